"""Shared business measures as Column builders.

Everything here is a plain ``pyspark.sql.Column`` expression, so it stays
inside whole-stage codegen; nothing is a UDF.

Money is carried exactly through every sum (as integer cents inside the
aggregation, as decimals outside it). A ratio is taken only once at the end,
on doubles converted from those exact sums, so the result is the correctly
rounded quotient of exact values on any engine.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units used for display, as in the reference dashboard.
LAKH = 1e5
CRORE = 1e7

def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec(value: str) -> Column:
    """An exact decimal literal (``F.lit(0.35)`` would be a double)."""
    return F.lit(Decimal(value))


def as_double(c: str | Column) -> Column:
    return col(c).cast("double")


def div0(a: str | Column, b: str | Column) -> Column:
    """Warehouse ``DIV0``: NULL when either side is NULL, 0 when ``b`` is 0,
    otherwise ``a / b`` as a double."""
    a, b = as_double(a), as_double(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(
        b == 0, F.lit(0.0)
    ).otherwise(a / b)


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b`` as a double, NULL when ``b`` is 0 or NULL (pandas would give
    inf / NaN there)."""
    a, b = as_double(a), as_double(b)
    return F.when(b != 0, a / b)


_EXACT = r"^(decimal\(\d+,[0-2]\)|(tiny|small|big)?int|void)$"


def cents(c: str | Column) -> Column:
    """An amount with at most 2 decimals as exact integer cents (bigint).
    The multiplication stays within 18 digits, so Spark keeps it on longs.

    Doubles and wider scales would be cut off by the cast, so they raise; the
    type is known when the plan is made, and the check folds away."""
    kind = F.typeof(col(c))
    refused = F.raise_error(F.concat(F.lit("an amount must be a decimal of scale 2 or less, not "), kind))
    return F.when(kind.rlike(_EXACT), (col(c) * dec("100")).cast("long")).otherwise(refused.cast("long"))


def from_cents(c: str | Column) -> Column:
    """Integer cents back to an exact decimal(23,2)."""
    return col(c).cast("decimal(20,0)") * dec("0.01")


def sum_cents(cents_expr: Column) -> Column:
    """Sum of integer cents, back to an exact decimal(23,2).

    Summing longs is about twice as fast as summing decimal(12,2) (whose
    buffer is wider than 18 digits and falls back to BigDecimal per row), and
    is still exact; a long holds 9.2e16 rupees of cents per group, and ANSI
    mode raises rather than wraps if a group ever exceeded that."""
    return from_cents(F.sum(cents_expr))


def money_sum(c: str | Column) -> Column:
    """Exact sum of an amount column (scale <= 2)."""
    return sum_cents(cents(c))


def exact_mean(c: str | Column) -> Column:
    """Mean of an exact amount: exact sum, then one division.

    ``avg`` on decimals rounds to a fixed scale and ``avg`` on doubles depends
    on summation order; this does neither.
    """
    c = col(c)
    return F.when(F.count(c) > 0, money_sum(c).cast("double") / F.count(c))


def round_half_up(c: str | Column, digits: int) -> Column:
    """Round a double half away from zero with plain IEEE steps
    (scale, add one half, floor, unscale), so it is the same on every engine."""
    c = as_double(c)
    scale = float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5).cast("double") / scale


def change_pct(now: str | Column, base: str | Column) -> Column:
    """Percent change of ``now`` against ``base``; NULL for a zero base."""
    now, base = as_double(now), as_double(base)
    return F.when(base != 0, (now - base) / base * 100.0)


def contribution_margin(
    revenue: str | Column,
    refunds: str | Column,
    commission: str | Column,
    cogs: str | Column,
    packaging: str | Column,
    logistics: str | Column,
    reverse_logistics: str | Column,
) -> Column:
    """The one definition of contribution margin:
    revenue - refunds - commission - cogs - packaging - logistics - reverse logistics."""
    parts = [refunds, commission, cogs, packaging, logistics, reverse_logistics]
    return reduce(lambda acc, p: acc - col(p), parts, col(revenue))


def gross_margin(
    revenue: str | Column,
    commission: str | Column,
    cogs: str | Column,
    packaging: str | Column,
    logistics: str | Column,
) -> Column:
    """Margin before returns: contribution margin with zero refunds and reverse logistics."""
    return reduce(lambda acc, p: acc - col(p), [commission, cogs, packaging, logistics], col(revenue))


def zero_if_null(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


def merge_on_keys(keys: list[str], left: DataFrame, *others: DataFrame) -> DataFrame:
    """Left-join grouped frames on ``keys``, NULL matching NULL (``<=>``),
    without a join: the frames are stacked and grouped once on the keys.

    Each frame must hold one row per key (a grouping), and the keys of the
    others must occur in ``left`` (they are groupings of the same fact rows),
    so each key's row takes every column from the one frame that has it. The
    frames are already hash-partitioned on the keys by their own grouping;
    the stack needs one small exchange of the grouped rows, where a null-safe
    join would re-shuffle both sides on ``coalesce``/``isnull`` expressions
    and sort them."""
    frames = (left, *others)
    fields = [f for df in frames for f in df.schema.fields if f.name not in keys]
    parts = []
    for i, df in enumerate(frames):
        own = set(df.columns)
        cols = [F.col(f.name) if f.name in own else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        parts.append(df.select(*keys, F.lit(i == 0).alias("__left"), *cols))
    stacked = reduce(DataFrame.unionByName, parts)
    merged = stacked.groupBy(*keys).agg(
        F.max("__left").alias("__left"), *[F.max(f.name).alias(f.name) for f in fields]
    )
    return merged.where(F.col("__left")).drop("__left")

