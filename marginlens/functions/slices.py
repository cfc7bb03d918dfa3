"""Running totals along an order, exact for groups of any size.

A window with ``PARTITION BY k ORDER BY t`` runs a whole group in one task, and
a window without a partition the whole table. Here the rows are dealt to
*slices* by range over (keys, order), so a group of any size lies in as many
consecutive slices as it needs. Every slice runs its own window, and what the
earlier slices of the group add up to is carried in.

Only the first group of a slice can have begun in an earlier one, so at most
one row per slice is carried: the broadcast is bounded by the number of
slices (shuffle partitions), whatever the data.

``sliced`` writes the dealt rows, because range bounds are sampled and a
second evaluation could deal differently.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE, AT = "__slice", "__at"


def sliced(df: DataFrame, keys: list[str], order: list[Column], save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` in range slices by (keys, order), written by ``save``: with
    ``__slice`` and ``__at``, a number that ascends along (keys, order) over
    the whole table. Rows equal in all of these are dealt by their place in
    the input, so a heap of equal rows is split as well."""
    by = [F.col(k).asc_nulls_first() for k in keys] + list(order) + [F.col("__tie").asc()]
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie")
    return save(dealt.withColumn(AT, F.monotonically_increasing_id()).withColumn(SLICE, F.shiftright(AT, 33)))


def _last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


# kind: (window function, of a slice, carried and own combined)
_KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "sum": (F.sum, F.sum, lambda carried, own: F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0))),
    "xor": (F.bit_xor, F.bit_xor, lambda carried, own: F.coalesce(carried.bitwiseXOR(own), own, carried)),
    "max": (F.max, F.max, lambda carried, own: F.greatest(carried, own)),
    "last": (_last, None, lambda carried, own: F.coalesce(own, carried)),
}


def running(rows: DataFrame, keys: list[str], folds: dict[str, tuple[str, Column]], order: str = AT) -> DataFrame:
    """``rows`` (with ``__slice``) and, per name in ``folds``, the fold (kind,
    column) of the rows of the same keys up to and including each row along
    ``order``. Kinds: sum (nulls as 0), xor, max, last (the last value that is
    not null). Null keys are a group like any other."""
    own = Window.partitionBy(SLICE, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.select("*", *[_KINDS[kind][0](c).over(own).alias(name) for name, (kind, c) in folds.items()])
    return _carried_in(rows, within, keys, folds, order)


def before(rows: DataFrame, keys: list[str], folds: dict[str, tuple[str, Column]], order: str = AT) -> DataFrame:
    """As ``running``, of the rows before each row only (null, or 0 for sum, for a first row)."""
    own = Window.partitionBy(SLICE, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.select("*", *[_KINDS[kind][0](c).over(own).alias(name) for name, (kind, c) in folds.items()])
    return _carried_in(rows, within, keys, folds, order)


def _carried_in(rows: DataFrame, within: DataFrame, keys: list[str], folds: dict[str, tuple[str, Column]], order: str) -> DataFrame:
    def of_slice(kind: str, c: Column) -> Column:
        return _KINDS[kind][1](c) if _KINDS[kind][1] else F.max_by(c, F.when(c.isNotNull(), F.col(order)))

    ends = rows.groupBy(SLICE, *keys).agg(*[of_slice(kind, c).alias(f"__of_{name}") for name, (kind, c) in folds.items()])
    along = Window.partitionBy(*keys).orderBy(SLICE)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col(SLICE).alias("__to"),
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.lag(SLICE).over(along).alias("__from"),
        *[_KINDS[kind][0](F.col(f"__of_{name}")).over(earlier).alias(f"__c_{name}") for name, (kind, _) in folds.items()],
    ).where(F.col("__from").isNotNull())
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col(SLICE) == F.col("__to"))
    # At most one row per slice, see above.
    met = within.join(F.broadcast(carried), same, "left")
    kept = [c for c in within.columns if c not in folds]
    return met.select(*kept, *[_KINDS[kind][2](F.col(f"__c_{name}"), F.col(name)).alias(name) for name, (kind, _) in folds.items()])
