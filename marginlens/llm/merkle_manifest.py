"""Merkle manifest of a dataset with a membership witness for every row.

Rows are leaves. Within a group (a language) the leaves stand in order, and
level by level every two consecutive nodes become their hash; the last one of
an odd level is hashed alone. What remains is the group's subroot; the
subroots, in the order of the groups, give the root in the same way.

The witnesses are built incrementally. A block of ``2**BLOCK_BITS`` aligned
leaves is appended leaf by leaf to a row of open subtrees: two of one height
close to a subtree twice as large, and each side's root extends the partial
witness of every leaf on the other side. A task returns its block's root, the
witnesses as far as they go, and how often the root of an unfinished block is
still to be hashed alone. Block roots are then appended in the same way as
leaves of the next block, until a group has a single one; an upper witness
extends that of each row of its block. No task holds more than one block, and
the driver holds nothing of the data.

A witness is a row of steps of 33 bytes: the side of the sibling (0 none,
1 left, 2 right) and its digest. ``fold`` computes a root from a leaf and a
witness.

Nulls: each field that is null enters a leaf as ``-``; a null group comes first,
a null order value comes first in its group. Rows equal in group and order
stand by their leaf digest; repeated rows are leaves of their own with the same
digest. A null text or an empty one is hashed like any other (``-`` or ``0:``).
A table without rows gives no rows. Columns not named are not read, so their
names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.functions.slices import running, sliced
from marginlens.llm.common import map_batches, saved

BLOCK_BITS = 10
STEP = 33
ALONE, LEFT, RIGHT = b"\x00", b"\x01", b"\x02"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: Iterable[Column]) -> Column:
    """SHA-256 (binary) over the fields: ``-`` for null, else the length in UTF-8 bytes, ``:`` and the value."""
    parts = []
    for c in fields:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hash(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def append_block(hashes: list[bytes], lift: int, bits: int) -> tuple[list[bytes], bytes, int]:
    """Append the nodes of one block in order: their witnesses, the block's
    root, and how often that is to be hashed alone should the group go on.
    ``lift`` is that number of the block's last node."""
    witness = [bytearray() for _ in hashes]
    if len(hashes) == 1:
        return [b""], hashes[0], lift + bits
    open_: list[tuple[int, bytes, range]] = []  # heights fall from left to right

    def alone(height: int, digest: bytes, members: range) -> tuple[int, bytes, range]:
        for i in members:
            witness[i] += ALONE + bytes(STEP - 1)
        return height + 1, _hash(digest), members

    def close(node: tuple[int, bytes, range]) -> tuple[int, bytes, range]:
        while open_ and open_[-1][0] == node[0]:
            height, digest, members = open_.pop()
            for i in members:
                witness[i] += RIGHT + node[1]
            for i in node[2]:
                witness[i] += LEFT + digest
            node = height + 1, _hash(digest, node[1]), range(members.start, node[2].stop)
        return node

    for i, digest in enumerate(hashes):
        node = (0, digest, range(i, i + 1))
        if i == len(hashes) - 1:
            for _ in range(lift):
                node = (0, *alone(*node)[1:])
        open_.append(close(node))
    while len(open_) > 1:
        node = open_.pop()
        while node[0] < open_[-1][0]:
            node = alone(*node)
        open_.append(close(node))
    height, root, _ = open_[0]
    return [bytes(w) for w in witness], root, bits - height


def _appended(nodes: DataFrame, bits: int) -> DataFrame:
    """``nodes`` (grp, pos, hash, lift, ...) with witness, block_root and block_lift."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        lifts = block.column("lift").to_pylist()
        witness, root, lift = append_block(block.column("hash").to_pylist(), lifts[-1], bits)
        n = block.num_rows
        return (
            block.drop_columns(["__block"])
            .append_column("witness", pa.array(witness, pa.binary()))
            .append_column("block_root", pa.array([root] * n, pa.binary()))
            .append_column("block_lift", pa.array([lift] * n, pa.int32()))
        )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    blocks = nodes.withColumn("__block", F.shiftright("pos", bits)).groupBy("grp", "__block")
    return blocks.applyInArrow(run, f"{kinds}, witness binary, block_root binary, block_lift int")


def _above(nodes: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The nodes with their own block's part of the witness, and per block
    (grp, block, above, subroot): the rest of it and the group's root."""
    own = saved(_appended(nodes, bits), "merkle-blocks")
    first = own.where(F.col("pos") % (1 << bits) == 0)
    blocks = first.select("grp", F.shiftright("pos", bits).alias("pos"), F.col("block_root").alias("hash"), F.col("block_lift").alias("lift"))
    own = own.drop("lift", "block_root", "block_lift")
    if blocks.where("pos > 0").isEmpty():
        return own, blocks.select("grp", F.col("pos").alias("block"), F.unhex(F.lit("")).alias("above"), F.col("hash").alias("subroot"))
    upper, rest = _above(blocks, bits)
    return own, saved(_joined(upper, rest, bits).select("grp", F.col("pos").alias("block"), F.col("witness").alias("above"), "subroot"), "merkle-above")


def _joined(own: DataFrame, rest: DataFrame, bits: int) -> DataFrame:
    met = own.withColumn("block", F.shiftright("pos", bits)).join(rest, ["grp", "block"]).drop("block")
    return met.withColumn("witness", F.concat("witness", "above")).drop("above")


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    carry: dict[str, Column] | None = None,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """(order, leaf, subroot, root, witness, and the columns of ``carry``) for every row of ``docs``."""
    carry = carry or {}
    # A null group comes first, the others in the order of their UTF-8 bytes.
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    hashed = docs.select(grp.alias("grp"), F.col(order).alias("__order"), leaf(F.col(c) for c in fields).alias("hash"), *[c.alias(k) for k, c in carry.items()])
    save = lambda df: saved(df, "merkle-slices")
    cut = sliced(saved(hashed, "merkle-leaves"), ["grp"], [F.col("__order").asc_nulls_first(), F.col("hash").asc()], save)
    nodes = running(cut, ["grp"], {"n": ("sum", F.lit(1))})
    nodes = nodes.select("grp", (F.col("n") - 1).alias("pos"), "__order", "hash", F.lit(0).alias("lift"), *carry)
    own, rest = _above(nodes, bits)
    subroots = rest.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("subroot").alias("hash"))
    along = running(sliced(subroots, [], [F.col("of").asc()], save), [], {"n": ("sum", F.lit(1))})
    top = along.select("grp", (F.col("n") - 1).alias("pos"), "of", "hash", F.lit(0).alias("lift"))
    top = _joined(*_above(top, bits), bits).select(F.col("of").alias("grp"), F.col("witness").alias("up"), F.col("subroot").alias("root"))
    # The groups' part is added to the blocks, so no row of a large group is joined on the group alone.
    rest = rest.join(top, "grp").withColumn("above", F.concat("above", "up")).drop("up")
    return _joined(own, rest, bits).select(F.col("__order").alias(order), F.col("hash").alias("leaf"), "subroot", "root", "witness", *carry)


def steps(witness: bytes) -> list[tuple[bytes, bytes]]:
    return [(witness[i : i + 1], witness[i + 1 : i + STEP]) for i in range(0, len(witness), STEP)]


def fold(digest: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness give."""
    for side, sibling in steps(witness):
        digest = _hash(sibling, digest) if side == LEFT else _hash(digest, sibling) if side == RIGHT else _hash(digest)
    return digest


def verified(rows: DataFrame, claim: str, order: str = "doc_id") -> DataFrame:
    """Rows of ``manifest`` folded from the leaf in column ``claim`` (null: the
    row's own): (order, leaf, subroot, root, proof_sha256, folded_root,
    verified), digests as lowercase hex."""
    kind = rows.schema[order].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        cols = {c: batch.column(c).to_pylist() for c in ("leaf", "subroot", "root", "witness", claim)}
        folded = [fold(c or own, w) for c, own, w in zip(cols[claim], cols["leaf"], cols["witness"])]
        proofs = [hashlib.sha256("".join(s.hex() for side, s in steps(w) if side != ALONE).encode()).hexdigest() for w in cols["witness"]]
        hexes = [[d.hex() for d in cols[c]] for c in ("leaf", "subroot", "root")]
        right = [f == r for f, r in zip(folded, cols["root"])]
        arrays = [batch.column(order), *map(pa.array, hexes), pa.array(proofs), pa.array([f.hex() for f in folded]), pa.array(right)]
        yield pa.RecordBatch.from_arrays(arrays, names)

    names = [order, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    wanted = rows.select(order, "leaf", "subroot", "root", "witness", claim)
    return map_batches(wanted, run, f"`{order}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


__all__ = ["append_block", "fold", "leaf", "manifest", "steps", "verified"]
