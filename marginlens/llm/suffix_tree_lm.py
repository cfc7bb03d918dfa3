"""LM scoring with a probabilistic suffix tree.

The model reads a text as its lower-cased (A-Z) words joined by single spaces
and one end sign, byte by byte. Contexts of up to ``depth`` bytes are nodes of
a suffix tree. A context stays when it occurs at least ``least`` times and its
next-symbol distribution diverges from that of its suffix by more than a BIC
penalty; its suffixes stay with it. Next-symbol distributions are smoothed
towards the suffix's, down to the root. A symbol is scored in the state of the
longest suffix of the text so far that the tree holds.

Counts are taken over all training texts: every task counts its n-grams and
Spark sums them. ``least`` is a count, not a share, and nothing bounds the
number of contexts: the tree grows with the input. It is a written table, a row
per context. Only its ``head``, the most frequent contexts, goes to the
executors: with all prefixes, so that one step never loses a longer suffix, it
forms an automaton that is walked over many strips of text at once. A place
whose context goes on into the rest of the tree, the tail, is found by a Bloom
filter of fixed size; its n-gram is looked up in the table by a join on the
contexts, and the score of the longest one replaces the head's. What the filter
takes for a context by chance finds none there and keeps the head's score, so
the size of head and filter changes the work, not the result.

Beside it stands a word unigram score with add-one smoothing. Word counts are
kept whole. Words that make up ``frequent`` or more of the training tokens (at
most 1/``frequent`` of them) go to every executor; the others are looked up by
a join on the word, from which the frequent words, its hot keys, are gone.

Null text counts as empty: its only token is the end. Null ids are scored but
not learned from. Repeated rows are kept and counted one by one. Without
training texts every symbol has probability 1/256 and no word is known.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.llm.common import forget, mark, saved, slices

END = 10  # a byte that no word holds; also stands before the first word
MAX_DEPTH = 6  # an n-gram of depth + 1 bytes is one 64-bit integer
FILTER_BITS = 26  # the filter holds 2 ** FILTER_BITS bits, 8 MiB


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def stream(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, is a symbol, lengths): each text as ``depth`` end signs, its
    bytes and an end sign; the leading signs are context only."""
    pad = bytes([END]) * depth
    flat = [b" ".join(words) for words in texts]
    lengths = np.array([len(x) + 1 for x in flat], np.int64)
    data = np.frombuffer(b"".join(pad + x + bytes([END]) for x in flat), np.uint8)
    real = np.ones(len(data), bool)
    starts = np.concatenate([[0], np.cumsum(lengths + depth)[:-1]]) if len(flat) else np.zeros(0, np.int64)
    for i in range(depth):
        real[starts + i] = False
    return data, real, lengths


def grams(data: np.ndarray, depth: int) -> np.ndarray:
    """The code of the ``depth`` + 1 bytes that end at each place, the last
    byte lowest; built from codes of half the length."""
    out, have = data.astype(np.int64), 1
    while have <= depth:
        more = min(have, depth + 1 - have)
        before = (out[:-have] & ((1 << 8 * more) - 1)) << 8 * have
        out = out.copy()
        out[have:] |= before
        have += more
    return out


def _groups(batches, size: int = 1 << 21) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    """Texts as words, in groups of about ``size`` bytes."""
    rows, texts, held = [], [], 0
    for batch in batches:
        for part in slices(batch, 128):
            own = part.column("text").to_pylist()
            rows.append(part)
            texts += [words_of(t) for t in own]
            held += sum(len(t) for t in own if t)
            if held >= size:
                yield rows, texts
                rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def counts(docs: DataFrame, depth: int) -> DataFrame:
    """(code, word, n) of all texts, read once: n-grams have a code, words (the
    end sign among them) a word, the other is null. A task merges its n-grams
    when they are over three million and hands them on when over two million
    are left; likewise its words at 400,000. What tasks hand on is summed
    behind the shuffle: before it there is little left to merge."""

    def run(batches):
        parts, held = [], 0
        words: Counter = Counter()
        for _, texts in _groups(batches):
            words[bytes([END])] += len(texts)
            for own in texts:
                words.update(own)
            if len(words) > 400_000:
                yield from _rows(None, list(words.keys()), list(words.values()))
                words = Counter()
            data, real, _ = stream(texts, depth)
            parts.append(np.unique(grams(data, depth)[real], return_counts=True))
            held += len(parts[-1][0])
            if held > 3_000_000:
                codes, n = _merged(parts)
                if len(codes) > 2_000_000:
                    yield from _rows(codes, None, n)
                    parts, held = [], 0
                else:
                    parts, held = [(codes, n)], len(codes)
        codes, n = _merged(parts)
        yield from _rows(codes, None, n)
        yield from _rows(None, list(words.keys()), list(words.values()))

    rows = docs.select("text").mapInArrow(run, "code long, word binary, n long")
    return rows.repartition("code", "word").groupBy("code", "word").agg(F.sum("n").alias("n"))


def _rows(codes, words, n, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), rows):
        own = pa.array(n[at : at + rows], pa.int64())
        cols = [
            pa.nulls(len(own), pa.int64()) if codes is None else pa.array(codes[at : at + rows]),
            pa.nulls(len(own), pa.binary()) if words is None else pa.array(words[at : at + rows], pa.binary()),
            own,
        ]
        yield pa.RecordBatch.from_arrays(cols, ["code", "word", "n"])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in parts)])
    counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
    if not len(codes):
        return codes, counts
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


@dataclass(frozen=True)
class Tree:
    """The automaton. symbol: class of each byte; rare bytes share one. step
    and score: by state * classes + class; offset: log10 share of a byte in its
    class; known: by state, length of the longest suffix that is a context if
    the tail goes on from it, else ``depth``."""

    depth: int
    classes: int
    symbol: np.ndarray
    offset: np.ndarray
    step: np.ndarray
    score: np.ndarray
    known: np.ndarray

    def scores(self, data: np.ndarray, strips: int = 8192, block: int = 1 << 22) -> np.ndarray:
        """log10 probability of the byte at each place, given what precedes."""
        return self.walk(data, strips, block)[0]

    def walk(self, data: np.ndarray, strips: int = 8192, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """``scores``, and ``known`` of the state each was taken in."""
        out, known = np.empty(len(data)), np.empty(len(data), np.uint8)
        lead = np.full(self.depth, END, np.uint8)
        for at in range(0, len(data), block):
            piece = np.concatenate([lead, data[at : at + block]])
            out[at : at + block], known[at : at + block] = self._walk(piece, strips)
            lead = piece[len(piece) - self.depth :]
        return out, known

    def _walk(self, data: np.ndarray, strips: int) -> tuple[np.ndarray, np.ndarray]:
        """Each strip starts ``depth`` symbols early, after which its state is
        that of the whole text."""
        n = len(data) - self.depth
        long = max(64, -(-n // strips))
        strips = -(-n // long)
        sym = np.concatenate([self.symbol[data], np.zeros(strips * long - n, np.uint16)])
        rows = np.lib.stride_tricks.as_strided(sym, (strips, long + self.depth), (2 * long, 2))
        columns = np.ascontiguousarray(rows.T)
        got, known = np.empty((long, strips), np.float32), np.empty((long, strips), np.uint8)
        state = np.zeros(strips, np.int32)
        for i, column in enumerate(columns):
            at = state * np.int32(self.classes) + column
            if i >= self.depth:
                np.take(self.score, at, out=got[i - self.depth])
                np.take(self.known, state, out=known[i - self.depth])
            state = np.take(self.step, at)
        return got.T.reshape(-1)[:n] + self.offset[data[self.depth :]], known.T.reshape(-1)[:n]


def _context(code: Column, k: Column, depth: int) -> Column:
    """The ``k`` bytes before the last one of an n-gram."""
    masks = F.array(*[F.lit((1 << 8 * j) - 1) for j in range(depth + 1)])
    return F.shiftrightunsigned(code, 8).bitwiseAND(F.element_at(masks, k + 1))


def states(counts: DataFrame, depth: int, least: int) -> DataFrame:
    """(k, ctx, total, above, next) of the contexts that stay and of the root
    (k = 0): length, bytes, occurrences, those of the suffix one byte shorter
    (null for the root), and a struct (sym, n) per next symbol."""
    each = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("k")
    rows = counts.select(each, "code", "n").select("k", _context(F.col("code"), F.col("k"), depth).alias("ctx"), F.col("code").bitwiseAND(255).cast("int").alias("sym"), "n")
    since = mark()
    rows = saved(rows.groupBy("k", "ctx", "sym").agg(F.sum("n").alias("n")), "lm-contexts")
    often = rows.groupBy("k", "ctx").agg(F.sum("n").alias("total")).where((F.col("total") >= least) | (F.col("k") == 0))
    # A context has at most 256 next symbols, and 256 contexts one byte longer.
    nodes = rows.join(often, ["k", "ctx"]).groupBy("k", "ctx", "total").agg(F.array_sort(F.collect_list(F.struct("sym", "n"))).alias("next"))
    nodes = saved(nodes, "lm-nodes")
    size = nodes.where("k = 0").agg(F.max("total")).first()[0] or 0
    masks = F.array(*[F.lit((1 << 8 * j) - 1) for j in range(depth)])
    longer = nodes.where("k > 0").withColumn("pk", F.col("k") - 1).withColumn("pctx", F.col("ctx").bitwiseAND(F.element_at(masks, F.col("k"))))
    suffix = nodes.select(F.col("k").alias("pk"), F.col("ctx").alias("pctx"), F.col("total").alias("above"), F.map_from_entries("next").alias("pnext"))
    one = lambda x: x["n"] * F.log(x["n"] * F.col("above") / (F.col("total") * F.element_at("pnext", x["sym"])))
    gain = F.aggregate("next", F.lit(0.0), lambda sum_, x: sum_ + one(x))
    tested = longer.join(suffix, ["pk", "pctx"]).select("k", "ctx", "total", "above", "next", (gain > F.size("next") * (0.5 * float(np.log(max(size, 2))))).alias("differs"))
    tested = saved(tested, "lm-tested")
    each = F.explode(F.sequence(F.lit(1), F.col("k"))).alias("k")
    closed = tested.where("differs").select(each, "ctx").select("k", _context(F.col("ctx") * 256, F.col("k"), depth).alias("ctx")).distinct()
    root = nodes.where("k = 0").select("k", "ctx", "total", F.lit(None).cast("long").alias("above"), "next")
    found = saved(root.unionByName(tested.drop("differs").join(closed, ["k", "ctx"])), "lm-states")
    forget(counts.sparkSession, since, keep=[found])
    return found


def head_and_tail(found: DataFrame, most: int) -> tuple[list, dict[tuple[int, int], list], DataFrame]:
    """(next symbols of the root, {(length, context): next symbols} of the
    ``most`` most frequent contexts, states of all others). A suffix is at
    least as frequent as what it is a suffix of, and shorter: the head holds
    the suffixes of its contexts. ``front`` marks contexts of the tail whose
    suffix ``pctx``, one byte shorter, is in the head."""
    pairs = lambda own: [(x["sym"], x["n"]) for x in own]
    root = [x for r in found.where("k = 0").select("next").toArrow().column("next").to_pylist() for x in pairs(r)]
    masks = F.array(*[F.lit((1 << 8 * j) - 1) for j in range(MAX_DEPTH)])
    deep = found.where("k > 0").withColumn("pctx", F.col("ctx").bitwiseAND(F.element_at(masks, F.col("k"))))
    first = deep.orderBy(F.desc("total"), "k", "ctx").limit(most).select("k", "ctx", "total", "next").toArrow()
    nodes, last = {}, None
    for part in first.to_batches():
        for k, ctx, total, own in zip(*(part.column(i).to_pylist() for i in range(4))):
            nodes[k, ctx], last = pairs(own), (total, k, ctx)
    if last is None:
        return root, nodes, deep.withColumn("front", F.col("k") == 1)

    def behind(total: str, k: Column, ctx: str) -> Column:
        later = (k > last[1]) | ((k == last[1]) & (F.col(ctx) > last[2]))
        return (F.col(total) < last[0]) | ((F.col(total) == last[0]) & later)

    front = (F.col("k") == 1) | ~behind("above", F.col("k") - 1, "pctx")
    return root, nodes, deep.where(behind("total", F.col("k"), "ctx")).withColumn("front", front)


def bits_of(ctx: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
    """The places of contexts of ``k`` bytes in the filter."""
    key = ctx.astype(np.uint64) | (k.astype(np.uint64) << np.uint64(48))
    return [(key * np.uint64(odd)) >> np.uint64(64 - FILTER_BITS) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def tail_filter(tail: DataFrame) -> tuple[np.ndarray, set[tuple[int, int]]]:
    """(Bloom filter, as bytes, over the contexts at the tail's front; the
    contexts of the head, or the root (0, 0), that they are one byte longer than)."""
    front = tail.where("front")

    def run(batches):
        held = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            for at in bits_of(batch.column("ctx").to_numpy(), batch.column("k").to_numpy()):
                np.bitwise_or.at(held, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at].astype(np.int16))], ["at", "held"])

    parts = front.select("k", "ctx").mapInArrow(run, "at long, held short")
    got = parts.groupBy("at").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    out[got.column("at").to_numpy()] = got.column("held").to_numpy().astype(np.uint8)
    opened = front.select((F.col("k") - 1).alias("k"), "pctx").distinct().toArrow()
    return out, set(zip(opened.column("k").to_pylist(), opened.column("pctx").to_pylist()))


def in_tail(data: np.ndarray, real: np.ndarray, known: np.ndarray, held: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, their n-grams) whose context may go on into the tail: the
    filter holds the one that is a byte longer than the head's."""
    at = np.flatnonzero(real & (known < depth))
    code = np.zeros(len(at), np.int64)
    for j in range(depth + 1):
        code |= data[at - j].astype(np.int64) << 8 * j
    k = known[at] + 1
    hit = np.ones(len(at), bool)
    for bit in bits_of((code >> 8) & ((np.int64(1) << (8 * k.astype(np.int64))) - 1), k):
        hit &= (held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return at[hit], code[hit]


def looked_up(hits: DataFrame, tail: DataFrame, depth: int, smooth: float) -> DataFrame:
    """(row, deeper): what the tail adds to the head's score of each row. hits
    (row, code, known, base, tf): the n-grams of ``in_tail`` with the length of
    the head's context and its score, which a code determines."""
    each = F.explode(F.sequence(F.col("known") + 1, F.lit(depth))).alias("k")
    asked = hits.groupBy("code").agg(F.max("known").alias("known"), F.max("base").alias("base")).select("code", "base", each)
    asked = asked.withColumn("ctx", _context(F.col("code"), F.col("k"), depth))
    n = F.coalesce(F.try_element_at(F.map_from_entries("next"), F.col("code").bitwiseAND(255).cast("int")), F.lit(0))
    met = asked.join(tail.select("k", "ctx", "total", "next"), ["k", "ctx"]).select("code", "base", F.struct("k", n.alias("n"), "total").alias("at"))
    steps = met.groupBy("code", "base").agg(F.array_sort(F.collect_list("at")).alias("steps"))  # at most ``depth``
    p = F.aggregate("steps", F.pow(F.lit(10.0), F.col("base")), lambda p, x: (x["n"] + smooth * p) / (x["total"] + smooth))
    better = steps.select("code", (F.log10(p) - F.col("base")).alias("more"))
    return hits.select("row", "code", "tf").join(better, "code").groupBy("row").agg(F.sum(F.col("tf") * F.col("more")).alias("deeper"))


def build(root: list[tuple[int, int]], nodes: dict[tuple[int, int], list], depth: int, least: float, smooth: float, opened: set[tuple[int, int]] = frozenset()) -> Tree:
    count = np.zeros(256)
    for s, n in root:
        count[s] = n
    total = count.sum()
    # Bytes below the share ``least`` get one class, unless a context holds them.
    held = {b for k, c in nodes for b in c.to_bytes(k, "big")} | {END}
    common = np.flatnonzero((count >= max(1.0, least * total)) | np.isin(np.arange(256), list(held)))
    symbol = np.zeros(256, np.uint16)
    symbol[common] = np.arange(1, len(common) + 1)
    classes = len(common) + 1
    size = np.bincount(symbol, count + 1, classes)
    offset = np.log10((count + 1) / size[symbol])
    # States: the contexts, oldest byte first, and all their prefixes.
    names = {c.to_bytes(k, "big") for k, c in nodes}
    own = {c.to_bytes(k, "big"): rows for (k, c), rows in nodes.items()}
    names = sorted({n[:i] for n in names for i in range(len(n) + 1)} | {b""}, key=lambda n: (len(n), n))
    at = {n: i for i, n in enumerate(names)}
    step = np.zeros((len(names), classes), np.int32)
    score = np.zeros((len(names), classes), np.float32)
    known = np.full(len(names), 0 if (0, 0) in opened else depth, np.uint8)
    for i, name in enumerate(names):
        link = name[1:]
        while name and link not in at:
            link = link[1:]
        if not name:
            score[i] = size / size.sum()
        else:
            step[i], score[i], known[i] = step[at[link]], score[at[link]], known[at[link]]
            if name in own:
                known[i] = len(name) if (len(name), int.from_bytes(name, "big")) in opened else depth
                n = np.zeros(classes)
                for s, c in own[name]:
                    n[symbol[s]] += c
                score[i] = (n + smooth * score[i]) / (n.sum() + smooth)
        for s in common:
            longer = at.get(name + bytes([s]))
            if longer is not None:
                step[i, symbol[s]] = longer
    return Tree(depth, classes, symbol, offset, step.ravel(), np.log10(score, out=score).ravel(), known)


def scores(docs: DataFrame, training: Column, frequent: float = 2e-6, depth: int = 6, least: int = 50, head: int = 100_000, smooth: float = 4.0) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every
    row of ``docs``, learned from the rows where ``training`` is true. ``head``
    and ``frequent`` say what goes to the executors; neither changes a result."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not 0 < depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 1 to {MAX_DEPTH}")
    found = saved(counts(docs.where(training), depth), "lm-counts")
    context_rows = states(found.where(F.col("code").isNotNull()).select("code", "n"), depth, least)
    root, nodes, tail = head_and_tail(context_rows, head)
    held, opened = tail_filter(tail) if len(nodes) == head else (None, set())
    tree = build(root, nodes, depth, frequent, smooth, opened)
    words = found.where(F.col("word").isNotNull()).select("word", F.col("n").alias("c"))
    got = words.agg(F.sum("c"), F.count("*")).first()
    tokens, distinct = got[0] or 0, got[1]
    end = F.col("word") == F.lit(bytes([END]))  # in every text, however long the texts are
    often = words.where((F.col("c") >= max(1.0, frequent * tokens)) | end).toArrow()
    near = dict(zip(often.column("word").to_pylist(), often.column("c").to_pylist()))
    shared = spark.sparkContext.broadcast((tree, {w: float(np.log10(c + 1)) for w, c in near.items()}, held))

    def run(batches):
        model, near, held = shared.value
        part = TaskContext.get().partitionId() << 40
        done = 0
        for rows, texts in _groups(batches):
            data, real, lengths = stream(texts, model.depth)
            each, known = model.walk(data)
            each = np.where(real, each, 0.0)
            starts = np.concatenate([[0], np.cumsum(lengths + model.depth)[:-1]])
            ends = near.get(bytes([END]))
            sums, found, tails, tfs, stops = [], [], [], [], [0]
            for own in texts:
                values = list(map(near.get, own))
                rest = Counter(w for w, v in zip(own, values) if v is None)
                sums.append(sum(filter(None, values)) + (ends or 0.0))
                found.append(len(own) - rest.total() + (ends is not None))
                tails += rest.keys()
                tfs += rest.values()
                stops.append(len(tails))
            tail = pa.StructArray.from_arrays([pa.array(tails, pa.binary()), pa.array(tfs, pa.int32())], ["word", "tf"])
            ids = pa.concat_arrays([r.column("doc_id") for r in rows])
            cols = [
                pa.array(np.arange(done, done + len(texts)) + part),
                ids,
                pa.array([len(t) + 1 for t in texts], pa.int64()),
                pa.array(found, pa.int64()),
                pa.array(sums, pa.float64()),
                pa.array(np.add.reduceat(each, starts)),
                pa.ListArray.from_arrays(np.array(stops, np.int32), tail),
                _deeper(data, real, known, each, starts, held, model.depth),
            ]
            done += len(texts)
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_tokens", "found", "sums", "score", "tail", "grams"])

    schema = f"row long, doc_id {kind}, n_tokens long, found long, sums double, score double, tail array<struct<word: binary, tf: int>>, grams array<struct<code: long, known: int, base: double, tf: int>>"
    scored = saved(docs.select("doc_id", "text").mapInArrow(run, schema), "lm-scored")
    words_met = scored.select("row", F.explode("tail").alias("at")).select("row", "at.word", "at.tf")
    met = words_met.join(words, "word").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("gain"))
    out = scored.drop("tail", "grams").join(met, "row", "left")
    if held is None:
        out = out.withColumn("deeper", F.lit(0.0))
    else:
        out = out.join(looked_up(scored.select("row", F.inline("grams")), tail, depth, smooth), "row", "left")
    floor = float(np.log10(tokens + distinct + 1))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("found") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("score") + F.coalesce("deeper", F.lit(0.0))).alias("score"),
    )


def _deeper(data, real, known, each, starts, held, depth: int) -> pa.Array:
    """Per text, its distinct n-grams that may reach the tail, with their frequency."""
    if held is None:
        return pa.ListArray.from_arrays(np.zeros(len(starts) + 1, np.int32), pa.StructArray.from_arrays([pa.nulls(0, t) for t in _GRAM.values()], list(_GRAM)))
    at, code = in_tail(data, real, known, held, depth)
    text = np.searchsorted(starts, at, "right") - 1
    order = np.lexsort((code, text))
    at, code, text = at[order], code[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])])[: len(at)])
    tf = np.diff(np.append(first, len(at)))
    values = code[first], known[at[first]], each[at[first]], tf
    rows = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(values, _GRAM.values())], list(_GRAM))
    return pa.ListArray.from_arrays(np.searchsorted(text[first], np.arange(len(starts) + 1)).astype(np.int32), rows)


_GRAM = {"code": pa.int64(), "known": pa.int32(), "base": pa.float64(), "tf": pa.int32()}
