"""Quality classifier: random Fourier features over document statistics.

Each text becomes a short vector of statistics (shares of byte classes, word
and line repetition, compressibility). Random Fourier features approximate a
Gaussian kernel over the standardised vectors; ridge regression on them is
solved from normal equations that every partition sums for itself, and an
isotonic map (pool adjacent violators over fine score bins) turns the ridge
value into a probability.

What reaches the driver is bounded: one row of moments, one (D+1) x (D+2)
matrix, and one row per score bin.

Null text counts as empty. Empty texts get the statistics of the empty string
and are scored like any other. Rows repeat as they come in. Without any
labelled row the score is 0.5 for every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from marginlens.llm.common import learned, map_batches, saved

STATISTICS = (
    "log_words",
    "log_word_bytes",
    "upper_share",
    "digit_share",
    "symbol_share",
    "bar_share",
    "mark_share",
    "stop_share",
    "space_share",
    "line_share",
    "wide_share",
    "distinct_words",
    "top_word_share",
    "distinct_lines",
    "compressed_share",
)
BINS = 4096
LOW, HIGH = -1.0, 2.0

_SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]\\_+=`", np.uint8)


@dataclass(frozen=True)
class Model:
    """All arrays are bounded by the number of statistics and features."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8)
        wave = np.cos(z @ self.weights + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(x), 1)), wave])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.interp(self.margin(x), self.knots, self.values)


def statistics(text: str | None, packer: zstandard.ZstdCompressor) -> list[float]:
    data = (text or "").encode("utf-8", "replace")
    size = max(len(data), 1)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x]
    often = Counter(words)
    n = len(words)
    upper = int(count[65:91].sum())
    letters = max(upper + int(count[97:123].sum()), 1)
    return [
        np.log1p(n),
        np.log1p(sum(map(len, words)) / max(n, 1)),
        upper / letters,
        int(count[48:58].sum()) / size,
        int(count[_SYMBOLS].sum()) / size,
        int(count[124]) / size,
        int(count[33] + count[63]) / size,
        int(count[44] + count[46]) / size,
        int(count[32]) / size,
        int(count[10]) / size,
        int(count[128:].sum()) / size,
        np.log1p(len(often)) / np.log1p(max(n, 1)),
        max(often.values(), default=0) / max(n, 1),
        len(set(lines)) / max(len(lines), 1),
        len(packer.compress(data)) / (size + 16),
    ]


def _matrix(texts: pa.Array) -> np.ndarray:
    packer = zstandard.ZstdCompressor(level=1)
    return np.array([statistics(t, packer) for t in texts.to_pylist()], float).reshape(len(texts), len(STATISTICS))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        x = _matrix(batch.column("text"))
        lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, x array<double>")


def labelled(x: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, x, n, s): rows with a label; n labels were given to the id, s
    of them 1. Labels meet documents after they are summed per id, so repeated
    ids on both sides don't multiply. Null ids and labels take no part."""
    given = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.count("*").cast("double").alias("n"), F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("s"))
    )
    return x.join(given, "doc_id").select("doc_id", "x", "n", "s")


def fit(training: DataFrame, features: int = 256, width: float = 0.6, penalty: float = 1.0, seed: int = 7) -> Model:
    """Fit on rows (doc_id, x, n, s). A quarter of the ids, by crc32 of the id
    with a suffix, calibrates; the rest solves the ridge. If one part is empty
    both use all rows."""
    width = width / np.sqrt(len(STATISTICS))
    k = len(STATISTICS)
    rng = np.random.default_rng(seed)
    weights, phases = rng.normal(0, width, (k, features)), rng.uniform(0, 2 * np.pi, features)
    training = training.withColumn("cal", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":cal"))) % 4 == 0)
    sums = [F.sum("n").alias("n"), F.sum(F.when(F.col("cal"), F.col("n"))).alias("cal")]
    for i in range(k):
        sums += [F.sum(F.col("n") * F.col("x")[i]).alias(f"a{i}"), F.sum(F.col("n") * F.col("x")[i] ** 2).alias(f"b{i}")]
    got = training.agg(*sums).first()
    if not got["n"]:
        none = np.zeros(0)
        return Model(np.zeros(k), np.ones(k), weights, phases, np.zeros(features + 1), none, none)
    center = np.array([got[f"a{i}"] for i in range(k)]) / got["n"]
    spread = np.array([got[f"b{i}"] for i in range(k)]) / got["n"] - center**2
    scale = np.where(spread > 1e-12, np.sqrt(np.maximum(spread, 1e-12)), 1.0)
    start = Model(center, scale, weights, phases, np.zeros(features + 1), np.zeros(0), np.zeros(0))
    split = 0 < (got["cal"] or 0) < got["n"]
    ridge = _solve(training.where(~F.col("cal")) if split else training, start, penalty)
    model = Model(center, scale, weights, phases, ridge, np.zeros(0), np.zeros(0))
    return _calibrate(training.where("cal") if split else training, model)


def _solve(training: DataFrame, model: Model, penalty: float) -> np.ndarray:
    """Each task sums its own Z'Z and Z'y and emits the matrix by rows; the
    rows of equal number are summed in a second step."""
    size = len(model.phases) + 1

    def part(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            x, n, s = _read(batch)
            z = model.features(x)
            total[:, :size] += (z * n[:, None]).T @ z
            total[:, size] += z.T @ s
        yield _rows(np.arange(size, dtype=np.int32), total)

    def add(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1)
        for batch in tables:
            total += batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size + 1).sum(0)
        yield _rows(np.array([key[0].as_py()], np.int32), total[None, :])

    schema = "row int, v array<double>"
    parts = training.select("x", "n", "s").mapInArrow(part, schema)
    summed = parts.groupBy("row").applyInArrow(add, schema).collect()
    full = np.zeros((size, size + 1))
    for r in summed:
        full[r["row"]] = r["v"]
    lam = np.full(size, penalty)
    lam[0] = 1e-6
    return np.linalg.solve(full[:, :size] + np.diag(lam), full[:, size])


def _rows(numbers: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    v = pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), values.ravel())
    return pa.RecordBatch.from_arrays([pa.array(numbers), v], ["row", "v"])


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
    return x, batch.column("n").to_numpy(zero_copy_only=False), batch.column("s").to_numpy(zero_copy_only=False)


def _calibrate(training: DataFrame, model: Model) -> Model:
    """Isotonic regression over bins of the ridge value: rows are counted per
    bin where they are, at most BINS rows reach the driver."""

    def part(batches):
        n, s, v = np.zeros(BINS), np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            x, own_n, own_s = _read(batch)
            value = model.margin(x)
            at = np.clip(((value - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
            n += np.bincount(at, own_n, BINS)
            s += np.bincount(at, own_s, BINS)
            v += np.bincount(at, own_n * np.clip(value, LOW, HIGH), BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(s[at]), pa.array(v[at])], ["bin", "n", "s", "v"])

    parts = training.select("x", "n", "s").mapInArrow(part, "bin int, n double, s double, v double")
    bins = parts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v")).orderBy("bin").collect()
    knots, values = pool([(r["v"], r["s"], r["n"]) for r in bins])
    return Model(model.center, model.scale, model.weights, model.phases, model.ridge, knots, values)


def pool(blocks: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators. blocks: (sum of value, sum of label, weight) by
    rising value. Returns the blocks' mean values and label means, between
    which scores are interpolated; one pseudo-label of each kind keeps the
    ends inside (0, 1)."""
    out: list[list[float]] = []
    for v, s, n in blocks:
        out.append([v, s, n])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            v, s, n = out.pop()
            out[-1] = [out[-1][0] + v, out[-1][1] + s, out[-1][2] + n]
    knots = np.array([v / n for v, _, n in out])
    values = np.array([(s + 0.01) / (n + 0.02) for _, s, n in out])
    return knots, np.maximum.accumulate(values)


def train(x: DataFrame, labels: DataFrame, **how) -> Model:
    """Fit on the labelled rows whose id fold (mod 5) isn't 0."""
    rows = labelled(x.where(learned(F.col("doc_id"), 5, 0)), labels)
    return fit(saved(rows, "quality-training"), **how)


def score_statistics(x: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from rows (doc_id, x)."""
    kind = x.schema["doc_id"].dataType.simpleString()
    shared = x.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(values))], ["doc_id", "score"])

    return map_batches(x, run, f"doc_id {kind}, score double")


def score_column(spark, model: Model, text: str = "text") -> Column:
    """A column with the score of a whole text."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [shared.value.score(_matrix(pa.array(texts.iloc[i : i + 512], pa.string()))) for i in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(F.col(text))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every row of ``docs``, learned from ``labels``."""
    x = saved(with_statistics(docs), "quality-statistics")
    return score_statistics(x, train(x, labels))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose score is ``least`` or more."""
    x = with_statistics(docs.where(learned(F.col("doc_id"), 5, 0)))
    model = train(x, labels)
    return docs.where(score_column(docs.sparkSession, model) >= least)
