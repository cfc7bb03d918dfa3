"""Language identification by segmentation-marginalised unigrams.

Each language is a distribution over the pieces of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, which
a forward algorithm computes; a text's log probability is the sum over its
words. The piece probabilities are fitted by expectation maximisation
(forward-backward over the distinct words of each language).

Words are maximal runs of letters, each with the marks that follow it,
lower-cased; digits, fractions and number signs are none. A word starts with
the vocabulary's word mark. Characters that are no piece of their own share one
unknown piece. Pieces are looked up by a 64-bit hash.

The fit may use a sample: of more than ``fit_rows`` training rows each
language gives an equal share of them (see ``learn``). Every text is scored whole.

Null texts and texts without a letter are ``und`` with score 0. Without
training rows everything is ``und``. Null ids are scored, but not learned
from; rows without a language are not learned from. Repeated rows are kept.
Ties between languages go to the first in alphabetical order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.llm.common import saved, slices

PIECES = "piece_bpe_32k.model"
MAX_PIECE = 16  # the longest piece of the vocabulary: none is left out
UNDETERMINED = "und"
MIN_ROWS, LONG_WORD = 500, 48
_WORD = regex.compile(r"(?:\p{L}\p{M}*)+")  # letters with the marks that follow them
_MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """code: 0 for characters that are no piece, else from 1. keys[l], ids[l]: the sorted
    hashed pieces of l characters. Piece 0 is none, piece 1 the unknown character."""

    code: np.ndarray
    keys: list[np.ndarray]
    ids: list[np.ndarray]
    size: int


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    texts = [t for t in dict.fromkeys(texts) if t == t.lower()]
    single = sorted({c for t in texts for c in t if c.isalpha() or c == _MARK})
    code = np.zeros(0x110000, np.int64)
    code[[ord(c) for c in single]] = np.arange(1, len(single) + 1)
    known = set(single)
    if max((len(t) for t in texts if set(t) <= known), default=0) > MAX_PIECE:
        raise ValueError(f"a piece is longer than {MAX_PIECE} characters")
    keys, ids, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 2
    for n in range(1, MAX_PIECE + 1):
        own = sorted(_packed([code[ord(c)] for c in t]) for t in texts if len(t) == n and set(t) <= known)
        if len(set(own)) < len(own):
            raise ValueError("two pieces have one hash")
        keys.append(np.array(own, np.int64))
        ids.append(np.arange(size, size + len(own)))
        size += len(own)
    return Vocabulary(code, keys, ids, size)


_FACTOR = 0x9E3779B97F4A7C15  # odd: a product modulo 2^64 loses nothing


def _packed(codes) -> int:
    out = 0
    for c in codes:
        out = (out * _FACTOR + int(c)) & 0xFFFFFFFFFFFFFFFF
        out ^= out >> 29
    return out - (1 << 64) if out >> 63 else out


class Lattice:
    """All pieces of a list of words. Words are ordered by falling length, so
    that the words that reach a step are a prefix."""

    def __init__(self, words: list[str], vocab: Vocabulary):
        marked = [_MARK + w for w in words]
        length = np.array([len(w) for w in marked], np.int64)
        self.order = np.argsort(-length, kind="stable")
        self.length = length[self.order]
        self.longest = int(self.length[0]) if len(words) else 0
        self.active = np.searchsorted(-self.length, -np.arange(self.longest + 1), side="right")
        flat = "".join(marked[i] for i in self.order)
        codes = vocab.code[np.frombuffer(flat.encode("utf-32-le"), np.uint32)]
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]) if len(words) else self.length
        self.piece = []
        room = np.repeat(self.start + self.length, self.length) - np.arange(len(codes))
        at = np.flatnonzero(codes)
        key = codes[at].astype(np.uint64)
        key ^= key >> np.uint64(29)
        for n in range(1, MAX_PIECE + 1):
            if n > 1:  # what starts here and has n known characters in its word
                more = room[at] >= n
                at, key = at[more], key[more]
                next_code = codes[at + n - 1]
                at, key, next_code = at[next_code > 0], key[next_code > 0], next_code[next_code > 0]
                key = key * np.uint64(_FACTOR) + next_code.astype(np.uint64)
                key ^= key >> np.uint64(29)
            got = np.zeros(len(codes), np.int64)
            if len(vocab.keys[n]) and len(at):
                signed = key.view(np.int64)
                place = np.minimum(np.searchsorted(vocab.keys[n], signed), len(vocab.keys[n]) - 1)
                got[at] = np.where(vocab.keys[n][place] == signed, vocab.ids[n][place], 0)
            if n == 1:
                got[got == 0] = 1
            self.piece.append(got)

    def forward(self, prob: np.ndarray, column: np.ndarray | None = None, keep: bool = False, boost: np.ndarray | None = None):
        """log probabilities (words, languages) in the words' order of entry.
        column: one language per word instead of all. keep: also all steps.
        boost: a factor per character of each word (see ``expected``)."""
        width = 1 if column is not None else prob.shape[1]
        n = len(self.length)
        column = None if column is None else column[self.order]
        boost = None if boost is None else boost[self.order]
        steps = [np.ones((n, width))]
        scale = np.zeros((n, width))
        scales = [scale]
        out = np.zeros((n, width))
        for j in range(1, self.longest + 1):
            m = self.active[j]
            total = np.zeros((m, width))
            for size in range(1, min(MAX_PIECE, j) + 1):
                pieces = self.piece[size - 1][self.start[:m] + j - size]
                hit = np.flatnonzero(pieces)  # long pieces are few
                if not len(hit):
                    continue
                pieces = pieces[hit]
                p = prob[pieces] if column is None else prob[pieces, column[hit]][:, None]
                if boost is not None:
                    p = p * (boost[hit] ** size)[:, None]
                total[hit] += steps[j - size][hit] * p
            if not keep and j % 8 == 0:  # keep the numbers away from zero
                top = np.max([s[:m] for s in steps[-MAX_PIECE:]] + [total], axis=0)
                total /= top
                for i in range(max(0, j - MAX_PIECE), j):
                    steps[i] = steps[i][:m] / top
                scale = scale[:m] + np.log(top)
            steps.append(total)
            if not keep and j >= MAX_PIECE:
                steps[j - MAX_PIECE] = steps[j - MAX_PIECE][:0]
            done = self.active[j + 1] if j < self.longest else 0
            with np.errstate(divide="ignore"):
                out[done:m] = np.log(total[done:]) + scale[done:m]
        back = np.empty_like(out)
        back[self.order] = out
        return (back, steps) if keep else back


def expected(words: list[str], lang: np.ndarray, n: np.ndarray, prob: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Expected piece counts (pieces, languages) of words with counts, each under its own language.

    The steps of a long word would fall below the smallest number. A factor per
    character is the same for all segmentations of a word, so it leaves their
    shares as they are: long words get the one that brings their sum to 1."""
    boost = np.ones(len(words))
    long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
    if long:
        logs = Lattice([words[i] for i in long], vocab).forward(prob, lang[long])[:, 0]
        boost[long] = np.exp(-logs / [len(words[i]) + 1 for i in long])
    lattice = Lattice(words, vocab)
    _, alpha = lattice.forward(prob, lang, keep=True, boost=boost if long else None)
    lang, n, boost = lang[lattice.order], n[lattice.order], boost[lattice.order]
    size = len(words)
    whole = np.empty(size)
    for j in range(1, lattice.longest + 1):
        done = lattice.active[j + 1] if j < lattice.longest else 0
        whole[done : lattice.active[j]] = alpha[j][done:, 0]
    beta = [np.zeros(lattice.active[j]) for j in range(lattice.longest + 1)]
    out = np.zeros(prob.shape)
    for j in range(lattice.longest, 0, -1):
        m = lattice.active[j]
        done = lattice.active[j + 1] if j < lattice.longest else 0
        beta[j][done:m] = 1.0
        for k in range(1, min(MAX_PIECE, j) + 1):
            pieces = lattice.piece[k - 1][lattice.start[:m] + j - k]
            hit = np.flatnonzero(pieces)
            if not len(hit):
                continue
            pieces, own = pieces[hit], lang[hit]
            p = prob[pieces, own] * beta[j][hit]
            if long:
                p = p * boost[hit] ** k
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                share = np.where(whole[hit] > 0, alpha[j - k][hit, 0] * p / whole[hit], 0.0)
            np.add.at(out, (pieces, own), share * n[hit])
            beta[j - k][hit] += p
    out[0] = 0
    return out


@dataclass(frozen=True)
class Model:
    langs: list[str]
    prob: np.ndarray
    path: str


def learn(docs: DataFrame, training: Column, fit_rows: int = 40_000, rounds: int = 3, path: str | None = None) -> Model:
    """Fit on (doc_id, text, lang) where ``training`` is true. Beyond
    ``fit_rows`` rows a sample is fitted on: an equal share of them for each
    language, but no fewer than ``MIN_ROWS``, drawn by a hash of doc_id."""
    path = path or public_tokenizers.path(PIECES)
    rows = docs.where(training & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    langs_n = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    langs, total = sorted(r["lang"] for r in langs_n), sum(r["n"] for r in langs_n)
    if not langs:
        return Model([], np.zeros((0, 0)), path)
    if total > fit_rows:
        # One rate a language, so that a small one is there whole beside a large one.
        share = max(fit_rows // len(langs), MIN_ROWS)
        rate = F.lit(1.0)
        for r in langs_n:
            rate = F.when(F.col("lang") == r["lang"], min(1.0, share / r["n"])).otherwise(rate)
        drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) / float(1 << 53)
        rows = rows.where(drawn < rate)
    words = saved(_lang_words(rows, langs), "lang-words")
    vocab = vocabulary(path)
    prob = np.full((vocab.size, len(langs)), 1.0 / vocab.size)
    for _ in range(rounds):
        prob[0] = 0
        counts = np.zeros_like(prob)
        for r in _expected(words, prob, path).collect():
            counts[r["piece"], r["lang"]] = r["n"]
        prob = (counts + 0.01) / (counts + 0.01).sum(0)
    prob[0] = 0
    return Model(langs, prob, path)


def _lang_words(rows: DataFrame, langs: list[str]) -> DataFrame:
    number = {x: i for i, x in enumerate(langs)}

    def run(batches):
        count: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    i = number[lang]
                    count.update((i, w) for w in _WORD.findall(text.lower()))
                if len(count) > 300_000:
                    yield from _count_rows(count)
                    count = Counter()
        yield from _count_rows(count)

    return rows.select("text", "lang").mapInArrow(run, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _count_rows(count: Counter, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    items = list(count.items())
    for at in range(0, len(items), rows):
        part = items[at : at + rows]
        cols = [pa.array([k[0] for k, _ in part], pa.int32()), pa.array([k[1] for k, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["lang", "word", "n"])


def _expected(words: DataFrame, prob: np.ndarray, path: str) -> DataFrame:
    """(lang, piece, n): every task sums its expected counts, Spark sums the tasks'."""
    shared = words.sparkSession.sparkContext.broadcast(prob)

    def run(batches):
        total = np.zeros(shared.value.shape)
        vocab = vocabulary(path)
        for batch in batches:
            for part in slices(batch, 8192):
                lang = part.column("lang").to_numpy().astype(np.int64)
                n = part.column("n").to_numpy().astype(float)
                total += expected(part.column("word").to_pylist(), lang, n, shared.value, vocab)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, lang])], ["lang", "piece", "n"])

    return words.mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Scorer:
    """log probabilities of words under all languages, each distinct word once
    until ``most`` words are held."""

    def __init__(self, model: Model, most: int = 250_000):
        self.model, self.most, self.vocab = model, most, vocabulary(model.path)
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.langs)))

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages) log probabilities; texts without a letter are nan."""
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(w for own in words for w in own) if w not in self.at]
        if len(self.at) + len(new) > self.most:
            self.at, new = {}, list(dict.fromkeys(w for own in words for w in own))
        held, want = len(self.at), len(self.at) + len(new)
        if want > len(self.rows):
            self.rows = np.concatenate([self.rows[:held], np.zeros((want - held + held // 2, self.rows.shape[1]))])
        for i in range(0, len(new), 16384):
            part = new[i : i + 16384]
            self.rows[held + i : held + i + len(part)] = Lattice(part, self.vocab).forward(self.model.prob)
        self.at.update(zip(new, range(held, want)))
        out = np.full((len(texts), len(self.model.langs)), np.nan)
        for i, own in enumerate(words):
            if own:
                out[i] = self.rows[list(map(self.at.__getitem__, own))].sum(0)
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text); the
    score is the language's share among all, each as likely beforehand."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value.langs else None
        for batch in batches:
            for part in slices(batch, 256):
                texts = part.column("text").to_pylist()
                logs = scorer.texts(texts) if scorer else np.full((len(texts), 1), np.nan)
                none = np.isnan(logs[:, 0])
                logs = np.where(none[:, None], 0.0, logs)
                best = logs.argmax(1)
                share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                lang = [UNDETERMINED if no else shared.value.langs[i] for no, i in zip(none, best)]
                cols = [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(none, 0.0, share))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
