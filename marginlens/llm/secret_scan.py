"""Secret scans: fixed patterns, and novelty under a primed compressor.

The fixed patterns find assignments of passwords and tokens, access keys and
long hexadecimal strings. The method adds strings in a sensitive context that
the compressor can't explain: a zstandard compressor, primed with a
dictionary of identifiers and prose, compresses the surroundings with and
without the candidate; the marginal bytes per character tell random strings
from names, paths and words, even long ones. Candidates that lie within a
span of the fixed patterns are not reported again.

Offsets are code points, ends exclusive. Null text counts as empty. Spans of
one text are ordered by start, then kind in the order of ``KINDS``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import pandas_udf

from marginlens.llm.common import map_batches

KINDS = ("assign", "access", "hex", "novel")


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" for c in word)


_NAMES = [_either_case(w) for w in ("password", "passwd", "secret", "token")] + [_either_case("api") + "_?" + _either_case("key")]
_ASSIGN = re.compile(rf"""({'|'.join(_NAMES)})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the runs of 20 and more characters
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Words that make a context sensitive, and what the compressor knows beforehand (fixed values).
CONTEXT = "password passwd passphrase pwd secret token apikey api_key api-key credential credentials private_key access_key auth bearer signature".split() + ["private key", "access key"]
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 true false null none undefined example sample changeme "
    "placeholder your_password_here your-token-here my_secret_key xxxxxxxxxxxxxxxx ---------------- ________________ "
    "import from class return function const static public private protected string integer float boolean config settings "
    "environment variable process.env os.environ getenv database username user_name hostname localhost connection "
    "application/json content-type authorization bearer header request response session cookie access_token refresh_token "
    "client_id client_secret private_key public_key api_key secret_key access_key signature certificate /usr/local/bin "
    "/home/user/project/src/main/java/com/example/ https://www.example.com/path/to/resource index.html .json .yaml .properties "
    "the and for that with this from have not are was which their would there about other into than then them these some"
).encode()

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{16,}={0,2}")  # a name and its value are two
_ASSIGNED = re.compile(r"""["']?\s*[:=]""")
_SENSITIVE = re.compile("(?:" + "|".join(_either_case(w) for w in CONTEXT) + r")[A-Za-z0-9_]*")


SAME_LENGTH = 0.88


class Novelty:
    """Marginal compressed bytes per character of a string in its surroundings."""

    def __init__(self, around: int = 64, level: int = 19):
        self.around = around
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            level, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.packer = zstandard.ZstdCompressor(dict_data=primed, compression_params=params)

    def __call__(self, text: str, start: int, end: int) -> float:
        before = text[max(0, start - self.around) : start].encode("utf-8", "replace")
        after = text[end : end + self.around].encode("utf-8", "replace")
        own = text[start:end]
        # The dictionary is in lower case: so are names in capitals alone.
        own = (own.lower() if own.isupper() else own).encode("utf-8", "replace")
        more = len(self.packer.compress(before + own + after)) - len(self.packer.compress(before + after))
        return more / max(len(own), 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of the fixed patterns, each kind leftmost and not overlapping itself."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return out


#: Between two lines of one secret: a line end, as such or escaped, or quotes, with signs of concatenation.
_BESIDE = re.compile(r"""(?=[^\n\\"']*[\n\\"'])(?:\\[nr]?|["'+,>|#*;\s]){1,16}""")
_LAST_LINE = re.compile(r"(?:\\[nr]|\s)+([A-Za-z0-9+/]{1,15}={0,2})(?:\\[nr]|\s)*-----END")


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, least: float, reach: int) -> list[tuple[int, int, str]]:
    """Candidates that start within ``reach`` behind a sensitive word, or end
    within ``reach`` before one, or hold one; names that hold the word are of
    it. A candidate that is reported is a cue for the one beside it or on the
    next line, so a block is followed in both directions to its ends. A line of
    the same length passes there with ``SAME_LENGTH`` of the novelty (lines of
    random base64 measure 0.59 and more), another one needs all of it and more
    than letters; the short last line of a key block goes with it."""
    cues = [m.span() for m in _SENSITIVE.finditer(text)]
    starts, ends = [s for s, _ in cues], [e for _, e in cues]
    candidates = []  # (start, end, stands near a cue)
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        i = bisect_right(starts, start) - 1  # the last cue that starts before it
        near = (i >= 0 and start <= ends[i] + reach) or (i + 1 < len(starts) and starts[i + 1] - end <= reach)
        if any(s <= start and end <= e for s, e, _ in base):
            continue
        if i >= 0 and starts[i] == start and ends[i] == end and _ASSIGNED.match(text, end):
            continue  # the name of what follows
        candidates.append((start, end, near))
    measured: dict[int, float] = {}

    def novel(i: int) -> float:
        if i not in measured:
            measured[i] = novelty(text, *candidates[i][:2])
        return measured[i]

    found = {i for i, (_, _, near) in enumerate(candidates) if near and novel(i) >= least}
    for step, order in ((1, range(len(candidates))), (-1, range(len(candidates) - 1, -1, -1))):
        for i in order:
            j = i - step
            if i in found or j not in found:
                continue
            left, right = candidates[min(i, j)], candidates[max(i, j)]
            if right[0] - left[1] > 16 or not _BESIDE.fullmatch(text, left[1], right[0]):
                continue
            own = text[slice(*candidates[i][:2])]
            alike = left[1] - left[0] == right[1] - right[0]
            if novel(i) >= (least * SAME_LENGTH if alike else least) and (alike or not own.isalpha()):
                found.add(i)
    out = [(*candidates[i][:2], "novel") for i in sorted(found)]
    for _, end, _ in list(out):
        if m := _LAST_LINE.match(text, end):
            out.append((*m.span(1), "novel"))
    return out


def scan(text: str | None, novelty: Novelty, least: float = 0.65, reach: int = 48) -> list[tuple[int, int, str]]:
    if not text:
        return []
    base = base_spans(text)
    low = text.lower()
    if any(w in low for w in CONTEXT):
        base = base + novel_spans(text, base, novelty, least, reach)
    return sorted(base, key=lambda x: (x[0], KINDS.index(x[2])))


def secrets(docs: DataFrame, least: float = 0.65, reach: int = 48) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base, spans) for every row:
    the two strings list kind:start:end, comma-joined."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        novelty = Novelty()
        counts, base, spans = {k: [] for k in KINDS}, [], []
        for text in batch.column("text").to_pylist():
            found = scan(text, novelty, least, reach)
            n = Counter(k for _, _, k in found)
            for k in KINDS:
                counts[k].append(n[k])
            base.append(",".join(f"{k}:{s}:{e}" for s, e, k in found if k != "novel"))
            spans.append(",".join(f"{k}:{s}:{e}" for s, e, k in found))
        cols = [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(base, pa.string()), pa.array(spans, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    names = ", ".join(f"n_{k} long" for k in KINDS)
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, {names}, base string, spans string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its
    first kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for s, e, k in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"[{k}]"]
        at = e
    return "".join([*out, text[at:]])


def redacted(text: Column, least: float = 0.65, reach: int = 48) -> Column:
    """The text with its secrets replaced; null stays null."""
    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        novelty = Novelty()
        return texts.map(lambda t: t if not t else redact(t, scan(t, novelty, least, reach)))

    return run(text)
