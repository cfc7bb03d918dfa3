"""Benchmark decontamination by template windows, with built-in functions only.

Documents and benchmark items are canonicalised alike: numbers, units behind
numbers and names (capitalised words inside a sentence) become typed
placeholders, case and punctuation go. Windows of ``window`` template words
are hashed and joined; matches are grouped by document, item and alignment
(document position minus item position). A document contains an item when,
at one alignment, at least ``share`` of the item's windows match and the
slots agree: each value the item has in a placeholder stands for one value in
the document and the reverse, so a re-parameterised copy counts and a mere
likeness of form doesn't.

That is the rule of ``contaminated``, which SQL restates. ``drop_contaminated``
also drops near copies (``near_copies``), and there windows and hits need
literal evidence beside their form.

An item with fewer words than a window matches documents whose whole template
is the same. Null and empty texts have no template and match nothing; null
ids take no part. Repeated documents or items are judged one by one and give
one row per pair of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Units that may follow a number (fixed values).
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour "
    "hours day days week weeks month months year years percent usd eur gbp dollar dollars euro euros cent cents meter "
    "meters metre metres mile miles kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter "
    "liters litre litres pound pounds inch inches foot feet degree degrees"
).split()

_ANY_NAME = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}[\p{L}\p{M}]*"
_NAME = r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+"
_NUMBER = r"(?<![\p{L}\p{N}])\d[\d.,:/]*(?![\p{L}\p{N}])"
_UNIT = rf"(?<=xnumx )(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
_DROPPED = r"[^\p{L}\p{N}\p{M}\s]+"
BROADCAST_ROWS = 1_000_000


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, _DROPPED, ""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def template(text: Column, name: str = _NAME) -> Column:
    """The canonical words of a text, in order, as one string."""
    typed = F.regexp_replace(F.regexp_replace(text, name, "xnamex"), _NUMBER, "xnumx")
    plain = _plain(typed)
    return F.when(F.contains(plain, F.lit("xnumx ")), F.regexp_replace(plain, _UNIT, "xunitx")).otherwise(plain)


def _is_slot(word: Column) -> Column:
    return word.isin("xnamex", "xnumx", "xunitx")


def windows(texts: DataFrame, id_name: str, window: int, name: str = _NAME, literal: int = 0) -> DataFrame:
    """(id, n, pos, hash, slots): the windows of each template. ``slots`` holds
    the words as written, where the window has a placeholder, else null. A
    window with fewer than ``literal`` words that are no placeholders is hashed
    as it is written."""
    has_slot = F.col("plain").rlike("xnamex|xnumx|xunitx")
    parts = (
        texts.where(F.col(id_name).isNotNull() & F.col("text").isNotNull())
        .select(id_name, F.col("text").alias("raw"), template(F.col("text"), name).alias("plain"))
        .select(id_name, _words(F.col("plain")).alias("w"), F.when(has_slot, _words(_plain(F.col("raw")))).alias("as_written"))
    )
    last = F.size("w") - window

    def one(i: Column) -> Column:
        w = F.slice("w", i + 1, window)
        slots = F.when(F.col("as_written").isNotNull(), F.when(F.exists(w, _is_slot), F.slice("as_written", i + 1, window)))
        digest = F.xxhash64(w)
        if literal:
            bare = F.size(F.filter(w, lambda x: ~_is_slot(x))) < literal
            digest = F.when(bare & slots.isNotNull(), F.xxhash64(slots, F.lit("as written"))).otherwise(digest)
        return F.struct(i.alias("pos"), digest.alias("hash"), slots.alias("slots"))

    many = F.transform(F.sequence(F.lit(0), last), one)
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64("w", F.lit("whole")).alias("hash"), F.col("as_written").alias("slots")))
    # The outer form: for the plain one Spark infers a filter on the array's
    # size, and computes every window twice.
    at = F.explode_outer(F.when(last >= 0, many).when(F.size("w") > 0, whole))
    # The count is a column beforehand, or every row would carry the words along.
    parts = parts.withColumn("n", F.greatest(last + 1, F.lit(1))).select(id_name, "n", at.alias("at"))
    return parts.where(F.col("at").isNotNull()).select(id_name, "n", "at.pos", "at.hash", "at.slots")


def _matches(docs: DataFrame, items: DataFrame, window: int, name: str = _NAME, literal: int = 0) -> DataFrame:
    """(doc_id, item_id, windows, item_pos, shift, slots): every window the two have in common."""
    own = windows(items.select("item_id", "text"), "item_id", window, name, literal)
    own = own.select("item_id", F.col("n").alias("windows"), F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots"))
    # The windows of the benchmark go to every executor while they are few;
    # beyond that both sides are shuffled on the hash.
    if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    # Only the slots' own values are carried on: (place in item, item's word, document's word).
    pair = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    place = F.transform(pair, lambda p, i: F.struct((i + F.col("item_pos")).alias("at"), p["a"].alias("a"), p["b"].alias("b")))
    return (
        windows(docs.select("doc_id", "text"), "doc_id", window, name, literal)
        .join(own, "hash")
        .select("doc_id", "item_id", "windows", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), place.alias("slots"))
    )


def _consistent() -> Column:
    """Each value of the item stands for one value of the document and the reverse."""
    values = F.transform("slots", lambda s: F.struct(s["a"], s["b"]))
    return (F.size(F.array_distinct(values)) == F.size(F.array_distinct(F.transform("slots", lambda s: s["a"])))) & (
        F.size(F.array_distinct(values)) == F.size(F.array_distinct(F.transform("slots", lambda s: s["b"])))
    )


def _changed() -> Column:
    """Places of the item whose words in the document are others."""
    return F.array_distinct(F.transform(F.filter("slots", lambda s: s["a"] != s["b"]), lambda s: s["at"]))


def contaminated(docs: DataFrame, items: DataFrame, window: int = 5, share: float = 0.8, literal: int = 0, alike: float = 0.0) -> DataFrame:
    """(doc_id, item_id, matched, windows, pos): one row per document and item
    it contains; the alignment with the most matched windows, then the first.
    With ``literal`` and ``alike``, as in ``near_copies``, form alone is no evidence."""
    found = _matches(docs, items, window, literal=literal)
    grouped = found.groupBy("doc_id", "item_id", "windows", "shift").agg(
        F.count_distinct("item_pos").alias("matched"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    words = F.col("windows") + window - 1
    same = words - F.size(_changed()) >= words * alike
    hits = grouped.where((F.col("matched") >= F.col("windows") * share) & _consistent() & same)
    best = F.max(F.struct(F.col("matched"), (-F.col("shift")).alias("back")))
    return hits.groupBy("doc_id", "item_id", "windows").agg(best.alias("best")).select(
        "doc_id", "item_id", F.col("best.matched").alias("matched"), "windows", (-F.col("best.back")).alias("pos")
    )


#: What counts as evidence that a text is a copy, not one of a like form: windows
#: with fewer words than LITERAL that are no placeholders match as written only,
#: and ALIKE of an item's words must be the document's own words too.
LITERAL, ALIKE = 2, 0.4


def near_copies(docs: DataFrame, items: DataFrame, window: int = 5, share: float = 0.8, band: int = 8, least: int = 8, run: int = 13) -> DataFrame:
    """(doc_id, item_id), distinct: documents that hold an item with words put
    in, left out or replaced, or a long passage of it. Capitalised words are
    names wherever they stand. At alignments whose slots agree, a hit has

    * ``share`` of the item's windows at one alignment, or
    * ``share`` of the item's words, and at least ``least``, covered by windows
      at alignments up to ``band`` words apart from one in their middle, or
    * ``run`` words of the item in a row at one alignment.

    Words in which item and document agree as written are literal. The first
    two need ``ALIKE`` of the item's words to be literal, the second at least
    ``least`` as well, and a run ``least`` literal words: rows of numbers and
    texts in title case are alike in form only."""
    place = lambda p: F.sequence(p, p + window - 1)
    runs = (
        _matches(docs, items, window, _ANY_NAME, LITERAL)
        .groupBy("doc_id", "item_id", "windows", "shift")
        .agg(F.array_sort(F.collect_set("item_pos")).alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
        .where(_consistent())
        .withColumn("changed", _changed())
        .withColumn("words", F.array_distinct(F.flatten(F.transform("at", place))))
        .withColumn("literal", F.array_except("words", "changed"))
        .drop("slots")
    )
    near = Window.partitionBy("doc_id", "item_id").orderBy("shift").rangeBetween(-band, band)

    def around(column: str) -> Column:
        return F.size(F.array_distinct(F.flatten(F.collect_list(column).over(near))))

    long = run - window  # from the first to the last window of a run
    unlike = lambda p: F.size(F.filter("changed", lambda c: (c >= p) & (c < p + run)))
    row = F.exists(
        "at",
        lambda p: F.array_contains("at", p + long) & (F.size(F.filter("at", lambda q: (q >= p) & (q <= p + long))) == long + 1) & (unlike(p) <= run - least),
    )
    words = F.col("windows") + window - 1
    whole = (F.size("at") >= F.col("windows") * share) & (F.size("literal") >= words * ALIKE)
    covered = (F.col("covered") >= words * share) & (F.col("covered") >= least) & (F.col("same") >= words * ALIKE) & (F.col("same") >= least)
    return runs.withColumn("covered", around("words")).withColumn("same", around("literal")).where(whole | row | covered).select("doc_id", "item_id").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of ``docs``, columns as they are, that contain no item and no
    near copy of one. Rows with a null id can't be named by the search and are kept."""
    bad = contaminated(docs, items, window, share, LITERAL, ALIKE).select("doc_id").unionByName(near_copies(docs, items, window, share).select("doc_id")).distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
