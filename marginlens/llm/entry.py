"""The registered queries of this subpackage: each applies its operator, with
production parameters, to its whole table and derives the contract's columns.

For all of them: an empty table gives no rows; columns other than those the
contract names are not read, so extra ones may have any name; texts are taken
whole, however long; repeated rows are answered one by one unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginlens.llm import bbit_minhash, bpe_codec, decontaminate, lang_id, license_scan, merkle_manifest, oracle_sql, prefix_trie, projected_ann, quality, secret_scan, simhash_cover, suffix_tree_lm, url_cascade
from marginlens.llm.common import held_out, learned, table

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
KEEP_FROM = 0.3
SHINGLE, RADIUS = 4, 4


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every row of ``documents``. Null text or text
    without a letter: ``und``, score 0. A null id is not held out and not learned
    from. Languages that score alike: the first in alphabetical order. Without
    training rows all are ``und``."""
    docs = table(spark, sf_dir, "documents")
    found = lang_id.predict(docs, lang_id.learn(docs, learned(F.col("doc_id"), 5, 0)))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded bytes of every row of
    ``documents``. Null and empty text: no tokens, digests of nothing. Null ids
    are rows like others."""
    return bpe_codec.digests(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ``documents`` and ``benchmark`` rows where the item's template
    stands in the document: a row per pair of ids, whatever repeats. Null ids,
    null and empty texts on either side are in no pair; of alignments with equally
    many windows the first counts; an empty ``benchmark`` gives no rows."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and scores of every row of ``documents``. Null and empty text:
    the end alone. A null id is not held out and not learned from. Without
    training rows no token is known and every byte has probability 1/256."""
    found = suffix_tree_lm.scores(table(spark, sf_dir, "documents"), learned(F.col("doc_id"), 7, 2))
    return found.withColumn("held_out", held_out(F.col("doc_id"), 7, 2))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``. Null, empty
    and wordless texts have fingerprint zero and are linked like others. A
    component of null ids only has a null component_id."""
    found = simhash_cover.near_duplicates(table(spark, sf_dir, "documents"), SHINGLE, RADIUS)
    return found.select("doc_id", "fingerprint", "component_id")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every query row of ``embeddings``. Vectors that are
    null, zero, hold null or non-finite components or differ in length from most
    take no part, nor do null ids. Ties go to the smaller vec_id; an id repeated
    on several rows is never its own neighbour."""
    return projected_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per license notice of ``documents``, with its span. Null and empty
    texts give none; a null id is returned as it is; templates that save equally
    many bytes are tried in their listed order."""
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages``. A null url or one
    without ``://`` has an empty host and path, no rule, and is allowed. The
    longest host, then the longest path, wins."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_cascade.judge(table(spark, sf_dir, "pages"), rules)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets of every row of ``documents``. Null and empty
    texts have none and the digest of the empty string. Null ids are rows like
    others. Spans that start together stand in the order of the kinds."""
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every row of ``documents``. Null text counts as
    empty, and empty texts are scored. A null id is not held out and not learned
    from. Without labelled rows the score is 0.5."""
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= KEEP_FROM).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", predicted.alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of the rebuilt ``conversations`` (see
    ``prefix_trie`` for nulls, ties, repeats and empty tables)."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def merkle_rows(docs: DataFrame, bits: int = merkle_manifest.BLOCK_BITS) -> DataFrame:
    """The manifest of ``docs``, verified against a tampered table: n_chars of
    the rows whose id's crc32 7 divides is one more there (a null stays)."""
    changed = {"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1)}
    fields = [changed.get(c, F.col(c)) for c in merkle_manifest.FIELDS]
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle_manifest.leaf(fields))
    return merkle_manifest.verified(merkle_manifest.manifest(docs, carry={"claim": claim}, bits=bits), "claim")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every row of ``documents``
    (see ``merkle_manifest`` for nulls, repeats and empty tables)."""
    return merkle_rows(table(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and kept of every row of ``documents`` (see
    ``bbit_minhash`` for nulls, short and empty texts, repeats and empty tables)."""
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents"))


# DuckDB's expressions have no look-behind: a pattern with the place before it
# as a group is applied twice, as a match takes the place of the next one.
_TWICE = "regexp_replace(regexp_replace({0}, '{1}', '{2}', 'g'), '{1}', '{2}', 'g')"
_TYPED = _TWICE.format(
    _TWICE.format("text", r"([\p{Ll},;] )\p{Lu}\p{Ll}+", r"\1xnamex"),
    r"(^|[^\p{L}\p{N}])\d[\d.,:/]*([^\p{L}\p{N}]|$)",
    r"\1xnumx\2",
)
_UNITS = _TWICE.format("plain", rf"(xnumx )(?:{'|'.join(decontaminate.UNITS)})([^\p{{L}}\p{{N}}]|$)", r"\1xunitx\2")
OP3_SQL = rf"""
WITH texts AS (
  SELECT 'doc' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL
  SELECT 'item', item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), plains AS (
  SELECT side, id, lower(regexp_replace({_TYPED}, '[^\p{{L}}\p{{N}}\p{{M}}\s]+', '', 'g')) AS plain,
         lower(regexp_replace(text, '[^\p{{L}}\p{{N}}\p{{M}}\s]+', '', 'g')) AS raw FROM texts
), words AS (
  SELECT side, id, [x FOR x IN string_split_regex({_UNITS}, '\s+') IF x <> ''] AS w,
         [x FOR x IN string_split_regex(raw, '\s+') IF x <> ''] AS r FROM plains
), windows AS (
  SELECT side, id, greatest(len(w) - 4, 1) AS n, i AS pos, w[i + 1:i + 5] || CASE WHEN len(w) < 5 THEN ['whole'] ELSE [] END AS key,
         CASE WHEN len(list_intersect(w[i + 1:i + 5], ['xnamex', 'xnumx', 'xunitx'])) > 0 THEN r[i + 1:i + 5] END AS slots
  FROM (SELECT *, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)
), pairs AS (
  SELECT d.id AS doc_id, b.id AS item_id, b.n AS windows, d.pos - b.pos AS shift, b.pos AS item_pos, b.slots AS a, d.slots AS b
  FROM windows d JOIN windows b ON d.key = b.key AND d.side = 'doc' AND b.side = 'item'
), slots AS (
  SELECT doc_id, item_id, shift, count(DISTINCT {{'a': x, 'b': y}}) AS ab, count(DISTINCT x) AS a, count(DISTINCT y) AS b
  FROM (SELECT doc_id, item_id, shift, unnest(a) AS x, unnest(b) AS y FROM pairs WHERE a IS NOT NULL) GROUP BY ALL
), hits AS (
  SELECT doc_id, item_id, windows, shift, count(DISTINCT item_pos) AS matched FROM pairs GROUP BY ALL
  HAVING count(DISTINCT item_pos) >= windows * 0.8
)
SELECT h.doc_id, h.item_id, max(matched) AS matched, CAST(windows AS INTEGER) AS windows,
       CAST(arg_min(h.shift, {{'m': -matched, 's': h.shift}}) AS INTEGER) AS pos
FROM hits h LEFT JOIN slots s ON s.doc_id = h.doc_id AND s.item_id = h.item_id AND s.shift = h.shift
WHERE s.ab IS NULL OR (s.ab = s.a AND s.ab = s.b)
GROUP BY h.doc_id, h.item_id, windows
"""

OP8_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), c AS (
  SELECT page_id, regexp_extract(rest, '^[^?#]*') AS hp FROM u
), p AS (
  SELECT page_id, translate(regexp_extract(hp, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(hp, length(regexp_extract(hp, '^[^/]*')) + 1) AS path FROM c
), r AS (
  SELECT *, host = 'com' OR ends_with(host, '.com') AS is_com, host = 'net' OR ends_with(host, '.net') AS is_net,
         host = 'example.com' OR ends_with(host, '.example.com') AS is_example,
         host = 'www.example.com' OR ends_with(host, '.www.example.com') AS is_www FROM p
), m AS (
  SELECT page_id, host, path, CASE
    WHEN is_www AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN is_example AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN is_com AND starts_with(path, '/') THEN 'com/'
    WHEN is_net AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN is_net AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule FROM r
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_byte_bpe,
        op3_decontamination,
        op4_lm_score,
        op5_simhash,
        op6_nearest,
        op7_license_scan,
        op8_url_filter,
        op9_secret_scan,
        op10_quality,
        op11_prefix_trie,
        op12_merkle,
        op13_minhash,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op8_url_filter": OP8_SQL,
    "op11_prefix_trie": oracle_sql.OP11_SQL,
    "op12_merkle": oracle_sql.OP12_SQL,
    "op13_minhash": oracle_sql.OP13_SQL,
}
