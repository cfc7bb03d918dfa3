"""Windows against a plain reimplementation; planted copies, re-parameterised
copies and look-alikes."""

from __future__ import annotations

import re

import duckdb
import pytest

from marginlens.llm import decontaminate as d
from marginlens.llm import entry

SF = "/root/testdata/sf0.01"
ITEM = "A train leaves the old station with 120 people and travels 45 km to meet Anna near the river before it stops for 30 minutes"


def words(text):
    low = re.sub(r"[^\w\s]|_", "", text).lower()
    return low.split()


def test_whole_items_of_the_table_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    found = {(r["doc_id"], r["item_id"]) for r in entry.op3_decontamination(spark, SF).collect()}
    want = set()
    plain_items = {i["item_id"]: words(i["text"]) for i in items}
    for doc in docs:
        own = words(doc["text"] or "")
        at = {}
        for n in range(len(own) - 4):
            at.setdefault(tuple(own[n : n + 5]), []).append(n)
        for i, item in plain_items.items():
            per = {}
            for n in range(len(item) - 4):
                for p in at.get(tuple(item[n : n + 5]), []):
                    per.setdefault(p - n, set()).add(n)
            if any(len(v) >= 0.8 * (len(item) - 4) for v in per.values()):
                want.add((doc["doc_id"], i))
    assert want and want <= found
    assert len(found - want) <= 0.05 * len(want)  # more only through placeholders


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "two words"), (None, ITEM)], "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as hash", "'x' as slots")


CASES = {
    "exact": (ITEM, True),
    "inside": ("Some words first. " + ITEM + ". And more of it.", True),
    "new numbers and name": (ITEM.replace("120", "77").replace("45", "1,500").replace("Anna", "Boris").replace("30", "9"), True),
    "case and punctuation": (ITEM.upper().replace(" ANNA", " Anna").replace(" KM", " km,"), None),
    "half": (" ".join(ITEM.split()[:12]), False),
    "other": ("Nothing of this text stands in any benchmark item at all, be it 120 km or 30 minutes", False),
    "short item": ("Two words!", True),
    "short item inside": ("these two words are not alone", False),
}


def test_copies(spark, make_docs, items):
    texts = list(CASES.values())
    docs = make_docs([(i, t) for i, (t, _) in enumerate(texts)] + [(100, None), (101, ""), (None, ITEM), (0, ITEM)])
    docs = docs.selectExpr("*", "1 as item_id", "2 as hash", "3 as pos")
    rows = d.contaminated(docs, items).collect()
    got = {r["doc_id"] for r in rows}
    for i, (_, hit) in enumerate(texts):
        if hit is not None:
            assert (i in got) == hit, texts[i]
    assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows}) and None not in got
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert None in left and 100 in left and 101 in left and not (set(left) & got)
    assert d.contaminated(docs.limit(0), items).count() == 0
    assert d.contaminated(docs, items.limit(0)).count() == 0
    assert d.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_slots_must_agree(spark, make_docs):
    item = "the sum of 12 and 12 is twice as much as the half of 12 and 48 taken together now"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make_docs([(1, item.replace("12", "7").replace("48", "5")), (2, item.replace("12", "7", 1)), (3, item.replace("48", "12"))])
    assert {r["doc_id"] for r in d.contaminated(docs, items).collect()} == {1}


def test_long_text_and_many_repeats(spark, make_docs):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = make_docs([(1, "blah " * 100_000 + ITEM), (2, (ITEM + " ") * 500), (3, "1,1," * 100_000), (4, "A" * 300_000)])
    rows = d.contaminated(docs, items).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2]
    assert [r["pos"] for r in rows if r["doc_id"] == 1] == [100_000]


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(entry.ORACLE_SQL["op3_decontamination"]).fetchall()
    got = [tuple(r) for r in entry.op3_decontamination(spark, SF).collect()]
    assert want and sorted(got) == sorted(want)


def test_copies_against_sql(spark, make_docs, items, tmp_path):
    docs = make_docs([(i, t) for i, (t, _) in enumerate(CASES.values())])
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", items.select("item_id", "text"))):
        df.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    want = con.execute(entry.ORACLE_SQL["op3_decontamination"]).fetchall()
    assert sorted(tuple(r) for r in d.contaminated(docs, items).collect()) == sorted(want)


def test_main_path_is_native(spark):
    plan = entry.op3_decontamination(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def _with(text, old, new):
    assert old in text
    return text.replace(old, new, 1)


NEAR = {
    "a word more": (_with(ITEM, "45 km", "about 45 km"), True),
    "a word less": (_with(ITEM, "old ", ""), True),
    "a longer name": (_with(ITEM, "Anna", "Mary Ann"), True),
    "a longer number": (_with(ITEM, "30", "thirty five"), True),
    "a passage": ("He read that " + " ".join(ITEM.split()[3:19]) + " and closed the book", True),
    "too short a passage": ("He read that " + " ".join(ITEM.split()[3:13]) + " and closed the book", False),
    "other": (CASES["other"][0], False),
}


def test_near_copies_go(spark, make_docs):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = make_docs([(i, "Some words first. " + t + ". And more of it.") for i, (t, _) in enumerate(NEAR.values())])
    left = {r["doc_id"] for r in d.drop_contaminated(docs, items).collect()}
    assert left == {i for i, (_, hit) in enumerate(NEAR.values()) if not hit}


def test_names_at_sentence_starts_go(spark, make_docs):
    tom = "Tom has 12 apples. Tom gives 5 apples to a friend. How many are left for Tom now?"
    short = "Which river flows through the town?"
    items = spark.createDataFrame([(1, tom), (2, short)], "item_id long, text string")
    docs = make_docs([(1, tom.replace("Tom", "Sam")), (2, "he asked them Which river flows through the town? and left"), (3, "he asked them which river flows through the town? and left"), (4, "he asked which river it was")])
    assert [r["doc_id"] for r in d.drop_contaminated(docs, items).collect()] == [4]


def test_likeness_of_form_is_no_evidence(spark, make_docs):
    """Number tables, forms with other values and title-case texts stay; the same with equal values goes."""
    numbers = "monthly sales were " + " ".join(str(1000 + 37 * i) for i in range(25))
    title = "The Old Man And His Small Grey Dog Went Down To Their Lake Again"
    form = "from 10 to 20 from 30 to 40 from 50 to 60 from 70 to 80 from 90 to 100"
    items = spark.createDataFrame([(1, numbers), (2, title), (3, form)], "item_id long, text string")
    clean = [
        "monthly sales were " + " ".join(str(7 + 91 * i) for i in range(40)),
        " ".join(str(5 + 13 * i) for i in range(300)),
        "A Title Of Quite Another Kind With Many Words In It And None Of Them The Same As There",
        "Annual Report Of The Council On Roads Rivers Bridges And Other Works In The Northern Counties",
    ]
    copies = [numbers, "x " + numbers + " y", title, "they read: " + title + " and so on", form]
    docs = make_docs(list(enumerate(clean + copies)))
    assert sorted(r["doc_id"] for r in d.drop_contaminated(docs, items).collect()) == list(range(len(clean)))


def test_a_number_table_against_many_items_is_quick(spark, make_docs):
    """20,000 numbers and 40 items of 25 numbers meet in no window."""
    items = spark.createDataFrame([(i, " ".join(str(i * 1000 + 7 * j) for j in range(25))) for i in range(40)], "item_id long, text string")
    docs = make_docs([(1, " ".join(str(10**6 + 3 * i) for i in range(20_000))), (2, " ".join(str(5 * 1000 + 7 * j) for j in range(25)))])
    assert d._matches(docs, items, 5, d._ANY_NAME, d.LITERAL).where("doc_id = 1").count() == 0
    assert [r["doc_id"] for r in d.drop_contaminated(docs, items).collect()] == [1]
