from __future__ import annotations

import os
import random

import duckdb

from marginlens.llm import entry, url_cascade as u

SF = "/root/testdata/sf0.01"


def by_definition(url, rules):
    host, path = u.split_url(url)
    fit = [(len(h), len(p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    if not fit:
        return host, path, None, "allow"
    best = max(fit, key=lambda x: (x[0], x[1], x[2] == "block"))
    return host, path, best[3], best[2]


def test_parts_of_urls():
    assert u.split_url(None) == u.split_url("no scheme/x") == u.split_url("") == ("", "")
    assert u.split_url("HTTP://ExÄmple.COM?x=http://b") == ("exÄmple.com", "")
    assert u.split_url("a://B#f/x?y") == ("b", "")
    assert u.split_url("a://b/c://d/E?f#g") == ("b", "/c://d/E")
    assert u.split_url("://x/y") == ("x", "/y")


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(entry.ORACLE_SQL["op8_url_filter"]).fetchall()
    got = [tuple(r) for r in entry.op8_url_filter(spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert {v for *_, v in got} == {"allow", "block"}


def test_many_rules_several_levels_and_shards(spark, monkeypatch):
    rng = random.Random(4)
    hosts = [".".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4))) for _ in range(500)]
    rules = sorted({(rng.choice(hosts), rng.choice(["/", "/x/", "/x/y", ""]), rng.choice(u.VERDICTS)) for _ in range(300)})
    rules_df = spark.createDataFrame([*rules, (None, "/", "block"), ("a", "/", "maybe")], "host string, path string, verdict string")
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/', '/x/y/z', '/q'])}{rng.choice(['', '?a', '#b'])}" for _ in range(800)]
    urls += [None, "", "nothing", "http://", "http:///x/", "http://A.B/x/y", "http://" + "a." * 2000 + "b/x/"]
    pages = spark.createDataFrame([(i % 700, x) for i, x in enumerate(urls)], "page_id long, url string").selectExpr("*", "1 as rule", "2 as verdict", "3 as found")
    want = sorted(((i % 700, *by_definition(x, rules)) for i, x in enumerate(urls)), key=str)
    monkeypatch.setattr(u, "BITS_PER_KEY", 2)  # many false positives, so many levels
    got = sorted((tuple(r) for r in u.judge(pages, rules_df).collect()), key=str)
    assert got == want
    monkeypatch.setattr(u, "MOST_BYTES", 50)  # several passes
    assert sorted((tuple(r) for r in u.judge(pages, rules_df).collect()), key=str) == want
    assert u.judge(pages.limit(0), rules_df).count() == 0
    assert {r["verdict"] for r in u.judge(pages, rules_df.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark, monkeypatch):
    monkeypatch.setattr(u, "BITS_PER_KEY", 3)
    pages = spark.createDataFrame([(i, f"http://h{i}.com/") for i in range(3000)], "page_id long, url string")
    listed = spark.createDataFrame([("block", f"h{i}.com/") for i in range(0, 3000, 3)], "verdict string, key string")
    cascade = u.cascades(pages, listed, [1])["block"]
    assert len(cascade) > 2
    keys = [f"h{i}.com/".encode() for i in range(3000)]
    assert u.listed_in(cascade, keys).tolist() == [i % 3 == 0 for i in range(3000)]
    assert os.path.isdir(SF)
