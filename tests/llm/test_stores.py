"""Operators 2, 7 and 9 on odd rows; their SQL is run by the driver."""

import math
from collections import Counter

import pytest

from cutweave.llm import merkle, mixing, queries, url_filter
from cutweave.llm.url_filter import Rule

ROT = ["page_id", "file_no", "rec_offset", "rec_length"]


def pages(spark, n=2500):
    rows = [(i, f"http://h{i % 7}.example.com/en/{i}", "x" * (i % 90)) for i in range(n)]
    rows += [(None, None, None), (None, "u", "h"), (5, "http://h5.example.com/en/5", "xxxxx"), (-3, "", "")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_audit_finds_just_what_was_changed(spark):
    records = merkle.pack(pages(spark)).cache()
    assert merkle.audit(records, records).count() == 0
    bad = merkle.audit(records, queries.bit_rot(records)).collect()
    got = Counter(r["status"] for r in bad)
    ids = [i for i in range(2500)] + [-3]
    assert got["missing"] == sum(i % 193 == 7 for i in ids)
    assert got["altered"] == sum(i % 97 == 5 and i % 193 != 7 for i in ids) + 1  # page 5 stands there twice
    assert all((r["digest_b"] is None) == (r["status"] == "missing") for r in bad)
    back = merkle.audit(queries.bit_rot(records), records)
    assert Counter(r["status"] for r in back.collect())["extra"] == got["missing"]
    assert merkle.audit(records.limit(0), records.limit(0)).count() == 0


def test_a_replica_packed_by_itself_shifts_no_record(spark):
    base = pages(spark).filter("page_id is not null")
    records = merkle.pack(base)
    lost = merkle.audit(records, merkle.pack(base.filter("page_id <> 700"))).collect()
    assert [(r["page_id"], r["status"]) for r in lost] == [(700, "missing")]
    longer = base.selectExpr("page_id", "url", "CASE WHEN page_id = 700 THEN repeat('y', 500000) ELSE html END AS html", "1 AS digest")
    got = merkle.audit(records, merkle.pack(longer)).collect()
    assert [(r["page_id"], r["status"]) for r in got] == [(700, "altered")] and got[0]["rec_offset"] == lost[0]["rec_offset"]


def test_audit_of_repeated_and_null_ids(spark):
    rows = [(5, "u", "a"), (5, "u", "a"), (5, "u", "b"), (None, None, "n"), (None, None, "n"), (None, None, "m"), (8, "v", "")]
    schema = "page_id bigint, url string, html string"
    make = lambda x: merkle.pack(spark.createDataFrame(x, schema)).withColumn("status", merkle.F.lit(1))
    audit = lambda x: sorted((str(r["page_id"]), r["status"]) for r in merkle.audit(make(rows), make(x)).collect())
    assert audit(rows[::-1]) == []
    assert audit(rows[1:]) == [("5", "missing")] and audit([*rows, rows[3]]) == [("None", "extra")]
    assert audit([(5, "u", "c"), *rows[1:]]) == [("5", "altered")] and audit([*rows[:3], *rows[4:]]) == [("None", "missing")]


def test_offsets_are_gapless(spark):
    for (_,), own in merkle.pack(pages(spark)).toPandas().groupby(["file_no"]):
        own = own.sort_values("rec_offset")
        ends = (own.rec_offset + own.rec_length).tolist()
        assert own.rec_offset.tolist() == [0, *ends[:-1]]


def test_mixture_hits_its_weights(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('s', id % 5) END AS source", "'t' AS text", "1 AS replica")
    mix = mixing.replicate(docs, {"hot": 1.0, "s1": 3.0})
    got = Counter(r["source"] for r in mix.select("source").collect())
    assert set(got) == {"hot", "s1"}
    assert abs(got["hot"] - 7500) < 5 * math.sqrt(7500) and abs(got["s1"] - 22500) < 5 * 22500 / math.sqrt(2000)
    assert mix.columns == ["doc_id", "source", "text", "replica", "source_rate", "replica_", "mix_key"]
    even = mixing.replicate(docs, epochs=0.5)
    assert abs(even.count() - 15_000) < 1000
    assert None in {r["source"] for r in even.select("source").distinct().collect()}
    assert mixing.replicate(docs.limit(0)).count() == 0


def test_mixture_with_null_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a", None), (1, "a", "x"), (1, "a", "x"), (2, None, "")], "doc_id bigint, source string, text string")
    got = Counter((r["doc_id"], r["source"]) for r in mixing.replicate(docs, epochs=50.0).collect())
    assert got[(1, "a")] % 2 == 0 and got[(2, None)] > 0 and got[(None, "a")] > 0
    own = spark.createDataFrame([(None, "a", "x" * 3_000_000), (1, "a", "")], "doc_id bigint, source string, text string")
    assert all(len(r["mix_key"]) == 32 for r in mixing.replicate(own, epochs=3.0).collect())  # a long text, and no null key
    assert abs(mixing.poisson_table(31_600.0)[31_600] - 0.5) < 0.01 and mixing.poisson_table(0.0).tolist() == [1.0]
    large = mixing.replicate(docs, epochs=2000.0)  # exp(-rate) underflows
    assert abs(large.count() - 8000) < 1500


def test_rules_fit_hosts_and_paths(spark):
    urls = [
        (1, "HTTP://WWW.Example.COM/en/a?x#y"), (2, "http://blog.example.com/en/"), (3, "http://blog.example.com/EN/"), (4, "http://example.com"), (5, None),
        (6, "no scheme/com/"), (7, "x://net/es/1"), (8, "x://a.net/fr/?q"), (9, "x://anet/es/"), (10, "x://com/"), (11, "x://y.com:80/"), (12, ""),
        (13, "http://cheap-pills.org/x"), (14, "http://x.cheap-pills.com/de/"), (15, "x://a/://net/es/"), (15, "x://a/://net/es/"), (None, "x://net/es/"), (16, "x://b.com/" + "a/" * 40_000), (17, "x://h?y://net/es/"),
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, u in urls], "page_id bigint, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, queries.URL_RULES).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("com/", "allow")
    assert got[4] == ("example.com", "", None, "allow") and got[5] == ("", "", None, "allow") == got[6] == got[12]
    assert got[7][2:] == ("net/es/", "block") and got[8][2:] == ("net/fr/", "block") and got[9][2:] == (None, "allow")
    assert got[10][2:] == ("com/", "allow") and got[11] == ("y.com:80", "/", None, "allow")
    assert got[13][2:] == (None, "block") and got[14][2:] == ("com/", "allow") and got[15] == ("a", "/://net/e", None, "allow")
    assert got[None][2:] == ("net/es/", "block") and got[16][2:] == ("com/", "allow") and got[17][0] == "h"
    assert url_filter.filter_urls(df, queries.URL_RULES).count() == len(urls)
    assert url_filter.filter_urls(df.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, [], "block").collect()} == {"block"}


def test_rules_come_from_a_table_of_bounded_size(spark, monkeypatch):
    rows = [("||net/es/", "block", "net/es/"), ("||cheap.", "block", None)]
    table = spark.createDataFrame(rows, "pattern string, verdict string, name string")
    rules = url_filter.rules_from(table)
    assert sorted(rules, key=str) == sorted((Rule(*r) for r in rows), key=str)
    # of fallbacks that fit alike the greater verdict counts
    df = spark.createDataFrame([(1, "x://cheap.org/")], "page_id int, url string")
    both = [*rules, Rule("||cheap.", "allow")]
    assert {r["verdict"] for x in (both, both[::-1]) for r in url_filter.filter_urls(df, x).collect()} == {"block"}
    monkeypatch.setattr(url_filter, "TABLE_BYTES", 10)
    for act in (lambda: url_filter.rules_from(table), lambda: url_filter.filter_urls(df, rules)):
        with pytest.raises(ValueError):
            act()


def test_patterns(spark):
    assert url_filter.literal_tokens("||ads.*.com^") == ["ads", "com"]
    assert url_filter.literal_tokens("banner*") == [] and url_filter.literal_tokens("/ads/*x") == ["ads"]
    rules = [Rule("/ads/*.gif|", "block", "gif"), Rule("*track*", "block", "track"), Rule("||good.com^", "allow", "good.com and all")]
    df = spark.createDataFrame([(1, "x://a/ads/b.gif"), (2, "x://a/ads/b.gifs"), (3, "x://a/xtracky"), (4, "x://w.good.com/track"), (5, "x://good.com")], "page_id int, url string")
    got = {r["page_id"]: r["rule"] for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {1: "gif", 2: None, 3: "track", 4: "good.com and all", 5: "good.com and all"}
