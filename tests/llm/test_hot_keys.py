"""Joins with hot keys against plain joins."""

from pyspark.sql import functions as F

from cutweave.llm import common


def test_hot_keys_lose_and_repeat_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 8)
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id % 400 END AS k", "id AS x", "id AS __salt").unionByName(
        spark.createDataFrame([(7, None, None), (7, None, None)], "k bigint, x bigint, __salt bigint")
    )
    lookup = common.materialize(rows.filter("k IS NULL OR k % 5 <> 1").groupBy("k").agg(F.max("x").alias("top"), F.count(F.lit(1)).alias("n")), "test")
    got = common.join_hot(rows, lookup, "k", "n", ["x"])
    want = rows.join(lookup.drop("n"), "k")
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.collect()))
    assert common.join_hot(rows.limit(0), common.materialize(lookup.limit(0), "test"), "k", "n", ["x"]).count() == 0
