"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutweave.llm.common import join_hot, materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the
    smallest node of its component.

    Alternates the large-star and small-star steps: each node hangs its
    neighbours on the smallest one it knows, so paths shrink by half or more
    a round. A round is two aggregations and two joins of rows no more than
    the edges; a hub's edges are salted over tasks, and nothing reaches the
    driver but counts and a checksum. Repeated edges and loops add nothing;
    without edges there are no rows.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first())

    now = materialize(tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "cc")
    seen = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        count = F.count(F.lit(1)).alias("n")
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m"), count).select("a", F.least("a", "m").alias("m"), "n"), "cc")
        large = join_hot(both.filter("b > a"), least, "a", "n", ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(tidy(large), "cc")
        own = materialize(large.groupBy("a").agg(F.min("b").alias("m"), count), "cc")
        hung = join_hot(large, own, "a", "n", ["b"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialize(tidy(hung.unionByName(own.select("a", F.col("m").alias("b")))), "cc")
        for old in (now, least, large, own):
            release(old)
        now, before = small, seen
        seen = mark(now)
        if seen == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
