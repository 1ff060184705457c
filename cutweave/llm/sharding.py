"""Sharding by longest-processing-time scheduling.

Groups of documents that must stay together are put, largest first, into the
shard that is least loaded at that time. The schedule itself runs on the
driver through a heap, but not over the groups, whose number grows with the
corpus: groups are classed by size to 1 part in 1024, and the schedule deals
out whole classes, of which there are under 60 thousand at any corpus size.
A run of equal sizes goes to the n smallest slots among ``load + j * size``,
which is what the heap would do one by one.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutweave.llm.common import join_hot, materialize

#: Leading bits of a group's size that tell its class.
SIZE_BITS = 11
#: Rows that one task numbers at most, on average.
RANK_ROWS = 100_000


def place_equal(loads: list[float], n: int, size: float) -> list[int]:
    """How many of ``n`` equal groups each shard gets, by the greedy rule."""
    counts = [0] * len(loads)
    if n > 4 * len(loads):
        lo, hi = min(loads), max(loads) + size * (n / len(loads) + 2)
        slots = lambda level: [max(0, math.ceil((level - x) / size)) for x in loads]
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(slots(mid)) <= n else (lo, mid)
        counts = slots(lo)
        if sum(counts) > n:
            counts = [0] * len(loads)
    heap = [(x + c * size, i) for i, (x, c) in enumerate(zip(loads, counts, strict=True))]
    heapq.heapify(heap)
    for _ in range(n - sum(counts)):
        load, i = heapq.heappop(heap)
        counts[i] += 1
        heapq.heappush(heap, (load + size, i))
    return counts


def schedule(classes: list[tuple[int, int, int]], n_shards: int) -> tuple[list[tuple[int, list[int]]], list[float]]:
    """``classes``: (class, number of groups, bytes). Returns for each class
    the running numbers of groups by shard, and the shards' loads."""
    loads, out = [0.0] * n_shards, []
    for cls, n, total in sorted(classes, reverse=True):
        counts = place_equal(loads, n, total / n)
        loads = [x + c * total / n for x, c in zip(loads, counts, strict=True)]
        ends, run = [], 0
        for c in counts:
            run += c
            ends.append(run)
        out.append((cls, ends))
    return out, loads


def _numbered(df: DataFrame, by: list[str], salt: F.Column, order: list, name: str, n_parts: int) -> DataFrame:
    """Gapless numbers from 0 within each value of ``by``, in two levels, so
    that no task has to hold all rows of a value."""
    df = df.withColumn("__part", F.pmod(salt, F.lit(n_parts)))
    counts = df.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    numbered = df.withColumn("__rank", rank.cast("bigint") - 1).join(counts, [*by, "__part"])
    return numbered.withColumn(name, F.col("__base") + F.col("__rank")).drop("__part", "__rank", "__base")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Shard of every document: doc_id, size, text_crc32, law, shard, slot,
    grown_shard.

    size: UTF-8 bytes of the text plus 1. Documents with equal texts form a
    group and share a shard; null texts form one group too (crc32 0). Slots
    number each shard's rows from 0 without gaps. Repeated rows each get a
    slot. The law is ``bytes``: loads are as near equal as the largest group
    lets them be. Groups of equal size are told apart by their hashes, which
    decides ties; a text of any length is one group. An empty table gives no
    rows. Only doc_id and text are read, so other columns cannot clash.
    """
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0).cast("bigint")).alias("text_crc32"),
        F.xxhash64(text.isNull(), text).alias("g1"),
        F.xxhash64(F.lit("second"), text.isNull(), text).alias("g2"),
    )
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    shift = F.greatest(F.lit(0), F.length(F.bin("bytes")) - F.lit(SIZE_BITS))
    groups = groups.withColumn("cls", F.call_function("shiftleft", F.call_function("shiftright", F.col("bytes"), shift), shift))
    groups = materialize(groups, "shard-groups")
    hist = groups.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"), F.sum("n_rows").alias("n_rows")).collect()
    quotas, _ = schedule([(r["cls"], r["n"], r["total"]) for r in hist], n_shards)
    n_groups, n_rows = sum(r["n"] for r in hist), sum(r["n_rows"] for r in hist)
    spark = docs.sparkSession
    quota = spark.createDataFrame(quotas, "cls bigint, ends array<bigint>")
    ranked = _numbered(groups, ["cls"], F.col("g1"), [F.desc("bytes"), "g1", "g2"], "rank", max(1, n_groups // RANK_ROWS))
    placed = ranked.join(F.broadcast(quota), "cls")  # under 60,000 rows by SIZE_BITS
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    placed = materialize(placed.select("g1", "g2", shard.cast("int").alias("shard"), "n_rows"), "shard-groups-put")
    put = materialize(join_hot(rows, placed, ["g1", "g2"], "n_rows", ["doc_id"]), "shard-put")
    order = ["doc_id", "text_crc32", "size", "g1", "g2"]
    out = _numbered(put, ["shard"], F.xxhash64("doc_id", "g1"), order, "slot", max(1, n_rows // RANK_ROWS))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
