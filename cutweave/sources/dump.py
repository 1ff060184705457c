"""The int32 dump of a hierarchy, as one binary file.

The number of levels; then for each level n, m, n + 1 row offsets, m
neighbours, m edge weights, n vertex weights and, from the second level on,
the map of the level before. Little-endian.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutweave.model import Hierarchy, materialize
from cutweave.operators import prep
from cutweave.sources.files import LIMIT, Sink, put, read_numbers

def _check(h: Hierarchy) -> list[tuple[int, int]]:
    """Vertices and entries of each level; raises what the format can't hold."""
    if not h.graphs or len(h.maps) + 1 != len(h.graphs):
        raise ValueError("an incomplete hierarchy")
    sizes: list[tuple[int, int]] = []
    for level, (edges, vertices) in enumerate(h.graphs):
        m, least, most = edges.agg(F.count(F.lit(1)), F.min("w"), F.max("w")).first()
        n, least_v, most_v = vertices.agg(F.count(F.lit(1)), F.min("vw"), F.max("vw")).first()
        if max(n, m, most or 0, most_v or 0) > LIMIT or min(least or 0, least_v or 0) < 0:
            raise ValueError(f"level {level} is beyond 32 bits")
        if level:
            rows, first, last = h.maps[level - 1].agg(F.count(F.lit(1)), F.min("c"), F.max("c")).first()
            if rows != sizes[-1][0] or rows and not 0 <= first <= last < n:
                raise ValueError(f"the map to level {level} does not fit")
        sizes.append((n, m))
    return sizes


def write_dump(h: Hierarchy, path: str) -> None:
    """One file, streamed a partition at a time; it appears when whole."""
    sizes = _check(h)
    with Sink(h.graphs[0][0].sparkSession, path) as out:
        out.write(struct.pack("<i", len(sizes)))
        for level, ((edges, vertices), (n, m)) in enumerate(zip(h.graphs, sizes, strict=True)):
            out.write(struct.pack("<ii", n, m))
            put(out, prep.row_offsets(edges, vertices), ["v"], "first", "int32")
            out.write(struct.pack("<i", m))
            put(out, edges, ["src", "dst"], "dst", "int32")
            put(out, edges, ["src", "dst"], "w", "int32")
            put(out, vertices, ["v"], "vw", "int32")
            if level:
                put(out, h.maps[level - 1], ["v"], "c", "int32")


def read_dump(spark: SparkSession, path: str) -> Hierarchy:
    """The hierarchy of a dump; only the headers come to the driver."""
    numbers = materialize(read_numbers(spark, path, "int32"))
    length = numbers.count()
    at = 0

    def take(n: int, name: str = "value") -> DataFrame:
        nonlocal at
        if n < 0 or at + n > length:
            raise ValueError(f"{path} ends early")
        here, at = at, at + n
        return numbers.filter(F.col("pos").between(here, here + n - 1)).select((F.col("pos") - here).alias("pos"), F.col("value").alias(name))

    def header(n: int) -> list[int]:
        return [r["value"] for r in take(n).orderBy("pos").collect()]

    out, before = Hierarchy(stop_reason="read"), 0
    for level in range(header(1)[0]):
        n, m = header(2)
        first = take(n + 1, "first")
        after = first.select((F.col("pos") - 1).alias("pos"), F.col("first").alias("next"))
        rows = first.join(after, "pos").select(F.col("pos").alias("v"), "first", (F.col("next") - F.col("first")).alias("deg"))
        ends = rows.agg(F.coalesce(F.min("deg"), F.lit(0)), F.coalesce(F.sum("deg"), F.lit(0))).first()
        if ends[0] < 0 or ends[1] != m:
            raise ValueError(f"the offsets of level {level} do not fit")
        edges = prep.expand_rows(rows, take(m, "dst")).join(take(m, "w").withColumnRenamed("pos", "ord"), "ord")
        vertices = take(n, "vw").withColumnRenamed("pos", "v")
        out.graphs.append((edges.select("src", "dst", "w"), vertices))
        if level:
            out.maps.append(take(before, "c").withColumnRenamed("pos", "v"))
        before = n
    if at != length:
        raise ValueError(f"{path} goes on after the last level")
    return out
