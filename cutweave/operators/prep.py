"""Preparation, validation and numbering of graphs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutweave.model import materialize

#: Ids that share a block in two-level running sums.
BLOCK = 1 << 16
#: Rows that one task may sort; the sums are whole numbers, so it makes no difference to them.
FEW = 1 << 20


def symmetrize(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges, without self-loops, in both directions."""
    one = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct()
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def degree(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, deg): directed entries of each vertex's row, loops included."""
    rows = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("deg"))
    return vertices.select("v").join(rows, "v", "left").select("v", F.coalesce("deg", F.lit(0)).alias("deg"))


def degree_class(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(cls, n): low up to 8, medium up to 256, else high."""
    deg = F.col("deg")
    cls = F.when(deg <= 8, "low").when(deg <= 256, "medium").otherwise("high")
    return degree(edges, vertices).groupBy(cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def zero_degree(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return vertices.join(edges, vertices["v"] == edges["src"], "left_anti").select("v", "vw")


def symmetry_report(edges: DataFrame) -> DataFrame:
    """One row: entries, loops, duplicates, unique directed pairs without
    loops, reciprocal and one-way ones, undirected edges, pairs whose two
    multiplicities differ, and two verdicts."""
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n").alias("m"))
    both = pairs.join(back, ["src", "dst"], "left")
    loop, has = F.col("src") == F.col("dst"), F.col("m").isNotNull()
    s = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
    out = both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.coalesce(F.sum(F.when(loop, F.col("n"))), F.lit(0)).alias("self_loops"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        s(~loop).alias("unique_directed"), s(~loop & has).alias("reciprocal"), s(~loop & ~has).alias("one_way"),
        s((F.col("src") < F.col("dst")) | (~has & (F.col("src") > F.col("dst")))).alias("undirected"), s(~loop & has & (F.col("n") != F.col("m"))).alias("multiplicity_mismatches"),
    )
    return out.withColumn("is_symmetric", F.col("one_way") == 0).withColumn("is_multi_symmetric", (F.col("one_way") == 0) & (F.col("multiplicity_mismatches") == 0))


def reverse_violations(edges: DataFrame) -> DataFrame:
    """Entries (src, dst, w, n) whose reverse does not stand as often."""
    n = edges.groupBy("src", "dst", "w").agg(F.count(F.lit(1)).alias("n"))
    back = n.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "n")
    return n.join(back, ["src", "dst", "w", "n"], "left_anti")


def shape_violations(edges: DataFrame, n: int, allow_loops: bool = True) -> DataFrame:
    """Entries with ids out of range, or loops where these are not allowed."""
    bad = (F.col("src") < 0) | (F.col("src") >= n) | (F.col("dst") < 0) | (F.col("dst") >= n) | F.col("src").isNull() | F.col("dst").isNull()
    return edges.filter(bad if allow_loops else bad | (F.col("src") == F.col("dst")))


def validate(edges: DataFrame, vertices: DataFrame, allow_loops: bool = True, strict: bool = True) -> None:
    """Raises ValueError for ids out of range, gaps in the ids, weights that
    are not positive, loops where not allowed and, if strict, asymmetry."""
    row = vertices.agg(F.count(F.lit(1)), F.min("v"), F.max("v"), F.min("vw"), F.countDistinct("v")).first()
    if row[0] and (row[1] != 0 or row[2] != row[0] - 1 or row[4] != row[0]):
        raise ValueError("vertex ids are not dense from 0")
    if row[0] and row[3] <= 0:
        raise ValueError("vertex weights must be positive")
    if not shape_violations(edges, row[0], allow_loops).isEmpty():
        raise ValueError("an edge's end is out of range, or a self-loop")
    if strict and not reverse_violations(edges).isEmpty():
        raise ValueError("the graph is not symmetric")


def row_certificate(edges: DataFrame) -> DataFrame:
    """(v, row_sum, row_max, ascending): sums of rows, and whether a row's
    neighbours strictly ascend in the order of ``ord``."""
    before = F.lag("dst").over(Window.partitionBy("src").orderBy("ord"))
    up = F.coalesce(before < F.col("dst"), F.lit(True))
    return edges.withColumn("up", up).groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("row_sum"), F.max("w").alias("row_max"), F.min("up").alias("ascending"))


def running_sum(df: DataFrame, key: str, value: Column, out: str, exclusive: bool = False) -> DataFrame:
    """Running sum of ``value`` in ascending order of the distinct integer
    ``key``, over the whole frame, in two levels: no task sorts it all."""
    df = df.withColumn("__v", value).withColumn("__block", F.floor(F.col(key) / BLOCK))
    sums = df.groupBy("__block").agg(F.sum("__v").alias("__s"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each BLOCK ids
    sums = sums.select("__block", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("__block").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__in", F.sum("__v").over(inner)).join(sums, "__block")
    total = F.col("__base") + F.col("__in")
    return df.withColumn(out, total - F.col("__v") if exclusive else total).drop("__v", "__block", "__in", "__base")


def ordered_sum(df: DataFrame, by: list[str], order: list[Column], value: Column, out: str, exclusive: bool = False, most: int | None = None) -> DataFrame:
    """Running sum of ``value`` within each value of ``by``, in an order that
    has no ties. Rows are dealt by ranges of (by, order) and stored; a task
    sorts one range, however few values ``by`` has, or none. Where the caller
    knows that there are at ``most`` FEW rows, a plain window does."""
    if most is not None and most <= FEW:
        run = F.sum("__v").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        df = df.withColumn("__v", value).withColumn(out, run)
        return (df.withColumn(out, F.col(out) - F.col("__v")) if exclusive else df).drop("__v")
    dealt = df.withColumn("__v", value).repartitionByRange(*[F.col(c) for c in by], *order)
    dealt = materialize(dealt.withColumn("__p", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = dealt.groupBy(*by, "__p").agg(F.sum("__v").alias("__s"))
    sums = sums.select(*by, "__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*by, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("__base") + F.col("__in")
    run = dealt.withColumn("__in", F.sum("__v").over(inner)).join(sums, [*by, "__p"])
    return run.withColumn(out, total - F.col("__v") if exclusive else total).drop("__v", "__p", "__in", "__base")


def compact(clusters: DataFrame) -> DataFrame:
    """(v, c): surviving cluster ids numbered densely in ascending order."""
    ids = running_sum(clusters.select("c").distinct(), "c", F.lit(1).cast("bigint"), "id", exclusive=True)
    return clusters.join(ids, "c").select("v", F.col("id").alias("c"))


def remap_ids(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges on dense ids, and the map (id, v). ``raw``: ord, src, dst. Ids
    are numbered by first appearance, a record's src before its dst; records
    of loops number their id but give no edge."""
    seen = raw.select(F.col("src").alias("id"), (F.col("ord") * 2).alias("at")).unionByName(raw.select(F.col("dst").alias("id"), (F.col("ord") * 2 + 1).alias("at")))
    first = seen.groupBy("id").agg(F.min("at").alias("at"))
    id_map = running_sum(first, "at", F.lit(1).cast("bigint"), "v", exclusive=True).select("id", "v")
    src, dst = id_map.select(F.col("id").alias("src"), F.col("v").alias("s")), id_map.select(F.col("id").alias("dst"), F.col("v").alias("d"))
    edges = raw.filter("src <> dst").join(src, "src").join(dst, "dst").select("ord", F.col("s").alias("src"), F.col("d").alias("dst"))
    return edges, id_map


def row_offsets(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, first): start of each vertex's row in a CSR, ascending by vertex."""
    return running_sum(degree(edges, vertices), "v", F.col("deg"), "first", exclusive=True).select("v", "first", "deg")


def expand_rows(offsets: DataFrame, indices: DataFrame) -> DataFrame:
    """(src, dst, ord) from (v, first, deg) and (pos, dst)."""
    rows = offsets.filter("deg > 0").select(F.col("v").alias("src"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("deg") - 1)).alias("pos"))
    return rows.join(indices, "pos").select("src", "dst", F.col("pos").alias("ord"))


def metis_rows(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, line): ascending neighbours from 1, an empty line without any."""
    rows = edges.groupBy(F.col("src").alias("v")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda d: (d + 1).cast("string")), " ").alias("line"))
    return vertices.select("v").join(rows, "v", "left").select("v", F.coalesce("line", F.lit("")).alias("line"))


# --- generators ----------------------------------------------------------------


def _random(salt: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def random_edges(spark: SparkSession, n: int, m: int, seed: int = 0, loops: bool = False) -> DataFrame:
    """``m`` distinct directed edges (src, dst, value in [0, 1)) on n vertices, sorted."""
    most = n * n if loops else n * (n - 1)
    if n < 1 or m < 0 or m > most:
        raise ValueError("no such number of distinct edges")
    draws = int(m * 1.2) + 64 if m < most // 2 else most
    if m < most // 2:
        i = F.col("id")
        pairs = spark.range(4 * draws).select(F.floor(_random(seed, F.lit("s"), i) * n).alias("src"), F.floor(_random(seed, F.lit("d"), i) * n).alias("dst"))
    else:
        pairs = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst"))
    pairs = (pairs if loops else pairs.filter("src <> dst")).distinct()
    key = F.xxhash64(F.lit(seed), "src", "dst")
    ranked = ordered_sum(pairs.withColumn("key", key), [], [F.col("key"), F.col("src"), F.col("dst")], F.lit(1).cast("bigint"), "rank").filter(F.col("rank") <= m).select("src", "dst")
    return ranked.withColumn("value", _random(seed, F.lit("v"), F.col("src"), F.col("dst")).cast("float")).orderBy("src", "dst")


def synthetic(spark: SparkSession, kind: str, n: int = 16384, seed: int = 17) -> DataFrame:
    """Symmetric edges of a social, circuit or disconnected graph; n is a multiple of 8."""
    if n < 8 or n % 8:
        raise ValueError("the number of vertices must be a multiple of 8")
    size, v = n // 8, F.col("v")
    ids = spark.range(n).select(F.col("id").alias("v"))
    link = lambda dst, frame=ids: frame.select(v.alias("src"), dst.cast("bigint").alias("dst"))
    base = F.floor(v / size) * size
    if kind == "social":
        local = ids.select("v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
        out = link(base).unionByName(link(base + (v - base + 1) % size))
        out = out.unionByName(link(base + F.floor(_random(seed, v, F.col("j")) * size), local))
        out = out.unionByName(link(F.floor(_random(seed, F.lit("g"), v) * n), ids.filter(_random(seed, F.lit("p"), v) < 0.6)))
    elif kind == "circuit":
        out = link(v + 1).unionByName(link(v + 2)).unionByName(link(v + 4)).filter(F.col("dst") < n)
        out = out.unionByName(link(F.floor(_random(seed, F.lit("g"), v) * n), ids.filter(v % 16 == 0)))
    elif kind == "disconnected":
        out = link(v - 1, ids.filter(v % size != 0))
    else:
        raise ValueError(f"unknown kind {kind}")
    return symmetrize(out).withColumn("w", F.lit(1).cast("bigint"))


def multigraph(spark: SparkSession, n: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Edges and vertices of a symmetric graph with a self-loop, parallel
    edges, small components, an isolated vertex (7) and pairs (u, u + 1) for
    even u from 10."""
    once = [(0, 1), (0, 1), (1, 2), (2, 3), (4, 5), (5, 6), (5, 6), (8, 9)]
    head = spark.createDataFrame([(0, 0), *once, *((b, a) for a, b in once)], "src bigint, dst bigint")
    pairs = spark.range(10, n - 1, 2).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    edges = head.unionByName(pairs).unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.withColumn("w", F.lit(1).cast("bigint")), spark.range(n).select(F.col("id").alias("v"), F.lit(1).cast("bigint").alias("vw"))


def record_bounds(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """(c, bound): most weight that any entry of a cluster's row can get, the
    sum of its vertices' rows, held at 2^64 - 1."""
    rows = edges.groupBy(F.col("src").alias("v")).agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("bound"))
    total = mapping.join(rows, "v", "left").groupBy("c").agg(F.coalesce(F.sum("bound"), F.lit(0)).alias("bound"))
    return total.select("c", F.least(F.col("bound"), F.lit(Decimal(2**64 - 1)).cast("decimal(38,0)")).cast("decimal(20,0)").alias("bound"))


def checked_total(df: DataFrame, column: str, limit: int = 2**64 - 1) -> int:
    """Exact sum of a column; OverflowError beyond ``limit``."""
    total = int(df.agg(F.coalesce(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(0))).first()[0])
    if total > limit:
        raise OverflowError(f"the sum of {column} is beyond its type")
    return total
