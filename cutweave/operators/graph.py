"""Joins and aggregations on edges, vertices and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutweave.functions.scalars import partition_capacity, pseudo_label


def label_ends(edges: DataFrame, labels: DataFrame, label: str = "part") -> DataFrame:
    """Edges with the labels of both ends: ls, ld. No side is broadcast by
    hand; the optimizer does so where the labels' size allows."""
    s = labels.select(F.col("v").alias("src"), F.col(label).alias("ls"))
    d = labels.select(F.col("v").alias("dst"), F.col(label).alias("ld"))
    return edges.join(s, "src").join(d, "dst")


def affinity(edges: DataFrame, labels: DataFrame, label: str = "c") -> DataFrame:
    """(v, label, aff): weight from each vertex to each label next to it; loops don't count."""
    d = labels.select(F.col("v").alias("dst"), F.col(label))
    near = edges.filter("src <> dst").join(d, "dst")
    return near.groupBy(F.col("src").alias("v"), label).agg(F.sum("w").alias("aff"))


def dense_affinity(edges: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """One row a vertex with a column p0, p1, ... for each part."""
    out = affinity(edges, labels, "part").groupBy("v").pivot("part", list(range(parts))).sum("aff")
    return out.select("v", *[F.coalesce(F.col(str(p)), F.lit(0)).alias(f"p{p}") for p in range(parts)])


def cut(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: cut, the weight between parts, each edge once; odd: whether
    the directed sum was odd, which a symmetric graph's never is."""
    total = F.coalesce(F.sum(F.when(F.col("ls") != F.col("ld"), F.col("w"))), F.lit(0))
    out = label_ends(edges, labels).agg(total.alias("directed"))
    return out.select(F.expr("directed div 2").alias("cut"), (F.col("directed") % 2 != 0).alias("odd"))


def cut_value(edges: DataFrame, labels: DataFrame) -> int:
    row = cut(edges, labels).first()
    if row["odd"]:
        raise ValueError("the graph is not symmetric")
    return row["cut"]


def loads(vertices: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """(part, load, n) for every part, empty ones too."""
    own = vertices.join(labels, "v").groupBy("part").agg(F.sum("vw").alias("load"), F.count(F.lit(1)).alias("n"))
    every = vertices.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    return every.join(own, "part", "left").select("part", F.coalesce("load", F.lit(0)).alias("load"), F.coalesce("n", F.lit(0)).alias("n"))


def load_list(vertices: DataFrame, labels: DataFrame, parts: int) -> list[int]:
    return [r["load"] for r in loads(vertices, labels, parts).orderBy("part").collect()]


def check_labels(vertices: DataFrame, labels: DataFrame, parts: int) -> None:
    """Raises ValueError unless each vertex has one label from 0 to parts - 1."""
    joined = vertices.select("v").join(labels, "v", "full_outer")
    bad = joined.groupBy("v").agg(F.count("part").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    if not bad.filter(f"n <> 1 or lo < 0 or hi >= {parts}").isEmpty() or labels.count() != vertices.count():
        raise ValueError("labels do not cover the vertices with parts in range")


def cluster_weights(vertices: DataFrame, clusters: DataFrame) -> DataFrame:
    return vertices.join(clusters, "v").groupBy("c").agg(F.sum("vw").alias("cw"))


def contract_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between clusters, weights added up; edges within vanish."""
    s = mapping.select(F.col("v").alias("src"), F.col("c").alias("cs"))
    d = mapping.select(F.col("v").alias("dst"), F.col("c").alias("cd"))
    cross = edges.join(s, "src").join(d, "dst").filter("cs <> cd")
    return cross.groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w"))


def contract_vertices(vertices: DataFrame, mapping: DataFrame) -> DataFrame:
    return cluster_weights(vertices, mapping).select(F.col("c").alias("v"), F.col("cw").alias("vw"))


def project(mapping: DataFrame, coarse_labels: DataFrame) -> DataFrame:
    return mapping.join(coarse_labels.withColumnRenamed("v", "c"), "c").select("v", "part")


def contraction_faults(edges: DataFrame, vertices: DataFrame, mapping: DataFrame, coarse_edges: DataFrame, coarse_vertices: DataFrame, cap: int) -> DataFrame:
    """One row that says what a contraction must keep: total weight, every
    cluster's weight, the capacity, and the cut of made-up labels."""
    fine = mapping.select("v", pseudo_label(F.col("c")).alias("part"))
    coarse = coarse_vertices.select("v", pseudo_label(F.col("v")).alias("part"))
    got = cluster_weights(vertices, mapping).join(coarse_vertices, F.col("c") == F.col("v"), "full_outer")
    row = got.agg(
        F.sum(F.when(F.col("cw").eqNullSafe(F.col("vw")), 0).otherwise(1)).alias("wrong_weights"), F.sum(F.when(F.col("vw") > cap, 1).otherwise(0)).alias("over_capacity"),
        F.sum("cw").alias("fine_weight"), F.sum("vw").alias("coarse_weight"),
    )
    one, two = cut(edges, fine).select(F.col("cut").alias("fine_cut")), cut(coarse_edges, coarse).select(F.col("cut").alias("coarse_cut"))
    return row.crossJoin(one).crossJoin(two)  # three frames of one row


def cluster_percentiles(vertices: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: n, singletons, p50, p90, p99 (the lower of two), max weight.

    Ranks come from running counts over the distinct weights."""
    cw = clusters.join(vertices, "v").groupBy("c").agg(F.sum("vw").alias("cw"), F.count(F.lit(1)).alias("k"))
    hist = cw.groupBy("cw").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).alias("single"))
    run = F.sum("n").over(Window.orderBy("cw").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row a distinct weight
    ranked = hist.withColumn("upto", run).withColumn("all", F.sum("n").over(Window.partitionBy()))
    pick = lambda f: F.min(F.when(F.col("upto") > F.floor(F.lit(f) * (F.col("all") - 1)), F.col("cw")))
    return ranked.agg(F.sum("n").alias("clusters"), F.sum("single").alias("singletons"), pick(0.5).alias("p50"), pick(0.9).alias("p90"), pick(0.99).alias("p99"), F.max("cw").alias("max_weight"))


def analyze_parts(edges: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """(part, vertices, internal, outgoing, incoming and their values): counts
    and weighted sums of directed edges; loops are internal."""
    ends = label_ends(edges, labels)
    same = F.col("ls") == F.col("ld")
    out = ends.groupBy(F.col("ls").alias("part")).agg(
        F.sum(F.when(same, 1).otherwise(0)).alias("internal"), F.sum(F.when(~same, 1).otherwise(0)).alias("outgoing"),
        F.sum(F.when(same, F.col("w").cast("double")).otherwise(0.0)).alias("internal_value"), F.sum(F.when(~same, F.col("w").cast("double")).otherwise(0.0)).alias("outgoing_value"),
    )
    into = ends.filter(~same).groupBy(F.col("ld").alias("part")).agg(F.count(F.lit(1)).alias("incoming"), F.sum(F.col("w").cast("double")).alias("incoming_value"))
    n = labels.groupBy("part").agg(F.count(F.lit(1)).alias("vertices"))
    every = edges.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    whole = every.join(n, "part", "left").join(out, "part", "left").join(into, "part", "left")
    return whole.na.fill(0)


def analyze_summary(per_part: DataFrame) -> DataFrame:
    """One row: directed cut and its ratio, and mean, extremes, imbalance
    (max / mean) and deviation (spread / mean) of vertices and edge sets."""
    edges = F.col("internal") + F.col("outgoing")
    row = per_part.withColumn("e", edges).agg(
        F.sum("outgoing").alias("directed_cut"), F.sum("e").alias("directed_edges"), F.avg("outgoing").alias("local_cut_avg"), F.max("outgoing").alias("local_cut_max"),
        F.avg("vertices").alias("vertices_avg"), F.min("vertices").alias("vertices_min"), F.max("vertices").alias("vertices_max"),
        F.avg("e").alias("edges_avg"), F.min("e").alias("edges_min"), F.max("e").alias("edges_max"),
    )
    ratio = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    row = row.withColumn("cut_ratio", ratio("directed_cut", "directed_edges"))
    for x in ("vertices", "edges"):
        row = row.withColumn(f"{x}_imbalance", ratio(f"{x}_max", f"{x}_avg"))
        row = row.withColumn(f"{x}_deviation", F.when(F.col(f"{x}_avg") == 0, 0.0).otherwise((F.col(f"{x}_max") - F.col(f"{x}_min")) / F.col(f"{x}_avg")))
    return row


def verify(edges: DataFrame, vertices: DataFrame, labels: DataFrame, parts: int, ratio: float) -> DataFrame:
    """One row: vertices, undirected edges without loops, cut, its ratio, max
    load, capacity and whether it holds."""
    check_labels(vertices, labels, parts)
    total = vertices.agg(F.sum("vw")).first()[0] or 0
    cap = partition_capacity(total, parts, ratio)
    n = vertices.agg(F.count(F.lit(1)).alias("vertices"))
    m = edges.filter("src <> dst").agg(F.expr("count(1) div 2").alias("edges"), F.expr("coalesce(sum(w), 0) div 2").alias("edge_weight"))
    top = loads(vertices, labels, parts).agg(F.max("load").alias("max_load"), F.min("load").alias("min_load"))
    row = n.crossJoin(m).crossJoin(cut(edges, labels).select("cut")).crossJoin(top)  # frames of one row
    row = row.withColumn("cut_ratio", F.when(F.col("edge_weight") == 0, 0.0).otherwise(F.col("cut") / F.col("edge_weight")))
    return row.withColumn("capacity", F.lit(cap)).withColumn("capacity_ok", F.col("max_load") <= cap)


def repeat_summary(runs: DataFrame) -> DataFrame:
    """(k, method) -> median, least and greatest of seconds and cut."""
    aggs = [f(c).alias(f"{c}_{name}") for c in ("seconds", "cut") for name, f in (("median", F.median), ("min", F.min), ("max", F.max))]
    return runs.groupBy("k", "method").agg(F.count(F.lit(1)).alias("runs"), *aggs)


def imbalance(vertices: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """One row: total and greatest load, and their imbalance: max * parts / total, 0 without weight."""
    top = loads(vertices, labels, parts).agg(F.sum("load").alias("total"), F.max("load").alias("max_load"))
    return top.withColumn("imbalance", F.when(F.col("total") == 0, 0.0).otherwise(F.col("max_load") * F.lit(float(parts)) / F.col("total")))


def balance_report(summary: DataFrame, vertex_limit: float = 1.05, edge_limit: float = 1.05) -> DataFrame:
    """(metric, avg, min, max, imbalance, deviation, allowed_max, within_ratio)
    of vertices and edge sets, from :func:`analyze_summary`."""
    rows = None
    for x, limit in (("vertices", vertex_limit), ("edges", edge_limit)):
        avg, least, most = (F.col(f"{x}_{k}").cast("double") for k in ("avg", "min", "max"))
        off = F.when(avg == 0, 0.0).otherwise(F.greatest(F.abs(most - avg), F.abs(least - avg)) / avg)
        ratio = F.col(f"{x}_imbalance").cast("double")
        one = summary.select(F.lit(x).alias("metric"), avg.alias("avg"), least.alias("min"), most.alias("max"), ratio.alias("imbalance"), off.alias("deviation"), (avg * limit).alias("allowed_max"), (ratio <= limit).alias("within_ratio"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def report_text(report: DataFrame) -> str:
    """The balance report as lines of key=value: two rows, one a metric."""
    return "\n".join(" ".join(f"{k}={str(v).lower() if isinstance(v, bool) else f'{v:.6g}' if isinstance(v, float) else v}" for k, v in r.asDict().items()) for r in report.collect())


def labels_digest(labels: DataFrame) -> str:
    """A digest of a labelling that does not depend on the order of its rows."""
    word = lambda k: F.sum(F.conv(F.substring("h", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")).cast("string")
    hashed = labels.select(F.sha2(F.concat_ws(":", "v", "part"), 256).alias("h"))
    return hashed.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[word(k) for k in range(4)]), 256)).first()[0]
