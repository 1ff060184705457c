"""The registered queries of the graph operators, each with its SQL.

Graphs come from the sales tables: parts that are bought together (PP), and
suppliers with their parts (SP). Labels, clusters and maps are made from the
vertex ids, so that SQL can make them too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutweave.functions import scalars
from cutweave.model import CoarsenOptions, RefineOptions, materialize, scratch, shared_root
from cutweave.operators import blocks as bl
from cutweave.operators import coarsen as co
from cutweave.operators import graph as gr
from cutweave.operators import prep
from cutweave.operators import refine as rf
from cutweave.operators import spectral as sp
from cutweave.plans import partition as pt
from cutweave.sources import files

K, ALPHA, CAP = 4, 1.03, 5
SEED, LEVEL, ROUND = 7, 1, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges_pp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one order, weighted by the number of line pairs."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    a, b = lines.select("l_orderkey", F.col("l_partkey").alias("src")), lines.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def packed_pp(spark: SparkSession, sf_dir: str, v: DataFrame) -> tuple[DataFrame, bl.Blocks | None]:
    """PP as its entries, and packed from the lines of the orders where that
    can be; the entries are stored only where it can not."""
    g = bl.pack_groups(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("v")), v)
    e = edges_pp(spark, sf_dir)
    return (e if g else materialize(e)), g


def edges_sp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers (ids first) and parts, in both directions."""
    n = table(spark, sf_dir, "supplier").count()
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + n).alias("dst")).agg(F.count(F.lit(1)).alias("w"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed multigraph with self-loops: part and supplier keys as they are."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit(1).cast("bigint").alias("w"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), (1 + F.col("p_size") % 3).cast("bigint").alias("vw"))


def labels(v: DataFrame, k: int = K) -> DataFrame:
    return v.select("v", (F.col("v") % k).cast("int").alias("part"))


def heavy_labels(v: DataFrame) -> DataFrame:
    """Most of the weight in part 0."""
    return v.select("v", F.when(F.col("v") % 5 < 3, 0).otherwise(F.col("v") % K).cast("int").alias("part"))


def with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and, numbered after them, customers: these have no entry in PP."""
    n = table(spark, sf_dir, "part").count()
    own = table(spark, sf_dir, "customer").select((F.col("c_custkey") + n).alias("v"), (1 + F.col("c_nationkey") % 3).cast("bigint").alias("vw"))
    return vertices(spark, sf_dir).unionByName(own)


def clusters(v: DataFrame) -> DataFrame:
    return v.select("v", (F.col("v") - F.col("v") % 3).alias("c"))


def mapping(v: DataFrame) -> DataFrame:
    return v.select("v", F.expr("v div 3").alias("c"))


ROLE, TIE = scalars.salts(SEED + LEVEL, LEVEL, ROUND)
#: As if half the clusters could go.
THRESHOLD = 1 << 31


def proposals(spark: SparkSession, sf_dir: str, roles: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = vertices(spark, sf_dir)
    c = clusters(v)
    return co.propose(gr.affinity(edges_pp(spark, sf_dir), c), c, ROLE, THRESHOLD, TIE, roles), v, c


def lp(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = edges_pp(spark, sf_dir)
    own = labels(vertices(spark, sf_dir))
    return rf.lp_targets(gr.affinity(e, own, "part"), own, 0.75), e, own


def lp_movers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, e, own = lp(spark, sf_dir)
    p, e = materialize(p), materialize(e)
    return materialize(rf.priority_filter(e, own, p)), e, own


def overload(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int], int]:
    e, v = edges_pp(spark, sf_dir), vertices(spark, sf_dir)
    own = heavy_labels(v)
    loads = gr.load_list(v, own, K)
    cap = scalars.partition_capacity(sum(loads), K, ALPHA)
    return rf.rebalance_targets(gr.affinity(e, own, "part"), v, own, loads, cap), loads, cap


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertices(spark, sf_dir).select("v", (F.col("v") % 2).cast("int").alias("grp"))


def rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in names})


# --- SQL -------------------------------------------------------------------------

E = "e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*)::BIGINT AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2)"
V = "v AS (SELECT p_partkey AS v, (1 + p_size % 3)::BIGINT AS vw FROM part)"
VC = V.removesuffix(")") + " UNION ALL SELECT c_custkey + (SELECT count(*) FROM part), (1 + c_nationkey % 3)::BIGINT FROM customer)"
L = f"l AS (SELECT v, (v % {K})::INTEGER AS part FROM v)"
H = f"l AS (SELECT v, CASE WHEN v % 5 < 3 THEN 0 ELSE v % {K} END::INTEGER AS part FROM v)"
C = "c AS (SELECT v, v - v % 3 AS c FROM v)"
M = "m AS (SELECT v, v // 3 AS c FROM v)"
R = "r AS (SELECT l_orderkey * 10 + l_linenumber AS ord, l_partkey AS src, l_suppkey AS dst, 1::BIGINT AS w FROM lineitem)"
PA = "a AS (SELECT e.src AS v, l.part, sum(e.w)::BIGINT AS aff FROM e JOIN l ON l.v = e.dst WHERE e.src <> e.dst GROUP BY 1, 2)"


def mix_sql(rel: str, x: str, out: str) -> str:
    """A SELECT that adds mix32 of ``x`` to the rows of ``rel``."""
    z = [f"z{i}_{out}" for i in range(5)]
    mul = lambda a, c: f"(({a} & 65535) * {c} + (((({a} >> 16) * {c}) & 65535) << 16)) & 4294967295"
    q = f"SELECT *, ({x})::BIGINT & 4294967295 AS {z[0]} FROM {rel}"
    q = f"SELECT *, xor({z[0]}, {z[0]} >> 16) AS {z[1]} FROM ({q})"
    q = f"SELECT *, {mul(z[1], scalars.MIX_A)} AS {z[2]} FROM ({q})"
    q = f"SELECT *, xor({z[2]}, {z[2]} >> 15) AS {z[3]} FROM ({q})"
    q = f"SELECT *, {mul(z[3], scalars.MIX_B)} AS {z[4]} FROM ({q})"
    return f"(SELECT * EXCLUDE ({', '.join(z)}), xor({z[4]}, {z[4]} >> 16) AS {out} FROM ({q}))"


def with_sql(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


def propose_ctes(roles: bool = True) -> list[str]:
    hashed = mix_sql(mix_sql("(SELECT DISTINCT c FROM c)", "c", "hc"), f"xor(c, {ROLE})", "role")
    near = mix_sql("(SELECT a.*, h.hc, h.role, c.c AS own, o.role AS own_role FROM ca a JOIN h ON h.c = a.c JOIN c ON c.v = a.v JOIN h o ON o.c = c.c)", f"xor(xor(v, hc), {TIE})", "t")
    ok = "c <> own AND aff > 0" + (f" AND role >= {THRESHOLD}" if roles else "")
    may = f" AND own_role < {THRESHOLD}" if roles else ""
    return [
        E, V, C, "ca AS (SELECT e.src AS v, c.c, sum(e.w)::BIGINT AS aff FROM e JOIN c ON c.v = e.dst WHERE e.src <> e.dst GROUP BY 1, 2)",
        f"h AS (SELECT c, hc, role FROM {hashed})", f"n AS (SELECT * FROM {near})",
        "mine AS (SELECT v, coalesce(max(CASE WHEN c = own THEN aff END), 0) AS mine FROM n GROUP BY v)",
        f"b AS (SELECT v, c AS target, aff, t, row_number() OVER (PARTITION BY v ORDER BY aff DESC, t DESC, c) AS rn FROM n WHERE {ok}{may})",
        "p AS (SELECT b.v, b.target, b.aff - mine.mine AS gain, b.t AS tie FROM b JOIN mine USING (v) WHERE rn = 1 AND aff > mine)",
    ]


ADMIT = f"""SELECT v, target FROM (
  SELECT p.v, p.target, cw, sum(vw) OVER (PARTITION BY p.target ORDER BY gain DESC, tie DESC, p.v ROWS UNBOUNDED PRECEDING) AS run
  FROM p JOIN v USING (v) LEFT JOIN (SELECT c AS target, sum(vw) AS cw FROM c JOIN v USING (v) GROUP BY 1) w ON w.target = p.target)
WHERE cw <= {CAP} AND run <= {CAP} - cw"""
FAV = ["f AS (SELECT p.*, v.vw FROM p JOIN v USING (v) JOIN c USING (v) JOIN (SELECT c, sum(vw) AS cw FROM c JOIN v USING (v) GROUP BY c) w ON w.c = c.c WHERE cw = vw)"]
PAIRS = [
    "k AS (SELECT *, row_number() OVER o AS rk, lag(vw) OVER o AS mate_w, lag(v) OVER o AS mate FROM f WINDOW o AS (PARTITION BY target ORDER BY gain DESC, tie DESC, v))",
    f"pr AS (SELECT v, mate, target, gain, tie FROM k WHERE rk % 2 = 0 AND mate_w <= {CAP} - vw)",
]
LP = [
    E, V, L, PA, "o AS (SELECT l.v, l.part AS source, coalesce(a.aff, 0) AS own FROM l LEFT JOIN a ON a.v = l.v AND a.part = l.part)",
    "b AS (SELECT a.v, o.source, o.own, a.part AS target, a.aff, row_number() OVER (PARTITION BY a.v ORDER BY a.aff DESC, a.part) AS rn FROM a JOIN o USING (v) WHERE a.part <> o.source AND a.aff > 0)",
    "p AS (SELECT v, source, target, (aff - own)::BIGINT AS gain FROM b WHERE rn = 1 AND (aff >= own OR own - aff < floor(0.75::DOUBLE * own)))",
]
FILTER = [
    """x AS (SELECT e.src AS v, sum(e.w * ((u.target = s.target)::INT - (u.target = s.source)::INT - (u.source = s.target)::INT + (u.source = s.source)::INT)) AS fix
      FROM e JOIN p s ON s.v = e.src JOIN p u ON u.v = e.dst WHERE e.src <> e.dst AND (u.gain > s.gain OR (u.gain = s.gain AND u.v < s.v)) GROUP BY 1)""",
    "mv AS (SELECT p.v, p.source, p.target, p.gain FROM p LEFT JOIN x USING (v) WHERE p.gain + coalesce(fix, 0) >= 0)",
]
REBALANCE = [
    E, V, H, PA, f"ld AS (SELECT p.part, coalesce(sum(vw), 0)::BIGINT AS load FROM (SELECT unnest(range({K}))::INTEGER AS part) p LEFT JOIN l ON l.part = p.part LEFT JOIN v ON v.v = l.v GROUP BY 1)",
    f"cp AS (SELECT floor(sum(load) * {ALPHA} / {K})::BIGINT AS cap FROM ld)",
    "src AS (SELECT v.v, v.vw, l.part AS source FROM v JOIN l USING (v) JOIN ld ON ld.part = l.part, cp WHERE load > cap)",
    f"""op AS (SELECT *, sum(slack) OVER (PARTITION BY v ORDER BY part ROWS UNBOUNDED PRECEDING) AS upto, sum(slack) OVER (PARTITION BY v) AS total FROM {mix_sql('''(
      SELECT s.v, s.vw, s.source, ld.part, cap - ld.load AS slack, coalesce(a.aff, 0) AS aff FROM src s JOIN ld ON ld.part <> s.source CROSS JOIN cp LEFT JOIN a ON a.v = s.v AND a.part = ld.part
      WHERE ld.load < cap AND s.vw <= cap - ld.load)''', "v", "hash")})""",
    "bs AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY aff DESC, slack DESC, part) AS rn FROM op)",
    "tk AS (SELECT v, min(part) AS drawn FROM op WHERE upto > hash % total GROUP BY v)",
    "rb AS (SELECT b.v, b.vw, b.source, CASE WHEN b.aff > 0 THEN b.part ELSE drawn END::INTEGER AS target, (b.aff - coalesce(a.aff, 0))::DOUBLE / b.vw AS per_weight FROM bs b JOIN tk USING (v) LEFT JOIN a ON a.v = b.v AND a.part = b.source WHERE rn = 1)",
]
BUCKET = "CASE WHEN per_weight > 0 THEN 0 WHEN per_weight = 0 THEN 1 ELSE greatest(2, least(49, 25 + ceil(ln(-per_weight) / ln(1.5::DOUBLE)))) END::INTEGER"
QUOTA = [
    f"bk AS (SELECT *, {BUCKET} AS bucket, hash % 16 AS section FROM {mix_sql('rb', 'v', 'hash')})",
    "q AS (SELECT bk.*, coalesce(sum(vw) OVER (PARTITION BY source ORDER BY bucket, section, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bk)",
    "ch AS (SELECT q.* FROM q JOIN ld ON ld.part = q.source, cp WHERE before < load - cap)",
]
G = "g AS (SELECT v, (v % 2)::INTEGER AS grp FROM v)"
SPECTRAL = [
    E, V, G, "w AS (SELECT e.src, e.dst, e.w, a.grp FROM e JOIN g a ON a.v = e.src JOIN g b ON b.v = e.dst WHERE a.grp = b.grp)",
    f"s AS (SELECT z.v, z.grp, coalesce(d.degree, 0)::DOUBLE AS degree, h / 4294967296.0::DOUBLE - 0.5 AS x FROM {mix_sql('g', f'xor(xor(v, {SEED}), grp)', 'h')} z LEFT JOIN (SELECT src AS v, sum(w)::DOUBLE AS degree FROM w GROUP BY 1) d USING (v))",
]
MOMENTS = [
    "mo AS (SELECT grp, sum(m) AS mass, sum(m * x) / sum(m) AS mean, sum(m * x * x) / sum(m) AS sq FROM (SELECT *, CASE WHEN degree > 0 THEN degree ELSE 1 END AS m FROM s) GROUP BY grp)",
    "nm AS (SELECT grp, mean, CASE WHEN sq - mean * mean > 1e-30 THEN 1 / sqrt(sq - mean * mean) ELSE 1 END AS scale FROM mo)",
    "n AS (SELECT v, grp, degree, (x - mean) * scale AS x FROM s JOIN nm USING (grp))",
]
ANALYZE = [
    E, V, L, "j AS (SELECT e.*, a.part AS ls, b.part AS ld FROM e JOIN l a ON a.v = e.src JOIN l b ON b.v = e.dst)",
    f"""pp AS (SELECT p.part, (SELECT count(*) FROM l WHERE l.part = p.part) AS vertices,
      count(*) FILTER (WHERE ls = p.part AND ld = p.part) AS internal, count(*) FILTER (WHERE ls = p.part AND ld <> p.part) AS outgoing,
      coalesce(sum(w) FILTER (WHERE ls = p.part AND ld = p.part), 0)::DOUBLE AS internal_value, coalesce(sum(w) FILTER (WHERE ls = p.part AND ld <> p.part), 0)::DOUBLE AS outgoing_value,
      count(*) FILTER (WHERE ls <> p.part AND ld = p.part) AS incoming, coalesce(sum(w) FILTER (WHERE ls <> p.part AND ld = p.part), 0)::DOUBLE AS incoming_value
      FROM (SELECT unnest(range({K}))::INTEGER AS part) p JOIN j ON ls = p.part OR ld = p.part GROUP BY p.part)""",
]
PSEUDO = "((c * 2654435761 + 17) % 23)"
CUT = "sum(CASE WHEN a.part <> b.part THEN w ELSE 0 END)"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__.removeprefix("q_")] = f
        if sql is not None:
            SQL[f.__name__.removeprefix("q_")] = sql
        return f

    return add


@register(with_sql(E, final="SELECT * FROM e"))
def q_edges_pp(s, d):
    return edges_pp(s, d)


@register("WITH o AS (SELECT l_suppkey AS src, l_partkey + (SELECT count(*) FROM supplier) AS dst, count(*)::BIGINT AS w FROM lineitem GROUP BY 1, 2) SELECT src, dst, w FROM o UNION ALL SELECT dst, src, w FROM o")
def q_edges_sp(s, d):
    return edges_sp(s, d)


@register(with_sql(R, "o AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM r WHERE src <> dst)", final="SELECT src, dst FROM o UNION ALL SELECT dst, src FROM o"))
def q_symmetrize(s, d):
    return prep.symmetrize(raw(s, d))


@register(with_sql(R, final="SELECT * FROM r WHERE src <> dst"))
def q_self_loop_filter(s, d):
    return prep.without_loops(raw(s, d))


@register(with_sql(E, V, final="SELECT CASE WHEN deg <= 8 THEN 'low' WHEN deg <= 256 THEN 'medium' ELSE 'high' END AS cls, count(*) AS n FROM (SELECT v.v, count(e.src) AS deg FROM v LEFT JOIN e ON e.src = v.v GROUP BY 1) GROUP BY 1"))
def q_degree_class(s, d):
    return prep.degree_class(edges_pp(s, d), vertices(s, d))


@register(with_sql(E, VC, final="SELECT v.v, count(e.src) AS deg FROM v LEFT JOIN e ON e.src = v.v GROUP BY 1"))
def q_degree(s, d):
    return prep.degree(edges_pp(s, d), with_customers(s, d))


@register(with_sql(E, VC, final="SELECT v, vw FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = v.v)"))
def q_zero_degree(s, d):
    return prep.zero_degree(edges_pp(s, d), with_customers(s, d))


@register(
    with_sql(
        R, "n AS (SELECT src, dst, count(*) AS n FROM r GROUP BY 1, 2)", "j AS (SELECT a.*, b.n AS m FROM n a LEFT JOIN n b ON a.src = b.dst AND a.dst = b.src)",
        "o AS (SELECT sum(n)::BIGINT AS entries, coalesce(sum(n) FILTER (WHERE src = dst), 0)::BIGINT AS self_loops, sum(n - 1)::BIGINT AS duplicates, count(*) FILTER (WHERE src <> dst) AS unique_directed, count(*) FILTER (WHERE src <> dst AND m IS NOT NULL) AS reciprocal, count(*) FILTER (WHERE src <> dst AND m IS NULL) AS one_way, count(*) FILTER (WHERE src < dst OR (m IS NULL AND src > dst)) AS undirected, count(*) FILTER (WHERE src <> dst AND n <> m) AS multiplicity_mismatches FROM j)",
        final="SELECT *, one_way = 0 AS is_symmetric, one_way = 0 AND multiplicity_mismatches = 0 AS is_multi_symmetric FROM o",
    )
)
def q_symmetry_report(s, d):
    return prep.symmetry_report(raw(s, d))


@register(with_sql(R, "n AS (SELECT src, dst, w, count(*) AS n FROM r GROUP BY 1, 2, 3)", final="SELECT src, dst, w, n FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.src = a.dst AND b.dst = a.src AND b.w = a.w AND b.n = a.n)"))
def q_reverse_violations(s, d):
    return prep.reverse_violations(raw(s, d))


@register(with_sql(R, final="SELECT src AS v, sum(w)::BIGINT AS row_sum, max(w) AS row_max, bool_and(up) AS ascending FROM (SELECT *, coalesce(lag(dst) OVER (PARTITION BY src ORDER BY ord) < dst, true) AS up FROM r) GROUP BY 1"))
def q_row_certificate(s, d):
    return prep.row_certificate(raw(s, d))


@register(with_sql(E, V, final="SELECT v, (sum(deg) OVER (ORDER BY v) - deg)::BIGINT AS first, deg FROM (SELECT v.v, count(e.src) AS deg FROM v LEFT JOIN e ON e.src = v.v GROUP BY 1)"))
def q_row_offsets(s, d):
    return prep.row_offsets(edges_pp(s, d), vertices(s, d))


@register(with_sql("r AS (SELECT DISTINCT l_partkey * 1000000 + l_suppkey AS ord, l_partkey AS src, l_suppkey AS dst FROM lineitem)", "f AS (SELECT id, min(seen) AS seen FROM (SELECT src AS id, ord * 2 AS seen FROM r UNION ALL SELECT dst, ord * 2 + 1 FROM r) GROUP BY 1)", "m AS (SELECT id, row_number() OVER (ORDER BY seen) - 1 AS v FROM f)", final="SELECT ord, a.v AS src, b.v AS dst FROM r JOIN m a ON a.id = r.src JOIN m b ON b.id = r.dst WHERE r.src <> r.dst"))
def q_id_remap(s, d):
    pairs = raw(s, d).select((F.col("src") * 1000000 + F.col("dst")).alias("ord"), "src", "dst").distinct()
    return prep.remap_ids(pairs)[0]


@register(with_sql(V, "t AS (SELECT v, v - v % 3 AS c FROM v)", final="SELECT v, dense_rank() OVER (ORDER BY c) - 1 AS c FROM t"))
def q_compact_ids(s, d):
    return prep.compact(clusters(vertices(s, d)))


@register(with_sql(E, V, final="SELECT v.v, coalesce(string_agg((e.dst + 1)::VARCHAR, ' ' ORDER BY e.dst), '') AS line FROM v LEFT JOIN e ON e.src = v.v GROUP BY 1"))
def q_metis_rows(s, d):
    return prep.metis_rows(edges_pp(s, d), vertices(s, d))


@register("SELECT l_orderkey, h FROM " + mix_sql("(SELECT DISTINCT l_orderkey FROM lineitem)", "l_orderkey * 2654435", "h"))
def q_mix32(s, d):
    keys = table(s, d, "lineitem").select("l_orderkey").distinct()
    return scalars.with_mix32(keys, F.col("l_orderkey") * 2654435, "h")


@register(with_sql(E, V, L, final="SELECT (sum(w) // 2)::BIGINT AS cut, sum(w) % 2 <> 0 AS odd FROM e JOIN l a ON a.v = e.src JOIN l b ON b.v = e.dst WHERE a.part <> b.part"))
def q_edge_cut(s, d):
    return gr.cut(edges_pp(s, d), labels(vertices(s, d)))


@register(with_sql(V, L, final=f"SELECT p.part, coalesce(sum(vw), 0)::BIGINT AS load, count(v.v) AS n FROM (SELECT unnest(range({K + 1}))::INTEGER AS part) p LEFT JOIN l ON l.part = p.part LEFT JOIN v ON v.v = l.v GROUP BY 1"))
def q_part_loads(s, d):
    v = vertices(s, d)
    return gr.loads(v, labels(v), K + 1)


@register(
    with_sql(
        E, V, L, "ld AS (SELECT part, sum(vw) AS load FROM l JOIN v USING (v) GROUP BY 1)",
        f"o AS (SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) // 2 FROM e) AS edges, (SELECT sum(w) // 2 FROM e)::BIGINT AS edge_weight, (SELECT sum(w) // 2 FROM e JOIN l a ON a.v = e.src JOIN l b ON b.v = e.dst WHERE a.part <> b.part)::BIGINT AS cut, (SELECT max(load) FROM ld)::BIGINT AS max_load, (SELECT min(load) FROM ld)::BIGINT AS min_load, (SELECT floor(sum(vw) * {ALPHA} / {K}) FROM v)::BIGINT AS capacity)",
        final="SELECT vertices, edges, edge_weight, cut, max_load, min_load, round(cut / edge_weight, 6) AS cut_ratio, capacity, max_load <= capacity AS capacity_ok FROM o",
    )
)
def q_verify_summary(s, d):
    v = vertices(s, d)
    return rounded(gr.verify(edges_pp(s, d), v, labels(v), K, ALPHA), "cut_ratio").withColumn("capacity", F.col("capacity").cast("bigint"))


@register(with_sql(V, f"t AS (SELECT sum(vw)::BIGINT AS total FROM v), k AS (SELECT unnest([2, 4, 8, 16, 32])::INTEGER AS parts)", final=f"SELECT parts, total, floor(total * {ALPHA} / parts)::BIGINT AS capacity FROM t, k"))
def q_capacity_check(s, d):
    total = vertices(s, d).agg(F.sum("vw")).first()[0]
    return s.createDataFrame([(k, total, scalars.partition_capacity(total, k, ALPHA)) for k in (2, 4, 8, 16, 32)], "parts int, total bigint, capacity bigint")


@register(with_sql(*propose_ctes()[:4], final="SELECT * FROM ca"))
def q_cluster_affinity(s, d):
    return gr.affinity(edges_pp(s, d), clusters(vertices(s, d)))


@register(with_sql(E, V, L, PA, final="SELECT v, " + ", ".join(f"coalesce(sum(aff) FILTER (WHERE part = {p}), 0)::BIGINT AS p{p}" for p in range(K)) + " FROM a GROUP BY v"))
def q_part_affinity(s, d):
    return gr.dense_affinity(edges_pp(s, d), labels(vertices(s, d)), K)


@register(with_sql(*propose_ctes(), final="SELECT * FROM p"))
def q_best_cluster(s, d):
    return proposals(s, d)[0]


@register(with_sql(*propose_ctes(), final="SELECT *, row_number() OVER (PARTITION BY target ORDER BY gain DESC, tie DESC, v)::INTEGER AS rank FROM p"))
def q_admission_order(s, d):
    w = Window.partitionBy("target").orderBy(*co.admission_order())
    return proposals(s, d)[0].withColumn("rank", F.row_number().over(w))


@register(with_sql(*propose_ctes(), final=ADMIT))
def q_prefix_admission(s, d):
    return co.admit(*proposals(s, d), CAP)


@register(with_sql(*propose_ctes(), f"ad AS ({ADMIT})", final="SELECT c.v, coalesce(ad.target, c.c) AS c FROM c LEFT JOIN ad USING (v)"))
def q_sclp_round(s, d):
    v = vertices(s, d)
    c = clusters(v)
    return co.move(c, co.sclp_round(edges_pp(s, d), v, c, CAP, ROLE, THRESHOLD, TIE))


@register(with_sql(*propose_ctes(False), *FAV, final="SELECT * FROM f").replace("v - v % 3 AS c", "CASE WHEN v % 4 = 0 THEN v - v % 3 ELSE v END AS c"))
def q_singleton_favorite(s, d):
    return co.singleton_favorites(*loose(s, d))


def loose(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Role-free proposals where most vertices are alone."""
    v = vertices(s, d)
    c = v.select("v", F.when(F.col("v") % 4 == 0, F.col("v") - F.col("v") % 3).otherwise(F.col("v")).alias("c"))
    return co.propose(gr.affinity(edges_pp(s, d), c), c, ROLE, 0, TIE, False), v, c


LOOSE = [x.replace("v - v % 3 AS c", "CASE WHEN v % 4 = 0 THEN v - v % 3 ELSE v END AS c") for x in propose_ctes(False)]


@register(with_sql(*LOOSE, *FAV, *PAIRS, final="SELECT * FROM pr"))
def q_two_hop_pairs(s, d):
    return co.two_hop_pairs(co.singleton_favorites(*loose(s, d)), CAP)


@register(with_sql(*LOOSE, *FAV, *PAIRS, "bd AS (SELECT greatest(0, count(DISTINCT c) - (count(*) + 1) // 2) AS budget FROM c)", "bg AS (SELECT *, row_number() OVER (ORDER BY target, gain DESC, tie DESC, v) AS pos FROM pr)", final="SELECT bg.v, c.c AS target FROM bg JOIN c ON c.v = bg.mate, bd WHERE pos <= budget"))
def q_merge_budget(s, d):
    """With the budget of the plan, which grows with the graph."""
    p, v, c = loose(s, d)
    n, count = c.agg(F.count(F.lit(1)), F.countDistinct("c")).first()
    return co.merge_budget(co.two_hop_pairs(co.singleton_favorites(p, v, c), CAP), c, max(0, count - -(-n // 2)))


@register(with_sql(E, VC, "z AS (SELECT v, vw, sum(vw) OVER (ORDER BY v) AS run FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = v.v))", "b AS (SELECT v, ((run - vw) // 12) AS bin FROM z WHERE (run - vw) // 12 = (run - 1) // 12)", final="SELECT v, min(v) OVER (PARTITION BY bin) AS rep FROM b"))
def q_isolated_packing(s, d):
    return co.pack_isolated(edges_pp(s, d), with_customers(s, d), 12)


@register(with_sql(E, V, M, final="SELECT a.c AS src, b.c AS dst, sum(w)::BIGINT AS w FROM e JOIN m a ON a.v = e.src JOIN m b ON b.v = e.dst WHERE a.c <> b.c GROUP BY 1, 2"))
def q_contract_edges(s, d):
    return gr.contract_edges(edges_pp(s, d), mapping(vertices(s, d)))


@register(with_sql(V, M, final="SELECT c AS v, sum(vw)::BIGINT AS vw FROM m JOIN v USING (v) GROUP BY 1"))
def q_contract_vertices(s, d):
    v = vertices(s, d)
    return gr.contract_vertices(v, mapping(v))


@register(with_sql(E, V, M, f"k AS (SELECT (sum(w) // 2)::BIGINT AS x FROM e JOIN m a ON a.v = e.src JOIN m b ON b.v = e.dst WHERE {PSEUDO.replace('c *', 'a.c *')} <> {PSEUDO.replace('c *', 'b.c *')})", final="SELECT 0::BIGINT AS wrong_weights, (SELECT count(*) FROM (SELECT c, sum(vw) AS s FROM m JOIN v USING (v) GROUP BY 1) WHERE s > 8) AS over_capacity, (SELECT sum(vw) FROM v)::BIGINT AS fine_weight, (SELECT sum(vw) FROM v)::BIGINT AS coarse_weight, x AS fine_cut, x AS coarse_cut FROM k"))
def q_contraction_cut_conserved(s, d):
    e, v = edges_pp(s, d), vertices(s, d)
    m = mapping(v)
    return gr.contraction_faults(e, v, m, gr.contract_edges(e, m), gr.contract_vertices(v, m), 8)


@register(with_sql(V, M, final="SELECT v, (c % 4)::INTEGER AS part FROM m"))
def q_project_labels(s, d):
    m = mapping(vertices(s, d))
    return gr.project(m, m.select(F.col("c").alias("v"), (F.col("c") % 4).cast("int").alias("part")).distinct())


@register(with_sql(*LP, final="SELECT * FROM p"))
def q_lp_targets(s, d):
    return lp(s, d)[0]


@register(with_sql(*LP, *FILTER, final="SELECT * FROM mv"))
def q_priority_filter(s, d):
    return lp_movers(s, d)[0]


@register(with_sql(*LP, *FILTER, final="SELECT coalesce(sum(w * ((s.source <> l.part)::INT - (s.target <> coalesce(u.target, l.part))::INT)), 0)::BIGINT AS gain FROM e JOIN mv s ON s.v = e.src JOIN l ON l.v = e.dst LEFT JOIN mv u ON u.v = e.dst WHERE e.src <> e.dst AND (u.v IS NULL OR e.dst > e.src)"))
def q_cut_delta(s, d):
    movers, e, own = lp_movers(s, d)
    return rf.cut_delta(e, own, movers)


@register(with_sql(*LP, *FILTER, final="SELECT l.v, coalesce(mv.target, l.part)::INTEGER AS part FROM l LEFT JOIN mv USING (v)"))
def q_apply_moves(s, d):
    movers, _, own = lp_movers(s, d)
    return rf.apply_moves(own, movers)


@register(with_sql(*LP, *FILTER, "n AS (SELECT l.v, coalesce(mv.target, l.part)::INTEGER AS part FROM l LEFT JOIN mv USING (v))", final="SELECT e.src AS v, n.part, sum(e.w)::BIGINT AS aff FROM e JOIN n ON n.v = e.dst GROUP BY 1, 2"))
def q_affinity_delta(s, d):
    movers, e, own = lp_movers(s, d)
    return rf.affinity_delta(e, gr.affinity(e, own, "part"), movers)


@register(with_sql(*REBALANCE, final="SELECT v, vw, source, target, round(per_weight, 6) AS per_weight FROM rb"))
def q_rebalance_targets(s, d):
    return rounded(overload(s, d)[0], "per_weight")


@register(with_sql(*REBALANCE, *QUOTA, final="SELECT v, bucket, section FROM bk"))
def q_gain_bucket(s, d):
    return rf._ordered(overload(s, d)[0]).select("v", "bucket", "section")


@register(with_sql(*REBALANCE, *QUOTA, final="SELECT v, source, target, bucket FROM ch"))
def q_source_quota(s, d):
    return rf.source_quota(*overload(s, d)).select("v", "source", "target", "bucket")


@register(with_sql(*REBALANCE, *QUOTA, "dd AS (SELECT *, sum(vw) OVER (PARTITION BY target ORDER BY bucket, section, v ROWS UNBOUNDED PRECEDING) AS run FROM ch)", final="SELECT v, source, target FROM dd JOIN ld ON ld.part = dd.target, cp WHERE run <= cap - load"))
def q_destination_admission(s, d):
    moves, loads, cap = overload(s, d)
    return rf.destination_admission(rf.source_quota(moves, loads, cap), loads, cap)


@register(with_sql(*SPECTRAL, final="SELECT v, grp, degree, round(x, 6) AS x FROM s"))
def q_spectral_start(s, d):
    return rounded(sp.start(edges_pp(s, d), groups(s, d), SEED), "x")


@register(with_sql(*SPECTRAL, *MOMENTS, final="SELECT grp, round(mean, 6) AS mean, round(scale, 6) AS scale FROM nm"))
def q_spectral_moments(s, d):
    return rounded(sp.moments(sp.start(edges_pp(s, d), groups(s, d), SEED)), "mean", "scale")


STEP = "st AS (SELECT n.v, n.grp, n.degree, CASE WHEN n.degree > 0 THEN 0.5 * (n.x + coalesce(k.s, 0) / n.degree) ELSE n.x END AS x FROM n LEFT JOIN (SELECT w.src AS v, sum(w.w * n.x) AS s FROM w JOIN n ON n.v = w.dst GROUP BY 1) k USING (v))"


@register(with_sql(*SPECTRAL, *MOMENTS, STEP, final="SELECT v, grp, degree, round(x, 6) AS x FROM st"))
def q_spectral_step(s, d):
    e = edges_pp(s, d)
    return rounded(sp.step(e, sp.normalize(sp.start(e, groups(s, d), SEED))), "x")


@register(with_sql(*SPECTRAL, final="SELECT s.v, s.grp, row_number() OVER o::INTEGER AS pos, sum(vw) OVER (PARTITION BY s.grp ORDER BY s.x, s.v ROWS UNBOUNDED PRECEDING)::BIGINT AS prefix FROM s JOIN v USING (v) WINDOW o AS (PARTITION BY s.grp ORDER BY s.x, s.v)"))
def q_split_prefix(s, d):
    return sp.prefix_weights(sp.start(edges_pp(s, d), groups(s, d), SEED), vertices(s, d))


@register(with_sql(*ANALYZE, final="SELECT * FROM pp"))
def q_analyze_parts(s, d):
    return gr.analyze_parts(edges_pp(s, d), labels(vertices(s, d)), K)


@register(
    with_sql(
        *ANALYZE, "z AS (SELECT *, internal + outgoing AS e FROM pp)",
        "o AS (SELECT sum(outgoing)::BIGINT AS directed_cut, sum(e)::BIGINT AS directed_edges, avg(outgoing) AS local_cut_avg, max(outgoing) AS local_cut_max, avg(vertices) AS vertices_avg, min(vertices) AS vertices_min, max(vertices) AS vertices_max, avg(e) AS edges_avg, min(e) AS edges_min, max(e) AS edges_max FROM z)",
        final="SELECT directed_cut, directed_edges, round(local_cut_avg, 6) AS local_cut_avg, local_cut_max, round(vertices_avg, 6) AS vertices_avg, vertices_min, vertices_max, round(edges_avg, 6) AS edges_avg, edges_min, edges_max, round(directed_cut / directed_edges, 6) AS cut_ratio, round(vertices_max / vertices_avg, 6) AS vertices_imbalance, round((vertices_max - vertices_min) / vertices_avg, 6) AS vertices_deviation, round(edges_max / edges_avg, 6) AS edges_imbalance, round((edges_max - edges_min) / edges_avg, 6) AS edges_deviation FROM o",
    )
)
def q_analyze_summary(s, d):
    out = gr.analyze_summary(gr.analyze_parts(edges_pp(s, d), labels(vertices(s, d)), K))
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@register(with_sql(V, C, "w AS (SELECT c, sum(vw)::BIGINT AS cw, count(*) AS k FROM c JOIN v USING (v) GROUP BY 1)", "r AS (SELECT *, row_number() OVER (ORDER BY cw) - 1 AS i, count(*) OVER () AS n FROM w)", final="SELECT max(n) AS clusters, count(*) FILTER (WHERE k = 1) AS singletons, " + ", ".join(f"max(cw) FILTER (WHERE i = floor({f}::DOUBLE * (n - 1)))::BIGINT AS {name}" for f, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))) + ", max(cw) AS max_weight FROM r"))
def q_cluster_weight_percentiles(s, d):
    v = vertices(s, d)
    return gr.cluster_percentiles(v, clusters(v))


@register("SELECT (o_custkey % 3)::INTEGER AS k, o_orderpriority AS method, count(*) AS runs, " + ", ".join(f"{f}({c}) AS {n}_{m}" for c, n in (("o_totalprice", "seconds"), ("o_orderkey::DOUBLE", "cut")) for f, m in (("median", "median"), ("min", "min"), ("max", "max"))) + " FROM orders GROUP BY 1, 2")
def q_repeat_summary(s, d):
    runs = table(s, d, "orders").select((F.col("o_custkey") % 3).cast("int").alias("k"), F.col("o_orderpriority").alias("method"), F.col("o_totalprice").alias("seconds"), F.col("o_orderkey").cast("double").alias("cut"))
    return gr.repeat_summary(runs)


@register()
def q_coarsen_levels(s, d):
    """(level, vertices, entries, weight) of the hierarchy of PP."""
    with scratch(s):
        v = materialize(vertices(s, d))
        e, packed = packed_pp(s, d, v)
        h = pt.coarsen(e, v, CoarsenOptions(K, SEED, cluster_size_factor=128, strict_verify=True), packed)
        rows = [(k, g.n, g.entries, int(g.vw.sum())) for k, g in enumerate(h.packed)]  # no entry of PP is parallel to another
        rows = rows or [(k, x.count(), y.count(), x.agg(F.sum("vw")).first()[0]) for k, (y, x) in enumerate(h.graphs)]
    return s.createDataFrame(rows, "level int, vertices bigint, entries bigint, weight bigint")


@register()
def q_partition_pipeline(s, d):
    """Parts of PP: coarsened, split, projected and refined."""
    with scratch(s):  # the labels stay
        v = materialize(table(s, d, "part").select(F.col("p_partkey").alias("v"), F.lit(1).cast("bigint").alias("vw")))
        e, packed = packed_pp(s, d, v)
        return pt.partition(e, v, K, ALPHA, 0, max_rounds=32, packed=packed)[0]


@register()
def q_refine_labels(s, d):
    """PP from labels v mod 4, refined for up to 32 rounds."""
    e = materialize(edges_pp(s, d))
    v = materialize(table(s, d, "part").select(F.col("p_partkey").alias("v"), F.lit(1).cast("bigint").alias("vw")))
    return pt.refine(e, v, labels(v), RefineOptions(K, ALPHA, max_rounds=32, stale_rounds=3))[0]


@register()
def q_synthetic_social(s, d):
    return prep.synthetic(s, "social")


@register(with_sql(*propose_ctes()[:6], f"""g AS (SELECT v, greatest(0, coalesce(max(CASE WHEN c <> own AND aff > 0 THEN aff END), 0) - coalesce(max(CASE WHEN c = own THEN aff END), 0)) AS free,
    CASE WHEN max(own_role) < {THRESHOLD} THEN greatest(0, coalesce(max(CASE WHEN c <> own AND aff > 0 AND role >= {THRESHOLD} THEN aff END), 0) - coalesce(max(CASE WHEN c = own THEN aff END), 0)) ELSE 0 END AS held FROM n GROUP BY v)""",
    final="SELECT count(*) FILTER (WHERE free > 0)::BIGINT AS positive_gain, count(*) FILTER (WHERE free > held)::BIGINT AS role_blocked, coalesce(sum(free - held), 0)::BIGINT AS blocked_gain FROM g"))
def q_role_diagnostics(s, d):
    c = clusters(vertices(s, d))
    return co.role_diagnostics(gr.affinity(edges_pp(s, d), c), c, ROLE, THRESHOLD)


@register(with_sql(E, V, M, final="SELECT m.c, coalesce(sum(b.bound), 0)::BIGINT AS bound FROM m LEFT JOIN (SELECT src AS v, sum(w) AS bound FROM e GROUP BY 1) b USING (v) GROUP BY 1"))
def q_record_bounds(s, d):
    return prep.record_bounds(edges_pp(s, d), mapping(vertices(s, d))).withColumn("bound", F.col("bound").cast("bigint"))


@register(with_sql(V, H, f"ld AS (SELECT part, sum(vw) AS load FROM l JOIN v USING (v) GROUP BY 1)", final=f"SELECT sum(load)::BIGINT AS total, max(load)::BIGINT AS max_load, round(max(load) * {float(K)}::DOUBLE / sum(load), 6) AS imbalance FROM ld"))
def q_load_imbalance(s, d):
    v = vertices(s, d)
    return rounded(gr.imbalance(v, heavy_labels(v), K), "imbalance")


@register(
    with_sql(
        *ANALYZE, "z AS (SELECT *, internal + outgoing AS e FROM pp)",
        "b AS (SELECT 'vertices' AS metric, avg(vertices) AS a, min(vertices) AS lo, max(vertices) AS hi FROM z UNION ALL SELECT 'edges', avg(e), min(e), max(e) FROM z)",
        final="SELECT metric, round(a, 6) AS avg, lo::DOUBLE AS min, hi::DOUBLE AS max, round(hi / a, 6) AS imbalance, round(greatest(hi - a, a - lo) / a, 6) AS deviation, round(a * 1.05::DOUBLE, 6) AS allowed_max, hi / a <= 1.05 AS within_ratio FROM b",
    )
)
def q_balance_report(s, d):
    return rounded(gr.balance_report(gr.analyze_summary(gr.analyze_parts(edges_pp(s, d), labels(vertices(s, d)), K))), "avg", "imbalance", "deviation", "allowed_max")


@register("SELECT c::BIGINT AS clusters, n::BIGINT AS vertices, floor(least(0.5::DOUBLE, greatest(0, c - (n + 1) // 2) / c::DOUBLE) * 4294967296)::BIGINT AS threshold FROM (SELECT count(DISTINCT l_suppkey) + count(DISTINCT l_partkey) AS n FROM lineitem), (SELECT unnest(range(1, 41)) AS i), LATERAL (SELECT 1 + (n - 1) * i // 40 AS c)")
def q_mover_thresholds(s, d):
    n = sum(table(s, d, "lineitem").agg(F.countDistinct("l_suppkey"), F.countDistinct("l_partkey")).first())
    return s.createDataFrame([(c, n, scalars.mover_threshold(c, n)) for c in (1 + (n - 1) * i // 40 for i in range(1, 41))], "clusters bigint, vertices bigint, threshold bigint")


@register(with_sql(V, "t AS (SELECT sum(vw) AS total, max(vw) AS top FROM v)", final="SELECT k::INTEGER AS parts, greatest(64, (511 + k) // k)::BIGINT AS factor, greatest(32, greatest(64, (511 + k) // k) * k)::BIGINT AS cutoff, greatest(top, (total + greatest(64, (511 + k) // k) * k - 1) // (greatest(64, (511 + k) // k) * k))::BIGINT AS capacity FROM t, (SELECT unnest(range(2, 33)) AS k)"))
def q_cluster_capacities(s, d):
    total, top = vertices(s, d).agg(F.sum("vw"), F.max("vw")).first()
    rows = [(k, f, scalars.coarsest_cutoff(f, k), scalars.cluster_capacity(total, top, f, k)) for k in range(2, 33) for f in [scalars.production_factor(k)]]
    return s.createDataFrame(rows, "parts int, factor bigint, cutoff bigint, capacity bigint")


@register("WITH o AS (SELECT unnest([(0, 1), (0, 1), (1, 2), (2, 3), (4, 5), (5, 6), (5, 6), (8, 9)]) AS p UNION ALL SELECT (u, u + 1) FROM (SELECT unnest(range(10, 4095, 2)) AS u)) SELECT 0::BIGINT AS src, 0::BIGINT AS dst, 1::BIGINT AS w UNION ALL SELECT p[1]::BIGINT, p[2]::BIGINT, 1 FROM o UNION ALL SELECT p[2]::BIGINT, p[1]::BIGINT, 1 FROM o")
def q_multigraph(s, d):
    return prep.multigraph(s)[0]


@register(with_sql(R, final="SELECT src, dst, count(*) AS n FROM r GROUP BY 1, 2"))
def q_edge_list_round_trip(s, d):
    """Entries written as text and read as an edge list of sniffed format."""
    path = f"{shared_root(s)}/graph/{uuid.uuid4().hex}"
    raw(s, d).select(F.concat_ws(" ", "src", "dst").alias("line")).write.text(path)
    return files.read_edge_list(s, path).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@register(with_sql(E, V, final="SELECT src, dst, w, row_number() OVER (ORDER BY src, dst) - 1 AS ord FROM (SELECT src, dst, 1::BIGINT AS w FROM e)"))
def q_csr_round_trip(s, d):
    """PP written as a binary CSR and read again."""
    path = f"{shared_root(s)}/graph/{uuid.uuid4().hex}"
    e = materialize(edges_pp(s, d))
    files.write_csr(e, vertices(s, d), f"{path}-ptr", f"{path}-idx")
    return files.read_csr(s, f"{path}-ptr", f"{path}-idx")[0].select("src", "dst", "w", "ord")


@register(with_sql(V, L, final="SELECT v, part FROM l"))
def q_labels_round_trip(s, d):
    path = f"{shared_root(s)}/graph/{uuid.uuid4().hex}"
    files.write_partition(labels(vertices(s, d)), path)
    return files.read_partition(s, path, "binary")


@register("SELECT count(*)::BIGINT AS vertices, sum(vw)::BIGINT AS total, floor(sum(vw) * 1.03 / 4)::BIGINT AS capacity, 0::BIGINT AS bad_labels, true AS within, true AS cut_as_counted FROM (SELECT 1 AS vw FROM part)")
def q_partition_invariants(s, d):
    """What any partition of PP must keep: every vertex one label in range,
    loads within the capacity, and the cut that was counted, by its own join."""
    e = materialize(edges_pp(s, d))
    v = materialize(table(s, d, "part").select(F.col("p_partkey").alias("v"), F.lit(1).cast("bigint").alias("vw")))
    run = pt.partition_run(e, v, K, ALPHA, 0)
    own = run.labels
    cut = e.join(own.select(F.col("v").alias("src"), F.col("part").alias("a")), "src").join(own.select(F.col("v").alias("dst"), F.col("part").alias("b")), "dst")
    cut = cut.agg(F.expr("coalesce(sum(CASE WHEN a <> b THEN w END), 0) div 2").alias("cut"))
    load = v.join(own, "v", "left").groupBy("part").agg(F.sum("vw").alias("load"), F.count(F.lit(1)).alias("n"))
    bad = F.sum(F.when(F.col("part").between(0, K - 1), 0).otherwise(F.col("n")))
    row = load.agg(F.sum("n").alias("vertices"), F.sum("load").alias("total"), bad.alias("bad_labels"), F.max("load").alias("top")).crossJoin(cut)  # frames of one row
    cap = F.floor(F.col("total") * ALPHA / K)
    counted = F.col("cut") == run.stats[-1].final_cut
    return row.select("vertices", "total", cap.alias("capacity"), "bad_labels", (F.col("top") <= cap).alias("within"), counted.alias("cut_as_counted"))


@register(with_sql(E, V, f"k AS (SELECT (sum(w) // 2)::BIGINT AS x FROM e WHERE {PSEUDO.replace('c *', 'src *')} <> {PSEUDO.replace('c *', 'dst *')})", final="SELECT sum(vw)::BIGINT AS least_weight, sum(vw)::BIGINT AS greatest_weight, true AS falls, true AS onto FROM v, k GROUP BY x"))
def q_coarsen_invariants(s, d):
    """What any hierarchy must keep: the weight of each level, fewer vertices
    level by level, and maps onto the next level's ids."""
    e, v = materialize(edges_pp(s, d)), materialize(vertices(s, d))
    h = pt.coarsen(e, v, CoarsenOptions(K, SEED, cluster_size_factor=16, strict_verify=True))
    weights = [x.agg(F.sum("vw")).first()[0] for _, x in h.graphs]
    sizes = [x.count() for _, x in h.graphs]
    onto = [m.agg(F.min("c"), F.max("c"), F.countDistinct("c"), F.countDistinct("v")).first() for m in h.maps]
    fits = all(tuple(o) == (0, n - 1, n, m) for o, m, n in zip(onto, sizes, sizes[1:], strict=False))
    falls = len(sizes) > 1 and all(a > b for a, b in zip(sizes, sizes[1:], strict=False))
    return s.createDataFrame([(min(weights), max(weights), falls, fits)], "least_weight bigint, greatest_weight bigint, falls boolean, onto boolean")


@register(with_sql(E, "v AS (SELECT p_partkey AS v, 1::BIGINT AS vw FROM part)", L, final="SELECT (sum(w) // 2)::BIGINT AS first_cut, true AS no_worse, true AS within FROM e JOIN l a ON a.v = e.src JOIN l b ON b.v = e.dst WHERE a.part <> b.part"))
def q_refine_invariants(s, d):
    """PP from labels v mod 4: the cut it starts with, that it does not rise, and the capacity."""
    e = materialize(edges_pp(s, d))
    v = materialize(table(s, d, "part").select(F.col("p_partkey").alias("v"), F.lit(1).cast("bigint").alias("vw")))
    out, stats = pt.refine(e, v, labels(v), RefineOptions(K, ALPHA))
    row = gr.verify(e, v, out, K, ALPHA).first()
    return s.createDataFrame([(stats.initial_cut, row["cut"] == stats.final_cut <= stats.initial_cut, bool(row["capacity_ok"]))], "first_cut bigint, no_worse boolean, within boolean")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
