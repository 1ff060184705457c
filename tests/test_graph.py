"""Golden fixtures and properties of the graph engine."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutweave import model
from cutweave.functions import scalars
from cutweave.model import CoarsenOptions, Hierarchy, RefineOptions
from cutweave.operators import coarsen as co
from cutweave.operators import graph as gr
from cutweave.operators import prep, spectral
from cutweave.plans import partition as pt
from cutweave.sources import files


def graph(spark, edges, weights):
    both = [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges if a != b]
    return spark.createDataFrame(both, "src bigint, dst bigint, w bigint"), spark.createDataFrame(list(enumerate(weights)), "v bigint, vw bigint")


def labels_of(spark, parts):
    return spark.createDataFrame(list(enumerate(parts)), "v bigint, part int")


def test_mix32_and_capacities(spark):
    want = {0: 0, 1: 1753845952, 2: 3507691905, 42: 388445122, 2**32 - 1: 1734902346}
    assert {x: scalars.mix32(x) for x in want} == want
    df = scalars.with_mix32(spark.createDataFrame([(x,) for x in want], "x bigint"), F.col("x"), "h")
    assert {r["x"]: r["h"] for r in df.collect()} == want
    for total, k, alpha, cap in ((6, 2, 1.10, 3), (100, 4, 1.03, 25), (1000, 4, 1.03, 257), (6, 2, 1.34, 4)):
        assert scalars.partition_capacity(total, k, alpha) == cap
    for total, k, alpha in ((4, 3, 1.03), (100, 0, 1.03), (100, 33, 1.03), (100, 4, 0.99), (100, 4, math.nan)):
        with pytest.raises(ValueError):
            scalars.partition_capacity(total, k, alpha)
    with pytest.raises(OverflowError):
        scalars.partition_capacity(2**64 - 1, 2, 4.0)
    rng = random.Random(1)
    for _ in range(500):
        rec = rng.randrange(2**20), rng.randrange(2**20), rng.randrange(2**23)
        assert scalars.record_unpack(scalars.record_pack(*rec, 20), 20) == rec


def test_projection_keeps_the_cut(spark):
    fine = graph(spark, [(0, 1, 1), (1, 2, 5), (2, 3, 10)], [1, 1, 1, 1])
    coarse = graph(spark, [(0, 1, 5)], [2, 2])
    mapping = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "v bigint, c bigint")
    assert gr.contract_edges(fine[0], mapping).orderBy("src").collect() == coarse[0].orderBy("src").collect()
    own = gr.project(mapping, labels_of(spark, [0, 1]))
    assert gr.cut_value(fine[0], own) == gr.cut_value(coarse[0], labels_of(spark, [0, 1])) == 5
    out, stats = pt.uncoarsen(Hierarchy([fine, coarse], [mapping]), labels_of(spark, [0, 1]), RefineOptions(2, 1.10, 2))
    assert gr.cut_value(fine[0], out) <= 5 and gr.load_list(fine[1], out, 2) == [2, 2]
    with pytest.raises(ValueError):
        pt.refine(*fine, labels_of(spark, [0, 0, 0, 1]), RefineOptions(2, 1.10, 1))


def test_exchange_and_repair(spark):
    g = graph(spark, [(0, 1, 1), (0, 3, 4), (1, 2, 4), (1, 4, 100), (2, 3, 1), (3, 5, 100)], [1] * 6)
    out, _ = pt.refine(*g, labels_of(spark, [0, 0, 1, 1, 0, 1]), RefineOptions(2, 1.03, 8))
    assert gr.cut_value(g[0], out) == 2 and gr.load_list(g[1], out, 2) == [3, 3]
    g = graph(spark, [(0, 1, 1), (0, 4, 4), (1, 2, 100), (4, 5, 100)], [1] * 8)
    out, stats = pt.refine(*g, labels_of(spark, [0, 0, 0, 0, 1, 1, 1, 1]), RefineOptions(2, 1.03, 8))
    assert gr.cut_value(g[0], out) == 1 and gr.load_list(g[1], out, 2) == [4, 4] and stats.rebalance_iterations >= 1


def test_isolated_packing(spark):
    e, v = graph(spark, [(0, 1, 3)], [7, 7, 1, 4, 4, 1, 1, 8, 1, 3, 6, 2])
    cap = scalars.cluster_capacity(45, 8, 2, 2)
    assert cap == 12
    reps = {r["v"]: r["rep"] for r in co.pack_isolated(e, v, cap).collect()}
    assert 0 not in reps and 1 not in reps
    mapping, count, _ = pt.aggregate(e, v, 2, 0, 0, 2, True)
    assert count == 7 and [r["c"] for r in mapping.orderBy("v").collect()] == [0, 1, 2, 2, 2, 2, 2, 3, 4, 4, 5, 6]


def test_spectral_bisection(spark):
    clique = [(a + k, b + k, 3) for k in (0, 4) for a in range(4) for b in range(a)]
    e, v = graph(spark, clique, [2] * 8)
    one, two = (pt.initial_partition(e, v, 2, 1.03) for _ in range(2))
    assert gr.cut_value(e, one) == 0 and sorted(one.collect()) == sorted(two.collect())
    none = np.zeros(0, dtype=np.int64)
    got = spectral.bisect_arrays(12, none, none, none, np.ones(12, dtype=np.int64), 3, 4, 0)
    assert np.bincount(got).tolist() == [4, 4, 4]
    got = spectral.bisect_arrays(256, none, none, none, np.ones(256, dtype=np.int64), 32, 8, 0)
    assert np.bincount(got).tolist() == [8] * 32
    with pytest.raises(RuntimeError):
        spectral.bisect_arrays(3, none, none, none, np.full(3, 2), 2, 3, 0)
    with pytest.raises(ValueError):
        pt.initial_partition(e, graph(spark, [], [1000] + [1] * 256)[1], 3, 1.10)


def test_large_graphs_split_by_joins(spark, monkeypatch):
    clique = [(a + k, b + k, 3) for k in (0, 4) for a in range(4) for b in range(a)]
    e, v = graph(spark, clique, [2] * 8)
    one_task = pt.initial_partition(e, v, 2, 1.03)
    monkeypatch.setattr(pt, "ONE_TASK", 0)
    got = pt.initial_partition(e, v, 2, 1.03)
    assert gr.cut_value(e, got) == 0 and gr.load_list(v, got, 2) == [8, 8]
    assert sorted(tuple(r) for r in got.select("v", "part").collect()) == sorted(tuple(r) for r in one_task.collect())


def test_levels_keep_weight_and_cut(spark):
    e = prep.synthetic(spark, "circuit", 256)
    v = spark.range(256).selectExpr("id AS v", "1L AS vw")
    h = pt.coarsen(e, v, CoarsenOptions(2, 3, max_levels=2, cluster_size_factor=8, strict_verify=True))
    assert len(h.graphs) > 1 and all(g[1].agg(F.sum("vw")).first()[0] == 256 for g in h.graphs)
    assert h.graphs[1][1].count() <= 0.75 * 256


def test_validation(spark):
    e, v = graph(spark, [(0, 1, 1), (1, 2, 1), (2, 2, 1)], [1, 1, 1])
    prep.validate(e, v)
    for bad in ([(0, 3, 1)], [(0, -1, 1)]):
        with pytest.raises(ValueError):
            prep.validate(graph(spark, bad, [1])[0], v)
    with pytest.raises(ValueError):
        prep.validate(e, v, allow_loops=False)
    with pytest.raises(ValueError):
        prep.validate(e.filter("src <> 0"), v)
    with pytest.raises(ValueError):
        prep.validate(e, graph(spark, [], [1, 0, 1])[1])


def test_files_round_trip(spark, tmp_path):
    e, v = graph(spark, [(0, 1, 1), (0, 2, 1), (2, 4, 1)], [1] * 5)
    ptr, idx = str(tmp_path / "a_indptr.bin"), str(tmp_path / "a_indices.bin")
    files.write_csr(e, v, ptr, idx)
    back, vertices = files.read_csr(spark, ptr, idx)
    assert sorted(back.select("src", "dst", "w").collect()) == sorted(e.collect()) and vertices.count() == 5
    files.write_metis(e, v, str(tmp_path / "g.metis"))
    assert (tmp_path / "g.metis").read_text() == "5 3\n2 3\n1\n1 5\n\n3\n"
    own = labels_of(spark, [0, 1, 1, 0, 2])
    for form in ("binary", "text"):
        files.write_partition(own, str(tmp_path / form), form)
        assert sorted(files.read_partition(spark, str(tmp_path / form), form).collect()) == sorted(own.collect())
    (tmp_path / "snap.txt").write_text("# c\n10 20\n20 10 5\n30 30\n\n")
    edges, ids = prep.remap_ids(files.read_edge_list(spark, str(tmp_path / "snap.txt")))
    assert [(r["src"], r["dst"]) for r in edges.orderBy("ord").collect()] == [(0, 1), (1, 0)] and ids.count() == 3
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix\n% c\n3 3 2\n1 2\n3 1 0.5\n")
    assert [(r["src"], r["dst"]) for r in files.read_edge_list(spark, str(tmp_path / "m.mtx")).orderBy("ord").collect()] == [(0, 1), (2, 0)]
    for text in ("1 -2\n", "7\n", "%%MatrixMarket\n2 2 1\n1 3\n"):
        (tmp_path / "bad.txt").write_text(text)
        with pytest.raises(ValueError):
            files.read_edge_list(spark, str(tmp_path / "bad.txt"))
    files.write_hierarchy(Hierarchy([(e, v)], [], "max_levels"), str(tmp_path / "h"))
    assert files.read_hierarchy(spark, str(tmp_path / "h")).stop_reason == "max_levels"
    lines = spark.createDataFrame([(1, "cut=5 ratio=0.25 done")], "ord int, line string")
    assert [(r["key"], r["value"]) for r in files.metric_lines(lines).collect()] == [("cut", "5"), ("ratio", "0.25")]


def test_generators(spark):
    got = prep.random_edges(spark, 50, 300, 1).collect()
    assert len({(r["src"], r["dst"]) for r in got}) == 300 and all(r["src"] != r["dst"] and 0 <= r["value"] < 1 for r in got)
    assert prep.random_edges(spark, 5, 25, 1, loops=True).count() == 25
    for kind in ("social", "circuit", "disconnected"):
        e = prep.synthetic(spark, kind, 64)
        assert prep.reverse_violations(e).isEmpty() and prep.without_loops(e).count() == e.count()
    assert e.count() == 2 * (64 - 8)


def test_registered_partitions_refine_for_32_rounds(spark, sf_dir, monkeypatch):
    from cutweave.plans import queries

    seen = []
    monkeypatch.setattr(pt, "refine", lambda e, v, labels, options=None: (seen.append(options), (labels, None))[1])
    queries.q_refine_labels(spark, sf_dir)
    monkeypatch.setattr(pt, "coarsen", lambda e, v, o: Hierarchy([(e, v)], []))
    monkeypatch.setattr(pt, "initial_partition", lambda e, v, *a: v.withColumn("part", F.lit(0)))
    monkeypatch.setattr(pt, "uncoarsen", lambda h, labels, options=None: (seen.append(options), (labels, []))[1])
    queries.q_partition_pipeline(spark, sf_dir)
    assert [(o.max_rounds, o.stale_rounds) for o in seen] == [(32, 3)] * 2


def same_as_sql(spark, sf_dir, *names):
    import duckdb

    from cutweave.plans import queries

    db, out = duckdb.connect(), []
    for name in ("lineitem", "part", "supplier", "customer"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name in names:
        got = queries.queries()[name](spark, sf_dir)
        want = db.execute(queries.oracle_sql()[name])
        order = [[c[0] for c in want.description].index(c) for c in got.columns]
        out.append(sorted(tuple(r) for r in got.collect()))
        assert out[-1] == sorted(tuple(r[i] for i in order) for r in want.fetchall()), name
    return out


def test_graph_queries_on_whole_tables(spark, sf_dir):
    degrees, alone, packed, one_way = same_as_sql(spark, sf_dir, "degree", "zero_degree", "isolated_packing", "reverse_violations")
    assert len(degrees) == 350 and all(n for v, n in degrees if v < 200)
    assert len(alone) == len([v for v, n in degrees if not n]) == 150 and 0 < len(packed) <= len(alone) and one_way


def test_merge_budget_grows_with_the_graph(spark, sf_dir):
    (derived,) = same_as_sql(spark, sf_dir.replace("sf0.001", "sf0.01"), "merge_budget")
    assert len(derived) > 40


def test_registered_synthetic_graph_has_the_suites_size(spark, sf_dir):
    from cutweave.plans import queries

    assert queries.q_synthetic_social(spark, sf_dir).agg(F.countDistinct("src")).first()[0] == 16384


def hub_graph(spark, w=1):
    """A vertex linked twice to each of 1..257, these in a path, and 258 alone."""
    edges = [(0, v, w) for v in range(1, 258) for _ in range(2)] + [(v, v + 1, w) for v in range(1, 257)]
    return graph(spark, edges, [7] * 259)


def python_cut(edges, parts):
    return sum(w for a, b, w in edges if parts[a] != parts[b]) // 2


def test_hubs_split_alike_each_time(spark):
    e, v = hub_graph(spark)
    for k in (2, 3, 4, 8):
        one, two = (pt.initial_partition(e, v, k, 1.03) for _ in range(2))
        assert gr.labels_digest(one) == gr.labels_digest(two)
        assert max(gr.load_list(v, one, k)) <= scalars.partition_capacity(7 * 259, k, 1.03)


def test_no_rounds_change_nothing(spark):
    for w in (1, 2**40):
        e, v = hub_graph(spark, w)
        rows = [tuple(r) for r in e.collect()]
        for parts in ([x % 4 for x in range(259)], [min(3, x // 65) for x in range(259)]):
            own = labels_of(spark, parts)
            out, stats = pt.refine(e, v, own, RefineOptions(4, 1.10, 0))
            assert sorted(out.collect()) == sorted(own.collect()) and stats.rounds == 0
            assert stats.final_cut == stats.initial_cut == python_cut(rows, parts)


def test_dense_contraction_adds_by_key(spark):
    rows = [(a, b, 3) for a in range(34) for b in range(34) for _ in range(2)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, w bigint")
    for g in (7, 1):
        want = {}
        for a, b, w in rows:
            if a % g != b % g:
                want[(a % g, b % g)] = want.get((a % g, b % g), 0) + w
        mapping = spark.range(35).selectExpr("id AS v", f"id % {g} AS c")
        assert {(r["src"], r["dst"]): r["w"] for r in gr.contract_edges(e, mapping).collect()} == want
        assert sum(r["bound"] for r in prep.record_bounds(e, mapping).collect()) == sum(w for _, _, w in rows)


def test_multigraphs_and_matchings_coarsen(spark):
    e, v = prep.multigraph(spark)
    assert prep.reverse_violations(e).isEmpty() and e.filter("src = 7").isEmpty()
    mapping, count, cap = pt.aggregate(e, v, 4, 0, 0, 256, False)
    assert 0.45 <= count / 4096 <= 0.60
    pt.check_level(e, v, mapping, gr.contract_edges(e, mapping), gr.contract_vertices(v, mapping), cap)
    pairs = spark.range(8).selectExpr("id AS src", "id ^ 1 AS dst", "1L AS w")
    h = pt.coarsen(pairs, spark.range(8).selectExpr("id AS v", "1L AS vw"), CoarsenOptions(4))
    assert len(h.graphs) == 1 and h.stop_reason == "capacity_floor"


def test_clusters_do_not_depend_on_the_width_of_weights(spark):
    ring = [(x, (x + 1) % 1024) for x in range(1024)] + [(0, x) for x in range(1, 129)]
    maps = []
    for w in (1_000_000, 2**40):
        e, v = graph(spark, [(a, b, w) for a, b in ring] + [(0, 0, w)], [1] * 1024)
        maps.append(sorted(tuple(r) for r in pt.aggregate(e, v, 4, 0, 0, 64, True)[0].collect()))
    assert maps[0] == maps[1]


def test_stress_graph_is_refined_within_the_capacity(spark):
    n, k = 384, 4
    half = [((x, (x + d) % n), w) for x in range(n) for d, w in ((1, 3), (17, 11), (17, 7))] + [((x, x), 13) for x in range(n)]
    rows = [(a, b, w) for (a, b), w in half] + [(b, a, w) for (a, b), w in half]
    e = spark.createDataFrame(rows[::-1], "src bigint, dst bigint, w bigint")
    v = spark.range(n).selectExpr("id AS v", f"1 + (id div {k}) % 3 AS vw")
    out, stats = pt.refine(e, v, labels_of(spark, [x % k for x in range(n)]), RefineOptions(k, 1.03, 4))
    assert stats.initial_cut == 8064 >= stats.final_cut
    assert max(gr.load_list(v, out, k)) <= scalars.partition_capacity(sum(1 + (x // k) % 3 for x in range(n)), k, 1.03)


def test_whole_partitions_are_repeatable_and_verified(spark):
    from cutweave.plans import commands

    (row,) = commands.suite(spark, 64, ("circuit",), (2,), 2, max_rounds=2)
    assert row["max_load"] <= row["capacity"] == 32
    e, v = graph(spark, [(a + k, b + k, 3) for k in (0, 4) for a in range(4) for b in range(a)], [1] * 8)
    got = commands.compare(e, v, {"even": lambda e, v, k: v.selectExpr("v", "cast(v % 2 AS int) AS part"), "halves": lambda e, v, k: v.selectExpr("v", "cast(v div 4 AS int) AS part")}, (2,), repeats=2)
    assert [(s["method"], s["cut_median"], s["runs"]) for s in got["summary"]] == [("even", 24.0, 2), ("halves", 0.0, 2)] and len(got["verified"]) == 2


def test_commands_read_and_write_files(spark, tmp_path):
    from cutweave.plans import commands
    from cutweave.sources import dump

    e, v = graph(spark, [(a + k, b + k, 1) for k in (0, 4) for a in range(4) for b in range(a)] + [(0, 4, 1)], [1] * 8)
    ptr, idx, out = (str(tmp_path / x) for x in ("indptr", "indices", "labels"))
    files.write_csr(e, v, ptr, idx)
    got = commands.partition_files(spark, ptr, idx, 2, out, verify=True)
    assert got["cut"] == 1 and got["max_load"] == 4 and {"coarsen_seconds", "uncoarsen_seconds"} <= set(got)
    assert sorted(np.fromfile(out, dtype="<i4").tolist()) == [0, 0, 0, 0, 1, 1, 1, 1]
    line = files.metric_lines(spark.createDataFrame([(1, files.metric_text(got))], "ord int, line string"))
    assert {r["key"]: r["value"] for r in line.collect()}["cut"] == "1"
    assert commands.coarsen_files(spark, ptr, idx, 2, str(tmp_path / "h"))["levels"] == 1
    assert dump.read_dump(spark, str(tmp_path / "h")).graphs[0][0].count() == e.count()
    with pytest.raises(OverflowError):
        files.read_csr(spark, ptr, idx, limit=20)
    with pytest.raises(OverflowError):
        prep.checked_total(v, "vw", 7)
    files.write_json({"a": 1}, spark, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text() == '{\n "a": 1\n}'
    made = prep.random_edges(spark, 20, 60, 3)
    files.write_graph_files(made, spark.range(20).selectExpr("id AS v", "1L AS vw"), str(tmp_path / "g"))
    back = files.read_csr(spark, str(tmp_path / "g_indptr.bin"), str(tmp_path / "g_indices.bin"), str(tmp_path / "g_values.bin"))[0]
    assert sorted(back.select("src", "dst", "value").collect()) == sorted(made.select("src", "dst", "value").collect())
    _, ids = prep.remap_ids(spark.createDataFrame([(0, 50, 40), (1, 40, 90)], "ord bigint, src bigint, dst bigint"))
    files.write_vertex_ids(ids, str(tmp_path / "ids"))
    assert np.fromfile(str(tmp_path / "ids"), dtype="<i8").tolist() == [50, 40, 90]
    assert "within_ratio=" in gr.report_text(gr.balance_report(gr.analyze_summary(gr.analyze_parts(e, v.selectExpr("v", "cast(v div 4 AS int) AS part"), 2))))


def test_packed_graphs_give_what_joins_give(spark, sf_dir, monkeypatch):
    from cutweave.operators import blocks as bl
    from cutweave.plans import queries

    e, v = model.materialize(queries.edges_pp(spark, sf_dir)), model.materialize(queries.vertices(spark, sf_dir))
    e = model.materialize(e.unionByName(e.filter("src % 7 = 0 AND dst % 7 = 0")).unionByName(spark.createDataFrame([(5, 5, 3)], e.schema)))
    v = model.materialize(v.unionByName(spark.range(200, 230).selectExpr("id AS v", "1 + id % 3 AS vw")))
    by_joins, count, cap = pt.aggregate(e, v, 4, 3, 0, 8, True)
    with monkeypatch.context() as m:
        m.setattr(bl, "pack", lambda *a: None)
        refined, stats = pt.refine(e, v, v.selectExpr("v", "cast(v % 4 AS int) AS part"), RefineOptions(4, 1.25, 3))
    for block, local in ((1 << 19, 1 << 20), (500, 0)):  # held by the driver, and in many blocks
        monkeypatch.setattr(bl, "BLOCK", block)
        monkeypatch.setattr(bl, "LOCAL", local)
        g = bl.pack(e, v)
        assert (g.local is None) == (not local) and sorted(map(tuple, g.edges().collect())) == sorted(map(tuple, e.groupBy("src", "dst").agg(F.sum("w")).collect()))
        mapping, n, most = pt.aggregate_packed(g, 4, 3, 0, 8, True)
        assert (n, most) == (count, cap) and sorted(map(tuple, by_joins.collect())) == list(enumerate(mapping.tolist()))
        coarse = bl.contract(g, mapping, n)
        assert sorted(map(tuple, coarse.edges().collect())) == sorted(map(tuple, gr.contract_edges(e, by_joins).collect()))
        out, same = pt.refine_packed(g, np.arange(g.n) % 4, RefineOptions(4, 1.25, 3))
        assert same == stats and sorted(map(tuple, refined.collect())) == list(enumerate(out.tolist()))
    for bad in (e.selectExpr("src + 100 AS src", "dst", "w"), e.selectExpr("src", "dst", "w - 1 AS w"), e.limit(0)):
        assert bl.pack(bad, v) is None
    assert bl.pack(e, v.filter("v <> 3")) is None


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("other", "other")


def test_partition_invariants_is_not_a_job_a_step(spark, sf_dir):
    from cutweave.plans import queries

    (row,), jobs = jobs_of(spark, "invariants", lambda: queries.q_partition_invariants(spark, sf_dir).collect())
    assert (row["vertices"], row["bad_labels"], row["within"], row["cut_as_counted"]) == (200, 0, True, True) and jobs < 100


def test_partition_pipeline_is_not_a_job_a_step(spark, sf_dir):
    from cutweave.plans import queries

    rows, jobs = jobs_of(spark, "pipeline", lambda: queries.q_partition_pipeline(spark, sf_dir).collect())
    loads = [sum(r["part"] == p for r in rows) for p in range(4)]
    assert sorted(r["v"] for r in rows) == list(range(200)) and sum(loads) == 200 and max(loads) <= 51 and jobs < 100


def test_coarsen_levels_is_not_a_job_a_step(spark, sf_dir):
    from cutweave.plans import queries

    rows, jobs = jobs_of(spark, "levels", lambda: queries.q_coarsen_levels(spark, sf_dir.replace("sf0.001", "sf0.01")).collect())
    rows = sorted(rows)
    assert len(rows) > 2 and len({r["weight"] for r in rows}) == 1 and rows[0]["vertices"] == 2000 and rows[0]["entries"] == 231458
    assert all(a["vertices"] > b["vertices"] for a, b in zip(rows, rows[1:], strict=False)) and jobs < 60


def test_graphs_packed_from_groups_are_those_of_their_pairs(spark, sf_dir, monkeypatch):
    from cutweave.operators import blocks as bl
    from cutweave.plans import queries

    rows = [(1, 0), (1, 1), (1, 1), (2, 1), (2, 0), (2, 2), (3, 3), (4, 3), (4, 3), (None, 0), (None, 2), (5, None), (5, 2), (6, 4), (6, 2)]
    own = spark.createDataFrame(rows, "grp bigint, v bigint")
    lines = queries.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS grp", "l_partkey AS v")
    for members, v in ((own, spark.range(6).selectExpr("id AS v", "1 + id % 3 AS vw")), (lines, queries.vertices(spark, sf_dir))):
        a, b = members.selectExpr("grp", "v AS src"), members.selectExpr("grp", "v AS dst")
        want = sorted(map(tuple, a.join(b, "grp").filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1))).collect()))
        for block, local in ((1 << 19, 1 << 20), (3, 0)):
            with monkeypatch.context() as m:
                m.setattr(bl, "BLOCK", block if members is own else max(block, 500))
                m.setattr(bl, "LOCAL", local)
                g = bl.pack_groups(members, v)
                assert sorted(map(tuple, g.edges().collect())) == want and g.entries == len(want)
                assert sorted(map(tuple, g.vertices().collect())) == sorted(map(tuple, v.collect()))
        assert bl.pack_groups(members, v.filter("v < 4")) is None and bl.pack_groups(members.limit(0), v) is None
    assert bl.pack_groups(own.filter("grp = 4"), spark.range(6).selectExpr("id AS v", "1L AS vw")) is None


def test_pairs_of_lines_are_not_stored_one_by_one(spark, sf_dir, monkeypatch):
    from cutweave.plans import queries

    stored = []
    monkeypatch.setattr(queries, "edges_pp", lambda *a, f=queries.edges_pp: stored.append(f(*a)) or stored[-1])
    for module in (queries, pt):
        monkeypatch.setattr(module, "materialize", lambda df, *a, f=module.materialize, **b: f(df, *a, **b) if set(df.columns) != {"src", "dst", "w"} else pytest.fail("entries were stored"))
    assert queries.q_coarsen_levels(spark, sf_dir).count() and queries.q_partition_pipeline(spark, sf_dir).count() == 200
