"""The multilevel partitioner: coarsen, split, project and refine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutweave.functions import scalars
from cutweave.model import CoarsenOptions, Hierarchy, Lazy, RefineOptions, RefineStats, Stages, materialize, scratch
from cutweave.operators import blocks as bl
from cutweave.operators import coarsen as co
from cutweave.operators import graph as gr
from cutweave.operators import prep
from cutweave.operators import refine as rf
from cutweave.operators import spectral as sp

#: Rounds of clustering a level, and the share of vertices at which they stop.
ROUNDS, ENOUGH = 4, 0.60
#: Vertices and directed entries together up to which the coarsest graph is split in one task.
ONE_TASK = 4_000_000


def aggregate(edges: DataFrame, vertices: DataFrame, parts: int, seed: int, level: int, factor: int, pack: bool) -> tuple[DataFrame, int, int]:
    """Map (v, c) of one level, its number of clusters, and the capacity."""
    n, total, top = vertices.agg(F.count(F.lit(1)), F.sum("vw"), F.max("vw")).first()
    cap = scalars.cluster_capacity(total, top, factor, parts)
    clusters, count = vertices.select("v", F.col("v").alias("c")), n
    for k in range(ROUNDS):
        if count <= ENOUGH * n:
            break
        role, tie = scalars.salts(seed, level, k)
        moves = co.sclp_round(edges, vertices, clusters, cap, role, scalars.mover_threshold(count, n), tie)
        clusters = materialize(co.move(clusters, moves))
        count = clusters.select("c").distinct().count()
    if pack:
        clusters = materialize(co.move(clusters, co.pack_isolated(edges, vertices, cap), "rep"))
        count = clusters.select("c").distinct().count()
    if count > ENOUGH * n:
        role, tie = scalars.salts(seed, level, ROUNDS)
        found = co.propose(gr.affinity(edges, clusters), clusters, role, 0, tie, filter_roles=False)
        pairs = co.two_hop_pairs(co.singleton_favorites(found, vertices, clusters), cap, n)
        budget = max(0, count - -(-n // 2))
        clusters = materialize(co.move(clusters, co.merge_budget(pairs, clusters, budget, n)))
    mapping = materialize(prep.compact(clusters))
    return mapping, mapping.select("c").distinct().count(), cap


def aggregate_packed(g: bl.Blocks, parts: int, seed: int, level: int, factor: int, pack: bool) -> tuple[np.ndarray, int, int]:
    """As :func:`aggregate`, of a packed graph; the map is an array by vertex."""
    cap = scalars.cluster_capacity(int(g.vw.sum()), int(g.vw.max()), factor, parts)
    clusters, count = np.arange(g.n), g.n
    for k in range(ROUNDS):
        if count <= ENOUGH * g.n:
            break
        role, tie = scalars.salts(seed, level, k)
        v, target = bl.admit(bl.propose(g, clusters, role, scalars.mover_threshold(count, g.n), tie), g.vw, clusters, cap)
        clusters[v] = target
        count = len(np.unique(clusters))
    if pack:
        clusters = bl.pack_isolated(g, clusters, cap)
        count = len(np.unique(clusters))
    if count > ENOUGH * g.n:
        role, tie = scalars.salts(seed, level, ROUNDS)
        found = bl.propose(g, clusters, role, 0, tie, filter_roles=False)
        clusters = bl.two_hop(found, g.vw, clusters, cap, max(0, count - -(-g.n // 2)))
    ids, mapping = np.unique(clusters, return_inverse=True)
    return mapping, len(ids), cap


def coarsen(edges: DataFrame, vertices: DataFrame, options: CoarsenOptions | None = None, packed: bl.Blocks | None = None) -> Hierarchy:
    """Levels until the graph is small, a level gains too little, or there
    are enough; the level that gains too little is left out. ``packed``: the
    same graph, where it is packed already."""
    o = options or CoarsenOptions()
    if not scalars.MIN_PARTS <= o.parts <= scalars.MAX_PARTS or o.cluster_size_factor < 2 or not 0 < o.stop_contraction_ratio <= 1 or not 0 < o.max_levels <= 200:
        raise ValueError("parts, cluster size factor, stop ratio or levels out of range")
    if (g := packed or bl.pack(edges, vertices)) is not None:
        return _coarsen_packed(g, edges, vertices, o)
    out = Hierarchy([(edges, vertices)], [], "max_levels")
    cutoff = scalars.coarsest_cutoff(o.cluster_size_factor, o.parts)
    for level in range(o.max_levels):
        edges, vertices = out.graphs[-1]
        n = vertices.count()
        if n <= cutoff:
            out.stop_reason = "capacity_floor"
            break
        mapping, count, cap = aggregate(edges, vertices, o.parts, o.seed + level, level, o.cluster_size_factor, o.pack_isolated)
        if count >= n or count / n > o.stop_contraction_ratio:
            out.stop_reason = "insufficient_contraction"
            break
        coarse = materialize(gr.contract_edges(edges, mapping)), materialize(gr.contract_vertices(vertices, mapping))
        if o.strict_verify:
            check_level(edges, vertices, mapping, *coarse, cap)
        out.graphs.append(coarse)
        out.maps.append(mapping)
    return out


def _coarsen_packed(g: bl.Blocks, edges: DataFrame, vertices: DataFrame, o: CoarsenOptions) -> Hierarchy:
    packed, maps, reason = [g], [], "max_levels"
    cutoff = scalars.coarsest_cutoff(o.cluster_size_factor, o.parts)
    for level in range(o.max_levels):
        g = packed[-1]
        if g.n <= cutoff:
            reason = "capacity_floor"
            break
        mapping, count, cap = aggregate_packed(g, o.parts, o.seed + level, level, o.cluster_size_factor, o.pack_isolated)
        if count >= g.n or count / g.n > o.stop_contraction_ratio:
            reason = "insufficient_contraction"
            break
        coarse = bl.contract(g, mapping, count)
        if o.strict_verify:
            check_packed(g, mapping, coarse, cap)
        packed.append(coarse)
        maps.append(mapping)
    graphs = [lambda: (edges, vertices)] + [lambda g=g: (g.edges(), g.vertices()) for g in packed[1:]]
    frames = [lambda m=m: bl.table(edges.sparkSession, v=np.arange(len(m)), c=m) for m in maps]
    return Hierarchy(Lazy(graphs), Lazy(frames), reason, packed, maps)


def check_packed(fine: bl.Blocks, mapping: np.ndarray, coarse: bl.Blocks, cap: int) -> None:
    """As :func:`check_level`."""
    label = (np.arange(coarse.n) * 2654435761 + 17) % 23
    cuts = bl.directed_cut(fine, label[mapping]) // 2, bl.directed_cut(coarse, label) // 2
    weight = np.zeros(coarse.n, np.int64)
    np.add.at(weight, mapping, fine.vw)
    if (weight != coarse.vw).any() or (coarse.vw > cap).any() or cuts[0] != cuts[1]:
        raise RuntimeError(f"a contraction broke its invariants: cuts {cuts}, greatest weight {coarse.vw.max()} of {cap}")


def check_level(edges: DataFrame, vertices: DataFrame, mapping: DataFrame, coarse_edges: DataFrame, coarse_vertices: DataFrame, cap: int) -> None:
    row = gr.contraction_faults(edges, vertices, mapping, coarse_edges, coarse_vertices, cap).first()
    if row["wrong_weights"] or row["over_capacity"] or row["fine_weight"] != row["coarse_weight"] or row["fine_cut"] != row["coarse_cut"]:
        raise RuntimeError(f"a contraction broke its invariants: {row}")


def initial_partition(edges: DataFrame, vertices: DataFrame, parts: int, ratio: float, seed: int = 0) -> DataFrame:
    """(v, part) by recursive spectral bisection. A graph of up to ONE_TASK
    vertices and entries is split in one task, which needs some 100 bytes for
    each; a larger one by joins and aggregations, all groups of a depth at
    once. Its sums run in another order, so coordinates may differ in their
    last bits there."""
    n, total = vertices.agg(F.count(F.lit(1)), F.sum("vw")).first()
    cap = scalars.partition_capacity(total or 0, parts, ratio)
    if n < parts or vertices.filter(F.col("vw") > cap).count():
        raise ValueError("a vertex is heavier than a part, or there are too few")
    if n + edges.count() > ONE_TASK:
        return _initial_large(edges, vertices, parts, cap, seed)

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        e, v = pdf[pdf["dst"] >= 0], pdf[pdf["dst"] < 0].sort_values("src")
        labels = sp.bisect_arrays(n, e["src"].to_numpy(), e["dst"].to_numpy(), e["w"].to_numpy(), v["w"].to_numpy(), parts, cap, seed)
        return pd.DataFrame({"v": np.arange(n), "part": labels.astype("int32")})

    rows = edges.select("src", "dst", "w").unionByName(vertices.select(F.col("v").alias("src"), F.lit(-1).cast("bigint").alias("dst"), F.col("vw").alias("w")))
    return materialize(rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(split, "v bigint, part int"))


def _initial_large(edges: DataFrame, vertices: DataFrame, parts: int, cap: int, seed: int) -> DataFrame:
    total = vertices.agg(F.sum("vw")).first()[0]
    groups = vertices.select("v", F.lit(0).alias("grp"))
    tasks = {0: (parts, total)}
    while any(k > 1 for k, _ in tasks.values()):
        own = materialize(groups.filter(F.col("grp").isin([g for g, (k, _) in tasks.items() if k > 1])))
        inner = materialize(sp.within(edges, own).select("src", "dst", "w"))
        x = sp.normalize(materialize(sp.start(edges, own, seed)))
        for _ in range(sp.STEPS):  # stored each time: a step reads its input several times over
            x = sp.normalize(materialize(sp.spread(inner, x)))
        ranked = materialize(sp.prefix_weights(x, vertices))
        cuts, after = [], {}
        for g, (k, weight) in tasks.items():
            if k == 1:
                after[g] = (k, weight)
                continue
            left, target, least, most = sp.split_limits(weight, k, cap)
            rows = ranked.filter(F.col("grp") == g)
            n = rows.count()
            first = rows.filter(F.col("prefix") >= target).agg(F.min("pos")).first()[0] or n
            near = {r["pos"]: r["prefix"] for r in rows.filter(F.col("pos").between(min(first, n - k + left) - k, max(first, left) + k)).collect()}  # a few rows about the border
            at = max(left, min(n - (k - left), first))
            if near[at] > most and at > left:
                at -= 1
            elif near[at] < least and at < n - (k - left):
                at += 1
            if not least <= near[at] <= most:
                raise RuntimeError("the spectral split cannot satisfy the capacity")
            cuts.append((g, at, g + left))
            after[g], after[g + left] = (left, near[at]), (k - left, weight - near[at])
        border = edges.sparkSession.createDataFrame(cuts, "grp int, at int, right int")
        split = ranked.join(F.broadcast(border), "grp").select("v", F.when(F.col("pos") > F.col("at"), F.col("right")).otherwise(F.col("grp")).alias("to"))
        groups = materialize(groups.join(split, "v", "left").select("v", F.coalesce("to", "grp").alias("grp")))
        tasks = after
    return groups.select("v", F.col("grp").alias("part"))


def refine(edges: DataFrame, vertices: DataFrame, labels: DataFrame, options: RefineOptions | None = None) -> tuple[DataFrame, RefineStats]:
    """Moves by label propagation with a priority filter, each batch followed
    by rebalancing; the best state that was seen is kept."""
    o = options or RefineOptions()
    check_options(o)
    gr.check_labels(vertices, labels, o.parts)
    if (g := bl.pack(edges, vertices)) is not None:
        v, part = bl.arrays(labels, "v", "part")
        out, stats = refine_packed(g, part[np.argsort(v)], o)
        return materialize(bl.table(edges.sparkSession, v=np.arange(g.n), part=out)), stats
    n, total = vertices.agg(F.count(F.lit(1)), F.coalesce(F.sum("vw"), F.lit(0))).first()
    cap = scalars.partition_capacity(total, o.parts, o.imbalance_ratio)
    directed, heaviest = edges.agg(F.sum("w"), F.max("w")).first()
    if (directed or 0) > 2**62:
        raise OverflowError("edge weights are beyond the gains' range")
    loads = gr.load_list(vertices, labels, o.parts)
    if max(loads) > cap:
        raise ValueError("the input is beyond the capacity")
    share = 0.25 if (heaviest or 0) <= 1 else 0.75
    best, best_cut = labels, gr.cut_value(edges, labels)
    cut, locked = best_cut, None
    stats = RefineStats(initial_cut=best_cut, final_cut=best_cut)
    aff = materialize(gr.affinity(edges, labels, "part"))
    stale = empty = 0

    def move(movers: DataFrame) -> int:
        nonlocal labels, aff, cut, loads
        cut -= rf.cut_delta(edges, labels, movers).first()[0]
        aff = materialize(rf.affinity_delta(edges, aff, movers))
        labels = materialize(rf.apply_moves(labels, movers))
        loads = gr.load_list(vertices, labels, o.parts)
        return movers.count()

    while stats.rounds < o.max_rounds and stale < o.stale_rounds:
        stats.rounds += 1
        proposals = materialize(rf.lp_targets(aff, labels, share, locked))
        movers = materialize(rf.priority_filter(edges, labels, proposals))
        locked = None
        if movers.isEmpty():
            empty, stale = empty + 1, stale + 1
            if empty >= 2:
                break
            continue
        empty = 0
        stats.accepted += move(movers)
        locked = movers.select("v")
        for _ in range(2 * o.parts + 4):
            if max(loads) <= cap:
                break
            stats.rebalance_iterations += 1
            movers = materialize(rf.rebalance_step(aff, vertices, labels, loads, cap, n))
            if movers.isEmpty():
                break
            stats.accepted += move(movers)
        if max(loads) > cap:
            break
        stale += 1
        if cut < best_cut:
            if cut < 0.999 * best_cut:
                stale = 0
            best, best_cut = labels, cut
    stats.final_cut = gr.cut_value(edges, best)
    if stats.final_cut != best_cut or max(gr.load_list(vertices, best, o.parts)) > cap:
        raise RuntimeError("the kept state does not have the cut and loads that were counted")
    return best, stats


def refine_packed(g: bl.Blocks, labels: np.ndarray, o: RefineOptions) -> tuple[np.ndarray, RefineStats]:
    """As :func:`refine`, of a packed graph and labels by vertex."""
    cap = scalars.partition_capacity(int(g.vw.sum()), o.parts, o.imbalance_ratio)
    labels = labels.astype(np.int8)
    share = 0.25 if g.heaviest <= 1 else 0.75

    def load_list() -> np.ndarray:
        return np.bincount(labels, g.vw, o.parts).astype(np.int64)

    def looked(locked: np.ndarray | None) -> tuple[tuple[np.ndarray, ...], int]:
        held = np.zeros(g.n, dtype=bool)
        if locked is not None:
            held[locked] = True
        found, directed = bl.survey(g, labels, held, o.parts, share)
        if directed % 2:
            raise ValueError("the graph is not symmetric")
        return found, directed // 2

    loads = load_list()
    if loads.max() > cap:
        raise ValueError("the input is beyond the capacity")
    proposals, cut = looked(None)
    best, best_cut = labels, cut
    stats = RefineStats(initial_cut=cut, final_cut=cut)
    stale = empty = 0
    while stats.rounds < o.max_rounds and stale < o.stale_rounds:
        stats.rounds += 1
        v, target = bl.priority_filter(g, labels, proposals)
        if not len(v):
            empty, stale = empty + 1, stale + 1
            if empty >= 2:
                break
            proposals, cut = looked(None)
            continue
        empty, locked = 0, v
        stats.accepted += len(v)
        labels = labels.copy()
        labels[v] = target
        loads = load_list()
        for _ in range(2 * o.parts + 4):
            if loads.max() <= cap:
                break
            stats.rebalance_iterations += 1
            v, target = bl.rebalance_step(g, labels, loads, cap)
            if not len(v):
                break
            stats.accepted += len(v)
            labels[v] = target
            loads = load_list()
        if loads.max() > cap:
            break
        proposals, cut = looked(locked)
        stale += 1
        if cut < best_cut:
            if cut < 0.999 * best_cut:
                stale = 0
            best, best_cut = labels, cut
    stats.final_cut = best_cut
    labels = best
    if bl.directed_cut(g, best) // 2 != best_cut or load_list().max() > cap:
        raise RuntimeError("the kept state does not have the cut and loads that were counted")
    return best, stats


def _uncoarsen_packed(h: Hierarchy, labels: DataFrame, o: RefineOptions) -> tuple[DataFrame, list[RefineStats]]:
    gr.check_labels(h.packed[-1].vertices(), labels, o.parts)
    v, part = bl.arrays(labels, "v", "part")
    own, stats = refine_packed(h.packed[-1], part[np.argsort(v)], o)
    all_stats, last = [stats], h.packed[-1].n
    for level in range(len(h.packed_maps) - 1, -1, -1):
        own, g = own[h.packed_maps[level]], h.packed[level]
        if level == 0 or g.n >= o.refinement_growth_ratio * last:
            own, stats = refine_packed(g, own, o)
            all_stats.append(stats)
            last = g.n
    return bl.table(labels.sparkSession, v=np.arange(len(own)), part=own), all_stats


def check_options(o: RefineOptions) -> None:
    if not 0 <= o.max_rounds <= 64 or not 1 <= o.stale_rounds <= 64 or not o.refinement_growth_ratio >= 1:
        raise ValueError("rounds, stale rounds or growth ratio out of range")


def uncoarsen(h: Hierarchy, labels: DataFrame, options: RefineOptions | None = None) -> tuple[DataFrame, list[RefineStats]]:
    """Labels of the coarsest graph carried down to the input; a level is
    refined if it has grown enough since the last that was."""
    o = options or RefineOptions()
    if h.packed:
        check_options(o)
        return _uncoarsen_packed(h, labels, o)
    labels, stats = refine(*h.graphs[-1], labels, o)
    all_stats, last = [stats], h.graphs[-1][1].count()
    for level in range(len(h.maps) - 1, -1, -1):
        labels = materialize(gr.project(h.maps[level], labels))
        n = h.graphs[level][1].count()
        if level == 0 or n >= o.refinement_growth_ratio * last:
            labels, stats = refine(*h.graphs[level], labels, o)
            all_stats.append(stats)
            last = n
    return labels, all_stats


def partition(edges: DataFrame, vertices: DataFrame, parts: int = 4, ratio: float = 1.03, seed: int = 0, factor: int | None = None, max_rounds: int = 32, verify: bool = False, packed: bl.Blocks | None = None) -> tuple[DataFrame, list[RefineStats]]:
    """(v, part) and the refinements' statistics. The graph must be symmetric,
    with ids dense from 0 and positive weights. ``packed``: the same graph,
    where it is packed already by :func:`blocks.pack_groups`."""
    run = partition_run(edges, vertices, parts, ratio, seed, factor, max_rounds, verify, packed)
    return run.labels, run.stats


@dataclass
class PartitionRun:
    """Labels, what the refinements did, and seconds by stage."""

    labels: DataFrame
    stats: list[RefineStats]
    levels: int
    stop_reason: str
    seconds: dict[str, float]


def partition_run(edges: DataFrame, vertices: DataFrame, parts: int = 4, ratio: float = 1.03, seed: int = 0, factor: int | None = None, max_rounds: int = 32, verify: bool = False, packed: bl.Blocks | None = None) -> PartitionRun:
    """As :func:`partition`; everything stored on the way is deleted but the labels."""
    stages = Stages()
    with scratch(edges.sparkSession):
        with stages("input_prepare"):
            vertices = materialize(vertices.select("v", "vw"))
            scalars.partition_capacity(prep.checked_total(vertices, "vw"), parts, ratio)
            if packed is None:  # the pairs of groups are symmetric, and their ids and weights were checked
                edges = materialize(edges.select("src", "dst", "w"))
                prep.validate(edges, vertices, strict=verify)
        options = CoarsenOptions(parts, seed, cluster_size_factor=factor or scalars.production_factor(parts), pack_isolated=True, strict_verify=verify)
        with stages("coarsen"):
            h = coarsen(edges, vertices, options, packed)
        with stages("initial_partition"):
            labels = initial_partition(*h.graphs[-1], parts, ratio, seed)
        with stages("uncoarsen"):
            labels, stats = uncoarsen(h, labels, RefineOptions(parts, ratio, max_rounds))
            labels = materialize(labels, keep=True)
    return PartitionRun(labels, stats, len(h.graphs), h.stop_reason, stages.seconds)
