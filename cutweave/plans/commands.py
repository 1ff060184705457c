"""Commands: partition, coarsen, analyze, compare and the synthetic suite."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cutweave.functions import scalars
from cutweave.model import CoarsenOptions, Stages
from cutweave.operators import graph as gr
from cutweave.operators import prep
from cutweave.plans import partition as pt
from cutweave.sources import dump, files

KINDS, PARTS = ("social", "circuit", "disconnected"), (2, 4, 8, 32)
Method = Callable[[DataFrame, DataFrame, int], DataFrame]


def partition_files(spark: SparkSession, indptr: str, indices: str, parts: int, output: str, ratio: float = 1.03, seed: int = 0, verify: bool = False) -> dict[str, object]:
    """Loads a CSR, partitions it and writes the labels as int32; returns the
    metrics that the command prints."""
    stages = Stages()
    with stages("input_load"):
        edges, vertices = files.read_csr(spark, indptr, indices, limit=files.LIMIT)
    run = pt.partition_run(edges, vertices, parts, ratio, seed, verify=verify)
    with stages("partition_output"):
        files.write_partition(run.labels, output)
    row = gr.verify(edges, vertices, run.labels, parts, ratio).first()
    seconds = {f"{k}_seconds": float(v) for k, v in {**stages.seconds, **run.seconds}.items()}
    return {"cut": row["cut"], "cut_ratio": float(row["cut_ratio"]), "max_load": row["max_load"], "capacity": int(row["capacity"]), "levels": run.levels, "stop_reason": run.stop_reason, **seconds, "algorithm_total_seconds": float(sum(run.seconds.values()))}


def coarsen_files(spark: SparkSession, indptr: str, indices: str, parts: int, output: str | None, seed: int = 0, stop_ratio: float = 0.90, max_levels: int = 24, verify: bool = False) -> dict[str, object]:
    """Loads a CSR, coarsens it and, with ``output``, writes the int32 dump."""
    stages = Stages()
    edges, vertices = files.read_csr(spark, indptr, indices, limit=files.LIMIT)
    with stages("coarsen"):
        h = pt.coarsen(edges.select("src", "dst", "w"), vertices, CoarsenOptions(parts, seed, stop_ratio, max_levels, strict_verify=verify))
    if output:
        with stages("hierarchy_export"):
            dump.write_dump(h, output)
    return {"levels": len(h.graphs), "coarsest_vertices": h.graphs[-1][1].count(), "stop_reason": h.stop_reason, **{f"{k}_seconds": float(v) for k, v in stages.seconds.items()}}


def compare(edges: DataFrame, vertices: DataFrame, methods: dict[str, Method], parts: tuple[int, ...] = (4, 8), ratio: float = 1.03, repeats: int = 3) -> dict[str, object]:
    """Runs methods in turn on one graph, so that what slows the machine slows
    all alike; each must keep the same integer capacity. Equal labellings are
    verified once. Returns metadata, runs, verified and summary."""
    runs, verified = [], {}
    for k in parts:
        for repeat in range(repeats):
            for name, method in methods.items():
                stages = Stages()
                with stages("run"):
                    labels = method(edges, vertices, k)
                    digest = gr.labels_digest(labels)
                if (k, digest) not in verified:
                    row = gr.verify(edges, vertices, labels, k, ratio).first()
                    if not row["capacity_ok"]:
                        raise RuntimeError(f"{name} is beyond the capacity at k = {k}")
                    verified[(k, digest)] = row["cut"]
                runs.append((k, name, repeat, stages.seconds["run"], verified[(k, digest)], digest))
    frame = edges.sparkSession.createDataFrame(runs, "k int, method string, repeat int, seconds double, cut bigint, labels string")
    summary = [r.asDict() for r in gr.repeat_summary(frame).orderBy("k", "method").collect()]
    meta = {"vertices": vertices.count(), "entries": edges.count(), "ratio": ratio, "repeats": repeats, "methods": sorted(methods)}
    return {"metadata": meta, "runs": [dict(zip(frame.columns, r, strict=True)) for r in runs], "verified": [{"k": k, "labels": d, "cut": c} for (k, d), c in verified.items()], "summary": summary}


def suite(spark: SparkSession, n: int = 16384, kinds: tuple[str, ...] = KINDS, parts: tuple[int, ...] = PARTS, repeats: int = 2, seed: int = 17, ratio: float = 1.03, max_rounds: int = 32) -> list[dict[str, object]]:
    """Partitions each kind of synthetic graph into each number of parts. The
    reported cut must be an independent join's, loads within the capacity, and
    repeats alike to the last label."""
    out = []
    for kind in kinds:
        edges = pt.materialize(prep.synthetic(spark, kind, n, seed))
        vertices = spark.range(n).selectExpr("id AS v", "1L AS vw")
        for k in parts:
            digests = set()
            for _ in range(repeats):
                run = pt.partition_run(edges, vertices, k, ratio, 0, max_rounds=max_rounds)
                row = gr.verify(edges, vertices, run.labels, k, ratio).first()
                if not row["capacity_ok"] or row["cut"] != run.stats[-1].final_cut:
                    raise RuntimeError(f"{kind} into {k}: cut {run.stats[-1].final_cut} reported, {row}")
                digests.add(gr.labels_digest(run.labels))
            if len(digests) != 1:
                raise RuntimeError(f"{kind} into {k}: repeats differ")
            out.append({"kind": kind, "parts": k, "cut": row["cut"], "max_load": row["max_load"], "capacity": int(row["capacity"])})
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cutweave")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("partition", "coarsen"):
        p = commands.add_parser(name)
        p.add_argument("indptr")
        p.add_argument("indices")
        p.add_argument("parts", type=int)
        p.add_argument("output")
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("--verify", action="store_true")
        if name == "partition":
            p.add_argument("--ratio", type=float, default=1.03)
        else:
            p.add_argument("--stop-ratio", type=float, default=0.90)
            p.add_argument("--max-levels", type=int, default=24)
    p = commands.add_parser("suite")
    p.add_argument("--n", type=int, default=16384)
    args = parser.parse_args(argv)
    if args.command != "suite" and not scalars.MIN_PARTS <= args.parts <= scalars.MAX_PARTS:
        parser.error("parts must be from 2 to 32")
    spark = SparkSession.builder.appName("cutweave").getOrCreate()
    if args.command == "partition":
        print(files.metric_text(partition_files(spark, args.indptr, args.indices, args.parts, args.output, args.ratio, args.seed, args.verify)))
    elif args.command == "coarsen":
        print(files.metric_text(coarsen_files(spark, args.indptr, args.indices, args.parts, args.output, args.seed, args.stop_ratio, args.max_levels, args.verify)))
    else:
        for row in suite(spark, args.n):
            print(files.metric_text(row))
    return 0
