"""Graphs packed in blocks of rows, and passes over them.

Where a graph has up to MOST vertices, its entries are stored once, as packed
rows of some BLOCK entries, and each step is one pass over these: a task gets
the vertices' arrays by broadcast and sees whole rows of its block, so nothing
is shuffled but in a contraction. The arrays of the vertices are held by the
driver, as are graphs of up to LOCAL entries. Steps give the same whole numbers
as the joins of :mod:`coarsen` and :mod:`refine`, which take all other graphs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutweave.functions.scalars import MIX_A, MIX_B
from cutweave.model import materialize

#: Vertices of a graph whose arrays the driver holds, some 50 bytes each;
#: entries of a block, and of a graph that the driver holds.
MOST, BLOCK, LOCAL = 1 << 22, 1 << 19, 1 << 20
#: Weights whose sums are exact in doubles.
EXACT = 1 << 53
PACKED = "block int, lo bigint, counts binary, dst binary, w binary"
LOOSE = "block int, src binary, dst binary, w binary"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOW = np.uint64(0xFFFFFFFF)


def mix32(x: np.ndarray) -> np.ndarray:
    """:func:`scalars.mix32` of an array of 64-bit whole numbers."""
    x = x.astype(np.uint64) & _LOW
    x ^= x >> np.uint64(16)
    x = x * np.uint64(MIX_A) & _LOW
    x ^= x >> np.uint64(15)
    x = x * np.uint64(MIX_B) & _LOW
    return x ^ (x >> np.uint64(16))


@dataclass
class Block:
    """Rows of the vertices from ``lo`` on: entries by (row, dst), row from 0."""

    lo: int
    counts: np.ndarray
    dst: np.ndarray
    w: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


@dataclass
class Blocks:
    """A packed graph: parallel entries are one, their weights added up."""

    spark: SparkSession
    vw: np.ndarray
    degree: np.ndarray
    entries: int
    heaviest: int
    frame: DataFrame | None = None
    local: list[Block] | None = None

    @property
    def n(self) -> int:
        return len(self.vw)

    def run(self, step: Callable, *state: object) -> list:
        """``step(block, *state)`` of every block, in no order."""
        if self.local is not None:
            return [step(b, *state) for b in self.local]
        held = self.spark.sparkContext.broadcast(state)

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"out": [pickle.dumps(step(_block(r), *held.value)) for r in b.itertuples(index=False)]})

        with small_batches(self.spark):
            out = [pickle.loads(r[0]) for r in self.frame.mapInPandas(task, "out binary").collect()]
        held.destroy()
        return out

    def edges(self) -> DataFrame:
        """(src, dst, w), unpacked."""
        if self.local is not None:
            return table(self.spark, src=np.concatenate([b.lo + b.row for b in self.local]), dst=np.concatenate([b.dst for b in self.local]), w=np.concatenate([b.w for b in self.local]))

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for x in map(_block, b.itertuples(index=False)):
                    yield pd.DataFrame({"src": x.lo + x.row, "dst": x.dst.astype(np.int64), "w": x.w.astype(np.int64)})

        return self.frame.mapInPandas(task, "src bigint, dst bigint, w bigint")

    def vertices(self) -> DataFrame:
        return table(self.spark, v=np.arange(self.n), vw=self.vw)


class small_batches:  # noqa: N801
    """Packed rows go to Python a few at a time."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(BATCH)
        self.conf.set(BATCH, "4")

    def __exit__(self, *_: object) -> None:
        self.conf.set(BATCH, self.before)


def table(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """A frame of BIGINT columns, but of INT for part."""
    return spark.createDataFrame(pa.table({k: pa.array(x.astype(np.int32 if k == "part" else np.int64)) for k, x in columns.items()}))


def arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of whole numbers as arrays, rows in no order."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({c: [b[c].to_numpy(dtype=np.int64).tobytes()] for c in names})

    rows = df.select(*names).mapInPandas(task, ", ".join(f"{c} binary" for c in names)).collect()
    return [np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[c], dtype=np.int64) for r in rows)]) for c in names]


def _weights(w: np.ndarray) -> bytes:
    return w.astype("<u4" if not len(w) or w.max() < 1 << 32 else "<i8").tobytes()


def _entries(dst: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    to = np.frombuffer(dst, dtype="<u4")
    return to.astype(np.int64), np.frombuffer(w, dtype="<u4" if len(w) == len(dst) else "<i8").astype(np.int64)


def _block(r: object) -> Block:
    dst, w = _entries(r.dst, r.w)
    return Block(r.lo, np.frombuffer(r.counts, dtype="<u4").astype(np.int64), dst, w)


def summed(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of (src, dst), parallel ones added up."""
    key = (src.astype(np.uint64) << np.uint64(32)) | dst.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    if not len(start):
        return src[:0], dst[:0], w[:0]
    key = key[start]
    return (key >> np.uint64(32)).astype(np.int64), (key & _LOW).astype(np.int64), np.add.reduceat(w[order], start)


def _loose(src: np.ndarray, dst: np.ndarray, w: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
    """Rows of LOOSE of entries in order of src; ``starts``: first vertex of each block."""
    at = np.append(np.searchsorted(src, starts), len(src))
    rows = [(i, src[a:b].astype("<u4").tobytes(), dst[a:b].astype("<u4").tobytes(), _weights(w[a:b])) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
    return pd.DataFrame(rows, columns=["block", "src", "dst", "w"])


def starts_of(degree: np.ndarray) -> np.ndarray:
    """First vertices of blocks of some BLOCK entries and vertices."""
    no = np.cumsum(degree + 1) // BLOCK
    return np.flatnonzero(np.append(True, no[1:] != no[:-1])[: len(no)])


def _joined(spark: SparkSession, loose: DataFrame, vw: np.ndarray, starts: np.ndarray) -> Blocks:
    """The packed graph of stored or lazy rows of LOOSE."""
    ends = np.append(starts[1:], len(vw))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        src = np.concatenate([np.frombuffer(x, dtype="<u4") for x in pdf["src"]]).astype(np.int64)
        dst, w = (np.concatenate(x) for x in zip(*map(_entries, pdf["dst"], pdf["w"]), strict=True))
        src, dst, w = summed(src, dst, w)
        lo = int(starts[block])
        counts = np.bincount(src - lo, minlength=int(ends[block]) - lo)
        return pd.DataFrame({"block": [block], "lo": lo, "counts": [counts.astype("<u4").tobytes()], "dst": [dst.astype("<u4").tobytes()], "w": [_weights(w)], "heaviest": int(w.max())})

    with small_batches(spark):
        frame = materialize(loose.repartitionById(max(1, len(starts)), "block").groupBy("block").applyInPandas(join, PACKED + ", heaviest bigint"))
    degree, heaviest = np.zeros(len(vw), np.int64), 0
    for r in frame.select("lo", "counts", "heaviest").collect():
        counts = np.frombuffer(r["counts"], dtype="<u4")
        degree[r["lo"] : r["lo"] + len(counts)] = counts
        heaviest = max(heaviest, r["heaviest"])
    out = Blocks(spark, vw, degree, int(degree.sum()), heaviest, frame.drop("heaviest"))
    if out.entries <= LOCAL:
        out.local = [_block(r) for r in out.frame.collect()]
        out.frame = None
    return out


def _vertex_weights(vertices: DataFrame) -> np.ndarray | None:
    """Weights by vertex; None if :func:`pack` does not take these vertices."""
    n, lo, hi, least, total, full = vertices.agg(F.count(F.lit(1)), F.min("v"), F.max("v"), F.min("vw"), F.sum(F.col("vw").cast("double")), F.count("vw")).first()
    if not 0 < n <= MOST or lo != 0 or hi != n - 1 or full != n or least <= 0 or total >= EXACT:
        return None
    v, vw = arrays(vertices, "v", "vw")
    if len(np.unique(v)) != n:
        return None
    return vw[np.argsort(v)]


def pack(edges: DataFrame, vertices: DataFrame) -> Blocks | None:
    """The packed graph; None if it has over MOST vertices, ids that are not
    dense from 0, ends or weights out of range, or sums that doubles do not hold."""
    spark = edges.sparkSession
    if (vw := _vertex_weights(vertices)) is None:
        return None
    n = len(vw)
    ends = [f(c) for c in ("src", "dst") for f in (F.min, F.max, F.count)]
    row = edges.agg(F.count(F.lit(1)), *ends, F.min("w"), F.sum(F.col("w").cast("double")), F.count("w")).first()
    m, a, b, na, c, d, nc, light, weight, nw = row
    if m == 0 or min(na, nc, nw) < m or min(a, c) < 0 or max(b, d) >= n or light <= 0 or weight >= EXACT:
        return None
    src, count = arrays(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "src", "n")
    degree = np.zeros(n, np.int64)
    degree[src] = count
    starts = starts_of(degree)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for x in batches:
            held.append(tuple(x[k].to_numpy(dtype=np.int64) for k in ("src", "dst", "w")))
            size += len(x)
            if size >= 2 * BLOCK:
                yield _loose(*summed(*(np.concatenate(y) for y in zip(*held, strict=True))), starts)
                held, size = [], 0
        if size:
            yield _loose(*summed(*(np.concatenate(y) for y in zip(*held, strict=True))), starts)

    # stored, as these are to go to Python in larger batches than packed rows
    return _joined(spark, materialize(edges.select("src", "dst", "w").mapInPandas(task, LOOSE)), vw, starts)


def pack_groups(members: DataFrame, vertices: DataFrame) -> Blocks | None:
    """As :func:`pack`, of the graph that links the vertices of each group of
    ``members`` (grp, v), weighted by the number of pairs of different members.
    The pairs are made where they are packed, and never stored or shuffled one by one."""
    spark = members.sparkSession
    if (vw := _vertex_weights(vertices)) is None:
        return None
    groups = members.filter("grp IS NOT NULL").groupBy("grp").agg(F.collect_list(F.col("v").cast("bigint")).alias("vs"))
    groups = materialize(groups.filter("size(vs) > 1").select("vs"))
    size = F.size("vs").cast("double")
    lo, hi, weight = groups.agg(F.min(F.array_min("vs")), F.max(F.array_max("vs")), F.sum(size * size)).first()
    if lo is None or lo < 0 or hi >= len(vw) or weight >= EXACT:
        return None
    v, most = arrays(groups.select(F.explode("vs").alias("v"), (F.size("vs") - 1).cast("bigint").alias("n")).groupBy("v").agg(F.sum("n").alias("n")), "v", "n")
    degree = np.zeros(len(vw), np.int64)
    degree[v] = most
    starts = starts_of(degree)

    def pairs(vs: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        of, n = vs.flatten().to_numpy(), vs.value_lengths().to_numpy().astype(np.int64)
        first, n = np.repeat(np.cumsum(n) - n, n), np.repeat(n, n)
        upto = np.cumsum(n)
        cut = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1], 2 * BLOCK)), len(of)))
        for a, b in zip(cut[:-1], cut[1:], strict=True):  # some 2 * BLOCK pairs, or those of one member
            k = n[a:b]
            src, dst = np.repeat(of[a:b], k), of[np.repeat(first[a:b] - np.cumsum(k) + k, k) + np.arange(k.sum())]
            other = src != dst
            yield src[other], dst[other]

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        src, dst = (np.concatenate(x) for x in zip(*held, strict=True))
        rows = _loose(*summed(src, dst, np.ones(len(src), np.int64)), starts)
        return pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in zip(rows, (pa.int32(), *[pa.binary()] * 3), strict=True)], names=list(rows))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            for x in pairs(b.column(0)) if b.num_rows else ():
                held.append(x)
                count += len(x[0])
                if count >= 2 * BLOCK:
                    yield packed(held)
                    held, count = [], 0
        if count:
            yield packed(held)

    out = _joined(spark, materialize(groups.mapInArrow(task, LOOSE)), vw, starts)
    return out if out.entries else None


# --- clustering ----------------------------------------------------------------


def _best(row: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Places of each row's greatest by the first value, then the next; rows ascend."""
    at = np.arange(len(row))
    for x in values:
        if not len(at):
            break
        start = np.flatnonzero(np.append(True, row[at][1:] != row[at][:-1]))
        top = np.maximum.reduceat(x[at], start)
        at = at[x[at] == np.repeat(top, np.diff(np.append(start, len(at))))]
    return at


def _propose(b: Block, clusters: np.ndarray, hashed: np.ndarray, role: np.ndarray | None, threshold: int, tie: int) -> tuple[np.ndarray, ...]:
    own = clusters[b.lo : b.lo + len(b.counts)].astype(np.int64)
    row = b.row
    use = b.dst != b.lo + row
    if role is not None:
        use &= (role[own] < threshold)[row]
    row, c, aff = summed(row[use], clusters[b.dst[use]].astype(np.int64), b.w[use])
    at_own = c == own[row]
    mine = np.zeros(len(own), np.int64)
    mine[row[at_own]] = aff[at_own]
    ok = ~at_own if role is None else ~at_own & (role[c] >= threshold)
    row, c, aff = row[ok], c[ok], aff[ok]
    near = np.flatnonzero(aff == np.repeat(*_tops(row, aff))) if len(row) else np.zeros(0, np.int64)
    row, c, aff = row[near], c[near], aff[near]
    t = mix32((b.lo + row).astype(np.uint64) ^ hashed[c].astype(np.uint64) ^ np.uint64(tie)).astype(np.int64)
    at = _best(row, t, -c)
    row, c, gain, t = row[at], c[at], aff[at] - mine[row[at]], t[at]
    up = gain > 0
    return b.lo + row[up], c[up], gain[up], t[up]


def _tops(row: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    return np.maximum.reduceat(x, start), np.diff(np.append(start, len(row)))


def propose(g: Blocks, clusters: np.ndarray, role_salt: int, threshold: int, tie_salt: int, filter_roles: bool = True) -> tuple[np.ndarray, ...]:
    """As :func:`coarsen.propose`: v, target, gain and tie."""
    ids = np.arange(g.n)
    hashed = mix32(ids).astype(np.uint32)
    role = mix32(ids.astype(np.uint64) ^ np.uint64(role_salt)).astype(np.uint32) if filter_roles else None
    parts = g.run(_propose, clusters.astype(np.int32), hashed, role, threshold, tie_salt)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _running(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Running sums within neighbours of one group."""
    if not len(group):
        return value
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    total = np.cumsum(value)
    return total - np.repeat(total[start] - value[start], np.diff(np.append(start, len(group))))


def admit(proposed: tuple[np.ndarray, ...], vw: np.ndarray, clusters: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`coarsen.admit`: v and target."""
    v, target, gain, tie = proposed
    order = np.lexsort((v, -tie, -gain, target))
    v, target = v[order], target[order]
    weight = weights(vw, clusters)[target]
    fits = (weight <= cap) & (_running(target, vw[v]) <= cap - weight)
    return v[fits], target[fits]


def weights(vw: np.ndarray, clusters: np.ndarray) -> np.ndarray:
    """Weight of each cluster, by its id; the sums are exact."""
    return np.bincount(clusters, vw, len(vw)).astype(np.int64)


def pack_isolated(g: Blocks, clusters: np.ndarray, cap: int) -> np.ndarray:
    """Clusters after :func:`coarsen.pack_isolated`."""
    v = np.flatnonzero(g.degree == 0)
    run = np.cumsum(g.vw[v])
    first, last = (run - g.vw[v]) // cap, (run - 1) // cap
    v, first = v[first == last], first[first == last]
    bins, at, of = np.unique(first, return_index=True, return_inverse=True)
    out = clusters.copy()
    out[v] = v[at][of]
    return out


def two_hop(proposed: tuple[np.ndarray, ...], vw: np.ndarray, clusters: np.ndarray, cap: int, budget: int) -> np.ndarray:
    """Clusters after the first ``budget`` pairs of :func:`coarsen.two_hop_pairs`."""
    v, target, gain, tie = proposed
    alone = weights(vw, clusters)[clusters[v]] == vw[v]
    v, target, gain, tie = v[alone], target[alone], gain[alone], tie[alone]
    order = np.lexsort((v, -tie, -gain, target))
    v, target = v[order], target[order]
    rank = _running(target, np.ones(len(v), np.int64))
    second = np.flatnonzero((rank % 2 == 0) & (rank > 0))
    second = second[vw[v[second - 1]] <= cap - vw[v[second]]][:budget]  # in the order of (target, gain, tie, v) of the second
    out = clusters.copy()
    out[v[second]] = clusters[v[second - 1]]
    return out


def contract(g: Blocks, mapping: np.ndarray, count: int) -> Blocks:
    """The graph of ``count`` clusters; entries within one vanish."""
    vw = np.bincount(mapping, g.vw, count).astype(np.int64)
    starts = starts_of(np.bincount(mapping, g.degree, count).astype(np.int64))
    if g.local is not None:
        parts = [_contract(b, mapping) for b in g.local]
        src, dst, w = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        degree = np.bincount(src, minlength=count)
        return Blocks(g.spark, vw, degree, len(src), int(w.max()) if len(w) else 0, local=[Block(0, degree, dst, w)])
    held = g.spark.sparkContext.broadcast(mapping.astype(np.int32))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [_contract(_block(r), held.value) for r in b.itertuples(index=False)]
            yield _loose(*summed(*(np.concatenate(x) for x in zip(*parts, strict=True))), starts)

    return _joined(g.spark, g.frame.mapInPandas(task, LOOSE), vw, starts)


def _contract(b: Block, mapping: np.ndarray) -> tuple[np.ndarray, ...]:
    src, dst = mapping[b.lo + b.row].astype(np.int64), mapping[b.dst].astype(np.int64)
    cross = src != dst
    return src[cross], dst[cross], b.w[cross]


def _directed(b: Block, labels: np.ndarray) -> int:
    return int(b.w[labels[b.lo + b.row] != labels[b.dst]].sum())


def directed_cut(g: Blocks, labels: np.ndarray) -> int:
    return sum(g.run(_directed, labels))


# --- refinement ----------------------------------------------------------------


def _affinity(b: Block, labels: np.ndarray, parts: int) -> np.ndarray:
    """Weight of each row's vertex to each part, without loops."""
    row = b.row
    w = np.where(b.dst == b.lo + row, 0, b.w)
    return np.bincount(row * parts + labels[b.dst], w, len(b.counts) * parts).astype(np.int64).reshape(-1, parts)


def _survey(b: Block, labels: np.ndarray, locked: np.ndarray, parts: int, share: float) -> tuple:
    aff, v = _affinity(b, labels, parts), np.arange(b.lo, b.lo + len(b.counts))
    own_label = labels[v].astype(np.int64)
    at = np.arange(len(v))
    own = aff[at, own_label]
    aff[at, own_label] = 0
    cut = int(aff.sum())
    target = aff.argmax(axis=1)
    best = aff[at, target]
    gain = best - own
    take = (best > 0) & ((gain >= 0) | (-gain < np.floor(share * own.astype(np.float64)))) & ~locked[v]
    return v[take], target[take], gain[take], cut


def survey(g: Blocks, labels: np.ndarray, locked: np.ndarray, parts: int, share: float) -> tuple[tuple[np.ndarray, ...], int]:
    """As :func:`refine.lp_targets`, v, target and gain, and the directed cut."""
    got = g.run(_survey, labels, locked, parts, share)
    return tuple(np.concatenate([x[i] for x in got]) for i in range(3)), sum(x[3] for x in got)


def _priority(b: Block, labels: np.ndarray, target: np.ndarray, gain: np.ndarray) -> np.ndarray:
    v, u = b.lo + b.row, b.dst
    near = np.flatnonzero((target[v] >= 0) & (target[u] >= 0) & (v != u))
    v, u, w = v[near], u[near], b.w[near]
    first = (gain[u] > gain[v]) | ((gain[u] == gain[v]) & (u < v))
    v, u, w = v[first], u[first], w[first]
    tu, tv, su, sv = target[u], target[v], labels[u], labels[v]
    term = w * ((tu == tv).astype(np.int64) - (tu == sv) - (su == tv) + (su == sv))
    fix = np.bincount(v - b.lo, term, len(b.counts)).astype(np.int64)
    own = np.arange(b.lo, b.lo + len(b.counts))
    return own[(target[own] >= 0) & (gain[own] + fix >= 0)]


def priority_filter(g: Blocks, labels: np.ndarray, proposed: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`refine.priority_filter`: v and target."""
    v, to, up = proposed
    target, gain = np.full(g.n, -1, labels.dtype), np.zeros(g.n, np.int64)
    target[v], gain[v] = to, up
    kept = np.concatenate(g.run(_priority, labels, target, gain))
    return kept, target[kept]


def _overloaded(b: Block, labels: np.ndarray, over: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    out = over[labels[b.lo : b.lo + len(b.counts)]] & (b.counts > 0)
    return b.lo + np.flatnonzero(out), _affinity(b, labels, parts)[out]


def rebalance_step(g: Blocks, labels: np.ndarray, loads: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`refine.rebalance_step`: v and target."""
    parts = len(loads)
    over = loads > cap
    v = np.flatnonzero(over[labels])
    aff = np.zeros((len(v), parts), np.int64)
    for own, rows in g.run(_overloaded, labels, over, parts):
        aff[np.searchsorted(v, own)] = rows
    source, vw, slack = labels[v].astype(np.int64), g.vw[v], np.maximum(0, cap - loads)
    may = (slack > 0) & (vw[:, None] <= slack) & (np.arange(parts) != source[:, None])
    room = np.where(may, slack, 0)
    some = may.any(axis=1)
    v, aff, source, vw, may, room = v[some], aff[some], source[some], vw[some], may[some], room[some]
    own = aff[np.arange(len(v)), source]
    near = np.where(may, aff, -1)
    top = near.max(axis=1, initial=-1)
    best = np.where(near == top[:, None], room, -1).argmax(axis=1)  # then the most room, then the lowest
    upto = np.cumsum(room, axis=1)
    ticket = mix32(v).astype(np.int64) % np.maximum(1, upto[:, -1])
    target = np.where(top > 0, best, (may & (upto > ticket[:, None])).argmax(axis=1))
    per_weight = (top - own).astype(np.float64) / vw
    loss = 25 + np.ceil(np.log(np.where(per_weight < 0, -per_weight, 1.0)) / np.log(1.5))
    bucket = np.where(per_weight > 0, 0, np.where(per_weight == 0, 1, np.clip(loss, 2, 49))).astype(np.int64)
    section = mix32(v).astype(np.int64) % 16
    order = np.lexsort((v, section, bucket, source))
    before = _running(source[order], vw[order]) - vw[order]
    order = order[before < (loads - cap)[source[order]]]
    order = order[np.lexsort((v[order], section[order], bucket[order], target[order]))]
    order = order[_running(target[order], vw[order]) <= (cap - loads)[target[order]]]
    return v[order], target[order]
