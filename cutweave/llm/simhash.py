"""SimHash near-duplicates through vantage-point trees.

Distinct fingerprints are partitioned by their Hamming distance to vantage
points, by a tree that is built on a bounded sample and has about LEAF
fingerprints a leaf. A fingerprint lives in one leaf and is sent to those
later leaves that the triangle inequality does not rule out, so every pair
within the radius meets in exactly one leaf. In a leaf a second tree over
its residents prunes the same way down to small buckets.

A leaf emits no pairs but a spanning forest of its links: linear in its
residents and visitors, however dense a group of near copies is. Visitors
are streamed past the residents, so memory is bounded by the leaf size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutweave.llm.common import fresh, join_hot, materialize, release
from cutweave.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
LEAF = 16384
BUCKET = 128
#: Fingerprints that the upper tree is built on, at most about.
SAMPLE = 16384
#: Residents that a task holds of a leaf, on average; a larger leaf is dealt in parts.
RESIDENTS = 1 << 20


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, as an unsigned number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = len(words)
    if not k:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if k <= size:
        return digest(joined, 42)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=k)
    end = np.cumsum(lengths + 1) - 1
    start = end - lengths
    hashes = np.array([digest(joined[i:j], 42) for i, j in zip(start[: k - size + 1].tolist(), end[size - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series(np.array([fingerprint(x) for x in s], dtype=np.uint64).view(np.int64))


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Node:
    """A vantage point: points at distance up to ``mid`` go inside. Leaves
    have ``points`` (their own, or None in the upper tree) and a number."""

    vantage: np.uint64 = np.uint64(0)
    mid: int = 0
    inside: Node | None = None
    outside: Node | None = None
    leaf: int = -1
    points: np.ndarray | None = None


def grow(x: np.ndarray, own: np.ndarray, most: int, counter: list[int]) -> Node:
    """Tree over the fingerprints ``x[own]``; of a few candidates the vantage
    point is the one that spreads the distances most."""
    if len(own) > most:
        best = None
        for c in own[:: max(1, len(own) // 8)][:8]:
            d = distance(x[own], x[c])
            mid = int(np.median(d))
            if mid == d.max():
                mid -= 1
            n_in = int((d <= mid).sum())
            near = int((np.abs(d.astype(np.int64) - mid) <= RADIUS).sum())
            if 0 < n_in < len(own) and (best is None or near < best[0]):
                best = (near, x[c], mid, d <= mid)
        if best is not None:
            _, v, mid, within = best
            return Node(v, mid, grow(x, own[within], most, counter), grow(x, own[~within], most, counter))
    counter[0] += 1
    return Node(leaf=counter[0] - 1, points=own)


def route(node: Node, x: np.ndarray, home: np.ndarray, guest: np.ndarray, radius: int, out: list) -> None:
    """Collects (leaf, residents, visitors), as indices into ``x``. A point
    whose home is inside also visits what is outside, where the triangle
    inequality allows; never the other way round, as pairs meet once."""
    if node.inside is None:
        if len(home) or len(guest):
            out.append((node.leaf, home, guest))
        return
    d, g = distance(x[home], node.vantage).astype(np.int64), distance(x[guest], node.vantage).astype(np.int64)
    within = d <= node.mid
    route(node.inside, x, home[within], guest[g - radius <= node.mid], radius, out)
    across = home[within & (d + radius > node.mid)]
    route(node.outside, x, home[~within], np.concatenate([across, guest[g + radius > node.mid]]), radius, out)


class Leaf:
    """Residents of a leaf, their tree and their links as a union-find."""

    def __init__(self, residents: np.ndarray, radius: int):
        self.x, self.radius = residents, radius
        self.root = np.arange(len(residents))
        self.tree = grow(residents, np.arange(len(residents)), BUCKET, [0])
        self._link(residents)

    def _roots(self, i: np.ndarray) -> np.ndarray:
        r = self.root[i]
        while True:
            up = self.root[r]
            if np.array_equal(up, r):
                self.root[i] = r
                return r
            r = up

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def _link(self, visitors: np.ndarray) -> np.ndarray:
        """Links visitors with residents; returns a linked resident of each, or -1."""
        met = np.full(len(visitors), -1, dtype=np.int64)
        stack = [(self.tree, np.arange(len(visitors)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            if node.inside is None:
                for at in range(0, len(q), 4096):
                    self._bucket(visitors, q[at : at + 4096], node.points, met)
                continue
            d = distance(visitors[q], node.vantage).astype(np.int64)
            stack.append((node.inside, q[d - self.radius <= node.mid]))
            stack.append((node.outside, q[d + self.radius > node.mid]))
        return met

    def _bucket(self, visitors: np.ndarray, q: np.ndarray, points: np.ndarray, met: np.ndarray) -> None:
        close = distance(visitors[q][:, None], self.x[points][None, :]) <= self.radius
        rows = np.flatnonzero(close.any(axis=1))
        if not len(rows):
            return
        close = close[rows]
        q = q[rows]
        first = points[close.argmax(axis=1)]
        old = met[q]
        met[q] = np.where(old < 0, first, old)
        # every resident that a visitor is close to joins the first that it met
        roots = self._roots(points)
        classes, inv = np.unique(roots, return_inverse=True)
        touched = np.stack([close[:, inv == k].any(axis=1) for k in range(len(classes))], axis=1) if len(classes) < len(points) else close[:, np.argsort(inv)]
        anchor = self._roots(met[q])
        r, k = np.nonzero(touched & (anchor[:, None] != classes[None, :]))
        for a, b in set(zip(anchor[r].tolist(), classes[k].tolist(), strict=True)):
            a, b = self._find(a), self._find(b)
            if a != b:
                self.root[max(a, b)] = min(a, b)

    def visit(self, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met = self._link(visitors)
        has = met >= 0
        return visitors[has], self.x[met[has]]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        top = self._roots(np.arange(len(self.x)))
        child = np.flatnonzero(top != np.arange(len(self.x)))
        return self.x[child], self.x[top[child]]


def link_forest(fps: DataFrame, radius: int = RADIUS, leaf_size: int = LEAF, sample: int = SAMPLE, residents: int = RESIDENTS) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints that links connect.

    ``fps``: one column fp (bigint), distinct, stored. The upper tree's
    sample: fingerprints whose hash is 0 modulo count / ``sample``. It has as
    many leaves as the sample allows; where these would hold more than
    ``residents`` fingerprints, each is dealt by hash in parts of that many. A
    part's residents visit the parts before it, and visitors visit all, so
    every pair still meets once and a task's memory stays bounded.
    """
    n = fps.count()
    keep = F.pmod(F.xxhash64("fp"), F.lit(max(1, n // sample))) == 0
    picked = np.array([r["fp"] for r in fps.filter(keep).collect()], dtype=np.int64).view(np.uint64)
    picked.sort()
    counter: list[int] = [0]
    tree = grow(picked, np.arange(len(picked)), max(2, int(leaf_size * len(picked) / max(n, 1))), counter)

    def strip(node: Node) -> None:
        node.points = None
        for child in (node.inside, node.outside):
            if child is not None:
                strip(child)

    strip(tree)
    n_parts = max(1, -(-n // (counter[0] * residents)))
    sent = fps.sparkSession.sparkContext.broadcast(tree)  # at most SAMPLE nodes

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        size = 0

        def flush() -> pd.DataFrame:
            keys = sorted(held)
            return pd.DataFrame({"leaf": [k[0] for k in keys], "guest": [k[1] for k in keys], "fps": [np.concatenate(held[k]).tobytes() for k in keys]})

        for b in batches:
            x = b["fp"].to_numpy().astype(np.int64).view(np.uint64)
            out: list = []
            route(sent.value, x, np.arange(len(x)), np.zeros(0, dtype=np.int64), radius, out)
            mixed = x * np.uint64(0x9E3779B97F4A7C15)
            part = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(n_parts)).astype(np.int64)
            for leaf, home, guest in out:
                for k in range(n_parts):
                    of = part[home]
                    for role, own in ((0, home[of == k]), (1, np.concatenate([home[of > k], guest]))):
                        if len(own):
                            held.setdefault((leaf * n_parts + k, role), []).append(x[own])
                            size += len(own)
            if size > 1 << 21:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf_no, homes, leaf = None, [], None

        def edges(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            for no, guest, raw in batch.itertuples(index=False):
                if no != leaf_no:
                    if leaf is None and homes:
                        leaf = Leaf(np.concatenate(homes), radius)
                    if leaf is not None:
                        yield edges(*leaf.forest())
                    leaf_no, homes, leaf = no, [], None
                x = np.frombuffer(raw, dtype=np.uint64)
                if not guest:
                    homes.append(x)
                elif homes:
                    leaf = leaf or Leaf(np.concatenate(homes), radius)
                    yield edges(*leaf.visit(x))
        if leaf is None and homes:
            leaf = Leaf(np.concatenate(homes), radius)
        if leaf is not None:
            yield edges(*leaf.forest())

    dealt = fps.mapInPandas(deal, "leaf int, guest int, fps binary")
    return dealt.repartition("leaf").sortWithinPartitions("leaf", "guest").mapInPandas(meet, "a bigint, b bigint")


def with_components(rows: DataFrame, radius: int = RADIUS, leaf_size: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """doc_id, fp, component_id, is_kept of stored ``rows`` (doc_id, fp): see
    :func:`near_duplicates`."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("best")
    fps = materialize(rows.groupBy("fp").agg(best, F.count(F.lit(1)).alias("n")), "simhash-fps")
    edges = materialize(link_forest(fps.select("fp"), radius, leaf_size, sample), "simhash-links")
    comps = materialize(connected_components(edges), "simhash-components")
    release(edges)
    rooted = fps.join(comps.withColumnRenamed("node", "fp"), "fp")
    heads = rooted.groupBy("root").agg(F.min("best").alias("head"))
    linked = rooted.join(heads, "root").select("fp", "head")
    whole = fps.join(linked, "fp", "left").select("fp", F.coalesce("head", "best").alias("head"), "n")
    out = join_hot(rows, materialize(whole, "simhash-heads"), "fp", "n", ["doc_id"])  # rows that share a fingerprint may be very many
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("fp") == F.col("head.fp"))
    return out.select("doc_id", "fp", F.col("head.doc_id").alias("component_id"), kept.alias("is_kept"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text", leaf_size: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """doc_id, fp, component_id, is_kept for every row.

    component_id: the smallest id reachable over links; null ids count only
    where a component has no other. Texts without words, null ones too, have
    fingerprint 0 and link like any other. Repeated rows stay as they are; a
    text of any length is read whole, its shingles 65,536 at a time. An empty
    table gives no rows. Only the id and the text are read, so other columns
    cannot clash. ``is_kept`` holds for the fingerprint and id that stand for
    a component: the smallest id, then the smallest fingerprint.
    """
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text)).alias("fp")), "simhash")
    return with_components(rows, radius, leaf_size, sample)


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, all columns kept.

    The row kept has the component's smallest id; of repeated rows with that
    id and fingerprint one stays, of texts that differ but have both the one
    of least hash. Null and empty texts are one component. Rows are stored
    once with their fingerprint and shuffled once, by id.
    """
    fp, hid, hfp, rank = fresh(docs, "__sim_fp", "__sim_id", "__sim_head", "__sim_rank")
    marked = materialize(docs.withColumn(fp, fingerprint_udf(F.col("text"))), "simhash-rows", "zstd")
    heads = with_components(marked.select("doc_id", F.col(fp).alias("fp")), radius).filter("is_kept").select("doc_id", "fp").distinct()
    heads = materialize(heads.select(F.col("doc_id").alias(hid), F.col("fp").alias(hfp)), "simhash-kept")
    found = marked.join(heads, F.col("doc_id").eqNullSafe(F.col(hid)) & (F.col(fp) == F.col(hfp)))
    one = Window.partitionBy("doc_id", fp).orderBy(F.xxhash64("text"))
    return found.withColumn(rank, F.row_number().over(one)).filter(F.col(rank) == 1).select(*[found[c] for c in docs.columns])


def hex16(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
