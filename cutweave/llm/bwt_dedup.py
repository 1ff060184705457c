"""Exact removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere
else. Three steps decide that for every position of every text:

1. Every window of LENGTH bytes is filed under its anchor, the place in it
   where the hash of GRAM bytes is least. Equal windows have equal anchors,
   so windows whose anchor hash stands once in the corpus are settled: they
   do not repeat. An anchor's windows overlap and form one context string.
   Contexts that are equal, anchor and all, are settled too: all repeat.
2. What is left are differing contexts under one anchor hash: edges of
   copies. Those of many anchors make a bucket, a bucket is cut into shards,
   each shard sorts its suffixes once and keeps its transform. The shards'
   transforms are merged by refining their interleave STEP bytes at a time,
   LENGTH / STEP times, never sorting suffixes of different shards. Blocks
   of the interleave are then the intervals of equal LENGTH-byte prefixes;
   those of two suffixes or more are the repeats.
3. The repeated windows come back to their texts, which are cut.

Hashes of 128 bits stand for texts and for contexts under an anchor hash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutweave.llm.common import join_hot, materialize, release

LENGTH = 200
GRAM = 32
STEP = 8
#: Bytes of text that are searched for anchors at once.
CHUNK = 2 << 20
#: Bytes of a shard, and of the contexts of a bucket on average.
SHARD, BUCKET = 32 << 10, 128 << 10
#: Contexts of one anchor hash that may share a bucket; more are split.
CROWD = 8192

_SECOND = xxhash.xxh64_intdigest(b"second", 42)


def text_refs(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for a text."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def _refs(b: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(b, 42), xxhash.xxh64_intdigest(b, _SECOND)


# --- anchors ---------------------------------------------------------------


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a multiple of 8) from each position on."""
    n = len(buf) - gram + 1
    word = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf.data, strides=(1,)).copy()
    out = np.zeros(n, dtype=np.uint64)
    for k in range(0, gram, 8):
        out ^= word[k : k + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def contexts(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Every text's windows by anchor: arrays doc, start (first window's, in
    the text), size (bytes of the context), off (of the anchor in it), hash
    of the anchor, and hash of the context."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else sizes
    data = b"".join(texts)
    empty = {k: np.zeros(0, dtype=t) for k, t in (("doc", "i8"), ("start", "i8"), ("size", "i8"), ("off", "i8"), ("h", "u8"), ("c", "u8"))}
    if not len(sizes) or sizes.max() < length:
        return empty
    buf = np.frombuffer(data, dtype=np.uint8)
    h = gram_hashes(buf, gram)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(key, length - gram + 1)
    valid = np.zeros(len(least), dtype=bool)
    for b, k in zip(base.tolist(), sizes.tolist(), strict=True):
        if k >= length:
            valid[b : b + k - length + 1] = True
    at = np.flatnonzero(valid)
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    start, stop, anchor = at[first], at[last] + length, anchor[first]
    doc = np.searchsorted(base, start, side="right") - 1
    off = anchor - start
    digest = xxhash.xxh3_64_intdigest
    c = np.fromiter((digest(data[i:j], k) for i, j, k in zip(start.tolist(), stop.tolist(), off.tolist(), strict=True)), dtype=np.uint64, count=len(start))
    # an empty text shares its base with the next one; only texts with windows get here
    while (short := sizes[doc] < length).any():
        doc[short] -= 1
    return {"doc": doc, "start": start - base[doc], "size": stop - start, "off": off, "h": h[anchor], "c": c}


ANCHORS = "extra boolean, h bigint, c bigint, off int, size int, r1 bigint, r2 bigint, start int, twice boolean"


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """A row for each context that a task meets, and one marked ``extra`` for
    each further place where it meets it; so a passage that stands in many
    documents sends few rows under its anchor's hash."""

    def part(texts: list[bytes]) -> pd.DataFrame:
        refs = np.array([_refs(t) for t in texts], dtype=np.uint64).reshape(-1, 2)
        own = contexts(texts, length)
        r = refs[own["doc"]] if len(own["doc"]) else refs[:0]
        mixed = own["c"] ^ (own["h"] * np.uint64(0x9E3779B97F4A7C15))
        _, index, inverse, count = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
        extra = np.ones(len(mixed), dtype=bool)
        extra[index] = False
        # the same text again adds no place, but makes its contexts repeat
        place = r[:, 0] ^ (own["start"].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        _, once = np.unique(place ^ mixed, return_index=True)
        keep = np.zeros(len(mixed), dtype=bool)
        keep[once] = True
        keep |= ~extra
        h = np.where(extra, place, own["h"])
        return pd.DataFrame(
            {
                "extra": extra, "h": h.view(np.int64), "c": own["c"].view(np.int64), "off": own["off"].astype(np.int32), "size": own["size"].astype(np.int32),
                "r1": r[:, 0].copy().view(np.int64), "r2": r[:, 1].copy().view(np.int64), "start": own["start"].astype(np.int32), "twice": count[inverse] > 1 if len(mixed) else extra,
            }
        )[keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for t in b["text"]:
                raw = (t or "").encode("utf-8", "surrogatepass")
                if len(raw) >= length:
                    held.append(raw)
                    size += len(raw)
                    if size >= CHUNK:
                        yield part(held)
                        held, size = [], 0
        if held:
            yield part(held)

    return docs.select("text").mapInPandas(run, ANCHORS)


def classify(rows: DataFrame) -> DataFrame:
    """Places whose windows repeat (settled) or may repeat (open), and one
    place of each settled context that an open one must be held against
    (sample). Columns: r1, r2, h, off, start, size, settled, open, sample."""
    by_c, by_h = Window.partitionBy("h", "c"), Window.partitionBy("h")
    first = Window.partitionBy("h", "c").orderBy("r1", "r2", "start")
    settled = F.col("extra") | (F.count(F.lit(1)).over(by_c) > 1) | F.max("twice").over(by_c)
    mixed = F.min("c").over(by_h) != F.max("c").over(by_h)
    out = rows.withColumn("settled", settled).withColumn("mixed", mixed & ~F.col("extra")).withColumn("rank", F.row_number().over(first))
    out = out.withColumn("open", F.col("mixed") & ~F.col("settled"))
    out = out.withColumn("sample", F.col("settled") & F.col("mixed") & (F.col("rank") == 1) & F.max("open").over(by_h))
    return out.filter("settled or open").select("r1", "r2", "h", "off", "start", "size", "settled", "open", "sample")


# --- transforms --------------------------------------------------------------


class Shard:
    """Suffixes of some strings, sorted by their first ``depth`` bytes, STEP at
    a time, an end before all else; the transform: the STEP bytes before each
    suffix; and its mapping: where the suffix that begins with these stands."""

    def __init__(self, strings: list[bytes], numbers: list[int], depth: int = LENGTH):
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        n = int(sizes.sum() + len(sizes))
        base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        buf = np.frombuffer(b"\0".join(strings) + b"\0" * STEP, dtype=np.uint8)
        self.offset = np.arange(n) - np.repeat(base, sizes + 1)
        self.string = np.repeat(np.array(numbers, dtype=np.int64), sizes + 1)
        left = np.repeat(sizes, sizes + 1) - self.offset
        code = np.ndarray(shape=(n,), dtype=">u8", buffer=buf.data, strides=(1,)).astype(np.uint64)
        # ends come first, and are told apart by place alone; a rank is the place where its class begins
        self.order = np.concatenate([np.flatnonzero(left < STEP), np.zeros(0, dtype=np.int64)])
        long = np.flatnonzero(left >= STEP)
        long = long[np.argsort(code[long], kind="stable")]
        n_short = len(self.order)
        self.order = np.concatenate([self.order, long])
        place = np.arange(n)
        new = np.ones(n, dtype=bool)
        new[n_short + 1 :] = code[long[1:]] != code[long[:-1]]
        new[n_short : n_short + 1] = True
        new[1:n_short] = False  # one class, as far as longer suffixes see
        self.values = code[long[new[n_short:]]]  # distinct, ascending
        kinds = np.zeros(n, dtype=np.int64)
        kinds[long] = np.cumsum(new[n_short:]) - 1
        rank = np.empty(n, dtype=np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(new, place, 0))
        covered = STEP
        while covered < depth:
            # only classes of two suffixes or more are sorted on, by the rank of what follows
            alone = new & np.append(new[1:], True)
            alone[:n_short] = True
            at = np.flatnonzero(~alone)
            if not len(at):
                break
            own = self.order[at]
            ahead = np.where(left[own] >= covered, rank[np.minimum(own + covered, n - 1)] + 1, 0)
            again = np.lexsort((ahead, rank[own])) if n >= 1 << 31 else np.argsort((rank[own] << 32) | ahead, kind="stable")
            before, ahead = rank[own[again]], ahead[again]
            self.order[at] = own[again]
            split = np.ones(len(at), dtype=bool)
            split[1:] = (before[1:] != before[:-1]) | (ahead[1:] != ahead[:-1])
            new[at] = split
            rank[self.order[at]] = np.maximum.accumulate(np.where(split, at, 0))
            covered *= 2
        where = np.empty(n, dtype=np.int64)
        where[self.order] = place
        self.back = where[np.maximum(self.order - STEP, 0)]  # of suffixes with STEP bytes before them
        self.symbol = kinds[np.maximum(self.order - STEP, 0)]  # number in ``values``

    def after(self, depth: int) -> np.ndarray:
        """Suffixes with ``depth`` bytes before them, as places in the order."""
        return np.flatnonzero(self.offset[self.order] >= depth)


def merge_shards(shards: list[Shard], depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each shard the suffixes whose first ``depth`` bytes begin another
    suffix too, as places in its order, and the block of equal ones each is in.

    The interleave starts with the suffixes that have ``depth`` bytes before
    them. A step puts STEP bytes before each: a stable sort by them refines
    the interleave, and the shards' mappings say which suffixes stand there
    now; that many more bytes of each prefix are then in order. A block is an
    interval of equal prefixes; the common prefix at its border is shorter
    than the bytes so far. A suffix that is alone in its block stays alone
    however it is extended, so it goes; that settles most in a few steps.
    """
    own = [s.after(depth) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.int32), [len(x) for x in own])
    block = np.zeros(len(z), dtype=np.int32)  # of no bytes, all prefixes are equal
    values = np.sort(np.concatenate([s.values for s in shards]), kind="stable")
    values = values[np.append(True, values[1:] != values[:-1])[: len(values)]]
    kind = np.uint16 if len(values) < 1 << 16 else np.int32
    symbols = [np.searchsorted(values, s.values).astype(kind)[s.symbol] for s in shards]
    for _ in range(0, depth, STEP):
        # the i-th suffix of a shard in the interleave is the i-th of its transform
        chars = np.empty(len(z), dtype=kind)
        chars[np.argsort(z, kind="stable")] = np.concatenate([x[i] for x, i in zip(symbols, own, strict=True)])
        order = np.argsort(chars, kind="stable")
        ch, bl, z = chars[order], block[order], z[order]
        new = np.ones(len(z) + 1, dtype=bool)
        new[1:-1] = (ch[1:] != ch[:-1]) | (bl[1:] != bl[:-1])
        keep = ~(new[:-1] & new[1:])
        block = np.cumsum(new[:-1])[keep]
        stays = keep[np.argsort(z, kind="stable")]
        z = z[keep]
        ends = np.cumsum([len(x) for x in own])[:-1]
        own = [np.sort(s.back[i])[k] for s, i, k in zip(shards, own, np.split(stays, ends), strict=True)]
    blocks = np.split(block[np.argsort(z, kind="stable")], np.cumsum([len(x) for x in own])[:-1])
    return list(zip(own, blocks, strict=True))


def repeated_windows(strings: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD) -> list[np.ndarray]:
    """For each string, the starts of its ``length``-byte windows that start
    anywhere else too. All strings must be of ``length`` bytes or more, and
    ``length`` a multiple of STEP."""
    shards, held, numbers, size = [], [], [], 0
    for no, s in enumerate(strings):
        held.append(s)
        numbers.append(no)
        size += len(s)
        if size >= shard_bytes:
            shards.append(Shard(held, numbers, length))
            held, numbers, size = [], [], 0
    if held:
        shards.append(Shard(held, numbers, length))
    found = [np.zeros(0, dtype=np.int64)] * len(strings)
    for s, (own, _) in zip(shards, merge_shards(shards, length) if shards else [], strict=True):
        at = np.sort(s.order[own])
        no, first = np.unique(s.string[at], return_index=True)
        for k, offsets in zip(no.tolist(), np.split(s.offset[at], first[1:]), strict=False):  # none: one empty part
            found[k] = offsets
    return found


def runs(starts: np.ndarray, length: int) -> np.ndarray:
    """Union of the windows at ascending ``starts``, as rows (first, end)."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > starts[:-1] + length
    first = np.flatnonzero(new)
    return np.stack([starts[first], starts[np.concatenate([first[1:], [len(starts)]]) - 1] + length], axis=1)


def split_crowds(ctx: DataFrame, length: int, gram: int, crowd: int) -> tuple[DataFrame, list[DataFrame]]:
    """Contexts so split that no hash has more than ``crowd`` of them.

    The windows of a crowded anchor, which reach lo to hi bytes to its left,
    are halved by that. Those that reach at least t bytes share the t bytes
    there; the others share the bytes to the right that a shorter reach
    leaves them. That makes the new hash, so equal windows stay together,
    and contexts that are alone under theirs are settled: none of their
    windows repeats. At a single reach a context is a window, and equal ones
    repeat. Columns: h, r1, r2, start, off, raw, settled. Returns the
    contexts, and the runs (r1, r2, first, end) found to repeat on the way.
    A level halves all crowded anchors at once; there are at most 9 levels.
    """
    columns = ["h", "r1", "r2", "start", "off", "raw", "settled"]
    now = ctx.select(*columns, F.lit(0).alias("lo"), F.lit(length - gram).alias("hi"))
    off, size, t = F.col("off"), F.octet_length("raw"), F.col("t")
    calm: list[DataFrame] = []
    found: list[DataFrame] = []
    while True:
        big = materialize(now.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("h"), "bwt-crowds")
        if big.isEmpty():
            calm.append(now)
            break
        calm.append(now.join(big, "h", "left_anti"))
        crowded = now.join(big, "h", "left_semi").withColumn("t", F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int"))
        single = crowded.filter("lo = hi").withColumn("c", F.xxhash64("raw"))
        same = single.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.max("settled").alias("s")).filter("n > 1 or s").select("h", "c")
        hit = single.join(same, ["h", "c"], "left_semi").filter("not settled")
        found.append(hit.select("r1", "r2", F.col("start").alias("first"), (F.col("start") + length).alias("end")))
        wide = crowded.filter("lo < hi")
        far = wide.filter(off >= t).select(
            F.xxhash64("h", "t", F.substring("raw", off - t + 1, t + gram)).alias("h"), "r1", "r2", "start", "off",
            F.substring("raw", F.lit(1), off - t + length).alias("raw"), "settled", F.col("t").alias("lo"), "hi",
        )
        skip = F.greatest(F.lit(0), off - (t - 1))
        near = wide.filter(size >= skip + length).select(
            F.xxhash64("h", -t, F.substring("raw", off + 1, length - t + 1)).alias("h"), "r1", "r2", (F.col("start") + skip).alias("start"), (off - skip).alias("off"),
            F.substring("raw", skip + 1, size).alias("raw"), "settled", "lo", (t - 1).alias("hi"),
        )
        halves = far.unionByName(near)
        alone = halves.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
        now = materialize(halves.join(alone, "h", "left_semi"), "bwt-half", "zstd")
    out = calm[0]
    for x in calm[1:]:
        out = out.unionByName(x)
    return out.select(*columns), found


def narrowed(anchors: list[int], offs: list[int], raws: list[bytes], length: int = LENGTH, parts: int = 4) -> list[tuple[int, int]]:
    """First byte and end of the part of each context whose windows may repeat.

    The windows that reach lo to hi bytes to the left of their anchor share a
    core of bytes about it. If no other context of the anchor has that core,
    none of them repeats. A context without any other such core gets (0, 0).
    """
    out, step = [(0, 0)] * len(raws), -(-length // parts)
    for lo in range(0, length, step):
        hi = lo + step - 1
        own, tally = [], Counter()
        for i, (h, off, raw) in enumerate(zip(anchors, offs, raws, strict=True)):
            least, most = max(lo, length - len(raw) + off), min(hi, off)
            if least <= most:
                core = (h, xxhash.xxh3_64_intdigest(raw[off - lo : off + length - hi]))
                own.append((i, core, off - most, off - least + length))
                tally[core] += 1
        for i, core, first, end in own:
            if tally[core] > 1:
                out[i] = (min(out[i][0], first), max(out[i][1], end)) if out[i][1] else (first, end)
    return out


def resolve(ctx: DataFrame, length: int, bucket_bytes: int = BUCKET) -> DataFrame:
    """Runs of repeated windows of the open contexts: r1, r2, first, end."""
    total = ctx.agg(F.sum(F.octet_length("raw")).alias("b")).first()["b"] or 0
    n = max(1, total // bucket_bytes)

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "r1", "r2", "start"], kind="stable")
        open_ = ~pdf["settled"].to_numpy(dtype=bool)
        starts = pdf["start"].to_numpy()
        out: dict[str, list] = {"r1": [], "r2": [], "first": [], "end": []}
        raws = [bytes(x) for x in pdf["raw"]]
        part = narrowed(pdf["h"].tolist(), pdf["off"].tolist(), raws, length)
        left = [no for no, (_, end) in enumerate(part) if end]
        for no, found in zip(left, repeated_windows([raws[no][slice(*part[no])] for no in left], length), strict=True):
            if open_[no]:
                for lo, hi in (runs(found, length) + part[no][0]).tolist():
                    out["r1"].append(pdf["r1"].iat[no])
                    out["r2"].append(pdf["r2"].iat[no])
                    out["first"].append(lo + starts[no])
                    out["end"].append(hi + starts[no])
        return pd.DataFrame(out).astype({"r1": "int64", "r2": "int64", "first": "int32", "end": "int32"})

    keyed = ctx.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(n)))
    return keyed.groupBy("bucket").applyInPandas(bucket, "r1 bigint, r2 bigint, first int, end int")


# --- texts -------------------------------------------------------------------


def _union(flat: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(flat):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in spans:
        out.append(raw[at:lo])
        at = hi
    return b"".join([*out, raw[at:]])


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<int>"


def _result(doc_id: object, raw: bytes, spans: list[tuple[int, int]]) -> tuple:
    return doc_id, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut(raw, spans)).hexdigest(), [x for s in spans for x in s]


def _frame(rows: list[tuple], columns: str) -> pd.DataFrame:
    names = [c.strip().split()[0] for c in columns.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    out["doc_id"] = pd.array(out["doc_id"].tolist(), dtype="Int64")
    return out


def _id(x: object) -> int | None:
    return None if x is None or x != x else int(x)


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """Columns of RESULT for every row; spans: first byte and end of each
    removed run in turn.

    Null and empty texts have no bytes and keep the hash of none. A text that
    stands twice goes whole, if it has ``length`` bytes; so do repeated rows,
    as each is a document. Which of equal strings came first makes no
    difference, so there are no ties. Null ids stay null; an empty table gives
    no rows. Only doc_id and text are read, so other columns cannot clash. A
    text is one value of a task: its anchors are about a hundredth of its bytes.
    """
    r1, r2 = text_refs(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", r1.alias("r1"), r2.alias("r2"))
    refs = ["r1", "r2"]
    places = classify(anchor_rows(docs, length))
    of_text = places.groupBy(*refs).agg(F.collect_set(F.struct("start", "size", "h", "off", "settled", "open", "sample")).alias("places"))
    # a text that very many rows hold is a hot key
    texts = rows.groupBy(*refs).agg(F.count(F.lit(1)).alias("n"))
    texts = materialize(texts.join(of_text, refs, "left"), "bwt-texts", "zstd")
    rows = join_hot(rows, texts, refs, "n", ["doc_id"])
    full = RESULT + ", r1 bigint, r2 bigint, text string, is_open boolean, ctx array<struct<h:bigint,start:int,off:int,raw:binary,settled:boolean>>"

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, a, c, own in b[["doc_id", "text", "r1", "r2", "places"]].itertuples(index=False):
                raw = (text or "").encode("utf-8", "surrogatepass")
                own = [] if own is None else list(own)
                spans = _union([(p["start"], p["start"] + p["size"]) for p in own if p["settled"]])
                is_open = any(p["open"] for p in own)
                ctx = [{"h": p["h"], "start": p["start"], "off": p["off"], "raw": raw[p["start"] : p["start"] + p["size"]], "settled": p["settled"]} for p in own if p["open"] or p["sample"]]
                done = (_id(doc_id), len(raw), 0, 0, "", [x for s in spans for x in s]) if is_open else _result(_id(doc_id), raw, spans)
                out.append((*done, a, c, text if is_open else None, is_open, ctx))
            yield _frame(out, RESULT + ", r1 b, r2 b, text s, is_open b, ctx c")

    first = materialize(rows.mapInPandas(settle, full), "bwt-settled", "zstd")
    ctx = first.select("r1", "r2", F.explode("ctx").alias("x")).select("r1", "r2", "x.*")
    held = materialize(ctx.dropDuplicates(["h", "r1", "r2", "start"]), "bwt-contexts", "zstd")
    ctx, early = split_crowds(held, length, GRAM, crowd)
    more = resolve(ctx, length)
    for x in early:
        more = more.unionByName(x.select("r1", "r2", F.col("first").cast("int"), F.col("end").cast("int")))
    more = materialize(more, "bwt-more", "zstd")
    release(held)
    more = more.groupBy(*refs).agg(F.collect_set(F.struct("first", "end")).alias("more"))
    left = first.filter("is_open").select("doc_id", "text", "r1", "r2", "spans")
    held = left.groupBy(*refs).agg(F.count(F.lit(1)).alias("n"))
    left = join_hot(left, materialize(held.join(more, refs, "left"), "bwt-open", "zstd"), refs, "n", ["doc_id"]).select("doc_id", "text", "spans", "more")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, flat, own in b.itertuples(index=False):
                raw, flat = (text or "").encode("utf-8", "surrogatepass"), [int(x) for x in flat]
                own = [] if own is None else [(p["first"], p["end"]) for p in own]
                out.append(_result(_id(doc_id), raw, _union([*zip(flat[::2], flat[1::2], strict=True), *own])))
            yield _frame(out, RESULT)

    return first.filter("not is_open").select(*[c.split()[0] for c in RESULT.split(", ")]).unionByName(left.mapInPandas(finish, RESULT))
