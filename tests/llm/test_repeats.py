"""Operators 4 and 8 against brute force and on odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash

from cutweave.llm import additive_quantization, bwt_dedup, queries


def cut_brute(docs, length):
    raws = [(i, (t or "").encode()) for i, t in docs]
    window = lambda b, i: xxhash.xxh3_128_digest(b[i : i + length])
    n = Counter(window(b, i) for _, b in raws for i in range(len(b) - length + 1))
    out = []
    for doc_id, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[window(b, i)] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def plain(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


def test_merged_transforms_find_all_repeats():
    rng = random.Random(2)
    for trial in range(80):
        length = rng.choice([8, 16, 24])
        strings = [bytes(rng.choices(b"ab" if trial % 2 else b"abcd", k=rng.randint(length, 60))) for _ in range(rng.randint(1, 30))]
        if trial % 3 == 0:
            strings += strings[:3]
        n = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[i for i in range(len(s) - length + 1) if n[s[i : i + length]] > 1] for s in strings]
        assert [x.tolist() for x in bwt_dedup.repeated_windows(strings, length, rng.choice([50, 200, 10_000]))] == want


def test_shards_are_ordered_to_the_end():
    rng = random.Random(8)
    for _ in range(400):
        # long strings that share 16 bytes and more, and then differ
        head = bytes(rng.choices(b"abcdef", k=rng.randint(16, 40)))
        strings = [head + bytes(rng.choices(b"abcdef", k=rng.randint(8, 30))) for _ in range(rng.randint(2, 6))]
        shard = bwt_dedup.Shard(strings, list(range(len(strings))))
        rest = [strings[k][i:] for k, i in zip(shard.string[shard.order].tolist(), shard.offset[shard.order].tolist(), strict=True)]
        long = [x for x in rest if len(x) >= bwt_dedup.STEP]
        assert rest[len(rest) - len(long) :] == long
        # whole steps of bytes, the end of a string before all else
        whole = [tuple(x[i : i + 8] if len(x) >= i + 8 else b"" for i in range(0, len(x) + 1, 8)) for x in long]
        assert whole == sorted(whole)


def test_op4_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert max(len(t) for _, t in docs) > 15_000  # whole texts, the longest too
    assert plain(queries.op4_bwt_dedup(spark, sf_dir)) == cut_brute(docs, 200)


def test_parts_of_contexts_that_cannot_repeat_are_left_out():
    rng = random.Random(11)
    for trial in range(200):
        length, gram = 40, 8
        head, core, tail = (bytes(rng.choices(b"abc", k=k)) for k in (40, gram, 40))
        offs, raws = [], []
        for _ in range(rng.randint(1, 8)):
            left, right = rng.randint(0, 32), rng.randint(0, 32)
            raw = bytearray(head[40 - left :] + core + tail[:right])
            if len(raw) < length:
                continue
            for _ in range(rng.randint(0, 2)):
                raw[rng.randrange(len(raw))] = 100
            offs.append(left)
            raws.append(bytes(raw))
        part = bwt_dedup.narrowed([1] * len(raws), offs, raws, length)
        n = Counter((o - i, r[i : i + length]) for o, r in zip(offs, raws, strict=True) for i in range(len(r) - length + 1))
        for o, r, (lo, hi) in zip(offs, raws, part, strict=True):
            assert all(lo <= i and i + length <= hi for i in range(len(r) - length + 1) if n[(o - i, r[i : i + length])] > 1)


def made_up(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(90))
    docs = [(None, None), (1, ""), (2, passage), (2, passage), (3, "x" * 450), (4, passage[:199]), (5, "y" * 200)]
    for i in range(60):
        own = " ".join(word() for _ in range(rng.randint(5, 120)))
        lo = rng.randint(0, 250)
        part = passage[lo : lo + rng.randint(150, 400)]
        if i % 3 == 0:
            k = rng.randint(0, len(part) - 1)
            part = part[:k] + "#" + part[k + 1 :]
        docs.append((100 + i, own + part + own[::-1]))
    return docs


def test_op4_odd_rows_and_crowded_anchors(spark):
    for seed, crowd in ((1, 3), (2, 8)):
        docs = made_up(seed)
        df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id bigint, text string, spans string").repartition(7)
        want = cut_brute(docs, 200)
        assert plain(bwt_dedup.remove_repeats(df, crowd=crowd)) == want
    assert plain(bwt_dedup.remove_repeats(df)) == want
    assert bwt_dedup.remove_repeats(df.limit(0)).count() == 0


def nearest(rows, k, every):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == len(rows[0][1]):
            seen[(i, tuple(v))] = np.array(v, dtype=np.float32).astype(float)
    out = []
    for (q, _), x in sorted(seen.items()):
        if q % every == 0:
            scored = sorted((-float(x @ y), i) for (i, _), y in seen.items() if i != q)[:k]
            out += [(q, r + 1, i, round(-s, 6)) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def answers(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in df.collect())


def test_op8_finds_the_nearest(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = answers(queries.op8_additive_quantization(spark, sf_dir)), nearest(rows, 20, 20)
    assert got == want


def test_op8_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    hot = rows[7][1]
    rows += [(1000 + i, hot) for i in range(200)]
    nan, inf = float("nan"), float("inf")
    rows += [(20, None), (None, hot), (40, [0.0] * 8), (60, [nan] * 8), (80, [inf, *[1.0] * 7]), (2000, [1.0, 2.0]), (2020, []), (2040, [None] * 8), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, ids int").repartition(4)
    want = nearest(rows, 20, 20)
    assert answers(additive_quantization.search(df)) == want
    monkeypatch.setattr(additive_quantization, "BLOCK", 7)
    assert answers(additive_quantization.search(df)) == want
    small = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert answers(additive_quantization.search(small)) == [(0, 1, 1, 1.0)]
    assert additive_quantization.search(df.limit(0)).count() == 0


def test_op8_ties_go_to_smaller_ids(spark):
    # far more distinct vectors than k tie for each query, and arrive by falling ids
    rows = [(i, [1.0, *(float(i >> b & 1) for b in range(9))]) for i in range(1, 400)]
    rows = [(0, [1.0, *[0.0] * 9])] + rows
    df = spark.createDataFrame(rows[::-1], "vec_id bigint, embedding array<float>").coalesce(1)
    assert answers(additive_quantization.search(df)) == nearest(rows, 20, 20)
