"""Operators 1, 5, 6 and 10 against brute force and on odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from cutweave.llm import positional_index, quality, queries, sharding, simhash

ODD = [
    (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (None, "x"), (None, None), (4, ""), (5, "   \n\t "), (6, "Ärger über STRASSE ß 123"),
    (7, "word " * 30_000), (8, "a b c d e f h"), (1, "a b c d e f g"), (9, "\u2028é\u00a0b \x1f c"),
]


def odd(spark):
    rows = [(i, t, "en", "s", 7, 0.5, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string")


def words5(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words5(t)
        for p in [tuple(w)] if 0 < len(w) <= 13 else [tuple(w[k : k + 13]) for k in range(len(w) - 12)]:
            if p:
                windows[p].add("" if i is None else str(i))
    sizes = sorted({len(p) for p in windows})
    out = []
    for d, t in docs:
        w = words5(t)
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                own = windows.get(tuple(w[k : k + size]))
                if own:
                    hit.update(range(k, k + size))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


FIVE = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_op5_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert plain(queries.op5_positional_index(spark, sf_dir), *FIVE) == contamination(docs, items)


def test_op5_odd_rows_and_many_blocks(spark, monkeypatch):
    items = [(1, "c d e"), (2, ""), (3, None), (None, "word word"), (4, "é b"), (5, "123 " * 20), (6, "ärger ÜBER strasse")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = odd(spark)
    want = contamination(ODD, items)
    assert plain(positional_index.decontaminate(docs, bench), *FIVE) == want
    monkeypatch.setattr(positional_index.phrase_blocks, "__defaults__", (13, 4))
    assert plain(positional_index.decontaminate(docs, bench), *FIVE) == want
    kept = positional_index.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert plain(kept, "doc_id", "text") == sorted([(d[0], t) for d, t in zip(contamination_by_row(ODD, items), [t for _, t in ODD], strict=True) if not d[1]], key=str)
    assert positional_index.decontaminate(docs.limit(0), bench).count() == 0
    assert plain(positional_index.decontaminate(docs, bench.limit(0)), "n_hit") == [(0,)] * len(ODD)


def contamination_by_row(docs, items):
    return [(d, contamination([(d, t)], items)[0][5]) for d, t in docs]


def test_phrase_and_proximity():
    seg = positional_index.index_texts(["the cat sat on the mat", "mat the cat"], None, 14)
    found = dict(positional_index.find_exact(seg, [(b"the", b"cat"), (b"the", b"mat"), (b"cat", b"mat")]))
    assert {k: v.tolist() for k, v in found.items()} == {0: [0, 21], 1: [4]}
    assert positional_index.find_near(seg, (b"mat", b"cat"), 1).tolist() == [20]
    assert positional_index.find_near(seg, (b"mat", b"cat"), 3).tolist() == [1, 20]
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**40])
    assert positional_index.decode_varints(positional_index.encode_varints(x)).tolist() == x.tolist()


def words6(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def simhash_brute(text):
    w = words6(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(rows):
    fps = sorted({f for _, f in rows})
    arr = np.array(fps, dtype=np.uint64)
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ np.uint64(f)) <= 4):
            a, b = find(f), find(fps[i + 1 + int(j)])
            parent[max(a, b)] = min(a, b)
    least = defaultdict(lambda: None)
    for d, f in rows:
        r = find(f)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return [(d, f"{f:016x}", least[find(f)]) for d, f in rows]


def test_op6_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = components_brute([(r["doc_id"], simhash_brute(r["text"])) for r in docs])
    assert plain(queries.op6_simhash_vptree(spark, sf_dir), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)


def test_op6_odd_rows(spark):
    docs = odd(spark)
    want = components_brute([(i, simhash_brute(t)) for i, t in ODD])
    got = simhash.near_duplicates(docs).withColumn("h", simhash.hex16(simhash.F.col("fp")))
    assert plain(got, "doc_id", "h", "component_id") == sorted(want, key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 in ids and 4 not in ids and 5 not in ids and 6 in ids
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_vantage_trees_find_every_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 1200).astype(np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in {*rng.integers(0, 64, rng.integers(1, 7))})) for b in base[:200] for _ in range(4)]
    x = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64)]))
    want = components_brute([(i, int(f)) for i, f in enumerate(x.tolist())])
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp bigint").repartition(5).cache()
    for leaf, sample, residents in ((60, 500, 1 << 20), (10**6, 10**6, 1 << 20), (60, 10, 40)):  # in the last a leaf is dealt in parts
        edges = [(int(np.int64(r["a"]).view(np.uint64)), int(np.int64(r["b"]).view(np.uint64))) for r in simhash.link_forest(fps, 4, leaf, sample, residents).collect()]
        parent = {int(f): int(f) for f in x}

        def find(f, parent=parent):
            while parent[f] != f:
                f = parent[f]
            return f

        for a, b in edges:
            assert (a ^ b).bit_count() <= 4 or leaf < 10**9
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        groups = defaultdict(set)
        for i, f in enumerate(x.tolist()):
            groups[find(f)].add(i)
        wanted = defaultdict(set)
        for d, _, c in want:
            wanted[c].add(d)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 0.85), ("sf0.01", 0.97)])
def test_op1_separates_held_out_rows(spark, sf_dir, sf, least):
    sf_dir = os.path.join(os.path.dirname(sf_dir), sf)
    got = {r["doc_id"]: r for r in queries.op1_quality_qda(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    right = total = 0
    for r in labels:
        row = got[r["doc_id"]]
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.3)
        if row["held_out"]:
            total += 1
            right += row["predicted"] == r["quality"]
    assert right >= least * total


def test_op1_scores_equal_a_plain_discriminant(spark, sf_dir):
    docs = {r["doc_id"]: quality.statistics(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    own = [(docs[i], c) for i, c in labels if c in (0, 1) and i in docs and zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([s for s, _ in own]), np.array([c for _, c in own])
    n, d = [int((y == c).sum()) for c in (0, 1)], x.shape[1]
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / len(y)
    side = []
    for c in (0, 1):
        pull = 0.1 + 0.88 * d / (d + n[c])
        s = (0.98 - pull) * cov[c] + pull * pooled + 0.02 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        z = np.array(list(docs.values())) - x[y == c].mean(0)
        side.append(np.log((n[c] + 1) / (len(y) + 2)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    gap = dict(zip(docs, side[1] - side[0], strict=True))
    got = {r["doc_id"]: r["score"] for r in queries.op1_quality_qda(spark, sf_dir).collect()}
    stats = spark.createDataFrame([(i, v) for i, v in docs.items()], "doc_id bigint, x array<double>")
    model = quality.train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert model.slope > 0 and np.allclose(model.difference(np.array(list(docs.values()))), list(gap.values()), rtol=1e-6, atol=1e-6)
    for i, s in got.items():
        assert abs(s - 1 / (1 + np.exp(-np.clip(model.slope * gap[i] + model.offset, -500, 500)))) < 1e-6


def test_op1_query_on_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (8, 0), (None, 1), (4, None), (77, 0)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op1_quality_qda(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((i for i, _ in ODD), key=str)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_op1_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 0), (6, 0), (7, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(ODD)
    none = quality.keep_good(docs, labels.limit(0))
    assert none.count() == len(ODD)  # without labels every score is 0.5
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.filter("quality = 1")).count() > 0


def check_shards(rows, texts, n=16):
    loads, slots, shard_of = defaultdict(int), defaultdict(list), {}
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for s, own in slots.items():
        assert 0 <= s < n and sorted(own) == list(range(len(own)))
    for r in rows:
        for t in texts[r["doc_id"]]:
            if len((t or "").encode()) + 1 == r["size"] and zlib.crc32((t or "").encode()) == r["text_crc32"]:
                shard_of.setdefault((t,), set()).add(r["shard"])
    return loads, shard_of


def test_op10_keeps_groups_together_and_loads_even(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op10_lpt_shards(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs)
    texts = defaultdict(set)
    for r in docs:
        texts[r["doc_id"]].add(r["text"])
    loads, shard_of = check_shards(rows, texts)
    assert all(len(s) == 1 for s in shard_of.values())
    sizes = defaultdict(int)
    for r in docs:
        sizes[r["text"]] += len(r["text"].encode()) + 1
    want = [0] * 16
    for s in sorted(sizes.values(), reverse=True):
        want[want.index(min(want))] += s
    assert max(loads.values()) <= 1.03 * max(want)


def test_op10_odd_rows(spark):
    rows = sharding.shard_documents(odd(spark), 4).collect()
    assert len(rows) == len(ODD) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    texts = defaultdict(set)
    for i, t in ODD:
        texts[i].add(t)
    check_shards(rows, texts, 4)
    assert len({r["shard"] for r in rows if r["size"] == 1 and r["doc_id"] == 3} | {r["shard"] for r in rows if r["size"] == 1 and r["doc_id"] is None}) == 1
    assert sharding.shard_documents(odd(spark).limit(0), 4).count() == 0


def test_whole_classes_are_dealt_as_the_heap_would():
    rng = np.random.default_rng(3)
    for _ in range(200):
        loads = rng.integers(0, 1000, rng.integers(1, 9)).astype(float).tolist()
        n, size = int(rng.integers(0, 300)), float(rng.integers(1, 50))
        want, now = [0] * len(loads), list(loads)
        for _ in range(n):
            i = now.index(min(now))
            now[i] += size
            want[i] += 1
        got = sharding.place_equal(loads, n, size)
        assert sum(got) == n
        assert sorted(x + c * size for x, c in zip(loads, got, strict=True)) == sorted(now)


def near_brute(words, phrase, slop):
    out = []
    for i, w in enumerate(words):
        for j in range(i + 1, min(len(words), i + len(phrase) + slop) + 1):
            if w in phrase and not Counter(phrase) - Counter(words[i:j]):
                out.append((i, j))
                break
    return out


def test_op5_proximity_equals_brute_force(spark):
    rng = random.Random(9)
    text = lambda lo, hi: " ".join(rng.choices("abcdefgh", k=rng.randint(lo, hi)))
    docs = [(i, text(0, 40)) for i in range(60)] + [(60, None), (None, "a b c d a")]
    items = [("x", "a b a"), ("y", "h g f e d"), ("z", "a q"), ("w", text(7, 7)), ("v", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string")
    for slop in (0, 3, 30):  # 30: more than the gap between documents
        want = {(d, i, lo, hi) for d, t in docs for i, q in items for p in positional_index.windows_of(q.split(), 5) for lo, hi in near_brute((t or "").split(), p, slop)}
        got = [tuple(r) for r in positional_index.proximity(df, asked, slop, 5).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
