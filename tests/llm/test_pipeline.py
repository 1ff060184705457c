"""The pipeline, stage by stage, against a plain version."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import numpy as np
from test_documents import ODD, components_brute, contamination, odd, simhash_brute

from cutweave.llm import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=str)


def mixed(rows, seed=42):
    n = Counter(r[3] for r in rows)
    w = {s: math.sqrt(k) for s, k in n.items()}
    out = []
    for r in rows:
        rate = len(rows) * w[r[3]] / sum(w.values()) / n[r[3]]
        u = int(hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, cdf = 0, math.exp(-rate), math.exp(-rate)
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        out += [r] * k
    return sorted(out, key=str)


def test_stages_equal_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.quality_stage(spark, docs, sf_dir).cache()
    stats = docs.select("doc_id", quality.statistics_udf("text").alias("x")).cache()
    model = quality.train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r["doc_id"]: model.score(np.array([r["x"]]))[0] for r in stats.collect()}
    rows = [r for r in rows_of(docs) if scores[r[0]] >= 0.3]
    assert rows_of(good) == rows and len(rows) < docs.count()

    one = corpus_pipeline.near_dedup_stage(spark, good, sf_dir).cache()
    head = {d: c for d, _, c in components_brute([(r[0], simhash_brute(r[1])) for r in rows])}
    rows = [r for r in rows if head[r[0]] == r[0]]
    assert rows_of(one) == rows

    clean = corpus_pipeline.decontamination_stage(spark, one, sf_dir).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in contamination([r[:2] for r in rows], items) if r[5]}
    rows = [r for r in rows if r[0] not in bad]
    assert rows_of(clean) == rows and bad

    mix = corpus_pipeline.mixing_stage(spark, clean, sf_dir).cache()
    rows = mixed(rows)
    assert rows_of(mix) == rows

    shards = corpus_pipeline.sharding_stage(spark, mix, sf_dir).collect()
    assert Counter(r["doc_id"] for r in shards) == Counter(r[0] for r in rows)
    assert len(corpus_pipeline.run(spark, sf_dir).collect()) == len(rows)


def test_stages_bear_odd_rows_and_empty_tables(spark, sf_dir):
    for docs in (odd(spark), odd(spark).limit(0)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir).cache()
            assert docs.columns == columns and docs.count() <= 4 * len(ODD)
        assert corpus_pipeline.sharding_stage(spark, docs, sf_dir).count() == docs.count()
