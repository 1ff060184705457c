"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutweave.llm import additive_quantization, bwt_dedup, chaining, merkle, mixing, positional_index, quality, sharding, simhash, url_filter
from cutweave.llm.common import materialize
from cutweave.llm.url_filter import Rule


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: quality ------------------------------------------------------------


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats, x = quality.with_statistics(docs)
    stats = materialize(stats.select("doc_id", F.col(x).alias("x")), "quality")
    model = quality.train(stats, table(spark, sf_dir, "labels"))
    scored = quality.with_score(stats, model, "x", "score")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


# --- 2: WARC ---------------------------------------------------------------


def rotten(record: Column) -> Column:
    """A record of the replica that op2 audits: of every 97 page ids one's last byte is another."""
    return F.when(F.col("page_id") % 97 == 5, F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.lit("?"))).otherwise(record)


def not_lost() -> Column:
    """Of every 193 page ids the replica lacks one's records."""
    return F.coalesce(F.col("page_id") % 193 != 7, F.lit(True))


def bit_rot(records: DataFrame) -> DataFrame:
    return records.withColumn("record", rotten(F.col("record"))).filter(not_lost())


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stores are hashed where they are read, so only digests are
    shuffled; the replica was packed by itself, after its loss."""
    records = merkle.stored(table(spark, sf_dir, "pages"))
    hashed = records.select("page_id", "file_no", F.octet_length("record").cast("bigint").alias("rec_length"), F.sha2("record", 256).alias("digest"), F.sha2(rotten(F.col("record")), 256).alias("copy_digest"))
    hashed = materialize(hashed, "merkle-hashed")
    copy = hashed.filter(not_lost()).drop("digest").withColumnRenamed("copy_digest", "digest")
    own, copy = (materialize(merkle.placed(x), "merkle-placed") for x in (hashed.drop("copy_digest"), copy))
    return merkle.audit(own, copy)


OP2_SQL = r"""
WITH r AS (
  SELECT page_id, page_id // 1000 AS file_no,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id::VARCHAR
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, ''))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
o AS (
  SELECT *, strlen(record)::BIGINT AS rec_length,
    coalesce(sum(strlen(record)) OVER (PARTITION BY file_no ORDER BY page_id, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rec_offset
  FROM r)
SELECT page_id, file_no, rec_offset, rec_length,
  CASE WHEN page_id % 193 = 7 THEN 'missing' ELSE 'altered' END AS status,
  sha256(record) AS digest_a,
  CASE WHEN page_id % 193 = 7 THEN NULL ELSE sha256(substring(record, 1, length(record) - 1) || '?') END AS digest_b
FROM o WHERE page_id % 193 = 7 OR page_id % 97 = 5
"""

# --- 3: fuzzy passages -----------------------------------------------------


def op3_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents"))


# --- 4: repeated bytes -----------------------------------------------------


def op4_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


# --- 5: benchmark decontamination ------------------------------------------


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("hit_spans", "hit_items")


# --- 6: SimHash -------------------------------------------------------------


def op6_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


# --- 7: mixing -------------------------------------------------------------


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.replicate(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "source", F.round("source_rate", 9).alias("source_rate"), "replica", "mix_key")


OP7_SQL = r"""
WITH n AS (SELECT source, count(*) AS n_docs, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n_docs) FROM n)::DOUBLE * w / (SELECT sum(w) FROM n) / n_docs AS rate FROM n),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT + 1)) AS k FROM r),
p AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - coalesce(lgamma(k + 1), 0)) AS p FROM k),
c AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT doc_id, source, ('0x' || substring(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM documents),
d AS (SELECT u.doc_id, u.source, c.rate, count(*) FILTER (WHERE c.cdf <= u.u) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL),
e AS (SELECT doc_id, source, rate, unnest(range(0, n)) AS replica FROM d)
SELECT doc_id, source, round(rate, 9) AS source_rate, replica::INTEGER AS replica,
  md5('42-shuffle:' || coalesce(doc_id::VARCHAR, '') || ':' || replica::VARCHAR) AS mix_key FROM e
"""

# --- 8: nearest neighbours --------------------------------------------------


def op8_additive_quantization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quantization.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


# --- 9: URL filter ---------------------------------------------------------

URL_RULES = [
    Rule.domain("com/", "allow"),
    Rule.domain("example.com/en/", "block"),
    Rule.domain("www.example.com/en/", "allow"),
    Rule.domain("net/es/", "block"),
    Rule.domain("net/fr/", "block"),
    # What no named rule judges is blocked if its host tells what it sells.
    *(Rule(f"||{x}.", "block") for x in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule_host, rule_path, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT page_id, host, path,
    arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(v, length(rule_host || rule_path)) AS v
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN regexp_matches(host || path, '^([^/]*[.])?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]') THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""

# --- 10: sharding ----------------------------------------------------------


def op10_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_qda": op1_quality_qda,
        "op2_merkle_audit": op2_merkle_audit,
        "op3_collinear_chains": op3_collinear_chains,
        "op4_bwt_dedup": op4_bwt_dedup,
        "op5_positional_index": op5_positional_index,
        "op6_simhash_vptree": op6_simhash_vptree,
        "op7_poisson_mix": op7_poisson_mix,
        "op8_additive_quantization": op8_additive_quantization,
        "op9_url_filter": op9_url_filter,
        "op10_lpt_shards": op10_lpt_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_merkle_audit": OP2_SQL, "op7_poisson_mix": OP7_SQL, "op9_url_filter": OP9_SQL}
