"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the mixture,
divided by its share of the corpus. Each document draws a number of copies
from a Poisson distribution with that mean, by inverting the distribution at
a uniform number hashed from the seed and the document's id. The draws need
no coordination, are the same on every run, and hit the targets in
expectation with relative error falling as 1/sqrt(documents).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutweave.llm.common import fresh



def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """One row a source: source, n_docs, rate.

    ``weights``: relative target weight of each source; sources not named
    get 0. None: the square root of its document count, which lifts small
    sources. ``epochs``: size of the mixture as a multiple of the corpus.
    A null source is a source like any other.
    """
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        n = n.withColumn("w", F.sqrt(F.col("n_docs").cast("double")))
    else:
        w = F.lit(0.0)
        for name, x in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(x))).otherwise(w)
        n = n.withColumn("w", w)
    total = n.agg(F.sum("n_docs").alias("all_docs"), F.sum("w").alias("all_w"))  # one row
    rate = F.lit(float(epochs)) * F.col("all_docs") * F.col("w") / F.col("all_w") / F.col("n_docs")
    return n.crossJoin(F.broadcast(total)).select("source", "n_docs", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_table(rate: float) -> np.ndarray:
    """P(X <= k) for k = 0, 1, ... until the tail is below what a double
    shows; from logarithms, so that a large rate does not underflow."""
    if not rate > 0:
        return np.ones(1)
    k = np.arange(1, math.ceil(rate + 12 * math.sqrt(rate) + 24) + 1)
    return np.cumsum(np.exp(-rate + np.concatenate([[0.0], np.cumsum(math.log(rate) - np.log(k))])))


def with_tables(rates: DataFrame, rate: str, cdf: str) -> DataFrame:
    """Adds the table of each row's rate, once a source; its length is about
    that of a document's copies."""
    schema = T.StructType([*rates.schema.fields, T.StructField(cdf, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{cdf: [poisson_table(x) for x in b[rate]]})

    return rates.mapInPandas(run, schema)


def uniform(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) of 52 bits from an MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """The mixture: all columns of ``docs`` and source_rate, replica (from 0),
    mix_key; rows are dealt to partitions by the hash ``mix_key`` and ordered
    by it within them, which is a global shuffle.

    The rates are a row a source, joined by source; a source that holds much
    of the corpus is split by Spark's skew handling, as the rates' side is
    small. A null id draws as an empty one; repeated rows draw alike, each
    giving its own copies. An empty table gives an empty mixture. Names that
    clash with the new ones get the new ones underscored. Texts are carried,
    never read: their length makes no difference. Ties cannot arise, as equal
    rows draw alike; they are spread over partitions by where they come from.
    """
    rate, replica, key = fresh(docs, "source_rate", "replica", "mix_key")
    src, cdf, u, salt = fresh(docs, "__mix_source", "__mix_cdf", "__mix_u", "__mix_salt")
    rates = source_rates(docs.select("source"), weights, epochs)
    rates = with_tables(rates.select(F.col("source").alias(src), F.col("rate").alias(rate)), rate, cdf)
    drawn = docs.withColumn(u, uniform(F.col(id_col), seed)).withColumn(salt, F.when(F.col(id_col).isNull(), F.spark_partition_id()).otherwise(0)).join(rates, F.col("source").eqNullSafe(F.col(src)))
    n = F.size(F.filter(F.col(cdf), lambda c: c <= F.col(u)))
    drawn = drawn.withColumn(replica, n).drop(cdf, u, src).filter(F.col(replica) > 0)
    copies = drawn.withColumn(replica, F.explode(F.sequence(F.lit(0), F.col(replica) - 1)))
    text = F.concat_ws(":", F.lit(f"{seed}-shuffle"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(replica).cast("string"))
    # null ids share their keys, however many they are
    return copies.withColumn(key, F.md5(text)).repartition(key, salt).sortWithinPartitions(key).drop(salt)
