"""Nearest neighbours by inner product through additive quantisation.

Vectors are written as sums of codewords, one from each of full-dimensional
residual codebooks; the sum is searched with a beam. A query scores a vector
by adding one number a codebook, looked up in its table; the best are scored
exactly on the original vectors. Stored with each code are the norm of the
sum and that of what it leaves out, which bounds how far a looked-up score
can be off: vectors that could still be among the nearest by that bound, but
are not among the first candidates, are scored exactly too.

Equal vectors are one entry of the index, with their smallest ids: a vector
that a third of the rows hold does not crowd out others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutweave.llm.common import join_hot, materialize, shared_root

BOOKS, WORDS, BEAM = 8, 256, 4
#: Vectors that the codebooks are fitted on, at most about.
SAMPLE = 16384
#: Queries that are searched in one pass over the index, at most about.
BLOCK = 8192
#: First candidates of each query in each batch of the index.
CANDIDATES = 128


@dataclass
class Codebooks:
    words: np.ndarray  # (books, words, dimensions)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, books): the best of ``beam`` partial sums after each book."""
        n, books = len(x), len(self.words)
        out = np.zeros((n, books), dtype=np.uint8)
        for lo in range(0, n, 512):
            part = x[lo : lo + 512]
            left = part[:, None, :]
            codes = np.zeros((len(part), 1, 0), dtype=np.uint8)
            for m in range(books):
                w = self.words[m]
                cost = (left**2).sum(-1)[:, :, None] - 2 * left @ w.T + (w**2).sum(-1)[None, None, :]
                flat = cost.reshape(len(part), -1)
                k = min(beam, flat.shape[1])
                best = np.argpartition(flat, k - 1, axis=1)[:, :k] if k < flat.shape[1] else np.tile(np.arange(k), (len(part), 1))
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
                b, c = np.divmod(best, len(w))
                rows = np.arange(len(part))[:, None]
                left = left[rows, b] - w[c]
                codes = np.concatenate([codes[rows, b], c[:, :, None].astype(np.uint8)], axis=2)
            out[lo : lo + 512] = codes[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, books, words): what each codeword adds to a query's score."""
        return np.einsum("qd,mwd->qmw", queries, self.words)


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 7) -> Codebooks:
    """Residual k-means; always gives ``books`` books, of as many words as the
    sample has rows if that is fewer."""
    rng = np.random.default_rng(seed)
    left, out = sample.astype(np.float64), []
    k = max(1, min(words, len(sample)))
    for _ in range(books):
        w = left[rng.choice(len(left), k, replace=False)].copy() if len(left) else np.zeros((k, sample.shape[1]))
        for _ in range(rounds if len(left) else 0):
            near = np.argmin((w**2).sum(1) - 2 * left @ w.T, axis=1)
            count = np.bincount(near, minlength=k)
            total = np.zeros_like(w)
            np.add.at(total, near, left)
            w[count > 0] = total[count > 0] / count[count > 0, None]
        out.append(w)
        if len(left):
            left = left - w[np.argmin((w**2).sum(1) - 2 * left @ w.T, axis=1)]
    return Codebooks(np.stack(out))


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, h1, h2) of the rows that take part: not of null id, null,
    zero, or with null or non-finite components, and of the commonest length
    (ties: the longer). A row that stands twice counts once."""
    v = F.col(vec_col)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull())
    rows = rows.filter(~bad).filter(F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.filter(F.size("v") == (size["n"] if size else 0))
    return rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"))


def build_index(rows: DataFrame, k: int) -> tuple[DataFrame, Codebooks | None]:
    """One entry for each distinct vector: h1, h2, ids (the ``k`` + 1
    smallest), v, codes, norm, error; and the codebooks.

    The sample: vectors whose hash is 0 modulo count / SAMPLE.
    """
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = rows.dropDuplicates(["h1", "h2", "vec_id"]).withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    entries = materialize(few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")), "aq-entries")
    n = entries.count()
    if not n:
        return entries, None
    keep = F.pmod(F.col("h1"), F.lit(max(1, n // SAMPLE))) == 0
    sample = np.array([r["v"] for r in entries.filter(keep).orderBy("h1", "h2").select("v").collect()], dtype=np.float64)
    if not len(sample):
        sample = np.array([entries.orderBy("h1", "h2").first()["v"]], dtype=np.float64)
    books = fit(sample)
    sent = rows.sparkSession.sparkContext.broadcast(books)  # BOOKS x WORDS vectors

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["v"].tolist(), dtype=np.float64)
            codes = sent.value.encode(x)
            near = sent.value.decode(codes)
            yield b.assign(codes=[c.tobytes() for c in codes], norm=np.sqrt((near**2).sum(1)), error=np.sqrt(((x - near) ** 2).sum(1)))

    extra = [T.StructField("codes", T.BinaryType()), T.StructField("norm", T.DoubleType()), T.StructField("error", T.DoubleType())]
    schema = T.StructType([*entries.schema.fields, *extra])
    return materialize(entries.mapInPandas(encode, schema), "aq-index"), books


class Best:
    """The ``k`` best entries of each query so far; of equal scores those of
    the smallest ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.entry = np.zeros((n, k, 2), dtype=np.int64)  # the hashes that name it
        self.least = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, lo: int, score: np.ndarray, entry: np.ndarray, least: np.ndarray) -> None:
        """Rows of candidates, each with its name and smallest id, for the
        queries from ``lo`` on."""
        hi = lo + len(score)
        s = np.concatenate([self.score[lo:hi], score], axis=1)
        e = np.concatenate([self.entry[lo:hi], entry], axis=1)
        i = np.concatenate([self.least[lo:hi], least], axis=1)
        top = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[lo:hi], self.least[lo:hi] = (np.take_along_axis(x, top, 1) for x in (s, i))
        self.entry[lo:hi] = np.take_along_axis(e, top[:, :, None], 1)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, of each row of q with its rows of x."""
    return np.einsum("qd,qcd->qc", q, x)


def search_batch(books: Codebooks, q: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, least: np.ndarray, names: np.ndarray, best: Best, candidates: int = CANDIDATES) -> int:
    """Scores a batch of entries, named ``names`` (rows h1, h2) and with
    ``least`` as their smallest ids, for all queries. Returns how many scores
    beyond the first candidates' were exact ones, as the bound left them open."""
    n_open = 0
    reach = np.sqrt((q**2).sum(1))
    for lo in range(0, len(q), 128):
        part = q[lo : lo + 128]
        table = books.tables(part)
        rough = np.zeros((len(part), len(x)))
        for m in range(codes.shape[1]):
            rough += table[:, m][:, codes[:, m]]
        c = min(candidates, len(x))
        top = np.argpartition(-rough, c - 1, axis=1)[:, :c] if c < len(x) else np.tile(np.arange(c), (len(part), 1))
        best.add(lo, exact_scores(part, x[top]), names[top], least[top])
        if c == len(x):
            continue
        # the bound, with room for rounding: what could still beat the k-th best
        need = best.score[lo : lo + len(part), -1]
        rough += reach[lo : lo + len(part), None] * error[None, :] * (1 + 1e-9) + 1e-9
        np.put_along_axis(rough, top, -np.inf, 1)
        for i in np.flatnonzero((rough >= need[:, None]).any(axis=1)).tolist():
            more = np.flatnonzero(rough[i] >= need[i])
            best.add(lo + i, exact_scores(part[i : i + 1], x[more][None]), names[more][None], least[more][None])
            n_open += len(more)
    return n_open


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` nearest rows of each row whose id is divisible by ``every``:
    query_id, rank (from 1), vec_id, score.

    Nearest: largest inner product; ties go to the smaller id; a row is no
    neighbour of its own id. Fewer than ``k`` others: all of them. No usable
    rows: no result.
    """
    rows = materialize(usable(vectors), "aq-rows")
    index, books = build_index(rows, k)
    spark = vectors.sparkSession
    if books is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "h1", "h2")
    queries = materialize(index.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v"), "aq-queries")
    n_blocks = -(-queries.count() // BLOCK)
    sent_books = spark.sparkContext.broadcast(books)
    schema, path = "h1 bigint, h2 bigint, score double, e1 bigint, e2 bigint, least bigint", f"{shared_root(spark)}/cutweave/aq-found-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in range(n_blocks):  # each pass is stored: the driver holds one block, and the plan none
        own = queries.filter(F.pmod(F.xxhash64("h2"), F.lit(n_blocks)) == block).orderBy("h1", "h2").collect()
        if not own:
            continue
        sent = spark.sparkContext.broadcast((np.array([(r["h1"], r["h2"]) for r in own], dtype=np.int64), np.array([r["v"] for r in own], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            keys, q = sent.value
            best = Best(len(q), k + 1)
            for b in batches:
                x = np.array(b["v"].tolist(), dtype=np.float64)
                codes = np.frombuffer(b"".join(b["codes"]), dtype=np.uint8).reshape(len(b), -1)
                search_batch(sent_books.value, q, x, codes, b["error"].to_numpy(), b["least"].to_numpy(), b[["h1", "h2"]].to_numpy(), best)
            for lo in range(0, len(q), 1024):
                score, entry, least = best.score[lo : lo + 1024], best.entry[lo : lo + 1024], best.least[lo : lo + 1024]
                i, j = np.nonzero(score > -np.inf)
                yield pd.DataFrame({"h1": keys[lo + i, 0], "h2": keys[lo + i, 1], "score": score[i, j], "e1": entry[i, j, 0], "e2": entry[i, j, 1], "least": least[i, j]})

        index.select("h1", "h2", F.col("ids")[0].alias("least"), "v", "codes", "error").mapInPandas(run, schema).write.mode("append").parquet(path)
        sent.destroy()
    near = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "least")
    found = spark.read.schema(schema).parquet(path).withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1).drop("r", "least")
    found = materialize(found, "aq-best")
    met = found.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n"))
    ids = materialize(index.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), "ids").join(met, ["e1", "e2"]), "aq-ids")
    member = join_hot(found, ids, ["e1", "e2"], "n", ["h1", "h2"]).select("h1", "h2", "score", F.explode("ids").alias("vec_id"))  # some vectors are near to very many
    near = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    member = member.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1).drop("r")
    lists = member.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    own = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    lists = materialize(lists.join(own.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")), ["h1", "h2"]), "aq-lists")
    own = join_hot(own, lists, ["h1", "h2"], "n", ["query_id"])  # queries of one vector may be very many
    own = own.withColumn("near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    out = own.select("query_id", F.posexplode("near").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
