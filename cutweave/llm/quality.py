"""Quality classifier: a regularised quadratic discriminant.

Each class has a Gaussian over transformed statistics of the whole text,
with its own covariance, shrunk towards the pooled one and its diagonal. A
document's score is the logistic of the difference of the two log densities,
which are Mahalanobis distances through Cholesky factors that are computed
once and kept in the model.

The moments are sums, so fitting is one pass whose tasks each return a few
numbers per class, over every labelled training row; nothing is sampled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutweave.llm.common import fresh, materialize

#: Score from which a document counts as good.
THRESHOLD = 0.3

_KEEP = bytes(range(256))
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_SPACE = b" \t\n\r\x0b\x0c"
_STOPS = b".,;:'\"-?()"
_SIGNS = b"#$%&*+/<=>@[\\]^_`{|}~!"
_HIGH = bytes(range(128, 256))
#: Kinds of bytes: letters a, digits 0, signs #, stops, blanks.
_KIND = bytes(35 if c in _SIGNS else 48 if c in _DIGIT else 32 if c in _SPACE else 46 if c in _STOPS else 97 for c in range(256))

FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digits", "stops", "signs", "high", "lone_signs",
    "sign_pairs", "same_as_before", "distinct", "top_word", "long_words", "short_words", "line_length", "same_lines", "longest_run",
)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a text; a null text counts as empty.

    Shares are put through a square root, which spreads them near 0, and
    counts through a logarithm.
    """
    b = (text or "").encode("utf-8", "surrogatepass")
    n = len(b)
    words = b.split()
    k = len(words)
    if not k:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    count = lambda chars: n - len(b.translate(_KEEP, chars))
    black = n - count(_SPACE)
    share = lambda x, of: (x / of) ** 0.5 if of else 0.0
    tally = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    run = longest = 1
    if same:
        for x, y in zip(words, words[1:]):
            run = run + 1 if x == y else 1
            if run > longest:
                longest = run
    kinds = b.translate(_KIND)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=k)
    lines = [x for x in b.split(b"\n") if x]
    return [
        float(np.log1p(n)),
        float(np.log1p(k)),
        float(np.log(black / k)),
        share(count(_UPPER), black),
        share(count(_DIGIT), black),
        share(count(_STOPS), black),
        share(count(_SIGNS), black),
        share(count(_HIGH), black),
        share(kinds.count(b" # "), k),
        share(min(k, kinds.count(b"##")), k),
        share(same, k),
        float(np.log(len(tally)) / np.log(k)) if k > 1 else 1.0,
        share(max(tally.values()) - 1, k),
        share(int((sizes > 14).sum()), k),
        share(int((sizes < 4).sum()), k),
        float(np.log1p(n / max(1, len(lines)))),
        share(len(lines) - len(set(lines)), len(lines)),
        float(np.log(longest)),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([statistics(x) for x in s])


@dataclass
class Model:
    """Means, inverse Cholesky factors and log constants of classes 0 and 1,
    and the line that maps a density difference to log odds."""

    mean: np.ndarray
    inv_factor: np.ndarray
    constant: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        out = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.inv_factor[c].T
            out.append(self.constant[c] - 0.5 * np.einsum("ij,ij->i", z, z))
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Likelihood of label 1, from 0 to 1; an outlier to both classes
        gets no more extreme than the line's ends let it."""
        t = np.clip(self.slope * self.difference(x) + self.offset, -500, 500)
        return 1 / (1 + np.exp(-t))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def _moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products by class. Columns: label, x."""
    d = len(FEATURES)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.array(b["x"].tolist(), dtype=float).reshape(-1, d)
            x = np.hstack([np.ones((len(x), 1)), x])
            for c in (0, 1):
                own = x[(b["label"] == c).to_numpy()]
                if len(own):
                    total[c] = total.get(c, 0) + own.T @ own
        if total:
            yield pd.DataFrame({"label": list(total), "m": [m.ravel().tolist() for m in total.values()]})

    parts = rows.mapInPandas(part, "label int, m array<double>")
    sums = parts.select("label", F.posexplode("m")).groupBy("label", "pos").agg(F.sum("col").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in sums:  # 2 (d + 1)^2 numbers
        out.setdefault(r["label"], np.zeros((d + 1) ** 2))[r["pos"]] = r["v"]
    full = {c: m.reshape(d + 1, d + 1) for c, m in out.items()}
    return {c: (m[0, 0], m[0, 1:], m[1:, 1:]) for c, m in full.items()}


def fit(rows: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> Model:
    """Fit on rows (label 0 or 1, x array<double>).

    shrink: weight of the pooled covariance in each class's own, more where
    the class has few rows for its number of moments; ridge: weight of the
    pooled diagonal, plus a small constant for statistics that
    never vary. A class without rows gets the pooled moments, so any input
    gives a model; without rows at all every score is 0.5.
    """
    d = len(FEATURES)
    got = _moments(rows)
    n = {c: got[c][0] if c in got else 0.0 for c in (0, 1)}
    total = n[0] + n[1]
    mean, cov = np.zeros((2, d)), np.zeros((2, d, d))
    if total:
        for c in (0, 1):
            if n[c]:
                mean[c] = got[c][1] / n[c]
                cov[c] = got[c][2] / n[c] - np.outer(mean[c], mean[c])
        for c in (0, 1):
            if not n[c]:
                mean[c] = mean[1 - c]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / max(total, 1)
    factor, const = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        own = cov[c] if n[c] else pooled
        pull = shrink + (1 - shrink - ridge) * d / (d + n[c])
        s = (1 - pull - ridge) * own + pull * pooled + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        lower = np.linalg.cholesky(s)
        factor[c] = np.linalg.inv(lower)
        const[c] = np.log((n[c] + 1) / (total + 2)) - np.log(np.diag(lower)).sum()
    return Model(mean, factor, const)


def calibrate(model: Model, rows: DataFrame, bins: int = 400) -> Model:
    """Fit slope and offset of the log odds by Newton steps on a histogram of
    the density differences: at most ``bins`` rows reach the driver."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
            t = np.clip(model.difference(x), -40, 40)
            yield pd.DataFrame({"bin": np.round(t * (bins / 80)).astype("int64"), "label": b["label"].astype("int32")})

    got = rows.mapInPandas(part, "bin bigint, label int").groupBy("bin", "label").count().collect()
    if len({r["label"] for r in got}) < 2:
        return model
    t = np.array([r["bin"] * 80 / bins for r in got])
    y = np.array([float(r["label"]) for r in got])
    w = np.array([float(r["count"]) for r in got])
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * t + b, -500, 500)))
        g = np.array([(w * (p - y) * t).sum() + 0.01 * (a - 1), (w * (p - y)).sum()])
        v = w * p * (1 - p)
        h = np.array([[(v * t * t).sum() + 0.01, (v * t).sum()], [(v * t).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    if a <= 0:  # the difference doesn't order the classes: leave it as it is
        return model
    return Model(model.mean, model.inv_factor, model.constant, float(a), float(b))


def training_rows(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Rows (label, x) to learn from. ``stats``: doc_id, x. Held-out ids, null
    ids and labels other than 0 and 1 are left out; a document labelled
    several times counts each time."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    return own.join(stats.select("doc_id", "x"), "doc_id").select("label", "x")


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    rows = training_rows(stats, labels, label)
    return calibrate(fit(rows), rows)


def with_score(df: DataFrame, model: Model, x: str, score: str) -> DataFrame:
    """Adds the score of the statistics in column ``x``."""

    @F.pandas_udf("double")
    def scored(xs: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(xs.tolist(), dtype=float).reshape(-1, len(FEATURES))))

    return df.withColumn(score, scored(F.col(x)))


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    (x,) = fresh(docs, "quality_stats")
    return docs.withColumn(x, statistics_udf(F.col(text))), x


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns kept.

    Rows are stored once with their statistics. Null texts count as empty;
    both score like other short texts, and very long ones are read whole.
    Repeated rows score alike and stay or go together; equal scores need no
    order, and one of just ``threshold`` stays. Rows without id are scored,
    but not learned from. Without labels every row stays; an empty table gives
    no rows. Clashing names are kept, as the new ones get underscores.
    """
    x, score = fresh(docs, "quality_stats", "quality_score")
    stored = materialize(docs.withColumn(x, statistics_udf(F.col("text"))), "quality", "zstd")
    model = train(stored.select("doc_id", F.col(x).alias("x")), labels)
    scored = with_score(stored, model, x, score)
    return scored.filter(F.col(score) >= threshold).drop(x, score)
