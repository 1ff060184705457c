"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs in one process (a master
    of ``local``) a temporary folder is made and remembered as the context's
    checkpoint folder; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cutweave-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


#: Spark's setting that deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What :func:`materialize` stores within is deleted at the end: for
    callers that write their result before that."""
    paths: list[str] = []
    token = _made.set(paths)
    try:
        yield
    finally:
        _made.reset(token)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read, never a recomputation of
    what stands before, and a nondeterministic row order becomes fixed. The
    write's own shuffle files go when it has ended, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/cutweave/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    if (paths := _made.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`materialize`."""
    for name in df.inputFiles()[:1]:
        delete(df.sparkSession, name.rsplit("/", 1)[0])


#: Keys held by more than one in HOT of all rows are hot, if by more than HOT rows.
HOT = 1024


def join_hot(rows: DataFrame, lookup: DataFrame, key: str | list[str], n: str, spread: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, which has each key once, with
    hot keys split over tasks.

    Column ``n`` of ``lookup``, which is dropped, says how many rows hold its
    key; ``lookup`` is stored. A hot key's rows are dealt by the hash of the
    columns ``spread`` to as many salts as it has shares of 1 / HOT, and its
    lookup row stands once for each salt. At most HOT keys are hot, and at
    most 2 * HOT lookup rows are added, whatever the data; only the hot keys
    are broadcast. Without a hot key it is a plain join. Null keys meet nothing.
    """
    keys = [key] if isinstance(key, str) else key
    total, most = lookup.agg(F.sum(n), F.max(n)).first()
    share = max(HOT, (total or 0) // HOT)
    if (most or 0) <= share:
        return rows.join(lookup.drop(n), keys)
    salt, salts = fresh(rows.join(lookup.limit(0), keys, "left"), "__salt", "__salts")
    hot = F.broadcast(lookup.filter(F.col(n) > share).select(*keys, F.ceil(F.col(n) / F.lit(share)).cast("int").alias(salts)))
    count = F.coalesce(F.col(salts), F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn(salt, F.pmod(F.xxhash64(*spread), count).cast("int")).drop(salts)
    each = lookup.drop(n).join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), count - 1))).drop(salts)
    return dealt.join(each, [*keys, salt]).drop(salt)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names based on ``names`` that do not clash with those of ``df``.

    Compared without case, as Spark resolves names.
    """
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
