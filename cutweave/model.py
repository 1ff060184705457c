"""Options, results and the storage step that iterations use."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class CoarsenOptions:
    parts: int = 4
    seed: int = 0
    stop_contraction_ratio: float = 0.90
    max_levels: int = 24
    cluster_size_factor: int = 256
    pack_isolated: bool = False
    strict_verify: bool = False


@dataclass
class RefineOptions:
    parts: int = 4
    imbalance_ratio: float = 1.03
    max_rounds: int = 32
    stale_rounds: int = 3
    refinement_growth_ratio: float = 2.0


@dataclass
class RefineStats:
    rounds: int = 0
    accepted: int = 0
    rebalance_iterations: int = 0
    initial_cut: int = 0
    final_cut: int = 0


class Lazy(Sequence):
    """Values made when they are first read."""

    def __init__(self, makers: list[Callable[[], object]]):
        self.makers, self.made = makers, {}

    def __len__(self) -> int:
        return len(self.makers)

    def __getitem__(self, i: int) -> object:
        i = range(len(self.makers))[i]
        if i not in self.made:
            self.made[i] = self.makers[i]()
        return self.made[i]


@dataclass
class Hierarchy:
    """Graphs from the input to the coarsest, and the maps between them;
    packed: the same as Blocks and arrays, where the graph allows it."""

    graphs: Sequence[tuple[DataFrame, DataFrame]] = field(default_factory=list)
    maps: Sequence[DataFrame] = field(default_factory=list)
    stop_reason: str = ""
    packed: list = field(default_factory=list)
    packed_maps: list = field(default_factory=list)


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is
    unset and all runs in one process. On a cluster its absence is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cutweave-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What :func:`materialize` stores within is deleted at the end; the
    caller keeps its result by storing it outside, or by a ``keep`` path."""
    paths: list[str] = []
    token = _made.set(paths)
    try:
        yield
    finally:
        _made.reset(token)
        for path in paths:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass
class Stages:
    """Wall-clock seconds of named stages; a stage must end in an action."""

    seconds: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Store as Parquet in the shared folder and read back.

    Iterations cut their lineage this way and not with checkpoint(): the
    optimizer may use constraints of a checkpointed frame's old columns when
    the frame is joined with something derived from it, and lose rows.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not keep and (paths := _made.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
