"""Session building and durable cut points."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of the cuts made in the innermost open ``scratch`` block.
made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def build_session(app: str = "gleaner", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution on; every other choice stays with the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; fall back to a scratch folder in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def spread(df: DataFrame, force: bool = False) -> DataFrame:
    """Rows of a small input over all cores before heavy per-row work; an input with enough partitions stays as it is,
    so a large scan is never shuffled for this. ``force`` is for aggregated frames whose shuffle partitions adaptive
    execution would merge."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if force:
        return df.repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, reachable from every executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write a frame to a table in the shared folder and go on from there: lineage is cut, a lost executor cannot change
    the rows, later readers get only the columns they use, and the optimizer knows the size."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    if (cuts := made.get()) is not None:
        cuts.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Cuts]:
    """Delete the cuts made within the block behind it. A cut made by ``keep`` of what the block gets lives on, as one of
    the block around this one if there is one."""
    outer, cuts = made.get(), Cuts()
    token = made.set(cuts)
    try:
        yield cuts
    finally:
        made.reset(token)
        for folder in cuts:
            delete_folder(spark, folder)
        if outer is not None:
            outer.extend(cuts.kept)


class Cuts(list[str]):
    """Folders of cuts; those of ``kept`` outlive the block."""

    def __init__(self) -> None:
        super().__init__()
        self.kept: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        cut = durable(df)
        self.kept.append(self.pop())
        return cut


@contextmanager
def laid_out(df: DataFrame, keys: list[str]) -> Iterator[DataFrame]:
    """The frame as a table in the shared folder, bucketed and sorted by ``keys``: joins on them shuffle the other side only,
    as often as they are made. The table is gone behind the block."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"laid_out_{uuid.uuid4().hex}", shared_folder(spark, "laid-out")
    # One task per bucket, hence one file.
    rows = df.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        delete_folder(spark, path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(cut: DataFrame) -> None:
    """Delete the table behind a cut that nothing reads any more; other frames are left alone."""
    spark = cut.sparkSession
    for folder in {name.rpartition("/")[0] for name in cut.inputFiles()}:
        if folder.rpartition("/")[2].startswith("cut-"):
            delete_folder(spark, folder)
