"""Session bootstrap and the few settings every plan relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "lodestone", master: str | None = None, driver_memory: str = "8g", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and Arrow on; ``master`` only for local runs, a cluster's submit settings win otherwise."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.driver.memory", driver_memory)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return importable(builder.getOrCreate())


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers that share this file system import the package even when the driver was started elsewhere."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of tables that are still there, by path, oldest first.
_folders: dict[str, SparkSession] = {}
#: Lists that take note of the folders which the present thread makes, outermost first.
_noted: ContextVar[tuple[list[str], ...]] = ContextVar("noted", default=())


@contextmanager
def made() -> Iterator[list[str]]:
    """The folders that the block makes in this thread, in order, so that whoever called for them can ``discard`` them.

    What other threads store meanwhile is not among them. Blocks may lie within each other.
    """
    folders: list[str] = []
    mark = _noted.set((*_noted.get(), folders))
    try:
        yield folders
    finally:
        _noted.reset(mark)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one of this machine, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/lodestone-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"
    _folders[path] = spark
    for folders in _noted.get():
        folders.append(path)
    return path


def folders_since(count: int = 0) -> list[str]:
    """The shared folders made so far that are still there, beyond the first so many."""
    return list(_folders)[count:]


def discard(*paths: str) -> None:
    """Deletes stored tables that nothing will read any more."""
    for path in paths:
        spark = _folders.pop(path, None)
        if spark is not None:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _remove_folders() -> None:
    for path in folders_since():
        try:
            discard(path)
        except Exception:  # noqa: BLE001, S110  the session may be gone
            pass


def stored(df: DataFrame, by: str = "", buckets: int = 0) -> DataFrame:
    """The rows as a table in the shared folder. It outlives executors and cuts the lineage.

    With ``by`` it is bucketed by that column: a join on it with rows in as many partitions doesn't exchange the table.
    Spark buckets only what its catalog names, so it has a name while it is written.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    if not by:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = f"spark_catalog.default.{path.rsplit('/', 1)[1].replace('-', '_')}"
    try:
        writer.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


_filled: dict[tuple, bool] = {}


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows, dealt anew where fewer of its tasks have rows than can run at once, as with a file of one row group."""
    context = df.sparkSession.sparkContext
    key = (context.applicationId, *sorted(df.inputFiles()))
    if key not in _filled:
        tasks = df.select(F.spark_partition_id().alias("task")).distinct().limit(context.defaultParallelism).count()
        _filled[key] = tasks >= context.defaultParallelism
    return df if _filled[key] else df.repartition(context.defaultParallelism)


#: Rows up to which a side of a join is sent to every executor.
SMALL = 200_000


def is_small(df: DataFrame, rows: int = SMALL) -> bool:
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """Marked to be sent to every executor if it is counted to have at most so many rows, else as it is."""
    return F.broadcast(df) if is_small(df, rows) else df
