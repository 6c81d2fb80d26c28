"""Sessions and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_own: dict[str, str] = {}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def small(df: DataFrame, most: int) -> DataFrame:
    """A table marked for sending to every task if it has at most ``most`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, least: int = 500) -> DataFrame:
    """A table for work in Python: as it is where it has as many partitions as the cluster runs tasks at once, as any
    large table has, else dealt out evenly in parts of at least ``least`` rows. A file of one row group is one task
    otherwise, however many cores there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(max(1, min(cores, -(-df.count() // least))))


_roots: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Deletes the tables that this application's queries have written so far; call it once their results are read.
    Returns how many queries' tables there were. Published versions stay."""
    roots = _roots.pop(spark.sparkContext.applicationId, [])
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(roots)


class Stages:
    """Tables written once in the shared folder, so that a lost executor costs one read and no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.root = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def write(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """The table as written, in folders by the values of a column if one is named."""
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def counted(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """The table as written, and aggregates of its rows that the write itself observes, without reading it again."""
        seen = Observation()
        out = self.write(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]))
        return out, seen.get

    def drop(self, df: DataFrame) -> None:
        """Free a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def within(spark: SparkSession, seconds: float, action: Callable[[], T]) -> T:
    """The result of an action whose jobs are cancelled, and TimeoutError raised, after a time: a statement's timeout."""
    context, group, late = spark.sparkContext, f"within-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"cancelled after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        for p in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(p, None)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, wherever the driver found it; once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidemark-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"tidemark-{app}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    # The driver serves the archive to executors; no folder is shared.
    spark.sparkContext.addPyFile(path)
