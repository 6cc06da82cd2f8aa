"""Spark session set-up, and tables in the shared checkpoint folder that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# SQL settings the operators are designed for; all can be set on a live session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even when the split costs an extra shuffle further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Vectors and pages are wide: keep the Arrow batches handed to Python small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def build_session(app_name: str = "storygraph", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings above; ``master`` and shuffle width are for local use."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session somebody else made ready: SQL settings, a folder to cut lineage, code on the workers."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    checkpoint_folder(spark)
    _ship_package(spark)
    return spark


def _ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver imported it from."""
    sc = spark.sparkContext
    if getattr(sc, "_storygraph_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="storygraph-code-")) / "storygraph.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._storygraph_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors share one disk, falls back to a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="storygraph-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return folder


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def scratch_path(spark: SparkSession) -> str:
    """A new folder name below the checkpoint folder."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/storygraph-{uuid.uuid4().hex}"
    paths = _written.get()
    if paths is not None:
        paths.append(path)
    return path


def materialize(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    Cuts the lineage, survives the loss of executors, keeps columns prunable and
    gives the planner real sizes. ``rows`` and any further aggregates are
    measured by the same job. What the job has shuffled is removed when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    seen = Observation()
    measured = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()])
    with _shuffles_removed(spark):
        measured.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside leave no shuffle files. Not for all of a session: somebody may run a plan again that has read them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``materialize`` wrote inside the block when it ends."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        sc = spark.sparkContext
        for name in paths:
            path = sc._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
