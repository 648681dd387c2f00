"""Session and table helpers shared by every query."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "ledgerloom") -> SparkSession:
    """A session with the settings every query assumes: UTC, AQE on, and skewed joins split at run time."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; only Spark opens the path, so any store Spark can read works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (local tests) a temporary folder is set for the session.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = held.get() if held.isDefined() else None
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        place = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may be gone; the folder is the cluster's scratch space
            drop_path(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver found it."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    reachable = str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if not reachable and context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="ledgerloom-")  # executors fetch the file from the driver while it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}-{context.applicationId}", "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


def map_arrow(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, schema)
