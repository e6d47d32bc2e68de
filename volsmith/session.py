"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool
from pathlib import Path
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Model fits are strings of short jobs; this many are submitted to the cluster side by side.
FITS_AT_ONCE = 8


def get_spark(app: str = "volsmith", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew joins and UTC dates."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Python functions travel by reference to their modules; workers whose path lacks the package
    get it from the driver through Spark's own file server.
    """
    context = spark.sparkContext
    if getattr(context, "_volsmith_shipped", False):
        return
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="volsmith-package-") as folder:
        copy = shutil.copytree(package, f"{folder}/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='volsmith-')}/volsmith", "zip", folder, Path(copy).name)
    context.addPyFile(archive)
    context._volsmith_shipped = True


def staging_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with the machine, so the setting is required there.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="volsmith-")
        context.setCheckpointDir(root)
    return root


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a reader of it.

    Cuts the lineage in a way that outlives lost executors, keeps column pruning, and gives the
    optimiser the true size: joins with a staged table are broadcast only when its bytes are
    below ``spark.sql.autoBroadcastJoinThreshold`` and fall back to a shuffle join beyond it.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{staging_root(spark)}/volsmith-{app}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fit_side_by_side(
    spark: SparkSession, fit: Callable[[Any], Any], settings: Iterable[Any],
) -> list[Any]:
    """``fit`` of every setting, in order, submitted from a few driver threads."""
    settings = list(settings)
    with ThreadPool(max(1, min(FITS_AT_ONCE, len(settings)))) as pool:
        return pool.map(inheritable_thread_target(spark)(fit), settings, chunksize=1)
