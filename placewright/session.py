"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: What the engine wants from a session. Sizing (executors, memory, number of
#: shuffle partitions) is left to the cluster; AQE coalesces and splits from
#: whatever initial number it is given.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "placewright",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder every executor can reach, below ``spark.checkpoint.dir``.

    A machine-local folder is only used in local mode with the setting unset;
    on a cluster that would lose data with the machine, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder all executors share"
            )
        base = tempfile.mkdtemp(prefix="placewright-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Remove a folder on whatever file system it lies; True if it was there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder on the machines' own (or mounted) file system; None on any other."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return None
    return place.toUri().getPath()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Needed where it is not installed on the executors: the driver adds it to
    the application as a zip file, once per application.
    """
    context = spark.sparkContext
    if getattr(context, "_placewright_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    staging = tempfile.mkdtemp(prefix="placewright-zip-")
    archive = shutil.make_archive(
        os.path.join(staging, "placewright"), "zip", root, "placewright"
    )
    context.addPyFile(archive)
    context._placewright_shipped = True
