"""Session settings the library is written against."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_ARCHIVE = "sievework-package.zip"


def build_session(app_name: str = "sievework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` overrides any setting.

    On a cluster leave ``master`` unset and let spark-submit decide.  Shuffle
    partitions are left to the cluster: adaptive execution coalesces them, so a
    generous number is safe at scale and costs nothing on small data.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers (once per application).

    Spark distributes the archive, as with ``spark-submit --py-files``.
    """
    context = spark.sparkContext
    if any(Path(path).name == _ARCHIVE for path in context.listFiles):
        return spark
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="sievework-")) / _ARCHIVE
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent).as_posix())
    context.addPyFile(str(archive))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the cluster's checkpoint folder.

    A temporary folder is used only where the cluster names none and the master
    is local (as in tests); elsewhere a missing setting is an error, because a
    machine-local folder would not survive losing that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
    return tempfile.mkdtemp(prefix="sievework-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def write_step(df, name: str = "step"):
    """Write ``df`` to the shared folder and read it back; returns it with its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df, name: str = "step"):
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return write_step(df, name)[0]


def remove_step(spark: SparkSession, path: str) -> None:
    """Delete what :func:`write_step` wrote, once no plan reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary(df, name: str = "step"):
    """As :func:`materialize`, for a table that nothing reads after the block: its files are deleted then."""
    written, path = write_step(df, name)
    try:
        yield written
    finally:
        remove_step(df.sparkSession, path)
