"""Session settings and the shared working folder.

Intermediate tables that must survive a lost executor are written below the
folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "boutworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's settings; keyword names use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    Read from ``spark.checkpoint.dir``. Only a local master may leave it unset;
    it then gets a folder of its own for the life of the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="boutworks-")
    spark.conf.set("spark.checkpoint.dir", path)
    _delete_at_exit(spark, path)
    return path


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/boutworks/{name}-{uuid.uuid4().hex[:12]}"
    _delete_at_exit(spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows never recomputes what came before, also
    when executors are lost.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a work path early."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(target, True)
    system.cancelDeleteOnExit(target)


def finished(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match ``pattern`` and hold a table that was written to its end, in order."""
    jvm = spark.sparkContext._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(m.getPath().getParent().toString() for m in found or [])


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Move a path to one that isn't there yet; whether that was so."""
    jvm = spark.sparkContext._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    system = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not system.exists(target) and system.rename(source, target)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def locate(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever their working folder."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    locate(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
