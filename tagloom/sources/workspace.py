"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_homes: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one is made only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tagloom-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what stands there is deleted when the driver ends."""
    home = f"{shared_dir(spark)}/tagloom/{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(_forget, spark._jvm, spark._jsc.hadoopConfiguration(), home)
    return f"{home}/{uuid.uuid4().hex}"


def _forget(jvm, conf, path: str) -> None:
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001  (the JVM may be gone, and then nothing can be deleted from here)
        pass


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder to where none stands."""
    at, there = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(there.getParent())
    if not files.rename(at, there):
        raise RuntimeError(f"{path} can't be moved to {to}")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that it is computed once and its lineage ends."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tagloom_path = path
    return out


def settled(df: DataFrame) -> DataFrame:
    """``df`` itself if it is such a table, else what :func:`settle` makes of it."""
    return df if hasattr(df, "_tagloom_path") else settle(df)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`settle` that nothing reads any more."""
    delete(df.sparkSession, df._tagloom_path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
