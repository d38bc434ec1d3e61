"""Intermediate tables: written once to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Own scratch folders, by application, for sessions that name none (tests on one machine).
_OWN: dict[str, str] = {}
#: Where the tables that are still held were stored.
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Names of those that are tables of the session.
_NAMES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one, else, on one machine alone, a folder of this application."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: intermediate tables are written there")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-", dir="/tmp")
    return _OWN[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: lineage is cut, and the rows outlive any executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def bucketed(df: DataFrame, name: str, buckets: int, by: str, order: list[str]) -> DataFrame:
    """``df`` written as a table of the session in ``buckets`` by a column, sorted within each: joins by it don't shuffle.
    The name must be a fresh one; rows that come dealt by the column give one file a bucket."""
    path = fresh_path(df.sparkSession, name)
    df.write.bucketBy(buckets, by).sortBy(*order).option("path", path).saveAsTable(name)
    out = df.sparkSession.table(name)
    _PLACES[out], _NAMES[out] = path, name
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing still to be computed reads."""
    for df in tables:
        fs, path = _path(df.sparkSession, _PLACES.pop(df))
        if name := _NAMES.pop(df, None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        fs.delete(path, True)
    for spark in {df.sparkSession for df in tables}:
        spark.sparkContext._jvm.System.gc()  # Spark deletes the shuffle files of finished queries that it finds unused


def _path(spark: SparkSession, place: str):
    """The file system of a place, and the place as its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, place: str) -> bool:
    fs, path = _path(spark, place)
    return fs.exists(path)


def swap(spark: SparkSession, new: str, place: str) -> None:
    """Puts the folder ``new`` in the place of another, by two renames; the old one is deleted last."""
    fs, to = _path(spark, place)
    old = _path(spark, f"{place}.old")[1]
    fs.delete(old, True)
    if fs.exists(to):
        fs.rename(to, old)
    fs.rename(_path(spark, new)[1], to)
    fs.delete(old, True)
