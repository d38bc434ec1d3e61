"""Incremental feeds as Structured Streaming jobs. Files that are seen twice, or batches that run again after a failure,
leave the result as it was: short volume is upserted into a partitioned Parquet table, disclosures keep state of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from tidemark.operators.upsert import replace_by_key
from tidemark.sources.files import parse_short_volume
from tidemark.storage import dropped, exists, stored


#: Partitions of a batch that are named in the filter of the table's scan.
LISTED_PARTS = 2_000


#: Buckets of natural keys whose newest rows a disclosure stream keeps together; a task holds one bucket's.
STATE_BUCKETS = 1 << 12


class PartTable:
    """A Parquet table in partitions by the SQL expression ``part``. An upsert reads and rewrites the partitions that new
    rows fall into, and no other; it is written beside them first, so a failed batch is simply run again."""

    def __init__(self, spark: SparkSession, path: str, schema: str, part: str):
        self.spark, self.path, self.schema, self.part = spark, path, schema, part

    def _parts(self) -> DataFrame:
        schema = f"{self.schema}, part string"
        return self.spark.read.schema(schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._parts().drop("part")

    def _touched(self, parts: DataFrame) -> DataFrame:
        """The rows of ``parts`` (part; null is the partition of rows without one). Up to ``LISTED_PARTS`` of them are named
        in the filter, so that no other partition is listed or read; more are joined."""
        named = [r["part"] for r in parts.limit(LISTED_PARTS + 1).collect()]
        if len(named) > LISTED_PARTS:
            wanted = parts.withColumnRenamed("part", "_part")
            return self._parts().join(wanted, F.col("part").eqNullSafe(F.col("_part")), "left_semi")
        known = [p for p in named if p is not None]
        of_named = F.col("part").isin(*known) if known else F.lit(False)
        return self._parts().filter(of_named | F.col("part").isNull() if None in named else of_named)

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``merge`` gets the rows of the touched partitions and the new ones, and returns what the partitions hold now."""
        touched = new.select(F.expr(self.part).cast("string").alias("part")).distinct()
        old = self._touched(touched).drop("part")
        columns = self.read().columns
        now = stored(merge(old, new).select(*columns).withColumn("part", F.expr(self.part).cast("string")), "upsert")
        now.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        dropped(now)


def _start(rows: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SHORT_SCHEMA, SHORT_PART = "date date, ticker string, short_volume long, total_volume long", "date"
COVERAGE_SCHEMA, COVERAGE_PART = "date date", "year(date)"


def stream_short_volume(spark: SparkSession, folder: str, table: PartTable, coverage: PartTable, checkpoint: str) -> StreamingQuery:
    """Daily pipe files: a bar per ticker and day replaces an older one; days seen go to ``coverage`` (date)."""

    def batch(lines: DataFrame, _: int) -> None:
        rows = parse_short_volume(lines).dropDuplicates(["ticker", "date"])
        table.upsert(rows, lambda old, new: replace_by_key(old, new, ["ticker", "date"]))
        coverage.upsert(rows.select("date").distinct(), lambda old, new: old.union(new).distinct())

    return _start(spark.readStream.text(folder).select(F.col("value").alias("line")), batch, checkpoint)


class _Newest(StatefulProcessor):
    """State of a bucket of natural keys is the newest row of each, read and written as one list: a call to the state costs
    far more than a row. A row that isn't its key's newest goes out as amended, at once or when a newer one comes; the newer
    of two has the later date, then the larger address, then the larger id."""

    def __init__(self, schema: StructType, natural_key: list[str], disclosed: str, url: str):
        self._schema = schema
        self._key = [schema.names.index(c) for c in natural_key]
        self._at = [schema.names.index(c) for c in (disclosed, url, "id")]

    def _age(self, row: tuple) -> tuple:
        disclosed, url, id_ = (row[i] for i in self._at)
        return disclosed or date(1900, 1, 1), url is not None, url or "", id_ is not None, id_ if id_ is not None else 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = handle.getListState("newest", self._schema)
        self._change = Row(*self._schema.names, "amended")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        newest = {tuple(row[i] for i in self._key): tuple(row) for row in self._newest.get()}
        changed = set()
        for row in rows:
            row = tuple(row)[: len(self._schema)]  # without its bucket
            natural = tuple(row[i] for i in self._key)
            best = newest.get(natural)
            older = row
            if best is None or self._age(row) > self._age(best):
                # What was newest before this batch is in the log; it goes out again, as what came in the batch does once.
                older, newest[natural] = best, row
                changed.add(natural)
            if older is not None:
                yield self._change(*older, True)
        if changed:
            self._newest.put(list(newest.values()))
            for natural in changed:
                yield self._change(*newest[natural], None)

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state on disk; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_disclosures(spark: SparkSession, folder: str, schema: str, changes: str, natural_key: list[str], checkpoint: str, disclosed: str = "disclosure_date", url: str = "report_url") -> StreamingQuery:
    """Disclosure files (JSON lines) as a log of changes in the Parquet folder ``changes``: a row when its id is new for all
    time, with amended = true if a newer one of its natural key is known (nulls are equal), and again with amended = true
    when a newer one comes. Newest is as in ``mark_amended``.

    Ids seen and the newest row of each key are state in the checkpoint, in STATE_BUCKETS buckets of keys (nor may that number
    change under a checkpoint), so a batch reads its files and the buckets of their keys, nothing of what was written; the log is written exactly once. An id is the hash of a row's content: all rows of
    an id are equal, and a null id is an id, too. A new checkpoint knows nothing: it needs a new folder of changes and
    reads all files again."""
    rows = spark.readStream.schema(schema).json(folder).dropDuplicates(["id"])
    out = StructType([*rows.schema.fields, StructField("amended", BooleanType())])
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*natural_key), F.lit(STATE_BUCKETS)))
    marked = bucketed.groupBy("_bucket").transformWithState(_Newest(rows.schema, natural_key, disclosed, url), out, "Append", "None")
    with _rocksdb(spark):
        return marked.writeStream.format("parquet").outputMode("append").option("path", changes).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def disclosures(spark: SparkSession, schema: str, changes: str) -> DataFrame:
    """What the log says now: a row per id; what is amended once stays so."""
    log = spark.read.schema(f"{schema}, amended boolean").parquet(changes)
    return log.groupBy(*(c for c in log.columns if c != "amended")).agg(F.max("amended").alias("amended"))
