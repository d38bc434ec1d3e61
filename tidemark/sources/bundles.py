"""Quarterly archives of tab-separated tables as a Spark data source: a partition per archive, Arrow batches, line numbers.

An archive is a ZIP whose members are tables with a header line. A read names one member and the columns wanted of it;
besides them a schema may hold ``archive`` (its path) and ``line`` (the row's place in its member, from 1), which keeps the
order that a table of files loses. Archives are opened where they are read, through Arrow's file systems (local paths,
and URIs such as hdfs:// or s3://), and unpacked as a stream: what a task holds is a batch.

    spark.dataSource.register(BundleSource)
    spark.read.format("bundle").schema("ACCESSION_NUMBER string, line long").option("member", "SUBMISSION.tsv").load(folder)

Options: ``member``; ``path`` (a folder of ``*.zip`` files, or one archive); ``mode``: FAILFAST (default) stops at a file that
is no archive or lacks the member, DROPMALFORMED passes over it. Columns that a header lacks are null; bytes that are no
UTF-8 are replaced; short lines have nulls at their end.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Rows of an Arrow batch.
BATCH = 10_000
#: Longest field of a table, in characters.
FIELD = 1 << 24
_PLACE = {"archive": pa.string(), "line": pa.int64()}


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class BundleReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.member = schema.fieldNames(), options["member"]
        self.place, self.strict = options["path"], options.get("mode", "FAILFAST").upper() == "FAILFAST"

    def partitions(self) -> list[InputPartition]:
        system, path = fs.FileSystem.from_uri(self.place)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.place)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        return [Archive(f.path) for f in sorted(files, key=lambda f: f.path) if f.is_file and f.path.endswith(".zip")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(FIELD)
        system, _ = fs.FileSystem.from_uri(self.place)
        with system.open_input_file(partition.path) as file:
            try:
                archive = zipfile.ZipFile(file)
                member = archive.open(self.member)
            except (zipfile.BadZipFile, KeyError, pa.ArrowInvalid) as e:
                if self.strict:
                    raise ValueError(f"{partition.path}: no archive with a member {self.member}") from e
                return
            with archive, member:
                rows = csv.reader(io.TextIOWrapper(member, "utf-8", errors="replace", newline=""), delimiter="\t", quoting=csv.QUOTE_NONE)
                at = {name: i for i, name in enumerate(next(rows, []))}
                held: list[list[str]] = []
                first = 1
                for row in rows:
                    held.append(row)
                    if len(held) == BATCH:
                        yield self._batch(held, at, first, partition.path)
                        first, held = first + len(held), []
                if held:
                    yield self._batch(held, at, first, partition.path)

    def _batch(self, rows: list[list[str]], at: dict[str, int], first: int, path: str) -> pa.RecordBatch:
        def column(name: str) -> pa.Array:
            if name == "archive":
                return pa.array([path] * len(rows), pa.string())
            if name == "line":
                return pa.array(range(first, first + len(rows)), pa.int64())
            i = at.get(name, FIELD)
            return pa.array([row[i] if i < len(row) else None for row in rows], pa.string())

        return pa.RecordBatch.from_arrays([column(n) for n in self.names], schema=pa.schema([(n, _PLACE.get(n, pa.string())) for n in self.names]))


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        raise ValueError("a bundle is read with a schema: the columns wanted of its member, and archive and line where needed")

    def reader(self, schema: StructType) -> BundleReader:
        return BundleReader(schema, dict(self.options))


#: Members of the quarterly insider bundle, with the columns that are read.
INSIDER_TABLES = {
    "SUBMISSION.tsv": "ACCESSION_NUMBER string, FILING_DATE string, DOCUMENT_TYPE string, ISSUERTRADINGSYMBOL string",
    "REPORTINGOWNER.tsv": "ACCESSION_NUMBER string, RPTOWNERCIK string, RPTOWNERNAME string, RPTOWNER_RELATIONSHIP string, archive string, line long",
    "NONDERIV_TRANS.tsv": "ACCESSION_NUMBER string, TRANS_DATE string, TRANS_CODE string, TRANS_SHARES string, TRANS_PRICEPERSHARE string, TRANS_ACQUIRED_DISP_CD string",
}


def read_bundle(spark: SparkSession, path: str, member: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    spark.dataSource.register(BundleSource)
    return spark.read.format("bundle").schema(schema).option("member", member).option("mode", mode).load(path)


def insider_tables(spark: SparkSession, path: str, mode: str = "FAILFAST") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(submissions, owners, trades) of all archives under a folder."""
    return tuple(read_bundle(spark, path, member, schema, mode) for member, schema in INSIDER_TABLES.items())


def write_bundles(tables: dict[str, DataFrame], by: str, folder: str) -> int:
    """Writes an archive per value of column ``by``, whose members are the tables' rows with it, in the order of their
    column ``line``; returns their number. Each archive is made in one task, so a value should have an archive's rows."""
    spread = None
    for member, df in tables.items():
        names = [c for c in df.columns if c not in (by, "line")]
        part = df.selectExpr(f"cast({by} as string) as part", f"'{member}' as member", f"'{chr(9).join(names)}' as head", "cast(line as long) as line", f"concat_ws('\t', {', '.join(f'coalesce(`{n}`, \"\")' for n in names)}) as body")
        spread = part if spread is None else spread.union(part)

    def pack(group: pa.Table) -> pa.Table:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        rows = group.sort_by([("member", "ascending"), ("line", "ascending")]).to_pylist()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for member in sorted({r["member"] for r in rows}):
                own = [r for r in rows if r["member"] == member]
                archive.writestr(member, "\n".join([own[0]["head"], *(r["body"] for r in own)]) + "\n")
        with system.open_output_stream(f"{path}/{rows[0]['part']}.zip") as file:
            file.write(out.getvalue())
        return pa.table({"part": [rows[0]["part"]]})

    return spread.groupBy("part").applyInArrow(pack, "part string").count()
