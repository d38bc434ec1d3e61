"""A training-corpus pipeline of five stages over ``documents``; each is written as Parquet and read again by the next.

Toxic documents go, one document of each near-duplicate class stays, contaminated documents go, secrets are replaced in
the texts, and what is left is packed into training sequences.

Defined results: null and empty texts pass like others (they are near copies of each other, so one of them stays) and are
packed as their end id alone; rows without an id pass; rows that share an id are told apart by their texts, and of equal
rows one stays; of near copies that of the smallest id stays; extra columns pass through all stages but the last,
whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, packing, secret_scan, simhash, toxicity
from tidemark.llm.common import dropped, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Not expressible in SQL: boosted trees, fingerprints and token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
            dropped(*before)  # what this stage read
            before = [docs]
    return docs
