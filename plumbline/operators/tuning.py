"""Snapshots of verdicts under a configuration, and what changes between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def file_set_hash(files: DataFrame, of: str) -> DataFrame:
    """(of, hash): the first 16 hex digits of SHA-256 over each set's files, path then content, by path. files: (of, path, content),
    sets as small as a folder of settings."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "content"))), lambda f: F.concat(f["path"], f["content"])), "")
    return files.groupBy(of).agg(F.substring(F.sha2(whole, 256), 1, 16).alias("hash"))


FIELDS = ("final_verdict", "final_confidence", "domain", "scope")


def write_snapshot(verdicts: DataFrame, path: str, config_hash: str) -> None:
    """Append a snapshot, partitioned by document and configuration; nothing else is written."""
    verdicts.withColumn("config_hash", F.lit(config_hash)).write.mode("append").partitionBy("document_id", "config_hash").parquet(path)


def read_snapshot(spark: SparkSession, path: str, document_id: str | None, config_hash: str) -> DataFrame:
    """One snapshot (of all documents where none is named), read from its partitions alone; an error where there is none."""
    rows = spark.read.option("basePath", path).parquet(path).where(F.col("config_hash") == config_hash)
    rows = rows if document_id is None else rows.where(F.col("document_id") == document_id)
    if rows.isEmpty():
        raise FileNotFoundError(f"no snapshot of {document_id} under {config_hash}")
    return rows


def diff(before: DataFrame, after: DataFrame, fields=FIELDS) -> DataFrame:
    """(claim_id, field, before, after): what differs for the claims that both have, nulls compared as values; by claim and field."""
    a = before.select("claim_id", *(F.col(f).alias(f"__a_{f}") for f in fields))
    b = after.select("claim_id", *(F.col(f).alias(f"__b_{f}") for f in fields))
    changes = [
        F.when(~F.col(f"__a_{f}").eqNullSafe(F.col(f"__b_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"__a_{f}").cast("string").alias("before"), F.col(f"__b_{f}").cast("string").alias("after")))
        for f in fields
    ]
    found = a.join(b, "claim_id").select("claim_id", F.inline(F.filter(F.array(*changes), lambda c: c.isNotNull())))
    return found.orderBy("claim_id", "field")
