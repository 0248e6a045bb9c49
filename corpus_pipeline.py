"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which :func:`run` writes as Parquet in
the shared folder and reads again as the next stage's ``docs``. All but the last return the columns of ``documents``,
whatever else is among them and whatever it is named.

Defined cases, stage by stage: null and empty texts fail the base quality rules and go; of repeated rows
(one id, one text) all stay or all go, but near-duplicates keep every row of the smallest id; rows without an id
stay where their group has no id either; very long texts are read whole by every stage; an empty table, or one
of which nothing is kept, gives an empty result. The last stage repeats a row as often as the mix took it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import mixing, near_dedup, pieces, quality, secret_scan
from plumbline.llm.common import cut, table
from plumbline.llm.queries import with_decoded


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the quality model reject go; without labels the base rules alone decide."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; texts without words are in no group."""
    return near_dedup.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays, null texts as they are."""
    return secret_scan.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, 0 to 3 times; the null source is a source of its own."""
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and the decoded text of every row; a null or empty text has no pieces and decodes to nothing."""
    return with_decoded(pieces.encode(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scan", secrets),
    ("mixing", mix),
    ("pieces", encode),
]

#: No stage but the second can be said in SQL; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
