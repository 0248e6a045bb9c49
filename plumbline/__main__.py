"""One stage from the command line, over Parquet tables: python -m plumbline STAGE ... (see --help).

Results are written where --out says, or shown as JSON lines.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import classify, extract, ingest, tuning, verify


def _ingest(spark: SparkSession, a) -> DataFrame:
    made = ingest.run_ingestion(spark.read.parquet(a.elements), spark.read.parquet(a.documents))
    if not a.ocr:
        return made[a.table]
    read = spark.read.parquet(a.elements).select("document_id", "element_index", "ocr_confidence")
    return made["chunks"].join(read, ["document_id", "element_index"], "left").withColumn("low_confidence_ocr", ingest.low_confidence(F.col("ocr_confidence")))


def _extract(spark: SparkSession, a) -> DataFrame:
    return extract.extract_claims(spark.read.parquet(a.chunks))


def _classify(spark: SparkSession, a) -> DataFrame:
    return classify.classify(spark.read.parquet(a.claims), spark.read.parquet(a.points))


def _verify(spark: SparkSession, a) -> DataFrame:
    return verify.verify(spark.read.parquet(a.claims), spark.read.parquet(a.candidates), spark.read.parquet(a.reviews), a.tolerance)


def _compare(spark: SparkSession, a) -> DataFrame:
    before, after = (tuning.read_snapshot(spark, a.snapshots, a.document, h) for h in (a.before, a.after))
    return tuning.diff(before, after)


STAGES = {
    "ingest": (_ingest, ("elements", "documents")),
    "extract": (_extract, ("chunks",)),
    "classify": (_classify, ("claims", "points")),
    "verify": (_verify, ("claims", "candidates", "reviews")),
    "compare": (_compare, ("snapshots", "document", "before", "after")),
}


def _arguments(argv: list[str] | None):
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    stages = parser.add_subparsers(dest="stage", required=True)
    for name, (_, needs) in STAGES.items():
        stage = stages.add_parser(name)
        for need in needs:
            stage.add_argument(f"--{need}", required=True)
        stage.add_argument("--out", help="folder for Parquet; without it rows are shown")
        stage.add_argument("--rows", type=int, default=50, help="rows shown at most")
    stages.choices["ingest"].add_argument("--table", choices=("documents", "sections", "chunks"), default="chunks")
    stages.choices["ingest"].add_argument("--ocr", action="store_true", help="mark chunks read with low confidence")
    stages.choices["verify"].add_argument("--tolerance", type=float, default=verify.TOLERANCE)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _arguments(argv)
    found = STAGES[a.stage][0](spark or SparkSession.builder.appName("plumbline").getOrCreate(), a)
    if a.out:
        found.write.mode("overwrite").parquet(a.out)
    else:
        for row in found.limit(a.rows).select(F.to_json(F.struct("*")).alias("row")).collect():
            print(row.row)


if __name__ == "__main__":
    main()
