"""History and review reads: pages of documents, verdict summaries, claim details, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.verify import VERDICT, latest


def claim_summary(claims: DataFrame, verdicts: DataFrame, newest_only: bool = False) -> DataFrame:
    """(document_id, final_verdict, n): over every verdict row, or over each claim's newest."""
    rows = latest(verdicts) if newest_only else verdicts
    return claims.select("claim_id", "document_id").join(rows.select("claim_id", "final_verdict"), "claim_id").groupBy("document_id", "final_verdict").agg(F.count("*").alias("n"))


def history_page(documents: DataFrame, claims: DataFrame, verdicts: DataFrame, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of documents, newest first, with each one's verdict counts as a map."""
    rows = documents if status is None else documents.where(F.col("status") == status)
    page = rows.orderBy(F.col("created_at").desc(), "document_id").offset(offset).limit(limit)
    # a page is small: its claims and verdicts are found before anything is counted
    some = claims.join(page.select("document_id"), "document_id", "left_semi")
    counts = claim_summary(some, verdicts).groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("final_verdict", "n")))).alias("claim_summary"))
    return page.join(counts, "document_id", "left")


def claim_list(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims with their newest verdict, null where there is none; status follows from it."""
    joined = claims.join(latest(verdicts).select("claim_id", "final_verdict", "final_confidence", "severity", "resolved_by"), "claim_id", "left")
    return joined.withColumn("status", F.when(F.col("final_verdict").isNull(), "pending").otherwise("verified"))


def claim_detail(claims: DataFrame, evidence: DataFrame, traces: DataFrame) -> DataFrame:
    """Claims with their evidence and traces; each side is gathered before it is joined."""
    e = evidence.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("source_ref", "source_type", "content_snippet", "authority_score"))).alias("evidence"))
    t = traces.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "agent_name", "raw_response"))).alias("traces"))
    return claims.join(e, "claim_id", "left").join(t, "claim_id", "left")


def runs(pipeline_runs: DataFrame, document_id=None, stage: str | None = None) -> DataFrame:
    """Runs, newest first."""
    rows = pipeline_runs if document_id is None else pipeline_runs.where(F.col("document_id") == document_id)
    rows = rows if stage is None else rows.where(F.col("stage") == stage)
    return rows.orderBy(F.col("created_at").desc(), "run_id")


ISO = "yyyy-MM-dd'T'HH:mm:ss"


def verdict_view(verdicts: DataFrame) -> DataFrame:
    """Verdicts as they are shown: fixed columns, the time in ISO form."""
    return verdicts.select("claim_id", "verdict_id", "final_verdict", F.date_format("resolved_at", ISO).alias("resolved_at"))


def _iso(name: str) -> Column:
    return F.date_format(name, ISO).alias(name)


def document_view(documents: DataFrame) -> DataFrame:
    """Documents as they are shown."""
    return documents.select(F.col("document_id").alias("id"), "filename", "file_type", "status", "page_count", "file_size_bytes", "has_structural_index", _iso("created_at"))


def evidence_view(evidence: DataFrame) -> DataFrame:
    """Evidence rows as they are shown, of each claim."""
    return evidence.select("claim_id", F.col("evidence_id").alias("id"), "source_type", "source_ref", "content_snippet", "authority_score", _iso("retrieved_at"))


def trace_view(traces: DataFrame) -> DataFrame:
    """What was sent to the agents of each claim and what came back, as it is shown."""
    return traces.select("claim_id", F.col("trace_id").alias("id"), "agent_name", "prompt_sent", "raw_response", "tool_calls", "config_hash", _iso("created_at"))


def full_verdict_view(verdicts: DataFrame) -> DataFrame:
    """Whole verdict rows as they are shown: both reviews, the outcome, the time."""
    return verdicts.select(*VERDICT, _iso("resolved_at"))


def navigator_lines(sections: DataFrame) -> DataFrame:
    """(document_id, lines): the sections of a document as a navigator is shown them, a line each, in order of id."""
    line = F.format_string("- id=%s title=%s summary=%s", F.col("section_id").cast("string"), F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("section_id", line.alias("line")))), lambda e: e["line"])
    return sections.groupBy("document_id").agg(F.array_join(lines, "\n").alias("lines"))


def coverage(claims: DataFrame, by: str, *columns: str) -> DataFrame:
    """The distinct values of each column, sorted, for every value of ``by``."""
    return claims.groupBy(by).agg(*(F.array_join(F.sort_array(F.collect_set(c)), ",").alias(c) for c in columns))
