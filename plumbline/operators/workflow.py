"""The whole run: parsed elements to chunks, claims, evidence, verdicts, status and events.

Each stage is written before the next reads it, so what an outside model answered is asked once and a
lost executor repeats one stage at most.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline import config
from plumbline.functions import text as X
from plumbline.operators import classify, extract, ingest, retrieve, verify
from plumbline.schemas import key
from plumbline.sources import providers
from plumbline.streaming import events as ev


def _stored(df: DataFrame, path: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def _section_id() -> Column:
    return F.when(F.col("order_index").isNotNull(), key(F.col("document_id"), F.col("order_index")))


def evidence_candidates(elements: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a lookup may find: whole tables, and the chunks that aren't tables."""
    tables = ingest.with_heading(elements).where("type = 'table'").join(ingest.assign_sections(elements, sections), ["document_id", "element_index"], "left")
    text = X.table_text(F.col("data")) if "data" in elements.columns else F.col("text")
    page = F.col("page_number") if "page_number" in elements.columns else F.lit(None).cast("int")
    one = tables.select(
        key(F.col("document_id"), F.col("element_index"), F.lit("table")).alias("candidate_id"),
        "document_id",
        _section_id().alias("section_id"),
        F.lit("internal_table").alias("source_type"),
        text.alias("content"),
        page.alias("page_number"),
        "section_title",
        F.col("element_index").cast("long").alias("ordinal"),
    )
    body = chunks.where("chunk_type <> 'table'").select(
        F.col("chunk_id").alias("candidate_id"),
        "document_id",
        "section_id",
        F.lit("internal_chunk").alias("source_type"),
        F.col("chunk_text").alias("content"),
        F.lit(None).cast("int").alias("page_number"),
        "section_title",
        F.col("element_index").cast("long").alias("ordinal"),
    )
    return one.unionByName(body)


def _classified(chunks: DataFrame, points: DataFrame, decompose, embed) -> DataFrame:
    found = extract.extract_claims(chunks, decompose)
    place = chunks.select("chunk_id", "section_id", "section_title")
    claims = found.withColumn("claim_id", key(F.col("chunk_id"), F.col("sentence_index"), F.col("claim_text"), F.col("claim_type"))).dropDuplicates(["claim_id"])
    return classify.classify(embed(claims.join(place, "chunk_id"), "claim_text"), points)


def run_events(documents: DataFrame, claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The events of a finished run, numbered within a document in the order of stages: pages done, ingested, claims, verdicts, end."""
    names = config.EVENTS
    done, failed = documents.where("status = 'complete'"), documents.where("status = 'failed'")
    of = claims.select("claim_id", "document_id")

    def step(rows: DataFrame, place: int, name: str, about: Column) -> DataFrame:
        return rows.select("document_id", F.lit(place).alias("place"), F.lit(name).alias("event"), about.alias("about"))

    pages = done.where("page_count is not null").select("document_id", "page_count", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count").cast("long"))).alias("page_number"))
    page = F.format_string("%012d", F.get_json_object("payload", "$.pages_done").cast("long"))
    paged = ev.progress_events(pages).select("document_id", F.lit(-1).alias("place"), "event", page.alias("about"), "payload")
    rows = step(done, 0, names[1], F.lit(""))
    rows = rows.unionByName(step(of, 1, names[2], F.col("claim_id")))
    rows = rows.unionByName(step(verdicts.join(of, "claim_id"), 2, names[3], F.col("claim_id")))
    rows = rows.unionByName(step(done, 3, names[4], F.lit(""))).unionByName(step(failed, 0, names[5], F.lit("")))
    order = Window.partitionBy("document_id").orderBy("place", "about")
    payload = F.when(F.col("about") != "", F.to_json(F.struct(F.col("about").alias("claim_id")))).otherwise("{}")
    rows = rows.withColumn("payload", payload).unionByName(paged)
    return rows.select("document_id", F.row_number().over(order).cast("long").alias("seq"), "event", "payload")


def run_rows(documents: DataFrame, config_hash: str, created_at: str, duration_ms: int, stage: str = "ingest") -> DataFrame:
    """pipeline_runs rows of a stage that ran for all documents at once: each bears the stage's whole duration."""
    output = F.to_json(F.struct("status", "page_count", "has_structural_index"))
    stamped = documents.select(
        key(F.col("document_id"), F.lit(stage), F.lit(created_at)).alias("run_id"), "document_id", F.lit(stage).alias("stage"), F.lit(config_hash).alias("config_hash"),
        F.col("filename").alias("input_ref"), output.alias("raw_output"), F.lit(duration_ms).cast("int").alias("duration_ms"), F.lit(created_at).cast("timestamp").alias("created_at"),
    )
    return stamped


def process(
    elements: DataFrame,
    documents: DataFrame,
    path: str,
    points: DataFrame,
    reviews: Callable[[DataFrame, DataFrame], DataFrame],
    *,
    resolved_at: str,
    decompose: Callable[[DataFrame], DataFrame] | None = None,
    embed: Callable[[DataFrame, str], DataFrame] = providers.embed,
    connector: Callable[[DataFrame], DataFrame] = retrieve.fixed_source,
    tolerance: float = verify.TOLERANCE,
    summarize: Callable[[DataFrame], DataFrame] | None = providers.summarize,
    settings: dict | None = None,
) -> dict[str, DataFrame]:
    """Run every stage for all documents; the tables stand under ``path`` and are returned: documents, sections with summaries,
    chunks, claims, candidates, evidence, reviews, verdicts with their reasoning, agent_traces, pipeline_runs, events.

    A document without elements has failed. ``reviews(claims, evidence)`` gives rows as :func:`verify.reconcile`
    takes them, without domain; claims that no rule and no review resolves stay pending, as do joined sentences
    without ``decompose``. points: domain centroids (label, centroid).
    """
    config_hash = config.settings_hash(settings or config.THRESHOLDS)
    began = time.monotonic()
    parsed = ingest.run_ingestion(elements, documents, summarize)
    sections = _stored(parsed["sections"], path, "sections")
    chunk_id = key(F.col("document_id"), F.col("element_index"), F.col("chunk_index"))
    chunks = _stored(parsed["chunks"].withColumn("chunk_id", chunk_id).withColumn("section_id", _section_id()), path, "chunks")
    took = int((time.monotonic() - began) * 1000)
    claims = _stored(_classified(chunks, points, decompose, embed), path, "claims")
    candidates = _stored(evidence_candidates(elements, sections, chunks), path, "candidates")
    named = sections.select("document_id", _section_id().alias("section_id"), "title", F.col("summary") if "summary" in sections.columns else F.lit("").alias("summary")) if "title" in sections.columns else None
    choose = (lambda missed: retrieve.pick_section(missed, named)) if named is not None else (lambda missed: missed.select("claim_id", F.lit(None).cast("string").alias("section_id")).limit(0))
    evidence = _stored(retrieve.dispatch(claims, candidates, choose, connector), path, "evidence")
    answers = _stored(reviews(claims, evidence), path, "reviews")
    verdicts = verify.verify(claims, candidates, answers, tolerance)
    verdicts = verdicts.withColumn("resolved_at", F.lit(resolved_at).cast("timestamp")).withColumn("verdict_id", key(F.col("claim_id"), F.col("resolved_at")))
    verdicts = _stored(verdicts, path, "verdicts")
    by_agents = answers.join(verdicts.where("resolved_by = 'agent'").select("claim_id"), "claim_id", "left_semi")
    traced = _stored(verify.traces(by_agents, config_hash, resolved_at), path, "agent_traces")
    read = elements.select("document_id").distinct().withColumn("read", F.lit(True))
    status = F.when(F.col("read"), F.lit("complete")).otherwise(F.lit("failed"))
    done = _stored(parsed["documents"].join(read, "document_id", "left").withColumn("status", status).drop("read"), path, "documents")
    events = _stored(run_events(done, claims, verdicts), path, "events")
    runs = _stored(run_rows(done, config_hash, resolved_at, took), path, "pipeline_runs")
    return {
        "documents": done, "sections": sections, "chunks": chunks, "claims": claims, "candidates": candidates, "evidence": evidence, "reviews": answers,
        "verdicts": verdicts, "agent_traces": traced, "pipeline_runs": runs, "events": events,
    }


def reverify(claims: DataFrame, wanted: DataFrame, candidates: DataFrame, reviews: DataFrame, path: str, resolved_at: str, tolerance: float = verify.TOLERANCE) -> DataFrame:
    """Verify the claims in ``wanted`` (claim_id) again and append the verdicts to the history under ``path``; the new rows."""
    again = verify.verify(claims.join(wanted, "claim_id", "left_semi"), candidates, reviews, tolerance)
    again = again.withColumn("resolved_at", F.lit(resolved_at).cast("timestamp")).withColumn("verdict_id", key(F.col("claim_id"), F.col("resolved_at")))
    again.write.mode("append").parquet(f"{path}/verdicts")
    rows = again.sparkSession.read.schema(again.schema).parquet(f"{path}/verdicts")
    return rows.where(F.col("resolved_at") == F.lit(resolved_at).cast("timestamp"))
