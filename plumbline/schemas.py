"""Schemas of the entity tables and of the structs that external reviewers return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline import config

_DDL = {
    "documents": "document_id string, filename string, file_type string, storage_path string, file_size_bytes bigint, status string, page_count int, has_structural_index boolean, created_at timestamp",
    "elements": "document_id string, element_index int, type string, level int, text string, data array<array<string>>, page_number int, source string, ocr_confidence double",
    "document_sections": "section_id string, document_id string, title string, is_pseudo_section boolean, summary string, summary_word_count bigint, summary_method string, domain_hint string, order_index int, start_index int, end_index int, page_start int, page_end int",
    "document_chunks": "chunk_id string, document_id string, section_id string, element_index int, chunk_index int, chunk_type string, chunk_text string, context_capsule string, page_number int, start_sentence int, end_sentence int, ocr_confidence double, embedding array<float>",
    "extracted_tables": "table_id string, document_id string, section_id string, page_number int, table_data array<array<string>>, parse_status string",
    "claims": "claim_id string, document_id string, chunk_id string, claim_text string, source_span string, claim_type string, scope string, requires array<string>, domain string, domain_confidence double, domain_source string, embedding array<float>, status string, created_at timestamp",
    "evidence": "evidence_id string, claim_id string, source_type string, source_ref string, content_snippet string, authority_score double, retrieved_at timestamp",
    "verdicts": "verdict_id string, claim_id string, verifier_verdict string, verifier_confidence double, verifier_reasoning string, challenger_verdict string, challenger_confidence double, challenger_reasoning string, agreement boolean, final_verdict string, final_confidence double, severity string, resolved_by string, resolved_at timestamp",
    "pipeline_runs": "run_id string, document_id string, stage string, config_hash string, input_ref string, raw_output string, duration_ms int, created_at timestamp",
    "agent_traces": "trace_id string, claim_id string, agent_name string, prompt_sent string, raw_response string, tool_calls array<struct<tool_name:string,tool_args:string,result:string>>, config_hash string, created_at timestamp",
    "events": "document_id string, seq bigint, event string, payload string",
    "words": "document_id string, page_number int, text string, x0 double, top double, size double",
    "table_boxes": "document_id string, page_number int, x0 double, top double, x1 double, bottom double, data array<array<string>>",
}

#: What a reviewer returns for a claim.
REVIEW = "struct<verdict:string,confidence:double,reasoning:string>"


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def names() -> list[str]:
    return list(_DDL)


def key(*cols: Column) -> Column:
    """A deterministic identifier of a natural key."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols)), 256), 1, 32)


def _fits(name: str) -> Column:
    """The constraints of a table; null where a nullable column is null counts as fitting."""
    rules = {
        "documents": [F.col("file_type").isin(*config.FILE_TYPES)],
        "claims": [F.col("claim_type").isin(*config.CLAIM_TYPES), F.col("scope").isin(*config.SCOPES), F.col("domain_confidence").between(0, 1)],
        "verdicts": [F.col("final_verdict").isin(*config.VERDICTS), F.col("severity").isin(*config.SEVERITIES), F.col("final_confidence").between(0, 1)],
    }
    out = F.lit(True)
    for rule in rules.get(name, []):
        out = out & F.coalesce(rule, F.lit(True))
    return out


def split_valid(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the table's constraints, and the rest for a reject sink."""
    return df.where(_fits(name)), df.where(~_fits(name))
