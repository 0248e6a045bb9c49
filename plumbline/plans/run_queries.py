"""Queries over files, sinks, streams, providers, views and whole runs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from plumbline import config, schemas
from plumbline.functions import text as X
from plumbline.operators import batching, extract, ingest, layout, retrieve, review, tuning, verify, workflow
from plumbline.plans import claim_queries as claims_
from plumbline.plans.bindings import ELEMENTS_SQL, PARAGRAPHS_SQL, REPORTS_SQL, REVIEWS_SQL, page_elements, reports, reviews, table, words_sql
from plumbline.plans.ingest_queries import _BODY, _CLAUSE, _ISLANDS, sentences_sql
from plumbline.plans.registry import query
from plumbline.plans.review_queries import ORDER, _events
from plumbline.sources import files, providers
from plumbline.staging import fresh_path, stored
from plumbline.streaming import events as ev
from plumbline.streaming import pages as streamed

HERE = Path(__file__).resolve().parents[1]


def paragraphs(spark, sf_dir):
    return ingest.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")


def split_sql(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda w: w <> '')"


# --- files in ----------------------------------------------------------------------------------------

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _as_docx(text: str) -> bytes:
    """A word-processor file of a text: its first line a heading, lines with bars tables of one row, the others paragraphs."""
    out = []
    for i, line in enumerate(text.split("\n")):
        run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
        if i and " | " in line:
            cells = "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in line.split(" | "))
            out.append(f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>")
        else:
            style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if i == 0 else ""
            out.append(f"<w:p>{style}{run(line)}</w:p>")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body>{"".join(out)}</w:body></w:document>')
    return held.getvalue()


def _made_files(spark, sf_dir):
    """(document_id, file_type, content): documents with an even id as word-processor files, the others as scanned ones."""
    kind = F.when(F.col("doc_id") % 2 == 0, "docx").otherwise("pdf")
    plain = F.regexp_replace("text", r"[^\n\x20-\x7E¡-ɏ]", "?")
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("document_id"), kind.alias("file_type"), plain.alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, texts = batch.column(1), batch.column(2).to_pylist()
            made = [_as_docx(t) if k == "docx" else t.encode() for k, t in zip(kinds.to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), kinds, pa.array(made, pa.binary())], names=["document_id", "file_type", "content"])

    return rows.mapInArrow(make, "document_id string, file_type string, content binary")


def _scanned(content: bytes) -> list[dict]:
    """Stands in for a reader of portable documents: every line is a page without text of its own, its words are read at 90."""
    return [{"read": [(w, 90.0) for w in line.split(" ")]} for line in content.decode().split("\n")]


@query(
    r"""WITH t AS (SELECT doc_id, regexp_replace(text, '[^\n\x20-\x7E\x{00A1}-\x{024F}]', '?', 'g') AS text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM t),
k AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN 'paragraph' WHEN i = 0 THEN 'heading' WHEN contains(line, ' | ') THEN 'table' ELSE 'paragraph' END AS type,
  CASE WHEN doc_id % 2 = 1 THEN array_to_string(list_filter(string_split(line, ' '), lambda w: w <> ''), ' ') ELSE line END AS text FROM l)
SELECT doc_id::VARCHAR AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS element_index, type, CASE WHEN type = 'heading' THEN 1 ELSE -1 END::BIGINT AS level, md5(text) AS digest,
  CASE WHEN doc_id % 2 = 1 THEN 0.9 ELSE -1 END::DOUBLE AS ocr_confidence FROM k WHERE type IN ('heading', 'table') OR trim(text, ' ') <> ''"""
)
def parsed_documents(spark, sf_dir):
    """Files of both kinds, made of the texts, parsed to elements."""
    rows = files.parse_documents(stored(_made_files(spark, sf_dir), "files"), _scanned)
    text = F.coalesce("text", F.array_join(F.flatten("data"), " | "))
    return rows.select("document_id", F.col("element_index").cast("long").alias("element_index"), "type", F.coalesce("level", F.lit(-1)).cast("long").alias("level"), F.md5(text).alias("digest"), F.round(F.coalesce("ocr_confidence", F.lit(-1.0)), 9).alias("ocr_confidence"))


_NAMES = "'report-' || page_id || CASE page_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' ELSE '' END"


@query(
    f"WITH u AS (SELECT 'in/' || {_NAMES} AS path, length(html) * 20000 AS size, {_NAMES} AS filename, CASE page_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' WHEN 2 THEN 'txt' ELSE '' END AS file_type FROM pages) "
    "SELECT filename, file_type, CASE WHEN file_type NOT IN ('docx', 'pdf') THEN 'unsupported file type' WHEN size > 200 * 1024 * 1024 THEN 'file too large' ELSE 'queued' END AS state FROM u"
)
def upload_checks(spark, sf_dir):
    p = F.col("page_id")
    ending = F.when(p % 4 == 0, ".docx").when(p % 4 == 1, ".PDF").when(p % 4 == 2, ".txt").otherwise("")
    listing = table(spark, sf_dir, "pages").select(F.concat(F.lit("in/report-"), p.cast("string"), ending).alias("path"), (F.length("html") * 20000).cast("long").alias("length"), F.current_timestamp().alias("modificationTime"))
    good, bad = files.check_uploads(listing)
    return good.select("filename", "file_type", F.col("status").alias("state")).unionByName(bad.select("filename", "file_type", F.col("reason").alias("state")))


@query(
    "SELECT ordinal::BIGINT AS ordinal, domain, claim_type, method, ceiling::DOUBLE AS ceiling FROM (VALUES (0, 'financial', 'statistical', 'deterministic', -1), (1, 'financial', 'causal', 'agent', -1), "
    "(2, 'legal', 'definitional', 'agent', -1), (3, 'general', '*', 'agent', 0.6)) t(ordinal, domain, claim_type, method, ceiling)"
)
def registry_rows(spark, sf_dir):
    """The registry as its settings file has it."""
    rows = verify.registry_table(spark, config.load_registry(str(HERE / "settings/registry.yaml")))
    return rows.select(F.col("ordinal").cast("long").alias("ordinal"), F.col("reg_domain").alias("domain"), F.col("reg_type").alias("claim_type"), "method", F.coalesce("ceiling", F.lit(-1.0)).alias("ceiling"))


@query(
    f"WITH {REPORTS_SQL} SELECT claim_id, 'Judge the claim by the evidence alone.' || chr(10) || chr(10) || 'Claim: ' || claim_text || chr(10) || chr(10) || 'Evidence:' || chr(10) || table_text || chr(10) AS prompt FROM reports"
)
def template_prompts(spark, sf_dir):
    """Prompts from a template file."""
    template = F.lit(config.load_template(str(HERE / "prompts"), "verifier"))
    return reports(spark, sf_dir).select("claim_id", X.fill(template, claim=F.col("claim_text"), evidence=F.col("table_text")).alias("prompt"))


@query(
    "SELECT conv_id, substring(sha256(string_agg(lpad(turn::VARCHAR, 9, '0') || '/' || role || coalesce(text, ''), '' ORDER BY lpad(turn::VARCHAR, 9, '0') || '/' || role, coalesce(text, ''))), 1, 16) AS hash FROM conversations GROUP BY conv_id"
)
def file_set_hashes(spark, sf_dir):
    """Conversations as sets of small files, one a turn: the hash that a folder of settings gets."""
    path = F.concat(F.lpad(F.col("turn").cast("string"), 9, "0"), F.lit("/"), "role")
    rows = table(spark, sf_dir, "conversations").select("conv_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return tuning.file_set_hash(rows, "conv_id")


# --- layout of whole pages -----------------------------------------------------------------------------


@query(
    f"WITH {PARAGRAPHS_SQL}, e AS (SELECT document_id, element_index, element_index % 4 = 0 AS is_table, text FROM paragraphs), s AS (SELECT document_id, element_index, {sentences_sql('text')} AS ss FROM e WHERE NOT is_table) "
    "SELECT document_id, element_index::BIGINT AS chunk_id, len(ss)::BIGINT AS n_sentences FROM s WHERE len(ss) > 0"
)
def body_sentences(spark, sf_dir):
    """Sentences are taken of chunks that aren't tables."""
    kind = F.when(F.col("element_index") % 4 == 0, "table").otherwise("paragraph")
    chunks = paragraphs(spark, sf_dir).select("document_id", F.col("element_index").cast("long").alias("chunk_id"), kind.alias("chunk_type"), F.col("text").alias("chunk_text"))
    return extract.chunk_sentences(chunks).groupBy("document_id", "chunk_id").agg(F.count("*").alias("n_sentences"))


@query("SELECT event_id AS chunk_id, coalesce(value IS NOT NULL AND value / 100 < 0.6::DOUBLE, false) AS low_confidence_ocr FROM events")
def chunk_display(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("chunk_id"), F.lit(0).alias("element_index"), (F.col("value") / 100).alias("ocr_confidence"))
    return ingest.display_chunks(rows).drop("ocr_confidence")


# --- ingest of whole texts -------------------------------------------------------------------------------

_WORDS = f"greatest(1, round_even(sum(len({split_sql('text')})) / 400.0::DOUBLE, 0))"
_GATED = f"""{_ISLANDS},
pc AS (SELECT document_id, {_WORDS}::BIGINT AS pages FROM paragraphs GROUP BY document_id),
secs AS (SELECT islands.* FROM islands JOIN pc USING (document_id) WHERE pages > 5)"""


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"))


@query(
    f"""WITH {_GATED}, snt AS (SELECT document_id, element_index, {sentences_sql('text')} AS ss FROM paragraphs),
ks AS (SELECT *, unnest(range(CASE WHEN len(ss) = 0 THEN 0 WHEN len(ss) <= 10 THEN 1 ELSE ceil((len(ss) - 10) / 8.0)::BIGINT + 1 END)) AS k FROM snt)
SELECT ks.document_id, ks.element_index::BIGINT AS element_index, k::BIGINT AS chunk_index, md5(array_to_string(ss[k * 8 + 1:k * 8 + 10], ' ')) AS digest, source AS context_capsule, coalesce(order_index, -1)::BIGINT AS order_index
FROM ks JOIN documents ON doc_id = ks.document_id LEFT JOIN secs s ON s.document_id = ks.document_id AND ks.element_index >= s.start_index AND ks.element_index < s.end_index"""
)
def ingest_chunks(spark, sf_dir):
    """Chunks of the whole ingest, with their section where the document is long enough to have an index."""
    made = ingest.run_ingestion(paragraphs(spark, sf_dir), _sources(spark, sf_dir))
    return made["chunks"].select(
        "document_id", F.col("element_index").cast("long").alias("element_index"), "chunk_index", F.md5("chunk_text").alias("digest"), "context_capsule", F.coalesce("order_index", F.lit(-1).cast("long")).alias("order_index")
    )


@query(
    f"""WITH {_ISLANDS}, t AS (SELECT i.document_id, order_index, count(*) AS items, string_agg(text, chr(10) ORDER BY element_index) AS text FROM islands i
  JOIN paragraphs p ON p.document_id = i.document_id AND p.element_index >= start_index AND p.element_index < end_index GROUP BY ALL)
SELECT document_id, order_index::BIGINT AS order_index, md5(array_to_string({split_sql('text')}[1:150], ' ')) AS digest, least(150, len({split_sql('text')}))::BIGINT AS summary_word_count,
  CASE WHEN items > 1 AND len({split_sql('text')}) > 3000 THEN 'batch_and_reduce' ELSE 'direct' END AS summary_method FROM t"""
)
def section_summaries(spark, sf_dir):
    """Every topic section summarised, in one call or batch by batch; the stand-in for a model keeps the first words."""
    elements = paragraphs(spark, sf_dir)
    rows = ingest.with_summaries(stored(ingest.topic_sections(elements), "sections"), elements, providers.summarize)
    return rows.select("document_id", "order_index", F.md5("summary").alias("digest"), "summary_word_count", "summary_method")


@query(
    f"""WITH {_GATED}, e AS (SELECT document_id, element_index, element_index // 3 + 1 AS page FROM paragraphs),
r AS (SELECT s.document_id, s.order_index, min(page) AS lo, max(page) AS hi FROM secs s LEFT JOIN e ON e.document_id = s.document_id AND e.element_index >= s.start_index AND e.element_index < s.end_index GROUP BY ALL)
SELECT e.document_id, e.element_index::BIGINT AS chunk_id, coalesce(max(order_index), -1)::BIGINT AS order_index FROM e LEFT JOIN r ON r.document_id = e.document_id AND page BETWEEN coalesce(lo, 0) AND coalesce(hi, 1000000000) GROUP BY ALL"""
)
def finalized_chunks(spark, sf_dir):
    """Chunks that came page by page, linked to sections once the document is whole."""
    elements = paragraphs(spark, sf_dir).withColumn("page_number", (F.floor(F.col("element_index") / 3) + 1).cast("int"))
    chunks = elements.select("document_id", F.col("element_index").cast("long").alias("chunk_id"), "page_number")
    made = ingest.finalize_structure(elements, chunks, ingest.page_estimate(elements))
    return made["chunks"].select("document_id", "chunk_id", F.coalesce("order_index", F.lit(-1).cast("long")).alias("order_index"))


@query(
    f"WITH {ELEMENTS_SQL}, {_BODY}, q AS (SELECT m.*, {words_sql('text')} AS ws, {words_sql('section_title')} AS tw, {words_sql('url')} AS uw FROM marked m JOIN pages ON page_id = document_id WHERE type <> 'heading') "
    "SELECT document_id, element_index::BIGINT AS element_index, coalesce((len(tw) > 0 AND len(list_intersect(tw, ws)) * 2 >= len(tw)) OR (len(uw) > 0 AND len(list_intersect(uw, ws)) * 2 >= len(uw)), false) AS meets FROM q"
)
def requires_match(spark, sf_dir):
    """Whether a paragraph holds half of what its heading or its address says."""
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), "url")
    body = ingest.with_heading(page_elements(spark, sf_dir)).join(urls, "document_id")
    asked = F.array(F.coalesce("section_title", F.lit("")), "url")
    return body.select("document_id", F.col("element_index").cast("long").alias("element_index"), X.matches_requires(F.col("text"), asked).alias("meets"))


# --- providers ---------------------------------------------------------------------------------------------


@query(
    f"SELECT doc_id, ceil(len({split_sql('text')}) * 4 / 3::DOUBLE)::BIGINT AS tokens, md5(CASE WHEN ceil(len({split_sql('text')}) * 4 / 3::DOUBLE) > 8091 THEN array_to_string({split_sql('text')}[1:6068], ' ') ELSE text END) AS digest FROM documents WHERE text IS NOT NULL"
)
def token_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", providers.token_estimate(F.col("text")).alias("tokens"), F.md5(providers.guard_tokens(F.col("text"))).alias("digest"))


@query(
    rf"""WITH RECURSIVE {PARAGRAPHS_SQL.lstrip()},
sized AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY element_index) AS i, element_index, ceil(len({split_sql('text')}) * 4 / 3::DOUBLE)::BIGINT AS tokens FROM paragraphs),
walk AS (SELECT document_id, i, element_index, tokens, 0::BIGINT AS batch, tokens AS used, 1 AS n FROM sized WHERE i = 1
  UNION ALL SELECT s.document_id, s.i, s.element_index, s.tokens, CASE WHEN used + s.tokens > 1000 OR n >= 10 THEN batch + 1 ELSE batch END, CASE WHEN used + s.tokens > 1000 OR n >= 10 THEN s.tokens ELSE used + s.tokens END,
  CASE WHEN used + s.tokens > 1000 OR n >= 10 THEN 1 ELSE n + 1 END FROM walk JOIN sized s ON s.document_id = walk.document_id AND s.i = walk.i + 1)
SELECT document_id, element_index::BIGINT AS element_index, tokens, batch FROM walk"""
)
def two_limit_batches(spark, sf_dir):
    """Batches held to a number of inputs and of tokens."""
    rows = paragraphs(spark, sf_dir).select("document_id", F.col("element_index").cast("long").alias("element_index"), providers.token_estimate(F.col("text")).alias("tokens"))
    return batching.batches(rows, "document_id", "element_index", "tokens", most=1000, items=10)


@query(f"SELECT item_id, array_to_string({split_sql('text')}[1:150], ' ') AS summary FROM benchmark")
def provider_answers(spark, sf_dir):
    """A provider's answer for each text, asked in batches."""
    return providers.summarize(table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text")


def _load_counter():
    return lambda texts: [len((t or "").split()) for t in texts]


@query(f"SELECT item_id, len({split_sql('text')})::BIGINT AS n FROM benchmark")
def loaded_pipeline(spark, sf_dir):
    """A pipeline that each worker process builds once."""
    return providers.apply_provider(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", "n", "bigint", providers.once_a_worker(_load_counter)).drop("text")


@query("SELECT vec_id, list_transform(embedding, lambda x: round((x::DOUBLE + 3 * x::DOUBLE) / 2, 6)) AS pooled FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0")
def mean_pooled(spark, sf_dir):
    """Token vectors pooled to one."""
    parts = F.array(F.col("embedding").cast("array<double>"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3))
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and size(embedding) > 0")
    # round() here drops the sign of what it rounds to zero; SQL keeps it
    return rows.select("vec_id", F.transform(providers.mean_pool(parts), lambda x: F.abs(F.round(x, 6)) * F.signum(x)).alias("pooled"))


@query("SELECT item_id AS claim_id, 'external' AS source_type, 'search://' || item_id AS source_ref, text AS content_snippet, 0.5::DOUBLE AS authority_score FROM benchmark WHERE item_id % 3 <> 0")
def connector_evidence(spark, sf_dir):
    """Rows of another external source than the fixed one, for the claims whose scope asks for them."""

    def search(asked):
        texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("content_snippet"))
        found = asked.select("claim_id").join(texts, "claim_id")
        return found.select("claim_id", F.lit("external").alias("source_type"), F.concat(F.lit("search://"), F.col("claim_id").cast("string")).alias("source_ref"), "content_snippet", F.lit(0.5).alias("authority_score"))

    claims = claims_.benchmark_claims(spark, sf_dir)
    return retrieve.dispatch(claims, claims_.lookup_candidates(spark, sf_dir).limit(0), lambda missed: missed.select("claim_id", F.lit(None).cast("bigint").alias("section_id")).limit(0), search)


# --- verdicts, views, sinks ------------------------------------------------------------------------------------

_TWO = "CASE WHEN {c} = 0 THEN '0.00' ELSE (round_even({c}, 2)::DECIMAL(20,2))::VARCHAR END"


@query(
    f"WITH {claims_._VERIFIED}, v AS (SELECT *, {claims_._verified_sql(0.5)} AS final_verdict FROM comp) SELECT claim_id, final_verdict, 'deterministic' AS resolved_by, "
    f"CASE WHEN stated IS NULL THEN 'the claim states no percentage' WHEN final_verdict = 'insufficient' THEN 'no table found holds both figures' "
    f"ELSE 'the tables give ' || {_TWO.format(c='computed')} || '% where the claim says ' || {_TWO.format(c='stated')} || '%' END AS reasoning FROM v"
)
def verify_retrieved(spark, sf_dir):
    """Claims verified through the lookup: each year is a section with its table and one that holds no figures."""
    rows = reports(spark, sf_dir)
    claims = claims_.report_claims(spark, sf_dir).drop("section_id").join(rows.select("claim_id", F.col("yr").alias("section_id")), "claim_id")
    one = rows.select(F.col("claim_id").alias("candidate_id"), "document_id", F.col("yr").alias("section_id"), F.lit("internal_table").alias("source_type"), F.col("table_text").alias("content"), F.lit(1).alias("page_number"), F.lit("Revenue").alias("section_title"), F.lit(2).cast("long").alias("ordinal"))
    bare = one.withColumns({"candidate_id": -F.col("candidate_id"), "content": F.lit("Current period revenue | see below\nPrior period revenue | see below"), "ordinal": F.lit(1).cast("long")})
    none = spark.createDataFrame([], "claim_id bigint, verifier_verdict string, verifier_confidence double, challenger_verdict string, challenger_confidence double")
    found = verify.verify(claims, stored(one.unionByName(bare), "candidates"), none)
    return found.select("claim_id", "final_verdict", "resolved_by", F.col("verifier_reasoning").alias("reasoning"))


@query(
    f"WITH {REVIEWS_SQL} SELECT claim_id, 'verifier' AS agent_name, verifier_verdict AS verdict FROM reviews UNION ALL SELECT claim_id, 'challenger', challenger_verdict FROM reviews"
)
def review_traces(spark, sf_dir):
    """Two traces a review, with what came back."""
    rows = verify.traces(reviews(spark, sf_dir), "0" * 16, "2026-01-01 00:00:00")
    return rows.select("claim_id", "agent_name", F.get_json_object("raw_response", "$.verdict").alias("verdict"))


@query(
    "SELECT doc_id AS claim_id, NOT (doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 > 9) AS fits FROM labels"
)
def claims_that_fit(spark, sf_dir):
    """Rows that keep their table's constraints, and those that don't."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        d.alias("claim_id"), F.when(d % 5 == 0, "rumour").otherwise("causal").alias("claim_type"), F.when(d % 7 == 0, "lunar").otherwise("both").alias("scope"), F.when(d % 11 > 9, 1.5).otherwise(0.5).alias("domain_confidence")
    )
    good, bad = schemas.split_valid(rows, "claims")
    return good.select("claim_id", F.lit(True).alias("fits")).unionByName(bad.select("claim_id", F.lit(False).alias("fits")))


@query(
    "SELECT o_orderkey AS id, o_orderstatus || '.docx' AS filename, 'docx' AS file_type, 'queued' AS status, o_custkey AS page_count, o_orderkey * 10 AS file_size_bytes, o_custkey > 5 AS has_structural_index, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS created_at FROM orders"
)
def document_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.concat("o_orderstatus", F.lit(".docx")).alias("filename"), F.lit("docx").alias("file_type"), F.lit("queued").alias("status"), F.col("o_custkey").alias("page_count"),
        (F.col("o_orderkey") * 10).alias("file_size_bytes"), (F.col("o_custkey") > 5).alias("has_structural_index"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )
    return review.document_view(rows)


@query(
    "SELECT o_custkey AS claim_id, o_orderkey AS id, 'external' AS source_type, 'order://' || o_orderkey AS source_ref, o_orderstatus AS content_snippet, 0.6::DOUBLE AS authority_score, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS retrieved_at FROM orders"
)
def evidence_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("evidence_id"), F.lit("external").alias("source_type"), F.concat(F.lit("order://"), F.col("o_orderkey").cast("string")).alias("source_ref"),
        F.col("o_orderstatus").alias("content_snippet"), F.lit(0.6).alias("authority_score"), F.col("o_orderdate").cast("timestamp").alias("retrieved_at"),
    )
    return review.evidence_view(rows)


@query(
    "SELECT conv_id AS claim_id, turn AS id, role AS agent_name, 'asked' AS prompt_sent, text AS raw_response, 'h' AS config_hash, '2026-01-01T00:00:00' AS created_at FROM conversations"
)
def trace_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("claim_id"), F.col("turn").alias("trace_id"), F.col("role").alias("agent_name"), F.lit("asked").alias("prompt_sent"), F.col("text").alias("raw_response"),
        F.lit(None).cast("string").alias("tool_calls"), F.lit("h").alias("config_hash"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )
    return review.trace_view(rows).drop("tool_calls")


@query(
    f"WITH {claims_._VERIFIED}, v AS (SELECT claim_id, {claims_._verified_sql(0.5)} AS a, {claims_._verified_sql(5.01)} AS b FROM comp) SELECT claim_id, 'final_verdict' AS field, a AS before, b AS after FROM v WHERE a <> b"
)
def snapshots_compared(spark, sf_dir):
    """Snapshots written under two configurations, read back and compared."""
    path = fresh_path(spark, "snapshots")
    documents = reports(spark, sf_dir).select("claim_id", F.col("document_id").cast("string").alias("document_id"))
    for tolerance in (0.5, 5.01):
        tuning.write_snapshot(claims_._snapshot(spark, sf_dir, tolerance).join(documents, "claim_id"), path, config.settings_hash({"tolerance": tolerance}))
    before, after = (tuning.read_snapshot(spark, path, None, config.settings_hash({"tolerance": t})) for t in (0.5, 5.01))
    return tuning.diff(before, after)


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM pages UNION ALL SELECT 'pipeline_runs', count(*) FROM documents")
def persisted_tables(spark, sf_dir):
    """What the sinks of an ingest hold after it."""
    path = fresh_path(spark, "persisted")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("filename"), F.lit("ingested").alias("status"), F.lit(1).alias("page_count"), F.lit(False).alias("has_structural_index"))
    files.persist({"documents": documents, "chunks": table(spark, sf_dir, "pages")}, path, workflow.run_rows(documents, "0" * 16, "2026-01-01 00:00:00", 1))
    read = [spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in ("documents", "chunks", "pipeline_runs")]
    return read[0].unionByName(read[1]).unionByName(read[2])


# --- streams ------------------------------------------------------------------------------------------------------


@query(
    f"WITH {ELEMENTS_SQL}, {_BODY} SELECT document_id::VARCHAR AS document_id, element_index::BIGINT AS element_index, section_title, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY element_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start "
    "FROM marked WHERE type <> 'heading'"
)
def pages_as_a_stream(spark, sf_dir):
    """Elements that arrive as a stream, with the heading and offset that the stream's state carries, appended to a table."""
    rows = page_elements(spark, sf_dir).select(F.col("document_id").cast("string").alias("document_id"), F.col("element_index").cast("int").alias("element_index"), "type", "text")
    source, out, checkpoint = (fresh_path(spark, x) for x in ("page-source", "page-sink", "page-state"))
    rows.write.parquet(source)
    streamed.ingest_pages(spark.readStream.schema(rows.schema).parquet(source), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("document_id", F.col("element_index").cast("long").alias("element_index"), "section_title", "char_start")


@query(
    "SELECT user_id::VARCHAR AS document_id, count(*) AS n_events, count(*) FILTER (event_type = 'click') AS n_extracted, count(*) FILTER (event_type = 'purchase') AS n_verified, arg_max(event_type, event_id) AS last_event, "
    "bool_or(event_type = 'error') AS ended, ['signup', 'view', 'click', 'purchase', 'error'][max(list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type))] AS stage FROM events GROUP BY user_id"
)
def event_log_stream(spark, sf_dir):
    """Events published to the log, subscribed to as a stream and folded."""
    log, out, checkpoint = (fresh_path(spark, x) for x in ("event-log", "event-fold", "event-state"))
    ev.append_events(_events(spark, sf_dir).withColumn("document_id", F.col("document_id").cast("string")), log)
    folded = ev.fold(ev.event_stream(spark, log), ORDER)
    sink = lambda rows, _: rows.write.mode("overwrite").parquet(out)
    folded.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT user_id::VARCHAR AS document_id, event_id AS seq, event_type AS event FROM events")
def polled_events(spark, sf_dir):
    """The log as a view that polls sees it."""
    log, out, checkpoint = (fresh_path(spark, x) for x in ("poll-log", "poll-view", "poll-state"))
    ev.append_events(_events(spark, sf_dir).withColumn("document_id", F.col("document_id").cast("string")), log)
    asked = ev.poll(ev.event_stream(spark, log), lambda rows, _: rows.write.mode("append").parquet(out), checkpoint)
    asked.processAllAvailable()
    asked.stop()
    return spark.read.parquet(out).select("document_id", "seq", "event")


# --- the whole run -------------------------------------------------------------------------------------------------


@query(
    f"""WITH {ELEMENTS_SQL}, n AS (SELECT document_id, greatest(1, round_even(sum(len({split_sql('text')})) / 400.0::DOUBLE, 0))::BIGINT AS pages FROM elements GROUP BY document_id),
snt AS (SELECT document_id, element_index, {sentences_sql('text')} AS ss FROM elements WHERE type <> 'heading'),
ks AS (SELECT *, unnest(range(CASE WHEN len(ss) = 0 THEN 0 WHEN len(ss) <= 10 THEN 1 ELSE ceil((len(ss) - 10) / 8.0)::BIGINT + 1 END)) AS k FROM snt),
ch AS (SELECT document_id, element_index, array_to_string(ss[k * 8 + 1:k * 8 + 10], ' ') AS text FROM ks),
cs AS (SELECT unnest({sentences_sql('text')}) AS sentence FROM ch),
cl AS (SELECT count(*) AS c FROM cs WHERE NOT regexp_matches(sentence, '{_CLAUSE}')),
d AS (SELECT count(*) AS all_, count(DISTINCT document_id) AS done FROM pages LEFT JOIN (SELECT DISTINCT document_id FROM elements) e ON e.document_id = page_id)
SELECT 'documents' AS name, all_ AS n FROM d UNION ALL SELECT 'complete', done FROM d UNION ALL SELECT 'pipeline_runs', all_ FROM d UNION ALL SELECT 'chunks', count(*) FROM ch UNION ALL SELECT 'claims', c FROM cl
UNION ALL SELECT 'verdicts', c FROM cl UNION ALL SELECT 'events', (SELECT sum(pages // 5 + CASE WHEN pages % 5 <> 0 THEN 1 ELSE 0 END) FROM n) + 2 * c + (SELECT done + all_ FROM d) FROM cl"""
)
def run_tables(spark, sf_dir):
    """The whole run over the web pages: rows of each table that it leaves."""
    elements = stored(page_elements(spark, sf_dir).withColumn("document_id", F.col("document_id").cast("string")), "elements")
    documents = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), F.col("url").alias("filename"))
    points = spark.createDataFrame([("general", [1.0] + [0.0] * 63)], "label string, centroid array<double>")

    def judge(claims, evidence):
        both = {f"{a}_{c}": F.lit(v) for a in ("verifier", "challenger") for c, v in (("verdict", "supported"), ("confidence", 0.8), ("reasoning", "as found"))}
        return claims.select("claim_id").withColumns(both)

    made = workflow.process(elements, documents, fresh_path(spark, "run"), points, judge, resolved_at="2026-01-01 00:00:00")
    counts = {name: made[name] for name in ("documents", "pipeline_runs", "chunks", "claims", "verdicts", "events")} | {"complete": made["documents"].where("status = 'complete'")}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counts.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
