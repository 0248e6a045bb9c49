"""Queries that route, look up, classify and verify claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import config
from plumbline.functions import text as X
from plumbline.operators import classify, retrieve, tuning, verify
from plumbline.plans.bindings import PARAGRAPHS_SQL, REPORTS_SQL, REQUIRES, REVIEWS_SQL, reports, reviews, table, words_sql
from plumbline.plans.registry import query

# How figures are written.
_MONEY = r"\$?([\d,]+(?:\.\d+)?)\s*([MBKmbk])?"


def money_sql(c: str) -> str:
    unit = f"upper(regexp_extract({c}, '{_MONEY}', 2))"
    return f"TRY_CAST(replace(regexp_extract({c}, '{_MONEY}', 1), ',', '') AS DOUBLE) * CASE {unit} WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1.0 END"


def percent_sql(c: str) -> str:
    return rf"TRY_CAST(regexp_extract({c}, '(-?\d+(?:\.\d+)?)\s*%', 1) AS DOUBLE)"


_FIGURES = "('$' || (p_retailprice::DECIMAL(18,2))::VARCHAR || CASE p_size % 4 WHEN 0 THEN 'M' WHEN 1 THEN ' k' WHEN 2 THEN '' ELSE 'B' END || ' for ' || p_name)"


def _figures():
    unit = F.when(F.col("p_size") % 4 == 0, "M").when(F.col("p_size") % 4 == 1, " k").when(F.col("p_size") % 4 == 2, "").otherwise("B")
    return F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), unit, F.lit(" for "), F.col("p_name"))


@query(f"SELECT p_partkey, round({money_sql(_FIGURES)}, 2) AS amount FROM part")
def parse_money(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.parse_money(_figures()), 2).alias("amount"))


@query(f"WITH {REPORTS_SQL} SELECT claim_id, {percent_sql('claim_text')} AS stated_pct FROM reports")
def parse_percent(spark, sf_dir):
    return reports(spark, sf_dir).select("claim_id", X.parse_percent(F.col("claim_text")).alias("stated_pct"))


@query(
    "SELECT s_suppkey, 'Metric | Value' || chr(10) || s_name || ' | ' || coalesce(s_nationkey::VARCHAR, 'None') AS table_text FROM supplier"
)
def table_texts(spark, sf_dir):
    rows = F.array(F.array(F.lit("Metric"), F.lit("Value")), F.array(F.col("s_name"), F.col("s_nationkey").cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.table_text(rows).alias("table_text"))


def _line(word: str) -> str:
    return f"list_filter(string_split(table_text, chr(10)), lambda l: contains(lower(l), '{word}'))[1]"


_VERIFIED = f"""{REPORTS_SQL},
figs AS (SELECT claim_id, document_id, {percent_sql('claim_text')} AS stated, {money_sql(_line('current'))} AS cur, {money_sql(_line('prior'))} AS pri FROM reports),
comp AS (SELECT *, (cur - pri) / pri * 100 AS computed FROM figs)"""


def _verified_sql(tolerance: float) -> str:
    return f"CASE WHEN computed IS NULL OR stated IS NULL THEN 'insufficient' WHEN abs(computed - stated) <= {tolerance}::DOUBLE THEN 'supported' ELSE 'contradicted' END"


def report_claims(spark, sf_dir):
    return reports(spark, sf_dir).select(
        "claim_id", "document_id", "claim_text", F.lit("financial").alias("domain"), F.lit("statistical").alias("claim_type"), F.lit("internal").alias("scope"),
        F.lit(None).cast("bigint").alias("section_id"), F.array(*map(F.lit, REQUIRES)).alias("requires"),
    )


def report_tables(spark, sf_dir):
    """Each year's table belongs to its claim's section; claims are looked up through (document, year)."""
    return reports(spark, sf_dir).select("claim_id", F.col("table_text").alias("content_snippet"), F.lit(0).alias("ordinal"))


@query(
    f"WITH {_VERIFIED}, v AS (SELECT *, {_verified_sql(0.5)} AS final_verdict FROM comp) "
    "SELECT claim_id, stated AS stated_pct, round(computed, 6) AS computed_pct, final_verdict, CASE final_verdict WHEN 'insufficient' THEN 0.0 ELSE 1.0 END::DOUBLE AS final_confidence, "
    "CASE final_verdict WHEN 'contradicted' THEN 'critical' WHEN 'insufficient' THEN 'minor' ELSE 'info' END AS severity FROM v"
)
def verify_deterministic(spark, sf_dir):
    """The flagship: orders to yearly revenue, to table and claim texts, to recomputed verdicts."""
    rows = verify.recompute(report_claims(spark, sf_dir), report_tables(spark, sf_dir))
    return rows.select("claim_id", "stated_pct", F.round("computed_pct", 6).alias("computed_pct"), "final_verdict", "final_confidence", "severity")


@query(
    f"WITH {REVIEWS_SQL}, a AS (SELECT *, verifier_verdict = challenger_verdict AS agreement FROM reviews), "
    "f AS (SELECT *, CASE WHEN agreement THEN verifier_verdict ELSE 'disputed' END AS final_verdict, CASE WHEN agreement THEN least(verifier_confidence, challenger_confidence) ELSE 0.0 END AS final_confidence FROM a) "
    "SELECT claim_id, agreement, final_verdict, final_confidence, CASE WHEN final_verdict = 'contradicted' THEN CASE WHEN domain = 'financial' THEN 'critical' ELSE 'major' END WHEN final_verdict = 'disputed' THEN 'major' "
    "WHEN final_verdict = 'insufficient' THEN 'minor' ELSE 'info' END AS severity, 'agent' AS resolved_by FROM f"
)
def reconcile_verdicts(spark, sf_dir):
    return verify.reconcile(reviews(spark, sf_dir)).select("claim_id", "agreement", "final_verdict", "final_confidence", "severity", "resolved_by")


@query(
    f"WITH {REVIEWS_SQL} SELECT claim_id, challenger_verdict AS final_verdict, domain, CASE challenger_verdict WHEN 'contradicted' THEN CASE WHEN domain = 'financial' THEN 'critical' ELSE 'major' END "
    "WHEN 'insufficient' THEN 'minor' ELSE 'info' END AS severity FROM reviews"
)
def severity_rules(spark, sf_dir):
    return reviews(spark, sf_dir).select("claim_id", F.col("challenger_verdict").alias("final_verdict"), "domain", X.severity(F.col("challenger_verdict"), F.col("domain")).alias("severity"))


@query(
    f"WITH {REVIEWS_SQL}, t AS (SELECT claim_id, domain, CASE claim_id % 4 WHEN 0 THEN 'statistical' WHEN 1 THEN 'causal' WHEN 2 THEN 'definitional' ELSE 'opinion' END AS claim_type FROM reviews) "
    "SELECT claim_id, domain, claim_type, CASE WHEN domain = 'financial' AND claim_type = 'statistical' THEN 'deterministic' WHEN domain = 'financial' AND claim_type = 'causal' THEN 'agent' "
    "WHEN domain = 'legal' AND claim_type = 'definitional' THEN 'agent' WHEN domain = 'general' THEN 'agent' END AS method, CASE WHEN domain = 'general' THEN 0.6 END::DOUBLE AS ceiling FROM t"
)
def registry_routing(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("statistical", "causal", "definitional", "opinion"))), (F.col("claim_id") % 4 + 1).cast("int"))
    rows = reviews(spark, sf_dir).select("claim_id", "domain", kind.alias("claim_type"))
    return rows.select("*", verify.method_of(F.col("domain"), F.col("claim_type")).alias("method"), verify.ceiling_of(F.col("domain")).alias("ceiling"))


@query(
    f"WITH {REPORTS_SQL} SELECT claim_id, 'Claim: ' || claim_text || chr(10) || 'Evidence:' || chr(10) || '- [internal_table] extracted_table:' || claim_id || ' page 1: ' || table_text AS prompt FROM reports"
)
def prompts(spark, sf_dir):
    rows = reports(spark, sf_dir)
    ref = X.citation(F.concat(F.lit("extracted_table:"), F.col("claim_id").cast("string")), F.lit(1), F.lit(None).cast("string"))
    evidence = rows.select("claim_id", F.lit("internal_table").alias("source_type"), ref.alias("source_ref"), F.col("table_text").alias("content_snippet"))
    joined = rows.join(verify.bundle(evidence), "claim_id")
    return joined.select("claim_id", X.fill(F.lit("Claim: {claim}\nEvidence:\n{evidence}"), claim=F.col("claim_text"), evidence=F.col("bundle")).alias("prompt"))


# --- retrieval: each benchmark item requires its own text of the paragraphs of all documents -------


def benchmark_claims(spark, sf_dir):
    item = F.col("item_id")
    scope = F.when(item % 3 == 0, "internal").when(item % 3 == 1, "external").otherwise("both")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("claim_id"), (item % 20).alias("document_id"), F.lit(None).cast("bigint").alias("section_id"), F.array("text").alias("requires"), scope.alias("scope")
    )


def lookup_candidates(spark, sf_dir):
    """Paragraphs of the documents of a source (documents by their source's number), every seventh as a table."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.substring("source", 4, 9).cast("bigint").alias("document_id"), F.col("doc_id").alias("candidate_id"), F.col("text").alias("content"))
    return rows.select(
        "candidate_id", "document_id", (F.col("candidate_id") % 5).alias("section_id"), "content", F.when(F.col("candidate_id") % 7 == 0, "internal_table").otherwise("internal_chunk").alias("source_type"),
        (F.col("candidate_id") % 30).cast("int").alias("page_number"), F.lit("Body").alias("section_title"), F.col("candidate_id").alias("ordinal"),
    )


_LOOKUP = f"""bc AS (SELECT item_id AS claim_id, item_id % 20 AS document_id, {words_sql('text')} AS wanted,
  CASE item_id % 3 WHEN 0 THEN 'internal' WHEN 1 THEN 'external' ELSE 'both' END AS scope FROM benchmark),
cand AS (SELECT doc_id AS candidate_id, substring(source, 4, 9)::BIGINT AS document_id, doc_id % 5 AS section_id, text, {words_sql('text')} AS ws,
  CASE WHEN doc_id % 7 = 0 THEN 'internal_table' ELSE 'internal_chunk' END AS source_type FROM documents WHERE text IS NOT NULL),
hits AS (SELECT claim_id, candidate_id, source_type, section_id, scope, CASE WHEN source_type = 'internal_table' THEN 'extracted_table:' ELSE 'document_chunk:' END || candidate_id || ' page ' || (candidate_id % 30) || ' section ''Body''' AS source_ref,
  CASE WHEN source_type = 'internal_table' THEN 1.0 ELSE 0.9 END::DOUBLE AS authority_score
  FROM bc JOIN cand USING (document_id) WHERE len(wanted) > 0 AND len(list_intersect(wanted, ws)) * 2 >= len(wanted))"""


@query(f"WITH {_LOOKUP} SELECT claim_id, candidate_id, source_type, source_ref, authority_score FROM hits")
def internal_lookup(spark, sf_dir):
    return retrieve.internal_lookup(benchmark_claims(spark, sf_dir), lookup_candidates(spark, sf_dir)).drop("content_snippet")


def _choose(missed):
    return missed.select("claim_id", (F.col("claim_id") % 5).alias("section_id"))


def _section_claims(spark, sf_dir):
    """The claims, scoped to a section that seldom holds their evidence."""
    return benchmark_claims(spark, sf_dir).withColumn("section_id", (F.col("claim_id") + 1) % 5)


_FALLBACK = f"""{_LOOKUP},
direct AS (SELECT * FROM hits WHERE section_id = (claim_id + 1) % 5 AND scope IN ('internal', 'both')),
firsts AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY CASE WHEN source_type = 'internal_table' THEN 0 ELSE 1 END, candidate_id) AS rn FROM hits
  WHERE section_id = claim_id % 5 AND scope IN ('internal', 'both') AND claim_id NOT IN (SELECT claim_id FROM direct))"""


@query(f"WITH {_FALLBACK} SELECT claim_id, candidate_id, source_type, source_ref, authority_score FROM firsts WHERE rn = 1")
def cross_reference_fallback(spark, sf_dir):
    claims, candidates = _section_claims(spark, sf_dir).where("scope in ('internal', 'both')"), lookup_candidates(spark, sf_dir)
    direct = retrieve.internal_lookup(claims, candidates)
    return retrieve.fallback_lookup(claims, direct, candidates, _choose).drop("content_snippet")


@query(
    f"WITH {_FALLBACK} SELECT claim_id, source_type, source_ref, authority_score FROM direct UNION ALL SELECT claim_id, source_type, source_ref, authority_score FROM firsts WHERE rn = 1 "
    "UNION ALL SELECT claim_id, 'external', 'mock://competitor-filing', 0.6::DOUBLE FROM bc WHERE scope IN ('external', 'both')"
)
def dispatch_by_scope(spark, sf_dir):
    return retrieve.dispatch(_section_claims(spark, sf_dir), lookup_candidates(spark, sf_dir), _choose).drop("content_snippet")


@query(
    f"WITH sec AS (SELECT n_nationkey AS section_id, n_regionkey AS document_id, n_name AS title FROM nation), sw AS (SELECT *, {words_sql('title')} AS ws FROM sec), "
    f"cl AS (SELECT s_suppkey AS claim_id, n_regionkey AS document_id, {words_sql('n_name')} AS wanted FROM supplier JOIN nation ON s_nationkey = n_nationkey), "
    "h AS (SELECT claim_id, section_id, len(list_intersect(wanted, ws)) AS hits, len(wanted) AS size FROM cl JOIN sw USING (document_id)) "
    "SELECT claim_id, arg_min(section_id, (-hits, section_id))::BIGINT AS section_id FROM h WHERE hits > 0 AND 2 * hits >= size GROUP BY claim_id"
)
def pick_section(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    claims = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("claim_id"), F.col("n_regionkey").alias("document_id"), F.array("n_name").alias("requires"))
    sections = nation.select(F.col("n_nationkey").alias("section_id"), F.col("n_regionkey").alias("document_id"), F.col("n_name").alias("title"), F.lit("").alias("summary"))
    return retrieve.pick_section(claims, sections).withColumn("section_id", F.col("section_id").cast("long"))


@query(
    f"WITH {PARAGRAPHS_SQL}, hay AS (SELECT document_id, element_index, lower(p.text) AS t, lower(lang) AS asked FROM paragraphs p JOIN documents ON doc_id = document_id) "
    "SELECT document_id, element_index::BIGINT AS element_index, contains(t, asked) AS cites FROM hay"
)
def citation_fidelity(spark, sf_dir):
    from plumbline.operators import ingest

    """Whether a paragraph holds its document's language code, whatever the case."""
    documents = table(spark, sf_dir, "documents")
    rows = ingest.paragraphs(documents, "doc_id", "text").join(documents.select(F.col("doc_id").alias("document_id"), F.upper("lang").alias("asked")), "document_id")
    return rows.select("document_id", F.col("element_index").cast("long").alias("element_index"), X.citation_fidelity(F.col("text"), F.col("asked")).alias("cites"))


# --- vectors ---------------------------------------------------------------------------------------

_CENTROIDS = """pts AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE embedding IS NOT NULL),
means AS (SELECT label, pos, avg(x) AS x FROM pts GROUP BY label, pos),
cents AS (SELECT label, list(x ORDER BY pos) AS centroid FROM means GROUP BY label)"""


@query(f"WITH {_CENTROIDS} SELECT label, pos::BIGINT AS pos, round(x, 6) AS x FROM means")
def domain_centroids(spark, sf_dir):
    rows = classify.centroids(table(spark, sf_dir, "embeddings"))
    return rows.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(
    f"WITH {_CENTROIDS}, s AS (SELECT vec_id, cents.label, list_cosine_similarity(embedding::DOUBLE[], centroid) AS score FROM embeddings, cents WHERE embedding IS NOT NULL) "
    "SELECT vec_id, arg_max(label, (score, -label)) AS domain, round(greatest(0, max(score)), 6) AS score FROM s GROUP BY vec_id"
)
def semantic_domain(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    rows = classify.nearest(vectors.where("embedding is not null"), classify.centroids(vectors))
    return rows.select("vec_id", "domain", F.round("score", 6).alias("score"))


_TOPK = """s AS (SELECT cents.label AS query_id, vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], centroid) AS similarity FROM embeddings, cents WHERE embedding IS NOT NULL{where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s)
SELECT query_id, rank::BIGINT AS rank, chunk_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 5"""


def _topk(spark, sf_dir, keep=None):
    vectors = table(spark, sf_dir, "embeddings")
    points = classify.centroids(vectors).select(F.col("label").alias("query_id"), F.col("centroid").alias("vector"))
    chunks = vectors.select(F.col("vec_id").alias("chunk_id"), "embedding")
    chunks = chunks if keep is None else chunks.where(keep)
    return retrieve.similar_many(chunks, points).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_CENTROIDS}, {_TOPK.format(where='')}")
def similar_topk(spark, sf_dir):
    return _topk(spark, sf_dir)


@query(f"WITH {_CENTROIDS}, {_TOPK.format(where=' AND (vec_id % 50 < 10 OR vec_id % 50 > 20)')}")
def similar_topk_excluding_range(spark, sf_dir):
    return _topk(spark, sf_dir, retrieve.outside_range(F.col("chunk_id") % 50, 10, 20))


# --- domains -----------------------------------------------------------------------------------------

_TITLES = "(CASE n_nationkey % 5 WHEN 0 THEN 'Financial Highlights ' WHEN 1 THEN 'Legal Disclosures ' WHEN 2 THEN 'Outlook ' WHEN 3 THEN 'Regulatory revenue ' ELSE 'EARNINGS ' END || n_name)"
_TITLE_WORDS = ("Financial Highlights ", "Legal Disclosures ", "Outlook ", "Regulatory revenue ", "EARNINGS ")


def _titles():
    return F.concat(F.element_at(F.array(*map(F.lit, _TITLE_WORDS)), (F.col("n_nationkey") % 5 + 1).cast("int")), F.col("n_name"))


_HINT = "CASE WHEN regexp_matches(lower({c}), 'financial|revenue|earnings') THEN 'financial' WHEN regexp_matches(lower({c}), 'legal|compliance|regulatory|disclosures') THEN 'legal' END"


@query(f"SELECT n_nationkey, {_HINT.format(c=_TITLES)} AS domain_hint FROM nation")
def title_domain_hint(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", X.title_hint(_titles()).alias("domain_hint"))


_TERMS = ("strong EBITDA and liability", "GDPR liability before revenue", "nothing to see", "free cash flow rose YoY", "yoy growth", "antitrust case", "Revenue grew", "SEC filing")
def _gazetteer_sql(c: str) -> str:
    pattern = X.gazetteer_pattern().replace("'", "''")
    term = f"regexp_extract({c}, '{pattern}', 1)"
    lists = {d: ", ".join(f"'{t}'" for t in ts if not t.startswith("[")) for d, ts in config.GAZETTEER.items()}
    return f"CASE WHEN {term} IN ({lists['financial']}) OR lower({term}) = 'yoy' THEN 'financial' WHEN {term} IN ({lists['legal']}) THEN 'legal' END"


@query(f"SELECT doc_id, {_gazetteer_sql('text')} AS domain FROM documents")
def gazetteer_match(spark, sf_dir):
    """Over whole texts; phrases that hold the terms are among the tests."""
    return table(spark, sf_dir, "documents").select("doc_id", X.gazetteer_domain(F.col("text")).alias("domain"))


@query(
    f"""WITH {_CENTROIDS}, c AS (SELECT vec_id AS claim_id, embedding, CASE WHEN vec_id % 6 = 0 THEN 'Legal Disclosures' WHEN vec_id % 6 = 1 THEN 'Outlook' END AS section_title,
  ['{"', '".join(_TERMS)}'][(vec_id % 8 + 1)::INTEGER] AS claim_text FROM embeddings WHERE embedding IS NOT NULL),
d3 AS (SELECT CASE label % 3 WHEN 0 THEN 'financial' WHEN 1 THEN 'general' ELSE 'legal' END AS domain, label, centroid FROM cents),
s AS (SELECT claim_id, domain, label, list_cosine_similarity(embedding::DOUBLE[], centroid) AS score FROM c, d3),
best AS (SELECT claim_id, arg_max(domain, (score, -label)) AS sd, greatest(0, max(score)) AS ss FROM s GROUP BY claim_id),
t AS (SELECT claim_id, {_HINT.format(c="section_title")} AS hint, {_gazetteer_sql("claim_text")} AS term, sd, ss FROM c JOIN best USING (claim_id)),
u AS (SELECT claim_id, coalesce(hint, term, sd) AS domain, CASE WHEN hint IS NOT NULL THEN 0.95 WHEN term IS NOT NULL THEN 0.85 ELSE ss END::DOUBLE AS confidence,
  CASE WHEN hint IS NOT NULL THEN 'structural' WHEN term IS NOT NULL THEN 'terminology' ELSE 'semantic' END AS domain_source FROM t)
SELECT claim_id, domain, round(CASE WHEN domain = 'general' THEN least(confidence, 0.6::DOUBLE) ELSE confidence END, 6) AS domain_confidence, domain_source FROM u"""
)
def domain_cascade(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").where("embedding is not null")
    kinds = F.when(F.col("label") % 3 == 0, "financial").when(F.col("label") % 3 == 1, "general").otherwise("legal")
    points = classify.centroids(vectors).select(kinds.alias("label"), "centroid", F.col("label").alias("place"))
    v = F.col("vec_id")
    claims = vectors.select(
        v.alias("claim_id"), "embedding", F.when(v % 6 == 0, "Legal Disclosures").when(v % 6 == 1, "Outlook").alias("section_title"), F.element_at(F.array(*map(F.lit, _TERMS)), (v % 8 + 1).cast("int")).alias("claim_text")
    )
    rows = classify.classify(claims, points)
    return rows.select("claim_id", "domain", F.round("domain_confidence", 6).alias("domain_confidence"), "domain_source")


@query(
    "WITH v AS (SELECT vec_id, label AS d, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL) "
    "SELECT a.vec_id AS claim_id, min(b.vec_id) AS same_as FROM v a JOIN v b ON a.d = b.d AND b.vec_id < a.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3 GROUP BY a.vec_id"
)
def near_claims(spark, sf_dir):
    claims = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("claim_id"), F.col("label").alias("document_id"), "embedding")
    return classify.near_claims(claims, 0.3)


@query(
    "SELECT doc_id AS claim_id, CASE WHEN quality = 0 THEN CASE WHEN (doc_id % 100) / 100.0 > 0.75 THEN 'both' ELSE 'external' END WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 'external' "
    "WHEN doc_id % 2 = 0 AND (doc_id % 100) / 100.0 > 0.7 THEN 'in_document' WHEN toxic = 1 OR (doc_id % 3 <> 0 AND doc_id % 100 = 0) THEN 'unverifiable' ELSE 'external' END AS route FROM labels"
)
def route_claims(spark, sf_dir):
    d = F.col("doc_id")
    route = X.route(F.col("quality") == 0, d % 3 == 0, F.col("toxic") == 1, d % 2 == 0, (d % 100) / F.lit(100.0))
    return table(spark, sf_dir, "labels").select(d.alias("claim_id"), route.alias("route"))


# --- tuning ----------------------------------------------------------------------------------------------


def _snapshot(spark, sf_dir, tolerance):
    claims = report_claims(spark, sf_dir)
    rows = verify.recompute(claims, report_tables(spark, sf_dir), tolerance)
    return rows.select("claim_id", "final_verdict", "final_confidence", "domain", "scope")


@query(
    f"WITH {_VERIFIED}, v AS (SELECT claim_id, {_verified_sql(0.5)} AS a, {_verified_sql(5.01)} AS b FROM comp) SELECT claim_id, 'final_verdict' AS field, a AS before, b AS after FROM v WHERE a <> b"
)
def snapshot_diff(spark, sf_dir):
    return tuning.diff(_snapshot(spark, sf_dir, 0.5), _snapshot(spark, sf_dir, 5.01))
