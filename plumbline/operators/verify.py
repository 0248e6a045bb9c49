"""Verdicts: routing by registry, recomputation of stated percentages, reconciliation of two reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline import config, schemas
from plumbline.functions import text as X
from plumbline.operators import retrieve

TOLERANCE = config.THRESHOLDS["arithmetic_tolerance_pct"]


def registry_table(spark: SparkSession, registry=config.REGISTRY) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(registry)]
    return spark.createDataFrame(rows, "ordinal int, reg_domain string, reg_type string, method string, ceiling double")


def method_of(domain: Column, claim_type: Column, registry=config.REGISTRY) -> Column:
    """The method of the first registry row for the domain and the claim type or ``*``, else null. The registry is configuration,
    so it is part of the expression and needs no join."""
    out = F.lit(None).cast("string")
    for row_domain, row_type, method, _ in reversed(registry):
        fits = domain == row_domain
        if row_type != "*":
            fits = fits & (claim_type == row_type)
        out = F.when(fits, F.lit(method)).otherwise(out)
    return out


def ceiling_of(domain: Column, registry=config.REGISTRY) -> Column:
    """The confidence ceiling of the first row for the domain that carries one, else null."""
    out = F.lit(None).cast("double")
    for row_domain, _, _, ceiling in reversed(registry):
        if ceiling is not None:
            out = F.when(domain == row_domain, F.lit(float(ceiling))).otherwise(out)
    return out


def recompute(claims: DataFrame, tables: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Deterministic verdicts. claims: (claim_id, claim_text, domain); tables: (claim_id, content_snippet, ordinal), the retrieved ones.

    The first table with usable figures decides; no stated percentage or no such table: insufficient.
    """
    figures = tables.withColumn("f", X.current_prior(F.col("content_snippet")))
    usable = figures.where("f.current is not null and f.prior is not null and f.prior <> 0")
    first = usable.groupBy("claim_id").agg(F.min_by(F.struct("f", "ordinal"), "ordinal").alias("used"))
    stated = X.parse_percent(F.col("claim_text"))
    rows = claims.withColumn("stated_pct", stated).join(first, "claim_id", "left")
    current, prior = F.col("used.f.current"), F.col("used.f.prior")
    computed = F.when(F.col("stated_pct").isNotNull(), F.try_divide(current - prior, prior) * 100)
    rows = rows.withColumn("computed_pct", computed).withColumn("difference", F.abs(F.col("computed_pct") - F.col("stated_pct")))
    verdict = F.when(F.col("difference").isNull(), "insufficient").when(F.col("difference") <= tolerance, "supported").otherwise("contradicted")
    rows = rows.withColumn("final_verdict", verdict).withColumn("deciding_table", F.when(F.col("difference").isNotNull(), F.col("used.ordinal")))
    confidence = F.when(F.col("final_verdict") == "insufficient", 0.0).otherwise(1.0)
    return rows.withColumn("final_confidence", confidence).withColumn("severity", X.severity(F.col("final_verdict"), F.col("domain"))).drop("used")


def reasoning(row_verdict: Column, stated: Column, computed: Column) -> Column:
    """The sentence that goes with a deterministic verdict."""

    def shown(figure: Column) -> Column:
        return F.bround(figure, 2).cast("decimal(20,2)").cast("string")

    compared = F.format_string("the tables give %s%% where the claim says %s%%", shown(computed), shown(stated))
    return F.when(stated.isNull(), "the claim states no percentage").when(row_verdict == "insufficient", "no table found holds both figures").otherwise(compared)


#: What a verdict row says besides its identity and time.
VERDICT = (
    "claim_id", "verifier_verdict", "verifier_confidence", "verifier_reasoning", "challenger_verdict", "challenger_confidence",
    "challenger_reasoning", "agreement", "final_verdict", "final_confidence", "severity", "resolved_by",
)


def _filled(rows: DataFrame) -> DataFrame:
    """``rows`` with every verdict column, null where it is missing."""
    kinds = schemas.schema("verdicts")
    missing = {c: F.lit(None).cast(kinds[c].dataType) for c in VERDICT if c not in rows.columns}
    return rows.withColumns(missing).select(*VERDICT) if missing else rows.select(*VERDICT)


def traces(reviews: DataFrame, config_hash: str, created_at: str) -> DataFrame:
    """agent_traces rows, two a review: what was sent to verifier and challenger (``verifier_prompt``, ...) and what came back
    (``verifier_raw``, ..., else the structured answer as JSON), null where the review doesn't say."""
    def answer(agent: str) -> Column:
        if f"{agent}_raw" in reviews.columns:
            return F.col(f"{agent}_raw")
        parts = [F.col(f"{agent}_{c}").alias(c) for c in ("verdict", "confidence", "reasoning") if f"{agent}_{c}" in reviews.columns]
        return F.to_json(F.struct(*parts))

    def one(agent: str) -> Column:
        sent = F.col(f"{agent}_prompt") if f"{agent}_prompt" in reviews.columns else F.lit(None).cast("string")
        return F.struct(F.lit(agent).alias("agent_name"), sent.alias("prompt_sent"), answer(agent).alias("raw_response"))

    rows = reviews.select("claim_id", F.inline(F.array(one("verifier"), one("challenger"))))
    stamped = rows.withColumns({"tool_calls": F.lit(None).cast(schemas.schema("agent_traces")["tool_calls"].dataType), "config_hash": F.lit(config_hash), "created_at": F.lit(created_at).cast("timestamp")})
    named = stamped.withColumn("trace_id", schemas.key(F.col("claim_id"), F.col("agent_name"), F.col("created_at")))
    return named.select(*schemas.schema("agent_traces").names)


def reconcile(reviews: DataFrame) -> DataFrame:
    """Two reviews of a claim to one verdict: agreement takes the verdict and the smaller confidence, else disputed at 0.

    reviews: (claim_id, domain, verifier_verdict, verifier_confidence, challenger_verdict, challenger_confidence).
    """
    agree = F.col("verifier_verdict") == F.col("challenger_verdict")
    rows = reviews.withColumn("agreement", agree)
    rows = rows.withColumn("final_verdict", F.when(F.col("agreement"), F.col("verifier_verdict")).otherwise("disputed"))
    rows = rows.withColumn("final_confidence", F.when(F.col("agreement"), F.least("verifier_confidence", "challenger_confidence")).otherwise(0.0))
    return rows.withColumn("severity", X.severity(F.col("final_verdict"), F.col("domain"))).withColumn("resolved_by", F.lit("agent"))


def verify(claims: DataFrame, candidates: DataFrame, reviews: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One verdict row a claim, with its reasoning: recomputed where the registry says so, else reconciled from ``reviews``;
    claims without a review (none came, or the reviewer had no access: its verdict is null) stay out, pending."""
    marked = claims.withColumn("method", method_of(F.col("domain"), F.col("claim_type")))
    exact = marked.where("method = 'deterministic'")
    tables = retrieve.internal_lookup(exact, candidates.where("source_type = 'internal_table'")).join(candidates.select("candidate_id", "ordinal"), "candidate_id")
    one = recompute(exact, tables, tolerance).withColumn("resolved_by", F.lit("deterministic"))
    one = one.withColumn("verifier_reasoning", reasoning(F.col("final_verdict"), F.col("stated_pct"), F.col("computed_pct")))
    rest = marked.where("method is null or method <> 'deterministic'").select("claim_id", "domain")
    answered = reviews.where("verifier_verdict is not null and challenger_verdict is not null")
    two = reconcile(answered.join(rest, "claim_id"))
    return _filled(one).unionByName(_filled(two))


def latest(verdicts: DataFrame) -> DataFrame:
    """The newest verdict of every claim."""
    w = Window.partitionBy("claim_id").orderBy(F.col("resolved_at").desc(), F.col("verdict_id").desc())
    return verdicts.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def bundle(evidence: DataFrame) -> DataFrame:
    """(claim_id, bundle): a claim's evidence as lines, in order of reference and text."""
    line = X.evidence_line(F.col("source_type"), F.col("source_ref"), F.col("content_snippet"))
    rows = evidence.select("claim_id", F.struct("source_ref", line.alias("line")).alias("e"))
    lines = F.transform(F.sort_array(F.collect_list("e")), lambda e: e["line"])
    return rows.groupBy("claim_id").agg(F.array_join(lines, "\n").alias("bundle"))
