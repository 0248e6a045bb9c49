"""Queries that read history and reviews, and fold events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import review, verify
from plumbline.plans.bindings import VERDICTS_SQL, table, verdicts
from plumbline.plans.registry import query
from plumbline.streaming import events as ev


def _claims(spark, sf_dir):
    return verdicts(spark, sf_dir).select("claim_id", "document_id").distinct()


_CLAIMS = "claims AS (SELECT DISTINCT claim_id, document_id FROM verdicts)"
_LATEST = "latest AS (SELECT * FROM verdicts QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY resolved_at DESC, verdict_id DESC) = 1)"


@query(f"WITH {VERDICTS_SQL} SELECT document_id, final_verdict, count(*) AS n FROM verdicts GROUP BY ALL")
def claim_summary(spark, sf_dir):
    return review.claim_summary(_claims(spark, sf_dir), verdicts(spark, sf_dir))


@query(f"WITH {VERDICTS_SQL}, {_LATEST} SELECT document_id, final_verdict, count(*) AS n FROM latest GROUP BY ALL")
def claim_summary_latest(spark, sf_dir):
    return review.claim_summary(_claims(spark, sf_dir), verdicts(spark, sf_dir), newest_only=True)


@query(f"WITH {VERDICTS_SQL}, {_LATEST} SELECT claim_id, verdict_id, final_verdict FROM latest")
def latest_verdict(spark, sf_dir):
    return verify.latest(verdicts(spark, sf_dir)).select("claim_id", "verdict_id", "final_verdict")


@query(
    f"WITH {VERDICTS_SQL}, {_LATEST}, c AS (SELECT c_custkey AS claim_id FROM customer) SELECT c.claim_id, final_verdict, CASE WHEN final_verdict IS NULL THEN 'pending' ELSE 'verified' END AS status FROM c LEFT JOIN latest USING (claim_id)"
)
def claim_list(spark, sf_dir):
    claims = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("claim_id"))
    rows = verdicts(spark, sf_dir).withColumns({"final_confidence": F.lit(1.0), "severity": F.lit("info"), "resolved_by": F.lit("agent")})
    return review.claim_list(claims, rows).select("claim_id", "final_verdict", "status")


_DOCS = """docs AS (SELECT doc_id AS document_id, n_chars, source FROM documents)"""


@query(
    f"WITH {VERDICTS_SQL}, {_CLAIMS}, {_DOCS}, page AS (SELECT document_id, n_chars FROM docs ORDER BY n_chars DESC, document_id LIMIT 20 OFFSET 5), "
    "n AS (SELECT document_id, final_verdict, count(*) AS n FROM verdicts GROUP BY ALL) "
    "SELECT document_id, n_chars, string_agg(final_verdict || '=' || n, ',' ORDER BY final_verdict) AS summary FROM page LEFT JOIN n USING (document_id) GROUP BY document_id, n_chars"
)
def history_page(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("created_at"))
    rows = review.history_page(documents, _claims(spark, sf_dir), verdicts(spark, sf_dir), limit=20, offset=5)
    entries = F.transform(F.sort_array(F.map_entries("claim_summary")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("document_id", F.col("created_at").alias("n_chars"), F.when(F.col("claim_summary").isNotNull(), F.array_join(entries, ",")).alias("summary"))


@query(
    "WITH e AS (SELECT o_custkey AS claim_id, count(*) AS n_evidence FROM orders GROUP BY 1), t AS (SELECT conv_id AS claim_id, count(*) AS n_traces, string_agg(role, '>' ORDER BY turn, role, text) AS roles FROM conversations GROUP BY 1) "
    "SELECT c_custkey AS claim_id, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_traces, 0) AS n_traces, roles FROM customer LEFT JOIN e ON e.claim_id = c_custkey LEFT JOIN t ON t.claim_id = c_custkey"
)
def claim_detail_counts(spark, sf_dir):
    claims = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("claim_id"))
    evidence = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("source_ref"), F.lit("external").alias("source_type"), F.col("o_orderstatus").alias("content_snippet"), F.lit(0.6).alias("authority_score")
    )
    traces = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("claim_id"), F.col("turn").alias("created_at"), F.col("role").alias("agent_name"), F.col("text").alias("raw_response"))
    rows = review.claim_detail(claims, evidence, traces)
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    roles = F.array_join(F.transform("traces", lambda t: t["agent_name"]), ">")
    return rows.select("claim_id", count("evidence").alias("n_evidence"), count("traces").alias("n_traces"), roles.alias("roles"))


@query("SELECT event_id AS run_id, user_id AS document_id, event_type AS stage FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id")
def runs_by_stage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"), F.col("ts").alias("created_at"))
    return review.runs(rows, stage="purchase").drop("created_at")


@query(f"WITH {VERDICTS_SQL} SELECT claim_id, verdict_id, final_verdict, strftime(resolved_at, '%Y-%m-%dT%H:%M:%S') AS resolved_at FROM verdicts")
def verdict_view(spark, sf_dir):
    return review.verdict_view(verdicts(spark, sf_dir))


@query("SELECT p_size AS document_id, string_agg('- id=' || p_partkey || ' title=' || p_name || ' summary=' || p_type, chr(10) ORDER BY p_partkey) AS lines FROM part GROUP BY p_size")
def navigator_lines(spark, sf_dir):
    return review.navigator_lines(
        table(spark, sf_dir, "part").select(F.col("p_size").alias("document_id"), F.col("p_partkey").alias("section_id"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"))
    )


@query(
    f"WITH {VERDICTS_SQL}, kinds AS (SELECT DISTINCT document_id, final_verdict FROM verdicts) SELECT document_id, string_agg(final_verdict, ',' ORDER BY final_verdict) AS final_verdict FROM kinds GROUP BY document_id"
)
def coverage_sets(spark, sf_dir):
    return review.coverage(verdicts(spark, sf_dir), "document_id", "final_verdict")


# --- events ------------------------------------------------------------------------------------------------

#: The event kinds of the test table, in the order of stages.
ORDER = ("signup", "view", "click", "purchase", "error")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.col("props").alias("payload"))


@query("SELECT event_id, event_id % 83 AS page FROM events WHERE (event_id % 83) % 5 = 0 OR event_id % 83 = 82")
def progress_throttle(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 83).alias("page"))
    return rows.where(ev.reports_progress(F.col("page"), F.lit(82)))


@query(
    "SELECT user_id AS document_id, count(*) AS n_events, count(*) FILTER (event_type = 'click') AS n_extracted, count(*) FILTER (event_type = 'purchase') AS n_verified, arg_max(event_type, event_id) AS last_event, "
    "bool_or(event_type = 'error') AS ended, ['signup', 'view', 'click', 'purchase', 'error'][max(list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type))] AS stage FROM events GROUP BY user_id"
)
def stage_fold(spark, sf_dir):
    return ev.fold(_events(spark, sf_dir), ORDER)


@query(
    "SELECT user_id AS document_id, floor(count(*) FILTER (event_type = 'purchase')::DOUBLE / count(*) * 100 + 0.5)::BIGINT AS percent FROM events GROUP BY user_id"
)
def event_counters(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("document_id").agg(F.count_if(F.col("event") == "purchase").alias("done"), F.count("*").alias("total"))
    return rows.select("document_id", ev.percent(F.col("done"), F.col("total")).alias("percent"))


@query(
    "SELECT user_id AS document_id, event_id AS seq, event_type AS name, '{\"document_id\":' || user_id || ',\"seq\":' || event_id || ',\"event\":\"' || event_type || '\",\"payload\":\"' || replace(props, '\"', '\\\"') || '\"}' AS data FROM events"
)
def encoded_events(spark, sf_dir):
    return ev.encode(_events(spark, sf_dir))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts"), F.col("event_type").alias("event"))
    return ev.windowed_counts(rows, "ts").select(F.col("window.start").alias("hour"), "event", "n")
