"""How the engine's entities are found in the test tables, in DataFrames and in the same words of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline import config


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- report documents: a nation's yearly revenue -------------------------------------------

REPORTS_SQL = """
money AS (SELECT c_nationkey::BIGINT AS doc, year(o_orderdate)::BIGINT AS yr, floor(sum(o_totalprice::DECIMAL(18,2)))::BIGINT AS cur
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
pairs AS (SELECT *, lag(cur) OVER (PARTITION BY doc ORDER BY yr) AS pri FROM money),
facts AS (SELECT *, round((cur - pri) * 1000.0::DOUBLE / pri)::BIGINT + CASE WHEN (doc + yr) % 3 = 0 THEN 50 ELSE 0 END AS tenths FROM pairs WHERE pri > 0),
reports AS (SELECT doc * 10000 + yr AS claim_id, doc AS document_id, yr,
  'Metric | Value' || chr(10) || 'Revenue (current period) | $' || cur || chr(10) || 'Revenue (prior period) | $' || pri AS table_text,
  'Revenue grew ' || CASE WHEN tenths < 0 THEN '-' ELSE '' END || (abs(tenths) // 10) || '.' || (abs(tenths) % 10) || '% year-over-year' AS claim_text FROM facts)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id, document_id, yr, table_text, claim_text): a claim and its table for each nation and year."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    doc, yr = F.col("c_nationkey").cast("long").alias("doc"), F.year("o_orderdate").cast("long").alias("yr")
    money = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(doc, yr)
    money = money.agg(F.floor(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).cast("long").alias("cur"))
    pairs = money.withColumn("pri", F.lag("cur").over(Window.partitionBy("doc").orderBy("yr"))).where("pri > 0")
    tenths = F.round((F.col("cur") - F.col("pri")) * F.lit(1000.0) / F.col("pri")).cast("long") + F.when((F.col("doc") + F.col("yr")) % 3 == 0, 50).otherwise(0)
    facts = pairs.withColumn("tenths", tenths)
    size = F.abs("tenths")
    stated = F.concat(F.when(F.col("tenths") < 0, "-").otherwise(""), F.floor(size / 10).cast("long").cast("string"), F.lit("."), (size % 10).cast("string"))
    return facts.select(
        (F.col("doc") * 10000 + F.col("yr")).alias("claim_id"),
        F.col("doc").alias("document_id"),
        "yr",
        F.concat(F.lit("Metric | Value\nRevenue (current period) | $"), F.col("cur").cast("string"), F.lit("\nRevenue (prior period) | $"), F.col("pri").cast("string")).alias("table_text"),
        F.concat(F.lit("Revenue grew "), stated, F.lit("% year-over-year")).alias("claim_text"),
    )


REQUIRES = ("current period revenue", "prior period revenue")

# --- text documents -------------------------------------------------------------------------

PARAGRAPHS_SQL = """
raw_lines AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
paras AS (SELECT document_id, unnest(range(len(ls))) AS element_index, unnest(ls) AS text FROM raw_lines),
paragraphs AS (SELECT * FROM paras WHERE trim(text, ' ') <> '')"""


def stop_sql() -> str:
    return "[" + ", ".join(f"'{w}'" for w in config.STOPWORDS) + "]"


def words_sql(column: str) -> str:
    """content_words in SQL."""
    parts = rf"string_split_regex(lower(regexp_replace({column}, '[^\p{{L}}\p{{N}}]', ' ', 'g')), ' +')"
    return f"list_distinct(list_filter({parts}, lambda w: w <> '' AND NOT list_contains({stop_sql()}, w)))"


def overlap_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) END"


# --- web pages as documents with headings ----------------------------------------------------

_STRIP = r"(?s)<script.*?</script>|<style.*?</style>"
_BLOCK = r"(?s)<(?:h1|p)(?:\s[^>]*)?>.*?</(?:h1|p)>"

ELEMENTS_SQL = rf"""
blocks AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '{_STRIP}', '', 'g'), '{_BLOCK}') AS bs FROM pages WHERE html IS NOT NULL),
parts AS (SELECT page_id AS document_id, unnest(range(len(bs))) AS element_index, unnest(bs) AS b FROM blocks),
named AS (SELECT document_id, element_index, b LIKE '<h1%' AS is_title, trim(regexp_replace(b, '<[^>]+>', '', 'g'), ' ') AS text FROM parts),
elements AS (SELECT document_id, element_index, text, element_index // 3 + 1 AS page_number,
  CASE WHEN is_title OR length(text) < 40 THEN 'heading' ELSE 'paragraph' END AS type FROM named)"""


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, element_index, type, text, page_number): a page is a document, its title and short paragraphs are headings."""
    found = F.regexp_extract_all(F.regexp_replace("html", _STRIP, ""), F.lit(_BLOCK), F.lit(0))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.posexplode(found).alias("element_index", "b"))
    text = F.trim(F.regexp_replace("b", "<[^>]+>", ""))
    kind = F.when(F.startswith("b", F.lit("<h1")) | (F.length(text) < 40), "heading").otherwise("paragraph")
    page = (F.floor(F.col("element_index") / 3) + 1).cast("int")
    return rows.select("document_id", "element_index", kind.alias("type"), text.alias("text"), page.alias("page_number"))


# --- reviews and verdicts from the label table ---------------------------------------------

REVIEWS_SQL = """
reviews AS (SELECT doc_id AS claim_id, CASE doc_id % 3 WHEN 0 THEN 'financial' WHEN 1 THEN 'legal' ELSE 'general' END AS domain,
  CASE WHEN quality = 1 THEN 'supported' ELSE 'contradicted' END AS verifier_verdict, (60 + doc_id % 40) / 100.0::DOUBLE AS verifier_confidence,
  CASE WHEN toxic = 1 THEN 'insufficient' WHEN quality = 1 THEN 'supported' ELSE 'contradicted' END AS challenger_verdict, (50 + doc_id % 45) / 100.0::DOUBLE AS challenger_confidence
  FROM labels)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("doc_id")
    good = F.when(F.col("quality") == 1, "supported").otherwise("contradicted")
    return table(spark, sf_dir, "labels").select(
        id_.alias("claim_id"),
        F.when(id_ % 3 == 0, "financial").when(id_ % 3 == 1, "legal").otherwise("general").alias("domain"),
        good.alias("verifier_verdict"),
        ((60 + id_ % 40) / F.lit(100.0)).alias("verifier_confidence"),
        F.when(F.col("toxic") == 1, "insufficient").otherwise(good).alias("challenger_verdict"),
        ((50 + id_ % 45) / F.lit(100.0)).alias("challenger_confidence"),
    )


# --- an append-only verdict history from the event table -------------------------------------

VERDICTS_SQL = """
verdicts AS (SELECT event_id AS verdict_id, user_id AS claim_id, user_id % 50 AS document_id, ts AS resolved_at,
  CASE event_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'insufficient' ELSE 'disputed' END AS final_verdict FROM events)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("supported", "contradicted", "insufficient", "disputed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("verdict_id"), F.col("user_id").alias("claim_id"), (F.col("user_id") % 50).alias("document_id"), F.col("ts").alias("resolved_at"), kind.alias("final_verdict")
    )
