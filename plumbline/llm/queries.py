"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import mixing, near_dedup, pieces, pii, quality, secret_scan, tokens, topk, url_filter
from plumbline.llm.common import fresh_path, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its piece ids, their number and the text that they decode to."""
    return with_decoded(pieces.encode(table(spark, sf_dir, "documents")))


def with_decoded(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", pieces.decode(F.col("ids")).alias("decoded"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table's rows, of low quality or toxic, taken as labels of the pages of the same id."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), page_labels(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    tokens.write_token_files(table(spark, sf_dir, "documents"), path)
    return tokens.read_token_files(spark, path, with_ids=False).drop("ids")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# --- the contract's base columns, which SQL can say ------------------------------------------------


def base_op1_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def base_op4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base verdicts, which no label bears on."""
    none = spark.createDataFrame([], "doc_id long, quality int")
    return quality.quality(table(spark, sf_dir, "documents"), none).drop("kept", "quality")


def base_op5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_pii(spark, sf_dir).drop("base_sha256", "spans")


def base_op6_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def base_op9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_secrets(spark, sf_dir).drop("base_sha256", "spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_mixing, op2_pieces, op3_urls, op4_quality, op5_pii, op6_token_counts, op7_near_dedup, op8_topk, op9_secrets, op10_token_files, pipeline)
    named += (base_op1_targets, base_op4_counts, base_op5_counts, base_op6_bytes, base_op9_counts)
    return {f.__name__: f for f in named}


# --- SQL ------------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM both_ JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.k + b.k - c)),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, v FROM reach JOIN links ON u = r)
SELECT reach.doc_id, max(coalesce(k, 0))::BIGINT AS n_shingles, min(r) AS component_id, min(r) = reach.doc_id AS kept
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
q AS (SELECT vec_id AS query_id, c AS qc FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i] * qc[i]))::BIGINT AS score FROM q JOIN v ON vec_id <> query_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


_PAGE_LABELS = "SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM labels"


def op3_sql(pages: str = "pages", labels: str = _PAGE_LABELS) -> str:
    """The tree level by level, over tables of pages (page_id, url) and labels (page_id, bad)."""
    u = url_filter
    cases = []
    for host, path, verdict in sorted(u.RULES, key=lambda r: -len(r[0] + r[1])):
        cases.append((f"(p.host = '{host}' OR p.host LIKE '%.{host}') AND starts_with(path, '{path}')", host + path, verdict))
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)
    return f"""
WITH RECURSIVE p0 AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{u._UPPER}', '{u._LOWER}') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM {pages}),
p AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda s: s <> ''), '/') AS shape FROM p0),
marks AS (SELECT page_id, max(bad) AS bad FROM ({labels}) WHERE page_id IS NOT NULL AND bad IS NOT NULL GROUP BY page_id),
shapes AS (SELECT host, shape, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN marks USING (page_id) WHERE host <> '' GROUP BY host, shape),
tree AS (
  SELECT host, shape, n, labelled, bad, '' AS prefix, '' AS above, 1 AS level, false AS ended FROM shapes
  UNION ALL
  SELECT host, shape, n, labelled, bad,
    prefix || CASE WHEN seg = '' THEN '' WHEN n_here >= {u.SUPPORT} AND (n_here * {u.SHARE} >= n_all OR marked >= {u.SMOOTHING}) THEN '/' || seg ELSE '/*' END,
    CASE WHEN seg = '' THEN above ELSE prefix END, level + 1, seg = ''
  FROM (SELECT *, sum(n) OVER (PARTITION BY host, prefix, seg) AS n_here, sum(labelled) OVER (PARTITION BY host, prefix, seg) AS marked,
      sum(n) OVER (PARTITION BY host, prefix) AS n_all
    FROM (SELECT *, coalesce(string_split(shape, '/')[level], '') AS seg FROM tree WHERE NOT ended))),
b AS (SELECT host, above AS parent, prefix AS template, sum(labelled)::DOUBLE AS l, sum(bad)::DOUBLE AS k FROM tree WHERE ended GROUP BY ALL),
c AS (SELECT *, sum(l) OVER w AS al, sum(k) OVER w AS ak FROM b WINDOW w AS (PARTITION BY host, parent)),
d AS (SELECT *, CASE WHEN l > 0 AND abs(k / l - ak / al) > {u.SIGMAS} * sqrt(ak / al * (1 - ak / al) / l) THEN template ELSE '' END AS grp FROM c),
e AS (SELECT host, parent, grp, sum(l) AS l, sum(k) AS k, any_value(al) AS al, any_value(ak) AS ak FROM d GROUP BY host, parent, grp),
base AS (SELECT coalesce(avg(bad::DOUBLE), 0) AS r FROM marks),
bad AS (SELECT host, parent, grp FROM e, base
  WHERE l > 0 AND (k + {u.SMOOTHING} * (ak + {u.SMOOTHING} * r) / (al + {u.SMOOTHING})) / (l + {u.SMOOTHING}) >= r + (1 - r) * {u.LIFT}),
rej AS (SELECT t.host, t.shape FROM tree t JOIN d ON t.ended AND t.host = d.host AND t.above = d.parent AND t.prefix = d.template
  JOIN bad ON d.host = bad.host AND d.parent = bad.parent AND d.grp = bad.grp)
SELECT page_id, p.host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, CASE WHEN rej.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN rej ON p.host = rej.host AND p.shape = rej.shape"""


_SPLIT = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

BASE_OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, len({_SPLIT}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS turn FROM w),
b AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER u, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER u, 0)) AS share
  FROM o WINDOW u AS (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(share, turn) AS level FROM b WHERE 3 * source_size >= weight * share)
SELECT doc_id, size::BIGINT AS size, source_size, least(3 * source_size::DOUBLE, weight * level) AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, l
"""

BASE_OP4_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, text, {_SPLIT} AS ws FROM documents),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS ls FROM w WHERE text IS NOT NULL),
wins AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
many AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
inside AS (SELECT r, count(DISTINCT i + j) AS n FROM many, range(5) t(j) GROUP BY r),
c AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::BIGINT AS n_symbols,
  coalesce(len(ls) - len(list_distinct(ls)), 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN lines USING (r) LEFT JOIN inside USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: (CASE WHEN i % 2 = 1 THEN reverse({_DIGITS})[i]::INT WHEN reverse({_DIGITS})[i]::INT > 4 THEN 2 * reverse({_DIGITS})[i]::INT - 9 ELSE 2 * reverse({_DIGITS})[i]::INT END))) % 10 = 0"

BASE_OP5_SQL = rf"""
SELECT doc_id, coalesce(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')), 0)::BIGINT AS n_email,
  coalesce(len(list_filter(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda m: len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS BIGINT), 0) > 255)) = 0)), 0)::BIGINT AS n_ip,
  coalesce(len(list_filter(regexp_extract_all(text, '[0-9](?:[ -]?[0-9])+'), lambda m: length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN})), 0)::BIGINT AS n_card,
  coalesce(len(list_filter(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), lambda m: length({_DIGITS}) BETWEEN 10 AND 15)), 0)::BIGINT AS n_phone FROM documents
"""

_KEYS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))

BASE_OP9_SQL = rf"""
SELECT doc_id, coalesce(len(list_filter(regexp_extract_all(text, '(?:{_KEYS})["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda m: length(m) >= 6)), 0)::BIGINT AS n_assign,
  coalesce(len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda m: length(m) >= 20)), 0)::BIGINT AS n_access,
  coalesce(len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda m: length(m) >= 24)), 0)::BIGINT AS n_hex FROM documents
"""

BASE_SQL = {
    "base_op1_targets": BASE_OP1_SQL,
    "base_op4_counts": BASE_OP4_SQL,
    "base_op5_counts": BASE_OP5_SQL,
    "base_op6_bytes": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents",
    "base_op9_counts": BASE_OP9_SQL,
}


def oracle_sql() -> dict[str, str]:
    return {"op3_urls": op3_sql(), "op7_near_dedup": OP7_SQL, "op8_topk": OP8_SQL} | BASE_SQL
