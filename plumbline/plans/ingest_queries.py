"""Queries over texts, elements, sections, chunks and page layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import batching, extract, ingest, layout
from plumbline.plans.bindings import ELEMENTS_SQL, PARAGRAPHS_SQL, overlap_sql, page_elements, table, words_sql
from plumbline.plans.registry import query

_SENTENCES = r"list_filter(list_transform(regexp_extract_all({c}, '[^.!?\n]+[.!?]*'), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '')"


def sentences_sql(column: str) -> str:
    return _SENTENCES.replace("{c}", column)


@query(f"SELECT doc_id, len(ws)::BIGINT AS n_words, md5(array_to_string(list_sort(ws), ' ')) AS digest FROM (SELECT doc_id, {words_sql('text')} AS ws FROM documents WHERE text IS NOT NULL)")
def token_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.content_words(F.col("text")).alias("ws"))
    return rows.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.md5(F.array_join(F.sort_array("ws"), " ")).alias("digest"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents WHERE text IS NOT NULL")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.word_count(F.col("text")).alias("n_words"))


@query(
    f"WITH {PARAGRAPHS_SQL}, w AS (SELECT document_id, element_index, {words_sql('text')} AS ws FROM paragraphs), "
    "p AS (SELECT *, lag(ws) OVER (PARTITION BY document_id ORDER BY element_index) AS before FROM w) "
    f"SELECT document_id, element_index::BIGINT AS element_index, round({overlap_sql('before', 'ws')}, 9) AS similarity FROM p WHERE before IS NOT NULL"
)
def overlap_similarity(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = ingest.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text").select("document_id", "element_index", X.content_words(F.col("text")).alias("ws"))
    rows = rows.withColumn("before", F.lag("ws").over(Window.partitionBy("document_id").orderBy("element_index"))).where("before is not null")
    return rows.select("document_id", F.col("element_index").cast("long").alias("element_index"), F.round(X.overlap(F.col("before"), F.col("ws")), 9).alias("similarity"))


@query(f"WITH {PARAGRAPHS_SQL} SELECT document_id, element_index::BIGINT AS element_index, text FROM paragraphs")
def elements_paragraphs(spark, sf_dir):
    return ingest.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text").select("document_id", F.col("element_index").cast("long").alias("element_index"), "text")


@query(f"WITH {ELEMENTS_SQL} SELECT document_id, element_index::BIGINT AS element_index, type, text FROM elements")
def elements_html(spark, sf_dir):
    return page_elements(spark, sf_dir).select("document_id", F.col("element_index").cast("long").alias("element_index"), "type", "text")


@query(
    f"WITH {ELEMENTS_SQL}, heads AS (SELECT document_id, arg_min(text, element_index) AS head FROM elements WHERE type = 'heading' GROUP BY document_id) "
    "SELECT page_id AS document_id, coalesce(nullif(head, ''), url) AS title FROM pages LEFT JOIN heads ON page_id = document_id"
)
def document_titles(spark, sf_dir):
    documents = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.col("url").alias("filename"))
    return ingest.document_titles(page_elements(spark, sf_dir), documents)


_HEADED = f"""{ELEMENTS_SQL},
n AS (SELECT document_id, max(element_index) + 1 AS n FROM elements GROUP BY document_id),
headed AS (SELECT document_id, text AS title, row_number() OVER w - 1 AS order_index, element_index + 1 AS start_index,
  coalesce(lead(element_index) OVER w, n) AS end_index FROM elements JOIN n USING (document_id) WHERE type = 'heading' WINDOW w AS (PARTITION BY document_id ORDER BY element_index))"""


@query(f"WITH {_HEADED} SELECT document_id, title, order_index::BIGINT AS order_index, start_index::BIGINT AS start_index, end_index::BIGINT AS end_index FROM headed")
def headed_sections(spark, sf_dir):
    return ingest.headed_sections(page_elements(spark, sf_dir)).drop("is_pseudo_section")


_ISLANDS = f"""{PARAGRAPHS_SQL},
wl AS (SELECT document_id, element_index, {words_sql('text')} AS ws FROM paragraphs),
wb AS (SELECT *, lag(ws) OVER (PARTITION BY document_id ORDER BY element_index) AS before FROM wl),
n AS (SELECT document_id, max(element_index) + 1 AS n FROM paragraphs GROUP BY document_id),
islands AS (SELECT document_id, row_number() OVER w - 1 AS order_index, element_index AS start_index, coalesce(lead(element_index) OVER w, n) AS end_index
  FROM wb JOIN n USING (document_id) WHERE before IS NULL OR ({overlap_sql('before', 'ws')}) < 1 - 0.35::DOUBLE WINDOW w AS (PARTITION BY document_id ORDER BY element_index))"""


@query(f"WITH {_ISLANDS} SELECT document_id, order_index::BIGINT AS order_index, start_index::BIGINT AS start_index, end_index::BIGINT AS end_index FROM islands")
def topic_shift_sections(spark, sf_dir):
    return ingest.topic_sections(ingest.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")).drop("is_pseudo_section")


def _doc_elements(spark, sf_dir):
    """Whole documents as one element each."""
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("element_index"), "text", F.lit("paragraph").alias("type"))


_CHUNKS = f"""snt AS (SELECT doc_id AS document_id, {sentences_sql('text')} AS ss FROM documents WHERE text IS NOT NULL),
ks AS (SELECT *, unnest(range(CASE WHEN len(ss) = 0 THEN 0 WHEN len(ss) <= 10 THEN 1 ELSE ceil((len(ss) - 10) / 8.0)::BIGINT + 1 END)) AS k FROM snt),
chunks AS (SELECT document_id, k AS chunk_index, k * 8 AS start_sentence, least(k * 8 + 10, len(ss)) - 1 AS end_sentence, array_to_string(ss[k * 8 + 1:k * 8 + 10], ' ') AS chunk_text FROM ks)"""


@query(f"WITH {_CHUNKS} SELECT document_id, chunk_index::BIGINT AS chunk_index, start_sentence::BIGINT AS start_sentence, end_sentence::BIGINT AS end_sentence, md5(chunk_text) AS digest FROM chunks")
def sentence_chunks(spark, sf_dir):
    chunks = ingest.sentence_chunks(_doc_elements(spark, sf_dir))
    return chunks.select("document_id", "chunk_index", "start_sentence", "end_sentence", F.md5("chunk_text").alias("digest"))


_BODY = """marked AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY element_index ROWS UNBOUNDED PRECEDING) AS section_title FROM elements)"""


@query(
    f"WITH {ELEMENTS_SQL}, {_BODY} SELECT document_id, element_index::BIGINT AS element_index, "
    "CASE WHEN section_title IS NULL OR section_title = '' OR section_title = url THEN url ELSE url || ' > ' || section_title END AS context_capsule "
    "FROM marked JOIN pages ON page_id = document_id WHERE type <> 'heading'"
)
def context_capsules(spark, sf_dir):
    titles = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.col("url").alias("title"))
    body = ingest.with_heading(page_elements(spark, sf_dir)).join(titles, "document_id")
    return body.select("document_id", F.col("element_index").cast("long").alias("element_index"), ingest.capsule(F.col("title"), F.col("section_title")).alias("context_capsule"))


@query(
    f"WITH {ELEMENTS_SQL}, b AS (SELECT document_id, element_index, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY element_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start "
    "FROM elements WHERE type <> 'heading') SELECT document_id, element_index::BIGINT AS element_index, char_start FROM b"
)
def running_offsets(spark, sf_dir):
    body = ingest.with_heading(page_elements(spark, sf_dir))
    return ingest.running_offsets(body).select("document_id", F.col("element_index").cast("long").alias("element_index"), "char_start")


@query(
    rf"WITH {PARAGRAPHS_SQL} SELECT document_id, greatest(1, round_even(sum(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))) / 400.0::DOUBLE, 0)::BIGINT)::BIGINT AS page_count FROM paragraphs GROUP BY document_id"
)
def page_estimate(spark, sf_dir):
    return ingest.page_estimate(ingest.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(
    f"WITH {_HEADED} SELECT e.document_id, e.element_index::BIGINT AS element_index, coalesce(h.order_index, -1)::BIGINT AS order_index FROM elements e "
    "LEFT JOIN headed h ON h.document_id = e.document_id AND e.element_index >= h.start_index AND e.element_index < h.end_index"
)
def section_assignment(spark, sf_dir):
    elements = page_elements(spark, sf_dir)
    rows = ingest.assign_sections(elements, ingest.headed_sections(elements))
    return rows.withColumn("order_index", F.coalesce("order_index", F.lit(-1).cast("long")))


_RANGES = f"""{_HEADED},
ranged AS (SELECT h.document_id, h.order_index, min(page_number) AS page_start, max(page_number) AS page_end FROM headed h
  LEFT JOIN elements e ON e.document_id = h.document_id AND e.element_index >= h.start_index AND e.element_index < h.end_index GROUP BY ALL)"""


@query(f"WITH {_RANGES} SELECT document_id, order_index::BIGINT AS order_index, coalesce(page_start, -1)::BIGINT AS page_start, coalesce(page_end, -1)::BIGINT AS page_end FROM ranged")
def page_ranges(spark, sf_dir):
    elements = page_elements(spark, sf_dir)
    rows = ingest.page_ranges(elements, ingest.headed_sections(elements))
    return rows.select("document_id", "order_index", *(F.coalesce(F.col(c), F.lit(-1)).cast("long").alias(c) for c in ("page_start", "page_end")))


@query(
    f"WITH {_RANGES} SELECT e.document_id, e.element_index::BIGINT AS chunk_id, coalesce(max(order_index), -1)::BIGINT AS order_index FROM elements e "
    "LEFT JOIN ranged r ON r.document_id = e.document_id AND e.page_number BETWEEN coalesce(page_start, 0) AND coalesce(page_end, 1000000000) WHERE type <> 'heading' GROUP BY ALL"
)
def section_relink_last_wins(spark, sf_dir):
    elements = page_elements(spark, sf_dir)
    sections = ingest.page_ranges(elements, ingest.headed_sections(elements))
    chunks = elements.where("type <> 'heading'").select("document_id", F.col("element_index").cast("long").alias("chunk_id"), "page_number")
    return ingest.relink_by_page(chunks, sections).select("document_id", "chunk_id", F.coalesce("order_index", F.lit(-1).cast("long")).alias("order_index"))


@query("SELECT event_id, value IS NOT NULL AND value / 100 < 0.6::DOUBLE AS low_confidence_ocr FROM events")
def low_confidence_flag(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ingest.low_confidence(F.col("value") / 100).alias("low_confidence_ocr"))


@query(
    f"WITH {_ISLANDS}, pc AS (SELECT document_id, greatest(1, round_even(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) / 400.0::DOUBLE, 0)) AS pages FROM paragraphs GROUP BY document_id) "
    "SELECT document_id, count(*)::BIGINT AS n_sections FROM islands JOIN pc USING (document_id) WHERE pages > 5 GROUP BY document_id"
)
def section_gate(spark, sf_dir):
    elements = ingest.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return ingest.structural_index(elements, ingest.page_estimate(elements)).groupBy("document_id").agg(F.count("*").alias("n_sections"))


@query(
    f"WITH {_HEADED}, c AS (SELECT document_id, count(*) AS chunk_count, count(*) FILTER (length(text) % 10 = 0) AS table_count FROM elements WHERE type <> 'heading' GROUP BY document_id), "
    "s AS (SELECT document_id, count(*) AS section_count FROM headed GROUP BY document_id) "
    "SELECT c.document_id, chunk_count::BIGINT AS chunk_count, table_count::BIGINT AS table_count, coalesce(section_count, 0)::BIGINT AS section_count FROM c LEFT JOIN s USING (document_id)"
)
def ingest_counts(spark, sf_dir):
    elements = page_elements(spark, sf_dir)
    chunks = elements.where("type <> 'heading'").withColumn("chunk_type", F.when(F.length("text") % 10 == 0, "table").otherwise("paragraph"))
    return ingest.ingest_counts(chunks, ingest.headed_sections(elements))


@query(
    f"WITH snt AS (SELECT doc_id, {sentences_sql('text')} AS ss FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, len(ss)::BIGINT AS n_sentences, md5(array_to_string(ss, '|')) AS digest FROM snt"
)
def split_sentences(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.sentences(F.col("text")).alias("ss"))
    return rows.select("doc_id", F.size("ss").cast("long").alias("n_sentences"), F.md5(F.array_join("ss", "|")).alias("digest"))


_CLAUSE = r"(?i)(^|\s)(and|but|or|nor|yet|because|while|although|whereas|which|that)\s|,\s+\w+(ing|ed)\s"


@query(
    f"WITH snt AS (SELECT item_id, {sentences_sql('text')} AS ss FROM benchmark), s AS (SELECT item_id, unnest(range(len(ss))) AS sentence_index, unnest(ss) AS sentence FROM snt) "
    f"SELECT item_id, sentence_index::BIGINT AS sentence_index, sentence AS claim_text, CASE WHEN regexp_matches(sentence, '\\d') THEN 'statistical' ELSE 'definitional' END AS claim_type, 'internal' AS scope "
    f"FROM s WHERE NOT regexp_matches(sentence, '{_CLAUSE}')"
)
def direct_claims(spark, sf_dir):
    chunks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("document_id"), F.col("item_id").alias("chunk_id"), F.lit("paragraph").alias("chunk_type"), F.col("text").alias("chunk_text"))
    rows = extract.extract_claims(chunks)
    return rows.select(F.col("document_id").alias("item_id"), F.col("sentence_index").cast("long").alias("sentence_index"), "claim_text", "claim_type", "scope")


@query(f"WITH {PARAGRAPHS_SQL} SELECT document_id, element_index::BIGINT AS element_index, regexp_matches(text, '{_CLAUSE}') AS decompose FROM paragraphs")
def clause_gate(spark, sf_dir):
    rows = ingest.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("document_id", F.col("element_index").cast("long").alias("element_index"), X.needs_decomposition(F.col("text")).alias("decompose"))


@query(
    rf"""WITH RECURSIVE {PARAGRAPHS_SQL.lstrip()},
sized AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY element_index) AS i, element_index, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS words FROM paragraphs),
walk AS (SELECT document_id, i, element_index, words, 0::BIGINT AS batch, words AS used FROM sized WHERE i = 1
  UNION ALL SELECT s.document_id, s.i, s.element_index, s.words, CASE WHEN used + s.words > 300 THEN batch + 1 ELSE batch END, CASE WHEN used + s.words > 300 THEN s.words ELSE used + s.words END
  FROM walk JOIN sized s ON s.document_id = walk.document_id AND s.i = walk.i + 1)
SELECT document_id, element_index::BIGINT AS element_index, words, batch FROM walk"""
)
def greedy_batches(spark, sf_dir):
    rows = ingest.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")
    sized = rows.select("document_id", F.col("element_index").cast("long").alias("element_index"), X.word_count(F.col("text")).alias("words"))
    return batching.batches(sized, "document_id", "element_index", "words", most=300)


@query(
    r"SELECT doc_id AS section_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS summary_words, "
    r"CASE WHEN len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) <= 3000 THEN 'direct' ELSE 'batch_and_reduce' END AS summary_method FROM documents WHERE text IS NOT NULL"
)
def summary_plan(spark, sf_dir):
    return batching.summary_plan(table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("section_id"), "text"))


# --- page layout: words laid out from line items -------------------------------------------------

_LAID = """laid AS (SELECT l_suppkey AS document_id, (l_orderkey % 4 + 1)::INTEGER AS page_number, l_returnflag || l_linenumber || '-' || l_orderkey AS text,
  ((l_orderkey * 37 + l_linenumber * 11) % 500)::DOUBLE AS x0, ((l_orderkey * 13 + l_linenumber * 7) % 700)::DOUBLE AS top, CASE WHEN l_orderkey % 9 = 0 THEN 16.0 ELSE 11.0 END::DOUBLE AS size FROM lineitem),
boxes AS (SELECT s_suppkey AS document_id, (s_suppkey % 4 + 1)::INTEGER AS page_number, 50.0::DOUBLE AS x0, 100.0::DOUBLE AS top, 300.0::DOUBLE AS x1, 400.0::DOUBLE AS bottom FROM supplier)"""


def _words(spark, sf_dir):
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("document_id"),
        (key % 4 + 1).cast("int").alias("page_number"),
        F.concat("l_returnflag", line.cast("string"), F.lit("-"), key.cast("string")).alias("text"),
        ((key * 37 + line * 11) % 500).cast("double").alias("x0"),
        ((key * 13 + line * 7) % 700).cast("double").alias("top"),
        F.when(key % 9 == 0, 16.0).otherwise(11.0).alias("size"),
    )


def _boxes(spark, sf_dir):
    doc = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        doc.alias("document_id"), (doc % 4 + 1).cast("int").alias("page_number"), *(F.lit(v).alias(n) for n, v in (("x0", 50.0), ("top", 100.0), ("x1", 300.0), ("bottom", 400.0)))
    )


@query(
    f"WITH {_LAID} SELECT document_id, page_number::BIGINT AS page_number, text FROM laid l WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.document_id = l.document_id AND b.page_number = l.page_number "
    "AND l.x0 BETWEEN b.x0 AND b.x1 AND l.top BETWEEN b.top AND b.bottom)"
)
def bbox_exclusion(spark, sf_dir):
    rows = layout.outside_tables(_words(spark, sf_dir), _boxes(spark, sf_dir))
    return rows.select("document_id", F.col("page_number").cast("long").alias("page_number"), "text")


@query(f"WITH {_LAID} SELECT document_id, page_number::BIGINT AS page_number, round(median(size) * 1.15, 6) AS threshold FROM laid GROUP BY ALL")
def heading_thresholds(spark, sf_dir):
    rows = layout.heading_threshold(_words(spark, sf_dir))
    return rows.select("document_id", F.col("page_number").cast("long").alias("page_number"), F.round("threshold", 6).alias("threshold"))


def _lines_sql(words: str) -> str:
    """Words folded to lines, in order; the words come from the table named."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY top, x0, text, size) AS i FROM {words}),
walk AS (SELECT document_id, page_number, i, text, size, top AS anchor, 0::BIGINT AS line_index FROM o WHERE i = 1
  UNION ALL SELECT o.document_id, o.page_number, o.i, o.text, o.size, CASE WHEN abs(walk.anchor - o.top) < 3 THEN walk.anchor ELSE o.top END, CASE WHEN abs(walk.anchor - o.top) < 3 THEN line_index ELSE line_index + 1 END
  FROM walk JOIN o ON o.document_id = walk.document_id AND o.page_number = walk.page_number AND o.i = walk.i + 1),
page_lines AS (SELECT document_id, page_number, line_index, min(anchor) AS top, string_agg(text, ' ' ORDER BY i) AS text, avg(size) AS size FROM walk GROUP BY document_id, page_number, line_index)"""


def _blocks_sql(words: str) -> str:
    """Lines folded to blocks; a page's threshold comes from all its words."""
    joins = "l.type = w.type AND abs(l.size - w.size) < 0.5 AND l.top - w.last < w.size * 1.9"
    return f"""{_lines_sql(words)},
bounds AS (SELECT document_id, page_number, median(size) * 1.15 AS threshold FROM laid GROUP BY ALL),
l AS (SELECT p.*, CASE WHEN size >= threshold THEN 'heading' ELSE 'paragraph' END AS type FROM page_lines p JOIN bounds USING (document_id, page_number)),
bw AS (SELECT document_id, page_number, line_index, type, text, top, top AS last, size, 0::BIGINT AS block_index FROM l WHERE line_index = 0
  UNION ALL SELECT l.document_id, l.page_number, l.line_index, l.type, l.text, CASE WHEN {joins} THEN w.top ELSE l.top END, l.top, CASE WHEN {joins} THEN w.size ELSE l.size END, CASE WHEN {joins} THEN w.block_index ELSE w.block_index + 1 END
  FROM bw w JOIN l ON l.document_id = w.document_id AND l.page_number = w.page_number AND l.line_index = w.line_index + 1),
blocks AS (SELECT document_id, page_number, block_index, min(type) AS type, min(top) AS top, string_agg(text, ' ' ORDER BY line_index) AS text FROM bw GROUP BY document_id, page_number, block_index)"""


@query(f"WITH RECURSIVE {_LAID}, {_lines_sql('laid')} SELECT document_id, page_number::BIGINT AS page_number, line_index, top, text, round(size, 6) AS size FROM page_lines")
def line_grouping(spark, sf_dir):
    rows = layout.lines(_words(spark, sf_dir))
    return rows.select("document_id", F.col("page_number").cast("long").alias("page_number"), "line_index", "top", "text", F.round("size", 6).alias("size"))


@query(f"WITH RECURSIVE {_LAID}, {_blocks_sql('laid')} SELECT document_id, page_number::BIGINT AS page_number, block_index, type, top, text FROM blocks")
def block_merge(spark, sf_dir):
    """A fold over a fold."""
    words = _words(spark, sf_dir)
    return layout.blocks(layout.lines(words), layout.heading_threshold(words)).withColumn("page_number", F.col("page_number").cast("long"))


@query(
    f"""WITH RECURSIVE {_LAID}, free AS (SELECT * FROM laid l WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.document_id = l.document_id AND b.page_number = l.page_number AND l.x0 BETWEEN b.x0 AND b.x1 AND l.top BETWEEN b.top AND b.bottom)),
{_blocks_sql('free')},
parts AS (SELECT document_id, page_number, type, top, text FROM blocks UNION ALL SELECT document_id, page_number, 'table', top, NULL FROM boxes)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, top, type, text NULLS FIRST) - 1 AS element_index, page_number::BIGINT AS page_number, type, coalesce(text, '') AS text FROM parts"""
)
def native_page_elements(spark, sf_dir):
    """Text blocks outside tables and the tables, in reading order."""
    boxes = _boxes(spark, sf_dir).withColumn("data", F.array(F.array(F.lit("cell"))))
    rows = layout.page_elements(_words(spark, sf_dir), boxes)
    return rows.select("document_id", F.col("element_index").cast("long").alias("element_index"), F.col("page_number").cast("long").alias("page_number"), "type", F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT page_id, CASE WHEN length(trim(coalesce(url, ''), ' ')) > 20 THEN 'native' ELSE 'ocr' END AS source FROM pages")
def page_native_split(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text"))
    return layout.native_pages(pages).select("page_id", "source")


@query(
    "WITH o AS (SELECT user_id AS document_id, event_id % 3 AS page_number, event_id AS ordinal, event_type AS text, CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE (event_id % 100)::DOUBLE END AS conf FROM events) "
    "SELECT document_id, page_number::BIGINT AS page_number, md5(string_agg(text, ' ' ORDER BY ordinal)) AS digest, round(coalesce(avg(CASE WHEN conf <> -1 THEN conf END) / 100, 0), 9) AS ocr_confidence FROM o GROUP BY ALL"
)
def ocr_pages(spark, sf_dir):
    e = F.col("event_id")
    words = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("document_id"), (e % 3).alias("page_number"), e.alias("ordinal"), F.col("event_type").alias("text"), F.when(e % 5 == 0, -1.0).otherwise((e % 100).cast("double")).alias("conf")
    )
    rows = layout.ocr_pages(words)
    return rows.select("document_id", "page_number", F.md5("text").alias("digest"), F.round("ocr_confidence", 9).alias("ocr_confidence"))
