"""From elements to titles, sections and overlapping sentence chunks.

Elements: (document_id, element_index, type, text, ...). Windows are partitioned by document, so
one task never holds more than whole documents; nothing is shuffled but by document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline import config
from plumbline.functions import text as X
from plumbline.operators import batching
from plumbline.schemas import key
from plumbline.staging import stored

T = config.THRESHOLDS


def paragraphs(docs: DataFrame, document_id: str, text: str) -> DataFrame:
    """Lines of a text that aren't blank, as paragraph elements that keep their ordinals."""
    rows = docs.select(F.col(document_id).alias("document_id"), F.posexplode(F.split(text, "\n")).alias("element_index", "text"))
    return rows.where(F.trim("text") != "").withColumn("type", F.lit("paragraph"))


def document_titles(elements: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, title): the first heading's text, else the file name; an empty heading doesn't count as text."""
    heads = elements.where("type = 'heading'").groupBy("document_id").agg(F.min_by("text", "element_index").alias("head"))
    joined = documents.join(heads, "document_id", "left")
    return joined.select("document_id", F.coalesce(F.nullif("head", F.lit("")), "filename").alias("title"))


def _by_document() -> Window:
    return Window.partitionBy("document_id").orderBy("element_index")


def with_heading(elements: DataFrame) -> DataFrame:
    """Body elements with the text of the heading that they stand under (``section_title``, null before the first)."""
    above = F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True)
    carried = above.over(_by_document().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return elements.withColumn("section_title", carried).where("type <> 'heading'")


def capsule(title: Column, section: Column) -> Column:
    """Title > section, or the title alone where the section is missing, empty or the title itself."""
    alone = section.isNull() | (section == "") | (section == title)
    return F.when(alone, title).otherwise(F.concat_ws(" > ", title, section))


def running_offsets(elements: DataFrame) -> DataFrame:
    """Character offset of every body element: what precedes it, a line feed after each."""
    w = _by_document().rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("text") + 1
    return elements.withColumn("char_start", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def windows(sentences: Column, size: int = T["window_sentences"], overlap: int = T["window_overlap"]) -> Column:
    """array<struct(chunk_index, start_sentence, end_sentence, chunk_text)>: windows that advance by
    size - overlap and end with the one that reaches the last sentence."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window")
    step = size - overlap
    n = F.size(sentences)
    many = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), lambda k: k < many)

    def window(k: Column) -> Column:
        return F.struct(
            k.cast("long").alias("chunk_index"),
            (k * step).cast("long").alias("start_sentence"),
            (F.least(k * step + size, n) - 1).cast("long").alias("end_sentence"),
            F.array_join(F.slice(sentences, k * step + 1, size), " ").alias("chunk_text"),
        )

    return F.transform(starts, window)


def sentence_chunks(elements: DataFrame, *keep: str, size: int = T["window_sentences"], overlap: int = T["window_overlap"]) -> DataFrame:
    """One row a window of every body element; an element without sentences gives none."""
    rows = elements.select("document_id", "element_index", *keep, X.sentences(F.col("text")).alias("__s"))
    return rows.select("document_id", "element_index", *keep, F.inline(windows(F.col("__s"), size, overlap)))


def page_estimate(elements: DataFrame) -> DataFrame:
    """(document_id, page_count): words outside tables over 400, half to even, at least 1."""
    words = F.sum(F.when(F.col("type") != "table", X.word_count(F.col("text"))))
    estimate = F.bround(F.coalesce(words, F.lit(0)) / T["words_a_page"]).cast("long")
    return elements.groupBy("document_id").agg(F.greatest(F.lit(1), estimate).alias("page_count"))


def headed_sections(elements: DataFrame) -> DataFrame:
    """A section for every heading: the elements after it, up to the next heading or the end."""
    sizes = elements.groupBy("document_id").agg((F.max("element_index") + 1).alias("n"))
    heads = elements.where("type = 'heading'").join(sizes, "document_id")
    w = _by_document()
    return heads.select(
        "document_id",
        F.col("text").alias("title"),
        (F.row_number().over(w) - 1).cast("long").alias("order_index"),
        (F.col("element_index") + 1).cast("long").alias("start_index"),
        F.coalesce(F.lead("element_index").over(w), F.col("n")).cast("long").alias("end_index"),
        F.lit(False).alias("is_pseudo_section"),
    )


def topic_sections(elements: DataFrame, sensitivity: float = T["topic_shift_sensitivity"]) -> DataFrame:
    """Pseudo-sections: a paragraph opens one when its word overlap with the paragraph before is below
    1 - sensitivity; sections run to the next one's start, in element positions."""
    sizes = elements.groupBy("document_id").agg((F.max("element_index") + 1).alias("n"))
    w = _by_document()
    body = elements.where("type = 'paragraph'").select("document_id", "element_index", X.content_words(F.col("text")).alias("words"))
    before = F.lag("words").over(w)
    opens = before.isNull() | (X.overlap(before, F.col("words")) < 1 - sensitivity)
    starts = body.withColumn("opens", opens).where("opens").join(sizes, "document_id")
    return starts.select(
        "document_id",
        (F.row_number().over(w) - 1).cast("long").alias("order_index"),
        F.col("element_index").cast("long").alias("start_index"),
        F.coalesce(F.lead("element_index").over(w), F.col("n")).cast("long").alias("end_index"),
        F.lit(True).alias("is_pseudo_section"),
    )


def structural_index(elements: DataFrame, pages: DataFrame, short: int = T["short_document_pages"]) -> DataFrame:
    """Sections of long documents: by headings where there are any, else by topic."""
    kinds = elements.groupBy("document_id").agg(F.bool_or(F.col("type") == "heading").alias("headed"))
    gate = kinds.join(pages.where(F.col("page_count") > short), "document_id").select("document_id", "headed")
    rows = elements.join(gate, "document_id")
    headed = headed_sections(rows.where("headed").drop("headed"))
    return headed.unionByName(topic_sections(rows.where("not headed").drop("headed")), allowMissingColumns=True)


def page_ranges(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections with the smallest and largest page of their elements, null where none has a page."""
    pages = elements.select("document_id", F.col("element_index").cast("long").alias("element_index"), "page_number")
    inside = assign_sections(elements, sections).where("order_index is not null").join(pages, ["document_id", "element_index"])
    spans = inside.groupBy("document_id", "order_index").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
    return sections.join(spans, ["document_id", "order_index"], "left")


def assign_sections(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """Elements with the first section whose interval holds them (``order_index``, null before the first).

    Sections of a document don't overlap and come in order, so the holder is the last one that starts at or
    before the element: a merge of starts and elements by position, without a range join.
    """
    starts = sections.where("start_index < end_index").select(
        "document_id", F.col("start_index").alias("at"), F.lit(0).alias("side"), F.struct("order_index", "end_index").alias("section")
    )
    body = elements.select("document_id", F.col("element_index").cast("long").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<order_index:bigint,end_index:bigint>").alias("section"))
    w = Window.partitionBy("document_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = starts.unionByName(body).withColumn("holder", F.last("section", ignorenulls=True).over(w)).where("side = 1")
    order = F.when(F.col("at") < F.col("holder.end_index"), F.col("holder.order_index"))
    return met.select("document_id", F.col("at").alias("element_index"), order.alias("order_index"))


def relink_by_page(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks with the last section (by order) whose pages hold theirs; missing bounds are open, and a chunk
    without page has none.

    Sections are laid out to the pages that their document's chunks have, each page keeps its last section, and
    chunks meet their page: rows grow with pages, not with chunks times sections.
    """
    seen = chunks.where("page_number is not null").select("document_id", "page_number").distinct()
    reach = seen.groupBy("document_id").agg(F.min("page_number").alias("first"), F.max("page_number").alias("end"))
    bounds = sections.select("document_id", "order_index", F.coalesce("page_start", F.lit(0)).alias("lo"), F.coalesce("page_end", F.lit(10**9)).alias("hi")).join(reach, "document_id")
    bounds = bounds.withColumn("lo", F.greatest("lo", "first")).withColumn("hi", F.least("hi", "end")).where("lo <= hi")
    pages = bounds.select("document_id", "order_index", F.explode(F.sequence(F.col("lo").cast("long"), F.col("hi").cast("long"))).alias("__page"))
    last = pages.groupBy("document_id", "__page").agg(F.max("order_index").alias("order_index"))
    return chunks.withColumn("__page", F.col("page_number").cast("long")).join(last, ["document_id", "__page"], "left").drop("__page")


def low_confidence(confidence: Column, threshold: float = T["ocr_confidence"]) -> Column:
    return confidence.isNotNull() & (confidence < threshold)


def ingest_counts(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(document_id, chunk_count, table_count, section_count)."""
    a = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.count_if(F.col("chunk_type") == "table").alias("table_count"))
    b = sections.groupBy("document_id").agg(F.count("*").alias("section_count"))
    return a.join(b, "document_id", "left").withColumn("section_count", F.coalesce("section_count", F.lit(0).cast("long")))


def section_texts(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """(section_id, document_id, order_index, ordinal, text): what stands in each section, tables as JSON."""
    inside = assign_sections(elements, sections).where("order_index is not null")
    text = F.when(F.col("type") == "table", F.to_json("data")).otherwise(F.col("text")) if "data" in elements.columns else F.col("text")
    rows = elements.select("document_id", F.col("element_index").cast("long").alias("element_index"), text.alias("text"))
    met = rows.join(inside, ["document_id", "element_index"])
    return met.select(key(F.col("document_id"), F.col("order_index")).alias("section_id"), "document_id", "order_index", F.col("element_index").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"))


def with_summaries(sections: DataFrame, elements: DataFrame, summarize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sections with summary, its word count and how it was made: direct, batch_and_reduce, or blocked_credentials where the
    provider had no access. A section that holds nothing has none of the three."""
    texts = section_texts(elements, sections)
    made = batching.summarize_sections(texts.select("section_id", "ordinal", "text"), summarize)
    method = F.when(F.col("summary").isNull(), "blocked_credentials").when(F.col("calls") > 1, "batch_and_reduce").otherwise("direct")
    words = F.when(F.col("summary").isNotNull(), X.word_count(F.col("summary")))
    made = made.select("section_id", "summary", words.alias("summary_word_count"), method.alias("summary_method"))
    return sections.withColumn("section_id", key(F.col("document_id"), F.col("order_index"))).join(made, "section_id", "left")


def finalize_structure(elements: DataFrame, chunks: DataFrame, pages: DataFrame, summarize: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The index of documents whose chunks arrived page by page: sections with their pages (and summaries), every chunk
    with the last section whose pages hold its page, documents as ingested.

    chunks: (document_id, chunk_id, page_number, ...); pages: (document_id, page_count)."""
    sections = structural_index(elements, pages)
    sections = with_summaries(sections, elements, summarize) if summarize else sections
    sections = stored(page_ranges(elements, sections), "sections")
    linked = relink_by_page(chunks.drop("order_index"), sections)
    indexed = sections.select("document_id").distinct().withColumn("has_structural_index", F.lit(True))
    done = pages.join(indexed, "document_id", "left").withColumn("has_structural_index", F.coalesce("has_structural_index", F.lit(False)))
    return {"documents": done.withColumn("status", F.lit("ingested")), "sections": sections, "chunks": linked}


def display_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks as they are shown: without inner positions, marked where they were read with low confidence."""
    shown = chunks.drop("element_index")
    return shown.withColumn("low_confidence_ocr", low_confidence(F.col("ocr_confidence"))) if "ocr_confidence" in chunks.columns else shown


def run_ingestion(elements: DataFrame, documents: DataFrame, summarize: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """documents, sections and chunks of parsed elements, as the sinks write them; sections are summarised where ``summarize`` is given."""
    titles = document_titles(elements, documents)
    pages = page_estimate(elements)
    sections = structural_index(elements, pages)
    sections = stored(with_summaries(sections, elements, summarize), "sections") if summarize else sections
    body = with_heading(elements)
    body = body.withColumn("text", F.when(F.col("type") == "table", X.table_text(F.col("data"))).otherwise(F.col("text"))) if "data" in elements.columns else body
    chunks = sentence_chunks(body, "type", "section_title").join(titles, "document_id")
    chunks = chunks.withColumn("context_capsule", capsule(F.col("title"), F.col("section_title")))
    chunks = chunks.join(assign_sections(elements, sections), ["document_id", "element_index"], "left").withColumnRenamed("type", "chunk_type")
    indexed = sections.select("document_id").distinct().withColumn("has_structural_index", F.lit(True))
    done = documents.join(pages, "document_id", "left").join(indexed, "document_id", "left")
    done = done.withColumn("has_structural_index", F.coalesce("has_structural_index", F.lit(False))).withColumn("status", F.lit("ingested"))
    return {"documents": done, "sections": sections, "chunks": chunks}
