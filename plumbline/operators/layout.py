"""Page layout: words to lines, lines to blocks, table areas, native and scanned pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline import config

LINE_GAP, SIZE_GAP, BLOCK_GAP, HEADING_RATIO, BODY_SIZE = 3.0, 0.5, 1.9, 1.15, 11.0
PAGE = ("document_id", "page_number")


def native_pages(pages: DataFrame, threshold: int = config.THRESHOLDS["native_text_chars"]) -> DataFrame:
    """Pages marked native (more text than the threshold) or scanned."""
    return pages.withColumn("source", F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) > threshold, "native").otherwise("ocr"))


def outside_tables(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose corner lies in no table of their page."""
    b = boxes.select(*PAGE, F.col("x0").alias("bx0"), F.col("top").alias("btop"), "x1", "bottom")
    inside = F.col("x0").between(F.col("bx0"), F.col("x1")) & F.col("top").between(F.col("btop"), F.col("bottom"))
    same = (words.document_id == b.document_id) & (words.page_number == b.page_number)
    return words.join(b, same & inside, "left_anti")


def lines(words: DataFrame) -> DataFrame:
    """Lines of each page: (document_id, page_number, line_index, top, text, size). A word joins the line whose first word's top
    is less than LINE_GAP away; sizes are means. A page's words are one array, folded in order."""
    entry = F.struct(F.bround("top").alias("level"), "x0", "top", "text", "size")
    pages = words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(entry)).alias("w"))
    start = F.expr("cast(array() as array<struct<top: double, texts: array<string>, sizes: array<double>>>)")

    def step(out: Column, w: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = last.isNotNull() & (F.abs(last["top"] - w["top"]) < LINE_GAP)
        grown = F.struct(last["top"].alias("top"), F.concat(last["texts"], F.array(w["text"])).alias("texts"), F.concat(last["sizes"], F.array(w["size"])).alias("sizes"))
        fresh = F.struct(w["top"].alias("top"), F.array(w["text"]).alias("texts"), F.array(w["size"]).alias("sizes"))
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(fresh)))

    folded = pages.select(*PAGE, F.posexplode(F.aggregate("w", start, step)).alias("line_index", "l"))
    mean = F.aggregate("l.sizes", F.lit(0.0), lambda s, x: s + x) / F.size("l.sizes")
    return folded.select(*PAGE, F.col("line_index").cast("long").alias("line_index"), "l.top", F.array_join("l.texts", " ").alias("text"), mean.alias("size"))


def heading_threshold(words: DataFrame) -> DataFrame:
    """(document_id, page_number, threshold): HEADING_RATIO times the median word size."""
    return words.groupBy(*PAGE).agg((F.coalesce(F.median("size"), F.lit(BODY_SIZE)) * HEADING_RATIO).alias("threshold"))


def blocks(page_lines: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Blocks of each page: (document_id, page_number, block_index, type, top, text). A line stays in the block of the same type whose first
    line's size is near and whose last line is less than BLOCK_GAP sizes above."""
    rows = page_lines.join(thresholds, list(PAGE))
    kind = F.when(F.col("size") >= F.col("threshold"), "heading").otherwise("paragraph")
    entry = F.struct("line_index", "top", "text", "size", kind.alias("type"))
    pages = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(entry)).alias("l"))
    start = F.expr("cast(array() as array<struct<type: string, texts: array<string>, top: double, last: double, size: double>>)")

    def step(out: Column, x: Column) -> Column:
        b = F.try_element_at(out, F.lit(-1))
        same = b.isNotNull() & (b["type"] == x["type"]) & (F.abs(x["size"] - b["size"]) < SIZE_GAP) & (x["top"] - b["last"] < b["size"] * BLOCK_GAP)
        grown = F.struct(b["type"].alias("type"), F.concat(b["texts"], F.array(x["text"])).alias("texts"), b["top"].alias("top"), x["top"].alias("last"), b["size"].alias("size"))
        fresh = F.struct(x["type"].alias("type"), F.array(x["text"]).alias("texts"), x["top"].alias("top"), x["top"].alias("last"), x["size"].alias("size"))
        return F.when(same, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(fresh)))

    folded = pages.select(*PAGE, F.posexplode(F.aggregate("l", start, step)).alias("block_index", "b"))
    return folded.select(*PAGE, F.col("block_index").cast("long").alias("block_index"), "b.type", "b.top", F.array_join("b.texts", " ").alias("text"))


def page_elements(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Elements of native pages in reading order: text blocks outside tables, and the tables."""
    free = outside_tables(words, boxes)
    texts = blocks(lines(free), heading_threshold(words)).select(*PAGE, "type", "text", "top")
    tables = boxes.select(*PAGE, F.lit("table").alias("type"), "data", "top")
    both = texts.unionByName(tables, allowMissingColumns=True)
    return both.withColumn("element_index", _place()).withColumn("source", F.lit("native"))


def _place() -> Column:
    order = Window.partitionBy("document_id").orderBy("page_number", "top", "type", "text")
    return (F.row_number().over(order) - 1).cast("int")


def document_elements(words: DataFrame, boxes: DataFrame, ocr_words: DataFrame) -> DataFrame:
    """Elements of whole documents in the order of their pages: native pages as laid out, a scanned page that holds text as
    one paragraph with its confidence."""
    native = page_elements(words, boxes).drop("element_index")
    scanned = ocr_pages(ocr_words).where("text <> ''").select(*PAGE, F.lit("paragraph").alias("type"), "text", F.lit(0.0).alias("top"), F.lit("ocr").alias("source"), "ocr_confidence")
    return native.unionByName(scanned, allowMissingColumns=True).withColumn("element_index", _place())


def ocr_pages(ocr_words: DataFrame) -> DataFrame:
    """Scanned pages: non-blank words in order, and the mean confidence without the -1 marks, over 100 (0 if none).

    ocr_words: (document_id, page_number, ordinal, text, conf).
    """
    kept = F.filter(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda w: F.trim(w["text"]) != "")
    mean = F.avg(F.when(F.col("conf") != -1, F.col("conf"))) / 100
    return ocr_words.groupBy(*PAGE).agg(F.array_join(F.transform(kept, lambda w: w["text"]), " ").alias("text"), F.coalesce(mean, F.lit(0.0)).alias("ocr_confidence"))
