"""Greedy packing in order, and summaries of sections that don't fit one call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import config
from plumbline.functions import text as X
from plumbline.staging import stored

T = config.THRESHOLDS


def pack(sizes: Column, *, most: int, items: int | None = None) -> Column:
    """array<bigint>: the batch number of every item of an ordered array of sizes. A batch closes before the item that
    would exceed ``most`` (or ``items`` items); an item is never split."""
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("out"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, size: Column) -> Column:
        full = state["used"] + size > most
        if items is not None:
            full = full | (state["n"] >= items)
        close = (state["n"] > 0) & full
        batch = state["batch"] + close.cast("long")
        used = F.when(close, size.cast("long")).otherwise(state["used"] + size)
        n = F.when(close, F.lit(1).cast("long")).otherwise(state["n"] + 1)
        return F.struct(F.concat(state["out"], F.array(batch)).alias("out"), batch.alias("batch"), used.alias("used"), n.alias("n"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def batches(rows: DataFrame, group: str, ordinal: str, size: str, *, most: int, items: int | None = None) -> DataFrame:
    """(group, ordinal, size, batch) of rows packed in order within each group (a document's or section's)."""
    lists = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(ordinal), F.col(size).cast("long").alias("__size")))).alias("__l"))
    packed = lists.withColumn("__b", pack(F.transform("__l", lambda x: x["__size"]), most=most, items=items))
    out = packed.select(group, F.explode(F.arrays_zip("__l", "__b")).alias("x"))
    return out.select(group, F.col(f"x.__l.{ordinal}").alias(ordinal), F.col("x.__l.__size").alias(size), F.col("x.__b").alias("batch"))


def summarize_sections(chunks: DataFrame, summarize: Callable[[DataFrame], DataFrame], direct: int = T["summary_direct_words"], rounds: int = 8) -> DataFrame:
    """(section_id, summary, calls): sections of at most ``direct`` words in one call, larger ones batch by batch, their
    summaries again the same way. chunks: (section_id, ordinal, text); ``summarize``: (section_id, batch, text) -> with
    ``summary``; a section with an answer that is null (no access) ends with none. Every round is written, since a model's
    answer must not be asked for twice."""
    done, left = None, chunks.select("section_id", "ordinal", "text", F.lit(0).cast("long").alias("calls"))
    for _ in range(rounds):
        sized = left.withColumn("words", X.word_count(F.col("text")))
        packed = batches(sized, "section_id", "ordinal", "words", most=direct).join(left, ["section_id", "ordinal"])
        texts = packed.groupBy("section_id", "batch").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"), F.max("calls").alias("calls")
        )
        asked = stored(summarize(texts), "summaries")
        many = asked.groupBy("section_id").agg(F.count("*").alias("n"), F.bool_or(F.col("summary").isNull()).alias("blocked"))
        rows = asked.join(many, "section_id").withColumn("calls", F.col("calls") + F.col("n"))
        refused = rows.where("blocked").groupBy("section_id").agg(F.lit(None).cast("string").alias("summary"), F.max("calls").alias("calls"))
        rows = rows.where("not blocked")
        whole = rows.where("n = 1").select("section_id", "summary", "calls").unionByName(refused)
        done = whole if done is None else done.unionByName(whole)
        left = rows.where("n > 1").select("section_id", F.col("batch").alias("ordinal"), F.col("summary").alias("text"), "calls")
        if left.isEmpty():
            return done
    raise ValueError(f"sections didn't reduce in {rounds} rounds")


def summary_plan(sections: DataFrame, direct: int = T["summary_direct_words"]) -> DataFrame:
    """sections: (section_id, text) -> word count and method."""
    words = X.word_count(F.col("text"))
    return sections.select("section_id", words.alias("summary_words"), F.when(words <= direct, "direct").otherwise("batch_and_reduce").alias("summary_method"))
