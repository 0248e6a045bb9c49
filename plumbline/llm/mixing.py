"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and CAP. Of all rates that give each source its target of
words, the chosen ones have the least relative entropy to rate 1, sum of r log r - r: the exponential tilt
r = exp(lambda * size), held at CAP. The dual is convex and one lambda a source solves it; Newton steps,
kept inside a bracket that grows until it holds the solution, run for all sources at once over their (size, count)
tables, which are as long as documents' sizes differ, not as documents are many.

Rates become whole copies: the whole part, and one more where a hash of the document, less the
rate's fraction, lies at or below the source's cut. The cut starts near 0 and is moved, exactly to
a document, so that the taken words come as near to the target as one document allows.

Defined cases: null text: size 0, taken 0. Null source: a source of its own, last in the order.
A source without words: target 0. Repeated rows: each is a document, and those with one id and text are taken alike.
Empty table: empty result. Other columns, whatever their names, aren't read by :func:`mix` and pass through
:func:`take_mix`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import cut, skew_join, unit_hash, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often, and no target is larger than so many times its source.
CAP = 3
#: Newton steps of a source at most, and how near to its target, in shares of it, they must come.
STEPS, TOLERANCE = 400, 1e-9
#: Cells of the histogram of keys in which the cut is searched.
CELLS = 1 << 14


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with each one's place in code-point order, null last; a range of them is ordered in each task."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    parts = cut(sources.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "sources")
    sizes = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}  # at most n rows
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    offsets = F.broadcast(sources.sparkSession.createDataFrame(offsets, "part int, before long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("place", place).join(offsets, "part").withColumn("place", F.col("before") + F.col("place")).drop("part", "before")


def capped_targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): shares of all words by weight; what
    exceeds CAP times a source is shared again among the others, until none is above.

    A pass adds up the sources that are full at the level so far, which gives the others' next level; levels only rise.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long")
    rows = cut(_ranked(sources).withColumn("weight", weight).drop("place"), "weights")
    most = CAP * F.col("source_size")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, filled = 0.0, -1
    while True:
        full = most <= F.col("weight") * F.lit(level)
        told = rows.agg(F.count_if(full), F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        if told[0] == filled or not told[2]:
            break
        filled, level = told[0], (total - (told[1] or 0)) / told[2]
    target = F.least(most.cast("double"), F.col("weight") * F.lit(level))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def _rate(tilt: Column) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(F.least(F.lit(700.0), tilt)))


def tilt(size: np.ndarray, count: np.ndarray, target: float) -> float:
    """The lambda that gives ``count`` documents of each ``size`` their target of words, by Newton steps on the
    dual; a step that leaves the bracket halves it instead."""
    at = (size > 0) & (count > 0)
    size, words = size[at].astype(float), (size * count)[at].astype(float)
    if not len(size) or target <= 0 or target >= CAP * words.sum():
        return 0.0

    def got(lam: float) -> tuple[float, float]:
        rate = np.exp(np.minimum(lam * size, 700.0))
        free = rate < CAP
        rate = np.where(free, rate, float(CAP))
        return float(words @ rate), float((words * size) @ np.where(free, rate, 0.0))

    low, high = -1.0 / size.max(), 1.0 / size.max()
    while got(low)[0] > target:
        low *= 2
    while got(high)[0] < target:
        high *= 2
    lam = 0.0
    for _ in range(STEPS):
        taken, slope = got(lam)
        if abs(taken - target) <= TOLERANCE * target:
            return lam
        low, high = (lam, high) if taken < target else (low, lam)
        step = lam + (target - taken) / slope if slope > 0 else np.inf
        lam = step if low < step < high else (low + high) / 2
        if lam in (low, high):
            return lam  # no double lies between
    raise ArithmeticError(f"a source stays off its target of {target} words")


def _pieces(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rate, whole copies and rounding key of every document, given each source's lambda."""
    full = F.col("target") >= CAP * F.col("source_size")
    rate = F.when(full, F.lit(float(CAP))).otherwise(_rate(F.col("lam") * F.col("size")))
    rows = skew_join(docs, plan, "of").withColumn("rate", rate)
    whole = F.least(F.floor("rate"), F.lit(CAP - 1)).cast("long")
    rows = rows.withColumn("whole", F.when(full, F.lit(CAP)).otherwise(whole).cast("long"))
    key = unit_hash(F.col("doc_id"), F.col("text_key")) - (F.col("rate") - F.col("whole"))
    return rows.withColumn("key", F.when(full, F.lit(2.0)).otherwise(key))


_TILTED = T.StructType([T.StructField("of", T.StringType()), T.StructField("source_size", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("target", "lam")])


def _tilted(group: pa.Table) -> pa.Table:
    """One source's rows (of, size, n, source_size, target) to its row of the plan."""
    size, count = (group.column(c).to_numpy() for c in ("size", "n"))
    order = np.argsort(size, kind="stable")
    target = group.column("target")[0].as_py()
    row = {c: group.column(c)[0].as_py() for c in ("of", "source_size", "target")} | {"lam": float(tilt(size[order], count[order], target))}
    kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64())
    return pa.table([pa.array([row[c]], k) for c, k in zip(_TILTED.names, kinds, strict=True)], names=_TILTED.names)


def solve(sized: DataFrame) -> DataFrame:
    """(doc_id, text_key, source, of, size) -> the plan: one row a source with lambda and the cut."""
    sizes = cut(sized.groupBy("source", "of", "size").agg(F.count("*").alias("n")), "sizes")
    sources = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"))
    targets = capped_targets(sources).select(_name(F.col("source")).alias("of"), "source_size", "target")
    # a group is one row for each size that the source's documents have
    rows = sizes.select("of", "size", "n").join(targets, "of")
    plan = cut(rows.groupBy("of").applyInArrow(_tilted, _TILTED), "plan")

    # where each source's cut lies: its cell of keys, then the document within the cell
    cell = F.floor((F.col("key") + 1) / 3 * CELLS).cast("int")
    pieces = cut(_pieces(sized, plan).select("of", "size", "whole", "key", cell.alias("cell")), "keys")
    cells = cut(pieces.groupBy("of", "cell").agg(F.sum("size").alias("here"), F.sum(F.col("whole") * F.col("size")).alias("base")), "cells")
    wanted = plan.join(cells.groupBy("of").agg(F.sum("base").alias("base")), "of").select("of", (F.col("target") - F.col("base")).alias("missing"))
    upto = Window.partitionBy("of").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    below = cells.withColumn("below", F.coalesce(F.sum("here").over(upto), F.lit(0)))
    edge = below.join(wanted, "of").where("below < missing and below + here >= missing")
    edge = edge.select(F.concat_ws("/", "cell", "of").alias("at"), "below", "missing")
    # documents of one key are taken or left together, so they count as one
    near = skew_join(pieces.select("of", "size", "key", F.concat_ws("/", "cell", "of").alias("at")), cut(edge, "edge"), "at")
    near = near.groupBy("of", "key", "below", "missing").agg(F.sum("size").alias("size"))
    near = near.withColumn("upto", F.col("below") + F.sum("size").over(Window.partitionBy("of").orderBy("key")))
    near = near.withColumn("off", F.abs(F.col("upto") - F.col("missing")))
    best = near.groupBy("of").agg(F.min(F.struct("off", "key")).alias("best"), F.min("key").alias("least"), F.first("below").alias("below"), F.first("missing").alias("missing"))
    # the cut may also lie just below the cell's first document
    at = F.when(F.col("missing") - F.col("below") <= F.col("best.off"), F.col("least") - F.lit(1e-12)).otherwise(F.col("best.key"))
    # without an edge: nothing is missing, or all that there is (keys of full sources are 2)
    everything = F.when(F.col("missing") > 0, F.lit(1.5)).otherwise(F.lit(-2.0))
    ends = wanted.select("of", everything.alias("otherwise"))
    plan = plan.join(best.select("of", at.alias("cut")), "of", "left").join(ends, "of")
    return cut(plan.withColumn("cut", F.coalesce("cut", "otherwise")).drop("otherwise"), "plan")


def _name(source: Column) -> Column:
    """A source's key, which the null source has too."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _key_columns() -> list[Column]:
    source = F.col("source").cast("string")
    return [F.col("doc_id"), F.xxhash64("text").alias("text_key"), source.alias("source"), _name(source).alias("of"), word_count(F.col("text")).alias("size")]


def _copies() -> Column:
    return F.col("whole") + F.when(F.col("key") <= F.col("cut"), F.lit(1)).otherwise(F.lit(0))


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, copies, rate."""
    sized = cut(docs.select(*_key_columns()), "sized")
    return _pieces(sized, solve(sized)).select(
        "doc_id", "size", "source_size", "target", (_copies() * F.col("size")).cast("long").alias("taken"), _copies().cast("int").alias("copies"), "rate"
    )


def take_mix(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, all columns as they were. The decision
    is a function of the row and its source's plan, so the texts of sources that hold more than one in a
    thousand rows aren't shuffled."""
    plan = solve(cut(docs.select(*_key_columns()), "sized"))
    columns = docs.columns
    inner = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"), *_key_columns())
    taken = _pieces(inner, plan).withColumn("copies", _copies().cast("int")).where("copies > 0")
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select(*(F.col("row").getField(c).alias(c) for c in columns))
