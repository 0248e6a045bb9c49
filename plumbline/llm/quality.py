"""Quality rules: fixed base rules and a hashed n-gram logistic regression.

Word 1- and 2-grams and character 3- to 5-grams (bytes) of the whole text are hashed into 2^16
weights; a text's two feature groups are each scaled to sum 1, so a score is a mean weight and
needs no per-text dictionary. The regression is fitted on at most ``PER_CLASS`` labelled rows of
each class (those of the smallest id hash), Platt-calibrated on the held-out quarter of them at the
corpus's own class ratio, and applied in Arrow batches against the fixed threshold.

Defined cases: null or wordless text: all counts 0 and ``base_failed`` (fewer than 10 words).
No labels, or labels of one class only: the model accepts everything. Repeated rows are judged
alike, each on its own; null doc_ids too. Columns other than doc_id and text aren't read by :func:`quality` and pass
through :func:`keep_quality`. Repeats of words are told by 64-bit hashes of five-word windows that aren't compared
again: two windows of one text with n words collide with probability below n^2 / 2^65. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import Texts, keyed, mix64, slices, small_batches, unit_hash

BITS = 16
#: Labelled rows of each class that the regression is fitted on, at most.
PER_CLASS = 1000
#: Every so-many-th sampled row calibrates instead of training.
HELD_OUT = 4
#: Kept when the calibrated probability of good quality is at least this.
KEEP_FROM = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_ROLL = keyed(8, seed=11) | np.uint64(1)
_SHIFT = np.uint64(64 - BITS)


def repeated_words(texts: Texts, words: np.ndarray, width: int = 5) -> np.ndarray:
    """Words of every text that lie in a ``width``-word window found twice or more in that text."""
    n = len(words)
    out = np.zeros(len(texts), np.int64)
    if n < width:
        return out
    with np.errstate(over="ignore"):
        windows = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            windows += words[j : n - width + 1 + j] * _ROLL[j]
        doc = texts.doc_of_word
        whole = doc[: n - width + 1] == doc[width - 1 :]
        at = np.flatnonzero(whole)
        keys = mix64(windows[at] + mix64(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.bincount(at[twice], minlength=n + 1) - np.bincount(at[twice] + width, minlength=n + 1)
    marked = np.cumsum(cover)[:n] > 0
    return out + np.bincount(doc[marked], minlength=len(texts))


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line of the text."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def base_counts(column: pa.Array, texts: Texts, words: np.ndarray) -> dict[str, np.ndarray]:
    code_points = (texts.data & 0xC0) != 0x80
    return {
        "n_words": np.diff(texts.first).astype(np.int64),
        "word_chars": texts.per_text(code_points & texts.inside),
        "n_symbols": texts.per_text(_SYMBOL[texts.data]),
        "n_dup_lines": np.array([repeated_lines(x) for x in column.to_pylist()], np.int64),
        "n_repeat_words": repeated_words(texts, words),
    }


def _slots(texts: Texts, words: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(group, text index, slot) for every n-gram of a slice of texts."""
    with np.errstate(over="ignore"):
        yield "word", texts.doc_of_word, (words * _ROLL[0] >> _SHIFT).astype(np.int64)
        if len(words) > 1:
            both = texts.doc_of_word[1:] == texts.doc_of_word[:-1]
            pair = mix64(words[:-1] * _ROLL[1] + words[1:] * _ROLL[2])[both]
            yield "word", texts.doc_of_word[1:][both], (pair >> _SHIFT).astype(np.int64)
        data = texts.data.astype(np.uint32)
        doc = np.repeat(np.arange(len(texts)), np.diff(texts.at))
        rolled = data * np.uint32(0x9E3779B1)
        for n in range(1, 5):
            if len(data) <= n:
                return
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + data[n:]
            if n >= 2:
                inside = doc[n:] == doc[: len(doc) - n]
                slot = ((rolled * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int64)
                yield "char", doc[n:][inside], slot[inside]


def mean_weights(texts: Texts, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean word-gram weight plus the mean character-gram weight of every text."""
    sums = {g: np.zeros(len(texts)) for g in ("word", "char")}
    counts = {g: np.zeros(len(texts)) for g in ("word", "char")}
    for group, doc, slot in _slots(texts, words):
        sums[group] += np.bincount(doc, weights[group].take(slot), len(texts))
        counts[group] += np.bincount(doc, minlength=len(texts))
    return sum(sums[g] / np.maximum(counts[g], 1) for g in sums)


_VECTOR = T.StructType(
    [
        T.StructField("place", T.LongType()),
        T.StructField("label", T.LongType()),
        T.StructField("slots", T.BinaryType()),
        T.StructField("shares", T.BinaryType()),
    ]
)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 1 << BITS
    for batch in batches:
        column = batch.column(2)
        for i in range(batch.num_rows):
            one = column.slice(i, 1)
            texts = Texts(one)
            words = texts.word_hashes()
            dense = np.zeros(2 * size)
            for group, _, slot in _slots(texts, words):
                dense[size * (group == "char") :][:size] += np.bincount(slot, minlength=size)
            for half in (dense[:size], dense[size:]):
                half /= max(1.0, half.sum())
            slots = np.flatnonzero(dense)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, 1),
                    batch.column(1).slice(i, 1),
                    pa.array([slots.astype("<i4").tobytes()], pa.binary()),
                    pa.array([dense[slots].astype("<f4").tobytes()], pa.binary()),
                ],
                names=_VECTOR.names,
            )


class Model:
    """Weights of the two feature groups and the calibration of their score."""

    def __init__(self, word: np.ndarray, char: np.ndarray, slope: float, shift: float):
        self.weights = {"word": word, "char": char}
        self.slope, self.shift = slope, shift

    def probability(self, texts: Texts, words: np.ndarray) -> np.ndarray:
        score = self.slope * mean_weights(texts, words, self.weights) + self.shift
        return 1 / (1 + np.exp(-np.clip(score, -50, 50)))


def _fit(rows: list, ratio: float) -> Model | None:
    """Logistic regression by full-batch accelerated gradient steps; Platt scaling on the rest.

    ratio: good labels for every bad one in the whole table. rows: emptied, so that their bytes don't stay beside the arrays.
    """
    size = 1 << BITS
    rows.sort()  # (place, label, slots, shares)
    labels = np.array([float(r[1]) for r in rows])
    if len(set(labels)) < 2:
        return None
    held = np.array([r[0] % HELD_OUT == 0 for r in rows])
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held = np.zeros(len(rows), bool)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) // 4 for r in rows])
    slot = np.frombuffer(b"".join(r[2] for r in rows), "<i4")
    share = np.frombuffer(b"".join(r[3] for r in rows), "<f4")
    rows.clear()
    train = np.where(held, 0.0, 1.0)
    weight = train * np.where(labels > 0, 0.5 / max(1, (train * labels).sum()), 0.5 / max(1, (train * (1 - labels)).sum()))
    # square roots of shares' column norms even out rare and common slots
    norm = np.sqrt(np.bincount(slot, share**2 * weight[row], 2 * size) + 1e-9)
    value = share / norm[slot]
    w, look, bias, momentum, penalty = np.zeros(2 * size), np.zeros(2 * size), 0.0, 0.9, 1e-3
    step = 4.0 / max(1e-9, (weight * np.bincount(row, value**2, len(labels))).sum())
    for _ in range(120):
        margin = np.bincount(row, value * look[slot], len(labels)) + bias
        off = weight * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels)
        new = look - step * (np.bincount(slot, value * off[row], 2 * size) + penalty * look)
        look = new + momentum * (new - w)
        w = new
        bias -= off.sum()
    w = w / norm
    score = np.bincount(row, share * w[slot], len(labels))
    part = held if held.any() else ~held
    x, y = score[part], labels[part]
    # Platt's targets, rows weighted to the table's class ratio, two-parameter Newton steps
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    each = np.where(y > 0, ratio / max(1, y.sum()), 1 / max(1, (1 - y).sum()))
    each = each / each.sum()
    scale = max(1e-9, x.std())
    z = np.stack([x / scale, np.ones_like(x)], 1)
    theta = np.array([1.0, -x.mean() / scale])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -50, 50)))
        gradient = z.T @ (each * (p - target)) + 1e-4 * theta
        hessian = (z * (each * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        theta = theta - move * min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
    return Model(w[:size], w[size:], float(theta[0] / scale), float(theta[1]))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample of ``labels`` (doc_id, quality) and their texts in ``docs``."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("label"))
    marks = marks.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    totals = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    if len(totals) < 2:
        return None
    # below the bound lie about four times the sample, so that no task orders a whole class
    at = unit_hash(F.col("doc_id"))
    near = F.lit(False)
    for label, n in totals.items():
        near = near | ((F.col("label") == label) & (at * n <= 4 * PER_CLASS))
    first = Window.partitionBy("label").orderBy(at, "doc_id")
    chosen = marks.where(near).withColumn("place", F.row_number().over(first).cast("long")).where(F.col("place") <= PER_CLASS)
    # at most 2 * PER_CLASS rows
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    vectors = picked.where("text is not null").select("place", "label", "text").mapInArrow(_vectors, _VECTOR)
    ratio = totals[1] / totals[0]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            for place, label, slots, shares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen.setdefault((place, label), (place, label, slots, shares))  # repeated rows of a document count once
        rows = list(seen.values())
        seen.clear()
        model = _fit(rows, ratio)
        if model is not None:
            both = np.concatenate([model.weights["word"], model.weights["char"]]).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([both], pa.binary()), pa.array([model.slope]), pa.array([model.shift])], names=["weights", "slope", "shift"])

    # the sample is bounded, so one task fits it; the driver gets the weights alone
    found = vectors.repartition(1).mapInArrow(fit, "weights binary, slope double, shift double").collect()
    if not found:
        return None
    both = np.frombuffer(found[0].weights, "<f4").astype(float)
    return Model(both[: 1 << BITS], both[1 << BITS :], found[0].slope, found[0].shift)


_JUDGED = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("quality", T.DoubleType())]
)


def _judge(column: pa.Array, model: Model | None) -> Iterator[tuple[int, int, dict]]:
    for a, b in slices(column):
        part = column.slice(a, b - a)
        texts = Texts(part)
        words = texts.word_hashes()
        found = base_counts(part, texts, words)
        failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
        quality = np.ones(b - a) if model is None else model.probability(texts, words)
        yield a, b, found | {"base_failed": failed, "kept": ~failed & (quality >= KEEP_FROM), "quality": quality}


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, kept and the probability."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels))  # 2^17 weights at any corpus size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in _judge(batch.column(1), shared.value):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(found[c]) for c in _JUDGED.names[1:])], names=_JUDGED.names
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, _JUDGED)


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules and the model keep, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            kept = [found["kept"] for _, _, found in _judge(column, shared.value)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(keep, docs.schema)
