"""Seams for what needs an outside model: language models, sentence vectors, token counts.

A provider is a plain callable on lists; it runs once a batch in ``mapInPandas``. Its answers must be
written to a table before further use. The built-in ones are deterministic.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import config
from plumbline.functions import text as X
from plumbline.schemas import REVIEW

T = config.THRESHOLDS


class MissingCredentials(RuntimeError):
    """A provider has no access; its claims stay pending."""


def with_retry(call: Callable[[list], list], tries: int = 5, wait: float = 1.0, sleep=time.sleep) -> Callable[[list], list]:
    """The call, tried again with doubled waits; missing credentials aren't tried again."""

    def run(batch: list) -> list:
        for attempt in range(tries):
            try:
                return call(batch)
            except MissingCredentials:
                raise
            except Exception:
                if attempt == tries - 1:
                    raise
                sleep(wait * 2**attempt)
        return []

    return run


def packed(sizes: list[int], most: int | None, items: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of batches in order: one closes before the item that would exceed ``most`` or ``items``; none is split."""
    start, used = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= items or (most is not None and used + size > most)):
            yield start, i
            start, used = i, 0
        used += size
    if start < len(sizes):
        yield start, len(sizes)


def words_as_tokens(text: str | None) -> int:
    """What :func:`token_estimate` says, for a text in Python."""
    return -(-len((text or "").split()) * 4 // 3)


def apply_provider(
    rows: DataFrame, column: str, out: str, kind: str, call: Callable[[list], list], inputs: int = 100, tokens: int | None = None, count: Callable = words_as_tokens, blocked: str | None = None
) -> DataFrame:
    """``rows`` with ``out``, the provider's answer for ``column``, asked in batches of at most ``inputs`` rows and ``tokens`` tokens.

    ``blocked`` names a column that is true where the provider had no access: such rows have no answer, and a task asks
    no more after its first refusal. Without it missing credentials fail the job.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refused = False
        for frame in frames:
            asked = frame[column].tolist()
            answers: list = []
            for a, b in packed([count(x) if tokens else 0 for x in asked], tokens, inputs):
                try:
                    answers += [None] * (b - a) if refused else call(asked[a:b])
                except MissingCredentials:
                    if blocked is None:
                        raise
                    refused = True
                    answers += [None] * (b - a)
            made = frame.assign(**{out: pd.Series(answers, index=frame.index, dtype=object)})
            yield made if blocked is None else made.assign(**{blocked: [x is None and refused for x in answers]})

    answered = rows.withColumn(out, F.lit(None).cast(kind))
    answered = answered if blocked is None else answered.withColumn(blocked, F.lit(None).cast("boolean"))
    return rows.mapInPandas(run, answered.schema)


def once_a_worker(load: Callable[[], Callable[[list], list]]) -> Callable[[list], list]:
    """A provider whose pipeline ``load`` builds on first use, once in each worker process that runs it."""

    def call(batch: list) -> list:
        key = getattr(load, "__qualname__", repr(load))
        if key not in _pipelines:
            _pipelines[key] = load()
        return _pipelines[key](batch)

    return call


_pipelines: dict = {}


def hashed_vector(texts: list[str], size: int = 64) -> list[list[float]]:
    """Deterministic sentence vectors: counts of hashed words, scaled to length 1."""
    import hashlib
    import math

    out = []
    for text in texts:
        v = [0.0] * size
        for word in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / norm for x in v])
    return out


def first_words(texts: list[str], words: int = 150) -> list[str]:
    """Deterministic summaries: the first words."""
    return [" ".join((t or "").split()[:words]) for t in texts]


def embed(chunks: DataFrame, column: str = "chunk_text", call: Callable[[list], list] = hashed_vector) -> DataFrame:
    """Vectors of a column's texts: each text held to the provider's limit, batches to its two limits."""
    held = chunks.withColumn("__held", guard_tokens(F.col(column)))
    return apply_provider(held, "__held", "embedding", "array<double>", call, T["embed_inputs"], T["embed_tokens"]).drop("__held")


def summarize(texts: DataFrame, call: Callable[[list], list] = first_words) -> DataFrame:
    """Texts with ``summary``, null where the provider had no access."""
    return apply_provider(texts, "text", "summary", "string", call, blocked="blocked").drop("blocked")


def token_estimate(text: Column) -> Column:
    """Tokens of a text where no vocabulary is at hand: four for every three words, at least one a word."""
    return F.ceil(X.word_count(text) * 4 / 3).cast("long")


def guard_tokens(text: Column, most: int = T["embed_text_tokens"]) -> Column:
    """The text, or as many of its first words as the limit surely holds where the estimate exceeds it."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(token_estimate(text) > most, F.array_join(F.slice(words, 1, most * 3 // 4), " ")).otherwise(text)


def mean_pool(vectors: Column) -> Column:
    """The mean of an array of vectors, position by position, as long as the first; null for none."""
    size = F.size(F.get(vectors, F.lit(0)))
    # sums begin at -0.0, which added to any figure leaves it as it is: 0.0 would turn a mean of -0.0 into 0.0
    total = F.aggregate(vectors, F.array_repeat(F.lit(-0.0), size), lambda sums, v: F.zip_with(sums, v, lambda a, b: a + b.cast("double")))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors)))


def review(claims: DataFrame, call: Callable[[list], list]) -> DataFrame:
    """Claims with a reviewer's answer for their ``prompt``: (verdict, confidence, reasoning), and ``blocked`` where it had no access."""
    return apply_provider(claims, "prompt", "review", REVIEW, call, blocked="blocked")
