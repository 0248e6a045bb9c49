"""Claims from chunks: simple sentences become claims by themselves, joined ones go to a decomposer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X

CLAIM = "claim_text string, source_span string, claim_type string, scope string, requires array<string>"


def chunk_sentences(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, sentence_index, sentence) of the chunks that aren't tables."""
    body = chunks.where("chunk_type <> 'table'")
    return body.select("document_id", "chunk_id", F.posexplode(X.sentences(F.col("chunk_text"))).alias("sentence_index", "sentence"))


def direct_claims(sentences: DataFrame) -> DataFrame:
    """Claims of the sentences that need no decomposition."""
    return sentences.where(~X.needs_decomposition(F.col("sentence"))).select("*", X.direct_claim(F.col("sentence")).alias("c")).select(*sentences.columns, "c.*")


def extract_claims(chunks: DataFrame, decompose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All claims. ``decompose`` maps the joined sentences to rows with the claim columns added; without it they wait.

    What an outside model answers must be written to a table before further use, so that it is asked once.
    """
    sentences = chunk_sentences(chunks)
    direct = direct_claims(sentences)
    if decompose is None:
        return direct
    return direct.unionByName(decompose(sentences.where(X.needs_decomposition(F.col("sentence")))).select(*direct.columns))
