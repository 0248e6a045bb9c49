"""Evidence: scoped lookup by phrase overlap, the fallback section, external rows, and vector search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.staging import stored

#: Evidence columns.
EVIDENCE = ("claim_id", "source_type", "source_ref", "content_snippet", "authority_score")


def requirement_hits(claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """(claim_id, candidate_id) where at least half of one required phrase's words stand in the candidate,
    within the document (and the claim's section, where it has one).

    An inverted index: both sides are exploded to distinct tokens and equi-joined on document and token, so a
    document's claims and candidates are never paired blindly. Only tokens that a claim asks for are kept of the candidates.
    """
    met = wide_hits(claims, candidates)
    return met.where(F.col("scope").isNull() | (F.col("scope") == F.col("section_id"))).select("claim_id", "candidate_id")


def wide_hits(claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """(claim_id, scope, candidate_id, section_id): the same within the document, whatever the section; scope is the claim's."""
    phrases = claims.select("claim_id", "document_id", "section_id", F.posexplode("requires").alias("phrase", "wanted"))
    phrases = phrases.withColumn("words", X.content_words(F.col("wanted"))).withColumn("size", F.size("words"))
    tokens = phrases.select("claim_id", "document_id", F.col("section_id").alias("scope"), "phrase", "size", F.explode("words").alias("token"))
    asked = tokens.select("document_id", "token").distinct()
    index = candidates.select("candidate_id", "document_id", "section_id", F.explode(X.content_words(F.col("content"))).alias("token"))
    index = index.join(asked, ["document_id", "token"], "left_semi")
    # a claim has one scope and a candidate one section, so both ride along in the key
    scored = tokens.join(index, ["document_id", "token"]).groupBy("claim_id", "scope", "phrase", "candidate_id", "section_id", "size").agg(F.count("*").alias("hits"))
    return scored.where("2 * hits >= size").select("claim_id", "scope", "candidate_id", "section_id").distinct()


def internal_lookup(claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """Evidence rows of the claim's own document.

    claims: (claim_id, document_id, section_id, requires); candidates: (candidate_id, document_id, section_id,
    source_type, content, page_number, section_title, ordinal), tables and non-table chunks together.
    """
    return evidence_of(requirement_hits(claims, candidates), candidates)


def evidence_of(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """Evidence rows of hits (claim_id, candidate_id)."""
    hits = found.select("claim_id", "candidate_id").join(candidates, "candidate_id")
    prefix = F.when(F.col("source_type") == "internal_table", "extracted_table:").otherwise("document_chunk:")
    ref = X.citation(F.concat(prefix, F.col("candidate_id").cast("string")), F.col("page_number"), F.col("section_title"))
    score = F.when(F.col("source_type") == "internal_table", 1.0).otherwise(0.9)
    return hits.select("claim_id", "candidate_id", "source_type", ref.alias("source_ref"), F.col("content").alias("content_snippet"), score.alias("authority_score"))


def pick_section(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """(claim_id, section_id): the section whose title and summary share most with what the claim requires, at
    least half of its words; none where nothing does. The deterministic stand-in for a navigator."""
    wanted = claims.select("claim_id", "document_id", F.explode(X.content_words(F.array_join("requires", " "))).alias("token"))
    sizes = wanted.groupBy("claim_id").agg(F.count("*").alias("size"))
    named = sections.select("section_id", "document_id", F.explode(X.content_words(F.concat_ws(" ", "title", "summary"))).alias("token"))
    hits = wanted.join(named, ["document_id", "token"]).groupBy("claim_id", "section_id").agg(F.count("*").alias("hits"))
    best = hits.join(sizes, "claim_id").where("2 * hits >= size").groupBy("claim_id")
    return best.agg(F.min_by("section_id", F.struct(-F.col("hits"), F.col("section_id"))).alias("section_id"))


def fallback_lookup(claims: DataFrame, found: DataFrame, candidates: DataFrame, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For claims that the direct lookup found nothing for: the first matching table, else the first matching
    chunk, of the section that ``choose`` gives them."""
    return _fallback(claims, found, wide_hits(claims, candidates), candidates, choose)


def _fallback(claims: DataFrame, found: DataFrame, wide: DataFrame, candidates: DataFrame, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    missed = claims.join(found.select("claim_id").distinct(), "claim_id", "left_anti")
    hits = wide.drop("scope").join(choose(missed), ["claim_id", "section_id"])
    hits = evidence_of(hits, candidates).join(candidates.select("candidate_id", "ordinal"), "candidate_id")
    first = Window.partitionBy("claim_id").orderBy((F.col("source_type") != "internal_table").cast("int"), "ordinal", "candidate_id")
    return hits.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "ordinal")


def fixed_source(claims: DataFrame) -> DataFrame:
    """An external source that gives every claim the same row; stands in for a connector."""
    return claims.select(
        "claim_id",
        F.lit("external").alias("source_type"),
        F.lit("mock://competitor-filing").alias("source_ref"),
        F.lit("Competitor reported 8% revenue growth").alias("content_snippet"),
        F.lit(0.6).alias("authority_score"),
    )


def dispatch(claims: DataFrame, candidates: DataFrame, choose, connector=fixed_source) -> DataFrame:
    """Evidence by scope: internal (with fallback) for internal and both, the connector's for external and both."""
    inside = claims.where("scope in ('internal', 'both')")
    # all texts are tokenised once, for the direct lookup and for the fallback
    wide = stored(wide_hits(inside, candidates), "hits")
    own = wide.where(F.col("scope").isNull() | (F.col("scope") == F.col("section_id")))
    direct = evidence_of(own, candidates)
    further = _fallback(inside, own, wide, candidates, choose)
    outside = connector(claims.where("scope in ('external', 'both')"))
    return direct.select(*EVIDENCE).unionByName(further.select(*EVIDENCE)).unionByName(outside)


def outside_range(ordinal: Column, lo: int, hi: int) -> Column:
    """Keep what has no ordinal or lies outside [lo, hi]."""
    return ordinal.isNull() | (ordinal < lo) | (ordinal > hi)


def similar(chunks: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The k chunks most similar to one query vector: a top-k that every task cuts to k first."""
    scored = chunks.where("embedding is not null").withColumn("similarity", X.cosine(F.col("embedding"), F.lit([float(x) for x in query])))
    return scored.orderBy(F.col("similarity").desc(), "chunk_id").limit(k)


def similar_many(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, chunk_id, similarity) for a small set of query vectors.

    The queries (at most MANY, checked) go to every task, which scores an Arrow batch of chunks by one matrix product
    and keeps the k best of the batch for each query. Vectors of another length, with null components or of
    length 0 score 0, as :func:`text.cosine` has it.
    """
    few = queries.limit(MANY + 1).collect()
    if len(few) > MANY:
        raise ValueError(f"similar_many takes at most {MANY} queries")
    names = {f.name: f.dataType for f in (*chunks.schema, *queries.schema)}
    out = T.StructType([T.StructField("query_id", names["query_id"]), T.StructField("chunk_id", names["chunk_id"]), T.StructField("similarity", T.DoubleType())])
    if not few:
        return chunks.sparkSession.createDataFrame([], out).withColumn("rank", F.lit(0).cast("long")).select("query_id", "chunk_id", "similarity", "rank")
    asked = [(q.query_id, np.array(q.vector, float)) for q in few]
    kind = to_arrow_type(names["query_id"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
            ends = np.cumsum(lengths)
            rows = []
            for query_id, query in asked:
                score = np.zeros(len(ids))
                fits = np.flatnonzero(lengths == len(query))
                if len(fits) and len(query):
                    at = values[ends[fits][:, None] - len(query) + np.arange(len(query))]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        found = (at @ query) / (np.sqrt((at * at).sum(1)) * np.sqrt(query @ query))
                    score[fits] = np.nan_to_num(found, nan=0.0)
                # all that tie with the k-th stay, so that ids decide
                least = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
                rows += [(query_id, i, score[i]) for i in np.flatnonzero(score >= least).tolist()]
            columns = [[r[0] for r in rows], ids.take(pa.array([r[1] for r in rows], pa.int64())), [r[2] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), columns[1], pa.array(columns[2], pa.float64())], names=out.names)

    wanted = chunks.where("embedding is not null").select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    scored = wanted.mapInArrow(best, out)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


MANY = 256
