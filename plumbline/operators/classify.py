"""Domains: title hint, then gazetteer, then the nearest exemplar centroid, under the registry's ceilings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import config
from plumbline.functions import text as X
from plumbline.operators.verify import ceiling_of

#: Centroids are the domains' exemplars: a handful, checked.
MOST_CENTROIDS = 256
#: Vectors of a document that are compared at a time.
NEAR_BLOCK = 1024


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, centroid): the mean vector of every label, a partial average a dimension."""
    rows = vectors.where("embedding is not null").select(F.col(label).alias("label"), F.posexplode("embedding").alias("pos", "x"))
    means = rows.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return means.groupBy("label").agg(ordered.alias("centroid"))


def nearest(vectors: DataFrame, points: DataFrame) -> DataFrame:
    """Vectors with the label of the most similar centroid and the score (never below 0); on ties the smaller label, or
    the smaller ``place`` where points have one (several points may share a label)."""
    order = "place" if "place" in points.columns else "label"
    few = sorted(points.limit(MOST_CENTROIDS + 1).collect(), key=lambda r: str(r[order]).zfill(12))
    if len(few) > MOST_CENTROIDS:
        raise ValueError(f"at most {MOST_CENTROIDS} centroids")
    offers = [F.struct(X.cosine(F.col("embedding"), F.lit(list(p.centroid))).alias("score"), F.lit(-i).alias("place"), F.lit(p.label).alias("label")) for i, p in enumerate(few)]
    best = F.array_max(F.array(*offers))
    return vectors.withColumn("__best", best).withColumn("domain", F.col("__best.label")).withColumn("score", F.greatest(F.lit(0.0), F.col("__best.score"))).drop("__best")


def cascade(hint: Column, text: Column, semantic_domain: Column, semantic_score: Column, gazetteer: dict = config.GAZETTEER) -> Column:
    """struct(domain, confidence, source): the first tier that knows, its confidence under the domain's ceiling."""
    term = X.gazetteer_domain(text, gazetteer)

    def tier(domain: Column, confidence: Column, source: str) -> Column:
        return F.struct(domain.alias("domain"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"))

    found = (
        F.when(hint.isNotNull(), tier(hint, F.lit(0.95), "structural"))
        .when(term.isNotNull(), tier(term, F.lit(0.85), "terminology"))
        .otherwise(tier(semantic_domain, F.greatest(F.lit(0.0), semantic_score), "semantic"))
    )
    ceiling = F.coalesce(ceiling_of(found["domain"]), F.lit(1.0))
    return F.struct(found["domain"].alias("domain"), F.least(found["confidence"], ceiling).alias("confidence"), found["source"].alias("source"))


def classify(claims: DataFrame, points: DataFrame, gazetteer: dict = config.GAZETTEER) -> DataFrame:
    """claims: (claim_id, claim_text, section_title, embedding) -> with domain, domain_confidence, domain_source. Only
    claims that neither tier decides are compared with the centroids."""
    hinted = claims.withColumn("__hint", X.title_hint(F.col("section_title"))).withColumn("__term", X.gazetteer_domain(F.col("claim_text"), gazetteer))
    sure = hinted.where("__hint is not null or __term is not null").withColumn("domain", F.lit(None).cast("string")).withColumn("score", F.lit(0.0))
    rest = nearest(hinted.where("__hint is null and __term is null"), points)
    both = sure.unionByName(rest)
    tiers = cascade(F.col("__hint"), F.col("claim_text"), F.col("domain").cast("string"), F.col("score"), gazetteer)
    out = both.withColumn("__t", tiers).drop("domain", "score", "__hint", "__term")
    return out.select("*", F.col("__t.domain").alias("domain"), F.col("__t.confidence").alias("domain_confidence"), F.col("__t.source").alias("domain_source")).drop("__t")


def near_claims(claims: DataFrame, threshold: float = config.THRESHOLDS["claim_dedup"]) -> DataFrame:
    """(claim_id, same_as): claims of a document whose vectors are at least this similar to an earlier claim's.

    A document's vectors meet in blocks of NEAR_BLOCK by matrix products; nothing is emitted but the answer. The largest
    group is the claims of one document. Vectors of another length than a document's first, or with null components, match nothing.
    """
    rows = claims.where("embedding is not null").select("document_id", "claim_id", F.col("embedding").cast("array<double>").alias("embedding"))
    out = T.StructType([T.StructField(c, rows.schema["claim_id"].dataType) for c in ("claim_id", "same_as")])

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by("claim_id").combine_chunks()
        ids, vectors = group.column("claim_id"), group.column("embedding").to_pylist()
        size = len(vectors[0])
        plain = np.array([v if len(v) == size and None not in v else [0.0] * size for v in vectors], float).reshape(len(vectors), size)
        norms = np.sqrt((plain * plain).sum(1, keepdims=True))
        unit = np.divide(plain, norms, out=np.zeros_like(plain), where=norms > 0)
        later, first = [], []
        for i in range(0, len(unit), NEAR_BLOCK):
            block = unit[i : i + NEAR_BLOCK]
            left = np.arange(len(block))
            for j in range(0, i + len(block), NEAR_BLOCK):
                near = block[left] @ unit[j : j + NEAR_BLOCK].T >= threshold
                near &= (j + np.arange(near.shape[1]))[None, :] < (i + left)[:, None]
                hit = near.any(1)
                later += (i + left[hit]).tolist()
                first += (j + near[hit].argmax(1)).tolist()
                left = left[~hit]
        return pa.table({"claim_id": ids.take(pa.array(later, pa.int64())), "same_as": ids.take(pa.array(first, pa.int64()))})

    return rows.groupBy("document_id").applyInArrow(meet, out)
