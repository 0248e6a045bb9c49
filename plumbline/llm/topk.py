"""Exact top-k by integer inner product over a bit-sliced index.

A block of vectors is stored as slices: for every dimension the vectors' integers, quantised to
``SLICE_BITS`` bits, give one bitmap a bit. A query's approximate scores come from these bitmaps alone: a bit of
the query's integer at weight w adds the dimension's bitmaps at their own weight plus w, and a
carry-save tree adds all bitmaps of a weight at once. The top rows are then selected from the most
significant slice of the sum downward. Quantisation can hide at most a known amount, so rows whose
sum lies within it of the k-th form the boundary; their scores are computed exactly.

Queries and blocks meet by an equi-join on (shard, group): the index is dealt to shards of at most
SHARD_BLOCKS blocks, the queries to groups of GROUP_BLOCKS; a shard is sent once to each group and a
group once to each shard. Neither side is broadcast.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part.
Vectors of another length than the query's aren't its candidates. Rows that repeat a vec_id are
candidates each, never for a query of that same id; repeated query ids ask once, with the smallest
vector. Null ids take no part. Other columns aren't read. Components of any size are exact: vectors with one so
large that a score might leave 64 bits stand in blocks of their own and are scored in integers of unlimited length. Ranks follow the exact
score; where it leaves 64 bits, the score column holds the nearer end of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import cut

SCALE = 1024
EVERY = 100
K = 10
SLICE_BITS = 8
#: Vectors of a block, queries of a block; blocks of a shard of the index, blocks of a group of queries.
BLOCK_ROWS, QUERY_ROWS, SHARD_BLOCKS, GROUP_BLOCKS = 8192, 128, 16, 128
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _add_bitmaps(stacks: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Bit slices, least significant first, of the sum of weighted bitmaps (carry-save, then ripple)."""
    out = []
    weight, top = 0, max(stacks, default=-1)
    while weight <= top:
        here = stacks.get(weight, [])
        layer = np.concatenate([x.reshape(-1, words) for x in here]) if here else np.zeros((0, words), np.uint64)
        while len(layer) >= 3:
            third = len(layer) // 3
            a, b, c = layer[:third], layer[third : 2 * third], layer[2 * third : 3 * third]
            half = a ^ b
            carry = (a & b) | (c & half)
            layer = np.concatenate([half ^ c, layer[3 * third :]])
            stacks.setdefault(weight + 1, []).append(carry)
            top = max(top, weight + 1)
        if len(layer) == 2:
            stacks.setdefault(weight + 1, []).append(layer[0] & layer[1])
            top = max(top, weight + 1)
            out.append(layer[0] ^ layer[1])
        else:
            out.append(layer[0] if len(layer) else np.zeros(words, np.uint64))
        weight += 1
    return out


def _ones(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _kth_largest(slices: list[np.ndarray], everyone: np.ndarray, k: int) -> int:
    """The k-th largest sum among ``everyone``, read from the most significant slice downward."""
    value, above, tied = 0, 0, everyone
    for i in range(len(slices) - 1, -1, -1):
        with_bit = tied & slices[i]
        n = _ones(with_bit)
        if above + n >= k:
            value |= 1 << i
            tied = with_bit
        else:
            above += n
            tied = tied & ~slices[i]
    return value


def _at_least(slices: list[np.ndarray], everyone: np.ndarray, bound: int) -> np.ndarray:
    """Bitmap of the rows whose sum is ``bound`` or more."""
    if bound <= 0:
        return everyone
    if bound >> len(slices):
        return np.zeros_like(everyone)
    sure, tied = np.zeros_like(everyone), everyone
    for i in range(len(slices) - 1, -1, -1):
        if bound >> i & 1:
            tied = tied & slices[i]
        else:
            sure |= tied & slices[i]
            tied = tied & ~slices[i]
    return sure | tied


class SlicedBlock:
    """The bit-sliced index of a block of integer vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.n = len(vectors)
        self.words = -(-self.n // 64)
        self.low = vectors.min(axis=0)
        span = int((vectors.max(axis=0) - self.low).max())
        self.shift = max(0, span.bit_length() - SLICE_BITS)
        cells = (vectors - self.low) >> self.shift
        self.bits = min(SLICE_BITS, max(1, span.bit_length()))
        padded = np.zeros((self.words * 64, vectors.shape[1]), np.int64)
        padded[: self.n] = cells
        self.slices = np.stack([self._pack((padded >> b & 1).T.astype(bool)) for b in range(self.bits)], 1)
        self.everyone = self._pack((np.arange(self.words * 64) < self.n)[None])[0]

    @staticmethod
    def _pack(rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.packbits(rows, axis=1, bitorder="little")).view(np.uint64)

    def top(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores that hold the k best rows outside ``skip``; more where scores tie."""
        everyone = self.everyone if not skip.any() else self.everyone & ~self._pack(np.pad(skip, (0, self.words * 64 - self.n))[None])[0]
        rows = np.flatnonzero(self._unpack(everyone))
        if len(rows) > k:
            stacks: dict[int, list[np.ndarray]] = {}
            size = np.abs(query)
            for w in range(int(size.max(initial=0)).bit_length()):
                for sign in (1, -1):
                    dims = np.flatnonzero((size >> w & 1).astype(bool) & (np.sign(query) == sign))
                    if len(dims):
                        chosen = self.slices[dims] if sign > 0 else ~self.slices[dims]
                        for b in range(self.bits):
                            stacks.setdefault(w + b, []).append(chosen[:, b])
            sums = _add_bitmaps(stacks, self.words)
            # what quantisation hides of one row against another
            hidden = int(size.sum()) * ((1 << self.shift) - 1)
            slack = -(-hidden // (1 << self.shift))
            bound = _kth_largest(sums, everyone, k) - slack
            rows = np.flatnonzero(self._unpack(_at_least(sums, everyone, bound)))
        scores = self.vectors[rows] @ query
        if len(rows) > k:
            at = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= at], scores[scores >= at]
        return rows, scores

    def _unpack(self, bitmap: np.ndarray) -> np.ndarray:
        return np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n].astype(bool)


def wide_integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, as Python integers."""
    # doubles from 2^53 on are integers, and SCALE times a smaller one is exact
    whole = [int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE)) for x in vectors.ravel().tolist()]
    return np.array(whole, object).reshape(vectors.shape)


def _narrow(scaled: np.ndarray, dim: int) -> np.ndarray:
    """Rows whose integers are small enough for 64-bit scores against each other."""
    return (np.abs(scaled) < 2.0**31 / dim**0.5).all(axis=1)


class _Block:
    """Vectors of the index as stored: sliced where they are narrow."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        self.wide = None if row["narrow"] else wide_integers(vectors)
        self.sliced = SlicedBlock(np.floor(vectors * SCALE).astype(np.int64)) if row["narrow"] else None

    def best(self, query_id: int, query: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Ids and exact scores of the K best, ties to smaller ids."""
        skip = self.ids == query_id
        if self.sliced is not None and query.dtype != object:
            rows, scores = self.sliced.top(query, K, skip)
            order = np.lexsort((self.ids[rows], -scores))[:K]
            return self.ids[rows][order], scores[order].tolist()
        if self.wide is None:
            self.wide = self.sliced.vectors.astype(object)
        rows = np.flatnonzero(~skip)
        scores = self.wide[rows] @ query.astype(object)
        chosen = heapq.nsmallest(K, zip([-x for x in scores], self.ids[rows].tolist(), strict=True))
        return np.array([i for _, i in chosen], np.int64), [-x for x, _ in chosen]


def _beyond(score: int) -> bytes | None:
    """For scores at the ends of 64 bits or beyond: bytes in the order of the integers."""
    if _LEAST < score < _MOST:
        return None
    size = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    key = len(size).to_bytes(4, "big") + size
    return b"\x01" + key if score > 0 else b"\x00" + bytes(255 - x for x in key)


_PACKED = T.StructType(
    [
        T.StructField("dim", T.IntegerType()),
        T.StructField("narrow", T.BooleanType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("vectors", T.BinaryType()),
    ]
)
_MET = T.StructType([T.StructField(c, T.IntegerType()) for c in ("shard", "group", "dim", "side")] + _PACKED.fields[1:])
_BEST = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")] + [T.StructField("beyond", T.BinaryType())]
)


def _packer(rows_a_block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list] = {}

        def block(kind: tuple[int, bool]) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(kind), strict=True))
            columns = [pa.array([kind[0]], pa.int32()), pa.array([kind[1]]), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=_PACKED.names)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                vectors = values[ends[at][:, None] - dim + np.arange(dim)]
                with np.errstate(over="ignore"):
                    narrow = _narrow(np.floor(vectors * SCALE), int(dim))
                for small in (True, False):
                    of = np.flatnonzero(narrow == small)
                    kind = (int(dim), small)
                    for i in range(0, len(of), rows_a_block):
                        part = of[i : i + rows_a_block]
                        held.setdefault(kind, []).append((ids[at[part]], vectors[part]))
                        if sum(len(x) for x, _ in held[kind]) >= rows_a_block:
                            yield block(kind)
        for kind in list(held):
            yield block(kind)

    return pack


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (shard, group, dim, side): the blocks of a shard come first, then a group of queries."""
    place, blocks = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["shard"], row["group"], row["dim"]) != place:
                place, blocks = (row["shard"], row["group"], row["dim"]), []
            if row["side"] == 0:
                blocks.append(_Block(row))
                continue
            asked = np.frombuffer(row["ids"], np.int64)
            queries = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            queries = np.floor(queries * SCALE).astype(np.int64) if row["narrow"] else wide_integers(queries)
            out = []
            for query_id, query in zip(asked.tolist(), queries, strict=True):
                for block in blocks:
                    ids, scores = block.best(query_id, query)
                    out += [(query_id, i, max(_LEAST, min(_MOST, x)), _beyond(x)) for i, x in zip(ids.tolist(), scores, strict=True)]
            if out:
                kinds = [pa.int64()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_BEST.names)


@contextmanager
def _batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for what runs inside; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _dealt(blocks: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``blocks`` with a number below the second result, so that about ``most`` at most share one; while there
    are few, one for every block, for as many tasks."""
    n = blocks.select("dim").count()
    numbers = max(1, -(-n // most), min(n, 4 * blocks.sparkSession.sparkContext.defaultParallelism))
    return blocks.withColumn("number", F.pmod(F.xxhash64("ids"), F.lit(numbers)).cast("int")), numbers


def top_k(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score for every vec_id divisible by EVERY against all rows (vec_id, embedding)."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    asked = rows.where(F.col("vec_id") % EVERY == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    with _batch_rows(spark, 4096):
        index = cut(rows.mapInArrow(_packer(BLOCK_ROWS), _PACKED), "index")
        queries = cut(asked.mapInArrow(_packer(QUERY_ROWS), _PACKED), "queries")
    index, shards = _dealt(index, SHARD_BLOCKS)
    n_queries = queries.select("dim").count()
    groups = max(1, -(-n_queries // GROUP_BLOCKS))
    queries = queries.withColumn("number", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    held = index.select(F.col("number").alias("shard"), numbers(groups).alias("group"), "dim", F.lit(0).alias("side"), *_PACKED.names[1:])
    sent = queries.select(numbers(shards).alias("shard"), F.col("number").alias("group"), "dim", F.lit(1).alias("side"), *_PACKED.names[1:])
    met = held.unionByName(sent).repartition("shard", "group", "dim").sortWithinPartitions("shard", "group", "dim", "side")
    with _batch_rows(spark, 4):
        best = cut(met.select(*_MET.names).mapInArrow(_search, _BEST), "best")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc_nulls_last(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
