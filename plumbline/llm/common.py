"""What the corpus operators share: table access, shared-folder staging and Arrow text buffers.

Nothing here collects rows to the driver.  ``cut`` writes a table in the shared folder and reads it back:
lineage ends there and a lost executor costs no recomputation of what stands before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.staging import fresh_path, shared_dir  # noqa: F401
from plumbline.staging import stored as cut  # noqa: F401

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow batches are cut to so many rows, so that very long texts don't pile up in one batch.
BATCH_ROWS = 512
#: Texts inside an Arrow batch are handled in slices of about so many bytes.
SLICE_BYTES = 1 << 21

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch for this session's Python stages. The bounds stay: a frame that is
    returned runs under the settings of the time when it is read."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * SLICE_BYTES))


#: A key is hot if it holds more than one in HOT_KEYS of the rows, so there are fewer hot keys than that.
HOT_KEYS = 1000


def skew_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``facts`` (at most one row a key, other columns of other names) on ``key``, inner or left.

    Rows of hot keys stay where they are and meet their fact by broadcast (under HOT_KEYS rows), as do rows
    with a null key, which meet none; the others are shuffled. ``rows`` should be a written table, as it is
    read several times. sizes: (key, count) of the rows, where it is known already.
    """
    least = rows.count() // HOT_KEYS
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count() if sizes is None else sizes
    hot = [r[0] for r in counts.where(F.col("count") > least).select(key).collect()]  # fewer than HOT_KEYS
    hot = [bytes(x) if isinstance(x, bytearray) else x for x in hot]
    known = F.col(key).isNotNull()
    often = F.col(key).isin(hot)
    cold = rows.where(known & ~often).join(facts, key, how)
    warm = rows.where((known & often) if how == "inner" else (~known | often))
    if not hot and how == "inner":
        return cold
    return warm.join(F.broadcast(facts.where(often)), key, how).unionByName(cold)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A double in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


# --- Arrow text buffers -----------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(n: int, seed: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _GOLDEN)


_weights = keyed(1 << 12) | np.uint64(1)


def _position_weights(n: int) -> np.ndarray:
    global _weights
    if n > len(_weights):
        _weights = keyed(1 << int(n - 1).bit_length()) | np.uint64(1)
    return _weights


class Texts:
    """A slice of texts as one byte buffer, with the words of every text found at once."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column, "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
        at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        self.at = at - at[0]
        inside = ~_SPACE[self.data]
        n = len(self.data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.at[(self.at > 0) & (self.at < n)]
        before[edges] = False
        after[edges - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.doc_of_word = np.searchsorted(self.at, self.starts, side="right") - 1
        #: word index range of every text: first[i] .. first[i + 1]
        self.first = np.searchsorted(self.doc_of_word, np.arange(len(self.at)), side="left")

    def __len__(self) -> int:
        return len(self.at) - 1

    def word_hashes(self) -> np.ndarray:
        """64-bit hash of every word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        weights = _position_weights(int(lengths.max()))
        place = np.arange(len(self.data), dtype=np.int64)
        span = np.diff(self.starts, append=len(self.data))
        place[self.starts[0] :] -= np.repeat(self.starts, span)
        place[~self.inside] = 0
        with np.errstate(over="ignore"):
            parts = (self.data.astype(np.uint64) + np.uint64(1)) * weights[place]
            parts[~self.inside] = 0
            sums = np.add.reduceat(parts, self.starts)
            return mix64(sums + lengths.astype(np.uint64) * _GOLDEN)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over every text of a value per byte."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(start, stop) row ranges of about ``limit`` bytes of text; a longer text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    start, room = 0, 0
    for i, size in enumerate(sizes):
        if i > start and room + size > limit:
            yield start, i
            start, room = i, 0
        room += int(size)
    if start < len(sizes):
        yield start, len(sizes)


_RUN = keyed(5, seed=7) | np.uint64(1)


def shingle_hashes(texts: Texts, words: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of every text; a shorter text has its
    whole word sequence as one shingle, a text without words has none."""
    n = len(words)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for j in range(width):
            rolled += words[j : n - width + 1 + j] * _RUN[j]
        rolled = mix64(rolled + np.uint64(width) * _GOLDEN)
        out = []
        for i in range(len(texts)):
            a, b = texts.first[i], texts.first[i + 1]
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                short = np.uint64(0)
                for j in range(b - a):
                    short = short + words[a + j] * _RUN[j]
                out.append(mix64(np.array([short + np.uint64(b - a) * _GOLDEN], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
