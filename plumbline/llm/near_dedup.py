"""MinHash near-dedup by min-max hashing.

Every permutation is evaluated once and gives two signature values, the minimum and the maximum,
so 64 evaluations give 128 values.  Bands of four values (the two of two permutations) select
candidates: a pair of Jaccard similarity 0.75 escapes all 32 bands with probability 5e-6.

Work is done on *classes* (texts with equal shingle sets, named by a number), so exact copies cost nothing beyond
their signature.  Inside a bucket nothing is paired with everything:

1. every class is compared with one representative, the class that shares the most buckets
   (the original, in a group of edited copies), on full shingle sets; what a representative refused gets a
   representative of its own, for as long as most of the refused find theirs;
2. what shares a bucket with another component is paired where it shares one of its rarest shingles (the
   prefix filter, which loses no pair); buckets and shingles whose members are one component already are
   dropped by an aggregation. Where one shingle would make more than ``PAIRS`` pairs, its members are compared
   in blocks of bounded size that emit nothing but links that join components.

All steps run over all buckets without a cap. Keys that hold many rows (a bucket, a representative, a shingle, a
class of copies) are split: their facts are broadcast, under 1000 narrow rows, or their sets are copied
to as many salts as their rows need.

Defined cases: null or wordless text: an empty set, linked with nothing, kept, its component is its
own doc_id. Repeated rows: one class; each row is returned. Null doc_id: the row takes part, its
component is the smallest doc_id that is not null (null if there is none), ``kept`` is false where
the group has an id and true where it has none. Empty table: empty result. Other columns, whatever their names, aren't
read by :func:`near_duplicates` and pass through :func:`drop_near_duplicates`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import HOT_KEYS, Texts, cut, keyed, mix64, shingle_hashes, skew_join, slices, small_batches

PERMUTATIONS = 64
#: Permutations of a band; each gives its minimum and its maximum.
BAND = 2
#: Link when 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Shingles of the classes that one task holds and compares at a time, about.
BLOCK_SHINGLES = 1 << 19
#: Pairs of one shingle that are emitted; the members of a shingle with more are compared in blocks.
PAIRS = 1 << 16
#: Pairs that meet one copy of a class's set, at least; a HOT_KEYS-th of all pairs, where that is more.
SALT_PAIRS = 1 << 9

_FLIP = keyed(PERMUTATIONS, seed=1)[:, None]
_SCALE = (keyed(PERMUTATIONS, seed=2) | np.uint64(1))[:, None]


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of every permutation over a set of 64-bit shingles that isn't empty."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            values = (shingles[None, i : i + 2048] ^ _FLIP) * _SCALE
            values ^= values >> np.uint64(29)
            values *= _SCALE
            np.minimum(low, values.min(axis=1), out=low)
            np.maximum(high, values.max(axis=1), out=high)
    return low, high


def band_hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit key for every band of BAND minima and BAND maxima."""
    both = np.concatenate([low.reshape(-1, BAND), high.reshape(-1, BAND)], axis=1)
    with np.errstate(over="ignore"):
        key = mix64(np.arange(1, len(both) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for j in range(both.shape[1]):
            key = mix64(key + both[:, j])
    return key.view(np.int64)


_SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_key", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(2)
        for a, b in slices(text):
            texts = Texts(text.slice(a, b - a), lower=True)
            sets = shingle_hashes(texts, texts.word_hashes())
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = [band_hashes(*signature(s)) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=_SIGNED.names,
            )


_SETS = T.StructType([T.StructField("cls", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(1)
        for a, b in slices(text):
            texts = Texts(text.slice(a, b - a), lower=True)
            sets = shingle_hashes(texts, texts.word_hashes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=_SETS.names,
            )


def _keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, shingles) of the classes in ``wanted`` (cls, row), from the text of one row of each."""
    needed = wanted.select("cls", F.col("row.doc_id").alias("at_id"), F.col("row.text_key").alias("at_key"))
    texts = _keyed_texts(docs)
    found = texts.join(needed, (texts.text_key == needed.at_key) & texts.doc_id.eqNullSafe(needed.at_id))
    sets = found.select("cls", "text").mapInArrow(_shingle_sets, _SETS)
    return sets.groupBy("cls").agg(F.first("shingles").alias("shingles"))  # rows may repeat an id with its text


def _salted(pairs: DataFrame, sets: DataFrame, side: str, room: int) -> tuple[DataFrame, DataFrame]:
    """(key, salts) of one side of the pairs, a written table, with a salt for every ``room`` pairs of a key, and the
    sets of that side, each copied to as many salts as its pairs need."""
    salts = F.ceil(F.col("count") / room).cast("int")
    needed = cut(pairs.groupBy(side).count().select(side, salts.alias("salts")), "salts")
    copies = sets.join(needed, sets.cls == needed[side])
    salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    return needed, copies.select(side, salt.alias(f"salt_{side}"), F.col("shingles").alias(f"of_{side}"))


def _confirmed(pairs: DataFrame, sets: DataFrame, once: bool = False) -> DataFrame:
    """Of pairs (a, b) of classes, rows of a written table, those whose full shingle sets are similar enough.

    A key with more than one salt holds over a HOT_KEYS-th of the pairs or is one of few, so these are broadcast to the pairs.
    once: no class is the ``a`` of two pairs, so that side needs no salts.
    """
    n_a, n_b = F.size("of_a").cast("long"), F.size("of_b").cast("long")
    common = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    room = max(SALT_PAIRS, pairs.count() // HOT_KEYS)
    met = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("of_a")), "a") if once else pairs
    for side in "b" if once else "ab":
        needed, of_side = _salted(pairs, sets, side, room)
        salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("a", "b"), "salts").cast("int"))
        met = met.join(F.broadcast(needed.where("salts > 1")), side, "left").withColumn(f"salt_{side}", salt).drop("salts")
        met = met.join(of_side, [side, f"salt_{side}"])
    met = met.where(F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * SIMILAR)
    met = met.select("a", "b", (n_a + n_b).alias("n"), common.alias("common"))
    return met.where(F.col("common") * 100 >= (F.col("n") - F.col("common")) * SIMILAR).select("a", "b")


_ROWS = T.StructType(
    [
        T.StructField("hub", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("side", T.IntegerType()),
        T.StructField("cls", T.LongType()),
        T.StructField("comp", T.LongType()),
        T.StructField("shingles", T.ArrayType(T.LongType())),
    ]
)
_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


class _Held:
    """The refused classes of one block, ready to be compared with a stream of classes."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.cls = [r[0] for r in rows]
        self.comp = [r[1] for r in rows]
        self.sizes = np.array([len(r[2]) for r in rows])
        values = np.concatenate([r[2] for r in rows])
        owner = np.repeat(np.arange(len(rows)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]
        self.parent: dict[int, int] = {}

    def _root(self, comp: int) -> int:
        while (up := self.parent.get(comp, comp)) != comp:
            comp = up
        return comp

    def links(self, cls: int, comp: int, shingles: np.ndarray) -> list[tuple[int, int]]:
        """Links of a class to held ones that join components not joined here before."""
        low = np.searchsorted(self.values, shingles, "left")
        count = np.searchsorted(self.values, shingles, "right") - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = np.bincount(self.owner[at], minlength=len(self.cls))
        out = []
        for i in np.flatnonzero(common * 100 >= (self.sizes + len(shingles) - common) * SIMILAR):
            mine, other = self._root(self.comp[i]), self._root(comp)
            if mine != other:
                self.parent[max(mine, other)] = min(mine, other)
                out.append((self.cls[i], cls))
        return out


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (hub, block, side): the held classes of a block come first, then all of its hub."""
    block, rows, held = None, [], None
    for batch in batches:
        out = []
        sets = batch.column(5)
        values, ends = sets.flatten().to_numpy(zero_copy_only=False), np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))
        heads = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
        for i, (hub, number, side, cls, comp) in enumerate(heads):
            shingles = values[ends[i - 1] if i else 0 : ends[i]]
            if (hub, number) != block:
                block, rows, held = (hub, number), [], None
            if side == 0:
                rows.append((cls, comp, shingles.copy()))
            else:
                held = held or _Held(rows)
                out += held.links(cls, comp, shingles)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=_LINK.names)


def _in_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join components among the members of every group.

    members: (hub, cls, comp, few, n), hub naming the group, n the class's shingles. The few are held in
    blocks of about BLOCK_SHINGLES and met by every member of their group.
    """
    held_shingles = F.sum(F.when(F.col("few"), F.col("n")))
    blocks = members.groupBy("hub").agg(F.ceil(held_shingles / BLOCK_SHINGLES).cast("long").alias("blocks"))
    rows = cut(members.join(blocks, "hub"), "heavy").join(sets, "cls")
    held = rows.where("few").select("hub", F.pmod(F.xxhash64("cls"), "blocks").alias("block"), F.lit(0).alias("side"), "cls", "comp", "shingles")
    met = rows.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "cls", "comp", "shingles")
    both = held.unionByName(met).repartition("hub", "block").sortWithinPartitions("hub", "block", "side")
    return both.select(*_ROWS.names).mapInArrow(_compare_blocks, _LINK)


def _crossing(open_sets: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join different components.

    open_sets: (cls, comp, shingles), a written table. Sets of Jaccard similarity t share a shingle among the first
    n - ceil(t n) + 1 of either in any common order; in the order of frequency most of these belong to
    one set alone and pair with nothing, as do the edits of a copy that is too far from all others.
    Within a shingle, members of its most frequent component aren't compared with each other.
    """
    rows = open_sets.select("cls", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    counts = cut(rows.groupBy("shingle").count().where("count > 1"), "shingle-counts")
    shared = cut(skew_join(rows, counts.withColumnRenamed("count", "df"), "shingle", sizes=counts), "shared")
    by_class = Window.partitionBy("cls")
    place = F.row_number().over(by_class.orderBy("df", "shingle")) + F.col("n") - F.count("*").over(by_class)
    prefix = F.col("n") - F.ceil(F.col("n") * SIMILAR / 100) + 1
    first = cut(shared.withColumn("place", place).where(F.col("place") <= prefix).select("cls", "comp", "n", "shingle"), "prefixes")
    tally = first.groupBy("shingle", "comp").count().groupBy("shingle")
    tally = tally.agg(F.max(F.struct("count", "comp")).alias("most"), F.count("*").alias("comps"), F.sum("count").alias("every"))
    tally = cut(tally.where("comps > 1").select("shingle", "every", F.col("most.comp").alias("main"), (F.col("every") - F.col("most.count")).alias("others")), "tally")
    first = skew_join(first, tally, "shingle", sizes=tally.select("shingle", F.col("every").alias("count")))
    first = cut(first.withColumn("few", F.col("comp") != F.col("main")), "prefixes")
    heavy = F.col("others") * F.col("every") > PAIRS

    light = first.where(~heavy)
    few = light.where("few").select("shingle", F.col("cls").alias("a"), F.col("comp").alias("comp_a"), F.col("n").alias("n_a"))
    every = light.select("shingle", F.col("cls").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("few").alias("both"))
    once = ~F.col("both") | (F.col("a") < F.col("b"))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILAR
    pairs = few.join(every, "shingle").where((F.col("comp_a") != F.col("comp_b")) & once & sizes)
    links = _confirmed(cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs"), sets)
    crowd = first.where(heavy)
    if crowd.isEmpty():
        return links
    return links.unionByName(_in_blocks(crowd.select(F.col("shingle").alias("hub"), "cls", "comp", "few", "n"), sets))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, comp), comp its smallest node.

    Labels fall to the smallest among the neighbours and then jump to their label's label, so a
    chain of length n ends in about log n rounds. Each round is a written table.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = cut(edges.union(edges.select("v", "u")), "edges")  # a link that comes twice does no harm
    labels = cut(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("comp")), "labels")
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("v"), "comp"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        met = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        moved = met.join(up, "comp", "left").select("node", "old", F.least("comp", "above").alias("comp"))
        moved = cut(moved, "labels")
        changed = moved.where("comp <> old").limit(1).count()
        labels = moved.select("node", "comp")
        if not changed:
            return labels


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, members.cls == labels.node, "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))


def _refused(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """Of stars (cls, hub, weight), a written table, the classes outside their representative's component."""
    main = labels.select(F.col("node").alias("hub"), F.col("comp").alias("main"))
    known = labels.select(F.col("node").alias("cls"), "comp")
    met = skew_join(stars, main, "hub", "left").join(known, "cls", "left")
    return met.where(F.coalesce("comp", "cls") != F.coalesce("main", "hub")).select("cls", "hub", "weight")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, text_key.

    ``text_key`` is xxhash64 of the text; with doc_id it addresses the row in later joins.
    """
    small_batches(docs.sparkSession)
    signed = cut(_keyed_texts(docs).mapInArrow(_sign, _SIGNED), "signatures")
    classes = signed.where("digest is not null").groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_key")).alias("row"), F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"), F.count("*").alias("count")
    )
    # a class is named by a number, which the written table keeps
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    pairs = classes.select(F.explode("bands").alias("key"), "cls")
    reach = cut(pairs.groupBy("key").count().where("count > 1"), "reach")
    members = cut(skew_join(pairs, reach.withColumnRenamed("count", "reach"), "key", sizes=reach), "buckets")

    # 1. a star in every bucket, around the class that shares the most
    central = members.groupBy("cls").agg(F.sum("reach").alias("weight"))
    sets = cut(_full_sets(docs, classes.join(central.select("cls"), "cls").select("cls", "row")), "sets")
    offers = cut(members.select("key", "cls").join(central, "cls"), "offers")
    tops = offers.groupBy("key").agg(F.max(F.struct("weight", F.col("cls").alias("hub"))).alias("top"))
    offers = skew_join(offers, tops, "key", sizes=reach)
    stars = offers.where(F.col("cls") != F.col("top.hub")).groupBy("cls").agg(F.max("top").alias("top"), F.first("weight").alias("weight"))
    stars = cut(stars.select("cls", F.col("top.hub").alias("hub"), "weight"), "stars")
    links = cut(_confirmed(stars.select(F.col("cls").alias("a"), F.col("hub").alias("b")), sets, once=True), "links")
    labels = components(links)
    while True:
        refused = cut(_refused(stars, labels), "refused")
        tops = cut(refused.groupBy("hub").agg(F.max(F.struct("weight", "cls")).alias("top"), F.count("*").alias("count")), "tops")
        again = skew_join(refused, tops.select("hub", "top"), "hub", sizes=tops).where(F.col("cls") != F.col("top.cls"))
        stars = cut(again.select("cls", F.col("top.cls").alias("hub"), "weight"), "stars")
        asked = stars.count()
        if not asked:
            break
        found = cut(_confirmed(stars.select(F.col("cls").alias("a"), F.col("hub").alias("b")), sets, once=True), "links")
        n = found.count()
        if n:
            links = links.unionByName(found)
            labels = components(links)
        if 2 * n < asked:
            break

    # 2. what shares a bucket with another component
    marked = cut(_labelled(members, labels), "marked")
    open_keys = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    open_keys = cut(open_keys, "open-keys")
    marked = skew_join(marked, open_keys, "key", sizes=reach).select("cls", "comp").distinct()
    more = cut(_crossing(cut(sets.join(marked, "cls"), "open"), sets), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    grouped = classes.join(labels, classes.cls == labels.node, "left").select(
        "digest", "least_id", F.coalesce("comp", "cls").alias("comp")
    )
    smallest = grouped.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    ids = cut(grouped.join(smallest, "comp").select("digest", "component_id"), "ids")
    alone = F.col("digest").isNull()
    component: Column = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return skew_join(signed.drop("bands"), ids, "digest", "left", sizes=classes).select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that aren't the smallest id of their group; all columns stay."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("id"), "text_key")
    here = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("of"), F.xxhash64(docs["text"]).alias("key"))
    kept = here.join(gone, (F.col("key") == F.col("text_key")) & F.col("of").eqNullSafe(F.col("id")), "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
