"""The near-duplicate stage on five-word shingles: SimHash links, and MinHash bands for what lies beyond two bits.

A text is the set of its runs of five words. Two texts are near copies at a Jaccard similarity of
0.8 or more; every candidate pair is verified by the exact sets. Candidates come from the SimHash
operator (fingerprints of the same shingles at two or fewer differing bits) and from MinHash bands:
copies at 0.8 differ in about ten bits of 64, which no one-wildcard index reaches. With 32 bands of
five rows a pair at 0.8 meets in no band with a probability of 3e-6, and less above.

Index entries of over ``bucket_limit`` distinct sets are dealt into groups of about ``deal`` anew in
each band, and the sets of a group are compared with its first, so the work for one large group of
copies grows with its size and not its square. What such an entry then still holds in different
components is compared exactly: with shingles ordered from rare to common, two sets at the limit
share one early enough in both for what follows to be as much as the limit asks for. Only such
shingles meet in an equality join, across components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm import simhash
from lociflow.llm.components import connected_components
from lociflow.llm.shared import broadcast_if_small, materialise, not_broadcast, scratch, slices

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SEED = 42

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (4, BANDS * ROWS), np.uint64) << np.uint64(1) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(33)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; a shorter text is one run."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    h = np.array([xxhash.xxh64_intdigest(t, SEED) for t in tokens], np.uint64)
    count = len(tokens) - words + 1
    return np.unique(_mixed(sum(h[i : i + count] * _FACTORS[0, i] for i in range(words))))


def bands(own: np.ndarray) -> np.ndarray:
    """One key for each band of a set's MinHash signature; an empty set has none."""
    if not len(own):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1 << 13):  # bounded memory for very long texts
        x = own[at : at + (1 << 13), None] * _FACTORS[1] + _FACTORS[2]
        least = np.minimum(least, x.min(0))
    rows = _mixed(least).reshape(BANDS, ROWS) * _FACTORS[3].reshape(BANDS, ROWS)
    return _mixed(rows.sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def _same(sets: list[np.ndarray]) -> pa.Array:
    import xxhash

    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, same, fp, n, keys) per row: ``same`` is equal for equal shingle sets, ``fp`` the SimHash fingerprint, n the shingles, ``keys`` the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 23):
                sets = [shingles(t.as_py()) for t in batch.column("text")]
                fps = np.array([simhash.fingerprint(t.as_py(), SHINGLE_WORDS) for t in batch.column("text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), _same(sets), pa.array(fps), pa.array([len(s) for s in sets], pa.int32()), _lists([bands(s) for s in sets])], names=["id", "same", "fp", "n", "keys"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, same bigint, fp bigint, n int, keys array<bigint>")


def shingle_sets(docs: DataFrame, own: DataFrame, wanted: DataFrame, id_col: str, text_col: str, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(same, shingles) of the ``wanted`` values of ``same``; made again from one text of each, so that not all sets need be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 23):
                sets = [shingles(t.as_py()) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([_same(sets), _lists(sets)], names=["same", "shingles"])

    one_each = own.join(not_broadcast(wanted), "same", "left_semi").groupBy("same").agg(F.min("id").alias("wanted_id"))
    ids = materialise(one_each.select("wanted_id").distinct(), "wanted-ids")
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = given.join(broadcast_if_small(ids, F.lit(32), broadcast_bytes), F.col("id") == F.col("wanted_id"), "left_semi").select("text")
    made = chosen.mapInArrow(run, "same bigint, shingles array<bigint>")
    return materialise(made.join(not_broadcast(wanted), "same", "left_semi").groupBy("same").agg(F.first("shingles").alias("shingles")), "sets")


def simhash_pairs(own: DataFrame) -> DataFrame:
    """Candidate pairs (x, y) of ``same`` values by SimHash links: between the first sets of linked fingerprints, and to the others of each."""
    sets = own.select("fp", "same").distinct()
    first = materialise(sets.groupBy("fp").agg(F.min("same").alias("rep")), "fingerprints")
    equal = sets.join(not_broadcast(first), "fp").filter("rep < same").select(F.col("rep").alias("x"), F.col("same").alias("y"))
    linked = simhash.links(first.select("fp")).select(F.col("x").alias("f"), F.col("y").alias("g"))
    ends = [not_broadcast(first.select(F.col("fp").alias(v), F.col("rep").alias(r))) for v, r in ("fa", "gb")]
    linked = linked.join(ends[0], "f").join(ends[1], "g")
    return equal.union(linked.filter("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")))


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The pairs whose shingle sets are at ``similarity`` or above; ``sets_of`` gives the sets of a table of ``same`` values."""
    sets = sets_of(pairs.select(F.col("x").alias("same")).union(pairs.select("y")).distinct())
    left, right = (not_broadcast(sets.select(F.col("same").alias(v), F.col("shingles").alias(f"s_{v}"))) for v in "xy")
    both = pairs.join(left, "x").join(right, "y").select("x", "y", F.size(F.array_intersect("s_x", "s_y")).alias("common"), (F.size("s_x") + F.size("s_y")).alias("all"))
    return materialise(both.filter(F.col("common") >= F.lit(similarity) * (F.col("all") - F.col("common")) - 1e-9).select("x", "y"), "near-links")


def links(own: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, bucket_limit: int = 64, deal: int = 16) -> DataFrame:
    """Pairs (x, y), x < y, of ``same`` values whose shingle sets are at ``similarity`` or above.

    All pairs below ``bucket_limit`` sets an entry; above it enough pairs to keep every component whole.
    """
    index = materialise(own.select("same", "n", F.explode("keys").alias("key")).distinct(), "bands")
    shared = index.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    group = F.when(F.col("held") > bucket_limit, F.pmod(F.xxhash64("key", "same"), F.ceil(F.col("held") / deal))).otherwise(F.lit(0))
    met = materialise(index.join(not_broadcast(shared), "key").select("key", "same", "n", "held", group.alias("group")), "met")
    light = met.filter(F.col("held") <= bucket_limit)
    one, two = (light.select("key", F.col("same").alias(v), F.col("n").alias(f"n_{v}")) for v in "xy")
    banded = one.join(not_broadcast(two), "key").filter((F.col("x") < F.col("y")) & _fits(similarity)).select("x", "y")
    first = Window.partitionBy("key", "group").orderBy("same")
    dealt = met.filter(F.col("held") > bucket_limit).select(F.first("same").over(first).alias("x"), F.first("n").over(first).alias("n_x"), F.col("same").alias("y"), F.col("n").alias("n_y"))
    dealt = dealt.filter((F.col("x") < F.col("y")) & _fits(similarity)).select("x", "y")
    sure = verified(materialise(banded.union(dealt).union(simhash_pairs(own)).distinct(), "pairs"), sets_of, similarity)
    heavy = met.filter(F.col("held") > bucket_limit)
    if not heavy.limit(1).count():
        return sure
    comps = connected_components(sure, "x", "y")
    named = heavy.join(not_broadcast(comps), F.col("same") == F.col("node"), "left").select("key", "same", "n", F.coalesce("component", "same").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    apart = materialise(named.join(not_broadcast(mixed), "key", "left_semi").select("same", "n", "component").distinct(), "apart")
    return sure.union(verified(across(apart, sets_of, similarity), sets_of, similarity)) if apart.limit(1).count() else sure


def _fits(similarity: float):
    return F.least("n_x", "n_y") >= F.lit(similarity) * F.greatest("n_x", "n_y") - 1e-9


#: Classes of shingles by hash; their counts travel with the plan.
CLASSES = 1 << 14


def _class(shingle: Column) -> Column:
    return F.pmod(shingle, F.lit(CLASSES)).cast("int")


def across(apart: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Every pair (x, y) of sets of different components in ``apart`` (same, n, component) that can reach ``similarity``.

    Shingles are ordered by how many shingles of these sets are in their class, rare classes first;
    any order that is the same for all sets is right, and the classes' counts are few enough to be
    a literal, so that no shingle meets a table of frequencies. After the first shingle that two sets
    share, at positions p and q, they share at most what follows, and at the limit s they share
    s / (1 + s) of their sizes' sum. Per shingle only the sets outside its largest component are
    paired, with all of the others.
    """
    sets = sets_of(apart.select("same"))
    counted = sets.select(F.explode("shingles").alias("shingle")).groupBy(_class(F.col("shingle")).alias("class")).agg(F.count("*").alias("n")).collect()
    held = [0] * CLASSES
    for row in counted:
        held[row["class"]] = row["n"]
    rarity = F.lit(np.array(held, np.int64))
    ordered = sets.join(not_broadcast(apart), "same").select("same", "n", "component", F.array_sort(F.transform("shingles", lambda s: F.struct(F.get(rarity, _class(s)).alias("held"), s.alias("shingle")))).alias("s"))
    first = F.slice("s", F.lit(1), F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int") + 1)
    rare = ordered.select("same", "n", "component", F.posexplode(first).alias("at", "r"))
    rare = materialise(rare.select("same", "n", "component", "r.shingle", (F.col("n") - F.col("at")).alias("left")), "rare-shingles")
    size = rare.groupBy("shingle", "component").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.count("*").alias("k"), F.max_by("component", F.struct("c", "component")).alias("largest")).filter("k > 1").select("shingle", "largest")
    open_sets = rare.join(not_broadcast(size), "shingle")
    one = open_sets.filter(F.col("component") != F.col("largest")).select("shingle", *(F.col(c).alias(v) for c, v in (("same", "x"), ("n", "n_x"), ("component", "c_x"), ("left", "left_x"))))
    two = open_sets.select("shingle", *(F.col(c).alias(v) for c, v in (("same", "y"), ("n", "n_y"), ("component", "c_y"), ("left", "left_y"))))
    enough = F.least("left_x", "left_y") >= F.lit(similarity / (1 + similarity)) * (F.col("n_x") + F.col("n_y")) - 1e-9
    met = one.join(not_broadcast(two), "shingle").filter((F.col("c_x") != F.col("c_y")) & _fits(similarity) & enough)
    return materialise(met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs-across")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 32 << 20, **options) -> DataFrame:
    """Rows of ``docs`` with the smallest id of each group of near copies, one row for each id; rows without an id stay.

    Groups are the connected components of the links. Null and empty texts and texts of white space
    only are one group. Of rows that repeat an id one stays. An empty table gives an empty result;
    all columns of ``docs`` are kept. The ids that stay are broadcast up to ``broadcast_bytes``.
    """
    with scratch(docs.sparkSession):
        given = docs.filter(F.col(id_col).isNotNull())
        own = materialise(described(given, id_col, text_col), "bands-by-row")
        comps = connected_components(links(own, lambda wanted: shingle_sets(given, own, wanted, id_col, text_col, broadcast_bytes), **options), "x", "y")
        firsts = own.groupBy("same").agg(F.min("id").alias("id"))
        named = firsts.join(not_broadcast(comps), F.col("same") == F.col("node"), "left").select("id", F.coalesce("component", "same").alias("group"))
        kept = materialise(named.groupBy("group").agg(F.min("id").alias(id_col)).select(id_col).distinct(), "kept", keep=True)
    stay = docs.join(broadcast_if_small(kept, F.lit(32), broadcast_bytes), id_col, "left_semi").dropDuplicates([id_col])
    return stay.unionByName(docs.filter(F.col(id_col).isNull())).select(docs.columns)
