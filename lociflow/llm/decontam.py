"""Benchmark decontamination by spaced seeds, with DataFrame operations only.

A mask of ones and zeros lies over consecutive tokens; a seed hashes the tokens under its ones, so
a changed token under a zero does not matter. Seeds of benchmark items and of training texts meet
in an equality join, and each hit is verified: on its diagonal some window around it must agree
in ``similarity`` of its tokens. Substituted words are tolerated, unrelated texts are not.

The masks miss nothing at the default similarity: whichever fifth of the tokens of a window of 20,
or of a whole item of 8 to 19 tokens, is replaced, one of them fits the rest (a test tries all
ways). Items of under eight tokens are searched for as they are, by a hash of all their tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import broadcast_if_small, free_name, materialise, scratch

#: Masks of five compared tokens each.
MASKS = ("11111", "111011", "11001011")
SPAN = max(map(len, MASKS))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds(df: DataFrame, keep: list[str], masks: list[str]) -> DataFrame:
    """``keep`` by token position ``at`` and seed hash ``h``, one row for each mask that fits there; tokens are in ``words``.

    The tokens themselves are not carried on, as they would be copied to every position.
    """
    least = min(map(len, masks))
    spread = df.filter(F.size("words") >= least).select(*keep, "words", F.explode(F.expr(f"sequence(0, size(words) - {least})")).alias("at"))

    def seed(mask: str) -> Column:
        h = F.xxhash64(F.lit(mask), *(F.get("words", F.col("at") + i) for i, c in enumerate(mask) if c == "1"))
        return h if len(mask) == least else F.when(F.col("at") + len(mask) <= F.size("words"), h)

    return spread.select(*keep, "at", F.explode(F.array(*map(seed, masks))).alias("h")).filter("h is not null")


def found(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 20, similarity: float = 0.8, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(id, key, i, matched, compared): rows of ``docs`` by id and text hash that hold part of item i."""
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("words")).filter(F.size("words") > 0).distinct()
    items = materialise(items.withColumn("item_key", F.xxhash64("words")), "benchmark")
    short = sorted(r[0] for r in items.filter(F.size("words") < SPAN).select(F.size("words")).distinct().collect())  # at most seven lengths
    keep = ["item_id", "item_key", "exact"]
    bench = seeds(items.filter(F.size("words") >= SPAN).withColumn("exact", F.lit(False)), keep, list(MASKS))
    for n in short:
        bench = bench.union(seeds(items.filter(F.size("words") == n).withColumn("exact", F.lit(True)), keep, ["1" * n]))
    bench = materialise(bench.withColumnRenamed("at", "item_at"), "benchmark-seeds")

    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    masks = [*MASKS, *("1" * n for n in short if "1" * n not in MASKS)]
    met = seeds(own.withColumn("words", tokens(F.col("text"))), ["id", "key"], masks).join(broadcast_if_small(bench, F.lit(64), broadcast_bytes), "h")
    diagonal = F.col("at") - F.col("item_at")
    # One diagonal is enough for an item that is searched for as it is.
    diagonals = met.groupBy("id", "key", "item_id", "item_key", F.when(~F.col("exact"), diagonal).alias("spaced")).agg(F.min(diagonal).alias("diagonal"))
    hits = materialise(diagonals.groupBy("id", "key").agg(F.collect_list(F.struct("item_id", "item_key", "diagonal")).alias("hits")), "hits")
    small_hits = broadcast_if_small(hits, F.size("hits") * 40 + 64, broadcast_bytes)
    near = own.join(small_hits, own["id"].eqNullSafe(hits["id"]) & (own["key"] == hits["key"])).select(own["id"], own["key"], tokens(F.col("text")).alias("words"), "hits").select("id", "key", "words", F.explode("hits").alias("z"))
    named = items.select(F.col("item_id").alias("i"), F.col("item_key").alias("k"), F.col("words").alias("item"))
    near = near.join(broadcast_if_small(named, F.size("item") * 24 + 64, broadcast_bytes), F.col("z.item_id").eqNullSafe(F.col("i")) & (F.col("z.item_key") == F.col("k")))
    return _verified(near, window, similarity)


def _verified(near: DataFrame, window: int, similarity: float) -> DataFrame:
    """Best window of each text and item over its diagonals, where it is similar enough."""
    start = F.greatest(F.col("z.diagonal"), F.lit(0))
    cut = near.select("id", "key", "i", "item", F.greatest(-F.col("z.diagonal"), F.lit(0)).alias("skip"), F.slice("words", start + 1, F.size("item")).alias("part"))
    equal = F.transform("item", lambda w, n: F.coalesce(F.when(n >= F.col("skip"), F.get("part", n - F.col("skip")) == w), F.lit(False)).cast("int"))
    sized = cut.select("id", "key", "i", equal.alias("equal"), F.least(F.size("item"), F.lit(window)).alias("compared"))
    sums = F.transform(F.sequence(F.lit(0), F.size("equal") - F.col("compared")), lambda s: F.aggregate(F.slice("equal", s + 1, F.col("compared")), F.lit(0), lambda a, x: a + x))
    enough = F.when(F.col("compared") < SPAN, F.col("compared")).otherwise(F.lit(similarity) * F.col("compared") - 1e-9)
    best = sized.select("id", "key", "i", F.array_max(sums).alias("matched"), "compared").filter(F.col("matched") >= enough)
    return best.groupBy("id", "key", "i").agg(F.max("matched").cast("bigint").alias("matched"), F.max("compared").cast("bigint").alias("compared"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 20, similarity: float = 0.8, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(id, item, matched, compared): texts that hold part of a benchmark item.

    ``compared`` is the smaller of ``window`` and the item's tokens, ``matched`` the most equal
    tokens of such a window on a diagonal with a hit. An item of under eight tokens has to be there
    as it is. Benchmark seeds, items, and the hits while they are verified are broadcast up to
    ``broadcast_bytes`` each and shuffled beyond. Items and texts without tokens, nulls included,
    give no row; ids that repeat, null ids included, are reported once for each item. Empty tables
    give an empty result; other columns of ``docs`` play no part.
    """
    with scratch(docs.sparkSession):
        best = materialise(found(docs, benchmark, id_col, text_col, item_col, item_text, window, similarity, broadcast_bytes), "overlaps", keep=True)
    return best.groupBy(F.col("id").alias(id_col), F.col("i").alias(item_col)).agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 32 << 20, **options) -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item.

    Rows are judged by id and text, so of rows that repeat an id only those with an overlap go.
    Null and empty texts stay. All columns of ``docs`` are kept as they are.
    """
    a, b = free_name(docs, "bad_id"), free_name(docs, "bad_key")
    with scratch(docs.sparkSession):
        hits = found(docs, benchmark, id_col, text_col, broadcast_bytes=broadcast_bytes, **options)
        bad = materialise(hits.select(F.col("id").alias(a), F.col("key").alias(b)).distinct(), "contaminated", keep=True)
    return docs.join(broadcast_if_small(bad, F.lit(64), broadcast_bytes), F.col(id_col).eqNullSafe(F.col(a)) & (F.xxhash64(text_col) == F.col(b)), "left_anti")
