"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, with DataFrame operations only.

Rows are permuted within their partition; how many of a partition's rows go to each shard is
drawn from the multivariate hypergeometric law, so that all row counts come out exactly and every
assignment is equally likely; then rows are exchanged and permuted again within their shard.
The matrix is drawn down a tree over the partitions, 16 children a node, so no step is as long
as the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.shared import broadcast_if_small, free_name, held_once, materialise

SHARDS = 8
FANOUT = 16
#: Two constants of the ratio-of-uniforms hat for unimodal discrete laws, sqrt(8/e) and 3 - sqrt(12/e).
HAT = (1.7155277699214135, 0.8989161620588988)
#: A trial is accepted with a probability of over 0.6, so not one of these is left out in practice; if so, the job fails.
TRIALS = 96


def uniform(*of: Column) -> Column:
    """A number in (0, 1) that depends on the values alone."""
    return (F.shiftrightunsigned(F.xxhash64(*of), 11) + F.lit(0.5)) * F.lit(2.0**-53)


def _log_factorial_ratio(y: Column, x: Column) -> Column:
    """ln(y! / x!): exact factorials up to 20, above them Stirling's series with the large terms subtracted first."""
    def series(v: Column) -> Column:
        return (F.lit(1 / 12) - (F.lit(1 / 360) - F.lit(1 / 1260) / (v * v)) / (v * v)) / v

    def single(v: Column) -> Column:
        d = v.cast("double")
        return F.when(v <= 20, F.ln(F.factorial(v.cast("int")).cast("double"))).otherwise((d + 0.5) * F.ln(d) - d + F.lit(0.9189385332046727) + series(d))

    a, b = y.cast("double"), x.cast("double")
    both = (b + 0.5) * F.log1p((a - b) / b) + (a - b) * (F.ln(a) - 1) + series(a) - series(b)
    return F.when(y == x, F.lit(0.0)).when((y > 20) & (x > 20), both).otherwise(single(y) - single(x))


def hypergeometric(good: Column, bad: Column, draws: Column, *seed: Column) -> Column:
    """Number of good ones among ``draws`` taken without replacement, by ratio of uniforms; the same seed gives the same number.

    The hat holds for every size, so the work does not grow with the numbers. No good or no bad ones,
    or no draws, leave nothing to chance.
    """
    lo, hi = F.greatest(F.lit(0).cast("bigint"), draws - bad), F.least(draws, good)
    n = F.greatest(good + bad, F.lit(1)).cast("double")
    mean = draws * (good / n)
    spread = mean * (bad / n) * ((n - draws) / F.greatest(n - 1, F.lit(1.0)))
    mode = F.greatest(lo, F.least(hi, F.floor((draws + 1.0) * ((good + 1.0) / (n + 2.0)))))
    start = F.struct(lo.alias("lo"), hi.alias("hi"), mode.alias("mode"), (mean + 0.5).alias("centre"), (F.lit(HAT[0]) * F.sqrt(spread + 0.5) + F.lit(HAT[1])).alias("width"))

    def attempt(s: Column, trial: Column) -> Column:
        def judge(t: Column) -> Column:
            x, m = t["x"], s["mode"]
            gain = _log_factorial_ratio(m, x) + _log_factorial_ratio(good - m, good - x) + _log_factorial_ratio(draws - m, draws - x) + _log_factorial_ratio(bad - draws + m, bad - draws + x)
            return F.when((x >= s["lo"]) & (x <= s["hi"]) & (2 * F.ln(t["u"]) <= gain), x)

        u = uniform(*seed, trial, F.lit("u"))
        return held_once(F.struct(F.floor(s["centre"] + s["width"] * (uniform(*seed, trial, F.lit("v")) - 0.5) / u).alias("x"), u.alias("u")), judge)

    def drawn(s: Column) -> Column:
        tries = F.aggregate(F.sequence(F.lit(1), F.lit(TRIALS)), F.lit(None).cast("bigint"), lambda found, trial: F.coalesce(found, attempt(s, trial)))
        return F.when(s["lo"] == s["hi"], s["lo"]).otherwise(F.coalesce(tries, F.raise_error(F.lit("no accepted draw")).cast("bigint")))

    return held_once(start, drawn)


def _row(rest: Column, draws: Column, *seed: Column) -> Column:
    """Array: how many of ``draws`` rows go to each shard with ``rest`` places left, the last shard taking what remains."""
    total = F.aggregate(rest, F.lit(0).cast("bigint"), lambda a, x: a + x)
    start = F.struct(draws.alias("draws"), total.alias("total"), F.lit(0).alias("j"), F.array().cast("array<bigint>").alias("taken"))

    def step(s: Column, good: Column) -> Column:
        took = hypergeometric(good, s["total"] - good, s["draws"], *seed, s["j"])
        return held_once(took, lambda x: F.struct((s["draws"] - x).alias("draws"), (s["total"] - good).alias("total"), (s["j"] + 1).alias("j"), F.array_append(s["taken"], x).alias("taken")))

    return F.aggregate(rest, start, step)["taken"]


def communication_matrix(counts: DataFrame, sizes: list[int], seed: int = 0) -> DataFrame:
    """(block, take) for ``counts`` (block from 0, n): rows of each block for each shard. Rows sum to n, columns to ``sizes``.

    Counts are added up a tree of 16 children a node; from its top each node's places are dealt to
    its children, one after another. Only the tree's height reaches the driver.
    """
    levels = [counts.select(F.col("block").cast("bigint").alias("id"), F.col("n").cast("bigint").alias("n"))]
    last = levels[0].agg(F.max("id")).first()[0] or 0
    while last > 0:
        last //= FANOUT
        levels.append(levels[-1].groupBy(F.floor(F.col("id") / FANOUT).alias("id")).agg(F.sum("n").alias("n")))
    down = levels[-1].select("id", F.array(*(F.lit(s).cast("bigint") for s in sizes)).alias("take"))
    for depth in range(len(levels) - 2, -1, -1):
        kids = levels[depth].groupBy(F.floor(F.col("id") / FANOUT).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("kid"), "n"))).alias("kids"))
        start = F.struct(F.col("take").alias("rest"), F.expr("cast(array() as array<struct<kid:bigint,take:array<bigint>>>)").alias("out"))

        def deal(s: Column, kid: Column) -> Column:
            row = _row(s["rest"], kid["n"], F.lit(seed), F.lit(depth), kid["kid"])
            return held_once(row, lambda take: F.struct(F.zip_with(s["rest"], take, lambda a, b: a - b).alias("rest"), F.array_append(s["out"], F.struct(kid["kid"].alias("kid"), take.alias("take"))).alias("out")))

        dealt = down.join(kids, "id").select(F.explode(F.aggregate("kids", start, deal)["out"]).alias("x"))
        down = materialise(dealt.select(F.col("x.kid").alias("id"), F.col("x.take").alias("take")), "matrix")
    return down.select(F.col("id").alias("block"), "take")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 0, rows_a_range: int = 1 << 15) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: a uniform shuffle into shards whose row counts differ by one at most.

    Slots run from 0 in each shard without gaps. Every row goes somewhere, whatever it holds: null and
    repeated rows are rows like others, with more shards than rows some are empty, an empty table
    gives no rows. Columns named shard or slot are replaced. Call it within ``scratch``; rows are
    written once in locally permuted order, which also fixes them for what follows, and shuffled
    once. ``rows_a_range`` bounds what one task sorts at the end; there are as many ranges as tasks at least.
    """
    own = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")])
    key, at = free_name(own, "permute_key"), free_name(own, "permuted_at")
    local = own.withColumn(key, F.xxhash64(F.lit(seed), F.lit("local"), F.monotonically_increasing_id())).sortWithinPartitions(key)
    # Row numbers hold the partition above bit 33 and the place in the permuted partition below.
    rows = materialise(local.drop(key).withColumn(at, F.monotonically_increasing_id()), "permuted")
    block, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    counts = materialise(rows.groupBy(block.alias("block")).agg(F.count("*").alias("n")), "block-counts")
    n = counts.agg(F.sum("n")).first()[0] or 0
    take = communication_matrix(counts, [n // shards + (j < n % shards) for j in range(shards)], seed)
    cuts = F.aggregate("take", F.array().cast("array<bigint>"), lambda done, x: F.array_append(done, F.coalesce(F.element_at(F.when(F.size(done) > 0, done), -1), F.lit(0)) + x))
    ends = materialise(take.select("block", cuts.alias("ends")), "block-cuts")
    ends = broadcast_if_small(ends, F.lit(8 * shards + 64), 8 << 20)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(-(-parts // shards), -(-n // (shards * rows_a_range)))
    names = {c: free_name(own, f"shuffle_{c}") for c in ("block", "ends", "range", "mix", "base", "own")}
    ends = ends.select(F.col("block").alias(names["block"]), F.col("ends").alias(names["ends"]))
    sent = rows.join(ends, block == F.col(names["block"]))
    mix = F.xxhash64(F.lit(seed), F.lit("again"), F.col(at))
    sent = sent.withColumn("shard", F.size(F.filter(names["ends"], lambda e: e <= place)).cast("int")).withColumn(names["mix"], mix)
    sent = sent.withColumn(names["range"], F.pmod(F.xxhash64(F.lit(seed), F.lit("range"), F.col(at)), F.lit(ranges))).drop(names["block"], names["ends"])
    held = sent.groupBy("shard", names["range"]).agg(F.count("*").alias(names["own"]))
    w = Window.partitionBy("shard").orderBy(names["range"]).rowsBetween(Window.unboundedPreceding, -1)
    base = held.withColumn(names["base"], F.coalesce(F.sum(names["own"]).over(w), F.lit(0))).drop(names["own"])
    inside = F.row_number().over(Window.partitionBy("shard", names["range"]).orderBy(names["mix"], at)) - 1
    return sent.withColumn("slot", inside.cast("bigint")).join(base, ["shard", names["range"]]).withColumn("slot", F.col("slot") + F.col(names["base"])).select(*(F.col(f"`{c}`") for c in own.columns), "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard of Parquet files, each file's rows in order of slot."""
    sharded.repartition("shard", F.floor(F.col("slot") / (1 << 20))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
