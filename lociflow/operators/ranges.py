"""Range joins, islands and prefix sums: the interval tools under the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bins of one level are so many times as wide as those of the level below; the widest are longer than contigs.
STEP, WIDEST = 64, 1 << 29


def _widths(width: int, longest: int | None = None) -> list[int]:
    """Bin widths of all levels, up to the first that holds ``longest`` positions."""
    out = [width]
    while out[-1] < (WIDEST if longest is None else longest):
        out.append(out[-1] * STEP)
    return out


def _bin(pos: Column, width: int) -> Column:
    return F.floor(pos / width).cast("bigint")


def _held(lo: Column, hi: Column, widths: list[int]) -> Column:
    """Array of (level, first, last): the levels at which [lo, hi) touches two bins at most, its own level first; the top level always."""
    each = F.array(*(F.struct(F.lit(i).alias("level"), _bin(lo, w).alias("first"), _bin(hi - 1, w).alias("last")) for i, w in enumerate(widths)))
    return F.filter(each, lambda x: (x["last"] - x["first"] <= 1) | (x["level"] == len(widths) - 1))


def point_in_interval(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str, on: list[tuple[str, str]], width: int, how: str = "inner", longest: int | None = None) -> DataFrame:
    """Pairs with ``lo <= point < hi`` and equal ``on`` columns.

    Bins come in levels, each 64 times as wide as the one below. An interval goes to the lowest level
    at which it touches two bins at most, so it makes two rows at most however long it is; a point
    looks into one bin of each level. No pair comes twice, and the join is an equality join that
    Spark can deal out and split. Give a ``width`` near the usual interval length, and ``longest``
    where it is known, which leaves out the levels above. Empty intervals match nothing.

    The join is a sort-merge join by hint: Spark judges a side by the file it comes from, not by the rows
    made here, and would send millions of them through the driver as a broadcast.
    """
    widths = _widths(width, longest)
    spread = intervals.filter(F.col(hi) > F.col(lo)).withColumn("__own", _held(F.col(lo), F.col(hi), widths)[0])
    spread = spread.withColumn("__level", F.col("__own.level")).withColumn("__bin", F.explode(F.sequence("__own.first", "__own.last"))).drop("__own")
    looks = F.array(*(F.struct(F.lit(i).alias("level"), _bin(F.col(point), w).alias("bin")) for i, w in enumerate(widths)))
    keyed = points.withColumn("__look", F.explode(looks)).withColumn("__look_level", F.col("__look.level")).withColumn("__look_bin", F.col("__look.bin")).drop("__look")
    cond = (F.col("__look_level") == F.col("__level")) & (F.col("__look_bin") == F.col("__bin")) & (F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))
    for a, b in on:
        cond = cond & (keyed[a] == spread[b])
    return keyed.hint("merge").join(spread.hint("merge"), cond, how).drop("__look_level", "__look_bin", "__level", "__bin")


def overlap(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], on: list[tuple[str, str]], width: int, longest: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Pairs of half-open intervals that share a position, each once, however long they are.

    Of a pair the interval of the higher level lies in its own bins, and the other one looks there;
    which of both it is makes part of the key, so intervals meet at no level above both of theirs.
    A pair that meets in two bins is kept in the later start's. Both tables are read once. Neither is
    broadcast, as in ``point_in_interval``.
    """
    widths = _widths(width, None if None in longest else max(longest))
    top = [len(_widths(width, n)) - 1 if n is not None else len(widths) - 1 for n in longest]

    def spread(df: DataFrame, span: tuple[str, str], to: str, own_role: int, other_top: int) -> DataFrame:
        def rows(x: Column, i: Column) -> Column:
            # 0: the left one's level is as high or higher, 1: the right one's is higher.
            looks = F.when((i > (0 if own_role == 0 else -1)) & (x["level"] <= other_top), F.array(F.lit(1 - own_role)))
            roles = F.concat(F.when(i == 0, F.array(F.lit(own_role))).otherwise(F.array().cast("array<int>")), F.coalesce(looks, F.array().cast("array<int>")))
            return F.flatten(F.transform(F.sequence(x["first"], x["last"]), lambda k: F.transform(roles, lambda r: F.struct(r.alias("role"), x["level"].alias("level"), k.alias("bin")))))

        return df.filter(F.col(span[1]) > F.col(span[0])).withColumn(to, F.explode(F.flatten(F.transform(_held(F.col(span[0]), F.col(span[1]), widths), rows))))

    x, y = spread(left, a, "__left", 0, top[1]), spread(right, b, "__right", 1, top[0])
    wide = F.element_at(F.array(*(F.lit(w) for w in widths)), F.col("__left.level") + 1)
    cond = (F.col("__left") == F.col("__right")) & (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (F.col("__left.bin") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / wide))
    for p, q in on:
        cond = cond & (x[p] == y[q])
    return x.hint("merge").join(y.hint("merge"), cond).drop("__left", "__right")


def prefix_sum(deltas: DataFrame, value: str, to: str, key: str = "chrom", pos: str = "pos", block: int = 65536) -> DataFrame:
    """Running sum of ``value`` by ``pos`` within ``key``, in two levels.

    Positions are cut into blocks; block totals are summed up in one small window by key, and
    within a block in another. No task gets a whole chromosome. ``pos`` must be unique by key.
    """
    own = deltas.withColumn("__k", F.floor(F.col(pos) / block))
    totals = own.groupBy(key, "__k").agg(F.sum(value).alias("__t"))
    before = totals.withColumn("__base", F.coalesce(F.sum("__t").over(Window.partitionBy(key).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    inside = F.sum(value).over(Window.partitionBy(key, "__k").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("__in", inside).join(before, [key, "__k"]).withColumn(to, F.col("__base") + F.col("__in")).drop("__k", "__in", "__base")


def steps(changes: DataFrame, value: str, to: str, next_to: str, key: str = "chrom", pos: str = "pos", block: int = 65536, parts: int | None = None) -> DataFrame:
    """(key, pos, to, next_to): ``value`` summed up by place, its running sum within ``key``, and the next place; places whose sum is zero are left out.

    As ``prefix_sum`` and ``next_position`` together, from changes of any number a place. One exchange by
    block of positions serves the sums by place, the running sums and the next places; what lies before
    and behind a block comes from one row a block. ``parts`` gives the exchange's partitions (the
    session's without): rows are narrow, and Spark would join partitions by their packed size.
    Changes without a key or place are left out.
    """
    # What the join would ask of one side only is asked of both, so that both are the same exchange and it is made once.
    own = changes.select(key, pos, value, F.floor(F.col(pos) / block).alias("__k")).filter(F.col(key).isNotNull() & F.col("__k").isNotNull())
    own = own.repartition(key, "__k") if parts is None else own.repartition(parts, key, "__k")
    summed = own.groupBy(key, "__k", pos).agg(F.sum(value).alias("__v")).filter("__v <> 0")
    inside = Window.partitionBy(key, "__k").orderBy(pos)
    each = summed.select(key, "__k", pos, F.sum("__v").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("__in"), F.lead(pos).over(inside).alias("__lead"))
    blocks = summed.groupBy(key, "__k").agg(F.sum("__v").alias("__t"), F.min(pos).alias("__f"))
    over = Window.partitionBy(key).orderBy("__k")  # one row a block
    around = blocks.select(key, "__k", F.coalesce(F.sum("__t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.lead("__f").over(over).alias("__after"))
    return each.join(around, [key, "__k"]).select(key, pos, (F.col("__base") + F.col("__in")).alias(to), F.coalesce("__lead", "__after").alias(next_to))


def carry_forward(rows: DataFrame, value: str, to: str, pos: str, block: int = 4096, levels: int = 2, before: bool = False) -> DataFrame:
    """``rows`` with the last non-null ``value`` at each ``pos`` or earlier (with ``before``: earlier only) as ``to``, over the whole table.

    Rows are cut into blocks of positions. The last value of each block is carried over the blocks
    first, in the same way again for ``levels``, then within blocks; the one window without a
    partition sees a row for each ``block ** levels`` positions. ``pos`` must be unique.
    """
    frame = (Window.unboundedPreceding, -1 if before else 0)
    if not levels:
        return rows.withColumn(to, F.last(value, ignorenulls=True).over(Window.orderBy(pos).rowsBetween(*frame)))
    k, got = f"__k{levels}", f"__v{levels}"
    own = rows.withColumn(k, F.floor(F.col(pos) / block))
    ends = own.groupBy(k).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(pos))).alias("__value"))
    carried = carry_forward(ends, "__value", got, k, block, levels - 1, before=True).select(k, got)
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(k).orderBy(pos).rowsBetween(*frame))
    return own.withColumn("__inside", inside).join(carried, k).withColumn(to, F.coalesce("__inside", got)).drop(k, got, "__inside")


def next_position(points: DataFrame, to: str, key: str = "chrom", pos: str = "pos", block: int = 65536) -> DataFrame:
    """The next larger ``pos`` of the same ``key``, again without a window over a whole key."""
    own = points.withColumn("__k", F.floor(F.col(pos) / block))
    firsts = own.groupBy(key, "__k").agg(F.min(pos).alias("__f"))
    after = firsts.withColumn("__next", F.lead("__f").over(Window.partitionBy(key).orderBy("__k"))).drop("__f")
    lead = F.lead(pos).over(Window.partitionBy(key, "__k").orderBy(pos))
    return own.withColumn("__in", lead).join(after, [key, "__k"]).withColumn(to, F.coalesce("__in", "__next")).drop("__k", "__in", "__next")


def _merged(regions: DataFrame, keys: list[str], s: str, e: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(s, e)
    reach = F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = regions.withColumn("__new", F.when(reach.isNull() | (F.col(s) > reach), 1).otherwise(0))
    return marked.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "__g").agg(F.min(s).alias(s), F.max(e).alias(e)).drop("__g")


def merge_intervals(regions: DataFrame, key: str = "chrom", s: str = "s", e: str = "e", block: int = 65536) -> DataFrame:
    """Union of regions: overlapping and adjacent ones merged, as (key, s, e).

    Regions are merged by blocks of their starts first, so that the window over a whole key sees
    only what the blocks could not join.
    """
    own = regions.filter(F.col(e) > F.col(s)).withColumn("__k", F.floor(F.col(s) / block))
    return _merged(_merged(own, [key, "__k"], s, e).drop("__k"), [key], s, e)


def runs_of(points: DataFrame, key: str = "chrom", pos: str = "pos", least: int = 2, block: int = 65536) -> DataFrame:
    """Maximal runs of consecutive positions of at least ``least``, as (key, s, e).

    Runs are found within blocks of positions and those that touch a block's border are joined.
    """
    own = points.select(key, pos).distinct().withColumn("__k", F.floor(F.col(pos) / block))
    g = F.col(pos) - F.row_number().over(Window.partitionBy(key, "__k").orderBy(pos))
    inner = own.withColumn("__g", g).groupBy(key, "__k", "__g").agg(F.min(pos).alias("s"), (F.max(pos) + 1).alias("e")).select(key, "s", "e")
    return merge_intervals(inner, key).filter(F.col("e") - F.col("s") >= least)


def _range_of(borders: list, key: Column, types: list) -> Column:
    """How many of the sorted ``borders`` are at most ``key``, by halving steps over one literal array."""
    if not borders:
        return F.lit(0)
    names = [f"c{i}" for i in range(len(types))]
    table = F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(row, types, names))) for row in borders))
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(borders).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at))


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], totals: dict[str, str] | None = None, sample: int = 20) -> DataFrame:
    """``df`` with running sums (new name: column) by ``order`` within ``keys`` (none: over the whole table), and whole sums of the group.

    The sorted table is cut into ranges of (keys, order); sums run within a range of a group, and
    those of the group's earlier ranges are added. A group with most of the rows spreads over many
    ranges, so no task gets a whole group. The borders come once from ``sample`` random rows a range
    and only balance the work: a row's range depends on its values alone, so a rerun gives the same
    sums. Nulls are one group and sort first; rows equal in ``order`` come in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*keys, *order]
    types = [df.schema[c].dataType for c in columns]
    key = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    picked = df.select(key.alias("x")).orderBy(F.rand(42)).limit(parts * sample)
    found = picked.agg(F.array_sort(F.collect_list("x")).alias("x")).first()["x"][sample::sample]
    borders = [row for i, row in enumerate(found) if i == 0 or row != found[i - 1]]
    totals = totals or {}
    own = df.withColumn("__g", F.struct(F.lit(0), *(F.col(c) for c in keys))).withColumn("__p", _range_of(borders, key, types))
    inside = Window.partitionBy("__g", "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = sorted({*sums.values(), *totals.values()})
    counts = own.groupBy("__g", "__p").agg(*(F.sum(c).alias(f"__s{i}") for i, c in enumerate(used)))
    w = Window.partitionBy("__g")  # one row a range
    upto = w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__g", "__p", *(F.sum(f"__s{used.index(c)}").over(upto).alias(f"__b{i}") for i, c in enumerate(sums.values())), *(F.sum(f"__s{used.index(c)}").over(w).alias(f"__t{i}") for i, c in enumerate(totals.values())))
    own = own.select("*", *(F.sum(c).over(inside).alias(f"__i{i}") for i, c in enumerate(sums.values()))).join(before, ["__g", "__p"])
    out = {to: F.coalesce(F.col(f"__b{i}"), F.lit(0)) + F.coalesce(F.col(f"__i{i}"), F.lit(0)) for i, to in enumerate(sums)} | {to: F.coalesce(F.col(f"__t{i}"), F.lit(0)) for i, to in enumerate(totals)}
    return own.select(*(F.col(f"`{c}`") for c in df.columns if c not in out), *(c.alias(to) for to, c in out.items()))


def ranked(df: DataFrame, keys: list[str], order: list[str], to: str, total: str | None = None, sample: int = 20) -> DataFrame:
    """``df`` with 1-based ranks ``to`` by ``order`` within ``keys`` and, if named, the group's row count ``total``, as ``running_sums`` of ones."""
    own = df.withColumn("__one", F.lit(1).cast("bigint"))
    return running_sums(own, keys, order, {to: "__one"}, {total: "__one"} if total else None, sample).drop("__one")


def nth_smallest(df: DataFrame, column: str, k: int, few: int = 10_000):
    """The ``k``-th smallest non-null value (from 1) of a column, exact, as a driver number.

    A quantile sketch gives two values around the wanted rank and rows are counted on both sides of
    each. Either one of them holds the rank, or it lies before, between or behind them, and only those
    rows are looked at again until few are left. No task gets more than ``few`` values.
    """
    own = df.select(F.col(column).alias("v")).filter("v is not null")
    left, below = own.count(), 0
    if not 0 < k <= left:
        raise ValueError(f"no value of rank {k} among {left}")
    while left > few:
        share = (k - below - 0.5) / left
        low, high = (F.lit(v) for v in own.agg(F.percentile_approx("v", [max(0.0, share - 2e-4), min(1.0, share + 2e-4)], 10_000).alias("q")).select(F.col("q")[0].alias("a"), F.col("q")[1].alias("b")).first())
        found = own.agg(F.max(low).alias("low"), F.max(high).alias("high"), *(F.count_if(c) for c in (F.col("v") < low, F.col("v") <= low, F.col("v") < high, F.col("v") <= high))).first()
        rank, (under, to_low, to_high, upto) = k - below, found[2:]
        if under < rank <= to_low:
            return found["low"]
        if to_high < rank <= upto:
            return found["high"]
        if rank <= under:
            own, left = own.filter(F.col("v") < low), under
        elif rank > upto:
            own, left, below = own.filter(F.col("v") > high), left - upto, below + upto
        else:
            own, left, below = own.filter((F.col("v") > low) & (F.col("v") < high)), to_high - to_low, below + to_low
    return own.orderBy("v").limit(k - below).agg(F.max("v")).first()[0]


def few_values(df: DataFrame, column: str, few: int = 10_000) -> list[tuple] | None:
    """(value, count) of all non-null values in order, from one pass over ``df``; None where more than ``few`` differ."""
    own = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).limit(few + 1).collect()
    return sorted((r["v"], r["n"]) for r in own) if len(own) <= few else None


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a column's non-null values, the mean of both middle ones of an even number; null without any."""
    n = df.filter(F.col(column).isNotNull()).count()
    if not n:
        return None
    low = nth_smallest(df, column, (n + 1) // 2)
    return float(low) if n % 2 else (float(low) + float(nth_smallest(df, column, n // 2 + 1))) / 2
