"""Channels of the windows around a candidate's two ends: sparse counts by channel and offset.

A window row is ``4 * expand + gap`` wide: the left window, a gap, the right window. Rows are
0 depth, 1 to 21 events, 22 to 29 orphaned events (code plus 8), 30 to 34 bases A, C, T, G, N.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import calls, cigar
from lociflow.operators.basestore import with_text
from lociflow.operators.ranges import overlap, point_in_interval

CHANNELS = 35
DISCORDANT = [18, 19, 20, 21]


def event_hits(cands: DataFrame, events: DataFrame, expand: int = 62, scales: tuple[int, ...] = (0, 3), scale: Column | None = None) -> DataFrame:
    """(sv_id, side, which, off, event, n): events in reach of a candidate, all kinds in one range join.

    Two-position events are looked up by their first end on the left and by their second on the
    right; ``which`` is ``shared`` where both ends are in reach of their sides, on the chromosome;
    else ``left`` or ``right``. One-position events (null second place) count on each side that sees
    them. ``off`` counts from the side's own end, in units of ``2 ** scale`` bases: by default that is
    3 for discordant pairs and 0 for others. Equal events are counted first, so hot spots join once.
    ``cands`` has sv_id, chrom, l, r.
    """
    scale = F.when(F.col("event").isin(DISCORDANT), 3).otherwise(0) if scale is None else scale
    scaled = lambda c: F.expr(f"shiftright({c}, scale)")
    ev = events.withColumn("scale", scale).withColumn("a_pos", scaled("a_pos")).withColumn("b_pos", scaled("b_pos")).groupBy("a_chrom", "a_pos", "b_chrom", "b_pos", "event", "scale").agg(F.count("*").alias("n"))
    ends = F.array(F.struct(F.lit("left").alias("end"), F.col("a_chrom").alias("e_chrom"), F.col("a_pos").alias("e_pos")), F.struct(F.lit("right").alias("end"), F.coalesce("b_chrom", "a_chrom").alias("e_chrom"), F.coalesce("b_pos", "a_pos").alias("e_pos")))
    points = ev.withColumn("x", F.explode(ends)).select("a_chrom", "a_pos", "b_chrom", "b_pos", "event", "n", F.col("scale").alias("e_scale"), "x.*")
    at = cands.select("sv_id", "chrom", "l", "r", F.explode(F.array(*(F.lit(s) for s in scales))).alias("scale")).select("sv_id", "chrom", "scale", scaled("l").alias("l"), scaled("r").alias("r"))
    sides = at.select("*", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("l").alias("at")), F.struct(F.lit("right").alias("side"), F.col("r").alias("at")))).alias("x")).select("sv_id", "chrom", "scale", "l", "r", "x.side", (F.col("x.at") - expand).alias("lo"), (F.col("x.at") + expand + 1).alias("hi"))
    met = point_in_interval(points, sides, "e_pos", "lo", "hi", [("e_chrom", "chrom"), ("e_scale", "scale"), ("end", "side")], 4 * expand, longest=2 * expand + 1)
    one = F.col("b_pos").isNull()
    near_a = F.col("a_pos").between(F.col("l") - expand, F.col("l") + expand) & (F.col("a_chrom") == F.col("chrom"))
    near_b = F.col("b_pos").between(F.col("r") - expand, F.col("r") + expand) & (F.col("b_chrom") == F.col("chrom"))
    x, y = F.col("a_pos") - F.col("l"), F.col("b_pos") - F.col("r")
    hit = lambda side, which, off: F.struct(F.lit(side).alias("side"), F.lit(which).alias("which"), off.alias("off"))
    left = F.when(one, F.array(hit("left", "left", x))).when(near_b, F.array(hit("left", "shared", x), hit("right", "shared", y))).otherwise(F.array(hit("left", "left", x)))
    right = F.when(one, F.array(hit("right", "right", F.col("a_pos") - F.col("r")))).when(~near_a, F.array(hit("right", "right", y)))
    return met.select("sv_id", F.explode(F.when(F.col("side") == "left", left).otherwise(right)).alias("x"), "event", "n").select("sv_id", "x.side", "x.which", "x.off", "event", "n")


def window_hits(cands: DataFrame, signals2d: DataFrame, expand: int = 62, shift: int = 0) -> DataFrame:
    """(sv_id, side, which, off, event, n) of two-position events, as ``event_hits``, all in units of ``2 ** shift`` bases."""
    return event_hits(cands, signals2d, expand, (shift,), F.lit(shift))


def hits_1d(cands: DataFrame, signals1d: DataFrame, expand: int = 62) -> DataFrame:
    """(sv_id, side, which, off, event, n): one-position events, on both sides where windows overlap."""
    width = 4 * expand
    bin_of = lambda p: F.floor(p / width)
    # Events are dealt out by bin, which serves their counts and the join alike; a window of known length touches two bins at most.
    own = signals1d.select("chrom", "pos", "event", bin_of(F.col("pos")).alias("bin")).repartition("chrom", "bin").groupBy("chrom", "bin", "pos", "event").agg(F.count("*").alias("n"))
    sides = cands.select("sv_id", F.col("chrom").alias("c_chrom"), F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("l").alias("at")), F.struct(F.lit("right").alias("side"), F.col("r").alias("at")))).alias("x")).select("sv_id", "c_chrom", "x.side", "x.at")
    sides = sides.withColumn("c_bin", F.explode(F.sequence(bin_of(F.col("at") - expand), bin_of(F.col("at") + expand))))
    met = own.hint("merge").join(sides.hint("merge"), (F.col("chrom") == F.col("c_chrom")) & (F.col("bin") == F.col("c_bin")) & F.col("pos").between(F.col("at") - expand, F.col("at") + expand))
    return met.select("sv_id", "side", F.col("side").alias("which"), (F.col("pos") - F.col("at")).alias("off"), "event", "n")


def orphan_channel(event: Column, which: Column) -> Column:
    """Event code, or code plus 8 for orphanable events that only one side sees."""
    return F.when((which != "shared") & cigar.event_is_orphanable(event), event + 8).otherwise(event)


def place(hits: DataFrame, expand: int = 62, gap: int = 8, compat: bool = False) -> DataFrame:
    """(sv_id, channel, offset, value): hits at their window columns, counted.

    An event at the far border of its window has no column there and is left out; with
    ``compat`` the left one lands in the first gap column.
    """
    return placed(hits, expand, gap, compat).groupBy("sv_id", "channel", "offset").agg(F.sum("value").alias("value"))


def placed(hits: DataFrame, expand: int = 62, gap: int = 8, compat: bool = False) -> DataFrame:
    """``place`` before cells are summed up, for who sums them up further."""
    base = F.when(F.col("side") == "left", expand).otherwise(3 * expand + gap)
    off = F.col("off") + base
    inside = off.between(0, 4 * expand + gap - 1)
    if not compat:
        inside = inside & F.when(F.col("side") == "left", off < 2 * expand).otherwise(off >= 2 * expand + gap)
    return hits.filter(inside).select("sv_id", orphan_channel(F.col("event"), F.col("which")).cast("int").alias("channel"), off.cast("int").alias("offset"), F.col("n").alias("value"))


def _sides(cands: DataFrame, expand: int, gap: int) -> DataFrame:
    """(sv_id, chrom, lo, hi, to): the half-open span of each side and the column of its first base."""
    rows = F.array(F.struct((F.col("l") - expand).alias("lo"), (F.col("l") + expand).alias("hi"), F.lit(0).alias("to")), F.struct((F.col("r") - expand).alias("lo"), (F.col("r") + expand).alias("hi"), F.lit(2 * expand + gap).alias("to")))
    return cands.select("sv_id", F.col("chrom").alias("c_chrom"), F.explode(rows).alias("x")).select("sv_id", "c_chrom", "x.*")


def window_runs(cands: DataFrame, runs: DataFrame, columns: list[str], half: int = 62, gap: int = 8) -> DataFrame:
    """(sv_id, first, last, columns): a run-length table (chrom, s, e, columns) cut at both windows, as stretches of offsets, both ends included."""
    met = overlap(_sides(cands, half, gap), runs.select("chrom", "s", "e", *columns), ("lo", "hi"), ("s", "e"), [("c_chrom", "chrom")], 4 * half, (2 * half, None))
    at = lambda p: (p - F.col("lo") + F.col("to")).cast("int")
    return met.select("sv_id", at(F.greatest("lo", "s")).alias("first"), at(F.least("hi", "e") - 1).alias("last"), *columns)


def depth_runs(cands: DataFrame, runs: DataFrame, expand: int = 62, gap: int = 8) -> DataFrame:
    """(sv_id, channel, first, last, value): ``window_depth`` with a row for each stretch of equal depth."""
    own = window_runs(cands, runs, ["depth"], expand, gap)
    return own.select("sv_id", F.lit(0).alias("channel"), "first", "last", F.col("depth").cast("bigint").alias("value"))


def spread_runs(runs: DataFrame) -> DataFrame:
    """The cells of stretches: ``offset`` in the place of ``first`` and ``last``."""
    each = runs.withColumn("offset", F.explode(F.sequence("first", "last")))
    return each.select(*("offset" if c == "first" else c for c in runs.columns if c != "last"))


def window_depth(cands: DataFrame, runs: DataFrame, expand: int = 62, gap: int = 8) -> DataFrame:
    """Channel 0: depth under both windows, from run-length depth (chrom, s, e, depth); zeros left out."""
    return spread_runs(depth_runs(cands, runs, expand, gap))


def window_one_hot(cands: DataFrame, store: DataFrame, expand: int = 62, gap: int = 8) -> DataFrame:
    """Channels 30 to 34: bases under both windows, cut from a base store; one join row a window."""
    text = with_text(_sides(cands, expand, gap), store, "c_chrom", "lo", "hi", "text")
    each = text.select("sv_id", "to", F.posexplode(F.split(F.upper("text"), "")).alias("i", "base"))
    row = F.expr(f"instr('{calls.PACKAGE_BASES}', base)")
    return each.filter(row > 0).select("sv_id", (row + 29).cast("int").alias("channel"), (F.col("i") + F.col("to")).cast("int").alias("offset"), F.lit(1).cast("bigint").alias("value"))


def channels(cands: DataFrame, events: DataFrame, runs: DataFrame, store: DataFrame, expand: int = 62, gap: int = 8, compat: bool = False) -> DataFrame:
    """The sparse tensor (sv_id, channel, offset, value) of all candidates from events of all kinds, depth runs and a base store."""
    return place(event_hits(cands, events, expand), expand, gap, compat).unionByName(window_depth(cands, runs, expand, gap)).unionByName(window_one_hot(cands, store, expand, gap))


def stretches(cands: DataFrame, events: DataFrame, runs: DataFrame, store: DataFrame, expand: int = 62, gap: int = 8, compat: bool = False) -> DataFrame:
    """(sv_id, channel, first, last, value, text): what ``channels`` holds, without a row for each cell.

    Depth comes as stretches of equal value, events as stretches of one cell, and bases as a window's ``text`` from the cell
    ``first`` on (null channel). Values of a cell add up.
    """
    none = lambda kind: F.lit(None).cast(kind)
    hits = placed(event_hits(cands, events, expand), expand, gap, compat).select("sv_id", "channel", F.col("offset").alias("first"), F.col("offset").alias("last"), F.col("value").cast("bigint").alias("value"), none("string").alias("text"))
    depth = depth_runs(cands, runs, expand, gap).select("sv_id", "channel", "first", "last", "value", none("string").alias("text"))
    bases = with_text(_sides(cands, expand, gap), store, "c_chrom", "lo", "hi", "text").select("sv_id", none("int").alias("channel"), F.col("to").cast("int").alias("first"), none("int").alias("last"), none("bigint").alias("value"), F.upper("text").alias("text"))
    return hits.unionByName(depth).unionByName(bases)


#: Candidates whose tensors are laid out together in a task.
LAID_OUT = 64
_BASE_ROW = np.zeros(256, np.int64)
_BASE_ROW[np.frombuffer(calls.PACKAGE_BASES.encode(), np.uint8)] = np.arange(30, 30 + len(calls.PACKAGE_BASES))


def _laid_out(rows: pa.RecordBatch, n: int, at: np.ndarray, width: int) -> np.ndarray:
    """Tensors (n, channels, width) of stretches, of which the ``at``-th tensor has each."""
    tensors = np.zeros((n, CHANNELS, width + 1), np.int64)
    column = lambda c: rows.column(c).fill_null(0).to_numpy(zero_copy_only=False)
    channel, first, last, value = (column(c) for c in ("channel", "first", "last", "value"))
    plain = np.flatnonzero(rows.column("channel").is_valid().to_numpy(zero_copy_only=False))
    np.add.at(tensors, (at[plain], channel[plain], first[plain]), value[plain])
    np.add.at(tensors, (at[plain], channel[plain], last[plain] + 1), -value[plain])
    tensors = np.cumsum(tensors, axis=2)[:, :, :width]
    texts = rows.column("text")
    with_text = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
    if len(with_text):
        own = [t.encode("latin-1", "replace") for t in texts.take(pa.array(with_text)).to_pylist()]
        size = np.array([len(t) for t in own])
        row = _BASE_ROW[np.frombuffer(b"".join(own), np.uint8)]
        cell = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[with_text], size)
        known = row > 0
        np.add.at(tensors, (np.repeat(at[with_text], size)[known], row[known], cell[known]), 1)
    if tensors.max(initial=0) > np.iinfo(np.int32).max:
        raise ValueError("a cell is over 32 bits")
    return tensors.astype(np.int32)


def _by_candidate(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by candidate, whole candidates at a time: each one's first row, and their tensors."""
    held: list[pa.RecordBatch] = []
    for batch in _with_end(batches):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            held.append(batch)
        if not held or (batch is not None and sum(b.num_rows for b in held) < 1 << 12):
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = rows.column("sv_id").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        # The last candidate may go on in the next batch.
        whole, end = (len(starts), len(ids)) if batch is None else (len(starts) - 1, starts[-1])
        held = [] if batch is None else [rows.slice(end)]
        for a in range(0, whole, LAID_OUT):
            own = starts[a : min(a + LAID_OUT, whole)]
            stop = end if a + LAID_OUT >= whole else starts[a + LAID_OUT]
            at = np.repeat(np.arange(len(own)), np.diff([*own, stop]))
            yield rows.take(pa.array(own)), _laid_out(rows.slice(own[0], stop - own[0]), len(own), at, width)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def tensors(parts_of: DataFrame, keep: list[str] = [], width: int = 256, parts: int | None = None, packed: bool = False) -> DataFrame:
    """(sv_id, keep, tensor): ``dense`` of all candidates of ``stretches``, of which ``keep`` are more columns, equal for a candidate's rows.

    Stretches are dealt out by candidate once, in ``parts`` partitions, and laid out by numpy for a few candidates at a time. With
    ``packed`` a tensor is binary: its 32-bit little-endian numbers, row by row, in zlib's format (``unpacked`` gives them back).
    """
    import zlib

    own = parts_of.select("sv_id", *keep, "channel", "first", "last", "value", "text")
    own = (own.repartition("sv_id") if parts is None else own.repartition(parts, "sv_id")).sortWithinPartitions("sv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for firsts, laid in _by_candidate(batches, width):
            if packed:
                out = pa.array([zlib.compress(t.astype("<i4").tobytes(), 1) for t in laid], pa.binary())
            else:
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, laid.size + 1, width, dtype=np.int32)), pa.array(laid.ravel()))
                out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(laid) * CHANNELS + 1, CHANNELS, dtype=np.int32)), rows)
            yield pa.RecordBatch.from_arrays([*(firsts.column(c) for c in ("sv_id", *keep)), out], names=["sv_id", *keep, "tensor"])

    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("sv_id", *keep))
    return own.mapInArrow(run, f"{kinds}, tensor {'binary' if packed else 'array<array<int>>'}")


def tensor_sums(tensors: DataFrame, keep: list[str], width: int = 256) -> DataFrame:
    """(keep, channel, total, weighted): of each row of each tensor, as arrays or packed, the sum and the sum weighted by place from 1; rows without anything are left out."""
    import zlib

    packed = tensors.schema["tensor"].dataType.simpleString() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(1, width + 1)
        for batch in batches:
            for a in range(0, batch.num_rows, LAID_OUT):
                own = batch.slice(a, LAID_OUT)
                column = own.column("tensor")
                if packed:
                    cells = np.frombuffer(b"".join(zlib.decompress(t) for t in column.to_pylist()), "<i4")
                else:
                    cells = column.flatten().flatten().to_numpy(zero_copy_only=False)
                cells = cells.reshape(own.num_rows, -1, width).astype(np.int64)
                total, weighted = cells.sum(2), cells @ place
                i, channel = np.nonzero(total > 0)
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([*(own.column(c).take(at) for c in keep), pa.array(channel.astype(np.int32)), pa.array(total[i, channel]), pa.array(weighted[i, channel])], names=[*keep, "channel", "total", "weighted"])

    kinds = ", ".join(f"{c} {tensors.schema[c].dataType.simpleString()}" for c in keep)
    return tensors.select(*keep, "tensor").mapInArrow(run, f"{kinds}, channel int, total bigint, weighted bigint")


def dense(sparse: DataFrame, rows: int = CHANNELS, width: int = 256) -> DataFrame:
    """(sv_id, tensor): each candidate's rows as arrays, missing cells zero.

    Cells are sorted and the gaps between them filled with runs of zeros, in one pass.
    """
    cells = F.sort_array(F.collect_list(F.struct((F.col("channel") * width + F.col("offset")).alias("k"), F.col("value").cast("int").alias("v"))))
    last = F.array(F.struct(F.lit(rows * width).alias("k"), F.lit(0).alias("v")))
    filled = sparse.groupBy("sv_id").agg(F.concat(cells, last).alias("m"))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("m", i - 1)["k"])
    flat = F.flatten(F.transform("m", lambda x, i: F.concat(F.array_repeat(F.lit(0), x["k"] - before(i) - 1), F.array(x["v"]))))
    cut = lambda whole: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda c: F.slice(whole, c * width + 1, width))
    # Through an array of one element, so that the cells are laid out once and not again for each row cut from them.
    return filled.select("sv_id", F.get(F.transform(F.array(flat), cut), F.lit(0)).alias("tensor"))


def pair_slice(cands: DataFrame, segments: DataFrame, columns: list[str], half: int = 100, pad: int = 10) -> DataFrame:
    """(sv_id, offset, columns): a run-length table (chrom, s, e, columns) cut at both ends, zero padding between and where it has no row.

    Windows meet segments whole; only what lies under a window becomes a row for each position. Sums of
    cells need no such rows: ``window_runs`` gives the stretches.
    """
    cells = spread_runs(window_runs(cands, segments, columns, half, pad))
    empty = cands.select("sv_id", F.explode(F.sequence(F.lit(0), F.lit(4 * half + pad - 1))).alias("offset"))
    return cells.unionByName(empty, allowMissingColumns=True).groupBy("sv_id", "offset").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns))


def augment(cands: DataFrame, longest: int = 20, seed: int = 0) -> DataFrame:
    """Each candidate, an outward and an inward copy (copy 0, 1, -1), moved 1 to ``longest`` bases by a hash of its id."""
    move = F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col("sv_id").cast("string"), F.col("copy").cast("string")).cast("binary")), F.lit(longest)) + 1
    each = cands.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(-1)))).withColumn("move", F.col("copy") * move)
    return each.withColumn("l", F.col("l") - F.col("move")).withColumn("r", F.col("r") + F.col("move")).drop("move").filter("l <= r")


def shift_discordant(sparse: DataFrame, shift: int, expand: int = 62, gap: int = 8) -> DataFrame:
    """Discordant rows moved outwards: left in the left window, right in the right one; what leaves is dropped."""
    row = F.col("channel").isin(*DISCORDANT, *(c + 8 for c in DISCORDANT))
    left = F.col("offset") < 2 * expand
    moved = F.when(~row, F.col("offset")).when(left, F.col("offset") - shift).otherwise(F.col("offset") + shift)
    return sparse.withColumn("offset", moved.cast("int")).filter((F.col("offset") >= 0) & (F.col("offset") < 4 * expand + gap))


def min_max(sparse: DataFrame, width: int = 256) -> DataFrame:
    """``scaled``: each channel of each candidate to 0..1; cells that are missing count as zero."""
    own = sparse.groupBy("sv_id", "channel").agg(F.min("value").alias("__a"), F.max("value").alias("__b"), F.count("*").alias("__n"))
    met = sparse.join(own, ["sv_id", "channel"])
    lo, hi = _with_missing(F.col("__a"), F.col("__b"), F.col("__n"), width)
    return met.select("sv_id", "channel", "offset", F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(0.0).alias("scaled"))


def _with_missing(least: Column, most: Column, n: Column, width: int) -> tuple[Column, Column]:
    """Least and largest value of a channel, of which ``n`` of ``width`` cells are there and the others are zero."""
    return F.when(n < width, F.least(least, F.lit(0))).otherwise(least), F.when(n < width, F.greatest(most, F.lit(0))).otherwise(most)


def min_max_sums(runs: DataFrame, width: int = 256) -> DataFrame:
    """(sv_id, channel, n, low, high, total): count, least, largest and sum of what ``min_max`` gives for the cells of ``runs``.

    Scaling keeps the order of values and is linear, so all come from one grouping of the stretches.
    """
    n = F.col("last") - F.col("first") + 1
    own = runs.groupBy("sv_id", "channel").agg(F.sum(n).alias("n"), F.min("value").alias("a"), F.max("value").alias("b"), F.sum(F.col("value") * n).alias("t"))
    lo, hi = _with_missing(F.col("a"), F.col("b"), F.col("n"), width)
    scaled = lambda x, k: F.when(hi > lo, (x - lo * k) / (hi - lo)).otherwise(0.0)
    return own.select("sv_id", "channel", "n", scaled(F.col("a"), 1).alias("low"), scaled(F.col("b"), 1).alias("high"), scaled(F.col("t"), F.col("n")).alias("total"))


def _meet(spans: DataFrame, cands: DataFrame, half: int, parts: int | None, columns: list[Column | str] = ["*"]) -> DataFrame:
    """Rows of ``spans`` (qname, r_chrom, s, e, ...) over one window whose names also occur over the other, with sv_id, lo, hi and side.

    A read goes to the bins that it covers and a window to its own, two at most; a pair is kept in the later start's. Rows that met are
    dealt out by candidate once (in ``parts`` partitions) with what ``columns`` makes of them, for the names and for who counts by candidate.
    """
    width = 8 * half
    sides = _sides(cands, half, 0).select("sv_id", "c_chrom", "lo", "hi", F.when(F.col("to") == 0, "left").otherwise("right").alias("side"))
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))
    own, at = spans.filter("e > s").withColumn("__bin", bins("s", "e")), sides.withColumn("__at", bins("lo", "hi"))
    cond = (F.col("r_chrom") == F.col("c_chrom")) & (F.col("__bin") == F.col("__at")) & (F.col("s") < F.col("hi")) & (F.col("lo") < F.col("e")) & (F.col("__bin") == F.floor(F.greatest("s", "lo") / width))
    met = own.hint("merge").join(at.hint("merge"), cond).drop("__bin", "__at", "c_chrom").select(*columns)
    met = met.repartition("sv_id") if parts is None else met.repartition(parts, "sv_id")
    name = Window.partitionBy("sv_id", "qname")  # a few reads
    return met.withColumn("__both", F.min("side").over(name) < F.max("side").over(name)).filter("__both").drop("__both")


def common_reads(reads: DataFrame, cands: DataFrame, half: int = 62, parts: int | None = None) -> DataFrame:
    """(sv_id, side, qname, ...): reads over one window whose names also occur over the other; ``parts`` gives the partitions of what met."""
    spans = reads.withColumn("s", F.col("pos0")).withColumn("e", cigar.cigar_ref_end("pos0", "cigar")).withColumnRenamed("chrom", "r_chrom")
    return _meet(spans, cands, half, parts)


#: Kinds of reads by strand, kind and clip, and kinds of pairs, by the numbers that stand for them.
READ_KINDS = [f"{strand}_{kind}_{clip}" for strand in "FR" for kind in ("AR", "CR", "SR") for clip in "NLRB"]
PAIR_KINDS = ["TRA_S", "TRA_O", "INV_A", "INV_B", "DUP_A", "DUP_B", "DR_R", "DR_F"]


def read_channels(reads: DataFrame, cands: DataFrame, half: int = 62, parts: int | None = None) -> DataFrame:
    """(sv_id, side, channel, pos, n): kinds of the reads that both windows share, by position.

    Kinds are strand by any, split and clipped reads and clip side, and the pair kinds DR, DUP,
    INV and TRA. A clipped read counts at its clipped end, another over its whole span.

    Reads meet windows with a number for their kinds. Positions are counted as running sums of the stretches' ends by candidate,
    where the rows lie already, and become rows at the very end. ``parts`` is as in ``common_reads``.
    """
    rev, mate_rev = cigar.flag_has("flag", cigar.REVERSE), cigar.flag_has("flag", cigar.MATE_REVERSE)
    lc, rc = cigar.is_left_clipped("cigar"), cigar.is_right_clipped("cigar")
    clip = F.when(lc & rc, 3).when(lc, 1).when(rc, 2).otherwise(0)
    kind = F.when(F.col("sa").isNotNull(), 2).when(lc | rc, 1).otherwise(0)
    same, later, earlier = F.col("chrom") == F.col("next_chrom"), F.col("next_pos0") > F.col("pos0"), F.col("next_pos0") < F.col("pos0")
    pair = (
        F.when(~same, F.when(rev == mate_rev, "TRA_S").otherwise("TRA_O")).when(rev == mate_rev, F.when(later, "INV_A").otherwise("INV_B"))
        .when(rev & later, "DUP_A").when(~rev & earlier, "DUP_B")
        .when(~cigar.flag_has("flag", cigar.PROPER), F.when(rev, "DR_R").otherwise("DR_F"))
    )
    own_kind = F.when(rev, 12).otherwise(0) + kind * 4 + clip
    pair_kind = F.coalesce(F.array_position(F.array(*map(F.lit, PAIR_KINDS)), pair), F.lit(0)).cast("int")
    spans = reads.select("qname", F.col("chrom").alias("r_chrom"), F.col("pos0").alias("s"), cigar.cigar_ref_end("pos0", "cigar").alias("e"), (own_kind * 16 + pair_kind).cast("smallint").alias("kinds"))
    own_kind, pair_kind = F.shiftright("kinds", 4), F.col("kinds").bitwiseAND(F.lit(15).cast("smallint")).cast("int")
    clip = own_kind % 4
    first = F.when(clip == 2, F.col("e")).otherwise(F.col("s"))
    last = F.when(clip == 0, F.col("e")).otherwise(first + 1)
    kinds = F.when(pair_kind > 0, F.array(own_kind, len(READ_KINDS) - 1 + pair_kind)).otherwise(F.array(own_kind))
    cut_first, cut_last = F.greatest("lo", first), F.least("hi", last)
    own = _meet(spans, cands, half, parts, ["sv_id", "side", "qname", "kinds", cut_first.alias("first"), F.greatest(cut_last - cut_first, F.lit(0)).cast("int").alias("bases")])
    cut = own.filter("bases > 0").select("sv_id", "side", kinds.alias("kinds"), "first", (F.col("first") + F.col("bases")).alias("last"))
    ends = cut.select("sv_id", "side", F.explode("kinds").alias("kind"), F.array(F.struct(F.col("first").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("last").alias("pos"), F.lit(-1).alias("d"))).alias("x"))
    by = ["sv_id", "side", "kind"]
    steps = ends.select(*by, F.explode("x").alias("x")).groupBy(*by, F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d")).filter("d <> 0")
    over = Window.partitionBy(*by).orderBy("pos")
    runs = steps.select(*by, "pos", F.sum("d").over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.lead("pos").over(over).alias("to")).filter("n <> 0")
    names = F.array(*map(F.lit, READ_KINDS + PAIR_KINDS))
    return runs.select("sv_id", "side", F.get(names, F.col("kind")).alias("channel"), F.explode(F.sequence("pos", F.col("to") - 1)).alias("pos"), "n")
