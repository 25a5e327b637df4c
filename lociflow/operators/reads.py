"""Reads: filters, mate pairing, depth and insert sizes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import cigar as C
from lociflow.operators.basestore import WIDTH
from lociflow.operators.ranges import exact_median, few_values, nth_smallest, steps


def drop_failed(reads: DataFrame) -> DataFrame:
    """Without QC-failed, duplicate, secondary and supplementary reads."""
    return reads.filter(~C.flag_has("flag", C.FAIL))


def min_mapq(reads: DataFrame, least: int = 10) -> DataFrame:
    """Mapped reads of at least this mapping quality."""
    return reads.filter(~C.flag_has("flag", C.UNMAPPED) & (F.col("mapq") >= least))


def pair_mates(reads: DataFrame, name: str = "qname") -> DataFrame:
    """Pairs (qname, pair, a, b) of reads that follow each other by ``ord`` under one name.

    Reads 2k-1 and 2k make pair k; a last odd read has no mate and gives no row. Failed reads
    are dropped before. ``a`` and ``b`` are structs of the read's columns.
    """
    ok = drop_failed(reads)
    own = F.struct(*(F.col(c) for c in reads.columns))
    w = Window.partitionBy(name).orderBy("ord")
    dealt = ok.withColumn("__n", F.row_number().over(w)).withColumn("__b", F.lead(own).over(w)).withColumn("__a", own)
    return dealt.filter((F.col("__n") % 2 == 1) & F.col("__b").isNotNull()).select(name, ((F.col("__n") + 1) / 2).cast("bigint").alias("pair"), F.col("__a").alias("a"), F.col("__b").alias("b"))


def clipped_with_later_mate(reads: DataFrame) -> DataFrame:
    """Clipped reads beside their mate, found by name and the mate's place, that comes later in the file."""
    a = reads.filter(C.is_clipped("cigar"))
    b = reads.select(F.col("qname").alias("m_qname"), F.col("chrom").alias("m_chrom"), F.col("pos0").alias("m_pos0"), F.col("ord").alias("m_ord"), F.col("flag").alias("m_flag"))
    return a.join(b, (a["qname"] == b["m_qname"]) & (a["next_chrom"] == b["m_chrom"]) & (a["next_pos0"] == b["m_pos0"]) & (b["m_ord"] > a["ord"]))


def _changes(reads: DataFrame, least: int = 10) -> DataFrame:
    """(chrom, pos, d): +1 at each aligned block's start, -1 at its last base."""
    blocks = min_mapq(drop_failed(reads), least).select("chrom", F.explode(C.aligned_blocks("cigar", "pos0")).alias("b"))
    ends = blocks.select("chrom", F.explode(F.array(F.struct(F.col("b.s").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("b.e") - 1).alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    return ends.select("chrom", "x.pos", "x.d")


def depth_changes(reads: DataFrame, least: int = 10) -> DataFrame:
    """(chrom, pos, delta): +1 at each aligned block's start, -1 at its last base, which stays uncovered."""
    return _changes(reads, least).groupBy("chrom", "pos").agg(F.sum("d").alias("delta")).filter("delta <> 0")


def depth(reads: DataFrame, least: int = 10, parts: int | None = None) -> DataFrame:
    """Run-length depth (chrom, s, e, depth), runs of zero left out; ``parts`` as in ``steps``."""
    runs = steps(_changes(reads, least), "d", "depth", "e", parts=parts)
    return runs.filter("depth <> 0 and e is not null").select("chrom", F.col("pos").alias("s"), "e", F.col("depth").cast("bigint").alias("depth"))


def dense_depth(runs: DataFrame) -> DataFrame:
    """(chrom, pos, depth) for each covered position."""
    return runs.select("chrom", F.explode(F.expr("sequence(s, e - 1)")).alias("pos"), "depth")


def insert_size_percentile(reads: DataFrame, p: float = 0.995, least: int = 30, skip: int = 400_000, take: int = 300_000, large: int | None = None, compat: bool = False) -> DataFrame:
    """One row (n, insert_size): the element of that rank, not interpolated.

    First reads of a pair on one chromosome and opposite strands, with good quality, all of them.
    Only with ``large`` set, and where there are more, the first ``skip`` by file order are left
    out and ``take`` are used.
    """
    own = min_mapq(drop_failed(reads), least).filter(C.flag_has("flag", C.READ1) & C.flag_has("flag", C.PAIRED) & (F.col("chrom") == F.col("next_chrom")))
    rev, mate = C.flag_has("flag", C.REVERSE), C.flag_has("flag", C.MATE_REVERSE)
    own = own.filter(rev | mate) if compat else own.filter(rev != mate)
    if large is not None and own.count() > large:
        own = own.orderBy("ord").offset(skip).limit(take)
    sizes = own.select(F.abs("tlen").cast("bigint").alias("size"))
    counts = few_values(sizes, "size")  # sizes repeat: one pass, one row for each different size
    n = sizes.filter("size is not null").count() if counts is None else sum(c for _, c in counts)
    rank = max(1, int(n * p))
    if counts is None:
        found = [(n, nth_smallest(sizes, "size", rank))]
    else:
        upto = accumulate(c for _, c in counts)
        found = [(n, v) for (v, _), to in zip(counts, upto) if to >= rank][:1]
    return reads.sparkSession.createDataFrame(found, "n bigint, insert_size bigint")


def insert_size_stats(reads: DataFrame, longest: int = 1000, first: int | None = None) -> DataFrame:
    """One row (mean, sd) of mate distances below ``longest`` on opposite strands, over all reads or the ``first`` ones by file order."""
    rev, mate = C.flag_has("flag", C.REVERSE), C.flag_has("flag", C.MATE_REVERSE)
    own = reads.filter((F.col("chrom") == F.col("next_chrom")) & (rev != mate)).withColumn("d", F.abs(F.col("pos0") - F.col("next_pos0"))).filter(F.col("d") < longest)
    own = own if first is None else own.orderBy("ord").limit(first)
    return own.agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))


def position_counts(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def support_histogram(counts: DataFrame, upto: int = 5, n: str = "n") -> DataFrame:
    """(k, positions): positions with at least k reads."""
    wide = counts.agg(*(F.count_if(F.col(n) >= k).alias(str(k)) for k in range(1, upto + 1)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("positions")) for k in range(1, upto + 1)))).alias("x")).select("x.k", "x.positions")


def _median(counts: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, median) of each column of a table of counts by value, of which the first row stands for ``low``; NaN without any."""
    n = counts.sum(axis=0)
    upto, low_rank, high_rank = np.zeros_like(n), (n + 1) // 2, n // 2 + 1
    behind = np.zeros(len(n))  # values below the lower and the upper middle one, together
    for row in counts:
        upto += row
        behind += upto < low_rank
        behind += upto < high_rank
    return n, np.where(n > 0, low + behind / 2, np.nan)


#: Bases of a chunk that are held to be sorted; beyond, they are counted by value and place in tables of fixed size.
HELD = 1 << 20
_BASES = np.zeros(256, bool)
_BASES[np.frombuffer(b"ACGT", np.uint8)] = True


class _Chunk:
    """Values and places of the bases over one chunk; its size does not depend on the depth."""

    def __init__(self, chrom: str, chunk: int, width: int):
        self.key, self.width = (chrom, chunk), width
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_held = 0
        self.tables: tuple[np.ndarray, np.ndarray] | None = None
        self.used: dict[int, tuple[int, int]] = {}
        self.odd = np.zeros(width, np.int64)
        self.refs = np.full(width, 32, np.uint8)

    def add(self, at: np.ndarray, bases: np.ndarray, quals: np.ndarray, mapqs: np.ndarray) -> None:
        """Bases with their places in the chunk, qualities with their offset, and mapping qualities, -1 where there is none."""
        self.held.append((at, quals, mapqs))
        self.n_held += len(at)
        ref = self.refs[at]
        odd = _BASES[bases] & (bases != ref) & (ref != 32) & (ref != ord("N"))
        self.odd += np.bincount(at[odd], minlength=self.width)
        if self.n_held > HELD:
            self._count()

    def _count(self) -> None:
        """What is held goes into the tables."""
        if self.tables is None:
            self.tables = np.zeros((256, self.width), np.int64), np.zeros((256, self.width), np.int64)
        at, quals, mapqs = map(np.concatenate, zip(*self.held))
        self.held, self.n_held = [], 0
        for i, values in enumerate((quals, mapqs)):
            known = values >= 0
            values, places = values[known].astype(np.int64), at[known]
            if len(values):
                low, high = int(values.min()), int(values.max())
                first, last = self.used.get(i, (low, high))
                self.used[i] = min(low, first), max(high, last)
                self.tables[i][low : high + 1] += np.bincount((values - low) * self.width + places, minlength=(high - low + 1) * self.width).reshape(-1, self.width)

    def _sorted(self, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, median) by place, NaN without any; values are of one byte."""
        n = np.bincount(at, minlength=self.width)
        own = np.sort((at << 8 | values).astype(np.int32)) & 255
        some, start = n > 0, np.cumsum(n) - n
        low, high = (start + (n - 1) // 2)[some], (start + n // 2)[some]
        out = np.full(self.width, np.nan)
        out[some] = (own[low] + own[high]) / 2
        return n, out

    def medians(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, quality, mapping quality) by place."""
        if self.tables is not None:
            if self.held:
                self._count()
            (n, bq), (_, mapq) = (_median(t[f : last + 1], f) for t, (f, last) in ((t, self.used.get(i, (0, 0))) for i, t in enumerate(self.tables)))
        elif self.held:
            at, quals, mapqs = map(np.concatenate, zip(*self.held))
            known = mapqs >= 0
            (n, bq), (_, mapq) = self._sorted(at, quals), self._sorted(at[known], mapqs[known])
        else:
            n, bq, mapq = np.zeros(self.width, np.int64), np.full(self.width, np.nan), np.full(self.width, np.nan)
        return n, bq - 33, mapq

    def packed(self) -> pa.RecordBatch:
        n, bq, mapq = self.medians()
        chrom, chunk = self.key
        odd = np.where(n > 0, self.odd / np.maximum(n, 1), np.nan)
        return pa.RecordBatch.from_arrays([pa.array([chrom], pa.string()), pa.array([chunk], pa.int64()), *(pa.array([x], pa.list_(pa.float64())) for x in (bq, odd, mapq))], names=["chrom", "chunk", "bq", "fraction", "mapq"])

    def rows(self) -> pa.RecordBatch:
        n, bq, mapq = self.medians()
        at = np.flatnonzero(n)
        chrom, chunk = self.key
        found = [pa.repeat(pa.scalar(chrom, pa.string()), len(at)), pa.array(chunk * self.width + at, pa.int64()), pa.array(n[at]), pa.array(bq[at]), pa.array(mapq[at], mask=np.isnan(mapq[at])), pa.array(self.odd[at] / n[at])]
        return pa.RecordBatch.from_arrays(found, names=["chrom", "pos", "n", "bq_median", "mapq_median", "snv_fraction"])


#: Bases of a piece at most, so that a batch of pieces is of bounded size; a divisor of a chunk's width.
PIECE = 512


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of a text column as one array of single bytes, and where each text begins, with the end behind."""
    column = column.fill_null("").cast(pa.large_string())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data if data is not None else b"", np.uint8)
    if len(data) and data[ends[0] : ends[-1]].max(initial=0) > 127:
        own = [t.encode("latin-1") for t in column.to_pylist()]
        data, ends = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])
    return data, ends


def _piled(batches: Iterator[pa.RecordBatch], width: int = WIDTH, out=_Chunk.rows) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by chunk, each chunk's reference before its pieces, to rows by position or what ``out`` makes of a chunk."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, lo = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("k", "lo"))
        names = batch.column("chrom").dictionary_encode()
        named, names = names.indices.fill_null(-1).to_numpy(zero_copy_only=False), [*names.dictionary.to_pylist(), None]
        mapq = batch.column("mapq").fill_null(-1).to_numpy(zero_copy_only=False)
        if mapq.max() > 255:
            raise ValueError("a mapping quality is over 255")
        (bases, ends), (quals, qual_ends) = _letters(batch.column("bases")), _letters(batch.column("quals"))
        is_ref, refs = batch.column("refs").is_valid().to_numpy(zero_copy_only=False), batch.column("refs")
        starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (named[1:] != named[:-1])])).tolist() + [batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = names[named[a]], int(k[a])
            if held is None or held.key != key:
                if held is not None:
                    yield out(held)
                held = _Chunk(*key, width)
            if is_ref[a]:
                text = refs[a].as_py().encode("latin-1")
                held.refs[: len(text)] = np.frombuffer(text, np.uint8)
                a += 1
            if a == b:
                continue
            begins, sizes = ends[a:b], ends[a + 1 : b + 1] - ends[a:b]
            # A base's place is its piece's place plus how far it stands behind the piece's first.
            at = np.arange(begins[0], ends[b]) + np.repeat(lo[a:b] - key[1] * width - begins, sizes)
            held.add(at, bases[ends[a] : ends[b]], quals[qual_ends[a] : qual_ends[b]], np.repeat(mapq[a:b], sizes))
    if held is not None:
        yield out(held)


def _pieces(reads: DataFrame, store: DataFrame, seq: str, qual: str, parts: int | None) -> DataFrame:
    """Aligned stretches cut at the borders of chunks and pieces, and the chunks' reference, dealt out and sorted by chunk; a column ``ops`` of parsed CIGARs is used if there is one."""
    ops = F.aggregate(
        F.col("ops") if "ops" in reads.columns else C.cigar_ops("cigar", "pos0"),
        F.expr("named_struct('q', 0, 'out', cast(array() as array<struct<r:bigint,q:int,n:int>>))"),
        lambda a, o: F.struct(
            (a["q"] + F.when(o["op"].isin("M", "I", "S", "=", "X"), o["len"]).otherwise(0)).alias("q"),
            F.when(o["op"].isin("M", "=", "X"), F.array_append(a["out"], F.struct(o["ref_start"].alias("r"), a["q"].alias("q"), o["len"].alias("n")))).otherwise(a["out"]).alias("out"),
        ),
    )["out"]
    one = F.array(F.struct(F.col("pos0").cast("bigint").alias("r"), F.lit(0).alias("q"), F.expr("CAST(substring(cigar, 1, length(cigar) - 1) AS INT)").alias("n")))
    ops = F.when(F.col("cigar").rlike(r"^\d+[M=X]$"), one).otherwise(ops)
    own = drop_failed(reads).filter(~C.flag_has("flag", C.UNMAPPED) & F.col(seq).isNotNull() & F.col(qual).isNotNull()).select("chrom", "mapq", seq, qual, F.explode(ops).alias("b")).filter("b.n > 0")
    end = F.col("b.r") + F.col("b.n")
    cut = own.withColumn("i", F.explode(F.sequence(F.floor(F.col("b.r") / PIECE), F.floor((end - 1) / PIECE)))).withColumn("k", F.floor(F.col("i") * PIECE / WIDTH))
    cut = cut.withColumn("lo", F.greatest(F.col("b.r"), F.col("i") * PIECE)).withColumn("n", (F.least(end, (F.col("i") + 1) * PIECE) - F.col("lo")).cast("int")).withColumn("q", (F.col("b.q") + F.col("lo") - F.col("b.r")).cast("int"))
    part = lambda c, pad: F.rpad(F.substring(c, F.col("q") + 1, F.col("n")), F.col("n"), pad)
    pieces = cut.select("chrom", "k", "lo", F.col("mapq").cast("int").alias("mapq"), F.upper(part(seq, " ")).alias("bases"), part(qual, "\0").alias("quals"), F.lit(None).cast("string").alias("refs"))
    none = lambda kind: F.lit(None).cast(kind)
    known = store.select("chrom", F.col("chunk").alias("k"), none("bigint").alias("lo"), none("int").alias("mapq"), none("string").alias("bases"), none("string").alias("quals"), F.upper(F.substring("bases", 1, WIDTH)).alias("refs"))
    both = pieces.unionByName(known)
    both = both.repartition("chrom", "k") if parts is None else both.repartition(parts, "chrom", "k")
    # Nulls sort first: a chunk's reference comes before its pieces.
    return both.sortWithinPartitions("chrom", "k", "lo")


def pileup(reads: DataFrame, store: DataFrame, seq: str = "seq", qual: str = "qual", max_depth: int | None = None, parts: int | None = None) -> DataFrame:
    """(chrom, pos, n, bq_median, mapq_median, snv_fraction) of positions under aligned bases; with ``max_depth``, of those under fewer.

    Query offsets advance over M, I, S, = and X, reference positions over M, D, N, = and X.
    ``qual`` is text with an offset of 33; reads without sequence or quality are left out. Bases
    over an unknown reference base (N, or none in the store) are no mismatches. Aligned stretches are cut
    at the borders of the base store's chunks and sorted by chunk with them (one exchange, in ``parts``
    partitions); no base becomes a row before its position's counts are made.
    """
    out = _pieces(reads, store, seq, qual, parts).mapInArrow(_piled, "chrom string, pos bigint, n bigint, bq_median double, mapq_median double, snv_fraction double")
    return out if max_depth is None else out.filter(F.col("n") < max_depth)


def pileup_chunks(reads: DataFrame, store: DataFrame, seq: str = "seq", qual: str = "qual", parts: int | None = None) -> DataFrame:
    """(chrom, chunk, bq, fraction, mapq): the medians and fractions of ``pileup`` as one row a chunk, NaN where there are none."""
    pack = lambda batches: _piled(batches, out=_Chunk.packed)
    return _pieces(reads, store, seq, qual, parts).mapInArrow(pack, "chrom string, chunk bigint, bq array<double>, fraction array<double>, mapq array<double>")


def drop_outliers(df: DataFrame, columns: list[str], threshold: float = 3.5) -> DataFrame:
    """Rows whose modified z-score of the distance from the medians is at most ``threshold``; a zero spread drops none."""
    centre = {c: exact_median(df, c) for c in columns}
    d = F.sqrt(sum(((F.col(c) - F.lit(centre[c])) ** 2 for c in columns), F.lit(0.0)))
    far = df.withColumn("__d", d)
    mad = exact_median(far, "__d")
    return (far.filter(0.6745 * F.col("__d") / F.lit(mad) <= threshold) if mad else far).drop("__d")
