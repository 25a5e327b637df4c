"""Whole-genome channels: per-position counts and medians of reads, split pairs and candidates.

Channel tables are sparse: (chrom, pos, channel, value). Positions follow the reference
channels: a left clip counts at start + 1, a right clip at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import calls
from lociflow.functions import cigar as C
from lociflow.operators.basestore import WIDTH
from lociflow.operators.ranges import next_position, steps

COVERAGE = ["cov_proper", "cov_disc_F", "cov_disc_R", "cov_improper_F", "cov_improper_R"]
CLIPPED = [f"{p}{s}_{d}" for p in ("", "disc_") for s in ("left", "right") for d in "FR"] + [f"{k}_{d}" for k in ("D_left", "D_right", "I") for d in "FR"]
INVERSION = [f"inv_{k}" for k in ("before", "before_split", "after", "after_split")]
DUPLICATION = [f"dup_{k}" for k in ("before", "before_split", "after", "after_split")]
TRANSLOCATION = [f"tra_{k}" for k in ("opposite", "opposite_split", "same", "same_split")]
SPLIT = [f"split_{s}_{d}" for s in ("left", "right") for d in "FR"]
CLIP_DISTANCE = [f"clipdist_{o}_{s}" for o in ("forward", "reverse") for s in ("left", "right", "all")]
SPLIT_DISTANCE = [f"splitdist_{s}_{d}" for s in ("left", "right") for d in "FR"]
SNV = ["snv_bq", "snv_fraction", "snv_mapq"]
BASES = [f"base_{b}" for b in calls.GENOME_BASES]
#: All 53 columns in their fixed order.
ALL = COVERAGE + SNV + CLIPPED + SPLIT + CLIP_DISTANCE + INVERSION + DUPLICATION + TRANSLOCATION + SPLIT_DISTANCE + BASES


def _mapped(reads: DataFrame, min_mapq: int, mates: bool = False) -> DataFrame:
    """Reads with the flags and places that the channels ask for."""
    bits = C.UNMAPPED | (C.MATE_UNMAPPED if mates else 0)
    own = reads.filter(~C.flag_has("flag", bits) & (F.col("mapq") >= min_mapq))
    return own.withColumn("rev", C.flag_has("flag", C.REVERSE)).withColumn("mrev", C.flag_has("flag", C.MATE_REVERSE)).withColumn("proper", C.flag_has("flag", C.PROPER)).withColumn("end", C.cigar_ref_end("pos0", "cigar")).withColumn("lc", C.is_left_clipped("cigar")).withColumn("rc", C.is_right_clipped("cigar")).withColumn("strand", F.when(F.col("rev"), "R").otherwise("F"))


def _count(df: DataFrame, pos: Column, *names: Column) -> DataFrame:
    """Counts of all non-null channel names of each row at its position."""
    each = df.select("chrom", pos.cast("bigint").alias("pos"), (names[0] if len(names) == 1 else F.explode(F.array(*names))).alias("channel"))
    return each.filter("channel is not null").groupBy("chrom", "pos", "channel").agg(F.count("*").cast("double").alias("value"))


def coverage(reads: DataFrame, mean: float, sd: float, min_mapq: int = 10, parts: int | None = None) -> DataFrame:
    """Five span depths over [start, end - 1): proper, discordant by strand, not proper by strand; each with its next place, ``parts`` as in ``steps``."""
    own = _mapped(reads, min_mapq).filter(F.col("end") - 1 > F.col("pos0"))
    mate = ~C.flag_has("flag", C.MATE_UNMAPPED)
    disc = (F.col("chrom") == F.col("next_chrom")) & (F.col("rev") != F.col("mrev")) & C.is_discordant_isize("pos0", "next_pos0", mean, sd)
    names = F.array(F.when(C.is_properly_mapped("chrom", "next_chrom", "flag"), "cov_proper"), F.when(mate & disc, F.concat(F.lit("cov_disc_"), "strand")), F.when(mate & ~F.col("proper"), F.concat(F.lit("cov_improper_"), "strand")))
    each = own.select("chrom", "pos0", "end", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("channel"))
    ends = each.select("chrom", "channel", F.explode(F.array(F.struct(F.col("pos0").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") - 1).alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    out = steps(ends.select(F.concat_ws("|", "chrom", "channel").alias("key"), "x.pos", "x.d"), "d", "depth", "next", key="key", parts=parts)
    return out.select(F.split("key", "[|]")[0].alias("chrom"), "pos", F.split("key", "[|]")[1].alias("channel"), F.col("depth").cast("double").alias("value"), "next")


def clipped(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    """Fourteen counts: clips without supplementary alignment facing an opposite mate, all and not proper, and indels of 50 bases or more."""
    own = _mapped(reads, min_mapq, mates=True).filter((F.col("chrom") == F.col("next_chrom")) & (F.col("rev") != F.col("mrev")) & F.col("sa").isNull() & (F.col("lc") | F.col("rc")))
    side = F.when(F.col("lc"), "left").otherwise("right")
    clips = _count(own, clip_position(), F.concat_ws("_", side, "strand"), F.when(~F.col("proper"), F.concat_ws("_", F.lit("disc"), side, "strand")))
    big = _mapped(reads, min_mapq).select("chrom", "strand", F.explode(C.get_indels("cigar", "pos0")).alias("i"))
    at = F.when(F.col("i.kind") == "INS", F.array(F.struct(F.lit("I").alias("k"), F.col("i.s").alias("p")))).otherwise(F.array(F.struct(F.lit("D_left").alias("k"), F.col("i.s").alias("p")), F.struct(F.lit("D_right").alias("k"), F.col("i.e").alias("p"))))
    ends = big.select("chrom", "strand", F.explode(at).alias("x"))
    return clips.unionByName(_count(ends, F.col("x.p"), F.concat_ws("_", "x.k", "strand")))


def clip_position() -> Column:
    return F.when(F.col("lc"), F.col("pos0") + 1).otherwise(F.col("end"))


def _split_suffix() -> Column:
    return F.when(F.col("sa").isNotNull(), "_split").otherwise("")


def inversions(reads: DataFrame, min_mapq: int = 10, compat: bool = False) -> DataFrame:
    """Clips whose mate lies on the same strand, before or after; with ``compat`` only those without supplementary alignment."""
    own = _mapped(reads, min_mapq, mates=True).filter((F.col("chrom") == F.col("next_chrom")) & (F.col("rev") == F.col("mrev")) & (F.col("lc") | F.col("rc")))
    own = own.filter(F.col("sa").isNull()) if compat else own
    return _count(own, clip_position(), F.concat(F.lit("inv_"), F.when(F.col("pos0") > F.col("next_pos0"), "before").otherwise("after"), _split_suffix()))


def duplications(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    """Reverse left clips with the mate after, forward right clips with the mate before."""
    own = _mapped(reads, min_mapq, mates=True).filter((F.col("chrom") == F.col("next_chrom")) & (F.col("rev") != F.col("mrev")))
    # What flags and places decide comes first; the CIGAR text is looked at for the rest only.
    own = own.filter((F.col("rev") & (F.col("pos0") < F.col("next_pos0"))) | (~F.col("rev") & (F.col("pos0") > F.col("next_pos0"))))
    after, before = F.col("rev") & F.col("lc"), ~F.col("rev") & F.col("rc") & ~F.col("lc")
    return _count(own.filter(after | before), clip_position(), F.concat(F.lit("dup_"), F.when(after, "after").otherwise("before"), _split_suffix()))


def translocations(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    """Clips whose mate lies on another chromosome, by strands."""
    own = _mapped(reads, min_mapq, mates=True).filter((F.col("chrom") != F.col("next_chrom")) & (F.col("lc") | F.col("rc")))
    return _count(own, clip_position(), F.concat(F.lit("tra_"), F.when(F.col("rev") != F.col("mrev"), "opposite").otherwise("same"), _split_suffix()))


def clipped_positions(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    """(chrom, side, pos, n): clips without supplementary alignment that a later mate confirms."""
    ok = reads.filter(~C.flag_has("flag", C.UNMAPPED) & (F.col("mapq") >= min_mapq) & F.col("sa").isNull())
    mates = ok.select(F.col("qname").alias("q"), F.col("chrom").alias("c"), F.col("pos0").alias("p"), F.col("ord").alias("o"), F.col("next_chrom").alias("nc"))
    met = ok.filter(C.is_clipped("cigar")).join(mates, (F.col("qname") == F.col("q")) & (F.col("next_pos0") == F.col("p")) & (F.col("chrom") == F.col("nc")) & (F.col("o") > F.col("ord")))
    sides = F.filter(F.array(F.when(C.is_left_clipped("cigar"), F.struct(F.lit("left").alias("side"), (F.col("pos0") + 1).alias("pos"))), F.when(C.is_right_clipped("cigar"), F.struct(F.lit("right").alias("side"), C.cigar_ref_end("pos0", "cigar").alias("pos")))), lambda x: x.isNotNull())
    return met.select("chrom", F.explode(sides).alias("x")).groupBy("chrom", "x.side", "x.pos").agg(F.count("*").alias("n"))


def clip_distances(reads: DataFrame, mean: float, sd: float, min_mapq: int = 10) -> DataFrame:
    """Median z-scored mate distance of forward-reverse pairs, by direction and clip side."""
    own = _mapped(reads, min_mapq, mates=True).filter(F.col("chrom") == F.col("next_chrom"))
    ahead = ~F.col("rev") & F.col("mrev") & (F.col("pos0") <= F.col("next_pos0"))
    behind = F.col("rev") & ~F.col("mrev") & (F.col("pos0") > F.col("next_pos0"))
    own = own.filter(ahead | behind).withColumn("o", F.when(ahead, "forward").otherwise("reverse")).withColumn("z", (F.abs(F.col("pos0") - F.col("next_pos0")) - mean) / sd)
    keys = F.array(F.struct(F.lit("all").alias("s"), F.when(F.col("rev"), F.col("pos0")).otherwise(F.col("end") + 1).alias("p")), F.when(F.col("lc"), F.struct(F.lit("left").alias("s"), F.col("pos0").alias("p"))).when(F.col("rc"), F.struct(F.lit("right").alias("s"), (F.col("end") + 1).alias("p"))))
    each = own.select("chrom", "o", "z", F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("k"))
    return each.groupBy("chrom", F.col("k.p").cast("bigint").alias("pos"), F.concat_ws("_", F.lit("clipdist"), "o", "k.s").alias("channel")).agg(F.median("z").alias("value"))


def split_reads(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    """Clipped reads with their first supplementary alignment: clip side, both positions, type and strands.

    Reads with a supplementary alignment but no clip of their own are left out.
    """
    own = _mapped(reads, min_mapq).filter(F.col("lc") | F.col("rc")).withColumn("first", C.sa_first("sa", min_mapq)).filter("first is not null")
    sa = C.sa_list("sa")[0]["cigar"]
    own = own.withColumn("sa_pos", F.col("first.pos0") + F.when(C.is_left_clipped(sa), F.lit(1)).when(C.is_right_clipped(sa), C.cigar_consumed(sa)).otherwise(0))
    own = own.withColumn("side", F.when(F.col("lc") & F.col("rc"), "both").when(F.col("lc"), "left").otherwise("right")).withColumn("pos", F.when(F.col("rc"), F.col("end")).otherwise(F.col("pos0") + 1))
    kind = (
        F.when(F.col("chrom") != F.col("first.rname"), "CTX").when(F.col("rev") == F.col("mrev"), "INV").when(F.col("side") == "both", "DEL")
        .when(F.col("side") == "right", F.when(F.col("pos0") < F.col("sa_pos"), "DEL").otherwise("DUP")).otherwise(F.when(F.col("pos0") > F.col("sa_pos"), "DUP").otherwise("DEL"))
    )
    mine = F.when(F.col("rev"), "-").otherwise("+")
    strands = F.when(mine == F.col("first.strand"), "+-").otherwise(F.concat(mine, F.col("first.strand")))
    return own.select("chrom", "pos", F.col("first.rname").alias("sa_chrom"), "sa_pos", "side", "strand", kind.alias("kind"), strands.alias("strands"))


def split_counts(reads: DataFrame, min_mapq: int = 10, both: bool = False) -> DataFrame:
    own = split_reads(reads, min_mapq)
    own = own if both else own.filter("side <> 'both'")
    return _count(own, F.col("pos"), F.concat_ws("_", F.lit("split"), "side", "strand"))


def split_distances(reads: DataFrame, mean: float, sd: float, min_mapq: int = 10) -> DataFrame:
    """Median z-scored distance from the clip to the supplementary alignment, 0 across chromosomes."""
    z = F.when(F.col("chrom") == F.col("sa_chrom"), (F.abs(F.col("pos") - F.col("sa_pos")) - mean) / sd).otherwise(0.0)
    own = split_reads(reads, min_mapq).filter("side <> 'both'")
    return own.groupBy("chrom", "pos", F.concat_ws("_", F.lit("splitdist"), "side", "strand").alias("channel")).agg(F.median(z).alias("value"))


def canonical(chrom1: Column, pos1: Column, chrom2: Column, pos2: Column) -> tuple[Column, Column]:
    """Both ends in text order of chromosome, then position."""
    a, b = F.struct(chrom1.alias("c"), pos1.cast("bigint").alias("p")), F.struct(chrom2.alias("c"), pos2.cast("bigint").alias("p"))
    return F.least(a, b), F.greatest(a, b)


def _pairs(df: DataFrame, a: Column, b: Column, kind: Column, strands: Column) -> DataFrame:
    return df.select(a["c"].alias("chrom1"), a["p"].alias("pos1"), b["c"].alias("chrom2"), b["p"].alias("pos2"), kind.alias("kind"), strands.alias("strands")).distinct()


def split_pairs(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    """Distinct pairs (chrom1, pos1, chrom2, pos2, kind, strands) of split reads."""
    a, b = canonical(F.col("chrom"), F.col("pos"), F.col("sa_chrom"), F.col("sa_pos"))
    return _pairs(split_reads(reads, min_mapq), a, b, F.col("kind"), F.col("strands"))


def indel_pairs(reads: DataFrame, min_mapq: int = 10, least: int = 50) -> DataFrame:
    """Distinct pairs of CIGAR indels of at least ``least`` bases."""
    own = _mapped(reads, min_mapq).select("chrom", F.explode(C.get_indels("cigar", "pos0", least)).alias("i"))
    end = F.when(F.col("i.kind") == "INS", F.col("i.s") + 1).otherwise(F.col("i.e"))
    a, b = canonical(F.col("chrom"), F.col("i.s"), F.col("chrom"), end)
    return _pairs(own, a, b, F.concat(F.lit("INDEL_"), "i.kind"), F.lit("+-"))


def clip_sides(reads: DataFrame, least: int = 1) -> DataFrame:
    """(chrom, side, pos, n): clipped positions with at least ``least`` reads, left before right for double clips."""
    own = reads.filter(C.is_clipped("cigar")).select("chrom", F.when(C.is_left_clipped("cigar"), F.struct(F.lit("left").alias("side"), (F.col("pos0") + 1).alias("pos"))).otherwise(F.struct(F.lit("right").alias("side"), C.cigar_ref_end("pos0", "cigar").alias("pos"))).alias("x"))
    return own.groupBy("chrom", "x.side", "x.pos").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def insertion_candidates(reads: DataFrame, least: int = 3) -> DataFrame:
    """Pairs (p, p + 1): a clipped position with a clip of the other side at p - 1 or p."""
    own = clip_sides(reads, least).select("chrom", "side", "pos")
    near = own.select(F.col("chrom").alias("c"), F.col("side").alias("s"), F.explode(F.array(F.col("pos"), F.col("pos") + 1)).alias("p"))
    met = own.join(near, (F.col("chrom") == F.col("c")) & (F.col("pos") == F.col("p")) & (F.col("side") != F.col("s")), "left_semi")
    return met.select(F.col("chrom").alias("chrom1"), F.col("pos").alias("pos1"), F.col("chrom").alias("chrom2"), (F.col("pos") + 1).alias("pos2"), F.lit("INS").alias("kind"), F.lit("+-").alias("strands")).distinct()


def split_support(reads: DataFrame, min_mapq: int = 10, least: int = 1) -> DataFrame:
    """(chrom, pos): positions that at least ``least`` split or indel ends of one side share."""
    ends = split_reads(reads, min_mapq).filter("side <> 'both'").select("chrom", "side", "pos")
    big = _mapped(reads, min_mapq).select("chrom", F.explode(C.get_indels("cigar", "pos0")).alias("i")).filter("i.kind = 'DEL'")
    more = big.select("chrom", F.explode(F.array(F.struct(F.lit("right").alias("side"), F.col("i.s").alias("pos")), F.struct(F.lit("left").alias("side"), F.col("i.e").alias("pos")))).alias("x")).select("chrom", "x.side", "x.pos")
    return ends.unionByName(more).groupBy("chrom", "side", "pos").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("chrom", "pos").distinct()


def supported_pairs(pairs: DataFrame, support: DataFrame) -> DataFrame:
    """Pairs of which either end is supported; insertions are exempt."""
    at = support.select(F.col("chrom").alias("c"), F.col("pos").alias("p"))
    one = pairs.join(at, (F.col("chrom1") == F.col("c")) & (F.col("pos1") == F.col("p")), "left_semi")
    two = pairs.join(at, (F.col("chrom2") == F.col("c")) & (F.col("pos2") == F.col("p")), "left_semi")
    return one.unionByName(two).unionByName(pairs.filter("kind = 'INS'")).distinct()


def candidates(pairs: DataFrame, contigs: DataFrame, svtype: str, half: int = 100) -> DataFrame:
    """Pairs of one type and of its CIGAR twin, far enough from the contigs' ends."""
    own = pairs.filter(F.col("kind").isin(svtype, f"INDEL_{svtype}"))
    for k in ("1", "2"):
        c = contigs.select(F.col("chrom").alias(f"c{k}"), F.col("len").alias(f"len{k}"))
        own = own.join(F.broadcast(c), F.col(f"chrom{k}") == F.col(f"c{k}")).filter(F.col(f"pos{k}").between(half, F.col(f"len{k}") - half)).drop(f"c{k}", f"len{k}")
    return own


def near_clips(pairs: DataFrame, clips: DataFrame) -> DataFrame:
    """Pairs with either end within one base of a clipped position."""
    near = clips.select(F.col("chrom").alias("c"), F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)).alias("p")).distinct()
    one = pairs.join(near, (F.col("chrom1") == F.col("c")) & (F.col("pos1") == F.col("p")), "left_semi")
    two = pairs.join(near, (F.col("chrom2") == F.col("c")) & (F.col("pos2") == F.col("p")), "left_semi")
    return one.unionByName(two).distinct()


def one_hot(bases: DataFrame) -> DataFrame:
    """Base indicators in the order A, T, C, G, N."""
    own = bases.filter(F.upper("base").isin(list(calls.GENOME_BASES)))
    return own.select("chrom", "pos", F.concat(F.lit("base_"), F.upper("base")).alias("channel"), F.lit(1.0).alias("value"))


def read_channels(reads: DataFrame, mean: float, sd: float, min_mapq: int = 10, compat: bool = False) -> DataFrame:
    """(chrom, pos, channel, value): all that a read adds to counts, coverage changes and distances, from one explode.

    Counts add one at their place; a span adds one to its coverage channels at its start and takes
    it away at its last base. Distances are z-scores of which a place's median counts.
    """
    own = _mapped(reads, min_mapq).withColumn("both", ~C.flag_has("flag", C.MATE_UNMAPPED)).withColumn("same", F.col("chrom") == F.col("next_chrom"))
    own = own.withColumn("facing", F.col("rev") != F.col("mrev")).withColumn("clip", F.col("lc") | F.col("rc")).withColumn("at", clip_position()).withColumn("sfx", _split_suffix())
    own = own.withColumn("big", C.get_indels("cigar", "pos0")).withColumn("first", C.sa_first("sa", min_mapq))
    item = lambda when, channel, pos, value=1.0: F.when(when, F.struct(channel.alias("channel"), pos.cast("bigint").alias("pos"), (F.lit(value) if isinstance(value, float) else value).cast("double").alias("value")))
    name = lambda *parts: F.concat_ws("_", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    strand, side = F.col("strand"), F.when(F.col("lc"), F.lit("left")).otherwise("right")
    start, end, next_pos = F.col("pos0"), F.col("end"), F.col("next_pos0")

    spans = [("cov_proper", C.is_properly_mapped("chrom", "next_chrom", "flag")), ("cov_disc", F.col("both") & F.col("same") & F.col("facing") & C.is_discordant_isize("pos0", "next_pos0", mean, sd)), ("cov_improper", F.col("both") & ~F.col("proper"))]
    out = []
    for channel, when in spans:
        full = F.lit(channel) if channel == "cov_proper" else name(channel, strand)
        out += [item(when & (end - 1 > start), full, start), item(when & (end - 1 > start), full, end - 1, -1.0)]
    clean = F.col("both") & F.col("same") & F.col("facing") & F.col("sa").isNull() & F.col("clip")
    out += [item(clean, name(side, strand), F.col("at")), item(clean & ~F.col("proper"), name("disc", side, strand), F.col("at"))]
    turned = F.col("both") & F.col("same") & ~F.col("facing") & F.col("clip")
    turned = turned & F.col("sa").isNull() if compat else turned
    out.append(item(turned, F.concat(F.lit("inv_"), F.when(start > next_pos, "before").otherwise("after"), "sfx"), F.col("at")))
    after, before = F.col("lc") & F.col("rev") & (start < next_pos), ~F.col("lc") & F.col("rc") & ~F.col("rev") & (start > next_pos)
    out.append(item(F.col("both") & F.col("same") & F.col("facing") & (after | before), F.concat(F.lit("dup_"), F.when(after, "after").otherwise("before"), "sfx"), F.col("at")))
    out.append(item(F.col("both") & ~F.col("same") & F.col("clip"), F.concat(F.lit("tra_"), F.when(F.col("facing"), "opposite").otherwise("same"), "sfx"), F.col("at")))
    ahead, behind = ~F.col("rev") & F.col("mrev") & (start <= next_pos), F.col("rev") & ~F.col("mrev") & (start > next_pos)
    paired, o, z = F.col("both") & F.col("same") & (ahead | behind), F.when(ahead, "forward").otherwise("reverse"), (F.abs(start - next_pos) - mean) / sd
    out += [item(paired, name("clipdist", o, "all"), F.when(F.col("rev"), start).otherwise(end + 1), z), item(paired & F.col("clip"), name("clipdist", o, side), F.when(F.col("lc"), start).otherwise(end + 1), z)]
    single = F.col("first").isNotNull() & (F.col("lc") != F.col("rc"))
    sa = C.sa_list("sa")[0]["cigar"]
    sa_pos = F.col("first.pos0") + F.when(C.is_left_clipped(sa), F.lit(1)).when(C.is_right_clipped(sa), C.cigar_consumed(sa)).otherwise(0)
    place = F.when(F.col("rc"), end).otherwise(start + 1)
    far = F.when(F.col("chrom") == F.col("first.rname"), (F.abs(place - sa_pos) - mean) / sd).otherwise(0.0)
    out += [item(single, name("split", side, strand), place), item(single, name("splitdist", side, strand), place, far)]
    indels = F.flatten(F.transform("big", lambda i: F.when(i["kind"] == "INS", F.array(item(F.lit(True), name("I", strand), i["s"]))).otherwise(F.array(item(F.lit(True), name("D_left", strand), i["s"]), item(F.lit(True), name("D_right", strand), i["e"])))))
    none = F.array().cast("array<struct<channel:string,pos:bigint,value:double>>")
    # Missing items go after the explode: a lambda over the array would be evaluated without generated code.
    each = own.select("chrom", F.explode(F.concat(F.array(*out), F.coalesce(indels, none))).alias("x")).filter("x is not null")
    return each.select("chrom", "x.pos", "x.channel", "x.value")


#: Channels that are laid out from reads and pileup; the bases come from the store.
LAID = [c for c in ALL if c not in BASES]
#: Channels of which a place takes the median, not the sum.
DISTANCE = np.array([c in CLIP_DISTANCE + SPLIT_DISTANCE for c in LAID])
_CODES = 64  # an event's code is its place in the chunk times this, plus its channel


def chr_chunks(reads: DataFrame, contigs: DataFrame, store: DataFrame, mean: float, sd: float, pile: DataFrame | None = None, min_mapq: int = 10, width: int = WIDTH, parts: int | None = None) -> DataFrame:
    """(chrom, chunk, places, before, events, bq, fraction, mapq, bases): all that the whole-genome array is laid out from, one row for each chunk of the contigs.

    ``events`` are (code, value, n), equal ones counted, so a row does not grow with the depth where values
    repeat; ``before`` are the coverages carried in from earlier chunks, made from one row a chunk. ``pile`` is
    ``pileup_chunks``. Coverage from before the contig's start counts from 0 on, what lies outside is
    left out. ``parts`` gives the partitions (the session's without).
    """
    dealt = lambda df: df.repartition("chrom", "chunk") if parts is None else df.repartition(parts, "chrom", "chunk")
    lengths = F.broadcast(contigs.select(F.col("chrom").alias("c"), "len"))
    channel = F.array_position(F.array(*(F.lit(c) for c in LAID)), F.col("channel")) - 1
    each = read_channels(reads, mean, sd, min_mapq).join(lengths, F.col("chrom") == F.col("c")).filter((F.col("pos") < F.col("len")) & ((F.col("pos") >= 0) | F.col("channel").startswith("cov")))
    pos = F.greatest("pos", F.lit(0))
    # Totals and events ask for the same columns, so both come from the same exchange.
    own = each.select("chrom", F.floor(pos / width).alias("chunk"), (pos % width * _CODES + channel).cast("int").alias("code"), "value")
    events = dealt(own.filter(F.col("chrom").isNotNull() & F.col("chunk").isNotNull()))
    counted = events.groupBy("chrom", "chunk", "code", "value").agg(F.count("*").alias("n"))
    held = counted.groupBy("chrom", "chunk").agg(F.collect_list(F.struct("code", "value", "n")).alias("events"))
    totals = events.groupBy("chrom", "chunk").agg(*(F.sum(F.when(F.col("code") % _CODES == i, F.col("value"))).alias(c) for i, c in enumerate(COVERAGE)))
    chunks = contigs.filter("len > 0").select("chrom", "len", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("len") - 1) / width))).alias("chunk"))
    over = Window.partitionBy("chrom").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    before = F.array(*(F.coalesce(F.sum(c).over(over), F.lit(0.0)) for c in COVERAGE))
    spine = chunks.join(totals, ["chrom", "chunk"], "left").select("chrom", "chunk", F.least(F.lit(width), F.col("len") - F.col("chunk") * width).cast("int").alias("places"), before.alias("before"))
    out = dealt(spine).join(held, ["chrom", "chunk"], "left")
    if pile is None:
        out = out.select("*", *(F.lit(None).cast("array<double>").alias(c) for c in ("bq", "fraction", "mapq")))
    else:
        out = out.hint("merge").join(dealt(pile).hint("merge"), ["chrom", "chunk"], "left")
    bases = store.select("chrom", "chunk", F.upper(F.substring("bases", 1, width)).alias("bases"))
    return out.hint("merge").join(dealt(bases).hint("merge"), ["chrom", "chunk"], "left")


def _summed(events: pa.Array, places: int) -> np.ndarray:
    """Channels by place: sums of the events at a place, the median for distances."""
    code, value, n = (events.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    cell = code % _CODES * places + code // _CODES
    far = DISTANCE[code % _CODES]
    out = np.bincount(cell[~far], value[~far] * n[~far], minlength=len(LAID) * places).astype(float)
    order = np.lexsort((value[far], cell[far]))
    cell, value, n = cell[far][order], value[far][order], n[far][order]
    if len(cell):
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        upto, size = np.cumsum(n), np.add.reduceat(n, first)
        start = upto[first] - n[first]
        one, two = (value[np.searchsorted(upto, start + rank)] for rank in ((size + 1) // 2, size // 2 + 1))
        out[cell[first]] = (one + two) / 2
    return out.reshape(len(LAID), places)


def _layers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(chrom, chunk, channels by place, letters) of the rows of ``chr_chunks``: 48 rows of values; letters are blanks where there are none."""
    for batch in batches:
        own = {c: batch.column(c) for c in batch.schema.names}
        for i in range(batch.num_rows):
            places, events = own["places"][i].as_py(), own["events"][i].values
            out = np.zeros((len(LAID), places)) if events is None else _summed(events, places)
            out[: len(COVERAGE)] = np.cumsum(out[: len(COVERAGE)], axis=1) + own["before"][i].values.to_numpy()[:, None]
            for c, name in zip(("bq", "fraction", "mapq"), SNV):
                if own[c][i].is_valid:
                    out[LAID.index(name)] = np.nan_to_num(own[c][i].values.to_numpy()[:places])
            text = (own["bases"][i].as_py() or "").encode("latin-1", "replace")[:places]
            yield own["chrom"][i].as_py(), own["chunk"][i].as_py(), out, np.frombuffer(text.ljust(places), np.uint8)


def chr_array(reads: DataFrame, contigs: DataFrame, store: DataFrame, mean: float, sd: float, pile: DataFrame | None = None, min_mapq: int = 10, width: int = WIDTH, parts: int | None = None, block: int | None = None) -> DataFrame:
    """(chrom, s, e, 48 channels, bases): the whole-genome array as segments over which no channel changes; ``dense`` gives its 53 columns by position.

    A chunk of ``chr_chunks`` is laid out at a time and cut where any channel changes. Contigs are covered from
    0 to their length and missing values are zero. A segment's ``bases`` are its stretch of the reference, in
    capitals. ``block`` is of no effect any more.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chrom, chunk, out, letters in _layers(batches):
            s = np.flatnonzero(np.r_[True, (out[:, 1:] != out[:, :-1]).any(axis=0)])
            e = np.r_[s[1:], out.shape[1]]
            text = letters.tobytes().decode("latin-1")
            found = [pa.array([chrom] * len(s), pa.string()), pa.array(chunk * width + s), pa.array(chunk * width + e), *(pa.array(x[s]) for x in out), pa.array([text[a:b] for a, b in zip(s, e)], pa.string())]
            yield pa.RecordBatch.from_arrays(found, names=["chrom", "s", "e", *LAID, "bases"])

    chunks = chr_chunks(reads, contigs, store, mean, sd, pile, min_mapq, width, parts)
    return chunks.mapInArrow(segments, f"chrom string, s bigint, e bigint, {', '.join(f'{c} double' for c in LAID)}, bases string")


def array_sums(chunks: DataFrame, width: int = WIDTH, weight: int = 97) -> DataFrame:
    """(chrom, channel, nonzero, total, placed) of all 53 columns, from ``chr_chunks``: each chunk is laid out by position and summed up; ``placed`` weighs by place modulo ``weight``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chrom, chunk, out, letters in _layers(batches):
            array = np.vstack([out, *(letters == ord(c[-1]) for c in BASES)])
            w = (chunk * width + np.arange(array.shape[1])) % weight
            found = [pa.array([chrom] * len(array), pa.string()), pa.array(LAID + BASES), pa.array(np.count_nonzero(array, axis=1)), pa.array(array.sum(axis=1)), pa.array(array @ w.astype(float))]
            yield pa.RecordBatch.from_arrays(found, names=["chrom", "channel", "nonzero", "total", "placed"])

    each = chunks.mapInArrow(sums, "chrom string, channel string, nonzero bigint, total double, placed double")
    return each.groupBy("chrom", "channel").agg(*(F.sum(c).alias(c) for c in ("nonzero", "total", "placed")))


def dense(segments: DataFrame) -> DataFrame:
    """(chrom, pos, 53 columns) of array segments: each position's values, bases as indicators."""
    each = segments.select("chrom", "s", *(c for c in ALL if c not in BASES), F.posexplode(F.split(F.upper("bases"), "")).alias("i", "base"))
    return each.select("chrom", (F.col("s") + F.col("i")).alias("pos"), *((F.col("base") == c[-1]).cast("double").alias(c) if c in BASES else F.col(c) for c in ALL))


def channel_stats(channels: DataFrame, contigs: DataFrame) -> DataFrame:
    """(chrom, channel, mean, sd) over the whole contig of run-length channels; uncovered positions count as zero. Next places are found where ``channels`` has no ``next``."""
    own = channels if "next" in channels.columns else next_position(channels.withColumn("key", F.concat_ws("|", "chrom", "channel")), "next", key="key")
    own = own.filter("next is not null")
    n, v = F.col("next") - F.col("pos"), F.col("value")
    sums = own.groupBy("chrom", "channel").agg(F.sum(v * n).alias("s"), F.sum(v * v * n).alias("s2"))
    met = sums.join(F.broadcast(contigs), "chrom")
    mean = F.col("s") / F.col("len")
    return met.select("chrom", "channel", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.col("s2") / F.col("len") - mean * mean), 6).alias("sd"))


def snv(pile: DataFrame) -> DataFrame:
    """The three pileup channels in long form."""
    rows = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(v).cast("double").alias("value")) for c, v in zip(SNV, ("bq_median", "snv_fraction", "mapq_median"))))
    return pile.select("chrom", "pos", F.explode(rows).alias("x")).select("chrom", "pos", "x.channel", "x.value")


def pairs_to_bedpe(pairs: DataFrame) -> DataFrame:
    return pairs.select("chrom1", F.col("pos1").alias("s1"), (F.col("pos1") + 1).alias("e1"), "chrom2", F.col("pos2").alias("s2"), (F.col("pos2") + 1).alias("e2"), F.col("kind").alias("svtype"), F.substring("strands", 1, 1).alias("strand1"), F.substring("strands", 2, 1).alias("strand2"))
