"""Evidence signals of read pairs: one-position and two-position events with their codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import cigar as C
from lociflow.operators.reads import drop_failed, pair_mates

#: Event names in code order, from 1.
EVENTS = ("SOFT_LEFT_FWD SOFT_RIGHT_FWD SOFT_LEFT_REV SOFT_RIGHT_REV INS_FWD INS_REV HIGH_NM SOFT_BOTH DEL_FWD DEL_REV SPLIT_LOW_QUALITY SPLIT_INTER_CHROMOSOMAL MATE_UNMAPPED "
          "SPLIT_PLUS_PLUS SPLIT_MINUS_MINUS SPLIT_MINUS_PLUS SPLIT_PLUS_MINUS DISCORDANT_PLUS_MINUS DISCORDANT_PLUS_PLUS DISCORDANT_MINUS_MINUS DISCORDANT_MINUS_PLUS").split()
ONE, TWO = ["chrom", "pos", "event"], ["a_chrom", "a_pos", "b_chrom", "b_pos", "event"]


#: The type of an event; one-position events have no second place.
EVENT = "struct<a_chrom:string,a_pos:bigint,b_chrom:string,b_pos:bigint,event:int>"


def _with_ops(each: DataFrame) -> DataFrame:
    return each.withColumn("rev", C.flag_has("flag", C.REVERSE)).withColumn("end", C.cigar_ref_end("pos0", "cigar")).withColumn("ops", C.cigar_ops("cigar", "pos0"))


def paired_reads(pairs: DataFrame) -> DataFrame:
    """Both reads of each pair as rows again, with ``rev``, ``end`` and the parsed ``ops``."""
    return _with_ops(pairs.select(F.explode(F.array("a", "b")).alias("r")).select("r.*"))


def _event(a_chrom: Column, a_pos: Column, b_chrom: Column | None, b_pos: Column | None, event: Column) -> Column:
    none = F.lit(None)
    return F.struct(a_chrom.alias("a_chrom"), a_pos.cast("bigint").alias("a_pos"), (none if b_chrom is None else b_chrom).cast("string").alias("b_chrom"), (none if b_pos is None else b_pos).cast("bigint").alias("b_pos"), event.cast("int").alias("event"))


def _if(condition: Column, events: Column) -> Column:
    """``events`` where the condition holds, none elsewhere."""
    return F.coalesce(F.when(condition, events), F.array().cast(f"array<{EVENT}>"))


def _rows(df: DataFrame, events: Column, columns: list[str]) -> DataFrame:
    """One row an event, with the places that its kind has."""
    out = df.select(F.explode(events).alias("x"))
    return out.select("x.*") if columns is TWO else out.select(F.col("x.a_chrom").alias("chrom"), F.col("x.a_pos").alias("pos"), "x.event")


def _soft_clips(min_len: int, min_mapq: int, exclude_double: bool) -> Column:
    double = (F.col("ops")[0]["op"] == "S") & (F.element_at("ops", -1)["op"] == "S")
    found = F.filter("ops", lambda o: (o["op"] == "S") & (o["len"] >= min_len))
    code = lambda o: F.when(o["ref_start"] == F.col("pos0"), 1).otherwise(2) + F.when(F.col("rev"), 2).otherwise(0)
    ok = (F.col("mapq") >= min_mapq) & (F.size("ops") >= 2)
    return _if(ok & ~double if exclude_double else ok, F.transform(found, lambda o: _event(F.col("chrom"), o["ref_start"], None, None, code(o))))


def soft_clips(each: DataFrame, min_len: int = 14, min_mapq: int = 10, exclude_double: bool = False) -> DataFrame:
    """Codes 1 to 4: soft clips of at least ``min_len``, left if they lie at the read's start.

    Reads clipped on both sides count too unless ``exclude_double``.
    """
    return _rows(each, _soft_clips(min_len, min_mapq, exclude_double), ONE)


def _insertions(min_len: int, min_mapq: int) -> Column:
    found = F.filter("ops", lambda o: (o["op"] == "I") & (o["len"] >= min_len))
    return _if((F.col("mapq") >= min_mapq) & (F.size("ops") >= 2), F.transform(found, lambda o: _event(F.col("chrom"), o["ref_start"], None, None, F.when(F.col("rev"), 6).otherwise(5))))


def insertions(each: DataFrame, min_len: int = 14, min_mapq: int = 10) -> DataFrame:
    """Codes 5 and 6: inserted bases of at least ``min_len``."""
    return _rows(each, _insertions(min_len, min_mapq), ONE)


def _high_nm(least: int, min_mapq: int) -> Column:
    indel = F.aggregate(F.filter("ops", lambda o: o["op"].isin("I", "D")), F.lit(0).cast("bigint"), lambda a, o: a + o["len"])
    middle = F.floor((F.col("pos0") + F.col("end")) / 2)
    return _if((F.col("mapq") >= min_mapq) & (F.col("nm") >= least) & (F.col("nm") - indel >= least), F.array(_event(F.col("chrom"), middle, None, None, F.lit(7))))


def high_nm(each: DataFrame, least: int = 10, min_mapq: int = 10) -> DataFrame:
    """Code 7 at the read's middle: many mismatches even without its indels."""
    return _rows(each, _high_nm(least, min_mapq), ONE)


def _soft_both() -> Column:
    double = (F.size("ops") >= 2) & (F.col("ops")[0]["op"] == "S") & (F.element_at("ops", -1)["op"] == "S")
    return _if(double, F.array(_event(F.col("chrom"), F.col("pos0"), F.col("chrom"), F.col("end"), F.lit(8))))


def soft_both(each: DataFrame) -> DataFrame:
    """Code 8: first and last operation are soft clips, at any mapping quality."""
    return _rows(each, _soft_both(), TWO)


def _cigar_deletions(min_len: int, min_mapq: int) -> Column:
    found = F.filter("ops", lambda o: (o["op"] == "D") & (o["len"] >= min_len))
    return _if(F.col("mapq") >= min_mapq, F.transform(found, lambda o: _event(F.col("chrom"), o["ref_start"], F.col("chrom"), o["ref_start"] + o["len"], F.when(F.col("rev"), 10).otherwise(9))))


def cigar_deletions(each: DataFrame, min_len: int = 10, min_mapq: int = 10) -> DataFrame:
    """Codes 9 and 10: deletions of at least ``min_len``."""
    return _rows(each, _cigar_deletions(min_len, min_mapq), TWO)


def _splits(min_mapq: int) -> Column:
    left, start, end = C.soft_left("cigar", "mapq", min_mapq), F.col("pos0"), F.col("end")

    def one(s: Column) -> Column:
        least = F.least(s["mapq"], F.col("mapq"))
        p, p_end = s["pos"], C.cigar_ref_end(s["pos"], s["cigar"])
        before, sa_left = p < start, ~s["cigar"].rlike("S$")
        near = F.when(before, F.when(sa_left, p).otherwise(p_end - 1)).otherwise(F.when(sa_left, p - 1).otherwise(p_end))
        mine = (
            F.when(before & sa_left, F.when(left, start).otherwise(end))
            .when(before, F.when(left, start).otherwise(end - 1))
            .when(sa_left, F.when(left, start - 1).otherwise(end))
            .otherwise(F.when(left, start).otherwise(end))
        )
        minus = s["strand"] == "-"
        code = C.orientation_event(F.when(before, minus).otherwise(F.col("rev")), F.when(before, F.col("rev")).otherwise(minus), C.SPLIT_CODES)
        code = F.when(least < min_mapq, 11).when(s["rname"] != F.col("chrom"), 12).otherwise(code)
        pick = lambda yes, no: F.when(before, yes).otherwise(no)
        return _event(pick(s["rname"], F.col("chrom")), pick(near, mine), pick(F.col("chrom"), s["rname"]), pick(mine, near), code)

    return _if(F.col("sa").isNotNull(), F.transform(F.filter(C.sa_list("sa"), lambda s: F.least(s["mapq"], F.col("mapq")) > 0), one))


def splits(each: DataFrame, min_mapq: int = 10) -> DataFrame:
    """Codes 11, 12 and 14 to 17: one event for each supplementary alignment.

    The side with the smaller position comes first. Coordinates follow from the order, the
    supplementary's side and the read's own clip; positions keep the mixed bases that the offsets
    are tuned to (supplementary 1-based, read 0-based).
    """
    return _rows(each, _splits(min_mapq), TWO)


def _open_pair(min_mapq: int, longest: int | None) -> Column:
    """The pair is not proper, and some mate maps well."""
    return ((F.col("a.mapq") >= min_mapq) | (F.col("b.mapq") >= min_mapq)) & ~C.proper_pair(F.col("a.flag"), F.col("a.tlen"), longest)


def _best(read: str, side: str) -> Column:
    c, start = F.col(f"{read}.cigar"), F.col(f"{read}.pos0")
    return C.best_position(side, start, C.cigar_ref_end(start, c), F.coalesce(c.rlike(r"^\d+S"), F.lit(False)), F.coalesce(c.rlike("S$"), F.lit(False)), C.several_ops(c))


def _mates_unmapped(min_mapq: int, longest: int | None) -> Column:
    a, b = C.flag_has(F.col("a.flag"), C.UNMAPPED), C.flag_has(F.col("b.flag"), C.UNMAPPED)
    pick = lambda side: F.when(a, _best("b", side)).otherwise(_best("a", side))
    chrom = F.when(a, F.col("b.chrom")).otherwise(F.col("a.chrom"))
    return _if(_open_pair(min_mapq, longest) & (a != b), F.array(_event(chrom, pick("right"), chrom, pick("left"), F.lit(13))))


def mates_unmapped(pairs: DataFrame, min_mapq: int = 10, longest: int | None = None) -> DataFrame:
    """Code 13: exactly one mate is unmapped; both positions are of the mapped one."""
    return _rows(pairs, _mates_unmapped(min_mapq, longest), TWO)


def _discordants(min_mapq: int, longest: int | None) -> Column:
    a, b = C.flag_has(F.col("a.flag"), C.UNMAPPED), C.flag_has(F.col("b.flag"), C.UNMAPPED)
    code = C.orientation_event(C.flag_has(F.col("a.flag"), C.REVERSE), C.flag_has(F.col("b.flag"), C.REVERSE), C.DISCORDANT_CODES)
    return _if(_open_pair(min_mapq, longest) & (a == b), F.array(_event(F.col("a.chrom"), _best("a", "left"), F.col("b.chrom"), _best("b", "right"), code)))


def discordants(pairs: DataFrame, min_mapq: int = 10, longest: int | None = None) -> DataFrame:
    """Codes 18 to 21: pairs that are not proper, by strands in file order."""
    return _rows(pairs, _discordants(min_mapq, longest), TWO)


def signals(reads: DataFrame, min_len: int = 14, min_mapq: int = 10, nm: int = 10, longest: int | None = None) -> DataFrame:
    """All events (a_chrom, a_pos, b_chrom, b_pos, event), repeats kept; codes 1 to 7 have one position and a null second one.

    Mates are paired once, by one shuffle on the read name, and all events of a pair come out of
    one explode.
    """
    one = [_soft_clips(min_len, min_mapq, False), _insertions(min_len, min_mapq), _high_nm(nm, min_mapq)]
    return _of_pairs(reads, one, ["nm"], min_mapq, longest)


def _of_pairs(reads: DataFrame, one: list[Column], more: list[str], min_mapq: int, longest: int | None) -> DataFrame:
    """All two-position events and those of ``one``, which need the columns ``more``; no other columns are shuffled."""
    narrow = reads.select("qname", "ord", "flag", "chrom", "pos0", "mapq", "cigar", *([] if longest is None else ["tlen"]), "sa", *more)
    pairs = pair_mates(narrow).withColumn("of_pair", F.concat(_mates_unmapped(min_mapq, longest), _discordants(min_mapq, longest)))
    none = F.array().cast(f"array<{EVENT}>")
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("r"), "of_pair"), F.struct(F.col("b").alias("r"), none.alias("of_pair")))).alias("x")).select("x.r.*", "x.of_pair")
    own = F.concat("of_pair", *one, _soft_both(), _cigar_deletions(10, min_mapq), _splits(min_mapq))
    return _rows(_with_ops(each), own, TWO)


def signals_1d(reads: DataFrame, min_len: int = 14, min_mapq: int = 10, nm: int = 10) -> DataFrame:
    """All one-position events (chrom, pos, event), repeats kept.

    They are made before reads meet their mates, so that the shuffle by name carries events and no reads.
    """
    found = F.concat(_soft_clips(min_len, min_mapq, False), _insertions(min_len, min_mapq), _high_nm(nm, min_mapq))
    own = _with_ops(drop_failed(reads)).select("qname", "ord", "chrom", F.transform(found, lambda x: F.struct(x["a_pos"].alias("pos"), x["event"].alias("event"))).alias("found"))
    w = Window.partitionBy("qname").orderBy("ord")
    paired = own.withColumn("has_mate", (F.row_number().over(w) % 2 == 0) | F.lead("ord").over(w).isNotNull())
    return paired.filter("has_mate").select("chrom", F.explode("found").alias("x")).select("chrom", "x.pos", "x.event")


def signals_2d(reads: DataFrame, min_mapq: int = 10, longest: int | None = None) -> DataFrame:
    """All two-position events (a_chrom, a_pos, b_chrom, b_pos, event), repeats kept."""
    return _of_pairs(reads, [], [], min_mapq, longest)
