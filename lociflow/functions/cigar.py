"""CIGAR and read-flag expressions: plain functions that return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the alignment format.
CONSUMES_REFERENCE = ["M", "D", "N", "=", "X"]
ALIGNED = ["M", "=", "X"]
CLIPS = ["S", "H"]
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 1, 2, 4, 8, 16, 32
READ1, READ2, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 64, 128, 256, 512, 1024, 2048
FAIL = SECONDARY | QCFAIL | DUPLICATE | SUPPLEMENTARY


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag_has(flag: Column | str, bits: int) -> Column:
    """Whether any of ``bits`` is set."""
    return _c(flag).bitwiseAND(F.lit(bits)) != 0


def cigar_ops(cigar: Column | str, pos0: Column | str) -> Column:
    """Array of (op, len, ref_start); a null CIGAR gives null."""
    cigar, pos0 = _c(cigar), _c(pos0)
    raw = F.transform(
        F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)),
        lambda t: F.struct(F.substring(t, -1, 1).alias("op"), F.substring(t, F.lit(1), F.length(t) - 1).cast("int").alias("len")),
    )
    empty = F.expr("cast(array() as array<struct<op:string,len:int,ref_start:bigint>>)")
    start = F.struct(pos0.cast("bigint").alias("at"), empty.alias("ops"))
    done = F.aggregate(
        raw,
        start,
        lambda acc, r: F.struct(
            (acc["at"] + F.when(r["op"].isin(CONSUMES_REFERENCE), r["len"]).otherwise(0)).alias("at"),
            F.array_append(acc["ops"], F.struct(r["op"].alias("op"), r["len"].alias("len"), acc["at"].alias("ref_start"))).alias("ops"),
        ),
    )
    # A single operation, as most reads have, takes no lambdas.
    one = F.array(F.struct(F.substring(cigar, -1, 1).alias("op"), _number(cigar).cast("int").alias("len"), pos0.cast("bigint").alias("ref_start")))
    return F.when(cigar.rlike(r"^\d+[MIDNSHP=X]$"), one).otherwise(done["ops"])


def _number(cigar: Column) -> Column:
    """The digits before the last letter of a single operation."""
    return F.substring(cigar, F.lit(1), F.length(cigar) - 1)


def _sum(cigar: Column, ops: list[str]) -> Column:
    """Total length of the given operations, from the text alone."""
    kinds = "".join(ops)
    several = F.aggregate(F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{kinds}]"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return F.when(cigar.rlike(rf"^\d+[{kinds}]$"), _number(cigar).cast("bigint")).otherwise(several)


def cigar_consumed(cigar: Column | str) -> Column:
    """Reference bases that a CIGAR covers: M, D, N, = and X."""
    return _sum(_c(cigar), CONSUMES_REFERENCE)


def cigar_ref_end(pos: Column | str, cigar: Column | str) -> Column:
    return _c(pos) + cigar_consumed(cigar)


def aligned_blocks(cigar: Column | str, pos0: Column | str) -> Column:
    """Gap-free blocks (s, e), half open."""
    return F.transform(F.filter(cigar_ops(cigar, pos0), lambda o: o["op"].isin(ALIGNED)), lambda o: F.struct(o["ref_start"].alias("s"), (o["ref_start"] + o["len"]).alias("e")))


def is_left_clipped(cigar: Column | str) -> Column:
    return F.coalesce(_c(cigar).rlike(r"^\d+[SH]"), F.lit(False))


def is_right_clipped(cigar: Column | str) -> Column:
    return F.coalesce(_c(cigar).rlike(r"[SH]$"), F.lit(False))


def is_clipped(cigar: Column | str) -> Column:
    return is_left_clipped(cigar) | is_right_clipped(cigar)


def several_ops(cigar: Column | str) -> Column:
    return F.coalesce(_c(cigar).rlike(r"^\d+[^0-9]\d+"), F.lit(False))


def soft_left(cigar: Column | str, mapq: Column | str, min_mapq: int = 10) -> Column:
    """First operation S of several, and the read maps well enough."""
    return F.coalesce((_c(mapq) >= min_mapq) & several_ops(cigar) & _c(cigar).rlike(r"^\d+S"), F.lit(False))


def soft_right(cigar: Column | str, mapq: Column | str, min_mapq: int = 10) -> Column:
    return F.coalesce((_c(mapq) >= min_mapq) & several_ops(cigar) & _c(cigar).rlike(r"S$"), F.lit(False))


def best_position(side: str, start: Column, end: Column, left_soft: Column, right_soft: Column, several: Column) -> Column:
    """A soft-clipped end if there is one (the left first), else the end that faces the mate."""
    return F.when(several & left_soft, start).when(several & right_soft, end).otherwise(start if side == "right" else end)


def has_indels(cigar: Column | str) -> Column:
    return F.coalesce(_c(cigar).rlike("[ID]"), F.lit(False))


def get_indels(cigar: Column | str, pos0: Column | str, least: int = 50, compat: bool = False) -> Column:
    """Array of (kind, s, e) of deletions and insertions of at least ``least`` bases.

    Positions advance over every reference-consuming operation; with ``compat`` they stay
    where they were over deletions that are themselves reported and over skipped regions.
    """
    ops = cigar_ops(cigar, pos0)
    if compat:
        stays = F.filter(ops, lambda o: (o["op"] == "N") | ((o["op"] == "D") & (o["len"] >= least)))
        back = lambda o: F.aggregate(F.filter(stays, lambda p: p["ref_start"] < o["ref_start"]), F.lit(0).cast("bigint"), lambda a, p: a + p["len"])
    else:
        back = lambda o: F.lit(0).cast("bigint")
    big = F.filter(ops, lambda o: o["op"].isin("I", "D") & (o["len"] >= least))
    found = F.transform(
        big,
        lambda o: F.struct(
            F.when(o["op"] == "D", "DEL").otherwise("INS").alias("kind"),
            (o["ref_start"] - back(o) + F.when(o["op"] == "D", 1).otherwise(0)).alias("s"),
            (o["ref_start"] - back(o) + F.when(o["op"] == "D", o["len"]).otherwise(0)).alias("e"),
        ),
    )
    # Most reads hold no number of so many digits before I or D; their operations need not be laid out.
    return F.when(_c(cigar).rlike(rf"\d{{{len(str(max(least, 1)))},}}[ID]"), found).when(_c(cigar).isNotNull(), F.expr("cast(array() as array<struct<kind:string,s:bigint,e:bigint>>)"))


def sa_list(sa: Column | str) -> Column:
    """Array of (rname, pos, strand, cigar, mapq, nm) of an SA tag's entries."""
    return F.transform(
        F.filter(F.split(_c(sa), ";"), lambda t: t != ""),
        lambda t: F.struct(
            F.split(t, ",")[0].alias("rname"), F.split(t, ",")[1].cast("bigint").alias("pos"), F.split(t, ",")[2].alias("strand"),
            F.split(t, ",")[3].alias("cigar"), F.split(t, ",")[4].cast("int").alias("mapq"), F.split(t, ",")[5].cast("int").alias("nm"),
        ),
    )


def sa_first(sa: Column | str, min_mapq: int = 10) -> Column:
    """(rname, pos0, strand) of the first SA entry; null if it maps below ``min_mapq``."""
    first = F.get(sa_list(sa), 0)
    return F.when(first["mapq"] >= min_mapq, F.struct(first["rname"].alias("rname"), (first["pos"] - 1).alias("pos0"), first["strand"].alias("strand")))


def proper_pair(flag: Column | str, tlen: Column | str, longest: Column | int | None = None) -> Column:
    """Proper bit, and an insert of at most ``longest`` where one is given."""
    proper = flag_has(flag, PROPER)
    if longest is None:
        return proper
    limit = F.lit(longest) if isinstance(longest, int) else longest
    return proper & (limit.isNull() | (F.abs(_c(tlen)) <= limit))


def is_properly_mapped(chrom: Column | str, next_chrom: Column | str, flag: Column | str) -> Column:
    """Mate on the same chromosome and the opposite strand."""
    return (_c(chrom) == _c(next_chrom)) & (flag_has(flag, REVERSE) != flag_has(flag, MATE_REVERSE))


def is_discordant_isize(pos: Column | str, next_pos: Column | str, mean: float, sd: float) -> Column:
    """Not downstream within mean plus sd; a mate upstream is always discordant."""
    d = _c(next_pos) - _c(pos)
    return ~((d > 0) & (d <= mean + sd))


#: Event codes by strand pair (reverse a, reverse b).
SPLIT_CODES = {(False, False): 14, (True, True): 15, (True, False): 16, (False, True): 17}
DISCORDANT_CODES = {(False, True): 18, (False, False): 19, (True, True): 20, (True, False): 21}


def orientation_event(rev_a: Column, rev_b: Column, codes: dict[tuple[bool, bool], int]) -> Column:
    """Event code of a strand pair."""
    out = F.lit(None).cast("int")
    for (a, b), code in codes.items():
        out = F.when((rev_a == a) & (rev_b == b), code).otherwise(out)
    return out


def event_is_orphanable(event: Column | str) -> Column:
    return _c(event).between(14, 21)
