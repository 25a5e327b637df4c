"""Expressions on calls, windows, names, bases and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Long type names.
LONG_TYPES = {"DELETION": "DEL", "INSERTION": "INS", "INVERSION": "INV"}
PACKAGE_BASES, GENOME_BASES = "ACTGN", "ATCGN"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def window_id(chrom1, pos1, chrom2, pos2, strand, svtype) -> Column:
    return F.concat_ws("/", *(_c(x).cast("string") for x in (chrom1, pos1, chrom2, pos2, strand, svtype)))


def window_id_parts(window: Column | str) -> Column:
    """(chrom1, pos1, chrom2, pos2, rest); ids of fewer parts give null."""
    p = F.split(_c(window), "/", 5)
    return F.when(F.size(p) >= 5, F.struct(p[0].alias("chrom1"), p[1].cast("bigint").alias("pos1"), p[2].alias("chrom2"), p[3].cast("bigint").alias("pos2"), p[4].alias("rest")))


def sv_id(svtype, chrom1, s1, chrom2, s2) -> Column:
    return F.concat_ws("/", *(_c(x).cast("string") for x in (svtype, chrom1, s1, chrom2, s2)))


def svtype_normalise(svtype: Column | str) -> Column:
    """Short upper-case type: drops ``TYPE:``, keeps what follows an underscore, shortens long names."""
    t = F.upper(F.regexp_replace(_c(svtype), "^TYPE:", ""))
    t = F.when(F.contains(t, F.lit("_")), F.split(t, "_")[1]).otherwise(t)
    for long, short in LONG_TYPES.items():
        t = F.when(t == long, short).otherwise(t)
    return t


def bnd_alt(ref: Column | str, alt: Column | str) -> Column:
    """(connection, chrom2, pos2, inserted) of a breakend ALT; other texts give null.

    ``t[p[`` joins 3' to 5', ``t]p]`` 3' to 3', ``]p]t`` 5' to 3', ``[p[t`` 5' to 5'.
    """
    alt, ref = _c(alt), _c(ref)
    mate = r"[\[\]](.+):([0-9]+)[\[\]]"
    ahead = F.regexp_extract(alt, r"^([A-Za-z.]+)[\[\]]", 1)
    behind = F.regexp_extract(alt, r"[\[\]]([A-Za-z.]+)$", 1)
    kind = F.when(alt.rlike(r"^[A-Za-z.]+\["), "3to5").when(alt.rlike(r"^[A-Za-z.]+\]"), "3to3").when(alt.rlike(r"^\]"), "5to3").when(alt.rlike(r"^\["), "5to5")
    return F.when(alt.rlike(mate), F.struct(kind.alias("connection"), F.regexp_extract(alt, mate, 1).alias("chrom2"), F.regexp_extract(alt, mate, 2).cast("bigint").alias("pos2"), (F.length(F.concat(ahead, behind)) - F.length(ref)).alias("inserted")))


def genotype_text(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return F.when((a == 1) & (b == 1), "1/1").when((a == 0) & (b == 1), "0/1").when((a == 0) & (b == 0), "0/0").otherwise("./.")


def chrom_plain(chrom: Column | str) -> Column:
    """Without a ``chr`` prefix; ``M`` becomes ``MT``."""
    c = F.regexp_replace(_c(chrom), "^chr", "")
    return F.when(c == "M", "MT").otherwise(c)


def chrom_ucsc(chrom: Column | str) -> Column:
    """With a ``chr`` prefix; ``MT`` becomes ``chrM``."""
    c = F.regexp_replace(_c(chrom), "^chr", "")
    return F.concat(F.lit("chr"), F.when(c == "MT", "M").otherwise(c))


def base_one_hot(base: Column | str, order: str = PACKAGE_BASES, compat: bool = False) -> Column:
    """Array of 0/1 by base order; case matters only with ``compat``."""
    b = _c(base) if compat else F.upper(_c(base))
    return F.array(*(F.coalesce(b == x, F.lit(False)).cast("int") for x in order))


def base_complement(base: Column | str) -> Column:
    return F.translate(_c(base), "ACGTacgt", "TGCAtgca")


def signif(x: Column | str, digits: int = 4) -> Column:
    """Rounded to significant digits; zero stays zero."""
    x = _c(x).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def percent(x: Column | str) -> Column:
    return signif(x) * 100


def prob_margin(p_sv: Column | str, p_other: Column | str) -> Column:
    return _c(p_sv) - _c(p_other)


def discordant_compress(pos: Column | str) -> Column:
    return F.shiftright(_c(pos), 3)


def infer_svtype(chrom1, chrom2, start, partner, strand, partner_strand, ins_len, sv_len) -> Column:
    """Type by breakend geometry; the first rule that fits decides."""
    return (
        F.when(_c(chrom1) != _c(chrom2), "CTX")
        .when(_c(ins_len) >= 0.7 * F.abs(_c(sv_len)), "INS")
        .when(_c(strand) == _c(partner_strand), "INV")
        .when((_c(start) < _c(partner)) != (_c(strand) == "-"), "DEL")
        .otherwise("DUP")
    )


def infer_svtype_ct(declared, chrom1, chrom2, start, end, ct, alt) -> Column:
    """Type by connection text: BP across chromosomes, INS where ALT's text is 0.7 of the size or longer, INV, DEL, else as declared.

    The size counts both ends, and a symbolic ALT's text counts like any other.
    """
    size = F.abs(_c(end) - _c(start) + 1)
    return (
        F.when(_c(chrom1) != _c(chrom2), "BP")
        .when(F.length(_c(alt)) >= 0.7 * size, "INS")
        .when(_c(ct).isin("5to5", "3to3"), "INV")
        .when((_c(start) < _c(end)) != _c(ct).isin("5to3", "3to5"), "DEL")
        .otherwise(_c(declared))
    )


def qual_proxy(caller, qual, su, sr, pe) -> Column:
    """QUAL of callers that give none: supporting reads."""
    return F.when(_c(caller) == "lumpy", _c(su)).when(_c(caller) == "delly", F.coalesce(_c(sr), F.lit(0)) + F.coalesce(_c(pe), F.lit(0))).otherwise(_c(qual))
