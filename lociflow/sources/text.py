"""Readers and writers of SAM, BEDPE, BED, FAI, FASTA, VCF and signal text, with fixed schemas.

Positions are 0-based and half open inside; readers and writers convert at the border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.operators.basestore import chunked, with_text
from lociflow.operators.ranges import carry_forward

BEDPE = "chrom1 string, s1 bigint, e1 bigint, chrom2 string, s2 bigint, e2 bigint, svtype string"


def _tab(lines: DataFrame, i: int) -> Column:
    return F.get(F.split("value", "\t"), i)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines in ``value`` and their order in ``ord``: by file, block of the file, and line.

    Spark reads blocks in any order, so blocks are numbered by file and start; there is one row
    for each block in that window, and rows keep their order within a block.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    own = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), row.alias("i"))
    blocks = own.select("f", "b").distinct().withColumn("k", F.row_number().over(Window.orderBy("f", "b")).cast("bigint"))
    return own.join(F.broadcast(blocks), ["f", "b"]).select("value", (F.shiftleft("k", 33) + F.col("i")).alias("ord"))


def parse_sam(rows: DataFrame) -> DataFrame:
    """Reads of SAM lines (value, ord); header lines are left out. POS and PNEXT become 0-based."""
    own = rows.filter("value not like '@%' and value <> ''").withColumn("t", F.split("value", "\t"))
    tag = lambda k: F.regexp_replace(F.get(F.filter(F.slice("t", 12, F.lit(1000)), lambda x: F.startswith(x, F.lit(k))), 0), "^" + k, "")
    t = lambda i: F.get("t", i)
    gone = lambda c, none: F.when(c != none, c)
    return own.select(
        t(0).alias("qname"), "ord", t(1).cast("int").alias("flag"), t(2).alias("chrom"), (t(3).cast("bigint") - 1).alias("pos0"), t(4).cast("int").alias("mapq"), gone(t(5), "*").alias("cigar"),
        F.when(t(6) == "=", t(2)).otherwise(t(6)).alias("next_chrom"), (t(7).cast("bigint") - 1).alias("next_pos0"), t(8).cast("bigint").alias("tlen"),
        tag("NM:i:").cast("int").alias("nm"), tag("SA:Z:").alias("sa"), gone(t(9), "*").alias("seq"), gone(t(10), "*").alias("qual"),
    )


def format_sam(reads: DataFrame) -> DataFrame:
    """SAM lines (value, ord) of reads; sequence and quality are ``*`` where there is none."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    tags = [F.when(F.col("nm").isNotNull(), F.concat(F.lit("NM:i:"), F.col("nm").cast("string"))), F.when(F.col("sa").isNotNull(), F.concat(F.lit("SA:Z:"), "sa"))]
    body = [F.col("qname"), s("flag"), s("chrom"), (F.col("pos0") + 1).cast("string"), s("mapq"), s("cigar"), s("next_chrom"), (F.col("next_pos0") + 1).cast("string"), s("tlen"), *(s(c) if c in reads.columns else F.lit("*") for c in ("seq", "qual"))]
    return reads.select(F.concat_ws("\t", *body, *tags).alias("value"), "ord")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(lines(spark, path))


def parse_bedpe(rows: DataFrame, svtype: str | None = None) -> DataFrame:
    """BEDPE rows; the last column is the type, long names are shortened, INS ends follow their start."""
    t = F.split("value", "\t")
    own = rows.filter("value <> '' and value not like '#%'").select(*( _tab(rows, i).cast(k).alias(n) for i, (n, k) in enumerate((("chrom1", "string"), ("s1", "bigint"), ("e1", "bigint"), ("chrom2", "string"), ("s2", "bigint"), ("e2", "bigint")))), F.element_at(t, -1).alias("svtype"))
    own = own.withColumn("svtype", F.when(F.col("svtype") == "TYPE:DELETION", "DEL").otherwise(F.col("svtype")))
    ins = F.col("svtype") == "INS"
    fixed = {"chrom2": F.col("chrom1"), "s2": F.col("s1") + 1, "e2": F.col("e1") + 1}
    own = own.withColumns({c: F.when(ins, v).otherwise(F.col(c)) for c, v in fixed.items()})
    return own.filter(F.col("svtype") == svtype) if svtype else own


def bedpe_candidates(rows: DataFrame) -> DataFrame:
    """(chrom1, pos1, chrom2, pos2, strands, svtype) of BEDPE lines; strands are unknown."""
    t = lambda i: _tab(rows, i)
    return rows.filter("value <> ''").select(t(0).alias("chrom1"), t(1).cast("bigint").alias("pos1"), t(3).alias("chrom2"), t(4).cast("bigint").alias("pos2"), F.lit("**").alias("strands"), t(6).alias("svtype"))


def bedpe_breakpoints(rows: DataFrame) -> DataFrame:
    """(chrom, l, r, svtype) of rows with both ends on one chromosome. Spark reads gzip by itself."""
    t = lambda i: _tab(rows, i)
    return rows.filter("value <> '' and value not like '#%'").filter(t(0) == t(3)).select(t(0).alias("chrom"), t(1).cast("bigint").alias("l"), t(4).cast("bigint").alias("r"), t(6).alias("svtype"))


def _info(rows: DataFrame) -> DataFrame:
    own = rows.filter("value <> '' and value not like '#%'").withColumn("t", F.split("value", "\t"))
    pairs = F.transform(F.filter(F.split(F.get("t", F.lit(7)), ";"), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    # Of a key that comes twice the first value holds; a map would refuse it.
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    return own.withColumn("info", F.map_from_entries(first))


def vcf_breakpoints(rows: DataFrame) -> DataFrame:
    """(chrom, l, r, svtype, gt) of VCF lines; the genotype only where there is exactly one sample."""
    own = _info(rows)
    gt = F.regexp_replace(F.split(F.get("t", 9), ":")[0], "[|]", "/")
    known = F.when(gt.isin("1/1", "0/1", "0/0"), gt).otherwise("./.")
    return own.select(F.get("t", 0).alias("chrom"), (F.get("t", 1).cast("bigint") - 1).alias("l"), F.element_at("info", "END").cast("bigint").alias("r"), F.element_at("info", "SVTYPE").alias("svtype"), F.when(F.size("t") == 10, known).alias("gt"))


def vcf_confidence(rows: DataFrame) -> DataFrame:
    """(chrom, s1, e1, s2, e2, svtype): intervals of position and end.

    The 95 % interval is taken where the plain one is there too; a remote interval stands in for
    a missing one; none is (0, 0).
    """
    own = _info(rows)

    def pair(plain: str, narrow: str, remote: str) -> Column:
        has = F.map_contains_key("info", F.lit(plain))
        v = F.when(has & F.map_contains_key("info", F.lit(narrow)), F.element_at("info", narrow)).when(has, F.element_at("info", plain)).otherwise(F.coalesce(F.element_at("info", remote), F.lit("0,0")))
        return F.transform(F.split(v, ","), lambda x: x.cast("bigint"))

    a, b, pos, end = pair("CIPOS", "CIPOS95", "CIRPOS"), pair("CIEND", "CIEND95", "CIREND"), F.get("t", 1).cast("bigint"), F.element_at("info", "END").cast("bigint")
    return own.select(F.get("t", 0).alias("chrom"), (pos + a[0]).alias("s1"), (pos + a[1] + 1).alias("e1"), (end + b[0]).alias("s2"), (end + b[1] + 1).alias("e2"), F.element_at("info", "SVTYPE").alias("svtype"))


def parse_bed(rows: DataFrame, ucsc: bool = True) -> DataFrame:
    """(chrom, s, e) of BED lines, chromosomes with or without ``chr``."""
    from lociflow.functions.calls import chrom_plain, chrom_ucsc

    c = (chrom_ucsc if ucsc else chrom_plain)(_tab(rows, 0))
    return rows.filter("value <> '' and value not like '#%' and value not like 'track%'").select(c.alias("chrom"), _tab(rows, 1).cast("bigint").alias("s"), _tab(rows, 2).cast("bigint").alias("e"))


def bed_to_bedpe(bed: DataFrame) -> DataFrame:
    """Deletions as BEDPE with one-base ends and ids ``DEL_n`` in order of chromosome and place."""
    from lociflow.operators.datasets import numbered

    own = numbered(bed, ["chrom", "s", "e"], "n")
    return own.select(F.col("chrom").alias("chrom1"), F.col("s").alias("s1"), (F.col("s") + 1).alias("e1"), F.col("chrom").alias("chrom2"), F.col("e").alias("s2"), (F.col("e") + 1).alias("e2"), F.concat(F.lit("DEL_"), F.col("n").cast("string")).alias("id"))


def parse_fai(rows: DataFrame) -> DataFrame:
    return rows.filter("value <> ''").select(_tab(rows, 0).alias("chrom"), _tab(rows, 1).cast("bigint").alias("len"))


def contigs_minus1(contigs: DataFrame) -> DataFrame:
    """Lengths less one."""
    return contigs.withColumn("len", F.col("len") - 1)


def main_contigs(contigs: DataFrame) -> DataFrame:
    """Chromosomes 1 to 22, X and Y, with or without ``chr``."""
    return contigs.filter(F.regexp_replace("chrom", "^chr", "").isin([str(i) for i in range(1, 23)] + ["X", "Y"]))


def fasta_lines(rows: DataFrame, block: int = 4096) -> DataFrame:
    """(chrom, pos, text) of FASTA lines (value, ord): each line of bases with its 0-based start; ``chunked`` makes a store of them.

    A line's contig is the last header before it, carried forward by blocks of lines. Its start is
    the sum of the lengths before it in its contig, in two levels: by block of lines, then by line,
    so a contig is no single task. Lines before any header and empty ones are left out.
    """
    named = rows.withColumn("head", F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S+)", 1)))
    body = carry_forward(named, "head", "chrom", "ord", block).filter("head is null and chrom is not null and value <> ''")
    own = body.select("chrom", "value", "ord", F.floor(F.col("ord") / block).alias("k"))
    sums = own.groupBy("chrom", "k").agg(F.sum(F.length("value")).alias("n"))
    before = sums.withColumn("base_at", F.coalesce(F.sum("n").over(Window.partitionBy("chrom").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    w = Window.partitionBy("chrom", "k").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("in_block", F.coalesce(F.sum(F.length("value")).over(w), F.lit(0))).join(before, ["chrom", "k"])
    return placed.select("chrom", (F.col("base_at") + F.col("in_block")).alias("pos"), F.col("value").alias("text"))


def parse_fasta(rows: DataFrame, block: int = 4096) -> DataFrame:
    """(chrom, pos, base) of FASTA lines; for whole genomes keep them as lines and make a base store of them."""
    each = fasta_lines(rows, block).select("chrom", "pos", F.posexplode(F.split("text", "")).alias("i", "base"))
    return each.select("chrom", (F.col("pos") + F.col("i")).alias("pos"), "base")


def _base_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and sums of places by contig and base of a batch of lines."""
    for batch in batches:
        chrom = batch.column("chrom").dictionary_encode()
        size = pc.binary_length(batch.column("text").cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64)
        letters = np.frombuffer(b"".join(batch.column("text").cast(pa.binary()).to_pylist()), np.uint8)
        if len(letters) and letters.max() > 127:
            raise ValueError("a line of bases holds letters of several bytes")
        ends = np.cumsum(size)
        own, first = chrom.indices.to_numpy(), batch.column("pos").to_numpy()
        rows = []
        for base in b"ACGTN":
            at = np.flatnonzero(letters == base)
            line = np.searchsorted(ends, at, side="right")
            within = at - (ends - size)[line]
            for i, name in enumerate(chrom.dictionary.to_pylist()):
                here = own[line] == i
                if here.any():
                    rows.append((name, chr(base), int(here.sum()), int((first[line] + within)[here].sum())))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["chrom", "base", "n", "places"])


def base_sums(lines: DataFrame) -> DataFrame:
    """(chrom, base, n, places): how often A, C, G, T and N stand in placed lines, and the sum of their places; lines are of single-byte letters."""
    each = lines.select("chrom", "pos", "text").mapInArrow(_base_sums, "chrom string, base string, n bigint, places bigint")
    return each.groupBy("chrom", "base").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """A base store of the FASTA files at ``path``."""
    return chunked(fasta_lines(lines(spark, path)))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """Contigs of the FAI files at ``path``."""
    return parse_fai(lines(spark, path))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Regions of the BED files at ``path``."""
    return parse_bed(lines(spark, path))


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of the BEDPE files at ``path``."""
    return parse_bedpe(lines(spark, path))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Breakpoints of the VCF files at ``path``."""
    return vcf_breakpoints(lines(spark, path))


def signal_lines(events: DataFrame) -> DataFrame:
    """Tab lines of an event table in its column order; a null is an empty field."""
    return events.select(_tab_line(events.columns).alias("value"))


def _tab_line(columns: list[str]) -> Column:
    return F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def write_signals(events: DataFrame, path: str, keys: list[str]) -> None:
    """Range-dealt and sorted tab text, so that the parts in order are sorted as a whole."""
    dealt = events.repartitionByRange(*keys).sortWithinPartitions(*events.columns)
    signal_lines(dealt).write.option("compression", "gzip").text(path)


def parse_signals(rows: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    return rows.select(*(F.nullif(_tab(rows, i), F.lit("")).cast(k).alias(n) for i, (n, k) in enumerate(schema)))


SIGNALS_1D = [("chrom", "string"), ("pos", "bigint"), ("event", "int")]
SIGNALS_2D = [("a_chrom", "string"), ("a_pos", "bigint"), ("b_chrom", "string"), ("b_pos", "bigint"), ("event", "int")]
#: The two texts of all signals, each a folder of sorted parts.
ONE_PLACE, TWO_PLACES = "soft_and_insertions", "events2d"


def write_all_signals(events: DataFrame, path: str, parts: int | None = None) -> None:
    """Both texts of events of all kinds (a_chrom, a_pos, b_chrom, b_pos, event; codes 1 to 7 have one place).

    They are dealt out by ranges of text and place and sorted by all columns, so the parts of a text in order are
    sorted as a whole; ``parts`` gives the number of ranges (the session's without).
    """
    kind = F.when(F.col("event").between(1, 7), ONE_PLACE).otherwise(TWO_PLACES)
    own, keys = events.withColumn("kind", kind), ["kind", "a_chrom", "a_pos"]
    dealt = own.repartitionByRange(*keys) if parts is None else own.repartitionByRange(parts, *keys)
    dealt = dealt.sortWithinPartitions(*keys, "b_chrom", "b_pos", "event")
    line = F.when(F.col("kind") == ONE_PLACE, _tab_line(["a_chrom", "a_pos", "event"])).otherwise(_tab_line([c for c, _ in SIGNALS_2D]))
    dealt.select("kind", line.alias("value")).write.partitionBy("kind").option("compression", "gzip").text(path)


def read_signal_lines(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value): the lines of both texts."""
    return spark.read.schema("value string, kind string").text(path).select("kind", "value")


def read_all_signals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One-position events, two-position events without discordant pairs, and discordant pairs with places in units of eight bases."""
    from lociflow.operators.windows import DISCORDANT

    rows = read_signal_lines(spark, path)
    one, two = (parse_signals(rows.filter(F.col("kind") == k), s) for k, s in ((ONE_PLACE, SIGNALS_1D), (TWO_PLACES, SIGNALS_2D)))
    far = F.col("event").isin(DISCORDANT)
    return one, two.filter(~far), two.filter(far).withColumns({c: F.shiftright(c, 3) for c in ("a_pos", "b_pos")})


def scored_vcf(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """VCF lines (value, ord) with QUAL rewritten from scores by CHROM and POS; the header stays, records without a score go."""
    from lociflow.operators.callsets import scores_to_calls

    t = F.split("value", "\t")
    own = rows.filter("value not like '#%' and value <> ''").select("ord", t.alias("t"), t[0].alias("chrom"), t[1].cast("bigint").alias("pos"))
    met = scores_to_calls(own, scores)
    body = met.select("ord", F.concat_ws("\t", F.slice("t", 1, 5), F.col("prob").cast("string"), F.slice("t", 7, F.lit(100000))).alias("value"))
    return rows.filter("value like '#%'").select("ord", "value").unionByName(body)


def bedpe_to_vcf(calls: DataFrame, contigs: DataFrame, store: DataFrame) -> DataFrame:
    """VCF 4.2 lines (value, ord) of calls with call_id, chrom1, s1, chrom2, s2, svtype, qual, and a base store.

    Other types give one symbolic record (an insertion ends at its start plus one); TRA and CTX
    give four breakend records that name their mates.
    """
    far = F.col("svtype").isin("TRA", "CTX")
    own = calls
    for k in ("1", "2"):
        own = with_text(own.withColumn("__to", F.col(f"s{k}") + 1), store, f"chrom{k}", f"s{k}", "__to", f"ref{k}").withColumn(f"ref{k}", F.when(F.col(f"ref{k}") == " ", "N").otherwise(F.upper(f"ref{k}"))).drop("__to")
    end = F.when(F.col("svtype") == "INS", F.col("s1") + 2).otherwise(F.col("s2") + 1)
    qual = F.coalesce(F.col("qual").cast("string"), F.lit("1"))
    one = own.filter(~far).select((F.col("call_id") * 4).alias("ord"), F.concat_ws("\t", "chrom1", (F.col("s1") + 1).cast("string"), F.concat(F.lit("sv"), F.col("call_id").cast("string")), "ref1", F.concat(F.lit("<"), "svtype", F.lit(">")), qual, F.lit("PASS"), F.concat(F.lit("SVTYPE="), "svtype", F.lit(";END="), end.cast("string"))).alias("value"))
    p1, p2 = F.concat_ws(":", "chrom1", (F.col("s1") + 1).cast("string")), F.concat_ws(":", "chrom2", (F.col("s2") + 1).cast("string"))
    name = lambda k: F.concat(F.lit("sv"), F.col("call_id").cast("string"), F.lit(f"_{k}"))
    rec = lambda k, chrom, pos, ref, alt, mate: F.struct(F.lit(k).alias("k"), F.concat_ws("\t", chrom, (F.col(pos) + 1).cast("string"), name(k + 1), ref, alt, qual, F.lit("PASS"), F.concat(F.lit("SVTYPE=BND;MATEID="), name(mate))).alias("v"))
    bnd = F.array(
        rec(0, "chrom1", "s1", "ref1", F.concat("ref1", F.lit("["), p2, F.lit("[")), 2), rec(1, "chrom2", "s2", "ref2", F.concat(F.lit("]"), p1, F.lit("]"), "ref2"), 1),
        rec(2, "chrom1", "s1", "ref1", F.concat(F.lit("]"), p2, F.lit("]"), "ref1"), 4), rec(3, "chrom2", "s2", "ref2", F.concat("ref2", F.lit("["), p1, F.lit("[")), 3),
    )
    four = own.filter(far).select("call_id", F.explode(bnd).alias("x")).select((F.col("call_id") * 4 + F.col("x.k")).alias("ord"), F.col("x.v").alias("value"))
    head = contigs.select(F.lit(-2).cast("bigint").alias("ord"), F.concat(F.lit("##contig=<ID="), "chrom", F.lit(",length="), F.col("len").cast("string"), F.lit(">")).alias("value"))
    spark = calls.sparkSession
    frame = spark.createDataFrame([(-3, "##fileformat=VCFv4.2"), (-1, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")], "ord bigint, value string")
    return frame.unionByName(head).unionByName(one).unionByName(four)


def vcf_to_bedpe(ends: DataFrame, least: int = 50, types: list[str] | None = None) -> DataFrame:
    """BEDPE rows of typed breakends: size of at least ``least`` or CTX, one of an inversion's two, and only ``types`` if given."""
    own = ends.filter((F.abs("sv_len") >= least) | (F.col("svtype") == "CTX")).filter((F.col("svtype") != "INV") | F.col("end_id").rlike("_bp1$"))
    own = own.filter(F.col("svtype").isin(types)) if types else own
    return own.select("chrom1", F.col("start").alias("s1"), (F.col("start") + 1).alias("e1"), "chrom2", F.col("partner").alias("s2"), (F.col("partner") + 1).alias("e2"), "svtype")


def prediction_bedpe(scored: DataFrame, correct: bool) -> DataFrame:
    """(chrom1, s1, e1, chrom2, s2, e2, text, score) of scored rows: wrong ones, or all with ``correct``.

    ``text`` tells prediction and truth and ends in a running number by place.
    """
    from lociflow.operators.datasets import numbered

    own = scored if correct else scored.filter("pred <> y")
    own = numbered(own, ["chrom", "l", "r", "call_id"], "n")
    text = F.concat(F.lit("PRED:"), F.col("pred").cast("string"), F.lit("_TRUE:"), F.col("y").cast("string"), F.lit("_"), F.col("n").cast("string"))
    return own.select(F.col("chrom").alias("chrom1"), F.col("l").alias("s1"), (F.col("l") + 1).alias("e1"), F.col("chrom").alias("chrom2"), F.col("r").alias("s2"), (F.col("r") + 1).alias("e2"), text.alias("text"), "score")
