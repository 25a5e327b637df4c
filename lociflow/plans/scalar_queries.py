"""Queries of the scalar functions and row filters, over the fixture reads and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociflow.functions import calls as X
from lociflow.functions import cigar as C
from lociflow.operators import basestore, callsets, reads
from lociflow.plans.fixtures import DUCK_BASES, with_ctes
from lociflow.plans.registry import query

R, K = with_ctes("reads"), with_ctes("cand")
#: Reads by CIGAR operation, and reads with their end.
OPS = (
    R + """,
ops AS (SELECT qname, ord, flag, chrom, pos0, mapq, nm, i, CAST(regexp_extract(x, '[0-9]+') AS INT) AS len, substr(x, length(x), 1) AS op FROM
  (SELECT *, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (SELECT *, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS xs FROM reads))),
opr AS (SELECT *, CAST(pos0 + coalesce(sum(CASE WHEN op IN ('M','D','N','=','X') THEN len ELSE 0 END) OVER (PARTITION BY qname, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ref_start FROM ops)"""
)
ENDS = (
    R + """,
rd AS (SELECT *, CASE WHEN cigar IS NOT NULL THEN CAST(coalesce(list_sum([CAST(v AS BIGINT) FOR v IN regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1)]), 0) AS BIGINT) END AS consumed FROM reads)"""
)
KEY = "qname, ord"


def one(name: str, column, sql: str, base: str = R, source: str = "reads"):
    """A query of one expression by read."""

    @query(name, f"{base}\nSELECT qname, ord, {sql} AS v FROM {source}")
    def run(fx):
        return fx.reads.select("qname", "ord", column().alias("v"))


def call(name: str, column, sql: str):
    """A query of one expression by call."""

    @query(name, f"{K}\nSELECT call_id, {sql} AS v FROM cand")
    def run(fx):
        return fx.cand.select("call_id", column().alias("v"))


@query("cigar_ops", f"{OPS}\nSELECT qname, ord, i, op, len, ref_start FROM opr")
def cigar_ops(fx):
    own = fx.reads.select("qname", "ord", F.posexplode(C.cigar_ops("cigar", "pos0")).alias("i", "o"))
    return own.select("qname", "ord", (F.col("i") + 1).cast("bigint").alias("i"), "o.op", "o.len", "o.ref_start")


@query("aligned_blocks", f"{OPS}\nSELECT qname, ord, ref_start AS s, ref_start + len AS e FROM opr WHERE op IN ('M','=','X')")
def aligned_blocks(fx):
    return fx.reads.select("qname", "ord", F.explode(C.aligned_blocks("cigar", "pos0")).alias("b")).select("qname", "ord", "b.s", "b.e")


one("cigar_ref_end", lambda: C.cigar_ref_end("pos0", "cigar"), "pos0 + consumed", ENDS, "rd")
one("cigar_consumed", lambda: C.cigar_consumed("cigar"), "consumed", ENDS, "rd")
one("is_left_clipped", lambda: C.is_left_clipped("cigar"), "coalesce(regexp_matches(cigar, '^[0-9]+[SH]'), false)")
one("is_right_clipped", lambda: C.is_right_clipped("cigar"), "coalesce(regexp_matches(cigar, '[SH]$'), false)")
one("is_clipped", lambda: C.is_clipped("cigar"), "coalesce(regexp_matches(cigar, '^[0-9]+[SH]|[SH]$'), false)")
one("soft_left", lambda: C.soft_left("cigar", "mapq"), "coalesce(mapq >= 10 AND regexp_matches(cigar, '^[0-9]+S[0-9]'), false)")
one("soft_right", lambda: C.soft_right("cigar", "mapq"), "coalesce(mapq >= 10 AND regexp_matches(cigar, '[A-Z=][0-9]+S$'), false)")
one(
    "best_position",
    lambda: C.best_position("left", F.col("pos0"), C.cigar_ref_end("pos0", "cigar"), F.coalesce(F.col("cigar").rlike(r"^\d+S"), F.lit(False)), F.coalesce(F.col("cigar").rlike("S$"), F.lit(False)), C.several_ops("cigar")),
    "CASE WHEN coalesce(regexp_matches(cigar, '^[0-9]+S[0-9]'), false) THEN pos0 ELSE pos0 + consumed END", ENDS, "rd",
)
one("has_indels", lambda: C.has_indels("cigar"), "coalesce(regexp_matches(cigar, '[ID]'), false)")
one("sa_first", lambda: C.sa_first("sa")["pos0"], "CASE WHEN CAST(string_split(sa, ',')[5] AS INT) >= 10 THEN CAST(string_split(sa, ',')[2] AS BIGINT) - 1 END")
one("flag_has", lambda: C.flag_has("flag", C.FAIL), "(flag & 3840) <> 0")
one("proper_pair", lambda: C.proper_pair("flag", "tlen", 500), "(flag & 2) <> 0 AND abs(tlen) <= 500")
one("is_properly_mapped", lambda: C.is_properly_mapped("chrom", "next_chrom", "flag"), "chrom = next_chrom AND ((flag & 16) <> 0) <> ((flag & 32) <> 0)")
one("is_discordant_isize", lambda: C.is_discordant_isize("pos0", "next_pos0", 400.0, 100.0), "NOT (next_pos0 - pos0 > 0 AND next_pos0 - pos0 <= 500)")
one("orientation_event", lambda: C.orientation_event(C.flag_has("flag", 16), C.flag_has("flag", 32), C.DISCORDANT_CODES), "CASE WHEN (flag & 16) <> 0 AND (flag & 32) <> 0 THEN 20 WHEN (flag & 16) <> 0 THEN 21 WHEN (flag & 32) <> 0 THEN 18 ELSE 19 END")
one("event_is_orphanable", lambda: C.event_is_orphanable(F.col("nm")), "nm BETWEEN 14 AND 21")
one("discordant_compress", lambda: X.discordant_compress("pos0"), "CAST(floor(pos0 / 8.0) AS BIGINT)")
one("chrom_normalise", lambda: X.chrom_plain(X.chrom_ucsc("chrom")), "chrom")
one("genotype_text", lambda: X.genotype_text(F.col("nm") % 3, F.col("nm") % 2), "CASE WHEN nm % 3 = 1 AND nm % 2 = 1 THEN '1/1' WHEN nm % 3 = 0 AND nm % 2 = 1 THEN '0/1' WHEN nm % 3 = 0 AND nm % 2 = 0 THEN '0/0' ELSE './.' END")


@query("get_indels", f"{OPS}\nSELECT qname, ord, CASE op WHEN 'D' THEN 'DEL' ELSE 'INS' END AS kind, ref_start + CASE op WHEN 'D' THEN 1 ELSE 0 END AS s, ref_start + CASE op WHEN 'D' THEN len ELSE 0 END AS e FROM opr WHERE op IN ('I','D') AND len >= 16")
def get_indels(fx):
    return fx.reads.select("qname", "ord", F.explode(C.get_indels("cigar", "pos0", 16)).alias("i")).select("qname", "ord", "i.kind", "i.s", "i.e")


@query("sa_list", f"{R}\nSELECT qname, ord, x[1] AS rname, CAST(x[2] AS BIGINT) AS pos, x[3] AS strand, x[4] AS cigar, CAST(x[5] AS INT) AS mapq, CAST(x[6] AS INT) AS nm FROM (SELECT qname, ord, string_split(replace(sa, ';', ''), ',') AS x FROM reads WHERE sa IS NOT NULL)")
def sa_list(fx):
    return fx.reads.select("qname", "ord", F.explode(C.sa_list("sa")).alias("s")).select("qname", "ord", "s.*")


call("window_id_encode", lambda: X.window_id("chrom", "l", "chrom", "r", F.lit("**"), "svtype"), "concat(chrom, '/', CAST(l AS VARCHAR), '/', chrom, '/', CAST(r AS VARCHAR), '/**/', svtype)")
call("window_id_decode", lambda: X.window_id_parts(X.window_id("chrom", "l", "chrom", "r", F.lit("**"), "svtype"))["pos2"], "r")
call("sv_id_encode", lambda: X.sv_id("svtype", "chrom", "l", "chrom", "r"), "concat(svtype, '/', chrom, '/', CAST(l AS VARCHAR), '/', chrom, '/', CAST(r AS VARCHAR))")
call("svtype_normalise", lambda: X.svtype_normalise(F.when(F.col("svtype") == "DEL", "TYPE:DELETION").when(F.col("svtype") == "INV", "inversion").otherwise(F.concat(F.lit("x_"), "svtype"))), "svtype")
call("signif4", lambda: F.round(X.signif(F.col("qual") / 7.0), 9), "CASE WHEN qual = 0 THEN 0 ELSE round(round(qual / 7.0 * pow(10, 3 - floor(log10(qual / 7.0)))) / pow(10, 3 - floor(log10(qual / 7.0))), 9) END")
call("make_percent", lambda: F.round(X.percent(F.col("qual") / 1000.0), 9), "CASE WHEN qual = 0 THEN 0 ELSE round(round(qual / 1000.0 * pow(10, 3 - floor(log10(qual / 1000.0)))) / pow(10, 3 - floor(log10(qual / 1000.0))) * 100, 9) END")
call("prob_margin", lambda: F.round(X.prob_margin(F.col("qual") / 1000.0, 1 - F.col("qual") / 1000.0), 6), "round(qual / 1000.0 - (1 - qual / 1000.0), 6)")
call("qual_proxy", lambda: X.qual_proxy(F.when(F.col("caller") == "A", "lumpy").when(F.col("caller") == "B", "delly").otherwise("C"), F.col("qual"), F.col("qual") % 10, F.when(F.col("qual") % 2 == 0, F.col("qual") % 7), F.col("qual") % 5),
     "CASE caller WHEN 'A' THEN qual % 10 WHEN 'B' THEN CASE WHEN qual % 2 = 0 THEN qual % 7 ELSE 0 END + qual % 5 ELSE qual END")
INFER = "CASE WHEN call_id % 50 = 0 THEN 'CTX' WHEN qual % 90 >= 0.7 * (r - l) THEN 'INS' WHEN call_id % 3 = 0 THEN 'INV' WHEN (l < r) <> (call_id % 9 = 1) THEN 'DEL' ELSE 'DUP' END"
call("svtype_infer", lambda: X.infer_svtype(F.lit("12"), F.when(F.col("call_id") % 50 == 0, "22").otherwise("12"), "l", "r", F.when(F.col("call_id") % 9 == 1, "-").otherwise("+"), F.when((F.col("call_id") % 3 == 0) == (F.col("call_id") % 9 == 1), "-").otherwise("+"), F.col("qual") % 90, F.col("r") - F.col("l")), INFER)
CT = ("5to5", "3to3", "3to5", "5to3", "none")
call("svtype_infer_py", lambda: X.infer_svtype_ct("svtype", F.lit("1"), F.when(F.col("call_id") % 50 == 0, "2").otherwise("1"), "l", "r", F.element_at(F.array(*(F.lit(x) for x in CT)), (F.col("call_id") % 5 + 1).cast("int")), F.when(F.col("qual") % 5 == 0, F.lit("<DEL>")).otherwise(F.rpad(F.lit("A"), F.col("qual").cast("int") + 1, "C"))),
     "CASE WHEN call_id % 50 = 0 THEN 'BP' WHEN CASE WHEN qual % 5 = 0 THEN 5 ELSE qual + 1 END >= 0.7 * (r - l + 1) THEN 'INS' WHEN call_id % 5 < 2 THEN 'INV' WHEN (l < r) <> (call_id % 5 < 4) THEN 'DEL' ELSE svtype END")


@query("bnd_alt_parse", f"{K}\nSELECT call_id, '3to3' AS connection, chrom AS chrom2, r AS pos2, 0 AS inserted FROM cand")
def bnd_alt_parse(fx):
    alt = F.concat(F.lit("N]"), "chrom", F.lit(":"), F.col("r").cast("string"), F.lit("]"))
    return fx.cand.select("call_id", X.bnd_alt(F.lit("N"), alt).alias("b")).select("call_id", "b.*")


@query("base_one_hot", f"SELECT chrom, CAST(sum(CASE base WHEN 'A' THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE base WHEN 'C' THEN 1 ELSE 0 END) AS BIGINT) AS c, CAST(sum(CASE base WHEN 'N' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM ({DUCK_BASES}) GROUP BY chrom")
def base_one_hot(fx):
    own = fx.bases.select("chrom", X.base_one_hot("base").alias("o"))
    return own.groupBy("chrom").agg(F.sum(F.col("o")[0]).alias("a"), F.sum(F.col("o")[1]).alias("c"), F.sum(F.col("o")[4]).alias("n"))


@query("base_complement", f"SELECT chrom, translate(base, 'ACGT', 'TGCA') AS v, count(*) AS n FROM ({DUCK_BASES}) GROUP BY ALL")
def base_complement(fx):
    return fx.bases.groupBy("chrom", X.base_complement("base").alias("v")).agg(F.count("*").alias("n"))


@query("flanked_by_n", f"{K}, b AS ({DUCK_BASES})\nSELECT call_id, coalesce(max(CAST(base = 'N' AS INT)), 0) = 1 AS v FROM (SELECT call_id, chrom, unnest([l - 1, l]) AS pos FROM cand) LEFT JOIN b USING (chrom, pos) GROUP BY call_id")
def flanked_by_n(fx):
    return basestore.flanked_by_n(fx.cand, fx.store).select("call_id", F.col("n_beside").alias("v"))


READ_COLUMNS = "qname, ord, flag, chrom, pos0, mapq"


@query("flt_read_fail", f"{R}\nSELECT {READ_COLUMNS} FROM reads WHERE (flag & 3840) = 0")
def flt_read_fail(fx):
    return reads.drop_failed(fx.reads).select(*READ_COLUMNS.split(", "))


@query("flt_min_mapq", f"{R}\nSELECT {READ_COLUMNS} FROM reads WHERE (flag & 4) = 0 AND mapq >= 30")
def flt_min_mapq(fx):
    return reads.min_mapq(fx.reads, 30).select(*READ_COLUMNS.split(", "))


@query("flt_candidate_bounds", f"{K}\nSELECT call_id, chrom, least(l, r) AS l, greatest(l, r) AS r FROM cand WHERE least(l, r) >= 5000 AND greatest(l, r) < (SELECT len FROM span) - 5000")
def flt_candidate_bounds(fx):
    return callsets.in_bounds(fx.cand, fx.contigs, 5000).select("call_id", "chrom", "l", "r")


@query("flt_candidate_window", f"{K}\nSELECT call_id, chrom, l, r FROM cand WHERE l BETWEEN 9000 AND (SELECT len - 9000 FROM span) AND r BETWEEN 9000 AND (SELECT len - 9000 FROM span)")
def flt_candidate_window(fx):
    return callsets.in_window(fx.cand, fx.contigs, 9000).select("call_id", "chrom", "l", "r")


@query("flt_dedup_first", f"{K}\nSELECT call_id, chrom, svtype FROM (SELECT *, row_number() OVER (PARTITION BY chrom, l % 500 ORDER BY call_id) AS n FROM cand) WHERE n = 1")
def flt_dedup_first(fx):
    return callsets.first_of(fx.cand.withColumn("k", F.col("l") % 500), ["chrom", "k"], "call_id").select("call_id", "chrom", "svtype")


@query("flt_chrom_allow", f"{K}\nSELECT call_id, chrom FROM cand WHERE call_id % 11 <> 0 AND call_id % 13 <> 0")
def flt_chrom_allow(fx):
    """Both ends on one of chr1 to chr22: some calls are moved to X, of some the second end."""
    ends = fx.cand.select("call_id", F.when(F.col("call_id") % 11 == 0, "X").otherwise(F.col("chrom")).alias("chrom1"), F.when(F.col("call_id") % 13 == 0, "7").when(F.col("call_id") % 11 == 0, "X").otherwise(F.col("chrom")).alias("chrom2"))
    return callsets.on_chroms(ends, [str(i) for i in range(1, 23)]).select("call_id", F.col("chrom1").alias("chrom"))


@query("flt_pass", f"{K}\nSELECT call_id FROM cand WHERE qual % 3 = 0")
def flt_pass(fx):
    own = fx.cand.withColumn("filter", F.when(F.col("qual") % 3 == 0, F.when(F.col("qual") % 2 == 0, "PASS").otherwise(".")).otherwise("LowQual"))
    return own.filter(F.col("filter").isin("PASS", ".")).select("call_id")


@query("flt_svtype_size", f"{K}\nSELECT call_id, svtype FROM cand WHERE svtype = 'DEL' AND r - l >= 700")
def flt_svtype_size(fx):
    big = (F.abs(F.col("r") - F.col("l")) >= 700) | F.col("svtype").isin("TRA", "CTX", "INS")
    return fx.cand.filter((F.col("svtype") == "DEL") & big).select("call_id", "svtype")


@query("flt_partner_present", f"{K}, e AS (SELECT call_id AS end_id, call_id + CASE WHEN call_id % 40 = 0 THEN 20 ELSE -20 END AS partner_id FROM cand WHERE qual > 300)\nSELECT end_id, partner_id FROM e WHERE partner_id IN (SELECT end_id FROM e)")
def flt_partner_present(fx):
    ends = fx.cand.filter("qual > 300").select(F.col("call_id").alias("end_id"), (F.col("call_id") + F.when(F.col("call_id") % 40 == 0, 20).otherwise(-20)).alias("partner_id"))
    return callsets.keep_partnered(ends)


@query("flt_qual_cut", f"{K}, e AS (SELECT call_id AS end_id, call_id + CASE WHEN call_id % 40 = 0 THEN 20 ELSE -20 END AS partner_id, qual FROM cand WHERE qual / 1000.0 > 0.5)\nSELECT end_id, partner_id, qual FROM e WHERE partner_id IN (SELECT end_id FROM e)")
def flt_qual_cut(fx):
    ends = fx.cand.select(F.col("call_id").alias("end_id"), (F.col("call_id") + F.when(F.col("call_id") % 40 == 0, 20).otherwise(-20)).alias("partner_id"), "qual")
    return callsets.cut_by_qual(ends, 500)


@query("flt_test_chrom", f"{with_ctes('cand', 'truth')}\nSELECT 'call' AS kind, call_id AS id, chrom FROM cand WHERE chrom = '12' UNION ALL SELECT 'truth', tid, chrom FROM truth WHERE chrom = '12'")
def flt_test_chrom(fx):
    own, truth = callsets.restrict(fx.cand, fx.truth, "12")
    return own.select(F.lit("call").alias("kind"), F.col("call_id").alias("id"), "chrom").unionByName(truth.select(F.lit("truth").alias("kind"), F.col("tid").alias("id"), "chrom"))


@query("flt_labels_known", f"{K}\nSELECT call_id, CASE WHEN qual % 2 = 0 THEN 'DEL' ELSE 'noDEL' END AS label FROM cand WHERE qual % 5 <> 0")
def flt_labels_known(fx):
    from lociflow.operators.datasets import known_labels

    own = fx.cand.withColumn("label", F.when(F.col("qual") % 5 == 0, "other").when(F.col("qual") % 2 == 0, "DEL").otherwise("noDEL"))
    return known_labels(own).select("call_id", "label")


@query("flt_min_support", f"{R}\nSELECT chrom, pos0, count(*) AS n FROM reads GROUP BY ALL HAVING count(*) >= 2")
def flt_min_support(fx):
    return reads.position_counts(fx.reads, "chrom", "pos0").filter("n >= 2")


@query("flt_outlier_mad", f"""{K}, m AS (SELECT median(l) AS ml, median(r) AS mr FROM cand), d AS (SELECT call_id, sqrt((l - ml)*(l - ml) + (r - mr)*(r - mr)) AS d FROM cand, m)
SELECT call_id FROM d WHERE 0.6745 * d / (SELECT median(d) FROM d) <= 1.2""")
def flt_outlier_mad(fx):
    return reads.drop_outliers(fx.cand, ["l", "r"], 1.2).select("call_id")


