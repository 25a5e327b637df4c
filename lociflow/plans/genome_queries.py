"""Queries of the whole-genome channels and split-read candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociflow.operators import genome, reads
from lociflow.plans.fixtures import DUCK_BASES
from lociflow.plans.registry import query
from lociflow.plans.scalar_queries import OPS
from lociflow.plans.signal_queries import PILE, piled, sequenced

MEAN, SD = 500.0, 200.0
#: Reads with end, clip sides and strands, as the channels see them.
G = (
    OPS + """,
g AS (SELECT *, (flag & 16) <> 0 AS rev, (flag & 32) <> 0 AS mrev, (flag & 2) <> 0 AS proper, CASE WHEN (flag & 16) <> 0 THEN 'R' ELSE 'F' END AS strand,
  CASE WHEN cigar IS NOT NULL THEN pos0 + CAST(coalesce(list_sum([CAST(v AS BIGINT) FOR v IN regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1)]), 0) AS BIGINT) END AS e,
  coalesce(regexp_matches(cigar, '^[0-9]+[SH]'), false) AS lc, coalesce(regexp_matches(cigar, '[SH]$'), false) AS rc FROM reads WHERE (flag & 4) = 0 AND mapq >= 10),
gm AS (SELECT *, CASE WHEN lc THEN pos0 + 1 ELSE e END AS cp, CASE WHEN sa IS NULL THEN '' ELSE '_split' END AS sfx FROM g WHERE (flag & 8) = 0),
big AS (SELECT chrom, CASE WHEN (flag & 16) <> 0 THEN 'R' ELSE 'F' END AS strand, op, ref_start + CASE op WHEN 'D' THEN 1 ELSE 0 END AS s, ref_start + CASE op WHEN 'D' THEN len ELSE 0 END AS e2 FROM opr WHERE op IN ('I','D') AND len >= 50 AND (flag & 4) = 0 AND mapq >= 10),
sx AS (SELECT *, string_split(replace(sa, ';', ''), ',') AS x FROM g WHERE sa IS NOT NULL AND (lc OR rc)),
sr AS (SELECT *, CASE WHEN lc AND rc THEN 'both' WHEN lc THEN 'left' ELSE 'right' END AS side, CASE WHEN rc THEN e ELSE pos0 + 1 END AS pos, x[1] AS sa_chrom, x[3] AS sa_strand,
  CAST(x[2] AS BIGINT) - 1 + CASE WHEN regexp_matches(x[4], '^[0-9]+[SH]') THEN 1 WHEN regexp_matches(x[4], '[SH]$') THEN CAST(list_sum([CAST(v AS BIGINT) FOR v IN regexp_extract_all(x[4], '([0-9]+)[MDN=X]', 1)]) AS BIGINT) ELSE 0 END AS sa_pos FROM sx WHERE CAST(x[5] AS INT) >= 10),
srk AS (SELECT *, CASE WHEN chrom <> sa_chrom THEN 'CTX' WHEN rev = mrev THEN 'INV' WHEN side = 'both' THEN 'DEL' WHEN side = 'right' THEN CASE WHEN pos0 < sa_pos THEN 'DEL' ELSE 'DUP' END WHEN pos0 > sa_pos THEN 'DUP' ELSE 'DEL' END AS kind,
  CASE WHEN (CASE WHEN rev THEN '-' ELSE '+' END) = sa_strand THEN '+-' ELSE concat(CASE WHEN rev THEN '-' ELSE '+' END, sa_strand) END AS strands, (chrom, pos) <= (sa_chrom, sa_pos) AS fwd FROM sr),
sp AS (SELECT DISTINCT CASE WHEN fwd THEN chrom ELSE sa_chrom END AS chrom1, CASE WHEN fwd THEN pos ELSE sa_pos END AS pos1, CASE WHEN fwd THEN sa_chrom ELSE chrom END AS chrom2, CASE WHEN fwd THEN sa_pos ELSE pos END AS pos2, kind, strands FROM srk),
ip AS (SELECT DISTINCT chrom AS chrom1, s AS pos1, chrom AS chrom2, CASE op WHEN 'I' THEN s + 1 ELSE e2 END AS pos2, CASE op WHEN 'I' THEN 'INDEL_INS' ELSE 'INDEL_DEL' END AS kind, '+-' AS strands FROM big),
cs AS (SELECT chrom, CASE WHEN lc THEN 'left' ELSE 'right' END AS side, CASE WHEN lc THEN pos0 + 1 ELSE e END AS pos, count(*) AS n FROM (SELECT *, coalesce(regexp_matches(cigar, '^[0-9]+[SH]'), false) AS lc, coalesce(regexp_matches(cigar, '[SH]$'), false) AS rc,
  CASE WHEN cigar IS NOT NULL THEN pos0 + CAST(coalesce(list_sum([CAST(v AS BIGINT) FOR v IN regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1)]), 0) AS BIGINT) END AS e FROM reads) WHERE lc OR rc GROUP BY ALL),
ins AS (SELECT DISTINCT chrom AS chrom1, pos AS pos1, chrom AS chrom2, pos + 1 AS pos2, 'INS' AS kind, '+-' AS strands FROM cs a WHERE n >= 1 AND EXISTS (SELECT 1 FROM cs b WHERE b.n >= 1 AND b.chrom = a.chrom AND b.side <> a.side AND b.pos IN (a.pos, a.pos - 1))),
sup AS (SELECT DISTINCT chrom, pos FROM (SELECT chrom, side, pos FROM (SELECT chrom, side, pos FROM srk WHERE side <> 'both' UNION ALL SELECT chrom, 'right', s FROM big WHERE op = 'D' UNION ALL SELECT chrom, 'left', e2 FROM big WHERE op = 'D') GROUP BY chrom, side, pos HAVING count(*) >= 2)),
ap AS (SELECT * FROM sp UNION ALL SELECT * FROM ip UNION ALL SELECT * FROM ins),
sup_p AS (SELECT DISTINCT ap.* FROM ap WHERE kind = 'INS' OR EXISTS (SELECT 1 FROM sup WHERE sup.chrom = chrom1 AND sup.pos = pos1) OR EXISTS (SELECT 1 FROM sup WHERE sup.chrom = chrom2 AND sup.pos = pos2))"""
)
PAIR = "chrom1, pos1, chrom2, pos2, kind, strands"


def channel(name: str, run, sql: str):
    @query(name, f"{G}\nSELECT chrom, pos, channel, round(CAST(count(*) AS DOUBLE), 6) AS value FROM ({sql}) GROUP BY ALL")
    def counted(fx):
        return run(fx.reads)


CLIPS = """SELECT chrom, cp AS pos, concat(CASE WHEN lc THEN 'left_' ELSE 'right_' END, strand) AS channel FROM gm WHERE chrom = next_chrom AND rev <> mrev AND sa IS NULL AND (lc OR rc)
UNION ALL SELECT chrom, cp, concat('disc_', CASE WHEN lc THEN 'left_' ELSE 'right_' END, strand) FROM gm WHERE chrom = next_chrom AND rev <> mrev AND sa IS NULL AND (lc OR rc) AND NOT proper
UNION ALL SELECT chrom, s, concat(CASE op WHEN 'I' THEN 'I_' ELSE 'D_left_' END, strand) FROM big UNION ALL SELECT chrom, e2, concat('D_right_', strand) FROM big WHERE op = 'D'"""
INV = "SELECT chrom, cp AS pos, concat('inv_', CASE WHEN pos0 > next_pos0 THEN 'before' ELSE 'after' END, sfx) AS channel FROM gm WHERE chrom = next_chrom AND rev = mrev AND (lc OR rc)"
DUP = "SELECT chrom, cp AS pos, concat('dup_', CASE WHEN lc THEN 'after' ELSE 'before' END, sfx) AS channel FROM gm WHERE chrom = next_chrom AND rev <> mrev AND ((lc AND rev AND pos0 < next_pos0) OR (NOT lc AND rc AND NOT rev AND pos0 > next_pos0))"
TRA = "SELECT chrom, cp AS pos, concat('tra_', CASE WHEN rev <> mrev THEN 'opposite' ELSE 'same' END, sfx) AS channel FROM gm WHERE chrom <> next_chrom AND (lc OR rc)"
SPLITS = "SELECT chrom, pos, concat('split_', side, '_', strand) AS channel FROM srk WHERE side <> 'both'"
channel("gw_clipped14", lambda r: genome.clipped(r), CLIPS)
channel("gw_inversion4", lambda r: genome.inversions(r), INV)
channel("gw_duplication4", lambda r: genome.duplications(r), DUP)
channel("gw_translocation4", lambda r: genome.translocations(r), TRA)
channel("gw_split4", lambda r: genome.split_counts(r), SPLITS)

COV = f"""cx AS (SELECT *, chrom = next_chrom AND rev <> mrev AS pm, chrom = next_chrom AND rev <> mrev AND (flag & 8) = 0 AND NOT (next_pos0 - pos0 > 0 AND next_pos0 - pos0 <= {MEAN + SD}) AS ds FROM g WHERE e - 1 > pos0),
cn AS (SELECT chrom, pos0, e, 'cov_proper' AS channel FROM cx WHERE pm UNION ALL SELECT chrom, pos0, e, concat('cov_disc_', strand) FROM cx WHERE ds UNION ALL SELECT chrom, pos0, e, concat('cov_improper_', strand) FROM cx WHERE (flag & 8) = 0 AND NOT proper),
cd AS (SELECT chrom, channel, pos, sum(d) AS delta FROM (SELECT chrom, channel, pos0 AS pos, 1 AS d FROM cn UNION ALL SELECT chrom, channel, e - 1, -1 FROM cn) GROUP BY ALL HAVING sum(d) <> 0)"""


@query("gw_coverage5", f"{G}, {COV}\nSELECT chrom, pos, channel, CAST(sum(delta) OVER (PARTITION BY chrom, channel ORDER BY pos) AS DOUBLE) AS value FROM cd")
def gw_coverage5(fx):
    return genome.coverage(fx.reads, MEAN, SD, parts=fx.parts).drop("next")


@query("agg_channel_meansd", f"{G}, {COV}, sz AS (SELECT CAST(len AS DOUBLE) AS len FROM span), lv AS (SELECT chrom, channel, pos, lead(pos) OVER w AS nxt, sum(delta) OVER w AS v FROM cd WINDOW w AS (PARTITION BY chrom, channel ORDER BY pos))\nSELECT chrom, channel, round(CAST(sum(v * (nxt - pos)) AS DOUBLE) / len, 6) AS mean, round(sqrt(CAST(sum(v * v * (nxt - pos)) AS DOUBLE) / len - pow(CAST(sum(v * (nxt - pos)) AS DOUBLE) / len, 2)), 6) AS sd FROM lv, sz WHERE nxt IS NOT NULL GROUP BY chrom, channel, len")
def agg_channel_meansd(fx):
    return genome.channel_stats(genome.coverage(fx.reads, MEAN, SD, parts=fx.parts), fx.contigs)


@query("gw_snv3", f"{PILE}\nSELECT chrom, pos // 1000 AS bin, channel, count(*) AS n, round(sum(value), 4) AS total, round(sum(value * (pos % 97)), 4) AS placed FROM (SELECT chrom, pos, 'snv_bq' AS channel, bq_median AS value FROM pile UNION ALL SELECT chrom, pos, 'snv_fraction', snv_fraction FROM pile UNION ALL SELECT chrom, pos, 'snv_mapq', mapq_median FROM pile) GROUP BY ALL")
def gw_snv3(fx):
    """Base quality and mapping quality medians and the fraction of other bases, summed up by kilobase."""
    own = genome.snv(piled(fx)).withColumn("bin", F.floor(F.col("pos") / 1000))
    return own.groupBy("chrom", "bin", "channel").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.col("value") * (F.col("pos") % 97)), 4).alias("placed"))


@query("gw_clipped_pos", f"""{G}, okc AS (SELECT * FROM g WHERE sa IS NULL)
SELECT chrom, side, pos, count(*) AS n FROM (
  SELECT a.chrom, 'left' AS side, a.pos0 + 1 AS pos FROM okc a JOIN okc b ON a.qname = b.qname AND a.next_pos0 = b.pos0 AND a.chrom = b.next_chrom AND b.ord > a.ord WHERE a.lc
  UNION ALL SELECT a.chrom, 'right', a.e FROM okc a JOIN okc b ON a.qname = b.qname AND a.next_pos0 = b.pos0 AND a.chrom = b.next_chrom AND b.ord > a.ord WHERE a.rc) GROUP BY ALL""")
def gw_clipped_pos(fx):
    return genome.clipped_positions(fx.reads)


DIST = f"""dz AS (SELECT *, CASE WHEN rev THEN 'reverse' ELSE 'forward' END AS o, (abs(pos0 - next_pos0) - {MEAN}) / {SD} AS z FROM gm WHERE chrom = next_chrom AND ((NOT rev AND mrev AND pos0 <= next_pos0) OR (rev AND NOT mrev AND pos0 > next_pos0))),
dk AS (SELECT chrom, CASE WHEN rev THEN pos0 ELSE e + 1 END AS pos, concat('clipdist_', o, '_all') AS channel, z FROM dz UNION ALL SELECT chrom, CASE WHEN lc THEN pos0 ELSE e + 1 END, concat('clipdist_', o, CASE WHEN lc THEN '_left' ELSE '_right' END), z FROM dz WHERE lc OR rc)"""


@query("gw_clip_distance", f"{G}, {DIST}\nSELECT chrom, pos, channel, round(median(z), 6) AS value FROM dk GROUP BY ALL")
def gw_clip_distance(fx):
    return genome.clip_distances(fx.reads, MEAN, SD).withColumn("value", F.round("value", 6))


SDIST = f"SELECT chrom, pos, concat('splitdist_', side, '_', strand) AS channel, CASE WHEN chrom = sa_chrom THEN (abs(pos - sa_pos) - {MEAN}) / {SD} ELSE 0 END AS z FROM srk WHERE side <> 'both'"


@query("gw_split_distance", f"{G}\nSELECT chrom, pos, channel, round(median(z), 6) AS value FROM ({SDIST}) GROUP BY ALL")
def gw_split_distance(fx):
    return genome.split_distances(fx.reads, MEAN, SD).withColumn("value", F.round("value", 6))


@query("agg_position_median", f"{G}, {DIST}\nSELECT chrom, channel, count(*) AS positions, round(sum(v), 4) AS total FROM (SELECT chrom, pos, channel, median(z) AS v FROM dk GROUP BY ALL) GROUP BY ALL")
def agg_position_median(fx):
    return genome.clip_distances(fx.reads, MEAN, SD).groupBy("chrom", "channel").agg(F.count("*").alias("positions"), F.round(F.sum("value"), 4).alias("total"))


@query("gw_split_pairs", f"{G}\nSELECT {PAIR} FROM sp")
def gw_split_pairs(fx):
    return genome.split_pairs(fx.reads)


@query("gw_indel_pairs", f"{G}\nSELECT {PAIR} FROM ip")
def gw_indel_pairs(fx):
    return genome.indel_pairs(fx.reads)


@query("gw_ins_candidates", f"{G}\nSELECT {PAIR} FROM ins")
def gw_ins_candidates(fx):
    return genome.insertion_candidates(fx.reads, 1)


def pairs(fx):
    return genome.split_pairs(fx.reads).unionByName(genome.indel_pairs(fx.reads)).unionByName(genome.insertion_candidates(fx.reads, 1))


@query("flt_pair_min_support", f"{G}\nSELECT {PAIR} FROM sup_p")
def flt_pair_min_support(fx):
    return genome.supported_pairs(pairs(fx), genome.split_support(fx.reads, least=2))


@query("gw_split_bedpe", f"{G}\nSELECT chrom1, pos1 AS s1, pos1 + 1 AS e1, chrom2, pos2 AS s2, pos2 + 1 AS e2, kind AS svtype, substr(strands, 1, 1) AS strand1, substr(strands, 2, 1) AS strand2 FROM sup_p")
def gw_split_bedpe(fx):
    return genome.pairs_to_bedpe(genome.supported_pairs(pairs(fx), genome.split_support(fx.reads, least=2)))


@query("gw_candidates_sr", f"{G}\nSELECT {PAIR} FROM ap WHERE kind IN ('DEL', 'INDEL_DEL') AND pos1 BETWEEN 2000 AND (SELECT len - 2000 FROM span) AND pos2 BETWEEN 2000 AND (SELECT len - 2000 FROM span)")
def gw_candidates_sr(fx):
    return genome.candidates(pairs(fx), fx.contigs, "DEL", 2000)


@query("gw_candidates_cr", f"{G}\nSELECT chrom, side, pos, n FROM cs WHERE n >= 2")
def gw_candidates_cr(fx):
    return genome.clip_sides(fx.reads, 2)


@query("gw_candidates_by_chr", f"{G}\nSELECT DISTINCT {PAIR} FROM sp WHERE EXISTS (SELECT 1 FROM cs WHERE cs.n >= 2 AND cs.chrom = chrom1 AND cs.pos BETWEEN pos1 - 1 AND pos1 + 1) OR EXISTS (SELECT 1 FROM cs WHERE cs.n >= 2 AND cs.chrom = chrom2 AND cs.pos BETWEEN pos2 - 1 AND pos2 + 1)")
def gw_candidates_by_chr(fx):
    return genome.near_clips(genome.split_pairs(fx.reads), genome.clip_sides(fx.reads, 2))


@query("gw_one_hot5", f"SELECT chrom, concat('base_', base) AS channel, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM ({DUCK_BASES}) GROUP BY ALL")
def gw_one_hot5(fx):
    return genome.one_hot(fx.bases).groupBy("chrom", "channel").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


LONG = f"""{G}, {COV}, {DIST}, long AS (SELECT chrom, pos, channel, CAST(count(*) AS DOUBLE) AS value FROM ({CLIPS} UNION ALL {INV} UNION ALL {DUP} UNION ALL {TRA} UNION ALL {SPLITS}) GROUP BY ALL
UNION ALL SELECT chrom, pos, channel, CAST(sum(delta) OVER (PARTITION BY chrom, channel ORDER BY pos) AS DOUBLE) FROM cd UNION ALL SELECT chrom, pos, channel, median(z) FROM dk GROUP BY ALL
UNION ALL SELECT chrom, pos, channel, median(z) FROM ({SDIST}) GROUP BY ALL)"""
VALUES = [c for c in genome.ALL if c not in genome.BASES]


def sums_sql(names, table):
    return " UNION ALL ".join(f"SELECT chrom, '{c}' AS channel, count(CASE WHEN {c} <> 0 THEN 1 END) AS nonzero, round(sum({c}), 5) AS total, round(sum({c} * (pos % 97)), 5) AS placed FROM {table} GROUP BY chrom" for c in names)


#: The twin lays out every position: coverage is carried from its changes to each of them.
@query("gw_chr_array", f"""{LONG}, {PILE[PILE.index("b AS ("):]},
every AS MATERIALIZED (SELECT chrom, unnest(range(len)) AS pos FROM contigs_of, span),
places AS (SELECT chrom, pos, {', '.join(f"max(CASE WHEN channel = '{c}' THEN value END) AS {c}" for c in VALUES if c not in genome.SNV)} FROM long GROUP BY chrom, pos),
laid AS MATERIALIZED (SELECT every.chrom, every.pos, {', '.join(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY every.chrom ORDER BY every.pos), 0) AS {c}" if c in genome.COVERAGE else f"coalesce({c}, 0) AS {c}" for c in VALUES if c not in genome.SNV)},
  coalesce(bq_median, 0) AS snv_bq, coalesce(snv_fraction, 0) AS snv_fraction, coalesce(mapq_median, 0) AS snv_mapq, {', '.join(f"CAST(coalesce(base = '{c[-1]}', false) AS INT) AS {c}" for c in genome.BASES)}
  FROM every LEFT JOIN places USING (chrom, pos) LEFT JOIN pile USING (chrom, pos) LEFT JOIN b USING (chrom, pos))
{sums_sql(genome.ALL, 'laid')}""".replace("FROM contigs_of, span", "FROM (SELECT unnest(['12', '22']) AS chrom), span"))
def gw_chr_array(fx):
    """All 53 columns of every position, laid out and summed up by chunk: how many are not zero, their sum, and their sum weighted by place."""
    pile = reads.pileup_chunks(sequenced(fx), fx.store, parts=fx.parts)
    own = genome.array_sums(genome.chr_chunks(fx.reads, fx.contigs, fx.store, MEAN, SD, pile, parts=fx.parts))
    return own.select("chrom", "channel", "nonzero", F.round("total", 5).alias("total"), F.round("placed", 5).alias("placed"))
