"""Queries of labels, callset evaluation, datasets, metrics, models, sources and sinks."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from lociflow.functions import calls as X
from lociflow.operators import basestore, callsets, datasets, genome, metrics, models, ranges, reads, signals, windows
from lociflow.plans.fixtures import BASE, DUCK_BASES, with_ctes
from lociflow.plans.genome_queries import G
from lociflow.plans.registry import query
from lociflow.plans.scalar_queries import OPS, K, R
from lociflow.plans.signal_queries import SIG, TENSOR
from lociflow.sources import stores, text
from lociflow.sources.places import delete, shared_path

KT, KR = with_ctes("cand", "truth"), with_ctes("cand", "regions")
H = 100
LAB = (
    KT + f""",
hs AS (SELECT call_id, s1 AS s, e1 AS e, svtype || '/' || t.chrom || '/' || s1 || '/' || t.chrom || '/' || s2 AS sv, t.svtype AS tt, e1 <= c.l + {H} AS tight FROM (SELECT call_id, chrom, l FROM cand) c JOIN truth t ON c.chrom = t.chrom AND s1 >= c.l - {H} AND e1 <= c.l + {H + 1}),
he AS (SELECT call_id, s2 AS s, e2 AS e, svtype || '/' || t.chrom || '/' || s1 || '/' || t.chrom || '/' || s2 AS sv, e2 <= c.r + {H} AS tight FROM (SELECT call_id, chrom, r FROM cand) c JOIN truth t ON c.chrom = t.chrom AND s2 >= c.r - {H} AND e2 <= c.r + {H + 1}),
lc AS (SELECT c.*, coalesce(a.n, 0) AS n_start, coalesce(b.n, 0) AS n_end FROM cand c LEFT JOIN (SELECT call_id, count(DISTINCT (s, e, sv)) AS n FROM hs GROUP BY 1) a USING (call_id) LEFT JOIN (SELECT call_id, count(DISTINCT (s, e, sv)) AS n FROM he GROUP BY 1) b USING (call_id)),
sh AS (SELECT hs.call_id, hs.sv, min(tt) AS t, bool_or(hs.tight AND he.tight) AS tight FROM hs JOIN he ON hs.call_id = he.call_id AND hs.sv = he.sv GROUP BY ALL),
lab AS (SELECT lc.*, CASE WHEN n_start = 1 AND n_end = 1 AND coalesce(g.tight, false) THEN g.t WHEN n_start > 1 OR n_end > 1 THEN 'DEL' ELSE 'noDEL' END AS label FROM lc LEFT JOIN (SELECT call_id, bool_or(tight) AS tight, min(t) AS t FROM sh GROUP BY 1) g USING (call_id)),
cov AS (SELECT DISTINCT sv FROM sh JOIN lc USING (call_id) WHERE n_start > 1 OR n_end > 1 OR tight)"""
)


def labelled(fx):
    return callsets.decide(fx.cand, fx.truth, H)


@query("lab_counts", f"{LAB}\nSELECT call_id, n_start, n_end FROM lc")
def lab_counts(fx):
    return callsets.label_counts(fx.cand, fx.truth, H).select("call_id", "n_start", "n_end")


@query("lab_decide", f"{LAB}\nSELECT call_id, label FROM lab")
def lab_decide(fx):
    return labelled(fx).select("call_id", "label")


@query("lab_duplicate_guard", f"{LAB}\nSELECT call_id, label FROM lab")
def lab_duplicate_guard(fx):
    return callsets.refuse_duplicates(labelled(fx), "call_id").select("call_id", "label")


@query("lab_covered", f"{LAB}\nSELECT sv FROM cov")
def lab_covered(fx):
    return callsets.covered(fx.cand, fx.truth, H)


@query("lab_uncovered", f"{LAB}\nSELECT tid FROM truth t WHERE svtype || '/' || chrom || '/' || s1 || '/' || chrom || '/' || s2 NOT IN (SELECT sv FROM cov)")
def lab_uncovered(fx):
    return callsets.uncovered(fx.truth, callsets.covered(fx.cand, fx.truth, H)).select("tid")


@query("lab_balance", f"{LAB}\nSELECT call_id, label FROM lab WHERE label = 'DEL' UNION ALL (SELECT call_id, label FROM lab WHERE label <> 'DEL' ORDER BY call_id LIMIT (SELECT count(*) FROM lab WHERE label = 'DEL'))")
def lab_balance(fx):
    return callsets.balance(labelled(fx).select("call_id", "label"), "DEL", "call_id")


@query("agg_label_counts", f"{LAB}\nSELECT label, count(*) AS n FROM lab GROUP BY label")
def agg_label_counts(fx):
    return reads.position_counts(labelled(fx), "label")


@query("agg_sv_coverage_pct", f"{LAB}\nSELECT CAST(floor(100.0 * (SELECT count(*) FROM cov) / (SELECT count(*) FROM truth)) AS BIGINT) AS percent")
def agg_sv_coverage_pct(fx):
    n = fx.truth.agg(F.count("*").alias("n"))
    k = callsets.covered(fx.cand, fx.truth, H).agg(F.count("*").alias("k"))
    return n.join(k, F.lit(True)).select(callsets.coverage_percent(F.col("k"), F.col("n")).alias("percent"))


@query("snk_labels", f"{LAB}\nSELECT concat(chrom, '/', l, '/', chrom, '/', r, '/**/', svtype) AS window_id, label FROM lab")
def snk_labels(fx):
    """Labels with their windows, written to a store by place and read back."""
    path = shared_path(fx.spark, "labels")
    stores.write_store(labelled(fx).select("call_id", "chrom", "l", "r", "svtype", "label"), path, key="call_id")
    return stores.read_store(fx.spark, path).select(X.window_id("chrom", "l", "chrom", "r", F.lit("**"), "svtype").alias("window_id"), "label")


@query("flt_regions_remove", f"{KR}\nSELECT call_id FROM cand c WHERE NOT EXISTS (SELECT 1 FROM regions g WHERE g.chrom = c.chrom AND (c.l >= s AND c.l < e OR c.r >= s AND c.r < e))")
def flt_regions_remove(fx):
    return callsets.remove_regions(fx.cand, fx.regions).select("call_id")


@query("flt_regions_keep", f"{KR}, wide AS (SELECT chrom, s - 200 AS s, e + 200 AS e FROM regions)\nSELECT call_id FROM cand c WHERE EXISTS (SELECT 1 FROM wide g WHERE g.chrom = c.chrom AND c.l >= s AND c.l < e) AND EXISTS (SELECT 1 FROM wide g WHERE g.chrom = c.chrom AND c.r >= s AND c.r < e)")
def flt_regions_keep(fx):
    wide = fx.regions.select("chrom", (F.col("s") - 200).alias("s"), (F.col("e") + 200).alias("e"))
    return callsets.keep_regions(fx.cand, wide).select("call_id")


MATCH = (
    KT + """,
m AS (SELECT call_id, tid, qual, caller FROM cand c JOIN truth t ON c.chrom = t.chrom AND abs(c.l - t.s1) <= least(200.0, 0.5 * (t.s2 - t.s1)) AND abs(c.r - t.s2) <= least(200.0, 0.5 * (t.s2 - t.s1)) AND abs((c.r - c.l) - (t.s2 - t.s1)) <= 0.25 * (t.s2 - t.s1)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tid, caller ORDER BY qual DESC, call_id) AS n FROM m) WHERE n = 1),
mc AS (SELECT c.*, coalesce(h.k, 0) AS hits FROM cand c LEFT JOIN (SELECT call_id, count(*) AS k FROM best GROUP BY 1) h USING (call_id)),
nt AS (SELECT count(*) AS n_truth FROM truth),
pr0 AS (SELECT caller, qual, count(*) AS calls, count(CASE WHEN hits > 0 THEN 1 END) AS tp FROM mc GROUP BY ALL),
pr AS (SELECT *, CAST(sum(tp) OVER w AS BIGINT) AS cum_tp, CAST(sum(calls) OVER w AS BIGINT) AS cum_n FROM pr0 WINDOW w AS (PARTITION BY caller ORDER BY qual DESC)),
sm AS (SELECT caller, svtype, count(*) AS calls, count(CASE WHEN hits > 0 THEN 1 END) AS tp FROM mc GROUP BY caller, svtype)"""
)


def found(fx):
    return callsets.matches(fx.cand, fx.truth)


def counted(fx):
    return callsets.match_counts(fx.cand, callsets.best_matches(found(fx), ["caller"]))


@query("join_breakpoint_match", f"{MATCH}\nSELECT call_id, tid FROM m")
def join_breakpoint_match(fx):
    return found(fx).select("call_id", "tid")


@query("match_count_best", f"{MATCH}\nSELECT call_id, hits FROM mc")
def match_count_best(fx):
    return counted(fx).select("call_id", "hits")


@query("pr_curve", f"{MATCH}\nSELECT caller, qual, calls, tp, cum_tp, cum_n, cum_n - cum_tp AS cum_fp, round(CAST(cum_tp AS DOUBLE) / cum_n, 9) AS precision, round(CAST(cum_tp AS DOUBLE) / n_truth, 9) AS recall FROM pr, nt")
def pr_curve(fx):
    return callsets.pr_curve(counted(fx), fx.truth.count()).withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@query("pr_operating_point", f"{MATCH}\nSELECT caller, qual, round(CAST(cum_tp AS DOUBLE) / cum_n, 9) AS precision, round(CAST(cum_tp AS DOUBLE) / n_truth, 9) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY abs(qual - 500), qual) AS n FROM pr), nt WHERE n = 1")
def pr_operating_point(fx):
    return callsets.operating_point(callsets.pr_curve(counted(fx), fx.truth.count()), 500).withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


SUMMARY = "round(CAST(tp AS DOUBLE) / calls, 9) AS precision, round(CAST(tp AS DOUBLE) / n_truth, 9) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (calls + n_truth) ELSE 0 END, 9) AS f1"


@query("agg_caller_summary", f"{MATCH}, s AS (SELECT caller, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tp) AS BIGINT) AS tp FROM sm GROUP BY caller)\nSELECT caller, calls, tp, calls - tp AS fp, {SUMMARY} FROM s, nt")
def agg_caller_summary(fx):
    return callsets.caller_summary(counted(fx), fx.truth.count()).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


#: Each call belongs to one simulated setting, found by its id; the truth is made with the same settings.
SETTING = "CASE {0} % 3 WHEN 0 THEN 'coverage' WHEN 1 THEN 'insert size' ELSE 'read length' END AS parameter, ({0} * 7) % 4 AS setting, CASE WHEN {0} % 2 = 0 THEN 'hmz' ELSE 'htz' END AS genotype"
SWEEP = ["parameter", "setting", "genotype", "svtype", "mode", "caller"]
SWEEP_SETS = [SWEEP, ["parameter", "setting", "genotype", "mode", "caller"], ["parameter", "setting", "svtype", "caller"], ["svtype", "caller"], ["caller"]]
_truth_sets = list(dict.fromkeys(tuple(c for c in one if c not in ("mode", "caller")) for one in SWEEP_SETS))
_shown = lambda c: f"CASE WHEN grouping({c}) = 1 THEN 'all' ELSE CAST({c} AS VARCHAR) END AS {c}"
_sets = lambda sets: ", ".join("(" + ", ".join(one) + ")" for one in sets)


@query("agg_param_sweep", f"""{MATCH}, sc AS (SELECT *, {SETTING.format('call_id')}, CASE WHEN qual % 2 = 0 THEN 'split' ELSE 'clip' END AS mode FROM mc), st AS (SELECT *, {SETTING.format('tid')} FROM truth),
gc AS (SELECT {', '.join(map(_shown, SWEEP))}, count(*) AS calls, count(CASE WHEN hits > 0 THEN 1 END) AS tp FROM sc GROUP BY GROUPING SETS ({_sets(SWEEP_SETS)})),
gt AS (SELECT {', '.join(map(_shown, SWEEP[:4]))}, count(*) AS n_truth FROM st GROUP BY GROUPING SETS ({_sets(_truth_sets)}))
SELECT {', '.join(SWEEP)}, calls, tp, calls - tp AS fp, coalesce(n_truth, 0) AS n_truth, round(CAST(tp AS DOUBLE) / calls, 9) AS precision, round(CASE WHEN n_truth > 0 THEN CAST(tp AS DOUBLE) / n_truth ELSE 0 END, 9) AS recall, round(CASE WHEN tp > 0 AND n_truth > 0 THEN 2.0 * tp / (calls + n_truth) ELSE 0 END, 9) AS f1
FROM gc LEFT JOIN gt USING ({', '.join(SWEEP[:4])})""")
def agg_param_sweep(fx):
    own = counted(fx).selectExpr("*", *SETTING.format("call_id").replace(" AS parameter, ", " AS parameter|").replace(" AS setting, ", " AS setting|").split("|"), "CASE WHEN qual % 2 = 0 THEN 'split' ELSE 'clip' END AS mode")
    truth = fx.truth.selectExpr("*", *SETTING.format("tid").replace(" AS parameter, ", " AS parameter|").replace(" AS setting, ", " AS setting|").split("|"))
    return callsets.param_sweep(own, truth, SWEEP, SWEEP[:4], SWEEP_SETS).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("agg_max_recall", f"{MATCH}\nSELECT caller, round(max(CAST(cum_tp AS DOUBLE) / n_truth), 9) AS recall FROM pr, nt GROUP BY caller")
def agg_max_recall(fx):
    return callsets.pr_curve(counted(fx), fx.truth.count()).groupBy("caller").agg(F.round(F.max("recall"), 9).alias("recall"))


@query("agg_name_matches_upset", f"{MATCH}, u AS (SELECT tid, max(CASE caller WHEN 'A' THEN 1 ELSE 0 END) AS a, max(CASE caller WHEN 'B' THEN 1 ELSE 0 END) AS b, max(CASE caller WHEN 'C' THEN 1 ELSE 0 END) AS c FROM m GROUP BY tid)\nSELECT concat(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0)) AS pattern, count(*) AS n FROM truth LEFT JOIN u USING (tid) GROUP BY ALL")
def agg_name_matches_upset(fx):
    return callsets.upset(fx.truth, found(fx), ["A", "B", "C"])


@query("venn_truth_hits", f"{MATCH}, u AS (SELECT t.tid, EXISTS (SELECT 1 FROM m WHERE m.tid = t.tid AND caller = 'A') AS a, EXISTS (SELECT 1 FROM m WHERE m.tid = t.tid AND caller = 'B') AS b FROM truth t)\nSELECT count(CASE WHEN a AND NOT b THEN 1 END) AS only_one, count(CASE WHEN b AND NOT a THEN 1 END) AS only_two, count(CASE WHEN a AND b THEN 1 END) AS \"both\", count(CASE WHEN NOT a AND NOT b THEN 1 END) AS missed FROM u")
def venn_truth_hits(fx):
    return callsets.venn(fx.truth, found(fx), "A", "B")


SELF = "abs(c.l - t.l) <= least(200.0, 0.5 * (t.r - t.l)) AND abs(c.r - t.r) <= least(200.0, 0.5 * (t.r - t.l))"


@query("dedup_callset", f"{K}\nSELECT DISTINCT call_id FROM (SELECT c.call_id, row_number() OVER (PARTITION BY t.call_id ORDER BY c.qual DESC, c.call_id) AS n FROM cand c JOIN cand t ON c.chrom = t.chrom AND {SELF} AND abs((c.r - c.l) - (t.r - t.l)) <= 0.25 * (t.r - t.l)) WHERE n = 1")
def dedup_callset(fx):
    return callsets.dedup_calls(fx.cand).select("call_id")


@query("union_callsets", f"{K}\nSELECT call_id FROM cand WHERE caller = 'A' UNION ALL SELECT call_id FROM cand c WHERE caller = 'B' AND NOT EXISTS (SELECT 1 FROM cand t WHERE t.caller = 'A' AND t.chrom = c.chrom AND {SELF})")
def union_callsets(fx):
    return callsets.union_calls(fx.cand.filter("caller = 'A'"), fx.cand.filter("caller = 'B'")).select("call_id")


SUP = f"""{G}, {with_ctes('truth', after=('reads',))}"""
NEAR = "EXISTS (SELECT 1 FROM sp WHERE chrom1 = t.chrom AND chrom2 = t.chrom AND {})"


def support_query(name: str, enclosed: bool, sql: str):
    wide = 150 if enclosed else 0

    @query(name, f"{SUP}, tw AS (SELECT tid, chrom, s1 - {wide} AS s1, e1 + {wide} AS e1, s2 - {wide} AS s2, e2 + {wide} AS e2 FROM truth)\nSELECT tid, {NEAR.format(sql)} AS supported FROM tw t")
    def run(fx):
        own = fx.truth.select(F.col("tid").alias("call_id"), "chrom", (F.col("s1") - wide).alias("s1"), (F.col("e1") + wide).alias("e1"), (F.col("s2") - wide).alias("s2"), (F.col("e2") + wide).alias("e2"))
        return callsets.split_by_support(own, genome.split_pairs(fx.reads), 100, enclosed).select(F.col("call_id").alias("tid"), "supported")


support_query("join_range_overlap", False, "pos1 - 100 < e1 AND s1 < pos1 + 101 AND pos2 - 100 < e2 AND s2 < pos2 + 101")
support_query("join_range_enclosed_by_support", True, "s1 <= pos1 - 100 AND pos1 + 101 <= e1 AND s2 <= pos2 - 100 AND pos2 + 101 <= e2")


@query("split_by_support", f"{SUP}\nSELECT x AS supported, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM truth), 6) AS percent FROM (SELECT {NEAR.format('pos1 - 100 < e1 AND s1 < pos1 + 101 AND pos2 - 100 < e2 AND s2 < pos2 + 101')} AS x FROM truth t) GROUP BY x")
def split_by_support(fx):
    own = callsets.split_by_support(fx.truth.withColumnRenamed("tid", "call_id"), genome.split_pairs(fx.reads), 100)
    n = fx.truth.count()
    return own.groupBy("supported").agg(F.count("*").alias("n"), F.round(100 * F.count("*") / F.lit(n), 6).alias("percent"))


@query("sim_translocation_fix", f"{K}\nSELECT call_id, CASE WHEN n % 2 = 1 THEN '3to3' ELSE '5to5' END AS connection, concat('TRA_', chrom, '_', n) AS uid FROM (SELECT call_id, chrom, row_number() OVER (PARTITION BY chrom ORDER BY call_id) AS n FROM cand)")
def sim_translocation_fix(fx):
    return callsets.fix_translocations(fx.cand, "call_id").select("call_id", "connection", "uid")


@query("join_score_to_calls", f"{K}, sc AS (SELECT chrom, l // 1000 AS pos, call_id AS ord, qual / 1000.0 AS prob FROM cand), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY ord DESC) AS n FROM sc) WHERE n = 1)\nSELECT call_id, round(prob, 6) AS prob FROM (SELECT call_id, chrom, r // 1000 AS pos FROM cand) JOIN last USING (chrom, pos)")
def join_score_to_calls(fx):
    scores = fx.cand.select("chrom", F.floor(F.col("l") / 1000).alias("pos"), F.col("call_id").alias("ord"), (F.col("qual") / 1000.0).alias("prob"))
    return callsets.scores_to_calls(fx.cand.select("call_id", "chrom", F.floor(F.col("r") / 1000).alias("pos")), scores).select("call_id", F.round("prob", 6).alias("prob"))


@query("ivl_merge", f"{with_ctes('regions')}, r AS (SELECT chrom, s, e + 300 AS e FROM regions), a AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r), b AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e) AS g FROM a)\nSELECT chrom, min(s) AS s, max(e) AS e FROM b GROUP BY chrom, g")
def ivl_merge(fx):
    return ranges.merge_intervals(fx.regions.withColumn("e", F.col("e") + 300))


@query("ivl_n_runs", f"SELECT chrom, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT chrom, pos, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS g FROM ({DUCK_BASES}) WHERE base = 'N') GROUP BY chrom, g HAVING count(*) >= 2")
def ivl_n_runs(fx):
    return ranges.runs_of(fx.bases.filter("base = 'N'"))


@query("ivl_extract_chrom_rename", f"{with_ctes('regions')}\nSELECT concat('chr', chrom) AS chrom, s, e FROM regions WHERE chrom = '12'")
def ivl_extract_chrom_rename(fx):
    return fx.regions.filter(F.col("chrom") == "12").withColumn("chrom", X.chrom_ucsc("chrom"))


# Datasets: sample is the caller, order the call.
DS = LAB + """,
ds AS (SELECT call_id, call_id AS ord, caller AS sample, chrom, l AS pos, label, CASE label WHEN 'DEL' THEN 0 WHEN 'noDEL' THEN 1 END AS y, qual / 1000.0 AS score, CASE WHEN qual % 2 = 0 THEN 0 ELSE 1 END AS pred FROM lab)"""


def rows(fx):
    own = labelled(fx)
    return own.select("call_id", F.col("call_id").alias("ord"), F.col("caller").alias("sample"), "chrom", F.col("l").alias("pos"), "label", datasets.encode_label(F.col("label")).alias("y"), (F.col("qual") / 1000.0).alias("score"), F.when(F.col("qual") % 2 == 0, 0).otherwise(1).alias("pred"))


@query("ds_label_encode", f"{DS}\nSELECT call_id, y FROM ds")
def ds_label_encode(fx):
    return rows(fx).select("call_id", "y")


@query("ds_class_weights", f"{DS}\nSELECT call_id, round(CAST(n AS DOUBLE) / (k * c), 9) AS weight FROM (SELECT call_id, (SELECT count(*) FROM ds WHERE y IS NOT NULL) AS n, (SELECT count(DISTINCT y) FROM ds) AS k, count(*) OVER (PARTITION BY y) AS c FROM ds WHERE y IS NOT NULL)")
def ds_class_weights(fx):
    return datasets.class_weights(rows(fx).filter("y is not null")).select("call_id", F.round("weight", 9).alias("weight"))


@query("ds_kfold_contiguous", f"{DS}\nSELECT call_id, CAST(ntile(7) OVER (ORDER BY ord) - 1 AS INT) AS fold FROM ds")
def ds_kfold_contiguous(fx):
    return datasets.kfold_contiguous(rows(fx), 7).select("call_id", "fold")


@query("ds_tail_validation", f"{DS}\nSELECT call_id, row_number() OVER (ORDER BY ord) > CAST(floor((SELECT count(*) FROM ds) * 0.7) AS BIGINT) AS validation FROM ds")
def ds_tail_validation(fx):
    return datasets.tail_validation(rows(fx), 0.3).select("call_id", "validation")


@query("ds_leave_chrom_out", f"{DS}\nSELECT call_id, CASE WHEN chrom = '12' THEN 'test' ELSE 'train' END AS part FROM ds")
def ds_leave_chrom_out(fx):
    return datasets.leave_out(rows(fx), "chrom", "12").select("call_id", "part")


@query("ds_leave_sample_out", f"{DS}\nSELECT call_id FROM ds WHERE sample <> 'A' AND chrom <> '12'")
def ds_leave_sample_out(fx):
    return datasets.leave_sample_out(rows(fx), "A", "12").select("call_id")


BIN = DS + """,
bn AS (SELECT call_id, sample, chrom, pos, CAST((dense_rank() OVER (ORDER BY chrom) - 1) * 3 + max(t) OVER (PARTITION BY chrom, pos) AS INT) AS bin FROM (SELECT *, ntile(3) OVER (PARTITION BY chrom ORDER BY pos, call_id) - 1 AS t FROM ds))"""


def binned(fx):
    return datasets.genomic_bins(rows(fx))


@query("ds_genomic_bins", f"{BIN}\nSELECT call_id, bin FROM bn")
def ds_genomic_bins(fx):
    return binned(fx).select("call_id", "bin")


def group_query(name: str, source: str, column: str, test: list, validation: list):
    t, v = (", ".join(repr(x) for x in xs) for xs in (test, validation))

    @query(name, f"{BIN}\nSELECT * FROM (SELECT call_id, CASE WHEN sample = 'A' AND {column} IN ({t}) THEN 'test' WHEN sample = 'A' AND {column} IN ({v}) THEN 'validation' WHEN sample <> 'A' AND {column} NOT IN ({t}) AND {column} NOT IN ({v}) THEN 'train' END AS part FROM {source}) WHERE part IS NOT NULL")
    def run(fx):
        own = rows(fx) if source == "ds" else binned(fx)
        return datasets.leave_group_out(own, "A", column, test, validation).select("call_id", "part")


group_query("ds_locso", "ds", "chrom", ["12"], ["22"])
group_query("ds_locso_list", "ds", "chrom", ["12", "1"], ["2"])
group_query("ds_lobso", "bn", "bin", [0], [4])
group_query("ds_lobso_list", "bn", "bin", [0, 3], [1])


@query("ds_leakage_asserts", f"{BIN}, p AS (SELECT sample, bin, CASE WHEN sample = 'A' AND bin = 0 THEN 'test' WHEN sample = 'A' AND bin = 4 THEN 'validation' WHEN sample <> 'A' AND bin NOT IN (0, 4) THEN 'train' END AS part FROM bn)\nSELECT count(CASE part WHEN 'train' THEN 1 END) AS train, count(CASE part WHEN 'test' THEN 1 END) AS test, count(CASE part WHEN 'validation' THEN 1 END) AS validation, 0 AS leaks, 0 AS impure FROM p")
def ds_leakage_asserts(fx):
    return datasets.assert_split(datasets.leave_group_out(binned(fx), "A", "bin", [0], [4]), "A", "bin", [0])


@query("ds_kfold_stratified")
def ds_kfold_stratified(fx):
    return datasets.kfold_stratified(rows(fx), 5, "call_id").select("call_id", "label", "fold")


@query("ds_holdout_stratified")
def ds_holdout_stratified(fx):
    return datasets.holdout_stratified(rows(fx), "call_id").select("call_id", "label", "test")


@query("src_multi_sample", f"{DS}\nSELECT sample, count(*) AS n FROM ds GROUP BY sample")
def src_multi_sample(fx):
    own = rows(fx).drop("sample")
    caller = fx.cand.select("call_id", "caller")
    parts = {c: own.join(caller.filter(F.col("caller") == c), "call_id", "left_semi") for c in "ABC"}
    return datasets.combine_samples(parts).groupBy("sample").agg(F.count("*").alias("n"))


KNOWN = DS + ", kn AS (SELECT * FROM ds WHERE y IS NOT NULL)"


def known(fx):
    return rows(fx).filter("y is not null")


@query("met_accuracy", f"{KNOWN}\nSELECT round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END), 9) AS accuracy FROM kn")
def met_accuracy(fx):
    return metrics.accuracy(known(fx)).select(F.round("accuracy", 9).alias("accuracy"))


@query("met_balanced_accuracy", f"{KNOWN}\nSELECT round(avg(r), 9) AS balanced_accuracy FROM (SELECT avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS r FROM kn GROUP BY y)")
def met_balanced_accuracy(fx):
    return metrics.balanced_accuracy(known(fx)).select(F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


@query("agg_confusion", f"{KNOWN}\nSELECT y, count(CASE pred WHEN 0 THEN 1 END) AS pred_0, count(CASE pred WHEN 1 THEN 1 END) AS pred_1 FROM kn GROUP BY y")
def agg_confusion(fx):
    return metrics.confusion(known(fx), [0, 1])


STEPS = KNOWN + """,
st0 AS (SELECT chrom, score, count(*) AS n, count(CASE y WHEN 0 THEN 1 END) AS tp FROM kn GROUP BY ALL),
st AS (SELECT *, sum(tp) OVER w AS ct, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY chrom) AS p FROM st0 WINDOW w AS (PARTITION BY chrom ORDER BY score DESC)),
pt AS (SELECT chrom, score, CAST(ct AS DOUBLE) / cn AS precision, CASE WHEN p > 0 THEN CAST(ct AS DOUBLE) / p ELSE 0 END AS recall FROM st)"""


@query("met_average_precision", f"{STEPS}\nSELECT chrom, round(sum(step * precision), 9) AS average_precision FROM (SELECT *, recall - coalesce(lag(recall) OVER (PARTITION BY chrom ORDER BY score DESC), 0) AS step FROM pt) GROUP BY chrom")
def met_average_precision(fx):
    return metrics.average_precision(known(fx).withColumn("hit", F.col("y") == 0), ["chrom"]).withColumn("average_precision", F.round("average_precision", 9))


@query("met_pr_points", KNOWN + """,
pc AS (SELECT '0' AS cls, score AS v, y = 0 AS hit FROM kn UNION ALL SELECT '1', 1 - score, y = 1 FROM kn),
pa AS (SELECT * FROM pc UNION ALL SELECT 'micro', v, hit FROM pc),
p0 AS (SELECT cls, v, count(*) AS n, count(CASE WHEN hit THEN 1 END) AS tp FROM pa GROUP BY ALL),
p1 AS (SELECT *, sum(tp) OVER w AS ct, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY cls) AS p FROM p0 WINDOW w AS (PARTITION BY cls ORDER BY v DESC))
SELECT cls, round(v, 9) AS score, round(CAST(ct AS DOUBLE) / cn, 9) AS precision, round(CASE WHEN p > 0 THEN CAST(ct AS DOUBLE) / p ELSE 0 END, 9) AS recall FROM p1""")
def met_pr_points(fx):
    """One class against the rest, for each class and for the pool of all."""
    own = metrics.one_against_rest(known(fx).withColumn("other", 1 - F.col("score")), {0: "score", 1: "other"})
    return metrics.pr_points(own, ["cls"]).withColumns({c: F.round(c, 9) for c in ("score", "precision", "recall")})


@query("met_f1_weighted", f"{KNOWN}, f AS (SELECT t.y, n, tp, coalesce(p, 0) AS p FROM (SELECT y, count(*) AS n, count(CASE WHEN y = pred THEN 1 END) AS tp FROM kn GROUP BY y) t LEFT JOIN (SELECT pred, count(*) AS p FROM kn GROUP BY pred) q ON q.pred = t.y)\nSELECT round(CAST(sum(CASE WHEN tp > 0 THEN 2.0 * tp / (n + p) ELSE 0 END * n) AS DOUBLE) / sum(n), 9) AS f1_weighted FROM f")
def met_f1_weighted(fx):
    return metrics.f1_weighted(known(fx)).select(F.round("f1_weighted", 9).alias("f1_weighted"))


@query("met_fold_mean", f"{KNOWN}, fm AS (SELECT chrom, avg(a) AS mean FROM (SELECT chrom, sample, avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS a FROM kn GROUP BY ALL) GROUP BY chrom)\nSELECT chrom, round(mean, 9) AS mean, mean = (SELECT max(mean) FROM fm) AS best FROM fm")
def met_fold_mean(fx):
    own = metrics.accuracy(known(fx), ["chrom", "sample"])
    return metrics.fold_means(own, ["chrom"], "accuracy").withColumn("mean", F.round("mean", 9))


def training(fx):
    """Labelled candidates with pooled channel features and class weights."""
    cands = fx.cand.select(F.col("call_id").alias("sv_id"), "chrom", "l", "r")
    sparse = windows.placed(windows.hits_1d(cands, signals.signals_1d(fx.reads)))
    own = datasets.class_weights(rows(fx).filter("y is not null")).withColumn("fold", F.pmod(F.col("call_id"), F.lit(3)).cast("int"))
    pooled = models.pooled_features(sparse, pools=2).withColumnRenamed("sv_id", "call_id")
    return own.join(pooled, "call_id").select("call_id", "chrom", "sample", "y", "weight", "fold", "features")


@contextmanager
def trained_on(fx):
    """The training rows in a written table, which goes when they are no longer needed."""
    path = shared_path(fx.spark, "training")
    own = training(fx)
    own.write.parquet(path)
    try:
        yield fx.spark.read.schema(own.schema).parquet(path)
    finally:
        delete(fx.spark, path)


#: What the search tries: 24 models a fold.
GRID = {"reg_param": [0.01, 0.1, 1.0], "weight_power": [1.0, 0.0], "fit_intercept": [True, False], "standardize": [True, False]}


@query("ml_train")
def ml_train(fx):
    with trained_on(fx) as own:
        model = models.train(own)
    return fx.spark.createDataFrame([(float(model.intercept), int(model.numFeatures))], "intercept double, features int")


@query("ml_score")
def ml_score(fx):
    """Rows of two folds scored by a model that was fitted on the third: no row is scored by a model that saw it."""
    with trained_on(fx) as own:
        model = models.train(own.filter("fold = 0"))
        return kept(fx, models.score(model, own.filter("fold <> 0")).select("call_id", "y", "p_sv", "pred"), "scores")


@query("ml_param_search")
def ml_param_search(fx):
    with trained_on(fx) as own:
        best, found = models.param_search(own, GRID)
    rows = [(*(r[k] for k in GRID), r["mean"], r["finished"], {k: r[k] for k in GRID} == best) for r in found]
    return fx.spark.createDataFrame(rows, "reg_param double, weight_power double, fit_intercept boolean, standardize boolean, mean double, finished boolean, best boolean")


@query("ml_nested_cv")
def ml_nested_cv(fx):
    with trained_on(fx) as own:
        out = models.nested_cv(own, "chrom", {"reg_param": [0.01, 0.1], "standardize": [True, False]}).select("call_id", "chrom", "p_sv", "pred")
        return kept(fx, out, "nested-scores")


@query("ml_score_grouped")
def ml_score_grouped(fx):
    with trained_on(fx) as own:
        return kept(fx, models.score_grouped(own, "sample").select("call_id", "sample", "p_sv", "pred"), "grouped-scores")


def kept(fx, df, what):
    """``df`` written, as what it reads goes."""
    path = shared_path(fx.spark, what)
    df.write.parquet(path)
    return fx.spark.read.schema(df.schema).parquet(path)


@query("ml_collect", f"{K}\nSELECT key, call_id, qual FROM (SELECT l // 5000 AS key, call_id, qual, row_number() OVER (PARTITION BY l // 5000 ORDER BY call_id DESC) AS n FROM cand) WHERE n = 1")
def ml_collect(fx):
    return models.collect_scores(fx.cand.select(F.floor(F.col("l") / 5000).alias("key"), "call_id", "qual"), "key", "call_id")


# Sources and sinks, by lines made from the fixtures.
@query("src_reads", f"{R}\nSELECT qname, ord, flag, chrom, pos0, mapq, cigar, next_chrom, next_pos0, tlen, nm, sa FROM reads")
def src_reads(fx):
    return text.parse_sam(text.format_sam(fx.reads)).drop("seq", "qual")


def bedpe(fx):
    t = fx.truth
    return t.select(F.concat_ws("\t", "chrom", F.col("s1").cast("string"), F.col("e1").cast("string"), "chrom", F.col("s2").cast("string"), F.col("e2").cast("string"), F.when(F.col("svtype") == "DEL", "TYPE:DELETION").when(F.col("svtype") == "DUP", "INS").otherwise(F.col("svtype"))).alias("value"), F.col("tid").alias("ord"))


@query("src_bedpe", f"{KT}\nSELECT chrom AS chrom1, s1, e1, chrom AS chrom2, CASE svtype WHEN 'DUP' THEN s1 + 1 ELSE s2 END AS s2, CASE svtype WHEN 'DUP' THEN e1 + 1 ELSE e2 END AS e2, CASE svtype WHEN 'DUP' THEN 'INS' ELSE svtype END AS svtype FROM truth")
def src_bedpe(fx):
    return text.parse_bedpe(bedpe(fx))


@query("src_bedpe_candidates", f"{KT}\nSELECT chrom AS chrom1, s1 AS pos1, chrom AS chrom2, s2 AS pos2, '**' AS strands, CASE svtype WHEN 'DEL' THEN 'TYPE:DELETION' WHEN 'DUP' THEN 'INS' ELSE svtype END AS svtype FROM truth")
def src_bedpe_candidates(fx):
    return text.bedpe_candidates(bedpe(fx))


@query("src_bedpe_breakpoints", f"{KT}\nSELECT chrom, s1 AS l, s2 AS r, CASE svtype WHEN 'DEL' THEN 'TYPE:DELETION' WHEN 'DUP' THEN 'INS' ELSE svtype END AS svtype FROM truth")
def src_bedpe_breakpoints(fx):
    return text.bedpe_breakpoints(bedpe(fx))


def vcf(fx):
    gt = F.element_at(F.array(F.lit("0/1"), F.lit("1|1"), F.lit("1/2")), (F.col("qual") % 3).cast("int") + 1)
    ci = F.when(F.col("qual") % 4 == 0, ";CIPOS=-5,7;CIEND=-3,4;CIPOS95=-2,2").when(F.col("qual") % 4 == 1, ";CIPOS95=-2,2").when(F.col("qual") % 4 == 2, ";CIRPOS=-9,9").otherwise("")
    info = F.concat(F.lit("SVTYPE="), "svtype", F.lit(";END="), F.col("r").cast("string"), ci)
    return fx.cand.select(F.concat_ws("\t", "chrom", (F.col("l") + 1).cast("string"), F.lit("x"), F.lit("N"), F.lit("<SV>"), F.col("qual").cast("string"), F.lit("PASS"), info, F.lit("GT"), gt).alias("value"), F.col("call_id").alias("ord"))


@query("src_vcf_breakpoints", f"{K}\nSELECT chrom, l, r, svtype, CASE qual % 3 WHEN 0 THEN '0/1' WHEN 1 THEN '1/1' ELSE './.' END AS gt FROM cand")
def src_vcf_breakpoints(fx):
    return text.vcf_breakpoints(vcf(fx))


@query("src_vcf_ci", f"{K}\nSELECT chrom, l + 1 + CASE qual % 4 WHEN 0 THEN -2 WHEN 2 THEN -9 ELSE 0 END AS s1, l + 1 + CASE qual % 4 WHEN 0 THEN 2 WHEN 2 THEN 9 ELSE 0 END + 1 AS e1, r + CASE qual % 4 WHEN 0 THEN -3 ELSE 0 END AS s2, r + CASE qual % 4 WHEN 0 THEN 4 ELSE 0 END + 1 AS e2, svtype FROM cand")
def src_vcf_ci(fx):
    return text.vcf_confidence(vcf(fx))


@query("snk_scored_vcf", f"{K}, sc AS (SELECT chrom, l + 1 AS pos, max(call_id) AS ord FROM cand WHERE qual % 2 = 0 GROUP BY ALL)\nSELECT c.call_id AS ord, concat(c.chrom, chr(9), c.l + 1, chr(9), 'x', chr(9), 'N', chr(9), '<SV>', chr(9), d.qual, chr(9), 'PASS', chr(9), 'SVTYPE=', c.svtype, chr(9), 'END=', c.r) AS value FROM cand c JOIN sc ON sc.chrom = c.chrom AND sc.pos = c.l + 1 JOIN cand d ON d.call_id = sc.ord")
def snk_scored_vcf(fx):
    lines = fx.cand.select(F.concat_ws("\t", "chrom", (F.col("l") + 1).cast("string"), F.lit("x"), F.lit("N"), F.lit("<SV>"), F.lit("."), F.lit("PASS"), F.concat(F.lit("SVTYPE="), "svtype"), F.concat(F.lit("END="), F.col("r").cast("string"))).alias("value"), F.col("call_id").alias("ord"))
    scores = fx.cand.filter("qual % 2 = 0").select("chrom", (F.col("l") + 1).alias("pos"), F.col("call_id").alias("ord"), F.col("qual").alias("prob"))
    return text.scored_vcf(lines, scores)


@query("src_bed", f"{with_ctes('regions')}\nSELECT concat('chr', chrom) AS chrom, s, e FROM regions")
def src_bed(fx):
    return text.parse_bed(fx.regions.select(F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string")).alias("value")))


@query("src_bed_to_bedpe", f"{with_ctes('regions')}\nSELECT chrom AS chrom1, s AS s1, s + 1 AS e1, chrom AS chrom2, e AS s2, e + 1 AS e2, concat('DEL_', row_number() OVER (ORDER BY chrom, s, e)) AS id FROM regions")
def src_bed_to_bedpe(fx):
    return text.bed_to_bedpe(fx.regions)




def contig_lines(fx):
    """One line for each contig."""
    return fx.contigs.select(F.concat_ws("\t", "chrom", F.col("len").cast("string"), F.lit("4"), F.lit("60"), F.lit("61")).alias("value"))


@query("src_fai", f"{with_ctes('contigs')}\nSELECT chrom, len FROM contigs")
def src_fai(fx):
    return text.parse_fai(contig_lines(fx))


@query("src_contigs_minus1", f"{with_ctes('contigs')}\nSELECT chrom, len - 1 AS len FROM contigs")
def src_contigs_minus1(fx):
    return text.contigs_minus1(text.main_contigs(text.parse_fai(contig_lines(fx))))


@query("src_fasta", f"SELECT chrom, base, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM ({DUCK_BASES}) GROUP BY ALL")
def src_fasta(fx):
    """FASTA lines of 64 bases made from the base store, read back by place and summed up by base, a line at a time."""
    cut = basestore.base_runs(fx.store).select("chrom", (F.col("pos") / 64).cast("bigint").alias("k"), "text", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    body = cut.select("chrom", (F.col("k") + F.col("i")).alias("k"), F.trim(F.substring("text", F.col("i") * 64 + 1, F.lit(64))).alias("value")).filter("value <> ''")
    body = body.select("value", (F.col("chrom").cast("bigint") * (1 << 40) + F.col("k") + 1).alias("ord"))
    heads = fx.contigs.select(F.concat(F.lit(">"), "chrom").alias("value"), (F.col("chrom").cast("bigint") * (1 << 40)).alias("ord"))
    lines = text.fasta_lines(body.unionByName(heads))
    return text.base_sums(lines)


SIGNAL_TEXTS = f"""{SIG},
one AS (SELECT chrom, pos, event FROM s1), two AS (SELECT a_chrom, a_pos, b_chrom, b_pos, event FROM s2)"""


def signal_texts(fx):
    """Where both texts of all signals were written."""
    path = shared_path(fx.spark, "signals")
    text.write_all_signals(signals.signals(fx.reads), path, parts=fx.parts)
    return path


@query("src_signals", f"""{SIGNAL_TEXTS}
SELECT 'one' AS kind, chrom AS a_chrom, pos AS a_pos, NULL AS b_chrom, NULL AS b_pos, event FROM one
UNION ALL SELECT 'two', a_chrom, a_pos, b_chrom, b_pos, event FROM two WHERE event NOT BETWEEN 18 AND 21
UNION ALL SELECT 'discordant', a_chrom, CAST(floor(a_pos / 8.0) AS BIGINT), b_chrom, CAST(floor(b_pos / 8.0) AS BIGINT), event FROM two WHERE event BETWEEN 18 AND 21""")
def src_signals(fx):
    """Both texts of signals read back by their schemas, discordant pairs apart."""
    one, two, far = text.read_all_signals(fx.spark, signal_texts(fx))
    none = lambda kind: F.lit(None).cast(kind)
    one = one.select(F.lit("one").alias("kind"), F.col("chrom").alias("a_chrom"), F.col("pos").alias("a_pos"), none("string").alias("b_chrom"), none("bigint").alias("b_pos"), "event")
    return one.unionByName(two.withColumn("kind", F.lit("two"))).unionByName(far.withColumn("kind", F.lit("discordant")))


@query("snk_signals", f"""{SIGNAL_TEXTS}
SELECT 'soft_and_insertions' AS kind, concat_ws(chr(9), chrom, pos, event) AS value FROM one UNION ALL SELECT 'events2d', concat_ws(chr(9), a_chrom, a_pos, b_chrom, b_pos, event) FROM two""")
def snk_signals(fx):
    """The lines of both texts of signals, sorted and packed, as they are read back."""
    return text.read_signal_lines(fx.spark, signal_texts(fx))


@query("snk_channels", f"{TENSOR}, t AS (SELECT sv_id, channel, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * (\"offset\" + 1)) AS BIGINT) AS weighted FROM cells GROUP BY ALL HAVING sum(value) > 0)\nSELECT sv_id, cw.chrom, cw.l, cw.r, channel, total, weighted FROM t JOIN cw USING (sv_id)")
def snk_channels(fx):
    """Tensors with their positions, written to a store by place and read back by region: each row's sum, and its sum weighted by place."""
    own = fx.cand.select(F.col("call_id").alias("sv_id"), "chrom", "l", "r")
    parts_of = windows.stretches(own, signals.signals(fx.reads), fx.depth, fx.store)
    path = shared_path(fx.spark, "channels")
    packed = windows.tensors(parts_of, parts=fx.parts, packed=True)
    # By hint, as in the range joins: candidates are far more than the file that they are made from lets Spark expect.
    stores.write_store(packed.join(own.hint("merge"), "sv_id"), path, key="sv_id", parts=fx.parts)
    whole = fx.contigs.select("chrom", F.lit(0).alias("s"), (F.col("len") + 100_000).alias("e"))
    return windows.tensor_sums(stores.read_regions(fx.spark, path, whole), ["sv_id", "chrom", "l", "r"])


@query("src_reads_by_region", f"{R}, {with_ctes('regions', after=('reads',))}, sp AS (SELECT *, pos0 + CAST(coalesce(list_sum([CAST(v AS BIGINT) FOR v IN regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1)]), 0) AS BIGINT) AS e2 FROM reads)\nSELECT qname, ord, sp.chrom, pos0, e2 AS e FROM sp WHERE EXISTS (SELECT 1 FROM regions g WHERE g.chrom = sp.chrom AND pos0 < g.e AND e2 > g.s)")
def src_reads_by_region(fx):
    """Reads written to a store by place, and those over some region read back."""
    from lociflow.functions import cigar as C

    own = fx.reads.withColumn("e", F.coalesce(C.cigar_ref_end("pos0", "cigar"), F.col("pos0")))
    path = shared_path(fx.spark, "reads")
    stores.write_store(own, path, lo="pos0", hi="e", key="qname", parts=fx.parts)
    return stores.read_regions(fx.spark, path, fx.regions, lo="pos0", hi="e").select("qname", "ord", "chrom", "pos0", "e")


def typed(fx):
    return fx.cand.select("call_id", F.col("chrom").alias("chrom1"), F.col("l").alias("s1"), F.col("chrom").alias("chrom2"), F.col("r").alias("s2"), F.when(F.col("call_id") % 5 == 0, "TRA").otherwise(F.col("svtype")).alias("svtype"), "qual")


@query("snk_bedpe_to_vcf", f"""{K}, o AS MATERIALIZED (SELECT c.*, {BASE.replace('pos', 'l').replace('o_cust', 'b1.o_cust')} AS ref1, {BASE.replace('pos', 'r').replace('o_cust', 'b2.o_cust')} AS ref2 FROM cand c JOIN orders b1 ON b1.o_orderkey = l // 40 JOIN orders b2 ON b2.o_orderkey = r // 40)
SELECT call_id * 4 AS ord, concat(chrom, chr(9), l + 1, chr(9), 'sv', call_id, chr(9), ref1, chr(9), '<', svtype, '>', chr(9), qual, chr(9), 'PASS', chr(9), 'SVTYPE=', svtype, ';END=', r + 1) AS value FROM o WHERE call_id % 5 <> 0
UNION ALL SELECT call_id * 4, concat(chrom, chr(9), l + 1, chr(9), 'sv', call_id, '_1', chr(9), ref1, chr(9), ref1, '[', chrom, ':', r + 1, '[', chr(9), qual, chr(9), 'PASS', chr(9), 'SVTYPE=BND;MATEID=sv', call_id, '_2') FROM o WHERE call_id % 5 = 0
UNION ALL SELECT call_id * 4 + 1, concat(chrom, chr(9), r + 1, chr(9), 'sv', call_id, '_2', chr(9), ref2, chr(9), ']', chrom, ':', l + 1, ']', ref2, chr(9), qual, chr(9), 'PASS', chr(9), 'SVTYPE=BND;MATEID=sv', call_id, '_1') FROM o WHERE call_id % 5 = 0
UNION ALL SELECT call_id * 4 + 2, concat(chrom, chr(9), l + 1, chr(9), 'sv', call_id, '_3', chr(9), ref1, chr(9), ']', chrom, ':', r + 1, ']', ref1, chr(9), qual, chr(9), 'PASS', chr(9), 'SVTYPE=BND;MATEID=sv', call_id, '_4') FROM o WHERE call_id % 5 = 0
UNION ALL SELECT call_id * 4 + 3, concat(chrom, chr(9), r + 1, chr(9), 'sv', call_id, '_4', chr(9), ref2, chr(9), ref2, '[', chrom, ':', l + 1, '[', chr(9), qual, chr(9), 'PASS', chr(9), 'SVTYPE=BND;MATEID=sv', call_id, '_3') FROM o WHERE call_id % 5 = 0
UNION ALL SELECT -3, '##fileformat=VCFv4.2' UNION ALL SELECT -2, concat('##contig=<ID=', chrom, ',length=', len, '>') FROM span, (SELECT unnest(['12', '22']) AS chrom) UNION ALL SELECT -1, concat('#CHROM', chr(9), 'POS', chr(9), 'ID', chr(9), 'REF', chr(9), 'ALT', chr(9), 'QUAL', chr(9), 'FILTER', chr(9), 'INFO')""")
def snk_bedpe_to_vcf(fx):
    return text.bedpe_to_vcf(typed(fx), fx.contigs, fx.store)


@query("snk_vcf_to_bedpe", f"{K}\nSELECT chrom AS chrom1, l AS s1, l + 1 AS e1, chrom AS chrom2, r AS s2, r + 1 AS e2, svtype FROM cand WHERE r - l >= 400 AND (svtype <> 'INV' OR qual % 2 = 0)")
def snk_vcf_to_bedpe(fx):
    ends = fx.cand.select(F.col("chrom").alias("chrom1"), F.col("l").alias("start"), F.col("chrom").alias("chrom2"), F.col("r").alias("partner"), "svtype", (F.col("l") - F.col("r")).alias("sv_len"), F.concat(F.lit("sv_bp"), (F.col("qual") % 2 + 1).cast("string")).alias("end_id"))
    return text.vcf_to_bedpe(ends, 400)


@query("snk_pred_bedpe", f"{DS}, w AS (SELECT lab.chrom, lab.l, lab.r, ds.y, ds.pred, ds.score, row_number() OVER (ORDER BY lab.chrom, lab.l, lab.r, lab.call_id) AS n FROM lab JOIN ds USING (call_id) WHERE ds.pred <> ds.y)\nSELECT chrom AS chrom1, l AS s1, l + 1 AS e1, chrom AS chrom2, r AS s2, r + 1 AS e2, concat('PRED:', pred, '_TRUE:', y, '_', n) AS text, round(score, 6) AS score FROM w")
def snk_pred_bedpe(fx):
    own = rows(fx).select("call_id", "y", "pred", "score").join(fx.cand.select("call_id", "chrom", "l", "r"), "call_id")
    return text.prediction_bedpe(own, False).withColumn("score", F.round("score", 6))


