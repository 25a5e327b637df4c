"""Labels, region filters, breakpoint matching, merging and precision/recall of callsets.

Calls have call_id, chrom, l, r, svtype, qual and, where callers are compared, caller. Truth
has tid, chrom, s1, e1, s2, e2, svtype. Intervals are half open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import calls as X
from lociflow.operators.ranges import overlap, point_in_interval, ranked, running_sums


def in_bounds(cands: DataFrame, contigs: DataFrame, expand: int = 62) -> DataFrame:
    """Ends in order and at least ``expand`` from the contig's start and more than that from its end."""
    met = cands.join(F.broadcast(contigs.select(F.col("chrom").alias("__c"), "len")), F.col("chrom") == F.col("__c"))
    low, high = F.least("l", "r"), F.greatest("l", "r")
    return met.filter((low >= expand) & (high < F.col("len") - expand)).withColumns({"l": low, "r": high}).drop("__c", "len")


def in_window(cands: DataFrame, contigs: DataFrame, half: int) -> DataFrame:
    """Both ends between ``half`` and the contig's length less ``half``."""
    met = cands.join(F.broadcast(contigs.select(F.col("chrom").alias("__c"), "len")), F.col("chrom") == F.col("__c"))
    return met.filter(F.col("l").between(half, F.col("len") - half) & F.col("r").between(half, F.col("len") - half)).drop("__c", "len")


def first_of(cands: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return cands.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__n = 1").drop("__n")


def enveloped(cands: DataFrame, truth: DataFrame, half: int) -> DataFrame:
    """(call_id, side, sv, svtype, s, e, at): truth intervals that lie whole inside a candidate's window, by side."""
    out = []
    for side, at, s, e in (("start", "l", "s1", "e1"), ("end", "r", "s2", "e2")):
        spans = cands.select("call_id", F.col("chrom").alias("__c"), F.col(at).alias("at"), (F.col(at) - half).alias("__lo"), (F.col(at) + half + 1).alias("__hi"))
        own = truth.select("chrom", F.col(s).alias("s"), F.col(e).alias("e"), "svtype", X.sv_id("svtype", "chrom", "s1", "chrom", "s2").alias("sv"))
        met = point_in_interval(own, spans, "s", "__lo", "__hi", [("chrom", "__c")], 4 * half, longest=2 * half + 1).filter("e <= __hi")
        out.append(met.select("call_id", F.lit(side).alias("side"), "sv", "svtype", "s", "e", "at"))
    return out[0].unionByName(out[1])


def label_counts(cands: DataFrame, truth: DataFrame, half: int) -> DataFrame:
    """``cands`` with ``n_start`` and ``n_end``: different truth intervals in reach of each end."""
    hit = enveloped(cands, truth, half).groupBy("call_id").agg(*(F.countDistinct(F.when(F.col("side") == s, F.struct("s", "e", "sv"))).alias(f"n_{s}") for s in ("start", "end")))
    return cands.join(hit, "call_id", "left").fillna(0, ["n_start", "n_end"])


def _by_variant(cands: DataFrame, truth: DataFrame, half: int) -> DataFrame:
    """(call_id, sv, n_start, n_end, a, b, all_tight, t): hits of each candidate and variant, from one run of the range joins.

    ``a`` and ``b`` say for each side whether a hit lies inside the window without its last base.
    """
    tight, own = F.col("e") <= F.col("at") + half, {k: F.col("side") == k for k in ("start", "end")}
    counts = [F.size(F.collect_set(F.when(own[k], F.struct("s", "e")))).cast("bigint").alias(f"n_{k}") for k in own]
    flags = [F.max(F.when(own[k], tight)).alias(n) for k, n in (("start", "a"), ("end", "b"))]
    return enveloped(cands, truth, half).groupBy("call_id", "sv").agg(*counts, *flags, F.min(tight).alias("all_tight"), F.min("svtype").alias("t"))


def decide(cands: DataFrame, truth: DataFrame, half: int, svtype: str = "DEL", strict: bool = False) -> DataFrame:
    """``label_counts`` with ``label``: the type, or ``no`` and the type.

    One hit at each end must be the same variant, and lie inside the window without its last
    base. Several hits at an end give the type without comparing variants; with ``strict`` the
    ends must share one.
    """
    shared = F.expr("a is not null and b is not null")
    hits = _by_variant(cands, truth, half).groupBy("call_id").agg(F.sum("n_start").alias("n_start"), F.sum("n_end").alias("n_end"), F.max(F.when(shared, F.expr("a and b"))).alias("tight"), F.min(F.when(shared, F.col("t"))).alias("t"))
    out = cands.join(hits, "call_id", "left").fillna(0, ["n_start", "n_end"])
    several = (F.col("n_start") > 1) | (F.col("n_end") > 1)
    single = (F.col("n_start") == 1) & (F.col("n_end") == 1) & F.coalesce("tight", F.lit(False))
    if strict:
        several = several & F.col("t").isNotNull()
    return out.withColumn("label", F.when(single, F.col("t")).when(several, svtype).otherwise(f"no{svtype}")).drop("tight", "t")


def covered(cands: DataFrame, truth: DataFrame, half: int) -> DataFrame:
    """(sv): variants that some candidate covers with both ends."""
    whole = Window.partitionBy("call_id")  # the variants in reach of one candidate
    each = _by_variant(cands, truth, half).withColumn("all_start", F.sum("n_start").over(whole)).withColumn("all_end", F.sum("n_end").over(whole))
    return each.filter("n_start > 0 and n_end > 0 and (all_start > 1 or all_end > 1 or all_tight)").select("sv").distinct()


def uncovered(truth: DataFrame, covered_ids: DataFrame) -> DataFrame:
    """Truth rows that no candidate covers; TRA rows are left out."""
    own = truth.filter("svtype <> 'TRA'").withColumn("sv", X.sv_id("svtype", "chrom", "s1", "chrom", "s2"))
    return own.join(covered_ids, "sv", "left_anti")


def coverage_percent(n_covered: Column, n_all: Column) -> Column:
    return F.when(n_all == 0, 0).otherwise(F.floor(100 * n_covered / n_all)).cast("bigint")


def refuse_duplicates(df: DataFrame, key: str) -> DataFrame:
    """``df``, or an error when it is run if a key comes twice."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("__n", n).filter(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate id: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("__n")


def balance(labelled: DataFrame, positive: str, order: str) -> DataFrame:
    """All positives and as many other rows, first by ``order``, from a global sort without a single-task window."""
    yes, no = labelled.filter(F.col("label") == positive), labelled.filter(F.col("label") != positive)
    return yes.unionByName(no.orderBy(order).limit(yes.count()))


def touching(calls: DataFrame, regions: DataFrame, at: str) -> DataFrame:
    """(call_id) of calls whose one-base end lies in a region."""
    ends = calls.select("call_id", F.col("chrom").alias("__c"), F.col(at).alias("__p"))
    return point_in_interval(ends, regions.select("chrom", "s", "e"), "__p", "s", "e", [("__c", "chrom")], 2048).select("call_id").distinct()


def remove_regions(calls: DataFrame, regions: DataFrame) -> DataFrame:
    """Calls of which no end lies in a region."""
    return calls.join(touching(calls, regions, "l").union(touching(calls, regions, "r")), "call_id", "left_anti")


def keep_regions(calls: DataFrame, regions: DataFrame) -> DataFrame:
    """Calls of which both ends lie in regions."""
    return calls.join(touching(calls, regions, "l"), "call_id", "left_semi").join(touching(calls, regions, "r"), "call_id", "left_semi")


def matches(calls: DataFrame, truth: DataFrame, maxgap: int = 200, size_part: float = 0.5, size_margin: float = 0.25, sizes: bool = True) -> DataFrame:
    """(call_id, tid, qual): calls and truth rows whose breakpoints agree.

    Start and end differ by at most ``maxgap``, and at most half the truth's size, and sizes by
    at most a quarter; without ``sizes`` (insertions) only the gap counts.
    """
    spans = truth.select("tid", F.col("chrom").alias("__c"), F.col("s1").alias("__s"), F.col("s2").alias("__e"), (F.col("s1") - maxgap).alias("__lo"), (F.col("s1") + maxgap + 1).alias("__hi"))
    met = point_in_interval(calls, spans, "l", "__lo", "__hi", [("chrom", "__c")], 4 * maxgap, longest=2 * maxgap + 1)
    size, own = F.col("__e") - F.col("__s"), F.col("r") - F.col("l")
    gap = F.least(F.lit(float(maxgap)), size_part * size) if sizes else F.lit(float(maxgap))
    ok = (F.abs(F.col("l") - F.col("__s")) <= gap) & (F.abs(F.col("r") - F.col("__e")) <= gap)
    if sizes:
        ok = ok & (F.abs(own - size) <= size_margin * size)
    keep = [c for c in ("caller",) if c in calls.columns]
    return met.filter(ok).select("call_id", "tid", "qual", *keep)


def best_matches(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each truth row credits only its best-QUAL call (the smaller id of equals), within ``by``."""
    w = Window.partitionBy("tid", *(by or [])).orderBy(F.desc("qual"), "call_id")
    return found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def match_counts(calls: DataFrame, best: DataFrame) -> DataFrame:
    """``calls`` with ``hits``, the truth rows that credit each."""
    return calls.join(best.groupBy("call_id").agg(F.count("*").alias("hits")), "call_id", "left").fillna(0, ["hits"])


def pr_curve(counted: DataFrame, n_truth: int) -> DataFrame:
    """(caller, qual, calls, tp, cum_tp, cum_n, cum_fp, precision, recall) by falling QUAL.

    Calls are summed up by QUAL first; the sums run over ranges of QUALs of a caller.
    """
    own = counted.groupBy("caller", "qual").agg(F.count("*").alias("calls"), F.count_if(F.col("hits") > 0).alias("tp")).withColumn("__falling", -F.col("qual"))
    own = running_sums(own, ["caller"], ["__falling"], {"cum_tp": "tp", "cum_n": "calls"}).drop("__falling").withColumn("cum_fp", F.col("cum_n") - F.col("cum_tp"))
    return own.withColumn("precision", F.col("cum_tp") / F.col("cum_n")).withColumn("recall", F.col("cum_tp") / F.lit(n_truth))


def operating_point(curve: DataFrame, at: float = 0.5) -> DataFrame:
    """Each caller's row nearest to QUAL ``at``; the smaller QUAL of equals."""
    return curve.groupBy("caller").agg(F.min_by(F.struct("qual", "precision", "recall"), F.struct(F.abs(F.col("qual") - at), F.col("qual"))).alias("x")).select("caller", "x.*")


def caller_summary(counted: DataFrame, n_truth: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, calls, tp, fp, precision, recall, f1) by caller or by all given keys."""
    own = counted.groupBy(*(keys or ["caller"])).agg(F.count("*").alias("calls"), F.count_if(F.col("hits") > 0).alias("tp"))
    own = own.withColumn("fp", F.col("calls") - F.col("tp")).withColumn("precision", F.col("tp") / F.col("calls")).withColumn("recall", F.col("tp") / F.lit(n_truth))
    return own.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def param_sweep(counted: DataFrame, truth: DataFrame, keys: list[str], truth_keys: list[str], sets: list[list[str]]) -> DataFrame:
    """(keys, calls, tp, fp, n_truth, precision, recall, f1) for each set of keys, ``all`` for the keys outside it.

    ``counted`` has the keys and hits, ``truth`` the ``truth_keys`` (those of the keys that a truth row
    has too). Recall is by the truth of the same group, not by all of it; a group without truth has
    recall 0. Null keys are a group of their own.
    """
    named = lambda c: F.when(F.grouping(c) == 1, "all").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias(c)
    grouped = lambda s: [[F.col(c) for c in one] for one in s]
    calls = counted.groupingSets(grouped(sets), *(F.col(c) for c in keys)).agg(F.count("*").alias("calls"), F.count_if(F.col("hits") > 0).alias("tp"), *(named(c).alias(f"__{c}") for c in keys))
    calls = calls.select(*(F.col(f"__{c}").alias(c) for c in keys), "calls", "tp")
    own_sets = [list(x) for x in dict.fromkeys(tuple(c for c in one if c in truth_keys) for one in sets)]
    held = truth.groupingSets(grouped(own_sets), *(F.col(c) for c in truth_keys)).agg(F.count("*").alias("n_truth"), *(named(c).alias(f"__{c}") for c in truth_keys))
    held = held.select(*(F.col(f"__{c}").alias(c) for c in truth_keys), "n_truth")
    own = calls.join(held, truth_keys, "left").fillna(0, ["n_truth"]).withColumn("fp", F.col("calls") - F.col("tp")).withColumn("precision", F.col("tp") / F.col("calls"))
    own = own.withColumn("recall", F.when(F.col("n_truth") > 0, F.col("tp") / F.col("n_truth")).otherwise(0.0))
    f1 = F.when((F.col("tp") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return own.select(*keys, "calls", "tp", "fp", "n_truth", "precision", "recall", f1.alias("f1"))


def on_chroms(calls: DataFrame, chroms: list[str], chrom1: str = "chrom1", chrom2: str = "chrom2") -> DataFrame:
    """Calls whose ends lie on one chromosome, and on one of ``chroms``."""
    return calls.filter((F.col(chrom1) == F.col(chrom2)) & F.col(chrom1).isin(chroms))


def cut_by_qual(ends: DataFrame, above: float = 0.5, qual: str = "qual", key: str = "end_id", partner: str = "partner_id") -> DataFrame:
    """Breakends with a QUAL above ``above`` whose partner has passed the cut too."""
    return keep_partnered(ends.filter(F.col(qual) > above), key, partner)


def restrict(calls: DataFrame, truth: DataFrame, chrom: str) -> tuple[DataFrame, DataFrame]:
    """Calls and truth of one chromosome."""
    return calls.filter(F.col("chrom") == chrom), truth.filter(F.col("chrom") == chrom)


def as_truth(calls: DataFrame) -> DataFrame:
    """A callset in the truth's columns, to match callsets with each other."""
    return calls.select(F.col("call_id").alias("tid"), "chrom", F.col("l").alias("s1"), (F.col("l") + 1).alias("e1"), F.col("r").alias("s2"), (F.col("r") + 1).alias("e2"), "svtype")


def dedup_calls(calls: DataFrame, **options) -> DataFrame:
    """The best-QUAL call of each call's match set, once each."""
    own = matches(calls, as_truth(calls), **options)
    best = own.groupBy("tid").agg(F.max_by("call_id", F.struct(F.col("qual"), -F.col("call_id"))).alias("call_id")).select("call_id").distinct()
    return calls.join(best, "call_id", "left_semi")


def union_calls(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    """All of ``a``, and of ``b`` what matches nothing in ``a``; all of ``b`` where nothing matches."""
    met = matches(b, as_truth(a), size_margin=float("inf"), **options).select("call_id").distinct()
    return a.unionByName(b.join(met, "call_id", "left_anti"))


def truth_hits(truth: DataFrame, best: DataFrame, caller: str) -> DataFrame:
    return truth.join(best.filter(F.col("caller") == caller).select("tid").distinct(), "tid", "left_semi")


def venn(truth: DataFrame, found: DataFrame, one: str, two: str) -> DataFrame:
    """(only_one, only_two, both, missed): truth rows by which of two callers hit them."""
    own = found.groupBy("tid").agg(F.max(F.col("caller") == one).alias("a"), F.max(F.col("caller") == two).alias("b"))
    met = truth.select("tid").join(own, "tid", "left").fillna(False, ["a", "b"])
    return met.agg(F.count_if(F.expr("a and not b")).alias("only_one"), F.count_if(F.expr("b and not a")).alias("only_two"), F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.expr("not a and not b")).alias("missed"))


def upset(truth: DataFrame, found: DataFrame, callers: list[str]) -> DataFrame:
    """(pattern, n): truth rows by the set of callers that hit them, as 0/1 text in the given order."""
    own = found.groupBy("tid").agg(*(F.max((F.col("caller") == c).cast("int")).alias(f"__{c}") for c in callers))
    met = truth.select("tid").join(own, "tid", "left").fillna(0)
    return met.groupBy(F.concat(*(F.col(f"__{c}").cast("string") for c in callers)).alias("pattern")).agg(F.count("*").alias("n"))


def split_by_support(calls: DataFrame, support: DataFrame, half: int = 100, enclosed: bool = False) -> DataFrame:
    """``calls`` with ``supported``: some split pair lies near both ends.

    An end is met when a support position's window of ``half`` overlaps it; with ``enclosed``
    the call's end interval (s1..e1, s2..e2) must contain that window whole. ``support`` has
    chrom1, pos1, chrom2, pos2.
    """
    pairs = support.select("chrom1", "pos1", "chrom2", "pos2").distinct().withColumn("a", F.col("pos1") - half).withColumn("b", F.col("pos1") + half + 1)
    own = calls.select("call_id", F.col("chrom").alias("__c"), "s1", "e1", "s2", "e2")
    met = overlap(pairs, own, ("a", "b"), ("s1", "e1"), [("chrom1", "__c")], 4 * half).filter(F.col("chrom2") == F.col("__c"))
    if enclosed:
        ok = (F.col("s1") <= F.col("a")) & (F.col("b") <= F.col("e1")) & (F.col("s2") <= F.col("pos2") - half) & (F.col("pos2") + half + 1 <= F.col("e2"))
    else:
        ok = (F.col("pos2") - half < F.col("e2")) & (F.col("s2") < F.col("pos2") + half + 1)
    yes = met.filter(ok).select("call_id").distinct().withColumn("supported", F.lit(True))
    return calls.join(yes, "call_id", "left").fillna(False, ["supported"])


def keep_partnered(ends: DataFrame, key: str = "end_id", partner: str = "partner_id") -> DataFrame:
    """Breakends whose partner is there too."""
    return ends.join(ends.select(F.col(key).alias("__k")), F.col(partner) == F.col("__k"), "left_semi")


def scores_to_calls(calls: DataFrame, scores: DataFrame) -> DataFrame:
    """Calls (chrom, pos) with ``prob`` of their key; the last score by ``ord`` wins, calls without one go."""
    last = scores.withColumn("__n", F.row_number().over(Window.partitionBy("chrom", "pos").orderBy(F.desc("ord")))).filter("__n = 1").select("chrom", "pos", "prob")
    return calls.join(last, ["chrom", "pos"])


def fix_translocations(rows: DataFrame, order: str = "ord") -> DataFrame:
    """TRA rows that come in twos get connections 3to3 and 5to5 and ids of their own; numbered within a chromosome by order, a range at a time."""
    own = ranked(rows, ["chrom"], [order], "n")
    return own.withColumn("connection", F.when(F.col("n") % 2 == 1, "3to3").otherwise("5to5")).withColumn("uid", F.concat_ws("_", F.lit("TRA"), "chrom", F.col("n").cast("string")))
