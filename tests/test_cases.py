"""Hand-written cases of the read, window, label and dataset operators."""

import pytest
from pyspark.sql import functions as F

from lociflow.functions import calls as X
from lociflow.functions import cigar as C
from lociflow.operators import callsets, datasets, genome, metrics, ranges, reads, signals, windows
from lociflow.sources import text

READ = "qname string, ord long, flag int, chrom string, pos0 long, mapq int, cigar string, next_chrom string, next_pos0 long, tlen long, nm int, sa string"


def read(q="q", ord=1, flag=67, pos=100, mapq=60, cigar="100M", nc="1", npos=300, tlen=300, nm=0, sa=None, chrom="1"):
    return (q, ord, flag, chrom, pos, mapq, cigar, nc, npos, tlen, nm, sa)


def pair(spark, a, b=None):
    b = b or read(ord=2, flag=131, pos=300, npos=100)
    return spark.createDataFrame([a, b], READ)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_depth_leaves_out_the_last_base(spark):  # C1
    df = spark.createDataFrame([read(pos=10, cigar="4M")], READ)
    assert got(reads.depth(df)) == [("1", 10, 13, 1)]
    assert sum(r["depth"] for r in reads.dense_depth(reads.depth(df)).collect()) == 3


def test_double_clip(spark):  # C2, T8
    df = pair(spark, read(cigar="15S70M15S"))
    assert got(signals.signals_1d(df)) == [("1", 100, 1), ("1", 170, 2)]
    assert ("1", 100, "1", 170, 8) in got(signals.signals_2d(df))
    each = signals.paired_reads(reads.pair_mates(df))
    assert signals.soft_clips(each, exclude_double=True).count() == 0


def test_long_deletion_positions(spark):  # C3, T3
    df = spark.createDataFrame([("30M60D10M60D5M",)], "c string")
    both = df.select(C.get_indels("c", F.lit(0)).alias("a"), C.get_indels("c", F.lit(0), compat=True).alias("b")).first()
    assert [tuple(x) for x in both["a"]] == [("DEL", 31, 90), ("DEL", 101, 160)]
    assert [tuple(x) for x in both["b"]] == [("DEL", 31, 90), ("DEL", 41, 100)]


@pytest.mark.parametrize(
    "own, sa, expect",
    [
        ("20S80M", "1,50,+,50M20S,30,0", ("1", 99, "1", 100, 14)), ("80M20S", "1,50,+,50M20S,30,0", ("1", 99, "1", 179, 14)),
        ("20S80M", "1,50,+,20S50M,30,0", ("1", 50, "1", 100, 14)), ("80M20S", "1,50,-,20S50M,30,0", ("1", 50, "1", 180, 16)),
        ("20S80M", "1,500,+,50M20S,30,0", ("1", 100, "1", 550, 14)), ("80M20S", "1,500,-,50M20S,30,0", ("1", 180, "1", 550, 17)),
        ("20S80M", "1,500,+,20S50M,30,0", ("1", 99, "1", 499, 14)), ("80M20S", "2,500,+,20S50M,30,0", ("1", 180, "2", 499, 12)),
        ("80M20S", "1,500,+,20S50M,5,0", ("1", 180, "1", 499, 11)),
    ],
)
def test_split_table(spark, own, sa, expect):  # C4, C5, T1
    each = signals.paired_reads(reads.pair_mates(pair(spark, read(cigar=own, sa=sa + ";"))))
    assert got(signals.splits(each)) == [expect]


def test_split_without_quality_is_dropped(spark):  # C5
    each = signals.paired_reads(reads.pair_mates(pair(spark, read(cigar="80M20S", sa="1,500,+,20S50M,0,0;"))))
    assert signals.splits(each).count() == 0


def test_mate_unmapped(spark):  # C6
    df = pair(spark, read(flag=73, npos=100), read(ord=2, flag=133, mapq=0, cigar=None))
    assert got(signals.signals_2d(df)) == [("1", 100, "1", 200, 13)]


def test_third_read_starts_a_new_pair(spark):
    df = spark.createDataFrame([read(ord=i) for i in (1, 2, 3)], READ)
    assert reads.pair_mates(df).count() == 1


def test_insert_size_rank(spark):  # C7
    df = spark.createDataFrame([read(q=f"q{i}", ord=i, flag=99, tlen=i) for i in range(1, 1001)], READ)
    assert reads.insert_size_percentile(df).first()["insert_size"] == 995


def test_window_edges(spark):  # C8, T11
    c = spark.createDataFrame([(1, "1", 1000, 3000)], "sv_id long, chrom string, l long, r long")
    ev = spark.createDataFrame([("1", p, 1) for p in (938, 1062, 2938, 3062)], "chrom string, pos long, event int")
    hits = windows.hits_1d(c, ev)
    assert [r[2] for r in got(windows.place(hits))] == [0, 132]
    assert [r[2] for r in got(windows.place(hits, compat=True))] == [0, 124, 132]


def test_overlapping_windows_count_twice(spark):  # C9
    c = spark.createDataFrame([(1, "1", 1000, 1050)], "sv_id long, chrom string, l long, r long")
    ev = spark.createDataFrame([("1", 1020, 1)], "chrom string, pos long, event int")
    assert windows.hits_1d(c, ev).count() == 2


def test_dense_tensor(spark):
    s = spark.createDataFrame([(1, 0, 0, 7), (1, 2, 255, 9), (1, 34, 255, 1)], "sv_id long, channel int, offset int, value long")
    t = windows.dense(s).first()["tensor"]
    assert (len(t), {len(r) for r in t}) == (35, {256}) and (t[0][0], t[2][255], t[34][255], sum(map(sum, t))) == (7, 9, 1, 17)


CAND, TRUTH = "call_id long, chrom string, l long, r long, svtype string, qual long", "tid long, chrom string, s1 long, e1 long, s2 long, e2 long, svtype string"


@pytest.mark.parametrize(
    "truth, label, strict",
    [
        ([], "noDEL", "noDEL"), ([(1000, 9000)], "noDEL", "noDEL"), ([(1000, 2000)], "DEL", "DEL"), ([(1000, 9000), (9000, 2000)], "noDEL", "noDEL"),
        ([(1000, 9000), (1001, 9500)], "DEL", "noDEL"), ([(1000, 2000), (1001, 2001)], "DEL", "DEL"), ([(1100, 2000)], "noDEL", "noDEL"),
    ],
)
def test_labels(spark, truth, label, strict):  # C10, T15
    c = spark.createDataFrame([(1, "1", 1000, 2000, "DEL", 5)], CAND)
    t = spark.createDataFrame([(i, "1", s, s + 1, e, e + 1, "DEL") for i, (s, e) in enumerate(truth)], TRUTH)
    assert callsets.decide(c, t, 100).first()["label"] == label
    assert callsets.decide(c, t, 100, strict=True).first()["label"] == strict


def test_duplicate_guard(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="duplicate id"):
        callsets.refuse_duplicates(df, "k").collect()


def test_n_runs_reach_the_end(spark):  # C11, T17
    df = spark.createDataFrame([("1", i, b) for i, b in enumerate("NNACNNN")], "chrom string, pos long, base string")
    assert got(ranges.runs_of(df.filter("base = 'N'"), block=4)) == [("1", 0, 2), ("1", 4, 7)]


def test_merge_joins_adjacent(spark):
    df = spark.createDataFrame([("1", 0, 5), ("1", 5, 9), ("1", 11, 12), ("2", 1, 2), ("1", 3, 4)], "chrom string, s long, e long")
    assert got(ranges.merge_intervals(df)) == [("1", 0, 9), ("1", 11, 12), ("2", 1, 2)]


def test_range_join_at_bin_borders(spark):
    p = spark.createDataFrame([(i,) for i in range(-12, 13)], "p long").withColumn("c", F.lit("1"))
    v = spark.createDataFrame([("1", -8, -3), ("1", 0, 4), ("1", 4, 4), ("1", 3, 9)], "d string, lo long, hi long")
    out = got(ranges.point_in_interval(p, v, "p", "lo", "hi", [("c", "d")], 4).select("p", "lo", "hi"))
    assert out == sorted((x, a, b) for x in range(-12, 13) for a, b in ((-8, -3), (0, 4), (4, 4), (3, 9)) if a <= x < b)


def test_last_score_wins(spark):  # C12
    c = spark.createDataFrame([("1", 5, "x")], "chrom string, pos long, id string")
    s = spark.createDataFrame([("1", 5, 1, 0.2), ("1", 5, 2, 0.9), ("1", 6, 3, 0.1)], "chrom string, pos long, ord long, prob double")
    assert [r["prob"] for r in callsets.scores_to_calls(c, s).collect()] == [0.9]


def test_union_without_hits_keeps_all(spark):  # C13, T18
    a = spark.createDataFrame([(1, "1", 1000, 2000, "DEL", 5)], CAND)
    b = spark.createDataFrame([(2, "1", 50000, 60000, "DEL", 5), (3, "2", 1000, 2000, "DEL", 5)], CAND)
    assert callsets.union_calls(a, b).count() == 3


def test_equal_positions_take_the_later_bin(spark):  # C14
    df = spark.createDataFrame([(i, "1", p) for i, p in enumerate([1, 2, 2, 2, 5, 6])], "id long, chrom string, pos long")
    assert {r["pos"]: r["bin"] for r in datasets.genomic_bins(df).collect()} == {1: 0, 2: 1, 5: 2, 6: 2}


def test_average_precision_with_ties(spark):  # C15
    df = spark.createDataFrame([("k", 0.9, True), ("k", 0.5, False), ("k", 0.5, True), ("k", 0.1, False)], "k string, score double, hit boolean")
    assert metrics.average_precision(df, ["k"]).first()[1] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_lost_condition_of_group_splits(spark):  # T19
    df = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "1"), ("B", "2"), ("B", "3")], "sample string, chrom string")
    part = lambda **o: sorted((r[0], r[1], r[2]) for r in datasets.leave_group_out(df, "A", "chrom", ["1"], ["2"], **o).collect())
    assert part() == [("A", "1", "test"), ("A", "2", "validation"), ("B", "3", "train")]
    assert ("B", "2", "train") in part(compat=True)


def test_folds(spark):
    df = spark.range(11).withColumnRenamed("id", "ord").withColumn("label", F.when(F.col("ord") < 4, "a").otherwise("b"))
    assert sorted(r["count"] for r in datasets.kfold_contiguous(df, 3).groupBy("fold").count().collect()) == [3, 4, 4]
    by = {(r["label"], r["fold"]): r["count"] for r in datasets.kfold_stratified(df, 2, "ord").groupBy("label", "fold").count().collect()}
    assert by[("a", 0)] == by[("a", 1)] == 2 and abs(by[("b", 0)] - by[("b", 1)]) <= 1


def test_leaking_split_fails(spark):
    df = spark.createDataFrame([("A", "1", "train"), ("A", "1", "test")], "sample string, chrom string, part string")
    with pytest.raises(Exception, match="leaks"):
        datasets.assert_split(df, "A", "chrom", ["1"]).collect()


def test_equals_in_cigar_and_null(spark):  # T2
    df = spark.createDataFrame([("5=1X4D3I2S",), (None,)], "c string")
    assert [r[0] for r in df.select(C.cigar_ref_end(F.lit(10), "c")).collect()] == [20, None]
    assert [r[0] for r in df.select(C.is_clipped("c")).collect()] == [True, False]


def test_one_hot_orders(spark):  # T4
    row = spark.range(1).select(X.base_one_hot(F.lit("t")).alias("a"), X.base_one_hot(F.lit("t"), X.GENOME_BASES).alias("b"), X.base_one_hot(F.lit("t"), compat=True).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == ([0, 0, 1, 0, 0], [0, 1, 0, 0, 0], [0] * 5)


def test_breakend_texts(spark):
    df = spark.createDataFrame([("N[2:5[",), ("N]2:5]",), ("]2:5]N",), ("[2:5[NAC",), ("<DEL>",)], "alt string")
    out = [r[0] for r in df.select(X.bnd_alt(F.lit("N"), "alt")).collect()]
    assert [tuple(x) if x else None for x in out] == [("3to5", "2", 5, 0), ("3to3", "2", 5, 0), ("5to3", "2", 5, 0), ("5to5", "2", 5, 2), None]


def test_insertion_candidates_are_near(spark):  # T14
    rows = [read(q=f"a{i}", ord=i, cigar="50M50S", pos=100) for i in range(3)] + [read(q=f"b{i}", ord=9 + i, cigar="50S50M", pos=149) for i in range(3)] + [read(q=f"c{i}", ord=20 + i, cigar="50S50M", pos=900) for i in range(3)]
    assert [r[1] for r in got(genome.insertion_candidates(spark.createDataFrame(rows, READ)))] == [150]


def test_text_round_trips(spark, tmp_path):
    df = spark.createDataFrame([read(sa="1,5,+,3M,9,0;"), read(q="r", ord=2, cigar=None)], READ)
    path = str(tmp_path / "sam")
    text.format_sam(df).select("value").write.text(path)
    back = text.read_sam(spark, path).drop("seq", "qual", "ord")
    assert got(back.fillna("", ["cigar", "sa"])) == got(df.drop("ord").fillna("", ["cigar", "sa"]))
    ev = spark.createDataFrame([("2", 5, 1), ("1", 7, 3)], "chrom string, pos long, event int")
    text.write_signals(ev, str(tmp_path / "ev"), ["chrom", "pos"])
    assert got(text.parse_signals(spark.read.text(str(tmp_path / "ev")), text.SIGNALS_1D)) == got(ev)
    fasta = spark.createDataFrame([(">a x", 0), ("ACG", 1), ("TN", 2), (">b", 3), ("G", 4)], "value string, ord long")
    assert got(text.parse_fasta(fasta, block=2)) == [("a", 0, "A"), ("a", 1, "C"), ("a", 2, "G"), ("a", 3, "T"), ("a", 4, "N"), ("b", 0, "G")]
