"""Range joins by levels of bins, carried values, ranks and the base store against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lociflow.operators import basestore, ranges
from lociflow.sources import text


def spans(rng, n, first):
    """Intervals of all lengths from 1 to 10 ** 8, an empty one among them."""
    out = []
    for i in range(n):
        start = rng.randint(0, 2 * 10**8)
        out.append((first + i, rng.choice("xy"), start, start + int(10 ** rng.uniform(0, 8))))
    return [*out, (first + n, "x", 5, 5)]


def meets(x, y):
    return x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]


def test_overlaps_of_all_lengths(spark):
    rng = random.Random(5)
    left, right = spans(rng, 250, 0), spans(rng, 250, 1000)
    right += [(2000 + i, "x", left[i][2], left[i][3]) for i in range(20)] + [(3000, "x", left[0][3], left[0][3] + 1)]
    a, b = spark.createDataFrame(left, "i long, c string, s long, e long"), spark.createDataFrame(right, "j long, d string, t long, f long")
    got = sorted((r["i"], r["j"]) for r in ranges.overlap(a, b, ("s", "e"), ("t", "f"), [("c", "d")], 256).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if meets(x, y)) and len(got) > 500
    short = [(i, "x", q, q + rng.randint(1, 248)) for i, q in enumerate(rng.choice(right)[rng.choice([2, 3])] - rng.randint(0, 200) for _ in range(300))]
    c = spark.createDataFrame(short, "i long, c string, s long, e long")
    want = sorted((x[0], y[0]) for x in short for y in right if meets(x, y))
    assert want == sorted((r["i"], r["j"]) for r in ranges.overlap(c, b, ("s", "e"), ("t", "f"), [("c", "d")], 256, (248, None)).collect())
    assert want == sorted((r["i"], r["j"]) for r in ranges.overlap(b, c, ("t", "f"), ("s", "e"), [("d", "c")], 256, (None, 248)).collect())


def test_points_in_intervals_of_all_lengths(spark):
    rng = random.Random(6)
    held = spans(rng, 250, 0)
    points = [(k, rng.choice("xy"), rng.choice([rng.choice(held)[2], rng.choice(held)[3], rng.choice(held)[3] - 1, rng.randint(0, 2 * 10**8)])) for k in range(500)]
    a, p = spark.createDataFrame(held, "i long, c string, s long, e long"), spark.createDataFrame(points, "k long, g string, p long")
    got = sorted((r["k"], r["i"]) for r in ranges.point_in_interval(p, a, "p", "s", "e", [("g", "c")], 256).collect())
    assert got == sorted((p[0], x[0]) for x in held for p in points if x[1] == p[1] and x[2] <= p[2] < x[3])


def test_long_intervals_make_few_rows(spark):
    """An interval of a whole contig is two rows in its own bins and two a level above at most, however narrow the bins."""
    one = spark.createDataFrame([("x", 0, 250_000_000)], "c string, s long, e long")
    plan = ranges.overlap(one, one.toDF("d", "t", "f"), ("s", "e"), ("t", "f"), [("c", "d")], 256)
    assert plan.count() == 1
    assert max(len(r[0]) for r in one.select(ranges._held(F.col("s"), F.col("e"), ranges._widths(256))).collect()) <= 3


@pytest.mark.parametrize("before", [False, True])
def test_carry_forward(spark, before):
    rng = random.Random(7)
    rows = [(i * 3, rng.choice([None, None, None, f"v{i}"])) for i in range(400)]
    got = {r["pos"]: r["got"] for r in ranges.carry_forward(spark.createDataFrame(rows, "pos long, v string"), "v", "got", "pos", 16, 2, before).collect()}
    last, want = None, {}
    for pos, v in rows:
        if before:
            want[pos] = last
        last = v or last
        if not before:
            want[pos] = last
    assert got == want


def test_ranks_within_a_hot_group(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, "hot", "hot", "hot", "b"]), rng.choice([None, *range(50)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, i long").repartition(5)
    got = {r["i"]: (r["rank"], r["n"]) for r in ranges.ranked(df, ["g"], ["v", "i"], "rank", "n").collect()}
    whole = {r["i"]: r["rank"] for r in ranges.ranked(df, [], ["v", "i"], "rank").collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for g in (None, "hot", "b"):
        own = sorted((r for r in rows if r[0] == g), key=key)
        assert [got[r[2]] for r in own] == [(k + 1, len(own)) for k in range(len(own))]
    assert [whole[r[2]] for r in sorted(rows, key=key)] == list(range(1, 2001))
    assert ranges.ranked(df.limit(0), ["g"], ["v"], "rank").count() == 0


def test_base_store(spark):
    """Pieces of all lengths, a gap, windows over chunk borders and before the contig's start."""
    rng = random.Random(9)
    whole = "".join(rng.choice("ACGTNacgt") for _ in range(1000))
    known = whole[:300] + " " * 50 + whole[350:]
    pieces, at = [], 0
    while at < 1000:
        n = rng.choice([1, 7, 130, 300])
        text_ = known[at : at + n]
        pieces += [("c", at + i, part) for part in text_.split(" ") for i in [text_.index(part) if part else 0] if part]
        at += n
    store = basestore.chunked(spark.createDataFrame([*pieces, ("c", 10, ""), ("c", 11, None)], "chrom string, pos long, text string"), 64, 40)
    assert "".join(r["text"].ljust(64) for r in basestore.base_runs(store, 64).orderBy("pos").collect()).rstrip() == known
    places = [(rng.randint(-30, 1020), rng.randint(1, 40)) for _ in range(300)]
    df = spark.createDataFrame([("c", lo, lo + n) for lo, n in places] + [("none", 0, 5)], "c string, lo long, hi long")
    want = {("c", lo, lo + n): "".join(known[p] if 0 <= p < 1000 else " " for p in range(lo, lo + n)) for lo, n in places} | {("none", 0, 5): " " * 5}
    assert {(r["c"], r["lo"], r["hi"]): r["t"] for r in basestore.with_text(df, store, "c", "lo", "hi", "t", 64, 40).collect()} == want
    with pytest.raises(Exception, match="longer than 40"):
        basestore.with_text(df.withColumn("hi", F.col("lo") + 41), store, "c", "lo", "hi", "t", 64, 40).collect()
    near = {r["p"]: r["n_beside"] for r in basestore.flanked_by_n(spark.createDataFrame([("c", p) for p in range(1, 1000)], "chrom string, p long"), basestore.chunked(spark.createDataFrame(pieces, "chrom string, pos long, text string")), "p").collect()}
    assert near == {p: "N" in known[p - 1 : p + 1].upper() for p in range(1, 1000)}


def test_fasta_by_carried_headers(spark):
    given = [">a first", "ACG", "", "T", ">b", "NN", ">empty", ">c", *["ACGTA"] * 50]
    rows = spark.createDataFrame([(i * 7, v) for i, v in enumerate(["junk", *given])], "ord long, value string")
    got = sorted((r["chrom"], r["pos"], r["text"]) for r in text.fasta_lines(rows, 8).collect())
    assert got == [("a", 0, "ACG"), ("a", 3, "T"), ("b", 0, "NN"), *(("c", 5 * i, "ACGTA") for i in range(50))]


def test_info_keys_that_come_twice(spark):
    line = "1\t100\tx\tA\t<DEL>\t5\tPASS\tSVTYPE=DEL;END=200;SVTYPE=DUP;IMPRECISE;A=b=c"
    info = text._info(spark.createDataFrame([(line,)], "value string")).select("info").first()[0]
    assert info == {"SVTYPE": "DEL", "END": "200", "IMPRECISE": None, "A": "b=c"}


def test_readers_by_path(spark, tmp_path):
    """Files of each format read by their path."""
    given = {"fasta": [">a x", "ACGT", "NN", ">b", "TT"], "fai": ["a\t6\t3\t4\t5"], "bed": ["a\t1\t5"], "bedpe": ["a\t1\t2\ta\t5\t6\tDEL"], "vcf": ["##x", "a\t2\tv\tA\t<DEL>\t1\tPASS\tSVTYPE=DEL;END=6"]}
    for name, lines in given.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    path = lambda name: f"file://{tmp_path}/{name}"
    assert sorted((r["chrom"], r["chunk"], r["bases"]) for r in text.read_fasta(spark, path("fasta")).collect()) == [("a", 0, "ACGTNN"), ("b", 0, "TT")]
    assert text.read_fai(spark, path("fai")).first()["len"] == 6 and text.read_bed(spark, path("bed")).first()[:3] == ("chra", 1, 5)
    assert text.read_bedpe(spark, path("bedpe")).first()["s2"] == 5 and text.read_vcf(spark, path("vcf")).first()["r"] == 6
