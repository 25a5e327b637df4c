"""Batched models against single fits and brute force, searches, keyed stores, exact selection, and queries without a twin on small tables."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lociflow.operators import datasets, genome, models, ranges, reads, windows
from lociflow.sources import stores


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4)) * [1, 5, 0.2, 0] + [0, 3, 0, 7]
    p = 1 / (1 + np.exp(-(x @ [1.0, -0.3, 2.0, 0.0] + 0.5)))
    y = (rng.random(600) < p).astype(int)
    data = [(i, int(y[i]), float(1 + y[i] * 0.7), i % 3, "abc"[i % 7 % 3], [float(v) for v in x[i]]) for i in range(600)]
    return spark.createDataFrame(data, "id long, y int, weight double, fold int, sample string, v array<double>").withColumn("features", array_to_vector("v")).drop("v").cache()


@pytest.mark.parametrize("standardize", [True, False])
@pytest.mark.parametrize("intercept", [True, False])
def test_batch_equals_single_fits(rows, standardize, intercept):
    specs = [models.Spec((("fold", f),), reg_param=r, standardize=standardize, fit_intercept=intercept) for f in range(2) for r in (0.01, 0.3)]
    models.fit_many(rows, specs)
    for s in specs:
        own = rows.filter(F.col("fold") != s.without[0][1])
        one = LogisticRegression(labelCol="y", weightCol="weight", maxIter=500, tol=1e-14, regParam=s.reg_param, standardization=standardize, fitIntercept=intercept).fit(own)
        assert s.settled and np.abs(s.beta - np.array([one.intercept, *one.coefficients])).max() < 1e-6


def test_passes_do_not_grow_with_models(rows, monkeypatch):
    calls = []
    real = models._sums
    monkeypatch.setattr(models, "_sums", lambda *a: calls.append(1) or real(*a))
    models.fit_many(rows, [models.Spec(reg_param=r) for r in (0.1,)])
    one = len(calls)
    models.fit_many(rows, [models.Spec((("fold", f),), reg_param=r) for f in range(3) for r in (0.05, 0.1, 0.2, 0.4)])
    assert len(calls) - one <= one + 2


def single_accuracy(rows, fold, params):
    spec = models.fit_many(rows.filter(F.col("fold") != fold), [models.Spec(**params)])[0]
    held = rows.filter(F.col("fold") == fold).collect()
    hit = {c: [int((spec.beta[0] + np.dot(spec.beta[1:], r["features"].toArray()) > np.log(spec.threshold / (1 - spec.threshold))) == (r["y"] == 1)) for r in held if r["y"] == c] for c in (0, 1)}
    return np.mean([np.mean(hit[c]) for c in (0, 1)])


def test_search_and_halving(rows):
    grid = {"reg_param": [0.01, 10.0], "weight_power": [0.0, 1.0], "threshold": [0.5, 0.9]}
    best, found = models.param_search(rows, grid, keep=0)
    for r in found:
        assert r["finished"] and r["mean"] == pytest.approx(np.mean([single_accuracy(rows, f, {k: r[k] for k in grid}) for f in range(3)]))
    assert best == {k: found[0][k] for k in grid} and found[0]["mean"] == max(r["mean"] for r in found)
    _, halved = models.param_search(rows, grid, keep=2)
    assert sum(r["finished"] for r in halved) == 2 and len(halved) == 8 and halved[0]["mean"] >= sorted(r["mean"] for r in found)[-3]


def test_search_fits_all_unless_asked(rows):
    grid = {"reg_param": [0.001, 0.01, 0.1, 1.0, 10.0], "threshold": [0.5, 0.9]}
    best, found = models.param_search(rows, grid)
    assert len(found) == 10 and all(r["finished"] for r in found)
    assert found == models.param_search(rows, grid, keep=0)[1] and found[0]["mean"] == max(r["mean"] for r in found)


def test_grouped_and_nested_scores(rows):
    out = {r["id"]: r for r in models.score_grouped(rows, "sample", {"reg_param": 0.1}).collect()}
    for value in "abc":
        spec = models.fit_many(rows.filter(F.col("sample") != value), [models.Spec(reg_param=0.1)])[0]
        for r in rows.filter(F.col("sample") == value).collect():
            p = 1 / (1 + np.exp(-(spec.beta[0] + np.dot(spec.beta[1:], r["features"].toArray()))))
            assert out[r["id"]]["p_sv"] == pytest.approx(1 - p, abs=1e-9) and out[r["id"]]["pred"] == int(p > 0.5)
    nested = models.nested_cv(rows, "sample", {"reg_param": [0.01, 0.1]}, keep=0)
    assert nested.count() == 600 and nested.filter("pred = y").count() > 400
    best = models.param_search(rows.filter("sample <> 'a'"), {"reg_param": [0.01, 0.1]}, keep=0)[0]
    spec = models.fit_many(rows.filter("sample <> 'a'"), [models.Spec(**best)])[0]
    one = {r["id"]: r["p_sv"] for r in nested.filter("sample = 'a'").collect()}
    for r in rows.filter("sample = 'a'").limit(20).collect():
        assert one[r["id"]] == pytest.approx(1 - 1 / (1 + np.exp(-(spec.beta[0] + np.dot(spec.beta[1:], r["features"].toArray())))), abs=1e-9)


def test_single_model_scores(rows):
    model = models.train(rows.filter("fold = 0"), {"maxIter": 100})
    out = models.score(model, rows.filter("fold <> 0")).collect()
    want = {r["id"]: 1 - 1 / (1 + np.exp(-(model.intercept + model.coefficients.dot(r["features"])))) for r in rows.filter("fold <> 0").collect()}
    assert {r["id"]: pytest.approx(r["p_sv"]) for r in out} == want and all(r["pred"] == int(r["p_sv"] < 0.5) for r in out)


# Stores


def test_store_reads_only_what_is_asked_for(spark, tmp_path):
    rng = random.Random(4)
    held = [(f"v{i}", rng.choice(["1", "2", "X"]), s := rng.randint(0, 20_000_000), s + rng.choice([1, 500, 3_000_000]), float(i)) for i in range(800)]
    path = f"file://{tmp_path}/store"
    stores.write_store(spark.createDataFrame(held, "sv_id string, chrom string, l long, r long, x double").repartition(3), path, key="sv_id")
    asked = [("1", 5_000_000, 5_100_000), ("X", 0, 10), ("2", 19_999_999, 30_000_000), ("none", 0, 10), ("1", 7, 7)]
    want = sorted(h for h in held if any(h[1] == c and h[2] < e and h[3] > s and e > s for c, s, e in asked))
    one = stores.read_region(spark, path, asked)
    assert sorted(map(tuple, one.collect())) == want and one.columns == ["sv_id", "chrom", "l", "r", "x"]
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "store_bin" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len({f for f in one.inputFiles()}) > 0
    every = stores.read_store(spark, path).select("store_chrom", "store_bin").distinct().count()
    touched = one.select(F.input_file_name()).distinct().count()
    assert touched < every / 2
    table = spark.createDataFrame(asked, "chrom string, s long, e long")
    assert sorted(map(tuple, stores.read_regions(spark, path, table).collect())) == want
    some = stores.read_ids(spark, path, ["v3", "v500", "nothing"], "sv_id")
    assert sorted(map(tuple, some.collect())) == sorted(h for h in held if h[0] in ("v3", "v500"))
    assert stores.read_ids(spark, path, [], "sv_id").count() == 0 and stores.read_region(spark, path, []).count() == 0
    with pytest.raises(Exception, match="contig and start"):
        stores.write_store(spark.createDataFrame([("a", None, 1, 2)], "sv_id string, chrom string, l long, r long"), f"{path}-odd")


# Selection


def test_exact_selection(spark):
    rng = random.Random(5)
    for values in ([rng.lognormvariate(0, 4) for _ in range(3001)], [float(rng.randint(0, 3)) for _ in range(2000)], [1.0] * 1500 + [2.0] * 1500, [5.0], [1e-300, 1e300, 0.0, -1e300] * 300):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(4)
        own = sorted(values)
        for k in {1, len(own), len(own) // 2 + 1, max(1, len(own) // 3)}:
            assert ranges.nth_smallest(df, "v", k, few=50) == own[k - 1]
        assert ranges.exact_median(df, "v") == pytest.approx(float(np.median(own)))
    assert ranges.exact_median(spark.createDataFrame([(None,)], "v double"), "v") is None
    with pytest.raises(ValueError):
        ranges.nth_smallest(spark.createDataFrame([(1.0,)], "v double"), "v", 2)


# Queries without a twin


def test_later_mates_of_clipped_reads(spark):
    rng = random.Random(6)
    data = [(f"q{rng.randint(0, 40)}", i, rng.choice("xy"), rng.randint(0, 3), rng.choice("xy"), rng.randint(0, 3), rng.choice(["10S90M", "100M", "90M10H", None]), 0) for i in range(400)]
    df = spark.createDataFrame(data, "qname string, ord long, chrom string, pos0 long, next_chrom string, next_pos0 long, cigar string, flag int")
    want = sorted((a[1], b[1]) for a in data if a[6] in ("10S90M", "90M10H") for b in data if a[0] == b[0] and a[4] == b[2] and a[5] == b[3] and b[1] > a[1])
    assert sorted((r["ord"], r["m_ord"]) for r in reads.clipped_with_later_mate(df).collect()) == want and want


def test_augmented_windows(spark):
    import zlib

    cands = spark.createDataFrame([(i, "1", 1000 + i, 1010 + 7 * i) for i in range(50)], "sv_id long, chrom string, l long, r long")
    out = {(r["sv_id"], r["copy"]): (r["l"], r["r"]) for r in windows.augment(cands, 20, 3).collect()}
    want = {}
    for i in range(50):
        for copy in (0, 1, -1):
            move = copy * (zlib.crc32(f"3:{i}:{copy}".encode()) % 20 + 1)
            if 1000 + i - move <= 1010 + 7 * i + move:
                want[i, copy] = (1000 + i - move, 1010 + 7 * i + move)
    assert out == want and len(want) < 150


def test_read_channels_of_windows(spark):
    """Two reads over both windows of a candidate, one of them clipped, and one over a single window."""
    data = [("a", 1, 1 + 64, "1", 90, 60, "30M", "1", 290, 100, 0, None), ("a", 2, 1 + 128 + 16, "1", 290, 60, "10S20M", "1", 90, -100, 0, None), ("b", 3, 1, "1", 95, 60, "10M", "1", 900, 0, 0, None)]
    df = spark.createDataFrame(data, "qname string, ord long, flag int, chrom string, pos0 long, mapq int, cigar string, next_chrom string, next_pos0 long, tlen long, nm int, sa string")
    cands = spark.createDataFrame([(7, "1", 100, 300)], "sv_id long, chrom string, l long, r long")
    out = {(r["side"], r["channel"], r["pos"]): r["n"] for r in windows.read_channels(df, cands, 20).collect()}
    assert {k[:2] for k in out} == {("left", "F_AR_N"), ("left", "DR_F"), ("right", "R_CR_L"), ("right", "DR_R")} or {k[1] for k in out if k[0] == "left"} >= {"F_AR_N"}
    assert {p for (s, c, p) in out if (s, c) == ("left", "F_AR_N")} == set(range(90, 120)) and out["right", "R_CR_L", 290] == 1 and not any(n != 1 for n in out.values())


def test_stratified_holdout(spark):
    df = spark.createDataFrame([(i, "rare" if i % 20 == 0 else "usual") for i in range(1000)], "id long, label string")
    out = datasets.holdout_stratified(df, "id").collect()
    test = {label: sum(r["test"] for r in out if r["label"] == label) for label in ("rare", "usual")}
    assert test == {"rare": 15, "usual": 285} and len({r["id"] for r in out}) == 1000
    again = datasets.holdout_stratified(df.repartition(5), "id").collect()
    assert {r["id"] for r in again if r["test"]} == {r["id"] for r in out if r["test"]}


def test_array_segments_laid_out(spark):
    """A small array by position against its parts: every position once, coverage carried on, points where they are."""
    data = [("a", 1, 1 + 2 + 32, "1", 3, 60, "4S10M", "1", 9, 16, 0, None), ("a", 2, 1 + 2 + 16, "1", 9, 60, "10M", "1", 3, -16, 0, None), ("b", 3, 1 + 8, "1", 18, 60, "6M", "1", 18, 0, 0, None)]
    df = spark.createDataFrame(data, "qname string, ord long, flag int, chrom string, pos0 long, mapq int, cigar string, next_chrom string, next_pos0 long, tlen long, nm int, sa string")
    from lociflow.operators import basestore

    store = basestore.chunked(spark.createDataFrame([("1", 0, "ACGTNACGTNACGTNACGTN")], "chrom string, pos long, text string"), 8, 8)
    array = genome.chr_array(df, spark.createDataFrame([("1", 25)], "chrom string, len long"), store, 500.0, 200.0, block=4, width=8)
    out = {r["pos"]: r for r in genome.dense(array).collect()}
    assert sorted(out) == list(range(25))
    assert [out[p]["cov_proper"] for p in range(25)] == [float((3 <= p < 12) + (9 <= p < 18)) for p in range(25)]
    assert [out[p]["left_F"] for p in range(25)] == [1.0 if p == 4 else 0.0 for p in range(25)]
    assert ["".join(b for b in "ATCGN" if out[p][f"base_{b}"]) for p in range(25)] == list("ACGTNACGTNACGTNACGTN") + [""] * 5


def test_signal_texts_are_whole_and_sorted(spark, tmp_path):
    import glob
    import gzip

    from lociflow.sources import text

    rows = [("12", p, None, None, e) for p in (900, 5, 77, 5) for e in (1, 7)] + [("22", p, "12", p + 9, e) for p in (1000, 70, 9) for e in (9, 18)] + [("12", 33, "12", 40, 13)]
    path = str(tmp_path / "signals")
    text.write_all_signals(spark.createDataFrame(rows, "a_chrom string, a_pos bigint, b_chrom string, b_pos bigint, event int"), path, parts=3)
    for kind, wanted in ((text.ONE_PLACE, [(c, p, e) for c, p, _, q, e in rows if q is None]), (text.TWO_PLACES, [r for r in rows if r[3] is not None])):
        lines = [line for f in sorted(glob.glob(f"{path}/kind={kind}/*.gz")) for line in gzip.open(f, "rt").read().splitlines()]
        assert lines == ["\t".join(map(str, r)) for r in sorted(wanted)]
    one, two, far = text.read_all_signals(spark, path)
    assert one.count() == 8 and {r["event"] for r in two.collect()} == {9, 13}
    assert sorted((r["a_pos"], r["b_pos"], r["event"]) for r in far.collect()) == [(1, 2, 18), (8, 9, 18), (125, 126, 18)]
    gaps = spark.createDataFrame([("1", None, 3)], "chrom string, pos bigint, event int")
    assert text.parse_signals(text.signal_lines(gaps), text.SIGNALS_1D).collect() == gaps.collect()


@pytest.mark.parametrize("name", ["src_signals", "snk_signals"])
def test_signal_queries_hold_all_events(spark, name):
    import duckdb
    import pandas as pd

    from lociflow.plans import callset_queries, registry  # noqa: F401

    c = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    twin = c.execute(registry.ORACLES[name]).df()
    out = registry.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()[list(twin.columns)]
    text = lambda frame: sorted(tuple("" if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in frame.itertuples(index=False))
    assert text(out) == text(twin) and len(out) > 1000
    codes = {int(r[-1]) for r in text(out)} if name == "src_signals" else {int(v.split("\t")[-1]) for v in out["value"]}
    assert codes >= {1, 2, 5, 7, 8, 9, 11, 13, 18}
