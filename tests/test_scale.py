"""What keeps jobs within memory and time on larger tables: how they are joined, dealt out and read."""

import pytest
from pyspark.sql import functions as F

from lociflow.operators import ranges


def planned(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def spans(spark):
    own = spark.range(200).select(F.lit("1").alias("c"), (F.col("id") * 37).alias("lo"), (F.col("id") * 37 + 50).alias("hi"))
    other = spark.range(300).select(F.lit("1").alias("d"), (F.col("id") * 23).alias("s"), (F.col("id") * 23 + 9).alias("e"))
    return own, other


def test_range_joins_are_not_broadcast(spans):
    own, other = spans
    met = ranges.overlap(own, other, ("lo", "hi"), ("s", "e"), [("c", "d")], 64)
    assert "Broadcast" not in planned(met)
    assert met.count() == own.join(other, (F.col("lo") < F.col("e")) & (F.col("s") < F.col("hi"))).count()
    at = ranges.point_in_interval(other, own, "s", "lo", "hi", [("d", "c")], 64)
    assert "Broadcast" not in planned(at)
    assert at.count() == own.join(other, (F.col("lo") <= F.col("s")) & (F.col("s") < F.col("hi"))).count()


def test_reads_are_dealt_out_by_rows(spark, monkeypatch):
    from lociflow.plans import fixtures

    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    fx = fixtures.Fixtures(spark, "/root/testdata/sf0.001")
    assert fx.parts == -(-fx.table("lineitem").count() // 500)
    plan = planned(fx.reads)
    assert f", {fx.parts}), REPARTITION_BY_NUM" in plan


def test_steps_sum_run_and_look_ahead(spark):
    rows = [("1", p, d) for p, d in [(-3, 1), (5, 1), (5, 1), (40, -1), (40, 1), (70, -2), (300, 1), (301, -2)]] + [("2", 9, 1)]
    out = ranges.steps(spark.createDataFrame(rows, "chrom string, pos bigint, d int"), "d", "depth", "e", block=32, parts=3)
    assert sorted(map(tuple, out.collect())) == [("1", -3, 1, 5), ("1", 5, 3, 70), ("1", 70, 1, 300), ("1", 300, 2, 301), ("1", 301, 0, None), ("2", 9, 1, None)]


def test_insert_size_percentile_reads_once(spark, monkeypatch):
    from lociflow.operators import reads

    rows = [("a", 1 + 64 + 16, "1", "1", 60, t) for t in [300] * 50 + [-500] * 49 + [900]]
    own = spark.createDataFrame(rows, "qname string, flag int, chrom string, next_chrom string, mapq int, tlen int")
    plain = [tuple(reads.insert_size_percentile(own, p).first()) for p in (0.5, 0.51, 0.99, 0.995, 1.0)]
    assert plain == [(100, 300), (100, 500), (100, 500), (100, 500), (100, 900)]
    assert reads.insert_size_percentile(own.filter("false")).count() == 0
    monkeypatch.setattr(reads, "nth_smallest", lambda *a: pytest.fail("sizes that repeat take one pass"))
    assert tuple(reads.insert_size_percentile(own, 0.5).first()) == (100, 300)
    assert ranges.few_values(own, "tlen", few=2) is None


def test_pileup_makes_no_row_a_base(spark):
    from lociflow.operators import basestore, reads

    text = "ACGTN" * 2000
    store = basestore.chunked(spark.createDataFrame([("1", 0, text)], "chrom string, pos bigint, text string"))
    rows = [("1", 0, 4090, m, "3S12M", "ACG" + "acgtACGTNACG", "".join(chr(33 + q + i) for i in range(15))) for m, q in [(10, 5), (20, 9), (None, 30), (31, 2)]]
    rows += [("1", 0, 4000, 7, "1300M", "A" * 1290, "I" * 1290), ("1", 0, 9995, 9, "10M", "C" * 10, "5" * 10), ("1", 4, 1, 9, "2M", "CC", "55"), ("1", 0, 1, 9, "2M", None, "55")]
    own = spark.createDataFrame(rows, "chrom string, flag int, pos0 bigint, mapq int, cigar string, seq string, qual string")
    counted = {}
    for _, flag, at, mapq, cigar, seq, qual in rows:
        if flag == 4 or seq is None:
            continue
        skip, n = (3, 12) if cigar == "3S12M" else (0, int(cigar[:-1]))
        for i in range(n):
            b, q = seq[skip + i : skip + i + 1].upper(), qual[skip + i : skip + i + 1]
            ref = text[at + i : at + i + 1] or " "
            counted.setdefault(at + i, []).append((ord(q) - 33 if q else -33, mapq, b in tuple("ACGT") and b != ref and ref not in "N "))
    import statistics

    wanted = {p: (len(v), statistics.median(x[0] for x in v), statistics.median([x[1] for x in v if x[1] is not None]), sum(x[2] for x in v) / len(v)) for p, v in counted.items()}
    out = reads.pileup(own, store, parts=2)
    assert {r["pos"]: tuple(r)[2:] for r in out.collect()} == wanted
    assert "SortMergeJoin" not in planned(out)


def test_common_reads_meet_windows_once(spark):
    from lociflow.operators import windows

    rows = [("a", "1", 1000, "50M"), ("a", "1", 5000, "50M"), ("b", "1", 1010, "50M"), ("c", "1", 900, "9000M"), ("d", "2", 1000, "50M"), ("d", "1", 5010, "50M")]
    own = spark.createDataFrame(rows, "qname string, chrom string, pos0 bigint, cigar string")
    cands = spark.createDataFrame([(7, "1", 1020, 5020)], "sv_id int, chrom string, l bigint, r bigint")
    met = windows.common_reads(own, cands)
    assert planned(met).split("Initial Plan")[0].count("SortMergeJoin") == 1  # no second meeting of reads and windows
    assert sorted((r["side"], r["qname"], r["s"]) for r in met.collect()) == [("left", "a", 1000), ("left", "c", 900), ("right", "a", 5000), ("right", "c", 900)]


def test_depth_sums_lay_out_no_cells(spark, monkeypatch):
    from lociflow.operators import windows
    from lociflow.plans import registry, signal_queries

    runs = spark.createDataFrame([(1, 0, 3, 6, 2), (1, 0, 9, 9, 5), (2, 0, 0, 255, 4)], "sv_id int, channel int, first int, last int, value bigint")
    plain = signal_queries.window_sums(windows.spread_runs(runs))
    assert sorted(map(tuple, signal_queries.run_sums(runs).collect())) == sorted(map(tuple, plain.collect()))
    scaled = windows.min_max(windows.spread_runs(runs)).groupBy("sv_id", "channel").agg(F.count("*"), F.min("scaled"), F.max("scaled"), F.round(F.sum("scaled"), 9))
    assert sorted(map(tuple, windows.min_max_sums(runs).withColumn("total", F.round("total", 9)).collect())) == sorted(map(tuple, scaled.collect()))
    for name in ("window_depth", "pair_slice", "min_max"):
        monkeypatch.setattr(windows, name, lambda *a, **k: pytest.fail("sums need no row for each cell"))
    for name in ("win_depth", "win_pair_slice", "win_minmax"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_steps_make_one_exchange(spark):
    from lociflow.plans.fixtures import Fixtures

    out = Fixtures(spark, "/root/testdata/sf0.001").depth
    assert out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_stores_are_written_by_as_many_tasks_as_asked(spark, tmp_path):
    from pathlib import Path

    from lociflow.sources import stores

    own = spark.range(3000).select(F.col("id").alias("name"), F.lit("1").alias("chrom"), (F.col("id") * 4001).alias("l"), (F.col("id") * 4001 + 5).alias("r"))
    for parts, least in ((None, 1), (20, 9)):
        path = f"{tmp_path}/store-{parts}"
        stores.write_store(own, path, key="name", parts=parts)
        for folder in ("data", "ids"):
            tasks = {f.name.split("-")[1] for f in Path(path, folder).rglob("part-*.parquet")}
            assert len(tasks) >= least and (parts is None or len(tasks) > 4)
        assert stores.read_store(spark, path).count() == 3000 and spark.read.parquet(f"{path}/ids").count() == 3000
        assert sorted(r["name"] for r in stores.read_ids(spark, path, [0, 17, 2999], "name").collect()) == [0, 17, 2999]


def test_one_position_hits_take_two_exchanges(spark):
    from lociflow.operators import windows

    events = spark.createDataFrame([("1", p, 1 + p % 3) for p in [0, 37, 38, 99, 100, 100, 161, 162, 163, 247, 248, 250]], "chrom string, pos bigint, event int")
    cands = spark.createDataFrame([(1, "1", 100, 310), (2, "1", 100, 130), (3, "2", 100, 130), (4, "1", 10, 40)], "sv_id int, chrom string, l bigint, r bigint")
    met = windows.hits_1d(cands, events)
    wide = cands.select("sv_id", F.col("chrom").alias("c"), F.explode(F.array("l", "r")).alias("at"))
    brute = wide.join(events, (F.col("c") == F.col("chrom")) & (F.abs(F.col("pos") - F.col("at")) <= 62)).count()
    assert met.agg(F.sum("n")).first()[0] == brute
    assert planned(met).split("Initial Plan")[0].count("Exchange hashpartitioning") == 2


def test_bases_are_not_broadcast(spark):
    from lociflow.operators import basestore

    store = basestore.chunked(spark.createDataFrame([("1", 0, "ACGTN" * 2000)], "chrom string, pos bigint, text string"))
    spans = spark.createDataFrame([("1", 4090, 4100), ("1", 0, 3), ("2", 5, 7)], "c string, lo bigint, hi bigint")
    cut = basestore.with_text(spans, store, "c", "lo", "hi", "text")
    assert "Broadcast" not in planned(cut)
    assert {r["lo"]: r["text"] for r in cut.collect()} == {4090: "ACGTNACGTN", 0: "ACG", 5: "  "}


def test_models_see_only_features_with_spread(spark, monkeypatch):
    from lociflow.operators import models
    from pyspark.ml.functions import array_to_vector

    own = spark.range(300).select((F.col("id") % 7 < 3).cast("int").alias("y"), F.lit(1.0).alias("weight"), array_to_vector(F.array(*[F.lit(0.0)] * 30, (F.col("id") % 5).cast("double"), *[F.lit(2.0)] * 30)).alias("features"))
    real, seen = models._sums, []
    monkeypatch.setattr(models, "_sums", lambda df, specs, of, used=None: seen.append(used) or real(df, specs, of, used))
    spec = models.fit_many(own, [models.Spec()])[0]
    assert spec.settled and set(map(int, spec.beta.nonzero()[0])) <= {0, 31} and len(spec.beta) == 62
    assert len(seen) > 1 and all(list(u) == [0, 31] for u in seen[1:])


def test_training_rows_are_made_once(spark, monkeypatch):
    from lociflow.plans import callset_queries, registry

    calls, real = [], callset_queries.training
    monkeypatch.setattr(callset_queries, "training", lambda fx: calls.append(1) or real(fx))
    assert registry.QUERIES["ml_score"](spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1


def test_array_sums_by_chunk(spark):
    from lociflow.operators import basestore, genome, reads

    data = [("a", 1, 1 + 2 + 32, "1", 3, 60, "4S10M", "1", 9, 16, 0, None), ("b", 2, 1 + 2 + 32, "1", 3, 60, "4S10M", "1", 40, 16, 0, None), ("a", 3, 1 + 2 + 16, "1", 9, 60, "10M", "1", 3, -16, 0, None), ("c", 4, 1 + 8, "1", 18, 60, "6M", "1", 18, 0, 0, None)]
    df = spark.createDataFrame(data, "qname string, ord long, flag int, chrom string, pos0 long, mapq int, cigar string, next_chrom string, next_pos0 long, tlen long, nm int, sa string")
    store = basestore.chunked(spark.createDataFrame([("1", 0, "ACGTNACGTNACGTNACGTN")], "chrom string, pos long, text string"), 8, 8)
    sized = spark.createDataFrame([("1", 25), ("2", 3)], "chrom string, len long")
    chunks = genome.chr_chunks(df, sized, store, 10.0, 2.0, width=8)
    at = genome.dense(genome.chr_array(df, sized, store, 10.0, 2.0, width=8))
    wanted = at.groupBy("chrom").agg(*(F.struct(F.count_if(F.col(c) != 0).alias("nonzero"), F.sum(c).alias("total"), F.sum(F.col(c) * (F.col("pos") % 97)).alias("placed")).alias(c) for c in genome.ALL)).collect()
    got = {(r["chrom"], r["channel"]): tuple(r)[2:] for r in genome.array_sums(chunks, 8).collect()}
    assert got == {(r["chrom"], c): tuple(r[c]) for r in wanted for c in genome.ALL}
    assert at.filter("chrom = '1' and pos = 3").first()["clipdist_forward_left"] == ((6 - 10) / 2 + (37 - 10) / 2) / 2  # the median of both reads there
    assert chunks.collect() and "ReusedExchange" in chunks._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # The packed pileup says what the pileup says by position.
    rows = spark.createDataFrame([("1", 0, 2, m, "12M", "ACGTACGTACGT", "56789:;<=>?@") for m in (4, 9, None)], "chrom string, flag int, pos0 bigint, mapq int, cigar string, seq string, qual string")
    whole = basestore.chunked(spark.createDataFrame([("1", 0, "ACGTNACGTNACGTNACGTN")], "chrom string, pos long, text string"))
    packed = reads.pileup_chunks(rows, whole).first()
    for r in reads.pileup(rows, whole).collect():
        assert (packed["bq"][r["pos"]], packed["fraction"][r["pos"]], packed["mapq"][r["pos"]]) == (r["bq_median"], r["snv_fraction"], r["mapq_median"])


def test_reads_are_made_in_one_pass(spark):
    from lociflow.operators import genome
    from lociflow.plans.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    twin = fx._fixture("reads")
    assert fx.reads.dtypes == twin.dtypes and not fx.reads.exceptAll(twin).count() and not twin.exceptAll(fx.reads).count()
    plan = planned(genome.duplications(fx.reads)).split("Initial Plan")[0]
    assert "Union" not in plan and plan.count("Scan parquet") == 1


def test_bases_come_from_patterns(spark):
    from lociflow.plans.fixtures import BASE, Fixtures
    from lociflow.operators.basestore import base_runs

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    each = base_runs(fx.store).select("chrom", "pos", F.posexplode(F.split("text", "")).alias("i", "base")).select("chrom", (F.col("pos") + F.col("i")).alias("pos"), "base").filter("base <> ' '")
    places = fx.table("orders").selectExpr("o_custkey", "explode(sequence(o_orderkey * 40, o_orderkey * 40 + 39)) AS pos").selectExpr("explode(array('12', '22')) AS chrom", "pos", f"{BASE} AS base")
    assert each.exceptAll(places).count() == 0 and each.count() == places.count()
    assert "sequence(0, 39" not in fx.store._jdf.queryExecution().optimizedPlan().toString()


def test_bases_are_summed_by_batch(spark):
    from lociflow.sources import text

    own = spark.createDataFrame([("a", 5, "ACGTN"), ("a", 10, "AANx"), ("b", 0, "T"), ("b", 1, "")], "chrom string, pos bigint, text string")
    wanted = {("a", "A"): (3, 5 + 10 + 11), ("a", "C"): (1, 6), ("a", "G"): (1, 7), ("a", "T"): (1, 8), ("a", "N"): (2, 9 + 12), ("b", "T"): (1, 0)}
    assert {tuple(r)[:2]: tuple(r)[2:] for r in text.base_sums(own).collect()} == wanted
    with pytest.raises(Exception, match="several bytes"):
        text.base_sums(own.withColumn("text", F.lit("é"))).collect()


def test_read_channels_count_without_a_row_a_base(spark):
    from lociflow.operators import windows

    rows = [("a", "1", 1000, "50M", 16 + 1, "1", 5000, None), ("a", "1", 5000, "30M20S", 1, "1", 1000, None), ("b", "1", 1010, "20S30M", 1 + 2, "1", 5010, "1,5,+,3M,9,0;"), ("b", "1", 5010, "5S40M5S", 1 + 32, "2", 1010, None)]
    rows += [("c", "1", 10, "2M9000N2M", 1 + 2, "1", 10, None), ("d", "1", 1000, "50M", 1, "1", 9, None), ("a", "1", 1020, "10M", 16 + 1, "1", 5000, None)]
    own = spark.createDataFrame(rows, "qname string, chrom string, pos0 bigint, cigar string, flag int, next_chrom string, next_pos0 bigint, sa string")
    cands = spark.createDataFrame([(7, "1", 1020, 5020), (8, "1", 1000, 1062)], "sv_id int, chrom string, l bigint, r bigint")
    wanted = {}
    for sv, l, r in ((7, 1020, 5020), (8, 1000, 1062)):
        spans = {q: [] for q, *_ in rows}
        for q, chrom, s, c, flag, next_chrom, next_pos, sa in rows:
            e = s + {"50M": 50, "30M20S": 30, "20S30M": 30, "5S40M5S": 40, "2M9000N2M": 9004, "10M": 10}[c]
            spans[q] += [(side, at - 62, at + 62, s, e, c, flag, next_chrom, next_pos, sa) for side, at in (("left", l), ("right", r)) if s < at + 62 and at - 62 < e]
        for q, found in spans.items():
            for side, lo, hi, s, e, c, flag, next_chrom, next_pos, sa in found if len({x[0] for x in found}) == 2 else ():
                rev, mate, left, right = bool(flag & 16), bool(flag & 32), c.find("S") in (1, 2) and c[0] != "3", c.endswith("S")
                names = [f"{'R' if rev else 'F'}_{'SR' if sa else 'CR' if left or right else 'AR'}_{'B' if left and right else 'L' if left else 'R' if right else 'N'}"]
                names += [("TRA_S" if rev == mate else "TRA_O") if next_chrom != "1" else ("INV_A" if next_pos > s else "INV_B") if rev == mate else "DUP_A" if rev and next_pos > s else "DUP_B" if not rev and next_pos < s else None if flag & 2 else "DR_R" if rev else "DR_F"]
                for name in filter(None, names):
                    for p in [s] if left else [e] if right else range(s, e):
                        if lo <= p < hi:
                            wanted[sv, side, name, p] = wanted.get((sv, side, name, p), 0) + 1
    out = windows.read_channels(own, cands, parts=2)
    assert {(r["sv_id"], r["side"], r["channel"], r["pos"]): r["n"] for r in out.collect()} == wanted and max(wanted.values()) > 1
    plan = planned(out).split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 3 and "Generate explode(sequence" in plan.split("Exchange")[0]  # both sides, and what met


def test_tensors_are_laid_out_from_stretches(spark):
    from lociflow.operators import signals, windows
    from lociflow.plans import fixtures, signal_queries

    fx = fixtures.Fixtures(spark, "/root/testdata/sf0.001")
    own = signal_queries.cands(fx).filter("sv_id % 8 = 0")
    given = own, signals.signals(fx.reads), fx.depth, fx.store
    plain = {r["sv_id"]: r["tensor"] for r in windows.dense(windows.channels(*given)).collect()}
    stretches = windows.stretches(*given)
    laid = windows.tensors(stretches, parts=3)
    assert {r["sv_id"]: r["tensor"] for r in laid.collect()} == plain and len(plain) > 100
    sums = {(i, c): (sum(row), sum(v * (k + 1) for k, v in enumerate(row))) for i, t in plain.items() for c, row in enumerate(t) if sum(row)}
    for tensors in (laid, windows.tensors(stretches, parts=3, packed=True)):
        assert {(r["sv_id"], r["channel"]): (r["total"], r["weighted"]) for r in windows.tensor_sums(tensors, ["sv_id"]).collect()} == sums
    cells = stretches.agg(F.count("*")).first()[0]
    assert cells * 2 < windows.channels(*given).count()  # no row for each cell
    assert "explode(sequence(first" not in planned(laid)


def test_tensors_across_batches(spark):
    from lociflow.operators import windows

    rows = [(i, 0, k, k + 3, 2, None) for i in range(90) for k in range(i * 3 % 200)] + [(i, None, 132, None, None, "ACGTN X") for i in range(90)]
    own = spark.createDataFrame(rows, "sv_id bigint, channel int, first int, last int, value bigint, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        out = {r["sv_id"]: r["tensor"] for r in windows.tensors(own, parts=1).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 90
    for i, t in out.items():
        n = i * 3 % 200
        assert t[0] == [2 * sum(k <= c <= k + 3 for k in range(n)) for c in range(256)]
        assert [next((b for b in range(30, 35) if t[b][132 + k]), 0) for k in range(7)] == [30, 31, 33, 32, 34, 0, 0]


def test_pileup_of_deep_and_shallow_chunks(spark, monkeypatch):
    """Few bases of a chunk are sorted, many are counted in tables; both give the same medians."""
    import numpy as np
    import pyarrow as pa

    from lociflow.operators import reads

    rng = np.random.default_rng(5)
    rows = [("1", 0, None, None, None, None, "ACGTN" * 819 + "A")]
    for _ in range(400):
        n = int(rng.integers(1, 90))
        rows.append(("1", 0, int(rng.integers(0, 4000)), None if rng.random() < 0.2 else int(rng.integers(0, 61)), "".join("ACGTé"[i] for i in rng.integers(0, 5, n)), "".join(chr(33 + q) for q in rng.integers(0, 60, n)), None))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["chrom", "k", "lo", "mapq", "bases", "quals", "refs"])
    given = [batch.slice(0, 7), batch.slice(7, 200), batch.slice(207)]
    shallow = pa.Table.from_batches(reads._piled(iter(given))).to_pylist()
    monkeypatch.setattr(reads, "HELD", 3000)
    assert pa.Table.from_batches(reads._piled(iter(given))).to_pylist() == shallow and len(shallow) > 2000
    by, ref = {}, rows[0][-1]
    for _, _, lo, mapq, bases, quals, _ in rows[1:]:
        for i, (b, q) in enumerate(zip(bases, quals)):
            by.setdefault(lo + i, []).append((ord(q) - 33, mapq, b in "ACGT" and b != ref[lo + i] and ref[lo + i] != "N"))
    wanted = [("1", p, len(v), np.median([x[0] for x in v]), np.median([x[1] for x in v if x[1] is not None]) if any(x[1] is not None for x in v) else None, sum(x[2] for x in v) / len(v)) for p, v in sorted(by.items())]
    assert [tuple(r.values()) for r in shallow] == wanted
