"""The near-copy stage against all pairs of exact shingle sets."""

import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from lociflow.llm import nearcopies

SF = "/root/testdata/sf0.001"


def runs(text):
    k = (text or "").encode().lower().split()
    return frozenset(tuple(k[i : i + 5]) for i in range(max(1, len(k) - 4)))


def brute_kept(texts):
    """Smallest ids of the groups that all pairs at Jaccard 0.8 or more make."""
    sets, root = {i: runs(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in texts if find(i) == i}


def test_stage_removes_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r[0] for r in pipeline.drop_near_copies(spark, docs, SF).select("doc_id").collect()}
    assert kept == brute_kept({r["doc_id"]: r["text"] for r in docs.collect()})


@pytest.mark.parametrize("options", [{}, {"bucket_limit": 8, "deal": 4}])
def test_copies_about_the_limit(spark, options):
    rng, texts = random.Random(3), {}
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(4):
            own = list(words)
            for _ in range(rng.randrange(9)):
                own[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(own)
    texts |= {len(texts) + k: f"{' '.join(words)} tail{k}" for k in range(60)}  # one large group
    kept = nearcopies.keep_first(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **options)
    assert {r["doc_id"] for r in kept.collect()} == brute_kept(texts)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "Two  WORDS"), (5, "Two  WORDS"), (None, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in nearcopies.keep_first(docs).collect()) == [0, 1, 4]
    assert nearcopies.keep_first(docs.limit(0)).count() == 0


def test_made_rows_are_not_broadcast(spark, monkeypatch):
    """Keys that are exploded from a small file look small to Spark; they never go through the driver."""
    from lociflow.llm import components, nearcopies, shared, simhash

    plans = []
    plain = shared.materialise

    def watched(df, what, keep=False):
        plans.append((what, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, what, keep)

    for module in (components, nearcopies, simhash):
        monkeypatch.setattr(module, "materialise", watched)
    texts = [" ".join(f"w{i}x{j % 40}" for j in range(60)) + f" end{i % 2}" for i in range(6)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    fps = plain(spark.range(500).select(F.col("id").alias("fp")), "fps")
    assert simhash.links(fps, bucket_limit=4).count() > 0
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() == 6
    assert nearcopies.keep_first(docs).count() == 6
    assert nearcopies.keep_first(docs, bucket_limit=1).count() == 6
    joins = [(what, p) for what, p in plans if "Join" in p]
    assert {"variants", "near-duplicates"} <= {what for what, _ in joins}
    assert not [what for what, p in joins if "BroadcastHashJoin" in p and what not in ("wanted-ids", "sets")]


def test_tables_over_the_limit_are_not_broadcast(spark):
    from lociflow.llm.shared import broadcast_if_small

    own, few = spark.range(100), spark.range(10)
    joined = lambda limit: own.join(broadcast_if_small(few, F.lit(8), limit), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined(80) and "BroadcastHashJoin" not in joined(79)
