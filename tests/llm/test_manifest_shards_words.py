"""Merkle manifest, exact shards and spelling variants against brute force, and odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from math import comb

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import merkle, sharding, variants
from lociflow.llm.queries import op12_hypergeometric_shards
from lociflow.llm.shared import scratch

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (4, "Wort " * 20000, "en", "b", 100000), (5, "same text", "de", "a", 9), (5, "same text", "de", "a", 9), (None, "No Id", "en", "a", 5), (7, "ÄPFEL Äpfel", "de", "", 11)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns that clash with names used inside."""
    extra = {c: F.lit("x") for c in ("leaf", "root", "path", "group", "pos", "n", "digest", "word", "id", "shard", "slot", "ends", "permuted_at", "shuffle_mix", "row")}
    return spark.createDataFrame(ODD, DOC).withColumns(extra)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def brute_tree(leaves):
    """Root of a list of digests, and for each its (left, right) siblings by level."""
    at, paths, level = list(range(len(leaves))), [[] for _ in leaves], leaves
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for i, p in enumerate(at):
            run = runs[p // 16]
            paths[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        at, level = [p // 16 for p in at], [sha(*run) for run in runs]
    return level[0], paths


def brute_manifest(rows):
    by = defaultdict(list)
    for doc, text, lang, source, n in rows:
        own = leaf(doc, source, lang, n, text)
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        low = None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        by[source].append(((doc is not None, doc or 0), own, leaf(doc, source, lang, n, low) if hit else own, doc))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[1] for x in sorted(by[s])]) for s in sources}
    root, tops = brute_tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for (_, own, start, doc), path in zip(sorted(by[s]), trees[s][1]):
            d, proof = start, ""
            for left, right in path + top:
                d, proof = sha(left, d, right), proof + left + right
            out.append((doc, own, trees[s][0], root, sha(proof), d, d == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_against_brute_force(spark, odd):
    rng = random.Random(1)
    rows = [(i, f"Text {rng.random()}", "en", None if (s := rng.choice([0, 1, 1, 1, 1, 2, 3])) == 3 else f"s{s}", i) for i in rng.sample(range(10**6), 700)]
    rows += [(i, "T", "en", "lone", 1) for i in [5]] + [(i, "T", "en", "run", 1) for i in range(17)] + [(i, "T", "en", f"many{i}", 1) for i in range(40)]
    for given, df in ((rows, spark.createDataFrame(rows, DOC).repartition(3)), (ODD, odd)):
        out = sorted((tuple(r[c] for c in COLUMNS) for r in merkle.manifest(df).collect()), key=repr)
        assert out == brute_manifest(given)
    assert merkle.manifest(odd.limit(0)).count() == 0
    assert any(not r[-1] for r in brute_manifest(rows)) and sum(r[-1] for r in brute_manifest(rows)) > 500


def test_proofs_notice_any_change(spark):
    """Paths are a real output: a leaf folds to the root, another leaf in its place does not."""
    leaves = spark.range(300).select("id", F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit("x").alias("source"))
    with scratch(spark):
        out = merkle.prove(leaves, "source", ["id"]).select("id", "root", merkle.fold(F.col("leaf"), F.col("path")).alias("ok"), merkle.fold(F.sha2(F.lit("other"), 256), F.col("path")).alias("bad"), F.size("path").alias("n")).collect()
    assert len(out) == 300 and all(r["ok"] == r["root"] != r["bad"] and r["n"] == 3 for r in out)


@pytest.mark.parametrize("good, bad, draws", [(5, 7, 4), (50, 10, 30), (500, 300, 200), (3, 10000, 500), (2000, 30, 1500)])
def test_draws_follow_the_law(spark, good, bad, draws):
    n = 20000
    long = lambda v: F.lit(v).cast("bigint")
    got = np.array([r[0] for r in spark.range(n).select(sharding.hypergeometric(long(good), long(bad), long(draws), F.col("id"))).collect()])
    want = np.array([comb(good, x) * comb(bad, draws - x) / comb(good + bad, draws) if 0 <= draws - x <= bad else 0 for x in range(min(good, draws) + 1)]) * n
    seen = np.bincount(got, minlength=len(want))
    common = want > 5
    chi, free = ((seen[common] - want[common]) ** 2 / want[common]).sum(), max(1, common.sum() - 1)
    assert seen[want == 0].sum() == 0 and chi < free + 5 * np.sqrt(2 * free)


def test_draws_of_huge_numbers(spark):
    good, bad, draws, n = 10**11, 3 * 10**11, 2 * 10**11, 5000
    x = np.array([float(r[0]) for r in spark.range(n).select(sharding.hypergeometric(*(F.lit(v).cast("bigint") for v in (good, bad, draws)), F.col("id"))).collect()])
    var = draws * 0.25 * 0.75 * (good + bad - draws) / (good + bad)
    assert abs(x.mean() - draws * 0.25) < 5 * np.sqrt(var / n) and abs(x.var() / var - 1) < 0.12


def test_matrix_sums(spark):
    counts = spark.range(300).select(F.col("id").alias("block"), (F.col("id") % 7 * 100).alias("n"))
    total = sum(i % 7 * 100 for i in range(300))
    sizes = [total // 8 + (j < total % 8) for j in range(8)]
    with scratch(spark):
        rows = sharding.communication_matrix(counts, sizes).collect()
    m = np.array([r["take"] for r in rows])
    assert m.sum(0).tolist() == sizes and all(sum(r["take"]) == r["block"] % 7 * 100 for r in rows) and (m >= 0).all()
    full = m[m.sum(1) == 600] / 600
    assert 0.1 < full.mean() < 0.15 and 0.008 < full.std() < 0.02  # sd of a share of 600 draws is 0.0135


def test_shards_are_exact_and_uniform(spark, odd):
    with scratch(spark):
        out = sharding.shard(spark.range(0, 20003, 1, 13), rows_a_range=500).toPandas()
        again = sharding.shard(spark.range(0, 20003, 1, 13), rows_a_range=500, seed=1).toPandas()
        few = sharding.shard(spark.range(5)).toPandas()
        strange = sharding.shard(odd).collect()
        assert sharding.shard(odd.limit(0)).count() == 0
    sizes = out["shard"].value_counts()
    assert out["id"].is_unique and len(out) == 20003 and sizes.max() - sizes.min() == 1 and all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert sorted(few["shard"].value_counts().tolist()) == [1] * 5 and sorted((r["doc_id"], r["text"], r["id"]) for r in strange if r["doc_id"]) == sorted((r[0], r[1], "x") for r in ODD if r[0])
    # Places in the input, shards and slots are independent, and another seed gives another shuffle.
    place = out.sort_values(["shard", "slot"])["id"].to_numpy()
    assert abs(np.corrcoef(np.arange(len(place)), place)[0, 1]) < 0.04 and abs(np.corrcoef(place[:-1], place[1:])[0, 1]) < 0.04
    table = np.histogram2d(out["id"], out["shard"], bins=[13, 8])[0]
    assert ((table - table.mean()) ** 2 / table.mean()).sum() < 84 + 5 * np.sqrt(168)
    assert (out.sort_values("id")["shard"].to_numpy() == again.sort_values("id")["shard"].to_numpy()).mean() < 0.2


def test_shard_query(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = op12_hypergeometric_shards(spark, SF).collect()
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out} == want and {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    with scratch(spark):
        sharding.write_shards(sharding.shard(docs, 4), f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == docs.count() and back.join(docs, ["doc_id", "text"], "left_semi").count() == docs.count() and back.select("shard").distinct().count() == 4


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    nears = defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            nears[a].append(b)
            nears[b].append(a)
    form = {}
    for w in words:
        best = min(nears[w], key=lambda b: (-words[b], b), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(nears[w]), words[form[w]] if form[w] else None))
    return sorted(out)


WORD_COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_words_against_brute_force(spark, odd):
    rng = random.Random(3)
    alphabet = "abéß"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(6, 9))) for _ in range(40)]
    for _ in range(160):  # chains of single edits
        w = rng.choice(base)
        i = rng.randrange(len(w))
        base.append(w[:i] + rng.choice(["", rng.choice(alphabet), w[i] + rng.choice(alphabet)]) + w[i + 1 :])
    long = ["x" * 39, "x" * 40, "x" * 41, "x" * 42, "y" + "x" * 40, "x" * 20 + "z" + "x" * 20, "ab" * 300, "ab" * 299 + "aa", "ab" * 299 + "a", "ba" * 300]
    words = [w for w in base for _ in range(rng.choice([5, 5, 6, 30, 200]))] + [w for w in long for _ in range(rng.choice([5, 40]))]
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 60 : i * 60 + 60]).title() + ". 12,É") for i in range(len(words) // 60 + 1)]
    rows += [(i, "frequent FREQUENT fréquent ") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted(tuple(r[c] for c in WORD_COLUMNS) for r in variants.spelling_variants(df).collect())
    want = brute_variants(rows)
    assert out == want and sum(r[4] for r in want) > 150 and any(r[2] != r[0] and r[2] != r[1] for r in want)
    assert {r[0] for r in want if len(r[0]) > 36 and r[4]}
    assert [tuple(r[c] for c in WORD_COLUMNS) for r in variants.spelling_variants(odd).collect()] == [] and variants.spelling_variants(odd.limit(0)).count() == 0


@pytest.mark.parametrize("module, columns", [(merkle, COLUMNS), (variants, WORD_COLUMNS)])
def test_twins(spark, module, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    run = merkle.manifest if module is merkle else variants.spelling_variants
    got = sorted((tuple(r[c] for c in columns) for r in run(spark.read.parquet(f"{SF}/documents.parquet")).collect()), key=repr)
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({module.oracle_sql()})").fetchall(), key=repr)
