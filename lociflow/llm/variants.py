"""Spelling variants: words one edit apart, by a relational trie frontier.

States (word, position, node, edits) are joined with a table of trie edges level by level; a
state that has used its one edit and ends at a word is a neighbour. One edit leaves the first or
the second half of a word as it is, so words are walked through a trie of all words and, turned
round, through one of all words turned round, each from the node of the half that stays: states
branch only below such nodes and never at the root.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import crc32_sql, materialise, scratch

RUN = re.compile("[a-zÀ-ÿ]+")
DAMAGE = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words up to this length walk the trie, one level a code point; longer ones meet by hashes of all their one-edit forms.
TRIE_LENGTH = 40
#: Words that a task counts before it hands them on.
COUNTER_ROWS = 500_000


def damaged(run: str, doc: str | None) -> str:
    """The run without one code point where its checksum with the document's id says so."""
    h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
    if h % DAMAGE:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least six code points and five occurrences; counts are added up in each task before the shuffle.

    Null and empty texts have no words; runs of rows with a null id stay as they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words, counts = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, raw in zip(batch.column("id"), batch.column("text")):
                if not raw.is_valid:
                    continue
                # bytes.lower() changes A-Z alone. Runs of very long texts are not held all at once.
                text = raw.as_buffer().to_pybytes().lower().decode()
                runs = RUN.findall(text) if len(text) < 1 << 22 else (m.group() for m in RUN.finditer(text))
                for word, n in Counter(runs).items():
                    word = damaged(word, doc.as_py())
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) > COUNTER_ROWS:
                    yield out()
        yield out()

    given = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _walks(words: DataFrame) -> DataFrame:
    """(turned, word, m): each word as it is and turned round."""
    return words.select(F.explode(F.array(F.struct(F.lit(False).alias("turned"), F.col("word")), F.struct(F.lit(True).alias("turned"), F.reverse("word").alias("word")))).alias("x")).select("x.turned", "x.word", F.char_length("x.word").alias("m"))


def trie_edges(words: DataFrame, above: int = LEAST_LENGTH // 2) -> DataFrame:
    """(turned, node, ch, ends) of both tries below depth ``above``: a node is its prefix, ``ends`` says that the child is a word."""
    at = _walks(words).filter(F.col("m") > above).select("turned", "word", "m", F.explode(F.sequence(F.lit(above), F.col("m") - 1)).alias("i"))
    return at.groupBy("turned", F.substring("word", F.lit(1), F.col("i")).alias("node"), F.substring("word", F.col("i") + 1, F.lit(1)).alias("ch")).agg(F.max(F.col("i") + 1 == F.col("m")).alias("ends"))


def _advance(front: DataFrame, edges: DataFrame) -> DataFrame:
    """The states that follow ``front``: a match, a smaller code point in the word's place, or one of the word's left out."""
    ch = F.substring("word", F.col("pos") + 1, F.lit(1))
    same = F.col("ch") == ch
    met = front.drop("ends").join(edges, ["turned", "node"]).filter(same | ((F.col("edits") == 0) & (F.col("ch") < ch)))
    moved = met.select("turned", "word", "m", (F.col("pos") + 1).alias("pos"), F.concat("node", "ch").alias("node"), (F.col("edits") + F.when(same, 0).otherwise(1)).alias("edits"), "ends")
    cut = front.filter("edits = 0").select("turned", "word", "m", (F.col("pos") + 1).alias("pos"), "node", F.lit(1).alias("edits"), "ends")
    return moved.union(cut)


def _by_trie(words: DataFrame) -> DataFrame:
    """(a, b) for words one replacement (a > b at the place) or one deletion (b is shorter) apart, each once or more."""
    edges = materialise(trie_edges(words), "trie-edges")
    half = F.floor(F.col("m") / 2).cast("int")
    # The turned word's walk starts where the second half of the word ends, so every place of an edit lies in one of both walks.
    begin = F.when(F.col("turned"), F.col("m") - half).otherwise(half)
    front = _walks(words).withColumn("pos", begin).withColumn("node", F.substring("word", F.lit(1), F.col("pos"))).withColumn("edits", F.lit(0)).withColumn("ends", F.lit(False))
    found = None
    for _ in range(TRIE_LENGTH):
        step = materialise(_advance(front, edges), "frontier")
        own = step.filter("edits = 1 and pos = m and ends").select(*(F.when(F.col("turned"), F.reverse(c)).otherwise(F.col(c)).alias(n) for c, n in (("word", "a"), ("node", "b"))))
        found = own if found is None else found.union(own)
        front = step.filter("pos < m")
        if front.isEmpty():
            break
    return found


def _by_hashes(words: DataFrame) -> DataFrame:
    """(a, b) one edit apart, each once or more, for words that are too long to walk: rolling hashes of all forms meet, and pairs are verified."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        for batch in batches:
            for own, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
                code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
                term = code * np.cumprod(np.full(len(code), base, np.uint64))
                upto = np.cumsum(term)
                with np.errstate(over="ignore"):
                    gone = upto - term + (upto[-1] - upto) * np.uint64(inverse)  # without i: the code points before it and those after it, one place down
                    wild = (upto[-1] - term) * np.uint64(31) + np.arange(len(code), dtype=np.uint64)
                keys = np.concatenate([gone, wild, upto[-1:]]).view(np.int64)
                kind = ["cut"] * len(code) + ["wild"] * len(code) + ["whole"]
                for at in range(0, len(keys), 4096):
                    part = keys[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), own)), pa.array(part), pa.array(kind[at : at + 4096])], names=["id", "key", "kind"])

    named = words.select(F.xxhash64("word").alias("id"), "word")
    forms = materialise(named.mapInArrow(run, "id bigint, key bigint, kind string").distinct(), "long-forms")
    cut, whole, wild = (forms.filter(F.col("kind") == k) for k in ("cut", "whole", "wild"))
    pairs = cut.select("key", F.col("id").alias("i")).join(whole.select("key", F.col("id").alias("j")), "key")
    pairs = pairs.union(wild.select("key", F.col("id").alias("i")).join(wild.select("key", F.col("id").alias("j")), "key").filter("i < j")).select("i", "j").distinct()
    pairs = pairs.join(named.select(F.col("id").alias("i"), F.col("word").alias("a")), "i").join(named.select(F.col("id").alias("j"), F.col("word").alias("b")), "j")
    return pairs.select("a", "b").filter(F.levenshtein("a", "b", 1) == 1)


def neighbours(words: DataFrame) -> DataFrame:
    """(a, b), both ways and each once: different ``words`` (word) that differ by one inserted, deleted or replaced code point."""
    length = F.char_length("word")
    near = _by_trie(words.filter(length <= TRIE_LENGTH).select("word"))
    if not (long := words.filter(length >= TRIE_LENGTH).select("word")).isEmpty():
        near = near.union(_by_hashes(long))
    return near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root) of ``forms`` (word, form): forms followed to the last by pointer jumping; a word without one is its own root."""
    at = materialise(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    for _ in range(max_rounds):
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialise(at.join(up, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        at = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            return at
    raise RuntimeError(f"roots did not settle in {max_rounds} rounds")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """One row a word: form, root, n, n_near, form_n.

    A word's form is its most frequent neighbour (ties: the smallest in code-point order) if that
    occurs at least ``ratio`` times as often, else null. Null and empty texts have no words, repeated
    rows count as often as they stand there, extra columns are ignored, and words of any length are
    compared. An empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        words = materialise(word_counts(docs, id_col, text_col).filter(F.char_length("word") >= LEAST_LENGTH), "words")
        near = neighbours(words.select("word"))
        counted = near.join(words.select(F.col("word").alias("b"), "n"), "b")
        best = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "b")).alias("best"))
        own = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
        good = F.col("form_n") >= F.lit(ratio) * F.col("n")
        own = materialise(own.select("word", F.when(good, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(good, F.col("form_n")).alias("form_n")), "forms")
        return materialise(own.join(roots(own), "word").select("word", "form", "root", "n", "n_near", "form_n"), "spelling-variants", keep=True)


def oracle_sql() -> str:
    """DuckDB twin of ``spelling_variants`` over documents: neighbours by forms with one code point left out or masked."""
    ascii_lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE {crc32_sql()},
runs AS (SELECT doc_id, r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({ascii_lower}, '[a-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
marked AS MATERIALIZED (SELECT r, n, CASE WHEN doc_id IS NULL THEN 1 ELSE {crc32_sql("(doc_id || ':' || r)")} END AS h FROM runs),
vocab AS MATERIALIZED (SELECT w AS word, sum(n)::bigint AS n FROM (SELECT CASE WHEN h % {DAMAGE} = 0 THEN r[1 : h % length(r)] || r[h % length(r) + 2 :] ELSE r END AS w, n FROM marked) GROUP BY w HAVING sum(n) >= {LEAST_COUNT} AND length(w) >= {LEAST_LENGTH}),
forms AS MATERIALIZED (SELECT word, i, word[1 : i] AS head, word[i + 2 :] AS tail FROM (SELECT word, unnest(range(length(word))) AS i FROM vocab)),
pairs AS (SELECT x.word AS a, y.word AS b FROM forms x JOIN forms y USING (i, head, tail) WHERE x.word <> y.word
 UNION SELECT f.word, v.word FROM forms f JOIN vocab v ON v.word = f.head || f.tail UNION SELECT v.word, f.word FROM forms f JOIN vocab v ON v.word = f.head || f.tail),
best AS (SELECT a, count(*) AS n_near, min({{'less': -n, 'b': encode(b)}}) AS best FROM pairs JOIN vocab ON vocab.word = b GROUP BY a),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {RATIO} * n THEN decode(best.b) END AS form, CASE WHEN -best.less >= {RATIO} * n THEN -best.less END AS form_n FROM vocab LEFT JOIN best ON a = word),
climb(word, here, step) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT climb.word, form, step + 1 FROM climb JOIN formed ON formed.word = climb.here WHERE form IS NOT NULL)
SELECT word, form, arg_max(here, step) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n)::bigint AS form_n FROM climb JOIN formed USING (word) GROUP BY word, form"""
