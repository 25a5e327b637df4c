"""Language spans of mixed text: script ranges narrow the candidates, then Viterbi over word scores.

A word is a run of letters. Its score in a language is the sum of smoothed log probabilities of
its character 2-, 3- and 4-grams, word borders included. Only languages that write in the word's
script stay candidates. Viterbi with a penalty for each switch labels the words; runs of one
label are the spans. Texts are handled whole, many side by side.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import delete, shared_path, slices

#: The first code point of each script's blocks, and its end.
SCRIPTS = {
    "Latin": [(0x41, 0x250), (0x1E00, 0x1F00)],
    "Greek": [(0x370, 0x400), (0x1F00, 0x2000)],
    "Cyrillic": [(0x400, 0x530)],
    "Armenian": [(0x530, 0x590)],
    "Hebrew": [(0x590, 0x600)],
    "Arabic": [(0x600, 0x700), (0x750, 0x780)],
    "Devanagari": [(0x900, 0x980)],
    "Bengali": [(0x980, 0xA00)],
    "Tamil": [(0xB80, 0xC00)],
    "Thai": [(0xE00, 0xE80)],
    "Georgian": [(0x10A0, 0x1100)],
    "Hangul": [(0x1100, 0x1200), (0xAC00, 0xD7B0)],
    "Kana": [(0x3040, 0x3100)],
    "Han": [(0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)],
}

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
SLICE_BYTES = 2 << 20


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower-case letter, 0 for what is no letter; its script."""
    lower, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            small = s.lower()
            lower[c] = ord(small) if len(small) == 1 else c
    for i, blocks in enumerate(SCRIPTS.values(), 1):
        for a, b in blocks:
            script[a:b] = i
    return lower, script


def _words(texts: list[str]) -> dict:
    """All words of the texts: bounds in the joined code points, document, script, and n-gram buckets by position."""
    lower, script = _tables()
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = lower[raw]
    letter = code > 0
    edge = np.diff(letter.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the text ends with a line end
    first = np.cumsum(sizes) - sizes
    # Positions that carry n-grams: the letters and the border after each word.
    held = letter.copy()
    held[end] = True
    mixed, grams = code * np.uint32(2654435761), []
    padded = np.concatenate([np.zeros(3, np.uint32), code])
    odd = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
    at = np.flatnonzero(held)
    h = mixed[at]
    inside = np.ones(len(at), bool)
    for back in (1, 2, 3):
        before = padded[at + 3 - back]
        before = np.where(inside, before, 0)
        inside &= before > 0
        h = (h ^ (before + np.uint32(back)) * odd[back - 1]) * np.uint32(0x27D4EB2F)
        grams.append(((h >> np.uint32(15)) ^ h) & np.uint32(BUCKETS - 1))
    return {"start": start, "end": end, "doc": np.searchsorted(first, start, side="right") - 1, "first": first, "script": script[raw[start]], "grams": grams, "begin": np.searchsorted(at, start)}


class LanguageModel:
    """Log probabilities of n-gram buckets by language, and the scripts of each language."""

    def __init__(self, langs: list[str], logs: np.ndarray, scripts: np.ndarray, penalty: float):
        self.langs, self.logs, self.scripts, self.penalty = langs, logs, scripts, penalty

    def label(self, texts: list[str]) -> tuple[dict, np.ndarray]:
        """The words of the texts and the index of each word's language."""
        w = _words(texts)
        n = len(w["start"])
        if not n:
            return w, np.zeros(0, np.int8)
        score = sum(self.logs[i].take(g, axis=0) for i, g in enumerate(w["grams"]))
        score = np.add.reduceat(score, w["begin"], axis=0)
        allowed = self.scripts[w["script"]]
        known = allowed.any(1)
        score = np.where(allowed, score, -1e6)
        score[~known] = 0
        return w, self._viterbi(score, np.bincount(w["doc"], minlength=len(texts)))

    def _viterbi(self, score: np.ndarray, counts: np.ndarray) -> np.ndarray:
        order = np.argsort(-counts, kind="stable")
        first = (np.cumsum(counts) - counts)[order]
        length = counts[order]
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # documents longer than t
        back = np.empty(score.shape, np.int8)
        own = np.arange(score.shape[1], dtype=np.int8)
        best = np.zeros((len(counts), score.shape[1]), np.float32)
        for t, m in enumerate(active.tolist()):
            at = first[:m] + t
            v = best[:m]
            top = v.argmax(1)
            switch = v[np.arange(m), top] - self.penalty
            stay = v >= switch[:, None]
            back[at] = np.where(stay, own, top[:, None])
            v[:] = np.where(stay, v, switch[:, None]) + score[at]
            v -= v.max(1, keepdims=True)
        state = best.argmax(1).astype(np.int8)
        out = np.empty(len(score), np.int8)
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            at = first[:m] + t
            out[at] = state[:m]
            state[:m] = back[at, state[:m]]
        return out


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_docs: int = 8000, penalty: float = 12.0, min_script_share: float = 0.02) -> LanguageModel:
    """Fit the model on at most ``max_docs`` labelled rows, those with the smallest hashes of their ids.

    Rows with a null label are left out; rows that repeat id and text count once. The hashes are
    chosen without the texts, and only the chosen texts are fetched, so no task holds more texts
    than its own rows. N-grams are counted on the executors; the driver gets the counts, whose
    number is bounded by the buckets and languages.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(id_col).alias("h"), F.xxhash64(text).alias("g"))
    picked = shared_path(docs.sparkSession, "language-sample")
    given.select("h", "g").orderBy("h", "g").limit(max_docs).distinct().write.parquet(picked)
    chosen = docs.sparkSession.read.schema("h bigint, g bigint").parquet(picked)
    sample = given.join(F.broadcast(chosen), ["h", "g"], "left_semi").groupBy("h", "g").agg(F.min("lang").alias("lang"), F.first("text").alias("text"))
    sample = sample.select("lang", "text").repartition(docs.sparkSession.sparkContext.defaultParallelism)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, scripts = {}, {}
        for frame in frames:
            for lang, own in frame.groupby("lang", sort=True):
                table = grams.setdefault(lang, np.zeros((len(ORDERS), BUCKETS), np.int64))
                letters = scripts.setdefault(lang, np.zeros(len(SCRIPTS) + 1, np.int64))
                texts = own["text"].tolist()
                for at in range(0, len(texts), 200):
                    w = _words(texts[at : at + 200])
                    letters += np.bincount(w["script"], weights=w["end"] - w["start"], minlength=len(letters)).astype(np.int64)
                    for i, g in enumerate(w["grams"]):
                        table[i] += np.bincount(g, minlength=BUCKETS)
        for lang, table in grams.items():
            order, bucket = np.nonzero(table)
            yield pd.DataFrame({"lang": lang, "part": order, "bucket": bucket, "n": table[order, bucket]})
            own = np.flatnonzero(scripts[lang])
            yield pd.DataFrame({"lang": lang, "part": -1, "bucket": own, "n": scripts[lang][own]})

    counted = sample.mapInPandas(count, "lang string, part int, bucket int, n bigint").groupBy("lang", "part", "bucket").agg(F.sum("n").alias("n"))
    try:
        counts = counted.toPandas()
    finally:
        delete(docs.sparkSession, picked)
    langs = sorted(counts["lang"].unique())
    table, scripts = np.zeros((len(ORDERS), BUCKETS, len(langs))), np.zeros((len(SCRIPTS) + 1, len(langs)))
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        letters = own[own["part"] < 0]
        scripts[letters["bucket"], i] = letters["n"]
        own = own[own["part"] >= 0]
        table[own["part"], own["bucket"], i] = own["n"]
    logs = np.log((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
    share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
    return LanguageModel(langs, logs, share >= min_script_share, penalty)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_spans) per row.

    ``lang_pred`` is the language of most letters over the spans, the alphabetically first of
    equals, and ``score`` its share of the letters. Null texts, texts without letters, and any
    text under a model without languages give ``und`` and 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shipped.value)
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                texts = piece.column("text").fill_null("").to_pylist()
                n, k = len(texts), len(m.langs)
                lang, score, spans = ["und"] * n, np.zeros(n), np.zeros(n, np.int64)
                w, label = m.label(texts) if k else ({"start": ()}, None)
                if len(w["start"]):
                    letters = np.bincount(w["doc"] * k + label, weights=w["end"] - w["start"], minlength=n * k).reshape(n, k)
                    total, top = letters.sum(1), letters.argmax(1)
                    score = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0)
                    lang = [m.langs[t] if s > 0 else "und" for t, s in zip(top.tolist(), total.tolist())]
                    new = np.append(True, (label[1:] != label[:-1]) | (w["doc"][1:] != w["doc"][:-1]))
                    spans = np.bincount(w["doc"][new], minlength=n)
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.int64())], names=["id", "lang_pred", "score", "n_spans"])

    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, lang_pred string, score double, n_spans bigint").withColumnRenamed("id", id_col)


def spans(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, span, begin, end, lang): the labelled spans of each text, as half-open character offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shipped.value)
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                texts = piece.column("text").fill_null("").to_pylist()
                w, label = m.label(texts) if m.langs else ({"start": ()}, None)
                if not len(w["start"]):
                    continue
                new = np.append(True, (label[1:] != label[:-1]) | (w["doc"][1:] != w["doc"][:-1]))
                at = np.flatnonzero(new)
                last = np.append(at[1:], len(label)) - 1
                doc = w["doc"][at]
                number = np.arange(len(at)) - np.searchsorted(doc, doc)
                yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(doc)), pa.array(number, pa.int64()), pa.array(w["start"][at] - w["first"][doc], pa.int64()), pa.array(w["end"][last] - w["first"][doc], pa.int64()), pa.array([m.langs[i] for i in label[at].tolist()], pa.string())], names=["id", "span", "begin", "end", "lang"])

    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, span bigint, begin bigint, end bigint, lang string").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: CRC-32 of the id as text, remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
