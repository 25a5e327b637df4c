"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints have 64 bits. For links at two or fewer differing bits each is cut into two
segments, so one segment differs by at most one bit; every segment is indexed under its 32
one-wildcard variants, variants meet in an equality join, and the pairs are verified. Index
entries under which very many distinct fingerprints meet are not paired: their fingerprints
are indexed again under all two-bit wildcards of the whole fingerprint, where at most four
distinct fingerprints can meet and all of them are linked, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.components import connected_components
from lociflow.llm.shared import materialise, not_broadcast, scratch

SHINGLE_WORDS = 3
SEED = 42


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text as an unsigned number; no words give zero."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return digest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]).tolist()
    starts = [0, *ends]
    total, count = np.zeros(64, np.int64), len(tokens) - words + 1
    for at in range(0, count, 1 << 16):  # bounded memory for very long texts
        stop = min(count, at + (1 << 16))
        h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:stop], ends[at + words - 1 : stop + words - 1])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row, fp as a signed 64-bit number. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps)], names=["id", "fp"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, fp bigint").withColumnRenamed("id", id_col)


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under the 64 one-wildcard variants of its two segments."""
    half = F.when(F.col("w") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    bit = F.expr("shiftleft(1L, w % 32)")
    spread = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w"))
    return spread.select(F.expr("shiftleft(cast(w as bigint), 32)").bitwiseOR(half.bitwiseAND(F.bitwise_not(bit))).alias("key"), "fp")


def links(fps: DataFrame, bucket_limit: int = 256) -> DataFrame:
    """Distinct pairs (x, y), x < y, of distinct fingerprints at two or fewer differing bits.

    Within index entries of over ``bucket_limit`` fingerprints, pairs are given between each
    two-bit-wildcard class's smallest member and the others, which keeps every component.
    """
    keys = variants(fps)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialise(not_broadcast(keys).join(shared, "key"), "variants")
    few = met.filter(F.col("n") <= bucket_limit).select("key", "fp")
    near = (F.col("x") < F.col("y")) & (F.expr("bit_count(x ^ y)") <= 2)
    plain = not_broadcast(few.select("key", F.col("fp").alias("x"))).join(few.select("key", F.col("fp").alias("y")), "key").filter(near).select("x", "y")
    hot = met.filter(F.col("n") > bucket_limit).select("fp").distinct().select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("p")).select("fp", "p", F.explode(F.expr("sequence(p + 1, 63)")).alias("q"))
    kept = F.col("fp").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, p) | shiftleft(1L, q)")))
    cliques = hot.groupBy("p", "q", kept.alias("kept")).agg(F.min("fp").alias("x"), F.collect_set("fp").alias("all"))
    star = cliques.filter(F.size("all") > 1).select("x", F.explode("all").alias("y")).filter("x < y")
    return plain.union(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = 256) -> DataFrame:
    """(id, fingerprint, component_id) per row of ``docs``.

    Rows with the same or nearly the same fingerprint share a component, named by its smallest
    id. Exact copies are reduced to one fingerprint before anything is joined. Rows with a null
    id keep their fingerprint and get a null component unless others share it; they link no two
    others. Null texts count as empty, long ones are read in pieces, rows that repeat are reported
    each, extra columns are ignored, and an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        own = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
        nodes = materialise(own.groupBy("fp").agg(F.min(id_col).alias("rep")), "nodes")
        found = links(nodes.select("fp"), bucket_limit)
        ends = nodes.filter("rep is not null")
        a, b = (not_broadcast(ends.select(F.col("fp").alias(v), F.col("rep").alias(r))) for v, r in ("xa", "yb"))
        found = found.join(a, "x").join(b, "y")
        comps = connected_components(found)
        named = nodes.join(not_broadcast(comps), nodes["rep"] == comps["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
        out = own.join(not_broadcast(named), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
        return materialise(out, "near-duplicates", keep=True)
