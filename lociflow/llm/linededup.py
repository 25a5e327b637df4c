"""Line deduplication by overlapping windows of three lines, with DataFrame operations only.

Every three consecutive lines of a text are hashed together (128 bits). Windows whose hash
occurs more than once over all texts are repeats; the first is the one with the smallest
(id, text, line). Lines covered by any later occurrence are removed; overlapping covers are merged
into ranges, and a text is put together from what lies between its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import free_name, held_once

WINDOW = 3


def windows(texts: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, key, pos, h1, h2) of ``texts`` (id, key, text): the hash of each window of ``size`` lines; shorter texts have none."""
    lines = texts.select("id", "key", F.split("text", "\n").alias("lines")).filter(F.size("lines") >= size)
    at = lines.select("id", "key", "lines", F.explode(F.expr(f"sequence(0, size(lines) - {size})")).alias("pos"))
    own = [F.expr(f"lines[pos + {i}]") for i in range(size)]
    return at.select("id", "key", F.col("pos").cast("bigint").alias("pos"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit("second"), *own).alias("h2"))


def removed_lines(texts: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, key, starts, ends): for each text that loses lines the half-open ranges of their positions, in order and apart.

    An occurrence that overlaps the first one within its own text is no later occurrence, so a
    run of equal lines keeps its first window. Overlapping and touching covers become one range.
    """
    seen = windows(texts, size)
    first = seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "pos")).alias("first")).filter("n > 1").select("h1", "h2", "first")
    own = (F.col("id") == F.col("first.id")) & (F.col("key") == F.col("first.key"))
    later = seen.join(first, ["h1", "h2"]).filter(~own | (F.col("pos") >= F.col("first.pos") + size))
    covers = later.groupBy("id", "key").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    # Each window covers ``size`` lines, so a range begins and ends where the next start is further away than that.
    begins = held_once(F.col("at"), lambda at: F.filter(at, lambda p, i: (i == 0) | (p > F.get(at, i - 1) + size)))
    lasts = held_once(F.col("at"), lambda at: F.filter(at, lambda p, i: F.coalesce(F.get(at, i + 1) > p + size, F.lit(True))))
    return covers.select("id", "key", begins.alias("starts"), F.transform(lasts, lambda p: p + size).alias("ends"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut from the text, and ``n_lines`` and ``n_removed`` added.

    Texts keep their other lines in order. Null texts stay null with no lines. Rows that repeat id
    and text are one text in the search and lose the same lines; different texts of one id are
    different texts, ordered by their hash. A text of which every line is a repeat becomes empty.
    Rows with a null id take part in no search and stay as they are. Columns named ``n_lines`` or
    ``n_removed`` are replaced, all others stay.
    """
    names = {c: free_name(docs, f"cut_{c}") for c in ("id", "key", "starts", "ends")}
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text")).filter("id is not null and text is not null").dropDuplicates(["id", "key"])
    gone = removed_lines(own, size).select(*(F.col(c).alias(n) for c, n in names.items()))
    joined = docs.join(gone, (F.col(id_col) == F.col(names["id"])) & (F.xxhash64(text) == F.col(names["key"])), "left")
    starts, ends, lines = F.col(names["starts"]), F.col(names["ends"]), F.split(text, "\n")
    # The lines between the ranges: before the first, between two, after the last.
    def between(all_lines: Column) -> Column:
        def part(i: Column) -> Column:
            begin = F.coalesce(F.get(ends, i - 1), F.lit(0)).cast("int")
            return F.slice(all_lines, begin + 1, F.coalesce(F.get(starts, i).cast("int"), F.size(all_lines)) - begin)

        return F.transform(F.sequence(F.lit(0), F.size(starts)), part)

    kept = held_once(lines, between)
    n = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    removed = F.coalesce(F.aggregate(F.zip_with(starts, ends, lambda a, b: b - a), F.lit(0).cast("bigint"), lambda total, x: total + x), F.lit(0).cast("bigint"))
    return joined.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_lines", "n_removed")),
        F.when(starts.isNull(), text).otherwise(F.array_join(F.flatten(kept), "\n")).alias(text_col), n.alias("n_lines"), removed.alias("n_removed"),
    )


def oracle_sql() -> str:
    """DuckDB twin of ``dedup_lines`` over documents, by whole windows instead of hashes."""
    return """WITH texts AS (SELECT DISTINCT doc_id, text FROM documents),
ls AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM texts),
w AS (SELECT doc_id, p, l[p + 1 : p + 3] AS k FROM (SELECT doc_id, l, unnest(range(len(l) - 2)) AS p FROM ls WHERE len(l) >= 3)),
f AS (SELECT k, min({'d': doc_id, 'p': p}) AS f FROM w GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT q) AS g FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM w JOIN f USING (k) WHERE doc_id <> f.f.d OR p >= f.f.p + 3) GROUP BY doc_id)
SELECT doc_id, CASE WHEN g IS NULL THEN text ELSE array_to_string([x FOR x, i IN l IF NOT list_contains(g, i - 1)], chr(10)) END AS text, coalesce(len(l), 0) AS n_lines, coalesce(len(g), 0) AS n_removed
FROM ls LEFT JOIN gone USING (doc_id)"""
