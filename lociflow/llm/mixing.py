"""Mixing to target weights: iterative proportional fitting, with DataFrame operations only.

Tokens are summed by cell (one value of each dimension). Every value of a dimension has a target in
tokens, and all targets of a dimension add up to the budget. Raking multiplies the weights of each
value's cells in turn so that the value's expected tokens meet its target. A cell gives at most all
its tokens (probability one): the factor is chosen so that what full cells cannot give is given by
the value's other cells. Rounds go on until every target of every dimension is met.

A value that holds fewer tokens than its share of the budget gives all it has, and its surplus goes
to the dimension's other values in proportion to their shares, so the budget holds.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.shared import broadcast_if_small, free_name, materialise, scratch

WORD = r"[^ \t\n\r\x0B\x0C]+"

#: Raking stops when no target is missed by more than this share of itself.
TOLERANCE = 1e-4
MAX_STEPS = 20
#: Rounds of raking in one step, over all dimensions each; then the gap is looked at.
ROUNDS = 3
#: Up to so many cells are raked in one task, without a shuffle; more are raked by a shuffle for each dimension.
ONE_TASK_CELLS = 200_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def topic(text: Column) -> Column:
    """A coarse kind of content: legal, contact, table or prose."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.contains(t, F.lit("icense")), "legal").when(F.contains(t, F.lit("@")), "contact").when(F.contains(t, F.lit(" | ")), "table").otherwise("prose")


def _value(dim: Column) -> Column:
    return F.coalesce(dim.cast("string"), F.lit("unknown"))


def cells(docs: DataFrame, dims: dict[str, Column], tokens: Column) -> DataFrame:
    """(d0, d1, ..., tokens): tokens by cell, cells without tokens left out; null values of a dimension are ``unknown``."""
    named = [_value(c).alias(f"d{i}") for i, c in enumerate(dims.values())]
    summed = docs.select(*named, tokens.cast("bigint").alias("tokens")).groupBy(*(f"d{i}" for i in range(len(dims)))).agg(F.sum("tokens").alias("tokens"))
    return summed.filter("tokens > 0")


def _level(part: list[str], cap: Column, base: Column, total: Column, order: list[str]) -> Column:
    """The factor f by which the sum of least(cap, f * base) over a part is ``total``; null if only all of ``cap`` gives it.

    Rows fill up in the order of cap / base. f counts on the first row that does not fill up: what is
    left of the total, over the bases from there on.
    """
    ratio = cap / base
    up = Window.partitionBy(*part).orderBy(ratio, *order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*part).orderBy(ratio.desc(), *(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (total - F.coalesce(F.sum(cap).over(up), F.lit(0.0))) / F.sum(base).over(down)
    return F.when(level * base <= cap, level)


#: What a dimension is to be: shares by value, or an exponent of its values' tokens (0: equal shares, 1: as they are).
Wanted = float | dict[str, float]


def targets(table: DataFrame, wanted: dict[str, Wanted], budget: float) -> DataFrame:
    """(dim, value, available, share, asked, target) of the cells of ``table``, one row for each value.

    With an exponent ``share`` is the value's tokens to its power, normalised. With given shares it
    is the value's own; values without one divide what the given shares leave of 1 in proportion to
    their tokens, and shares are normalised over the values that occur. ``asked`` is the share of the
    budget, ``target`` the nearest that can be reached within the dimension: at most all that is
    there, with the surplus handed on to the dimension's other values in proportion to their shares.
    """
    n = len(wanted)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(f"d{i}").alias("value")) for i in range(n))))
    own = table.select(each.alias("own"), F.col("tokens").cast("double").alias("tokens")).groupBy("own.dim", "own.value").agg(F.sum("tokens").alias("available"))
    given, raw = F.lit(None).cast("double"), F.lit(0.0)
    whole = Window.partitionBy("dim")
    for i, want in enumerate(wanted.values()):
        if isinstance(want, dict):
            for value, share in want.items():
                given = F.when((F.col("dim") == i) & (F.col("value") == value), float(share)).otherwise(given)
    own = own.withColumn("given", given)
    spare = F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("given").over(whole), F.lit(0.0)))
    open_tokens = F.sum(F.when(F.col("given").isNull(), F.col("available"))).over(whole)
    for i, want in enumerate(wanted.values()):
        mine = F.coalesce("given", spare * F.col("available") / open_tokens) if isinstance(want, dict) else F.pow("available", F.lit(float(want)))
        raw = F.when(F.col("dim") == i, mine).otherwise(raw)
    own = own.withColumn("raw", raw).withColumn("total", F.sum("raw").over(whole))
    # Shares of zero, or of values that do not occur alone, leave nothing to give.
    own = own.select("dim", "value", "available", F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(0.0).alias("share"), (F.lit(float(budget)) * F.sum("available").over(whole)).alias("whole")).withColumn("asked", F.col("share") * F.col("whole"))
    # Where one dimension's values of a positive share hold less than the budget, that is all the others are asked for as well.
    most = own.filter("share > 0").groupBy("dim").agg(F.sum("available").alias("most")).agg(F.min("most")).first()[0] or 0.0
    own = own.withColumn("whole", F.least("whole", F.lit(float(most))))
    some = own.filter("share > 0").withColumn("level", _level(["dim"], F.col("available"), F.col("share"), F.col("whole"), ["value"]))
    filled = F.least(F.col("available"), F.max("level").over(whole) * F.col("share"))
    none = own.filter("share = 0").select("dim", "value", "available", "share", "asked", F.lit(0.0).alias("target"))
    return some.select("dim", "value", "available", "share", "asked", F.coalesce(filled, "available").alias("target")).unionByName(none)


def rake(table: DataFrame, goals: DataFrame, n_dims: int, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS, one_task_cells: int = ONE_TASK_CELLS) -> tuple[DataFrame, float]:
    """``table`` with ``weight``, and the largest gap to a target that was left.

    The expected tokens of a cell are least(tokens, weight). Only cells are handled here, no
    documents: their number depends on the values of the dimensions. Every few rounds the cells are
    written to the shared folder and the driver sees one number, the largest gap that the last
    round met. Targets that contradict each other are never met; then the last round stands.
    Cells of a value with a target of zero are left out.
    """
    dims = [f"d{i}" for i in range(n_dims)]
    fitted = table.withColumn("weight", F.col("tokens").cast("double"))
    for i in range(n_dims):
        full = F.col("target") >= F.col("available") * (1 - 1e-9)  # such values give all that they have
        own = goals.filter((F.col("dim") == i) & (F.col("target") > 0)).select(F.col("value").alias(f"d{i}"), F.col("target").alias(f"t{i}"), full.alias(f"full{i}"))
        fitted = fitted.join(own, f"d{i}")
    few = table.count() <= one_task_cells
    fitted = materialise(fitted.coalesce(1) if few else fitted, "raked")
    gap = 0.0
    for _ in range(max_steps):
        step = fitted.coalesce(1) if few else fitted
        cap, missed = F.col("tokens").cast("double"), F.lit(0.0)
        for turn in range(ROUNDS * n_dims):
            i = turn % n_dims
            value, weight, target = Window.partitionBy(f"d{i}"), F.col("weight"), F.col(f"t{i}")
            if turn >= (ROUNDS - 1) * n_dims:  # the last round's gaps
                step = step.withColumn(f"m{i}", F.abs(F.sum(F.least(cap, weight)).over(value) - target) / target)
                missed = F.greatest(missed, F.col(f"m{i}"))
            step = step.withColumn("level", _level([f"d{i}"], cap, weight, target, dims))
            step = step.withColumn("level", F.max("level").over(value))
            step = step.withColumn("weight", F.coalesce(F.when(~F.col(f"full{i}"), F.col("level") * weight), F.greatest(cap, weight))).drop("level")
        step = materialise(step.withColumn("missed", missed).drop(*(f"m{i}" for i in range(n_dims))), "raked")
        gap = step.agg(F.max("missed")).first()[0] or 0.0
        fitted = step.drop("missed")
        if gap <= tolerance:
            break
    return fitted.select(*dims, "tokens", "weight"), gap


def probabilities(fitted: DataFrame) -> DataFrame:
    """``fitted`` with ``probability``: expected tokens over tokens."""
    return fitted.withColumn("probability", F.least(F.lit(1.0), F.col("weight") / F.col("tokens")))


def reached(fitted: DataFrame, goals: DataFrame, n_dims: int) -> DataFrame:
    """(dim, value, available, share, asked, target, reached, gap): the expected tokens of each value beside what was asked for and its target; ``gap`` is what is missing or too much of ``asked``, as its share."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(f"d{i}").alias("value")) for i in range(n_dims))))
    got = fitted.select(each.alias("own"), F.least(F.col("tokens").cast("double"), F.col("weight")).alias("e")).groupBy("own.dim", "own.value").agg(F.sum("e").alias("reached"))
    out = goals.join(got, ["dim", "value"], "left").fillna(0.0, ["reached"])
    return out.withColumn("gap", F.when(F.col("asked") > 0, (F.col("reached") - F.col("asked")) / F.col("asked")).otherwise(0.0))


def calibrate(docs: DataFrame, dims: dict[str, Column], wanted: dict[str, Wanted], tokens: Column, budget: float = 0.5, strict: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Fitted cells and their targets; a gap above the tolerance is a warning, or with ``strict`` an error. ``reached`` makes the table of gaps of both."""
    table = materialise(cells(docs, dims, tokens), "cells")
    goals = materialise(targets(table, {d: wanted[d] for d in dims}, budget), "targets")
    fitted, gap = rake(table, goals, len(dims), **options)
    if gap > options.get("tolerance", TOLERANCE):
        said = f"mixing targets contradict each other or need more rounds: one is missed by {gap:.2%} of itself"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    return fitted, goals


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mix(docs: DataFrame, dims: dict[str, Column], wanted: dict[str, Wanted], tokens: Column, id_col: str = "doc_id", budget: float = 0.5, seed: str = "mix", broadcast_bytes: int = 32 << 20, **options) -> DataFrame:
    """Sampled rows of ``docs`` with their ``probability``; a column of that name in ``docs`` is replaced, all others stay.

    Null ids and null texts are drawn like others (a null text has no tokens); rows that repeat an
    id are drawn together. Documents of cells without any token are never drawn. An empty table
    gives an empty result. The cell table is broadcast up to ``broadcast_bytes`` and joined by
    shuffle beyond.
    """
    names = [free_name(docs, f"cell_{i}") for i in range(len(dims))]
    chance = free_name(docs, "chance")
    with scratch(docs.sparkSession):
        fitted, _ = calibrate(docs, dims, wanted, tokens, budget, **options)
        p = materialise(probabilities(fitted).select(*(F.col(f"d{i}").alias(n) for i, n in enumerate(names)), F.col("probability").alias(chance)), "probabilities", keep=True)
    p = broadcast_if_small(p, sum((F.octet_length(n) for n in names), F.lit(64)), broadcast_bytes)
    on = [_value(c) == F.col(n) for c, n in zip(dims.values(), names)]
    out = docs.join(p, on).filter(uniform(F.col(id_col), seed) < F.col(chance))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c != "probability"), F.col(chance).alias("probability"))


def oracle_sql(wanted: dict[str, Wanted], budget: float = 0.5, seed: str = "mix") -> str:
    """DuckDB twin of ``mix`` over documents by source, lang and topic: the same rounds as a recursion."""
    dims = list(wanted)

    def level(inner: str, part: str, cap: str, base: str, total: str, order: list[str]) -> str:
        up = f"PARTITION BY {part} ORDER BY {cap} / {base}, {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        down = f"PARTITION BY {part} ORDER BY {cap} / {base} DESC, {', '.join(f'{c} DESC' for c in order)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        return f"SELECT *, ({total} - coalesce(sum({cap}) OVER ({up}), 0)) / sum({base}) OVER ({down}) AS raw FROM ({inner})"

    step = f"SELECT *, 0::DOUBLE AS missed FROM raked WHERE round < {MAX_STEPS} AND gap > {TOLERANCE}"
    for turn in range(ROUNDS * len(dims)):
        d = dims[turn % len(dims)]
        gap = f"greatest(missed, abs(now - t_{d}) / t_{d})" if turn >= (ROUNDS - 1) * len(dims) else "missed"
        step = level(f"SELECT *, sum(least(tokens, weight)) OVER (PARTITION BY {d}) AS now FROM ({step})", d, "tokens", "weight", f"t_{d}", dims)
        step = f"SELECT *, max(CASE WHEN raw * weight <= tokens THEN raw END) OVER (PARTITION BY {d}) AS f FROM ({step})"
        step = f"SELECT {', '.join(dims)}, tokens, {', '.join(f't_{x}, full_{x}' for x in dims)}, round, coalesce(CASE WHEN NOT full_{d} THEN f * weight END, greatest(tokens, weight)) AS weight, {gap} AS missed FROM ({step})"

    def raw(d: str, want: Wanted) -> str:
        if not isinstance(want, dict):
            return f"SELECT '{d}' AS dim, {d} AS value, sum(tokens) AS available, pow(sum(tokens), {float(want)}) AS p FROM cells GROUP BY {d}"
        own = " ".join(f"WHEN '{v}' THEN {float(x)}::DOUBLE" for v, x in want.items())
        return f"""SELECT dim, value, available, coalesce(g, greatest(0, 1 - coalesce(sum(g) OVER (), 0)) * available / sum(CASE WHEN g IS NULL THEN available END) OVER ()) AS p
  FROM (SELECT '{d}' AS dim, {d} AS value, sum(tokens) AS available, CASE {d} {own} END AS g FROM cells GROUP BY {d})"""

    powers = " UNION ALL ".join(raw(d, w) for d, w in wanted.items())
    shares = f"SELECT *, p / sum(p) OVER (PARTITION BY dim) AS share, {float(budget)} * sum(available) OVER (PARTITION BY dim) AS whole FROM ({powers})"
    joins = " ".join(f"JOIN goals g_{d} ON g_{d}.dim = '{d}' AND g_{d}.value = cells.{d}" for d in dims)
    return f"""WITH RECURSIVE own AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
  CASE WHEN contains(coalesce(text, ''), 'icense') THEN 'legal' WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN contains(coalesce(text, ''), ' | ') THEN 'table' ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\x0B\\x0C]+')) AS n_tokens FROM documents),
cells AS (SELECT {', '.join(dims)}, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM own GROUP BY ALL HAVING sum(n_tokens) > 0),
goals AS (SELECT *, target >= available * (1 - 1e-9) AS full FROM (SELECT dim, value, available, coalesce(least(available, max(CASE WHEN raw * share <= available THEN raw END) OVER (PARTITION BY dim) * share), available) AS target
  FROM ({level(shares, 'dim', 'available', 'share', 'whole', ['value'])}))),
raked AS (
  SELECT {', '.join(f'cells.{d}' for d in dims)}, tokens, {', '.join(f'g_{d}.target AS t_{d}, g_{d}.full AS full_{d}' for d in dims)}, 0 AS round, tokens AS weight, 1::DOUBLE AS gap FROM cells {joins}
  UNION ALL
  SELECT {', '.join(dims)}, tokens, {', '.join(f't_{d}, full_{d}' for d in dims)}, round + 1 AS round, weight, max(missed) OVER () AS gap FROM ({step})),
last AS (SELECT * FROM raked WHERE round = (SELECT max(round) FROM raked))
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability FROM (
  SELECT own.*, least(1.0, weight / tokens) AS p FROM own JOIN last USING ({', '.join(dims)}))
WHERE CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / {float(16**13)} < p"""
