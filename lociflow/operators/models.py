"""Weighted binary classifiers on window features: fit, search, nested folds, scores.

A single model is one of ``pyspark.ml``. Searches and folds fit all their models together: a pass over
the rows adds up the gradients and curvatures of every model, so the number of passes does not depend
on how many there are.

Rows have y (0 for the type), weight, and a vector column ``features``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pooled_features(sparse: DataFrame, rows: int = 35, width: int = 256, pools: int = 8) -> DataFrame:
    """(sv_id, features): channel sums over ``pools`` stretches of the window, from the sparse tensor; its cells may come in parts.

    Cells are dealt out by candidate once, as narrow rows, for their sums and for the vectors.
    """
    k = (F.col("channel") * pools + F.floor(F.col("offset") * pools / width)).cast("int")
    own = sparse.select("sv_id", k.alias("k"), "value").repartition("sv_id").groupBy("sv_id").pivot("k", list(range(rows * pools))).agg(F.sum("value").cast("double"))
    return own.select("sv_id", array_to_vector(F.array(*(F.coalesce(F.col(str(i)), F.lit(0.0)) for i in range(rows * pools)))).alias("features"))


def train(df: DataFrame, params: dict | None = None):
    """A weighted logistic regression; ``params`` are its keywords."""
    return LogisticRegression(labelCol="y", featuresCol="features", weightCol="weight", **({"maxIter": 20, "regParam": 0.01} | (params or {}))).fit(df)


def score(model, df: DataFrame) -> DataFrame:
    """``df`` with ``p_sv``, the probability of class 0, and ``pred``, the likelier class."""
    out = model.transform(df)
    return out.withColumn("p_sv", vector_to_array("probability")[0]).withColumn("pred", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "prediction")


@dataclass
class Spec:
    """One model of a batch: the rows it is fitted without, as (column, value), and its parameters.

    Parameters are ``reg_param`` (ridge penalty), ``weight_power`` (of the class weights; 0: none),
    ``fit_intercept``, ``standardize`` (the penalty sees features of unit spread) and ``threshold``
    (probability of class 1 from which on it is predicted).
    """

    without: tuple[tuple[str, object], ...] = ()
    reg_param: float = 0.01
    weight_power: float = 1.0
    fit_intercept: bool = True
    standardize: bool = True
    threshold: float = 0.5
    beta: np.ndarray | None = field(default=None, compare=False)  # intercept first
    settled: bool = field(default=False, compare=False)


def _sums(df: DataFrame, specs: list[Spec], of: Callable[[np.ndarray, np.ndarray, np.ndarray, Spec], np.ndarray], used: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Per spec the sum over its rows of what ``of`` (features with a leading one, y, weight) gives for a batch of rows; one pass over ``df``.

    Each task adds up its rows for all specs; tasks' sums are added in two steps. The driver gets one
    array a spec. Specs with equal exclusions share their rows; ``used`` gives the features that ``of``
    sees, by place, all without.
    """
    columns = sorted({c for s in specs for c, _ in s.without})
    given = df.select("y", "weight", vector_to_array("features").alias("x"), *(F.col(c).alias(f"by_{c}") for c in columns))

    alike: dict[tuple, list[int]] = {}
    for i, spec in enumerate(specs):
        alike.setdefault(spec.without, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.column_stack([np.ones(n), batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)])
            x = x if used is None else x[:, used]
            y, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("y", "weight"))
            by = {c: batch.column(f"by_{c}").to_pandas().to_numpy() for c in columns}
            for without, own in alike.items():
                mine = np.logical_and.reduce([np.ones(n, bool), *(by[c] != v for c, v in without)])
                if mine.any():
                    rows = x[mine], y[mine], w[mine]
                    for i in own:
                        got = of(*rows, specs[i])
                        held[i] = held[i] + got if i in held else got
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([part % 64] * len(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["spec", "part", "v"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"spec": [frame["spec"].iloc[0]], "part": [frame["part"].iloc[0]], "v": [np.sum(np.stack(frame["v"].to_numpy()), axis=0).tolist()]})

    kind = "spec int, part int, v array<double>"
    each = given.mapInArrow(run, kind).groupBy("spec", "part").applyInPandas(add, kind).groupBy("spec").applyInPandas(add, kind)
    return {r["spec"]: np.array(r["v"]) for r in each.collect()}


def _weights(w: np.ndarray, spec: Spec) -> np.ndarray:
    return w**spec.weight_power


def _moments(x: np.ndarray, y: np.ndarray, w: np.ndarray, spec: Spec) -> np.ndarray:
    w = _weights(w, spec)
    return np.concatenate([[w.sum(), (w * w).sum()], w @ x, w @ (x * x)])


def _curvature(x: np.ndarray, y: np.ndarray, w: np.ndarray, spec: Spec) -> np.ndarray:
    """Gradient, and the matrix of second derivatives, of the weighted loss."""
    w, p = _weights(w, spec), 1 / (1 + np.exp(-np.clip(x @ spec.beta, -500, 500)))
    return np.concatenate([x.T @ (w * (p - y)), ((x.T * (w * p * (1 - p))) @ x).ravel()])


def fit_many(df: DataFrame, specs: list[Spec], steps: int = 25, tolerance: float = 1e-10) -> list[Spec]:
    """Fit all specs together by Newton steps, one pass over ``df`` a step however many there are; ``beta`` is set on each.

    The loss is the weighted mean log loss plus half the penalty times the squared coefficients
    (of unit-spread features if ``standardize``), without the intercept. Features without any spread
    get zero and are in no gradient or curvature. A fit goes on where an earlier
    call left it. Specs without rows get zeros. ``df`` has y, weight, features and the columns that
    ``without`` names; it is read ``steps`` + 1 times at most, so persist it or write it before.
    """
    todo = [s for s in specs if not s.settled]
    if not todo:
        return specs
    moments = _sums(df, todo, _moments)
    size = next((len(v) for v in moments.values()), 2) // 2 - 1
    total, spread = {}, {}
    for i, s in enumerate(todo):
        if s.beta is None:
            s.beta = np.zeros(size)
        if i not in moments:
            s.settled = True
            continue
        w1, w2, mean, square = moments[i][0], moments[i][1], moments[i][2 : 2 + size] / moments[i][0], moments[i][2 + size :]
        var = np.maximum((square - w1 * mean * mean) / max(w1 - w2 / w1, 1e-300), 0)
        total[i], spread[i] = w1, np.where(var > 1e-12 * np.maximum(mean * mean, 1e-300), var, 0)
    for _ in range(steps):
        own = [(i, s) for i, s in enumerate(todo) if not s.settled]
        if not own:
            break
        used = np.flatnonzero(np.logical_or.reduce([np.arange(size) == 0, *(spread[i] > 0 for i, _ in own), *(s.beta != 0 for _, s in own)]))
        sums = _sums(df, [replace(s, beta=s.beta[used]) for _, s in own], _curvature, used)
        for k, (i, s) in enumerate(own):
            grad, curve = sums[k][: len(used)] / total[i], sums[k][len(used) :].reshape(len(used), -1) / total[i]
            ridge = s.reg_param * (spread[i][used] if s.standardize else np.ones(len(used)))
            ridge[0] = 0
            free = spread[i][used] > 0
            free[0] = s.fit_intercept
            grad, curve = (grad + ridge * s.beta[used])[free], (curve + np.diag(ridge))[np.ix_(free, free)]
            move = np.linalg.lstsq(curve, -grad, rcond=None)[0]
            s.beta[used[free]] += move
            s.settled = bool(np.abs(move).max(initial=0) < tolerance)
    return specs


def balanced_accuracies(df: DataFrame, specs: list[Spec], held: list[tuple[str, object]]) -> list[float]:
    """Of each spec, the mean recall of both classes over the rows with its (column, value) of ``held`` that its other exclusions leave; one pass."""
    def counts(x: np.ndarray, y: np.ndarray, w: np.ndarray, spec: Spec) -> np.ndarray:
        right = ((1 / (1 + np.exp(-np.clip(x @ spec.beta, -500, 500)))) > spec.threshold) == (y == 1)
        return np.array([np.sum(y == c) for c in (0, 1)] + [np.sum(right & (y == c)) for c in (0, 1)], float)

    # A spec's rows are those it leaves in; the wanted ones are all those less the ones without them.
    used = np.flatnonzero(np.logical_or.reduce([np.arange(len(specs[0].beta)) == 0, *(s.beta != 0 for s in specs)]))
    own = [replace(s, beta=s.beta[used]) for s in specs]
    wide = [replace(s, without=tuple(e for e in s.without if e != h)) for s, h in zip(own, held)]
    all_rows, rest = _sums(df, wide, counts, used), _sums(df, own, counts, used)
    out = []
    for i in range(len(specs)):
        n0, n1, r0, r1 = all_rows.get(i, np.zeros(4)) - rest.get(i, np.zeros(4))
        recalls = [r / n for r, n in ((r0, n0), (r1, n1)) if n]
        out.append(float(np.mean(recalls)) if recalls else 0.0)
    return out


def _combinations(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def search(df: DataFrame, grid: dict[str, list], fold: str = "fold", without: list[tuple] = [()], rung: int = 2, keep: int = 0) -> list[list[dict]]:
    """For each exclusion of ``without`` all parameters with their mean balanced accuracy over the folds, best first.

    All exclusions, parameters and folds are fitted together, all of them to the end. Only with ``keep``
    set the worse half of an exclusion's parameters is left as it stands after every ``rung`` steps,
    until ``keep`` are left, which are fitted to the end. Rows are dicts of the parameters, ``mean`` and ``finished``;
    of equals the earlier in the grid is better.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())  # few
    combos = _combinations(grid)
    specs = {(o, c, f): Spec((*out, (fold, f)), **combo) for o, out in enumerate(without) for c, combo in enumerate(combos) for f in folds}
    open_ones = {o: list(range(len(combos))) for o in range(len(without))}
    means: dict[tuple[int, int], float] = {}

    def measure(finished: bool) -> None:
        own = [(o, c, f) for o in open_ones for c in open_ones[o] for f in folds]
        if not own:
            return
        got = balanced_accuracies(df, [specs[k] for k in own], [(fold, f) for _, _, f in own])
        for o, c in {k[:2] for k in own}:
            means[o, c] = sum(g for g, k in zip(got, own) if k[:2] == (o, c)) / len(folds)

    while keep and any(len(v) > keep for v in open_ones.values()):
        fit_many(df, [specs[o, c, f] for o in open_ones for c in open_ones[o] for f in folds], steps=rung)
        measure(False)
        for o, own in open_ones.items():
            if len(own) > keep:
                open_ones[o] = sorted(sorted(own, key=lambda c: (-means[o, c], c))[: max(keep, -(-len(own) // 2))])
    fit_many(df, [specs[o, c, f] for o in open_ones for c in open_ones[o] for f in folds])
    measure(True)
    out = []
    for o in range(len(without)):
        rows = [combo | {"mean": means[o, c], "finished": c in open_ones[o]} for c, combo in enumerate(combos)]
        out.append(sorted(rows, key=lambda r: (not r["finished"], -r["mean"])))
    return out


def param_search(df: DataFrame, grid: dict[str, list], fold: str = "fold", **options) -> tuple[dict, list[dict]]:
    """Best parameters by mean balanced accuracy over the folds, and all rows of ``search``."""
    rows = search(df, grid, fold, **options)[0]
    return {k: rows[0][k] for k in grid}, rows


def score_without(df: DataFrame, column: str, specs: dict) -> DataFrame:
    """``df`` with ``p_sv`` and ``pred`` by the spec of each row's value of ``column``; one row a value is broadcast."""
    kind = df.schema[column].dataType.simpleString()
    rows = [(v, float(s.beta[0]), [float(b) for b in s.beta[1:]], float(s.threshold)) for v, s in specs.items()]
    table = df.sparkSession.createDataFrame(rows, f"__value {kind}, __at double, __beta array<double>, __limit double")
    met = df.join(F.broadcast(table), F.col(column) == F.col("__value"))
    eta = F.aggregate(F.zip_with(vector_to_array("features"), F.col("__beta"), lambda x, b: x * b), F.col("__at"), lambda a, x: a + x)
    p = 1 / (1 + F.exp(-eta))
    return met.withColumn("p_sv", 1 - p).withColumn("pred", (p > F.col("__limit")).cast("int")).drop("__value", "__at", "__beta", "__limit")


def nested_cv(df: DataFrame, outer: str, grid: dict[str, list], inner: str = "fold", **options) -> DataFrame:
    """Held-out scores of every row: for each outer value, search on the rest's inner folds, fit, predict; all outer values together."""
    values = sorted(r[0] for r in df.select(outer).distinct().collect())  # chromosomes, samples
    found = search(df, grid, inner, [((outer, v),) for v in values], **options)
    specs = {v: Spec(((outer, v),), **{k: rows[0][k] for k in grid}) for v, rows in zip(values, found)}
    fit_many(df, list(specs.values()))
    return score_without(df, outer, specs)


def score_grouped(df: DataFrame, column: str, params: dict | None = None) -> DataFrame:
    """Each value's rows scored by the model of all other values, fitted together."""
    specs = {v: Spec(((column, v),), **(params or {})) for v in sorted(r[0] for r in df.select(column).distinct().collect())}
    fit_many(df, list(specs.values()))
    return score_without(df, column, specs)


def collect_scores(parts: DataFrame, key: str, order: str) -> DataFrame:
    """One score by key over all parts; the last by ``order`` wins."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return parts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
