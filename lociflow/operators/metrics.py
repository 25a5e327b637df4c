"""Classification metrics as DataFrames: scores are summed up by value before any window runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.operators.ranges import running_sums


def accuracy(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))


def balanced_accuracy(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean recall over the classes that occur."""
    own = df.groupBy(*(keys or []), "y").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("r"))
    return own.groupBy(*(keys or [])).agg(F.avg("r").alias("balanced_accuracy"))


def confusion(df: DataFrame, classes: list[int]) -> DataFrame:
    """(y, one column for each predicted class): counts, 0 where a pair does not occur."""
    own = df.groupBy("y").pivot("pred", classes).count().na.fill(0)
    return own.select("y", *(F.col(str(c)).alias(f"pred_{c}") for c in classes))


def _steps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts at each different score of a key and above it; the sums run over ranges of scores, so a key may hold most rows."""
    own = df.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.count_if(F.col("hit")).alias("tp")).withColumn("__falling", -F.col("score"))
    own = running_sums(own, keys, ["__falling"], {"cum_n": "n", "cum_tp": "tp"}, {"positives": "tp"}).drop("__falling")
    return own.withColumn("precision", F.col("cum_tp") / F.col("cum_n")).withColumn("recall", F.when(F.col("positives") > 0, F.col("cum_tp") / F.col("positives")).otherwise(0.0))


def pr_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, precision, recall) at each different score; rows have score and hit."""
    return _steps(df, keys).select(*keys, "score", "precision", "recall")


def one_against_rest(df: DataFrame, probs: dict[int, str]) -> DataFrame:
    """(cls, score, hit) of each row for each class and for ``micro``, the pool of all."""
    each = df.select(F.explode(F.array(*(F.struct(F.lit(str(c)).alias("cls"), F.col(p).cast("double").alias("score"), (F.col("y") == c).alias("hit")) for c, p in probs.items()))).alias("x")).select("x.*")
    return each.unionByName(each.withColumn("cls", F.lit("micro")))


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of recall steps times precision over different scores, high to low."""
    step = F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0)
    return _steps(df, keys).groupBy(*keys).agg(F.sum(step * F.col("precision")).alias("average_precision"))


def f1_weighted(df: DataFrame) -> DataFrame:
    """One row: F1 of each class, averaged by the classes' rows."""
    true, pred = df.groupBy(F.col("y").alias("c")).agg(F.count("*").alias("n"), F.count_if(F.col("y") == F.col("pred")).alias("tp")), df.groupBy(F.col("pred").alias("c")).agg(F.count("*").alias("p"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n") + F.coalesce("p", F.lit(0)))).otherwise(0.0)
    return true.join(pred, "c", "left").agg((F.sum(f1 * F.col("n")) / F.sum("n")).alias("f1_weighted"))


def fold_means(df: DataFrame, params: list[str], metric: str) -> DataFrame:
    """(params, mean) over folds, best first marked by ``best``; the first parameters in order win ties."""
    own = df.groupBy(*params).agg(F.avg(metric).alias("mean"))
    top = own.agg(F.max("mean")).first()[0]
    first = own.filter(F.col("mean") == F.lit(top)).orderBy(*params).limit(1).withColumn("best", F.lit(True)).select(*params, "best")
    return own.join(F.broadcast(first), params, "left").fillna(False, ["best"])
