"""Datasets for training: labels, weights, folds, hold-outs, and checks against leakage.

Rows have an id, ``ord`` (their order), and where needed sample, chrom, bin and label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.operators.ranges import ranked, running_sums


def encode_label(label: Column, svtype: str = "DEL") -> Column:
    """0 for the type, 1 for its absence, null for other labels."""
    return F.when(label == svtype, 0).when(label == f"no{svtype}", 1)


def known_labels(df: DataFrame, svtype: str = "DEL") -> DataFrame:
    return df.filter(F.col("label").isin(svtype, f"no{svtype}"))


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """``df`` with ``weight`` n / (k * n_class); class counts are joined, not windowed."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    n, k = counts.agg(F.sum("__n"), F.count("*")).first()
    return df.join(F.broadcast(counts), label).withColumn("weight", F.lit(n or 0) / (F.lit(k) * F.col("__n"))).drop("__n")


def numbered(df: DataFrame, order: list[str], to: str = "rank") -> DataFrame:
    """``df`` with 1-based ranks by a global sort: ranks within ranges plus the counts before them."""
    return ranked(df, [], order, to)


def fold_of(rank: Column, n: int, k: int) -> Column:
    """Fold 0 to k - 1 of a 1-based rank: contiguous folds, the first ``n % k`` one row larger."""
    small, larger = n // k, n % k
    border = larger * (small + 1)
    return F.when(rank <= border, F.floor((rank - 1) / (small + 1))).otherwise(larger + F.floor((rank - 1 - border) / max(small, 1))).cast("int")


def kfold_contiguous(df: DataFrame, k: int, order: str = "ord") -> DataFrame:
    n = df.count()
    return numbered(df, [order]).withColumn("fold", fold_of(F.col("rank"), n, k)).drop("rank")


def shuffle_key(id_col: str, seed: int) -> Column:
    return F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))


def kfold_stratified(df: DataFrame, k: int, id_col: str, label: str = "label", seed: int = 0) -> DataFrame:
    """Folds of equal label shares: rows of a label in hashed order are dealt out in turn.

    The order is cut into hash ranges, so a large class is not ranked in one task.
    """
    key = shuffle_key(id_col, seed)
    own = df.withColumn("__h", key).withColumn("__k", F.floor(F.col("__h") / (1 << 22)))
    counts = own.groupBy(label, "__k").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__c").over(Window.partitionBy(label).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    inside = F.row_number().over(Window.partitionBy(label, "__k").orderBy("__h", id_col))
    return own.withColumn("__i", inside).join(before, [label, "__k"]).withColumn("fold", F.pmod(F.col("__b") + F.col("__i") - 1, F.lit(k)).cast("int")).drop("__h", "__k", "__i", "__b")


def holdout_stratified(df: DataFrame, id_col: str, label: str = "label", test_tenths: int = 3, seed: int = 0) -> DataFrame:
    """``df`` with ``test``: of each label, three of ten rows in hashed order."""
    return kfold_stratified(df, 10, id_col, label, seed).withColumn("test", F.col("fold") < test_tenths).drop("fold")


def tail_validation(df: DataFrame, share: float = 0.3, order: str = "ord") -> DataFrame:
    """``df`` with ``validation``: the last share in order."""
    first = int(df.count() * (1 - share))
    return numbered(df, [order]).withColumn("validation", F.col("rank") > first).drop("rank")


def leave_out(df: DataFrame, column: str, value: str) -> DataFrame:
    """``df`` with ``part``: ``test`` for the value, else ``train``."""
    return df.withColumn("part", F.when(F.col(column) == value, "test").otherwise("train"))


def leave_sample_out(df: DataFrame, sample: str, without_chrom: str | None = None) -> DataFrame:
    """Training rows of the other samples, also without one chromosome if it is given."""
    own = df.filter(F.col("sample") != sample)
    return own.filter(F.col("chrom") != without_chrom) if without_chrom is not None else own


def leave_group_out(df: DataFrame, sample: str, column: str, test: list, validation: list, compat: bool = False) -> DataFrame:
    """``df`` with ``part`` for a sample and values of chrom or bin; rows of no part are left out.

    Training rows are of other samples and of neither the test nor the validation values; with
    ``compat`` those of the validation values stay in training.
    """
    own, at = F.col("sample") == sample, F.col(column)
    train = ~own & ~at.isin(test)
    if not compat:
        train = train & ~at.isin(validation)
    return df.withColumn("part", F.when(own & at.isin(test), "test").when(own & at.isin(validation), "validation").when(train, "train")).filter("part is not null")


def genomic_bins(df: DataFrame, bins: int = 3, pos: str = "pos") -> DataFrame:
    """``df`` with ``bin``: each chromosome cut into bins of equal counts, numbered on over chromosomes in text order.

    Equal positions all take the later bin.
    """
    at = df.groupBy("chrom", pos).agg(F.count("*").alias("__c"))
    summed = running_sums(at, ["chrom"], [pos], {"__r": "__c"}, {"__n": "__c"})
    order = df.select("chrom").distinct().withColumn("__d", F.row_number().over(Window.orderBy("chrom")) - 1)  # one row a chromosome
    small, larger = F.floor(F.col("__n") / bins), F.col("__n") % bins
    border, r = larger * (small + 1), F.col("__r")
    own = F.when(r <= border, F.floor((r - 1) / (small + 1))).otherwise(larger + F.floor((r - 1 - border) / F.greatest(small, F.lit(1))))
    placed = summed.join(F.broadcast(order), "chrom").withColumn("bin", (F.col("__d") * bins + own).cast("int")).select("chrom", pos, "bin")
    return df.join(placed, ["chrom", pos])


def check_split(parts: DataFrame, sample: str, column: str, test: list) -> DataFrame:
    """One row of checks: counts by part, and how many rows leak between test and training."""
    own = F.col("sample") == sample
    return parts.agg(
        F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "test").alias("test"), F.count_if(F.col("part") == "validation").alias("validation"),
        F.count_if((F.col("part") == "train") & (own | F.col(column).isin(test))).alias("leaks"), F.count_if((F.col("part") == "test") & ~(own & F.col(column).isin(test))).alias("impure"),
    )


def assert_split(parts: DataFrame, sample: str, column: str, test: list) -> DataFrame:
    """``check_split``, failing when it is run if a part is empty or rows leak."""
    ok = F.expr("train > 0 and test > 0 and leaks = 0 and impure = 0")
    return check_split(parts, sample, column, test).filter(F.when(ok, True).otherwise(F.raise_error(F.lit("the split leaks or has an empty part")).cast("boolean")))


def combine_samples(parts: dict[str, DataFrame]) -> DataFrame:
    """All samples' rows with a ``sample`` column; samples must have the same columns."""
    out = None
    for name, df in parts.items():
        own = df.withColumn("sample", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out
