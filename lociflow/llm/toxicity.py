"""Toxicity by a classifier chain: linear models in sequence, each seeing the earlier ones' probabilities.

While training, a later model sees the out-of-fold probabilities of the earlier ones, so it learns
from the kind of probabilities that it meets when scoring. Words are letters only, lower-cased;
the vocabulary is exact (no hashing), so words that were never seen count nothing.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import materialise, scratch


#: The sample is small; with so few partitions each step of a fit is one short job of one stage.
PARTITIONS = 4


def words(text: Column) -> Column:
    """Different words of a text: runs of letters, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}]+"), lambda w: w != ""))


class ToxicityChain:
    """Fitted models of the categories, in chain order; a float stands for a constant probability."""

    def __init__(self, categories: list[str], vocabulary, models: list):
        self.categories, self.vocabulary, self.models = categories, vocabulary, models

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with one probability column ``p_<category>`` for each category.

        Columns of those names are replaced, all others stay. Null and empty texts have no words
        and get what the models give for none; rows that repeat are scored each, alike.
        """
        made = [f"p_{c}" for c in self.categories]
        kept = [c for c in docs.columns if c not in made]
        # The row travels as one struct, so that no column of it meets the names used here.
        out = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row"), words(F.col(text_col)).alias("__words"))
        out = out if self.vocabulary is None else self.vocabulary.transform(out)
        for i, (c, model) in enumerate(zip(self.categories, self.models)):
            out = _apply(out, model, [f"p_{d}" for d in self.categories[:i]], f"p_{c}")
        return out.select(*(F.col(f"__row.`{c}`") for c in kept), *made)


def _features(df: DataFrame, earlier: list[str]) -> DataFrame:
    if not earlier:
        return df.withColumn("__x", F.col("__counts"))
    return VectorAssembler(inputCols=["__counts", *earlier], outputCol="__x").transform(df)


def _apply(df: DataFrame, model, earlier: list[str], to: str) -> DataFrame:
    if isinstance(model, float):
        return df.withColumn(to, F.lit(model))
    out = model.transform(_features(df, earlier))
    return out.withColumn(to, vector_to_array("__p")[1]).drop("__x", "__p", "__raw", "__y")


def _fit(df: DataFrame, category: str, earlier: list[str], penalty: float):
    n, positive = df.agg(F.count("*"), F.sum(category)).first()
    if not n or not positive or positive == n:
        return float(positive / n) if n else 0.0
    lr = LogisticRegression(featuresCol="__x", labelCol=category, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__y", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=25, tol=1e-4)
    return lr.fit(_features(df, earlier))


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20000, folds: int = 2, vocabulary_size: int = 20000, min_docs: int = 4, penalty: float = 5e-5) -> ToxicityChain:
    """Fit the chain on the documents of at most ``max_rows`` labels, those with the smallest hashes of their ids.

    ``labels`` has the id and a 0/1 column for each category; rows where any is null are left out.
    The labels are sampled before they meet the texts, so their number is bounded and they are
    broadcast; no text is shuffled but the sample's. A category with one value only, or no rows at
    all, gets its constant share as probability. Folds follow the text's hash, so equal texts
    share one.
    """
    with scratch(docs.sparkSession):
        own = labels.select(F.col(id_col).alias("__id"), *(F.col(c).cast("double").alias(c) for c in categories)).dropna()
        own = F.broadcast(own.orderBy(F.xxhash64("__id"), "__id", *categories).limit(max_rows))
        met = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text")).join(own, F.col("__doc") == F.col("__id"))
        sample = met.select(*categories, words(F.col("__text")).alias("__words"), F.pmod(F.xxhash64("__text"), F.lit(folds)).alias("__fold")).repartition(PARTITIONS)
        sample = materialise(sample, "toxicity-sample")
        if sample.filter(F.size("__words") > 0).limit(1).count() == 0:
            n, *sums = sample.agg(F.count("*"), *(F.sum(c) for c in categories)).first()
            return ToxicityChain(categories, None, [float(s / n) if n else 0.0 for s in sums])
        least = min(min_docs, max(1, sample.count() // 50))
        vocabulary = CountVectorizer(inputCol="__words", outputCol="__counts", vocabSize=vocabulary_size, minDF=float(least)).fit(sample)
        if not vocabulary.vocabulary:
            vocabulary = CountVectorizer(inputCol="__words", outputCol="__counts", vocabSize=vocabulary_size).fit(sample)
        data, models = vocabulary.transform(sample).drop("__words").coalesce(PARTITIONS).persist(), []
        held = [data]
        for i, c in enumerate(categories):
            earlier = [f"p_{d}" for d in categories[:i]]
            models.append(_fit(data, c, earlier, penalty))
            if i + 1 < len(categories):
                parts = []
                for f in range(folds):
                    model = _fit(data.filter(F.col("__fold") != f), c, earlier, penalty)
                    parts.append(_apply(data.filter(F.col("__fold") == f), model, earlier, f"p_{c}"))
                out = parts[0]
                for p in parts[1:]:
                    out = out.unionByName(p)
                data = out.coalesce(PARTITIONS).persist()
                held.append(data)
        for frame in held:
            frame.unpersist()
        return ToxicityChain(categories, vocabulary, models)


def label_columns(labels: DataFrame) -> DataFrame:
    """Labels as categories in chain order: ``low_quality``, then ``toxic``."""
    return labels.select("doc_id", (1 - F.col("quality").cast("int")).alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))


CATEGORIES = ["low_quality", "toxic"]
THRESHOLD = 0.5
