"""Labels, metrics, thresholds, significance and trained models."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import CountVectorizer, FeatureHasher, StringIndexer, Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (classes x rows of the class); one row a class."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    return sizes.crossJoin(F.broadcast(total)).select(label, "n", (F.col("all") / (F.col("k") * F.greatest("n", F.lit(1)))).alias("weight"))


def binary_metrics(rows: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """n, accuracy, precision, recall and f1; 0 where nothing can be divided."""
    a, b = F.col(y) == 1, F.col(p) == 1
    t = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"),
        F.count_if(a & ~b).alias("fn"), F.count_if(F.col(y) == F.col(p)).alias("right"),
    )
    div = lambda x, z: F.coalesce(F.try_divide(x, z), F.lit(0.0))
    precision, recall = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.select("n", div(F.col("right"), F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), div(2 * precision * recall, precision + recall).alias("f1"))


def class_metrics(rows: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """label, support, precision, recall and f1 over all labels of either column."""
    each = F.explode(F.array_distinct(F.array(F.col(y), F.col(p)))).alias("label")
    t = rows.select(each, F.col(y).alias("y"), F.col(p).alias("p")).groupBy("label").agg(
        F.count_if((F.col("y") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"),
        F.count_if(F.col("p") == F.col("label")).alias("said"),
        F.count_if(F.col("y") == F.col("label")).alias("support"),
    )
    div = lambda x, z: F.coalesce(F.try_divide(x, z), F.lit(0.0))
    precision, recall = div(F.col("tp"), F.col("said")), div(F.col("tp"), F.col("support"))
    return t.select("label", "support", "tp", precision.alias("precision"), recall.alias("recall"), div(2 * precision * recall, precision + recall).alias("f1"))


def multiclass_metrics(rows: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    c = class_metrics(rows, y, p)
    weighted = lambda x: (F.sum(F.col(x) * F.col("support")) / F.sum("support")).alias(f"weighted_{x}")
    names = ("precision", "recall", "f1")
    return c.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *(F.avg(x).alias(f"macro_{x}") for x in names), *map(weighted, names))


def best_threshold(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """The first threshold of .30, .35 ... .90 with the best F1."""
    grid = F.explode(F.transform(F.sequence(F.lit(6), F.lit(18)), lambda k: F.round(k * 0.05, 2))).alias("t")
    t = rows.select(F.col(y).alias("y"), F.col(p).alias("p"), grid).groupBy("t").agg(
        F.count_if((F.col("y") == 1) & (F.col("p") >= F.col("t"))).alias("tp"),
        F.count_if((F.col("y") != 1) & (F.col("p") >= F.col("t"))).alias("fp"),
        F.count_if((F.col("y") == 1) & (F.col("p") < F.col("t"))).alias("fn"),
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return t.select("t", F.round(f1, 4).alias("f1")).orderBy(F.desc("f1"), "t").limit(1)


def paired(rows: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Two classifiers' discordant counts and the t statistic of their correctness."""
    d = F.when(F.col(a) == F.col(y), 1.0).otherwise(0.0) - F.when(F.col(b) == F.col(y), 1.0).otherwise(0.0)
    t = rows.select(d.alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("only_a"), F.count_if(F.col("d") < 0).alias("only_b"),
        F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"),
    )
    return t.select("n", "only_a", "only_b", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def mcnemar(only_a: int, only_b: int) -> float:
    """Exact two-sided binomial p-value of the discordant counts."""
    n, k = only_a + only_b, min(only_a, only_b)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * sum(map(math.exp, logs))) if n else 1.0


def nb_counts(docs: DataFrame) -> DataFrame:
    """label, word, cnt and docs: what a naive Bayes model is made of. docs: label and words, an array; a row a document.

    A document gives each word as often as it stands, and once more for the document.
    """
    mark = lambda words, m: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(m).alias("m")))
    each = F.inline(F.concat(mark(F.col("words"), 0), mark(F.array_distinct("words"), 1)))
    rows = docs.select("label", each).groupBy("label", "word")
    return rows.agg(F.sum(1 - F.col("m")).alias("cnt"), F.sum("m").alias("docs"))


def bag_classifier(rows: DataFrame, kind: str = "logistic", vocabulary: int = 1000) -> PipelineModel:
    """Count vectors of ``words`` and a classifier of the text column ``label``.

    kind: logistic (balanced if there is a column weight), multinomial or bernoulli.
    """
    steps = [
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep"),
        CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary, binary=kind == "bernoulli"),
    ]
    if kind == "logistic":
        weight = {"weightCol": "weight"} if "weight" in rows.columns else {}
        steps.append(LogisticRegression(labelCol="y", regParam=0.01, maxIter=50, family="multinomial", **weight))
    else:
        steps.append(NaiveBayes(labelCol="y", modelType=kind))
    return Pipeline(stages=steps).fit(rows)


def dot_classifier(rows: DataFrame, inputs: list[str], l1: bool = False, n: int | None = None) -> PipelineModel:
    """Logistic regression on hashed features; C = 1."""
    n = n or rows.count()
    model = LogisticRegression(labelCol="y", regParam=1 / max(n, 1), elasticNetParam=float(l1), standardization=False, maxIter=50)
    return Pipeline(stages=[FeatureHasher(inputCols=inputs, outputCol="features", numFeatures=1 << 14), model]).fit(rows)


PART_WORDS = 2_000_000


def word_vectors(sentences: DataFrame, size: int = 100, window: int = 5, min_count: int = 3, epochs: int = 15, seed: int = 42):
    """Skip-gram vectors (hierarchical softmax) of the column ``words``.

    Each part of about ``PART_WORDS`` words learns from the common vectors in every epoch; a
    word's vectors are then averaged over the parts that have it.
    """
    tokens = sentences.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    return Word2Vec(
        numPartitions=max(1, -(-tokens // PART_WORDS)), vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, inputCol="words", outputCol="vec"
    ).fit(sentences)
