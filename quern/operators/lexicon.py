"""Sentiment scores of texts from a lexicon of valences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The constant of the published normalisation of summed valences.
NORMAL = 15.0


def scores(words: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """pos, neg, neu and compound of every text.

    words: ``key`` and word; lexicon: word and valence, a list of chosen size
    that is sent to the tasks, so only a text's sums are shuffled. A word outside
    the lexicon is neutral; a valence weighs one more than its size.
    """
    rows = words.join(F.broadcast(lexicon.select("word", "valence")), "word", "left").withColumn("v", F.coalesce("valence", F.lit(0.0)))
    n, v = F.lit(1), F.col("v")
    sums = rows.groupBy(key).agg(
        F.sum(F.when(v > 0, n * (v + 1)).otherwise(0.0)).alias("p"),
        F.sum(F.when(v < 0, n * (1 - v)).otherwise(0.0)).alias("m"),
        F.sum(F.when(v == 0, n).otherwise(0)).alias("z"),
        F.sum(n * v).alias("s"),
    )
    total = F.col("p") + F.col("m") + F.col("z")
    return sums.select(
        key, (F.col("p") / total).alias("pos"), (F.col("m") / total).alias("neg"), (F.col("z") / total).alias("neu"),
        (F.col("s") / F.sqrt(F.col("s") * F.col("s") + NORMAL)).alias("compound"),
    )
