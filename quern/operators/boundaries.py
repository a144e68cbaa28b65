"""Sentence ends against marked ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _ends(lines: Column) -> Column:
    """Ends (exclusive) of all lines but the last in the text that joins them by one space."""
    step = lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)) + 1, F.lit(0)) + F.length(x)))
    ends = F.aggregate(lines, F.array().cast("array<int>"), step)
    return F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0)))


def against_gold(blocks: DataFrame) -> DataFrame:
    """sample, tp, fp and fn of every block; null where the rule's sentences don't lie in the text.

    blocks: sample and lines, the marked sentences in order.
    """
    lines = F.filter(F.transform("lines", lambda x: T.strip(T.without_timestamps(x))), lambda x: x != "")
    rows = blocks.select("sample", lines.alias("lines")).withColumn("text", F.array_join("lines", " "))
    rows = rows.select("sample", _ends(F.col("lines")).alias("gold"), T.boundaries(F.col("text")).alias("b"), F.size(T.sentences(F.col("text"))).alias("n"))
    said = F.transform(F.slice("b", F.lit(1), F.greatest(F.size("b") - 1, F.lit(0))), lambda x: x + 1)
    rows = rows.select("sample", "gold", F.when(F.size("b") == F.col("n"), said).alias("said"))
    count = lambda x: F.when(F.col("said").isNotNull(), F.size(x).cast("long"))
    return rows.select(
        "sample", count(F.array_intersect("gold", "said")).alias("tp"), count(F.array_except("said", "gold")).alias("fp"),
        count(F.array_except("gold", "said")).alias("fn"),
    )


def totals(counts: DataFrame) -> DataFrame:
    """samples, tp, fp, fn, precision, recall and f1 over all blocks; 0 where nothing can be divided."""
    t = counts.agg(F.count(F.lit(1)).alias("samples"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return t.select(
        "samples", "tp", "fp", "fn", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"),
        div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
