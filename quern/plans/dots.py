"""Queries on dots and sentence ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dots as D
from ..operators import learning as L
from .registry import query, table

_D = """
WITH r AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations),
d AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS p FROM r),
x AS (SELECT doc_id, p - 1 AS i, text, text[p - 1:p - 1] AS c, text[p + 1:p + 1] AS n, left(text, p - 1) AS bef, text[p + 1:] AS aft FROM d WHERE text[p:p] = '.')
"""


def _docs(spark, sf):
    rows = table(spark, sf, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


@query(
    "dot_features",
    f"""{_D} SELECT doc_id, i, CASE WHEN i = 0 THEN '<BOS>' ELSE c END AS prev_char, CASE WHEN aft = '' THEN '<EOS>' ELSE n END AS next_char,
        regexp_matches(c, '^\\p{{Nd}}$')::int AS prev_is_digit, regexp_matches(n, '^\\p{{Nd}}$')::int AS next_is_digit,
        CASE WHEN regexp_extract(bef, '(\\p{{L}}*)\\s*$', 1) = '' THEN '<NONE>' ELSE lower(regexp_extract(bef, '(\\p{{L}}*)\\s*$', 1)) END AS prev_word,
        CASE WHEN regexp_extract(aft, '^\\s*(\\p{{L}}*)', 1) = '' THEN '<NONE>' ELSE lower(regexp_extract(aft, '^\\s*(\\p{{L}}*)', 1)) END AS next_word,
        regexp_matches(aft, '^[\\s"''”»)\\]}}]*\\p{{Lu}}')::int AS next_token_upper FROM x""",
)
def dot_features(spark, sf):
    names = ("prev_char", "next_char", "prev_is_digit", "next_is_digit", "prev_word", "next_word", "next_token_upper")
    return D.examples(_docs(spark, sf)).select("doc_id", "i", *names)


@query("dot_labels")
def dot_labels(spark, sf):
    return D.examples(_docs(spark, sf)).select("doc_id", "i", "y", D.vetoed(F.col("y")).alias("kept"), "snippet")


INPUTS = [
    "prev_char", "prev2_char", "next_char", "next2_char", "prev_is_digit", "next_is_digit", "prev_is_upper", "next_is_upper", "next_is_space",
    "next_is_closing", "prev_word", "next_word", "prev_word_len", "next_word_len", "prev_single_upper", "next_token_upper", "is_decimal", "is_short",
]


def _fitted(spark, sf):
    rows = D.examples(_docs(spark, sf)).withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)))
    rows = rows.persist()
    model = L.dot_classifier(rows.where("fold < 8"), INPUTS)
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("p", vector_to_array("probability")[1])


@query("dot_lr")
def dot_lr(spark, sf):
    found = _fitted(spark, sf)
    return L.binary_metrics(found.where("fold = 9").withColumn("prediction", D.vetoed(F.col("prediction").cast("int"))))


@query("dot_threshold")
def dot_threshold(spark, sf):
    return L.best_threshold(_fitted(spark, sf).where("fold = 8"))


@query("dot_sentences")
def dot_sentences(spark, sf):
    found = _fitted(spark, sf).withColumn("prediction", D.vetoed((F.col("p") >= 0.5).cast("int")))
    return D.cut(_docs(spark, sf), found.select("doc_id", "i", "prediction"))
