"""Subword queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import subwords as B
from .corpus import WORDS_SQL, word_rows
from .registry import query

_VOC = f"""
WITH RECURSIVE c AS (SELECT w AS word, count(*) AS cnt FROM (SELECT unnest({WORDS_SQL}) AS w FROM documents) GROUP BY w),
v AS (SELECT array_to_string(list_append(string_split(word, ''), '</w>'), ' ') AS sym, cnt FROM c)
"""


def _pairs(rows: str) -> str:
    return f"""SELECT a, b, sum(cnt)::bigint AS cnt FROM (SELECT s[i] AS a, s[i + 1] AS b, cnt FROM
      (SELECT s, cnt, unnest(range(1, len(s))) AS i FROM (SELECT string_split(sym, ' ') AS s, cnt FROM {rows}))) GROUP BY a, b"""


def _chain(n: int) -> str:
    out = []
    for k in range(n):
        src = "v" if k == 0 else f"v{k}"
        out.append(f"b{k + 1} AS MATERIALIZED (SELECT * FROM ({_pairs(src)}) ORDER BY cnt DESC, a, b LIMIT 1)")
        out.append(f"v{k + 1} AS MATERIALIZED (SELECT replace(sym, b.a || ' ' || b.b, b.a || b.b) AS sym, {src}.cnt FROM {src}, b{k + 1} b)")
    return ", ".join(out)


def vocabulary(spark, sf):
    """Persisted, as every use of it would read the texts again."""
    return C.frequencies(word_rows(spark, sf), "word").persist()


@query("bpe_pairs", f"{_VOC} {_pairs('v')}")
def bpe_pairs(spark, sf):
    return B.pair_counts(B.start(vocabulary(spark, sf)))


@query(
    "bpe_merges_10",
    f"{_VOC}, {_chain(10)} " + " UNION ALL ".join(f"SELECT {k} AS rank, a, b, cnt FROM b{k}" for k in range(1, 11)),
)
def bpe_merges_10(spark, sf):
    made = B.train(vocabulary(spark, sf), 10)
    return spark.createDataFrame([(k + 1, *m) for k, m in enumerate(made)], "rank int, a string, b string, cnt long")


@query("bpe_segment")
def bpe_segment(spark, sf):
    words = vocabulary(spark, sf)
    return B.apply(words.where(F.length("word").between(6, 14)), B.train(words, 20))
