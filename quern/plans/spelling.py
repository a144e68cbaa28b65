"""Spelling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import spelling as S
from .corpus import WORDS_SQL, word_rows
from .registry import query

ASKED = 300
_V = f"""
WITH v AS (SELECT w AS word, count(*) AS cnt FROM (SELECT unnest({WORDS_SQL}) AS w FROM documents) GROUP BY w),
n AS (SELECT word, row_number() OVER (ORDER BY word) AS rn FROM v WHERE length(word) >= 4)
"""


def _draw(below: str, *key: str) -> str:
    return f"(('0x' || md5(concat_ws('~', {', '.join(key)}))[1:8])::bigint % ({below}))"


def _typo(seed: str, w: str) -> str:
    op, at = _draw("3", seed, "'op'", w), _draw(f"greatest(length({w}), 1)", seed, "'at'", w)
    letter = f"'{S.ALPHABET}'[{_draw(str(len(S.ALPHABET)), seed, repr('letter'), w)} + 1]"
    before, here, after = f"{w}[1:{at}]", f"{w}[{at} + 1:]", f"{w}[{at} + 2:]"
    return (
        f"CASE WHEN {op} = 0 AND length({w}) > 1 THEN {before} || {after} WHEN {op} = 1 THEN {before} || {letter} || {here}"
        f" ELSE {before} || {letter} || {after} END"
    )


_Q = f"""{_V},
t AS (SELECT word AS meant, {_typo("'7'", "word")} AS query FROM (SELECT word FROM v WHERE length(word) >= 5 AND regexp_full_match(word, '[a-z]+')
  ORDER BY md5('7~' || word) LIMIT {ASKED})),
q AS (SELECT DISTINCT query FROM t)
"""
_CAND = f"""{_Q},
c AS (SELECT query, v.word, v.cnt FROM q JOIN v ON abs(length(query) - length(v.word)) <= 2 AND query[1:1] = v.word[1:1])
"""
_UNIT = """CASE WHEN length(query) = 0 THEN length(word)::double WHEN length(word) = 0 THEN length(query)::double ELSE
 list_extract(list_reduce(range(1, length(query) + 1), lambda p, i: list_reduce(range(1, length(word) + 1), lambda c, j:
   list_append(c, least(p[j + 1] + 1, c[j] + 1, p[j] + (CASE WHEN query[i] = word[j] THEN 0.0 ELSE {price} END)::double)), [i::double]),
   list_transform(range(0, length(word) + 1), lambda x: x::double)), -1) END"""
_ALIKE = "MAP {" + ", ".join(f"'{a}': '{''.join(b)}'" for a, b in S.ALIKE.items()) + "}"
_CONF = f"""
dr AS (SELECT k, word FROM (SELECT k, {_draw("(SELECT count(*) FROM n)", "'42'", "'word'", "k")} + 1 AS rn FROM range(12000) r(k)) JOIN n USING (rn)),
pos AS (SELECT k, word, list_filter(range(1, length(word) + 1), lambda i: map_contains({_ALIKE}, word[i])) AS spots FROM dr),
us AS (SELECT *, len(spots) > 0 AND {_draw("100", "'42'", "'use'", "k")} < 85 AS u FROM pos),
pl AS (SELECT *, word[CASE WHEN u THEN spots[{_draw("greatest(len(spots), 1)", "'42'", "'at'", "k")} + 1] ELSE {_draw("length(word)", "'42'", "'any'", "k")} + 1 END] AS a FROM us),
ch AS (SELECT a, CASE WHEN u THEN {_ALIKE}[a][{_draw(f"greatest(coalesce(length({_ALIKE}[a]), 1), 1)", "'42'", "'twin'", "k")} + 1]
  ELSE '{S.ALPHABET}'[{_draw(str(len(S.ALPHABET)), "'42'", "'letter'", "k")} + 1] END AS b FROM pl),
conf AS (SELECT a, b, count(*) AS cnt FROM ch WHERE a <> b GROUP BY a, b)
"""


def vocabulary(spark, sf):
    """Persisted, as every use of it would read the texts again."""
    return C.frequencies(word_rows(spark, sf), "word").persist()


def _typos(vocab):
    """``ASKED`` words of the vocabulary, each with one mistake: word, query."""
    words = vocab.where((F.length("word") >= 5) & F.col("word").rlike("^[a-z]+$"))
    words = words.orderBy(F.md5(F.concat(F.lit("7~"), "word").cast("binary"))).limit(ASKED)
    return words.select("word", T.typo(F.col("word"), F.lit("7"), S.ALPHABET).alias("query"))


@query("spell_typos", f"{_Q} SELECT meant AS word, query FROM t")
def spell_typos(spark, sf):
    return _typos(vocabulary(spark, sf))


@query("spell_candidates", f"{_CAND} SELECT query, count(*) AS n, sum(cnt)::bigint AS cnt FROM c GROUP BY query")
def spell_candidates(spark, sf):
    v = vocabulary(spark, sf)
    found = S.candidates(_typos(v).select("query").distinct(), v)
    return found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("cnt"))


@query(
    "spell_suggest",
    f"""{_CAND}, d AS (SELECT query, word, cnt, {_UNIT.format(price="1.0")}::int AS distance FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, cnt DESC, word) AS rank FROM d)
        SELECT query, word, distance, cnt, rank FROM r WHERE rank <= 5""",
)
def spell_suggest(spark, sf):
    v = vocabulary(spark, sf)
    found = S.candidates(_typos(v).select("query").distinct(), v)
    return S.suggest(found, F.levenshtein("query", "word")).select("query", "word", "distance", "cnt", "rank")


@query("confusion_synth", f"{_V}, {_CONF} SELECT a, b, cnt FROM conf")
def confusion_synth(spark, sf):
    return _confusions(vocabulary(spark, sf))


def _confusions(vocab):
    numbered = C.ranked(vocab.where(F.length("word") >= 4).select("word"), ["word"])
    return S.synthetic_confusions(numbered)


@query(
    "confusion_top",
    f"""{_V}, {_CONF} SELECT row_number() OVER (ORDER BY cnt DESC, a, b) AS rank, a, b, cnt,
        round(cnt / sum(cnt) OVER (PARTITION BY a), 6) AS p FROM conf ORDER BY cnt DESC, a, b LIMIT 20""",
)
def confusion_top(spark, sf):
    from pyspark.sql.window import Window

    rows = S.shares(_confusions(vocabulary(spark, sf))).orderBy(F.desc("cnt"), "a", "b").limit(20)
    rank = F.row_number().over(Window.orderBy(F.desc("cnt"), "a", "b"))  # 20 rows
    return rows.select(rank.alias("rank"), "a", "b", "cnt", F.round("p", 6).alias("p"))


def _weighted(spark, sf):
    v = vocabulary(spark, sf)
    typos = _typos(v).persist()
    found = S.weighted_nearest(typos, v, _confusions(v), digits=6)
    return S.suggest(found, F.round("distance", 6)), typos


_PRICE = "coalesce(cm.m[query[i] || word[j]], 1.0)"
_W = f"""{_Q}, {_CONF},
cm AS (SELECT map_from_entries(list({{'k': a || b, 'v': greatest(0.15, 1 / ln(cnt + 2))}})) AS m FROM conf),
c1 AS (SELECT query, v.word, v.cnt FROM q JOIN v ON abs(length(query) - length(v.word)) <= 2 AND query[1:1] = v.word[1:1]),
c AS (SELECT * FROM c1 UNION ALL SELECT query, v.word, v.cnt FROM (SELECT query FROM q WHERE query NOT IN (SELECT query FROM c1)) q
  JOIN v ON abs(length(query) - length(v.word)) <= 2),
d AS (SELECT query, word, cnt, round({_UNIT.format(price=_PRICE)}, 6) AS distance FROM c, cm),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, cnt DESC, word) AS rank FROM d)
"""


@query("spell_weighted", f"{_W} SELECT query, word, distance, cnt, rank FROM r WHERE rank <= 5")
def spell_weighted(spark, sf):
    return _weighted(spark, sf)[0].select("query", "word", "distance", "cnt", "rank")


@query(
    "spell_eval",
    f"""{_W}, h AS (SELECT t.query, meant, min(rank) AS rank FROM t JOIN r ON r.query = t.query AND r.word = meant AND rank <= 5 GROUP BY ALL)
        SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS acc_1,
        round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS acc_5 FROM t LEFT JOIN h USING (query, meant)""",
)
def spell_eval(spark, sf):
    found, typos = _weighted(spark, sf)
    return S.accuracy(found, typos)
