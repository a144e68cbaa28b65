"""Language-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import coded as K
from ..operators import corpus as C
from ..operators import ngrams as N
from .corpus import SPLIT_SQL, sentences_sql
from .registry import query, table

_SENT = f"""
WITH {SPLIT_SQL},
x AS (SELECT split, regexp_extract_all(lower(unnest({sentences_sql("coalesce(text, '')")})), '{T.WORD}') AS w FROM s),
st AS (SELECT split, w, row_number() OVER () AS sid FROM x WHERE len(w) > 0),
voc AS (SELECT t AS word, count(*) AS cnt FROM (SELECT unnest(w) AS t FROM st WHERE split = 'train') GROUP BY t HAVING count(*) >= 2),
known AS (SELECT word FROM voc UNION ALL SELECT '<s>' UNION ALL SELECT '</s>'),
pad AS (SELECT split, list_concat(['<s>', '<s>'], w, ['</s>']) AS p, len(w) AS n FROM st),
raw AS (SELECT split, p[i] AS a, p[i + 1] AS b, p[i + 2] AS c FROM (SELECT split, p, unnest(range(1, n + 2)) AS i FROM pad)),
ev AS (SELECT split, CASE WHEN ka.word IS NULL THEN '<UNK>' ELSE a END AS h1, CASE WHEN kb.word IS NULL THEN '<UNK>' ELSE b END AS h2,
    CASE WHEN kc.word IS NULL THEN '<UNK>' ELSE c END AS w, sum(m)::bigint AS m
  FROM (SELECT split, a, b, c, count(*) AS m FROM raw GROUP BY ALL) r
  LEFT JOIN known ka ON ka.word = a LEFT JOIN known kb ON kb.word = b LEFT JOIN known kc ON kc.word = c GROUP BY ALL)
"""
_COUNTS = f"""{_SENT},
tr AS (SELECT * FROM ev WHERE split = 'train'),
tri AS (SELECT h1, h2, w, sum(m) AS c3 FROM tr GROUP BY ALL),
bi AS (SELECT h2, w, sum(c3) AS c2 FROM tri GROUP BY ALL),
uni AS (SELECT w, sum(c2) AS c1, count(*) AS bef FROM bi GROUP BY ALL),
x3 AS (SELECT h1, h2, sum(c3) AS d3, count(*) AS u3 FROM tri GROUP BY ALL),
x2 AS (SELECT h2, sum(c2) AS d2, count(*) AS u2 FROM bi GROUP BY ALL),
tot AS (SELECT sum(c2) AS n1, count(*) AS nb FROM bi),
sz AS (SELECT count(*) + 3 AS v FROM voc),
j AS (SELECT split, m, coalesce(c3, 0)::double AS c3, coalesce(c2, 0)::double AS c2, coalesce(c1, 0)::double AS c1, coalesce(d3, 0)::double AS d3,
    coalesce(d2, 0)::double AS d2, coalesce(u3, 0) AS u3, coalesce(u2, 0) AS u2, coalesce(bef, 0) AS bef, n1::double AS n1, nb::double AS nb, v
  FROM ev LEFT JOIN tri USING (h1, h2, w) LEFT JOIN bi USING (h2, w) LEFT JOIN uni USING (w)
  LEFT JOIN x3 USING (h1, h2) LEFT JOIN x2 USING (h2), tot, sz),
p AS (SELECT *, CASE WHEN n1 > 0 THEN c1 / n1 ELSE 0 END AS p1, CASE WHEN d2 > 0 THEN c2 / d2 ELSE 0 END AS p2,
    CASE WHEN d3 > 0 THEN c3 / d3 ELSE 0 END AS p3, CASE WHEN nb > 0 THEN bef / nb ELSE 0 END AS ct FROM j),
k AS (SELECT *, CASE WHEN d2 = 0 THEN ct ELSE greatest(c2 - 0.75, 0) / d2 + 0.75 * u2 / d2 * ct END AS kn2 FROM p),
q AS (SELECT split, m, p1, p2, p3, (c3 + 1) / (d3 + v) AS laplace, 0.1 * p1 + 0.3 * p2 + 0.6 * p3 AS interpolation,
    CASE WHEN c3 > 0 THEN p3 WHEN c2 > 0 THEN 0.4 * p2 ELSE 0.16 * p1 END AS backoff,
    CASE WHEN d3 = 0 THEN kn2 ELSE greatest(c3 - 0.75, 0) / d3 + 0.75 * u3 / d3 * kn2 END AS kneser_ney FROM k)
"""
_LONG = " UNION ALL ".join(
    f"SELECT split, '{x}' AS method, sum(m)::bigint AS events, round(exp(-sum(m * ln(CASE WHEN {x} <= 0 THEN 1e-12 ELSE {x} END)) / sum(m)), 4) AS ppl FROM q GROUP BY split"
    for x in N.METHODS
)


def sentences(spark, sf):
    """split and words of every sentence."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = C.split(docs)
    return rows.select("split", F.explode(T.sentence_words(F.col("text"))).alias("words"))


def _counted(spark, sf, order=3, train=False):
    """The n-grams of all splits (or of train only) over the words that train has twice."""
    docs = C.split(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    words = docs.where("split = 'train'").select(F.explode(T.words(F.col("text"))).alias("word"))  # those of its sentences
    counts = C.frequencies(words, "word").persist()
    tokens = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    rows = docs.where("split = 'train'") if train else docs
    rows = rows.select("split", F.explode(T.sentence_words(F.col("text"))).alias("words"))
    made = K.Counted(rows, counts.where("cnt >= 2"), tokens if train else tokens * 5 // 4, order)
    counts.unpersist()
    return made


@query("lm_vocab", f"{_SENT} SELECT word, cnt FROM voc")
def lm_vocab(spark, sf):
    return N.vocabulary(sentences(spark, sf))


def _top(order: int):
    cols = ["h1", "h2", "w"][3 - order :]

    def run(spark, sf):
        if order > 1:
            return _counted(spark, sf, order, train=True).top(50)
        raw = N.raw_events(sentences(spark, sf), order).persist()
        ev = N.known_events(raw, N.vocabulary_of(raw).persist()).where("split = 'train'")
        return ev.select(*cols, F.col("m").alias("cnt")).orderBy(F.desc("cnt"), *cols).limit(50)

    return run


for _n in (1, 2, 3):
    _cols = ", ".join(["h1", "h2", "w"][3 - _n :])
    query(
        f"ngram_{_n}_top",
        f"{_SENT} SELECT {_cols}, sum(m)::bigint AS cnt FROM ev WHERE split = 'train' GROUP BY {_cols} ORDER BY cnt DESC, {_cols} LIMIT 50",
    )(_top(_n))


@query(
    "kn_stats",
    f"""{_COUNTS} SELECT (SELECT count(*) FROM tri) AS trigrams, (SELECT count(*) FROM bi) AS bigrams, (SELECT count(*) FROM uni) AS words,
        (SELECT max(u3) FROM x3) AS most_after_two, (SELECT max(u2) FROM x2) AS most_after_one, (SELECT max(bef) FROM uni) AS most_before""",
)
def kn_stats(spark, sf):
    t = _counted(spark, sf, train=True).totals()
    names = ("trigrams", "bigrams", "words", "most_after_two", "most_after_one", "most_before")
    before = t["before"]
    row = (t["trigrams"], t["bigrams"], int((before > 0).sum()), t["most_after_two"], t["most_after_one"], int(before.max()))
    if not t["trigrams"]:
        row = (0, 0, 0, None, None, None)
    return spark.createDataFrame([row], ", ".join(f"{n} long" for n in names))


@query(
    "ppl_mle",
    f"{_COUNTS} "
    + " UNION ALL ".join(
        f"SELECT split, '{x}' AS method, sum(m)::bigint AS events, sum(CASE WHEN {x} <= 0 THEN m ELSE 0 END)::bigint AS zero_events,"
        f" CASE WHEN sum(CASE WHEN {x} <= 0 THEN m ELSE 0 END) = 0 THEN round(exp(-sum(m * ln(CASE WHEN {x} > 0 THEN {x} END)) / sum(m)), 4) END AS ppl FROM q GROUP BY split"
        for x in ("p1", "p2", "p3")
    ),
)
def ppl_mle(spark, sf):
    return K.unsmoothed(_counted(spark, sf).sums()).withColumn("ppl", F.round("ppl", 4))


@query("ppl_smoothing", f"{_COUNTS} {_LONG}")
def ppl_smoothing(spark, sf):
    return K.perplexities(_counted(spark, sf).sums(), N.METHODS).withColumn("ppl", F.round("ppl", 4))


@query(
    "best_smoothing",
    f"{_COUNTS}, r AS ({_LONG}) SELECT method, ppl FROM r WHERE split = 'dev' ORDER BY ppl, method LIMIT 1",
)
def best_smoothing(spark, sf):
    rows = K.perplexities(_counted(spark, sf).sums(), N.METHODS).where("split = 'dev'")
    return rows.select("method", F.round("ppl", 4).alias("ppl")).orderBy("ppl", "method").limit(1)
