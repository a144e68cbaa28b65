"""Queries on labels, metrics and trained classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classification as K
from ..operators import corpus as C
from ..operators import lexicon, recurrent
from ..operators import learning as L
from ..operators import matrices as M
from .corpus import WORDS_SQL, documents, word_rows
from .registry import query, table

_P = """
WITH y AS (SELECT doc_id, lang AS y, CASE WHEN ('0x' || md5('p~' || doc_id)[1:8])::bigint % 4 = 0
  THEN (['en', 'fr', 'de', 'es'])[('0x' || md5('q~' || doc_id)[1:8])::bigint % 4 + 1] ELSE lang END AS p FROM documents)
"""


def _guesses(spark, sf):
    pick = T.draw(F.lit("q"), F.col("doc_id"), below=4)
    other = F.get(F.array(*map(F.lit, ("en", "fr", "de", "es"))), pick)
    wrong = T.draw(F.lit("p"), F.col("doc_id"), below=4) == 0
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("y"), F.when(wrong, other).otherwise(F.col("lang")).alias("prediction"))


@query("label_dist", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def label_dist(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "class_weights",
    "SELECT lang, count(*) AS n, round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 6) AS weight FROM documents GROUP BY lang",
)
def class_weights(spark, sf):
    return L.class_weights(table(spark, sf, "documents"), "lang").withColumn("weight", F.round("weight", 6))


@query(
    "metrics_multiclass",
    f"""{_P}, l AS (SELECT DISTINCT unnest([y, p]) AS label FROM y),
        c AS (SELECT label, count(*) FILTER (WHERE y = label AND p = label) AS tp, count(*) FILTER (WHERE p = label) AS said,
          count(*) FILTER (WHERE y = label) AS support FROM y, l GROUP BY label),
        m AS (SELECT *, CASE WHEN said = 0 THEN 0 ELSE tp / said END AS pr, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS rc FROM c),
        f AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM m)
        SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(pr), 6) AS macro_precision, round(avg(rc), 6) AS macro_recall,
          round(avg(f1), 6) AS macro_f1, round(sum(pr * support) / sum(support), 6) AS weighted_precision,
          round(sum(rc * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f""",
)
def metrics_multiclass(spark, sf):
    rows = L.multiclass_metrics(_guesses(spark, sf))
    return rows.select(*(F.round(c, 6).alias(c) for c in rows.columns))


@query(
    "metrics_binary",
    """WITH r AS (SELECT toxic AS y, (('0x' || md5('b~' || doc_id)[1:8])::bigint % 3 = 0)::int AS p FROM labels),
       t AS (SELECT count(*) AS n, sum((y = 1 AND p = 1)::int) AS tp, sum((y <> 1 AND p = 1)::int) AS fp, sum((y = 1 AND p <> 1)::int) AS fn, sum((y = p)::int) AS ok FROM r)
       SELECT n, round(ok / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM t""",
)
def metrics_binary(spark, sf):
    said = (T.draw(F.lit("b"), F.col("doc_id"), below=3) == 0).cast("int")
    rows = table(spark, sf, "labels").select(F.col("toxic").alias("y"), said.alias("prediction"))
    m = L.binary_metrics(rows)
    return m.select("n", *(F.round(c, 6).alias(c) for c in m.columns[1:]))


@query(
    "paired_test",
    f"""{_P}, d AS (SELECT (p = y)::int - ('en' = y)::int AS d FROM y)
        SELECT count(*) AS n, count(*) FILTER (WHERE d > 0) AS only_a, count(*) FILTER (WHERE d < 0) AS only_b,
        round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM d""",
)
def paired_test(spark, sf):
    rows = _guesses(spark, sf).withColumn("b", F.lit("en"))
    return L.paired(rows, "y", "prediction", "b").withColumn("t", F.round("t", 6))


@query(
    "nb_counts",
    f"""SELECT lang AS label, word, count(*) AS cnt, count(DISTINCT doc_id) AS docs
        FROM (SELECT doc_id, lang, unnest({WORDS_SQL}) AS word FROM documents) GROUP BY ALL""",
)
def nb_counts(spark, sf):
    return L.nb_counts(documents(spark, sf).select(F.col("lang").alias("label"), T.words(F.col("text")).alias("words")))


def _classified(spark, sf, kind):
    rows = documents(spark, sf).select("doc_id", F.col("lang").alias("label"), T.words(F.col("text")).alias("words"))
    rows = rows.withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)))
    if kind == "logistic":
        rows = rows.join(F.broadcast(L.class_weights(rows, "label").select("label", "weight")), "label")
    model = L.bag_classifier(rows.where("fold < 8"), kind)
    return L.multiclass_metrics(model.transform(rows.where("fold >= 8")))


for _kind in ("logistic", "multinomial", "bernoulli"):
    query(f"classify_{_kind}")(lambda spark, sf, kind=_kind: _classified(spark, sf, kind))


@query(
    "lexicon_scores",
    f"""WITH w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({WORDS_SQL}) AS word FROM documents) GROUP BY ALL),
        x AS (SELECT doc_id, n, CASE WHEN word IN ('the', 'la', 'und') THEN 1.5 WHEN word IN ('of', 'de', 'en') THEN -0.5 ELSE 0 END::double AS v FROM w),
        s AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN n * (v + 1) ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN n * (1 - v) ELSE 0 END) AS m,
          sum(CASE WHEN v = 0 THEN n ELSE 0 END) AS z, sum(n * v) AS s FROM x GROUP BY doc_id)
        SELECT doc_id, round(p / (p + m + z), 6) AS pos, round(m / (p + m + z), 6) AS neg, round(z / (p + m + z), 6) AS neu,
          round(s / sqrt(s * s + 15), 6) AS compound FROM s""",
)
def lexicon_scores(spark, sf):
    known = [(w, 1.5) for w in ("the", "la", "und")] + [(w, -0.5) for w in ("of", "de", "en")]
    rows = lexicon.scores(word_rows(spark, sf), F.broadcast(spark.createDataFrame(known, "word string, valence double")))
    return rows.select("doc_id", *(F.round(c, 6).alias(c) for c in rows.columns[1:]))


def _languages(spark, sf):
    """doc_id, label (the language), words and split of every document."""
    docs = documents(spark, sf).select("doc_id", F.col("lang").alias("label"), F.filter(T.words(F.col("text")), lambda w: F.length(w) >= 2).alias("words"))
    return C.stratified(docs, "label")


@query("recurrent_grid")
def recurrent_grid(spark, sf):
    """Languages told by recurrent networks from the documents' mean word vectors."""
    rows = _languages(spark, sf).persist()
    vectors = K.word_vectors("pmi", rows.where("split = 'train'"), K.Settings())
    names = F.create_map(*(F.lit(x) for k, n in enumerate(("de", "en", "es", "fr")) for x in (n, k)))
    made = M.mean_vectors(rows, vectors).join(rows.drop("words"), "doc_id")
    made = made.select(F.lit("pmi").alias("feature"), "doc_id", "split", names[F.col("label")].cast("int").alias("y"), "vec")
    return recurrent.train_grid(made)


@query("classify_table")
def classify_table(spark, sf):
    """Feature sets by logistic regression; factorised vectors are left to the command, for their time."""
    return K.compare(_languages(spark, sf).persist(), ("count", "tfidf", "pmi", "word2vec"))


@query("predict_top")
def predict_top(spark, sf):
    """Fitted on train and dev, the best labels of every test document."""
    rows = _languages(spark, sf).persist()
    found = K.Predictor.fit(rows.where("split <> 'test'")).predict(rows.where("split = 'test'"))
    return found.select("doc_id", "predicted_label", F.inline("top_predictions"))


# what the table's figures are made of, from predictions that SQL can make too
_GUESS = "CASE WHEN length(coalesce(text, '')) % 5 = 0 THEN 'en' WHEN length(coalesce(text, '')) % 7 = 0 THEN 'fr' ELSE lang END"


@query(
    "classify_scores",
    f"""WITH p AS (SELECT source AS feature, lang AS y, {_GUESS} AS g FROM documents),
        t AS (SELECT feature, y AS c, count(*) AS n, sum((y = g)::int) AS hit FROM p GROUP BY ALL), s AS (SELECT feature, g AS c, count(*) AS said FROM p GROUP BY ALL),
        e AS (SELECT feature, c, coalesce(n, 0) AS n, coalesce(hit, 0) AS hit, 2 * coalesce(hit, 0) / (coalesce(n, 0) + coalesce(said, 0)) AS f1 FROM t FULL JOIN s USING (feature, c))
        SELECT feature, round(sum(hit) / sum(n), 6) AS test_accuracy, round(avg(f1), 6) AS test_f1_macro, round(sum(f1 * n) / sum(n), 6) AS test_f1_weighted FROM e GROUP BY feature""",
)
def classify_scores(spark, sf):
    size = F.length(F.coalesce("text", F.lit("")))
    guess = F.when(size % 5 == 0, "en").when(size % 7 == 0, "fr").otherwise(F.col("lang"))
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("feature"), F.lit("fixed").alias("model"), F.lit("test").alias("split"), F.col("lang").alias("y"), guess.alias("prediction")
    )
    return K.scores(rows).select("feature", *(F.round(c, 6).alias(c) for c in ("test_accuracy", "test_f1_macro", "test_f1_weighted")))


@query("word_vectors")
def word_vectors(spark, sf):
    rows = documents(spark, sf).select(F.explode(T.sentence_words(F.col("text"))).alias("words")).where(F.size("words") > 1)
    return L.word_vectors(rows, size=16, epochs=1).getVectors().select("word", F.col("vector").cast("string").alias("vector"))
