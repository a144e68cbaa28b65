import math

import pytest
from pyspark.sql import functions as F

from quern.operators import corpus as C
from quern.operators import dots as D
from quern.operators import learning as L
from quern.operators import ngrams as N
from quern.operators import subwords as B
from quern.sources import pages as P


@pytest.mark.parametrize("n,sizes", [(0, (0, 0, 0)), (1, (0, 0, 1)), (10, (8, 1, 1)), (2473, (1978, 247, 248))])
def test_split_sizes(spark, n, sizes):
    rows = C.split(spark.range(n).withColumnRenamed("id", "doc_id")).groupBy("split").count().collect()
    got = {r.split: r["count"] for r in rows}
    assert tuple(got.get(k, 0) for k in ("train", "dev", "test")) == sizes


def test_offsets_cross_blocks(spark):
    rows = spark.createDataFrame([(k * 3000, k + 1) for k in range(6)], "doc_id long, k int")
    got = {r.doc_id: r.start for r in C.offsets(rows, "k").collect()}
    assert got == {k * 3000: sum(range(1, k + 1)) for k in range(6)}


def test_language_model_on_three_texts(spark):
    rows = [("train", ["a", "b"]), ("train", ["a", "b"]), ("train", ["a", "c"]), ("test", ["a", "c"])]
    s = spark.createDataFrame(rows, "split string, words array<string>")
    v = N.vocabulary(s)
    assert {r.word: r.cnt for r in v.collect()} == {"a": 3, "b": 2}
    ev = N.events(s, v)
    p = N.probabilities(ev, v.agg((F.count(F.lit(1)) + 3).alias("v")))
    got = {(r.h1, r.h2, r.w): r for r in p.where("split = 'test'").collect()}
    row = got[("<s>", "a", "<UNK>")]
    assert row.p3 == pytest.approx(1 / 3) and row.p1 == pytest.approx(1 / 9) and row.laplace == pytest.approx(2 / 8)
    out = {(r.split, r.method): r for r in N.perplexities(p).collect()}
    assert out[("train", "backoff")].ppl == pytest.approx({(r.split, r.method): r for r in N.unsmoothed(p).collect()}[("train", "p3")].ppl)
    assert out[("train", "laplace")].events == 9
    with pytest.raises(ValueError):
        N.probabilities(ev, v, weights=(0.1, 0.1, 0.1))


def test_subwords(spark):
    counts = [("low", 5), ("lower", 2), ("xlow", 1)]
    rows = spark.createDataFrame(counts, "word string, cnt long")
    merges = B.train(rows, 4)
    assert merges == B.train_local(counts, 4)
    made = {r.word: r.pieces for r in B.apply(rows, merges).collect()}
    assert all("".join(p) == w for w, p in made.items())


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "y string, prediction string")
    m = L.multiclass_metrics(rows).first()
    assert m.accuracy == pytest.approx(1 / 3) and m.macro_f1 == pytest.approx((2 / 3) / 3)
    none = L.binary_metrics(spark.createDataFrame([(0, 0)], "y int, prediction int")).first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)
    assert L.mcnemar(0, 0) == 1 and L.mcnemar(1, 9) == pytest.approx(2 * 11 / 1024)


def test_dot_rules(spark):
    docs = spark.createDataFrame([(1, "J. Smith paid 3.50. Dr. No came! Yes.")], "doc_id long, text string")
    rows = D.examples(docs).withColumn("prediction", D.vetoed(F.lit(1)))
    assert [r.prediction for r in rows.orderBy("i").collect()] == [0, 0, 1, 0, 1]
    got = D.cut(docs, rows.select("doc_id", "i", "prediction")).first().sentences
    assert got == ["J. Smith paid 3.50.", "Dr. No came!", "Yes."]


def test_bodies():
    assert P.body_of("<article>" + "x" * 301 + "</article>") == "x" * 301
    assert P.body_of("<p>short</p>") is None
    assert P.body_of("<p>" + "y" * 200 + "<p>" + "z" * 60, 250) == "y" * 200 + "\n" + "z" * 60


def test_incremental(spark):
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "url string")
    assert [r.url for r in P.unseen(new, spark.createDataFrame([("a",)], "url string")).collect()] == ["b"]


def test_length_stats(spark):
    rows = spark.createDataFrame([(k,) for k in (5, 1, 4, 2, 9)], "n int")
    got = C.length_stats(rows, F.col("n")).first()
    assert (got.n, got.min, got.p50, got.mean, got.p95, got.max) == (5, 1, 4, 4, 5, 9)


def test_registry_names_have_callables():
    from quern.plans import registry

    assert all(map(callable, registry.queries().values()))
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert math.isfinite(len(registry.queries()))
