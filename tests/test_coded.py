"""Packed n-gram counts against the tables of ``ngrams``, with several parts and chunks."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import coded as K
from quern.operators import ngrams as N


@pytest.fixture(scope="module")
def sentences(spark):
    rng = random.Random(3)
    rows = [(rng.choice(("train", "train", "train", "dev", "test")), [rng.choice("aabbcdefgh") for _ in range(rng.randint(1, 9))]) for _ in range(300)]
    return spark.createDataFrame([*rows, ("train", ["once"]), ("test", ["never"])], "split string, words array<string>").repartition(3)


@pytest.fixture()
def counted(monkeypatch, sentences):
    monkeypatch.setattr(K, "EVENTS", 400)
    return lambda order=3, rows=sentences: K.Counted(rows, N.vocabulary(sentences), 2000, order)


def test_perplexities_are_those_of_the_tables(sentences, counted):
    vocab = N.vocabulary(sentences)
    scored = N.probabilities(N.events(sentences, vocab), vocab.agg((F.count(F.lit(1)) + 3).alias("v")))
    sums = counted().sums()
    keyed = lambda rows: {(r.split, r.method): r for r in rows.collect()}
    got, want = keyed(K.perplexities(sums, N.METHODS)), keyed(N.perplexities(scored))
    assert got.keys() == want.keys() and len(got) == 12
    for k, r in want.items():
        assert (got[k].events, got[k].ppl) == (r.events, pytest.approx(r.ppl))
    got, want = keyed(K.unsmoothed(sums)), keyed(N.unsmoothed(scored))
    for k, r in want.items():
        assert (got[k].events, got[k].zero_events) == (r.events, r.zero_events)
        assert got[k].ppl == (None if r.ppl is None else pytest.approx(r.ppl))


@pytest.mark.parametrize("order", [2, 3])
def test_top_and_totals(sentences, counted, order):
    train = sentences.where("split = 'train'")
    names = ["h1", "h2", "w"][3 - order :]
    want = N.events(train, N.vocabulary(sentences), order).select(*names, "m").orderBy(F.desc("m"), *names).limit(20).collect()
    made = counted(order, train)
    assert made.parts > 1
    assert [tuple(r) for r in made.top(20).collect()] == [tuple(r) for r in want]
    if order == 3:
        t = N.counts(N.events(train, N.vocabulary(sentences)))
        got = counted(3, train).totals()
        assert (got["trigrams"], got["bigrams"]) == (t["tri"].count(), t["bi"].count())
        assert got["most_after_two"] == t["ctx3"].agg(F.max("u3")).first()[0]
        assert got["before"].max() == t["uni"].agg(F.max("before")).first()[0]
