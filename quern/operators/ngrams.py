"""N-gram language models: counts, smoothing and perplexity as joins and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

UNKNOWN = "<UNK>"
SMALL = 500_000  # words of a vocabulary that is broadcast
SPLITS = ("train", "dev", "test")


def vocabulary(sentences: DataFrame, min_count: int = 2) -> DataFrame:
    """Words of the train split seen often enough. sentences: split, words."""
    seen = sentences.where("split = 'train'").select(F.explode("words").alias("word"))
    return seen.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_count)


def raw_events(sentences: DataFrame, order: int = 3) -> DataFrame:
    """split, h1, h2, w (as far as the order goes) and m, how often they occur, in one pass over the text."""
    names = ["h1", "h2", "w"][3 - order :]
    rows = sentences.select("split", F.inline(T.ngram_structs(F.col("words"), order)).alias(*names))
    return rows.groupBy("split", *names).agg(F.count(F.lit(1)).alias("m"))


def vocabulary_of(raw: DataFrame, min_count: int = 2) -> DataFrame:
    """The vocabulary of ``raw_events``: every word of a sentence is the last of one n-gram."""
    seen = raw.where("split = 'train' and w <> '</s>'").groupBy(F.col("w").alias("word")).agg(F.sum("m").alias("cnt"))
    return seen.where(F.col("cnt") >= min_count)


def known_events(raw: DataFrame, vocab: DataFrame, small: int = SMALL) -> DataFrame:
    """``raw`` events with <UNK> for words outside the vocabulary.

    Distinct n-grams are looked up, each once. A vocabulary of at most ``small``
    words is sent to the tasks; a larger one is joined.
    """
    names = [c for c in raw.columns if c in ("h1", "h2", "w")]
    known = vocab.select("word").unionByName(vocab.sparkSession.createDataFrame([("<s>",), ("</s>",)], "word string"))
    if vocab.count() <= small:
        known = F.broadcast(known)
    rows = raw
    for n in names:
        rows = rows.join(known.select(F.col("word").alias(n), F.lit(True).alias(f"k_{n}")), n, "left")
    rows = rows.select(
        "split", *(F.when(F.col(f"k_{n}"), F.col(n)).otherwise(UNKNOWN).alias(n) for n in names), "m"
    )
    return rows.groupBy("split", *names).agg(F.sum("m").alias("m"))


def events(sentences: DataFrame, vocab: DataFrame, order: int = 3) -> DataFrame:
    """The events of sentences over a given vocabulary."""
    return known_events(raw_events(sentences, order), vocab)


def counts(train: DataFrame) -> dict[str, DataFrame]:
    """All tables that the smoothers need, from the train events (h1, h2, w, m)."""
    n = F.count(F.lit(1))
    tri = train.groupBy("h1", "h2", "w").agg(F.sum("m").alias("c3"))
    bi = tri.groupBy("h2", "w").agg(F.sum("c3").alias("c2"))
    return {
        "tri": tri,
        "bi": bi,
        "uni": bi.groupBy("w").agg(F.sum("c2").alias("c1"), n.alias("before")),
        "ctx3": tri.groupBy("h1", "h2").agg(F.sum("c3").alias("d3"), n.alias("u3")),
        "ctx2": bi.groupBy("h2").agg(F.sum("c2").alias("d2"), n.alias("u2")),
        "all": bi.agg(F.sum("c2").alias("n1"), n.alias("nb")),
    }


def _or0(name: str) -> Column:
    return F.coalesce(name, F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def probabilities(
    ev: DataFrame, size: DataFrame, alpha: float = 1.0, weights: tuple[float, float, float] = (0.1, 0.3, 0.6),
    gamma: float = 0.4, discount: float = 0.75,
) -> DataFrame:
    """Events with the probabilities of all methods side by side.

    size: one row with v, the number of words and the three special ones.
    """
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("the interpolation weights must add up to 1")
    # one row a trigram, with its number in each split; that of train is its count
    tri = ev.groupBy("h1", "h2", "w").agg(*(F.sum(F.when(F.col("split") == x, F.col("m")).otherwise(0)).alias(x) for x in SPLITS))
    tri = tri.withColumn("c3", F.col("train"))
    seen = tri.where("c3 > 0")
    n = F.count(F.lit(1))
    bi = seen.groupBy("h2", "w").agg(F.sum("c3").alias("c2")).persist()
    ctx3 = seen.groupBy("h1", "h2").agg(F.sum("c3").alias("d3"), n.alias("u3"))
    uni, ctx2 = bi.groupBy("w").agg(F.sum("c2").alias("c1"), n.alias("before")), bi.groupBy("h2").agg(F.sum("c2").alias("d2"), n.alias("u2"))
    total = bi.agg(F.sum("c2").alias("n1"), n.alias("nb"))
    if size.first()[0] <= SMALL:  # of words, which bounds both tables
        uni, ctx2 = F.broadcast(uni), F.broadcast(ctx2)
    rows = (
        tri.join(bi, ["h2", "w"], "left").join(ctx3, ["h1", "h2"], "left").join(uni, "w", "left").join(ctx2, "h2", "left")
        .crossJoin(F.broadcast(total)).crossJoin(F.broadcast(size))  # one row each
    )
    c3, c2, c1, d3, d2 = (_or0(x) for x in ("c3", "c2", "c1", "d3", "d2"))
    p1, p2, p3 = _ratio(c1, F.col("n1")), _ratio(c2, d2), _ratio(c3, d3)
    cont = _ratio(_or0("before"), F.col("nb"))
    kn2 = F.when(d2 == 0, cont).otherwise(F.greatest(c2 - discount, F.lit(0.0)) / d2 + discount * _or0("u2") / d2 * cont)
    kn3 = F.when(d3 == 0, kn2).otherwise(F.greatest(c3 - discount, F.lit(0.0)) / d3 + discount * _or0("u3") / d3 * kn2)
    made = rows.select(
        *SPLITS, "h1", "h2", "w", p1.alias("p1"), p2.alias("p2"), p3.alias("p3"),
        ((c3 + alpha) / (d3 + alpha * F.col("v"))).alias("laplace"),
        (weights[0] * p1 + weights[1] * p2 + weights[2] * p3).alias("interpolation"),
        F.when((c3 > 0) & (d3 > 0), p3).when((c2 > 0) & (d2 > 0), gamma * p2).otherwise(gamma * gamma * p1).alias("backoff"),
        kn3.alias("kneser_ney"),
    )
    each = F.inline(F.array(*(F.struct(F.lit(x).alias("split"), F.col(x).alias("m")) for x in SPLITS)))
    return made.select(each, *(c for c in made.columns if c not in SPLITS)).where("m > 0")


METHODS = ("laplace", "interpolation", "backoff", "kneser_ney")


def perplexities(rows: DataFrame, names: tuple[str, ...] = METHODS) -> DataFrame:
    """split, method, events and ppl; a probability that isn't positive counts as 1e-12."""
    out = [F.exp(-F.sum(F.col("m") * F.log(F.when(F.col(x) <= 0, 1e-12).otherwise(F.col(x)))) / F.sum("m")).alias(x) for x in names]
    wide = rows.groupBy("split").agg(F.sum("m").alias("events"), *out)
    each = F.array(*(F.struct(F.lit(x).alias("method"), F.col(x).alias("ppl")) for x in names))
    return wide.select("split", "events", F.inline(each))


def unsmoothed(rows: DataFrame, names: tuple[str, ...] = ("p1", "p2", "p3")) -> DataFrame:
    """As ``perplexities`` for maximum likelihood: infinite if an event has no probability."""
    made = []
    for x in names:
        zero = F.sum(F.when(F.col(x) <= 0, F.col("m")).otherwise(0))
        ppl = F.exp(-F.sum(F.col("m") * F.log(F.when(F.col(x) > 0, F.col(x)))) / F.sum("m"))
        made += [zero.alias(f"z{x}"), F.when(zero == 0, ppl).alias(x)]
    wide = rows.groupBy("split").agg(F.sum("m").alias("events"), *made)
    each = F.array(*(F.struct(F.lit(x).alias("method"), F.col(f"z{x}").alias("zero_events"), F.col(x).alias("ppl")) for x in names))
    return wide.select("split", "events", F.inline(each))
