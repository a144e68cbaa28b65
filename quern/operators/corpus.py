"""Documents as tables of words, with their places."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Documents of which the places are summed up as one before a global order.
BLOCK = 4096


def load_documents(
    rows: DataFrame, text: str = "text", doc_id: str = "doc_id", url: str | None = None, category: str | None = None,
    subcategory: str | None = None, remove_timestamps: bool = False,
) -> DataFrame:
    """doc_id, text, category and subcategory; an id that lacks is the address, then ``doc_<n>``."""
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.nullif(F.col(doc_id).cast("string"), F.lit(""))
    if url:
        key = F.coalesce(key, F.nullif(F.col(url), F.lit("")))
    none = F.lit(None).cast("string")
    return rows.select(
        F.coalesce(key, F.concat(F.lit("doc_"), F.monotonically_increasing_id().cast("string"))).alias("doc_id"),
        (T.without_timestamps(body) if remove_timestamps else body).alias("text"),
        (F.col(category) if category else none).alias("category"),
        (F.col(subcategory) if subcategory else none).alias("subcategory"),
    )


def exploded(docs: DataFrame, items: Column, name: str) -> DataFrame:
    """doc_id, pos (from 0) and one item a row."""
    return docs.select("doc_id", F.posexplode(items).alias("pos", name))


def frequencies(items: DataFrame, name: str) -> DataFrame:
    """Counts; partial sums come before the shuffle, so a frequent item is no burden."""
    return items.groupBy(name).agg(F.count(F.lit(1)).alias("cnt"))


def top(counts: DataFrame, name: str, k: int) -> DataFrame:
    """The ``k`` most frequent, ties by name."""
    return counts.orderBy(F.desc("cnt"), F.asc(name)).limit(k)


def offsets(docs: DataFrame, size: str) -> DataFrame:
    """``docs`` with ``start``: the sum of ``size`` over all documents of lesser id.

    Blocks of ids are summed first, so the one window over all of them sees a
    row for each block and no more.
    """
    docs = docs.withColumn("block", F.floor(F.col("doc_id") / BLOCK))
    blocks = docs.groupBy("block").agg(F.sum(size).alias("all"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("own", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return docs.join(blocks, "block").withColumn("start", F.col("own") + F.col("base")).drop("block", "own", "base")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rn``, from 1 in the given order of string keys.

    The range is cut at sampled keys, so rows are counted within ranges and
    only the ranges' counts are summed in one place.
    """
    from pyspark.sql import functions as S

    kept = rows.repartitionByRange(*order).withColumn("part", S.spark_partition_id()).persist()
    sizes = kept.groupBy("part").agg(S.count(S.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", S.coalesce(S.sum("n").over(before), S.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy(*order)
    kept = kept.withColumn("own", S.row_number().over(inner))
    return kept.join(sizes, "part").withColumn("rn", S.col("own") + S.col("base")).drop("part", "own", "base")


def _hashed(seed: int) -> Column:
    return F.md5(F.concat_ws("~", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))


def _last_of(keys: DataFrame, ranks: dict[tuple, list[int]], by: list[str]) -> dict[tuple, list[tuple | None]]:
    """For each group the (key, doc_id) at each of some ranks (from 1; 0 gives None).

    Keys are counted by their first four digits; only the few ranges that hold a
    wanted rank are then ranked in full, so no task sees a whole group.
    """
    head = F.substring("key", 1, 4).alias("head")
    counts = keys.groupBy(*by, head).agg(F.count(F.lit(1)).alias("n")).orderBy(*by, "head").collect()  # 65536 a group at most
    upto: dict[tuple, int] = {}
    wanted, base = set(), {}
    for r in counts:
        group = tuple(r[c] for c in by)
        before = upto.get(group, 0)
        upto[group] = before + r.n
        if any(before < k <= before + r.n for k in ranks[group]):
            wanted.add((*group, r["head"]))
            base[(*group, r["head"])] = before
    out: dict[tuple, list[tuple | None]] = {g: [None] * len(ks) for g, ks in ranks.items()}
    if not wanted:
        return out
    heads = keys.where(head.isin(sorted({w[-1] for w in wanted}))).select(*by, "key", "doc_id", head)
    order = Window.partitionBy(*by, "head").orderBy("key", "doc_id")
    rows = heads.withColumn("rn", F.row_number().over(order))
    tests = [
        (w, k, F.col("head").eqNullSafe(w[-1]) & (F.col("rn") == k - base[w]) & _same(by, w))
        for w in sorted(wanted, key=repr)
        for k in ranks[w[:-1]]
        if base[w] < k <= upto[w[:-1]]
    ]
    found = rows.where(functools.reduce(lambda x, y: x | y, [t for _, _, t in tests])).collect()  # as many as ranks
    for r in found:
        group = tuple(r[c] for c in by)
        for at, k in enumerate(ranks[group]):
            if k == r.rn + base[(*group, r["head"])]:
                out[group][at] = (r.key, r.doc_id)
    return out


def _same(by: list[str], values: tuple) -> Column:
    return functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(v) for c, v in zip(by, values)], F.lit(True))


def _upto(last: tuple | None) -> Column:
    """Whether a row comes no later than a (key, doc_id)."""
    if last is None:
        return F.lit(False)
    return (F.col("key") < last[0]) | ((F.col("key") == last[0]) & (F.col("doc_id") <= F.lit(last[1])))


def split(docs: DataFrame, seed: int = 42, train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """``docs`` with ``split``: exact shares in the order of a hash of seed and id.

    A filter-like expression on the id: two keys at the borders decide, so the
    documents themselves are neither sorted nor joined.
    """
    n = docs.count()
    a = int(n * train)
    b = a + int(n * dev)
    keyed = docs.withColumn("key", _hashed(seed))
    first, second = _last_of(keyed, {(): [a, b]}, [])[()]
    name = F.when(_upto(first), "train").when(_upto(second), "dev").otherwise("test")
    return keyed.withColumn("split", name).drop("key")


def stratified(docs: DataFrame, label: str, seed: int = 42, train: float = 0.8, dev: float = 0.5) -> DataFrame:
    """``docs`` with ``split``, in the same shares for every label; a label's borders are two keys."""
    keyed = docs.withColumn("key", _hashed(seed))
    ranks = {}
    for r in docs.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect():  # one row a label
        a = math.floor(r.n * train)
        ranks[(r[label],)] = [a, a + math.floor((r.n - a) * dev)]
    borders = _last_of(keyed, ranks, [label])
    spark = docs.sparkSession
    kind, id_kind = docs.schema[label].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    rows = [(g[0], *(first or (None, None)), *(second or (None, None))) for g, (first, second) in borders.items()]
    names = f"_label {kind}, k1 string, d1 {id_kind}, k2 string, d2 {id_kind}"
    table = F.broadcast(spark.createDataFrame(rows, names))  # one row a label
    at = lambda k: (F.col("key") < F.col(f"k{k}")) | ((F.col("key") == F.col(f"k{k}")) & (F.col("doc_id") <= F.col(f"d{k}")))
    joined = keyed.join(table, F.col(label).eqNullSafe(F.col("_label")))
    name = F.when(F.coalesce(at(1), F.lit(False)), "train").when(F.coalesce(at(2), F.lit(False)), "dev").otherwise("test")
    return joined.withColumn("split", name).drop("key", "_label", "k1", "d1", "k2", "d2")


def length_stats(rows: DataFrame, size: Column) -> DataFrame:
    """min, median, mean and the value at rank int(.95 (n - 1)), and max.

    Lengths are counted by value, so the running sum sees distinct lengths.
    """
    counts = rows.groupBy(size.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    run = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("c").over(run))
    n = counts.agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s"))
    counts = counts.crossJoin(F.broadcast(n))  # one row
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return counts.agg(
        F.max("n").alias("n"),
        F.min("v").cast("long").alias("min"),
        F.floor((at(low) + at(high)) / 2).cast("long").alias("p50"),
        F.floor(F.max("s") / F.max("n")).cast("long").alias("mean"),
        at(F.floor((F.col("n") - 1) * F.lit(0.95))).cast("long").alias("p95"),
        F.max("v").cast("long").alias("max"),
    )
