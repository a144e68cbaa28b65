"""Counts of n-grams and of neighbours over numbered words: one shuffle of packed numbers.

A word's number is its place among all known words and the three special ones
in the order of their bytes. Every n-gram goes to the part of its middle word
(h2), so that a part holds whole (h1, h2, w), (h2, w), (h1, h2) and (h2) groups;
only sums by the last word cross the parts. Numbers travel as sorted keys,
written as differences and compressed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL = ("</s>", "<UNK>", "<s>")  # in the order of their bytes, before any letter
END, UNKNOWN, START = 0, 1, 2
SPLITS = ("train", "dev", "test")
EVENTS = 2_000_000  # events of a part, about
CHUNK = 1_000_000  # words that a task counts at once
BLOCKS = 16  # of the sums by last word
SLICE = 1_000_000  # n-grams whose probabilities are worked out at once
_BLOBS = "part int, keys binary, counts binary"


def _pack(keys: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Sorted keys as differences, their bytes put together by place, and counts."""
    steps = np.diff(keys, prepend=np.uint64(0))
    made = []
    for v in (steps, counts.astype(np.int64)):
        planes = np.ascontiguousarray(v.view(np.uint8).reshape(len(v), -1).T)
        made.append(len(v).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True))
    return made


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    v = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
    return np.cumsum(v, dtype=np.uint64) if kind is np.uint64 else v


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else counts.astype(np.int64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """For each of sorted keys the number of its run."""
    return np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)


class Counted:
    """The n-grams of sentences (split, words) over the words that ``vocab`` (word, cnt) names.

    One million known words take about 15 MB of the driver and of a worker.
    """

    def __init__(self, sentences: DataFrame, vocab: DataFrame, tokens: int, order: int = 3):
        known = vocab.select("word").toArrow().column("word").to_pylist()
        self.words = pa.array([*SPECIAL, *sorted(known)], pa.string())
        self.spark, self.order = sentences.sparkSession, order
        self.bits = max(2, (len(self.words) - 1).bit_length())
        # room for the split and the middle word's number within its part
        self.parts = max(1, -(-tokens // EVENTS), -(-len(self.words) // (1 << max(1, 62 - 2 * self.bits))))
        self.sent = self.spark.sparkContext.broadcast(self.words)
        self.merged = _merged(self._events(sentences), self.parts)

    def _events(self, sentences: DataFrame) -> DataFrame:
        bits, parts, order, sent = self.bits, self.parts, self.order, self.sent

        def rows(split: np.ndarray, lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
            codes = lists.flatten().dictionary_encode()
            found = pc.index_in(codes.dictionary, value_set=sent.value).fill_null(UNKNOWN).to_numpy(zero_copy_only=False)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            last = np.cumsum(size) - 1
            first = last - size + 1
            w = np.full(int(size.sum()), END, np.uint64)
            inner = np.ones(len(w), bool)
            inner[last] = False
            w[inner] = found[codes.indices.to_numpy()]
            h2, h1 = np.roll(w, 1), np.zeros(len(w), np.uint64)
            h2[first] = START
            if order > 2:
                h1 = np.roll(h2, 1)
                h1[first] = START
            part = (h2 % np.uint64(parts)).astype(np.uint32)
            key = (((h2 // np.uint64(parts) << np.uint64(bits)) | h1) << np.uint64(bits) | w) << np.uint64(2) | np.repeat(split, size)
            yield from _dealt(part, key, np.ones(len(key), np.int64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _chunked(batches, rows, CHUNK)

        code = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")) - 1
        return sentences.select(code.cast("int").alias("split"), "words").where(F.size("words") > 0).mapInArrow(run, _BLOBS)

    def top(self, k: int, split: int = 0) -> DataFrame:
        """The ``k`` most frequent n-grams of a split, ties in the order of their bytes: h1, h2, w (as far as the order goes) and cnt."""
        names = ["h1", "h2", "w"][3 - self.order :]
        sent, table = self.sent, self._table()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, keys, counts in _parts(batches):
                t = table(part, keys, counts)
                n = t["m"][split]
                some = np.flatnonzero(n > 0)
                if len(some) > k:
                    some = some[n[some] >= np.partition(n[some], -k)[-k]]
                best = some[np.lexsort((t["w"][some], t["h2"][some], t["h1"][some], -n[some]))][:k]
                cols = [sent.value.take(pa.array(t[c][best].astype(np.int64))) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n[best].astype(np.int64))], names=[*names, "cnt"])

        rows = self.merged.mapInArrow(run, ", ".join(f"{c} string" for c in names) + ", cnt long")
        return rows.orderBy(F.desc("cnt"), *names).limit(k)

    def _table(self):
        bits, parts = np.uint64(self.bits), np.uint64(self.parts)
        low = np.uint64((1 << self.bits) - 1)

        def table(part: int, keys: np.ndarray, counts: np.ndarray) -> dict:
            """A part's n-grams in order: h1, h2, w, the keys of their groups and m, the counts of each split."""
            gram = keys >> np.uint64(2)
            run = _runs(gram)
            first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else run
            split = (keys & np.uint64(3)).astype(np.int64)
            m = np.zeros((3, len(first)), np.int64)
            m[split, run] = counts
            gram = gram[first]
            local = gram >> (bits + bits)
            return {"h1": (gram >> bits) & low, "h2": local * parts + np.uint64(part), "w": gram & low, "m": m, "h1h2": gram >> bits, "h2w": local << bits | (gram & low), "local": local}

        return table

    def _groups(self):
        table, bits = self._table(), self.bits

        def groups(part: int, keys: np.ndarray, counts: np.ndarray) -> dict:
            """The table with the train counts of its groups; ``g`` numbers are places of groups."""
            t = table(part, keys, counts)
            c3 = t["c3"] = t["m"][0]
            seen = (c3 > 0).astype(np.int64)
            sums = lambda at, v: np.bincount(at, v).astype(np.int64) if len(at) else np.zeros(0, np.int64)
            t["g3"] = _runs(t.pop("h1h2"))
            t["d3"], t["u3"] = sums(t["g3"], c3), sums(t["g3"], seen)
            pair, t["g2"] = np.unique(t.pop("h2w"), return_inverse=True)
            t["c2"] = sums(t["g2"], c3)
            local = _runs(pair >> np.uint64(bits))
            t["d2"], t["u2"] = sums(local, t["c2"]), sums(local, (t["c2"] > 0).astype(np.int64))
            t["gx"] = local[t["g2"]] if len(pair) else local
            t["w2"] = (pair & np.uint64((1 << bits) - 1)).astype(np.int64)
            return t

        return groups

    def totals(self) -> dict:
        """trigrams, bigrams, most_after_two, most_after_one; c1 and before, arrays by the number of the last word."""
        self.merged = self.merged.persist(StorageLevel.DISK_ONLY)
        groups, size = self._groups(), len(self.words)
        ends = [size * b // BLOCKS for b in range(BLOCKS + 1)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c1, before, one = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(4, np.int64)
            for part in _parts(batches):
                t = groups(*part)
                on = t["c2"] > 0
                c1 += np.bincount(t["w2"], t["c2"], minlength=size).astype(np.int64)
                before += np.bincount(t["w2"][on], minlength=size)
                most = lambda v: int(v.max()) if len(v) else 0
                one = np.array([one[0] + (t["c3"] > 0).sum(), one[1] + on.sum(), max(one[2], most(t["u3"])), max(one[3], most(t["u2"]))])
            for b in range(BLOCKS):
                cut = slice(ends[b], ends[b + 1])
                yield _row(b, one if b == 0 else np.zeros(4, np.int64), c1[cut], before[cut])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for b, *parts in zip(*(x.to_pylist() for x in batch.columns)):
                    one, c1, before = (np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True), np.int64) for x in parts)
                    was = total.get(b)
                    total[b] = [one, c1, before] if was is None else [np.concatenate((was[0][:2] + one[:2], np.maximum(was[0][2:], one[2:]))), was[1] + c1, was[2] + before]
            for b, parts in total.items():
                yield _row(b, *parts)

        schema = "block int, one binary, c1 binary, before binary"
        rows = self.merged.mapInArrow(run, schema).repartition(BLOCKS, "block").mapInArrow(add, schema).collect()  # ``BLOCKS`` rows
        c1, before, one = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(4, np.int64)
        for r in rows:
            got = [np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True), np.int64) for x in (r.one, r.c1, r.before)]
            cut = slice(ends[r.block], ends[r.block + 1])
            c1[cut], before[cut] = got[1], got[2]
            one = one if r.block else got[0]
        return dict(zip(("trigrams", "bigrams", "most_after_two", "most_after_one"), map(int, one))) | {"c1": c1, "before": before}

    def sums(
        self, alpha: float = 1.0, weights: tuple[float, float, float] = (0.1, 0.3, 0.6), gamma: float = 0.4, discount: float = 0.75
    ) -> DataFrame:
        """split, events and, for every method x, ``s_x`` (the sum of the logarithms of its positive
        probabilities) and ``z_x`` (events without any); a row for each part and split."""
        if abs(sum(weights) - 1) > 1e-9:
            raise ValueError("the interpolation weights must add up to 1")
        from .ngrams import METHODS

        t = self.totals()
        v, n1, nb = len(self.words), int(t["c1"].sum()), int(t["before"].sum())
        groups, methods = self._groups(), ("p1", "p2", "p3", *METHODS)
        shared = self.spark.sparkContext.broadcast((t["c1"], t["before"]))

        def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)

        def made(t: dict, at: slice) -> dict[str, np.ndarray]:
            c1, before = (x[t["w"][at].astype(np.int64)].astype(float) for x in shared.value)
            g3, g2, gx = t["g3"][at], t["g2"][at], t["gx"][at]
            c3, d3, u3 = t["c3"][at].astype(float), t["d3"][g3].astype(float), t["u3"][g3]
            c2, d2, u2 = t["c2"][g2].astype(float), t["d2"][gx].astype(float), t["u2"][gx]
            p1, cont = (c1 / n1, before / nb) if n1 else (c1 * 0, c1 * 0)
            p2, p3 = ratio(c2, d2), ratio(c3, d3)
            kn2 = np.where(d2 == 0, cont, ratio(np.maximum(c2 - discount, 0), d2) + discount * ratio(u2.astype(float), d2) * cont)
            kn3 = np.where(d3 == 0, kn2, ratio(np.maximum(c3 - discount, 0), d3) + discount * ratio(u3.astype(float), d3) * kn2)
            return {
                "p1": p1, "p2": p2, "p3": p3, "laplace": (c3 + alpha) / (d3 + alpha * v),
                "interpolation": weights[0] * p1 + weights[1] * p2 + weights[2] * p3,
                "backoff": np.where(c3 > 0, p3, np.where(c2 > 0, gamma * p2, gamma * gamma * p1)), "kneser_ney": kn3,
            }

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                t = groups(*part)
                total = np.zeros((len(SPLITS), 1 + 2 * len(methods)))
                for a in range(0, len(t["w"]), SLICE):
                    at = slice(a, a + SLICE)
                    m = t["m"][:, at].astype(float)
                    total[:, 0] += m.sum(axis=1)
                    for k, p in enumerate(made(t, at)[x] for x in methods):
                        log = np.log(p, out=np.zeros(len(p)), where=p > 0)
                        total[:, 1 + 2 * k] += m @ log
                        total[:, 2 + 2 * k] += m @ (p <= 0)
                cols = [pa.array(total[:, 0].astype(np.int64))]
                for k in range(len(methods)):
                    cols += [pa.array(total[:, 1 + 2 * k]), pa.array(total[:, 2 + 2 * k].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(SPLITS), *cols], names=["split", "events", *(f"{c}_{x}" for x in methods for c in "sz")])

        schema = "split string, events long, " + ", ".join(f"s_{x} double, z_{x} long" for x in methods)
        return self.merged.mapInArrow(run, schema)


def _blob(part: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in _pack(keys, counts))], names=["part", "keys", "counts"])


def _dealt(part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The keys of every part with the sums of their counts."""
    by = np.argsort(part, kind="stable")
    part, keys, counts = part[by], keys[by], counts[by]
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
    for a, b in zip(at, [*at[1:], len(part)]):
        yield _blob(part[a], *_summed(keys[a:b], counts[a:b]))


def _merged(blobs: DataFrame, parts: int) -> DataFrame:
    """One row a part: the sums of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts = None, [], []
        whole = lambda: _blob(part, *_summed(np.concatenate(keys), np.concatenate(counts)))
        for p, k, c in _parts(batches):
            if p != part and keys:
                yield whole()
                keys, counts = [], []
            part = p
            keys.append(k)
            counts.append(c)
        if keys:
            yield whole()

    return blobs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, _BLOBS)


WINDOW_CHUNK = 300_000


def windows(docs: DataFrame, vocab: DataFrame, window: int, weighted: bool = False) -> DataFrame:
    """w1, w2 and cnt within ``window`` places of the words that ``vocab`` (word, cnt) names, both ways.

    docs: words, an array. Words that aren't named take no place. With ``weighted`` a pair counts one
    over its distance, added up as whole numbers. A pair is summed up in one order of its words and given in
    both; pairs are dealt to parts by both words, so no frequent word is a burden.
    """
    unit = math.lcm(*range(1, window + 1)) if weighted else 1
    known = vocab.select("word", "cnt").persist()
    named = known.select("word").toArrow().column("word").to_pylist()
    tokens = known.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    known.unpersist()
    words = pa.array(sorted(named), pa.string())
    bits, parts = max(1, len(words).bit_length()), max(1, -(-tokens * window // (2 * EVENTS)))
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def rows(_, lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
        codes = lists.flatten().dictionary_encode()
        found = pc.index_in(codes.dictionary, value_set=sent.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        word, doc = found[codes.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(size)), size)
        on = word >= 0
        word, doc = word[on].astype(np.uint64), doc[on]
        keys, worth = [], []
        for d in range(1, window + 1):
            here = doc[d:] == doc[:-d]
            a, b = word[:-d][here], word[d:][here]
            keys.append(np.minimum(a, b) << np.uint64(bits) | np.maximum(a, b))
            worth.append(np.full(len(a), unit // d if weighted else 1))
        key = np.concatenate(keys)
        yield from _dealt((key % np.uint64(parts)).astype(np.uint32), key, np.concatenate(worth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _chunked(batches, rows, WINDOW_CHUNK)

    def named_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, counts in _parts(batches):
            for at in range(0, len(keys), 100_000):
                key, n = keys[at : at + 100_000], counts[at : at + 100_000]
                a, b = ((key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64))
                n = np.where(a == b, 2 * n, n)
                other = a != b
                w1, w2 = np.concatenate((a, b[other])), np.concatenate((b, a[other]))
                n = np.concatenate((n, n[other]))
                cnt = pa.array(n / unit) if weighted else pa.array(n)
                yield pa.RecordBatch.from_arrays([sent.value.take(pa.array(w1)), sent.value.take(pa.array(w2)), cnt], names=["w1", "w2", "cnt"])

    blobs = docs.select(F.lit(0).alias("k"), "words").mapInArrow(run, _BLOBS)
    return _merged(blobs, parts).mapInArrow(named_pairs, f"w1 string, w2 string, cnt {'double' if weighted else 'long'}")


def _chunked(batches: Iterator[pa.RecordBatch], rows, most: int) -> Iterator[pa.RecordBatch]:
    """``rows`` of about ``most`` words at a time."""
    held, n = [], 0
    for batch in batches:
        at = 0
        sizes = np.cumsum(pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, before + most - n, "right")))
            held.append(batch.slice(at, upto - at))
            n += int(sizes[upto - 1] - before)
            at = upto
            if n >= most or at < batch.num_rows:
                yield from _joined(held, rows)
                held, n = [], 0
    if held:
        yield from _joined(held, rows)


def _joined(held: list[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    return rows(table.column(0).chunk(0).to_numpy().astype(np.uint64), table.column(1).chunk(0))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            part, keys, counts = (x[k].as_py() for x in batch.columns)
            yield part, _unpack(keys, np.uint64), _unpack(counts, np.int64)


def _row(block: int, *arrays: np.ndarray) -> pa.RecordBatch:
    made = [v.nbytes.to_bytes(8, "little") + pa.compress(np.ascontiguousarray(v).tobytes(), "zstd", asbytes=True) for v in arrays]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in made)], names=["block", "one", "c1", "before"])


def perplexities(sums: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """split, method, events and ppl; a probability that isn't positive counts as 1e-12."""
    total = lambda x: F.sum(f"s_{x}") + F.sum(f"z_{x}") * F.log(F.lit(1e-12))
    wide = sums.groupBy("split").agg(F.sum("events").alias("events"), *(F.exp(-total(x) / F.sum("events")).alias(x) for x in names)).where("events > 0")
    return wide.select("split", "events", F.inline(F.array(*(F.struct(F.lit(x).alias("method"), F.col(x).alias("ppl")) for x in names))))


def unsmoothed(sums: DataFrame, names: tuple[str, ...] = ("p1", "p2", "p3")) -> DataFrame:
    """With zero_events; without a ppl where there are any."""
    made = [c for x in names for c in (F.sum(f"z_{x}").alias(f"z_{x}"), F.when(F.sum(f"z_{x}") == 0, F.exp(-F.sum(f"s_{x}") / F.sum("events"))).alias(x))]
    wide = sums.groupBy("split").agg(F.sum("events").alias("events"), *made).where("events > 0")
    return wide.select("split", "events", F.inline(F.array(*(F.struct(F.lit(x).alias("method"), F.col(f"z_{x}").alias("zero_events"), F.col(x).alias("ppl")) for x in names))))
