"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers are normalised to words; every run of ``window`` words
of an item (or the whole item if shorter) is a pattern. The automaton runs
over word numbers, so a text is scanned once, and what is found is mapped
back to the words and characters of the original.

An automaton is sent to the workers, so its size is bounded: more patterns
than ``MOST``, or more than ``BYTES`` of them, are dealt into several. A worker
then takes ``BUFFER`` bytes of texts at a time through one automaton after the
other, so the texts are still read once and what is found is merged in place.

Defined cases: a null text has no words and is clean; an item without words
has no pattern; a null item id reads as an empty string; repeated items count
once for each id; repeated rows are reported each; an empty benchmark leaves
everything clean; other columns of the input may have any names and come back
as they were.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, gathered, held, kept_rows, map_batches, slices

WINDOW = 10
MOST, BYTES = 200_000, 64 << 20
BUFFER = 64 << 20
HOLDS = "matcher"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-cases A-Z and blanks every other ASCII character but digits and a-z.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def windows_of(text: str | None, window: int = WINDOW) -> list[str]:
    w = words_of(text)
    if not w:
        return []
    n = min(window, len(w))
    return [b" ".join(w[i : i + n]).decode() for i in range(len(w) - n + 1)]


def patterns(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (pattern, items): the runs of words and the ids that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch):
                made = {
                    (p, i)
                    for i, t in zip(part.column("item").to_pylist(), part.column("text").to_pylist())
                    for p in windows_of(t, window)
                }
                yield {"pattern": [p for p, _ in made], "item": [i for _, i in made]}

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    found = map_batches(rows, run, "pattern string, item string")
    return found.groupBy("pattern").agg(F.collect_set("item").alias("items"))


class Matcher:
    """The automaton over word numbers."""

    def __init__(self, made: list[tuple[str, list[str]]]):
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, items in made:
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in pattern.encode().split(b" "))
            self.automaton.add_word(key, (len(key), items))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[list[int]], set[str]]:
        """Number of words, joined runs [start, end) of hit words, item ids."""
        w = words_of(text)
        runs: list[list[int]] = []
        items: set[str] = set()
        if not w or not self.numbers:
            return len(w), runs, items
        number = self.numbers.get
        for last, (n, ids) in self.automaton.iter(tuple([number(x, 0) for x in w])):
            items.update(ids)
            start = last + 1 - n
            while runs and runs[-1][1] >= start:
                start = min(start, runs.pop()[0])
            runs.append([start, last + 1])
        return len(w), runs, items


def join_runs(runs: list[list[int]]) -> list[list[int]]:
    """Runs that touch or overlap become one."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class Matchers:
    """The automata of all blocks. A Python worker keeps the last one that it
    built, so that with one block it is built once, not in every task."""

    def __init__(self, blocks: list):
        self.name, self.blocks = uuid.uuid4().hex, blocks

    def block(self, k: int) -> Matcher:
        def make() -> Matcher:
            made = Matcher(self.blocks[k].value)
            if len(self.blocks) > 1:
                self.blocks[k].__dict__.pop("_value", None)  # read again when needed
            return made

        return held(HOLDS, (self.name, k), make)

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[list[int]], set[str]]]:
        """What ``Matcher.scan`` gives for each text, over all blocks."""
        found = [self.block(0).scan(t) for t in texts]
        for k in range(1, len(self.blocks)):
            matcher = self.block(k)
            for j, text in enumerate(texts):
                n, runs, items = found[j]
                _, more, ids = matcher.scan(text)
                found[j] = (n, join_runs(runs + more), items | ids)
        return found


def matchers(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, most: int = MOST) -> Matchers:
    """The automata of a benchmark, with about ``most`` patterns each."""
    made = Workspace(spark, "decontamination").save(patterns(benchmark, window), "patterns")
    weight = F.aggregate("items", F.octet_length("pattern").cast("long"), lambda n, x: n + F.octet_length(x))
    n, size = made.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))).first()
    blocks, sent = max(1, -(-n // most), -(-size // BYTES)), []
    for k in range(blocks):
        part = made.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k)
        sent.append(spark.sparkContext.broadcast([(p, list(i)) for p, i in part.collect()]))  # about ``most`` patterns
    return Matchers(sent)


_LOWER = {65 + k: 97 + k for k in range(26)}


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """Per row: doc_id, n_words, hits (runs of words), chars (their places in the
    original text) and items."""
    found, kind = matchers(spark, benchmark, window, most), docs.schema["doc_id"].dataType.simpleString()
    size = BUFFER if len(found.blocks) > 1 else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for parts in gathered(batches, size):
            texts = [t for part in parts for t in part.column("text").to_pylist()]
            rows = iter(zip(texts, found.scan(texts)))
            for part in parts:
                out: dict = {"doc_id": part.column("doc_id"), "n_words": [], "hits": [], "chars": [], "items": []}
                for text, (n, runs, items) in islice(rows, part.num_rows):
                    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))] if runs else []
                    out["n_words"].append(n)
                    out["hits"].append([{"start": a, "end": b} for a, b in runs])
                    out["chars"].append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs])
                    out["items"].append(sorted(items))
                yield out

    spans = "array<struct<start: int, end: int>>"
    return map_batches(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words bigint, hits {spans}, chars {spans}, items array<string>", HOLDS
    )


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any run of benchmark words."""
    found = matchers(spark, benchmark, window)
    size = BUFFER if len(found.blocks) > 1 else 1
    return kept_rows(docs, "text", lambda texts: [not runs for _, runs, _ in found.scan(texts)], size, HOLDS)
