"""SimHash near-deduplication with pigeonhole blocks.

A document's fingerprint has bit b set when over half of its shingle hashes
have it. Two fingerprints that differ in at most three bits agree in two of
five blocks, so each distinct fingerprint is filed under the ten pairs of
blocks; those filed together are compared in full. A file of many
fingerprints is filed again, by four blocks of the bits that it leaves open
(a near pair agrees in one of them), which cuts it to a thousandth or so. What
still exceeds a chunk is dealt out as pairs of chunks, so no task holds more
than two, and every unit of work returns a spanning forest instead of all its
pairs. Connected components of the forests are the groups.

Work grows with the number of distinct fingerprints; with its square only among
those that share a block pair and a further block, past ``CHUNK`` of them.

Defined cases: a null or blank text has fingerprint zero and is linked like
any other; texts of fewer words than a shingle hash their whole sequence; a
null id is linked but never names a group unless all ids of it are null;
repeated rows share their group; rows that a join or an explode made are rows of
their own; other columns of the input may have any names and come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Placed, Workspace, map_batches, slices
from .components import components

SEED = 42
DISTANCE = 3
WIDTHS = (13, 13, 13, 13, 12)
CHUNK = 4096
STEP = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), STEP):
        part = h[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, _file, _row and fp (the fingerprint's bits as a signed long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch):
                fp = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64)
                yield {k: part.column(k) for k in ("doc_id", "_file", "_row")} | {"fp": fp.view(np.int64)}

    rows = docs.select("doc_id", "_file", "_row", "text")
    return map_batches(rows, run, f"doc_id {kind}, _file string, _row bigint, fp bigint")


PAIRS = tuple(combinations(range(len(WIDTHS)), len(WIDTHS) - DISTANCE))
AGAIN = 10  # bits of a block of those that a pair of blocks leaves open


def _blocks() -> list[F.Column]:
    low = np.cumsum((0, *WIDTHS))
    return [F.shiftrightunsigned("fp", int(a)).bitwiseAND(F.lit((1 << w) - 1)) for a, w in zip(low, WIDTHS)]


def _keys() -> F.Column:
    """The file names of a fingerprint: for two blocks of five, their numbers and bits."""
    block = _blocks()
    return F.array(
        *(F.shiftleft(F.lit(k).cast("long"), 26) + F.shiftleft(block[i], 13) + block[j] for k, (i, j) in enumerate(PAIRS))
    )


def _further() -> F.Column:
    """The names of a fingerprint in a file (``key``) by blocks of its other bits."""
    block, open_bits = _blocks(), []
    for pair in PAIRS:
        at, bits = 0, F.lit(0).cast("long")
        for k in range(len(WIDTHS)):
            if k not in pair:
                bits, at = bits + F.shiftleft(block[k], at), at + WIDTHS[k]
        open_bits.append(bits)
    rest = F.get(F.array(*open_bits), F.shiftright("key", 26).cast("int"))
    name = F.lit(1 << 50) + F.shiftleft("key", AGAIN + 2)
    each = [F.shiftrightunsigned(rest, AGAIN * s).bitwiseAND(F.lit((1 << AGAIN) - 1)) for s in range(DISTANCE + 1)]
    return F.array(*(name + (s << AGAIN) + x for s, x in enumerate(each)))


def forest(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges (least of its component, member) that connect what is near."""
    rest, edges = np.unique(values), []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        todo = [root]
        while todo and len(rest):
            near = np.bitwise_count((rest ^ todo.pop()).view(np.uint64)) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                todo.extend(found)
                edges.extend((int(root), int(x)) for x in found)
    return edges


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows come sorted by unit (key, i, j); a unit holds two chunks at most."""
    unit, held = None, np.empty(0, np.int64)
    for batch in batches:
        key, i, j, fp = (batch.column(k).to_numpy() for k in ("key", "i", "j", "fp"))
        if not len(fp):
            continue
        cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        starts = np.concatenate(([0], cut, [len(fp)]))
        edges: list[tuple[int, int]] = []
        for a, b in zip(starts[:-1], starts[1:]):
            now = (key[a], i[a], j[a])
            if now != unit:
                edges += forest(held)
                unit, held = now, fp[a:b]
            else:
                held = np.concatenate((held, fp[a:b]))
        yield {"u": [x[0] for x in edges], "v": [x[1] for x in edges]}
    edges = forest(held)
    yield {"u": [x[0] for x in edges], "v": [x[1] for x in edges]}


def _sized(filed: DataFrame) -> DataFrame:
    """fp, key and m, the size of the file, for files of two and more.

    AQE splits a file with very many rows: the join needs them together no more.
    """
    sizes = filed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return filed.join(sizes, "key")


def links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) that span each component of distinct ``fps`` (column fp)."""
    filed = _sized(fps.select("fp", F.explode(_keys()).alias("key")))
    large = filed.where(F.col("m") > chunk).select("fp", F.explode(_further()).alias("key"))
    filed = filed.where(F.col("m") <= chunk).unionByName(_sized(large))
    filed = filed.withColumn("c", F.ceil(F.col("m") / chunk).cast("int"))
    filed = filed.withColumn("h", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    units = filed.select("key", "fp", "h", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("x"))
    units = units.select("key", F.least("h", "x").alias("i"), F.greatest("h", "x").alias("j"), "fp")
    units = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return map_batches(units, _forests, "u bigint, v bigint").distinct()


def near_groups(spark: SparkSession, docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per document: doc_id, _file, _row, fp, component_id, kept.

    component_id is the least id that can be reached; kept marks the row of
    that id (of several, the first stored).
    """
    space = Workspace(spark, "simhash")
    return _grouped(Placed(docs, space).pick(doc_id="doc_id", text="text"), space, words)


def _grouped(rows: DataFrame, space: Workspace, words: int) -> DataFrame:
    rows = space.save(fingerprints(rows, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row"))
    fps = space.save(rows.groupBy("fp").agg(first.alias("first")), "distinct")
    roots = components(links(fps.select("fp")), space)
    labels = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    labels = labels.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = labels.groupBy("root").agg(F.min("first").alias("best"))
    labels = space.save(labels.join(best, "root").select("fp", "best"), "labels")
    same_row = (F.col("_file") == F.col("best._file")) & (F.col("_row") == F.col("best._row"))
    # AQE splits a fingerprint with very many rows: nothing above the join needs them together
    return rows.join(labels, "fp").select(
        "doc_id", "_file", "_row", "fp", F.col("best.doc_id").alias("component_id"), same_row.alias("kept")
    )


def keep_first(spark: SparkSession, docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    space = Workspace(spark, "simhash")
    placed = Placed(docs, space)
    return placed.only(_grouped(placed.pick(doc_id="doc_id", text="text"), space, words).where("kept"))
