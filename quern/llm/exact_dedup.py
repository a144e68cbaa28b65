"""Exact deduplication as a stateful stream with disk-backed keyed state.

Each arriving row is reduced to a digest, its identifier and a locator of its
content. A streaming aggregation keyed by digest keeps, in RocksDB and without
expiry, the greatest identifier seen, where its content lies, and a count.
Digests that were hit more than once are then checked on the full bytes, so a
digest collision can't merge different texts.

Only DataFrame operations and Structured Streaming are used.

Defined cases: a null text counts as empty; rows that are equal in text and
identifier keep exactly one of them; a null identifier loses to any other; an
empty table gives an empty result; rows that a join or an explode made, or a
file that is read twice, are rows of their own; other columns of the input may
have any names and come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Placed, Workspace, lower_ascii

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no space set aside for each of many stores
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # a store is closed when its task ends, so that an executor holds one a core and not all
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
#: Bits of the map that tells rows of hit digests: 16 for each, within these
#: bounds (2 and 128 MiB). Beyond, the digests are joined instead.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 30


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


class StreamingDeduplicator:
    """Keyed state in a shared folder that survives between ingests."""

    def __init__(self, spark: SparkSession, digest: Callable[[Column], Column] = sha256):
        self.spark, self.digest = spark, digest
        self.space = Workspace(spark, "dedup")
        self.rows: DataFrame | None = None
        self.docs: DataFrame | None = None
        self.epochs: list[int] = []

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add rows to the state; may be called again with further rows."""
        self.add(Placed(docs, self.space).pick(id=id_col, text=text_col))

    def add(self, rows: DataFrame) -> None:
        """Add rows of id, text, _file and _row."""
        norm = lower_ascii(F.col("text"))
        base = rows.select("id", self.digest(norm).alias("digest"), norm.alias("norm"), "_file", "_row")
        narrow = base.select("id", "digest", "_file", "_row")
        narrow.write.mode("append").parquet(self.space.file("inbox"))
        self.docs = base if self.docs is None else self.docs.unionByName(base)
        self.rows = self.spark.read.schema(narrow.schema).parquet(self.space.file("inbox"))
        self._advance(narrow)

    def _advance(self, narrow: DataFrame) -> None:
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in STREAM_CONF}
        for k, v in STREAM_CONF.items():
            conf.set(k, v)
        try:
            seen = (
                self.spark.readStream.schema(narrow.schema)
                .parquet(self.space.file("inbox"))
                .groupBy("digest")
                .agg(F.max(F.struct("id", "_file", "_row")).alias("best"), F.count(F.lit(1)).alias("n"))
            )

            def save(batch: DataFrame, epoch: int) -> None:
                batch.write.mode("overwrite").parquet(self.space.file(f"state/epoch={epoch}"))
                self.epochs.append(epoch)

            (
                seen.writeStream.outputMode("update")
                .foreachBatch(save)
                .option("checkpointLocation", self.space.file("stream"))
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def state(self) -> DataFrame:
        """digest, best (id and locator of the row that stays), n."""
        if not self.epochs:
            row = "digest string, best struct<id: {}, _file: string, _row: bigint>, n bigint"
            kind = self.rows.schema["id"].dataType.simpleString()
            return self.spark.createDataFrame([], row.format(kind))
        found = self.spark.read.parquet(self.space.file("state"))
        if len(set(self.epochs)) == 1:
            return found.select("digest", "best", "n")
        last = F.max(F.struct("epoch", "best", "n")).alias("last")
        return found.groupBy("digest").agg(last).select("digest", "last.best", "last.n")

    def _hits_by_text(self) -> DataFrame:
        """Rows of hit digests grouped by digest and full text.

        A map of hashed digests keeps most other texts out of the shuffle; the
        aggregation over whole texts combines copies before it. Digests too many
        for the map are joined, which shuffles texts once, by digest.
        """
        hits = self.state().where("n > 1").select("digest")
        wanted = 16 * hits.count()
        rows = self.docs.select("digest", "norm")
        if wanted > MOST_BITS:
            rows = rows.join(hits, "digest", "left_semi")
        else:
            rows = self._mapped(rows, hits, 1 << max(wanted - 1, LEAST_BITS - 1).bit_length())
        return rows.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))

    @staticmethod
    def _mapped(rows: DataFrame, hits: DataFrame, bits: int) -> DataFrame:
        """The rows whose digest is marked in a map of ``bits`` bits, sent out in blocks of 4 KiB."""
        bit = F.pmod(F.xxhash64("digest"), F.lit(bits))
        blocks = (
            hits.select(bit.alias("bit"))
            .groupBy(F.bitmap_bucket_number("bit").alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
        )
        at = F.col("at")
        byte = F.conv(F.hex(F.substring("map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        spot = F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0
        rows = rows.withColumn("block", F.bitmap_bucket_number(bit)).withColumn("at", F.bitmap_bit_position(bit))
        return rows.join(F.broadcast(blocks), "block").where(spot)  # MOST_BITS / 8 bytes at most

    def result(self) -> DataFrame:
        """One row per ingested row: doc_id, keep_id, group_size, kept, text_sha256, _file, _row."""
        by_text = self._hits_by_text().groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
        clashes = self.space.save(by_text.where("texts > 1").select("digest"), "clashes")
        # AQE splits a digest with very many rows: nothing above the join needs them together
        rows = self.rows.join(self.state(), "digest", "left")
        same_row = (F.col("_file") == F.col("best._file")) & (F.col("_row") == F.col("best._row"))
        out = [
            F.col("id").alias("doc_id"),
            F.col("best.id").alias("keep_id"),
            F.col("n").alias("group_size"),
            same_row.alias("kept"),
            F.col("digest").alias("text_sha256"),
            "_file",
            "_row",
        ]
        if clashes.isEmpty():
            return rows.select(*out)
        # texts that share a digest are told apart by their bytes
        rest = self.docs.join(clashes, "digest", "left_semi")
        best = rest.groupBy("digest", "norm").agg(
            F.max(F.struct("id", "_file", "_row")).alias("best"), F.count(F.lit(1)).alias("n")
        )
        rest = rest.join(best, ["digest", "norm"])
        return rows.join(clashes, "digest", "left_anti").select(*out).unionByName(rest.select(*out))


def dedup(spark: SparkSession, docs: DataFrame, **kw) -> DataFrame:
    """Deduplicate one finite table; see ``StreamingDeduplicator.result``."""
    d = StreamingDeduplicator(spark, **kw)
    d.ingest(docs)
    return d.result()


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that deduplication keeps, with all their columns."""
    d = StreamingDeduplicator(spark)
    placed = Placed(docs, d.space)
    d.add(placed.pick(id="doc_id", text="text"))
    return placed.only(d.result().where("kept"))
