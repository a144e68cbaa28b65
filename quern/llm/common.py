"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SHARED_KEY = "spark.checkpoint.dir"
LOCAL_SHARED = "/tmp/checkpoints/quern"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; only where that is
    unset and all runs on one machine, as in tests, is a local folder taken.
    """
    found = spark.conf.get(SHARED_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SHARED_KEY} must name a folder that the driver and all executors share")
        found = LOCAL_SHARED
        spark.conf.set(SHARED_KEY, found)
    return found.rstrip("/")


class Workspace:
    """A fresh folder in the shared directory for tables that cut lineage.

    Frames read back from it stay valid until the Python process ends,
    when the folder is removed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
        atexit.register(self.remove)

    def file(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the frame that reads it."""
        df.write.mode("overwrite").parquet(self.file(name))
        return self.spark.read.schema(df.schema).parquet(self.file(name))

    def delete(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.file(name) if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def remove(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone at exit
            self.delete()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds), F.lit(0))


def _one_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is one scan of Parquet files, each named once, under filters
    and projections only, so that a file and a place in it stand for one row."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation":
        return False
    if relation.fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return False
    if any(n.lower() == "_metadata" for n in relation.schema().fieldNames()):
        return False
    paths = sorted(f"{p.rstrip('/')}/" for p in relation.location().rootPaths().mkString("\n").split("\n"))
    return not any(b.startswith(a) for a, b in zip(paths, paths[1:]))


def place_of(names: list[str], name: str) -> int:
    """The place of a column: by its exact name, else whatever the case."""
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


_HELD: dict[str, tuple[object, object]] = {}


def held(kind: str, key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, which a Python worker holds for its next tasks of this
    ``kind``: one thing, that of the last ``key``."""
    if kind not in _HELD or _HELD[kind][0] != key:
        _HELD.pop(kind, None)
        _HELD[kind] = key, make()
    return _HELD[kind][1]


def let_go(kind: str = "") -> None:
    """Free what a Python worker holds of other kinds.

    Workers serve one operator after the other and wait for a minute when idle,
    so what each of them held would add up in the executor's memory.
    """
    others = _HELD.keys() - {kind}
    for other in others:
        del _HELD[other]
    if others:
        gc.collect()
        with contextlib.suppress(Exception):  # glibc gives back what is free only when told to
            ctypes.CDLL(None).malloc_trim(0)


def kept_rows(
    docs: DataFrame, name: str, keep: Callable[[list], list[bool]], size: int = 1, holds: str = ""
) -> DataFrame:
    """The rows of ``docs`` for whose values in column ``name`` the function says true,
    with all their columns, whatever these are called. The function gets the values
    of about ``size`` bytes of rows at a time; ``holds`` is the kind of what it holds."""
    names = docs.columns
    k = place_of(names, name)
    plain = docs.toDF(*(f"c{j}" for j in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(holds)
        for parts in gathered(batches, size):
            kept = pa.array(keep([v for part in parts for v in part.column(k).to_pylist()]), pa.bool_())
            at = 0
            for part in parts:
                yield part.filter(kept.slice(at, part.num_rows))
                at += part.num_rows

    return plain.mapInArrow(run, plain.schema).toDF(*names)


class Placed:
    """A table whose rows can be told apart: ``rows`` has its columns as c0, c1, …
    by position, so that no name can clash, and ``_file`` and ``_row``, which
    identify each row in every later scan.

    Rows are told apart by the files that they are read from; where the table is
    more than a scan of files (exploded, joined, read twice, computed), it is
    written to ``space`` first.
    """

    def __init__(self, docs: DataFrame, space: Workspace):
        self.names = docs.columns
        plain = docs.toDF(*(f"c{k}" for k in range(len(self.names))))
        if not _one_scan(docs):
            plain = space.save(plain, f"placed-{uuid.uuid4().hex}")
        at = F.col("_metadata")
        self.rows = plain.select("*", at["file_path"].alias("_file"), at["row_index"].alias("_row"))

    def pick(self, **columns: str) -> DataFrame:
        """The columns of these names, under new names, with ``_file`` and ``_row``."""
        at = {new: F.col(f"c{place_of(self.names, old)}").alias(new) for new, old in columns.items()}
        return self.rows.select(*at.values(), "_file", "_row")

    def only(self, keys: DataFrame, how: str = "left_semi") -> DataFrame:
        """The rows that ``keys`` (of _file and _row) names, or with ``left_anti`` all
        others, as they came."""
        found = self.rows.join(keys.select("_file", "_row"), ["_file", "_row"], how)
        return found.drop("_file", "_row").toDF(*self.names)


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, holds: str = ""
) -> DataFrame:
    """mapInArrow over ``df`` for a function that yields dicts of columns; ``holds`` is
    the kind of what it holds."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        let_go(holds)
        for out in fn(batches):
            arrays = [_column(out[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def slices(batch: pa.RecordBatch, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``max_bytes`` of Arrow data.

    Single rows are never cut: a longer text is a part of its own.
    """
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Parts of batches, ``size`` bytes of them at a time."""
    held, n = [], 0
    for batch in batches:
        for part in slices(batch):
            held.append(part)
            n += part.nbytes
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held
