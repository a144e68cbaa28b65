"""Files that the corpus tools read and write, as DataFrames."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

DOCUMENT = (
    "url string, domain string, title string, datetime_raw string, text string, scraped_at string,"
    " lang_script string, source string, category string, subcategory string"
)


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a line; blank lines are skipped, bad ones fail.

    Without a schema it is inferred, so unknown keys pass through.
    """
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the raw lines that aren't blank, as audits of missing keys need them."""
    return spark.read.text(path).where(F.trim("value") != "")


def write_documents(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; null fields are written."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """word and cnt of a vocabulary file, tab-separated, without a header."""
    return spark.read.schema("word string, cnt long").option("sep", "\t").option("quote", "").csv(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """By falling frequency, ties by word."""
    rows = counts.select("word", "cnt").orderBy(F.desc("cnt"), "word")
    rows.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def read_confusions(spark: SparkSession, path: str) -> DataFrame:
    """a, b and cnt; a line without three fields fails."""
    reader = spark.read.schema("a string, b string, cnt long").option("sep", "\t").option("quote", "")
    return reader.option("mode", "FAILFAST").csv(path)


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """rank (from 1), a and b; the rank is the line's number."""
    whole = spark.read.text(path, wholetext=True)  # a model of chosen size
    rows = whole.select(F.posexplode(F.split("value", "\\r?\\n")).alias("n", "line")).where(F.trim("line") != "")
    pair = F.split("line", " ")
    return rows.select((F.col("n") + 1).alias("rank"), F.get(pair, 0).alias("a"), F.get(pair, 1).alias("b"))


def write_merges(spark: SparkSession, merges: list[tuple], path: str) -> None:
    rows = spark.createDataFrame([(f"{m[0]} {m[1]}",) for m in merges], "value string")
    rows.coalesce(1).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word and vec; lines of fewer than three fields (as a header) or with bad numbers are skipped."""
    parts = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 3)
    vec = F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.try_cast("float"))
    rows = rows.select(F.get("p", 0).alias("word"), vec.alias("vec"))
    return rows.where(~F.exists("vec", lambda x: x.isNull()))


def write_vectors(vectors: DataFrame, path: str) -> None:
    rows = vectors.select(F.concat_ws(" ", "word", F.transform("vec", lambda x: x.cast("string"))).alias("value"))
    rows.write.mode("overwrite").text(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """review and sentiment (1 or 0) of a CSV with commas or, failing that, semicolons."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    rows = reader.csv(path)
    if "sentiment" not in rows.columns:
        rows = reader.option("sep", ";").csv(path)
    rows = rows.select(F.trim("review").alias("review"), F.lower(F.trim("sentiment")).alias("mark")).na.drop()
    mark = F.when(F.col("mark") == "positive", 1).when(F.col("mark") == "negative", 0)
    return rows.select("review", mark.alias("sentiment")).where(F.col("sentiment").isNotNull())


def write_texts(texts: DataFrame, path: str, column: str = "text") -> None:
    """One text a line, its white space squeezed."""
    line = F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s+", " "))
    texts.select(line.alias("value")).write.mode("overwrite").text(path)


# The marks of an evaluation file.
GOLD = "GOLD (YOU EDIT BELOW THIS LINE):"
GOLD_NONE = "[PASTE SNIPPET HERE AND ADD NEWLINES FOR SENTENCE BREAKS]"
SAMPLE = "=== SAMPLE"


def gold_blocks(text: Column) -> Column:
    """The marked blocks of an evaluation file: for each, its lines that aren't empty."""
    quoted = F.lit("\\Q" + GOLD + "\\E")
    blocks = F.split(text, quoted)
    blocks = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))

    def lines(block: Column) -> Column:
        head = F.get(F.split(block, F.lit("\\Q" + SAMPLE + "\\E")), F.lit(0))
        return F.filter(F.transform(F.split(head, "\\R"), T.strip), lambda x: (x != "") & (x != GOLD_NONE))

    return F.transform(blocks, lines)


def ranked_table(rows: DataFrame, path: str) -> None:
    """CSV, TSV and Markdown of a small ranked table, side by side."""
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}.csv")
    rows.coalesce(1).write.mode("overwrite").option("header", "true").option("sep", "\t").csv(f"{path}.tsv")
    rows.sparkSession.createDataFrame([(markdown(rows),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.md")


def markdown(rows: DataFrame) -> str:
    """A report's table as Markdown, row by row; what goes into a report is of a chosen size."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join(map(str, r)) + " |" for r in rows.toLocalIterator())])


def plain(value):
    """For JSON: rows become dicts; infinite numbers stay (as Infinity), undefined ones become null."""
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return None if isinstance(value, float) and math.isnan(value) else value


def write_report(report: dict, path: str) -> None:
    """A report of small parts; a DataFrame in it becomes a list of all its rows."""
    made = {k: list(v.toLocalIterator()) if isinstance(v, DataFrame) else v for k, v in report.items()}
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(plain(made), ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def read_report(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def exists(spark, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
