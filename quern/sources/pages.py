"""Web pages as tables: links, titles, dates, bodies, crawl plans."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def plain(html: Column) -> Column:
    """Text without tags, with the common character references."""
    text = F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</\\1>|<!--.*?-->|<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def links(pages: DataFrame, prefix: str = "/news/", base: str = "") -> DataFrame:
    """page_id, pos and link: every first link with the prefix, in page order."""
    found = F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "link")).where(F.startswith("link", F.lit(prefix)))
    rows = rows.select("page_id", "pos", F.concat(F.lit(base), "link").alias("link"))
    return rows.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))


def title(html: Column) -> Column:
    """The first h1; only without any, the title; null if empty."""
    one = lambda tag: F.nullif(plain(F.regexp_extract(html, f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1)), F.lit(""))
    return F.when(html.rlike("(?i)<h1[\\s>]"), one("h1")).otherwise(one("title"))


def raw_date(html: Column) -> Column:
    found = F.regexp_extract(plain(html), r"\b\d{1,2}:\d{2},\s*\d{2}\s+\S+\s+\d{4}\b", 0)
    return F.nullif(found, F.lit(""))


class _Body(HTMLParser):
    def __init__(self):
        super().__init__()
        self.depth, self.p, self.article, self.parts = 0, None, [], []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag == "p":
            self._end()
            self.p = []

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag == "p":
            self._end()

    def _end(self):
        if self.p is not None:
            self.parts.append(" ".join(" ".join(self.p).split()))
        self.p = None

    def handle_data(self, data):
        if self.depth > 0 and data.strip():
            self.article.append(data.strip())
        if self.p is not None:
            self.p.append(data)


def body_of(html: str | None, shortest: int = 250, drop: str = "") -> str | None:
    """Text of the article element if long enough, else the paragraphs together."""
    reader = _Body()
    reader.feed(html or "")
    reader._end()
    whole = "\n".join(reader.article)
    if len(whole) > 300:
        return whole
    parts = [p.replace(drop, "").strip() if drop else p for p in reader.parts]
    text = "\n".join(p for p in parts if p)
    return text if len(text) >= shortest else None


def bodies(pages: DataFrame, shortest: int = 250, drop: str = "") -> DataFrame:
    """page_id, url, title, datetime_raw, domain and text; too short ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # one page at a time is a Python object
                batch = whole.slice(at, 256)
                text = pa.array((body_of(h.as_py(), shortest, drop) for h in batch.column(5)), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], text], names=[*batch.schema.names[:5], "text"])

    rows = pages.select(
        "page_id", "url", title(F.col("html")).alias("title"), raw_date(F.col("html")).alias("datetime_raw"),
        F.try_parse_url("url", F.lit("HOST")).alias("domain"), F.col("html").alias("text"),
    )
    rows = rows.mapInArrow(run, rows.schema)
    return rows.where(F.length("text") >= shortest)


def crawl_plan(found: DataFrame, each: int, most: int) -> DataFrame:
    """First-come distinct links, at most ``each`` a bucket and ``most`` in all.

    found: bucket, ord, link.
    """
    first = found.groupBy("link").agg(F.min(F.struct("bucket", "ord")).alias("f")).select("f.bucket", "f.ord", "link")
    inner = Window.partitionBy("bucket").orderBy("ord", "link")
    some = first.withColumn("rn", F.row_number().over(inner)).where(F.col("rn") <= each)
    return some.orderBy("bucket", "ord", "link").limit(most).select("bucket", "ord", "link")


def unseen(rows: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose address isn't there yet, one for each address."""
    return rows.join(seen.select(key), key, "left_anti").dropDuplicates([key])
