"""Robots files and joined phrases."""

from pyspark.sql import functions as F

from quern.operators import matrices
from quern.sources import robots


def test_robots(spark):
    urls = [("https://a.example/x", False), ("https://a.example/open", True), ("https://b.example/x", True), (None, True)]
    files = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /x\n")], "host string, text string")
    rows = spark.createDataFrame([(u,) for u, _ in urls], "url string")
    assert {r.url: r.allowed for r in robots.allowed(rows, files).collect()} == dict(urls)


def test_joined_phrases(spark):
    rows = spark.createDataFrame([(["new", "york", "new", "york", "city"],), (["york"],), ([],), (["new"],)], "w array<string>")
    known = F.array(F.lit("new york"), F.lit("york city"))
    got = [r[0] for r in rows.select(matrices.joined(F.col("w"), known)).collect()]
    assert got == [["new_york", "new_york", "city"], ["york"], [], ["new"]]
