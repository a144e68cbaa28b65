"""Which addresses a site's robots file lets an agent fetch."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 1000


def _parsed(text: str | None) -> RobotFileParser:
    parser = RobotFileParser()
    parser.parse((text or "").splitlines())
    return parser


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """``urls`` (column url) with ``allowed``.

    robots: host and text, one file a host. A host without a file, or an
    address without a host, is allowed everything.
    """
    files = robots.groupBy("host").agg(F.min("text").alias("_robots"))
    rows = urls.withColumn("_host", F.try_parse_url("url", F.lit("HOST")))
    rows = rows.join(files, F.col("_host") == F.col("host"), "left").drop("host", "_host")

    @F.pandas_udf("boolean")
    def may(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        seen: dict[str | None, RobotFileParser] = {}
        for url, text in parts:
            out = []
            for u, t in zip(url, text):
                if t not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[t] = _parsed(t)
                out.append(u is None or t is None or seen[t].can_fetch(agent, u))
            yield pd.Series(out)

    return rows.withColumn("allowed", may("url", "_robots")).drop("_robots")
