"""Queries on web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import pages as P
from .registry import query, table


def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g')"
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{sign}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(
    "link_extract",
    """SELECT page_id, link, min(i - 1)::int AS pos FROM (SELECT page_id, l[i] AS link, i FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i
       FROM (SELECT page_id, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS l FROM pages))) WHERE starts_with(link, '/t') GROUP BY ALL""",
)
def link_extract(spark, sf):
    return P.links(table(spark, sf, "pages"), "/t")


@query(
    "page_title",
    f"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<h1[\\s>]') THEN nullif({_plain("regexp_extract(html, '(?is)<h1(?:[^>]*)?>(.*?)</h1>', 1)")}, '')
        ELSE nullif({_plain("regexp_extract(html, '(?is)<title(?:[^>]*)?>(.*?)</title>', 1)")}, '') END AS title FROM pages""",
)
def page_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.title(F.col("html")).alias("title"))


@query(
    "page_date",
    f"""SELECT page_id, nullif(regexp_extract({_plain("html || '<p>10:05, 03 Mamyr 2024</p>'")}, '\\b\\d{{1,2}}:\\d{{2}},\\s*\\d{{2}}\\s+\\S+\\s+\\d{{4}}\\b'), '') AS raw FROM pages""",
)
def page_date(spark, sf):
    html = F.concat("html", F.lit("<p>10:05, 03 Mamyr 2024</p>"))
    return table(spark, sf, "pages").select("page_id", P.raw_date(html).alias("raw"))


@query("page_body")
def page_body(spark, sf):
    return P.bodies(table(spark, sf, "pages"))


@query(
    "crawl_plan",
    """WITH l AS (SELECT page_id % 5 AS bucket, page_id * 1000 + i AS ord, l[i] AS link FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i
         FROM (SELECT page_id, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS l FROM pages))),
       f AS (SELECT link, min({'bucket': bucket, 'ord': ord}) AS f FROM l GROUP BY link),
       r AS (SELECT f.bucket AS bucket, f.ord AS ord, link, row_number() OVER (PARTITION BY f.bucket ORDER BY f.ord, link) AS rn FROM f)
       SELECT bucket, ord, link FROM r WHERE rn <= 50 ORDER BY bucket, ord, link LIMIT 600""",
)
def crawl_plan(spark, sf):
    found = F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(found).alias("i", "link"))
    rows = rows.select((F.col("page_id") % 5).alias("bucket"), (F.col("page_id") * 1000 + F.col("i") + 1).alias("ord"), "link")
    return P.crawl_plan(rows, 50, 600)


@query(
    "incremental_new",
    "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)",
)
def incremental_new(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url")
    return P.unseen(rows.select("url"), rows.where("page_id % 3 = 0"))


@query("site_counts", "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain, count(*) AS n FROM pages GROUP BY ALL")
def site_counts(spark, sf):
    host = F.try_parse_url("url", F.lit("HOST")).alias("domain")
    return table(spark, sf, "pages").groupBy(host).agg(F.count(F.lit(1)).alias("n"))
