"""What is read out of pages by pattern: links, sitemap locations, challenges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa.operators.latest import first_by


def links(pages: DataFrame, pattern: str) -> DataFrame:
    """page_id, link and position (from 1) of what the pattern's group finds in html, each link at its first place."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("position", "link"))
    first = found.groupBy("page_id", "link").agg((F.min("position") + 1).cast("long").alias("position"))
    return first


def sitemap_locations(sitemaps: DataFrame, keep: Column | None = None, limit: int | None = None) -> DataFrame:
    """loc entries of sitemaps (name, xml) in page order, unescaped, those that the condition on ``url`` keeps."""
    found = sitemaps.select("name", F.posexplode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("position", "url"))
    found = found.withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&")))
    found = found.filter(keep) if keep is not None else found
    return found if limit is None else found.orderBy("name", "position").limit(limit)


def known_urls(urls: DataFrame, limit: int = 300) -> DataFrame:
    """urls (position, url), one for each number at the end of the path, the first one, at most 1 to 300 of them."""
    if not 1 <= limit <= 300:
        raise ValueError("limit must be 1 to 300")
    sku = urls.withColumn("sku", F.regexp_extract("url", r"([0-9]+)/?(?:[?#].*)?$", 1)).filter("sku <> ''")
    return first_by(sku, ["sku"], [F.col("position").asc()]).orderBy("position").limit(limit)


def is_challenge(html: Column, marks: tuple[str, ...] = ("captcha", "access denied", "verify you are human", "robot or human")) -> Column:
    """Whether a page asks for proof of being human rather than showing its content."""
    low, out = F.lower(html), F.lit(False)
    for m in marks:
        out = out | F.contains(low, F.lit(m))
    return out
