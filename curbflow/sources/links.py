"""Published links: anchors of raw HTML pages, resolved against the page's own address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Comments, scripts and styles are not markup: an anchor written inside them is no link.
NOT_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
ANCHOR_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
BASE_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"

# Dot segments are walked only where a path has some.
_WALK = (
    "array_join(aggregate(split({p}, '/'), CAST(array() AS array<string>), (kept, part) -> CASE "
    "WHEN part = '.' THEN kept "
    "WHEN part = '..' THEN CASE WHEN size(kept) > 1 THEN slice(kept, 1, size(kept) - 1) ELSE kept END "
    "ELSE concat(kept, array(part)) END), '/')"
)


def _plain(path: str) -> str:
    return f"CASE WHEN {path} RLIKE '(^|/)[.][.]?(/|$)' THEN {_WALK.format(p=path)} ELSE {path} END"


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per anchor of a page: its raw href, the absolute URL and the file name."""
    found = pages.select(
        key,
        F.col("url").alias("base"),
        F.explode(
            F.regexp_extract_all(
                F.regexp_replace("html", NOT_MARKUP, " "), F.lit(ANCHOR_HREF), F.lit(1)
            )
        ).alias("quoted"),
    )
    bare = F.regexp_replace("quoted", r"""^["']|["']$""", "")
    hrefs = found.select(
        key, "base", F.trim(F.replace(bare, F.lit("&amp;"), F.lit("&"))).alias("href")
    ).where("href <> ''")
    parts = hrefs.selectExpr(
        key,
        "href",
        f"regexp_extract(base, r'{ORIGIN}', 1) AS origin",
        f"regexp_extract(base, r'{BASE_PATH}', 1) AS base_path",
        "regexp_extract(base, '^[^#]*', 0) AS base_page",
        "regexp_extract(base, '^[^?#]*', 0) AS base_bare",
        "regexp_extract(href, '^[^?#]*', 0) AS path",
        "regexp_extract(href, '[?#].*$', 0) AS tail",
    )
    folder = "regexp_extract(base_path, '^.*/', 0)"
    relative = f"concat(CASE WHEN {folder} = '' THEN '/' ELSE {folder} END, path)"
    resolved = parts.selectExpr(
        key,
        "href",
        f"""CASE
          WHEN href RLIKE r'{SCHEME}' THEN href
          WHEN startswith(href, '//') THEN concat(regexp_extract(origin, r'{SCHEME}', 0), href)
          WHEN startswith(href, '/') THEN concat(origin, {_plain("path")}, tail)
          WHEN startswith(href, '?') THEN concat(base_bare, href)
          WHEN startswith(href, '#') THEN concat(base_page, href)
          ELSE concat(origin, {_plain(relative)}, tail)
        END AS url""",
    )
    last = f"regexp_extract(regexp_extract(url, r'{BASE_PATH}', 1), '[^/]*$', 0)"
    return resolved.selectExpr(
        "*", f"coalesce(try_url_decode(replace({last}, '+', '%2B')), {last}) AS filename"
    )


def trip_links(links: DataFrame) -> DataFrame:
    """Links that name a monthly trip file."""
    return links.where("endswith(filename, '.parquet') AND contains(filename, '_tripdata_')")


def link_conflicts(links: DataFrame) -> DataFrame:
    """File names published under more than one URL."""
    return (
        links.select("filename", "url")
        .distinct()
        .groupBy("filename")
        .agg(F.count(F.lit(1)).alias("urls"))
        .where("urls > 1")
    )


def published_only(catalog: DataFrame, links: DataFrame, historical_years: list[int]) -> DataFrame:
    """Catalog entries that count: historical ones always, current ones only when linked."""
    historical = catalog.where(F.col("year").isin(historical_years))
    current = catalog.where(~F.col("year").isin(historical_years))
    linked = links.select("filename").distinct()
    return historical.unionByName(current.join(linked, "filename", "left_semi"))
