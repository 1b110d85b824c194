"""Landed web pages: routing, links, enumeration and body text."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from versegrid.functions.html_body import SITE_RULES, BodyRule, page_body
from versegrid.functions.text import clean_text, strip_suffix
from versegrid.operators.ranking import global_row_number

# Index letters and address of the artist lists.
ARTIST_INDICES = ("1",) + tuple("abcdefghijklmnopqrstuvwxyz")
ARTISTS_PAGE = "http://www.metrolyrics.com/artists-%s-%d.html"


def route(url: Column, rules=SITE_RULES) -> Column:
    """Number of the first rule whose pattern matches the start of ``url``; else null."""
    return F.coalesce(*[
        F.when(url.rlike(rule.url_regex if rule.url_regex.startswith("^") else "^" + rule.url_regex), F.lit(i))
        for i, rule in enumerate(rules)
    ])


def routed(pages: DataFrame, rules=SITE_RULES, url: str = "url") -> DataFrame:
    """Pages that a rule takes, with ``rule_no`` and ``site``; others are skipped."""
    sites = F.array(*[F.lit(rule.site) for rule in rules])
    numbered = pages.withColumn("rule_no", route(F.col(url), rules)).filter(F.col("rule_no").isNotNull())
    return numbered.withColumn("site", sites[F.col("rule_no")])


def rejected(pages: DataFrame, rule: BodyRule, url: str = "url") -> DataFrame:
    """Pages a single extractor refuses because their address is not its own."""
    return pages.filter(route(F.col(url), [rule]).isNull())


def require_route(pages: DataFrame, rule: BodyRule, url: str = "url") -> DataFrame:
    """The same pages; evaluation fails on one with a foreign address."""
    message = F.concat(F.lit(f"{rule.site} cannot extract from URL "), F.col(url))
    checked = F.when(route(F.col(url), [rule]).isNotNull(), F.col(url)).otherwise(F.raise_error(message))
    return pages.withColumn(url, checked)


def with_body(pages: DataFrame, rules=SITE_RULES, html: str = "html", rule_no: str = "rule_no") -> DataFrame:
    """Add ``body``, the text that rule ``rule_no`` finds in ``html``, null without one.

    Only the two input columns travel to Python, in Arrow batches, of which one page at a
    time becomes a Python string. The function is declared non-deterministic because Catalyst
    would otherwise repeat it below joins and in filters, and each page should be parsed once.
    """
    rules = tuple(rules)

    @F.arrow_udf("string")
    def body(pages_html: pa.Array, numbers: pa.Array) -> pa.Array:
        return pa.array((page_body(h.as_py(), rules[n.as_py()]) for h, n in zip(pages_html, numbers)), pa.string())

    return pages.withColumn("body", body.asNondeterministic()(F.col(html), F.col(rule_no)))


def nonempty(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value other than the empty string."""
    return df.filter(F.col(column) != "")


def extract_bodies(pages: DataFrame, key: str = "trackid", rules=SITE_RULES) -> DataFrame:
    """``(key, lyrics)``: routed, extracted, and cleaned where anything was found.

    A body that cleaning empties stays.
    """
    found = nonempty(with_body(routed(pages, rules), rules), "body")
    return found.select(key, clean_text(F.col("body")).alias("lyrics"))


class LinkLayout(NamedTuple):
    """Where the links of a list page are: container, row start, link in a row.

    ``container`` has one group, the inner markup; ``link`` two, address and text.
    """

    container: str
    row: str
    link: str


_HREF_AND_TEXT = r"""<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
ARTIST_TABLE = LinkLayout(
    r"""(?is)<table\b[^>]*?\bclass\s*=\s*["'](?:[^"']*\s)?songs-table(?:\s[^"']*)?["'][^>]*>(.*?)</table>""",
    r"(?i)<tr\b[^>]*>",
    r"(?is)<td\b.*?" + _HREF_AND_TEXT,
)
SONG_TABLE = LinkLayout(
    r"""(?is)<table\b[^>]*?\bclass\s*=\s*["']songs-table compact["'][^>]*>(.*?)</table>""",
    r"(?i)<tr\b[^>]*>",
    r"(?is)<td(?![^>]*\bclass\b)[^>]*>.*?" + _HREF_AND_TEXT,
)


def plain_text(markup: Column) -> Column:
    """Text of a short piece of markup: tags removed, the common entities resolved."""
    text = F.regexp_replace(markup, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                         ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def list_links(pages: DataFrame, keys: list[str], layout: LinkLayout, compat: bool = False) -> DataFrame:
    """``(*keys, pos, href, name)``: one link per row of the page's list."""
    inner = F.regexp_replace(F.regexp_extract("html", layout.container, 1), r"(?is)<thead\b.*?</thead>", "")
    pieces = F.split(inner, layout.row)
    rows = pages.select(*keys, F.posexplode(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))))
                        .alias("pos", "_row"))
    linked = rows.filter(F.col("_row").rlike(layout.link))
    name = plain_text(F.regexp_extract("_row", layout.link, 2))
    return linked.select(
        *keys, "pos",
        F.regexp_extract("_row", layout.link, 1).alias("href"),
        strip_suffix(name, compat=compat).alias("name"),
    )


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, href)`` of every double-quoted link of a page."""
    return pages.select(key, F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))


def songs_page_pattern(href: Column) -> Column:
    """``x-lyrics.html`` -> ``x-alpage-{}.html``; other addresses stay as they are."""
    return F.regexp_replace(href, "-lyrics.html$", "-alpage-{}.html")


def songs_page_url(pattern: Column, page: Column) -> Column:
    return F.replace(pattern, F.lit("{}"), page.cast("string"))


def artist_page_url(idx_ord: Column, page: Column) -> Column:
    """Address of a page of the artist list with the given index number."""
    idx = F.get(F.array(*[F.lit(i) for i in ARTIST_INDICES]), idx_ord)
    return F.format_string(ARTISTS_PAGE, idx, page)


def artist_pages(spark: SparkSession, max_depth: int) -> DataFrame:
    """``(idx_ord, idx, page, url)`` to ask for: 27 artist lists of ``max_depth`` pages."""
    indices = spark.createDataFrame(list(enumerate(ARTIST_INDICES)), "idx_ord int, idx string")
    pages = indices.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(max_depth))))
    return pages.withColumn("url", artist_page_url(F.col("idx_ord"), F.col("page")))


def reachable(landed: DataFrame, group: list[str], max_depth: int | None = None) -> DataFrame:
    """Pages read before the first redirect or missing page of their list.

    ``landed`` has a row per answered ``page`` of a list, with ``url`` and
    ``final_url``; a page that landed several times has several. ``max_depth`` ends
    all lists early, as a live crawl would. Pass keys only: the rows of a list meet
    in one window.
    """
    within = landed.filter(F.col("page") >= 1)
    if max_depth is not None:
        within = within.filter(F.col("page") <= max_depth)
    order = W.partitionBy(*group).orderBy("page")
    answered = (F.col("url") == F.col("final_url")) & (F.dense_rank().over(order) == F.col("page"))
    judged = within.withColumn("_bad", ~F.coalesce(answered, F.lit(False)))
    so_far = F.max("_bad").over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    return judged.withColumn("_stopped", so_far).filter(~F.col("_stopped")).drop("_bad", "_stopped")


def asked_as(url: Column) -> tuple[Column, Column]:
    """Address pattern and page number under which a landed songs page was asked for."""
    page = F.regexp_extract(url, r"-alpage-([1-9]\d{0,8})\.html$", 1)
    pattern = F.when(page != "", F.regexp_replace(url, r"-alpage-\d+\.html$", "-alpage-{}.html")).otherwise(url)
    return pattern, F.coalesce(page.try_cast("int"), F.lit(1))


def assign_track_keys(links: DataFrame, order: list[str]) -> DataFrame:
    """``(trackid, …)``: every row numbered from 1 in crawl order."""
    return global_row_number(links, order, "trackid")
