"""Boilerplate lines of a site, found by their share of the site's pages.

A page's visible text lines are counted once a page and host; a line on more than ``ratio`` of a host's pages (and on at
least ``min_pages``) is boilerplate there and is dropped from that host's pages. Only SQL functions are used. Counting
combines before the shuffle, so a host with a third of all pages or a line on all of them is no hot group. Of a host's
lines at most (mean lines a page) / ratio can be over the ratio, so the list that a host's pages are joined with is as
bounded as a page. Lists of up to ``LIST_BYTES`` together are broadcast and no page is moved; beyond that each host's pages are
dealt over ``SALTS`` tasks, and its list to each of them.

Defined cases: null html has no lines; an empty one neither. Pages whose host is unknown (null or odd url) keep all lines.
Repeated rows count as pages of their own. Host names are lower-cased. Other columns are not carried, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from snippetry.session import stage

#: Boilerplate lists of this size together are broadcast.
LIST_BYTES = 32 << 20
#: Tasks that a host's pages are dealt over where the lists are larger.
SALTS = 32

# Fixed value: tags that end a line of visible text.
BLOCK = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|"
    "ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul"
)


def host(url: str = "url") -> Column:
    name = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(name, F.lit(""))


def html_lines(html: str = "html") -> Column:
    """Non-empty lines of visible text: comments, scripts and styles go, block tags break lines, other tags vanish, blanks
    are collapsed."""
    text = F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", "")
    for tag in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    text = F.regexp_replace(text, r"[ \t\r\n\f]+", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCK})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(lines, F.array().cast("array<string>"))


def _line_key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def site_lines(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, line_key, n_pages, host_pages) of all lines on pages with a known host."""
    lined = pages.select(host(url).alias("host"), html_lines(html).alias("lines")).where("host IS NOT NULL")
    totals = lined.groupBy("host").agg(F.count("*").alias("host_pages"))
    once = lined.select("host", F.explode(F.array_distinct(F.transform("lines", _line_key))).alias("line_key"))
    counts = once.groupBy("host", "line_key").agg(F.count("*").alias("n_pages"))
    return counts.join(totals, "host")


def boilerplate(pages: DataFrame, ratio: float = 0.3, min_pages: int = 3, url: str = "url", html: str = "html") -> DataFrame:
    """(host, line_keys) of the lines over the ratio."""
    over = site_lines(pages, url, html).where((F.col("n_pages") >= min_pages) & (F.col("n_pages") > ratio * F.col("host_pages")))
    return over.groupBy("host").agg(F.collect_set("line_key").alias("line_keys"))


def drop_boilerplate(pages: DataFrame, ratio: float = 0.3, min_pages: int = 3, page_id: str = "page_id", url: str = "url",
                     html: str = "html", list_bytes: int = LIST_BYTES) -> DataFrame:
    """(page_id, host, lines, kept): all lines of each page and those left, in order."""
    found = stage(boilerplate(pages, ratio, min_pages, url, html), "site-boilerplate")
    # A key takes 16 bytes and 16 more of the array around it.
    held = found.agg(F.sum(F.size("line_keys").cast("bigint") * 32 + F.length("host") + 64).alias("held")).first()["held"] or 0
    if held <= list_bytes:
        lined = pages.select(F.col(page_id).alias("page_id"), host(url).alias("host"), html_lines(html).alias("lines"))
        joined = lined.join(F.broadcast(found), "host", "left")
    else:
        salt = F.pmod(F.xxhash64(F.col(page_id), F.col(url)), F.lit(SALTS)).cast("int").alias("salt")
        lined = pages.select(F.col(page_id).alias("page_id"), host(url).alias("host"), salt, html_lines(html).alias("lines"))
        dealt = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = lined.join(dealt, ["host", "salt"], "left")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("line_keys"), _line_key(x)))
    return joined.select("page_id", "host", "lines", F.when(F.col("line_keys").isNull(), F.col("lines")).otherwise(kept).alias("kept"))
