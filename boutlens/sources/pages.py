"""Saved pages to rows: events, bouts, profiles and prices out of HTML columns.

Fields that one expression finds are extracted by built-in functions; tables become arrays of rows by
regexp_extract_all, so that nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens.functions import dates, text

_CELL = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"
_ROW = r"(?is)<tr\b[^>]*>.*?</tr>"


def plain(html: Column) -> Column:
    """The text of a piece of HTML: no tags, entities resolved, single spaces."""
    out = F.regexp_replace(html, r"(?is)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return text.collapsed(out)


def _one(html: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, group), F.lit(""))


def meta(html: Column, name: str) -> Column:
    return _one(html, rf'(?is)<meta[^>]+(?:name|property)="{name}"[^>]+content="([^"]*)"')


def body(html: Column) -> Column:
    """A page without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")


def links(html: Column) -> Column:
    """Array of (href, label)."""
    found = F.regexp_extract_all(body(html), F.lit(r'(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>'), 0)
    return F.transform(found, lambda a: F.struct(_one(a, r'(?is)href="([^"]*)"').alias("href"), plain(a).alias("label")))


def table_rows(html: Column) -> Column:
    """Array of the cells' texts, an array for each row of the page's tables that has any."""
    rows = F.regexp_extract_all(body(html), F.lit(_ROW), 0)
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(_CELL), 1), plain))
    return F.filter(cells, lambda c: F.size(c) > 0)


def page_facts(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html): title, description, number of links, tables' rows and words of each page."""
    html = F.col("html")
    return pages.select(
        "page_id", text.canonical_url(F.col("url")).alias("url"), text.html_title(html).alias("title"), meta(html, "description").alias("description"), F.size(links(html)).alias("links"),
        F.size(table_rows(html)).alias("rows"), F.size(F.split(plain(body(html)), " ")).alias("words"), text.is_challenge(html, F.lit(200)).alias("challenge"),
    )


def event_list(pages: DataFrame) -> DataFrame:
    """(name, url, day, location) of the events that a list page links to; rows without a date go."""
    rows = F.regexp_extract_all(body(F.col("html")), F.lit(_ROW), 0)
    r = pages.select(F.explode(rows).alias("r"))
    link = F.col("r")
    day = dates.any_date(_one(plain(link), r"([A-Z][a-z]+ \d{1,2}, \d{4})"))
    out = r.select(
        plain(_one(link, r'(?is)<a\b[^>]*>(.*?)</a>')).alias("name"), _one(link, r'(?is)<a\b[^>]*href="([^"]*)"').alias("url"), day.alias("day"),
        F.nullif(plain(F.regexp_extract(link, r"(?is)<td\b[^>]*>(?:(?!<td\b).)*</td>\s*<td\b[^>]*>(.*?)</td>", 1)), F.lit("")).alias("location"),
    )
    return out.filter("day is not null and url is not null")


def fighter_profile(pages: DataFrame) -> DataFrame:
    """(url, name, height, reach, stance, born) of profile pages: labelled fields, missing ones null."""
    t = plain(body(F.col("html")))
    field = lambda label, value: _one(t, rf"{label}:\s*({value})")
    return pages.select(
        "url", plain(_one(F.col("html"), r'(?is)<span class="b-content__title-highlight">(.*?)</span>')).alias("name"),
        text.height_inches(field("Height", r"\d+'\s*\d+\"?|--")).alias("height"), text.reach_inches(field("Reach", r"[\d.]+\"?|--")).alias("reach"),
        text.present(field("STANCE", r"[A-Z][a-z]+")).alias("stance"), dates.any_date(field("DOB", r"[A-Z][a-z]{2} \d{1,2}, \d{4}|--")).alias("born"),
    )


def bout_rounds(pages: DataFrame) -> DataFrame:
    """(url, round, red, blue, sig_red, sig_blue, td_red, td_blue, control_red, control_blue) of bout pages.

    A round's row has the two corners' values in one cell, one behind the other.
    """
    rows = pages.select("url", F.posexplode(F.filter(table_rows(F.col("html")), lambda c: F.size(c) >= 10)).alias("round", "c"))
    pair = lambda i: F.regexp_extract_all(F.get("c", F.lit(i)), F.lit(r"\d+ of \d+"), 0)
    clock = F.regexp_extract_all(F.element_at("c", -1), F.lit(r"\d+:\d\d|--"), 0)
    landed = lambda a, k: text.landed_of(F.get(a, F.lit(k)))[0]
    return rows.select(
        "url", "round", landed(pair(2), 0).alias("sig_red"), landed(pair(2), 1).alias("sig_blue"), landed(pair(5), 0).alias("td_red"), landed(pair(5), 1).alias("td_blue"),
        text.clock_seconds(F.get(clock, F.lit(0))).alias("control_red"), text.clock_seconds(F.get(clock, F.lit(1))).alias("control_blue"),
    )


def moneylines(pages: DataFrame) -> DataFrame:
    """(url, matchup, side, opening, low, high, books): each side's lines over the bookmakers' cells of a page."""
    cell = r'(?is)<td\b[^>]*data-li="\[\d+,\d+,\d+\]"[^>]*>.*?</td>'
    cells = pages.select("url", F.posexplode(F.regexp_extract_all(body(F.col("html")), F.lit(cell), 0)).alias("at", "c"))
    mark = lambda g: F.regexp_extract("c", r'data-li="\[(\d+),(\d+),(\d+)\]"', g)
    line = F.regexp_replace(plain(F.regexp_extract("c", r"(?is)<span\b[^>]*>(.*?)</span>", 1)), r"^\+", "").try_cast("int")
    rows = cells.select("url", "at", mark(2).cast("int").alias("side"), mark(3).cast("long").alias("matchup"), line.alias("line")).filter("line is not null")
    return rows.groupBy("url", "matchup", "side").agg(F.min_by("line", "at").alias("opening"), F.min("line").alias("low"), F.max("line").alias("high"), F.count("*").alias("books"))


def has_captcha(html: Column) -> Column:
    return F.coalesce(F.regexp_like(html, F.lit(r'(?i)id="[^"]*captcha[^"]*"')), F.lit(False))
