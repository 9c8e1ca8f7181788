"""Parsing and normalising text columns, as built-in expressions: what can't be read is null, nothing raises."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as missing, and the divisions in the order in which they are sought.
MISSING = ["", "---", "--", "nan", "None"]
DIVISIONS = [
    "Women's Strawweight", "Women's Featherweight", "Women's Bantamweight", "Women's Flyweight", "Light Heavyweight", "Catch Weight", "Open Weight",
    "Featherweight", "Bantamweight", "Welterweight", "Middleweight", "Heavyweight", "Lightweight", "Flyweight",
]
UNRANKED = ["Catch Weight", "Open Weight"]
ORGANISATIONS = {
    "major": ["Bellator", "ONE Championship", "ONE FC", "PFL", "Professional Fighters League", "Pride", "Strikeforce", "WEC", "World Extreme Cagefighting", "RIZIN"],
    "regional": ["LFA", "Legacy Fighting Alliance", "KSW", "Cage Warriors", "M-1", "Brave CF", "Brave Combat Federation", "Eagle FC", "Combate Global", "Combate Americas"],
}
CHALLENGES = ["Just a moment...", "cf-browser-verification", "Cloudflare Ray ID", "Attention Required! | Cloudflare"]
REFUSALS = [403, 429, 503]
#: Latin letters with marks, and the plain letters that they are made of
_FOLDS = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.normalize("NFKD", chr(c))[0].isascii()]


def blank_to_null(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


def present(s: Column) -> Column:
    """The trimmed text, null where it stands for a missing value."""
    return F.when(~F.trim(s).isin(MISSING), F.trim(s))


def _number(s: Column, pattern: str, group: int, kind: str = "int") -> Column:
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit("")).try_cast(kind)


def landed_of(s: Column) -> tuple[Column, Column]:
    """"69 of 101": (69, 101)."""
    pattern = r"(\d+)\s+of\s+(\d+)"
    return _number(present(s), pattern, 1), _number(present(s), pattern, 2)


def clock_seconds(s: Column) -> Column:
    """"2:15": 135."""
    parts = F.split(present(s), ":")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int"))


def percentage(s: Column) -> Column:
    """"65%": 0.65."""
    return F.nullif(F.regexp_replace(present(s), "%+$", ""), F.lit("")).try_cast("double") / 100


def height_inches(s: Column) -> Column:
    """Feet and inches, 5' 10": 70."""
    pattern = r"(\d+)'\s*(\d+)"
    return (_number(present(s), pattern, 1) * 12 + _number(present(s), pattern, 2)).cast("double")


def reach_inches(s: Column) -> Column:
    return F.nullif(F.regexp_replace(present(s), '"+$', ""), F.lit("")).try_cast("double")


def cm_to_inches(cm: Column) -> Column:
    return cm / 2.54


def positive_cm_to_inches(cm: Column) -> Column:
    """Null for what is no length; two digits, halves to even."""
    return F.when(cm > 0, F.bround(cm / 2.54, 2))


def division(s: Column) -> Column:
    """The first known division that the text names."""
    found = F.lit("Unknown")
    for name in reversed(DIVISIONS):
        found = F.when(F.contains(F.lower(s), F.lit(name.lower())), name).otherwise(found)
    return F.when(s.isNull(), F.lit("Unknown")).otherwise(found)


def is_title(s: Column) -> Column:
    return F.coalesce(F.contains(F.lower(s), F.lit("title")), F.lit(False))


def num_rounds(s: Column) -> Column:
    return F.coalesce(_number(s, r"(\d+)\s+Rnd", 1), F.lit(3))


def truthy(s: Column) -> Column:
    return F.coalesce(F.lower(F.trim(s)).isin("true", "1", "yes", "t"), F.lit(False))


def fold(s: Column) -> Column:
    """Latin letters without their marks; what is then still no ASCII goes."""
    return F.regexp_replace(F.translate(s, "".join(a for a, _ in _FOLDS), "".join(b for _, b in _FOLDS)), r"[^\x00-\x7F]", "")


def collapsed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def normal_name(s: Column) -> Column:
    """Lower case, "saint" and "junior" shortened, hyphens to spaces, no other punctuation, single spaces."""
    out = F.lower(s)
    for pattern, put in ((r"\bsaint\b", "st"), (r"\bjunior\b", "jr"), (r"-+", " "), (r"[^\p{L}\p{N}_\s]", "")):
        out = F.regexp_replace(out, pattern, put)
    return collapsed(out)


def normal_place(s: Column) -> Column:
    return collapsed(F.lower(fold(s)))


def slug(s: Column, aliases: dict[str, str] | None = None) -> Column:
    """"Herb Dean": "herb-dean"; an alias stands for its name, nothing left is null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.lower(fold(F.trim(s)))), r"\s+", "-"), "[^a-z0-9-]", "")
    named = F.nullif(plain, F.lit(""))
    for alias, name in (aliases or {}).items():
        named = F.when(named == alias, name).otherwise(named)
    return named


def tokens(s: Column) -> Column:
    return F.filter(F.split(normal_place(s), " "), lambda t: t != "")


def last_name(s: Column) -> Column:
    return F.try_element_at(tokens(s), F.lit(-1))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens; null where neither has one."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double"))


def same_tokens(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(a))) == F.array_sort(F.array_distinct(tokens(b)))


def association(s: Column) -> Column:
    """A club's name without one closing word for what it is; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(s)), r" (\(usa\)|mma|academy|gym)$", "")), F.lit(""))


def org_tier(s: Column, tiers: dict[str, list[str]] = ORGANISATIONS) -> Column:
    """The first tier one of whose tokens the name holds; "local" for other names, "none" without one."""
    found = F.lit("local")
    for tier, marks in reversed(list(tiers.items())):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(F.lower(s), F.lit(m.lower()))
        found = F.when(hit, tier).otherwise(found)
    return F.when(F.coalesce(F.trim(s), F.lit("")) == "", "none").otherwise(found)


def contest_method(s: Column) -> Column:
    """Free text to a method's name; the first kind that it mentions."""
    m = F.lower(F.trim(s))
    return (
        F.when(F.contains(m, F.lit("ko")), "KO/TKO").when(F.contains(m, F.lit("sub")), "Submission").when(F.contains(m, F.lit("decision")), "Decision")
        .when(F.contains(m, F.lit("draw")), "Draw").when(F.contains(m, F.lit("no contest")) | F.contains(m, F.lit("nc")), "No Contest").otherwise(F.trim(s))
    )


def contest_result(s: Column) -> Column:
    r = F.lower(F.trim(s))
    return F.when(r.isin("win", "w"), "win").when(r.isin("loss", "l"), "loss").when(r.isin("draw", "d"), "draw").when(r.isin("nc", "no contest"), "nc").otherwise(r)


def method_and_detail(s: Column) -> tuple[Column, Column]:
    """"Decision - Split": ("Decision", "Split")."""
    parts = F.split(F.trim(s), " - ", 2)
    return contest_method(F.get(parts, F.lit(0))), blank_to_null(F.get(parts, F.lit(1)))


def pair_key(date: Column, a: Column, b: Column) -> Column:
    """One key for a pair on a day, in either order."""
    return F.concat_ws("|", date.cast("string"), F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def pair_key_parts(key: Column) -> tuple[Column, Column, Column]:
    part = lambda i: F.get(F.split(key, r"\|"), F.lit(i))
    return F.try_to_date(part(0), "yyyy-MM-dd"), part(1), part(2)


def hex_id(url: Column) -> Column:
    """The hexadecimal id at the end of a link."""
    return F.nullif(F.regexp_extract(url, r"/([0-9a-f]{16})/?$", 1), F.lit(""))


def trailing_number(url: Column) -> Column:
    return _number(url, r"-(\d+)/?$", 1, "long")


def canonical_url(url: Column) -> Column:
    """Without query, fragment and closing slashes, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"[?#].*$", ""), "/+$", "")


def html_title(html: Column) -> Column:
    """The title's text, null where there is none."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return F.nullif(F.trim(raw), F.lit(""))


def organisation(event: Column) -> Column:
    """An event's organiser: its name up to a number or a colon, the whole name where nothing is left."""
    cut = F.trim(F.regexp_replace(F.trim(F.regexp_replace(event, r"\s+\d+\s*:.*$", "")), r":\s*.*$", ""))
    return F.coalesce(F.nullif(cut, F.lit("")), event)


def is_challenge(html: Column, status: Column) -> Column:
    """Whether a page is a gate against robots rather than content."""
    hit = status.isin(REFUSALS)
    for mark in CHALLENGES:
        hit = hit | F.coalesce(F.contains(html, F.lit(mark)), F.lit(False))
    return hit


def probe_status(flag: Column, slug: Column, error: Column, status: Column, captcha: Column, title: Column, home: str, prefix: str = "ufc-") -> Column:
    """How a probe of a page went; the first that holds."""
    return (
        F.when(flag == "EVENT_NOT_FOUND", "event_not_found").when(flag == "PRE_ARCHIVE_SKIP", "pre_archive_skip").when((slug != "") & ~slug.startswith(prefix), "disambiguation_fail")
        .when(status == 404, "not_found").when(status >= 400, "http_other").when(error == "timeout", "timeout").when(error.isNotNull(), "error")
        .when(captcha, "captcha").when(title.isNull(), "error").when(title == home, "homepage_fallback").otherwise("reachable")
    )


def matching_division(s: Column) -> Column:
    """The division that a user's text means: the longest rankable one of which it is a part, whatever the case."""
    found = F.lit(None).cast("string")
    for name in sorted((d for d in DIVISIONS if d not in UNRANKED), key=len):
        found = F.when(F.contains(F.lit(name.lower()), F.lower(F.trim(s))), name).otherwise(found)
    return F.when(F.trim(s) != "", found)
