"""Queries that parse and normalise text: strings are made from the keys of orders, or read from documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.functions import dates, text
from boutlens.plans.bouts import table
from boutlens.plans.registry import query

_RAW = """WITH raw AS (SELECT o_orderkey AS k,
CASE o_orderkey % 7 WHEN 0 THEN '---' WHEN 1 THEN NULL WHEN 2 THEN 'x' ELSE (o_orderkey % 90) || ' of ' || (o_orderkey % 90 + 7) END AS strikes,
CASE o_orderkey % 5 WHEN 0 THEN '--' WHEN 1 THEN '1:2:3' ELSE (o_orderkey % 6) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END AS clock,
CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'n%' ELSE (o_orderkey % 101) || '%' END AS pct,
CASE o_orderkey % 6 WHEN 0 THEN 'nan' ELSE (5 + o_orderkey % 2) || ''' ' || (o_orderkey % 12) || '"' END AS height,
CASE o_orderkey % 6 WHEN 1 THEN 'None' WHEN 2 THEN 'wide' ELSE (60 + o_orderkey % 25) || '.5"' END AS reach,
CASE o_orderkey % 5 WHEN 0 THEN 'Main Light Heavyweight Title Bout' WHEN 1 THEN 'Women''s Flyweight Bout' WHEN 2 THEN 'heavyweight bout' WHEN 3 THEN 'Superfight TITLE' END AS kind,
CASE o_orderkey % 4 WHEN 0 THEN '5 Rnd (5-5-5-5-5)' WHEN 1 THEN 'No Time Limit' WHEN 2 THEN '3 Rnd (5-5-5)' END AS format,
CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%b %-d, %Y') WHEN 3 THEN 'soon' ELSE '--' END AS day,
CAST(o_orderdate AS DATE) AS real_day FROM orders)
"""


def _raw(spark, sf_dir) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    n = lambda c: c.cast("string")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(k % 7 == 0, "---").when(k % 7 == 1, None).when(k % 7 == 2, "x").otherwise(F.concat(n(k % 90), F.lit(" of "), n(k % 90 + 7))).alias("strikes"),
        F.when(k % 5 == 0, "--").when(k % 5 == 1, "1:2:3").otherwise(F.concat(n(k % 6), F.lit(":"), F.lpad(n(k % 60), 2, "0"))).alias("clock"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "n%").otherwise(F.concat(n(k % 101), F.lit("%"))).alias("pct"),
        F.when(k % 6 == 0, "nan").otherwise(F.concat(n(5 + k % 2), F.lit("' "), n(k % 12), F.lit('"'))).alias("height"),
        F.when(k % 6 == 1, "None").when(k % 6 == 2, "wide").otherwise(F.concat(n(60 + k % 25), F.lit('.5"'))).alias("reach"),
        F.when(k % 5 == 0, "Main Light Heavyweight Title Bout").when(k % 5 == 1, "Women's Flyweight Bout").when(k % 5 == 2, "heavyweight bout").when(k % 5 == 3, "Superfight TITLE").alias("kind"),
        F.when(k % 4 == 0, "5 Rnd (5-5-5-5-5)").when(k % 4 == 1, "No Time Limit").when(k % 4 == 2, "3 Rnd (5-5-5)").alias("format"),
        F.when(k % 5 == 0, F.date_format(day, "MMMM d, yyyy")).when(k % 5 == 1, F.date_format(day, "yyyy-MM-dd")).when(k % 5 == 2, F.date_format(day, "MMM d, yyyy")).when(k % 5 == 3, "soon").otherwise("--").alias("day"),
        F.to_date(day).alias("real_day"),
    )


@query(_RAW + """SELECT k, TRY_CAST(nullif(regexp_extract(strikes, '(\\d+)\\s+of\\s+(\\d+)', 1), '') AS INT) AS landed, TRY_CAST(nullif(regexp_extract(strikes, '(\\d+)\\s+of\\s+(\\d+)', 2), '') AS INT) AS attempted,
CASE WHEN k % 5 > 1 THEN CAST((k % 6) * 60 + k % 60 AS INT) END AS control, CASE WHEN k % 4 > 1 THEN (k % 101) / 100.0::DOUBLE END AS share, CASE WHEN k % 6 <> 0 THEN CAST((5 + k % 2) * 12 + k % 12 AS DOUBLE) END AS height,
CASE WHEN k % 6 NOT IN (1, 2) THEN CAST(60 + k % 25 AS DOUBLE) + 0.5 END AS reach, CASE k % 5 WHEN 0 THEN 'Light Heavyweight' WHEN 1 THEN 'Women''s Flyweight' WHEN 2 THEN 'Heavyweight' ELSE 'Unknown' END AS division,
k % 5 IN (0, 3) AS title, CASE k % 4 WHEN 0 THEN 5 ELSE 3 END AS rounds, CASE WHEN k % 5 < 3 THEN real_day END AS day,
CAST(CASE WHEN k % 5 > 1 AND k % 3 > 0 THEN (k % 3 - 1) * 300 + (k % 6) * 60 + k % 60 ELSE 900 END AS INT) AS seconds FROM raw""")
def parse_text_fields(spark, sf_dir) -> DataFrame:
    """Strikes, clocks, shares, lengths, divisions, rounds and dates out of their written forms."""
    r = _raw(spark, sf_dir)
    landed, attempted = text.landed_of(F.col("strikes"))
    ended = F.when((F.col("k") % 3 > 0) & (F.col("k") % 5 > 1), (F.col("k") % 3).cast("int"))
    return r.select(
        "k", landed.alias("landed"), attempted.alias("attempted"), text.clock_seconds(F.col("clock")).alias("control"), text.percentage(F.col("pct")).alias("share"),
        text.height_inches(F.col("height")).alias("height"), text.reach_inches(F.col("reach")).alias("reach"), text.division(F.col("kind")).alias("division"),
        text.is_title(F.col("kind")).alias("title"), text.num_rounds(F.col("format")).alias("rounds"), dates.any_date(F.col("day")).alias("day"),
        dates.bout_seconds(ended, F.col("clock"), F.lit(3)).alias("seconds"),
    )


_NAMES = """WITH names AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'Ovince Saint-Preux' WHEN 1 THEN '  JUNIOR  dos Santos, ' WHEN 2 THEN 'José "Pepe" Núñez' WHEN 3 THEN 'O''Malley, Sean' WHEN 4 THEN c_name ELSE '' END AS name,
CASE c_custkey % 3 WHEN 0 THEN 'Preux Saint Ovince' WHEN 1 THEN c_name ELSE 'sean o''malley' END AS other, c_name FROM customer)
"""


def _names(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, "Ovince Saint-Preux").when(k % 6 == 1, "  JUNIOR  dos Santos, ").when(k % 6 == 2, 'José "Pepe" Núñez').when(k % 6 == 3, "O'Malley, Sean").when(k % 6 == 4, F.col("c_name")).otherwise("")
    other = F.when(k % 3 == 0, "Preux Saint Ovince").when(k % 3 == 1, F.col("c_name")).otherwise("sean o'malley")
    return table(spark, sf_dir, "customer").select(k.alias("k"), name.alias("name"), other.alias("other"), "c_name")


_TOKENS = "list_filter(string_split(trim(regexp_replace(lower(strip_accents({0})), '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"


@query(_NAMES + f"""SELECT k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '\\bsaint\\b', 'st', 'g'), '\\bjunior\\b', 'jr', 'g'), '-+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS plain,
nullif(regexp_replace(regexp_replace(trim(lower(strip_accents(trim(name)))), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '') AS slug, {_TOKENS.format('name')}[-1] AS last_name,
list_sort(list_distinct({_TOKENS.format('name')})) = list_sort(list_distinct({_TOKENS.format('other')})) AS same_tokens,
CASE WHEN len({_TOKENS.format('name')}) + len({_TOKENS.format('other')}) > 0 THEN len(list_intersect({_TOKENS.format('name')}, {_TOKENS.format('other')})) / len(list_distinct(list_concat({_TOKENS.format('name')}, {_TOKENS.format('other')})))::DOUBLE END AS jaccard FROM names""")
def normalize_names(spark, sf_dir) -> DataFrame:
    name, other = F.col("name"), F.col("other")
    return _names(spark, sf_dir).select(
        "k", text.normal_name(name).alias("plain"), text.slug(name).alias("slug"), text.last_name(name).alias("last_name"), text.same_tokens(name, other).alias("same_tokens"),
        text.token_jaccard(name, other).alias("jaccard"),
    )


_METHODS = ["KO (Punches)", "Technical Submission (Choke)", "Decision - Split", "Draw", "NC", "Could Not Continue", "  ", "TKO - Doctor"]
_RESULTS = ["W", "loss", "Draw", "NC", "Overturned"]
_ORGS = ["Bellator 290: Bader vs Fedor", "Cage Warriors 50", "ONE Championship: Lights Out", "Backyard Brawl", "", "RIZIN 30"]


def _case(column: str, values: list[str], n: int) -> str:
    quoted = [v.replace("'", "''") for v in values]
    return f"CASE {column} % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted)) + " END"


def _pick(column, values: list[str], n: int):
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(column % n == i, v).otherwise(out)
    return out


@query(f"""WITH raw AS (SELECT o_orderkey AS k, {_case('o_orderkey', _METHODS, 9)} AS m, {_case('o_orderkey', _RESULTS, 6)} AS r, {_case('o_orderkey', _ORGS, 7)} AS e FROM orders)
SELECT k, {_case('k', ['KO/TKO', 'Submission', 'Decision', 'Draw', 'No Contest', 'Could Not Continue', '', 'KO/TKO'], 9)} AS method, {_case('k', ['win', 'loss', 'draw', 'nc', 'overturned'], 6)} AS result,
CASE k % 9 WHEN 2 THEN 'Decision' WHEN 7 THEN 'KO/TKO' WHEN 0 THEN 'KO/TKO' WHEN 1 THEN 'Submission' WHEN 3 THEN 'Draw' WHEN 4 THEN 'No Contest' WHEN 5 THEN 'Could Not Continue' WHEN 6 THEN '' END AS kind,
CASE k % 9 WHEN 2 THEN 'Split' WHEN 7 THEN 'Doctor' END AS detail, {_case('k', ['Bellator', 'Cage Warriors 50', 'ONE Championship', 'Backyard Brawl', '', 'RIZIN 30'], 7)} AS organisation,
CASE k % 7 WHEN 0 THEN 'major' WHEN 1 THEN 'regional' WHEN 2 THEN 'major' WHEN 3 THEN 'local' WHEN 5 THEN 'major' ELSE 'none' END AS tier FROM raw""")
def parse_outcomes(spark, sf_dir) -> DataFrame:
    """Methods, results and organisers out of free text."""
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(k.alias("k"), _pick(k, _METHODS, 9).alias("m"), _pick(k, _RESULTS, 6).alias("r"), _pick(k, _ORGS, 7).alias("e"))
    kind, detail = text.method_and_detail(F.col("m"))
    return r.select("k", text.contest_method(F.col("m")).alias("method"), text.contest_result(F.col("r")).alias("result"), kind.alias("kind"), detail.alias("detail"), text.organisation(F.col("e")).alias("organisation"), text.org_tier(F.col("e")).alias("tier"))


@query("""WITH raw AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT k, CASE WHEN k % 3 > 0 THEN day END AS slashed, CASE WHEN k % 4 > 0 THEN day END AS ordinal, day - CAST(floor((18 + k % 30 + 0.5) * 365.25) AS INT) AS born,
CASE WHEN k % 5 > 0 THEN round_even((100 + k % 120) / 2.54, 2) END AS inches, ((100 + k % 120) / 2.54::DOUBLE) AS plain_inches, CASE WHEN k % 6 > 0 THEN lpad(printf('%x', k), 16, '0') END AS hex_id, CASE WHEN k % 2 = 0 THEN k END AS number,
'http://a.b/event/x-' || k AS url, CASE WHEN year(day) <= 2009 THEN 'pre-2010' WHEN year(day) <= 2014 THEN '2010-2014' WHEN year(day) <= 2019 THEN '2015-2019' ELSE '2020-2026' END AS era FROM raw""")
def parse_dates_and_links(spark, sf_dir) -> DataFrame:
    """Dates in two more forms, birth from age, lengths in centimetres, ids in links."""
    k = F.col("o_orderkey")
    day = F.col("day")
    r = table(spark, sf_dir, "orders").select(k.alias("k"), F.to_date("o_orderdate").alias("day"))
    k = F.col("k")
    d = F.dayofmonth("day")
    suffix = F.when(d.isin(11, 12, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
    slashed = F.when(k % 3 > 0, F.date_format(day, "MMM / dd / yyyy")).otherwise("never")
    ordinal = F.when(k % 4 > 0, F.concat(F.date_format(day, "MMM d"), suffix, F.date_format(day, " yyyy"))).otherwise("Mar 44th 2023")
    link = F.when(k % 6 > 0, F.concat(F.lit("http://a.b/f/"), F.lpad(F.lower(F.hex(k)), 16, "0"))).otherwise("http://a.b/f/none")
    numbered = F.when(k % 2 == 0, F.concat(F.lit("/fighters/Jon-Jones-"), k.cast("string"))).otherwise("/fighters/nobody")
    return r.select(
        "k", dates.slashed_date(slashed).alias("slashed"), dates.ordinal_date(ordinal).alias("ordinal"), dates.born_from_age((18 + k % 30 + 0.5), day).alias("born"),
        text.positive_cm_to_inches(F.when(k % 5 > 0, (100 + k % 120).cast("double")).otherwise(-1.0)).alias("inches"), text.cm_to_inches((100 + k % 120).cast("double")).alias("plain_inches"),
        text.hex_id(link).alias("hex_id"), text.trailing_number(numbered).alias("number"), text.canonical_url(F.concat(F.lit(" HTTP://a.b/Event/X-"), k.cast("string"), F.lit("/?q=1#z"))).alias("url"),
        dates.era(day).alias("era"),
    )


@query(f"""SELECT page_id, nullif(trim(replace(replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')), '') AS title,
contains(html, 'Cloudflare Ray ID') OR contains(html, 'Just a moment...') OR contains(html, 'cf-browser-verification') OR contains(html, 'Attention Required! | Cloudflare') OR page_id % 50 = 3 AS challenge,
CASE WHEN page_id % 31 = 0 THEN 'event_not_found' WHEN page_id % 31 = 1 THEN 'pre_archive_skip' WHEN page_id % 29 = 5 THEN 'disambiguation_fail' WHEN page_id % 23 = 4 THEN 'not_found' WHEN page_id % 23 = 6 THEN 'http_other'
WHEN page_id % 19 = 2 THEN 'timeout' WHEN page_id % 17 = 1 THEN 'captcha' WHEN nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), '') IS NULL THEN 'error' ELSE 'reachable' END AS status FROM pages""")
def page_probe_status(spark, sf_dir) -> DataFrame:
    """Title, robot gate and probe status of raw pages; sentinels and errors are made from the ids."""
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", "html", text.html_title(F.col("html")).alias("title"))
    code = F.when(k % 23 == 4, 404).when(k % 23 == 6, 500).otherwise(200)
    status = text.probe_status(
        F.when(k % 31 == 0, "EVENT_NOT_FOUND").when(k % 31 == 1, "PRE_ARCHIVE_SKIP").otherwise(""), F.when(k % 29 == 5, "bellator-272").otherwise("ufc-300"),
        F.when(k % 19 == 2, "timeout"), code, k % 17 == 1, F.col("title"), "Home",
    )
    return p.select("page_id", "title", text.is_challenge(F.col("html"), F.when(k % 50 == 3, 403).otherwise(200)).alias("challenge"), status.alias("status"))
