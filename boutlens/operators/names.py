"""Names that don't agree letter by letter: similarity, best match within a block, tiers of rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from boutlens.functions import text
from boutlens.operators.graph import stored


def indel_ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths, by one machine word's operations a letter."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    open_ = (1 << len(a)) - 1
    for ch in b:
        hit = open_ & masks.get(ch, 0)
        open_ = (open_ + hit) | (open_ - hit)
    same = len(a) - (open_ & (1 << len(a)) - 1).bit_count()
    return 200.0 * same / (len(a) + len(b))


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """indel_ratio() of two columns; null where either is."""
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def reversed_name(name: Column) -> Column:
    """"Last, First" as "First Last"; null without a comma."""
    parts = F.split(name, ",", 2)
    return F.when(F.size(parts) == 2, F.concat_ws(" ", F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(0)))))


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(text.tokens(name)), " ")


def _least_shared(length: int, q: int, threshold: float) -> int:
    """How many q-grams a name of ``length`` shares at least with any name that it is like at ``threshold``.

    A likeness of t leaves (1 - t) of both lengths to deletions and insertions; a deletion takes q grams of the name at
    most, an insertion q - 1. Lengths further apart than t allows can't be alike.
    """
    t = threshold / 100.0
    least = None
    for other in range(length and 1, 2 * length + 2 if t >= 2 / 3 else int(length * (2 - t) / t) + 2):
        edits = int((1 - t) * (length + other) + 1e-9)
        edits -= (edits - abs(length - other)) % 2
        if edits < abs(length - other):
            continue
        gone, added = (edits + length - other) // 2, (edits - length + other) // 2
        shared = length - q + 1 - q * gone - (q - 1) * added
        least = shared if least is None else min(least, shared)
    return 0 if least is None else least


def _prefixes(threshold: float, longest: int) -> tuple[list[int], list[int], int]:
    """By length: how many of a name's rarest pairs of letters, and of its rarest letters, are looked up; and up to which
    length letters are needed, as pairs alone don't prove a match."""
    pairs = [max(0, n - 1) - _least_shared(n, 2, threshold) + 1 for n in range(longest + 1)]
    short = max((n for n in range(longest + 1) if _least_shared(n, 2, threshold) < 1), default=0)
    t = threshold / 100.0
    reach = int(short * (2 - t) / t) + 1
    letters = [n - _least_shared(n, 1, threshold) + 1 if n <= reach else 0 for n in range(longest + 1)]
    return pairs, letters, short


#: names are looked up by their first letters up to this length; longer ones agree in as many grams as one of it
LONGEST = 512


def _grams(name: Column, q: int) -> Column:
    """The q-grams of a name, repeats told apart by their number."""
    n = F.length(name) - (q - 1)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: name.substr(i, F.lit(q)))
    cut = F.when(n >= 1, cut).otherwise(F.array().cast("array<string>"))
    return F.transform(cut, lambda g, i: F.concat(F.lit(f"{q}:"), g, F.lit(":"), F.size(F.filter(F.slice(cut, 1, i), lambda h: h == g)).cast("string")))


def similar_pairs(left: DataFrame, right: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """(on, l, r, score): all pairs of distinct names ``l`` of ``left`` and ``r`` of ``right`` in a block alike at ``threshold``.

    Exact for the ratio of insertions and deletions: names that are alike share one of each other's rarest pairs of
    letters, or letters where a name is short, and only such pairs are scored. Frequent ones come last in the order, so
    that they are looked up only by names that have few others; a crowded one is split by the skew join. Two empty names
    are alike. ``threshold`` is above 50.
    """
    own, held = left.select(*on, "l").distinct(), right.select(*on, "r").distinct()
    longest = min(LONGEST, max(own.agg(F.max(F.length("l"))).first()[0] or 0, held.agg(F.max(F.length("r"))).first()[0] or 0))
    pairs, letters, _ = _prefixes(threshold, longest)
    looked = lambda table, n: F.element_at(F.array(*(F.lit(x) for x in table)), F.least(n, F.lit(longest)) + 1)
    names = own.select(F.col("l").alias("name")).union(held.select(F.col("r").alias("name"))).distinct()
    cut = names.select("name", F.explode(F.concat(_grams(F.col("name"), 1), _grams(F.col("name"), 2))).alias("g")).withColumn("q", F.left("g", F.lit(1)).cast("int"))
    often = cut.groupBy("g").agg(F.count("*").alias("n"))
    ranked = cut.join(often, "g").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "g", "q"))).alias("all"))
    size = F.length("name")
    # a name longer than the table keeps all but as many grams as one of the table's length must share
    extra = F.greatest(size - longest, F.lit(0))
    rare = lambda q, table: F.slice(F.filter("all", lambda x: x["q"] == q), 1, F.greatest(F.when(looked(table, size) > 0, looked(table, size) + extra).otherwise(0), F.lit(0)))
    chosen = ranked.select("name", F.explode(F.transform(F.concat(rare(2, pairs), rare(1, letters)), lambda x: x["g"])).alias("g"))
    t = threshold / 100.0
    a, b = own.join(chosen.withColumnRenamed("name", "l"), "l"), held.join(chosen.withColumnRenamed("name", "r"), "r")
    near = F.length("l") + F.length("r")
    met = a.join(b, [*on, "g"]).filter(2 * F.least(F.length("l"), F.length("r")) >= t * near - 1e-9).select(*on, "l", "r").distinct()
    scored = met.withColumn("score", ratio("l", "r")).filter(F.col("score") >= threshold)
    none = lambda df, c: df.filter(F.length(c) == 0)
    empty = none(own, "l").join(none(held, "r"), on) if on else none(own, "l").crossJoin(none(held, "r"))
    return scored.unionByName(empty.withColumn("score", F.lit(100.0)))


def one_apart(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, score): all pairs of names ``l`` of ``left`` and ``r`` of ``right`` of which one is the other without one letter.

    Found by equality with the names that a letter was taken from, so that there are no other candidates.
    """
    less = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))
    own, held = left.select("l").distinct().filter("l <> ''"), right.select("r").distinct().filter("r <> ''")
    longer = own.join(held.withColumn("v", less(F.col("r"))), F.col("l") == F.col("v")).select("l", "r")
    shorter = own.withColumn("v", less(F.col("l"))).join(held, F.col("r") == F.col("v")).select("l", "r")
    both = F.length("l") + F.length("r")
    return longer.union(shorter).withColumn("score", 200.0 * ((both - 1) / 2) / both)


def best_match(left: DataFrame, right: DataFrame, on: list[str], threshold: float, normal=text.normal_name, by_tokens: bool = False) -> DataFrame:
    """(left_id, right_id, score): the best of the rows of ``right`` (right_id, right_name) in the same block as a row of
    ``left`` (left_id, left_name), at ``threshold`` or more; ties go to the least right_id.

    Names are normalised; either may be written last name first. Names that agree letter by letter are joined as they
    are, then those that differ by one letter, if no other difference can score as much; only what is left is looked up
    by similar_pairs().
    """
    form = lambda c: sorted_tokens(normal(c)) if by_tokens else normal(c)
    turned = lambda c: F.lit(None).cast("string") if by_tokens else normal(reversed_name(c))
    ways = lambda c: F.explode(F.filter(F.array(F.struct(form(c).alias("n"), F.lit(False).alias("t")), F.struct(turned(c).alias("n"), F.lit(True).alias("t"))), lambda x: x["n"].isNotNull()))
    own = left.filter(F.col("left_name").isNotNull()).select(*on, F.col("left_name").alias("name")).distinct().select(*on, "name", ways(F.col("name")).alias("w")).select(*on, "name", F.col("w.n").alias("l"), F.col("w.t").alias("lt"))
    held = stored(right.filter(F.col("right_name").isNotNull()).select(*on, "right_id", ways(F.col("right_name")).alias("w")).groupBy(*on, F.col("w.n").alias("r"), F.col("w.t").alias("rt")).agg(F.min("right_id").alias("right_id")))
    both = ~(F.col("lt") & F.col("rt"))
    equal = own.join(held.withColumnRenamed("r", "l"), [*on, "l"]).filter(both).groupBy(*on, "name").agg(F.min("right_id").alias("right_id")).withColumn("score", F.lit(100.0))
    rest = stored(own.join(equal.select(*on, "name"), [*on, "name"], "left_anti"))
    top = lambda met: met.groupBy(*on, "name").agg(F.max(F.struct("score", (-F.col("right_id")).alias("n"))).alias("__best")).select(*on, "name", (-F.col("__best.n")).alias("right_id"), F.col("__best.score").alias("score"))
    near = rest.join(one_apart(rest, held), "l").filter(F.col("score") >= threshold).join(held, [*on, "r"]).filter(both)
    # two letters and more cost at least 2 of 2 n + 2, n being the length of the name's longest form
    longest = rest.groupBy(*on, "name").agg(F.max(F.length("l")).alias("__longest"))
    close = stored(top(near).join(longest, [*on, "name"]).filter(F.col("score") > 100.0 - 100.0 / (F.col("__longest") + 1) + 1e-9).drop("__longest"))
    found = equal.unionByName(close)
    rest = stored(rest.join(close.select(*on, "name"), [*on, "name"], "left_anti"))
    if not rest.isEmpty():
        found = found.unionByName(top(rest.join(similar_pairs(rest, held, on, threshold), [*on, "l"]).join(held, [*on, "r"]).filter(both)))
    return left.join(found.withColumnRenamed("name", "left_name"), [*on, "left_name"]).select("left_id", "right_id", "score")


def exact_then_fuzzy(left: DataFrame, right: DataFrame, threshold: float = 85.0) -> DataFrame:
    """(left_id, right_id, kind): places equal after normalising, else the best by sorted tokens among all places."""
    key = text.normal_place(F.col("right_name"))
    held = right.groupBy(key.alias("k")).agg(F.max("right_id").alias("right_id"))
    asked = left.withColumn("k", text.normal_place(F.col("left_name")))
    exact = asked.join(held, "k").select("left_id", "right_id", F.lit("exact").alias("kind"))
    rest = asked.join(held.select("k"), "k", "left_anti").select("left_id", "left_name")
    top = best_match(rest, right, [], threshold, text.normal_place, by_tokens=True)
    return exact.unionByName(top.select("left_id", "right_id", F.concat(F.lit("fuzzy:"), F.col("score").cast("int").cast("string")).alias("kind")))


def _tokens(c: str) -> Column:
    return F.filter(F.transform(text.tokens(F.col(c)), lambda t: F.regexp_replace(t, r"\.+$", "")), lambda t: t != "")


def alias_tiers(asked: DataFrame, card: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, match, tier, confidence) of names ``asked`` (id, name, day) among the fighters of a day's ``card`` (day, fighter, fighter_name).

    Tiers, the first that answers: 1 same last name and a shared first token or its initial, one such fighter; 2 the
    only fighter of that last name on the card; 3 to 5 the ``registry`` (alias, canonical, tier), on the card or, with
    less confidence, anywhere; 6 the same set of tokens. An initial alone doesn't choose among several of one last name.
    """
    # names repeat: each is taken apart once, and each name of a day is answered once
    last, firsts = F.try_element_at("t", F.lit(-1)), F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0)))
    whole = F.array_join(F.array_sort(F.array_distinct("t")), " ")
    lexicon = asked.select("name").union(card.select("fighter_name")).distinct().filter("name is not null").withColumn("t", _tokens("name"))
    lexicon = stored(lexicon.select("name", last.alias("last"), firsts.alias("firsts"), F.array_join("t", " ").alias("n"), whole.alias("set")))
    own = asked.select("name", "day").distinct().join(lexicon, "name", "left")
    card = stored(card.select("day", "fighter", F.col("fighter_name").alias("name")).join(lexicon, "name", "left"))
    held = card.dropDuplicates(["day", "fighter"]).select(F.col("day").alias("cday"), F.struct("fighter").alias("who"), F.col("last").alias("clast"), F.col("firsts").alias("cfirsts"))
    same = held.groupBy("cday", "clast").agg(F.count("who.fighter").alias("same_last"), F.min("who.fighter").alias("only"))
    met = own.join(same, (F.col("day") == F.col("cday")) & (F.col("last") == F.col("clast")), "left").drop("cday", "clast").withColumn("same_last", F.coalesce("same_last", F.lit(0)))
    # a key is a first token, or the first letter of one; of those whom a key hits, the least and the last tell whether it is one
    letters = F.transform(F.filter("cfirsts", lambda c: c != ""), lambda c: F.concat(F.lit("i:"), F.substring(c, 1, 1)))
    keys = F.explode(F.array_distinct(F.concat(F.transform("cfirsts", lambda c: F.concat(F.lit("t:"), c)), letters)))
    hit = held.select("cday", "clast", "who", keys.alias("key")).groupBy("cday", "clast", "key").agg(F.min("who").alias("least"), F.max("who").alias("most"))
    wanted = F.explode(F.array_distinct(F.concat(F.transform("firsts", lambda k: F.concat(F.lit("t:"), k)), F.transform(F.filter("firsts", lambda k: F.length(k) == 1), lambda k: F.concat(F.lit("i:"), k)))))
    looked = own.select("name", "day", "last", wanted.alias("key")).distinct()
    found = looked.join(hit.withColumnRenamed("key", "ckey"), (F.col("day") == F.col("cday")) & (F.col("last") == F.col("clast")) & (F.col("key") == F.col("ckey"))).groupBy("name", "day").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    by = met.join(found, ["name", "day"], "left")
    short = F.exists("firsts", lambda k: F.length(k) <= 1)
    first = F.when((F.col("least") == F.col("most")) & ~((F.col("same_last") > 1) & short), F.col("least.fighter"))
    second = F.when(F.col("same_last") == 1, F.col("only"))

    norm = lambda c: F.array_join(_tokens(c), " ")
    people = card.groupBy(F.col("n").alias("cn")).agg(F.max("fighter").alias("anywhere"))
    here = card.groupBy(F.col("day").alias("hday"), F.col("n").alias("hn")).agg(F.max("fighter").alias("here"))
    reg = registry.select(norm("alias").alias("alias"), norm("canonical").alias("rn"), F.col("tier").alias("rtier")).groupBy("alias").agg(F.min(F.struct("rtier", "rn")).alias("r")).select("alias", "r.*")
    named = by.join(reg, F.col("n") == F.col("alias"), "left").join(here, (F.col("day") == F.col("hday")) & (F.col("rn") == F.col("hn")), "left").join(people, F.col("rn") == F.col("cn"), "left")

    sets = card.groupBy(F.col("day").alias("sday"), F.col("set").alias("cset")).agg(F.min("fighter").alias("sixth"))
    full = named.join(sets, (F.col("day") == F.col("sday")) & (F.col("set") == F.col("cset")), "left")
    listed = F.col("rtier").isNotNull()
    tier = (
        F.when(first.isNotNull(), "1").when(second.isNotNull(), "2").when(listed, F.col("rtier").cast("string")).when(F.col("sixth").isNotNull(), "6")
        .when(F.col("same_last") > 1, "ambiguous-same-card-lastname").otherwise("no-match")
    )
    match = F.coalesce(first, second, F.when(listed, F.coalesce("here", "anywhere")).otherwise(F.col("sixth")))
    confidence = (
        F.when(tier == "1", "high").when(tier == "2", "med").when(listed & tier.isin("3", "4", "5"), F.when(F.col("here").isNotNull(), "med").otherwise("low")).when(tier == "6", "med")
        .otherwise("requires-manual-review")
    )
    answers = full.select(F.col("name").alias("__name"), F.col("day").alias("__day"), match.alias("match"), tier.alias("tier"), confidence.alias("confidence"))
    rows = asked.select("id", "name", "day").distinct().join(answers, F.col("name").eqNullSafe(F.col("__name")) & F.col("day").eqNullSafe(F.col("__day")))
    return rows.select("id", "match", "tier", "confidence")
