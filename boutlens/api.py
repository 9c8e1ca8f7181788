"""The public read surface: functions from stored tables to result tables.

A ``Store`` names the tables: fighters (id, name, source, height, reach, stance, born), aliases (id, alias), bouts
(fight_id, event_date, division, fighter_a, fighter_b, winner, method), snapshots (fighter, fight_id, division, elo_type,
before, after, shown, event_date) and features (fighter, fight_id, as_of, numbers and style_tag).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlens.functions import dates
from boutlens.functions import odds as fn
from boutlens.functions import text
from boutlens.operators import matching

PAIRS = ["sig_str_per_minute", "td_rate", "td_accuracy", "td_defense", "strike_defense", "ctrl_time_per_fight"]


@dataclass(frozen=True)
class Store:
    fighters: DataFrame
    aliases: DataFrame
    bouts: DataFrame
    snapshots: DataFrame
    features: DataFrame | None = None


def _latest(snapshots: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """The latest snapshot of each key; of one day's the one of the greatest bout."""
    best = snapshots.groupBy(*keys).agg(F.max(F.struct("event_date", "fight_id", *columns)).alias("s"))
    return best.select(*keys, *(F.col(f"s.{c}").alias(c) for c in ("event_date", "fight_id", *columns)))


def sides(bouts: DataFrame) -> DataFrame:
    """A row for each fighter of a bout, with the opponent and whether they won; null without a winner."""
    both = F.explode(F.array(F.struct(F.col("fighter_a").alias("f"), F.col("fighter_b").alias("o")), F.struct(F.col("fighter_b").alias("f"), F.col("fighter_a").alias("o"))))
    return bouts.withColumn("s", both).select(
        "fight_id", "event_date", "division", "method", F.col("s.f").alias("fighter"), F.col("s.o").alias("opponent"), (F.col("winner") == F.col("s.f")).cast("int").alias("won")
    )


def search_fighters(store: Store, name: str) -> DataFrame:
    """Fighters a part of whose name, or of an alias, is ``name``, whatever the case; by name, then id."""
    return matching.search(store.fighters, store.aliases, name).orderBy("name", "id")


def divisions(store: Store, fighter: int | None = None) -> DataFrame:
    """The divisions bouts were held in, of one fighter's where one is named, in order."""
    s = sides(store.bouts)
    return (s if fighter is None else s.filter(F.col("fighter") == fighter)).select("division").distinct().orderBy("division")


def fighter_detail(store: Store, fighter: int, division: str | None = None) -> DataFrame:
    """One row a division: rating, bouts, wins, losses (draws are neither)."""
    s = sides(store.bouts).filter(F.col("fighter") == fighter)
    snaps = store.snapshots.filter((F.col("fighter") == fighter) & (F.col("elo_type") == "overall"))
    if division is not None:
        s, snaps = s.filter(F.col("division") == division), snaps.filter(F.col("division") == division)
    record = s.groupBy("division").agg(F.count("*").alias("bouts"), F.count_if(F.col("won") == 1).alias("wins"), F.count_if(F.col("won") == 0).alias("losses"))
    rated = _latest(snaps, ["division"], "shown").select("division", F.col("shown").alias("rating"), F.col("event_date").alias("rated_on"))
    return record.join(rated, "division", "left").select(F.lit(fighter).alias("fighter"), "division", "rating", "rated_on", "bouts", "wins", "losses").orderBy("division")


def domain_ratings(store: Store, fighter: int) -> DataFrame:
    """(striking, grappling): the latest displayed rating of each domain, null where there is none."""
    d = store.snapshots.filter((F.col("fighter") == fighter) & F.col("elo_type").isin("striking", "grappling"))
    last = _latest(d, ["elo_type"], "shown")
    return last.agg(*(F.max(F.when(F.col("elo_type") == t, F.col("shown"))).alias(t) for t in ("striking", "grappling")))


def division_rankings(store: Store, division: str, limit: int = 15) -> DataFrame:
    """A division's fighters by displayed rating; entries of one name are one person, of whom the most trusted source counts."""
    snaps = store.snapshots.filter((F.col("division") == division) & (F.col("elo_type") == "overall"))
    rated = _latest(snaps, ["fighter"], "shown").join(store.fighters.select(F.col("id").alias("fighter"), "name", "source"), "fighter")
    one = rated.groupBy(F.lower("name").alias("k")).agg(F.min(F.struct(matching.priority(F.col("source")).alias("p"), (-F.col("shown")).alias("r"), "fighter", "name", "event_date")).alias("b"))
    n = sides(store.bouts).groupBy("fighter").agg(F.count("*").alias("bouts"))
    top = one.select("b.fighter", "b.name", (-F.col("b.r")).alias("rating"), F.col("b.event_date").alias("rated_on")).join(n, "fighter", "left").orderBy(F.desc("rating"), "fighter").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rating"), "fighter"))).select("place", "fighter", "name", "rating", "bouts", "rated_on")


def fighters_with_ratings(store: Store) -> DataFrame:
    """Every fighter's latest rating in each division, with both domains: one pass over the snapshots."""
    last = _latest(store.snapshots, ["fighter", "division", "elo_type"], "shown")
    wide = last.groupBy("fighter", "division").pivot("elo_type", ["overall", "striking", "grappling"]).agg(F.max("shown"))
    return wide.join(store.fighters.select(F.col("id").alias("fighter"), "name", "source"), "fighter").filter("overall is not null")


def elo_history(store: Store, fighter: int, elo_type: str = "overall") -> DataFrame:
    h = store.snapshots.filter((F.col("fighter") == fighter) & (F.col("elo_type") == elo_type))
    return h.select("event_date", "fight_id", "division", "before", "after", "shown").orderBy("event_date", "fight_id")


def common_division(a: Column, b: Column) -> tuple[Column, Column]:
    """(division, whether both have it) of two arrays: the first shared one by name, else each one's own first."""
    shared = F.array_sort(F.array_intersect(a, b))
    return F.coalesce(F.get(shared, F.lit(0)), F.get(F.array_sort(a), F.lit(0))), F.size(shared) > 0


def build_matchup(store: Store, name_a: str, name_b: str) -> DataFrame:
    """One row: two fighters side by side; null ids where a name means nobody or several.

    The weighted value of a feature counts where there is one, else the career's.
    """
    spark = store.fighters.sparkSession
    asked = spark.createDataFrame([("a", name_a), ("b", name_b)], "side string, wanted string")
    found = asked.join(matching.resolve_name(store.fighters, asked.select("wanted").distinct()), "wanted")
    ids = found.groupBy().pivot("side", ["a", "b"]).agg(F.first("id"))
    own = sides(store.bouts).groupBy("fighter").agg(F.collect_set("division").alias("divisions"))
    rated = _latest(store.snapshots, ["fighter", "elo_type", "division"], "shown")

    def side(s: str) -> DataFrame:
        f = store.fighters.withColumnsRenamed({c: f"{c}_{s}" for c in store.fighters.columns})
        return f.join(own.select(F.col("fighter").alias(f"id_{s}"), F.col("divisions").alias(f"divisions_{s}")), f"id_{s}", "left")

    met = ids.join(side("a"), F.col("a") == F.col("id_a"), "left").join(side("b"), F.col("b") == F.col("id_b"), "left")
    division, shared = common_division(F.col("divisions_a"), F.col("divisions_b"))
    met = met.withColumns({"division": division, "same_division": shared})
    last = F.broadcast(met.select("id_a", "id_b", "division"))
    for s in "ab":
        wide = rated.join(last, (F.col("fighter") == F.col(f"id_{s}")) & (rated.division == last.division)).groupBy("fighter").pivot("elo_type", ["overall", "striking", "grappling"]).agg(F.max("shown"))
        met = met.join(wide.withColumnsRenamed({"fighter": f"__{s}", "overall": f"elo_{s}", "striking": f"striking_{s}", "grappling": f"grappling_{s}"}), F.col(f"id_{s}") == F.col(f"__{s}"), "left")
    now = F.current_date()
    age = lambda s: dates.years_between(F.col(f"born_{s}"), now)
    out = {
        "elo_diff": F.col("elo_a") - F.col("elo_b"), "expected_a": fn.expected_score(F.col("elo_a"), F.col("elo_b")), "height_diff": F.col("height_a") - F.col("height_b"),
        "reach_diff": F.col("reach_a") - F.col("reach_b"), "age_diff": age("a") - age("b"), "style_index_a": fn.style_index(F.col("striking_a"), F.col("grappling_a")),
        "style_index_b": fn.style_index(F.col("striking_b"), F.col("grappling_b")), "style_a": fn.style(F.col("striking_a"), F.col("grappling_a")), "style_b": fn.style(F.col("striking_b"), F.col("grappling_b")),
    }
    columns = ["id_a", "name_a", "id_b", "name_b", "division", "same_division", *(c.alias(n) for n, c in out.items())]
    if store.features is not None:
        latest = store.features.groupBy("fighter").agg(F.max(F.struct("as_of", "fight_id", *[c for c in store.features.columns if c not in ("fighter", "as_of", "fight_id")])).alias("s")).select("fighter", "s.*")
        for s in "ab":
            value = lambda c: F.coalesce(f"{c}_ewma", c) if f"{c}_ewma" in latest.columns else F.col(c)
            some = latest.select(F.col("fighter").alias(f"__f{s}"), *(value(c).alias(f"{c}_{s}") for c in PAIRS if c in latest.columns))
            met = met.join(some, F.col(f"id_{s}") == F.col(f"__f{s}"), "left")
        columns += [f"{c}_{s}" for c in PAIRS if c in latest.columns for s in "ab"]
    return met.select(*columns)


def resolve_division(store: Store, asked: str) -> str | None:
    """The rankable division that a user's text means."""
    spark = store.fighters.sparkSession
    return spark.range(1).select(text.matching_division(F.lit(asked))).first()[0]


def inference_rows(store: Store, pairs: DataFrame) -> DataFrame:
    """Rows to score for bouts to come: ``pairs`` (a, b, day) with both sides' latest ratings, features and measurements before the day.

    What lies on the day itself or later isn't read; a side without a rating has 1500, other gaps are null.
    """
    numbers = [n for n, k in store.features.dtypes if k in ("double", "int", "bigint") and n not in ("fighter", "fight_id")] if store.features is not None else []
    # a row's name is what it asks, so that it is the same however often it is evaluated
    asked = pairs.withColumn("row", F.to_json(F.struct("a", "b", "day")))
    both = asked.dropDuplicates(["row"]).select("row", F.col("day").alias("event_date"), F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("fighter")), F.struct(F.lit("b").alias("side"), F.col("b").alias("fighter")))).alias("s"))
    sides_ = both.select("row", "event_date", "s.side", "s.fighter")
    elo = store.snapshots.filter("elo_type = 'overall'")
    met = matching.asof_backward(sides_, elo, "fighter", "event_date", ["fight_id", "after"]).select("row", "event_date", "side", "fighter", F.coalesce("last_after", F.lit(1500.0)).alias("elo"))
    if numbers:
        known = store.features.withColumnRenamed("as_of", "event_date")
        met = matching.asof_backward(met, known, "fighter", "event_date", ["fight_id", *numbers]).drop("last_event_date", "last_fight_id").withColumnsRenamed({f"last_{n}": n for n in numbers})
    f = store.fighters.select(F.col("id").alias("fighter"), "height", "reach", "born")
    met = met.join(f, "fighter", "left").withColumn("age", dates.years_between(F.col("born"), F.col("event_date"))).drop("born")
    columns = ["elo", *numbers, "height", "reach", "age"]
    a, b = (met.filter(F.col("side") == s).select("row", *(F.col(c).alias(f"{c}_{s}") for c in columns)) for s in "ab")
    wide = asked.join(a, "row").join(b, "row")
    return wide.select("a", "b", "day", *((F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"{c}_diff") for c in columns), fn.expected_score(F.col("elo_a"), F.col("elo_b")).alias("elo_prob"))
