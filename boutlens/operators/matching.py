"""Joins by pair, day and name, and the choice among duplicates.

Pairs meet under an unordered key, so that a join on either orientation is one equi-join; days within a tolerance
meet in buckets of days, never in a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order in which sources are believed.
SOURCES = {"ufcstats": 0, "sherdog": 1, "kaggle-rajeevw": 2, "kaggle-mdabbert": 3}


def unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})


def pair_match(left: DataFrame, right: DataFrame, a: str = "a", b: str = "b", day: str = "day") -> DataFrame:
    """``left`` with match_id and match ("exact", "swapped" or null) of ``right`` (id, day, a, b): same day, same pair.

    Of several matches the one of the least id is taken, exact before swapped.
    """
    own = unordered(right, a, b).select(F.col(day).alias("r_day"), "lo", "hi", F.struct(F.col(a).alias("ra"), F.col("id").alias("rid")).alias("m"))
    best = own.groupBy("r_day", "lo", "hi").agg(F.min("m.rid").alias("any"), F.min(F.when(F.col("m.ra") == F.col("lo"), F.col("m.rid"))).alias("forward"), F.min(F.when(F.col("m.ra") != F.col("lo"), F.col("m.rid"))).alias("backward"))
    met = unordered(left, a, b).join(best.withColumnsRenamed({"lo": "rlo", "hi": "rhi"}), (F.col(day) == F.col("r_day")) & (F.col("lo") == F.col("rlo")) & (F.col("hi") == F.col("rhi")), "left")
    exact = F.when(F.col(a) == F.col("lo"), F.col("forward")).otherwise(F.col("backward"))
    match = F.when(exact.isNotNull(), "exact").when(F.col("any").isNotNull(), "swapped")
    return met.select(*left.columns, F.coalesce(exact, F.col("any")).alias("match_id"), match.alias("match"))


def pair_unmatched(left: DataFrame, right: DataFrame, a: str = "a", b: str = "b", day: str = "day") -> DataFrame:
    """Rows of ``left`` whose pair doesn't meet on that day in ``right``, in either orientation."""
    keys = unordered(right, a, b).select(day, "lo", "hi")
    return unordered(left, a, b).join(keys, [day, "lo", "hi"], "left_anti").select(*left.columns)


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, columns: list[str], strict: bool = True) -> DataFrame:
    """``left`` with last_<column> of the latest row of ``right`` of the same key before (or at) its time.

    One union and one window: rows of both meet in the order of time, and the last seen state is carried on.
    """
    state = right.select(key, F.col(at).alias("__asof_at"), F.lit(1 if strict else -1).alias("__asof_side"), F.struct(at, *columns).alias("__asof_state"), *(F.lit(None).cast(left.schema[c].dataType).alias(f"__own_{c}") for c in left.columns))
    asked = left.select(key, F.col(at).alias("__asof_at"), F.lit(0).alias("__asof_side"), F.lit(None).cast(state.schema["__asof_state"].dataType).alias("__asof_state"), *(F.col(c).alias(f"__own_{c}") for c in left.columns))
    w = Window.partitionBy(key).orderBy("__asof_at", "__asof_side", F.col("__asof_state")).rowsBetween(Window.unboundedPreceding, 0)
    seen = state.unionByName(asked).withColumn("__asof_last", F.last("__asof_state", ignorenulls=True).over(w)).filter("__asof_side = 0")
    return seen.select(*(F.col(f"__own_{c}").alias(c) for c in left.columns), *(F.col(f"__asof_last.{c}").alias(f"last_{c}") for c in [at, *columns]))


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, day: str, within: int) -> DataFrame:
    """``left`` ids with the id of the row of ``right`` nearest in days, at most ``within`` away; ties by day, then id.

    Rows of both sides meet once in the order of days, forwards and backwards: each carries the last seen row of ``right``
    on. Days that are dense cost no more than others. Null keys and days meet nothing.
    """
    left, right = (df.dropna(subset=[*keys, day]) for df in (left, right))
    held = right.groupBy(*keys, F.col(day).alias("__day")).agg(F.min(right_id).alias("__id")).select(*keys, "__day", F.lit(0).alias("__side"), F.struct("__day", "__id").alias("__row"), F.lit(None).cast(left.schema[left_id].dataType).alias(left_id))
    asked = left.select(*keys, F.col(day).alias("__day"), F.lit(1).alias("__side"), F.lit(None).cast(held.schema["__row"].dataType).alias("__row"), left_id)
    seen = lambda order: F.last("__row", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, 0))
    met = held.unionByName(asked).withColumns({"__before": seen(F.asc("__day")), "__after": seen(F.desc("__day"))}).filter("__side = 1")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.datediff("__day", F.col(f"{c}.__day"))).alias("gap"), F.col(f"{c}.__day").alias("day"), F.col(f"{c}.__id").alias("id")))
    best = met.select(left_id, F.least(near("__before"), near("__after")).alias("best")).filter(F.col("best.gap") <= within)
    return best.groupBy(left_id).agg(F.min("best").alias("best")).select(left_id, F.col("best.id").alias("match_id"), F.col("best.gap").alias("days_apart"))


def priority(source: Column) -> Column:
    found = F.lit(99)
    for name, place in SOURCES.items():
        found = F.when(source == name, place).otherwise(found)
    return found


def prefer_canonical(rows: DataFrame, key: Column, source: str, tie: str) -> DataFrame:
    """Of rows of equal key the one of the most trusted source, then the least ``tie``: a struct minimum, no sort."""
    best = F.min(F.struct(priority(F.col(source)).alias("p"), F.col(tie).alias("t"), F.struct(*rows.columns).alias("row")))
    return rows.groupBy(key.alias("__key")).agg(best.alias("best")).select("best.row.*")


def search(people: DataFrame, aliases: DataFrame, text: str) -> DataFrame:
    """People whose name, or one of whose aliases, holds the text, whatever the case."""
    wanted = F.lit(text.lower())
    hit = aliases.filter(F.contains(F.lower("alias"), wanted)).select(F.col("id").alias("__id")).distinct()
    met = people.join(hit, F.col("id") == F.col("__id"), "left")
    return met.filter(F.contains(F.lower("name"), wanted) | F.col("__id").isNotNull()).drop("__id")


def resolve_name(people: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, id, candidates): the one person whom a name means, null where none or several do.

    An exact name wins over a part of a name; of duplicates the canonical row counts.
    """
    own = people.select("id", F.lower("name").alias("n"), priority(F.col("source")).alias("p"))
    person = own.groupBy("n").agg(F.min(F.struct("p", "id")).alias("best")).select("n", "best.id")
    asked = wanted.select("wanted", F.lower("wanted").alias("w"))
    exact = asked.join(person, F.col("w") == F.col("n")).select("wanted", "id", F.lit(1).alias("candidates"))
    rest = asked.join(exact.select("wanted"), "wanted", "left_anti")
    words = person.select("id", "n", F.explode(F.split("n", r"\s+")).alias("t"))
    part = rest.select("wanted", "w", F.element_at(F.split("w", r"\s+"), 1).alias("t")).join(words, "t").filter(F.contains("n", F.col("w")))
    found = part.groupBy("wanted").agg(F.min("id").alias("id"), F.countDistinct("id").alias("candidates"))
    loose = rest.select("wanted").join(found, "wanted", "left").select("wanted", F.when(F.col("candidates") == 1, F.col("id")).alias("id"), F.coalesce("candidates", F.lit(0)).cast("int").alias("candidates"))
    return exact.unionByName(loose)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], nulls_overwrite: bool = False) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key: new values win, nulls only with ``nulls_overwrite``.

    Rows of ``new`` that share a key must have been folded to one.
    """
    values = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, F.lit(True).alias("__new"), *(F.col(c).alias(f"__{c}") for c in values))
    met = old.withColumn("__old", F.lit(True)).join(fresh, keys, "full")
    pick = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) if nulls_overwrite else F.coalesce(f"__{c}", c)
    return met.select(*(F.col(c) if c in keys else pick(c).alias(c) for c in old.columns))


def fill_nulls(preferred: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``preferred`` with its nulls filled from ``other``, and the rows that only ``other`` has."""
    values = [c for c in preferred.columns if c not in keys]
    met = preferred.join(other.select(*keys, *(F.col(c).alias(f"__{c}") for c in values)), keys, "full")
    return met.select(*(F.col(c) if c in keys else F.coalesce(c, f"__{c}").alias(c) for c in preferred.columns))


def set_once(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` set where it was null, never overwritten."""
    met = old.join(new.select(key, F.col(column).alias("__new")), key, "left")
    return met.select(*(F.coalesce(column, "__new").alias(column) if c == column else F.col(c) for c in old.columns))


def proportional_sample(rows: DataFrame, key: str, k: int, seed: int, strata: str) -> DataFrame:
    """``k`` rows, of each stratum in proportion to its size, by the least hash of key and seed: all where there are fewer.

    Shares are whole by the largest remainder: a stratum gets its share rounded down, and what is left goes to the
    strata of the largest remainders, ties to the least name; small strata may get none. Strata fold to one row each
    before they are ranked; null is a stratum.
    """
    sizes = rows.groupBy(F.col(strata).alias("__stratum")).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__total"), F.least(F.sum("__n"), F.lit(k)).alias("__k"))
    parts = sizes.join(F.broadcast(total)).withColumns({"__base": F.expr("__n * __k div __total"), "__rest": F.expr("__n * __k % __total")})
    given = parts.agg(F.sum("__base").alias("__given"))
    place = F.row_number().over(Window.orderBy(F.desc("__rest"), F.col("__stratum").asc_nulls_first()))
    takes = parts.join(F.broadcast(given)).withColumn("__take", F.col("__base") + (place <= F.col("__k") - F.col("__given")).cast("long")).select("__stratum", "__take")
    order = [F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]
    own = rows.withColumn("__place", F.row_number().over(Window.partitionBy(strata).orderBy(*order)))
    return own.join(takes, F.col(strata).eqNullSafe(F.col("__stratum"))).filter(F.col("__place") <= F.col("__take")).select(rows.columns)


def sample_by_hash(rows: DataFrame, key: str, k: int, seed: int, strata: str | None = None) -> DataFrame:
    """The ``k`` rows (of each stratum) of the least hash of key and seed: the same ones at every run."""
    order = [F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]
    if strata is None:
        return rows.orderBy(*order).limit(k)
    place = F.row_number().over(Window.partitionBy(strata).orderBy(*order))
    return rows.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")
