"""Delimited files, checked Parquet tables and JSON.

Delimited files are read as text under a fixed schema, never by inference, and typed by expressions; a row that can't
be used is kept with its reason, never dropped in silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from boutlens.functions import dates, text
from boutlens.functions import odds as fn

PROFILE = ["fighter_name", "Height", "Weight", "Reach", "Stance", "DOB"]
ODDS = ["fight_id", "fighter_id", "opening", "closing_range_min", "closing_range_max"]
LINKS = ["fighter_id", "database", "name", "database_id"]
VENUE = ["venue_id", "name", "city", "state", "country", "lat", "lon", "timezone_iana", "n_events", "geocode_source"]
SEED = ["fighter_id", "n_pre_ufc_fights", "win_rate", "org_tier"]
SUPPLEMENT = [
    "R_fighter", "B_fighter", "date", "Winner", "weight_class", "title_bout", "no_of_rounds", "finish", "finish_details", "finish_round", "finish_round_time", "location",
    "R_Height_cms", "R_Reach_cms", "R_Stance", "R_age", "B_Height_cms", "B_Reach_cms", "B_Stance", "B_age",
]
#: statistics of one corner in the semicolon-separated contest file, after the prefix R_ or B_
PAIRED = {"SIG_STR.": "sig", "TOTAL_STR.": "total", "TD": "td", "HEAD": "head", "BODY": "body", "LEG": "leg", "DISTANCE": "distance", "CLINCH": "clinch", "GROUND": "ground"}
COUNTED = {"KD": "knockdowns", "SUB_ATT": "submission_attempts", "REV": "reversals"}


def strings(spark: SparkSession, path, columns: list[str], sep: str = ",") -> DataFrame:
    """A delimited file with a header, the named columns as text; columns that the file lacks are null."""
    head = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in head])
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return rows.select(*(F.col(f"`{c}`") if c in head else F.lit(None).cast("string").alias(c) for c in columns))


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists on its file system."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return p
    return None


def profiles(spark: SparkSession, path) -> DataFrame:
    """Fighters: name, height, reach, stance, date of birth."""
    rows = strings(spark, path, PROFILE)
    return rows.filter(text.present(F.col("fighter_name")).isNotNull()).select(
        F.trim("fighter_name").alias("name"), text.height_inches(F.col("Height")).alias("height"), text.reach_inches(F.col("Reach")).alias("reach"),
        text.present(F.col("Stance")).alias("stance"), dates.any_date(F.col("DOB")).alias("born"),
    )


def split_valid(rows: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reason``): the first rule that a row breaks."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        reason = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def contests(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(bouts, rejected) of the semicolon-separated file; the winner is the side whose name the file repeats."""
    corner = [f"{p}_{c}" for p in "RB" for c in (*COUNTED, *PAIRED, "CTRL")]
    rows = strings(spark, path, ["R_fighter", "B_fighter", *corner, "win_by", "last_round", "last_round_time", "Format", "Referee", "date", "location", "Fight_type", "Winner"], ";")
    method, detail = text.method_and_detail(F.col("win_by"))
    red, blue = F.trim("R_fighter"), F.trim("B_fighter")
    typed = rows.withColumns({
        "day": dates.any_date(F.col("date")), "division": text.division(F.col("Fight_type")), "is_title": text.is_title(F.col("Fight_type")), "rounds": text.num_rounds(F.col("Format")),
        "method": method, "detail": detail, "round_finished": F.col("last_round").try_cast("int"),
        "winner": F.when(F.trim("Winner") == red, red).when(F.trim("Winner") == blue, blue), "referee": text.slug(F.col("Referee"), {"herbert-dean": "herb-dean"}),
    })
    tomorrow = F.date_add(F.current_date(), 1)
    return split_valid(typed, [
        ("no date", F.col("day").isNotNull()), ("date in the future", F.col("day") <= tomorrow), ("no name", (red != "") & (blue != "")), ("same fighter twice", red != blue),
        ("unknown division", F.col("division").isin(text.DIVISIONS)), ("rounds", F.col("rounds").between(1, 5)),
    ])


def corner_stats(bouts: DataFrame) -> DataFrame:
    """Two rows a bout of contests(): each corner's statistics."""

    def corner(p: str) -> DataFrame:
        columns = [F.col(f"`{p}_{c}`").try_cast("int").alias(n) for c, n in COUNTED.items()]
        for c, n in PAIRED.items():
            landed, attempted = text.landed_of(F.col(f"`{p}_{c}`"))
            columns += [landed.alias(f"{n}_landed"), attempted.alias(f"{n}_attempted")]
        name = F.trim(f"{p}_fighter").alias("fighter")
        return bouts.select("day", F.trim("R_fighter").alias("red"), F.trim("B_fighter").alias("blue"), name, *columns, text.clock_seconds(F.col(f"`{p}_CTRL`")).alias("control"))

    return corner("R").unionByName(corner("B"))


def supplement(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(bouts, fighters) of the supplement file: lengths in centimetres, ages for dates of birth, the winner by colour."""
    rows = strings(spark, path, SUPPLEMENT).withColumn("day", dates.any_date(F.col("date")))
    red, blue = F.trim("R_fighter"), F.trim("B_fighter")
    finish = text.blank_to_null(F.col("finish"))
    bouts = rows.select(
        "day", red.alias("red"), blue.alias("blue"), F.when(F.col("Winner") == "Red", red).when(F.col("Winner") == "Blue", blue).alias("winner"), text.division(F.col("weight_class")).alias("division"),
        text.truthy(F.col("title_bout")).alias("is_title"), F.coalesce(F.col("no_of_rounds").try_cast("int"), F.lit(3)).alias("rounds"), F.when(finish == "Overturned", "Other").otherwise(finish).alias("method"),
        text.blank_to_null(F.col("finish_details")).alias("detail"), F.col("finish_round").try_cast("double").cast("int").alias("round_finished"), F.col("finish_round_time").alias("time_finished"),
    )

    def corner(p: str) -> DataFrame:
        length = lambda c: text.positive_cm_to_inches(F.col(f"{p}_{c}_cms").try_cast("double"))
        return rows.select(
            F.trim(f"{p}_fighter").alias("name"), length("Height").alias("height"), length("Reach").alias("reach"), text.blank_to_null(F.col(f"{p}_Stance")).alias("stance"),
            dates.born_from_age(F.col(f"{p}_age").try_cast("double"), F.col("day")).alias("born"), "day",
        )

    latest = corner("R").unionByName(corner("B")).filter("name is not null and name <> ''")
    fighters = latest.groupBy("name").agg(F.max(F.struct("day", "height", "reach", "stance", "born")).alias("s"))
    return bouts.filter("day is not null"), fighters.select("name", "s.height", "s.reach", "s.stance", "s.born")


def odds(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(sides of bouts with exactly two rows, rejected rows): prices typed, the date read out of the bout's key."""
    rows = strings(spark, path, ODDS)
    day, _, _ = text.pair_key_parts(F.col("fight_id"))
    number = lambda c: text.blank_to_null(F.col(c)).try_cast("int").alias(c)
    typed = rows.select(F.trim("fight_id").alias("fight_id"), F.trim("fighter_id").alias("fighter_id"), number("opening"), number("closing_range_min"), number("closing_range_max"), day.alias("day"))
    good, bad = split_valid(typed, [("no fight", text.blank_to_null(F.col("fight_id")).isNotNull()), ("no fighter", text.blank_to_null(F.col("fighter_id")).isNotNull()), ("no date", F.col("day").isNotNull())])
    sizes = good.groupBy("fight_id").agg(F.count("*").alias("n"))
    met = good.join(sizes, "fight_id")
    alone = met.filter("n <> 2").drop("n").withColumn("reason", F.lit("not two sides"))
    return met.filter("n = 2").drop("n"), bad.unionByName(alone)


def fair_odds(sides: DataFrame) -> DataFrame:
    """Sides of odds() with both fair probabilities: each row meets the other of its bout."""
    p = sides.select("fight_id", "fighter_id", "day", fn.implied_probability(F.col("opening")).alias("o"), fn.closing_consensus(F.col("closing_range_min"), F.col("closing_range_max")).alias("c"))
    other = p.select("fight_id", F.col("fighter_id").alias("other"), F.col("o").alias("oo"), F.col("c").alias("oc"))
    met = p.join(other, "fight_id").filter("fighter_id <> other")
    return met.select("fight_id", "fighter_id", "day", fn.devig(F.col("o"), F.col("oo")).alias("opening_implied_prob"), fn.devig(F.col("c"), F.col("oc")).alias("closing_implied_prob"))


def name_links(spark: SparkSession, path) -> DataFrame:
    rows = strings(spark, path, LINKS)
    return rows.select(*(text.blank_to_null(F.col(c)).alias(c) for c in LINKS)).filter("fighter_id is not null and name is not null")


def venues(spark: SparkSession, path) -> DataFrame:
    rows = strings(spark, path, VENUE)
    kinds = {"venue_id": "int", "lat": "double", "lon": "double", "n_events": "int"}
    return rows.select(*(text.blank_to_null(F.col(c)).try_cast(kinds.get(c, "string")).alias(c) for c in VENUE))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(fighter_id, seed); no file gives no rows, a blank in a required column or an unknown tier raises when read."""
    if first_existing(spark, path) is None:
        return spark.createDataFrame([], "fighter_id long, seed double")
    rows = strings(spark, path, SEED)
    need = lambda c, kind: F.coalesce(text.blank_to_null(F.col(c)).try_cast(kind), F.raise_error(F.concat(F.lit(f"{c} is blank or unreadable for fighter "), F.coalesce(F.col("fighter_id"), F.lit("?")))).cast(kind))
    return rows.select(need("fighter_id", "long").alias("fighter_id"), fn.seed_rating(need("win_rate", "double"), need("n_pre_ufc_fights", "int"), need("org_tier", "string")).alias("seed"))


def checked_parquet(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table whose footer has the columns and types asked for; what is wrong is named before any row is read."""
    got = {f.name: f.dataType for f in spark.read.parquet(path).schema}
    missing = [f.name for f in schema if f.name not in got]
    wrong = [f"{f.name}: {got[f.name].simpleString()} for {f.dataType.simpleString()}" for f in schema if f.name in got and got[f.name] != f.dataType]
    if missing or wrong:
        raise ValueError(f"{path}: missing {missing}, of another type {wrong}")
    return spark.read.parquet(path).select(*(f.name for f in schema))


def with_sidecar(spark: SparkSession, path: str, sidecar: str, expected: dict) -> DataFrame:
    """A Parquet table whose JSON sidecar has the ``expected`` values, such as the model's digest, width and cutoff."""
    held = spark.read.option("multiLine", True).json(sidecar).first().asDict()
    wrong = {k: (held.get(k), v) for k, v in expected.items() if held.get(k) != v}
    if wrong:
        raise ValueError(f"{sidecar}: {wrong}")
    return spark.read.parquet(path)


def latest_version(paths: DataFrame, column: str = "path") -> DataFrame:
    """One row: the path of the greatest number behind the last _v."""
    number = F.nullif(F.regexp_extract(column, r"_v(\d+)[^/]*$", 1), F.lit("")).try_cast("int")
    return paths.agg(F.max_by(column, number).alias(column), F.max(number).alias("version"))
