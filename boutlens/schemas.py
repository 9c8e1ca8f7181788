"""Fixed schemas of the stored tables, and the values that their columns may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def _ddl(text: str) -> StructType:
    from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, TimestampNTZType

    kinds = {"int": IntegerType(), "long": LongType(), "double": DoubleType(), "string": StringType(), "date": DateType(), "boolean": BooleanType(), "timestamp": TimestampNTZType(), "strings": ArrayType(StringType()), "doubles": ArrayType(DoubleType())}
    fields = []
    for part in text.replace("\n", " ").split(","):
        name, kind = part.split()
        fields.append(StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
    return StructType(fields)


#: a type that ends in ! may not be null
FIGHTERS = _ddl("id long!, name string!, nickname string, height_inches double, reach_inches double, leg_reach_inches double, stance string, date_of_birth date, source string!, source_id string, pre_ufc_record string")
ALIASES = _ddl("id long!, fighter_id long!, alias_name string!, source string!")
EVENTS = _ddl("id long!, name string!, date date!, location string, source string!, source_url string, referee_id long, venue_id long")
FIGHTS = _ddl("""id long!, event_id long!, fighter_a_id long!, fighter_b_id long!, winner_id long, weight_class string!, method string, method_detail string, round_finished int,
time_finished string, is_title_fight boolean!, num_rounds int!, source string!, source_url string""")
ROUND_STATS = _ddl("""id long!, fight_id long!, fighter_id long!, round_number int!, sig_strikes_landed int, sig_strikes_attempted int, head_strikes_landed int, body_strikes_landed int,
leg_strikes_landed int, distance_strikes_landed int, clinch_strikes_landed int, ground_strikes_landed int, takedowns_landed int, takedowns_attempted int, submission_attempts int,
reversals int, control_time_seconds int, knockdowns int""")
FIGHT_ODDS = _ddl("fight_id long!, fighter_id long!, opening_ml int, closing_range_min_ml int, closing_range_max_ml int, opening_implied_prob double, closing_implied_prob double, source string!, scraped_at timestamp")
ELO_SNAPSHOTS = _ddl("fighter_id long!, fight_id long!, division string!, elo_type string!, elo_before double!, elo_after double!, elo_after_shrinkage double!, k_factor_used double!, fight_date date!")
COMPUTED_FEATURES = _ddl("fighter_id long!, fight_id long!, as_of_date date, feature_set_version string!, features string!")
REFEREES = _ddl("id long!, name string!, normalized_name string!, alias_list strings")
VENUES = _ddl("id long!, name string!, city string, state string, country string!, lat double!, lon double!, timezone_iana string!, n_events int, geocode_source string")
MODEL_RUNS = _ddl("id long!, model_name string!, model_version string!, calibration_method string, cutoff_date date!, n_training_fights int, n_test_fights int, trained_at timestamp!, model_artifact_sha256 string, metadata_json string")
EVAL_SLICES = _ddl("slice_name string!, feature_vector doubles!, outcome int!, substrate_sha string!")

#: keys that no two rows share
KEYS = {
    "fighters": ["id"], "aliases": ["alias_name", "source"], "events": ["id"], "fights": ["id"], "round_stats": ["fight_id", "fighter_id", "round_number"], "fight_odds": ["fight_id", "fighter_id"],
    "referees": ["normalized_name"], "venues": ["id"], "model_runs": ["id"],
}
CHECKS = {
    "fights": {"num_rounds": "num_rounds between 1 and 5", "same_fighter": "fighter_a_id <> fighter_b_id"}, "round_stats": {"round_number": "round_number between 0 and 5"},
    "elo_snapshots": {"elo_type": "elo_type in ('overall', 'striking', 'grappling')"},
}


def faults(rows: DataFrame, schema: StructType, keys: list[str] | None = None, checks: dict[str, str] | None = None) -> DataFrame:
    """(rule, n): nulls where none may be, broken checks and repeated keys of a table; one pass and one for the keys."""
    rules = {f"null {f.name}": F.count_if(F.col(f.name).isNull()) for f in schema if not f.nullable}
    rules |= {name: F.count_if(~F.coalesce(F.expr(c), F.lit(True))) for name, c in (checks or {}).items()}
    out = rows.agg(*(c.alias(n) for n, c in rules.items())).unpivot([], list(rules), "rule", "n") if rules else None
    if keys:
        twice = rows.groupBy(*keys).agg(F.count("*").alias("k")).filter("k > 1").agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).cast("long").alias("n")).select(F.lit("repeated key").alias("rule"), "n")
        out = twice if out is None else out.unionByName(twice)
    return out


def conform(rows: DataFrame, schema: StructType) -> DataFrame:
    """``rows`` with the schema's columns, in order and cast; columns that are missing are null, others go."""
    held = {c.lower() for c in rows.columns}
    kind = lambda t: t if isinstance(t, DataType) else DataType.fromDDL(str(t))
    return rows.select(*((F.col(f.name) if f.name.lower() in held else F.lit(None)).cast(kind(f.dataType)).alias(f.name) for f in schema))
