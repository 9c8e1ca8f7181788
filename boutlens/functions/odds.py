"""Scalar functions over market prices, ratings and outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rating's parameters, seed bonuses and country groups.
RATING = {
    "initial": 1500.0, "k_first": 40.0, "k_later": 20.0, "k_bouts": 5, "transfer": 0.5, "shrink_bouts": 5, "idle_days": 270, "idle_rate": 0.1, "idle_most": 0.5,
    "ko": 1.2, "submission": 1.1, "unanimous": 1.0, "split": 0.5, "draw": 0.5, "dq": 0.8,
}
TIER_BONUS = {"major": 50, "regional": 0, "local": -25, "none": -50}
ASIA_PACIFIC = ["Japan", "China", "Singapore", "Philippines", "South Korea", "Thailand"]
EUROPE = ["England", "Scotland", "Ireland", "Germany", "France", "Sweden", "Spain", "Italy", "Poland", "Netherlands", "Czech Republic"]
DIVISION_ORDER = {
    "Strawweight": 1, "Flyweight": 2, "Bantamweight": 3, "Featherweight": 4, "Lightweight": 5, "Welterweight": 6, "Middleweight": 7, "Light Heavyweight": 8,
    "Heavyweight": 9, "Women's Strawweight": 1, "Women's Flyweight": 2, "Women's Bantamweight": 3, "Women's Featherweight": 4,
}
MILES, KILOMETRES = 3958.7613, 6371.0088


def implied_probability(moneyline: Column) -> Column:
    """Of an American price; null inside (-100, 100), where no price exists."""
    return F.when(moneyline <= -100, -moneyline / (-moneyline + 100.0)).when(moneyline >= 100, 100.0 / (moneyline + 100.0))


def devig(p: Column, q: Column) -> Column:
    """The share of the two sides' probabilities."""
    return p / (p + q)


def closing_consensus(low: Column, high: Column) -> Column:
    """The mean of a price range, taken between probabilities."""
    return (implied_probability(low) + implied_probability(high)) / 2.0


def expected_score(rating: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - rating) / 400.0))


def k_factor(bouts_before: Column, config: dict = RATING) -> Column:
    return F.when(bouts_before < config["k_bouts"], config["k_first"]).otherwise(config["k_later"])


def margin(method: Column, detail: Column, draw: Column, config: dict = RATING) -> Column:
    """How much a bout counts, by the way it ended; unknown ways count like unanimous decisions."""
    return (
        F.when(draw, config["draw"]).when(method.isin("KO/TKO", "TKO"), config["ko"]).when(method.isin("Submission", "SUB"), config["submission"])
        .when((method == "S-DEC") | ((method == "Decision") & (F.trim(detail) == "Split")), config["split"]).when(method == "DQ", config["dq"]).otherwise(config["unanimous"])
    )


def inactivity(days: Column, config: dict = RATING) -> Column:
    """The share of a rating's distance from the start that a gap of so many days takes; null without one."""
    past = (days - config["idle_days"]) / 30.0
    return F.when(days > config["idle_days"], F.least(past * config["idle_rate"], F.lit(config["idle_most"]))).when(days.isNotNull(), 0.0)


def shown(rating: Column, bouts: Column, config: dict = RATING) -> Column:
    """The rating as displayed: near the start after few bouts."""
    return config["initial"] + (rating - config["initial"]) * F.least(bouts / config["shrink_bouts"], F.lit(1.0))


def seed_rating(win_rate: Column, bouts: Column, tier: Column) -> Column:
    """A newcomer's first rating from an earlier career; an unknown tier raises."""
    bonus = F.raise_error(F.concat(F.lit("unknown tier: "), tier))
    for name, value in TIER_BONUS.items():
        bonus = F.when(tier == name, F.lit(float(value))).otherwise(bonus)
    experience = F.greatest(F.lit(0.0), F.least(F.lit(25.0), bouts / 20.0 * 25.0))
    return F.greatest(F.lit(1300.0), F.least(F.lit(1700.0), 1500.0 + 100.0 * (win_rate - 0.5) + bonus + experience))


def outcome(method: Column) -> Column:
    """finish, decision or no_action; short forms of decisions are no_action, as in the reference."""
    finish = method.isin("KO/TKO", "TKO", "KO", "Submission", "SUB")
    decision = method.isin("Decision", "Decision - Unanimous", "Decision - Split", "Decision - Majority")
    return F.when(finish, "finish").when(decision, "decision").otherwise("no_action")


def edge_weight(method: Column, config: dict = RATING) -> Column:
    """A win's weight in the graph: here a majority decision counts half."""
    m = F.upper(method)
    return (
        F.when(m.isin("KO/TKO", "KO", "TKO"), config["ko"]).when(m.isin("SUB", "SUBMISSION"), config["submission"]).when(m.isin("S-DEC", "M-DEC"), config["split"])
        .when(m == "DQ", config["dq"]).otherwise(1.0)
    )


def country_bucket(country: Column) -> Column:
    return (
        F.when(country == "United States", "US").when(country == "Brazil", "BR").when(country == "Australia", "AU").when(country.isin(ASIA_PACIFIC), "ASIA-PACIFIC")
        .when(country.isin(EUROPE), "EU-OTHER").otherwise("UNKNOWN")
    )


def style_index(striking: Column, grappling: Column) -> Column:
    return striking - grappling


def style(striking: Column, grappling: Column, threshold: float = 30.0) -> Column:
    gap = striking - grappling
    return F.when(gap > threshold, "striker").when(gap < -threshold, "grappler").otherwise("balanced")


def same_stance(a: Column, b: Column) -> Column:
    """1 for equal stances; unknown ones and those that change count as orthodox."""
    plain = lambda s: F.coalesce(F.nullif(s, F.lit("Switch")), F.lit("Orthodox"))
    return (plain(a) == plain(b)).cast("double")


def division_ordinal(division: Column) -> Column:
    found = F.lit(5.0)
    for name, place in DIVISION_ORDER.items():
        found = F.when(division == name, F.lit(float(place))).otherwise(found)
    return found


def great_circle(lat: Column, lon: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


def clipped(value: Column, most: float) -> Column:
    return F.greatest(F.least(value, F.lit(most)), F.lit(-most))


def reach_over_mean(a: Column, b: Column, mean: Column) -> Column:
    return (a - b) / F.nullif(mean, F.lit(0.0))


def symmetric(forward: Column, reverse: Column) -> Column:
    """A probability that doesn't depend on which side is named first."""
    return 0.5 * (forward + (1 - reverse))


def calibration_method(rows: Column) -> Column:
    return F.when(rows >= 1000, "isotonic").otherwise("sigmoid")
