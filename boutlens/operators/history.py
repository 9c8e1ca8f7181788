"""Leakage-free features of a fighter's history: each row sees only the rows before it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def before(*keys: str, order=("event_date", "fight_id")):
    """All rows of the same keys before the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def ordered(*keys: str, order=("event_date", "fight_id")):
    return Window.partitionBy(*keys).orderBy(*order)


def total_before(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long")


def ewma(values: Column, alpha: float = 0.206) -> Column:
    """Exponentially weighted mean of an array: the first value seeds it, nulls are skipped, none gives 0."""
    seen = F.filter(values, lambda v: v.isNotNull())
    folded = F.aggregate(F.slice(seen, 2, F.greatest(F.size(seen) - 1, F.lit(0))), F.get(seen, F.lit(0)).cast("double"), lambda a, v: a * (1 - alpha) + v * alpha)
    return F.coalesce(folded, F.lit(0.0))


def last_values(df: DataFrame, columns: list[str], n: int, key: str = "fighter") -> DataFrame:
    """``df`` with last_<column>: the latest ``n`` values before each row that aren't null, in order.

    A value's number among a fighter's values bounds each list's window, so that no prefix is ever gathered whole.
    """
    for c in columns:
        df = df.withColumn(f"__k_{c}", F.count(c).over(before(key)))
    for c in columns:
        own = Window.partitionBy(key).orderBy(f"__k_{c}").rangeBetween(-n, -1)
        df = df.withColumn(f"last_{c}", F.collect_list(c).over(own))  # a frame's rows come in the window's order
    return df.drop(*(f"__k_{c}" for c in columns))


def mean_of_last(values: str, n: int) -> Column:
    """Mean of the last ``n`` of an array; null where it holds fewer."""
    return F.when(F.size(values) >= n, F.aggregate(F.slice(values, -n, n), F.lit(0.0), lambda a, v: a + v) / n)


def folded(df: DataFrame, means: dict[str, str | tuple[str, float]], lasts: dict[str, tuple[str, int]], alpha: float = 0.206, key: str = "fighter", order=("event_date", "fight_id")) -> DataFrame:
    """``df`` with running values of each key's earlier rows, in one ordered pass: nulls are skipped.

    ``means`` names exponentially weighted means: {output: column}, or {output: (column, its own alpha)}, seeded by the
    first value, 0 before it. ``lasts``
    names means of the last n values: {output: (column, n)}, null while there are fewer. A task holds the state of one
    key, however long its history is.
    """
    means = {name: m if isinstance(m, tuple) else (m, alpha) for name, m in means.items()}
    columns = sorted({*(c for c, _ in means.values()), *(c for c, _ in lasts.values())})
    outputs = [*means, *lasts]

    def run(batches):
        at, state = run, {}  # no key yet
        for b in batches:
            keys = b.column(key).to_pylist()
            # where a key ends
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            held = {c: b.column(c).to_pylist() for c in columns}
            made = {name: [] for name in outputs}
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                if lo == hi:
                    continue
                if keys[lo] != at:
                    at, state = keys[lo], {name: [] if name in lasts else None for name in outputs}
                for name, (c, share) in means.items():
                    mean, out = state[name], made[name]
                    for x in held[c][lo:hi]:
                        out.append(0.0 if mean is None else mean)
                        if x is not None:
                            mean = x if mean is None else mean * (1 - share) + x * share
                    state[name] = mean
                for name, (c, n) in lasts.items():
                    seen, out = state[name], made[name]
                    for x in held[c][lo:hi]:
                        out.append(sum(seen) / n if len(seen) == n else None)
                        if x is not None:
                            seen.append(x)
                            if len(seen) > n:
                                del seen[0]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(made[name], pa.float64()) for name in outputs)], [*b.schema.names, *outputs])

    given = df.withColumns({c: F.col(c).cast("double") for c in columns}) if any(df.schema[c].dataType != DoubleType() for c in columns) else df
    schema = StructType([*given.schema.fields, *(StructField(name, DoubleType()) for name in outputs)])
    return given.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def ewma_before(df: DataFrame, names: dict[str, str], alpha: float = 0.206) -> DataFrame:
    """``df`` with the weighted mean of each column's earlier values: {column: output}."""
    return folded(df, {out: c for c, out in names.items()}, {}, alpha)


def last_days(df: DataFrame, n: int, key: str = "fighter", day: str = "event_date") -> DataFrame:
    """The rows of each key's last ``n`` days that have any, with ``back``, the day's number from the end."""
    back = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc(day)))
    return df.withColumn("back", back).filter(F.col("back") <= n)


def with_streaks(sides: DataFrame) -> DataFrame:
    """``win_streak``: wins in a row just before each bout; anything but a win ends it."""
    run = F.sum(F.when(F.coalesce("won", F.lit(0)) == 1, 0).otherwise(1)).over(ordered("fighter"))
    islands = sides.withColumn("__run", run)
    length = F.sum(F.coalesce("won", F.lit(0))).over(ordered("fighter", "__run"))
    after = islands.withColumn("__after", length)
    return after.withColumn("win_streak", F.coalesce(F.lag("__after").over(ordered("fighter")), F.lit(0)).cast("long")).drop("__run", "__after")


def shrunk(successes: Column, trials: Column, prior: Column, k: float = 50) -> Column:
    return (successes + k * prior) / (trials + k)
