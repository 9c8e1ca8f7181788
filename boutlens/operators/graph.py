"""The graph of who beat whom: edges, components, rank, strength of schedule, as of a day."""

from __future__ import annotations

import datetime
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutlens.functions.odds import edge_weight

DAMPING, DECAY, TOLERANCE, ROUNDS = 0.85, 0.98, 1e-6, 100
#: folded edges that a task holds at a time: 28 bytes each
MOST_EDGES = 2_000_000
#: days that a task solves at once, and values that it holds of each kind for their nodes, at most
MOST_TOGETHER, CELLS = 64, 1 << 21
#: days that are broadcast: 4 bytes each
MOST_DAYS = 100_000
#: nodes that a task holds at most while it thins edges
MOST_NODES = 2_000_000
_EPOCH = datetime.date(1970, 1, 1)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="boutlens-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut through the session's checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` read back from columns written once beside the checkpoints: smaller than a checkpoint, but in no order."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def written(df: DataFrame, *by: str) -> str:
    """The folder that ``df`` was written to, as columns, beside the checkpoints, in folders ``by`` values; what was shuffled for it is deleted."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(folder) if by else df.write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return folder


def forest(edges: DataFrame) -> DataFrame:
    """(u, v): the undirected ``edges`` thinned in each partition to those that join two of its components."""

    def run(batches):
        above: dict = {}
        u, v = [], []
        for b in batches:
            pairs = b.filter(pc.and_(b.column(0).is_valid(), b.column(1).is_valid())).to_pydict()
            for x, y in zip(pairs["u"], pairs["v"]):
                own = x, y
                while (up := above.setdefault(x, x)) != x:
                    above[x] = x = above[up]
                while (up := above.setdefault(y, y)) != y:
                    above[y] = y = above[up]
                if x != y or own[0] == own[1]:
                    above[x] = y
                    u.append(own[0])
                    v.append(own[1])
            if len(above) > MOST_NODES:
                above = {}
            if len(u) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, b.schema.field(0).type), pa.array(v, b.schema.field(1).type)], ["u", "v"])
                u, v = [], []
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, b.schema.field(0).type), pa.array(v, b.schema.field(1).type)], ["u", "v"])

    two = edges.select("u", "v")
    return two.mapInArrow(run, two.schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected ``edges`` (u, v): the least node that can be reached.

    Labels spread to neighbours and jump to their label's label, so that rounds grow with the logarithm of the
    longest path. Nulls are ignored.
    """
    both = edges.filter("u is not null and v is not null").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        least = labels.join(near, "node").select("node", F.least("component", "c").alias("up"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("up"), F.col("component").alias("far"))
        new = checkpointed(least.join(jump, "up", "left").select("node", F.least("up", F.coalesce("far", "up")).alias("component"), "old"))
        labels = new.select("node", "component")
        if new.filter("component <> old").isEmpty():
            return labels


def edges(bouts: DataFrame, by_division: bool = False) -> DataFrame:
    """(src, dst, weight, earliest) from losers to winners; rematches add weight and keep the earliest day.

    With ``by_division`` every division is a graph of its own.
    """
    won = bouts.filter("winner is not null")
    loser = F.when(F.col("winner") == F.col("fighter_a"), F.col("fighter_b")).otherwise(F.col("fighter_a"))
    keys = [*([F.col("division")] if by_division else []), loser.alias("src"), F.col("winner").alias("dst")]
    return won.groupBy(*keys).agg(F.sum(edge_weight(F.col("method"))).alias("weight"), F.min("event_date").alias("earliest"))


def edges_asof(graph: DataFrame, days: DataFrame, decay: float | None = None) -> DataFrame:
    """(as_of, src, dst, weight): the edges known before each day; with ``decay`` their weight fades day by day."""
    asked = days.select("as_of").distinct()
    few = asked.limit(MOST_DAYS + 1).count() <= MOST_DAYS
    met = graph.join(F.broadcast(asked) if few else asked, F.col("earliest") < F.col("as_of"))
    weight = F.col("weight") * F.pow(F.lit(decay), F.datediff("as_of", "earliest")) if decay else F.col("weight")
    return met.select("as_of", "src", "dst", weight.alias("weight"))


def read_batches(folder: str, columns: list[str], rows: int = 1 << 20):
    """The rows that written() put into a folder, in record batches, file by file."""
    where, path = fs.FileSystem.from_uri(folder)
    for info in sorted(where.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
        if info.base_name.endswith(".parquet"):
            with where.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(rows, columns=columns, use_threads=False)


def _power_iterations(edges, first: np.ndarray, days: np.ndarray, alpha: float = DAMPING) -> tuple[np.ndarray, np.ndarray]:
    """Rank and mean rank of the nodes with an edge into each, (days, nodes); nodes that ``first`` a day doesn't know yet are null.

    ``edges()`` gives (src, dst, weight, day) in batches in the order of days, as often as it is called: a round reads all
    of them for all days that have not converged, and holds a few values for each day and node.
    """
    n = len(first)
    known = first[None, :] < days[:, None]
    sizes = known.sum(axis=1)
    active = np.flatnonzero(sizes)

    def sums(of, some):
        total = np.zeros((len(days), n))
        for src, dst, weight, day in edges():
            for j, k in zip(some, np.searchsorted(day, days[some])):
                if k:
                    at, value = of(j, src[:k], dst[:k], weight[:k])
                    total[j] += np.bincount(at, value, n)
        return total

    out = sums(lambda j, s, d, w: (s, w), active)
    x = np.where(known, 1 / np.maximum(sizes, 1)[:, None], 0.0)
    everyone = active
    for _ in range(ROUNDS):
        share = np.divide(x, out, out=np.zeros_like(x), where=out > 0)
        new = sums(lambda j, s, d, w: (d, w * share[j][s]), active)
        going = []
        for j in active:
            value = np.where(known[j], alpha * (new[j] + x[j][out[j] == 0].sum() / sizes[j]) + (1 - alpha) / sizes[j], 0.0)
            moved = np.abs(value - x[j]).sum()
            x[j] = value
            if moved >= sizes[j] * TOLERANCE:
                going.append(j)
        active = np.array(going, int)
        if not going:
            break
    into = sums(lambda j, s, d, w: (d, None), everyone)
    met = sums(lambda j, s, d, w: (d, x[j][s]), everyone)
    return np.where(known, x, np.nan), np.divide(met, into, out=np.full_like(x, np.nan), where=into > 0)


def pagerank_asof(graph: DataFrame, days: DataFrame, decay: float | None = None, most_edges: int = MOST_EDGES) -> DataFrame:
    """(as_of, node, rank, sos) of the graph before each day; if ``days`` has ``node``, of the nodes asked for on a day.

    Edges are numbered and written once. A task solves some days at once and streams the edges in each round, at most
    ``most_edges`` at a time: neither edges nor nodes are multiplied by days, but for the ranks that come out.
    """
    known = stored(graph.filter("src is not null and dst is not null").select("src", "dst", "weight", F.unix_date("earliest").alias("day")))
    people = written(known.select(F.explode(F.array("src", "dst")).alias("node"), "day").groupBy("node").agg(F.min("day").alias("day")))

    def nodes():
        held = [[x.to_numpy() for x in b.columns] for b in read_batches(people, ["node", "day"])]
        ids, first = (np.concatenate([np.empty(0, t), *(b[i] for b in held)]) for i, t in enumerate((np.int64, np.int32)))
        order = np.argsort(ids)
        return ids[order], first[order]

    def number(batches):
        ids, _ = nodes()
        for b in batches:
            at = [pa.array(np.searchsorted(ids, b.column(c).to_numpy())) for c in ("src", "dst")]
            yield pa.RecordBatch.from_arrays([*at, b.column("weight"), b.column("day")], ["src", "dst", "weight", "day"])

    n = known.sparkSession.read.parquet(people).count()
    lines = written(known.select("src", "dst", F.col("weight").cast("double").alias("weight"), "day").mapInArrow(number, "src long, dst long, weight double, day int").sortWithinPartitions("day"))
    together = max(1, min(MOST_TOGETHER, CELLS // max(n, 1)))
    some = "node" in days.columns
    asked = days.filter("as_of is not null").select(F.unix_date("as_of").alias("at"), *(["node"] if some else []))
    # days by decade, so that faded weights of one task don't vanish, and then by number: one row a day
    inside = F.row_number().over(Window.partitionBy(F.floor(F.col("at") / 3650)).orderBy("at")) - 1
    parts = stored(asked.select("at").distinct().withColumn("part", F.struct(F.floor(F.col("at") / 3650).alias("decade"), F.floor(inside / together).alias("n"))).select("at", (F.col("part.decade") * 100_000 + F.col("part.n")).alias("part")))
    count = max(1, parts.select("part").distinct().count())
    dealt = asked.join(F.broadcast(parts), "at").repartition(count, "part").sortWithinPartitions("part", "at")

    def solved(rows):
        at = np.concatenate([x.column("at").to_numpy() for x in rows])
        which, place = np.unique(at, return_inverse=True)
        ids, first = nodes()

        def edges():
            for b in read_batches(lines, ["src", "dst", "weight", "day"], max(1, most_edges)):
                src, dst, weight, day = (x.to_numpy() for x in b.columns)
                k = np.searchsorted(day, which[-1])
                if k:
                    faded = weight[:k] * (decay ** np.arange(which[-1] - day[0] + 1))[which[-1] - day[:k]] if decay else weight[:k]
                    yield src[:k], dst[:k], faded, day[:k]

        rank, sos = _power_iterations(edges, first, which)
        if some:
            node = np.concatenate([x.column("node").to_numpy(zero_copy_only=False) for x in rows])
            to = np.minimum(np.searchsorted(ids, node), max(len(ids) - 1, 0))
            keys = np.unique((place * len(ids) + to)[ids[to] == node]) if len(ids) else np.empty(0, int)
        for lo in range(0, len(keys) if some else rank.size, 1 << 16):
            j, i = np.divmod(keys[lo : lo + (1 << 16)] if some else np.arange(lo, min(lo + (1 << 16), rank.size)), max(len(ids), 1))
            here = ~np.isnan(rank[j, i])
            j, i = j[here], i[here]
            values = [pa.array(which[j].astype(np.int32)).cast(pa.date32()), pa.array(ids[i]), pa.array(rank[j, i]), pa.array(sos[j, i], from_pandas=True)]
            yield pa.RecordBatch.from_arrays(values, ["as_of", "node", "rank", "sos"])

    def run(batches):
        held, part = [], None
        for b in batches:
            parts = b.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo and parts[lo] != part:
                    if held:
                        yield from solved(held)
                    held, part = [], parts[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from solved(held)

    return dealt.mapInArrow(run, "as_of date, node long, rank double, sos double")


def network_features(rows: DataFrame, ranks: DataFrame, day: str = "event_date", node: str = "fighter") -> DataFrame:
    """``rows`` with rank, sos and in_graph_debut, 1 where the graph before the day doesn't know the node."""
    met = rows.join(ranks.withColumnsRenamed({"as_of": "__day", "node": "__node"}), (F.col(day) == F.col("__day")) & (F.col(node) == F.col("__node")), "left")
    return met.withColumn("in_graph_debut", F.col("rank").isNull().cast("double")).drop("__day", "__node")

