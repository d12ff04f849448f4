"""Ordering, dicing and packing of trajectories.

The unit is (shard, agent). Positions come from one window over it; everything else follows in closed form,
so that points meet their chunks by exploding a short sequence instead of a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.operators.clean import TRAJECTORY, epoch_seconds


def positions(points: DataFrame) -> DataFrame:
    """Points with ``p``, the 0-based place in the trajectory, and ``n``, its length; event_id breaks ties of time."""
    own = Window.partitionBy(*TRAJECTORY)
    return points.withColumn("p", F.row_number().over(own.orderBy("ts", "event_id")).cast("long") - 1).withColumn("n", F.count("*").over(own))


def lengths(placed: DataFrame) -> DataFrame:
    return placed.groupBy(*TRAJECTORY).agg(F.max("n").alias("n"))


def with_start(rows: DataFrame, state: DataFrame | None, q: int) -> DataFrame:
    """``start``: where dicing goes on. State (shard, agent, end_row) resumes at end_row + 1 - q, absent users at 0."""
    if state is None:
        return rows.withColumn("start", F.lit(0).cast("long"))
    resumed = state.select(*TRAJECTORY, (F.col("end_row") + 1 - q).alias("_at"))
    return rows.join(resumed, list(TRAJECTORY), "left").withColumn("start", F.greatest(F.lit(0), F.coalesce("_at", F.lit(0))).cast("long")).drop("_at")


def long_enough(n: Column, start: Column, k: int) -> Column:
    """A fresh trajectory needs more than ``k`` points, a resumed one a whole chunk."""
    return F.when(start == 0, n > k).otherwise(start + k <= n)


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """The larger end row per trajectory; trajectories on one side only are kept."""
    return old.unionByName(new).groupBy(*TRAJECTORY).agg(F.max("end_row").alias("end_row"))


def dice(sizes: DataFrame, k: int, q: int, state: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Chunks (shard, agent, chunk_id, row_start, row_end) of trajectories of length ``n``.

    chunk_id runs over the agents of a shard in order; ``cap`` keeps the first chunks of a shard.
    """
    s = k - q
    users = with_start(sizes, state, q).where(long_enough(F.col("n"), F.col("start"), k))
    users = users.withColumn("chunks", F.floor((F.col("n") - F.col("start") - k) / s) + 1)
    before = Window.partitionBy("shard").orderBy("agent").rowsBetween(Window.unboundedPreceding, -1)
    users = users.withColumn("offset", F.coalesce(F.sum("chunks").over(before), F.lit(0)))
    rows = users.select(*TRAJECTORY, "start", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("i"))
    row_start = F.col("start") + F.col("i") * s
    out = rows.select(*TRAJECTORY, (F.col("offset") + F.col("i")).alias("chunk_id"), row_start.alias("row_start"), (row_start + k - 1).alias("row_end"))
    return out if cap is None else out.where(F.col("chunk_id") < cap)


def end_rows(chunks: DataFrame) -> DataFrame:
    """New state: the last row of each trajectory that a chunk has reached."""
    return chunks.groupBy(*TRAJECTORY).agg(F.max("row_end").alias("end_row"))


def chunk_points(placed: DataFrame, k: int, q: int, state: DataFrame | None = None) -> DataFrame:
    """Points once per chunk that covers them: + i, the chunk's number in its trajectory, and j, the place in it."""
    s = k - q
    rows = with_start(placed, state, q).withColumn("at", F.col("p") - F.col("start"))
    rows = rows.where((F.col("at") >= 0) & long_enough(F.col("n"), F.col("start"), k))
    low = F.greatest(F.lit(0), F.ceil((F.col("at") - k + 1) / s))
    rows = rows.withColumn("i", F.explode(F.sequence(low, F.floor(F.col("at") / s))))
    return rows.where(F.col("i") * s + k <= F.col("n") - F.col("start")).withColumn("j", F.col("at") - F.col("i") * s)


def filled_heads(rows: DataFrame, q: int) -> DataFrame:
    """Chunk points with epoch seconds ``ts_s``; in a trajectory's first chunk the first ``q`` rows repeat row 0. + is_start."""
    own = Window.partitionBy(*TRAJECTORY, "i").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = (F.col("i") == 0) & (F.col("start") == 0) & (F.col("j") < q)
    out = rows.withColumn("ts_s", epoch_seconds(F.col("ts")))
    for c in ("longitude", "latitude", "longitude_n", "latitude_n", "ts_s"):
        out = out.withColumn(f"_{c}", F.when(head, F.first(c).over(own)).otherwise(F.col(c)))
    names = [f"_{c}" for c in ("longitude", "latitude", "longitude_n", "latitude_n", "ts_s")]
    return out.drop(*[c[1:] for c in names]).withColumnsRenamed({c: c[1:] for c in names}).withColumn("is_start", F.col("j") < q)


def pack(rows: DataFrame, k: int, fields: list[str]) -> DataFrame:
    """One row per chunk with its points as an ordered array; chunks that don't have exactly ``k`` points go."""
    packed = rows.groupBy(*TRAJECTORY, "i").agg(F.array_sort(F.collect_list(F.struct("j", *fields))).alias("points"))
    return packed.where(F.size("points") == k)


def inference_chunks(placed: DataFrame, k: int, q1: int, q2: int) -> DataFrame:
    """Overlapping chunks for inference: element j of chunk i is point clamp(i * s - q1 + j), every chunk has ``k`` rows.

    + chunk count ``m``. The head of the first chunk repeats the first point, the tail of the last the last one.
    """
    if k <= q1 + q2 or k - q1 - q2 < q1:
        raise ValueError("overlaps leave no room for new points")
    s = k - q1 - q2
    m = 1 + F.ceil(F.greatest(F.lit(0), F.col("n") - (k - q1)) / s)
    own = placed.withColumn("m", m)
    # each point is the value of one or more (i, j); the ends are repeated by the clamp
    low = F.greatest(F.lit(0), F.ceil((F.col("p") + q1 - k + 1) / s))
    high = F.least(F.col("m") - 1, F.floor((F.col("p") + q1) / s))
    i = F.when(F.col("p") == 0, F.sequence(F.lit(0).cast("long"), high)).when(
        F.col("p") == F.col("n") - 1, F.sequence(low, F.col("m") - 1)
    ).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))
    rows = own.withColumn("i", F.explode(i))
    at = F.col("p") + q1 - F.col("i") * s
    first, last = F.col("p") == 0, F.col("p") == F.col("n") - 1
    low_j = F.when(first, 0).otherwise(at)
    high_j = F.when(last, k - 1).otherwise(at)
    rows = rows.withColumn("_low", F.greatest(F.lit(0), low_j)).withColumn("_high", F.least(F.lit(k - 1), high_j))
    return rows.where("_low <= _high").withColumn("j", F.explode(F.sequence(F.col("_low").cast("long"), F.col("_high").cast("long")))).drop("_low", "_high")


def stitch(rows: DataFrame, k: int, q1: int, q2: int) -> DataFrame:
    """The one copy of each point that is a chunk's own: new points of a chunk, and the last chunk's to its real end."""
    s = k - q1 - q2
    own = F.col("i") == F.least(F.floor(F.col("p") / s), F.col("m") - 1)
    return rows.where(own & (F.col("j") == F.col("p") + q1 - F.col("i") * s))


def strided_chunks(placed: DataFrame, k: int, q: int) -> DataFrame:
    """Chunks of stride k - q that drop their first ``q`` points: ceil(n / (k - q)) chunks, no padding."""
    s = k - q
    low = F.greatest(F.lit(0), F.ceil((F.col("p") - k + 1) / s))
    rows = placed.withColumn("i", F.explode(F.sequence(low, F.least(F.floor(F.col("p") / s), F.ceil(F.col("n") / s) - 1))))
    return rows.withColumn("j", F.col("p") - F.col("i") * s).where(F.col("j") >= q)
