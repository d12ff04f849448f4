"""Incremental dicing: points arrive over time, every full chunk is emitted once.

The state of a trajectory is five numbers whatever its length: how many points it has had, the time and id of the last
one, where the next chunk starts, and its timer. A trajectory that is new to the stream begins from the state that batch
runs have left (``initial_state``), if there is one. An event-time timer lets the state go once the watermark has passed the
last point by ``idle``. A first chunk is emitted on its (K + 1)-th point, as a batch run wants more than K; later ones when
full. Points that are older than the last one taken go to an output of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayline.operators.clean import TRAJECTORY, valid_fixes
from wayline.sources.trajectories import points_from_events, scratch

#: How late points may come, and how long a trajectory may rest before its state goes.
LATENESS, IDLE_MS = "1 day", 365 * 24 * 3600 * 1000
#: Rows of kind ``chunk`` have row_start and row_end, those of kind ``late`` the point's event_id and its time in microseconds.
OUTPUT = "shard long, agent long, kind string, i long, row_start long, row_end long, event_id long, us long"
STATE = "n long, last_us long, last_id long, next_start long, timer_ms long"
INITIAL = "shard long, agent long, n long, last_us long, last_id long, next_start long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERS = ("i", "row_start", "row_end", "event_id", "us")


def _out(key: tuple[Any, ...], kind: str, **columns: np.ndarray) -> pd.DataFrame:
    n = len(next(iter(columns.values())))
    made = {"shard": np.full(n, key[0]), "agent": np.full(n, key[1]), "kind": np.full(n, kind, object)}
    return pd.DataFrame({**made, **{c: pd.array(columns[c] if c in columns else [None] * n, "Int64") for c in NUMBERS}})


class Dicer(StatefulProcessor):
    """Takes a trajectory's new points in order of time and emits the chunks they fill and the points that came late."""

    def __init__(self, k: int, q: int, idle_ms: int = IDLE_MS):
        self.k, self.q, self.idle_ms = k, q, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", STATE)

    def handleInitialState(self, key: tuple[Any, ...], initialState: pd.DataFrame, timerValues: Any) -> None:
        r = initialState.iloc[0]
        self._put(tuple(int(r[c]) for c in ("n", "last_us", "last_id", "next_start")), -1, timerValues)

    def _put(self, state: tuple[int, int, int, int], timer: int, times: Any) -> None:
        wanted = max(state[1] // 1000, times.getCurrentWatermarkInMs(), 0) + self.idle_ms
        if wanted != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        self.at.update((*state, wanted))

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        k, step = self.k, self.k - self.q
        n, last_us, last_id, start, timer = self.at.get() if self.at.exists() else (0, -1, -1, 0, -1)
        points = pd.concat(list(rows)).drop_duplicates(["us", "event_id"]).sort_values(["us", "event_id"])
        us, event = points["us"].to_numpy(np.int64), points["event_id"].to_numpy(np.int64)
        new = (us > last_us) | ((us == last_us) & (event > last_id))
        if new.any():
            n, last_us, last_id = n + int(new.sum()), int(us[new][-1]), int(event[new][-1])
        # the first chunk wants one point more than it holds; each later one starts k - q further on
        starts = np.arange(start, n - k + 1, step) if start or n > k else np.zeros(0, np.int64)
        self._put((n, last_us, last_id, start + len(starts) * step), timer, timerValues)
        if len(starts):
            yield _out(key, "chunk", i=starts // step, row_start=starts, row_end=starts + k - 1)
        if not new.all():
            yield _out(key, "late", event_id=event[~new], us=us[~new])

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.at.clear()
        yield _out(key, "chunk", i=np.zeros(0, np.int64))

    def close(self) -> None:
        pass


def initial_state(placed: DataFrame, state: DataFrame, q: int) -> DataFrame:
    """What the stream goes on from: batch ``state`` (shard, agent, end_row) with the point at its end row, from ``placed`` points."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    at = placed.join(state, list(TRAJECTORY)).where(F.col("p") == F.col("end_row"))
    return at.select(*TRAJECTORY, (F.col("end_row") + 1).alias("n"), us.alias("last_us"), F.col("event_id").alias("last_id"), (F.col("end_row") + 1 - q).alias("next_start"))


def dice_stream(points: DataFrame, k: int, q: int, lateness: str = LATENESS, idle_ms: int = IDLE_MS, initial: DataFrame | None = None) -> DataFrame:
    """OUTPUT rows of a stream of points (shard, agent, ts, event_id, ...): its chunks, numbered ``i`` within a trajectory, and the
    points that came late. A point that repeats one of its batch counts once; points beyond the watermark never get here
    and are counted by the query's progress. ``initial`` is an ``initial_state``; it is read once, with the first batch."""
    rows = points.select("shard", "agent", "event_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", lateness)
    rows = rows.withColumn("us", F.unix_micros("at"))
    return rows.groupBy("shard", "agent").transformWithStateInPandas(
        Dicer(k, q, idle_ms), T.StructType.fromDDL(OUTPUT), "Append", "EventTime", None if initial is None else initial.groupBy("shard", "agent"),
    )


def run_available(rows: DataFrame, sink: str, checkpoint: str) -> int:
    """Runs a ``dice_stream`` over what there is and appends to ``sink``; returns how many points the watermark has cut off.

    A batch writes a folder of its own number, once: after a restart from ``checkpoint`` an unfinished batch replaces its folder.
    """
    spark = rows.sparkSession
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def emitted(spark: SparkSession, sink: str, kind: str = "chunk") -> DataFrame:
    """The rows of a kind that ``run_available`` has written."""
    rows = spark.read.schema(OUTPUT).parquet(sink).where(F.col("kind") == kind)
    return rows.select("shard", "agent", "i", "row_start", "row_end") if kind == "chunk" else rows.select("shard", "agent", "event_id", "us")


def held_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(shard, agent, n, last_us, last_id, next_start): the stream's state as of its last batch, from the state store's own files."""
    rows = spark.read.format("statestore").option("stateVarName", "at").load(checkpoint)
    return rows.select("key.shard", "key.agent", "value.n", "value.last_us", "value.last_id", "value.next_start")


def arrivals(events: DataFrame, parts: int) -> Iterator[DataFrame]:
    """Events as ``parts`` arrivals by time, one after the other; none if there are no events. Within one a user's events share a file."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(us), F.max(us)).first()
    if low is None:
        return
    for part in range(parts):
        a, b = low + (high + 1 - low) * part // parts, low + (high + 1 - low) * (part + 1) // parts
        yield events.where((us >= a) & (us < b)).repartition("user_id")


def run_once(spark: SparkSession, events: DataFrame, k: int, q: int, parts: int = 4, initial: DataFrame | None = None) -> tuple[str, str]:
    """Streams ``events``, written as arrivals; returns the folders of the sink and of the checkpoint.

    An arrival is one batch, of however many files: the watermark moves on behind it and cuts none of its points off.
    """
    source, sink, checkpoint = (scratch(spark, f"stream-{x}") for x in ("in", "out", "state"))
    came = False
    for arrival in arrivals(events, parts):
        arrival.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        cut_off = run_available(dice_stream(valid_fixes(points_from_events(stream)), k, q, initial=initial), sink, checkpoint)
        if cut_off:
            raise RuntimeError(f"the watermark has cut off {cut_off} points of arrivals in order of time")
        came = True
    if not came:
        spark.createDataFrame([], OUTPUT).write.parquet(f"{sink}/batch=0")
    return sink, checkpoint
