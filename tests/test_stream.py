"""The stateful stream: start from batch state, restart, late points, timers and its state read back."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from wayline.operators import chunk, clean
from wayline.sources.trajectories import points_from_events, scratch
from wayline.streaming import dicing

T0 = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, spec):
    """(event_id, seconds, user) rows."""
    return spark.createDataFrame([(i, T0 + datetime.timedelta(seconds=s), u, "view", 1.0, "{}") for i, s, u in spec], EVENTS)


def arrive(frame, source):
    frame.coalesce(1).write.mode("append").parquet(source)


def stream(spark, source, initial=None, **options):
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    return dicing.dice_stream(clean.valid_fixes(points_from_events(rows)), 10, 2, initial=initial, **options)


def batch_chunks(frame):
    placed = chunk.positions(clean.valid_fixes(points_from_events(frame)))
    return sorted((r.shard, r.agent, r.row_start) for r in chunk.dice(chunk.lengths(placed), 10, 2).collect())


def chunks(spark, sink):
    return sorted((r.shard, r.agent, r.row_start) for r in dicing.emitted(spark, sink).collect())


def test_a_restarted_stream_goes_on_from_batch_state(spark):
    all_ = [(i, i, i % 3) for i in range(300) if i % 97 and i % 89]
    whole = events(spark, all_)
    placed = chunk.positions(clean.valid_fixes(points_from_events(whole)))
    first = chunk.dice(chunk.lengths(placed.where("p < 30 and agent <> 2").drop("n").withColumn("n", F.lit(30))), 10, 2)
    state = chunk.end_rows(first)
    taken = {(r.agent, r.end_row) for r in state.collect()}
    assert {a for a, _ in taken} == {0, 1}
    rest = placed.join(state, ["shard", "agent"], "left").where("end_row is null or p > end_row").select("event_id")
    later = whole.join(rest, "event_id", "left_semi")
    initial = dicing.initial_state(placed, state, 2)
    source, sink, checkpoint = (scratch(spark, x) for x in ("in", "out", "cp"))
    arrive(later.where("event_id < 150"), source)
    dicing.run_available(stream(spark, source, initial), sink, checkpoint)
    half = chunks(spark, sink)
    arrive(later.where("event_id >= 150 and event_id < 220"), source)
    arrive(later.where("event_id >= 220"), source)
    dicing.run_available(stream(spark, source, initial), sink, checkpoint)  # a new query from the old checkpoint
    own = chunks(spark, sink)
    assert set(half) < set(own) and len(own) == len(set(own))
    assert sorted(own + [(r.shard, r.agent, r.row_start) for r in first.collect()]) == batch_chunks(whole)
    held = {r.agent: (r.n, r.last_id, r.next_start) for r in dicing.held_state(spark, checkpoint).collect()}
    sizes = {r.agent: r.n for r in chunk.lengths(placed).collect()}
    assert {a: n for a, (n, _, _) in held.items()} == sizes
    assert all(start == max(s for _, b, s in own if b == a) + 8 for a, (_, _, start) in held.items())


def test_late_points_are_an_output_of_their_own(spark):
    source, sink, checkpoint = (scratch(spark, x) for x in ("in", "out", "cp"))
    arrive(events(spark, [(i, i, 1) for i in range(1, 31)]), source)
    arrive(events(spark, [(1000 + i, i, 1) for i in range(20, 41)] + [(5, 5, 1)]), source)  # ties of time go by id
    dropped = dicing.run_available(stream(spark, source), sink, checkpoint)
    late = {r.event_id for r in dicing.emitted(spark, sink, "late").collect()}
    assert late == {5, *range(1020, 1030)} and dropped == 0
    held = dicing.held_state(spark, checkpoint).first()
    assert held.n + len(late) == 52 and (held.last_id, held.n) == (1040, 41)
    assert [s for _, _, s in chunks(spark, sink)] == [0, 8, 16, 24]


def test_state_goes_after_rest_and_the_watermark_counts_what_it_cuts(spark):
    source, sink, checkpoint = (scratch(spark, x) for x in ("in", "out", "cp"))
    hour = 3600
    arrive(events(spark, [(i, i, 1) for i in range(1, 13)]), source)
    arrive(events(spark, [(100 + i, 50 * hour + i, 2) for i in range(1, 13)]), source)
    arrive(events(spark, [(200, 51 * hour, 2)]), source)
    arrive(events(spark, [(300, 20, 1), (301, 52 * hour, 2)]), source)  # two days behind the watermark
    dropped = dicing.run_available(stream(spark, source, lateness="1 hour", idle_ms=10 * hour * 1000), sink, checkpoint)
    assert dropped == 1 and dicing.emitted(spark, sink, "late").count() == 0
    assert {r.agent: r.n for r in dicing.held_state(spark, checkpoint).collect()} == {2: 14}


def test_an_empty_stream_gives_nothing(spark):
    sink, _ = dicing.run_once(spark, events(spark, []), 10, 2)
    assert dicing.emitted(spark, sink).count() == 0


def test_an_arrival_of_many_files_loses_no_point(spark, monkeypatch):
    day = 24 * 3600
    whole = events(spark, [(i, i % 100 * day // 4 + i // 100, i // 100) for i in range(2000)])
    arrivals = dicing.arrivals
    monkeypatch.setattr(dicing, "arrivals", lambda rows, parts: (part.repartition(4, "user_id") for part in arrivals(rows, parts)))
    sink, checkpoint = dicing.run_once(spark, whole, 10, 2)
    assert chunks(spark, sink) == batch_chunks(whole)
    assert dicing.emitted(spark, sink, "late").count() == 0
    assert sum(r.n for r in dicing.held_state(spark, checkpoint).collect()) == clean.valid_fixes(points_from_events(whole)).count()
