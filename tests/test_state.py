"""Versioned resume state: what a reader sees of whole, broken and concurrent commits."""

from __future__ import annotations

import pytest

from wayline.operators import chunk
from wayline.sources import trajectories as src
from wayline.sources import versions


def sizes(spark, lengths):
    return spark.createDataFrame([(a % 3, a, n) for a, n in lengths.items()], "shard long, agent long, n long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_resumed_runs_equal_one_run(spark):
    root, seen = src.scratch(spark, "t"), []
    for step in (10, 11, 25, 25, 37, 60):
        seen.append(versions.resume(spark, root, sizes(spark, {1: step, 2: step // 2, 3: 12, 4: 2 * step}), 10, 3))
    whole = chunk.dice(sizes(spark, {1: 60, 2: 30, 3: 12, 4: 120}), 10, 3).select("shard", "agent", "row_start", "row_end")
    assert rows(versions.all_chunks(spark, root).drop("version")) == rows(whole)
    assert rows(versions.snapshot(spark, root)) == rows(chunk.end_rows(whole).select("shard", "agent", "end_row"))
    assert seen[3] == seen[2] < seen[4] < seen[5]  # nothing new, no version


def test_a_run_that_dies_before_its_manifest_leaves_the_version_before_it(spark, monkeypatch):
    root = src.scratch(spark, "t")
    versions.resume(spark, root, sizes(spark, {1: 30}), 10, 2)
    before = rows(versions.snapshot(spark, root)), rows(versions.all_chunks(spark, root))
    with monkeypatch.context() as m:
        m.setattr(versions, "_create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            versions.resume(spark, root, sizes(spark, {1: 60}), 10, 2)
    assert (rows(versions.snapshot(spark, root)), rows(versions.all_chunks(spark, root))) == before
    assert versions.resume(spark, root, sizes(spark, {1: 60}), 10, 2) == 2
    whole = chunk.dice(sizes(spark, {1: 60}), 10, 2).select("shard", "agent", "row_start", "row_end")
    assert rows(versions.all_chunks(spark, root).drop("version")) == rows(whole)


def test_a_writer_that_comes_second_reads_again(spark, monkeypatch):
    root = src.scratch(spark, "t")
    versions.resume(spark, root, sizes(spark, {1: 30, 2: 30}), 10, 2)
    with pytest.raises(versions.VersionTaken):
        versions.commit(spark, root, spark.createDataFrame([(1, 1, 99)], versions.STATE), 0)
    real, once = versions.commit, []

    def late(spark_, root_, state, after, chunks=None):
        if not once:
            once.append(real(spark_, root_, spark.createDataFrame([(1, 1, 45)], versions.STATE), after))
        return real(spark_, root_, state, after, chunks)

    monkeypatch.setattr(versions, "commit", late)
    assert versions.resume(spark, root, sizes(spark, {1: 60, 2: 60}), 10, 2) == 3
    made = {(r.agent, r.row_start) for r in versions.all_chunks(spark, root).where("version = 3").collect()}
    assert min(s for a, s in made if a == 1) == 44 and min(s for a, s in made if a == 2) == 24  # both behind the state of their own


def test_one_datasets_record_is_replaced_and_old_versions_stay(spark, monkeypatch):
    monkeypatch.setattr(versions, "WHOLE_EVERY", 3)
    root, state = src.scratch(spark, "t"), lambda *r: spark.createDataFrame(list(r), versions.STATE)
    assert rows(versions.snapshot(spark, root)) == [] and versions.newest(spark, root) == 0
    want = {}
    for v, new in enumerate([[(0, 1, 5), (1, 2, 7)], [(1, 2, 6), (1, 3, 4)], [(0, 1, 9)], [(2, 9, 1)], [(1, 3, 8)]]):
        assert versions.commit(spark, root, state(*new), v) == v + 1
        for s, a, e in new:
            want[s, a] = max(e, want.get((s, a), 0))
        assert rows(versions.snapshot(spark, root)) == sorted((*k, e) for k, e in want.items())
    assert rows(versions.snapshot(spark, root, 2)) == [(0, 1, 5), (1, 2, 7), (1, 3, 4)]
    assert [r.base for r in versions.manifests(spark, root).orderBy("version").collect()] == [1, 1, 1, 4, 4]


def test_a_broken_file_beside_readable_ones_is_reported(spark):
    path = src.scratch(spark, "shards")
    points = spark.createDataFrame([(1, None, i, "x", 1.0, 1.0, 1.0, 1.0) for i in range(30)], src.POINTS)
    for _ in range(2):
        points.coalesce(1).write.mode("append").parquet(f"{path}/shard=1")
    spark.createDataFrame([("no",)], "value string").coalesce(1).write.mode("append").text(f"{path}/shard=1")
    assert [r.ds_name for r in src.unreadable_files(spark, path).collect()] == ["shard=1"]
    assert rows(src.shard_report(spark, path, 10, spark.createDataFrame([], "ds_name string"))) == [("shard=1", 60, 1, "damaged")]
