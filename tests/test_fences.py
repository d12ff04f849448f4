"""Fences from sketches of shards: exact on few values, within the bound on many, and no old shard is opened again."""

from __future__ import annotations

import pathlib
import random

from pyspark.sql import functions as F

from wayline.operators import fences
from wayline.sources import trajectories as src


def add(spark, path, shards):
    rows = [(s, v) for s, values in shards.items() for v in values]
    spark.createDataFrame(rows, "shard string, err double").repartition("shard").write.mode("append").partitionBy("shard").parquet(path)


def test_odd_values_and_missing_shards(spark):
    samples, path = src.scratch(spark, "t"), src.scratch(spark, "t")
    assert fences.append_sketches(spark, samples, path, F.col("err")) == 0
    none = {"delta": 1.0, "q1": 0.0, "q3": 1.0, "iqr": 1.0, "n": 0, "low": None, "high": None}
    assert fences.sketched_fence(spark, path).first().asDict() == none
    add(spark, samples, {"b c": [None, float("nan"), float("inf")], "7": [None]})
    assert fences.append_sketches(spark, samples, path, F.col("err")) == 2
    assert fences.sketched_fence(spark, path).first().asDict() == none
    add(spark, samples, {None: [5.0] * 40, "1": [1.0, float("-inf"), 9.0], "2": [5.0]})
    assert fences.append_sketches(spark, samples, path, F.col("err")) == 3
    found = fences.sketched_fence(spark, path).first()
    assert (found.n, found.low, found.high, found.q1, found.q3, found.delta) == (43, 1.0, 9.0, 5.0, 5.0, 5.0)


def test_new_shards_read_no_old_one_and_ranks_hold(spark):
    rng = random.Random(3)
    samples, path = src.scratch(spark, "t"), src.scratch(spark, "t")
    values = {str(s): [round(rng.lognormvariate(0, 2), 3) for _ in range(6000)] for s in range(12)}
    add(spark, samples, {s: values[s] for s in list(values)[:8]})
    assert fences.append_sketches(spark, samples, path, F.col("err")) == 8
    for file in pathlib.Path(samples).glob("shard=*/part-*"):  # an old shard that is opened now fails the run
        file.write_bytes(b"no parquet")
    for file in pathlib.Path(samples).glob("shard=*/.part-*.crc"):
        file.unlink()
    add(spark, samples, {s: values[s] for s in list(values)[8:]})
    assert fences.append_sketches(spark, samples, path, F.col("err")) == 4
    assert fences.append_sketches(spark, samples, path, F.col("err")) == 0
    found, all_ = fences.sketched_fence(spark, path).first(), [v for x in values.values() for v in x]
    assert found.n == len(all_) and (found.low, found.high) == (min(all_), max(all_))
    for q, p in ((found.q1, 0.25), (found.q3, 0.75)):
        assert sum(v < q for v in all_) / len(all_) - 2 * fences.RANK_ERROR <= p <= sum(v <= q for v in all_) / len(all_) + 2 * fences.RANK_ERROR
    assert list(pathlib.Path(path).glob("shard=*/part-*")).__len__() == 12
    assert max(f.stat().st_size for f in pathlib.Path(path).glob("shard=*/part-*")) < 200_000
