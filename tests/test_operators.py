"""Operators on literal rows: the edge cases that shape them, and brute-force versions in plain Python."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.functions import samples as fn
from wayline.operators import chunk, clean, denoise, metrics, sampling, select
from wayline.streaming import dicing

T0 = datetime.datetime(2024, 1, 1)


def trajectory(spark, lengths: dict[int, int], extra=()):
    rows = [(0, a, T0 + datetime.timedelta(seconds=i), a * 1000 + i, 0.1, 0.2, 0.1 + i * 1e-5, 0.2) for a, n in lengths.items() for i in range(n)]
    schema = "shard long, agent long, ts timestamp_ntz, event_id long, longitude double, latitude double, longitude_n double, latitude_n double"
    return spark.createDataFrame([*rows, *extra], schema)


def test_valid_fixes_reject_null_nan_and_infinity(spark):
    bad = [None, float("nan"), float("inf"), float("-inf")]
    rows = trajectory(spark, {1: 1}, [(0, 2, T0, i, *[x if c == i % 4 else 0.5 for c in range(4)]) for i, x in enumerate(bad)])
    assert [r.agent for r in clean.valid_fixes(rows).collect()] == [1]
    assert {r.agent: (r.n_before, r.n_valid, r.n_dropped) for r in clean.drop_accounting(rows).collect()} == {1: (1, 1, 0), 2: (4, 0, 4)}
    kept = clean.drop_nan(rows.where("agent = 2"), ("longitude", "latitude_n"))
    assert {r.event_id for r in kept.collect()} == {1, 2, 3}


@pytest.mark.parametrize("n,chunks", [(9, 0), (10, 0), (11, 1), (17, 1), (18, 2), (26, 3)])
def test_a_trajectory_needs_more_than_k_points(spark, n, chunks):
    sizes = spark.createDataFrame([(0, 1, n)], "shard long, agent long, n long")
    assert chunk.dice(sizes, 10, 2).count() == chunks


def test_resumed_dicing_equals_one_run(spark):
    whole = {(r.row_start, r.row_end) for r in chunk.dice(spark.createDataFrame([(0, 1, 50)], "shard long, agent long, n long"), 10, 3).collect()}
    first = chunk.dice(spark.createDataFrame([(0, 1, 25)], "shard long, agent long, n long"), 10, 3)
    state = chunk.end_rows(first)
    rest = chunk.dice(spark.createDataFrame([(0, 1, 50)], "shard long, agent long, n long"), 10, 3, state)
    assert {(r.row_start, r.row_end) for r in [*first.collect(), *rest.collect()]} == whole


def test_state_beyond_the_end_gives_nothing_and_absent_state_starts_at_zero(spark):
    sizes = spark.createDataFrame([(0, 1, 30), (0, 2, 30)], "shard long, agent long, n long")
    state = spark.createDataFrame([(0, 1, 99)], "shard long, agent long, end_row long")
    assert {r.agent for r in chunk.dice(sizes, 10, 2, state).collect()} == {2}


def test_chunk_points_equal_the_range_join(spark):
    placed = chunk.positions(trajectory(spark, {1: 37, 2: 10, 3: 11}))
    got = {(r.agent, r.i, r.j, r.p) for r in chunk.chunk_points(placed, 10, 3).collect()}
    want = {(a, i, p - i * 7, p) for a, n in {1: 37, 2: 10, 3: 11}.items() if n > 10 for i in range(9) if i * 7 + 10 <= n for p in range(i * 7, i * 7 + 10)}
    assert got == want


def test_head_of_the_first_chunk_repeats_row_zero(spark):
    rows = chunk.filled_heads(chunk.chunk_points(chunk.positions(trajectory(spark, {1: 30})), 10, 3), 3).collect()
    first = {r.j: r.longitude_n for r in rows if r.i == 0}
    assert first[0] == first[1] == first[2] != first[3]
    assert len({r.longitude_n for r in rows if r.i == 1}) == 10
    assert all(r.is_start == (r.j < 3) for r in rows)


@pytest.mark.parametrize("k,q1,q2,n", [(10, 2, 2, 35), (10, 2, 2, 32), (10, 2, 2, 3), (8, 0, 3, 20), (9, 3, 0, 1), (10, 2, 2, 8)])
def test_inference_chunks_follow_the_clamp_and_stitch_covers_once(spark, k, q1, q2, n):
    placed = chunk.positions(trajectory(spark, {1: n}))
    rows = chunk.inference_chunks(placed, k, q1, q2)
    s = k - q1 - q2
    m = 1 + math.ceil(max(0, n - (k - q1)) / s)
    assert sorted((r.i, r.j, r.p) for r in rows.collect()) == [(i, j, min(max(i * s - q1 + j, 0), n - 1)) for i in range(m) for j in range(k)]
    assert sorted(r.p for r in chunk.stitch(rows, k, q1, q2).collect()) == list(range(n))


def test_overlaps_without_room_are_refused(spark):
    with pytest.raises(ValueError):
        chunk.inference_chunks(chunk.positions(trajectory(spark, {1: 5})), 6, 3, 3)


def test_strided_chunks_lose_only_the_first_points(spark):
    rows = chunk.strided_chunks(chunk.positions(trajectory(spark, {1: 37})), 10, 3).collect()
    assert {r.p for r in rows} == set(range(3, 37))


def test_projection_and_back(spark):
    row = spark.range(1).select(F.lit(-118.2).alias("x"), F.lit(34.1).alias("y"), F.lit(-118.19).alias("x0"), F.lit(34.09).alias("y0"))
    e, n = geo.to_enu(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"))
    lon, lat = geo.to_geodetic(e, n, F.col("x0"), F.col("y0"))
    r = row.select(e.alias("e"), n.alias("n"), lon.alias("lon"), lat.alias("lat")).first()
    assert -930 < r.e < -915 and 1100 < r.n < 1115
    assert abs(r.lon + 118.2) < 1e-8 and abs(r.lat - 34.1) < 1e-8


def test_fence_interpolates_and_has_defaults(spark):
    values = [1.0, 2.0, 4.0, 8.0, float("nan"), None]
    r = metrics.fence(spark.createDataFrame([(v,) for v in values], "err double"), "err").first()
    q1, q3 = np.percentile([1, 2, 4, 8], [25, 75])
    assert (r.q1, r.q3, r.delta) == (q1, q3, q3 + 1.5 * (q3 - q1))
    empty = metrics.fence(spark.createDataFrame([], "err double"), "err").first()
    assert (empty.delta, empty.q1, empty.q3, empty.iqr) == (1, 0, 1, 1)


def test_two_medians_of_an_even_set(spark):
    rows = spark.createDataFrame([(0, float(x)) for x in (1, 2, 3, 4)], "g int, err double")
    assert metrics.set_statistics(rows, ["g"]).first()["median"] == 2.5
    assert metrics.set_statistics(rows, ["g"], lower_median=True).first()["median"] == 2.0


def test_overlap_regions_grow_at_the_worse_end(spark):
    err = [9.0, *[1] * 8, 9, *[1] * 9, 8]
    groups = spark.createDataFrame([("m", i, float(e)) for i, e in enumerate(err)], "model string, grp int, err double")
    run = metrics.overlap_runs(groups, ["model"]).first()
    assert (run.q1, run.q2) == (1, 1)
    grown = metrics.detect_overlaps(groups, ["model"]).first()
    assert not any(x > 2 for x in err[grown.q1 : len(err) - grown.q2])


def test_both_huber_forms(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (3.0, 1.0)], "err double, w double")
    scaled = metrics.masked_huber(rows, 2.0, F.col("w")).first()
    assert scaled.loss == (0 + 2 * (3 - 1)) / 2
    weighted = metrics.weighted_huber(rows, 2.0, F.col("w")).first()
    assert abs(weighted.loss - 4) < 1e-6 and weighted.mean_error == 2


def test_position_weight_shape(spark):
    w = [r[0] for r in spark.range(32).select(fn.position_weight(F.col("id"), 32)).collect()]
    assert w[0] == 0 and w[7] == 1 and w[8:24] == [1.0] * 16 and w[24] == 1 and abs(w[31] - 0.8) < 1e-12


def test_step_of_names(spark):
    rows = spark.createDataFrame([("ckpt_e1_s42.safetensors",), ("none",), (None,)], "n string")
    assert [r[0] for r in rows.select(fn.step_of(F.col("n"))).collect()] == [42, -1, -1]


def test_small_and_big_sets_are_disjoint_and_short_sets_fail(spark):
    rows = spark.createDataFrame([(0, i, str(i % 7)) for i in range(40)], "p int, k int, fp string")
    small = sampling.small_set(rows, "p", "fp", ["p", "k"], 4)
    big = sampling.big_set(rows, small, "p", "fp", ["p", "k"], 10)
    assert [r.k for r in small.collect()] == [0, 1, 2, 3] and [r.k for r in big.collect()] == [4, 5, 6]
    with pytest.raises(ValueError):
        sampling.require(big, 10)


def test_first_distinct_samples_are_exact_and_read_no_further_than_they_must(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = [(p, k, f"f{rng.randrange(200)}") for p in range(20) for k in range(30)]
    path = str(tmp_path / "packs")
    spark.createDataFrame(rows, "pack int, k int, fp string").repartition("pack").write.partitionBy("pack").parquet(path)
    packs = spark.read.parquet(path)

    def plain(n, gone=frozenset()):
        out, seen, last = [], set(gone), -1
        for p, k, f in sorted(rows):
            if f not in seen and len(out) < n:
                seen.add(f)
                out.append((p, k, f))
                last = p
        return out, last

    for n in (1, 25, 31, 120, 150, 500):
        want, last = plain(n)
        found, read = sampling.first_distinct(packs, "pack", "fp", ["pack", "k"], n)
        assert sorted((r.pack, r.k, r.fp) for r in found.collect()) == want
        assert len(read) <= (20 if len(want) < n else 2 * last + 2)
    small, _ = sampling.first_distinct(packs, "pack", "fp", ["pack", "k"], 30)
    gone = {r.fp for r in small.collect()}
    found, read = sampling.first_distinct(packs, "pack", "fp", ["pack", "k"], 40, small)
    assert sorted((r.pack, r.k, r.fp) for r in found.collect()) == plain(40, gone)[0] and len(read) < 20
    assert sampling.first_distinct(packs.where("false"), "pack", "fp", ["pack", "k"], 5)[0].count() == 0


def test_only_the_shards_that_are_needed_are_opened(spark, tmp_path):
    path = str(tmp_path / "packs")
    for p in range(6):
        spark.createDataFrame([(k, f"{p}/{k}") for k in range(5)], "k int, fp string").coalesce(1).write.parquet(f"{path}/pack={p}")
    for p in (4, 5):  # files that cannot be read: opening one would fail
        for f in (tmp_path / "packs" / f"pack={p}").glob("part-*"):
            f.write_bytes(b"broken")
    packs = spark.read.schema("k int, fp string, pack int").parquet(path)
    found, read = sampling.first_distinct(packs, "pack", "fp", ["pack", "k"], 12)
    assert [(r.pack, r.k) for r in found.orderBy("pack", "k").collect()] == [(p, k) for p in range(3) for k in range(5)][:12] and read == [0, 1, 2]


def test_composed_schedule_equals_the_loop(spark):
    import random

    rng = random.Random(8)
    rows, want = [], {}
    for m in ("a", "b", "c"):
        delta = 38.13
        for step in sorted(rng.sample(range(20_000), 400)):
            err = rng.choice([None, float("nan"), rng.uniform(0, 400)])
            rows.append((m, step, err))
            if err is not None and err == err:
                a = 0.02 if step < 5000 else 0.005
                delta = min(80.0, max(20.0, (1 - a) * delta + a * max(err, 15.0)))
        want[m] = delta
    rows.append(("none", 1, None))
    want["none"] = 38.13
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "model string, step long, acc_mean double")
    for width in (3, 50, 1000, 10**6):
        got = {r.model: r.delta for r in select.delta_schedule(log, width=width).collect()}
        assert got.keys() == want.keys() and all(abs(got[m] - want[m]) < 1e-9 for m in want)


def test_velocity_fit_minimises_the_fixed_delta_loss(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    v = x @ np.array([[1.5, -0.5], [0.25, 2.0]]) + [3.0, -1.0] + rng.normal(scale=0.05, size=(400, 2))
    v[:40] += 50  # outliers
    w = rng.uniform(0.5, 1, 400)
    rows = spark.createDataFrame([(float(a), float(b), float(c), float(d), float(u)) for (a, b), (c, d), u in zip(x, v, w, strict=True)] + [(None, 1.0, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 1.0, 1.0), (1.0, 1.0, 9e9, 1.0, 0.0)], "a double, b double, ve double, vn double, u double")
    fit = denoise.fit_velocity(rows, ["a", "b"], 0.5, F.col("u"), 30).orderBy("axis").collect()
    beta = np.array([[r.intercept, *r.coefficients] for r in fit]).T
    assert np.allclose(beta, [[3, -1], [1.5, -0.5], [0.25, 2]], atol=0.05)

    def loss(b):
        e = w * np.sqrt(((v - np.c_[np.ones(400), x] @ b) ** 2).sum(axis=1))
        return np.where(e <= 0.5, 0.5 * e * e, 0.5 * (e - 0.25)).mean()

    assert abs(fit[0].loss - loss(beta)) < 1e-6
    assert all(loss(beta) <= loss(beta + d) + 1e-9 for d in rng.normal(scale=1e-3, size=(50, 3, 2)))
    none = denoise.fit_velocity(rows.where("false"), ["a"], 1.0).first()
    assert (none.intercept, none.coefficients, none.loss) == (0.0, [0.0], None)


def test_split_by_share_skips_no_shard(spark):
    shards = sampling.ranked_shards(spark.range(11).select(F.col("id").alias("shard")))
    split = {r.shard: r.split for r in sampling.split_by_share(shards).collect()}
    assert [split[i] for i in range(11)] == ["train"] * 8 + ["val"] * 2 + ["test"]


def test_keep_sets_and_orders(spark):
    log = spark.createDataFrame([("m", f"c{i}", i, float(i % 5), float(i % 3), 0.0) for i in range(20)], "model string, ckpt_name string, step long, acc_mean double, acc_median double, acc_std double")
    assert select.best_by_audit(log).first().step == 0
    assert select.best_by_training(log).first().step == 15
    stay, go = select.trim(log, select.keep_set(log))
    assert stay.count() + go.count() == 20 and {r.step for r in stay.collect()} >= set(range(13, 20))


def breadth_first(x, k, q1, q2, a, m):
    """One point at a time, with the chunks built from growing lists."""
    s = k - q1 - q2
    for _ in range(m):
        out, previous, used = [], None, 0
        while previous is None or used < len(x):
            if previous is None:
                chunk, used = [x[0]] * q1 + x[: k - q1], min(len(x), k - q1)
            else:
                chunk, used = previous[-(q1 + q2) :] + x[used : used + s], min(len(x), used + s)
            real = len(chunk)
            chunk = chunk + [x[-1]] * (k - real)
            o = chunk[0]
            previous = [tuple(c - a * (c - c0) / m for c, c0 in zip(pt, o, strict=True)) for pt in chunk]
            out += previous[q1 : k - q2 if used < len(x) else real]
        x = out
    return x


def test_breadth_first_equals_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    for n, k, q1, q2 in ((23, 8, 2, 2), (32, 10, 2, 2), (1, 8, 2, 2), (30, 8, 0, 3), (30, 9, 3, 0)):
        x = rng.normal(size=(n, 2))
        rows = spark.createDataFrame([(0, 1, i, float(a), float(b)) for i, (a, b) in enumerate(x)], "shard long, agent long, p long, e double, n double")
        got = denoise.denoise_breadth_first(rows, ["shard", "agent"], k, q1, q2, denoise.linear_predictor(0.3), 0.25).orderBy("p").toPandas()
        assert np.allclose(got[["e", "n"]].to_numpy(), breadth_first([tuple(p) for p in x.tolist()], k, q1, q2, 0.3, 4)), (n, k, q1, q2)


def test_breadth_first_blocks_equal_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    long = {agent: rng.normal(size=(n, 2)) for agent, n in enumerate((1, 5, 6, 7, 12, 13, 40, 57))}
    rows = spark.createDataFrame([(0, agent, i, float(a), float(b)) for agent, x in long.items() for i, (a, b) in enumerate(x)], "shard long, agent long, p long, e double, n double")
    for k, q1, q2, block in ((8, 2, 2, 1), (8, 2, 2, 2), (8, 2, 2, 5), (8, 0, 3, 2), (9, 3, 0, 3), (8, 1, 5, 2), (9, 2, 5, 4)):
        got = denoise.denoise_breadth_first(rows, ["shard", "agent"], k, q1, q2, denoise.linear_predictor(0.3), 0.25, block).orderBy("agent", "p").toPandas()
        for agent, x in long.items():
            own = got[got["agent"] == agent]
            assert own["p"].tolist() == list(range(len(x)))
            assert np.allclose(own[["e", "n"]].to_numpy(), breadth_first([tuple(p) for p in x.tolist()], k, q1, q2, 0.3, 4)), (agent, k, q1, q2, block)
    assert denoise.denoise_breadth_first(rows.where("false"), ["shard", "agent"], 8, 2, 2, denoise.linear_predictor(0.3), 0.25).count() == 0


def test_statistics_of_null_keys_and_unordered_values(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, None), (2, float("nan")), (2, 1.0)], "k long, v double")
    found = {r["k"]: (r["count"], r["med_err"]) for r in metrics.summary(rows, "v", ["k"]).collect()}
    assert found[None] == (2, 2.0) and found[1] == (0, None) and found[2][0] == 2 and np.isnan(found[2][1])


def test_three_coordinates_come_back_from_a_thousand_kilometres(spark):
    rows = [(lon0 + d, lat0 + f, h, lon0, lat0, h0) for lon0, lat0 in ((0.0, 0.0), (-118.2, 34.0), (179.9, -60.0), (10.0, 89.0)) for d, f, h, h0 in ((0.0, 0.0, 0.0, 0.0), (8.9, 0.3, 8848.0, 12.5), (0.01, -8.9, -400.0, 46.0), (-3.0, -7.0, 46.0, 0.0))]
    got = spark.createDataFrame(rows, "lon double, lat double, h double, lon0 double, lat0 double, h0 double")
    e, n, u = geo.to_local(*[F.col(c) for c in ("lon", "lat", "h", "lon0", "lat0", "h0")])
    got = got.withColumns({"e": e, "n": n, "u": u})
    lon, lat, h = geo.from_local(*[F.col(c) for c in ("e", "n", "u", "lon0", "lat0", "h0")])
    got = got.select("*", lon.alias("lon_b"), lat.alias("lat_b"), h.alias("h_b"), F.hypot("e", "n").alias("far")).collect()
    assert max(r.far for r in got) > 900_000
    for r in got:
        turn = (r.lon_b - r.lon + 180) % 360 - 180
        assert abs(turn) * 111_320 * np.cos(np.radians(r.lat)) < 1e-6 and abs(r.lat_b - r.lat) * 111_320 < 1e-6 and abs(r.h_b - r.h) < 1e-6, r


def test_shuffled_places_are_a_permutation(spark):
    sizes = [1, 2, 3, 5, 64, 1000, 4999, 5000]
    rows = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "n long, i long")
    got = rows.select("n", "i", *[fn.shuffled_place(F.col("i"), F.col("n"), F.lit(k)).alias(f"at{k}") for k in (0, 1)]).toPandas()
    for n, own in got.groupby("n"):
        for k in (0, 1):
            assert sorted(own[f"at{k}"]) == list(range(n))
        if n >= 1000:
            assert (own["at0"] == own["i"]).sum() < 10 and (own["at0"] == own["at1"]).sum() < 10
            assert abs(np.corrcoef(own["i"], own["at0"])[0, 1]) < 0.1


def test_chunk_denoising_equals_the_closed_form(spark):
    rows = spark.createDataFrame([(c, j, float(c + j), float(-j)) for c in range(5) for j in range(8)], "c long, j long, e double, n double")
    got = denoise.denoise_chunks(rows, ["c"], 8, denoise.linear_predictor(0.1), 0.2).orderBy("c", "j").toPandas()
    f = (1 - 0.2 * 0.1) ** 5
    assert np.allclose(got["e"], [f * (c + j) for c in range(5) for j in range(8)]) and np.allclose(got["n"], [-f * j for c in range(5) for j in range(8)])


def test_streamed_chunks_equal_batch_chunks(spark):
    rows = [(i, T0 + datetime.timedelta(seconds=i), i % 5, "view", 1.0, "{}") for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    got = {tuple(r) for r in dicing.emitted(spark, dicing.run_once(spark, events, 10, 2, parts=3)[0]).collect()}
    from wayline.sources.trajectories import points_from_events

    sizes = chunk.lengths(chunk.positions(clean.valid_fixes(points_from_events(events))))
    assert got == {tuple(r) for r in chunk.dice(sizes, 10, 2).selectExpr("shard", "agent", "row_start div 8", "row_start", "row_end").collect()}


def test_empty_input(spark):
    none = trajectory(spark, {})
    placed = chunk.positions(clean.valid_fixes(none))
    assert chunk.dice(chunk.lengths(placed), 10, 2).count() == 0
    assert chunk.inference_chunks(placed, 10, 2, 2).count() == 0


@pytest.mark.parametrize("lower", [False, True])
def test_quantiles_are_exact_where_only_an_interval_is_ranked(spark, lower):
    rng = np.random.default_rng(5)
    values = {"a": np.round(rng.normal(size=4000), 2), "b": rng.exponential(size=2500), "c": np.full(1500, 3.0), "d": np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)], "k string, v double")
    found = {r.k: r.x for r in metrics.quantiles(rows, {"x": F.col("v")}, ["k"], (0.25, 0.5, 0.75), lower, accuracy=100).collect()}
    method = "inverted_cdf" if lower else "linear"
    assert set(found) == set(values)
    for k, v in values.items():
        assert np.allclose(found[k], np.quantile(v, [0.25, 0.5, 0.75], method=method), rtol=0, atol=1e-12), k
    none = metrics.summary(rows.where("k = 'e'"), "v").first()
    assert none["count"] == 0 and none["med_err"] is None
    assert metrics.fence(rows.where("false"), "v").first().asDict() == {"delta": 1.0, "q1": 0.0, "q3": 1.0, "iqr": 1.0}


def test_places_are_counted_over_ranges(spark):
    rows = spark.range(1000).selectExpr("id % 3 as k", "(id * 7919) % 1009 as v").repartition(7)
    found = sampling.numbered(rows, ["k"], [F.col("v")], "at").collect()
    for k in range(3):
        own = sorted((r.v, r["at"]) for r in found if r.k == k)
        assert [at for _, at in own] == list(range(len(own)))


def test_users_with_bad_points_are_dropped_and_short_sets_fail(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(0, 1, 1.0, 1.0, 1.0, 1.0), (0, 1, 1.0, 1.0, nan, 1.0), (0, 2, 1.0, 1.0, 1.0, 1.0), (1, 1, 1.0, 1.0, 1.0, None)], "shard long, agent long, longitude double, latitude double, longitude_n double, latitude_n double")
    left = clean.drop_bad_users(rows)
    assert [(r.shard, r.agent) for r in left.collect()] == [(0, 2)] and clean.require_finite(left).count() == 1
    with pytest.raises(ValueError, match="longitude_n"):
        clean.require_finite(rows)
    with pytest.raises(ValueError):
        sampling.require(left, 2)


def test_a_predictor_is_loaded_once_for_a_name():
    loads = []
    predictor = denoise.LoadOnce("counted", lambda: loads.append(1) or (lambda x, t: x + t))
    assert predictor(1, 2) == 3 and predictor(2, 2) == 4 and loads == [1]
