"""DuckDB twins of the registered queries, from shared common table expressions."""

from __future__ import annotations

from wayline.plans.settings import DELTA, FIT_DELTA, FIT_ROUNDS, K, MODELS, Q, Q1, Q2, SPLIT, DRAWS

S = K - Q
SI = K - Q1 - Q2
FOUR = ("longitude", "latitude", "longitude_n", "latitude_n")


def finite(*columns: str) -> str:
    return " and ".join(f"({c} is not null and isfinite({c}))" for c in columns)


def uniform(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::bigint / 4294967296.0::double)"


def ecef(lon: str, lat: str, h: str | float) -> tuple[str, str, str]:
    n = f"(6378137.0::double / sqrt(1 - E2() * sin(radians({lat})) * sin(radians({lat}))))".replace("E2()", "0.0066943799901413165::double")
    return (
        f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lon})))", f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lon})))",
        f"(({n} * (1 - 0.0066943799901413165::double) + {h}) * sin(radians({lat})))",
    )


def local(lon: str, lat: str, height: str | float, lon0: str, lat0: str) -> tuple[str, str, str]:
    x, y, z = (f"({a} - {b})" for a, b in zip(ecef(lon, lat, height), ecef(lon0, lat0, 0.0), strict=True))
    la, ph = f"radians({lon0})", f"radians({lat0})"
    return (
        f"(-sin({la}) * {x} + cos({la}) * {y})", f"(-sin({ph}) * cos({la}) * {x} - sin({ph}) * sin({la}) * {y} + cos({ph}) * {z})",
        f"(cos({ph}) * cos({la}) * {x} + cos({ph}) * sin({la}) * {y} + sin({ph}) * {z})",
    )


def enu(lon: str, lat: str, lon0: str, lat0: str) -> tuple[str, str]:
    return local(lon, lat, 46.0, lon0, lat0)[:2]


def geodetic(e: str, n: str, lon0: str, lat0: str) -> tuple[str, str]:
    la, ph = f"radians({lon0})", f"radians({lat0})"
    x0, y0, z0 = ecef(lon0, lat0, 0.0)
    x = f"({x0} - sin({la}) * {e} - sin({ph}) * cos({la}) * {n} + cos({ph}) * cos({la}) * 46.0)"
    y = f"({y0} + cos({la}) * {e} - sin({ph}) * sin({la}) * {n} + cos({ph}) * sin({la}) * 46.0)"
    z = f"({z0} + cos({ph}) * {n} + sin({ph}) * 46.0)"
    b = "6356752.314245179::double"
    p = f"sqrt({x} * {x} + {y} * {y})"
    th = f"atan2({z} * 6378137.0::double, {p} * {b})"
    lat = f"atan2({z} + 0.006739496742276434::double * {b} * power(sin({th}), 3), {p} - 0.0066943799901413165::double * 6378137.0::double * power(cos({th}), 3))"
    return f"degrees(atan2({y}, {x}))", f"degrees({lat})"


def huber(e: str, d: float) -> str:
    return f"(case when {e} <= {d} then 0.5 * {e} * {e} else {d} * ({e} - 0.5 * {d}) end)"


def weight(j: str, k: int) -> str:
    return f"(case when {j} < 8 then ({j} / 7.0::double) * ({j} / 7.0::double) when {j} >= {k - 8} then 1 - 0.2::double * ({j} - {k - 8}) / 7 else 1.0::double end)"


TRAJ = """traj as (select user_id as agent, ts, event_id, user_id % 32 as shard, event_type as modality,
  -118.25::double + ((event_id * 7919) % 10007) / 1000000.0::double as longitude,
  34.05::double + ((event_id * 6101) % 10009) / 1000000.0::double as latitude,
  case when event_id % 97 <> 0 then -118.25::double + ((event_id * 7919) % 10007) / 1000000.0::double + (((event_id * 31) % 201) - 100) / 1000000.0::double end as longitude_n,
  case when event_id % 89 = 0 then 'NaN'::double else 34.05::double + ((event_id * 6101) % 10009) / 1000000.0::double + (((event_id * 37) % 201) - 100) / 1000000.0::double end as latitude_n
  from events)"""
VALID = f"valid as (select * from traj where {finite(*FOUR)})"
PTS = "pts as (select *, row_number() over (partition by shard, agent order by ts, event_id) - 1 as p, count(*) over (partition by shard, agent) as n from valid)"
SIZES = "sizes as (select shard, agent, max(n) as n from pts group by all)"
CP = f"""cp as (select * exclude (i), i, p - i * {S} as j from (
  select *, unnest(range(greatest(0, cast(ceil((p - {K - 1}) / {S}) as bigint)), p // {S} + 1)) as i from pts where n > {K}) where i * {S} + {K} <= n)"""
FILLED = "filled as (select shard, agent, event_id, p, n, i, j, j < %d as is_start, " % Q + ", ".join(
    f"case when i = 0 and j < {Q} then first_value({c}) over w else {c} end as {c}" for c in FOUR
) + f", case when i = 0 and j < {Q} then first_value(epoch(date_trunc('second', ts))) over w else epoch(date_trunc('second', ts)) end as ts_s from cp window w as (partition by shard, agent, i order by j))"
_E1 = enu("longitude_n", "latitude_n", "lon_o", "lat_o")
_E0 = enu("longitude", "latitude", "lon_o", "lat_o")
ENU = f"""origin as (select *, first_value(longitude_n) over w as lon_o, first_value(latitude_n) over w as lat_o from filled window w as (partition by shard, agent, i order by j)),
enu as (select *, {_E1[0]} as e1, {_E1[1]} as n1, {_E0[0]} as e0, {_E0[1]} as n0 from origin),
eps as (select *, sqrt((e1 - e0) * (e1 - e0) + (n1 - n0) * (n1 - n0)) as err from enu)"""
LEVEL = uniform("shard || '/' || agent || '/' || i || '/' || s")
NOISY = f"""draws as (select *, unnest(range(0, {DRAWS})) as s from eps),
noisy as (select *, {LEVEL} as t, e1 - e0 as ve, n1 - n0 as vn, e0 + {LEVEL} * (e1 - e0) as ex, n0 + {LEVEL} * (n1 - n0) as nx from draws)"""
LOG = """ckpt_log as (select event_type as model, 'ckpt_e' || (event_id // 1000 + 1) || '_s' || event_id || '.safetensors' as ckpt_name,
  event_id // 1000 + 1 as epoch, event_id as step, value as avg_loss, value * 0.5::double as acc_mean,
  value * 0.4::double + event_id % 7 as acc_median, value * 0.1::double as acc_std, 0.0001::double as lr, 37.5::double as huber_loss_delta from events)"""
ERR = """err as (select cast(label % 5 as bigint) as model, vec_id % 7 as ckpt, vec_id as sample, j, abs(x::double) as err from (
  select label, vec_id, unnest(embedding) as x, unnest(range(0, len(embedding))) as j from embeddings))"""
SHARDS = "shards as (select distinct shard from traj), ranked as (select shard, row_number() over (order by shard) - 1 as rank, count(*) over () as n from shards)"
BASE = ", ".join((TRAJ, VALID, PTS, SIZES))
CHUNKS = f"""{BASE}, users as (select *, (n - {K}) // {S} + 1 as chunks from sizes where n > {K}),
offs as (select *, coalesce(sum(chunks) over (partition by shard order by agent rows between unbounded preceding and 1 preceding), 0) as off from users),
chunks as (select shard, agent, cast(off + i as bigint) as chunk_id, i * {S} as row_start, i * {S} + {K - 1} as row_end from (select *, unnest(range(0, chunks)) as i from offs))"""
POINTS = ", ".join((BASE, CP, FILLED, ENU))
STATE = f"state as (select shard, agent, (n // 3) + {Q} as end_row from sizes where agent % 3 = 0)"
INFER = f"""chunked as (select *, unnest(range(0, m)) as i from (select *, cast(1 + ceil(greatest(0, n - {K - Q1}) / {SI}) as bigint) as m from sizes)),
slots as (select *, unnest(range(0, {K})) as j from chunked),
infer as (select s.shard, s.agent, s.m, i, j, p.p, p.n, longitude_n, latitude_n from slots s join pts p on p.shard = s.shard and p.agent = s.agent and p.p = least(greatest(i * {SI} - {Q1} + j, 0), s.n - 1))"""


def _summary(v: str) -> str:
    return (
        f"round(sum({v}), 4) as total_err, round(avg({v}), 6) as avg_err, round(median({v}), 6) as med_err, round(stddev_pop({v}), 6) as std_err, count({v}) as count"
    )


_R = lambda c, d=2: f"round({c}, {d}) + 0.0 as {c}"
_UP = local("longitude_n", "latitude_n", "(event_id % 500)", "lon_o", "lat_o")
_BACK = geodetic("e1", "n1", "lon_o", "lat_o")
_SAMPLES = f"""samples as (select shard, agent, i, s, max(t) as t, bool_and({finite('ex', 'nx', 've', 'vn')}) as ok,
  string_agg(cast(event_id as varchar), ',' order by j) as key from noisy group by shard, agent, i, s)"""
_SET = """valid_s as (select shard as pack, shard, agent, i, s from samples where ok union all select shard + 1, shard, agent, i, s from samples where ok and (agent + i) % 5 = 0),
firsts as (select * from (select *, row_number() over (partition by shard, agent, i, s order by pack) as r from valid_s) where r = 1),
small as (select * from firsts order by pack, shard, agent, i, s limit 200)"""
_NOT_SMALL = "(shard, agent, i, s) not in (select (shard, agent, i, s) from small)"
_NAMED = "cast(pack as integer) as pack, shard, agent, i, s"


def _fit() -> str:
    """The rounds of the velocity fit, one after the other: sums, Cramer's rule for three unknowns."""
    parts = [f"""x as materialized (select 1.0::double as x0, ex / 1000 as x1, nx / 1000 as x2, ve, vn, {weight('j', K)} as w from noisy where shard < {SPLIT[0]} and {weight('j', K)} > 0
  and {finite('ex', 'nx', 've', 'vn')})"""]
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    a = [[f"s{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    for k in range(FIT_ROUNDS):
        before = f"b{k - 1}" if k else "(select " + ", ".join(f"0.0::double as {v}{i}" for v in ("ve", "vn") for i in range(3)) + ")"
        e = "w * sqrt(" + " + ".join(f"pow({v} - (b.{v}0 * x0 + b.{v}1 * x1 + b.{v}2 * x2), 2)" for v in ("ve", "vn")) + ")"
        u = "w * w" if not k else f"w * w * case when e <= {FIT_DELTA} then 1 else {FIT_DELTA} / e end"
        sums = ", ".join([f"sum({u} * x{i} * x{j}) as s{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum({u} * x{i} * {v}) as t{v}{i}" for v in ("ve", "vn") for i in range(3)])
        solved = ", ".join(
            f"{det([[f't{v}{r}' if c == i else a[r][c] for c in range(3)] for r in range(3)])} / {det(a)} as {v}{i}" for v in ("ve", "vn") for i in range(3)
        )
        parts.append(f"b{k} as materialized (select {solved}, loss from (select {sums}, avg({huber('e', FIT_DELTA)}) as loss from (select x.*, {e} as e from x, {before} b)))")
    return ", ".join(parts)


_BYTES = ", ".join(f"round(avg(err) filter (j // 8 = {g}), 6) as byte_{g}" for g in range(8))
_FENCE = "quantile_cont(err, 0.25) as q1, quantile_cont(err, 0.75) as q3"

SQL: dict[str, str] = {
    "a1_scan_shards": f"with {TRAJ} select 'shard=' || shard as ds_name, count(*) as n_rows, count(distinct agent) as n_agents from traj group by shard",
    "a2_unreadable_shards": f"""with {BASE}, {STATE} select 'shard=' || shard as ds_name, count(*) as n_rows, (shard = 5)::bigint as n_bad_files,
  case when shard = 5 then 'damaged' when shard in (select shard from sizes where n > {K}) or shard in (select shard from state) then 'ok' else 'no_chunks' end as status from traj group by shard
union all select 'shard=98', count(*), 0, 'no_chunks' from traj where event_id < 10 union all select 'shard=99', 0, 1, 'unreadable'""",
    "a3_head_extract": f"with {TRAJ} select event_id, agent, modality, longitude, latitude from traj order by event_id limit 1000",
    "a4_sample_sink": f"with {POINTS}, {NOISY} select case when shard < {SPLIT[0]} then 'train' when shard < {SPLIT[1]} then 'val' else 'test' end as split, shard, count(distinct (agent, i, s)) as n_rows from noisy group by all",
    "a5_read_state": f"with {CHUNKS} select 'shard_' || shard as ds_name, agent, max(row_end) as end_row from chunks group by all",
    "a6_write_state": f"with {CHUNKS} select 'shard_' || shard as ds_name, count(*) as n_agents, cast(sum(e) as bigint) as sum_end from (select shard, agent, max(row_end) as e from chunks group by all) group by all",
    "j1_stream_from_state": f"""with {CHUNKS} select c.shard, c.agent, row_start, row_end, case when n // 2 > {K} and row_end < n // 2 then 1 else 2 end as part
  from chunks c join sizes z on c.shard = z.shard and c.agent = z.agent""",
    "i9_velocity_fit": f"with {POINTS}, {NOISY}, {_fit()} " + " union all ".join(
        f"select '{v}' as axis, round({v}0, 4) + 0.0 as intercept, round({v}1, 4) + 0.0 as ke, round({v}2, 4) + 0.0 as kn, round(loss, 4) + 0.0 as loss from b{FIT_ROUNDS - 1}" for v in ("ve", "vn")),
    "a6_resumed_runs": f"""with {CHUNKS} select c.shard, c.agent, row_start, row_end, case when n // 2 > {K} and row_end < n // 2 then 1 else 2 end::bigint as version
  from chunks c join sizes z on c.shard = z.shard and c.agent = z.agent""",
    "a6_state_versions": f"""with {CHUNKS}, run as (select c.shard, c.agent, row_end, case when n // 2 > {K} and row_end < n // 2 then 1 else 2 end as v from chunks c join sizes z on c.shard = z.shard and c.agent = z.agent),
s as (select 1::bigint as version, shard, agent, max(row_end) as end_row from run where v = 1 group by all union all select 2, shard, agent, max(row_end) from run group by all)
select * from s union all select 3, shard, agent, case when shard = 3 then end_row + 1000 else end_row end from s where version = 2""",
    "a7_metric_log": f"with {LOG} select model, count(*) as n_rows, max(step) as last_step, round(avg(avg_loss), 6) as avg_loss from ckpt_log group by model",
    "a7_audit_log": f"""with {ERR}, s as (select model, ckpt, sample, avg(err) as err from err group by all),
m as (select model, ckpt, round(avg(err), 6) as mean, round(median(err), 6) as median, round(stddev_pop(err), 6) as std from s group by all),
b as (select model, ckpt, {_BYTES} from err group by all) select * from m join b using (model, ckpt)""",
    "a7_benchmark_log": f"with {ERR} select model, 8::bigint as q1, 8::bigint as q2, round(avg(err), 6) as mean_full, round(median(err), 6) as median_full, round(stddev_pop(err), 6) as std_full, round(avg(err) filter (j >= 8 and j < 56), 6) as mean_mid, round(median(err) filter (j >= 8 and j < 56), 6) as median_mid, round(stddev_pop(err) filter (j >= 8 and j < 56), 6) as std_mid from err group by model",
    "a8_sample_packs": f"""with {POINTS}, {NOISY}, u as (select distinct case when shard < {SPLIT[0]} then 'train' when shard < {SPLIT[1]} then 'val' else 'test' end as split, shard, agent, i, s from noisy)
select split, shard, cast(dense_rank() over (partition by split order by shard) - 1 as integer) as shard_index, n_rows from (select split, shard, count(*) as n_rows from u group by all)""",
    "b1_valid_fixes": f"with {TRAJ}, {VALID} select event_id, agent, longitude_n, latitude_n from valid",
    "b2_noisy_valid": f"with {TRAJ} select event_id, agent from traj where {finite('longitude_n', 'latitude_n')}",
    "b3_drop_nan": f"with {TRAJ}, odd as (select event_id, case when event_id % 101 = 0 then 'Infinity'::double else longitude_n end as longitude_n, latitude_n from traj) select event_id from odd where longitude_n is not null and not isnan(longitude_n) and latitude_n is not null and not isnan(latitude_n)",
    "b4_drop_accounting": f"with {TRAJ} select shard, agent, count(*) as n_before, count(*) filter ({finite(*FOUR)}) as n_valid, count(*) filter (not ({finite(*FOUR)})) as n_dropped from traj group by all",
    "b5_quality_check": f"with {TRAJ} select " + ", ".join(f"count(*) filter (not {finite(c)}) as bad_{c}" for c in FOUR) + " from traj",
    "b5_checked_users": f"with {TRAJ} select event_id, agent from traj where (shard, agent) not in (select (shard, agent) from traj where not ({finite(*FOUR)}))",
    "b6_enu_finite": f"with {POINTS} select count(*) as n_points, count(*) filter (not ({finite('e1', 'n1', 'e0', 'n0')})) as n_bad from enu",
    "b7_epoch_seconds": f"with {TRAJ} select event_id, epoch(date_trunc('second', ts)) as ts_s from traj",
    "b8_min_length": f"with {BASE}, {STATE} select shard, agent, n, start from (select z.*, greatest(0, coalesce(end_row + 1 - {Q}, 0)) as start from sizes z left join state t using (shard, agent)) where case when start = 0 then n > {K} else start + {K} <= n end",
    "b9_sample_validity": f"with {POINTS}, {NOISY} select ok, count(*) as n_samples from (select bool_and({finite('ex', 'nx', 've', 'vn')} and event_id % 503 <> 0) as ok from noisy group by shard, agent, i, s) group by ok",
    "b10_coordinate_channels": f"with {POINTS} select shard, agent, i, j, {_R('e1')}, {_R('n1')} from enu",
    "b11_overlap_mask": f"with {POINTS} select shard, agent, i, cast(sum(case when is_start then 0 else 1 end) as bigint) as weight from filled group by all",
    "b12_single_user": f"with {TRAJ} select event_id, agent, shard from traj where agent = 7",
    "c1_start_rows": f"with {BASE}, {STATE} select z.shard, z.agent, greatest(0, coalesce(end_row + 1 - {Q}, 0)) as start from sizes z left join state t using (shard, agent)",
    "c2_chunk_points": f"with {BASE}, {CP} select shard, agent, i, j, event_id from cp",
    "c3_state_merge": f"with {CHUNKS}, {STATE}, fresh as (select shard, agent, max(row_end) as end_row from chunks group by all) select coalesce(a.shard, b.shard) as shard, coalesce(a.agent, b.agent) as agent, greatest(coalesce(a.end_row, -1), coalesce(b.end_row, -1)) as end_row from state a full join fresh b on a.shard = b.shard and a.agent = b.agent",
    "c4_not_in_small": f"with {POINTS}, {NOISY}, {_SAMPLES}, {_SET} select {_NAMED} from valid_s where {_NOT_SMALL}",
    "c5_sampled_users": f"with {TRAJ}, picked as (select * from (select shard, agent, row_number() over (partition by shard order by md5('seed/' || agent), agent) as r from (select distinct shard, agent from traj)) where r <= 2) select event_id, agent from traj where (shard, agent) in (select (shard, agent) from picked)",
    "c6_best_checkpoint": f"with {LOG}, {ERR}, best as (select * from (select *, row_number() over (partition by model order by acc_mean, acc_median, acc_std, step) as r from ckpt_log) where r = 1), vec as (select sample, j // 8 as grp, avg(err) as err from err group by all) select model, ckpt_name, grp, round(err, 6) as err from best join vec on vec.sample = best.step % 500",
    "c7_models_by_samples": f"with {POINTS}, {NOISY}, m as (select unnest({list(MODELS)}::double[]) as a) select a, round(avg(sqrt((a * ex - ve) * (a * ex - ve) + (a * nx - vn) * (a * nx - vn))), 6) as err, count(*) as n from noisy cross join m group by a",
    "c8_tail_alignment": f"""with {BASE}, est as (select * from pts where p >= {Q}), a as (select *, row_number() over (partition by shard, agent order by p desc) as k from pts), b as (select *, row_number() over (partition by shard, agent order by p desc) as k from est)
select a.shard, a.agent, count(*) as n_pairs, cast(min(a.p) as bigint) as first_p from a join b using (shard, agent, k) group by all""",
    "c9_prediction_vs_label": f"with {POINTS}, {NOISY} select shard, agent, i, s, round(avg(sqrt((0.1::double * ex - ve) * (0.1::double * ex - ve) + (0.1::double * nx - vn) * (0.1::double * nx - vn))), 4) as err from noisy group by all",
    "c10_position_weights": f"with {POINTS} select shard, agent, i, round(sum(err * {weight('j', K)}), 4) as weighted from eps group by all",
    "c11_retain_or_drop": f"""with {LOG}, {{keep}} select l.model, count(*) filter (k.model is not null) as n_retained, count(*) filter (k.model is null) as n_dropped from ckpt_log l left join keep k on l.model = k.model and l.ckpt_name = k.ckpt_name group by l.model""",
    "d1_distinct_users": f"with {TRAJ} select shard, count(distinct agent) as n_agents from traj group by shard",
    "d2_modalities": f"with {TRAJ} select distinct modality from (select modality, row_number() over (partition by shard order by ts, event_id) as r from traj) where r <= 1000",
    "d3_displacements": f"with {POINTS} select shard, agent, i, j, round(err, 2) as eps from eps where isfinite(err) and shard < {SPLIT[0]}",
    "d4_sketched_fence": f"with {POINTS} select cast(run as integer) as run, cast(count(distinct shard) filter (shard >= first) as integer) as n_read, count(*) filter (isfinite(err)) as n, "
    f"round(min(err) filter (isfinite(err)), 4) as low, round(max(err) filter (isfinite(err)), 4) as high, true as q1_within, true as q3_within "
    f"from eps join (values (1, 0, {SPLIT[0] // 2}), (2, {SPLIT[0] // 2}, {SPLIT[0]})) as runs(run, first, last) on shard < last group by run",
    "d4_outlier_fence": f"with {POINTS} select round(q3 + 1.5 * (q3 - q1), 4) as delta, round(q1, 4) as q1, round(q3, 4) as q3, round(q3 - q1, 4) as iqr from (select {_FENCE} from eps where isfinite(err) and shard < {SPLIT[0]})",
    "d5_displacement_range": f"with {POINTS} select round(min(err), 4) as low, round(max(err), 4) as high, round(avg(err), 4) as mean from eps where shard < {SPLIT[0]}",
    "d6_error_summary": f"with {ERR} select model, {_summary('err')} from err group by model",
    "d7_sample_error": f"with {ERR} select sample, round(avg(err), 6) as err from err group by sample",
    "d8_set_statistics": f"with {ERR}, s as (select model, ckpt, sample, avg(err) as err from err group by all) select model, ckpt, round(avg(err), 6) as mean, round(median(err), 6) as median, round(stddev_pop(err), 6) as std from s group by all",
    "d9_lower_median": f"with {ERR}, s as (select model, ckpt, sample, avg(err) as err from err group by all) select model, ckpt, round(avg(err), 6) as mean, round(quantile_disc(err, 0.5), 6) as median, round(stddev_pop(err), 6) as std from s group by all",
    "d10_group_errors": f"with {ERR} select model, ckpt, j // 8 as grp, round(avg(err), 6) as err from err group by all",
    "d11_overlap_runs": f"""with {ERR}, g as (select model, ckpt, j // 8 as grp, avg(err) as err from err group by all),
f as (select model, ckpt, quantile_cont(err, 0.75) + 1.5 * (quantile_cont(err, 0.75) - quantile_cont(err, 0.25)) as delta from g group by all),
h as (select g.*, err > delta as high from g join f using (model, ckpt)),
r as (select *, max((not high)::int) over (partition by model, ckpt order by grp) as ahead, max((not high)::int) over (partition by model, ckpt order by grp desc) as behind from h)
select model, ckpt, count(*) filter (ahead = 0) as q1, count(*) filter (behind = 0 and ahead <> 0) as q2 from r group by all""",
    "d11_overlaps_grown": f"""with recursive {ERR}, g as (select model, ckpt, j // 8 as grp, avg(err) as err from err group by all),
f as (select model, ckpt, quantile_cont(err, 0.75) + 1.5 * (quantile_cont(err, 0.75) - quantile_cont(err, 0.25)) as delta from g group by all),
h as (select g.*, err > delta as high from g join f using (model, ckpt)),
r as (select *, max((not high)::int) over (partition by model, ckpt order by grp) as ahead, max((not high)::int) over (partition by model, ckpt order by grp desc) as behind from h),
l as (select model, ckpt, count(*) filter (ahead = 0) as q1, count(*) filter (behind = 0 and ahead <> 0) as q2, list(err order by grp) as e, list(high::int order by grp) as o, count(*) as n from r group by all),
w(model, ckpt, q1, q2, e, o, n) as (select * from l union all
  select model, ckpt, q1 + (e[q1 + 1] > e[n - q2])::int, q2 + (not e[q1 + 1] > e[n - q2])::int, e, o, n from w where list_sum(o[q1 + 1:n - q2]) > 0)
select model, ckpt, max(q1) as q1, max(q2) as q2 from w group by all""",
    "d12_full_and_middle": f"with {ERR} select model, round(avg(err), 6) as mean_full, round(median(err), 6) as median_full, round(stddev_pop(err), 6) as std_full, round(avg(err) filter (j >= 8 and j < 56), 6) as mean_mid, round(median(err) filter (j >= 8 and j < 56), 6) as median_mid, round(stddev_pop(err) filter (j >= 8 and j < 56), 6) as std_mid from err group by model",
    "d13_masked_huber": f"with {POINTS} select round(avg({huber(f'(err * {weight(chr(106), K)})', DELTA)}), 6) as loss, round(avg(err * {weight('j', K)}), 6) as mean_error from eps",
    "d14_weighted_huber": f"with {POINTS} select round(sum((case when is_start then 0 else 1 end) * {huber('err', DELTA)}) / (sum(case when is_start then 0 else 1 end) + 1e-8), 6) as loss, round(avg(err), 6) as mean_error from eps",
    "d16_axis_error": f"with {POINTS}, s as (select shard, agent, i, avg((abs(e1 - e0) + abs(n1 - n0)) / 2) as err from eps where j >= {Q} group by all) select round(avg(err), 6) as mean, round(quantile_disc(err, 0.5), 6) as median, round(stddev_pop(err), 6) as std from s",
    "d17_mean_of_batches": f"with {LOG} select round(avg(a), 6) as avg_loss, round(avg(b), 6) as acc_mean from (select step // 64 as batch, avg(avg_loss) as a, avg(acc_mean) as b from ckpt_log group by batch)",
    "d18_split_counts": f"with {CHUNKS} select case when shard < {SPLIT[0]} then 'train' when shard < {SPLIT[1]} then 'val' else 'test' end as split, count(*) as n_chunks, count(*) * {DRAWS} as n_samples from chunks group by split",
    "d19_packing": f"with {POINTS} select shard, agent, i, count(*) as n_points, string_agg(cast(event_id as varchar), ',' order by j) as ids from filled group by all having count(*) = {K}",
    "d20_group_matrix": f"with {ERR} select model, ckpt, " + ", ".join(f"round(avg(err) filter (j // 8 = {g}), 6) as byte_{g}" for g in range(8)) + " from err group by model, ckpt",
    "d21_input_baseline": f"with {BASE}, o as (select *, first_value(longitude) over w as lon_o, first_value(latitude) over w as lat_o from pts window w as (partition by shard, agent order by p)), e as (select *, {_E1[0]} as e1, {_E1[1]} as n1, {_E0[0]} as e0, {_E0[1]} as n0 from o where n >= 2) select {_summary('sqrt((e1 - e0) * (e1 - e0) + (n1 - n0) * (n1 - n0))')} from e",
    "d22_trajectory_error": f"""with {BASE}, {INFER}, io as (select *, first_value(longitude_n) over w as lon_o, first_value(latitude_n) over w as lat_o from infer window w as (partition by shard, agent, i order by j)),
ie as (select *, {_E1[0]} * power(1 - 0.2::double * 0.1, 5) as e1, {_E1[1]} * power(1 - 0.2::double * 0.1, 5) as n1 from io),
own as (select ie.shard, ie.agent, ie.p, e1, n1, lon_o, lat_o from ie where i = least(p // {SI}, m - 1) and j = p + {Q1} - i * {SI}),
d as (select own.*, v.longitude, v.latitude from own join pts v on v.shard = own.shard and v.agent = own.agent and v.p = own.p),
x as (select shard, agent, sqrt((e1 - {_E0[0]}) * (e1 - {_E0[0]}) + (n1 - {_E0[1]}) * (n1 - {_E0[1]})) as err from d)
select shard, {_summary('err')} from x group by shard""",
    "d23_chunk_error": f"with {POINTS}, {NOISY}, c as (select *, ex * power(1 - t / 5 * 0.1::double, 5) as xe, nx * power(1 - t / 5 * 0.1::double, 5) as xn from noisy), both_ as (select 'denoised' as what, sqrt((xe - e0) * (xe - e0) + (xn - n0) * (xn - n0)) as err from c union all select 'input', sqrt((ex - e0) * (ex - e0) + (nx - n0) * (nx - n0)) from c) select what, {_summary('err')} from both_ group by what",
    "e1_positions": f"with {BASE} select event_id, p from pts",
    "e2_lengths": f"with {BASE} select event_id, n from pts",
    "e3_chunk_numbers": f"with {CHUNKS} select * from chunks",
    "e4_chunk_cap": f"with {CHUNKS} select * from chunks where chunk_id < 10",
    "e5_origins": f"with {POINTS} select distinct shard, agent, i, lon_o, lat_o from origin",
    "e6_filled_heads": f"with {POINTS} select shard, agent, i, j, longitude_n, latitude_n, ts_s from filled where j < {Q}",
    "e7_is_start": f"with {POINTS} select shard, agent, i, j, is_start from filled",
    "e8_end_rows": f"with {CHUNKS} select shard, agent, max(row_end) as end_row from chunks group by all",
    "e9_split_by_rank": f"with {TRAJ}, {SHARDS} select shard, case when rank < 26 then 'train' when rank < 29 then 'val' else 'test' end as split from ranked",
    "e10_split_by_share": f"with {TRAJ}, {SHARDS} select shard, case when rank < ceil(n * 0.70) then 'train' when rank < ceil(n * 0.70) + ceil(n * 0.15) then 'val' else 'test' end as split from ranked",
    "e11_first_by_fingerprint": f"with {POINTS}, {NOISY}, {_SAMPLES}, {_SET} select {_NAMED} from firsts",
    "e12_keep_set": f"with {LOG}, {{keep}} select * from keep",
    "e13_best_by_audit": f"with {LOG} select model, ckpt_name, step from (select *, row_number() over (partition by model order by acc_mean, acc_median, acc_std, step) as r from ckpt_log) where r = 1",
    "e14_best_by_training": f"with {LOG} select model, ckpt_name, step from (select *, row_number() over (partition by model order by acc_median, acc_mean, step desc) as r from ckpt_log) where r = 1",
    "e15_resume_point": f"with {LOG} select model, step, ckpt_name, epoch, avg_loss from (select *, row_number() over (partition by model order by step desc) as r from ckpt_log) where r = 1",
    "e16_running_means": f"with {LOG} select model, epoch, step, cast(avg(avg_loss) over w as float) as loss, cast(avg(acc_mean) over w as float) as error from ckpt_log window w as (partition by model, epoch order by step rows unbounded preceding)",
    "e17_delta_schedule": f"""with recursive {LOG}, o as (select model, step, acc_mean, row_number() over (partition by model order by step) as r from ckpt_log),
f(model, r, delta) as (select distinct model, 0::bigint, 38.13::double from o union all
  select f.model, o.r, least(80.0::double, greatest(20.0::double, (1 - a) * f.delta + a * greatest(o.acc_mean, 15.0::double)))
  from f join (select *, case when step < 5000 then 0.02::double else 0.005::double end as a from o) o on o.model = f.model and o.r = f.r + 1)
select model, round(max_by(delta, r), 6) as delta from f group by model""",
    "e18_next_user": f"with {TRAJ} select shard, agent, lead(shard) over (order by shard, agent) as next_shard, lead(agent) over (order by shard, agent) as next_agent from (select distinct shard, agent from traj)",
    "f1_time_sort": f"with {BASE} select shard, agent, string_agg(cast(event_id as varchar), ',' order by p) as ids from pts group by all",
    "f2_sampled_users": f"with {TRAJ} select shard, agent from (select shard, agent, row_number() over (partition by shard order by md5('seed/' || agent), agent) as r from (select distinct shard, agent from traj)) where r <= 3",
    "f3_first_users": f"with {TRAJ} select shard, agent from (select shard, agent, dense_rank() over (partition by shard order by agent) as r from (select distinct shard, agent from traj)) where r <= 3",
    "f4_last_shards": f"with {TRAJ} select distinct shard from (select shard, dense_rank() over (order by shard desc) as r from traj) where r <= 3",
    "f5_quick_sample": f"with {TRAJ} select event_id from traj order by md5('quick/' || event_id), event_id limit 2000",
    "f6_small_set": f"with {POINTS}, {NOISY}, {_SAMPLES}, {_SET} select {_NAMED} from small",
    "f7_big_set": f"with {POINTS}, {NOISY}, {_SAMPLES}, {_SET} select {_NAMED} from firsts where {_NOT_SMALL} order by pack, shard, agent, i, s limit 1000",
    "f8_epoch_batches": f"""with s as (select event_id as sample, event_id % 4 as shard from events), k as (select *, row_number() over (partition by shard order by sample) as r, least(37000, count(*) over (partition by shard) - count(*) over (partition by shard) % 100) as n from s where shard = 2),
b as (select sample, pass, n, (row_number() over (partition by pass order by md5('6/' || pass || '/' || sample), sample) - 1) // 64 as batch from (select *, unnest(range(0, 2)) as pass from k where r <= n))
select sample, cast(pass as integer) as pass, batch from b where (batch + 1) * 64 <= n""",
    "f8_keyed_batches": f"""with recursive s as (select event_id as sample, event_id % 4 as shard from events), k as (select sample, row_number() over (order by sample) - 1 as r, least(37000, count(*) over () - count(*) over () % 100) as n from s where shard = 2),
turns as (select sample, pass, n, r as at_, 0 as t from (select *, unnest(range(0, 2)) as pass from k where r < n)
  union all select sample, pass, n, case when {uniform("'6/' || pass || '/' || (t + 1) || '/' || greatest(at_, other)")} < 0.5 then other else at_ end, t + 1
  from (select *, (cast(floor({uniform("'6/' || pass || '/' || (t + 1)")} * n) as bigint) + n - at_) % n as other from turns where t < 40))
select sample, cast(pass as integer) as pass, at_ // 64 as batch from turns where t = 40 and (at_ // 64 + 1) * 64 <= n""",
    "f9_draws": f"""with s as (select event_id as sample, event_id % 4 as shard from events), z as (select *, row_number() over (partition by shard order by sample) - 1 as at_, count(*) over (partition by shard) as n from s),
d as (select unnest(range(0, 5000)) as draw) select draw, z.shard, sample from d join z on z.shard = draw % 4 and z.at_ = cast(floor({uniform("'draws/' || draw")} * z.n) as bigint)""",
    "f10_capped_error": f"with {ERR}, s as (select sample, avg(err) as err from err group by sample order by sample limit 300) select round(avg(err), 6) as mean, count(*) as n from s",
    "g1_concatenated": f"with {TRAJ} select shard, count(*) as n from traj group by shard",
    "g2_distinct_union": f"with {TRAJ} select distinct modality from traj",
    "g3_union_of_keeps": f"with {LOG}, {{keep}} select model, count(*) as n from keep group by model",
    "g4_not_kept": f"with {LOG}, {{keep}} select model, ckpt_name from ckpt_log except select model, ckpt_name from keep",
    "g5_replaced_record": f"with {CHUNKS}, fresh as (select shard, agent, max(row_end) as end_row from chunks group by all) select shard, agent, case when shard = 3 then end_row + 1000 else end_row end as end_row from fresh",
    "g6_disjoint_sets": f"with {POINTS}, {NOISY}, {_SAMPLES}, {_SET}, big as (select * from firsts where {_NOT_SMALL} order by pack, shard, agent, i, s limit 1000) select count(*) as n_common from small join big using (shard, agent, i, s)",
    "h1_to_enu": f"with {POINTS} select shard, agent, i, j, {_R('e1')}, {_R('n1')}, {_R('e0')}, {_R('n0')} from enu",
    "h1_with_up": f"with {POINTS} select shard, agent, i, j, round({_UP[0]}, 2) + 0.0 as e, round({_UP[1]}, 2) + 0.0 as north, round({_UP[2]}, 2) + 0.0 as up from origin",
    "h2_true_height": f"with {POINTS} select shard, agent, i, j, round(longitude_n, 6) as lon, round(latitude_n, 6) as lat, (event_id % 500)::double as height from origin",
    "h2_to_geodetic": f"with {POINTS} select shard, agent, i, j, round({_BACK[0]}, 6) as lon, round({_BACK[1]}, 6) as lat from enu",
    "h3_velocity": f"with {POINTS} select shard, agent, i, j, round(e1 - e0, 2) + 0.0 as ve, round(n1 - n0, 2) + 0.0 as vn from enu",
    "h4_noise_levels": f"with {POINTS}, {NOISY} select shard, agent, i, s, j, t, round(ex, 2) + 0.0 as ex, round(nx, 2) + 0.0 as nx from noisy",
    "h5_endpoints": f"with {POINTS}, {NOISY} select shard, agent, i, s, round(max(abs(ex - t * ve - e0)), 6) as off0, round(max(abs(ex + (1 - t) * ve - e1)), 6) as off1 from noisy group by all",
    "h6_lengths": f"with {POINTS} select shard, round(sum(err), 4) as plain, round(sum(sqrt((e1 - e0) * (e1 - e0) + (n1 - n0) * (n1 - n0) + 1e-8)), 4) as with_eps from eps group by shard",
    "h7_huber": f"with {POINTS} select shard, round(sum({huber('err', 8.0)}), 4) as loss from eps group by shard",
    "h8_position_weight": f"with {ERR} select j, round(max({weight('j', 64)}), 6) as w from err group by j",
    "h9_noise_embedding": "with t as (select event_id, (event_id % 1000) / 1000.0::double as t from events), x as (select event_id, t, unnest(range(0, 8)) as i from t) select event_id, i, round(sin(t * exp(-i * ln(10000.0::double) / 7)), 6) + 0.0 as s, round(cos(t * exp(-i * ln(10000.0::double) / 7)), 6) + 0.0 as c from x",
    "h10_fingerprints": f"with {POINTS}, {NOISY}, g as (select shard, agent, i, s, string_agg(cast(ex::float as varchar) || ',' || cast(nx::float as varchar), ';' order by j) as key from noisy group by shard, agent, i, s) select count(*) as n_samples, count(distinct key) as n_distinct from g",
    "h11_step_of": f"with {LOG} select ckpt_name, coalesce(try_cast(nullif(regexp_extract(ckpt_name, '_s(\\d+)', 1), '') as bigint), -1) as step from ckpt_log",
    "h12_names": f"with {LOG} select ckpt_name, replace(ckpt_name, '.safetensors', '_full.pt') as weights, split_part(ckpt_name, '_', 1) as arch, split_part(ckpt_name, '_', 2) as size from ckpt_log",
    "i1_inference_chunks": f"with {BASE}, {INFER} select shard, agent, i, j, p from infer",
    "i2_stitch": f"with {BASE} select shard, agent, p from pts",
    "i4_depth_first": f"""with {BASE}, {INFER}, io as (select *, first_value(longitude_n) over w as lon_o, first_value(latitude_n) over w as lat_o from infer window w as (partition by shard, agent, i order by j)),
ie as (select *, {_E1[0]} * power(1 - 0.2::double * 0.1, 5) as e1, {_E1[1]} * power(1 - 0.2::double * 0.1, 5) as n1 from io)
select shard, agent, p, round({_BACK[0]}, 6) as lon, round({_BACK[1]}, 6) as lat from ie where i = least(p // {SI}, m - 1) and j = p + {Q1} - i * {SI}""",
    "i5_breadth_first": f"""with recursive {BASE}, io as (select *, first_value(longitude_n) over w as lon_o, first_value(latitude_n) over w as lat_o from pts window w as (partition by shard, agent order by p)),
iv as (select shard, agent, p, n, unnest([{{'axis': 'e', 'v': {_E1[0]}}}, {{'axis': 'n', 'v': {_E1[1]}}}], recursive := true) from io),
it as (select shard, agent, axis, max(n) as n, cast(1 + ceil(greatest(0, max(n) - {K - Q1}) / {SI}) as bigint) as m, list(v order by p) as x from iv group by all),
walk as (select shard, agent, axis, n, m, x, 0::bigint as step, []::double[] as tail, []::double[] as done from it
  union all select shard, agent, axis, n, m, case when step % m = m - 1 then done || own else x end, step + 1, case when step % m = m - 1 then [] else c[{SI + 1}:] end, case when step % m = m - 1 then [] else done || own end
  from (select *, list_slice(c, {Q1 + 1}, case when step % m < m - 1 then {K - Q2} else n - (step % m) * {SI} + {Q1} end) as own
    from (select * exclude (raw), list_transform(raw, lambda v: v - 0.1::double / 5 * (v - raw[1])) as c
      from (select *, list_transform(range({K}), lambda j: case when step % m > 0 and j < {Q1 + Q2} then tail[j + 1] else x[least(greatest((step % m) * {SI} - {Q1} + j, 0), n - 1) + 1] end) as raw from walk where step < 5 * m))))
select a.shard, a.agent, a.p, round(a.v, 4) + 0.0 as e, round(b.v, 4) + 0.0 as n
from (select shard, agent, unnest(range(0, n)) as p, unnest(x) as v from walk where step = 5 * m and axis = 'e') a
join (select shard, agent, unnest(range(0, n)) as p, unnest(x) as v from walk where step = 5 * m and axis = 'n') b using (shard, agent, p)""",
    "i5_error_codes": f"""with {TRAJ}, v as (select shard, agent, count(*) filter (agent % 50 <> 0 and {finite(*FOUR)}) as n_points from traj group by all)
select shard, agent, n_points, case when n_points > 0 then 0 else -1 end as error_code from v""",
    "i6_euler": f"with {POINTS}, {NOISY} select shard, agent, i, s, round(avg(ex * power(1 - t / 30 * 0.1::double, 30)), 4) + 0.0 as e, round(avg(nx * power(1 - t / 30 * 0.1::double, 30)), 4) + 0.0 as n from noisy group by all",
    "i7_predictions": f"with {POINTS}, {NOISY} select shard, agent, i, s, round(avg(0.1::double * ex), 4) + 0.0 as ve, round(avg(0.1::double * nx), 4) + 0.0 as vn from noisy group by all",
    "i8_strided_chunks": f"""with {BASE}, c as (select *, unnest(range(0, cast(ceil(n / {S}) as bigint))) as i from sizes), x as (select *, unnest(range(i * {S} + {Q}, least(i * {S} + {K}, n))) as p from c)
select shard, agent, i, p, p - i * {S} as j from x""",
    "i10_audit": f"""with {ERR}, s as (select model, ckpt, sample, avg(err) as err from err group by all),
m as (select model, ckpt, avg(err) as mean, median(err) as median, stddev_pop(err) as std from s group by all),
b as (select *, row_number() over (partition by model order by mean, median, std, ckpt) as r from m)
select model, ckpt, round(mean, 6) as mean, round(median, 6) as median, round(std, 6) as std, {_BYTES} from b join err using (model, ckpt) where r = 1 group by all""",
    "j1_streamed_dicing": f"with {CHUNKS} select shard, agent, row_start // {S} as i, row_start, row_end from chunks",
}
_KEEP = "keep as (" + " union ".join(
    f"select model, ckpt_name from (select *, row_number() over (partition by model order by {o}) as r from ckpt_log) where r <= {n}"
    for o, n in (("acc_mean, step", 3), ("acc_median, step", 3), ("step desc", 7))
) + ")"
SQL = {k: v.replace("{keep}", _KEEP) for k, v in SQL.items()}
