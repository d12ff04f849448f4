"""Applying a velocity model v = f(x, t) to chunks, and fitting a simple one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.samples import finite, huber, length
from wayline.operators.sampling import cut, stored_shards
from wayline.sources.trajectories import scratch

Predictor = Callable[[np.ndarray, np.ndarray], np.ndarray]


def linear_predictor(a: float) -> Predictor:
    """v = a x: the stand-in whose Euler steps have a closed form."""
    return lambda x, t: a * x


def steps_of(dt: float) -> int:
    return round(1 / dt)


def euler(x: Column, a: Column, t: Column, steps: int) -> Column:
    """``steps`` equal steps from level t to 0 under v = a x, as a column: x <- x - (t / steps) a x."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda s, _: s - t / steps * a * s)


def denoise_chunks(rows: DataFrame, keys: Sequence[str], k: int, predictor: Predictor, dt: float, batch: int = 512) -> DataFrame:
    """Every chunk on its own from t = 1 to 0: rows (keys, j, e, n) of whole chunks in, the same rows out.

    Chunks are packed to one row each, so that Arrow batches hold whole chunks and the predictor sees (b, k, 2) arrays.
    """
    m = steps_of(dt)
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("j", "e", "n"))).alias("pts")).where(F.size("pts") == k)
    flat = packed.select(*keys, F.transform("pts", lambda p: p["e"]).alias("e"), F.transform("pts", lambda p: p["n"]).alias("n"))
    schema = ", ".join(f"{c} {t}" for c, t in flat.dtypes if c in keys) + ", e array<double>, n array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                x = np.stack([np.stack(part["e"].to_list()), np.stack(part["n"].to_list())], axis=2)
                for step in range(m):
                    t = np.full((len(x), 1), 1 - step / m)
                    x = x - predictor(x, t) / m
                out = part[list(keys)].copy()
                out["e"], out["n"] = list(x[:, :, 0]), list(x[:, :, 1])
                yield out

    done = flat.mapInPandas(run, schema)
    return done.select(*keys, F.posexplode(F.arrays_zip("e", "n")).alias("j", "p")).select(*keys, F.col("j").cast("long").alias("j"), "p.e", "p.n")


def denoise_breadth_first(rows: DataFrame, keys: Sequence[str], k: int, q1: int, q2: int, predictor: Predictor, dt: float, block: int = 4096) -> DataFrame:
    """All chunks of a trajectory move one level at a time; a chunk's head is the tail that its forerunner has just reached.

    Rows (keys, p, e, n) of points in, places p from 0 on without gaps, (keys, p, e, n) out, as many; the predictor sees metres from a chunk's first
    point. The last chunk is kept to its real end.

    A task holds ``block`` chunks, not a trajectory. Blocks lean: with each level a block begins and ends some chunks earlier, so that it
    needs nothing of the block behind it, and takes every point through all levels at once. What it hands on is, for each level, the
    last tail and the points that the next level of the next block begins with. The n-th blocks of all trajectories are one job, which reads
    and writes only their own points; there are as many jobs as blocks in the longest trajectory.
    """
    if k <= q1 + q2 or block < 1:
        raise ValueError("overlaps leave no room for new points" if block >= 1 else "a block holds a chunk or more")
    m, s, spark = steps_of(dt), k - q1 - q2, rows.sparkSession
    lean = max(1, -(-q2 // s))  # chunks that a level's last chunk looks ahead
    types = dict(rows.dtypes)
    # lvl: 0 given points; 1 to m points at that level, m the result; -1 to -m tails; m + 1 one row with a trajectory's length
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", lvl int, p long, e double, n double"
    of = lambda at: F.greatest(F.lit(0), F.floor((at - q2) / (block * s))).cast("int")
    path = scratch(spark, "blocks")
    given = rows.select(*keys, F.lit(0).alias("lvl"), F.col("p").cast("long").alias("p"), F.col("e").cast("double").alias("e"), F.col("n").cast("double").alias("n"))
    given.withColumn("_block", of(F.col("p"))).write.partitionBy("_block").parquet(path)
    stored_points = spark.read.schema(f"{schema}, _block int").parquet(path)
    nothing = F.lit(None).cast("double")
    ends = stored_points.groupBy(*keys).agg((F.max("p") + 1).alias("p")).select(*keys, F.lit(m + 1).alias("lvl"), "p", nothing.alias("e"), nothing.alias("n"), of(F.col("p") - 1).alias("_block"))
    stored = stored_points.unionByName(ends)

    def moved(number: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            held = {lvl: part.sort_values("p") for lvl, part in pdf.groupby("lvl")}
            length_ = int(held[m + 1]["p"].iloc[0]) if m + 1 in held else None
            chunks = None if length_ is None else 1 + -(-max(0, length_ - (k - q1)) // s)
            xy = lambda lvl: held[lvl][["e", "n"]].to_numpy(float) if lvl in held else np.zeros((0, 2))
            out: list[tuple[int, int, np.ndarray]] = []  # level, first place, points
            before, base = xy(0), int(held[0]["p"].iloc[0])
            for level in range(1, m + 1):
                first = max(0, number * block - lean * (level - 1))
                stop = max(0, (number + 1) * block - lean * (level - 1)) if chunks is None else chunks
                t = np.full((1, 1), 1 - (level - 1) / m)
                tail = xy(-level) if first else None
                new = [xy(level)]
                base_next = int(held[level]["p"].iloc[0]) if level in held else first * s
                for i in range(first, stop):
                    at = np.clip(i * s - q1 + np.arange(k), 0, None if length_ is None else length_ - 1) - base
                    chunk = before[at][None] if tail is None else np.concatenate([tail, before[at[q1 + q2 :]]])[None]
                    chunk = chunk - predictor(chunk - chunk[:, :1], t) / m
                    tail = chunk[0, s:].copy()
                    new.append(chunk[0, q1 : k - q2 if chunks is None or i < chunks - 1 else length_ - i * s + q1])
                points = np.concatenate(new)
                if chunks is None and tail is not None:
                    out.append((-level, 0, tail))
                if level == m:
                    out.append((m, base_next, points))
                elif chunks is None:
                    begin = max(0, (number + 1) * block - lean * level)
                    at = begin * s + q2 if begin else 0
                    out.append((level, at, points[at - base_next :]))
                before, base = points, base_next
            sizes = [len(x) for _, _, x in out]
            values = np.concatenate([x for _, _, x in out])
            return pd.DataFrame({
                **{c: [pdf[c].iloc[0]] * len(values) for c in keys}, "lvl": np.repeat([lvl for lvl, _, _ in out], sizes),
                "p": np.concatenate([at + np.arange(n) for (_, at, _), n in zip(out, sizes, strict=True)]), "e": values[:, 0], "n": values[:, 1],
            })

        return run

    done, handed = None, None
    for number in stored_shards(stored_points, "_block"):
        own = stored.where(F.col("_block") == number).drop("_block")
        own = own if handed is None else own.unionByName(handed)
        own = cut(own.groupBy(*keys).applyInPandas(moved(number), schema))
        handed = own.where(F.col("lvl") != m)
        reached = own.where(F.col("lvl") == m).select(*keys, "p", "e", "n")
        done = reached if done is None else done.unionByName(reached)
    return done if done is not None else given.drop("lvl").where("false")


class LoadOnce:
    """A predictor that every worker process loads at its first batch and keeps: only name and loader are shipped."""

    _held: dict[str, Predictor] = {}

    def __init__(self, name: str, load: Callable[[], Predictor]):
        self.name, self.load = name, load

    def __call__(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        if self.name not in LoadOnce._held:
            LoadOnce._held[self.name] = self.load()
        return LoadOnce._held[self.name](x, t)


def with_error_code(trajectories: DataFrame, done: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """All ``trajectories`` (keys) with the count ``n`` of ``done`` and error_code: 0, or -1 where nothing was left."""
    both = trajectories.join(done, list(keys), "left")
    return both.select(*keys, F.coalesce(n, F.lit(0)).alias(n), F.when(F.col(n) > 0, 0).otherwise(-1).alias("error_code"))


def predict(rows: DataFrame, keys: Sequence[str], predictor: Predictor) -> DataFrame:
    """Velocities (keys, ve, vn) of points (keys, e, n, t) in Arrow batches."""
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", ve double, vn double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = predictor(b[["e", "n"]].to_numpy(float)[:, None, :], b[["t"]].to_numpy(float))[:, 0, :]
            out = b[list(keys)].copy()
            out["ve"], out["vn"] = v[:, 0], v[:, 1]
            yield out

    return rows.select(*keys, "e", "n", "t").mapInPandas(run, schema)


def fit_velocity(rows: DataFrame, features: Sequence[str], delta: float, weight: Column | float = 1.0, rounds: int = 8) -> DataFrame:
    """Linear models of (ve, vn) on ``features`` under the fixed-delta Huber loss: (axis, intercept, coefficients, loss, rounds).

    The loss of a point is Huber's of ``weight`` times the length of its residual over both axes. Iteratively reweighted least
    squares: a round is one aggregate of the weighted normal equations, which both axes share, and a solve of their p x p
    system on the driver; the first round weighs all points alike. ``loss`` is the mean at the start of the last round. Points
    with a value that is missing or not finite, or without weight, take no part; without points, coefficients are zero.
    """
    spark, p = rows.sparkSession, len(features) + 1
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    held = rows.select(*[F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(features)], F.col("ve").cast("double").alias("ve"), F.col("vn").cast("double").alias("vn"), w.alias("w"))
    for c in held.columns:
        held = held.where(finite(F.col(c)))
    held = cut(held.where("w > 0").withColumn("x0", F.lit(1.0)))
    beta, loss = np.zeros((p, 2)), None
    for k in range(rounds):
        fitted = [sum((F.lit(float(beta[i, a])) * F.col(f"x{i}") for i in range(p)), F.lit(0.0)) for a in (0, 1)]
        e = F.col("w") * length(F.col("ve") - fitted[0], F.col("vn") - fitted[1])
        u = F.col("w") * F.col("w") * (F.lit(1.0) if k == 0 else F.when(e <= delta, 1.0).otherwise(delta / e))
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        sums = [F.sum(u * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs] + [F.sum(u * F.col(f"x{i}") * F.col(v)) for v in ("ve", "vn") for i in range(p)]
        found = held.agg(*sums, F.avg(huber(e, F.lit(float(delta))))).first()
        if found[0] is None:
            break
        a = np.zeros((p, p))
        for (i, j), v in zip(pairs, found, strict=False):
            a[i, j] = a[j, i] = v
        right, loss = np.array(found[len(pairs) : len(pairs) + 2 * p]).reshape(2, p).T, found[len(found) - 1]
        beta = np.linalg.lstsq(a, right, rcond=None)[0]  # features that repeat each other share their weight
    out = [(axis, float(beta[0, i]), [float(x) for x in beta[1:, i]], loss, rounds) for i, axis in enumerate(("ve", "vn"))]
    return spark.createDataFrame(out, "axis string, intercept double, coefficients array<double>, loss double, rounds int")
