"""Displacements, outlier fences, error statistics, losses and overlap detection."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.geo import to_enu
from wayline.functions.samples import huber, length
from wayline.operators.sampling import cut


def enu_pair(rows: DataFrame, keys: Sequence[str] = ("shard", "agent", "i")) -> DataFrame:
    """+ e0, n0 (clean) and e1, n1 (noisy), both seen from the chunk's noisy first point lon_o, lat_o."""
    own = Window.partitionBy(*keys).orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("lon_o", F.first("longitude_n").over(own)).withColumn("lat_o", F.first("latitude_n").over(own))
    for tag, lon, lat in (("1", "longitude_n", "latitude_n"), ("0", "longitude", "latitude")):
        e, n = to_enu(F.col(lon), F.col(lat), F.col("lon_o"), F.col("lat_o"))
        rows = rows.withColumn(f"e{tag}", e).withColumn(f"n{tag}", n)
    return rows


def displacement() -> Column:
    return length(F.col("e1") - F.col("e0"), F.col("n1") - F.col("n0"))


def with_quantiles(
    rows: DataFrame, values: dict[str, Column], by: Sequence[str], probs: Sequence[float], lower: bool = False, accuracy: int = 10_000, stats: Sequence[Column] = (),
) -> DataFrame:
    """Exact quantiles without a task that holds all values: ``by``, ``stats`` and, for each name of ``values``, an array.

    ``rows`` are computed once: keys and values are cut and read twice. The first reading aggregates ``stats``, which are
    aggregates over the names of ``values``, and a sketch, whose error is bounded by 1 / accuracy of the rows and which gives
    an interval about each wanted rank; the second counts the values below each interval and those inside, equal ones
    together. Only the inside, a few 10,000ths of the rows, is ranked in a window. Quantiles interpolate; with ``lower`` they
    are the value at rank ceil(p n). Nulls are left out, NaN is the largest value, null keys are keys; keys without values
    have null for the array. Without ``by`` there is one row, of empty tables too.
    """
    held = cut(rows.select(*by, *[c.cast("double").alias(n) for n, c in values.items()]))
    around = [e for p in probs for e in (max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy))]
    sketched = [f for n in values for f in (F.count(n).alias(f"_n_{n}"), F.percentile_approx(n, around, accuracy).alias(f"_e_{n}"))]
    sketch = cut(held.groupBy(*by).agg(*sketched, *stats))
    kept = [c for c in sketch.columns if c not in by and not c.startswith(("_n_", "_e_"))]
    if by:
        right = sketch.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[c for c in sketch.columns if c.startswith(("_n_", "_e_"))])
        on = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
        met, known = held.join(right, on), F.col
    else:  # a sketch of one row: its edges are literals
        row = sketch.first().asDict()
        types = {f.name: f.dataType for f in sketch.schema}
        met, known = held, lambda c: F.lit(row[c]).cast(types[c])
    slots = [(v, p) for v in values for p in range(len(probs))]

    def slot(at: int, v: str, p: int) -> Column:
        n, edges = known(f"_n_{v}"), known(f"_e_{v}")
        rank = F.greatest(F.ceil(F.lit(probs[p]) * n) - 1, F.lit(0)).cast("double") if lower else F.lit(probs[p]) * (n - 1)
        # few values: the interval is everything, which also holds the ranks next to the wanted one
        low = F.when(n <= accuracy, float("-inf")).otherwise(F.get(edges, F.lit(2 * p)))
        high = F.when(n <= accuracy, float("nan")).otherwise(F.get(edges, F.lit(2 * p + 1)))
        return F.struct(F.lit(at).alias("slot"), rank.alias("rank"), F.when(F.col(v) <= high, F.col(v) >= low).alias("inside"), F.col(v).alias("v"))

    met = met.select(*by, F.explode(F.array(*[slot(at, v, p) for at, (v, p) in enumerate(slots)])).alias("x")).where("x.inside is not null")
    counted = met.groupBy(*by, "x.slot", "x.rank", F.when(F.col("x.inside"), F.col("x.v")).alias("v")).agg(F.count("*").alias("m"))
    own = Window.partitionBy(*by, "slot").orderBy(F.asc_nulls_first("v"))
    placed = counted.withColumn("stop", F.sum("m").over(own)).where("v is not null").withColumn("start", F.col("stop") - F.col("m"))
    at = lambda r: F.max(F.when((F.col("start") <= r) & (r < F.col("stop")), F.col("v")))
    found = placed.groupBy(*by, "slot").agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"), F.max("rank").alias("rank"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank")))
    both = sketch.select(*by, *kept, *[f"_n_{v}" for v in values]).unionByName(found.select(*by, "slot", value.alias("q")), allowMissingColumns=True)
    array = lambda v: F.array(*[F.max(F.when(F.col("slot") == at, F.col("q"))) for at, (w, _) in enumerate(slots) if w == v])
    return both.groupBy(*by).agg(*[F.first(c, ignorenulls=True).alias(c) for c in kept], *[F.when(F.max(f"_n_{v}") > 0, array(v)).alias(v) for v in values])


def quantiles(rows: DataFrame, values: dict[str, Column], by: Sequence[str], probs: Sequence[float], lower: bool = False, accuracy: int = 10_000) -> DataFrame:
    """``with_quantiles`` alone, of the keys that have a value."""
    found = with_quantiles(rows, values, by, probs, lower, accuracy)
    return found.where(F.coalesce(*values).isNotNull()) if by else found


def fence(rows: DataFrame, value: str, by: Sequence[str] = (), exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """delta = q3 + 1.5 iqr with q1, q3, iqr of the finite values; 1, 0, 1, 1 where there are none.

    ``exact`` interpolates between exact ranks; otherwise one pass gives ranks within 1 / accuracy of the rows.
    """
    v = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    if exact:
        out = with_quantiles(rows, {"q": v}, by, (0.25, 0.75))
    else:
        out = rows.groupBy(*by).agg(F.percentile_approx(v, [0.25, 0.75], accuracy).alias("q"))
    q1, q3 = F.coalesce(F.col("q")[0], F.lit(0.0)), F.coalesce(F.col("q")[1], F.lit(1.0))
    iqr = q3 - q1
    return out.select(*by, F.when(F.col("q").isNull(), 1.0).otherwise(q3 + 1.5 * iqr).alias("delta"), q1.alias("q1"), q3.alias("q3"), iqr.alias("iqr"))


def summary(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum, mean, averaging median, population deviation and count."""
    stats = [F.sum("_med").alias("total_err"), F.avg("_med").alias("avg_err"), F.stddev_pop("_med").alias("std_err"), F.count("_med").alias("count")]
    both = with_quantiles(rows, {"_med": F.col(value)}, by, (0.5,), stats=stats)
    return both.select(*by, "total_err", "avg_err", F.get("_med", F.lit(0)).alias("med_err"), "std_err", "count")


def per_sample(errors: DataFrame, by: Sequence[str]) -> DataFrame:
    return errors.groupBy(*by).agg(F.avg("err").alias("err"))


def set_statistics(samples: DataFrame, by: Sequence[str], lower_median: bool = False) -> DataFrame:
    """Mean, median and population deviation of per-sample errors; the lower median of an even count on request."""
    stats = [F.avg("_med").alias("mean"), F.stddev_pop("_med").alias("std")]
    both = with_quantiles(samples, {"_med": F.col("err")}, by, (0.5,), lower_median, stats=stats)
    return both.select(*by, "mean", F.get("_med", F.lit(0)).alias("median"), "std")


def group_errors(errors: DataFrame, by: Sequence[str], width: int = 8) -> DataFrame:
    """Mean point error of each group of ``width`` positions."""
    return errors.groupBy(*by, F.floor(F.col("j") / width).alias("grp")).agg(F.avg("err").alias("err"))


def overlap_runs(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Leading (q1) and trailing (q2) runs of groups over the fence of the group means."""
    own = Window.partitionBy(*by)
    over = groups.join(fence(groups, "err", by).select(*by, "delta"), list(by)).withColumn("high", F.col("err") > F.col("delta"))
    ahead = F.max((~F.col("high")).cast("int")).over(own.orderBy("grp"))
    behind = F.max((~F.col("high")).cast("int")).over(own.orderBy(F.desc("grp")))
    runs = over.withColumn("ahead", ahead).withColumn("behind", behind)
    return runs.groupBy(*by).agg(F.count_if(F.col("ahead") == 0).alias("q1"), F.count_if((F.col("behind") == 0) & (F.col("ahead") != 0)).alias("q2"))


def detect_overlaps(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """q1 and q2 grown until no group between them is over the fence, at the end whose next error is larger (tie: the tail).

    A few dozen values per key meet in one task.
    """
    schema = ", ".join(f"{c} {t}" for c, t in groups.dtypes if c in by) + ", q1 long, q2 long"

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        err = pdf.sort_values("grp")["err"].to_numpy()
        low, high = np.percentile(err, [25, 75])
        over = err > high + 1.5 * (high - low)
        q1 = int(np.argmin(over)) if not over.all() else len(over)
        q2 = int(np.argmin(over[::-1][: len(over) - q1])) if q1 < len(over) else 0
        while over[q1 : len(over) - q2].any():
            if err[q1] > err[len(err) - q2 - 1]:
                q1 += 1
            else:
                q2 += 1
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "q1": [q1], "q2": [q2]})

    return groups.groupBy(*by).applyInPandas(grow, schema)


def full_and_middle(errors: DataFrame, by: Sequence[str], k: int, q1: int, q2: int) -> DataFrame:
    """Mean and median over all points and over those off the overlaps, pooled."""
    middle = F.when((F.col("j") >= q1) & (F.col("j") < k - q2), F.col("err"))
    stats = [f(v).alias(n + v) for v in ("_full", "_mid") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    both = with_quantiles(errors, {"_full": F.col("err"), "_mid": middle}, by, (0.5,), stats=stats)
    median = lambda c: F.get(c, F.lit(0)).alias(f"median{c}")
    return both.select(*by, "mean_full", median("_full"), "std_full", "mean_mid", median("_mid"), "std_mid")


def masked_huber(rows: DataFrame, delta: float, weight: Column) -> DataFrame:
    """Loss whose weight scales the error before Huber; means over all points."""
    e = weight * F.col("err")
    return rows.agg(F.avg(huber(e, F.lit(delta))).alias("loss"), F.avg(e).alias("mean_error"))


def weighted_huber(rows: DataFrame, delta: float, weight: Column) -> DataFrame:
    """Loss whose weight scales the Huber value; divided by the sum of weights."""
    loss = F.sum(weight * huber(F.col("err"), F.lit(delta))) / (F.sum(weight) + 1e-8)
    return rows.agg(loss.alias("loss"), F.avg("err").alias("mean_error"))


def mean_of_batches(rows: DataFrame, batch: str, values: Sequence[str]) -> DataFrame:
    """Means of per-batch means."""
    inner = rows.groupBy(batch).agg(*[F.avg(v).alias(v) for v in values])
    return inner.agg(*[F.avg(v).alias(v) for v in values])


def group_matrix(groups: DataFrame, by: Sequence[str], n_groups: int) -> DataFrame:
    """Checkpoints by groups: one column for each group."""
    return groups.groupBy(*by).pivot("grp", list(range(n_groups))).agg(F.first("err")).withColumnsRenamed({str(g): f"byte_{g}" for g in range(n_groups)})


def align_tails(truth: DataFrame, estimate: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Pairs aligned from the end: a shorter estimate loses its head."""
    own = Window.partitionBy(*keys).orderBy(F.desc(order))
    left = truth.withColumn("from_end", F.row_number().over(own))
    right = estimate.withColumn("from_end", F.row_number().over(own))
    return left.join(right.drop(order), [*keys, "from_end"])
