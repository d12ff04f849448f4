"""Filters and data-quality counts over trajectory points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.samples import finite

COORDINATES = ("longitude", "latitude", "longitude_n", "latitude_n")
TRAJECTORY = ("shard", "agent")


def all_finite(columns: Sequence[str]) -> Column:
    out = finite(F.col(columns[0]))
    for c in columns[1:]:
        out = out & finite(F.col(c))
    return out


def valid_fixes(points: DataFrame, columns: Sequence[str] = COORDINATES) -> DataFrame:
    """Points whose coordinates are all present and finite."""
    return points.where(all_finite(columns))


def drop_nan(points: DataFrame, columns: Sequence[str] = ("longitude_n", "latitude_n")) -> DataFrame:
    """Points without a NaN or null coordinate; infinities stay."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c)
    return points.where(keep)


def drop_accounting(points: DataFrame) -> DataFrame:
    """Per trajectory: rows before, valid and dropped."""
    valid = F.count_if(all_finite(COORDINATES))
    return points.groupBy(*TRAJECTORY).agg(F.count("*").alias("n_before"), valid.alias("n_valid"), (F.count("*") - valid).alias("n_dropped"))


def nonfinite_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each column, how many values are not finite."""
    return rows.agg(*[F.coalesce(F.count_if(~finite(F.col(c))), F.lit(0)).alias(f"bad_{c}") for c in columns])


def drop_bad_users(points: DataFrame, columns: Sequence[str] = COORDINATES) -> DataFrame:
    """``points`` without the trajectories of which any coordinate is not finite: the check after a filter, which
    drops the whole user rather than hand on what should not exist."""
    bad = points.where(~all_finite(columns)).select(*TRAJECTORY).distinct()
    return points.join(bad, list(TRAJECTORY), "left_anti")


def require_finite(points: DataFrame, columns: Sequence[str] = COORDINATES) -> DataFrame:
    """``points``, or an error that counts the values that are not finite."""
    counts = nonfinite_counts(points, columns).first().asDict()
    if any(counts.values()):
        raise ValueError(f"values that are not finite: {counts}")
    return points


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without zone, as a double."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("double")
