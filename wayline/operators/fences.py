"""Outlier fences kept as one sketch for each shard, so that the fence after new shards reads no old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size parameter of the sketches: about 60 KB a shard, whatever its rows.
K = 4096
#: Bound of a quantile's error in rank, as a share of the rows, at 99 % confidence; merging keeps it.
RANK_ERROR = 2.296 / K**0.9723
SKETCHES = "sketch binary, n long, low double, high double"


def _shards(spark: SparkSession, path: str, shard: str) -> set[str]:
    """Names of the folders ``shard=...`` under ``path`` that hold a data file; none for a path that does not exist."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(f"{path}/{shard}=*/part-*")
    found = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(files)
    return {f.getPath().getParent().getName() for f in found or []}


def append_sketches(spark: SparkSession, samples: str, path: str, value: Column, shard: str = "shard") -> int:
    """Sketches the shards of ``samples`` that ``path`` has none of, and returns their number.

    ``samples`` is a parquet table with a folder for each shard, which is complete once it is there; only new shards are
    opened. A sketch is one row in one file, so a run that dies leaves whole sketches or none, and the next one makes the rest.
    Null and non-finite values are left out; a shard of nothing else has a sketch without values; repeated rows and ties count.
    """
    new = sorted(_shards(spark, samples, shard) - _shards(spark, path, shard))
    if not new:
        return 0
    rows = spark.read.option("basePath", samples).parquet(*[f"{samples}/{name}" for name in new])
    v = value.cast("double")
    rows = rows.select(F.col(shard), F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("_v"))
    made = rows.groupBy(shard).agg(
        F.kll_sketch_agg_double("_v", F.lit(K)).alias("sketch"), F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")
    )
    made.repartition(shard).write.mode("append").partitionBy(shard).parquet(path)
    return len(new)


def sketched_fence(spark: SparkSession, path: str, shard: str = "shard") -> DataFrame:
    """One row: delta, q1, q3, iqr as ``metrics.fence`` defines them, n, low and high, from the sketches under ``path`` alone.

    Quartiles are values that occur, within RANK_ERROR of their ranks. Without sketches or values: 1, 0, 1, 1, n = 0 and nulls.
    """
    kept = spark.read.parquet(path) if _shards(spark, path, shard) else spark.createDataFrame([], SKETCHES)
    whole = kept.where("n > 0").agg(
        F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    at = lambda p, none: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).otherwise(none)
    q = whole.select(at(0.25, 0.0).alias("q1"), at(0.75, 1.0).alias("q3"), "n", "low", "high")
    iqr = F.col("q3") - F.col("q1")
    return q.select(F.when(F.col("n") > 0, F.col("q3") + 1.5 * iqr).otherwise(1.0).alias("delta"), "q1", "q3", iqr.alias("iqr"), "n", "low", "high")
