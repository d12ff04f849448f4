"""Sources and sinks: trajectory shards, head extracts, sample packs, resume state and metric logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.operators.clean import COORDINATES, all_finite

#: Declared, not inferred: a corrupt shard must not break the read.
POINTS = T.StructType([
    T.StructField("agent", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("event_id", T.LongType()),
    T.StructField("modality", T.StringType()), T.StructField("longitude", T.DoubleType()), T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude_n", T.DoubleType()), T.StructField("latitude_n", T.DoubleType()),
])
TRAIN_LOG = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("ckpt_name", T.StringType()), T.StructField("epoch", T.LongType()),
    T.StructField("step", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("avg_loss", "acc_mean", "acc_median", "acc_std", "lr", "huber_loss_delta")],
])

#: One row per audited checkpoint or model: statistics and the mean error of each group of positions.
AUDIT_LOG = T.StructType([
    T.StructField("model", T.LongType()), T.StructField("ckpt", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("mean", "median", "std", *(f"byte_{g}" for g in range(8)))],
])
#: One row per benchmark run of a model: steps, groups cut at both ends, errors over all points and off the overlaps.
BENCHMARK_LOG = T.StructType([
    T.StructField("model", T.LongType()), T.StructField("q1", T.LongType()), T.StructField("q2", T.LongType()),
    *[T.StructField(f"{s}_{w}", T.DoubleType()) for w in ("full", "mid") for s in ("mean", "median", "std")],
])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, or, in a local session, in its warehouse.

    A cluster without that setting raises: a folder of one machine would hide what others wrote.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/wayline-{name}-{uuid.uuid4().hex}"


def points_from_events(events: DataFrame) -> DataFrame:
    """Trajectory points derived from the ``events`` table: a clean and a noisy fix each, some missing."""
    lon = F.lit(-118.25) + ((F.col("event_id") * 7919) % 10007) / 1000000.0
    lat = F.lit(34.05) + ((F.col("event_id") * 6101) % 10009) / 1000000.0
    return events.select(
        F.col("user_id").alias("agent"), "ts", "event_id", (F.col("user_id") % 32).alias("shard"), F.col("event_type").alias("modality"),
        lon.alias("longitude"), lat.alias("latitude"),
        F.when(F.col("event_id") % 97 != 0, lon + (((F.col("event_id") * 31) % 201) - 100) / 1000000.0).alias("longitude_n"),
        F.when(F.col("event_id") % 89 == 0, F.lit(float("nan"))).otherwise(lat + (((F.col("event_id") * 37) % 201) - 100) / 1000000.0).alias("latitude_n"),
    )


def log_from_events(events: DataFrame) -> DataFrame:
    """A training log derived from ``events``: one run per event type, one checkpoint per event."""
    e = F.col("event_id")
    epoch = F.floor(e / 1000) + 1
    return events.select(
        F.col("event_type").alias("model"),
        F.concat(F.lit("ckpt_e"), epoch.cast("string"), F.lit("_s"), e.cast("string"), F.lit(".safetensors")).alias("ckpt_name"),
        epoch.alias("epoch"), e.alias("step"), F.col("value").alias("avg_loss"), (F.col("value") * 0.5).alias("acc_mean"),
        (F.col("value") * 0.4 + e % 7).alias("acc_median"), (F.col("value") * 0.1).alias("acc_std"),
        F.lit(0.0001).alias("lr"), F.lit(37.5).alias("huber_loss_delta"),
    )


def errors_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """Point errors derived from ``embeddings``: (model, ckpt, sample, j, err)."""
    return embeddings.select(
        (F.col("label") % 5).cast("long").alias("model"), (F.col("vec_id") % 7).alias("ckpt"), F.col("vec_id").alias("sample"),
        F.posexplode("embedding").alias("j", "x"),
    ).select("model", "ckpt", "sample", "j", F.abs(F.col("x").cast("double")).alias("err"))


def write_shards(points: DataFrame, path: str) -> None:
    """One folder per shard, so that a shard's name survives in its files' paths."""
    points.repartition("shard").write.partitionBy("shard").parquet(path)


def scan_shards(spark: SparkSession, path: str) -> DataFrame:
    """All points under ``path`` with ``ds_name``, the shard folder; unreadable files yield no rows."""
    rows = spark.read.schema(POINTS).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").parquet(path)
    return rows.withColumn("ds_name", F.regexp_extract(F.col("_metadata.file_path"), r"/(shard=[^/]+)/[^/]*$", 1))


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """(ds_name, file): the files under ``path`` that yield no row, whether other files of their shard do or not."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    listed = files.select("path", F.regexp_extract("path", r"/(shard=[^/]+)/([^/]*)$", 1).alias("ds_name"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))
    read = scan_shards(spark, path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1).alias("file"), "ds_name").distinct()
    return listed.join(read, ["ds_name", "file"], "left_anti").select("ds_name", "file")


def shard_report(spark: SparkSession, path: str, k: int, state: DataFrame) -> DataFrame:
    """(ds_name, n_rows, n_bad_files, status): every shard folder that has a file. ``n_bad_files`` yielded no row; the status is ``unreadable``
    if none did, ``damaged`` if some did, ``no_chunks`` if no trajectory has more than ``k`` valid points and ``state`` (ds_name)
    has no entry of it."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
        .select(F.regexp_extract("path", r"/(shard=[^/]+)/[^/]*$", 1).alias("ds_name")).distinct()
    )
    bad = unreadable_files(spark, path).groupBy("ds_name").agg(F.count("*").alias("_bad"))
    own = scan_shards(spark, path).groupBy("ds_name", "agent").agg(F.count("*").alias("n"), F.count_if(all_finite(COORDINATES)).alias("n_valid"))
    found = own.groupBy("ds_name").agg(F.sum("n").alias("n_rows"), F.max("n_valid").alias("longest"))
    n, n_bad = F.coalesce("n_rows", F.lit(0)), F.coalesce("_bad", F.lit(0))
    known = state.select("ds_name").distinct().withColumn("_known", F.lit(True))
    status = F.when(n == 0, "unreadable").when(n_bad > 0, "damaged").when((F.col("longest") > k) | F.col("_known"), "ok").otherwise("no_chunks")
    joined = listed.join(found, "ds_name", "left").join(bad, "ds_name", "left").join(known, "ds_name", "left")
    return joined.select("ds_name", n.alias("n_rows"), n_bad.alias("n_bad_files"), status.alias("status"))


def head_extract(points: DataFrame, order: list[str], n: int, path: str) -> DataFrame:
    """The first ``n`` rows by ``order``, written as zstd parquet and read again."""
    points.orderBy(*order).limit(n).write.option("compression", "zstd").parquet(path)
    return points.sparkSession.read.parquet(path)


def write_samples(samples: DataFrame, path: str) -> DataFrame:
    """Training samples by split and shard; returns the row count of each part."""
    samples.repartition("split", "shard").write.partitionBy("split", "shard").parquet(path)
    return samples.sparkSession.read.parquet(path).groupBy("split", "shard").agg(F.count("*").alias("n_rows"))


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Sample packs with the running number of their shard."""
    rows = spark.read.parquet(path)
    number = rows.select("split", "shard").distinct()
    from pyspark.sql.window import Window

    # one row per shard is ranked, not one per sample
    ranked = number.withColumn("shard_index", F.dense_rank().over(Window.partitionBy("split").orderBy("shard")) - 1)
    return rows.join(ranked, ["split", "shard"])


def write_state(state: DataFrame, path: str) -> None:
    """Resume state (ds_name, agent, end_row) as JSON lines, one record and one map per dataset."""
    users = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("agent").cast("string"), "end_row"))))
    state.groupBy("ds_name").agg(users.alias("users")).write.json(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("ds_name string, users map<string,bigint>").json(path)
    return rows.select("ds_name", F.explode("users").alias("agent", "end_row")).withColumn("agent", F.col("agent").cast("long"))


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").option("header", "true").csv(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType = TRAIN_LOG) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)
