"""Splits, reproducible samples, disjoint validation sets and batches."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.samples import finite, shuffled_place, uniform
from wayline.sources.trajectories import scratch


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with their 0-based place by ``order`` within ``by`` in ``name``, without a task that holds a key's rows.

    Rows are dealt by ranges and cut there; a place is the number of rows in earlier ranges, counted once per
    range, plus the place within the range. ``order`` has no ties.
    """
    dealt = cut(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n_range"))  # one row per key and range
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n_range").over(earlier), F.lit(0))).drop("_n_range")
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1 + F.col("_before")
    return dealt.join(sizes, [*by, "_range"]).withColumn(name, place).drop("_range", "_before")


def ranked_shards(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """Distinct shards with their 0-based rank by name: a table of shards, not of rows, is ranked."""
    return rows.select(shard).distinct().withColumn("rank", F.dense_rank().over(Window.orderBy(shard)) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))


def split_by_rank(shards: DataFrame, n_train: int = 26, n_val: int = 3) -> DataFrame:
    return shards.withColumn("split", F.when(F.col("rank") < n_train, "train").when(F.col("rank") < n_train + n_val, "val").otherwise("test"))


def split_by_share(shards: DataFrame, train: int = 70, val: int = 15) -> DataFrame:
    """ceil(train %), ceil(val %), the rest; no shard is skipped at a boundary."""
    a = F.ceil(F.col("n") * train / 100)
    b = a + F.ceil(F.col("n") * val / 100)
    return shards.withColumn("split", F.when(F.col("rank") < a, "train").when(F.col("rank") < b, "val").otherwise("test"))


def sample_agents(agents: DataFrame, n: int, seed: str) -> DataFrame:
    """At most ``n`` agents per shard, without replacement, the same for a seed."""
    order = Window.partitionBy("shard").orderBy(F.md5(F.concat_ws("/", F.lit(seed), F.col("agent").cast("string"))), "agent")
    return agents.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def first_agents(agents: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("shard").orderBy("agent")
    return agents.withColumn("_r", F.dense_rank().over(own)).where(F.col("_r") <= k).drop("_r")


def valid_sample(points: Column, t: Column) -> Column:
    """All values finite and is_start 0 or 1."""
    good = F.forall(points, lambda p: finite(p["e"]) & finite(p["n"]) & finite(p["ve"]) & finite(p["vn"]) & p["is_start"].isin(0.0, 1.0))
    return good & finite(t)


def first_by_fingerprint(samples: DataFrame, key: str, order: list[str]) -> DataFrame:
    own = Window.partitionBy(key).orderBy(*order)
    return samples.withColumn("_r", F.row_number().over(own)).where(F.col("_r") == 1).drop("_r")


def stored_shards(packs: DataFrame, shard: str) -> list:
    """The sorted values of ``shard``: from the names of the folders where ``packs`` is stored by it, without opening a file."""
    names = [re.search(rf"/{re.escape(shard)}=([^/]*)/[^/]*$", f) for f in packs.inputFiles()]
    if not names or not all(names):
        return sorted(r[0] for r in packs.where(F.col(shard).isNotNull()).select(shard).distinct().collect())
    whole = packs.schema[shard].dataType.typeName() in ("byte", "short", "integer", "long")
    found = {unquote(m[1]) for m in names} - {"__HIVE_DEFAULT_PARTITION__"}
    return sorted(map(int, found) if whole else found)


def first_distinct(packs: DataFrame, shard: str, key: str, order: list[str], n: int, exclude: DataFrame | None = None) -> tuple[DataFrame, list]:
    """The first ``n`` rows of distinct ``key`` in order (``shard`` first), and the shards that were read for them.

    ``packs`` is stored by ``shard``. Slices of 1, 2, 4, ... shards are read until the rows suffice, each shard once; a slice's
    rows of keys seen before, or in ``exclude`` (key), go; so do rows without a shard. What lies behind the n-th row is never read, and what is found is exact.
    """
    shards = stored_shards(packs, shard)
    found, at, size, have = None, 0, 1, 0
    while at < len(shards) and have < n:
        own = first_by_fingerprint(packs.where(F.col(shard).isin(shards[at : at + size])), key, order)
        for seen in (found, exclude):
            own = own if seen is None else own.join(seen.select(key), key, "left_anti").select(own.columns)
        own = cut(own.orderBy(*order).limit(n - have))
        at, size, have = at + size, 2 * size, have + own.count()
        found = own if found is None else found.unionByName(own)
    return (packs.where("false") if found is None else found), shards[:at]


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` as a table written to the checkpoint folder: computed once, where a checkpoint computes its last stage twice, and
    read by column."""
    path = scratch(rows.sparkSession, "cut")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small_set(packs: DataFrame, shard: str, key: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` distinct samples in order."""
    return first_distinct(packs, shard, key, order, n)[0]


def big_set(packs: DataFrame, small: DataFrame, shard: str, key: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` distinct samples that are not in the small set."""
    return first_distinct(packs, shard, key, order, n, small)[0]


def require(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, or an error if there are not ``n``; rows are counted, so they are best stored before."""
    found = rows.count()
    if found < n:
        raise ValueError(f"{found} samples, {n} wanted")
    return rows


def epoch_batches(samples: DataFrame, epoch: int, shards: int, step: int, most: int, batch: int, passes: int = 1) -> DataFrame:
    """Batches of one epoch: shard ``epoch`` mod ``shards``, trimmed to a multiple of ``step`` and at most ``most`` rows,
    shuffled by a seeded key for each pass, incomplete batches dropped."""
    own = samples.where(F.col("shard") == epoch % shards)
    n = F.count("*")
    sizes = own.groupBy("shard").agg(F.least(F.lit(most), n - n % step).alias("_n"))
    kept = numbered(own, ["shard"], [F.col("sample")], "_r").join(F.broadcast(sizes), "shard")  # one shard
    kept = kept.where(F.col("_r") < F.col("_n")).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    key = F.md5(F.concat_ws("/", F.lit(str(epoch)), F.col("pass").cast("string"), F.col("sample").cast("string")))
    out = numbered(kept, ["shard", "pass"], [key, F.col("sample")], "_place").withColumn("batch", F.floor(F.col("_place") / batch).cast("long"))
    return out.where((F.col("batch") + 1) * batch <= F.col("_n")).drop("_n", "_r", "_place")


def keyed_batches(samples: DataFrame, epoch: int, shards: int, step: int, most: int, batch: int, passes: int = 1) -> DataFrame:
    """As ``epoch_batches``, with the permutation that (epoch, pass) names instead of a sort for each pass: rows are numbered
    once, and each computes its place in every pass by itself."""
    own = samples.where(F.col("shard") == epoch % shards)
    n = F.count("*")
    sizes = own.groupBy("shard").agg(F.least(F.lit(most), n - n % step).cast("long").alias("_n"))
    kept = numbered(own, ["shard"], [F.col("sample")], "_r").join(F.broadcast(sizes), "shard")  # one shard
    kept = kept.where(F.col("_r") < F.col("_n")).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    out = kept.withColumn("batch", F.floor(shuffled_place(F.col("_r"), F.col("_n"), F.lit(epoch), F.col("pass")) / batch).cast("long"))
    return out.where((F.col("batch") + 1) * batch <= F.col("_n")).drop("_n", "_r")


def draws(samples: DataFrame, shards: int, m: int, seed: str) -> DataFrame:
    """``m`` draws with replacement, shards by turns: (draw, shard, sample)."""
    spark = samples.sparkSession
    placed = numbered(samples, ["shard"], [F.col("sample")], "_at")
    sizes = samples.groupBy("shard").agg(F.count("*").alias("_n"))
    wanted = spark.range(m).select(F.col("id").alias("draw"), (F.col("id") % shards).alias("shard")).join(sizes, "shard")
    at = F.floor(uniform(F.lit(seed), F.col("draw")) * F.col("_n")).cast("long")
    return wanted.withColumn("_at", at).join(placed, ["shard", "_at"]).select("draw", "shard", "sample")
