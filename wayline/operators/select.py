"""Choosing checkpoints and reading training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(rows: DataFrame, by: str, order: list[Column], n: int = 1) -> DataFrame:
    own = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= n).drop("_r")


def keep_set(log: DataFrame, n_best: int = 3, n_last: int = 7) -> DataFrame:
    """(model, ckpt_name): the best by mean, the best by median and the last by step."""
    best = [top(log, "model", [F.col("acc_mean"), F.col("step")], n_best), top(log, "model", [F.col("acc_median"), F.col("step")], n_best)]
    chosen = [*best, top(log, "model", [F.desc("step")], n_last)]
    out = chosen[0].select("model", "ckpt_name")
    for c in chosen[1:]:
        out = out.union(c.select("model", "ckpt_name"))
    return out.distinct()


def trim(log: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checkpoints that stay, and those that may be deleted; nothing is deleted here."""
    return log.join(keep, ["model", "ckpt_name"], "left_semi"), log.join(keep, ["model", "ckpt_name"], "left_anti")


def best_by_audit(log: DataFrame) -> DataFrame:
    return top(log, "model", [F.col("acc_mean"), F.col("acc_median"), F.col("acc_std"), F.col("step")])


def best_by_training(log: DataFrame) -> DataFrame:
    return top(log, "model", [F.col("acc_median"), F.col("acc_mean"), F.desc("step")])


def resume_point(log: DataFrame) -> DataFrame:
    """Last row of each run by step."""
    return log.groupBy("model").agg(F.max_by(F.struct("ckpt_name", "epoch", "avg_loss"), "step").alias("last"), F.max("step").alias("step")).select(
        "model", "step", "last.ckpt_name", "last.epoch", "last.avg_loss"
    )


def running_means(log: DataFrame) -> DataFrame:
    own = Window.partitionBy("model", "epoch").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.select("model", "epoch", "step", F.avg("avg_loss").over(own).alias("loss"), F.avg("acc_mean").over(own).alias("error"))


#: Steps, or composed ranges of them, that meet in one row.
FOLD_RANGE = 1000


def _composed(pieces: Column, first: Column) -> Column:
    """The maps x -> clamp(a x + b, lo, hi) of an ordered array, one after the other, as one such map; a is not negative."""
    clamp = lambda v, p: F.least(p["hi"], F.greatest(p["lo"], v))

    def after(f: Column, p: Column) -> Column:
        return F.struct(
            (p["a"] * f["a"]).alias("a"), (p["a"] * f["b"] + p["b"]).alias("b"),
            clamp(p["a"] * f["lo"] + p["b"], p).alias("lo"), clamp(p["a"] * f["hi"] + p["b"], p).alias("hi"),
        )

    return F.aggregate(pieces, first, after)


def delta_schedule(log: DataFrame, first: float = 38.13, floor: float = 15.0, low: float = 20.0, high: float = 80.0, switch: int = 5000, width: int = FOLD_RANGE) -> DataFrame:
    """Clamped exponential mean of the error in step order, fast before ``switch`` steps and slow after: final delta per run.

    A step maps x to clamp(a x + b, low, high). Such maps are closed under composition, so ranges of ``width`` steps are
    composed apart, then ranges of ranges, until a run is one map: no row holds more than ``width`` of them. A step occurs once in a
    run and is not negative; an error that is missing leaves delta as it is, and so does an empty run.
    """
    alpha = F.when(F.col("step") < switch, 0.02).otherwise(0.005)
    number = lambda v: F.lit(float(v))
    known = log.where(F.col("acc_mean").isNotNull() & ~F.isnan("acc_mean"))
    piece = F.struct((1 - alpha).alias("a"), (alpha * F.greatest("acc_mean", number(floor))).alias("b"), number(low).alias("lo"), number(high).alias("hi"))
    rows = known.select("model", F.col("step").alias("at"), piece.alias("f"))
    same = F.struct(number(1).alias("a"), number(0).alias("b"), number("-inf").alias("lo"), number("inf").alias("hi"))
    last = rows.agg(F.max("at")).first()[0] or 0
    while True:
        held = F.transform(F.array_sort(F.collect_list(F.struct("at", "f"))), lambda p: p["f"])
        rows = rows.groupBy("model", F.floor(F.col("at") / width).alias("at")).agg(_composed(held, same).alias("f"))
        last //= width
        if not last:
            break
    delta = F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.col("f.a") * first + F.col("f.b")))
    return log.select("model").distinct().join(rows.select("model", delta.alias("delta")), "model", "left").select("model", F.coalesce("delta", F.lit(first)).alias("delta"))


def next_user(users: DataFrame) -> DataFrame:
    """For each (shard, agent) the next one in order, over shard borders: a window per shard and one over the shards."""
    own = Window.partitionBy("shard").orderBy("agent")
    inside = users.withColumn("next_agent", F.lead("agent").over(own))
    firsts = users.groupBy("shard").agg(F.min("agent").alias("first")).withColumn("next_shard", F.lead("shard").over(Window.orderBy("shard"))).withColumn(
        "next_first", F.lead("first").over(Window.orderBy("shard"))
    )
    joined = inside.join(firsts, "shard")
    here = F.col("next_agent").isNotNull()
    return joined.select(
        "shard", "agent", F.when(here, F.col("shard")).otherwise(F.col("next_shard")).alias("next_shard"),
        F.coalesce("next_agent", "next_first").alias("next_agent"),
    )


def page_after(users: DataFrame, shard: int, agent: int) -> DataFrame:
    """The first (shard, agent) after the given one."""
    after = (F.col("shard") > shard) | ((F.col("shard") == shard) & (F.col("agent") > agent))
    return users.where(after).orderBy("shard", "agent").limit(1)
