"""Helpers shared by the training-data operators: durable cut points and connected components."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition shared by the operators: space and U+0009 to U+000D.
WHITESPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A key with more rows than this, and than a 100,000th of all rows, is hot: of such keys there are 100,000 at most.
HOT_ROWS, MOST_HOT = 1000, 100_000
#: Rows of a few numbers, counted first, that are broadcast; beyond them the same join is shuffled.
FEW_ROWS = 200_000
#: Blocks of the Bloom filter that ``sifted`` broadcasts (rows of two numbers, 32 MB).
SIFT_BLOCKS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, shared by driver and executors.

    Where it is unset, a local session (tests) uses its warehouse folder; a cluster raises, since a folder of
    one machine would lose what other machines wrote.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", "")
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder and read from there; survives lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def gathered(df: DataFrame) -> DataFrame:
    """``df``, of few rows or wanted for totals only, in as many partitions as there are cores rather than shuffle partitions."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def totals(df: DataFrame, *aggregates: Column) -> Row:
    """The aggregates of a table that has been cut."""
    return gathered(df).agg(*aggregates).first()


def held(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have ``rows`` narrow rows at most, broadcast where they are few."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


def split_join(rows: DataFrame, groups: DataFrame, keys: list[str], times: str, narrow: bool = False) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, one row per key with its number of rows in ``times``; hot keys are split.

    Where ``groups`` is ``narrow``, which is to say rows of a few numbers, and has few rows, it is broadcast and ``rows`` stay where they are.

    A hot key's group is repeated once for each part, and its rows are dealt over the parts by their own
    content, so that no task gets more of a key than ``HOT_ROWS`` rows or a 100,000th of all, give or take
    chance. The hot keys are at most ``MOST_HOT`` by that rule and are broadcast. ``groups`` is cut here.
    """
    groups = cut(groups)
    n, total = totals(groups, F.count("*"), F.sum(times))
    if narrow and n <= FEW_ROWS:
        return rows.join(F.broadcast(groups), keys)
    size = max(HOT_ROWS, (total or 0) // MOST_HOT)
    parts = F.ceil(F.col(times) / size).cast("int")
    part, n_parts = free_name(rows, "_part"), free_name(rows, "_parts")
    hot = F.broadcast(groups.where(F.col(times) > size).select(*keys, parts.alias(n_parts)))
    dealt = rows.join(hot, keys, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col(n_parts)), F.lit(0)).cast("int")).drop(n_parts)
    spread = groups.withColumn(part, F.explode(F.sequence(F.lit(0), F.when(F.col(times) > size, parts - 1).otherwise(0))))
    return dealt.join(spread, [*keys, part]).drop(part)


def deal(rows: DataFrame, groups: DataFrame, keys: list[str], part: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a left join of ``rows`` with ``groups`` on ``keys`` and ``part``, with the keys hot in ``rows`` split.

    Rows of a hot key, listed in ``groups`` or not, are dealt over its parts by their own content; its groups, any number
    of them, stand in every part. Rows with a null key are dealt too. The hot keys are at most ``MOST_HOT`` and are broadcast.
    """
    counts = cut(rows.groupBy(*keys).agg(F.count("*").alias(part)))
    size = max(HOT_ROWS, (counts.agg(F.sum(part)).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(counts.where(F.col(part) > size).select(*keys, F.ceil(F.col(part) / size).cast("int").alias(part)))
    unknown = [F.col(k).isNull() for k in keys]
    n_parts = F.coalesce(F.when(reduce(or_, unknown), F.lit(MOST_HOT)).otherwise(F.col(part)), F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn(part, F.pmod(F.xxhash64(*rows.columns), n_parts).cast("int"))
    spread = groups.join(hot, keys, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(part), F.lit(1)) - 1)))
    return dealt, spread


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows: the measured bound asked for before a broadcast hint."""
    return df.limit(max_rows + 1).count() <= max_rows


def sifted(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``rows`` without most of those whose column ``on`` stands nowhere in ``keys``; every other row stays.

    A blocked Bloom filter of plain columns: a key sets two bits of the 64 of its block. The blocks are broadcast, so that
    ``rows`` stay where they are, and a join with more keys than can be broadcast shuffles little more than it returns.
    With k keys to a block, about (1 - exp(-k / 32))^2 of the rows without a key pass, and the caller's join drops those.
    That has to be an inner join: Spark moves a left semi join below this one, where it would shuffle all rows.
    """
    bits, block, word = (free_name(rows, name) for name in ("_bits", "_block", "_word"))
    digest = F.xxhash64(F.lit(3), on)
    bit = lambda low: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(digest, low).bitwiseAND(F.lit(63)).cast("int"))
    marks = F.pmod(digest, F.lit(SIFT_BLOCKS)).alias(block), bit(58).bitwiseOR(bit(52)).alias(bits)
    table = keys.select(*marks).groupBy(block).agg(F.bit_or(bits).alias(word))
    met = rows.select("*", *marks).join(F.broadcast(table), block)
    return met.where(F.col(word).bitwiseAND(F.col(bits)) == F.col(bits)).select(*rows.columns)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Roots of undirected ``edges`` (a, b): rows (node, root) for every node but the roots themselves.

    Alternating large-star and small-star steps: every step re-hangs neighbours on the smallest known
    node with one grouped minimum and one equi-join, so that a round shuffles a multiple of the edges
    and no neighbourhood is ever collected. Once the edges are few, the minima are broadcast and the edges
    lie in few partitions, as a round is otherwise made of empty tasks. The root is the smallest node of
    the component. Loops, repeated edges and nulls are ignored; no edges give an empty result.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        now = tuple(totals(e, F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.max("a")))
        e = gathered(e) if now[0] <= FEW_ROWS else e
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        # every edge leads down, so the smallest neighbour of b is that of its edges (b, ...), or b itself
        low = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = e.join(held(low, now[0]), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(held(low, now[0]), "a").select(F.explode(hung).alias("e")).select("e.a", "e.b")
        e = cut(small.where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
