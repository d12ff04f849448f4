"""Versioned resume state: append-only folders, a manifest written last, snapshot reads, and resumed runs as one operation.

A version's data (the whole records of the datasets it changes, and the chunks that its run gave) are written to new
folders first; then its manifest is created under the version's number, which fails if another writer has taken it. A
folder without a manifest does not exist for a reader, so a run that dies anywhere before leaves the version before it.
A snapshot takes each dataset's record from the newest version that holds it, back to the last whole version (``base``).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import chunk
from wayline.operators.clean import TRAJECTORY

STATE = "shard long, agent long, end_row long"
CHUNKS = "shard long, agent long, row_start long, row_end long"
MANIFEST = "version long, base long, state string, chunks string"
#: Versions after which a snapshot is written whole again, so that a read touches so many folders at most.
WHOLE_EVERY = 16


class VersionTaken(RuntimeError):
    """Another writer has committed the version; read again and retry."""


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A new file, by the store that ``path`` names; ``VersionTaken`` if it exists."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    # written aside and renamed, so that a manifest is there whole or not at all; a store that renames over a file is asked first
    aside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(where) or not fs.rename(aside, where):
        fs.delete(aside, False)
        raise VersionTaken(path)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(version, base, state, chunks): the committed versions; none for a root that does not exist yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").json(f"{root}/manifests")


def newest(spark: SparkSession, root: str) -> int:
    """The newest committed version, 0 before the first."""
    return manifests(spark, root).agg(F.max("version")).first()[0] or 0


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """State (shard, agent, end_row) as of ``version``, the newest one if none is named; empty before the first."""
    known = manifests(spark, root)
    known = known if version is None else known.where(F.col("version") <= version)
    last = known.orderBy(F.desc("version")).first()
    if last is None:
        return spark.createDataFrame([], STATE)
    # WHOLE_EVERY rows at most
    read = known.where((F.col("version") >= last.base) & (F.col("version") <= last.version)).select("version", "state").collect()
    rows = [spark.read.schema(STATE).parquet(f"{root}/{r.state}").withColumn("version", F.lit(r.version)) for r in read]
    rows = _union(rows)
    held = rows.groupBy("shard").agg(F.max("version").alias("version"))  # a row for each dataset
    return rows.join(held, ["shard", "version"]).select("shard", "agent", "end_row")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def merged_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """The whole records of the datasets in ``new``: the larger end row of each trajectory, old ones kept; other datasets are not in it."""
    changed = new.select("shard").distinct()
    return chunk.merge_state(old.join(changed, "shard", "left_semi"), new.select("shard", "agent", "end_row"))


def commit(spark: SparkSession, root: str, state: DataFrame, after: int, chunks: DataFrame | None = None) -> int:
    """Merges ``state`` into version ``after`` as the next version, together with the ``chunks`` of its run.

    ``VersionTaken`` if ``after`` is no longer the newest: nothing is visible of this call then, and the caller reads again. Every
    WHOLE_EVERY versions all datasets are written.
    """
    version, name = after + 1, uuid.uuid4().hex
    old = snapshot(spark, root, after)
    whole = (version - 1) % WHOLE_EVERY == 0
    rows = merged_records(old, state) if not whole else chunk.merge_state(old, state.select("shard", "agent", "end_row"))
    folder = f"state/{version:08d}-{name}"
    rows.write.parquet(f"{root}/{folder}")
    made = None
    if chunks is not None:
        made = f"chunks/{version:08d}-{name}"
        chunks.select(*[c.split()[0] for c in CHUNKS.split(", ")]).write.parquet(f"{root}/{made}")
    base = version if whole else manifests(spark, root).where(F.col("version") == after).first().base
    text = json.dumps({"version": version, "base": base, "state": folder, "chunks": made})
    _create(spark, f"{root}/manifests/{version:08d}.json", text)
    return version


def resume(spark: SparkSession, root: str, sizes: DataFrame, k: int, q: int, tries: int = 3) -> int:
    """One resumed run: reads the newest state, dices only what lies beyond it, and commits chunks and merged state at once.

    ``sizes`` holds (shard, agent, n). Datasets without new chunks keep their records, and a run without any chunk makes no
    version. If another run commits first, this one starts over from its state. Returns the newest version.
    """
    for _ in range(tries):
        at = newest(spark, root)
        made = chunk.dice(sizes, k, q, snapshot(spark, root, at)).select(*TRAJECTORY, "row_start", "row_end")
        reached = chunk.end_rows(made)
        if reached.isEmpty():
            return at
        try:
            return commit(spark, root, reached, at, made)
        except VersionTaken:
            continue
    raise VersionTaken(f"{root}: other runs committed first {tries} times")


def all_chunks(spark: SparkSession, root: str) -> DataFrame:
    """(shard, agent, row_start, row_end, version): the chunks of all committed runs."""
    parts = [r for r in manifests(spark, root).where("chunks is not null").orderBy("version").collect()]
    frames = [spark.read.schema(CHUNKS).parquet(f"{root}/{r.chunks}").withColumn("version", F.lit(r.version).cast("long")) for r in parts]
    return _union(frames) if frames else spark.createDataFrame([], f"{CHUNKS}, version long")
