"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks mark which of the next tokens are hashed and which are ignored. Every token position of a
training text and of a benchmark item is hashed under every mask; equal hashes are hits. Around a hit the
two texts are laid over each other and equal tokens counted, so that substituted tokens do not hide an
overlap. The hashes of a text are made, probed and dropped inside one generated stage: only hits travel.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import cut, fits_broadcast, read

#: An overlap counts if some window of WINDOW aligned tokens (or the whole shorter item) has a share
#: MIN_SHARE of equal ones.
WINDOW, MIN_SHARE = 16, 0.8
# Masks, 1 is hashed, 0 ignored. Each set hits every placement of the substitutions that MIN_SHARE
# allows: three in 16 tokens; three in 15 and two in 10 (so in 11 to 14).
MASKS = ("11010111", "11100010011")
MIDDLE_MASKS, MIDDLE = ("110111", "1101011", "11100101"), 10
#: Benchmark seeds are broadcast up to so many rows (about 64 MB), and joined by shuffle beyond.
MAX_BROADCAST_SEEDS = 2_000_000
#: Hits (three numbers each) that are broadcast to fetch the texts they stand in, and joined by shuffle beyond.
MAX_BROADCAST_HITS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null and empty texts have none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def masks_for(n: int) -> tuple[str, ...]:
    """Masks for an item of ``n`` tokens that miss no placement of the substitutions allowed in it.

    Items of five to nine tokens allow for one: a mask for each place it can take. Shorter ones allow for none.
    """
    if n >= WINDOW:
        return MASKS
    if n >= MIDDLE:
        return MIDDLE_MASKS
    if n >= 5:
        return tuple("1" * i + "0" + "1" * (n - 1 - i) for i in range(n))
    return ("1" * n,)


def _hash(mask: str, words: str = "words") -> Column:
    """Null where the mask reaches beyond the last token."""
    at = F.xxhash64(F.lit(mask), *[F.get(words, F.col("pos") + i) for i, bit in enumerate(mask) if bit == "1"])
    return F.when(F.col("pos") + len(mask) <= F.size(words), at)


def seeds(rows: DataFrame, keep: list[str], masks: list[str]) -> DataFrame:
    """One row per (row of ``rows``, position, mask): ``keep``, pos, seed; ``rows`` has an array ``words``."""
    n, span = F.size("words"), min(map(len, masks))
    positions = F.when(n >= span, F.sequence(F.lit(0), n - span)).otherwise(F.array().cast("array<int>"))
    # outer: the plain form makes the optimiser split the text once more in a filter below
    at = rows.select(*keep, "words", F.explode_outer(positions).alias("pos"))
    return at.select(*keep, "pos", F.explode(F.array(*map(_hash, masks))).alias("seed")).where("seed is not null")


def overlaps(
    docs: DataFrame, benchmark: DataFrame,
    max_broadcast_seeds: int = MAX_BROADCAST_SEEDS, max_broadcast_hits: int = MAX_BROADCAST_HITS,
) -> DataFrame:
    """Verified overlaps: doc_id, item_id, n_equal (equal tokens on the best alignment), n_item, best_window.

    One row per document and item, and none is missed: an alignment of which a window of WINDOW tokens (of an
    item with fewer, all) has MIN_SHARE equal ones is hit by a mask wherever the substitutions stand, at texts'
    ends too. Null and empty texts and items overlap nothing; rows with a null id are left out; repeated rows of
    an id count as one text each and give one row; ties of alignments give the same numbers; texts of any
    length are compared whole; other columns are ignored; an empty table gives an empty result.
    """
    words = tokens(F.col("text"))
    items = cut(benchmark.where("item_id is not null").select("item_id", words.alias("words")).where(F.size("words") > 0))
    # at most WINDOW rows
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).distinct().collect()]
    if not lengths:
        return items.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "item_id", *[F.lit(0).cast("long").alias(c) for c in ("n_equal", "n_item", "best_window")])
    by_masks: dict[tuple[str, ...], list[int]] = {}
    for n in sorted(lengths):
        by_masks.setdefault(masks_for(n), []).append(n)
    found_in = [seeds(items.where(F.least(F.size("words"), F.lit(WINDOW)).isin(of)), ["item_id"], list(masks)) for masks, of in by_masks.items()]
    item_seeds = functools.reduce(DataFrame.unionByName, found_in).withColumnRenamed("pos", "item_pos").distinct()
    if fits_broadcast(item_seeds, max_broadcast_seeds):
        item_seeds = F.broadcast(item_seeds)
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    found = seeds(texts.select("doc_id", words.alias("words")), ["doc_id"], sorted({m for masks in by_masks for m in masks}))
    hits = cut(
        found.join(item_seeds, "seed")
        .select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    )
    # the documents that were hit are split once more (exploding one array holds its tokens) and laid over the items
    ids = hits.select("doc_id").distinct()
    some, ids = (F.broadcast(hits), F.broadcast(ids)) if fits_broadcast(hits, max_broadcast_hits) else (hits, ids)
    split = texts.join(ids, "doc_id", "left_semi").select("doc_id", F.explode(F.array(words)).alias("words"))
    laid = split.join(some, "doc_id").join(items.withColumnRenamed("words", "item"), "item_id")
    begin = F.greatest(F.lit(0), F.col("shift"))
    end = F.least(F.size("words"), F.col("shift") + F.size("item"))
    equal = F.zip_with(
        F.slice("words", begin + 1, end - begin), F.slice("item", begin - F.col("shift") + 1, end - begin),
        lambda a, b: F.when(a == b, 1).otherwise(0),
    )
    laid = laid.select("doc_id", "item_id", F.size("item").alias("n_item"), F.explode(F.array(equal)).alias("equal"))
    width = F.least(F.lit(WINDOW), F.col("n_item"), F.size("equal"))
    windows = F.transform(
        F.sequence(F.lit(1), F.size("equal") - F.col("width") + 1),
        lambda i: F.aggregate(F.slice("equal", i, F.col("width")), F.lit(0), lambda s, x: s + x),
    )
    scored = laid.withColumn("width", width).select(
        "doc_id", "item_id", F.col("n_item").cast("long"), F.least(F.lit(WINDOW), F.col("n_item")).alias("need"),
        F.aggregate("equal", F.lit(0), lambda s, x: s + x).cast("long").alias("n_equal"),
        F.array_max(windows).cast("long").alias("best_window"),
    )
    return (
        scored.where(F.col("best_window") >= F.lit(MIN_SHARE) * F.col("need"))
        .groupBy("doc_id", "item_id").agg(F.max("n_equal").alias("n_equal"), F.max("n_item").alias("n_item"), F.max("best_window").alias("best_window"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap an item; rows with a null doc_id stay. Other cases are those of ``overlaps``."""
    return docs.join(overlaps(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``overlaps`` of all documents with all items; its docstring defines every case."""
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# Candidates here are all alignments with a run of equal tokens that the allowed substitutions cannot break up: the
# twin knows no masks, so that equal rows show that the masks miss nothing.
_WORDS = "list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
SQL = f"""
with d as (select doc_id, {_WORDS} as words from documents),
b as (select *, case when n >= {WINDOW} then 4 when n >= {MIDDLE} then 3 when n >= 5 then 2 else n end as run
  from (select *, len(words) as n from (select item_id, {_WORDS} as words from benchmark)) where n > 0),
dg as (select doc_id, run, p, array_to_string(words[p + 1:p + run], ' ') as gram from (select doc_id, words, run, unnest(range(0, len(words) - run + 1)) as p
  from d, (select distinct run from b) where len(words) >= run)),
bg as (select item_id, run, q, array_to_string(words[q + 1:q + run], ' ') as gram from (select item_id, words, run, unnest(range(0, n - run + 1)) as q from b)),
hits as (select distinct doc_id, item_id, p - q as shift from dg join bg using (run, gram)),
places as (select doc_id, item_id, b.n as n_item, d.words as dw, b.words as bw,
    unnest(range(greatest(0, shift), least(len(d.words), shift + len(b.words)))) as p, shift
  from hits join d using (doc_id) join b using (item_id)),
equal as (select doc_id, item_id, shift, n_item, p, case when dw[p + 1] = bw[p - shift + 1] then 1 else 0 end as e from places),
rolled as (select doc_id, item_id, shift, n_item, e,
    sum(e) over (partition by doc_id, item_id, shift order by p rows between least({WINDOW}, n_item) - 1 preceding and current row) as w from equal),
best as (select doc_id, item_id, shift, n_item, sum(e) as n_equal, max(w) as best_window from rolled group by all)
select doc_id, item_id, cast(max(n_equal) as bigint) as n_equal, cast(max(n_item) as bigint) as n_item,
  cast(max(best_window) as bigint) as best_window
from best where best_window >= {MIN_SHARE} * least({WINDOW}, n_item) group by doc_id, item_id
"""
