"""Hard negatives by Kronecker-packed products: exact integer inner products of anchors with all rows, several rows a word.

1. Vectors become whole numbers, floor(256 x), and are dealt over blocks of bounded size by a hash of their id.
2. A block's components are biased to be non-negative and several rows are packed into separated fields of one
   64-bit word; fields are as wide as the block and the anchors ask for. A word is multiplied once for each anchor
   component, and the sums, biased so that no field borrows from the next one, are unpacked into exact scores. Where
   a field would not fit a word, the words are integers of any length.
3. Blocks of an anchor's label give its positives; blocks of all rows then give, for each anchor and positive, the rows of
   other labels in the positive's band. A block returns its first few; Spark ranks these.

Anchors meet the blocks by an equi-join on the number of their group; groups are broadcast where they are few, else both
sides are dealt over parts, so that no task holds more than its blocks and groups one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.llm.common import cut, fits_broadcast, read

#: Rows of a block and of a group of anchors, on average; hashes of ids deal them.
BLOCK_ROWS, GROUP_ANCHORS = 4096, 512
#: Groups of anchors (about a quarter of a megabyte each at 64 components) that are broadcast; dealt over parts beyond.
MAX_BROADCAST_GROUPS = 32
#: Blocks of one label or group that meet in a task.
TASK_BLOCKS = 8
SCALE = 256
#: Positives of an anchor and negatives of a positive; a negative's score is at least this share of the positive's.
POSITIVES, NEGATIVES, SHARE = 5, 5, (4, 5)
LONG = 2**63


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, as int64; object where these don't suffice.

    Both come as doubles, as the vectors' components do; an object result holds integers of any length.
    """
    n, d = rows.shape
    if not (len(anchors) and n and d):
        return np.zeros((len(anchors), n), np.int64)
    wide = max(np.abs(anchors).max(), np.abs(rows).max()) >= 2**52
    whole = np.vectorize(int, otypes=[object]) if wide else (lambda x: x.astype(np.int64))
    a, c = whole(anchors), whole(rows)
    low = c.min()
    c = c - low
    # |sum of products| < 2^(width - 1), so a field of ``width`` bits holds it once biased
    most = max(int(sum(abs(int(x)) for x in r)) for r in a) if wide else int(np.abs(a).sum(axis=1).max())
    width = (most * int(c.max())).bit_length() + 1
    fields = min(64 // width, n) if not wide else 0
    if fields and (most * max(abs(int(low)), 1)).bit_length() < 62:
        word, kind = np.uint64, lambda x: np.array([x], np.uint64)
        base = a.sum(axis=1)[:, None] * low
        a, c = a.astype(np.uint64), c.astype(np.uint64)
    else:
        fields, word, kind = min(8, n), object, lambda x: np.array([x], object)
        a, c, low = a.astype(object), c.astype(object), int(low)
        base = a.sum(axis=1)[:, None] * low
    words = np.zeros(((n + fields - 1) // fields, d), word)
    for f in range(fields):
        part = c[f::fields]
        words[: len(part)] += part << kind(width * f) if word is np.uint64 else part * (1 << width * f)
    total = a @ words.T  # 64-bit words wrap around; the bias undoes the borrows
    total = total + kind(sum(1 << (width * f + width - 1) for f in range(fields)))
    out = np.empty((len(a), n), np.int64 if word is np.uint64 else object)
    for f in range(fields):
        field = (total >> kind(width * f)) & kind((1 << width) - 1)
        field = field.astype(out.dtype) - (1 << (width - 1))
        out[:, f::fields] = field[:, : len(range(f, n, fields))]
    return out + base


def _clipped(scores: np.ndarray) -> np.ndarray:
    """Scores beyond a long are its limits; they rank and are returned so."""
    return scores if scores.dtype != object else np.minimum(np.maximum(scores, -LONG), LONG - 1).astype(np.int64)


def _first(at: np.ndarray, score: np.ndarray, row_id: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` entries of each value of ``at`` by falling score, then rising id."""
    order = np.lexsort((row_id, ~score, at))  # ~ turns the order of all longs around without overflow
    own = at[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
    return order[rank < n]


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """The vectors as rows; shorter ones are filled with zeros."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = flat
    return out


def _side(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]:
    held = column.flatten()
    return held.field("vec_id").to_numpy(), held.field("label").to_numpy(), _matrix(held.field("v")), held


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = min(a.shape[1], b.shape[1])
    return a[:, :d], b[:, :d]


def positives_of(anchor_ids: np.ndarray, anchors: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the first ``n`` rows of each anchor but itself."""
    scores = _clipped(packed_scores(*_aligned(anchors, rows)))
    own = anchor_ids[:, None] == ids[None]
    if len(ids) > n + 1:  # the (n + 1)-th score, as the anchor may be among the rows
        least = np.partition(scores, len(ids) - n - 1, axis=1)[:, len(ids) - n - 1]
        a, r = np.nonzero((scores >= least[:, None]) & ~own)
    else:
        a, r = np.nonzero(~own)
    s = scores[a, r]
    first = _first(a, s, ids[r], n)
    return anchor_ids[a[first]], ids[r[first]], s[first]


def negatives_of(anchors: np.ndarray, labels: np.ndarray, wanted: list[list[int]], ids: np.ndarray, row_labels: np.ndarray, rows: np.ndarray, n: int, share: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """(anchor's place, positive's place, row, score): the first ``n`` rows of another label in each positive's band."""
    scores = _clipped(packed_scores(*_aligned(anchors, rows)))
    low = [[-(-share[0] * p // share[1]) for p in own] for own in wanted]
    far = LONG - 1
    least = np.array([min(x, default=far) for x in low], np.int64)
    a, r = np.nonzero((scores >= least[:, None]) & (labels[:, None] != row_labels[None]))
    s = scores[a, r]
    order = np.lexsort((ids[r], ~s, a))
    a, r, s = a[order], r[order], s[order]
    out = []
    for i in np.unique(a):
        at, stop = np.searchsorted(a, [i, i + 1])
        falling = ~s[at:stop]  # ascending
        for j, p in enumerate(wanted[i]):
            first, last = at + np.searchsorted(falling, ~np.int64(p)), at + np.searchsorted(falling, ~np.int64(max(low[i][j], -LONG)), "right")
            out += [(int(i), j, int(ids[r[k]]), int(s[k])) for k in range(first, min(last, first + n))]
    return out


def vectors(embeddings: DataFrame, relabel: int | None = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v): ids and labels as longs and whole components, as doubles, of the rows that take part.

    A null id, label, vector or component, one that is not finite, or one that is not once it is scaled, leaves a row out. Of rows
    with one id the one with the smallest (label, vector) stays. An id divisible by ``relabel`` moves its label on by one.
    """
    x = F.transform("embedding", lambda c: c.cast("double") * float(SCALE))
    label = F.col("label").cast("long")
    if relabel:
        label = F.when(F.col("vec_id") % relabel == 0, (label + 1) % labels).otherwise(label)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("x", lambda c: c - F.pmod(c, F.lit(1.0)))
    rows = rows.where("vec_id is not null and label is not null and x is not null").where(good).select("vec_id", "label", whole.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _held(rows: DataFrame, keys: list[str], name: str, *more: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("vec_id", "label", "v", *more)).alias(name))


def _met(blocks: DataFrame, groups: DataFrame, key: str, n_groups: int) -> DataFrame:
    """Every block beside every group of its ``key``; the blocks of a key are dealt over parts of TASK_BLOCKS."""
    if n_groups <= MAX_BROADCAST_GROUPS:
        return blocks.join(F.broadcast(groups), key)
    counts = blocks.groupBy(key).agg(F.ceil(F.count("*") / TASK_BLOCKS).cast("int").alias("_parts"))
    left = blocks.join(counts, key).withColumn("_part", F.pmod(F.col("block"), F.col("_parts")).cast("int")).drop("_parts")
    right = groups.join(counts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return left.join(right, [key, "_part"])


def _table(columns: dict[str, np.ndarray | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(np.asarray(v, np.int64)) for k, v in columns.items()})


def positives(rows: DataFrame, anchors: DataFrame, n: int = POSITIVES) -> DataFrame:
    """(anchor_id, positive_id, score): the first ``n`` other rows of each anchor's label by score, ties by id."""
    sizes = cut(rows.groupBy("label").agg(F.count("*").alias("n")).join(anchors.groupBy("label").agg(F.count("*").alias("m")), "label"))
    numbers = sizes.select("label", F.ceil(F.col("n") / BLOCK_ROWS).alias("b"), F.ceil(F.col("m") / GROUP_ANCHORS).alias("g"))
    numbers = F.broadcast(numbers) if fits_broadcast(numbers, 100_000) else numbers
    dealt = lambda df, c: df.join(numbers, "label").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col(c)))
    blocks = _held(dealt(rows, "b").withColumn("own", F.col("label")), ["own", "block"], "rows")
    groups = _held(dealt(anchors, "g").withColumn("own", F.col("label")), ["own", "block"], "anchors").drop("block")
    n_groups = sizes.agg(F.sum(F.ceil(F.col("m") / GROUP_ANCHORS))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, _, v, _ = _side(batch.column("rows").slice(i, 1))
                anchor_ids, _, a, _ = _side(batch.column("anchors").slice(i, 1))
                x, y, s = positives_of(anchor_ids, a, ids, v, n)
                yield _table({"anchor_id": x, "positive_id": y, "score": s})

    met = _met(blocks, groups, "own", n_groups).select("rows", "anchors")
    found = met.mapInArrow(run, "anchor_id long, positive_id long, score long")
    own = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    return found.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= n).drop("_r")


def negatives(rows: DataFrame, anchors: DataFrame, found: DataFrame, n: int = NEGATIVES, share: tuple[int, int] = SHARE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the positives ``found``."""
    own = found.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("found"))
    asked = anchors.join(own.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    n_rows, n_anchors = rows.count(), asked.count()
    n_blocks, n_groups = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_anchors // GROUP_ANCHORS))
    deal = lambda df, m: df.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(m)))
    blocks = _held(deal(rows, n_blocks), ["block"], "rows").withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
    groups = _held(deal(asked, n_groups).withColumnRenamed("block", "number"), ["number"], "anchors", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, v, _ = _side(batch.column("rows").slice(i, 1))
                anchor_ids, own_labels, a, held = _side(batch.column("anchors").slice(i, 1))
                positive = held.field("found").to_pylist()
                wanted = [[p["score"] for p in own] for own in positive]
                out = negatives_of(a, own_labels, wanted, ids, labels, v, n, share)
                yield _table({
                    "anchor_id": [anchor_ids[k] for k, *_ in out], "positive_id": [positive[k][j]["positive_id"] for k, j, *_ in out],
                    "positive_score": [wanted[k][j] for k, j, *_ in out], "negative_id": [x[2] for x in out], "negative_score": [x[3] for x in out],
                })

    met = _met(blocks, groups, "number", n_groups).select("rows", "anchors")
    met = met.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(embeddings: DataFrame, every: int = 100, relabel: int | None = 7) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by ``every``: their first positives, and for each of these the
    first rows of other labels that score from four fifths of the positive's score up to it.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part; of rows with one id
    one stays (``vectors``). Ties of scores go to the smaller id. Of vectors of different lengths the common
    components count; an empty vector scores zero with all. Scores beyond a long are its limits. Anchors without positives,
    and positives without negatives in their band, give no rows; other columns are ignored; an empty table gives none.
    """
    rows = cut(vectors(embeddings, relabel))
    anchors = rows.where(F.col("vec_id") % every == 0)
    found = cut(positives(rows, anchors))
    return negatives(rows, anchors, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mine`` of all embeddings; its docstring defines every case."""
    return mine(read(spark, sf_dir, "embeddings"))


SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as row_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, row_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, row_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over w as integer) as rank, row_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, row_id)
qualify row_number() over w <= 5
"""
