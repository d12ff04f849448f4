"""Near-duplicates by bottom-k sketches from one hash function.

1. One pass over the texts hashes every document's distinct five-word shingles; the KEPT smallest hashes are its sketch. Documents of one set collapse to a node, so that exact copies cost one row from here on.
2. Inverted lists hold the nodes under retained values, apart by size, as similar sets are of similar sizes. In a list,
   or a block of bounded size of it, overlaps are counted over all retained values, and where they allow for it the
   similarity is estimated from the bottom of the union of two sketches. What is far below the threshold goes.
3. What is left is chained, and the full sets of a chain's texts are compared exactly, in blocks of bounded size (``similar_links``).
4. Connected components over these links; every document gets its node's.

Values under which very many nodes stand (a passage that a large part of the corpus shares) are hot. A node is listed
under retained values that are not; only nodes that consist of hot values to a quarter or more are listed under
these too, and there only those of over one half (core) are compared with all. A pair of which neither is core differs so
little in the rest that this shares a value itself.

What a pair at the threshold can be missed by: no common value among the first eight of both sketches, 0.15^8 = 3 in
10^7 (nodes with hot values are listed under 24 others: 2 in 10^7 where half of a set is hot), or an estimate below one half,
1 in 10^11.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import connected_components, cut, held, read, split_join, totals
from wayline.llm.simhash_dedup import shingles, similar_links

PERCENT = 85
#: Values that a sketch retains; values of a node that are listed, without and with hot ones among the retained.
KEPT, LISTED, LISTED_HOT = 64, 8, 24
#: Hot values that a node is listed under from a share of MOSTLY_HOT: with what such a pair shares of them, 16 miss 1 in 10^7.
LISTED_MOSTLY, MOSTLY_HOT = 16, 0.8
#: Share of hot values from which a node is listed under hot ones, and beyond which it is compared with all there.
GUEST_SHARE, CORE_SHARE = 0.25, 0.5
#: A value of more nodes than this, and than a 100,000th of all retained ones, is hot: of such there are 100,000 at most.
HOT_NODES, MOST_HOT = 1000, 100_000
#: Least estimate, in percent, of a pair whose sets are compared.
ESTIMATE = 50
#: Width of a class of sizes, as a natural logarithm: a little more than that of 1 / 0.85.
CLASS_WIDTH = 0.163
#: Nodes of a side of a block.
CELL_NODES = 2048
#: Nodes with a possible partner whose keys are broadcast to the texts; joined by shuffle beyond.
MAX_BROADCAST_NODES = 500_000
#: Fills up sketches of small sets.
PAD = np.uint64(2**64 - 1)


def sketched(texts: pd.Series) -> pd.DataFrame:
    """Per text: a 128-bit digest of its set (null for the empty one), the set's size, and its sketch as signed hashes."""
    node, n, sketch = [], [], []
    for t in texts:
        h = shingles(t)
        node.append(xxhash.xxh3_128_hexdigest(h.tobytes()) if len(h) else None)
        n.append(len(h))
        sketch.append(h[:KEPT].view(np.int64))
    return pd.DataFrame({"digest": node, "n": n, "sketch": sketch})


def bottom_estimates(one: np.ndarray, others: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """Similarity of a sketch to each row of ``others`` by the bottom of their unions; sketches are filled up with PAD.

    Exact where the union is no larger than a sketch.
    """
    both = np.sort(np.concatenate([np.broadcast_to(one, (len(others), len(one))), others], axis=1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != PAD)
    place = np.cumsum(~again & (both != PAD), axis=1)  # of each element among the union's
    return (again & (place <= kept)).sum(axis=1) / np.maximum(1, np.minimum(place[:, -1], kept))


def forest(sketches: np.ndarray, sizes: np.ndarray, core: np.ndarray, percent: int = PERCENT, least: int = ESTIMATE) -> list[tuple[int, int]]:
    """Pairs that connect what all pairs with an estimate of ``least`` percent or more connect; one of a pair is ``core``.

    Overlaps come from the values' inverted lists. A breadth-first walk: what is reached is not compared again.
    """
    m = len(sketches)
    owner, place = np.nonzero(sketches != PAD)
    code = np.unique(sketches[owner, place], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    post, starts = owner[order], np.searchsorted(code[order], np.arange(int(code.max(initial=-1)) + 2))
    first = np.searchsorted(owner, np.arange(m + 1))
    new, out = np.ones(m, bool), []
    for root in range(m):
        if not new[root]:
            continue
        new[root] = False
        queue = [root]
        while queue and new.any():
            i = queue.pop()
            own = code[first[i] : first[i + 1]]
            s, n = starts[own], starts[own + 1] - starts[own]
            index = np.repeat(s - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            overlap = np.bincount(post[index], minlength=m)
            # the union's bottom holds this many values at least, and what is common there stands in both sketches
            bottom = np.minimum(KEPT, np.maximum(sizes[i], sizes))
            fits = 100 * np.minimum(sizes[i], sizes) >= percent * np.maximum(sizes[i], sizes)
            near = np.flatnonzero(new & fits & (core[i] | core) & (100 * overlap >= least * bottom))
            near = near[100 * bottom_estimates(sketches[i], sketches[near]) >= least]
            new[near] = False
            out += [(int(i), int(j)) for j in near]
            queue += near.tolist()
    return out


def _filled(column: pa.ListArray) -> np.ndarray:
    """Sketches as rows, filled up with PAD."""
    size = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.full((len(size), KEPT), PAD, np.uint64)
    out[np.arange(KEPT)[None] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return out


def listed_values(nodes: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, node, n, core): the inverted lists. A key is a value together with a class of sizes; similar sizes share one.

    Under a value that is not hot all nodes are core.
    """
    factor = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, core = [], [], []
            sizes = batch.column("n").to_numpy()
            for i in range(batch.num_rows):
                s = batch.column("sketch")[i].values.to_numpy(zero_copy_only=False)
                is_hot = np.isin(s, hot) if len(hot) else np.zeros(len(s), bool)
                share = is_hot.mean() if len(s) else 0
                plain = s[~is_hot][: LISTED_HOT if share else LISTED]
                common = s[is_hot][: LISTED if share == 1 else LISTED_MOSTLY if share >= MOSTLY_HOT else LISTED_HOT] if share >= GUEST_SHARE else s[:0]
                own = np.concatenate([plain, common]).view(np.uint64)
                kind = math.floor(math.log(sizes[i]) / CLASS_WIDTH)
                keys += [own ^ c for c in np.arange(kind + 1, kind + 3, dtype=np.uint64) * factor]
                core += [np.ones(len(plain), bool), np.full(len(common), share > CORE_SHARE)] * 2
                at.append(2 * len(own))
            where = pa.array(np.repeat(np.arange(batch.num_rows), at))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64()), "node": batch.column("node").take(where),
                "n": batch.column("n").take(where), "core": pa.array(np.concatenate(core) if core else [], pa.bool_()),
            })

    return nodes.select("node", "n", "sketch").mapInArrow(run, "key long, node long, n long, core boolean")


def hot_values(nodes: DataFrame) -> np.ndarray:
    """Retained values of very many nodes; by the rule they are MOST_HOT at most."""
    counts = nodes.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count("*").alias("m"))
    total = totals(nodes, F.sum(F.size("sketch")))[0] or 0
    found = counts.where(F.col("m") > max(HOT_NODES, total // MOST_HOT)).select("value").toArrow()
    return np.sort(found.column("value").to_numpy())


def _labelled(links: DataFrame) -> tuple[DataFrame, int]:
    """(node, component), the smallest node that links reach, and the number of rows; nodes without links are left out."""
    both = F.array(F.struct("node", F.col("root").alias("component")), F.struct(F.col("root").alias("node"), F.col("root").alias("component")))
    label = cut(connected_components(links).select(F.explode(both).alias("e")).select("e.node", "e.component").distinct())
    return label, totals(label, F.count("*"))[0]


def links_of(nodes: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that connect what all pairs of nodes (node, n, sketch, key) of ``percent`` or more connect.

    ``texts`` (key, text) holds a node's text under its key, once or more.
    """
    lists = cut(listed_values(nodes, hot_values(nodes)))
    sizes = lists.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("_low"), F.bit_xor(F.xxhash64("node", "core")).alias("_all")).where("m > 1")
    # lists of the same nodes say the same: one of them is enough
    sizes = sizes.groupBy("m", "_low", "_all").agg(F.min("key").alias("key")).select("key", "m", F.ceil(F.col("m") / CELL_NODES).cast("int").alias("parts"))
    met = split_join(lists, sizes, ["key"], "m", narrow=True).select("key", "node", "n", "core", "parts")
    rows = met.join(nodes.select("node", "sketch"), "node")  # a node stands in some dozens of lists at most
    part = F.pmod(F.xxhash64("node"), "parts").cast("int")
    # a node stands in every cell (i, j), i <= j, of its list that its part is a side of
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, part).alias("i"), F.greatest(o, part).alias("j")))
    cells = rows.select("key", "node", "n", "core", "sketch", F.explode(others).alias("at")).select("key", "node", "n", "core", "sketch", "at.i", "at.j")

    def run(table: pa.Table) -> pa.Table:
        node, sketch = table.column("node").combine_chunks(), table.column("sketch").combine_chunks()
        found = forest(_filled(sketch), table.column("n").to_numpy(), table.column("core").to_numpy(), percent)
        a, b = (node.take(pa.array([p[s] for p in found], pa.int64())) for s in (0, 1))
        return pa.table({"a": a, "b": b})

    found = cells.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")
    near = cut(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    label, n = _labelled(near)
    chained = cut(nodes.select("node", "key").join(held(label, n), "node").select(F.col("node").alias("doc_id"), "key", F.col("component").alias("root")))
    wanted = F.broadcast(chained) if n <= MAX_BROADCAST_NODES else chained
    candidates = texts.join(wanted, "key").dropDuplicates(["doc_id"]).drop("key")
    return cut(similar_links(candidates, near.groupBy("a").agg(F.min("b").alias("leader")), percent))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept.

    Null and empty texts, and texts without a word, have an empty set and are linked with nothing; texts of fewer than five
    words have one shingle. Equal sets are linked whatever their texts. Rows that repeat a doc_id are documents of their
    own; a null doc_id stays null, is never the smallest one where there is another, and is kept if its component has no other.
    Texts of any length are taken whole; other columns are ignored; an empty table gives an empty result.
    """
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = sketched(b["text"])
            out.insert(0, "doc_id", b["doc_id"].array)
            out.insert(1, "key", b["key"].array)
            yield out

    rows = cut(text.mapInPandas(run, f"doc_id {doc_id}, key string, digest string, n long, sketch array<long>"))
    sets = rows.where("digest is not null")
    nodes = sets.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"), F.max("n").alias("n"), F.min(F.struct("key", "sketch")).alias("one"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "times", "n", "one.key", "one.sketch"))
    label, n = _labelled(links_of(nodes.select("node", "n", "sketch", "key"), text.select("key", "text"), percent))
    ids = nodes.select("node", "least").join(held(label, n), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = label.join(held(ids, n), "component").select("node", "component_id")
    # only linked nodes need their component's smallest id; all others answer for themselves
    answer = nodes.select("node", "digest", "least", "times").join(held(linked, n), "node", "left").select("digest", F.coalesce("component_id", "least").alias("component_id"), "times")
    full = split_join(sets.select("doc_id", "digest", "n"), answer, ["digest"], "times").select("doc_id", "n", "component_id")
    found = full.unionByName(rows.where("digest is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all documents; its docstring defines every case."""
    return near_duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (select distinct doc_id, array_to_string(words[i:i + 4], ' ') as shingle from (select doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by all) p
  join n u on u.doc_id = a join n v on v.doc_id = b where 100 * common >= 85 * (u.n + v.n - common)),
e as (select a, b from l union all select b, a from l),
r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on e.a = r.other)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n on n.doc_id = d.doc_id join (select doc_id, min(other) as component_id from r group by doc_id) c on c.doc_id = d.doc_id
"""
