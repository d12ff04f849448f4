"""SimHash near-duplicates through a distributed vantage-point tree.

1. One pass over the texts gives a 64-bit fingerprint per document.
2. Equal fingerprints collapse to one node, so groups of copies cost one row from here on.
3. The top of a vantage-point tree, built from a bounded sample of nodes, deals the nodes into shards.
   A node lives in one shard; where it is closer to a ball's boundary than the radius it also visits
   the shards across that boundary as a query, which is what the triangle inequality allows and no more.
4. Every shard runs the same recursion down to small leaves, compares there, and returns a spanning
   forest of the pairs it found rather than all pairs.
5. Connected components over the forests give the groups.

A distance between unrelated 64-bit fingerprints is near 32 with deviation 4, so a ball's boundary at
radius 2 overlaps about two fifths of the queries: work grows as about n^1.5, memory of a task does not.

``keep_one`` takes the same way with fingerprints of 256 bits over distinct five-word shingles and a radius that holds all
but a few millionths of the documents with a Jaccard similarity of 0.8. At this radius the triangle inequality rules out little beside
clusters, so there is a tree for each class of set sizes, as similar sets are of similar sizes, and a leaf's visitors are dealt
over cells of bounded size. What the tree links is verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from wayline.llm import common
from wayline.llm.common import connected_components, cut, read, split_join, totals

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Nodes a shard should hold; the number of shards grows with the nodes.
SHARD_NODES = 20_000
#: Bound of the sample that fixes the vantage points, and the fewest sample points of a shard.
SAMPLE_NODES, SAMPLE_PER_SHARD = 262_144, 16
LEAF = 256
#: The pipeline's stage: words of a shingle, and the Jaccard similarity (in percent) from which documents are linked.
STAGE_WORDS, STAGE_PERCENT = 5, 80
#: Words of 64 bits of the stage's fingerprint, and its radius. Bits of sets of similarity 0.8 differ with a probability of 0.15 where sets are
#: large and 0.19 at most (four shingles of five): the radius is 6.5 and 4.5 deviations above the mean.
LANES, STAGE_RADIUS = 4, 76
#: Fewest shingles of a set that can be similar to another one without being equal to it.
STAGE_LEAST = 4
#: Width of a class of set sizes, as a natural logarithm: a little more than that of 1 / 0.8.
CLASS_WIDTH = 0.224
#: Visits of a cell of the stage, and the nodes below which its shards are not split further.
CELL_VISITS, STAGE_LEAF = 200_000, 4096
#: Bounds of a block of the stage's candidates; a task holds two blocks, and one text more at most where that is longer.
BLOCK_ROWS, BLOCK_CHARS = 1000, 4_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of one text as an unsigned integer: a bit is set if over half the shingle hashes set it."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.array([digest(joined[s:e], seed) for s, e in spans], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        block = h[at : at + 8192]
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _distance(x: np.ndarray, v: np.ndarray | np.uint64) -> np.ndarray:
    """Differing bits of fingerprints, of one word each or of several in a row."""
    bits = np.bitwise_count(x ^ v)
    return bits.sum(axis=1, dtype=np.int64) if x.ndim > 1 else bits.astype(np.int64)


def _close(x: np.ndarray, rows: np.ndarray, columns: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``radius``, as places in ``rows`` and ``columns``. Of wide fingerprints the last word is only met where the others allow it."""
    lanes = x[:, None] if x.ndim == 1 else x
    bits = np.bitwise_count(lanes[rows, 0][:, None] ^ lanes[columns, 0][None])
    for w in range(1, max(1, lanes.shape[1] - 1)):
        bits += np.bitwise_count(lanes[rows, w][:, None] ^ lanes[columns, w][None])
    r, c = np.nonzero(bits <= radius)
    if lanes.shape[1] > 1:
        near = _distance(lanes[rows[r]], lanes[columns[c]]) <= radius
        r, c = r[near], c[near]
    return r, c


def build_tree(sample: np.ndarray, depth: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and ball radii of a complete binary tree in heap order; a radius is the median distance.

    Where the sample has run out, a node takes its vantage point and radius from the whole of it.
    """
    rng = np.random.default_rng(seed)
    vantage, radius = np.zeros((2**depth - 1, *sample.shape[1:]), np.uint64), np.zeros(2**depth - 1, np.int64)
    parts = [sample]
    for level in range(depth):
        deeper = []
        for at, part in enumerate(parts, 2**level - 1):
            pool = part if len(part) else sample[rng.integers(len(sample), size=64)]
            vantage[at] = pool[rng.integers(len(pool))]
            d = _distance(pool, vantage[at])
            radius[at] = int(np.median(d))
            deeper += [part[_distance(part, vantage[at]) <= radius[at]], part[_distance(part, vantage[at]) > radius[at]]]
        parts = deeper
    return vantage, radius


def route(
    x: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int, radius: int, home: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, index into ``x`` and whether it is the home shard, for every visit that the bounds demand; points not at ``home`` only visit."""
    shard, at, home = np.zeros(len(x), np.int64), np.arange(len(x)), np.ones(len(x), bool) if home is None else home
    for level in range(depth):
        node = shard + 2**level - 1
        d = _distance(x[at], tree[0][node])
        mu = tree[1][node]
        inside = d <= mu
        # a home goes to its own side; from inside it also asks across, which covers pairs that straddle
        into = np.where(home, inside, d <= mu + radius)
        out = np.where(home, ~inside | (d > mu - radius), d > mu - radius)
        shard, home, at = (
            np.concatenate((2 * shard[into], 2 * shard[out] + 1)),
            np.concatenate((home[into], (home & ~inside)[out])),
            np.concatenate((at[into], at[out])),
        )
    return shard, at, home


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the edges, for each of n nodes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        m = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, label[end], m)
            np.minimum.at(label, end, m)
        while (deeper := label[label] < label).any():
            label[deeper] = label[label[deeper]]
        if (before == label).all():
            return label


def shard_links(
    x: np.ndarray, home: np.ndarray, radius: int = RADIUS, leaf: int = LEAF, seed: int = SEED, sizes: np.ndarray | None = None, percent: int = STAGE_PERCENT
) -> np.ndarray:
    """Smallest linked index for each point, over all home-home and query-home pairs within ``radius``.

    With ``sizes``, the smaller of a pair has ``percent`` of the larger at least.
    """
    rng = np.random.default_rng(seed)
    n = len(x)
    label = np.arange(n)
    left, right, held = [], [], 0

    def fold() -> None:
        nonlocal label, left, right, held
        a, b = np.concatenate([np.arange(n), *left]), np.concatenate([label, *right])
        label, left, right, held = _forest(n, a, b), [], [], 0

    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        h, q = stack.pop()
        if not len(h) or len(h) + len(q) < 2:
            continue
        halves = None
        if len(h) > leaf:
            for _ in range(4):
                v = x[h[rng.integers(len(h))]]
                dh, dq = _distance(x[h], v), _distance(x[q], v)
                mu = int(np.median(dh))
                inside = dh <= mu
                if 0.1 < inside.mean() < 0.9:
                    across = h[inside & (dh > mu - radius)]
                    halves = [(h[inside], q[dq <= mu + radius]), (h[~inside], np.concatenate((q[dq > mu - radius], across)))]
                    break
        if halves:
            stack += halves
            continue
        every = np.concatenate((h, q))
        for i in range(0, len(every), 512):  # a tight ball that no vantage point splits is compared in blocks
            for j in range(0, len(h), 1024):
                r, c = _close(x, every[i : i + 512], h[j : j + 1024], radius)
                a, b = every[i + r], h[j + c]
                keep = a != b
                if sizes is not None:
                    keep &= 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
                left.append(a[keep])
                right.append(b[keep])
                held += int(keep.sum())
                if held > 1_000_000:
                    fold()
    fold()
    return label


def near_links(nodes: DataFrame, radius: int = RADIUS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``nodes.fp`` that connect exactly what pairs within ``radius`` connect."""
    n = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard_nodes))))
    wanted = min(SAMPLE_NODES, max(4096, SAMPLE_PER_SHARD * 2**depth))
    tree = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if depth:
        rows = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(wanted).collect()
        tree = build_tree(np.array([r[0] for r in rows], np.int64).view(np.uint64), depth)

    held = nodes.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b["fp"].to_numpy(np.int64)
            shard, at, home = route(x.view(np.uint64), held.value, depth, radius)
            yield pd.DataFrame({"shard": shard, "fp": x[at], "home": home})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["fp"].to_numpy(np.int64)
        label = shard_links(x.view(np.uint64), pdf["home"].to_numpy(bool), radius)
        at = np.flatnonzero(label != np.arange(len(x)))
        return pd.DataFrame({"a": x[at], "b": x[label[at]]})

    dealt = nodes.select("fp").mapInPandas(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(solve, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id reachable over links of ``radius`` or fewer differing bits.
    Null texts count as empty; texts without a word have fingerprint zero and link like any other;
    repeated rows stay; a group whose doc_ids are all null has a null component_id; extra columns are
    ignored; an empty table gives an empty result.
    """
    prints = cut(docs.select("doc_id", pandas_udf(_fingerprints, T.LongType())(F.col("text")).alias("fp")))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected_components(near_links(nodes, radius, shard_nodes))
    # Only linked nodes need the root's smallest id; all others answer for themselves.
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = linked.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingles(text: str | None, words_per_shingle: int = STAGE_WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text; shorter texts are one shingle, texts without a word none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter((digest(x, seed) for x in words), np.uint64, len(words))
    k = min(words_per_shingle, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):  # a polynomial of the word hashes, stirred at every step
        h = (h ^ w[i : len(words) - k + 1 + i]) * MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of LANES words of a set of hashes: a bit is set if over half of them, stirred anew for every word, set it."""
    votes = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(h), 255 * 16):
        block = h[at : at + 255 * 16, None] ^ (MIX * np.arange(1, LANES + 1, dtype=np.uint64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            block = (block ^ (block >> np.uint64(shift))) * np.uint64(factor)
        block ^= block >> np.uint64(31)
        bits = np.unpackbits(block.view(np.uint8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):  # as many as a byte can count
            votes += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)


def _node(h: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _printed(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in texts]
    prints = np.array([wide_fingerprint(h) for h in sets], np.uint64).reshape(-1, LANES).view(np.int64)
    return pd.DataFrame({"node": [_node(h) for h in sets], "n": [len(h) for h in sets], **{f"f{w}": prints[:, w] for w in range(LANES)}})


def wide_links(nodes: DataFrame, radius: int = STAGE_RADIUS, shard_nodes: int = SHARD_NODES, percent: int = STAGE_PERCENT) -> DataFrame:
    """Edges (a, b) that connect what pairs of nodes (id, n, f0 to f3) within ``radius`` connect whose sizes ``n`` are similar.

    A node lives in the tree of its class of sizes and visits that of the next one. A tree's shard is compared in cells: its
    own nodes stand in each, its visitors are dealt over them.
    """
    lanes = [f"f{w}" for w in range(LANES)]
    classed = nodes.withColumn("kind", F.floor(F.log("n") / CLASS_WIDTH).cast("int"))
    counts = {r.kind: r.m for r in classed.groupBy("kind").agg(F.count("*").alias("m")).collect()}  # a row for each class, some dozens
    depths = {k: max(0, int(np.ceil(np.log2(m / shard_nodes)))) for k, m in counts.items()}
    deep = [k for k, d in depths.items() if d]
    trees = {}
    if deep:
        wanted = min(SAMPLE_NODES, max(4096, SAMPLE_PER_SHARD * sum(2 ** depths[k] for k in deep)))
        rows = classed.where(F.col("kind").isin(deep)).select("kind", *lanes).orderBy(F.xxhash64(*lanes), *lanes).limit(wanted).collect()
        for k in deep:
            own = np.array([r[1:] for r in rows if r.kind == k], np.int64).reshape(-1, LANES).view(np.uint64)
            depths[k] = depths[k] if len(own) else 0
            trees[k] = build_tree(own, depths[k])
    cells = {k: -(-(m + counts.get(k - 1, 0)) // CELL_VISITS) for k, m in counts.items()}
    held = nodes.sparkSession.sparkContext.broadcast((trees, depths, cells))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, depths, cells = held.value
        for b in batches:
            x, kind = np.ascontiguousarray(b[lanes].to_numpy(np.int64)).view(np.uint64), b["kind"].to_numpy()
            for k in sorted({*kind, *(kind + 1)} & set(depths)):
                own = np.flatnonzero((kind == k) | (kind == k - 1))
                shard, at, home = route(x[own], trees.get(k), depths[k], radius, kind[own] == k)
                rows = b.iloc[own[at]][["id", "n", *lanes]].assign(kind=k, shard=shard, home=home)
                cell = (x[own[at], 0] % np.uint64(cells[k])).astype(np.int64)
                for c in range(cells[k]):
                    yield rows[home | (cell == c)].assign(cell=c)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.ascontiguousarray(pdf[lanes].to_numpy(np.int64)).view(np.uint64), pdf["id"].to_numpy()
        label = shard_links(x, pdf["home"].to_numpy(bool), radius, STAGE_LEAF, sizes=pdf["n"].to_numpy(), percent=percent)
        at = np.flatnonzero(label != np.arange(len(x)))
        return pd.DataFrame({"a": ids[at], "b": ids[label[at]]})

    columns = ["id", "n", *lanes]
    dealt = classed.select(*columns, "kind").mapInPandas(deal, ", ".join(f"{c} long" for c in columns) + ", kind int, shard long, home boolean, cell long")
    return dealt.groupBy("kind", "shard", "cell").applyInPandas(solve, "a long, b long")


def similar_groups(sets: list[np.ndarray], percent: int = STAGE_PERCENT) -> np.ndarray:
    """Label of each set's group over all pairs with a Jaccard similarity of ``percent`` or more, worked out exactly.

    A breadth-first walk: sets already reached are never compared with each other again.
    """
    sizes = np.array([len(h) for h in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(owner) else np.zeros(0, np.int64)
    own = np.split(code, np.cumsum(sizes)[:-1])
    n_codes = int(code.max()) + 1 if len(code) else 0
    label = np.full(len(sets), -1)
    order = np.argsort(code, kind="stable")
    post, post_code = owner[order], code[order]
    left = held = len(sets)
    starts = np.searchsorted(post_code, np.arange(n_codes + 1))
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first] = first
        left -= 1
        queue = [first]
        while queue and left:
            if 2 * left < held:  # postings of what is reached go
                keep = label[post] < 0
                post, post_code, held = post[keep], post_code[keep], left
                starts = np.searchsorted(post_code, np.arange(n_codes + 1))
            at = queue.pop()
            s, n = starts[own[at]], starts[own[at] + 1] - starts[own[at]]
            index = np.repeat(s - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            common = np.bincount(post[index], minlength=len(sets))
            near = (label < 0) & (common > 0) & (100 * common >= percent * (sizes + sizes[at] - common))
            found = np.flatnonzero(near)
            label[found] = first
            left -= len(found)
            queue += found.tolist()
    return label


def links_across(homes: list[np.ndarray], visitors: list[np.ndarray], label: np.ndarray, percent: int = STAGE_PERCENT) -> list[tuple[int, int]]:
    """Pairs (visitor, home), by place in ``visitors + homes``, that connect what all similar pairs of the two sides connect.

    ``label`` names the groups known before, of the visitors first; a pair inside one group is not returned.
    """
    sets, known = visitors + homes, np.unique(label, return_inverse=True)[1]
    sizes = np.array([len(h) for h in sets], np.int64)
    if not sizes.sum():
        return []
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(code, np.cumsum(sizes)[:-1])
    n = len(visitors)
    first = int(sizes[:n].sum())
    owner, post = np.repeat(np.arange(len(homes)), sizes[n:]), code[first:]
    order = np.argsort(post, kind="stable")
    owner, post = owner[order], post[order]
    starts = np.searchsorted(post, np.arange(int(code.max()) + 2))
    found = []
    for v in range(n):
        s, m = starts[own[v]], starts[own[v] + 1] - starts[own[v]]
        index = np.repeat(s - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
        common = np.bincount(owner[index], minlength=len(homes))
        near = (known[n:] != known[v]) & (common > 0) & (100 * common >= percent * (sizes[n:] + sizes[v] - common))
        for j in np.flatnonzero(near):
            if known[n + j] != known[v]:
                found.append((v, n + int(j)))
                known[known == known[n + j]] = known[v]
    return found


def _solve_similar(pdf: pd.DataFrame, percent: int = STAGE_PERCENT) -> pd.DataFrame:
    ids = pdf["doc_id"].to_numpy()
    label = similar_groups([shingles(t) for t in pdf["text"]], percent)
    at = np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[at], "b": ids[label[at]]})


def _solve_across(pdf: pd.DataFrame, percent: int = STAGE_PERCENT) -> pd.DataFrame:
    pdf = pdf.sort_values("home", kind="stable")
    ids, sets, home = pdf["doc_id"].to_numpy(), [shingles(t) for t in pdf["text"]], pdf["home"].to_numpy(bool)
    n = int((~home).sum())
    found = links_across(sets[n:], sets[:n], pdf["label"].to_numpy(), percent)
    return pd.DataFrame({"a": [ids[v] for v, _ in found], "b": [ids[h] for _, h in found]}, dtype="int64")


def _blocks(rows: str, chars: str):
    return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(chars) / BLOCK_CHARS), F.lit(1)).cast("int")


def similar_links(candidates: DataFrame, star: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """Links (a, b) that connect exactly what the pairs of ``percent`` or more of documents with one ``root`` connect.

    ``candidates`` holds doc_id, root and text, once each; ``star`` names for a document (a) a smaller one (leader) that the
    candidates' search has linked it with. A root's documents are dealt over blocks of bounded rows and characters. First every block is
    solved, with its documents' leaders in it, so that a large group of copies becomes one group by few comparisons. Then,
    under roots of several blocks, every document outside the root's largest group meets every block.
    """
    texts = candidates.withColumn("chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    sizes = texts.groupBy("root").agg(F.count("*").alias("n"), F.sum("chars").alias("all_chars")).select("root", "n", _blocks("n", "all_chars").alias("parts"))
    held = cut(split_join(texts, sizes, ["root"], "n", narrow=True).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")))
    large, cells = held.where("parts > 1"), held.select("root", "part", "doc_id", "text")
    n_large = totals(large, F.count("*"))[0]
    if n_large:
        dealt = common.held(large.select("root", "part", F.col("doc_id").alias("a")), n_large)
        leaders = common.held(star.join(dealt, "a").select("root", "part", F.col("leader").alias("doc_id")).distinct(), n_large)
        guests = large.select("doc_id", "text").join(leaders, "doc_id").select("root", "part", "doc_id", "text")
        cells = cells.unionByName(guests)
    links = cut(cells.groupBy("root", "part").applyInPandas(lambda pdf: _solve_similar(pdf, percent), "a long, b long"))
    if not n_large:
        return links
    label = connected_components(links).select(F.col("node").alias("doc_id"), F.col("root").alias("label"))
    label = common.held(label, totals(label, F.count("*"))[0])
    tagged = large.select("root", "part", "parts", "doc_id", "text", "chars").join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    groups = tagged.groupBy("root", "label").agg(F.count("*").alias("m"), F.sum("chars").alias("c"))
    rest = groups.groupBy("root").agg(
        F.sum("m").alias("n"), F.max(F.struct("m", "label", "c")).alias("top"), F.sum("c").alias("all_chars")
    ).where("n > top.m").withColumn("rest", F.col("n") - F.col("top.m")).withColumn("rest_chars", F.col("all_chars") - F.col("top.c"))
    rest = rest.select("root", "n", F.col("top.label").alias("top"), _blocks("rest", "rest_chars").alias("rest_parts"))
    still = cut(split_join(tagged, rest, ["root"], "n", narrow=True))
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    same = ["root", "doc_id", "text", "label"]
    homes = still.select(*same, F.col("part").alias("i"), up_to("rest_parts").alias("j"), F.lit(True).alias("home"))
    visits = still.where("label <> top").select(
        *same, up_to("parts").alias("i"), F.pmod(F.xxhash64("doc_id", F.lit(SEED)), "rest_parts").cast("int").alias("j"), F.lit(False).alias("home")
    )
    across = homes.unionByName(visits).groupBy("root", "i", "j").applyInPandas(lambda pdf: _solve_across(pdf, percent), "a long, b long")
    return links.unionByName(across)


def similar_documents(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, component_id) of documents that are not the smallest doc_id of their group.

    Documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Equal sets collapse
    first; documents that the vantage-point trees of their fingerprints link, chained, are candidates, and ``similar_links``
    works out their similarities exactly. Rows with a null doc_id take no part; texts without a word are equal.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lanes = [f"f{w}" for w in range(LANES)]
    printed = pandas_udf(_printed, f"node long, n long, {', '.join(f'{c} long' for c in lanes)}")(F.col("text"))
    prints = cut(rows.select("doc_id", printed.alias("p")).select("doc_id", "p.*"))
    nodes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("n", *lanes)]))
    found = wide_links(nodes.where(F.col("n") >= STAGE_LEAST).select(F.col("least_id").alias("id"), "n", *lanes))
    edges = cut(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    chained = connected_components(edges)
    chained = cut(chained.unionByName(chained.select(F.col("root").alias("node"), "root").distinct()))
    candidates = rows.join(chained.withColumnRenamed("node", "doc_id"), "doc_id").dropDuplicates(["doc_id"])
    roots = connected_components(similar_links(candidates, edges.groupBy("a").agg(F.min("b").alias("leader"))))
    answer = nodes.join(roots.select(F.col("node").alias("least_id"), F.col("root").alias("component_id")), "least_id", "left")
    answer = answer.select("node", F.coalesce("component_id", "least_id").alias("component_id"), "times")
    found = split_join(prints.select("doc_id", "node"), answer, ["node"], "times").select("doc_id", "component_id")
    return found.where("doc_id <> component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of similar documents: the one with the smallest doc_id; rows with a null doc_id stay.

    Repeated rows of one doc_id are one document and collapse to a single row. doc_id holds whole numbers, of any type; other ids raise ``CAST_INVALID_INPUT``.
    """
    gone = similar_documents(docs).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
