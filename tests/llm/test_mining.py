"""Hard negatives, source divergence and MinHash near-dedup: twins, brute-force versions and odd input."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import DATA, same
from tests.llm.test_llm import ODD, docs
from wayline.llm import common, divergence, hard_negatives, minhash_dedup, registry, simhash_dedup

NEW = ["op11_hard_negatives", "op12_source_divergence", "op13_minhash"]


@pytest.mark.parametrize("name", NEW)
def test_twin(spark, name):
    same(registry.queries()[name](spark, DATA), registry.oracle_sql()[name], DATA)


# 11 hard negatives


@pytest.mark.parametrize("scale", [5, 130, 10**6, 2**31, 2.0**60, 1e38])
def test_packed_products_are_exact(scale):
    rng = np.random.default_rng(1)
    for d in (0, 1, 3, 64):
        for n in (1, 2, 7, 50):
            a, c = np.floor(rng.uniform(-scale, scale, (4, d))), np.floor(rng.uniform(-scale, scale, (n, d)))
            assert hard_negatives.packed_scores(a, c).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, q, strict=True)) for q in c] for r in a]


def plain_negatives(rows, every):
    """rows: vec_id -> (label, whole components), after the change of labels."""
    score = lambda x, y: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(rows[x][1], rows[y][1], strict=False))))
    out = []
    for anchor in sorted(rows):
        if anchor % every:
            continue
        order = sorted((x for x in rows if x != anchor), key=lambda x: (-score(anchor, x), x))
        for p in [x for x in order if rows[x][0] == rows[anchor][0]][:5]:
            s = score(anchor, p)
            near = [x for x in order if rows[x][0] != rows[anchor][0] and 80 * s <= 100 * score(anchor, x) <= 100 * s]
            out += [(anchor, p, i + 1, x, s, score(anchor, x)) for i, x in enumerate(near[:5])]
    return sorted(out)


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, score string, rows string")


@pytest.mark.parametrize("few_groups", [True, False])
def test_negatives_equal_plain_python(spark, monkeypatch, few_groups):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "TASK_BLOCKS", 2)
    monkeypatch.setattr(hard_negatives, "MAX_BROADCAST_GROUPS", 10**6 if few_groups else 0)
    rng = random.Random(4)
    table = [(i, [rng.choice([-0.5, 0.1, 0.25, 0.9]) for _ in range(6)], rng.choice([0, 0, 0, 1, 2, 9])) for i in range(200)]
    table += [(200, [0.1] * 3, 1), (210, [], 1), (220, [3e38, -1e38], 0), (230, [2e37] * 6, 2)]
    whole = {i: ((y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v, y in table}
    odd = [(300, None, 1), (310, [0.1], None), (320, [None, 1.0], 1), (330, [float("nan")], 1), (340, [float("inf")], 1), (None, [0.1] * 6, 1)]
    found = hard_negatives.mine(vector_table(spark, table + odd + table[:30]), every=10)
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(whole, 10)


def test_no_vectors_give_no_negatives(spark):
    assert hard_negatives.mine(vector_table(spark, [])).count() == 0
    assert hard_negatives.mine(vector_table(spark, [(100, [0.5], 1)])).count() == 0


# 12 source divergence


def plain_audit(rows, min_docs=10):
    """rows: (lang, source, text)."""
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    words = [(a or "", b or "", [lower(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for a, b, t in rows]
    out = []
    for lang in {a for a, _, _ in words}:
        held, by, total = collections.Counter(), {}, collections.Counter()
        for a, b, w in words:
            if a == lang:
                held.update(set(w))
                by.setdefault(b, collections.Counter()).update(w)
                total.update(w)
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        prob = lambda own: {t: 1 + 10**9 * (own[t] + 2) // (sum(own[x] for x in kept) + 2 * len(kept)) for t in kept}
        price = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: prob(c) for s, c in by.items()}, prob(total)
        for s in by:
            pairs = [(o, sum(price(p[s][t], p[o][t]) for t in kept)) for o in by if o != s]
            terms = [(t, price(p[s][t], q[t])) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (item, v) in enumerate(found[: None if part == "pair" else 10])]
    return sorted(out)


@pytest.mark.parametrize("columns", [divergence.COLUMNS, 7])
def test_audit_equals_plain_python(spark, monkeypatch, columns):
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 16)
    monkeypatch.setattr(divergence, "LEAST_TERMS", 4)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 300)
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "abcdÄß" for b in "ABCéfG"] + ["Straße", "ÉCOLE", "école", "日本", "x"]
    rows = []
    for _ in range(400):
        text = rng.choice([" ", "\n", "-", "_", "7"]).join(rng.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=rng.randint(0, 30)))
        rows.append((rng.choice(["en", "de", None, ""]), rng.choice(["hot", "hot", "s1", "s2", "S2", None, "é"]), text))
    rows += [("xx", "alone", "few words"), ("yy", "a", None), ("yy", "b", ""), ("en", "no terms", "12 34"), *[("zz", s, "same words") for s in "pq" for _ in range(8)], rows[0]]
    table = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n string")
    assert sorted(tuple(r) for r in divergence.audit(table).collect()) == plain_audit(rows)


def test_audit_on_odd_rows(spark):
    rows = docs(spark, ODD * 24).withColumn("source", F.when(F.col("doc_id") % 5 > 1, F.lit("s")))
    want = plain_audit([(r.lang, r.source, r.text) for r in rows.collect()])
    assert sorted(tuple(r) for r in divergence.audit(rows).collect()) == want and want
    assert divergence.audit(rows.where("false")).count() == 0


def test_prices_beyond_a_long_are_exact():
    level = np.array([0, 5, 10**12, 9 * 10**17])
    assert divergence.prices(level, 10**18, 7).tolist() == [1 + 10**9 * (int(c) + 2) // (10**18 + 14) for c in level]


# 13 near duplicates


def plain_sets(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set()))
    return out


def plain_components(sets, percent=85):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("cell,hot", [(512, 1000), (9, 12)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, cell, hot):
    monkeypatch.setattr(minhash_dedup, "CELL_NODES", cell)
    monkeypatch.setattr(minhash_dedup, "HOT_NODES", hot)
    monkeypatch.setattr(minhash_dedup, "MOST_HOT", 10**9)
    monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", cell)
    rng = random.Random(hot)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(40):  # documents of one passage and something of their own, and copies of a few
        own = [word() for _ in range(rng.choice([5, 20, 60, 200]))]
        texts += copies(rng, own + passage if rng.random() < 0.6 else own, rng.choice([1, 1, 2, 6]), 2)
    texts += copies(rng, [word() for _ in range(120)], 60, 3) + ["a b", "A  b", "a b c d e", "a b c d e f", "", None, " \n", "a"]
    texts += [texts[0]] * 30
    rng.shuffle(texts)
    sets = plain_sets(texts)
    label = plain_components(sets)
    rows = minhash_dedup.near_duplicates(docs(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, label, strict=True))}


def test_near_duplicates_on_odd_rows(spark):
    rows = docs(spark, ODD).unionByName(docs(spark, ["null id", "a b c"], [None, None])).unionByName(docs(spark, ["a b c", ODD[0]], [0, 0]))
    found = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(rows).collect())
    assert sum(found.values()) == rows.count()
    assert found[None, 1, None, True] == 1 and found[None, 1, 0, False] == 1 and found[0, 1, 0, True] == 3
    assert found[5, 1, 0, False] == 1 and found[1, 0, 1, True] == found[2, 0, 2, True] == 1
    assert minhash_dedup.near_duplicates(rows.where("false")).count() == 0
    named = rows.where("doc_id is not null").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.component_id for r in minhash_dedup.near_duplicates(named).where("doc_id = 'd5'").collect()} == {"d0"}


def test_estimates_are_exact_for_small_unions_and_close_for_large_ones():
    rng = np.random.default_rng(3)
    for size, kept in ((20, 64), (3000, 64)):
        both = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        for common in (0, size // 2, size):
            a, b = np.sort(both[:size]), np.sort(both[size - common : 2 * size - common])
            rows = np.full((2, kept), minhash_dedup.PAD, np.uint64)
            for r, x in zip(rows, (a, b), strict=True):
                r[: min(kept, len(x))] = x[:kept]
            true = common / (2 * size - common)
            got = minhash_dedup.bottom_estimates(rows[0], rows[1:], kept)[0]
            assert got == true if 2 * size - common <= kept else abs(got - true) < 0.25


@pytest.mark.parametrize("few", [0, 30, 10**6])
def test_components_by_shuffle_and_by_broadcast_equal_a_loop(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_ROWS", few)
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(20)]
    label = {x: x for p in pairs for x in p}
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label = {x: low if r == high else r for x, r in label.items()}
    edges = spark.createDataFrame([*pairs, *pairs[:9], (7, 7), (None, 8)], "a long, b long")
    found = {r.node: r.root for r in common.connected_components(edges).collect()}
    assert found == {x: r for x, r in label.items() if x != r}
    assert common.connected_components(edges.where("false")).count() == 0


def test_near_duplicates_of_few_nodes_run_few_empty_tasks(spark):
    """op13 on many shuffle partitions: what is small is broadcast, rather than written by every partition again and again."""
    rng = random.Random(8)
    texts = [t for _ in range(20) for t in copies(rng, [f"w{rng.randrange(4000)}" for _ in range(80)], 3, 2)]
    partitions, conf = 64, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    sc = spark.sparkContext
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few nodes", "")
        assert minhash_dedup.near_duplicates(docs(spark, texts)).count() == len(texts)
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few nodes") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert 0 < tasks < 75 * partitions


def test_near_duplicates_beyond_all_broadcasts_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    monkeypatch.setattr(minhash_dedup, "MAX_BROADCAST_NODES", 0)
    monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", 7)
    rng = random.Random(9)
    texts = [t for n in (1, 2, 5, 25) for t in copies(rng, [f"w{rng.randrange(4000)}" for _ in range(100)], n, 5)] + ["a b", "A  b", None]
    sets = plain_sets(texts)
    rows = minhash_dedup.near_duplicates(docs(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, plain_components(sets), strict=True))}
