"""The ten operators on small fixtures: odd input, brute-force versions, round trips and held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.compare import DATA, same
from wayline.llm import (
    common,
    decontaminate,
    html_extract,
    line_dedup,
    pii,
    pipeline,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    simhash_dedup,
    substring_dedup,
    url_filter,
)

LONG = " ".join(f"wörd{i % 977}" for i in range(30_000))
#: doc_id, text, lang, source, n_chars and columns whose names clash with ones the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, ids string, found string, fp string, key string, words string, gone string, _id string, _key string, spans string"


def docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en" if i else None, "s", None, *["x"] * 11) for i, t in zip(ids, texts, strict=True)], SCHEMA)


ODD = ["plain words here and there", None, "", " \n\t ", LONG, "plain words here and there", "ünïcode 😀 text\n\nwith lines\n", "a", "\x00\x0b\x1c"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, and one row given twice."""
    rows = docs(spark, ODD)
    extra = docs(spark, ["null id"], [None])
    return rows.unionByName(extra).unionByName(rows.where("doc_id = 0")).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None) for i in range(8)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")


# 1 personal data


def plain_spans(text):
    """The contract's patterns as they stand."""
    out = []
    luhn = lambda d: sum((int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c))))) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern, good in (
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (2, r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "@", ".", "-", "1", "23", "+", " ", "(", "255", "4111 1111 1111 1111", "é", "x@y.z", "1.2.3.4"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 200_000 + "a." * 50_000 + "@" * 1000) == []


def test_pii_on_odd_rows(spark, odd, none):
    rows = pii.find(odd).collect()
    assert len(rows) == odd.count() and all(r.n_email == 0 and r.found == [] for r in rows)
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find(none).count() == 0


def test_terms_that_tell_are_removed_wherever_they_stand(spark):
    texts = [f"the report {i} was sent by zorblatt to ann@x.org with the thing" for i in range(20)]
    texts += [f"the report {i} and the thing was sent with all to others here {i}" for i in range(90)] + ["no address but Zorblatt stands here"]
    rows = docs(spark, texts)
    found = {r.doc_id: [(pii.KINDS[s.kind], texts[r.doc_id][s.start : s.end]) for s in r.found] for r in pii.find(rows).collect()}
    assert found[0] == [("remove", "zorblatt"), ("email", "ann@x.org")] and found[110] == [("remove", "Zorblatt")]
    assert all(found[i] == [] for i in range(20, 110))
    clean = {r.doc_id: r.text for r in pii.sanitise(rows).collect()}
    assert "zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and clean[30] == texts[30] and "Zorblatt" not in clean[110]


def test_secrets_are_found_by_their_information():
    find = lambda t: [t[s:e] for s, _, e in pii.secret_spans(t, pii.base_spans(t))]
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    assert find(f'so token = "{token}" it is') == [token] and find(f"({token})") == [token]
    assert find("password: hunter22 and api_key='abcdef-1'") == ["hunter22", "abcdef-1"]
    assert find("internationalisation 4111111111111111 aaaaaaaa11111111 a_long_name_of_a_thing passwords are long") == []
    assert find("a1b2c3d4e5f6g7h8@mail.example.com") == []


def plain_terms(texts):
    """term -> bits left, by dictionaries over all texts."""
    near, holds, words = collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        spans = pii.base_spans(t)
        spans = sorted([*spans, *pii.secret_spans(t, spans)])
        near.update({(c["entity"], c["term"]) for c in pii.context(t, spans)})
        holds.update({e for s, k, x in spans for e in (pii.entity(k, t[s:x]), pii.KINDS[k])})
        words.update(set(re.findall(r"[^\W_]+", t.lower())))
    left = {}
    for (entity, term), n in near.items():
        bits = -np.log2(n / (words[term] + pii.PRIOR))
        if bits <= pii.GENERALISE_BITS and -np.log2(holds[entity] / len(texts)) - bits >= pii.LEAST_BITS:
            left[term] = min(bits, left.get(term, 9))
    return left


def test_counts_and_spans_equal_plain_python(spark):
    rng = random.Random(6)
    texts = []
    for i in range(400):
        words = [f"{rng.choice('abcd')}{rng.randrange(40):02d}" for _ in range(rng.randint(0, 25))]
        if i % 8 == 0:
            who = rng.randrange(3)
            words.insert(rng.randint(0, len(words)), f"Name{who} writes from user{who}@x.org today{rng.randrange(9)}")
        if i % 40 == 1:
            words.append(f"secretkey is {hashlib.sha1(str(i).encode()).hexdigest()}")
        texts.append(" ".join(words))
    left = plain_terms(texts)
    assert {"name0", "writes", "secretkey"} <= set(left) and 3 < len(left) < 40
    rows = pii.find(docs(spark, texts)).collect()
    for r in rows:
        t = texts[r.doc_id]
        own = pii.base_spans(t)
        own += pii.secret_spans(t, own)
        want = [(m.start(), 6 if left[m[0].lower()] <= pii.REMOVE_BITS else 5, m.end()) for m in re.finditer(r"[^\W_]{3,}", t) if m[0].lower() in left]
        want = [s for s in want if not any(a < s[2] and s[0] < b for a, _, b in own)]
        assert [(s.start, s.kind, s.end) for s in r.found] == sorted(own + want)
        assert r.n_general + r.n_remove == len(want)


# 2 quality classifier


def test_classifier_ranks_held_out_documents(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    found = quality_classifier.query(spark, folder).join(common.read(spark, folder, "labels"), "doc_id").where("held_out").toPandas()
    assert ((found["predicted"] == found["quality"]).mean()) > 0.95
    good, bad = found[found["quality"] == 1]["score"].to_numpy(), found[found["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.98


def test_classifier_on_odd_rows(spark, odd, none, labels):
    rows = quality_classifier.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.score(none, labels).count() == 0
    assert {r.score for r in quality_classifier.score(odd, labels.where("false")).collect()} == {0.5}


# 3 near duplicates


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=2):
    label = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= radius
    while True:
        new = np.array([label[near[i]].min() for i in range(len(prints))])
        if (new == label).all():
            return label
        label = new


def test_fingerprints_and_components_on_odd_rows(spark, odd, none):
    rows = simhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    for i, text in enumerate(ODD):
        assert int(by_id[i].fingerprint, 16) == plain_fingerprint(text)
    assert by_id[5].component_id == 0 and {by_id[i].component_id for i in (1, 2, 3)} == {1}
    assert simhash_dedup.near_duplicates(none).count() == 0
    kept = [r.doc_id for r in simhash_dedup.keep_one(odd).collect()]
    assert kept.count(0) == 1 and 5 not in kept and 2 not in kept and None in kept


@pytest.mark.parametrize("shard_nodes", [100, 700, 100_000])
def test_vantage_point_shards_lose_no_link(spark, shard_nodes):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 600, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64))
    ball = np.array([0x1234567890ABCDEF], np.uint64).repeat(400)
    x = np.unique(np.concatenate([base, flip(base), flip(flip(base)), flip(ball), flip(flip(ball)), flip(flip(flip(ball)))]))
    nodes = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in common.connected_components(simhash_dedup.near_links(nodes, 2, shard_nodes)).collect()}
    groups = collections.defaultdict(set)
    for v, c in zip(x.view(np.int64).tolist(), plain_components(x).tolist(), strict=True):
        groups[c].add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


@pytest.mark.parametrize("shard_nodes, visits", [(60, 100), (100_000, 200_000)])
def test_wide_trees_lose_no_link(spark, monkeypatch, shard_nodes, visits):
    monkeypatch.setattr(simhash_dedup, "CELL_VISITS", visits)
    monkeypatch.setattr(simhash_dedup, "STAGE_LEAF", 20)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, (150, simhash_dedup.LANES), dtype=np.uint64)
    bits = np.unpackbits(base.view(np.uint8), axis=1)
    near = [np.packbits(bits ^ (rng.random(bits.shape) < share), axis=1).view(np.uint64) for share in (0.15, 0.25)]
    x = np.concatenate([base, *near])
    n = np.concatenate([rng.integers(4, 400, 150)] * 3) * rng.choice([10, 11, 12, 13], 450) // 10
    rows = [(i, int(n[i]), *v) for i, v in enumerate(x.view(np.int64).tolist())]
    nodes = spark.createDataFrame(rows, "id long, n long, f0 long, f1 long, f2 long, f3 long")
    found = common.connected_components(simhash_dedup.wide_links(nodes, shard_nodes=shard_nodes)).collect()
    distance = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2, dtype=int)
    linked = (distance <= simhash_dedup.STAGE_RADIUS) & (100 * np.minimum(n[:, None], n) >= 80 * np.maximum(n[:, None], n))
    label = np.arange(len(x))
    while (low := np.array([label[row].min() for row in linked]))[:].tolist() != label.tolist():
        label = low
    assert {r.node: r.root for r in found} == {i: r for i, r in enumerate(label.tolist()) if i != r} and 50 < len(found) < 300


def test_sets_at_the_threshold_lie_within_the_stage_radius():
    rng = np.random.default_rng(7)
    for common_, one, two in ((4, 1, 0), (8, 1, 1), (8, 2, 0), (40, 10, 0), (40, 5, 5), (400, 50, 50)):
        h = rng.integers(0, 2**64, (200, common_ + one + two), dtype=np.uint64)
        a = [simhash_dedup.wide_fingerprint(x[: common_ + one]) for x in h]
        b = [simhash_dedup.wide_fingerprint(np.concatenate((x[:common_], x[common_ + one :]))) for x in h]
        assert max(int(np.bitwise_count(u ^ v).sum()) for u, v in zip(a, b, strict=True)) <= simhash_dedup.STAGE_RADIUS


def test_near_dedup_candidates_come_from_the_tree(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words))]
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(docs(spark, texts)).collect()) == [0, 2]
    monkeypatch.setattr(simhash_dedup, "wide_links", lambda nodes: nodes.sparkSession.createDataFrame([], "a long, b long"))
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(docs(spark, texts)).collect()) == [0, 1, 2]


def plain_kept(texts, at_least=0.8):
    """Smallest index of each group over all pairs of five-word shingle sets."""
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) < at_least * max(len(a), len(b)):
                continue
            if (a or b) and 5 * len(a & b) < 4 * len(a | b) or label[i] == label[j]:
                continue
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return sorted(set(label))


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_similar_groups_equal_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", block_rows)
    rng = random.Random(4)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(3, 120))] for _ in range(25)]
    texts = []
    for words in base:
        for _ in range(6):
            new = list(words)
            for _ in range(rng.randint(0, 4)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(500)}"
            texts.append(" ".join(new))
    rng.shuffle(texts)
    texts += [None, "", " \n"]
    kept = sorted(r.doc_id for r in simhash_dedup.keep_one(docs(spark, texts)).collect())
    assert kept == plain_kept(texts) and 25 < len(kept) < len(texts) - 20


@pytest.mark.parametrize("chars", [4_000_000, 3000])
def test_large_groups_and_chains_lose_no_link_over_blocks(spark, monkeypatch, chars):
    monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", 5)
    monkeypatch.setattr(simhash_dedup, "BLOCK_CHARS", chars)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    words = [f"w{i}" for i in range(400)]
    slide = [" ".join(words[i : i + 60]) for i in range(0, 300, 3)]  # every text is near the next, the first and last have nothing in common
    template = [" ".join(words[:40] + [f"own{i}x{k}" for k in range(8)]) for i in range(30)]  # one band in common, nothing near
    copies = [" ".join(words[100:180]) + f" tail{i % 40}" for i in range(120)]
    texts = slide + template + copies
    random.Random(8).shuffle(texts)
    kept = sorted(r.doc_id for r in simhash_dedup.keep_one(docs(spark, texts)).collect())
    assert kept == plain_kept(texts) and 30 < len(kept) < 60


def test_links_across_equal_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(6)]
    sets += [np.unique(np.concatenate([s[2:], rng.integers(0, 60, 2).astype(np.uint64)])) for s in sets for _ in range(5)]
    visitors, homes = sets[::3], [h for i, h in enumerate(sets) if i % 3]
    both = visitors + homes
    near = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    want = [(v, h) for v in range(len(visitors)) for h in range(len(visitors), len(both)) if near(both[v], both[h])]
    found = simhash_dedup.links_across(homes, visitors, np.arange(len(both)))
    assert found and set(found) <= set(want) and not simhash_dedup.links_across(homes, visitors, np.zeros(len(both), int))
    groups = lambda pairs: {frozenset(g) for g in merged(pairs)}
    assert groups(found) == groups(want)


def merged(pairs):
    """Connected groups of ``pairs``."""
    groups = []
    for a, b in pairs:
        joined = {a, b}.union(*(g for g in groups if a in g or b in g))
        groups = [g for g in groups if not (a in g or b in g)] + [joined]
    return groups


def test_near_dedup_stage_equals_all_pairs(spark):
    rows = common.read(spark, DATA, "documents")
    texts = {r.doc_id: r.text for r in rows.collect()}
    ids = sorted(texts)
    want = [ids[i] for i in plain_kept([texts[i] for i in ids])]
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, rows, DATA).collect()) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3), (2, 1)]
    found = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{1000 + i: 1000 for i in range(1, 300)}}


# 4 SentencePiece


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.load_pieces())


def test_ids_equal_the_library(codec):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + ["", " ", "   a  b ", "x" * 300, "aaaa aaa aa a" * 20, "漢字 テスト 😀😀", "http://a.b/c?d=e&f=1  def f(x):\n\treturn x+1"]
    texts += ["".join(rng.choice("abcdeinorst   .,\nüß漢😀E") for _ in range(rng.randint(1, 200))) for _ in range(600)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text[:80]
        assert codec.decode(ids) == text


def test_lattice_equals_merging(codec):
    for word in [*LONG.split()[:500], "inter", "antidisestablishment", "the,", "aaaaaaaaaaaaa"]:
        assert codec.encode([word])[0].tolist() == codec.merge(sentencepiece_codec.BLANK + word), word


def test_encoding_odd_rows(spark, odd, none):
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(odd)).collect()
    assert len(rows) == odd.count()
    assert all(r.decoded == (r.text or "") and r.n_tokens == len(r.ids) for r in rows)
    assert sentencepiece_codec.encode(none).count() == 0


# 5 HTML


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'><nav><ul><li><a href=/x>menu</a></ul></nav>"
    "<div class=ad>buy</div><div class='post-17 entry'><h1>Head &amp; more</h1><p>One\n two<br>three<p>Caf&eacute; &#8364; <b>bold</b></p>"
    "<aside>side</aside><form>form</form><script>if (a < b) { '</p>' }</script><div id=comments><p>reader said</p></div></div>"
    "<div class='cookie-notice'>cookies</div><footer>foot</footer><!-- gone --></body></html>"
)


def test_main_text_of_a_page():
    assert html_extract.extract(PAGE, None) == "Head & more\nOne two three\nCafé € bold"


@pytest.mark.parametrize("open_, close", [
    ("<div class='wrap has-sidebar'>", "</div>"), ("<div id=page class='no-menu'>", "</div>"), ("<form id=x>", "</form>"), ("<div class='sidebar-page widget'>", "</div>"),
    ("<div role=banner><form><div class=social>", "</div></form></div>"), ("<div class=menu-open><main>", "</main></div>"),
])
def test_names_and_forms_do_not_silence_an_article(open_, close):
    rest = "<div class=sidebar><p>aside text</p></div><div id=comments><p>" + "a reader said much more than the author did " * 9 + "</p></div><div class=related><article><p>other</p></article></div>"
    body = "<article><h1>Title</h1><p>The text of the article stands here.</p><form><label>mail</label><input></form></article>"
    assert html_extract.extract(f"<html><body>{open_}{body}{close}{rest}</body></html>", None) == "Title\nThe text of the article stands here."


def test_votes_equal_plain_counts(spark):
    pages = common.read(spark, DATA, "pages")
    votes = collections.defaultdict(lambda: collections.defaultdict(float))
    for r in pages.select("html", html_extract.host_of().alias("host")).collect():
        found = html_extract.scores(r.html or "")
        top = max((s for _, s in found), default=0)
        for p, s in found:
            if s >= html_extract.VOTE_SHARE * top:
                votes[r.host][p] += s / top
    want = {h: max(v, key=lambda p: (round(v[p], 6), p)) for h, v in votes.items()}
    assert {r.host: r.path for r in html_extract.host_paths(pages).collect()} == want


def test_hosts_agree_on_a_path_and_odd_pages_fall_back(spark):
    short = "<html><body class='has-sidebar'><div class='post-3 entry'><p>tiny</p></div><div class=box><p>" + "elsewhere long text " * 5 + "</p></div></body></html>"
    pages = [(i, "http://h.example.com/1", PAGE) for i in range(5)] + [
        (5, "http://h.example.com/2", short), (6, None, "<p>alone"), (7, "http://x.org/", None), (8, "http://x.org/", ""), (9, "odd", "no tags & all"), (0, "http://h.example.com/1", PAGE),
        (10, "http://h.example.com/3", "<article><p>" + "long " * 40_000 + "</p></article>"), (11, "http://h.example.com/4", "<a title='open><p>x"),
    ]
    rows = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("path", F.lit("clash"))).collect()}
    assert rows[0].text == "Head & more\nOne two three\nCafé € bold" and rows[0].n_chars == len(rows[0].text)
    assert rows[5].text == "tiny"  # the host's winning path
    assert rows[6].text == "alone" and rows[7].text == rows[8].text == "" and rows[9].text == "no tags & all"
    assert rows[10].n_chars == 5 * 40_000 - 1
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 6 quality rules


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_rule_counts_equal_plain_python(spark, odd, none):
    rng = random.Random(7)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(["a ", "b ", "c\n", "#", "\x0b", "é", " ", "same line\n", ""]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for text, *got in zip(texts, *quality_rules.rule_counts(texts).values(), strict=True):
        assert tuple(int(x) for x in got) == plain_rules(text), text[:80]
    rows = quality_rules.quality_rules(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality_rules.quality_rules(none).count() == 0


def plain_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries: log probability of a character after a context, for one language."""
    order = quality_rules.ORDER
    sym = lambda t: [0] * (order - 1) + quality_rules.symbols(np.array([ord(c) for c in t], np.int64)).tolist()
    tables = {order: collections.Counter()}
    for t in texts:
        s = sym(t)
        tables[order].update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    discount, context = {}, {}
    for k, table in tables.items():
        t = [sum(n == i for n in table.values()) for i in range(5)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + t[2] else 0.5
        d = [0] + [min(max(i - (i + 1) * y * t[i + 1] / t[i], 0.1), i) if t[i] else 0.5 for i in (1, 2, 3)]
        discount[k] = d
        context[k] = collections.defaultdict(lambda: [0, 0.0])
        for g, n in table.items():
            context[k][g[:-1]][0] += n
            context[k][g[:-1]][1] += d[min(n, 3)]

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / 4096
        if g[:-1] not in context[k]:
            return below
        total, off = context[k][g[:-1]]
        n = tables[k].get(g, 0)
        return max(n - discount[k][min(n, 3)], 0) / total + off / total * below

    def surprise(t):
        s = sym(t)
        return -np.mean([np.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))])

    return surprise, p


def test_perplexity_and_verdict_equal_plain_python(spark):
    rng = random.Random(12)
    word = {lang: [rng.choice(["ka", "lo", "мир", "дом", "té", "漢字"]) + rng.choice("abcé漢я") for _ in range(30)] for lang in ("x", None)}
    texts = [(lang, " ".join(rng.choice(word[lang]) for _ in range(rng.randint(0, 60)))) for lang in ("x", None) for _ in range(60)]
    texts += [("x", "".join(rng.choice("qzw#$%") for _ in range(200))), ("x", " ".join("".join(rng.sample("миродя", 5)) for _ in range(60)))]
    rows = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    whole = {r.doc_id: r for r in quality_rules.quality_rules(rows).collect()}
    parts = {r.doc_id: r for r in quality_rules.quality_rules(rows.unionByName(rows), model_rows=700, block_chars=900).dropDuplicates(["doc_id"]).collect()}
    for lang in ("x", None):
        own = [(i, t) for i, (x, t) in enumerate(texts) if x == lang]
        for found, times in ((whole, 1), (parts, 2)):
            surprise, p = plain_model([t for _, t in own] * times)
            want = {i: surprise(t) for i, t in own if t}
            for i, t in own:
                assert (found[i].perplexity is None) == (not t)
                assert not t or abs(np.log(found[i].perplexity) - want[i]) < 1e-4
            values = sorted(want.values())
            q1, q3 = (values[int(np.ceil(len(values) * q)) - 1] for q in (0.25, 0.75))
            for i, t in own:
                width = quality_rules.BAND * (q3 - q1) * np.sqrt(1 + 1500 / max(1, len(t)))
                n = len(t.split())
                assert found[i].kept == (n >= 20 and not found[i].base_failed and q1 - width <= want[i] <= q3 + width), (i, t)
        gram = tuple(quality_rules.symbols(np.array([ord(c) for c in "kaa "], np.int64)).tolist()[1 - quality_rules.ORDER :])
        assert abs(sum(p((*gram, c)) for c in range(4096)) - 1) < 1e-6
    assert not whole[121].base_failed and not whole[121].kept and whole[0].kept  # letters of the language, words of none


# 7 decontamination


def test_masks_hit_every_placement_of_substitutions():
    for n in range(1, 41):
        need = int(np.ceil(decontaminate.MIN_SHARE * min(n, decontaminate.WINDOW)))
        window = min(n, decontaminate.WINDOW)
        masks = decontaminate.masks_for(n)
        places = [[p + i for i, bit in enumerate(m) if bit == "1"] for m in masks for p in range(window - len(m) + 1)]
        for off in itertools.combinations(range(window), window - need):
            assert any(not set(off) & set(p) for p in places), (n, off)


def plain_overlaps(texts, items):
    """Every alignment of every text with every item, by loops."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            a, b = split(t), split(item)
            need = min(16, len(b))
            for shift in range(-len(b) + 1, len(a)):
                e = [a[p] == b[p - shift] for p in range(max(0, shift), min(len(a), shift + len(b)))]
                best = max((sum(e[k : k + min(need, len(e))]) for k in range(len(e) - min(need, len(e)) + 1)), default=0)
                if b and best >= 0.8 * need:
                    old = out.get((i, j), (0, 0))
                    out[i, j] = (max(old[0], sum(e)), max(old[1], best))
    return out


def test_overlaps_equal_all_alignments(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(60)}"
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20, 30, 45)]
    texts = []
    for _ in range(120):
        item = rng.choice(items).split()
        k = len(item) * rng.choice((0, 0.1, 0.19, 0.25))
        for at in rng.sample(range(len(item)), int(k)):
            item[at] = word()
        item = item[rng.choice((0, 0, 1, 3)) :]
        texts.append(" ".join([*(word() for _ in range(rng.randint(0, 9))), *item, *(word() for _ in range(rng.randint(0, 9)))]))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for most in (2_000_000, 0):
        got = {(r.doc_id, r.item_id): (r.n_equal, r.best_window) for r in decontaminate.overlaps(docs(spark, texts), benchmark, most, most).collect()}
        assert got == plain_overlaps(texts, items)


def test_substitutions_do_not_hide_a_benchmark_item(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(30)]
    changed = list(item)
    changed[7] = changed[22] = "other"
    noise = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{noise(20)} {' '.join(item).upper()}! {noise(20)}", f"{noise(5)} {' '.join(changed)}", noise(200), f"{noise(9)} {' '.join(item[:6])} {noise(9)}", None, "", LONG]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, ""), (3, None), (None, "x y"), (1, " ".join(item)), (4, "two words")], "item_id long, text string")
    rows = docs(spark, texts)
    found = {(r.doc_id, r.item_id): (r.n_equal, r.n_item) for r in decontaminate.overlaps(rows, benchmark).collect()}
    assert found == {(0, 1): (30, 30), (1, 1): (28, 30)}
    kept = decontaminate.decontaminate(rows.unionByName(docs(spark, [" ".join(item)], [None])), benchmark)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (2, 3, 4, 5, 6)] + [(True, 0)]
    shuffled = decontaminate.overlaps(rows, benchmark, 0, 0)
    assert {(r.doc_id, r.item_id) for r in shuffled.collect()} == {(0, 1), (1, 1)}
    assert decontaminate.overlaps(rows, benchmark.where("false")).count() == 0 == decontaminate.overlaps(rows.where("false"), benchmark).count()


# 8 passages


def test_repeated_lines_keep_the_earliest(spark, odd, none):
    line = "this passage has  more than eight words in it, really"
    texts = [f"own start of the text\n{line}\nown end", f"{line.upper()}\n {line}\t\n{line}", "short line\nshort  line", None, "", f"é😀\n{line.replace('  ', ' ')}"]
    rows = {r.doc_id: r for r in substring_dedup.removed_spans(docs(spark, texts)).collect()}
    cut = {i: [texts[i][s.start : s.stop] for s in rows[i].spans] for i in rows}
    assert cut == {0: [], 1: [texts[1]], 2: ["short  line"], 3: [], 4: [], 5: [texts[5].split("\n")[1]]}
    assert rows[1].n_units == 3 and rows[1].removed_chars == len(texts[1]) and rows[1].passage_words == 30
    done = {r.doc_id: r for r in substring_dedup.dedup_passages(docs(spark, texts)).collect()}
    assert done[0].text == texts[0] and done[1].text == "" and done[5].text == "é😀" and done[3].text is None and len(done[5].removed_spans) == 1
    assert substring_dedup.removed_spans(odd).count() == odd.count() and substring_dedup.removed_spans(none).count() == 0
    assert substring_dedup.dedup_passages(odd).count() == odd.count() and set(substring_dedup.dedup_passages(none).columns) == {*none.columns, "removed_spans"}


def plain_gone(texts):
    """(text, word) of every word in a line or 50-word run that stands earlier, by dictionaries alone."""
    first, out, split = {}, set(), {}
    for i, t in enumerate(texts):
        words, at = [], 0
        for line in (t or "").split("\n"):
            own = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
            if own and first.setdefault(tuple(own), (i, at)) != (i, at):
                out |= {(i, at + k) for k in range(len(own))}
            words, at = words + own, at + len(own)
        split[i] = words
    runs = {}
    for i, words in split.items():
        for k in range(len(words) - 49):
            d, p = runs.setdefault(tuple(words[k : k + 50]), (i, k))
            if d < i or k - p >= 50:
                out |= {(i, k + x) for x in range(50)}
    return out


def test_passages_inside_lines_equal_plain_python(spark, monkeypatch):
    rng = random.Random(11)
    passages = [" ".join(f"P{rng.randrange(90)}" for _ in range(n)) for n in (49, 50, 51, 60, 90, 140)]
    texts = []
    for i in range(40):
        own = [f"w{rng.randrange(10_000)}" for _ in range(rng.randint(0, 60))]
        own.insert(rng.randint(0, len(own)), rng.choice(passages))
        own.insert(rng.randint(0, len(own)), rng.choice(["\n", "\n\n", "\nsame line\n", rng.choice(passages)]))
        texts.append(" ".join(own))
    texts += ["a " * 120, "b c " * 70, None]
    for most_ids, hot in ((1000, 1000), (0, 3)):  # broadcast; shuffled, with hot keys split
        monkeypatch.setattr(substring_dedup, "MAX_BROADCAST_IDS", most_ids)
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        rows = substring_dedup.removed_spans(docs(spark, texts)).collect()
        got = set()
        for r in rows:
            places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")]
            got |= {(r.doc_id, k) for k, (a, b) in enumerate(places) for s in r.spans if s.start <= a and b <= s.stop}
        assert got == plain_gone(texts)
    assert sum(r.has_passage for r in rows) > 15


# 9 URL filters


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_entries_hold_from_their_date_until_the_next(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    entries = [
        ("l", "a.org", 1, "2024-01-10 00:00:00", "block"), ("l", "a.org", 2, "2024-02-10 00:00:00", "remove"), ("l", "www.a.org", 3, "2024-01-20 00:00:00", "allow"),
        ("l", "a.org", 4, "2024-03-01 00:00:00", "block"), ("m", "a.org", 5, "2024-03-05 00:00:00", "allow"), ("l", "http://b.org/x", 6, "2020-01-01 00:00:00", "block"),
        ("l", None, 7, "2020-01-01 00:00:00", "block"), ("l", "a.org", 8, None, "block"), ("l", "c.org", 9, "2024-01-01 00:00:00", "block"), ("l", "c.org", 10, "2024-01-01 00:00:00", "allow"),
    ]
    captures = [
        (1, "http://a.org/", "2024-01-09 23:59:59", "none"), (2, "https://u@A.org:80/p", "2024-01-10 00:00:00", "block"), (3, "http://x.a.org", "2024-02-09 00:00:00", "block"),
        (4, "http://www.a.org/", "2024-01-25 00:00:00", "allow"), (5, "http://a.org/", "2024-02-10 00:00:00", "none"), (6, "http://a.org/", "2024-03-02 00:00:00", "block"),
        (7, "http://a.org/", "2024-03-06 00:00:00", "allow"), (8, "http://b.org/x", "2024-03-06 00:00:00", "block"), (9, None, "2024-03-06 00:00:00", "none"), (10, "odd", "2024-03-06 00:00:00", "none"),
        (11, "http://a.org/", None, "none"), (12, "http://nota.org/", "2024-01-15 00:00:00", "none"), (13, "http://c.org/", "2024-01-15 00:00:00", "allow"), (1, "http://a.org/", "2024-01-09 23:59:59", "none"),
    ]
    e = spark.createDataFrame(entries, "list string, key string, entry_id long, at string, action string").withColumn("at", F.to_timestamp("at"))
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at string, want string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    for most in (1000, 0):  # broadcast, and salted shuffle
        found = {r.page_id: r.verdict for r in url_filter.judge(c, e, max_broadcast=most).collect()}
        assert found == {p: want for p, _, _, want in captures}
    assert {r.verdict for r in url_filter.judge(c, e.where("false")).collect()} == {"none"} and url_filter.judge(c.where("false"), e).count() == 0


# 10 lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text) + 1)
        kind = rng.randrange(3)
        if kind == 0 or not text:
            text.insert(at, rng.choice("xyzé😀"))
        elif kind == 1:
            del text[min(at, len(text) - 1)]
        else:
            text[min(at, len(text) - 1)] = rng.choice("xyzé😀")
    return "".join(text)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(spark, tau):
    rng = random.Random(tau)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 40)))
        pairs.append((a, changed(rng, a, rng.randint(0, 5)) if a else "b"))
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within(F.col("a"), F.col("b"), tau).alias("w")).collect():
        assert r.w == (edits(r.a, r.b) <= tau), (r.a, r.b)


def plain_removed(rows, tau, shortest):
    places = [(d, i, line) for d, t in rows for i, line in enumerate((t or "").split("\n")) if len(line) >= shortest]
    return {(d, i) for d, i, line in places if any((e, j) < (d, i) and (o == line or edits(o, line) <= tau) for e, j, o in places)}


def test_removed_lines_equal_all_pairs(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(18, 45))) for _ in range(12)]
    lines = base + [changed(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(70)]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)] + [None, "", lines[0], "short\nshort"]
    found = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(docs(spark, texts), 2, 20).collect()}
    assert found == plain_removed(list(enumerate(texts)), 2, 20) and len(found) > 20


@pytest.mark.parametrize("broadcast_ids", [1_000_000, 0])
def test_hot_lines_and_segments_lose_no_pair(spark, monkeypatch, broadcast_ids):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_IDS", broadcast_ids)
    rng = random.Random(5)
    # one template, so that nearly all lines share its segments, and one line that is everywhere
    lines = [f"order number {rng.randint(100, 999)} was shipped on {rng.randint(10, 99)} May" for _ in range(60)]
    texts = [f"{line}\nthe line that stands everywhere\n}}" for line in lines]
    found = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(docs(spark, texts), 2, 11, 1).collect()}
    rows = list(enumerate(texts))
    assert found == plain_removed(rows, 2, 11) | {(i, 2) for i in range(1, len(texts))}
    assert 0 < len({i for i, line in found if line == 0}) < len(texts) - 1


@pytest.mark.parametrize("column", ["key", "place"])
def test_sifted_rows_are_few_and_hold_every_match(spark, column):
    kind = "bigint" if column == "key" else "decimal(31,0)"
    rows = spark.range(20_000).select((F.col("id") * 7919 - 5000).cast(kind).alias(column), F.col("id").alias("_bits"), F.col("id").alias("_Block"))
    wanted = rows.where("_bits % 40 = 3").select(column)
    left = common.sifted(rows, wanted, column)
    assert left.schema == rows.schema and wanted.join(left, column, "left_anti").count() == 0
    assert wanted.count() <= left.count() < 2 * wanted.count()
    assert common.sifted(rows, wanted.limit(0), column).count() == 0 and left.subtract(rows).count() == 0


def test_keys_and_texts_beyond_broadcasts_are_sifted_before_they_are_joined(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_IDS", 0)
    shuffled = {}
    split_join = line_dedup.split_join

    def counted(rows, groups, keys, times):
        shuffled[tuple(keys)] = rows.count()
        return split_join(rows, groups, keys, times)

    monkeypatch.setattr(line_dedup, "split_join", counted)
    rng = random.Random(12)
    lines = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(60)) for _ in range(300)]
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, 300, 3)] + [lines[0] + "!", lines[7][1:], "own line of this text only\n" + lines[9]]
    found = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(docs(spark, texts), 2, 20).collect()}
    assert found == {(100, 0), (101, 0), (102, 1)}
    # of fifteen keys for each of 303 distinct lines, only those of the two pairs are dealt out
    assert shuffled[("key",)] < 100


def test_texts_beyond_broadcasts_are_sifted_before_they_are_joined(spark, monkeypatch):
    rows = line_dedup._keyed(line_dedup.line_rows(docs(spark, [f"line {i} of many\nline {i % 7} of few" for i in range(500)])))
    ids = rows.where("doc_id % 50 = 3 and line_no = 0").select("id", "id2", "place").distinct()
    want = {(r.doc_id, r.line) for r in line_dedup._first_rows(rows, ids).collect()}
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_IDS", 0)
    found = line_dedup._first_rows(rows, ids)
    assert {(r.doc_id, r.line) for r in found.collect()} == want == {(i, f"line {i} of many") for i in range(3, 500, 50)}
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert "place" in joins[0] and "_word" in joins[1]


def test_short_lines_go_in_query_and_stage(spark, tmp_path):
    texts = ["own first line of this text\nReleased under the MIT License.\nOK\n\nend a", "Released under the MIT License!\nsome own words stand here\nOK\n\nno", "OK\nOk\nReleased under the MIT License."]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = {0: "", 1: "0,2", 2: "0,2"}
    assert {r.doc_id: r.removed_lines for r in line_dedup.query(spark, str(tmp_path)).collect()} == want
    done = {r.doc_id: r.text for r in pipeline.lines(spark, docs(spark, texts), str(tmp_path)).collect()}
    assert done == {0: texts[0], 1: "some own words stand here\n\nno", 2: "Ok"}


def test_lines_of_odd_rows(spark, odd, none):
    done = {r.doc_id: r for r in line_dedup.dedup_lines(odd).collect()}
    assert {i: r.text for i, r in done.items()} == {**dict(enumerate(ODD)), None: "null id"}
    long_twice = docs(spark, [LONG, LONG + "!", "own\n" + LONG])
    assert [(r.doc_id, r.text == "own", r.n_chars) for r in line_dedup.dedup_lines(long_twice).orderBy("doc_id").collect()] == [(0, False, None), (2, True, 3)]
    assert line_dedup.dedup_lines(none).count() == 0
    with pytest.raises(ValueError):
        line_dedup.removed_lines(odd, 3, 10)


# queries and pipeline


@pytest.mark.parametrize("module", [decontaminate, substring_dedup, url_filter])
def test_twin(spark, module):
    same(module.query(spark, DATA), module.SQL, DATA)


def test_repeated_chunks_are_looked_up_once():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load_pieces())
    chunks, place, size = codec._chunks(["one two one two", "", "two \U0001f600 é"])
    assert len(chunks) == len(set(chunks)) < len(place) == size.sum() and size[1] == 0
    whole = ["".join(chunks[i] for i in part) for part in np.split(place, np.cumsum(size)[:-1])]
    assert whole == ["▁one▁two▁one▁two", "", "▁two▁\U0001f600▁é"]


def test_pipeline_stages_take_effect(spark):
    out = pipeline.run(spark, DATA).collect()
    assert out and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    assert len({r.doc_id for r in out}) == len(out)
    rows = common.read(spark, DATA, "documents")
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, rows, DATA)
        assert after.columns == rows.columns and 0 < after.count() <= rows.count()
    none = rows.where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0


def test_stages_of_odd_rows_equal_plain_python(spark, odd):
    texts = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    kept = {name: stage(spark, odd, DATA) for name, stage in pipeline.STAGES}
    assert all(kept[name].columns == odd.columns for name, _ in pipeline.STAGES[:-1])
    scores = {(r.doc_id, r.score >= 0.5) for r in quality_classifier.score(odd, common.read(spark, DATA, "labels")).collect()}
    assert {r.doc_id for r in kept["quality_classifier"].collect()} == {i for i, good in scores if good}
    places = [(i, k, x) for i, t in texts.items() for k, x in enumerate((t or "").split("\n")) if x]
    near = lambda a, b: min(len(a), len(b)) >= line_dedup.NEAR_CHARS and max(len(a), len(b)) < 1000 and edits(a, b) <= line_dedup.TAU
    gone = {(i, k) for i, k, x in places if any((e, j) < (i, k) and (o == x or near(o, x)) for e, j, o in places)}
    assert {(r.doc_id, r.text) for r in kept["line_dedup"].collect()} == {
        (i, t if not any(d == i for d, _ in gone) else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in texts.items()
        if not t or any((i, k) not in gone for k in range(t.count("\n") + 1))
    } | {(None, "null id")}
    ids = sorted(texts)
    groups = {ids[i] for i in plain_kept([texts[i] for i in ids])}
    assert {r.doc_id for r in kept["simhash_near_dedup"].collect()} == groups | {None}
    items = [r.text for r in common.read(spark, DATA, "benchmark").collect()]
    short = {i: t for i, t in texts.items() if t != LONG}
    hit = {list(short)[i] for i, _ in plain_overlaps(list(short.values()), items)}
    assert {r.doc_id for r in kept["benchmark_decontamination"].collect()} == set(texts) - hit | {None}
    assert all(r.round_trip for r in kept["sentencepiece_encoding"].collect()) and kept["sentencepiece_encoding"].count() == odd.count()
