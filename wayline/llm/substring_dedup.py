"""Passages that repeat anywhere in the corpus: equal lines by hash, and equal runs of 50 words inside or across lines.

Lines are normalised (ASCII lower case, words joined by one space), their digests grouped over all documents
and the earliest occurrence by (doc_id, place) kept. Lines alone miss a passage that begins or ends inside a
line, so runs of WORDS words are units too, wherever they begin. Hashing every run would multiply the corpus;
instead windows of ANCHOR words are thinned by winnowing, which chooses at least one in every WORDS words by
its content alone: a passage that stands in two places holds the same anchors in both. Only runs around an
anchor that occurs twice are hashed, grouped and removed, word for word, in offsets of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import cut, fits_broadcast, free_name, read, split_join
from wayline.llm.vectext import Block, blocks, mix

#: Words of a run that is a unit, and of the windows that are thinned: one is chosen in WORDS - ANCHOR + 1 of them.
WORDS, ANCHOR = 50, 25
#: Ids of documents that are broadcast to fetch their texts, and joined by shuffle beyond.
MAX_BROADCAST_IDS = 1_000_000

_C1, _C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Words:
    """Words of texts laid end to end: hash, text, line (counted over all texts), begin and end of each."""

    def __init__(self, texts: list[str]):
        b = Block(texts)
        b.cp = np.where((b.cp >= 65) & (b.cp <= 90), b.cp + 32, b.cp)
        space = b.space()
        self.n, self.block = b.n, b
        self.begin = b.begins(space)
        self.hash = b.hashes(self.begin, space)
        self.doc = b.doc[self.begin]
        before = np.concatenate(([True], space[:-1])) if len(space) else space
        closing = np.flatnonzero(space & ~before) if len(space) else np.zeros(0, np.int64)
        stops = np.sort(np.concatenate((closing, (b.start + b.size)[b.size > 0])))
        self.end = stops[np.searchsorted(stops, self.begin, "right")] if len(stops) else stops
        newline = np.cumsum(b.cp == 10)
        self.line = newline[self.begin] + self.doc if len(self.begin) else self.begin
        self.first_line = np.concatenate(([0], newline))[b.start] + np.arange(b.n)
        self.first_word = np.searchsorted(self.doc, np.arange(b.n))
        self.n_words = np.bincount(self.doc, minlength=b.n)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all runs of ``size`` words of one text, and two 64-bit hashes of each."""
        count = len(self.hash) - size + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros((2, 0), np.uint64)
        h, g, other = np.zeros(count, np.uint64), np.zeros(count, np.uint64), mix(self.hash)
        for k in range(size):
            h = h * _C1 + self.hash[k : k + count]
            g = g * _C2 + other[k : k + count]
        at = np.flatnonzero(self.doc[:count] == self.doc[size - 1 :])
        return at, np.stack((mix(h[at]), mix(g[at])))

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first words of all lines that have one, and two hashes of each line."""
        if not len(self.line):
            return np.zeros(0, np.int64), np.zeros((2, 0), np.uint64)
        at = np.flatnonzero(np.concatenate(([True], self.line[1:] != self.line[:-1])))
        within = (np.arange(len(self.line)) - np.repeat(at, np.diff(np.append(at, len(self.line))))).astype(np.uint64)
        sums = [np.add.reduceat(mix(h + within * c) * c, at) for h, c in ((self.hash, _C1), (mix(self.hash), _C2))]
        return at, np.stack([mix(s) for s in sums])


def _slide(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``size`` consecutive elements."""
    have, out = 1, x
    while have < size:
        step = min(have, size - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the chosen windows: the smallest hash of every WORDS - ANCHOR + 1 neighbours, ties included."""
    at, (h, _) = w.windows(ANCHOR)
    k = WORDS - ANCHOR + 1
    edge = np.full(k - 1, np.iinfo(np.uint64).max, np.uint64)
    least = _slide(np.concatenate((edge, h, edge)), k, np.minimum)
    chosen = (_slide(least, k, np.maximum) == h) & (w.n_words[w.doc[at]] >= WORDS)
    return at[chosen], h[chosen]


def _own(at: np.ndarray, hashes: np.ndarray, doc: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """For units of texts: index of the first equal unit of the same text, and whether one ``apart`` or more before is equal."""
    key = mix(hashes[0] ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, bool)
    first = np.empty(len(key), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else order
    return first, at - at[first] >= apart


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_UNITS = "doc_id long, text_key long, pos int, stays boolean, again boolean, h1 long, h2 long"


def _rows(w: Words, ids: np.ndarray, keys: np.ndarray, at: np.ndarray, hashes: np.ndarray, apart: int, stays: np.ndarray) -> pd.DataFrame:
    """One row per text and distinct unit: the place of the first, whether one of them ``stays``, and whether a later one does."""
    doc = w.doc[at]
    first, late = _own(at, hashes, doc, apart)
    again, any_ = np.zeros(len(at), bool), np.zeros(len(at), bool)
    again[first[late & stays]] = True
    any_[first[stays]] = True
    one = first == np.arange(len(at))
    d = doc[one]
    return pd.DataFrame({
        "doc_id": ids[d], "text_key": keys[d], "pos": (at[one] - w.first_word[d]).astype(np.int32), "stays": any_[one], "again": again[one],
        "h1": _signed(hashes[0][one]), "h2": _signed(hashes[1][one]),
    })


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Words, np.ndarray, np.ndarray, pd.DataFrame]]:
    for b in batches:
        for first, texts in blocks(b["text"].tolist()):
            part = b.iloc[first : first + len(texts)]
            yield Words(texts), part["doc_id"].to_numpy(np.int64), part["text_key"].to_numpy(np.int64), part


def _line_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for w, ids, keys, _ in _batches(batches):
        at, hashes = w.lines()
        yield _rows(w, ids, keys, at, hashes, 1, np.ones(len(at), bool))


def _anchor_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per text: places and hashes of its anchors, and the places at which its lines begin."""
    for w, ids, keys, _ in _batches(batches):
        at, h = anchors(w)
        begin = w.lines()[0]
        local = lambda x: x - w.first_word[w.doc[x]]
        cuts = [np.searchsorted(w.doc[x], np.arange(w.n + 1)) for x in (at, begin)]
        part = lambda x, i, c: x[c[i] : c[i + 1]]
        used = np.flatnonzero(np.diff(cuts[0]))
        if not len(used):
            continue
        pos, h, begin = local(at).astype(np.int32), _signed(h), local(begin).astype(np.int32)
        yield pd.DataFrame({
            "doc_id": ids[used], "text_key": keys[used], "places": [part(pos, i, cuts[0]) for i in used],
            "hashes": [part(h, i, cuts[0]) for i in used], "begins": [part(begin, i, cuts[1]) for i in used],
        })


def _stays(begins: np.ndarray, lines: np.ndarray | None, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether words ``start`` to ``stop`` of a text reach into a line that stays; a line's later repeats count as lines that stay."""
    coded = np.zeros(0, np.int64) if lines is None else np.asarray(lines, np.int64)
    kept = np.concatenate(([0], np.cumsum(~np.isin(begins, coded[coded & 1 == 1] >> 1))))
    return kept[np.searchsorted(begins, stop - 1, "right")] > kept[np.searchsorted(begins, start, "right") - 1]


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per anchor: whether runs that hold it reach into a line that stays, and whether its text also holds it twice."""
    for b in batches:
        stay, again = [], []
        for places, hashes, begins, lines in zip(b["places"], b["hashes"], b["begins"], b["lines"], strict=True):
            # every run that holds the anchor is looked at: a line that stays may lie beside the anchor
            stay.append(_stays(begins, lines, np.maximum(places - (WORDS - ANCHOR), 0), places + WORDS))
            _, which, n = np.unique(hashes, return_inverse=True, return_counts=True)
            again.append((n[which] > 1) & stay[-1])
        if stay:
            n = np.fromiter(map(len, stay), np.int64, len(stay))
            yield pd.DataFrame({
                "doc_id": np.repeat(b["doc_id"].to_numpy(), n), "text_key": np.repeat(b["text_key"].to_numpy(), n),
                "pos": np.concatenate(b["places"].tolist()), "h1": np.concatenate(b["hashes"].tolist()), "stays": np.concatenate(stay), "again": np.concatenate(again),
            })


def _window_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of WORDS words that hold one of the text's repeated anchors."""
    for w, ids, keys, part in _batches(batches):
        at, hashes = w.windows(WORDS)
        edge = np.zeros(len(w.hash) + 1, np.int64)
        for i, places in enumerate(part["places"]):
            pos = w.first_word[i] + np.asarray(places, np.int64)
            np.add.at(edge, np.maximum(pos - (WORDS - ANCHOR), 0), 1)
            np.add.at(edge, np.minimum(pos + 1, len(w.hash)), -1)
        near = np.cumsum(edge)[at] > 0
        at, hashes, stays = at[near], hashes[:, near], np.zeros(int(near.sum()), bool)
        begin = w.lines()[0]
        lines, cuts = np.searchsorted(w.doc[begin], np.arange(w.n + 1)), np.searchsorted(w.doc[at], np.arange(w.n + 1))
        for i, coded in enumerate(part["lines"]):
            own = slice(cuts[i], cuts[i + 1])
            pos = at[own] - w.first_word[i]
            stays[own] = _stays(begin[lines[i] : lines[i + 1]] - w.first_word[i], coded, pos, pos + WORDS)
        yield _rows(w, ids, keys, at, hashes, WORDS, stays)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


_OPEN = "last_stay > first or again > 0"


def _late() -> list:
    return [F.max(F.when(F.col("stays"), F.col("doc_id"))).alias("last_stay"), F.max(F.col("again").cast("int")).alias("again")]


def _repeats(rows: DataFrame, name: str) -> DataFrame:
    """doc_id, text_key and ``name``: places of units of which a later one stays, times two, plus one where the unit goes.

    Units that lie in lines that go count as earlier ones, but are not marked themselves.
    """
    keys = [f"{name}_h1", f"{name}_h2"]
    rows = rows.withColumnsRenamed(dict(zip(["h1", "h2"], keys, strict=True)))
    first = rows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.count("*").alias("times"), *_late())
    met = split_join(rows.where("stays").select("doc_id", "text_key", "pos", *keys), first.where(_OPEN).select(*keys, "first", "times"), keys, "times")
    coded = F.col("pos") * 2 + (F.col("first") < F.col("doc_id")).cast("int")
    return met.groupBy("doc_id", "text_key").agg(F.collect_set(coded).alias(name))


def repeated_units(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lines, runs: places of the units that stand elsewhere too, coded as in ``_repeats``.

    Runs are only looked for where they can change a word's fate: around anchors of which some occurrence but
    the first reaches into a line that stays. All others lie in lines that go, or are the first of their kind.
    """
    texts = _keyed(docs)
    key = ["doc_id", "text_key"]
    lines = cut(_repeats(texts.mapInPandas(_line_units, _UNITS), "lines"))
    lists = texts.mapInPandas(_anchor_lists, "doc_id long, text_key long, places array<int>, hashes array<long>, begins array<int>")
    chosen = cut(lists.join(lines, key, "left").mapInPandas(_anchor_rows, "doc_id long, text_key long, pos int, h1 long, stays boolean, again boolean"))
    met = chosen.groupBy("h1").agg(F.min("doc_id").alias("first"), F.count("*").alias("times"), *_late())
    open_ = met.where(_OPEN).select("h1", "times")
    hits = cut(split_join(chosen.select(*key, "pos", "h1"), open_, ["h1"], "times").groupBy(*key).agg(F.collect_set("pos").alias("places")))
    ids = hits.select(*key)
    some = texts.join(F.broadcast(ids), key, "left_semi") if fits_broadcast(ids, MAX_BROADCAST_IDS) else texts
    some = some.join(hits, key).join(lines, key, "left").dropDuplicates(key)
    runs = _repeats(some.mapInPandas(_window_units, _UNITS), "runs")
    return cut(lines.join(runs, key, "full"))


def _places(coded: pd.Series, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of repeated units, counted over all texts of ``w``, and which of those units go."""
    held = [(w.first_word[i], np.asarray(c, np.int64)) for i, c in enumerate(coded) if c is not None and len(c)]
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate([first + (c >> 1) for first, c in held]), np.concatenate([c & 1 == 1 for _, c in held])


def _runs(marked: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of marked words of one text."""
    inner = marked[1:] & marked[:-1] & (doc[1:] == doc[:-1])
    return np.flatnonzero(marked & np.concatenate(([True], ~inner))), np.flatnonzero(marked & np.concatenate((~inner, [True])))


def spans_of(texts: list[str], lines: pd.Series, runs: pd.Series) -> list[tuple[list[tuple[int, int]], int, int]]:
    """Per text: spans that go, words of the longest of them, and words of the longest run that stands elsewhere too."""
    w = Words(texts)
    if not len(w.hash):
        return [([], 0, 0)] * w.n
    gone, seen = np.zeros(len(w.hash) + 1, np.int64), np.zeros(len(w.hash) + 1, np.int64)
    for coded, unit, apart in ((lines, Words.lines, 1), (runs, lambda w: w.windows(WORDS), WORDS)):
        places, go = _places(coded, w)
        if not len(places):
            continue
        at, hashes = unit(w)
        stop = np.append(at[1:], len(w.hash)) if apart == 1 else at + WORDS
        first, late = _own(at, hashes, w.doc[at], apart)
        known, goes = np.zeros(len(w.hash), bool), np.zeros(len(w.hash), bool)
        known[places] = True
        goes[places[go]] = True
        known, goes = known[at[first]], goes[at[first]]
        for total, units in ((gone, known & (goes | late)), (seen, known)):
            np.add.at(total, at[units], 1)
            np.add.at(total, stop[units], -1)
    a, b = _runs(np.cumsum(gone)[:-1] > 0, w.doc)
    c, d = _runs(np.cumsum(seen)[:-1] > 0, w.doc)
    longest, shared = np.zeros(w.n, np.int64), np.zeros(w.n, np.int64)
    np.maximum.at(longest, w.doc[a], b - a + 1)
    np.maximum.at(shared, w.doc[c], d - c + 1)
    starts, stops = w.begin[a] - w.block.start[w.doc[a]], w.end[b] - w.block.start[w.doc[a]]
    edges = np.searchsorted(w.doc[a], np.arange(w.n + 1))
    pairs = list(zip(starts.tolist(), stops.tolist(), strict=True))
    return [(pairs[edges[i] : edges[i + 1]], int(longest[i]), int(shared[i])) for i in range(w.n)]


def _found(text: pd.Series, lines: pd.Series, runs: pd.Series) -> list[tuple[list[tuple[int, int]], int, int]]:
    out = []
    for first, texts in blocks(text.tolist()):
        part = slice(first, first + len(texts))
        out += spans_of(texts, lines.iloc[part], runs.iloc[part])
    return out


_SPAN = "array<struct<start:int,stop:int>>"


def _joined(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``docs`` with the coded places of each row's text, as ``names``: its id, its key, its lines, its runs."""
    found = repeated_units(docs).toDF(*names)
    return docs.join(found, (docs["doc_id"].cast("long") == found[names[0]]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found[names[1]]), "left")


def removed_spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_units (lines), n_removed (spans), removed_chars, spans (array of
    struct (start, stop)), passage_words (words of the longest span), has_passage (that is WORDS or more) and
    shares_passage (WORDS or more words in a row that stand in another place too, the one kept included;
    of runs, those count of which a later one reaches into a line that is no repeat of another text's).

    A line with a word goes if an equal one stands at a smaller (doc_id, place); so does a run of WORDS words,
    unless the two overlap. Spans are code points of the original text from the first to past the last word of
    neighbouring words that go. Null and empty texts, and rows with a null doc_id, lose nothing; rows that
    repeat an id are alike and never earlier than each other; ties cannot occur, as places differ; extra
    columns are ignored; an empty table gives an empty result. Texts of any length are worked on whole.
    """
    rows = _joined(docs.select("doc_id", "text"), ("_id", "_key", "lines", "runs"))
    touched = F.col("_id").isNotNull()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = _found(b["text"], b["lines"], b["runs"])
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_units": b["n_units"],
                "spans": [[{"start": s, "stop": e} for s, e in spans] for spans, _, _ in found],
                "passage_words": [n for _, n, _ in found], "seen": [n for _, _, n in found],
            })

    n_units = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    slim = rows.select(F.col("doc_id").cast("string").alias("doc_id"), n_units.alias("n_units"), F.when(touched, F.coalesce("text", F.lit(""))).alias("text"), "lines", "runs")
    done = slim.mapInPandas(measure, f"doc_id string, n_units long, spans {_SPAN}, passage_words long, seen long")
    return done.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_units", F.size("spans").cast("long").alias("n_removed"),
        F.aggregate("spans", F.lit(0), lambda a, s: a + s["stop"] - s["start"]).cast("long").alias("removed_chars"), "spans",
        "passage_words", (F.col("passage_words") >= WORDS).alias("has_passage"), (F.col("seen") >= WORDS).alias("shares_passage"),
    )


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without its spans, and without the lines that lose every word by it."""
    parts, at = [], 0
    for s, e in spans:
        parts += [text[at:s], "\x00" if "\x00" not in text else ""]
        at = e
    left = "".join([*parts, text[at:]])
    if "\x00" in text:
        return left
    return "\n".join(line.replace("\x00", "") for line in left.split("\n") if "\x00" not in line or line.replace("\x00", "").strip(" \t\r\f\v"))


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` and their original spans in ``removed_spans`` (an existing
    column of that name is replaced). Null texts stay null; the other cases are those of ``removed_spans``.
    doc_id holds whole numbers, of any type; other ids raise ``CAST_INVALID_INPUT``."""
    docs = docs.drop("removed_spans")
    names = tuple(free_name(docs, n) for n in ("r_id", "r_key", "r_lines", "r_runs"))
    rows = _joined(docs, names)

    @F.pandas_udf(f"text string, spans {_SPAN}")
    def cut_out(text: pd.Series, lines: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out, spans = [], []
        for t, (found, _, _) in zip(text, _found(text, lines, runs), strict=True):
            out.append(_without(t, found) if found else t)
            spans.append([{"start": s, "stop": e} for s, e in found])
        return pd.DataFrame({"text": out, "spans": spans})

    name = free_name(docs, "r_done")
    done = rows.withColumn(name, cut_out("text", names[2], names[3]))
    return done.select(*[F.col(f"{name}.text").alias(c) if c == "text" else F.col(c) for c in docs.columns], F.col(f"{name}.spans").alias("removed_spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``removed_spans`` of all documents, spans as text (start:stop, joined by commas); its docstring defines every case."""
    found = removed_spans(read(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", "n_units", "n_removed", "removed_chars", text.alias("spans"), "passage_words", "has_passage", "shares_passage")


SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
u as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as line_no from d),
o as (select *, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) as base from u),
lower as (select *, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as plain from o),
p as (select *, regexp_extract_all(plain, '[ \\t\\r\\f\\x0B]+|[^ \\t\\r\\f\\x0B]+') as parts from lower),
x as (select doc_id, line_no, base, unnest(parts) as part, unnest(range(0, len(parts))) as part_no from p where len(parts) > 0),
y as (select *, base + cast(coalesce(sum(length(part)) over (partition by doc_id, line_no order by part_no rows between unbounded preceding and 1 preceding), 0) as bigint) as start from x),
w as (select doc_id, line_no, part as word, start, row_number() over (partition by doc_id order by line_no, part_no) - 1 as pos
  from y where not regexp_matches(part, '^[ \\t\\r\\f\\x0B]')),
l as (select doc_id, line_no, min(pos) as pos, max(pos) + 1 as stop, string_agg(word, ' ' order by pos) as unit from w group by doc_id, line_no),
lr as (select doc_id, pos, stop, count(*) over (partition by unit) as times, row_number() over (partition by unit order by doc_id, pos) as rn,
  min(doc_id) over (partition by unit) < doc_id and min(pos) over (partition by unit, doc_id) = pos as other from l),
kw as (select doc_id, unnest(range(pos, stop)) as pos, case when other then 0 else 1 end as stays from lr),
ks as (select doc_id, pos, max(stays) over (partition by doc_id order by pos rows between current row and {WORDS - 1} following) = 1 as stays from kw),
a as (select doc_id, list(word order by pos) as words from w group by doc_id having count(*) >= {WORDS}),
r as (select doc_id, pos, array_to_string(words[pos + 1:pos + {WORDS}], ' ') as unit
  from (select doc_id, words, unnest(range(0, len(words) - {WORDS - 1})) as pos from a)),
rl as (select r.*, first_doc < doc_id or pos - own >= {WORDS} as late, stays
  from (select *, min(doc_id) over (partition by unit) as first_doc, min(pos) over (partition by unit, doc_id) as own from r) r join ks using (doc_id, pos)),
rm as (select *, bool_or(late and stays) over (partition by unit) and bool_or(stays) over (partition by unit, doc_id) as live from rl),
marks as (
  select doc_id, pos, stop, rn > 1 as goes from lr where times > 1
  union all select doc_id, pos, pos + {WORDS}, late from rm where live),
gone as (select distinct doc_id, unnest(range(pos, stop)) as pos from marks where goes),
seen as (select distinct doc_id, unnest(range(pos, stop)) as pos from marks),
runs as (select doc_id, min(pos) as a, max(pos) as b from (select *, pos - row_number() over (partition by doc_id order by pos) as run from gone) group by doc_id, run),
seen_runs as (select doc_id, max(n) as n from (select doc_id, count(*) as n from (select *, pos - row_number() over (partition by doc_id order by pos) as run from seen) group by doc_id, run) group by doc_id),
spans as (select g.doc_id, x.start as start, z.start + length(z.word) as stop, g.b - g.a + 1 as n
  from runs g join w x on x.doc_id = g.doc_id and x.pos = g.a join w z on z.doc_id = g.doc_id and z.pos = g.b),
s as (select doc_id, count(*) as n_removed, cast(sum(stop - start) as bigint) as removed_chars,
  string_agg(start || ':' || stop, ',' order by start) as spans, max(n) as passage_words from spans group by doc_id)
select d.doc_id, cast(len(string_split(d.text, chr(10))) as bigint) as n_units, coalesce(n_removed, 0) as n_removed, coalesce(removed_chars, 0) as removed_chars,
  coalesce(spans, '') as spans, coalesce(passage_words, 0) as passage_words, coalesce(passage_words, 0) >= {WORDS} as has_passage,
  coalesce(n, 0) >= {WORDS} as shares_passage
from d left join s using (doc_id) left join seen_runs using (doc_id)
"""
