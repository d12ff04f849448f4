"""Personal data: patterns for what has a form, and information content for what gives it away.

Four patterns find e-mail addresses, IP addresses, card and phone numbers; secrets (keys, tokens, passwords)
are found by the information in their characters or by an assignment to a telling name. The values found and
their kinds are the protected entities. Over the whole corpus it is counted how many documents hold a term,
and in how many it stands near an entity. From that follows how many bits of uncertainty about the entity
are left to a reader who sees the term: with few left the term is generalised, with fewer removed, wherever
in the corpus it occurs.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import cut, fits_broadcast, read

#: Kinds in the order that breaks ties of start: the base patterns, then those of the method.
KINDS = ("email", "ip", "card", "phone", "secret", "general", "remove")
#: Bits of uncertainty about an entity that a term may leave at most to be generalised, and to be removed.
GENERALISE_BITS, REMOVE_BITS = 1.0, 0.33
#: Bits that a term must tell at least: what most documents hold anyway is not disclosed by a word.
LEAST_BITS = 2.0
#: Documents without the entity that every term is credited with, so that few observations prove little.
PRIOR = 3
#: Context of an entity: so many words on either side, within so many characters.
WINDOW_WORDS, WINDOW_CHARS = 8, 400
#: A string of this many characters or more, with letters and digits, is a secret from so many bits on.
SECRET_CHARS, SECRET_BITS = 16, 48.0
#: Telling terms, and ids of documents that hold them, that are broadcast; joined by shuffle beyond.
MAX_BROADCAST_TERMS, MAX_BROADCAST_IDS = 1_000_000, 1_000_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A digit run that does not match from its first digit does not match from a later one either.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TERM = re.compile(r"[^\W_]{3,}")
_RUN = re.compile(r"[A-Za-z0-9_-]{16,}")
_ASSIGNED = re.compile(r"(?i)(?:passwd|password|secret|token|api[_-]?key)[\"']?[ \t]*[=:][ \t]*([\"']?)([^\s\"']{6,})\1")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the valid base matches, sorted."""
    out: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:  # from each @ outwards: what the pattern's leftmost match gives, in linear time
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(v) <= 3 and int(v or "0") <= 255 for v in (p.lstrip("0") for p in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Spans:
    """Spans (start, kind, end) sorted by start, asked for those that overlap a stretch without a look at the others."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.spans, self.starts = spans, [s for s, _, _ in spans]
        self.reach = list(itertools.accumulate((e for _, _, e in spans), max))  # the furthest end up to each span

    def near(self, start: int, end: int) -> list[tuple[int, int, int]]:
        held = self.spans[bisect.bisect_right(self.reach, start) : bisect.bisect_left(self.starts, end)]
        return [x for x in held if x[2] > start]


def bits(value: str) -> float:
    """Information in a string's characters, by their own frequencies."""
    n = len(value)
    return -sum(c * math.log2(c / n) for c in Counter(value).values())


def secret_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of secrets that overlap no base match, sorted."""
    found = [(m.start(), m.end()) for m in _RUN.finditer(text) if _secret(m[0])] + [m.span(2) for m in _ASSIGNED.finditer(text)]
    out: list[tuple[int, int, int]] = []
    known = Spans(base)
    for s, e in sorted(found):
        if not known.near(s, e) and not (out and s < out[-1][2]):
            out.append((s, KINDS.index("secret"), e))
    return out


def _secret(run: str) -> bool:
    if len(run) < SECRET_CHARS or not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
        return False
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(run, run[1:], strict=False))
    return turns >= 4 and bits(run) >= SECRET_BITS


def entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value if kind > 3 else value.lower() if kind < 2 else _NOT_DIGIT.sub('', value)}"


def context(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """(entity, term) of the words near every span, outside all spans; entities are the value and its kind."""
    out: dict[tuple[str, str], dict] = {}
    known = Spans(spans)
    for start, kind, end in spans:
        name = entity(kind, text[start:end])
        low, high = max(0, start - WINDOW_CHARS), min(len(text), end + WINDOW_CHARS)
        left = [m for m in _TERM.finditer(text, low, start) if m.start() > low or low == 0]
        right = [m for m in _TERM.finditer(text, end, high) if m.end() < high or high == len(text)]
        for m in (*left[-WINDOW_WORDS:], *right[:WINDOW_WORDS]):
            if not known.near(m.start(), m.end()):
                for e in (name, KINDS[kind]):
                    out[e, m[0].lower()] = {"entity": e, "term": m[0].lower()}
    return list(out.values())


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


_BASE = (
    "doc_id string, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<start:int,kind:int,end:int>>, context array<struct<entity:string,term:string>>, entities array<string>"
)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, key, text in zip(b["doc_id"], b["text_key"], b["text"], strict=True):
            spans = base_spans(text)
            n = [sum(1 for s in spans if s[1] == k) for k in range(4)]
            base_sha256 = digest(spans)
            spans = sorted([*spans, *secret_spans(text, spans)])
            entities = {e for s, k, t in spans for e in (entity(k, text[s:t]), KINDS[k])}
            rows.append((doc_id, key, *n, base_sha256, [dict(start=s, kind=k, end=e) for s, k, e in spans], context(text, spans), sorted(entities)))
        yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "context", "entities"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _words(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and term_key: one row per document and distinct word, and one with a null word for texts without."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    spread = _keyed(docs).select("doc_id", "text_key", F.explode_outer(words).alias("term"))
    return spread.select("doc_id", "text_key", F.xxhash64("term").alias("term_key"))


def disclosures(docs: DataFrame, scanned: DataFrame, n_docs: int) -> DataFrame:
    """(term, entity, left): terms that leave at most GENERALISE_BITS of uncertainty about an entity, and how many.

    A document with the term holds the entity near it with probability n_both / (n_term + PRIOR), a bound that
    few observations keep low. ``left`` is its negative binary logarithm; the term tells the difference to what
    a document without knowledge of the term leaves.
    """
    near = scanned.where(F.size("context") > 0).select("doc_id", "text_key", F.explode("context").alias("c"))
    together = near.select("c.entity", "c.term").groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    # fewer than PRIOR documents leave more than a bit even where every document with the term has the entity
    together = together.where(F.col("n_both") >= PRIOR).withColumn("term_key", F.xxhash64("term"))
    entities = scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    # Words are counted before they meet the candidates: a row for each word and task, whatever the candidates are.
    counted = _words(docs).groupBy("term_key").agg(F.count("*").alias("n_term"))
    bonds = together.join(entities, "entity").join(counted, "term_key", "left")
    n_term = F.greatest("n_both", F.coalesce("n_term", F.lit(0)))
    left = -F.log2(F.col("n_both") / (n_term + PRIOR))
    own = -F.log2(F.col("n_entity") / F.lit(float(n_docs)))
    return bonds.select("term", "entity", left.alias("left"), own.alias("own")).where((F.col("left") <= GENERALISE_BITS) & (F.col("own") - F.col("left") >= LEAST_BITS)).drop("own")


def _term_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        added = []
        for text, terms, base in zip(b["text"], b["terms"], b["base"], strict=True):
            kinds = {t["term"]: t["kind"] for t in terms}
            spans = [(m.start(), m.end()) for m in _TERM.finditer(text) if m[0].lower() in kinds]
            taken = Spans([(s["start"], s["kind"], s["end"]) for s in base])
            added.append([{"start": s, "kind": kinds[text[s:e].lower()], "end": e} for s, e in spans if not taken.near(s, e)])
        yield pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "added": added})


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts and digest of the base matches and ``found``, an array of
    struct (start, kind, end) with secrets and the terms that tell, sorted; kind is an index into KINDS.

    Null and empty texts hold nothing; a null doc_id stays; repeated rows are found alike and count each time;
    spans of one start are sorted by kind; texts of any length are read whole; other columns are ignored; an
    empty table gives an empty result. Offsets are code points, the end exclusive.
    """
    key = ["doc_id", "text_key"]
    scanned = cut(_keyed(docs).mapInPandas(_scan, _BASE))
    strong = disclosures(docs, scanned, max(1, scanned.count())).groupBy("term").agg(F.min("left").alias("left"))
    kind = F.when(F.col("left") <= REMOVE_BITS, KINDS.index("remove")).otherwise(KINDS.index("general"))
    strong = cut(strong.select("term", F.xxhash64("term").alias("term_key"), kind.alias("kind")))
    listed = F.broadcast(strong) if fits_broadcast(strong, MAX_BROADCAST_TERMS) else strong
    told = _words(docs).join(listed, "term_key").groupBy(*key).agg(F.collect_set(F.struct("term", "kind")).alias("terms"))
    told = cut(told.withColumn("_id", F.coalesce("doc_id", F.lit(""))))  # a null id is found again by its text
    ids = told.select("_id", "text_key")
    texts = _keyed(docs).withColumn("_id", F.coalesce("doc_id", F.lit(""))).drop("doc_id")
    if fits_broadcast(ids, MAX_BROADCAST_IDS):
        texts = texts.join(F.broadcast(ids), ["_id", "text_key"], "left_semi")
    base = scanned.select(F.coalesce("doc_id", F.lit("")).alias("_id"), "text_key", "base").dropDuplicates(["_id", "text_key"])
    marked = texts.dropDuplicates(["_id", "text_key"]).join(told, ["_id", "text_key"]).join(base, ["_id", "text_key"])
    added = marked.select(*key, "text", "terms", "base").mapInPandas(_term_spans, f"doc_id string, text_key long, added {_SPANS}")
    added = added.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "added")
    joined = scanned.join(added, scanned["doc_id"].eqNullSafe(added["_id"]) & (scanned["text_key"] == added["_key"]), "left")
    both = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPANS))))
    out = joined.withColumn("found", both)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        *[count(k) for k in KINDS[4:]], "found",
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rewritten: base matches and secrets as [KIND], terms generalised to [WORD] or [NUMBER] or removed.

    Null texts stay null; all other cases are those of ``find``.
    """

    def rewrite(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, found, strict=True):
            if spans is None or not len(spans):
                out.append(text)
                continue
            parts, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    word = text[s["start"] : s["end"]]
                    kind = KINDS[s["kind"]]
                    shown = "" if kind == "remove" else (("[NUMBER]" if word.isdigit() else "[WORD]") if kind == "general" else f"[{kind.upper()}]")
                    parts += [text[at : s["start"]], shown]
                    at = s["end"]
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out)

    found = find(docs).where(F.size("found") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "found").dropDuplicates(["_id", "_key"])
    on = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_key"])
    joined = docs.join(found, on, "left")
    text = F.pandas_udf(rewrite, T.StringType())(docs["text"], found["found"])
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``find`` of all documents, spans as text; ``private`` is true where personal data or a secret was found."""
    found = find(read(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    span = F.transform("found", lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    own = F.exists("found", lambda s: s["kind"] <= KINDS.index("secret"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(span, ",").alias("spans"),
        "n_secret", "n_general", "n_remove", own.alias("private"),
    )
