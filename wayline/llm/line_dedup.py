"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

A line within ``tau`` edits of another, cut into tau + 1 segments, shares at least one whole segment
with it near the same place. Every distinct line is indexed under (length, segment number, segment) and
probes the lengths from its own down to ``tau`` less at the start positions that the multi-match rule
leaves. Both are one 64-bit key, so that the join moves pairs of longs. Candidates are verified by a
bit-parallel recurrence over the 2 tau + 1 diagonals of the band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import HOT_ROWS, MOST_HOT, cut, fits_broadcast, free_name, read, sifted, split_join

#: Edits between two lines that count as the same, and the fewest characters of a line that takes part.
TAU, MIN_CHARS = 2, 40
#: The query and the pipeline's stage: the fewest characters of a line that is compared with its near ones (``shortest``
#: of the edits) and of one that goes where an equal one stands earlier.
NEAR_CHARS, EQUAL_CHARS = 11, 1
#: Keys of more than one line, and lines whose text is fetched: up to so many (32 MB) are broadcast; of more, a
#: Bloom filter is, and the rows that pass it are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
# Characters, of one byte each, whose counts are compared before two lines are paired.
LETTERS = "abcdefghijklmnopqrstuvwxyz .,0123456789"


def _segment(length: Column, i: int, tau: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``i`` (from 0) of a line: the first ones are the shorter ones."""
    k = tau + 1
    short = F.floor(length / k).cast("int")
    n_short = F.lit(k) - length % k
    start = F.lit(1) + F.lit(i) * short + F.greatest(F.lit(0), F.lit(i) - n_short)
    return start.cast("int"), (short + (F.lit(i) >= n_short).cast("int")).cast("int")


def wide(line: Column) -> Column:
    """The line at four bytes a character: a substring of it is a copy, where UTF-8 has to be scanned."""
    return F.encode(line, "UTF-32")


def _key(chars: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), chars.substr(start * 4 - 3, size * 4))


def shortest(tau: int) -> int:
    """Characters from which every segment is longer than the moves that are tried."""
    return (tau + 1) * (tau + 1) + tau


def index_keys(chars: Column, n: Column, tau: int = TAU) -> Column:
    """Keys a line of ``n`` characters, given as ``wide``, is found under."""
    return F.array(*[_key(chars, n, i, *_segment(n, i, tau)) for i in range(tau + 1)])


def probe_keys(chars: Column, n: Column, tau: int = TAU) -> Column:
    """Keys under which every line of the same length or up to ``tau`` less, within ``tau`` edits, can be found.

    Lines of ``shortest(tau)`` characters or more: none of the places falls outside the line.
    """
    keys = []
    for less in range(tau + 1):
        length = n - F.lit(less)
        for i in range(tau + 1):
            start, size = _segment(length, i, tau)
            for move in range(max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1):
                keys.append(_key(chars, length, i, start + F.lit(move), size))
    return F.array(*keys)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; a plain Column would be worked out at every use."""
    return F.transform(F.array(value), body)[0]


def _trimmed(pair: Column, level: int, levels: int) -> Column:
    """Struct (a, b, m) without common ends: pieces of m / 2, m / 4, ... characters go from either end where they are
    equal, which never changes an edit distance and leaves m / 2^levels equal characters at most; m is the shorter length."""

    def once(p: Column) -> Column:
        size = F.shiftright(p["m"], (level + 1) // 2)
        same = p["a"].substr(F.lit(1), size) == p["b"].substr(F.lit(1), size)
        rest = [F.reverse(F.when(same, p[c].substr(size + 1, F.char_length(p[c]))).otherwise(p[c])).alias(c) for c in "ab"]
        return F.struct(*rest, p["m"].alias("m"))  # turned round, so that steps take the two ends by turns

    return _let(pair, once if level == 2 * levels else lambda p: _trimmed(once(p), level + 1, levels))


def _banded(p: Column, tau: int) -> Column:
    width = 2 * tau + 1
    full = (1 << width) - 1
    na, nb = F.size(p["a"]), F.size(p["b"])
    # before the first character, the cell s characters ahead takes s insertions
    start = [sum(1 << (tau + s) for s in range(e + 1)) for e in range(tau + 1)]

    def step(state: Column, j: Column) -> Column:
        match = F.lit(0)
        for d in range(width):
            same = F.get(p["b"], j + F.lit(d - tau - 1)) == F.get(p["a"], j - F.lit(1))
            match = match.bitwiseOR(F.when(same, F.lit(1 << d)).otherwise(F.lit(0)))

        def move(m: Column) -> Column:
            out: list[Column] = []
            for e in range(tau + 1):
                new = state[f"r{e}"].bitwiseAND(m)
                if e:
                    old = state[f"r{e - 1}"]
                    inserted = F.shiftleft(out[e - 1], 1).bitwiseAND(F.lit(full))
                    new = new.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(inserted)
                out.append(new)
            return F.struct(*[c.alias(f"r{e}") for e, c in enumerate(out)])

        return _let(match, move)

    first = F.struct(*[F.lit(m).alias(f"r{e}") for e, m in enumerate(start)])
    steps = F.when(na > 0, F.sequence(F.lit(1), na)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(steps, first, step)[f"r{tau}"]
    goal = F.get(F.array(*[F.lit(1 << d) for d in range(width)]), nb - na + F.lit(tau))
    return F.coalesce(last.bitwiseAND(goal) != 0, F.lit(False))


def _chars(s: Column) -> Column:
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def within(a: Column, b: Column, tau: int = TAU, trim_levels: int = 7) -> Column:
    """True if ``a`` and ``b`` are within ``tau`` edits.

    Bit-parallel over the band: mask e holds a bit for each of the 2 tau + 1 diagonals whose cell is
    reachable with e edits after a character of ``a``; a step is a handful of shifts and ands.
    """
    pair = F.struct(a.alias("a"), b.alias("b"), F.least(F.char_length(a), F.char_length(b)).alias("m"))
    chars = lambda p: F.struct(_chars(p["a"]).alias("a"), _chars(p["b"]).alias("b"))
    return _let(_trimmed(pair, 1, trim_levels), lambda p: _let(chars(p), lambda q: _banded(q, tau)))


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line."""
    return docs.select("doc_id", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def _place() -> Column:
    """One number that sorts like (doc_id, line_no): hash aggregation can hold it, a struct it could not."""
    return F.col("doc_id").cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col("line_no")


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with their place and ``id``, ``id2``: two hashes, 128 bits together, that stand for the line."""
    return rows.select(
        F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"), _place().alias("place"), "doc_id", "line_no", "line"
    )


def _equal_lines(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, line_no) of lines that equal an earlier one of ``rows``, grouped by hash; hot lines are split."""
    keyed = _keyed(rows).drop("line")
    first = keyed.groupBy("id", "id2").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1")
    return split_join(keyed, first, ["id", "id2"], "times").where("place > first").select("doc_id", "line_no")


def removed_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, equal_chars: int | None = None) -> DataFrame:
    """Rows (doc_id, line_no) of lines that repeat an earlier one within ``tau`` edits.

    Earlier means a smaller (doc_id, line_no); a line goes if any line of another place that is equal or
    within ``tau`` edits stands earlier, kept itself or not. Lines under ``min_chars`` characters only go
    where they have ``equal_chars`` or more (none have where it is None) and an equal one stands earlier.
    Rows with a null doc_id never take part. Null and empty texts have no lines, an empty table gives no rows, and
    lines of any length are compared whole. doc_id holds whole numbers, of any type; other ids raise ``CAST_INVALID_INPUT``.
    """
    if min_chars < shortest(tau):
        raise ValueError(f"lines of under {shortest(tau)} characters are too short for {tau} edits")
    every = line_rows(docs.where("doc_id is not null"))
    near = _near_lines(every.where(F.char_length("line") >= min_chars), tau)
    if equal_chars is None or equal_chars >= min_chars:
        return near
    short = every.where((F.char_length("line") >= equal_chars) & (F.char_length("line") < min_chars))
    return near.unionByName(_equal_lines(short))


def _shared_keys(distinct: DataFrame, tau: int) -> DataFrame:
    """Rows (id, key, own) of the keys of more than one line of ``distinct`` (id, own, probes).

    Nearly all keys belong to one line; they go by a grouped minimum and maximum, which every task works out for its own
    rows first, so that a segment of very many lines is no task's load.
    """
    either = distinct.select("id", F.posexplode(F.concat("own", "probes")).alias("at", "key")).select("id", "key", (F.col("at") <= tau).alias("own"))
    keys = either.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("times")).where("low <> high")
    keys = cut(keys.select("key", "times"))
    if fits_broadcast(keys, MAX_BROADCAST_IDS):
        return cut(either.join(F.broadcast(keys.select("key")), "key", "left_semi"))
    return cut(split_join(sifted(either, keys, "key"), keys, ["key"], "times").drop("times"))


def _first_rows(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``keyed`` at the places of ``ids`` (id, id2, place; a line once)."""
    at = ["id", "id2", "place"]
    if fits_broadcast(ids, MAX_BROADCAST_IDS):
        return keyed.join(F.broadcast(ids), at)
    return sifted(keyed, ids, "place").join(ids, at)  # a left semi join would be moved below the filter


def _met(found: DataFrame, asked: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join on ``key`` with a cell of the grid that ``hot`` (key, p, q) gives a hot key.

    The found lines of a hot key are dealt over p rows of cells and stand in all q columns, those that ask over q columns
    and stand in all p rows: any two meet in exactly one cell, and a cell holds a bounded number of either.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    one = lambda line, n: F.pmod(F.xxhash64(F.lit(2), line), F.coalesce(F.col(n), F.lit(1))).cast("int")
    sides = []
    for side, line, down, across in ((found, "x", one("x", "p"), every("q")), (asked, "y", every("p"), one("y", "q"))):
        sides.append(side.join(F.broadcast(hot), "key", "left").withColumn("down", down).withColumn("across", across).drop("p", "q"))
    return sides[0], sides[1]


def _near_lines(rows: DataFrame, tau: int) -> DataFrame:
    both = ["id", "id2"]
    keyed = _keyed(rows)
    wider = keyed.select(*both, "place", wide(F.col("line")).alias("chars")).withColumn("n", (F.octet_length("chars") / 4).cast("int"))
    distinct = cut(
        wider.groupBy(*both).agg(
            F.min("place").alias("first"), F.count("*").alias("times"),
            F.first(index_keys(F.col("chars"), F.col("n"), tau)).alias("own"), F.first(probe_keys(F.col("chars"), F.col("n"), tau)).alias("probes"),
        )
    )
    shared = _shared_keys(distinct, tau)
    # the text of a line is read where it stands first, so that a line that is everywhere is fetched once
    ids = shared.select("id").distinct()
    ids = cut(distinct.select(*both, F.col("first").alias("place")).join(ids, "id", "left_semi"))
    texts = _first_rows(keyed, ids).groupBy(*both).agg(F.first("line").alias("line"), F.min("place").alias("first"))
    counts = F.array(*[(F.octet_length("line") - F.octet_length(F.replace("line", F.lit(c), F.lit("")))).cast("int") for c in LETTERS])
    texts = cut(texts.withColumn("letters", counts).withColumn("n", F.char_length("line")))
    # A substitution moves two counts by one, an insertion or deletion one: lines of one key are only paired where
    # their counts allow for tau edits, and lines of one length only one way round.
    sizes = cut(shared.groupBy("key").agg(F.count_if("own").alias("p"), F.count_if(~F.col("own")).alias("q")).where("p > 0 and q > 0"))
    total = sizes.agg(F.sum(F.col("p") + F.col("q"))).first()[0] or 0
    size = max(HOT_ROWS, total // MOST_HOT)
    hot = sizes.where((F.col("p") > size) | (F.col("q") > size)).select("key", *[F.ceil(F.col(c) / size).cast("int").alias(c) for c in "pq"])
    bags = shared.join(texts.select(*both, "letters", "n"), "id")
    found = bags.where("own").select("key", F.col("id").alias("x"), F.col("id2").alias("x2"), F.col("letters").alias("lx"), F.col("n").alias("nx"))
    asked = bags.where("not own").select("key", F.col("id").alias("y"), F.col("id2").alias("y2"), F.col("letters").alias("ly"), F.col("n").alias("ny"))
    found, asked = _met(found, asked, hot)
    apart = sum((F.abs(F.col("lx")[i] - F.col("ly")[i]) for i in range(len(LETTERS))), F.lit(0))
    later = (F.col("y") > F.col("x")) | ((F.col("y") == F.col("x")) & (F.col("y2") > F.col("x2")))
    once = (F.col("ny") > F.col("nx")) | ((F.col("ny") == F.col("nx")) & later)
    at = [asked[c] == found[c] for c in ("key", "down", "across")]
    pairs = asked.join(found, [*at, once, apart <= 2 * tau - F.col("ny") + F.col("nx")])
    sides = cut(pairs.select("x", "x2", "y", "y2").distinct())
    for side in ("x", "y"):
        ends = texts.select(F.col("id").alias(side), F.col("id2").alias(f"{side}2"), F.col("line").alias(f"l{side}"), F.col("first").alias(f"f{side}"))
        sides = sides.join(ends, [side, f"{side}2"])
    close = sides.where(within(F.col("lx"), F.col("ly"), tau))
    ends = F.when(F.col("fx") < F.col("fy"), F.struct(F.col("y").alias("id"), F.col("y2").alias("id2"))).otherwise(F.struct(F.col("x").alias("id"), F.col("x2").alias("id2")))
    late = close.select(ends.alias("end")).select("end.*").distinct().withColumn("late", F.lit(True))
    bad = (
        distinct.select(*both, "first", "times").join(late, both, "left")
        .where("late or times > 1").select(*both, "first", "times", F.coalesce("late", F.lit(False)).alias("late"))
    )
    gone = split_join(keyed.drop("line"), bad, both, "times")
    return gone.where(F.col("late") | (F.col("place") > F.col("first"))).select("doc_id", "line_no")


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, equal_chars: int | None = None) -> DataFrame:
    """``docs`` with repeated lines cut out of ``text`` (and ``n_chars`` set anew where it exists).

    A document that had text and loses all of its lines goes. Null and empty texts stay as they are, as do
    documents without a repeated line; repeated rows are equal lines of one doc_id and are treated alike.
    doc_id holds whole numbers, of any type; other ids raise ``CAST_INVALID_INPUT``.
    """
    name = free_name(docs, "gone")
    cut_lines = F.col(name)
    gone = removed_lines(docs, tau, min_chars, equal_chars).groupBy("doc_id").agg(F.collect_set("line_no").alias(name))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(cut_lines, i))
    out = docs.join(gone, "doc_id", "left").where(cut_lines.isNull() | (F.size(kept) > 0))
    out = out.withColumn("text", F.when(cut_lines.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut_lines.isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go, and their numbers."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    gone = removed_lines(docs, TAU, NEAR_CHARS, EQUAL_CHARS).groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    lines = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    return lines.join(gone, "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    )
