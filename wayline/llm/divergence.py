"""Source divergence audit by one-hot level products.

1. One pass over the texts counts terms by (language, source), occurrences and documents, added up in Spark.
2. A term's count in a source is its level there. Terms of a language are dealt over blocks; in a block every (source,
   level) is an indicator column, and the product of this 0/1 matrix with its transpose, blocked and exact, holds the joint
   table of every two sources: how many terms have level x in one and level y in the other.
3. A joint table's cells are priced by the divergence of the two levels' probabilities and added up. A block returns one
   sum for each two sources; Spark adds these. Common terms, of many levels, stand in smaller blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.llm.common import cut, fits_broadcast, read

#: Documents of a language that must hold a term, ranks of the terms reported, and the unit of probabilities.
MIN_DOCS, TOP_TERMS, UNIT = 10, 10, 1_000_000_000
#: Terms of a block at most, and of a block of common terms at least.
BLOCK_TERMS, LEAST_TERMS = 1024, 64
#: Indicator columns of one side of a product, pairs of sources that a task adds up before it hands them on, and bytes of text counted at once.
COLUMNS, HELD, BLOCK_BYTES = 2048, 1_000_000, 32_000_000
#: (language, source) groups that are broadcast; joined by shuffle beyond.
MAX_BROADCAST_GROUPS = 100_000
#: Largest count whose product with UNIT fits a long.
MOST = 9_000_000_000

# What parts terms: all ASCII characters but letters.
_GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of consecutive slices of about BLOCK_BYTES; a longer text is a slice of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > BLOCK_BYTES:
            yield first, texts.slice(first, i - first)
            first, held = i, 0
        held += int(size)
    if len(sizes) > first:
        yield first, texts.slice(first)


def _counted(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, texts): terms of all ``texts``, added up over those of one ``group``."""
    words = pc.split_pattern_regex(pc.ascii_lower(texts), _GAPS)
    doc, flat = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words).dictionary_encode()
    names, code = flat.dictionary, flat.indices.to_numpy()
    size = max(1, len(names))
    own, times = np.unique(doc.astype(np.int64) * size + code, return_counts=True)  # one entry for each text and term
    own_key = group[own // size] * size + own % size
    key, back, docs = np.unique(own_key, return_inverse=True, return_counts=True)
    n = np.bincount(back, weights=times, minlength=len(key)).astype(np.int64)
    # texts that begin or end with a gap have empty words there
    word = names.take(pa.array(key % size))
    good = pc.not_equal(word, "").to_numpy(zero_copy_only=False)
    return (key // size)[good], word.filter(pa.array(good)), n[good], docs[good]


def count_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, total, held): terms in ``min_docs`` documents of a language or more, with their occurrences in it and in
    each of its sources, an array of (source, n); a term '' holds all sources of the language, with or without terms.

    One shuffle by language and term serves both sums; a task hands on one row for each term and source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            both = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
            pair, group = np.unique(both, return_inverse=True)
            at = [pa.array(x) for x in (pair // max(1, len(source.dictionary)), pair % max(1, len(source.dictionary)))]
            names = [d.dictionary.take(x) for d, x in zip((lang, source), at, strict=True)]
            parts = [(np.arange(len(pair)), pa.array([""] * len(pair), pa.string()), np.bincount(group, minlength=len(pair)), np.bincount(group, minlength=len(pair)))]
            parts += [_counted(texts, group[first : first + len(texts)]) for first, texts in _blocks(batch.column("text"))]
            for own, term, n, held in parts:
                own = pa.array(own)
                yield pa.RecordBatch.from_pydict({"lang": names[0].take(own), "source": names[1].take(own), "term": term, "n": pa.array(n, pa.int64()), "docs": pa.array(held, pa.int64())})

    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = text.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    own = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = own.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held"))
    return held.where((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs")


def prices(level: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The probability of each count in a source of ``total`` kept occurrences, in whole billionths, from 1 on."""
    if level.max(initial=0) > MOST:
        return np.array([1 + UNIT * (int(c) + 2) // (total + 2 * kept) for c in level], np.int64)
    return 1 + UNIT * (level + 2) // (total + 2 * kept)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def priced_pairs(counts: np.ndarray, totals: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first source, second source, sum of divergences) over the rows of ``counts`` (terms by sources), first < second."""
    n, m = counts.shape
    column = np.empty((n, m), np.int64)
    owner, price = [], []
    at = 0
    for g in range(m):
        level, column[:, g] = np.unique(counts[:, g], return_inverse=True)
        column[:, g] += at
        at += len(level)
        owner.append(np.full(len(level), g))
        price.append(prices(level, int(totals[g]), kept))
    owner, price = np.concatenate(owner), np.concatenate(price)
    sums = np.zeros(m * m, np.int64)
    # single precision is exact here: a product's cells count terms, BLOCK_TERMS or a few more
    sides = []
    for low in range(0, at, COLUMNS):
        width = min(COLUMNS, at - low)
        rows, groups = np.nonzero((column >= low) & (column < low + width))
        one_hot = np.zeros((n, width), np.float32)
        one_hot[rows, column[rows, groups] - low] = 1
        sides.append((low, one_hot))
    for i, (a, left) in enumerate(sides):
        for b, right in sides[i:]:
            joint = left.T @ right
            x, y = np.nonzero(joint)
            times = joint[x, y].astype(np.int64)
            x, y = x + a, y + b
            own = owner[x] < owner[y]
            x, y, times = x[own], y[own], times[own]
            np.add.at(sums, owner[x] * m + owner[y], times * divergence(price[x], price[y]))
    first, second = np.triu_indices(m, 1)
    return first, second, sums[first * m + second]


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, h, value): the divergence of every two sources, numbered within their language, g < h.

    ``kept`` (lang, term, total, held) and ``groups`` (lang, source, g, total, kept).
    """
    size = F.greatest(F.lit(LEAST_TERMS), F.floor(F.lit(BLOCK_TERMS) / F.pow(F.lit(2), F.greatest(F.lit(0), F.col("height") - 6)))).cast("long")
    high = kept.withColumn("height", F.floor(F.log2("total")).cast("int"))
    # of one language and height as many blocks as its terms fill; a table of a few dozen rows a language
    parts = high.groupBy("lang", "height").agg(F.count("*").alias("_n")).select("lang", "height", F.ceil(F.col("_n") / size).alias("_parts"))
    dealt = high.join(parts, ["lang", "height"]).withColumn("block", F.pmod(F.xxhash64("term"), "_parts"))
    blocks = dealt.groupBy("lang", "height", "block").agg(F.collect_list("held").alias("held"))
    by_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("g", "source", "total"))).alias("totals"), F.max("kept").alias("kept"))
    met = blocks.join(by_lang.where("size(totals) > 1"), "lang").select("lang", "held", "totals", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, held in sums.items():
                g, h = np.triu_indices(len(held), 1)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()), "g": pa.array(g), "h": pa.array(h), "value": pa.array(held[g, h])})
            sums.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                lang, kept = batch.column("lang")[i].as_py(), batch.column("kept")[i].as_py()
                rows, named = batch.column("held").slice(i, 1).flatten(), batch.column("totals").slice(i, 1).flatten()
                held, totals = rows.flatten(), named.field("total").to_numpy()
                table = np.zeros((len(rows), len(totals)), np.int64)
                place = pc.index_in(held.field("source"), named.field("source")).to_numpy()
                table[pc.list_parent_indices(rows).to_numpy(), place] = held.field("n").to_numpy()
                g, h, value = priced_pairs(table, totals, kept)
                if lang not in sums:
                    if sum(x.size for x in sums.values()) > HELD:
                        yield from flush()
                    sums[lang] = np.zeros((len(totals), len(totals)), np.int64)
                sums[lang][g, h] += value
        yield from flush()

    return met.mapInArrow(run, "lang string, g long, h long, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def _p(count: str, total: str):
    """As ``prices``, as a column; in decimals, as a count times UNIT can leave a long."""
    return F.expr(f"1 + ((cast({count} as decimal(20,0)) + 2) * {UNIT}) div (cast({total} as decimal(20,0)) + 2 * kept)").cast("long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` for every other source of a language, by divergence; part
    ``term`` for the first ``top`` terms that a source holds more of than its language, by their share of the divergence.

    A null text, language or source is ''. Repeated rows count each time. A source without terms has its pairs; a
    language without kept terms has pairs of value 0 and no terms; one of a single source has no pairs. Ties go by item, by
    its bytes. Texts of any length are counted whole; ids and other columns are ignored; an empty table gives an empty result.
    """
    counts = cut(count_terms(docs, min_docs))
    sources = counts.where("term = ''").select("lang", F.explode("held.source").alias("source"))
    kept = counts.where("term <> ''")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("of_lang"))
    held = kept.select("lang", "term", F.col("total").alias("of_term"), F.explode("held").alias("h")).select("lang", "term", "of_term", "h.source", "h.n")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # sources, not documents, are numbered and ranked from here on
    groups = sources.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), "of_lang",
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("g"),
    )
    groups = cut(groups)
    values = pair_values(kept, groups)
    both = values.unionByName(values.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    others = groups.select("lang", "source", "g").join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h")), "lang").where("g <> h")
    pairs = others.join(cut(both), ["lang", "g", "h"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    own = groups.select("lang", "source", "total", "kept", "of_lang")
    own = F.broadcast(own) if fits_broadcast(own, MAX_BROADCAST_GROUPS) else own
    priced = held.join(own, ["lang", "source"]).withColumn("p", _p("n", "total")).withColumn("q", _p("of_term", "of_lang")).where("p > q")
    best = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    told = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(told)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``audit`` of all documents; its docstring defines every case."""
    return audit(read(spark, sf_dir, "documents"))


SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
w as (select r, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term, count(*) as total from w group by all having count(distinct r) >= 10),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v, sum(total) as n from kept group by lang),
s as (select lang, source, sum(n) as n from c group by all),
t as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.v) as bigint) as p,
    cast(1 + (1000000000::hugeint * (k.total + 2)) // (v.n + 2 * v.v) as bigint) as q
  from g join kept k using (lang) join v using (lang) left join s using (lang, source) left join c using (lang, source, term)),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item,
    cast(coalesce((select sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) from t x join t y on x.lang = y.lang and x.term = y.term
      where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as bigint) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source),
words as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from t where n > 0 and p > q)
select lang, source, part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from pairs
union all select * from (select lang, source, part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from words) where rank <= 10
"""
