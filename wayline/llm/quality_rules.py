"""Quality rules with an n-gram perplexity from a Spark-counted modified Kneser-Ney model.

The model is over characters as they are (lower case, white space as one blank), five at a time, with a model
and a band for every language; it grows with what the corpus holds. Five 12-bit character hashes make a
gram's 60-bit hash: characters up to U+07FF keep codes of their own, those beyond share 2,048. Counts,
continuation counts, discounts and back-offs are grouped and joined in Spark, which gives the log probability of
every gram of the corpus. Tasks read it by binary search from an array of sorted hashes beside one of values: of
the whole model while that has a bounded size, else of the grams that a block of texts holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import cut, fits_broadcast, read, shared_folder
from wayline.llm.vectext import Block, blocks, mix, per_doc, repeated

ORDER, BITS = 5, 12
#: Width of the accepted band in interquartile ranges on either side of the quartiles of log perplexity.
BAND = 2.0
#: The mean over n characters strays as 1 / sqrt(n): a band is wider by sqrt(1 + SHORT / n) for a short text.
SHORT = 1500
#: Rules of the base verdict.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
#: Grams of the model that pass the driver and are sent to every task (20 bytes each); a larger model meets the texts in blocks.
MODEL_ROWS = 2_000_000
#: Characters of a block of texts, unless one text has more; it is held in a task with the part of the model it needs.
TEXT_BLOCK = 16_000_000
#: Languages whose discounts and bands are broadcast; joined by shuffle beyond.
MAX_BROADCAST_LANGUAGES = 100_000
#: Distinct grams, of all languages, that a task holds before it hands them on.
HELD_GRAMS = 2_000_000

_A, _OWN = 1 << BITS, 0x800
_LOWER = np.array([ord(c) if len(c) == 1 else i for i, c in ((i, chr(i).lower()) for i in range(0x3000))], np.int64)
_LOWER[9:14] = 32
_START = 0


def symbols(cp: np.ndarray) -> np.ndarray:
    """Character hashes of code points."""
    low = np.where(cp < len(_LOWER), _LOWER[np.minimum(cp, len(_LOWER) - 1)], cp).astype(np.int64)
    far = low >= _OWN
    if far.any():
        low[far] = _OWN + (mix(low[far]) & np.uint64(_OWN - 1)).astype(np.int64)
    return low


def gram_codes(block: Block) -> np.ndarray:
    """Code of the ORDER characters that end at each code point; texts begin after start marks."""
    c = symbols(block.cp)
    at = np.arange(len(c)) - np.repeat(block.start, block.size)
    code = c.copy()
    for back in range(1, ORDER):
        older = np.zeros_like(c)
        older[back:] = c[:-back] if len(c) > back else 0
        older[at < back] = _START
        code |= older << (BITS * back)
    return code


def _mask(k: int) -> int:
    return (1 << (BITS * k)) - 1


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over all rows of ``docs`` (lang, text); each task adds up before it sends."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            codes, n = (np.concatenate([x[i] for x in held[lang]]) for i in range(2))
            distinct, which = np.unique(codes, return_inverse=True)
            return distinct, np.bincount(which, weights=n).astype(np.int64)

        def frames() -> Iterator[pd.DataFrame]:
            for lang in held:
                code, n = merged(lang)
                yield pd.DataFrame({"lang": lang, "code": code, "n": n})

        size = lambda: sum(len(code) for x in held.values() for code, _ in x)
        for b in batches:
            for lang, part in b.groupby("lang"):
                for _, texts in blocks(part["text"].tolist()):
                    held.setdefault(lang, []).append(np.unique(gram_codes(Block(texts)), return_counts=True))
                if size() > HELD_GRAMS:
                    held.update({x: [merged(x)] for x in held})
                    if size() > HELD_GRAMS // 2:
                        yield from frames()
                        held.clear()
        yield from frames()

    rows = docs.mapInPandas(count, "lang string, code long, n long")
    return rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def estimate(counts: DataFrame) -> tuple[DataFrame, bool]:
    """(lang, code, value): the log probability of each counted gram's last character after the others.

    ``counts`` is that of ``count_grams``; interpolated modified Kneser-Ney with three discounts for each language and
    length. The last result tells whether tables of one row per language may be broadcast. Tables of grams are merged,
    never sent through the driver.
    """
    tables = {ORDER: cut(counts)}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct grams one longer that end so
        shorter = F.col("code").bitwiseAND(F.lit(_mask(k)))
        tables[k] = cut(tables[k + 1].groupBy("lang", shorter.alias("code")).agg(F.count("*").alias("n")))
    few = fits_broadcast(tables[1].select("lang").distinct(), MAX_BROADCAST_LANGUAGES)
    lower = None
    for k in range(1, ORDER + 1):
        t = [F.count_if(F.col("n") == i).cast("double") for i in range(1, 5)]
        of = tables[k].groupBy("lang").agg(*[x.alias(f"t{i}") for i, x in enumerate(t, 1)])
        y = F.when(F.col("t1") + F.col("t2") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(0.5)
        d = [
            F.when(F.col(f"t{i}") > 0, F.least(F.greatest(i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}"), F.lit(0.1)), F.lit(float(i)))).otherwise(0.5)
            for i in (1, 2, 3)
        ]
        of = of.select("lang", F.array(*d).alias("d"))
        of = F.broadcast(of) if few else of
        rows = tables[k].join(of, "lang").select("lang", "code", "n", F.get("d", F.least("n", F.lit(3)).cast("int") - 1).alias("taken"))
        before = F.shiftrightunsigned("code", BITS).alias("ctx")
        weights = rows.groupBy("lang", before).agg(F.sum("n").alias("total"), F.sum("taken").alias("off"))
        weights = weights.select("lang", "ctx", "total", F.greatest(F.col("off") / F.col("total"), F.lit(1e-12)).alias("lam"))
        rows = rows.withColumn("ctx", before).join(F.broadcast(weights) if k == 1 and few else weights.hint("merge"), ["lang", "ctx"])
        if k == 1:
            rows = rows.withColumn("below", F.lit(1.0 / _A))
        else:
            rows = rows.withColumn("low", F.col("code").bitwiseAND(F.lit(_mask(k - 1)))).join(lower.hint("merge"), ["lang", "low"])
        p = F.greatest(F.col("n") - F.col("taken"), F.lit(0.0)) / F.col("total") + F.col("lam") * F.col("below")
        lower = cut(rows.select("lang", F.col("code").alias("low"), p.alias("below")))
    return lower.select("lang", F.col("low").alias("code"), F.log("below").alias("value")), few


class Tables:
    """Sorted hashes and values of a model or a part of it, by language."""

    def __init__(self, rows: pd.DataFrame):
        """``rows``: number (of the language), code, value."""
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for number, part in rows.groupby("number"):
            code = part["code"].to_numpy(np.int64)
            order = np.argsort(code)
            self.held[int(number)] = code[order], part["value"].to_numpy(np.float32)[order]

    def values(self, number: int, code: np.ndarray) -> np.ndarray:
        """Log probabilities of codes, all of which the model holds."""
        h, value = self.held.get(number, (np.zeros(0, np.int64), np.zeros(0, np.float32)))
        return value[np.searchsorted(h, code)]


def rule_counts(texts: list[str]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of one block."""
    b = Block(texts)
    space = b.space()
    begins = b.begins(space)
    words, word_doc = b.hashes(begins, space), b.doc[begins]
    line_end = b.cp == 10
    before = np.ones(len(b.cp), bool)
    before[1:] = line_end[:-1]
    before[b.start[b.size > 0]] = True
    lines = np.flatnonzero(before)
    n_dup = np.zeros(b.n)
    if len(lines):
        with_word = np.add.reduceat((~space).astype(np.int64), lines) > 0
        keys = b.hashes(lines, line_end)[with_word]
        doc = b.doc[lines][with_word]
        n_dup = np.bincount(doc[repeated(keys, doc)[0]], minlength=b.n)
    n_repeat = np.zeros(b.n)
    w = REPEAT_WINDOW
    if len(words) >= w:
        key = np.zeros(len(words) - w + 1, np.uint64)
        for k in range(w):
            key = key * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - w + 1 + k]
        at = np.flatnonzero(word_doc[: len(key)] == word_doc[w - 1 :])
        twice = at[repeated(mix(key[at]), word_doc[at])[1]]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + w, -1)
        n_repeat = np.bincount(word_doc[np.cumsum(edge)[:-1] > 0], minlength=b.n)
    symbol = np.isin(b.cp, [ord(c) for c in SYMBOLS])
    return {
        "n_words": np.bincount(word_doc, minlength=b.n), "word_chars": np.bincount(b.doc[~space], minlength=b.n),
        "n_symbols": np.bincount(b.doc[symbol], minlength=b.n), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
    }


def _scored(part: pd.DataFrame, tables: Tables) -> Iterator[pd.DataFrame]:
    """Rule counts and summed log probabilities of rows (doc_id, lang, number, text)."""
    for (lang, number), same in part.groupby(["lang", "number"]):
        for first, texts in blocks(same["text"].tolist()):
            block = Block(texts)
            out = pd.DataFrame(rule_counts(texts)).astype(np.int64)
            out["doc_id"], out["lang"] = same["doc_id"].to_numpy()[first : first + len(texts)], lang
            code, which = np.unique(gram_codes(block), return_inverse=True)
            out["total"], out["n_chars"] = per_doc(tables.values(int(number), code)[which], block.doc, block.n), block.size
            yield out


_SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, doc_id string, lang string, total double, n_chars long"


def _with_sent_model(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Scores of ``rows`` with the whole model in every task."""
    sent = rows.sparkSession.sparkContext.broadcast(Tables(model.toArrow().to_pandas()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from _scored(b, sent.value)

    return rows.mapInPandas(run, _SCORED)


def _with_met_model(rows: DataFrame, model: DataFrame, block_chars: int) -> DataFrame:
    """Scores of ``rows`` where no task can hold the model: blocks of texts meet the values of their own grams.

    The texts are written once, neighbours in blocks, each block's distinct grams are joined with the model, and what
    is found meets the block's texts. That reads the texts twice and shuffles them once, whatever the model's size;
    a task holds a block and its grams. A gram that all texts hold has one row for each block.
    """

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, size = 0, 0
        for b in batches:
            of = []
            for n in map(len, b["text"]):
                if size and size + n > block_chars:
                    block, size = block + 1, 0
                size += n
                of.append(block)
            # a task's blocks are its own: its number stands above theirs
            yield b.assign(block=b["block"] + np.array(of, np.int64))

    place = F.shiftleft(F.spark_partition_id().cast("long"), 33).alias("block")
    numbered = rows.select("*", place).mapInPandas(number, "doc_id string, lang string, number long, text string, block long")
    # a compressed table rather than a checkpoint: it holds whole texts
    path = f"{shared_folder(rows.sparkSession)}/op6-texts-{uuid.uuid4().hex}"
    numbered.write.option("compression", "zstd").parquet(path)
    held = rows.sparkSession.read.parquet(path)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (block, lang), part in b.groupby(["block", "number"]):
                for _, texts in blocks(part["text"].tolist()):
                    yield pd.DataFrame({"block": block, "number": lang, "code": np.unique(gram_codes(Block(texts)))})

    asked = held.select("block", "number", "text").mapInPandas(grams, "block long, number long, code long").distinct()
    known = asked.join(model.hint("merge"), ["number", "code"])

    def run(texts: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_scored(texts, Tables(values)), ignore_index=True)

    # without texts a block has nothing to score; without characters it has no values
    return held.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(run, _SCORED)


def quality_rules(docs: DataFrame, band: float = BAND, model_rows: int = MODEL_ROWS, block_chars: int = TEXT_BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): the rule counts, perplexity, base_failed and kept.

    Null and empty texts have no words, a null perplexity and fail the base rules; a null lang is a
    language of its own, and every language has its own model and band; repeated rows are judged alike and
    count in the model each time; ties at a band's edge are kept; texts of any length are read whole; extra
    columns are ignored; an empty table gives an empty result. A model of over ``model_rows`` grams is not
    sent whole but meets the texts in blocks of ``block_chars`` characters, with the same result.
    """
    # ids pass through pandas as text: a column with nulls would turn to floating point there
    text = F.coalesce("text", F.lit(""))
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), lang.alias("lang"), F.xxhash64(lang).alias("number"), text.alias("text"))
    model, few = estimate(count_grams(rows.select("lang", "text")))
    model = cut(model.select(F.xxhash64("lang").alias("number"), "code", F.col("value").cast("float").alias("value")))
    fits = fits_broadcast(model, model_rows)
    scored = cut(_with_sent_model(rows, model) if fits else _with_met_model(rows, model, block_chars))
    surprise = F.when(F.col("n_chars") > 0, -F.col("total") / F.col("n_chars"))
    scored = scored.withColumn("surprise", surprise)
    quartiles = scored.groupBy("lang").agg(F.percentile_approx("surprise", [0.25, 0.75], 10000).alias("q")).select(
        "lang", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")
    )
    judged = scored.join(F.broadcast(quartiles) if few else quartiles, "lang", "left")
    width = F.lit(band) * (F.col("q3") - F.col("q1")) * F.sqrt(1 + F.lit(SHORT) / F.greatest(F.lit(1), F.col("n_chars")))
    inside = F.coalesce(F.col("surprise").between(F.col("q1") - width, F.col("q3") + width), F.lit(False))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.exp("surprise").alias("perplexity"), failed.alias("base_failed"), (~failed & inside).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality_rules`` of all documents; its docstring defines every case."""
    return quality_rules(read(spark, sf_dir, "documents"))
