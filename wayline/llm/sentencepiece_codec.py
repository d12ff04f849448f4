"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut where two neighbouring characters stand together in no piece, so that no merge can cross the
cut, and every such chunk is encoded once per worker. The new chunks of a batch are laid end to end and
their suffixes sorted; binary search gives each piece's range of occurrences; the occurrences are the edges
of a lattice, sorted by the place where they end, and relaxed in that order. For a merge-based (BPE) model
the relaxation keeps, at each place, the one piece that ends there in the encoding of the prefix: a piece
follows another exactly if no merge would have crossed the seam between them, which is read from the two
pieces' merge trees. Chunks of very many characters, of runs of blanks, of a character outside the
vocabulary, or with pieces whose merge tree is not ordered by rank are merged pair by pair instead; both
ways give the same ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import free_name, read
from wayline.llm.vectext import blocks

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Longest chunk that takes the lattice, chunks kept per worker, characters of one suffix array.
MAX_CHUNK, MAX_KEPT, BATCH_CHARS = 64, 200_000, 250_000
_BITS, _PER_KEY = 12, 5
#: Characters of texts that are encoded at once.
BLOCK = 500_000


def load_pieces(path: str = MODEL_PATH) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file; read on the driver and sent to the tasks (a fixed, small table)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in model.pieces]


class Codec:
    """Encoder and decoder for a list of (piece, score, type) of a BPE model with byte fallback."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = [p for p, _, _ in pieces]
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4)}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == 2), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.raw = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.replace(BLANK, " ").encode() for p, _, k in pieces]
        order = sorted(self.id_of.values(), key=lambda i: (-pieces[i][1], i))
        score = {i: pieces[i][1] for i in order}
        n = len(pieces)
        self.rank = np.full(n, -1, np.int64)
        at, last = -1, None
        for i in order:  # equal scores share a rank: the leftmost pair goes first then
            at += score[i] != last
            last = score[i]
            if len(self.pieces[i]) > 1:
                self.rank[i] = at
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        pairs, odd = {}, []
        self.usable = np.zeros(n, bool)
        for p, i in self.id_of.items():
            for cut in range(1, len(p)):
                a, b = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = int(self.rank[i])
        self._pair = pairs
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.usable[i] = True
                continue
            symbols, final = self._merge(list(p))
            if len(symbols) == 1 and final is not None:
                self.usable[i] = True
                self.left[i], self.right[i] = final
                if max(self.rank[final[0]], self.rank[final[1]]) >= self.rank[i]:
                    odd.append(i)
        self.odd = np.zeros(n, bool)
        self.odd[odd] = True
        self._hash_pairs(pairs)
        self._prepare_search()
        self.kept: dict[str, int] = {}
        self.flat, self.offset, self.hits = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    # merging pair by pair

    def _merge(self, text: list[str]) -> tuple[list[int], tuple[int, int] | None]:
        """Ids after merging best pairs first (-1: not in the vocabulary), and the pair merged last."""
        ids = [self.id_of.get(c, -1) for c in text]
        symbols: list[int | None] = list(ids)
        size = [1] * len(ids)
        following, previous = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int, str]] = []
        words = list(text)

        def offer(i: int) -> None:
            j = following[i]
            if j < len(ids) and symbols[i] is not None and symbols[j] is not None:
                r = self._pair.get((symbols[i], symbols[j]))
                if r is not None:
                    heapq.heappush(heap, (r, i, size[i], size[j], ""))

        for i in range(len(ids) - 1):
            offer(i)
        final = None
        while heap:
            _, i, si, sj, _ = heapq.heappop(heap)
            j = following[i]
            if symbols[i] is None or j >= len(ids) or size[i] != si or size[j] != sj or symbols[j] is None:
                continue
            final = (symbols[i], symbols[j])
            words[i] += words[j]
            symbols[i], symbols[j] = self.id_of[words[i]], None
            size[i] += size[j]
            size[j] = 0
            following[i] = following[j]
            if following[i] < len(ids):
                previous[following[i]] = i
            if previous[i] >= 0:
                offer(previous[i])
            offer(i)
        return [s for s in symbols if s is not None], final

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk by merging; characters outside the vocabulary become their bytes."""
        out, at = [], 0
        for i in self._merge(list(chunk))[0]:
            if i >= 0:
                out.append(i)
                at += len(self.pieces[i])
            else:
                out += [self.byte.get(b, self.unknown) for b in chunk[at].encode()] if self.byte else [self.unknown]
                at += 1
        return out

    # merge trees: whether two pieces can stand side by side

    def _hash_pairs(self, pairs: dict[tuple[int, int], int]) -> None:
        n = 1 << max(4, int(np.ceil(np.log2(4 * len(pairs) + 4))))
        self.mask = np.int64(n - 1)
        keys = np.array([(a << 20) | b for a, b in pairs], np.int64).reshape(-1)
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.table, self.value = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        slot, self.probes, todo = self._slot(keys), 0, np.arange(len(keys))
        while len(todo):
            free = self.table[slot[todo]] == -1
            first = np.unique(slot[todo[free]], return_index=True)[1]
            win = todo[free][first]
            self.table[slot[win]], self.value[slot[win]] = keys[win], values[win]
            todo = np.setdiff1d(todo, win)
            slot[todo] = (slot[todo] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(30)).astype(np.int64) & self.mask

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two pieces; a huge number where they do not merge."""
        keys = (a << 20) | b
        slot = self._slot(keys)
        out = np.full(len(keys), 1 << 40, np.int64)
        at = np.arange(len(keys))
        while len(at):
            held = self.table[slot]
            hit = held == keys[at]
            out[at[hit]] = self.value[slot[hit]]
            on = ~hit & (held != -1)
            at, slot = at[on], (slot[on] + 1) & self.mask
        return out

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b can follow piece a: no merge crosses the seam at any time, going back from the end."""
        good = np.ones(len(a), bool)
        at, x, y, bound = np.arange(len(a)), a.copy(), b.copy(), np.full(len(a), 1 << 40, np.int64)
        while len(at):
            bad = self._pair_rank(x, y) < bound
            good[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[on], x[on], y[on], rx[on], ry[on]
            later = rx > ry  # of equal ranks the left one is merged first
            bound = np.where(later, rx, ry + 1)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return good

    # suffix array, ranges, edges, relaxation

    def _prepare_search(self) -> None:
        singles = sorted(ord(p) for p in self.id_of if len(p) == 1)
        if len(singles) + 2 >= 1 << _BITS:
            raise ValueError("more single characters than a suffix key has room for")
        self.symbol = np.zeros(0x110000, np.uint16)
        self.symbol[singles] = np.arange(1, len(singles) + 1)
        self.n_symbols = len(singles) + 1
        self.together = np.zeros(self.n_symbols * self.n_symbols, bool)
        for p in self.id_of:
            c = self.symbol[[ord(x) for x in p]].astype(np.int64)
            known = (c[:-1] > 0) & (c[1:] > 0)
            self.together[(c[:-1] * self.n_symbols + c[1:])[known]] = True
        use = [(p, i) for p, i in self.id_of.items() if self.usable[i] and not p.startswith(BLANK * 2)]
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.search_ids = np.array([i for _, i in use], np.int64)
        length = np.array([len(p) for p, _ in use])
        self.n_keys = int(np.ceil(length.max() / _PER_KEY))
        low = np.zeros((len(use), self.n_keys * _PER_KEY), np.int64)
        for row, (p, _) in enumerate(use):
            low[row, : len(p)] = self.symbol[[ord(c) for c in p]]
        high = np.where(np.arange(low.shape[1]) < length[:, None], low, (1 << _BITS) - 1)
        self.low, self.high = self._keys(low), self._keys(high)
        order = np.lexsort(self.low[::-1])  # neighbours in the search are neighbours in memory
        self.search_ids = self.search_ids[order]
        self.low, self.high = [k[order] for k in self.low], [k[order] for k in self.high]
        self.long = length[order] > _PER_KEY

    def _keys(self, symbols: np.ndarray) -> list[np.ndarray]:
        shifts = _BITS * np.arange(_PER_KEY - 1, -1, -1)
        return [(symbols[:, k * _PER_KEY : (k + 1) * _PER_KEY].astype(np.int64) << shifts).sum(axis=1) for k in range(self.n_keys)]

    def _ranges(self, suffix_keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last place of each piece in the sorted suffixes."""

        first, last = np.searchsorted(suffix_keys[0], self.low[0], "left"), np.searchsorted(suffix_keys[0], self.high[0], "right")
        longer = np.flatnonzero(self.long & (first < last))  # only these ask for more than their first key

        def bound(keys: list[np.ndarray], after: bool) -> np.ndarray:
            low, high = first[longer], last[longer]
            keys = [k[longer] for k in keys]
            while (open_ := low < high).any():
                at = np.flatnonzero(open_)
                mid = (low[at] + high[at]) >> 1
                less, equal = np.zeros(len(at), bool), np.ones(len(at), bool)
                for s, k in zip(suffix_keys[1:], keys[1:], strict=True):
                    less |= equal & (s[mid] < k[at])
                    equal &= s[mid] == k[at]
                up = less | equal if after else less
                low[at[up]] = mid[up] + 1
                high[at[~up]] = mid[~up]
            return low

        starts, stops = bound(self.low, False), bound(self.high, True)
        first[longer], last[longer] = starts, stops
        return first, last

    def _suffixes(self, key: np.ndarray) -> np.ndarray:
        """The suffix array to the length of the longest piece, by doubling from keys of the first characters."""
        reach = _PER_KEY
        while True:
            order = np.argsort(key)
            if reach >= self.n_keys * _PER_KEY:
                return order
            steps = np.concatenate(([False], key[order][1:] != key[order][:-1]))
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(steps) + 1
            if rank[order[-1]] == len(key):
                return order
            after = np.concatenate((rank[reach:], np.zeros(min(reach, len(rank)), np.int64)))
            key = (rank << 31) | after
            reach *= 2

    def _lattice(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of known characters, laid end to end, and how many each has (0: must be merged)."""
        text = "\0".join(chunks) + "\0"
        sym = self.symbol[np.frombuffer(text.encode("utf-32-le"), "<u4")].astype(np.int64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        padded = np.concatenate((sym, np.zeros(self.n_keys * _PER_KEY, np.int64)))
        key = np.zeros(len(sym) + (self.n_keys - 1) * _PER_KEY, np.int64)
        for k in range(_PER_KEY):
            key |= padded[k : k + len(key)] << (_BITS * (_PER_KEY - 1 - k))
        keys = [key[k * _PER_KEY : k * _PER_KEY + len(sym)] for k in range(self.n_keys)]
        order = self._suffixes(keys[0])
        first, last = self._ranges([k[order] for k in keys])
        count = last - first
        total = int(count.sum())
        piece = np.repeat(self.search_ids, count)
        place = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        begin = order[place]
        end = begin + self.size[piece]
        chunk_start = np.repeat(start, size + 1)
        depth = (end - chunk_start[begin]).astype(np.int16)
        sort = np.argsort(depth, kind="stable")
        begin, end, piece, depth = begin[sort], end[sort], piece[sort], depth[sort]
        waves = np.searchsorted(depth, np.arange(1, int(size.max()) + 2))
        held = np.full(len(sym) + 1, -1, np.int64)
        for a, b in zip(waves[:-1], waves[1:], strict=True):
            s, p, e = begin[a:b], piece[a:b], end[a:b]
            before = held[s]
            at_start = s == chunk_start[s]
            open_ = np.flatnonzero(~at_start & (before >= 0))
            fits = at_start.copy()
            fits[open_] = self.side_by_side(before[open_], p[open_])
            held[e[fits]] = p[fits]
        # back from each chunk's end
        at, alive = start + size, np.arange(len(chunks))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        n = np.zeros(len(chunks), np.int64)
        failed = np.zeros(len(chunks), bool)
        while len(alive):
            p = held[at[alive]]
            lost = (p < 0) | self.odd[np.maximum(p, 0)]
            failed[alive[lost]] = True
            alive, p = alive[~lost], p[~lost]
            steps.append((alive, p))
            n[alive] += 1
            at[alive] -= self.size[p]
            alive = alive[at[alive] > start[alive]]
        n[failed] = 0
        offset = np.cumsum(n)
        flat = np.zeros(int(offset[-1]) if len(offset) else 0, np.int32)
        for back, (who, p) in enumerate(steps):
            ok = ~failed[who]
            flat[offset[who[ok]] - 1 - back] = p[ok]
        return flat, n

    def _learn(self, fresh: list[str]) -> None:
        """Encode chunks that are not kept yet."""
        easy, hard = [], []
        for c in fresh:  # a chunk of several characters has none outside the vocabulary
            plain = len(c) <= MAX_CHUNK and (len(c) > 1 or c in self.id_of) and not c.startswith(BLANK * 2)
            (easy if plain else hard).append(c)
        flats, sizes, names = [], [], []
        at = 0
        while at < len(easy):
            stop, chars = at, 0
            while stop < len(easy) and chars < BATCH_CHARS:
                chars += len(easy[stop]) + 1
                stop += 1
            flat, n = self._lattice(easy[at:stop])
            hard += [c for c, k in zip(easy[at:stop], n.tolist(), strict=True) if not k]
            names += [c for c, k in zip(easy[at:stop], n.tolist(), strict=True) if k]
            flats.append(flat)
            sizes.append(n[n > 0])
            at = stop
        for c in hard:
            ids = self.merge(c)
            names.append(c)
            flats.append(np.array(ids, np.int32))
            sizes.append(np.array([len(ids)]))
        self.kept.update(zip(names, range(len(self.kept), len(self.kept) + len(names)), strict=True))
        self.flat = np.concatenate([self.flat, *flats])
        self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(np.concatenate(sizes))]) if sizes else self.offset

    def _forget(self) -> None:
        """Keep the chunks met most often, half of MAX_KEPT at most, and none met only once."""
        often = np.flatnonzero(self.hits > 1)
        if len(often) > MAX_KEPT // 2:
            often = np.sort(often[np.argsort(-self.hits[often], kind="stable")[: MAX_KEPT // 2]])
        names = list(self.kept)
        self.kept = {names[i]: k for k, i in enumerate(often.tolist())}
        first, n = self.offset[often], self.offset[often + 1] - self.offset[often]
        ends = np.cumsum(n)
        self.flat = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n - first, n)]
        self.offset, self.hits = np.concatenate(([0], ends)), self.hits[often] // 2

    def _chunks(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct chunks of all texts, the chunks one after the other as places among these, and how many each text has."""
        full = "".join(BLANK + t.replace(" ", BLANK) if t else "" for t in texts)
        if not full:
            return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        points = np.frombuffer(full.encode("utf-32-le"), "<u4")
        sym = self.symbol[points].astype(np.int64)
        cut = np.ones(len(full) + 1, bool)
        cut[1:-1] = ~self.together[sym[:-1] * self.n_symbols + sym[1:]]
        ends = np.cumsum(size)
        cut[ends] = True
        at = np.flatnonzero(cut)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate(([0], np.cumsum(width)))[at]
        held = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(offset), pa.py_buffer(full.encode())).dictionary_encode()
        return held.dictionary.to_pylist(), held.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(at, ends), prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the model's own encoder gives them; an empty text has none."""
        if len(self.kept) > MAX_KEPT:
            self._forget()
        chunks, place, size = self._chunks(texts)
        index = list(map(self.kept.get, chunks))
        if None in index:
            self._learn([c for c, i in zip(chunks, index, strict=True) if i is None])
            index = list(map(self.kept.__getitem__, chunks))
        at = np.array(index, np.int64)[place]
        seen = np.bincount(at, minlength=len(self.kept))
        seen[: len(self.hits)] += self.hits
        self.hits = seen
        first, n = self.offset[at], self.offset[at + 1] - self.offset[at]
        ends = np.cumsum(n)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n - first, n)]
        return np.split(ids, np.concatenate(([0], ends))[np.cumsum(size)][:-1]) if len(texts) else []

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the blank put before a text is taken off."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _in_worker(pieces) -> Callable[[], Codec]:
    """One codec per worker process, kept between tasks."""

    def get() -> Codec:
        if _CODECS.get("pieces") is not pieces.value:
            _CODECS.update(pieces=pieces.value, codec=Codec(pieces.value))
        return _CODECS["codec"]

    return get


_CODECS: dict = {}


def _column(spark: SparkSession, path: str, kind: T.DataType, one: Callable[[Codec, pd.Series], Iterator[pd.Series | pd.DataFrame]]):
    """A pandas UDF over batches; what it gives back comes in smaller parts, so that a batch's result is never held whole."""
    get = _in_worker(spark.sparkContext.broadcast(load_pieces(path)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = get()
        for b in batches:
            yield from one(codec, b)

    return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER)


def encode(docs: DataFrame, path: str = MODEL_PATH, verify: bool = False) -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens`` (existing columns of these names are replaced).

    ``verify`` adds ``round_trip``: whether the ids, decoded in the same task, give the text again.
    Null and empty texts have no ids; other nulls, repeated rows and extra columns pass through; an empty
    table gives an empty result.
    """
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def one(codec: Codec, texts: pd.Series) -> Iterator[pd.DataFrame]:
        for _, part in blocks(texts.tolist(), BLOCK):
            ids = codec.encode(part)
            same = [codec.decode(x) == t for x, t in zip(ids, part, strict=True)] if verify else [None] * len(part)
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "round_trip": pd.Series(same, dtype=object)})

    name = free_name(docs, "encoded")
    out = docs.withColumn(name, _column(docs.sparkSession, path, kind, one)(F.col("text")))
    new = {"ids": F.col(name)["ids"], "n_tokens": F.size(F.col(name)["ids"]).cast("long")}
    return out.withColumns({**new, "round_trip": F.col(name)["round_trip"]} if verify else new).drop(name)


def decode(encoded: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids``; null ids give an empty text."""

    def one(codec: Codec, rows: pd.Series) -> Iterator[pd.Series]:
        for at in range(0, len(rows), 500):
            yield pd.Series([codec.decode(np.asarray(x, np.int32)) if x is not None else "" for x in rows.iloc[at : at + 500]], dtype=object)

    return encoded.withColumn("decoded", _column(encoded.sparkSession, path, T.StringType(), one)(F.col("ids")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, a digest of them, and whether they decode to the text."""
    both = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), verify=True)
    return both.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), "round_trip")
