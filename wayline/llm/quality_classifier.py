"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word falls into one of BUCKETS hash buckets with a fixed sparse ternary index vector. A bucket's word
vector is the sum of the index vectors that stand within WINDOW words of it anywhere in the corpus: each task
adds up its own share and Spark adds the shares. A document is the weighted mean and spread of its words'
vectors. The network is trained on the driver on a bounded sample of labelled rows and its probabilities are
calibrated with one temperature on rows kept out of training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import read
from wayline.llm.vectext import Block, blocks

BUCKETS, DIM, NONZERO, WINDOW = 1 << 13, 48, 4, 2
#: Bound of the labelled rows that are learned from; taken by a hash of doc_id.
MAX_LABELLED = 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 128, 2e-3, 1e-4, 42
#: Code points pooled at once: a few tens of MB of vectors.
_CHARS = 200_000


def token_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each token: runs of letters, runs of digits, and single marks."""
    b = Block(texts)
    kind = np.full(len(b.cp), 1, np.uint8)  # letters, and all beyond ASCII
    low = b.cp < 128
    c = b.cp[low]
    k = np.full(len(c), 3, np.uint8)  # marks
    k[((c >= 65) & (c <= 90)) | ((c >= 97) & (c <= 122))] = 1
    k[(c >= 48) & (c <= 57)] = 2
    k[(c <= 32) | (c == 127)] = 0
    kind[low] = k
    outside = kind == 0
    fresh = np.ones(len(kind), bool)
    fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    fresh[b.start[b.size > 0]] = True
    begins = np.flatnonzero(fresh & ~outside)
    return (b.hashes(begins, outside) % np.uint64(BUCKETS)).astype(np.int64), b.doc[begins]


def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors of all buckets, the same everywhere."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIM), np.int16)
    at = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, np.where(rng.random((BUCKETS, NONZERO)) < 0.5, -1, 1).astype(np.int16), axis=1)
    return out


def _context_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = index_vectors()
    sums, counts = np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, texts in blocks(b["text"].tolist(), _CHARS):
            bucket, doc = token_buckets(texts)
            if not len(bucket):
                continue
            near = np.zeros((len(bucket), DIM), np.int16)
            vectors = index[bucket]
            for step in range(1, WINDOW + 1):
                same = (doc[step:] == doc[:-step])[:, None]
                near[step:] += vectors[:-step] * same
                near[:-step] += vectors[step:] * same
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            sums[found] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
            counts += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"bucket": at.astype(np.int32), "n": counts[at], **{f"v{i}": sums[at, i] for i in range(DIM)}})


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of all buckets and their weights; BUCKETS rows at most come to the driver."""
    columns = ["n", *(f"v{i}" for i in range(DIM))]
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        _context_sums, "bucket int, " + ", ".join(f"{c} long" for c in columns)
    )
    pdf = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    vectors, n = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    vectors[pdf["bucket"]] = pdf[columns[1:]].to_numpy(float)
    n[pdf["bucket"]] = pdf["n"]
    vectors -= vectors.sum(0) / max(1.0, n.sum()) * n[:, None]  # what every word has in common says nothing
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    weights = 1e-3 / (1e-3 + n / max(1.0, n.sum()))
    return vectors.astype(np.float32), weights.astype(np.float32)


def pool(texts: list[str], vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted mean and spread of the word vectors of each text; zeros for a text without words."""
    bucket, doc = token_buckets(texts)
    out = np.zeros((len(texts), 2 * DIM), np.float32)
    if len(bucket):
        found, first = np.unique(doc, return_index=True)
        w = weights[bucket][:, None]
        x = vectors[bucket]
        total = np.add.reduceat(w, first, axis=0, dtype=np.float64)
        mean = np.add.reduceat(x * w, first, axis=0, dtype=np.float64) / total
        square = np.add.reduceat(x * x * w, first, axis=0, dtype=np.float64) / total
        out[found, :DIM] = mean
        out[found, DIM:] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


class Network:
    """Two layers in numpy: tanh units, one logit, a temperature."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        order = rng.permutation(len(x))
        held = order[: max(1, len(x) // 5)]
        used = order[len(held) :] if len(x) > 4 else order
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            rng.shuffle(used)
            for at in range(0, len(used), BATCH):
                i = used[at : at + BATCH]
                h = np.tanh(z[i] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
                back = np.outer(e, p[2]) * (1 - h * h)
                g = [z[i].T @ back + DECAY * p[0], back.sum(0), h.T @ e + DECAY * p[2], np.array([e.sum()])]
                t += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logit, y_held = self.logit(x[held]), y[held]
        loss = lambda s: np.logaddexp(0, np.where(y_held == 1, -1, 1) * logit / s).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


class Constant:
    """Stands in where no labelled row or only one class is known."""

    def __init__(self, p: float):
        self.p = p

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED):
    """Scorer of text lists: word vectors from all of ``docs``, a network from labelled rows that are not held out."""
    vectors, weights = word_vectors(docs)
    known = (
        labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )

    def pooled(texts: pd.Series) -> pd.Series:
        out = [pool(part, vectors, weights) for _, part in blocks(texts.tolist(), _CHARS)]
        return pd.Series(list(np.concatenate(out))) if out else pd.Series([], dtype=object)

    # at most max_labelled ids and labels are broadcast, as many pooled vectors come back
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(
        "doc_id", "quality", F.pandas_udf(pooled, T.ArrayType(T.FloatType()))("text").alias("x")
    ).toPandas().sort_values("doc_id").drop_duplicates("doc_id")
    y = rows["quality"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        network = Constant(float(y.mean()) if len(y) else 0.5)
    else:
        network = Network().fit(np.stack(rows["x"].to_numpy()).astype(np.float64), y)
    return vectors, weights, network


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with ``score``, the calibrated probability of label 1.

    Null and empty texts pool to the zero vector and get the network's score for it; nulls elsewhere, repeated
    rows and extra columns are untouched (a column named score is replaced); without usable labels every score is the mean label, or 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))

    def predict(texts: pd.Series) -> pd.Series:
        vectors, weights, network = model.value
        out = [network.predict(pool(part, vectors, weights).astype(np.float64)) for _, part in blocks(texts.tolist(), _CHARS)]
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return docs.withColumn("score", F.pandas_udf(predict, T.DoubleType())("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
