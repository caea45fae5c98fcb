"""Quality of documents: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities.

Each token gives a text and a shape, and marks for one that repeats the one before it or one seen earlier in the
document. All hash into ``BUCKETS`` rows. Every row has a fixed sparse random index vector; a word's vector is the sum
of the index vectors found near it in all texts. A document is the means of its words' vectors. The network is fitted on a bounded sample (at most ``max_rows`` labelled rows,
those with the smallest hashes); a part of it is kept back to set the temperature.

Edge cases: a null or empty text pools to zeros and gets the network's value there; repeated rows score alike; null
ids and labels never train; with no labelled rows, or labels of one kind, every score is the smoothed share of label 1;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents
from .hashing import mix, word_hashes
from .toxicity import MAX_ROWS, held_out, labelled, with_score

BUCKETS = 1 << 13
DIMS = 32
NONZERO = 4
REACH = 2
HIDDEN = 32
WIDTH = 7 * DIMS  # of a pooled document


AGAIN, SEEN = 0, 1  # buckets of the marks


@functools.cache
def index_vectors() -> np.ndarray:
    """Fixed sparse ternary vectors, one for each bucket."""
    rng = np.random.default_rng(20240229)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for row in out:
        row[rng.choice(DIMS, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: its lower case for the text of a word (0 for signs, which are left out), and its kind for the
    shape. Bytes of other scripts are small letters."""
    low, kind = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        blank = b == 32 or 9 <= b <= 13
        low[b] = 32 if blank else ord(c.lower()) if c.isalnum() else 0
        kind[b] = 32 if blank else 97 if c.islower() else 65 if c.isupper() else 48 if c.isdigit() else b
    kind[128:] = 97
    return low, kind


LOW, KIND = _tables()


def word_ids(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words' texts and of their shapes (kinds of signs, runs shrunk to one), in order."""
    b = np.frombuffer(text, np.uint8)
    low = LOW[b]
    kind = KIND[b]
    kind = kind[np.concatenate((kind[:1] > 0, kind[1:] != kind[:-1]))]
    bucket = lambda h, salt: ((h ^ np.uint64(salt)) % np.uint64(BUCKETS - 2)).astype(np.int64) + 2
    return bucket(word_hashes(low[low > 0]), 0), bucket(mix(word_hashes(kind)), 1)


def add_contexts(ids: np.ndarray, total: np.ndarray) -> None:
    """Adds to each word's row the index vectors of the words within reach; -1 stands between documents."""
    index = np.concatenate((index_vectors(), np.zeros((1, DIMS), np.float32)))  # the last row is for -1
    edge = np.full(REACH, -1)
    wide = np.concatenate((edge, ids, edge))
    n = len(ids)
    context = np.zeros((n, DIMS), np.float32)
    for d in range(-REACH, REACH + 1):
        if d:
            context += index[wide[REACH + d : REACH + d + n]]
    order = np.argsort(ids.astype(np.int16), kind="stable")  # a radix sort
    key = ids[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sums = np.add.reduceat(context[order], first, axis=0)
    own = key[first] >= 0
    total[key[first][own]] += sums[own]


def context_sums(docs: DataFrame) -> np.ndarray:
    """Sums of index vectors near each word, over all texts. A task sends BUCKETS rows at most, each reduced by key
    before the driver takes the BUCKETS totals."""

    def run(batches):
        total = np.zeros((BUCKETS, DIMS), np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                parts = [word_ids(t.as_py() or b"") for t in batch.column(0).slice(at, 32).cast(pa.binary())]
                gap = np.full(REACH, -1)
                for k in (0, 1):
                    add_contexts(np.concatenate([x for p in parts for x in (p[k], gap)]), total)
        rows = np.flatnonzero(np.abs(total).sum(1))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(total[rows].ravel()), DIMS).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(rows), flat], names=["bucket", "v"])

    sums = docs.select("text").mapInArrow(run, "bucket long, v array<double>").groupBy("bucket").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMS)))
    got = sums.toPandas()
    out = np.zeros((BUCKETS, DIMS))
    out[got["bucket"].to_numpy(np.int64)] = got[[f"v{i}" for i in range(DIMS)]].to_numpy(np.float64)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit context vectors beside the index vectors, so that a pooled document keeps both."""
    centred = sums / (np.abs(sums).sum(1, keepdims=True) + 1e-9)
    centred = centred - centred[np.abs(sums).sum(1) > 0].mean(0) if (np.abs(sums).sum(1) > 0).any() else centred
    unit = centred / (np.linalg.norm(centred, axis=1, keepdims=True) + 1e-9)
    unit[np.abs(sums).sum(1) == 0] = 0
    return np.concatenate((unit, index_vectors() / np.sqrt(NONZERO)), axis=1).astype(np.float32)


def pool(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """The mean context vector of the words' texts, the mean of both vectors of their shapes, and the marks' vectors
    by their shares among the words."""
    words, shapes = word_ids(text)
    out = np.zeros(WIDTH, np.float32)
    if len(words):
        out[:DIMS] = vectors[words, :DIMS].mean(0)
        out[3 * DIMS : 5 * DIMS] = (words[1:] == words[:-1]).sum() / len(words) * vectors[AGAIN]
        out[5 * DIMS :] = (1 - len(np.unique(words)) / len(words)) * vectors[SEEN]
    if len(shapes):
        out[DIMS : 3 * DIMS] = vectors[shapes].mean(0)
    return out


class Network:
    """Two layers in numpy, trained with Adam; ``temperature`` divides the logit."""

    def __init__(self, width: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.temperature = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 3e-3, decay: float = 1e-4, batch: int = 256, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        cut = rng.permutation(len(x))
        back = cut[: len(x) // 5] if len(x) >= 50 else cut
        own = cut[len(x) // 5 :] if len(x) >= 50 else cut
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-6
        self.w[3][0] = np.log((y[own].sum() + 1) / (len(own) - y[own].sum() + 1))
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(own)
            for at in range(0, len(order), batch):
                i = order[at : at + batch]
                z = (x[i] - self.mean) / self.scale
                h = np.tanh(z @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3][0], -30, 30))) - y[i]) / len(i)
                dh = d[:, None] * self.w[2] * (1 - h * h)
                grads = [z.T @ dh + decay * self.w[0], dh.sum(0), h.T @ d + decay * self.w[2], np.array([d.sum()])]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        z, yb = self.logit(x[back]), y[back]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
        loss = [np.logaddexp(0, np.where(yb == 1, -z, z) / g).mean() for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])


class Scorer:
    def __init__(self, vectors: np.ndarray, network: Network | None, base: float):
        self.vectors, self.network, self.base = vectors, network, base

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts or self.network is None:
            return np.full(len(texts), self.base)
        return self.network.probability(np.stack([pool(t.encode(), self.vectors) for t in texts]))


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_rows: int = MAX_ROWS) -> Scorer:
    vectors = word_vectors(context_sums(docs))
    sample = scratch.save(labelled(docs, labels, "quality", max_rows).repartition(12), "quality-sample")

    def pooled(batches):
        for batch in batches:
            x = np.array([pool((t or "").encode(), vectors) for t in batch.column(0).to_pylist()], np.float32).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32())), batch.column(1)], names=["x", "y"])

    rows = sample.mapInArrow(pooled, "x array<float>, y int").toPandas()  # at most max_rows
    y = rows["y"].to_numpy(np.float64)
    base = (y.sum() + 0.5) / (len(y) + 1)
    if not 0 < y.sum() < len(y):
        return Scorer(vectors, None, float(base))
    order = np.lexsort(np.stack(rows["x"].to_numpy()).T[:4])  # whatever order the rows came in
    network = Network(WIDTH)
    network.fit(np.stack(rows["x"].to_numpy())[order].astype(np.float64), y[order])
    return Scorer(vectors, network, float(base))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, scratch: Scratch | None = None, name: str = "quality") -> DataFrame:
    """All columns of docs and, under ``name``, the probability of label 1."""
    scorer = train(docs, labels, scratch or Scratch(docs.sparkSession, "quality"), max_rows)
    return with_score(docs, name, scorer.score)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).selectExpr("cast(doc_id as long) as doc_id", "text")
    out = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name="score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
