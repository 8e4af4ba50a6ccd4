"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut in overlapping chunks of CHUNK bytes that cover all of it. In a chunk, filters over WIDTH bytes
slide in steps of two bytes and are max-pooled; a small layer makes features of that, and the greatest and the
mean value of each feature over all chunks make the probability. The sample that it is trained on is bounded
by `most` rows and `most_bytes`; it takes rows by a hash of their id, as many of either label as there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import keyed, settle, slabs, strings

CHUNK, STEP = 256, 224
WIDTH, DIM, FILTERS, HIDDEN = 8, 8, 24, 16
MOST, MOST_BYTES, EPOCHS, BATCH = 3000, 16 << 20, 14, 48


def places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the chunks of all texts begin, how many bytes their text has from there, and which begin a text. An empty text has one."""
    size = np.diff(at)
    n = np.maximum(1, -(-(size - CHUNK) // STEP) + 1)
    head = np.cumsum(n) - n
    begin = np.repeat(at[:-1], n) + (np.arange(n.sum()) - np.repeat(head, n)) * STEP
    return begin, np.repeat(at[1:], n) - begin, head


def gather(data: np.ndarray, begin: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Chunks, padded with zeros."""
    out = data[np.minimum(begin[:, None] + np.arange(CHUNK), len(data) - 1)] if len(data) else np.zeros((len(begin), CHUNK), np.uint8)
    out[np.arange(CHUNK) >= left[:, None]] = 0
    return out


def chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of some texts, and which begin a text."""
    begin, left, head = places(at)
    return gather(data, begin, left), head


@dataclass
class Network:
    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def new(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        g = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        parts, each = WIDTH // 2, 2 * DIM
        return cls(
            g(256, DIM, scale=0.5), g(parts, each, FILTERS, scale=(1 / (parts * each)) ** 0.5), np.zeros(FILTERS, np.float32), g(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5),
            np.zeros(HIDDEN, np.float32), g(2 * HIDDEN, scale=(1 / HIDDEN) ** 0.5), np.zeros(1, np.float32),
        )

    def pooled(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedded chunks, the filters' greatest values in each, and where they are."""
        x = self.emb[some].reshape(len(some), CHUNK // 2, 2 * DIM)
        places = CHUNK // 2 - WIDTH // 2 + 1
        a = x[:, :places] @ self.conv[0]
        for s in range(1, WIDTH // 2):
            a += x[:, s : s + places] @ self.conv[s]
        return x, a.max(axis=1), a

    def features(self, v: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(v + self.bias, 0) @ self.w1 + self.b1, 0)

    def combine(self, u: np.ndarray, head: np.ndarray) -> np.ndarray:
        n = np.diff(np.append(head, len(u)))[:, None]
        return np.concatenate([np.maximum.reduceat(u, head), np.add.reduceat(u, head) / n], axis=1).astype(u.dtype)

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A probability for each text; 256 chunks are in work at a time."""
        begin, left, head = places(at)
        v = np.concatenate([self.pooled(gather(data, begin[i : i + 256], left[i : i + 256]))[1] for i in range(0, len(begin), 256)])
        z = self.combine(self.features(v), head) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def step(self, some: np.ndarray, head: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted log loss."""
        x, v, a = self.pooled(some)
        r = np.maximum(v + self.bias, 0)
        h = r @ self.w1 + self.b1
        u = np.maximum(h, 0)
        n = np.diff(np.append(head, len(u)))
        z = self.combine(u, head)
        p = 1 / (1 + np.exp(-(z @ self.w2 + self.b2)))
        d = ((p - y) * weight / weight.sum()).astype(np.float32)
        dz = d[:, None] * self.w2
        top = np.repeat(z[:, :HIDDEN], n, axis=0) == u
        share = top / np.maximum(1, np.repeat(np.add.reduceat(top, head, dtype=np.float32), n, axis=0))
        du = np.repeat(dz[:, :HIDDEN], n, axis=0) * share + np.repeat(dz[:, HIDDEN:] / n[:, None], n, axis=0)
        dh = (du * (h > 0)).astype(np.float32)
        dv = (dh @ self.w1.T) * (v + self.bias > 0)
        k = a.argmax(axis=1)
        chunk = np.repeat(np.arange(len(some)), FILTERS)
        conv, emb = np.zeros_like(self.conv), np.zeros((256, DIM), np.float32)
        for s in range(WIDTH // 2):
            at = (k + s).ravel()
            rows = x[chunk, at].reshape(len(some), FILTERS, 2 * DIM)
            conv[s] = np.einsum("cfd,cf->df", rows, dv)
            dx = dv[..., None] * self.conv[s].T
            for half in range(2):
                byte = some[chunk, 2 * at + half]
                g = dx[..., half * DIM : (half + 1) * DIM].reshape(-1, DIM)
                for j in range(DIM):
                    emb[:, j] += np.bincount(byte, g[:, j], 256).astype(np.float32)
        return [emb, conv, dv.sum(axis=0), r.T @ dh, dh.sum(axis=0), z.T @ d, d.sum(keepdims=True)]


def train(texts: list[bytes], y: np.ndarray, prior: float, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Adam over batches; rows weigh so that label 1 has the share `prior` of all."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    names = list(net.__dataclass_fields__)
    m, v = ([np.zeros_like(getattr(net, k)) for k in names] for _ in range(2))
    ones = max(1, int(y.sum()))
    weights = np.where(y == 1, prior / ones, (1 - prior) / max(1, len(y) - ones)) * len(y)
    t = 0
    for epoch in range(epochs):
        rate = 4e-3 * (1 - epoch / epochs) + 3e-4
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            some = [texts[k] for k in rows]
            at = np.concatenate([[0], np.cumsum([len(x) for x in some])])
            t += 1
            grads = net.step(*chunks(np.frombuffer(b"".join(some), np.uint8), at), y[rows], weights[rows])
            for j, (k, g) in enumerate(zip(names, grads, strict=True)):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                getattr(net, k)[...] -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-7)
    return net


def fold(of: int) -> Column:
    """crc32 of the id as text, modulo `of`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, most_bytes: int) -> tuple[list[bytes], np.ndarray, float]:
    """Texts of at most `most` usable labelled rows and `most_bytes`, their labels, and label 1's share among all usable rows.

    Rows come in the order of a hash of their id, half of them of either label while both last; of documents that
    share an id one is taken, by a hash of its text. Texts over half of most_bytes aren't taken. One pass over the documents.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    n = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    zero, one = (known.where(F.col("y") == v).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for v in (0, 1))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes // 2)
    joined = own.join(F.broadcast(zero.unionByName(one)), "doc_id")  # at most `most` ids
    found = settle(joined.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("doc_id", "y", "x.text"))
    chosen, left = [], [most_bytes // 2] * 2
    for y, _, doc_id, size in sorted(map(tuple, found.select("y", F.xxhash64("doc_id"), "doc_id", F.octet_length("text")).collect())):  # at most `most` rows
        if size <= left[y]:
            left[y] -= size
            chosen.append((doc_id, y))
    at = {x: k for k, x in enumerate(chosen)}
    texts: list[bytes] = [b""] * len(chosen)
    if chosen:
        some = spark.createDataFrame(chosen, "doc_id long, y int")
        for doc_id, y, text in found.join(F.broadcast(some), ["doc_id", "y"]).toLocalIterator():  # at most most_bytes
            texts[at[doc_id, y]] = text.encode()
    total = n.get(0, 0) + n.get(1, 0)
    return texts, np.array([y for _, y in chosen], np.float32), n.get(1, 0) / total if total else 0.5


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, most: int = MOST, most_bytes: int = MOST_BYTES) -> Network:
    """Train on a bounded sample of the usable labelled rows; without any, a network that says 0.5 at first."""
    texts, y, prior = sample(docs, labels, label, F.lit(True) if usable is None else usable, most, most_bytes)
    return train(texts, y, min(max(prior, 0.01), 0.99))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, key (tells rows of one doc_id apart) and score (label 1's probability) of each row, from its whole text. Null is empty; an empty text is a chunk of padding."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))  # some kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        for b in batches:
            data, at = strings(b.column(2))
            p = [own.scores(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slabs(at, 1 << 20)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(p) if p else np.zeros(0))], ["doc_id", "key", "score"])

    return keyed(docs).select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, score double")


def keep_good(docs: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is at least `least`; one pass, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        for b in batches:
            data, at = strings(b.column(text))
            p = [own.scores(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slabs(at, 1 << 20)]
            if p:
                yield b.filter(pa.array(np.concatenate(p) >= least))

    return docs.mapInArrow(run, docs.schema)
