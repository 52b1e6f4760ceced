"""Quality classifier: random-indexing word vectors and a two-layer network.

Every word has a sparse ternary index vector given by rule; a word's vector
is its index vector plus the index vectors of the words around it in the
training texts (random indexing). A document is the mean of its words'
vectors, next to the mean of vectors for the words' written shapes, and a
two-layer NumPy network turns that into a probability, calibrated by a
temperature fitted on labelled rows that took no part in training.

Only the fit uses a sample: at most ``SAMPLE`` labelled rows outside the
held-out fifth, with at most ``SAMPLE_CHARS`` characters each. Scoring reads
every whole text and nothing but the text.

Defined results: null and empty texts have an all-zero vector and still get
a score; ids may be null (never held out) or repeated; labels that are null
are not learnt from; without labelled rows every score is 0.5; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, opened, packed, settled, share, ship

SAMPLE, SAMPLE_CHARS = 6000, 50_000
FOLDS, THRESHOLD = 5, 0.3
BUCKETS, SHAPES, DIM, SHAPE_DIM, HIDDEN = 1 << 15, 256, 64, 32, 32
WINDOW, NONZERO = 2, 6
MEMO = 500_000


def index_vectors(rows: int, dim: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors, one per row, from a seeded rule."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, dim), np.float32)
    at = rng.integers(0, dim, (rows, NONZERO))
    out[np.arange(rows)[:, None], at] = rng.choice(np.float32([-1, 1]), (rows, NONZERO))
    return out


def shape_of(word: str) -> str:
    """Written shape: letter case, digits and punctuation kept as runs, e.g. ``Aa,`` or ``A!!``."""
    out = []
    for c in word[:12] + word[-4:] if len(word) > 16 else word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if k not in "Aa0" or not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class Model:
    """Word vectors, shape vectors and the network; texts are scored in batches."""

    def __init__(self):
        self.words = index_vectors(BUCKETS, DIM, 1)
        self.shapes = index_vectors(SHAPES, SHAPE_DIM, 2)
        self.mean, self.std = np.zeros(DIM + SHAPE_DIM + 1, np.float32), np.ones(DIM + SHAPE_DIM + 1, np.float32)
        self.net, self.temperature, self._memo = None, 1.0, {}

    def __getstate__(self):
        return {**self.__dict__, "_memo": {}}

    def codes(self, text: str) -> np.ndarray:
        """One integer per word: word bucket and shape bucket."""
        memo, out = self._memo, []
        for w in text.split():
            code = memo.get(w)
            if code is None:
                if len(memo) > MEMO:
                    memo.clear()
                bare = "".join(c for c in w.lower() if c.isalnum()) or w
                code = memo[w] = (zlib.crc32(bare.encode()) % BUCKETS * SHAPES
                                  + zlib.crc32(shape_of(w).encode()) % SHAPES)
            out.append(code)
        return np.array(out, np.int64)

    def learn_contexts(self, texts: list[str]) -> None:
        """Random indexing: adds the index vectors of neighbouring words, then scales to unit length."""
        base, total = self.words, np.zeros_like(self.words)
        for text in texts:
            w = self.codes(text) // SHAPES
            for d in range(1, WINDOW + 1):
                for a, b in ((w[:-d], w[d:]), (w[d:], w[:-d])):
                    if len(a):
                        order = np.argsort(a, kind="stable")
                        at = np.flatnonzero(np.concatenate(([True], np.diff(a[order]) != 0)))
                        total[a[order][at]] += np.add.reduceat(base[b[order]], at)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        self.words = base / np.sqrt(NONZERO) + total / np.maximum(norm, 1)

    def vector(self, text: str) -> np.ndarray:
        c = self.codes(text)
        if not len(c):
            return np.zeros(DIM + SHAPE_DIM + 1, np.float32)
        words = np.zeros(DIM, np.float32)
        for k in range(0, len(c), 65536):  # long texts in parts, so memory stays bounded
            words += self.words[c[k:k + 65536] // SHAPES].sum(axis=0)
        shapes = np.bincount(c % SHAPES, minlength=SHAPES).astype(np.float32) @ self.shapes
        again = np.count_nonzero(c[1:] // SHAPES == c[:-1] // SHAPES)  # a word that follows itself
        return np.concatenate([words, shapes, [again]]).astype(np.float32) / len(c)

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(x), np.float32)
        w1, b1, w2, b2 = self.net
        h = np.maximum((x - self.mean) / self.std @ w1 + b1, 0)
        return (h @ w2 + b2)[:, 0]

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.stack([self.vector(t) for t in texts]) if texts else np.zeros((0, DIM + SHAPE_DIM + 1), np.float32)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30).astype(np.float64)))

    def fit(self, texts: list[str], labels: np.ndarray, seed: int = 3, epochs: int = 60) -> Model:
        if not len(texts):
            return self
        self.learn_contexts(texts)
        x, y = np.stack([self.vector(t) for t in texts]), labels.astype(np.float32)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        n_cal = max(1, len(x) // 6) if len(x) > 5 else 0
        cal, fit = order[:n_cal], order[n_cal:]
        self.mean, self.std = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-4
        z = (x - self.mean) / self.std
        self.net = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)).astype(np.float32),
                    np.zeros(HIDDEN, np.float32), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, 1)).astype(np.float32),
                    np.zeros(1, np.float32)]
        m, v, step = [0 * p for p in self.net], [0 * p for p in self.net], 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
                w1, b1, w2, b2 = self.net
                h = np.maximum(z[part] @ w1 + b1, 0)
                d = (1 / (1 + np.exp(-np.clip((h @ w2 + b2)[:, 0], -30, 30))) - y[part])[:, None] / len(part)
                back = d @ w2.T * (h > 0)
                grads = [z[part].T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ d + 1e-4 * w2, d.sum(axis=0)]
                step += 1
                for k, g in enumerate(grads):  # Adam
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.net[k] = self.net[k] - 3e-3 * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        if n_cal:
            self.temperature = self._calibrate(self.logits(x[cal]), y[cal])
        return self

    @staticmethod
    def _calibrate(logits: np.ndarray, y: np.ndarray) -> float:
        """Temperature with the least log loss on rows outside the fit."""
        grid = np.geomspace(0.5, 10, 60)
        loss = [np.logaddexp(0, -np.where(y > 0, logits, -logits) / t).mean() for t in grid]
        return float(grid[int(np.argmin(loss))])


def held_out(id_col: str | Column) -> Column:
    """The fifth of the rows that is never learnt from."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows outside the held-out fifth, chosen by a hash of the id."""
    known = packed(labels.select(id_col, label_col), id_col, label_col).filter(
        F.col("_0").isNotNull() & ~held_out("_0") & F.col("_1").isNotNull())
    # repeated labels count once: the sample is of distinct (id, label) pairs
    picked = settled(hash_sample(known.select("_0", "_1").distinct(), sample, "_0", "_1"))
    texts = packed(docs.select(id_col, text_col), id_col, text_col).select(F.col("_0").alias("_id"), F.col("_1").alias("_t"))
    texts = texts.filter(F.length("_t") <= SAMPLE_CHARS).withColumn("_d", F.sha2("_t", 256))
    # at most ``sample`` ids and digests: the broadcasts have a fixed bound, and so has what reaches the
    # driver. A semi-join keeps a document's row once however often its label is repeated, and equal
    # rows are merged by digest before any text moves.
    known_texts = texts.join(F.broadcast(picked), F.col("_id") == F.col("_0"), "left_semi")
    cut = hash_sample(known_texts.select("_id", "_d").distinct(), sample, "_id", "_d")
    rows = known_texts.join(F.broadcast(cut), ["_id", "_d"]).dropDuplicates(["_id", "_d"]).select("_id", "_t")
    rows = rows.join(F.broadcast(picked), F.col("_id") == F.col("_0")).select("_id", "_t", "_1").collect()
    rows = sorted((str(r[0]), r[1], int(r[2])) for r in rows)[:sample]
    return Model().fit([r[1] for r in rows], np.array([r[2] for r in rows], np.float32))


def _score(shared):
    def run(batches):
        model = opened(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            kept = batch.select(range(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(model.score(texts), pa.float64())],
                                             [*kept.schema.names, "score"])
    return run


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score``, the calibrated probability of label 1, of each document."""
    df = packed(docs.select(id_col, text_col), id_col, text_col).select("_0", "_1")
    schema = T.StructType([df.schema["_0"]]).add("score", "double")
    shared = share(docs.sparkSession, model)
    return df.mapInArrow(_score(shared), schema).withColumnRenamed("_0", id_col)


ship(__name__)
