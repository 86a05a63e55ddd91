"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
so all pairwise interactions cost time linear in a text's features. The model is
fitted in numpy on a bounded sample of labelled rows (``sample``) and then scores
every whole text without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .text_stats import base_counts, byte_shares
from .wordhash import U, Words

BITS = 16
FACTORS = 8
#: Labelled rows that the model is fitted on, at most: those whose ids hash lowest.
SAMPLE = 6000


class Features:
    """Rows of a sparse matrix: ``index`` and ``value`` of the entries, row i's from ``begin[i]`` on; and the dense statistics."""

    def __init__(self, texts: list[bytes], meta: np.ndarray):
        words = Words(texts, lower=True)
        bucket = (words.hashes() >> U(64 - BITS)).astype(np.int64)
        pairs, times = np.unique((words.doc.astype(np.int64) << BITS) | bucket, return_counts=True)
        owner = pairs >> BITS
        self.index = (pairs & ((1 << BITS) - 1)).astype(np.int32)
        self.begin = np.searchsorted(owner, np.arange(len(texts) + 1))
        distinct = np.diff(self.begin)
        value = np.log1p(times)
        norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=len(texts)))
        self.value = (value / norm[owner]).astype(np.float32) if len(owner) else np.zeros(0, dtype=np.float32)
        n = base_counts(texts)
        some = np.maximum(n["n_words"], 1)
        self.dense = np.column_stack([
            np.log1p(n["n_words"]), n["word_chars"] / some, np.minimum(n["n_symbols"] / some, 3), np.minimum(n["n_dup_lines"], 50) / 10, n["n_repeat_words"] / some, distinct / some, byte_shares(texts), np.log1p(np.maximum(meta, 0)),
        ]).astype(np.float32)


class Machine:
    """The fitted factorisation machine. Parameters of the dense statistics follow those of the word buckets."""

    def __init__(self, dense: np.ndarray, rng: np.random.Generator):
        self.mean, self.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-3
        size = (1 << BITS) + dense.shape[1]
        self.w0, self.w = 0.0, np.zeros(size, dtype=np.float32)
        self.v = rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32)

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -4, 4).astype(np.float32)

    def margins(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """Each row's margin and its factor sums."""
        z = self.scaled(f.dense)
        n, words = len(z), 1 << BITS
        owner = np.repeat(np.arange(n), np.diff(f.begin))
        x = f.value
        linear = np.bincount(owner, weights=self.w[f.index] * x, minlength=n) + z @ self.w[words:]
        vx = self.v[f.index] * x[:, None]
        sums, squares = z @ self.v[words:], (z * z) @ (self.v[words:] ** 2)
        filled = np.flatnonzero(np.diff(f.begin))
        if len(filled):
            at = f.begin[:-1][filled]
            sums[filled] += np.add.reduceat(vx, at, axis=0)
            squares[filled] += np.add.reduceat(vx * vx, at, axis=0)
        return self.w0 + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def scores(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(f)[0], -30, 30)))


def part(f: Features, rows: np.ndarray) -> Features:
    """Some rows of a feature matrix."""
    out = object.__new__(Features)
    lengths = np.diff(f.begin)[rows]
    out.begin = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(lengths)))
    at = np.repeat(f.begin[:-1][rows] - out.begin[:-1], lengths) + np.arange(out.begin[-1])
    out.index, out.value, out.dense = f.index[at], f.value[at], f.dense[rows]
    return out


def fit(f: Features, labels: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss; the same rows give the same model."""
    rng = np.random.default_rng(seed)
    m = Machine(f.dense, rng)
    words = 1 << BITS
    share = np.clip(labels.mean(), 0.01, 0.99) if len(labels) else 0.5
    m.w0 = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_0 = np.full_like(m.w, 1e-6), np.full_like(m.v, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            b = part(f, rows)
            margin, sums = m.margins(b)
            error = ((1 / (1 + np.exp(-np.clip(margin, -30, 30)))) - labels[rows]).astype(np.float32) / len(rows)
            owner = np.repeat(np.arange(len(rows)), np.diff(b.begin))
            z = m.scaled(b.dense)
            near, back = np.unique(b.index, return_inverse=True)
            ex = error[owner] * b.value
            grad_w = np.bincount(back, weights=ex, minlength=len(near)).astype(np.float32)
            pull = ex[:, None] * sums[owner] - (ex * b.value)[:, None] * m.v[b.index]
            grad_v = np.column_stack([np.bincount(back, weights=pull[:, k], minlength=len(near)) for k in range(FACTORS)]).astype(np.float32) if len(near) else np.zeros((0, FACTORS), dtype=np.float32)
            ids = np.concatenate((near, np.arange(words, words + z.shape[1])))
            gw = np.concatenate((grad_w, error @ z)) + decay * m.w[ids]
            gv = np.concatenate((grad_v, z.T @ (error[:, None] * sums) - ((z * z).T @ error)[:, None] * m.v[words:])) + decay * m.v[ids]
            seen_w[ids] += gw * gw
            seen_v[ids] += gv * gv
            m.w[ids] -= rate * gw / np.sqrt(seen_w[ids])
            m.v[ids] -= rate * gv / np.sqrt(seen_v[ids])
            seen_0 += float(error.sum()) ** 2
            m.w0 -= rate * float(error.sum()) / seen_0**0.5
    return m


def _meta(batch_column: pa.Array) -> np.ndarray:
    return np.array([x or 0 for x in batch_column.to_pylist()], dtype=np.float64)


def train(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_col: str | None = "n_chars", sample: int = SAMPLE, rows_each: int = 512) -> Machine | None:
    """Fit on the ``sample`` labelled rows whose ids hash lowest, of those not ``held_out``; None if there are none."""
    ids = labels.filter(~held_out & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    chosen = ids.orderBy(F.xxhash64("__id"), "__id").limit(sample)  # bounded, so it may be broadcast
    meta = F.col(meta_col) if meta_col and meta_col in docs.columns else F.length(text_col)
    joined = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), meta.cast("double").alias("__meta")).join(F.broadcast(chosen), "__id").groupBy("__id", "__label").agg(F.min(F.struct("__text", "__meta")).alias("__least")).select("__id", "__least.__text", "__least.__meta", "__label")  # one text an id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, meta = common.as_bytes(batch.column(1)), _meta(batch.column(2))
            for a, b in common.slices(texts):
                f = Features(texts[a:b], meta[a:b])
                cut = [slice(x, y) for x, y in zip(f.begin[:-1], f.begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(3)[a:b].cast(pa.int32()), pa.array([f.index[c].tobytes() for c in cut], pa.binary()), pa.array([f.value[c].tobytes() for c in cut], pa.binary()), pa.array([d.tobytes() for d in f.dense], pa.binary())],
                    names=["id", "label", "index", "value", "dense"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = common.map_batches(joined, run, f"id {kind}, label int, index binary, value binary, dense binary").toPandas().sort_values(["id", "index"])  # at most `sample` rows of at most 2**BITS word buckets
    if not len(rows):
        return None
    f = object.__new__(Features)
    f.index = np.frombuffer(b"".join(rows["index"]), dtype=np.int32)
    f.value = np.frombuffer(b"".join(rows["value"]), dtype=np.float32)
    f.begin = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum([len(x) // 4 for x in rows["index"]])))
    f.dense = np.vstack([np.frombuffer(x, dtype=np.float32) for x in rows["dense"]])
    return fit(f, rows["label"].to_numpy(dtype=np.float32))


def scored(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text", meta_col: str | None = "n_chars", threshold: float = 0.7) -> DataFrame:
    """``id_col``, score and predicted (score >= ``threshold``) of each row of ``docs``.

    Null and empty texts are scored by their statistics alone, texts of any length
    whole. A null id or null metadata (taken as 0) is no obstacle; repeated rows score
    alike, and a score at the threshold is predicted as 1. Without a model (nothing was
    labelled) every score is 0.5. An empty table gives no rows. Other columns, whatever
    their names, aren't read.
    """
    meta = F.col(meta_col) if meta_col and meta_col in docs.columns else F.length(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, about = common.as_bytes(batch.column(1)), _meta(batch.column(2))
            parts = [machine.scores(Features(texts[a:b], about[a:b])) if machine else np.full(b - a, 0.5) for a, b in common.slices(texts)]
            score = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_batches(docs.select(id_col, text_col, meta.cast("double").alias("__meta")), run, f"`{id_col}` {kind}, score double, predicted int")
