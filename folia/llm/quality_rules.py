"""Quality rules: counts of each text and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted over the whole corpus: one
from the trusted target documents, one from all documents. A text's score is the
mean, over its n-grams, of the log of their ratio; texts below a fixed threshold
are rejected. Only the bounded table of buckets ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .text_stats import base_counts

N, BITS = 3, 16
#: Mean log ratio (natural) that a kept text has at least. Prose in a language that a small trusted sample happens to
#: under-represent stays above it; marked-up, shouted or listed junk lies at -1 and below.
MIN_LLR = -0.7
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def hashed_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of the joined texts, and where each text's own begin and end."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n" * N, dtype=np.uint8).astype(np.uint32)
    gram = raw[: len(raw) - N + 1].copy()
    for j in range(1, N):
        gram = (gram << np.uint32(8)) | raw[j : len(raw) - N + 1 + j]
    buckets = (gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(lengths + 1)[:-1]))
    return buckets, begin, begin + np.maximum(lengths - N + 1, 0)


def count_grams(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> np.ndarray:
    """Counts of each bucket in all documents (row 0) and in the trusted ones (row 1)."""
    ids = trusted.select(F.col(id_col).alias("__trusted_id")).filter("__trusted_id is not null").distinct()
    few = common.small_enough(ids, broadcast_rows)
    marked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(ids) if few else ids, F.col("__id") == F.col("__trusted_id"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            texts, is_trusted = common.as_bytes(batch.column(0)), batch.column(1).to_pylist()
            for a, b in common.slices(texts, common.FINE_BYTES):
                buckets, begin, end = hashed_grams(texts[a:b])
                own = np.zeros(len(buckets) + 1, dtype=np.int8)
                mine = np.zeros(len(buckets) + 1, dtype=np.int8)
                for x, y, t in zip(begin.tolist(), end.tolist(), is_trusted[a:b], strict=True):
                    own[x:y] = 1
                    if t:
                        mine[x:y] = 1
                total[0] += np.bincount(buckets[own[:-1] > 0], minlength=1 << BITS)
                total[1] += np.bincount(buckets[mine[:-1] > 0], minlength=1 << BITS)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[0][seen]), pa.array(total[1][seen])], names=["bucket", "raw", "target"])

    counted = common.map_batches(marked.select("__text", F.col("__trusted_id").isNotNull()), run, "bucket bigint, raw bigint, target bigint")
    out = np.zeros((2, 1 << BITS), dtype=np.float64)
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most 2**BITS rows
    out[0, rows["bucket"]], out[1, rows["bucket"]] = rows["raw"], rows["target"]
    return out


def log_ratio(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of target over raw probability of each bucket; all zero where nothing is trusted."""
    if not counts[1].sum():
        return np.zeros(counts.shape[1])
    share = (counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * counts.shape[1])
    return np.log(share[1]) - np.log(share[0])


def judged(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_llr: float = MIN_LLR, broadcast_rows: int = common.BROADCAST_ROWS, extra: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the five counts, base_failed, kept and llr of each row of ``docs``.

    ``trusted``: ids (``id_col``) of the target documents; others and repeats are
    ignored. base_failed: under 10 words, or over 20 % of the words in repeated
    5-word windows. kept: not base_failed and llr >= ``min_llr``. A null or empty
    text has zero counts, llr 0 and fails; a null id is judged like any other. No
    trusted text: every llr is 0. ``extra``: columns of ``docs`` passed through.
    """
    ratio = log_ratio(count_grams(docs, trusted, id_col, text_col, broadcast_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.as_bytes(batch.column(1))
            parts: dict[str, list] = {c: [] for c in (*_COUNTS, "llr")}
            for a, b in common.slices(texts, common.FINE_BYTES):
                for c, v in base_counts(texts[a:b]).items():
                    parts[c].append(v)
                buckets, begin, end = hashed_grams(texts[a:b])
                total = np.concatenate((np.zeros(1), np.cumsum(ratio[buckets])))
                parts["llr"].append((total[end] - total[begin]) / np.maximum(end - begin, 1))
            got = {c: np.concatenate(v) if v else np.zeros(0) for c, v in parts.items()}
            failed = (got["n_words"] < 10) | (100 * got["n_repeat_words"] > 20 * got["n_words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], *(pa.array(got[c].astype(np.int64)) for c in _COUNTS), pa.array(failed), pa.array(~failed & (got["llr"] >= min_llr)), pa.array(got["llr"])],
                names=[id_col, *extra, *_COUNTS, "base_failed", "kept", "llr"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (id_col, *extra)), *(f"{c} bigint" for c in _COUNTS), "base_failed boolean, kept boolean, llr double"])
    return common.map_batches(docs.select(id_col, text_col, *extra), run, schema)


def accepted(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_llr: float = MIN_LLR) -> DataFrame:
    """The rows and columns of ``docs`` whose text is kept by ``judged``; the text passes through, nothing is joined back."""
    ratio = log_ratio(count_grams(docs, trusted, id_col, text_col, common.BROADCAST_ROWS))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.as_bytes(batch.column(at))
            keep = []
            for a, b in common.slices(texts, common.FINE_BYTES):
                n = base_counts(texts[a:b])
                buckets, begin, end = hashed_grams(texts[a:b])
                total = np.concatenate((np.zeros(1), np.cumsum(ratio[buckets])))
                llr = (total[end] - total[begin]) / np.maximum(end - begin, 1)
                keep.append((n["n_words"] >= 10) & (100 * n["n_repeat_words"] <= 20 * n["n_words"]) & (llr >= min_llr))
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, dtype=bool)))

    return common.map_batches(docs, run, docs.schema)
