"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components.

1. One pass over the texts gives each document its shingle set's size, a 128-bit
   fingerprint and the band keys of its signature. Texts never move.
2. Equal sets collapse to one representative by fingerprint, combined before the
   shuffle, so a set that a third of all rows share is one row from here on.
3. Representatives that share a band key are tied to the key's least member. These
   ties only say which documents must be compared: their components are *families*.
4. Only families' texts are shingled again. A family is compared in blocks of
   bounded size, each pair of blocks in one task: signatures first, then full sets.
   A task returns a spanning forest of its confirmed links, never its pairs.
5. Components of the confirmed links, joined back by fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .wordhash import U, Words, mix, seeds, sequence_hash, windows

#: Documents and shingles of a block at most; a task holds two blocks.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 1_500_000


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct ``k``-word shingle hashes; a shorter text is one shingle, an empty one has none."""
    for a, b in common.slices(texts, common.FINE_BYTES):
        words = Words(texts[a:b], lower=True)
        hashes = words.hashes()
        found, at = windows(hashes, words.doc, k)
        bounds = np.searchsorted(words.doc[at], np.arange(b - a + 1))
        for i in range(b - a):
            if words.counts[i] >= k:
                yield np.unique(found[bounds[i] : bounds[i + 1]])
            elif words.counts[i]:
                yield np.array([sequence_hash(hashes[words.first[i] : words.first[i + 1]])], dtype=U)
            else:
                yield np.zeros(0, dtype=U)


class Signer:
    """``bands`` x ``rows`` minima of universal hashes x -> a x + b (odd a, modulo 2**64, upper half)."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.a = (seeds(bands * rows, 11) | U(1))[:, None]
        self.b = seeds(bands * rows, 12)[:, None]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            low = None
            for at in range(0, len(shingles), 4096):
                part = (shingles[None, at : at + 4096] * self.a + self.b).min(axis=1)
                low = part if low is None else np.minimum(low, part)
        return low >> U(32)

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band, different between bands."""
        with np.errstate(over="ignore"):
            parts = signature.reshape(self.bands, self.rows)
            key = np.arange(1, self.bands + 1, dtype=U)
            for j in range(self.rows):
                key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, j])
        return key.view(np.int64)


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, fp, keys`` of each row; fp and keys are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            texts = common.as_bytes(batch.column(1))
            n, fps, keys = [], [], []
            for s in shingle_sets(texts, k):
                n.append(len(s))
                fps.append(fingerprint(s) if len(s) else None)
                keys.append(signer.keys(signer.signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_batches(docs.select(id_col, text_col), run, f"doc_id {kind}, n_shingles bigint, fp binary, keys array<bigint>")


class _Block:
    """Documents of one task: sets, signatures, and links found so far."""

    def __init__(self, ids: list[int], blocks: list[int], sets: list[np.ndarray], signer: Signer):
        self.ids, self.blocks, self.sets = ids, np.array(blocks), sets
        self.sizes = np.array([len(s) for s in sets])
        self.signatures = np.array([signer.signature(s) & U(0xFFFF) for s in sets], dtype=np.uint16)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        tokens = tokens[order]
        self.tokens, self.begin = np.unique(tokens, return_index=True)
        self.end = np.append(self.begin[1:], len(tokens))
        self.root = np.arange(len(ids))

    def common_with(self, i: int) -> np.ndarray:
        """Shingles that each document shares with document ``i``, by the postings of its shingles."""
        at = np.searchsorted(self.tokens, self.sets[i])
        spans = [self.owner[b:e] for b, e in zip(self.begin[at].tolist(), self.end[at].tolist(), strict=True)]
        return np.bincount(np.concatenate(spans), minlength=len(self.ids))

    def link(self, percent: int, inner: set[int]) -> None:
        """Join documents whose sets meet the threshold: pairs from two blocks, and pairs inside the blocks ``inner``."""
        n = len(self.ids)
        share = percent / 100
        k = self.signatures.shape[1]
        least = k * (share - 6 * (share * (1 - share) / k) ** 0.5)
        for i in range(n):
            size = self.sizes
            apart = (self.root != self.root[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            if self.blocks[i] not in inner:
                apart &= self.blocks != self.blocks[i]
            cand = np.flatnonzero(apart)
            if not len(cand):
                continue
            agree = (self.signatures[cand] == self.signatures[i]).sum(axis=1)
            cand = cand[agree >= least]
            if not len(cand):
                continue
            both = self.common_with(i)[cand]
            linked = cand[100 * both >= percent * (size[cand] + size[i] - both)]
            if len(linked):
                roots = np.unique(np.append(self.root[linked], self.root[i]))
                self.root[np.isin(self.root, roots)] = roots[0]


def confirmed_links(family_docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``a, b``: a spanning forest of the links inside each family, from rows doc_id, text, family, parts.

    ``parts``: blocks of the family. Each row goes to one task for each block that
    it is compared with; a family of one block is one task.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(common.as_bytes(batch.column(1)), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64())), *batch.columns[2:]], names=["doc_id", "shingles", "family", "parts"])

    sets = common.map_batches(family_docs.select("doc_id", "text", "family", "parts"), shingled, "doc_id bigint, shingles array<bigint>, family bigint, parts int")
    dealt = (
        sets.withColumn("own", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .filter("parts = 1 or own <> other")
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .select("family", "i", "j", "parts", "own", "doc_id", "shingles")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        key, held = None, []

        def done() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            block = _Block([h[0] for h in held], [h[1] for h in held], [h[2] for h in held], signer)
            _, i, j, parts = key
            inner = ({i} if j <= i + 1 else set()) | ({j} if parts == j + 1 == i + 2 else set())  # each block's own pairs in one task
            block.link(percent, inner)
            least: dict[int, int] = {}
            for root, one in zip(block.root.tolist(), block.ids, strict=True):
                least[root] = min(one, least.get(root, one))
            links = [(one, least[root]) for root, one in zip(block.root.tolist(), block.ids, strict=True) if one != least[root]]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            shingles = batch.column(6)
            values, offsets = shingles.flatten().to_numpy(zero_copy_only=False).view(U), shingles.offsets.to_numpy() - shingles.offsets[0].as_py()
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for n, (*now, own, one) in enumerate(zip(*columns, strict=True)):
                if tuple(now) != key:
                    if (out := done()) is not None:
                        yield out
                    key, held = tuple(now), []
                held.append((one, own, values[offsets[n] : offsets[n + 1]].copy()))
        if (out := done()) is not None:
            yield out

    return common.map_batches(dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j"), compare, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 36, rows: int = 5, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = common.BROADCAST_ROWS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs`` (integer ids).

    Documents whose sets of distinct ``k``-word shingles (A-Z lower-cased) have
    100 * intersection >= ``percent`` * union are linked; component_id is the least
    doc_id reachable, kept tells whether that is the document itself. A pair at the
    threshold t is missed by every band with probability (1 - t**rows)**bands.
    A text with fewer words is one shingle; null, empty or blank texts have none
    and are linked with nothing; texts of any length count whole. A null id:
    component_id null, kept. Rows that repeat an id share its component; of equal
    ids none is preferred, as all are kept or none. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rowset = common.stored(signed(texts, k, bands, rows, "doc_id", "text"), "signed")
    reps = common.stored(
        rowset.filter("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("copies")), "reps"
    )
    banded = reps.select("rep", F.explode("keys").alias("key"))
    heads = banded.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("members")).filter("members > 1").select("key", "head")
    ties = common.looked_up(banded, heads, "key", "inner", broadcast_rows).filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    families = components(ties, broadcast_rows=broadcast_rows)
    sized = families.join(reps.select(F.col("rep").alias("node"), "n"), "node")
    parts = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    measured = sized.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).select("component", parts.alias("parts"))
    members = common.stored(families.join(measured, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("family"), "parts"), "members")
    few = common.small_enough(members, broadcast_rows)
    links = confirmed_links(texts.join(F.broadcast(members) if few else members, "doc_id"), k, percent, bands, rows)
    found = components(links, broadcast_rows=broadcast_rows)
    # a set of one document that is linked with nothing needs no look-up
    by_set = reps.join(found, reps["rep"] == found["node"], "left").filter("component is not null or copies > 1").select("fp", F.coalesce("component", "rep").alias("component"))
    return common.looked_up(rowset.select("doc_id", "n_shingles", "fp"), by_set, "fp", rows=broadcast_rows).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, broadcast_rows: int = common.BROADCAST_ROWS, **options) -> DataFrame:
    """The rows and columns of ``docs`` but for documents that aren't kept; see ``near_duplicates``.

    Null ids and texts without words stay; rows that repeat a kept id all stay. An
    empty table stays empty; other columns, whatever their names, pass through.
    """
    id_col = options.get("id_col", "doc_id")
    dropped = near_duplicates(docs, broadcast_rows=broadcast_rows, **options).filter("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    dropped = common.stored(dropped, "dropped")
    few = common.small_enough(dropped, broadcast_rows)
    return docs.join(F.broadcast(dropped) if few else dropped, id_col, "left_anti")
