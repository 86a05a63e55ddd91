"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger
is an append-only Parquet table of (blob, rule version) pairs already scanned, with
their findings. A scan takes each content once, leaves out pairs that the ledger
has, scans the rest, appends them, and joins the findings back to all paths.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Rules besides the base ones; each needs a fixed prefix that ordinary text doesn't have.
_MORE = {
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    "ghtoken": re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}
#: Follows from the patterns and the least lengths: after any change of the rules all blobs are scanned again.
RULE_VERSION = zlib.crc32(repr([(p.pattern, p.flags) for p in (_ASSIGN, _ACCESS, _HEX, *_MORE.values())] + [12, 18, 16]).encode())
_ORDER = {kind: i for i, kind in enumerate(("assign", "access", "hex", *_MORE))}
_FINDINGS = "n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string"


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each secret, in code points with the end exclusive, by start and then kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    for kind, mark in (("pem", "PRIVATE KEY"), ("ghtoken", "gh"), ("slack", "xox"), ("jwt", "eyJ")):
        if mark in text:
            found += [(m.start(), m.end(), kind) for m in _MORE[kind].finditer(text)]
    return sorted(found, key=lambda x: (x[0], _ORDER[x[2]], x[1]))


def _row(text: str) -> tuple[int, int, int, str, str]:
    found = find_secrets(text)
    shown = [f"{kind}:{a}:{b}" for a, b, kind in found]
    base = [s for s, (_, _, kind) in zip(shown, found, strict=True) if kind in ("assign", "access", "hex")]
    n = [sum(kind == k for _, _, kind in found) for k in ("assign", "access", "hex")]
    return *n, ",".join(base), ",".join(shown)


def addressed(versions: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Paths (id, blob) and contents (blob, packed text), without a shuffle. Null text is the empty blob."""
    import hashlib  # noqa: F401  workers import it too

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        recent: set[bytes] = set()
        for batch in batches:
            blobs, packed = [], []
            for text in common.as_bytes(batch.column(0)):
                blob = hashlib.sha256(text).digest()
                if blob in recent:  # a copy that this task has just sent
                    continue
                if len(recent) >= 200_000:
                    recent.clear()
                recent.add(blob)
                blobs.append(blob)
                packed.append(packer.compress(text))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(packed, pa.binary())], names=["blob", "packed"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = versions.select(F.col(id_col), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
    return paths, common.map_batches(versions.select(text_col), pack, "blob binary, packed binary")


def scan(contents: DataFrame) -> DataFrame:
    """Findings of each content (blob, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = [_row(unpacker.decompress(p.as_py()).decode("utf-8", "replace")) for p in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["blob", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return common.map_batches(contents.select("blob", "packed"), run, f"blob binary, {_FINDINGS}")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty before the first scan."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = f"blob binary, rule_version bigint, {_FINDINGS}"
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def update_ledger(versions: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """Scan what the ledger at ``path`` lacks and append it. Returns the paths: ``id_col``, blob."""
    spark = versions.sparkSession
    paths, contents = addressed(versions, id_col, text_col)
    known = ledger(spark, path).filter(F.col("rule_version") == rule_version).select("blob").distinct()
    unseen = contents.groupBy("blob").agg(F.first("packed").alias("packed")).join(known, "blob", "left_anti")
    scan(unseen).withColumn("rule_version", F.lit(rule_version).cast("bigint")).write.mode("append").parquet(path)
    return paths


def findings(versions: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """``id_col``, n_assign, n_access, n_hex, base_spans and spans of every path, after bringing the ledger up to date.

    Each row of ``versions`` is a version of a path: repeated rows and null ids each
    get their content's findings; null and empty texts have none. Whole contents of
    any length are scanned; secrets that begin at one place come in the order of their
    kinds. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    paths = update_ledger(versions, path, id_col, text_col, rule_version)
    found = ledger(versions.sparkSession, path).filter(F.col("rule_version") == rule_version).dropDuplicates(["blob"])
    some = found.filter("spans <> ''").drop("rule_version")
    joined = common.looked_up(paths, some, "blob")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return joined.select(id_col, *zero, *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")))


def redacted(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs``, with ``[REDACTED kind]`` in place of each secret; n_chars, if there, is brought up to date.

    Overlapping secrets become one mark, of the first one's kind. Rows without
    secrets, null texts included, stay as they are; repeated rows are treated alike,
    texts of any length whole, and an empty table gives no rows. Other columns,
    whatever their names, pass through.
    """
    own, shown = ("__" + name + "_" * (1 + max(map(len, docs.columns))) for name in ("blob", "spans"))  # longer than any column of docs
    update_ledger(docs.select(F.lit(None).cast("bigint").alias("doc_id"), text_col), path, "doc_id", text_col)
    some = ledger(docs.sparkSession, path).filter((F.col("rule_version") == RULE_VERSION) & (F.col("spans") != "")).select(F.col("blob").alias(own), F.col("spans").alias(shown)).dropDuplicates([own])
    blob = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    joined = common.looked_up(docs.withColumn(own, blob), some, own, rows=200_000).select(*(F.col(f"`{c}`") for c in docs.columns), shown)
    at = docs.columns.index(text_col)
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            columns = list(batch.columns[:-1])
            if any(spans):
                texts = columns[at].to_pylist()
                lengths = columns[size].to_pylist() if size is not None else None
                for i, s in enumerate(spans):
                    if s:
                        texts[i] = redact(texts[i], s)
                        if lengths is not None:
                            lengths[i] = len(texts[i])
                columns[at] = pa.array(texts, columns[at].type)
                if size is not None:
                    columns[size] = pa.array(lengths, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(i) for i in range(len(columns))]))

    return common.map_batches(joined, run, docs.schema)


def redact(text: str, spans: str) -> str:
    """``text`` with a mark in place of each ``kind:start:end``."""
    out, at = [], 0
    for kind, start, end in sorted((tuple(s.split(":")) for s in spans.split(",")), key=lambda s: int(s[1])):
        a, b = int(start), int(end)
        if a >= at:
            out += [text[at:a], f"[REDACTED {kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
