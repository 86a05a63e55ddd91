"""The fixed metadata contract of retrieval records, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia import schemas as S
from folia.functions import keys as K
from folia.functions import text as T


def as_bool(c: Column) -> Column:
    """True for true, 1, yes and y in any case; null is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def as_int(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("int")


def as_float(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")


def contract(chunks: DataFrame, defaults: DataFrame | None = None, on: str = "doc_id") -> DataFrame:
    """``chunks`` as records of the contract's fields. Missing columns are filled from ``defaults`` (joined on ``on``), else typed defaults.

    A chunk's own value wins over the document's. Text is on one line; the chunk's
    preview, lengths and token estimate win over computed ones.
    """
    if defaults is not None:
        shared = [c for c in defaults.columns if c != on]
        chunks = chunks.join(defaults.select(on, *(F.col(c).alias(f"__{c}") for c in shared)), on, "left")
        chunks = chunks.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) if c in chunks.columns else F.col(f"__{c}") for c in shared}).drop(*(f"__{c}" for c in shared))
    have = set(chunks.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    text = T.normalize_text(get("retrieval_text"))
    display = F.coalesce(T.truthy(T.normalize_text(get("display_text"))), text)
    fields = {c: T.normalize_text(get(c)) for c in S.STRING_FIELDS} | {c: as_int(get(c)) for c in S.INT_FIELDS} | {c: as_float(get(c)) for c in S.FLOAT_FIELDS} | {c: as_bool(get(c)) for c in S.BOOL_FIELDS}
    tables, images = F.coalesce(fields["table_count"], F.lit(0)), F.coalesce(fields["image_count"], F.lit(0))
    ids = F.filter(F.transform("source_block_ids", T.normalize_text), lambda x: x != "") if "source_block_ids" in have else F.array().cast("array<string>")
    own = T.normalize_text(get("vector_record_id"))
    made = K.vector_record_id(get("doc_id"), get("strategy_name"), get("chunk_id"), get("page_num"), get("chunk_index"), get("chunk_type"), F.xxhash64(text))
    fields |= {
        "vector_record_id": F.coalesce(T.truthy(own), made), "source_block_ids": F.coalesce(ids, F.array().cast("array<string>")), "retrieval_text": text, "display_text": display,
        "evidence_preview": T.evidence_preview(F.coalesce(T.truthy(get("evidence_preview").cast("string")), display)), "char_len": F.coalesce(fields["char_len"], F.length(text)), "token_estimate": F.coalesce(fields["token_estimate"], T.estimate_tokens(text)),
        "table_count": tables, "image_count": images, "has_text": fields["has_text"] | (text != ""), "has_table": fields["has_table"] | (tables > 0), "has_image": fields["has_image"] | (images > 0),
    }
    return chunks.select(*(fields[c].alias(c) for c in S.METADATA_FIELDS))


def scalar_metadata(records: DataFrame) -> DataFrame:
    """Scalar fields only, nulls as empty strings: what a vector collection filters on."""
    scalars = [c for c in S.METADATA_FIELDS if c not in ("source_block_ids", "retrieval_text", "display_text")]
    return records.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in scalars))


def distributions(records: DataFrame) -> DataFrame:
    """Records by strategy and by document, side by side (one scan, grouping sets); null or empty counts as ``unknown``."""
    named = records.select(*(F.coalesce(T.truthy(F.col(c)), F.lit("unknown")).alias(c) for c in ("strategy_name", "doc_id")))
    named = named.groupingSets([["strategy_name"], ["doc_id"]], "strategy_name", "doc_id").agg(F.count("*").alias("n"), F.grouping("strategy_name").alias("g"))
    return named.select(F.when(F.col("g") == 0, "strategy").otherwise("document").alias("kind"), F.coalesce("strategy_name", "doc_id").alias("name"), "n")


def embeddable(records: DataFrame) -> DataFrame:
    return records.filter(F.coalesce("retrieval_text", F.lit("")) != "")


def document_defaults(payloads: DataFrame, path: str = "path") -> DataFrame:
    """doc_id and strategy of chunk files from their payload, else from the parts of their names."""
    name = F.element_at(F.split(path, "/"), -1)
    parts = F.split(name, r"\.")
    strategy = F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("")
    return payloads.withColumns({"doc_id": F.coalesce(T.truthy(F.col("doc_id")), F.get(parts, F.lit(0))), "strategy_name": F.coalesce(T.truthy(F.col("strategy_name")), strategy)})


def document_header(docs: DataFrame) -> DataFrame:
    """The refined type before the type, empty values skipped."""
    return docs.withColumn("document_type", T.truthy(F.col("refined_type"), F.col("document_type")))


def with_sidecar(docs: DataFrame, sidecar: DataFrame, fields: tuple[str, ...] = ("document_type", "pipeline_used", "quality_grade")) -> DataFrame:
    """Parsed documents with their sidecar's values, met by file name; a sidecar's non-empty value wins."""
    other = sidecar.select("filename", *(F.col(c).alias(f"__{c}") for c in fields))
    return docs.join(other, "filename", "left").withColumns({c: T.truthy(F.col(f"__{c}"), F.col(c)) for c in fields}).drop(*(f"__{c}" for c in fields))
