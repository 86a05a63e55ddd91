"""Identities: the same inputs give the same key on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_text, truthy


def document_id(path: Column) -> Column:
    return F.md5(path.cast("binary"))


def stable_id(*parts: Column, length: int = 12) -> Column:
    """The first digits of the MD5 of the parts, joined by ``::``; null parts are empty."""
    return F.substring(F.md5(F.concat_ws("::", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, length)


def block_id(own: Column, kind: Column, bbox: Column, text: Column) -> Column:
    return F.coalesce(truthy(own), stable_id(kind, bbox, text))


def chunk_id(doc: Column, strategy: Column, page: Column, index: Column, kind: Column, sources: Column) -> Column:
    """``doc:strategy:p<page>:<index, 4 digits>:kind:<8 digits of the sources' hash>``; the hash input is the ids joined by ``,``."""
    return F.format_string("%s:%s:p%d:%04d:%s:%s", doc, strategy, F.coalesce(page, F.lit(0)), index, kind, stable_id(F.array_join(sources, ","), length=8))


def vector_record_id(doc: Column, strategy: Column, chunk: Column, page: Column, index: Column, kind: Column, fallback: Column) -> Column:
    base = F.concat_ws("|", *(normalize_text(x) for x in (doc, strategy, chunk, page, index, kind)))
    base = F.when(F.translate(base, "|", "") == "", F.concat(F.lit("fallback|"), fallback.cast("string"))).otherwise(base)
    return F.concat(F.lit("vec_"), F.substring(F.sha2(base.cast("binary"), 256), 1, 24))


def document_key(record: Column, chunk: Column, page: Column, index: Column, text: Column) -> Column:
    """The record's or chunk's id, else page, place and a hash of the text."""
    return F.coalesce(truthy(F.trim(record)), truthy(F.trim(chunk)), F.concat_ws(":", page.cast("string"), index.cast("string"), F.xxhash64(text).cast("string")))
