"""The queries of the training-data operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabularies keep ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_fm import scored, train

    docs = common.table(spark, sf_dir, "documents")
    machine = train(docs, common.table(spark, sf_dir, "labels"), common.held_out(4, 2))
    return scored(docs, machine).select("doc_id", common.held_out(4, 2).alias("held_out"), "score", "predicted")


URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number ends its path."""
    from .url_templates import path_of, verdicts

    labels = common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_key"), (1 - F.col("quality")).alias("bad"))
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(\.[A-Za-z]+)?/?$", 1)
    return verdicts(common.table(spark, sf_dir, "pages"), URL_RULES, labels, F.when(number != "", number.cast("bigint")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(common.table(spark, sf_dir, "documents"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_ledger import findings

    found = findings(common.table(spark, sf_dir, "documents"), common.fresh_path(spark, "ledger"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op6_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .attention_lm import scored

    found = scored(common.table(spark, sf_dir, "documents"), ~common.held_out(5, 1), tokenizer_path())
    return found.select("doc_id", common.held_out(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    trusted = common.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return judged(common.table(spark, sf_dir, "documents"), trusted)


def op8_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_writer import read, write

    folder = common.fresh_path(spark, "warc")
    records = read(write(common.table(spark, sf_dir, "pages"), folder), folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(common.table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"), k=3, percent=85, bands=28, rows=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fm": op1_quality_fm,
    "op2_url_templates": op2_url_templates,
    "op3_decontaminate": op3_decontaminate,
    "op4_pfair_mixing": op4_pfair_mixing,
    "op5_secret_ledger": op5_secret_ledger,
    "op6_attention_lm": op6_attention_lm,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc_writer": op8_warc_writer,
    "op9_token_counts": op9_token_counts,
    "op10_minhash_dedup": op10_minhash_dedup,
}

ORACLES: dict[str, str] = {
    "op8_warc_writer": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
             f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
        SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN p.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id > f.first_id THEN f.first_id END AS refers_to, TRUE AS payload_ok
        FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
    """,
}
