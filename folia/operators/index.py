"""Vector runs and collections as tables: joins with their metadata, upsert, delete, catalogue and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions import text as T


def payload(vectors: DataFrame, metadata: DataFrame, key: str = "vector_record_id") -> DataFrame:
    """Vectors with their metadata; those without are left to ``failed``."""
    return vectors.join(metadata, key)


def failed(vectors: DataFrame, metadata: DataFrame, key: str = "vector_record_id") -> DataFrame:
    """Ids of vectors without metadata."""
    return vectors.join(metadata.select(key), key, "left_anti").select(key)


def upserted(collection: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``collection`` with ``new`` in place of rows of the same key; of repeated new keys the last by ``version`` counts, where there is one."""
    if "version" in new.columns:
        last = F.row_number().over(W.partitionBy(key).orderBy(F.desc("version")))
        new = new.withColumn("__n", last).filter("__n = 1").drop("__n", "version")
    return collection.join(new.select(key), key, "left_anti").select(collection.columns).unionByName(new.select(collection.columns))


def without_document(records: DataFrame, doc_id, key: str = "doc_id") -> DataFrame:
    """``records`` but for one document; a null key stays."""
    return records.filter(~F.col(key).eqNullSafe(F.lit(doc_id)))


def write_run(vectors: DataFrame, metadata: DataFrame, root: str, run_id: str) -> None:
    """Write a vector run and then point ``latest`` at it: readers see the old run or the whole new one."""
    vectors.write.mode("overwrite").parquet(f"{root}/runs/{run_id}/vectors")
    metadata.write.mode("overwrite").parquet(f"{root}/runs/{run_id}/metadata")
    spark = vectors.sparkSession
    pointer = spark.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("written_at"), F.lit(vectors.count()).alias("vectors"))
    pointer.write.mode("append").parquet(f"{root}/latest")


def latest_run(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Vectors and metadata of the run that was last pointed at."""
    row = spark.read.parquet(f"{root}/latest").agg(F.max_by("run_id", "written_at").alias("run_id")).first()
    return spark.read.parquet(f"{root}/runs/{row.run_id}/vectors"), spark.read.parquet(f"{root}/runs/{row.run_id}/metadata")


def delete_document(spark: SparkSession, root: str, doc_id: str, run_id: str) -> None:
    """A new run without the document; the old one stays, so a failed delete changes nothing. Fails if the document isn't there."""
    vectors, metadata = latest_run(spark, root)
    if metadata.filter(F.col("doc_id") == doc_id).isEmpty():
        raise ValueError(f"no document {doc_id}")
    kept = without_document(metadata, doc_id)
    write_run(vectors.join(kept.select("vector_record_id"), "vector_record_id", "left_semi"), kept, root, run_id)


def ingest_summary(vectors: DataFrame, metadata: DataFrame, key: str = "vector_record_id") -> DataFrame:
    """Records seen, with and without metadata, in one pass."""
    met = vectors.select(key).join(metadata.select(key, F.lit(True).alias("met")).distinct(), key, "left")
    return met.agg(F.count("*").alias("total"), F.count("met").alias("succeeded"), (F.count("*") - F.count("met")).alias("failed"))


def catalogue(records: DataFrame) -> DataFrame:
    """Documents by file name: chunks, distinct pages, strategies."""
    return records.groupBy("filename").agg(
        F.count("*").alias("chunk_count"), F.countDistinct(F.when(F.col("page_num") > 0, F.col("page_num"))).alias("page_count"), F.array_join(F.array_sort(F.collect_set("strategy_name")), ",").alias("strategies")
    )


def with_jobs(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents and pending jobs by file name; a job's status wins. Pending first, then by name."""
    j = jobs.select("filename", F.col("status").alias("job_status"), "progress")
    both = documents.join(j, "filename", "full_outer").withColumn("status", F.coalesce("job_status", F.lit("ready"))).drop("job_status")
    return both.orderBy(F.desc(F.col("status").isin("queued", "running")), F.lower("filename"), "filename")


def latest_jobs(events: DataFrame) -> DataFrame:
    """Each job's last state by time, ties by event id."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "ts"), F.struct("ts", "event_id")).alias("s"), F.count("*").alias("n_events")).select("job_id", "s.status", "s.progress", F.col("s.ts").alias("updated_at"), "n_events")


def metadata_filter(strategy: str | None = None, filename: str | None = None, doc_id: str | None = None):
    """The conjunction of the equalities that are given; true without any."""
    out = F.lit(True)
    for name, value in (("strategy_name", strategy), ("filename", filename), ("doc_id", doc_id)):
        if value:
            out = out & (F.col(name) == value)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text once: the least id, and how many rows share it. Only hashes are shuffled."""
    hashed = docs.select(F.col(id_col), F.sha2(T.normalize_text(F.col(text_col)).cast("binary"), 256).alias("digest"))
    return hashed.groupBy("digest").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))
