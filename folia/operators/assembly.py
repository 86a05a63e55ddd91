"""From pages and sidecars to chunk payloads: sidecar joins, titles and priorities of groups, both strategies' chunks, their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia import schemas as S
from folia.functions import keys as K
from folia.functions import text as T

from . import chunking

AT = ["doc_id", "page_num"]
CHUNKS = "chunk_id string, doc_id string, page_num int, chunk_index int, chunk_type string, page_title string, retrieval_text string, display_text string, char_len int, token_estimate int, strategy_name string"


# --- sidecars ------------------------------------------------------------------------------------------------------


def with_sidecar_text(pages: DataFrame, sidecar: DataFrame) -> DataFrame:
    """``pages`` whose missing ``rag_text`` comes from the sidecar's page of the same number."""
    extra = sidecar.select(*AT, F.col("rag_text").alias("__side"))
    own = [c for c in pages.columns if c not in (*AT, "rag_text")]
    return pages.join(extra, AT, "left").select(*AT, *own, F.coalesce(T.truthy(T.clean_text(F.col("rag_text")), T.clean_text(F.col("__side"))), F.lit("")).alias("rag_text"))


def sidecar_pages(sidecar: DataFrame, pages: DataFrame) -> DataFrame:
    """The sidecar's pages with the parsed page's title, or a stub of their own where no page was parsed; blank ones are issues."""
    parsed = pages.select(*AT, F.col("page_title").alias("__title"), F.lit(False).alias("__stub"))
    rows = sidecar.join(parsed, AT, "left")
    blank = T.clean_text(F.col("rag_text")) == ""
    return rows.select(
        *AT, "rag_text", F.when(F.col("__stub").isNull(), F.col("page_title")).otherwise(F.col("__title")).alias("page_title"), F.coalesce("__stub", F.lit(True)).alias("stub"),
        F.when(blank, F.concat(F.lit("empty_llm_ready_page:"), F.col("page_num").cast("string"))).alias("issue"),
    )


# --- groups --------------------------------------------------------------------------------------------------------


def summary_priority(blocks: DataFrame, *by: str) -> DataFrame:
    """The highest summary priority of each group, as the first block that has it spells it; null without any."""
    value = F.col("summary_priority")
    rank = F.when(F.lower(value) == "high", 3).when(F.lower(value) == "medium", 2).when(F.lower(value) == "low", 1)
    rows = chunking.completed(blocks).withColumn("rank", rank)
    return rows.groupBy(*by).agg(F.min_by(F.when(F.col("rank").isNotNull(), value), F.struct(-F.coalesce("rank", F.lit(0)), chunking.order())).alias("summary_priority"))


def associated_title(blocks: DataFrame, *by: str) -> DataFrame:
    """The first title that a group's blocks name, in order: an associated one, the page's, or a title block's own text."""
    rows = chunking.completed(blocks)
    named = T.truthy(T.clean_text(F.col("associated_title")), T.clean_text(F.col("meta_page_title")), F.when(F.col("type") == "title", T.clean_text(F.col("text"))))
    return rows.groupBy(*by).agg(F.min_by(named, F.struct(named.isNull(), chunking.order())).alias("associated_title"))


# --- visual records ------------------------------------------------------------------------------------------------


def richness(c: Column) -> Column:
    """``struct(chars, lines, metrics, periods, labels)`` of a text."""
    return T.let(T.clean_text(c), lambda x: F.struct(F.length(x).alias("chars"), F.size(T.lines(x)).alias("lines"), F.size(T.metric_tokens(x)).alias("metrics"), F.size(T.period_tokens(x)).alias("periods"), F.size(T.label_candidates(x)).alias("labels")))


def row_signal(rows: Column) -> Column:
    """How much the first eight rows say: 2 for three filled cells or more, 1 for two."""
    filled = F.transform(F.slice(rows, 1, 8), lambda r: T.count_if(r, lambda c: T.clean_text(c) != ""))
    return F.aggregate(filled, F.lit(0), lambda a, n: a + F.when(n >= 3, 2).when(n == 2, 1).otherwise(0))


def preview_rows(rows: Column, limit: int = 12) -> Column:
    """The first rows."""
    return F.slice(rows, 1, limit)


def pair_text(label: Column, value: Column) -> Column:
    """``label=value``; the label alone without a value, ``value`` for a missing label."""
    name = F.coalesce(T.truthy(T.clean_text(label)), F.lit("value"))
    return F.when(T.clean_text(value) != "", F.concat(name, F.lit("="), T.clean_text(value))).otherwise(name)


def visual_title(associated: Column, own: Column, page: Column, text: Column, page_num: Column) -> Column:
    """The first title there is, else the page's first line, 200 characters at most; else the page's number."""
    named = T.truthy(*(T.clean_text(c) for c in (associated, own, page)), F.get(F.split(T.clean_text(text), "\n"), F.lit(0)))
    return F.coalesce(F.substring(named, 1, 200), F.concat(F.lit("page "), page_num.cast("string"), F.lit(" visual")))


def confidence(*scores: Column, default: float) -> Column:
    """The first score that is a number; one beyond 1 counts tenths, up to 0.98."""
    score = F.coalesce(*(s.try_cast("double") for s in scores))
    return F.coalesce(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(score > 1.0, F.least(F.lit(0.98), score / 10.0)).otherwise(score))), 4), F.lit(default))


def json_text(value: Column) -> Column:
    """Compact JSON."""
    return F.to_json(value)


def visual_fields(kind: Column, title: Column, row_label: Column, column_label: Column, value: Column, row: Column, column: Column) -> Column:
    """The structured fields of a cell's chunk: texts cleaned, empty ones null, places as whole numbers where they are."""
    texts = {"table_kind": kind, "table_title": title, "row_label": row_label, "column_label": column_label, "cell_value": value}
    return F.struct(*(T.truthy(T.clean_text(c)).alias(n) for n, c in texts.items()), row.try_cast("int").alias("row_index_in_table"), column.try_cast("int").alias("column_index_in_table"))


# --- payloads ------------------------------------------------------------------------------------------------------


def all_chunks(blocks: DataFrame, pages: DataFrame, sidecar: DataFrame | None = None) -> DataFrame:
    """The chunks of both strategies in one table: text groups with support, and each page and block by itself."""
    ready = pages if sidecar is None else with_sidecar_text(pages, sidecar)
    columns = [f.strip().split(" ")[0] for f in CHUNKS.split(",")]
    return chunking.text_first_chunks(blocks, ready).select(columns).unionByName(chunking.native_chunks(ready, blocks).select(columns))


def payloads(chunks: DataFrame, documents: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """A header per document and strategy: schema_version, names, total_chunks and issues; documents without chunks have headers too.

    ``documents``: doc_id, filename, document_type; ``issues``: doc_id, strategy_name, issue.
    """
    strategies = F.explode(F.array(F.lit(S.MAIN_STRATEGY), F.lit(S.BASELINE_STRATEGY))).alias("strategy_name")
    key = ["doc_id", "strategy_name"]
    heads = documents.select("doc_id", "filename", "document_type", strategies)
    counted = chunks.groupBy(*key).agg(F.count("*").alias("total_chunks"))
    out = heads.join(counted, key, "left").withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0))).withColumn("schema_version", F.lit(1))
    if issues is None:
        return out.withColumn("issues", F.array().cast("array<string>"))
    found = issues.filter("issue is not null").groupBy(*key).agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    return out.join(found, key, "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))


def write_chunks(chunks: DataFrame, root: str) -> None:
    """Chunks as JSON lines, a folder a strategy; a run replaces the one before it."""
    chunks.write.mode("overwrite").partitionBy("strategy_name").json(root)


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of both strategies' folders; an error if there are none, or if a line is no chunk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    have = [s for s in (S.MAIN_STRATEGY, S.BASELINE_STRATEGY) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/strategy_name={s}"))]
    if not have:
        raise FileNotFoundError(f"no chunks below {root}")
    schema = f"{CHUNKS}, __bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "__bad").option("basePath", root).json([f"{root}/strategy_name={s}" for s in have])
    checked = F.when(F.col("__bad").isNotNull() | F.col("chunk_id").isNull(), F.raise_error(F.lit("a line is no chunk"))).otherwise(F.col("chunk_id"))
    return rows.withColumn("chunk_id", checked.cast("string")).drop("__bad")


def selected_documents(documents: DataFrame, doc_id: str | None = None, path: str | None = None) -> DataFrame:
    """The document of an id; or that of a path by its hash, else those of the path's file name; or all."""
    if doc_id:
        return documents.filter(F.col("doc_id") == doc_id)
    if not path:
        return documents
    own = documents.filter(F.col("doc_id") == K.document_id(F.lit(path)))
    name = path.replace("\\", "/").rpartition("/")[2]
    base = F.regexp_extract(F.coalesce("filepath", F.lit("")), r"([^/\\]*)$", 1)
    return own if not own.isEmpty() else documents.filter((base == name) | (F.col("filename") == name))
