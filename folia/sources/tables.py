"""Pages, blocks and documents from the test tables and other text collections."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import text as T

LINES_PER_PAGE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its files have fewer splits than there are cores; a larger table stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` worked out and written below ``spark.checkpoint.dir``, to be read as often as a plan needs it."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="folia-shared-")
    path = f"{folder.rstrip('/')}/folia/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_blocks(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Blocks of plain texts: one per non-empty line, ``lines_per_page`` to a page, laid out on an A4 page of points.

    A short line without prose is a title, a line with bars a table, the rest text.
    """
    lines = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text")).filter(T.strip(F.col("text")) != "")
    row = F.col("line") % lines_per_page
    x = F.when(F.col("line") % 3 == 2, 320.0).otherwise(50.0)
    kind = F.when(F.col("text").contains("|"), "table").when(F.length("text") < 24, "title").otherwise("text")
    return lines.select(
        "doc_id", (F.floor(F.col("line") / lines_per_page) + 1).cast("int").alias("page_num"), F.col("line").alias("seq"), kind.alias("type"), "text",
        F.array(x, 40.0 + row * 36.0, x + F.least(F.lit(250.0), F.length("text") * 2.0), 62.0 + row * 36.0).alias("bbox"),
        F.lit("native").alias("source"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"),
    )


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of HTML pages: headings, paragraphs, list items, table rows and footers by their tags, entities resolved, in page order."""
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<(h[1-6]|p|li|tr|footer|title)\b[^>]*>.*?</\1\s*>"), 0)
    rows = pages.select(F.col("page_id").cast("string").alias("doc_id"), F.posexplode(found).alias("seq", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([A-Za-z0-9]+)", 1))
    kind = F.when(tag.rlike("^(h[1-6]|title)$"), "title").when(tag == "footer", "footer").when(tag == "tr", "table").otherwise("text")
    return rows.select("doc_id", F.lit(1).alias("page_num"), "seq", kind.alias("type"), html_text(F.col("raw")).alias("text"), tag.alias("source")).filter("text <> ''")


def html_text(c: Column) -> Column:
    """Text of an HTML fragment: tags out, the common entities resolved, on one line."""
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return T.normalize_text(c)


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of Markdown: paragraphs between empty lines, ``#`` lines as titles, at rising heights."""
    parts = F.split(T.clean_text(F.col(text_col)), r"\n\n")
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(parts).alias("seq", "raw")).filter(T.strip(F.col("raw")) != "")
    title = F.col("raw").rlike(r"^#{1,6}\s")
    return rows.select(
        "doc_id", F.lit(1).alias("page_num"), "seq", F.when(title, "title").otherwise("text").alias("type"), T.strip(F.regexp_replace("raw", r"^#{1,6}\s+", "")).alias("text"),
        F.array(F.lit(50.0), 40.0 + F.col("seq") * 30.0, F.lit(545.0), 62.0 + F.col("seq") * 30.0).alias("bbox"), F.lit("markdown").alias("source"),
    )


def file_kind(path: Column) -> Column:
    """The format by extension; null for one that isn't read."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("pdf", "doc", "docx", "hwp", "xlsx", "xls", "html", "htm", "md", "txt"), ext)
