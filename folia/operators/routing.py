"""Document routing and grading from page features: two levels of aggregation, no driver work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions import geometry as G
from folia.functions import text as T
from folia.functions.tables import ratio

DOC_TYPES = ("slide_ir", "text_report", "dashboard_brief", "table_heavy")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def signatures(pages: DataFrame) -> DataFrame:
    """doc_id, page_num, place, signature of each page's first and last two lines, eight characters or more."""
    all_lines = T.lines(F.coalesce("text", F.lit("")))
    top, bottom = T.signature(F.array_join(F.slice(all_lines, 1, 2), " ")), T.signature(F.array_join(F.slice(all_lines, F.greatest(F.lit(1), F.size(all_lines) - 1), F.lit(2)), " "))
    both = F.array(F.struct(F.lit("top").alias("place"), top.alias("signature")), F.struct(F.lit("bottom").alias("place"), bottom.alias("signature")))
    return pages.select("doc_id", "page_num", F.explode(both).alias("s")).select("doc_id", "page_num", "s.place", "s.signature").filter(F.length("signature") >= 8)


def repeated_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page_num of pages whose header or footer another page of the document shares."""
    found = signatures(pages)
    often = found.groupBy("doc_id", "place", "signature").agg(F.count("*").alias("n")).filter("n >= 2").drop("n")
    return found.join(often, ["doc_id", "place", "signature"], "left_semi").select("doc_id", "page_num").distinct()


def repeated_texts(blocks: DataFrame, least: int = 3) -> DataFrame:
    """Blocks whose normalised text stands on ``least`` or more pages of the document."""
    key = T.normalized_key(F.col("text"))
    rows = blocks.withColumn("__key", key).filter("__key <> ''")
    often = rows.groupBy("doc_id", "__key").agg(F.countDistinct("page_num").alias("pages")).filter(F.col("pages") >= least)
    return rows.join(often, ["doc_id", "__key"]).drop("__key")


def page_features(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per page with the features that its type is scored by."""
    text, kind = F.trim(F.coalesce("text", F.lit(""))), F.col("type")
    texts = kind.isin("text", "title", "footer")
    own = blocks.groupBy("doc_id", "page_num").agg(
        F.count("*").alias("block_count"), F.count_if(kind.isin("image", "chart", "drawing")).alias("images"), F.count_if(kind == "table").alias("tables"), F.count_if(texts).alias("texts"),
        F.coalesce(F.sum(F.when(kind == "title", F.length(text))), F.lit(0)).alias("title_chars"), F.count_if(texts & (F.length(text) < 15)).alias("tiny"), F.count_if(texts & (F.size(F.split(text, "\n")) >= 3)).alias("long"),
        F.collect_list(F.when(kind.isin("text", "title") & (G.width(F.col("bbox")) <= 0.72 * F.col("page_width")), G.x0(F.col("bbox")))).alias("edges"),
    )
    rows = pages.join(own, ["doc_id", "page_num"], "left").fillna(0, ["block_count", "images", "tables", "texts", "title_chars", "tiny", "long"])
    rows = rows.join(repeated_pages(pages).withColumn("repeated", F.lit(1.0)), ["doc_id", "page_num"], "left").fillna(0.0, ["repeated"])
    compact = T.squeezed(F.coalesce("text", F.lit("")))
    landscape = F.coalesce((F.col("page_width") > F.col("page_height") * 1.05) & (F.col("page_height") > 0), F.lit(False))
    return rows.select(
        "doc_id", "page_num", F.length(compact).cast("double").alias("text_density"), ratio(F.regexp_count(compact, F.lit(r"\d")) + F.regexp_count(compact, F.lit("%")), F.greatest(F.lit(1), F.length(compact))).alias("numeric_density"),
        F.col("tables").cast("double").alias("table_count"), F.col("images").cast("double").alias("image_count"), columns(F.col("edges"), F.col("page_width")).cast("double").alias("column_count"),
        ratio(F.col("title_chars"), F.greatest(F.lit(1), F.length(compact))).alias("title_ratio"), "repeated", F.col("block_count").cast("double").alias("block_count"), landscape.cast("double").alias("landscape"),
        ratio(F.col("images") + F.col("tiny"), F.greatest(F.lit(1), F.col("block_count"))).alias("fragment_ratio"), ratio(F.col("long"), F.greatest(F.lit(1), F.col("texts"))).alias("continuity"),
    )


def columns(edges: Column, page_width: Column) -> Column:
    """Columns from 1 to 3: left edges, in order, merged while within 18 % of the width (40 points at least) of the running centre."""
    gap = F.greatest(page_width * 0.18, F.lit(40.0))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("at"))

    def add(acc: Column, x: Column) -> Column:
        new = acc["at"].isNull() | (F.abs(x - acc["at"]) > gap)
        return F.struct((acc["n"] + new.cast("int")).alias("n"), F.when(new, x).otherwise((acc["at"] + x) / 2).alias("at"))

    return F.greatest(F.lit(1), F.least(F.lit(3), F.aggregate(F.array_sort(F.coalesce(edges, F.array().cast("array<double>"))), start, add, lambda a: a["n"])))


def page_scores(features: DataFrame) -> DataFrame:
    """``features`` with the four type scores and the page's type."""
    c = F.col
    text, numeric, table, image = clamp(c("text_density") / 1800.0), clamp(c("numeric_density") / 0.18), clamp(c("table_count") / 3.0), clamp(c("image_count") / 3.0)
    column, title, block = clamp((c("column_count") - 1.0) / 2.0), clamp(c("title_ratio") / 0.18), clamp(c("block_count") / 18.0)
    fit = 1.0 - clamp(F.abs(c("column_count") - 1.5) / 1.5)
    slide = (c("landscape") >= 1.0).cast("double")
    export = ((c("landscape") >= 1.0) & (c("fragment_ratio") >= 0.75) & (c("continuity") <= 0.15)).cast("double")
    scores = {
        "slide_ir": 0.18 * image + 0.15 * title + 0.10 * (1.0 - text) + 0.10 * (1.0 - column) + 0.10 * slide + 0.10 * c("fragment_ratio") + 0.12 * c("landscape") + 0.12 * export + 0.08 * (1.0 - c("repeated")) - 0.15 * text,
        "text_report": 0.35 * text + 0.20 * c("continuity") + 0.12 * (1.0 - table) + 0.12 * c("repeated") + 0.10 * fit + 0.08 * (1.0 - image) + 0.08 * (1.0 - numeric),
        "dashboard_brief": 0.24 * numeric + 0.22 * image + 0.18 * block + 0.14 * column + 0.10 * (1.0 - c("repeated")) - 0.16 * export,
        "table_heavy": 0.36 * table + 0.22 * numeric + 0.14 * c("repeated") + 0.08 * (1.0 - image) + 0.08 * (1.0 - title),
    }
    rows = features.withColumns({k: F.round(v, 9) for k, v in scores.items()})
    order = F.array_sort(F.array(*(F.struct((-c(k)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(DOC_TYPES))))
    mixture = sum(((v >= 0.45).cast("int") for v in (text, numeric, table, image)), F.lit(0))
    first, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    return rows.withColumn("page_type", F.when((second["s"] - first["s"] < 0.08) & (mixture >= 2), "mixed_document").otherwise(first["k"]))


def routed(scored_pages: DataFrame, allow_mixed: bool = True) -> DataFrame:
    """One row per document: its type, confidence, scores and reasons."""
    c = F.col
    docs = scored_pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), *(F.avg(k).alias(f"mean_{k}") for k in DOC_TYPES), *(F.avg((c("page_type") == k).cast("double")).alias(f"share_{k}") for k in (*DOC_TYPES, "mixed_document")),
        *(F.avg(k).alias(k) for k in ("text_density", "numeric_density", "table_count", "image_count", "column_count", "title_ratio", "repeated", "block_count", "landscape")),
    )
    score = {k: F.round(c(f"mean_{k}") + 0.15 * c(f"share_{k}"), 9) for k in DOC_TYPES}
    order = F.array_sort(F.array(*(F.struct((-v).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k"), c(f"share_{k}").alias("share")) for i, (k, v) in enumerate(score.items()))))
    best, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    wide = sum(((c(f"share_{k}") >= 0.2).cast("int") for k in DOC_TYPES), F.lit(0))
    gap = second["s"] - best["s"]
    mixed = ((c("share_mixed_document") >= 0.25) | ((gap < 0.08) & (wide >= 2)) | ((best["share"] < 0.5) & (wide >= 3))) & F.lit(allow_mixed)
    confidence = F.when(mixed, clamp(0.52 + c("share_mixed_document") * 0.25 + wide * 0.05)).otherwise(clamp(0.40 - best["s"] * 0.35 + best["share"] * 0.20 + gap * 1.20))
    kind = F.when(mixed, "mixed_document").otherwise(best["k"])
    reasons = F.array_compact(F.array(
        F.when(kind == "slide_ir", "visual pages with little narrative").when(kind == "text_report", "dense text with few tables and visuals").when(kind == "dashboard_brief", "numbers, visuals and many blocks together")
        .when(kind == "table_heavy", "tables and numbers outweigh narrative").otherwise("no layout dominates"),
        F.when((kind == "slide_ir") & (c("landscape") >= 0.4), "landscape pages"), F.when((kind == "text_report") & (c("repeated") >= 0.35), "repeated headers or footers"), F.when((kind == "dashboard_brief") & (c("column_count") >= 1.8), "several columns"), F.when((kind == "table_heavy") & (c("table_count") >= 1.2), "tables on most pages"),
    ))
    return docs.select("doc_id", "pages", kind.alias("document_type"), F.round(confidence, 3).alias("confidence"), *(F.round(v, 6).alias(f"score_{k}") for k, v in score.items()), F.array_join(reasons, "; ").alias("reasons"))


def quality_grade(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per document: score 0-100 and grade A, B, C or F, from fragmentation, density and structure."""
    kind = F.col("type")
    b = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(kind == "title").alias("titles"), F.count_if(kind == "table").alias("tables"), F.count_if(kind == "text").alias("texts"), F.count_if((kind == "text") & ~F.trim("text").contains("\n")).alias("single"))
    p = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.max((F.coalesce("rag_text", F.lit("")) != "").cast("int")).alias("has_rag"))
    rows = p.join(b, "doc_id", "left").fillna(0, ["blocks", "titles", "tables", "texts", "single"])
    singles, dense = ratio(F.col("single"), F.greatest(F.lit(1), F.col("texts"))), F.col("blocks") / F.col("pages")
    score = 80 + F.when(singles > 0.7, -30).when(singles > 0.5, -15).when(singles < 0.2, 10).otherwise(0) + F.when(dense > 100, -20).when(dense > 50, -10).when(dense < 20, 5).otherwise(0) + T.points((F.col("titles") > 0, 5), (F.col("tables") > 0, 5), (F.col("has_rag") == 1, 5))
    score = F.when(F.col("chars") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score))).cast("int")
    grade = F.when(F.col("chars") == 0, "F").when(score >= 90, "A").when(score >= 70, "B").when(score >= 50, "C").otherwise("F")
    return rows.select("doc_id", score.alias("score"), grade.alias("grade"), F.round(singles, 2).alias("singleton_ratio"), F.round(dense, 1).alias("blocks_per_page"), "titles", "tables")


def parse_metadata(pages: DataFrame) -> DataFrame:
    """Characters, pages and text sources of each document, with a label of its text quality."""
    chars = F.sum(F.length(F.coalesce("text", F.lit(""))))
    rows = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), chars.alias("total_chars"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty_pages"))
    per_page = F.col("total_chars") / F.col("page_count")
    return rows.withColumn("text_quality", F.when(per_page < 50, "low").when(per_page < 300, "medium").otherwise("high"))


def with_page_window(pages: DataFrame) -> DataFrame:
    """Each page's share of its document's characters, running."""
    order = W.partitionBy("doc_id").orderBy("page_num")
    n = F.length(F.coalesce("text", F.lit("")))
    return pages.withColumn("running_chars", F.sum(n).over(order))
