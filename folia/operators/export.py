"""Documents as a language model is given them: block entries in sections, page titles and texts, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions import pagetext as P
from folia.functions import text as T

from . import chunking

AT = ["doc_id", "page_num"]
SECTIONS = ("title", "body", "table", "visual", "note")


def roles() -> Column:
    return F.lower(F.concat_ws(" ", *(T.truthy(F.col(c)) for c in ("summary_role", "slide_role", "dashboard_role"))))


def decorative() -> Column:
    """Blocks whose role or reason for exclusion is decoration, a disclaimer, a footer, a page number or noise."""
    return T.contains_any(F.lower(F.coalesce("exclude_reason", F.lit(""))), P.DECORATIVE) | T.contains_any(roles(), P.DECORATIVE)


def structured() -> Column:
    """Whether a block has a summary, key values, a table or a caption."""
    return T.truthy(*(F.col(c) for c in ("table_summary", "table_markdown", "chart_summary", "visual_summary", "caption_text"))).isNotNull() | (F.coalesce(F.size("key_value_rows"), F.lit(0)) > 0)


def key_values(limit: int = 8) -> Column:
    """Key values as lines."""
    pairs = F.transform(F.slice("key_value_rows", 1, limit), lambda r: F.struct(P.tidy(r["item"], 160).alias("k"), P.tidy(r["values"], 260).alias("v")))
    return F.coalesce(F.array_join(F.transform(F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "")), lambda p: F.concat(p["k"], F.lit(": "), p["v"])), "\n"), F.lit(""))


def entries(blocks: DataFrame) -> DataFrame:
    """A row per block that a model is given: doc_id, page_num, source_order, type, llm_section, text, the summaries, and the meta fields that stay.

    Texts are tidied to a length by type: titles and bodies compacted, tables led by
    their summary, visuals by theirs. Excluded blocks of low priority, footers of no
    use and visuals without anything to say are left out.
    """
    rows = chunking.completed(blocks)
    kind, low, out = F.coalesce("type", F.lit("unknown")), F.lower(F.coalesce("summary_priority", F.lit(""))) == "low", F.coalesce("summary_exclude", F.lit(False))
    raw = P.tidy(F.col("text"))
    tabular = (kind == "table") | T.truthy(F.col("table_summary"), F.col("table_markdown")).isNotNull() | (F.coalesce(F.size("key_value_rows"), F.lit(0)) > 0)
    visual = kind.isin("image", "chart") | T.truthy(F.col("chart_summary"), F.col("visual_summary")).isNotNull()
    summary, caption = P.tidy(F.col("table_summary"), 1200), P.tidy(F.col("caption_text"), 400)
    seen = P.tidy(F.coalesce(T.truthy(F.col("chart_summary"), F.col("visual_summary")), F.lit("")), 1200)
    text = (
        F.when(kind == "title", F.when(out, "").otherwise(P.compact(raw))).when(tabular, F.coalesce(T.truthy(summary, key_values(), P.tidy(raw, 420)), F.lit(""))).when(visual, P.tidy(raw, 300))
        .when(kind == "text", F.when(out | low, "").otherwise(F.when(F.coalesce(F.col("slide_role") == "offpage_text_stream", F.lit(False)), P.compact(raw, 280)).otherwise(P.compact(raw, 650))))
        .when(kind == "footer", P.tidy(raw, 240)).otherwise(P.tidy(raw, 420))
    )
    is_visual = visual & ~tabular & (kind != "title")
    is_table = tabular & (kind != "title")
    blank = F.coalesce(T.truthy(raw), F.lit("")) == ""
    left = ((kind == "footer") & (out | low | decorative())) | (out & low & kind.isin("title", "text", "unknown") & ~structured()) | (is_visual & blank & (seen == "") & (caption == "")) | (~kind.isin("title", "text", "footer", "table", "image", "chart") & ~is_table & ~is_visual & blank & ~structured())
    said = lambda condition, c: F.when(condition, T.truthy(c))
    made = rows.filter(~left).select(
        *AT, F.col("seq").alias("source_order"), kind.alias("type"), text.alias("text"), said(is_table, summary).alias("table_summary"), said(is_table, P.tidy(F.col("table_markdown"), 4000)).alias("table_markdown"), said(is_table, key_values(20)).alias("key_values"),
        said(is_visual & (kind == "chart"), seen).alias("chart_summary"), said(is_visual & (kind != "chart"), seen).alias("visual_summary"), T.truthy(caption).alias("caption_text"), "summary_role", "slide_role", "dashboard_role", "panel_id", "panel_order", "associated_title", "summary_priority",
        F.col("exclude_reason").alias("summary_exclude_reason"), "dashboard_region_id", "region_id",
    )
    c = F.col
    section = (
        F.when(c("type") == "title", "title").when(F.coalesce("table_summary", "table_markdown", "key_values").isNotNull(), "table").when(F.coalesce("chart_summary", "visual_summary").isNotNull() | c("type").isin("chart", "image"), "visual")
        .when((c("type") == "footer") | (F.lower(F.coalesce("summary_priority", F.lit(""))) == "low") | T.truthy(c("summary_exclude_reason")).isNotNull(), "note").when(c("type") == "text", "body").otherwise("note")
    )
    sided = made.withColumn("llm_section", section)
    # beside a table, text streams and key figures are notes
    has_table = F.max((c("llm_section") == "table").cast("int")).over(W.partitionBy(*AT)) == 1
    aside = (c("llm_section") == "body") & has_table & F.coalesce(c("slide_role").isin("offpage_text_stream", "kpi_group"), F.lit(False))
    return sided.withColumn("llm_section", F.when(aside, "note").otherwise(c("llm_section")))


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` of ``entries`` with ``place``: by section, priority, panel and source."""
    bucket = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("llm_section"))
    p = F.lower(F.coalesce("summary_priority", F.lit("")))
    rank = F.when(p == "high", 0).when(p == "medium", 1).when(p == "low", 4).otherwise(2)
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*AT).orderBy(bucket, rank, F.coalesce("panel_order", F.lit(999)), "source_order")))


def page_titles(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_num, page_title: the page's own, else the best of what its blocks offer by type, role, priority and length; the earliest of equal ones."""
    rows = chunking.completed(blocks)
    kind, low = F.col("type"), F.lower(F.coalesce("summary_priority", F.lit("")))
    own, associated = T.truthy(F.col("meta_page_title")), T.truthy(F.col("associated_title"))
    score = T.points(
        (kind == "title", 100), (own.isNotNull(), 40), (associated.isNotNull(), 24), (roles().contains("title") | roles().contains("header"), 28), (low == "high", 18), (low == "medium", 10), (kind == "text", 8),
        (kind.isin("table", "chart", "image") & associated.isNotNull(), 6),
    )
    usable = ~((kind == "footer") | (low == "low") | F.coalesce("summary_exclude", F.lit(False)) | decorative())
    offered = F.array_compact(F.array(F.when(kind.isin("title", "text"), F.col("text")), own, associated))
    made = rows.filter(usable).select(*AT, "seq", score.alias("points"), F.explode(F.transform(offered, lambda c: P.compact(c))).alias("t")).filter(F.regexp_count("t", F.lit(r"\p{L}")) >= 2)
    value = F.col("points") - F.floor(F.greatest(F.lit(0), F.length("t") - 120) / 8)
    best = made.groupBy(*AT).agg(F.min_by("t", F.struct((-value).alias("v"), "seq", F.length("t").alias("n"), "t")).alias("t"))
    return pages.select(*AT, P.compact(F.col("page_title")).alias("given")).join(best, AT, "left").select(*AT, F.coalesce(T.truthy(F.col("given")), F.col("t"), F.lit("")).alias("page_title"))


def entry_text() -> Column:
    """``struct(label, text)`` of an entry in a page's text."""
    table = F.array_join(F.array_compact(F.array(
        F.when(T.truthy(F.col("associated_title"), F.col("caption_text")).isNotNull(), F.concat(F.lit("Title: "), P.tidy(T.truthy(F.col("associated_title"), F.col("caption_text")), 180))),
        F.concat(F.lit("Summary: "), F.col("table_summary")), _unless_in(F.concat(F.lit("Key values: "), F.col("key_values")), F.col("key_values"), F.col("table_summary")), _unless_in(F.concat(F.lit("Markdown: "), P.tidy(F.col("table_markdown"), 1800)), F.col("table_markdown"), F.col("table_summary"), F.col("key_values")),
    )), "\n")
    summary = F.coalesce("chart_summary", "visual_summary")
    visual = F.coalesce(F.concat(summary, F.coalesce(_unless_in(F.concat(F.lit("\nCaption: "), P.tidy(F.col("caption_text"), 260)), F.col("caption_text"), summary), F.lit(""))), F.col("caption_text"), P.tidy(F.col("text"), 360))
    s, pair = F.col("llm_section"), lambda label, c: F.struct(label.alias("label"), F.coalesce(c, F.lit("")).alias("text"))
    return (
        F.when(s == "title", pair(F.lit("TITLE"), P.compact(F.col("text")))).when(s == "table", pair(F.lit("TABLE"), F.when(table != "", table).otherwise(P.tidy(F.col("text"), 500))))
        .when(s == "visual", pair(F.when(F.col("type") == "chart", "CHART").otherwise("VISUAL"), visual)).when(s == "note", pair(F.lit("NOTE"), P.tidy(F.col("text"), 320))).otherwise(pair(F.lit("BODY"), P.compact(F.col("text"), 900)))
    )


def _unless_in(shown: Column, c: Column, *others: Column) -> Column:
    """``shown``, unless ``c`` says the same as one of the others."""
    same = F.lit(False)
    for other in others:
        same = same | F.coalesce(repeats(T.normalized_key(c), T.normalized_key(other)), F.lit(False))
    return F.when(~same, shown)


def repeats(a: Column, b: Column) -> Column:
    """Whether two keys are equal, or one of 18 characters or more is within the other."""
    return (a == b) | ((F.length(a) >= 18) & (F.length(b) >= 18) & (a.contains(b) | b.contains(a)))


def page_texts(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, page_num, page_title, rag_text, entries: the title and the entries under their labels, in sections; a text that repeats one before it is left out.

    A page's entries are folded in order inside the JVM; a page is the natural bound.
    """
    said = entry_text()
    lists = ordered(rows).groupBy(*AT).agg(F.array_sort(F.collect_list(F.struct("place", said["label"].alias("label"), P.tidy(said["text"], 2200).alias("text")))).alias("said"), F.count("*").alias("entries"))
    whole = titles.join(lists, AT, "left")
    none = F.array().cast("array<struct<place:int,label:string,text:string>>")
    first = F.when(F.col("page_title") != "", F.array(F.struct(F.lit(0).alias("place"), F.lit("TITLE").alias("label"), F.col("page_title").alias("text")))).otherwise(none)
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, x: Column) -> Column:
        def put(key: Column) -> Column:
            new = (key != "") & ~F.exists(acc["keys"], lambda k: repeats(key, k))
            longer = F.struct(F.concat(acc["keys"], F.array(key)).alias("keys"), F.concat(acc["parts"], F.array(F.concat(F.lit("["), x["label"], F.lit("] "), x["text"]))).alias("parts"))
            return F.when(new, longer).otherwise(acc)

        return T.let(T.normalized_key(x["text"]), put)

    parts = F.aggregate(F.concat(first, F.coalesce("said", none)), start, add, lambda a: a["parts"])
    return whole.select(*AT, "page_title", F.array_join(parts, "\n\n").alias("rag_text"), F.coalesce("entries", F.lit(0)).alias("entries"))


def documents(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """A row per document: its header (doc_id and more), page_count, and its pages (page_num, page_title, rag_text, rag_text_source) in order.

    ``pages``: ``page_texts`` with ``source_text``, which stands in where nothing structured was said.
    """
    text = F.coalesce(T.truthy(F.col("rag_text"), F.col("source_text")), F.lit(""))
    source = F.when(F.coalesce("rag_text", F.lit("")) != "", "structured_export").otherwise("parser_rag_text")
    page = F.struct("page_num", "page_title", text.alias("rag_text"), source.alias("rag_text_source"))
    lists = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.array_sort(F.collect_list(page)).alias("pages"))
    return headers.join(lists, "doc_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))


def report(rows: DataFrame, limit: int = 2600) -> DataFrame:
    """doc_id, markdown: ``documents`` as a Markdown report, page texts cut at ``limit`` characters."""
    shown = lambda p: F.concat(
        F.lit("## Page "), p["page_num"].cast("string"), F.lit("\n\n"), F.when(p["page_title"] != "", F.concat(F.lit("**Page Title:** "), p["page_title"], F.lit("\n\n"))).otherwise(""), F.lit("```\n"), F.substring(p["rag_text"], 1, limit),
        F.when(F.length(p["rag_text"]) > limit, F.concat(F.lit("\n... ("), F.length(p["rag_text"]).cast("string"), F.lit(" chars total)"))).otherwise(""), F.lit("\n```\n"),
    )
    head = F.concat(F.lit("# "), F.coalesce("filename", F.lit("Unknown")), F.lit("\n\n- **Pages:** "), F.col("page_count").cast("string"), F.lit("\n\n---\n\n"))
    return rows.select("doc_id", F.concat(head, F.coalesce(F.array_join(F.transform("pages", shown), "\n"), F.lit(""))).alias("markdown"))
