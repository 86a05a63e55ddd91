"""Slides, scanned boxes and visuals: roles and predicates of blocks, page profiles, box cleaning, hosts of visuals, tables judged for a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions import geometry as G
from folia.functions import pagetext as P
from folia.functions import tables as TB
from folia.functions import text as T

from . import layout, routing

AT = ["doc_id", "page_num"]

# --- fixed values: thresholds of tables that a scan finds ---------------------------------------------------------
SCAN_ROWS, SCAN_COLS, SCAN_FILLED, SCAN_AREA, SCAN_ACCURACY = 2, 2, 0.35, 0.70, 60.0
KEY_FIGURE = r"(?i)[\d,]+(?:\.\d+)?\s*(%|원|억원|조원|USD|배|x|pt|bps)"
# ------------------------------------------------------------------------------------------------------------------


def dense_length(c: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(T.squeezed(F.coalesce(c, F.lit(""))))


def slide_role(text: Column, b: Column, page_width: Column, page_height: Column, font_size: Column) -> Column:
    """What a slide's text is by its place, size and content."""
    t = T.strip(F.coalesce(text, F.lit("")))
    n, dense, high = F.length(t), dense_length(t), G.y0(b) < page_height * 0.16
    prose = t.rlike("[.!?。]") & (dense > 120)
    return (
        F.when(high & (prose | ((dense > 180) & (T.digit_ratio(t) >= 0.12))), "body_note").when(high & ((font_size >= 14) | ((n <= 80) & (G.width(b) > page_width * 0.18))), "title").when((G.y1(b) > page_height * 0.92) & (n <= 40), "footer")
        .when(t.rlike(KEY_FIGURE) & (n <= 48), "kpi_metric").when(F.substring(t, 1, 1).isin(*"▪•-□◦*+"), "bullet_item").when((n <= 8) & ~t.rlike("[A-Za-z가-힣]{2,}"), "decorative_noise")
        .when((G.width(b) < page_width * 0.12) & (n < 16) & (G.y0(b) < page_height * 0.25), "section_chip").otherwise("body_note")
    )


def slide_kind(kind: Column, role: Column, b: Column, page_height: Column) -> Column:
    """``struct(type, summary_role, summary_priority, summary_exclude)`` of a slide's block by its role; the lowest strip is the footer."""
    foot = (role == "footer") | (kind.isin("text", "title") & (G.y1(b) > page_height * 0.94))
    return F.struct(
        F.when(foot, "footer").when(role == "title", "title").otherwise(kind).alias("type"), F.when(role == "title", "title").when(role == "offpage_text_stream", "body_text").alias("summary_role"),
        F.when(foot, "low").when(role.isin("title", "kpi_metric", "kpi_group"), "high").when(role == "offpage_text_stream", "medium").alias("summary_priority"), F.coalesce(foot, F.lit(False)).alias("summary_exclude"),
    )


def report_role(text: Column, b: Column, page_height: Column, largest: Column, smallest: Column) -> Column:
    """``struct(role, type)`` of a report's block by its place, fonts and lines."""
    t = T.strip(F.coalesce(text, F.lit("")))
    n, n_lines = F.length(t), F.size(T.lines(t))
    named = lambda role, kind: F.struct(F.lit(role).alias("role"), F.lit(kind).alias("type"))
    return (
        F.when((G.y0(b) < page_height * 0.12) & (largest >= 13.5) & (n <= 120), named("section_title", "title")).when((G.y1(b) > page_height * 0.92) & (n <= 60), named("footer_note", "footer"))
        .when(t.rlike(r"(?i)^\s*(표|table|figure|그림)\s*[\dA-Za-z\-.]+"), named("caption", "text")).when((n_lines >= 2) & (n >= 120), named("paragraph", "text")).when((largest - smallest >= 2.5) & (n <= 90), named("section_title", "title")).otherwise(named("body_text", "text"))
    )


def plain_role(b: Column, page_height: Column, largest: Column) -> Column:
    """title, footer or text by place and font."""
    return F.when((largest >= 14) & (G.y0(b) < page_height * 0.15), "title").when((G.y1(b) > page_height * 0.92) & (G.height(b) < 20), "footer").otherwise("text")


def off_page(b: Column, page_height: Column) -> Column:
    return (G.y1(b) < page_height * 0.025) | (G.y0(b) < -page_height * 0.02)


def fragment_of_line(text: Column, b: Column, page_height: Column) -> Column:
    """Short pieces that may form a line of figures: letters, or numbers outside the title strip; quarters aside."""
    t = T.strip(F.coalesce(text, F.lit("")))
    number = t.rlike(r"^[+-]?\d+(?:[.,]\d+)?%?\)?$")
    return (t != "") & ~t.rlike(r"(?i)^\dQ\d{2,4}$") & ~((G.y0(b) < page_height * 0.14) & number) & (t.rlike("[A-Za-z가-힣]") | number | (t.rlike(r"\d") & t.rlike("[+%.,)]")))


def page_profiles(blocks: DataFrame) -> DataFrame:
    """doc_id, page_num and how a slide's text is spread: local_chars, global_chars, visuals, global_only, legal_like, index_like.

    Texts across the page's top, or of the off-page stream, are global, the others
    local. ``blocks``: type, text, bbox, page_width, page_height, slide_role, summary_exclude.
    """
    b, text = F.col("bbox"), F.coalesce("text", F.lit(""))
    role = F.coalesce("slide_role", F.lit(""))
    said = F.col("type").isin("text", "title") & ~F.coalesce("summary_exclude", F.lit(False)) & (role != "footer") & (T.strip(text) != "")
    wide = (dense_length(text) > 140) & (G.width(b) >= F.col("page_width") * 0.65) & (G.y0(b) <= F.col("page_height") * 0.20) & (G.y1(b) <= F.col("page_height") * 0.36) & (G.height(b) <= F.col("page_height") * 0.24)
    streams = said & ((role == "offpage_text_stream") | wide)
    total = lambda condition, c: F.coalesce(F.sum(F.when(condition, c)), F.lit(0))
    found = blocks.groupBy(*AT).agg(
        total(said & ~streams, dense_length(text)).alias("local_chars"), total(streams, dense_length(text)).alias("global_chars"), F.count_if(F.col("type").isin("chart", "image")).alias("visuals"),
        total(streams, F.regexp_count(text, F.lit("[.!?。]"))).alias("stops"), total(streams, F.regexp_count(text, F.lit(r"\d"))).alias("digits"),
    )
    c = F.col
    share = TB.ratio(c("digits"), c("global_chars"))
    only = (c("global_chars") >= 40) & (c("local_chars") < 40)
    legal = only & (c("stops") >= 1) & (c("global_chars") > 55) & (share < 0.18) & (c("visuals") <= 4)
    listed = only & (c("global_chars") <= 260) & (share >= 0.08) & (c("visuals") <= 4)
    return found.select(*AT, "local_chars", "global_chars", "visuals", only.alias("global_only"), legal.alias("legal_like"), listed.alias("index_like"))


def page_roles(blocks: DataFrame) -> DataFrame:
    """doc_id, page_num, page_role: cover, disclaimer (the last page), toc, section_divider (under five blocks) or body. Pages count from 1."""
    text = T.squeezed(F.lower(F.coalesce("text", F.lit(""))))
    pages = blocks.groupBy(*AT).agg(F.count("*").alias("n"), F.max(T.contains_any(text, ("목차", "contents", "index"))).alias("toc"))
    last = pages.groupBy("doc_id").agg(F.max("page_num").alias("last"))
    role = F.when(F.col("page_num") == 1, "cover").when(F.col("page_num") >= F.col("last"), "disclaimer").when(F.col("toc"), "toc").when(F.col("n") < 5, "section_divider").otherwise("body")
    return pages.join(last, "doc_id").select(*AT, role.alias("page_role"))


def page_mode(characters: Column, words: Column, texts: Column, images: Column, candidates: Column) -> Column:
    """Whether a slide's own text is enough, has to be read optically, or both."""
    rich = (characters >= 120) | (words >= 40) | ((texts >= 4) & (characters >= 60))
    bare = (characters < 40) & (words < 15) & ((candidates >= 50) | (images >= 15) | ((images > 0) & (texts == 0)) | (characters < 10))
    return F.when(rich, "native_text_slide").when(bare, "ocr_slide").otherwise("hybrid_slide")


def kept_visuals(visuals: DataFrame, most: int = 10) -> DataFrame:
    """Visuals of some size and shape; of a page with more than ``most`` the largest, in reading order.

    ``visuals``: doc_id, page_num, seq, bbox, page_width, page_height.
    """
    b = F.col("bbox")
    area = G.area(b)
    fit = visuals.filter(~P.decorative_shape(G.width(b), G.height(b), F.col("page_width"), F.col("page_height")) & (area >= 0.005 * F.col("page_width") * F.col("page_height")))
    page = W.partitionBy(*AT)
    ranked = fit.withColumns({"__n": F.count("*").over(page), "__rank": F.row_number().over(page.orderBy(F.desc(area), "seq"))})
    return ranked.filter((F.col("__n") <= most) | (F.col("__rank") <= most)).drop("__n", "__rank")


def visual_hosts(visuals: DataFrame, blocks: DataFrame, least: float = 0.35) -> DataFrame:
    """Each visual with the text, title or table it belongs to: overlap, nearness and a telling role count; none below ``least``.

    Pairs are formed within a page only. ``blocks`` has page_width, page_height and dashboard_role.
    """
    role = F.coalesce("dashboard_role", F.lit(""))
    hosts = blocks.filter(F.col("type").isin("text", "title", "table") & (role != "footer")).select(*AT, F.col("seq").alias("host_seq"), F.col("bbox").alias("h_bbox"), role.alias("h_role"), "page_width", "page_height")
    a, b = F.col("bbox"), F.col("h_bbox")
    near = (G.horizontal_gap(a, b) < F.col("page_width") * 0.04) & (G.vertical_gap(a, b) < F.col("page_height") * 0.04)
    score = G.overlap_of_first(a, b) + F.when(near, 1.0).otherwise(0.0) + F.when(F.col("h_role").isin("kpi", "ranking", "mini_table", "issue_box", "card_text", "title"), 0.25).otherwise(0.0)
    met = visuals.select(*AT, "seq", "bbox").join(hosts, AT).withColumn("score", score).filter(F.col("score") >= least)
    best = met.groupBy(*AT, "seq").agg(F.max_by(F.struct("host_seq", "score"), F.struct("score", -F.col("host_seq"))).alias("h"))
    return visuals.select(*AT, "seq").join(best, [*AT, "seq"], "left").select(*AT, "seq", "h.host_seq", F.round("h.score", 6).alias("score"))


def region_stats(members: DataFrame) -> DataFrame:
    """doc_id, page_num, regions and the least, largest and mean share of the page and number of lines of its regions (region, bbox, page_width, page_height)."""
    share = G.area(F.col("box")) / (F.col("page_width") * F.col("page_height"))
    each = members.groupBy(*AT, "region").agg(G.union_all(F.col("bbox")).alias("box"), F.count("*").alias("lines"), F.first("page_width").alias("page_width"), F.first("page_height").alias("page_height")).withColumn("share", share)
    return each.groupBy(*AT).agg(
        F.count("*").alias("regions"), F.round(F.min("share"), 5).alias("area_min"), F.round(F.max("share"), 5).alias("area_max"), F.round(F.avg("share"), 5).alias("area_mean"), F.min("lines").alias("lines_min"), F.max("lines").alias("lines_max"), F.round(F.avg("lines"), 3).alias("lines_mean")
    )


# --- boxes that were read optically --------------------------------------------------------------------------------


def sound_box(text: Column, sure: Column) -> Column:
    """Boxes that aren't noise: the shorter the text, the surer it has to be; some letter or digit at all."""
    t = T.strip(F.coalesce(text, F.lit("")))
    n = F.length(t)
    unsure = ((n <= 1) & (sure < 0.7)) | ((n <= 2) & (sure < 0.5)) | ((n <= 3) & ((sure < 0.35) | (~t.rlike("[A-Za-z가-힣]") & (sure < 0.6))))
    return t.rlike(P.MEANING) & ~unsure


def box_score(boxes: DataFrame) -> DataFrame:
    """doc_id, page_num, score of what was read: sure characters, more for valid boxes and coverage, less for fragments; a tenth under ten characters.

    ``boxes``: doc_id, page_num, text, confidence, bbox, page_width, page_height.
    """
    n, sure = F.length(T.strip(F.coalesce("text", F.lit("")))), F.coalesce("confidence", F.lit(0.0))
    found = boxes.groupBy(*AT).agg(
        F.sum(n * sure).alias("weighted"), F.avg(((sure > 0.4) & (n >= 2)).cast("double")).alias("valid"), F.avg((n <= 2).cast("double")).alias("micro"), F.sum(n).alias("chars"),
        F.least(F.lit(0.5), F.sum(G.area(F.col("bbox"))) / F.greatest(F.lit(1.0), F.first(F.col("page_width") * F.col("page_height")))).alias("coverage"),
    )
    c = F.col
    score = c("weighted") * (1.0 + c("valid") * 0.3) * (1.0 + c("coverage") * 0.2) - c("micro") * c("chars") * 0.3
    return found.select(*AT, F.round(F.greatest(F.lit(0.0), F.when(c("chars") < 10, score * 0.1).otherwise(score)), 2).alias("score"))


def joined_boxes(boxes: DataFrame) -> DataFrame:
    """doc_id, page_num, place, text, confidence, bbox: sound boxes joined along their lines while the next one is level and near.

    Whether a box joins depends on the box grown so far, so each page's boxes, a
    bounded list, are folded in order inside the JVM.
    """
    b = F.col("bbox")
    item = F.struct(F.rint(G.center_y(b)).alias("line"), G.x0(b).alias("x"), "text", F.col("confidence").cast("double").alias("confidence"), "bbox")
    pages = boxes.filter(sound_box(F.col("text"), F.col("confidence"))).groupBy(*AT).agg(F.array_sort(F.collect_list(item)).alias("items"))
    box = "struct<text:string,confidence:double,bbox:array<double>>"

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        high = F.greatest(F.lit(1.0), G.height(last["bbox"]))
        gap = G.x0(x["bbox"]) - G.x1(last["bbox"])
        near = (F.abs(G.center_y(last["bbox"]) - G.center_y(x["bbox"])) <= high * 0.6) & (gap <= high * 1.5) & (gap >= -high * 0.3)
        grown = F.struct(F.concat(last["text"], F.when(gap < high * 0.3, "").otherwise(" "), x["text"]).alias("text"), F.round((last["confidence"] + x["confidence"]) / 2, 4).alias("confidence"), G.union(last["bbox"], x["bbox"]).alias("bbox"))
        fresh = F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["bbox"].alias("bbox"))
        return F.when((F.size(done) > 0) & near, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown.cast(box)))).otherwise(F.concat(done, F.array(fresh.cast(box))))

    first = F.get("items", F.lit(0))
    start = F.array(F.struct(first["text"].alias("text"), first["confidence"].alias("confidence"), first["bbox"].alias("bbox")).cast(box))
    folded = F.aggregate(F.slice(F.col("items"), F.lit(2), F.size("items")), start, add)
    return pages.select(*AT, F.posexplode(folded).alias("place", "b")).select(*AT, "place", "b.text", "b.confidence", "b.bbox")


# --- pages and tables as a whole -----------------------------------------------------------------------------------


def accepted_scan(rows: Column, b: Column, page_width: Column, page_height: Column, accuracy: Column) -> Column:
    """``struct(accepted, reason)`` of a table that a scan found."""
    n, m = F.size(rows), F.size(F.get(rows, F.lit(0)))
    filled = TB.ratio(T.count_if(F.flatten(rows), lambda c: T.strip(c) != ""), n * m)
    reason = (
        F.when(n < SCAN_ROWS, "too_few_rows").when(m < SCAN_COLS, "too_few_cols").when(filled < SCAN_FILLED, "low_filled_ratio").when(TB.ratio(G.area(b), page_width * page_height) > SCAN_AREA, "bbox_too_large").when(accuracy < SCAN_ACCURACY, "low_accuracy").otherwise("accepted")
    )
    return T.let(reason, lambda r: F.struct((r == "accepted").alias("accepted"), r.alias("reason")))


def suppressed(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """``blocks`` with ``summary_exclude``, ``exclude_reason`` and ``summary_priority`` by their document's type (doc_id, document_type): tiny texts
    of slides and wordy ones of dashboards go, tables of table documents come first."""
    rows = blocks.join(documents.select("doc_id", F.col("document_type").alias("__kind")), "doc_id", "left")
    t = T.strip(F.coalesce("text", F.lit("")))
    digits = F.regexp_count(t, F.lit(r"\d")) / F.greatest(F.lit(1), F.length(t))
    plain = F.col("type") == "text"
    out = F.coalesce("summary_exclude", F.lit(False))
    tiny = (F.col("__kind") == "slide_ir") & plain & (F.length(t) < 15) & (F.coalesce("summary_role", F.lit("")) != "title")
    wordy = (F.col("__kind") == "dashboard_brief") & plain & (F.length(t) < 50) & (digits < 0.1)
    why = F.when(~out & tiny, "slide_micro_text").when(~out & wordy, "dashboard_narrative_noise")
    first = (F.col("__kind") == "table_heavy") & (F.col("type") == "table")
    return rows.withColumns({"exclude_reason": F.coalesce(why, "exclude_reason"), "summary_exclude": out | F.coalesce(why.isNotNull(), F.lit(False)), "summary_priority": F.when(first, "high").otherwise(F.col("summary_priority"))}).drop("__kind")


def enriched_tables(blocks: DataFrame) -> DataFrame:
    """``blocks`` whose tables are judged: a candidate below 1 becomes ``unknown``; the others get Markdown, quality and readiness."""
    b = F.col("bbox")
    own = F.col("type") == "table"
    rows = TB.text_to_rows(F.col("text"))
    scored = TB.candidate_score(F.col("type"), F.col("source"), F.col("text"), rows, F.try_divide(G.area(b), F.col("page_width") * F.col("page_height")), F.try_divide(G.width(b), G.height(b)))
    made = blocks.withColumn("__score", F.when(own, scored["score"])).withColumn("__t", F.when(own & (F.col("__score") >= 1.0), TB.normalized(rows, F.col("source"), F.lit(None).cast("string")))).withColumn("__q", TB.quality(F.col("__t")))
    return made.withColumns({
        "type": F.when(own & (F.col("__score") < 1.0), "unknown").otherwise(F.col("type")), "table_score": F.round("__score", 6), "table_markdown": F.col("__t.markdown"),
        "table_quality": F.when(F.col("__t").isNotNull(), F.round("__q.overall", 6)), "table_readiness": F.when(F.col("__t").isNotNull(), TB.readiness(F.col("__t"), F.col("__q.reject_signals"))),
    }).drop("__score", "__t", "__q")


def finalised(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of finished pages and those set aside: boxes checked, repeats dropped, tables judged, ordered for reading."""
    good, aside = layout.valid_blocks(blocks)
    once = layout.deduplicated(good).select(*AT, "seq")
    return layout.reading_order(enriched_tables(good.join(once, [*AT, "seq"], "left_semi"))), aside


def first_route(pages: DataFrame, blocks: DataFrame, sample: int = 5) -> DataFrame:
    """doc_id, document_type from each document's first ``sample`` pages: a quick route without mixed types."""
    early = F.col("page_num") <= sample
    scored = routing.page_scores(routing.page_features(pages.filter(early), blocks.filter(early)))
    return routing.routed(scored, allow_mixed=False).select("doc_id", "document_type", "confidence")
