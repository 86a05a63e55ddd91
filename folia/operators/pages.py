"""Pages judged as wholes: their class, quality and content, and the order and sections of their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions import geometry as G
from folia.functions import pagetext as P
from folia.functions import text as T

AT = ["doc_id", "page_num"]


def classified(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page_num, page_class, signals: cover or disclaimer, appendix, dashboard, slide or text, from one aggregate of a page's blocks."""
    kind, text = F.col("type"), F.coalesce("text", F.lit(""))
    own = blocks.groupBy(*AT).agg(
        F.count("*").alias("blocks"), F.count_if(kind == "title").alias("titles"), F.count_if(kind == "text").alias("texts"), F.count_if(kind.isin("image", "chart", "table")).alias("visuals"),
        F.count_if((kind == "text") & (F.length(text) > 60) & text.contains("다.")).alias("long"), F.coalesce(F.sum(F.when(kind == "text", F.regexp_count(text, F.lit(r"\d+")))), F.lit(0)).alias("numbers"),
        F.coalesce(F.sum(F.when(kind == "text", F.regexp_count(text, F.lit("%")))), F.lit(0)).alias("percents"),
    )
    c = F.col
    squeezed = F.replace(F.lower(F.coalesce("text", F.lit(""))), F.lit(" "), F.lit(""))
    hits = lambda words: sum((squeezed.contains(w).cast("int") for w in words), F.lit(0))
    rows = pages.join(own, AT, "left").fillna(0, ["blocks", "titles", "texts", "visuals", "long", "numbers", "percents"])
    rows = rows.withColumns({"disclaimers": hits(P.PAGE_DISCLAIMER), "words": hits(P.DASHBOARD_WORDS), "dates": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(P.DATES))})
    cover = T.points((c("disclaimers") > 0, 3), (c("long") == 0, 1), (c("page_num") <= 2, 1), ((c("titles") >= 2) & (c("texts") <= 3), 1), (c("dates") >= 2, 1))
    board = T.points((c("words") >= 3, 2), ((c("numbers") > 40) & (c("percents") > 3), 1), (c("blocks") > 15, 1), (c("visuals") >= 2, 1), ((c("long") > 0) & (c("visuals") > 0), 1))
    rows = rows.withColumns({"cover_score": cover, "board_score": board})
    page_class = (
        F.when((c("cover_score") >= 4) | (c("disclaimers") >= 2), "cover_or_disclaimer_like").when((c("visuals") > c("texts")) & (c("visuals") >= 2) & (c("long") == 0), "appendix_or_table_heavy")
        .when((c("board_score") >= 3) & (c("numbers") > 30), "dashboard_kpi_like").when(c("page_width") > c("page_height") * 1.05, "slide_like").otherwise("text_heavy")
    )
    named = F.array_compact(F.array(
        F.when(c("disclaimers") > 0, F.format_string("disclaimer_found(%d)", "disclaimers")), F.when(c("page_num") <= 2, F.lit("early_page")), F.when(c("long") == 0, F.lit("no_long_paragraph")),
        F.when((c("titles") >= 2) & (c("texts") <= 3), F.lit("title_heavy_layout")), F.when(c("dates") >= 2, F.format_string("date_pattern(%d)", "dates")),
    ))
    return rows.select(*AT, page_class.alias("page_class"), named.alias("signals"))


def quality(pages: DataFrame) -> DataFrame:
    """doc_id, quality: the mean of the pages' points less errors (50), warnings (5 each) and unsure optical reading (20); less again for many empty pages.

    ``pages``: doc_id, text, error, warnings, ocr_applied, ocr_confidence.
    """
    points = 100.0 - F.when(F.col("error"), 50).otherwise(0) - 5 * F.coalesce("warnings", F.lit(0)) - F.when(F.col("ocr_applied") & (F.coalesce("ocr_confidence", F.lit(100)) < 60), 20).otherwise(0)
    empty = F.count_if(T.strip(F.coalesce("text", F.lit(""))) == "")
    found = pages.groupBy("doc_id").agg(F.avg(F.greatest(F.lit(0.0), points)).alias("mean"), (empty > F.count("*") * 0.3).alias("sparse"))
    return found.select("doc_id", F.round(F.col("mean") * F.when(F.col("sparse"), 0.7).otherwise(1.0), 2).alias("quality"))


def content(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page_count, title_blocks, text_blocks, tables, empty_pages, text_quality of each document."""
    kind = F.col("type")
    own = blocks.groupBy("doc_id").agg(F.count_if(kind == "title").alias("title_blocks"), F.count_if(kind == "text").alias("text_blocks"), F.count_if(kind == "table").alias("tables"))
    text = F.coalesce("text", F.lit(""))
    whole = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.count_if(T.strip(text) == "").alias("empty_pages"), F.avg(F.length(text)).alias("mean"))
    score = 100.0 - F.col("empty_pages") / F.col("page_count") * 45.0 + F.when(F.col("mean") < 300, -10.0).when(F.col("mean") > 1200, 3.0).otherwise(0.0)
    joined = whole.join(own, "doc_id", "left").fillna(0, ["title_blocks", "text_blocks", "tables"])
    return joined.select("doc_id", "page_count", "title_blocks", "text_blocks", "tables", "empty_pages", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2).alias("text_quality"))


def unique_lines(lines: DataFrame, limit: int = 12) -> DataFrame:
    """doc_id, page_num, texts: each page's first ``limit`` line texts from top to bottom, repeats by letter case left out."""
    text = T.normalize_text(F.col("text"))
    b = F.col("bbox")
    rows = lines.select(*AT, text.alias("t"), F.lower(text).alias("k"), F.struct(G.y0(b).alias("y"), G.x0(b).alias("x"), "seq").alias("place")).filter("t <> ''")
    first = rows.groupBy(*AT, "k").agg(F.min_by("t", "place").alias("t"), F.min("place").alias("place"))
    return first.groupBy(*AT).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("place", "t"))), 1, limit), lambda x: x["t"]).alias("texts"))


def left_sections(lines: DataFrame, gap: float = 0.036) -> DataFrame:
    """``lines`` (doc_id, page_num, seq, text, bbox, page_height) of a left column with ``role``: a short, low, lettered first line that stands
    apart from longer lines below it is a section's header, those its body; other lines are narrative."""
    b, h = F.col("bbox"), F.col("page_height")
    order = W.partitionBy(*AT).orderBy(G.y0(b), G.x0(b), "seq")
    new = F.coalesce(G.y0(b) - F.lag(G.y1(b)).over(order) > h * gap, F.lit(True))
    rows = lines.withColumn("new", new.cast("int")).withColumn("cluster", F.sum("new").over(order))
    own = W.partitionBy(*AT, "cluster").orderBy(G.y0(b), G.x0(b), "seq")
    all_of = W.partitionBy(*AT, "cluster")
    size = F.length(T.strip(F.col("text")))
    rows = rows.withColumns({"n": F.row_number().over(own), "size": size, "alpha": P.share_of(F.col("text"), "[A-Za-z가-힣]"), "height": G.height(b), "to_next": F.lead(G.y0(b)).over(own) - G.y1(b)})
    first = (F.col("n") == 1).cast("int")
    fits = (F.col("n") == 1) & (F.col("size") <= 35) & (F.col("height") <= h * 0.022) & (F.col("alpha") >= 0.22) & (F.col("to_next") >= h * 0.008)
    head_size, body = F.max(F.col("size") * first).over(all_of), F.avg(F.when(F.col("n") > 1, F.col("size"))).over(all_of)
    headed = F.coalesce(F.max(fits.cast("int")).over(all_of) == 1, F.lit(False)) & ~F.coalesce((body > 0) & (head_size >= 0.6 * body), F.lit(False)) & (F.count("*").over(all_of) > 1)
    role = F.when(headed & (F.col("n") == 1), "section_header_like").when(headed, "section_body_like").otherwise("narrative_text")
    return rows.withColumn("role", role).select(*lines.columns, "role")


def dashboard_rank(kind: Column, role: Column) -> Column:
    """The place of a dashboard block's kind in its page's final order; equal ones go by height."""
    return (
        F.when(kind == "title", 0).when(role == "narrative_paragraph", 1).when(role == "section_header_like", 2).when(role == "section_body_like", 3).when(role == "structured_card", 4)
        .when(role.isin("chart_label_like", "list_item_like", "card_header_like"), 5).when(role == "contact_info_like", 6).when((kind == "footer") | (role == "footer"), 8).when(role == "ignore_noise", 9).otherwise(7)
    )


def line_blocks(lines: DataFrame) -> DataFrame:
    """Lines (with ``role`` and ``coarse`` role) as blocks of their own: type, dashboard role, priority and exclusion by the role."""
    role = F.coalesce("role", F.lit(""))
    out = role.isin("ignore_noise", "footer")
    board = F.when(role == "chart_label_like", "kpi").when(role == "list_item_like", "ranking").when(role == "table_header_like", "mini_table").otherwise(F.coalesce("coarse", F.lit("card_text")))
    priority = F.when(out, "low").when(role.isin("chart_label_like", "list_item_like", "table_header_like"), "high").otherwise("medium")
    return lines.withColumns({"type": F.when(out, "footer").otherwise("text"), "dashboard_role": board, "summary_priority": priority, "summary_exclude": out})


def most_overlap(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """doc_id, page_num, seq, overlap: the largest share of a line that a zone of its page covers; 0 without one."""
    z = zones.select(*AT, F.col("bbox").alias("z_bbox"))
    met = lines.join(z, AT).groupBy(*AT, "seq").agg(F.max(G.inner_overlap(F.col("bbox"), F.col("z_bbox"))).alias("overlap"))
    return lines.select(*AT, "seq").join(met, [*AT, "seq"], "left").select(*AT, "seq", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def exclusion_zones(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page_num, kind (hard or soft), bbox: where a dashboard page has no prose.

    Hard zones are the tables and the clusters (``cluster`` of ``lines``) of three or
    more short or numeric lines on the right or at the bottom; soft ones numeric
    clusters on the right. Each is a little inflated; one above 40 % of the page is none.
    """
    b, pw, ph = F.col("bbox"), F.col("page_width"), F.col("page_height")
    own = lines.groupBy(*AT, "cluster").agg(
        G.union_all(b).alias("bbox"), F.count("*").alias("n"), F.avg(G.width(b) / F.greatest(pw, F.lit(1.0))).alias("wide"), F.avg(P.share_of(F.col("text"), r"\d")).alias("numeric"),
        F.avg((F.length(T.strip(F.coalesce("text", F.lit("")))) <= 22).cast("double")).alias("short"), F.first("page_width").alias("page_width"), F.first("page_height").alias("page_height"),
    )
    c = F.col
    cx, cy = G.center_x(b), G.center_y(b)
    some = c("n") >= 3
    tight = some & (c("wide") <= 0.38) & ((c("numeric") >= 0.26) | (c("short") >= 0.45))
    right = tight & (cx >= 0.52 * pw) & (cy < 0.67 * ph)
    bottom = tight & ~right & (G.y0(b) >= 0.66 * ph)
    soft = some & (c("numeric") >= 0.30) & (c("wide") <= 0.36) & (cx >= 0.50 * pw)
    zone = lambda kind, dx, dy: F.struct(F.lit(kind).alias("kind"), G.expanded(b, pw * dx, ph * dy).alias("bbox"))
    made = F.array_compact(F.array(F.when(right, zone("hard", 0.008, 0.006)).when(bottom, zone("hard", 0.006, 0.005)), F.when(soft, zone("soft", 0.004, 0.003))))
    of_lines = own.select(*AT, "page_width", "page_height", F.explode(made).alias("z")).select(*AT, "page_width", "page_height", "z.kind", "z.bbox")
    of_tables = tables.select(*AT, "page_width", "page_height", F.lit("hard").alias("kind"), G.expanded(b, F.greatest(F.lit(2.0), pw * 0.011), F.greatest(F.lit(2.0), ph * 0.009)).alias("bbox"))
    return of_lines.unionByName(of_tables).filter(G.area(b) <= 0.40 * pw * ph).select(*AT, "kind", "bbox")
