"""Blocks in the plane: reading order, islands, spatial joins, and the greedy operators.

Joins in the plane are equi-joins on (document, page) with a residual condition, so
their cost is bounded by a page's blocks. Operators whose next step depends on what
they have already kept go through a page's blocks together.
"""

from __future__ import annotations

import difflib
import re
from collections import namedtuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from folia.functions import geometry as G
from folia.functions import text as T

from .retrieval import dealt

AT = ["doc_id", "page_num"]


def page_window(*order) -> W:
    return W.partitionBy(*AT).orderBy(*order)


def valid_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks clamped to their page with a known type; and those dropped, with the reason."""
    b = F.col("bbox")
    known = F.when(F.col("type").isin("text", "title", "footer", "table", "image", "chart"), F.col("type")).otherwise("unknown")
    box = G.clamped(b, F.coalesce("page_width", F.lit(0.0)), F.coalesce("page_height", F.lit(0.0)))
    reason = F.when((F.size(b) != 4) | b.isNull(), "bad_bbox").when((G.x1(b) <= G.x0(b)) | (G.y1(b) <= G.y0(b)), "empty_bbox").when(known.isin("text", "title") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "empty_text")
    rows = blocks.withColumns({"drop_reason": reason, "type": known})
    return rows.filter("drop_reason is null").withColumn("bbox", box).drop("drop_reason"), rows.filter("drop_reason is not null")


def reading_order(blocks: DataFrame, multi_column: bool = False) -> DataFrame:
    """``rag_order`` from 0: bands of 20 points, then x; with ``multi_column`` the left column before the right."""
    b = F.col("bbox")
    column = F.when(G.center_x(b) < F.col("page_width") / 2, 0).otherwise(1) if multi_column else F.lit(0)
    return blocks.withColumn("rag_order", F.row_number().over(page_window(column, F.floor(G.y0(b) / 20), G.x0(b), "seq")) - 1)


def layout_hint(blocks: DataFrame) -> DataFrame:
    """two_column_text, slide_like or single_column for each page."""
    b = F.col("bbox")
    side = G.column_of(b, F.col("page_width"))
    rows = blocks.groupBy(*AT).agg(F.count_if(side == "left").alias("left"), F.count_if(side == "right").alias("right"), F.count_if(side == "full").alias("full"), F.max(F.col("page_width") > F.col("page_height") * 1.05).alias("wide"))
    hint = F.when("wide", "slide_like").when((F.col("left") >= 3) & (F.col("right") >= 3) & (F.col("full") <= F.col("left") + F.col("right")), "two_column_text").otherwise("single_column")
    return rows.select(*AT, hint.alias("hint"), "left", "right", "full")


def line_islands(spans: DataFrame, dy: float = 2.5) -> DataFrame:
    """Spans with ``line``: a new line begins where the height differs by ``dy`` or more from the span before."""
    order = page_window(G.y0(F.col("bbox")), G.x0(F.col("bbox")), "seq")
    new = F.when(F.abs(G.y0(F.col("bbox")) - F.lag(G.y0(F.col("bbox"))).over(order)) < dy, 0).otherwise(1)
    return spans.withColumn("__new", new).withColumn("line", F.sum("__new").over(order)).drop("__new")


def lines_to_blocks(lines: DataFrame, gap: float = 1.6, drift: float = 40.0) -> DataFrame:
    """Lines (bbox, font_size) with ``island``: a line joins the one above if the gap is small for its font and the left edges agree."""
    order = page_window(G.y0(F.col("bbox")), G.x0(F.col("bbox")), "seq")
    before = F.lag("bbox").over(order)
    joined = (G.y0(F.col("bbox")) - G.y1(before) <= gap * F.lag("font_size").over(order)) & (F.abs(G.x0(F.col("bbox")) - G.x0(before)) < drift)
    return lines.withColumn("__new", F.when(joined, 0).otherwise(1)).withColumn("island", F.sum("__new").over(order)).drop("__new")


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, page_num, paragraph, bbox, text: lines joined while the gap stays under 2.4 times the page's median gap or 3 % of its height."""
    order = page_window(G.y0(F.col("bbox")), G.x0(F.col("bbox")), "seq")
    rows = lines.withColumn("gap", F.greatest(F.lit(0.0), G.y0(F.col("bbox")) - G.y1(F.lag("bbox").over(order))))
    median = rows.groupBy(*AT).agg(F.median("gap").alias("median_gap"))
    rows = rows.join(median, AT).withColumn("__new", F.when(F.col("gap") <= F.greatest(2.4 * F.col("median_gap"), 0.03 * F.col("page_height")), 0).otherwise(1))
    rows = rows.withColumn("paragraph", F.sum("__new").over(order))
    return rows.groupBy(*AT, "paragraph").agg(G.union_all(F.col("bbox")).alias("bbox"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n_lines"))


def regular_lists(blocks: DataFrame, bucket: float = 18.0) -> DataFrame:
    """x-buckets of three or more lines at regular distances (their spread under 1.2 % of the page's height)."""
    rows = blocks.withColumn("bucket", F.floor(G.x0(F.col("bbox")) / bucket))
    order = W.partitionBy(*AT, "bucket").orderBy(G.y0(F.col("bbox")), "seq")
    rows = rows.withColumn("gap", G.y0(F.col("bbox")) - F.lag(G.y0(F.col("bbox"))).over(order))
    return rows.groupBy(*AT, "bucket").agg(F.count("*").alias("n"), F.stddev_pop("gap").alias("spread"), F.max("page_height").alias("h")).filter("n >= 3 and spread < 0.012 * h").select(*AT, "bucket", "n", F.round("spread", 6).alias("spread"))


def _pairs(left: DataFrame, right: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each left block with the other blocks of its page, the right one's columns prefixed ``r_``."""
    return left.join(right.select(*AT, *(F.col(c).alias(f"r_{c}") for c in columns)), AT)


def nearest_heading(blocks: DataFrame, within: float = 200.0, slack: float = 10.0) -> DataFrame:
    """Each block that isn't a title with the nearest title above it; none beyond ``within`` points."""
    heads = blocks.filter("type = 'title'")
    pairs = _pairs(blocks.filter("type <> 'title'"), heads, ("seq", "bbox", "text")).withColumn("gap", G.y0(F.col("bbox")) - G.y1(F.col("r_bbox"))).filter((F.col("gap") >= -slack) & (F.col("gap") <= within))
    best = pairs.groupBy(*AT, "seq").agg(F.min_by(F.struct("r_seq", "r_text", "gap"), F.struct(F.abs("gap"), "r_seq")).alias("h"))
    return blocks.filter("type <> 'title'").select(*AT, "seq").join(best, [*AT, "seq"], "left").select(*AT, "seq", F.col("h.r_seq").alias("heading_seq"), F.col("h.r_text").alias("heading"), F.col("h.gap").alias("gap"))


def captions(blocks: DataFrame, near: float = 80.0, body: float = 40.0) -> DataFrame:
    """Each table or visual with the nearest short text within ``near`` points in its column; else the nearest text within ``body``."""
    targets, texts = blocks.filter(F.col("type").isin("table", "image", "chart")), blocks.filter(F.col("type").isin("text", "title"))
    pairs = _pairs(targets, texts, ("seq", "bbox", "text")).withColumn("gap", G.vertical_gap(F.col("bbox"), F.col("r_bbox"))).filter(G.horizontal_overlap(F.col("bbox"), F.col("r_bbox")) > 0)
    tier = F.when((F.length("r_text") <= 120) & (F.col("gap") < near), 0).when(F.col("gap") < body, 1)
    best = pairs.withColumn("tier", tier).filter("tier is not null").groupBy(*AT, "seq").agg(F.min_by(F.struct("r_seq", "r_text"), F.struct("tier", "gap", "r_seq")).alias("c"))
    return targets.select(*AT, "seq").join(best, [*AT, "seq"], "left").select(*AT, "seq", F.col("c.r_seq").alias("caption_seq"), F.col("c.r_text").alias("caption"))


def nearby_texts(anchors: DataFrame, texts: DataFrame, k: int = 4, dx: float = 24.0, dy: float = 60.0, overlap: float = 0.20) -> DataFrame:
    """The ``k`` nearest texts whose box meets the anchor's enlarged one by ``overlap``."""
    pairs = _pairs(anchors, texts, ("seq", "bbox", "text")).filter("seq <> r_seq")
    pairs = pairs.withColumns({"share": G.inner_overlap(G.expanded(F.col("bbox"), dx, dy), F.col("r_bbox")), "distance": G.vertical_gap(F.col("bbox"), F.col("r_bbox")) + G.horizontal_gap(F.col("bbox"), F.col("r_bbox"))}).filter(F.col("share") >= overlap)
    rank = F.row_number().over(W.partitionBy(*AT, "seq").orderBy("distance", "r_seq"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select(*AT, "seq", "rank", "r_seq", "distance")


def best_region(items: DataFrame, regions: DataFrame, least: float = 0.20) -> DataFrame:
    """Each item with the region it overlaps most, more so if its centre lies inside; the first of equal ones."""
    pairs = _pairs(items, regions, ("region", "bbox"))
    score = G.overlap_of_first(F.col("bbox"), F.col("r_bbox")) + F.when(G.contains_center(F.col("r_bbox"), F.col("bbox")), 0.25).otherwise(0.0)
    scored = pairs.withColumn("score", score).filter(F.col("score") >= least)
    return scored.groupBy(*AT, "seq").agg(F.max_by(F.struct(F.col("r_region").alias("region"), "score"), F.struct("score", -F.col("r_region"))).alias("m")).select(*AT, "seq", "m.region", F.round("m.score", 6).alias("score"))


def outside_tables(texts: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Texts that no table covers by half or more."""
    t = tables.select(*AT, F.col("bbox").alias("t_bbox"))
    hit = texts.join(t, AT).filter(G.overlap_of_first(F.col("bbox"), F.col("t_bbox")) >= share).select(*AT, "seq").distinct()
    return texts.join(hit, [*AT, "seq"], "left_anti")


def text_inside_images(blocks: DataFrame) -> DataFrame:
    """Characters of the texts inside each image."""
    pairs = _pairs(blocks.filter(F.col("type").isin("image", "chart")), blocks.filter(F.col("type").isin("text", "title")), ("bbox", "text"))
    inside = F.when(G.contains_center(F.col("bbox"), F.col("r_bbox")), F.length("r_text")).otherwise(0)
    return pairs.groupBy(*AT, "seq").agg(F.sum(inside).alias("inner_chars"))


def neighbour_counts(blocks: DataFrame, band: float = 0.055) -> DataFrame:
    """Other blocks within a band of the page's height whose x-range meets the block's."""
    right = blocks.select(*AT, F.col("seq").alias("r_seq"), F.col("bbox").alias("r_bbox"))
    near = (F.col("seq") != F.col("r_seq")) & (F.abs(G.center_y(F.col("bbox")) - G.center_y(F.col("r_bbox"))) <= band * F.col("page_height")) & (G.horizontal_overlap(F.col("bbox"), F.col("r_bbox")) > 0)
    found = blocks.join(right, AT).filter(near).groupBy(*AT, "seq").agg(F.count("*").alias("neighbours"))
    return blocks.select(*AT, "seq").join(found, [*AT, "seq"], "left").fillna(0, ["neighbours"])


def previous_title(blocks: DataFrame) -> DataFrame:
    """Each block with the last title before it and the first text among the next two."""
    order = page_window("seq")
    title, text = F.when(F.col("type") == "title", F.col("text")), F.when(F.col("type") == "text", F.col("text"))
    return blocks.select(*AT, "seq", F.last(title, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("title_before"), F.first(text, ignorenulls=True).over(order.rowsBetween(1, 2)).alias("text_after"))


def axis_neighbours(blocks: DataFrame, flag: Column) -> DataFrame:
    """Whether one of the two blocks before or after has ``flag``."""
    order = page_window("seq")
    f = flag.cast("int")
    return blocks.select(*AT, "seq", F.coalesce(F.greatest(F.max(f).over(order.rowsBetween(-2, -1)), F.max(f).over(order.rowsBetween(1, 2))) == 1, F.lit(False)).alias("near_flag"))


def panel_order(blocks: DataFrame) -> DataFrame:
    """Panels numbered by place, and each block's ``panel * 1000 + int(10 y) + int(x)`` with the page scaled to one."""
    first = blocks.filter("panel_id is not null").groupBy(*AT, "panel_id").agg(F.min(G.y0(F.col("bbox"))).alias("y"), F.min(G.x0(F.col("bbox"))).alias("x"))
    ranked = first.withColumn("panel_order", F.dense_rank().over(page_window(F.floor(F.col("y") / 20), "x", "panel_id"))).select(*AT, "panel_id", "panel_order")
    b = F.col("bbox")
    place = F.col("panel_order") * 1000 + F.floor(10 * G.y0(b) / F.col("page_height")).cast("int") + F.floor(G.x0(b) / F.col("page_width")).cast("int")
    return blocks.join(ranked, [*AT, "panel_id"], "left").withColumn("reading_order", place)


def page_title(blocks: DataFrame, least: int = 20) -> DataFrame:
    """The likeliest title of each page; null below ``least`` points. Early, high, short and capitalised blocks score."""
    text = T.clean_text(F.col("text"))
    score = F.when(F.col("type") == "title", 30).otherwise(0) + T.points((F.col("seq") == 0, 15), (F.length(text).between(4, 80), 12), (text.rlike("^[A-Z0-9가-힣]"), 5), (text.rlike("[.!?]$"), -6), (T.digit_ratio(text) > 0.4, -15), (T.boilerplate(T.coverage_text(text)), -20))
    rows = blocks.withColumn("points", score)
    best = rows.groupBy(*AT).agg(F.max_by(F.struct(text.alias("t"), "points"), F.struct("points", -F.col("seq"))).alias("b"))
    return best.select(*AT, F.when(F.col("b.points") >= least, F.col("b.t")).alias("page_title"), F.col("b.points").alias("points"))


def rag_text(blocks: DataFrame) -> DataFrame:
    """Each page's text in structure order: titles, body, tables; repeated lines (by letters and digits) once."""
    key = T.normalized_key(F.col("text"))
    bucket = F.when(F.col("type") == "title", 0).when(F.col("type") == "table", 2).otherwise(1)
    rows = blocks.filter((F.col("type") != "footer") & (key != "")).withColumns({"bucket": bucket, "key": key})
    first = rows.withColumn("n", F.row_number().over(W.partitionBy(*AT, "key").orderBy("bucket", "seq"))).filter("n = 1")
    text = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kind, F.struct("seq", T.clean_text(F.col("text")).alias("t"))))), lambda x: x["t"]), "\n")
    parts = first.groupBy(*AT).agg(text(F.col("bucket") == 0).alias("a"), text(F.col("bucket") == 1).alias("b"), text(F.col("bucket") == 2).alias("c"))
    return parts.select(*AT, F.array_join(F.filter(F.array("a", "b", "c"), lambda x: x != ""), "\n\n").alias("rag_text"))


# --- operators whose next step depends on the blocks kept so far ---------------------------------------------------


def _key(text: str) -> str:
    return re.sub(r"[\W_]+", "", (text or "").lower())


def _area(b) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def _overlap(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return 0.0 if w <= 0 or h <= 0 else w * h / max(1e-9, min(_area(a), _area(b)))


def _same(a: str, b: str) -> bool:
    """Equal, contained in a long one, or alike to 92 %."""
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    return (len(short) >= 18 and short in long) or (len(short) >= 30 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.92)


def _per_page(blocks: DataFrame, step, schema: str) -> DataFrame:
    """``step`` over the rows of each page, which follow each other in a partition sorted by page; its tuples have ``schema``.

    Pages are a few rows each, so what a data frame of its own would cost for each is far more than the step.
    """
    row, kind = namedtuple("Block", blocks.columns), to_arrow_schema(_parse_datatype_string(schema))
    at = [blocks.columns.index(c) for c in AT]

    def run(batches):
        key, page, out = None, [], []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = [values[i] for i in at]
                if page and now != key:
                    out.extend(step(page))
                    page = []
                    if len(out) >= 2000:
                        yield _batch(out, kind)
                        out = []
                key = now
                page.append(row._make(values))
        if page:
            out.extend(step(page))
        if out:
            yield _batch(out, kind)

    return dealt(blocks, *AT).sortWithinPartitions(*AT).mapInArrow(run, schema)


def _batch(rows: list[tuple], kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


def _placed(rows: list) -> list:
    """From top to bottom, then from left to right."""
    return sorted(rows, key=lambda r: (r.bbox[1], r.bbox[0], r.seq))


_SLIM = "doc_id string, page_num int, seq int, type string, bbox array<double>, text string"


def deduplicated(blocks: DataFrame) -> DataFrame:
    """Blocks without those that repeat, by place and text, one kept before them; better sources and longer texts come first."""

    def step(rows: list) -> list[tuple]:
        rank = lambda s: 3 if s in ("native", "pdfplumber", "camelot") else 1 if s == "ocr" else 0
        kept: list = []
        keys: dict[int, str] = {}

        def key(r) -> str:
            if id(r) not in keys:
                keys[id(r)] = _key(r.text)
            return keys[id(r)]

        for r in sorted(rows, key=lambda r: (-rank(r.source), -len(r.text), r.seq)):
            x0, y0, x1, y1 = r.bbox[:4]
            near = (k for k in kept if k.bbox[0] < x1 and x0 < k.bbox[2] and k.bbox[1] < y1 and y0 < k.bbox[3])
            if not any(_overlap(r.bbox, k.bbox) >= 0.5 and (_same(key(r), key(k)) or len(key(r)) < 12) for k in near):
                kept.append(r)
        return [tuple(r[:6]) for r in kept]

    return _per_page(blocks.select("doc_id", "page_num", "seq", "type", "bbox", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source")), step, _SLIM)


def distinct_texts(blocks: DataFrame) -> DataFrame:
    """Blocks whose text is not the same as, within, or nearly one kept before on the page."""

    def step(rows: list) -> list[tuple]:
        kept: list[str] = []
        chosen = []
        for r in sorted(rows, key=lambda r: r.seq):
            key = _key(r.text)
            if key and not any(_same(key, k) for k in kept):
                kept.append(key)
                chosen.append(tuple(r))
        return chosen

    return _per_page(blocks.select("doc_id", "page_num", "seq", "type", "bbox", F.coalesce("text", F.lit("")).alias("text")), step, _SLIM)


def merged_paragraphs(blocks: DataFrame, gap: float = 16.0, drift: float = 40.0, most: int = 1200) -> DataFrame:
    """Neighbouring text blocks joined while the gap to the growing box stays small; titles and other types end a paragraph."""

    def step(rows: list) -> list[tuple]:
        out: list[list] = []
        for row in _placed(rows):
            last = out[-1] if out else None
            if last and row.type == last[3] == "text" and -2.0 <= row.bbox[1] - last[4][3] <= gap and abs(row.bbox[0] - last[4][0]) <= drift and len(last[5]) + len(row.text) <= most:
                b = last[4]
                last[4] = [min(b[0], row.bbox[0]), min(b[1], row.bbox[1]), max(b[2], row.bbox[2]), max(b[3], row.bbox[3])]
                last[5] += "\n" + row.text
            else:
                out.append([row.doc_id, row.page_num, row.seq, row.type, list(row.bbox), row.text])
        return [tuple(x) for x in out]

    return _per_page(blocks.select("doc_id", "page_num", "seq", "type", "bbox", F.coalesce("text", F.lit("")).alias("text")), step, _SLIM)


def clustered(blocks: DataFrame, dx: float = 30.0, dy: float = 24.0) -> DataFrame:
    """``cluster``: each block joins the first cluster whose growing box is within reach, else begins one."""

    def step(rows: list) -> list[tuple]:
        boxes: list[list[float]] = []
        out = []
        for r in _placed(rows):
            b = r.bbox
            at = next((i for i, c in enumerate(boxes) if b[0] - c[2] <= dx and c[0] - b[2] <= dx and b[1] - c[3] <= dy and c[1] - b[3] <= dy), None)
            if at is None:
                boxes.append(list(b))
                at = len(boxes) - 1
            else:
                c = boxes[at]
                boxes[at] = [min(b[0], c[0]), min(b[1], c[1]), max(b[2], c[2]), max(b[3], c[3])]
            out.append((r.doc_id, r.page_num, r.seq, at))
        return out

    return _per_page(blocks.select("doc_id", "page_num", "seq", "bbox"), step, "doc_id string, page_num int, seq int, cluster int")


def lines_by_height(blocks: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """``line``: blocks whose centre is within ``tolerance`` of the running mean of the line so far."""

    def step(rows: list) -> list[tuple]:
        out, mean, n, line = [], None, 0, -1
        for y, _, r in sorted(((r.bbox[1] + r.bbox[3]) / 2, r.seq, r) for r in rows):
            if mean is None or abs(y - mean) > tolerance:
                line, mean, n = line + 1, y, 1
            else:
                mean, n = (mean * n + y) / (n + 1), n + 1
            out.append((r.doc_id, r.page_num, r.seq, line))
        return out

    return _per_page(blocks.select("doc_id", "page_num", "seq", "bbox"), step, "doc_id string, page_num int, seq int, line int")


def absorbed_fragments(blocks: DataFrame, tiny: int = 8, reach: float = 60.0) -> DataFrame:
    """Tiny texts appended to the nearest other text within ``reach``; those without one stay."""

    def step(page: list) -> list[tuple]:
        rows = [[r.seq, r.type, list(r.bbox), r.text] for r in sorted(page, key=lambda r: r.seq)]
        hosts = [r for r in rows if r[1] == "text" and len(r[3].strip()) >= tiny]
        out = []
        for r in rows:
            if r[1] == "text" and len(r[3].strip()) < tiny and hosts:
                gap = lambda h, r=r: max(0, h[2][1] - r[2][3], r[2][1] - h[2][3]) + max(0, h[2][0] - r[2][2], r[2][0] - h[2][2])
                best = min(hosts, key=lambda h: (gap(h), h[0]))
                if gap(best) < reach:
                    best[3] = f"{best[3]} {r[3].strip()}"
                    best[2] = [min(best[2][0], r[2][0]), min(best[2][1], r[2][1]), max(best[2][2], r[2][2]), max(best[2][3], r[2][3])]
                    continue
            out.append(r)
        return [(page[0].doc_id, page[0].page_num, *r) for r in out]

    return _per_page(blocks.select("doc_id", "page_num", "seq", "type", "bbox", F.coalesce("text", F.lit("")).alias("text")), step, _SLIM)


# What the lines of plain documents look like.
_LIST_MARK = re.compile(r"^(?:[-•*·▪○●◦]|\(?\d{1,2}[.)]|[①-⑳]|[가-하][.)])\s+")
_META_LINE = re.compile(r"^(?:date|from|to|subject|author|version|작성일|작성자|수신|발신|제목|문서번호)\s*[:：]", re.IGNORECASE)
_HEADER_LINE = re.compile(r"^(?:#{1,6}\s+|(?:제\s*\d+\s*[장절조])|(?:\d+(?:\.\d+){0,3}\.?\s+[^\W\d_])|(?:chapter|section)\s+\d+|[IVX]+\.\s)", re.IGNORECASE)


def line_kind(line: str) -> str:
    """header, meta, blank, table, list, data or body."""
    bare = line.strip()
    if not bare:
        return "blank"
    if len(bare) <= 80 and _HEADER_LINE.match(bare):
        return "header"
    if _META_LINE.match(bare):
        return "meta"
    cells = [c for c in re.split(r"\s*\|\s*|\t|\s{2,}", bare) if c]
    if len(cells) >= 3:
        return "table"
    if _LIST_MARK.match(bare):
        return "list"
    if len(cells) == 2 and re.search(r"\d", cells[1]):
        return "data"
    return "body"


def structured_text(pages: DataFrame, most: int = 1200) -> DataFrame:
    """Blocks of plain text by a line-state machine: each change of kind ends the open block; tables need two stable rows, else they are text."""

    def step(rows: list) -> list[tuple]:
        out: list[tuple[str, str]] = []
        doc, page = rows[0].doc_id, rows[0].page_num
        kind, lines = "", []

        def flush() -> None:
            if lines:
                name = {"header": "title", "meta": "text", "list": "text", "body": "text"}.get(kind, kind)
                if kind in ("table", "data"):
                    widths = [len([c for c in re.split(r"\s*\|\s*|\t|\s{2,}", x.strip()) if c]) for x in lines]
                    common = max(set(widths), key=widths.count)
                    name = "table" if len(lines) >= 2 and sum(abs(w - common) <= 1 for w in widths) / len(widths) >= 0.7 else "text"
                out.append((name, "\n".join(lines)))
                lines.clear()

        for row in rows:
            for line in (row.text or "").split("\n"):
                now = line_kind(line)
                if now != kind or now == "header" or sum(map(len, lines)) + len(line) > most:
                    flush()
                kind = now
                if now != "blank":
                    lines.append(line.strip())
        flush()
        return [(doc, page, i, t, x) for i, (t, x) in enumerate(out)]

    return _per_page(pages.select("doc_id", "page_num", "text"), step, "doc_id string, page_num int, seq int, type string, text string")


def cover_labels(blocks: DataFrame, first: int = 8) -> DataFrame:
    """Roles of the first blocks of page 1: title, date, organisation or cover."""
    order = W.partitionBy("doc_id").orderBy("seq")
    text = F.trim("text")
    role = F.when(text.rlike(r"\d{4}[.\-/년]\s*\d{1,2}"), "date").when(F.col("n") == 1, "cover_title").when(F.length(text) <= 20, "cover_label").otherwise("cover")
    return blocks.filter("page_num = 1").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= first).select("doc_id", "seq", "n", role.alias("cover_role"))
