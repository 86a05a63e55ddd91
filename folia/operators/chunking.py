"""Chunks from blocks: text groups with the support of visuals, fallbacks, and the page-native baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia import schemas as S
from folia.functions import keys as K
from folia.functions import text as T

from .splitting import split_text

#: Characters of a flow of text blocks before a new group starts.
FLOW_CHARS = 950

_OPTIONAL = {
    "string": ("slide_role", "summary_role", "dashboard_role", "panel_kind", "visual_role", "exclude_reason", "summary_priority", "panel_id", "region_id", "dashboard_region_id", "associated_title", "meta_page_title", "table_summary", "table_markdown", "chart_summary", "visual_summary", "caption_text", "block_id"),
    "boolean": ("summary_exclude", "rag_exclude"), "int": ("rag_order", "panel_order", "reading_order"), "array<string>": ("context_ids",), "array<double>": ("bbox",), "array<struct<item:string,values:string>>": ("key_value_rows",),
}


def completed(blocks: DataFrame) -> DataFrame:
    """``blocks`` with every column of the block table, null where the source has none, and a block id."""
    missing = {c: F.lit(None).cast(kind) for kind, names in _OPTIONAL.items() for c in names if c not in blocks.columns}
    blocks = blocks.withColumns(missing) if missing else blocks
    return blocks.withColumn("block_id", K.block_id(F.col("block_id"), F.col("type"), F.concat_ws(",", F.col("bbox").cast("array<string>"), F.col("page_num").cast("string"), F.col("seq").cast("string")), F.col("text")))


def panel_key() -> Column:
    return T.truthy(F.col("panel_id"), F.col("region_id"), F.col("dashboard_region_id"))


def excluded() -> Column:
    """Blocks that never become text: flagged ones, footers, page numbers, decoration."""
    role, kind = F.lower(F.coalesce(T.truthy(F.col("slide_role"), F.col("summary_role"), F.col("dashboard_role")), F.lit(""))), F.lower(F.coalesce(T.truthy(F.col("panel_kind"), F.col("visual_role")), F.lit("")))
    reason = F.lower(F.coalesce("exclude_reason", F.lit("")))
    flagged = F.coalesce("summary_exclude", F.lit(False)) | F.coalesce("rag_exclude", F.lit(False))
    return flagged | (F.col("type") == "footer") | role.isin(*S.EXCLUDED_ROLES) | kind.isin(*S.EXCLUDED_KINDS) | kind.contains("decorative") | T.contains_any(reason, ("decorative", "footer", "page_number", "empty_table_geometry"))


def order() -> Column:
    """The order of blocks on a page."""
    return F.struct(
        F.coalesce("rag_order", F.lit(9999)).alias("a"), F.coalesce("panel_order", F.lit(9999)).alias("b"), F.coalesce("reading_order", F.lit(999999)).alias("c"),
        F.coalesce(F.get("bbox", F.lit(1)), F.lit(0.0)).alias("d"), F.coalesce(F.get("bbox", F.lit(0)), F.lit(0.0)).alias("e"), F.col("seq").alias("f"),
    )


def support_parts() -> Column:
    """What a visual has to say: its summaries, caption, longer Markdown and key values."""
    md = T.clean_text(F.col("table_markdown"))
    texts = [F.nullif(T.clean_text(F.col(c)), F.lit("")) for c in ("table_summary", "chart_summary", "visual_summary", "caption_text")]
    rows = F.filter(F.transform(F.slice("key_value_rows", 1, 8), lambda r: F.trim(F.concat(T.clean_text(r["item"]), F.lit(": "), T.clean_text(r["values"])))), lambda x: x != ":")
    lines = F.when(F.size("key_value_rows") >= 3, F.nullif(F.array_join(rows, "\n"), F.lit("")))
    return F.array_compact(F.array(*texts, F.when(F.length(md) >= 90, md), lines))


def support_score(text: Column) -> Column:
    """How well a visual may back a text, from ``text``, its joined ``support_parts``: length, sentences, metrics and rows, less for contact details."""
    return T.let(text, _support_score)


def _support_score(text: Column) -> Column:
    rows, md = F.coalesce(F.size("key_value_rows"), F.lit(0)), T.clean_text(F.col("table_markdown"))
    tabular = T.step(rows, (4, 2), (2, 1)) + F.when((F.regexp_count(md, F.lit("\n")) >= 3) | (F.regexp_count(md, F.lit(r"\|")) >= 8), 1).otherwise(0)
    other = F.when(T.truthy(T.clean_text(F.col("chart_summary")), T.clean_text(F.col("visual_summary")), T.clean_text(F.col("caption_text"))).isNotNull(), 1).otherwise(0)

    def total(m: Column) -> Column:
        contact = (F.length(text) <= 220) & (T.contact_signals(text) >= 1) & (T.count_if(T.lines(text), lambda x: x.contains(":") | x.contains("|")) >= 1) & (m["s"] == 0) & (m["k"] <= 2)
        score = T.step(F.length(text), (120, 2), (70, 1)) + T.step(m["s"], (2, 2), (1, 1)) + T.step(m["k"], (4, 2), (2, 1))
        return score + F.when(F.col("type") == "table", tabular).otherwise(other) + T.points((contact, -4), (F.length(text) < 45, -2))

    counts = F.struct(T.sentence_ends(text).alias("s"), T.metric_like(text).alias("k"))
    return F.when(text == "", 0).otherwise(T.let(counts, total)).cast("int")


def labelled_support() -> Column:
    """The visual's texts under their labels, repeated ones once."""
    named = [F.when(T.clean_text(F.col(c)) != "", F.struct(F.lit(f"[{label}]\n").alias("label"), T.clean_text(F.col(c)).alias("text"))) for c, label in (("table_summary", "TABLE SUMMARY"), ("table_markdown", "TABLE"), ("chart_summary", "CHART SUMMARY"), ("visual_summary", "VISUAL SUMMARY"), ("caption_text", "CAPTION"))]
    shown = F.transform(T.distinct_by(F.array_compact(F.array(*named)), lambda x: T.squeezed(x["text"])), lambda x: F.concat(x["label"], x["text"]))
    rows = F.filter(F.transform(F.slice("key_value_rows", 1, 20), lambda r: F.concat(F.lit("- "), T.clean_text(r["item"]), F.lit(": "), T.clean_text(r["values"]))), lambda x: x != "- : ")
    values = F.when(F.size(rows) > 0, F.array(F.concat(F.lit("[KEY VALUES]\n"), F.array_join(rows, "\n")))).otherwise(F.array().cast("array<string>"))
    return F.concat(shown, F.coalesce(values, F.array().cast("array<string>")))


def flow_keys(items: Column, flow_chars: int = FLOW_CHARS) -> Column:
    """The group key of each of a page's text ``items`` (panel, n characters), in their order.

    Blocks of a panel form one group wherever they stand. Others flow: a flow ends at
    a panel's block, or when it and the next text would exceed ``flow_chars``. The
    running length restarts with each flow, so the items are folded.
    """
    start = F.struct(F.lit(0).alias("flow"), F.lit(False).alias("open"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        in_panel = x["panel"].isNotNull()
        full = acc["open"] & (acc["length"] + x["n"] > flow_chars)
        new = ~in_panel & (~acc["open"] | full)
        flow = F.when(new, acc["flow"] + 1).otherwise(acc["flow"])
        joined = F.when(new | (acc["length"] == 0), x["n"]).when(x["n"] == 0, acc["length"]).otherwise(acc["length"] + 2 + x["n"])
        key = F.when(in_panel, x["panel"]).otherwise(F.concat(F.lit("text_flow:"), flow.cast("string")))
        return F.struct(flow.cast("int").alias("flow"), (~in_panel).alias("open"), F.when(in_panel, 0).otherwise(joined).cast("int").alias("length"), F.concat(acc["out"], F.array(key)).alias("out"))

    return F.aggregate(items, start, add, lambda a: a["out"])


def anchor_groups(text_blocks: DataFrame, flow_chars: int = FLOW_CHARS) -> DataFrame:
    """``text_blocks`` (doc_id, page_num, block_id, text, panel, order) with ``group_key``, by ``flow_keys``; a page's blocks are shuffled once. Blocks of no page have no group."""
    at, own = ["doc_id", "page_num"], [c for c in text_blocks.columns if c not in ("doc_id", "page_num", "block_id")]
    item = F.struct("order", "block_id", "panel", F.length(T.clean_text(F.col("text"))).alias("n"), *(c for c in own if c not in ("order", "panel")))
    pages = text_blocks.dropna(subset=at).groupBy(*at).agg(F.array_sort(F.collect_list(item)).alias("items"))
    placed = pages.select(*at, F.explode(F.arrays_zip("items", flow_keys(F.col("items"), flow_chars).alias("keys"))).alias("z"))
    return placed.select(*at, F.col("z.items.block_id").alias("block_id"), *(F.col(f"z.items.{c}").alias(c) for c in own), F.col("z.keys").alias("group_key"))


def composed(anchor: Column, support: Column) -> Column:
    """``struct(retrieval, display)`` of an ``anchor`` and its ``support`` (array of score, size, text): the best two
    supports that reach the threshold are shown; a very short anchor is retrieved with the best one only."""
    best = F.slice(F.reverse(F.array_sort(support)), 1, 2)
    admitted = F.transform(F.filter(best, lambda s: (s["text"] != "") & (s["score"] >= F.when(F.length(anchor) < 120, 5).otherwise(4))), lambda s: s["text"])
    shown = lambda texts: F.array_join(F.filter(F.concat(F.array(anchor), texts), lambda t: t != ""), "\n\n")
    return T.let(admitted, lambda texts: F.struct(shown(F.when(F.length(anchor) < 60, F.slice(texts, 1, 1)).otherwise(texts)).alias("retrieval"), shown(texts).alias("display")))


def _page_groups(items: Column) -> Column:
    """A page's text groups as chunks: a group's texts, and the supports of its panel or that name a block of it as context."""

    def group(key: Column, texts: Column, keys: Column) -> Column:
        parts = F.filter(texts, lambda x, i: F.get(keys, i) == key)
        facts = lambda p: F.struct(p.alias("parts"), F.transform(p, lambda x: x["block_id"]).alias("ids"), F.array_join(F.filter(F.transform(p, lambda x: x["text"]), lambda t: t != ""), "\n\n").alias("anchor"))
        return T.let(T.let(parts, facts), lambda g: T.let(backing(g), lambda support: chunk(g, support)))

    def backing(g: Column) -> Column:
        def admitted(s: Column) -> Column:
            named = F.coalesce(F.exists(s["context_ids"], lambda c: F.coalesce(F.array_contains(g["ids"], c), F.lit(False))), F.lit(False))
            near = F.coalesce(F.exists(g["parts"], lambda p: F.coalesce(p["panel"] == s["panel"], F.lit(False))), F.lit(False))
            return (named | near) & (s["score"] >= F.when(named, 4).otherwise(6) + F.when(F.length(g["anchor"]) < 120, 1).otherwise(0))

        found = F.filter(items, lambda s: s["score"].isNotNull() & admitted(s))
        return F.transform(found, lambda s: F.struct(s["score"].alias("score"), F.length(s["support_text"]).alias("size"), s["support_text"].alias("text"), s["block_id"].alias("support_id")))

    def chunk(g: Column, support: Column) -> Column:
        several = (F.size(g["ids"]) > 1) | (F.size(support) > 0)
        short = (F.length(g["anchor"]) < 24) & ~several
        texts = F.when(~short, composed(g["anchor"], support))
        return T.let(texts, lambda t: _chunk(F.get(g["parts"], F.lit(0))["order"], 0, F.when(several, "block_group").otherwise("text"), t["retrieval"], t["display"], F.concat(g["ids"], F.transform(support, lambda s: s["support_id"]))))

    texts = F.filter(items, lambda x: x["is_text"])
    made = T.let(texts, lambda ts: T.let(flow_keys(ts), lambda keys: F.transform(F.array_distinct(keys), lambda key: group(key, ts, keys))))
    return F.filter(made, lambda c: c["retrieval"] != "")


def _chunk(first: Column, kind: int, chunk_type: Column, retrieval: Column, display: Column, sources: Column) -> Column:
    return F.struct(first.alias("first"), F.lit(kind).alias("kind"), chunk_type.alias("chunk_type"), retrieval.alias("retrieval"), display.alias("display"), sources.alias("sources"))


def _page_instead(items: Column, rag_text: Column, no_order: Column) -> Column:
    """The chunks of a page without text groups: its own text, else its blocks' texts, else visuals that say enough by themselves."""
    said = F.array_sort(F.transform(items, lambda x: F.struct(x["order"].alias("order"), F.concat(F.when(x["text"] != "", F.array(x["text"])).otherwise(F.array().cast("array<string>")), x["labelled"]).alias("said"), x["block_id"].alias("block_id"))))

    def page(said: Column) -> Column:
        text = F.coalesce(T.truthy(T.clean_text(rag_text), F.array_join(F.flatten(F.transform(said, lambda s: s["said"])), "\n\n")), F.lit(""))
        ids = F.coalesce(F.transform(said, lambda s: s["block_id"]), F.array().cast("array<string>"))
        return T.let(text, lambda t: F.when(t != "", F.array(_chunk(no_order, 1, F.lit("page"), t, t, ids))).otherwise(visuals))

    telling = lambda x: (x["score"] >= 7) & ~((F.length(x["support_text"]) < 120) & (T.metric_like(x["support_text"]) < 4) & (T.sentence_ends(x["support_text"]) < 2))
    visuals = F.transform(F.filter(items, telling), lambda x: _chunk(x["order"], 2, F.when(x["type"] == "table", "table_summary").otherwise("chart_summary"), x["support_text"], x["support_text"], F.array(x["block_id"])))
    return T.let(said, page)


def text_first_chunks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The main strategy's chunks from ``blocks`` and ``pages`` (doc_id, page_num, rag_text, page_title).

    Per page: the text groups with their support; a page without any falls back to
    its own text, then to its blocks' texts; one without those to visuals that say
    enough by themselves. Long texts are split; chunks are numbered per document.
    A page's blocks are gathered in one row, so blocks are read and shuffled once.
    """
    at = ["doc_id", "page_num"]
    is_text, visual = F.col("type").isin(*S.TEXT_TYPES), F.col("type").isin(*S.TABLE_TYPES, *S.VISUAL_TYPES)
    ready = completed(blocks).withColumns({"panel": panel_key(), "order": order()}).filter(~excluded()).dropna(subset=at)
    told = F.coalesce("table_summary", "table_markdown", "chart_summary", "visual_summary", "caption_text").isNotNull() | F.col("key_value_rows").isNotNull()  # else the lambdas below have nothing to find
    ready = ready.withColumn("support_text", F.when(visual & told, F.array_join(support_parts(), "\n\n")))
    supports = F.col("support_text") != ""
    text = F.when(F.col("type").isin(*S.TEXT_TYPES, *S.TABLE_TYPES), T.clean_text(F.col("text")))
    rows = ready.select(
        *at, "order", "block_id", "panel", F.coalesce(F.length(text), F.lit(0)).alias("n"), F.coalesce(is_text, F.lit(False)).alias("is_text"), "type", text.alias("text"),
        F.when(supports, F.col("support_text")).alias("support_text"), F.when(supports, support_score(F.col("support_text"))).alias("score"), F.when(supports, F.col("context_ids")).alias("context_ids"), F.when(told, labelled_support()).otherwise(F.array().cast("array<string>")).alias("labelled"),
    )
    items = rows.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct(*(c for c in rows.columns if c not in at)))).alias("items"))
    both = pages.select(*at, "rag_text", "page_title", F.lit(True).alias("parsed")).join(items, at, "full")
    no_order = F.lit(None).cast(dict(rows.dtypes)["order"])
    instead = F.when(F.col("parsed"), _page_instead(F.col("items"), F.col("rag_text"), no_order))
    chunks = T.let(_page_groups(F.col("items")), lambda groups: F.when(F.size(groups) > 0, groups).otherwise(instead))
    return numbered(both.select(*at, "page_title", F.explode(chunks).alias("c")).select(*at, "c.*", "page_title"), S.MAIN_STRATEGY)


def native_chunks(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """The baseline's chunks: each page's own text, then each block's."""
    at = ["doc_id", "page_num"]
    whole = pages.filter(T.clean_text(F.col("rag_text")) != "").select(*at, F.lit(-1).alias("seq"), F.lit("native_page").alias("chunk_type"), T.clean_text(F.col("rag_text")).alias("retrieval"), F.array().cast("array<string>").alias("sources"), "page_title")
    ready = completed(blocks)
    said = F.concat_ws("\n\n", *(F.nullif(T.clean_text(F.col(c)), F.lit("")) for c in ("text", "table_summary", "table_markdown", "chart_summary", "visual_summary", "caption_text")))
    single = ready.select(*at, "seq", F.coalesce("type", F.lit("text")).alias("chunk_type"), said.alias("retrieval"), F.array(F.col("seq").cast("string")).alias("sources")).filter("retrieval <> ''").join(pages.select(*at, "page_title"), at, "left")
    both = whole.unionByName(single).withColumn("display", F.col("retrieval")).withColumns({"first": F.col("seq"), "kind": F.lit(0)}).drop("seq")
    return numbered(both, S.BASELINE_STRATEGY, hard=1350)


def numbered(groups: DataFrame, strategy: str, hard: int = 1400) -> DataFrame:
    """Split texts, numbered from 1 per document in page and block order, as chunk rows."""
    parts = groups.select("*", F.posexplode(split_text(F.col("retrieval"), hard=hard)).alias("split_index", "part"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("page_num", "kind", "first", "sources", "split_index"))
    rows = parts.withColumn("chunk_index", place)
    shown = F.when(F.col("split_index") == 0, F.col("display")).otherwise(F.col("part"))
    return rows.select(
        K.chunk_id(F.col("doc_id"), F.lit(strategy), F.col("page_num"), F.col("chunk_index"), F.col("chunk_type"), F.col("sources")).alias("chunk_id"), F.lit(strategy).alias("strategy_name"), "doc_id", "page_num", "chunk_index", "chunk_type",
        "page_title", F.col("page_title").alias("section_title"), F.col("sources").alias("source_block_ids"), "split_index", F.col("part").alias("retrieval_text"), shown.alias("display_text"), F.substring(shown, 1, 500).alias("evidence_preview"),
        (F.trim("part") != "").alias("has_text"), F.length("part").alias("char_len"), F.when(F.trim("part") == "", 0).otherwise(T.chunk_tokens(F.col("part"))).alias("token_estimate"),
    )


def sparse_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page_num, sparse: little text of its own, or few texts beside visuals."""
    ready = completed(blocks).filter(~excluded())
    text, visual = F.col("type").isin(*S.TEXT_TYPES), F.col("type").isin(*S.VISUAL_TYPES)
    seen = ready.groupBy("doc_id", "page_num").agg(F.count_if(text).alias("t"), F.count_if(visual).alias("v"), F.count_if(text & F.col("text").rlike(r"\d")).alias("n"))
    joined = pages.join(seen, ["doc_id", "page_num"], "left").fillna(0, ["t", "v", "n"])
    return joined.select("doc_id", "page_num", ((F.length(T.clean_text(F.col("rag_text"))) < 80) | ((F.col("t") <= 2) & (F.col("v") >= 1)) | ((F.col("n") >= 1) & (F.col("t") <= 4) & (F.col("v") >= 1))).alias("sparse"))


def table_records(blocks: DataFrame) -> DataFrame:
    """Visual records of tables that say enough, numbered over all tables of their page."""
    numbered_tables = completed(blocks).filter("type = 'table'").withColumn("visual_index", F.row_number().over(W.partitionBy("doc_id", "page_num").orderBy(order())))
    summary, md = T.clean_text(F.col("table_summary")), T.clean_text(F.coalesce("table_markdown", "text"))
    both = F.array_join(F.filter(F.array(summary, md), lambda t: t != ""), "\n\n")
    signal = F.aggregate(F.slice(F.coalesce("key_value_rows", F.array().cast("array<struct<item:string,values:string>>")), 1, 8), F.lit(0), lambda a, r: a + F.when((T.clean_text(r["item"]) != "") & (T.clean_text(r["values"]) != ""), 2).when((T.clean_text(r["item"]) != "") | (T.clean_text(r["values"]) != ""), 1).otherwise(0))
    headers = F.size(F.split(F.get(F.split(md, "\n"), F.lit(0)), r"\|"))

    def score(m: Column) -> Column:
        total = T.step(F.length(m["both"]), (120, 2), (70, 1)) + T.step(m["metrics"], (4, 2), (2, 1)) + T.step(m["signal"], (4, 2), (2, 1))
        return total + T.points(((T.char_count(md, r"\|") >= 10) | (T.char_count(md, "\n") >= 4), 1), (headers >= 2, 1), (T.visual_contactish(m["both"]), -4), ((F.length(m["both"]) < 45) & (m["signal"] < 2), -2))

    measured = T.let(both, lambda x: F.struct(x.alias("both"), F.size(T.metric_tokens(x)).alias("metrics"), signal.alias("signal")))
    kept = numbered_tables.filter(~excluded()).withColumn("gate", T.let(measured, score)).filter("gate >= 4")
    return kept.select("doc_id", "page_num", "block_id", F.lit("table").alias("visual_type"), "visual_index", "gate", both.alias("retrieval_text"), F.lit(0.72).alias("visual_confidence"))


def chart_records(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Visual records of charts and images whose text and context carry metrics and periods."""
    at = ["doc_id", "page_num"]
    ready = completed(blocks).withColumn("order", order())
    visuals = ready.filter(F.col("type").isin(*S.VISUAL_TYPES) & ~excluded()).withColumn("visual_index", F.row_number().over(W.partitionBy(*at).orderBy("order")))
    named = visuals.select(*at, F.col("block_id").alias("visual"), F.explode("context_ids").alias("block_id")).join(ready.select(*at, "block_id", "order", T.clean_text(F.col("text")).alias("said")), [*at, "block_id"])
    context = named.groupBy(*at, F.col("visual").alias("block_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "said"))), lambda x: x["said"]), "\n\n").alias("near"))
    chart = F.array_join(F.filter(F.array(*(T.clean_text(F.col(c)) for c in ("chart_summary", "visual_summary", "caption_text", "text"))), lambda t: t != ""), "\n\n")
    rows = visuals.join(context, [*at, "block_id"], "left").join(pages.select(*at, "rag_text"), at, "left").withColumn("chart", chart)
    rows = rows.withColumn("both", F.array_join(F.filter(F.array("chart", F.coalesce("near", F.substring(T.clean_text(F.col("rag_text")), 1, 900))), lambda t: t != ""), "\n\n"))

    def score(e: Column) -> Column:
        metrics, periods, labels = e["metrics"], e["periods"], e["labels"]
        total = T.step(F.length("chart"), (80, 2), (1, 1)) + T.step(metrics, (4, 2), (2, 1)) + T.step(periods, (2, 2), (1, 1))
        return total + T.points((labels >= 2, 1), (F.length("both") >= 140, 1), (T.visual_contactish(F.col("both")), -4), ((metrics <= 1) & (periods == 0), -3), ((labels >= 4) & (metrics == 0) & (periods == 0), -3))

    kept = rows.withColumn("gate", T.let(T.evidence(F.col("both")), score)).filter("gate >= 4")
    trend = T.trend(T.metric_tokens(F.col("both")), T.period_tokens(F.col("both")), F.col("both"))
    return kept.select(*at, "block_id", F.lit("chart").alias("visual_type"), "visual_index", "gate", F.col("both").alias("retrieval_text"), F.lit(0.64).alias("visual_confidence"), trend.alias("trend"))


def chart_like_pages(pages: DataFrame, blocks: DataFrame, charts: DataFrame) -> DataFrame:
    """A record for each page without chart records that reads like a chart page."""
    at = ["doc_id", "page_num"]
    visual = completed(blocks).filter(F.col("type").isin(*S.VISUAL_TYPES)).select(*at).distinct().withColumn("has_visual", F.lit(True))
    rows = pages.join(charts.select(*at).distinct(), at, "left_anti").join(visual, at, "left").withColumn("said", T.clean_text(F.coalesce("rag_text", "text")))
    seen = F.coalesce("has_visual", F.lit(False))
    rows = rows.withColumn("hint", T.contains_any(F.lower("said"), T.CHART_WORDS))
    hint = F.col("hint")

    def score(e: Column) -> Column:
        total = T.step(e["metrics"], (6, 3), (4, 2)) + T.step(e["periods"], (2, 2), (1, 1))
        return total + T.points((e["labels"] >= 3, 1), (F.length("said") >= 220, 1), (hint, 1), (T.visual_contactish(F.col("said")), -4))

    kept = rows.withColumn("gate", F.when(hint | seen, T.let(T.evidence(F.col("said")), score))).filter("gate >= 5")  # one condition: apart, the second would come first
    return kept.select(*at, F.lit("chart_like_page").alias("visual_type"), "gate", F.substring("said", 1, 1600).alias("retrieval_text"), F.when(hint, 0.58).otherwise(0.48).alias("visual_confidence"))


def unpivoted(tables: DataFrame, row_cap: int = 24, cell_cap: int = 72, candidate: Column | None = None) -> DataFrame:
    """Row and cell records (table_id, record, row_label, column_label, value) of tables (table_id, headers, rows incl. header).

    Only tables that ``candidate`` admits and that have two or more data rows; the first rows and cells up to the caps.
    """
    tables = tables if candidate is None else tables.filter(candidate)
    rows = tables.filter(F.size("rows") >= 3).select("table_id", "headers", F.posexplode(F.slice("rows", 2, 1_000_000)).alias("row_index", "row"))
    label = F.coalesce(T.truthy(T.clean_text(F.get("row", F.lit(0)))), F.concat(F.lit("row_"), (F.col("row_index") + 1).cast("string")))
    cells = rows.withColumn("row_label", label).select("table_id", "headers", "row_index", "row_label", F.posexplode("row").alias("column_index", "value")).filter((F.col("column_index") > 0) & (T.clean_text(F.col("value")) != ""))
    column = F.coalesce(T.truthy(T.clean_text(F.get("headers", F.col("column_index")))), F.concat(F.lit("col_"), (F.col("column_index") + 1).cast("string")))
    cells = cells.select("table_id", "row_index", "column_index", "row_label", column.alias("column_label"), T.clean_text(F.col("value")).alias("value"))
    kept_cells = cells.withColumn("n", F.row_number().over(W.partitionBy("table_id").orderBy("row_index", "column_index"))).filter(F.col("n") <= cell_cap)
    pairs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "column_label", "value"))), lambda p: F.concat(p["column_label"], F.lit("="), p["value"])), "; ")
    by_row = cells.groupBy("table_id", "row_index", "row_label").agg(pairs.alias("value"))
    kept_rows = by_row.withColumn("n", F.row_number().over(W.partitionBy("table_id").orderBy("row_index"))).filter(F.col("n") <= row_cap)
    return kept_cells.select("table_id", F.lit("cell").alias("record"), "row_index", "column_index", "row_label", "column_label", "value").unionByName(
        kept_rows.select("table_id", F.lit("row").alias("record"), "row_index", F.lit(None).cast("int").alias("column_index"), "row_label", F.lit(None).cast("string").alias("column_label"), "value")
    )


def summary(chunks: DataFrame) -> DataFrame:
    """One row per document and strategy: counts, lengths, pages and empty texts."""
    return chunks.groupBy("doc_id", "strategy_name").agg(
        F.count("*").alias("total_chunks"), F.round(F.avg("char_len"), 2).alias("avg_char_len"), F.min("char_len").alias("min_char_len"), F.max("char_len").alias("max_char_len"),
        F.countDistinct("page_num").alias("page_coverage_count"), F.array_join(F.array_sort(F.collect_set("page_num")).cast("array<string>"), ",").alias("page_coverage"),
        F.count_if(F.trim("retrieval_text") == "").alias("empty_chunks"), F.sum("char_len").alias("total_chars"),
    )


def type_distribution(chunks: DataFrame) -> DataFrame:
    """Chunks by type within each document and strategy."""
    return chunks.groupBy("doc_id", "strategy_name", F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type")).agg(F.count("*").alias("n"))
