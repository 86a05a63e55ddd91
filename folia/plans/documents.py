"""Queries of whole pages, documents and answers, and their SQL. Importing it registers them with the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia import schemas
from folia.functions import geometry as G
from folia.functions import pagetext as P
from folia.functions import text as T
from folia.operators import answering, assembly, export, pages, retrieval, slides
from folia.plans import catalogue as C
from folia.plans import oracles as O
from folia.sources import files
from folia.sources import tables as S

query, blocks, docs, pages_of = C.query, C.blocks, C.docs, C.pages_of


def rich_blocks(spark, sf_dir) -> DataFrame:
    """The text blocks with meta fields by their number: priorities, titles, roles, exclusions, tables and charts."""
    seq = F.col("seq")
    kind = F.when(seq % 9 == 8, "chart").otherwise(F.col("type"))
    numbered = lambda word: F.concat(F.lit(word), seq.cast("string"))
    rows = blocks(spark, sf_dir).withColumn("type", kind)
    return rows.withColumns({
        "summary_priority": F.when(seq % 4 == 0, "high").when(seq % 4 == 1, "Medium").when(seq % 4 == 2, "low"), "associated_title": F.when(seq % 7 == 3, numbered("Section ")), "summary_exclude": seq % 11 == 5, "slide_role": F.when(seq % 13 == 4, "offpage_text_stream"),
        "exclude_reason": F.when(seq % 17 == 6, "page_number"), "table_summary": F.when(F.col("type") == "table", numbered("Table of ")), "table_markdown": F.when(F.col("type") == "table", F.col("text")), "chart_summary": F.when(F.col("type") == "chart", F.col("text")), "caption_text": F.when(F.col("type") == "chart", numbered("Figure ")),
    })


_RICH = f"""{C.BLOCKS_SQL.strip()}, r0 AS (SELECT * REPLACE (CASE WHEN seq % 9 = 8 THEN 'chart' ELSE type END AS type) FROM blocks),
    rich AS (SELECT *, CASE seq % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'Medium' WHEN 2 THEN 'low' END AS prio, CASE WHEN seq % 7 = 3 THEN 'Section ' || seq END AS assoc, seq % 11 = 5 AS excl, CASE WHEN seq % 13 = 4 THEN 'offpage_text_stream' END AS slide, CASE WHEN seq % 17 = 6 THEN 'page_number' END AS reason FROM r0)"""


def _tidy(c: str, limit: int = 0) -> str:
    flat = rf"array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce({c}, ''), '[ \t\r\f\v]+', ' ', 'g'), chr(10)), lambda y: {O.strip('y')}), lambda y: y <> ''), chr(10))"
    return flat if not limit else f"CASE WHEN length({flat}) > {limit} THEN {O.strip(f'substr({flat}, 1, {limit})')} || '...' ELSE {flat} END"


def _disclaimer(c: str) -> str:
    return O.any_of(f"replace(lower({c}), ' ', '')", P.DISCLAIMER)


def _compact(c: str, limit: int) -> str:
    """``P.compact`` of texts that have neither a report's running title nor a quarter heading."""
    return f"CASE WHEN {_disclaimer(c)} THEN '' ELSE {_tidy(c, limit)} END"


# --- lines and blocks ----------------------------------------------------------------------------------------------


@query(rf"""WITH {C.BLOCKS_SQL}, t AS (SELECT *, {O.strip('text')} AS s FROM blocks),
    v AS (SELECT *, lower(s) AS low, length(s) AS n, {O.found('s', '[a-zA-Z가-힣]')} AS letters, {O.words('s')} AS w, len(list_distinct(list_filter(string_split(replace(s, ' ', ''), ''), lambda x: x <> ''))) AS variety, {O.found('text', P.MEANING)} AS said, regexp_matches(text, '(?i)\d|%|bp|p\)') AS metric FROM t)
    SELECT doc_id, page_num, seq, {_disclaimer('text')} AS disclaimer, {O.any_of('lower(text)', P.CONTENTS)} AS contents, {_disclaimer('text')} OR ((said < 3 AND NOT metric) OR (length(text) <= 5 AND NOT metric)) AS weak,
      low IN ({', '.join(f"'{x}'" for x in P.NOISE_TEXTS)}) OR regexp_matches(low, '{P.NOISE_YEAR}') OR regexp_matches(low, '{P.NOISE_PHRASE}') OR (n <= 8 AND NOT regexp_matches(s, '[가-힣a-zA-Z]{{4,}}')) OR letters < 2 OR (n > 5 AND variety <= 2) OR (letters < n * 0.3 AND n < 40)
        OR (n <= 12 AND letters <= 6) OR (n <= 15 AND letters <= 3) OR (w <= 2 AND n <= 20 AND ({O.any_of('low', P.NOISE_TEXTS)} OR letters < 5)) AS noise FROM v""")
def block_predicates(spark, sf_dir):
    """Disclaimers, contents, weak texts and visual noise."""
    t = F.col("text")
    return blocks(spark, sf_dir).select("doc_id", "page_num", "seq", P.disclaimer(t).alias("disclaimer"), P.contents(t).alias("contents"), P.weak(F.col("type"), t, F.lit(None).cast("string"), F.lit(None).cast("string")).alias("weak"), P.visual_noise(t).alias("noise"))


_SHARE = lambda pattern: f"{O.found('s', pattern)} / n"


@query(rf"""WITH {C.BLOCKS_SQL}, t AS (SELECT *, {O.strip('text')} AS s, length({O.strip('text')}) AS n, x1 - x0 AS wd FROM blocks),
    m AS (SELECT *, {O.found('s', '[A-Za-z가-힣]')} AS letters, {O.found('s', '[0-9]{1,2}/[0-9]{1,2}')} AS ticks, length(s) - length(replace(s, '|', '')) AS bars, {O.found('s', '[0-9]')} + {O.found('s', '[|%+,./-]')} AS figures,
      {_SHARE('[A-Za-z가-힣]')} AS alpha, {_SHARE('[0-9]')} AS digits, {_SHARE('[|%+,./()-]')} AS symbols, regexp_matches(s, '^\[[^\]\n]{{1,24}}\]\s*\S') AS topic FROM t),
    f AS (SELECT *, n <= 32 AND regexp_matches(s, '\d') AND regexp_matches(s, '(?i)[%+-]|bp|bps|x\b') AND (wd >= 12.0 OR n >= 4) AS value_ FROM m)
    SELECT doc_id, page_num, seq, concat_ws(',', CASE WHEN value_ THEN 'metric_value' END, CASE WHEN topic THEN 'topic_start' END, CASE WHEN topic OR (n <= 80 AND regexp_matches(s, '^[A-Za-z][A-Za-z0-9 /&-]{{1,40}}:$')) THEN 'issue_box' END,
      CASE WHEN regexp_matches(s, '^\d{{1,2}}[.)]\s+\S') OR regexp_matches(s, '^[*-]\s+\S') THEN 'ranking' END, CASE WHEN (bars >= 1 AND wd > 595 * 0.12) OR {O.found('s', '(?i)' + chr(92) + 'b[0-9]{1,2}[QH][0-9]{2,4}[A-Z]?' + chr(92) + 'b')} >= 2 OR {O.found('s', '(?i)' + chr(92) + 'b(?:1D|1W|1M|3M|6M|12M)' + chr(92) + 'b')} >= 2 THEN 'mini_table' END,
      CASE WHEN regexp_matches(s, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}') OR regexp_matches(s, '(?:\+?\d{{1,3}}[-.\s]?)?\(?\d{{2,4}}\)?[-.\s]?\d{{2,4}}[-.\s]?\d{{2,4}}') THEN 'contact' END, CASE WHEN ticks >= 1 AND n <= 36 THEN 'axis_tick' END,
      CASE WHEN (n <= 22 AND regexp_matches(s, '^\([^)]{{1,18}}\)\s*$')) OR (n <= 12 AND symbols >= 0.2 AND digits < 0.35) THEN 'unit_label' END, CASE WHEN NOT value_ AND regexp_matches(s, '^[\d.,%+-]{{1,5}}$') AND wd < 18 THEN 'tiny_numeric' END,
      CASE WHEN bars >= 2 OR ticks >= 2 OR (ticks >= 1 AND n <= 40) OR (n <= 20 AND regexp_matches(s, '^\([^)]+\)\s*$')) OR (n < 52 AND figures >= 0.5 * n AND letters < greatest(6, n // 5)) THEN 'debris' END,
      CASE WHEN NOT (n <= 3 AND digits >= 0.34) AND NOT (digits >= 0.62 AND alpha < 0.18) THEN 'context' END, CASE WHEN regexp_matches(s, '[.。?？!！;；:：]') THEN 'prose' END) AS signals FROM f""")
def line_predicates(spark, sf_dir):
    """What each line would be on a dashboard."""
    signs = P.line_signals(F.col("t"), F.col("digit"), G.width(F.col("bbox")), F.col("page_width"))
    lines = blocks(spark, sf_dir).withColumn("t", T.strip(F.coalesce("text", F.lit("")))).withColumn("digit", F.col("t").rlike(r"\d"))
    return lines.select("doc_id", "page_num", "seq", F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in signs.items()))), ",").alias("signals"))


@query(rf"""WITH {C.BLOCKS_SQL}, t AS (SELECT *, {O.normal('text')} AS s, row_number() OVER (PARTITION BY doc_id, page_num, lower({O.normal('text')}) ORDER BY y0, x0, seq) AS k FROM blocks),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y0, x0, seq) AS p FROM t WHERE k = 1 AND s <> '') SELECT doc_id, page_num, md5(string_agg(s, chr(10) ORDER BY p)) AS digest, count(*) AS n FROM o WHERE p <= 12 GROUP BY ALL""")
def unique_lines(spark, sf_dir):
    return pages.unique_lines(blocks(spark, sf_dir)).select("doc_id", "page_num", F.md5(F.array_join("texts", "\n").cast("binary")).alias("digest"), F.size("texts").cast("bigint").alias("n"))


@query(rf"""WITH {C.BLOCKS_SQL}, l AS (SELECT *, length({O.strip('text')}) AS sz, {O.found(O.strip('text'), '[A-Za-z가-힣]')} / greatest(1, length({O.strip('text')})) AS alpha FROM blocks WHERE x0 = 50),
    c AS (SELECT *, CASE WHEN y0 - lag(y1) OVER w > 1800 * 0.036 THEN 1 WHEN lag(y1) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY y0, x0, seq)),
    k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_num ORDER BY y0, x0, seq) AS cl FROM c), n AS (SELECT *, row_number() OVER w AS n, lead(y0) OVER w - y1 AS nxt FROM k WINDOW w AS (PARTITION BY doc_id, page_num, cl ORDER BY y0, x0, seq)),
    h AS (SELECT doc_id, page_num, cl, count(*) AS cnt, max(sz) FILTER (n = 1) AS hs, avg(sz) FILTER (n > 1) AS bs, bool_or(n = 1 AND sz <= 35 AND y1 - y0 <= 1800 * 0.022 AND alpha >= 0.22 AND coalesce(nxt >= 1800 * 0.008, FALSE)) AS ok FROM n GROUP BY ALL)
    SELECT doc_id, page_num, seq, CASE WHEN ok AND cnt > 1 AND NOT (bs > 0 AND hs >= 0.6 * bs) THEN CASE WHEN n = 1 THEN 'section_header_like' ELSE 'section_body_like' END ELSE 'narrative_text' END AS role FROM n JOIN h USING (doc_id, page_num, cl)""")
def left_sections(spark, sf_dir):
    left = blocks(spark, sf_dir).filter(G.x0(F.col("bbox")) == 50.0).withColumn("page_height", F.lit(1800.0))
    return pages.left_sections(left).select("doc_id", "page_num", "seq", "role")


_ROLES = ("narrative_paragraph", "section_header_like", "section_body_like", "structured_card", "chart_label_like", "list_item_like", "table_header_like", "contact_info_like", "footer", "ignore_noise", "other")


@query(f"""WITH {C.BLOCKS_SQL}, r AS (SELECT *, ([{', '.join(f"'{x}'" for x in _ROLES)}])[seq % 11 + 1] AS role FROM blocks),
    b AS (SELECT *, CASE WHEN role IN ('ignore_noise', 'footer') THEN 'footer' ELSE 'text' END AS kind, CASE role WHEN 'narrative_paragraph' THEN 1 WHEN 'section_header_like' THEN 2 WHEN 'section_body_like' THEN 3 WHEN 'structured_card' THEN 4 WHEN 'chart_label_like' THEN 5 WHEN 'list_item_like' THEN 5 WHEN 'contact_info_like' THEN 6 WHEN 'footer' THEN 8 WHEN 'ignore_noise' THEN 8 ELSE 7 END AS k FROM r)
    SELECT doc_id, page_num, seq, kind AS type, CASE role WHEN 'chart_label_like' THEN 'kpi' WHEN 'list_item_like' THEN 'ranking' WHEN 'table_header_like' THEN 'mini_table' ELSE 'card_text' END AS dashboard_role, CASE WHEN kind = 'footer' THEN 'low' WHEN role IN ('chart_label_like', 'list_item_like', 'table_header_like') THEN 'high' ELSE 'medium' END AS summary_priority,
      CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY k, y0, seq) AS INTEGER) AS place FROM b""")
def dashboard_order(spark, sf_dir):
    """Lines as blocks of their own by role, in a dashboard page's final order."""
    from pyspark.sql import Window as W

    role = F.get(F.array(*map(F.lit, _ROLES)), F.col("seq") % 11)
    rows = pages.line_blocks(blocks(spark, sf_dir).withColumns({"role": role, "coarse": F.lit(None).cast("string")}))
    place = F.row_number().over(W.partitionBy("doc_id", "page_num").orderBy(pages.dashboard_rank(F.col("type"), F.col("role")), G.y0(F.col("bbox")), "seq"))
    return rows.select("doc_id", "page_num", "seq", "type", "dashboard_role", "summary_priority", place.alias("place"))


@query(f"""WITH {C.BLOCKS_SQL}, z AS (SELECT doc_id, page_num, x0 - 30 AS a, y0 - 30 AS b, x1 + 30 AS c, y1 + 30 AS d FROM blocks WHERE type = 'table'),
    p AS (SELECT l.doc_id, l.page_num, l.seq, greatest(0, least(x1, c) - greatest(x0, a)) * greatest(0, least(y1, d) - greatest(y0, b)) / least((x1 - x0) * (y1 - y0), (c - a) * (d - b)) AS o FROM blocks l JOIN z ON l.doc_id = z.doc_id AND l.page_num = z.page_num WHERE l.type <> 'table')
    SELECT l.doc_id, l.page_num, l.seq, round(coalesce(max(p.o), 0.0), 6) AS overlap FROM blocks l LEFT JOIN p USING (doc_id, page_num, seq) WHERE l.type <> 'table' GROUP BY ALL""")
def zone_overlap(spark, sf_dir):
    b = blocks(spark, sf_dir)
    zones = b.filter("type = 'table'").withColumn("bbox", G.expanded(F.col("bbox"), 30.0, 30.0))
    return pages.most_overlap(b.filter("type <> 'table'"), zones).withColumn("overlap", F.round("overlap", 6))


# --- pages ---------------------------------------------------------------------------------------------------------


@query(rf"""WITH {C.PAGES_SQL}, l AS (SELECT *, {O.lines('text')} AS ls, regexp_replace(text, '[ \n]', '', 'g') AS d FROM pages_), w AS (SELECT *, list_filter(flatten(list_transform(ls, lambda x: regexp_split_to_array(x, '\s+'))), lambda x: x <> '') AS tk FROM l),
    m AS (SELECT *, {O.found('d', P.MEANING)} / length(d) AS share, len(list_filter(ls, lambda x: {O.found('x', P.MEANING)} >= 3)) / greatest(1, len(ls)) AS good, len(list_filter(tk, lambda t: length(t) <= 2)) / greatest(1, len(tk)) AS short FROM w)
    SELECT doc_id, page_num, CASE WHEN length(text) >= 60 THEN share < 0.35 AND (1 - share > 0.6 OR good < 0.4 OR short > 0.6) ELSE page_num % 2 = 1 OR share < 0.3 END AS needed,
      CASE WHEN length(text) >= 60 THEN CASE WHEN share < 0.35 AND (1 - share > 0.6 OR good < 0.4 OR short > 0.6) THEN 'low_alphanumeric_density' ELSE 'ocr_not_needed' END WHEN page_num % 2 = 1 THEN 'images_present_and_text_weak' WHEN share < 0.3 THEN 'short_and_low_alphanumeric' ELSE 'native_text_below_threshold_but_no_images' END AS reason FROM m""")
def reading_decisions(spark, sf_dir):
    """Which pages have to be read optically; odd pages are taken to have an image."""
    rows = pages_of(blocks(spark, sf_dir)).withColumn("r", P.reading_needed(F.col("text"), F.col("page_num") % 2, F.lit("")))
    return rows.select("doc_id", "page_num", "r.needed", "r.reason")


def _words_found(c: str, words) -> str:
    return " + ".join(f"CAST(contains({c}, '{w}') AS INTEGER)" for w in words)


@query(rf"""WITH {C.PAGES_SQL}, o AS (SELECT doc_id, page_num, count(*) AS nb, count(*) FILTER (type = 'title') AS ti, count(*) FILTER (type = 'text') AS tx, count(*) FILTER (type = 'table') AS vi, count(*) FILTER (type = 'text' AND length(text) > 60 AND contains(text, '다.')) AS lo,
      coalesce(sum({O.found('text', '[0-9]+')}) FILTER (type = 'text'), 0) AS nu, coalesce(sum({O.found('text', '%')}) FILTER (type = 'text'), 0) AS pc FROM blocks GROUP BY ALL),
    q AS (SELECT doc_id, page_num, {_words_found("replace(lower(text), ' ', '')", P.PAGE_DISCLAIMER)} AS di, {_words_found("replace(lower(text), ' ', '')", P.DASHBOARD_WORDS)} AS wo, {O.found('text', P.DATES)} AS da FROM pages_),
    s AS (SELECT *, CASE WHEN di > 0 THEN 3 ELSE 0 END + CAST(lo = 0 AS INTEGER) + CAST(page_num <= 2 AS INTEGER) + CAST(ti >= 2 AND tx <= 3 AS INTEGER) + CAST(da >= 2 AS INTEGER) AS co, CASE WHEN wo >= 3 THEN 2 ELSE 0 END + CAST(nu > 40 AND pc > 3 AS INTEGER) + CAST(nb > 15 AS INTEGER) + CAST(vi >= 2 AS INTEGER) + CAST(lo > 0 AND vi > 0 AS INTEGER) AS bo FROM o JOIN q USING (doc_id, page_num))
    SELECT doc_id, page_num, CASE WHEN co >= 4 OR di >= 2 THEN 'cover_or_disclaimer_like' WHEN vi > tx AND vi >= 2 AND lo = 0 THEN 'appendix_or_table_heavy' WHEN bo >= 3 AND nu > 30 THEN 'dashboard_kpi_like' ELSE 'text_heavy' END AS page_class,
      concat_ws(',', CASE WHEN di > 0 THEN 'disclaimer_found(' || di || ')' END, CASE WHEN page_num <= 2 THEN 'early_page' END, CASE WHEN lo = 0 THEN 'no_long_paragraph' END, CASE WHEN ti >= 2 AND tx <= 3 THEN 'title_heavy_layout' END, CASE WHEN da >= 2 THEN 'date_pattern(' || da || ')' END) AS signals FROM s""")
def page_classes(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return pages.classified(pages_of(rows), rows).withColumn("signals", F.array_join("signals", ","))


@query(f"""WITH {C.PAGES_SQL}, s AS (SELECT doc_id, greatest(0.0, 100.0 - CASE WHEN page_num % 5 = 0 THEN 50 ELSE 0 END - 5 * (page_num % 3) - CASE WHEN page_num % 4 = 1 AND page_num % 8 * 10 < 60 THEN 20 ELSE 0 END) AS p, trim(text) = '' AS e FROM pages_)
    SELECT doc_id, round(CAST(avg(p) AS DOUBLE) * CASE WHEN count(*) FILTER (e) > count(*) * 0.3 THEN 0.7 ELSE 1.0 END, 2) AS quality FROM s GROUP BY 1""")
def page_quality(spark, sf_dir):
    """Every fifth page with an error, some with warnings or read optically."""
    n = F.col("page_num")
    return pages.quality(pages_of(blocks(spark, sf_dir)).withColumns({"error": n % 5 == 0, "warnings": n % 3, "ocr_applied": n % 4 == 1, "ocr_confidence": n % 8 * 10}))


@query(f"""WITH {C.PAGES_SQL}, b AS (SELECT doc_id, count(*) FILTER (type = 'title') AS title_blocks, count(*) FILTER (type = 'text') AS text_blocks, count(*) FILTER (type = 'table') AS tables FROM blocks GROUP BY 1), p AS (SELECT doc_id, count(*) AS page_count, count(*) FILTER (trim(text) = '') AS empty_pages, avg(length(text)) AS mean FROM pages_ GROUP BY 1)
    SELECT doc_id, page_count, title_blocks, text_blocks, tables, empty_pages, round(greatest(0.0, least(100.0, 100.0 - empty_pages / page_count * 45.0 + CASE WHEN mean < 300 THEN -10.0 WHEN mean > 1200 THEN 3.0 ELSE 0.0 END)), 2) AS text_quality FROM p JOIN b USING (doc_id)""")
def content_structure(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return pages.content(pages_of(rows), rows)


@query(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[ \n]', '', 'g') AS d, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {O.strip('x')}), lambda x: x <> '') AS ls FROM documents),
    m AS (SELECT doc_id, {O.found('d', '[0-9]')} / greatest(1, length(d)) AS share, {O.found('text', '[가-힣][다음함][.]')} AS e, len(list_filter(ls, lambda x: length(x) > 60 AND regexp_matches(x, '[다음함]'))) AS lo, len(list_filter(ls, lambda x: length(x) < 30 AND regexp_matches(x, '[:•\[\]-]'))) AS la FROM t)
    SELECT doc_id, round(share, 3) AS num_ratio, CAST(e AS INTEGER) AS endings, CAST(lo AS INTEGER) AS long_paragraphs, CAST(la AS INTEGER) AS labels, share > 0.25 AND e <= 1 AND lo = 0 AS dashboard FROM m""")
def narrative_profiles(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", P.narrative_profile(F.col("text")).alias("p")).select("doc_id", "p.*")


# --- groups and payloads -------------------------------------------------------------------------------------------


@query(rf"""WITH {_RICH}, p AS (SELECT doc_id, page_num, prio, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY CASE lower(prio) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, y0, x0, seq) AS k FROM rich),
    t AS (SELECT doc_id, page_num, n, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY n IS NULL, y0, x0, seq) AS k FROM (SELECT *, coalesce(assoc, CASE WHEN type = 'title' THEN nullif({O.clean('text')}, '') END) AS n FROM rich))
    SELECT p.doc_id, p.page_num, p.prio AS summary_priority, t.n AS associated_title FROM p JOIN t ON p.doc_id = t.doc_id AND p.page_num = t.page_num AND p.k = 1 AND t.k = 1""")
def group_meta(spark, sf_dir):
    """The highest priority and the first title of each page's blocks."""
    rows = rich_blocks(spark, sf_dir)
    return assembly.summary_priority(rows, "doc_id", "page_num").join(assembly.associated_title(rows, "doc_id", "page_num"), ["doc_id", "page_num"])


_SIDE = f"""{C.PAGES_SQL.strip()}, side AS (SELECT doc_id, page_num + 1 AS page_num, 'side ' || page_num AS rag_text, 'Side ' || page_num AS page_title FROM pages_ WHERE page_num % 3 <> 2)"""


def sidecar(rows: DataFrame) -> DataFrame:
    """A sidecar whose pages are shifted by one, so that some have no parsed page."""
    n = F.col("page_num").cast("string")
    return rows.filter("page_num % 3 <> 2").select("doc_id", (F.col("page_num") + 1).alias("page_num"), F.concat(F.lit("side "), n).alias("rag_text"), F.concat(F.lit("Side "), n).alias("page_title"))


@query(f"""WITH {_SIDE} SELECT s.doc_id, s.page_num, CASE WHEN p.doc_id IS NULL THEN s.page_title ELSE substr(p.text, 1, 80) END AS page_title, p.doc_id IS NULL AS stub FROM side s LEFT JOIN pages_ p ON p.doc_id = s.doc_id AND p.page_num = s.page_num""")
def sidecar_pages(spark, sf_dir):
    parsed = pages_of(blocks(spark, sf_dir))
    return assembly.sidecar_pages(sidecar(parsed), parsed).select("doc_id", "page_num", "page_title", "stub")


@query(f"""WITH {_SIDE} SELECT p.doc_id, p.page_num, md5(CASE WHEN p.page_num % 2 = 0 THEN coalesce(s.rag_text, '') ELSE {O.clean('p.text')} END) AS digest FROM pages_ p LEFT JOIN side s ON p.doc_id = s.doc_id AND p.page_num = s.page_num""")
def sidecar_text(spark, sf_dir):
    """Even pages have lost their own text."""
    parsed = pages_of(blocks(spark, sf_dir))
    lost = parsed.withColumn("rag_text", F.when(F.col("page_num") % 2 == 1, F.col("rag_text")))
    return assembly.with_sidecar_text(lost, sidecar(parsed)).select("doc_id", "page_num", F.md5(F.col("rag_text").cast("binary")).alias("digest"))


@query()
def chunk_payloads(spark, sf_dir):
    """Headers of both strategies' chunks for every document."""
    rows = blocks(spark, sf_dir)
    parsed = pages_of(rows)
    names = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("filename"), F.col("lang").alias("document_type"))
    issues = assembly.sidecar_pages(sidecar(parsed), parsed).filter("stub").select("doc_id", F.lit(schemas.BASELINE_STRATEGY).alias("strategy_name"), F.concat(F.lit("stub:"), F.col("page_num").cast("string")).alias("issue"))
    return assembly.payloads(assembly.all_chunks(rows, parsed), names, issues).withColumn("issues", F.array_join("issues", ","))


@query(f"""WITH {O._CELLS}, x AS (SELECT * FROM cells WHERE r > 0)
    SELECT table_id, r AS row_index, c AS column_index, CASE WHEN v <> '' THEN 'cell ' || c || '=' || v ELSE 'cell ' || c END AS pair, round(CASE WHEN table_id % 17 > 1 THEN least(0.98, (table_id % 17) / 10.0) ELSE CAST(table_id % 17 AS DOUBLE) END, 4) AS confidence, nullif(v, '') AS cell_value FROM x""")
def cell_fields(spark, sf_dir):
    rows = C.order_tables(spark, sf_dir).select("table_id", F.posexplode("rows").alias("row_index", "row")).filter("row_index > 0").select("table_id", "row_index", F.posexplode("row").alias("column_index", "v"))
    label = F.concat(F.lit("cell "), F.col("column_index").cast("string"))
    fields = assembly.visual_fields(F.lit(None).cast("string"), F.lit(" "), F.lit(None).cast("string"), label, F.col("v"), F.col("row_index").cast("string"), F.lit("no number"))
    return rows.select("table_id", "row_index", "column_index", assembly.pair_text(label, F.col("v")).alias("pair"), assembly.confidence(F.lit("none"), (F.col("table_id") % 17).cast("string"), default=0.5).alias("confidence"), fields["cell_value"].alias("cell_value"))


# --- answers -------------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id % 50 AS query_id, vec_id, label FROM embeddings), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY query_id) AS size FROM q)
    SELECT query_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos % 2 = 0 THEN 'm' || vec_id ELSE 'v' || vec_id END AS vector_record_id, CASE WHEN pos < size - 1 THEN 'text ' || vec_id ELSE '' END AS text, CASE WHEN pos < 3 THEN round(1.0 - (pos * 0.25) / 2, 6) END AS score FROM n""")
def parallel_results(spark, sf_dir):
    """A store's parallel lists as rows; the lists of texts and distances are short."""
    rows = S.table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 50).alias("query_id")).agg(F.array_sort(F.collect_list("vec_id")).alias("v"))
    v = F.col("v")
    record = F.transform(v, lambda x, i: F.when(i % 2 == 0, F.concat(F.lit('{"vector_record_id": "m'), x.cast("string"), F.lit('"}'))).otherwise("{}"))
    results = rows.select("query_id", F.transform(v, lambda x: F.concat(F.lit("v"), x.cast("string"))).alias("ids"), record.alias("metadatas"), F.transform(F.slice(v, F.lit(1), F.size(v) - 1), lambda x: F.concat(F.lit("text "), x.cast("string"))).alias("documents"), F.array(*(F.lit(0.25 * i) for i in range(3))).alias("distances"))
    return answering.from_parallel(results).withColumn("score", F.round("score", 6))


@query("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS n FROM documents), s AS (SELECT doc_id, k, 3 - k AS pos FROM d, range(3) r(k)), c AS (SELECT doc_id, k FROM d, range(2) r(k))
    SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS place FROM s JOIN c USING (doc_id, k)""")
def restored_selection(spark, sf_dir):
    """Stored selections of three chunks, the last of which is gone."""
    d = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"))
    chosen = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("chunk_index")).withColumn("pos", 3 - F.col("chunk_index"))
    return answering.restored(chosen, d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("chunk_index"))).select("doc_id", "chunk_index", "place")


@query()
def representative_chunks(spark, sf_dir):
    """Selections by coverage; those of every other document come from the store, and documents without chunks fall back to reranked candidates."""
    scored = S.stored(C.covered(spark, sf_dir).drop("text"), "scored-chunks")  # five steps read them: splitting and scoring are most of the work
    even = F.col("doc_id").cast("bigint") % 2 == 0
    stored = scored.filter(even).groupBy("doc_id").agg(F.min("chunk_index").alias("chunk_index")).withColumn("pos", F.lit(1))
    reranked = retrieval.diversified(C.summary_candidates(spark, sf_dir).select(F.col("doc_id").alias("request_id"), F.col("chunk_index").alias("doc"), F.col("page_num").cast("string").alias("page"), F.lit("").alias("section"), F.col("s.score").alias("score")), 8)
    rest = reranked.select(F.col("request_id").alias("doc_id"), F.lit(1).alias("page_num"), F.col("doc").alias("chunk_index"), "rank")
    return answering.representative(scored.filter(F.col("doc_id").cast("bigint") % 5 != 1), 8, rest, stored)


# --- export --------------------------------------------------------------------------------------------------------

_ENTRIES = f"""{_RICH}, e0 AS (SELECT *, {_tidy('text')} AS raw, coalesce(lower(prio) = 'low', FALSE) AS low FROM rich WHERE NOT (excl AND coalesce(lower(prio) = 'low', FALSE) AND type IN ('title', 'text'))),
    e1 AS (SELECT *, CASE type WHEN 'title' THEN CASE WHEN excl THEN '' ELSE {_compact('raw', 140)} END WHEN 'table' THEN 'Table of ' || seq WHEN 'chart' THEN {_tidy('raw', 300)}
      ELSE CASE WHEN excl OR low THEN '' WHEN slide IS NOT NULL THEN {_compact('raw', 280)} ELSE {_compact('raw', 650)} END END AS said,
      CASE type WHEN 'title' THEN 'title' WHEN 'table' THEN 'table' WHEN 'chart' THEN 'visual' ELSE CASE WHEN low OR reason IS NOT NULL THEN 'note' ELSE 'body' END END AS s0 FROM e0),
    e2 AS (SELECT *, CASE WHEN s0 = 'body' AND slide IS NOT NULL AND bool_or(s0 = 'table') OVER (PARTITION BY doc_id, page_num) THEN 'note' ELSE s0 END AS section FROM e1)"""


@query(f"""WITH {_ENTRIES} SELECT doc_id, page_num, seq AS source_order, section AS llm_section, md5(said) AS digest,
    CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY list_position(['title', 'body', 'table', 'visual', 'note'], section), CASE lower(prio) WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 4 ELSE 2 END, seq) AS INTEGER) AS place FROM e2""")
def model_entries(spark, sf_dir):
    """Block entries for a model, in their order."""
    rows = export.ordered(export.entries(rich_blocks(spark, sf_dir)))
    return rows.select("doc_id", "page_num", "source_order", "llm_section", F.md5(F.col("text").cast("binary")).alias("digest"), "place")


@query(rf"""WITH {_RICH}, u AS (SELECT * FROM rich WHERE NOT (coalesce(lower(prio) = 'low', FALSE) OR excl OR reason IS NOT NULL)),
    o AS (SELECT *, CASE WHEN type = 'title' THEN 100 ELSE 0 END + CASE WHEN assoc IS NOT NULL THEN 24 ELSE 0 END + CASE lower(prio) WHEN 'high' THEN 18 WHEN 'medium' THEN 10 ELSE 0 END + CASE WHEN type = 'text' THEN 8 ELSE 0 END + CASE WHEN type IN ('table', 'chart') AND assoc IS NOT NULL THEN 6 ELSE 0 END AS points FROM u),
    c AS (SELECT doc_id, page_num, seq, points, text AS t FROM o WHERE type IN ('title', 'text') UNION ALL SELECT doc_id, page_num, seq, points, assoc FROM o WHERE assoc IS NOT NULL), k AS (SELECT * REPLACE ({_compact('t', 140)} AS t) FROM c),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY points - greatest(0, length(t) - 120) // 8 DESC, seq, length(t), t) AS n FROM k WHERE {O.found('t', chr(92) + 'p{L}')} >= 2)
    SELECT p.doc_id, p.page_num, coalesce(b.t, '') AS page_title FROM (SELECT DISTINCT doc_id, page_num FROM blocks) p LEFT JOIN b ON b.doc_id = p.doc_id AND b.page_num = p.page_num AND b.n = 1""")
def model_titles(spark, sf_dir):
    rows = rich_blocks(spark, sf_dir)
    return export.page_titles(rows, pages_of(rows).withColumn("page_title", F.lit("")))


@query()
def model_documents(spark, sf_dir):
    """Documents for a model with their pages' texts, as reports."""
    rows = rich_blocks(spark, sf_dir)
    parsed = pages_of(rows)
    texts = export.page_texts(export.entries(rows), export.page_titles(rows, parsed)).join(parsed.select("doc_id", "page_num", F.col("text").alias("source_text")), ["doc_id", "page_num"])
    heads = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("filename"))
    return export.report(export.documents(texts, heads)).select("doc_id", F.length("markdown").alias("chars"), F.md5(F.col("markdown").cast("binary")).alias("digest"))


# --- slides, boxes and tables --------------------------------------------------------------------------------------


@query(rf"""WITH {C.BLOCKS_SQL}, t AS (SELECT *, {O.strip('text')} AS s, length(regexp_replace(text, '\s+', '', 'g')) AS d, 10.0 + seq % 8 AS font FROM blocks), m AS (SELECT *, length(s) AS n, {O.found('s', '[0-9]')} / greatest(1, d) AS dr, y0 < 842 * 0.16 AS high FROM t),
    r AS (SELECT *, CASE WHEN high AND ((regexp_matches(s, '[.!?。]') AND d > 120) OR (d > 180 AND dr >= 0.12)) THEN 'body_note' WHEN high AND (font >= 14 OR (n <= 80 AND x1 - x0 > 595 * 0.18)) THEN 'title' WHEN y1 > 842 * 0.92 AND n <= 40 THEN 'footer' WHEN regexp_matches(s, '{slides.KEY_FIGURE}') AND n <= 48 THEN 'kpi_metric'
      WHEN regexp_matches(s, '^[▪•□◦*+-]') THEN 'bullet_item' WHEN n <= 8 AND NOT regexp_matches(s, '[A-Za-z가-힣]{{2,}}') THEN 'decorative_noise' WHEN x1 - x0 < 595 * 0.12 AND n < 16 AND y0 < 842 * 0.25 THEN 'section_chip' ELSE 'body_note' END AS role FROM m)
    SELECT doc_id, page_num, seq, role AS slide_role, CASE WHEN role = 'footer' OR (type <> 'table' AND y1 > 842 * 0.94) THEN 'footer' WHEN role = 'title' THEN 'title' ELSE type END AS kind, CASE WHEN role = 'footer' OR (type <> 'table' AND y1 > 842 * 0.94) THEN 'low' WHEN role IN ('title', 'kpi_metric') THEN 'high' END AS priority,
      CASE WHEN y0 < 842 * 0.12 AND font >= 13.5 AND n <= 120 THEN 'section_title' WHEN y1 > 842 * 0.92 AND n <= 60 THEN 'footer_note' WHEN regexp_matches(s, '(?i)^\s*(표|table|figure|그림)\s*[0-9A-Za-z.-]+') THEN 'caption' WHEN font - 8 >= 2.5 AND n <= 90 THEN 'section_title' ELSE 'body_text' END AS report_role,
      CASE WHEN font >= 14 AND y0 < 842 * 0.15 THEN 'title' WHEN y1 > 842 * 0.92 AND y1 - y0 < 20 THEN 'footer' ELSE 'text' END AS plain_role FROM r""")
def block_roles(spark, sf_dir):
    """What each block would be on a slide and in a report; fonts by number."""
    b, font = F.col("bbox"), 10.0 + F.col("seq") % 8
    rows = blocks(spark, sf_dir).withColumn("slide_role", slides.slide_role(F.col("text"), b, F.col("page_width"), F.col("page_height"), font))
    kind = slides.slide_kind(F.col("type"), F.col("slide_role"), b, F.col("page_height"))
    return rows.select("doc_id", "page_num", "seq", "slide_role", kind["type"].alias("kind"), kind["summary_priority"].alias("priority"), slides.report_role(F.col("text"), b, F.col("page_height"), font, F.lit(8.0))["role"].alias("report_role"), slides.plain_role(b, F.col("page_height"), font).alias("plain_role"))


@query(rf"""WITH {_RICH}, s AS (SELECT *, length(regexp_replace(text, '\s+', '', 'g')) AS d, type IN ('text', 'title') AND NOT excl AND {O.strip('text')} <> '' AS said FROM rich), g AS (SELECT *, said AND slide IS NOT NULL AS st FROM s),
    p AS (SELECT doc_id, page_num, coalesce(sum(d) FILTER (said AND NOT st), 0) AS lo, coalesce(sum(d) FILTER (st), 0) AS gl, count(*) FILTER (type = 'chart') AS visuals, coalesce(sum({O.found('text', '[.!?。]')}) FILTER (st), 0) AS stops, coalesce(sum({O.found('text', '[0-9]')}) FILTER (st), 0) AS digits FROM g GROUP BY ALL),
    q AS (SELECT *, gl >= 40 AND lo < 40 AS only_, digits / greatest(1, gl) AS share FROM p)
    SELECT doc_id, page_num, CAST(lo AS BIGINT) AS local_chars, CAST(gl AS BIGINT) AS global_chars, visuals, only_ AS global_only, only_ AND stops >= 1 AND gl > 55 AND share < 0.18 AND visuals <= 4 AS legal_like, only_ AND gl <= 260 AND share >= 0.08 AND visuals <= 4 AS index_like FROM q""")
def page_profiles(spark, sf_dir):
    return slides.page_profiles(rich_blocks(spark, sf_dir))


@query(rf"""WITH {C.PAGES_SQL}, b AS (SELECT doc_id, page_num, count(*) AS n, count(*) FILTER (type <> 'table') AS tx, bool_or({O.any_of("regexp_replace(lower(text), '" + chr(92) + "s+', '', 'g')", ('목차', 'contents', 'index'))}) AS toc FROM blocks GROUP BY ALL), m AS (SELECT doc_id, max(page_num) AS last_ FROM b GROUP BY 1),
    x AS (SELECT *, length(text) AS ch, {O.words('text')} AS w FROM pages_)
    SELECT b.doc_id, b.page_num, CASE WHEN b.page_num = 1 THEN 'cover' WHEN b.page_num >= last_ THEN 'disclaimer' WHEN toc THEN 'toc' WHEN n < 5 THEN 'section_divider' ELSE 'body' END AS page_role,
      CASE WHEN ch >= 120 OR w >= 40 OR (tx >= 4 AND ch >= 60) THEN 'native_text_slide' WHEN ch < 40 AND w < 15 AND (b.page_num % 4 > 0 AND tx = 0 OR ch < 10) THEN 'ocr_slide' ELSE 'hybrid_slide' END AS page_mode FROM b JOIN m USING (doc_id) JOIN x ON x.doc_id = b.doc_id AND x.page_num = b.page_num""")
def page_roles(spark, sf_dir):
    """Each page's role, and how it would be read as a slide; some are taken to have images."""
    rows = blocks(spark, sf_dir)
    counts = rows.groupBy("doc_id", "page_num").agg(F.count_if(F.col("type") != "table").alias("texts"))
    t = F.col("text")
    mode = slides.page_mode(F.length(t), F.size(T.words(t)), F.col("texts"), F.col("page_num") % 4, F.lit(0))
    modes = pages_of(rows).join(counts, ["doc_id", "page_num"]).select("doc_id", "page_num", mode.alias("page_mode"))
    return slides.page_roles(rows).join(modes, ["doc_id", "page_num"])


@query(f"""WITH {C.BLOCKS_SQL}, v AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM blocks WHERE (x1 - x0) * (y1 - y0) >= 0.005 * 595 * 842 AND NOT (x1 - x0 > 595 * 0.5 AND y1 - y0 < 842 * 0.008)), r AS (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY w * h DESC, seq) AS k FROM v WINDOW p AS (PARTITION BY doc_id, page_num))
    SELECT doc_id, page_num, seq FROM r WHERE n <= 10 OR k <= 10""")
def kept_visuals(spark, sf_dir):
    """All blocks taken as visuals: the larger ones of each page."""
    return slides.kept_visuals(blocks(spark, sf_dir)).select("doc_id", "page_num", "seq")


@query(f"""WITH {_RICH}, h AS (SELECT *, CASE WHEN seq % 5 = 0 THEN 'kpi' WHEN seq % 5 = 1 THEN 'footer' ELSE '' END AS role FROM rich WHERE type IN ('text', 'title', 'table')),
    p AS (SELECT v.doc_id, v.page_num, v.seq, h.seq AS hs, greatest(0, least(v.x1, h.x1) - greatest(v.x0, h.x0)) * greatest(0, least(v.y1, h.y1) - greatest(v.y0, h.y0)) / ((v.x1 - v.x0) * (v.y1 - v.y0))
      + CASE WHEN greatest(0, h.x0 - v.x1, v.x0 - h.x1) < 595 * 0.04 AND greatest(0, h.y0 - v.y1, v.y0 - h.y1) < 842 * 0.04 THEN 1.0 ELSE 0 END + CASE WHEN role = 'kpi' THEN 0.25 ELSE 0 END AS s FROM rich v JOIN h ON h.doc_id = v.doc_id AND h.page_num = v.page_num AND role <> 'footer' WHERE v.type = 'chart'),
    b AS (SELECT * FROM p WHERE s >= 0.35 QUALIFY row_number() OVER (PARTITION BY doc_id, page_num, seq ORDER BY s DESC, hs) = 1)
    SELECT v.doc_id, v.page_num, v.seq, b.hs AS host_seq, round(b.s, 6) AS score FROM rich v LEFT JOIN b ON b.doc_id = v.doc_id AND b.page_num = v.page_num AND b.seq = v.seq WHERE v.type = 'chart'""")
def visual_hosts(spark, sf_dir):
    rows = rich_blocks(spark, sf_dir).withColumn("dashboard_role", F.when(F.col("seq") % 5 == 0, "kpi").when(F.col("seq") % 5 == 1, "footer"))
    return slides.visual_hosts(rows.filter("type = 'chart'"), rows)


@query(f"""WITH {C.BLOCKS_SQL}, r AS (SELECT doc_id, page_num, seq % 3 AS region, (max(x1) - min(x0)) * (max(y1) - min(y0)) / (595.0 * 842.0) AS share, count(*) AS lines FROM blocks GROUP BY ALL)
    SELECT doc_id, page_num, count(*) AS regions, round(min(share), 5) AS area_min, round(max(share), 5) AS area_max, round(avg(share), 5) AS area_mean, min(lines) AS lines_min, max(lines) AS lines_max, round(avg(lines), 3) AS lines_mean FROM r GROUP BY ALL""")
def region_stats(spark, sf_dir):
    return slides.region_stats(blocks(spark, sf_dir).withColumn("region", F.col("seq") % 3))


@query(f"""WITH {C.BLOCKS_SQL}, b AS (SELECT doc_id, page_num, length({O.strip('text')}) AS n, (seq % 10) / 10.0 AS c, (x1 - x0) * (y1 - y0) AS a FROM blocks), g AS (SELECT doc_id, page_num, sum(n * c) AS w, avg(CASE WHEN c > 0.4 AND n >= 2 THEN 1.0 ELSE 0.0 END) AS valid, avg(CASE WHEN n <= 2 THEN 1.0 ELSE 0.0 END) AS micro, sum(n) AS chars, least(0.5, sum(a) / (595.0 * 842.0)) AS cov FROM b GROUP BY ALL),
    s AS (SELECT *, CAST(w * (1.0 + valid * 0.3) * (1.0 + cov * 0.2) - micro * chars * 0.3 AS DOUBLE) AS s FROM g) SELECT doc_id, page_num, round(greatest(0.0, CASE WHEN chars < 10 THEN s * 0.1 ELSE s END), 2) AS score FROM s""")
def box_scores(spark, sf_dir):
    return slides.box_score(blocks(spark, sf_dir).withColumn("confidence", (F.col("seq") % 10) / 10.0))


@query(f"""WITH {_RICH}, d AS (SELECT *, CASE CAST(doc_id AS BIGINT) % 4 WHEN 0 THEN 'slide_ir' WHEN 1 THEN 'dashboard_brief' WHEN 2 THEN 'table_heavy' ELSE 'text_report' END AS kind, {O.strip('text')} AS s FROM rich),
    w AS (SELECT *, CASE WHEN excl THEN NULL WHEN kind = 'slide_ir' AND type = 'text' AND length(s) < 15 THEN 'slide_micro_text' WHEN kind = 'dashboard_brief' AND type = 'text' AND length(s) < 50 AND {O.found('s', '[0-9]')} / greatest(1, length(s)) < 0.1 THEN 'dashboard_narrative_noise' END AS why FROM d)
    SELECT doc_id, page_num, seq, excl OR why IS NOT NULL AS summary_exclude, coalesce(why, reason) AS exclude_reason, CASE WHEN kind = 'table_heavy' AND type = 'table' THEN 'high' ELSE prio END AS summary_priority FROM w""")
def suppressed_blocks(spark, sf_dir):
    kinds = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.get(F.array(*map(F.lit, ("slide_ir", "dashboard_brief", "table_heavy", "text_report"))), (F.col("doc_id") % 4).cast("int")).alias("document_type"))
    rows = rich_blocks(spark, sf_dir).withColumn("summary_role", F.lit(None).cast("string"))
    return slides.suppressed(rows, kinds).select("doc_id", "page_num", "seq", "summary_exclude", "exclude_reason", "summary_priority")


@query()
def finished_pages(spark, sf_dir):
    """Blocks of finished pages: checked, without repeats, tables judged, in reading order."""
    return slides.finalised(blocks(spark, sf_dir))[0].select("doc_id", "page_num", "seq", "type", "rag_order", "table_score", "table_readiness")


@query()
def first_routes(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return slides.first_route(pages_of(rows), rows)


@query(f"""WITH {C.BLOCKS_SQL}, t AS (SELECT * REPLACE (CASE WHEN page_num % 2 = 0 THEN '123456' || substr(text, 1, 6) ELSE substr(text, 1, 20) END AS text) FROM blocks), l AS (SELECT *, seq % 3 + 3 * ((seq % 20) // 7) AS cl, length({O.strip('text')}) AS n FROM t),
    g AS (SELECT doc_id, page_num, cl, min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d, count(*) AS k, avg((x1 - x0) / 800.0) AS wide, avg({O.found(O.strip('text'), '[0-9]')} / n) AS num, avg(CASE WHEN n <= 22 THEN 1.0 ELSE 0.0 END) AS short FROM l GROUP BY ALL),
    f AS (SELECT *, k >= 3 AND wide <= 0.38 AND (num >= 0.26 OR short >= 0.45) AS tight, (a + c) / 2 AS cx, (b + d) / 2 AS cy FROM g), h AS (SELECT *, tight AND cx >= 0.52 * 800 AND cy < 0.67 * 842 AS rt FROM f),
    z AS (SELECT doc_id, page_num, 'hard' AS kind, a - 800 * 0.008 AS a, b - 842 * 0.006 AS b, c + 800 * 0.008 AS c, d + 842 * 0.006 AS d FROM h WHERE rt UNION ALL SELECT doc_id, page_num, 'hard', a - 800 * 0.006, b - 842 * 0.005, c + 800 * 0.006, d + 842 * 0.005 FROM h WHERE tight AND NOT rt AND b >= 0.66 * 842
      UNION ALL SELECT doc_id, page_num, 'soft', a - 800 * 0.004, b - 842 * 0.003, c + 800 * 0.004, d + 842 * 0.003 FROM h WHERE k >= 3 AND num >= 0.30 AND wide <= 0.36 AND cx >= 0.50 * 800 UNION ALL SELECT doc_id, page_num, 'hard', x0 - 800 * 0.011, y0 - 842 * 0.009, x1 + 800 * 0.011, y1 + 842 * 0.009 FROM blocks WHERE type = 'table')
    SELECT doc_id, page_num, kind, round(CAST(a AS DOUBLE), 4) AS x0, round(CAST(b AS DOUBLE), 4) AS y0, round(CAST(c AS DOUBLE), 4) AS x1, round(CAST(d AS DOUBLE), 4) AS y1 FROM z WHERE (c - a) * (d - b) <= 0.40 * 800 * 842""")
def exclusion_zones(spark, sf_dir):
    """Lines cut short, those of even pages led by figures, in clusters by column and height."""
    rows = blocks(spark, sf_dir).withColumn("page_width", F.lit(800.0))
    seq = F.col("seq")
    short = F.when(F.col("page_num") % 2 == 0, F.concat(F.lit("123456"), F.substring("text", 1, 6))).otherwise(F.substring("text", 1, 20))
    lines = rows.withColumns({"text": short, "cluster": seq % 3 + 3 * F.floor(seq % 20 / 7)})
    zones = pages.exclusion_zones(lines, rows.filter("type = 'table'"))
    return zones.select("doc_id", "page_num", "kind", *(F.round(F.get("bbox", F.lit(i)), 4).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


_FIGURE = r"(?i)[-+]?[0-9][0-9,]*(?:[.][0-9]+)?\s*(?:%|bp|bps|원|억원|조원|조|USD|pt|x)?"


@query(rf"""WITH {C.BLOCKS_SQL}, t AS (SELECT doc_id, page_num, seq, text, list_transform(regexp_extract_all(text, '{_FIGURE}'), lambda x: {O.strip('x')}) AS f FROM blocks), n AS (SELECT *, list_reduce(list_prepend(text, f), lambda acc, x: replace(acc, x, ' ')) AS bare FROM t WHERE len(f) > 0),
    l AS (SELECT *, regexp_replace({O.normal("regexp_replace(bare, '^[" + chr(92) + "s" + chr(92) + "-*+•" + chr(0xf0a7) + "▪●○]+', '')")}, '^[ :;,]+|[ :;,]+$', '', 'g') AS label FROM n) SELECT doc_id, page_num, seq, coalesce(nullif(label, ''), 'metric') AS item, array_to_string(f, ', ') AS "values" FROM l""")
def key_value_rows(spark, sf_dir):
    """Labels and figures of each line that has figures."""
    return blocks(spark, sf_dir).select("doc_id", "page_num", "seq", F.explode(P.key_value_rows(F.array("text"))).alias("r")).select("doc_id", "page_num", "seq", "r.*")


@query(f"""WITH {O._CELLS}, r AS (SELECT table_id, r, string_agg(CASE WHEN r = 0 THEN '<th>' || v || '</th>' ELSE '<td>' || v || '</td>' END, '' ORDER BY c) AS h FROM cells GROUP BY ALL)
    SELECT table_id, md5('<table><thead><tr>' || max(h) FILTER (r = 0) || '</tr></thead><tbody>' || string_agg('<tr>' || h || '</tr>', '' ORDER BY r) FILTER (r > 0) || '</tbody></table>') AS digest FROM r GROUP BY 1""")
def html_tables(spark, sf_dir):
    return C.order_tables(spark, sf_dir).select("table_id", F.md5(P.html_table(F.col("rows")).cast("binary")).alias("digest"))


@query("""SELECT doc_id, md5('/data/' || source || '/' || doc_id || '.' || upper(lang)) AS id, doc_id || '.' || upper(lang) AS filename, lang AS file_type, n_chars AS file_size, source || '/' || doc_id || '.' || upper(lang) AS portable FROM documents""")
def base_records(spark, sf_dir):
    """Documents as files below one folder: what a parsed document begins with, and the path relative to the folder."""
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.upper("lang"))
    rows = files.base_records(docs(spark, sf_dir).select(path.alias("path"), F.col("n_chars").alias("length")))
    return rows.select(F.regexp_extract("filename", r"^(\d+)", 1).cast("bigint").alias("doc_id"), "id", "filename", "file_type", "file_size", P.portable_path(F.col("filepath"), "/data").alias("portable"))
