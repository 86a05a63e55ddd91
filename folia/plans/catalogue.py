"""The registered queries and the DuckDB SQL of those that SQL can express.

A query takes (spark, sf_dir), runs an operator over whole tables and returns its
rows; numbers are rounded where engines may differ in the last digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions import geometry as G
from folia.functions import keys as K
from folia.functions import tables as TB
from folia.functions import text as T
from folia.operators import chunking, index, layout, metadata, retrieval, routing, tablequality
from folia.operators.splitting import split_text
from folia.plans import oracles
from folia.sources import tables as S
from folia.streaming import latency

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spread(S.table(spark, sf_dir, "documents"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.text_blocks(docs(spark, sf_dir))


def pages_of(rows: DataFrame) -> DataFrame:
    """Pages of plain-text blocks: their lines, in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    out = rows.groupBy("doc_id", "page_num").agg(text.alias("text"), F.first("page_width").alias("page_width"), F.first("page_height").alias("page_height"))
    return out.withColumn("rag_text", F.col("text")).withColumn("page_title", F.substring("text", 1, 80))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts, split."""
    rows = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "source", F.posexplode(split_text(F.col("text"))).alias("pos", "text"))
    return rows.select("doc_id", "source", (F.floor(F.col("pos") / 2) + 1).cast("int").alias("page_num"), (F.col("pos") + 1).alias("chunk_index"), "text", F.lit("text").alias("chunk_type"), F.lit("").alias("visual_type"))


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.with_coverage(chunks(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks with ids, scored, and the chunks that represent each document, in page order."""
    picked = retrieval.select_coverage(covered(spark, sf_dir), retrieval.coverage_budget(8))
    return picked.orderBy(F.col("doc_id").cast("bigint"), "page_num", "chunk_index")


# Pieces of SQL that several oracles share. RE2 has no \\h, so classes are spelled out.
def _clean(c: str) -> str:
    lines = f"regexp_replace(replace(replace(coalesce({c}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({lines}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _normal(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


BLOCKS_SQL = r"""
    lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
    blocks AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(line // 20 + 1 AS INTEGER) AS page_num, CAST(line AS INTEGER) AS seq,
        CASE WHEN contains(text, '|') THEN 'table' WHEN length(text) < 24 THEN 'title' ELSE 'text' END AS type, text,
        CAST(CASE WHEN line % 3 = 2 THEN 320.0 ELSE 50.0 END AS DOUBLE) AS x0, CAST(40.0 + (line % 20) * 36.0 AS DOUBLE) AS y0,
        CAST(CASE WHEN line % 3 = 2 THEN 320.0 ELSE 50.0 END + least(250.0, length(text) * 2.0) AS DOUBLE) AS x1, CAST(62.0 + (line % 20) * 36.0 AS DOUBLE) AS y1
        FROM lines WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')
"""
PAGES_SQL = BLOCKS_SQL + r""", pages_ AS (SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY seq) AS text FROM blocks GROUP BY ALL)"""


# --- text ----------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, length({_clean('text')}) AS clean_chars, length({_normal('text')}) AS normal_chars,
    CASE WHEN length({_normal('text')}) = 0 THEN 0 ELSE greatest(1, (length({_normal('text')}) + 3) // 4) END AS tokens, greatest(1, length({_clean('text')}) // 4) AS chunk_tokens, md5({_clean('text')}) AS digest FROM documents""")
def clean_text_stats(spark, sf_dir):
    staged = docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("clean"), T.normalize_text(F.col("text")).alias("normal"))
    clean, normal = F.col("clean"), F.col("normal")
    return staged.select("doc_id", F.length(clean).cast("bigint").alias("clean_chars"), F.length(normal).cast("bigint").alias("normal_chars"), T.estimate_tokens(normal).cast("bigint").alias("tokens"), T.chunk_tokens(clean).cast("bigint").alias("chunk_tokens"), F.md5(clean.cast("binary")).alias("digest"))


@query(rf"""SELECT doc_id, CASE WHEN length({_normal('text')}) <= 600 THEN {_normal('text')} ELSE regexp_replace(substr({_normal('text')}, 1, 597), '\s+$', '') || '...' END AS preview FROM documents""")
def evidence_preview(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.evidence_preview(F.col("text")).alias("preview"))


@query("""SELECT doc_id, md5(source || '/' || doc_id) AS document_id, substr(md5('text::' || doc_id || '::' || lang), 1, 12) AS stable_id,
    'vec_' || substr(sha256(doc_id || '|' || source || '|' || lang || '|1|' || doc_id || '|text'), 1, 24) AS record_id FROM documents""")
def stable_record_ids(spark, sf_dir):
    c = F.col
    return docs(spark, sf_dir).select(
        "doc_id", K.document_id(F.concat("source", F.lit("/"), c("doc_id").cast("string"))).alias("document_id"), K.stable_id(F.lit("text"), c("doc_id"), c("lang")).alias("stable_id"),
        K.vector_record_id(c("doc_id"), c("source"), c("lang"), F.lit(1), c("doc_id"), F.lit("text"), c("doc_id")).alias("record_id"),
    )


@query(r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\d[\d,]*(?:\.\d+)?(?:\s*[%]|[A-Za-z]{1,4})?')) AS metrics,
    len(regexp_extract_all(coalesce(text, ''), '(?:\+?\d[\d\s().-]{6,}\d)')) AS phones, len(regexp_extract_all(coalesce(text, ''), '(?i)\b(?:[1-4]Q\d{2,4}|20\d{2}[./-]?\d{0,2})\b')) AS periods,
    len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS n_lines FROM documents""")
def text_signals(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return docs(spark, sf_dir).select("doc_id", T.metric_like(text).cast("bigint").alias("metrics"), F.regexp_count(text, F.lit(T.PHONE)).cast("bigint").alias("phones"), F.regexp_count(text, F.lit(T.PERIOD)).cast("bigint").alias("periods"), F.size(T.lines(text)).cast("bigint").alias("n_lines"))


def _any(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


@query(rf"""WITH d AS (SELECT doc_id, text, lower({_normal('text')}) AS t FROM documents)
    SELECT doc_id, {_any('t', T.BOILERPLATE)} AS boilerplate, ({_any('t', T.CONTACT)} OR regexp_matches(t, '(?:\+\d{{1,3}}[\s\-]?)?(?:\d{{2,4}}[\s\-]?){{2,}}\d{{3,4}}')) AS contact_noise,
    regexp_matches(text, '(?i)(?:\d[\d,.\-]*\s*(?:%|bp|bps|x|배|건|명|원|달러|usd|krw|억원|백만원|천만원|million|billion|mn|bn))|(?:roe|bps|eps|ebitda|cagr|margin|growth|revenue|sales|profit|income|cash flow|guidance)') AS metric_signal FROM d""")
def noise_predicates(spark, sf_dir):
    clean = T.coverage_text(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", T.boilerplate(clean).alias("boilerplate"), T.contact_noise(clean).alias("contact_noise"), T.metric_signal(F.col("text")).alias("metric_signal"))


@query()
def text_predicates(spark, sf_dir):
    t = F.col("text")
    named = {"title_only": T.title_only(t), "numeric_heavy": T.numeric_heavy(t), "sparse_list": T.sparse_list(t), "dense_body": T.dense_body(t), "explanatory": T.explanatory(t), "meaningful_visual": T.meaningful_visual(t), "contactish": T.contactish(t)}
    return docs(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in named.items()), T.sentence_parts(t).cast("bigint").alias("sentences"), T.sentence_ends(t).cast("bigint").alias("sentence_ends"))


@query()
def token_metrics(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.metric_tokens(t), " ").alias("metrics"), F.array_join(T.period_tokens(t), " ").alias("periods"), F.size(T.label_candidates(t)).alias("labels"), T.trend(T.metric_tokens(t), T.period_tokens(t), t).alias("trend"))


@query(r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 4 WHEN 0 THEN ' see Page ' || (turn + 1) WHEN 1 THEN ' p. ' || conv_id % 100 WHEN 2 THEN ' ' || turn || ' 페이지' ELSE '' END AS text FROM conversations)
    SELECT conv_id, turn, CAST(coalesce(nullif(regexp_extract(text, '(?i)\bpage\s*(\d{1,4})\b', 1), ''), nullif(regexp_extract(text, '(?i)\bp\.\s*(\d{1,4})\b', 1), ''), nullif(regexp_extract(text, '(\d{1,4})\s*페이지', 1), '')) AS INTEGER) AS expected_page,
      length(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS key_chars FROM c""")
def conversation_keys(spark, sf_dir):
    """The pages that turns name, with a page added to three of four."""
    n = F.col("turn")
    said = F.when(n % 4 == 0, F.concat(F.lit(" see Page "), (n + 1).cast("string"))).when(n % 4 == 1, F.concat(F.lit(" p. "), (F.col("conv_id") % 100).cast("string"))).when(n % 4 == 2, F.concat(F.lit(" "), n.cast("string"), F.lit(" 페이지"))).otherwise("")
    t = F.concat(F.coalesce("text", F.lit("")), said)
    return S.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.expected_page(t).alias("expected_page"), F.length(T.normalized_key(t)).cast("bigint").alias("key_chars"))


@query("""WITH n AS (SELECT conv_id, string_agg('[' || turn || '] document=' || role || ' page=' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id)
    SELECT conv_id AS request_id, md5(context) AS digest, length(context) AS chars FROM n""")
def context_format(spark, sf_dir):
    rows = S.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("rank"), F.col("role").alias("filename"), F.col("turn").alias("page"), "text")
    return retrieval.context(rows).select("request_id", F.md5(F.col("context").cast("binary")).alias("digest"), F.length("context").cast("bigint").alias("chars"))


# --- blocks and chunks ---------------------------------------------------------------------------------------------


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, page_num, seq, type, md5(text) AS digest, x0, y0, x1, y1 FROM blocks")
def block_explode(spark, sf_dir):
    b = F.col("bbox")
    return blocks(spark, sf_dir).select("doc_id", "page_num", "seq", "type", F.md5(F.col("text").cast("binary")).alias("digest"), G.x0(b).alias("x0"), G.y0(b).alias("y0"), G.x1(b).alias("x1"), G.y1(b).alias("y1"))


@query(rf"""WITH RECURSIVE c AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_clean('text')} AS t FROM documents),
    s AS (SELECT doc_id, t, 0 AS pos, 0 AS start, 0 AS stop, FALSE AS done FROM c WHERE length(t) > 1400
      UNION ALL SELECT doc_id, t, pos + 1, stop, CASE WHEN stop2 >= length(t) THEN length(t) ELSE stop2 END, stop2 >= length(t) FROM (
        SELECT *, CASE WHEN from_ + 1400 >= length(t) THEN length(t) WHEN cut > 495 THEN from_ + cut + 1 ELSE from_ + 1400 END AS stop2 FROM (
          SELECT *, greatest(CASE WHEN strpos(reverse(substr(t, from_ + 1, 1100)), chr(10)) = 0 THEN -1 ELSE least(1100, length(t) - from_) - strpos(reverse(substr(t, from_ + 1, 1100)), chr(10)) END,
                             CASE WHEN strpos(reverse(substr(t, from_ + 1, 1100)), ' .') = 0 THEN -1 ELSE least(1100, length(t) - from_) - strpos(reverse(substr(t, from_ + 1, 1100)), ' .') - 1 END) AS cut
          FROM (SELECT *, CASE WHEN pos = 0 THEN 0 ELSE greatest(stop - 120, start + 1) END AS from_ FROM s WHERE NOT done)))),
    p AS (SELECT doc_id, pos, CASE WHEN pos = 1 THEN 0 ELSE NULL END AS x, start, stop, t FROM s WHERE pos > 0),
    short AS (SELECT doc_id, t FROM c WHERE length(t) BETWEEN 1 AND 1400)
    SELECT doc_id, count(*) AS parts, max(stop) AS chars FROM p GROUP BY ALL UNION ALL SELECT doc_id, 1, length(t) FROM short""")
def split_long_text(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), split_text(F.col("text")).alias("parts"), F.length(T.clean_text(F.col("text"))).cast("bigint").alias("chars"))
    return rows.filter(F.size("parts") > 0).select("doc_id", F.size("parts").cast("bigint").alias("parts"), "chars")


@query()
def split_parts(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    return rows.select("doc_id", "chunk_index", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def anchor_groups(spark, sf_dir):
    rows = chunking.completed(blocks(spark, sf_dir)).withColumns({"panel": chunking.panel_key(), "order": chunking.order()}).filter("type in ('text', 'title')")
    grouped = chunking.anchor_groups(rows.select("doc_id", "page_num", "block_id", "text", "panel", "order"))
    return grouped.groupBy("doc_id", "page_num", "group_key").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


@query()
def text_first_chunks(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    out = chunking.text_first_chunks(rows, pages_of(rows))
    return out.select("chunk_id", "doc_id", "page_num", "chunk_index", "chunk_type", "char_len", "token_estimate", F.size("source_block_ids").alias("sources"))


@query()
def native_chunks(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return chunking.native_chunks(pages_of(rows), rows).select("chunk_id", "doc_id", "page_num", "chunk_index", "chunk_type", "char_len")


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, 'lines' AS strategy_name, count(*) AS total_chunks, round(avg(length(text)), 2) AS avg_char_len, min(length(text)) AS min_char_len, max(length(text)) AS max_char_len,
    count(DISTINCT page_num) AS page_coverage_count, array_to_string(list_sort(list(DISTINCT page_num)), ',') AS page_coverage, count(*) FILTER (trim(text) = '') AS empty_chunks, CAST(sum(length(text)) AS BIGINT) AS total_chars FROM blocks GROUP BY doc_id""")
def chunk_summary(spark, sf_dir):
    rows = blocks(spark, sf_dir).select("doc_id", "page_num", F.lit("lines").alias("strategy_name"), F.col("text").alias("retrieval_text"), F.length("text").cast("bigint").alias("char_len"))
    return chunking.summary(rows)


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, 'lines' AS strategy_name, type AS chunk_type, count(*) AS n FROM blocks GROUP BY ALL""")
def chunk_types(spark, sf_dir):
    return chunking.type_distribution(blocks(spark, sf_dir).select("doc_id", F.lit("lines").alias("strategy_name"), F.col("type").alias("chunk_type")))


@query("""SELECT kind, name, n FROM (SELECT CASE WHEN grouping(source) = 0 THEN 'strategy' ELSE 'document' END AS kind, coalesce(source, lang) AS name, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (lang)))""")
def strategy_distribution(spark, sf_dir):
    return metadata.distributions(docs(spark, sf_dir).select(F.col("source").alias("strategy_name"), F.col("lang").alias("doc_id")))


@query(f"""SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, 'vec_' || substr(sha256(d.doc_id || '|' || source || '|' || 'c' || d.doc_id || '|1|' || d.doc_id || '|text'), 1, 24) AS vector_record_id, length({_normal('text')}) AS char_len,
    CASE WHEN length({_normal('text')}) = 0 THEN 0 ELSE greatest(1, (length({_normal('text')}) + 3) // 4) END AS token_estimate, {_normal('text')} <> '' AS has_text, coalesce(l.q, '') AS quality_grade, FALSE AS has_table FROM documents d
    LEFT JOIN (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 'A' ELSE 'F' END AS q FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id""")
def metadata_contract(spark, sf_dir):
    grades = S.table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.when(F.max("quality") == 1, "A").otherwise("F").alias("quality_grade"))
    d = F.col("doc_id").cast("string")
    rows = docs(spark, sf_dir).select(d.alias("doc_id"), F.col("source").alias("strategy_name"), F.concat(F.lit("c"), d).alias("chunk_id"), F.lit("1").alias("page_num"), d.alias("chunk_index"), F.lit("text").alias("chunk_type"), F.col("text").alias("retrieval_text"))
    return metadata.contract(rows, grades).select("doc_id", "vector_record_id", F.col("char_len").cast("bigint").alias("char_len"), F.col("token_estimate").cast("bigint").alias("token_estimate"), "has_text", "quality_grade", "has_table")


@query()
def sparse_pages(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return chunking.sparse_pages(pages_of(rows), rows)


@query()
def visual_records(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    pages = pages_of(rows)
    tables = chunking.table_records(rows).select("doc_id", "page_num", "visual_type", "gate", F.length("retrieval_text").alias("chars"))
    charts = chunking.chart_records(rows, pages)
    like = chunking.chart_like_pages(pages, rows, charts).select("doc_id", "page_num", "visual_type", "gate", F.length("retrieval_text").alias("chars"))
    return tables.unionByName(charts.select("doc_id", "page_num", "visual_type", "gate", F.length("retrieval_text").alias("chars"))).unionByName(like)


@query()
def html_blocks(spark, sf_dir):
    rows = S.html_blocks(S.table(spark, sf_dir, "pages"))
    return rows.groupBy("doc_id", "type").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


@query()
def markdown_blocks(spark, sf_dir):
    return S.markdown_blocks(docs(spark, sf_dir)).select("doc_id", "seq", "type", F.length("text").alias("chars"))


# --- tables --------------------------------------------------------------------------------------------------------


def order_tables(spark, sf_dir) -> DataFrame:
    """A table per order: its lines as rows, under a header."""
    cells = ("l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    lines = S.table(spark, sf_dir, "lineitem").select("l_orderkey", *cells).repartition("l_orderkey")  # as numbers: texts in lists are twice as large
    rows = lines.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list(F.array(*(F.col(c).cast("string") for c in cells)))).alias("data"))
    head = F.array(*(F.lit(c.removeprefix("l_")) for c in cells))
    return rows.select("table_id", head.alias("headers"), F.concat(F.array(head), "data").alias("rows"))


@query("""WITH o AS (SELECT l_orderkey, list_sort(list([CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_quantity AS VARCHAR), l_returnflag, l_linestatus])) AS data FROM lineitem GROUP BY 1),
    r AS (SELECT l_orderkey AS table_id, unnest(data) AS row_, generate_subscripts(data, 1) - 1 AS row_index FROM o WHERE len(data) >= 2),
    c AS (SELECT table_id, row_index, unnest(row_) AS value, generate_subscripts(row_, 1) - 1 AS column_index, row_[1] AS row_label FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_index, column_index) AS n FROM c WHERE column_index > 0)
    SELECT table_id, CAST(row_index AS INTEGER) AS row_index, CAST(column_index AS INTEGER) AS column_index, row_label, (['linenumber', 'partkey', 'quantity', 'returnflag', 'linestatus'])[column_index + 1] AS column_label, value FROM k WHERE n <= 72""")
def table_unpivot(spark, sf_dir):
    return chunking.unpivoted(order_tables(spark, sf_dir)).filter("record = 'cell'").drop("record")


@query()
def table_rows(spark, sf_dir):
    return chunking.unpivoted(order_tables(spark, sf_dir)).filter("record = 'row'").select("table_id", "row_index", "row_label", "value")


@query()
def table_quality(spark, sf_dir):
    rows = tablequality.measured(order_tables(spark, sf_dir))
    return rows.select("table_id", "n_rows", "n_cols", "numeric_cols", *(F.round(c, 6).alias(c) for c in tablequality.RATIOS), "ready")


@query(f"""WITH {oracles._QUALITY} SELECT table_id, CAST(n_rows AS BIGINT) AS n_rows, n_cols, numeric_cols, round(CAST(stable AS DOUBLE), 9) AS row_stability FROM q""")
def table_shape(spark, sf_dir):
    rows = tablequality.measured(order_tables(spark, sf_dir))
    return rows.select("table_id", F.col("n_rows").cast("bigint").alias("n_rows"), "n_cols", "numeric_cols", F.round("row_stability", 9).alias("row_stability"))


@query("""WITH g AS (SELECT r_name, list_sort(list([n_name, CAST(n_nationkey AS VARCHAR)])) AS d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
    SELECT r_name, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(d, lambda x: '| ' || x[1] || ' | ' || x[2] || ' |'), chr(10)) AS markdown FROM g""")
def table_markdown(spark, sf_dir):
    nations, regions = S.table(spark, sf_dir, "nation"), S.table(spark, sf_dir, "region")
    rows = nations.join(regions, nations.n_regionkey == regions.r_regionkey).groupBy("r_name").agg(F.array_sort(F.collect_list(F.array("n_name", F.col("n_nationkey").cast("string")))).alias("d"))
    return rows.select("r_name", TB.markdown(F.array(F.lit("name"), F.lit("key")), F.col("d")).alias("markdown"))


@query()
def best_table(spark, sf_dir):
    """Of each customer's orders as tables, the one of best quality."""
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = tablequality.measured(order_tables(spark, sf_dir)).join(orders, F.col("table_id") == F.col("o_orderkey"))
    key = F.struct(F.round("overall", 9), F.round("header_likelihood", 9), F.round("row_stability", 9), F.round(-F.col("empty_cell_ratio"), 9), F.col("n_rows") * F.col("n_cols"), -F.col("table_id"))
    return rows.groupBy("o_custkey").agg(F.max_by("table_id", key).alias("table_id"), F.round(F.max("overall"), 6).alias("overall"))


@query()
def table_candidates(spark, sf_dir):
    b = F.col("bbox")
    rows = blocks(spark, sf_dir).filter("type = 'table'")
    scored = rows.withColumn("c", TB.candidate_score(F.col("type"), F.col("source"), F.col("text"), TB.text_to_rows(F.col("text")), F.try_divide(G.area(b), F.col("page_width") * F.col("page_height")), F.try_divide(G.width(b), G.height(b))))
    return scored.select("doc_id", "page_num", "seq", F.round("c.score", 6).alias("score"), F.array_join("c.signals", ",").alias("signals"), F.array_join("c.rejects", ",").alias("rejects"))


# --- routing and grading -------------------------------------------------------------------------------------------


@query()
def page_scores(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return routing.page_scores(routing.page_features(pages_of(rows), rows)).select("doc_id", "page_num", "page_type", *(F.round(k, 6).alias(k) for k in routing.DOC_TYPES))


@query()
def document_routes(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return routing.routed(routing.page_scores(routing.page_features(pages_of(rows), rows)))


@query(f"""WITH {BLOCKS_SQL}, b AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (type = 'title') AS titles, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (type = 'text') AS texts FROM blocks GROUP BY 1),
    p AS (SELECT doc_id, count(DISTINCT page_num) AS pages FROM blocks GROUP BY 1),
    s AS (SELECT *, CASE WHEN texts > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS single, CAST(blocks AS DOUBLE) / pages AS dense FROM b JOIN p USING (doc_id)),
    v AS (SELECT *, greatest(0, least(100, 80 + CASE WHEN single > 0.7 THEN -30 WHEN single < 0.2 THEN 10 ELSE 0 END + CASE WHEN dense > 100 THEN -20 WHEN dense > 50 THEN -10 WHEN dense < 20 THEN 5 ELSE 0 END + CASE WHEN titles > 0 THEN 5 ELSE 0 END + CASE WHEN tables > 0 THEN 5 ELSE 0 END + 5)) AS score FROM s)
    SELECT doc_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'F' END AS grade, single AS singleton_ratio, titles, tables FROM v""")
def quality_grade(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return routing.quality_grade(pages_of(rows), rows).drop("blocks_per_page")


@query(rf"""WITH {PAGES_SQL}, l AS (SELECT doc_id, page_num, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM pages_),
    s AS (SELECT doc_id, page_num, 'top' AS place, array_to_string(ls[1:2], ' ') AS raw FROM l UNION ALL SELECT doc_id, page_num, 'bottom', array_to_string(ls[greatest(1, len(ls) - 1):], ' ') FROM l),
    k AS (SELECT doc_id, page_num, place, substr(regexp_replace(regexp_replace(lower(raw), '\d+', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g'), 1, 80) AS sig FROM s)
    SELECT DISTINCT doc_id, page_num FROM k WHERE length(sig) >= 8 AND (doc_id, place, sig) IN (SELECT (doc_id, place, sig) FROM k WHERE length(sig) >= 8 GROUP BY doc_id, place, sig HAVING count(*) >= 2)""")
def repeated_signature(spark, sf_dir):
    return routing.repeated_pages(pages_of(blocks(spark, sf_dir)))


@query(rf"""WITH {BLOCKS_SQL}, k AS (SELECT *, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g') AS k FROM blocks)
    SELECT doc_id, page_num, seq, pages FROM k JOIN (SELECT doc_id, k, count(DISTINCT page_num) AS pages FROM k WHERE k <> '' GROUP BY ALL HAVING pages >= 3) USING (doc_id, k)""")
def repeated_texts(spark, sf_dir):
    return routing.repeated_texts(blocks(spark, sf_dir)).select("doc_id", "page_num", "seq", "pages")


@query(f"""WITH {PAGES_SQL}, g AS (SELECT doc_id, count(*) AS page_count, CAST(sum(length(text)) AS BIGINT) AS total_chars, count(*) FILTER (text = '') AS empty_pages FROM pages_ GROUP BY 1)
    SELECT *, CASE WHEN total_chars / page_count < 50 THEN 'low' WHEN total_chars / page_count < 300 THEN 'medium' ELSE 'high' END AS text_quality FROM g""")
def parse_metadata(spark, sf_dir):
    return routing.parse_metadata(pages_of(blocks(spark, sf_dir)))


# --- retrieval -----------------------------------------------------------------------------------------------------

_PROBE = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def probe(spark, sf_dir, vec_id: int = 0) -> list[float]:
    """The embedding of one stated row."""
    return [float(x) for x in S.table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]]


@query(f"""SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score, CAST(row_number() OVER (ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) DESC, vec_id) AS INTEGER) AS vector_rank FROM embeddings, {_PROBE} QUALIFY vector_rank <= 20""")
def knn_topk(spark, sf_dir):
    return retrieval.knn(S.table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), 20).select("vec_id", F.round("vector_score", 6).alias("score"), "vector_rank")


@query(f"""SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score, CAST(row_number() OVER (ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) DESC, vec_id) AS INTEGER) AS vector_rank FROM embeddings, {_PROBE} WHERE label = 1 QUALIFY vector_rank <= 5""")
def knn_filtered(spark, sf_dir):
    return retrieval.knn(S.table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), 5, keep=F.col("label") == 1).select("vec_id", F.round("vector_score", 6).alias("score"), "vector_rank")


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT query_id, vec_id, list_cosine_similarity(e, q) AS score FROM q, e)
    SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def knn_batch(spark, sf_dir):
    vectors = S.table(spark, sf_dir, "embeddings")
    queries = vectors.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.knn_batch(vectors, queries, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""SELECT vec_id, round(1.0 - (1.0 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))) / 2.0, 6) AS score FROM embeddings, {_PROBE}""")
def distance_score(spark, sf_dir):
    q = F.lit(probe(spark, sf_dir))
    return S.table(spark, sf_dir, "embeddings").select("vec_id", F.round(retrieval.distance_score(1.0 - retrieval.cosine(F.col("embedding"), q)), 6).alias("score"))


_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}](?:[\p{L}\p{N}.,%/-]*[\p{L}\p{N}%])?')"


@query(f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY token""")
def inverted_index(spark, sf_dir):
    return retrieval.postings(docs(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_BM25 = f"""tok AS (SELECT doc_id AS doc, unnest({_TOKENS}) AS token, len({_TOKENS}) AS length FROM documents),
    post AS (SELECT token, doc, length, count(*) AS tf FROM tok GROUP BY ALL), stat AS (SELECT count(*) AS n, avg(len({_TOKENS})) AS mean FROM documents),
    qt AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS})) AS token FROM benchmark), dfs AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
    sc AS (SELECT query_id, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS s FROM qt JOIN post USING (token) JOIN dfs USING (token), stat GROUP BY ALL),
    bm AS (SELECT query_id, doc, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc) AS keyword_rank FROM sc QUALIFY keyword_rank <= 20)"""


def keyword_hits(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    stat = d.agg(F.count("*").alias("n"), F.avg(F.size(T.keyword_tokens(F.col("text")))).alias("mean")).first()
    queries = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    terms = queries.select(F.explode(T.keyword_tokens(F.col("text"))).alias("token")).distinct()
    return retrieval.bm25(retrieval.postings(d, wanted=terms), queries, stat.n, float(stat.mean or 1.0))


@query(f"WITH {_BM25} SELECT query_id, doc, round(s, 6) AS score, CAST(keyword_rank AS INTEGER) AS keyword_rank FROM bm")
def bm25_topk(spark, sf_dir):
    return keyword_hits(spark, sf_dir).select("query_id", "doc", F.round("keyword_score", 6).alias("score"), "keyword_rank")


def vector_hits(spark, sf_dir) -> DataFrame:
    """Vector candidates of each benchmark item: neighbours of the vector of its number, as documents."""
    vectors = S.table(spark, sf_dir, "embeddings")
    queries = vectors.join(S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.knn_batch(vectors, queries, 20).select("query_id", F.col("vec_id").alias("doc"), F.col("rank").alias("vector_rank"))


_VEC = """vs AS (SELECT q.vec_id AS query_id, e.vec_id AS doc, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings e),
    vr AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc) AS vector_rank FROM vs QUALIFY vector_rank <= 20)"""
_RRF = """both_ AS (SELECT query_id, doc, vector_rank, NULL AS keyword_rank FROM vr UNION ALL SELECT query_id, doc, NULL, keyword_rank FROM bm),
    fu AS (SELECT query_id, doc, sum(coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + keyword_rank), 0)) AS s, count(*) AS sources, min(vector_rank) AS v, min(keyword_rank) AS k FROM both_ GROUP BY ALL),
    ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, sources DESC, coalesce(v, 10000), coalesce(k, 10000), doc) AS hybrid_rank FROM fu QUALIFY hybrid_rank <= 30)"""


@query(f"WITH {_BM25}, {_VEC}, {_RRF} SELECT query_id, doc, round(s, 9) AS rrf_score, sources, CAST(v AS INTEGER) AS vector_rank, CAST(k AS INTEGER) AS keyword_rank, CAST(hybrid_rank AS INTEGER) AS hybrid_rank FROM ra")
def rrf_fusion(spark, sf_dir):
    fused = retrieval.rrf(vector_hits(spark, sf_dir), keyword_hits(spark, sf_dir))
    return fused.select("query_id", "doc", F.round("rrf_score", 9).alias("rrf_score"), "sources", "vector_rank", "keyword_rank", "hybrid_rank")


@query()
def qa_rerank(spark, sf_dir):
    fused = retrieval.rrf(vector_hits(spark, sf_dir), keyword_hits(spark, sf_dir))
    queries = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.qa_rerank(fused, docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text"), queries).select("query_id", "doc", F.round("qa_rank_score", 6).alias("score"), "is_boilerplate", "qa_rank")


@query()
def coverage_score(spark, sf_dir):
    return covered(spark, sf_dir).select("doc_id", "page_num", "chunk_index", "coverage")


@query()
def best_chunk_per_page(spark, sf_dir):
    return retrieval.best_per_page(covered(spark, sf_dir)).select("doc_id", "page_num", "chunk_index", "coverage")


@query()
def page_priority(spark, sf_dir):
    return retrieval.page_priority(covered(spark, sf_dir)).select("doc_id", "page_num", F.round("priority", 6).alias("priority"))


@query()
def coverage_selection(spark, sf_dir):
    return retrieval.select_coverage(covered(spark, sf_dir), retrieval.coverage_budget(8))


def summary_candidates(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir)
    s = retrieval.summary_score(F.col("text"), F.col("source"), F.col("chunk_type"), F.lit(False), F.lit(True), 1.0 / (60 + F.col("chunk_index")))
    return c.withColumn("s", s)


@query()
def summary_scores(spark, sf_dir):
    return summary_candidates(spark, sf_dir).select("doc_id", "chunk_index", F.round("s.score", 6).alias("score"), F.array_join("s.penalties", ",").alias("penalties"))


@query()
def summary_rerank(spark, sf_dir):
    rows = summary_candidates(spark, sf_dir).select(F.col("doc_id").alias("request_id"), F.col("chunk_index").alias("doc"), F.col("page_num").cast("string").alias("page"), F.concat("source", F.lit("-"), (F.col("page_num") % 3).cast("string")).alias("section"), F.round("s.score", 9).alias("score"))
    return retrieval.diversified(rows, 8).select("request_id", "doc", F.round("score", 6).alias("score"), "rank")


@query("""WITH c AS (SELECT l_suppkey AS request_id, 'part' || (l_partkey % 3) AS filename, l_linenumber + CAST(l_partkey % 40 AS INTEGER) AS page, l_extendedprice AS score, l_orderkey * 10 + l_linenumber AS doc_rank FROM lineitem),
    b AS (SELECT request_id, filename, page, score, doc_rank, row_number() OVER (PARTITION BY request_id, filename, page ORDER BY score DESC, doc_rank) AS n FROM c QUALIFY n = 1),
    i AS (SELECT *, CASE WHEN page - lag(page) OVER w <= 1 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY request_id, filename ORDER BY page)), r AS (SELECT *, sum(new) OVER (PARTITION BY request_id, filename ORDER BY page) AS run FROM i)
    SELECT request_id, filename, page, score, doc_rank, count(*) OVER (PARTITION BY request_id, filename, run) AS pages FROM r QUALIFY row_number() OVER (PARTITION BY request_id, filename, run ORDER BY score DESC, doc_rank) = 1""")
def source_clusters(spark, sf_dir):
    c = F.col
    rows = S.table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("request_id"), F.concat(F.lit("part"), (c("l_partkey") % 3).cast("string")).alias("filename"), (c("l_linenumber") + (c("l_partkey") % 40).cast("int")).alias("page"), c("l_extendedprice").alias("score"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("doc_rank"))
    return retrieval.source_clusters(rows)


@query("""SELECT l_suppkey AS request_id, 'part' || (l_partkey % 3) AS filename, l_linenumber AS page, min(l_orderkey) AS doc_rank FROM lineitem GROUP BY ALL""")
def distinct_sources(spark, sf_dir):
    c = F.col
    return retrieval.distinct_sources(S.table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("request_id"), F.concat(F.lit("part"), (c("l_partkey") % 3).cast("string")).alias("filename"), c("l_linenumber").alias("page"), c("l_orderkey").alias("doc_rank")))


@query()
def answer_sources(spark, sf_dir):
    """Sources of the benchmark items taken as answers, from their keyword candidates."""
    items = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("answer"))
    hits = keyword_hits(spark, sf_dir).withColumnRenamed("query_id", "request_id").join(items, "request_id").join(docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text", "source"), "doc")
    tokens = T.keyword_tokens(F.col("text"))
    score = retrieval.candidate_score(F.lit(0.0), retrieval.source_profile(F.col("answer")), tokens, F.col("keyword_rank"), F.lit(None).cast("int"), F.lit(False))
    rows = hits.select("request_id", F.col("source").alias("filename"), F.col("doc").alias("page"), score.alias("score"), F.col("keyword_rank").alias("doc_rank"), tokens.alias("doc_tokens"))
    return retrieval.answer_sources(rows, items).select("request_id", "rank", "filename", "page", F.round("total", 6).alias("total"))


# --- index ---------------------------------------------------------------------------------------------------------


@query("""SELECT vec_id, label, source, n_chars FROM embeddings JOIN documents ON doc_id = vec_id""")
def vector_payload(spark, sf_dir):
    meta = docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "source", "n_chars")
    return index.payload(S.table(spark, sf_dir, "embeddings").select("vec_id", "label"), meta, "vec_id")


@query("""SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def failed_ids(spark, sf_dir):
    return index.failed(S.table(spark, sf_dir, "embeddings"), S.table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id")), "vec_id")


@query("""SELECT count(*) AS total, count(*) FILTER (vec_id IN (SELECT doc_id FROM labels)) AS succeeded, count(*) FILTER (vec_id NOT IN (SELECT doc_id FROM labels)) AS failed FROM embeddings""")
def ingest_summary(spark, sf_dir):
    return index.ingest_summary(S.table(spark, sf_dir, "embeddings"), S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id")


@query("""SELECT vec_id, label FROM embeddings WHERE vec_id % 10 <> 3 UNION ALL SELECT vec_id, -1 FROM embeddings WHERE vec_id % 10 = 3 UNION ALL SELECT vec_id + 1000000, -1 FROM embeddings WHERE vec_id % 10 = 4""")
def upsert(spark, sf_dir):
    now = S.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    old, added = now.filter("vec_id % 10 = 3").withColumn("label", F.lit(-1)), now.filter("vec_id % 10 = 4").select((F.col("vec_id") + 1000000).alias("vec_id"), F.lit(-1).alias("label"))
    return index.upserted(now, old.unionByName(added), "vec_id")


@query("""SELECT doc_id, source FROM documents WHERE doc_id <> 7""")
def delete_document(spark, sf_dir):
    return index.without_document(docs(spark, sf_dir).select("doc_id", "source"), 7)


@query(f"""WITH {BLOCKS_SQL} SELECT source AS filename, count(*) AS chunk_count, count(DISTINCT page_num) AS page_count, array_to_string(list_sort(list(DISTINCT lang)), ',') AS strategies FROM blocks JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, lang FROM documents) USING (doc_id) GROUP BY source""")
def catalogue(spark, sf_dir):
    names = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("filename"), F.col("lang").alias("strategy_name"))
    return index.catalogue(blocks(spark, sf_dir).select("doc_id", "page_num").join(names, "doc_id"))


def job_events(spark, sf_dir) -> DataFrame:
    c = F.col
    status = F.when(c("event_type") == "signup", "queued").when(c("event_type") == "purchase", "completed").when(c("event_type") == "error", "failed").otherwise("running")
    return S.table(spark, sf_dir, "events").select(c("user_id").cast("string").alias("job_id"), status.alias("status"), F.least(F.lit(100), F.greatest(F.lit(0), c("value"))).cast("int").alias("progress"), "ts", "event_id")


@query("""WITH j AS (SELECT CAST(user_id AS VARCHAR) AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts, event_id FROM events)
    SELECT job_id, status, ts AS updated_at, count(*) OVER (PARTITION BY job_id) AS n_events FROM j QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1""")
def job_state(spark, sf_dir):
    return index.latest_jobs(job_events(spark, sf_dir)).select("job_id", "status", "updated_at", "n_events")


@query("""WITH d AS (SELECT source AS filename, count(*) AS docs FROM documents GROUP BY 1), j AS (SELECT 'src' || (user_id % 30) AS filename, arg_max(event_type, event_id) AS status FROM events GROUP BY 1)
    SELECT filename, docs, coalesce(status, 'ready') AS status FROM d FULL JOIN j USING (filename)""")
def pending_jobs(spark, sf_dir):
    have = docs(spark, sf_dir).groupBy(F.col("source").alias("filename")).agg(F.count("*").alias("docs"))
    jobs = S.table(spark, sf_dir, "events").groupBy(F.concat(F.lit("src"), (F.col("user_id") % 30).cast("string")).alias("filename")).agg(F.max_by("event_type", "event_id").alias("status")).withColumn("progress", F.lit(0))
    return index.with_jobs(have, jobs).select("filename", "docs", "status")


@query(f"""SELECT sha256({_normal('text')}) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1""")
def dedup_exact(spark, sf_dir):
    return index.exact_duplicates(docs(spark, sf_dir))


# --- layout --------------------------------------------------------------------------------------------------------


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, page_num, seq, CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY floor(y0 / 20), x0, seq) - 1 AS INTEGER) AS rag_order FROM blocks""")
def reading_order(spark, sf_dir):
    return layout.reading_order(blocks(spark, sf_dir)).select("doc_id", "page_num", "seq", "rag_order")


@query(f"""WITH {BLOCKS_SQL}, p AS (SELECT b.doc_id, b.page_num, b.seq, h.seq AS heading_seq, b.y0 - h.y1 AS gap FROM blocks b JOIN blocks h ON b.doc_id = h.doc_id AND b.page_num = h.page_num AND h.type = 'title' AND b.type <> 'title' AND b.y0 - h.y1 BETWEEN -10 AND 200),
    k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, page_num, seq ORDER BY abs(gap), heading_seq) = 1)
    SELECT b.doc_id, b.page_num, b.seq, k.heading_seq, k.gap FROM blocks b LEFT JOIN k ON b.doc_id = k.doc_id AND b.page_num = k.page_num AND b.seq = k.seq WHERE b.type <> 'title'""")
def nearest_heading(spark, sf_dir):
    return layout.nearest_heading(blocks(spark, sf_dir)).select("doc_id", "page_num", "seq", "heading_seq", "gap")


@query(f"""WITH {BLOCKS_SQL}, p AS (SELECT a.doc_id, a.page_num, a.seq, t.seq AS r_seq, greatest(0, t.y0 - a.y1, a.y0 - t.y1) + greatest(0, t.x0 - a.x1, a.x0 - t.x1) AS distance,
      greatest(0, least(a.x1 + 24, t.x1) - greatest(a.x0 - 24, t.x0)) * greatest(0, least(a.y1 + 60, t.y1) - greatest(a.y0 - 60, t.y0)) / least((a.x1 - a.x0 + 48) * (a.y1 - a.y0 + 120), (t.x1 - t.x0) * (t.y1 - t.y0)) AS share
      FROM blocks a JOIN blocks t ON a.doc_id = t.doc_id AND a.page_num = t.page_num AND a.seq <> t.seq WHERE a.type = 'table' AND t.type <> 'table')
    SELECT doc_id, page_num, seq, CAST(row_number() OVER (PARTITION BY doc_id, page_num, seq ORDER BY distance, r_seq) AS INTEGER) AS rank, r_seq, distance FROM p WHERE share >= 0.2 QUALIFY rank <= 4""")
def spatial_topk(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return layout.nearby_texts(b.filter("type = 'table'"), b.filter("type <> 'table'"))


@query()
def region_argmax(spark, sf_dir):
    b = blocks(spark, sf_dir)
    regions = b.select("doc_id", "page_num").distinct().select("doc_id", "page_num", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("region")).withColumn("bbox", F.array((F.col("region") % 2) * 297.5, F.floor(F.col("region") / 2) * 280.0, (F.col("region") % 2 + 1) * 297.5, (F.floor(F.col("region") / 2) + 1) * 280.0))
    return layout.best_region(b, regions)


@query(f"""WITH {BLOCKS_SQL} SELECT t.doc_id, t.page_num, t.seq FROM blocks t WHERE t.type <> 'table' AND NOT EXISTS (SELECT 1 FROM blocks x WHERE x.type = 'table' AND x.doc_id = t.doc_id AND x.page_num = t.page_num
    AND greatest(0, least(t.x1, x.x1 + 40) - greatest(t.x0, x.x0 - 40)) * greatest(0, least(t.y1, x.y1 + 40) - greatest(t.y0, x.y0 - 40)) >= 0.5 * (t.x1 - t.x0) * (t.y1 - t.y0) AND t.x1 > t.x0)""")
def overlap_anti(spark, sf_dir):
    b = blocks(spark, sf_dir)
    wide = b.filter("type = 'table'").withColumn("bbox", G.expanded(F.col("bbox"), 40.0, 40.0))
    return layout.outside_tables(b.filter("type <> 'table'"), wide).select("doc_id", "page_num", "seq")


@query(f"""WITH {BLOCKS_SQL}, l AS (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER w) < 40 THEN 0 ELSE 1 END AS new FROM blocks WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY y0, x0, seq)) SELECT doc_id, page_num, seq, sum(new) OVER (PARTITION BY doc_id, page_num ORDER BY y0, x0, seq) AS line FROM l""")
def line_islands(spark, sf_dir):
    return layout.line_islands(blocks(spark, sf_dir), 40.0).select("doc_id", "page_num", "seq", "line")


@query(f"""WITH {BLOCKS_SQL} SELECT a.doc_id, a.page_num, a.seq, count(b.seq) AS neighbours FROM blocks a LEFT JOIN blocks b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.seq <> b.seq AND abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= 0.055 * 842 AND least(a.x1, b.x1) > greatest(a.x0, b.x0) GROUP BY ALL""")
def neighbour_counts(spark, sf_dir):
    return layout.neighbour_counts(blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, page_num, seq, md5(last_value(CASE WHEN type = 'title' THEN text END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS title_before, md5(first_value(CASE WHEN type = 'text' THEN text END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS text_after FROM blocks WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY seq)""")
def previous_title(spark, sf_dir):
    rows = layout.previous_title(blocks(spark, sf_dir))
    return rows.select("doc_id", "page_num", "seq", F.md5(F.col("title_before").cast("binary")).alias("title_before"), F.md5(F.col("text_after").cast("binary")).alias("text_after"))


@query(f"""WITH {BLOCKS_SQL}, g AS (SELECT *, greatest(0.0, y0 - lag(y1) OVER w) AS gap FROM blocks WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY y0, x0, seq)), m AS (SELECT doc_id, page_num, median(gap) AS mg FROM g GROUP BY ALL),
    n AS (SELECT g.*, CASE WHEN gap <= greatest(2.4 * mg, 0.03 * 842) THEN 0 ELSE 1 END AS new FROM g JOIN m USING (doc_id, page_num)), p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_num ORDER BY y0, x0, seq) AS paragraph FROM n)
    SELECT doc_id, page_num, paragraph, count(*) AS n_lines, min(y0) AS top, max(y1) AS bottom FROM p GROUP BY ALL""")
def paragraphs(spark, sf_dir):
    return layout.paragraphs(blocks(spark, sf_dir)).select("doc_id", "page_num", "paragraph", "n_lines", G.y0(F.col("bbox")).alias("top"), G.y1(F.col("bbox")).alias("bottom"))


@query()
def page_titles(spark, sf_dir):
    return layout.page_title(blocks(spark, sf_dir)).select("doc_id", "page_num", "page_title", "points")


@query()
def rag_text(spark, sf_dir):
    return layout.rag_text(blocks(spark, sf_dir)).select("doc_id", "page_num", F.length("rag_text").alias("chars"), F.md5(F.col("rag_text").cast("binary")).alias("digest"))


@query()
def captions(spark, sf_dir):
    return layout.captions(blocks(spark, sf_dir)).select("doc_id", "page_num", "seq", "caption_seq")


@query()
def block_dedupe(spark, sf_dir):
    return layout.deduplicated(blocks(spark, sf_dir)).select("doc_id", "page_num", "seq")


@query()
def paragraph_merge(spark, sf_dir):
    return layout.merged_paragraphs(blocks(spark, sf_dir)).select("doc_id", "page_num", "seq", "type", F.length("text").alias("chars"))


@query()
def greedy_clusters(spark, sf_dir):
    return layout.clustered(blocks(spark, sf_dir))


@query()
def fragment_absorb(spark, sf_dir):
    return layout.absorbed_fragments(blocks(spark, sf_dir)).select("doc_id", "page_num", "seq", F.length("text").alias("chars"))


@query()
def structured_text(spark, sf_dir):
    return layout.structured_text(pages_of(blocks(spark, sf_dir))).select("doc_id", "page_num", "seq", "type", F.length("text").alias("chars"))


# --- streams -------------------------------------------------------------------------------------------------------


@query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type AS stage, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS total_ms, round(max(value), 4) AS max_ms FROM events GROUP BY ALL""")
def latency_tumbling(spark, sf_dir):
    return latency.tumbling(latency.latency_events(S.table(spark, sf_dir, "events")))


@query("""SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean_ms, round(median(value), 6) AS median_ms, min(value) AS min_ms FROM events GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    return latency.percentiles(latency.latency_events(S.table(spark, sf_dir, "events")))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS request_id, ts, value FROM events), n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY request_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM e),
    s AS (SELECT *, sum(new) OVER (PARTITION BY request_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n) SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 minute AS session_end, request_id, count(*) AS n, round(sum(value), 4) AS total_ms FROM s GROUP BY request_id, k""")
def latency_sessions(spark, sf_dir):
    return latency.sessions(latency.latency_events(S.table(spark, sf_dir, "events")))

ORACLES |= oracles.oracles(BLOCKS_SQL.strip(), PAGES_SQL.strip(), _BM25, _VEC, _RRF)

from folia.plans import documents  # noqa: E402, F401  registers further queries
