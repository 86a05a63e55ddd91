"""What steps cost as tables grow: plans and memory, beside results against the plain way."""

import pytest
from pyspark.sql import functions as F

from folia.functions import text as T


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


WHITE = " \t\n\x0b\x0c\r\x85\xa0    　"
ODD = ["", WHITE, "a", f"{WHITE}a  b{WHITE}", "a\r\n\r\rb", "a \t b\n\n\n\nc", "\x1ca\x1f", "a​b​", "가　　나 ", "a\n \n \nb", None]


def test_cleaning_equals_patterns(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "t string")
    whole = F.coalesce("t", F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    clean = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"\r\n?", "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    got = rows.select(T.strip(whole), T.clean_text(F.col("t")), T.normalize_text(F.col("t"))).collect()
    assert got == rows.select(strip(whole), clean, strip(F.regexp_replace(whole, r"(?U)\s+", " "))).collect()


def test_clean_cells_meet_no_pattern_and_methods_are_compiled(spark, small):
    import __spark_entry__ as entry

    rows = entry.queries()["cell_fields"](spark, small)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    assert "s+" not in plan(rows.select("cell_value"))


def test_order_tables_are_dealt_as_numbers(spark, small):
    from folia.plans import catalogue

    exchanges = [x for x in plan(catalogue.order_tables(spark, small)).split("== Physical Plan ==")[1].splitlines() if "Exchange" in x]
    assert len(exchanges) == 1 and "l_orderkey" in exchanges[0]
    assert "ObjectHashAggregate" not in plan(catalogue.order_tables(spark, small)).split("Exchange")[-1]  # lists are made after the shuffle


def test_pages_cost_no_data_frame_each(spark):
    from folia.operators import layout

    rows = [("d", p, s, "text", [50.0, 40.0 + 9 * s, 300.0, 62.0 + 9 * s], f"line {s // 2} of the page", "native") for p in range(3000) for s in range(3)]
    blocks = spark.createDataFrame(rows, "doc_id string, page_num int, seq int, type string, bbox array<double>, text string, source string")
    once = layout.deduplicated(blocks)
    assert "FlatMapGroupsInPandas" not in plan(once)
    assert once.select("page_num", "seq").exceptAll(blocks.filter("seq <> 1").select("page_num", "seq")).count() == 0 and once.count() == 6000
    assert layout.lines_by_height(blocks).filter("line > 0").count() == 6000
    assert layout.clustered(blocks).filter("cluster > 0").count() == 0


def test_neighbours_in_bounded_products(spark):
    """A task keeps k for each query, equal ones by id, whatever the number of vectors."""
    import tracemalloc

    import numpy as np

    from folia.operators.retrieval import Nearest

    rng = np.random.default_rng(5)
    queries, vectors = rng.normal(size=(900, 8)), rng.normal(size=(9000, 8)).repeat(2, axis=0)[rng.permutation(18000)]
    best, scores = Nearest(900, 5), lambda a, b: np.round(queries[a:b] @ vectors.T, 3)
    tracemalloc.start()
    for q in range(0, 900, 100):
        for at in range(0, 18000, 500):
            best.add(slice(q, q + 100), np.arange(at, at + 500), np.round(queries[q : q + 100] @ vectors[at : at + 500].T, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at, ids, _ = best.rows(slice(None))
    for q in range(0, 900, 90):
        want = np.lexsort((np.arange(18000), -scores(q, q + 1)[0]))[:5]
        assert ids[np.array(at) == q].tolist() == want.tolist()
    assert peak < 10e6


@pytest.mark.parametrize("cells", [0, 8_000_000])
def test_keyword_candidates(spark, cells):
    """Equal scores by document, null ones first, repeated ids together; the same with and without the matrix, and no shuffle by query and document with it."""
    from folia.operators import retrieval

    docs = spark.createDataFrame([(i % 70 or None, f"alpha {'beta ' * (i % 3)} gamma{i % 5}") for i in range(200)], "doc_id bigint, text string").repartition(5)
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma1 gamma2"), (3, "nothing here"), (None, "Beta")], "query_id bigint, text string")
    got = retrieval.bm25(retrieval.postings(docs), queries, 200, 3.0, k=7, most_cells=cells)
    pairs = retrieval.bm25(retrieval.postings(docs), queries, 200, 3.0, k=7, most_cells=0)
    rows = lambda df: sorted(map(str, df.select("query_id", "doc", F.round("keyword_score", 6), "overlap", "keyword_rank").collect()))
    assert rows(got) == rows(pairs) and got.count() == 21
    assert any("Exchange hashpartitioning(query_id" in x and ", doc#" in x for x in plan(got).splitlines()) == (cells == 0)


def test_metrics_and_counts_equal_patterns(spark):
    texts = ["ROE up", "Cash Flow", "cash  flow", "12 bp", "3.5%", "5 KRW", "1,2-", "İncome", "", "가1b!2가", "no figures", "7 x", None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    t, letters = F.col("t"), "[A-Za-z가-힣]"
    got = rows.select(T.metric_signal(t), T.char_count(t, letters)).collect()
    assert got == rows.select(t.rlike(T.METRIC_SIGNAL), F.regexp_count(t, F.lit(letters))).collect()


def test_line_signals_equal_patterns(spark):
    """Cheap looks before patterns: the same signals as the patterns alone, on lines for each of them; no text for each letter."""
    from folia.functions import pagetext as P

    texts = ["+3.5%", "[Topic] says", "Issue box:", "1. first", "- item", "a|b|c 1Q24 2Q25", "1D 1W", "a.b@c.de", "02-123-4567", "1/2 3/4", "(unit) ", "12.5", "(a)", "|%-+", "1", "12,3", "no figures here", "왜? 네", "가나다 1", " ", "", None]
    rows = spark.createDataFrame([(x, w) for x in texts for w in (5.0, 15.0, 200.0)], "c string, w double").withColumn("t", T.strip(F.coalesce("c", F.lit("")))).withColumn("digit", F.col("t").rlike(r"\d"))
    t, w, n = F.col("t"), F.col("w"), F.length("t")
    count = lambda p: F.regexp_count(t, F.lit(p))
    share = lambda p: F.when(n == 0, 0.0).otherwise(count(p) / n)
    value = (n > 0) & (n <= 32) & t.rlike(r"\d") & t.rlike(r"(?i)[%+\-]|bp|bps|x\b") & ((w >= 12.0) | (n >= 4))
    ticks, bars, topic = count(r"\d{1,2}/\d{1,2}"), count(r"\|"), t.rlike(r"^\[[^\]\n]{1,24}\]\s*\S")
    want = {
        "metric_value": value, "topic_start": topic, "issue_box": topic | ((n <= 80) & t.rlike(r"^[A-Za-z][A-Za-z0-9 /\-&]{1,40}:$")), "ranking": t.rlike(r"^\d{1,2}[.)]\s+\S") | t.rlike(r"^[\-*]\s+\S"),
        "mini_table": ((bars >= 1) & (w > 595 * 0.12)) | (count(r"(?i)\b\d{1,2}[QH]\d{2,4}[A-Z]?\b") >= 2) | (count(r"(?i)\b(?:1D|1W|1M|3M|6M|12M)\b") >= 2),
        "contact": t.rlike(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}") | t.rlike(r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{2,4}[-.\s]?\d{2,4}"), "axis_tick": (ticks >= 1) & (n <= 36),
        "unit_label": ((n <= 22) & t.rlike(r"^\([^)]{1,18}\)\s*$")) | ((n <= 12) & (share(r"[|%\-+,./()]") >= 0.2) & (share(r"\d") < 0.35)), "tiny_numeric": (n == 0) | (~value & t.rlike(r"^[\d.,%+\-]{1,5}$") & (w < 18)),
        "debris": (n == 0) | (bars >= 2) | (ticks >= 2) | ((ticks >= 1) & (n <= 40)) | ((n <= 20) & t.rlike(r"^\([^)]+\)\s*$")) | ((n < 52) & (count(r"\d") + count(r"[|%\-+,./]") >= 0.5 * n) & (count("[A-Za-z가-힣]") < F.greatest(F.lit(6), F.floor(n / 5)))),
        "context": (n > 0) & ~((n <= 3) & (share(r"\d") >= 0.34)) & ~((share(r"\d") >= 0.62) & (share("[A-Za-z가-힣]") < 0.18)), "prose": t.rlike(r"[.。?？!！;；:：]"),
    }
    got = P.line_signals(t, F.col("digit"), w, F.lit(595.0))
    assert list(got) == list(want) and rows.select(*(c.alias(k) for k, c in got.items())).collect() == rows.select(*(c.alias(k) for k, c in want.items())).collect()
    assert "[A-Za-z가-힣]+" in plan(rows.select(*got.values()))  # counted by taking them out


FIGURES = ["", "x", "1,2,3,4,5,6,7,8,9,10,11,12,13,14 and fifteen, sixteen and so on", "a" * 39 + "1" * 14, "%$;:()" * 9, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 \n" * 3, "word 12 " * 30, "가나다 3% " * 12, "twelve words " * 60, None]


def test_figures_are_counted_where_there_are_some(spark):
    rows = spark.createDataFrame([(x,) for x in FIGURES], "t string")
    t, compact = F.col("t"), T.squeezed(F.col("t"))
    digits, letters, symbols = (F.regexp_count(compact, F.lit(p)) for p in (r"\d", "[A-Za-z가-힣]", r"[%$€£¥₩/,:;()\-+]"))
    want = (F.length(compact) >= 40) & ((digits >= F.greatest(F.lit(14), letters)) | (digits + symbols > F.greatest(F.lit(24), F.floor(F.length(compact) * 0.55))))
    assert rows.select(T.numeric_heavy(t)).collect() == rows.select(want).collect() and any(r[0] for r in rows.select(want).collect())
    assert str(T.numeric_heavy(t)).count("(?U)") == 1  # white space is taken out once


def test_summary_score_goes_through_a_text_once(spark):
    """Twelve words are looked for, not all counted; score and penalties share what they need."""
    from folia.operators import retrieval

    texts = [*FIGURES, "Table of contents", "appendix " * 30, "a. " * 50, "ab, cd; " * 6 + "." * 120, "eleven " * 11 + "-" * 90, "twelve " * 12 + "-" * 90]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    score = retrieval.summary_score(F.col("t"), F.lit("source"), F.lit("text"), F.lit(False), F.lit(True), F.lit(0.0))
    one = T.normalize_text(F.col("t"))
    n, words = F.length(one), F.regexp_count(one, F.lit("[A-Za-z0-9ㄱ-힣]+"))
    bonus = F.when(n >= 350, 0.12).when(n >= 120, 0.08).when(n >= 60, 0.02).otherwise(-0.08) + F.when((n >= 120) & (words >= 12), 0.08).otherwise(0.0)
    cost = sum((F.when(F.array_contains(score["penalties"], k), w).otherwise(0.0) for k, w in (("toc_like", 0.28), ("appendix_like", 0.22), ("title_only", 0.2), ("visual_only", 0.18), ("caption_or_numeric_only", 0.16))), F.lit(0.0))
    assert rows.select(F.round(score["score"], 6)).collect() == rows.select(F.round(bonus - cost, 6)).collect()
    assert str(score).count("(?U)[") == 1 and "ㄱ-힣]+, " not in str(score)


def test_chart_pages_are_judged_after_their_hint(spark):
    """The chart words equal their pattern, and a page without one isn't searched for metrics."""
    from folia.operators import chunking

    texts = ["ROE up", "a graphic", "SERİES", "serieſ", "추이", "operation", "nothing", "", "Margin 3% 4% 5% 6% 1Q24 2Q24 3Q24\n" * 8, "3% 4% 5% 6% 7% 8% 1Q24 2Q24\n" * 9]
    pages = spark.createDataFrame([("d", i, x) for i, x in enumerate(texts)], "doc_id string, page_num int, rag_text string").withColumn("text", F.col("rag_text"))
    t = F.col("text")
    assert pages.select(T.contains_any(F.lower(t), T.CHART_WORDS)).collect() == pages.select(t.rlike(T.CHART_HINT)).collect()
    blocks = spark.createDataFrame([("d", i, 0, "text", x) for i, x in enumerate(texts)], "doc_id string, page_num int, seq int, type string, text string")
    none = pages.select("doc_id", "page_num").limit(0)
    found = chunking.chart_like_pages(pages, blocks, none)
    assert [r.page_num for r in found.collect()] == [8]
    tree = plan(found).split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1]
    assert all("CASE WHEN" in x for x in tree.splitlines() if "Filter" in x and "regexp_extract_all" in x)


def test_representative_chunks_split_texts_twice(spark, small):
    """Once for the scores, which are stored before the plan begins, and once in it for the candidates; not for each step that reads them."""
    from folia.plans import catalogue

    tree = plan(catalogue.QUERIES["representative_chunks"](spark, small)).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert sum("Relation" in x and "text#" in x for x in tree.splitlines()) == 1


def test_tables_measured_by_batch_equal_expressions(spark, small):
    """Whole tables are measured without interpreted lambdas over their cells, with what the expressions give, to the last digit."""
    import random

    import __spark_entry__ as entry
    import pyarrow as pa

    from folia.functions import tables as TB
    from folia.operators import tablequality
    from folia.session import ship_package

    for name in ("table_quality", "table_shape", "best_table"):
        assert "rlike" not in plan(entry.queries()[name](spark, small)).lower(), name
    deal = random.Random(5)
    cells = ["", " ", "name", "12", "3.5%", "(1)", "-", "▲", "a b", "가나다", "매출액 12억원", "x" * 95, "y 1 " * 25, "이것은 긴 문장이라고 할 수 있다. " * 4, None, "1,234", "  pad  d ", "\u3000가 2", "é", "ſ", "😀1", "[", "조"]

    def table():
        pool, wide = deal.sample(cells, deal.choice([1, 2, 4, 8, len(cells)])), deal.choice([1, 1, 2, 3, 5, 17])
        rows = [[deal.choice(pool) for _ in range(wide if deal.random() < 0.7 else deal.randint(0, wide + 1))] for _ in range(deal.choice([0, 1, 2, 2, 3, 4, 6, 9, 55]))]
        return None if deal.random() < 0.02 else [*rows, None] if deal.random() < 0.05 else rows

    rows = [(i, table()) for i in range(1000)]
    tables = ship_package(spark).createDataFrame(rows, "table_id bigint, rows array<array<string>>")
    plain = tables.select("table_id", TB.normalized(F.col("rows"), F.lit("native"), F.lit(None).cast("string")).alias("t")).withColumn("q", TB.quality(F.col("t")))
    want = plain.select("table_id", "t.n_rows", "t.n_cols", F.array_join(F.col("t.numeric_cols").cast("array<string>"), ",").alias("numeric_cols"), *(f"q.{c}" for c in tablequality.RATIOS), TB.readiness(F.col("t"), F.col("q.reject_signals")).alias("ready"))
    got = sorted(tablequality.measured(tables).select(*want.columns).collect())
    assert got == sorted(want.collect()) and len({r.ready for r in got}) >= 9
    whole = pa.array([r for _, r in rows], pa.list_(pa.list_(pa.string())))
    parts = [tablequality.measure(whole.slice(a, 300), 0.5) for a in range(0, 1000, 300)]
    assert all(pa.concat_arrays([p[c] for p in parts]).equals(x) for c, x in tablequality.measure(whole, 0.5).items())


def test_blocks_of_a_page_are_gathered_once(spark, small):
    """Text-first chunks read the documents once for the pages and once for the blocks, whatever supports them; cleaning replaces nothing in clean texts."""
    import __spark_entry__ as entry

    from folia.operators import chunking

    chunks = plan(entry.queries()["text_first_chunks"](spark, small))
    assert chunks.count("FileScan parquet") <= 2 and chunks.split("== Physical Plan ==")[1].count("Join ") <= 1
    bbox = [0.0, 0.0, 1.0, 1.0]
    table = "Sales rose to 12 million in 2023. Costs fell to 8 million. Margin is 33 %. " * 2
    rows = [
        ("d", 1, 0, "text", "a" * 130, None, None, "b0", None, bbox), ("d", 1, 1, "table", "", table, "p", "b1", ["b0"], bbox), ("d", 1, 2, "text", "in the panel, and long enough " * 5, None, "p", "b2", None, bbox), ("d", 2, 0, "text", "short", None, None, "b3", None, bbox),
        ("d", 3, 0, "table", "", table, None, "b4", None, bbox), ("d", 4, 0, "text", "on a page that was not parsed", None, None, "b5", None, bbox), (None, 1, 0, "text", "of no document at all, and long", None, None, "b6", None, bbox),
    ]
    blocks = spark.createDataFrame(rows, "doc_id string, page_num int, seq int, type string, text string, table_summary string, panel_id string, block_id string, context_ids array<string>, bbox array<double>")
    pages = spark.createDataFrame([("d", 1, "x", "one"), ("d", 2, "", "two"), ("d", 3, None, "three"), ("d", 9, "own text", "nine")], "doc_id string, page_num int, rag_text string, page_title string")
    got = {(r.page_num, r.chunk_type, tuple(r.source_block_ids), r.page_title) for r in chunking.text_first_chunks(blocks, pages).collect()}
    assert got == {(1, "block_group", ("b0", "b1"), "one"), (1, "block_group", ("b2", "b1"), "one"), (2, "page", ("b3",), "two"), (3, "page", ("b4",), "three"), (4, "text", ("b5",), None), (9, "page", (), "nine")}
