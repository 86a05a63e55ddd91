"""Page text, exports, payloads and answers on small literal rows."""

import pytest
from pyspark.sql import functions as F

from folia import schemas
from folia.functions import pagetext as P
from folia.operators import answering, assembly, export, pages, retrieval, slides
from folia.sources import files


def value(spark, column, **columns):
    names = ", ".join(f"{k} {t}" for k, (t, _) in columns.items())
    return spark.createDataFrame([tuple(v for _, v in columns.values())], names).select(column.alias("v")).first().v


def text(spark, f, t):
    return value(spark, f(F.col("t")), t=("string", t))


@pytest.mark.parametrize(
    "given, title",
    [
        ("2024년연간보고서실적 요약", "실적 요약"), ("2024년보고서", "2024년보고서"), ("12.3% 4.5 (6) [1Q2024] Results", "[1Q2024] Results"), ("Sales and costs [1Q2024] Results", "Sales and costs [1Q2024] Results"),
        ("본 자료는 참고용", ""), (None, ""), ("x" * 200, "x" * 140 + "..."),
    ],
)
def test_compact_titles(spark, given, title):
    assert text(spark, P.compact, given) == title


def test_figures_tables_and_noise(spark):
    assert text(spark, P.metric_list, "12.5%, 2024 1Q; 1,234 12.5% | 7 3.1 88") == ["12.5%", "234", "3.1", "88"]
    rows = ("array<array<string>>", [["a", "b"], ["c", None]])
    shown = lambda s, kv, m, r, t: value(spark, P.table_text(*(F.col(c) for c in "skmrt")), s=("string", s), k=("array<struct<item:string,`values`:string>>", kv), m=("string", m), r=r, t=("string", t))
    assert shown("Sum", [("k", "v"), ("", "x")], "| a |", rows, "t") == "[TABLE SUMMARY]\nSum\n\n[TABLE KEY VALUES]\n- k: v\n\n[TABLE]\n| a |"
    assert shown(None, None, None, rows, "t") == "[TABLE]\n2 rows, 2 columns\na | b\nc | "
    assert shown(None, None, None, ("array<array<string>>", []), "only text") == "[TABLE]\nonly text" and shown(None, None, None, ("array<array<string>>", None), None) == ""
    assert [text(spark, P.visual_noise, t) for t in ("2025년", "----------", "Revenue by region and year", None)] == [True, True, False, True]
    assert [text(spark, P.title_question, t) for t in ("이 문서 제목이 뭐야", "What is the Document Title?", "What is revenue?")] == [True, True, False]
    header = lambda cells: value(spark, P.meaningful_header(F.col("c")), c=("array<string>", cells))
    assert [header(c) for c in (["Name", "2023"], ["Contents", "x"], ["-", "%"], [], None)] == [True, False, False, False, False]
    some = lambda r: value(spark, P.meaningful_rows(F.col("c")), c=("array<array<string>>", r))
    assert [some(r) for r in ([["12.5"]], [["12.5", "a"]], [["", None]], None)] == [False, True, False, False]
    reading = lambda t, n, hint: value(spark, P.reading_needed(F.col("t"), F.col("n"), F.col("h")), t=("string", t), n=("int", n), h=("string", hint))
    assert [reading(*x).reason for x in (("", 0, ""), (" \n", 0, ""), ("ab", 1, ""), ("--- ?", 0, ""), ("word", 0, ""), ("plain words " * 9, 2, ""), ("%%%% (()) !! ab " * 9, 0, "slide_like"))] == [
        "native_text_empty", "native_text_whitespace_only", "images_present_and_text_weak", "short_and_low_alphanumeric", "native_text_below_threshold_but_no_images", "ocr_not_needed", "sensitive_slide_low_density"]
    weak = lambda t, kind="text", reason=None, prio=None: value(spark, P.weak(*(F.col(c) for c in "ktrp")), k=("string", kind), t=("string", t), r=("string", reason), p=("string", prio))
    assert [weak("ab"), weak("ab", prio="high"), weak("4%"), weak("long enough"), weak("long enough", reason="axis_label"), weak(None)] == [True, False, False, False, True, True]


BLOCKS = "doc_id string, page_num int, seq int, type string, text string, bbox array<double>, summary_priority string, associated_title string, slide_role string, table_summary string, table_markdown string, chart_summary string, caption_text string, summary_exclude boolean"


def rows_of(spark, *rows):
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    return spark.createDataFrame([tuple({"doc_id": "d", "page_num": 1, "seq": i, "bbox": [0.0, 10.0 * i, 9.0, 10.0 * i + 9], **r}.get(n) for n in names) for i, r in enumerate(rows)], BLOCKS)


def test_export_of_a_page(spark):
    rows = rows_of(
        spark, {"type": "title", "text": "Annual results"}, {"type": "text", "text": "Revenue grew in every region during the year."}, {"type": "text", "text": "Revenue grew in every region, during the year"}, {"type": "text", "text": "stream of figures", "slide_role": "offpage_text_stream", "summary_priority": "high"},
        {"type": "table", "text": "a b", "table_summary": "Sales by region", "table_markdown": "| a | b |", "associated_title": "Sales"}, {"type": "chart", "text": "", "chart_summary": "Margins rose", "caption_text": "Figure 1"}, {"type": "footer", "text": "page 3", "summary_exclude": True}, {"type": "image", "text": " "},
        {"type": "text", "text": "gone", "summary_exclude": True, "summary_priority": "low"},
    )
    made = {r.source_order: r.llm_section for r in export.entries(rows).collect()}
    assert made == {0: "title", 1: "body", 2: "body", 3: "note", 4: "table", 5: "visual"}
    page = spark.createDataFrame([("d", 1, ""), ("d", 2, "Given title")], "doc_id string, page_num int, page_title string")
    titles = {r.page_num: r.page_title for r in export.page_titles(rows, page).collect()}
    assert titles == {1: "Annual results", 2: "Given title"}
    out = {r.page_num: r for r in export.page_texts(export.entries(rows), export.page_titles(rows, page)).collect()}
    assert out[1].rag_text == "\n\n".join(["[TITLE] Annual results", "[BODY] Revenue grew in every region during the year.", "[TABLE] Title: Sales\nSummary: Sales by region\nMarkdown: | a | b |", "[CHART] Margins rose\nCaption: Figure 1", "[NOTE] stream of figures"])
    assert out[2].rag_text == "[TITLE] Given title" and out[2].entries == 0
    heads = spark.createDataFrame([("d", "f.pdf"), ("e", None)], "doc_id string, filename string")
    texts = export.page_texts(export.entries(rows), export.page_titles(rows, page)).withColumn("source_text", F.lit("own"))
    docs = {r.doc_id: r for r in export.documents(texts, heads).collect()}
    assert [p.page_num for p in docs["d"].pages] == [1, 2] and docs["e"].page_count == 0
    report = {r.doc_id: r.markdown for r in export.report(export.documents(texts, heads), limit=20).collect()}
    assert report["d"].startswith("# f.pdf\n\n- **Pages:** 2") and "chars total" in report["d"] and report["e"].startswith("# Unknown")


def test_group_titles_and_priorities(spark):
    rows = rows_of(spark, {"type": "text", "text": "x", "summary_priority": "low"}, {"type": "title", "text": " Head "}, {"type": "text", "text": "y", "summary_priority": "Medium", "associated_title": "Later"}, {"type": "text", "text": "z", "summary_priority": "medium"})
    assert assembly.summary_priority(rows, "doc_id").first().summary_priority == "Medium"
    assert assembly.associated_title(rows, "doc_id").first().associated_title == "Head"
    bare = rows_of(spark, {"type": "text", "text": "x"})
    assert assembly.summary_priority(bare, "doc_id").first().summary_priority is None and assembly.associated_title(bare, "doc_id").first().associated_title is None


def test_chunk_files_round_trip(spark, tmp_path):
    rows = rows_of(spark, {"type": "text", "text": "A paragraph that is long enough to be a chunk of its own."})
    page = rows.select("doc_id", "page_num", F.col("text").alias("rag_text"), F.lit("T").alias("page_title"))
    made = assembly.all_chunks(rows, page)
    assembly.write_chunks(made, str(tmp_path / "chunks"))
    back = assembly.read_chunks(spark, str(tmp_path / "chunks"))
    key = lambda df: sorted((r.chunk_id, r.retrieval_text, r.strategy_name) for r in df.collect())
    assert key(back) == key(made) and {r.strategy_name for r in back.collect()} == {schemas.MAIN_STRATEGY, schemas.BASELINE_STRATEGY}
    with pytest.raises(FileNotFoundError):
        assembly.read_chunks(spark, str(tmp_path / "none"))
    (tmp_path / "bad" / f"strategy_name={schemas.MAIN_STRATEGY}").mkdir(parents=True)
    (tmp_path / "bad" / f"strategy_name={schemas.MAIN_STRATEGY}" / "x.json").write_text('["no chunk"]\n')
    with pytest.raises(Exception, match="no chunk"):
        assembly.read_chunks(spark, str(tmp_path / "bad")).collect()
    docs = spark.createDataFrame([("1", "a.pdf", "/x/a.pdf"), ("2", "b.pdf", "/y/b.pdf")], "doc_id string, filename string, filepath string")
    assert [r.doc_id for r in assembly.selected_documents(docs, path="/elsewhere/b.pdf").collect()] == ["2"] and assembly.selected_documents(docs, doc_id="1").count() == 1 and assembly.selected_documents(docs).count() == 2


def test_representative_branches(spark, tmp_path):
    chunks = spark.createDataFrame([(d, p, p, "Words that explain the results of the year at some length. " * 6, "text", "") for d in ("a", "b") for p in (1, 2, 3)], "doc_id string, page_num int, chunk_index int, text string, chunk_type string, visual_type string")
    scored = retrieval.with_coverage(chunks)
    path = str(tmp_path / "selections")
    assert answering.selections(spark, path).count() == 0
    first = answering.representative(scored.filter("doc_id = 'a'"), 8).cache()
    answering.keep_selections(first, path, "run", "c", "text", retrieval.coverage_budget(8))
    reranked = spark.createDataFrame([("a", 1, 1, 1), ("z", 4, 9, 1), ("z", 5, 10, 2)], "doc_id string, page_num int, chunk_index int, rank int")
    got = answering.representative(scored, 1, reranked, answering.selections(spark, path).filter("run_id = 'run'")).collect()
    assert {(r.doc_id, r.backend) for r in got} == {("a", "coverage_selection_cache"), ("b", "coverage_selection"), ("z", "rerank_candidates")}
    assert [(r.chunk_index, r.place) for r in sorted(got, key=lambda r: r.place) if r.doc_id == "a"] == [(r.chunk_index, r.place) for r in first.orderBy("place").collect()]
    assert [r.chunk_index for r in got if r.doc_id == "z"] == [9] and answering.fallback_budget(5) == 20 and answering.fallback_budget(30) == 80


def test_answers_report_pages(spark):
    v = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc int, vector_rank int")
    k = spark.createDataFrame([(1, 11, 1)], "query_id int, doc int, keyword_rank int")
    texts = spark.createDataFrame([(10, "table of contents", 1), (11, "growth of sales", 7)], "doc int, text string, page int")
    q = spark.createDataFrame([(1, "sales growth on page 7"), (2, "nothing")], "query_id int, text string")
    final, report = answering.retrieved(v, k, texts, q)
    assert [r.doc for r in final.orderBy("qa_rank").collect()] == [11, 10]
    got = {r.query_id: r for r in report.collect()}
    assert (got[1].vector_candidates, got[1].keyword_candidates, got[1].fused, got[1].boilerplate_fused, got[1].page_hit_fused, got[1].page_hit_returned) == (2, 1, 2, 1, True, True)
    assert got[2].fused == 0 and got[2].page_hit_fused is None
    shown = answering.previews(final.join(texts.select("doc", "text"), "doc") if "text" not in final.columns else final, 1).collect()
    assert len(shown) == 1 and shown[0].preview == "growth of sales"


def test_empty_pages_and_lines(spark):
    none = rows_of(spark, {"type": "text", "text": "x"}).limit(0)
    assert pages.unique_lines(none).count() == 0 and export.entries(none).count() == 0
    assert text(spark, P.narrative_profile, None).num_ratio == 0.0
    assert value(spark, P.decorative_shape(*(F.col(c) for c in "whab")), w=("double", 400.0), h=("double", 2.0), a=("double", 595.0), b=("double", 842.0))


def test_scanned_boxes(spark):
    rows = [("d", 1, t, c, [x, y, x + 20.0, y + 10.0], 100.0, 100.0) for t, c, x, y in (("Net", 0.9, 0.0, 0.0), ("sales", 0.8, 21.0, 0.2), ("rose", 0.7, 46.0, 0.0), ("far", 0.9, 90.0, 0.0), ("a", 0.6, 0.0, 30.0), ("--", 0.9, 30.0, 30.0), ("12", 0.55, 60.0, 30.0), ("below", 0.9, 0.0, 50.0))]
    boxes = spark.createDataFrame(rows, "doc_id string, page_num int, text string, confidence double, bbox array<double>, page_width double, page_height double")
    got = slides.joined_boxes(boxes).orderBy("place").collect()
    assert [r.text for r in got] == ["Netsales rose", "far", "below"] and got[0].bbox == [0.0, 0.0, 66.0, 10.2] and got[0].confidence == pytest.approx(0.775)
    assert slides.joined_boxes(boxes.limit(0)).count() == 0


def test_tables_and_roles(spark):
    judge = lambda rows, b, accuracy: value(spark, slides.accepted_scan(F.col("r"), F.col("b"), F.lit(100.0), F.lit(100.0), F.col("a")), r=("array<array<string>>", rows), b=("array<double>", b), a=("double", accuracy)).reason
    two = [["a", "b"], ["c", "d"]]
    assert [judge([["a", "b"]], [0.0, 0.0, 9.0, 9.0], 99.0), judge([["a"], ["b"]], [0.0, 0.0, 9.0, 9.0], 99.0), judge([["", ""], ["", "x"]], [0.0, 0.0, 9.0, 9.0], 99.0), judge(two, [0.0, 0.0, 99.0, 99.0], 99.0), judge(two, [0.0, 0.0, 9.0, 9.0], 10.0), judge(two, [0.0, 0.0, 9.0, 9.0], 99.0)] == [
        "too_few_rows", "too_few_cols", "low_filled_ratio", "bbox_too_large", "low_accuracy", "accepted"]
    piece = lambda t, y: value(spark, slides.fragment_of_line(F.col("t"), F.array(F.lit(0.0), F.col("y"), F.lit(9.0), F.col("y") + 5), F.lit(100.0)), t=("string", t), y=("double", y))
    assert [piece("1Q24", 50.0), piece("12.5%", 5.0), piece("12.5%", 50.0), piece("sales", 5.0), piece("--", 50.0), piece(None, 50.0)] == [False, False, True, True, False, False]
    mode = lambda *x: value(spark, slides.page_mode(*(F.col(c) for c in "cwtif")), **{c: ("int", v) for c, v in zip("cwtif", x, strict=True)})
    assert [mode(200, 5, 1, 0, 0), mode(70, 5, 4, 0, 0), mode(5, 1, 1, 0, 0), mode(30, 5, 0, 1, 0), mode(30, 5, 1, 0, 60), mode(90, 20, 1, 1, 1)] == ["native_text_slide", "native_text_slide", "ocr_slide", "ocr_slide", "ocr_slide", "hybrid_slide"]
    blocks = spark.createDataFrame(
        [("d", 1, i, k, t, [10.0, y, 200.0, y + 20], "native", 595.0, 842.0) for i, (k, t, y) in enumerate((("table", "name  sales  costs\nnorth  12  7\nsouth  15  9", 100.0), ("table", "CONTENTS ..... 4", 300.0), ("text", "plain", 500.0)))],
        "doc_id string, page_num int, seq int, type string, text string, bbox array<double>, source string, page_width double, page_height double",
    )
    got = {r.seq: r for r in slides.enriched_tables(blocks).collect()}
    assert (got[0].type, got[1].type, got[2].type) == ("table", "unknown", "text") and got[0].table_markdown.startswith("| name | sales | costs |") and got[0].table_quality > 0 and got[1].table_markdown is None and got[2].table_score is None


def test_settings_and_cache(spark, tmp_path):
    (tmp_path / ".env").write_text('# comment\nKEY = "a=b"\n\nno sign\nOTHER=\'x\'\nKEY=last\n')
    assert {r.name: r.value for r in files.settings(spark, str(tmp_path / ".env")).collect()} == {"KEY": "last", "OTHER": "x"}
    docs = spark.createDataFrame([("1", None, 3), ("2", "success", None)], "doc_id string, status string, pages int")
    files.write_cache(docs, str(tmp_path / "cache"))
    assert sorted(map(tuple, spark.read.schema(docs.schema).json(str(tmp_path / "cache")).collect())) == sorted(map(tuple, docs.collect()))
    shown = value(spark, P.html_table(F.col("r")), r=("array<array<string>>", [["a<b", None], ["x"]]))
    assert shown == "<table><thead><tr><th>a&lt;b</th><th></th></tr></thead><tbody><tr><td>x</td><td></td></tr></tbody></table>" and value(spark, P.html_table(F.col("r")), r=("array<array<string>>", [[None]])) == ""
    got = value(spark, P.key_value_rows(F.col("l")), l=("array<string>", ["- Revenue: 12.5% and 1,200 USD", "no figure", "42"]))
    assert [tuple(r) for r in got] == [("Revenue: and", "12.5%, 1,200 USD"), ("metric", "42")]
