"""Operators on small literal rows, against plain Python where there is a loop to compare with."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from folia.functions import geometry as G
from folia.functions import keys as K
from folia.functions import tables as TB
from folia.functions import text as T
from folia.operators import chunking, index, layout, metadata, retrieval, splitting
from folia.sources import files
from folia.sources import tables as S
from folia.streaming import latency


def value(spark, column, **columns):
    """The value of an expression over one row."""
    names = ", ".join(f"{k} {t}" for k, (t, _) in columns.items())
    rows = spark.createDataFrame([tuple(v for _, v in columns.values())], names) if columns else spark.range(1)
    return rows.select(column.alias("v")).first().v


def text(spark, f, t):
    return value(spark, f(F.col("t")), t=("string", t))


@pytest.mark.parametrize(("raw", "clean"), [("a\r\nb\rc", "a\nb\nc"), ("a \t b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("  x  ", "x"), (None, "")])
def test_clean_text(spark, raw, clean):
    assert text(spark, T.clean_text, raw) == clean


def test_normalisation_and_previews(spark):
    assert text(spark, T.normalize_text, " a \n b　 c ") == "a b c"
    assert text(spark, T.evidence_preview, "x" * 600) == "x" * 600
    assert text(spark, T.evidence_preview, "x" * 596 + " " + "y" * 10) == "x" * 596 + "..."
    assert [text(spark, T.estimate_tokens, t) for t in ("", "a", "abcde")] == [0, 1, 2] and text(spark, T.chunk_tokens, "abc") == 1


def test_metrics_in_korean_and_english(spark):
    t = "매출 1,234억원, 5.5%p 증가 (2024) 1,234 억원; 12 명, 3.25 and 7"
    assert text(spark, T.metric_tokens, t) == ["1,234억원", "5.5%p", "12 명", "3.25"]
    assert text(spark, T.period_tokens, "1Q24 and 2Q2023, 1q24, 2024.05") == ["1Q24", "2Q2023", "2024.05"]
    up = value(spark, T.trend(F.array(F.lit("1.5%"), F.lit("3억원"), F.lit("2.5%")), F.array(F.lit("1Q24")), F.lit("")))
    assert up == "increased" and value(spark, T.trend(F.array(F.lit("1.5%"), F.lit("3억원")), F.array(F.lit("1Q24")), F.lit(""))) is None
    assert value(spark, T.trend(F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit(""))) is None


def test_predicates(spark):
    assert text(spark, T.title_only, "Annual report") and not text(spark, T.title_only, "Revenue grew 5% in the year.")
    assert text(spark, T.contactish, "Tel: 01012345678\nMail: a@b.co") and not text(spark, T.contactish, "This is a sentence. And more: text")
    assert text(spark, T.no_support, "문서에서 확인할 수 없습니다. 다른 문장.") and not text(spark, T.no_support, "매출은 5%입니다.") and text(spark, T.no_support, "")
    assert [text(spark, T.expected_page, t) for t in ("see page 12", "p. 3", "7 페이지", "none")] == [12, 3, 7, None]
    assert text(spark, T.keyword_tokens, "Growth: 5.5% (2024-01) 매출!") == ["growth", "5.5%", "2024-01", "매출"]
    assert [text(spark, T.token_class, t) for t in ("abc", "12", "a1")] == ["word", "number", "mixed"]


def test_keys_are_stable(spark):
    import hashlib

    assert value(spark, K.stable_id(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == hashlib.md5(b"a::::b").hexdigest()[:12]
    none = F.lit(None).cast("string")
    got = value(spark, K.vector_record_id(none, none, none, none, none, none, F.lit(7)))
    assert got == "vec_" + hashlib.sha256(b"fallback|7").hexdigest()[:24]


def plain_split(t, target=1100, hard=1400, overlap=120):
    parts, start = [], 0
    if len(t) <= hard:
        return [t] if t else []
    while True:
        end = min(len(t), start + hard)
        if end < len(t):
            window = t[start:end]
            cut = max(window[:target].rfind("\n\n"), window[:target].rfind("\n"), window[:target].rfind(". "))
            if cut > target * 0.45:
                end = start + cut + 1
        parts += [t[start:end].strip()] if t[start:end].strip() else []
        if end >= len(t):
            return parts
        start = max(end - overlap, start + 1)


def plain_clean(t):
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()


def test_splitting(spark):
    rng = random.Random(1)
    texts = ["", "short", "x" * 1400, "x" * 5000, *(plain_clean("".join(rng.choice(["word ", "end. ", "line\n", "gap\n\n", "longer-word "]) for _ in range(rng.randint(200, 1500)))) for _ in range(20))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in rows.select("i", splitting.split_text(F.col("t")).alias("p")).collect()}
    assert got == {i: plain_split(t) for i, t in enumerate(texts)}


def test_geometry(spark):
    a, b = F.array(*map(F.lit, (0.0, 0.0, 10.0, 10.0))), F.array(*map(F.lit, (5.0, 5.0, 15.0, 25.0)))
    assert value(spark, G.intersection(a, b)) == 25 and value(spark, G.inner_overlap(a, b)) == 0.25 and value(spark, G.overlap_of_first(b, a)) == 0.125
    assert value(spark, G.union(a, b)) == [0, 0, 15, 25] and value(spark, G.vertical_gap(a, F.array(*map(F.lit, (0.0, 14.0, 1.0, 20.0))))) == 4
    point = F.array(*map(F.lit, (1.0, 1.0, 1.0, 1.0)))
    assert value(spark, G.inner_overlap(point, point)) == 0


def test_table_normalisation_and_quality(spark):
    rows = "array<array<string>>"
    raw = [["10", "20", ""], ["name", "q1", "q2"], ["", "", ""], ["a", "1", "2"], ["b", "3"]]
    t = value(spark, TB.normalized(F.col("r"), F.lit("native"), F.lit("T")), r=(rows, raw))
    assert t.headers == ["name", "q1", "q2"] and t.rows[1] == ["10", "20", ""] and t.rows[-1] == ["b", "3", ""] and (t.n_rows, t.n_cols) == (4, 3)
    assert t.numeric_cols == [1, 2] and t.markdown.split("\n")[1] == "| --- | --- | --- |"
    q = value(spark, TB.quality(TB.normalized(F.col("r"), F.lit("native"), F.lit("T"))), r=(rows, raw))
    assert 0 < q.overall < 10 and q.reject_signals == []
    none = value(spark, TB.quality(TB.normalized(F.col("r"), F.lit("native"), F.lit("T"))), r=(rows, []))
    assert none.overall == 0 and none.empty_cell_ratio == 1
    assert text(spark, TB.text_to_rows, "name  q1  q2\na  1 2 3\tx") == [["name", "q1", "q2"], ["a", "1", "2", "3", "x"]]
    assert text(spark, TB.numeric_like, "1,234") and text(spark, TB.numeric_like, "3 원") and not text(spark, TB.numeric_like, "abc")


def block(seq, kind, t, x=50.0, y=None, **more):
    y = 40.0 + 40 * seq if y is None else y
    return {"doc_id": "d", "page_num": 1, "seq": seq, "type": kind, "text": t, "bbox": [x, y, x + 100.0, y + 20.0], "source": "native", "page_width": 600.0, "page_height": 800.0, **more}


BLOCK = "doc_id string, page_num int, seq int, type string, text string, bbox array<double>, source string, page_width double, page_height double, panel_id string, region_id string, dashboard_region_id string, context_ids array<string>, table_summary string, block_id string"


def blocks(spark, *rows):
    names = [c.split()[0] for c in BLOCK.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], BLOCK)


def plain_groups(items, target=950):
    groups, at, flow, joined = {}, {}, 0, None
    for bid, panel, t in items:
        if panel:
            joined = None
            groups.setdefault(panel, []).append(bid)
            continue
        if joined is None or len(joined) + len(t) > target:
            flow, joined = flow + 1, t
        else:
            joined = f"{joined}\n\n{t}" if joined and t else joined or t
        groups.setdefault(f"text_flow:{flow}", []).append(bid)
    return groups


def test_anchor_groups_equal_a_loop(spark):
    rng = random.Random(6)
    rows = [block(i, "text", "w" * rng.choice([5, 200, 400, 900]), panel_id=rng.choice([None, None, None, "p1", "p2"]), block_id=f"b{i}") for i in range(60)]
    ready = chunking.completed(blocks(spark, *rows)).withColumns({"panel": chunking.panel_key(), "order": chunking.order()})
    got = chunking.anchor_groups(ready.select("doc_id", "page_num", "block_id", "text", "panel", "order")).collect()
    out = {}
    for r in sorted(got, key=lambda r: int(r.block_id[1:])):
        out.setdefault(r.group_key, []).append(r.block_id)
    assert out == plain_groups([(r["block_id"], r["panel_id"], r["text"]) for r in rows])


def test_chunks_take_support_of_the_same_panel_or_by_name(spark):
    summary = "Revenue rose 5% to 1,234 and costs fell 3% to 987. Margins widened by 2.5%p over the year. Growth of 8% is expected for 2025."
    rows = [
        block(0, "text", "The company had a good year in all of its markets and expects more. " * 2, block_id="t0", panel_id="p"), block(1, "chart", "", block_id="c1", panel_id="p", table_summary=summary * 2),
        block(2, "text", "Another section without any picture that is long enough to stand alone here.", block_id="t2"), block(3, "table", "", block_id="c3", context_ids=["t2"], table_summary=summary * 2), block(4, "footer", "page 1", block_id="f"),
    ]
    pages = spark.createDataFrame([("d", 1, "", "Title"), ("d", 2, "Text of a page without blocks.", "Two")], "doc_id string, page_num int, rag_text string, page_title string")
    got = {tuple(r.source_block_ids): r for r in chunking.text_first_chunks(blocks(spark, *rows), pages).collect()}
    assert set(got) == {("t0", "c1"), ("t2", "c3"), ()}
    assert got[("t0", "c1")].chunk_type == "block_group" and summary in got[("t0", "c1")].retrieval_text and got[()].page_num == 2
    assert sorted(r.chunk_index for r in got.values()) == [1, 2, 3]


def test_metadata_contract(spark):
    rows = spark.createDataFrame([("d", "yes", "x", "  some  text ", None, "3"), ("e", "0", "7", "", "", "")], "doc_id string, has_chart string, page_num string, retrieval_text string, display_text string, table_count string")
    defaults = spark.createDataFrame([("d", "report", "9")], "doc_id string, document_type string, page_num string")
    got = {r.doc_id: r for r in metadata.contract(rows, defaults).collect()}
    d, e = got["d"], got["e"]
    assert d.has_chart and d.page_num is None and d.retrieval_text == d.display_text == "some text" and d.has_table and d.table_count == 3 and d.document_type == "report" and d.char_len == 9 and d.token_estimate == 3
    assert not e.has_chart and e.page_num == 7 and not e.has_text and e.token_estimate == 0 and e.vector_record_id.startswith("vec_")
    assert all(v is not None for v in metadata.scalar_metadata(metadata.contract(rows)).first())


def test_coverage_pages_spread(spark):
    score = {p: 0.9 if p % 7 == 0 else 0.4 + (p % 3) * 0.05 for p in range(1, 61)}
    chosen = retrieval.choose_pages(list(score), score, 12)
    assert len(chosen) == 12 and chosen == sorted(set(chosen)) and {7, 14, 21, 28, 35, 42, 49, 56} <= set(chosen)
    assert retrieval.choose_pages([1, 2], {1: 0.1, 2: 0.2}, 5) == [1, 2] and retrieval.choose_pages([1], {1: 1.0}, 0) == []
    assert [retrieval.coverage_budget(k) for k in (1, 8, 10, 50)] == [24, 24, 30, 60]


def test_diversified_rerank(spark):
    rows = spark.createDataFrame([("r", i, str(i // 3), f"s{i // 4}", 1.0 - i / 100) for i in range(12)], "request_id string, doc int, page string, section string, score double")
    got = [r.doc for r in retrieval.diversified(rows, 6).orderBy("rank").collect()]
    # one a page until three are taken (0, 3, 6), then pages may repeat while a section has at most two
    assert got == [0, 3, 6, 7, 8, 9]
    bare = spark.createDataFrame([("r", i, None, None, 1.0 - i / 100) for i in range(4)], "request_id string, doc int, page string, section string, score double")
    assert [r.doc for r in retrieval.diversified(bare, 3).orderBy("rank").collect()] == [0, 1, 2]
    few = spark.createDataFrame([("r", i, "1", "s", 1.0 - i / 100) for i in range(5)], "request_id string, doc int, page string, section string, score double")
    assert [r.doc for r in retrieval.diversified(few, 4).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_fusion_ties_and_single_lists(spark):
    v = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc int, vector_rank int")
    k = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id int, doc int, keyword_rank int")
    got = retrieval.rrf(v, k).orderBy("hybrid_rank").collect()
    assert [r.doc for r in got] == [11, 10, 12] and got[0].sources == 2 and got[0].rrf_score == pytest.approx(2 / 62)


def test_sources_of_answers(spark):
    c = spark.createDataFrame([(1, "a", 3, 0.5, 1, ["growth", "5%", "2024"]), (1, "a", 4, 0.5, 2, ["growth", "5%"]), (1, "b", 9, 0.4, 3, ["growth", "5%", "2024"]), (2, "a", 1, 0.5, 1, ["x"])], "request_id int, filename string, page int, score double, doc_rank int, doc_tokens array<string>")
    a = spark.createDataFrame([(1, "Growth was 5% in 2024."), (2, "알 수 없습니다.")], "request_id int, answer string")
    got = retrieval.answer_sources(c.filter("filename = 'a'"), a).orderBy("rank").collect()
    assert [(r.request_id, r.filename, r.page) for r in got] == [(1, "a", 3)]
    one = retrieval.answer_sources(c, a).orderBy("rank").collect()
    assert [(r.filename, r.page) for r in one] == [("a", 3), ("b", 9)]
    assert retrieval.source_markdown(retrieval.answer_sources(c, a)).first().markdown.endswith("- a · p.3\n- b · p.9")


def test_index_upsert_delete_and_runs(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, version int")
    assert {tuple(r) for r in index.upserted(old, new, "id").collect()} == {("a", 1), ("b", 4), ("c", 5)}
    vectors = spark.createDataFrame([("v1", [1.0]), ("v2", [2.0])], "vector_record_id string, embedding array<float>")
    meta = spark.createDataFrame([("v1", "d1"), ("v2", "d2")], "vector_record_id string, doc_id string")
    root = str(tmp_path / "index")
    index.write_run(vectors, meta, root, "run_1")
    index.delete_document(spark, root, "d1", "run_2")
    assert [r.vector_record_id for r in index.latest_run(spark, root)[0].collect()] == ["v2"]
    with pytest.raises(ValueError, match="no document"):
        index.delete_document(spark, root, "d1", "run_3")
    assert [r.vector_record_id for r in index.latest_run(spark, root)[0].collect()] == ["v2"]


def test_layout_greedy_operators(spark):
    rows = blocks(spark, block(0, "text", "The same paragraph of text", y=40.0), block(1, "text", "the same paragraph of text!", y=42.0), block(2, "text", "Other", y=300.0), block(3, "text", "x", x=60.0, y=325.0), block(4, "title", "Heading", y=500.0))
    assert {r.seq for r in layout.deduplicated(rows).collect()} == {1, 2, 3, 4}  # of repeats the longest text stays
    assert {r.seq for r in layout.distinct_texts(rows).collect()} == {0, 2, 3, 4}
    assert {r.seq: r.text for r in layout.absorbed_fragments(rows).collect()}[0].startswith("The same") and layout.clustered(rows).select("cluster").distinct().count() == 3
    assert [(r.seq, r.text) for r in layout.merged_paragraphs(rows).orderBy("seq").collect()][2:] == [(2, "Other\nx"), (4, "Heading")] and layout.lines_by_height(rows).select("line").distinct().count() == 4
    good, bad = layout.valid_blocks(rows.unionByName(blocks(spark, {**block(9, "text", "z"), "bbox": [5.0, 5.0, 1.0, 9.0]})))
    assert good.count() == 5 and bad.first().drop_reason == "empty_bbox"


def test_structured_text(spark):
    pages = spark.createDataFrame([("d", 1, "1. Scope\nDate: today\nplain text here\nmore text\n\n- item one\n- item two\na | b | c\n1 | 2 | 3\nsingle | row | only\nend")], "doc_id string, page_num int, text string")
    got = [(r.type, r.text.split("\n")[0]) for r in layout.structured_text(pages).orderBy("seq").collect()]
    assert got == [("title", "1. Scope"), ("text", "Date: today"), ("text", "plain text here"), ("text", "- item one"), ("table", "a | b | c"), ("text", "end")]


def test_html_and_markdown_blocks(spark):
    pages = spark.createDataFrame([(1, "<html><script>var p='</p>'</script><h1>Head &amp; more</h1><p>One<br>two</p><table><tr><td>a</td><td>b</td></tr></table><footer>foot</footer>"), (2, None)], "page_id bigint, html string")
    assert [(r.type, r.text) for r in S.html_blocks(pages).orderBy("seq").collect()] == [("title", "Head & more"), ("text", "One two"), ("table", "a b"), ("footer", "foot")]
    md = spark.createDataFrame([(1, "# Head\n\npara one\nline\n\n\n\npara two")], "doc_id bigint, text string")
    assert [(r.type, r.text) for r in S.markdown_blocks(md).orderBy("seq").collect()] == [("title", "Head"), ("text", "para one\nline"), ("text", "para two")]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def archive(parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return raw.getvalue()


def test_files_of_several_formats(spark, tmp_path):
    docx = archive({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    xlsx = archive({
        "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {X}><si><t>name</t></si></sst>", "xl/styles.xml": f'<styleSheet {X}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {X}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1.5</v></c></row><row/><row><c r="A3" s="1"><v>45292</v></c></row></sheetData></worksheet>',
    })
    for name, body in {"a.docx": docx, "b.xlsx": xlsx, "c.txt": b"one\ftwo", "d.docx": b"broken", "e.pdf": b"%PDF", "f.md": b" "}.items():
        (tmp_path / name).write_bytes(body)
    rows = files.read_documents(spark, str(tmp_path)).collect()
    got = {(r.filename, r.page_num): r for r in rows}
    assert got["a.docx", 1].text == "Hello\na | b" and got["a.docx", 1].tables == [[["a", "b"]]]
    assert got["b.xlsx", 1].tables == [[["name", "", "1.5"], ["2024-01-01"]]] and got["b.xlsx", 1].page_title == "S1"
    assert got["c.txt", 2].text == "two" and got["d.docx", None].status == "error" and "no parser" in got["e.pdf", None].error and got["f.md", 1].status == "partial"
    assert files.first_success(lambda c: 1 / 0, files.parse_text)(b"x")[0][2] == "x"


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc_id": "x", "n": 1}')
    (tmp_path / "b.json").write_text("{broken")
    got = {r.doc_id: r.status for r in files.read_json_documents(spark, str(tmp_path), "doc_id string, n int").collect()}
    assert got == {"x": "success", "b": "error"}
    one, two = spark.createDataFrame([("f", 1)], "filename string, v int"), spark.createDataFrame([("f", 2), ("g", 3)], "filename string, v int")
    assert {tuple(r) for r in files.latest_per_name(one, two).select("filename", "v").collect()} == {("f", 2), ("g", 3)}


def run_stream(spark, frame, schema, sink, path, mode):
    frame.write.mode("append").parquet(path)
    out = sink(spark.readStream.schema(schema).parquet(path))
    name = f"t{random.randrange(10**9)}"
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def test_streams(spark, small, tmp_path):
    events = latency.latency_events(S.table(spark, small, "events"))
    batch = {(r.window_start, r.stage): (r.n, r.errors) for r in latency.tumbling(events).collect()}
    got = run_stream(spark, events, events.schema, lambda s: latency.tumbling(s), str(tmp_path / "e"), "update")
    assert {(r.window_start, r.stage): (r.n, r.errors) for r in got} == batch
    jobs = spark.createDataFrame([("j", "queued", 0, 1), ("j", "running", 40, 2), ("j", "completed", 100, 3), ("j", "running", 10, 4), ("k", "running", 5, 1)], "job_id string, status string, progress int, ts int")
    last = {r.job_id: (r.status, r.progress, r.events) for r in run_stream(spark, jobs, jobs.schema, latency.job_states, str(tmp_path / "j"), "update")}
    assert last == {"j": ("completed", 100, 4), "k": ("running", 5, 1)}
    tokens = spark.createDataFrame([("r", 2, "token", "lo"), ("r", 1, "token", "Hel"), ("r", 3, "done", ""), ("q", 1, "token", "x")], "request_id string, seq int, event string, data string")
    assert [tuple(r) for r in run_stream(spark, tokens, tokens.schema, latency.assembled_answers, str(tmp_path / "t"), "append")] == [("r", "Hello", "done")]


def test_queries_of_several_blocks_equal_one_block(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), float(i % 3)]) for i in range(60)], "vec_id bigint, embedding array<double>").repartition(4)
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).filter("query_id < 25")
    want = sorted(map(tuple, retrieval.knn_batch(vectors, queries, 5).collect()))
    assert len(want) == 125 and sorted(map(tuple, retrieval.knn_batch(vectors, queries, 5, most_queries=7).collect())) == want
