"""Table operators over ``rows ARRAY<ARRAY<STRING>>`` as Column expressions with higher-order functions.

A normalised table is a struct: title, headers, rows (row 0 is the header, all
rows of one length), n_rows, n_cols, source, numeric_cols and markdown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_if, let, normalize_text

# Patterns that define the results.
NUMERIC_LIKE = (
    r"^[()\-\s]*\d[\d,./%-]*$",
    r"(?i)(억원|백만원|만원|원|%|bp|bps|배|x|주|천주|십억원|조원|usd|krw)",
    r"^[A-Za-z]{1,4}\s*\d+(?:\.\d+)?$",
)
UNIT_HINT = r"(?i)[\(%조억원백만원bpptxUSD원\)]"
SYMBOLS = r"[▪•□◦\-\(\)▲△▼▽■◆]+"
TOC_WORDS = ("CONTENTS", "목차", "INDEX", "APPENDIX", "부록")
DISCLAIMER_WORDS = ("DISCLAIMER", "COMPLIANCE", "면책", "준법", "COPYRIGHT", "ALL RIGHTS RESERVED")

Rows = Column


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``; 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def cleaned(rows: Rows) -> Rows:
    """Cells on one line; rows without text dropped."""
    return F.filter(F.transform(rows, lambda r: F.transform(r, normalize_text)), lambda r: F.exists(r, lambda c: c != ""))


def text_to_rows(text: Column) -> Rows:
    """Rows of a text: cells between tabs or two blanks; a cell of three or more tokens, all but one numeric, is spread."""
    numeric = lambda c: c.rlike(r"\d")

    def spread(cell: Column) -> Column:
        tokens = F.split(cell, r"(?U)\s+")
        dense = (F.size(tokens) >= 3) & (count_if(tokens, numeric) >= F.size(tokens) - 1)
        return F.when(dense, tokens).otherwise(F.array(cell))

    def line(x: Column) -> Column:
        cells = F.filter(F.transform(F.split(x, r"(?U)\s{2,}|\t"), lambda c: F.trim(c)), lambda c: c != "")
        return F.flatten(F.transform(cells, spread))

    rows = F.filter(F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), "\n"), line), lambda r: F.size(r) > 0)
    expected = F.when(F.size(F.get(rows, F.lit(0))) > 1, F.size(F.get(rows, F.lit(0)))).otherwise(F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    return F.transform(rows, lambda r: F.when((F.size(r) > expected + 2) & (expected > 1), rechunked(r, expected)).otherwise(r))


def has_row_label(cells: Column) -> Column:
    first, rest = F.get(cells, F.lit(0)), F.slice(cells, 2, 1_000_000)
    return (F.size(cells) >= 2) & ~first.rlike(r"\d") & (F.length(first) > 1) & (count_if(rest, lambda c: c.rlike(r"\d")) >= F.size(rest) * 0.5)


def rechunked(cells: Column, expected: Column) -> Column:
    """A labelled row with too many numbers: the numbers joined into ``expected`` - 1 cells."""
    rest = F.slice(cells, 2, 1_000_000)
    size = F.greatest(F.lit(1), F.ceil(F.size(rest) / F.greatest(F.lit(1), expected - 1))).cast("int")
    starts = F.when(F.size(rest) > 0, F.sequence(F.lit(1), F.greatest(F.size(rest), F.lit(1)), size)).otherwise(F.array().cast("array<int>"))
    joined = F.concat(F.slice(cells, 1, 1), F.transform(starts, lambda s: F.array_join(F.slice(rest, s, size), " ")))
    return F.when((expected >= 2) & (F.size(cells) > expected) & has_row_label(cells), F.slice(joined, F.lit(1), expected)).otherwise(cells)


def padded(rows: Rows) -> Rows:
    """All rows of the longest one's length."""
    most = lambda rs: F.coalesce(F.array_max(F.transform(rs, F.size)), F.lit(0))
    return let(rows, lambda rs: let(most(rs), lambda m: F.transform(rs, lambda r: F.concat(r, F.array_repeat(F.lit(""), m - F.size(r))))))


def header_likelihood(header: Column, data: Rows) -> Column:
    def share(cells: Column, test) -> Column:
        return ratio(count_if(cells, test), F.size(cells))

    digits = lambda c: c.rlike(r"\d")
    some = lambda cells: F.filter(cells, lambda c: F.trim(c) != "")

    def value(filled: Column) -> Column:
        lead = let(some(F.flatten(data)), lambda cells: share(cells, digits)) - share(filled, digits) + 0.2
        total = 0.45 * share(filled, lambda c: c.rlike("[A-Za-z가-힣]")) + 0.30 * share(filled, lambda c: F.length(c) <= 25) + 0.25 * F.greatest(F.lit(0.0), lead)
        return F.when(F.size(filled) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))).otherwise(0.0)

    return F.coalesce(let(some(header), value), F.lit(0.0))


def with_header_first(rows: Rows) -> Rows:
    """The likeliest header of the first three rows moved to the top; the first of equal ones wins."""

    def moved(rs: Column) -> Column:
        at = F.sequence(F.lit(0), F.least(F.lit(2), F.size(rs) - 1))
        scores = F.transform(at, lambda i: header_likelihood(F.get(rs, i), F.slice(rs, i + 2, 3)))
        best = let(scores, lambda v: F.array_position(v, F.array_max(v)).cast("int"))  # from 1
        return let(best, lambda b: F.concat(F.slice(rs, b, 1), F.slice(rs, F.lit(1), b - 1), F.slice(rs, b + 1, F.size(rs))))

    return let(rows, lambda rs: F.when(F.size(rs) > 0, moved(rs)).otherwise(rs))


def numeric_columns(rows: Rows) -> Column:
    """Columns with digits in 60 % or more of the filled cells of the first five data rows."""

    def found(rs: Column) -> Column:
        def numeric(i: Column) -> Column:
            cells = F.filter(F.transform(F.slice(rs, 2, 5), lambda r: F.get(r, i)), lambda c: F.trim(c) != "")
            return let(cells, lambda filled: (F.size(filled) > 0) & (ratio(count_if(filled, lambda c: c.rlike(r"\d")), F.size(filled)) >= 0.6))

        n = F.coalesce(F.size(F.get(rs, F.lit(0))), F.lit(0))
        return F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), numeric)).otherwise(F.array().cast("array<int>"))

    return let(rows, found)


def markdown(headers: Column, rows: Rows) -> Column:
    """A Markdown table; empty without headers."""
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.transform(headers, lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("-")))
    n = F.size(headers)
    body = F.transform(rows, lambda r: bar(F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(n - F.size(r), F.lit(0)))), F.lit(1), n), lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(" ")))))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit("")).otherwise(F.array_join(F.concat(F.array(bar(head), bar(F.transform(headers, lambda _: F.lit("---")))), body), "\n"))


def row_stability(rows: Rows) -> Column:
    """Share of the rows whose filled cells are within one of the commonest number; the first of equal numbers counts."""
    counts = F.filter(F.transform(rows, lambda r: count_if(r, lambda c: F.trim(c) != "")), lambda n: n > 0)
    return let(counts, lambda cs: let(first_mode(cs), lambda mode: ratio(count_if(cs, lambda n: F.abs(n - mode) <= 1), F.size(cs))))


def first_mode(values: Column) -> Column:
    """The commonest value; the first of equally common ones."""
    return let(values, lambda vs: let(F.transform(vs, lambda n: count_if(vs, lambda m: m == n)), lambda often: F.get(vs, (F.array_position(often, F.array_max(often)) - 1).cast("int"))))


def numeric_consistency(rows: Rows, columns: Column, n_cols: Column) -> Column:
    """Mean share of cells with digits in the numeric columns' data rows."""
    data = F.slice(rows, 2, 1_000_000)

    def share(i: Column) -> Column:
        cells = F.filter(F.transform(data, lambda r: F.get(r, i)), lambda c: F.trim(c) != "")
        return let(cells, lambda filled: F.when(F.size(filled) > 0, ratio(count_if(filled, lambda c: c.rlike(r"\d")), F.size(filled))))

    shares = F.filter(F.transform(columns, share), lambda s: s.isNotNull())
    mean = let(shares, lambda v: ratio(F.aggregate(v, F.lit(0.0), lambda a, s: a + s), F.size(v)))
    return F.when((n_cols <= 0) | (F.size(rows) <= 1), 0.0).when(F.size(columns) == 0, F.when(n_cols >= 2, 0.15).otherwise(0.0)).otherwise(mean)


def long_text_ratio(rows: Rows) -> Column:
    def long(r: Column) -> Column:
        def judge(filled: Column) -> Column:
            size = F.length(F.array_join(filled, " "))
            return ((F.size(filled) <= 1) & (size > 90)) | (size / F.greatest(F.lit(1), F.size(filled)) > 70)

        return let(F.filter(r, lambda c: F.trim(c) != ""), judge)

    return F.when(F.size(rows) > 0, ratio(count_if(rows, long), F.size(rows))).otherwise(1.0)


def symbolic_ratio(rows: Rows) -> Column:
    cells = F.filter(F.transform(F.flatten(rows), lambda c: F.trim(c)), lambda c: c != "")
    symbolic = lambda c: c.rlike(SYMBOLS) & (F.regexp_count(c, F.lit("[A-Za-z가-힣0-9]")) <= 1)
    return let(cells, lambda cs: F.when(F.size(cs) > 0, ratio(count_if(cs, symbolic), F.size(cs))).otherwise(1.0))


def source_bias(source: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    return F.when(s.contains("camelot"), 1.0).when(s.contains("pdfplumber"), 0.9).when(s.contains("ocr"), 0.3).otherwise(0.5)


def normalized(rows: Rows, source: Column, title: Column) -> Column:
    """The normalised table struct of raw rows."""

    def table(ready: Column) -> Column:
        headers = F.coalesce(F.get(ready, F.lit(0)), F.array().cast("array<string>"))
        return F.struct(
            title.alias("title"), headers.alias("headers"), ready.alias("rows"), F.size(ready).alias("n_rows"), F.size(headers).alias("n_cols"), source.alias("source"),
            numeric_columns(ready).alias("numeric_cols"), markdown(headers, F.slice(ready, 2, 1_000_000)).alias("markdown"),
        )

    return let(with_header_first(padded(cleaned(rows))), table)


def _prose(text: Column, rows: Rows) -> Column:
    """Sentences mixed with both a wide row and a long single cell."""
    sentences = count_if(F.split(text, r"(?U)[.?!]\s+"), lambda s: F.length(F.trim(s)) > 15)
    filled = F.transform(rows, lambda r: count_if(r, lambda c: F.trim(c) != ""))
    long_single = F.exists(F.arrays_zip(rows.alias("r"), filled.alias("n")), lambda z: (z["n"] == 1) & (F.length(F.get(z["r"], F.lit(0))) > 50))
    return (F.length(text) > 100) & text.contains("다.") & (sentences >= 2) & F.exists(filled, lambda n: n >= 3) & long_single


def quality(table: Column) -> Column:
    """The table's quality: nine ratios, the overall score and the reject signals, in a struct."""
    return let(table, lambda t: let(_measures(t), lambda m: _quality(t, m)))


def _measures(table: Column) -> Column:
    """What the quality is made of, worked out once."""
    rows = table["rows"]
    return F.struct(
        F.filter(F.transform(F.flatten(rows), lambda c: F.trim(c)), lambda c: c != "").alias("filled"), header_likelihood(table["headers"], F.slice(rows, 2, 1_000_000)).alias("likely"), row_stability(rows).alias("stable"), long_text_ratio(rows).alias("long"),
        numeric_consistency(rows, table["numeric_cols"], table["n_cols"]).alias("numeric"), symbolic_ratio(rows).alias("symbolic"), F.filter(F.transform(F.slice(rows, 2, 1_000_000), lambda r: F.trim(F.get(r, F.lit(0)))), lambda c: c != "").alias("body"),
    )


def _quality(table: Column, m: Column) -> Column:
    rows, headers, n_rows, n_cols = table["rows"], table["headers"], table["n_rows"], table["n_cols"]
    filled, total = m["filled"], n_rows * n_cols
    empty = ratio(total - F.size(filled), F.greatest(F.lit(1), total))
    complete = ratio(count_if(headers, lambda h: F.trim(h) != ""), F.greatest(F.lit(1), F.size(headers)))
    likely = m["likely"]
    repeats = 1.0 - ratio(F.size(F.array_distinct(filled)), F.greatest(F.lit(1), F.size(filled)))
    stable, long, numeric, symbolic, body = m["stable"], m["long"], m["numeric"], m["symbolic"], m["body"]
    hint = F.concat(F.array_join(F.slice(body, 1, 2), " "), F.lit(" "), F.coalesce(F.get(headers, F.lit(0)), F.lit(""))).rlike(UNIT_HINT)
    compact = (n_cols == 1) & (n_rows >= 2) & (F.size(body) > 0) & (likely >= 0.72) & (long < 0.45) & (symbolic < 0.35) & ((numeric >= 0.15) | (ratio(count_if(body, lambda c: c.rlike(r"\d")), F.size(body)) >= 0.7)) & hint
    digits = lambda r: count_if(r, lambda c: c.rlike(r"\d"))
    collapsed = F.exists(rows, lambda r: (F.size(r) > 15) & (digits(r) > 10))
    narrative = F.exists(rows, lambda r: (F.length(F.get(r, F.lit(0))) > 80) & (digits(r) > 2))
    giant = (n_rows < 3) & (F.length(F.array_join(F.flatten(rows), "")) > 300)
    shape = F.when(giant | collapsed | narrative, 0.1).when(n_rows > 50, 0.5).when((n_cols < 2) | (n_rows < 2), F.when(compact, 0.55).otherwise(0.05)).otherwise(1.0)
    text = F.array_join(F.transform(rows, lambda r: F.array_join(r, " ")), "\n")
    sparse = (total > 0) & (ratio(F.size(filled), total) < 0.2)
    signals = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in (
        (_prose(text, rows), "dashboard_mixed_table"), (giant, "giant_dump_table"), (collapsed, "collapsed_row_table"), (narrative, "mixed_narrative_table"), ((n_cols < 2) & ~compact, "single_column_pseudo_table"),
        (long > 0.5, "long_text_dump_table"), (stable < 0.28, "unstable_row_shape"), (empty > 0.78, "mostly_empty_cells"), (symbolic > 0.55, "symbolic_pseudo_table"), (sparse, "non_rectangular_sparse_table"),
    ))))
    bias = source_bias(table["source"])
    overall = (1.0 - empty) * 2.0 + complete + likely * 1.2 + numeric * 1.4 + shape * 2.0 - long * 2.0 - symbolic * 2.2 - repeats + stable * 1.4 + bias * 0.4
    none = F.coalesce(n_rows, F.lit(0)) == 0
    zero = lambda c, empty_value=0.0: F.when(none, F.lit(empty_value)).otherwise(c)
    return F.struct(
        zero(empty, 1.0).alias("empty_cell_ratio"), zero(complete).alias("header_completeness"), zero(likely).alias("header_likelihood"), zero(numeric).alias("numeric_alignment"), zero(shape).alias("shape_plausibility"),
        zero(repeats).alias("duplication"), zero(stable).alias("row_stability"), zero(long, 1.0).alias("long_text_ratio"), zero(symbolic).alias("symbolic_ratio"), zero(bias).alias("source_bias"),
        zero(overall).alias("overall"), F.when(none, F.array().cast("array<string>")).otherwise(signals).alias("reject_signals"),
    )


def readiness(table: Column, signals: Column) -> Column:
    """``summary_ready`` or the reason why not."""
    rows, n_rows, n_cols = table["rows"], table["n_rows"], table["n_cols"]
    first_numeric = count_if(F.slice(rows, 2, 1_000_000), lambda r: F.get(r, F.lit(0)).rlike(r"\d"))
    filled = count_if(F.flatten(rows), lambda c: F.trim(c) != "")
    out = F
    for reason in ("dashboard_mixed_table", "giant_dump_table", "collapsed_row_table", "micro_fragment_table", "mixed_narrative_table", "non_rectangular_sparse_table", "single_column_pseudo_table", "symbolic_pseudo_table", "no_row_labels"):
        out = out.when(F.array_contains(signals, reason), F.lit(reason))
    return (
        out.when(n_rows == 0, "no_rows").when(n_rows < 2, "micro_fragment_table").when(~F.exists(table["headers"], lambda h: F.trim(h) != ""), "no_headers")
        .when((first_numeric == n_rows - 1) & (n_cols <= 5) & (n_rows - 1 < 3), "no_row_labels").when(ratio(filled, n_rows * n_cols) < 0.3, "non_rectangular_sparse_table").otherwise("summary_ready")
    )


def dashboard_readiness(table: Column, signals: Column) -> Column:
    """``dashboard_allowlist_kept`` or the reason why not."""
    rows = table["rows"]
    filled = F.transform(rows, lambda r: count_if(r, lambda c: F.trim(c) != ""))
    mode = first_mode(filled)
    prose = F.exists(F.flatten(rows), lambda c: (F.length(F.trim(c)) > 50) & F.trim(c).rlike("(다|요)\\.$"))
    headerish = count_if(rows, lambda r: count_if(r, lambda c: ~c.rlike(r"\d")) > mode * 0.7)
    mixed = F.arrays_overlap(signals, F.array(F.lit("dashboard_mixed_table"), F.lit("giant_dump_table"), F.lit("mixed_narrative_table")))
    return (
        F.when(table["n_rows"] < 3, "dashboard_compact_table_fail").when(mixed, "dashboard_rank_grid_mixed").when(mode < 2, "dashboard_compact_table_fail")
        .when(count_if(filled, lambda n: (n != mode) & (n > 0)) > table["n_rows"] * 0.5, "dashboard_multi_region_table").when(prose, "dashboard_rank_grid_mixed")
        .when(headerish > 3, "dashboard_multi_region_table").otherwise("dashboard_allowlist_kept")
    )


def candidate_score(kind: Column, source: Column, text: Column, rows: Rows, area_ratio: Column, aspect: Column) -> Column:
    """``struct(score, signals, rejects)`` of a block that may be a table. A null area or aspect is no evidence."""
    measured = F.struct(F.trim(F.coalesce(text, F.lit(""))).alias("text"), rows.alias("rows"), quality(normalized(rows, source, F.nullif(F.substring(F.trim(text), 1, 120), F.lit("")))).alias("q"))
    return let(measured, lambda m: _candidate(kind, source, m["text"], m["rows"], area_ratio, aspect, m["q"]))


def _candidate(kind: Column, source: Column, text: Column, rows: Rows, area_ratio: Column, aspect: Column, q: Column) -> Column:
    upper = F.upper(text)
    n_lines, n_tokens = F.size(F.split(text, "\n")), F.size(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""))
    numbers = F.regexp_count(text, F.lit(r"\d+"))
    density = numbers / F.greatest(F.lit(1), F.length(F.replace(text, F.lit(" "), F.lit(""))))
    mean = F.length(text) / n_lines
    some = F.coalesce(F.size(rows) > 0, F.lit(False))
    any_word = lambda words, c: F.coalesce(F.greatest(*(c.contains(w) for w in words)), F.lit(False))
    engine = source.contains("camelot") | source.contains("pdfplumber")
    small = F.coalesce((area_ratio < 0.005) | ((area_ratio < 0.02) & (n_tokens < 5)), F.lit(False))
    rules = (
        (engine, 3.0, "engine", True), (any_word(TOC_WORDS, F.substring(upper, 1, 50)), -5.0, "toc_or_appendix_keywords", False), (any_word(DISCLAIMER_WORDS, upper), -2.0, "disclaimer_compliance_zone", False),
        (text.rlike(r"\.{5,}\s*\d+") | text.rlike(r"(?U)[\s_]{5,}\s*\d+"), -3.0, "toc_page_number_pattern", False), (n_lines >= 3, 1.0, "min_rows_met", True), ((n_lines >= 3) & (mean > 100), -3.0, "paragraph_like_dump", False),
        ((n_lines >= 3) & (mean < 40), 1.0, "short_label_structure", True), ((numbers > 0) & (density > 0.15), 2.0, "high_numeric_density", True), ((numbers > 0) & (density < 0.02) & (kind != "image"), -2.0, "low_numeric_density", False),
        (some & (q["empty_cell_ratio"] < 0.45), 1.0, "structured_fill_ratio_ok", True), (some & (q["row_stability"] > 0.65), 1.0, "stable_row_shape", True), (some & (q["header_likelihood"] > 0.5), 0.8, "header_likely", True),
        (some & (q["long_text_ratio"] > 0.45), -3.0, "long_text_dump_table", False), (some & (q["empty_cell_ratio"] > 0.78), -3.0, "mostly_empty_cells", False), (some & (q["row_stability"] < 0.28), -2.5, "unstable_row_shape", False),
        (small, -4.0, "small_kpi_or_logo_area", False), (F.coalesce((aspect > 15) | (aspect < 0.1), F.lit(False)), -3.0, "decorative_separator_shape", False),
    )
    score = F.lit(1.0) + F.when(some, F.greatest(F.lit(-2.5), F.least(F.lit(3.5), q["overall"] * 0.45))).otherwise(0.0)
    for condition, weight, _, _ in rules:
        score = score + F.when(condition, weight).otherwise(0.0)
    named = lambda good: F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, _, n, g in rules if g == good)))
    return F.struct(score.alias("score"), named(True).alias("signals"), named(False).alias("rejects"))


def numeric_like(cell: Column) -> Column:
    return (cell != "") & (cell.rlike(NUMERIC_LIKE[0]) | (cell.rlike(r"\d") & cell.rlike(NUMERIC_LIKE[1])) | cell.rlike(NUMERIC_LIKE[2]))


def record_columns(cells: Column) -> Column:
    """Columns of a flat cell list: the divisors from 2 to 14."""
    n = F.size(cells)
    return F.filter(F.sequence(F.lit(2), F.lit(14)), lambda c: (n % c == 0) & (n / c >= 2))


def rows_as_text(rows: Rows) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")
