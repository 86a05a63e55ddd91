"""Page text for retrieval and the predicates that judge pages, blocks, lines and table rows; Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# --- fixed values -------------------------------------------------------------------------------------------------
DISCLAIMER = ("본자료는", "투자권유", "법적책임", "증빙자료", "광고물로활용", "면책")
PAGE_DISCLAIMER = ("본자료는", "투자권유", "법적책임", "증빙자료", "광고물로활용", "면책", "투자판단", "endofdocument")
CONTENTS = ("contents", "목차", "appendix", "index")
DASHBOARD_WORDS = ("1d", "1w", "1m", "수익률", "순매수", "종목", "업종", "테마", "ytd", "qoq", "yoy")
NOISE_TEXTS = (
    "2025년", "20252", "qoq", "%", "b+", "a", "contents", "본 자", "태메젯증권", "1분기", "2분기", "3분기", "4분기", "2025", "2024", "2026", "사업별 주", "분기별", "결산",
)
NOISE_YEAR = r"^(20[2-3]\d)(년|말|분기|\.|2)?$"
NOISE_PHRASE = r"^(본\s?자|사업별\s?주|순영업수익|국내주식|해외주식\s?수|운용손의|감사합니다|eso등|규제비율|규제비율\s?1c|일간\s?상승|주요\s?이벤|전월\s?대비)$"
TITLE_QUESTIONS = ("문서제목", "문서명", "파일명", "제목이뭐", "제목뭐", "documenttitle", "filename")
WEAK_REASONS = ("footer", "disclaimer", "date_metadata", "contact_metadata", "axis_label")
DECORATIVE = ("decorative", "disclaimer", "footer", "page_number", "noise")
DATES = r"20\d{2}[.년/]?\d{1,2}[.월]?"
MEANING = "[A-Za-z0-9가-힣]"
#: Characters of a page's own text from which no image asks for reading it, and images that do.
NATIVE_ENOUGH, IMAGES = 60, 1
# ------------------------------------------------------------------------------------------------------------------


def tidy(c: Column, limit: int | None = None) -> Column:
    """Lines stripped, empty ones dropped, blanks single; cut at ``limit`` characters with ``...``; null is empty."""
    flat = F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\x00"), F.lit(" ")), r"[ \t\r\f\x0B]+", " ")
    joined = F.array_join(T.lines(flat), "\n")
    if limit is None:
        return joined
    return T.let(joined, lambda x: F.when(F.length(x) > limit, F.concat(F.regexp_replace(F.substring(x, 1, limit), r"(?U)\s+\z", ""), F.lit("..."))).otherwise(x))


def disclaimer(*texts: Column) -> Column:
    """Whether one of the texts, blanks aside, holds a disclaimer's words."""
    return _any(texts, lambda c: T.contains_any(F.replace(F.lower(c), F.lit(" "), F.lit("")), DISCLAIMER))


def contents(*texts: Column) -> Column:
    """Whether one of the texts names a table of contents, an appendix or an index."""
    return _any(texts, lambda c: T.contains_any(F.lower(c), CONTENTS))


def _any(texts: tuple[Column, ...], test) -> Column:
    found = F.lit(False)
    for c in texts:
        found = found | F.coalesce(test(c), F.lit(False))
    return found


def without_report_prefix(c: Column) -> Column:
    """Without the report's running title before it, if three characters or more stay."""
    return T.let(tidy(c), lambda x: T.let(T.strip(F.regexp_replace(x, r"^(20\d{2}년[^\s]{0,24}?보고서)+", "")), lambda y: F.when(F.length(y) >= 3, y).otherwise(x)))


def focused(c: Column) -> Column:
    """From its quarter heading on, if what stands before is mostly figures."""
    at = F.regexp_instr(c, F.lit(r"\[[1-4]Q20\d{2}\]"))
    before = F.substring(c, F.lit(1), at - 1)
    figures = F.regexp_count(before, F.lit("[0-9%()., ]"))
    return F.when((at > 1) & (figures >= F.greatest(F.lit(3), F.floor(F.length(before) * 0.35))), T.strip(F.substring(c, at, F.length(c)))).otherwise(c)


def compact(c: Column, limit: int = 140) -> Column:
    """A title or body text without running title and leading figures; empty for a disclaimer. Titles take 140 characters, bodies 700."""
    return T.let(T.let(without_report_prefix(c), focused), lambda x: F.when((x == "") | disclaimer(x), "").otherwise(tidy(x, limit)))


def metric_list(c: Column) -> Column:
    """At most twelve distinct figures of a list in a text; years, quarters and bare digits left out."""
    tokens = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)[,;|\s]+"), lambda t: F.regexp_replace(tidy(t), "^[ ,;]+|[ ,;]+$", ""))
    bare = lambda t: F.replace(t, F.lit(","), F.lit(""))
    period = lambda b: b.rlike(r"^(20[0-3]\d년?|[1-4](q|Q|분기)?|[qQ][1-4]|24|25)$") | ((F.length(b) >= 5) & b.contains("2025") & ~b.contains("%") & ~b.contains("."))
    figure = lambda b: b.rlike(r"\d") & (b.contains("%") | b.contains(".") | (F.length(b) >= 2))
    return F.slice(T.distinct_by(F.filter(tokens, lambda t: (t != "") & figure(bare(t)) & ~period(bare(t))), lambda t: F.lower(bare(t))), 1, 12)


def table_text(summary: Column, key_values: Column, markdown: Column, rows: Column, text: Column) -> Column:
    """What a table says: its summary, key values and Markdown; else its size and first rows; else its text."""
    pair = lambda r: F.concat(F.lit("- "), tidy(r["item"], 120), F.lit(": "), tidy(r["values"], 180))
    pairs = F.transform(F.filter(F.slice(key_values, 1, 12), lambda r: (tidy(r["item"]) != "") & (tidy(r["values"]) != "")), pair)
    under = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{label}]\n"), c))
    parts = F.array_compact(F.array(under("TABLE SUMMARY", tidy(summary, 1000)), under("TABLE KEY VALUES", F.array_join(pairs, "\n")), under("TABLE", tidy(markdown, 1800))))
    shown = F.array_join(F.transform(F.slice(rows, 1, 3), lambda r: F.array_join(F.transform(r, lambda c: tidy(c, 80)), " | ")), "\n")
    size = F.concat(F.size(rows).cast("string"), F.lit(" rows, "), F.array_max(F.transform(rows, F.size)).cast("string"), F.lit(" columns"))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.concat(F.lit("[TABLE]\n"), size, F.lit("\n"), shown)).otherwise(F.coalesce(under("TABLE", tidy(text, 500)), F.lit("")))


def priority_rank(priority: Column) -> Column:
    """3 high, 2 medium, 1 unsaid, 0 low."""
    p = F.lower(F.coalesce(priority, F.lit("")))
    return F.when(p == "high", 3).when(p == "medium", 2).when(p == "low", 0).otherwise(1)


def weak(kind: Column, text: Column, reason: Column, priority: Column) -> Column:
    """Text blocks that say too little for a page's text."""
    metric = text.rlike(r"(?i)\d|%|bp|p\)")
    said = F.regexp_count(text, F.lit(MEANING))
    small = ((said < 3) & ~metric) | ((F.length(text) <= 5) & ~metric & (priority_rank(priority) < 2))
    out = (kind == "footer") | F.coalesce(reason.isin(*WEAK_REASONS), F.lit(False)) | disclaimer(text)
    return (F.coalesce(text, F.lit("")) == "") | out | ((priority_rank(priority) < 3) & small)


def visual_noise(c: Column) -> Column:
    """Text on a visual that is debris: years, stock phrases, few letters, repeated or mostly symbolic characters."""

    def judge(t: Column) -> Column:
        low, n, letters = F.lower(t), F.length(t), F.regexp_count(t, F.lit("[a-zA-Z가-힣]"))
        words = F.size(T.words(t))
        variety = F.size(F.array_distinct(F.filter(F.split(F.replace(t, F.lit(" "), F.lit("")), ""), lambda x: x != "")))
        short = (words <= 2) & (n <= 20) & (T.contains_any(low, NOISE_TEXTS) | (letters < 5))
        return (
            (t == "") | low.rlike(NOISE_YEAR) | low.rlike(NOISE_PHRASE) | low.isin(*NOISE_TEXTS) | ((n <= 8) & ~t.rlike("[가-힣a-zA-Z]{4,}")) | (letters < 2) | ((n > 5) & (variety <= 2))
            | ((letters < n * 0.3) & (n < 40)) | ((n <= 12) & (letters <= 6)) | ((n <= 15) & (letters <= 3)) | short
        )

    return T.let(T.strip(F.coalesce(c, F.lit(""))), judge)


def meaningful_header(cells: Column) -> Column:
    """A header row with a cell of letters or digits, no contents words and not mostly symbols."""

    def judge(filled: Column) -> Column:
        size = F.aggregate(filled, F.lit(0), lambda a, c: a + F.length(c))
        symbols = F.aggregate(filled, F.lit(0), lambda a, c: a + F.regexp_count(c, F.lit(r"[▪%().\-/|]")))
        return (F.size(filled) > 0) & ~F.exists(filled, lambda c: contents(c)) & F.exists(filled, lambda c: c.rlike(MEANING)) & ~(symbols > size * 0.8)

    return F.coalesce(T.let(F.filter(F.transform(cells, T.strip), lambda c: c != ""), judge), F.lit(False))


def meaningful_rows(rows: Column) -> Column:
    """Whether a row has more than one lone figure and some letter or digit."""

    def good(filled: Column) -> Column:
        lone = (F.size(filled) == 1) & F.get(filled, F.lit(0)).rlike(r"^[\d.,%\-]+$")
        return (F.size(filled) > 0) & ~lone & F.exists(filled, lambda c: c.rlike(MEANING))

    return F.coalesce(F.exists(rows, lambda r: T.let(F.filter(F.transform(r, T.strip), lambda c: c != ""), good)), F.lit(False))


def reading_needed(native: Column, images: Column, hint: Column) -> Column:
    """``struct(needed, reason)``: whether a page has to be read optically.

    An empty page has; a page with enough text only if too little of it is letters
    and digits, the sooner on slides; one with little text if it has images.
    """

    def judge(m: Column) -> Column:
        share, symbols = m["meaning"] / m["n"], 1.0 - m["meaning"] / m["n"]
        line_share, short = m["good"] / F.greatest(F.lit(1), m["lines"]), m["short"] / F.greatest(F.lit(1), m["tokens"])
        slide = hint.isin("slide_like", "mixed_visual") & (share < 0.45) & ((symbols > 0.4) | (line_share < 0.5) | (short > 0.5))
        poor = (share < 0.35) & ((symbols > 0.6) | (line_share < 0.4) | (short > 0.6))
        said = lambda needed, why: F.struct(F.lit(needed).alias("needed"), F.lit(why).alias("reason"))
        enough = F.when(slide, said(True, "sensitive_slide_low_density")).when(poor, said(True, "low_alphanumeric_density")).otherwise(said(False, "ocr_not_needed"))
        scarce = F.when(images >= IMAGES, said(True, "images_present_and_text_weak")).when(share < 0.3, said(True, "short_and_low_alphanumeric")).otherwise(said(False, "native_text_below_threshold_but_no_images"))
        return F.when(m["length"] == 0, said(True, "native_text_empty")).when(m["n"] == 0, said(True, "native_text_whitespace_only")).when(m["length"] >= NATIVE_ENOUGH, enough).otherwise(scarce)

    native = F.coalesce(native, F.lit(""))
    dense, all_lines = F.regexp_replace(native, "[ \n]", ""), T.lines(native)
    tokens = F.flatten(F.transform(all_lines, T.words))
    measured = F.struct(
        F.length(native).alias("length"), F.length(dense).alias("n"), F.regexp_count(dense, F.lit(MEANING)).alias("meaning"), F.size(all_lines).alias("lines"), F.size(tokens).alias("tokens"),
        T.count_if(all_lines, lambda x: F.regexp_count(x, F.lit(MEANING)) >= 3).alias("good"), T.count_if(tokens, lambda t: F.length(t) <= 2).alias("short"),
    )
    return T.let(measured, judge)


def narrative_profile(c: Column) -> Column:
    """``struct(num_ratio, endings, long_paragraphs, labels, dashboard)`` of a text."""
    c = F.coalesce(c, F.lit(""))
    dense, all_lines = F.regexp_replace(c, "[ \n]", ""), F.filter(F.transform(F.split(c, "\n"), T.strip), lambda x: x != "")
    share = F.regexp_count(dense, F.lit(r"\d")) / F.greatest(F.lit(1), F.length(dense))
    endings = F.regexp_count(c, F.lit(r"[가-힣][다음함]\."))
    long = T.count_if(all_lines, lambda x: (F.length(x) > 60) & x.rlike("[다음함]"))
    labels = T.count_if(all_lines, lambda x: (F.length(x) < 30) & x.rlike(r"[:\-•\[\]]"))
    return F.struct(F.round(share, 3).alias("num_ratio"), endings.alias("endings"), long.alias("long_paragraphs"), labels.alias("labels"), ((share > 0.25) & (endings <= 1) & (long == 0)).alias("dashboard"))


def title_question(c: Column) -> Column:
    """Whether a question asks for the document's title or file name."""
    return T.contains_any(F.lower(T.squeezed(F.coalesce(c, F.lit("")))), TITLE_QUESTIONS)


# --- lines of a dashboard ------------------------------------------------------------------------------------------


def share_of(c: Column, pattern: str) -> Column:
    """Share of a line's characters that ``pattern``, a class, has."""
    t = T.strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) == 0, 0.0).otherwise(T.char_count(t, pattern) / F.length(t))


def line_signals(t: Column, digit: Column, width: Column, page_width: Column) -> dict[str, Column]:
    """What a dashboard line looks like, by name: ``t`` is the stripped line, ``digit`` whether it has one.

    Patterns come after what is cheap to see: most lines have no digit, no bar and no mark at their beginning, or are too long.
    """
    n = F.length(t)
    count = lambda chars: T.char_count(t, chars)
    share = lambda chars: F.when(n == 0, 0.0).otherwise(count(chars) / n)
    bars, figures = n - F.length(F.replace(t, F.lit("|"), F.lit(""))), count(r"[\d|%\-+,./]")
    ticks = F.when(digit & t.contains("/"), F.regexp_count(t, F.lit(r"\d{1,2}/\d{1,2}"))).otherwise(0)
    topic = t.startswith("[") & t.rlike(r"^\[[^\]\n]{1,24}\]\s*\S")
    value = digit & (n <= 32) & t.rlike(r"(?i)[%+\-]|bp|bps|x\b") & ((width >= 12.0) | (n >= 4))
    unit = t.startswith("(") & (n <= 22) & t.rlike(r"^\([^)]{1,18}\)\s*$") | ((n <= 12) & (share(r"[|%\-+,./()]") >= 0.2) & (share(r"\d") < 0.35))
    return {
        "metric_value": value,
        "topic_start": topic,
        "issue_box": topic | ((n <= 80) & t.rlike(r"^[A-Za-z][A-Za-z0-9 /\-&]{1,40}:$")),
        "ranking": (digit & t.rlike(r"^\d{1,2}[.)]\s+\S")) | ((t.startswith("-") | t.startswith("*")) & t.rlike(r"^[\-*]\s+\S")),
        "mini_table": ((bars >= 1) & (width > page_width * 0.12)) | (digit & (F.regexp_count(t, F.lit(r"(?i)\b\d{1,2}[QH]\d{2,4}[A-Z]?\b")) >= 2)) | (digit & (F.regexp_count(t, F.lit(r"(?i)\b(?:1D|1W|1M|3M|6M|12M)\b")) >= 2)),
        "contact": (t.contains("@") & t.rlike(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")) | (digit & t.rlike(r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{2,4}[-.\s]?\d{2,4}")),
        "axis_tick": (n <= 36) & (ticks >= 1),
        "unit_label": unit,
        "tiny_numeric": (n == 0) | ((n <= 5) & (width < 18) & ~value & t.rlike(r"^[\d.,%+\-]{1,5}$")),
        "debris": (n == 0) | (bars >= 2) | (ticks >= 2) | ((n <= 40) & (ticks >= 1)) | (t.startswith("(") & (n <= 20) & t.rlike(r"^\([^)]+\)\s*$")) | ((n < 52) & (figures >= 0.5 * n) & (count("[A-Za-z가-힣]") < F.greatest(F.lit(6), F.floor(n / 5)))),
        "context": (n > 0) & ~(digit & (n <= 3) & (share(r"\d") >= 0.34)) & ~(digit & (share(r"\d") >= 0.62) & (share("[A-Za-z가-힣]") < 0.18)),
        "prose": t.contains(".") | t.rlike(r"[。?？!！;；:：]"),
    }


def decorative_shape(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Visual fragments too small or too thin to show anything."""
    area = width * height / (page_width * page_height)
    return (width <= 0) | (height <= 0) | (area < 0.0005) | ((width < page_width * 0.03) & (height < page_height * 0.03)) | ((width > page_width * 0.5) & (height < page_height * 0.008)) | ((height > page_height * 0.5) & (width < page_width * 0.008))


def key_value_rows(lines: Column) -> Column:
    """``ARRAY<STRUCT<item, values>>`` of the lines with figures: the label without them, and the figures joined; ``metric`` without a label."""
    figure = r"(?i)[-+]?\d[\d,]*(?:\.\d+)?\s*(?:%|bp|bps|원|억원|조원|조|USD|pt|x)?"
    figures = lambda x: F.filter(F.transform(F.regexp_extract_all(x, F.lit(figure), F.lit(0)), T.strip), lambda t: t != "")

    def row(x: Column) -> Column:
        def made(found: Column) -> Column:
            bare = F.aggregate(found, x, lambda label, t: F.replace(label, t, F.lit(" ")))
            label = F.regexp_replace(T.normalize_text(F.regexp_replace(bare, r"^[\s\-*+•▪●○]+", "")), "^[ :;,]+|[ :;,]+$", "")
            return F.struct(F.coalesce(F.nullif(label, F.lit("")), F.lit("metric")).alias("item"), F.array_join(found, ", ").alias("values"))

        return T.let(figures(x), lambda found: F.when(F.size(found) > 0, made(found)))

    return F.filter(F.transform(lines, row), lambda r: r.isNotNull())


def html_table(rows: Column, most_rows: int = 300, most_columns: int = 32) -> Column:
    """Rows as an HTML table, the first one as its head if others follow; empty without cells."""
    shown = F.filter(F.transform(F.slice(rows, 1, most_rows), lambda r: F.transform(F.slice(r, 1, most_columns), lambda c: F.coalesce(c, F.lit("")))), lambda r: F.exists(r, lambda c: c != ""))

    def table(rs: Column) -> Column:
        width = F.array_max(F.transform(rs, F.size))
        line = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.concat(F.lit(f"<{tag}>"), T.escaped_html(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
        head = F.concat(F.lit("<thead>"), line(F.get(rs, F.lit(0)), "th"), F.lit("</thead>"))
        body = lambda part: F.concat(F.lit("<tbody>"), F.array_join(F.transform(part, lambda r: line(r, "td")), ""), F.lit("</tbody>"))
        inner = F.when(F.size(rs) > 1, F.concat(head, body(F.slice(rs, F.lit(2), F.size(rs))))).otherwise(body(rs))
        return F.when(F.size(rs) > 0, F.concat(F.lit("<table>"), inner, F.lit("</table>"))).otherwise("")

    return F.coalesce(T.let(shown, table), F.lit(""))


def portable_path(path: Column, root: str) -> Column:
    """A path relative to ``root`` if it lies below it; else as it is."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)
