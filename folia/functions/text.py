"""Text functions and predicates as Column expressions; none leaves the JVM.

Lengths count code points. White space is Unicode white space throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column

# --- fixed values -------------------------------------------------------------------------------------------------
# Patterns and word lists that define the results.
SENTENCE_END = r"[.!?]\s|[.!?]$|[다요음]\s|[다요음]$"
PHONE = r"(?:\+?\d[\d\s().-]{6,}\d)"
EMAIL = r"\b[^@\s]+@[^@\s]+\.[^@\s]+\b"
URL = r"(?i)\b(?:https?://|www\.)\S+\b"
METRIC = r"\d[\d,]*(?:\.\d+)?(?:\s*[%]|[A-Za-z]{1,4})?"
UNITS = r"%p|%|bp|bps|억원|조원|만원|원|명|개|주|배|x|pt|십억원|백만원|조|억"
VALUE = r"(?i)(?<![A-Za-z0-9])[+-]?(?:\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)(?:\s?(?:" + UNITS + r"))?"
PERIOD = r"(?i)\b(?:[1-4]Q\d{2,4}|20\d{2}[./-]?\d{0,2})\b"
NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)"
METRIC_SIGNAL = (
    r"(?i)(?:\d[\d,.\-]*\s*(?:%|bp|bps|x|배|건|명|원|달러|usd|krw|억원|백만원|천만원|million|billion|mn|bn))"
    r"|(?:roe|bps|eps|ebitda|cagr|margin|growth|revenue|sales|profit|income|cash flow|guidance)"
)
#: The same in two parts: words are found faster one by one.
METRIC_AMOUNT = r"\d[\d,.\-]*\s*(?:%|bp|bps|x|배|건|명|원|달러|usd|krw|억원|백만원|천만원|million|billion|mn|bn)"
METRIC_WORDS = ("roe", "bps", "eps", "ebitda", "cagr", "margin", "growth", "revenue", "sales", "profit", "income", "cash flow", "guidance")
BOILERPLATE = (
    "contents", "table of contents", "appendix", "appendices", "annex", "annexes", "disclaimer", "compliance notice", "legal notice", "safe harbor",
    "forward-looking", "all rights reserved", "confidential", "목차", "부록", "별첨", "면책", "유의사항", "공표일", "참고자료",
)
CONTACT = (
    "analyst", "contact", "contacts", "investor relations", "ir contact", "e-mail", "email", "tel", "telephone", "phone", "fax", "www.", "@",
    "주소", "전화", "팩스", "이메일", "담당자", "문의",
)
PHONE_DIGITS = r"(?:\+\d{1,3}[\s\-]?)?(?:\d{2,4}[\s\-]?){2,}\d{3,4}"
TOC_TERMS = ("contents", "table of contents", "toc", "목차")
APPENDIX_TERMS = ("appendix", "appendices", "부록", "참고자료")
NO_SUPPORT = (
    r"확인할 수 없습니다", r"알 수 없습니다", r"찾을 수 없습니다", r"답변할 수 없습니다", r"응답할 수 없습니다",
    r"관련 (?:내용|정보|문장|근거)[^.\n]{0,24}(?:없|부족)", r"(?:내용|정보|근거)[^.\n]{0,16}없어[^.\n]{0,20}(?:답변|응답)할 수 없습니다", r"문맥(?:상)?[^.\n]{0,30}(?:없|부족)",
    r"제공된 문서[^.\n]{0,60}(?:포함되어 있지 않|확인할 수 없|찾을 수 없|답변할 수 없|응답할 수 없|없어)", r"지원[^.\n]{0,20}(?:되지 않|할 수 없)",
)
CHART_HINT = r"(?i)(chart|graph|trend|series|roe|bps|eps|margin|ratio|추이|그래프|차트|지표|비율|연환산|자기자본|수익률|판매관리비율)"
#: The same as words, for texts in lower case.
CHART_WORDS = ("chart", "graph", "trend", "series", "roe", "bps", "eps", "margin", "ratio", "추이", "그래프", "차트", "지표", "비율", "연환산", "자기자본", "수익률", "판매관리비율")
SERIES_HINT = r"(?i)(ROE|BPS|EPS|규제비율|판매관리비율|자기자본비율|레버리지비율)"
DATE_LIKE = (r"\b\d{4}[./-]\d{1,2}(?:[./-]\d{1,2})?\b", r"\b\d{4}년(?:\s*\d{1,2}월(?:\s*\d{1,2}일)?)?\b", r"(?i)\b\d{1,2}q\d{2,4}\b")
# ------------------------------------------------------------------------------------------------------------------

#: Unicode white space: what ``\s`` of (?U) patterns matches.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_NEWLINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: expressions that use it many times stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without leading and trailing white space."""
    return F.btrim(c, F.lit(_WHITE))


def clean_text(c: Column) -> Column:
    """Line ends as \\n, blanks collapsed, at most one empty line in a row, stripped; null is empty."""
    c = one_kind = F.coalesce(c.cast("string"), F.lit(""))
    for old, new in (("\r\n", "\n"), ("\r", "\n"), ("\t", " ")):
        one_kind = F.replace(one_kind, F.lit(old), F.lit(new))
    unclean = contains_any(c, ("\r", "\t", "  ", "\n\n\n"))  # most texts have none, and replacing and patterns cost more than all the rest
    return strip(F.when(unclean, F.regexp_replace(F.regexp_replace(one_kind, " {2,}", " "), r"\n{3,}", "\n\n")).otherwise(c))


def normalize_text(c: Column) -> Column:
    """One line: white space collapsed and stripped; null is empty."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return strip(F.when(c.rlike(r"(?U)[\s&&[^ ]]| {2}"), F.regexp_replace(c, r"(?U)\s+", " ")).otherwise(c))


def squeezed(c: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def truthy(c: Column, *more: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (c, *more)))


def evidence_preview(c: Column, limit: int = 600) -> Column:
    """At most ``limit`` characters of the normalised text, with ``...`` where it was cut."""
    compact = normalize_text(c)
    return F.when(F.length(compact) <= limit, compact).otherwise(F.concat(F.regexp_replace(F.substring(compact, 1, limit - 3), r"(?U)\s+\z", ""), F.lit("...")))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters rounded up; none for an empty text."""
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((F.length(c) + 3) / 4))).cast("int")


def chunk_tokens(c: Column) -> Column:
    """A quarter of the characters rounded down, at least 1: the chunk's own estimate."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def lines(c: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(c, _NEWLINES), strip), lambda x: x != "")


def count_if(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | c.contains(term)
    return found


def sentence_ends(c: Column) -> Column:
    """Sentence ends; if there are none, long lines."""
    clean = clean_text(c)
    ends = F.regexp_count(clean, F.lit(SENTENCE_END))
    return F.when(clean == "", 0).when(ends > 0, ends).otherwise(count_if(lines(clean), lambda x: F.length(x) >= 45))


def sentence_parts(c: Column) -> Column:
    """Parts between sentence ends and line ends."""
    return count_if(F.split(c, r"(?U)(?:[.!?]|(?<=[다요음임]))\s+|\n+"), lambda x: strip(x) != "")


def metric_like(c: Column) -> Column:
    """Numbers, with or without a short unit."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(METRIC))


def contact_signals(c: Column) -> Column:
    return F.regexp_count(c, F.lit(PHONE)) + F.regexp_count(c, F.lit(EMAIL)) + F.regexp_count(c, F.lit(URL))


def contactish(c: Column, limit: int = 220) -> Column:
    """A short text of contact details rather than prose."""
    clean = clean_text(c)
    marked = count_if(F.split(clean, _NEWLINES), lambda x: x.contains(":") | x.contains("|"))
    return (F.length(clean) <= limit) & (contact_signals(clean) >= 1) & (marked >= 1) & (sentence_ends(clean) == 0) & (metric_like(clean) <= 2)


def visual_contactish(c: Column, limit: int = 260) -> Column:
    """The same for the text of visuals: few metrics instead of no sentence."""
    clean = clean_text(c)
    marked = count_if(lines(clean), lambda x: x.contains(":") | x.contains("|"))
    return (F.length(clean) <= limit) & (contact_signals(clean) >= 1) & (marked >= 1) & (F.size(metric_tokens(clean)) <= 2)


def looks_metric(token: Column) -> Column:
    compact = squeezed(token)
    return compact.rlike(f"(?i)({UNITS})$") | compact.contains(",") | compact.rlike(r"^[+-]?\d+\.\d+$")


def plain_year(token: Column) -> Column:
    return squeezed(token).rlike(r"^20\d{2}$")


def distinct_by(items: Column, key) -> Column:
    """The first item of each key, in order."""
    return let(items, lambda xs: let(F.transform(xs, key), lambda keys: F.filter(F.transform(xs, lambda x, i: F.when(F.array_position(keys, F.get(keys, i)) == i + 1, x)), lambda x: x.isNotNull())))


def metric_tokens(c: Column) -> Column:
    """Distinct values with a unit, thousands separators or decimals, in order; plain years left out."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(VALUE), 0), clean_text)
    return distinct_by(F.filter(found, lambda t: (t != "") & ~plain_year(t) & looks_metric(t)), squeezed)


def period_tokens(c: Column) -> Column:
    """Distinct quarters, years and months, in order."""
    return distinct_by(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PERIOD), 0), F.lower)


def label_candidates(c: Column) -> Column:
    """Distinct pieces between lines, bars and slashes that may label something."""
    pieces = F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n\r|/]+"), clean_text)
    good = F.filter(pieces, lambda x: F.length(x).between(3, 90) & x.rlike("[A-Za-z가-힣]") & ~((F.length(x) > 50) & (char_count(x, r"\d") >= 4) & (F.size(metric_tokens(x)) >= 4)))
    return distinct_by(good, lambda x: F.lower(squeezed(x)))


def evidence(c: Column) -> Column:
    """``struct(metrics, periods, labels)``: how many distinct ones a text has."""
    return F.struct(F.size(metric_tokens(c)).alias("metrics"), F.size(period_tokens(c)).alias("periods"), F.size(label_candidates(c)).alias("labels"))


def metric_value(token: Column) -> Column:
    """``struct(value, unit)`` of a metric token; null without a number."""
    compact = squeezed(token)
    number = F.regexp_extract(compact, NUMBER, 0)
    return F.when(number != "", F.struct(F.replace(number, F.lit(","), F.lit("")).cast("double").alias("value"), F.lower(F.regexp_extract(compact, f"(?i)({UNITS})$", 1)).alias("unit")))


def metric_signal(c: Column) -> Column:
    return contains_any(F.lower(c), METRIC_WORDS) | c.rlike(f"(?i){METRIC_AMOUNT}")


def words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda x: x != "")


def explanatory(c: Column) -> Column:
    """Prose long enough to explain something."""
    return (F.length(c) >= 140) & ((sentence_parts(c) >= 2) | (F.size(words(c)) >= 18) | (F.length(c) >= 280))


def dense_body(c: Column) -> Column:
    long = count_if(lines(c), lambda x: F.length(x) >= 50)
    n = F.size(lines(c))
    return (n > 0) & ((long >= 2) | ((F.length(c) >= 260) & (n <= F.greatest(F.lit(4), F.floor(F.length(c) / 120)))))


def title_only(c: Column) -> Column:
    bare = strip(c)
    short = (F.length(bare) <= 110) & (F.size(lines(bare)) <= 3) & (F.size(words(bare)) <= 14)
    return (bare == "") | (short & (sentence_parts(bare) <= 1) & ~metric_signal(bare))


def char_count(c: Column, chars: str) -> Column:
    """How many characters of a class there are; a text for each isn't made, as counting matches does."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{chars}+", ""))


def numeric_heavy(c: Column) -> Column:
    """Figures and symbols rather than letters. Most texts have too few of them for anything else to be counted; none of the classes has white space."""

    def full(n: Column) -> Column:
        m = F.struct(F.length(squeezed(c)).alias("size"), char_count(c, r"[\d]").alias("digits"), char_count(c, "[A-Za-z가-힣]").alias("letters"))
        return let(m, lambda m: (m["size"] >= 40) & ((m["digits"] >= F.greatest(F.lit(14), m["letters"])) | (n > F.greatest(F.lit(24), F.floor(m["size"] * 0.55)))))

    return let(char_count(c, r"[\d%$€£¥₩/,:;()\-+]"), lambda n: F.when(n < 14, False).otherwise(full(n)))


def sparse_list(c: Column) -> Column:
    all_lines = lines(c)
    n = F.size(all_lines)
    short = count_if(all_lines, lambda x: F.length(x) <= 24)
    bullets = count_if(all_lines, lambda x: x.rlike(r"^[\-•\d]+[.)]?\s*"))
    return (n >= 3) & ((short >= F.greatest(F.lit(3), n - 1)) | (bullets >= F.greatest(F.lit(2), F.floor(n / 2))))


def coverage_text(c: Column) -> Column:
    return F.lower(normalize_text(c))


def boilerplate(c: Column) -> Column:
    """``c`` is a ``coverage_text``."""
    return contains_any(c, BOILERPLATE)


def contact_noise(c: Column) -> Column:
    """``c`` is a ``coverage_text``."""
    return contains_any(c, CONTACT) | c.rlike(PHONE_DIGITS)


def meaningful_visual(c: Column) -> Column:
    return (F.length(c) >= 120) & ~title_only(c) & ~numeric_heavy(c) & ~boilerplate(coverage_text(c)) & (explanatory(c) | (metric_signal(c) & (sentence_parts(c) >= 2)))


def measured(c: Column) -> Column:
    """What the predicates above say about a text, in one struct that is worked out once per text.

    n, sentences; metric, explains, numeric, dense, title, sparse, boilerplate, contact, meaningful (as ``meaningful_visual``).
    """
    first = F.struct(c.alias("t"), lines(c).alias("ls"), sentence_parts(c).alias("s"), coverage_text(c).alias("low"), F.length(c).alias("n"))
    return let(first, lambda a: let(_signals(a), _measures))


def _signals(a: Column) -> Column:
    t, low, n, n_lines = a["t"], a["low"], a["n"], F.size(a["ls"])
    n_words = F.size(words(t))  # counted in short texts only
    metric = contains_any(low, METRIC_WORDS) | low.rlike(METRIC_AMOUNT)  # the text is lower-case already
    long, short = count_if(a["ls"], lambda x: F.length(x) >= 50), count_if(a["ls"], lambda x: F.length(x) <= 24)
    bullets = count_if(a["ls"], lambda x: x.rlike(r"^[\-•\d]+[.)]?\s*"))
    small = (F.length(strip(t)) <= 110) & (n_lines <= 3) & (a["s"] <= 1) & (n_words <= 14)
    return F.struct(
        n.alias("n"), a["s"].alias("sentences"), metric.alias("metric"), ((n >= 140) & ((n >= 280) | (a["s"] >= 2) | (n_words >= 18))).alias("explains"), numeric_heavy(t).alias("numeric"),
        ((n_lines > 0) & ((long >= 2) | ((n >= 260) & (n_lines <= F.greatest(F.lit(4), F.floor(n / 120)))))).alias("dense"), ((n_lines == 0) | small).alias("short"),
        ((n_lines >= 3) & ((short >= F.greatest(F.lit(3), n_lines - 1)) | (bullets >= F.greatest(F.lit(2), F.floor(n_lines / 2))))).alias("sparse"), boilerplate(low).alias("boilerplate"), contact_noise(low).alias("contact"), (n_lines == 0).alias("blank"),
    )


def _measures(b: Column) -> Column:
    title = b["blank"] | (b["short"] & ~b["metric"])
    meaningful = (b["n"] >= 120) & ~title & ~b["numeric"] & ~b["boilerplate"] & (b["explains"] | (b["metric"] & (b["sentences"] >= 2)))
    return F.struct(*(b[k].alias(k) for k in ("n", "sentences", "metric", "explains", "numeric", "dense", "sparse", "boilerplate", "contact")), title.alias("title"), meaningful.alias("meaningful"))


def first_answer_sentence(c: Column) -> Column:
    clean = normalize_text(F.regexp_replace(F.coalesce(c, F.lit("")), r"[#>*`_]", " "))
    return F.coalesce(F.get(F.filter(F.split(clean, r"(?<=[.!?])\s+|\n+"), lambda x: strip(x) != ""), F.lit(0)), F.lit(""))


def no_support(c: Column) -> Column:
    """Whether an answer's first sentence says that nothing was found."""
    first = first_answer_sentence(c)
    return (first == "") | first.rlike("|".join(NO_SUPPORT))


def date_like(c: Column) -> Column:
    return c.rlike(DATE_LIKE[0]) | c.rlike(DATE_LIKE[1]) | c.rlike(DATE_LIKE[2])


def expected_page(query: Column) -> Column:
    """The page a question names; null without one."""
    found = [F.nullif(F.regexp_extract(query, p, 1), F.lit("")) for p in (r"(?i)\bpage\s*(\d{1,4})\b", r"(?i)\bp\.\s*(\d{1,4})\b", r"(\d{1,4})\s*페이지")]
    return F.coalesce(*found).cast("int")


def keyword_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits (with inner ``.,%/-``): the keyword index's own tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}](?:[\p{L}\p{N}.,%/-]*[\p{L}\p{N}%])?"), 0)


def token_class(token: Column) -> Column:
    """number, mixed or word."""
    digit, letter = token.rlike(r"\d"), token.rlike(r"\p{L}")
    return F.when(digit & letter, "mixed").when(digit, "number").otherwise("word")


def signature(c: Column) -> Column:
    """A header's or footer's text without digits and punctuation, lower-cased, 80 characters at most."""
    c = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"\d+", " ")
    return F.substring(F.regexp_replace(c, r"(?U)[\W_]+", ""), 1, 80)


def normalized_key(c: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def without_controls(c: Column) -> Column:
    """Without control characters other than tab and line end."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def char_ratio(c: Column, pattern: str) -> Column:
    """Share of the non-blank characters that match ``pattern``."""
    compact = squeezed(F.coalesce(c, F.lit("")))
    return F.when(F.length(compact) == 0, 0.0).otherwise(F.regexp_count(compact, F.lit(pattern)) / F.length(compact))


def alpha_ratio(c: Column) -> Column:
    return char_ratio(c, r"\p{L}")


def digit_ratio(c: Column) -> Column:
    return char_ratio(c, r"\d")


def symbol_ratio(c: Column) -> Column:
    return char_ratio(c, r"[^\p{L}\p{N}]")


def escaped_html(c: Column) -> Column:
    """Text as HTML, line ends as breaks."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def charset_similarity(a: Column, b: Column) -> Column:
    """Shared distinct characters over the larger set."""
    left, right = (F.array_distinct(F.split(F.lower(x), "")) for x in (a, b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.size(F.array_intersect(left, right)) / F.greatest(F.size(left), F.size(right)))


def trend(metrics: Column, periods: Column, text: Column) -> Column:
    """Up, down or flat over the largest group of values with one unit; null where no trend may be inferred."""
    def direction(parsed: Column) -> Column:
        units = F.transform(parsed, lambda x: x["unit"])
        sizes = F.transform(F.array_distinct(units), lambda u: F.size(F.filter(units, lambda x: x == u)))
        unit = let(sizes, lambda n: F.get(F.array_distinct(units), (F.array_position(n, F.array_max(n)) - 1).cast("int")))

        def over(group: Column) -> Column:
            first, last = F.get(group, F.lit(0)), F.element_at(group, -1)
            allowed = (F.size(group) >= 2) & ((F.size(periods) > 0) | (text.rlike(SERIES_HINT) & first["unit"].isin("%", "%p", "bp", "bps")))
            return F.when(allowed, F.when(last["value"] > first["value"], "increased").when(last["value"] < first["value"], "decreased").otherwise("was flat"))

        return let(unit, lambda u: let(F.filter(parsed, lambda x: x["unit"] == u), over))

    return let(F.filter(F.transform(metrics, metric_value), lambda x: x.isNotNull()), lambda parsed: F.when(F.size(parsed) > 0, direction(parsed)))


def points(*terms: tuple[Column, float | int]) -> Column:
    """The sum of the weights whose condition holds."""
    total = F.lit(0)
    for condition, weight in terms:
        total = total + F.when(condition, weight).otherwise(0)
    return total


def step(value: Column, *levels: tuple[float, float], otherwise: float = 0) -> Column:
    """The weight of the first bound (falling) that ``value`` reaches."""
    (bound, weight), *rest = levels
    out = F.when(value >= bound, weight)
    for bound, weight in rest:
        out = out.when(value >= bound, weight)
    return out.otherwise(otherwise)
