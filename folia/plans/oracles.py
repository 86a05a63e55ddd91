"""DuckDB SQL of queries whose oracle builds on others': split texts, measured chunks, page features, table cells."""

from __future__ import annotations

from folia.functions import text as T
from folia.operators import retrieval, routing
from folia.operators import splitting as P


def clean(c: str) -> str:
    """``T.clean_text``. RE2 has no \\h, so classes are spelled out."""
    lines = f"regexp_replace(replace(replace(coalesce({c}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({lines}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def normal(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def found(c: str, pattern: str) -> str:
    """How often ``pattern`` occurs."""
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def any_of(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def sentence_parts(c: str) -> str:
    marked = rf"regexp_replace(regexp_replace({c}, '([다요음임])\s+', '\1' || chr(1), 'g'), '[.!?]\s+|\n+', chr(1), 'g')"
    return f"len(list_filter(string_split({marked}, chr(1)), lambda x: {strip('x')} <> ''))"


def lines(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"


def words(c: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({strip(c)}, '\s+'), lambda x: x <> ''))"


def split(rows: str, hard: int = P.HARD) -> str:
    """CTEs ending in ``parts`` (all columns of ``rows`` but t, pos, text): the texts ``t`` of ``rows`` (with a unique ``id``), split."""
    back = "strpos(reverse(h), chr(10))", "strpos(reverse(h), ' .')"
    cut = f"greatest(CASE WHEN {back[0]} > 0 THEN length(h) - {back[0]} + 1 ELSE 0 END, CASE WHEN {back[1]} > 0 THEN length(h) - {back[1]} ELSE 0 END)"
    return f"""cuts AS (SELECT id, t, 0 AS pos, 0 AS a, 0 AS b FROM {rows} WHERE length(t) > {hard} UNION ALL
      SELECT id, t, pos + 1, f, CASE WHEN length(t) - f <= {hard} THEN length(t) WHEN cut > {int(P.EARLIEST * P.TARGET) + 1} THEN f + cut ELSE f + {hard} END FROM (
        SELECT *, {cut} AS cut FROM (SELECT *, substr(t, f + 1, {P.TARGET}) AS h FROM (
          SELECT *, CASE WHEN pos = 0 THEN 0 ELSE greatest(b - {P.OVERLAP}, a + 1) END AS f FROM cuts WHERE pos = 0 OR b < length(t))))),
    pieces AS (SELECT id, pos, {strip('substr(t, a + 1, b - a)')} AS text FROM cuts WHERE pos > 0 UNION ALL SELECT id, 1, t FROM {rows} WHERE length(t) BETWEEN 1 AND {hard}),
    parts AS (SELECT r.* EXCLUDE (t), CAST(row_number() OVER (PARTITION BY id ORDER BY p.pos) - 1 AS INTEGER) AS pos, p.text FROM pieces p JOIN {rows} r USING (id) WHERE p.text <> '')"""


CHUNKS = f"""cleaned AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS id, source, {clean('text')} AS t FROM documents), {split('cleaned')},
    chunks AS (SELECT doc_id, source, CAST(pos // 2 + 1 AS INTEGER) AS page_num, pos + 1 AS chunk_index, text AS t FROM parts)"""

_SIGNS = r"[%$€£¥₩/,:;()+-]"
_NUMERIC = rf"""length(q) >= 40 AND ({found('q', '[0-9]')} >= greatest(14, {found('q', '[A-Za-z가-힣]')}) OR {found('q', '[0-9]')} + {found('q', _SIGNS)} > greatest(24, floor(length(q) * 0.55)))"""
_METRIC = T.METRIC_SIGNAL
_SHORT = "length({t}) <= 110 AND len(ls) <= 3 AND w <= 14 AND s <= 1"


def measured(rows: str) -> str:
    """CTEs ending in ``measured``: ``rows`` with what ``T.measured`` says about their text ``t``."""
    small = _SHORT.format(t=strip("t"))
    return rf"""m1 AS (SELECT *, length(t) AS n, {lines('t')} AS ls, {words('t')} AS w, {sentence_parts('t')} AS s, lower({normal('t')}) AS low, regexp_replace(t, '\s+', '', 'g') AS q FROM {rows}),
    m2 AS (SELECT *, regexp_matches(low, '{_METRIC}') AS metric, n >= 140 AND (s >= 2 OR w >= 18 OR n >= 280) AS explains, ({_NUMERIC}) AS numeric_,
      len(ls) > 0 AND (len(list_filter(ls, lambda x: length(x) >= 50)) >= 2 OR (n >= 260 AND len(ls) <= greatest(4, n // 120))) AS dense,
      len(ls) >= 3 AND (len(list_filter(ls, lambda x: length(x) <= 24)) >= greatest(3, len(ls) - 1) OR len(list_filter(ls, lambda x: regexp_matches(x, '^[•0-9-]+[.)]?\s*'))) >= greatest(2, len(ls) // 2)) AS sparse,
      {any_of('low', T.BOILERPLATE)} AS boilerplate, ({any_of('low', T.CONTACT)} OR regexp_matches(low, '{T.PHONE_DIGITS}')) AS contact FROM m1),
    m3 AS (SELECT *, len(ls) = 0 OR ({small} AND NOT metric) AS title FROM m2),
    measured AS (SELECT *, n >= 120 AND NOT title AND NOT numeric_ AND NOT boilerplate AND (explains OR (metric AND s >= 2)) AS meaningful FROM m3)"""


_COVERAGE = """0.18 + 0.28 + 0.0 + CASE WHEN n >= 360 THEN 0.18 WHEN n >= 220 THEN 0.13 WHEN n >= 140 THEN 0.08 WHEN n >= 90 THEN 0.03 WHEN n < 60 THEN -0.28 ELSE -0.12 END
    + CASE WHEN s >= 3 THEN 0.08 WHEN s >= 2 THEN 0.04 ELSE 0 END + CASE WHEN explains THEN 0.18 ELSE 0 END + CASE WHEN metric THEN 0.08 ELSE 0 END + CASE WHEN metric AND explains THEN 0.16 ELSE 0 END + CASE WHEN dense THEN 0.08 ELSE 0 END
    - CASE WHEN title THEN 0.24 ELSE 0 END - CASE WHEN numeric_ THEN 0.22 ELSE 0 END - CASE WHEN boilerplate THEN 0.34 ELSE 0 END - CASE WHEN contact THEN 0.26 ELSE 0 END - CASE WHEN sparse THEN 0.12 ELSE 0 END"""
COVERED = f"{CHUNKS}, {measured('chunks')}, covered AS (SELECT *, round(CAST({_COVERAGE} AS DOUBLE), 6) AS coverage FROM measured)"

_SUMMARY = rf"""g AS (SELECT doc_id, source, page_num, chunk_index, {normal('t')} AS one, lower({normal('t')}) AS low, lower(source) AS heads FROM chunks),
    k AS (SELECT *, length(one) AS n, {words('one')} AS w, {found('one', '[0-9]+(?:[.,][0-9]+)?%?')} AS numbers, {found('one', '[A-Za-zㄱ-힣]{2,}')} AS letters, {found('one', '[A-Za-z0-9ㄱ-힣]+')} AS runs FROM g),
    p AS (SELECT *, ({any_of('low', T.TOC_TERMS)} OR {any_of('heads', T.TOC_TERMS)}) AS toc, ({any_of('low', T.APPENDIX_TERMS)} OR {any_of('heads', T.APPENDIX_TERMS)}) AS apx,
      n <= 90 AND CASE WHEN trim(heads) = '' THEN w <= 8 ELSE low = trim(heads) OR w <= 8 END AS title, n = 0 OR (n < 120 AND numbers >= greatest(2, letters * 2)) AS cap FROM k),
    sc AS (SELECT *, CAST(1.0 / (60 + chunk_index) AS DOUBLE) + CASE WHEN n >= 350 THEN 0.12 WHEN n >= 120 THEN 0.08 WHEN n >= 60 THEN 0.02 ELSE -0.08 END + CASE WHEN n >= 120 AND runs >= 12 THEN 0.08 ELSE 0 END
      - CASE WHEN toc THEN 0.28 ELSE 0 END - CASE WHEN apx THEN 0.22 ELSE 0 END - CASE WHEN title THEN 0.2 ELSE 0 END - CASE WHEN cap THEN 0.16 ELSE 0 END AS score FROM p)"""


def features(blocks: str) -> str:
    """CTEs ending in ``scored``: the page features and type scores, from ``blocks`` and ``pages_`` of ``blocks``' CTEs."""
    unit = lambda c: f"greatest(0.0, least(1.0, {c}))"
    return rf"""{blocks}, fl AS (SELECT doc_id, page_num, {lines('text')} AS ls FROM pages_),
    fs AS (SELECT doc_id, page_num, 'top' AS place, array_to_string(ls[1:2], ' ') AS raw FROM fl UNION ALL SELECT doc_id, page_num, 'bottom', array_to_string(ls[greatest(1, len(ls) - 1):], ' ') FROM fl),
    fk AS (SELECT doc_id, page_num, place, substr(regexp_replace(regexp_replace(lower(raw), '\d+', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g'), 1, 80) AS sig FROM fs),
    rep AS (SELECT DISTINCT doc_id, page_num FROM fk WHERE length(sig) >= 8 AND (doc_id, place, sig) IN (SELECT (doc_id, place, sig) FROM fk WHERE length(sig) >= 8 GROUP BY doc_id, place, sig HAVING count(*) >= 2)),
    own AS (SELECT doc_id, page_num, count(*) AS blocks_, count(*) FILTER (type = 'table') AS tables_, sum(CASE WHEN type = 'title' THEN length(trim(text)) ELSE 0 END) AS title_chars,
      count(*) FILTER (type <> 'table' AND length(trim(text)) < 15) AS tiny, count(DISTINCT x0) FILTER (type <> 'table') AS edges FROM blocks GROUP BY ALL),
    ft AS (SELECT p.doc_id, p.page_num, CAST(length(c) AS DOUBLE) AS text_density, CAST({found('c', '[0-9%]')} AS DOUBLE) / greatest(1, length(c)) AS numeric_density, CAST(tables_ AS DOUBLE) AS table_count, CAST(greatest(1, least(3, edges)) AS DOUBLE) AS column_count,
      CAST(title_chars AS DOUBLE) / greatest(1, length(c)) AS title_ratio, CASE WHEN r.doc_id IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS repeated, CAST(blocks_ AS DOUBLE) AS block_count, CAST(tiny AS DOUBLE) / greatest(1, blocks_) AS fragment_ratio
      FROM (SELECT *, regexp_replace(text, '\s+', '', 'g') AS c FROM pages_) p JOIN own USING (doc_id, page_num) LEFT JOIN rep r ON r.doc_id = p.doc_id AND r.page_num = p.page_num),
    un AS (SELECT *, {unit('text_density / 1800.0')} AS tx, {unit('numeric_density / 0.18')} AS nu, {unit('table_count / 3.0')} AS tb, {unit('(column_count - 1.0) / 2.0')} AS co, {unit('title_ratio / 0.18')} AS ti, {unit('block_count / 18.0')} AS bl,
      1.0 - {unit('abs(column_count - 1.5) / 1.5')} AS fit FROM ft),
    ts AS (SELECT *, round(0.15 * ti + 0.10 * (1.0 - tx) + 0.10 * (1.0 - co) + 0.10 * fragment_ratio + 0.08 * (1.0 - repeated) - 0.15 * tx, 9) AS slide_ir, round(0.35 * tx + 0.12 * (1.0 - tb) + 0.12 * repeated + 0.10 * fit + 0.08 + 0.08 * (1.0 - nu), 9) AS text_report,
      round(0.24 * nu + 0.18 * bl + 0.14 * co + 0.10 * (1.0 - repeated), 9) AS dashboard_brief, round(0.36 * tb + 0.22 * nu + 0.14 * repeated + 0.08 + 0.08 * (1.0 - ti), 9) AS table_heavy FROM un),
    so AS (SELECT *, list_reverse_sort([slide_ir, text_report, dashboard_brief, table_heavy]) AS v FROM ts),
    scored AS (SELECT *, CASE WHEN v[1] - v[2] < 0.08 AND CAST(tx >= 0.45 AS INTEGER) + CAST(nu >= 0.45 AS INTEGER) + CAST(tb >= 0.45 AS INTEGER) >= 2 THEN 'mixed_document' WHEN slide_ir = v[1] THEN 'slide_ir' WHEN text_report = v[1] THEN 'text_report' WHEN dashboard_brief = v[1] THEN 'dashboard_brief' ELSE 'table_heavy' END AS page_type FROM so)"""


def _routes(blocks: str, sample: int = 0) -> str:
    """The documents' routes; from the first ``sample`` pages and without mixed types, if that is given."""
    types = routing.DOC_TYPES
    rows = features(blocks)
    if sample:
        body = rows[len(blocks) :].replace("FROM blocks", "FROM early").replace("FROM pages_", "FROM early_pages")
        rows = f"{blocks}, early AS (SELECT * FROM blocks WHERE page_num <= {sample}), early_pages AS (SELECT * FROM pages_ WHERE page_num <= {sample}){body}"
    means = ", ".join(f"avg({k}) AS mean_{k}, avg(CASE WHEN page_type = '{k}' THEN 1.0 ELSE 0.0 END) AS share_{k}" for k in types)
    score = ", ".join(f"round(mean_{k} + 0.15 * share_{k}, 9) AS score_{k}" for k in types)
    values = ", ".join(f"score_{k}" for k in types)
    best = " ".join(f"WHEN score_{k} = v[1] THEN '{k}'" for k in types)
    share = " ".join(f"WHEN '{k}' THEN share_{k}" for k in types)
    wide = " + ".join(f"CAST(share_{k} >= 0.2 AS INTEGER)" for k in types)
    rounded = ", ".join(f"round(score_{k}, 6) AS score_{k}" for k in types)
    chosen = "share_mixed >= 0.25 OR (gap < 0.08 AND wide >= 2) OR (share < 0.5 AND wide >= 3)" if not sample else "FALSE"
    sql = f"""WITH {rows}, d1 AS (SELECT doc_id, count(*) AS pages, {means}, avg(CASE WHEN page_type = 'mixed_document' THEN 1.0 ELSE 0.0 END) AS share_mixed, avg(table_count) AS table_count, avg(column_count) AS column_count, avg(repeated) AS repeated FROM scored GROUP BY 1),
    d2 AS (SELECT *, {score} FROM d1), d3 AS (SELECT *, list_reverse_sort([{values}]) AS v, {wide} AS wide FROM d2), d4 AS (SELECT *, CASE {best} END AS top, v[1] - v[2] AS gap FROM d3), d5 AS (SELECT *, CASE top {share} END AS share FROM d4),
    d6 AS (SELECT *, {chosen} AS mixed FROM d5), d7 AS (SELECT *, CASE WHEN mixed THEN 'mixed_document' ELSE top END AS kind FROM d6)
    SELECT doc_id, pages, kind AS document_type, round(greatest(0.0, least(1.0, CASE WHEN mixed THEN 0.52 + share_mixed * 0.25 + wide * 0.05 ELSE 0.40 + v[1] * 0.35 + share * 0.20 + gap * 1.20 END)), 3) AS confidence, {rounded},
      array_to_string(list_filter([CASE kind WHEN 'slide_ir' THEN 'visual pages with little narrative' WHEN 'text_report' THEN 'dense text with few tables and visuals' WHEN 'dashboard_brief' THEN 'numbers, visuals and many blocks together' WHEN 'table_heavy' THEN 'tables and numbers outweigh narrative' ELSE 'no layout dominates' END,
      CASE WHEN kind = 'text_report' AND repeated >= 0.35 THEN 'repeated headers or footers' END, CASE WHEN kind = 'dashboard_brief' AND column_count >= 1.8 THEN 'several columns' END, CASE WHEN kind = 'table_heavy' AND table_count >= 1.2 THEN 'tables on most pages' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM d7"""
    return sql if not sample else f"SELECT doc_id, document_type, confidence FROM ({sql})"


#: The order tables as cells (table_id, r, c, v; row 0 is the header), and their measures.
_CELLS = """l AS (SELECT l_orderkey AS table_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_quantity AS VARCHAR), l_returnflag, l_linestatus) AS INTEGER) AS r, [CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_quantity AS VARCHAR), l_returnflag, l_linestatus] AS row_ FROM lineitem),
    heads AS (SELECT ['linenumber', 'partkey', 'quantity', 'returnflag', 'linestatus'] AS row_), all_ AS (SELECT table_id, r, row_ FROM l UNION ALL SELECT DISTINCT table_id, 0, heads.row_ FROM l, heads),
    cells AS (SELECT table_id, r, unnest(row_) AS v, generate_subscripts(row_, 1) - 1 AS c FROM all_)"""
_QUALITY = rf"""{_CELLS}, x AS (SELECT *, regexp_matches(v, '[0-9]') AS digit FROM cells),
    byrow AS (SELECT table_id, r, count(*) FILTER (v <> '') AS filled FROM x GROUP BY ALL), modes AS (SELECT table_id, mode(filled) AS m FROM byrow GROUP BY 1),
    stab AS (SELECT table_id, count(*) FILTER (abs(filled - m) <= 1) / count(*) AS stable FROM byrow JOIN modes USING (table_id) GROUP BY 1),
    bycol AS (SELECT table_id, c, count(*) FILTER (digit AND r BETWEEN 1 AND 5) / count(*) FILTER (r BETWEEN 1 AND 5) AS early, count(*) FILTER (digit AND r > 0) / count(*) FILTER (r > 0) AS share FROM x GROUP BY ALL),
    nums AS (SELECT table_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS numeric_cols, avg(share) AS numeric_ FROM bycol WHERE early >= 0.6 GROUP BY 1),
    q1 AS (SELECT table_id, CAST(max(r) + 1 AS INTEGER) AS n_rows, CAST(max(c) + 1 AS INTEGER) AS n_cols, count(*) FILTER (v = '') / count(*) AS empty_, 1.0 - count(DISTINCT v) / count(*) AS repeats, count(*) FILTER (digit AND r > 0 AND c = 0) AS lead_,
      0.45 * (count(*) FILTER (r = 0 AND regexp_matches(v, '[A-Za-z]')) / count(*) FILTER (r = 0)) + 0.30 * (count(*) FILTER (r = 0 AND length(v) <= 25) / count(*) FILTER (r = 0)) + 0.25 * greatest(0.0, (count(*) FILTER (digit AND r > 0) / count(*) FILTER (r > 0)) - (count(*) FILTER (digit AND r = 0) / count(*) FILTER (r = 0)) + 0.2) AS likely FROM x GROUP BY 1),
    q AS (SELECT *, (1.0 - empty_) * 2.0 + 1.0 + likely * 1.2 + numeric_ * 1.4 + 1.0 * 2.0 - repeats + stable * 1.4 + 0.5 * 0.4 AS overall FROM q1 JOIN stab USING (table_id) JOIN nums USING (table_id))"""

_TOKENS = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}.,%/-]*[\p{{L}}\p{{N}}%])?')"


def tokens(c: str) -> str:
    return _TOKENS.format(c=c)


_DATES = [p.replace("(?i)", "") for p in T.DATE_LIKE]


def oracles(blocks: str, pages: str, bm25: str, vectors: str, rrf: str) -> dict[str, str]:
    """The SQL by query name, over the catalogue's CTEs of blocks, pages and ranked lists."""
    hits = lambda items, tok: f"len(list_filter({items}, lambda z: list_contains({tok}, z)))"
    dated = " OR ".join(f"regexp_matches(z, '{p}')" for p in _DATES)
    block_id = "substr(md5(type || '::' || concat_ws(',', CAST(x0 AS VARCHAR), CAST(y0 AS VARCHAR), CAST(x1 AS VARCHAR), CAST(y1 AS VARCHAR), CAST(page_num AS VARCHAR), CAST(seq AS VARCHAR)) || '::' || text), 1, 12)"
    name = lambda strategy: f"doc_id || ':{strategy}:p' || page_num || ':' || lpad(CAST(chunk_index AS VARCHAR), CAST(greatest(4, length(CAST(chunk_index AS VARCHAR))) AS INTEGER), '0') || ':' || chunk_type || ':' || substr(md5(sources), 1, 8)"
    text_first = f"""WITH RECURSIVE {pages}, o AS (SELECT *, {clean('text')} AS c, {block_id} AS bid, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y0, x0, seq) AS i FROM blocks WHERE type <> 'table'),
            f AS (SELECT doc_id, page_num, i, length(c) AS len_, 1 AS flow FROM o WHERE i = 1 UNION ALL SELECT o.doc_id, o.page_num, o.i, CASE WHEN f.len_ + length(o.c) > 950 OR f.len_ = 0 THEN length(o.c) WHEN o.c = '' THEN f.len_ ELSE f.len_ + 2 + length(o.c) END, f.flow + CAST(f.len_ + length(o.c) > 950 AS INTEGER)
              FROM f JOIN o ON o.doc_id = f.doc_id AND o.page_num = f.page_num AND o.i = f.i + 1),
            g AS (SELECT doc_id, page_num, flow, min(i) AS place, count(*) AS n, string_agg(c, chr(10) || chr(10) ORDER BY i) FILTER (c <> '') AS t, string_agg(bid, ',' ORDER BY i) AS sources FROM f JOIN o USING (doc_id, page_num, i) GROUP BY ALL),
            kept AS (SELECT doc_id, page_num, 0 AS kind, place, n, CASE WHEN n > 1 THEN 'block_group' ELSE 'text' END AS chunk_type, t, sources FROM g WHERE coalesce(t, '') <> '' AND NOT (length(t) < 24 AND n = 1)),
            rest AS (SELECT doc_id, page_num, 1 AS kind, 0 AS place, (SELECT count(*) FROM blocks b WHERE b.doc_id = p.doc_id AND b.page_num = p.page_num) AS n, 'page' AS chunk_type, {clean('text')} AS t,
              (SELECT string_agg({block_id}, ',' ORDER BY y0, x0, seq) FROM blocks b WHERE b.doc_id = p.doc_id AND b.page_num = p.page_num) AS sources FROM pages_ p WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = p.doc_id AND k.page_num = p.page_num)),
            ided AS (SELECT *, doc_id || '|' || page_num || '|' || place AS id FROM (SELECT * FROM kept UNION ALL SELECT * FROM rest) WHERE t <> ''), {split('ided')},
            nr AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_num, kind, place, pos) AS INTEGER) AS chunk_index FROM parts)
            SELECT {name('text_first_with_visual_support')} AS chunk_id, doc_id, page_num, chunk_index, chunk_type, CAST(length(text) AS INTEGER) AS char_len, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_estimate, CAST(n AS INTEGER) AS sources FROM nr"""
    native = f"""WITH RECURSIVE {pages}, rows_ AS (SELECT doc_id, page_num, -1 AS seq, 'native_page' AS chunk_type, {clean('text')} AS t, '' AS sources FROM pages_ UNION ALL SELECT doc_id, page_num, seq, type, {clean('text')}, CAST(seq AS VARCHAR) FROM blocks),
            ided AS (SELECT *, doc_id || '|' || page_num || '|' || seq AS id FROM rows_ WHERE t <> ''), {split('ided', 1350)},
            nr AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_num, seq, pos) AS INTEGER) AS chunk_index FROM parts)
            SELECT {name('llm_ready_native')} AS chunk_id, doc_id, page_num, chunk_index, chunk_type, CAST(length(text) AS INTEGER) AS char_len FROM nr"""
    return {
        "text_predicates": rf"""WITH d AS (SELECT doc_id, text AS t, {clean('text')} AS cl FROM documents), {measured('d')},
            e AS (SELECT *, {found('cl', T.SENTENCE_END)} AS ends, {found('cl', T.PHONE)} + {found('cl', T.EMAIL)} + {found('cl', T.URL)} AS signs FROM measured),
            f AS (SELECT *, CASE WHEN cl = '' THEN 0 WHEN ends > 0 THEN ends ELSE len(list_filter({lines('cl')}, lambda x: length(x) >= 45)) END AS se FROM e)
            SELECT doc_id, title AS title_only, numeric_ AS numeric_heavy, sparse AS sparse_list, dense AS dense_body, explains AS explanatory, meaningful AS meaningful_visual,
              length(cl) <= 220 AND signs >= 1 AND len(list_filter(string_split(cl, chr(10)), lambda x: contains(x, ':') OR contains(x, '|'))) >= 1 AND se = 0 AND {found('cl', T.METRIC.replace(chr(39), chr(39) * 2))} <= 2 AS contactish, s AS sentences, CAST(se AS BIGINT) AS sentence_ends FROM f""",
        "split_parts": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_index, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM chunks",
        "anchor_groups": f"""WITH RECURSIVE {blocks}, o AS (SELECT doc_id, page_num, length(text) AS own, length({clean('text')}) AS n, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y0, x0, seq) AS i FROM blocks WHERE type <> 'table'),
            f AS (SELECT doc_id, page_num, i, own, n AS len_, 1 AS flow FROM o WHERE i = 1 UNION ALL SELECT o.doc_id, o.page_num, o.i, o.own, CASE WHEN f.len_ + o.n > 950 OR f.len_ = 0 THEN o.n WHEN o.n = 0 THEN f.len_ ELSE f.len_ + 2 + o.n END, f.flow + CAST(f.len_ + o.n > 950 AS INTEGER)
              FROM f JOIN o ON o.doc_id = f.doc_id AND o.page_num = f.page_num AND o.i = f.i + 1)
            SELECT doc_id, page_num, 'text_flow:' || flow AS group_key, count(*) AS blocks, CAST(sum(own) AS BIGINT) AS chars FROM f GROUP BY ALL""",
        "sparse_pages": f"WITH {pages} SELECT doc_id, page_num, length({clean('text')}) < 80 AS sparse FROM pages_",
        "native_chunks": native,
        "text_first_chunks": text_first,
        "chunk_payloads": f"""WITH c AS (SELECT doc_id, 'text_first_with_visual_support' AS strategy_name, count(*) AS n FROM ({text_first}) GROUP BY 1 UNION ALL SELECT doc_id, 'llm_ready_native', count(*) FROM ({native}) GROUP BY 1),
            h AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, s.strategy_name, source AS filename, lang AS document_type FROM documents, (VALUES ('text_first_with_visual_support'), ('llm_ready_native')) s(strategy_name)),
            x AS (WITH {pages} SELECT s.doc_id, string_agg('stub:' || (s.page_num + 1), ',' ORDER BY 'stub:' || (s.page_num + 1)) AS issues FROM pages_ s WHERE s.page_num % 3 <> 2 AND NOT EXISTS (SELECT 1 FROM pages_ q WHERE q.doc_id = s.doc_id AND q.page_num = s.page_num + 1) GROUP BY 1)
            SELECT h.doc_id, h.strategy_name, filename, document_type, coalesce(n, 0) AS total_chunks, 1 AS schema_version, CASE WHEN h.strategy_name = 'llm_ready_native' THEN coalesce(issues, '') ELSE '' END AS issues FROM h LEFT JOIN c ON c.doc_id = h.doc_id AND c.strategy_name = h.strategy_name LEFT JOIN x ON x.doc_id = h.doc_id""",
        "markdown_blocks": rf"""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split({clean('text')}, chr(10) || chr(10))) AS raw, generate_subscripts(string_split({clean('text')}, chr(10) || chr(10)), 1) - 1 AS seq FROM documents)
            SELECT doc_id, CAST(seq AS INTEGER) AS seq, CASE WHEN regexp_matches(raw, '^#{{1,6}}\s') THEN 'title' ELSE 'text' END AS type, CAST(length({strip("regexp_replace(raw, '^#{1,6}" + chr(92) + "s+', '')")}) AS INTEGER) AS chars FROM p WHERE {strip('raw')} <> ''""",
        "table_rows": f"""WITH {_CELLS}, k AS (SELECT *, count(*) OVER (PARTITION BY table_id, c) AS n_rows FROM cells)
            SELECT table_id, r - 1 AS row_index, max(v) FILTER (c = 0) AS row_label, string_agg((['linenumber', 'partkey', 'quantity', 'returnflag', 'linestatus'])[c + 1] || '=' || v, '; ' ORDER BY c) FILTER (c > 0) AS value FROM k WHERE n_rows >= 3 AND r BETWEEN 1 AND 24 GROUP BY ALL""",
        "table_quality": f"""WITH {_QUALITY} SELECT table_id, n_rows, n_cols, numeric_cols, round(overall, 6) AS overall, round(CAST(stable AS DOUBLE), 6) AS row_stability, round(likely, 6) AS header_likelihood, round(CAST(empty_ AS DOUBLE), 6) AS empty_cell_ratio, round(CAST(numeric_ AS DOUBLE), 6) AS numeric_alignment,
            CASE WHEN lead_ = n_rows - 1 AND n_cols <= 5 AND n_rows - 1 < 3 THEN 'no_row_labels' ELSE 'summary_ready' END AS ready FROM q""",
        "best_table": f"""WITH {_QUALITY}, o AS (SELECT o_custkey, q.* FROM q JOIN orders ON o_orderkey = table_id)
            SELECT o_custkey, table_id, round(overall, 6) AS overall FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY round(overall, 9) DESC, round(likely, 9) DESC, round(stable, 9) DESC, n_rows * n_cols DESC, table_id) = 1""",
        "page_scores": f"WITH {features(pages)} SELECT doc_id, page_num, page_type, " + ", ".join(f"round({k}, 6) AS {k}" for k in routing.DOC_TYPES) + " FROM scored",
        "document_routes": _routes(pages),
        "first_routes": _routes(pages, 5),
        "qa_rerank": f"""WITH {bm25}, {vectors}, {rrf}, c AS (SELECT ra.query_id, ra.doc, ra.s, ra.hybrid_rank, len(list_intersect(list_distinct({tokens('b.text')}), list_distinct({tokens('d.text')}))) AS shared, {any_of(f"lower({normal('d.text')})", T.BOILERPLATE)} AS is_boilerplate FROM ra JOIN documents d ON d.doc_id = ra.doc JOIN benchmark b ON b.item_id = ra.query_id),
            k AS (SELECT *, 30 * s + least(0.5, 0.1 * shared) - CASE WHEN is_boilerplate THEN 0.4 ELSE 0 END AS score FROM c)
            SELECT query_id, doc, round(score, 6) AS score, is_boilerplate, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, hybrid_rank) AS INTEGER) AS qa_rank FROM k QUALIFY qa_rank <= {retrieval.FINAL_K}""",
        "coverage_score": f"WITH RECURSIVE {COVERED} SELECT doc_id, page_num, chunk_index, coverage FROM covered",
        "best_chunk_per_page": f"WITH RECURSIVE {COVERED} SELECT doc_id, page_num, chunk_index, coverage FROM covered QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY coverage DESC, chunk_index) = 1",
        "page_priority": f"""WITH RECURSIVE {COVERED}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY coverage DESC, chunk_index) AS k FROM covered QUALIFY k <= 3)
            SELECT doc_id, page_num, round(sum(coverage * CASE k WHEN 1 THEN 0.72 WHEN 2 THEN 0.2 ELSE 0.08 END) + least(0.12, count(*) FILTER (coverage >= 0.45 AND explains) * 0.05) + least(0.1, count(*) FILTER (coverage >= 0.65) * 0.04), 6) AS priority FROM t GROUP BY ALL""",
        "summary_scores": f"""WITH RECURSIVE {CHUNKS}, {_SUMMARY} SELECT doc_id, chunk_index, round(score, 6) AS score, concat_ws(',', CASE WHEN toc THEN 'toc_like' END, CASE WHEN apx THEN 'appendix_like' END, CASE WHEN title THEN 'title_only' END, CASE WHEN cap THEN 'caption_or_numeric_only' END) AS penalties FROM sc""",
        "answer_sources": f"""WITH {bm25}, a AS (SELECT item_id AS request_id, list_filter({tokens('text')}, lambda z: length(z) >= 2 OR regexp_matches(z, '[0-9]')) AS mt FROM benchmark),
            pr AS (SELECT *, list_filter(mt, lambda z: regexp_matches(z, '[0-9]')) AS nt, list_filter(mt, lambda z: {dated}) AS dt FROM a),
            h AS (SELECT bm.query_id AS request_id, bm.doc, bm.keyword_rank AS kr, d.source, {hits('mt', 'dtok')} AS e, {hits('nt', 'dtok')} AS n, {hits('dt', 'dtok')} AS d_, len(nt) > 0 AS wn, len(dt) > 0 AS wd FROM bm JOIN pr ON pr.request_id = bm.query_id JOIN (SELECT doc_id, source, {tokens('text')} AS dtok FROM documents) d ON d.doc_id = bm.doc),
            s AS (SELECT *, least(0.8, e * 0.18) + least(1.1, n * 0.45) + least(0.7, d_ * 0.35) - CASE WHEN wn AND n = 0 THEN 0.35 ELSE 0 END - CASE WHEN wd AND d_ = 0 THEN 0.2 ELSE 0 END + greatest(0.0, 0.18 - (kr - 1) * 0.02) AS base,
              least(1.2, n * 0.52) + least(0.8, d_ * 0.38) + least(0.5, e * 0.1) - CASE WHEN wn AND n = 0 THEN 0.28 ELSE 0 END - CASE WHEN wd AND d_ = 0 THEN 0.18 ELSE 0 END AS sup FROM h),
            r AS (SELECT *, base + sup AS total, row_number() OVER (PARTITION BY request_id ORDER BY round(base + sup, 12) DESC, sup DESC, n DESC, d_ DESC, e DESC, kr) AS rank FROM s QUALIFY rank <= 2),
            f AS (SELECT *, first_value(source) OVER w AS s1, first_value(doc) OVER w AS p1, first_value(total) OVER w AS t1 FROM r WINDOW w AS (PARTITION BY request_id ORDER BY rank))
            SELECT request_id, CAST(rank AS INTEGER) AS rank, source AS filename, doc AS page, round(CAST(total AS DOUBLE), 6) AS total FROM f WHERE rank = 1 OR (NOT (source = s1 AND abs(doc - p1) <= 1) AND sup > 0 AND total >= t1 - 0.35 AND (n > 0 OR d_ > 0 OR sup >= 0.24))""",
        "region_argmax": f"""WITH {blocks}, g AS (SELECT i AS region, (i % 2) * 297.5 AS rx0, (i // 2) * 280.0 AS ry0, (i % 2 + 1) * 297.5 AS rx1, (i // 2 + 1) * 280.0 AS ry1 FROM range(6) t(i)),
            p AS (SELECT *, greatest(0, least(x1, rx1) - greatest(x0, rx0)) * greatest(0, least(y1, ry1) - greatest(y0, ry0)) / ((x1 - x0) * (y1 - y0)) + CASE WHEN (x0 + x1) / 2 BETWEEN rx0 AND rx1 AND (y0 + y1) / 2 BETWEEN ry0 AND ry1 THEN 0.25 ELSE 0 END AS score FROM blocks, g WHERE x1 > x0)
            SELECT doc_id, page_num, seq, CAST(region AS INTEGER) AS region, round(score, 6) AS score FROM p WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY doc_id, page_num, seq ORDER BY score DESC, region) = 1""",
        "page_titles": rf"""WITH {blocks}, b AS (SELECT *, {clean('text')} AS t FROM blocks), c AS (SELECT *, regexp_replace(t, '\s+', '', 'g') AS k FROM b),
            p AS (SELECT *, CASE WHEN type = 'title' THEN 30 ELSE 0 END + CASE WHEN seq = 0 THEN 15 ELSE 0 END + CASE WHEN length(t) BETWEEN 4 AND 80 THEN 12 ELSE 0 END + CASE WHEN regexp_matches(t, '^[A-Z0-9가-힣]') THEN 5 ELSE 0 END - CASE WHEN regexp_matches(t, '[.!?]$') THEN 6 ELSE 0 END
              - CASE WHEN {found('k', '[0-9]')} > 0.4 * length(k) AND length(k) > 0 THEN 15 ELSE 0 END - CASE WHEN {any_of(f"lower({normal('t')})", T.BOILERPLATE)} THEN 20 ELSE 0 END AS points FROM c)
            SELECT doc_id, page_num, CASE WHEN points >= 20 THEN t END AS page_title, CAST(points AS INTEGER) AS points FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY points DESC, seq) = 1""",
        "rag_text": rf"""WITH {blocks}, b AS (SELECT *, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g') AS k, CASE type WHEN 'title' THEN 0 WHEN 'table' THEN 2 ELSE 1 END AS bucket FROM blocks),
            f AS (SELECT * FROM b WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, page_num, k ORDER BY bucket, seq) = 1), g AS (SELECT doc_id, page_num, bucket, string_agg({clean('text')}, chr(10) ORDER BY seq) AS t FROM f GROUP BY ALL),
            j AS (SELECT doc_id, page_num, string_agg(t, chr(10) || chr(10) ORDER BY bucket) AS t FROM g GROUP BY ALL) SELECT doc_id, page_num, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM j""",
        "captions": f"""WITH {blocks}, p AS (SELECT a.doc_id, a.page_num, a.seq, t.seq AS r, greatest(0.0, t.y0 - a.y1, a.y0 - t.y1) AS gap, length(t.text) AS n FROM blocks a JOIN blocks t ON a.doc_id = t.doc_id AND a.page_num = t.page_num AND a.type = 'table' AND t.type <> 'table' AND least(a.x1, t.x1) > greatest(a.x0, t.x0)),
            k AS (SELECT *, CASE WHEN n <= 120 AND gap < 80 THEN 0 WHEN gap < 40 THEN 1 END AS tier FROM p), m AS (SELECT * FROM k WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page_num, seq ORDER BY tier, gap, r) = 1)
            SELECT b.doc_id, b.page_num, b.seq, m.r AS caption_seq FROM blocks b LEFT JOIN m ON m.doc_id = b.doc_id AND m.page_num = b.page_num AND m.seq = b.seq WHERE b.type = 'table'""",
    }
