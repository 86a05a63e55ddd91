"""Shape, quality and readiness of whole tables, in numpy over all cells of an Arrow batch.

The results are those of ``normalized``, ``quality`` and ``readiness`` in
``folia.functions.tables``, which stay the expressions for single blocks. As
expressions they look at each cell dozens of times in interpreted lambdas; here each
cell's characters are classified once, and the rest are sums by row, column and table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.functions.text import _WHITE

RATIOS = ("overall", "row_stability", "header_likelihood", "empty_cell_ratio", "numeric_alignment")
#: Tables that a worker takes at a time.
PIECE = 2048

DIGIT, LETTER, SYMBOL, UNIT, LETTER_OR_DIGIT = 1, 2, 4, 8, 3
_CLASS = np.zeros(0x110000, dtype=np.uint8)
_CLASS[ord("0") : ord("9") + 1] |= DIGIT
for _first, _last in ("AZ", "az", "가힣"):
    _CLASS[ord(_first) : ord(_last) + 1] |= LETTER
_CLASS[[ord(_c) for _c in "▪•□◦-()▲△▼▽■◆"]] |= SYMBOL
_CLASS[[ord(_c) for _c in "(%조억원백만bptxusdBPTXUSD)"]] |= UNIT
_SPACES = f"[{_WHITE}]"


def measured(tables: DataFrame, source_bias: float = 0.5) -> DataFrame:
    """``table_id, n_rows, n_cols, numeric_cols, ready`` and the RATIOS of ``tables`` (table_id, rows); ``source_bias``: that of their source.

    ``numeric_cols`` are joined by commas. The batches hold whole tables, so nothing moves between tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                found = measure(piece.column(1), source_bias)
                yield pa.RecordBatch.from_arrays([piece.column(0), *found.values()], names=["table_id", *found])

    kind = tables.schema["table_id"].dataType.simpleString()
    schema = f"table_id {kind}, n_rows int, n_cols int, numeric_cols string, {', '.join(f'{c} double' for c in RATIOS)}, ready string"
    return tables.select("table_id", F.col("rows").cast("array<array<string>>")).mapInArrow(run, schema)


def _one_line(cells: pa.Array) -> pa.Array:
    """``normalize_text`` of each; null is empty."""
    cells = pc.fill_null(cells, "")
    runs = pc.match_substring_regex(cells, rf"{_SPACES}{{2}}|[{_WHITE.replace(' ', '')}]|^ | $")
    if not pc.any(runs).as_py():
        return cells
    return pc.utf8_trim(pc.replace_substring_regex(cells, f"{_SPACES}+", " "), " ")


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole != 0)


def _sums(values: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by group."""
    return np.bincount(by, weights=values, minlength=n).astype(np.int64)


def _likelihood(filled, letters, short, digits, data_filled, data_digits) -> np.ndarray:
    """``header_likelihood`` from counts of the header's and the data's cells."""
    lead = _ratio(data_digits, data_filled) - _ratio(digits, filled) + 0.2
    total = 0.45 * _ratio(letters, filled) + 0.30 * _ratio(short, filled) + 0.25 * np.maximum(0.0, lead)
    return np.where(filled > 0, np.minimum(1.0, np.maximum(0.0, total)), 0.0)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _characters(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all characters, and how many characters each cell has."""
    cells = cells.cast(pa.large_string())
    ends = np.frombuffer(cells.buffers()[1], dtype=np.int64)[cells.offset : cells.offset + len(cells) + 1]
    raw = memoryview(cells.buffers()[2] or b"")[ends[0] : ends[-1]] if len(cells) else b""
    octets = np.frombuffer(raw, dtype=np.uint8)
    if not (octets & 0x80).any():
        return _CLASS[octets], np.diff(ends)
    begins = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum((octets & 0xC0) != 0x80)))
    points = np.frombuffer(bytes(raw).decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    return _CLASS[points], np.diff(begins[ends - ends[0]])


def measure(tables: pa.Array, source_bias: float) -> dict[str, pa.Array]:
    """The measures of ``tables``, a list array of rows of cells."""
    n = len(tables)
    absent = tables.is_null().to_numpy(zero_copy_only=False)
    row_table = pc.list_parent_indices(tables).to_numpy().astype(np.int64)
    rows = pc.list_flatten(tables)
    cell_row = pc.list_parent_indices(rows).to_numpy().astype(np.int64)
    cells = _one_line(pc.list_flatten(rows))

    # by cell
    classes, size = _characters(cells)
    ends = np.cumsum(size)
    totals = lambda bit: np.diff(np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum((classes & bit) != 0)))[np.concatenate((np.zeros(1, dtype=np.int64), ends))])
    filled, digit, letter, unit = size > 0, totals(DIGIT) > 0, totals(LETTER) > 0, totals(UNIT) > 0
    symbolic = (totals(SYMBOL) > 0) & (totals(LETTER_OR_DIGIT) <= 1)
    place = np.arange(len(cell_row)) - _starts(np.bincount(cell_row, minlength=len(rows)))[cell_row]

    # by row, without those that have no text
    by_row = lambda x: _sums(x, cell_row, len(rows))
    full = by_row(filled) > 0
    width = np.bincount(cell_row, minlength=len(rows))
    number = np.cumsum(full) - 1  # of each kept row
    kept = full[cell_row]
    table = row_table[full]
    n_rows = np.bincount(table, minlength=n)
    start = _starts(n_rows)
    n_cols = np.zeros(n, dtype=np.int64)
    np.maximum.at(n_cols, table, width[full])
    r_filled, r_digits, r_letters, r_short, r_size, r_symbolic = (by_row(x)[full] for x in (filled, digit, letter, filled & (size <= 25), size, symbolic))
    at = np.arange(len(table)) - start[table]

    # the likeliest header of the first three rows
    run = {k: np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(x))) for k, x in (("filled", r_filled), ("digits", r_digits))}
    scores = np.full((3, n), -1.0)
    stop = start + n_rows
    for i in range(3):
        has = np.flatnonzero(n_rows > i)
        h = start[has] + i
        a, b = h + 1, np.minimum(h + 4, stop[has])
        scores[i, has] = _likelihood(r_filled[h], r_letters[h], r_short[h], r_digits[h], *(run[k][b] - run[k][a] for k in ("filled", "digits")))
    best = scores.argmax(axis=0)
    rank = np.where(at == best[table], 0, at + (at < best[table]))  # a row's place once the header is on top
    order = np.empty(len(table), dtype=np.int64)
    order[start[table] + rank] = np.arange(len(table))

    # by table
    some = np.flatnonzero(n_rows > 0)
    head = np.zeros(n, dtype=np.int64)
    head[some] = order[start[some]]
    by_table = lambda x: _sums(x, table, n)
    of_head = lambda x: np.where(n_rows > 0, x[head], 0) if len(x) else np.zeros(n, dtype=np.int64)
    t_filled, t_digits = by_table(r_filled), by_table(r_digits)
    total = n_rows * n_cols
    h_filled, h_digits = of_head(r_filled), of_head(r_digits)
    likely = _likelihood(h_filled, of_head(r_letters), of_head(r_short), h_digits, t_filled - h_filled, t_digits - h_digits)
    empty = _ratio(total - t_filled, np.maximum(1, total))
    complete = _ratio(h_filled, np.maximum(1, n_cols))
    long = _ratio(by_table(((r_filled <= 1) & (r_size + r_filled - 1 > 90)) | ((r_size + r_filled - 1) / np.maximum(1, r_filled) > 70)), n_rows)
    symbol_share = np.where(t_filled > 0, _ratio(by_table(r_symbolic), t_filled), 1.0)

    c_row, c_place = number[cell_row[kept]], place[kept]
    c_table = table[c_row]
    codes = pc.dictionary_encode(cells).indices.to_numpy().astype(np.int64)[kept]
    c_filled, c_digit, c_unit, c_size = filled[kept], digit[kept], unit[kept], size[kept]
    pairs = np.unique((c_table * (len(cells) + 1) + codes)[c_filled])
    repeats = 1.0 - _ratio(np.bincount(pairs // (len(cells) + 1), minlength=n), np.maximum(1, t_filled))

    # the commonest number of filled cells, the first of equal ones
    counts, ranked_table = r_filled[order], table[order]
    _, which, often = np.unique(ranked_table * (int(counts.max(initial=0)) + 1) + counts, return_inverse=True, return_counts=True)
    often = often[which]
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, ranked_table, often)
    first = np.full(n, len(order), dtype=np.int64)
    hit = np.flatnonzero(often == most[ranked_table])
    np.minimum.at(first, ranked_table[hit], hit)
    stable = _ratio(_sums(np.abs(counts - counts[first[ranked_table]]) <= 1, ranked_table, n), n_rows)

    # columns: numeric by the first five data rows, consistent by all
    base = _starts(n_cols)
    column, c_rank, n_columns = base[c_table] + c_place, rank[c_row], int(n_cols.sum())
    column_table = np.repeat(np.arange(n), n_cols)
    early, data = (c_rank >= 1) & (c_rank <= 5) & c_filled, (c_rank >= 1) & c_filled
    by_column = lambda x, where: _sums(x[where], column[where], n_columns)
    seen = by_column(c_filled, early)
    numeric = (seen > 0) & (_ratio(by_column(c_digit, early), seen) >= 0.6)
    known = by_column(c_filled, data)
    share = _ratio(by_column(c_digit, data), known)
    used = numeric & (known > 0)
    mean = _ratio(np.bincount(column_table[used], weights=share[used], minlength=n), np.bincount(column_table[used], minlength=n))
    n_numeric = np.bincount(column_table[numeric], minlength=n)
    consistent = np.where((n_cols <= 0) | (n_rows <= 1), 0.0, np.where(n_numeric == 0, np.where(n_cols >= 2, 0.15, 0.0), mean))
    names = pa.array((np.arange(n_columns) - base[column_table])[numeric]).cast(pa.string())
    numeric_cols = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(1), np.cumsum(n_numeric))).astype(np.int32)), names), ",")

    # first cells, and single columns
    lead = c_place == 0
    lead_digit, lead_size, lead_filled = np.zeros(len(table), dtype=bool), np.zeros(len(table), dtype=np.int64), np.zeros(len(table), dtype=bool)
    lead_digit[c_row[lead]], lead_size[c_row[lead]], lead_filled[c_row[lead]] = c_digit[lead], c_size[lead], c_filled[lead]
    body = by_table((rank >= 1) & lead_filled)
    lead_rows = by_table((rank >= 1) & lead_digit)
    hint = _sums(c_unit & (c_rank <= 2) & lead, c_table, n) > 0  # asked for tables of one column, whose rows are all filled
    compact = (n_cols == 1) & (n_rows >= 2) & (body > 0) & (likely >= 0.72) & (long < 0.45) & (symbol_share < 0.35) & ((consistent >= 0.15) | (_ratio(lead_rows, body) >= 0.7)) & hint
    collapsed = by_table((n_cols[table] > 15) & (r_digits > 10)) > 0
    narrative = by_table((lead_size > 80) & (r_digits > 2)) > 0
    chars = by_table(r_size)
    giant = (n_rows < 3) & (chars > 300)
    shape = np.where(giant | collapsed | narrative, 0.1, np.where(n_rows > 50, 0.5, np.where((n_cols < 2) | (n_rows < 2), np.where(compact, 0.55, 0.05), 1.0)))
    prose = (chars + n_rows * (n_cols - 1) + n_rows - 1 > 100) & (by_table(r_filled >= 3) > 0) & (by_table((r_filled == 1) & (lead_size > 50)) > 0)
    for i in np.flatnonzero(prose):
        prose[i] = _prose([cells.slice(x, y).to_pylist() for x, y in _cells_of(i, order, start, n_rows, np.flatnonzero(full), width)], int(n_cols[i]))
    overall = (1.0 - empty) * 2.0 + complete + likely * 1.2 + consistent * 1.4 + shape * 2.0 - long * 2.0 - symbol_share * 2.2 - repeats + stable * 1.4 + source_bias * 0.4

    none = n_rows == 0
    reasons = (
        (prose & ~none, "dashboard_mixed_table"), (giant & ~none, "giant_dump_table"), (collapsed, "collapsed_row_table"), (narrative, "mixed_narrative_table"), ((total > 0) & (_ratio(t_filled, total) < 0.2), "non_rectangular_sparse_table"),
        ((n_cols < 2) & ~compact & ~none, "single_column_pseudo_table"), ((symbol_share > 0.55) & ~none, "symbolic_pseudo_table"), (absent, "no_headers"), (none, "no_rows"), (n_rows < 2, "micro_fragment_table"), (h_filled == 0, "no_headers"),
        ((lead_rows == n_rows - 1) & (n_cols <= 5) & (n_rows - 1 < 3), "no_row_labels"), (_ratio(t_filled, total) < 0.3, "non_rectangular_sparse_table"),
    )
    ready = np.select([c for c, _ in reasons], [r for _, r in reasons], "summary_ready")
    zero = lambda x, value=0.0: pa.array(np.where(none, value, x))
    return {
        "n_rows": pa.array(n_rows.astype(np.int32), mask=absent), "n_cols": pa.array(n_cols.astype(np.int32)), "numeric_cols": numeric_cols, "overall": zero(overall), "row_stability": zero(stable),
        "header_likelihood": zero(likely), "empty_cell_ratio": zero(empty, 1.0), "numeric_alignment": zero(consistent), "ready": pa.array(ready.astype(object), pa.string()),
    }


def _cells_of(i: int, order: np.ndarray, start: np.ndarray, n_rows: np.ndarray, raw: np.ndarray, width: np.ndarray) -> list[tuple[int, int]]:
    """Where the cells of a table's rows are: first one and number."""
    rows = raw[order[start[i] : start[i] + n_rows[i]]]
    first = _starts(width)
    return [(int(first[r]), int(width[r])) for r in rows]


def _prose(rows: list[list[str]], n_cols: int) -> bool:
    """The sentences of ``functions.tables._prose``, whose other conditions hold."""
    text = "\n".join(" ".join(r + [""] * (n_cols - len(r))) for r in rows)
    return "다." in text and sum(len(s.strip(" ")) > 15 for s in re.split(rf"[.?!]{_SPACES}+", text)) >= 2
