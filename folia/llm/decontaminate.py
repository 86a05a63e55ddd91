"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, units and names turn into typed placeholders whose
values are kept as slots; other words are lower-cased and stripped of punctuation.
Windows of a benchmark item's template are hash-joined with the documents' windows.
An amount with a sign or unit attached counts as two words, and a capitalised word
that begins a sentence or line is tried both as a word and as a name.
In a run of matches with one offset, windows with the item's own values count, and
others if they are slot-consistent: each value of the item stands against one value
of the document, the one most windows give, and few values share one. So a question
with other numbers or names is found, and chance fits of placeholders aren't.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import U, Words, mix, weights, windows

#: Words of a window; a shorter item is one window of its own length.
WINDOW = 8
#: Shortest item, in words, that is looked for as a template; a shorter one is looked for word by word.
LEAST_ITEM = 6
#: Share of an item's windows that a leaking document holds at least.
COVERAGE = 0.5
#: Literal words that a window of an item has at least; others say too little.
LEAST_LITERAL = 4
#: The same where open words are taken as names.
LEAST_BESIDE_NAMES = 3

# Units of measure that follow or end a number.
UNITS = frozenset("mm cm m km g kg mg t l ml s ms h min kb mb gb tb hz khz mhz ghz w kw v kv a j kj pa bar mph kph ft in yd mi lb lbs oz usd eur gbp % $ € £ percent dollars euros pounds meters metres miles hours minutes seconds days weeks months years".split())
# Number words.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion".split())

#: Most words of a window that may be a word or a name and are tried in every combination; of more, all as words and all as names.
MOST_OPEN = 3

#: Values of an item that may stand against one value of a document; of more, only the best attested does.
MOST_MERGED = 2

#: Words whose reading a task remembers at most; beyond, it begins anew.
MOST_READ = 50_000

_LITERAL, _NUMBER, _UNIT, _TITLE, _OPEN = range(5)
_NUMBER_RE = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?")
_AMOUNT_RE = re.compile(r"([+-]?)([$€£]?)([+-]?\d(?:[\d.,:/]*\d)?)-?([^\W\d_]+|[%$€£])?")
_EDGES = "\"'`.,;:!?()[]{}<>«»“”‘’¿¡…*_#-–—"
_PLACEHOLDER = {_NUMBER: 0xA11CE5ED00000001, _UNIT: 0xA11CE5ED00000002, _TITLE: 0xA11CE5ED00000003}


def _split_amount(bare: str) -> list[str] | None:
    """Sign of currency, number and unit of an amount that is written as one word; None for other words."""
    found = _AMOUNT_RE.fullmatch(bare)
    if not found or not (found[2] or found[4]) or (found[4] and found[4].lower() not in UNITS):
        return None
    return [x for x in (found[2], found[1] + found[3], found[4]) if x]


#: Keeps the hashes of exact windows apart from those of templates.
_EXACT = U(0x5EEDE4AC7)

_BYTES = np.arange(256)
_UPPER, _LOWER = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122)
_EDGE = np.isin(_BYTES, np.frombuffer("".join(c for c in _EDGES if ord(c) < 128).encode(), dtype=np.uint8))
#: Bytes that send a word through the Python path: digits, signs of amounts, hyphens inside, and all but ASCII.
_OTHER = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | np.isin(_BYTES, np.frombuffer(b"$%+-", dtype=np.uint8))
_QUOTE, _STOP = np.isin(_BYTES, np.frombuffer(b"\"')", dtype=np.uint8)), np.isin(_BYTES, np.frombuffer(b".!?:", dtype=np.uint8))


def _hashed(words: list[str]) -> np.ndarray:
    """Hashes of words without ASCII white space."""
    return Words([w.encode("utf-8") for w in words]).hashes() if words else np.zeros(0, dtype=U)


class Lexicon:
    """How each distinct word reads: kinds and hashes of its parts, and whether a sentence ends with it.

    Plain ASCII words are read in numpy for a whole chunk; the others one by one, and remembered (up to MOST_READ).
    """

    def __init__(self) -> None:
        self.numbers, self.units = np.sort(_hashed(sorted(NUMBER_WORDS))), np.sort(_hashed(sorted(UNITS)))
        self.read: dict[bytes, tuple[list[tuple[int, str, int]], bool]] = {}

    def slow(self, words: list[bytes]) -> list[tuple[list[tuple[int, str, int]], bool]]:
        """For each word: (kind, value, hash) of its parts, and whether a sentence ends with it."""
        if len(self.read) >= MOST_READ:
            self.read.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in self.read]
        split = []
        for word in fresh:
            text = word.decode("utf-8", "replace")
            bare = text.strip(_EDGES) or text
            parts = None if _NUMBER_RE.fullmatch(bare) else _split_amount(bare)
            split.append(([(self.kind(p, p.lower()), p.lower()) for p in parts or [bare]], text.rstrip("\"'”’)")[-1:] in (".", "!", "?", ":")))
        codes = iter(_hashed([v for parts, _ in split for _, v in parts]).tolist())
        for word, (parts, stop) in zip(fresh, split, strict=True):
            self.read[word] = [(k, v, next(codes)) for k, v in parts], stop
        return [self.read[w] for w in words]

    @staticmethod
    def kind(bare: str, low: str) -> int:
        if _NUMBER_RE.fullmatch(bare) or all(x in NUMBER_WORDS for x in low.split("-")):
            return _NUMBER
        if low in UNITS:
            return _UNIT
        return _TITLE if len(bare) > 1 and bare[0].isupper() and bare[1:].islower() else _LITERAL


class Templates:
    """The canonical words of a chunk of texts, as arrays: ``doc``, ``kinds``, and the hashes with open words as literals (``plain``) and as names (``named``)."""

    def __init__(self, texts: list[bytes], lexicon: Lexicon):
        self.words = w = Words(texts)
        whole = w.hashes()
        _, first, which = np.unique(whole, return_index=True, return_inverse=True)
        starts, ends = w.starts[first].copy(), w.ends[first].copy()
        self.slow: dict[int, list[str]] = {}  # values of the parts of words that Python reads, by their number
        kinds, codes, stops = self._plain(starts, ends, lexicon)
        size = np.ones(len(first), dtype=np.int64)
        spare: list[tuple[int, int]] = []
        hard = np.flatnonzero(kinds < 0).tolist()
        for u, (parts, stop) in zip(hard, lexicon.slow([w.raw[a:b].tobytes() for a, b in zip(starts[hard].tolist(), ends[hard].tolist(), strict=True)]), strict=True):
            kinds[u], codes[u], stops[u] = parts[0][0], parts[0][2], stop
            self.slow[u] = [v for _, v, _ in parts]
            if len(parts) > 1:
                size[u] = len(parts)
                spare += [(k, c) for k, _, c in parts[1:]]
        self.starts, self.ends = starts, ends  # of the distinct words, without their edges
        # a part is found by its word's place for the first one, behind all first parts for the others
        kinds, codes = np.append(kinds, np.array([k for k, _ in spare], dtype=np.int8)), np.append(codes, np.array([c for _, c in spare], dtype=U))
        after = len(size) + np.cumsum(size - 1) - (size - 1) - 1
        times = size[which]
        self.word = np.repeat(np.arange(len(which)), times)
        self.number = which[self.word]
        self.part = np.arange(len(self.word)) - np.repeat(np.cumsum(times) - times, times)
        entry = np.where(self.part == 0, self.number, after[self.number] + self.part)
        self.kinds, self.codes, self.doc = kinds[entry], codes[entry], w.doc[self.word]
        lines = np.cumsum(w.raw == 10)[w.starts]
        begins = np.ones(len(which), dtype=bool)
        begins[1:] = (lines[1:] != lines[:-1]) | stops[which[:-1]]
        self.open = (self.kinds == _TITLE) & (self.part == 0) & begins[self.word]
        holders = np.array([0, _PLACEHOLDER[_NUMBER], _PLACEHOLDER[_UNIT], _PLACEHOLDER[_TITLE]], dtype=U)
        literal = (self.kinds == _LITERAL) | self.open
        plain = np.where(literal, self.codes, holders[self.kinds])
        self.plain = mix(plain)
        self.named = np.where(self.open, mix(holders[_TITLE : _TITLE + 1]), self.plain)
        self.slotted = ~literal

    def _plain(self, starts: np.ndarray, ends: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kind (-1: for Python), hash and sentence end of the distinct words; moves ``starts`` and ``ends`` past their edges."""
        raw, full = self.words.raw, (starts.copy(), ends.copy())

        def within(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(table[raw], dtype=np.int32)))
            return total[b] - total[a]

        last = ends.copy()
        while len(moved := np.flatnonzero((last > starts) & _QUOTE[raw[last - 1]])):
            last[moved] -= 1
        stops = (last > starts) & _STOP[raw[last - 1]]
        while len(moved := np.flatnonzero((ends > starts) & _EDGE[raw[ends - 1]])):
            ends[moved] -= 1
        while len(moved := np.flatnonzero((ends > starts) & _EDGE[raw[np.minimum(starts, len(raw) - 1)]])):
            starts[moved] += 1
        empty = starts >= ends
        starts[empty], ends[empty] = full[0][empty], full[1][empty]
        codes = self.words.hash_ranges(starts, ends)
        title = _UPPER[raw[starts]] & (within(_UPPER, starts + 1, ends) == 0) & (within(_LOWER, starts + 1, ends) > 0)
        kinds = np.where(title, _TITLE, _LITERAL).astype(np.int8)
        kinds[np.isin(codes, lexicon.units)] = _UNIT
        kinds[np.isin(codes, lexicon.numbers)] = _NUMBER
        other = within(_OTHER, *full) > 0
        kinds[other], starts[other], ends[other] = -1, full[0][other], full[1][other]
        return kinds, codes, stops

    def value(self, at: int) -> str:
        """The canonical word at a place."""
        u = int(self.number[at])
        if u in self.slow:
            return self.slow[u][int(self.part[at])]
        return bytes(self.words.raw[self.starts[u] : self.ends[u]]).decode("utf-8", "replace").lower()

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first word, and mask of the open words taken as names (bit j: the window's word j), of each form of each window inside a text.

        ``-k``: windows of ``k`` words as they are, without placeholders.
        """
        if k < 0:
            found, at = windows(mix(self.codes ^ _EXACT), self.doc, -k)
            return found.view(np.int64), at, np.zeros(len(at), dtype=np.int64)
        n = len(self.plain) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        found, at = windows(self.plain, self.doc, k, mixed=False)
        before = np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(self.open, dtype=np.int32)))
        several = np.flatnonzero(before[at + k] > before[at])
        sums, places, masks = [found], [at], [np.zeros(len(at), dtype=np.int64)]
        if len(several):
            # an open word taken as a name adds a difference to a window's sum: of the first MOST_OPEN ones and of all
            base, here = found[several], at[several]
            count = before[here + k] - before[here]
            rank = np.zeros(len(here), dtype=np.int64)
            step = np.zeros((MOST_OPEN, len(here)), dtype=U)
            bit = np.zeros((MOST_OPEN, len(here)), dtype=np.int64)
            whole, bits = np.zeros(len(here), dtype=U), np.zeros(len(here), dtype=np.int64)
            with np.errstate(over="ignore"):
                difference, weight = self.named - self.plain, weights(k)
                for j in range(k):
                    rows = np.flatnonzero(self.open[here + j])
                    change = difference[here[rows] + j] * weight[j]
                    whole[rows] += change
                    bits[rows] |= 1 << j
                    early = rank[rows] < MOST_OPEN
                    step[rank[rows][early], rows[early]], bit[rank[rows][early], rows[early]] = change[early], 1 << j
                    rank[rows] += 1
                sums.append(base + whole)
                places.append(here)
                masks.append(bits)
                for subset in range(1, (1 << MOST_OPEN) - 1):
                    rows = np.flatnonzero((count > 1) & (count <= MOST_OPEN) & (subset < (1 << count.astype(np.int64)) - 1))
                    if len(rows):
                        some = [r for r in range(MOST_OPEN) if subset >> r & 1]
                        sums.append(base[rows] + step[some][:, rows].sum(axis=0, dtype=U))
                        places.append(here[rows])
                        masks.append(bit[some][:, rows].sum(axis=0))
        with np.errstate(over="ignore"):
            return mix(np.concatenate(sums) + U(k)).view(np.int64), np.concatenate(places), np.concatenate(masks)

    def slots(self, at: int, k: int, named: int = 0) -> list[tuple[int, str]]:
        """(offset, value) of the placeholders of a window; none for a negative ``k``."""
        return [(j, self.value(at + j)) for j in range(k) if self.slotted[at + j] or named >> j & 1]


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, size, total, hash, at, offsets, values``: the windows of the items.

    ``size``: words of the window, negative where it is looked for without
    placeholders; ``total``: the item's windows that say enough, or all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for item, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                t = Templates([text], lexicon)
                k = min(WINDOW, len(t.plain))
                if item is None or not k:
                    continue
                forms = [(code, at, t.slots(at, k, named), LEAST_BESIDE_NAMES if named else LEAST_LITERAL) for code, at, named in zip(*(x.tolist() for x in t.windows(k)), strict=True)]
                good = [f for f in forms if k - len(f[2]) >= f[3]]
                if k < LEAST_ITEM or not good:  # says too little as a template: all its words are looked for
                    k = -k
                    good = [(code, at, [], 0) for code, at in zip(*(x.tolist() for x in t.windows(k)[:2]), strict=True)]
                total = len({f[1] for f in good})
                for code, at, slots, _ in good:
                    for column, value in zip(out, (item, k, total, code, at, [s[0] for s in slots], [s[1] for s in slots]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["item_id", "size", "total", "hash", "at", "offsets", "values"])

    schema = "item_id bigint, size int, total int, hash bigint, at int, offsets array<int>, `values` array<string>"
    return common.map_batches(benchmark.select(F.col(id_col).cast("bigint"), text_col), run, schema)


def whole_copy(hits: list[tuple[int, int, list[str], list[str]]], total: int) -> tuple[int, bool]:
    """As ``consistent_cover``, for exact windows: ``total`` if one run holds them all, else 0."""
    runs: dict[int, set] = defaultdict(set)
    for place, at, _, _ in hits:
        runs[place - at].add(at)
    return (total if any(len(run) == total for run in runs.values()) else 0), True


def consistent_cover(hits: Iterable[tuple[int, int, list[str], list[str]]]) -> tuple[int, bool]:
    """From (place in the document, place in the item, document's values, item's values) of an item's matches in one
    document: the item's windows that are covered, and whether all their values are the item's own.

    In a run, windows with the item's own values always count; others where each value of the item stands against the
    document's value that most windows give it.
    """
    runs: dict[int, list] = defaultdict(list)
    for place, at, own, given in hits:
        runs[place - at].append((at, set(zip(given, own, strict=True))))
    covered: set[int] = set()
    same = True
    for run in runs.values():
        votes: Counter = Counter(pair for _, pairs in run for pair in pairs)
        chosen: dict[str, str] = {}
        users: dict[str, list[str]] = defaultdict(list)
        for (given, own), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
            if given not in chosen:
                chosen[given] = own
                users[own].append(given)
        for own, several in users.items():
            if len(several) > MOST_MERGED:
                for given in several[1:]:
                    del chosen[given]
        for at, pairs in run:
            verbatim = all(g == o for g, o in pairs)
            if verbatim or all(chosen.get(g) == o for g, o in pairs):
                covered.add(at)
                same &= verbatim
    return len(covered), same


_LEAKS = "doc_id bigint, item_id bigint, windows int, coverage double, same_values boolean"


def _leak_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "windows", "coverage", "same_values"])


class Index:
    """The item windows as flat arrays, sorted by hash: what every worker holds. ``given``: the values of all windows one after another."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        order = np.lexsort(tuple(table.column(c).to_numpy() for c in ("at", "item_id", "size", "hash")))
        table = table.take(pa.array(order)).combine_chunks()
        self.keys, self.item, self.size, self.total, self.at = (table.column(c).to_numpy() for c in ("hash", "item_id", "size", "total", "at"))
        lists = table.column("values").combine_chunks() if len(table) else pa.array([], pa.list_(pa.string()))
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.begin, self.given = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0), lists.flatten()
        self.bits = max(10, min(24, int(len(self.keys) * 16).bit_length()))
        self.some = np.zeros(1 << self.bits, dtype=bool)
        self.some[self._short(self.keys)] = True
        self.sizes = sorted(set(self.size.tolist()))

    def _short(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(U) >> U(64 - self.bits)

    def met(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each key that the index has: its place in ``keys``, and its first and last-but-one entry."""
        likely = np.flatnonzero(self.some[self._short(keys)])
        left, right = np.searchsorted(self.keys, keys[likely]), np.searchsorted(self.keys, keys[likely], side="right")
        found = right > left
        return likely[found], left[found], right[found]

    def values(self, entry: int) -> list[str]:
        return self.given[int(self.begin[entry]) : int(self.begin[entry + 1])].to_pylist()


def _verdict(item: int, exact: bool, total: int, hits: list, coverage: float) -> tuple[int, int, float, bool] | None:
    """The result row, but for the document, of an item's matches in one document; None if they are no leak."""
    n, same = whole_copy(hits, total) if exact else consistent_cover(hits)
    return (item, n, n / total, same) if n and n >= coverage * total else None


def _by_broadcast(docs: DataFrame, index: DataFrame, coverage: float) -> DataFrame:
    """The join inside the scan of the documents: the item windows, of checked size, go to every worker."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(index.select("item_id", "size", "total", "hash", "at", "values").toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lexicon = shared.value, Lexicon()
        for batch in batches:
            rows, ids, texts = [], batch.column(0).to_pylist(), common.as_bytes(batch.column(1))
            for a, b in common.slices(texts, common.FINE_BYTES) if len(known.keys) else ():
                t = Templates(texts[a:b], lexicon)
                hits: dict[tuple, list] = defaultdict(list)
                for k in known.sizes:
                    found, places, named = t.windows(k)
                    for form, left, right in zip(*(x.tolist() for x in known.met(found)), strict=True):
                        place = int(places[form])
                        own = [v for _, v in t.slots(place, k, int(named[form]))]
                        for n in range(left, right):
                            if known.size[n] == k:
                                hits[int(t.doc[place]), int(known.item[n]), k < 0, int(known.total[n])].append((place, int(known.at[n]), own, known.values(n)))
                for (doc, item, exact, total), of_item in hits.items():
                    if (row := _verdict(item, exact, total, of_item, coverage)) is not None:
                        rows.append((ids[a + doc], *row))
            yield _leak_batch(rows)

    return common.map_batches(docs, run, _LEAKS)


def _by_shuffle(docs: DataFrame, index: DataFrame, coverage: float) -> DataFrame:
    """The same join for item windows beyond the broadcast bound: both sides are dealt by hash.

    The documents are written first, so that a row keeps its key when a task runs again.
    """
    rows = common.stored(docs, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    sizes = [r[0] for r in index.select("size").distinct().collect()]  # at most 2 * WINDOW values

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            texts = common.as_bytes(batch.column(2))
            for x, y in common.slices(texts, common.FINE_BYTES):
                t = Templates(texts[x:y], lexicon)
                for k in sizes:
                    found, places, named = t.windows(k)
                    for a in range(0, len(found), 5000):
                        at = places[a : a + 5000]
                        own = [[v for _, v in t.slots(p, k, m)] for p, m in zip(at.tolist(), named[a : a + 5000].tolist(), strict=True)]
                        of = pa.array(t.doc[at] + x)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(of), batch.column(1).take(of), pa.array(at, pa.int64()), pa.array(np.full(len(at), k), pa.int32()), pa.array(found[a : a + 5000]), pa.array(own, pa.list_(pa.string()))], names=["row", "doc_id", "place", "size", "hash", "own"]
                        )

    pieces = common.map_batches(rows, cut, "row bigint, doc_id bigint, place bigint, size int, hash bigint, own array<string>")
    met = pieces.join(index, ["hash", "size"]).groupBy("row", "doc_id", "item_id", (F.col("size") < 0).alias("exact"), "total").agg(F.collect_list(F.struct("place", "at", "own", F.col("values").alias("given"))).alias("hits"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, item, exact, total, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = _verdict(item, exact, total, [(h["place"], h["at"], h["own"], h["given"]) for h in hits], coverage)
                if row is not None:
                    rows.append((doc, *row))
            yield _leak_batch(rows)

    return common.map_batches(met.drop("row"), judge, _LEAKS)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = common.BROADCAST_ROWS) -> DataFrame:
    """``doc_id, item_id, windows, coverage, same_values``: each document that holds at least ``coverage`` of an item's windows.

    same_values: verbatim; else re-parameterised. Null and empty texts hold nothing,
    items without words or with a null id aren't looked for; those under six words or
    without a window that says enough only as a whole, word by word. Whole texts of any
    length are searched; of equal items each is reported. Repeated rows give repeated
    results, null document ids come back null. No documents or no items: no rows.
    Other columns, whatever their names, aren't read.
    """
    index = common.stored(item_windows(benchmark), "items")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return (_by_broadcast if common.small_enough(index, broadcast_rows) else _by_shuffle)(narrow, index, coverage)


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` but for documents with a leak. Rows with a null id can't be named and stay."""
    hit = common.stored(leaks(docs, benchmark, coverage, id_col, text_col).select(F.col("doc_id").alias(id_col)).filter(F.col(id_col).isNotNull()).distinct(), "leaks")
    return docs.join(F.broadcast(hit) if common.small_enough(hit) else hit, id_col, "left_anti").select(docs.columns)
