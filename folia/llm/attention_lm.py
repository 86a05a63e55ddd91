"""LM scoring with causal self-attention in numpy over subword ids, beside a smoothed word unigram.

A text is read as the subwords of a public byte-level BPE vocabulary, word by word. A
word's first subword is predicted by masked self-attention over the first subwords of
the words before it; its other subwords, and its end, by masked self-attention over the
subwords of the word itself. Both are the same kind of model (``Attention``): a local head
and one over the whole window, with logits by query and key symbol and a bias by distance,
one softmax over all heads and positions, and values that are distributions over the next symbol, so a token's
probability is the attention-weighted mean of its keys' values. Sequences are cut into
blocks of new tokens; each block's window also holds the tokens before it, and each
token is scored exactly once.

Symbols are the end, the most frequent ids, and classes of the other ids by how their
strings begin; an id has its corpus share within its symbol. Words seen in training
share their first symbol's probability by their counts, in the whole corpus; the share
of words seen once (Good and Turing) goes to the spelling by the second model.

Training is expectation maximisation: a round over a part of the training documents
gives, for every head, the expected counts of query-key pairs, distances and values,
by which logits and values are rescaled. The rounds together take every training
document once. Expected counts are rounded to whole numbers of 1/65536, so their sums,
the model and the scores don't depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import Words

#: Symbols (the end, classes of less frequent ids, frequent ids) and the classes among them; heads.
SYMBOLS, CLASSES, HEADS = 512, 110, 2
END, PAD = 0, SYMBOLS
WIDE = SYMBOLS + 1
#: Tokens of a window, and the new ones among them: of a text's first subwords, and inside a word.
TEXT_WINDOW, WORD_WINDOW = (32, 16), (8, 4)
#: Keys of the first head: the query's own token and the ones just before it. The second head attends to the whole window.
LOCAL = 8
#: Rounds of training; each training document, or distinct word, is in one of them.
ROUNDS = 6
#: Counts by which logits and values are smoothed, the latter by head, and how much of the earlier rounds' counts stays.
SMOOTH, VALUE_SMOOTH, KEPT = 20.0, (5.0, 50.0), 0.5
#: Words whose counts go to every worker; the others' counts are joined by shuffle.
FREQUENT = 400_000
#: Words that a worker remembers.
REMEMBERED = 800_000
#: Expected counts are whole multiples of its inverse.
UNIT = np.float32(65536)
#: Tokens taken at a time: an array of them stays in a core's cache.
BATCH = 8192
#: Slices in which tasks hand in their expected counts; each is summed on its own.
SLICES = 64


def bpe(path: str):
    """The encoder of a byte-level BPE file."""
    from .token_counts import model

    return model(path).merge


def encoded(encoder, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some words, each with a space before it, one after another; and how many each word has."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ids = np.array(encoder.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), dtype=np.int64)
    begins = np.flatnonzero(_spaced(encoder)[ids])
    if len(begins) == len(words):  # every space begins an id
        return ids, np.diff(np.append(begins, len(ids)))
    each = [encoder.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
    return np.array(list(chain.from_iterable(each)), dtype=np.int64), np.array([len(e) for e in each], dtype=np.int64)


_SPACED: dict[int, np.ndarray] = {}


def _spaced(encoder) -> np.ndarray:
    """Which ids' strings begin with a space."""
    found = _SPACED.get(id(encoder))
    if found is None:
        found = _SPACED[id(encoder)] = np.array([_string(encoder, i)[:1] == b" " for i in range(encoder.max_token_value + 1)])
    return found


def _string(encoder, i: int) -> bytes:
    try:
        return encoder.decode_single_token_bytes(i)
    except KeyError:  # a free id
        return b""


# --- the model ---------------------------------------------------------------------------------------------------


class Windows:
    """Windows of a batch of sequences: blocks of new tokens, with the tokens before them."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, start: np.ndarray | int, shape: tuple[int, int]):
        """``codes``: the targets of all sequences, END last in each; ``lengths``: of each; ``start``: what comes before the first one."""
        context, self.new = shape
        self.blocks = -(-lengths // self.new)
        begin = np.cumsum(lengths) - lengths
        self.lead = context - self.new
        room = self.blocks * self.new + self.lead
        base = np.cumsum(room) - room
        self.inputs = np.full(int(room.sum()), PAD, dtype=np.int64)  # what numpy gathers by without a copy
        self.targets = np.full(len(self.inputs), PAD, dtype=np.int64)
        at = np.repeat(base + self.lead - begin, lengths) + np.arange(len(codes))
        self.targets[at] = codes
        inner = np.ones(len(codes), dtype=bool)
        inner[begin + lengths - 1] = False  # nothing comes after the last target
        self.inputs[at[inner] + 1] = codes[inner]
        self.inputs[base + self.lead] = start
        before = (np.arange(int(self.blocks.sum())) - np.repeat(np.cumsum(self.blocks) - self.blocks, self.blocks)) * self.new
        self.starts = np.repeat(base, self.blocks) + before
        #: Whether tokens of the sequence come before a block, and how many it has.
        self.later, self.size = before > 0, np.minimum(np.repeat(lengths, self.blocks) - before, self.new)

    def steps(self, tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """About ``tokens`` tokens at a time, numbers of blocks with their inputs (places, blocks) and targets (new places, blocks).

        Places before a sequence and, to a quarter of a block, after it are left out; PAD stands in what remains of them.
        """
        quarter = max(self.new // 4, 1)
        size = np.minimum(-(-self.size // quarter) * quarter, self.new)
        for later in (False, True):
            for n in np.unique(size[self.later == later]).tolist():
                alike = np.flatnonzero((self.later == later) & (size == n))
                places = np.arange(0 if later else self.lead, self.lead + n)[:, None]
                for a in range(0, len(alike), max(tokens // n, 1)):
                    some = alike[a : a + max(tokens // n, 1)]
                    at = places + self.starts[some]
                    yield some, self.inputs[at], self.targets[at[-n:]]


class Attention:
    """Causal self-attention whose values are distributions of the next symbol."""

    def __init__(self, shape: tuple[int, int], share: np.ndarray):
        """``share``: the symbols' distribution, from which training starts."""
        self.shape, self.share = shape, share
        context = shape[0]
        self.logits = np.zeros((HEADS, WIDE, WIDE))
        self.local = min(LOCAL, shape[0] - shape[1] + 1)
        self.bias = [-2.0 * np.arange(self.local), -2.0 - 0.03 * np.arange(context)]
        self.values = np.tile(np.append(share, 1.0), (HEADS, WIDE, 1))
        self.held = np.zeros((HEADS, WIDE, SYMBOLS))

    def ready(self) -> Attention:
        """With the tables that scoring and training read, in single precision; made once."""
        if hasattr(self, "weight"):
            return self
        weight = np.exp(self.logits).astype(np.float32)
        weight[:, :, PAD] = 0  # nothing attends to what lies before the sequence
        self.weight = [w.ravel() for w in weight]
        self.near = [np.exp(b).astype(np.float32) for b in self.bias]
        self.value = [v.ravel() for v in self.values.astype(np.float32)]
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("weight", "near", "value")}

    def _attended(self, x: np.ndarray, y: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the unnormalised weights and of the weighted values of each target (new places, blocks).

        Goes by distance, as all keys at one distance are one slice of the inputs. ``kept`` gets, by distance and head,
        the first query with such a key, pairs of query and key, of key and target, weights and weighted values.
        """
        lead, rows = len(x) - len(y), x * WIDE
        whole, chosen = (np.zeros(y.shape, dtype=np.float32) for _ in range(2))
        for d in range(len(x)):
            skip = max(d - lead, 0)
            keys = slice(lead + skip - d, len(x) - d)
            pair, held = rows[lead + skip :] + x[keys], rows[keys] + y[skip:]
            for h in range(d >= self.local, HEADS):
                weights, parts = self.weight[h].take(pair, mode="clip"), self.value[h].take(held, mode="clip")
                weights *= self.near[h][d]
                parts *= weights
                whole[skip:] += weights
                chosen[skip:] += parts
                if kept is not None:
                    kept.append((d, h, skip, pair, held, weights, parts))
        return whole, chosen

    def log_probs(self, windows: Windows) -> np.ndarray:
        """Natural log probability of each target (blocks, new); 0 for padding."""
        out = np.zeros((len(windows.starts), windows.new))
        for some, x, y in windows.steps(BATCH):
            whole, chosen = self._attended(x, y)
            out[some, : len(y)] = np.where(y == PAD, 0.0, np.log(np.maximum(chosen, 1e-37).astype(np.float64)) - np.log(whole.astype(np.float64))).T
        return out

    def expected(self, windows: Windows, into: np.ndarray | None = None) -> np.ndarray:
        """Expected counts, in units, added to ``into``: for each head, the pairs that gave the target beside those attended to, both kinds of distances, and the values."""
        total = np.zeros(sum(self._sizes())) if into is None else into
        counts = [self._split(row) for row in np.split(total, np.cumsum(self._sizes())[:-1])]
        for _, x, y in windows.steps(BATCH):
            kept: list[tuple] = []
            whole, chosen = self._attended(x, y, kept)
            real = y != PAD
            by_whole, by_chosen = np.where(real, UNIT / whole, 0), np.where(real, UNIT / np.maximum(chosen, np.float32(1e-37)), 0)
            for d, h, skip, pair, held, weights, parts in kept:
                pairs, distances, values = counts[h]
                weights *= by_whole[skip:]
                parts *= by_chosen[skip:]
                gave = np.rint(parts, out=parts).astype(np.float64).ravel()
                both = np.empty(len(gave), dtype=np.complex128)  # two counts at the cost of one
                both.real, both.imag = gave, np.rint(weights, out=weights).ravel()
                np.add.at(pairs, pair.ravel(), both)
                np.add.at(values, held.ravel(), gave)
                distances[d] += both.sum()
        return total

    def _sizes(self) -> list[int]:
        """Cells of the expected counts of each head: pairs twice, distances twice, values."""
        return [3 * WIDE * WIDE + 2 * len(b) for b in self.bias]

    @staticmethod
    def _split(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A head's pairs and distances, what gave the target as real parts and what was attended to as imaginary ones, and its values."""
        cells = WIDE * WIDE
        return row[: 2 * cells].view(np.complex128), row[2 * cells : -cells].view(np.complex128), row[-cells:]

    def update(self, counts: np.ndarray) -> None:
        """Rescale logits, biases and values by the expected counts of a round."""
        self.__dict__.pop("weight", None)
        for h, row in enumerate(np.split(counts / float(UNIT), np.cumsum(self._sizes())[:-1])):
            pairs, distances, held = self._split(row)
            self.held[h] = KEPT * self.held[h] + held.reshape(WIDE, WIDE)[:, :SYMBOLS]
            smooth = VALUE_SMOOTH[h]
            self.values[h, :, :SYMBOLS] = (self.held[h] + smooth * self.share) / (self.held[h].sum(axis=1, keepdims=True) + smooth)
            self.logits[h] = np.clip(self.logits[h] + np.log((pairs.real + SMOOTH) / (pairs.imag + SMOOTH)).reshape(WIDE, WIDE), -12, 12)
            self.bias[h] = np.clip(self.bias[h] + np.log((distances.real + SMOOTH) / (distances.imag + SMOOTH)), -60, 12)


@dataclass
class Symbols:
    """Each id's symbol, its log share within the symbol, and the symbols' distribution."""

    code: np.ndarray
    log_share: np.ndarray
    share: np.ndarray


def symbols(times: np.ndarray, targets: np.ndarray, ends: float, encoder) -> Symbols:
    """From how often each id occurs, how often as a target, and how often sequences end."""
    size = len(times)
    order = np.lexsort((np.arange(size), -times))
    own = order[: SYMBOLS - 1 - CLASSES]
    smooth = times + 0.1
    rest = smooth.copy()
    rest[own] = 0
    begins, mass = [], {}
    for i in range(size):
        string = _string(encoder, i)
        begins.append(string[: 2 if string[:1] == b" " else 1])
        mass[begins[i]] = mass.get(begins[i], 0.0) + rest[i]
    number = {g: 1 + k for k, g in enumerate(sorted(mass, key=lambda g: (-mass[g], g))[: CLASSES - 1])}
    code = np.array([number.get(g, CLASSES) for g in begins], dtype=np.int32)
    code[own] = np.arange(1 + CLASSES, 1 + CLASSES + len(own))
    smooth = targets + 0.1
    whole = np.bincount(code, weights=smooth, minlength=SYMBOLS)
    share = whole + 0.5
    share[END] = ends + 0.5
    return Symbols(code, np.log(smooth / whole[code]), share / share.sum())


@dataclass
class WordCounts:
    """Counts of the frequent words (sorted hashes), and the totals of the unigram."""

    keys: np.ndarray
    times: np.ndarray
    tokens: int
    distinct: int
    ends: int

    def log10(self, times: np.ndarray | int) -> np.ndarray:
        return np.log10((times + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def look_up(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of frequent words (0 for others), and which are the others."""
        if not len(self.keys):
            return np.zeros(len(hashed), dtype=np.int64), np.ones(len(hashed), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
        rare = self.keys[at] != hashed
        return np.where(rare, 0, self.times[at]), rare


@dataclass
class Reader:
    """How texts become symbols. ``seen``: of each first symbol, the words' occurrences in training; ``once``: how many of its words occur once."""

    path: str
    name: str
    firsts: Symbols
    inner: Symbols
    seen: np.ndarray
    once: np.ndarray

    @property
    def unseen(self) -> np.ndarray:
        """Share of each first symbol that goes to words never seen."""
        return np.where(self.seen > 0, (self.once + 1) / (self.seen + 2), 1.0)

    def spelling(self, ids: np.ndarray, size: np.ndarray) -> Windows:
        """Windows over the subwords of words: from the first one on, up to the word's end."""
        codes = self.inner.code[ids]
        last = np.cumsum(size) - 1
        targets = np.append(codes[1:], END)
        targets[last] = END
        return Windows(targets, size, codes[last - size + 1], WORD_WINDOW)

    def spelled(self, ids: np.ndarray, size: np.ndarray, model: Attention) -> np.ndarray:
        """Log probability of each word's subwords by ``model``, given the symbol of the first."""
        windows = self.spelling(ids, size)
        first = np.cumsum(size) - size
        inside = self.inner.log_share[ids]
        inside[first] = self.firsts.log_share[ids[first]]
        return np.add.reduceat(model.log_probs(windows).sum(axis=1), np.cumsum(windows.blocks) - windows.blocks) + np.add.reduceat(inside, first)


class WordTable:
    """First symbols and facts of the words seen so far, as flat arrays indexed by the word's number.

    Words are told apart by their hashes, as in the corpus counts. Number 0 stands for a text's
    end. When REMEMBERED are passed, the words that were not met again are forgotten, and so are
    the newest of the others beyond half as many.
    """

    def __init__(self, reader: Reader, counts: WordCounts | None = None, spelling: Attention | None = None):
        self.reader, self.counts, self.spelling, self.encoder = reader, counts, spelling, bpe(reader.path)
        self.held = 1
        self.slots = np.zeros(1 << 16, dtype=np.int32)  # numbers by hash, 0: free; a taken place leads to the next
        self.hash, self.code, self.again = np.zeros(1, dtype=np.int64), np.full(1, END, dtype=np.int32), np.ones(1, dtype=bool)
        self.rare = np.zeros(1, dtype=bool)
        self.base, self.own, self.scale, self.spelled = np.zeros(1), np.zeros(1), np.zeros(1, dtype=np.float32), np.zeros(1, dtype=np.float32)

    def _fields(self) -> tuple[str, ...]:
        return ("hash", "code", "again") if self.counts is None else ("hash", "code", "again", "rare", "base", "own", "scale", "spelled")

    def _places(self, hashed: np.ndarray) -> np.ndarray:
        return (hashed.view(np.uint64) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, hashed: np.ndarray) -> np.ndarray:
        """The words' numbers; 0 for those not held."""
        at = self._places(hashed)
        found = self.slots.take(at)
        left = np.flatnonzero(self.hash.take(found) != hashed)
        left = left[found[left] > 0]
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            found[left] = now = self.slots[at[left]]
            left = left[(now > 0) & (self.hash[now] != hashed[left])]
        return found

    def _enter(self, first: int) -> None:
        """The words from number ``first`` on get their places; at most a third of all places are taken."""
        if 3 * self.held > len(self.slots):
            self.slots, first = np.zeros(1 << (4 * self.held).bit_length(), dtype=np.int32), 1
        left = np.arange(first, self.held, dtype=np.int32)
        at = self._places(self.hash[first : self.held])
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.again[: self.held])[: max(REMEMBERED // 2, 1)]
        for name in self._fields():
            setattr(self, name, getattr(self, name)[keep])
        self.held = len(keep)
        self.again[1:] = False
        self.slots[:] = 0
        self._enter(1)

    def _put(self, name: str, at: int, found: np.ndarray | bool) -> None:
        """``found`` as the field of the words from number ``at`` on; the arrays grow by doubling."""
        field = getattr(self, name)
        if len(field) < self.held:
            field = np.concatenate((field[:at], np.zeros(max(self.held, 2 * at) - at, dtype=field.dtype)))
            setattr(self, name, field)
        field[at : self.held] = found

    def _learn(self, words: list[bytes], hashed: np.ndarray) -> None:
        """New words, lower-cased, with their hashes."""
        at, r = self.held, self.reader
        self.held += len(words)
        ids, size = encoded(self.encoder, words)
        code = r.firsts.code[ids[np.cumsum(size) - size]]
        made = {"hash": hashed, "code": code, "again": False}
        if self.counts is not None:
            times, rare = self.counts.look_up(hashed)
            scale = ((1 - r.unseen) / np.maximum(r.seen, 1))[code].astype(np.float32)
            spelled = (np.log(r.unseen)[code] + r.spelled(ids, size, self.spelling)).astype(np.float32)
            own = np.log(times * scale.astype(np.float64) + np.exp(spelled.astype(np.float64)), where=~rare, out=np.zeros(len(words)))
            made |= {"rare": rare, "base": np.where(rare, 0.0, self.counts.log10(times)), "own": own, "scale": scale, "spelled": spelled}
        for name, more in made.items():
            self._put(name, at, more)
        self._enter(at)

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words and ends of some texts, one after another; and how many each text has."""
        if self.held > REMEMBERED:
            self._forget()
        words = Words(texts, lower=True)
        hashed = words.hashes().view(np.int64)
        found = self._find(hashed)
        self.again[found] = True
        new = np.flatnonzero(found == 0)
        if len(new):
            keys, first, which = np.unique(hashed[new], return_index=True, return_inverse=True)
            raw, at = words.raw.tobytes(), new[first]
            found[new] = self.held + which
            self._learn([raw[x:y].lower() for x, y in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)], keys)
        numbers = np.zeros(len(found) + len(texts), dtype=np.int64)
        numbers[np.arange(len(found)) + words.doc] = found
        return numbers, words.counts + 1

    def windows(self, texts: list[bytes]) -> tuple[Windows, np.ndarray, np.ndarray]:
        """Windows over the first subwords of the texts; the numbers of their words and ends; how many each text has."""
        numbers, n = self.numbers(texts)
        return Windows(self.code[numbers], n, END, TEXT_WINDOW), numbers, n


_HELD: dict[str, WordTable] = {}


def table_of(reader: Reader, counts: WordCounts | None = None, spelling: Attention | None = None) -> WordTable:
    """The worker's table for ``reader``, kept from task to task; of the last reader only."""
    name = f"{reader.name} {'scoring' if counts else 'training'}"
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = WordTable(reader, counts, spelling)
    return _HELD[name]


# --- corpus statistics -------------------------------------------------------------------------------------------


def count_words(texts: DataFrame) -> DataFrame:
    """``hash, word, times`` of all distinct words of ``texts`` (one column), A-Z lower-cased; counts combine before and after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"hash": [], "word": [], "times": []}
        for batch in batches:
            texts = common.as_bytes(batch.column(0))
            for a, b in common.slices(texts):
                words = Words([t.lower() for t in texts[a:b]])
                hashes = words.hashes()
                order = np.argsort(hashes)  # any occurrence of a word will do, so the sort needn't be stable
                ranked = hashes[order]
                edge = np.flatnonzero(np.concatenate((np.ones(min(len(ranked), 1), dtype=bool), ranked[1:] != ranked[:-1])))
                keys, first, times = ranked[edge], order[edge], np.diff(np.append(edge, len(ranked)))
                raw = words.raw.tobytes()
                held["hash"].append(keys.view(np.int64))
                held["times"].append(times)
                held["word"] += [raw[x:y] for x, y in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
            if len(held["word"]) > 200_000:
                yield counted(held)
        yield counted(held)

    def counted(held: dict[str, list]) -> pa.RecordBatch:
        """One row a word of what is held."""
        keys, first, which = np.unique(np.concatenate([*held["hash"], np.zeros(0, dtype=np.int64)]), return_index=True, return_inverse=True)
        times = np.bincount(which, weights=np.concatenate([*held["times"], np.zeros(0, dtype=np.int64)]), minlength=len(keys)).astype(np.int64)
        words = [held["word"][i] for i in first.tolist()]
        for x in held.values():
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int64())], names=["hash", "word", "times"])

    return common.map_batches(texts, run, "hash bigint, word binary, times bigint").groupBy("hash", "word").agg(F.sum("times").alias("times"))


def frequent_words(counts: DataFrame, ends: int, most: int = FREQUENT) -> tuple[WordCounts, int]:
    """The counts of at most ``most`` words, all those seen at least as often as the returned bound."""
    # at most a few hundred steps: exact below 64, then by quarter powers of two
    step = F.when(F.col("times") < 64, F.col("times")).otherwise(F.floor(F.pow(2.0, F.floor(F.log2("times") * 4) / 4)))
    table = sorted(((r[0], r[1], r[2]) for r in counts.groupBy(step.cast("bigint").alias("step")).agg(F.count("*"), F.sum("times")).collect()), reverse=True)
    tokens, distinct = sum(t[2] for t in table) + ends, sum(t[1] for t in table) + (ends > 0)
    bound, held = 1 << 62, 0
    for low, n, _ in table:
        if held + n > most:
            break
        bound, held = low, held + n
    rows = counts.filter(step >= bound).select("hash", "times").toPandas().sort_values("hash")  # at most `most` rows
    return WordCounts(rows["hash"].to_numpy(dtype=np.int64), rows["times"].to_numpy(dtype=np.int64), int(tokens), int(distinct), ends), bound


def count_ids(counts: DataFrame, path: str) -> np.ndarray:
    """By id, from all distinct words: occurrences as a word's first subword; words that begin with it; of those, seen once; and its places further inside words."""
    size = bpe(path).max_token_value + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path)
        total = np.zeros((4, size), dtype=np.int64)
        for batch in batches:
            ids, n = encoded(encoder, batch.column(0).to_pylist())
            if not len(n):
                continue
            times, begin = batch.column(1).to_numpy(), np.cumsum(n) - n
            first, inner = ids[begin], np.delete(ids, begin)
            np.add.at(total[0], first, times)
            for row, some in ((1, first), (2, first[times == 1]), (3, inner)):
                total[row] += np.bincount(some, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total.ravel()[some], pa.int64())], names=["cell", "times"])

    found = np.zeros(4 * size, dtype=np.int64)
    rows = common.map_batches(counts.select("word", "times"), run, "cell bigint, times bigint").groupBy("cell").agg(F.sum("times")).collect()  # at most four times the vocabulary
    for cell, times in rows:
        found[cell] = times
    return found.reshape(4, size)


def train(model: Attention, rows: DataFrame, windows: Callable[[pa.Array], Iterator[Windows]]) -> None:
    """One round of ``model`` over all ``rows`` (one column), which ``windows`` turns into windows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        """A row a slice: its counts, of which many are 0 or small, compressed before they leave Python."""
        size, raw = [x.nbytes for x in sums.values()], [pa.compress(x.tobytes(), codec="lz4", asbytes=True) for x in sums.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(size, pa.int32()), pa.array(raw, pa.binary())], names=["slice", "size", "counts"])

    def unpacked(size: int, raw: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(raw, size, codec="lz4", asbytes=True), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value.ready(), None
        for batch in batches:
            for made in windows(batch.column(0)):
                total = own.expected(made, total)
        if total is not None:
            cut = dict(enumerate(np.array_split(total.astype(np.int64), SLICES)))
            yield packed(cut)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, size, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = unpacked(size, raw)
                sums[i] = sums[i] + x if i in sums else x
        yield packed(sums)

    schema = "slice int, size int, counts binary"
    found = common.map_batches(common.map_batches(rows, run, schema).repartition("slice"), add, schema).collect()  # the model's size
    shared.unpersist()
    if found:
        model.update(np.concatenate([unpacked(*r[1:]) for r in sorted(found)]).astype(np.float64))


def fit(docs: DataFrame, counts: DataFrame, ends: int, path: str, id_col: str, text_col: str, rounds: int = ROUNDS) -> tuple[Reader, Attention, Attention]:
    """The reader, the model of texts and that of words, from all training documents ``docs``, of which there are ``ends``, and their word ``counts``."""
    import uuid

    encoder = bpe(path)
    times, words, once, inner = count_ids(counts, path)
    firsts, inside = symbols(times, times, ends, encoder), symbols(words + inner, inner, float(words.sum()), encoder)
    by_symbol = [np.bincount(firsts.code, weights=x, minlength=SYMBOLS) for x in (times, once)]
    reader = Reader(path, uuid.uuid4().hex, firsts, inside, *by_symbol)
    text, word = Attention(TEXT_WINDOW, firsts.share), Attention(WORD_WINDOW, inside.share)

    def of_words(column: pa.Array) -> Iterator[Windows]:
        found = column.to_pylist()
        if found:
            yield reader.spelling(*encoded(bpe(path), found))

    def of_texts(column: pa.Array) -> Iterator[Windows]:
        texts, table = common.as_bytes(column), table_of(reader)
        for a, b in common.slices(texts, common.FINE_BYTES):
            yield table.windows(texts[a:b])[0]

    texts = F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    deal = F.pmod(F.xxhash64(F.lit("lm"), F.col(id_col)), F.lit(rounds))
    for r in range(rounds):
        train(word, counts.filter(F.pmod("hash", F.lit(rounds)) == r).select("word"), of_words)
    for r in range(rounds):
        train(text, docs.filter(deal == r).select(texts), of_texts)
    return reader, text, word


def scored(docs: DataFrame, training: Column, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs``.

    ``training``: which rows teach, by ``id_col``. Tokens are the words with A-Z
    lower-cased, and one end; n_known: those seen in training; base_score: the
    add-half unigram's log10 probability; score: the attention model's, of the same
    words as subwords and the end. A null or empty text is one end. Texts of any
    length are scored whole, in windows. Null ids and repeated rows (which teach as
    often as they come) are scored like others; equal texts score alike; other columns,
    whatever their names, aren't read. An empty table gives no rows. With no training
    rows every count is 0 and the model keeps its initial parameters.
    """
    spark = docs.sparkSession
    teach = docs.filter(training).select(id_col, text_col)
    counts = common.stored(count_words(teach.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"))), "words")
    total = teach.count()
    known, bound = frequent_words(counts, total)
    shared = spark.sparkContext.broadcast((*fit(teach, counts, total, path, id_col, text_col), known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        reader, model, spelling, counts = shared.value
        model.ready()
        table = table_of(reader, counts, spelling.ready())
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = common.as_bytes(batch.column(1))
            for a, b in common.slices(texts, common.FINE_BYTES):
                windows, numbers, n = table.windows(texts[a:b])
                first = np.cumsum(n) - n
                log_p = model.log_probs(windows).sum(axis=1)
                score = np.add.reduceat(log_p, np.cumsum(windows.blocks) - windows.blocks) + np.add.reduceat(table.own[numbers], first)
                rare = table.rare[numbers]
                base = np.add.reduceat(table.base[numbers], first) + counts.log10(counts.ends)
                unmet = np.add.reduceat(rare.astype(np.int64), first)
                familiar = n - 1 - unmet + (counts.ends > 0)
                which, begin = numbers[rare], np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(unmet).astype(np.int32)))
                one = pa.StructArray.from_arrays([pa.array(table.hash[which]), pa.array(table.scale[which]), pa.array(table.spelled[which])], names=["hash", "scale", "spelled"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + b - a)), batch.column(0)[a:b], pa.array(n), pa.array(familiar), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(begin), one)],
                    names=["row", id_col, "n_tokens", "known", "base", "score", "rare"],
                )
                row += b - a

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row bigint, `{id_col}` {kind}, n_tokens bigint, known bigint, base double, score double, rare array<struct<hash: bigint, scale: float, spelled: float>>"
    rows = common.stored(common.map_batches(docs.select(id_col, text_col), run, schema), "scores")
    unseen = float(known.log10(0))
    rest = (counts.filter(F.col("times") < bound) if bound < 1 << 62 else counts).select("hash", "times")
    base = F.coalesce(F.log10((F.col("times") + 0.5) / F.lit(known.tokens + 0.5 * (known.distinct + 1))), F.lit(unseen))
    spelled = F.col("spelled").cast("double")
    own = F.when(F.col("times").isNull(), spelled).otherwise(F.log(F.col("times") * F.col("scale").cast("double") + F.exp(spelled)))
    met = rows.select("row", F.inline("rare")).join(rest, "hash", "left")
    extra = met.groupBy("row").agg(F.sum(base).alias("more"), F.sum(own).alias("words"), F.count("times").alias("met"))
    return rows.drop("rare").join(extra, "row", "left").select(
        id_col,
        "n_tokens",
        (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        ((F.col("score") + F.coalesce("words", F.lit(0.0))) / F.lit(float(np.log(10)))).alias("score"),
    )
