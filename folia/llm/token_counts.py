"""Token counts by the whole-token shortcut.

Offline, once in each worker, every vocabulary string is encoded by itself: those
that come back as one token are *whole*. A text is cut into pre-tokens; a whole
pre-token counts 1 with no merging, and only the rest go through the merges.
Pre-tokens are looked up as runs between single spaces, kept in a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Runs whose count a worker remembers; the table is emptied when full.
REMEMBERED = 250_000
#: A longer run isn't remembered.
LONGEST_REMEMBERED = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, reversed.

    Printable Latin-1 characters stand for themselves; the other bytes take, in
    order, the characters from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Counter(dict):
    """Tokens of a run ' word...': looked up, or made once by pre-tokens and merges."""

    def __init__(self, model: "ByteBpe"):
        super().__init__()
        self.model = model

    def __missing__(self, run: str) -> int:
        if not run or run[0].isspace() or run[-1].isspace():
            raise _OddSpace
        n = self.model.count_run(" " + run)
        if len(run) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[run] = n
        return n


class _OddSpace(Exception):
    """The text has white space other than single spaces between words, so runs can't be cut there."""


class ByteBpe:
    """Counts tokens exactly as the library gives them for a byte-level BPE file."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.merge = tiktoken.Encoding("folia", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks
        self.runs = _Counter(self)

    @cached_property
    def whole(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and encode alone as one token; proven when first asked for."""
        texts = []
        for raw in self.ranks:
            try:
                texts.append(raw.decode("utf-8"))
            except UnicodeDecodeError:
                continue
        return frozenset(t for t in texts if self.pattern.fullmatch(t) and len(self.pattern.findall(t)) == 1 and len(self.merge.encode_ordinary(t)) == 1)

    def count_run(self, text: str) -> int:
        """Tokens of a text without special strings: whole pre-tokens at once, the rest merged."""
        n = 0
        for piece in self.pattern.findall(text):
            n += 1 if piece in self.whole else len(self.merge.encode_ordinary(piece))
        return n

    def _count_plain(self, text: str) -> int:
        first, *rest = text.split(" ")
        last = rest.pop() if rest else "."
        if not first or first[-1].isspace() or not last or last[0].isspace():
            return self.count_run(text)
        try:
            return self.count_run(first) + sum(map(self.runs.__getitem__, rest)) + (self.count_run(" " + last) if len(last) + len(first) < len(text) else 0)
        except _OddSpace:
            return self.count_run(text)

    def count(self, text: str) -> int:
        """Tokens of ``text``; each special string inside it is one token, as by the library's default."""
        if not text:
            return 0
        if self.specials is None or not self.specials.search(text):
            return self._count_plain(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(self._count_plain(p) for p in parts if p)


@lru_cache(maxsize=4)
def model(path: str) -> ByteBpe:
    """One model a worker process and path."""
    return ByteBpe(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every text.

    ``path``: the tokenizer's file, where every worker can open it. Null text: 0
    bytes, 0 tokens. Null ids and repeated rows keep their rows; other columns
    are not read. Whole texts; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [bpe.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
