"""Structure statistics of whole texts, over many texts at once."""

from __future__ import annotations

import numpy as np

from .wordhash import Words, windows

_WHITE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"

#: Classes of bytes that ``byte_shares`` counts.
_CLASSES = {"upper": bytes(range(65, 91)), "digit": b"0123456789", "pipe": b"|", "mark": b"!?", "symbol": b"#*$%&<>{}[]\\^~@_=+", "stop": b".,;:", "line": b"\n", "high": bytes(range(128, 256))}


def repeated_words(words: Words, hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Words of each text that lie in a ``k``-word window which the text has twice or more."""
    found, at = windows(hashes, words.doc, k)
    n = len(words.counts)
    if not len(found):
        return np.zeros(n, dtype=np.int64)
    owner = words.doc[at]
    order = np.lexsort((found, owner))
    same = (found[order][1:] == found[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(found), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    marks = np.zeros(len(hashes) + k + 1, dtype=np.int64)
    starts = at[twice]
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + k, -1)
    covered = np.cumsum(marks)[: len(hashes)] > 0
    return np.bincount(words.doc[covered], minlength=n).astype(np.int64)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars (code points), n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = Words(texts)
    inked = [t.translate(None, _WHITE) for t in texts]
    continuation = bytes(range(128, 192))
    return {
        "n_words": words.counts,
        "word_chars": np.array([len(x.translate(None, continuation)) for x in inked], dtype=np.int64),
        "n_symbols": np.array([sum(map(x.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))) for x in inked], dtype=np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], dtype=np.int64),
        "n_repeat_words": repeated_words(words, words.hashes()),
    }


def byte_shares(texts: list[bytes]) -> np.ndarray:
    """Share of each byte class in each text; zero for an empty text."""
    out = np.zeros((len(texts), len(_CLASSES)))
    for i, t in enumerate(texts):
        if t:
            seen = np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256)
            out[i] = [seen[list(c)].sum() / len(t) for c in _CLASSES.values()]
    return out
