"""Words of many texts at once, as arrays over their UTF-8 bytes.

A word is a run of letters; bytes from 0x80 on count as letters.  Case is folded on
bytes, for ASCII and the Latin-1 letters, which keeps every position.  All hashes are
of whole words or of a few neighbouring bytes, and equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_WORD = np.zeros(256, dtype=bool)
_WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = _WORD[0x80:] = True
_WORD_OR_DIGIT = _WORD.copy()
_WORD_OR_DIGIT[ord("0") : ord("9") + 1] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_GAP = np.uint8(32)
#: Odd, so that powers have inverses modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Bytes that are hashed together, about; powers for these, kept.
_BLOCK = 1 << 16
_POWERS, _INVERSES = _powers(_BASE, 2 * _BLOCK), _powers(_BASE_INVERSE, 2 * _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts.

    ``starts`` and ``ends`` are byte positions in ``bytes`` (folded; texts are joined by
    gaps), ``doc`` the text's number of each word, ``text_starts`` where texts begin.
    """

    def __init__(self, texts: list[str], digits: bool = False) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        self.raw = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        own = _FOLD[self.raw]
        upper = (own[1:] >= 0x80) & (own[1:] <= 0x9E) & (own[1:] != 0x97) & (own[:-1] == 0xC3)
        own[1:][upper] += 32
        inside = (_WORD_OR_DIGIT if digits else _WORD)[own]
        self.bytes = np.where(inside, own, _GAP)
        self.inside = inside
        edges = np.diff(inside.view(np.int8))
        self.starts = np.flatnonzero(edges == 1) + 1
        self.ends = np.flatnonzero(edges == -1) + 1
        self.text_starts = 1 + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if raw else np.zeros(0, np.int64)
        self.n_texts = len(raw)
        firsts = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(np.append(firsts, len(self.starts)))
        self.firsts = firsts
        self.doc = np.repeat(np.arange(len(raw)), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the whole words.

        Of byte values times powers of an odd base, summed from the word's start, so
        that equal words have equal sums wherever they stand.
        """
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        out = np.empty(len(self.starts), np.uint64)
        step = np.searchsorted(self.starts, np.arange(0, len(self.bytes), _BLOCK))
        for a, b in zip(step, np.append(step[1:], len(self.starts)), strict=True):
            if a == b:
                continue
            lo, hi = int(self.starts[a]), int(self.ends[b - 1])
            n = hi - lo + 1
            # a word longer than a block makes a longer one
            kept = n <= len(_POWERS)
            powers, inverses = (_POWERS[:n], _INVERSES[:n]) if kept else (_powers(_BASE, n), _powers(_BASE_INVERSE, n))
            sums = np.zeros(n, np.uint64)
            weighted = (self.bytes[lo:hi].astype(np.uint64) + np.uint64(1)) * powers[1:]
            np.cumsum(weighted, dtype=np.uint64, out=sums[1:])
            begin, end = self.starts[a:b] - lo, self.ends[a:b] - lo
            out[a:b] = (sums[end] - sums[begin]) * inverses[begin]
        return mix(out)

    def code_points(self) -> np.ndarray:
        """For each byte position, the number of code points before it in its text's buffer."""
        heads = (self.raw & 0xC0) != 0x80
        return np.concatenate([[0], np.cumsum(heads)])


def grouped(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together (one text at least)."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
