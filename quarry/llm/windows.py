"""Repeated windows over sequences of symbols (words or bytes), exactly.

A window of ``window`` symbols repeats only if its smallest-hash run of ``core``
symbols repeats at the same offset, so windows are handled in ranges that share
such a core (a minimizer). A range has two digests: that of its core, which all
its windows contain, and that of its span, the text that its windows cover:

* core seen once: no window of the range repeats;
* span seen twice or more: every window of the range repeats;
* else: the range is open and is split by longer cores, up to the window itself.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads the low bits of a polynomial hash."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 17)
        out = []
        for b in (base, pow(base, -1, 2 ** 64)):
            p = np.full(n, b, dtype=U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (out[0], out[1])
    return have


class Hashes:
    """Digests of any stretch of a symbol sequence, from prefix sums modulo 2^64."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        n = len(symbols)
        power, self.inverse = _powers(_BASES[which], n + 1)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(symbols * power[:n], out=self.sums[1:])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[at + length] - self.sums[at]) * self.inverse[at])


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U))[buf]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``buf`` and the words' offsets by text."""
    inside = ~_SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(buf)]
    first[cut] = inside[cut]  # a text does not run on into the next one
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_symbols(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = Hashes(byte_symbols(buf))
    return mix(h.of(starts, ends - starts) + (ends - starts).astype(U))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if width > span else x


def _aranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = int(counts.sum())
    if total == 0:
        return np.empty(0, dtype=np.int64)
    skip = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + skip


def ranges(symbols: np.ndarray, offsets: np.ndarray, window: int, core: int,
           only: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
    """(text, lo, hi, core digest, span digest) of all ranges of windows: window
    starts lo..hi of one text. ``only`` = (text, lo, hi) limits the windows."""
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, U),) * 2
    lens = np.diff(offsets)
    if only is None:
        text = np.flatnonzero(lens >= window)
        at, count = offsets[:-1][text], lens[text] - window + 1
    else:
        text, at, count = only[0], offsets[:-1][only[0]] + only[1], only[2] - only[1] + 1
    if not len(text) or len(symbols) < window:
        return none
    starts = _aranges(at, count)
    hashes = Hashes(symbols)
    cores = hashes.of(np.arange(len(symbols) - core + 1), core)
    bits = U(max(20, int(len(cores)).bit_length()))
    low = (U(1) << bits) - U(1)
    packed = (cores & ~low) | np.arange(len(cores), dtype=U)
    anchor = (_sliding_min(packed, window - core + 1)[starts] & low).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    if only is not None:  # neighbouring limits stay apart
        new[np.cumsum(count)[:-1]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, a = starts[first], starts[last], anchor[first]
    which = np.repeat(text, count)[first]
    length = hi - lo + window
    spans = mix(Hashes(symbols, 1).of(lo, length) + length.astype(U) * U(1 << 32) + (a - lo).astype(U))
    base = offsets[:-1][which]
    return which, lo - base, hi - base, cores[a], spans


def covered(n: int, lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    """Mask of the symbols under windows lo..hi."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + window, -1)
    return np.cumsum(edge[:-1]) > 0
