"""Word and shingle hashes of whole texts, vectorised over the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space, and all of ASCII that is no letter.
NOT_LETTERS = np.zeros(256, dtype=bool)
NOT_LETTERS[:128] = [not chr(i).isalpha() for i in range(128)]
#: Bytes of text that are hashed at once; a longer word is taken whole.
PIECE = 1 << 21
_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with good avalanche."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys, which are 0 or more; none without keys."""
    cuts = np.nonzero(np.diff(keys.astype(np.int64), prepend=-1))[0].tolist()
    return list(zip(cuts, [*cuts[1:], len(keys)], strict=True)) if cuts else []


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd step and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 1)
        inverse = pow(_STEP, -1, 1 << 64)
        _POWERS[:] = [_cumulative(_STEP, size), _cumulative(inverse, size)]
    return _POWERS[0], _POWERS[1]


def _cumulative(step: int, n: int) -> np.ndarray:
    out = np.full(n, step, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _words_of(data: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one piece of text."""
    space = breaks[data]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    power, inverse = _powers(len(data))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[_LOWER[data]] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(text: bytes, breaks: np.ndarray = _SPACE) -> np.ndarray:
    """A hash for each word of a text, with A-Z as a-z; the text is taken in pieces that end at white space."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= PIECE:
        return _words_of(data, breaks)[0]
    found, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not breaks[data[end]]:
            more = np.nonzero(breaks[data[end : end + PIECE]])[0]
            end += int(more[0]) if len(more) else min(PIECE, len(data) - end)
        found.append(_words_of(data[at:end], breaks)[0])
        at = end
    return np.concatenate(found)


def _chain(words: np.ndarray, n: int, size: int) -> np.ndarray:
    """A hash of each run of `size` words, n of them."""
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = mix(h * _U(0x9E3779B97F4A7C15) + words[k : k + n])
    return h


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of all words if there are fewer; none without words."""
    m = len(words)
    if not m:
        return np.zeros(0, np.uint64)
    return np.unique(_chain(words, 1, m) if m < size else _chain(words, m - size + 1, size))


def batch_shingles(texts: list[bytes], size: int, breaks: np.ndarray = _SPACE) -> Iterator[np.ndarray]:
    """shingles of each text, hashed for many texts at a time."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) < PIECE):
            total += len(texts[end]) + 1
            end += 1
        if end == at + 1:
            yield shingles(word_hashes(texts[at], breaks), size)
        else:
            data = np.frombuffer(b" ".join(texts[at:end]), dtype=np.uint8)
            words, starts = _words_of(data, breaks)
            cuts = np.cumsum([0] + [len(t) + 1 for t in texts[at:end]])
            bounds = np.searchsorted(starts, cuts)
            n = len(words) - size + 1
            runs = _chain(words, n, size) if n > 0 else None
            for i in range(end - at):
                a, b = bounds[i], bounds[i + 1]
                if b - a >= size:
                    yield np.unique(runs[a : b - size + 1])
                else:
                    yield shingles(words[a:b], size)
        at = end
