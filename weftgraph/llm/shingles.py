"""Vectorised tokens and shingles for the Arrow-batched operators of this subpackage.

A *token* is one ideograph or one maximal run of ``a-z0-9`` in the NFKC-normalised lower-case text.  All
functions work on a whole batch of texts at once: the batch becomes one array of code points, token hashes come
from prefix sums of a polynomial modulo 2**64 (the base is odd, so a window is shifted back by its inverse), and
no Python object is made per token.  Texts are cut into chunks of bounded size first, so that memory does not
depend on how many or how long the texts of an Arrow batch are (one text is never cut).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

#: Code points of one chunk handed to the array code; a single longer text makes a chunk of its own.
CHUNK_CHARS = 1_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

# The ideograph ranges counted as one token each.
IDEOGRAPHS = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for the process."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, _U), np.full(size, _BASE_INV, _U)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _powers[size]
    return up[:n], down[:n]


def canonical(text: str | None) -> str:
    """NFKC and lower case; null becomes the empty text."""
    if not text:
        return ""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def chunks(texts: Sequence[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` code points each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, each text followed by one 0; and where each text starts (one more entry at the end)."""
    chars = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return chars, starts


def tokens(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, and for each text the index of its first token (one more entry at the end)."""
    chars, starts = code_points([canonical(t) for t in texts])
    word = ((chars >= 97) & (chars <= 122)) | ((chars >= 48) & (chars <= 57))
    single = np.zeros(len(chars), bool)
    if len(chars) and chars.max() >= IDEOGRAPHS[0][0]:
        for a, b in IDEOGRAPHS:
            single |= (chars >= a) & (chars <= b)
    before = np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    after = np.empty_like(word)
    after[-1:], after[:-1] = False, word[1:]
    first = np.flatnonzero((word & ~before) | single)
    last = np.flatnonzero((word & ~after) | single) + 1
    up, down = powers(len(chars) + 1)
    total = np.zeros(len(chars) + 1, _U)
    np.cumsum(mix(chars.astype(_U) + _U(1)) * up[:-1], out=total[1:])
    hashes = mix((total[last] - total[first]) * down[first])
    return hashes, np.searchsorted(first, starts)


def shingle_hashes(texts: Sequence[str | None], k: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the sequences of k consecutive tokens of each text (repeats kept), the index of each text's first
    one, and each text's number of tokens.  A text of fewer than k tokens has none."""
    h, at = tokens(texts)
    count = np.diff(at)
    kept = np.maximum(count - k + 1, 0)
    starts = np.zeros(len(at), np.int64)
    np.cumsum(kept, out=starts[1:])
    index = np.arange(starts[-1]) + np.repeat(at[:-1] - starts[:-1], kept)
    value = np.zeros(len(index), _U)
    for i in range(k):
        value = mix(value * _U(0xD6E8FEB86659FD93) + h[index + i])
    return value, starts, count


def distinct(value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, ascending, and their starts."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(len(starts)))


def pair_jaccard(left: Sequence[str | None], right: Sequence[str | None], k: int = 3) -> np.ndarray:
    """The exact similarity of left[i] and right[i]; 0 where neither has a shingle."""
    out = np.zeros(len(left))
    sizes = [(len(a) if a else 0) + (len(b) if b else 0) for a, b in zip(left, right)]
    start = 0
    while start < len(left):
        end, size = start, 0
        while end < len(left) and (end == start or size + sizes[end] <= CHUNK_CHARS):
            size += sizes[end]
            end += 1
        n = end - start
        value, at, _ = shingle_hashes([*left[start:end], *right[start:end]], k)
        value, at = distinct(value, at)
        owner = np.repeat(np.arange(2 * n), np.diff(at)) % n
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        same = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
        both = np.bincount(owner[1:][same], minlength=n)
        every = np.bincount(owner, minlength=n) - both
        out[start:end] = np.divide(both, every, out=np.zeros(n), where=every > 0)
        start = end
    return out
