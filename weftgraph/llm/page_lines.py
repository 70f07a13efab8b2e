"""The lines of pages as arrays: generalised wording, shape, place and hashed features of a whole batch of texts at once.

Generalised wording is lower case, with the site's name as one sign and every number as one 0; a *word* is a run of
a-z, a number, or a single other letter or sign.  The decoration at a line's ends belongs to its look, not its words.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np

from weftgraph.llm.shingles import mix, powers

_U = np.uint64
#: Bits of a feature's slot.
BITS = 20
EDGE = "*-·•›»«‹<>|#←→_=~ \t\r　"
SITE = "\x01"
#: Shapes of a line, of its form only: in this order the first that fits.
SHAPES = ("row", "menu", "numbered", "step", "label", "sentence", "clause", "short", "phrase")
_DIGITS = re.compile(r"\d+")
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """For every code point: its kind (0 none, 1 Latin, 2 number, 3 a word of its own), whether it is white space, whether
    it is decoration (made once a process)."""
    if not _tables:
        kind, space, edge = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool), np.zeros(0x110000, bool)
        for i in range(0x110000):
            c = chr(i)
            if c.isspace():
                space[i] = True
            elif c != "_" and not 0xD800 <= i < 0xE000:
                kind[i] = 3 if not c.isdigit() else 2
        kind[97:123] = kind[1] = 1
        space[10] = False
        edge[[ord(c) for c in EDGE]] = True
        edge |= space
        _tables.update(kind=kind, space=space, edge=edge)
    return _tables[name]


def generalised(text: str, site: str | None) -> str:
    text = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()
    for part in re.split(r"[-_.]", (site or "").lower()):
        if len(part) > 3:
            text = text.replace(part, SITE)
    return _DIGITS.sub("0", text)


@dataclass
class Lines:
    """Lines that aren't blank: the number of the text, the line's number in it, its path and place (see `read`), and
    features as pairs (line, slot), each once."""

    text: np.ndarray
    line_no: np.ndarray
    path: np.ndarray
    place: np.ndarray
    feature_line: np.ndarray
    feature_slot: np.ndarray

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.feature_line, weights[self.feature_slot], len(self.text))


def _hash(tag: int, *values) -> np.ndarray:
    h = np.array([tag], _U)
    for v in values:
        h = mix(np.asarray(v).astype(_U) + h * _U(0xD6E8FEB86659FD93) + _U(1))
    return h


def _any_in(where: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted positions: how many lie in [start, end), the first and the last of them (-1 where none does)."""
    lo, hi = np.searchsorted(where, start), np.searchsorted(where, end)
    some = hi > lo
    padded = np.append(where, -1)
    return hi - lo, np.where(some, padded[np.where(some, lo, -1)], -1), np.where(some, padded[np.where(some, hi - 1, -1)], -1)


def read(texts: list[str | None], sites: list[str | None], first: list[bool]) -> Lines:
    """The lines of the texts; ``first`` tells the first part of a page.

    A *path* is a line's generalised container: its shape and the head of its wording. Its *place* is the coarser path:
    the part of the page, how near the line is to the part's top and end, the shapes of the line and its neighbours.
    """
    plain = [generalised(t or "", s) for t, s in zip(texts, sites)]
    chars = np.frombuffer(("\n".join(plain) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, space, edge = (_table(k)[chars] for k in ("kind", "space", "edge"))
    end = np.flatnonzero(chars == 10)
    start = np.concatenate(([0], end[:-1] + 1))
    per = np.array([t.count("\n") + 1 for t in plain])
    owner = np.repeat(np.arange(len(plain)), per)
    number = np.arange(len(start)) - np.repeat(np.cumsum(per) - per, per)
    below = np.repeat(per, per) - 1 - number
    newline = chars == 10
    _, bare_first, bare_last = _any_in(np.flatnonzero(~space & ~newline), start, end)
    inner, in_first, in_last = _any_in(np.flatnonzero(~edge & ~newline), start, end)
    has, length = inner > 0, np.where(inner > 0, in_last - in_first + 1, 0)

    # words, within the decoration
    inside = np.zeros(len(chars) + 1, np.int32)
    np.add.at(inside, in_first[has], 1)
    np.add.at(inside, in_last[has] + 1, -1)
    kind = np.where(np.cumsum(inside)[:-1] > 0, kind, 0)
    single, run = kind == 3, (kind == 1) | (kind == 2)
    before, after = np.concatenate(([0], kind[:-1])), np.concatenate((kind[1:], [0]))
    word_start = np.flatnonzero(single | (run & (kind != before)))
    word_end = np.flatnonzero(single | (run & (kind != after))) + 1
    up, down = powers(len(chars) + 1)
    total = np.zeros(len(chars) + 1, _U)
    np.cumsum(mix(chars.astype(_U) + _U(1)) * up[:-1], out=total[1:])
    word = mix((total[word_end] - total[word_start]) * down[word_start])
    at = np.searchsorted(word_start, np.append(start, len(chars)))
    n_words = np.diff(at)
    padded = np.append(word, np.zeros(3, _U))
    head = [np.where(n_words > i, padded[np.minimum(at[:-1] + i, len(word))], _U(0)) for i in range(3)]
    tail = [np.where(n_words > i, padded[np.maximum(at[1:] - 1 - i, 0)], _U(0)) for i in range(2)]

    # shape
    code = lambda where: np.where(where >= 0, chars[np.maximum(where, 0)], 0)
    among = lambda signs: np.isin(chars, [ord(c) for c in signs])
    count = lambda mask: np.searchsorted(np.flatnonzero(mask), end) - np.searchsorted(np.flatnonzero(mask), start)
    near = np.concatenate(([False], space[:-1])) & np.concatenate((space[1:], [False]))
    breaks = count(among("|»·•") | (among("/>›") & near))
    next_char = code(np.where(has & (in_first + 1 <= in_last), in_first + 1, -1))
    _, colon, _ = _any_in(np.flatnonzero(among(":：")), np.where(has, in_first, end), end)
    last = code(in_last)
    stop = np.isin(last, [ord(c) for c in ".。!?！？"])
    numbered = (code(in_first) == 48) & np.isin(next_char, [ord(c) for c in ".)、"])
    tests = [
        (code(bare_first) == 124) & (breaks > 2), (breaks >= 2) | (count(among("#")) >= 4), numbered & (length < 40), numbered,
        (colon - in_first >= 1) & (colon - in_first <= 24) & (colon >= 0), stop & ((length > 60) | (count(among("。")) > 1)), stop, length < 24,
    ]
    shape = np.select(tests, range(8), 8)

    keep = np.flatnonzero(bare_first >= 0)
    shown = np.full(len(start) + 2, 15)
    shown[1:-1][keep] = shape[keep]
    apart = np.flatnonzero(np.diff(owner)) + 1
    above_, below_ = shown[:-2].copy(), shown[2:].copy()
    above_[apart] = 15
    below_[apart - 1] = 15
    part, from_top, from_end = np.array([bool(x) for x in first])[owner].astype(int), np.minimum(number, 3), np.minimum(below, 3)
    path = _hash(1, shape, *head) >> _U(1)
    place = _hash(2, part, from_top, from_end, shape, above_, below_) >> _U(1)

    # features
    every = np.arange(len(start))
    kinds = [
        (every, _hash(3, np.zeros(len(every)))), (every, _hash(4, shape)), (every, _hash(5, np.minimum(n_words, 12))), (every, _hash(6, np.minimum(length // 20, 12))), (every, _hash(7, last)),
        (every, _hash(8, shape, from_top, part)), (every, _hash(9, shape, from_end)), (every, _hash(10, np.where(np.isin(code(bare_first), [ord(c) for c in EDGE]), code(bare_first), 0))),
        (every, _hash(11, np.where(np.isin(code(bare_last), [ord(c) for c in EDGE]), code(bare_last), 0))), (every, _hash(12, tail[0], tail[1])), (every, _hash(20, shape, above_)), (every, _hash(21, shape, below_)), (every, _hash(22, place)), (every, _hash(13, head[0])), (every, _hash(14, head[0], head[1])), (every, _hash(15, *head)),
    ]
    long_, named = np.flatnonzero(n_words > 40), np.flatnonzero(count(chars == ord(SITE)) > 0)
    kinds += [(long_, _hash(16, np.zeros(len(long_)))), (named, _hash(17, np.zeros(len(named))))]
    of_word = np.repeat(every, n_words)
    kinds.append((of_word, _hash(18, word)))
    pairs = np.flatnonzero(of_word[1:] == of_word[:-1])
    kinds.append((of_word[pairs], _hash(19, word[pairs], word[pairs + 1])))
    line, slot = np.concatenate([x for x, _ in kinds]), np.concatenate([h for _, h in kinds]) & _U((1 << BITS) - 1)
    to = np.full(len(start), -1)
    to[keep] = np.arange(len(keep))
    line = to[line]
    both = np.unique((line[line >= 0].astype(np.int64) << BITS) | slot[line >= 0].astype(np.int64))
    return Lines(owner[keep], number[keep].astype(np.int32), path[keep].astype(np.int64), place[keep].astype(np.int64), both >> BITS, both & ((1 << BITS) - 1))
