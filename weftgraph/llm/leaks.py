"""Evaluation texts inside training texts: template windows, hash join, slot consistency.

A *word* is a maximal run of letters and digits in the NFKC-normalised lower-case text.  Words with a digit, units
of measure and given names are slots: canonicalisation puts a typed placeholder in their place, so that windows of
``words`` consecutive words match even where a question was asked again with other values.  The windows of items and
documents are tables joined by their hash.  A pair that meets is then compared over the item's own words: it is
*verbatim* if all of a stretch agree, and *re-parameterised* if the slots of the whole matched stretch agree under a
consistent one-to-one renaming of values.

Sets of words and windows travel to the tasks as bit tables of a fixed size (`BitTable`), however large the sets are.
A word wrongly taken for a name or unit is so in items and documents alike, so nothing is lost by it; a window wrongly
let through finds no partner in the join.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import array, column, map_batches, record
from weftgraph.llm.shingles import chunks, code_points, mix, powers
from weftgraph.sources import small_side, stage

_U = np.uint64

#: Words that are no slots which a window needs to be matched as a template.
LITERALS = 4
_NUMBER, _UNIT, _NAME = _U(0x6E756D), _U(0x756E6974), _U(0x6E616D65)
#: Bits of a bit table, as a power of two (8 MB), and of the bitmaps it is collected in.
TABLE_BITS, _MAP_BITS = 26, 15
#: A unit of measure stands behind a number at least so often, and in at least such a share of its places, in the items.
UNIT_PLACES, UNIT_SHARE = 2, 0.8

_word_points: list[np.ndarray] = []


def _letters_and_digits() -> np.ndarray:
    """For every code point whether it is a letter or digit (made once a process)."""
    if not _word_points:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalnum()]] = True
        _word_points.append(table)
    return _word_points[0]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, whether each has a digit, the index of each text's first word and one more at the end)."""
    plain = [(t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).lower()) if t else "" for t in texts]
    chars, starts = code_points(plain)
    inside = _letters_and_digits()[chars]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(chars) + 1)
    total = np.zeros(len(chars) + 1, _U)
    np.cumsum(mix(chars.astype(_U) + _U(1)) * up[:-1], out=total[1:])
    digits = np.concatenate(([0], np.cumsum((chars >= 48) & (chars <= 57))))
    return mix((total[end] - total[first]) * down[first]), digits[end] > digits[first], np.searchsorted(first, starts)


class BitTable:
    """A set of 64-bit hashes as one bit each of a table of fixed size: what is in the set is never denied."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def of(hashes: DataFrame) -> BitTable:
        """hashes (h long) -> its table, put together in the cluster; at most 2**(TABLE_BITS - _MAP_BITS) bitmaps of 4 KB
        are collected."""
        place = F.col("h").bitwiseAND(F.lit((1 << TABLE_BITS) - 1).cast("long"))
        rows = hashes.where("h is not null").select(F.shiftright(place, _MAP_BITS).alias("map"), place.bitwiseAND(F.lit((1 << _MAP_BITS) - 1).cast("long")).alias("bit"))
        table = np.zeros((1 << (TABLE_BITS - _MAP_BITS), 1 << (_MAP_BITS - 3)), np.uint8)
        for row in rows.groupBy("map").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect():
            table[row["map"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
        return BitTable(table.ravel())

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & _U((1 << TABLE_BITS) - 1)
        return (self.bits[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1


def templates(hashes: np.ndarray, digit: np.ndarray, units: BitTable, names: BitTable) -> tuple[np.ndarray, np.ndarray]:
    """The words with placeholders for slots, and which of them are slots."""
    out = np.where(digit, _NUMBER, hashes)
    out = np.where(units.holds(hashes) & ~digit, _UNIT, out)
    out = np.where(names.holds(hashes) & ~digit, _NAME, out)
    return out, out != hashes


def window_hashes(values: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` values within a text, and the index of each one's first value."""
    kept = np.maximum(np.diff(starts) - size + 1, 0)
    at = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(kept, out=at[1:])
    index = np.arange(at[-1]) + np.repeat(starts[:-1] - at[:-1], kept)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(mix(values + _U(11)) * up[:-1], out=total[1:])
    return mix((total[index + size] - total[index]) * down[index]), index


def window_keys(hashes: np.ndarray, template: np.ndarray, slots: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys windows are joined by: the template's hash, or that of the words themselves where fewer than LITERALS
    words of the window are no slots (a row of numbers says nothing without its values). Equal words give equal slots,
    so a verbatim window has the same key on both sides either way."""
    keys, first = window_hashes(template, starts, size)
    literal = np.concatenate(([0], np.cumsum(~slots)))
    bare = literal[first + size] - literal[first] < LITERALS
    if bare.any():
        keys = np.where(bare, mix(window_hashes(hashes, starts, size)[0] + _U(1)), keys)
    return keys, first


class _Item:
    """An item with the hashes of its template windows, sorted."""

    def __init__(self, text: str, size: int, units: BitTable, names: BitTable):
        self.size = size
        self.hashes, digit, starts = words([text])
        template, slots = templates(self.hashes, digit, units, names)
        keys, first = window_keys(self.hashes, template, slots, starts, size)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first = keys[order], first[order]


def _consistent(item: np.ndarray, other: np.ndarray) -> bool:
    """Whether the two sequences of slot values agree under a one-to-one renaming."""
    pairs = set(zip(item.tolist(), other.tolist()))
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def _word_hashes(texts: DataFrame) -> DataFrame:
    """(text) -> (h, behind): the hash of every word without a digit, and whether it stands behind one with a digit."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, digit, starts = words(column(batch, "text"))
        behind = np.zeros(len(digit), bool)
        behind[1:] = digit[:-1]
        inner = starts[:-1][starts[:-1] < len(digit)]
        behind[inner] = False
        return record(h=hashes[~digit].view(np.int64), behind=behind[~digit])

    return map_batches(texts.where("text is not null").select("text"), work, "h long, behind boolean")


def learnt_units(items: DataFrame) -> DataFrame:
    """items (text) -> (h): the hashes of the words that stand behind numbers in most of their places."""
    counted = _word_hashes(items).groupBy("h").agg(F.count("*").alias("n"), F.count_if("behind").alias("k"))
    return counted.where((F.col("k") >= UNIT_PLACES) & (F.col("k") >= UNIT_SHARE * F.col("n"))).select("h")


def window_rows(texts: DataFrame, name: str, size: int, units: BitTable, names: BitTable, among: BitTable | None = None) -> DataFrame:
    """(name, text) -> (key, name): the keys of the template windows, those in ``among`` only if given."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, texts_, out = array(batch, name), column(batch, "text"), []
        for a, b in chunks(texts_):
            hashes, digit, starts = words(texts_[a:b])
            template, slots = templates(hashes, digit, units, names)
            keys, first = window_keys(hashes, template, slots, starts, size)
            if among is not None:
                kept = among.holds(keys)
                keys, first = keys[kept], first[kept]
            out.append((keys, ids[a + np.searchsorted(starts, first, "right") - 1]))
        keys, owners = (np.concatenate(x) for x in zip(*out))
        return record(key=keys.view(np.int64), **{name: owners.astype(np.int64)})

    return map_batches(texts, work, f"key long, {name} long")


def leaks(documents: DataFrame, items: DataFrame, size: int = 13, names: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """documents (id, text) and items (item_id, item_text) -> (id, item_id, kind, n_words): one row per document, item
    and kind of match, ``verbatim`` or ``parameters``; n_words is the longest stretch of the item so matched.

    ``names`` (text) are the given names, ``units`` (text) the units of measure; without the latter they are learnt from
    the items. Null ids and null texts take no part; an id given twice with different texts has the matches of both;
    items of fewer than ``size`` words cannot match. A document that leaks verbatim has a ``parameters`` row too only
    where a longer stretch matches that way.
    """
    spark = documents.sparkSession
    asked = items.where("item_id is not null and item_text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("item_text").alias("text")).distinct()
    texts = documents.where("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), "text")
    given_names = BitTable.of(spark.createDataFrame([], "h long") if names is None else _word_hashes(names).select("h"))
    given_units = BitTable.of(learnt_units(asked) if units is None else _word_hashes(units).select("h"))
    of_items = stage(window_rows(asked, "item_id", size, given_units, given_names).distinct())
    among = BitTable.of(of_items.select(F.col("key").alias("h")))
    met = window_rows(texts, "id", size, given_units, given_names, among).join(small_side(of_items), "key")
    pairs = stage(met.select("id", "item_id").distinct())
    there = texts.join(small_side(stage(pairs.select("id").distinct())), "id", "left_semi")
    both = pairs.join(there, "id").join(asked.withColumnRenamed("text", "item_text"), "item_id")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        item = lru_cache(maxsize=1_000)(lambda text: _Item(text, size, given_units, given_names))
        ids, asked_ids, out = array(batch, "id"), array(batch, "item_id"), []
        for i, (text, item_text) in enumerate(zip(column(batch, "text"), column(batch, "item_text"))):
            out += [(int(ids[i]), int(asked_ids[i]), kind, n) for kind, n in _matches(text, item(item_text), given_units, given_names).items()]
        if not out:
            return None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32())
        return record(**{k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(zip(("id", "item_id", "kind", "n_words"), kinds))})

    found = map_batches(both.select("id", "item_id", "text", "item_text"), work, "id long, item_id long, kind string, n_words int")
    return found.groupBy("id", "item_id", "kind").agg(F.max("n_words").alias("n_words"))


def _matches(text: str, item: _Item, units: BitTable, names: BitTable) -> dict[str, int]:
    """The longest stretch of the item in the text by kind of match."""
    hashes, digit, starts = words([text])
    template, slots = templates(hashes, digit, units, names)
    keys, first = window_keys(hashes, template, slots, starts, item.size)
    low, high = np.searchsorted(item.keys, keys, "left"), np.searchsorted(item.keys, keys, "right")
    best: dict[str, int] = {}
    diagonals: dict[int, list[int]] = {}
    for h in np.flatnonzero(high > low):
        for w in range(low[h], high[h]):
            diagonals.setdefault(int(first[h] - item.first[w]), []).append(int(first[h]))
    for shift, places in diagonals.items():
        places = sorted(set(places))
        start = previous = places[0]
        for p in [*places[1:], None]:
            if p is not None and p == previous + 1:
                previous = p
                continue
            _stretch(hashes, slots, item, start, previous + item.size, shift, best)
            if p is not None:
                start = previous = p
    return best


def _stretch(hashes: np.ndarray, slots: np.ndarray, item: _Item, a: int, b: int, shift: int, best: dict[str, int]) -> None:
    ours, theirs = hashes[a:b], item.hashes[a - shift : b - shift]
    same = np.concatenate(([0], (ours == theirs).view(np.int8), [0]))
    edge = np.diff(same)
    longest = int((np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)).max(initial=0))
    if longest >= item.size:
        best["verbatim"] = max(best.get("verbatim", 0), longest)
    if b - a > longest:
        slot = slots[a:b]
        if _consistent(theirs[slot], ours[slot]):
            best["parameters"] = max(best.get("parameters", 0), b - a)
