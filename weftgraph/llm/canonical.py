"""Mapping free-entered values to a canonical list: token-level repair, then soft TF-IDF over whole entries.

The entries' tokens are the reference vocabulary.  Every distinct token of the forms is repaired once against it:
by edit distance (insertions, deletions, substitutions and swaps of neighbours), as an abbreviation written with a
full stop, or, where several words were written as one, by cutting it into vocabulary words.  Tokens meet the
vocabulary in joins: over shortened forms (two words within k edits have a form in common that is shortened by at most
k letters on either side), prefixes and substrings, so neither side's size is bounded.  The repaired tokens are joined
with the entries that hold them, and entries are ranked by soft TF-IDF; a form whose best entries name different nodes,
or whose best entry scores too low, is reported as unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.arrow import column, map_batches, record
from weftgraph.sources import stage

UNMATCHED = "UNMATCHED"

# Words that say what kind of thing a term is, not which one, unless the caller names others.
GENERIC = ("the", "a", "an", "protocol", "mechanism", "feature", "procedure", "process", "function", "协议", "机制", "功能", "过程", "流程", "特性")

_TOKEN = re.compile(r"[a-z0-9]+\.?|[^\W\da-z_]+")
_VERSION = re.compile(r"v?\d+")


@dataclass(frozen=True)
class Matching:
    """``least_score`` is the least soft TF-IDF of an accepted entry, ``margin`` what the best node must be ahead by.

    A word that occurs with one node only names it, and is repaired with care: by one edit from ``one_edit_name``
    letters, by two from ``two_edits_name``, never by two substitutions, nor by a substitution and a letter more or
    less if it begins otherwise. Words shared by nodes are repaired from ``one_edit`` and ``two_edits`` letters. What
    a token is repaired to depends on it and the entries alone, never on how often it stands in the forms."""

    least_score: float = 0.76
    margin: float = 0.02
    one_edit: int = 2
    two_edits: int = 4
    one_edit_name: int = 5
    two_edits_name: int = 6
    generic: tuple[str, ...] = GENERIC

    def allowed(self, word: str, name: bool) -> int:
        """Edits a vocabulary word may be away from a token."""
        if not word.isascii() or any(c.isdigit() for c in word):
            return 0
        one, two = (self.one_edit_name, self.two_edits_name) if name else (self.one_edit, self.two_edits)
        return 2 if len(word) >= two else 1 if len(word) >= one else 0


def form_tokens(form: str | None, generic: tuple[str, ...] = GENERIC) -> list[str]:
    """The tokens of a form: Latin words and digits (a full stop after one is kept), runs of other letters; generic
    words and version numbers are dropped unless nothing else is left."""
    every = _TOKEN.findall(unicodedata.normalize("NFKC", form or "").lower())
    out = []
    for token in every:
        if not token[0].isascii():
            for word in generic:
                if not word.isascii() and token.endswith(word) and len(token) > len(word):
                    token = token[: -len(word)]
            out.append(token)
        elif token.rstrip(".") not in generic and not _VERSION.fullmatch(token.rstrip(".")):
            out.append(token)
    return [t for t in out if t not in generic] or [t.rstrip(".") for t in every]


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or most + 1 if it is larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row, old = row, [i], before
        for j, y in enumerate(b, 1):
            cost = min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, old[j - 2] + 1)
            row.append(cost)
        before = previous
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _shortened(word: str, most: int) -> set[str]:
    return {"".join(word[i] for i in range(len(word)) if i not in cut) for n in range(most + 1) for cut in combinations(range(len(word)), n)}


def other_word(token: str, word: str, d: int) -> bool:
    """Whether a token ``d`` edits away from a name is rather another word than a slip."""
    # one letter replaced and one more or less, with another beginning (a swap of the first two is none)
    if d == 2 and abs(len(token) - len(word)) == 1 and token[0] != word[0] and token[1::-1] != word[:2]:
        return True
    # of equal length and two letters apart, unless a letter only moved
    replaced = d == 2 and len(token) == len(word) and sum(x != y for x, y in zip(token, word)) == 2
    return replaced and not _shortened(token, 1) & _shortened(word, 1)


def cut_apart(token: str, words: set[str]) -> list[str]:
    """The token cut into the fewest of the words (of at least three letters); empty if it cannot be."""
    sizes = sorted({len(w) for w in words if len(w) >= 3}, reverse=True)
    best: list[list[str] | None] = [[]] + [None] * len(token)
    for end in range(3, len(token) + 1):
        for size in sizes:
            if size <= end and best[end - size] is not None and token[end - size : end] in words:
                option = [*best[end - size], token[end - size : end]]
                if best[end] is None or len(option) < len(best[end]):
                    best[end] = option
    return best[-1] or []


def _rows(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    return record(**{k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})


def repairs(tokens: DataFrame, vocabulary: DataFrame, how: Matching) -> DataFrame:
    """Distinct tokens (token) and vocabulary (word, name), both staged -> (token, part, word, similarity): the words each
    token may be meant for (part 0), or the words it is made of; one row with a null word for a token without any."""
    text, longest = pa.string(), vocabulary.agg(F.max(F.length("word"))).first()[0] or 0
    plain = F.rtrim(F.col("token"), F.lit("."))
    asked = tokens.select("token", plain.alias("plain"))
    exact = asked.join(vocabulary, F.col("plain") == F.col("word")).select("token", F.lit(0).alias("part"), "word", F.lit(1.0).alias("similarity"))
    open_ = stage(asked.join(vocabulary, F.col("plain") == F.col("word"), "left_anti"))
    short = (F.col("token") != F.col("plain")) & (F.length("plain") >= 3)

    # abbreviations: words that begin so
    begins = vocabulary.where(F.length("word") >= 3).select("word", F.explode(F.sequence(F.lit(3), F.length("word"))).alias("n")).select("word", F.expr("substring(word, 1, n)").alias("plain"))
    abbreviated = open_.where(short).join(begins, "plain").select("token", F.lit(0).alias("part"), "word", F.lit(0.95).alias("similarity"))

    # slips: words with a shortened form in common, then the distance itself
    def shorten_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _rows([(s, w, n) for w, n in zip(column(batch, "word"), column(batch, "name")) for s in sorted(_shortened(w, how.allowed(w, n)))], short=text, word=text, name=pa.bool_())

    def shorten_tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _rows([(s, t, p) for t, p in zip(column(batch, "token"), column(batch, "plain")) for s in sorted(_shortened(p, 2 if len(p) > 2 else 1))], short=text, token=text, plain=text)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for token, plain_, word, name in zip(*(column(batch, c) for c in ("token", "plain", "word", "name"))):
            d = edits(plain_, word, how.allowed(word, name))
            if d <= how.allowed(word, name) and not (d and name and other_word(plain_, word, d)):
                out.append((token, word, 1 - d / max(len(plain_), len(word))))
        return _rows(out, token=text, word=text, similarity=pa.float64())

    latin = open_.where(~short & ~F.col("plain").rlike(r"[^\x00-\x7f]") & (F.length("plain") <= longest + 2))
    met = map_batches(latin, shorten_tokens, "short string, token string, plain string").join(map_batches(vocabulary, shorten_words, "short string, word string, name boolean"), "short")
    near = stage(map_batches(met.select("token", "plain", "word", "name").distinct(), measure, "token string, word string, similarity double"))
    best = near.groupBy("token").agg(F.max("similarity").alias("similarity"))
    slips = near.join(best, ["token", "similarity"]).select("token", F.lit(0).alias("part"), "word", "similarity")

    # several words in one: the vocabulary words that stand in it, put together without a gap
    found = stage(exact.union(abbreviated).union(slips))
    left = open_.join(found.select("token"), "token", "left_anti")

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens_ = zip(column(batch, "token"), column(batch, "plain"))
        return _rows([(t, p, w) for t, p in tokens_ for w in sorted({p[i : i + n] for n in range(3, longest + 1) for i in range(len(p) - n + 1)})], token=text, plain=text, word=text)

    def compose(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens_ = zip(column(batch, "token"), column(batch, "plain"), column(batch, "words"))
        return _rows([(t, i, w, 1.0) for t, p, held in tokens_ for i, w in enumerate(cut_apart(p, set(held)))], token=text, part=pa.int32(), word=text, similarity=pa.float64())

    inside = map_batches(left, pieces, "token string, plain string, word string").join(vocabulary.select("word"), "word").groupBy("token", "plain").agg(F.collect_set("word").alias("words"))
    every = stage(found.union(map_batches(inside, compose, "token string, part int, word string, similarity double")))
    none = tokens.join(every.select("token"), "token", "left_anti").select("token", F.lit(0), F.lit(None).cast("string"), F.lit(0.0))
    return every.union(none)


def map_to_canonical(forms: DataFrame, entries: DataFrame, how: Matching = Matching()) -> DataFrame:
    """forms (form) and entries (entry, node_id) -> one row per distinct form that is not null or blank:
    (form, node_id, score); node_id is UNMATCHED where no node is meant.

    Ties between entries of one node don't matter; a tie between nodes is reported as unmatched. Null or blank
    entries are ignored; with no entries every form is unmatched.
    """
    distinct = forms.select("form").where("form is not null and trim(form) <> ''").distinct()
    text = pa.string()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _rows([(form, i, t) for form in column(batch, "form") for i, t in enumerate(form_tokens(form, how.generic))], form=text, place=pa.int32(), token=text)

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for entry, node in zip(column(batch, "entry"), column(batch, "node_id")):
            listed = [t.rstrip(".") for t in form_tokens(entry, how.generic)]
            out += [(" ".join(listed), node, w) for w in sorted(set(listed))]
        return _rows(out, entry=text, node_id=text, word=text)

    tokens = stage(map_batches(distinct, cut, "form string, place int, token string"))
    listed = entries.where("entry is not null and node_id is not null").select("entry", "node_id").distinct()
    held = stage(map_batches(listed, words, "entry string, node_id string, word string").distinct())
    # a word that occurs with one node only is an entry of its own
    used = held.groupBy("word").agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("node_id"))
    vocabulary = stage(used.select("word", (F.col("n") == 1).alias("name")))
    held = stage(held.union(used.where("n = 1").select(F.col("word").alias("entry"), "node_id", "word")).distinct())
    repaired = repairs(stage(tokens.select("token").distinct()), vocabulary, how)
    nodes = max(1, held.agg(F.count_distinct("node_id")).first()[0])
    # a word is as telling as the number of nodes it occurs with is small
    idf = held.groupBy("word").agg((F.log(F.lit(nodes + 1.0) / F.count_distinct("node_id"))).alias("idf"))
    weighed = held.join(idf, "word")
    norm = weighed.groupBy("entry", "node_id").agg(F.sqrt(F.sum(F.col("idf") ** 2)).alias("norm"))
    weighed = stage(weighed.join(norm, ["entry", "node_id"]).select("entry", "node_id", "word", "idf", (F.col("idf") / F.col("norm")).alias("weight")))
    asked = tokens.join(repaired, "token").join(idf, "word", "left").withColumn("idf", F.coalesce("idf", F.log(F.lit(nodes + 1.0))))
    asked = stage(asked.select("form", "place", "part", "word", "similarity", "idf"))
    each = asked.groupBy("form", "place", "part").agg(F.max("idf").alias("idf"))
    length = each.groupBy("form").agg(F.sqrt(F.sum(F.col("idf") ** 2)).alias("length"))
    met = asked.where("word is not null").join(weighed.select("word", "entry", "node_id", "weight"), "word")
    met = met.groupBy("form", "entry", "node_id", "place", "part").agg(F.max(F.col("idf") * F.col("weight") * F.col("similarity")).alias("x"))
    scores = met.groupBy("form", "entry", "node_id").agg(F.sum("x").alias("x")).groupBy("form", "node_id").agg(F.max("x").alias("x"))
    scores = scores.join(length, "form").withColumn("score", F.col("x") / F.col("length"))
    order = Window.partitionBy("form").orderBy(F.desc("score"), "node_id")
    best = scores.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("n = 1")
    clear = (F.col("score") >= how.least_score) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= how.margin)
    out = distinct.join(best.select("form", "node_id", "score", clear.alias("clear")), "form", "left")
    return out.select("form", F.when(F.col("clear"), F.col("node_id")).otherwise(UNMATCHED).alias("node_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
