"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ideographs counted as one token each.
IDEOGRAPH = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
#: White space as Python's str.split has it.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda a plain expression is computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_count(text: Column) -> Column:
    """Ideographs one each; what remains is split at white space. Null counts as 0."""
    words = F.filter(F.split(F.regexp_replace(text, IDEOGRAPH, " "), SPACE), lambda w: w != "")
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(IDEOGRAPH)) + F.size(words)).cast("int")


# Punctuation of Chinese text and what stands for it.
PUNCTUATION_FROM, PUNCTUATION_TO = "，。！？；：（）【】“”‘’、—–", ",.!?;:()[]\"\"'',--"


def nfkc(text: Column) -> Column:
    """Unicode NFKC: the one scalar Spark lacks, Arrow-batched; ASCII texts are handed through unchanged."""
    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return convert(text)


def normalize(text: Column, paragraphs: bool = False) -> Column:
    """NFKC, plain punctuation, white space collapsed, trimmed, lower case; with ``paragraphs`` blank lines stay as
    paragraph breaks and only blanks and tabs collapse. Null gives the empty text."""
    plain = F.replace(F.translate(nfkc(F.coalesce(text, F.lit(""))), PUNCTUATION_FROM, PUNCTUATION_TO), F.lit("…"), F.lit("..."))
    if not paragraphs:
        return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))
    broken = F.split(F.regexp_replace(plain, r"\n\s*\n", "\n\n"), "\n\n")
    kept = F.filter(F.transform(broken, lambda p: F.regexp_replace(F.regexp_replace(p, r"[ \t]+", " "), r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return F.lower(F.array_join(kept, "\n\n"))


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def truncate_words(text: Column, most: int) -> Column:
    """The first ``most`` words of a text without ideographs, joined by blanks; a shorter text stays as it is."""
    return F.when(F.size(words(text)) <= most, text).otherwise(F.array_join(F.slice(words(text), 1, most), " "))


def truncate(text: Column, most: int) -> Column:
    """Words of the text, joined by blanks, as long as they make up at most ``most`` tokens: a word with ideographs counts
    as many as it has of them, any other one. A text within the limit stays as it is."""

    def cut(w: Column) -> Column:
        size = lambda x: F.greatest(F.lit(1), F.regexp_count(x, F.lit(IDEOGRAPH)))
        # sums only grow, so the words within the limit are the first ones
        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct((acc["sum"] + size(x)).alias("sum"), (acc["n"] + (acc["sum"] + size(x) <= most).cast("int")).alias("n"))
        return F.array_join(F.slice(w, F.lit(1), F.aggregate(w, start, step, lambda acc: acc["n"])), " ")

    return F.when(token_count(text) <= most, text).otherwise(let(words(text), cut))


def sliding_windows(text: Column, window: int = 512, overlap: int = 64) -> Column:
    """Windows of words; consecutive ones share ``overlap`` words and the last ends with the text."""
    step = window - overlap

    def cut(w: Column) -> Column:
        n = F.size(w)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - window) / step).cast("int")))
        return F.when(n <= window, F.array(text)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i * step + 1, window), " ")))

    return let(words(text), cut)


# Words whose final s is no plural.
_KEPT = ("this", "that", "its", "has", "was", "his", "bus", "plus", "thus", "is", "as", "us", "yes", "dns", "qos")


def normalize_term(term: Column) -> Column:
    """The key candidates are grouped by: no parentheses, no leading article, lower case, hyphens as blanks except
    between two abbreviations, version marks split off, simple plurals reduced."""
    t = F.trim(F.regexp_replace(F.trim(term), r"\s*\([^)]*\)\s*", " "))
    t = F.regexp_replace(t, r"(?i)^(the|a|an)\s+", "")
    pair = r"^[A-Z][A-Z0-9]{0,5}-[A-Z][A-Z0-9]{0,5}$"
    plain = F.array_join(F.transform(words(t), lambda w: F.lower(F.when(w.rlike(pair), w).otherwise(F.replace(w, F.lit("-"), F.lit(" "))))), " ")
    split = F.transform(words(plain), lambda w: F.when(w.rlike(r"^v\d+$"), F.substring(w, 2, 99)).otherwise(F.regexp_replace(w, r"^(.+?)v(\d+)$", "$1 $2")))

    def singular(w: Column) -> Column:
        long_ = F.when(w.rlike("ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("ses$"), F.regexp_replace(w, "ses$", "s")).otherwise(F.regexp_replace(w, "([^s])s$", "$1"))
        short = F.when(w.rlike(r"^\p{L}+s$") & (F.length(w) >= 3), F.regexp_replace(w, "s$", "")).otherwise(w)
        return F.when(w.isin(*_KEPT) | F.contains(w, F.lit("-")), w).when(F.length(w) > 3, long_).otherwise(short)

    return F.array_join(F.transform(words(F.array_join(split, " ")), singular), " ")


def abbreviation(term: Column) -> Column:
    """The abbreviation in trailing parentheses, or null."""
    found = F.regexp_extract(term, r"\(([A-Za-z][A-Za-z0-9\-]{0,10})\)\s*$", 1)
    return F.when(found != "", found)


def token_set(text: Column) -> Column:
    """Distinct tokens for SimHash and Jaccard: ideographs, and lower-case runs of letters and digits of at least two."""
    return F.array_distinct(simhash_tokens(text))


def simhash_tokens(text: Column) -> Column:
    latin = F.filter(F.regexp_extract_all(text, F.lit("[a-zA-Z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1)
    return F.concat(F.regexp_extract_all(text, F.lit(IDEOGRAPH), F.lit(0)), F.transform(latin, lambda w: F.lower(w)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token sets; two empty sets are alike, an empty and a full one are not."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
