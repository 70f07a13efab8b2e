"""Splitting documents into segments.

A document is one row, so the order-dependent parts (heading stack, merging up to a size, packing sentences) run
inside the row, Arrow-batched and without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_TOKENS, MOST_TOKENS, SENTENCE_TARGET, OVERLAP = 15, 1024, 512, 64

# What a heading looks like, and words that open a new topic.
_MARKDOWN = re.compile(r"(#{1,4})\s+(.+)")
_NUMBERED = re.compile(r"(\d+(?:\.\d+)*)\.?\s+([A-Z].*)")
_CAPITALS = re.compile(r"[A-Z][A-Z \-]{4,}")
_TURNS = re.compile(
    r"(?:however|therefore|in contrast|furthermore|on the other hand|as a result|in conclusion|for example|note that|importantly|conversely|similarly|moreover|nevertheless|in addition|in summary|consequently|meanwhile|alternatively)\b",
    re.I,
)
_IDEOGRAPH = re.compile(r"[㐀-䶿一-鿿]")
# The types a classifier may give; noise is dropped.
TYPES = (
    "definition", "mechanism", "scenario", "config", "procedure", "prerequisite", "constraint", "compatibility", "best_practice",
    "performance", "comparison", "fault", "troubleshooting", "table", "code", "noise", "unknown",
)


def count_tokens(text: str) -> int:
    return len(_IDEOGRAPH.findall(text)) + len(_IDEOGRAPH.sub(" ", text).split())


def sections(text: str) -> list[tuple[list[str], str, str]]:
    """(section path, section title, text) of the parts between headings: # marks, else numbered or capital headings
    (any white space after the number), else blocks between form feeds or two blank lines."""
    lines = text.split("\n")
    if any(_MARKDOWN.match(x) for x in lines):
        level_of = lambda m: len(m[1])
        find = _MARKDOWN.match
    elif any(_NUMBERED.match(x) or _CAPITALS.fullmatch(x) for x in lines):
        lines = [x for x in lines if "\f" not in x]
        level_of = lambda m: m[1].count(".") + 1
        find = _NUMBERED.match
    else:
        blocks = text.split("\f") if "\f" in text else re.split(r"\n{3,}", text)
        return [([], b.strip().split("\n", 1)[0].strip()[:80], b.strip()) for b in blocks if b.strip()]
    out, path, title, held = [], [], "", []

    def close() -> None:
        body = "\n".join(held).strip()
        if body:
            out.append((list(path), title, body))
        held.clear()

    for line in lines:
        m, bare = find(line), line.strip()
        if m:
            close()
            title = m[2].strip()
            path = [*path[: level_of(m) - 1], title]
        elif find is not _MARKDOWN.match and _CAPITALS.fullmatch(bare):
            close()
            title = bare.title()
            path = [title]
        else:
            held.append(line)
    close()
    return out


def paragraphs(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]


def windows(text: str, window: int = SENTENCE_TARGET, overlap: int = OVERLAP) -> list[str]:
    words = text.split()
    if len(words) <= window:
        return [text]
    last = -(-(len(words) - window) // (window - overlap))
    return [" ".join(words[i * (window - overlap) :][:window]) for i in range(last + 1)]


def sentences(text: str, target: int = SENTENCE_TARGET) -> list[str]:
    """Sentences packed up to ``target`` tokens; a topic's opening word begins a new piece; a sentence above the target
    is cut into windows."""
    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n\n+", text) if s.strip()]
    if len(parts) <= 1:
        return windows(text, target)
    out, held, size = [], [], 0
    for part in [*parts, None]:
        n = count_tokens(part) if part is not None else 0
        if held and (part is None or n > target or size + n > target or _TURNS.match(part)):
            out.append(" ".join(held))
            held, size = [], 0
        if part is not None:
            if n > target:
                out += windows(part, target)
            else:
                held.append(part)
                size += n
    return out


def controlled(text: str) -> list[str]:
    """A text above MOST_TOKENS as paragraphs, and those still above it as packed sentences; pieces under LEAST_TOKENS are
    dropped unless nothing is left."""
    if count_tokens(text) <= MOST_TOKENS:
        return [text]
    out = [piece for p in paragraphs(text) for piece in ([p] if count_tokens(p) <= MOST_TOKENS else sentences(p))]
    return [p for p in out if count_tokens(p) >= LEAST_TOKENS] or [text]


def merged(parts: list[tuple[list[str], str, str, str]]) -> list[tuple[list[str], str, str, str]]:
    """Adjacent parts (path, title, type, text) of one known type and section, put together up to MOST_TOKENS."""
    out: list[tuple[list[str], str, str, str]] = []
    size = 0
    for path, title, kind, text in parts:
        n = count_tokens(text)
        if out and kind != "unknown" and out[-1][2] == kind and out[-1][0] == path and size + n <= MOST_TOKENS:
            out[-1] = (path, out[-1][1], kind, out[-1][3] + "\n\n" + text)
            size += n
        else:
            out.append((path, title, kind, text))
            size = n
    return out


def checked_types(given: list[str] | None, expected: int) -> list[str]:
    """A classifier's answer as one known type a paragraph: what is missing or not known is ``unknown``."""
    given = list(given or [])[:expected]
    return [t if t in TYPES else "unknown" for t in given] + ["unknown"] * (expected - len(given))


def segment_documents(documents: DataFrame, classify: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """documents (source_doc_id, text) -> (source_doc_id, segment_index, section_path, section_title, segment_type,
    raw_text): sections, paragraphs of at least LEAST_TOKENS, noise dropped, merged by type, cut to size. Without a
    classifier, or where it raises, every paragraph's type is ``unknown`` and nothing is merged. Null texts have no
    segment."""
    shape = pa.schema([("source_doc_id", pa.int64()), ("segment_index", pa.int32()), ("section_path", pa.list_(pa.string())), ("section_title", pa.string()), ("segment_type", pa.string()), ("raw_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units = [(path, title, p) for path, title, body in sections(text or "") for p in paragraphs(body) if count_tokens(p) >= LEAST_TOKENS]
                try:
                    kinds = classify([u[2] for u in units]) if classify and units else None
                except Exception:  # noqa: BLE001 - a model's failure is no failure of the job
                    kinds = None
                typed = [(p, t, k, x) for (p, t, x), k in zip(units, checked_types(kinds, len(units))) if k != "noise"]
                pieces = [(path, title, kind, x) for path, title, kind, body in merged(typed) for x in controlled(body)]
                rows += [(doc, i, *p) for i, p in enumerate(pieces)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)], schema=shape)

    return documents.select(F.col("source_doc_id").cast("long"), "text").mapInArrow(run, "source_doc_id long, segment_index int, section_path array<string>, section_title string, segment_type string, raw_text string")


def paragraph_rows(documents: DataFrame) -> DataFrame:
    """documents (source_doc_id, text) -> (source_doc_id, position, paragraph), without the size rule."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    rows = documents.select("source_doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("position", "p"))
    return rows.select("source_doc_id", "position", strip(F.col("p")).alias("paragraph")).where("paragraph <> ''")


def confidence(text: Column, tokens: Column, kind: Column) -> Column:
    """0.70 and what size, a known type and a share of capitals add; at most 1, 2 places."""
    capitals = F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(F.length(text), F.lit(1))
    size = F.when(tokens.between(50, 512), 0.1).when(tokens > 512, 0.05).otherwise(0.0)
    known = F.when(kind != "unknown", 0.1).otherwise(0.0)
    rich = F.when((capitals > 0.02) & (capitals < 0.3), 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), 0.7 + size + known + rich), 2)


def title(section_title: Column, text: Column) -> Column:
    """The section's title, else the first sentence if it has more than 10 characters, else the first 80 characters."""
    first = F.trim(F.split(F.trim(text), r"\.")[0])
    return F.substring(F.when(F.coalesce(section_title, F.lit("")) != "", section_title).when(F.length(first) > 10, first).otherwise(F.when(first != "", first).otherwise(F.substring(text, 1, 80))), 1, 255)


def adjacent_pairs(segments: DataFrame, relation: str = "Elaboration", nuclearity: str = "NN") -> DataFrame:
    """One discourse edge per pair of neighbours of a document: (src_edu_id, dst_edu_id, relation_type, nuclearity)."""
    after = F.lead("segment_id").over(Window.partitionBy("source_doc_id").orderBy("segment_index", "segment_id"))
    return segments.select(F.col("segment_id").alias("src_edu_id"), after.alias("dst_edu_id"), F.lit(relation).alias("relation_type"), F.lit(nuclearity).alias("nuclearity")).where("dst_edu_id is not null")
