"""Reading what models answer: tolerant extraction of JSON, then a schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(answer: Column, kind: str = "array") -> Column:
    """The JSON in an answer: code fences dropped, then from the first opening to the last closing bracket; null if there
    is none."""
    opening, closing = (r"\[", r"\]") if kind == "array" else (r"\{", r"\}")
    bare = F.regexp_replace(answer, r"(?i)```(?:json)?", "")
    found = F.regexp_extract(bare, rf"(?s)({opening}.*{closing})", 1)
    return F.when(found != "", found)


def parsed(answer: Column, schema: str) -> Column:
    """The answer by a schema; null where it cannot be read (a half-read answer counts as none)."""
    return F.from_json(json_text(answer, "array" if schema.lower().startswith("array") else "object"), schema, {"mode": "PERMISSIVE"})


def allowed(value: Column, values: tuple[str, ...], default: str) -> Column:
    """The value if it is one of those allowed (case aside), else the default."""
    lower = {v.lower(): v for v in values}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in lower.items() for x in kv])[F.lower(F.trim(value))], F.lit(default))
