"""Cleaning, quality gates and exact duplicates of fetched pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import let, token_count

# Patterns of site furniture that is cut wherever it stands.
BOILERPLATE = (
    r"(?is)(cookie|privacy) (policy|notice|consent).*?(\n|$)",
    r"(?is)(accept|agree) (cookies|terms).*?(\n|$)",
    r"(?is)(share|like|tweet|follow us).*?(\n|$)",
    r"(?is)©\s*\d{4}.*?all rights reserved.*?(\n|$)",
    r"(?is)\b(navigation|breadcrumb|skip to content)\b.*?(\n|$)",
)

# What tells a document's type, a sentence's end and a line of a list.
SPEC_URL, SPEC_TITLE = "/rfc/|/rfcs/", r"\brfc\s*\d+"
MANUAL_URL, MANUAL_TITLE = "/config-guide/|/configuration/|/cli-reference/|/troubleshoot", "configuration guide|command reference|cli guide|troubleshoot"
QUESTIONS = r"(?i)\bQ\s*[:：]|\bA\s*[:：]|frequently asked|常见问题"
CODE = r"(?m)```[\s\S]*?```|^\s{4,}\S"
SENTENCE_END = r"""[.!?。！？]+(?:\s|["')\]]|\z)"""
LISTED = r"^\s*[-*•◦·▪▫]\s|\.\s*\.\s*\."


def exact_duplicates(documents: DataFrame, digest: str = "content_hash", order: str = "crawl_time", key: str = "source_doc_id") -> DataFrame:
    """documents with ``is_duplicate``: of those with an equal digest the earliest stays (a null time comes last). A null
    digest equals none. The first of each digest is a partial minimum joined back, so a hot digest is no task of its own."""
    first = F.min(F.struct(F.col(order).isNull().alias("late"), F.col(order).alias("t"), F.col(key).alias("k")))
    heads = documents.where(F.col(digest).isNotNull()).groupBy(digest).agg(first.alias("_head"))
    return documents.join(heads, digest, "left").withColumn("is_duplicate", F.coalesce(F.col("_head.k") != F.col(key), F.lit(False))).select(*documents.columns, "is_duplicate")


def dedup_groups(documents: DataFrame, digest: str = "normalized_hash") -> DataFrame:
    """(source_doc_id, dedup_group_id): the least id with the same digest; a null digest makes no group."""
    heads = documents.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min("source_doc_id").alias("dedup_group_id"))
    return documents.select("source_doc_id", digest).join(heads, digest, "left").select("source_doc_id", F.coalesce("dedup_group_id", "source_doc_id").alias("dedup_group_id"))


def is_plaintext(content: Column, url: Column) -> Column:
    head = F.substring(content, 1, 500)
    return F.coalesce(url.endswith(".txt"), F.lit(False)) | ~head.rlike(r"<\w+[\s>]")


def preprocess_html(html: Column) -> Column:
    for tag in ("style", "script", "noscript", "template"):
        html = F.regexp_replace(html, rf"(?i)<{tag}[^>]*>[\s\S]*?</{tag}>", "")
    return html


def html_to_text(html: Column) -> Column:
    """Headings as # marks, blocks as lines, other tags dropped, white space collapsed."""
    for level in (4, 3, 2, 1):
        html = F.regexp_replace(html, rf"(?is)<h{level}[^>]*>\s*(.*?)\s*</h{level}>", "\n" + "#" * level + " $1\n")
    html = F.regexp_replace(html, r"(?i)</?(p|div|li|tr|blockquote)(\s[^>]*)?>", "\n")
    html = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", ""), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def extracted_text(pages: DataFrame, extractors: Sequence[Callable[[str], str | None]] = (), least: int = 200) -> DataFrame:
    """pages (page_id, html) -> (page_id, text, extracted_by): the answer of the first extractor (a library's function of
    the page) that gives at least ``least`` characters, else `html_to_text`, marked ``rules``. An extractor that raises
    has no answer. Null pages have a null text."""
    plain = pages.select("page_id", "html", F.when(F.col("html").isNotNull(), html_to_text(preprocess_html(F.col("html")))).alias("rules"))
    if not extractors:
        return plain.select("page_id", F.col("rules").alias("text"), F.lit("rules").alias("extracted_by"))

    def run(batches):
        for pdf in batches:
            texts, by = [], []
            for html, rules in zip(pdf["html"], pdf["rules"]):
                text, name = rules, "rules"
                for i, extract in enumerate(extractors if html else ()):
                    try:
                        given = extract(html)
                    except Exception:  # noqa: BLE001 - the next one is asked
                        given = None
                    if given and len(given) >= least:
                        text, name = given, getattr(extract, "__name__", str(i))
                        break
                texts.append(text)
                by.append(name)
            yield pdf[["page_id"]].assign(text=texts, extracted_by=by)

    return plain.mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, extracted_by string")


def html_title(html: Column) -> Column:
    tag = lambda t: F.regexp_replace(F.regexp_extract(html, rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1), r"<[^>]+>", "")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), strip(tag("title"))).otherwise(strip(tag("h1")))


def text_title(text: Column) -> Column:
    """The first line that can be a title: 4 to 150 characters, not aligned in columns."""
    bare = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s*#*\s*|\s+$", ""))
    fit = F.filter(bare, lambda x: (F.length(x) > 3) & (F.length(x) <= 150) & ~x.rlike(r"\S.*\s{4,}.*\S"))
    return F.coalesce(F.get(fit, F.lit(0)), F.lit(""))


def language(text: Column) -> Column:
    return F.when(F.regexp_count(F.substring(text, 1, 500), F.lit(r"[\x{4e00}-\x{9fff}]")) > 20, "zh").otherwise("en")


def quality_signals(text: Column) -> dict[str, Column]:
    """line_count, char_count, sentence_density (sentence ends per 1 000 characters), listy_ratio."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.greatest(F.size(lines), F.lit(1))
    ends = F.regexp_count(text, F.lit(SENTENCE_END))
    listy = F.size(F.filter(lines, lambda x: (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2) | x.rlike(LISTED)))
    empty = F.length(text) == 0
    return {
        "line_count": F.when(empty, 0).otherwise(n).cast("int"),
        "char_count": F.length(text),
        "sentence_density": F.when(empty, 0.0).otherwise(F.round(ends / (F.length(text) / 1000), 2)),
        "listy_ratio": F.when(empty, 0.0).otherwise(F.round(listy / n, 2)),
    }


def quality_gate(tokens: Column, density: Column, listy: Column) -> Column:
    """The reason a page is of low quality, or null."""
    return F.when(tokens < 200, "too_short").when(density < 1.0, "no_sentences").when((density < 2.0) & (listy > 0.4), "listy_dump")


def document_type(url: Column, title: Column, text: Column) -> Column:
    u, t = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    asks = F.regexp_count(F.substring(text, 1, 3000), F.lit(QUESTIONS))
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    faq = (n > 0) & (asks / F.greatest(n / 100, F.lit(1.0)) > 0.3)
    fences = F.regexp_count(text, F.lit(CODE))
    return (
        F.when(u.rlike(SPEC_URL) | t.rlike(SPEC_TITLE), "spec")
        .when(u.rlike(MANUAL_URL) | t.rlike(MANUAL_TITLE), "vendor_doc")
        .when(u.endswith(".pdf"), "pdf")
        .when(faq, "faq")
        .when(fences > 3, "tutorial")
        .otherwise("tech_article")
    )


def strip_boilerplate(text: Column) -> Column:
    for pattern in BOILERPLATE:
        text = F.regexp_replace(text, pattern, " ")
    return text


def remove_repeated_lines(text: Column, least_length: int = 40, least_count: int = 3) -> Column:
    """A text without the long lines that stand in it ``least_count`` times or more. Lines are compared within one text
    only: an array expression, no shuffle."""
    lines = F.split(text, "\n", -1)
    long_ = F.array_sort(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: F.length(x) >= least_length))
    # over the sorted lines: how often the present one has stood, and which ones have stood often enough
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.array().cast("array<string>").alias("often"))
    run = lambda acc, x: F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
    often = lambda acc, x: F.when(run(acc, x) == least_count, F.concat(acc["often"], F.array(x))).otherwise(acc["often"])
    again = F.aggregate(long_, start, lambda acc, x: F.struct(x.alias("last"), run(acc, x).alias("run"), often(acc, x).alias("often")), lambda acc: acc["often"])
    return let(again, lambda a: F.array_join(F.filter(lines, lambda x: ~F.array_contains(a, F.trim(x))), "\n"))


def links(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> distinct (page_id, link): absolute links of the same host without file downloads."""
    found = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r"""href=["']([^"'#]+)"""), F.lit(1))).alias("href"))
    host = F.parse_url("url", F.lit("HOST"))
    link = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(F.lit("https://"), host, F.col("href")))
    out = found.withColumn("link", link).where(F.col("link").isNotNull() & ~F.lower("link").rlike(r"\.(jpg|jpeg|png|gif|svg|css|js|ico|zip|gz|mp4)(\?|$)"))
    return out.where(F.parse_url("link", F.lit("HOST")) == host).select("page_id", "link").distinct()


def normalize_url(url: Column) -> Column:
    return F.regexp_replace(url, r"^https?://datatracker\.ietf\.org/doc/(?:html/)?(rfc\d+).*$", "https://www.rfc-editor.org/rfc/$1")


def task_queue(tasks: DataFrame, n: int) -> DataFrame:
    """The next tasks: pending, greatest priority first."""
    return tasks.where("status = 'pending'").orderBy(F.desc_nulls_last("priority"), "task_id").limit(n)


def retry_after(retries: Column) -> Column:
    """Minutes to wait before the next try."""
    return F.when(retries <= 0, 5).when(retries == 1, 30).otherwise(120)


def quality_report(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents -> source_doc_id, the signals, token_count and the gate's reason."""
    rows = documents.select("source_doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.select("source_doc_id", token_count(F.col("_t")).alias("token_count"), *[c.alias(n) for n, c in quality_signals(F.col("_t")).items()])
    return rows.withColumn("reason", quality_gate(F.col("token_count"), F.col("sentence_density"), F.col("listy_ratio")))


