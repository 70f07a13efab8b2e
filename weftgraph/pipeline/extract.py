"""Facts: from discourse relations, from model output (checked and filtered), and their confidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph import model
from weftgraph.functions.text import words

# Words by which a predicate is told, in order.
PREDICATE_SIGNALS = (
    ("uses_protocol", r"\buses?\b|\busing\b|\butiliz"),
    ("part_of", r"\bpart of\b|\bcomponent\b|\bwithin\b"),
    ("depends_on", r"\bdepends?\s+on\b|\brequir"),
    ("impacts", r"\bimpact|affect"),
    ("causes", r"\bcaus(?:e[sd]?|ing)\b|\bresult(?:s|ing)?\s+in\b"),
    ("encapsulates", r"\bencapsulat"),
    ("establishes", r"\bestablish"),
    ("advertises", r"\badvertis"),
    ("forwards_via", r"\bforward"),
    ("protects", r"\bprotect"),
    ("monitored_by", r"\bmonitor"),
    ("configured_by", r"\bconfigur"),
    ("implements", r"\bimplement"),
)


def rst_facts(rst: DataFrame, tags: DataFrame, relations: Sequence[str], per_side: int = 3) -> DataFrame:
    """Discourse edges whose type names a predicate, between the first nodes of both segments: (subject, predicate,
    object, segment_id). The nucleus is the subject; no node is related to itself; only known relations are kept."""
    predicate = F.create_map(*[F.lit(x) for kv in model.RST_PREDICATE.items() for x in kv])[F.col("relation_type")]
    edges = rst.withColumn("predicate", predicate).where(F.col("predicate").isin(list(relations)))
    turned = F.col("nuclearity") == "SN"
    edges = edges.select(F.when(turned, F.col("dst_edu_id")).otherwise(F.col("src_edu_id")).alias("s"), F.when(turned, F.col("src_edu_id")).otherwise(F.col("dst_edu_id")).alias("o"), "predicate")
    order = Window.partitionBy("segment_id").orderBy(F.desc_nulls_last("confidence"), "ontology_node_id")
    best = tags.groupBy("segment_id", "ontology_node_id").agg(F.max("confidence").alias("confidence"))
    best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_side).select("segment_id", "ontology_node_id")
    rows = edges.join(best.toDF("s", "subject"), "s").join(best.toDF("o", "object"), "o").where("subject <> object")
    return rows.select("subject", "predicate", "object", F.col("s").alias("segment_id")).distinct()


def segment_chains(segments: DataFrame, rst: DataFrame, least: int = 3, most: int = 4, most_tokens: int = 1500) -> DataFrame:
    """From every segment the chain along chaining relations (the least successor first) of ``least`` to ``most``
    segments within ``most_tokens`` (a quarter of the characters each): (head, chain, tokens)."""
    size = segments.select(F.col("segment_id").alias("id"), F.floor(F.length(F.coalesce("raw_text", F.lit(""))) / 4).cast("int").alias("t"))
    step = rst.where(F.col("relation_type").isin(list(model.CHAINING))).groupBy("src_edu_id").agg(F.min("dst_edu_id").alias("next"))
    chain = size.select(F.col("id").alias("head"), F.col("id").alias("at"), F.array("id").alias("chain"), F.col("t").alias("tokens"), F.lit(True).alias("open"))
    for _ in range(most - 1):
        grown = chain.join(step, (F.col("at") == F.col("src_edu_id")) & F.col("open"), "left").join(size, F.col("next") == F.col("id"), "left")
        fits = F.col("next").isNotNull() & (F.col("tokens") + F.coalesce("t", F.lit(0)) <= most_tokens)
        chain = grown.select("head", F.when(fits, F.col("next")).otherwise(F.col("at")).alias("at"), F.when(fits, F.concat("chain", F.array("next"))).otherwise(F.col("chain")).alias("chain"), F.when(fits, F.col("tokens") + F.coalesce("t", F.lit(0))).otherwise(F.col("tokens")).alias("tokens"), fits.alias("open"))
    return chain.where(F.size("chain") >= least).select("head", "chain", "tokens")


def quote_supported(quote: Column, text: Column) -> Column:
    """Whether a quote stands in the text (case and white space aside), or 80 % of its words do."""
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    q, t = F.trim(flat(quote)), flat(text)
    mine = F.array_distinct(words(q))
    share = F.size(F.array_intersect(mine, F.array_distinct(words(t)))) / F.greatest(F.size(mine), F.lit(1))
    return F.coalesce((F.length(quote) >= 8) & (F.contains(t, q) | (share >= 0.8)), F.lit(False))


def filter_triples(triples: DataFrame, allowed_nodes: DataFrame, relations: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """triples (segment_id, subject, predicate, object), allowed_nodes (segment_id, node_id) -> facts whose both ends are
    allowed in their segment, differ and have a known predicate; and the unknown predicates with their number of uses."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim("predicate")), r"[\s\-]+", "_"), r"[^a-z0-9_]", "")
    rows = triples.withColumn("predicate", clean).where("predicate <> '' and subject <> object")
    for end in ("subject", "object"):
        rows = rows.join(allowed_nodes.select("segment_id", F.col("node_id").alias(end)).distinct(), ["segment_id", end], "left_semi")
    known = F.col("predicate").isin(list(relations))
    return rows.where(known).select("segment_id", "subject", "predicate", "object"), rows.where(~known).groupBy("predicate").agg(F.count("*").alias("n"))


def predicate_signal(text: Column) -> Column:
    """The first predicate whose words stand in the first 3 000 characters, or null."""
    head, out = F.lower(F.substring(text, 1, 3000)), None
    for name, pattern in PREDICATE_SIGNALS:
        out = F.when(head.rlike(pattern), name) if out is None else out.when(head.rlike(pattern), name)
    return out


def cooccurrence(segments: DataFrame, tags: DataFrame) -> DataFrame:
    """segments (segment_id, text) that mention exactly two nodes and a predicate's words: (segment_id, subject,
    predicate, object), the subject being the lesser id."""
    two = tags.groupBy("segment_id").agg(F.count_distinct("ontology_node_id").alias("n"), F.min("ontology_node_id").alias("subject"), F.max("ontology_node_id").alias("object")).where("n = 2")
    return segments.join(two, "segment_id").select("segment_id", "subject", predicate_signal(F.col("text")).alias("predicate"), "object").where("predicate is not null")


def rst_argmax(scores: Column, given: Column) -> Column:
    """The relation with the greatest score among the known ones, else the given one if known, else Elaboration."""
    known = [*model.RST_PROPAGATION]
    valid = F.filter(F.map_entries(scores), lambda e: e["key"].isin(known))
    best = F.array_max(F.transform(valid, lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    return F.coalesce(best["k"], F.when(given.isin(known), given), F.lit("Elaboration"))


#: Nodes a segment needs to be asked about, triples of one question to a verifier, hints on nuclearity.
LEAST_ANCHORS, VERIFY_CHUNK = 3, 3
NUCLEARITY = {"NS": "the first paragraph is the main content", "SN": "the second paragraph is the main content", "NN": "both paragraphs carry equal weight"}


def merged_contexts(segments: DataFrame, rst: DataFrame, tags: DataFrame) -> DataFrame:
    """segments (segment_id, raw_text) -> what a model is asked about, (segment_id, text, nodes): segments with at least
    LEAST_ANCHORS nodes by themselves, and pairs joined by a continuative relation that have as many together, under
    the second's id and with a line on the relation before the texts."""
    nodes = tags.groupBy("segment_id").agg(F.array_sort(F.collect_set("ontology_node_id")).alias("nodes"))
    rows = segments.select("segment_id", F.coalesce("raw_text", F.lit("")).alias("text")).join(nodes, "segment_id", "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<string>")))
    pairs = rst.where(F.col("relation_type").isin(list(model.CONTINUATIVE))).select(F.col("src_edu_id").alias("a"), F.col("dst_edu_id").alias("segment_id"), "relation_type", F.coalesce("nuclearity", F.lit("NN")).alias("nuclearity"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in NUCLEARITY.items() for x in kv])[F.col("nuclearity")], F.lit(NUCLEARITY["NN"]))
    hint = F.concat(F.lit("[These two paragraphs have a "), "relation_type", F.lit(" relation: "), weight, F.lit(".]\n\n"))
    both = pairs.join(rows.toDF("a", "text_a", "nodes_a"), "a").join(rows, "segment_id")
    both = both.select("segment_id", F.concat(hint, "text_a", F.lit("\n"), "text").alias("text"), F.array_sort(F.array_union("nodes_a", "nodes")).alias("nodes"))
    return rows.union(both).where(F.size("nodes") >= LEAST_ANCHORS)


def model_triples(contexts: DataFrame, extractor: Callable[[str, list[str]], list[dict]] | None) -> DataFrame:
    """contexts (segment_id, text, nodes) -> (segment_id, subject, predicate, object, quote) as ``extractor(text, nodes)``
    gives them, batch by batch in the tasks; what it raises leaves the context without triples. Without an extractor
    there are none. Check the outcome with `filter_triples` and `quote_supported`."""
    shape = "segment_id long, subject string, predicate string, object string, quote string"
    if extractor is None:
        return contexts.sparkSession.createDataFrame([], shape)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for segment, text, nodes in zip(pdf["segment_id"], pdf["text"], pdf["nodes"]):
                try:
                    given = extractor(text, list(nodes))
                except Exception:  # noqa: BLE001 - a model's failure is no failure of the job
                    given = []
                out += [(segment, *(t.get(c) for c in ("subject", "predicate", "object", "quote"))) for t in given or []]
            yield pd.DataFrame(out, columns=["segment_id", "subject", "predicate", "object", "quote"])

    return contexts.select("segment_id", "text", "nodes").mapInPandas(run, shape).distinct()


def verified_triples(triples: DataFrame, texts: DataFrame, verifier: Callable[[str, list[dict]], list[bool] | None] | None, chunk: int = VERIFY_CHUNK) -> DataFrame:
    """triples (segment_id, subject, predicate, object, quote) without those ``verifier(text, triples)`` denies. A segment's
    triples are asked about in chunks; a chunk whose answer fails twice, or is no list of its length, stays."""
    if verifier is None:
        return triples
    names = ["subject", "predicate", "object", "quote"]
    order = Window.partitionBy("segment_id").orderBy(*names)
    rows = triples.withColumn("_c", F.floor((F.row_number().over(order) - 1) / chunk))
    asked = rows.groupBy("segment_id", "_c").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("t")).join(texts.select("segment_id", "text"), "segment_id", "left")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for segment, listed, text in zip(pdf["segment_id"], pdf["t"], pdf["text"]):
                listed = [dict(t) for t in listed]
                verdict = None
                for _ in range(2):
                    try:
                        verdict = verifier(text or "", listed)
                    except Exception:  # noqa: BLE001
                        verdict = None
                    if verdict is not None and len(verdict) == len(listed):
                        break
                    verdict = None
                out += [(segment, *(t[c] for c in names)) for t, ok in zip(listed, verdict or [True] * len(listed)) if ok]
            yield pd.DataFrame(out, columns=["segment_id", *names])

    return asked.select("segment_id", "t", "text").mapInPandas(run, triples.select("segment_id", *names).schema)
