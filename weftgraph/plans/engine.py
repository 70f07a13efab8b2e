"""Running plans: a fold over the steps that builds one lazy DataFrame per variable.

A result set is a DataFrame with node_id (string), node_type and ``_ord`` (its order) besides the columns of its
node type.  Nothing is computed until a variable is asked for, except the hops of graph walks.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph import model
from weftgraph.functions.vectors import cosine
from weftgraph.knowledge import Knowledge
from weftgraph.operators import graph
from weftgraph.plans.planner import waves
from weftgraph.plans.validator import validate

#: Columns by which a plan may filter, rank or group.
NODE_COLUMNS = ("canonical_name", "layer", "lifecycle_state")
FACT_COLUMNS = ("subject", "predicate", "object", "confidence", "lifecycle_state", "domain")
SEGMENT_COLUMNS = ("source_doc_id", "site_key", "segment_index", "segment_type", "raw_text", "token_count", "confidence", "lifecycle_state")
#: Names a projection may use for the id.
ID_NAMES = ("node_id", "segment_id", "fact_id")


class PlanError(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Limits:
    """What a plan's sets are cut to, each in the set's order; None cuts nothing. ``result`` bounds the sets of seeds,
    expansions and unions, ``visited`` walks, ``top_k`` what a budget is spent on, ``cross_encoder`` what a model scores."""

    result: int | None = model.MAX_RESULT
    visited: int | None = model.MAX_VISITED
    top_k: int | None = model.MAX_TOP_K
    cross_encoder: int | None = model.MAX_CROSS_ENCODER


#: Whole sets, whatever their size.
NO_LIMITS = Limits(None, None, None, None)


@dataclass
class Result:
    """Variables of a finished plan; ``frames`` are lazy, ``values`` scalars as one-row DataFrames, ``steps`` the trace,
    ``errors`` what went wrong with a variable (its frame is empty then)."""

    last: str
    frames: dict[str, DataFrame] = field(default_factory=dict)
    values: dict[str, DataFrame] = field(default_factory=dict)
    steps: list[dict] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def frame(self) -> DataFrame:
        return self.values[self.last] if self.last in self.values else self.frames[self.last]

    def serialize(self) -> dict:
        """The last variable in full (at most MAX_RESULT rows, in order), the others as counts or values, a failed one as
        an empty set with its error."""
        out: dict = {}
        for name, df in self.frames.items():
            if name in self.errors:
                out[name] = {"count": 0, "error": self.errors[name]}
            elif name == self.last:
                ordered = df.orderBy("_ord", "node_id") if "_ord" in df.columns else df
                out[name] = [{k: v for k, v in r.asDict(recursive=True).items() if k != "_ord"} for r in ordered.limit(model.MAX_RESULT).collect()]
            else:
                n = df.limit(model.MAX_RESULT + 1).count()
                out[name] = {"count": min(n, model.MAX_RESULT), "truncated": n > model.MAX_RESULT}
        for name, df in self.values.items():
            out[name] = {"value": df.first()[0]}
        return {"meta": {"steps_executed": len(self.steps), "steps_detail": self.steps}, "result": out}


def _aligned(frames: list[DataFrame]) -> list[DataFrame]:
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    kinds = {c: f.schema[c].dataType for f in reversed(frames) for c in f.columns}
    return [f.select(*[F.col(c) if c in f.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names]) for f in frames]


class QueryEngine:
    """Runs plans over a `Knowledge`. ``scorer(query, texts) -> scores`` is an optional cross-encoder; without one the
    feature scores stand. ``strict`` raises what a step raises; otherwise its set is empty and the error is kept."""

    def __init__(self, knowledge: Knowledge, relations: set[str] | None = None, scorer: Callable[[str, list[str]], list[float]] | None = None, limits: Limits = Limits(), strict: bool = True):
        self.k, self.scorer, self.limits, self.strict = knowledge, scorer, limits, strict
        self.relations = relations if relations is not None else {"depends_on", "requires", "impacts", "causes", "implemented_by", "explains", "applies_to", "composed_of", "subclass_of"}

    def run(self, plan: dict) -> Result:
        errors = validate(plan, self.relations)
        if errors:
            raise PlanError(errors)
        steps, result = plan["steps"], Result(plan["steps"][-1]["as"])
        for wave in waves(steps):
            for i in wave:
                began, step = time.time(), steps[i]
                try:
                    getattr(self, "_" + step["op"])(step, result, plan)
                except Exception as error:
                    if self.strict:
                        raise
                    result.errors[step["as"]] = str(error)
                    result.frames[step["as"]] = self.k.spark.createDataFrame([], "node_id string, node_type string, _ord double")
                result.steps.append({"step": i, "op": step["op"], "as": step["as"], "ms": round(1000 * (time.time() - began), 1)})
        return result

    # ---- seed

    def _nodes(self, rows: DataFrame, order: Column | None = None) -> DataFrame:
        return rows.select("node_id", F.lit("node").alias("node_type"), (order if order is not None else F.lit(0.0)).cast("double").alias("_ord"), *NODE_COLUMNS, *(["similarity"] if "similarity" in rows.columns else []))

    def _segments(self, rows: DataFrame, extra: tuple[str, ...] = (), order: Column | None = None) -> DataFrame:
        return rows.select(F.col("segment_id").cast("string").alias("node_id"), F.lit("segment").alias("node_type"), (order if order is not None else F.lit(0.0)).cast("double").alias("_ord"), *SEGMENT_COLUMNS, *extra)

    def _facts(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("fact_id").alias("node_id"), F.lit("fact").alias("node_type"), F.lit(0.0).alias("_ord"), *FACT_COLUMNS)

    def _seed(self, step: dict, result: Result, plan: dict) -> None:
        by, target, value, k = step["by"], step["target"], step["value"], self.k
        values = value if isinstance(value, list) else [value]
        active_segments, active_facts = k.segment.where("lifecycle_state = 'active'"), k.fact.where("lifecycle_state = 'active'")
        if by == "id":
            if target == "node":
                out = self._nodes(k.node.where(F.col("node_id").isin(values)))
            elif target == "segment":
                out = self._segments(active_segments.where(F.col("segment_id").isin([int(v) for v in values])))
            else:
                out = self._facts(active_facts.where(F.col("fact_id").isin(values)))
        elif by == "alias":
            terms = [str(v).lower() for v in values]
            ids = k.alias.where(F.col("folded").isin(terms)).select(F.col("canonical_node_id").alias("node_id"))
            named = k.node.where(F.lower("canonical_name").isin(terms)).select("node_id")
            out = self._nodes(k.node.join(ids.union(named).distinct(), "node_id", "left_semi"))
        elif by == "layer":
            out = self._nodes(k.node.where(F.col("layer").isin([str(v) for v in values])))
        elif by == "embedding":
            near = nearest_segments(k, value, step.get("top_k", 100))
            if target == "node":
                tags = k.segment_tag.select("segment_id", F.col("ontology_node_id").alias("node_id"))
                rows = near.join(tags, "segment_id").orderBy(F.desc("similarity"), "segment_id", "node_id").limit(step.get("top_k", 100))
                rows = rows.groupBy("node_id").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= step.get("threshold", 0.0))
                out = self._nodes(k.node.join(rows, "node_id"), -F.col("similarity"))
            else:
                rows = active_segments.join(near.where(F.col("similarity") >= step.get("threshold", 0.0)), "segment_id")
                out = self._segments(rows, ("similarity",), -F.col("similarity"))
        else:  # attribute
            columns, rows = {"segment": (SEGMENT_COLUMNS, active_segments), "fact": (FACT_COLUMNS, active_facts)}.get(target, ((), None))
            if rows is None:
                out = self._nodes(k.node.where("false"))
            else:
                unknown = [c for c in value if c not in columns]
                if unknown:
                    raise PlanError([f"unknown attribute '{c}'" for c in unknown])
                for c, v in value.items():
                    rows = rows.where(F.col(c) == v)
                out = self._segments(rows) if target == "segment" else self._facts(rows)
        result.frames[step["as"]] = first_rows(out, self.limits.result)

    # ---- expand

    def _expand(self, step: dict, result: Result, plan: dict) -> None:
        source = result.frames[step.get("from") or step.get("input")]
        types = step.get("any_of") or step["sequence"]
        if "sequence" in step:
            out = self._sequence(source, types, step.get("direction", "outbound"))
        else:
            reserved = [t for t in types if t in model.RESERVED_EDGES]
            parts = [getattr(self, "_" + t)(source) for t in reserved]
            relations = [t.upper() for t in types if t not in reserved]
            if relations:
                depth = step.get("depth", 1)
                walk = graph.bfs(self.k.edge, source.select("node_id"), relations, step.get("direction", "outbound"), None if depth == "unlimited" else depth, step.get("confidence_decay") or 1.0, step.get("min_confidence", 0.0), self.limits.visited)
                walk = walk.select("node_id", F.col("hop").alias("_hop"), F.col("confidence").alias("_confidence"), F.col("rel_type").alias("_rel_type"))
                rows = self.k.node.join(walk, "node_id")
                parts.append(rows.select("node_id", F.lit("node").alias("node_type"), F.col("_hop").cast("double").alias("_ord"), *NODE_COLUMNS, "_hop", "_confidence", "_rel_type"))
            aligned = _aligned(parts)
            out = aligned[0]
            for part in aligned[1:]:
                out = out.union(part)
        result.frames[step["as"]] = first_rows(out, self.limits.result)

    def _sequence(self, source: DataFrame, types: list[str], direction: str) -> DataFrame:
        current = source.select("node_id").distinct()
        for t in types:
            if t in model.RESERVED_EDGES:
                current = getattr(self, "_" + t)(current.select("node_id")).select("node_id").distinct()
            else:
                walk = graph.directed(self.k.edge, [t.upper()], direction)
                current = walk.join(current.withColumnRenamed("node_id", "here"), "here", "left_semi").select(F.col("there").alias("node_id")).distinct()
        last = types[-1]
        if last in ("tagged_in", "rst_adjacent", "evidenced_by"):
            return self._segments(self.k.segment.join(current.select(F.col("node_id").cast("long").alias("segment_id")), "segment_id", "left_semi"))
        return self._nodes(self.k.node.join(current, "node_id", "left_semi"))

    def _tagged_in(self, source: DataFrame) -> DataFrame:
        tags = self.k.segment_tag.select("segment_id", F.col("ontology_node_id").alias("matched_node")).distinct()
        ids = source.select(F.col("node_id").alias("matched_node")).distinct()
        rows = self.k.segment.where("lifecycle_state = 'active'").join(tags.join(ids, "matched_node"), "segment_id")
        return self._segments(rows, ("matched_node",))

    def _rst_adjacent(self, source: DataFrame) -> DataFrame:
        ids = source.select(F.col("node_id").cast("long").alias("from_id")).distinct()
        both = self.k.rst.select(F.col("src_edu_id").alias("from_id"), F.col("dst_edu_id").alias("segment_id"), "relation_type")
        both = both.union(self.k.rst.select(F.col("dst_edu_id").alias("from_id"), F.col("src_edu_id").alias("segment_id"), "relation_type"))
        found = both.join(ids, "from_id", "left_semi").groupBy("segment_id").agg(F.min("relation_type").alias("relation_type"))
        found = found.join(ids.withColumnRenamed("from_id", "segment_id"), "segment_id", "left_anti")
        return self._segments(self.k.segment.join(found, "segment_id"), ("relation_type",))

    def _evidenced_by(self, source: DataFrame) -> DataFrame:
        best = self.k.evidence.join(source.select(F.col("node_id").alias("fact_id")).distinct(), "fact_id", "left_semi")
        best = best.groupBy("segment_id").agg(F.max("evidence_score").alias("evidence_score"))
        return self._segments(self.k.segment.where("lifecycle_state = 'active'").join(best, "segment_id"), ("evidence_score",))

    # ---- combine

    def _combine(self, step: dict, result: Result, plan: dict) -> None:
        sets = [result.frames[v] for v in step["sets"]]
        ids = [s.select("node_id").distinct() for s in sets]
        if step["method"] == "subtract":
            out = sets[0].join(ids[1], "node_id", "left_anti")
        elif step["method"] == "intersect":
            out = sets[0]
            for other in ids[1:]:
                out = out.join(other, "node_id", "left_semi")
        else:
            parts = _aligned([s.withColumn("_ord", F.col("_ord") + 1e6 * i) for i, s in enumerate(sets)])
            out = parts[0]
            for part in parts[1:]:
                out = out.union(part)
            out = first_rows(out, self.limits.result)
        result.frames[step["as"]] = out.select(*[c for c in sets[0].columns if c in out.columns], *[c for c in out.columns if c not in sets[0].columns])

    # ---- aggregate

    def _aggregate(self, step: dict, result: Result, plan: dict) -> None:
        source, limit = result.frames[step.get("from") or step.get("input")], step.get("limit")
        how, name = step["function"], step["as"]
        if how == "count":
            result.values[name] = source.agg(F.count("*").alias("value"))
            return
        if how == "group":
            keys = [k for k in step.get("by", ["node_type"])]
            made = [(F.coalesce(F.col(k).cast("string"), F.lit("")) if k in source.columns else F.lit("")).alias(k) for k in keys]
            result.frames[name] = source.groupBy(*made).agg(F.count("*").alias("count"))
            return
        if how == "rank":
            keys = [c for c in step.get("by", ["confidence"]) if c in source.columns]
            down = step.get("order", "desc") == "desc"
            order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c in keys]
            result.frames[name] = ranked(source, order, limit)
        elif how == "score":
            signals = step.get("signals") or ["confidence"]
            score = sum((_signal(source, s) for s in signals), F.lit(0.0)) / len(signals)
            result.frames[name] = ranked(source.withColumn("_score", score), [F.desc("_score")], limit)
        else:
            result.frames[name] = self._rerank(source, step, plan)

    def _rerank(self, source: DataFrame, step: dict, plan: dict) -> DataFrame:
        query = step.get("query") or plan.get("intent") or " ".join(str(v) for s in plan["steps"] if s["op"] == "seed" for v in (s["value"] if isinstance(s["value"], list) else [s["value"]]))
        scored = source.withColumn("_feature_score", feature_score(source, query, step.get("signals")))
        order = [F.desc("_feature_score")]
        if step.get("cross_encoder") and query and self.scorer:
            top = ranked(scored, order, self.limits.cross_encoder)
            scored, order = cross_encoded(top, query, self.scorer), [F.desc("_final_score")]
        if step.get("budget"):
            return budget_select(ranked(scored, order, self.limits.top_k), step["budget"], step.get("limit", 30))
        return ranked(scored, order, step.get("limit", 30))

    # ---- project

    def _project(self, step: dict, result: Result, plan: dict) -> None:
        source = result.frames[step.get("from") or step.get("input")]
        made = []
        for f in step["fields"]:
            if f in source.columns:
                made.append(F.col(f))
            elif f in ID_NAMES:
                made.append(F.col("node_id").alias(f))
        keep = ["_ord"] if "_ord" in source.columns and "_ord" not in step["fields"] else []
        result.frames[step["as"]] = source.select(*made, *keep)


def _signal(source: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in source.columns else F.lit(0.0)


def first_rows(df: DataFrame, limit: int | None = model.MAX_RESULT) -> DataFrame:
    """Keep-first by id and type in the set's order; then at most ``limit`` rows in that order."""
    order = Window.partitionBy("node_id", "node_type").orderBy("_ord", *[F.col(c) for c in df.columns if c in ("matched_node", "_rel_type")])
    one = df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return one if limit is None else one.orderBy("_ord", "node_id").limit(limit)


def ranked(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first ``limit`` rows in the order, ties by id; their new order is their rank."""
    top = df.orderBy(*order, "node_id")
    top = top.limit(limit) if limit else top
    return top.withColumn("_ord", F.row_number().over(Window.orderBy(*order, "node_id")).cast("double"))


def feature_score(source: DataFrame, query: str | None, signals: list[str] | None = None) -> Column:
    """Weighted signals and the share of the query's terms that occur in the text, rounded to 4 places."""
    signals = signals or list(model.RERANK_WEIGHTS)
    score = F.lit(0.0)
    for s in signals:
        weight = model.RERANK_WEIGHTS.get(s, 1.0 / max(len(signals), 1))
        if s == "source_rank":
            rank = F.col(s) if s in source.columns else F.lit("C")
            value = F.coalesce(F.create_map(*[F.lit(x) for kv in (("S", 1.0), ("A", 0.8), ("B", 0.6), ("C", 0.4)) for x in kv])[rank], F.lit(0.4))
        else:
            value = _signal(source, s)
        score = score + weight * value
    terms = [t.lower() for t in (query or "").split() if len(t) >= 2]
    if terms and "raw_text" in source.columns:
        text = F.lower(F.coalesce("raw_text", F.lit("")))
        hits = sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))
        score = score + model.RERANK_KEYWORDS * F.least(hits / len(terms), F.lit(1.0))
    return F.round(score, 4)


def cross_encoded(top: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """Scores of a model on at most MAX_CROSS_ENCODER rows: 0.4 feature score + 0.6 model score / 10."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*top.schema.fields, StructField("_final_score", DoubleType())])

    def score(batches):
        for pdf in batches:
            given = scorer(query, [t or "" for t in pdf["raw_text"]]) if len(pdf) else []
            pdf["_final_score"] = [0.4 * f + 0.6 * c / 10 for f, c in zip(pdf["_feature_score"], given)]
            yield pdf

    return top.coalesce(1).mapInPandas(score, schema)


def budget_select(top: DataFrame, budget: int, limit: int) -> DataFrame:
    """Greedy by order: a row that doesn't fit the token budget is skipped, until ``limit`` rows are taken. Over at
    most MAX_TOP_K rows, as an array fold. A missing token count is a quarter of the characters."""
    text = F.length(F.coalesce("raw_text", F.lit("")))
    tokens = F.when(F.coalesce("token_count", F.lit(0)) > 0, F.col("token_count")).otherwise(F.greatest(F.lit(1), F.floor(text / 4))).cast("int")
    small = top.select("node_id", "_ord", tokens.alias("t"))
    rows = F.array_sort(F.collect_list(F.struct("_ord", "node_id", "t")))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<string>").alias("ids"))
    fits = lambda acc, x: (acc.sum + x.t <= budget) & (F.size(acc.ids) < limit)
    step = lambda acc, x: F.struct(F.when(fits(acc, x), acc.sum + x.t).otherwise(acc.sum).alias("sum"), F.when(fits(acc, x), F.concat(acc.ids, F.array(x.node_id))).otherwise(acc.ids).alias("ids"))
    taken = small.agg(rows.alias("rows")).select(F.explode(F.aggregate("rows", start, step, lambda acc: acc.ids)).alias("node_id"))
    return top.join(F.broadcast(taken), "node_id", "left_semi")


def nearest_segments(k: Knowledge, query: list[float], top_k: int, column: str = "content_vec") -> DataFrame:
    """Exact top-k by cosine: (segment_id, similarity); null and zero vectors take no part."""
    vectors = k.segment_vec.select("segment_id", F.col(column).alias("v")).where("v is not null")
    near = vectors.select("segment_id", cosine(F.col("v"), query).alias("similarity")).where("similarity is not null")
    return near.orderBy(F.desc("similarity"), "segment_id").limit(top_k)
