"""Named operators with hooks around them: before, after and on error, outermost first."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Outcome:
    """What an operator gave: a DataFrame or value, and what hooks noted about the call."""

    value: Any
    meta: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Hooks:
    before: Callable[[str, dict], dict | None] | None = None
    after: Callable[[str, Outcome], None] | None = None
    on_error: Callable[[str, Exception], Any] | None = None


class OperatorRegistry:
    def __init__(self):
        self._operators: dict[str, Callable] = {}
        self._hooks: list[Hooks] = []

    def register(self, name: str, operator: Callable) -> None:
        if name in self._operators:
            raise ValueError(f"operator '{name}' is registered already")
        self._operators[name] = operator

    def use(self, hooks: Hooks) -> None:
        self._hooks.append(hooks)

    def names(self) -> list[str]:
        return sorted(self._operators)

    def run(self, name: str, *args, **parameters) -> Outcome:
        """Runs an operator. ``before`` may change the parameters; ``on_error`` may give a value in place of the error
        (the innermost one that does decides)."""
        if name not in self._operators:
            raise KeyError(f"unknown operator '{name}'")
        began = time.time()
        try:
            for hooks in self._hooks:
                if hooks.before and (changed := hooks.before(name, parameters)) is not None:
                    parameters = changed
            outcome = Outcome(self._operators[name](*args, **parameters))
        except Exception as error:
            for hooks in reversed(self._hooks):
                if hooks.on_error and (value := hooks.on_error(name, error)) is not None:
                    outcome = Outcome(value, {"error": str(error)})
                    break
            else:
                raise
        outcome.meta["ms"] = round(1000 * (time.time() - began), 1)
        for hooks in reversed(self._hooks):
            if hooks.after:
                hooks.after(name, outcome)
        return outcome


#: Bounds of parameters, checked before an operator runs.
BOUNDS = {
    "expand": {"depth": (1, 3), "min_confidence": (0.0, 1.0)},
    "path_infer": {"max_hops": (1, 8), "min_confidence": (0.0, 1.0)},
    "dependency_closure": {"max_depth": (1, 10)},
    "impact_propagate": {"max_depth": (1, 6), "min_confidence": (0.0, 1.0)},
}


def check_bounds(name: str, parameters: dict) -> None:
    """Raises where a parameter lies outside of its bounds, or a limit, offset or number of rows is negative."""
    for p, (low, high) in BOUNDS.get(name, {}).items():
        if parameters.get(p) is not None and not low <= parameters[p] <= high:
            raise ValueError(f"{name}: {p} must be within {low}..{high}")
    for p in ("limit", "offset", "top_k", "n"):
        if parameters.get(p) is not None and parameters[p] < 0:
            raise ValueError(f"{name}: {p} must not be negative")


def default_registry() -> OperatorRegistry:
    """The named operators, the inspections of graph and ontology, staleness, the quality report and the drill-down."""
    from weftgraph import drilldown, quality
    from weftgraph.operators import graph, semantic

    registry = OperatorRegistry()
    for name in (
        "lookup", "resolve", "expand", "path_infer", "dependency_closure", "impact_propagate", "evidence_rank", "conflict_detect", "fact_merge", "candidate_discover", "attach_score",
        "filter_facts", "filter_segments", "filter_concepts", "semantic_search", "edu_search", "cross_layer_check", "reasoning_chain", "context_facts", "context_segments", "context_evidence",
    ):
        registry.register(name, getattr(semantic, name))
    for name in ("isolated_nodes", "super_nodes", "degree_distribution", "predicate_concentration"):
        registry.register(f"graph_inspect.{name}", getattr(semantic, name))
    registry.register("graph_inspect.cycles", lambda k, relation="DEPENDS_ON", longest=5: graph.cycles(k.edge, relation, longest))
    registry.register("graph_inspect.components", lambda k: graph.components(k.edge.select("src", "dst")))
    for name in ("cross_layer_check", "inheritance_stats"):
        registry.register(f"ontology_inspect.{name}", getattr(semantic, name))
    registry.register("ontology_inspect.predicate_overlap", lambda k, least=0.3: quality.predicate_overlap(k.edge, least))
    registry.register("ontology_inspect.similar_nodes", quality.similar_nodes)
    for name in ("stale_facts", "stale_documents", "weak_evidence"):
        registry.register(f"stale_knowledge.{name}", getattr(semantic, name))
    registry.register("ontology_quality", quality.report)
    registry.register("evolution_gate", lambda candidates, **columns: candidates.withColumn("reasons", semantic.gate_reasons(**columns)))
    registry.register("drilldown", drilldown.drilldown)
    registry.use(Hooks(before=lambda name, parameters: check_bounds(name, parameters)))
    return registry
