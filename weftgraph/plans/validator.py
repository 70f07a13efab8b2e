"""Static checks of a plan: every problem is reported, nothing is run."""

from __future__ import annotations

import re

from weftgraph import model

_VARIABLE = re.compile(r"\$[A-Za-z_]\w*")


def _number(value, low: float, high: float, open_low: bool = False) -> bool:
    fits = isinstance(value, (int, float)) and not isinstance(value, bool)
    return fits and (value > low if open_low else value >= low) and value <= high


def _whole(value, low: int, high: int) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and low <= value <= high


def _seed(step: dict, relations: set[str]) -> list[str]:
    out = []
    if step.get("by") not in model.SEED_MODES:
        out.append(f"seed.by must be one of {list(model.SEED_MODES)}")
    if step.get("target") not in model.TARGETS:
        out.append(f"seed.target must be one of {list(model.TARGETS)}")
    if "value" not in step:
        out.append("seed requires 'value'")
    if step.get("by") == "embedding" and not _whole(step.get("top_k", 100), 1, model.MAX_TOP_K):
        out.append(f"top_k must be 1..{model.MAX_TOP_K}")
    return out


def _expand(step: dict, relations: set[str]) -> list[str]:
    out = []
    given = [k for k in ("any_of", "sequence") if k in step]
    if len(given) == 2:
        out.append("any_of and sequence are mutually exclusive")
    if not given:
        out.append("expand requires 'any_of' or 'sequence'")
    else:
        edges = step[given[0]]
        if not isinstance(edges, list) or not edges:
            out.append("edge type list must be non-empty")
        else:
            out += [f"unknown edge type '{e}'" for e in edges if e not in relations and e not in model.RESERVED_EDGES]
    if step.get("depth", 1) != "unlimited" and not _whole(step.get("depth", 1), 1, model.MAX_DEPTH):
        out.append(f"depth must be 1..{model.MAX_DEPTH} or 'unlimited'")
    if step.get("confidence_decay") is not None and not _number(step["confidence_decay"], 0, 1, open_low=True):
        out.append("confidence_decay must be in (0, 1]")
    if step.get("direction", "outbound") not in model.DIRECTIONS:
        out.append(f"direction must be one of {list(model.DIRECTIONS)}")
    if step.get("target") is not None and step["target"] not in model.TARGETS:
        out.append(f"target must be one of {list(model.TARGETS)}")
    return out


def _combine(step: dict, relations: set[str]) -> list[str]:
    out, sets = [], step.get("sets")
    if step.get("method") not in model.COMBINE_METHODS:
        out.append(f"combine.method must be one of {list(model.COMBINE_METHODS)}")
    if not isinstance(sets, list) or len(sets) < 2:
        out.append("combine.sets requires >= 2 variables")
    elif step.get("method") == "subtract" and len(sets) != 2:
        out.append("subtract requires exactly 2 sets")
    return out


def _aggregate(step: dict, relations: set[str]) -> list[str]:
    out = []
    if step.get("function") not in model.AGGREGATES:
        out.append(f"aggregate.function must be one of {list(model.AGGREGATES)}")
    if step.get("limit") is not None and not _whole(step["limit"], 1, model.MAX_TOP_K):
        out.append(f"limit must be 1..{model.MAX_TOP_K}")
    return out


def _project(step: dict, relations: set[str]) -> list[str]:
    fields = step.get("fields")
    return [] if isinstance(fields, list) and fields else ["project.fields must be a non-empty list"]


CHECKS = {"seed": _seed, "expand": _expand, "combine": _combine, "aggregate": _aggregate, "project": _project}


def references(step: dict) -> list[str]:
    """The variables a step reads."""
    sets = step.get("sets")
    return [v for v in (step.get("from"), step.get("input"), *(sets if isinstance(sets, list) else [])) if v]


def validate(plan: dict, relations: set[str]) -> list[str]:
    """The errors of a plan, in the order of its steps; empty if it can run."""
    steps = plan.get("steps")
    if not isinstance(steps, list) or not steps:
        return ["plan requires at least one step"]
    errors = [f"a plan has at most {model.MAX_STEPS} steps"] if len(steps) > model.MAX_STEPS else []
    known: set[str] = set()
    for i, step in enumerate(steps):
        found, name = [], step.get("as")
        if step.get("op") not in CHECKS:
            found.append(f"unknown op '{step.get('op')}'")
        else:
            found += CHECKS[step["op"]](step, relations)
        for ref in references(step):
            if not isinstance(ref, str) or not _VARIABLE.fullmatch(ref):
                found.append("variable reference must start with '$'")
            elif ref not in known:
                found.append(f"undefined variable '{ref}'")
        if not isinstance(name, str) or not _VARIABLE.fullmatch(name):
            found.append("'as' must be a variable such as '$x'")
        elif name in known:
            found.append(f"duplicate variable '{name}'")
        else:
            known.add(name)
        errors += [f"step[{i}]: {e}" for e in found]
    return errors
