"""Topological levels of a plan. Spark is lazy, so they say what may be materialised side by side, no more."""

from __future__ import annotations

from weftgraph.plans.validator import references


def waves(steps: list[dict]) -> list[list[int]]:
    """Step numbers level by level: a step stands one level after the last it reads; a cycle is an error."""
    writer = {step.get("as"): i for i, step in enumerate(steps)}
    reads = [{writer[v] for v in references(step) if v in writer} for step in steps]
    level: dict[int, int] = {}
    while len(level) < len(steps):
        ready = [i for i in range(len(steps)) if i not in level and reads[i] <= level.keys()]
        if not ready:
            raise ValueError("circular dependency in the plan")
        level.update({i: max((level[j] + 1 for j in reads[i]), default=0) for i in ready})
    return [sorted(i for i, n in level.items() if n == k) for k in range(max(level.values(), default=-1) + 1)]
