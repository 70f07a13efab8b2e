import pytest

from weftgraph.operators.registry import Hooks, OperatorRegistry, default_registry


def test_hooks_run_around_an_operator():
    seen, registry = [], OperatorRegistry()
    registry.register("double", lambda x: 2 * x)
    registry.register("fail", lambda: 1 / 0)
    registry.use(Hooks(before=lambda n, p: seen.append("a") or {**p, "x": p["x"] + 1} if "x" in p else None, after=lambda n, o: seen.append("z")))
    registry.use(Hooks(before=lambda n, p: seen.append("b"), after=lambda n, o: seen.append("y")))
    assert registry.run("double", x=3).value == 8 and seen == ["a", "b", "y", "z"]
    with pytest.raises(ZeroDivisionError):
        registry.run("fail")
    registry.use(Hooks(on_error=lambda n, e: "rescued"))
    assert registry.run("fail").value == "rescued" and "error" in registry.run("fail").meta
    with pytest.raises(ValueError):
        registry.register("double", lambda: None)
    with pytest.raises(KeyError):
        registry.run("absent")


def test_default_registry_has_the_operators():
    assert {"lookup", "path_infer", "impact_propagate", "drilldown"} <= set(default_registry().names())
