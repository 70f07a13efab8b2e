"""Validation, planning and running of plans."""

import os

import pytest

from weftgraph.knowledge import Knowledge, portable
from weftgraph.plans import PlanError, QueryEngine, validate, waves

RELATIONS = {"depends_on", "requires"}
SEED = {"op": "seed", "as": "$a", "by": "id", "target": "node", "value": ["x"]}
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("steps", "message"),
    [
        ([], "at least one step"),
        ([SEED] * 21, "at most 20"),
        ([{**SEED, "op": "scan"}], "unknown op"),
        ([{**SEED, "as": "a"}], "must be a variable"),
        ([SEED, SEED], "duplicate variable"),
        ([{**SEED, "by": "luck"}], "seed.by"),
        ([{**SEED, "target": "edge"}], "seed.target"),
        ([{k: v for k, v in SEED.items() if k != "value"}], "requires 'value'"),
        ([{**SEED, "by": "embedding", "top_k": 501}], "top_k"),
        ([SEED, {"op": "expand", "as": "$b", "from": "$a"}], "any_of"),
        ([SEED, {"op": "expand", "as": "$b", "from": "$a", "any_of": ["requires"], "sequence": ["requires"]}], "exclusive"),
        ([SEED, {"op": "expand", "as": "$b", "from": "$a", "any_of": []}], "non-empty"),
        ([SEED, {"op": "expand", "as": "$b", "from": "$a", "any_of": ["likes"]}], "unknown edge type"),
        ([SEED, {"op": "expand", "as": "$b", "from": "$a", "any_of": ["requires"], "depth": 11}], "depth"),
        ([SEED, {"op": "expand", "as": "$b", "from": "$a", "any_of": ["requires"], "confidence_decay": 0}], "confidence_decay"),
        ([SEED, {"op": "expand", "as": "$b", "from": "$a", "any_of": ["requires"], "direction": "up"}], "direction"),
        ([SEED, {"op": "expand", "as": "$b", "from": "$c", "any_of": ["requires"]}], "undefined variable"),
        ([SEED, {"op": "combine", "as": "$b", "method": "xor", "sets": ["$a", "$a"]}], "combine.method"),
        ([SEED, {"op": "combine", "as": "$b", "method": "union", "sets": ["$a"]}], ">= 2"),
        ([SEED, {"op": "combine", "as": "$b", "method": "subtract", "sets": ["$a", "$a", "$a"]}], "exactly 2"),
        ([SEED, {"op": "aggregate", "as": "$b", "from": "$a", "function": "median"}], "aggregate.function"),
        ([SEED, {"op": "aggregate", "as": "$b", "from": "$a", "function": "rank", "limit": 0}], "limit"),
        ([SEED, {"op": "project", "as": "$b", "from": "$a", "fields": []}], "project.fields"),
    ],
)
def test_errors_are_told(steps, message):
    assert any(message in e for e in validate({"steps": steps}, RELATIONS))


def test_a_good_plan_has_no_errors():
    steps = [SEED, {"op": "expand", "as": "$b", "from": "$a", "any_of": ["requires", "tagged_in"], "depth": "unlimited"}, {"op": "combine", "as": "$c", "method": "union", "sets": ["$a", "$b"]}]
    assert validate({"steps": steps}, RELATIONS) == []


def test_waves():
    s = lambda name, *reads: {"as": name, "sets": list(reads)}
    assert waves([s("$a"), s("$b"), s("$c", "$a"), s("$d", "$b"), s("$e", "$c", "$d"), s("$f", "$e")]) == [[0, 1], [2, 3], [4], [5]]
    with pytest.raises(ValueError):
        waves([s("$a", "$b"), s("$b", "$a")])


def test_portable_lists_views_in_order():
    text = portable("SELECT count(*) FROM {v_evidence} WHERE x ~ '\\d{4}'")
    assert text.index("v_fact AS") < text.index("v_evidence AS") and "{" not in text.replace("{4}", "")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_results_are_serialized(spark):
    engine = QueryEngine(Knowledge(spark, FOLDER))
    plan = {"steps": [{**SEED, "value": ["MECH.1", "MECH.2"]}, {"op": "aggregate", "as": "$n", "from": "$a", "function": "count"}, {"op": "project", "as": "$p", "from": "$a", "fields": ["node_id", "layer"]}]}
    out = engine.run(plan).serialize()
    assert out["result"]["$n"] == {"value": 2} and out["result"]["$a"] == {"count": 2, "truncated": False}
    assert out["result"]["$p"] == [{"node_id": "MECH.1", "layer": "mechanism"}, {"node_id": "MECH.2", "layer": "mechanism"}]
    assert [s["op"] for s in out["meta"]["steps_detail"]] == ["seed", "aggregate", "project"]
    with pytest.raises(PlanError):
        engine.run({"steps": [{**SEED, "by": "attribute", "target": "segment", "value": {"raw_text; drop": 1}}]})
    with pytest.raises(PlanError):
        engine.run({"steps": []})
