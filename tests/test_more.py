"""Governance, the report, hooks of models, sources and late events on hand-made rows."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from weftgraph import governance as G
from weftgraph import quality as Q
from weftgraph.functions import hashing, text
from weftgraph.functions.vectors import embedded
from weftgraph.operators.registry import default_registry
from weftgraph.pipeline import align, extract, ingest, segment
from weftgraph.sources import scope, stage
from weftgraph.sources.readers import read_files, read_json_lines, read_yaml
from weftgraph.streaming import event_windows, run_once


def test_truncate_with_ideographs(spark):
    rows = [("a b c d", 3), ("路由器 drops 世界 packets", 5), ("路由器的协议", 3), ("short", 3), ("", 3), (None, 3)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in df.select(text.truncate(F.col("t"), 3)).collect()] == ["a b c", "路由器", "", "short", "", None]
    assert df.select(text.truncate(F.col("t"), 5)).collect()[1][0] == "路由器 drops"


def test_normalized_text_is_nfkc(spark):
    texts = ["ＢＧＰ，路由", "ﬁne ①②", "é", "x y", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(text.normalize(F.col("t"))).collect()]
    assert all(g == unicodedata.normalize("NFKC", g) for g in got) and got[0].startswith("bgp") and got[1] == "fine 12"


def test_hamming_pairs_by_two_blocks(spark):
    import itertools
    import random

    pick = random.Random(3)
    values = [pick.getrandbits(64) for _ in range(40)]
    for v in values[:30]:
        for bit in pick.sample(range(64), pick.randint(0, 5)):
            v ^= 1 << bit
        values.append(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id int, p long")
    want = {(a, b, bin(values[a] ^ values[b]).count("1")) for a, b in itertools.combinations(range(len(values)), 2)}
    for most in (1, 3):
        assert {tuple(r) for r in hashing.hamming_pairs(df, "id", "p", most).collect()} == {w for w in want if w[2] <= most}


def test_clean_up(spark):
    rows = [
        (1, ["a"], "auto_rejected", "llm:noise", 4, "2024-06-01", None),
        (2, ["b", "B"], "auto_rejected", "embedding_variant:IP.X:0.93", 4, "2024-06-01", [7, 8]),
        (3, ["c"], "auto_rejected", "llm:variant: Some Name ", 4, "2024-06-01", [9, None]),
        (4, ["d"], "auto_rejected", "llm: variant", 4, "2024-06-01", [1]),
        (5, ["e"], "discovered", None, 1, "2024-01-01", None),
        (6, ["f"], "discovered", None, 1, "2024-06-20", None),
        (7, None, None, None, None, None, None),
        (8, ["h"], "accepted", "llm:noise", 1, "2020-01-01", None),
    ]
    candidates = spark.createDataFrame(rows, "candidate_id long, surface_forms array<string>, review_status string, review_note string, source_count int, last_seen_at string, example_segments array<long>").withColumn("last_seen_at", F.to_date("last_seen_at"))
    nodes = spark.createDataFrame([("IP.X", "x"), ("IP.Y", "Some name")], "node_id string, canonical_name string")
    done = G.clean_up(candidates, nodes, spark.createDataFrame([("alias", "IP.X")], "surface_form string, canonical_node_id string"), F.lit("2024-06-30").cast("date"))
    kept = {r.candidate_id: (r.review_status, r.review_note) for r in done.candidates.collect()}
    assert kept == {2: ("variant_merged", "merged_into:IP.X"), 3: ("variant_merged", "merged_into:IP.Y"), 6: ("discovered", None), 7: (None, None), 8: ("accepted", "llm:noise")}
    assert {(r.segment_id, r.ontology_node_id) for r in done.tags.collect()} == {(7, "IP.X"), (8, "IP.X"), (9, "IP.Y")}
    assert {tuple(r) for r in done.aliases.collect()} == {("b", "IP.X"), ("B", "IP.X"), ("c", "IP.Y")}


def test_review_merge_and_retro_facts(spark):
    candidates = spark.createDataFrame([(1, ["a"], 2), (2, ["b", "a"], 3), (3, None, None), (4, ["z"], 9)], "candidate_id long, surface_forms array<string>, source_count int")
    groups = spark.createDataFrame([("g", 1, False), ("g", 2, True), ("g", 3, None), ("h", 4, True)], "group_id string, candidate_id long, is_primary boolean")
    assert {(r.candidate_id, tuple(r.surface_forms), r.source_count) for r in G.review_merge(candidates, groups).collect()} == {(2, ("b", "a"), 5), (4, ("z",), 9)}
    shape = "normalized_form string, examples array<struct<subject:string,object:string,segment_id:string,source_doc_id:string>>"
    facts, evidence = G.retro_facts(spark.createDataFrame([("uses", [("A", "B", "1", "d"), ("A", "B", "2", "d"), ("", "B", "3", "d"), ("A", None, "3", "d")]), ("none", None)], shape))
    assert [(r.subject, r.predicate, r.object, r.confidence) for r in facts.collect()] == [("A", "uses", "B", 0.65)] and evidence.count() == 2


def test_cosine_links_and_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.05]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, 0.0, 0.0])], "candidate_id long, vec array<double>")
    want = {(1, 2)}
    assert {tuple(r) for r in G.cosine_links(vectors.where("candidate_id <> 6")).collect()} == want
    monkeypatch.setattr(align, "BLOCK_NODES", 2)
    assert {tuple(r) for r in G.cosine_links(vectors.where("candidate_id <> 6")).collect()} == want
    nodes = spark.createDataFrame([("n1", [1.0, 0.1], "concept"), ("n2", [1.0, 0.0], "method"), ("n3", [1.0, 0.0], "method")], "node_id string, vec array<double>, layer string")
    segments = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "segment_id long, vec array<double>")
    assert [(r.node_id, r.confidence) for r in align.embedding_match(segments, nodes).orderBy("similarity", "node_id").collect()] == [("n1", 0.8), ("n2", 0.8), ("n3", 0.8)]
    assert {r.node_id for r in align.embedding_match(segments, nodes, layers=["concept"]).collect()} == {"n1"}
    assert {r.node_id for r in align.embedding_match(segments, nodes, most=1).collect()} == {"n2"}


def test_new_concepts(spark):
    terms = spark.createDataFrame([(" Fresh Term ", None, "odd", 1, 2), ("known", "new_concept", "method", 1, 2), ("the", "new_concept", "concept", 1, 2), ("x", "noise", "concept", 1, 2), ("y", "variant", "concept", 1, 2), ("close", "new_concept", "method", 1, 2), ("", None, None, 1, 2), (None, None, None, 1, 2)], "term string, classification string, layer string, doc_id long, segment_id long")
    aliases, stop = spark.createDataFrame([("Known",)], "surface_form string"), spark.createDataFrame([("The",)], "word string")
    assert {(r.term, r.layer) for r in align.new_concepts(terms, aliases, stop).collect()} == {("Fresh Term", "concept"), ("close", "method")}
    vectors = spark.createDataFrame([("close", [1.0, 0.0]), ("Fresh Term", [0.0, 1.0])], "term string, vec array<double>")
    nodes = spark.createDataFrame([("n", [1.0, 0.1])], "node_id string, vec array<double>")
    assert {r.term for r in align.new_concepts(terms, aliases, stop, vectors, nodes).collect()} == {"Fresh Term"}


def test_model_triples_are_asked_for_and_verified(spark):
    contexts = spark.createDataFrame([(1, "text one", ["a", "b", "c"]), (2, "fails", ["a", "b", "c"])], "segment_id long, text string, nodes array<string>")

    def extractor(text, nodes):
        if text == "fails":
            raise RuntimeError
        return [{"subject": nodes[0], "predicate": f"p{i}", "object": nodes[1], "quote": "q"} for i in range(5)]

    triples = extract.model_triples(contexts, extractor)
    assert triples.count() == 5 and extract.model_triples(contexts, None).count() == 0
    sizes = lambda text, asked: [t["predicate"] != "p1" for t in asked] if len(asked) == 3 else None
    kept = extract.verified_triples(triples, contexts.select("segment_id", "text"), sizes)
    assert {r.predicate for r in kept.collect()} == {"p0", "p2", "p3", "p4"}
    segments = spark.createDataFrame([(1, "one"), (2, "two")], "segment_id long, raw_text string")
    rst = spark.createDataFrame([(1, 2, "Elaboration", "NS"), (2, 1, "Contrast", "NN")], "src_edu_id long, dst_edu_id long, relation_type string, nuclearity string")
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "segment_id long, ontology_node_id string")
    found = extract.merged_contexts(segments, rst, tags).collect()
    assert [(r.segment_id, r.nodes) for r in found] == [(2, ["a", "b", "c"])] and found[0].text.endswith("one\ntwo")


def measured(**changed):
    good = dict(gini=0.2, super_ratio=0.0, isolation=0.0, tags_per_segment=3, ubiquitous=0, overlaps=[], top3_share=0.5, concentrated=0, used_in_facts=9, used=9, defined=10, similar=0, coverage={"a-b": 0.5}, alias_coverage=1.0, tag_rate=1.0, largest_share={"concept": 1.0, "global": 1.0}, fiedler={"concept": 0.5, "global": None}, cycles=0)
    return Q.Measured(**{**good, **changed})


def test_report_scores_and_issues():
    assert Q.issues(measured()) == []
    assert Q.scores(measured()) == {"granularity": 1.0, "orthogonality": 1.0, "cross_layer": 1.0, "discoverability": 0.97, "structural": 0.8, "overall": 0.954}
    bad = measured(gini=0.85, isolation=0.5, overlaps=[("p", "q", 0.6)], top3_share=0.9, coverage={"a-b": 0.05, "b-c": 0.1}, alias_coverage=0.4, largest_share={"concept": 0.6, "global": 0.4}, fiedler={"concept": 0.001, "global": 0.0}, cycles=2)
    assert [(d, i) for d, i, _ in Q.issues(bad)] == [("granularity", "high_gini"), ("granularity", "high_isolation"), ("orthogonality", "predicate_overlap:p/q"), ("orthogonality", "predicate_skew"), ("cross_layer", "layer_gap:a-b"), ("discoverability", "low_alias_coverage"), ("structural", "low_algebraic_connectivity:concept"), ("structural", "fragmented_layer:global"), ("structural", "dependency_cycle")]
    assert Q.scores(bad) == {"granularity": 0.5, "orthogonality": 0.5, "cross_layer": 0.15, "discoverability": 0.73, "structural": 0.3, "overall": 0.436}


def test_registry_checks_bounds():
    registry = default_registry()
    assert {"graph_inspect.super_nodes", "ontology_inspect.inheritance_stats", "stale_knowledge.stale_facts", "ontology_quality", "evolution_gate"} <= set(registry.names())
    for name, wrong in (("expand", {"depth": 4}), ("path_infer", {"max_hops": 0}), ("dependency_closure", {"max_depth": 11}), ("filter_facts", {"limit": -1})):
        with pytest.raises(ValueError):
            registry.run(name, None, **wrong)


def test_sources(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("nodes:\n  - node_id: IP.A\n    canonical_name: 甲\n    layer: concept\n    extra: 1\n  - node_id: IP.A\n    canonical_name: 乙\n  - just text\nrelations:\n  - id: uses\n    domain_hint: concept\n    range_hint: any\n")
    (tmp_path / "b.yaml").write_text("other: 1\n")
    nodes, relations, aliases = G.load_ontology(spark, str(tmp_path))
    assert [(r.node_id, r.canonical_name, r.lifecycle_state) for r in nodes.collect()] == [("IP.A", "乙", "active")] and aliases.count() == 0
    edges = spark.createDataFrame([("IP.A", "uses", "MECH.B"), ("MECH.B", "uses", "IP.A"), ("IP.A", "likes", "IP.A"), ("IP.A", None, "IP.A")], "src string, predicate string, dst string")
    assert {tuple(r) for r in G.validate_relations(relations, edges).collect()} == {("uses", "wrong subject", 1), ("likes", "not defined", 1)}
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nbroken\n')
    assert [(r.a, r._corrupt) for r in read_json_lines(spark, str(tmp_path / "c.jsonl"), "a int").collect()] == [(1, None), (None, "broken")]
    assert read_files(spark, str(tmp_path), "*.yaml").count() == 2
    assert read_yaml(spark, str(tmp_path), "relations", "id string, description string").first().id == "uses"


def test_late_events_are_dropped_after_the_watermark(spark, tmp_path):
    shape = "ts timestamp, event_type string, value double"
    batches = [["2024-01-01 00:10", "2024-01-01 00:50"], ["2024-01-01 06:00"], ["2024-01-01 06:10"], ["2024-01-01 00:20", "2024-01-01 06:30"], ["2024-01-01 12:00"], ["2024-01-01 18:00"]]
    for i, times in enumerate(batches):
        rows = spark.createDataFrame([(t, "x", 1.0) for t in times], "t string, event_type string, value double")
        rows.select(F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        (tmp_path / f"{i}").mkdir()
    import glob
    import os

    for i, path in enumerate(sorted(glob.glob(f"{tmp_path}/events/*.parquet"), key=os.path.getmtime)):
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    got = {(r.start.hour, r.n) for r in run_once(event_windows(stream, late="2 hours"), "append").collect()}
    # the event of 00:20 came hours after its window was closed; the window of 06:00 took all of its own
    assert (0, 2) in got and (6, 3) in got and (0, 3) not in got


def test_scope_removes_what_was_staged_in_it(spark):
    import os

    kept = stage(spark.range(3))
    with scope():
        inner = stage(spark.range(5))
        where = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(where) and inner.count() == 5
    assert not os.path.exists(where) and kept.count() == 3


def test_classified_paragraphs(spark):
    assert segment.checked_types(["fault", "odd", None], 5) == ["fault", "unknown", "unknown", "unknown", "unknown"] and segment.checked_types(None, 1) == ["unknown"]
    long_ = lambda w: " ".join([w] * 20)
    df = spark.createDataFrame([(1, f"{long_('menu')}\n\n{long_('fault')}\n\n{long_('fault')}\n\n{long_('other')}"), (2, None)], "source_doc_id long, text string")
    rows = segment.segment_documents(df, lambda texts: [{"menu": "noise", "fault": "fault"}.get(t.split()[0], "odd") for t in texts]).collect()
    assert [(r.segment_type, r.raw_text.split()[0]) for r in rows] == [("fault", "fault"), ("unknown", "other")] and rows[0].raw_text.count("fault") == 40

    def failing(texts):
        raise RuntimeError

    assert {r.segment_type for r in segment.segment_documents(df, failing).collect()} == {"unknown"}


def test_extractors_and_embedders(spark):
    pages = spark.createDataFrame([(1, "<p>one</p>"), (2, "<b>two</b>"), (3, None)], "page_id long, html string")

    def never(html):
        raise ValueError

    def second(html):
        return "x" * 300 if "two" in html else "short"

    assert {(r.page_id, r.extracted_by) for r in ingest.extracted_text(pages, [never, second]).collect()} == {(1, "rules"), (2, "second"), (3, "rules")}
    assert {r.page_id: r.text for r in ingest.extracted_text(pages).collect()} == {1: "one", 2: "two", 3: None}
    texts = spark.createDataFrame([(1, "abc"), (2, None), (3, " "), (4, "bad")], "id long, text string")

    def embedder(given):
        if "bad" in given:
            raise RuntimeError
        return [[float(len(t)), 1.0] for t in given]

    assert [(r.id, r.vec) for r in embedded(texts, embedder, batch=1).collect()] == [(1, [3.0, 1.0])] and embedded(texts, None).count() == 0
