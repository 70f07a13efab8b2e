"""Text, hashing, segmentation, extraction and governance on hand-made rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weftgraph import governance
from weftgraph.functions import hashing, model_output, scoring, text
from weftgraph.pipeline import align, dedup, extract, index, ingest, segment


def one(spark, expression, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns[n] for n in names)], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for n, v in columns.items()))
    return df.select(expression.alias("x")).first()[0]


TERMS = {"BGP-4": "bgp 4", "BGP v4": "bgp 4", "BGPv4": "bgp 4", "MPLS-TE": "mpls-te", "IS-IS": "is-is", "Router-ID": "router id", "Router IDs": "router id", "OSPF Router-ID": "ospf router id", "the BGP protocol": "bgp protocol", "network layer reachability information (NLRI)": "network layer reachability information", "broadcast networks": "broadcast network", "policies": "policy", "addresses": "address", "": "", "dns": "dns"}


@pytest.mark.parametrize(("term", "want"), TERMS.items())
def test_normalize_term(spark, term, want):
    assert one(spark, text.normalize_term(F.col("t")), t=term) == want


def test_abbreviation(spark):
    assert one(spark, text.abbreviation(F.col("t")), t="Border Gateway Protocol (BGP)") == "BGP"
    assert one(spark, text.abbreviation(F.col("t")), t="simple text") is None


def test_normalize(spark):
    assert one(spark, text.normalize(F.col("t")), t=" ＢＧＰ，  路由…\n\nx ") == "bgp, 路由... x"
    assert one(spark, text.normalize(F.col("t"), True), t=" A  b \n \n c\td ") == "a b\n\nc d"
    assert one(spark, text.normalize(F.col("t")), t=None) == ""


def test_tokens_and_windows(spark):
    assert one(spark, text.token_count(F.col("t")), t="two 世界 words") == 4
    assert one(spark, text.token_count(F.col("t")), t=None) == 0
    assert one(spark, text.sliding_windows(F.col("t"), 4, 1), t="a b c d e f g") == ["a b c d", "d e f g"]
    assert one(spark, text.sliding_windows(F.col("t"), 4, 1), t="a b") == ["a b"]
    assert segment.windows("a b c d e f g", 4, 1) == ["a b c d", "d e f g"]


def simhash(t):
    words = re.findall("[㐀-䶿一-鿿]", t) + [w.lower() for w in re.findall("[a-zA-Z0-9]+", t) if len(w) > 1]
    votes = [0] * 64
    for w in words:
        h = int(hashlib.md5(w.encode()).hexdigest(), 16)
        votes = [v + (1 if h >> i & 1 else -1) for i, v in enumerate(votes)]
    value = sum(1 << i for i, v in enumerate(votes) if v > 0)
    return value - (1 << 64) if value >> 63 else value


def test_simhash_and_pairs(spark):
    texts = ["The router drops 世界 packets", "", "a", "the the the router", "x1 y2 z3 路由路由"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "id int, t string")
    got = {r.id: r.simhash for r in hashing.simhash(df, "id", "t").collect()}
    assert got == {**{i: simhash(t) for i, t in enumerate(texts)}, 9: 0}
    prints = spark.createDataFrame([(1, 0), (2, 7), (3, 15), (4, -1), (5, None)], "id int, p long")
    assert {tuple(r) for r in hashing.hamming_pairs(prints, "id", "p", 3).collect()} == {(1, 2, 3), (2, 3, 1)}


def test_scores(spark):
    assert one(spark, scoring.score_fact(F.lit("S"), F.lit("manual"), F.lit(1.0), F.lit(1.0), F.lit(1.0)), x=1) == 1.0
    assert one(spark, scoring.score_fact(F.lit("?"), F.lit("?"), F.lit(0.0), F.lit(0.0), F.lit(0.0)), x=1) == 0.26
    assert [one(spark, scoring.temporal_validity(F.col("d")), d=d) for d in (365, 366, 1825, 1826)] == [1.0, 0.85, 0.7, 0.5]


def test_sections_by_headings_numbers_and_blocks():
    assert segment.sections("# A\nx\n## B\ny\n# C\nz") == [(["A"], "A", "x"), (["A", "B"], "B", "y"), (["C"], "C", "z")]
    # one blank after the number is enough, since an earlier step collapses blanks
    assert segment.sections("1. Title\nx\n1.1 Sub\ny\nGENERAL TERMS\nz") == [(["Title"], "Title", "x"), (["Title", "Sub"], "Sub", "y"), (["General Terms"], "General Terms", "z")]
    assert segment.sections("one\n\n\n\ntwo") == [([], "one", "one"), ([], "two", "two")]
    assert segment.sections("") == []


def test_merging_and_length_control():
    parts = [(["A"], "A", k, "w " * n) for k, n in (("fault", 500), ("fault", 500), ("fault", 100), ("unknown", 20), ("unknown", 20))]
    assert [segment.count_tokens(p[3]) for p in segment.merged(parts)] == [1000, 100, 20, 20]
    long_ = " ".join(f"word{i} ends here." for i in range(700))
    pieces = segment.controlled(long_)
    assert all(segment.count_tokens(p) <= 512 for p in pieces) and " ".join(pieces) == long_
    assert segment.sentences("One two. However three. Four.")[1].startswith("However")


def test_segments_of_documents(spark):
    body = "word " * 20
    df = spark.createDataFrame([(1, f"# T\n{body}\n\nshort\n\n{body}"), (2, None), (3, "")], "source_doc_id long, text string")
    got = segment.segment_documents(df).collect()
    assert [(r.source_doc_id, r.segment_index, r.section_path, r.segment_type) for r in got] == [(1, 0, ["T"], "unknown"), (1, 1, ["T"], "unknown")]


def test_repeated_lines_of_a_text(spark):
    line = "this line is long enough to be counted as repeated"
    t = "\n".join([line, "a", line + " ", "b", "a", "a", line])
    assert one(spark, ingest.remove_repeated_lines(F.col("t")), t=t) == "a\nb\na\na"
    assert one(spark, ingest.remove_repeated_lines(F.col("t")), t="\n".join([line, line])) == "\n".join([line, line])


def test_html(spark):
    html = "<html><title> A <b>B</b></title><style>x</style><body><h2> Head <i>x</i> </h2><p>one</p><p>two<br>three</p></body></html>"
    assert one(spark, ingest.html_title(F.col("h")), h=html) == "A B"
    assert one(spark, ingest.html_to_text(ingest.preprocess_html(F.col("h"))), h=html).endswith("## Head x\n\none\n\ntwo\nthree")
    assert one(spark, ingest.is_plaintext(F.col("h"), F.lit("u")), h=html) is False
    assert one(spark, ingest.is_plaintext(F.col("h"), F.lit("u")), h="1 < 2 plain") is True


def test_identical_documents_keep_the_earliest(spark):
    df = spark.createDataFrame([(1, "h", 5), (2, "h", 3), (3, None, 1), (4, None, 2)], "source_doc_id int, content_hash string, crawl_time int")
    assert {r.source_doc_id for r in ingest.exact_duplicates(df).where("is_duplicate").collect()} == {1}


def test_short_terms_match_whole_words(spark):
    segments = spark.createDataFrame([(1, "The IP stack"), (2, "a shipment"), (3, "ship sp-1"), (4, None)], "segment_id int, text string")
    terms = spark.createDataFrame([("IP", "n1", 0.9), ("SP", "n2", 0.9), ("ship", "n3", 1.0), ("ship", "n3", 0.5), (None, "n4", 1.0)], "form string, node_id string, confidence double")
    assert {tuple(r) for r in align.find_terms(segments, terms).collect()} == {(1, "n1", 0.9), (2, "n3", 1.0), (3, "n3", 1.0), (3, "n2", 0.9)}


def test_tags_are_borrowed_along_strong_relations(spark):
    waiting = spark.createDataFrame([(1,), (2,)], "segment_id int")
    tags = spark.createDataFrame([(10, "n", 1.0), (11, "m", 0.6), (12, "k", 1.0)], "segment_id int, ontology_node_id string, confidence double")
    rst = spark.createDataFrame([(1, 10, "Elaboration", "SN"), (1, 11, "Elaboration", "NN"), (12, 2, "Contrast", "NS"), (1, 2, "Sequence", "NN")], "src_edu_id int, dst_edu_id int, relation_type string, nuclearity string")
    assert {tuple(r) for r in align.propagate(waiting, tags, rst).collect()} == {(1, "n", 0.9), (1, "m", 0.51)}


def test_quotes(spark):
    assert one(spark, extract.quote_supported(F.lit("Drops  ALL packets"), F.col("t")), t="the router drops all packets") is True
    assert one(spark, extract.quote_supported(F.lit("router packets all the drops"), F.col("t")), t="the router drops all packets") is True
    assert one(spark, extract.quote_supported(F.lit("drops"), F.col("t")), t="drops") is False
    assert one(spark, extract.quote_supported(F.lit(None).cast("string"), F.col("t")), t="x") is False


def test_relation_choice(spark):
    scores = F.create_map(F.lit("Contrast"), F.lit(0.4), F.lit("Evidence"), F.lit(0.7), F.lit("Nonsense"), F.lit(0.9))
    assert one(spark, extract.rst_argmax(scores, F.lit("Sequence")), x=1) == "Evidence"
    assert one(spark, extract.rst_argmax(F.create_map().cast("map<string,double>"), F.lit("Sequence")), x=1) == "Sequence"
    assert one(spark, extract.rst_argmax(F.create_map().cast("map<string,double>"), F.lit("?")), x=1) == "Elaboration"


def test_model_answers(spark):
    assert one(spark, model_output.parsed(F.col("a"), "array<struct<s:string,n:int>>"), a='Sure:\n```json\n[{"s": "x", "n": 2}]\n``` done')[0].n == 2
    assert one(spark, model_output.parsed(F.col("a"), "array<struct<s:string>>"), a="no json") is None
    assert one(spark, model_output.allowed(F.col("a"), ("Fault", "Config"), "unknown"), a=" fault ") == "Fault"


def test_triples_and_edges(spark):
    facts = spark.createDataFrame([("f1", "a", "p", "b", 0.9, "active"), ("f2", "a", "p", "b", 0.7, "active"), ("f3", "a", "p", "c", 0.4, "active"), ("f4", "a", "p", "d", 0.9, "conflicted")], "fact_id string, subject string, predicate string, object string, confidence double, lifecycle_state string")
    assert [tuple(r) for r in index.edges(facts).collect()] == [("a", "P", "b", "p", 0.9, 2)]
    assert {r.fact_id: r.lifecycle_state for r in dedup.merge_same_triples(facts).collect()}["f2"] == "superseded"
    assert {tuple(r) for r in dedup.functional_conflicts(facts, ["p"]).collect()} == {("f1", "f3", "conflict"), ("f2", "f3", "conflict")}
    assert {r.fact_id for r in dedup.conflicted_facts(facts, ["p"]).collect()} == {"f1", "f2", "f3"}
    assert one(spark, index.relation_type(F.lit("runs-on top")), x=1) == "RUNS_ON_TOP"


def test_routing_and_resuming(spark):
    df = spark.createDataFrame([("faq", 1), ("spec", 2), (None, 3)], "kind string, n int")
    stages = [("double", lambda d: d.withColumn("n", F.col("n") * 2)), ("inc", lambda d: d.withColumn("n", F.col("n") + 1))]
    assert {r.n for r in index.run(stages, df).collect()} == {3, 5, 7}
    assert {r.n for r in index.run(stages, df, start="inc").collect()} == {2, 3, 4}
    routed = index.run(stages, df, route=("kind", {"faq": lambda d: d.withColumn("n", F.lit(100))}))
    assert {r.n for r in routed.collect()} == {201, 5, 7}


def test_governance(spark):
    nodes = spark.createDataFrame([("A", "a", "concept", "active", None), ("B", "", "nowhere", "active", "Z"), ("A", "a", "concept", "active", "A")], "node_id string, canonical_name string, layer string, lifecycle_state string, parent_id string")
    assert sorted((r.node_id, r.problem) for r in governance.validate_ontology(nodes).collect()) == [("A", "double id"), ("B", "no canonical_name"), ("B", "unknown layer"), ("B", "unknown parent")]
    assert governance.next_version("v0.1.9") == "v0.1.10"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", None)], "id int, s string, n int")
    assert {tuple(r) for r in governance.upsert(old, new, "id").collect()} == {(1, "a", 1), (2, "b", 5), (3, "c", None)}


def test_pool_is_the_same_when_run_again(spark):
    shape = "normalized_form string, surface_forms array<string>, doc_ids array<long>, first_seen_at int, last_seen_at int"
    old = spark.createDataFrame([("x", ["X"], [1], 1, 2)], shape)
    new = spark.createDataFrame([("x", ["x", "X"], [1, 2], 0, 3), (None, ["y"], [1], 1, 1), (" ", None, None, 1, 1), ("z", None, None, 1, 1)], shape)
    pool = align.pool_candidates(old, new)
    again = align.pool_candidates(pool.drop("source_count"), new)
    assert {tuple(map(str, r)) for r in pool.collect()} == {tuple(map(str, r)) for r in again.collect()}
    assert {r.normalized_form: r.source_count for r in pool.collect()} == {"x": 2, "z": 0}
