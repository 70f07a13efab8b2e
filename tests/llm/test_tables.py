"""Queries without SQL over whole tables, against what must hold of every row."""

import os
import re
from collections import defaultdict

import pytest

from weftgraph.llm import queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


@pytest.fixture(scope="module")
def segments(spark):
    return {r.segment_id: r for r in spark.read.parquet(f"{FOLDER}/segments.parquet").collect()}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def count(text):
    return len(re.findall("[㐀-䶿一-鿿]", text)) + len(re.sub("[㐀-䶿一-鿿]", " ", text).split())


def test_groups_are_the_components_of_the_pairs(spark):
    pairs, groups = rows(spark, "p1_found"), {r.segment_id: r for r in rows(spark, "p1_groups")}
    root = {s: s for s in groups}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    sides = defaultdict(set)
    for s, r in groups.items():
        sides[find(s)].add(r.group_id)
    assert all(len(g) == 1 for g in sides.values()) and len({*map(min, sides.values())}) == len(sides)
    linked = {x for p in pairs for x in p}
    assert linked <= set(groups)


def test_cleaned_segments_lack_the_found_lines_only(spark, segments):
    drop = defaultdict(set)
    for s, n in rows(spark, "p3_found"):
        drop[s].add(n)
    got = {r.segment_id: r.text for r in rows(spark, "p3_cleaned")}
    assert set(got) == set(segments)
    for s, r in segments.items():
        assert got[s] == "\n".join(x for i, x in enumerate(r.raw_text.split("\n")) if i not in drop[s])


def test_frequent_lines_have_a_template(spark, segments):
    found = rows(spark, "p3_found")
    templates = {(r.site_key, r.template) for r in rows(spark, "p3_templates")}
    token = lambda w: "<*>" if re.search(r"\d", w) else w
    seen = 0
    for s, n in found:
        line = segments[s].raw_text.split("\n")[n]
        words = [token(w) for w in re.findall(r"[^\W_]+", line.lower())]
        seen += (segments[s].site_key, " ".join(words)) in templates
    # others differ in how their words are cut apart, or have too few letters outside of slots
    assert found and seen >= 0.9 * len(found)


def test_pieces_make_up_every_segment(spark, segments):
    pieces = defaultdict(list)
    for r in rows(spark, "p5_pieces"):
        pieces[r.segment_id].append(r)
    assert set(pieces) == set(segments)
    for s, listed in pieces.items():
        listed.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in listed] == list(range(listed[0].n_pieces)) and all(r.n_tokens == count(r.text) <= 1024 for r in listed)
        if len(listed) == 1:
            assert listed[0].text == segments[s].raw_text
        tokens = lambda t: re.findall("[㐀-䶿一-鿿]|[^\\s㐀-䶿一-鿿]+", t)
        whole = tokens(listed[0].text)
        for before, after in zip(listed, listed[1:]):
            assert after.first_token == before.first_token + before.n_tokens - 64
            whole += tokens(after.text)[64:]
        assert whole == tokens(segments[s].raw_text)
    by_document = defaultdict(list)
    for listed in pieces.values():
        for r in listed:
            by_document[r.doc_id].append((r.chunk_no, r.segment_index, r.piece_no))
    for listed in by_document.values():
        listed.sort()
        assert [c for c, _, _ in listed] == list(range(len(listed))) and [i for _, i, _ in listed] == sorted(i for _, i, _ in listed)


def test_every_typed_form_is_answered_once(spark):
    from pyspark.sql import functions as F

    got = rows(spark, "p6_found")
    candidates = spark.read.parquet(f"{FOLDER}/evolution_candidates.parquet").where(F.trim("normalized_form") != "").select("candidate_id").distinct()
    pending = spark.read.parquet(f"{FOLDER}/lexicon_aliases.parquet").where("canonical_node_id is null").where(F.trim("surface_form") != "").select("alias_id").distinct()
    want = {("candidate", r[0]) for r in candidates.collect()} | {("alias", r[0]) for r in pending.collect()}
    assert {(r.record_kind, r.record_id) for r in got} == want
    nodes = {r.node_id for r in spark.read.parquet(f"{FOLDER}/ontology_nodes.parquet").collect()}
    assert {r.canonical_node_id for r in got} <= nodes | {"UNMATCHED"}


def test_bodies_are_what_is_no_furniture(spark, segments):
    drop = defaultdict(set)
    for s, n in rows(spark, "p7_found"):
        assert segments[s].raw_text.split("\n")[n].strip()
        drop[s].add(n)
    want = defaultdict(list)
    for s, r in sorted(segments.items(), key=lambda x: (x[1].segment_index, x[0])):
        text = "\n".join(x for i, x in enumerate(r.raw_text.split("\n")) if i not in drop[s])
        text = re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", text)
        if text:
            want[r.source_doc_id].append(text)
    got = {r.doc_id: r.body for r in rows(spark, "p7_bodies")}
    for d in {r.source_doc_id for r in segments.values()}:
        assert got[d] == "\n\n".join(want[d]), d


def test_containers_hold_every_token_once(spark, documents):
    from weftgraph.llm.packing import count_tokens

    if not os.path.exists(queries.TOKENIZER):
        pytest.skip("no vocabulary file")
    size, fill = defaultdict(list), defaultdict(int)
    for r in rows(spark, "p8_packed"):
        size[r.doc_id].append((r.first_token, r.n_tokens))
        fill[r.container] += r.n_tokens
    assert set(size) == set(documents) and max(fill.values()) <= 2048
    for d, r in documents.items():
        n = count_tokens([r.text or ""], queries.TOKENIZER)[0]
        parts = sorted(size[d])
        assert sum(t for _, t in parts) == n and (n > 2048 or len(parts) == 1) and all(a + t == b for (a, t), (b, _) in zip(parts, parts[1:]))
    one = rows(spark, "p8_fill")[0]
    assert (one.n_containers, one.n_tokens, one.fullest) == (len(fill), sum(fill.values()), max(fill.values()))


def test_shared_parts_belong_to_pairs(spark, documents):
    pairs, shared = rows(spark, "p10_found"), {r.doc_id: r for r in rows(spark, "p10_shared")}
    met = {x for p in pairs for x in p}
    assert set(shared) == set(documents)
    for d, r in shared.items():
        assert r.n_chars == len(documents[d].text or "") and (r.shared_chars >= 300) == (d in met) and r.shared_chars <= r.n_chars


def test_leaks_hold_the_verbatim_ones(spark):
    found, leaks = {tuple(r) for r in rows(spark, "p9_found")}, rows(spark, "p9_leaks")
    assert {(r.doc_id, r.item_id) for r in leaks if r.kind == "verbatim"} == found
    assert all(r.n_words >= 13 for r in leaks)
