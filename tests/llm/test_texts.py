"""Lines, pieces, names, bodies, containers and leaks: brute force, round trips, held-out accuracy."""

import os
import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import boilerplate, canonical, leaks, packing, queries, site_lines, splitting

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def count(text):
    return len(re.findall("[㐀-䶿一-鿿]", text)) + len(re.sub("[㐀-䶿一-鿿]", " ", text).split())


# ---- repeated lines


def test_repeated_lines_match_brute_force(spark):
    notice, pick = "All rights are reserved by the publisher", random.Random(1)
    rows = []
    for d in range(24):
        body = " ".join(pick.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(9))
        line = [notice, notice.upper() + " 2024!", "* " + notice.replace(" ", "  "), "版权所有保留一切权利未经书面许可不得转载摘编本页"][d % 4]
        rows.append((d * 10, d, "a" if d < 16 else "b", f"{body}\n{line}\nshort", "x"))
    rows += [rows[0], (900, 1, None, notice, "x"), (901, None, "a", notice, "x"), (902, 2, "a", None, "x"), (903, 3, "a", "", "x"), (None, 3, "a", notice, "x")]
    df = spark.createDataFrame(rows, "segment_id long, doc_id long, site_key string, raw_text string, leaf string")
    documents, places = defaultdict(set), defaultdict(set)
    for s, d, site, text, _ in rows:
        if None not in (s, d, site, text):
            for i, x in enumerate(text.split("\n")):
                key = (site, "".join(c for c in x.lower() if c.isalpha()))
                if len(key[1]) >= 20:
                    documents[key].add(d)
                    places[key].add((s, i))
    want = {p for k in documents if len(documents[k]) >= 6 for p in places[k]}
    found = site_lines.repeated_lines(df, 6, 20)
    assert {tuple(r) for r in found.collect()} == want
    clean = {r.segment_id: r.text for r in site_lines.without_lines(df, found).collect()}
    for s, d, site, text, _ in rows:
        if s is not None and text is not None:
            assert clean[s] == "\n".join(x for i, x in enumerate(text.split("\n")) if (s, i) not in want)
    assert clean[902] is None
    assert site_lines.repeated_lines(df.limit(0)).count() == 0 and site_lines.templates(df.limit(0)).count() == 0


def test_only_lines_on_paths_that_cover_enough_are_counted(spark, monkeypatch):
    pick, counted, count = random.Random(5), [], site_lines.leaves
    # one wording, cut apart differently in each document; bodies whose paths cover one line; and a path of six lines
    # (equal number of letters and equal ends) of two wordings, neither of which is in six documents
    cuts = ["All rights are reserved by us", "ALL RIGHTS are reserved by us 2024", "All-rights-are-reserved-by-us", "Allrights arereserved byus", "1 All 2 rights 3 are reserved by us", "* A l l rights are reserved b y u s!"]
    rows = [(d, d, "a", "\n".join([" ".join(pick.choice("abcdefgh") * 5 for _ in range(9)), cut, ["beginning then some ending here", "beginning then more ending here"][d % 2]])) for d, cut in enumerate(cuts)]
    df = spark.createDataFrame(rows, "segment_id long, doc_id long, site_key string, raw_text string")
    monkeypatch.setattr(site_lines, "leaves", lambda lines: (counted.append({(r.segment_id, r.line_no) for r in lines.collect()}), count(lines))[1])
    assert {tuple(r) for r in site_lines.repeated_lines(df, 6, 20).collect()} == {(d, 1) for d in range(6)}
    assert counted == [{(d, n) for d in range(6) for n in (1, 2)}]


def test_templates_come_from_merged_trees(spark):
    names, pick = [f"name{chr(97 + i)}{chr(97 + i)}" for i in range(24)], random.Random(2)
    rows = []
    for d in range(24):
        body = " ".join(pick.choice("abcdefghijklmnop") * 4 for _ in range(11))
        rows.append((d, d, "a", f"Reviewed by {names[d]} of the network desk, {d} min read\n{body}\nAll rights are reserved by the publisher {2000 + d}"))
        rows.append((100 + d, d, "b", f"Only {names[d]} stands here and {names[-1 - d]} follows it"))
    df = spark.createDataFrame(rows, "segment_id long, doc_id long, site_key string, raw_text string")
    got = {(r.site_key, r.template): (r.n_documents, r.n_wordings, r.n_lines) for r in site_lines.templates(df).collect()}
    # no wording of the first line is frequent by itself; the merged tree makes its name a slot
    assert got == {
        ("a", "reviewed by <*> of the network desk <*> min read"): (24, 24, 24),
        ("a", "all rights are reserved by the publisher <*>"): (24, 1, 24),
        ("b", "only <*> stands here and <*> follows it"): (24, 24, 24),
    }
    assert {r.line_no for r in site_lines.repeated_lines(df).collect()} == {2}
    again = {(r.site_key, r.template): (r.n_documents, r.n_wordings, r.n_lines) for r in site_lines.templates(df.repartition(7)).collect()}
    assert again == got


def test_tokens_of_a_line(spark):
    row = spark.createDataFrame([("* Page 3 of 12: see V2, please",)], "x string").select(site_lines.words(F.col("x"))).first()
    assert row[0] == ["page", "<*>", "of", "<*>", "see", "<*>", "please"]


# ---- splitting


@given(st.lists(st.sampled_from(["word", "世", "界", ".", "。", "\n", "\n\n", " ", "end.", "a b c"]), max_size=120), st.integers(10, 30), st.integers(0, 4))
@settings(max_examples=150, deadline=None)
def test_pieces_fit_overlap_and_make_up_the_text(parts, limit, overlap):
    text = " ".join(parts)
    cut = splitting.split_points(text, limit, overlap)
    assert all(count(text[x:y]) == b - a <= limit for a, b, x, y in cut)
    assert all(p[1] - n[0] == overlap for p, n in zip(cut, cut[1:]))
    whole, at = "", 0
    for _, _, x, y in cut:
        whole, at = whole + text[max(x, at) : y], y
    assert whole == text


def test_pieces_end_at_sentences():
    text = " ".join(f"one two three four s{i}." for i in range(40))
    cut = splitting.split_points(text, 52, 3)
    assert len(cut) > 3 and all(text[x:y].rstrip().endswith(".") for _, _, x, y in cut)


def test_pieces_of_a_table(spark):
    long_ = " ".join(["tok"] * 2500)
    rows = [(1, 9, 0, long_, "k"), (1, 9, 0, long_, "k"), (2, 9, 1, "short", "k"), (3, 9, 2, None, "k"), (4, None, None, "", "k"), (None, 9, 3, "x", "k"), (5, 9, 4, "世" * 1025, "k")]
    df = spark.createDataFrame(rows, "segment_id long, doc_id long, segment_index int, raw_text string, n_tokens string")
    got = splitting.pieces(df, 1024, 64).orderBy("doc_id", "chunk_no").collect()
    assert [(r.segment_id, r.piece_no) for r in got if r.doc_id == 9] == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (5, 0), (5, 1)]
    assert [r.chunk_no for r in got if r.doc_id == 9] == list(range(7))
    assert {r.segment_id for r in splitting.oversized(df).collect()} == {1, 5}
    assert splitting.pieces(df.limit(0)).count() == 0


# ---- names

ENTRIES = [("Kixwick Session Guard", "n1"), ("卡克维会话保护", "n1"), ("KISG", "n1"), ("Hormar Fault Echo", "n2"), ("赫罗玛故障回显", "n2"), ("Morbex Prefix Relay", "n3"), ("Morbex", "n3"), ("Tamsin Tathwick Queue Shaping", "n4"), ("Tathwick Queue Shaping", "n4"), ("Drumpax Queue Shaping", "n5"), (None, "n6"), ("  ", "n6"), ("x", None)]
FORMS = {
    "kixwick-session-guard": "n1", "Session Guard (Kixwick)": "n1", "the kixwick session guards": "n1", "KixwickSessionGuard": "n1", "kixwcik sesion guard": "n1", "kisg": "n1", "卡克维会话保护机制": "n1", "ｋｉｘｗｉｃｋ ｓｅｓｓｉｏｎ ｇｕａｒｄ": "n1",
    "hormarfaultecho": "n2", "hormar faul. echo": "n2", "赫罗玛故障回显（协议）": "n2", "Hormar Fault Echo v3": "n2", "morbex protocol": "n3", "MORBEX": "n3", "tamsin_tathwick_queue_shaping": "n4", "queue shaping, drumpax": "n5",
    "queue shaping": "UNMATCHED", "zzyzx fault echo": "UNMATCHED", "sevlith protocol": "UNMATCHED", "赫勒扬环网保护": "UNMATCHED", "!!!": "UNMATCHED",
}


def test_forms_find_their_node(spark):
    forms = spark.createDataFrame([(f, "x") for f in FORMS] + [(None, "x"), ("  ", "x"), ("morbex protocol", "y")], "form string, node_id string")
    got = {r.form: r.node_id for r in canonical.map_to_canonical(forms, spark.createDataFrame(ENTRIES, "entry string, node_id string")).collect()}
    assert got == FORMS
    none = canonical.map_to_canonical(forms, spark.createDataFrame([], "entry string, node_id string"))
    assert {r.node_id for r in none.collect()} == {"UNMATCHED"}


def test_slips_find_their_node_however_many_forms_hold_them(spark):
    entries = spark.createDataFrame([*ENTRIES, ("Drelzeal", "n7")], "entry string, node_id string")
    want = {"morbx": "n3", "kixwcik session guard": "n1", "remzeal": "UNMATCHED"}
    ways = ["{}", " {} ", "{} protocol", "{} feature", "{} v2", "the {}", "{}!", "({})"]
    varied = {case(way.format(form)): node for form, node in want.items() for way in ways for case in (str.lower, str.upper, str.title)}
    for forms in (want, varied):
        found = canonical.map_to_canonical(spark.createDataFrame([(f,) for f in forms], "form string"), entries)
        assert {r.form: r.node_id for r in found.collect()} == forms


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
@settings(max_examples=200, deadline=None)
def test_edits_with_swaps(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i, j] = i + j
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    assert canonical.edits(a, b, 2) == min(d[-1, -1], 3)


# ---- bodies


def pages(n, seed):
    pick = random.Random(seed)
    body = lambda: "The " + " ".join(pick.choice(["router", "policy", "timer", "forwards", "drops", "the", "packet"]) for _ in range(16)) + "."
    segments, bodies, truth = [], [], {}
    for d in range(n):
        site = f"site{d % 3}word-x"
        head = [f"Home | Guides | {pick.choice(['Blog', 'Labs'])} | Sign in", f"Site{d % 3}word uses cookies for measuring traffic."]
        tail = [pick.choice(["Was this useful? Tell a friend", "Join 1600 readers of the letter"]), f"© {2000 + d % 20} Site{d % 3}word Press. All rights reserved."]
        main = [body() for _ in range(3)]
        segments.append((d, d, 0, site, "\n".join([*head, *main, "", *tail])))
        bodies.append((d, "\n\n".join(main)))
        truth[d] = {0, 1, 6, 7}
    return segments, bodies, truth


def test_furniture_on_held_out_pages(spark):
    segments, bodies, truth = pages(60, 2)
    segments += [segments[0], (900, 900, 0, None, None), (901, 901, None, None, ""), (None, 1, 0, "a", "x")]
    df = spark.createDataFrame([(*r, "x") for r in segments], "segment_id long, doc_id long, segment_index int, site_key string, raw_text string, path string")
    labels = spark.createDataFrame(bodies[:30] + [(None, "x"), (5, None)], "doc_id long, body string")
    found = boilerplate.furniture_lines(df, labels)
    got = defaultdict(set)
    for r in found.collect():
        got[r.segment_id].add(r.line_no)
    held_out = range(30, 60)
    assert sum(got[d] == truth[d] for d in held_out) >= 29
    clean = {r.doc_id: r.body for r in boilerplate.main_bodies(df, found).collect()}
    assert sum(clean[d].replace("\n\n", "\n") == dict(bodies)[d].replace("\n\n", "\n") for d in held_out) >= 29
    assert boilerplate.furniture_lines(df, labels.limit(0)).count() == 0
    assert boilerplate.furniture_lines(df.limit(0), labels).count() == 0


def test_bodies_of_documents_without_segments(spark):
    segments, bodies, truth = pages(60, 2)
    shape = "segment_id long, doc_id long, segment_index int, site_key string, raw_text string"
    df, labels = spark.createDataFrame(segments[:45], shape), spark.createDataFrame(bodies[:30], "doc_id long, body string")
    texts = [(d, site, "# A heading\n" + text.replace("\n\n", "\n## Another\n")) for d, _, _, site, text in segments[45:]]
    others = boilerplate.text_parts(spark.createDataFrame([*texts, (900, "site1word-x", ""), (901, None, None), (902, None, "# Only\n"), (None, None, "x")], "doc_id long, site_key string, text string"))
    found = boilerplate.furniture_lines(df, labels, others=others)
    assert set(boilerplate.furniture_lines(df, labels).collect()) == set(found.where("segment_id >= 0").collect())
    clean = {r.doc_id: r.body for r in boilerplate.main_bodies(df.unionByName(others), found).collect()}
    assert set(clean) == {*range(60), 900, 901, 902} and clean[900] == clean[901] == clean[902] == ""
    assert sum(clean[d].split() == dict(bodies)[d].split() for d in range(45, 60)) >= 14


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_every_document_has_a_body(spark):
    folder = "/root/testdata/sf0.001"
    documents = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    found = queries.p7_bodies(spark, folder).collect()
    assert len(found) == len(documents) and {r.doc_id for r in found} == documents and all(r.body is not None for r in found)


# ---- containers


@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 80))
@settings(max_examples=150, deadline=None)
def test_best_fit_keeps_the_capacity(sizes, capacity):
    bins = packing.best_fit(np.array(sizes, np.int64), capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    open_ = [sum(sizes[i] for i in b) for b in bins]
    assert sum(2 * x < capacity for x in open_) <= 1  # two that are not half full would have been one


@pytest.mark.parametrize(("items", "share"), [(400, 1.02), (60, 1.03)])  # 3 and 5 rounds of merging
def test_packing_is_whole_tight_and_repeatable(spark, items, share):
    pick = random.Random(6)
    rows = [(i, pick.choice([0, 3, 40, 90, 150, 400]) + pick.randint(0, 60), "x") for i in range(3000)] + [(5000, None, "x"), (5001, 2048 * 3, "x"), (5002, 2048 * 2 + 7, "x"), (None, 5, "x"), (5, 17, "x")]
    df = spark.createDataFrame(rows, "id long, size long, container string")
    got = packing.pack(df, 2048, partition_items=items, fan_in=3).collect()
    want = defaultdict(int)
    for i, s, _ in rows:
        if i is not None:
            want[i] = max(want[i], s or 0)
    sizes, tokens, cuts = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.container] += r.n_tokens
        tokens[r.id] += r.n_tokens
        cuts[r.id].append((r.first_token, r.n_tokens))
    assert tokens == want and len({(r.id, r.piece_no) for r in got}) == len(got)
    assert all(v <= 2048 for v in sizes.values()) and all(sizes[r.container] == r.container_total for r in got)
    assert all(len(c) == 1 for i, c in cuts.items() if want[i] <= 2048) and sorted(cuts[5002]) == [(0, 2048), (2048, 2048), (4096, 7)]
    assert len(sizes) * 2048 < sum(want.values()) * share + 2048
    again = packing.pack(df.repartition(7), 2048, partition_items=items, fan_in=3)
    assert {(r.container, r.id, r.piece_no) for r in again.collect()} == {(r.container, r.id, r.piece_no) for r in got}
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_ends_where_nothing_fits_together(spark):
    df = spark.range(2000).select("id", F.lit(1100).alias("size"))
    got = packing.pack(df, 2048, partition_items=50, fan_in=2)
    assert got.select("container").distinct().count() == got.count() == 2000


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_sizes_are_those_of_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    texts = ["Hello world, it's 10.0.0.1/24!", "世界 <|endoftext|>  \n\n x", "", None, "a" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.size for r in packing.token_sizes(df, VOCABULARY).collect()}
    assert got == {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


# ---- leaks


def test_leaks_match_brute_force(spark):
    words = lambda t: re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t or "").lower())
    item = "Which damped colour does DOKFEN probe when the ingress listener on PE-5 reports 0xde71 after 120 entries were cached twice"
    other = "Set the lease window to 15 minutes on edge-7 so that the busy database of Droktis discards 10.1.2.0/24 conservatively every day"
    numbers = " ".join(str(i) for i in range(100, 125))
    items = [(1, item), (2, other), (3, "too short to leak"), (None, item), (4, None), (5, item), (6, numbers)]
    parts = item.split()
    documents = [
        (10, "intro text. " + item.upper() + " more"),
        (11, " ".join(parts[2:16])),
        (12, " ".join(parts[:12])),
        (13, other.replace("15 minutes", "40 seconds").replace("edge-7", "edge-6").replace("Droktis", "Dokfen").replace("10.1.2.0/24", "10.8.9.0/24")),
        (14, item.replace("DOKFEN", "Ｄｏｋｆｅｎ") + "\n" + other),
        (15, None), (16, ""), (None, item), (17, item.replace("does", "did")),
        (18, "x " + numbers[8:80]), (19, " ".join(str(i) for i in range(500, 900))),
    ]
    grams = lambda t, n=13: {tuple(words(t)[i : i + n]) for i in range(len(words(t)) - n + 1)}
    want = {(d, i) for d, t in documents if d is not None for i, x in items if i is not None and x and grams(t) & grams(x)}
    df = spark.createDataFrame([(*r, 1) for r in documents], "id long, text string, item_id long")
    names, units = (spark.createDataFrame([(x,) for x in given], "text string") for given in (["Dokfen", "Droktis", None], ["minutes", "seconds"]))
    rows = leaks.leaks(df, spark.createDataFrame(items, "item_id long, item_text string"), 13, names, units).collect()
    assert {(r.id, r.item_id) for r in rows if r.kind == "verbatim"} == want
    assert (13, 2) in {(r.id, r.item_id) for r in rows if r.kind == "parameters"} and (13, 2) not in want
    assert not [r for r in rows if r.item_id == 6 and r.kind == "parameters"]
    assert {r.n_words for r in rows if r.id == 10 and r.kind == "verbatim"} == {len(words(item))}
    assert leaks.leaks(df, spark.createDataFrame([], "item_id long, item_text string")).count() == 0
    assert leaks.leaks(df.limit(0), spark.createDataFrame(items, "item_id long, item_text string")).count() == 0


def test_items_asked_again_with_other_values_are_found(spark):
    pick = random.Random(9)
    words_, names = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)], [f"Nam{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    units = ["seconds", "minutes", "packets", "Mbps"]

    def said(parts):
        # other values throughout: no two slots share one, the unit is the same all along
        unit, fresh, numbers = pick.choice(units), pick.sample(names, 8), pick.sample(range(1, 9999), 8)
        value = {"name": fresh.pop, "number": lambda: f"{numbers.pop()} {unit}", "code": lambda: f"0x{numbers.pop():04x}"}
        return " ".join(value[p]() if p in value else p for p in parts)

    items, documents = [], []
    for i in range(150):
        parts = [pick.choice(words_) for _ in range(24)]
        for k in pick.sample(range(24), 4):
            parts[k] = pick.choice(["name", "number", "code"])
        items.append((i, said(parts)))
        around = lambda: " ".join(pick.choice(words_) for _ in range(60))
        documents.append((i, f"{around()} {said(parts)} {around()}"))
        documents.append((1000 + i, around()))
    named = spark.createDataFrame([(n,) for n in names], "text string")
    rows = leaks.leaks(spark.createDataFrame(documents, "id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"), 13, named).collect()
    found = {(r.id, r.item_id) for r in rows}
    assert sum((i, i) in found for i in range(150)) >= 0.9 * 150
    assert len(found) <= 151


def test_bit_table_never_denies(spark):
    held = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    table = leaks.BitTable.of(spark.createDataFrame([(int(x),) for x in held] + [(None,)], "h long"))
    assert table.holds(held.view(np.uint64)).all()
    assert table.holds(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.01
