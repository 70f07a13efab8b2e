"""Near-duplicates, history, vectors and spans against brute force."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import history, hyperminhash, near_duplicates, nearest_vectors, queries, shared_spans, shingles
from weftgraph.sources import stage

HOW = near_duplicates.Similarity(threshold=0.6, words=3)


def tokens(text):
    plain = unicodedata.normalize("NFKC", text or "").lower()
    return re.findall(r"[a-z0-9]+|[㐀-䶿一-鿿]", plain)


def similarity(a, b, k=3):
    x, y = ({tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for t in (tokens(a), tokens(b)))
    return len(x & y) / len(x | y) if x | y else 0.0


def corpus(n=60, seed=3):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [(i, " ".join(pick.choice(words) for _ in range(pick.randint(30, 90)))) for i in range(n)]
    for i in range(n, 2 * n):
        w = pick.choice(out[:n])[1].split()
        for _ in range(pick.randint(0, 8)):
            w[pick.randrange(len(w))] = pick.choice(words)
        out.append((i, " ".join(w)))
    return out


@given(st.lists(st.text(alphabet="ab 1,世界ＡＢ\n", max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_token_hashes_tell_tokens_apart(texts):
    h, at = shingles.tokens(texts)
    seen = {}
    for i, t in enumerate(texts):
        mine = tokens(t)
        assert at[i + 1] - at[i] == len(mine)
        for token, value in zip(mine, h[at[i] : at[i + 1]].tolist()):
            assert seen.setdefault(token, value) == value
    assert len(set(seen.values())) == len(seen)


def test_pair_jaccard_is_exact():
    rows = corpus(20)
    pairs = list(itertools.combinations([t for _, t in rows], 2))[:200] + [("", ""), (None, "a b c d"), ("a b", "a b")]
    got = shingles.pair_jaccard([a for a, _ in pairs], [b for _, b in pairs])
    assert np.allclose(got, [similarity(a, b) for a, b in pairs])


def test_estimates_follow_the_truth():
    texts = [t for _, t in corpus(40)]
    value, at, _ = shingles.shingle_hashes(texts)
    value, at = shingles.distinct(value, at)
    registers, n = hyperminhash.sketch(value, at, 16), np.diff(at)
    a, b = np.array(list(itertools.combinations(range(len(texts)), 2))).T
    error = hyperminhash.estimate(registers[a], registers[b], n[a], n[b]) - [similarity(texts[i], texts[j]) for i, j in zip(a, b)]
    assert abs(error.mean()) < 0.01 and np.abs(error).max() < 0.25


def test_registers_hold_zeros_and_mantissa():
    # 2**-5 * 1.5 as a 64-bit fraction: four leading zeros, then 1 1 0 0 ...
    r = hyperminhash._registers(np.array([3 << 58], np.uint64))[0] - 1
    assert r >> hyperminhash.MANTISSA_BITS == 4 and r & 1023 == 512


def near(spark, rows, how=HOW):
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "id long, text string, class_id string, key string"), "id", "text", how)
    return found, {tuple(r) for r in near_duplicates.all_pairs(found).collect()}


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    rows += [(900, None), (901, ""), (902, "too short"), (None, rows[0][1]), rows[5], (903, rows[5][1]), (904, rows[5][1].upper())]
    found, got = near(spark, [(*r, "x", None) for r in rows])
    plain = {i: t for i, t in rows if i is not None}
    want = {(a, b) for a, b in itertools.combinations(sorted(plain), 2) if similarity(plain[a], plain[b]) >= 0.6}
    assert got == want
    groups = {r.id: r for r in near_duplicates.groups(found).collect()}
    assert groups[5].class_id == groups[903].class_id == groups[904].class_id == 5
    for a, b in want:
        assert groups[a].group_id == groups[b].group_id
    assert len(groups) == sum(len(tokens(t)) > 2 for t in plain.values())


def test_near_duplicates_of_an_empty_table(spark):
    assert near(spark, [])[1] == set()


def test_default_is_five_words_at_080():
    assert (near_duplicates.Similarity().words, near_duplicates.Similarity().threshold) == (5, 0.8)


def documents(spark, rows):
    return spark.createDataFrame(rows, "id long, batch int, text string, content_hash string, normalized_hash string, kind string")


def history_rows():
    rows = corpus(30, seed=8)
    digest = lambda i: f"{i % 23:064x}"
    spell = (lambda h: h, str.upper, lambda h: f"sha256:{h}", lambda h: f" {h} ", lambda h: None)
    out = [(i, i % 4, t, spell[i % 5](digest(i)), spell[(i // 5) % 5](digest(i + 1000)) if i % 3 else None, "x") for i, t in rows]
    return out + [(700, 3, None, None, None, "x"), (701, None, rows[0][1], digest(1), None, "x"), (702, 3, rows[0][1], None, None, "x")]


def duplicates(rows):
    bare = lambda h: (re.search("[0-9a-f]{64}", h.lower()) or [None])[0] if h else None
    same = lambda x, y: x is not None and x == y
    return {(a[0], b[0]) for a in rows for b in rows if a[1] is not None and b[1] is not None and a[1] < b[1] and (same(bare(a[3]), bare(b[3])) or same(bare(a[4]), bare(b[4])) or similarity(a[2], b[2]) >= 0.6)}


def test_duplicates_of_all_batches_match_brute_force(spark, tmp_path):
    rows = history_rows()
    index = history.HistoryIndex(spark, f"file://{tmp_path}/index", HOW)
    tasks = spark.createDataFrame([(1, "SHA256:" + f"{5:064X}"), (2, None), (3, "b" * 64), (1, f"{5:064x}")], "id long, content_hash string")
    found, fetched = history.duplicates(index, documents(spark, rows), tasks)
    assert {tuple(r) for r in found.collect()} == duplicates(rows) and len(index.runs()) == 2
    bare = lambda h: (re.search("[0-9a-f]{64}", h.lower()) or [None])[0] if h else None
    assert {tuple(r) for r in fetched.collect()} == {(r[0], 1) for r in rows if r[1] is not None and bare(r[3]) == f"{5:064x}"}
    none, fetched = history.duplicates(history.HistoryIndex(spark, f"file://{tmp_path}/none", HOW), documents(spark, []), tasks)
    assert none.count() == fetched.count() == 0


def test_index_batch_by_batch_finds_the_same(spark, tmp_path):
    rows = [r for r in history_rows() if r[1] is not None]
    every = documents(spark, rows)
    index = history.HistoryIndex(spark, f"file://{tmp_path}/index", HOW, max_runs=2)
    got = set()
    for b in range(4):
        batch = history.prepared(documents(spark, [r for r in rows if r[1] == b]), HOW)
        got |= {tuple(r) for r in index.match(batch, every).collect()}
        index.add(batch)
        assert len(index.runs()) <= 2
    assert got == duplicates(rows)
    assert index.match(history.prepared(documents(spark, []), HOW), every).count() == 0


def test_stored_runs_are_merged_without_a_shuffle(spark, tmp_path):
    index = history.HistoryIndex(spark, f"file://{tmp_path}/index", HOW)
    keys = index._table(index.add(history.prepared(documents(spark, history_rows()), HOW)), "keys")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(history.windows(keys, keys))
    # a new batch is brought into the run's ranges; the run stays where it is
    assert plan(history.windows(stage(keys.limit(50)), keys)).count("Exchange") == 1
    # another session, which was never told of the tables, finds the runs on disk
    other = history.HistoryIndex(spark.newSession(), f"file://{tmp_path}/index", HOW)
    spark.sql(f"DROP TABLE weftgraph_{index.runs()[0].replace('-', '_')}_keys")
    assert "Exchange" not in plan(history.windows(*[other._table(other.runs()[0], "keys")] * 2)) and other.tables("keys").count() == keys.count() > 0


def vectors(n=300, seed=5):
    order = np.random.default_rng(seed)
    x = order.standard_normal((n, 16))
    y = x[:100] + order.standard_normal((100, 16)) * 0.25
    return np.concatenate([x, y, x[:8], 2 * x[8:12]]).astype(np.float32)


def test_nearest_vectors_recall_and_order(spark):
    x = vectors()
    rows = [("f", i, v.tolist(), "a") for i, v in enumerate(x)]
    rows += [("f", 9000, None, "a"), ("f", 9001, [0.0] * 16, "a"), ("f", 9002, [], "a"), ("g", 0, x[0].tolist(), "a"), ("g", 1, x[0].tolist(), "a"), ("f", 3, x[3].tolist(), "a"), ("f", None, x[0].tolist(), "a"), ("f", 9003, [1.0, 2.0], "a"), ("f", 9004, [float("nan")] * 16, "a")]
    members, pairs = nearest_vectors.similar_pairs(spark.createDataFrame(rows, "field string, id long, vec array<float>, key string"), 0.85)
    got = {(r.field, r.id, r.neighbour) for r in nearest_vectors.most_similar(members, pairs, 5).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cosine = unit @ unit.T
    want = {("g", 0, 1), ("g", 1, 0)}
    for i in range(len(x)):
        near_ = [j for j in range(len(x)) if j != i and cosine[i, j] >= 0.85]
        want |= {("f", i, j) for j in sorted(near_, key=lambda j: (-round(cosine[i, j], 9), j))[:5]}
    assert len(got & want) / len(want) >= 0.95
    assert all(a != b for _, a, b in got)


def test_no_near_pair_is_left_out(spark, tmp_path):
    # pairs just above the least cosine that have no near vector in common with anything else
    n, order = 5000, np.random.default_rng(21)
    x, y = (order.standard_normal((n, 64)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    cosine = np.linspace(0.8501, 0.86, n)[:, None]
    x = np.concatenate([x, cosine * x + (1 - cosine**2) ** 0.5 * y]).astype(np.float32)
    rows = [(i, v, None, v if i % 10 == 0 else None) for i, v in enumerate(x.tolist())]
    rows += [rows[5], (20000, [0.0] * 64, None, None), (20001, None, None, [1.0, 2.0]), (20002, None, None, [2.0, 4.0]), (20003, (7 * x[9]).tolist(), None, None), (20004, x[9].tolist(), None, None)]
    vectors = pa.list_(pa.float32())
    shape = pa.schema([("segment_id", pa.int64()), ("embedding", vectors), ("title_vec", vectors), ("content_vec", vectors)])
    (tmp_path / "segments.parquet").mkdir()
    for part in range(3):
        pq.write_table(pa.Table.from_pylist([dict(zip(shape.names, r)) for r in rows[part::3]], shape), tmp_path / f"segments.parquet/{part}.parquet")
    got = {tuple(r) for r in queries.p4_found(spark, f"file://{tmp_path}").collect()}
    want = {(f, a, b) for i in range(n) for a, b in ((i, n + i), (n + i, i)) for f in ("embedding", "content_vec") if f == "embedding" or i % 10 == 0}
    want |= {("embedding", a, b) for s in [(9, n + 9, 20003, 20004)] for a in s for b in s if a != b} | {("content_vec", 20001, 20002), ("content_vec", 20002, 20001)}
    assert got == want


def test_blocks_hold_every_vector_once(monkeypatch):
    monkeypatch.setattr(nearest_vectors, "BLOCK_BYTES", 3 * 4 * 2)
    monkeypatch.setattr(nearest_vectors, "BEGUN_BYTES", 30)
    rows = [("fg"[i % 2], i, [1.0 * i] * (1 + i % 3)) for i in range(50)]
    shape = pa.schema([("field", pa.string()), ("id", pa.int64()), ("vec", pa.list_(pa.float32()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in rows[at : at + 9]], shape) for at in range(0, 50, 9)]
    got = []
    for block in nearest_vectors._packed(iter(batches)):
        (b,) = block.to_pylist()
        ids, vecs = np.frombuffer(b["ids"], "<i8").tolist(), np.frombuffer(b["vecs"], "<f4").reshape(-1, b["size"]).tolist()
        assert len(ids) == len(vecs) <= 6 // b["size"] and ids[0] == b["first"]
        got += zip([b["field"]] * len(ids), ids, vecs)
    assert sorted(got) == sorted(rows)


@pytest.mark.parametrize("most", [1, 10**6])
def test_near_rows_keep_the_best_of_every_row_and_column(monkeypatch, most):
    monkeypatch.setattr(nearest_vectors, "PRODUCT", (7, 11))
    monkeypatch.setattr(nearest_vectors, "EXACT_PAIRS", most)
    order = np.random.default_rng(6)
    x = order.standard_normal(8) + 0.5 * order.standard_normal((50, 8))
    x[30:34] = x[3]
    x /= np.linalg.norm(x, axis=1)[:, None]
    for a, b in ((x, None), (x[:20], x[20:])):
        cosine = np.triu(x @ x.T, 1) if b is None else a @ b.T
        i, j, found = nearest_vectors.near_rows(a, b, 0.85, 2)
        got = set(zip(i.tolist(), j.tolist()))
        every = {(p, q) for p, q in zip(*map(np.ndarray.tolist, np.nonzero(cosine >= 0.85)))}
        assert len(got) == len(i) and got <= every and np.allclose(found, cosine[i, j])
        assert got == every or most == 1
        for lines, at in ((cosine, 0), (cosine.T, 1)):
            for p, line in enumerate(lines):
                least = sorted(line)[-2]
                assert {pair for pair in every if pair[at] == p and cosine[pair] > least - 1e-12} <= got


def test_refinement_finds_what_no_table_brought_together(spark):
    order = np.random.default_rng(11)
    x = order.standard_normal((120, 32))
    x = np.concatenate([x + order.standard_normal(x.shape) * 0.36 for _ in range(6)])
    df = spark.createDataFrame([("f", i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "field string, id long, vec array<float>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.85)) if i < j}
    recall = []
    for rounds in (0, 1):
        how = nearest_vectors.Probing(tables=8, rounds=rounds)
        pairs = {(r.a, r.b) for r in nearest_vectors.similar_pairs(df, 0.85, how)[1].collect()}
        assert pairs <= want
        recall.append(len(pairs) / len(want))
    assert recall[1] > recall[0] + 0.1 and recall[1] > 0.8, recall
    assert nearest_vectors.planned(50_000_000).functions > nearest_vectors.planned(1_000).functions


def test_many_equal_vectors_cost_no_pairs_of_copies(spark):
    rows = [("f", i, [1.0, 2.0, 3.0, 4.0]) for i in range(3000)]
    members, pairs = nearest_vectors.similar_pairs(spark.createDataFrame(rows, "field string, id long, vec array<float>"), 0.85)
    best = nearest_vectors.most_similar(members, pairs, 5)
    assert pairs.count() == 0 and best.count() == 15000
    assert {r.neighbour for r in best.where("id = 2").collect()} == {0, 1, 3, 4, 5}


def test_perturbations_come_in_order_of_score():
    sets = nearest_vectors.perturbations(8, 20)
    assert sets[0] == (0,) and len(set(sets)) == 20
    assert all(len({min(j, 15 - j) for j in s}) == len(s) for s in sets)


@given(st.integers(0, 10**6), st.integers(1, 30))
@settings(max_examples=40, deadline=None)
def test_compact_windows_cover_every_stretch_once(seed, width):
    h = np.random.default_rng(seed).integers(0, 50, 60).astype(np.uint64)
    nodes = shared_spans.compact_windows(h, width)
    for a in range(len(h) - width + 1):
        b = a + width - 1
        covering = [c for f, c, e in nodes if f <= a <= c <= b <= e]
        assert len(covering) == 1 and h[covering[0]] == h[a : b + 1].min()


def test_compact_windows_of_one_repeated_gram_are_quick():
    assert len(shared_spans.compact_windows(np.zeros(200_000, np.uint64), 100)) < 4_000


def span_texts():
    pick = random.Random(4)
    text = lambda n: "".join(pick.choice("abcdefgh 世界\n") for _ in range(n))
    shared, long_ = text(90), text(300)
    return [(0, text(200) + shared + text(50)), (1, shared + text(100)), (2, text(40) + shared[:59] + text(80)), (3, long_), (4, long_), (5, text(30) + shared[20:85]), (6, None), (7, ""), (8, "z" * 500), (9, "z" * 80), (None, shared), (10, long_[:100] + text(10) + long_[100:170]), (11, "ab" * 90 + shared), (12, shared + "ab" * 60 + text(20) + "ba" * 50), (13, shared[:70] + text(30) + shared[:70])]


def test_shared_spans_match_brute_force(spark):
    rows, span = span_texts(), 60
    plain = {i: t or "" for i, t in rows if i is not None}
    grams = {i: {t[k : k + span] for k in range(len(t) - span + 1)} for i, t in plain.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(plain), 2) if grams[a] & grams[b]}
    df = spark.createDataFrame(rows, "id long, text string").withColumn("class_id", F.lit("x"))
    found = shared_spans.span_pairs(df, span, 40)
    assert {tuple(r) for r in shared_spans.expanded_pairs(*found, span).collect()} == want
    share = {r.id: r for r in shared_spans.shared_share(*found, span).collect()}
    for i, t in plain.items():
        elsewhere = set().union(*[grams[j] for j in plain if j != i])
        covered = np.zeros(len(t), bool)
        for k in range(len(t) - span + 1):
            if t[k : k + span] in elsewhere:
                covered[k : k + span] = True
        assert share[i].shared_chars == covered.sum(), i
    assert shared_spans.expanded_pairs(*shared_spans.span_pairs(df.limit(0), span, 40), span).count() == 0


def test_gram_must_fit():
    with pytest.raises(ValueError):
        shared_spans.span_pairs(None, 10, 20)
