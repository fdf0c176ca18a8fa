"""Attention, encoders' ends, intents, stored models and vectors, against loops."""

import numpy as np
import pytest

from palimpsest.operators import graph as G
from palimpsest.operators import learned as LE
from palimpsest.operators import retrieval as R
from palimpsest.sources import tables as ST


def slow_forward(p, x, edges, layers, heads):
    h = x @ p["in"]
    for k in range(layers):
        new = np.zeros_like(h)
        for node in range(len(x)):
            near = [s for s, d in edges if d == node] + [node]
            for a in range(heads):
                w = [h[s] @ p[f"w{k}"][a] for s in near]
                e = np.array([v @ p[f"s{k}"][a] + (h[node] @ p[f"w{k}"][a]) @ p[f"t{k}"][a] for v in w])
                e = np.exp(np.where(e > 0, e, 0.2 * e))
                size = p[f"w{k}"].shape[2]
                new[node, a * size : (a + 1) * size] = sum(x * y for x, y in zip(e / e.sum(), w, strict=True))
        h = h + LE._gelu(new)
        h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5)
    return h


def test_graph_attention_against_loops():
    r = np.random.default_rng(1)
    p = LE.gat_new(6, layers=3, heads=4, width=16)
    x, edges = r.normal(size=(7, 6)), [(0, 1), (1, 0), (2, 1), (5, 6), (6, 6)]
    src, dst = (np.array(v) for v in zip(*edges, strict=True))
    assert np.allclose(LE.gat_forward(p, x, src, dst), slow_forward(p, x, edges, 3, 4))
    a, q, v = LE.gat_heads(p, LE.gat_forward(p, x, src, dst))
    assert ((0 < a) & (a < 1)).all() and np.allclose(q.sum(1), 1) and v.shape == (7,)


def test_ends_learn_their_labels():
    r = np.random.default_rng(2)
    p = LE.gat_new(4, layers=1, heads=2, width=8)
    x = r.normal(size=(120, 4))
    h = LE.gat_forward(p, x, np.empty(0, int), np.empty(0, int))
    quality, activation = (h[:, 0] > 0).astype(int) + (h[:, 1] > 0.5), (h[:, 2] > 0).astype(float)
    p = LE.gat_train(p, h, activation, quality, epochs=400, rate=0.5)
    a, q, _ = LE.gat_heads(p, h)
    assert ((a > 0.5) == activation).mean() > 0.9 and (q.argmax(1) == quality).mean() > 0.8


def test_states_of_many_graphs(spark):
    p = LE.gat_new(2, layers=2, heads=2, width=8)
    nodes = spark.createDataFrame([("u", i, [float(i), 1.0]) for i in range(4)] + [("v", 1, [0.5, 0.5])], "user_id string, id long, vector array<double>")
    edges = spark.createDataFrame([("u", 0, 1), ("u", 2, 3), ("u", 9, 1), ("w", 1, 1)], "user_id string, src long, dst long")
    rows = {(x["user_id"], x["id"]): x["activation"] for x in LE.graph_states(nodes, edges, p).collect()}
    h = LE.gat_forward(p, np.array([[i, 1.0] for i in range(4)]), np.array([0, 2]), np.array([1, 3]))
    assert len(rows) == 5 and all(abs(rows["u", i] - LE.gat_heads(p, h)[0][i]) < 1e-6 for i in range(4))


def test_token_attention_and_ends():
    r = np.random.default_rng(3)
    x, mask = r.normal(size=(2, 5, 8)), np.array([[1, 1, 1, 0, 0], [1, 1, 1, 1, 1]], bool)
    q, k, v = (r.normal(size=(8, 8)) for _ in range(3))
    out = LE.attended_tokens(x, mask, q, k, v, heads=2)
    want = x[0, 1].copy()
    for a in range(2):
        s = slice(4 * a, 4 * a + 4)
        e = np.exp([(x[0, 1] @ q)[s] @ (x[0, j] @ k)[s] / 2 for j in range(3)])
        want[s] += sum(w * (x[0, j] @ v)[s] for j, w in enumerate(e / e.sum()))
    assert np.allclose(out[0, 1], want)
    changed = x.copy()
    changed[0, 3:] = 9
    assert np.allclose(LE.attended_tokens(changed, mask, q, k, v, heads=2)[0, :3], out[0, :3])
    tags = LE.tagged(out, r.normal(size=(8, 3)), mask)
    assert (tags[0, 3:] == 0).all() and tags.max() <= 2
    one, two = np.zeros((2, 5), bool), np.zeros((2, 5), bool)
    one[:, 0], two[:, 2] = True, True
    scores = LE.pair_scores(out, mask, one, two, r.normal(size=(24, 4)))
    assert scores.shape == (2, 4) and np.allclose(scores.sum(1), 1)


def test_intents_of_phrases(spark):
    training = LE.bootstrap(spark)
    told = training.selectExpr("text", "label", "1 AS session_id")
    rows = LE.intents(told, training).collect()
    assert sum(r["intent"] == r["label"] for r in rows) / len(rows) > 0.85 and all(0 < r["intent_confidence"] <= 1 for r in rows)
    assert {r["label"] for r in LE.class_counts(training).collect()} == {*LE.INTENTS, "neutral"}
    assert LE.intents(spark.createDataFrame([(1, None)], "id int, text string"), training).count() == 1
    assert LE.bootstrap(spark, LE.STYLES).select("label").distinct().count() == len(LE.STYLES) + 1


def test_models_and_vectors_are_stored(spark, tmp_path):
    p = LE.gat_new(3, layers=1, heads=2, width=4)
    ST.save_model(spark, p, f"file://{tmp_path}/gat")
    back = ST.load_model(spark, f"file://{tmp_path}/gat")
    assert back.keys() == p.keys() and all(np.allclose(back[k], p[k]) and back[k].shape == p[k].shape for k in p)
    assert ST.load_model(spark, f"file://{tmp_path}/none") is None
    rows = spark.createDataFrame([(1, [3.0, 4.0], False), (2, [0.0, 0.0], False), (3, [1.0, 0.0], True), (4, None, False), (5, [0.0, 2.0], False)], "id long, embedding array<double>, is_suppressed boolean")
    index = ST.unit_vectors(rows)
    assert {r["id"]: r["embedding"] for r in index.collect()} == {1: [0.6, 0.8], 5: [0.0, 1.0]}
    added = spark.createDataFrame([(1, [1.0, 0.0], False), (6, [5.0, 0.0], False), (5, [1.0, 1.0], True)], rows.schema)
    now = ST.indexed(index, added, spark.createDataFrame([(6,)], "id long"))
    assert {r["id"]: r["embedding"] for r in now.collect()} == {1: [1.0, 0.0]}


def test_snapshots_have_versions(spark, tmp_path):
    for v in (1, 2, 10):
        ST.write_snapshot(spark.createDataFrame([(v,)], "id int"), f"file://{tmp_path}", "t", v)
    assert ST.latest_snapshot(spark, f"file://{tmp_path}", "t").collect()[0]["id"] == 10
    assert ST.latest_snapshot(spark, f"file://{tmp_path}", "t", 2).collect()[0]["id"] == 2


@pytest.mark.parametrize("bound", [1 << 20, 40])
def test_mentions_against_a_search(spark, bound):
    texts = ["Ann met Bob Lee in Lyon", "annex", "", None, "BOB LEE, bob", "nobody"] * 2
    names = [(1, "Ann"), (2, "bob"), (3, "Bob Lee"), (4, "x"), (5, None), (6, "ann"), (7, "Lyon"), (8, "Émile")]
    got = R.mentions(spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"), spark.createDataFrame(names, "id int, name string"), name_bytes=bound).collect()
    want = {(t, i) for t, text in enumerate(texts) for i, n in names if text and n and len(n) > 1 and n.lower() in text.lower()}
    assert {(r["text_id"], r["id"]) for r in got} == want and len(got) == len(want)
    assert R.mentions(spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"), spark.createDataFrame([], "id int, name string")).count() == 0


def test_bridge_candidates(spark):
    parts = spark.createDataFrame([(i, 0) for i in range(5)] + [(9, 9)], "id long, component long")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in (0, 1, 2, 3, 4, 9)], "id long, embedding array<double>")
    assert [(r["a"], r["b"]) for r in G.bridge_candidates(parts, vectors, hubs=3).collect()] == [(9, 2)]


def test_streamed_habits_are_exact(spark):
    from palimpsest.streaming import turns as TU

    rows = spark.createDataFrame([(s, t, "yeah gonna") for s in range(5) for t in range(3)], "session_id long, turn long, message string")
    got = {r["pattern_key"]: (r["observations"], r["sessions"]) for r in TU.habits(rows).collect()}
    assert got["casual_tone"] == (15, 5)
