"""Joins whose sides are estimated too small must not be left to a broadcast."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import vector as V
from palimpsest.operators import graph as G
from palimpsest.operators import learned as LE
from palimpsest.operators import propagation as P
from palimpsest.operators import retrieval as R
from palimpsest.plans.registry import queries
from palimpsest.sources import tables as ST


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ctx_6_describe", "gr_14_contexts"])
def test_graph_tables_are_not_broadcast(spark, small, name):
    assert "Broadcast" not in plan(queries()[name](spark, small))


@pytest.mark.parametrize("name", ["gr_14_candidates", "gr_14_scored"])
def test_candidates_are_not_broadcast(spark, small, name):
    """Neither entities with their predicates nor their vectors go to the driver, whatever Spark estimates."""
    assert "Broadcast" not in plan(queries()[name](spark, small))


def test_grams_are_not_broadcast(spark):
    names = spark.createDataFrame([(1, "Ann Lee", "person"), (2, "Anne Lee", "person"), (3, "Bob", "person")], "id long, name string, entity_type string")
    pairs = G.similar_names(names)
    assert "Broadcast" not in plan(pairs)
    assert [tuple(r) for r in pairs.select("a", "b").collect()] == [(1, 2)]


def test_activations_of_equal_vectors_write_no_pairs(spark, monkeypatch):
    """Copies, a null, an empty and an odd vector, against the pairs written out."""
    vectors = [[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.8, 0.6], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0], [float("nan"), 1.0], None]
    rows = [(i, v, 0.5 + i / 20, i % 3, i, i == 1, False) for i, v in enumerate(vectors)]
    m = spark.createDataFrame(rows, "id long, embedding array<float>, confidence double, session_count int, access_count int, is_priority boolean, is_suppressed boolean")
    live = m.where("embedding IS NOT NULL")
    want = {r["id"]: r["activation"] for r in P.propagated(live.select("id", P.charge().alias("activation")), P.edges(m, 0.3)).collect()}
    monkeypatch.setattr(P, "edges", None)
    got = {r["id"]: r["activation"] for r in P.activations(m, 0.3).collect()}
    assert len(want) == 8 and got == pytest.approx(want, abs=2e-6)


def test_merges_of_equal_vectors_write_no_pairs(spark, monkeypatch):
    """Copies and near copies against a plain loop; only distinct vectors are paired."""
    r = np.random.default_rng(4)
    kinds = [[1.0, 0.0], [0.98, 0.2], [0.9, 0.44], [0.0, 1.0], [0.0, 0.0], [float("nan"), 1.0]]
    which = [0] * 40 + r.integers(0, 6, 40).tolist()
    rows = [(i, kinds[k], round(float(r.random()), 2), int(r.integers(0, 4)), bool(r.random() < 0.1), False, int(s)) for i, (k, s) in enumerate(zip(which, r.permutation(80), strict=True))]
    v = np.array([x[1] for x in rows])
    sim = np.nan_to_num(v @ v.T / np.maximum(np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(v, axis=1), 1e-9))
    gone, kept, score = set(), {}, [x[2] * 10 + x[3] + 50 * x[4] for x in rows]
    for i in sorted(range(80), key=lambda i: rows[i][6]):
        group = [j for j in range(80) if rows[j][6] > rows[i][6] and j not in gone and round(sim[i, j], 9) >= 0.92]
        if i not in gone and group:
            best = max((i, *group), key=lambda k: (score[k], rows[k][6]))
            kept[best] = kept.get(best, 0) + len(group)
            gone |= {i, *group} - {best}
    want = {(i, "drop", 0) for i in gone} | {(i, "keep", n) for i, n in kept.items() if i not in gone}
    found, own = [], V.similar_pairs
    monkeypatch.setattr(V, "similar_pairs", lambda *x, **y: found.append(own(*x, **y)) or found[-1])
    m = spark.createDataFrame(rows, "id long, embedding array<float>, confidence double, access_count int, is_priority boolean, is_suppressed boolean, seq long")
    assert {tuple(x) for x in P.merges(m).collect()} == want and len(gone) > 40
    assert found[0].count() <= 6


def test_sums_in_blocks(spark):
    r = np.random.default_rng(3).normal(size=(60, 4)).astype("float32")
    rows = spark.createDataFrame([(i, v.tolist(), float(i)) for i, v in enumerate(r)], "id long, embedding array<float>, value double")
    pairs = V.similar_pairs(rows, 0.2).collect()
    want = dict.fromkeys(range(60), 0.0)
    for p in pairs:
        want[p["i"]] += p["sim"] * p["j"]
        want[p["j"]] += p["sim"] * p["i"]
    assert {x["id"]: x["total"] for x in V.similar_sums(rows, 0.2, 60, 13, 4).collect()} == pytest.approx(want)


def test_links_in_blocks_are_those_of_the_two_steps(spark, monkeypatch):
    """Graphs of one shape are trained once, and predict what embedding and prediction apart do."""
    r = np.random.default_rng(5)
    shapes = [r.integers(0, (8, 3, 8), (17, 3)) for _ in range(2)]
    rows = [(str(u), int(a + 20 * u), int(p), int(b + 20 * u)) for u in range(8) for a, p, b in (shapes[u % 2] if u < 7 else shapes[0][:9])]
    triples = spark.createDataFrame(rows, "user_id string, s long, p long, o long")
    got = {tuple(x) for x in LE.learned_links(triples, block_rows=60).collect()}
    assert got and got == {tuple(x) for x in LE.predicted(triples, LE.embedded(triples)).collect()}
    calls, own = [], LE.transe
    monkeypatch.setattr(LE, "transe", lambda *x: calls.append(x) or own(*x))
    part = LE._links_of(triples.toArrow())
    assert len(calls) == 2 and {tuple(x.values()) for x in part.to_pylist()} == got


def test_profile_in_pieces(spark):
    rows = spark.range(1, 2501).select("id", F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("pattern_key"))
    pieces = ST.profile_pieces(rows, rows, rows.limit(0), rows, rows, 100).collect()
    assert max(len(json.loads(x["items"])) for x in pieces) == 100
    for name in ("rules", "clusters", "priority_memories", "entities", "relations"):
        whole = [i["id"] for x in sorted((x for x in pieces if x["name"] == name), key=lambda x: x["piece"]) for i in json.loads(x["items"])]
        assert whole == ([] if name == "priority_memories" else list(range(1, 2501)))


def test_names_are_broadcast_packed(spark, monkeypatch):
    """Several parts of names, each held by the driver as bytes."""
    sent, own = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x) or own(x))
    names = spark.createDataFrame([(i, f"Name{i:03d}") for i in range(300)], "id long, name string")
    texts = spark.createDataFrame([(1, "xNAME007y name299"), (2, None), (3, "name")], "text_id long, text string")
    assert sorted(tuple(r) for r in R.mentions(texts, names, 1, 2000).collect()) == [(1, 7), (1, 299)]
    assert len(sent) > 1 and all(isinstance(x, bytes) and len(x) < 3000 for x in sent)
