"""Queries see the whole of their tables, however many rows those have."""

import random
import re

import numpy as np

from palimpsest.operators import inference as I
from palimpsest.operators import learned as LE
from palimpsest.plans.registry import queries
from palimpsest.sources import adapters as A


def tables(spark, folder, **rows):
    """Parquet files of (DDL, rows) in a folder, named as the benchmark tables."""
    for name, (ddl, values) in rows.items():
        spark.createDataFrame(values, ddl).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_context_takes_every_document(spark, tmp_path):
    sf = tables(spark, tmp_path, documents=("doc_id long, text string", [(i, f"w{i}") for i in range(1300)]))
    got = queries()["ctx_1_3_context"](spark, sf).collect()
    assert len(got) == 52 and sorted(w for r in got for w in r["context"].split() if w.startswith("w")) == sorted(f"w{i}" for i in range(1300))
    assert sum(r["sections"] for r in queries()["ctx_2_budget"](spark, sf).collect()) == 1300


def test_relevant_triples_of_any_entity(spark, tmp_path):
    sf = tables(spark, tmp_path, customer=("c_custkey long, c_name string", [(i, f"Customer {i}") for i in (900, 901)]))
    assert {r["query_id"] for r in queries()["ctx_9_top_7_relevant_triples"](spark, sf).collect()} == {0, 1, 2}


def test_links_are_predicted_in_every_chain_of_families(spark, tmp_path):
    sf = tables(spark, tmp_path, customer=("c_custkey long, c_name string", [(i, f"Customer {i}") for i in range(60, 75)]))
    e, r = A.entities(spark, sf), A.relations(spark, sf)
    triples = LE.index(e, r.withColumn("user_id", A.chain("subject_id").cast("string"))).toPandas()
    got = queries()["gr_18_19_20_21_link_prediction"](spark, sf).toPandas()
    want = set()
    for _, part in triples.groupby("user_id"):
        rows = part.sort_values(["s", "p", "o"])
        names, codes = np.unique(np.concatenate([rows.s, rows.o]), return_inverse=True)
        kinds, pc = np.unique(rows.p, return_inverse=True)
        v, q = LE.transe(codes[: len(rows)], pc, codes[len(rows) :])
        told = set(zip(rows.s, rows.p, rows.o, strict=True))
        for s, p in {(s, p) for s, p, _ in told}:
            d = np.round(np.linalg.norm(v[names.searchsorted(s)] + q[kinds.searchsorted(p)] - v, axis=1), 6)
            near = sorted((x, o) for x, o in zip(d, names, strict=True) if o != s)[:3]
            want |= {(s, p, o) for x, o in near if x <= LE.NEAR and (s, p, o) not in told}
    assert triples.user_id.nunique() == 5 and set(zip(got.s, got.p, got.o, strict=True)) == want


def test_the_cap_on_hops_is_each_user_s(spark, tmp_path):
    names = [(100 * u + k, f"Name{u}x{k}", "person", 100 * u + k) for u in (1, 2) for k in range(60)]
    told = [(1000 * u + 2 * k + far, 100 * u + (k if far else 0), "father", 100 * u + (k + 25 if far else k), 1.0, False, 1000 * u + 2 * k + far, str(u)) for u in (1, 2) for k in range(1, 25) for far in (0, 1)]
    e = spark.createDataFrame(names, "id int, name string, entity_type string, seq int")
    r = spark.createDataFrame(told, "id int, subject_id int, predicate string, object_id int, confidence double, is_inferred boolean, seq int, user_id string")
    got = I.full(e, r).where("stage = 'multi_hop'").collect()
    assert [sum(x["object_id"] // 100 == u for x in got) for u in (1, 2)] == [20, 20]
    # no chain of families has twenty, so nothing is lost
    sf = tables(spark, tmp_path, customer=("c_custkey long, c_name string", [(i, f"Customer {i}") for i in range(1, 61)]))
    e, r = A.entities(spark, sf), A.relations(spark, sf)
    want = {tuple(x) for x in I.full(e, r, cap=None).collect()}
    assert {tuple(x) for x in queries()["gr_4_full_inference"](spark, sf).collect()} == want
    assert queries()["agg_2_graph_stats"](spark, sf).first()["inferred_relations"] == len(want)


def vectored(spark, folder, docs=900, vectors=700):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], "a") for i in range(vectors)]
    texts = [(i, "Conversation started from scratch" if i % 9 == 0 else f"t{i}", "s") for i in range(docs)]
    return tables(spark, folder, documents=("doc_id long, text string, source string", texts), labels=("doc_id long, quality int, toxic int", [(1, 1, 0)]), embeddings=("vec_id long, embedding array<float>, label string", rows))


def test_upkeep_and_activation_of_every_memory(spark, tmp_path):
    sf = vectored(spark, tmp_path)
    rows = queries()["gr_5_11_upkeep"](spark, sf).collect()
    assert sorted(r["id"] for r in rows) == list(range(900))
    assert {r["id"] for r in rows if r["suppression_reason"] == "noise_detected"} == set(range(0, 900, 9))
    assert sorted(r["id"] for r in queries()["gr_7_activations"](spark, sf).collect()) == list(range(900))


def test_searches_take_all_queries_and_vectors(spark, tmp_path):
    sf = vectored(spark, tmp_path)
    rows = queries()["top_2_over_fetch"](spark, sf).collect()
    assert {r["query_id"] for r in rows} == set(range(0, 700, 50))
    assert all({q, q + 700} - set(range(900, 2000)) <= {r["id"] for r in rows if r["query_id"] == q} for q in range(0, 700, 50))
    assert queries()["ctx_1_relevant_section"](spark, sf).count() == 14


def test_question_tokens_of_whole_texts_in_all_languages(spark, tmp_path):
    texts = {1: ("en", "Who's there? " * 15), 2: ("fr", "Les mots sont l\u00e0, et apr\u00e8s?"), 3: ("de", ""), 4: (None, " ".join(f"W{i}" for i in range(500)))}
    sf = tables(spark, tmp_path, documents=("doc_id long, lang string, text string", [(i, *v) for i, v in texts.items()]))
    got = {r["id"]: r["tokens"] for r in queries()["fn_19_question_tokens"](spark, sf).collect()}
    assert got == {i: " ".join(re.findall(r"'s|[a-z0-9_]+|\?", t.lower())) for i, (_, t) in texts.items()}


def test_signals_of_every_user_turn(spark, tmp_path):
    said = [(50 + i, 1, role, "I never said that") for i, role in enumerate(["user", "assistant", "user"])] + [(60, 1, "user", "plain")]
    sf = tables(spark, tmp_path, conversations=("conv_id long, turn long, role string, text string", said))
    for name, column in (("sig_1_dopamine", "dopamine"), ("sig_2_gaba", "gaba"), ("sig_3_norepinephrine", "norepinephrine")):
        rows = queries()[name](spark, sf).where("session_id >= 50").collect()
        assert sorted(r["session_id"] for r in rows) == [50, 52, 60], name
        assert column != "gaba" or {r["session_id"] for r in rows if r["gaba"]} == {50, 52}
