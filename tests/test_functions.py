import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import vector as V


def values(spark, expr, rows, ddl):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(expr).collect()]


def test_junk_names(spark):
    names = ["none", "Ann", "A", "3.5", "2 weeks ago", "If Bob", "the user", "Ann's", "User (x)", "Bob Lee", "", "topic"]
    got = values(spark, T.is_junk_name(F.col("n")), [(n,) for n in names], "n string")
    assert got == [True, False, True, True, True, True, True, False, False, False, True, True]


def test_valid_names(spark):
    names = ["Ann", "has", "the mill", "Ann Works At", "Bob Lee", "Ann's father", "One Two Three Four", "wife", "father in law", "Because Ann"]
    assert values(spark, T.is_valid_name(F.col("n")), [(n,) for n in names], "n string") == [True, False, False, False, True, False, False, False, False, False]


def test_dice(spark):
    pairs = [("Night", "Nacht"), ("same", "SAME "), ("", "x"), ("a", "a"), ("a", "b")]
    assert values(spark, F.round(T.dice(F.col("a"), F.col("b")), 4), pairs, "a string, b string") == [0.25, 1.0, 0.0, 1.0, 0.0]


def test_predicates(spark):
    words = ["Mum", "sister-in-law", "brothr", "pet", "pat", "lives in", "father_in_lau"]
    assert values(spark, T.predicate(F.col("w")), [(w,) for w in words], "w string") == ["mother", "sister_in_law", "brother", "pet", "pat", "lives_in", "father_in_law"]


def test_token_estimate_and_percent(spark):
    assert values(spark, T.tokens_estimate(F.col("t")), [("a b c",), ("",), (None,), ("one",)], "t string") == [4, 1, 1, 1]
    assert values(spark, T.percent(F.col("x")), [(0.8,), (0.005,), (0.125,)], "x double") == ["80%", "0%", "12%"]


def test_covered(spark):
    rows = [("Ann likes Bob", "ann is here"), ("Ann likes Bob", "nobody"), ("no names here", "ann"), ("Ann", "")]
    assert values(spark, T.is_covered(F.col("a"), F.col("b")), rows, "a string, b string") == [True, False, False, False]


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])]
    assert values(spark, V.cosine(F.col("a"), F.col("b")), rows, "a array<double>, b array<double>") == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_resized_and_normalised(spark):
    got = spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(V.resized(V.normalised(F.col("v")), 3).alias("a"), V.resized(F.col("v"), 1).alias("b")).first()
    assert got["a"] == pytest.approx([0.6, 0.8, 0.0]) and got["b"] == [3.0]


def test_similar_pairs_against_all_pairs(spark):
    import numpy as np

    r = np.random.default_rng(3)
    m = r.normal(size=(60, 8))
    m[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(None, m[0].tolist()), (99, None)]
    got = {(x["i"], x["j"]) for x in V.similar_pairs(spark.createDataFrame(rows, "id long, embedding array<float>"), 0.4, block_rows=13).collect()}
    f = m.astype(np.float32).astype(float)
    n = np.linalg.norm(f, axis=1)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if n[i] and n[j] and f[i] @ f[j] / n[i] / n[j] > 0.4}
    assert got == want
