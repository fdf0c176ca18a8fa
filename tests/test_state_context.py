from pyspark.sql import functions as F

from palimpsest.operators import context as C
from palimpsest.operators import state as S


def test_activation_is_clamped_in_order(spark):
    df = spark.createDataFrame([("e", 1, 3.0), ("e", 2, -0.5), ("f", 1, -1.0), ("f", 2, 0.25)], "entity_id string, seq int, delta double")
    assert {r["entity_id"]: r["resting_activation"] for r in S.activated(df).collect()} == {"e": 1.5, "f": 0.25}


def test_receptor_cap(spark):
    df = spark.createDataFrame([("e", "gaba", i) for i in range(100)], "entity_id string, signal string, seq int")
    row = S.receptors(df).first()
    assert (row["signal_count"], row["receptor"]) == (100, 3.0)


def test_decay(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0005)], "entity_id string, resting_activation double")
    assert {r["entity_id"]: r["resting_activation"] for r in S.decayed(df, 0.5).collect()} == {"a": 0.5, "b": 0.0}


def test_flood_reads_before_it_records(spark):
    df = spark.createDataFrame([("e", "gaba", True, 1), ("e", "gaba", True, 2)], "entity_id string, signal string, mentioned boolean, seq int")
    assert S.flood(df).first()["boost"] == 0.1025


def test_masks(spark):
    df = spark.createDataFrame([(1, "review the code of the project"), (2, "dinner"), (3, "work and family"), (4, "rain")], "message_id int, message string")
    assert {r["message_id"]: (r["work"], r["personal"]) for r in S.masks(df).collect()} == {1: (True, False), 2: (False, True), 3: (False, False)}


def test_negation_stays_in_its_clause(spark):
    df = spark.createDataFrame([("Ann isn't my sister", "Ann"), ("It isn't late, but Ann is here", "Ann"), ("Ann came", "Ann")], "m string, n string")
    assert [r[0] for r in df.select(S.negated(F.col("m"), F.col("n"))).collect()] == [True, False, False]


def test_top_order(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 1.5), ("c", 1.0)], "entity_id string, resting_activation double")
    assert [r["entity_id"] for r in S.top(df, 2).collect()] == ["b", "c"]


def test_budget_skips_and_goes_on(spark):
    parts = [(1, 0, "fact", "f " * 3), (1, 1, "style", "x " * 900), (1, 2, "important", "x " * 600), (1, 3, "relevant", "x " * 200)]
    row = C.budgeted(spark.createDataFrame(parts, "query_id int, pos int, name string, text string")).first()
    assert row["used_tokens"] == 4 + 1200 + 266 and len(row["kept"]) == 3


def test_mandatory_sections_stay(spark):
    parts = [(1, 0, "caution", "x " * 2000), (1, 1, "style", "x")]
    row = C.built(spark.createDataFrame(parts, "query_id int, pos int, name string, text string")).first()
    assert row["used_tokens"] == 2666 and row["context"].startswith("<memory_context>")


def test_sections(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0.8), (1, 2, "b", 0.5)], "query_id int, rank int, content string, confidence double")
    assert "  - [80% confidence] a\n  - [50% confidence] b" in C.relevant(rows).first()["relevant"]
    web = spark.createDataFrame([(1, 1, "T", "https://a.example/x", "s", "snip")], "query_id int, rank int, title string, url string, source string, snippet string")
    assert '"T" (a.example): snip' in C.web(web).first()["web"]
    kept = C.uncovered(spark.createDataFrame([("User said: x",), ("Ann is kind",), ("Bob is kind",)], "content string"), F.lit("about ann"))
    assert [r["content"] for r in kept.collect()] == ["Bob is kind"]
