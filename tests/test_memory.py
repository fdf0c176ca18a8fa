import pytest
from pyspark.sql import functions as F

from palimpsest import schema as S
from palimpsest.operators import memory as M
from palimpsest.sources import tables as ST

DDL = "id int, content string, tier string, confidence double, session_count int, access_count int, is_priority boolean, is_suppressed boolean, suppression_reason string, embedding array<float>"


def memories(spark, rows):
    return spark.createDataFrame(rows, DDL)


def one(id=1, content="x", session=0, access=0, priority=False, suppressed=False, v=(1.0, 0.0), confidence=1.0):
    return (id, content, "short", confidence, session, access, priority, suppressed, None, [float(x) for x in v] if v else None)


def test_suppress_and_restore(spark):
    m = memories(spark, [one(1), one(2, priority=True)])
    gone = M.suppress(m, m.where("id = 1"), "manual")
    row = gone.where("id = 1").first()
    assert (row["confidence"], row["is_suppressed"], row["suppression_reason"]) == (0.05, True, "manual")
    assert [r["id"] for r in M.search(gone, F.array(F.lit(1.0), F.lit(0.0))).collect()] == [2]
    back = M.restore(gone, gone.where("id = 1")).where("id = 1").first()
    assert (back["confidence"], back["is_suppressed"], back["suppression_reason"]) == (0.8, False, None)


def test_stale_needs_age_and_no_reads(spark):
    m = memories(spark, [one(1), one(2, access=1), one(3, priority=True)])
    for _ in range(11):
        m = M.age(m)
    assert [r["id"] for r in M.stale(m).collect()] == [1]


def test_purge(spark):
    m = memories(spark, [one(1, session=30, suppressed=True), one(2, session=29, suppressed=True), one(3, session=99)])
    assert sorted(r["id"] for r in M.purge(m).collect()) == [2, 3]


def test_stats_of_nothing(spark):
    row = M.stats(memories(spark, [])).first()
    assert row["total"] == 0 and row["long"] == 0


def test_search_orders_and_drops_unlike(spark):
    m = memories(spark, [one(1, v=(1, 0)), one(2, v=(0, 1)), one(3, v=(1, 1)), one(4, v=(-1, 0)), one(5, v=None), one(6, v=(1, 0), suppressed=True)])
    assert [r["id"] for r in M.search(m, F.array(F.lit(1.0), F.lit(0.0)), 5).collect()] == [1, 3]


def test_widening(spark):
    row = spark.range(1).select(M.widened(F.lit(10), F.lit(1)).alias("a"), M.widened(F.lit(10), F.lit(3)).alias("b"), M.lowered(F.lit(0.15), F.lit(1)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (20, 30, 0.075)


def test_deflate_and_noise(spark):
    m = memories(spark, [one(1, "who is my uncle", priority=True), one(2, "Conversation started from scratch", priority=True), one(3, "My wife is Ann", priority=True)])
    rows = {r["id"]: r for r in M.deflate(m).collect()}
    assert [rows[i]["is_priority"] for i in (1, 2, 3)] == [False, False, True] and rows[1]["confidence"] == 0.5
    assert [r["id"] for r in M.suppressed(M.suppress_noise(m)).collect()] == [2]


def test_correction_spares_priorities(spark):
    m = memories(spark, [one(1), one(2, priority=True), one(3, v=(0, 1))])
    q = F.array(F.lit(1.0), F.lit(0.0))
    assert [r["id"] for r in M.suppressed(M.corrected(m, q, "new")).collect()] == [1]
    assert sorted(r["id"] for r in M.suppressed(M.corrected(m, q, "new", spare_priority=False)).collect()) == [1, 2]


def test_insert_takes_defaults(spark):
    m = memories(spark, [one(1)])
    row = M.insert(m, spark.createDataFrame([(9, "new")], "id int, content string")).where("id = 9").first()
    assert (row["tier"], row["confidence"], row["is_suppressed"], row["access_count"]) == ("short", 1.0, False, 0)


def test_store_round_trip(spark, tmp_path):
    root = str(tmp_path / "store")
    ST.create_store(spark, root)
    ST.append(spark.createDataFrame([("a", "x", "u", 1)], "id string, content string, user_id string, seq long"), root, "memories")
    rows = ST.open_table(spark, root, "memories")
    assert rows.count() == 1 and rows.schema == S.schema("memories")
    ST.create_store(spark, root)
    assert ST.open_table(spark, root, "memories").count() == 1


def test_vectors_round_trip(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    rows = df.select(ST.unpacked_vector(ST.packed_vector(F.col("v"))).alias("v")).collect()
    assert [r["v"] for r in rows] == [[1.5, -2.0], None]


def test_profile_and_export(spark):
    m = memories(spark, [one(1)])
    assert "embedding" not in ST.exported(m).first()["json"]
    small = spark.createDataFrame([(1, "k")], "id int, pattern_key string")
    row = ST.profile(small, small, small, small, small).first()
    assert [len(row[c]) for c in ("rules", "clusters", "priority_memories", "entities", "relations")] == [1] * 5


@pytest.mark.parametrize("block", [2048, 2])
def test_many_searches_against_loops(spark, block):
    import numpy as np

    from palimpsest.operators import memory as M

    r = np.random.default_rng(4)
    v = np.round(r.normal(size=(60, 3)), 1)
    rows = [(i, [float(x) for x in v[i % 40]] if i % 9 else ([0.0, 0.0, 0.0] if i % 2 else None), i % 11 == 0) for i in range(60)] + [(70, [1.0], False)]
    asked = [(q, [float(x) for x in v[q]]) for q in range(5)] + [(9, None), (10, [0.0, 0.0, 0.0]), (11, [2.0])]
    m = spark.createDataFrame(rows, "id long, embedding array<float>, is_suppressed boolean").repartition(4)
    got = M.search_many(m, spark.createDataFrame(asked, "query_id int, query array<float>"), 7, block).collect()
    want = []
    for q, x in asked:
        hits = []
        for i, y, gone in rows:
            if not gone and x and y and len(x) == len(y) and np.linalg.norm(x) * np.linalg.norm(y) > 0:
                a, b = np.float32(x).astype(float), np.float32(y).astype(float)
                s = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)
                if s > 0:
                    hits.append((-s, i))
        want += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(hits)[:7], 1)]
    assert sorted((r["query_id"], r["id"], r["similarity"], r["rank"]) for r in got) == sorted(want)
