"""Queries on memories: filters, transitions, statistics, search, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import vector as V
from palimpsest.operators import memory as M
from palimpsest.operators import retrieval as R
from palimpsest.plans.registry import query
from palimpsest.sources import adapters as A
from palimpsest.sources import tables as ST

Spark, DF = SparkSession, DataFrame
MEM = "WITH " + A.MEMORIES + " "
FLAGS = ["id", "confidence", "session_count", "access_count", "is_priority", "is_suppressed", "suppression_reason", "tier"]
LIST = ", ".join(FLAGS)


@query(MEM + "SELECT id, confidence, tier FROM memories WHERE is_priority AND NOT is_suppressed", "fil_1_priority")
def fil_1(spark: Spark, sf: str) -> DF:
    return M.priority(A.memories(spark, sf)).select("id", "confidence", "tier")


@query(MEM + "SELECT id, suppression_reason FROM memories WHERE is_suppressed", "fil_2_suppressed")
def fil_2(spark: Spark, sf: str) -> DF:
    return M.suppressed(A.memories(spark, sf)).select("id", "suppression_reason")


@query(MEM + "SELECT id FROM memories m WHERE NOT EXISTS (SELECT 1 FROM memories s WHERE s.is_suppressed AND s.id = m.id)", "fil_3_not_suppressed_ids")
def fil_3(spark: Spark, sf: str) -> DF:
    m = A.memories(spark, sf)
    return m.select("id").join(M.suppressed_ids(m), "id", "left_anti")


@query(MEM + "SELECT id, session_count FROM memories WHERE session_count >= 10 AND access_count = 0 AND NOT is_suppressed AND NOT is_priority", "fil_4_stale")
def fil_4(spark: Spark, sf: str) -> DF:
    return M.stale(A.memories(spark, sf)).select("id", "session_count")


@query(MEM + f"SELECT {LIST} FROM memories WHERE id = 17", "fil_5_by_id")
def fil_5(spark: Spark, sf: str) -> DF:
    return M.by_id(A.memories(spark, sf), 17).select(*FLAGS)


@query(MEM + f"SELECT {', '.join(c for c in FLAGS if c not in ('confidence', 'is_suppressed', 'suppression_reason'))}, CASE WHEN id % 11 = 3 THEN 0.05::DOUBLE ELSE confidence END AS confidence, is_suppressed OR id % 11 = 3 AS is_suppressed, CASE WHEN id % 11 = 3 THEN 'user_denied' ELSE suppression_reason END AS suppression_reason FROM memories", "dml_1_suppress")
def dml_1(spark: Spark, sf: str) -> DF:
    m = A.memories(spark, sf)
    return M.suppress(m, m.where("id % 11 = 3").select("id"), "user_denied").select(*FLAGS)


@query(MEM + f"SELECT {', '.join(c for c in FLAGS if c not in ('confidence', 'is_suppressed', 'suppression_reason'))}, CASE WHEN is_suppressed THEN 0.8::DOUBLE ELSE confidence END AS confidence, false AS is_suppressed, CASE WHEN NOT is_suppressed THEN suppression_reason END AS suppression_reason FROM memories", "dml_2_restore")
def dml_2(spark: Spark, sf: str) -> DF:
    m = A.memories(spark, sf)
    return M.restore(m, M.suppressed_ids(m)).select(*FLAGS)


@query(MEM + "SELECT id, session_count + 1 AS session_count FROM memories", "dml_3_age")
def dml_3(spark: Spark, sf: str) -> DF:
    return M.age(A.memories(spark, sf)).select("id", "session_count")


@query(MEM + "SELECT m.id, (access_count + coalesce(n, 0))::INT AS access_count FROM memories m LEFT JOIN (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id) e ON e.id = m.id", "dml_4_touch")
def dml_4(spark: Spark, sf: str) -> DF:
    reads = A.table(spark, sf, "events").where("event_type = 'view'").select(F.col("user_id").alias("id"))
    return M.touched(A.memories(spark, sf), reads).select("id", "access_count")


@query(MEM + "SELECT id, round(CASE WHEN is_priority THEN least(1.0::DOUBLE, confidence * 1.5::DOUBLE) ELSE confidence END, 6) AS confidence FROM memories", "dml_5_boost")
def dml_5(spark: Spark, sf: str) -> DF:
    m = A.memories(spark, sf)
    return M.boost(m, m.where("is_priority"), M.boosted(F.col("confidence"))).select("id", F.round("confidence", 6).alias("confidence"))


@query(MEM + "SELECT id, session_count, is_suppressed FROM memories WHERE NOT (is_suppressed AND session_count >= 30)", "dml_6_purge")
def dml_6(spark: Spark, sf: str) -> DF:
    return M.purge(A.memories(spark, sf)).select("id", "session_count", "is_suppressed")


#: Memories that say something, among those that don't.
SAID = [
    (1, "User's greeting was friendly", True),
    (2, "The user initiated the conversation about rain", True),
    (3, "I'm a helpful AI assistant and more", True),
    (4, "Who is my father?", True),
    (5, "Who is my father, and where did he go after the long war in the north?", True),
    (6, "The meeting falls in week 32 of the year", False),
    (7, "My wife is Ann", True),
    (8, "no stored information about that", True),
    (9, "I'm a tireless writing assistant", True),
    (10, "", True),
]
SAID_SQL = "said AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}', {})".format(i, t.replace("'", "''"), p) for i, t, p in SAID) + ") AS t(id, content, is_priority))"
NOISE = r"user''?s?\s+greeting\s+was|user\s+initiated\s+the\s+conversation|user''?s?\s+question\s+was\s+a\s+simple|i''m a helpful ai assistant|i don''t recognize users|current date is|current day of the week|falls in week \d+|there are \d+ days in the month|conversation started from scratch|information found does not list|does not list the specific"
META = r"i''m a helpful ai|i don''t recognize|i''m a .* assistant|conversation started|no stored information"


def said(spark: Spark) -> DF:
    return spark.createDataFrame(SAID, "id int, content string, is_priority boolean")


@query(f"WITH {SAID_SQL} SELECT id::INT AS id, regexp_matches(lower(content), '{NOISE}') AS noise, regexp_matches(lower(content), '{META}') OR (starts_with(lower(content), 'who is my') AND length(content) < 30) AS meta FROM said", "fil_12_13_noise_and_meta")
def fil_12(spark: Spark, sf: str) -> DF:
    return said(spark).select("id", M.is_noise(F.col("content")).alias("noise"), M.is_meta(F.col("content")).alias("meta"))


@query(
    f"WITH {SAID_SQL}, " + A.MEMORIES + f", rows AS (SELECT m.id, m.confidence, m.is_suppressed, coalesce(s.content, '') AS c, coalesce(s.is_priority, m.is_priority) AS p FROM memories m LEFT JOIN said s ON s.id = m.id % 10 + 1), "
    f"hit AS (SELECT *, p AND NOT is_suppressed AND (regexp_matches(lower(c), '{NOISE}') OR regexp_matches(lower(c), '{META}') OR (starts_with(lower(c), 'who is my') AND length(c) < 30)) AS h FROM rows) "
    "SELECT id, CASE WHEN h THEN 0.5::DOUBLE ELSE confidence END AS confidence, p AND NOT h AS is_priority FROM hit",
    "dml_7_deflate",
)
def dml_7(spark: Spark, sf: str) -> DF:
    m = A.memories(spark, sf).drop("content").withColumnRenamed("is_priority", "_p")
    rows = m.join(said(spark).withColumnRenamed("id", "_k"), F.col("_k") == m["id"] % 10 + 1, "left").withColumn("is_priority", F.coalesce("is_priority", "_p"))
    return M.deflate(rows).select("id", "confidence", "is_priority")


@query(
    MEM + "SELECT count(*) FILTER (tier = 'short' AND NOT is_suppressed) AS short, count(*) FILTER (tier = 'mid' AND NOT is_suppressed) AS mid, count(*) FILTER (tier = 'long' AND NOT is_suppressed) AS long, count(*) FILTER (tier = 'priority' AND NOT is_suppressed) AS priority, count(*) FILTER (is_suppressed) AS suppressed, count(*) FILTER (is_priority AND NOT is_suppressed) AS is_priority, count(*) AS total FROM memories",
    "agg_1_memory_stats",
)
def agg_1(spark: Spark, sf: str) -> DF:
    return M.stats(A.memories(spark, sf))


@query(MEM + ", new AS (SELECT -1 - id AS id, 'corrected: ' || left(content, 20) AS content FROM memories WHERE id % 50 = 0) SELECT id, tier, confidence, source FROM memories UNION ALL SELECT id, 'short', 1.0::DOUBLE, 'conversation' FROM new", "src_3_insert_memory")
def src_3(spark: Spark, sf: str) -> DF:
    m = A.memories(spark, sf)
    new = m.where("id % 50 = 0").select((-1 - F.col("id")).alias("id"), F.concat(F.lit("corrected: "), F.substring("content", 1, 20)).alias("content"))
    return M.insert(m, new).select("id", "tier", "confidence", "source")


@query("SELECT conv_id AS session_id, count(*) AS messages, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS log FROM conversations GROUP BY conv_id", "src_4_conversation_records")
def src_4(spark: Spark, sf: str) -> DF:
    rows = ST.conversations(A.table(spark, sf, "conversations").withColumnRenamed("conv_id", "session_id"))
    return rows.select("session_id", F.size("messages").cast("long").alias("messages"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").alias("log"))


@query(MEM + "SELECT id, tier, confidence, is_priority FROM memories", "snk_1_export")
def snk_1(spark: Spark, sf: str) -> DF:
    rows = ST.exported(A.memories(spark, sf))
    return rows.select("id", F.from_json("json", "tier string, confidence double, is_priority boolean").alias("m")).select("id", "m.tier", "m.confidence", "m.is_priority")


VEC = f"vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), placed AS (SELECT m.*, v FROM memories m JOIN vecs ON vecs.id = m.vec_id)"


def placed(spark: Spark, sf: str) -> DF:
    return A.memories(spark, sf).join(A.vectors(spark, sf).select(F.col("id").alias("vec_id"), "embedding"), "vec_id")


ATTACHED = "vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), placed AS (SELECT m.*, v FROM memories m LEFT JOIN vecs ON vecs.id = m.id % (SELECT count(*) FROM embeddings))"


def attached(spark: Spark, sf: str) -> DF:
    """Every memory with the vector of its id modulo the number of vectors, null if there is none."""
    vectors = A.vectors(spark, sf).select(F.col("id").alias("vec_id"), "embedding")
    n = F.broadcast(vectors.agg(F.count("*").alias("_n")))
    rows = A.memories(spark, sf).drop("vec_id").join(n).withColumn("vec_id", F.expr("try_mod(id, _n)")).drop("_n")
    return rows.join(vectors, "vec_id", "left")


def query_set(spark: Spark, sf: str) -> DF:
    """The stated queries: every row whose id is divisible by 50."""
    return A.vectors(spark, sf).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def query_vector(spark: Spark, sf: str, n: int = 0):
    """A stored vector as a literal: one row by its key."""
    row = A.vectors(spark, sf).where(F.col("id") == n).first()
    return F.array(*[F.lit(float(x)) for x in row["embedding"]]) if row else F.lit(None).cast("array<double>")


@query(MEM + f", {VEC}, q AS (SELECT v AS q FROM vecs WHERE id = 0) SELECT id, round(list_cosine_similarity(v, q), 6) AS similarity, tier FROM placed, q WHERE NOT is_suppressed AND round(list_cosine_similarity(v, q), 6) > 0 ORDER BY 2 DESC, 1 LIMIT 10", "top_1_vector_search")
def top_1(spark: Spark, sf: str) -> DF:
    return M.search(placed(spark, sf), query_vector(spark, sf)).select("id", "similarity", "tier")


@query(
    MEM + f", {ATTACHED}, q AS (SELECT id AS query_id, v AS q FROM vecs WHERE id % 50 = 0), s AS (SELECT query_id, id, round(list_cosine_similarity(v, q), 6) AS similarity FROM placed, q WHERE NOT is_suppressed), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM s WHERE similarity > 0) SELECT query_id, id, similarity, rank FROM r WHERE rank <= 30",
    "top_2_over_fetch",
)
def top_2_all(spark: Spark, sf: str) -> DF:
    return M.search_many(attached(spark, sf), query_set(spark, sf), M.over_fetch(10)).select("query_id", "id", "similarity", "rank")


@query(MEM + f", {VEC}, q AS (SELECT v AS q FROM vecs WHERE id = 3), top AS (SELECT id, is_priority, content FROM placed, q WHERE NOT is_suppressed AND round(list_cosine_similarity(v, q), 6) > 0 ORDER BY round(list_cosine_similarity(v, q), 6) DESC, id LIMIT 5) SELECT id, is_suppressed OR id IN (SELECT id FROM top WHERE NOT is_priority) AS is_suppressed FROM memories", "dml_21_correction_suppresses_near")
def dml_21(spark: Spark, sf: str) -> DF:
    return M.corrected(placed(spark, sf), query_vector(spark, sf, 3), "a correction").select("id", "is_suppressed")


@query(MEM + f", {VEC}, q AS (SELECT v AS q FROM vecs WHERE id = 5), top AS (SELECT id, is_priority, content FROM placed, q WHERE NOT is_suppressed AND round(list_cosine_similarity(v, q), 6) > 0 ORDER BY round(list_cosine_similarity(v, q), 6) DESC, id LIMIT 5) SELECT id, CASE WHEN id IN (SELECT id FROM top) THEN 0.05::DOUBLE ELSE confidence END AS confidence FROM memories", "dml_23_manual_correct")
def dml_23(spark: Spark, sf: str) -> DF:
    return M.corrected(placed(spark, sf), query_vector(spark, sf, 5), "a correction", spare_priority=False).select("id", "confidence")


@query(MEM + "SELECT id, tier, content FROM memories WHERE is_priority ORDER BY seq DESC LIMIT 40", "top_12_priorities_newest")
def top_12(spark: Spark, sf: str) -> DF:
    return A.memories(spark, sf).where("is_priority").orderBy(F.desc("seq")).limit(40).select("id", "tier", "content")


@query("WITH vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM vecs a JOIN vecs b ON b.id = a.id + 1", "fn_1_cosine")
def fn_1(spark: Spark, sf: str) -> DF:
    v = A.vectors(spark, sf)
    other = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next"))
    return v.join(other, "id").select("id", F.round(V.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@query("WITH vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM vecs) SELECT id, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last, 100::INT AS size FROM n", "fn_2_3_normalise_and_resize")
def fn_2(spark: Spark, sf: str) -> DF:
    rows = A.vectors(spark, sf).select("id", V.resized(V.normalised(F.col("embedding")), 100).alias("v"))
    return rows.select("id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"), F.size("v").alias("size"))


@query(MEM + f", {VEC} SELECT id, round(confidence, 6) AS f1, round(least(access_count / 30.0::DOUBLE, 1.0), 6) AS f2, round(1.0::DOUBLE / (1.0 + 0.1::DOUBLE * session_count), 6) AS f3, is_priority::INT::DOUBLE AS f4, round((id % 4) / 3.0::DOUBLE, 6) AS f6, 384::INT AS size FROM placed", "prj_2_node_features")
def prj_2(spark: Spark, sf: str) -> DF:
    rows = R.features(placed(spark, sf))
    f = lambda i: F.get("features", F.lit(i))
    return rows.select("id", f(0).alias("f1"), f(1).alias("f2"), f(2).alias("f3"), f(3).alias("f4"), f(5).alias("f6"), F.size("vector").alias("size"))
