"""The benchmark tables as tables of the memory engine.

Each adapter is a deterministic rule with the same meaning in DuckDB; the SQL
next to it is what the registered queries are checked against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many vectors there are; memories are given them in turn.
VECTORS = "(SELECT count(*) FROM embeddings)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_count(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").count()


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels as memories."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    quality = F.col("quality")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.element_at(F.array(*[F.lit(t) for t in ("short", "mid", "long", "priority")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("tier"),
        F.coalesce(0.5 + 0.5 * quality, F.lit(0.8)).alias("confidence"),
        (F.col("doc_id") % 40).cast("int").alias("session_count"),
        (F.col("doc_id") % 7).cast("int").alias("access_count"),
        F.coalesce((quality == 1) & (F.col("doc_id") % 5 == 0), F.lit(False)).alias("is_priority"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_suppressed"),
        F.when(F.col("toxic") == 1, "manual").alias("suppression_reason"),
        "source",
        F.expr(f"try_mod(doc_id, {vector_count(spark, sf_dir)}L)").alias("vec_id"),
        F.col("doc_id").alias("seq"),
    )


MEMORIES = f"""memories AS (
  SELECT d.doc_id AS id, text AS content, (['short', 'mid', 'long', 'priority'])[(d.doc_id % 4 + 1)::INT] AS tier,
    coalesce(0.5::DOUBLE + 0.5::DOUBLE * quality, 0.8::DOUBLE) AS confidence, (d.doc_id % 40)::INT AS session_count, (d.doc_id % 7)::INT AS access_count,
    coalesce(quality = 1 AND d.doc_id % 5 = 0, false) AS is_priority, coalesce(toxic = 1, false) AS is_suppressed,
    CASE WHEN toxic = 1 THEN 'manual' END AS suppression_reason, source, d.doc_id % {VECTORS} AS vec_id, d.doc_id AS seq
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations: session, turn, message."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("message"))


TURNS = "turns AS (SELECT conv_id AS session_id, turn, text AS message FROM conversations WHERE role = 'user')"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pattern observations; a day is a session."""
    return table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 20).cast("string")).alias("pattern_key"),
        F.date_format("ts", "yyyy-MM-dd").alias("session_id"),
        F.col("event_id").alias("seq"),
    )


OBSERVATIONS = "observations AS (SELECT event_type || '_' || (user_id % 20)::VARCHAR AS pattern_key, strftime(ts, '%Y-%m-%d') AS session_id, event_id AS seq FROM events)"


def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signals of entities: entity_id, signal, delta, seq."""
    names = F.create_map(*[F.lit(x) for p in (("click", "dopamine"), ("view", "acetylcholine"), ("purchase", "serotonin"), ("signup", "norepinephrine"), ("error", "gaba")) for x in p])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.element_at(names, F.col("event_type")).alias("signal"), F.when(F.col("event_type") == "error", F.lit(-0.25)).otherwise(0.125).alias("delta"), F.col("event_id").alias("seq"))


STATE_EVENTS = """state_events AS (
  SELECT user_id AS entity_id, CASE event_type WHEN 'click' THEN 'dopamine' WHEN 'view' THEN 'acetylcholine' WHEN 'purchase' THEN 'serotonin' WHEN 'signup' THEN 'norepinephrine' WHEN 'error' THEN 'gaba' END AS signal,
    CASE WHEN event_type = 'error' THEN -0.25::DOUBLE ELSE 0.125::DOUBLE END AS delta, event_id AS seq FROM events)"""

#: Members of a family besides the customer (member 0).
KIN = ("father", "mother", "wife", "sister", "father_in_law")


def unsized(df: DataFrame) -> DataFrame:
    """Rows that joins meet by a sort and not by a broadcast: exploded rows are estimated as large as those they come from,
    so a size check lets millions of them into the driver.
    """
    return df.hint("merge")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and five kin of each: id, name, entity_type, seq."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("f"), F.col("c_name").alias("c_name"))
    rows = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(KIN))))).select(
        (F.col("f") * 8 + F.col("k")).alias("id"), F.when(F.col("k") == 0, F.col("c_name")).otherwise(F.concat(F.lit("Kin"), F.col("f").cast("string"), F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), F.greatest("k", F.lit(1))))).alias("name"), F.lit("person").alias("entity_type"), (F.col("f") * 8 + F.col("k")).alias("seq")
    )
    return unsized(rows)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's kin, and chains of up to three families by a father's father."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("f"))
    kin = F.array(*[F.lit(k) for k in KIN])
    near = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(len(KIN))))).select(
        (F.col("f") * 8).alias("subject_id"), F.element_at(kin, F.col("k")).alias("predicate"), (F.col("f") * 8 + F.col("k")).alias("object_id"), F.when((F.col("f") + F.col("k")) % 5 == 0, F.lit(0.7)).otherwise(1.0).alias("confidence"), (F.col("f") * 16 + F.col("k")).alias("seq")
    )
    far = c.where("f % 3 <> 2").select((F.col("f") * 8 + 1).alias("subject_id"), F.lit("father").alias("predicate"), ((F.col("f") + 1) * 8).alias("object_id"), F.lit(0.9).alias("confidence"), (F.col("f") * 16 + 9).alias("seq"))
    return unsized(near.unionByName(far).select(F.col("seq").alias("id"), "subject_id", "predicate", "object_id", "confidence", F.lit(False).alias("is_inferred"), "seq"))




def chain(id: str) -> Column:
    """The chain of families that an entity is in; relations stay inside one."""
    return F.floor(F.col(id) / 24)


GRAPH = """entities AS (
  SELECT c_custkey * 8 + k AS id, CASE WHEN k = 0 THEN c_name ELSE 'Kin' || c_custkey::VARCHAR || ' ' || (['A', 'B', 'C', 'D', 'E'])[greatest(k, 1)] END AS name, 'person' AS entity_type, c_custkey * 8 + k AS seq
  FROM customer, unnest(range(0, 6)) AS t(k)
), relations AS (
  SELECT c_custkey * 16 + k AS id, c_custkey * 8 AS subject_id, (['father', 'mother', 'wife', 'sister', 'father_in_law'])[k] AS predicate, c_custkey * 8 + k AS object_id,
    CASE WHEN (c_custkey + k) % 5 = 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS confidence, false AS is_inferred, c_custkey * 16 + k AS seq FROM customer, unnest(range(1, 6)) AS t(k)
  UNION ALL SELECT c_custkey * 16 + 9, c_custkey * 8 + 1, 'father', (c_custkey + 1) * 8, 0.9::DOUBLE, false, c_custkey * 16 + 9 FROM customer WHERE c_custkey % 3 <> 2
)"""
