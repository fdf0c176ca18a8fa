"""Snapshots, logs and exports of the engine's tables."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import schema as S


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a store, with its declared types and no inference."""
    return spark.read.schema(S.schema(name)).parquet(f"{root}/{name}")


def create_store(spark: SparkSession, root: str) -> None:
    """Empty tables, where there are none."""
    for name in S.DDL:
        S.empty(spark, name).write.mode("ignore").parquet(f"{root}/{name}")


def append(new: DataFrame, root: str, name: str) -> None:
    """Add rows to a table; columns that are missing are null."""
    kinds = {f.name: f.dataType for f in S.schema(name)}
    new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]).write.mode("append").parquet(f"{root}/{name}")


def write_snapshot(df: DataFrame, root: str, name: str, version: int) -> str:
    """The next version of a table beside the older ones; readers choose one."""
    path = f"{root}/{name}/version={version}"
    df.write.mode("error").parquet(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint; only a local session gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        told = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not told and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="palimpsest-"))
    return df.checkpoint()


def stable_id(*parts: Column) -> Column:
    """An id that the same content always gets, in place of a random one."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256), 1, 32)


def conversations(turns: DataFrame) -> DataFrame:
    """session_id, messages: each session's messages in order, as one record."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("session_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


def exported(memories: DataFrame) -> DataFrame:
    """id, json: every column but the vector."""
    return memories.select("id", F.to_json(F.struct(*[c for c in memories.columns if c != "embedding"])).alias("json"))


def training_lines(pairs: DataFrame) -> DataFrame:
    """value: a line of JSON with a user and an assistant message, from (question, answer)."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    return pairs.select(F.to_json(F.struct(F.array(message("user", "question"), message("assistant", "answer")).alias("messages"))).alias("value"))


def profile(rules: DataFrame, clusters: DataFrame, priority: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: the rules, clusters, priority memories and graph of one user as nested lists, all of them.

    The tables are one user's; a profile is one value, so it has to fit into one.
    """

    def listed(df: DataFrame, name: str, order: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c != order]))).alias(name))

    parts = [listed(rules, "rules", "pattern_key"), listed(clusters, "clusters", "id"), listed(priority, "priority_memories", "id"), listed(entities, "entities", "id"), listed(relations, "relations", "id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)
    return out


def profile_pieces(rules: DataFrame, clusters: DataFrame, priority: DataFrame, entities: DataFrame, relations: DataFrame, rows: int = 1024) -> DataFrame:
    """name, piece, items: the lists of ``profile`` as JSON arrays of at most so many rows, for graphs that don't fit into one value.

    The pieces of a name in order are its whole list in order of its key: rows are
    dealt by ranges of the key and numbered inside their range.
    """

    def listed(df: DataFrame, name: str, order: str) -> DataFrame:
        item = F.struct(order, *[c for c in df.columns if c != order])
        in_order = df.repartitionByRange(order).sortWithinPartitions(order).select(item.alias("item"), F.monotonically_increasing_id().alias("n"))
        pieces = in_order.groupBy(F.expr(f"n DIV {rows}").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("items"))
        return pieces.select(F.lit(name).alias("name"), "piece", F.to_json(F.transform("items", lambda x: x["item"])).alias("items"))

    parts = [listed(rules, "rules", "pattern_key"), listed(clusters, "clusters", "id"), listed(priority, "priority_memories", "id"), listed(entities, "entities", "id"), listed(relations, "relations", "id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unpacked_vector(blob: Column) -> Column:
    """A vector from packed little-endian 32-bit floats."""

    @F.pandas_udf("array<float>")
    def unpack(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return unpack(blob)


def packed_vector(vector: Column) -> Column:
    @F.pandas_udf("binary")
    def pack(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return pack(vector)


def balanced(rows: DataFrame, label: str, most: int, seed: int = 7) -> DataFrame:
    """At most so many rows of each label, chosen by a hash of the id that does not depend on partitions."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    return rows.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def labelled_texts(rows: DataFrame, label_map: dict[str, str], shortest: int = 5, longest: int = 200) -> DataFrame:
    """Texts of a length in letters, their labels mapped; others go."""
    pairs = F.create_map(*[F.lit(x) for p in label_map.items() for x in p])
    return rows.where(F.length("text").between(shortest, longest)).withColumn("label", F.element_at(pairs, F.col("label"))).where("label IS NOT NULL")


def latest_snapshot(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A version of a table, by default the last."""
    rows = spark.read.parquet(f"{root}/{name}")
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == version).drop("version")


def unit_vectors(memories: DataFrame) -> DataFrame:
    """id, embedding of live memories at unit length: what a vector search reads, made anew from the table."""
    from palimpsest.functions import vector as V

    unit = V.normalised(F.col("embedding"))
    return memories.where("NOT is_suppressed").select("id", unit.alias("embedding")).where("embedding IS NOT NULL")


def indexed(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after memories were added (or changed) and ids removed, without reading the others anew."""
    new = unit_vectors(added)
    stay = index.join(new.select("id").unionByName(added.where("is_suppressed").select("id")).unionByName(removed.select("id")).distinct(), "id", "left_anti")
    return stay.unionByName(new.join(removed.select("id").distinct(), "id", "left_anti"))


def save_model(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    """A model's arrays as a table of flat values with their shapes, so that any executor can read it."""
    rows = [(k, list(v.shape), np.asarray(v, float).ravel().tolist()) for k, v in sorted(arrays.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, value array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict[str, np.ndarray] | None:
    """The arrays of a saved model, or nothing if there is none: a caller then does without it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
