"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots, bytes and rows are summed per slot, and a
small versioned table says which shard holds which slot.  Version 1 deals the slots
out in turn.  ``rebalance`` reads the stored map, edits its last version and stores one
more: it moves a few slots from full shards to empty ones until their bytes are near
equal; records never hash anew, and earlier versions stay as they were.  The table has
a row per slot, so it and the sums may be handled on the driver and broadcast at any
size of the input.

A record's slot comes from its id and its text, so rows with one id, or none, spread
over all slots like any others; a row that is repeated
all over the table is dealt out by the number of its copy.  Equal texts of different ids lie in different slots: the law is about bytes, not about
keeping groups of equal texts together, and a group may be larger than a shard.

Null texts have no bytes; null ids are hashed like any other value.  Repeated rows get
places of their own.  Other columns are ignored.  An empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.llm.staging import staged

SHARDS = 24
SLOTS = 16384
#: Rebalancing stops when the fullest and the emptiest shard differ by so much of the mean.
TOLERANCE = 0.001

MAP_SCHEMA = "version int, slot int, shard int"


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def distinct_records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, text hash and how many rows are equal in these; summed before the shuffle, texts don't move."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of(F.col("text").cast("string")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


def slotted(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """A row for each copy of a record with its virtual slot."""
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return records.select("doc_id", "size", "text_crc32", "text_hash", copies).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), F.lit(slots)).cast("int"))


def slot_sums(rows: DataFrame) -> DataFrame:
    """virtual_slot, rows and bytes; at most a row per slot and task is shuffled."""
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def dealt(slots: int, shards: int) -> np.ndarray:
    """Version 1: slots in turn."""
    return np.arange(slots) % shards


def rebalanced(shard: np.ndarray, size: np.ndarray, shards: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """An edited map: single slots move from the fullest to the emptiest shard while that evens them."""
    shard = shard.copy()
    load = np.bincount(shard, size, shards).astype(np.int64)
    members = [sorted((int(size[s]), int(s)) for s in np.flatnonzero(shard == k) if size[s]) for k in range(shards)]
    for _ in range(4 * len(shard)):
        full, empty = int(np.argmax(load)), int(np.argmin(load))
        gap = load[full] - load[empty]
        if gap <= tolerance * load.mean() or not members[full]:
            break
        sizes = np.array([x[0] for x in members[full]])
        k = int(np.argmin(np.abs(sizes - gap / 2)))
        if sizes[k] >= gap:
            break
        moved = members[full].pop(k)
        members[empty].append(moved)
        load[full] -= moved[0]
        load[empty] += moved[0]
        shard[moved[1]] = empty
    return shard


def _version(version: int, shard: np.ndarray) -> pa.Table:
    n = len(shard)
    return pa.table({"version": pa.array(np.full(n, version), pa.int32()), "slot": pa.array(np.arange(n), pa.int32()), "shard": pa.array(shard, pa.int32())})


def new_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """A stored map whose version 1 deals the slots out in turn."""
    return staged(spark.createDataFrame(_version(1, dealt(slots, shards)), MAP_SCHEMA).coalesce(1), "slot-map")


def latest(versions: DataFrame) -> tuple[int, np.ndarray]:
    """The last version of a stored map: its number, and the shard of each slot."""
    number = versions.agg(F.max("version")).first()[0]
    rows = versions.where(F.col("version") == number).orderBy("slot").toArrow()
    if rows["slot"].to_pylist() != list(range(len(rows))):
        raise ValueError("a version names each slot once")
    return number, rows["shard"].to_numpy().astype(np.int64)


def rebalance(versions: DataFrame, sums: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The stored map with one version more, edited from its last by the bytes of each slot.

    ``shards`` may be larger than before: empty shards then fill with slots of the others.
    """
    spark = versions.sparkSession
    number, shard = latest(versions)
    told = sums.toArrow()
    size = np.zeros(len(shard), np.int64)
    size[told["virtual_slot"].to_numpy()] = told["bytes"].to_numpy()
    edited = spark.createDataFrame(_version(number + 1, rebalanced(shard, size, shards)), MAP_SCHEMA)
    return staged(versions.unionByName(edited).coalesce(1), "slot-map")


def assigned(rows: DataFrame, sums: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows with shard, slot (their place in the shard, from 0) and map_version, by the last version of a map."""
    number, shard = latest(versions)
    told = sums.select("virtual_slot", "rows").toArrow()
    count, first = np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64)
    count[told["virtual_slot"].to_numpy()] = told["rows"].to_numpy()
    for k in np.unique(shard):
        own = np.flatnonzero(shard == k)
        first[own] = np.cumsum(count[own]) - count[own]
    held = rows.sparkSession.createDataFrame(pa.table({"virtual_slot": pa.array(np.arange(len(shard)), pa.int32()), "shard": pa.array(shard, pa.int32()), "first": first}), "virtual_slot int, shard int, first long")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "text_hash", "copy")) - 1
    return rows.withColumn("place", place).join(F.broadcast(held), "virtual_slot").withColumns({"slot": F.col("first") + F.col("place"), "map_version": F.lit(number)}).drop("first", "place")


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, versions: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the place in the shard, from 0), grown_shard, virtual_slot, map_version.

    ``versions`` is a stored map to edit; without one a new map is begun.
    """
    rows = slotted(staged(distinct_records(docs), "records"), slots)
    sums = staged(slot_sums(rows), "slot-sums")
    versions = rebalance(new_map(docs.sparkSession, slots, shards) if versions is None else versions, sums, shards)
    return assigned(rows, sums, versions).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
