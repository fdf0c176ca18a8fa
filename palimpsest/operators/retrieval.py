"""Ranking of memories: mentions, boosts and the hybrid score."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions import vector as V
from palimpsest.operators import graph as G
from palimpsest.operators import memory as M
from palimpsest.shipping import ship

#: Weights of similarity, activation, graph and resting boost.
WEIGHTS = (0.42, 0.33, 0.18, 0.07)
DEFAULT_ACTIVATION, PRIORITY_ACTIVATION = 0.1, 0.3
STATES, ACTIVE = 30, 0.01


#: Bytes of names that one automaton holds; more names take more passes over the texts.
NAME_BYTES = 8 << 20


def mentions(texts: DataFrame, entities: DataFrame, least: int = 1, name_bytes: int = NAME_BYTES) -> DataFrame:
    """text_id, id: texts that hold an entity's name anywhere, names longer than ``least`` letters.

    A name may stand inside a word, so no token join finds it.  The names are put into
    automata of a bounded size, which are broadcast, and each text is read once for each
    automaton, whatever the number of names.  Null texts and null names name nothing.
    """
    names = entities.where(F.length("name") > least).select("id", F.lower("name").alias("name"))
    size = names.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0
    parts = max(1, -(-size // name_bytes))
    ship(texts.sparkSession)
    low = texts.where("text IS NOT NULL").select("text_id", F.lower("text").alias("text"))
    kind, id_kind = dict(texts.dtypes)["text_id"], dict(entities.dtypes)["id"]
    out = None
    for part in range(parts):
        own = names.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part) if parts > 1 else names
        found = _named(low, own, f"text_id {kind}, id {id_kind}")
        out = found if out is None else out.unionByName(found)
    return out


def _packed(told: pa.Table) -> bytes:
    """A table as compressed bytes: the driver keeps those of every part of the names, and a table of lists takes ten times as much."""
    to = pa.BufferOutputStream()
    with pa.ipc.new_stream(to, told.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(told)
    return to.getvalue().to_pybytes()


def _named(texts: DataFrame, names: DataFrame, schema: str) -> DataFrame:
    """Texts (text_id, text) against names (id, name) that fit into one automaton, in lower case both."""
    held = texts.sparkSession.sparkContext.broadcast(_packed(names.toArrow()))
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(fields)
        told = pa.ipc.open_stream(held.value).read_all()
        ids: dict[str, list] = {}
        for i, n in zip(told["id"].to_pylist(), told["name"].to_pylist(), strict=True):
            ids.setdefault(n, []).append(i)
        automaton = ahocorasick.Automaton()
        while ids:
            automaton.add_word(*ids.popitem())
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            one, two = [], []
            for text_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(automaton) else ():
                for i in sorted({i for _, own in automaton.iter(text) for i in own}):
                    one.append(text_id)
                    two.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(one, to[0].type), pa.array(two, to[1].type)], schema=to)

    return texts.mapInArrow(run, fields)


def co_mentioned(mentioned: DataFrame) -> DataFrame:
    """a, b, texts: entities that a text names together."""
    x, y = mentioned.select("text_id", F.col("id").alias("a")), mentioned.select("text_id", F.col("id").alias("b"))
    return x.join(y, "text_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("texts"))


def graph_boosts(query_entities: DataFrame, relations: DataFrame, mentioned: DataFrame, entities: DataFrame) -> DataFrame:
    """text_id, graph_boost: memories that name the query's entities or their neighbours, 0.3 and a quarter for each name."""
    near = G.touching(relations, query_entities).select(F.explode(F.array("subject_id", "object_id")).alias("id")).unionByName(query_entities.select("id")).distinct()
    names = entities.join(near, "id", "left_semi").where(F.length("name") > 2).select("id", F.lower("name").alias("name"))
    hits = mentioned.join(names, "id").groupBy("text_id").agg(F.countDistinct("name").alias("n"))
    return hits.select("text_id", F.least(F.lit(1.0), F.round(0.3 + F.col("n") * 0.25, 6)).alias("graph_boost"))


def resting_boosts(states: DataFrame, mentioned: DataFrame, limit: int = STATES) -> DataFrame:
    """text_id, resting_boost: the highest activation among the named entities, of the most active ones."""
    top = states.where(F.col("resting_activation") > ACTIVE).orderBy(F.desc("resting_activation"), "entity_id").limit(limit)
    return mentioned.join(top.select(F.col("entity_id").alias("id"), "resting_activation"), "id").groupBy("text_id").agg(F.least(F.lit(1.0), F.max("resting_activation")).alias("resting_boost"))


def multiplier(confidence: Column) -> Column:
    return 0.8 + 0.2 * confidence


def hybrid(memories: DataFrame, query: Column, activations: DataFrame, boosts: DataFrame, resting: DataFrame, k: int = M.TOP_K, weights: tuple[float, float, float, float] = WEIGHTS) -> DataFrame:
    """The k best memories by the weighted score, out of three times as many by similarity.

    activations (id, activation), boosts (text_id, graph_boost) and resting
    (text_id, resting_boost) may lack a memory.
    """
    found = M.search(memories, query, M.over_fetch(k))
    rows = found.join(activations.select("id", "activation"), "id", "left").join(boosts.withColumnRenamed("text_id", "id"), "id", "left").join(resting.withColumnRenamed("text_id", "id"), "id", "left")
    act = F.coalesce("activation", F.lit(DEFAULT_ACTIVATION))
    act = F.when(F.col("is_priority"), F.greatest(act, F.lit(PRIORITY_ACTIVATION))).otherwise(act)
    parts = (F.col("similarity"), act, F.coalesce("graph_boost", F.lit(0.0)), F.coalesce("resting_boost", F.lit(0.0)))
    score = (weights[0] * parts[0] + weights[1] * parts[1] + weights[2] * parts[2] + weights[3] * parts[3]) * multiplier(F.col("confidence"))
    out = rows.select("id", F.round(score, 6).alias("final_score"), "similarity", F.round(parts[1], 6).alias("activation"), parts[2].alias("graph_boost"), parts[3].alias("resting_boost"), "is_priority", "tier")
    return out.orderBy(F.desc("final_score"), "id").limit(k)


def rows_of(scored: DataFrame, memories: DataFrame) -> DataFrame:
    """Memory rows in the order of their scores."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "id"))) if "rank" not in scored.columns else scored
    return memories.join(ranked.select("id", "rank"), "id").orderBy("rank")


def features(memories: DataFrame, size: int = 384) -> DataFrame:
    """id, features (eight numbers) and the vector at a fixed length."""
    tier = F.array_position(F.array(*[F.lit(t) for t in ("short", "mid", "long", "priority")]), F.col("tier"))
    numbers = F.array(
        F.col("confidence"),
        F.least(F.col("access_count") / 30.0, F.lit(1.0)),
        1.0 / (1.0 + 0.1 * F.col("session_count")),
        F.col("is_priority").cast("double"),
        F.col("is_suppressed").cast("double"),
        (F.greatest(tier - 1, F.lit(0)) / 3.0).cast("double"),
        F.col("content").startswith("[Web]").cast("double"),
        F.col("content").startswith("User said:").cast("double"),
    )
    return memories.select("id", F.transform(numbers, lambda x: F.round(x, 6)).alias("features"), V.resized(F.col("embedding"), size).alias("vector"))
