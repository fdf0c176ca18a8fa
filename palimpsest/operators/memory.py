"""Operators on the memories table: filters, state transitions, statistics, search.

A transition takes a snapshot and gives the next one; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest import lexicon as L
from palimpsest.functions import text as T
from palimpsest.functions import vector as V
from palimpsest.schema import TIERS

SUPPRESSED_CONFIDENCE, RESTORED_CONFIDENCE, DEFLATED_CONFIDENCE = 0.05, 0.8, 0.5
STALE_SESSIONS, PURGE_SESSIONS = 10, 30
TOP_K, WIDEST, THRESHOLD = 10, 30, 0.15


# filters


def priority(memories: DataFrame) -> DataFrame:
    return memories.where("is_priority AND NOT is_suppressed")


def suppressed(memories: DataFrame) -> DataFrame:
    return memories.where("is_suppressed")


def suppressed_ids(memories: DataFrame) -> DataFrame:
    return suppressed(memories).select("id")


def stale(memories: DataFrame, sessions: int = STALE_SESSIONS) -> DataFrame:
    """Old, never read, neither suppressed nor a priority."""
    return memories.where((F.col("session_count") >= sessions) & (F.col("access_count") == 0) & ~F.col("is_suppressed") & ~F.col("is_priority"))


def by_id(memories: DataFrame, id: object) -> DataFrame:
    return memories.where(F.col("id") == F.lit(id))


def is_noise(content: Column) -> Column:
    return T.any_pattern(content, L.NOISE_PATTERNS)


def is_meta(content: Column) -> Column:
    """Statements about the assistant, and short questions that are only echoed."""
    low = F.lower(content)
    return T.any_pattern(content, L.META_PATTERNS) | (low.startswith("who is my") & (F.length(content) < 30))


# transitions


def _change(memories: DataFrame, ids: DataFrame, **values: Column) -> DataFrame:
    """New values for the memories that ``ids`` (id) names; unknown ids change nothing."""
    marked = memories.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return marked.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}).select(*memories.columns)


def suppress(memories: DataFrame, ids: DataFrame, reason: str) -> DataFrame:
    return _change(memories, ids, is_suppressed=F.lit(True), confidence=F.lit(SUPPRESSED_CONFIDENCE), suppression_reason=F.lit(reason))


def restore(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Undo a suppression; a priority stays one."""
    return _change(memories, ids, is_suppressed=F.lit(False), confidence=F.lit(RESTORED_CONFIDENCE), suppression_reason=F.lit(None).cast("string"))


def age(memories: DataFrame) -> DataFrame:
    return memories.withColumn("session_count", F.col("session_count") + 1)


def touched(memories: DataFrame, reads: DataFrame) -> DataFrame:
    """Add to ``access_count`` how often ``reads`` (id) names a memory."""
    counts = reads.groupBy("id").agg(F.count("*").cast("int").alias("_reads"))
    return memories.join(counts, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("_reads", F.lit(0))).select(*memories.columns)


def boosted(confidence: Column, factor: float = 1.5) -> Column:
    return F.least(F.lit(1.0), confidence * factor)


def boost(memories: DataFrame, ids: DataFrame, value: Column) -> DataFrame:
    return _change(memories, ids, confidence=value)


def purge(memories: DataFrame, sessions: int = PURGE_SESSIONS) -> DataFrame:
    """Without what has been suppressed for that many sessions."""
    return memories.where(~(F.col("is_suppressed") & (F.col("session_count") >= sessions)))


def suppress_noise(memories: DataFrame) -> DataFrame:
    hit = is_noise(F.col("content")) & ~F.col("is_suppressed")
    return memories.withColumns({"confidence": F.when(hit, SUPPRESSED_CONFIDENCE).otherwise(F.col("confidence")), "suppression_reason": F.when(hit, "noise_detected").otherwise(F.col("suppression_reason")), "is_suppressed": F.col("is_suppressed") | hit})


def deflate(memories: DataFrame) -> DataFrame:
    """Priorities that are noise or about the assistant lose their rank."""
    hit = F.col("is_priority") & ~F.col("is_suppressed") & (is_noise(F.col("content")) | is_meta(F.col("content")))
    return memories.withColumns({"confidence": F.when(hit, DEFLATED_CONFIDENCE).otherwise(F.col("confidence")), "is_priority": F.col("is_priority") & ~hit})


def insert(memories: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows; columns that they lack take their defaults."""
    defaults = {"tier": F.lit("short"), "confidence": F.lit(1.0), "session_count": F.lit(0), "access_count": F.lit(0), "is_priority": F.lit(False), "is_suppressed": F.lit(False), "source": F.lit("conversation")}
    for name, kind in memories.dtypes:
        if name not in new.columns:
            new = new.withColumn(name, defaults.get(name, F.lit(None)).cast(kind))
    return memories.unionByName(new.select(*memories.columns))


# statistics


def stats(memories: DataFrame) -> DataFrame:
    """One row: unsuppressed memories by tier, suppressed, priority and all."""
    live = ~F.col("is_suppressed")
    return memories.agg(
        *[F.count_if((F.col("tier") == t) & live).alias(t) for t in TIERS],
        F.count_if("is_suppressed").alias("suppressed"),
        F.count_if(F.col("is_priority") & live).alias("is_priority"),
        F.count("*").alias("total"),
    )


# search


def widened(k: Column, times: Column) -> Column:
    """Results after so many alarms: doubled each time, up to the widest."""
    return F.least(F.lit(WIDEST), k * F.pow(F.lit(2), times)).cast("int")


def lowered(threshold: Column, times: Column) -> Column:
    return threshold * F.pow(F.lit(0.5), times)


def search(memories: DataFrame, query: Column, k: int = TOP_K) -> DataFrame:
    """The k live memories most similar to a vector, with ``similarity`` above zero."""
    rows = memories.where("NOT is_suppressed AND embedding IS NOT NULL").withColumn("similarity", F.round(V.cosine(F.col("embedding"), query), 6))
    return rows.where("similarity > 0").orderBy(F.desc("similarity"), "id").limit(k)


#: Queries that are held against the memories at once.
QUERY_BLOCK = 2048


def search_many(memories: DataFrame, queries: DataFrame, k: int = TOP_K, block: int = QUERY_BLOCK) -> DataFrame:
    """The same for each row of ``queries`` (query_id, query): the memories' columns with query_id, similarity and rank.

    Queries are broadcast in blocks of a bounded size.  Memories are multiplied with a
    block batch by batch, where they are read, and of each batch only the best k of each
    query go on, so what is shuffled does not grow with the pairs.
    """
    live = memories.where("NOT is_suppressed AND embedding IS NOT NULL AND id IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = StructType.fromDDL(f"query_id {dict(queries.dtypes)['query_id']}, id {dict(memories.dtypes)['id']}, similarity double")
    told = queries.where("query IS NOT NULL").select("query_id", F.col("query").cast("array<double>").alias("query"))
    blocks = max(1, -(-told.count() // block))
    hits = None
    for b in range(blocks):
        own = told.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else told
        found = _best(live, own, k, schema)
        hits = found if hits is None else hits.unionByName(found)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return memories.join(hits.withColumn("rank", place).where(F.col("rank") <= k), "id")


def _best(live: DataFrame, queries: DataFrame, k: int, schema: StructType) -> DataFrame:
    """query_id, id, similarity: of each batch of memories the best k of each query."""
    told = queries.toArrow()
    vectors = [np.array(v, float) for v in told["query"].to_pylist()]
    by_width: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if np.linalg.norm(v) > 0:
            by_width.setdefault(len(v), []).append(i)
    groups = [(w, np.array(at), np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in at]).T) for w, at in by_width.items()]
    held = live.sparkSession.sparkContext.broadcast((told["query_id"].combine_chunks(), groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        names, groups = held.value
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            order = pc.rank(ids, sort_keys="ascending").to_numpy()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for width, at, unit in groups:
                rows = np.flatnonzero(sizes == width)
                if not len(rows):
                    continue
                m = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                norm = np.linalg.norm(m, axis=1)
                sim = np.nan_to_num(np.round(m @ unit / np.where(norm > 0, norm, 1)[:, None], 6))
                for j, q in enumerate(at.tolist()):
                    own = np.flatnonzero(sim[:, j] > 0)
                    if len(own) > k:  # all that are as good as the k-th best
                        own = own[sim[own, j] >= np.partition(sim[own, j], len(own) - k)[len(own) - k]]
                    own = own[np.lexsort((order[rows[own]], -sim[own, j]))[:k]]
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array([names[q].as_py()] * len(own), to[0].type), ids.take(pa.array(rows[own])).cast(to[1].type), pa.array(sim[own, j])], schema=to)

    return live.mapInArrow(run, schema)


def over_fetch(k: int) -> int:
    return min(3 * k, 100)


def corrected(memories: DataFrame, query: Column, content: str, k: int = 5, spare_priority: bool = True) -> DataFrame:
    """Suppress what is near a correction: the top k but those with the same words, and priorities if they are spared."""
    hits = search(memories, query, k).where(F.col("content") != content)
    if spare_priority:
        hits = hits.where("NOT is_priority")
    return suppress(memories, hits, "contradicted")

