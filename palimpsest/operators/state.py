"""Keyed state of entities: activation, signal history, receptors, masks, sentinels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import lexicon as L
from palimpsest.functions import text as T

HIGHEST, LOWEST = 2.0, 0.0
RECEPTOR_STEP, RECEPTOR_MOST, RECEPTOR_REST = 0.05, 3.0, 1.0
DECAY, DECAY_FLOOR, RECEPTOR_DECAY = 0.95, 0.001, 0.01
MENTIONED, AFFECTED = 0.05, 0.03


def clamped(x: Column) -> Column:
    return F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), x))


def activated(events: DataFrame, start: float = 0.0) -> DataFrame:
    """entity_id, resting_activation, total_activations: a clamped sum in order of ``seq``.

    Clamping makes the order matter, so an entity's deltas are folded in turn.  Runs
    of events of one entity are the unit of memory.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    fold = F.aggregate("deltas", F.lit(start), lambda a, e: clamped(a + e["delta"]))
    return events.groupBy("entity_id").agg(ordered.alias("deltas"), F.count("*").alias("total_activations")).select("entity_id", F.round(fold, 6).alias("resting_activation"), "total_activations")


def receptors(events: DataFrame) -> DataFrame:
    """entity_id, signal, signal_count, receptor: density grows by a step for each signal, to a most."""
    n = F.count("*")
    return events.groupBy("entity_id", "signal").agg(n.alias("signal_count"), F.least(F.lit(RECEPTOR_MOST), F.round(F.lit(RECEPTOR_REST) + RECEPTOR_STEP * n, 4)).alias("receptor"))


def as_maps(receptors: DataFrame) -> DataFrame:
    """entity_id, signal_history, receptor_density."""
    return receptors.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", F.col("signal_count").cast("int"))))).alias("signal_history"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "receptor")))).alias("receptor_density"))


def with_defaults(entities: DataFrame, states: DataFrame) -> DataFrame:
    """Every entity with its state, or that of a new one."""
    return entities.select(F.col("id").alias("entity_id")).join(states, "entity_id", "left").select("entity_id", F.coalesce("resting_activation", F.lit(0.0)).alias("resting_activation"), F.coalesce("total_activations", F.lit(0).cast("long")).alias("total_activations"))


def flood(events: DataFrame) -> DataFrame:
    """entity_id, boost: events raise an activation by a share of the receptor as it is before the signal is recorded.

    ``events``: entity_id, signal, mentioned, seq.  The n-th event of a signal finds
    a receptor of 1 + step * (n - 1), up to the most.
    """
    from pyspark.sql import Window

    before = F.row_number().over(Window.partitionBy("entity_id", "signal").orderBy("seq")) - 1
    receptor = F.least(F.lit(RECEPTOR_MOST), F.round(F.lit(RECEPTOR_REST) + RECEPTOR_STEP * before, 4))
    return events.withColumn("boost", F.when(F.col("mentioned"), MENTIONED).otherwise(AFFECTED) * receptor).groupBy("entity_id").agg(F.round(F.sum("boost"), 6).alias("boost"))


def decayed(states: DataFrame, factor: float = DECAY) -> DataFrame:
    """Activations shrink; what falls to the floor is nothing."""
    x = F.col("resting_activation")
    shrunk = F.when(x > DECAY_FLOOR, x * factor).otherwise(x)
    return states.withColumn("resting_activation", F.when(shrunk <= DECAY_FLOOR, 0.0).otherwise(shrunk))


def receptor_decayed(density: Column, step: float = RECEPTOR_DECAY) -> Column:
    """Densities move towards rest by a step."""
    return F.transform_values(density, lambda _, v: F.round(F.when(v > RECEPTOR_REST, F.greatest(F.lit(RECEPTOR_REST), v - step)).when(v < RECEPTOR_REST, F.least(F.lit(RECEPTOR_REST), v + step)).otherwise(v), 4))


def without_orphans(states: DataFrame, entities: DataFrame) -> DataFrame:
    return states.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")


def top(states: DataFrame, n: int) -> DataFrame:
    return states.orderBy(F.desc("resting_activation"), "entity_id").limit(n)


def with_sentinels(states: DataFrame) -> DataFrame:
    return states.where("sentinel_pattern IS NOT NULL")


def sentinel_hits(states: DataFrame, messages: DataFrame) -> DataFrame:
    """message_id, entity_id: messages that hold an entity's sentinel pattern.

    Sentinels are few beside messages; Spark broadcasts them by size.
    """
    return messages.join(with_sentinels(states), F.contains(F.lower("message"), F.lower("sentinel_pattern"))).select("message_id", "entity_id", "sentinel_pattern")


def masks(messages: DataFrame) -> DataFrame:
    """message_id, work, personal: the larger number of words wins strictly; without any word there is no row."""
    tokens = F.array_distinct(T.words(F.lower("message")))
    scored = messages.select("message_id", F.size(F.array_intersect(tokens, T.literal_array(L.WORK_WORDS))).alias("w"), F.size(F.array_intersect(tokens, T.literal_array(L.PERSONAL_WORDS))).alias("p"))
    return scored.where("w > 0 OR p > 0").select("message_id", (F.col("w") > F.col("p")).alias("work"), (F.col("p") > F.col("w")).alias("personal"))


def negated(message: Column, name: Column) -> Column:
    """Whether a message denies something of a name in the clause that names it."""
    clauses = F.split(F.lower(message), r"[,.;]|\bbut\b|\band\b")
    return F.exists(clauses, lambda c: F.contains(c, F.lower(name)) & F.rlike(c, F.lit(r"\b(?:not|never|isn't|isnt|doesn't|doesnt|wasn't|wasnt|no longer|don't|dont)\b")))


def new_sentinels(states: DataFrame, denials: DataFrame) -> DataFrame:
    """States with a pattern for entities that a message denies (entity_id, pattern, seq), unless they have one."""
    first = denials.groupBy("entity_id").agg(F.min_by("pattern", "seq").alias("_pattern"))
    return states.join(first, "entity_id", "left").withColumn("sentinel_pattern", F.coalesce("sentinel_pattern", "_pattern")).drop("_pattern")
