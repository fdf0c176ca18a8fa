"""Tables of the memory engine.

Every table carries ``user_id`` (isolation and partition key) and ``seq`` (order
of insertion): where the semantics say "first match", it is the least ``seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_COMMON = "user_id string, seq long"

DDL: dict[str, str] = {
    "memories": f"id string, content string, tier string, confidence double, created_at timestamp, session_count int, access_count int, is_priority boolean, is_suppressed boolean, suppression_reason string, source string, metadata map<string,string>, embedding array<float>, {_COMMON}",
    "signal_log": f"id string, signal_type string, trigger string, timestamp timestamp, details map<string,string>, memory_ids_affected array<string>, {_COMMON}",
    "conversations": f"id string, session_id string, messages array<struct<role:string,content:string>>, created_at timestamp, compressed boolean, {_COMMON}",
    "sessions": f"id string, started_at timestamp, ended_at timestamp, turns int, signals_fired int, {_COMMON}",
    "pattern_observations": f"id string, category string, pattern_key string, observation string, session_id string, created_at timestamp, {_COMMON}",
    "behavioral_rules": f"id string, pattern_key string, rule_text string, confidence double, observation_count long, created_at timestamp, is_active boolean, {_COMMON}",
    "knowledge_clusters": f"id string, topic string, description string, created_at timestamp, last_accessed timestamp, access_count int, memory_ids array<string>, {_COMMON}",
    "entities": f"id string, name string, entity_type string, properties map<string,string>, source_memory_id string, created_at timestamp, {_COMMON}",
    "relations": f"id string, subject_id string, predicate string, object_id string, confidence double, is_inferred boolean, source_memory_id string, created_at timestamp, {_COMMON}",
    "relation_corrections": f"id string, sentence string, subject_name string, predicate string, object_name string, is_positive boolean, created_at timestamp, {_COMMON}",
    "entity_state": f"entity_id string, resting_activation double, signal_history map<string,int>, receptor_density map<string,double>, expression_mask map<string,boolean>, total_activations long, last_activated_at timestamp, sentinel_pattern string, last_consolidated_at timestamp, updated_at timestamp, {_COMMON}",
}

TIERS = ("short", "mid", "long", "priority")
SIGNALS = ("dopamine", "gaba", "serotonin", "acetylcholine", "norepinephrine")
SUPPRESSION_REASONS = ("user_denied", "stale", "never_accessed", "contradicted", "confabulation", "manual")


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))
