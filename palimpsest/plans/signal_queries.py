"""Queries on turns: signals, habits, topics, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import lexicon as L
from palimpsest.operators import signals as S
from palimpsest.plans.registry import query
from palimpsest.sources import adapters as A

Spark, DF = SparkSession, DataFrame

#: Turns that say what signals look for.
PHRASES = [
    (1, 1, "No, I moved last year", None),
    (1, 2, "Exactly, that's it", None),
    (1, 3, "My name is Ann and I work at the mill", None),
    (1, 4, "I never said that, you're making that up", None),
    (1, 5, "I already told you twice", None),
    (2, 1, "Tell me more about rust ownership rules please", None),
    (2, 2, "Could you explain rust borrowing with an example of code", None),
    (2, 3, "yeah rust lifetimes are kinda odd tbh", None),
    (2, 4, "keep it simple, in plain words", "negative"),
    (2, 5, "thanks", "positive"),
    (3, 1, "I don't like that, wrong, actually it's blue", "correction: it is blue"),
    (3, 2, "Why? elaborate, more detail", None),
    (3, 3, "", None),
    (3, 4, "The weather in the valley is fine and the road is dry today", None),
    (3, 5, "no no no listen, pay attention", None),
]
_quoted = [(s, t, m.replace("'", "''"), f) for s, t, m, f in PHRASES]
PHRASES_SQL = "phrases AS (SELECT session_id::BIGINT AS session_id, turn::BIGINT AS turn, message, feedback FROM (VALUES " + ", ".join("({}, {}, '{}', {})".format(s, t, m, "NULL" if f is None else f"'{f}'") for s, t, m, f in _quoted) + ") AS t(session_id, turn, message, feedback))"


def phrases(spark: Spark) -> DF:
    return spark.createDataFrame(PHRASES, "session_id long, turn long, message string, feedback string")


def has(words: list[str], text: str = "lower(message)") -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


DOPAMINE = f"CASE WHEN lower(coalesce(feedback, '')) = 'positive' THEN 'explicit_positive_feedback' WHEN starts_with(lower(coalesce(feedback, '')), 'correction:') THEN 'user_correction' WHEN {has(L.CORRECTION)} THEN 'user_correction' WHEN {has(L.ENTHUSIASM)} THEN 'user_enthusiasm' WHEN {has(L.PERSONAL_INFO)} THEN 'novel_personal_info' END"
GABA = f"CASE WHEN lower(coalesce(feedback, '')) = 'negative' THEN 'explicit_negative_feedback' WHEN {has(L.DENIAL)} THEN 'user_denial' END"
NOREPINEPHRINE = f"CASE WHEN {has(L.FRUSTRATION)} THEN 'user_frustration' WHEN {has(L.CONTRADICTION)} THEN 'potential_contradiction' END"


#: The phrases and all user turns, which have no feedback.
EVERY_SQL = f"{PHRASES_SQL}, {A.TURNS}, every AS (SELECT * FROM phrases UNION ALL SELECT session_id, turn, message, NULL FROM turns), observed AS (SELECT *, {DOPAMINE} AS dopamine, {GABA} AS gaba, {NOREPINEPHRINE} AS norepinephrine FROM every)"


def every_turn(spark: Spark, sf: str) -> DF:
    return phrases(spark).unionByName(A.turns(spark, sf).withColumn("feedback", F.lit(None).cast("string")))


@query(f"WITH {EVERY_SQL} SELECT session_id, turn, dopamine FROM observed", "sig_1_dopamine")
def sig_1_all(spark: Spark, sf: str) -> DF:
    return S.dopamine(every_turn(spark, sf)).select("session_id", "turn", "dopamine")


@query(f"WITH {EVERY_SQL} SELECT session_id, turn, gaba, CASE WHEN gaba = 'user_denial' THEN 1 ELSE 0 END AS affected FROM observed", "sig_2_gaba")
def sig_2(spark: Spark, sf: str) -> DF:
    turns = phrases(spark).withColumn("turn_id", -(F.col("session_id") * 1000 + F.col("turn"))).unionByName(A.turns(spark, sf).withColumns({"feedback": F.lit(None).cast("string"), "turn_id": F.col("session_id") * 1000 + F.col("turn")}))
    found = turns.select("turn_id", F.explode(F.array(F.struct(F.lit(1).alias("id"), F.lit(False).alias("is_priority")), F.struct(F.lit(2).alias("id"), F.lit(True).alias("is_priority")))).alias("m")).select("turn_id", "m.*")
    events = S.gaba(turns)
    return events.join(S.denied(turns, found), "turn_id", "left").select("session_id", "turn", "gaba", F.coalesce(F.size("affected"), F.lit(0)).alias("affected"))


@query(f"WITH {EVERY_SQL} SELECT session_id, turn, norepinephrine FROM observed", "sig_3_norepinephrine")
def sig_3_all(spark: Spark, sf: str) -> DF:
    return S.norepinephrine(every_turn(spark, sf)).select("session_id", "turn", "norepinephrine")


_SHIFT = f"vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), {A.TURNS}, t AS (SELECT session_id, turn, v FROM turns JOIN vecs ON vecs.id = (session_id * 7 + turn) % {A.VECTORS}), s AS (SELECT *, lag(v) OVER (PARTITION BY session_id ORDER BY turn) AS b FROM t), shifts AS (SELECT session_id, turn, CASE WHEN b IS NOT NULL THEN round(list_cosine_similarity(v, b), 6) END AS similarity, coalesce(round(list_cosine_similarity(v, b), 6) < 0.3, false) AS topic_shift FROM s)"


def embedded_turns(spark: Spark, sf: str) -> DF:
    v = A.vectors(spark, sf).select(F.col("id").alias("_v"), "embedding")
    return A.turns(spark, sf).withColumn("_v", F.expr(f"try_mod(session_id * 7 + turn, {A.vector_count(spark, sf)})")).join(v, "_v").drop("_v")


@query(f"WITH {_SHIFT} SELECT session_id, turn, similarity, topic_shift FROM shifts", "win_1_topic_shift")
def win_1(spark: Spark, sf: str) -> DF:
    return S.topic_shifts(embedded_turns(spark, sf)).select("session_id", "turn", "similarity", "topic_shift")


_PENDING = "CASE WHEN turn % 3 = 0 THEN 'user_frustration' WHEN turn % 5 = 2 THEN 'potential_contradiction' END"


@query(
    f"WITH {_SHIFT}, p AS (SELECT session_id, turn, topic_shift, lag({_PENDING}) OVER (PARTITION BY session_id ORDER BY turn) AS pending FROM shifts), n AS (SELECT *, (pending IS NOT NULL)::INT + topic_shift::INT AS n FROM p) "
    f"SELECT session_id, turn, least(30, 10 * 2 ** n)::INT AS top_k, 0.15::DOUBLE * 0.5 ** n AS relevance_threshold, CASE WHEN topic_shift THEN '{L.CAUTIONS['topic_shift']}' WHEN pending = 'user_frustration' THEN '{L.CAUTIONS['user_frustration']}' WHEN pending = 'potential_contradiction' THEN '{L.CAUTIONS['potential_contradiction']}' END AS caution FROM n",
    "sig_4_5_6_retrieval_config",
)
def sig_5(spark: Spark, sf: str) -> DF:
    rows = S.topic_shifts(embedded_turns(spark, sf)).withColumn("norepinephrine", F.expr(_PENDING))
    return S.retrieval_config(rows).select("session_id", "turn", "top_k", "relevance_threshold", "caution")


def _patterns_sql(source: str) -> str:
    n = r"len(list_filter(regexp_split_to_array(message, '\s+'), lambda w: w <> ''))"
    casual = "len(list_intersect(list_filter(regexp_split_to_array(lower(message), '\\s+'), lambda w: w <> ''), [" + ", ".join(f"'{w}'" for w in L.CASUAL) + "])) > 0"
    rules = [(f"{n} < 10", "style", "prefers_concise"), (f"{n} > 50", "style", "prefers_detailed"), (casual, "style", "casual_tone"), (has(L.FORMAL), "style", "formal_tone"), (has(L.CODE), "preference", "wants_code_examples"), (has(L.FOLLOW_UP), "interaction", "asks_followups"), (has(L.SIMPLIFY), "preference", "wants_simplicity"), (has(L.DETAIL), "preference", "prefers_detailed")]
    return " UNION ALL ".join(f"SELECT session_id, turn, '{c}' AS category, '{k}' AS pattern_key FROM {source} WHERE {r}" for r, c, k in rules)


@query(f"WITH {PHRASES_SQL}, {A.TURNS}, every AS (SELECT session_id, turn, message FROM phrases UNION ALL SELECT session_id, turn, message FROM turns) {_patterns_sql('every')}", "sig_7_patterns")
def sig_7(spark: Spark, sf: str) -> DF:
    every = phrases(spark).drop("feedback").unionByName(A.turns(spark, sf))
    return S.patterns(every).select("session_id", "turn", "category", "pattern_key")


@query(f"WITH {A.OBSERVATIONS} SELECT pattern_key, count(*) AS observation_count, count(DISTINCT session_id) AS session_count FROM observations GROUP BY pattern_key", "agg_3_4_observation_counts")
def agg_3(spark: Spark, sf: str) -> DF:
    return S.observation_counts(A.observations(spark, sf))


_CRYSTAL = f"{A.OBSERVATIONS}, firsts AS (SELECT pattern_key, session_id, min(seq) AS first FROM observations GROUP BY ALL), second AS (SELECT pattern_key, first FROM firsts QUALIFY row_number() OVER (PARTITION BY pattern_key ORDER BY first) = 2), numbered AS (SELECT *, row_number() OVER (PARTITION BY pattern_key ORDER BY seq) AS n FROM observations), crystals AS (SELECT o.pattern_key, min(o.seq) AS seq, min(n)::INT AS observation_count FROM numbered o JOIN second s USING (pattern_key) WHERE n >= 3 AND o.seq >= s.first GROUP BY o.pattern_key)"


@query(f"WITH {_CRYSTAL} SELECT pattern_key, seq, observation_count FROM crystals", "win_2_agg_5_crystallised")
def win_2(spark: Spark, sf: str) -> DF:
    return S.crystallised(A.observations(spark, sf))


@query(f"WITH {_CRYSTAL} SELECT pattern_key, 'Observed recurring pattern: ' || pattern_key AS rule_text, observation_count FROM crystals WHERE pattern_key NOT LIKE 'view%'", "sig_8_rules")
def sig_8(spark: Spark, sf: str) -> DF:
    rules = A.observations(spark, sf).where("pattern_key LIKE 'view%'").select("pattern_key").distinct()
    return S.crystallised(A.observations(spark, sf), rules).select("pattern_key", S.rule_text(F.col("pattern_key")).alias("rule_text"), "observation_count")


def rules(spark: Spark, sf: str) -> DF:
    rows = S.crystallised(A.observations(spark, sf))
    return rows.select("pattern_key", S.rule_text(F.col("pattern_key")).alias("rule_text"), "observation_count", (F.col("seq") % 2 == 0).alias("is_active"), "seq")


_RULES = f"{_CRYSTAL}, rules AS (SELECT pattern_key, 'Observed recurring pattern: ' || pattern_key AS rule_text, observation_count, seq % 2 = 0 AS is_active, seq FROM crystals)"


@query(f"WITH {_RULES} SELECT pattern_key, rule_text FROM rules WHERE is_active", "fil_9_active_rules")
def fil_9(spark: Spark, sf: str) -> DF:
    return rules(spark, sf).where("is_active").select("pattern_key", "rule_text")


@query(f"WITH {_RULES} SELECT pattern_key, count(*) AS n FROM observations WHERE pattern_key IN (SELECT pattern_key FROM rules) GROUP BY pattern_key", "fil_24_rule_exists")
def fil_24(spark: Spark, sf: str) -> DF:
    return A.observations(spark, sf).join(rules(spark, sf).select("pattern_key"), "pattern_key", "left_semi").groupBy("pattern_key").agg(F.count("*").alias("n"))


@query(f"WITH {_RULES}, new AS (SELECT pattern_key, 'again' AS rule_text, 9::INT AS observation_count, true AS is_active, seq + 1000000 AS seq FROM rules WHERE pattern_key LIKE 'click%') SELECT pattern_key, rule_text, observation_count FROM (SELECT * FROM rules UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY pattern_key ORDER BY seq DESC) = 1", "dml_13_rule_upsert")
def dml_13(spark: Spark, sf: str) -> DF:
    now = rules(spark, sf)
    new = now.where("pattern_key LIKE 'click%'").select("pattern_key", F.lit("again").alias("rule_text"), F.lit(9).alias("observation_count"), F.lit(True).alias("is_active"), (F.col("seq") + 1000000).alias("seq"))
    return S.with_rules(now, new).select("pattern_key", "rule_text", "observation_count")


@query(f"WITH {_RULES} SELECT pattern_key, is_active AND pattern_key NOT LIKE 'view%' AS is_active FROM rules", "dml_13_rule_switch")
def dml_13b(spark: Spark, sf: str) -> DF:
    now = rules(spark, sf)
    return S.switched(now, now.where("pattern_key LIKE 'view%'"), False).select("pattern_key", "is_active")


@query(f"WITH {A.OBSERVATIONS} SELECT pattern_key, session_id, seq FROM observations WHERE pattern_key = 'click_3' ORDER BY seq DESC LIMIT 20", "top_11_observations")
def top_11(spark: Spark, sf: str) -> DF:
    return A.observations(spark, sf).where("pattern_key = 'click_3'").orderBy(F.desc("seq")).limit(20)


_STOP = "[" + ", ".join(f"'{w}'" for w in L.STOPWORDS) + "]"
_STRIP = r"""regexp_replace(w, '^[.,!?;:''"()\[\]{}]+|[.,!?;:''"()\[\]{}]+$', '', 'g')"""
_TOPIC = (
    rf"sig AS (SELECT session_id, turn, message, list_filter(list_transform(list_filter(regexp_split_to_array(lower(message), '\s+'), lambda w: length(w) > 2), lambda w: {_STRIP}), lambda w: w <> '' AND NOT list_contains({_STOP}, w)) AS s FROM every), "
    "pairs AS (SELECT *, CASE WHEN len(s) > 1 THEN list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1]) ELSE s END AS p FROM sig), "
    "counted AS (SELECT session_id, turn, w, count(*) AS n, min(i) AS place FROM (SELECT session_id, turn, unnest(p) AS w, unnest(range(1, len(p) + 1)) AS i FROM pairs) GROUP BY ALL), "
    "best AS (SELECT session_id, turn, w AS topic FROM counted QUALIFY row_number() OVER (PARTITION BY session_id, turn ORDER BY n DESC, place) = 1), "
    "topics AS (SELECT e.session_id, e.turn, e.message, topic FROM every e LEFT JOIN best b USING (session_id, turn))"
)
_EVERY = f"{PHRASES_SQL}, {A.TURNS}, every AS (SELECT session_id - 10 AS session_id, turn, message FROM phrases UNION ALL SELECT session_id, turn, message FROM turns)"


def every(spark: Spark, sf: str) -> DF:
    return phrases(spark).select((F.col("session_id") - 10).alias("session_id"), "turn", "message").unionByName(A.turns(spark, sf))


@query(f"WITH {_EVERY}, {_TOPIC} SELECT session_id, turn, topic FROM topics", "sig_9_agg_7_topic")
def sig_9(spark: Spark, sf: str) -> DF:
    return S.with_topic(every(spark, sf)).select("session_id", "turn", "topic")


_SUSTAINED = (
    "lasts AS (SELECT *, lag(topic) OVER w AS t1, lag(topic, 2) OVER w AS t2 FROM topics WINDOW w AS (PARTITION BY session_id ORDER BY turn)), "
    "sustained AS (SELECT session_id, turn, message, topic, coalesce(topic IS NOT NULL AND t1 IS NOT NULL AND t2 IS NOT NULL AND len(list_intersect(list_intersect(string_split(topic, ' '), string_split(t1, ' ')), string_split(t2, ' '))) > 0, false) AS is_sustained FROM lasts)"
)


@query(f"WITH {_EVERY}, {_TOPIC}, {_SUSTAINED} SELECT session_id, turn, is_sustained FROM sustained", "win_3_sustained_topic")
def win_3(spark: Spark, sf: str) -> DF:
    rows = S.with_topic(every(spark, sf))
    return S.sustained(rows).select("session_id", "turn", "is_sustained")


@query(f"WITH {_EVERY}, {_TOPIC}, {_SUSTAINED} SELECT session_id, turn, '[' || topic || '] User asked: ' || left(message, 200) AS content, 'mid' AS tier, 0.8::DOUBLE AS confidence, 'acetylcholine' AS source FROM sustained WHERE topic IS NOT NULL AND (is_sustained OR {has(L.DEPTH)})", "sig_10_focus_memories")
def sig_10(spark: Spark, sf: str) -> DF:
    return S.cluster_memory_rows(S.focus(every(spark, sf)))


TOPICS = ["rust ownership", "rust", "garden tools", "tools", "red wine tasting", "nothing here"]
CLUSTERS = [(1, "rust borrowing", 1), (2, "Rust", 2), (3, "wine tasting", 3), (4, "garden", 4), (5, "power tools", 5)]
_TC = "topics AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in TOPICS) + "]) AS topic UNION SELECT lower(p_name) FROM part), clusters AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', {s})" for i, t, s in CLUSTERS) + ") AS t(id, topic, seq))"


@query(
    f"WITH {_TC}, p AS (SELECT t.topic, c.id::INT AS cluster_id, c.seq, lower(t.topic) AS a, lower(c.topic) AS b, list_distinct(list_filter(string_split(lower(t.topic), ' '), lambda w: length(w) > 2)) AS x, list_distinct(list_filter(string_split(lower(c.topic), ' '), lambda w: length(w) > 2)) AS y FROM topics t, clusters c), "
    "s AS (SELECT topic, cluster_id, seq, CASE WHEN a = b THEN 3.0::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN 2.0::DOUBLE ELSE round(len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE, 6) END AS overlap FROM p) "
    "SELECT topic, cluster_id, overlap FROM s WHERE overlap >= 0.5 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY overlap DESC, seq) = 1",
    "top_9_sig_11_cluster_match",
)
def top_9(spark: Spark, sf: str) -> DF:
    return S.matched_clusters(spark.createDataFrame([(t,) for t in TOPICS], "topic string").unionByName(A.table(spark, sf, "part").select(F.lower("p_name").alias("topic"))).distinct(), spark.createDataFrame(CLUSTERS, "id int, topic string, seq int"))


_ADDS = "adds AS (SELECT user_id % 40 AS cluster_id, user_id * 3 + event_id % 5 AS memory_id, event_id AS seq FROM events), newest AS (SELECT cluster_id, memory_id, min(seq) AS seq FROM adds GROUP BY cluster_id, memory_id QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY min(seq) DESC) <= 15)"


def adds(spark: Spark, sf: str) -> DF:
    return A.table(spark, sf, "events").select((F.col("user_id") % 40).alias("cluster_id"), (F.col("user_id") * 3 + F.col("event_id") % 5).alias("memory_id"), F.col("event_id").alias("seq"))


@query(f"WITH {_ADDS} SELECT cluster_id, string_agg(memory_id::VARCHAR, ',' ORDER BY seq) AS members FROM newest GROUP BY cluster_id", "win_4_cluster_members")
def win_4(spark: Spark, sf: str) -> DF:
    return S.cluster_members(adds(spark, sf)).select("cluster_id", F.array_join(F.transform("memory_ids", lambda x: x.cast("string")), ",").alias("members"))


@query(f"WITH {_ADDS}, {A.MEMORIES} SELECT cluster_id, m.id, m.tier FROM newest JOIN memories m ON m.id = memory_id WHERE NOT m.is_suppressed", "jn_19_cluster_memories")
def jn_19(spark: Spark, sf: str) -> DF:
    rows = S.cluster_memories(S.cluster_members(adds(spark, sf)), A.memories(spark, sf))
    return rows.join(A.memories(spark, sf).select("id", "tier"), "id").select("cluster_id", "id", "tier")


@query(f"WITH {_ADDS}, c AS (SELECT cluster_id AS id, count(*)::INT AS access_count, max(seq) AS last_accessed FROM adds GROUP BY ALL), hits AS (SELECT user_id % 40 AS id, count(*)::INT AS n, max(event_id) AS last_hit FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT c.id, (access_count + coalesce(n, 0))::INT AS access_count, coalesce(last_hit, last_accessed) AS last_accessed FROM c LEFT JOIN hits USING (id) ORDER BY last_accessed DESC", "dml_14_top_5_touched_clusters")
def dml_14(spark: Spark, sf: str) -> DF:
    c = adds(spark, sf).groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").cast("int").alias("access_count"), F.max("seq").alias("last_accessed"))
    hits = A.table(spark, sf, "events").where("event_type = 'purchase'").select((F.col("user_id") % 40).alias("id"), F.col("event_id").alias("at"))
    return S.touched_clusters(c, hits).orderBy(F.desc("last_accessed"))


@query(f"WITH {EVERY_SQL} SELECT session_id, turn, 'User said: ' || message AS content, 'short' AS tier, 0.8::DOUBLE AS confidence FROM observed WHERE dopamine IS NULL AND gaba IS NULL AND norepinephrine IS NULL AND length(message) > 20", "sig_13_raw_memories")
def sig_13(spark: Spark, sf: str) -> DF:
    return S.raw_memories(every_turn(spark, sf))


@query(f"WITH {EVERY_SQL} SELECT session_id, turn, message, 'correction' AS intent FROM observed WHERE dopamine = 'user_correction' UNION ALL SELECT session_id, turn, message, 'denial' FROM observed WHERE gaba = 'user_denial'", "sig_14_learning_pairs")
def sig_14(spark: Spark, sf: str) -> DF:
    return S.learning_pairs(every_turn(spark, sf))


@query("WITH c AS (SELECT user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS n FROM events WHERE event_type = 'error') SELECT user_id, seq, n FROM c WHERE n % 3 = 0", "win_8_retrain_points")
def win_8(spark: Spark, sf: str) -> DF:
    return S.retrain_points(A.table(spark, sf, "events").where("event_type = 'error'").select("user_id", F.col("event_id").alias("seq")))


@query(f"WITH {A.STATE_EVENTS} SELECT seq, entity_id, signal FROM state_events ORDER BY seq DESC LIMIT 50", "top_3_recent_signals")
def top_3(spark: Spark, sf: str) -> DF:
    return A.state_events(spark, sf).orderBy(F.desc("seq")).limit(50).select("seq", "entity_id", "signal")
