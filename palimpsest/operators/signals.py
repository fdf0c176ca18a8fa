"""Signals: what a turn tells about its user, as events; at most one per signal and turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest import lexicon as L
from palimpsest.functions import text as T
from palimpsest.functions import vector as V
from palimpsest.operators import memory as M

CERTAIN = 0.7
TOPIC_SHIFT = 0.3
CRYSTAL_OBSERVATIONS, CRYSTAL_SESSIONS = 3, 2
TOPIC_TURNS = 3
CLUSTER_MEMORIES = 15
RAW_LENGTH = 20


def _by_intent(intents: dict[str, str]) -> Column:
    """Triggers of a learned classifier (columns intent, intent_confidence), if it is certain."""
    sure = F.col("intent_confidence") > CERTAIN
    return F.coalesce(*[F.when((F.col("intent") == k) & sure, F.lit(v)) for k, v in intents.items()])


def _prepared(turns: DataFrame) -> DataFrame:
    for name, kind in (("feedback", "string"), ("intent", "string"), ("intent_confidence", "double")):
        if name not in turns.columns:
            turns = turns.withColumn(name, F.lit(None).cast(kind))
    return turns.withColumn("_low", F.lower(F.coalesce("message", F.lit("")))).withColumn("_feedback", F.lower(F.coalesce("feedback", F.lit(""))))


def dopamine(turns: DataFrame) -> DataFrame:
    """``dopamine``: feedback first, then the classifier, then corrections, enthusiasm, personal facts."""
    low, feedback = F.col("_low"), F.col("_feedback")
    trigger = F.coalesce(
        F.when(feedback == "positive", "explicit_positive_feedback"),
        F.when(feedback.startswith("correction:"), "user_correction"),
        _by_intent({"correction": "user_correction", "enthusiasm": "user_enthusiasm", "personal_info": "novel_personal_info"}),
        F.when(T.contains_any(low, L.CORRECTION), "user_correction"),
        F.when(T.contains_any(low, L.ENTHUSIASM), "user_enthusiasm"),
        F.when(T.contains_any(low, L.PERSONAL_INFO), "novel_personal_info"),
    )
    pattern = F.coalesce(T.first_phrase(low, L.CORRECTION), T.first_phrase(low, L.ENTHUSIASM), T.first_phrase(low, L.PERSONAL_INFO))
    return _prepared(turns).withColumn("dopamine", trigger).withColumn("dopamine_pattern", pattern).drop("_low", "_feedback")


def gaba(turns: DataFrame) -> DataFrame:
    """``gaba``: negative feedback, the classifier, denials."""
    trigger = F.coalesce(F.when(F.col("_feedback") == "negative", "explicit_negative_feedback"), _by_intent({"denial": "user_denial"}), F.when(T.contains_any(F.col("_low"), L.DENIAL), "user_denial"))
    return _prepared(turns).withColumn("gaba", trigger).drop("_low", "_feedback")


def norepinephrine(turns: DataFrame) -> DataFrame:
    """``norepinephrine``: the classifier, frustration, contradictions."""
    trigger = F.coalesce(_by_intent({"frustration": "user_frustration", "contradiction": "potential_contradiction"}), F.when(T.contains_any(F.col("_low"), L.FRUSTRATION), "user_frustration"), F.when(T.contains_any(F.col("_low"), L.CONTRADICTION), "potential_contradiction"))
    return _prepared(turns).withColumn("norepinephrine", trigger).drop("_low", "_feedback")


def observed(turns: DataFrame) -> DataFrame:
    """The three signals of a turn, in the order in which they are looked for."""
    return norepinephrine(gaba(dopamine(turns)))


def denied(turns: DataFrame, retrieved: DataFrame) -> DataFrame:
    """turn_id, affected: of a denial, the retrieved memories (turn_id, id, is_priority) that are no priority."""
    events = gaba(turns).where("gaba = 'user_denial'").select("turn_id")
    return events.join(retrieved.where("NOT is_priority"), "turn_id", "left").groupBy("turn_id").agg(F.array_sort(F.collect_list("id")).alias("affected"))


# attention


def topic_shifts(turns: DataFrame, threshold: float = TOPIC_SHIFT) -> DataFrame:
    """similarity to the turn before in the session, and whether the topic shifted; a session's first turn never does."""
    before = F.lag("embedding").over(Window.partitionBy("session_id").orderBy("turn"))
    rows = turns.withColumn("_before", before)
    return rows.withColumn("similarity", F.when(F.col("_before").isNotNull(), F.round(V.cosine(F.col("embedding"), F.col("_before")), 6))).withColumn("topic_shift", F.coalesce(F.col("similarity") < threshold, F.lit(False))).drop("_before")


def retrieval_config(turns: DataFrame) -> DataFrame:
    """top_k, relevance_threshold and caution of each turn: what the turn before reported, then a topic shift, widen it.

    ``turns``: session_id, turn, norepinephrine (a trigger or null), topic_shift.
    """
    pending = F.lag("norepinephrine").over(Window.partitionBy("session_id").orderBy("turn"))
    times = F.col("_pending").isNotNull().cast("int") + F.col("topic_shift").cast("int")
    caution = F.when(F.col("topic_shift"), L.CAUTIONS["topic_shift"]).when(F.col("_pending") == "user_frustration", L.CAUTIONS["user_frustration"]).when(F.col("_pending") == "potential_contradiction", L.CAUTIONS["potential_contradiction"])
    return turns.withColumn("_pending", pending).withColumns({"top_k": M.widened(F.lit(M.TOP_K), times), "relevance_threshold": M.lowered(F.lit(M.THRESHOLD), times), "caution": caution}).drop("_pending")


# habits


def patterns(turns: DataFrame) -> DataFrame:
    """The turns' columns, category and pattern_key: one row for each habit that a message shows."""
    low, n = F.lower("message"), F.size(T.words(F.col("message")))

    def seen(condition: Column, category: str, key: str) -> Column:
        return F.when(condition, F.struct(F.lit(category).alias("category"), F.lit(key).alias("pattern_key")))

    found = F.array_compact(
        F.array(
            seen(n < 10, "style", "prefers_concise"),
            seen(n > 50, "style", "prefers_detailed"),
            seen(T.has_token(low, L.CASUAL), "style", "casual_tone"),
            seen(T.contains_any(low, L.FORMAL), "style", "formal_tone"),
            seen(T.contains_any(low, L.CODE), "preference", "wants_code_examples"),
            seen(T.contains_any(low, L.FOLLOW_UP), "interaction", "asks_followups"),
            seen(T.contains_any(low, L.SIMPLIFY), "preference", "wants_simplicity"),
            seen(T.contains_any(low, L.DETAIL), "preference", "prefers_detailed"),
        )
    )
    return turns.where("message IS NOT NULL").select(*turns.columns, F.posexplode(found).alias("pattern_pos", "_p")).select(*turns.columns, "pattern_pos", "_p.category", "_p.pattern_key")


def observation_counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy("pattern_key").agg(F.count("*").alias("observation_count"), F.countDistinct("session_id").alias("session_count"))


def crystallised(observations: DataFrame, rules: DataFrame | None = None, least: int = CRYSTAL_OBSERVATIONS, sessions: int = CRYSTAL_SESSIONS) -> DataFrame:
    """pattern_key, seq, observation_count: the observation at which a habit becomes a rule.

    A rule exists from then on, so later observations don't count.  The n-th
    observation and the first one of the second session decide: whichever is later.
    Both come from counts, no window holds a key's observations.
    """
    if rules is not None:
        observations = observations.join(rules.select("pattern_key"), "pattern_key", "left_anti")
    by_session = observations.groupBy("pattern_key", "session_id").agg(F.min("seq").alias("first"))
    nth = F.row_number().over(Window.partitionBy("pattern_key").orderBy("first"))
    second = by_session.withColumn("n", nth).where(F.col("n") == sessions).select("pattern_key", F.col("first").alias("second_first"))
    place = F.row_number().over(Window.partitionBy("pattern_key").orderBy("seq"))
    # rows at the threshold, and the one that opens the needed session
    placed = observations.withColumn("observation_count", place).join(second, "pattern_key")
    return placed.where((F.col("observation_count") >= least) & (F.col("seq") >= F.col("second_first"))).groupBy("pattern_key").agg(F.min("seq").alias("seq"), F.min("observation_count").alias("observation_count"))


def rule_text(key: Column) -> Column:
    return F.coalesce(F.element_at(T.literal_map(L.RULE_TEMPLATES), key), F.concat(F.lit("Observed recurring pattern: "), key))


def with_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules (pattern_key, rule_text, observation_count, is_active, seq) with new ones; of a key the last one stays."""
    every = rules.unionByName(new.select(*rules.columns))
    return every.withColumn("_n", F.row_number().over(Window.partitionBy("pattern_key").orderBy(F.desc("seq")))).where("_n = 1").drop("_n")


def switched(rules: DataFrame, keys: DataFrame, active: bool) -> DataFrame:
    marked = rules.join(keys.select("pattern_key").distinct().withColumn("_hit", F.lit(True)), "pattern_key", "left")
    return marked.withColumn("is_active", F.when(F.col("_hit"), F.lit(active)).otherwise(F.col("is_active"))).select(*rules.columns)


# topics and clusters


def with_topic(turns: DataFrame, message: str = "message") -> DataFrame:
    """``topic``: the most frequent pair of significant words, the first on ties; a single word if there is no pair; null without any.

    The words and the sorted pairs are columns of their own on the way, so each is
    made once; equal pairs are then neighbours and one fold finds the longest run.
    """
    w = F.col("_w")
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(w)
    nothing = F.struct(F.lit("").alias("seen"), F.lit(0).alias("run"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("best"))

    def count(a: Column, e: Column) -> Column:
        same = a["seen"] == e["p"]
        run, start = F.when(same, a["run"] + 1).otherwise(1), F.when(same, a["start"]).otherwise(e["i"])
        better = (run > a["n"]) | ((run == a["n"]) & (start < a["place"]))
        return F.struct(e["p"].alias("seen"), run.alias("run"), start.alias("start"), F.when(better, run).otherwise(a["n"]).alias("n"), F.when(better, start).otherwise(a["place"]).alias("place"), F.when(better, e["p"]).otherwise(a["best"]).alias("best"))

    rows = turns.withColumn("_w", T.significant_words(F.col(message)))
    rows = rows.withColumn("_p", F.array_sort(F.transform(pairs, lambda p, i: F.struct(p.alias("p"), i.alias("i")))))
    return rows.withColumn("topic", F.when(F.size("_p") > 0, F.aggregate("_p", nothing, count)["best"])).drop("_w", "_p")


def sustained(turns: DataFrame) -> DataFrame:
    """``is_sustained``: this turn and the two before it in the session all have a topic, the same one or with a word in common."""
    last = F.collect_list(F.struct(F.col("topic"))).over(Window.partitionBy("session_id").orderBy("turn").rowsBetween(-(TOPIC_TURNS - 1), 0))
    words = F.transform("_last", lambda t: F.split(t["topic"], " "))
    common = F.array_intersect(F.array_intersect(F.get(words, F.lit(0)), F.get(words, F.lit(1))), F.get(words, F.lit(2)))
    whole = (F.size("_last") == TOPIC_TURNS) & ~F.exists("_last", lambda t: t["topic"].isNull())
    return turns.withColumn("_last", last).withColumn("is_sustained", F.coalesce(whole & (F.size(common) > 0), F.lit(False))).drop("_last")


def focus(turns: DataFrame) -> DataFrame:
    """Turns that open or feed a cluster: a sustained topic, or a wish for depth."""
    rows = sustained(with_topic(turns))
    rows = rows.withColumn("is_depth_request", F.coalesce(T.contains_any(F.lower("message"), L.DEPTH), F.lit(False)))
    return rows.where("topic IS NOT NULL AND (is_sustained OR is_depth_request)")


def matched_clusters(topics: DataFrame, clusters: DataFrame) -> DataFrame:
    """topic, cluster_id, overlap: the cluster for a topic.

    The same topic wins, then the first cluster of which one text holds the other,
    then the one with the most words in common, at least half of the shorter.
    Clusters are found by the words they share with a topic or hold it in letters;
    the table of clusters is the small side.
    """
    t, c = F.lower("topic"), F.lower("cluster_topic")
    tw, cw = (F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: F.length(w) > 2)) for x in (t, c))
    common = F.size(F.array_intersect(tw, cw))
    ratio = common / F.least(F.size(tw), F.size(cw))
    pairs = topics.select("topic").distinct().join(clusters.select(F.col("id").alias("cluster_id"), F.col("topic").alias("cluster_topic"), "seq"), F.contains(t, c) | F.contains(c, t) | ((common >= 1) & (ratio >= 0.5)))
    score = F.when(t == c, 3.0).when(F.contains(t, c) | F.contains(c, t), 2.0).otherwise(ratio)
    best = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("overlap"), "seq"))
    return pairs.withColumn("overlap", F.round(score, 6)).withColumn("_n", best).where("_n = 1").select("topic", "cluster_id", "overlap")


def cluster_members(adds: DataFrame, most: int = CLUSTER_MEMORIES) -> DataFrame:
    """cluster_id, memory_ids: the newest distinct members, oldest first; adding a member again changes nothing."""
    first = adds.groupBy("cluster_id", "memory_id").agg(F.min("seq").alias("seq"))
    newest = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("seq")))
    kept = first.withColumn("_n", newest).where(F.col("_n") <= most)
    return kept.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "memory_id"))), lambda s: s["memory_id"]).alias("memory_ids"))


def cluster_memories(clusters: DataFrame, memories: DataFrame) -> DataFrame:
    """cluster_id, pos, id, content of the members that are not suppressed."""
    rows = clusters.select("cluster_id", F.posexplode("memory_ids").alias("pos", "id"))
    return rows.join(memories.where("NOT is_suppressed"), "id").select("cluster_id", "pos", "id", "content")


def cluster_memory_rows(focused: DataFrame) -> DataFrame:
    """The memory that a focused turn leaves: content, tier, confidence and source."""
    return focused.select("session_id", "turn", F.concat(F.lit("["), F.col("topic"), F.lit("] User asked: "), F.substring("message", 1, 200)).alias("content"), F.lit("mid").alias("tier"), F.lit(0.8).alias("confidence"), F.lit("acetylcholine").alias("source"))


def touched_clusters(clusters: DataFrame, hits: DataFrame) -> DataFrame:
    """access_count + 1 and a new last_accessed (seq of the hit) for clusters that a retrieval used."""
    last = hits.groupBy("id").agg(F.max("at").alias("_at"), F.count("*").cast("int").alias("_n"))
    return clusters.join(last, "id", "left").withColumns({"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed": F.coalesce("_at", "last_accessed")}).select(*clusters.columns)


# what is left


def raw_memories(turns: DataFrame) -> DataFrame:
    """Messages without any signal and longer than twenty letters, as short memories."""
    quiet = observed(turns).where("dopamine IS NULL AND gaba IS NULL AND norepinephrine IS NULL").where(F.length("message") > RAW_LENGTH)
    return quiet.select("session_id", "turn", F.concat(F.lit("User said: "), F.col("message")).alias("content"), F.lit("short").alias("tier"), F.lit(0.8).alias("confidence"))


def learning_pairs(turns: DataFrame) -> DataFrame:
    """message, intent: corrections and denials as examples for a classifier."""
    rows = observed(turns)
    return rows.where("dopamine = 'user_correction'").select("session_id", "turn", "message", F.lit("correction").alias("intent")).unionByName(rows.where("gaba = 'user_denial'").select("session_id", "turn", "message", F.lit("denial").alias("intent")))


def retrain_points(corrections: DataFrame, batch: int = 3) -> DataFrame:
    """Every ``batch``-th correction of a user, at which a model is trained again."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("seq"))
    return corrections.withColumn("n", n).where(F.col("n") % batch == 0)


def recent_lines(turns: DataFrame, turns_back: int = 6, letters: int = 100) -> DataFrame:
    """session_id, recent: the last messages (turn, role, text) of each session, cut, as a model is shown them."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    rows = turns.withColumn("_n", back).where(F.col("_n") <= turns_back)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring(F.coalesce("text", F.lit("")), 1, letters))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("at"), line.alias("line")))), lambda x: x["line"]), "\n").alias("recent"))


def first_observations(observations: DataFrame, most: int = 5) -> DataFrame:
    """pattern_key, shown: the first observations (observation, seq) of each pattern, as a model is shown them."""
    place = F.row_number().over(Window.partitionBy("pattern_key").orderBy("seq"))
    rows = observations.withColumn("_n", place).where(F.col("_n") <= most)
    return rows.groupBy("pattern_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat(F.lit("- "), "observation").alias("line")))), lambda x: x["line"]), "\n").alias("shown"))


def correction_pairs(messages: DataFrame) -> DataFrame:
    """text_id, sentence, subject_name, predicate, object_name, is_positive: the first relation between named ones that a correction (text_id, text) tells."""
    from palimpsest.operators import extraction as X

    rows = X.extracted(messages).where(F.col("subject") != X.USER)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("text_id").orderBy("pos"))).where("_n = 1")
    return first.join(messages.select("text_id", F.col("text").alias("sentence")), "text_id").select("text_id", "sentence", F.col("subject").alias("subject_name"), "predicate", F.col("object").alias("object_name"), F.lit(True).alias("is_positive"))
