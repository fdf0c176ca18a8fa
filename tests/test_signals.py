from palimpsest.operators import signals as S

T = "session_id int, turn int, message string, feedback string"


def turns(spark, messages, feedback=None):
    return spark.createDataFrame([(1, i, m, feedback) for i, m in enumerate(messages)], T)


def test_first_match_wins(spark):
    rows = S.observed(turns(spark, ["No, I prefer exactly this", "perfect, my wife said so", "my wife", None, ""])).orderBy("turn").collect()
    assert [r["dopamine"] for r in rows] == ["user_correction", "user_enthusiasm", "novel_personal_info", None, None]


def test_feedback_wins(spark):
    assert S.dopamine(turns(spark, ["my wife"], "Positive")).first()["dopamine"] == "explicit_positive_feedback"
    assert S.dopamine(turns(spark, ["x"], "correction: y")).first()["dopamine"] == "user_correction"
    assert S.gaba(turns(spark, ["x"], "negative")).first()["gaba"] == "explicit_negative_feedback"


def test_classifier_must_be_certain(spark):
    df = spark.createDataFrame([("x", "denial", 0.9), ("x", "denial", 0.7)], "message string, intent string, intent_confidence double")
    assert [r["gaba"] for r in S.gaba(df).collect()] == ["user_denial", None]


def test_denial_spares_priorities(spark):
    t = spark.createDataFrame([(1, "I never said that")], "turn_id int, message string")
    found = spark.createDataFrame([(1, 10, False), (1, 11, True)], "turn_id int, id int, is_priority boolean")
    assert S.denied(t, found).first()["affected"] == [10]


def test_token_and_substring_habits(spark):
    rows = S.patterns(turns(spark, ["yeah fix it", "the yeahs are a band of ten words or more than it", "```x``` is a thing that goes on and on for long"])).collect()
    assert {(r["turn"], r["pattern_key"]) for r in rows} == {(0, "prefers_concise"), (0, "casual_tone"), (2, "wants_code_examples")}


def test_crystallises_only_across_sessions(spark):
    seen = [("k", "a", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4), ("k", "b", 5), ("j", "a", 6), ("j", "b", 7)]
    df = spark.createDataFrame(seen, "pattern_key string, session_id string, seq long")
    assert [(r["pattern_key"], r["seq"], r["observation_count"]) for r in S.crystallised(df).collect()] == [("k", 4, 4)]
    assert S.crystallised(df, spark.createDataFrame([("k",)], "pattern_key string")).count() == 0


def test_topics(spark):
    rows = S.with_topic(turns(spark, ["Tell me about rust ownership, rust ownership!", "weather", "the of", None])).orderBy("turn").collect()
    assert [r["topic"] for r in rows] == ["rust ownership", "weather", None, None]


def test_sustained_topic(spark):
    df = spark.createDataFrame([(1, 1, "rust a"), (1, 2, "b rust"), (1, 3, "rust"), (1, 4, None), (2, 1, "rust"), (2, 2, "rust")], "session_id int, turn int, topic string")
    assert [r["is_sustained"] for r in S.sustained(df).orderBy("session_id", "turn").collect()] == [False, False, True, False, False, False]


def test_cluster_keeps_the_newest(spark):
    df = spark.createDataFrame([("c", i, i) for i in range(20)] + [("c", 19, 99)], "cluster_id string, memory_id int, seq int")
    assert S.cluster_members(df).first()["memory_ids"] == list(range(5, 20))


def test_word_overlap_match(spark):
    topics = spark.createDataFrame([("rust ownership",), ("red wine",)], "topic string")
    clusters = spark.createDataFrame([(1, "rust borrowing", 1)], "id int, topic string, seq int")
    assert [(r["topic"], r["overlap"]) for r in S.matched_clusters(topics, clusters).collect()] == [("rust ownership", 0.5)]


def test_topic_shift_is_per_session(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 1, [1.0, 0.0]), (2, 2, [1.0, 0.1])], "session_id int, turn int, embedding array<double>")
    assert [r["topic_shift"] for r in S.topic_shifts(df).orderBy("session_id", "turn").collect()] == [False, True, False, False]


def test_caution_is_transient(spark):
    df = spark.createDataFrame([(1, 1, "user_frustration", False), (1, 2, None, False), (1, 3, None, True)], "session_id int, turn int, norepinephrine string, topic_shift boolean")
    rows = S.retrieval_config(df).orderBy("turn").collect()
    assert [r["top_k"] for r in rows] == [10, 20, 20] and rows[0]["caution"] is None and "frustration" in rows[1]["caution"] and "topic" in rows[2]["caution"]
