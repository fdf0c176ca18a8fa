import numpy as np

from palimpsest.operators import signals as S
from palimpsest.streaming import turns as ST

DDL = "session_id long, turn long, message string, embedding array<double>"


def test_stream_equals_batch(spark, tmp_path):
    r = np.random.default_rng(2)
    said = ["rust ownership rules", "listen to rust ownership", "rust ownership again and again", "the weather is nice", "why", None]
    rows = [(s, t, said[(s + t) % 6], r.normal(size=3).tolist()) for s in range(4) for t in range(8)]
    batch = spark.createDataFrame(rows, DDL)
    for k, part in enumerate((batch.where("turn < 3"), batch.where("turn >= 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    q = ST.watched(stream, expiring=False).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {(x["session_id"], x["turn"]): x for x in spark.sql("SELECT * FROM watched").collect()}
    flags = S.norepinephrine(S.topic_shifts(batch))
    want = S.sustained(S.with_topic(S.retrieval_config(flags))).collect()
    assert len(got) == len(want) == 32
    for w in want:
        g = got[w["session_id"], w["turn"]]
        assert (g["topic_shift"], g["top_k"], g["caution"], g["is_sustained"]) == (w["topic_shift"], w["top_k"], w["caution"], w["is_sustained"])
        assert abs(g["relevance_threshold"] - w["relevance_threshold"]) < 1e-12


def test_event_windows_close(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    spark.read.parquet(f"{small}/events.parquet").write.parquet(str(tmp_path / "ev"))
    q = ST.counted_events(spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("ev").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert spark.sql("SELECT count(*) FROM ev").first()[0] >= 0
