from datetime import datetime

from labelloom.streaming import spans


def _drain(df, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql("select * from out").collect()


def test_streams(spark, tmp_path):
    at = lambda h: datetime(2025, 1, 1, h)
    batch = spark.createDataFrame([("a", 1, at(1), "j1"), ("a", 1, at(1), "j1"), ("b", 2, at(2), "j1"), ("c", None, at(20), "j2")], "span_id string, page int, ingested_at timestamp, job_id string")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spans.read_stream(spark, str(tmp_path / "in"), batch.schema)
    assert len(_drain(spans.first_deliveries(stream(), "span_id", "ingested_at"), "append")) == 3
    counts = _drain(spans.windowed_counts(stream(), "ingested_at", "job_id"), "complete")
    assert sorted((r.job_id, r.n) for r in counts) == [("j1", 1), ("j1", 2), ("j2", 1)]
    sessions = _drain(spans.gap_sessions(stream(), "ingested_at", "job_id"), "complete")
    assert sorted((r.job_id, r.n) for r in sessions) == [("j1", 3), ("j2", 1)]
    state = _drain(spans.job_progress(stream(), "job_id", "page"), "update")
    assert sorted(tuple(r) for r in state) == [("j1", 3, 2), ("j2", 1, 0)]
