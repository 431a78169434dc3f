from arbograph.streaming import arrivals

SCHEMA = "turn_id long, session_id long, question string, created_at timestamp"


def test_turns_arrive_once_and_are_counted(spark, tmp_path):
    rows = [(1, 1, "a", "2026-01-01 00:00:00"), (1, 1, "a", "2026-01-01 00:00:30"), (2, 1, "b", "2026-01-01 00:05:00"), (3, 2, "c", "2026-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "turn_id long, session_id long, question string, t string").selectExpr("turn_id", "session_id", "question", "cast(t as timestamp) created_at")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    arrivals.append_to(arrivals.first_arrivals(stream, ["turn_id"], "created_at"), "turns", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    found = spark.read.parquet(str(tmp_path / "out" / "turns"))
    assert sorted(r.turn_id for r in found.collect()) == [1, 2, 3]
    counted = arrivals.turns_by_window(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.n_turns, r.n_sessions) for r in spark.table("counted").collect()) == [(1, 1), (3, 1)]
