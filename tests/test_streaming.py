import json

from pyspark.sql import functions as F

from vastgrain.operators import grid, text
from vastgrain.streaming import leases, live


def drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_live_canvas_equals_batch(spark, tmp_path):
    points = spark.range(3000).select((F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 53).cast("double").alias("y"))
    points.repartition(4).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("x double, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    bounds = (0, 97, 0, 53)
    got = drain(live.live_canvas(stream, bounds, (8, 8), "x", "y"), "canvas", "complete", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, grid.canvas(points, bounds, (8, 8), "x", "y").collect()))


def test_log_stream_skips_torn_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text(json.dumps({"op": "load", "n": 1}) + "\n" + '{"op": "lo')
    (tmp_path / "log" / "b.jsonl").write_text(json.dumps({"op": "open", "n": 2}) + "\n")
    got = drain(live.read_log(spark, str(tmp_path / "log"), "op string, n long").filter("op is not null"), "logs", "append", tmp_path)
    assert sorted(r.op for r in got.collect()) == ["load", "open"]


def test_live_trigrams_equal_batch(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"line {i} alpha beta") for i in range(50)], "line long, text string")
    lines.repartition(3).write.parquet(str(tmp_path / "l"))
    stream = spark.readStream.schema("line long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "l"))
    live.live_trigrams(stream, str(tmp_path / "index"), str(tmp_path / "ck"), 8).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "index")).select("block", "trigram").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, text.trigram_index(lines, 8).collect()))


def test_hops_drop_late_rows(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", float(h)) for h in range(6) for m in (0, 30)]
    spark.createDataFrame(rows, "t string, v double").select(F.to_timestamp("t").alias("ts"), "v").repartition(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "e"))
    got = drain(live.live_hops(stream, "ts", "v", "2 hours", "1 hour", "10 minutes"), "hops", "complete", tmp_path)
    assert got.count() == 7 and got.agg(F.sum("n")).first()[0] == 24
    sessions = drain(live.live_sessions(stream.withColumn("k", F.lit(1)), "k", "ts", "20 minutes", "1 hour"), "sess", "complete", tmp_path)
    assert sessions.count() == 12


def test_status_moves_forward(spark):
    events = [(1, 1, "open"), (1, 2, "searched"), (1, 3, "described"), (2, 1, "open"), (2, 2, "confirmed"), (2, 3, "searched"), (3, 1, "refuted"), (3, 2, "in-review")]
    got = {r.id: r.status for r in live.fold_status(spark.createDataFrame(events, "id long, line long, status string")).collect()}
    assert got == {1: "searched", 2: "confirmed", 3: "in-review"}


def test_leases(spark):
    policy = leases.Policy(ttl=60, idle=20)
    events = [("g", 0.0, 0, "reserve", "a", 80), ("g", 1.0, 1, "reserve", "b", 50), ("g", 5.0, 2, "reserve", "c", 10), ("g", 10.0, 3, "release", "a", 0), ("g", 75.0, 4, "touch", "c", 0), ("g", 76.0, 5, "reserve", "d", 200)]
    got = [(r.t, r.outcome, r.holder, r.amount) for r in leases.replay(spark.createDataFrame(events, "device string, t double, line int, op string, holder string, amount long"), 100, policy).collect()]
    assert got == [(0.0, "granted", "a", 80), (10.0, "released", "a", 80), (10.0, "granted", "b", 50), (10.0, "granted", "c", 10), (75.0, "expired", "b", 50), (75.0, "expired", "c", 10), (76.0, "refused", "d", 200)]
