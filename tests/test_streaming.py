import random

from pyspark.sql import functions as F

from seamline.operators import sessions as batch
from seamline.streaming import sessions


def test_late_and_repeated_events(spark, tmp_path):
    rows = [(1, "2024-01-01 00:01:00", "u", "a"), (2, "2024-01-01 00:02:00", "u", "b"), (2, "2024-01-01 00:02:00", "u", "b"), (3, "2024-01-01 00:30:00", "u", "c"), (4, "2024-01-01 02:00:00", "u", "a")]
    df = spark.createDataFrame(rows, "id long, ts string, g string, n string").selectExpr("id", "cast(ts as timestamp) ts", "g", "n")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions.windowed_cooccurrence(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from windows")
    assert [r["nodes"] for r in got.collect()] == [["a", "b", "c"]]
    assert sorted((r["i"], r["j"]) for r in sessions.pairs(got).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_anchored_sessions_over_a_restart(spark, tmp_path):
    """Events come in files, out of order within the watermark and some too late; a stream that is stopped and started again gives the rows of the batch operator."""
    rng = random.Random(8)
    events, t = [], 1_700_000_000_000
    for k in range(400):
        t += rng.choice([50, 400, 3000])
        events.append((f"g{rng.randrange(4)}", k, t, rng.choice("abc")))
    moved = sorted(events, key=lambda e: e[2] + rng.randrange(4000))  # less than the 5 s that late events have
    schema = "g string, seq long, t long, n string"
    folder = tmp_path / "in"

    def arrive(part, name):
        rows = spark.createDataFrame(part, schema).select("g", "seq", F.timestamp_millis("t").alias("ts"), "n")
        rows.coalesce(1).write.mode("append").parquet(str(folder / name))

    def go_on():
        stream = spark.readStream.schema("g string, seq long, ts timestamp, n string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
        out = sessions.anchored_sessions(stream, 2_000, "5 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        assert out.trigger(availableNow=True).start().awaitTermination(120)

    for k in range(2):
        arrive(moved[100 * k : 100 * k + 100], f"f{k}")
    go_on()
    for k in range(2, 4):
        arrive(moved[100 * k : 100 * k + 100], f"f{k}")
    go_on()
    arrive([("g0", 900, events[50][2], "late"), ("g9", 1000, t + 60_000, "z")], "f4")
    go_on()
    arrive([("g9", 1001, t + 120_000, "z")], "f5")
    go_on()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("g", "seq", "t", "n", "session").collect())
    want = sorted(tuple(r) for r in batch.anchored_sessions(spark.createDataFrame(events, schema), 2_000).select("g", "seq", "t", "n", "session").collect())
    assert [r for r in got if r[0] != "g9"] == want and max(r[4] for r in want) > 20
