import shutil

from millrace.streaming import telemetry


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in" / "a.parquet")
    folder = str(tmp_path / "in")
    stream = telemetry.windowed(telemetry.read_events(spark, folder))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    want = telemetry.windowed(spark.read.parquet(folder))
    assert sorted(map(str, spark.table("windows").collect())) == sorted(map(str, want.collect()))


def events(rng, n):
    import datetime

    start, out = datetime.datetime(2026, 1, 1), []
    for i in range(n):
        at = start + datetime.timedelta(milliseconds=i * 700 + rng.randint(0, 400))
        out.append((0 if rng.random() < 0.4 else rng.randint(1, 9), at, rng.choice(("token", "token", "token", "figure", "other", "end", "error")), rng.choice((None, 1.5, 2.0))))
    return out


def test_runs_of_a_stream_as_of_the_table(spark, tmp_path):
    """Events out of order within the watermark; a last event, far later, lets the timers close what never ended."""
    import datetime
    import random

    from millrace.streaming.runs import OUTPUT, runs, runs_of_table

    rng, kind = random.Random(3), "run long, at timestamp, kind string, value double"
    rows = events(rng, 600)
    shuffled = sorted(rows, key=lambda e: e[1] + datetime.timedelta(milliseconds=rng.randint(0, 4000)))
    parts = [shuffled[i : i + 100] for i in range(0, 600, 100)]
    parts.append([(99, rows[-1][1] + datetime.timedelta(hours=2), "token", None)])
    parts.append([(99, rows[-1][1] + datetime.timedelta(hours=2, seconds=1), "end", None), (5, rows[0][1], "end", None)])  # the second is far too late
    source = tmp_path / "in"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        source.mkdir(exist_ok=True)
        for f in (tmp_path / f"part{i}").glob("*.parquet"):
            f.rename(source / f"{i:03}.parquet")
        import os

        os.utime(source / f"{i:03}.parquet", (1_700_000_000 + i * 60,) * 2)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = runs(stream, 5000, "10 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    got = sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).where("run <> 99").select(names).collect()))
    want = sorted(map(repr, runs_of_table(spark.createDataFrame(rows, kind), 5000).select(names).collect()))
    assert got == want and len(want) > 50 and {r.split("outcome=")[1] for r in want} == {"'cut')", "'end')", "'error')"}


def test_batches_do_not_grow_with_files(spark, tmp_path, monkeypatch):
    from millrace.plans import eval_queries as q

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(6).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    monkeypatch.setattr(q, "new_path", lambda spark, name: str(tmp_path / name))
    got = q.run_telemetry_stream(spark, str(tmp_path / "sf")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, q.run_telemetry(spark, str(tmp_path / "sf")).collect()))
    chunks = events.selectExpr("unix_seconds(cast(ts as timestamp)) div 432000 AS n").distinct().count()
    batches = [p for p in (tmp_path / "event-stream" / "progress" / "commits").iterdir() if p.name.isdigit()]
    assert len(batches) <= chunks + 3
