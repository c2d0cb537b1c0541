from driftlog.config import Config
from driftlog.engine import Engine
from driftlog.streaming import ingest as streaming

SCHEMA = "ts double, service string, level string, msg string"


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(folder)


def test_restart_neither_loses_nor_doubles(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "root")
    land(spark, landing, [(float(i), "auth", "INFO", "m") for i in range(10)] + [(1.0, "auth", "LOUD", "m")])
    run = lambda: streaming.ingest(spark.readStream.schema(SCHEMA).json(landing), root, 100.0).awaitTermination()
    run()
    assert streaming.stored(spark, root).count() == 10
    land(spark, landing, [(float(i), "billing", "ERROR", "m") for i in range(5)])
    run()
    run()
    stored = streaming.stored(spark, root)
    assert stored.count() == 15 and stored.where("service = 'billing'").count() == 5
    assert streaming.stored(spark, root, "quarantine").count() == 1
    heads = streaming.stored(spark, root, "headers")
    assert sorted(r["n_rows"] for r in heads.collect()) == [5, 10]
    engine = Engine(spark, root, clock=lambda: 100.0)
    assert engine.events.where("type = 'chunk_persisted'").count() == 2 and engine.events.where("type = 'chunk_sealed'").count() == 0
    assert [(r["seq"], r["n_rows"], r["is_open"]) for r in engine.headers.collect()] == [(0, 15, True)]  # the second batch went on with the open chunk
    assert engine.find('level = "ERROR" | order by ts desc | limit 2').count() == 2
    assert streaming.event_stream(spark, root).isStreaming


def test_sealing_goes_on_over_batches(spark, tmp_path):
    root, config = str(tmp_path), Config(chunk_max_entries=4, chunk_max_seconds=1e9)
    write = streaming._sink(root, lambda: 100.0, config)
    for number in (0, 1, 1, 2):  # one batch runs twice
        rows = [(float(10 * number + i), "auth", "INFO", f"m{number}-{i}") for i in range(3)]
        write(spark.createDataFrame(rows, SCHEMA), number)
    engine = Engine(spark, root, config, clock=lambda: 100.0)
    assert [(r["seq"], r["n_rows"], r["is_open"]) for r in engine.headers.orderBy("seq").collect()] == [(0, 4, False), (1, 4, False), (2, 1, True)]
    assert engine.find("ts exists").count() == 9 == engine.logs.select("pos").distinct().count()
    assert engine.events.where("type = 'chunk_sealed'").count() == 2
    lanes = str(tmp_path / "lanes")
    write = streaming._sink(lanes, 100.0, config, lanes=3)
    for number in range(2):
        write(spark.createDataFrame([(float(i), f"s{i}", "INFO", f"m{number}") for i in range(20)], SCHEMA), number)
    heads = Engine(spark, lanes, config).headers.collect()
    assert sum(r["n_rows"] for r in heads) == 40 and all(r["n_rows"] == 4 for r in heads if not r["is_open"]) and sum(r["is_open"] for r in heads) <= 3


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    write = streaming._sink(str(tmp_path), 100.0)
    batch = spark.createDataFrame([(1.0, "a", "INFO", "m")], SCHEMA)
    write(batch, 3)
    write(batch, 3)
    assert streaming.stored(spark, str(tmp_path)).count() == 1


def test_windowed_rates(spark, tmp_path):
    landing = str(tmp_path / "landing")
    land(spark, landing, [(float(i), "auth", "INFO", "m") for i in range(60)])
    rates = streaming.windowed_rates(spark.readStream.schema(SCHEMA).json(landing), 60, 30)
    query = rates.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["rate"] for r in spark.sql("SELECT rate FROM rates").collect()} == {0.5, 1.0}
