"""The control loop over the engine's own tables."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from driftlog.config import Config
from driftlog.engine import Engine

SCHEMA = "pos long, ts double, service string, level string, msg string, seq int, fields string"
NAMES = ("auth", "billing")


def rows(spark, lo, hi, size=5):
    made = [(i, float(i), NAMES[i % 2], "ERROR" if i % 3 == 0 else "INFO", "m", i // size, f'{{"user_id": {i}, "host": "h{i % 4}"}}') for i in range(lo, hi)]
    return spark.createDataFrame(made, SCHEMA).withColumn("fields", F.parse_json("fields"))


@pytest.fixture
def engine(spark, tmp_path):
    clock = [100.0]
    out = Engine(spark, str(tmp_path / "engine"), Config(chunk_max_entries=5), clock=lambda: clock[0])
    out.now = clock
    out.load(rows(spark, 0, 30))
    return out


def ids(frame):
    return sorted(r["index_id"] for r in frame.collect())


def test_queries_lead_to_indexes_drops_and_restores(spark, engine):
    for _ in range(5):
        assert engine.find('host = "h1"').count() == 8
    first = engine.tick(110.0)
    assert [(r["type"], r["action"]) for r in first.collect()] == [("decision", "build_index")] * 3
    assert len(ids(engine.catalog.read())) == 3 and engine.events.where("type = 'metric_tick'").count() == 1
    assert engine.find('host = "h1"').count() == 8 and engine.query_events[-1]["index"] == "hash:host"  # three chunks through the index, three by scan
    engine.drop_index("hash", "host", now=120.0)
    assert engine.catalog.read().count() == 0 and engine.tombstones.read().count() == 3
    engine.now[0] = 130.0
    for _ in range(5):
        engine.find('host = "h2"').count()
    after = engine.tick(140.0)
    assert {r["action"] for r in after.collect()} == {"restore_index"} and engine.tombstones.read().count() == 0
    assert engine.catalog.read().count() == 3 and engine.find('host = "h2"').count() == 7
    assert {r["planned"] >= r["applied"] for r in spark.read.parquet(f"{engine.root}/tick_summaries").collect()} == {True}


def test_more_chunks_than_the_cap_are_indexed_and_swapped(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "capped"), Config(max_hot_chunks=2, actions_per_tick_budget=3), clock=lambda: 100.0)
    engine.load(rows(spark, 0, 30))
    for _ in range(5):
        engine.find('service = "auth"')
    turn = lambda now: [(r["action"], r["target"]) for r in engine.tick(now).orderBy("action", "target").collect()]
    assert engine.hot == {4, 5} and turn(110.0) == [("build_index", "4:hash:service"), ("build_index", "5:hash:service")]
    for _ in range(5):
        engine.find('service = "auth"', (0.0, 4.0))
    assert turn(120.0) == [("promote", "0")]  # hotter than a hot one, which the cap puts out next
    assert turn(130.0) == [("build_index", "0:hash:service"), ("demote", "4")] and engine.hot == {0, 5}


def test_state_survives_a_restart(spark, engine):
    engine.build_index("hash", "user_id")
    engine.demote(0)
    again = Engine(spark, engine.root, engine.config, clock=lambda: 100.0)
    assert again.catalog.read().count() == 6 and again.hot == engine.hot == {1, 2, 3, 4, 5} and again.next_seq() == 6
    assert [r["pos"] for r in again.find("user_id = 7").collect()] == [7] and again.query_events[-1]["index"] == "hash:user_id"
    again.load(rows(spark, 30, 40))
    assert sorted(r["pos"] for r in again.find("user_id in [7, 33]").collect()) == [7, 33]
    assert again.catalog.read().where("seq >= 6").count() == 0


def test_an_engine_without_rows_ticks_and_answers(spark, tmp_path):
    empty = Engine(spark, str(tmp_path / "none"), clock=lambda: 100.0)
    assert empty.tick(100.0).count() == 0 and empty.find("user_id = 7").count() == 0 and empty.health()["chunks"] == 0
    assert empty.pressure() == 0 and empty.next_seq() == 0 and empty.cold(50.0).count() == 0


def test_old_versions_of_state_go(spark, engine):
    early = engine.catalog.read()
    for k in range(3):
        engine.build_index("hash", f"f{k}")
    assert early.count() == 0 and engine.catalog.read().count() == 18
    engine.catalog.prune(keep=0)
    assert list(engine.catalog.since) == [engine.catalog.version] and engine.catalog.read().count() == 18


def test_an_action_that_fails_stops_no_other(spark, engine, monkeypatch):
    for _ in range(5):
        engine.find('service = "auth"').count()
    build = engine.build_index

    def sometimes(kind, field, seqs=None, op=None, now=None):
        if seqs == [1]:
            raise OSError("disk is full")
        return build(kind, field, seqs, op, now)

    monkeypatch.setattr(engine, "build_index", sometimes)
    events = engine.tick(110.0).collect()
    assert [r["target"] for r in events] == ["0:hash:service", "2:hash:service"]
    assert spark.read.parquet(f"{engine.root}/tick_summaries").first()["failed"] == 1


def test_pressure_demotes_and_evicts(spark, tmp_path):
    tight = Engine(spark, str(tmp_path / "tight"), Config(max_memory_bytes=400, heavy_index_threshold=1), clock=lambda: 100.0)
    tight.load(rows(spark, 0, 20))
    tight.build_index("hash", "service")
    assert tight.pressure() > 0.95
    moved = tight.tick(200.0).collect()
    assert {"demote"} < {r["action"] for r in moved} and {r["tier_to"] for r in moved if r["action"] == "demote"} == {"cold"}
    assert all(r["reason"].startswith("idle=") for r in moved if r["action"] == "drop_index") and len(tight.hot) < 4
    assert tight.find('service = "auth"').count() == 10 and sorted(r["seq"] for r in tight.cold(50.0).collect()) == [0, 1, 2, 3]


def test_an_index_idles_from_its_birth(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "birth"), Config(chunk_max_entries=5), clock=lambda: 1000.0)
    engine.load(rows(spark, 0, 10))
    engine.build_index("hash", "service", now=1000.0)
    made = lambda now: [r["action"] for r in engine.tick(now).where("type = 'decision'").collect()]
    assert made(1050.0) == [] and engine.catalog.read().count() == 2  # young, though never used
    assert made(1700.0) == ["drop_index"] * 2 and engine.tombstones.read().count() == 2


def test_uses_and_heat_are_counted_by_query(spark, engine):
    engine.build_index("hash", "service")
    for _ in range(3):
        engine.find('service = "auth" and level = "INFO"').count()
    engine.find('service = "auth"', (0.0, 4.0)).count()
    engine.absorb(110.0)
    used = {r["seq"]: r["usage"] for r in engine.catalog.read().collect()}
    assert used == {0: 2} | dict.fromkeys(range(1, 6), 1)  # usage after the decay of the first turn: 4 and 3 halved
    engine.build_index("hash", "service", [0])
    assert engine.catalog.read().where("seq = 0").first()["usage"] == 2
    assert engine.hottest(1).first()["seq"] == 0
    engine.forget_heat([0])
    assert engine.heat.read().count() == 5 and engine.top_predicates(1).first()["field"] == "service"


def test_static_indexes_come_without_being_asked(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "static"), Config(static_indexes=("service", "ts")), clock=lambda: 100.0)
    engine.load(rows(spark, 0, 10))
    assert engine.tick(110.0).count() == 0
    assert ids(engine.catalog.read()) == ["0:hash:service", "0:skip:ts", "1:hash:service", "1:skip:ts"]
    engine.tick(120.0)
    assert engine.catalog.read().count() == 4


def test_bursts_are_entered_and_left(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "burst"), Config(burst_stability_n=2), clock=lambda: 0.0)
    engine.load(rows(spark, 0, 1))
    at, moment = 1, 0.0
    seen = []
    for size in [1] * 8 + [200] * 4 + [0] * 8:
        moment += 1.0
        if size:
            engine.load(rows(spark, at, at + size, 1000).withColumn("seq", F.lit(int(moment))), now=moment)
            at += size
        seen.append(engine.step_burst(moment)[0])
    assert True in seen and seen[0] is False and seen[-1] is False
    assert [r["state"] for r in engine.events.where("type = 'burst'").orderBy("ts").collect()] == ["enter", "exit"]


def test_the_endpoint_answers_with_rows_or_with_the_place(engine):
    good = engine.query('level = "ERROR" and service = "auth" | limit 3')
    assert good["row_count"] == 3 == len(good["rows"]) and good["duration_ms"] > 0 and good["index"] is None
    bad = engine.query('level = = "x"')
    assert "^" in bad["error"] and bad["position"] == 8
    assert engine.health()["status"] == "ok" and engine.health()["chunks"] == 6


def test_the_loop_survives_a_failing_turn(engine, monkeypatch):
    turns, stop = [], threading.Event()

    def turn():
        turns.append(1)
        if len(turns) == 1:
            raise RuntimeError("once")
        stop.set()

    monkeypatch.setattr(engine, "tick", turn)
    loop = threading.Thread(target=engine.run, args=(stop, 0.01))
    loop.start()
    loop.join(10)
    assert len(turns) == 2 and not loop.is_alive() and time.time() > 0
