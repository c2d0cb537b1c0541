"""The process: inbox, broker, streams and HTTP answers."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from driftlog.config import Config
from driftlog.engine import Engine
from driftlog.server import Broker, Inbox, Runtime, http_server, problem
from driftlog.streaming import ingest

ROW = {"ts": 10.0, "service": "auth", "level": "ERROR", "msg": "no", "fields": {"user_id": 7, "host": "h1"}}


def test_an_inbox_takes_all_rows_or_none(spark, tmp_path):
    inbox = Inbox(spark, str(tmp_path / "landing"), size=3)
    assert inbox.try_append(ROW, ROW) and not inbox.try_append(ROW, ROW) and inbox.try_append(ROW) and not inbox.try_append(ROW)
    assert inbox.flush() == 3 and inbox.flush() == 0 and inbox.try_append(ROW)
    files = [p for p in (tmp_path / "landing").iterdir() if p.suffix == ".json"]
    assert [json.loads(x) for x in files[0].read_text().splitlines()] == [ROW] * 3 and len(files) == 1


def test_a_slow_subscriber_loses_the_newest():
    broker = Broker(size=2)
    slow = broker.subscribe()
    for n in range(3):
        broker.publish({"n": n})
    assert [slow.get_nowait()["n"] for _ in range(slow.qsize())] == [0, 1]
    broker.unsubscribe(slow)
    broker.publish({"n": 9})
    assert slow.empty()


@pytest.mark.parametrize("change", [{"ts": -1}, {"ts": 1e12}, {"ts": True}, {"ts": None}, {"service": ""}, {"service": "s" * 129}, {"level": "LOUD"}, {"msg": "m" * 10_001}, {"msg": None}, {"fields": [1]}])
def test_rows_out_of_bounds_are_named(change):
    assert problem(ROW, 100.0) is None and problem(ROW | change, 100.0) and problem([ROW], 100.0)


def call(base, path, body=None):
    data = None if body is None else (body if isinstance(body, bytes) else json.dumps(body).encode())
    try:
        with urllib.request.urlopen(urllib.request.Request(base + path, data), timeout=60) as reply:
            return reply.status, json.loads(reply.read()), reply.headers
    except urllib.error.HTTPError as reply:
        return reply.code, json.loads(reply.read()), reply.headers


def test_rows_come_in_and_queries_are_answered(spark, tmp_path):
    with Runtime(spark, str(tmp_path / "root"), Config(tick_interval_sec=3600.0, metric_tick_interval_sec=3600.0), clock=lambda: 100.0) as runtime:
        server = http_server(runtime, port=0)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_address[1]}"
        assert call(base, "/api/query", {"q": 'level = "ERROR"'})[1]["rows_returned"] == 0  # nothing has come yet
        assert call(base, "/api/engine/state")[1]["n_chunks"] == 0 and call(base, "/api/chunks")[1] == []
        events = urllib.request.urlopen(base + "/api/events", timeout=60)
        status, body, headers = call(base, "/api/logs", [ROW, ROW | {"level": "INFO", "msg": 'quote " and ünï'}])
        assert (status, body) == (202, {"accepted": 2}) and headers["Access-Control-Allow-Origin"] == "*"
        assert call(base, "/api/logs", ROW | {"level": "LOUD"})[0] == 422 and call(base, "/api/logs", b"{")[0] == 422
        until = time.monotonic() + 60
        while call(base, "/api/health")[1]["chunks"] == 0 and time.monotonic() < until:
            time.sleep(0.5)
        status, body, _ = call(base, "/api/query", {"q": "user_id = 7 | order by ts desc"})
        assert status == 200 and body["rows_returned"] == 2 and {r["msg"] for r in body["results"]} == {"no", 'quote " and ünï'}
        assert body["results"][0]["fields"] == {"user_id": 7, "host": "h1"} and body["duration_ms"] > 0
        status, body, _ = call(base, "/api/query", {"q": 'level = = "x"'})
        assert status == 400 and "^" in body["detail"]
        assert call(base, "/api/query", {"q": ""})[0] == 422 and call(base, "/nowhere")[0] == 404 and call(base, "/api/tracker/top-predicates?k=x")[0] == 422
        named = []
        while "chunk_persisted" not in named:
            line = events.readline().decode()
            named += [line.split()[1]] if line.startswith("event: ") else []
        events.close()
        runtime.engine.build_index("hash", "service")
        runtime.engine.absorb(100.0)
        assert [r["status"] for r in call(base, "/api/indexes")[1]] == ["active"] and call(base, "/api/engine/state")[1]["n_indexed"] == 1
        assert {(r["field"], r["value"]) for r in call(base, "/api/tracker/top-predicates")[1]} >= {("user_id", "7.0")}
        assert len(call(base, "/api/tracker/top-predicates?k=1")[1]) == 1
        assert [(r["n_rows"], r["indexes"]) for r in call(base, "/api/chunks")[1]] == [(2, ["0:hash:service"])]
        runtime.inbox.size = 0
        status, _, headers = call(base, "/api/logs", [])
        assert status == 202
        runtime.inbox.size = 1
        runtime.inbox.try_append = lambda *rows: False
        status, _, headers = call(base, "/api/logs", ROW)
        assert status == 429 and headers["Retry-After"] == "1"
        server.shutdown()
        server.server_close()
    assert not runtime.ingest.isActive and not runtime.told.isActive


def test_what_was_accepted_is_there_after_a_stop(spark, tmp_path):
    settings = Config(tick_interval_sec=3600.0, metric_tick_interval_sec=3600.0)
    with Runtime(spark, str(tmp_path / "root"), settings, clock=lambda: 100.0) as runtime:
        assert runtime.inbox.try_append(ROW)
    with Runtime(spark, str(tmp_path / "root"), settings, clock=lambda: 100.0) as runtime:
        assert runtime.inbox.try_append(ROW | {"service": "billing"})
    found = runtime.engine.find("ts exists").select("service").collect()
    assert sorted(r["service"] for r in found) == ["auth", "billing"]


def test_an_index_on_a_growing_chunk_hides_no_row(spark, tmp_path):
    root, schema = str(tmp_path / "root"), "ts double, service string, level string, msg string"
    engine = Engine(spark, root, clock=lambda: 100.0)
    write = ingest._sink(root, 100.0, engine=engine)
    batch = lambda n: spark.createDataFrame([(float(n), "auth", "INFO", f"m{n}")], schema)
    write(batch(0), 0)
    assert engine.hot == {0} and engine.find('service = "auth"').count() == 1
    engine.build_index("hash", "service")
    write(batch(1), 1)  # the open chunk 0 goes on
    assert engine.find('service = "auth"').count() == 2 and engine.headers.count() == 1
    engine.build_index("hash", "service")
    ingest._sink(root, 100.0)(batch(2), 2)  # by another process
    assert engine.catalog.read().count() == 0 and engine.catalog.version == Engine(spark, root).catalog.version
