"""The engine as a process: a bounded inbox, the streams, the control loop, and a thin HTTP layer over them.

Only metadata and the rows of an answer pass the driver, and an answer's rows pass it partition by partition.
"""

from __future__ import annotations

import json
import logging
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.config import Config
from driftlog.engine import Engine
from driftlog.operators import views
from driftlog.plans.parser import ParseError
from driftlog.sources.logs import LEVELS, read_landing
from driftlog.streaming import ingest

log = logging.getLogger(__name__)

#: Rows that wait for the landing folder, events that wait for a subscriber, characters of a query.
INBOX_ROWS, SUBSCRIBER_EVENTS, QUERY_CHARS = 1000, 1000, 10_000
#: Seconds between two landing files, and what a writer that is refused is told to wait.
FLUSH_SEC, RETRY_SEC = 0.1, 1


def problem(row: object, now: float) -> str | None:
    """Why a row can't be taken in; the rules of ``sources.logs.valid`` and that ``fields`` is an object."""
    if not isinstance(row, dict):
        return "a row is an object"
    ts, service, level, msg = (row.get(k) for k in ("ts", "service", "level", "msg"))
    if isinstance(ts, bool) or not isinstance(ts, int | float) or not 0 <= ts <= now + 86400:
        return "ts must be a recent unix timestamp"
    if not isinstance(service, str) or not 1 <= len(service) <= 128:
        return "service must have 1 to 128 characters"
    if level not in LEVELS:
        return f"level must be one of {', '.join(LEVELS)}"
    if not isinstance(msg, str) or len(msg) > 10_000:
        return "msg must have at most 10000 characters"
    if not isinstance(row.get("fields", {}), dict):
        return "fields must be an object"
    return None


class Inbox:
    """Rows on their way to the landing folder, in files that appear whole. A full inbox refuses rows, which is the writers' backpressure."""

    def __init__(self, spark: SparkSession, landing: str, size: int = INBOX_ROWS):
        self.spark, self.landing, self.size = spark, landing.rstrip("/"), size
        self._rows: list[dict] = []
        self._lock, self._flushing = threading.Lock(), threading.Lock()
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._store = hadoop(self.landing).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._store.mkdirs(hadoop(self.landing))

    def try_append(self, *rows: dict) -> bool:
        """All rows or none."""
        with self._lock:
            if len(self._rows) + len(rows) > self.size:
                return False
            self._rows += rows
            return True

    def flush(self) -> int:
        """Waiting rows as one file of JSON lines; they stay waiting if it can't be written."""
        with self._flushing:
            with self._lock:
                taken = list(self._rows)
            if not taken:
                return 0
            lines = "".join(json.dumps({"fields": {}, **row}, ensure_ascii=False) + "\n" for row in taken).encode()
            hadoop, name = self.spark._jvm.org.apache.hadoop.fs.Path, f"{uuid.uuid4().hex}.json"
            hidden = hadoop(f"{self.landing}/_{name}")  # readers pass over names that begin so
            out = self._store.create(hidden)
            try:
                out.write(lines)
            finally:
                out.close()
            self._store.rename(hidden, hadoop(f"{self.landing}/{name}"))
            with self._lock:
                del self._rows[: len(taken)]
            return len(taken)


class Broker:
    """Events to subscribers. A subscriber that is behind loses the newest ones; publishing never waits."""

    def __init__(self, size: int = SUBSCRIBER_EVENTS):
        self.size, self._queues, self._lock = size, [], threading.Lock()

    def subscribe(self) -> queue.Queue:
        mine: queue.Queue = queue.Queue(self.size)
        with self._lock:
            self._queues.append(mine)
        return mine

    def unsubscribe(self, mine: queue.Queue) -> None:
        with self._lock:
            self._queues = [q for q in self._queues if q is not mine]

    def publish(self, event: dict) -> None:
        with self._lock:
            for each in self._queues:
                try:
                    each.put_nowait(event)
                except queue.Full:
                    pass


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object a row, nulls and open fields included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


class Runtime:
    """Inbox, ingest stream, event stream and control loop; ``with Runtime(...) as runtime`` starts and stops them.

    A restart goes on from the tables and the stream's checkpoint.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), clock: Callable[[], float] = time.time, files_per_trigger: int = 1000):
        self.spark, self.root, self.config, self.clock, self.files_per_trigger = spark, root.rstrip("/"), config, clock, files_per_trigger
        self.engine = Engine(spark, self.root, config, clock)
        self.inbox, self.broker = Inbox(spark, f"{self.root}/landing"), Broker()
        self._stop = threading.Event()
        self._threads: list[threading.Thread] = []

    def start(self) -> Runtime:
        rows = read_landing(self.spark, self.inbox.landing, streaming=True, files_per_trigger=self.files_per_trigger)
        self.ingest = ingest.ingest(rows, self.root, self.clock, available_now=False, interval=1.0, config=self.config, engine=self.engine)
        self.engine._publish(self.spark.createDataFrame([(float(self.clock()), "started")], "ts double, type string"), "started")  # the folder is there from now on
        told = ingest.event_stream(self.spark, self.root).writeStream.foreachBatch(self._tell)
        self.told = told.option("checkpointLocation", f"{self.root}/checkpoint-events/{uuid.uuid4().hex}").start()
        for work in (self._flush, lambda: self.engine.run(self._stop)):
            self._threads.append(threading.Thread(target=work, daemon=True))
            self._threads[-1].start()
        return self

    def _flush(self) -> None:
        while not self._stop.wait(FLUSH_SEC):
            try:
                self.inbox.flush()
            except Exception:
                log.exception("rows stay in the inbox")

    def _tell(self, events: DataFrame, number: int) -> None:
        for row in as_json(events.orderBy("ts")).toLocalIterator():
            self.broker.publish({k: v for k, v in json.loads(row["json"]).items() if v is not None})

    def stop(self) -> None:
        """What was accepted is landed and taken in first."""
        self._stop.set()
        for thread in self._threads:
            thread.join()
        self.inbox.flush()
        ingest.stop(self.ingest)
        self.told.stop()

    def __enter__(self) -> Runtime:
        return self.start()

    def __exit__(self, *failure) -> None:
        self.stop()

    # Answers

    def answer(self, text: str) -> Iterator[str]:
        """The body of an answer in pieces. Errors of the text are raised before the first piece."""
        began = time.perf_counter()
        found = self.engine.find(text)
        shown = as_json(found.select(*[c for c in found.columns if c not in ("pos", "seq")]))

        def pieces() -> Iterator[str]:
            yield '{"results":['
            n = 0
            for n, row in enumerate(shown.toLocalIterator(prefetchPartitions=True), 1):
                yield ("," if n > 1 else "") + row["json"]
            yield f'],"rows_returned":{n},"duration_ms":{(time.perf_counter() - began) * 1000:.3f}}}'

        return pieces()

    def table(self, path: str, options: dict[str, list[str]]) -> DataFrame | dict | None:
        """What the paths of the API show; None for others."""
        engine = self.engine
        if path == "/api/health":
            return engine.health()
        if path == "/api/tracker/top-predicates":
            return engine.top_predicates(max(int(options.get("k", ["20"])[0]), 0)).select("field", "op", "value", "freq")
        if path == "/api/indexes":
            return views.index_list(engine.catalog.read().drop("path"), engine.tombstones.read())
        if path not in ("/api/chunks", "/api/engine/state"):
            return None
        snapshot = engine.snapshot(engine.clock())
        if path == "/api/engine/state":
            rate, ratio = engine._rates
            held = views.engine_state(snapshot.chunks, snapshot.indexes).first().asDict()
            burst = engine.burst.read().first()
            return held | {"write_rate": rate, "burst_ratio": ratio, "is_burst": bool(burst and burst["inside"]), "memory_pressure": snapshot.pressure}
        listed = engine.catalog.read().groupBy("seq").agg(F.array_sort(F.collect_list("index_id")).alias("indexes"))
        kinds = snapshot.chunks.select("seq", "tier", "state")
        return views.chunk_list(engine.headers, engine.heat.read()).join(kinds, "seq", "left").join(listed, "seq", "left")


class Handler(BaseHTTPRequestHandler):
    runtime: Runtime

    def log_message(self, *args) -> None:
        log.debug(*args)

    def _start(self, status: int, kind: str = "application/json", **headers: str) -> None:
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Access-Control-Allow-Origin", "*")
        for name, value in headers.items():
            self.send_header(name.replace("_", "-"), value)
        self.end_headers()

    def _send(self, status: int, body: object, **headers: str) -> None:
        self._start(status, **headers)
        self.wfile.write(json.dumps(body).encode())

    def _write_pieces(self, pieces: Iterator[str]) -> None:
        for piece in pieces:
            self.wfile.write(piece.encode())

    def do_OPTIONS(self) -> None:
        self._start(204, Access_Control_Allow_Methods="GET, POST, OPTIONS", Access_Control_Allow_Headers="*")

    def do_GET(self) -> None:
        where = urlparse(self.path)
        if where.path == "/api/events":
            return self._events()
        try:
            shown = self.runtime.table(where.path, parse_qs(where.query))
        except ValueError as error:
            return self._send(422, {"detail": str(error)})
        if shown is None:
            return self._send(404, {"detail": "not found"})
        if isinstance(shown, dict):
            return self._send(200, shown)
        self._start(200)
        rows = as_json(shown).toLocalIterator()
        self._write_pieces(iter(["["]))
        self._write_pieces(("," if n else "") + r["json"] for n, r in enumerate(rows))
        self._write_pieces(iter(["]"]))

    def _events(self) -> None:
        """Server-sent events, each named by its type, until the client goes."""
        mine = self.runtime.broker.subscribe()
        try:
            self._start(200, "text/event-stream", Cache_Control="no-cache")
            while not self.runtime._stop.is_set():
                try:
                    event = mine.get(timeout=1.0)
                    self.wfile.write(f"event: {event.get('type')}\ndata: {json.dumps(event)}\n\n".encode())
                except queue.Empty:
                    self.wfile.write(b": still here\n\n")  # a client that is gone shows here
                self.wfile.flush()
        except OSError:
            pass
        finally:
            self.runtime.broker.unsubscribe(mine)

    def do_POST(self) -> None:
        try:
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
        except ValueError:
            return self._send(422, {"detail": "the body isn't JSON"})
        if self.path == "/api/logs":
            return self._logs(body if isinstance(body, list) else [body])
        if self.path == "/api/query":
            return self._query(body)
        self._send(404, {"detail": "not found"})

    def _logs(self, rows: list) -> None:
        now = self.runtime.clock()
        wrong = [{"row": i, "problem": p} for i, row in enumerate(rows) if (p := problem(row, now))]
        if wrong:
            return self._send(422, {"detail": wrong})
        if len(rows) > self.runtime.inbox.size:
            return self._send(422, {"detail": f"at most {self.runtime.inbox.size} rows at once"})
        if not self.runtime.inbox.try_append(*rows):
            return self._send(429, {"detail": "too many rows wait"}, Retry_After=str(RETRY_SEC))
        self._send(202, {"accepted": len(rows)})

    def _query(self, body: object) -> None:
        text = body.get("q") if isinstance(body, dict) else None
        if not isinstance(text, str) or not 1 <= len(text) <= QUERY_CHARS:
            return self._send(422, {"detail": f"q must have 1 to {QUERY_CHARS} characters"})
        try:
            pieces = self.runtime.answer(text)
        except ParseError as error:
            return self._send(400, {"detail": error.pretty(), "position": error.position})
        self._start(200)
        self._write_pieces(pieces)


def http_server(runtime: Runtime, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    server = ThreadingHTTPServer((host, port), type("BoundHandler", (Handler,), {"runtime": runtime}))
    server.daemon_threads = True
    return server
