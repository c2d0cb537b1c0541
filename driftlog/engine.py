"""The engine as one object: load, find, telemetry, and the control loop over tables under one folder.

``logs`` are chunk tables in batches (``seq`` and ``pos`` among their columns), ``headers`` a row for each chunk and batch.
State tables hold the index catalog (a row for each chunk and index), tombstones, heat, predicate counts and tiers; they are
metadata. A tick turns what was asked since the last one into new state, plans, applies and publishes.
"""

from __future__ import annotations

import functools
import logging
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.config import Config
from driftlog.operators import chunks, decisions, indexes, metrics, search, tick, views
from driftlog.plans import ir
from driftlog.plans.parser import ParseError, parse
from driftlog.sources.logs import LANDING_SCHEMA, write_chunks
from driftlog.state import Table

log = logging.getLogger(__name__)

HEADERS = "chunk_id string, seq int, n_rows long, ts_min double, ts_max double, size_bytes long, services array<string>, persisted_at double, is_open boolean"
CATALOG = "index_id string, seq int, kind string, field string, op string, bytes long, usage long, last_used double, path string"
TOMBSTONES = "index_id string, seq int, kind string, field string, op string, usage long, dropped_at double"
HEAT = "seq int, temp double, last_access double"
PREDICATES = "field string, op string, value string, freq long, last_seen double"
TIERS = "seq int, tier string"
BURST = "stable int, inside boolean, fast double, slow double"
SNAPSHOT = "seq int, n long, temp double, tier string, state string, persisted_at double, last_access double, size_bytes long"
PLANNED = "action string, target string, field string, op string, kind string, priority int, plan_seq int"
EVENTS = "query long, ts double, low double, high double, field string, op string, value string, index string"
PUBLISHED = (
    "ts double, type string, action string, target string, field string, op string, kind string, tier_from string, tier_to string, reason string, state string, "
    "ratio double, write_rate double, memory_pressure double, n_chunks long, n_sealed long, n_indexed long"
)
SUMMARY = "ts double, tick long, planned long, applied long, failed long, pressure double, is_burst boolean, n_chunks long, n_indexes long, n_dropped long"


def _alone(method: Callable) -> Callable:
    """A method that changes state: one thread at a time."""

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        with self._state:
            return method(self, *args, **kwargs)

    return run


class Engine:
    """HOT chunks are persisted and read from memory by ``find``, COLD ones come from Parquet; both give the same rows.

    ``clock`` gives the present where a method isn't told it. Threads may share an engine; a folder has one at a time, and ingest
    in the same process takes it as ``engine``.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), clock: Callable[[], float] = time.time):
        self.spark, self.root, self.config, self.clock = spark, root.rstrip("/"), config, clock
        table = lambda name, schema: Table(spark, self.root, name, schema)
        self.catalog, self.tombstones, self.heat = table("catalog", CATALOG), table("tombstones", TOMBSTONES), table("heat", HEAT)
        self.predicates, self.tiers, self.burst = table("predicates", PREDICATES), table("tiers", TIERS), table("burst", BURST)
        self.moment, self.planned = table("snapshot", SNAPSHOT), table("planned", PLANNED)
        self.hot: set[int] = {r["seq"] for r in self.tiers.read().where("tier = 'hot'").collect()}  # no more than the cap and a tick's promotions
        self._frame: DataFrame | None = None
        self.query_events: list[dict] = []
        self.queries = self.ticks = 0
        self.rows_seen: tuple[float, int] | None = None
        self._rates = 0.0, 1.0
        self._lock, self._state = threading.Lock(), threading.RLock()

    # Rows

    def load(self, logs: DataFrame, bloom_fields: tuple[str, ...] = (), now: float | None = None) -> None:
        """Appends sealed chunks and their headers. Indexes of a chunk that gets more rows are forgotten; new chunks have none.

        A batch that fails half way leaves no header, and rows without one are overwritten by the next load.
        """
        number = self.next_batch()
        write_chunks(logs, f"{self.root}/logs/batch={number}", "overwrite", bloom_fields)
        self.register(number, now)

    @_alone
    def register(self, number: int, now: float | None = None, still_open: list[int] = ()) -> None:
        """Headers, sketches, state and events for a batch that is written; running it again replaces them."""
        moment = self.clock() if now is None else now
        batch = self.spark.read.parquet(f"{self.root}/logs/batch={number}").where("seq IS NOT NULL")
        is_open = F.col("seq").isin(list(still_open)) if still_open else F.lit(False)
        heads = chunks.headers(batch).withColumn("persisted_at", F.lit(float(moment))).withColumn("is_open", is_open)
        if "fields" in batch.columns:
            chunks.sketch(batch, F.col("fields")).write.mode("overwrite").parquet(f"{self.root}/sketches/batch={number}")
        heads.write.mode("overwrite").parquet(f"{self.root}/headers/batch={number}")
        mine = self.spark.read.parquet(f"{self.root}/headers/batch={number}")
        known = self.catalog.read()
        if not known.join(mine, "seq", "left_semi").isEmpty():
            self.catalog.write(known.join(mine, "seq", "left_anti"))
        room = max(self.config.max_hot_chunks - len(self.hot), 0)
        self._move([r["seq"] for r in mine.orderBy(F.desc("seq")).limit(room).select("seq").collect()], True)
        told = lambda rows, kind: rows.select(F.lit(float(moment)).alias("ts"), F.lit(kind).alias("type"), F.col("chunk_id").alias("target"))
        self._publish(told(mine, "chunk_persisted"), f"batch-{number}-1")
        self._publish(told(mine.where("NOT is_open"), "chunk_sealed"), f"batch-{number}-2")

    def _tables(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")

    def _exists(self, name: str) -> bool:
        """Whether a table holds a batch that is written whole."""
        whole = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/batch=*/_SUCCESS")
        return bool(whole.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(whole))

    @property
    def headers(self) -> DataFrame:
        """A row for each chunk, over all batches that hold rows of it; none before the first batch."""
        if not self._exists("headers"):
            return self.spark.createDataFrame([], HEADERS)
        parts = self._tables("headers").groupBy("seq").agg(
            F.sum("n_rows").alias("n_rows"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"), F.sum("size_bytes").alias("size_bytes"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("services")))).alias("services"), F.max("persisted_at").alias("persisted_at"),
            F.max_by("is_open", "batch").alias("is_open"),
        )
        return parts.select(chunks.chunk_id("seq", "ts_min").alias("chunk_id"), "*")

    @property
    def logs(self) -> DataFrame:
        """All rows: HOT chunks from memory, the others from Parquet. Before the first batch, no rows of the landing schema."""
        if not self._exists("headers"):
            return self.spark.createDataFrame([], f"pos long, {LANDING_SCHEMA}, seq int")
        stored = self._tables("logs").drop("batch")
        if not self.hot:
            return stored
        if self._frame is None:
            self._frame = stored.where(F.col("seq").isin(sorted(self.hot))).persist(StorageLevel.MEMORY_AND_DISK)
        return self._frame.unionByName(stored.where(~F.col("seq").isin(sorted(self.hot))))

    def chunk(self, seq: int) -> DataFrame:
        return self.logs.where(F.col("seq") == seq)

    def next_seq(self) -> int:
        """After a restart numbering goes on from the largest chunk."""
        return int(self._tables("headers").agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]) + 1 if self._exists("headers") else 0

    def next_batch(self) -> int:
        return int(self._tables("headers").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]) + 1 if self._exists("headers") else 0

    # Queries

    def find(self, query: str | ir.Predicate | ir.Query, time_range: tuple[float, float] | None = None, time_mode: str = "chunk", **options) -> DataFrame:
        """Rows of a text, a predicate or a query. A given time range holds for texts and predicates. What was asked is remembered until the next tick."""
        if isinstance(query, str):
            query = parse(query, **options)
            query = ir.Query(query.where, time_range or query.time_range, query.limit, query.order_by)
        elif not isinstance(query, ir.Query):
            query = ir.Query(query, time_range)
        rows, through = self._through_index(query)
        low, high = query.time_range or (None, None)
        with self._lock:
            self.queries += 1
            self.query_events += [
                {"query": self.queries, "ts": float(self.clock()), "low": low, "high": high, "field": p.field, "op": p.op, "value": repr(p.value), "index": through}
                for p in ir.leaves(query.where)
            ]
        return search.run(query, rows, self.headers if query.time_range else None, time_mode)

    def query(self, text: str, **options) -> dict:
        """The answer of a query endpoint: rows, their number, the time it took and the index used; or the error with its place."""
        start = time.perf_counter()
        try:
            rows = self.find(text, **options).collect()
        except ParseError as error:
            return {"error": error.pretty(), "position": error.position}
        used = self.query_events[-1]["index"] if self.query_events else None
        return {"rows": [r.asDict() for r in rows], "row_count": len(rows), "duration_ms": (time.perf_counter() - start) * 1000, "index": used}

    def _through_index(self, query: ir.Query) -> tuple[DataFrame, str | None]:
        """The logs, or what a sidecar leaves of them if a leaf that must hold has one, and that index. The filter runs on it all the same.

        Chunks that the catalog doesn't list under the index are scanned.
        """
        parts = query.where.parts if isinstance(query.where, ir.And) else (query.where,)
        logs, catalog = self.logs, self.catalog.read()
        built = [(r["kind"], r["field"], r["paths"]) for r in catalog.groupBy("kind", "field").agg(F.collect_set("path").alias("paths")).collect()]
        for leaf in parts:
            if isinstance(leaf, ir.Predicate) and (index := indexes.pick([indexes.make_index(kind, field) for kind, field, _ in built], leaf)):
                paths = next(p for kind, field, p in built if (kind, field) == (index.kind, index.field))
                listed = catalog.where((F.col("kind") == index.kind) & (F.col("field") == index.field)).select("seq", "path")
                sidecar = self.spark.read.parquet(*paths).withColumn("path", F.regexp_extract(F.input_file_name(), r"(sidecars/[^/]+)/", 1))
                sidecar = sidecar.join(listed.withColumn("path", F.regexp_extract("path", r"(sidecars/[^/]+)$", 1)), ["seq", "path"], "left_semi").drop("path")
                covered = listed.select("seq").distinct()
                found = index.lookup(sidecar, logs.join(covered, "seq", "left_semi"), leaf)
                return found.unionByName(logs.join(covered, "seq", "left_anti")), f"{index.kind}:{index.field}"
        return logs, None

    # Physical design

    @_alone
    def build_index(self, kind: str, field: str, seqs: list[int] | None = None, op: str | None = None, now: float | None = None) -> DataFrame:
        """Builds the sidecar of some chunks, or of all, and lists it in the catalog. Chunks that have one get it anew.

        An index idles from its birth on. One that is built again keeps the uses that it had.
        """
        logs = self.logs if seqs is None else self.logs.where(F.col("seq").isin(seqs))
        path = f"{self.root}/sidecars/{kind}-{field.replace('/', '_')}-{uuid.uuid4().hex}"
        index = indexes.make_index(kind, field)
        index.build(logs).write.parquet(path)
        sidecar = self.spark.read.parquet(path)
        asked = self.headers.select("seq") if seqs is None else self.headers.where(F.col("seq").isin(seqs)).select("seq")
        size = index.memory_bytes(sidecar)
        fresh = asked.join(size, "seq", "left").select(
            indexes.index_id(F.col("seq"), kind, field).alias("index_id"), "seq", F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.lit(op).cast("string").alias("op"),
            F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.lit(0).cast("long").alias("usage"), F.lit(float(self.clock() if now is None else now)).alias("last_used"), F.lit(path).alias("path"),
        )
        before, known = self.tombstones.read(), self.catalog.read()
        again = before.select("index_id", "usage").unionByName(known.select("index_id", "usage")).groupBy("index_id").agg(F.max("usage").alias("prior"))
        fresh = fresh.join(again, "index_id", "left").withColumn("usage", F.coalesce("prior", "usage")).drop("prior")
        self.catalog.write(known.join(fresh.select("index_id"), "index_id", "left_anti").unionByName(fresh))
        self.tombstones.write(before.join(self.catalog.read().select("index_id"), "index_id", "left_anti"))
        return sidecar

    @_alone
    def drop_index(self, kind: str, field: str, seqs: list[int] | None = None, now: float | None = None) -> None:
        """Takes indexes from the catalog and leaves tombstones with their uses."""
        moment, known = self.clock() if now is None else now, self.catalog.read()
        mine = (F.col("kind") == kind) & (F.col("field") == field)
        if seqs is not None:
            mine &= F.col("seq").isin(seqs)
        gone = known.where(mine).select("index_id", "seq", "kind", "field", F.coalesce("op", F.lit(ir.EQ)).alias("op"), "usage", F.lit(float(moment)).alias("dropped_at"))
        before = self.tombstones.read().join(gone.select("index_id"), "index_id", "left_anti")
        self.tombstones.write(before.unionByName(gone))
        self.catalog.write(known.where(~mine))

    @_alone
    def _move(self, seqs: list[int], hot: bool) -> None:
        after = self.hot | set(seqs) if hot else self.hot - set(seqs)
        if self._frame is not None:
            self._frame.unpersist()
            self._frame = None
        if after != self.hot:
            self.hot = after
            self.tiers.write(self.spark.createDataFrame([(s, "hot") for s in sorted(after)], TIERS))

    def promote(self, seq: int) -> None:
        self._move([seq], True)

    def demote(self, seq: int) -> None:
        self._move([seq], False)

    # The control loop

    def pressure(self) -> float:
        """Bytes of HOT chunks and of indexes, as a share of the budget, 1 at most."""
        rows = self.headers.where(F.col("seq").isin(sorted(self.hot))).agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0] if self.hot else 0
        held = self.catalog.read().agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        return min(1.0, (rows + held) / self.config.max_memory_bytes)

    @_alone
    def absorb(self, now: float) -> None:
        """Takes what was asked since the last tick into heat, predicate counts and index usage, cools all chunks, and lets counts decay."""
        with self._lock:
            asked, self.query_events = self.query_events, []
        events = self.spark.createDataFrame([tuple(e[k] for k in ("query", "ts", "low", "high", "field", "op", "value", "index")) for e in asked], EVENTS)
        # Queries of the same range and index are one row, so that chunks meet ranges and not queries.
        queries = events.groupBy("low", "high", "index").agg(F.count_distinct("query").alias("asked"), F.max("ts").alias("ts"))
        heads = self.headers.select("seq", "ts_min", "ts_max")
        touched = heads.join(F.broadcast(queries), F.col("low").isNull() | ((F.col("ts_max") >= F.col("low")) & (F.col("ts_min") <= F.col("high"))))
        reached = touched.groupBy("seq").agg(F.sum("asked").alias("times"), F.max("ts").alias("seen"))
        cool = 1 - self.config.ema_alpha_chunk_temp
        kept = F.pow(F.lit(cool), F.coalesce("times", F.lit(0)))
        heated = F.when(F.col("temp").isNull(), F.when(F.col("times") > 0, 1.0).otherwise(0.0)).otherwise(1 - (1 - F.col("temp")) * kept)
        heat = heads.select("seq").join(self.heat.read(), "seq", "left").join(reached, "seq", "left")
        self.heat.write(heat.select("seq", (heated * cool).alias("temp"), F.coalesce("seen", "last_access").alias("last_access")))

        fresh = events.groupBy("field", "op", "value").agg(F.count(F.lit(1)).alias("freq"), F.max("ts").alias("last_seen"))
        counts = self.predicates.read().unionByName(fresh).groupBy("field", "op", "value").agg(F.sum("freq").cast("long").alias("freq"), F.max("last_seen").alias("last_seen"))
        used = touched.where("index IS NOT NULL").groupBy(F.concat_ws(":", F.col("seq").cast("string"), "index").alias("index_id")).agg(F.sum("asked").alias("times"), F.max("ts").alias("seen"))
        listed = self.catalog.read().join(used, "index_id", "left").withColumn("usage", F.col("usage") + F.coalesce("times", F.lit(0))).withColumn("last_used", F.coalesce("seen", "last_used"))
        if self.config.decay_every_n_ticks > 0 and self.ticks % self.config.decay_every_n_ticks == 0:
            counts = metrics.decay(counts, "freq", self.config.decay_factor)
            listed = listed.withColumn("usage", F.floor(F.col("usage") * self.config.decay_factor).cast("long"))
        self.predicates.write(counts)
        self.catalog.write(listed)

    @_alone
    def step_burst(self, now: float) -> tuple[bool, float, float]:
        """One sample of the write rate into the two averages and the hysteresis: in burst, the ratio, the rate. Entering and leaving are published."""
        total = int(self._tables("headers").agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]) if self._exists("headers") else 0
        before, self.rows_seen = self.rows_seen, (now, total)
        rate = (total - before[1]) / max(now - before[0], 1e-9) if before else 0.0
        old = self.burst.read().first()
        stable, inside, fast, slow = tuple(old) if old else (0, False, rate, rate)
        fast, slow = 0.5 * rate + 0.5 * fast, 0.05 * rate + 0.95 * slow
        ratio = fast / slow if slow > 0 else 1.0
        was = inside
        if not inside:
            stable = min(stable + 1, self.config.burst_stability_n) if ratio > self.config.burst_enter else max(stable - 1, 0)
            inside = stable >= self.config.burst_stability_n
        elif ratio < self.config.burst_exit:
            stable, inside = 0, False
        self.burst.write(self.spark.createDataFrame([(stable, inside, float(fast), float(slow))], BURST))
        if inside != was:
            self._publish(self.spark.createDataFrame([(float(now), "burst", "enter" if inside else "exit", float(ratio))], "ts double, type string, state string, ratio double"))
        return inside, ratio, rate

    def snapshot(self, now: float, is_burst: bool = False) -> tick.Snapshot:
        """All metrics at one moment, from the tables."""
        heads = self.headers
        tier = F.when(F.col("seq").isin(sorted(self.hot)), "hot").otherwise("cold") if self.hot else F.lit("cold")
        table = heads.join(self.heat.read(), "seq", "left").select(
            "seq", F.col("n_rows").alias("n"), F.coalesce("temp", F.lit(0.0)).alias("temp"), tier.alias("tier"), F.when(F.col("is_open"), "open").otherwise("persisted").alias("state"), "persisted_at", "last_access", "size_bytes"
        )
        sketches = None
        if self._exists("sketches"):  # which chunks hold which key; the fixed fields are in all
            fixed = heads.select("seq", F.explode(F.array(*[F.lit(f) for f in chunks.TOP_LEVEL])).alias("field"))
            sketches = self._tables("sketches").select("seq", "field").distinct().unionByName(fixed)
        return tick.Snapshot(now, table, self.predicates.read(), self.catalog.read(), self.tombstones.read(), self.pressure(), is_burst, sketches)

    @_alone
    def tick(self, snapshot: tick.Snapshot | float | None = None) -> DataFrame:
        """One turn: absorb, burst step, static indexes, plan within the budget, apply, expire, publish. Returns the events of this turn's actions.

        Given a snapshot, only plans, applies and publishes. An action that fails is logged, published by none and doesn't stop the others.
        """
        given = isinstance(snapshot, tick.Snapshot)
        now = snapshot.now if given else (self.clock() if snapshot is None else float(snapshot))
        ratio = rate = 0.0
        if not given:
            self.ticks += 1
            for table in (self.catalog, self.tombstones, self.heat, self.predicates, self.tiers, self.burst, self.moment, self.planned):
                table.prune()
            self.absorb(now)
            is_burst, ratio, rate = self.step_burst(now)
            snapshot = self.snapshot(now, is_burst)
            self.moment.write(snapshot.chunks)  # each rule reads the chunks, so they are put together once
            snapshot = replace(snapshot, chunks=self.moment.read())
        if self.config.static_indexes:
            self._build_static(snapshot)
        planned = tick.plan(snapshot, self.config)
        n_planned = 0
        if not given:
            self.planned.write(planned)
            planned = self.planned.read()
            n_planned = planned.count()
        todo = decisions.budget(planned, self.config).collect()
        reasons = {r["index_id"]: r["reason"] for r in tick.drop_reasons(snapshot.indexes.where(F.col("index_id").isin([a["target"] for a in todo])), now, self.config).collect()}
        done = []
        for action in todo:  # no more than the budget
            try:
                self._apply(action, now)
                done.append((*(action[k] for k in ("action", "target", "field", "op", "kind")), reasons.get(action["target"]) if action["action"] == "drop" else None))
            except Exception:
                log.exception("action failed: %s", action)
        self.tombstones.write(self.tombstones.read().join(decisions.expired(self.tombstones.read(), now, self.config).select("index_id"), "index_id", "left_anti"))
        applied = self.spark.createDataFrame(done, "action string, target string, field string, op string, kind string, reason string")
        events = tick.events_of(applied, now).join(applied.select("action", "target", "reason").dropDuplicates(["target"]).drop("action"), "target", "left")
        self._publish(events)
        if not given:
            table = snapshot.chunks
            self._rates = rate, ratio
            self.publish_metrics(now, snapshot)
            counts = table.count(), self.catalog.read().count(), self.tombstones.read().count()
            row = (now, self.ticks, n_planned, len(done), len(todo) - len(done), float(snapshot.pressure), snapshot.is_burst, *counts)
            self.spark.createDataFrame([row], SUMMARY).write.mode("append").parquet(f"{self.root}/tick_summaries")
        return self.spark.createDataFrame(events.collect(), events.schema)

    def publish_metrics(self, now: float, snapshot: tick.Snapshot | None = None) -> None:
        """A ``metric_tick`` event, with the write rate and burst ratio of the last tick."""
        snapshot = snapshot or self.snapshot(now)
        self._publish(views.metric_tick(snapshot.chunks, self.catalog.read(), now, *self._rates, snapshot.pressure))

    def _build_static(self, snapshot: tick.Snapshot) -> None:
        """Missing static indexes, all chunks of one index together; outside the budget and without an event."""
        missing = tick.static_builds(snapshot, self.config)
        for r in missing.groupBy("kind", "field").agg(F.collect_list("seq").alias("seqs")).collect():  # hot chunks, so no more than the cap
            self.build_index(r["kind"], r["field"], sorted(r["seqs"]), now=snapshot.now)

    def _apply(self, action, now: float) -> None:
        kind, target = action["action"], action["target"]
        if kind in ("promote", "demote"):
            self._move([int(target)], kind == "promote")
            return
        seq, index, field = target.split(":", 2)
        if kind in ("build", "restore"):
            self.build_index(index, field, [int(seq)], action["op"], now)
        else:  # drop and evict: the catalog forgets the index, a tombstone keeps the way back
            self.drop_index(index, field, [int(seq)], now)

    def run(self, stop: threading.Event, interval: float | None = None) -> None:
        """Ticks until ``stop`` is set, with metrics in between; what fails is logged and the loop goes on."""
        wait = self.config.tick_interval_sec if interval is None else interval
        while not stop.is_set():
            try:
                self.tick()
            except Exception:
                log.exception("tick failed")
            until = time.monotonic() + wait
            while (left := until - time.monotonic()) > 0 and not stop.wait(min(left, self.config.metric_tick_interval_sec)):
                if until - time.monotonic() > 0:
                    try:
                        self.publish_metrics(self.clock())
                    except Exception:
                        log.exception("metrics failed")

    # What others see

    def _publish(self, events: DataFrame, name: str | None = None) -> None:
        """Events under a name; what is published under the same name again replaces it."""
        shape = self.spark.createDataFrame([], PUBLISHED).schema
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in shape]
        events.select(*columns).write.mode("overwrite").parquet(f"{self.root}/engine_events/at={name or uuid.uuid4().hex}")

    @property
    def events(self) -> DataFrame:
        return self.spark.read.schema(f"{PUBLISHED}, at string").option("basePath", f"{self.root}/engine_events").parquet(f"{self.root}/engine_events").drop("at")

    def hottest(self, n: int) -> DataFrame:
        return self.heat.read().orderBy(F.desc("temp"), "seq").limit(n)

    def cold(self, since: float) -> DataFrame:
        """Chunks that weren't touched since a moment."""
        return self.headers.select("seq").join(self.heat.read(), "seq", "left").where(F.col("last_access").isNull() | (F.col("last_access") < since))

    @_alone
    def forget_heat(self, seqs: list[int]) -> None:
        """Takes chunks out of the heat table; they come back cold with the next tick."""
        self.heat.write(self.heat.read().where(~F.col("seq").isin(seqs)))

    def top_predicates(self, k: int = Config.topk_k) -> DataFrame:
        return metrics.top_predicates(self.predicates.read(), k)

    def health(self) -> dict:
        return {"status": "ok", "chunks": self.headers.count(), "ticks": self.ticks, "pending_queries": len(self.query_events)}
