"""Ingest by Structured Streaming: landing files to validated rows, chunks and headers, exactly once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlog.config import Config
from driftlog.engine import PUBLISHED, Engine
from driftlog.operators.chunks import row_size, seal_greedily
from driftlog.sources.logs import valid, write_chunks

#: Positions of a batch begin at its number times this.
BATCH_SPAN = 1 << 40


def _sink(root: str, now: float | Callable[[], float], config: Config = Config(), lanes: int = 1, engine: Engine | None = None):
    """Writes a batch under its own number, as chunks that ``Engine`` reads: a batch that is run again replaces what it wrote before."""
    given = engine

    def write(batch: DataFrame, number: int) -> None:
        moment = now() if callable(now) else now
        held = batch.persist()
        try:
            held.where(~valid(moment)).write.mode("overwrite").parquet(f"{root}/quarantine/batch={number}")
            engine = given or Engine(batch.sparkSession, root, config, clock=lambda: moment)
            good = held.where(valid(moment))
            if good.isEmpty():
                return
            start = _open_chunks(engine, number, config, lanes)
            strings = [c for c in ("service", "level", "msg") if c in good.columns]
            text = F.concat_ws("\x1f", *strings)
            laned = good.withColumn("lane", F.pmod(F.xxhash64(text, "ts"), F.lit(lanes)).cast("int")).withColumn("bytes", row_size(*strings))
            place = F.row_number().over(Window.partitionBy("lane").orderBy("ts", text))
            laned = laned.withColumn("pos", F.lit(number * BATCH_SPAN).cast("long") + (place - 1) * lanes + F.col("lane"))
            sealed = seal_greedily(laned, "lane", config, start=start)
            # Chunks of a lane are numbered lane, lane + lanes, lane + 2 lanes, so that lanes need not agree.
            whole = laned.join(sealed, ["lane", "pos"]).withColumn("seq", (F.col("lane_seq") * lanes + F.col("lane")).cast("int")).drop("lane", "bytes", "lane_seq")
            write_chunks(whole, f"{root}/logs/batch={number}", "overwrite")
            engine.register(number, moment, _still_open(engine, number, config, lanes))
        finally:
            held.unpersist()

    return write


def _last_chunks(engine: Engine, upto: int, lanes: int) -> list:
    """Of each lane the last chunk in the batches before ``upto``: its rows, bytes and least ts."""
    if not engine._exists("headers"):
        return []
    heads = engine._tables("headers").where(F.col("batch") < upto).groupBy("seq").agg(F.sum("n_rows").alias("n"), F.sum("size_bytes").alias("bytes"), F.min("ts_min").alias("first"), F.max("ts_max").alias("last"))
    return heads.groupBy(F.pmod("seq", F.lit(lanes)).alias("lane")).agg(F.max_by(F.struct("seq", "n", "bytes", "first", "last"), "seq").alias("c")).select("lane", "c.*").collect()


def _full(chunk, config: Config) -> bool:
    return chunk["n"] >= config.chunk_max_entries or chunk["bytes"] >= config.chunk_max_bytes or chunk["last"] - chunk["first"] >= config.chunk_max_seconds


def _open_chunks(engine: Engine, number: int, config: Config, lanes: int) -> dict:
    """Where each lane goes on: in its open chunk, or with the next one. No more rows than lanes."""
    found = {}
    for c in _last_chunks(engine, number, lanes):
        k = c["seq"] // lanes
        found[c["lane"]] = (k + 1, 0, 0, 0.0) if _full(c, config) else (k, c["n"], c["bytes"], c["first"])
    return found


def _still_open(engine: Engine, number: int, config: Config, lanes: int) -> list[int]:
    """Chunks of the batch that the next one goes on with."""
    mine = engine.spark.read.parquet(f"{engine.root}/logs/batch={number}")
    last = {c["lane"]: c for c in _last_chunks(engine, number, lanes)}
    ends = mine.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.sum(row_size("service", "level", "msg")).alias("bytes"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    ends = ends.groupBy(F.pmod("seq", F.lit(lanes)).alias("lane")).agg(F.max_by(F.struct("seq", "n", "bytes", "first", "last"), "seq").alias("c")).select("lane", "c.*").collect()
    out = []
    for c in ends:
        whole, before = c.asDict(), last.get(c["lane"])
        if before is not None and before["seq"] == c["seq"]:
            whole |= {"n": c["n"] + before["n"], "bytes": c["bytes"] + before["bytes"], "first": min(c["first"], before["first"]), "last": max(c["last"], before["last"])}
        if not _full(whole, config):
            out.append(c["seq"])
    return out


def ingest(
    source: DataFrame, root: str, now: float | Callable[[], float] = time.time, available_now: bool = True, interval: float = Config.tick_interval_sec,
    config: Config = Config(), lanes: int = 1, engine: Engine | None = None,
):
    """Starts the stream. The checkpoint and the batch numbers take the place of a write-ahead log: rows that
    were taken in are neither lost nor doubled by a restart. ``now`` is asked for each batch; ``lanes`` are writers that seal on their own.
    An engine over the same folder in this process must be given, so that it learns of chunks that get more rows."""
    writer = source.writeStream.foreachBatch(_sink(root, now, config, lanes, engine)).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{interval} seconds")).start()


def stop(query) -> None:
    """Graceful stop: what has arrived is taken in first."""
    query.processAllAvailable()
    query.stop()


def stored(spark: SparkSession, root: str, table: str = "logs") -> DataFrame:
    return spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}/batch=*")


def event_stream(spark: SparkSession, root: str) -> DataFrame:
    """The engine's events as a stream, for subscribers."""
    return spark.readStream.schema(f"{PUBLISHED}, at string").option("basePath", f"{root}/engine_events").parquet(f"{root}/engine_events/at=*").drop("at")


def windowed_rates(rows: DataFrame, window: float = Config.write_window_sec, slide: float = 1.0, late: str = "1 minute") -> DataFrame:
    """Streaming counts of a sliding window by service; rows later than the watermark are left out."""
    timed = rows.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("event_time", late)
    return (
        timed.groupBy(F.window("event_time", f"{int(window)} seconds", f"{int(slide)} seconds"), "service")
        .agg(F.count(F.lit(1)).alias("n")).select("service", F.col("window.end").alias("until"), (F.col("n") / window).alias("rate"))
    )
