"""Chunks: assignment, sealing, headers, schema sketches and pruning by header."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.config import Config
from driftlog.plans import ir
from driftlog.session import ship_package

ROW_OVERHEAD = 32
TOP_LEVEL = ("ts", "service", "level", "msg")


def row_size(*strings: str) -> Column:
    """Bytes of a row: its strings, and a fixed part."""
    return sum((F.coalesce(F.octet_length(s), F.lit(0)) for s in strings), F.lit(ROW_OVERHEAD)).cast("long")


def chunk_id(seq: str, ts_min: str) -> Column:
    return F.format_string("chunk_%06d_%d", F.col(seq).cast("long"), F.floor(F.col(ts_min) * 1000).cast("long"))


def assign_by_count(logs: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Sealing by count alone, from the position of a row: no shuffle and no state."""
    return logs.withColumn("seq", F.expr(f"CAST({pos} DIV {size} AS INT)"))


def seal_greedily(logs: DataFrame, lane: str, config: Config, size: str = "bytes", start: dict | None = None) -> DataFrame:
    """Sealing by count, bytes or age, whichever comes first, in order of pos within each lane.

    The rule is sequential: a row that fills the open chunk is its last. Lanes are independent, so a table is
    dealt over as many lanes as it should have writers. A lane is streamed in sorted order, not collected. ``start`` has, for lanes with an
    open chunk, its number, rows, bytes and first ts; those lanes go on with it.
    """
    start = start or {}
    ship_package(logs.sparkSession)
    shape = f"{logs.schema[lane].name} {logs.schema[lane].dataType.simpleString()}, pos long, lane_seq int"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seq, count, total, first = object(), 0, 0, 0, 0.0
        for batch in batches:
            out = []
            for name, ts, weight in zip(batch[lane], batch["ts"], batch[size]):
                if name != now:
                    now = name
                    seq, count, total, first = start.get(name, (0, 0, 0, 0.0))
                if count == 0:
                    total, first = 0, ts
                count, total = count + 1, total + weight
                out.append(seq)
                if count >= config.chunk_max_entries or total >= config.chunk_max_bytes or ts - first >= config.chunk_max_seconds:
                    seq, count = seq + 1, 0
            yield pd.DataFrame({lane: batch[lane], "pos": batch["pos"], "lane_seq": out})

    return logs.select(lane, "pos", "ts", size).repartition(lane).sortWithinPartitions(lane, "pos").mapInPandas(fold, shape)


def headers(logs: DataFrame) -> DataFrame:
    """A row for each chunk: ids, true time bounds, rows, bytes and services; summed before the shuffle."""
    out = logs.groupBy("seq").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
        F.sum(row_size("service", "level", "msg")).alias("size_bytes"),
        F.array_sort(F.collect_set("service")).alias("services"),
    )
    return out.select(chunk_id("seq", "ts_min").alias("chunk_id"), "*")


def sketch(logs: DataFrame, open_map: Column) -> DataFrame:
    """``seq, field, types``: the set of types that each key of the open map has in a chunk."""
    entries = _entries(logs, open_map)
    return entries.groupBy("seq", "field").agg(F.concat_ws(",", F.array_sort(F.collect_set("type"))).alias("types"))


def _entries(logs: DataFrame, open_map: Column) -> DataFrame:
    keyed = logs.select("seq", F.to_json(open_map).alias("_j"), open_map.alias("_v"))
    keys = keyed.select("seq", "_v", F.explode(F.json_object_keys("_j")).alias("field"))
    value = F.expr("try_variant_get(_v, concat('$[\"', field, '\"]'), 'variant')")
    return keys.select("seq", "field", F.schema_of_variant(value).alias("type"))


def overlaps(time_range: tuple[float, float]) -> Column:
    """Chunks whose time bounds touch the range."""
    low, high = time_range
    return (F.col("ts_max") >= F.lit(float(low))) & (F.col("ts_min") <= F.lit(float(high)))


def may_hold(expr, has_key) -> Column:
    """Whether a sealed chunk can hold a match by its sketch; ``has_key(field)`` says if a key is there.

    EXISTS and fields of the open map need their key, NOT keeps everything.
    """
    if isinstance(expr, ir.Predicate):
        return F.lit(True) if expr.field in TOP_LEVEL else has_key(expr.field)
    if isinstance(expr, ir.Not):
        return F.lit(True)
    parts = [may_hold(p, has_key) for p in expr.parts]
    out = parts[0]
    for part in parts[1:]:
        out = (out & part) if isinstance(expr, ir.And) else (out | part)
    return out
