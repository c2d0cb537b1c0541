"""What the admin endpoints and the dashboard show, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def engine_state(chunks: DataFrame, indexes: DataFrame) -> DataFrame:
    """Counts of chunks: all, sealed or persisted, indexed."""
    indexed = chunks.join(indexes.select("seq").distinct(), "seq", "left_semi").agg(F.count(F.lit(1)).alias("n_indexed"))
    counted = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("state").isin("sealed", "persisted")).alias("n_sealed"))
    return counted.join(F.broadcast(indexed), how="cross")


def metric_tick(chunks: DataFrame, indexes: DataFrame, now: float, write_rate: float, burst_ratio: float, pressure: float) -> DataFrame:
    """A row for the ``metric_tick`` event; sealed counts here leave persisted ones out."""
    base = engine_state(chunks, indexes).drop("n_sealed").join(chunks.agg(F.count_if(F.col("state") == "sealed").alias("n_sealed")), how="cross")
    fixed = [F.lit(float(v)).alias(k) for k, v in (("ts", now), ("write_rate", write_rate), ("burst_ratio", burst_ratio), ("memory_pressure", pressure))]
    return base.select(F.lit("metric_tick").alias("type"), *fixed, "n_chunks", "n_sealed", "n_indexed")


def chunk_list(headers: DataFrame, heat: DataFrame) -> DataFrame:
    return headers.join(heat.select("seq", "temp"), "seq", "left").withColumn("temp", F.coalesce("temp", F.lit(0.0)))


def index_list(active: DataFrame, dropped: DataFrame) -> DataFrame:
    return active.withColumn("status", F.lit("active")).unionByName(dropped.withColumn("status", F.lit("dropped")), allowMissingColumns=True)


def index_histogram(indexes: DataFrame) -> DataFrame:
    return indexes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").cast("long").alias("bytes"))


def tier_state_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("tier", "state").agg(F.count(F.lit(1)).alias("n"))


def chunk_order(chunks: DataFrame) -> DataFrame:
    """Chunks with their place: open before sealed before persisted, newest first."""
    state = F.when(F.col("state") == "open", 0).when(F.col("state") == "sealed", 1).otherwise(2)
    return chunks.withColumn("place", F.row_number().over(Window.orderBy(state, F.desc("ts_min"), "seq")))


def sorted_nulls_last(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    key = F.col(column)
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last())


def recent(events: DataFrame, n: int = 200, order: str = "ts", tie: str = "pos") -> DataFrame:
    return events.orderBy(F.desc(order), F.desc(tie)).limit(n)


def series_tail(samples: DataFrame, key: str, order: str, n: int = 150) -> DataFrame:
    """The last samples of each series."""
    return samples.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def predicate_labels(top: DataFrame, width: int = 20) -> DataFrame:
    value = F.col("value").cast("string")
    return top.withColumn("label", F.concat(F.col("field"), F.col("op"), F.when(F.length(value) > width, F.concat(F.left(value, F.lit(width)), F.lit("…"))).otherwise(value)))


def pressure_bucket(pressure: str = "pressure") -> Column:
    return F.when(F.col(pressure) < 0.7, "normal").when(F.col(pressure) < 0.9, "elevated").otherwise("critical")


def heat_bucket(temp: str = "temp") -> Column:
    return F.when(F.col(temp) < 0.05, "cold").otherwise("warm")
