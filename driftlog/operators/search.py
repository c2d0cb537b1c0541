"""Running a query: prune chunks by header, filter rows, order, limit, page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlog.functions.compile import Resolver, compile_expr, sort_key
from driftlog.operators.chunks import may_hold, overlaps
from driftlog.plans import ir
from driftlog.plans.parser import parse


def prune(logs: DataFrame, chunk_headers: DataFrame, time_range: tuple[float, float]) -> DataFrame:
    """Rows of the chunks that touch the range. A semi join on the partition column of a chunk table is
    turned into partition pruning; headers are as many as chunks, so they aren't collected."""
    return logs.join(chunk_headers.where(overlaps(time_range)).select("seq"), "seq", "left_semi")


def prune_by_sketch(logs: DataFrame, sketches: DataFrame, expr) -> DataFrame:
    """Rows of the chunks whose sketch admits the expression."""
    keys = sketches.groupBy("seq").agg(F.collect_set("field").alias("_keys"))
    chunks = logs.select("seq").distinct().join(keys, "seq", "left")
    admits = may_hold(expr, lambda field: F.coalesce(F.array_contains("_keys", field), F.lit(False)))
    return logs.join(chunks.where(admits).select("seq"), "seq", "left_semi")


def run(query: ir.Query, logs: DataFrame, chunk_headers: DataFrame | None = None, time_mode: str = "chunk") -> DataFrame:
    """Rows of the query, whole.

    ``time_mode='chunk'`` keeps all matching rows of the chunks that touch the time range; ``'row'`` also holds each row
    against it. Ties, and rows without an order, come by position; a sort on one key and a limit become one
    bounded top-n.
    """
    resolve = Resolver(logs)
    rows = logs
    if query.time_range:
        if chunk_headers is not None:
            rows = prune(rows, chunk_headers, query.time_range)
        if time_mode == "row" or chunk_headers is None:
            low, high = query.time_range
            rows = rows.where(F.col("ts").between(F.lit(float(low)), F.lit(float(high))))
    rows = rows.where(compile_expr(query.where, resolve))
    if query.order_by:
        key = sort_key(query.order_by.field, resolve)
        rows = rows.orderBy(key.desc_nulls_last() if query.order_by.descending else key.asc_nulls_first(), "pos")
    elif query.limit is not None:
        rows = rows.orderBy("pos")
    return rows if query.limit is None else rows.limit(query.limit)


def find(text: str, logs: DataFrame, chunk_headers: DataFrame | None = None, time_mode: str = "chunk", **options) -> DataFrame:
    return run(parse(text, **options), logs, chunk_headers, time_mode)


def page(rows: DataFrame, number: int, size: int, key: str = "pos") -> DataFrame:
    """A page of the rows in order of the key: the bounded top is sorted, not the table."""
    return rows.orderBy(key).limit((number + 1) * size).withColumn("_n", F.row_number().over(Window.orderBy(key))).where(F.col("_n") > number * size).drop("_n")
