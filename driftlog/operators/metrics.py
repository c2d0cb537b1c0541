"""Metrics of the workload: moving averages, sliding counts, bursts, heat, heavy hitters.

Order-dependent folds are split into blocks of rows that fold to a few numbers each, so no key's history is
gathered in one place.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlog.config import Config
from driftlog.session import ship_package

BLOCK = 4096


def ema(rows: DataFrame, lane: list[str], order: str, x: str, alpha: float, block: int = BLOCK) -> DataFrame:
    """``lane..., ema``: the average after the last sample; the first sample is taken as it is.

    ``order`` is a dense whole number within the lane, from 0. A block of samples is the map v -> keep * v + add; blocks are few per
    lane and are folded in order.
    """
    blocked = rows.select(*lane, F.col(order).alias("_o"), F.col(x).cast("double").alias("_x"), F.expr(f"{order} DIV {block}").alias("_b"))
    last = blocked.groupBy(*lane, "_b").agg(F.max("_o").alias("_last"), F.count(F.lit(1)).alias("_n"))
    weight = F.pow(F.lit(1 - alpha), F.col("_last") - F.col("_o")) * F.when(F.col("_o") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    maps = blocked.join(last, [*lane, "_b"]).groupBy(*lane, "_b").agg(F.sum(weight * F.col("_x")).alias("add"), F.first("_n").alias("n"))
    maps = maps.withColumn("keep", F.pow(F.lit(1 - alpha), "n"))
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("_b", "keep", "add"))), F.lit(0.0), lambda v, m: m["keep"] * v + m["add"])
    return maps.groupBy(*lane).agg(folded.alias("ema"))


def numbered(rows: DataFrame, lane: list[str], by: list) -> DataFrame:
    """Rows with their number ``_i`` within the lane."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*lane).orderBy(*by)) - 1)


def bucket(ts: str, width: float) -> Column:
    return F.floor(F.col(ts) / width) * F.lit(width)


def sliding_count(rows: DataFrame, lane: str, window: float, buckets: int = 60, ts: str = "ts") -> DataFrame:
    """``lane, bucket, n``: rows in the window that ends with each bucket; both ends belong to it."""
    width = window / buckets
    counted = rows.groupBy(lane, bucket(ts, width).alias("bucket")).agg(F.count(F.lit(1)).alias("_n"))
    frame = Window.partitionBy(lane).orderBy("bucket").rangeBetween(-int(window) if float(window).is_integer() else -window, 0)
    return counted.select(lane, "bucket", F.sum("_n").over(frame).alias("n"))


def write_rate(rows: DataFrame, lane: str, window: float, now: float, ts: str = "ts") -> DataFrame:
    """``lane, rate``: rows a second over the window before now; 0 for lanes that were idle."""
    return rows.groupBy(lane).agg((F.count_if((F.col(ts) >= now - window) & (F.col(ts) <= now)) / window).alias("rate"))


def burst_ratio(rates: DataFrame, lane: str, order: str, rate: str) -> DataFrame:
    """``lane, ratio``: the fast average over the slow one; 1 while the slow one is 0."""
    fast = ema(rates, [lane], order, rate, 0.5).withColumnRenamed("ema", "fast")
    slow = ema(rates, [lane], order, rate, 0.05).withColumnRenamed("ema", "slow")
    return fast.join(slow, lane).select(lane, F.when(F.col("slow") > 0, F.col("fast") / F.col("slow")).otherwise(1.0).alias("ratio"))


def heat(accesses: DataFrame, ticks: list[float], alpha: float = Config.ema_alpha_chunk_temp, key: str = "seq", ts: str = "ts") -> DataFrame:
    """``key, temp, last_access``: an access heats with 1, each tick cools all chunks with 0; an access comes before a tick at the same time."""
    times = accesses.sparkSession.createDataFrame([(float(t),) for t in ticks], "_t double")
    hot = accesses.select(key, F.col(ts).alias("_t"), F.lit(1.0).alias("_x"))
    cool = accesses.select(key).distinct().join(F.broadcast(times)).select(key, "_t", F.lit(0.0).alias("_x"))
    rows = numbered(hot.unionByName(cool), [key], ["_t", F.desc("_x")])
    last = accesses.groupBy(key).agg(F.max(ts).alias("last_access"))
    return ema(rows, [key], "_i", "_x", alpha).withColumnRenamed("ema", "temp").join(last, key)


def predicate_stats(events: DataFrame) -> DataFrame:
    """``field, op, value, freq, last_seen`` over exact predicates."""
    return events.groupBy("field", "op", "value").agg(F.count(F.lit(1)).alias("freq"), F.max_by("ts", "pos").alias("last_seen"))


def top_predicates(stats: DataFrame, k: int) -> DataFrame:
    return stats.orderBy(F.desc("freq"), "field", "op", "value").limit(k)


def index_usage(events: DataFrame) -> DataFrame:
    """``index_id, usage, last_used`` from the indexes that each query used."""
    used = events.select(F.explode("indexes_used").alias("index_id"), "ts")
    return used.groupBy("index_id").agg(F.count(F.lit(1)).alias("usage"), F.max("ts").alias("last_used"))


def decay(stats: DataFrame, count: str, factor: float = Config.decay_factor) -> DataFrame:
    """Counts times the factor, cut to whole numbers; what falls to 0 goes."""
    return stats.withColumn(count, F.floor(F.col(count) * factor).cast("long")).where(F.col(count) > 0)


def saturating(steps: DataFrame, lane: str, order: str, up: str, limit: int) -> DataFrame:
    """``lane, level, stable``: a counter that goes up or down by 1 within [0, limit]; stable at the limit.

    A step maps x to min(hi, max(lo, x + add)), and such maps compose, so blocks fold on their own.
    """
    delta = F.when(F.col(up), 1).otherwise(-1)
    blocked = steps.select(lane, F.col(order).alias("_o"), delta.alias("_d"), F.expr(f"{order} DIV {BLOCK}").alias("_b"))
    ordered = lambda items: F.array_sort(F.collect_list(items))
    start = F.struct(F.lit(0).alias("add"), F.lit(0).alias("lo"), F.lit(limit).alias("hi"))
    clamp = lambda v: F.least(F.lit(limit), F.greatest(F.lit(0), v))

    def then(m: Column, s: Column) -> Column:
        return F.struct((m["add"] + s["_d"]).alias("add"), clamp(m["lo"] + s["_d"]).alias("lo"), clamp(m["hi"] + s["_d"]).alias("hi"))

    maps = blocked.groupBy(lane, "_b").agg(F.aggregate(ordered(F.struct("_o", "_d")), start, then).alias("m"))
    level = F.aggregate(ordered(F.struct("_b", "m")), F.lit(0), lambda x, b: F.least(b["m"]["hi"], F.greatest(b["m"]["lo"], x + b["m"]["add"])))
    return maps.groupBy(lane).agg(level.alias("level")).withColumn("stable", F.col("level") >= limit)


def hysteresis(ratios: DataFrame, lane: str, order: str, ratio: str, config: Config = Config()) -> DataFrame:
    """``lane, state``: burst mode by a state of 0 to n (outside, with the counter) or -1 (inside).

    A sample is one of three letters (above the entry, below the exit, between), so a block is a table from each
    state to the next; tables compose in order.
    """
    n = config.burst_stability_n
    letter = F.when(F.col(ratio) > config.burst_enter, 2).when(F.col(ratio) < config.burst_exit, 0).otherwise(1)
    blocked = ratios.select(lane, F.col(order).alias("_o"), letter.alias("_l"), F.expr(f"{order} DIV {BLOCK}").alias("_b"))

    def step(state: Column, symbol: Column) -> Column:
        inside = F.when(symbol == 0, 0).otherwise(-1)
        count = F.when(symbol == 2, state + 1).otherwise(F.greatest(F.lit(0), state - 1))
        return F.when(state == -1, inside).when(count >= n, -1).otherwise(count)

    start = F.array(*[F.lit(s) for s in range(-1, n)])
    ordered = lambda items: F.array_sort(F.collect_list(items))
    tables = blocked.groupBy(lane, "_b").agg(
        F.aggregate(ordered(F.struct("_o", "_l")), start, lambda t, s: F.transform(t, lambda x: step(x, s["_l"]))).alias("t")
    )
    state = F.aggregate(ordered(F.struct("_b", "t")), F.lit(0), lambda x, b: F.element_at(b["t"], x + 2))
    return tables.groupBy(lane).agg(state.alias("state")).withColumn("is_burst", F.col("state") == -1)


def misra_gries_merge(a: Counter, b: Counter, k: int) -> Counter:
    """Two summaries as one: the (k + 1)-th count is taken off all."""
    merged = a + b
    if len(merged) > k:
        cut = sorted(merged.values(), reverse=True)[k]
        merged = Counter({x: n - cut for x, n in merged.items() if n > cut})
    return merged


def misra_gries(rows: DataFrame, key: str, k: int = Config.topk_k) -> DataFrame:
    """``key, n``: at most k heavy hitters; n is at most (rows / (k + 1)) below the true count, never above.

    Each task keeps k counters, and what is sent to the last task is k counters from each.
    """

    ship_package(rows.sparkSession)

    def summarise(batches):
        held: Counter = Counter()
        for batch in batches:
            held = misra_gries_merge(held, Counter(batch["key"].value_counts().to_dict()), k)
        yield from _summary(held)

    def reduce_(batches):
        held: Counter = Counter()
        for batch in batches:
            held = _merge_rows(held, batch, k)
        yield from _summary(held)

    parts = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).mapInPandas(summarise, "key string, n long")
    return parts.repartition(1).mapInPandas(reduce_, "key string, n long").withColumnRenamed("key", key)


def _summary(held: Counter) -> Iterator[pd.DataFrame]:
    """The counters as a batch. A task without rows gives none: pandas knows no type for empty columns, and Spark fails on them."""
    if held:
        yield pd.DataFrame({"key": list(held), "n": list(held.values())})


def _merge_rows(held: Counter, batch: pd.DataFrame, k: int) -> Counter:
    summed: Counter = Counter()
    for x, n in zip(batch["key"], batch["n"]):
        summed[x] += int(n)
    return misra_gries_merge(held, summed, k)


@dataclass(frozen=True)
class CountMin:
    """A count-min sketch: estimates are never below the true count."""

    total: int
    coefficients: np.ndarray
    table: np.ndarray

    @classmethod
    def read(cls, blob: bytes) -> CountMin:
        """From the bytes of Spark's aggregate: version, total, depth, width, coefficients, counters."""
        _, total, depth, width = struct.unpack(">iqii", blob[:20])
        numbers = np.frombuffer(blob[20:], ">i8").astype(np.int64)
        return cls(total, numbers[:depth], numbers[depth:].reshape(depth, width))

    def estimate(self, keys: np.ndarray) -> np.ndarray:
        """Counts of whole-number keys."""
        with np.errstate(over="ignore"):
            hashed = self.coefficients[:, None] * keys.astype(np.int64)[None, :]
            hashed = ((hashed + (hashed >> 32)) & 0x7FFFFFFF) % self.table.shape[1]
        return np.take_along_axis(self.table, hashed, axis=1).min(axis=0)


def count_min(rows: DataFrame, key: str, eps: float = 2 / Config.cms_w, confidence: float = 1 - 0.5**Config.cms_d, seed: int = 42) -> CountMin:
    """A sketch of a whole-number key, of fixed size whatever the input: ``cms_w`` counters in ``cms_d`` rows. Hash other keys first."""
    sketch = F.count_min_sketch(F.col(key).cast("long"), F.lit(eps), F.lit(confidence), F.lit(seed))
    return CountMin.read(bytes(rows.agg(sketch).first()[0]))


def with_estimates(rows: DataFrame, key: str, sketch: CountMin) -> DataFrame:
    """``rows`` with the column ``estimate``."""
    ship_package(rows.sparkSession)

    @F.pandas_udf("long")
    def estimate(keys: pd.Series) -> pd.Series:
        return pd.Series(sketch.estimate(keys.to_numpy()))

    return rows.withColumn("estimate", estimate(F.col(key).cast("long")))
