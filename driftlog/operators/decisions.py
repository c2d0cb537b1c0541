"""Decision rules over tables of metrics. Each gives the rows it selects; ``actions`` makes a plan of them.

Tables: chunks (seq, n, temp, tier, state, persisted_at, last_access), predicates (field, op, value, freq), indexes
(index_id, seq, field, kind, bytes, usage, last_used), dropped indexes (index_id, seq, field, op, dropped_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlog.config import Config

# Priorities (a lower one runs first) and the seconds a used index must idle under pressure.
PRIORITY = {"build": 30, "restore": 30, "promote": 25, "demote": 20, "evict": 15, "drop": 50}
PRESSURE_IDLE = 60.0
#: Order in which a tick plans; ties of priority run in it.
PLAN_ORDER = {"relief": 0, "restore": 1, "build": 2, "promote": 3, "demote": 4, "drop": 5}


def idle(now: float, last: str = "last_used") -> Column:
    """Seconds since the last use; never used is forever."""
    return F.coalesce(F.lit(now) - F.col(last), F.lit(float("inf")))


def roi(usage: str = "usage", size: str = "bytes", tier: str | None = None, config: Config = Config()) -> Column:
    """Uses per KiB; a cold index costs less by the disk factor."""
    kib = F.col(size) / 1024.0
    hot = F.col(usage) / kib
    value = hot if tier is None else F.when(F.col(tier) == "cold", F.col(usage) / (kib / config.disk_cost_factor)).otherwise(hot)
    return F.when(F.col(usage) <= 0, 0.0).when(F.col(size) <= 0, F.col(usage).cast("double")).otherwise(value)


def kind_for(op: str = "op", field: str = "field") -> Column:
    """The index that serves a predicate: skip for ranges of time, hash for equality and membership, else none."""
    return F.when((F.col(op) == "range") & (F.col(field) == "ts"), "skip").when(F.col(op).isin("=", "in"), "hash")


def should_build(chunks: DataFrame, predicates: DataFrame, is_burst: bool, sketches: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """``seq, field, op, kind``: hot predicates on warm chunks, once for each index, none in a burst.

    Chunks that are open, cold or without the field are left out. Values don't matter to an index, so predicates
    come down to the few pairs of field and operator that are asked for.
    """
    hot = predicates.where(F.col("freq") >= config.build_threshold_freq).select("field", "op", kind_for().alias("kind")).where("kind IS NOT NULL").distinct()
    warm = chunks.where((F.col("temp") >= config.min_temp_for_index) & (F.col("state") != "open") & (F.col("tier") == "hot"))
    pairs = warm.crossJoin(hot)
    if sketches is not None:
        pairs = pairs.join(sketches.select("seq", "field"), ["seq", "field"], "left_semi")
    out = pairs.select("seq", "field", "op", "kind")
    return out.limit(0) if is_burst else out


def should_drop(indexes: DataFrame, now: float, pressure: float, config: Config = Config()) -> DataFrame:
    """Idle indexes that don't pay, and under pressure all that idle; static fields' stay."""
    waste = (idle(now) > config.idle_drop_sec) & (roi(config=config) < config.min_roi)
    pressed = F.lit(pressure > config.mem_pressure_drop) & (idle(now) > PRESSURE_IDLE)
    return indexes.where((waste | pressed) & ~_static(config))


def _static(config: Config) -> Column:
    return F.col("field").isin(*config.static_indexes) if config.static_indexes else F.lit(False)


def should_restore(dropped: DataFrame, predicates: DataFrame, now: float, config: Config = Config()) -> DataFrame:
    """Tombstones still in cooldown whose field and operator were asked for again, often enough in sum."""
    asked = predicates.groupBy("field", "op").agg(F.sum("freq").alias("freq"), F.max("last_seen").alias("last_seen"))
    live = dropped.where(F.lit(now) - F.col("dropped_at") <= config.cooldown_sec)
    return live.join(asked, ["field", "op"]).where((F.col("last_seen") > F.col("dropped_at")) & (F.col("freq") >= config.build_threshold_freq))


def expired(dropped: DataFrame, now: float, config: Config = Config()) -> DataFrame:
    return dropped.where(F.lit(now) - F.col("dropped_at") > config.cooldown_sec)


def should_demote(chunks: DataFrame, now: float, config: Config = Config()) -> DataFrame:
    """Hot persisted chunks past their grace that are cool and idle."""
    settled = F.col("persisted_at").isNull() | (F.lit(now) - F.col("persisted_at") >= config.demote_grace_sec)
    return chunks.where(
        (F.col("tier") == "hot") & (F.col("state") == "persisted") & settled
        & (F.col("temp") < config.demote_threshold) & (idle(now, "last_access") > config.demote_idle_sec)
    )


def should_promote(chunks: DataFrame, config: Config = Config()) -> DataFrame:
    return chunks.where((F.col("tier") == "cold") & (F.col("temp") > config.promote_threshold))


def should_evict_heavy(indexes: DataFrame, now: float, pressure: float, config: Config = Config()) -> DataFrame:
    heavy = (F.col("bytes") >= config.heavy_index_threshold) & F.lit(pressure > config.mem_pressure_drop)
    return indexes.where(heavy & (idle(now) > PRESSURE_IDLE) & ~_static(config))


def _coldest(chunks: DataFrame) -> DataFrame:
    """Persisted hot chunks with their rank ``_r`` from the coldest and their number ``_n``; a chunk table is metadata, a row per chunk."""
    hot = chunks.where((F.col("tier") == "hot") & (F.col("state") == "persisted"))
    return hot.withColumn("_r", F.row_number().over(Window.orderBy("temp", "seq"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))


def relief(chunks: DataFrame, indexes: DataFrame, now: float, pressure: float, config: Config = Config()) -> DataFrame:
    """``action, target, priority`` of the cascade: demote some, demote half and evict, demote all and drop all but the three best."""
    ranked = _coldest(chunks)
    demote = lambda rows, priority: rows.select(F.lit("demote").alias("action"), F.col("seq").cast("string").alias("target"), F.lit(priority).alias("priority"))
    if pressure < config.mem_pressure_drop:
        return demote(ranked.limit(0), 0)
    if pressure < config.mem_pressure_high:
        return demote(ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 4))), 15)
    if pressure < config.mem_pressure_critical:
        some = demote(ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 2))), 10)
        evict = should_evict_heavy(indexes, now, pressure, config)
        return some.unionByName(evict.select(F.lit("evict").alias("action"), F.col("index_id").alias("target"), F.lit(8).alias("priority")))
    best = indexes.withColumn("_roi", roi(config=config)).orderBy(F.desc("_roi"), F.desc("index_id")).limit(3).select("index_id")
    drop = indexes.where(~_static(config)).join(best, "index_id", "left_anti")
    return demote(ranked, 5).unionByName(drop.select(F.lit("drop").alias("action"), F.col("index_id").alias("target"), F.lit(1).alias("priority")))


def over_cap(chunks: DataFrame, already: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Hot chunks beyond the cap, the coldest and longest unused first; a cap of 0 is none."""
    hot = chunks.where(F.col("tier") == "hot")
    if already is not None:
        hot = hot.join(already.select("seq"), "seq", "left_anti")
    if config.max_hot_chunks <= 0:
        return hot.limit(0)
    ranked = hot.where(F.col("state") == "persisted").withColumn("_r", F.row_number().over(Window.orderBy("temp", F.col("last_access").asc_nulls_first(), "seq")))
    total = hot.agg(F.count(F.lit(1)).alias("_hot"))
    return ranked.join(F.broadcast(total), how="cross").where(F.col("_r") <= F.col("_hot") - config.max_hot_chunks).drop("_r", "_hot")


def under_cap(wanted: DataFrame, chunks: DataFrame, leaving: DataFrame, config: Config = Config()) -> DataFrame:
    """Of the chunks that are to be promoted, those that the cap would let stay; a cap of 0 is none.

    The hottest come first: as many as there is room for when the leaving chunks are gone, and beyond that each that is hotter than the
    chunk that would go for it, the coldest first. Equal heat moves nothing.
    """
    if config.max_hot_chunks <= 0:
        return wanted
    hot = chunks.where(F.col("tier") == "hot").join(leaving.select("seq"), "seq", "left_anti")
    room = hot.agg((F.lit(config.max_hot_chunks) - F.count(F.lit(1))).alias("_room"))
    # Room and hot chunks together are no more than the cap, so no chunk after the first so many can have a place.
    first = wanted.orderBy(F.desc("temp"), F.col("last_access").desc_nulls_last(), "seq").limit(config.max_hot_chunks)
    ranked = first.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("temp"), F.col("last_access").desc_nulls_last(), "seq")))
    coldest = Window.orderBy("temp", F.col("last_access").asc_nulls_first(), "seq")
    going = hot.where(F.col("state") == "persisted").select(F.col("temp").alias("_temp"), F.row_number().over(coldest).alias("_place"))
    met = ranked.crossJoin(F.broadcast(room)).join(F.broadcast(going), F.col("_place") == F.col("_r") - F.col("_room"), "left")
    return met.where((F.col("_r") <= F.col("_room")) | (F.col("temp") > F.col("_temp"))).drop("_r", "_room", "_place", "_temp")


def budget(actions: DataFrame, config: Config = Config()) -> DataFrame:
    """The actions of a tick: by priority, plan order and target; builds and restores within their own limit, which excess ones don't use up."""
    order = ["priority", "plan_seq", "target"]
    building = F.col("action").isin("build", "restore")
    ranked = actions.withColumn("_b", F.row_number().over(Window.partitionBy(building).orderBy(*order)))
    fitting = ranked.where(~building | (F.col("_b") <= config.builds_per_tick))
    return fitting.orderBy(*order).limit(config.actions_per_tick_budget).drop("_b")
