"""One turn of the control loop: from a snapshot of metrics to a table of actions, and their events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlog.config import Config
from driftlog.operators import decisions as D


@dataclass(frozen=True)
class Snapshot:
    """All metrics at one moment; the clock is part of it."""

    now: float
    chunks: DataFrame
    predicates: DataFrame
    indexes: DataFrame
    dropped: DataFrame
    pressure: float = 0.0
    is_burst: bool = False
    sketches: DataFrame | None = None


def static_builds(snap: Snapshot, config: Config) -> DataFrame:
    """``seq, field, kind`` of static indexes that are missing on sealed hot chunks with rows; outside the budget."""
    spark = snap.chunks.sparkSession
    fields = spark.createDataFrame([(f, "skip" if f == "ts" else "hash") for f in config.static_indexes], "field string, kind string")
    ready = snap.chunks.where("state != 'open' AND tier = 'hot' AND n > 0").select("seq")
    return ready.join(F.broadcast(fields), how="cross").join(snap.indexes.select("seq", "field", "kind"), ["seq", "field", "kind"], "left_anti")


def plan(snap: Snapshot, config: Config = Config()) -> DataFrame:
    """``action, target, field, op, kind, priority, plan_seq`` of all that the rules ask for."""

    def rows(df: DataFrame, action: str, stage: str, target, priority=None, field=None, op=None, kind=None) -> DataFrame:
        text = lambda c: F.lit(None).cast("string") if c is None else F.col(c).cast("string")
        return df.select(
            (F.lit(action) if action else F.col("action")).alias("action"), F.col(target).cast("string").alias("target"),
            text(field).alias("field"), text(op).alias("op"), text(kind).alias("kind"),
            (F.col(priority) if priority else F.lit(D.PRIORITY.get(action, 0))).cast("int").alias("priority"), F.lit(D.PLAN_ORDER[stage]).alias("plan_seq"),
        )

    parts = [rows(D.relief(snap.chunks, snap.indexes, snap.now, snap.pressure, config), "", "relief", "target", "priority")]
    if not snap.is_burst:
        if config.dynamic_indexing:
            restore = D.should_restore(snap.dropped, snap.predicates, snap.now, config).select("index_id", "field", "op", D.kind_for().alias("kind"))
            parts.append(rows(restore, "restore", "restore", "index_id", field="field", op="op", kind="kind"))
            build = D.should_build(snap.chunks, snap.predicates, snap.is_burst, snap.sketches, config)
            build = build.join(snap.indexes.select("seq", "field", "kind"), ["seq", "field", "kind"], "left_anti")
            build = build.join(snap.dropped.select("seq", "field"), ["seq", "field"], "left_anti")
            build = build.withColumn("index_id", F.concat_ws(":", F.col("seq").cast("string"), "kind", "field")).dropDuplicates(["index_id"])
            parts.append(rows(build, "build", "build", "index_id", field="field", op="op", kind="kind"))
        soft = D.should_demote(snap.chunks, snap.now, config)
        leaving = soft.select("seq").unionByName(D.over_cap(snap.chunks, soft, config).select("seq"))
        if config.dynamic_tiering:
            parts.append(rows(D.under_cap(D.should_promote(snap.chunks, config), snap.chunks, leaving, config), "promote", "promote", "seq"))
        parts.append(rows(leaving, "demote", "demote", "seq"))
    if config.dynamic_indexing:
        parts.append(rows(D.should_drop(snap.indexes, snap.now, snap.pressure, config), "drop", "drop", "index_id"))
    # What several rules ask for is one action, by the rule that runs first.
    asked = reduce(DataFrame.unionByName, parts)
    first = Window.partitionBy("action", "target").orderBy("priority", "plan_seq")
    return asked.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def tick(snap: Snapshot, config: Config = Config()) -> DataFrame:
    """The actions to apply now."""
    return D.budget(plan(snap, config), config)


def drop_reasons(indexes: DataFrame, now: float, config: Config = Config()) -> DataFrame:
    """``index_id, reason``: how long an index idled and what it paid."""
    idle = F.when(F.col("last_used").isNull(), "inf").otherwise(F.format_string("%.0f", F.lit(now) - F.col("last_used")))
    return indexes.select("index_id", F.format_string("idle=%ss, roi=%.3f", idle, D.roi(config=config)).alias("reason"))


def events_of(actions: DataFrame, now: float) -> DataFrame:
    """``ts, type, action, target, field, op, kind, tier_from, tier_to``: what the actions publish."""
    move = F.col("action").isin("demote", "promote")
    tier = lambda hot: F.when(F.col("action") == "demote", F.lit("hot" if hot else "cold")).when(F.col("action") == "promote", F.lit("cold" if hot else "hot"))
    named = F.when(F.col("action").isin("build", "drop", "restore"), F.concat("action", F.lit("_index"))).when(F.col("action") == "evict", "evict_heavy_index").otherwise(F.col("action"))
    return actions.select(
        F.lit(float(now)).alias("ts"), F.when(move, "tier_change").otherwise("decision").alias("type"), named.alias("action"),
        "target", "field", "op", "kind", tier(True).alias("tier_from"), tier(False).alias("tier_to"),
    )
