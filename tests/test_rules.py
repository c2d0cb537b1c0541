"""Metrics and decision rules on tables of a few rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlog.config import Config
from driftlog.operators import decisions, metrics, tick, views
from driftlog.operators.metrics import misra_gries_merge

CHUNK = "seq int, n long, temp double, tier string, state string, persisted_at double, last_access double"
INDEX = "seq int, index_id string, field string, kind string, bytes long, usage long, last_used double"
PRED = "field string, op string, value string, freq long, last_seen double"
DROPPED = "index_id string, seq int, field string, op string, dropped_at double"


def seqs(df, column="seq"):
    return sorted(r[column] for r in df.collect())


@pytest.mark.parametrize("block", [3, 4096])
def test_ema_in_blocks_equals_the_fold(spark, block):
    xs = [random.Random(5).random() for _ in range(20)]
    want = xs[0]
    for x in xs[1:]:
        want = 0.3 * x + 0.7 * want
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "lane string, i long, x double")
    assert metrics.ema(rows, ["lane"], "i", "x", 0.3, block).first()["ema"] == pytest.approx(want)


def test_saturating_and_hysteresis_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "BLOCK", 4)
    rng = random.Random(3)
    ratios = [rng.choice([0.5, 2.0, 4.0, 4.0]) for _ in range(61)]
    level, count, burst = 0, 0, False
    for r in ratios:
        level = max(0, min(3, level + (1 if r > 3 else -1)))
        if burst:
            burst, count = (False, 0) if r < 1.5 else (True, count)
        else:
            count = count + 1 if r > 3 else max(0, count - 1)
            burst = count >= 3
    rows = spark.createDataFrame([("a", i, r) for i, r in enumerate(ratios)], "lane string, i long, ratio double").withColumn("up", F.col("ratio") > 3)
    assert metrics.saturating(rows, "lane", "i", "up", 3).first()["level"] == level
    assert metrics.hysteresis(rows, "lane", "i", "ratio").first()["is_burst"] == burst


def test_first_heat_samples(spark):
    one = spark.createDataFrame([(1, 5.0)], "seq int, ts double")
    assert metrics.heat(one, [10.0]).first()["temp"] == pytest.approx(0.9)
    assert metrics.heat(one, [1.0]).first()["temp"] == pytest.approx(0.1)


def test_sliding_count_keeps_the_window_edge(spark):
    rows = spark.createDataFrame([("a", float(t)) for t in (0, 10, 60, 61)], "lane string, ts double")
    got = {r["bucket"]: r["n"] for r in metrics.sliding_count(rows, "lane", 60.0).collect()}
    assert got == {0.0: 1, 10.0: 2, 60.0: 3, 61.0: 3}
    assert metrics.write_rate(rows, "lane", 60.0, 61.0).first()["rate"] == pytest.approx(3 / 60)


def test_misra_gries_bounds(spark):
    keys = ["hot"] * 50 + [f"k{i}" for i in range(20)]
    random.Random(1).shuffle(keys)
    got = {r["key"]: r["n"] for r in metrics.misra_gries(spark.createDataFrame([(k,) for k in keys], "key string").repartition(5), "key", 5).collect()}
    assert len(got) <= 5 and 50 - 70 / 6 <= got["hot"] <= 50
    assert misra_gries_merge(Counter(a=3, b=1), Counter(c=2), 2) == Counter(a=2, c=1)


def test_misra_gries_over_tasks_without_rows(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "key string")
    few = metrics.misra_gries(rows.coalesce(1).unionByName(rows.where("false").coalesce(1)), "key", 5)
    assert [tuple(r) for r in few.collect()] == [("a", 2)]
    assert metrics.misra_gries(rows.where("key IS NULL"), "key", 5).collect() == []
    assert metrics.misra_gries(spark.range(0).selectExpr("CAST(id AS STRING) AS key"), "key", 5).collect() == []


def test_misra_gries_over_splits_of_one_row_group(spark, tmp_path):
    """A large row group belongs to one of the splits that its file is read in; the other tasks have no rows."""
    path = str(tmp_path / "keys")
    spark.range(40_000).selectExpr("IF(id % 2 = 0, 'hot', sha2(CAST(id AS STRING), 256)) AS key").coalesce(1).write.option("compression", "uncompressed").parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        stored = spark.read.parquet(path)
        assert stored.rdd.getNumPartitions() > 2
        got = {r["key"]: r["n"] for r in metrics.misra_gries(stored, "key", 5).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) <= 5 and 20_000 - 40_000 / 6 <= got["hot"] <= 20_000


def test_count_min_bounds(spark):
    rows = spark.createDataFrame([(k,) for k in range(10) for _ in range(100)], "k long")
    sketch = metrics.count_min(rows, "k", eps=0.002)
    keys = np.arange(-5, 2000)
    got = dict(zip(keys.tolist(), sketch.estimate(keys).tolist()))
    assert sketch.total == 1000 and all(got[k] >= 100 for k in range(10))
    assert np.mean([got[k] for k in range(10, 2000)]) < 20


def test_decay_cuts_and_drops(spark):
    got = metrics.decay(spark.createDataFrame([("a", 40), ("b", 11), ("c", 1)], "k string, n long"), "n")
    assert {r["k"]: r["n"] for r in got.collect()} == {"a": 20, "b": 5}


NOW = 1000.0


@pytest.mark.parametrize(
    "row, demoted",
    [
        ((1, 5, 0.05, "hot", "persisted", 900.0, 800.0), True),
        ((1, 5, 0.1, "hot", "persisted", 900.0, 800.0), False),  # warm enough
        ((1, 5, 0.05, "cold", "persisted", 900.0, 800.0), False),
        ((1, 5, 0.05, "hot", "sealed", 900.0, 800.0), False),
        ((1, 5, 0.05, "hot", "persisted", 971.0, 800.0), False),  # in its grace
        ((1, 5, 0.05, "hot", "persisted", 970.0, 800.0), True),
        ((1, 5, 0.05, "hot", "persisted", None, None), True),
        ((1, 5, 0.05, "hot", "persisted", 900.0, 910.0), False),  # idle for just 90 s
        ((1, 5, 0.05, "hot", "persisted", 900.0, 909.9), True),
    ],
)
def test_demote(spark, row, demoted):
    assert decisions.should_demote(spark.createDataFrame([row], CHUNK), NOW).count() == demoted


def test_promote_is_strict(spark):
    rows = [(i, 1, t, "cold", "persisted", None, None) for i, t in enumerate((0.5, 0.51))] + [(9, 1, 0.9, "hot", "persisted", None, None)]
    assert seqs(decisions.should_promote(spark.createDataFrame(rows, CHUNK))) == [1]


@pytest.mark.parametrize(
    "bytes_, usage, last, pressure, dropped",
    [
        (10_240, 0, None, 0.3, True), (10_240, 0, 399.0, 0.3, True), (10_240, 0, 400.0, 0.3, False), (10_240, 1, 399.0, 0.3, False),
        (1024, 5, 930.0, 0.71, True), (1024, 5, 940.0, 0.71, False), (1024, 5, 930.0, 0.7, False), (0, 3, 100.0, 0.3, False),
    ],
)
def test_drop(spark, bytes_, usage, last, pressure, dropped):
    df = spark.createDataFrame([(1, "1:hash:a", "a", "hash", bytes_, usage, last)], INDEX)
    assert decisions.should_drop(df, NOW, pressure).count() == dropped
    assert decisions.should_drop(df, NOW, pressure, Config(static_indexes=("a",))).count() == 0


def test_build_needs_heat_frequency_and_calm(spark):
    chunk = spark.createDataFrame([(1, 9, 0.3, "hot", "sealed", None, None), (2, 9, 0.29, "hot", "sealed", None, None), (3, 9, 0.9, "hot", "open", None, None), (4, 9, 0.9, "cold", "persisted", None, None)], CHUNK)
    preds = spark.createDataFrame([("a", "=", "x", 5, 1.0), ("a", "=", "y", 9, 1.0), ("b", "=", "x", 4, 1.0), ("c", "exists", "", 50, 1.0), ("ts", "range", "", 5, 1.0)], PRED)
    got = sorted((r["seq"], r["field"], r["kind"]) for r in decisions.should_build(chunk, preds, False).collect())
    assert got == [(1, "a", "hash"), (1, "ts", "skip")]
    assert decisions.should_build(chunk, preds, True).count() == 0
    sketch = spark.createDataFrame([(1, "ts")], "seq int, field string")
    assert seqs(decisions.should_build(chunk, preds, False, sketch), "field") == ["ts"]


def test_restore_sums_frequencies_after_the_drop(spark):
    preds = spark.createDataFrame([("a", "=", "x", 2, 950.0), ("a", "=", "y", 3, 400.0)], PRED)
    rows = [("1", 1, "a", "=", 900.0), ("2", 2, "a", "=", 960.0), ("3", 3, "a", "=", 399.0), ("4", 4, "b", "=", 900.0), ("5", 5, "a", "=", 400.0)]
    dropped = spark.createDataFrame(rows, DROPPED)
    assert seqs(decisions.should_restore(dropped, preds, NOW), "index_id") == ["1", "5"]
    assert seqs(decisions.expired(dropped, NOW), "index_id") == ["3"]


def test_relief_cascade(spark):
    chunk = spark.createDataFrame([(i, 1, i / 10, "hot", "persisted", None, None) for i in range(8)], CHUNK)
    index = spark.createDataFrame([(i, f"i{i}", "a", "hash", 200_000 if i < 4 else 1024, i, 990.0 if i == 0 else 100.0) for i in range(10)], INDEX)
    plan = lambda p: sorted((r["action"], r["target"], r["priority"]) for r in decisions.relief(chunk, index, NOW, p).collect())
    assert plan(0.69) == []
    assert plan(0.75) == [("demote", "0", 15), ("demote", "1", 15)]
    assert plan(0.9) == [("demote", str(i), 10) for i in range(4)] + [("evict", f"i{i}", 8) for i in (1, 2, 3)]
    critical = plan(0.97)
    assert [x[1] for x in critical if x[0] == "demote"] == [str(i) for i in range(8)]
    assert [x[1] for x in critical if x[0] == "drop"] == [f"i{i}" for i in range(7)]


def test_hot_cap(spark):
    chunk = spark.createDataFrame([(i, 1, t, "hot", "persisted", None, 1.0) for i, t in enumerate((0.9, 0.1, 0.5, 0.3, 0.7))], CHUNK)
    assert seqs(decisions.over_cap(chunk, config=Config(max_hot_chunks=2))) == [1, 2, 3]
    assert decisions.over_cap(chunk, config=Config(max_hot_chunks=0)).count() == 0
    assert seqs(decisions.over_cap(chunk, chunk.where("seq = 1"), Config(max_hot_chunks=2))) == [2, 3]


@pytest.mark.parametrize(
    "hot, cold, cap, promoted",
    [
        ((0.9, 0.9), (0.6, 0.8, 0.7), 4, [11, 12]),  # there is room for two: the hottest
        ((0.9, 0.9), (0.9, 0.9, 0.9), 2, []),  # no room, and equal heat moves nothing
        ((0.2, 0.6), (0.7, 0.9, 0.55), 2, [10, 11]),  # 0.9 goes in for 0.2 and 0.7 for 0.6
        ((0.2, 0.7), (0.6, 0.65), 2, [11]),  # the second would have to be hotter than 0.7
        ((0.2, 0.8), (0.6, 0.65, 0.9), 3, [11, 12]),  # one by room, one for 0.2
        ((0.9, 0.05), (0.6, 0.7), 2, [11]),  # 0.05 leaves anyway
        ((0.3, 0.4, 0.5), (0.6, 0.45), 2, [10]),  # 0.3 goes by the cap, 0.4 for 0.6
        ((0.9, 0.9), (0.6, 0.7), 0, [10, 11]),  # a cap of 0 is none
    ],
)
def test_promotions_stay_under_the_cap(spark, hot, cold, cap, promoted):
    rows = [(i, 1, t, "hot", "persisted", None, 1.0) for i, t in enumerate(hot)] + [(10 + i, 1, t, "cold", "persisted", None, 1.0) for i, t in enumerate(cold)]
    empty = lambda schema: spark.createDataFrame([], schema)
    snap = tick.Snapshot(NOW, spark.createDataFrame(rows, CHUNK), empty(PRED), empty(INDEX), empty(DROPPED))
    plan = tick.plan(snap, Config(max_hot_chunks=cap, promote_threshold=0.4)).where("action = 'promote'")
    assert sorted(int(r["target"]) for r in plan.collect()) == promoted


def test_chunks_that_cannot_go_give_no_place(spark):
    rows = [(1, 1, 0.2, "hot", "sealed", None, None), (2, 1, 0.3, "hot", "open", None, None), (3, 1, 0.9, "cold", "persisted", None, None)]
    chunk = spark.createDataFrame(rows, CHUNK)
    left = lambda cap: seqs(decisions.under_cap(chunk.where("tier = 'cold'"), chunk, chunk.limit(0), Config(max_hot_chunks=cap)))
    assert left(1) == left(2) == [] and left(3) == [3]


def test_budget_skips_excess_builds_without_charging(spark):
    rows = [("build", str(i), 30, 2) for i in range(6)] + [("drop", str(i), 50, 5) for i in range(9)] + [("demote", "0", 10, 0)]
    got = [(r["action"], r["target"]) for r in decisions.budget(spark.createDataFrame(rows, "action string, target string, priority int, plan_seq int")).collect()]
    assert got == [("demote", "0")] + [("build", str(i)) for i in range(3)] + [("drop", str(i)) for i in range(6)]


def test_tick_plans_once_per_index_and_not_in_a_burst(spark):
    chunk = spark.createDataFrame([(1, 9, 0.9, "hot", "sealed", None, 990.0), (2, 9, 0.9, "cold", "persisted", None, 990.0)], CHUNK)
    preds = spark.createDataFrame([("a", "=", "x", 9, 1.0), ("a", "=", "y", 9, 1.0), ("a", "in", "z", 9, 1.0)], PRED)
    snap = tick.Snapshot(NOW, chunk, preds, spark.createDataFrame([], INDEX), spark.createDataFrame([], DROPPED))
    got = [(r["action"], r["target"]) for r in tick.tick(snap).collect()]
    assert got == [("promote", "2"), ("build", "1:hash:a")]
    burst = tick.Snapshot(NOW, chunk, preds, snap.indexes, snap.dropped, is_burst=True)
    assert tick.tick(burst).count() == 0
    assert [(r["action"], r["target"]) for r in tick.tick(snap, Config(dynamic_indexing=False)).collect()] == [("promote", "2")]
    events = {r["action"]: r for r in tick.events_of(tick.tick(snap), NOW).collect()}
    assert (events["promote"]["type"], events["promote"]["tier_to"], events["build_index"]["type"]) == ("tier_change", "hot", "decision")
    static = tick.static_builds(snap, Config(static_indexes=("ts", "service")))
    assert sorted((r["seq"], r["field"], r["kind"]) for r in static.collect()) == [(1, "service", "hash"), (1, "ts", "skip")]


def test_views(spark):
    chunk = spark.createDataFrame([(1, 1, 0.0, "hot", "open", None, None), (2, 1, 0.0, "hot", "sealed", None, None), (3, 1, 0.0, "cold", "persisted", None, None)], CHUNK)
    index = spark.createDataFrame([(2, "i", "a", "hash", 10, 1, None), (2, "j", "b", "hash", 5, 1, None)], INDEX)
    assert tuple(views.engine_state(chunk, index).first()) == (3, 2, 1)
    assert views.metric_tick(chunk, index, 1.0, 0.0, 1.0, 0.0).first()["n_sealed"] == 1
    assert tuple(views.index_histogram(index).first()) == ("hash", 2, 15)
