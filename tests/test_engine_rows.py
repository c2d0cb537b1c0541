"""Filters, chunks and indexes over small tables."""

import pytest
from pyspark.sql import functions as F

from driftlog.config import Config
from driftlog.engine import Engine
from driftlog.functions.compile import Resolver, compile_expr
from driftlog.operators import chunks, indexes, search
from driftlog.plans import ir
from driftlog.plans.parser import parse
from driftlog.sources.logs import export_json_lines, import_json_lines, split_valid

ROWS = [
    (0, '{"a": 7, "s": "x"}'), (1, '{"a": 7.0}'), (2, '{"a": "7"}'), (3, '{"a": true}'), (4, '{"a": null}'), (5, "{}"), (6, None),
    (7, '{"a": [1]}'), (8, '{"a": 12}'), (9, '{"s": "y"}'),
]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = spark.createDataFrame([(i, float(i), "auth" if i % 2 else None, "INFO", f"m{i}", j) for i, j in ROWS], "pos long, ts double, service string, level string, msg string, j string")
    return rows.withColumn("fields", F.try_parse_json("j")).drop("j").cache()


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a = 7", [0, 1]), ('a = "7"', [2]), ("a = 1", [3]), ("a exists", [0, 1, 2, 3, 7, 8]), ("not a exists", [4, 5, 6, 9]),
        ("not a = 7", [2, 3, 4, 5, 6, 7, 8, 9]), ("a >= 7 and a <= 12", [0, 1, 8]), ("a in [7, 12]", [0, 1, 8]), ('a in ["7", 12]', [2, 8]),
        ('a > "5"', [2]), ('s = "x" or s = "y"', [0, 9]), ('service = "auth"', [1, 3, 5, 7, 9]), ('not service = "auth"', [0, 2, 4, 6, 8]),
        ("missing = 1", []), ("ts >= 8", [8, 9]), ('ts = "8"', []), ("service > 3", []), ('a != 7', [2, 3, 7, 8]), ('s =~ "^[xy]$"', [0, 9]),
        ("a = 7 | order by a desc | limit 1", [0]), ("ts exists | order by a desc | limit 2", [8, 0]), ("ts exists | order by service | limit 2", [0, 2]),
    ],
)
def test_values_of_any_type(mixed, text, expected):
    got = [r["pos"] for r in search.find(text, mixed, now=100.0).collect()]
    assert (got if "|" in text else sorted(got)) == expected


def test_equality_with_null_is_absence(mixed):
    condition = compile_expr(ir.Predicate("a", ir.EQ, None), Resolver(mixed))
    assert sorted(r["pos"] for r in mixed.where(condition).collect()) == [4, 5, 6, 9]


def test_not_is_the_complement(mixed):
    for text in ("a = 7", "a exists", "a > 3", 'a in ["7"]', "missing exists", 's =~ "x"'):
        inside, outside = (search.find(t, mixed, now=1.0).count() for t in (text, f"not ({text})"))
        assert inside + outside == len(ROWS)


@pytest.fixture(scope="module")
def logs(spark):
    rows = [(i, float(i), ["auth", "billing", "auth", "frontend", "auth"][i % 5], "ERROR" if i % 3 == 0 else "INFO", f"m{i}", i % 7, f"trace-{i}") for i in range(60)]
    return chunks.assign_by_count(spark.createDataFrame(rows, "pos long, ts double, service string, level string, msg string, user_id long, trace string"), 15).cache()


@pytest.mark.parametrize(
    "index, predicate",
    [
        (indexes.HashIndex("service"), ir.Predicate("service", ir.EQ, "auth")),
        (indexes.HashIndex("user_id"), ir.Predicate("user_id", ir.IN, (1, 4))),
        (indexes.SkipIndex("ts", 4), ir.Predicate("ts", ir.RANGE, ir.Interval(4.0, 21.0))),
        (indexes.SkipIndex("ts", 4), ir.Predicate("ts", ir.RANGE, ir.Interval(low=50.0))),
        (indexes.BloomIndex("trace"), ir.Predicate("trace", ir.EQ, "trace-33")),
        (indexes.BloomIndex("user_id"), ir.Predicate("user_id", ir.EQ, 3.0)),
        (indexes.BloomIndex("trace"), ir.Predicate("trace", ir.IN, ("trace-1", "trace-59"))),
    ],
)
def test_indexed_equals_scanned(logs, index, predicate):
    scanned = {r["pos"] for r in search.run(ir.Query(predicate), logs).collect()}
    found = index.lookup(index.build(logs), logs, predicate)
    candidates = {r["pos"] for r in found.collect()}
    assert candidates >= scanned and (candidates == scanned or not index.precise)
    assert {r["pos"] for r in search.run(ir.Query(predicate), found).collect()} == scanned
    assert index.memory_bytes(index.build(logs)).where("bytes > 0").count() == 4


def test_posting_lists_and_blocks(logs):
    lists = {(r["seq"], r["value"]): r["positions"] for r in indexes.HashIndex.posting_lists(indexes.HashIndex("service").build(logs)).collect()}
    assert lists[0, "auth"] == [0, 2, 4, 5, 7, 9, 10, 12, 14]
    narrow = indexes.SkipIndex("ts", 3)
    got = narrow.lookup(narrow.build(logs.where("pos < 10")), logs.where("pos < 10"), ir.Predicate("ts", ir.RANGE, ir.Interval(4.0, 7.0)))
    assert sorted(r["pos"] for r in got.collect()) == [3, 4, 5, 6, 7, 8]


def test_skip_blocks_need_no_order(spark, logs):
    shuffled = logs.withColumn("ts", (F.col("pos") * 37 % 60).cast("double"))
    index, predicate = indexes.SkipIndex("ts", 4), ir.Predicate("ts", ir.RANGE, ir.Interval(10.0, 12.0))
    assert search.run(ir.Query(predicate), index.lookup(index.build(shuffled), shuffled, predicate)).count() == 3


def test_bloom_false_positives_are_few():
    bits, hashes = indexes.bloom_shape(1000, 0.01)
    held = set()
    for i in range(1000):
        held.update(indexes.bloom_places(f"in_{i}", bits, hashes).tolist())
    assert all(held.issuperset(indexes.bloom_places(f"in_{i}", bits, hashes).tolist()) for i in range(1000))
    wrong = sum(held.issuperset(indexes.bloom_places(f"out_{i}", bits, hashes).tolist()) for i in range(10_000))
    assert wrong / 10_000 <= 0.03


def test_choice_of_index():
    assert indexes.choose_kind("ts", ir.RANGE) == "skip" and indexes.choose_kind("k", ir.EQ) == "hash"
    assert indexes.choose_kind("k", ir.RANGE) is None and indexes.choose_kind("k", ir.EXISTS) is None
    both = [indexes.BloomIndex("a"), indexes.HashIndex("a"), indexes.SkipIndex()]
    assert isinstance(indexes.pick(both, ir.Predicate("a", ir.EQ, 1)), indexes.HashIndex)
    assert indexes.pick(both, ir.Predicate("b", ir.EQ, 1)) is None


def test_chunk_mode_holds_row_mode(logs):
    heads = chunks.headers(logs)
    query = ir.Query(ir.Predicate("level", ir.EQ, "ERROR"), (16.0, 20.0))
    rows = {r["pos"] for r in search.run(query, logs, heads, "row").collect()}
    whole = {r["pos"] for r in search.run(query, logs, heads, "chunk").collect()}
    assert rows == {18} and whole == {15, 18, 21, 24, 27}


def test_headers(logs):
    head = {r["seq"]: r for r in chunks.headers(logs).collect()}
    assert (head[1]["n_rows"], head[1]["ts_min"], head[1]["ts_max"], head[1]["services"]) == (15, 15.0, 29.0, ["auth", "billing", "frontend"])
    assert head[1]["chunk_id"] == "chunk_000001_15000"


def test_greedy_sealing_by_each_limit(logs):
    sized = logs.withColumn("bytes", F.lit(10)).withColumn("lane", F.lit("one"))
    count = lambda **limits: [r["n"] for r in chunks.seal_greedily(sized, "lane", Config(**limits)).groupBy("lane_seq").agg(F.count("*").alias("n")).orderBy("lane_seq").collect()]
    assert count(chunk_max_entries=25, chunk_max_seconds=1e9) == [25, 25, 10]
    assert count(chunk_max_bytes=200, chunk_max_seconds=1e9) == [20, 20, 20]
    assert count(chunk_max_seconds=9.0) == [10] * 6


def test_engine_end_to_end(spark, logs, tmp_path):
    engine = Engine(spark, str(tmp_path / "engine"))
    engine.load(logs)
    text = 'service = "auth" and level = "ERROR"'
    before = sorted(r["pos"] for r in engine.find(text).collect())
    engine.build_index("hash", "service")
    assert sorted(r["pos"] for r in engine.find(text).collect()) == before == [i for i in range(60) if i % 3 == 0 and i % 5 in (0, 2, 4)]
    engine.promote(1)
    assert engine.chunk(1).count() == 15
    engine.demote(1)
    assert engine.chunk(1).count() == 15 and engine.next_seq() == 4
    assert engine.find(ir.Predicate("ts", ir.RANGE, ir.Interval(3.0, 5.0))).count() == 3
    assert engine.find("ts exists", time_range=(16.0, 20.0), time_mode="row").count() == 5
    assert {e["field"] for e in engine.query_events} == {"service", "level", "ts"}


@pytest.mark.parametrize("kind, field, text", [("hash", "level", 'level = "ERROR"'), ("bloom", "service", 'service = "auth"'), ("skip", "ts", "ts >= 10 and ts <= 50")])
def test_sidecars_and_chunks_loaded_later(spark, logs, tmp_path, kind, field, text):
    engine = Engine(spark, str(tmp_path / "engine"))
    rows = lambda: sorted((r["seq"], r["pos"]) for r in engine.find(text).collect())
    engine.load(logs.where("seq < 2 and pos != 0"))
    engine.build_index(kind, field)
    engine.load(logs.where("seq >= 2 or pos = 0"))  # new chunks, and a row more of an indexed one
    after = rows()
    assert {seq for seq, _ in after} == {0, 1, 2, 3}
    engine.build_index(kind, field)
    assert rows() == after
    engine.drop_index(kind, field)
    assert rows() == after


def test_json_lines_round_trip(spark, logs, tmp_path):
    path = str(tmp_path / "cold")
    export_json_lines(logs, path)
    part = next((tmp_path / "cold").rglob("*.gz"))
    (part.parent / "bad.json").write_text('{"pos": 1, broken\n')
    back = import_json_lines(spark, path, "pos long, ts double, service string, level string, msg string, user_id long, trace string, seq int")
    assert back.count() == 60 and back.select("pos").distinct().count() == 60


def test_validation(spark):
    rows = [(1.0, "a", "INFO", "m"), (-1.0, "a", "INFO", "m"), (1.0, "", "INFO", "m"), (1.0, "a", "LOUD", "m"), (1.0, "a", "INFO", "m" * 10_001), (None, "a", "INFO", "m"), (99e9, "a", "INFO", "m")]
    good, bad = split_valid(spark.createDataFrame(rows, "ts double, service string, level string, msg string"), 100.0)
    assert (good.count(), bad.count()) == (1, 6)


def test_plan_has_no_python_and_a_bounded_sort(logs):
    plan = search.find('level = "ERROR" | order by ts desc | limit 5', logs)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    assert parse("a exists").limit is None
