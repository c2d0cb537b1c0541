"""Queries over the test tables, one for each operator, and the SQL they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlog.config import Config
from driftlog.engine import Engine
from driftlog.operators import chunks, decisions, indexes, metrics, search, tick, views
from driftlog.plans import ir
from driftlog.session import scratch_dir
from driftlog.sources.logs import events_as_logs, split_valid
from driftlog.streaming import ingest as streaming

NOW = 1706745600.0
ROW = ("pos", "ts", "service", "level", "msg", "user_id", "value", "k")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LG = """
WITH lg AS (
  SELECT event_id AS pos, epoch_us(ts)::DOUBLE / 1e6 AS ts, 'svc-' || (user_id % 6)::VARCHAR AS service,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
         event_type AS msg, user_id, value, json_extract_string(props, '$.k')::BIGINT AS k,
         CASE WHEN user_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS opt_k, props,
         (event_id // 500)::INTEGER AS seq
  FROM events
), hd AS (
  SELECT seq, count(*) AS n_rows, min(ts) AS ts_min, max(ts) AS ts_max,
         sum(octet_length(encode(service)) + octet_length(encode(level)) + octet_length(encode(msg)) + 32)::BIGINT AS size_bytes
  FROM lg GROUP BY seq
), chunk_m AS (
  SELECT seq, count(*) AS n, (seq % 10) / 10.0::DOUBLE AS temp, CASE WHEN seq % 3 = 0 THEN 'cold' ELSE 'hot' END AS tier,
         CASE WHEN seq % 7 = 0 THEN 'sealed' ELSE 'persisted' END AS state, 1706745600.0::DOUBLE - 10 * seq AS persisted_at,
         CASE WHEN seq % 4 = 0 THEN NULL ELSE 1706745600.0::DOUBLE - 12 * seq END AS last_access
  FROM lg GROUP BY seq
), pred_m AS (
  SELECT 'level' AS field, '=' AS op, level AS value, count(*) % 10 AS freq, max(ts) AS last_seen FROM lg GROUP BY level
), idx_m AS (
  SELECT seq, seq::VARCHAR || ':hash:' || level AS index_id, 'level' AS field, 'hash' AS kind, (2048 * count(*))::BIGINT AS bytes, count(*) % 7 AS usage,
         CASE WHEN seq % 5 = 0 THEN NULL ELSE 1706745600.0::DOUBLE - 90 * seq END AS last_used
  FROM lg GROUP BY seq, level
), idx_roi AS (
  SELECT *, CASE WHEN usage <= 0 THEN 0.0 WHEN bytes <= 0 THEN usage::DOUBLE ELSE usage / (bytes / 1024.0::DOUBLE) END AS roi,
         coalesce(1706745600.0::DOUBLE - last_used, 'Infinity'::DOUBLE) AS idle
  FROM idx_m
)
"""


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_logs(spark, sf_dir)


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL, which starts after the common tables."""

    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = LG + sql
        return function

    return register


def text_query(name: str, text: str, sql: str, time_mode: str = "row", columns: tuple[str, ...] = ROW, **options) -> None:
    """Registers a query of the language."""

    def function(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs = _logs(spark, sf_dir)
        chunk_headers = chunks.headers(logs) if time_mode == "chunk" else None
        return search.find(text, logs, chunk_headers, time_mode, now=NOW, **options).select(*columns)

    query(name, f"SELECT {', '.join(columns)} FROM lg {sql}")(function)


text_query("filter_eq", 'level = "ERROR"', "WHERE level = 'ERROR'")
text_query("filter_eq_numeric", "user_id = 7", "WHERE user_id = 7")
text_query("filter_eq_wrong_type", 'user_id = "7"', "WHERE false")
text_query("filter_in", 'msg in ["click", "view"] and k in [1, 2, 3]', "WHERE msg IN ('click', 'view') AND k IN (1, 2, 3)")
text_query("filter_exists", "opt_k exists", "WHERE opt_k IS NOT NULL", columns=(*ROW, "opt_k"))
text_query("filter_range_closed", "k >= 10 and k < 20", "WHERE k BETWEEN 10 AND 20")
text_query("filter_range_open", "k > 10 and k < 20", "WHERE k > 10 AND k < 20", open_ranges=True)
text_query("filter_and", 'level = "ERROR" and service = "svc-1"', "WHERE level = 'ERROR' AND service = 'svc-1'")
text_query("filter_or", 'level = "ERROR" or (service = "svc-2" and k = 5)', "WHERE level = 'ERROR' OR (service = 'svc-2' AND k = 5)")
text_query("filter_not_missing", "not opt_k = 5", "WHERE NOT coalesce(opt_k = 5, false)", columns=(*ROW, "opt_k"))
text_query("filter_absent_field", "not host exists", "")
text_query("label_set", '{level="INFO", service="svc-3"}', "WHERE level = 'INFO' AND service = 'svc-3'")
text_query("filter_ne_strict", 'level != "INFO"', "WHERE level <> 'INFO'")
text_query("filter_ne_compat", 'level != "INFO"', "WHERE level = 'INFO'", negation="compat")
text_query("filter_regex_strict", 'msg =~ "^(err|sign)" and service !~ "[0-2]$"', "WHERE regexp_matches(msg, '^(err|sign)') AND NOT regexp_matches(service, '[0-2]$')")
text_query("order_by_asc", 'level = "ERROR" | order by value limit 50'.replace(" limit", " | limit"), "WHERE level = 'ERROR' ORDER BY value, pos LIMIT 50")
text_query("order_by_desc_limit", 'level = "ERROR" and service = "svc-1" | order by ts desc | limit 100', "WHERE level = 'ERROR' AND service = 'svc-1' ORDER BY ts DESC, pos LIMIT 100")
text_query("order_missing_as_zero", 'level = "WARN" | limit 40 | order by opt_k', "WHERE level = 'WARN' ORDER BY coalesce(opt_k, 0), pos LIMIT 40", columns=(*ROW, "opt_k"))
text_query("order_by_string", 'k = 3 | order by service desc | limit 30', "WHERE k = 3 ORDER BY service DESC, pos LIMIT 30")
text_query("limit_ingest_order", 'service = "svc-4" | limit 25', "WHERE service = 'svc-4' ORDER BY pos LIMIT 25")
text_query("limit_zero", 'service = "svc-4" | limit 0', "WHERE false")
text_query("time_last", 'service = "svc-1" | last 5d', "WHERE service = 'svc-1' AND ts BETWEEN 1706745600 - 432000 AND 1706745600")
text_query("time_since", 'level = "ERROR" | since "2024-01-20T00:00:00"', "WHERE level = 'ERROR' AND ts BETWEEN 1705708800 AND 1706745600")
_BETWEEN = 'service = "svc-1" | between "2024-01-06T00:13:20" and "2024-01-07T04:00:00"'
text_query("time_between_row", _BETWEEN, "WHERE service = 'svc-1' AND ts BETWEEN 1704500000 AND 1704600000")
text_query(
    "time_between_chunk", _BETWEEN, "WHERE service = 'svc-1' AND seq IN (SELECT seq FROM hd WHERE ts_max >= 1704500000 AND ts_min <= 1704600000)", time_mode="chunk"
)


@query("page_n", "SELECT pos, service, level FROM (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM lg WHERE level = 'ERROR') WHERE n > 50 AND n <= 75")
def page_n(spark, sf_dir):
    return search.page(search.find('level = "ERROR"', _logs(spark, sf_dir), now=NOW), 2, 25).select("pos", "service", "level")


@query("filter_variant", "SELECT pos, service FROM lg WHERE k = 7")
def filter_variant(spark, sf_dir):
    """The open map itself: the field is found in a VARIANT."""
    logs = _logs(spark, sf_dir).select("pos", "ts", "service", "level", "msg", F.parse_json("props").alias("fields"))
    return search.find("k = 7", logs, now=NOW).select("pos", "service")


@query("ingest_validation", "SELECT level, count(*) FILTER (ts <= 1705000000 + 86400) AS n_accepted, count(*) FILTER (ts > 1705000000 + 86400) AS n_rejected FROM lg GROUP BY level")
def ingest_validation(spark, sf_dir):
    """Taken in some days before the last events, whose time is then too far ahead."""
    good, bad = split_valid(_logs(spark, sf_dir), 1705000000.0)
    both = good.select("level", F.lit(True).alias("good")).unionByName(bad.select("level", F.lit(False).alias("good")))
    return both.groupBy("level").agg(F.count_if("good").alias("n_accepted"), F.count_if(~F.col("good")).alias("n_rejected"))


# Chunks

@query("chunk_headers", "SELECT printf('chunk_%06d_%d', seq, floor(ts_min * 1000)::BIGINT) AS chunk_id, seq, n_rows, ts_min, ts_max, size_bytes FROM hd")
def chunk_headers(spark, sf_dir):
    return chunks.headers(_logs(spark, sf_dir)).drop("services")


@query("chunk_services", "SELECT seq, string_agg(DISTINCT service, ',' ORDER BY service) AS services FROM lg GROUP BY seq")
def chunk_services(spark, sf_dir):
    return chunks.headers(_logs(spark, sf_dir)).select("seq", F.concat_ws(",", "services").alias("services"))


@query("schema_sketch", "SELECT seq, 'k' AS field, 'BIGINT' AS types FROM lg WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY seq")
def schema_sketch(spark, sf_dir):
    return chunks.sketch(_logs(spark, sf_dir), F.parse_json("props"))


@query("sketch_prune", "SELECT seq, count(*) AS n FROM lg WHERE seq % 2 = 0 AND k >= 50 GROUP BY seq")
def sketch_prune(spark, sf_dir):
    """Only even chunks hold the field in their open map: the others are pruned by their sketch."""
    logs = _logs(spark, sf_dir).drop("k").withColumn("fields", F.parse_json(F.when(F.col("seq") % 2 == 0, F.col("props")).otherwise("{}")))
    expr = ir.Predicate("k", ir.RANGE, ir.Interval(low=50.0))
    kept = search.prune_by_sketch(logs, chunks.sketch(logs, F.col("fields")), expr)
    return search.run(ir.Query(expr), kept).groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


@query("row_size", "SELECT seq, sum(octet_length(encode(service)) + octet_length(encode(level)) + octet_length(encode(msg)) + octet_length(encode(props)) + 32)::BIGINT AS bytes FROM lg GROUP BY seq")
def row_size(spark, sf_dir):
    return _logs(spark, sf_dir).groupBy("seq").agg(F.sum(chunks.row_size("service", "level", "msg", "props")).alias("bytes"))


@query("seal_by_count", "SELECT (pos // 1000)::INTEGER AS seq, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM lg GROUP BY 1")
def seal_by_count(spark, sf_dir):
    sealed = chunks.assign_by_count(_logs(spark, sf_dir), 1000)
    return sealed.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(
    "seal_greedy",
    """, RECURSIVE_ROWS AS (
      SELECT service, pos, ts, row_number() OVER (PARTITION BY service ORDER BY pos) AS i,
             octet_length(encode(service)) + octet_length(encode(level)) + octet_length(encode(msg)) + 32 AS b FROM lg
    ), walk AS (
      SELECT service, i, 0 AS lane_seq, 1 AS c, b AS total, ts AS first, (1 >= 50 OR b >= 2000) AS done FROM RECURSIVE_ROWS WHERE i = 1
      UNION ALL
      SELECT r.service, r.i, CASE WHEN w.done THEN w.lane_seq + 1 ELSE w.lane_seq END,
             CASE WHEN w.done THEN 1 ELSE w.c + 1 END, CASE WHEN w.done THEN r.b ELSE w.total + r.b END, CASE WHEN w.done THEN r.ts ELSE w.first END,
             CASE WHEN w.done THEN r.b >= 2000 ELSE w.c + 1 >= 50 OR w.total + r.b >= 2000 OR r.ts - w.first >= 172800 END
      FROM walk w JOIN RECURSIVE_ROWS r ON r.service = w.service AND r.i = w.i + 1
    ) SELECT service, lane_seq, count(*) AS n FROM walk GROUP BY service, lane_seq""",
)
def seal_greedy(spark, sf_dir):
    logs = _logs(spark, sf_dir).withColumn("bytes", chunks.row_size("service", "level", "msg"))
    limits = Config(chunk_max_entries=50, chunk_max_bytes=2000, chunk_max_seconds=172800.0)
    return chunks.seal_greedily(logs, "service", limits).groupBy("service", "lane_seq").agg(F.count(F.lit(1)).alias("n"))


SQL["seal_greedy"] = SQL["seal_greedy"].replace("WITH lg", "WITH RECURSIVE lg", 1)


# Indexes

@query("hash_index_build", "SELECT seq, level AS value, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM lg GROUP BY seq, level")
def hash_index_build(spark, sf_dir):
    lists = indexes.HashIndex.posting_lists(indexes.HashIndex("level").build(_logs(spark, sf_dir)))
    return lists.select("seq", "value", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"))


@query("hash_lookup", "SELECT pos, service, level FROM lg WHERE level = 'ERROR'")
def hash_lookup(spark, sf_dir):
    logs, index = _logs(spark, sf_dir), indexes.HashIndex("level")
    return index.lookup(index.build(logs), logs, ir.Predicate("level", ir.EQ, "ERROR")).select("pos", "service", "level")


@query("hash_lookup_many", "SELECT pos, user_id FROM lg WHERE user_id IN (1, 2, 3)")
def hash_lookup_many(spark, sf_dir):
    logs, index = _logs(spark, sf_dir), indexes.HashIndex("user_id")
    return index.lookup(index.build(logs), logs, ir.Predicate("user_id", ir.IN, (1, 2, 3))).select("pos", "user_id")


@query("hash_bytes", "SELECT seq, sum(octet_length(encode(level)) + 8 * n)::BIGINT AS bytes FROM (SELECT seq, level, count(*) AS n FROM lg GROUP BY seq, level) GROUP BY seq")
def hash_bytes(spark, sf_dir):
    index = indexes.HashIndex("level")
    return index.memory_bytes(index.build(_logs(spark, sf_dir)))


@query("skip_build", "SELECT seq, (pos // 100) AS block, min(ts) AS low, max(ts) AS high, min(pos) AS first_pos, max(pos) AS last_pos FROM lg GROUP BY 1, 2")
def skip_build(spark, sf_dir):
    return indexes.SkipIndex().build(_logs(spark, sf_dir))


@query("skip_lookup", "SELECT pos, ts FROM lg WHERE ts BETWEEN 1704500000 AND 1704600000")
def skip_lookup(spark, sf_dir):
    logs, index = _logs(spark, sf_dir), indexes.SkipIndex()
    predicate = ir.Predicate("ts", ir.RANGE, ir.Interval(1704500000.0, 1704600000.0))
    return search.run(ir.Query(predicate), index.lookup(index.build(logs), logs, predicate)).select("pos", "ts")


@query("bloom_gate", "SELECT pos, user_id FROM lg WHERE user_id = 7")
def bloom_gate(spark, sf_dir):
    logs, index = _logs(spark, sf_dir), indexes.BloomIndex("user_id")
    predicate = ir.Predicate("user_id", ir.EQ, 7.0)
    return search.run(ir.Query(predicate), index.lookup(index.build(logs), logs, predicate)).select("pos", "user_id")


@query("bloom_bytes", "SELECT seq, (greatest(64, floor(-count(DISTINCT user_id) * ln(0.01) / (ln(2.0) * ln(2.0)))::BIGINT) // 8 + 64 + 7)::BIGINT AS bytes FROM lg GROUP BY seq")
def bloom_bytes(spark, sf_dir):
    index = indexes.BloomIndex("user_id")
    return index.memory_bytes(index.build(_logs(spark, sf_dir)))


# Metrics

@query("ema_fold", "SELECT service, round(list_reduce(list(value ORDER BY pos), lambda a, x: 0.3 * x + 0.7 * a), 6) AS ema FROM lg GROUP BY service")
def ema_fold(spark, sf_dir):
    rows = metrics.numbered(_logs(spark, sf_dir).select("service", "pos", "value"), ["service"], ["pos"])
    return metrics.ema(rows, ["service"], "_i", "value", 0.3).select("service", F.round("ema", 6).alias("ema"))


@query(
    "sliding_count",
    """SELECT service, bucket, sum(n) OVER (PARTITION BY service ORDER BY bucket RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)::BIGINT AS n
       FROM (SELECT service, floor(ts / 1440.0) * 1440.0 AS bucket, count(*) AS n FROM lg GROUP BY 1, 2)""",
)
def sliding_count(spark, sf_dir):
    return metrics.sliding_count(_logs(spark, sf_dir), "service", 86400.0)


@query("write_rate", "SELECT service, count(*) FILTER (ts >= 1706227200 - 86400 AND ts <= 1706227200) / 86400.0::DOUBLE AS rate FROM lg GROUP BY service")
def write_rate(spark, sf_dir):
    return metrics.write_rate(_logs(spark, sf_dir), "service", 86400.0, 1706227200.0)


def _hourly(spark, sf_dir) -> DataFrame:
    hours = _logs(spark, sf_dir).groupBy("service", F.floor(F.col("ts") / 3600).alias("hour")).agg((F.count(F.lit(1)) / 3600.0).alias("rate"))
    return metrics.numbered(hours, ["service"], ["hour"])


_HOURS = ", hours AS (SELECT service, floor(ts / 3600)::BIGINT AS hour, count(*) / 3600.0::DOUBLE AS rate FROM lg GROUP BY 1, 2)"


@query(
    "burst_ratio",
    _HOURS + """ SELECT service, round(list_reduce(list(rate ORDER BY hour), lambda a, x: 0.5 * x + 0.5 * a) / list_reduce(list(rate ORDER BY hour), lambda a, x: 0.05 * x + 0.95 * a), 6) AS ratio
       FROM hours GROUP BY service""",
)
def burst_ratio(spark, sf_dir):
    return metrics.burst_ratio(_hourly(spark, sf_dir), "service", "_i", "rate").select("service", F.round("ratio", 6).alias("ratio"))


@query(
    "stability_counter",
    _HOURS + """, steps AS (SELECT service, hour, CASE WHEN rate * 3600 >= 3 THEN 1 ELSE -1 END AS d FROM hours)
       SELECT service, list_reduce(list_concat([0], list(d ORDER BY hour)), lambda a, x: greatest(0, least(3, a + x)))::INTEGER AS level,
              list_reduce(list_concat([0], list(d ORDER BY hour)), lambda a, x: greatest(0, least(3, a + x))) >= 3 AS stable FROM steps GROUP BY service""",
)
def stability_counter(spark, sf_dir):
    steps = _hourly(spark, sf_dir).withColumn("up", F.col("rate") * 3600 >= 3)
    return metrics.saturating(steps, "service", "_i", "up", 3)


@query(
    "burst_hysteresis",
    _HOURS + """, letters AS (SELECT service, hour, CASE WHEN rate * 3600 > 3 THEN 2 WHEN rate * 3600 < 1.5 THEN 0 ELSE 1 END AS l FROM hours),
       folded AS (SELECT service, list_reduce(list_concat([0], list(l ORDER BY hour)), lambda s, x:
         CASE WHEN s = -1 THEN CASE WHEN x = 0 THEN 0 ELSE -1 END
              WHEN (CASE WHEN x = 2 THEN s + 1 ELSE greatest(0, s - 1) END) >= 3 THEN -1
              ELSE (CASE WHEN x = 2 THEN s + 1 ELSE greatest(0, s - 1) END) END)::INTEGER AS state FROM letters GROUP BY service)
       SELECT service, state, state = -1 AS is_burst FROM folded""",
)
def burst_hysteresis(spark, sf_dir):
    return metrics.hysteresis(_hourly(spark, sf_dir).withColumn("ratio", F.col("rate") * 3600), "service", "_i", "ratio")


TICKS = [1704067200.0 + 86400 * d for d in range(1, 31)]
_HEAT = """, steps AS (
      SELECT seq, ts AS t, 1.0::DOUBLE AS x FROM lg
      UNION ALL SELECT seq, 1704067200.0::DOUBLE + 86400 * d, 0.0 FROM (SELECT DISTINCT seq FROM lg), range(1, 31) r(d)
    ), heat AS (SELECT seq, list_reduce(list(x ORDER BY t, x DESC), lambda a, x: 0.1 * x + 0.9 * a) AS temp FROM steps GROUP BY seq)"""


def _heat(spark, sf_dir) -> DataFrame:
    return metrics.heat(_logs(spark, sf_dir), TICKS)


@query("heat_temperature", _HEAT + " SELECT seq, round(temp, 6) AS temp, (SELECT max(ts) FROM lg WHERE lg.seq = heat.seq) AS last_access FROM heat")
def heat_temperature(spark, sf_dir):
    return _heat(spark, sf_dir).select("seq", F.round("temp", 6).alias("temp"), "last_access")


@query("hottest_chunks", _HEAT + " SELECT seq, round(temp, 6) AS temp FROM heat ORDER BY round(temp, 6) DESC, seq LIMIT 5")
def hottest_chunks(spark, sf_dir):
    return _heat(spark, sf_dir).select("seq", F.round("temp", 6).alias("temp")).orderBy(F.desc("temp"), "seq").limit(5)


def _query_log(spark, sf_dir) -> DataFrame:
    """Each event stands for a query: its level is the predicate, its chunk was scanned, its service's index was used."""
    return _logs(spark, sf_dir).select(
        "pos", "ts", "seq", F.lit("level").alias("field"), F.lit("=").alias("op"), F.col("level").alias("value"),
        F.array(F.concat_ws(":", F.col("seq").cast("string"), F.lit("hash"), "service")).alias("indexes_used"),
    )


@query("predicate_freq", "SELECT 'level' AS field, '=' AS op, level AS value, count(*) AS freq, max(ts) AS last_seen FROM lg GROUP BY level")
def predicate_freq(spark, sf_dir):
    return metrics.predicate_stats(_query_log(spark, sf_dir))


@query("top_predicates", "SELECT level AS value, count(*) AS freq FROM lg GROUP BY level ORDER BY freq DESC, value LIMIT 3")
def top_predicates(spark, sf_dir):
    return metrics.top_predicates(metrics.predicate_stats(_query_log(spark, sf_dir)), 3).select("value", "freq")


@query("index_usage", "SELECT seq::VARCHAR || ':hash:' || service AS index_id, count(*) AS usage, max(ts) AS last_used FROM lg GROUP BY 1")
def index_usage(spark, sf_dir):
    return metrics.index_usage(_query_log(spark, sf_dir))


@query("decay_counters", "SELECT user_id, (count(*) // 2)::BIGINT AS freq FROM lg GROUP BY user_id HAVING count(*) // 2 > 0")
def decay_counters(spark, sf_dir):
    return metrics.decay(_logs(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("freq")), "freq")


@query("misra_gries", "SELECT msg, true AS within FROM lg GROUP BY msg")
def misra_gries(spark, sf_dir):
    """Heavy hitters with their bound: never above the true count, nor further below it than rows / (k + 1)."""
    logs = _logs(spark, sf_dir)
    truth = logs.groupBy("msg").agg(F.count(F.lit(1)).alias("true_n"))
    bound = logs.agg((F.count(F.lit(1)) / 21).alias("slack"))
    found = truth.join(metrics.misra_gries(logs, "msg", 20), "msg", "left").join(F.broadcast(bound), how="cross")
    n = F.coalesce("n", F.lit(0))
    return found.select("msg", ((n <= F.col("true_n")) & (n >= F.col("true_n") - F.col("slack"))).alias("within"))


@query("cms_estimate", "SELECT level, count(*) AS n, true AS at_least_true FROM lg GROUP BY level")
def cms_estimate(spark, sf_dir):
    """Frequencies of field and operator are kept by a hash of their text; no estimate is below the true count."""
    logs = _logs(spark, sf_dir).withColumn("_key", F.xxhash64(F.concat_ws("|", F.lit("level"), "level")))
    truth = logs.groupBy("level", "_key").agg(F.count(F.lit(1)).alias("n"))
    estimated = metrics.with_estimates(truth, "_key", metrics.count_min(logs, "_key"))
    return estimated.select("level", "n", (F.col("estimate") >= F.col("n")).alias("at_least_true"))


# Decisions

def _chunk_m(spark, sf_dir) -> DataFrame:
    return _logs(spark, sf_dir).groupBy("seq").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "seq", "n", "(seq % 10) / CAST(10 AS DOUBLE) AS temp", "CASE WHEN seq % 3 = 0 THEN 'cold' ELSE 'hot' END AS tier",
        "CASE WHEN seq % 7 = 0 THEN 'sealed' ELSE 'persisted' END AS state", "1706745600D - 10 * seq AS persisted_at",
        "CASE WHEN seq % 4 = 0 THEN NULL ELSE 1706745600D - 12 * seq END AS last_access",
    )


def _pred_m(spark, sf_dir) -> DataFrame:
    return metrics.predicate_stats(_query_log(spark, sf_dir)).withColumn("freq", F.col("freq") % 10)


def _idx_m(spark, sf_dir) -> DataFrame:
    return _logs(spark, sf_dir).groupBy("seq", "level").agg(F.count(F.lit(1)).alias("c")).selectExpr(
        "seq", "concat_ws(':', CAST(seq AS STRING), 'hash', level) AS index_id", "'level' AS field", "'hash' AS kind", "2048 * c AS bytes", "c % 7 AS usage",
        "CASE WHEN seq % 5 = 0 THEN NULL ELSE 1706745600D - 90 * seq END AS last_used",
    )


def _dropped_m(spark, sf_dir) -> DataFrame:
    return _logs(spark, sf_dir).groupBy("seq").agg(F.max("ts").alias("dropped_at")).selectExpr(
        "concat_ws(':', CAST(seq AS STRING), 'hash', 'level') AS index_id", "seq", "'level' AS field", "'=' AS op", "dropped_at"
    )


_DROPPED = ", dropped_m AS (SELECT seq::VARCHAR || ':hash:level' AS index_id, seq, 'level' AS field, '=' AS op, max(ts) AS dropped_at FROM lg GROUP BY seq)"


@query("roi", "SELECT index_id, roi FROM idx_roi")
def roi(spark, sf_dir):
    return _idx_m(spark, sf_dir).select("index_id", decisions.roi().alias("roi"))


@query("roi_by_tier", "SELECT index_id, CASE WHEN seq % 3 = 0 THEN roi * 100 ELSE roi END AS roi FROM (SELECT index_id, seq, CASE WHEN usage <= 0 THEN 0.0::DOUBLE WHEN seq % 3 = 0 THEN usage / (bytes / 1024.0::DOUBLE / 100) / 100 ELSE usage / (bytes / 1024.0::DOUBLE) END AS roi FROM idx_m)".replace("CASE WHEN seq % 3 = 0 THEN roi * 100 ELSE roi END AS roi", "round(CASE WHEN seq % 3 = 0 THEN roi * 100 ELSE roi END, 9) AS roi"))
def roi_by_tier(spark, sf_dir):
    tiered = _idx_m(spark, sf_dir).withColumn("tier", F.when(F.col("seq") % 3 == 0, "cold").otherwise("hot"))
    return tiered.select("index_id", F.round(decisions.roi(tier="tier"), 9).alias("roi"))


@query("choose_index", "SELECT DISTINCT 'level' AS field, op, CASE WHEN op IN ('=', 'in') THEN 'hash' END AS kind FROM (VALUES ('='), ('in'), ('exists'), ('range')) t(op) UNION ALL SELECT 'ts', 'range', 'skip'")
def choose_index(spark, sf_dir):
    rows = [("level", op) for op in ("=", "in", "exists", "range")] + [("ts", "range")]
    return spark.createDataFrame(rows, "field string, op string").withColumn("kind", decisions.kind_for())


@query("should_build", "SELECT DISTINCT seq, 'level' AS field, '=' AS op, 'hash' AS kind FROM chunk_m, pred_m WHERE temp >= 0.3 AND tier = 'hot' AND freq >= 5")
def should_build(spark, sf_dir):
    return decisions.should_build(_chunk_m(spark, sf_dir), _pred_m(spark, sf_dir), False)


@query("should_drop", "SELECT index_id FROM idx_roi WHERE (idle > 600 AND roi < 0.1)")
def should_drop(spark, sf_dir):
    return decisions.should_drop(_idx_m(spark, sf_dir), NOW, 0.3).select("index_id")


@query("should_drop_pressed", "SELECT index_id FROM idx_roi WHERE (idle > 600 AND roi < 0.1) OR idle > 60")
def should_drop_pressed(spark, sf_dir):
    return decisions.should_drop(_idx_m(spark, sf_dir), NOW, 0.75).select("index_id")


@query(
    "should_restore",
    _DROPPED + """ SELECT index_id, dropped_at FROM dropped_m, (SELECT sum(freq) AS freq, max(last_seen) AS last_seen FROM pred_m)
       WHERE 1706745600 - dropped_at <= 864000 AND last_seen > dropped_at AND freq >= 5""",
)
def should_restore(spark, sf_dir):
    return decisions.should_restore(_dropped_m(spark, sf_dir), _pred_m(spark, sf_dir), NOW, Config(cooldown_sec=864000.0)).select("index_id", "dropped_at")


@query("expired_tombstones", _DROPPED + " SELECT index_id FROM dropped_m WHERE 1706745600 - dropped_at > 864000")
def expired_tombstones(spark, sf_dir):
    return decisions.expired(_dropped_m(spark, sf_dir), NOW, Config(cooldown_sec=864000.0)).select("index_id")


_DEMOTE = "tier = 'hot' AND state = 'persisted' AND 1706745600 - persisted_at >= 30 AND temp < 0.1 AND (last_access IS NULL OR 1706745600 - last_access > 90)"


@query("should_demote", f"SELECT seq FROM chunk_m WHERE {_DEMOTE}")
def should_demote(spark, sf_dir):
    return decisions.should_demote(_chunk_m(spark, sf_dir), NOW).select("seq")


@query("should_promote", "SELECT seq FROM chunk_m WHERE tier = 'cold' AND temp > 0.5")
def should_promote(spark, sf_dir):
    return decisions.should_promote(_chunk_m(spark, sf_dir)).select("seq")


@query("should_evict_heavy", "SELECT index_id FROM idx_roi WHERE bytes >= 102400 AND idle > 60")
def should_evict_heavy(spark, sf_dir):
    return decisions.should_evict_heavy(_idx_m(spark, sf_dir), NOW, 0.75).select("index_id")


_RANKED = ", ranked AS (SELECT seq, row_number() OVER (ORDER BY temp, seq) AS r, count(*) OVER () AS n FROM chunk_m WHERE tier = 'hot' AND state = 'persisted')"


@query("relief_plan", _RANKED + " SELECT 'demote' AS action, seq::VARCHAR AS target, 15 AS priority FROM ranked WHERE r <= greatest(1, n // 4)")
def relief_plan(spark, sf_dir):
    return decisions.relief(_chunk_m(spark, sf_dir), _idx_m(spark, sf_dir), NOW, 0.75)


@query(
    "relief_high",
    _RANKED + """ SELECT 'demote' AS action, seq::VARCHAR AS target, 10 AS priority FROM ranked WHERE r <= greatest(1, n // 2)
       UNION ALL SELECT 'evict', index_id, 8 FROM idx_roi WHERE bytes >= 102400 AND idle > 60""",
)
def relief_high(spark, sf_dir):
    return decisions.relief(_chunk_m(spark, sf_dir), _idx_m(spark, sf_dir), NOW, 0.9)


@query(
    "relief_critical",
    _RANKED + """ SELECT 'demote' AS action, seq::VARCHAR AS target, 5 AS priority FROM ranked
       UNION ALL SELECT 'drop', index_id, 1 FROM (SELECT index_id, row_number() OVER (ORDER BY roi DESC, index_id DESC) AS b FROM idx_roi) WHERE b > 3""",
)
def relief_critical(spark, sf_dir):
    return decisions.relief(_chunk_m(spark, sf_dir), _idx_m(spark, sf_dir), NOW, 0.97)


@query(
    "hot_cap",
    """SELECT seq FROM (SELECT seq, row_number() OVER (ORDER BY temp, last_access NULLS FIRST, seq) AS r FROM chunk_m WHERE tier = 'hot' AND state = 'persisted')
       WHERE r <= (SELECT count(*) FROM chunk_m WHERE tier = 'hot') - 4""",
)
def hot_cap(spark, sf_dir):
    return decisions.over_cap(_chunk_m(spark, sf_dir), config=replace(Config(), max_hot_chunks=4)).select("seq")


_PLAN = f"""{_DROPPED}, plan AS (
      SELECT 'build' AS action, seq::VARCHAR || ':hash:level' AS target, 30 AS priority, 2 AS plan_seq
      FROM (SELECT DISTINCT seq FROM chunk_m, pred_m WHERE temp >= 0.3 AND tier = 'hot' AND freq >= 5)
      WHERE seq NOT IN (SELECT seq FROM idx_m) AND seq NOT IN (SELECT seq FROM dropped_m)
      UNION ALL SELECT 'restore', index_id, 30, 1 FROM dropped_m, (SELECT sum(freq) AS freq, max(last_seen) AS last_seen FROM pred_m)
      WHERE 1706745600 - dropped_at <= 864000 AND last_seen > dropped_at AND freq >= 5
      UNION ALL SELECT 'promote', seq::VARCHAR, 25, 3 FROM chunk_m WHERE tier = 'cold' AND temp > 0.5
      UNION ALL SELECT 'demote', seq::VARCHAR, 20, 4 FROM chunk_m WHERE {_DEMOTE}
      UNION ALL SELECT 'drop', index_id, 50, 5 FROM idx_roi WHERE (idle > 600 AND roi < 0.1)
    )"""


_TICK = Config(max_hot_chunks=0, cooldown_sec=864000.0)


def _snapshot(spark, sf_dir) -> tick.Snapshot:
    return tick.Snapshot(NOW, _chunk_m(spark, sf_dir), _pred_m(spark, sf_dir), _idx_m(spark, sf_dir), _dropped_m(spark, sf_dir), pressure=0.3)


@query("tick_plan", _PLAN + " SELECT * FROM plan")
def tick_plan(spark, sf_dir):
    return tick.plan(_snapshot(spark, sf_dir), _TICK).select("action", "target", "priority", "plan_seq")


@query(
    "action_budget",
    _PLAN + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY action IN ('build', 'restore') ORDER BY priority, plan_seq, target) AS b FROM plan)
       SELECT action, target, priority, plan_seq FROM ranked WHERE action NOT IN ('build', 'restore') OR b <= 3 ORDER BY priority, plan_seq, target LIMIT 10""",
)
def action_budget(spark, sf_dir):
    return tick.tick(_snapshot(spark, sf_dir), _TICK).select("action", "target", "priority", "plan_seq")


@query(
    "decision_events",
    _PLAN + """ SELECT CASE WHEN action IN ('promote', 'demote') THEN 'tier_change' ELSE 'decision' END AS type,
       CASE WHEN action IN ('promote', 'demote') THEN action ELSE action || '_index' END AS action, target,
       CASE action WHEN 'promote' THEN 'cold' WHEN 'demote' THEN 'hot' END AS tier_from, CASE action WHEN 'promote' THEN 'hot' WHEN 'demote' THEN 'cold' END AS tier_to FROM plan""",
)
def decision_events(spark, sf_dir):
    return tick.events_of(tick.plan(_snapshot(spark, sf_dir), _TICK), NOW).select("type", "action", "target", "tier_from", "tier_to")


@query("drop_reasons", "SELECT index_id, 'idle=' || CASE WHEN last_used IS NULL THEN 'inf' ELSE printf('%.0f', idle) END || 's, roi=' || printf('%.3f', roi) AS reason FROM idx_roi")
def drop_reasons(spark, sf_dir):
    return tick.drop_reasons(_idx_m(spark, sf_dir), NOW)


@query(
    "static_builds",
    """SELECT seq, field, kind FROM chunk_m, (VALUES ('service', 'hash'), ('level', 'hash'), ('ts', 'skip')) t(field, kind)
       WHERE state != 'open' AND tier = 'hot' AND n > 0 AND NOT (field = 'level' AND seq IN (SELECT seq FROM idx_m))""",
)
def static_builds(spark, sf_dir):
    return tick.static_builds(_snapshot(spark, sf_dir), Config(static_indexes=("service", "level", "ts"))).select("seq", "field", "kind")


# The engine over tables of its own

def _engine(spark, config: Config = Config()) -> tuple[Engine, list[float]]:
    """An empty engine and its clock, whose one number is the present."""
    clock = [NOW]
    return Engine(spark, f"{scratch_dir(spark)}/engine-{uuid.uuid4().hex}", config, clock=lambda: clock[0]), clock


@query("indexed_after_load", "SELECT pos, service FROM lg WHERE level = 'ERROR'")
def indexed_after_load(spark, sf_dir):
    """Chunks that are loaded after an index was built are scanned; those before are looked up."""
    engine, _ = _engine(spark)
    logs = _logs(spark, sf_dir)
    engine.load(logs.where("ts < 1705400000"))
    engine.build_index("hash", "level")
    engine.load(logs.where("ts >= 1705400000"))  # one chunk gets more rows
    return engine.find('level = "ERROR"').select("pos", "service")


@query("hash_lookup_variant", "SELECT pos, service FROM lg WHERE k IN (7, 9)")
def hash_lookup_variant(spark, sf_dir):
    """A hash index on a key of the open map."""
    logs = _logs(spark, sf_dir).select("pos", "ts", "service", "level", "msg", "seq", F.parse_json("props").alias("fields"))
    index = indexes.make_index("hash", "k")
    leaf = ir.Predicate("k", ir.IN, (7, 9))
    return search.run(ir.Query(leaf), index.lookup(index.build(logs), logs, leaf)).select("pos", "service")


@query("hash_lookup_mixed_in", "SELECT pos, service FROM lg WHERE user_id IN (7, 9)")
def hash_lookup_mixed_in(spark, sf_dir):
    """Literals of a type that the field never has match nothing, with an index as without."""
    logs = _logs(spark, sf_dir)
    index = indexes.make_index("hash", "user_id")
    leaf = ir.Predicate("user_id", ir.IN, (7, "x", 9))
    return index.lookup(index.build(logs), logs, leaf).select("pos", "service")


@query("bloom_gate_variant", "SELECT pos, service FROM lg WHERE k = 7")
def bloom_gate_variant(spark, sf_dir):
    logs = _logs(spark, sf_dir).select("pos", "ts", "service", "level", "msg", "seq", F.parse_json("props").alias("fields"))
    index = indexes.make_index("bloom", "k")
    leaf = ir.Predicate("k", ir.EQ, 7)
    return search.run(ir.Query(leaf), index.lookup(index.build(logs), logs, leaf)).select("pos", "service")


def _asked(spark, sf_dir, config: Config = Config()) -> tuple[Engine, list[float]]:
    """An engine that was asked six times for a service, three of them in a span of time."""
    engine, clock = _engine(spark, config)
    engine.load(_logs(spark, sf_dir))
    for k in range(6):
        clock[0] = NOW + k
        engine.find('service = "svc-1"', time_range=(1704500000.0, 1704600000.0) if k % 2 else None)
    return engine, clock


_ASKED = ", touched AS (SELECT seq, n_rows, row_number() OVER (ORDER BY seq DESC) <= 32 AS hot FROM hd)"


@query(
    "snapshot_from_tables",
    _ASKED + """ SELECT seq, n_rows AS n, round(0.9::DOUBLE * (1 - (1 - 0.9::DOUBLE) * 0.9::DOUBLE), 9) AS temp, CASE WHEN hot THEN 'hot' ELSE 'cold' END AS tier,
       'persisted' AS state, 1706745600.0::DOUBLE + 20 AS last_access FROM touched""",
)
def snapshot_from_tables(spark, sf_dir):
    """Heat after two turns: what was asked in the first heats to 1 and cools, then one more query and another turn."""
    engine, clock = _asked(spark, sf_dir)
    for moment, text in ((10, None), (20, 'level = "ERROR"')):
        clock[0] = NOW + moment
        if text:
            engine.find(text)
        engine.ticks += 1
        engine.absorb(clock[0])
    table = engine.snapshot(clock[0]).chunks
    return table.select("seq", "n", F.round("temp", 9).alias("temp"), "tier", "state", "last_access")


@query("predicates_from_tables", "SELECT 'service' AS field, '=' AS op, chr(39) || 'svc-1' || chr(39) AS value, 6::BIGINT AS freq, 1706745605.0::DOUBLE AS last_seen")
def predicates_from_tables(spark, sf_dir):
    engine, clock = _asked(spark, sf_dir)
    engine.ticks += 1
    engine.absorb(NOW + 10)
    return engine.predicates.read()


@query(
    "tick_end_to_end",
    _ASKED + """ SELECT 'decision' AS type, 'build_index' AS action, target, 'active' AS status FROM
       (SELECT seq::VARCHAR || ':hash:service' AS target FROM touched WHERE hot ORDER BY target LIMIT 3)""",
)
def tick_end_to_end(spark, sf_dir):
    """Asked often enough, a turn builds as many indexes as it may, and the catalog has them."""
    engine, clock = _asked(spark, sf_dir)
    events = engine.tick(NOW + 10)
    listed = engine.catalog.read().select(F.col("index_id").alias("target"), F.lit("active").alias("status"))
    return events.select("type", "action", "target").join(listed, "target", "left").select("type", "action", "target", "status")


@query("find_after_tick", "SELECT pos, level FROM lg WHERE service = 'svc-1'")
def find_after_tick(spark, sf_dir):
    """Some chunks indexed, some in memory, the rest on disk: the rows are the same."""
    engine, clock = _asked(spark, sf_dir)
    engine.tick(NOW + 10)
    engine.demote(2)
    return engine.find('service = "svc-1"').select("pos", "level")


@query("tombstone_expiry", "SELECT seq::VARCHAR || ':hash:service' AS index_id, 1706745600.0::DOUBLE + 500 AS dropped_at FROM hd")
def tombstone_expiry(spark, sf_dir):
    """Dropped 650 and 150 seconds before a turn; the cooldown is 600."""
    engine, clock = _engine(spark)
    engine.load(_logs(spark, sf_dir))
    for field, moment in (("level", NOW), ("service", NOW + 500)):
        engine.build_index("hash", field)
        engine.drop_index("hash", field, now=moment)
    engine.tick(NOW + 650)
    return engine.tombstones.read().select("index_id", "dropped_at")


# Views

@query("engine_state", "SELECT (SELECT count(*) FROM chunk_m) AS n_chunks, (SELECT count(*) FROM chunk_m WHERE state IN ('sealed', 'persisted')) AS n_sealed, (SELECT count(DISTINCT seq) FROM idx_m) AS n_indexed")
def engine_state(spark, sf_dir):
    return views.engine_state(_chunk_m(spark, sf_dir), _idx_m(spark, sf_dir))


@query("metric_tick", "SELECT 'metric_tick' AS type, 1706745600.0::DOUBLE AS ts, 0.5::DOUBLE AS write_rate, 1.0::DOUBLE AS burst_ratio, 0.3::DOUBLE AS memory_pressure, (SELECT count(*) FROM chunk_m) AS n_chunks, (SELECT count(*) FROM chunk_m WHERE state = 'sealed') AS n_sealed, (SELECT count(DISTINCT seq) FROM idx_m) AS n_indexed")
def metric_tick(spark, sf_dir):
    return views.metric_tick(_chunk_m(spark, sf_dir), _idx_m(spark, sf_dir), NOW, 0.5, 1.0, 0.3)


@query("chunk_list", "SELECT hd.seq, hd.n_rows, coalesce(m.temp, 0.0) AS temp FROM hd LEFT JOIN (SELECT * FROM chunk_m WHERE seq % 2 = 0) m ON hd.seq = m.seq")
def chunk_list(spark, sf_dir):
    warm = _chunk_m(spark, sf_dir).where("seq % 2 = 0")
    return views.chunk_list(chunks.headers(_logs(spark, sf_dir)), warm).select("seq", "n_rows", "temp")


@query("index_list", _DROPPED + " SELECT index_id, kind, 'active' AS status FROM idx_m UNION ALL SELECT index_id, NULL, 'dropped' FROM dropped_m")
def index_list(spark, sf_dir):
    return views.index_list(_idx_m(spark, sf_dir), _dropped_m(spark, sf_dir)).select("index_id", "kind", "status")


@query("index_type_hist", "SELECT kind, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM idx_m GROUP BY kind")
def index_type_hist(spark, sf_dir):
    return views.index_histogram(_idx_m(spark, sf_dir))


@query("tier_state_counts", "SELECT tier, state, count(*) AS n FROM chunk_m GROUP BY tier, state")
def tier_state_counts(spark, sf_dir):
    return views.tier_state_counts(_chunk_m(spark, sf_dir))


@query("chunk_filter", "SELECT seq FROM chunk_m WHERE tier = 'hot' AND state = 'sealed'")
def chunk_filter(spark, sf_dir):
    return _chunk_m(spark, sf_dir).where("tier = 'hot' AND state = 'sealed'").select("seq")


@query("chunk_sort", "SELECT m.seq, row_number() OVER (ORDER BY CASE state WHEN 'open' THEN 0 WHEN 'sealed' THEN 1 ELSE 2 END, ts_min DESC, m.seq)::INTEGER AS place FROM chunk_m m JOIN hd ON m.seq = hd.seq")
def chunk_sort(spark, sf_dir):
    joined = _chunk_m(spark, sf_dir).join(chunks.headers(_logs(spark, sf_dir)).select("seq", "ts_min"), "seq")
    return views.chunk_order(joined).select("seq", "place")


@query("index_sort_nulls_last", "SELECT index_id, last_used, row_number() OVER (ORDER BY last_used DESC NULLS LAST, index_id)::INTEGER AS place FROM idx_m")
def index_sort_nulls_last(spark, sf_dir):
    ordered = Window.orderBy(F.col("last_used").desc_nulls_last(), "index_id")
    return views.sorted_nulls_last(_idx_m(spark, sf_dir), "last_used", True).select("index_id", "last_used", F.row_number().over(ordered).alias("place"))


@query("recent_decisions", "SELECT pos, level FROM lg ORDER BY ts DESC, pos DESC LIMIT 200")
def recent_decisions(spark, sf_dir):
    return views.recent(_logs(spark, sf_dir).select("pos", "ts", "level")).select("pos", "level")


@query("series_tail", "SELECT service, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY pos DESC) AS r FROM lg) WHERE r <= 150")
def series_tail(spark, sf_dir):
    return views.series_tail(_logs(spark, sf_dir).select("service", "pos", "value"), "service", "pos")


@query("predicate_labels", "SELECT field || op || CASE WHEN length(v) > 3 THEN left(v, 3) || '…' ELSE v END AS label, freq FROM (SELECT *, value AS v FROM pred_m)")
def predicate_labels(spark, sf_dir):
    return views.predicate_labels(_pred_m(spark, sf_dir), 3).select("label", "freq")


@query("pressure_bucket", "SELECT seq, CASE WHEN temp < 0.7 THEN 'normal' WHEN temp < 0.9 THEN 'elevated' ELSE 'critical' END AS pressure_level, CASE WHEN temp < 0.05 THEN 'cold' ELSE 'warm' END AS heat_level FROM chunk_m")
def pressure_bucket(spark, sf_dir):
    return _chunk_m(spark, sf_dir).select("seq", views.pressure_bucket("temp").alias("pressure_level"), views.heat_bucket().alias("heat_level"))


# Streaming

@query("stream_ingest", "SELECT service, count(*) AS n, min(ts) AS ts_min, max(ts) AS ts_max FROM lg WHERE level = 'ERROR' GROUP BY service")
def stream_ingest(spark, sf_dir):
    """Events through a landing folder and the stream, and found by a text query over the chunks that it sealed."""
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    landing = _logs(spark, sf_dir).select("ts", "service", "level", "msg", "props")
    landing.repartition(4).write.parquet(f"{root}/landing")
    source = spark.readStream.schema(landing.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/landing")
    streaming.ingest(source, root, NOW).awaitTermination()
    found = Engine(spark, root, clock=lambda: NOW).find('level = "ERROR"')
    return found.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"))
