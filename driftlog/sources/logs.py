"""Where rows of logs come from and go to: the events table, landing JSON, chunk tables, compressed JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")
LANDING_SCHEMA = "ts double, service string, level string, msg string, fields variant"


def events_as_logs(spark: SparkSession, sf_dir: str, chunk_rows: int = 500) -> DataFrame:
    """The events table as logs: ``pos, ts, service, level, msg``, typed fields, and the chunk ``seq``."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS pos",
        "CAST(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS DOUBLE) / 1e6D AS ts",
        "concat('svc-', CAST(user_id % 6 AS STRING)) AS service",
        "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level",
        "event_type AS msg",
        "user_id",
        "value",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        "CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(get_json_object(props, '$.k') AS BIGINT) END AS opt_k",
        "props",
        f"CAST(event_id DIV {chunk_rows} AS INT) AS seq",
    )


def valid(now: float):
    """What a row must hold to be taken in."""
    return F.coalesce(
        F.col("ts").between(0, now + 86400)
        & F.length("service").between(1, 128)
        & F.col("level").isin(*LEVELS)
        & (F.length("msg") <= 10_000),
        F.lit(False),
    )


def split_valid(rows: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and those for quarantine."""
    return rows.where(valid(now)), rows.where(~valid(now))


def read_landing(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Landing folder of JSON lines; bad lines give null rows, which validation quarantines."""
    if not streaming:
        return spark.read.schema(LANDING_SCHEMA).option("mode", "PERMISSIVE").json(path)
    reader = spark.readStream.schema(LANDING_SCHEMA).option("mode", "PERMISSIVE")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def write_chunks(logs: DataFrame, path: str, mode: str = "append", bloom_fields: tuple[str, ...] = ()) -> None:
    """Chunk table: Parquet files of many whole chunks each, in order of chunk and time, so that file and page statistics
    skip by ``seq`` and ``ts``. A file a chunk would be millions of small files."""
    writer = logs.repartitionByRange("seq").sortWithinPartitions("seq", "ts", "pos").write.mode(mode).option("compression", "zstd")
    for field in bloom_fields:
        writer = writer.option(f"parquet.bloom.filter.enabled#{field}", "true")
    writer.parquet(path)


def export_json_lines(logs: DataFrame, path: str) -> None:
    """Compressed JSON lines by chunk, for other tools."""
    logs.repartition("seq").sortWithinPartitions("seq", "pos").write.mode("overwrite").option("compression", "gzip").partitionBy("seq").json(path)


def import_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reads what ``export_json_lines`` wrote; lines that don't parse are dropped, positions are kept in the rows."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    # The parser notices a bad line only if it is asked for a column of the line itself: the first must be there.
    parsed = F.col(rows.columns[0]).isNotNull()
    return rows.where(F.col("_corrupt_record").isNull() & parsed).drop("_corrupt_record")
