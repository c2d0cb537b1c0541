"""Line dedup by the spread of a line over distinct sites.

A HyperLogLog sketch of the sites of each line hash is merged by aggregation. Lines whose estimate is
clearly below or above the threshold are decided by it; those near it get an exact distinct count. Lines
on many sites are boilerplate and are removed from every document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.shingles import Shingler, _mix
from driftlog.llm.text_buffers import filled, flat, slices
from driftlog.session import lean, ship_package, written

#: Log2 of a sketch's registers; its relative standard error is about 1.04 / sqrt(2 ** LOG_REGISTERS).
LOG_REGISTERS = 10
#: Lines are decided by their estimate alone if it is this many standard errors (and a site) off the threshold.
STANDARD_ERRORS = 4
#: Boilerplate hashes up to so many are broadcast, more are joined by shuffle.
BROADCAST_LINES = 2_000_000


def line_hashes(data: np.ndarray, bounds: np.ndarray, shingler: Shingler) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines: row, start and end in the bytes, and hash; blank lines have hash 0.

    A hash is that of the line's words in order, so case of A-Z and white space around words don't count.
    """
    rows = len(bounds) - 1
    breaks = np.flatnonzero(data == 0x0A)
    # A break at a row's last byte opens an empty line that starts where the next row does, but belongs to the row before.
    per_row = np.diff(np.searchsorted(breaks, bounds)) + 1
    row = np.repeat(np.arange(rows), per_row)
    order = np.lexsort((np.r_[bounds[:-1], breaks + 1], np.r_[np.arange(rows), np.searchsorted(bounds, breaks, side="right") - 1]))
    starts = np.r_[bounds[:-1], breaks + 1][order]
    last = np.r_[row[1:] != row[:-1], True] if rows else np.zeros(0, bool)
    ends = np.where(last, bounds[1:][row], np.r_[starts[1:], 0] - 1) if rows else starts
    words, counts = shingler.word_hashes(data, np.unique(np.r_[starts, bounds[-1:]])) if len(data) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    # word_hashes counts by distinct starts; empty lines at equal starts get none.
    edges = np.unique(np.r_[starts, bounds[-1:]])
    owner = np.repeat(np.arange(len(counts)), counts)
    rank = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    mixed = _mix(words + _mix(rank.astype(np.uint64) + np.uint64(1)))
    total = np.r_[np.uint64(0), np.cumsum(mixed)]
    ends_of = np.cumsum(counts)
    sums = np.where(counts > 0, _mix(total[ends_of] - total[ends_of - counts] + counts.astype(np.uint64)), np.uint64(0))
    by_start = np.zeros(len(starts), np.uint64)
    full = ends > starts
    at = np.searchsorted(edges, starts)
    by_start[full] = sums[at[full]]
    return row, starts, ends, by_start


@lean
def spread_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, text) to distinct (line, site) of each part of the input; null sites are the empty name's."""
    shingler = Shingler(1)
    for whole in batches:
        for batch in slices(whole, 1, 1 << 20):
            data, bounds = flat(filled(batch.column(1)))
            row, _, _, line = line_hashes(data, bounds, shingler)
            names, site = np.unique(np.array(filled(batch.column(0)).to_pylist(), dtype=object), return_inverse=True)
            pair = np.unique(np.c_[line.view(np.int64), site[row]][line != 0], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(names[pair[:, 1]], pa.string())], names=["line", "site"])


@lean
def clean_batches(batches: Iterable[pa.RecordBatch], lines) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n_lines, n_removed, text without the given lines)."""
    bad = lines.value
    shingler = Shingler(1)
    for whole in batches:
        for batch in slices(whole, 1, 1 << 20):
            data, bounds = flat(filled(batch.column(1)))
            row, starts, ends, line = line_hashes(data, bounds, shingler)
            gone = np.isin(line, bad) & (line != 0) if len(bad) else np.zeros(len(line), bool)
            yield _cleaned(batch.column(0), data, bounds, row, starts, ends, gone)


@lean
def clean_given_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, array of lines to remove) to the same as ``clean_batches``."""
    shingler = Shingler(1)
    for whole in batches:
        for batch in slices(whole, 1, 1 << 20):
            data, bounds = flat(filled(batch.column(1)))
            row, starts, ends, line = line_hashes(data, bounds, shingler)
            gone = np.zeros(len(line), bool)
            for k, bad in enumerate(batch.column(2).to_pylist()):
                if bad:
                    mine = row == k
                    gone[mine] = np.isin(line[mine], np.array(bad, np.int64).view(np.uint64))
            yield _cleaned(batch.column(0), data, bounds, row, starts, ends, gone & (line != 0))


def _cleaned(ids, data, bounds, row, starts, ends, gone) -> pa.RecordBatch:
    raw = data.tobytes()
    rows = len(bounds) - 1
    removed = np.bincount(row[gone], minlength=rows)
    texts = []
    first = np.searchsorted(row, np.arange(rows + 1))
    for k in range(rows):
        if removed[k]:
            texts.append(b"\n".join(raw[starts[i] : ends[i]] for i in range(first[k], first[k + 1]) if not gone[i]))
        else:
            texts.append(raw[bounds[k] : bounds[k + 1]])
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(first).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())],
        names=["id", "n_lines", "n_removed", "text"],
    )


def boilerplate_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = 10) -> DataFrame:
    """``line, n_sites`` of the line hashes that stand on at least ``min_sites`` distinct sites.

    ``n_sites`` is exact near the threshold and an estimate well above it. Null texts have no lines; blank
    lines never count; null sites are one site of their own, that of the empty name.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(docs[site_col].cast("string").alias("site"), docs[text_col].cast("string").alias("text"))
    spread = written(rows.mapInArrow(spread_batches, "line long, site string"), "line-spread")
    error = STANDARD_ERRORS * 1.04 / 2 ** (LOG_REGISTERS / 2) * min_sites + 1
    # One row a site and task is left of a line, however common; lines with fewer rows than sites wanted need no sketch.
    counted = spread.groupBy("line").agg(F.count(F.lit(1)).alias("rows"))
    enough = written(counted.where(F.col("rows") >= min_sites).select("line"), "line-often")
    sketched = (
        spread.join(enough, "line", "left_semi")
        .groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"))
        .select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    estimated = written(sketched.where(F.col("sites") >= min_sites - error), "line-estimates")
    near = estimated.where(F.col("sites") <= min_sites + error).select("line")
    exact = (
        spread.join(near, "line", "left_semi").groupBy("line", "site").agg(F.first("line").alias("_")).groupBy("line")
        .agg(F.count(F.lit(1)).alias("n_sites")).where(F.col("n_sites") >= min_sites)
    )
    return written(estimated.where(F.col("sites") > min_sites + error).select("line", F.col("sites").alias("n_sites")).unionByName(exact), "line-boilerplate")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = 10) -> DataFrame:
    """``id, n_lines, n_removed, text`` of every row, its text without the lines that stand on many sites.

    A line is what stands between line feeds; lines are equal if their words are, regardless of the case of
    A-Z and of white space. Repeats of a line on one site count once; all its places go if it is boilerplate. Null
    and empty texts have one empty line, which stays. Repeated and null ids keep their rows. An empty
    table gives an empty result; other columns are ignored. Texts that lose nothing are returned byte by byte.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bad = boilerplate_lines(docs, site_col, text_col, min_sites).select("line")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, n_lines long, n_removed long, text string"
    if bad.count() <= BROADCAST_LINES:
        lines = spark.sparkContext.broadcast(np.sort(bad.toArrow()["line"].to_numpy().view(np.uint64)))
        out = rows.mapInArrow(lambda b: clean_batches(b, lines), shape)
    else:
        out = _clean_by_join(rows, bad, shape)
    return out.withColumnRenamed("id", id_col)


@lean
def row_line_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to distinct (line, key)."""
    shingler = Shingler(1)
    for whole in batches:
        for batch in slices(whole, 1, 1 << 20):
            data, bounds = flat(filled(batch.column(1)))
            row, _, _, line = line_hashes(data, bounds, shingler)
            pair = np.unique(np.c_[line.view(np.int64), row][line != 0], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), batch.column(0).take(pa.array(pair[:, 1]))], names=["line", "key"])


def _clean_by_join(rows: DataFrame, bad: DataFrame, shape: str) -> DataFrame:
    """For more boilerplate than may be broadcast: the lines to remove meet each text by its hash."""
    keyed = rows.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    places = keyed.select("key", "text").mapInArrow(row_line_batches, "line long, key string").distinct().join(bad, "line", "left_semi")
    lists = places.groupBy("key").agg(F.collect_list("line").alias("gone"))
    return keyed.join(lists, "key", "left").select("id", "text", "gone").mapInArrow(clean_given_batches, shape)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least 10 of their sources share."""
    cleaned = remove_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))
