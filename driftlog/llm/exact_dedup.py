"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.session import discard, written

#: Keys to drop up to so many (some 60 bytes each) are broadcast, more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_fn: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Membership of every row in its group of byte-identical texts.

    Returns ``id, keep_id, group_size, kept, text_sha256``, a row per input row.

    Null texts count as empty, and all empty texts form one group. ``keep`` says whether the smallest
    or the largest id stays. Rows that repeat both id and text are members of one group: each is
    returned, each counts in ``group_size``, and rows of the kept id are all marked kept. A null id never stays unless its whole group has null
    ids. An empty table gives an empty result; columns beyond id and text are ignored, so their names
    can't clash.

    Only ids and hashes are shuffled for the groups. Texts move just for rows whose hash occurs
    twice, and they are reduced before the shuffle to the least and the greatest text of a hash, which
    are equal exactly if all bytes are. Hashes that fail that test are split by the text itself.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.max if keep == "largest" else F.min
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), hash_fn(text).alias("_h"))
    keys = written(base.select("_id", "_h", F.unhex(F.sha2("_text", 256)).alias("_sha")), "exact-keys")

    groups = keys.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep"))
    multi = written(groups.where("_n > 1"), "exact-groups")
    collided = written(
        base.join(multi.select("_h"), "_h", "left_semi")
        .groupBy("_h")
        .agg(F.min("_text").alias("_lo"), F.max("_text").alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select("_h"),
        "exact-collisions",
    )
    clean = keys.join(multi, "_h", "left")
    if not collided.isEmpty():
        # One hash, several texts: the text joins the key for these rows.
        members = base.join(collided, "_h", "left_semi")
        split = members.groupBy("_h", "_text").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep"))
        resolved = members.select("_id", "_h", "_text", F.unhex(F.sha2("_text", 256)).alias("_sha")).join(
            split, ["_h", "_text"]
        )
        clean = clean.join(collided, "_h", "left_anti").unionByName(resolved.drop("_text"))
    keep_id = F.coalesce(F.col("_keep"), F.col("_id"))
    return clean.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce(F.col("_n"), F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``docs`` with one row of each text, that of the smallest or largest id; columns as they came.

    Rows go by id and text, so an id with several texts loses only those that another row keeps. Of rows that repeat the
    kept id along with its text one is left, whichever comes first; null counts as empty. Only ids and hashes to drop are joined,
    so texts are not shuffled while those are few; texts of repeated rows are.
    """
    rows = written(exact_groups(docs, id_col, text_col, keep).select(F.col(id_col).alias("_id"), "kept", F.unhex("text_sha256").alias("_sha")), "exact-rows")
    few = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    gone = written(rows.where("NOT kept").select("_id", "_sha").distinct(), "exact-dropped")
    twice = written(rows.where("kept").groupBy("_id", "_sha").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("_id", "_sha"), "exact-twice")
    discard(rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.unhex(F.sha2(text, 256)) == F.col("_sha"))
    kept = docs.join(few(gone), same, "left_anti")
    if twice.isEmpty():
        return kept
    twice = few(twice)
    again = kept.join(twice, same, "left_semi").withColumn("_text", text).dropDuplicates([id_col, "_text"]).drop("_text")
    return kept.join(twice, same, "left_anti").unionByName(again)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; the largest doc_id of equal texts stays."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
