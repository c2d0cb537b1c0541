"""Embedding near-dedup by a pivot-permutation index.

Reference points (pivots) are a bounded sample of all vectors. A vector is described by its nearest pivots in
order, and posted to inverted lists. Two vectors that share enough pivots are candidates, which the cosine in
double precision then decides.

Of two such vectors the smallest shared pivot is among the first of each, so a vector is posted under those only. A list
that is too long is split by the next shared pivot, which is among the first few more, as long as that makes it shorter; what
still is too long (a dense family) is cut to tiles. A pair counts in one list: that of its smallest shared pivots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.components import components
from driftlog.llm.text_buffers import unit_hash
from driftlog.session import discard, lean, ship_package, written

#: Pivots of a vector's description, and how many of them two candidates share at least.
NEAREST, SHARED = 10, 4
#: Pivots: PIVOT_RATE times the root of the number of vectors, within these bounds; fewer of very long vectors.
PIVOT_RATE, LEAST_PIVOTS, MOST_PIVOTS, PIVOT_BYTES = 4.0, 32, 4096, 64 << 20
#: Pivots are further apart than this cosine, so that a dense family doesn't take most of them.
APART = 0.8
#: Vectors of a list that one task holds at most twice, on average; longer lists are split, then cut to tiles.
TILE = 1000
#: Pivots that name a list, at most; a list is split if its largest part has no more than this share of it.
DEPTH, WORTH = 3, 0.5


@lean
def vector_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) to (id, label, dim, digest, vector as doubles); null digests mark vectors that can't link."""
    for batch in batches:
        dims, digests, blobs = [], [], []
        column = batch.column(2)
        labels = batch.column(1).is_valid().to_pylist()
        for k in range(batch.num_rows):
            value = column[k].values if column[k].is_valid else None
            usable = labels[k] and value is not None and len(value) and not value.null_count
            v = value.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if usable else None
            if v is not None and np.isfinite(v).all() and (v != 0).any():
                blob = v.tobytes()
                dims.append(len(v))
                digests.append(hashlib.md5(blob).digest())
                blobs.append(packed(v))
            else:
                dims.append(0)
                digests.append(None)
                blobs.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())],
            names=["id", "label", "dim", "digest", "vector"],
        )


def unit(blobs: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def packed(v: np.ndarray) -> bytes:
    """The vector as 4-byte numbers where they hold it exactly, else as 8-byte ones."""
    short = v.astype(np.float32)
    return short.tobytes() if (short == v).all() else v.tobytes()


def unpacked(blob: bytes, dim: int) -> bytes:
    return blob if len(blob) == 8 * dim else np.frombuffer(blob, np.float32).astype(np.float64).tobytes()


def spread(blobs: list[bytes], dim: int) -> np.ndarray:
    """Pivots of one length: the given vectors without those near an earlier one; random directions where they are too few."""
    kept: list[np.ndarray] = []
    for v in unit(blobs) if blobs else []:
        if not kept or (np.stack(kept) @ v).max() < APART:
            kept.append(v)
    more = np.random.default_rng(dim).normal(size=(max(LEAST_PIVOTS - len(kept), 0), dim))
    return np.concatenate([np.reshape(kept, (len(kept), dim)), more / np.sqrt((more * more).sum(axis=1, keepdims=True))])


@lean
def describe_batches(batches: Iterable[pa.RecordBatch], pivots) -> Iterator[pa.RecordBatch]:
    """(id, label, dim, vector) to (id, label, dim, near): the numbers of its nearest pivots, ascending."""
    table: dict[int, np.ndarray] = {}
    for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
        dims = batch.column(2).to_pylist()
        blobs = batch.column(3).to_pylist()
        out: list[list[int]] = [[]] * len(dims)
        for dim in set(dims):
            if dim not in table:
                table[dim] = spread(pivots.value.get(dim, []), dim)
            rows = [k for k, x in enumerate(dims) if x == dim]
            near = unit([unpacked(blobs[k], dim) for k in rows]) @ table[dim].T
            top = np.sort(np.argpartition(-near, NEAREST - 1, axis=1)[:, :NEAREST], axis=1)
            for k, ids in zip(rows, top.tolist()):
                out[k] = ids
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int32()))], names=["id", "label", "dim", "near"])


def tile_links(ids: np.ndarray, side: np.ndarray, weight: np.ndarray, near: np.ndarray, vectors: np.ndarray, key: list[int], threshold: float):
    """Links within a tile of the list ``key``: for each vector the weight of those linked with it, and its local root."""
    order = np.argsort(ids)
    ids, side, weight, near, vectors = ids[order], side[order], weight[order], near[order], vectors[order]
    names, place = np.unique(near, return_inverse=True)
    has = np.zeros((len(ids), len(names)), np.float32)
    has[np.arange(len(ids))[:, None], place.reshape(near.shape)] = 1
    before = has[:, : np.searchsorted(names, key[-1])]
    mixed = side.any() and not side.all()
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    step = 500
    pairs = []
    for lo in range(0, len(ids), step):
        part = slice(lo, lo + step)
        # The list's own pivots are the smallest that the two share.
        ok = (has[part] @ has.T >= SHARED) & (before[part] @ before.T == len(key) - 1)
        ok &= vectors[part] @ vectors.T >= threshold
        ok[np.arange(ok.shape[0]), np.arange(lo, lo + ok.shape[0])] = False
        if mixed:  # pairs of one side belong to that side's own tile
            ok &= side[part][:, None] != side[None, :]
        links[part] = ok @ weight
        a, b = np.nonzero(ok)
        pairs.append((a + lo, b))
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        low = np.minimum(low, low[low])
        if (low == root).all():
            break
        root = low
    return ids, links, ids[root]


@lean
def list_batches(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile to (id, links, root). A tile is (label, dim, key, i, j); its rows have side 0 (part i) or 1 (part j)."""
    tile, rows = None, []

    def tell(rows):
        if len(rows) < 2:
            return
        ids, side, weight, near, blobs = zip(*rows)
        vectors = unit([unpacked(x, tile[1]) for x in blobs])
        ids, links, root = tile_links(np.array(ids), np.array(side), np.array(weight), np.array(near), vectors, [int(x) for x in tile[2].split("-")], threshold)
        some = links > 0
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])], names=["id", "links", "root"])

    for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:5] != tile:
                if rows:
                    yield from tell(rows)
                tile, rows = row[:5], []
            rows.append(row[5:])
    if rows:
        yield from tell(rows)


def inverted_lists(described: DataFrame) -> DataFrame:
    """``label, dim, key, parts, id``: the lists of every vector, and into how many parts each is cut.

    Lists of one row are left out. Lists are split level by level; only ids and pivots move.
    """
    level = ["label", "dim", "key"]
    rows = written(described.select("label", "dim", "id", "near", F.posexplode(F.slice("near", 1, NEAREST - SHARED + 1)).alias("at", "pivot")).select(
        "label", "dim", F.col("pivot").cast("string").alias("key"), "at", "id", "near"
    ), "vector-level")
    done = []
    for depth in range(1, DEPTH + 1):
        sizes = written(rows.groupBy(level).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "vector-sizes")
        listed = rows.join(sizes, level)
        if depth == DEPTH or sizes.where(F.col("size") > TILE).isEmpty():
            done.append(written(listed.select(*level, "size", "id"), "vector-listed"))
            discard(rows, sizes)
            break
        long = listed.where(F.col("size") > TILE)
        more = long.select(
            "label", "dim", F.col("key").alias("parent"), "size", "id", "near", "at",
            F.explode(F.slice(F.transform("near", lambda p, k: F.struct(k.alias("k"), p.alias("p"))), F.col("at") + 2, F.lit(NEAREST - SHARED + 1 + depth) - F.col("at") - 1)).alias("next"),
        )
        more = written(more.withColumn("key", F.concat_ws("-", "parent", F.col("next.p").cast("string"))).withColumn("at", F.col("next.k")).drop("next"), "vector-split")
        parts = more.groupBy("label", "dim", "parent", "key").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
        split = parts.groupBy("label", "dim", "parent").agg(F.max("n").alias("most"), F.first("size").alias("size")).where(F.col("most") <= F.col("size") * WORTH)
        split = written(split.select("label", "dim", F.col("parent").alias("key")), "vector-worth")
        done.append(written(listed.join(split, level, "left_anti").select(*level, "size", "id"), "vector-listed"))
        after = written(more.join(split.withColumnRenamed("key", "parent"), ["label", "dim", "parent"], "left_semi").select("label", "dim", "key", "at", "id", "near"), "vector-level")
        discard(rows, sizes, more, split)
        rows = after
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    lists = written(whole.withColumn("parts", F.ceil(F.col("size") / TILE).cast("int")).drop("size"), "vector-lists")
    discard(*done)
    return lists


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row.

    Vectors link if their labels are equal and not null and their cosine is at least the threshold. Null
    vectors, vectors of zeros or of no length, and vectors with null or non-finite parts link with nothing;
    vectors of different lengths don't either. Equal vectors are one class, whose members all link; a
    repeated id counts as one vector per row. Null ids are returned with no links. An empty table gives
    an empty result; other columns are ignored. A cosine of just the threshold links. Links are found approximately (recall is
    measured in the tests), but every link reported holds. Pivots are a bounded sample; every row is indexed.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    read = written(rows.mapInArrow(vector_batches, "id long, label string, dim int, digest binary, vector binary"), "vectors")
    usable = read.where("digest IS NOT NULL AND id IS NOT NULL")
    classes = written(
        usable.groupBy("label", "dim", "digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vector-classes"
    )
    # A repeated id with several vectors is as many nodes, under numbers of their own.
    torn = written(classes.groupBy("rep").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("rep", F.lit(True).alias("torn")), "vector-torn")
    whole = torn.isEmpty()
    if whole:
        nodes = classes.withColumn("node", F.col("rep"))
    else:
        own = F.lit(-2) - F.xxhash64("rep", "label", "dim", "digest").bitwiseAND(F.lit((1 << 62) - 1))
        nodes = classes.join(torn, "rep", "left").withColumn("node", F.when(F.col("torn"), own).otherwise(F.col("rep"))).drop("torn")
    reps = nodes.join(usable.select(F.col("id").alias("rep"), "digest", "label", "dim", "vector").dropDuplicates(["rep", "digest", "label"]), ["rep", "digest", "label", "dim"]).select(
        F.col("node").alias("id"), "label", "dim", "weight", "vector"
    )
    reps = written(reps, "vector-reps")

    # A bounded sample serves as pivots.
    size = reps.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    wanted = min(MOST_PIVOTS, PIVOT_BYTES // (8 * max(size["dim"] or 1, 1)), max(LEAST_PIVOTS, int(PIVOT_RATE * size["n"] ** 0.5)))
    sampled = reps.where(unit_hash(F.col("id"), 19) < wanted / max(size["n"], 1)).select("dim", "id", "vector")
    table: dict[int, list[bytes]] = {}
    for dim, _, blob in sorted(map(tuple, sampled.collect()), key=lambda x: x[:2]):
        table.setdefault(dim, []).append(unpacked(bytes(blob), dim))
    pivots = spark.sparkContext.broadcast(table)

    described = written(reps.select("id", "label", "dim", "vector").mapInArrow(lambda b: describe_batches(b, pivots), "id long, label string, dim int, near array<int>"), "vector-near")
    lists = inverted_lists(described)
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int")
    tiled = (
        lists.join(described.select("id", "label", "dim", "near"), ["id", "label", "dim"]).join(reps, ["id", "label", "dim"])
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "label", "dim", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
            "id", F.when(F.col("part") == F.least("part", "other"), 0).otherwise(1).alias("side"), "weight", "near", "vector",
        )
        .repartition("label", "dim", "key", "i", "j").sortWithinPartitions("label", "dim", "key", "i", "j")
    )
    found = written(tiled.mapInArrow(lambda b: list_batches(b, threshold), "id long, links long, root long"), "vector-links")
    discard(described, lists)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found, "id", "root", "vector-cc")
    of_node = nodes.select("rep", "node").join(links.withColumnRenamed("id", "node"), "node", "left").join(parts, "node", "left")
    if whole:  # nodes are ids, and a component is its smallest node
        of_node = of_node.withColumn("component", F.coalesce("component", "node"))
    else:
        of_node = of_node.withColumn("component", F.coalesce("component", "node"))
        least = of_node.groupBy("component").agg(F.min("rep").alias("least"))
        of_node = of_node.join(least, "component").withColumn("component", F.col("least"))
    of_node = written(of_node.select("node", "links", "component"), "vector-of")
    member = nodes.join(of_node, "node", "left")
    discard(reps, found, parts)
    component = F.coalesce("component", "rep", "id")
    return (
        read.select("id", "label", "dim", "digest").join(member, ["label", "dim", "digest"], "left")
        .select(
            F.col("id").alias(id_col),
            F.when(F.col("id").isNull(), 0).otherwise(F.coalesce(F.col("weight") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))).cast("long").alias("n_links"),
            F.when(F.col("id").isNotNull(), component).alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        )
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings at a cosine of 0.98."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
