"""N-gram Jaccard join by a token-group matrix.

Similar documents are put in groups, and of each group the union of its tokens is stored. A query is
held against groups: the number of tokens it shares with a group's union bounds what it can share with
any member, and only groups that pass the bound are opened.

1. Every text becomes a set of shingle hashes; equal sets become one class with one node. Of a set its size, two
   hashes, bands of minima and a row of bits (a bit for each token's low digits) are kept, not its tokens.
2. Star links: nodes that agree in a band of minima are held against the smallest of the bucket. The
   components of the true links are the first clusters, so large families of near copies are joined in time
   linear in their size. Nodes without a link join the cluster of the star that they resemble.
3. Groups are parts of a cluster of about one size and of bounded tokens.
4. All links that are left are between components. A global order of tokens puts frequent ones last; the first token
   that two sets share must leave room in both for the whole overlap that a link needs. Matrix rows (token, group)
   tell where such tokens stand, and give pairs of a query and a group.
5. The matrix's other half has a row of bits for each of those groups, the union of its members'. A query's bits
   that the union lacks are tokens no member has; groups that can't hold enough of the query are dropped.
6. Texts move only for the groups that are left, and their members decide.

Steps 4 to 6 lose no link between components, so the components at the end are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.components import components
from driftlog.llm.shingles import WORDS, Shingler, _mix
from driftlog.llm.text_buffers import filled, flat, slices
from driftlog.session import discard, lean, ship_package, written

#: Bins of the minima and bins in a band of them.
BINS, BAND = 32, 4
#: Members and tokens of a group, on average at most; sizes of its members are within SIZE_STEP of each other.
GROUP_SIZE, GROUP_TOKENS, SIZE_STEP = 64, 1 << 18, 1.05
#: A token counts as frequent if some task meets it so often in a run of RUN_TOKENS; the table of frequent tokens is bounded.
LOCAL_REPEATS, RUN_TOKENS, FREQUENT_TOKENS = 3, 1_000_000, 500_000
#: Rows from which on a cluster is not left to one task of a join.
HOT_ROWS = 10_000
#: Keys up to so many are broadcast, more are joined by shuffle.
BROADCAST_KEYS = 2_000_000
#: Queries held against one copy of a group's members.
QUERIES_PER_COPY = 128
#: Bytes of text that a Python worker turns into shingles at a time.
SLICE = 1 << 20
#: Bits of a set's row, at least this many times its tokens (the next power of two).
BITS_PER_TOKEN = 2

#: A document has kind 0; rows of kind 1 have a frequent token as their id and its count as n.
SETS = "kind int, id long, th long, n int, h1 long, h2 long, bands array<long>, bits binary"


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of values as a binary column."""
    width = values.dtype.itemsize
    offsets = (np.r_[0, np.cumsum(counts)] * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def values_of(column: pa.Array, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column, one row after another, and how many each row has."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), np.diff(bounds) // np.dtype(kind).itemsize


def band_keys(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands of each set's minima, and how many each has. A band with an empty bin has no key."""
    owner = np.repeat(np.arange(len(counts)), counts)
    bins = (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (bins[1:] != bins[:-1])
    minima = np.zeros((len(counts), BINS), np.uint64)
    minima[owner[first], bins[first]] = values[first]
    there = np.zeros((len(counts), BINS), bool)
    there[owner[first], bins[first]] = True
    bands = BINS // BAND
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(counts), bands)).copy()
    for k in range(BAND):
        key = _mix(key * np.uint64(0x100000001B3) + minima[:, k::BAND])
    full = np.logical_and.reduce([there[:, k::BAND] for k in range(BAND)])
    return key[full], full.sum(axis=1)


def bit_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A row of bits for each set: a power of two of them, and for each token the bit of its low digits."""
    need = np.maximum(counts * BITS_PER_TOKEN, 64)
    sizes = np.left_shift(1, np.ceil(np.log2(need)).astype(np.int64))
    begins = np.cumsum(sizes) - sizes
    bits = np.zeros(int(sizes.sum()), bool)
    low = (values & np.repeat(sizes - 1, counts).astype(np.uint64)).astype(np.int64)
    bits[np.repeat(begins, counts) + low] = True
    return binary_rows(np.packbits(bits, bitorder="little"), sizes // 8)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A row of bits in ``size`` bytes: halves are laid on each other."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def shared_at_most(n: int, bits: np.ndarray, others: np.ndarray) -> int:
    """No set within ``others`` shares more of the n tokens of ``bits``: each bit that the others lack is a token they lack."""
    size = min(len(bits), len(others))
    return n - int(np.bitwise_count(folded(bits, size) & ~folded(others, size)).sum())


@lean
def set_batches(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(id, hash of the text, text) to the columns of SETS, and the frequent tokens."""
    shingler = Shingler(words)
    held: list[np.ndarray] = []

    def frequent() -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held.clear()
        if (often := counts >= LOCAL_REPEATS).any():
            many = int(often.sum())
            nothing = [pa.nulls(many, pa.int64())] * 2 + [pa.nulls(many, pa.list_(pa.int64())), pa.nulls(many, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(many, np.int32)), pa.array(values[often].view(np.int64)), pa.nulls(many, pa.int64()), pa.array(counts[often].astype(np.int32)), *nothing],
                names=["kind", "id", "th", "n", "h1", "h2", "bands", "bits"],
            )

    for whole in batches:
        for batch in slices(whole, 2, SLICE):
            values, counts = shingler.sets(*flat(filled(batch.column(2))))
            runs = np.r_[0, np.cumsum(counts)]
            hashes = []
            for seed in (0x51ED270B, 0xB5297A4D):
                total = np.r_[np.uint64(0), np.cumsum(_mix(values ^ np.uint64(seed)))]
                hashes.append((total[runs[1:]] - total[runs[:-1]]).astype(np.int64))
            keys, many = band_keys(values, counts)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(counts), np.int32)), batch.column(0), batch.column(1), pa.array(counts.astype(np.int32)), *map(pa.array, hashes), lists, bit_rows(values, counts)],
                names=["kind", "id", "th", "n", "h1", "h2", "bands", "bits"],
            )
            held.append(values)
            if sum(map(len, held)) > RUN_TOKENS:
                yield from frequent()
    yield from frequent()


class TokenOrder:
    """The global order: tokens that aren't frequent by hash, then frequent ones by count."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    def prefixes(self, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first tokens of each set, n - ceil(3 n / 4) + 1 of them in order, and how many each set has."""
        owner = np.repeat(np.arange(len(counts)), counts)
        order = np.arange(len(values))
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, values), len(self.tokens) - 1)
            weight = np.where(self.tokens[at] == values, np.minimum(self.counts[at], (1 << 40) - 1), 0)
            if weight.any():  # values ascend within a set, and a stable sort keeps that among equals
                order = np.argsort((owner << 40) + weight, kind="stable")
        size = np.where(counts > 0, counts - (3 * counts + 3) // 4 + 1, 0)
        rank = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
        return values[order[rank < size[owner]]], size


@lean
def prefix_batches(batches: Iterable[pa.RecordBatch], order, words: int) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, n, the first tokens in order)."""
    ordering, shingler = TokenOrder(*order.value), Shingler(words)
    for whole in batches:
        for batch in slices(whole, 1, SLICE):
            values, counts = shingler.sets(*flat(filled(batch.column(1))))
            tokens, sizes = ordering.prefixes(values, counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int32)), binary_rows(tokens, sizes)], names=["id", "n", "tokens"])


def _ranks(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@lean
def count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, first tokens) to (token, roomy): does the token leave room for a link with a set no smaller?"""
    for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
        tokens, sizes = values_of(batch.column(1))
        n = np.repeat(batch.column(0).to_numpy().astype(np.int64), sizes)
        roomy = 7 * (n - _ranks(sizes)) >= 6 * n
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(roomy)], names=["token", "roomy"])


@lean
def posting_batches(batches: Iterable[pa.RecordBatch], wanted=None) -> Iterator[pa.RecordBatch]:
    """(node, n, first tokens) to (token, node, n, room): how many of the set's tokens are not before this one. Only tokens in ``wanted`` if that is given."""
    some = None if wanted is None else wanted.value
    for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
        tokens, sizes = values_of(batch.column(2))
        n = np.repeat(batch.column(1).to_numpy(), sizes)
        columns = [tokens.view(np.int64), np.repeat(batch.column(0).to_numpy(), sizes), n, (n - _ranks(sizes)).astype(np.int32)]
        if some is not None:
            found = some[np.minimum(np.searchsorted(some, tokens), len(some) - 1)] == tokens if len(some) else np.zeros(len(tokens), bool)
            columns = [c[found] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "id", "n", "room"])


def similar(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    """100 * intersection >= 75 * union, in whole numbers."""
    return 7 * shared >= 3 * (a + b)


@lean
def star_bound_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, star, n, bits, n and bits of the star) to the pairs that may link."""
    for batch in batches:
        n, m = batch.column(2).to_pylist(), batch.column(4).to_pylist()
        mine, others = ([np.frombuffer(x, np.uint8) for x in batch.column(k).to_pylist()] for k in (3, 5))
        keep = [
            similar(min(shared_at_most(a, x, y), shared_at_most(b, y, x)), a, b) for a, x, b, y in zip(n, mine, m, others)
        ]
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["id", "star"])


@lean
def union_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, n, bits) sorted by gid to (gid, size of the smallest member, union of the bits)."""
    key, least, union = None, 0, np.zeros(0, np.uint8)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([least], pa.int32()), pa.array([union.tobytes()], pa.binary())], names=["gid", "least", "bits"])

    for batch in batches:
        for gid, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
            bits = np.frombuffer(blob, np.uint8)
            if gid != key:
                if key is not None:
                    yield row()
                key, least, union = gid, n, bits
            else:
                size = min(len(bits), len(union))
                least, union = min(least, n), folded(bits, size) | folded(union, size)
    if key is not None:
        yield row()


@lean
def group_bound_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, gid, n, bits, size of the smallest member and bits of the group) to the queries and groups that may link."""
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)))
        keep = [similar(shared_at_most(n, np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), n, least) for n, x, least, y in rows]
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["id", "gid"])


@lean
def open_batches(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(gid, salt, query, id, text), members before queries of each (gid, salt), to links (a, b).

    Of a query's links with several members, the first stands for it and ties the other members to the first, each once, so
    that there are no more links than rows.
    """
    shingler = Shingler(words)
    key, tied = None, set()
    members: list[np.ndarray] = []
    ids: list[int] = []
    table: tuple[np.ndarray, ...] | None = None
    for batch in (part for whole in batches for part in slices(whole, 4, SLICE)):
        left, right = [], []
        values, counts = shingler.sets(*flat(filled(batch.column(4))))
        ends = np.cumsum(counts)
        for k, (gid, salt, query, row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
            own = values[ends[k] - counts[k] : ends[k]]
            if (gid, salt) != key:
                key, members, ids, table, tied = (gid, salt), [], [], None, set()
            if not query:
                members.append(own.copy())
                ids.append(row)
                continue
            if table is None and members:
                sizes = np.fromiter(map(len, members), np.int64, len(members))
                union, where = np.unique(np.concatenate(members), return_inverse=True)
                table = union, where, np.repeat(np.arange(len(sizes)), sizes), sizes
            if table is None:
                continue
            union, where, owner, sizes = table
            at = np.minimum(np.searchsorted(union, own), len(union) - 1)
            mine = np.zeros(len(union), bool)
            mine[at[union[at] == own]] = True
            shared = np.bincount(owner[mine[where]], minlength=len(sizes))
            linked = [ids[i] for i in np.flatnonzero(similar(shared, len(own), sizes)) if ids[i] != row]
            if linked:
                left.append(row)
                right.append(linked[0])
                for other in linked[1:]:
                    if other not in tied:
                        tied.add(other)
                        left.append(linked[0])
                        right.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _most_frequent(counted: DataFrame) -> pa.Table:
    """The most frequent tokens, no more than FREQUENT_TOKENS: all whose count has at least so many binary digits.

    The order of tokens is free for the result, so the cut needs no exact rank and no sort of all tokens.
    """
    digits = F.length(F.bin("n"))
    sizes = {r["d"]: r["n"] for r in counted.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, 64
    for d in sorted(sizes, reverse=True):
        total += sizes[d]
        if total > FREQUENT_TOKENS:
            break
        least = d
    return counted.where(digits >= least).toArrow()


def _few(keys: DataFrame) -> DataFrame:
    """Marks a written table of keys for broadcast if it is small; else the join shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _with_sizes(rows: DataFrame, sizes: DataFrame, keys: list[str], many: str) -> DataFrame:
    """Rows (by id) with the columns of their key's row in a written table of sizes, null where there is none.

    Keys of many rows are broadcast: those of at least a BROADCAST_KEYS-th of all rows are no more than BROADCAST_KEYS. Their rows
    are then dealt by id, so that no task gets all rows of one key; the other keys' rows meet their sizes by shuffle.
    """
    values = [c for c in sizes.columns if c not in keys]
    total = sizes.agg(F.coalesce(F.sum(many), F.lit(0))).first()[0]
    bar = max(HOT_ROWS, int(total) // BROADCAST_KEYS + 1)
    hot = sizes.where(F.col(many) >= bar).select(*keys, F.struct(*values).alias("_hot"))
    cold = sizes.where(F.col(many) < bar).select(*keys, F.struct(*values).alias("_cold"), F.lit(0).alias("_salt"))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int") + 1).otherwise(0)
    met = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    return met.select(*rows.columns, *[F.coalesce(f"_hot.{v}", f"_cold.{v}").alias(v) for v in values])


def _size_step(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_STEP)))


def _turned(bits: Column, by: Column) -> Column:
    """A long's bits turned left."""
    return F.call_function("shiftleft", bits, by).bitwiseOR(F.call_function("shiftrightunsigned", bits, F.lit(64) - by))


def _place(step: Column) -> Column:
    return F.pmod(step, F.lit(64)).cast("int")


def _partner_sizes() -> Column:
    """The size steps (modulo 64) of sets that a posting's set may link with, if the token is the first they share."""
    n, room = F.col("n").cast("long"), F.col("room").cast("long")
    low = _size_step(F.ceil(n * 3 / 4)) - 1
    high = _size_step(F.greatest(F.least(F.floor(room * 7 / 3) - n, F.floor(n * 4 / 3) + 1), F.lit(1)))
    width = F.greatest(high - low + 1, F.lit(0)).cast("int")
    return _turned(F.call_function("shiftleft", F.lit(1).cast("long"), width) - F.lit(1).cast("long"), _place(low))


def _opened(texts: DataFrame, members: DataFrame, queries: DataFrame, words: int, tag: str) -> DataFrame:
    """Links (a, b) of queries (gid, id) with the members (gid, id) of their groups. A group that many queries ask for is
    copied, a copy for QUERIES_PER_COPY of them; each text moves once for each group it is a query of."""
    parts = written(queries.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_COPY).cast("int").alias("parts")), f"{tag}-parts")
    keys = written(
        members.join(parts, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("query"), "id").unionByName(
            queries.join(parts, "gid").select("gid", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"), F.lit(True).alias("query"), "id")
        ),
        f"{tag}-keys",
    )
    rows = texts.join(_few(keys), "id").select("gid", "salt", "query", "id", "text")
    dealt = rows.repartition("gid", "salt").sortWithinPartitions("gid", "salt", "query", "id")
    links = written(dealt.mapInArrow(lambda b: open_batches(b, words), "a long, b long"), f"{tag}-links")
    discard(parts, keys)
    return links


def _candidates(postings: DataFrame, matrix: DataFrame) -> DataFrame:
    """Queries and groups that share a token which leaves room for a link, once each.

    Of two components the smaller one asks; of groups of single nodes that with the smaller number.
    """
    asks = "csize < gsize OR (csize = gsize AND ((csize = 1 AND own <= gid) OR (csize > 1 AND comp < ghi)))"
    return (
        postings.withColumnRenamed("gid", "own").join(matrix, "token")
        .where(f"({asks}) AND (glo != ghi OR glo != comp)")
        .where("4 * n >= 3 * gmin AND 3 * n <= 4 * gmax AND 7 * least(room, groom) >= 3 * (n + gmin)")
        .select("id", "gid").distinct()
    )


def _classified(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id, th, n, comp, component_id`` of every row: the text's hash, the size of its set, its component's own number, and
    the smallest id in that."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("th"), "text")
    sets = written(rows.mapInArrow(lambda b: set_batches(b, words), SETS), "jaccard-sets")
    every = sets.where("kind = 0").select("id", "th", "n")
    full = sets.where("kind = 0 AND n > 0 AND id IS NOT NULL")

    # Classes of equal sets, each with one row as its node.
    keyed = full.select("id", "th", "h1", "h2", "n")
    classes = keyed.groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "th")).alias("rep"), F.count(F.lit(1)).alias("many")).where("many > 1")
    classes = written(classes.select("h1", "h2", "n", F.col("rep.id").alias("rep"), F.col("rep.th").alias("rep_th")), "jaccard-classes")
    copies = written(keyed.join(classes, ["h1", "h2", "n"]).where("id != rep OR th != rep_th").select("id", "th", "rep", "rep_th").distinct(), "jaccard-copies")
    # An id with several texts is as many nodes, under numbers of their own.
    torn = written(keyed.groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select("id"), "jaccard-torn")
    whole = torn.isEmpty()

    def noded(df: DataFrame, of: str = "id", th: str = "th", name: str = "node") -> DataFrame:
        if whole:
            return df.withColumn(name, F.col(of))
        marked = df.join(_few(torn).select(F.col("id").alias(of), F.lit(True).alias("_torn")), of, "left")
        own = F.lit(-2) - F.xxhash64(of, th).bitwiseAND(F.lit((1 << 62) - 1))
        return marked.withColumn(name, F.when(F.col("_torn"), own).otherwise(F.col(of))).drop("_torn")

    unique = lambda df: df.join(_few(copies).select("id", "th"), ["id", "th"], "left_anti")
    ours = noded(unique(full)).select(F.col("node").alias("id"), F.col("id").alias("doc"), "n", "bands", "bits")
    texts = noded(unique(rows.where("id IS NOT NULL"))).select(F.col("node").alias("id"), "text")

    # Star links within buckets of equal bands.
    bands = written(ours.select("id", F.explode("bands").alias("band")), "jaccard-bands")
    buckets = written(bands.groupBy("band").agg(F.min("id").alias("star"), F.max("id").alias("other")).where("star != other").select("band", "star"), "jaccard-buckets")
    pairs = written(bands.join(buckets, "band").where("id != star").select("id", "star").distinct(), "jaccard-pairs")
    discard(bands, buckets)
    bits_of = lambda ids, tag: written(ours.select("id", "n", "bits").join(_few(ids), "id", "left_semi").distinct(), tag)
    ends = written(pairs.select("id").union(pairs.select("star")).distinct(), "jaccard-ends")
    bits = bits_of(ends, "jaccard-bits")
    near = (
        pairs.join(bits, "id").join(bits.toDF("star", "m", "others"), "star").where("4 * n >= 3 * m AND 3 * n <= 4 * m")
        .select("id", "star", "n", "bits", "m", "others").mapInArrow(star_bound_batches, "id long, star long").distinct()
    )
    near = written(near.select(F.col("star").alias("gid"), "id"), "jaccard-near")
    discard(ends, bits)
    stars = _star_links(texts, near, words)
    first = components(stars, tag="jaccard-first")

    # Groups: parts of a cluster with sizes of one step.
    resembled = pairs.unionByName(pairs.select(F.col("star").alias("id"), "star")).groupBy("id").agg(F.min("star").alias("star"))
    counts = written(first.groupBy(F.col("component").alias("comp")).agg(F.count(F.lit(1)).alias("csize")), "jaccard-counts")
    apiece = (
        ours.select("id", "n").distinct().join(first.withColumnRenamed("node", "id"), "id", "left").join(resembled, "id", "left")
        .withColumn("comp", F.coalesce("component", "id"))
    )
    banded = written(
        _with_sizes(apiece, counts, ["comp"], "csize").withColumn("csize", F.coalesce("csize", F.lit(1)))
        .withColumn("cluster", F.when(F.col("csize") > 1, F.col("comp")).otherwise(F.coalesce("star", "id"))).withColumn("step", _size_step(F.col("n")))
        .select("id", "n", "comp", "csize", "cluster", "step"),
        "jaccard-banded",
    )
    discard(pairs, near, stars, first, counts)
    held = banded.groupBy("cluster", "step").agg(F.count(F.lit(1)).alias("held"), F.sum(F.col("n").cast("long")).alias("tokens")).where("held > 1")
    held = written(held, "jaccard-held")
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.ceil(F.greatest(F.col("held") / GROUP_SIZE, F.col("tokens") / GROUP_TOKENS)))
    placed = written(
        _with_sizes(banded, held, ["cluster", "step"], "held").withColumn("gid", F.xxhash64("cluster", "step", F.coalesce(part, F.lit(0)))).select("id", "n", "comp", "csize", "gid"),
        "jaccard-placed",
    )
    discard(banded, held)

    # Postings of the first tokens in the global order, where another set has the token too.
    counted = written(sets.where("kind = 1").groupBy(F.col("id").alias("token")).agg(F.sum(F.col("n").cast("long")).alias("n")), "jaccard-often")
    often = _most_frequent(counted)
    order = spark.sparkContext.broadcast((often["token"].to_numpy().view(np.uint64), often["n"].to_numpy()))
    prefixes = written(texts.mapInArrow(lambda b: prefix_batches(b, order, words), "id long, n int, tokens binary"), "jaccard-prefixes", "uncompressed")
    discard(counted)
    seen = prefixes.select("n", "tokens").mapInArrow(count_batches, "token long, roomy boolean")
    shared = written(seen.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.max("roomy").alias("roomy")).where("many > 1 AND roomy").select("token"), "jaccard-shared")
    posted = "token long, id long, n int, room int"
    if shared.count() <= BROADCAST_KEYS:
        wanted = spark.sparkContext.broadcast(np.sort(shared.toArrow()["token"].to_numpy().view(np.uint64)))
        postings = prefixes.mapInArrow(lambda b: posting_batches(b, wanted), posted)
    else:
        postings = prefixes.mapInArrow(posting_batches, posted).join(shared, "token", "left_semi")
    postings = written(postings.join(placed, ["id", "n"]), "jaccard-postings")
    discard(prefixes, shared)
    # Of those, the ones whose token stands in another component, in a set of a size that leaves room for a link.
    sizes = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _place(_size_step(F.col("n")))))
    apart = written(postings.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), sizes.alias("sizes")).where("lo != hi").select("token", "sizes"), "jaccard-apart")
    between = written(postings.join(apart, "token").where(_partner_sizes().bitwiseAND(F.col("sizes")) != 0).drop("sizes"), "jaccard-between")
    discard(postings, apart)

    # The matrix by token, and the queries that share tokens with its groups.
    matrix = written(
        between.groupBy("token", "gid").agg(
            F.max("room").alias("groom"), F.min("n").alias("gmin"), F.max("n").alias("gmax"), F.min("comp").alias("glo"), F.max("comp").alias("ghi"), F.max("csize").alias("gsize")
        ),
        "jaccard-matrix",
    )
    candidates = written(_candidates(between, matrix), "jaccard-candidates")
    discard(between, matrix)

    # The matrix by group: unions of members, for the groups that are asked for.
    asked = written(candidates.select("gid").distinct(), "jaccard-asked")
    members = written(placed.join(_few(asked), "gid", "left_semi").select("gid", "id", "n"), "jaccard-members")
    ends = written(members.select("id").union(candidates.select("id")).distinct(), "jaccard-ends")
    bits = bits_of(ends, "jaccard-bits")
    unions = members.join(bits, ["id", "n"]).select("gid", "n", "bits").repartition("gid").sortWithinPartitions("gid").mapInArrow(union_batches, "gid long, least int, bits binary")
    unions = written(unions.withColumnRenamed("bits", "union"), "jaccard-unions")
    bounded = candidates.join(bits, "id").join(unions, "gid").select("id", "gid", "n", "bits", "least", "union")
    qualified = written(bounded.mapInArrow(group_bound_batches, "id long, gid long").distinct().select("gid", "id"), "jaccard-qualified")
    discard(candidates, asked, members, ends, bits, unions)

    # Open the groups that qualify.
    links = _opened(texts, placed.select("gid", "id").distinct(), qualified, words, "jaccard-open")
    comp_of = placed.select("id", "comp").distinct()
    across = links.join(comp_of.toDF("a", "ca"), "a").join(comp_of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    last = components(across, tag="jaccard-last")

    # Back to all rows.
    docs_of = ours.select("id", "doc").distinct() if not whole else comp_of.select("id", F.col("id").alias("doc"))
    nodes = comp_of.join(last.withColumnRenamed("node", "comp"), "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")).join(docs_of, "id")
    if whole:  # nodes are ids, and a component is its smallest node
        nodes = nodes.withColumn("component_id", F.col("comp"))
    else:
        nodes = nodes.join(nodes.groupBy("comp").agg(F.min("doc").alias("component_id")), "comp")
    nodes = written(nodes.select("id", "comp", "component_id"), "jaccard-nodes")
    discard(qualified, links, last, placed)
    reps = noded(every.join(copies, ["id", "th"], "left").withColumn("rep", F.coalesce("rep", "id")).withColumn("rep_th", F.coalesce("rep_th", "th")), "rep", "rep_th")
    reps = reps.withColumn("node", F.when(F.col("n") > 0, F.col("node")))
    return reps.join(nodes.withColumnRenamed("id", "node"), "node", "left").select("id", "th", "n", "comp", F.coalesce("component_id", "id").alias("component_id"))


def _star_links(texts: DataFrame, near: DataFrame, words: int) -> DataFrame:
    """Those of the pairs of a node and its star (gid) that link."""
    return _opened(texts, near.select("gid", F.col("gid").alias("id")).distinct(), near, words, "jaccard-stars")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``id, n_shingles, component_id`` of every row: components of links with Jaccard of word shingles >= 0.75.

    Null texts count as empty; texts without a word have no shingles and link with nothing; shorter
    texts than a shingle have one shingle, all their words. Ids are whole numbers; an id with several texts is
    several documents, each with its own links, and stands for all of them where it is the smallest of a component; rows
    with a null id are returned with null component and link with nothing. Repeated rows are returned each. An
    empty table gives an empty result; other columns are ignored. A similarity of just 0.75 links. Shingles
    are compared as 64-bit hashes. ``docs`` is read several times: write it first if it is dear to make.
    """
    found = _classified(docs, id_col, text_col, words)
    return found.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id (of its texts, that of the smallest hash);
    columns as they came.

    Rows go by id and text, so an id with several texts loses only those that another document stands for. Of rows that
    repeat both id and text of what stays, one is left. Rows with a null id and texts without words stay.
    """
    found = written(_classified(docs, id_col, text_col, words).where("comp IS NOT NULL").select("id", "th", "comp"), "jaccard-rows")
    row = F.struct("id", "th")
    several = found.groupBy("comp").agg(F.min(row).alias("stays"), F.count(F.lit(1)).alias("many")).where("many > 1")
    several = written(several.select("comp", F.col("stays.id").alias("keep"), F.col("stays.th").alias("keep_th")), "jaccard-several")
    gone = written(found.join(several, "comp").where("id != keep OR th != keep_th").select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct(), "jaccard-gone")
    twice = written(found.groupBy("id", "th").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select(F.col("id").alias("_id"), F.col("th").alias("_th")), "jaccard-twice")
    discard(found, several)
    same = (F.col(id_col).cast("long") == F.col("_id")) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("_th"))
    kept = docs.join(_few(gone), same, "left_anti")
    if twice.isEmpty():
        return kept
    twice = _few(twice)
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
