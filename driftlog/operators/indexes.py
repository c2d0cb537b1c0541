"""Sidecar indexes of chunks: hash (value to positions), skip (time bounds of blocks) and bloom (membership)."""

from __future__ import annotations

import hashlib
import math
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.config import Config
from driftlog.functions.compile import Resolver, as_number, as_string, compile_leaf, present
from driftlog.plans import ir
from driftlog.session import ship_package


def index_id(seq: Column, kind: str, field: str) -> Column:
    return F.concat_ws(":", seq.cast("string"), F.lit(kind), F.lit(field))


class Index(ABC):
    """A sidecar table over chunks. ``precise`` ones give exactly the matching positions; the rows of
    others are checked again."""

    kind: str
    ops: tuple[str, ...]
    precise: bool

    def __init__(self, field: str):
        self.field = field

    @abstractmethod
    def build(self, logs: DataFrame) -> DataFrame:
        """The sidecar table."""

    @abstractmethod
    def lookup(self, sidecar: DataFrame, logs: DataFrame, predicate: ir.Predicate) -> DataFrame:
        """Rows that may match."""

    @abstractmethod
    def memory_bytes(self, sidecar: DataFrame) -> DataFrame:
        """``seq, bytes``."""


class HashIndex(Index):
    """Positions by value. Rows are keyed by (chunk, value) and pairs, not lists, are what lookups join, so a hot
    value is never gathered in one row; ``posting_lists`` gathers them within a chunk, whose size is bounded."""

    kind, ops, precise = "hash", (ir.EQ, ir.IN), True

    def build(self, logs: DataFrame) -> DataFrame:
        field = Resolver(logs)(self.field)
        value = F.lit(None).cast("string") if field.column is None else field.column
        return logs.where(present(field)).select("seq", value.alias("value"), "pos")

    @staticmethod
    def posting_lists(sidecar: DataFrame) -> DataFrame:
        return sidecar.groupBy("seq", "value").agg(F.array_sort(F.collect_list("pos")).alias("positions"))

    def lookup(self, sidecar: DataFrame, logs: DataFrame, predicate: ir.Predicate) -> DataFrame:
        # The predicate itself over the stored value, so a literal of another type matches what it would match without an index.
        same = compile_leaf(ir.Predicate("value", predicate.op, predicate.value), Resolver(sidecar, open_map=""))
        return logs.join(sidecar.where(same).select("seq", "pos").distinct(), ["seq", "pos"], "left_semi")

    def memory_bytes(self, sidecar: DataFrame) -> DataFrame:
        keyed = sidecar.groupBy("seq", F.col("value").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        return keyed.groupBy("seq").agg(F.sum(F.octet_length("value") + 8 * F.col("n")).cast("long").alias("bytes"))


class SkipIndex(Index):
    """Time bounds of blocks of rows. All blocks that overlap are candidates, in whatever order they lie."""

    kind, ops, precise = "skip", (ir.RANGE,), False

    def __init__(self, field: str = "ts", block: int = Config.skip_block_size):
        super().__init__(field)
        self.block = block

    def _block(self) -> Column:
        return F.floor(F.col("pos") / self.block)

    def build(self, logs: DataFrame) -> DataFrame:
        side = as_number(Resolver(logs)(self.field))
        side = F.col(self.field) if side is None else side
        return logs.groupBy("seq", self._block().alias("block")).agg(
            F.min(side).alias("low"), F.max(side).alias("high"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
        )

    def lookup(self, sidecar: DataFrame, logs: DataFrame, predicate: ir.Predicate) -> DataFrame:
        span = predicate.value
        hit = F.lit(True)
        if span.low is not None:
            hit &= F.col("high") >= F.lit(span.low)
        if span.high is not None:
            hit &= F.col("low") <= F.lit(span.high)
        blocks = sidecar.where(hit).select("seq", F.col("block").alias("_block"))
        return logs.withColumn("_block", self._block()).join(blocks, ["seq", "_block"], "left_semi").drop("_block")

    def memory_bytes(self, sidecar: DataFrame) -> DataFrame:
        return sidecar.groupBy("seq").agg((F.count(F.lit(1)) * 56).cast("long").alias("bytes"))


def canonical(value) -> str:
    """One spelling for values that predicates take as equal: numbers as doubles, whole ones without a fraction; truth values are 1 and 0."""
    if not isinstance(value, int | float):
        return str(value)
    number = float(value)
    return str(int(number)) if number.is_integer() else repr(number)


def bloom_shape(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for n keys at a false-positive rate."""
    bits = max(64, int(-max(n, 1) * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, int(bits / max(n, 1) * math.log(2)))


def bloom_places(key: str, bits: int, hashes: int) -> np.ndarray:
    digest = hashlib.blake2b(key.encode(), digest_size=16).digest()
    a, b = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1
    return np.array([(a + i * b) % bits for i in range(hashes)], np.int64)


class BloomIndex(Index):
    """A bit array of a chunk's values: a chunk whose bits deny a value is skipped whole."""

    kind, ops, precise = "bloom", (ir.EQ, ir.IN), False

    def __init__(self, field: str, rate: float = Config.bloom_fp_rate):
        super().__init__(field)
        self.rate = rate

    def build(self, logs: DataFrame) -> DataFrame:
        rate = self.rate
        ship_package(logs.sparkSession)
        # Distinct values first: a chunk's group is bounded by the chunk, and hot values are one row.
        field = Resolver(logs)(self.field)
        side = lambda column, kind: F.lit(None).cast(kind) if column is None else column.cast(kind)
        values = logs.where(present(field)).select("seq", side(as_string(field), "string").alias("text"), side(as_number(field), "double").alias("number")).distinct()

        def fold(group: pd.DataFrame) -> pd.DataFrame:
            bits, hashes = bloom_shape(len(group), rate)
            field = np.zeros(bits, bool)
            for text, number in zip(group["text"], group["number"]):
                if text is not None or number == number:
                    field[bloom_places(canonical(text if text is not None else number), bits, hashes)] = True
            return pd.DataFrame({"seq": [group["seq"].iloc[0]], "bits": [bits], "hashes": [hashes], "field": [np.packbits(field).tobytes()]})

        return values.groupBy("seq").applyInPandas(fold, "seq int, bits long, hashes int, field binary")

    def gate(self, sidecar: DataFrame, values: list) -> DataFrame:
        """Chunks that may hold one of the values."""
        keys = [canonical(v) for v in values]
        ship_package(sidecar.sparkSession)

        def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = []
                for bits, hashes, field in zip(batch["bits"], batch["hashes"], batch["field"]):
                    set_bits = np.unpackbits(np.frombuffer(field, np.uint8))
                    keep.append(any(set_bits[bloom_places(k, bits, hashes)].all() for k in keys))
                yield batch.loc[keep, ["seq"]]

        return sidecar.mapInPandas(admit, "seq int")

    def lookup(self, sidecar: DataFrame, logs: DataFrame, predicate: ir.Predicate) -> DataFrame:
        values = list(predicate.value) if predicate.op == ir.IN else [predicate.value]
        return logs.join(self.gate(sidecar, values), "seq", "left_semi")

    def memory_bytes(self, sidecar: DataFrame) -> DataFrame:
        return sidecar.select("seq", (F.floor(F.col("bits") / 8) + 64 + len(self.field.encode())).cast("long").alias("bytes"))


KINDS = {"hash": HashIndex, "skip": SkipIndex, "bloom": BloomIndex}


def make_index(kind: str, field: str) -> Index:
    return KINDS[kind](field)


def choose_kind(field: str, op: str) -> str | None:
    """The index that can serve the predicate; none for what no index serves."""
    if op == ir.RANGE:
        return "skip" if field == "ts" else None
    return "hash" if op in (ir.EQ, ir.IN) else None


def pick(indexes: list[Index], predicate: ir.Predicate) -> Index | None:
    """A precise index on the field before one that isn't. None holds rows without the field."""
    if predicate.op == ir.EQ and predicate.value is None or predicate.op == ir.IN and None in predicate.value:
        return None
    fitting = [i for i in indexes if i.field == predicate.field and predicate.op in i.ops]
    return min(fitting, key=lambda i: not i.precise, default=None)
