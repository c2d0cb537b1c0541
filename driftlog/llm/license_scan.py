"""License scans: ordered signature rules behind a keyword prefilter.

All keyword anchors are sought in the bytes of many documents at once; only documents that hold one
are looked at by rule, and only rules whose keywords all occur run their pattern. A detection whose
span lies within the span of one of better or equal priority is suppressed; base phrases stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.license_rules import Rule, rules, shortened
from driftlog.llm.text_buffers import filled, flat, per_row_counts, slices
from driftlog.session import lean, ship_package

DETECTION = "struct<rule:string,label:string,base:boolean,priority:int,weight:double,word:bigint,from_byte:bigint,to_byte:bigint>"
_DETECTION_ARROW = pa.list_(
    pa.struct(
        [
            ("rule", pa.string()), ("label", pa.string()), ("base", pa.bool_()), ("priority", pa.int32()),
            ("weight", pa.float64()), ("word", pa.int64()), ("from_byte", pa.int64()), ("to_byte", pa.int64()),
        ]
    )
)

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where words begin in the flat bytes; no word crosses a row."""
    inside = WORD_BYTES[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[firsts] = inside[firsts]
    return np.flatnonzero(starts)


def anchors_of(table: list[Rule]) -> list[bytes]:
    """A few keywords so that every rule has one: the commonest are taken first."""
    left, out = list(table), []
    while left:
        counts: dict[bytes, int] = {}
        for rule in left:
            for k in rule.keywords:
                counts[k] = counts.get(k, 0) + 1
        best = max(counts, key=lambda k: (counts[k], len(k), k))
        out.append(best)
        left = [r for r in left if best not in r.keywords]
    return out


def suppressed(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """Detections that no other of better or equal priority contains; base ones always stay.

    Of equal spans and priorities the first in rule order stays.
    """
    base = [d for d in found if d[0].base]
    rest = sorted((d for d in found if not d[0].base), key=lambda d: (d[0].priority, d[1] - d[2], d[1]))
    kept: list[tuple[Rule, int, int]] = []
    # Spans that no kept one contains, by start; their ends ascend too, so the last that starts early enough decides.
    lows: list[int] = []
    highs: list[int] = []
    for rule, lo, hi in rest:
        at = bisect_right(lows, lo)
        if at and highs[at - 1] >= hi:
            continue
        kept.append((rule, lo, hi))
        end = bisect_right(highs, hi, at)
        lows[at:end], highs[at:end] = [lo], [hi]
    return sorted(base + kept, key=lambda d: (d[1], -d[2], d[0].priority))


def windows(places: list[int], reach: int, width: int, size: int) -> Iterator[tuple[int, int]]:
    """The parts of a text within reach of the places, joined where they meet."""
    lo = hi = -1
    for at in places:
        a, b = max(at - reach, 0), min(at + width + reach + 1, size)
        if lo < 0:
            lo, hi = a, b
        elif a <= hi:
            hi = b
        else:
            yield lo, hi
            lo, hi = a, b
    yield lo, hi


class Scanner:
    """The rules, with what is needed to look only around their keywords."""

    def __init__(self, table: list[Rule] | None = None):
        self.table = rules() if table is None else table
        self.anchors = anchors_of(self.table)
        self.reach = [r.reach() for r in self.table]
        self.pivot = [max(r.keywords, key=len) for r in self.table]
        self.words = sorted({k for r in self.table for k in r.keywords})

    def detections(self, text: bytes) -> list[tuple[Rule, int, int]]:
        """What the rules find in one lower-cased text, after suppression.

        A match holds its keywords, so a pattern is tried no further than its greatest width from one
        of them (base phrases have no such width and see the whole text). Spans are those in the text as given.
        """
        text, at, origin = shortened(text)
        places: dict[bytes, list[int]] = {}
        for k in self.words:
            if k in text:
                places[k] = [m.start() for m in re.finditer(re.escape(k), text)]
        found = []
        for rule, reach, pivot in zip(self.table, self.reach, self.pivot):
            if pivot in places and all(k in places for k in rule.keywords):
                for lo, hi in windows(places[pivot], reach, len(pivot), len(text)):
                    found += [(rule, m.start(), m.end()) for m in rule.pattern.finditer(text, lo, hi)]
        if len(at) > 1:
            there = lambda k: k + origin[(j := bisect_right(at, k) - 1)] - at[j]
            found = [(rule, there(a), there(b - 1) + 1) for rule, a, b in found]
        return suppressed(found)


@lean
def scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n_words, detections)."""
    scanner = Scanner()
    for whole in batches:
        for batch in slices(whole, 1, 1 << 20):
            data, bounds = flat(filled(batch.column(1)))
            starts = word_starts(data, bounds)
            lowered = data.tobytes().lower()
            rows: set[int] = set()
            for anchor in scanner.anchors:
                at = lowered.find(anchor)
                while at >= 0:
                    row = int(np.searchsorted(bounds, at, side="right")) - 1
                    rows.add(row)
                    at = lowered.find(anchor, max(at + 1, int(bounds[row + 1]) - len(anchor) + 1))
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row in rows:
                lo = int(bounds[row])
                first = np.searchsorted(starts, lo)
                out[row] = [
                    {
                        "rule": rule.name, "label": rule.label, "base": rule.base, "priority": rule.priority, "weight": rule.weight,
                        "word": int(np.searchsorted(starts, lo + a) - first), "from_byte": a, "to_byte": b,
                    }
                    for rule, a, b in scanner.detections(lowered[lo : int(bounds[row + 1])])
                ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(per_row_counts(starts, bounds), pa.int64()), pa.array(out, _DETECTION_ARROW)],
                names=["id", "n_words", "detections"],
            )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence detections of every whole text: ``id, n_words, detections``, a row per input row.

    Null texts count as empty: no words, no detections. Repeated rows are scanned each; null ids pass
    through; an empty table gives an empty result; other columns are ignored. Spans are byte offsets
    in the UTF-8 text, ``word`` is the number of words before the span. Equal spans of equal priority
    give one detection, that of the first rule.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(scan_batches, f"id {kind}, n_words long, detections array<{DETECTION}>").withColumnRenamed("id", id_col)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents: base places and labels, and those of the rules."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("detections", lambda d: d["base"])
    labels = lambda of: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
