"""Features of whole texts that classifiers share, from flat bytes in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from driftlog.llm.shingles import Shingler
from driftlog.llm.text_buffers import filled, flat, per_row_counts, slices
from driftlog.session import lean

NAMES = (
    "log_words", "word_length", "upper", "digit", "space", "wide", "stop", "comma", "bang", "question", "pipe", "symbol",
    "quote", "bracket", "slash", "at", "equals", "dash", "line_words", "short_lines", "distinct_words", "repeated_lines",
    "symbol_ends", "empty",
)

_CLASSES = {
    "upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "wide": range(0x80, 0x100), "stop": b".", "comma": b",;:", "bang": b"!", "question": b"?",
    "pipe": b"|", "symbol": b"#$%&*^~+<>", "quote": b"\"'`", "bracket": b"()[]{}", "slash": b"/\\", "at": b"@", "equals": b"=", "dash": b"-_",
}
_TABLE = np.zeros(256, np.int64)
for _k, _members in enumerate(_CLASSES.values(), 1):
    _TABLE[list(_members)] = _k
_ODD = np.zeros(256, bool)
_ODD[list(b"#$%&*^~+<>|!@=")] = True


def features(data: np.ndarray, bounds: np.ndarray, shingler: Shingler) -> np.ndarray:
    """A row of features for each text; shares are of the text's bytes, words or lines."""
    rows = len(bounds) - 1
    size = np.diff(bounds)
    row = np.repeat(np.arange(rows), size)
    words, n_words = shingler.word_hashes(data, bounds)
    owner = np.repeat(np.arange(rows), n_words)
    kinds = np.bincount(row * (len(_CLASSES) + 1) + _TABLE[data], minlength=rows * (len(_CLASSES) + 1)).reshape(rows, -1)
    space = np.isin(data, np.frombuffer(b" \t\r\n\v\f", np.uint8))
    n_space = per_row_counts(np.flatnonzero(space), bounds)
    breaks = np.flatnonzero(data == 0x0A)
    n_lines = per_row_counts(breaks, bounds) + 1

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        v, o = values[order], of[order]
        fresh = np.ones(len(v), bool)
        fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[fresh], minlength=rows)

    # Lines, as sums of their words' hashes.
    line_of_byte = np.cumsum(data == 0x0A) + row
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(data) else np.zeros(0, np.int64)
    firsts = bounds[:-1][size > 0]
    begins = np.union1d(begins, firsts[~space[firsts]]) if len(data) else begins
    line = line_of_byte[begins]
    lines = int(line_of_byte[-1]) + 1 if len(data) else 0
    per_line = np.bincount(line, minlength=lines)
    line_hash = np.zeros(lines, np.uint64)
    if len(words) == len(begins):
        np.add.at(line_hash, line, words)
    line_row = np.zeros(lines, np.int64)
    line_row[line_of_byte] = row
    full = per_line > 0
    short = np.bincount(line_row[full & (per_line <= 3)], minlength=rows)
    filled_lines = np.bincount(line_row[full], minlength=rows)
    fresh_lines = distinct(line_hash[full], line_row[full])
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) if len(data) else begins
    odd_ends = np.bincount(row[ends[_ODD[data[ends]]]], minlength=rows)

    n = np.maximum(size, 1)
    w = np.maximum(n_words, 1)
    out = np.zeros((rows, len(NAMES)))
    column = {name: k for k, name in enumerate(NAMES)}
    out[:, column["log_words"]] = np.log1p(n_words) / 8
    out[:, column["word_length"]] = np.minimum((size - n_space) / w, 40) / 10
    for k, name in enumerate(_CLASSES, 1):
        out[:, column[name]] = kinds[:, k] / n
    out[:, column["space"]] = n_space / n
    out[:, column["line_words"]] = np.log1p(n_words / n_lines) / 5
    out[:, column["short_lines"]] = short / np.maximum(filled_lines, 1)
    # Distinct words fall with length by themselves; the root of the length takes most of that away.
    out[:, column["distinct_words"]] = distinct(words, owner) / w * np.log1p(n_words) / 8
    out[:, column["repeated_lines"]] = 1 - fresh_lines / np.maximum(filled_lines, 1)
    out[:, column["symbol_ends"]] = odd_ends / w
    out[:, column["empty"]] = n_words == 0
    return out


def feature_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each part of the (id, text, ...) batches with the features of its rows."""
    shingler = Shingler(1)
    for whole in batches:
        for batch in slices(whole, 1, 1 << 20):
            data, bounds = flat(filled(batch.column(1)))
            yield batch, features(data, bounds, shingler)


@lean
def collected_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, features)."""
    for batch, x in feature_batches(batches):
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "x"])
