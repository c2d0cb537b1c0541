"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round finds the rank of every adjacent
pair by binary search over the sorted pair keys, takes the lowest rank of each word, merges all its
places at once, and lets finished words go. Every merge of the supported vocabularies makes a token
of its own, so merging all places of the lowest pair at once equals merging them one by one.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from driftlog.llm.text_buffers import filled, slices
from driftlog.session import lean, ship_package

NO_RANK = np.iinfo(np.int64).max
CACHED_WORDS = 200_000

_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_LATIN_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: For text whose characters are all below U+0100; any other is cut by ``any_words``.
LATIN_WORDS = re.compile(f"{_CONTRACTIONS}|[{_LATIN}]+|[{_LATIN_NUMBER}]|[^{_SPACE}{_LATIN}{_LATIN_NUMBER}]+")


@cache
def every_letter() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def class_ranges(pattern: str) -> str:
    """The characters of a class of the tokenizers library, whose Unicode version is its own, as ranges for a regex."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    found = Split(Regex(f"{pattern}+"), "removed", invert=True).pre_tokenize_str(every_letter())
    return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for part, _ in found for run in _runs(part))


def _runs(part: str) -> Iterator[str]:
    """Parts of a string without a gap between its characters."""
    begin = 0
    for k in range(1, len(part) + 1):
        if k == len(part) or ord(part[k]) != ord(part[k - 1]) + 1:
            yield part[begin:k]
            begin = k


@cache
def unicode_tables() -> tuple[str, dict[int, str]]:
    """The library's own letters, numbers and white space as a pattern that cuts text into words, and the letters that it
    lowers in another way than Python does. Asked from the library once, on the driver."""
    from tokenizers import normalizers

    letter, number, space = class_ranges(r"\p{L}"), class_ranges(r"\p{N}"), class_ranges(r"\s")
    letters = every_letter().replace("\n", "")
    lowered = normalizers.Lowercase().normalize_str("\n".join(letters)).split("\n")
    other = {ord(a): b for a, b in zip(letters, lowered) if a.lower() != b or a == "Σ"}
    return f"{_CONTRACTIONS}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+", other


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones stand for themselves, the others follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _lowered(text: str, other: dict[int, str]) -> str:
    if not any(ord(c) in other for c in set(text)):
        return text.lower()
    return "".join(other[o] if (o := ord(c)) in other else c.lower() for c in text)


class WordBpe:
    """Encoder and decoder for a tokenizer file with word ends, read from its JSON text; ``tables`` as of ``unicode_tables``."""

    def __init__(self, definition: str, tables: tuple[str, dict[int, str]] | None = None):
        from tokenizers import normalizers

        spec = json.loads(definition)
        pattern, self.lowered_apart = tables or unicode_tables()
        self.any_words, self.composed = regex.compile(pattern), normalizers.NFC().normalize_str
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.final = np.array([vocab[x + end] for x in letters], dtype=np.int64)
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.width = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = np.empty(self.width, dtype=object)
        for token, number in [*vocab.items(), *self.added.items()]:
            self.tokens[number] = token
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make the same token")
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.specials = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.offsets, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def words_of(self, text: str) -> list[str]:
        """The pieces that merges never cross. Added tokens stand for themselves, as their exact text."""
        if self.specials and "<|" in text and (found := self.specials.findall(text)):
            out: list[str] = []
            for k, part in enumerate(self.specials.split(text)):
                out += self.words_of_plain(part)
                if k < len(found):
                    out.append(f"\0{found[k]}")
            return out
        return self.words_of_plain(text)

    def words_of_plain(self, text: str) -> list[str]:
        if text.isascii():
            return LATIN_WORDS.findall(text.lower())
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            # What the library lowers in its own way goes letter by letter, so no form depends on its place in the word.
            return self.any_words.findall(_lowered(self.composed(text), self.lowered_apart))
        return LATIN_WORDS.findall(text.lower())

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, one after another, and how many each has."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[data[last]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK)
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            wanted = symbols[inside] * self.width + symbols[inside + 1]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            rank[inside[hit]] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            runs = np.diff(np.r_[starts, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), runs)
            ended = lowest == NO_RANK
            if ended.any():
                done.append((owner[ended], symbols[ended]))
            merge = (rank == lowest) & ~ended
            places = np.flatnonzero(merge)
            if len(places):
                # Of overlapping places (a, a, a) every second one, from the left.
                first = np.r_[True, np.diff(places) != 1]
                run_start = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run_start) % 2 == 0]
                symbols[places] = self.made[rank[places]]
                stay = ~ended
                stay[places + 1] = False
            else:
                stay = ~ended
            symbols, owner = symbols[stay], owner[stay]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        owners = np.concatenate([o for o, _ in done])
        order = np.argsort(owners, kind="stable")
        return np.concatenate([s for _, s in done])[order], np.bincount(owners, minlength=len(words))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The row of each word in the table of known words, to which new ones are added."""
        known = self.known
        got = [known.get(w, -1) for w in words]
        if -1 in got:
            new = list(dict.fromkeys(w for w, k in zip(words, got) if k < 0))
            special = {w: self.added[w[1:]] for w in new if w[0] == "\0" and w[1:] in self.added}
            plain = [w for w in new if w not in special]
            ids, sizes = self.merged(plain)
            if special:
                ids = np.r_[ids, np.array(list(special.values()), np.int64)]
                sizes = np.r_[sizes, np.ones(len(special), np.int64)]
            for w in [*plain, *special]:
                known[w] = len(known)
            self.offsets = np.r_[self.offsets, len(self.ids) + np.cumsum(sizes) - sizes]
            self.sizes = np.r_[self.sizes, sizes]
            self.ids = np.r_[self.ids, ids]
            got = [known[w] for w in words]
        return np.array(got, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the texts, one after another, and how many each text has."""
        if len(self.known) > CACHED_WORDS:
            self.forget()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found = self.words_of(text)
            counts[k] = len(found)
            words += found
        if not words:
            return np.zeros(0, np.int64), counts
        rows = self.numbers(words)
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.offsets[rows] - (ends - sizes), sizes) + np.arange(ends[-1])]
        upto = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return ids, np.diff(upto)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: the file names no decoder, so tokens are joined by spaces. Ids outside the vocabulary give nothing."""
        ids = ids[(ids >= 0) & (ids < self.width)]
        return " ".join(t for t in self.tokens[ids].tolist() if t is not None)


@lean
def encode_batches(batches: Iterable[pa.RecordBatch], definition: str, tables: tuple) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, ids)."""
    bpe = WordBpe(definition, tables)
    for whole in batches:
        for batch in slices(whole, 1, 1 << 20):
            ids, counts = bpe.encode(filled(batch.column(1)).to_pylist())
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False) if not column.values.null_count else None
    bounds = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        if not valid[k]:
            yield np.zeros(0, np.int64)
        elif values is None:
            yield np.array([x for x in column[k].as_py() if x is not None], np.int64)
        else:
            yield values[bounds[k] : bounds[k + 1]]


@lean
def decode_batches(batches: Iterable[pa.RecordBatch], definition: str, tables: tuple) -> Iterator[pa.RecordBatch]:
    """(id, ids) to (id, ids, text)."""
    bpe = WordBpe(definition, tables)
    for batch in batches:
        texts = pa.array([bpe.decode(ids) for ids in _lists(batch.column(1))], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["id", "ids", "text"])


@lean
def digest_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ids, text) to the id, the number of ids, and the hashes of both."""
    for batch in batches:
        lists = [np.ascontiguousarray(x, dtype="<u4") for x in _lists(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(x) for x in lists], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in lists], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in batch.column(2).to_pylist()], pa.string()),
            ],
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


@lean
def table_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ids, text) to the id, the ids, their number, and the hash of the decoded text."""
    for batch in batches:
        sizes = [len(x) for x in _lists(batch.column(1))]
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())],
            names=["id", "ids", "n_tokens", "decoded_sha256"],
        )


def _definition(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as source:
        return source.read()


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Token ids of every whole text: ``id, ids array<int>``, a row per input row.

    Null texts count as empty and give an empty array, as texts of white space do. Null and repeated
    ids are passed through; an empty table gives an empty result; other columns are ignored. There is
    no truncation, no padding, and no special token but those that stand in the text. Batches are cut
    to slices of some MB, so memory follows the longest single text.
    """
    ship_package(docs.sparkSession)
    definition, tables = _definition(tokenizer), unicode_tables()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = rows.mapInArrow(lambda b: encode_batches(b, definition, tables), f"id {_kind(docs, id_col)}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """Text of every list of ids: ``id, ids, text``. A null list counts as empty; null ids in a list and ids outside the vocabulary give nothing."""
    ship_package(encoded.sparkSession)
    definition, tables = _definition(tokenizer), unicode_tables()
    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].cast("array<int>").alias("ids"))
    out = rows.mapInArrow(lambda b: decode_batches(b, definition, tables), f"id {_kind(encoded, id_col)}, ids array<int>, text string")
    return out.withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``bpe_encode`` and ``bpe_decode`` in one Python pass, as digests: ``id, n_tokens, ids_sha256, decoded_sha256``. Edge cases as there."""
    ship_package(docs.sparkSession)
    definition, tables = _definition(tokenizer), unicode_tables()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = rows.mapInArrow(
        lambda b: digest_batches(decode_batches(encode_batches(b, definition, tables), definition, tables)),
        f"id {_kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
    return out.withColumnRenamed("id", id_col)


def bpe_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``id, ids, n_tokens, decoded_sha256``: encoded texts ready for training, decoded once for a check. Edge cases as ``bpe_encode``."""
    ship_package(docs.sparkSession)
    definition, tables = _definition(tokenizer), unicode_tables()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = rows.mapInArrow(
        lambda b: table_batches(decode_batches(encode_batches(b, definition, tables), definition, tables)),
        f"id {_kind(docs, id_col)}, ids array<int>, n_tokens long, decoded_sha256 string",
    )
    return out.withColumnRenamed("id", id_col)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
