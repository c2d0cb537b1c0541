"""Language identification by unigram piece models, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is
the sum over all ways to cut it into pieces, found by a forward pass; probabilities come from expected
piece counts (forward and backward passes under a base model whose weights fall with a piece's rank).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.text_buffers import filled, slices, sums, unit_hash
from driftlog.session import lean, ship_package

UNDETERMINED = "und"
MARK = "▁"
CACHED_WORDS = 300_000
#: Words up to this length are summed as plain numbers, longer ones, and those whose sum comes out below TINY, as logarithms.
PLAIN_LENGTH, TINY = 48, 1e-250
#: Scales probabilities by letter so that products stay near 1; it cancels out.
LETTER_SCALE = 2.5

_NUMERALS = "".join(
    chr(c) for c in range(0x110000) if chr(c).isalnum() and not chr(c).isalpha() and unicodedata.category(chr(c)) != "Nd"
)
#: Runs of letters: of any text, of text without numerals that word characters hold, of ASCII in lower case.
LETTERS = re.compile(rf"[^\W\d_{re.escape(_NUMERALS)}]+")
_NUMERAL_SET = frozenset(_NUMERALS)
_LATIN_NUMERALS = [c for c in _NUMERALS if c < "\u0100"]
_FAST, _ASCII = re.compile(r"[^\W\d_]+"), re.compile(r"[a-z]+")


def letter_pieces(model_file: str | None = None) -> list[str]:
    """The vocabulary's lower-case pieces of letters, with or without the mark of a word's start, in order of rank."""
    import sentencepiece

    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [p for p in found if (x := p.removeprefix(MARK)) == x.lower() and (not x or LETTERS.fullmatch(x))]


class PieceTrie:
    """Finds all pieces that begin at each letter of many words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.unknown = len(pieces)
        letters = sorted({c for p in pieces for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        for k, c in enumerate(letters, 1):
            self.letter[ord(c)] = k
        self.width = len(letters) + 1
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for number, piece in enumerate(pieces):
            at = 0
            for c in piece:
                at = nodes.setdefault((at, int(self.letter[ord(c)])), len(nodes) + 1)
            ends[at] = number
        keys = np.array([a * self.width + b for a, b in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        for node, number in ends.items():
            self.piece[node] = number
        # The first two letters are looked up in a table, the rest by binary search.
        self.root = np.zeros(self.width, np.int64)
        for (a, b), node in nodes.items():
            if a == 0:
                self.root[b] = node
        self.longest = max(map(len, pieces))

    def edges(self, letters: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, length, piece) of each piece found; ``ends[i]`` is where the word of letter i ends. A letter
        that is no piece itself gets the unknown piece, so that every word can be cut."""
        at = np.arange(len(letters))
        state = self.root[letters]
        single = self.piece[state]
        starts = [at]
        numbers = [np.where((state > 0) & (single >= 0), single, self.unknown)]
        lengths = [np.ones(len(at), np.int64)]
        for m in range(2, self.longest + 1):
            alive = (state > 0) & (at + m <= ends[at])
            at, state = at[alive], state[alive]
            if not len(at):
                break
            wanted = state * self.width + letters[at + m - 1]
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            state = np.where(self.keys[place] == wanted, self.to[place], 0)
            hit = self.piece[state] >= 0
            hit &= state > 0
            starts.append(at[hit])
            numbers.append(self.piece[state[hit]])
            lengths.append(np.full(int(hit.sum()), m))
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(numbers)


@dataclass
class Lattice:
    """All pieces of some words; nodes are places between letters, one more than letters in each word."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    length: np.ndarray
    first: np.ndarray
    last: np.ndarray
    nodes: int


def lattice(words: list[str], trie: PieceTrie) -> Lattice:
    marked = [MARK + w for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    letters = trie.letter[np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)]
    finish = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    start, length, piece = trie.edges(letters, finish[owner])
    first = finish - sizes + np.arange(len(words))
    shift = owner[start]
    return Lattice(start + shift, start + shift + length, piece, length, first, first + sizes, len(letters) + len(words))


def _passes(order: np.ndarray, target: np.ndarray, step: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of edges of one step, sorted by target: the edges, where each target's run begins, the targets."""
    cuts = np.flatnonzero(np.r_[True, step[order][1:] != step[order][:-1], True])
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        these = order[lo:hi]
        to = target[these]
        runs = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        yield these, runs, to[runs]


def forward(net: Lattice, logp: np.ndarray, log_space: bool) -> np.ndarray:
    """Sum over all cuts up to each node, a column per model. ``logp``: (pieces + 1, models)."""
    weight = logp[net.piece] + LETTER_SCALE * net.length[:, None]
    word = np.searchsorted(net.first, net.end, side="right") - 1
    step = net.end - net.first[word]
    order = np.lexsort((net.end, step))
    if log_space:
        alpha = np.full((net.nodes, logp.shape[1]), -np.inf)
        alpha[net.first] = 0.0
        for these, runs, to in _passes(order, net.end, step):
            alpha[to] = np.logaddexp.reduceat(alpha[net.start[these]] + weight[these], runs, axis=0)
        return alpha
    weight = np.exp(weight)
    alpha = np.zeros((net.nodes, logp.shape[1]))
    alpha[net.first] = 1.0
    for these, runs, to in _passes(order, net.end, step):
        alpha[to] = np.add.reduceat(alpha[net.start[these]] * weight[these], runs, axis=0)
    return alpha


def backward(net: Lattice, logp: np.ndarray, log_space: bool) -> np.ndarray:
    """As ``forward``, from each node to its word's end."""
    weight = logp[net.piece] + LETTER_SCALE * net.length[:, None]
    word = np.searchsorted(net.first, net.end, side="right") - 1
    step = net.last[word] - net.start
    order = np.lexsort((net.start, step))
    beta = np.full((net.nodes, logp.shape[1]), -np.inf if log_space else 0.0)
    beta[net.last] = 0.0 if log_space else 1.0
    if not log_space:
        weight = np.exp(weight)
    for these, runs, to in _passes(order, net.start, step):
        if log_space:
            beta[to] = np.logaddexp.reduceat(beta[net.end[these]] + weight[these], runs, axis=0)
        else:
            beta[to] = np.add.reduceat(beta[net.end[these]] * weight[these], runs, axis=0)
    return beta


def _plain(words: list[str], trie: PieceTrie, logp: np.ndarray) -> tuple[np.ndarray, Lattice | None, np.ndarray]:
    """Which words plain numbers hold: short ones, under models that don't make them next to impossible; their
    lattice and forward sums."""
    plain = np.fromiter((len(w) <= PLAIN_LENGTH for w in words), bool, len(words))
    if not plain.any():
        return plain, None, np.zeros((0, logp.shape[1]))
    net = lattice([w for w, p in zip(words, plain) if p], trie)
    alpha = forward(net, logp, False)
    low = alpha[net.last].min(axis=1) < TINY
    if low.any():
        plain[np.flatnonzero(plain)[low]] = False
        return _plain_of(words, plain, trie, logp)
    return plain, net, alpha


def _plain_of(words: list[str], plain: np.ndarray, trie: PieceTrie, logp: np.ndarray) -> tuple[np.ndarray, Lattice | None, np.ndarray]:
    some = [w for w, p in zip(words, plain) if p]
    net = lattice(some, trie) if some else None
    return plain, net, forward(net, logp, False) if net else np.zeros((0, logp.shape[1]))


def word_logs(words: list[str], trie: PieceTrie, logp: np.ndarray) -> np.ndarray:
    """Log likelihood of each word by each model, over all its segmentations."""
    out = np.zeros((len(words), logp.shape[1]))
    plain, net, alpha = _plain(words, trie, logp)
    if net:
        out[plain] = np.log(alpha[net.last]) - LETTER_SCALE * (net.last - net.first)[:, None]
    if not plain.all():
        net = lattice([w for w, p in zip(words, plain) if not p], trie)
        out[~plain] = forward(net, logp, True)[net.last] - LETTER_SCALE * (net.last - net.first)[:, None]
    return out


def piece_counts(words: list[str], times: np.ndarray, trie: PieceTrie, logp: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, over all their segmentations under one model."""
    total = np.zeros(len(logp))
    plain, net, alpha = _plain(words, trie, logp)
    for log_space, some in ((False, plain), (True, ~plain)):
        if not some.any():
            continue
        if log_space:
            net = lattice([w for w, p in zip(words, some) if p], trie)
            alpha = forward(net, logp, True)
        a, b = alpha[:, 0], backward(net, logp, log_space)[:, 0]
        word = np.searchsorted(net.first, net.start, side="right") - 1
        edge = logp[net.piece, 0] + LETTER_SCALE * net.length
        if log_space:
            share = np.exp(a[net.start] + edge + b[net.end] - a[net.last][word])
        else:
            share = a[net.start] * np.exp(edge) * b[net.end] / a[net.last][word]
        total += np.bincount(net.piece, share * times[some][word], minlength=len(logp))
    return total


def words_of(text: str) -> list[str]:
    text = text.lower()
    if text.isascii():
        return _ASCII.findall(text)
    try:
        text.encode("latin-1")
        plain = not any(c in text for c in _LATIN_NUMERALS)
    except UnicodeEncodeError:
        plain = _NUMERAL_SET.isdisjoint(text)
    return (_FAST if plain else LETTERS).findall(text)


def base_logs(pieces: list[str], offset: float = 200.0, unknown: float = 1e-9) -> np.ndarray:
    """The base model: weight falls with the rank in the vocabulary; unknown letters are rare."""
    weight = 1.0 / (offset + np.arange(len(pieces)))
    return np.log(np.r_[weight / weight.sum(), unknown])[:, None]


def _parts(words: list[str], letters: int = 200_000) -> Iterator[list[str]]:
    """Runs of words with about so many letters, so that lattices stay small; a longer word is a run of its own."""
    run: list[str] = []
    size = 0
    for w in words:
        if run and size + len(w) > letters:
            yield run
            run, size = [], 0
        run.append(w)
        size += len(w) + 1
    if run:
        yield run


@lean
def expected_counts(batches: Iterable[pa.RecordBatch], pieces: list[str]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, piece, count): expected counts under the base model, a row per language and piece at most."""
    trie, logp = PieceTrie(pieces), base_logs(pieces)
    total: dict[str, np.ndarray] = {}

    def add(counts: dict[str, dict[str, int]]) -> None:
        for lang, of in counts.items():
            words = list(of)
            for some in _parts(words):
                total[lang] = total.get(lang, 0) + piece_counts(some, np.array([of[w] for w in some], float), trie, logp)

    waiting: dict[str, dict[str, int]] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), filled(batch.column(1)).to_pylist()):
            of = waiting.setdefault(lang, {})
            for w in words_of(text):
                of[w] = of.get(w, 0) + 1
            if len(of) > CACHED_WORDS:
                add({lang: waiting.pop(lang)})
    add(waiting)
    for lang, counts in total.items():
        there = np.flatnonzero(counts[:-1] > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(counts[there])],
            names=["lang", "piece", "n"],
        )


@dataclass
class LanguageModel:
    """Languages, the vocabulary, and log probabilities (pieces + 1, languages)."""

    langs: list[str]
    pieces: list[str]
    logp: np.ndarray


def fit_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fit_docs: int = 6000,
    smoothing: float = 200.0,
    model_file: str | None = None,
) -> LanguageModel:
    """Piece probabilities of every language of ``docs``.

    At most about ``fit_docs`` rows of a language are used: rows are taken by the hash of their id, with
    a fraction set from the language's row count. Words of any length, and of letters that are no piece, take part. Rows with a null language are left out; null texts add
    nothing. The counts that reach the driver are at most one row for each language and piece.
    A table without languages gives a model without any, under which every text is undetermined.
    """
    ship_package(docs.sparkSession)
    pieces = letter_pieces(model_file)
    rows = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), unit_hash(F.col(id_col)).alias("_u")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    share: Column = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, fit_docs / sizes[lang]))).otherwise(share)
    counted = (
        rows.where(F.col("_u") < share)
        .select("lang", "text")
        .mapInArrow(lambda b: expected_counts(b, pieces), "lang string, piece int, n double")
        .groupBy("lang", "piece")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    base = np.exp(base_logs(pieces)[:, 0])
    counts = np.zeros((len(pieces) + 1, len(langs)))
    column = {x: k for k, x in enumerate(langs)}
    counts[counted["piece"].to_numpy(), [column[x] for x in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    counts += smoothing * base[:, None]
    return LanguageModel(langs, pieces, np.log(counts / counts.sum(axis=0)))


def predictor(model: LanguageModel):
    """A function from texts to the number of the best language (that of none: one more than the last) and its score."""
    trie = PieceTrie(model.pieces)
    known: dict[str, int] = {}
    logs = np.zeros((0, len(model.langs)))

    def predict(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal known, logs
        if len(known) > CACHED_WORDS:
            known, logs = {}, np.zeros((0, len(model.langs)))
        found = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        if not model.langs:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts))
        flat = [w for ws in found for w in ws]
        get = known.get
        rows = [get(w, -1) for w in flat]
        if -1 in rows:
            new = list(dict.fromkeys(w for w, k in zip(flat, rows) if k < 0))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            logs = np.concatenate([logs, *(word_logs(some, trie, model.logp) for some in _parts(new))])
            rows = [get(w) for w in flat]
        total = sums(logs[np.array(rows, np.int64)], counts)
        score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return np.where(counts == 0, len(model.langs), total.argmax(axis=1)), np.where(counts == 0, 0.0, score)

    return predict


@lean
def predict_batches(batches: Iterable[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, lang_pred, score)."""
    predict = predictor(model)
    names = np.array([*model.langs, UNDETERMINED], dtype=object)
    for whole in batches:
        for batch in slices(whole, 1, 1 << 20):
            best, score = predict(filled(batch.column(1)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"]
            )


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for every whole text, a row per input row.

    The score is the posterior of the best language under equal priors. Null texts and texts without a
    letter are ``und`` with score 0. Ties go to the language first in order of its name. Null and
    repeated ids pass through, an empty table gives an empty result, other columns are ignored. Words of
    any length count in full.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lambda b: predict_batches(b, model), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


@lean
def accepted_batches(batches: Iterable[pa.RecordBatch], model: LanguageModel, text_at: int, least: float) -> Iterator[pa.RecordBatch]:
    """The rows whose language is determined with at least the given score."""
    scored = predictor(model)
    for whole in batches:
        for batch in slices(whole, text_at, 1 << 20):
            lang, score = scored(filled(batch.column(text_at)).to_pylist())
            yield batch.filter(pa.array((lang < len(model.langs)) & (score >= least)))


def keep_determined(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language can't be told: those that ``predict_languages`` calls ``und`` and
    those below ``least``. Columns and other rows as they came; nothing is shuffled."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda b: accepted_batches(b, model, at, least), docs.schema)


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learned from the rows that aren't held out."""
    model = fit_languages(docs.where(~held_out()))
    return predict_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
