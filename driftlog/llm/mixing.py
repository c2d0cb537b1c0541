"""Mixing sources to target weights by soft membership.

A classifier learned from a table of labels gives every document a posterior over domains. Projected
gradient descent then fits a nonnegative rate for each document, so that the expected tokens of each
domain, posterior times tokens times rate, match the targets in the least-squares sense.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftlog.llm.quality import QualityModel, _adam
from driftlog.llm.shingles import Shingler
from driftlog.llm.text_buffers import filled, flat, slices, unit_hash
from driftlog.llm.text_features import NAMES, features
from driftlog.session import discard, lean, ship_package, written

DOMAINS = ("good", "junk", "toxic")
#: Target tokens of a domain as a multiple of the tokens it is expected to hold.
WEIGHTS = {"good": 1.5, "junk": 0.1, "toxic": 0.1}
#: Bytes of text that a Python worker handles at a time.
SLICE = 1 << 20


def domain_of() -> Column:
    """The domain of a row of labels; null where the labels say nothing."""
    return F.when(F.col("toxic") == 1, F.lit(2)).when(F.col("quality") == 0, F.lit(1)).when(F.col("quality") == 1, F.lit(0))


@dataclass
class DomainModel:
    dense: QualityModel
    words: np.ndarray  # hashes, ascending
    weights: np.ndarray  # (features, domains)

    def inputs(self, data: np.ndarray, bounds: np.ndarray, shingler: Shingler) -> tuple[np.ndarray, np.ndarray]:
        """Dense features, which of the words occur, and a constant; and the number of words."""
        dense = self.dense.inputs(features(data, bounds, shingler))
        words, counts = shingler.word_hashes(data, bounds)
        seen = np.zeros((len(counts), len(self.words)))
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[at] == words
            seen[np.repeat(np.arange(len(counts)), counts)[hit], at[hit]] = 1
        return np.c_[dense, seen, np.ones(len(counts))], counts

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


@lean
def word_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(domain, text) to (word, domain, n): in how many texts of the domain the word occurs."""
    shingler = Shingler(1)
    for whole in batches:
        for batch in slices(whole, 1, SLICE):
            data, bounds = flat(filled(batch.column(1)))
            words, counts = shingler.word_hashes(data, bounds)
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((owner, words))
            w, o = words[order], owner[order]
            fresh = np.ones(len(w), bool)
            fresh[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
            w, d = w[fresh], np.array(batch.column(0).to_pylist(), np.int64)[o[fresh]]
            order = np.lexsort((d, w))
            w, d = w[order], d[order]
            start = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (d[1:] != d[:-1])]) if len(w) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w[start].view(np.int64)), pa.array(d[start].astype(np.int32)), pa.array(np.diff(np.r_[start, len(w)]).astype(np.int64))],
                names=["word", "domain", "n"],
            )


@lean
def input_batches(batches: Iterable[pa.RecordBatch], model: DomainModel) -> Iterator[pa.RecordBatch]:
    """(domain, text) to (domain, inputs)."""
    shingler = Shingler(1)
    for whole in batches:
        for batch in slices(whole, 1, SLICE):
            x, _ = model.inputs(*flat(filled(batch.column(1))), shingler)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["domain", "x"])


def fit_domains(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domains: int = len(DOMAINS), most_rows: int = 8_000, most_words: int = 150
) -> DomainModel:
    """Learns posteriors from labelled documents, at most about ``most_rows`` of them (by the hash of the id).

    ``labels`` has the id and a column ``domain`` with the number of a domain, below ``domains``; null domains are left out. The words
    that tell a domain from the rest best, ``most_words`` of each, are chosen by counts over the same rows.
    """
    ship_package(docs.sparkSession)
    labelled = labels.select(labels[id_col].cast("long").alias("id"), labels["domain"].cast("int").alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL")
    labelled = labelled.groupBy("id").agg(F.min("domain").alias("domain"))
    n = labelled.count()
    if n > most_rows:
        labelled = labelled.where(unit_hash(F.col("id"), 5) < most_rows / n)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    sample = written(rows.join(F.broadcast(labelled), "id").select("domain", "text"), "mixing-labelled")

    width = len(NAMES)
    blank = QualityModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:  # nothing to tell apart: the posterior is the only domain's, or even
        weights = np.zeros((width + 1, domains))
        for d in sizes:
            weights[-1, d] = 30
        return DomainModel(blank, np.zeros(0, np.uint64), weights)
    words = _telling_words(sample, sizes, most_words)
    draft = DomainModel(blank, words, np.zeros(0))
    x, y = _collected(sample, draft)
    dense = np.where(x[:, :width] == 0, 0, x[:, :width])
    blank = QualityModel(dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3), np.zeros(width), 0.0, 0.5)
    model = DomainModel(blank, words, np.zeros(0))
    x, y = _collected(sample, model)
    target = np.eye(domains)[y]
    theta = np.zeros((x.shape[1], domains))

    def gradient(flat_theta):
        z = x @ flat_theta.reshape(theta.shape)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return (x.T @ (p - target) / len(x) + 1e-4 * flat_theta.reshape(theta.shape)).ravel()

    model.weights = _adam(theta.ravel(), gradient, 300, 0.05).reshape(theta.shape)
    discard(sample)
    return model


def _telling_words(sample: DataFrame, sizes: dict[int, int], most: int) -> np.ndarray:
    counts = sample.mapInArrow(word_batches, "word long, domain int, n long").groupBy("word").pivot("domain", sorted(sizes)).agg(F.sum("n")).na.fill(0)
    total = sum(sizes.values())
    found: set[int] = set()
    for d, size in sizes.items():
        inside = F.col(str(d))
        outside = sum((F.col(str(o)) for o in sizes if o != d), F.lit(0))
        odds = F.log((inside + 0.5) / (size + 1.0)) - F.log((outside + 0.5) / (total - size + 1.0))
        best = counts.where(inside >= 5).orderBy(F.desc(inside * odds), "word").limit(most)
        found |= {r["word"] for r in best.select("word").collect()}
    return np.sort(np.array(sorted(found), np.int64).view(np.uint64))


def _collected(sample: DataFrame, model: DomainModel) -> tuple[np.ndarray, np.ndarray]:
    got = sample.mapInArrow(lambda b: input_batches(b, model), "domain int, x array<float>").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, -1)
    return x.astype(np.float64), got["domain"].to_numpy().astype(np.int64)


@lean
def member_batches(batches: Iterable[pa.RecordBatch], model: DomainModel) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n_tokens, posterior)."""
    shingler = Shingler(1)
    for whole in batches:
        for batch in slices(whole, 1, SLICE):
            x, counts = model.inputs(*flat(filled(batch.column(1))), shingler)
            p = model.posteriors(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), lists], names=["id", "n_tokens", "posterior"])


def rates_of(posterior: np.ndarray, history: np.ndarray) -> np.ndarray:
    """The rates after the given steps: each is projected gradient descent from rate 1, and depends on the
    other documents only through a direction over the domains, a few numbers a step."""
    rate = np.ones(len(posterior))
    for direction in history:
        rate = np.maximum(0.0, rate - posterior @ direction)
    return rate


def _matrix(column: pa.Array, domains: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), domains) if len(column) else np.zeros((0, domains))


def sum_batches(batches: Iterable[pa.RecordBatch], history: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, n_tokens, posterior) to (at, value): what the rates give each domain, then how the posteriors of documents
    that a step can move overlap, weighted by tokens."""
    domains = history.shape[1]
    total, overlap = np.zeros(domains), np.zeros((domains, domains))
    for batch in batches:
        p = _matrix(batch.column(2), domains)
        rate, tokens = rates_of(p, history), batch.column(1).to_numpy().astype(float)
        total += (tokens * rate) @ p
        moved = p[rate > 0] * tokens[rate > 0][:, None]
        overlap += moved.T @ p[rate > 0]
    values = np.r_[total, overlap.ravel()]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["at", "value"])


def rate_batches(batches: Iterable[pa.RecordBatch], history: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, n_tokens, posterior) with the rate."""
    for batch in batches:
        rate = rates_of(_matrix(batch.column(2), history.shape[1]), history)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=["id", "n_tokens", "posterior", "rate"])


@dataclass
class Fit:
    """The steps of the descent; tokens that the domains held, should have, and have; the largest miss against the targets."""

    history: np.ndarray
    held: np.ndarray
    target: np.ndarray
    reached: np.ndarray
    gap: float


def fit_rates(
    members: DataFrame, names: tuple[str, ...] = DOMAINS, weights: dict[str, float] | None = None, shares: dict[str, float] | None = None, most_steps: int = 40, tolerance: float = 1e-3
) -> Fit:
    """Nonnegative rates of ``members`` (id, n_tokens, posterior) by projected gradient descent.

    A domain's target is its weight times the tokens it is expected to hold; or, if ``shares`` are given, its share of
    all tokens. The gradient is scaled by the inverse of the domains' overlap, so that a step that no rate's bound
    stops would meet all targets at once. Descent stops when every domain is within ``tolerance`` of its target, when ten steps
    bring it no nearer, or after ``most_steps``; a gap that is left is told by a warning and in the result: targets may be out of
    reach for nonnegative rates. A step is one pass over the small table and brings one row a task of sums together; nothing is kept
    between steps but the directions, so a lost executor costs its running tasks. Without tokens all rates are 1.
    """
    domains = len(names)

    def sums(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = members.mapInArrow(lambda b: sum_batches(b, history), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        values = np.zeros(domains + domains**2)
        for r in got:
            values[r["at"]] = r["value"]
        return values[:domains], values[domains:].reshape(domains, domains)

    history = np.zeros((0, domains))
    held, overlap = sums(history)
    total = held.sum()
    if shares is not None:
        target = total * np.array([shares.get(d, 0.0) for d in names]) / max(sum(shares.values()), 1e-300)
    else:
        target = held * np.array([(weights or WEIGHTS).get(d, 1.0) for d in names])
    if total <= 0:
        return Fit(history, held, target, held, 0.0)
    miss = lambda now: float((np.abs(now - target) / np.maximum(target, tolerance * total)).max())
    now, step, best, since, found = held, 1.0, miss(held), 0, history
    reached = held
    while best > tolerance and len(history) < most_steps and since < 10:
        damped = overlap + 1e-9 * total * np.eye(domains)
        history = np.vstack([history, step * np.linalg.solve(damped, now - target)])
        now, overlap = sums(history)
        if miss(now) < best:
            since = 0 if miss(now) < 0.9 * best else since + 1
            best, found, reached = miss(now), history, now
        else:
            step, since = max(step / 2, 1 / 64), since + 1
    if best > tolerance:
        warnings.warn(f"targets are missed by up to {best:.3g} of their size: " + ", ".join(f"{d} {g:.4g} of {t:.4g}" for d, g, t in zip(names, reached, target)), stacklevel=2)
    return Fit(found, held, target, reached, best)


def _fitted(docs, labels, weights, shares, domains, label, id_col, text_col) -> tuple[DomainModel, DataFrame, Fit]:
    ship_package(docs.sparkSession)
    model = fit_domains(docs, labels.withColumn("domain", domain_of() if label is None else label), id_col, text_col, len(domains))
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    members = written(rows.mapInArrow(lambda b: member_batches(b, model), "id long, n_tokens long, posterior array<double>"), "mixing-members")
    return model, members, fit_rates(members, domains, weights, shares)


def _part(ids: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(ids.cast("long"), F.lit(0)), F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def mixture(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", shares: dict[str, float] | None = None,
    domains: tuple[str, ...] = DOMAINS, label: Column | None = None,
) -> DataFrame:
    """``id, n_tokens, p_<domain>..., rate, copies, gap`` of every row of ``docs``.

    ``label`` gives the number of a domain for a row of ``labels``; by default it comes from quality and toxic. ``weights`` or ``shares``
    set the targets, see ``fit_rates``; ``gap`` is the largest miss against them, the same in every row. Null and empty texts have no tokens
    and take part with their posterior alone; repeated rows each take part; null ids get copies as if of id 0; an empty
    table gives an empty result; other columns are ignored. ``copies`` is the rate rounded up or down by the hash of the id, so that
    its expectation is the rate. Ties can't arise: equal texts have equal rates.
    """
    _, members, fit = _fitted(docs, labels, weights, shares, domains, label, id_col, text_col)
    rated = members.mapInArrow(lambda b: rate_batches(b, fit.history), "id long, n_tokens long, posterior array<double>, rate double")
    return rated.select(
        F.col("id").alias(id_col), "n_tokens", *(F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(domains)),
        "rate", F.floor(F.col("rate") + _part(F.col("id"))).cast("int").alias("copies"), F.lit(fit.gap).alias("gap"),
    )


@lean
def mixed_batches(batches: Iterable[pa.RecordBatch], model: DomainModel, history: np.ndarray, text_at: int) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is the part that rounds up, to each row as often as its rate says, without that column."""
    shingler = Shingler(1)
    for whole in batches:
        for batch in slices(whole, text_at, SLICE):
            x, _ = model.inputs(*flat(filled(batch.column(text_at))), shingler)
            copies = np.floor(rates_of(model.posteriors(x), history) + batch.column(batch.num_columns - 1).to_numpy()).astype(np.int64)
            kept = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            yield kept.take(pa.array(np.repeat(np.arange(len(copies)), copies)))


def mix(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", shares: dict[str, float] | None = None,
    domains: tuple[str, ...] = DOMAINS, label: Column | None = None,
) -> DataFrame:
    """``docs`` with each row as often as its rate says; columns as they came.

    Texts are read once to fit and once to be copied where they lie: nothing but sums is shuffled, and rows need no
    key, so rows of a repeated or null id each go by their own text.
    """
    model, members, fit = _fitted(docs, labels, weights, shares, domains, label, id_col, text_col)
    discard(members)
    at, last = docs.columns.index(text_col), "_part"
    while last in docs.columns:
        last += "_"
    shape = StructType(docs.schema.fields)
    return docs.select("*", _part(docs[id_col]).alias(last)).mapInArrow(lambda b: mixed_batches(b, model, fit.history, at), shape)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rates and copies of all documents."""
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
