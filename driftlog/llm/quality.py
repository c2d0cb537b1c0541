"""Quality classifier by positive-unlabelled learning.

A logistic model over text features minimises the non-negative unbiased risk: trusted positives stand
for the positive class, unlabelled web text for the mixture, and the class prior, which the risk
needs, is estimated from both.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.text_buffers import unit_hash
from driftlog.llm.text_features import NAMES, collected_batches, feature_batches
from driftlog.session import lean, ship_package


LENGTH = NAMES.index("log_words")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, drawn to 0 for short texts, whose shares are noise."""
        words = np.expm1(8 * x[:, [LENGTH]])
        z = np.clip((x - self.mean) / self.scale, -6, 6) * words / (words + 20)
        z[:, LENGTH] = 0
        return z

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x))


def _adam(start: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    theta, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(theta)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def prior_cuts(positive: np.ndarray, least: float = 0.02) -> np.ndarray:
    """Scores at which the tails of positives are compared with those of all rows."""
    return np.quantile(positive, np.linspace(0.0, 1.0 - max(least, 20 / max(len(positive), 21)), 200))


def estimate_prior(positive: np.ndarray, cuts: np.ndarray, above: np.ndarray, rows: int) -> float:
    """The share of positives among all rows, by the best bin of a classifier's scores: the least ratio of tails,
    all rows to positives, each tail with a margin for its size. ``above``: how many of the rows reach each cut."""
    tail_p = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    tail_u = above / max(rows, 1)
    margin = np.sqrt(np.log(20) / (2 * len(positive))) + np.sqrt(np.log(20) / (2 * max(rows, 1)))
    best = int(np.argmin((tail_u + margin) / tail_p))
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.98))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior=None, steps: int = 500, decay: float = 1e-3) -> QualityModel:
    """Non-negative PU learning. Without positives or unlabelled rows the model gives the same score to all.

    ``unlabelled`` are rows of the whole mixture, positives among them. ``prior`` is their share, or a function that gives it
    from a model that tells positives from the mixture and that model's scores of ``positive``; by default it comes from the rows given.
    """
    width = len(NAMES)
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, prior if isinstance(prior, float) else 0.5)
    mean = positive.mean(axis=0)
    scale = np.maximum(0.5 * (positive.std(axis=0) + np.vstack([positive, unlabelled]).std(axis=0)), 1e-3)
    blank = QualityModel(mean, scale, np.zeros(width), 0.0, 0.5)
    p = np.c_[blank.inputs(positive), np.ones(len(positive))]
    u = np.c_[blank.inputs(unlabelled), np.ones(len(unlabelled))]
    if not isinstance(prior, float):

        def plain(theta):  # positives against the mixture
            a, b = _sigmoid(p @ theta), _sigmoid(u @ theta)
            return -(p * (1 - a)[:, None]).mean(axis=0) + (u * b[:, None]).mean(axis=0) + decay * theta

        theta = _adam(np.zeros(width + 1), plain, 300, 0.05)
        draft = QualityModel(mean, scale, theta[:-1], float(theta[-1]), 0.5)
        if prior is None:
            cuts = prior_cuts(p @ theta)
            prior = estimate_prior(p @ theta, cuts, (u @ theta >= cuts[:, None]).sum(axis=1), len(u))
        else:
            prior = prior(draft, p @ theta)

    def risk(theta):
        a, b = _sigmoid(p @ theta), _sigmoid(u @ theta)
        positive_part = -prior * (p * (1 - a)[:, None]).mean(axis=0)
        negative_risk = -np.log1p(-np.minimum(b, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(a, 1 - 1e-12)).mean()
        negative_part = (u * b[:, None]).mean(axis=0) - prior * (p * a[:, None]).mean(axis=0)
        if negative_risk < 0:  # it can't be: undo that part instead
            return -negative_part
        return positive_part + negative_part + decay * np.r_[theta[:-1], 0]

    theta = _adam(np.zeros(width + 1), risk, steps, 0.05)
    return QualityModel(mean, scale, theta[:-1], float(theta[-1]), prior)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


def _features(rows: DataFrame) -> np.ndarray:
    got = rows.mapInArrow(collected_batches, "id long, x array<double>").select("x").toArrow()["x"].combine_chunks()
    return got.flatten().to_numpy(zero_copy_only=False).reshape(len(got), len(NAMES))


@lean
def tail_batches(batches: Iterable[pa.RecordBatch], model: QualityModel, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, text) to (at, n): how many rows lie from each cut to the next; -1 for those below all."""
    found = np.zeros(len(cuts) + 1, np.int64)
    for _, x in feature_batches(batches):
        found += np.bincount(np.searchsorted(cuts, model.logits(x), side="right"), minlength=len(found))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(cuts), dtype=np.int32)), pa.array(found)], names=["at", "n"])


def fit_quality(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 15_000) -> QualityModel:
    """Learns from the texts of ``docs``: those whose id is in ``positives`` are trusted, and all together are the unlabelled mixture.

    Weights are fitted on at most about ``most_rows`` trusted rows and as many of the mixture (by the hash of the id); their features, not
    their texts, come to the driver. The class prior is counted over all rows of ``docs``. Null texts count as empty.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    trusted = positives.select(positives[id_col].cast("long").alias("id")).where("id IS NOT NULL").distinct()
    if (n := trusted.count()) > most_rows:
        trusted = trusted.where(unit_hash(F.col("id"), 11) < most_rows / n)
    total = rows.count()
    mixture = rows if total <= most_rows else rows.where(unit_hash(F.col("id"), 13) < most_rows / total)

    def prior(draft: QualityModel, scores: np.ndarray) -> float:
        cuts = prior_cuts(scores)
        found = {r["at"]: r["n"] for r in rows.mapInArrow(lambda b: tail_batches(b, draft, cuts), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
        above = np.cumsum([found.get(k, 0) for k in range(len(cuts) - 1, -1, -1)])[::-1]
        return estimate_prior(scores, cuts, above, total)

    return fit_pu(_features(rows.join(F.broadcast(trusted), "id", "left_semi")), _features(mixture), prior)  # no more trusted rows than the bound


@lean
def score_batches(batches: Iterable[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, score)."""
    for batch, x in feature_batches(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["id", "score"])


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every whole text, higher where quality is likelier, a row per input row.

    Null and empty texts are scored as texts without words. Equal texts have equal scores. Null and
    repeated ids pass through; an empty table gives an empty result; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lambda b: score_batches(b, model), f"id {kind}, score double").withColumnRenamed("id", id_col)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text of documents; labels of held-out rows aren't used."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = ~held_out()
    model = fit_quality(docs.where(learned), labels.where(learned & (F.col("quality") == 1)))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
