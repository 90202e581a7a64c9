"""Document quality by a regularised quadratic discriminant.

Each text gives a vector of transformed statistics (logs of lengths, log odds of shares). Each class of labelled texts
has a mean and a covariance, shrunk towards the pooled covariance and towards a multiple of the identity. The score is
the logistic of the difference of the two Gaussian log densities and the log of the class shares; Mahalanobis distances
come from Cholesky factors that are made once and cached with the model.

Counts, sums and sums of products are all that a fit needs, so it takes all labelled rows, wherever they are, and the
driver gets one row for each class.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stored, with_columns

SYMBOLS = "#*$%&|<>"
_COMPRESS = zstandard.ZstdCompressor(level=1)
_ASCII = {"upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "mark": b".,;:", "loud": b"!?", "symbol": SYMBOLS.encode()}
NAMES = ("words", "word_length", "upper", "digit", "mark", "loud", "symbol", "bar_words", "distinct", "top_word", "pair_repeats", "line_words", "line_repeats", "squeeze", "marked_words")


def _odds(part: float, whole: float) -> float:
    """Log odds of a share, with half a case added on each side."""
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of ``NAMES``. Those of an empty text are finite too."""
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, size = len(words), len(raw)
    count = {k: size - len(raw.translate(None, v)) for k, v in _ASCII.items()}
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(n),
        math.log1p((size - n) / n if n else 0),
        _odds(count["upper"], size),
        _odds(count["digit"], size),
        _odds(count["mark"], size),
        _odds(count["loud"], size),
        _odds(count["symbol"], size),
        _odds(seen[b"|"], n),
        _odds(len(seen), n),
        _odds(max(seen.values(), default=0), n),
        _odds(max(n - 1, 0) - pairs, n),
        math.log1p(n / max(len(lines), 1)),
        _odds(len(lines) - len(set(lines)), len(lines)),
        math.log((len(_COMPRESS.compress(raw)) + 16) / (size + 16)),
        _odds(sum(1 for w in seen if not w.isalpha() and len(w) > 1), len(seen)),
    ]


def with_statistics(df: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``statistics``, an array of doubles. A null text counts as empty; rows may repeat, an empty table stays empty, and a
    column named statistics gives way."""
    return with_columns(df, [text], "statistics array<double>", lambda t: {"statistics": [statistics(x or "") for x in t.to_pylist()]}, drop)


@dataclass
class Discriminant:
    """Log prior odds, means and covariances, class 0 first."""

    prior: float
    means: np.ndarray
    covariances: np.ndarray

    @cached_property
    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Inverse Cholesky factors, and half the log determinants."""
        chol = np.linalg.cholesky(self.covariances)
        return np.linalg.inv(chol), np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        inverse, half_log = self.factors
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - h for m, f, h in zip(self.means, inverse, half_log, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -50, 50)))


def fit(statistics: DataFrame, label: str = "label", to_pooled: float = 0.1, to_identity: float = 0.02) -> Discriminant:
    """From rows with ``statistics`` and a label of 0 or 1; rows with a null or another label take no part.

    ``to_pooled`` and ``to_identity`` are the two shrinkage weights. With one class only, or no row, every score is that
    of the prior with half a row added to each class.
    """
    d, at = len(NAMES), F.col("statistics")
    moments = statistics.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), at)

    def sums(batches):
        total = {k: [0, np.zeros(d), np.zeros((d, d))] for k in (0, 1)}
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k, t in total.items():
                own = x[y == k]
                t[0] += len(own)
                t[1] += own.sum(axis=0)
                t[2] += own.T @ own
        rows = [(k, n, i, v) for k, (n, s, p) in total.items() if n for i, v in enumerate(np.r_[s, p.ravel()].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int32(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["label", "n", "place", "value"])

    parts = moments.mapInArrow(sums, "label int, n long, place int, value double")
    got = parts.groupBy("label", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect()  # 2 * (d + d * d) rows
    n, flat = np.zeros(2), np.zeros((2, d + d * d))
    for r in got:
        n[r.label], flat[r.label, r.place] = r.n, r.value
    mean = flat[:, :d] / np.maximum(n, 1)[:, None]
    scatter = flat[:, d:].reshape(2, d, d) - np.maximum(n, 1)[:, None, None] * mean[:, :, None] * mean[:, None, :]
    own, pooled = scatter / np.maximum(n, 1)[:, None, None], scatter.sum(axis=0) / max(n.sum(), 1)
    prior = math.log((n[1] + 0.5) / (n[0] + 0.5))
    if n.min() == 0:
        return Discriminant(prior, np.zeros((2, d)), np.stack([np.eye(d)] * 2))
    cov = (1 - to_pooled) * own + to_pooled * pooled
    cov = (1 - to_identity) * cov + to_identity * np.eye(d) * np.trace(pooled) / d + 1e-6 * np.eye(d)
    return Discriminant(prior, mean, cov)


def score(df: DataFrame, model: Discriminant, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``score``, 0 to 1, to rows with ``statistics``. Equal rows score alike, an empty table stays empty, and a column
    named score gives way."""
    model.factors  # noqa: B018  made here, once, and sent with the model

    def make(x: pa.Array) -> dict:
        return {"score": pa.array(model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))))}

    return with_columns(df, ["statistics"], "score double", make, drop)


def score_texts(df: DataFrame, model: Discriminant, text: str = "text", score: str = "score") -> DataFrame:
    """Adds ``score`` to rows with a text, in one step. Null texts count as empty; rows may repeat, an empty table stays
    empty, and a column of that name gives way."""
    model.factors  # noqa: B018

    def make(t: pa.Array) -> dict:
        x = np.array([statistics(v or "") for v in t.to_pylist()]).reshape(-1, len(NAMES))
        return {score: pa.array(model.score(x))}

    return with_columns(df, [text], f"`{score}` double", make)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is kept from the fit: crc32 of its id as text leaves 2 when divided by 4. A null id is not."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 4 == 2, F.lit(False))


def _learnt(known: DataFrame, labels: DataFrame) -> Discriminant:
    learn = labels.select(F.col("doc_id"), F.col("quality").alias("label")).filter(~held_out())
    return fit(known.join(learn, "doc_id").select("statistics", "label"))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) of each row of ``docs``, learnt from ``labels``
    (doc_id, quality) of the documents that are not held out.

    Texts are read once: their statistics are kept in a table. Null texts count as empty, rows may repeat, and labels
    without a document, or with a null label, take no part. A document with several labels counts with each.
    """
    known = stored(with_statistics(docs.select("doc_id", F.col(f"`{text}`").alias("text")), drop=("text",)), "statistics")
    scored = score(known, _learnt(known, labels), drop=("statistics",))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, as they are, with all columns, whatever their names. Null and
    empty texts are scored like others; rows may repeat; an empty table stays empty.

    One pass fits the model; a second scores and filters each row where it is read, so texts are never shuffled.
    """
    known = stored(with_statistics(docs.select("doc_id", F.col(f"`{text}`").alias("text")), drop=("text",)), "statistics")
    model = _learnt(known, labels)
    return score_texts(docs, model, text, "__quality").filter(F.col("__quality") >= threshold).drop("__quality")
