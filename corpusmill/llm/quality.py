"""Quality classifier: a regularised quadratic discriminant over document statistics (operator 3).

Sixteen transformed statistics of a text; for each class their mean and a covariance shrunk towards its diagonal and
towards the mean variance; the score is the posterior of class 1 from the difference of the two Gaussian log densities,
whose Mahalanobis distances come from Cholesky factors computed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ready_workers
from .aside import set_aside
from .bpe import by_bytes

THRESHOLD = 0.7
SHRINK_DIAGONAL, SHRINK_SPHERE = 0.1, 0.02
#: Divides the log-density difference, as the statistics aren't really normal.
TEMPER = 4.0
#: Classes of bytes.
CLASSES = {1: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2: b"abcdefghijklmnopqrstuvwxyz", 3: b"0123456789", 4: b" \t\r\x0b\x0c", 5: b"\n", 6: b".,;:'\"()-?", 7: b"!", 8: b"|", 9: b"#$%&*+/<=>@[\\]^_`{}~"}
_TABLE = np.zeros(256, np.uint8)
for _k, _bytes in CLASSES.items():
    _TABLE[list(_bytes)] = _k
_TABLE[128:] = 10
TABLE = _TABLE.tobytes()
D = 16


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics; null counts as empty."""
    text = text or b""
    n = max(1, len(text))
    c = np.bincount(np.frombuffer(text.translate(TABLE), np.uint8), minlength=11).tolist()
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(words))
    again = sum(map(eq, words, words[1:]))
    ratios = [c[1] / max(1, c[1] + c[2]), c[3] / n, c[4] / n, c[5] / n, c[6] / n, c[7] / n, c[8] / n, c[9] / n, c[0] / n, c[10] / n, again / m, 1 - len(set(lines)) / max(1, len(lines))]
    return [*map(math.sqrt, ratios), math.log1p(len(text)), math.log1p(sum(map(len, words)) / m), math.log1p(len(words) / max(1, len(lines))), math.log1p(max(map(len, words), default=0))]


@dataclass(frozen=True)
class Model:
    """Per class: log prior, mean, inverse of the Cholesky factor, log determinant."""

    prior: tuple[float, float]
    mean: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for each row."""
        logs = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.whiten[k].T
            logs.append(-0.5 * ((z * z).sum(axis=1) + self.logdet[k]))
        diff = (logs[1] - logs[0]) / TEMPER + self.prior[1] - self.prior[0]
        return 1 / (1 + np.exp(-np.clip(diff, -700, 700)))


def shrunk(moment: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Covariance from the second moment: mixed with its diagonal and with the mean variance."""
    cov = moment - np.outer(mean, mean)
    cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(cov))
    return (1 - SHRINK_SPHERE) * cov + SHRINK_SPHERE * (np.trace(cov) / D + 1e-6) * np.eye(D)


def in_training():
    """The contract's fold: rows whose crc32 of the decimal id has another remainder than 2 by 4."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """From all labelled rows of the training fold; None unless both classes occur.

    Labels other than 0 and 1, and null ids, teach nothing; a label row counts once for each document row with its id.
    Only class counts, sums and products (at most 2 x 153 numbers) come to the driver.
    """
    ready_workers(docs.sparkSession)
    src = docs.where(in_training()).select(F.col("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                rows = [statistics(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "x": pa.array(rows, pa.list_(pa.float64()))})

    kind = src.schema["doc_id"].dataType.simpleString()
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = src.mapInArrow(run, f"doc_id {kind}, x array<double>").join(known, "doc_id")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros(1 + D + D * D), 1: np.zeros(1 + D + D * D)}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            y = batch.column("quality").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        for k in (0, 1):
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "v": pa.array([total[k]], pa.list_(pa.float64()))})

    sums = rows.select("x", "quality").mapInArrow(moments, "k int, v array<double>").select("k", F.posexplode("v").alias("at", "v")).groupBy("k", "at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + D + D * D))
    for r in sums:
        total[r.k, r.at] = r.v
    n = total[:, 0]
    if not n.all():
        return None
    mean = total[:, 1 : D + 1] / n[:, None]
    factors = [np.linalg.cholesky(shrunk(total[k, D + 1 :].reshape(D, D) / n[k], mean[k])) for k in (0, 1)]
    return Model(tuple(np.log(n / n.sum())), mean, np.stack([np.linalg.inv(f) for f in factors]), np.array([2 * np.log(np.diag(f)).sum() for f in factors]))


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns of every row, score and predicted. Without a model nothing is rejected: the score is 1. A null text
    counts as empty; null ids, repeats and ties are rows like others; kept columns mustn't be called score or predicted.
    """
    ready_workers(docs.sparkSession)
    fields = [docs.schema[c] for c in dict.fromkeys((*keep, "text"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                rows = np.array([statistics(t) for t in part.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, D)
                s = model.score(rows) if model else np.ones(len(rows))
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    out = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*(f.name for f in fields)).mapInArrow(run, f"{out}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: every document's score by the model of the training fold."""
    return score(docs, fit(docs, labels)).select("doc_id", (~in_training()).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, unchanged.

    Null and empty texts are scored as texts of length 0, long ones whole; repeated rows and ids get their own decisions; an
    empty table gives none; without labels of both classes all stay. Other columns stay, whatever they are called.
    """
    plain, back = set_aside(docs)
    return score(plain, fit(plain, labels), keep=tuple(plain.columns)).where("predicted = 1").select(back)
