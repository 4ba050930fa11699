"""Bounded training samples for the learned scorers, and small fitting helpers in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder

LETTERS = r"[^\W\d_]"


def sampled(rows: DataFrame, key: str, bound: int, salt: int = 0) -> DataFrame:
    """The rows whose hashed key falls below a threshold, set so that about `bound` rows are kept; all if there are fewer."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * bound / n))


def labelled(docs: DataFrame, labels: DataFrame, target: str, modulus: int, rest: int, bound: int) -> DataFrame:
    """doc_id, text, y and part (0 or 1: two thirds to learn from, one third to calibrate on) of a bounded sample.

    Rows whose remainder is `rest` are never used. Of several labels of one document the largest counts; null labels and
    null ids are skipped. The sample's ids are at most about `bound` rows, whatever the input, so they are broadcast. Where ids
    repeat, rows alike in id and text count once, and the rows are thinned by id and text if there are over twice as many as `bound`.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != F.lit(rest)))
    known = known.groupBy(F.col("doc_id")).agg(F.max(F.col(target)).cast("int").alias("y"))
    ids = sampled(known, "doc_id", bound)
    part = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(3)) == 0).cast("int").alias("part")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    n = rows.count()
    if n > ids.count():
        share = 1.0 if n <= 2 * bound else bound / n
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * share)).dropDuplicates(["doc_id", "text"])
    return rows.select("doc_id", "text", "y", part)


def held(modulus: int, rest: int) -> Column:
    return (remainder("doc_id", modulus) == F.lit(rest)).alias("held_out")


def scored(docs: DataFrame, modulus: int, rest: int, score: Callable[[list[str]], np.ndarray], threshold: float, more: str = "") -> DataFrame:
    """doc_id, held_out, score, predicted; score gets whole texts (null: empty) and returns a number from 0 to 1 for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            p = np.clip(np.nan_to_num(np.asarray(score(texts), dtype=np.float64), nan=0.5), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", held(modulus, rest), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge-penalised logistic regression by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, x.shape[1] + 1))
    w = np.zeros(z.shape[1])
    if len(z) == 0:
        return w
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ (p - y) / len(z) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        norm = np.linalg.norm(step)
        w = w - step * min(1.0, 5.0 / max(norm, 1e-12))
        if norm < 1e-8:
            break
    return w


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -35, 35)))
