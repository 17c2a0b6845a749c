"""Linear models fitted on a bounded sample of labelled rows: sampling, dual coordinate descent, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folds by crc32 of the id as text; this one is never learned from.
FOLDS = 5
HELD_OUT = 0


def held_out(id_col: str = "doc_id"):
    """Whether a row is in the fold that no label is learned from; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def labelled_sample(labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id") -> tuple[dict[int, int], float]:
    """(id -> label of at most ``per_class`` rows of each class, share of class 1 among all training rows).

    The rows are those of the smallest hashes of their ids, so the choice is the same in every run.
    Null ids and labels are left out; of several labels of an id the largest counts.
    """
    rows = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where("doc_id IS NOT NULL AND y IN (0, 1)")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    count = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen: dict[int, int] = {}
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen |= {r["doc_id"]: y for r in part.select("doc_id").collect()}
    total = sum(count.values())
    return chosen, (count.get(1, 0) / total if total else 0.5)


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 15, seed: int = 7) -> np.ndarray:
    """Weights of the linear SVM with hinge loss, by dual coordinate descent over sparse rows.

    ``rows``: (feature numbers, values); ``y``: -1 or 1; ``cost``: the upper bound of each row's dual
    variable. The last weight (at ``size``) is the bias, of a feature that is 1 in every row.
    """
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    norm = [float(v @ v) + 1.0 for _, v in rows]
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        most = 0.0
        for i in order.tolist():
            at, values = rows[i]
            gradient = y[i] * (w[at] @ values + w[size]) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                most = max(most, abs(step))
                alpha[i] = new
                w[at] += step * values
                w[size] += step
        if most < 1e-4:
            break
    return w


def platt(margins: np.ndarray, y01: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) estimates P(y = 1), by Newton steps."""
    a, b = 1.0, 0.0
    if len(margins) == 0:
        return a, b
    n1, n0 = float(weight[y01 == 1].sum()), float(weight[y01 == 0].sum())
    target = np.where(y01 == 1, 1 - 1e-3 - 1 / (len(margins) + 2), 1e-3 + 1 / (len(margins) + 2))
    b = float(np.log((n1 + 1e-9) / (n0 + 1e-9))) if n1 and n0 else 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        ga, gb = float(g @ margins) + 1e-4 * a, float(g.sum())
        haa, hab, hbb = float(h @ (margins * margins)) + 1e-4, float(h @ margins), float(h.sum())
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    return (a, b) if np.isfinite(a + b) and a > 0 else (1.0, 0.0)
