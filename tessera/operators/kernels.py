"""The engine's statistics by expressions over rows and by numpy over blocks, to hold one against the other."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.operators import kmeans, logreg


def row_stats(points: DataFrame, features: Sequence[str], label: str, centres: np.ndarray, model: np.ndarray) -> dict[str, np.ndarray]:
    a = kmeans.global_stats(points, features, centres)
    b = logreg.point_stats(points, features, label, model[:-1], model[-1]).first()
    return {
        "kmeans_counts": np.asarray(a.counts, float), "kmeans_sums": np.asarray(a.sums, float).ravel(), "kmeans_wcss": np.array([a.wcss]), "logreg_loss": np.array([b["loss"]]),
        "logreg_gradient": np.array([b[f"g{i}"] for i in range(len(features) + 1)]),
    }


def block_stats(points: DataFrame, features: Sequence[str], label: str, centres: np.ndarray, model: np.ndarray) -> dict[str, np.ndarray]:
    """The same by blocks: a task sends one row of sums, whatever its rows."""
    k, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, wcss, loss, grad = np.zeros(k), np.zeros((k, d)), 0.0, 0.0, np.zeros(d + 1)
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[:d]], 1)
            y = b.column(d).to_numpy(zero_copy_only=False).astype(float)
            far = ((x[:, None] - centres[None]) ** 2).sum(2)
            own = far.argmin(1)
            counts += np.bincount(own, minlength=k)
            np.add.at(sums, own, x)
            wcss += far[np.arange(len(own)), own].sum()
            z = x @ model[:-1] + model[-1]
            loss += (np.logaddexp(0, z) - y * z).sum()
            res = 1 / (1 + np.exp(-z)) - y
            grad += np.append(x.T @ res, res.sum())
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([counts, sums.ravel(), [wcss, loss], grad]).tolist()])], names=["v"])

    total = np.zeros(k + k * d + 2 + d + 1)
    # A row of a few dozen numbers for each task.
    for r in points.select(*features, label).mapInArrow(run, "v array<double>").collect():
        total += np.array(r["v"])
    at = np.cumsum([k, k * d, 1, 1])
    return dict(zip(("kmeans_counts", "kmeans_sums", "kmeans_wcss", "logreg_loss", "logreg_gradient"), np.split(total, at), strict=True))
