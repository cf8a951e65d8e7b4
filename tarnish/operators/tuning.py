"""Tuning of prototype vectors by gradient descent on frozen features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles


def lr_schedule(spark: SparkSession, kind: str, n: int, start: float = 0.002, end: float = 1e-5, gamma: float = 0.95) -> DataFrame:
    """(epoch, rate): cosine from start to end, or exponential."""
    e = spark.range(n).select(F.col("id").cast("int").alias("epoch"))
    rate = end + (start - end) * (1 + F.cos(np.pi * F.col("epoch") / n)) / 2 if kind == "cosine" else start * F.pow(F.lit(gamma), F.col("epoch"))
    return e.withColumn("rate", rate)


def tune_prototypes(features: DataFrame, prototypes: np.ndarray, *, vec: str = "vec", label: str = "label", epochs: int = 20, t: float = 10.0, start: float = 0.002, end: float = 1e-5, momentum: float = 0.9, decay: float = 5e-4) -> tuple[np.ndarray, list[float]]:
    """Prototypes (a row a label) after descent on the softmax loss, and the
    loss of each epoch.  An epoch is one pass of tasks that return a partial
    gradient each, summed by Spark; the driver holds the prototypes only."""
    rows = features.select(doubles(F.col(vec)).alias("v"), F.col(label).cast("int").alias("y")).persist()
    p, velocity, losses = prototypes.astype(float).copy(), np.zeros_like(prototypes, dtype=float), []
    try:
        for epoch in range(epochs):
            current = p.copy()

            def partial(batches, current=current):
                grad, loss, n = np.zeros_like(current), 0.0, 0
                for b in batches:
                    if len(b):
                        v, y = np.stack(b["v"]), b["y"].to_numpy()
                        z = t * v @ current.T
                        z -= z.max(1, keepdims=True)
                        q = np.exp(z)
                        q /= q.sum(1, keepdims=True)
                        loss -= np.log(q[np.arange(len(y)), y]).sum()
                        q[np.arange(len(y)), y] -= 1
                        grad += t * q.T @ v
                        n += len(y)
                yield pd.DataFrame({"i": range(grad.size + 2), "x": [*grad.ravel(), loss, float(n)]})

            total = {r["i"]: r["x"] for r in rows.mapInPandas(partial, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
            n = total[p.size + 1] or 1.0
            losses.append(total[p.size] / n)
            grad = np.array([total[i] for i in range(p.size)]).reshape(p.shape) / n + decay * p
            velocity = momentum * velocity + grad
            p -= (end + (start - end) * (1 + np.cos(np.pi * epoch / epochs)) / 2) * velocity
    finally:
        rows.unpersist()
    return p, losses
