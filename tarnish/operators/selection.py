"""Choosing the few normal samples, run planning, and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def seeded_order(id_col: str, seed: int):
    """A pseudo-random sort key that any engine with md5 reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def sample_shots(df: DataFrame, k: int, seed: int, by: str, id_col: str) -> DataFrame:
    """``k`` seeded rows of each class."""
    w = Window.partitionBy(by).orderBy(seeded_order(id_col, seed), id_col)
    return df.withColumn("shot", F.row_number().over(w)).where(F.col("shot") <= k)


def select_shots(df: DataFrame, shots: DataFrame, by: str, order_col: str) -> DataFrame:
    """Rows whose 0-based place in their class is listed in ``shots``
    (class, ord, idx), with the place in the list.

    The largest place that is listed is read first: a limit on the row
    number, by which each task keeps only so many rows of a class before
    they are shuffled.
    """
    most = shots.agg(F.max("idx").cast("long").alias("idx")).first()["idx"]
    w = Window.partitionBy(by).orderBy(order_col)
    placed = df.withColumn("idx", F.row_number().over(w)).where(F.col("idx") <= (-1 if most is None else most) + 1)
    return placed.withColumn("idx", F.col("idx") - 1).join(shots, [by, "idx"])


def run_grid(spark: SparkSession, classes: dict[str, list[str]], shots: list[int]) -> DataFrame:
    """A row for each (dataset, class, shot): one job instead of one process each."""
    rows = spark.createDataFrame([(d, c) for d, c in classes.items()], "dataset string, classes array<string>")
    sizes = F.array(*[F.lit(s) for s in shots])
    return rows.select("dataset", F.explode("classes").alias("class")).withColumn("shot", F.explode(sizes))


def best_epoch(df: DataFrame, keys: list[str], metric: str = "value", epoch: str = "epoch") -> DataFrame:
    """The earliest epoch of the highest metric for each run."""
    w = Window.partitionBy(*keys).orderBy(F.desc(metric), F.asc(epoch))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def assign_batches(df: DataFrame, size: int, seed: int, by: list[str], id_col: str) -> DataFrame:
    """Batch numbers in seeded order within each group; the last is partial.

    The seeded key is a digest, so its first three digits cut a group into
    4,096 even blocks that follow each other in its order; rows are numbered
    within blocks, from the sum of those before.
    """
    key = seeded_order(id_col, seed)
    rows = df.withColumn("_block", F.struct(*by, F.substring(key, 1, 3).alias("_digits")))
    before = Window.partitionBy(*[f"_block.{c}" for c in by]).orderBy("_block._digits").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_block").count().select("_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_block").orderBy(key, id_col)
    place = F.col("_start") + F.row_number().over(inside) - 1
    return rows.join(starts, "_block").withColumn("batch", F.floor(place / size).cast("long")).drop("_block", "_start")
