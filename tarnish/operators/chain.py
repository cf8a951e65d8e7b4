"""From feature vectors to metrics: every run (dataset, class, shots) of a
few-shot evaluation in one job.

Patches are scored against their run's gallery and texts, fused, laid out as
maps, enlarged and smoothed, and held against masks and labels.  A map is
known by its run and map_id together, so one image may be in many runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import harmonic, l2_normalize
from .blocks import nearest
from .grids import bilinear_taps, gaussian_taps, separable, to_grid
from .metrics import evaluate, max_pool
from .vectors import prototype_score


def visual_scores(patches: DataFrame, gallery: DataFrame, runs: list[str], layers: list[str]) -> DataFrame:
    """(runs, map_id, idx, score): mean over ``layers`` of the distance to
    the nearest row of the run's gallery.

    patches: (runs, map_id, idx, layers); gallery: (runs, layers).  A patch
    that lacks a layer's vector, or whose run has no gallery, has no score;
    runs with a null key meet nothing.
    """
    own = patches.select(*runs, F.struct("map_id", "idx").alias("_patch"), *layers)
    shots = gallery.select(*runs, F.lit(0).alias("_shot"), *layers)
    found = reduce(DataFrame.unionAll, [nearest(own, shots, "_patch", "_shot", keys=runs, va=v, vb=v) for v in layers])
    means = found.groupBy(*runs, "_patch").agg(F.avg("distance").alias("score"), F.count("*").alias("_n"))
    return means.where(F.col("_n") == len(layers)).select(*runs, "_patch.*", "score")


def textual_scores(rows: DataFrame, texts: DataFrame, runs: list[str], vec: str, t: float = 100.0) -> DataFrame:
    """``rows`` with ``score``, the share of the abnormal text in a softmax
    over both texts of the run.  texts: (runs, normal, abnormal), one row a
    run; rows of other runs go."""
    prototypes = F.array(l2_normalize(F.col("normal")), l2_normalize(F.col("abnormal")))
    both = texts.select(*runs, prototypes.alias("_texts"))
    scored = rows.join(both, runs).withColumn("score", F.get(prototype_score(l2_normalize(F.col(vec)), F.col("_texts"), t), F.lit(1)))
    return scored.drop("_texts")


def anomaly_maps(scores: DataFrame, runs: list[str], grid: tuple[int, int], to: tuple[int, int], sigma: float | None = None) -> DataFrame:
    """(runs, map_id, y, x, value): patch scores (runs, map_id, idx, score)
    of a grid, enlarged to ``to`` and smoothed if ``sigma`` is given.
    Patches without a score count as zero."""
    cells = to_grid(scores, grid[1]).select(F.struct(*runs, "map_id").alias("map_id"), "y", "x", F.col("score").alias("value"))
    maps = separable(cells, bilinear_taps(grid[0], to[0]), bilinear_taps(grid[1], to[1]))
    if sigma is not None:
        maps = separable(maps, gaussian_taps(to[0], sigma), gaussian_taps(to[1], sigma))
    return maps.select("map_id.*", "y", "x", "value")


def evaluate_runs(patches: DataFrame, images: DataFrame, gallery: DataFrame, texts: DataFrame, masks: DataFrame, *, runs: list[str], layers: list[str], vec: str, grid: tuple[int, int], to: tuple[int, int], sigma: float = 4.0, t: float = 100.0, digits: int = 9) -> DataFrame:
    """A row for each run: ``i_roc`` and ``p_roc`` (percent).

    patches: (runs, map_id, idx, layers, vec); images: (runs, map_id, vec,
    label), one row a map; gallery, texts: as above; masks: (map_id, y, x),
    the anomalous cells at size ``to``.  Image scores fuse the largest value
    of the enlarged visual map with the image's textual score; cell scores
    fuse both scores of each patch before maps are enlarged and smoothed.
    Scores that agree to ``digits`` digits are ties.  A run whose images, or
    cells, are of one kind only has null there.
    """
    visual = visual_scores(patches, gallery, runs, layers)
    at = [*runs, "map_id"]
    peaks = max_pool(anomaly_maps(visual, runs, grid, to), at, "value")
    said = textual_scores(images.select(*at, vec, "label"), texts, runs, vec, t).withColumnRenamed("score", "_said")
    whole = said.join(peaks, at).select(*runs, F.round(harmonic(F.col("score"), F.col("_said")), digits).alias("score"), "label")
    said = textual_scores(patches.select(*at, "idx", vec), texts, runs, vec, t).withColumnRenamed("score", "_said")
    fused = visual.join(said, [*at, "idx"]).select(*at, "idx", harmonic(F.col("score"), F.col("_said")).alias("score"))
    marked = masks.select("map_id", "y", "x").distinct().withColumn("label", F.lit(1))
    cells = anomaly_maps(fused, runs, grid, to, sigma).join(marked, ["map_id", "y", "x"], "left")
    cells = cells.select(*runs, F.round("value", digits).alias("score"), F.coalesce("label", F.lit(0)).alias("label"))
    image, cell = (evaluate(rows, runs).select(*runs, F.col("auc").alias(name)) for rows, name in ((whole, "i_roc"), (cells, "p_roc")))
    return image.join(cell, runs, "full")
