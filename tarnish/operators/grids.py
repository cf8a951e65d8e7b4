"""Grid maps as long tables (map_id, y, x, value).

Resampling is separable, one axis at a time: a map row is one array, which a
small matrix of weights turns into its resampled row; rows are then dealt
into tiles of destination rows, with those that a tile reaches over its
edges, and combined there.  Cells are shuffled once, rows about once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def completed(df: DataFrame, size: tuple[int, int]) -> DataFrame:
    """``df`` with a row for each cell of the grid that a map lacks, whose
    other columns are null; cells outside of the grid or without a place go.

    A map's cells are ordered by place and each makes those up to the next
    one, so only given cells are shuffled, once, by map_id.  A null map_id
    is a map of empty cells.
    """
    height, width = size
    inside = F.col("map_id").isNotNull() & F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    order = Window.partitionBy("map_id").orderBy("_at")
    rows = df.withColumn("_at", F.coalesce(F.when(inside, F.col("y") * width + F.col("x")), F.lit(-1)).cast("int"))
    rows = rows.withColumns({"_to": F.greatest("_at", F.lead("_at", 1, height * width).over(order) - 1), "_from": F.when(F.lag("_at").over(order).isNull(), 0).otherwise(F.greatest("_at", F.lit(0)))})
    cells = rows.where("_from <= _to").withColumn("_cell", F.explode(F.sequence("_from", "_to")))
    place = {"y": F.expr(f"_cell div {width}").cast(df.schema["y"].dataType), "x": (F.col("_cell") % width).cast(df.schema["x"].dataType)}
    return cells.select(*[F.col(c) if c == "map_id" else place.get(c, F.when(F.col("_cell") == F.col("_at"), F.col(c))).alias(c) for c in df.columns])


def to_grid(df: DataFrame, width: int, index: str = "idx") -> DataFrame:
    """Row-major places of a flat index."""
    return df.withColumns({"y": F.expr(f"cast({index} div {width} as int)"), "x": F.expr(f"cast({index} % {width} as int)")})


def bilinear_taps(src: int, dst: int) -> list[tuple[int, int, float]]:
    """Half-pixel centres, clamped at the borders."""
    out = []
    for d in range(dst):
        at = max(0.0, (d + 0.5) * src / dst - 0.5)
        a = min(int(at), src - 1)
        b, w = min(a + 1, src - 1), at - int(at)
        out += [(d, a, 1 - w), (d, b, w)]
    return out


def bicubic_taps(src: int, dst: int, a: float = -0.75) -> list[tuple[int, int, float]]:
    def weight(t: float) -> float:
        t = abs(t)
        if t <= 1:
            return (a + 2) * t**3 - (a + 3) * t**2 + 1
        return a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a if t < 2 else 0.0

    out = []
    for d in range(dst):
        at = (d + 0.5) * src / dst - 0.5
        base = math.floor(at)
        out += [(d, min(max(base + k, 0), src - 1), weight(at - base - k)) for k in range(-1, 3)]
    return out


def gaussian_taps(size: int, sigma: float, truncate: float = 4.0) -> list[tuple[int, int, float]]:
    """Kernel of radius int(truncate * sigma + 0.5); borders reflect with the
    edge repeated."""
    r = int(truncate * sigma + 0.5)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    s = sum(kernel)
    out = []
    for d in range(size):
        for k, w in zip(range(-r, r + 1), kernel, strict=True):
            at = (d + k) % (2 * size)
            out.append((d, at if at < size else 2 * size - 1 - at, w / s))
    return out


#: Destination rows of a tile.
TILE = 64


def _weights(taps: list[tuple[int, int, float]]):
    """The taps of an axis as a matrix (destination, source)."""
    import numpy as np

    out = np.zeros((max(d for d, _, _ in taps) + 1, max(s for _, s, _ in taps) + 1))
    for d, s, w in taps:
        out[d, s] += w
    return out


def _taps(spark: SparkSession, rows: list[tuple[int, int, float]], axis: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, f"_d int, {axis} int, _w double"))  # taps of one axis


def separable(df: DataFrame, taps_y: list, taps_x: list, value: str = "value") -> DataFrame:
    """Maps resampled by the taps of both axes.

    Cells that a map lacks, or that are null, count as zero; those outside
    of the taps' sources are left out, and so are destination rows that no
    row of the map reaches.
    """
    rows_, columns, tile = _weights(taps_y), _weights(taps_x), TILE
    kind = df.schema["map_id"].dataType.simpleString()
    reached = {y: sorted({d // tile for d, s, _ in taps_y if s == y}) for y in range(rows_.shape[1])}

    def along(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, width = batch.num_rows, columns.shape[1]
            cells = batch.column("_cells")
            flat, sizes = cells.flatten(), np.diff(np.asarray(cells.offsets))
            x, v = np.asarray(flat.field("x")), np.asarray(flat.field("_v"))
            at, inside = np.repeat(np.arange(n), sizes), (x >= 0) & (x < width)
            dense = np.zeros((n, width))
            np.add.at(dense, (at[inside], x[inside]), v[inside])
            out = dense @ columns.T
            tiles = [reached.get(y, []) for y in batch.column("y").to_pylist()]
            source = pa.array(np.repeat(np.arange(n), [len(t) for t in tiles]))
            made = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("map_id").take(source), pa.array([t for ts in tiles for t in ts], pa.int32()), batch.column("y").take(source), made.take(source)], names=["map_id", "_tile", "y", "_row"])

    def across(table):
        import numpy as np
        import pyarrow as pa

        y, row = np.asarray(table.column("y")), table.column("_row").combine_chunks()
        first = table.column("_tile")[0].as_py() * tile
        weights = rows_[first : first + tile][:, y]
        given = np.flatnonzero((rows_[first : first + tile][:, y] != 0).any(1))
        out = weights[given] @ np.asarray(row.flatten()).reshape(len(y), -1)
        n = out.size
        ids = table.column("map_id").combine_chunks().take(pa.array(np.zeros(n, dtype=np.int64)))
        return pa.table({"map_id": ids, "y": pa.array(np.repeat(given + first, out.shape[1]), pa.int32()), "x": pa.array(np.tile(np.arange(out.shape[1]), len(given)), pa.int32()), value: out.ravel()})

    cells = df.where(F.col(value).isNotNull()).groupBy("map_id", F.col("y").cast("int").alias("y")).agg(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias("_v"))).alias("_cells"))  # a map row
    tiles = cells.mapInArrow(along, f"map_id {kind}, _tile int, y int, _row array<double>")
    return tiles.groupBy("map_id", "_tile").applyInArrow(across, f"map_id {kind}, y int, x int, `{value}` double")


def resize_bilinear(df: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    return separable(df, bilinear_taps(size[0], to[0]), bilinear_taps(size[1], to[1]))


def resize_bicubic(df: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    return separable(df, bicubic_taps(size[0], to[0]), bicubic_taps(size[1], to[1]))


def smooth_gaussian(df: DataFrame, size: tuple[int, int], sigma: float = 4.0) -> DataFrame:
    return separable(df, gaussian_taps(size[0], sigma), gaussian_taps(size[1], sigma))


def resize_nearest(df: DataFrame, size: tuple[int, int], to: tuple[int, int], value: str = "value") -> DataFrame:
    spark = df.sparkSession
    pick = lambda s, d: [(k, k * s // d, 1.0) for k in range(d)]
    rows = df.join(_taps(spark, pick(size[1], to[1]), "x").withColumnRenamed("_d", "x2").drop("_w"), "x").join(_taps(spark, pick(size[0], to[0]), "y").drop("_w"), "y")
    return rows.select("map_id", F.col("_d").alias("y"), F.col("x2").alias("x"), value)


def crop_center(df: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    top, left = (round((s - t) / 2) for s, t in zip(size, to, strict=True))
    inside = F.col("y").between(top, top + to[0] - 1) & F.col("x").between(left, left + to[1] - 1)
    return df.where(inside).withColumns({"y": F.col("y") - top, "x": F.col("x") - left})


def pad_square(df: DataFrame, size: tuple[int, int], fill: float = 0.0, value: str = "value") -> DataFrame:
    """Centred in a square of the longer side."""
    side = max(size)
    top, left = ((side - s) // 2 for s in size)
    moved = df.withColumns({"y": F.col("y") + top, "x": F.col("x") + left})
    return completed(moved, (side, side)).withColumn(value, F.coalesce(value, F.lit(fill)))


def patchify(df: DataFrame, p: int, value: str = "value") -> DataFrame:
    """p x p tiles, each as an array in row-major order."""
    tile = df.groupBy("map_id", F.expr(f"cast(y div {p} as int)").alias("ty"), F.expr(f"cast(x div {p} as int)").alias("tx"))
    return tile.agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", value))), lambda s: s[value]).alias("patch"))


def block_average(df: DataFrame, p: int, size: tuple[int, int], value: str = "value") -> DataFrame:
    """Mean of p x p blocks; partial blocks at the edges go."""
    whole = df.where((F.col("y") < size[0] // p * p) & (F.col("x") < size[1] // p * p))
    return whole.groupBy("map_id", F.expr(f"cast(y div {p} as int)").alias("y"), F.expr(f"cast(x div {p} as int)").alias("x")).agg(F.avg(value).alias(value))


def overlay(image: DataFrame, heat: DataFrame | Column, mask: DataFrame | Column, alpha: float = 0.5, beta: float = 0.5, paint: float = 255.0) -> DataFrame:
    """alpha * heat + beta * image, cells whose mask is over 0.5 painted.

    heat (value) and mask (mask) are tables of cells, or columns of
    ``image``, which need no join.  Tables are joined by sorted partitions:
    cells made of few rows would be taken for a small table and broadcast.
    """
    keys = ["map_id", "y", "x"]
    own = [c.alias(name) for name, c in (("heat", heat), ("mask", mask)) if isinstance(c, Column)]
    rows = image.select(*keys, F.col("value").alias("image"), *own)
    if isinstance(heat, DataFrame):
        rows = rows.join(heat.select(*keys, F.col("value").alias("heat")).hint("merge"), keys)
    if isinstance(mask, DataFrame):
        rows = rows.join(mask.select(*keys, "mask").hint("merge"), keys, "left")
    return rows.select(*keys, F.when(F.col("mask") > 0.5, F.lit(paint)).otherwise(alpha * F.col("heat") + beta * F.col("image")).alias("value"))


def threshold(df: DataFrame, least: float, value: str = "value") -> DataFrame:
    """Cells strictly above ``least``."""
    return df.where(F.col(value) > least)
