"""Connected regions (8 neighbours) of foreground cells (map_id, y, x).

Rows are first compressed to runs; runs of adjacent rows that touch are
edges, and labels settle by neighbour minima with pointer jumping, so the
number of rounds grows with the logarithm of the number of runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(cells: DataFrame) -> DataFrame:
    """(map_id, y, x0, x1, run): maximal horizontal runs; run is the smallest
    place, y * 2**31 + x0."""
    w = Window.partitionBy("map_id", "y").orderBy("x")
    island = cells.select("map_id", "y", "x").distinct().withColumn("g", F.col("x") - F.row_number().over(w))
    r = island.groupBy("map_id", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")
    return r.withColumn("run", F.col("y").cast("long") * 2**31 + F.col("x0"))


def label_runs(cells: DataFrame, rounds: int = 64) -> DataFrame:
    """Runs with ``region``: the smallest run of their connected region."""
    return settled(_cut(runs(cells)), 1, rounds)


def settled(r: DataFrame, reach: int, rounds: int = 64) -> DataFrame:
    """Runs (map_id, y, x0, x1, run) with ``region``, the smallest run that
    they are connected with.  Runs of adjacent rows touch if their columns
    overlap (``reach`` 0), or lie side by side as well (1)."""
    a = r.select("map_id", F.col("y").alias("ya"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("run").alias("a"))
    b = r.select("map_id", (F.col("y") - 1).alias("ya"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("run").alias("b"))
    touch = a.join(b, ["map_id", "ya"]).where((F.col("b0") <= F.col("a1") + reach) & (F.col("b1") >= F.col("a0") - reach)).select("map_id", "a", "b")
    edges = _cut(touch.unionAll(touch.select("map_id", "b", "a")))
    labels = r.select("map_id", "run", F.col("run").alias("region"))
    for _ in range(rounds):
        near = edges.join(labels.select("map_id", F.col("run").alias("b"), F.col("region").alias("lb")), ["map_id", "b"]).join(labels.select("map_id", F.col("run").alias("a"), F.col("region").alias("la")), ["map_id", "a"]).where("lb < la")
        news = near.select("map_id", F.col("a").alias("run"), F.col("lb").alias("region")).unionAll(near.select("map_id", F.col("la").alias("run"), F.col("lb").alias("region")))
        news = _cut(news)
        if news.isEmpty():
            break
        best = news.unionAll(labels).groupBy("map_id", "run").agg(F.min("region").alias("region"))
        up = best.select("map_id", F.col("run").alias("region"), F.col("region").alias("up"))
        labels = _cut(best.join(up, ["map_id", "region"], "left").select("map_id", "run", F.coalesce("up", "region").alias("region")))
    else:
        raise RuntimeError("regions did not settle")
    return r.join(labels, ["map_id", "run"])


def _cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a checkpoint in the shared folder."""
    from ..sources.state import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def label_regions(cells: DataFrame) -> DataFrame:
    """Cells with the region they belong to."""
    labelled = label_runs(cells)
    return labelled.select("map_id", "region", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def region_props(cells: DataFrame) -> DataFrame:
    """Area and bounding box (exclusive ends) of each region."""
    return label_runs(cells).groupBy("map_id", "region").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("area"), F.min("y").alias("y0"), F.min("x0").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x1") + 1).alias("x1")
    )


def gaps(labelled: DataFrame) -> DataFrame:
    """What a region's rows leave free within its box, as runs: (map_id,
    region, y, x0, x1, run, open), open if they touch a side of the box.

    A connected region has a run in each row of its box, so the gaps are
    those before, between and after the runs of a row.
    """
    whole, row = Window.partitionBy("map_id", "region"), Window.partitionBy("map_id", "region", "y").orderBy("x0")
    r = labelled.select("map_id", "region", "y", "x0", "x1", F.min("x0").over(whole).alias("left"), F.max("x1").over(whole).alias("right"), F.min("y").over(whole).alias("top"), F.max("y").over(whole).alias("bottom"))
    r = r.withColumns({"before": F.coalesce(F.lag("x1").over(row) + 1, F.col("left")), "after": F.lead("x0").over(row)})
    last = F.when(F.col("after").isNull(), F.struct((F.col("x1") + 1).alias("x0"), F.col("right").alias("x1")))
    g = r.select("map_id", "region", "y", "left", "right", "top", "bottom", F.inline(F.array_compact(F.array(F.struct(F.col("before").alias("x0"), (F.col("x0") - 1).alias("x1")), last)))).where("x0 <= x1")
    return g.select("map_id", "region", "y", "x0", "x1", (F.col("y").cast("long") * 2**31 + F.col("x0")).alias("run"), F.expr("y = top or y = bottom or x0 = left or x1 = right").alias("open"))


def filled_regions(cells: DataFrame) -> DataFrame:
    """(map_id, region, y, x, area): a region's cells and its holes.

    Holes are groups of other cells within the region's box that touch no
    side of it; the background is joined over its four sides, so that a
    diagonal contour of the region closes.  Only a hole's cells are made of
    runs, never a box's.
    """
    labelled = _cut(label_runs(cells))
    free = _cut(gaps(labelled).select(F.struct("map_id", "region").alias("map_id"), "y", "x0", "x1", "run", "open"))
    ground = settled(free, 0).withColumnRenamed("region", "hole")
    shut = ground.groupBy("map_id", "hole").agg(F.max("open").alias("_open")).where("not _open").drop("_open")
    holes = ground.join(shut, ["map_id", "hole"], "left_semi").select("map_id.*", "y", "x0", "x1")
    area = labelled.groupBy("map_id", "region").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("area"))
    every = labelled.select("map_id", "region", "y", "x0", "x1").unionByName(holes)
    return every.select("map_id", "region", "y", F.explode(F.sequence("x0", "x1")).alias("x")).join(area, ["map_id", "region"])


def region_f1(cells: DataFrame, steps: int = 200, iou: float = 0.6, score: str = "score") -> DataFrame:
    """Best F1 over the sweep: (f1, recall, precision).

    A predicted region matches if over the joint box with some true region
    the intersection over union of all cells is ``iou`` or more; the matched
    predictions are the numerator of recall and of precision.

    A map is folded whole: its cells join by falling threshold, so each
    step's regions grow out of the last one's, and counts in a box are four
    reads of a table of sums.  A task adds up what its maps' counts change
    by at each step, and gives one row a step.
    """
    from .metrics import first_step

    c = first_step(cells.select("map_id", "y", "x", F.col(score).alias("score"), "gt"), [], steps)
    c = c.where("step is not null or gt = 1").select("map_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.coalesce("step", F.lit(steps)).cast("int").alias("step"), F.col("gt").cast("int").alias("gt"))
    dealt = c.repartition("map_id").sortWithinPartitions("map_id")
    counts = _cut(dealt.mapInArrow(_matches(steps, iou), "t int, made long, matched long").groupBy("t").agg(F.sum("made").alias("made"), F.sum("matched").alias("matched")))  # a row for each step
    real = counts.where("t < 0").agg(F.coalesce(F.sum("made"), F.lit(0)).alias("real"))  # one row
    up = Window.orderBy("t")  # one row a step
    r = counts.where("t >= 0").select("t", F.sum("made").over(up).alias("made"), F.sum("matched").over(up).alias("matched")).where("made > 0").crossJoin(F.broadcast(real))
    r = r.select("t", F.try_divide("matched", "real").alias("recall"), F.try_divide("matched", "made").alias("precision"))
    r = r.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), F.lit(0.0)))
    return r.orderBy(F.desc(F.round("f1", 12)), "t").limit(1).select("f1", "recall", "precision")


def _matches(steps: int, iou: float):
    """Of cells (map_id, y, x, step, gt) that arrive by map: rows (t, made,
    matched), what the counts of all maps change by at each step, and (-1,
    true regions, 0)."""

    def grown(groups, width):
        """Boxes of the connected regions after each group of cells."""
        up, box = {}, {}

        def top(c):
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        for group in groups:
            for c in group:
                y, x = divmod(c, width)
                up[c], box[c] = c, (y, x, y + 1, x + 1)
                for n in (c - width - 1, c - width, c - width + 1, c - 1, c + 1, c + width - 1, c + width, c + width + 1):
                    if n in up and (a := top(n)) != (b := top(c)):
                        up[a], p, q = b, box.pop(a), box[b]
                        box[b] = (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))
            yield list(box.values())

    def fold(y, x, step, gt):
        """A map's number of true regions, steps at which its cells change,
        and regions made and matched from there on."""
        import numpy as np

        y, x = y - y.min() + 1, x - x.min() + 1  # a free margin: no region wraps around a row
        shape = (int(y.max()) + 2, int(x.max()) + 2)
        first, truth = np.full(shape, steps), np.zeros(shape, dtype=bool)
        np.minimum.at(first, (y, x), step)
        truth[y[gt == 1], x[gt == 1]] = True
        true = np.array(next(grown([np.flatnonzero(truth).tolist()], shape[1]))).reshape(-1, 4)
        flat = first.ravel()
        order = np.argsort(flat, kind="stable")[: int((flat < steps).sum())]
        changes, at = np.unique(flat[order], return_index=True)
        made, good = np.zeros(len(changes), dtype=np.int64), np.zeros(len(changes), dtype=np.int64)
        several = max(1, (1 << 20) // flat.size)  # steps at a time
        wide = shape[1] + 1
        groups = grown((g.tolist() for g in np.split(order, at[1:])), shape[1])
        for k in range(0, len(changes), several):
            now = changes[k : k + several]
            held = [next(groups) for _ in now]
            made[k : k + len(now)] = [len(h) for h in held]
            if not len(true):
                continue
            on = first <= now[:, None, None]

            def sums(mask, n=len(now)):
                out = np.zeros((n, shape[0] + 1, wide), dtype=np.int32 if flat.size < 1 << 31 else np.int64)
                mask.cumsum(1, dtype=out.dtype).cumsum(2, dtype=out.dtype, out=out[:, 1:, 1:])
                return out.ravel()

            both, either = sums(on & truth), sums(on | truth)
            of, boxes = np.repeat(np.arange(len(now)), made[k : k + len(now)]), np.array([box for h in held for box in h])
            for j in range(0, len(boxes), 4096):
                b, s = boxes[j : j + 4096, None, :], of[j : j + 4096, None]
                top, left = s * (shape[0] + 1) * wide + np.minimum(b[..., 0], true[:, 0]) * wide, np.minimum(b[..., 1], true[:, 1])
                low, right = s * (shape[0] + 1) * wide + np.maximum(b[..., 2], true[:, 2]) * wide, np.maximum(b[..., 3], true[:, 3])
                corners = low + right, top + right, low + left, top + left
                within = lambda a: a.take(corners[0]) - a.take(corners[1]) - a.take(corners[2]) + a.take(corners[3])  # noqa: B023, E731
                hit = (within(both) >= iou * within(either)).any(1)
                good[k : k + len(now)] += np.bincount(of[j : j + 4096][hit], minlength=len(now))
        return len(true), changes, made, good

    def run(batches):
        import numpy as np
        import pyarrow as pa

        real, total, held, last = 0, np.zeros((2, steps), dtype=np.int64), [], None

        def add():
            nonlocal real
            n, changes, made, good = fold(*(np.concatenate(v) for v in zip(*held, strict=True)))
            real += n
            for row, v in zip(total, (made, good), strict=True):
                row[changes] += np.diff(v, prepend=0)

        for batch in batches:
            ids = batch.column("map_id").to_pylist()
            cells = [batch.column(k).to_numpy().astype(np.int64) for k in ("y", "x", "step", "gt")]
            starts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                if held and ids[a] != last:
                    add()
                    held.clear()
                held.append([v[a:b] for v in cells])
                last = ids[a]
        if held:
            add()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, steps), pa.int32()), pa.array(np.r_[real, total[0]]), pa.array(np.r_[0, total[1]])], names=["t", "made", "matched"])

    return run
