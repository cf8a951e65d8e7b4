"""Evaluation of scores against 0/1 labels, for all groups in one job.

Rows are first counted by distinct score, so windows run over counts and
ties are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_counts(df: DataFrame, keys: list[str], score: str = "score", label: str | tuple[str, str] = "label") -> DataFrame:
    """Rows of label 1 and 0 by score; ``label`` may also name two columns
    that hold such counts already."""
    if isinstance(label, tuple):
        return df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(label[0]).alias("p"), F.sum(label[1]).alias("n"))
    return df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))


def _cuts(side: int) -> Column:
    """``side`` rows of ``side`` quantiles of a group's finite scores."""
    n = side * side
    flat = F.percentile_approx("_finite", [(k + 1) / n for k in range(n)], 20 * n)
    return F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda k: F.slice(flat, k * side + 1, side))


def running(df: DataFrame, keys: list[str], score: str = "score", label: str | tuple[str, str] = "label", blocks: int = 1024) -> DataFrame:
    """Counts at each distinct score, with those of higher or equal scores
    (tp, fp) and of the whole group (pos, neg).

    Each group's distinct scores are cut at some ``blocks`` quantiles, of a
    sketch of bounded size; windows run within such a block, and over the
    blocks' totals, so that no group of many distinct scores is ordered in
    one task, however the scores are spread.  Nulls and NaN are in blocks of
    their own at the ends, as they sort.
    """
    value, side = F.col("score").cast("double"), max(1, math.isqrt(blocks))
    counts = score_counts(df, keys, score, label)
    counts = counts.withColumn("_finite", F.when(F.abs(value) < float("inf"), value))
    ends = counts.groupBy(*keys).agg(_cuts(side).alias("_cuts"))
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col("_finite")))  # noqa: E731  cuts ascend
    row = F.least(below(F.transform("_cuts", lambda r: F.get(r, F.lit(side - 1)))), F.lit(side - 1))
    near = row * side + below(F.get("_cuts", row))
    high = F.isnan(value) | (value == float("inf"))
    place = F.when(F.col("score").isNull(), -2).when(high, side * side + 1).when(F.col("_finite").isNull(), -1).otherwise(near).cast("int")
    safe = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]

    def looked_up(rows: DataFrame, to: DataFrame, *more) -> DataFrame:
        to = to.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        cond = [*safe, *more]
        out = rows.join(to, cond) if cond else rows.join(to)  # without keys: one row
        return out.drop(*[f"_k_{k}" for k in keys])

    counts = looked_up(counts, ends).withColumn("_block", place).drop("_finite", "_cuts")
    totals = counts.groupBy(*keys, "_block").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_block"))
    whole = Window.partitionBy(*keys)
    totals = totals.select(*keys, F.col("_block").alias("_at"), (F.sum("_p").over(above) - F.col("_p")).alias("_tp"), (F.sum("_n").over(above) - F.col("_n")).alias("_fp"), F.sum("_p").over(whole).alias("pos"), F.sum("_n").over(whole).alias("neg"))
    down = Window.partitionBy(*keys, "_block").orderBy(F.desc("score"))
    counts = counts.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down)})
    out = looked_up(counts, totals, F.col("_block") == F.col("_at"))
    return out.withColumns({"tp": F.col("tp") + F.col("_tp"), "fp": F.col("fp") + F.col("_fp")}).drop("_block", "_at", "_tp", "_fp")


def evaluate(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", sets: list[list[str]] | None = None) -> DataFrame:
    """All runs in one job: ROC-AUC, and best F1 with the lowest threshold
    that reaches it (percent), of each group of ``keys``, null keys included.

    ``sets``: subtotals by these subsets of the keys as well; they are made
    of the counts by score, not of the rows.  ``level`` has a bit for each
    key (the last one is 1) that a row is a total over, whose column is null.
    """
    counts = score_counts(df, keys, score, label)
    every = {k: 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)}
    wanted = dict.fromkeys(tuple(k for k in keys if k in own) for own in [keys, *(sets or [])])
    views = F.array(*[F.struct(*[(F.col(k) if k in own else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys], F.lit(sum(b for k, b in every.items() if k not in own)).alias("level")) for own in wanted])
    counts = counts.select(F.inline(views), "score", "p", "n")
    # one row for each score again, as running() counts rows of label 1 and 0
    r = running(counts, [*keys, "level"], "score", ("p", "n"))
    return r.groupBy(*keys, "level").agg(_area().alias("auc"), F.max(F.struct(F.round(_f1(), 12).alias("f1"), (-F.col("score").cast("double")).alias("t"))).alias("_best")).select(*keys, "level", "auc", percent(F.col("_best.f1")).alias("max_f1"), (-F.col("_best.t")).alias("threshold"))


def _area() -> Column:
    """Of the rows of ``running``: percent, ties count half."""
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0))
    return F.try_divide(100.0 * area, F.max("pos") * F.max("neg"))


def _f1() -> Column:
    """2 tp / (predicted + positive); zero where nothing is found."""
    return F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), F.lit(0.0))


def percent(share: Column) -> Column:
    """Percent with two decimals."""
    return F.round(100 * share, 2)


def max_pool(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """The largest score of each map."""
    return df.groupBy(*keys).agg(F.max(score).alias("score"))


def binned(df: DataFrame, bins: int, score: str = "score") -> DataFrame:
    """Scores as the middles of ``bins`` equal parts of their range, so that
    a curve over all cells of large maps has no more points than that."""
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor(F.try_divide(F.col(score) - F.col("_lo"), width)), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(ends)).withColumn(score, F.coalesce(F.col("_lo") + (at + 0.5) * width, F.col(score))).drop("_lo", "_hi")


def roc_curve(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    r = running(df, keys, score, label)
    return r.select(*keys, "score", F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"))


def roc_auc(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", bins: int | None = None) -> DataFrame:
    """Percent; ties count half; null for groups of one label only.
    ``bins``: see ``binned``."""
    df = df if bins is None else binned(df, bins, score)
    r = running(df, keys, score, label)
    return r.groupBy(*keys).agg(_area().alias("auc"))


def pr_curve(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    r = running(df, keys, score, label)
    return r.select(*keys, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "pos").alias("recall"))


def max_f1(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Best F1 and the lowest threshold that reaches it."""
    c = pr_curve(df, keys, score, label)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("f1", 12)), F.asc("score"))
    return c.withColumn("f1", f1).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, "f1", F.col("score").alias("threshold"))


def threshold_grid(df: DataFrame, keys: list[str], steps: int = 200, score: str = "score") -> DataFrame:
    """step 0 .. steps - 1 from the maximum down; the minimum is left out."""
    ends = df.groupBy(*keys).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    return ends.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).select(*keys, "step", (F.col("hi") - F.col("step") * ((F.col("hi") - F.col("lo")) / steps)).alias("threshold"))


def first_step(df: DataFrame, keys: list[str], steps: int = 200, score: str = "score") -> DataFrame:
    """Adds ``step``: the first sweep step whose threshold is below the
    score (null if none is)."""
    ends = df.groupBy(*keys).agg(F.min(score).alias("lo"), F.max(score).alias("hi")) if keys else df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    df = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))  # one row
    delta = (F.col("hi") - F.col("lo")) / steps
    guess = F.greatest(F.lit(0), F.floor(F.try_divide(F.col("hi") - F.col(score), delta)).cast("int") - 1)
    at = lambda k: F.col(score) > F.col("hi") - k * delta
    step = F.when(at(guess), guess).when(at(guess + 1), guess + 1).when(at(guess + 2), guess + 2).when(at(guess + 3), guess + 3)
    return df.withColumn("step", F.when(step < steps, step)).drop("lo", "hi")


def fpr_curve(cells: DataFrame, steps: int = 200, score: str = "score", label: str = "gt") -> DataFrame:
    """Share of unmasked cells over each step's threshold."""
    neg = cells.select(F.col(score).alias("score"), F.col(label).alias("gt"))
    neg = first_step(neg, [], steps).where("gt = 0")
    counts = neg.groupBy("step").agg(F.count("*").alias("n"))
    total = neg.agg(F.count("*").alias("all"))
    grid = cells.sparkSession.range(steps).select(F.col("id").cast("int").alias("step"))
    up = Window.orderBy("step")  # one row a step
    return grid.join(counts, "step", "left").withColumn("over", F.sum(F.coalesce("n", F.lit(0))).over(up)).crossJoin(F.broadcast(total)).select("step", F.try_divide("over", "all").alias("fpr"))


def iou_curve(cells: DataFrame, map_id: str = "map_id", steps: int = 200, score: str = "score", label: str = "gt") -> DataFrame:
    """Mean and deviation over maps with a mask of intersection over union."""
    c = first_step(cells.select(map_id, F.col(score).alias("score"), F.col(label).alias("gt")), [], steps)
    per = c.groupBy(map_id, F.coalesce("step", F.lit(steps)).alias("step")).agg(F.count("*").alias("pred"), F.sum("gt").alias("both"))
    up, whole = Window.partitionBy(map_id).orderBy("step"), Window.partitionBy(map_id)
    r = per.withColumns({"pred": F.sum("pred").over(up), "both": F.sum("both").over(up), "mask": F.sum("both").over(whole)}).where("mask > 0")
    return _swept(r, up, F.col("both") / (F.col("pred") + F.col("mask") - F.col("both")), steps, "iou", "iou_std")


def _swept(df: DataFrame, up, value: Column, steps: int, mean: str, deviation: str) -> DataFrame:
    """Mean and deviation of ``value`` at every step of the sweep, from rows
    of the steps at which a group's value changes; it is zero before the
    first of them.  Rows of step ``steps`` only stand for groups that may
    have no others.  Equal stretches of equal values are counted before they
    are laid out by step, so a group costs its changes, not all steps."""
    df = df.withColumns({"_until": F.lead("step", 1, steps).over(up), "_first": F.lag("step").over(up).isNull(), "_value": value})
    own = F.struct(F.col("step").alias("at"), F.col("_until").alias("until"), F.col("_value").alias("value"))
    before = F.when(F.col("_first"), F.struct(F.lit(0).alias("at"), F.col("step").alias("until"), F.lit(0.0).alias("value")))
    parts = df.select(F.inline(F.array_compact(F.array(before, own)))).where("at < until").groupBy("at", "until", "value").agg(F.count("*").alias("n"))
    r = parts.select(F.explode(F.sequence("at", F.col("until") - 1)).alias("step"), "value", "n").groupBy("step", "value").agg(F.sum("n").alias("n"))
    one = Window.partitionBy("step")  # a row for each distinct value
    r = r.withColumn("_mean", F.sum(F.col("n") * F.col("value")).over(one) / F.sum("n").over(one))
    return r.groupBy("step").agg(F.max("_mean").alias(mean), F.sqrt(F.sum(F.col("n") * F.pow(F.col("value") - F.col("_mean"), 2)) / F.sum("n")).alias(deviation))


def pro_curve(cells: DataFrame, regions: DataFrame, map_id: str = "map_id", steps: int = 200, score: str = "score") -> DataFrame:
    """Mean and deviation over regions of covered cells over area.

    regions: (map_id, y, x, region, area) with the cells of hole-filled
    regions and the area without the filling, so a value may exceed 1.
    """
    c = first_step(cells.select(map_id, "y", "x", F.col(score).alias("score")), [], steps)
    # by sorted partitions: cells made of runs would be taken for a small table
    hit = regions.select(map_id, "y", "x", "region", "area").join(c.where("step is not null").hint("merge"), [map_id, "y", "x"], "left")
    per = hit.groupBy(map_id, "region", F.coalesce("step", F.lit(steps)).alias("step")).agg(F.count("*").alias("n"), F.max("area").alias("area"))
    up = Window.partitionBy(map_id, "region").orderBy("step")
    return _swept(per.withColumn("n", F.sum("n").over(up)), up, F.col("n") / F.col("area"), steps, "pro", "pro_std")


def pro_auc(pro: DataFrame, fpr: DataFrame, limit: float = 0.3) -> DataFrame:
    """Area under the overlap curve up to ``limit``, over the rescaled rate;
    null if only one point is left."""
    r = pro.join(fpr, "step").where(F.col("fpr") <= limit)  # a row a step
    line = Window.orderBy("step")
    r = r.withColumns({"dx": F.col("fpr") - F.lag("fpr").over(line), "my": (F.col("pro") + F.lag("pro").over(line)) / 2})
    return r.agg(F.try_divide(F.sum(F.col("dx") * F.col("my")), F.max("fpr") - F.min("fpr")).alias("pro_auc"))


def score_histogram(df: DataFrame, label: str, bins: int = 50, score: str = "score") -> DataFrame:
    """Share of each label's scores in equal bins over the whole range."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    b = F.least(F.floor(F.coalesce(F.try_divide((F.col(score) - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = df.crossJoin(F.broadcast(ends)).groupBy(label, b.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def bootstrap(df: DataFrame, n: int, seed: int, parts: int | None = None) -> DataFrame:
    """Exactly ``n`` rows drawn with replacement, each row alike; ``seed``
    repeats the draw for the same rows.

    Equal rows are one row with a count, dealt into ``parts`` by a hash (one
    for each 100,000 of them, unless given).  One multinomial draw on the
    driver deals the n draws to the parts, one in each part deals them to
    its rows, which are then repeated.  An empty table gives no rows.
    """
    import numpy as np

    columns = df.columns
    # microseconds, which the plain form of a timestamp leaves out
    text = F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    rows = df.groupBy(*columns).agg(F.count("*").alias("_copies"))
    parts = parts or max(1, -(-rows.count() // 100_000))
    key = F.xxhash64("_text", F.lit(seed))
    rows = rows.withColumn("_text", text).withColumn("_of", F.pmod(key, F.lit(parts)).cast("int"))
    sizes = {r["_of"]: r["n"] for r in rows.groupBy("_of").agg(F.sum("_copies").alias("n")).collect()}  # a row a part
    if not sizes or n < 1:
        return df.limit(0)
    held = np.array([sizes.get(k, 0) for k in range(parts)])
    drawn = np.random.default_rng(seed).multinomial(n, held / held.sum())

    def deal(table):
        import numpy as np
        import pyarrow as pa

        table, k = table.sort_by("_text"), table.column("_of")[0].as_py()
        copies = np.asarray(table.column("_copies"))
        times = np.random.default_rng([seed, k]).multinomial(drawn[k], copies / copies.sum())
        return table.select(columns).append_column("_times", pa.array(times, pa.int64()))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _times long"
    dealt = rows.groupBy("_of").applyInArrow(deal, shape).where("_times > 0")
    return dealt.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select(*columns)


def metrics_table(df: DataFrame, metrics: list[str], name: str = "name", shares: bool = False) -> DataFrame:
    """Rows by name, a column for each metric, zero where there is none;
    ``shares``: values are shares and shown as percent."""
    df = df.withColumn("value", percent(F.col("value"))) if shares else df
    return df.groupBy(name).pivot("metric", metrics).agg(F.first("value")).na.fill(0.0)


def minmax(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Scaled to 0..1 within each group; a constant group gives null."""
    ends = df.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    return df.join(ends, keys).withColumn("scaled", F.try_divide(F.col(score) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def scale_255(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """(x - min) / max * 255, cut to whole numbers; the divisor is the maximum."""
    ends = df.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    return df.join(ends, keys).withColumn("scaled", F.try_divide(F.col(score) - F.col("_lo"), F.col("_hi")) * 255).withColumn("scaled", F.col("scaled").cast("int")).drop("_lo", "_hi")
