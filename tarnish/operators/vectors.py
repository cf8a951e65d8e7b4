"""Galleries, prototypes and distances over tables of feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, doubles, l2_normalize, log_sum_exp, softmax, total
from .blocks import attend_blocks, group_sums, nearest, pair_similarity, projected

#: Entries of a matrix that the driver may hold and broadcast.
HELD_ENTRIES = 1_000_000


def mean_vector(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Component-wise mean of a group's vectors."""
    return group_sums(df, keys, vec, "mean")


def prototype(df: DataFrame, keys: list[str], vec: str, pre_normalize: bool = False) -> DataFrame:
    """Mean then unit length; or the mean of unit vectors, as it is."""
    if pre_normalize:
        return mean_vector(df.withColumn(vec, l2_normalize(F.col(vec))), keys, vec)
    return mean_vector(df, keys, vec).withColumn(vec, l2_normalize(F.col(vec)))


def build_gallery(shots: DataFrame, by: str, vec: str) -> DataFrame:
    """A row for each class: its shots' unit vectors as one array."""
    return shots.groupBy(by).agg(F.collect_list(l2_normalize(F.col(vec))).alias("gallery"))  # k shots a class


def nearest_distance(v, gallery):
    """Column: min over the gallery of (1 - cosine) / 2, for a unit vector."""
    return F.array_min(F.transform(gallery, lambda g: (1 - dot(v, g)) / 2))


def nearest_k(df: DataFrame, gallery: DataFrame, k: int, id_col: str, by: str, vec: str) -> DataFrame:
    """The ``k`` nearest gallery rows (gallery_id, vec) of each row's class."""
    shots = gallery.select(by, F.col(id_col).alias("gallery_id"), F.col(vec).alias("_g"))
    return nearest(df, shots, id_col, "gallery_id", k, [by], vec, "_g").select(id_col, "rank", "gallery_id", "distance")


def similarity(a: DataFrame, b: DataFrame, scale: float, id_a: str, id_b: str, by: str | None = None) -> DataFrame:
    """Scaled dot products of all rows of ``a`` (va) and ``b`` (vb), of those
    that share ``by`` if given."""
    return pair_similarity(a, b, id_a, id_b, scale, [by] if by else [])


def prototype_score(v, prototypes, t: float):
    """Column: softmax over ``t`` times the dot products with an array of
    prototypes."""
    return softmax(F.transform(prototypes, lambda p: t * dot(v, p)))


def pool(tokens: DataFrame, key: str, how: str, vec: str = "vec", pos: str = "pos", valid: str = "valid") -> DataFrame:
    """Masked mean, masked maximum, or first vector of each group."""
    if how == "first":
        return tokens.where(F.col(pos) == 0).select(key, doubles(F.col(vec)).alias(vec))
    return group_sums(tokens.where(F.col(valid)), [key], vec, how)


def keep_tokens(tokens: DataFrame, key: str, share: float, seed: int, pos: str = "pos") -> DataFrame:
    """The first token and a seeded max(1, int(n * share)) of the others."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col(pos).cast("string")))
    rest = Window.partitionBy(key).orderBy(F.when(F.col(pos) == 0, 0).otherwise(1), order)
    n = F.count("*").over(Window.partitionBy(key)) - 1
    ranked = tokens.withColumns({"_n": F.row_number().over(rest) - 1, "_keep": F.greatest(F.lit(1), F.floor(n * share))})
    return ranked.where("_n <= _keep").drop("_n", "_keep")


def attend(tokens: DataFrame, queries: DataFrame, key: str, scale: float, vec: str = "vec") -> DataFrame:
    """softmax(q . v * scale) . v over the tokens of each group, for each of
    its queries (key, query_id, q)."""
    return attend_blocks(tokens, queries, key, "query_id", "q", vec, scale)


def self_smooth(tokens: DataFrame, key: str, token: str, scale: float, vec: str = "vec", normalized: bool = False) -> DataFrame:
    """Each token replaced by the attention over its own group; with
    ``normalized`` the weights use unit vectors and eight times the scale."""
    seen = l2_normalize(F.col(vec)) if normalized else doubles(F.col(vec))
    queries = tokens.select(key, F.col(token).alias("query_id"), seen.alias("q"))
    return attend(tokens.select(key, doubles(F.col(vec)).alias(vec)), queries, key, scale * (8 if normalized else 1), vec)


def project(df: DataFrame, weights: DataFrame, id_col: str, vec: str) -> DataFrame:
    """v @ W with W as rows (i, j, w): a long result (id, j, x).

    Up to ``HELD_ENTRIES`` entries are held as one matrix; a larger one is
    joined entry by entry.  Entries that W lacks are zero.
    """
    import numpy as np

    held = weights.select("i", "j", "w").limit(HELD_ENTRIES + 1).toArrow()  # checked below
    if held.num_rows > HELD_ENTRIES:
        parts = df.select(id_col, F.posexplode(doubles(F.col(vec))).alias("i", "x"))
        return parts.join(weights, "i").groupBy(id_col, "j").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    i, j, w = (np.asarray(held.column(c)) for c in ("i", "j", "w"))
    names = np.unique(j)
    matrix = np.zeros((int(i.max(initial=-1)) + 1, len(names)))
    np.add.at(matrix, (i, np.searchsorted(names, j)), w)
    named = F.array(*[F.struct(F.lit(int(name)).cast(weights.schema["j"].dataType).alias("j"), F.get("_p", F.lit(k)).alias("x")) for k, name in enumerate(names)])
    return projected(df.select(id_col, vec), matrix, vec, "_p").select(id_col, F.inline(named))


def lookup_vectors(ids: DataFrame, table: DataFrame, offsets: DataFrame, key: str, seq: str) -> DataFrame:
    """Id sequences as vectors from ``table`` (id, vec), plus the position's
    ``offsets`` (pos, offset); order is kept."""
    rows = ids.select(key, F.posexplode(seq).alias("pos", "id")).join(table, "id").join(offsets, "pos")
    added = F.zip_with(doubles(F.col("vec")), doubles(F.col("offset")), lambda a, b: a + b)
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", added.alias("v")))), lambda s: s["v"]).alias("vectors"))


def pca_project(df: DataFrame, k: int, id_col: str, vec: str) -> DataFrame:
    """Projection on the first ``k`` principal axes; each axis points so that
    its largest loading is positive."""
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = df.select(id_col, array_to_vector(doubles(F.col(vec))).alias("_v"), doubles(F.col(vec)).alias("_a"))
    axes = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(k)])
    return rows.select(id_col, F.array(*[dot(F.col("_a"), F.array(*map(F.lit, axes[:, j].tolist()))) for j in range(k)]).alias("projected"))


def triplet_loss(df: DataFrame, positive, negative, margin: float, vec: str):
    """Mean of relu(|a - p|^2 - |a - n|^2 + margin)."""
    from ..functions.vectors import squared_distance

    v = F.col(vec)
    return df.agg(F.avg(F.greatest(F.lit(0.0), squared_distance(v, positive) - squared_distance(v, negative) + margin)).alias("loss"))


def contrast_ce(df: DataFrame, anchor, negatives, t: float, vec: str) -> DataFrame:
    """Mean cross-entropy of one anchor against every negative."""
    v = F.col(vec)
    logits = F.concat(F.array(t * dot(v, anchor)), F.transform(negatives, lambda g: t * dot(v, g)))
    return df.agg(F.avg(log_sum_exp(logits) - F.get(logits, 0)).alias("loss"))


def clip_loss(pairs: DataFrame, t: float, batch: str = "batch", row: str = "row") -> DataFrame:
    """Symmetric contrastive loss within batches of (batch, row, va, vb)."""
    return in_batch_losses(pairs, t, batch, row).select(((F.col("by_row") + F.col("by_col")) / 2).alias("loss"))


def in_batch_losses(pairs: DataFrame, t: float, batch: str, row: str) -> DataFrame:
    a = pairs.select(batch, F.col(row).alias("i"), "va")
    b = pairs.select(batch, F.col(row).alias("j"), "vb")
    cells = a.join(b, batch).select(batch, "i", "j", (t * dot(F.col("va"), F.col("vb"))).alias("s"))
    lse = lambda by: F.max("s").over(Window.partitionBy(batch, by)) + F.log(F.sum(F.exp(F.col("s"))).over(Window.partitionBy(batch, by))) - F.max("s").over(Window.partitionBy(batch, by))
    cells = cells.withColumns({"li": lse("i"), "lj": lse("j")}).where("i = j")
    return cells.agg(F.avg(F.col("li") - F.col("s")).alias("by_row"), F.avg(F.col("lj") - F.col("s")).alias("by_col"))


def distill_loss(pairs: DataFrame, t: float, keys: list[str]) -> DataFrame:
    """Mean of -sum softmax(teacher) * log softmax(student) over rows that
    hold both as arrays."""
    s, q = F.transform(F.col("student"), lambda x: t * x), F.transform(F.col("teacher"), lambda x: t * x)
    loss = total(F.zip_with(softmax(q), s, lambda p, x: p * (log_sum_exp(s) - x)))
    return pairs.groupBy(*keys).agg(F.avg(loss).alias("loss"))


def token_ce(logits: DataFrame, labels: DataFrame, pad: int) -> DataFrame:
    """Mean cross-entropy over (seq, pos, token, logit), without pad labels."""
    w = Window.partitionBy("seq", "pos")
    rows = logits.withColumn("lse", F.max("logit").over(w) + F.log(F.sum(F.exp(F.col("logit"))).over(w)) - F.max("logit").over(w))
    rows = rows.join(labels.where(F.col("label") != pad), ["seq", "pos"]).where("token = label")
    return rows.agg(F.avg(F.col("lse") - F.col("logit")).alias("loss"))


def average_layers(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean of a row's scores over its layers, a row for each of ``keys``."""
    return df.groupBy(*keys).agg(F.avg(score).alias(score))
