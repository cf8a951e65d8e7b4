"""Objective aggregates over frozen vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import tuning
from ..operators import vectors as O
from .registry import query, table
from .vectors import BASE, PROTO, _rows

PROTOS = BASE + PROTO + ", q AS (SELECT label, list_transform(x, lambda z: z / sqrt(list_dot_product(x, x))) AS q FROM p), k AS (SELECT (SELECT q FROM q WHERE label = 0) AS a, (SELECT q FROM q WHERE label = 1) AS b, (SELECT list(q ORDER BY label) FROM q WHERE label > 0) AS negs)"


def _with_protos(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    p = O.prototype(rows, ["label"], "v")
    k = p.agg(F.array_sort(F.collect_list(F.struct("label", "v"))).alias("p")).select("p.v")  # a row a class
    return rows.withColumn("n", V.l2_normalize(F.col("v"))).crossJoin(F.broadcast(k.select(F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"), F.expr("slice(v, 2, size(v) - 1)").alias("negs"))))


@query(PROTOS + " SELECT round(avg(greatest(0, (2 - 2 * list_dot_product(n, a)) - (2 - 2 * list_dot_product(n, b)) + 0.1)), 6) AS loss FROM u, k")
def l1_triplet_loss(spark, sf_dir):
    return O.triplet_loss(_with_protos(spark, sf_dir), F.col("a"), F.col("b"), 0.1, "n").select(V.rounded("loss", 6).alias("loss"))


@query(PROTOS + " SELECT round(avg(ln(exp(10 * list_dot_product(n, a)) + list_sum(list_transform(negs, lambda g: exp(10 * list_dot_product(n, g))))) - 10 * list_dot_product(n, a)), 6) AS loss FROM u, k")
def l2_contrast_ce(spark, sf_dir):
    return O.contrast_ce(_with_protos(spark, sf_dir), F.col("a"), F.col("negs"), 10.0, "n").select(V.rounded("loss", 6).alias("loss"))


@query(BASE + ", m AS (SELECT label % 2 AS half, i, avg(n[i]) AS y FROM u, range(1, 65) t(i) GROUP BY 1, 2) SELECT round(sum((a.y - b.y) ** 2), 6) AS alignment, round(1 + 0.001 * sum((a.y - b.y) ** 2), 6) AS total FROM m a JOIN m b USING (i) WHERE a.half = 0 AND b.half = 1")
def l3_l4_alignment_and_total(spark, sf_dir):
    m = O.prototype(_rows(spark, sf_dir).withColumn("half", F.col("label") % 2), ["half"], "v", pre_normalize=True)
    both = m.where("half = 0").select(F.col("v").alias("a")).join(m.where("half = 1").select(F.col("v").alias("b")))  # one row each
    d = V.alignment_loss(F.col("a"), F.col("b"))
    return both.select(V.rounded(d, 6).alias("alignment"), V.rounded(V.total_loss(F.lit(1), d), 6).alias("total"))


PAIRS = BASE + ", b AS (SELECT vec_id // 20 AS batch, vec_id % 20 AS row, n AS va, list_reverse(n) AS vb FROM u), c AS (SELECT x.batch, x.row AS i, y.row AS j, 5 * list_dot_product(x.va, y.vb) AS s FROM b x JOIN b y USING (batch))"


def _pairs(spark, sf_dir):
    n = V.l2_normalize(F.col("v"))
    return _rows(spark, sf_dir).select(F.expr("vec_id div 20").alias("batch"), (F.col("vec_id") % 20).alias("row"), n.alias("va"), F.reverse(n).alias("vb"))


@query(PAIRS + ", l AS (SELECT i, j, s, ln(sum(exp(s)) OVER (PARTITION BY batch, i)) AS li, ln(sum(exp(s)) OVER (PARTITION BY batch, j)) AS lj FROM c) SELECT round((avg(li - s) + avg(lj - s)) / 2, 6) AS loss FROM l WHERE i = j")
def l5_contrastive_loss(spark, sf_dir):
    return O.clip_loss(_pairs(spark, sf_dir), 5.0).select(V.rounded("loss", 6).alias("loss"))


@query(BASE + ", r AS (SELECT vec_id, label, i, exp(2 * v[i]) / sum(exp(2 * v[i])) OVER (PARTITION BY vec_id) AS p, 2 * v[65 - i] - ln(sum(exp(2 * v[65 - i])) OVER (PARTITION BY vec_id)) AS q FROM u, range(1, 65) t(i)), x AS (SELECT vec_id, label, -sum(p * q) AS loss FROM r GROUP BY 1, 2) SELECT label, round(avg(loss), 6) AS loss FROM x GROUP BY label")
def l6_distillation(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("label", F.col("v").alias("teacher"), F.reverse("v").alias("student"))
    return O.distill_loss(rows, 2.0, ["label"]).select("label", V.rounded("loss", 6).alias("loss"))


@query(BASE + ", r AS (SELECT vec_id, label, i - 1 AS token, v[i] AS logit, ln(sum(exp(v[i])) OVER (PARTITION BY vec_id)) AS lse FROM u, range(1, 65) t(i)) SELECT round(avg(lse - logit), 6) AS loss FROM r WHERE token = label AND label <> 0")
def l7_token_ce(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumns({"seq": F.col("vec_id"), "pos": F.lit(0)})
    logits = rows.select("seq", "pos", F.posexplode("v").alias("token", "logit"))
    return O.token_ce(logits, rows.select("seq", "pos", "label"), 0).select(V.rounded("loss", 6).alias("loss"))


@query()
def l8_tune_prototypes(spark, sf_dir):
    """Loss by epoch; prototypes start at the classes' means."""
    import numpy as np

    rows = _rows(spark, sf_dir).withColumn("v", V.l2_normalize(F.col("v")))
    start = np.array([r["v"] for r in O.prototype(rows, ["label"], "v").orderBy("label").collect()])  # a row a class
    _, losses = tuning.tune_prototypes(rows, start, vec="v", epochs=100)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch int, loss double")


@query()
def u1_embed_batch(spark, sf_dir):
    from ..streaming.scoring import embed_batch, hashed_encoder

    return embed_batch(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", hashed_encoder()).select("doc_id", F.size("vec").alias("dim"))


@query("SELECT i::INT AS epoch, round(1e-5 + (0.002 - 1e-5) * (1 + cos(pi() * i / 100)) / 2, 9) AS cosine, round(0.002 * pow(0.95, i), 9) AS exponential FROM range(CASE WHEN (SELECT count(*) FROM embeddings) > 0 THEN 100 ELSE 0 END) t(i)")
def l9_rate_schedule(spark, sf_dir):
    """Rates of a tuning of the classes in ``embeddings``."""
    some = table(spark, sf_dir, "embeddings").select("label").limit(1).select()
    both = tuning.lr_schedule(spark, "cosine", 100).withColumnRenamed("rate", "cosine").join(tuning.lr_schedule(spark, "exponential", 100).withColumnRenamed("rate", "exponential"), "epoch")
    return both.join(F.broadcast(some)).select("epoch", V.rounded("cosine", 9).alias("cosine"), V.rounded("exponential", 9).alias("exponential"))
