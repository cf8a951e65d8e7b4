"""Queries over ``embeddings``: shots, galleries, prototypes, distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics, selection
from ..operators import vectors as O
from ..operators.blocks import lsh_nearest, nearest, nearest_in_groups
from ..sources.files import read_vectors
from .registry import query, table

#: Shots of each class and their seed.
K, SEED = 4, 111
BASE = f"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, label, v, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS n FROM e),
shots AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || vec_id::VARCHAR), vec_id) AS shot FROM u QUALIFY shot <= {K}),
rest AS (SELECT u.* FROM u WHERE vec_id NOT IN (SELECT vec_id FROM shots))
"""


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def _shots(spark, sf_dir):
    return selection.sample_shots(_rows(spark, sf_dir), K, SEED, "label", "vec_id")


def _gallery(spark, sf_dir):
    return O.build_gallery(_shots(spark, sf_dir), "label", "v")


def _rest(spark, sf_dir):
    return _rows(spark, sf_dir).join(_shots(spark, sf_dir).select("vec_id"), "vec_id", "left_anti")


def class_scores(spark, sf_dir):
    """Each row that is no shot against the gallery of each class."""
    shots = _shots(spark, sf_dir).select(F.col("label").alias("class"), F.col("v").alias("g"))
    rest = _rest(spark, sf_dir)
    scored = nearest_in_groups(rest, shots, "vec_id", "class", "v", "g").withColumnRenamed("distance", "score")
    return scored.join(rest.select("vec_id", "label"), "vec_id")


SCORES = BASE + ", cs AS (SELECT r.vec_id, r.label, s.label AS class, min((1 - list_dot_product(r.n, s.n)) / 2) AS score FROM rest r, shots s GROUP BY ALL)"


@query(SCORES + """, c AS (SELECT class, score, sum((label <> class)::INT) AS p, sum((label = class)::INT) AS n FROM cs GROUP BY 1, 2),
r AS (SELECT *, sum(p) OVER (PARTITION BY class ORDER BY score DESC) AS tp FROM c)
SELECT class, round(100.0 * sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)), 6)::DOUBLE AS auc FROM r GROUP BY class""")
def fewshot_auc_by_class(spark, sf_dir):
    """The whole slice: shots, galleries, distances, AUROC by class (percent)."""
    scored = class_scores(spark, sf_dir).withColumn("anomaly", (F.col("label") != F.col("class")).cast("int"))
    return metrics.evaluate(scored, ["class"], "score", "anomaly").select("class", V.rounded("auc", 6).alias("auc"))


@query(BASE + "SELECT vec_id, list_transform(n, lambda x: round(x, 6)) AS unit FROM u")
def v1_l2_normalize(spark, sf_dir):
    return _rows(spark, sf_dir).select("vec_id", F.transform(V.l2_normalize(F.col("v")), lambda x: V.rounded(x, 6)).alias("unit"))


@query(BASE + "SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS dot, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM u a JOIN u b ON b.vec_id = a.vec_id + 1")
def v2_dot_cosine(spark, sf_dir):
    a = _rows(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return a.join(b, "vec_id").select("vec_id", V.rounded(V.dot(F.col("v"), F.col("w")), 6).alias("dot"), V.rounded(V.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


PROTO = ", m AS (SELECT label, i, avg(v[i]) AS x, avg(n[i]) AS y FROM u, range(1, 65) t(i) GROUP BY 1, 2), p AS (SELECT label, list(x ORDER BY i) AS x, list(y ORDER BY i) AS y FROM m GROUP BY label)"


@query(BASE + PROTO + "SELECT label, list_transform(x, lambda z: round(z / sqrt(list_dot_product(x, x)), 6)) AS prototype FROM p")
def v3_prototype(spark, sf_dir):
    return O.prototype(_rows(spark, sf_dir), ["label"], "v").select("label", F.transform("v", lambda x: V.rounded(x, 6)).alias("prototype"))


@query(BASE + PROTO + "SELECT label, list_transform(y, lambda z: round(z, 6)) AS prototype FROM p")
def v4_mean_of_units(spark, sf_dir):
    return O.prototype(_rows(spark, sf_dir), ["label"], "v", pre_normalize=True).select("label", F.transform("v", lambda x: V.rounded(x, 6)).alias("prototype"))


@query(BASE + "SELECT r.vec_id, s.vec_id AS shot_id, round(10 * list_dot_product(r.n, s.n), 6) AS similarity FROM rest r JOIN shots s USING (label)")
def v5_similarity(spark, sf_dir):
    a = _rest(spark, sf_dir).select("vec_id", "label", V.l2_normalize(F.col("v")).alias("va"))
    b = _shots(spark, sf_dir).select(F.col("vec_id").alias("shot_id"), "label", V.l2_normalize(F.col("v")).alias("vb"))
    return O.similarity(a, b, 10.0, "vec_id", "shot_id", "label").select("vec_id", "shot_id", V.rounded("similarity", 6).alias("similarity"))


@query(BASE + "SELECT a.vec_id, b.vec_id AS other_id, round(4 * list_dot_product(a.n, b.n), 6) AS similarity FROM u a, u b WHERE a.vec_id % 7 = 0")
def v5_similarity_of_all(spark, sf_dir):
    """Every seventh row against all rows, without a common key, in blocks."""
    rows = _rows(spark, sf_dir).withColumn("n", V.l2_normalize(F.col("v")))
    a, b = rows.where("vec_id % 7 = 0").select("vec_id", F.col("n").alias("va")), rows.select(F.col("vec_id").alias("other_id"), F.col("n").alias("vb"))
    return O.similarity(a, b, 4.0, "vec_id", "other_id").select("vec_id", "other_id", V.rounded("similarity", 6).alias("similarity"))


@query(BASE + "SELECT a.vec_id, round(min((1 - list_dot_product(a.n, b.n)) / 2), 6) AS distance FROM u a, u b WHERE a.vec_id % 2 = 1 AND b.vec_id % 2 = 0 GROUP BY a.vec_id")
def v8_nearest_of_all(spark, sf_dir):
    """Odd rows against all even ones: a gallery as large as the table."""
    rows = _rows(spark, sf_dir)
    out = nearest(rows.where("vec_id % 2 = 1"), rows.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "near_id"), "vec_id", "near_id", va="v", vb="v")
    return out.select("vec_id", V.rounded("distance", 6).alias("distance"))


@query()
def v8_nearest_lsh(spark, sf_dir):
    """As v8_nearest_of_all, by hashing; what finds nothing near is searched
    exactly."""
    rows = _rows(spark, sf_dir)
    out = lsh_nearest(rows.where("vec_id % 2 = 1"), rows.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "near_id"), "vec_id", "near_id", length=0.5, va="v", vb="v")
    return out.select("vec_id", "near_id", V.rounded("distance", 6).alias("distance"), "exact")


@query(BASE + PROTO + """, q AS (SELECT label, list_transform(x, lambda z: z / sqrt(list_dot_product(x, x))) AS q FROM p),
s AS (SELECT u.vec_id, q.label, exp(10 * list_dot_product(u.n, q.q)) AS e FROM u, q)
SELECT vec_id, label, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS score FROM s""")
def v6_prototype_score(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    p = O.prototype(rows, ["label"], "v").agg(F.array_sort(F.collect_list(F.struct("label", "v"))).alias("p"))  # a row a class
    scored = rows.crossJoin(F.broadcast(p)).withColumn("s", O.prototype_score(V.l2_normalize(F.col("v")), F.col("p.v"), 10.0))
    return scored.select("vec_id", F.explode(F.arrays_zip(F.col("p.label").alias("label"), F.col("s").alias("s"))).alias("z")).select("vec_id", F.col("z.label").alias("label"), V.rounded("z.s", 6).alias("score"))


@query(BASE + "SELECT label, vec_id, shot, round(list_sum(list_transform(n, lambda x: x * x)), 6) AS length FROM shots")
def v7_gallery(spark, sf_dir):
    g = _shots(spark, sf_dir).withColumn("n", V.l2_normalize(F.col("v")))
    return g.select("label", "vec_id", F.col("shot").cast("long").alias("shot"), V.rounded(V.dot(F.col("n"), F.col("n")), 6).alias("length"))


@query(SCORES + "SELECT vec_id, class, round(score, 6) AS score FROM cs")
def v8_nearest_distance(spark, sf_dir):
    return class_scores(spark, sf_dir).select("vec_id", "class", V.rounded("score", 6).alias("score"))


@query(BASE + """, d AS (SELECT r.vec_id, s.vec_id AS gallery_id, (1 - list_dot_product(r.n, s.n)) / 2 AS distance FROM rest r JOIN shots s USING (label))
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 9), gallery_id) AS rank, gallery_id, round(distance, 6) AS distance FROM d QUALIFY rank <= 3""")
def v9_nearest_k(spark, sf_dir):
    out = O.nearest_k(_rest(spark, sf_dir), _shots(spark, sf_dir), 3, "vec_id", "label", "v")
    return out.select("vec_id", F.col("rank").cast("long").alias("rank"), "gallery_id", V.rounded("distance", 6).alias("distance"))


@query(SCORES + "SELECT vec_id, round(avg(score), 6) AS score FROM cs GROUP BY vec_id")
def v10_average_layers(spark, sf_dir):
    """Scores against several galleries (as layers), averaged by row."""
    return O.average_layers(class_scores(spark, sf_dir), ["vec_id"]).select("vec_id", V.rounded("score", 6).alias("score"))


TOKENS = BASE + ", t AS (SELECT vec_id // 25 AS image, vec_id % 25 AS pos, label NOT IN (8, 9) AS valid, v, n FROM u)"


def _tokens(spark, sf_dir):
    return _rows(spark, sf_dir).select(F.expr("vec_id div 25").alias("image"), (F.col("vec_id") % 25).alias("pos"), (~F.col("label").isin(8, 9)).alias("valid"), F.col("v").alias("vec"))


@query(TOKENS + """, m AS (SELECT image, i, avg(v[i]) FILTER (valid) AS a, max(v[i]) FILTER (valid) AS b, max(v[i]) FILTER (pos = 0) AS c FROM t, range(1, 65) r(i) GROUP BY 1, 2)
SELECT image, list(round(a, 6) ORDER BY i) AS mean, list(round(b, 6) ORDER BY i) AS max, list(round(c, 6) ORDER BY i) AS first FROM m GROUP BY image""")
def v11_pool(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    r = lambda c: F.transform(c, lambda x: V.rounded(x, 6))
    parts = [O.pool(t, "image", how).select("image", r(F.col("vec")).alias(how)) for how in ("mean", "max", "first")]
    return parts[0].join(parts[1], "image").join(parts[2], "image")


@query(TOKENS + """, m AS (SELECT image, i, max(abs(v[i])) AS a FROM t, range(1, 65) r(i) GROUP BY 1, 2)
SELECT image, list(round(a, 6) ORDER BY i) AS pooled FROM m GROUP BY image""")
def u2_pooler_in_sql(spark, sf_dir):
    """A user's pooler (largest magnitude), registered and called in SQL."""
    from ..streaming.scoring import register_sql_pooler

    register_sql_pooler(spark, "largest_magnitude", lambda m: abs(m).max(0))
    _tokens(spark, sf_dir).createOrReplaceTempView("tarnish_tokens")
    out = spark.sql("SELECT image, largest_magnitude(vec) AS pooled FROM tarnish_tokens GROUP BY image")
    return out.select("image", F.transform("pooled", lambda x: V.rounded(x, 6)).alias("pooled"))


@query(TOKENS + """, k AS (SELECT image, pos, count(*) OVER (PARTITION BY image) - 1 AS n, row_number() OVER (PARTITION BY image ORDER BY (pos <> 0)::INT, md5('7:' || image::VARCHAR || ':' || pos::VARCHAR)) - 1 AS k FROM t)
SELECT image, pos FROM k WHERE k <= greatest(1, floor(n * 0.5))""")
def v12_keep_tokens(spark, sf_dir):
    return O.keep_tokens(_tokens(spark, sf_dir).select("image", "pos"), "image", 0.5, 7)


@query(TOKENS + """, s AS (SELECT a.image, a.pos AS query_id, exp(0.5 * list_dot_product(a.v, b.v)) AS e, b.v FROM t a JOIN t b USING (image)),
w AS (SELECT image, query_id, e / sum(e) OVER (PARTITION BY image, query_id) AS w, v FROM s),
x AS (SELECT image, query_id, i, sum(w * v[i]) AS x FROM w, range(1, 65) r(i) GROUP BY 1, 2, 3)
SELECT image, query_id, list(round(x, 6) ORDER BY i) AS vec FROM x GROUP BY 1, 2""")
def v13_self_smooth(spark, sf_dir):
    out = O.self_smooth(_tokens(spark, sf_dir), "image", "pos", 0.5)
    return out.select("image", "query_id", F.transform("vec", lambda x: V.rounded(x, 6)).alias("vec"))


@query(TOKENS + """, q AS (SELECT image, v AS q FROM t WHERE pos = 0),
s AS (SELECT t.image, exp(2 * list_dot_product(q.q, t.v)) AS e, t.v FROM t JOIN q USING (image)),
w AS (SELECT image, e / sum(e) OVER (PARTITION BY image) AS w, v FROM s),
x AS (SELECT image, i, sum(w * v[i]) AS x FROM w, range(1, 65) r(i) GROUP BY 1, 2)
SELECT image, list(round(x, 6) ORDER BY i) AS vec FROM x GROUP BY 1""")
def v14_attend(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    q = t.where("pos = 0").select("image", F.lit(0).alias("query_id"), F.col("vec").alias("q"))
    return O.attend(t, q, "image", 2.0).select("image", F.transform("vec", lambda x: V.rounded(x, 6)).alias("vec"))


@query(BASE + "SELECT vec_id, j::INT AS j, round(sum(v[i + 1] * (((i * 7 + j * 3) % 11) - 5) / 10.0), 6)::DOUBLE AS x FROM u, range(0, 64) a(i), range(0, 3) b(j) GROUP BY 1, 2")
def v15_project(spark, sf_dir):
    w = spark.range(64 * 3).select(F.expr("cast(id div 3 as int)").alias("i"), F.expr("cast(id % 3 as int)").alias("j"))
    w = w.withColumn("w", ((F.col("i") * 7 + F.col("j") * 3) % 11 - 5) / 10.0)
    return O.project(_rows(spark, sf_dir), w, "vec_id", "v").select("vec_id", "j", V.rounded("x", 6).alias("x"))


@query()
def v16_pca(spark, sf_dir):
    return O.pca_project(_rows(spark, sf_dir), 2, "vec_id", "v")


@query(BASE + "SELECT vec_id, round(max(abs(v[i] / 3 - (v[i] / 3)::FLOAT::DOUBLE)), 9) AS loss FROM u, range(1, 65) r(i) GROUP BY vec_id")
def v17_cast_precision(spark, sf_dir):
    third = F.transform("v", lambda x: x / 3)
    gap = F.zip_with(third, V.cast_precision(third), lambda a, b: F.abs(a - b))
    return _rows(spark, sf_dir).select("vec_id", V.rounded(F.array_max(gap), 9).alias("loss"))


@query(BASE + """, k AS (SELECT doc_id, unnest([doc_id % n, (doc_id * 7) % n, (doc_id * 13) % n]) AS id, unnest([0, 1, 2]) AS pos FROM documents, (SELECT count(*) AS n FROM embeddings))
SELECT doc_id, list(round(u.v[1] + pos, 6) ORDER BY pos) AS firsts FROM k JOIN u ON u.vec_id = k.id GROUP BY doc_id""")
def v18_lookup_vectors(spark, sf_dir):
    n = _rows(spark, sf_dir).agg(F.count("*").alias("n"))  # one row
    ids = table(spark, sf_dir, "documents").join(F.broadcast(n)).select("doc_id", F.array(*[F.col("doc_id") * k % F.col("n") for k in (1, 7, 13)]).alias("ids"))
    offsets = spark.range(3).select(F.col("id").cast("int").alias("pos"), F.array_repeat(F.col("id").cast("double"), 64).alias("offset"))
    out = O.lookup_vectors(ids, _rows(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("v").alias("vec")), offsets, "doc_id", "ids")
    return out.select("doc_id", F.transform("vectors", lambda v: V.rounded(v[0], 6)).alias("firsts"))


@query(BASE + "SELECT label, vec_id, shot FROM shots")
def k2_sample_shots(spark, sf_dir):
    return _shots(spark, sf_dir).select("label", "vec_id", F.col("shot").cast("long").alias("shot"))


@query("SELECT label, vec_id, idx, ord FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx FROM embeddings) JOIN (SELECT unnest([5, 0, 9, 2]) AS idx, unnest([0, 1, 2, 3]) AS ord) USING (idx)")
def k1_select_shots(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    lists = e.select("label").distinct().select("label", F.posexplode(F.array(*map(F.lit, (5, 0, 9, 2)))).alias("ord", "idx"))
    return selection.select_shots(e, lists, "label", "vec_id").select("label", "vec_id", F.col("idx").cast("long").alias("idx"), "ord")


@query("SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY md5('5:' || vec_id::VARCHAR), vec_id) - 1) // 16 AS batch FROM embeddings")
def k6_assign_batches(spark, sf_dir):
    return selection.assign_batches(table(spark, sf_dir, "embeddings").select("label", "vec_id"), 16, 5, ["label"], "vec_id")


@query("SELECT vec_id, len(embedding)::INT AS dim FROM embeddings")
def s5_read_vectors(spark, sf_dir):
    return read_vectors(table(spark, sf_dir, "embeddings"), "embedding", 64).select("vec_id", F.size("embedding").alias("dim"))


@query(SCORES + "SELECT vec_id, round(score, 6) AS score FROM cs WHERE class = label")
def x1_score_batch(spark, sf_dir):
    """What the streaming query scores, as one batch."""
    from ..streaming.scoring import score_stream

    return score_stream(_rest(spark, sf_dir), _gallery(spark, sf_dir), "label", "v").select("vec_id", V.rounded("score", 6).alias("score"))
