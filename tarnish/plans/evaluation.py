"""Queries that evaluate scores: image level on ``labels``, fused scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import doubles, fuse_mean, harmonic, quantize, render, rounded
from ..operators import chain
from ..operators import grids as G
from ..operators import metrics as M
from ..operators import vectors as O
from .grids import taps_sql
from .registry import query, table

BASE = "WITH s AS (SELECT doc_id, d.lang, n_chars // 50 AS score, l.toxic AS label FROM documents d JOIN labels l USING (doc_id))"
RUN = BASE + """, c AS (SELECT lang, score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY 1, 2),
r AS (SELECT *, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER (PARTITION BY lang) AS pos, sum(n) OVER (PARTITION BY lang) AS neg FROM c WINDOW d AS (PARTITION BY lang ORDER BY score DESC))"""


def _scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr("n_chars div 50").alias("score"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")


@query(RUN + " SELECT lang, score, round(fp / nullif(neg, 0), 6)::DOUBLE AS fpr, round(tp / nullif(pos, 0), 6)::DOUBLE AS tpr FROM r")
def a1_roc_curve(spark, sf_dir):
    return M.roc_curve(_scores(spark, sf_dir), ["lang"]).select("lang", "score", rounded("fpr", 6).alias("fpr"), rounded("tpr", 6).alias("tpr"))


@query(RUN + " SELECT lang, round(100.0 * sum(n * (tp - p / 2)) / nullif(max(pos) * max(neg), 0), 6)::DOUBLE AS auc FROM r GROUP BY lang")
def a2_roc_auc(spark, sf_dir):
    return M.roc_auc(_scores(spark, sf_dir), ["lang"]).select("lang", rounded("auc", 6).alias("auc"))


@query(RUN + " SELECT lang, score, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / nullif(pos, 0), 6)::DOUBLE AS recall FROM r")
def a4_pr_curve(spark, sf_dir):
    return M.pr_curve(_scores(spark, sf_dir), ["lang"]).select("lang", "score", rounded("precision", 6).alias("precision"), rounded("recall", 6).alias("recall"))


@query(RUN + ", f AS (SELECT lang, score, CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (tp + fp + pos) END AS f1 FROM r) SELECT lang, round(f1, 6)::DOUBLE AS f1, score AS threshold FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(f1, 12) DESC, score) = 1")
def a5_max_f1(spark, sf_dir):
    return M.max_f1(_scores(spark, sf_dir), ["lang"]).select("lang", rounded("f1", 6).alias("f1"), "threshold")


@query(BASE + ", m AS (SELECT lang, min(score) AS lo, max(score) AS hi FROM s GROUP BY lang) SELECT lang, step::INT AS step, round(hi - step * ((hi - lo) / 200.0), 6) AS threshold FROM m, range(200) t(step)")
def a6_threshold_grid(spark, sf_dir):
    return M.threshold_grid(_scores(spark, sf_dir), ["lang"]).select("lang", "step", rounded("threshold", 6).alias("threshold"))


@query(BASE + ", e AS (SELECT min(score) AS lo, max(score) AS hi FROM s), b AS (SELECT label, least(floor((score - lo) * 50 / (hi - lo)), 49)::INT AS bin, count(*) AS n FROM s, e GROUP BY 1, 2) SELECT label, bin, n, round(n / sum(n) OVER (PARTITION BY label), 6)::DOUBLE AS share FROM b")
def a12_histogram(spark, sf_dir):
    return M.score_histogram(_scores(spark, sf_dir), "label").select("label", "bin", "n", rounded("share", 6).alias("share"))


@query()
def a13_bootstrap(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return M.bootstrap(s, 2 * s.count(), 7)


@query("""WITH s AS (SELECT d.lang, nullif(d.source, 'none') AS source, n_chars // 50 AS score, l.toxic AS label FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT lang, source, grouping(lang, source)::INT AS level, score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY GROUPING SETS ((lang, source, score), (lang, score), (score))),
r AS (SELECT *, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER w AS pos, sum(n) OVER w AS neg FROM g WINDOW w AS (PARTITION BY lang, source, level), d AS (PARTITION BY lang, source, level ORDER BY score DESC)),
f AS (SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (tp + fp + pos) END AS f1 FROM r)
SELECT lang, source, level, round(100.0 * sum(n * (tp - p / 2)) / nullif(max(pos) * max(neg), 0), 6)::DOUBLE AS auc, round(100 * max(f1), 2)::DOUBLE AS max_f1,
  arg_max(score::DOUBLE, (round(f1, 12), -score)) AS threshold FROM f GROUP BY 1, 2, 3""")
def k4_evaluate_all(spark, sf_dir):
    """Every language and source in one job, null sources among them, with
    totals by language and of all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.nullif("source", F.lit("none")).alias("source"), F.expr("n_chars div 50").alias("score"))
    rows = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    out = M.evaluate(rows, ["lang", "source"], sets=[["lang"], []])
    return out.select("lang", "source", "level", rounded("auc", 6).alias("auc"), "max_f1", "threshold")


CHAIN = f"""WITH e AS (SELECT vec_id // 25 AS map_id, vec_id % 25 AS idx, (vec_id // 25) % 2 AS class, label, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT * FROM e WHERE map_id % 10 < 2), q AS (SELECT * FROM e WHERE map_id % 10 >= 2),
y(a, b) AS (VALUES (1, 32), (33, 64)),
d AS (SELECT q.class, q.map_id, q.idx, y.a, min((1 - list_cosine_similarity(q.v[y.a:y.b], g.v[y.a:y.b])) / 2) AS d FROM q JOIN g USING (class), y GROUP BY ALL),
v AS (SELECT class, map_id, idx, avg(d) AS score FROM d GROUP BY ALL),
m AS (SELECT class, list(z ORDER BY i) AS p, list(z ORDER BY i DESC) AS r FROM (SELECT class, i, avg(v[i]) AS z FROM g, range(1, 65) t(i) GROUP BY ALL) GROUP BY class),
i AS (SELECT class, map_id, list(z ORDER BY i) AS v FROM (SELECT class, map_id, i, avg(v[i]) AS z FROM q, range(1, 65) t(i) GROUP BY ALL) GROUP BY ALL),
s AS (SELECT class, map_id, idx, 1 / (1 + exp(10 * (list_cosine_similarity(v, p) - list_cosine_similarity(v, r)))) AS said FROM (SELECT class, map_id, idx, v FROM q UNION ALL SELECT class, map_id, -1, v FROM i) JOIN m USING (class)),
c AS (SELECT 'image' AS kind, class, map_id, idx // 5 AS y, idx % 5 AS x, score AS value FROM v UNION ALL SELECT 'cell', class, map_id, idx // 5, idx % 5, score * said / (score + said) FROM v JOIN s USING (class, map_id, idx)),
{taps_sql("tb", G.bilinear_taps(5, 10))}, {taps_sql("tg", G.gaussian_taps(10, 4.0))},
b AS (SELECT kind, class, map_id, ty.d AS y, tx.d AS x, sum(value * ty.w * tx.w) AS value FROM c JOIN tb ty ON ty.s = y JOIN tb tx ON tx.s = x GROUP BY ALL),
o AS (SELECT class, map_id, ty.d AS y, tx.d AS x, sum(value * ty.w * tx.w) AS value FROM b JOIN tg ty ON ty.s = y JOIN tg tx ON tx.s = x WHERE kind = 'cell' GROUP BY ALL),
h AS (SELECT class, map_id, max(value) AS top FROM b WHERE kind = 'image' GROUP BY ALL),
a AS (SELECT 'i_roc' AS kind, class, round(top * said / (top + said), 9) AS score, (map_id % 4 >= 2)::INT AS label FROM h JOIN s USING (class, map_id) WHERE idx = -1
  UNION ALL SELECT 'p_roc', o.class, round(value, 9), (e.label < 3)::INT FROM o JOIN e ON e.map_id = o.map_id AND e.idx = o.y // 2 * 5 + o.x // 2),
n AS (SELECT kind, class, score, sum(label) AS p, sum(1 - label) AS n FROM a GROUP BY ALL),
r AS (SELECT *, sum(p) OVER (PARTITION BY kind, class ORDER BY score DESC) AS tp FROM n),
f AS (SELECT kind, class, round(100.0 * sum(n * (tp - p / 2)) / nullif(sum(p) * sum(n), 0), 6)::DOUBLE AS auc FROM r GROUP BY ALL)
SELECT class, max(auc) FILTER (kind = 'i_roc') AS i_roc, max(auc) FILTER (kind = 'p_roc') AS p_roc FROM f GROUP BY class"""


@query(CHAIN)
def k4_run_chain(spark, sf_dir):
    """Vectors to metrics in one job: maps of 5 x 5 patches of two layers
    (halves of the vectors) in two classes; a fifth of the maps is the
    gallery, whose mean and its reverse stand for the texts."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 25").alias("map_id"), (F.col("vec_id") % 25).alias("idx"), F.expr("(vec_id div 25) % 2").alias("class"), F.col("label").alias("kind"), doubles(F.col("embedding")).alias("v"))
    e = e.withColumns({"upper": F.slice("v", 1, 32), "lower": F.slice("v", 33, 32)})
    shots, patches = e.where("map_id % 10 < 2"), e.where("map_id % 10 >= 2")
    texts = O.prototype(shots, ["class"], "v").select("class", F.col("v").alias("normal"), F.reverse("v").alias("abnormal"))
    images = O.prototype(patches, ["class", "map_id"], "v").withColumn("label", F.expr("cast(map_id % 4 >= 2 as int)"))
    half = F.explode(F.array(F.lit(0), F.lit(1)))
    masks = patches.where("kind < 3").withColumn("_y", half).withColumn("_x", half).select("map_id", F.expr("cast(idx div 5 * 2 + _y as int)").alias("y"), F.expr("cast(idx % 5 * 2 + _x as int)").alias("x"))
    out = chain.evaluate_runs(patches, images, shots, texts, masks, runs=["class"], layers=["upper", "lower"], vec="v", grid=(5, 5), to=(10, 10), t=10.0)
    return out.select("class", rounded("i_roc", 6).alias("i_roc"), rounded("p_roc", 6).alias("p_roc"))


@query("SELECT lang AS name, round(avg(n_chars) FILTER (source < 'src2'), 2)::DOUBLE AS i_roc, coalesce(round(avg(n_chars) FILTER (source = 'none'), 2), 0)::DOUBLE AS p_roc FROM documents GROUP BY lang")
def a15_metrics_table(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("source") < "src2", "i_roc").when(F.col("source") == "none", "p_roc")
    long = d.groupBy(F.col("lang").alias("name"), kind.alias("metric")).agg(rounded(F.avg("n_chars"), 2).alias("value"))
    return M.metrics_table(long, ["i_roc", "p_roc"])


FUSE = "WITH f AS (SELECT event_id, user_id, value AS a, (event_id % 7)::DOUBLE AS b FROM events) "


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("a"), (F.col("event_id") % 7).cast("double").alias("b"))


@query(FUSE + "SELECT event_id, round(CASE WHEN a + b = 0 THEN 0 ELSE a * b / (a + b) END, 6)::DOUBLE AS harmonic, round((a + b) / 2, 6) AS mean FROM f")
def f1_f2_fusion(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).select("event_id", rounded(harmonic(a, b), 6).alias("harmonic"), rounded(fuse_mean(a, b), 6).alias("mean"))


@query(FUSE + "SELECT user_id, max(a) AS score FROM f GROUP BY user_id")
def f3_max_pool(spark, sf_dir):
    return M.max_pool(_pairs(spark, sf_dir), ["user_id"], "a")


@query(FUSE + "SELECT event_id, round((a - min(a) OVER w) / nullif(max(a) OVER w - min(a) OVER w, 0), 6) AS scaled FROM f WINDOW w AS (PARTITION BY user_id)")
def f4_minmax(spark, sf_dir):
    return M.minmax(_pairs(spark, sf_dir), ["user_id"], "a").select("event_id", rounded("scaled", 6).alias("scaled"))


@query(FUSE + "SELECT event_id, trunc((a - min(a) OVER w) / nullif(max(a) OVER w, 0) * 255)::INT AS scaled FROM f WINDOW w AS (PARTITION BY user_id)")
def f5_scale_255(spark, sf_dir):
    return M.scale_255(_pairs(spark, sf_dir), ["user_id"], "a").select("event_id", "scaled")


@query(FUSE + "SELECT event_id, round_even(b / 2, 0)::DOUBLE AS level, printf('%.2f', b / 4) AS text FROM f")
def f6_f7_quantise_and_render(spark, sf_dir):
    return _pairs(spark, sf_dir).select("event_id", quantize(F.col("b"), 0.5).cast("double").alias("level"), render(F.col("b") / 4, 2).alias("text"))
