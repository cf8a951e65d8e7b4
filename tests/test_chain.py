import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnish.operators import chain, metrics, prepare, prompts, selection


@pytest.fixture(scope="module")
def tables(spark):
    """Two runs of one image set each; anomalous patches lie far from the gallery."""
    rng, rows, images, masks = np.random.default_rng(0), [], [], []
    for run in ("a", "b"):
        for m in range(6):
            bad = m % 2
            for i in range(16):
                odd = bad and i in (5, 6)
                v = [float(-odd or 1), *(rng.normal(0, 0.05, 3).tolist())]
                rows.append((run, m, i, v, v[::-1]))
                if odd:
                    masks += [(m, 2 * (i // 4) + dy, 2 * (i % 4) + dx) for dy in (0, 1) for dx in (0, 1)]
            images.append((run, m, [float(1 - 2 * bad), 0.1, 0.0, 0.0], bad))
    s = spark.createDataFrame
    return {
        "patches": s(rows, "run string, map_id long, idx int, v array<double>, w array<double>"),
        "images": s(images, "run string, map_id long, v array<double>, label int"),
        "gallery": s([(r, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]) for r in ("a", "b")], "run string, v array<double>, w array<double>"),
        "texts": s([(r, [1.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0]) for r in ("a", "b")], "run string, normal array<double>, abnormal array<double>"),
        "masks": s(masks, "map_id long, y int, x int"),
    }


OPTIONS = {"runs": ["run"], "layers": ["v", "w"], "vec": "v", "grid": (4, 4), "to": (8, 8), "sigma": 0.5, "t": 5.0}


def test_clear_anomalies_are_found(tables):
    rows = {r.run: r for r in chain.evaluate_runs(**tables, **OPTIONS).collect()}
    assert set(rows) == {"a", "b"}
    for r in rows.values():
        assert r.i_roc == 100 and r.p_roc > 95


def test_runs_without_gallery_and_empty_tables(spark, tables):
    some = tables | {"gallery": tables["gallery"].where("run = 'a'")}
    assert [r.run for r in chain.evaluate_runs(**some, **OPTIONS).collect()] == ["a"]
    assert chain.evaluate_runs(**(tables | {"patches": tables["patches"].where("false")}), **OPTIONS).count() == 0


def test_patches_need_every_layer(tables):
    first = (F.col("map_id") == 0) & (F.col("idx") == 0)
    p = tables["patches"].withColumn("w", F.when(~first, F.col("w")))
    got = chain.visual_scores(p, tables["gallery"], ["run"], ["v", "w"])
    assert got.count() == tables["patches"].count() - 2
    r = got.where("run = 'a' and map_id = 1 and idx = 5").first()
    v = np.array(tables["patches"].where("run = 'a' and map_id = 1 and idx = 5").first().v)
    assert r.score == pytest.approx((1 - v[0] / np.linalg.norm(v)) / 2)


def test_maps_without_smoothing_keep_constants(spark):
    s = spark.createDataFrame([("a", 1, i, 0.25) for i in range(4)], "run string, map_id long, idx int, score double")
    rows = chain.anomaly_maps(s, ["run"], (2, 2), (5, 3)).collect()
    assert len(rows) == 15 and all(r.value == pytest.approx(0.25) and r.map_id == 1 for r in rows)


def test_batches_equal_one_window(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("g"))
    got = selection.assign_batches(df, 64, 5, ["g"], "id")
    w = Window.partitionBy("g").orderBy(selection.seeded_order("id", 5), "id")
    want = df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / 64).cast("long"))
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    assert got.groupBy("g", "batch").count().where("count <> 64").count() == 3


def test_listed_shots_limit_rows_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("class"))
    shots = spark.createDataFrame([(0, 0, 7), (1, 0, 2), (1, 1, 90)], "class long, ord int, idx int")
    out = selection.select_shots(df, shots, "class", "id")
    assert sorted((r["class"], r.ord, r.id) for r in out.collect()) == [(0, 0, 14), (1, 0, 5)]
    near = selection.select_shots(df, shots.where("idx < 50"), "class", "id")
    assert "WindowGroupLimit" in near._jdf.queryExecution().toString()
    assert selection.select_shots(df, shots.where("false"), "class", "id").count() == 0


def test_bootstrap_follows_the_copies(spark):
    when = dt.datetime(2024, 1, 1, 0, 0, 0, 1)
    rows = [(1, when, {"k": 1.0})] * 6000 + [(i, when + dt.timedelta(microseconds=i), None) for i in range(2, 4002)]
    df = spark.createDataFrame(rows, "a int, t timestamp, m map<string,double>")
    drawn = metrics.bootstrap(df, 50_000, 11, parts=3)
    got = drawn.collect()
    assert len(got) == 50_000
    hot = sum(r.a == 1 for r in got)
    assert abs(hot - 30_000) < 600  # over five deviations
    assert all(r.m == ({"k": 1.0} if r.a == 1 else None) for r in got)
    counts = np.bincount([r.a for r in got if r.a > 1], minlength=4002)[2:]
    assert abs(counts.var() / counts.mean() - 1) < 0.2
    assert sorted(r.a for r in got) == sorted(r.a for r in metrics.bootstrap(df, 50_000, 11, parts=3).collect())


def test_classes_by_display_name(spark):
    df = spark.createDataFrame([("pcb3",), ("screw",), (None,), ("pcb3",)], "class string")
    named = prepare.display_name(df, prompts.aliases(spark), "class")
    assert sorted(map(tuple, named.collect()), key=repr) == sorted([("pcb3", "printed circuit board"), ("screw", "screw"), (None, None), ("pcb3", "printed circuit board")], key=repr)
    said = prompts.expand_prompts(named.distinct(), ["damaged {}"], spark.createDataFrame([("screw", "bent {}")], "class string, template string"))
    assert {r.prompt for r in said.collect() if r.prompt} == {"damaged printed circuit board", "damaged screw", "bent screw"}
