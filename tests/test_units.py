"""Operators against hand-made expectations."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnish.functions import vectors as V
from tarnish.operators import grids, metrics, prepare, prompts, regions, tuning
from tarnish.operators import vectors as O
from tarnish.sources import files, state
from tarnish.streaming import scoring


def cells(spark, rows, extra=""):
    return spark.createDataFrame(rows, "map_id int, y int, x int" + extra)


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(V.l2_normalize(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_harmonic_is_zero_with_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(V.harmonic(F.col("a"), F.col("b"))).collect()] == [0.0, 0.5, 0.0]


def test_auc_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 0), ("a", 0.0, 0), ("b", 1.0, 1)], "k string, score double, label int")
    got = {r["k"]: r["auc"] for r in metrics.roc_auc(df, ["k"]).collect()}
    assert got["a"] == pytest.approx(75.0) and got["b"] is None


def test_regions_join_diagonally_and_snake(spark):
    snake = [(0, 0, x) for x in range(9)] + [(0, 1, 8)] + [(0, 2, x) for x in range(9)] + [(0, 3, 0)] + [(0, 4, x) for x in range(9)]
    diagonal, apart = [(1, 0, 0), (1, 1, 1)], [(1, 0, 5), (1, 4, 5)]
    got = regions.region_props(cells(spark, snake + diagonal + apart)).collect()
    assert sorted((r["map_id"], r["area"]) for r in got) == [(0, 29), (1, 1), (1, 1), (1, 2)]


def test_hole_is_filled(spark):
    ring = [(0, y, x) for y in range(3) for x in range(3) if (y, x) != (1, 1)]
    got = regions.filled_regions(cells(spark, ring)).collect()
    assert len(got) == 9 and {r["area"] for r in got} == {8}


def test_pro_curve_counts_filled_over_area(spark):
    ring = [(0, y, x) for y in range(3) for x in range(3) if (y, x) != (1, 1)]
    score = [(0, y, x, float(10 if y < 3 and x < 3 else 0)) for y in range(5) for x in range(5)]
    c = cells(spark, score, ", score double")
    got = metrics.pro_curve(c, regions.filled_regions(cells(spark, ring)), steps=4).orderBy("step").collect()
    assert [r["pro"] for r in got] == [0.0, 9 / 8, 9 / 8, 9 / 8]


def test_region_f1_perfect(spark):
    c = cells(spark, [(0, y, x, float(y < 2 and x < 2), int(y < 2 and x < 2)) for y in range(4) for x in range(4)], ", score double, gt int")
    assert regions.region_f1(c, 5).first()["f1"] == 1.0


def test_gaussian_keeps_mass_and_bilinear_identity(spark):
    c = cells(spark, [(0, y, x, float(y * 3 + x)) for y in range(4) for x in range(3)], ", value double")
    assert grids.smooth_gaussian(c, (4, 3), 1.0).agg(F.sum("value")).first()[0] == pytest.approx(66.0)
    same = {(r["y"], r["x"]): r["value"] for r in grids.resize_bilinear(c, (4, 3), (4, 3)).collect()}
    assert all(v == pytest.approx(y * 3 + x) for (y, x), v in same.items())


def test_modulo_pairs(spark):
    got = [(r["normal"], r["abnormal"]) for r in prompts.learned_pairs(spark, 2, 4).orderBy("copy").collect()]
    assert got == [(i % 2, i % 4) for i in range(8)] and len(set(got)) == 4


def test_region_f1_adds_maps_in_a_task():
    """One row a step for all maps of a task, whatever batches cut them."""
    import pyarrow as pa

    cells = [(7, 0, 0, 1, 1), (7, 0, 1, 3, 1), (7, 5, 5, 3, 0), (None, 0, 0, 0, 0), (None, 4, 4, 5, 1)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("map_id", "y", "x", "step", "gt"), c, strict=True)) for c in cells])
    for cuts in ([0, 5], [0, 1, 2, 4, 5]):
        out = list(regions._matches(5, 0.6)(iter([batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)])))
        assert sum(x.num_rows for x in out) == 6
        rows = {x["t"]: (x["made"], x["matched"]) for b in out for x in b.to_pylist()}
        assert rows == {-1: (2, 0), 0: (1, 0), 1: (1, 0), 2: (0, 0), 3: (1, 2), 4: (0, 0)}  # over the joint box, two of three cells of the far region agree


def test_subwords(spark):
    words = spark.createDataFrame([(1, 0, "abab"), (1, 1, "b")], "k int, pos int, w string")
    merges = spark.createDataFrame([(0, "a", "b"), (1, "ab", "ab</w>"), (2, "a", "b</w>")], "rank int, first string, second string")
    vocab = spark.createDataFrame([(0, "ab"), (1, "ab</w>"), (2, "b</w>"), (3, "abab</w>")], "id int, token string")
    row = prepare.subword_encode(words, merges, vocab, "k", "w").first()
    assert row["ids"] == [3, 2]  # a b a b_ -> ab a b_ -> ab ab_ -> abab_


def test_subwords_of_lists(spark, monkeypatch):
    """A row's words meet no other row's: no shuffle, however common a word;
    odd rows and a full memo."""
    monkeypatch.setattr(prepare, "MEMO", 1)
    merges = spark.createDataFrame([(0, "a", "b"), (1, "ab", "ab</w>"), (2, "a", "b</w>")], "rank int, first string, second string")
    vocab = spark.createDataFrame([(0, "ab"), (1, "ab</w>"), (2, "b</w>"), (3, "abab</w>")], "id int, token string")
    rows = [(1, ["abab", "b", "abab"]), (2, None), (3, []), (4, ["", None, "x", "b"]), (1, ["b"])]
    out = prepare.subword_lists(spark.createDataFrame(rows, "k int, w array<string>"), merges, vocab, "w")
    assert [tuple(x) for x in out.collect()] == [(1, [3, 2, 3]), (2, []), (3, []), (4, [-1, 2]), (1, [2])]
    from tarnish.plans import registry

    plan = registry.QUERIES["p14_subword_encode"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_tuning_lowers_loss(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.normal(c, 0.3, 4).tolist(), c) for c in (0, 1) for _ in range(30)]
    df = spark.createDataFrame(rows, "vec array<double>, label int")
    _, losses = tuning.tune_prototypes(df, rng.normal(0, 0.1, (2, 4)), epochs=6, t=1.0, start=0.3)
    assert losses[-1] < losses[0]


def test_upsert(spark):
    frame = lambda rows: spark.createDataFrame(rows, "name string, auc double")
    got = state.upsert_metrics(frame([("a", 1.0), ("b", 2.0)]), frame([("b", 3.456)]), spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), ["auc"])
    assert {r["name"]: r["auc"] for r in got.collect()} == {"a": 1.0, "b": 3.46, "c": 0.0}


def png(path, pixels):
    raw = b"".join(b"\x00" + bytes(c for p in row for c in p) for row in pixels)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_image_catalog_and_pixels(spark, tmp_path):
    for p in ("cup/train/good/000.png", "cup/test/good/001.png", "cup/test/hole/002.png", "cup/ground_truth/hole/002_mask.png"):
        png(tmp_path / "data" / p, [[(255, 0, 0), (0, 255, 0)]])
    got = {r["stem"]: (r["split"], r["label"], r["mask_path"] is not None) for r in files.read_image_catalog(spark, str(tmp_path / "data")).collect()}
    assert got == {"000": ("train", 0, False), "001": ("test", 0, False), "002": ("test", 1, True)}
    pixels = files.read_images(spark, str(tmp_path / "data/cup/test/hole")).first()
    assert (pixels["width"], pixels["height"], bytes(pixels["data"])) == (2, 1, bytes([0, 0, 255, 0, 255, 0]))


def test_text_sources(spark, tmp_path):
    (tmp_path / "shots/cup").mkdir(parents=True)
    (tmp_path / "shots/cup/list.txt").write_text("#1: 263\n#2: 203 097")
    got = sorted((r["k"], r["ord"], r["idx"]) for r in files.read_shot_lists(spark, str(tmp_path / "shots")).collect())
    assert got == [(1, 0, 263), (2, 0, 203), (2, 1, 97)]
    (tmp_path / "m.csv").write_text("object,split,label,image,mask\na,test,normal,x.png,\n")
    assert files.read_split_manifest(spark, str(tmp_path / "m.csv")).first()["label"] == "normal"
    (tmp_path / "j").mkdir()
    (tmp_path / "j/good.json").write_text('{\n"a": 1,\n"b": 2}')
    (tmp_path / "j/bad.json").write_text('{"a": 1}')
    assert [r["name"] for r in files.read_json_catalog(spark, str(tmp_path / "j"), ["a", "b"]).collect()] == ["good"]


def test_state_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("d", "c", 1, [1.0])], "dataset string, class string, shot int, vec array<double>")
    state.save_state(df, df, str(tmp_path / "s"), ["dataset", "class", "shot"])
    g, p = state.load_state(spark, str(tmp_path / "s"))
    assert g.count() == p.count() == 1
    state.write_scores(df, str(tmp_path / "w"), ["class"])
    assert spark.read.parquet(str(tmp_path / "w")).first()["class"] == "c"


def test_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "m")
    frame = lambda rows: spark.createDataFrame(rows, "name string, auc double")
    classes = spark.createDataFrame([("a",), ("b",)], "name string")
    assert state.current(spark, path, "metrics") is None and state.versions(spark, path) == []
    assert state.upsert_metrics_table(spark, path, frame([("a", 1.0)]), classes, ["auc"]) == 1
    broken = frame([("b", 2.0)]).withColumn("auc", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        state.upsert_metrics_table(spark, path, broken, classes, ["auc"])
    assert state.versions(spark, path) == [1]
    assert {r["name"]: r["auc"] for r in state.current(spark, path, "metrics").collect()} == {"a": 1.0, "b": 0.0}
    assert state.upsert_metrics_table(spark, path, frame([("b", 2.0)]), classes, ["auc"]) == 3
    assert {r["name"]: r["auc"] for r in state.current(spark, path, "metrics").collect()} == {"a": 1.0, "b": 2.0}
    (tmp_path / "m/v00000004").mkdir()
    (tmp_path / "m/v00000004/_CLAIMED").write_text("")  # another writer is at work
    assert state.versions(spark, path) == [1, 3]
    with pytest.raises(FileNotFoundError):
        state.load_state(spark, str(tmp_path / "none"))


def test_pooler_in_sql(spark):
    scoring.register_sql_pooler(spark, "spread_of", lambda m: m.max(0) - m.min(0))
    spark.createDataFrame([(1, [1.0, 5.0]), (1, [4.0, 5.0]), (1, None), (2, None)], "k int, v array<double>").createOrReplaceTempView("pooled_rows")
    got = {r["k"]: r["p"] for r in spark.sql("SELECT k, spread_of(v) AS p FROM pooled_rows GROUP BY k").collect()}
    assert got == {1: [3.0, 0.0], 2: None} and scoring.pooler("spread_of")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(20)], "id int, label int, vec array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    gallery = O.build_gallery(rows.where("id < 4"), "label", "vec")
    batch = {r["id"]: r["score"] for r in scoring.score_stream(rows, gallery, "label", "vec").collect()}
    stream = scoring.score_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), gallery, "label", "vec")
    q = stream.writeStream.format("memory").queryName("scored").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["id"]: r["score"] for r in spark.table("scored").collect()} == batch


def test_registries():
    files.register_source("x", lambda: 1)
    scoring.register_pooler("first", lambda c: c[0])
    assert files.read_source("x") == 1 and scoring.pooler("first")([3]) == 3
    with pytest.raises(KeyError):
        files.read_source("absent")


def test_character_references(spark):
    import html
    import random

    r = random.Random(1)
    names = ["eacute;", "eacute", "notit;", "amp", "AMP;", "nosuch;", "copycat", "NotEqualTilde;", "#128512;", "#x1F600", "#0;", "#x80;", "#129;", "#xD800;", "#1114112;", "#99999999999999999999;", "#11;", "#xFFFE;", "#13;", "#39;", "#", "#x;", " lt;", "lt;gt;", "amp;lt;", "amp;#65;", "b.Gamma;"]
    texts = ["&" + n for n in names] + ["".join(r.choice(["&" + r.choice(names), "x", " ", "&", ";", "é"]) for _ in range(9)) for _ in range(300)] + ["", "plain", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: (x.u, x.c) for x in df.select("i", prepare.unescaped(F.col("t")).alias("u"), prepare.clean_text(F.col("t")).alias("c")).collect()}
    assert all(got[i][0] == (None if t is None else html.unescape(t)) for i, t in enumerate(texts))
    plain = [i for i, t in enumerate(texts) if t is not None and html.unescape(html.unescape(t)).isprintable()]
    assert len(plain) > 50 and all(got[i][1] == " ".join(html.unescape(html.unescape(texts[i])).split(" ")).strip(" ").lower() or "  " in html.unescape(html.unescape(texts[i])) for i in plain if "\u0130" not in texts[i])


def test_subwords_of_a_public_file(spark):
    """Equal to the library on its own pieces, long words among them."""
    import random

    from tokenizers import Tokenizer

    path = "/opt/tokenizers/word_bpe_49k.json"
    lib, r = Tokenizer.from_file(path), random.Random(2)
    words = ["hello", "antidisestablishmentarianism", "über", "日本語", "a" * 3000, "".join(r.choice("etaoinshr") for _ in range(5000)), *["".join(r.choice("abcdeiorstné") for _ in range(r.randint(1, 14))) for _ in range(400)]]
    merges, vocab = prepare.read_subword_tables(spark, path)
    df = spark.createDataFrame([(k, 0, w) for k, w in enumerate(words)], "k int, pos int, w string")
    got = {x.k: x.ids for x in prepare.subword_encode(df, merges, vocab, "k", "w", as_bytes=True).collect()}
    assert all(got[k] == lib.encode(w, add_special_tokens=False).ids for k, w in enumerate(words))
    assert sum(len(v) == 1 for v in got.values()) >= 2 and max(map(len, got.values())) > 1000


def test_standardize_and_back(spark):
    df = spark.createDataFrame([([0.0, 255.0, 100.0],)], "v array<double>")
    m, s = [0.5, 0.4, 0.3], [0.2, 0.3, 0.4]
    row = df.select(prepare.standardize(F.col("v"), m, s).alias("z")).select("z", prepare.destandardize(F.col("z"), m, s).alias("b"), prepare.destandardize(F.transform("z", lambda x: x * 9), m, s).alias("c")).first()
    assert row["z"] == pytest.approx([-2.5, 2.0, (100 / 255 - 0.3) / 0.4]) and all(abs(x - y) <= 1 for x, y in zip(row["b"], [0, 255, 100], strict=True))
    assert row["c"][0] == 0 and row["c"][1] == 255


def test_softmax_and_its_log(spark):
    df = spark.createDataFrame([([1.0, 2.0, 700.0],), ([0.5, 0.5],)], "v array<double>")
    rows = df.select(V.softmax(F.col("v")).alias("p"), V.log_sum_exp(F.col("v")).alias("l")).collect()
    assert rows[0]["p"] == pytest.approx([0, 0, 1]) and rows[0]["l"] == pytest.approx(700) and rows[1]["p"] == [0.5, 0.5]


def test_running_sums_over_blocks(spark):
    rng = np.random.default_rng(5)
    score = rng.normal(size=400).round(2)
    label = (rng.random(400) < 0.4).astype(int)
    rows = [("a", float(x), int(y)) for x, y in zip(score, label, strict=True)] + [("b", 1.0, 1), ("b", 1.0, 0), (None, float("inf"), 1), (None, 0.0, 0), (None, -float("inf"), 1)]
    df = spark.createDataFrame(rows, "k string, score double, label int")
    for blocks in (2, 7, 4096):
        got = metrics.running(df, ["k"], blocks=blocks).collect()
        for r in got:
            mine = [(s, y) for k, s, y in rows if k == r["k"]]
            assert r["tp"] == sum(y for s, y in mine if s >= r["score"]) and r["fp"] == sum(1 - y for s, y in mine if s >= r["score"])
            assert r["pos"] == sum(y for _, y in mine) and r["neg"] == len(mine) - r["pos"]
    few = metrics.roc_auc(df.where("k = 'a'"), ["k"], bins=2000).first()["auc"]
    assert few == pytest.approx(metrics.roc_auc(df.where("k = 'a'"), ["k"]).first()["auc"], abs=0.2)
    assert {r["k"] for r in metrics.evaluate(df.where("k is not null"), ["k"]).collect()} == {"a", "b"}


def test_percent_table_and_tags(spark):
    long = spark.createDataFrame([("x", "auc", 0.98765), ("y", "f1", 0.5)], "name string, metric string, value double")
    got = {r["name"]: (r["auc"], r["f1"]) for r in metrics.metrics_table(long, ["auc", "f1"], shares=True).collect()}
    assert got == {"x": (98.77, 0.0), "y": (0.0, 50.0)}
    tags = prepare.tag_catalog(spark.createDataFrame([("m", {"A-b": "1", "c": "2"}), ("n", {"a_b": "3"})], "model string, tags map<string,string>"))
    assert {r[0] for r in prepare.by_tag(tags, "A-B").collect()} == {"m", "n"} and {r[0] for r in prepare.by_model(tags, "m").collect()} == {"a_b", "c"}


def test_rate_schedule(spark):
    rates = [r["rate"] for r in tuning.lr_schedule(spark, "cosine", 10).orderBy("epoch").collect()]
    assert rates[0] == pytest.approx(0.002) and rates == sorted(rates, reverse=True) and rates[-1] > 1e-5
    assert [r["rate"] for r in tuning.lr_schedule(spark, "exponential", 3).orderBy("epoch").collect()] == pytest.approx([0.002, 0.0019, 0.001805])


def test_unsettled_regions_are_an_error(spark):
    snake = [(0, 0, x) for x in range(9)] + [(0, 1, 8)] + [(0, 2, x) for x in range(9)]
    with pytest.raises(RuntimeError):
        regions.label_runs(cells(spark, snake), rounds=1)


def test_completed_makes_each_missing_cell_once(spark):
    rows = [(0, 1, 1, 5.0), (0, 1, 1, 6.0), (0, 0, 2, None), (0, 2, 0, 9.0), (1, None, 0, 7.0), (1, -1, 2, 7.0), (None, 0, 0, 8.0)]
    c = spark.createDataFrame(rows, "map_id int, y int, x int, value double")
    got = sorted(grids.completed(c, (2, 3)).collect(), key=repr)
    grid = [(y, x) for y in range(2) for x in range(3)]
    want = [(0, *p, None) for p in grid if p != (1, 1)] + [(0, 1, 1, 5.0), (0, 1, 1, 6.0)] + [(m, *p, None) for m in (1, None) for p in grid]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["m11_overlay", "m6_pad", "a7_pro_curve", "a8_iou_curve"])
def test_cells_of_few_rows_are_not_broadcast(spark, name):
    """Cells exploded from few rows look small to the planner."""
    from tarnish.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_sweeps_hold_values_between_changes(spark):
    c = cells(spark, [(0, 0, 0, 4.0, 1), (0, 0, 1, 2.0, 0), (0, 0, 2, 0.0, 1), (1, 0, 0, 0.0, 1), (2, 0, 0, 3.0, 0)], ", score double, gt int")
    got = metrics.iou_curve(c, steps=4).orderBy("step").collect()
    # map 0: nothing, one of two marked cells, the same, and a wrong one; map 1 is never found
    assert [r["iou"] for r in got] == pytest.approx([0.0, 0.25, 0.25, 1 / 6]) and [r["iou_std"] for r in got] == pytest.approx([0.0, 0.25, 0.25, 1 / 6])


def test_overlay_of_tables_and_columns(spark):
    c = cells(spark, [(0, 0, 0, 4.0, 1), (0, 0, 1, 2.0, 0)], ", value double, gt int")
    got = [sorted(grids.overlay(c, *more).collect()) for more in ((F.col("value") * 2, F.col("gt")), (c.withColumn("value", F.col("value") * 2), c.withColumn("mask", F.col("gt"))))]
    assert got[0] == got[1] == [(0, 0, 0, 255.0), (0, 0, 1, 3.0)]


def test_rounded_is_that_of_sql(spark):
    """Also the sign of zero, and halves of the scaled double."""
    import duckdb

    values = [-1e-9, -0.0, 0.0, 1e-9, -0.4999996, 2.5e-6, -2.5e-6, 1.0000005, 0.1234565, -7.0000015, 1.005, 123456.7890125, None, float("inf"), *np.random.default_rng(5).normal(size=200).round(7).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["r"] for r in df.select("i", V.rounded("v", 6).alias("r")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in values]
    assert [str(x) for x in got] == [str(x) for x in want]


def test_hashed_encoder_counts_each_trigram():
    texts = ["", None, "ab", "abcabcabc", "na\u00efve \U0001f600\U0001f600\U0001f600 x", "word " * 300]
    turn = np.random.default_rng(3).standard_normal((1024, 8)).astype(np.float32)
    want = np.zeros((len(texts), 1024), dtype=np.float32)
    for i, t in enumerate(texts):
        for k in range(max(0, len(t or "") - 2)):
            want[i, zlib.crc32(t[k : k + 3].encode()) % 1024] += 1
    assert np.array_equal(scoring.hashed_encoder(8)()(texts), want @ turn)
