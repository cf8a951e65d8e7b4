"""Blocked vector operators and evaluation against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnish.operators import blocks, metrics
from tarnish.operators import vectors as O


def table(spark, v, **more):
    rows = [(i, None if x is None else [float(y) for y in x], *[c[i] for c in more.values()]) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "id long, v array<double>" + "".join(f", {k} int" for k in more))


def unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(150, 6)), rng.normal(size=(90, 6))
    b[5] = b[4]  # a tie
    a[7] = 0
    return a, b, rng.integers(0, 2, 150) * 3, (np.arange(90) > 60) * 3  # keys 0 and 3, most in 0


@pytest.mark.parametrize("rows", [7, 4096])
def test_pairs_and_nearest(spark, data, rows):
    a, b, ka, kb = data
    left = table(spark, [*a, None], k=[*ka.tolist(), 0]).withColumnsRenamed({"id": "p", "v": "va"})
    right = table(spark, [*b, None], k=[*kb.tolist(), 0]).withColumnsRenamed({"id": "q", "v": "vb"})
    got = {(r.p, r.q): r.similarity for r in blocks.pair_similarity(left, right, "p", "q", 2.0, rows=rows).collect()}
    assert len(got) == 150 * 90 and all(got[i, j] == pytest.approx(2 * a[i] @ b[j]) for i, j in [(0, 0), (149, 89), (7, 3), (80, 41)])
    d = ((1 - unit(a) @ unit(b).T) / 2).round(9)
    for k in (1, 3):
        rows_ = blocks.nearest(left, right, "p", "q", k, ["k"], rows=rows).collect()
        near = {(r.p, r.rank): r.q for r in rows_}
        assert len(rows_) == len(near) == 150 * k
        for i in range(150):
            own = sorted((d[i, j], j) for j in range(90) if kb[j] == ka[i])
            assert [near[i, r + 1] for r in range(k)] == [j for _, j in own[:k]]
    least = {(r.p, r.k): r.distance for r in blocks.nearest_in_groups(left.drop("k"), right, "p", "k", rows=rows).collect()}
    assert len(least) == 300 and all(least[i, k] == pytest.approx(d[i][kb == k].min(), abs=1e-8) for i in range(150) for k in (0, 3))


def test_nothing_meets_nothing(spark, data):
    a = table(spark, data[0], k=[None] * 150).withColumnsRenamed({"id": "p", "v": "va"})
    b = table(spark, data[1], k=[1] * 90).withColumnsRenamed({"id": "q", "v": "vb"})
    assert blocks.nearest(a, b, "p", "q", 1, ["k"]).count() == 0
    assert blocks.pair_similarity(a.where("false"), b, "p", "q").count() == 0
    assert blocks.nearest_in_groups(a, b.where("false"), "p", "k").count() == 0


def test_no_side_is_broadcast(spark, data):
    a = table(spark, data[0]).withColumnsRenamed({"id": "p", "v": "va"})
    b = table(spark, data[1]).withColumnsRenamed({"id": "q", "v": "vb"})
    plan = blocks.pair_similarity(a, b, "p", "q")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "hint" not in plan.lower()


def test_many_rows_without_common_key(spark):
    """20,000 x 20,000 in blocks; only the nearest row of each is returned."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20_000, 8))
    rows = table(spark, v)
    out = blocks.nearest(rows.withColumnsRenamed({"id": "p", "v": "va"}), rows.withColumnsRenamed({"id": "q", "v": "vb"}), "p", "q")
    assert out.where("p = q and abs(distance) < 1e-9 and rank = 1").count() == 20_000


def test_lsh_recall(spark):
    """Clustered vectors: nearly all nearest distances are found, and each
    row has one; a tight bound sends the rest to the exact search."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    a, b = (centres[rng.integers(0, 40, n)] + rng.normal(0, 0.12, (n, 24)) for n in (800, 1500))
    left, right = table(spark, a).withColumnsRenamed({"id": "p", "v": "va"}), table(spark, b).withColumnsRenamed({"id": "q", "v": "vb"})
    best = ((1 - unit(a) @ unit(b).T) / 2).min(1)
    got = {r.p: r for r in blocks.lsh_nearest(left, right, "p", "q", length=0.3, accept=0.05).collect()}
    assert len(got) == 800
    assert sum(abs(got[i].distance - best[i]) < 1e-9 for i in range(800)) >= 0.95 * 800
    assert sum(not r.exact for r in got.values()) > 700
    all_exact = blocks.lsh_nearest(left, right, "p", "q", length=0.3, accept=-1.0).collect()
    assert all(r.exact and r.distance == pytest.approx(best[r.p]) for r in all_exact) and len(all_exact) == 800


@pytest.mark.parametrize("rows", [10, 4096])
def test_attention_over_blocks(spark, monkeypatch, rows):
    rng = np.random.default_rng(4)
    v, group = rng.normal(size=(60, 5)) * 3, [0] * 45 + [1] * 15
    tokens = table(spark, v, g=group)
    queries = tokens.select("g", F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = {r.query_id: r.v for r in blocks.attend_blocks(tokens, queries, "g", "query_id", "q", "v", 0.7, rows).collect()}
    for i in range(60):
        own = v[np.array(group) == group[i]]
        e = np.exp(0.7 * own @ v[i] - (0.7 * own @ v[i]).max())
        assert got[i] == pytest.approx(list(e @ own / e.sum()))


def test_wide_tokens(spark):
    """An image of 225 tokens of width 896."""
    rng = np.random.default_rng(6)
    tokens = table(spark, rng.normal(size=(225, 896)), image=[1] * 225)
    out = O.self_smooth(tokens.withColumnsRenamed({"v": "vec"}), "image", "id", 2.0, normalized=True)
    assert out.count() == 225 and len(out.first()["vec"]) == 896


def test_group_sums_and_projection(spark, monkeypatch):
    v = np.arange(24, dtype=float).reshape(6, 4)
    df = table(spark, [*v, None], k=[0, 0, 1, 1, 1, 1, 2])
    got = {r.k: r.v for r in blocks.group_sums(df, ["k"], "v", "mean").collect()}
    assert got == {0: [2.0, 3.0, 4.0, 5.0], 1: [14.0, 15.0, 16.0, 17.0]}
    w = spark.createDataFrame([(0, 5, 1.0), (3, 5, 2.0), (1, 9, -1.0)], "i int, j int, w double")
    want = {(i, 5): x[0] + 2 * x[3] for i, x in enumerate(v)} | {(i, 9): -x[1] for i, x in enumerate(v)}
    for held in (10**6, 1):
        monkeypatch.setattr(O, "HELD_ENTRIES", held)
        assert {(r.id, r.j): r.x for r in O.project(df, w, "id", "v").collect() if r.x is not None} == want


def test_skewed_scores_spread_over_blocks(spark):
    """An outlier, and scores near 0 and 1, leave no block with most rows."""
    rng = np.random.default_rng(2)
    for score in (np.r_[rng.random(20_000), 1e9], 1 / (1 + np.exp(-rng.normal(0, 12, 20_000)))):
        df = spark.createDataFrame([(float(x),) for x in score], "score double").withColumn("_finite", F.col("score"))
        cuts = np.array(df.agg(metrics._cuts(32).alias("c")).first()["c"]).ravel()
        assert np.all(np.diff(cuts) >= 0) and np.bincount(np.searchsorted(cuts, np.unique(score))).max() <= 200


def test_evaluate_with_totals(spark):
    rng = np.random.default_rng(9)
    rows = [(str(k) if k else None, int(m), float(s), int(y)) for k, m, s, y in zip(rng.integers(0, 3, 500), rng.integers(0, 2, 500), rng.integers(0, 40, 500) / 7, rng.integers(0, 2, 500), strict=True)]
    df = spark.createDataFrame([*rows, ("x", 1, None, 1), ("x", 1, 2.0, 0)], "k string, m int, score double, label int")
    got = {(r.k, r.m, r.level): r for r in metrics.evaluate(df, ["k", "m"], sets=[["k"], []]).collect()}
    assert len(got) == 7 + 4 + 1

    def auc(mine):
        pos, neg = [s for s, y in mine if y], [s for s, y in mine if not y]
        return 100 * np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])

    def best(mine):
        f1 = {t: 2 * sum(y for s, y in mine if s >= t) / (sum(s >= t for s, _ in mine) + sum(y for _, y in mine)) for t in {s for s, _ in mine}}
        top = max(f1.values())
        return round(100 * top, 2), min(t for t, v in f1.items() if v > top - 1e-12)

    for (k, m, level), r in got.items():
        mine = [(s, y) for a, b, s, y in rows if (level & 2 or a == k) and (level & 1 or b == m)]
        if k != "x" and level != 3:
            assert r.auc == pytest.approx(auc(mine)) and (r.max_f1, r.threshold) == best(mine)


def test_bootstrap_draws_exactly_n(spark):
    df = spark.createDataFrame([(i % 50, "s") for i in range(200)], "a int, b string")
    for n in (1, 777, 5000):
        got = metrics.bootstrap(df, n, 3, parts=4)
        assert got.columns == ["a", "b"] and got.count() == n
    again = lambda seed: sorted(r.a for r in metrics.bootstrap(df, 5000, seed, parts=4).collect())
    assert again(3) == again(3) != again(4)
    counts = np.bincount(again(3), minlength=50)  # 100 each; chi-square of 49 degrees
    assert ((counts - 100) ** 2 / 100).sum() < 95
    assert metrics.bootstrap(df.where("false"), 10, 1).count() == 0


def test_products_are_taken_in_strips_of_bounded_size():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(1500, 4)), rng.normal(size=(3000, 4))
    parts = list(blocks._strips(x, y))
    assert max(p.size for p in parts) <= blocks.CELLS and np.allclose(np.concatenate(parts), x @ y.T)


def test_strips_are_small():
    """Products that are held at once have 2^17 cells at most, however large both blocks are."""
    x, y = np.random.default_rng(1).normal(size=(2, 4096, 8))
    sizes = [s.shape for s in blocks._strips(x, y)]
    assert sum(n for n, _ in sizes) == 4096 and all(m == 4096 and n * m <= 1 << 17 for n, m in sizes)


def test_pairs_leave_a_task_in_strips(spark, monkeypatch):
    """A task never holds all pairs of two blocks: what it returns comes in
    batches of ``CELLS`` pairs, or one row against a block, at most."""
    v = np.random.default_rng(5).normal(size=(300, 4))
    a, b = table(spark, v).withColumnsRenamed({"id": "p", "v": "va"}), table(spark, v).withColumnsRenamed({"id": "q", "v": "vb"})
    monkeypatch.setattr(blocks, "CELLS", 1000)
    seen, pairs = [], blocks.block_pairs

    def spy(left, right, keys, fold, schema, rows):
        def counted(x, y):
            out = fold(x, y)
            assert out.num_rows <= 1
            return out

        seen.append(1)
        return pairs(left, right, keys, counted, schema, rows)

    monkeypatch.setattr(blocks, "block_pairs", spy)
    got = {(r.p, r.q): r.similarity for r in blocks.pair_similarity(a, b, "p", "q").collect()}
    assert seen and len(got) == 300 * 300 and all(got[i, j] == pytest.approx(v[i] @ v[j]) for i, j in [(0, 0), (299, 1), (17, 240)])
