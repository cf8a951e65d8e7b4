"""Operators on small tables with nulls, empties, ties and repeated rows."""

import base64
import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnish.llm import ann, bpe, chosen_path, compact_windows, langid, merkle, packing, queries, suffix_tree, token_counts, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, repeated rows, a very long text, a clashing column."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(20_000))
    copy = " ".join(f"copy{i}" for i in range(80))
    rows = [(1, None, None), (2, "", "en"), (3, copy, "en"), (4, copy, "en"), (4, copy, "en"), (5, copy.replace("copy40", "other"), "en"), (6, long, "de"), (7, "12 !?", None), (8, " \n\t ", "en"), (9, "short one", "de"), (None, "no id", "en")]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    rel = con.sql(queries.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 16))
    v[7] = v[3]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (450, [1.0]), (None, [1.0] * 16), (3, [float(x) for x in v[3]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest_neighbours(df, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 300, 50))
    hits = 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        hits += len({x for x, _ in found} & set(np.argsort(-s, kind="stable")[:5].tolist()))
        assert len(found) == 5 and all(abs(s[x] - y) < 1e-12 for x, y in found)
    assert hits >= 0.9 * 30
    assert ann.nearest_neighbours(df.where("vec_id < 3")).count() == 2  # all candidates
    assert ann.nearest_neighbours(df.limit(0)).count() == 0


def test_neighbours_over_many_cells_chunks_and_parts(spark, monkeypatch):
    """Clustered vectors in cells of some hundred rows that are searched in
    chunks, against brute force."""
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 512)
    monkeypatch.setattr(ann, "PART_ROWS", 40)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 24))[rng.integers(0, 200, 20_000)] + rng.normal(0, 0.15, (20_000, 24))
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": v.tolist()}), "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.nearest_neighbours(df, 5, cell_rows=200).collect():
        got[r["query_id"]].add(r["vec_id"])
    unit, hits = v / np.linalg.norm(v, axis=1, keepdims=True), 0
    for q in range(0, 20_000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.95 * 5 * 400 and all(len(x) == 5 for x in got.values())


def test_neighbours_are_verified_within_the_radius_only():
    """Clustered rows and queries: at most three times the candidates that
    lie within each query's last radius are verified (or the first chunk)."""
    rng = np.random.default_rng(4)
    v = ann._unit(rng.normal(size=(64, 24))[rng.integers(0, 64, 8192)] + rng.normal(0, 0.2, (8192, 24)))
    p, quantile = v @ ann.projection(24, ann.M), ann.chi_square_quantile(ann.CONFIDENCE, ann.M)
    asked, k = np.arange(0, 8192, 64), 6
    tree = ann.LocalTree(p)
    best, dist, verified = tree.search(p[asked], v, v[asked], k, np.full(len(asked), np.inf), quantile)
    within, hits = 0, 0
    for i, q in enumerate(asked):
        inside = ((p - p[q]) ** 2).sum(1) <= dist[i, -1] * quantile * (1 + 1e-9)
        within += max(ann.FIRST, int(inside.sum()))
        true = 2 - 2 * v @ v[q]
        want = np.sort(true[inside])[:k]  # exact among those within the radius
        assert np.allclose(dist[i], want, atol=1e-12) and np.allclose(true[best[i]], dist[i], atol=1e-12)
        hits += len(set(best[i].tolist()) & set(np.argsort(true, kind="stable")[:k].tolist()))
    assert verified.sum() <= 3 * within < len(asked) * 8192
    assert hits >= 0.95 * k * len(asked)
    again = tree.search(p[asked], v, v[asked], k, dist[:, -1], quantile)[2]  # a radius from elsewhere
    assert again.sum() <= within


def test_neighbours_of_very_large_and_small_vectors(spark):
    v = [[1e200, 0.0], [1e200, 1e190], [3e-200, 3e-200], [0.0, 5e-324], [1.7e308, -1.7e308]]
    df = spark.createDataFrame([(50 * i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest_neighbours(df).collect()}
    half = 0.5**0.5
    assert len(got) == 20
    for pair, want in {(0, 50): 1.0, (0, 100): half, (0, 150): 0.0, (100, 150): half, (100, 200): 0.0, (0, 200): half, (150, 200): -half}.items():
        assert abs(got[pair] - want) < 1e-12 and got[pair] == got[pair[::-1]]


def test_warc(spark):
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "é"), (5, "u", "é" * 100_000), (2, None, "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [tuple(r) for r in warc.round_trip(df).collect()]
    want = collections.Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        top = max((j for j, _, g in rows if (g or "").encode() == p and j is not None), default=None)
        kind = "response" if top is None or i == top else "revisit"
        want[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), kind, top if kind == "revisit" else None)] += 1
    assert collections.Counter(got) == want
    assert warc.round_trip(df.limit(0)).count() == 0
    path = warc.scratch_path(spark, "t")
    warc.write_warc(warc.with_revisits(df), path)
    assert warc.read_warc(spark, path).where("record_type = 'revisit'").count() == 2
    assert warc.read_warc(spark, path, "none").where("record_id = 'urn:page:5'").first()["payload"] is None
    assert bytes(warc.read_warc(spark, path).where("record_id = 'urn:page:5'").first()["payload"]).decode() == "é" * 100_000


class Counting(warc.WarcReader):
    decoded = 0

    def finish(self, row, block, head):
        self.decoded += block is not None
        return super().finish(row, block, head)


def found(path, *filters, **options):
    reader = Counting({"path": str(path), **options})
    left = list(reader.pushFilters(list(filters)))
    rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    return rows, reader.decoded, left


@pytest.mark.parametrize("kind", ["lengths", "plain", "one member", "members"])
def test_warc_filters_decode_wanted_payloads_only(tmp_path, kind):
    import gzip

    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    row = lambda i: {"record_type": "revisit" if i % 3 == 2 else "response", "record_id": f"urn:page:{i}", "target_uri": f"http://{'ab'[i % 2]}/{i}", "warc_date": "2024-01-01T00:00:00Z", "payload_digest": "X", "refers_to": "urn:page:0", "payload_bytes": 9000 + i, "payload": bytes([65 + i]) * (9000 + i)}
    records = [warc.record_bytes(row(i)) for i in range(9)]
    pack = {"lengths": lambda: b"".join(map(warc.gzip_member, records)), "plain": lambda: b"".join(records), "one member": lambda: gzip.compress(b"".join(records)), "members": lambda: b"".join(map(gzip.compress, records))}[kind]()
    name = "x.warc" if kind == "plain" else "x.warc.gz"
    (tmp_path / name).write_bytes(pack)
    rows, decoded, left = found(tmp_path)
    assert [r["record_id"] for r in rows] == [f"urn:page:{i}" for i in range(9)] and decoded == 9 and not left
    assert all(r["payload"] == (None if i % 3 == 2 else bytes([65 + i]) * (9000 + i)) and r["payload_bytes"] == 9000 + i for i, r in enumerate(rows))
    rows, decoded, left = found(tmp_path, EqualTo(("record_type",), "response"), StringStartsWith(("target_uri",), "http://a"), GreaterThan(("payload_bytes",), 1))
    assert [r["record_id"][-1] for r in rows] == ["0", "4", "6"] and decoded == 3 and len(left) == 1
    rows, decoded, _ = found(tmp_path, In(("record_id",), ("urn:page:1", "urn:page:8")), payload="none")
    assert [r["payload_bytes"] for r in rows] == [9001, 9008] and decoded == 0
    (tmp_path / name).write_bytes(pack[:-2000] if kind == "plain" else pack[:-30])
    with pytest.raises((ValueError, EOFError)):
        found(tmp_path)


def test_merkle(spark, odd, empty):
    rows = merkle.fingerprints_of_edits(odd).collect()
    assert len(rows) == 11 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    order = {(r["i"], r["text"]): r["h"] % 2**64 for r in odd.select(F.coalesce("doc_id", F.lit(-1)).alias("i"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()}
    texts = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in odd.collect()), key=lambda x: (x[0], order[x]))
    want = collections.Counter()
    for k, (i, t) in enumerate(texts):
        nxt, half = texts[(k + 1) % len(texts)][1], len(t) // 2
        want[(i, hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"] if r["doc_id"] is not None else -1, r["edited_sha256"]) for r in rows) == want
    assert merkle.fingerprints_of_edits(empty).count() == 0


def test_edits_are_located(spark):
    """An inserted paragraph leaves the others alone, an inserted word the
    pieces around it."""
    line = " ".join(f"word{i}e" for i in range(200))
    df = spark.createDataFrame([("a\nb\n\nc\nd", "a\nnew\nb\n\nc\nd", line, "first " + line)], "a string, b string, c string, d string")
    f = {c: merkle.fingerprint(F.col(c)) for c in "abcd"}
    got = df.select(merkle.edit_places(f["b"], f["a"]).alias("there"), merkle.edit_places(f["a"], f["b"]).alias("none"), merkle.likeness(f["a"], f["b"]).alias("ab"), merkle.likeness(f["c"], f["d"]).alias("cd"), merkle.likeness(f["a"], f["a"]).alias("aa")).first()
    assert [tuple(x) for x in got["there"]] == [(0, 1)] and got["none"] == [] and got["aa"] == 1
    assert got["ab"] == pytest.approx(1 - 1 / 9) and got["cd"] > 0.95


def test_tree_of_hashes(spark, odd):
    """Each node's hash follows from its children, as computed here; a changed
    node shows, and the first change is found from the root down."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in odd.select(F.coalesce("text", F.lit("")).alias("t"), merkle.fingerprint(F.col("text")).alias("f")).where(F.length("t") < 10**5).collect():
        nodes = [[sha(p)[:32] for p in s.split("\n")] for s in r["t"].split("\n\n")]
        upper = [sha("".join(n))[:32] for n in nodes]
        root, tree = r["f"].split(":")
        assert root == sha("".join(upper)) and [s.split("=")[0] for s in tree.split(";")] == upper
        assert [[p.split(".")[0] for p in s.split("=")[1].split(",")] for s in tree.split(";")] == nodes
    assert odd.where(merkle.sound(merkle.fingerprint(F.col("text")))).count() == odd.count()
    cases = [("a\nb\n\nc\nd", "a\nb\n\nc\nx", "1.1"), ("a\nb\n\nc", "a\nb", "1.0"), ("a", "a\nb", "0.1"), ("a\n\nb\n\nc", "a\n\nnew\n\nb\n\nc", "1.0"), ("a", "a", None), ("", "a", "0.0"), ("p\n" * 5000, "p\n" * 4000 + "q\n" * 1000, "0.4000"), ("s\n\n" * 5000, "s\n\n" * 4000 + "q\n\n" * 1000, "4000.0")]
    df = spark.createDataFrame(cases, "a string, b string, want string").select("want", *(merkle.fingerprint(F.col(c)).alias(c) for c in "ab"))
    assert df.where(~merkle.first_change(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0
    assert df.where(~merkle.first_change(F.col("b"), F.col("a")).eqNullSafe(F.col("want"))).count() == 0
    f = F.col("a")
    assert df.where(merkle.sound(F.regexp_replace(f, "=[0-9a-f]", "=x"))).isEmpty() and df.where(merkle.sound(F.regexp_replace(f, "^[0-9a-f]", "x"))).isEmpty()


@pytest.mark.parametrize("ids", [lambda i: 7, lambda i: None, lambda i: i**3, lambda i: (i % 5) * 10**9 + i])
def test_next_text_over_many_runs(spark, monkeypatch, ids):
    monkeypatch.setattr(merkle, "RUN_ROWS", 4)
    df = spark.createDataFrame([(ids(i), f"text {i}") for i in range(300)], "doc_id long, text string")
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows.sort(key=lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["h"] % 2**64))
    want = {r["text"]: rows[(k + 1) % len(rows)]["text"] for k, r in enumerate(rows)}
    assert {r["text"]: r["next_text"] for r in merkle.with_next(df).collect()} == want
    largest = merkle.with_runs(df.withColumn("hash", F.xxhash64("text"))).groupBy("run").count().agg(F.max("count")).first()[0]
    assert largest <= 20


def test_join(odd, empty):
    got = collections.Counter(tuple(r) for r in chosen_path.similar_texts(odd).collect())
    want = collections.Counter([(1, 1, 0), (2, 2, 0), (3, 3, 3), (4, 3, 3), (4, 3, 3), (5, 3, 3), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0), (None, None, 0)])
    assert got == want  # 71 of 81 shingles are shared
    assert chosen_path.similar_texts(empty).count() == 0
    assert sorted((r["doc_id"] or 0) for r in chosen_path.keep_one(odd).collect()) == [0, 1, 2, 3, 6, 7, 8, 9]


def test_passages(spark, odd, empty):
    got = {(r["doc_id"], r["source_doc_id"]): (r["start_word"], r["end_word"]) for r in compact_windows.duplicate_passages(odd).collect()}
    assert got[(4, 3)] == (0, 80) and got[(5, 3)] == (0, 80)
    assert compact_windows.duplicate_passages(empty).count() == 0
    kept = {r["doc_id"]: r["text"] for r in compact_windows.without_repeats(odd).collect()}
    assert 4 not in kept and 3 in kept and 1 in kept and None in kept


def test_join_of_rows_that_share_an_id(spark):
    copy = " ".join(f"copy{i}" for i in range(80))
    rows = [(4, "one text of its own", 1), (4, "quite another one here", 2), (None, copy, 3), (5, copy + " x", 4), (4, "one text of its own", 5), (6, "a\u00a0b\u3000c d e f", 6), (7, "a b c d e f", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc int")
    got = sorted(tuple(r) for r in chosen_path.similar_texts(df).select(*[F.coalesce(c, F.lit(-1)) for c in ("doc_id", "class_id", "n_links")]).collect())
    assert got == [(-1, 5, 1), (4, 4, 0), (4, 4, 1), (4, 4, 1), (5, 5, 1), (6, 6, 0), (7, 7, 0)]
    kept = sorted(r["text"] for r in chosen_path.keep_one(df).collect())
    assert kept == sorted([rows[0][1], rows[1][1], rows[3][1], rows[5][1], rows[6][1]])


def edited(words, at, tag):
    return [f"{tag}{i}" if i in at else w for i, w in enumerate(words)]


def test_passages_behind_a_similar_document(spark):
    """An earlier document that holds an unlike version, or a part, hides no exact repeat."""
    rows, want = [], {}
    for n in range(40):
        v2 = [f"p{n}w{i}" for i in range(50)]
        v1 = edited(v2, {12, 30} if n % 2 else set(range(20)), f"e{n}x")  # 36 and 26 of 46 shingles
        fill = lambda tag, n=n: [f"{tag}{n}f{i}" for i in range(60)]
        rows += [(3 * n, " ".join(fill("a") + v1)), (3 * n + 1, " ".join(fill("b") + v2)), (3 * n + 2, " ".join(v2 + fill("c")))]
        want[3 * n + 2] = 3 * n + 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["source_doc_id"]): (r["start_word"], r["end_word"]) for r in compact_windows.duplicate_passages(df).collect()}
    assert all(got.get(pair) == (0, 50) for pair in want.items())


def brute_force_places(docs):
    """Places of each document in a passage of each smaller one: (doc, source) -> set."""
    items, where, out = {i: compact_windows.shingle_sequence(t) for i, t in docs}, collections.defaultdict(set), {}
    for i, s in items.items():
        for x in set(s.tolist()):
            where[x].add(i)
    for i, s in items.items():
        shared = collections.Counter(j for x in set(s.tolist()) for j in where[x] if j < i)
        for j, n in shared.items():
            spans = compact_windows.repeated_spans(s, items[j], 46, 0.8) if n >= 36 else []
            if spans:
                out[i, j] = {p for a, b, _ in spans for p in range(a, b + 1)}
    return out


def test_near_passages_equal_brute_force(spark):
    """Passages of one window at the threshold: a word is edited, so that 41
    of 46 shingles recur (likeness 41 / 51)."""
    rows = []
    for n in range(400):
        p = [f"p{n}w{i}" for i in range(50)]
        fill = lambda tag, n=n: [f"{tag}{n}f{i}" for i in range(60)]
        rows += [(2 * n, " ".join(fill("a") + p + fill("b"))), (2 * n + 1, " ".join(fill("c") + edited(p, {24}, f"e{n}x") + fill("d")))]
    want = brute_force_places(rows)
    near = [pair for pair, places in want.items() if len(places) >= 46]
    got = collections.defaultdict(set)
    for r in compact_windows.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"], r["source_doc_id"]] |= set(range(r["start_word"], r["end_word"] - 4))
    assert len(near) == 400 and all(got[pair] >= want[pair] for pair in near)
    assert all(got[pair] <= want[pair] for pair in got)


def test_passages_behind_their_own_parts(spark):
    """Earlier documents hold both halves of a passage, or a line of it, that
    unlike documents have as well."""
    rows, pairs = [], []
    for n in range(60):
        line = [f"line{n % 3}w{i}" for i in range((30, 36, 40)[n % 3])]
        half = [[f"h{k}n{n}w{i}" for i in range(35)] for k in (0, 1)]
        fill = lambda tag, n=n: [f"{tag}{n}f{i}" for i in range(60)]
        lined = [f"q{n}w{i}" for i in range(20)] + line + [f"r{n}w{i}" for i in range(20)]
        earlier = (fill("a") + half[0] + fill("b"), fill("c") + half[1], fill("d") + line + fill("e"))
        rows += [(10 * n + k, " ".join(x)) for k, x in enumerate(earlier)]
        rows += [(10 * n + 3 + k, " ".join(fill(f"p{k}") + half[0] + half[1] + fill(f"s{k}"))) for k in (0, 1)]
        rows += [(10 * n + 5 + k, " ".join(fill(f"t{k}") + lined + fill(f"u{k}"))) for k in (0, 1)]
        pairs += [((10 * n + 4, 10 * n + 3), 70), ((10 * n + 6, 10 * n + 5), 40 + len(line))]
    got = collections.defaultdict(set)
    for r in compact_windows.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"], r["source_doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert sum(got[pair] == set(range(60, 60 + n)) for pair, n in pairs) == len(pairs)


@pytest.mark.parametrize("between", [False, True])
def test_passages_behind_their_sentences(spark, between):
    """Three sentences stand alone in other documents, before both documents
    that have them in a row or between the two; the later one of these has a
    word between sentences."""
    rows, pairs = [], []
    for n in range(60):
        lines = [[f"s{n}x{k}w{i}" for i in range(40)] for k in range(3)]
        fill = lambda tag, n=n: [f"{tag}{n}f{i}" for i in range(50)]
        alone = [fill(f"a{k}") + x + fill(f"b{k}") if n % 2 else x for k, x in enumerate(lines)]
        one = lines[0] + lines[1] + lines[2]
        two = fill("c") + lines[0] + [f"new{n}"] + lines[1] + [f"more{n}"] + lines[2] + fill("d")
        order = [one, *alone, two] if between else [*alone, one, two]
        rows += [(10 * n + k, " ".join(x)) for k, x in enumerate(order)]
        pairs.append((10 * n + 4, 10 * n + (0 if between else 3)))
    got = collections.defaultdict(set)
    for r in compact_windows.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"], r["source_doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert sum(len(got[pair]) >= 115 for pair in pairs) >= 0.95 * len(pairs)


def test_passages_behind_many_parts(spark):
    """Each sentence of a passage stands alone in more documents between its
    two than a window is linked to."""
    rows, pairs = [], []
    for n in range(20):
        lines = [[f"s{n}x{k}w{i}" for i in range(40)] for k in range(3)]
        fill = lambda tag, n=n: [f"{tag}{n}f{i}" for i in range(50)]
        alone = [fill(f"a{k}t{t}") + x + fill(f"b{k}t{t}") for t in range(compact_windows.BACK + 2) for k, x in enumerate(lines)]
        two = fill("c") + lines[0] + [f"new{n}"] + lines[1] + [f"more{n}"] + lines[2] + fill("d")
        rows += [(100 * n + k, " ".join(x)) for k, x in enumerate([lines[0] + lines[1] + lines[2], *alone, two])]
        pairs.append((100 * n + len(alone) + 1, 100 * n))
    got = collections.defaultdict(set)
    for r in compact_windows.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"], r["source_doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert {*got} == {*pairs} and all(len(got[pair]) >= 115 for pair in pairs)


@pytest.mark.parametrize(("missing", "last"), [(0, 0), (0, 2), (1, 3), (9, 10)])
def test_rarest_places_equal_brute_force(missing, last):
    r = np.random.default_rng(missing)
    order, text = r.integers(0, 40, 300).astype(np.uint64), np.repeat([0, -1, 1, 2], [120, 4, 9, 167])
    want = set()
    for i in range(len(order) - 11):
        if text[i] >= 0 and text[i] == text[i + 11]:
            part = order[i : i + 12]
            want |= {i + k for k, x in enumerate(part.tolist()) if x and (part < x).sum() <= last and (part == 0).sum() <= missing}
    assert set(compact_windows.rarest(order, text, 12, missing, last).tolist()) == want


def largest_likeness(x, y, least=46):
    """By the definition: over all subsequences of ``least`` shingles or more
    of ``x``, and all of ``y``, the largest Jaccard similarity of their sets."""
    x, y = ([" ".join(v[i : i + 5]) for i in range(len(v) - 4)] for v in (x.split(), y.split()))
    best = 0.0
    for i in range(len(x) - least + 1):
        for j in range(i + least, len(x) + 1):
            mine = set(x[i:j])
            for a in range(len(y)):
                seen, both = set(), 0
                for b in range(a, min(len(y), a + 2 * (j - i))):
                    if y[b] not in seen:
                        seen.add(y[b])
                        both += y[b] in mine
                    best = max(best, both / (len(mine) + len(seen) - both))
    return best


def test_passages_equal_their_definition(spark):
    """Each pair of small documents has a passage if and only if some pair of
    subsequences is at the threshold."""
    r, rows = random.Random(7), []
    for n in range(16):
        p = [f"p{n}w{i}" for i in range(54)]
        at = {0: set(), 1: {20}, 2: {26}, 3: {10, 40}, 4: {5, 20, 33, 45}}[n % 5]
        q = [w for i, x in enumerate(p) for w in (([f"e{n}v{i}"] if r.random() < 0.5 else [x, f"e{n}v{i}"]) if i in at else [x])]
        rows += [(2 * n, " ".join([f"a{n}", *p, f"b{n}"])), (2 * n + 1, " ".join([f"c{n}", *q, f"d{n}"]))]
    want = {(2 * n + 1, 2 * n): largest_likeness(rows[2 * n + 1][1], rows[2 * n][1]) for n in range(16)}
    got = {(x["doc_id"], x["source_doc_id"]) for x in compact_windows.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {pair for pair, like in want.items() if like >= 0.8} and 4 < len(got) < 16


def test_passages_that_stick_out_of_others(spark):
    """A source whose passage goes a few words beyond one found is found too."""
    rows = []
    for n in range(40):
        p = [f"p{n}w{i}" for i in range(83)]
        fill = lambda tag, n=n: [f"{tag}{n}f{i}" for i in range(60)]
        rows += [(3 * n, " ".join(fill("a") + p[:80] + fill("b"))), (3 * n + 1, " ".join(fill("c") + p[5:] + fill("d"))), (3 * n + 2, " ".join(p + fill("e")))]
    got = {tuple(r)[:4] for r in compact_windows.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all({(3 * n + 2, 0, 80, 3 * n), (3 * n + 2, 5, 83, 3 * n + 1)} <= got for n in range(40))


def test_sources_without_new_passages_are_not_verified(monkeypatch):
    """Of 50 sources of one passage one is verified, and those beyond it."""
    words = [f"w{i}" for i in range(200)]
    mine = compact_windows.shingle_sequence(" ".join(words))
    part = lambda a, b, k: compact_windows.shingle_sequence(" ".join([f"x{k}", *words[a:b], f"y{k}"]))
    calls, real = [], compact_windows.repeated_spans
    monkeypatch.setattr(compact_windows, "repeated_spans", lambda *x: calls.append(1) or real(*x))
    got = compact_windows.new_passages(mine, [(k, 0, 150, part(10, 90, k)) for k in range(50)] + [(77, 0, 150, part(40, 95, 77)), (78, 0, 150, part(120, 190, 78))], {(120, 195)}, 46, 0.8)
    assert [x[:3] for x in got] == [(10, 90, 0), (40, 95, 77)] and len(calls) == 2


def test_tables_leave_no_shuffle_files(spark):
    """What was shuffled for a written table goes when it is there, so a
    query's disk is that of its largest step."""
    from pathlib import Path

    from tarnish.llm.common import written

    dirs = [Path(p) for p in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {p for d in dirs for p in d.rglob("shuffle_*")}
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts").count() == 100
    assert not {p for p in files() - before if p.suffix == ".data" and p.stat().st_size > 1000} and spark.conf.get(key) == "false"


def test_tables_are_made_of_small_batches(spark):
    """A Python worker that makes a table gets 8 MB or little more at a time."""
    from tarnish.llm.common import written

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was, rows = spark.conf.get(key), spark.range(6000, numPartitions=1).select(F.repeat(F.lit("x"), 8000).alias("text"))
    assert written(rows.mapInArrow(sizes, "n long"), "sizes").agg(F.max("n")).first()[0] < 10 << 20 and spark.conf.get(key) == was


def test_long_chains_are_closed_over_ranges(spark):
    """One passage in 400 documents, over many partitions: all but the first find it."""
    p = " ".join(f"common{i}" for i in range(60))
    df = spark.createDataFrame([(k, f"x{k} y{k} {p} z{k}", k) for k in range(400)], "doc_id long, text string, _doc int").repartition(16)
    was = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        got = {r["doc_id"] for r in compact_windows.duplicate_passages(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was[0])
        spark.conf.set("spark.sql.shuffle.partitions", was[1])
    assert got == set(range(1, 400))


def test_passages_beside_clashing_columns(spark):
    p = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, p, 1, 2, 3, "s"), (1, "a " + p, 1, 2, 3, "s"), (None, p, 1, 2, 3, "s")], "doc_id long, text string, _doc int, _no int, _id int, _sha string")
    assert compact_windows.duplicate_passages(df).count() == 2


def test_passages_of_rows_that_share_an_id(spark):
    copy = " ".join(f"copy{i}" for i in range(80))
    rows = [(4, copy + " end", 1, "x"), (4, None, 2, "x"), (4, "a " + copy, 3, "x"), (None, copy, 4, "x"), (4, "a " + copy, 5, "x"), (5, "", 6, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _spans int, end_word string")
    found = [tuple(r)[:4] for r in compact_windows.duplicate_passages(df).collect()]
    assert len(found) == 2 and {r[0] for r in found} == {4, None} and all(r[2] - r[1] == 80 and r[3] == 4 for r in found)
    kept = sorted((r["_spans"], r["text"]) for r in compact_windows.without_repeats(df).collect())
    assert kept in ([(1, copy + " end"), (2, None), (3, "a"), (5, "a"), (6, "")], [(1, " end"), (2, None), (3, "a " + copy), (5, "a " + copy), (6, "")])


def test_stages_equal_brute_force(spark, documents):
    import corpus_pipeline

    docs = documents.limit(200).localCheckpoint()
    model = langid.fit(docs)
    known = sorted(r["doc_id"] for r in docs.collect() if not model.predict(r["text"])[2])
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, DATA).collect()) == known
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    covered = collections.defaultdict(set)
    for (i, _), places in brute_force_places(rows.items()).items():
        covered[i] |= {w for p in places for w in range(p, p + 5)}
    kept = {r["doc_id"]: r["text"] or "" for r in corpus_pipeline.repeated_passages(spark, docs, DATA).collect()}
    gone = {i: len((t or "").split()) - len(kept.get(i, "").split()) for i, t in rows.items()}
    assert sum(gone.values()) >= 0.98 * sum(map(len, covered.values())) > 0
    # cut elsewhere than whole documents suggest, a passage must still be at the threshold
    for r in compact_windows.duplicate_passages(docs).collect():
        mine, other = (compact_windows.shingle_sequence(rows[i]) for i in (r["doc_id"], r["source_doc_id"]))
        assert r["source_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50
        assert compact_windows.best_likeness(np.unique(mine[r["start_word"] : r["end_word"] - 4]), other, 0.8) >= 0.8
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert all(n <= len(covered[i]) for i, n in gone.items())


def test_scores(odd, empty, documents):
    for df in (odd, documents):
        rows = df.collect()
        held = [zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 if r["doc_id"] is not None else False for r in rows]
        tokens = [[*(r["text"] or "").encode().lower().split(), None] for r in rows]
        c = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
        n, v = sum(c.values()), len(c)
        want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, h, len(t), sum(c[w] > 0 for w in t), n) for r, h, t in zip(rows, held, tokens, strict=True))
        got = suffix_tree.score(df).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == want
        base = collections.defaultdict(float)
        for r, t in zip(rows, tokens, strict=True):
            base[r["doc_id"]] = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert all(r["base_score"] == pytest.approx(base[r["doc_id"]]) for r in got)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    assert suffix_tree.score(empty).count() == 0


def brute_force_score(train, text, depth=2):
    """The model by its definition, for an exact tree of ``depth`` (1 or 2) levels."""
    seqs = [[*t.lower().split(), None] for t in train]
    c = collections.Counter(w for s in seqs for w in s)
    n, v = sum(c.values()), len(c)
    after = [collections.Counter(), collections.Counter()]
    for s in seqs:
        for i, w in enumerate(s):
            if i:
                after[0][s[i - 1], w] += 1
            if i > 1:
                after[1][s[i - 2], s[i - 1], w] += 1
    root = lambda w: (c[w] + 1) / (n + v + 1)
    model = {}

    def p(context, w):
        while context and context not in model:
            context = context[1:]
        if not context:
            return root(w)
        listed, rest = model[context]
        return listed[w] if w in listed else rest * p(context[1:], w)

    for d, pairs in enumerate(after[:depth]):
        size = collections.Counter()
        for k in c:
            size[(k,)] = c[k]
        if d:
            size = collections.Counter({k: m for k, m in after[0].items() if m >= 2 and k[1] is not None and (k[0],) in size})
        fresh = {}
        for context, total in size.items():
            got = {k[-1]: m for k, m in pairs.items() if k[:-1] == context and m >= 2}
            if context[-1] is None or context[0] is None:
                continue
            listed = {w: (m - suffix_tree.DISCOUNT) / total for w, m in got.items()}
            mass = 1 - sum(listed.values())
            below = {w: p(context[1:], w) for w in got}
            rest = max(mass, 1e-9) / max(1 - sum(below.values()), 1e-9)
            mean = sum(m / total * math.log(listed[w] / below[w]) for w, m in got.items()) + mass * math.log(rest)
            if mean >= suffix_tree.MEAN and mean * total >= suffix_tree.TOTAL:
                fresh[context] = (listed, rest)
        model.update(fresh)
    seq = [*text.lower().split(), None]
    return sum(math.log10(p(tuple(seq[max(0, i - depth) : i]), w)) for i, w in enumerate(seq)), len(model)


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    follow = {(v, w): rng.permutation(7)[:2] for v in range(7) for w in range(7)}  # two words tell the next
    texts = []
    for _ in range(60):
        v, w, out = 0, 0, []
        for _ in range(60):
            out.append(f"W{w}" if rng.random() < 0.95 else f"rare{rng.integers(10**6)}")
            v, w = w, int(rng.choice(follow[v, w]))
        texts.append(" ".join(out))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") % 5 == 0
    train = [t for i, t in enumerate(texts) if i % 5]
    for r in suffix_tree.score(df, held, word_share=0, context_share=0, symbol_share=0, pair_share=0, contexts=1, pairs=2).collect():
        want, states = brute_force_score(train, texts[r["doc_id"]])
        assert states > 20 and r["score"] == pytest.approx(want, abs=1e-6)
    for share in (0.15, 0.5, 1.0):  # the same from a table joined, with some and with all words and pairs rare
        for r in suffix_tree.score(df, held, depth=1, word_share=share, pair_share=0.05, contexts=1, pairs=2).collect():
            want, states = brute_force_score(train, texts[r["doc_id"]], 1)
            assert states >= 7 and r["score"] == pytest.approx(want, abs=1e-6)


def test_states_of_two_words_are_cut_by_no_share(spark):
    """Two levels from a table joined, with some or all of both rare, equal brute force."""
    rng = np.random.default_rng(4)
    follow = {(v, w): rng.permutation(7)[:2] for v in range(7) for w in range(7)}
    texts = []
    for _ in range(60):
        v, w, out = 0, 0, []
        for _ in range(60):
            out.append(f"W{w}" if rng.random() < 0.95 else f"rare{rng.integers(10**6)}")
            v, w = w, int(rng.choice(follow[v, w]))
        texts.append(" ".join(out))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t for i, t in enumerate(texts) if i % 5]
    want = {i: brute_force_score(train, t)[0] for i, t in enumerate(texts)}
    for words, states, pairs in ((0, 0.02, 0.005), (0, 1.0, 0.02), (0.15, 0.03, 0.02), (1.0, 1.0, 1.0)):
        got = suffix_tree.score(df, F.col("doc_id") % 5 == 0, word_share=words, context_share=states, symbol_share=0.1, pair_share=pairs, contexts=1, pairs=2).collect()
        assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, abs=1e-6)


def test_codes_of_pairs_and_triples_differ():
    keys = np.arange(40)
    a, b = (x.ravel() for x in np.meshgrid(keys, keys, indexing="ij"))
    pair = suffix_tree.codes(a, b).reshape(40, 40)
    triple = suffix_tree.codes(np.repeat(pair, 40), np.broadcast_to(pair, (40, 40, 40)).ravel())
    assert len(np.unique(np.append(pair, triple))) == 40**2 + 40**3


def test_deeper_trees_are_refused(documents):
    with pytest.raises(ValueError):
        suffix_tree.score(documents, depth=3)


def test_tree_grows_with_the_corpus(documents):
    """Twice as many different texts list more pairs; none is cut by a share."""
    docs = documents.select("doc_id", "text").withColumn("held_out", F.lit(False))
    sizes = []
    for part in (docs.where("doc_id % 2 = 0"), docs):
        counts = suffix_tree.word_counts(part)
        tree, table = suffix_tree.learn(part, counts)
        sizes.append(len(tree.levels[0].codes) + table.where(f"b <> {tree.end + 1}").count())
    assert sizes[1] > 1.3 * sizes[0]


def test_tree_is_a_distribution(documents):
    docs = documents.select("doc_id", "text").withColumn("held_out", F.lit(False))
    counts = suffix_tree.word_counts(docs)
    tree, _ = suffix_tree.learn(docs, counts)
    words, c = zip(*[(r["word"], r["c"]) for r in counts.collect()], strict=True)
    one = tree.levels[0]
    state = int(np.flatnonzero(one.kept)[0])
    word = int(one.keys[state])
    total = 0.0
    all_c = [*c, tree.counts[-1]]
    for w, n in zip([*words, None], all_c, strict=True):
        x = np.array([word, tree.end if w is None else tree.ids.get(w.encode(), -1)])
        total += (n + 1) / (tree.tokens + 1 + tree.distinct) * 10 ** tree.gains(x)[0][1]
    total += 1 / (tree.tokens + 1 + tree.distinct) * 10 ** one.rest[state]  # an unknown word
    assert total == pytest.approx(1, abs=1e-6)


def test_encoding(odd, empty):
    t = bpe.tokenizer()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter()
    for r in odd.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))] += 1
    for split in (bpe.SPLIT_CHARS, 5000):
        assert collections.Counter(tuple(r) for r in bpe.round_trip(odd, split_chars=split).collect()) == want
    assert bpe.round_trip(empty).count() == 0


def test_token_counts(odd, empty):
    lengths = [r["n_tokens"] for r in token_counts.document_lengths(odd).collect()]
    got = sorted(tuple(r) for r in token_counts.token_counts(odd).collect())
    for a, b in zip(got, token_counts.brute_force(lengths), strict=True):
        assert a[:6] == b[:6] and a[6] == pytest.approx(b[6])
    cut = token_counts.truncated_total(token_counts.histogram(token_counts.document_lengths(odd)), 10).first()
    assert cut["kept_tokens"] == sum(min(x, 10) for x in lengths)
    assert token_counts.token_counts(empty).count() == 0


def test_languages(odd, empty, documents):
    got = langid.predictions(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    rows = langid.predictions(odd).collect()
    assert len(rows) == 11 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 7, 8))
    assert langid.predictions(empty).count() == 0


def test_known_languages_keep_their_columns(spark, documents):
    from pyspark.sql.functions import lit

    docs = documents.select("doc_id", "text", "lang", lit(3).alias("score"), lit("x").alias("_kept")).limit(60)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= 60
    same = spark.createDataFrame([(7, f"the word {i} and others", "en") for i in range(900)] + [(8, "der hund und die katze", "de")] * 5, "doc_id long, text string, lang string")
    sample = langid.training_sample(same)
    assert sum(lang == "en" for _, lang in sample) == langid.SAMPLE_DOCS and sum(lang == "de" for _, lang in sample) == 5


def test_languages_of_copies(spark):
    """A label of one row's copies is learned from, and each score is that of
    the definition: the mean of the n-grams' rows under the softmax."""
    rows = [(8, "der hund und die katze", "de")] * 5000 + [(k, f"the word {k} and others", "en") for k in range(3000)]
    sample = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert collections.Counter(lang for _, lang in sample) == {"de": langid.SAMPLE_DOCS, "en": langid.SAMPLE_DOCS}
    m = langid.train(sample)
    for text in ("die katze", "the others", "x", "Öl und Ärger " * 40):
        data = (" " + " ".join(text.lower().split()) + " ").encode()
        total, n = np.zeros(2), 0
        for size in langid.GRAMS:
            for i in range(len(data) - size + 1):
                h = 0
                for byte in data[i : i + size]:
                    h = (h * 0x01000193 + byte + 1) % 2**32
                total += m.table[(h * 2654435761 % 2**32) >> (32 - langid.BITS)]
                n += 1
        z = (total / n + m.bias) / m.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert m.predict(text)[:2] == (m.labels[int(p.argmax())], pytest.approx(p.max()))


@pytest.mark.parametrize("run", [1, 3, 1000])
def test_ranks_have_no_gaps(spark, monkeypatch, run):
    """Pieces of one null doc_id are spread over shards by their content."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(packing, "SHARD_RUN", run)
    pieces = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("id") % 50 + 1).alias("length"), (F.col("id") % 50 + 1).alias("doc_tokens"), F.col("id").alias("ids_crc32"), F.when(F.col("id") < 2000, 1).otherwise(2).alias("cls"))
    ranks = packing.ranked(pieces, 40)
    for cls, n in ((1, 2000), (2, 1000)):
        assert sorted(r["rank"] for r in ranks.where(F.col("cls") == cls).select("rank").collect()) == list(range(n))
    assert packing.ranked(pieces.where("false"), 40).count() == 0


def test_packing(odd, empty):
    t = bpe.tokenizer()
    rows = packing.pack(odd).collect()
    ids = collections.Counter()
    for r in odd.collect():
        ids[(r["doc_id"], tuple([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]))] += 1
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for seq in by.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    assert sum(r["length"] for r in rows) == sum(len(x) * n for (_, x), n in ids.items())
    whole = {i: x for (i, x), _ in ids.items()}
    for r in rows:
        x = whole[r["doc_id"]]
        assert r["doc_tokens"] == len(x)
        assert r["ids_crc32"] == zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    assert packing.pack(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.near_copies(spark, docs, DATA)
    assert kept.columns == docs.columns
    want = {r["class_id"] for r in chosen_path.similar_texts(docs).collect()}
    assert {r["doc_id"] for r in kept.collect()} == want
    final = corpus_pipeline.run(spark, DATA)
    assert 0 < final.select("doc_id").distinct().count() <= docs.count()
