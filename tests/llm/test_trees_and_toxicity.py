"""Manifest, conversation trie and toxicity against their definitions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tarnish.llm import manifest, prefix_trie, queries, toxicity

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, hash string, _tree string, path int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def framed(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
    return levels


def steps(levels, pos, fanout):
    out = []
    for level in levels[:-1]:
        first = pos // fanout * fanout
        out.append(("".join(level[first:pos]), "".join(level[pos + 1 : first + fanout])))
        pos //= fanout
    return out


def manifest_by_hand(rows, fanout):
    trees = {}
    for doc, text, lang, source, n in rows:
        leaf = sha(framed(doc, source, lang, n, text))
        bad = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n is not None
        trees.setdefault(lang, []).append((doc is not None, doc or 0, leaf, sha(framed(doc, source, lang, n + 1, text)) if bad else leaf, doc))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = {k: climb([x[2] for x in sorted(trees[k])], fanout) for k in order}
    high = climb([low[k][-1][0] for k in order], fanout)
    for at, k in enumerate(order):
        for pos, (_, _, leaf, changed, doc) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            way = steps(low[k], pos, fanout) + steps(high, at, fanout)
            folded = changed
            for left, right in way:
                folded = sha(left + folded + right)
            yield doc, leaf, low[k][-1][0], high[-1][0], sha("".join(a + b for a, b in way)), folded, folded == high[-1][0]


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest(spark, fanout):
    r = random.Random(3)
    rows = [(k, f"text {k} ü" * r.randint(0, 3), r.choice(["en", "de", None, "", "é"]), r.choice(["a", None]), r.choice([None, 5, 99, 2**63 - 1])) for k in range(-3, 70)]
    rows += [(7, "again", "en", "a", 1), (7, "again", "en", "a", 1), (None, None, None, None, None), (None, "x", "en", None, 3), (90, "long " * 100_000, "only", "s", 4)]
    df = spark.createDataFrame([(*x, "h", "t", 1) for x in rows], DOC)
    got = sorted((tuple(x) for x in manifest.tampered_proofs(df, fanout).collect()), key=repr)
    assert got == sorted(manifest_by_hand(rows, fanout), key=repr)
    assert {x[0] for x in got if not x[6]} >= {k for k in range(-3, 70) if zlib.crc32(str(k).encode()) % 7 == 0 and dict((a[0], a[4]) for a in rows)[k] is not None}


def test_manifest_of_few_rows(spark):
    one = spark.createDataFrame([(1, "a", "en", "s", 1, "h", "t", 1)], DOC)
    row = manifest.tampered_proofs(one).first()
    assert row.leaf == row.subroot == row.root == sha(framed(1, "s", "en", 1, "a")) and row.proof_sha256 == sha("")
    assert manifest.tampered_proofs(one.where("false")).count() == 0


def trie_by_hand(rows):
    own, nodes = {}, {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - c % 20, [])[:h] + v[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((c, len(seq)))
    kids = {}
    for seq in nodes:
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)
    words = lambda seq: len([w for w in "".join(" " if x in " \t\n\x0b\x0c\r" else x for x in seq[-1][1]).split(" ") if w]) if seq else 0

    def sums(seq):
        below = [sums(k) for k in kids.get(seq, [])]
        return sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(nodes[seq]) - 1) * words(seq)

    for seq, members in nodes.items():
        ends = sorted(c for c, n in members if n == len(seq))
        yield min(members)[0], len(seq), min(nodes[seq[:-1]])[0] if seq else None, len(members), len(kids.get(seq, [])), *sums(seq), sha(",".join(map(str, ends)))


@pytest.mark.parametrize("bits", [None, 12])
def test_trie(spark, bits, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)  # long conversations are cut
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    monkeypatch.setattr(prefix_trie, "LEAST", 12)
    r, rows = random.Random(5), []
    for c in range(150):
        chosen = [("user" if k % 2 == 0 else None, r.choice(["a b", "", None, "x y\x1cz q"]) if r.random() < 0.7 else f"t{c} {k}") for k in range(r.choice([1, 1, 2, 3, 5, 14]))]
        if 60 <= c < 110:  # many copies
            chosen = [("user", "hello there"), ("bot", "well"), ("user", "same same")] * 3
        rows += [(c, None if k == 0 and c % 3 == 0 else k, role, text) for k, (role, text) in enumerate(chosen)]
    rows += [(1040, 1, "u", "x " * 50_000), (1040, 2, "u", "y"), (1057, 3, "u", "y"), (1999, 1, "u", "n"), (None, 1, "u", "n"), (2000, 1, "u", "r"), (2000, 1, "u", "r")]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "conv_id long, turn long, role string, text string, conv int, depth int")
    got = [tuple(x) for x in prefix_trie.conversation_trie(df, bits).collect()]
    assert sorted(got, key=repr) == sorted(trie_by_hand(rows), key=repr)
    assert prefix_trie.conversation_trie(df.where("false")).count() == 0


def test_full_sketch_loses_nothing(spark):
    """A sketch far too small proves little; the rows stay the same."""
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    convs, rows = prefix_trie.rebuilt(prefix_trie.turns(df))
    table = prefix_trie.sketch(prefix_trie.prefixes(rows), 12)
    assert table.max() <= 2 and table.any()
    keys = prefix_trie.prefixes(rows).groupBy("a", "b").count().collect()
    a, b = np.array([k.a for k in keys]), np.array([k.b for k in keys])
    low = np.minimum.reduce([table[k][prefix_trie.places(a, b, k, 12)] for k in range(prefix_trie.ROWS)])
    assert all(est >= min(2, k["count"]) for est, k in zip(low, keys, strict=True))


def naive_score(m, text):
    """Filters over whole sentences of word vectors, as the definition has it."""
    words = toxicity._WORD.findall((text or "").lower())
    vec = [m.table[toxicity.buckets([w])[0]].sum(0) for w in words] or [np.zeros(m.table.shape[1])]
    vec += [np.zeros(m.table.shape[1])] * 2
    best = []
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best.append(max(sum(vec[i + k][toxicity.TAPS.index((w, k)) * toxicity.FILTERS + f] for k in range(w)) for i in range(len(vec) - 2)))
    z = np.maximum(np.array(best) + m.bias, 0) @ m.weights + m.offset
    return 1 / (1 + np.exp(-z))


def test_scores_of_pieces(monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS", 4)
    monkeypatch.setattr(toxicity, "CHARS", 25)
    monkeypatch.setattr(toxicity, "MEMO", 9)
    rng, r = np.random.default_rng(2), random.Random(2)
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    m = toxicity.Model(rng.normal(size=(1 << toxicity.BITS, len(toxicity.TAPS) * toxicity.FILTERS)).astype(np.float32), rng.normal(size=n).astype(np.float32), rng.normal(size=n) * 0.1, -0.5)
    for k in range(60):
        text = " ".join(r.choice(["a", "bb", "Ünder_score", "longerwords", "x", "y!", "..."]) for _ in range(k))
        assert m.score(text) == pytest.approx(naive_score(m, text), rel=1e-4)
    assert m.score(None) == m.score("") == m.score(" .,")


def test_learns_windows_and_stems():
    r, rows = random.Random(4), []
    for k in range(900):
        words = [f"w{r.randrange(300)}" for _ in range(r.randint(3, 60))]
        kind = k % 3
        if kind == 1:
            words.insert(r.randrange(len(words)), "vileword" + r.choice("abcdefgh") * r.randint(1, 9))
        rows.append((" ".join(words), int(kind == 1), "en" if k % 2 else None))
    m = toxicity.train(rows[:700], 1 / 3)
    got = [(m.score(t) >= 0.7) == bool(y) for t, y, _ in rows[700:]]
    assert sum(got) >= 0.97 * len(got)
    assert m.score("a vilewordzzz here") >= 0.7 > m.score("w1 w2 w3")
    assert toxicity.train([], 0).score("x") == 0.0 and toxicity.train([("a", 1, "en")], 1.0).score("x") == 1.0


def test_toxicity_query(spark):
    """Held-out accuracy on the larger sample; few labels are noise."""
    data = "/root/testdata/sf0.1"
    out = queries.QUERIES["op12_convolutional_toxicity"](spark, data).where("held_out")
    labels = spark.read.parquet(f"{data}/labels.parquet").selectExpr("doc_id", "toxic as y")
    rows = out.join(labels, "doc_id").select("y", "predicted").collect()
    clean, found = [x.predicted for x in rows if x.y == 0], [x.predicted for x in rows if x.y == 1]
    assert sum(clean) <= 0.02 * len(clean) and sum(found) >= 0.7 * len(found)


def test_toxicity_of_odd_rows(spark):
    rows = [(k, "you vile thing" if k % 2 else "a fine day", "en", "s") for k in range(40)] + [(3, None, None, None), (None, "x", None, None), (None, "", "en", None), (50, "word " * 200_000, "de", "s"), (51, "a" * 2_000_000, "de", "s")]
    docs = spark.createDataFrame([(*x, 0.5, 1) for x in rows], "doc_id long, text string, lang string, source string, score double, y int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, None), (None, 1), (3, 1), (3, 0), (99, 1)], "doc_id long, toxic int")
    out = toxicity.scores(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in out)
    assert {x.doc_id for x in out if x.held_out} == {k for k in [*range(40), 50, 51] if zlib.crc32(str(k).encode()) % 3 == 1}
    assert toxicity.scores(docs.where("false"), labels).count() == 0
    assert {x.score for x in toxicity.scores(docs, labels.where("false")).collect()} == {0.0}


def test_toxicity_learns_from_all_labels(spark):
    """What is toxic only in documents beyond those that weights start from."""
    r = random.Random(8)
    ids = spark.range(10_000).selectExpr("id as doc_id", "xxhash64(id) as h").collect()
    train_ids = sorted((x.h, x.doc_id) for x in ids if zlib.crc32(str(x.doc_id).encode()) % 3 != 1)
    toxic = [d for k, (_, d) in enumerate(train_ids) if k % 2]
    late = {*toxic[toxicity.SAMPLE_DOCS + 100 :]}
    assert len(late) > 1000
    rows = []
    for x in ids:
        words = [f"w{r.randrange(300)}" for _ in range(r.randint(3, 12))]
        if x.doc_id in toxic:
            words.insert(r.randrange(len(words)), "zorgish" if x.doc_id in late else "vileword")
        rows.append((x.doc_id, " ".join(words), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(x.doc_id, int(x.doc_id in toxic)) for x in ids], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    assert m.score("w5 zorgish w6 w7") >= 0.7 > m.score("w5 w6 w7 w8") and m.score("w5 vileword w6") >= 0.7
    again = toxicity.fit(docs.repartition(7), labels)
    assert again.score("w5 zorgish w6 w7") == m.score("w5 zorgish w6 w7") and (again.table == m.table).all()
