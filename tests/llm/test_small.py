"""Pure functions against their definitions."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnish.llm import ann, bpe, chosen_path, compact_windows, langid, packing, shingling, warc


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="abthe's!1 é日́\n<|>x", max_size=200), st.sampled_from([6, 16, 50]))
def test_tree_concatenation_is_exact(text, size):
    want = bpe.tokenizer().encode(text, add_special_tokens=False).ids
    assert bpe.tree_encode(text, size).tolist() == want
    assert np.frombuffer(bpe.word_encoder().encode([text])[0], dtype=np.uint16).tolist() == want
    assert bpe.decode(want) == bpe.tokenizer().decode(want, skip_special_tokens=False)


def test_tree_concatenation_of_a_long_word():
    r = random.Random(1)
    text = "".join(r.choice("etaoinshr") for _ in range(20_000))
    assert bpe.tree_encode(text, 500).tolist() == bpe.tokenizer().encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 6))
def test_compact_windows_cover_each_subsequence_once(values, span):
    h = np.array(values, dtype=np.uint64)
    left, c, right = compact_windows.compact_windows(h, span)
    for i in range(len(h) - span + 1):
        at = [int(m) for lo, m, hi in zip(left, c, right, strict=True) if lo <= i <= m <= i + span - 1 <= hi]
        assert at == [i + int(np.argmin(h[i : i + span]))]


def test_sources_cover_windows_greedily():
    of, source, f = (np.array(x) for x in zip(*[(0, 5, 0), (0, 9, 0), (1, 5, 1), (1, 9, 1), (2, 9, 2), (3, 7, 3), (4, 7, 4), (5, 8, 0)], strict=True))
    assert compact_windows.chosen_sources(of, source, f, 2) == ([9, 7], [5])


def test_regions_need_functions_that_agree():
    points = [(0, [100], 0), (10, [110], 0), (300, [900], 1), (310, [905], 2)]
    assert compact_windows.linked_regions(points, 46, 2) == [(300, 310, 900, 905)]
    assert len(compact_windows.linked_regions(points, 46)) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\u00a0\u3000\x1c\x0b\n", max_size=30), max_size=6))
def test_words_of_many_texts_equal_those_of_each(texts):
    import pyarrow as pa

    found, bounds = shingling.word_hashes(pa.array([*texts, None], pa.string()))
    known = {}
    for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=False):
        ws = t.encode().split()
        assert b - a == len(ws) and all(known.setdefault(w, h) == h for w, h in zip(ws, found[a:b].tolist(), strict=True))
    assert len(set(known.values())) == len(known) and bounds[-1] == bounds[-2]


def test_repeated_spans_finds_an_edited_passage():
    other = np.arange(1000, 1200, dtype=np.uint64)
    mine = np.concatenate([np.arange(50, dtype=np.uint64), other[20:120], np.arange(60, 110, dtype=np.uint64)])
    mine[80] = 7
    assert [(s, e) for s, e, _ in compact_windows.repeated_spans(mine, other, 46, 0.8)] == [(50, 149)]


def test_repeated_spans_where_the_source_repeats_a_line():
    mine = np.arange(1000, 1056, dtype=np.uint64)
    passage = mine.copy()
    passage[26:31] = np.arange(5)  # one word edited: 51 of 56 shingles
    other = np.concatenate([np.arange(2000, 2010, dtype=np.uint64), mine[:1], np.arange(3000, 3049, dtype=np.uint64), passage, np.arange(4000, 4040, dtype=np.uint64)])
    assert compact_windows.repeated_spans(mine, other, 46, 0.8) == [(0, 55, pytest.approx(51 / 61))]
    two = np.concatenate([mine, mine + 500])  # in the source far apart, in the other order
    apart = np.concatenate([passage + np.where(passage > 99, 500, 0).astype(np.uint64), np.arange(5000, 5400, dtype=np.uint64), passage])
    assert [(s, e) for s, e, _ in compact_windows.repeated_spans(two, apart, 46, 0.8)] == [(0, 55), (56, 111)]


def test_close_by_is_local():
    lines = [np.arange(100 * k, 100 * k + 12).astype(np.uint64) for k in range(40)]
    mine, same = np.concatenate(lines), np.concatenate([lines[k * 17 % 40] for k in range(40)])
    assert not compact_windows.close_by(mine, same, 46, 0.8)
    assert compact_windows.close_by(mine, np.concatenate([same, mine[100:150]]), 46, 0.8)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=14), st.lists(st.integers(0, 12), max_size=30))
def test_best_likeness_equals_all_windows(x, other):
    x, other = np.unique(np.array(x, dtype=np.uint64)), np.array(other, dtype=np.uint64)
    want = max((compact_windows.jaccard(x, other[i:j]) for i in range(len(other)) for j in range(i + 1, len(other) + 1)), default=0.0)
    got = compact_windows.best_likeness(x, other, 0.5)
    assert got == pytest.approx(want) if want >= 0.5 else got < 0.5


def test_remove_words():
    assert compact_windows.remove_words("a b  c d\ne", [(1, 3)]) == "a d\ne"


def test_meeting_probability():
    assert chosen_path.meeting(0.8, 1) == pytest.approx(0.75 * 0.8 + 0.25 * 0.96)
    assert (1 - chosen_path.meeting(0.8, 4)) ** chosen_path.runs_for(0.9999, 0.8, 4) <= 1e-4


def test_intersections():
    sets = [np.array([1, 2, 3]), np.array([2, 3, 4, 5]), np.array([9])]
    got = chosen_path.intersections(sets)
    assert got[0, 1] == 2 and got[0, 2] == 0


@pytest.mark.parametrize("seed", range(4))
def test_patterns_meet_demand(seed):
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, 40, 32)
    found = packing.patterns(demand)
    assert all((p * np.arange(1, 33)).sum() <= 32 for p, _ in found)
    assert (sum(p * n for p, n in found) == demand).all()
    least = math.ceil((demand * np.arange(1, 33)).sum() / 32)
    assert sum(n for _, n in found) <= 1.05 * least + 2


def test_language_model_separates():
    rows = [("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30
    m = langid.train(rows)
    assert m.predict("the dog and cat")[0] == "en" and m.predict("die katze und der hund")[0] == "de"
    assert m.predict(None) == ("und", 0.0, True) and m.predict("12 !?")[0] == "und"


def test_chunks_see_every_gram(monkeypatch):
    m = langid.Model(["a", "b"], np.random.default_rng(0).normal(size=(1 << langid.BITS, 2)), np.zeros(2))
    text = "some words that are cut " * 20
    whole = m.table[langid.grams(langid.plain(text))].mean(0)
    assert np.allclose(m.logits(text), whole)


def test_gzip_member_tells_its_length():
    data = warc.gzip_member(b"x" * 1000)
    head, body = warc._member(data)
    assert head + body + 8 == len(data)
    import gzip

    assert gzip.decompress(data) == b"x" * 1000
    assert hashlib.sha1(b"").hexdigest()


def test_parted_rows_are_whole_and_hold_all_keys(spark):
    from tarnish.llm.common import parted

    rows, keys = spark.range(500).withColumnRenamed("id", "x"), spark.range(0, 500, 7).withColumnRenamed("id", "k")
    for bits in (1 << 24, 64):  # 64: nearly every bit is set
        maybe, stay = parted(rows, "x", keys, "k", bits)
        a, b = ([r[0] for r in df.collect()] for df in (maybe, stay))
        assert sorted(a + b) == list(range(500))
        assert set(range(0, 500, 7)) <= set(a)


def test_removals_keep_odd_rows_and_columns(spark):
    words, own = [f"w{i}" for i in range(140)], [f"own{i}" for i in range(40)]
    one, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join([*own, *words[:60], "tail"])
    rows = [(1, one, "a"), (2, near, "b"), (3, other, "c"), (4, None, "d"), (5, "", "e"), (None, "alone here", "f"), (6, " ".join(words[:60]), "g"), (1, "a text of its own", "h"), (1, one, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc string").withColumn("_row", F.lit(1)).withColumn("n_chars", F.length("text"))
    kept = chosen_path.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["_doc"] for r in kept.collect()) == ["a", "c", "d", "e", "f", "g", "h"]
    cut = compact_windows.without_repeats(docs)
    assert cut.columns == docs.columns
    got = {r["_doc"]: r for r in cut.collect()}
    assert set(got) - {"b"} == set("acdefh")  # of g no word is left
    assert got["c"]["text"].split() == [*own, "tail"] and got["c"]["n_chars"] == len(got["c"]["text"])
    assert got["a"]["text"] == one and got["d"]["text"] is None and got["e"]["text"] == "" and got["h"]["text"] == "a text of its own"
    none = docs.where("false")
    assert chosen_path.keep_one(none).count() == compact_windows.without_repeats(none).count() == 0
