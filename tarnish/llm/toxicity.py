"""Toxicity by a convolutional text classifier.

A word is the sum of hashed embedding rows, of the word and of its
beginnings, so that forms never met before are placed by their stems.
Filters of several widths slide over the words, the largest response of
each over the whole text is kept, and a logistic layer turns these into a
score.  Weights start from ``SAMPLE_DOCS`` labelled documents of each label,
chosen by a hash of the id, on the driver; where there are more, all others
are dealt into shards by that hash, every shard goes on from these weights
over its whole texts in a task, and the shards' changes are averaged, each
row of the embeddings by the documents that changed it.  A fifth of all
labelled documents is not fitted: it calibrates the score and sets a
threshold for each language.

Scoring runs over whole texts in tasks: the response of a window is a sum of
one vector for each word and place, looked up in a memo of bounded size, and
long texts are taken in pieces that overlap by a window.
"""

from __future__ import annotations

import copy
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_residue, narrowed, prepare, written

#: Parameters: documents of each label that weights start from, hash buckets
#: (a power of two), embedding width, filters of each width, passes, step,
#: words in a memo, and characters and words taken at a time.
SAMPLE_DOCS, BITS, WIDTH, FILTERS, PASSES, STEP, MEMO, CHARS, WORDS = 2000, 16, 12, 8, 8, 0.1, 250_000, 1 << 22, 1 << 15
WIDTHS, STEMS = (1, 2, 3), (3, 5, 7)
#: Characters of a shard, steps of a weight's change that is summed, and of a
#: response by which texts that calibrate are counted.
SHARD, FINE, NEAR = 1 << 25, 1 << 24, 256
#: Score from which a text is called toxic, and positive calibration texts
#: that a language needs for a threshold of its own.
LIMIT, ENOUGH = 0.7, 10
_WORD = re.compile(r"\w+")


def pieces(text: str):
    """Lower-case words of a text, some at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + CHARS)
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):  # not within a word
            end += 1
        words = _WORD.findall(text[at:end].lower())
        for k in range(0, len(words), WORDS):
            yield words[k : k + WORDS]
        at = end


def buckets(words: list[str]) -> np.ndarray:
    """Hash rows of each word and of its beginnings (a short word repeats)."""
    crc, stems = zlib.crc32, [(str(n), n) for n in STEMS]
    hashes = [crc(part.encode()) for w in words for part in ("=" + w, *[k + w[:n] for k, n in stems])]
    return (np.array(hashes, dtype=np.int64) >> (32 - BITS)).reshape(-1, 1 + len(STEMS))


#: Place of each (width, offset) among the projected vectors of a word.
TAPS = [(w, k) for w in WIDTHS for k in range(w)]


class Model:
    """table: for each bucket, its embedding times the filters of every tap."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float, thresholds: dict | None = None, constant: float | None = None):
        self.table, self.bias, self.weights, self.offset, self.thresholds, self.constant = table, bias, weights, offset, thresholds or {}, constant
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((1, table.shape[1]), dtype=np.float32)  # row 0: nothing there

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "rows")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.memo, self.rows = {}, np.zeros((1, self.table.shape[1]), dtype=np.float32)

    def index(self, words: list[str]) -> np.ndarray:
        """Rows of the words' vectors, new ones added."""
        memo = self.memo
        got = [memo.get(w, 0) for w in words]
        new = list({w for w, k in zip(words, got, strict=True) if not k}) if 0 in got else []
        if new:
            if len(memo) + len(new) > MEMO:  # starts anew; the words at hand are few
                memo.clear()
                new, self.rows = sorted(set(words)), self.rows[:1]
            if len(self.rows) < 1 + len(memo) + len(new):
                grown = np.zeros((min(2 * (len(memo) + len(new)) + 1024, MEMO + len(new) + 1), self.rows.shape[1]), dtype=np.float32)
                grown[: len(memo) + 1] = self.rows[: len(memo) + 1]
                self.rows = grown
            for k in range(0, len(new), 4096):
                part = new[k : k + 4096]
                self.rows[len(memo) + 1 : len(memo) + 1 + len(part)] = self.table[buckets(part)].sum(1)
                memo.update(zip(part, range(len(memo) + 1, len(memo) + 1 + len(part)), strict=True))
            got = [memo[w] for w in words]
        return np.array(got, dtype=np.int64)

    def responses(self, idx: np.ndarray, last: bool) -> np.ndarray | None:
        """Largest response of each filter over the windows of these words;
        beyond the ``last`` words of a text nothing follows, others only
        have windows that are whole (none: null)."""
        if last:
            idx = np.concatenate([idx if len(idx) else np.zeros(1, dtype=np.int64), np.zeros(WIDTHS[-1] - 1, dtype=np.int64)])
        n, out = len(idx) - WIDTHS[-1] + 1, []
        if n < 1:
            return None
        for w in WIDTHS:
            total = 0
            for k in range(w):
                at = TAPS.index((w, k)) * FILTERS
                total = total + self.rows[idx[k : k + n], at : at + FILTERS]
            out.append(total.max(0))
        return np.concatenate(out)

    def features(self, text: str | None) -> np.ndarray:
        best, held, after = None, [], None
        for words in pieces(text or ""):
            if after is not None:
                held += after
                now = self.responses(self.index(held), False)
                best = now if best is None else best if now is None else np.maximum(best, now)
                held = held[-(WIDTHS[-1] - 1) :]  # windows that begin here aren't whole yet
            after = words
        now = self.responses(self.index([*held, *(after or [])]), True)
        return np.maximum((now if best is None else np.maximum(best, now)) + self.bias, 0)

    def response(self, text: str | None) -> float:
        return float(self.features(text) @ self.weights + self.offset)

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.response(text), -40, 40))))


_TAP_AT = [[TAPS.index((w, k)) for k in range(w)] for w in WIDTHS]


class Weights:
    """What is fitted, with the sums of squares that its steps are held by."""

    def __init__(self, seed: int = 11):
        self.rng = rng = np.random.default_rng(seed)
        n_out = len(WIDTHS) * FILTERS
        self.emb = rng.normal(0, 0.05, (1 << BITS, WIDTH)).astype(np.float32)
        self.conv = rng.normal(0, 0.3, (len(TAPS), WIDTH, FILTERS)).astype(np.float32)
        self.bias, self.out, self.offset = np.zeros(n_out, np.float32), rng.normal(0, 0.3, n_out).astype(np.float32), 0.0
        self.seen = [np.full(a.shape, 1e-3, np.float32) for a in (self.emb[:, :1], self.conv, self.bias, self.out)]

    def forward(self, hashed: np.ndarray, words: np.ndarray):
        """Of a text's distinct words the hash rows, and its words as their
        places: vectors, where the filters respond most, and features."""
        vec = np.concatenate([self.emb[hashed].sum(1), np.zeros((1, WIDTH), np.float32)])
        inv = np.concatenate([words if len(words) else [len(hashed)], np.full(WIDTHS[-1] - 1, len(hashed))]).astype(np.int64)
        n, best, where = len(inv) - WIDTHS[-1] + 1, [], []
        proj = np.einsum("ud,tdf->tuf", vec, self.conv, optimize=True)
        for at in _TAP_AT:
            total = sum(proj[t][inv[k : k + n]] for k, t in enumerate(at))
            where.append(total.argmax(0))
            best.append(total[where[-1], np.arange(FILTERS)])
        return inv, vec, where, np.maximum(np.concatenate(best) + self.bias, 0)

    def response(self, hashed: np.ndarray, words: np.ndarray) -> float:
        return self.forward(hashed, words)[3] @ self.out + self.offset

    def learn(self, hashed: np.ndarray, words: np.ndarray, y: int, rate: float, weight: float = 1.0) -> np.ndarray:
        """A step towards label ``y``; the embedding rows that it changes."""
        conv, seen = self.conv, self.seen
        inv, vec, where, feat = self.forward(hashed, words)
        p = 1 / (1 + np.exp(-np.clip(feat @ self.out + self.offset, -40, 40)))
        g = np.float32(weight * (p - y))
        back = g * self.out * (feat > 0)
        seen[3] += (g * feat) ** 2
        self.out -= rate * g * feat / np.sqrt(seen[3])
        self.offset -= 0.1 * rate * float(g)
        seen[2] += back**2
        self.bias -= rate * back / np.sqrt(seen[2])
        d_vec = np.zeros_like(vec)
        for j, at in enumerate(_TAP_AT):
            b = back[j * FILTERS : (j + 1) * FILTERS]
            for k, t in enumerate(at):
                rows_ = inv[where[j] + k]
                np.add.at(d_vec, rows_, b[:, None] * conv[t].T)
                d = vec[rows_].T * b
                seen[1][t] += d**2
                conv[t] -= rate * d / np.sqrt(seen[1][t])
        used = np.flatnonzero(np.abs(d_vec[:-1]).sum(1))
        h = hashed[used].ravel()
        if len(used):
            d = np.repeat(d_vec[used], hashed.shape[1], 0)
            np.add.at(seen[0][:, 0], h, (d**2).mean(1))
            np.add.at(self.emb, h, -rate * d / np.sqrt(seen[0][h]) / hashed.shape[1])
        return h

    def rows(self) -> np.ndarray:
        """All weights as rows of ``WIDTH``, those of the embeddings first."""
        small = np.concatenate([self.conv.ravel(), self.bias, self.out, [self.offset]])
        return np.concatenate([self.emb, np.pad(small, (0, -len(small) % WIDTH)).reshape(-1, WIDTH)]).astype(np.float64)

    def changed(self, delta: np.ndarray) -> Weights:
        """These weights, moved by ``delta``, as ``rows`` has them."""
        new, n = copy.deepcopy(self), len(self.emb)
        new.emb = (self.emb + delta[:n]).astype(np.float32)
        small = delta[n:].ravel()
        for name in ("conv", "bias", "out"):
            old = getattr(self, name)
            setattr(new, name, (old + small[: old.size].reshape(old.shape)).astype(np.float32))
            small = small[old.size :]
        new.offset = self.offset + float(small[0])
        return new

    def model(self, a: float = 1.0, c: float = 0.0, thresholds: dict | None = None) -> Model:
        """The model whose response is ``a`` times the fitted one and ``c``."""
        table = np.einsum("bd,tdf->btf", self.emb, self.conv, optimize=True).reshape(1 << BITS, len(TAPS) * FILTERS).astype(np.float32)
        return Model(table, self.bias.astype(np.float32), a * self.out.astype(np.float64), float(a * self.offset + c), thresholds)


def first_fit(rows: list[tuple[str, int, str | None]], seed: int = 11) -> tuple[Weights, np.ndarray, np.ndarray, list[str | None]]:
    """Weights fitted to four fifths of (text, 0/1, language) rows, and the
    response, label and language of the others."""
    names: dict[str, int] = {}
    docs = []
    for text, y, lang in rows:
        words = np.array([names.setdefault(w, len(names)) for part in pieces(text) for w in part], dtype=np.int64)
        u, inv = np.unique(words, return_inverse=True)
        docs.append((u, inv, y, lang))
    hashed = buckets(list(names) or [""])
    kept = [k for k in range(len(docs)) if k % 5 == 4]
    fit_ = [k for k in range(len(docs)) if k % 5 != 4]
    weights = Weights(seed)
    steps, done = PASSES * len(fit_), 0
    for _ in range(PASSES):
        for i in weights.rng.permutation(fit_):
            u, inv, y, _lang = docs[i]
            weights.learn(hashed[u], inv, y, STEP * (1 - 0.9 * done / steps))
            done += 1
    z = np.array([weights.response(hashed[docs[k][0]], docs[k][1]) for k in kept], dtype=np.float64)
    return weights, z, np.array([docs[k][2] for k in kept], dtype=np.float64), [docs[k][3] for k in kept]


def calibrated(weights: Weights, share: float, z: np.ndarray, y: np.ndarray, langs: list[str | None], n: np.ndarray) -> Model:
    """The model of ``weights``, calibrated by responses ``z`` and labels of
    texts that were not fitted, ``n`` of each kind."""
    mean = float((n * y).sum() / max(1, n.sum()))
    weight = n * np.where(y == 1, share / max(mean, 1e-9), (1 - share) / max(1 - mean, 1e-9))
    a, c, whole = 1.0, 0.0, n.sum()
    for _ in range(3000):  # logistic calibration
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
        e = weight * (p - y)
        a, c = max(0.05, a - 0.05 * float((e * z).sum() / whole) - 1e-4 * (a - 1)), c - 0.1 * float(e.sum() / whole)
    scores = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
    known = np.array(langs, dtype=object)
    own = {lang: np.array([x == lang for x in known]) for lang in set(langs)}
    return weights.model(a, c, {lang: best_threshold(scores[m], y[m], weight[m]) for lang, m in own.items() if (n * y)[m].sum() >= ENOUGH})


def train(rows: list[tuple[str, int, str | None]], share: float, seed: int = 11) -> Model:
    """Fits a model to (text, 0/1, language) rows.  ``share`` is the share of
    label 1 among all labelled documents, to which the score is calibrated."""
    if len({y for _, y, _ in rows}) < 2:
        n = len(WIDTHS) * FILTERS
        return Model(np.zeros((1, len(TAPS) * FILTERS), np.float32), np.zeros(n, np.float32), np.zeros(n), 0.0, constant=float(rows[0][1]) if rows else 0.0)
    weights, z, y, langs = first_fit(rows, seed)
    return calibrated(weights, share, z, y, langs, np.ones(len(z)))


def shard_changes(batches, weights: Weights, balance: tuple[float, float]):
    """(row, n, v0, v1, ...) for each shard of rows that arrive by shard: the
    sums of the changes of the rows of weights that it learned, from
    ``weights`` on, times ``n``, the texts that changed them."""
    names, hashed = {}, np.empty((0, 1 + len(STEMS)), dtype=np.int64)
    now, shard, docs, hits, start = None, None, 0, None, weights.rows()

    def changes():
        delta = now.rows() - start
        n = np.concatenate([hits, np.full(len(delta) - len(hits), docs)])
        at = np.flatnonzero(n)
        sums = np.rint(delta[at] * n[at, None] * FINE).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), *(pa.array(v) for v in sums.T)], names=["row", "n", *(f"v{k}" for k in range(WIDTH))])

    for batch in batches:
        for s, text, y in zip(*(batch.column(c).to_pylist() for c in ("shard", "text", "y")), strict=True):
            if s != shard:
                if now is not None:
                    yield changes()
                now, shard, docs, hits = copy.deepcopy(weights), s, 0, np.zeros(1 << BITS, dtype=np.int64)
            words = [w for part in pieces(text) for w in part]
            distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
            new = [w for w in distinct if w not in names]
            if len(names) + len(new) > MEMO:  # starts anew
                names, hashed, new = {}, hashed[:0], list(distinct)
            if new:
                if len(names) + len(new) > len(hashed):
                    hashed = np.concatenate([hashed, np.empty((len(hashed) + len(new), hashed.shape[1]), dtype=np.int64)])
                hashed[len(names) : len(names) + len(new)] = buckets(new)
                names.update(zip(new, range(len(names), len(names) + len(new)), strict=True))
            own = hashed[np.array([names[w] for w in distinct], dtype=np.int64)]
            h = now.learn(own, np.array([distinct[w] for w in words], dtype=np.int64), y, 0.1 * STEP, balance[y])
            hits[np.unique(h)] += 1
            docs += 1
    if now is not None:
        yield changes()


def refined(weights: Weights, rows: DataFrame, chars: int, counts: dict[int, int]) -> Weights:
    """``weights`` after all of ``rows`` (doc_id, y, text), dealt into shards
    by a hash of the id.  Changes are summed as integers, so the result does
    not depend on the order or the partitions in which rows come."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # buckets x width
    balance = tuple(sum(counts.values()) / (2 * max(1, counts.get(y, 0))) for y in (0, 1))
    shards = 1 + chars // SHARD
    names = [f"v{k}" for k in range(WIDTH)]
    order = F.xxhash64("doc_id", F.lit(5))
    dealt = rows.select(F.pmod(order, F.lit(shards)).alias("shard"), order.alias("at"), "doc_id", "text", "y").repartition(shards, "shard").sortWithinPartitions("shard", "at", "doc_id")
    got = dealt.select("shard", "text", "y").mapInArrow(lambda batches: shard_changes(batches, shared.value, balance), f"row long, n long, {', '.join(f'{v} long' for v in names)}")
    found = got.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in names]).toArrow()  # a row for each row of weights
    delta = np.zeros_like(weights.rows())
    sums = np.stack([found.column(v).to_numpy() for v in names], 1)
    delta[found.column("row").to_numpy()] = sums / found.column("n").to_numpy()[:, None] / FINE
    return weights.changed(delta)


def counted_responses(rows: DataFrame, weights: Weights) -> list[tuple[float, int, str | None, int]]:
    """(response, label, language, texts) of ``rows`` (y, text, lang), with
    responses counted by steps of 1 / ``NEAR`` from -40 to 40."""
    shared = rows.sparkSession.sparkContext.broadcast(weights.model())  # buckets x taps x filters

    def run(batches):
        m = shared.value
        for b in batches:
            z = np.array([m.response(t.as_py()) for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.clip(z, -40, 40) * NEAR).astype(np.int64)), b.column("y"), b.column("lang")], names=["z", "y", "lang"])

    got = rows.select("text", F.col("y").cast("int").alias("y"), "lang").mapInArrow(run, "z long, y int, lang string").groupBy("lang", "y", "z").count()
    return [(r["z"] / NEAR, r["y"], r["lang"], r["count"]) for r in got.orderBy("lang", "y", "z").collect()]  # steps x labels x languages


def best_threshold(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Of the middles between neighbouring scores the one of best F1, nearest
    to ``LIMIT`` among equals."""
    s = np.unique(scores)
    cuts = np.concatenate([(s[1:] + s[:-1]) / 2, [LIMIT]])
    f1 = [2 * (weight * y)[m].sum() / max(1e-12, weight[m].sum() + (weight * y).sum()) for m in (scores >= t for t in cuts)]
    return float(min(zip([-round(x, 9) for x in f1], np.abs(cuts - LIMIT), cuts, strict=True))[2])


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, chars) of each labelled document, as a written table.

    An id with several labels counts as toxic if one says so.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("y"))
    sizes = documents.where("text is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.length("text")).cast("long").alias("chars"))
    return written(known.where("y in (0, 1)").join(sizes, "doc_id"), "labelled")


def with_texts(documents: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` (doc_id, y) with text and lang; of several texts under one
    id the smallest is taken."""
    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return texts.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("d")).select("doc_id", "y", "d.*")


def fit(documents: DataFrame, labels: DataFrame, held_out=None) -> Model:
    """A model from all labelled documents that ``held_out`` (a condition on
    doc_id) doesn't name."""
    prepare(documents.sparkSession)
    held_out = crc_residue(F.col("doc_id").cast("long"), 3) == 1 if held_out is None else held_out
    documents, labels = documents.where(~held_out), labels.where(~held_out)
    known = labelled(documents, labels)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    one = known.select("doc_id", "y")
    chosen = written(one.where("y = 0").orderBy(*order).limit(SAMPLE_DOCS).unionAll(one.where("y = 1").orderBy(*order).limit(SAMPLE_DOCS)), "first")
    rows = with_texts(documents, F.broadcast(chosen)).collect()  # 2 * SAMPLE_DOCS rows
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    first = [(r["text"], int(r["y"]), r["lang"]) for r in rows]
    if max(counts.values(), default=0) <= SAMPLE_DOCS or len(counts) < 2:
        return train(first, share)
    weights = first_fit(first)[0]
    others = known.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").withColumn("kept", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 4)
    near = narrowed(documents, "doc_id", known, "doc_id")
    chars = others.where("not kept").agg(F.sum("chars")).first()[0] or 0
    weights = refined(weights, with_texts(near, others.where("not kept").select("doc_id", "y")), chars, counts)
    model = weights.model()
    found = [(model.response(text), y, lang, 1) for text, y, lang in first[4::5]]
    found += counted_responses(with_texts(near, others.where("kept").select("doc_id", "y")), weights)
    z, y, langs, n = zip(*found, strict=True)
    return calibrated(weights, share, np.array(z), np.array(y, dtype=np.float64), list(langs), np.array(n, dtype=np.float64))


def scored(documents: DataFrame, model: Model, extra: tuple[str, ...] = ()) -> DataFrame:
    """``extra`` columns and the score of every whole text."""
    prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # buckets x taps x filters
    fields = [documents.schema[c] for c in extra]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"])

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.score(t.as_py()) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in extra), pa.array(got, pa.float64())], names=[*extra, "score"])

    return documents.select(*extra, F.col("text").alias("_text")).mapInArrow(run, schema)


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7), threshold and toxic
    for every document.

    The score comes from the text alone.  threshold is calibrated for the
    document's language (0.7 for a null or rare one), toxic tells whether
    the score reaches it.  Null and empty texts have the score of no words;
    texts of any length are read whole; repeated rows and null doc_ids stay
    rows of their own.  Without labelled documents every score is 0, with
    one label only it is that label.  Other columns are ignored; an empty
    table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs, labels)
    docs = docs.withColumn("held_out", crc_residue(F.col("doc_id"), 3) == 1)
    out = scored(docs, model, ("doc_id", "held_out", "lang"))
    own = F.lit(None).cast("double")
    for lang, t in sorted((k, v) for k, v in model.thresholds.items() if k is not None):
        own = F.when(F.col("lang") == lang, F.lit(t)).otherwise(own)
    out = out.withColumn("threshold", F.coalesce(own, F.lit(LIMIT)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("toxic"))
