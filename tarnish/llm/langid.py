"""Language identification: averaged hashed subword embeddings under a
linear softmax.

Byte n-grams (2 to 4, over lower-cased words with blanks around them) are
hashed to rows of an embedding table; a text is the mean of its rows and a
linear softmax gives the language.  Training is stochastic gradient descent
in numpy on a bounded, stratified sample (``SAMPLE_DOCS`` documents of each
label, chosen by a hash of the row); a tenth of it sets the temperature that
calibrates the probabilities and the score under which a text is rejected.
Prediction runs over whole texts, in tasks; the table times the softmax
weights is all that they need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_residue, prepare

#: Parameters: labelled documents sampled for each language, hash buckets
#: (a power of two), embedding width, passes, step, share of the calibration
#: texts that may be rejected, and bytes that are hashed at a time.
SAMPLE_DOCS, BITS, WIDTH, PASSES, STEP, REJECTED, CHUNK = 300, 15, 16, 4, 4.0, 0.002, 1 << 20
GRAMS = (2, 3, 4)


def plain(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").split()) + b" "


def grams(data: bytes) -> np.ndarray:
    """Buckets of all n-grams of ``data``."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    out, h = [], b + np.uint32(1)
    for n in range(2, max(GRAMS) + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            out.append((h * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.int32) if out else np.empty(0, dtype=np.int32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


class Model:
    """table: a row of class scores for each bucket (embedding times weights)."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.labels, self.table, self.bias, self.temperature, self.threshold = labels, table, bias, temperature, threshold

    def logits(self, text: str) -> np.ndarray:
        data, total, n = plain(text), np.zeros(len(self.labels)), 0
        for a in range(0, len(data), CHUNK):  # chunks overlap by the longest n-gram less one byte
            g = grams(data[max(0, a - max(GRAMS) + 1) : a + CHUNK])
            total += np.bincount(g, minlength=len(self.table)) @ self.table if len(g) > len(self.table) else self.table[g].sum(0)
            n += len(g)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether to reject."""
        if not self.labels or not has_letter(text):
            return "und", 0.0, True
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(np.argmax(p))
        return self.labels[k], float(p[k]), bool(p[k] < self.threshold)


def train(rows: list[tuple[str, str]], seed: int = 5) -> Model:
    """Fits a model to (text, language) rows.  Each text is used whole and,
    so that short texts are met too, by one of its lines."""
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    examples = []
    for k, (text, lang) in enumerate(rows):
        lines = [x for x in text.split("\n") if has_letter(x)] or [text]
        for t in (text, lines[int(rng.integers(len(lines)))]):
            u, c = np.unique(grams(plain(t)), return_counts=True)
            if len(u):
                examples.append((u, (c / c.sum()).astype(np.float32), labels.index(lang), k % 10 == 9))
    fit, kept = [e for e in examples if not e[3]] or examples, [e for e in examples if e[3]] or examples
    emb = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (WIDTH, len(labels))).astype(np.float32), np.zeros(len(labels), dtype=np.float32)
    steps, done = PASSES * len(fit), 0
    for _ in range(PASSES):
        for i in rng.permutation(len(fit)):
            u, c, y, _kept = fit[i]
            rate = STEP * (1 - done / steps)
            done += 1
            x = c @ emb[u]
            z = x @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= rate * 0.1 * np.outer(x, p)
            bias -= rate * 0.01 * p
            emb[u] -= rate * 20 * c[:, None] * back
    table = (emb @ w).astype(np.float64)
    z = np.array([c @ table[u] + bias for u, c, _, _ in kept])
    y = np.array([e[2] for e in kept])

    def soft(t):
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(soft(t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    best = soft(t).max(1)[soft(t).argmax(1) == y]
    return Model(labels, table, bias.astype(np.float64), t, float(min(0.5, np.quantile(best, REJECTED))) if len(best) else 0.0)


def training_sample(docs: DataFrame, per_label: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """``per_label`` (text, lang) rows of each label, or all if it has fewer:
    those of the smallest hashes of id and text.  A rate that each label's
    number of different rows sets keeps the rows that are ranked to some more
    than these; copies of a row are counted, not ranked."""
    known = documents_of(docs)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return []
    rates = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, (2.0 * per_label + 100) / max(1, n))))])
    chosen = known.where(F.pmod("h", F.lit(1 << 20)) < F.element_at(rates, F.col("lang")) * (1 << 20))
    chosen = chosen.groupBy("lang", "h", "doc_id", "text").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h", "doc_id", "text")
    chosen = chosen.withColumn("before", F.sum("n").over(order) - F.col("n")).where(F.col("before") < per_label)
    copies = F.array_repeat(F.lit(0), F.least(F.col("n"), per_label - F.col("before")).cast("int"))
    chosen = chosen.select("doc_id", "text", "lang", F.explode(copies))
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r["lang"]) for r in chosen.collect()]  # per_label rows a label
    return [(t, lang) for _, t, lang in sorted(got)]


def documents_of(docs: DataFrame) -> DataFrame:
    """Labelled rows with a hash of id and text."""
    return docs.where("lang is not null and text is not null").select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("h"))


def fit(documents: DataFrame, held_out=None) -> Model:
    """A model from labelled documents that ``held_out`` (a condition) doesn't name."""
    held_out = crc_residue(F.col("doc_id"), 4) == 2 if held_out is None else held_out
    return train(training_sample(documents.where(~held_out)))


def identify(documents: DataFrame, model: Model, extra: tuple[str, ...] = ()) -> DataFrame:
    """Predictions for every whole text: the ``extra`` columns, lang_pred,
    score and rejected.  Null text, or text without a letter: ``und``, 0."""
    prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # buckets x languages
    fields = [f for f in documents.schema if f.name in extra]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, rejected boolean"])
    names = [f.name for f in fields]

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column("_text").to_pylist()]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *cols], names=[*names, "lang_pred", "score", "rejected"])

    return documents.select(*names, F.col("text").alias("_text")).mapInArrow(run, schema)


def predictions(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document.

    Repeated rows and null doc_ids are kept; without labelled documents all
    are ``und``; an empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    docs = docs.withColumn("held_out", crc_residue(F.col("doc_id"), 4) == 2)
    out = identify(docs, fit(docs), ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep_known(documents: DataFrame) -> DataFrame:
    """The documents whose language is recognised, all columns as they are.
    Rejected: texts without letters, null ones among them, and scores under
    the threshold.  Repeated rows fare alike; an empty table gives no rows.
    The columns doc_id, text and lang are needed."""
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_kept")
    out = identify(documents.select("text", whole), fit(documents), ("_kept",))
    return out.where("not rejected").select("_kept.*")
