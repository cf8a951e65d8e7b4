"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of up to ``DEPTH`` words.  A state is kept if its
next-symbol distribution diverges enough from that of its longest kept
suffix (mean divergence and total likelihood ratio).  It lists symbols that
follow it often enough, discounted; what is left of its mass goes to the
other symbols in proportion to the suffix's distribution.  The root is the
add-one word distribution.

States are every word, and every pair of words, of count ``CONTEXTS`` or
more, and list every symbol, rare ones too, that follows ``PAIRS`` times or
more: absolute counts, so both levels grow with the corpus.  They are learned
by grouping and stay a table that documents are joined with, as with the
counts of rare words.  The most frequent ones are broadcast instead, so that
they are no hot keys: words of a share of ``WORD_SHARE`` or more, ``ENTRIES``
pairs of them and ``ENTRIES`` triples at most, with their states.

All gains add up: a listed symbol's is that over its probability at the
suffix, less the state's factor of what isn't listed; this factor comes with
the state's own pair.  So a token asks for its pair and its triple only.
A triple is known by the codes of its two pairs.

A word's key is its place among the frequent words, or else a 63-bit hash
(negative): two rare words meet in one key with a chance of V * V / 2 ** 64.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_residue, prepare, written
from .shingling import mixed

#: Parameters; see above.  BITS: least and most of a filter ahead of shuffles,
#: which drops nothing that a table holds; DISCOUNT: taken from each listed
#: count; MEAN and TOTAL: least divergence in nats; FLUSH: distinct words or
#: pairs that a task holds.
DEPTH, WORD_SHARE, CONTEXTS, PAIRS, ENTRIES, BITS = 2, 1e-6, 2, 2, 1 << 20, (1 << 20, 1 << 27)
DISCOUNT, MEAN, TOTAL, FLUSH = 0.5, 0.02, 10.0, 400_000


def words(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z, cut at blanks and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c: over training documents."""

    def run(batches):
        total: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "c"])

        for b in batches:
            for text in b.column("text").to_pylist():
                total.update(words(text))
                if len(total) > FLUSH:
                    yield out()
                    total.clear()
        yield out()

    part = docs.where(~F.col("held_out")).select("text").mapInArrow(run, "word string, c long")
    return part.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Level:
    """States of one length.  keys: their codes, sorted; known: whether kept;
    codes: listed (state, symbol) pairs, sorted, with their gain (log10 of
    the ratio to the root); rest: log10 factor of what isn't listed; after:
    that of the longer state that a listed pair is, if it isn't in ``keys`` of
    the next level."""

    keys: np.ndarray
    kept: np.ndarray
    rest: np.ndarray
    codes: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    gain: np.ndarray = field(default_factory=lambda: np.empty(0))
    after: np.ndarray = field(default_factory=lambda: np.empty(0))


@dataclass
class Tree:
    """ids of frequent words (the end's comes after them), their counts, the
    counts' totals, and the levels."""

    ids: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    distinct: int
    levels: list[Level] = field(default_factory=list)

    @property
    def end(self) -> int:
        return len(self.ids)

    @property
    def gap(self) -> int:
        return self.end + 1

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts' words with a separator before each text and the
        end after it (rare words and separators: -1), keys (separators:
        ``gap``) and the separators' places."""
        special = {b"\n": self.gap, b" ": self.end}  # no word holds a blank
        ws: list[bytes] = []
        for text in texts:
            ws.append(b"\n")
            ws += words(text)
            ws.append(b" ")
        key = np.fromiter(map(self.ids.get, ws, repeat(-1)), dtype=np.int64, count=len(ws))
        rare = np.flatnonzero(key < 0)
        own = [special.get(ws[i]) for i in rare.tolist()]
        key[rare] = np.array([xxhash.xxh64_intdigest(ws[i], 42) | 1 << 63 if k is None else k for i, k in zip(rare.tolist(), own, strict=True)], dtype=np.uint64).view(np.int64)
        x = np.where((key < 0) | (key == self.gap), -1, key)
        return x, key, np.flatnonzero(key == self.gap)

    def states(self, x: np.ndarray) -> list[np.ndarray]:
        """For each level, the row of the state before each token (-1: none).
        A longer state is coded by the shorter one before it and a word."""
        out, last = [], None
        for d, level in enumerate(self.levels):
            code = np.full(len(x), -1, dtype=np.int64)
            if d == 0:
                code[1:] = x[:-1]
            else:
                shifted = np.full(len(x), -1, dtype=np.int64)
                shifted[1:] = last[:-1]
                before = np.full(len(x), -1, dtype=np.int64)
                before[1:] = x[:-1]
                both = (shifted >= 0) & (before >= 0)
                code[both] = shifted[both] * (self.end + 1) + before[both]
            last = find(level.keys, code)
            out.append(last)
        return out

    def windows(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens that two words of their text precede, and the code
        of each place's and the next one's keys."""
        word = (key != self.gap) & (key != self.end)
        return 2 + np.flatnonzero(word[:-2] & word[1:-1] & (key[2:] != self.gap)), codes(key[:-1], key[1:])

    def gains(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 of each token's probability over the root's, as far as the
        broadcast entries tell; the factor for the token after it; and where
        the table may hold its pair, and its triple."""
        found, total, after, open_ = self.states(x), np.zeros(len(x)), np.zeros(len(x)), np.ones((2, len(x)), dtype=bool)
        for d, level in enumerate(self.levels):
            at = found[d]
            listed = find(level.codes, np.where((at >= 0) & (x >= 0), at * self.gap + x, -1))
            kept = (at >= 0) & level.kept[at] if len(level.kept) else np.zeros(len(x), dtype=bool)
            hit = kept & (listed >= 0)
            total[kept] += level.rest[at[kept]]
            total[hit] = level.gain[listed[hit]]
            open_[d, listed >= 0] = False
            if len(level.after):
                after[listed >= 0] += level.after[listed[listed >= 0]]
        return total, after, *open_


def find(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of ``codes`` in sorted ``keys``; -1 where absent."""
    if not len(keys):
        return np.full(len(codes), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, at, -1)


def codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit codes of pairs of keys, or of codes.  ``mixed`` leaves zero as
    it is, so without a number added the triple (0, 0, c) had the code of the
    pair (c, 0)."""
    return mixed(mixed(a.view(np.uint64) + np.uint64(0x5851F42D4C957F2D)) + b.view(np.uint64)).view(np.int64)


def coded(entries: DataFrame) -> DataFrame:
    """``entries`` with the code of their (a, b)."""
    def run(batches):
        for b in batches:
            code = codes(b.column("a").to_numpy(), b.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(code), *b.columns], names=["code", *b.schema.names])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)
    return entries.mapInArrow(run, f"code long, {types}")


def bitmap(entries: DataFrame) -> np.ndarray:
    """Bits of the ``code`` of ``entries``: eight times the rows or more,
    within ``BITS``."""
    bits = min(max(BITS[0], 1 << (8 * entries.count()).bit_length()), BITS[1])

    def run(batches):
        own = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            at = batch.column("code").to_numpy() & (bits - 1)
            np.bitwise_or.at(own, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(own)
        for i in range(0, len(used), FLUSH):
            some = used[i : i + FLUSH]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some].view(np.int64))], names=["w", "bits"])

    out = np.zeros(bits // 64, dtype=np.int64)
    got = entries.select("code").mapInArrow(run, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most bits / 64 rows
    out[got["w"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def among(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    at = code & (64 * len(bits) - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def neighbours(docs: DataFrame, tree, bits) -> DataFrame:
    """a, b, n: keys of a word and of what follows it, over training
    documents; rare words only as far as ``bits`` has them."""

    def run(batches):
        t, known, held, size = tree.value, bits.value, [], 0

        def out(a, b, n):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

        def merged():
            code, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([h[1] for h in held]), minlength=len(code)).astype(np.int64)
            return out(code // t.gap, code % t.gap, n)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i in range(0, len(texts), 200):
                _, key, _ = t.flat(texts[i : i + 200])
                usable = key != t.gap
                rare = np.flatnonzero(key < 0)
                usable[rare] = among(known, key[rare])
                a, b = key[:-1], key[1:]
                ok = usable[:-1] & usable[1:] & (a != t.end)
                plain = ok & (a >= 0) & (b >= 0)
                held.append(np.unique(a[plain] * t.gap + b[plain], return_counts=True))
                size += len(held[-1][0])
                other = ok & ~plain
                yield out(a[other], b[other], np.ones(int(other.sum()), dtype=np.int64))
            if size > 10 * FLUSH:
                yield merged()
                held, size = [], 0
        if held:
            yield merged()

    part = docs.where(~F.col("held_out")).select("text").mapInArrow(run, "a long, b long, n long")
    return part.groupBy("a", "b").agg(F.sum("n").alias("n"))


def triples(docs: DataFrame, tree, states, pairs) -> DataFrame:
    """ab, bc, n: codes of two pairs of words in a row, over training
    documents, as far as the filters ``states`` and ``pairs`` have them."""

    def run(batches):
        t, held, size = tree.value, [], 0

        def merged():
            ab, bc = (np.concatenate(x) for x in zip(*held, strict=True))
            _, first, n = np.unique(codes(ab, bc), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(ab[first]), pa.array(bc[first]), pa.array(n)], names=["ab", "bc", "n"])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i in range(0, len(texts), 200):
                at, pair = t.windows(t.flat(texts[i : i + 200])[1])
                at = at[among(states.value, pair[at - 2])]
                at = at[among(pairs.value, pair[at - 1])]
                held.append((pair[at - 2], pair[at - 1]))
                size += len(at)
                if size > 5 * FLUSH:
                    yield merged()
                    held, size = [], 0
        if held:
            yield merged()

    part = docs.where(~F.col("held_out")).select("text").mapInArrow(run, "ab long, bc long, n long")
    return part.groupBy("ab", "bc").agg(F.sum("n").alias("n"))


def looked_up(df: DataFrame, key: str, table: DataFrame, how: str = "inner") -> DataFrame:
    """``df`` joined with ``table`` on ``key``: frequent words, 1 / WORD_SHARE
    at most, by broadcast, so that none of them is a hot key; rare ones by
    shuffle."""
    big = df.where(F.col(key) >= 0).join(F.broadcast(table.where(F.col(key) >= 0)), key, how)
    return big.unionByName(df.where(F.col(key) < 0).join(table.where(F.col(key) < 0), key, how))


def learn(docs: DataFrame, counts: DataFrame, depth: int = DEPTH, word_share: float = WORD_SHARE, context_share: float = 0.0, symbol_share: float = 0.0, pair_share: float | None = None, contexts: int = CONTEXTS, pairs: int = PAIRS) -> tuple[Tree, DataFrame]:
    """The tree from the training documents among ``docs``: its broadcast
    part, and the table of the rest: code, b, base, known, gain, where b is
    the key of a listed symbol, or end + 1 for the count of a rare word and
    for the state of it (two rows of one code).  Contexts and pairs of 2 give
    the exact tree: all contexts and pairs that occur twice.  Shares move
    entries between both parts and cut none: of words, states of two words,
    symbols of triples, and pairs and triples (not given: ``ENTRIES``)."""
    spark = docs.sparkSession
    ends = docs.where(~F.col("held_out")).count()
    sums = counts.agg(F.sum("c").alias("c"), F.count("*").alias("v")).first()
    tokens, distinct = (sums["c"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    frequent = counts.where(F.col("c") >= word_share * tokens).toArrow().to_pandas().sort_values(["c", "word"], ascending=[False, True])  # at most 1 / word_share rows
    tree = Tree({w.encode(): i for i, w in enumerate(frequent["word"])}, np.append(frequent["c"].to_numpy(dtype=np.int64), ends), tokens, distinct)
    hashed = F.xxhash64("word").bitwiseOR(F.lit(-(1 << 63)))
    rare = counts.where(F.col("c") < word_share * tokens).groupBy(hashed.alias("a")).agg(F.sum("c").alias("c"))
    rare = written(rare, "lm-rare")
    known = rare.select("a", F.lit(tree.end + 1).cast("long").alias("b"), F.log10(F.col("c") + 1.0).alias("base"), F.lit(1).cast("long").alias("known"), F.lit(0.0).alias("gain"))
    if not tokens:
        return tree, coded(known).drop("a")
    root = np.log10((tree.counts + 1) / (tokens + 1 + distinct))
    symbols = int((tree.counts[:-1] >= symbol_share * tokens).sum())  # words come by falling counts
    likely = bitmap(rare.where(F.col("c") >= pairs).select(F.col("a").alias("code")))
    sent = [spark.sparkContext.broadcast(v) for v in (tree, likely)]
    near = written(neighbours(docs, *sent).where(F.col("n") >= pairs), "lm-pairs")
    for v in sent:
        v.unpersist()
    least = max(float(pairs), _frequent(near.where("a >= 0 and b >= 0")) if pair_share is None else pair_share * tokens)
    plain = (F.col("a") >= 0) & (F.col("b") >= 0) & (F.col("n") >= least)
    # a state's sums, with each symbol's probability at the state and the root
    words_ = spark.createDataFrame(pa.table({"a": np.arange(tree.end + 1), "c": tree.counts})).unionByName(rare)
    size, follow = words_.select("a", F.col("c").cast("double").alias("size")), words_.select(F.col("a").alias("b"), F.col("c").alias("follow"))
    own = looked_up(looked_up(near, "a", size.where(F.col("size") >= contexts)), "b", follow.where(F.col("follow") >= pairs))
    own = written(own, "lm-listed").withColumn("p", (F.col("n") - DISCOUNT) / F.col("size")).withColumn("parent", (F.col("follow") + 1.0) / float(tokens + 1 + distinct))
    share = F.col("n") / F.col("size") * F.log(F.col("p") / F.col("parent"))
    states = own.groupBy("a").agg(F.first("size").alias("size"), F.sum("p").alias("p"), F.sum("parent").alias("parent"), F.sum(share).alias("mean"))
    mass = 1 - F.col("p")
    states = states.withColumn("rest", F.log10(F.greatest(mass, F.lit(1e-9)) / F.greatest(1 - F.col("parent"), F.lit(1e-9))))
    mean = F.col("mean") + mass * F.col("rest") * math.log(10)
    states = written(states.where((mean >= MEAN) & (mean * F.col("size") >= TOTAL)).select("a", "rest"), "lm-states")
    keys = np.arange(tree.end)
    kept, rest = np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
    got = states.where(F.col("a") >= 0).toArrow().to_pandas()  # at most 1 / word_share rows
    kept[got["a"].to_numpy()], rest[got["a"].to_numpy()] = True, got["rest"].to_numpy()
    got = own.where(plain).select(((F.col("a") * tree.gap) + F.col("b")).alias("code"), "n", F.log10("p").alias("p")).toArrow().to_pandas().sort_values("code")  # at most ENTRIES rows
    code, n = got["code"].to_numpy(dtype=np.int64), got["n"].to_numpy(dtype=float)
    one = Level(keys, kept, rest, code, got["p"].to_numpy() - root[code % tree.gap], np.zeros(len(code)))
    tree.levels.append(one)
    gain = F.log10("p") - F.log10("parent") - F.col("rest")
    none = [F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known")]
    # a pair's probability at its state, or at the root if that isn't kept
    likeliest = F.when(F.col("rest").isNull(), F.col("parent")).otherwise(F.col("p"))
    near = written(coded(looked_up(own, "a", states, "left").select("a", "b", "n", plain.alias("plain"), likeliest.alias("q"), gain.alias("gain"))).drop("a"), "lm-coded")
    rest_of = states.where(F.col("a") < 0).select("a", F.lit(tree.end + 1).cast("long").alias("b"), *none, F.col("rest").alias("gain"))
    parts = [coded(known.unionByName(rest_of)).drop("a"), near.where(~F.col("plain") & F.col("gain").isNotNull()).select("code", "b", *none, "gain")]
    if depth > 1:
        # pairs that are states themselves; the most frequent ones are broadcast with their frequent triples
        hot = F.col("plain") & (F.col("n") >= context_share * tokens)
        size = near.where((F.col("n") >= contexts) & (F.col("b") != tree.end)).select("code", F.col("n").cast("double").alias("size"), "plain", hot.alias("hot"))
        sent = [spark.sparkContext.broadcast(v) for v in (tree, bitmap(size), bitmap(near))]
        found = written(triples(docs, *sent).where(F.col("n") >= pairs), "lm-triples")
        for v in sent:
            v.unpersist()
        longer = written(_longer(found, size, near), "lm-longer")
        least = max(least, _frequent(longer.where("hot"))) if pair_share is None else least
        broadcast = F.col("hot") & (F.col("c").between(0, symbols - 1) | (F.col("c") == tree.end)) & (F.col("n") >= least)
        first = longer.where("first")
        alone = (code % tree.gap < tree.end) & (n >= max(contexts, context_share * tokens))
        names = codes(code // tree.gap, code % tree.gap)
        order = np.argsort(names)
        got = first.where("plain and not hot").select("ab", "rest").toArrow()  # at most ENTRIES rows
        one.after[order[find(names[order], got["ab"].to_numpy())]] = got["rest"].to_numpy()
        if alone.any():
            two = Level(code[alone], np.zeros(alone.sum(), dtype=bool), np.zeros(alone.sum()))
            order = np.argsort(names[alone])
            row_of = lambda ab: order[find(names[alone][order], ab.to_numpy())]
            got = first.where("hot").select("ab", "rest").toArrow()  # at most ENTRIES rows
            row = row_of(got["ab"])
            two.kept[row], two.rest[row] = True, got["rest"].to_numpy()
            got = longer.where(broadcast).select("ab", "c", F.log10("p").alias("p")).toArrow()  # at most ENTRIES rows
            symbol = got["c"].to_numpy()
            listed = row_of(got["ab"]) * tree.gap + symbol
            order_ = np.argsort(listed)
            two.codes, two.gain = listed[order_], (got["p"].to_numpy() - root[symbol])[order_]
            tree.levels.append(two)
        parts.append(first.where("not plain").select(F.col("ab").alias("code"), F.col("c").alias("b"), *none, F.col("rest").alias("gain")))
        gain = F.log10("p") - F.log10("q") - F.col("rest")
        listed = coded(longer.where(~broadcast).select(F.col("ab").alias("a"), F.col("bc").alias("b"), "c", *none, gain.alias("gain")))
        parts.append(listed.drop("a", "b").withColumnRenamed("c", "b"))
    return tree, written(reduce(DataFrame.unionByName, parts), "lm-table")


def _frequent(rows: DataFrame) -> float:
    """A count that at most ``ENTRIES`` of ``rows`` have or exceed in ``n``."""
    steps = rows.groupBy(F.floor(F.log2("n") * 8).alias("k")).count().toArrow().to_pandas().sort_values("k", ascending=False)
    over = steps["k"][steps["count"].cumsum() > ENTRIES]
    return 2 ** ((over.iloc[0] + 1) / 8) if len(over) else 0.0


def _longer(found: DataFrame, size: DataFrame, near: DataFrame) -> DataFrame:
    """ab, bc, c, n, p, q, rest, plain, hot, first: the triples of kept states
    of two words.  c: the symbol; p, q: its probability at the state and its
    suffix; first: one row of each state."""
    rows = found.join(near.select(F.col("code").alias("bc"), F.col("b").alias("c"), "q"), "bc").join(size.withColumnRenamed("code", "ab"), "ab")
    rows = rows.withColumn("p", (F.col("n") - DISCOUNT) / F.col("size"))
    state = Window.partitionBy("ab")
    mass = 1 - F.sum("p").over(state)
    rest = F.log10(F.greatest(mass, F.lit(1e-9)) / F.greatest(1 - F.sum("q").over(state), F.lit(1e-9)))
    share = F.sum(F.col("n") / F.col("size") * F.log(F.col("p") / F.col("q"))).over(state)
    rows = rows.select("*", mass.alias("mass"), rest.alias("rest"), share.alias("share"), (F.col("bc") == F.min("bc").over(state)).alias("first"))
    mean = F.col("share") + F.col("mass") * F.col("rest") * math.log(10)
    return rows.where((mean >= MEAN) & (mean * F.col("size") >= TOTAL)).select("ab", "bc", "c", "n", "p", "q", "rest", "plain", "hot", "first")


def score(documents: DataFrame, held_out=None, **options) -> DataFrame:
    """Scores of every whole text.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-one word model) and score (suffix tree), both log10.  Null text is
    empty: its one token is the end.  Repeated rows and null doc_ids are
    kept; an empty table gives no rows; other columns are ignored.
    ``options``: those of ``learn``.
    """
    depth = options.get("depth", DEPTH)
    if depth not in (1, 2):
        raise ValueError("the tree has states of one or two words: depth is 1 or 2")
    spark = documents.sparkSession
    prepare(spark)
    held = crc_residue(F.col("doc_id"), 7) == 2 if held_out is None else held_out
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held)
    counts = written(word_counts(docs), "lm-words")
    tree, table = learn(docs, counts, **options)
    shared, filter_ = spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast(bitmap(table))
    schema = "row long, code long, own struct<doc_id: long, held_out: boolean, n_tokens: long, known: long, base: double, gain: double>"

    def run(batches):
        t, bits, row = shared.value, filter_.value, TaskContext.get().partitionId() << 33
        logs, given = np.append(np.log10(t.counts + 1.0), 0.0), np.append(t.counts > 0, False)  # -1: nothing
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i in range(0, len(texts), 200):
                x, key, starts = t.flat(texts[i : i + 200])
                rows = row + np.arange(len(starts))
                row += len(starts)
                gain, after, *open_ = t.gains(x)
                sums = [np.add.reduceat(v, starts) for v in (given[x].astype(np.int64), logs[x], gain + after)]
                which = np.repeat(rows, np.diff(np.append(starts, len(x))))
                # what the table may hold: rare words with their states, pairs, triples
                rare, (three, code) = np.flatnonzero(key < 0), t.windows(key)
                pair = 1 + np.flatnonzero(open_[0][1:] & (key[:-1] != t.gap) & (key[1:] != t.gap) & (key[:-1] != t.end))
                three = three[open_[1][three]] if depth > 1 else three[:0]
                at = np.concatenate([rare, pair, three])
                code = np.concatenate([codes(key[rare], np.full(len(rare), t.end + 1)), code[pair - 1], codes(code[three - 2], code[three - 1])])
                some = among(bits, code)
                of = which[at]
                none = int(some.sum())
                part = batch.slice(i, len(rows))
                whole = [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(np.append(starts, len(x))) - 1), *map(pa.array, sums)]
                # a document's own row takes nothing from the table
                own = pa.StructArray.from_arrays(whole, names=["doc_id", "held_out", "n_tokens", "known", "base", "gain"])
                arrays = [np.append(of[some], rows), np.append(code[some], codes(rows, np.full(len(rows), t.end + 2)))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.concat_arrays([pa.nulls(none, own.type), own])], names=["row", "code", "own"])

    joined = docs.select("doc_id", "held_out", "text").mapInArrow(run, schema).join(table.select("code", "base", "known", "gain"), "code", "left")
    more = F.col("own").isNull()
    total = [(F.max(f"own.{c}") + F.sum(F.when(more, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)))).alias(c) for c in ("known", "base", "gain")]
    out = joined.groupBy("row").agg(*(F.max(f"own.{c}").alias(c) for c in ("doc_id", "held_out", "n_tokens")), *total)
    base = F.col("base") - F.col("n_tokens") * F.lit(math.log10(tree.tokens + 1 + tree.distinct))
    return out.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(tree.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))
