"""N-gram Jaccard join by chosen paths.

Texts of equal words are one representative.  A representative's set of
five-word shingles is stood for by its min-hashes: two sets agree on a
coordinate with the probability of their Jaccard similarity.  In each run,
every node samples one or two coordinates (1 / threshold on average) and
splits its sets by their values there; nodes of up to ``leaf`` sets are
compared by brute force, larger ones are split again, up to ``depth``
levels.  A pair at the threshold meets in a run with a probability that
``meeting`` computes, and the runs are repeated until the chance of missing
it is under 1 - ``recall``.

In a node, min-hashes choose pairs worth a look, and only sets that have one
are verified: their texts come to the node and all similarities are computed
exactly.  A pair that shares several nodes counts in the smallest one only,
so nothing is emitted for pairs: a task returns a number of links for each
set and edges to the smallest member of each connected group.  Nodes over
``leaf`` sets at the last level are compared in chunks, a task for each two.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_groups, narrowed, numbered, parted, prepare, slices, spread_join, written
from .components import connected_components
from .shingling import WORDS, mixed, portions, shingle_sets

#: Parameters: similarity, coordinates, chance that a pair at the threshold is
#: found, levels, sets in a node that is not split further, sets in a chunk,
#: and standard deviations that a sketch may be off by.
THRESHOLD, COORDINATES, RECALL, DEPTH, LEAF, CHUNK, SLACK = 0.8, 128, 0.9999, 4, 1024, 512, 4.5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 2**32, COORDINATES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)


def min_hashes(items: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """uint32 minimum of each hash function; blocks bound the memory."""
    low = (items >> np.uint64(32)).astype(np.uint32) ^ items.astype(np.uint32)
    best = np.full(COORDINATES, 2**32 - 1, dtype=np.uint32)
    for a in range(0, len(low), 4096):
        v = low[a : a + 4096, None] * by[0] + by[1]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x85EBCA6B)
        best = np.minimum(best, v.min(0))
    return best


def meeting(threshold: float, depth: int) -> float:
    """Chance that a pair at the threshold shares a node at the last level."""
    p, two = 1.0, 1 / threshold - 1
    for _ in range(depth):
        q = threshold * p
        p = (1 - two) * q + two * (1 - (1 - q) ** 2)
    return p


def runs_for(recall: float, threshold: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(threshold, depth)))


def children(node: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of each coordinate that a row's node samples."""
    seed = mixed(node)
    first = seed % np.uint64(COORDINATES)
    other = (first + np.uint64(1) + (seed >> np.uint64(20)) % np.uint64(COORDINATES - 1)) % np.uint64(COORDINATES)
    twice = (seed >> np.uint64(40)) % np.uint64(1 << 20) < np.uint64(int((1 / threshold - 1) * (1 << 20)))
    rows = np.arange(len(node))
    rows = np.concatenate([rows, rows[twice]])
    at = np.concatenate([first, other[twice]])
    value = sketch[rows, at.astype(np.int64)].astype(np.uint64)
    return rows, mixed(mixed(seed[rows] + at) ^ (value * _MIX))


def sketches(documents: DataFrame, threshold: float, n_runs: int) -> DataFrame:
    """doc, key (of the word sequence), empty, sketch (the low 16 bits of each
    min-hash) and starts: the nodes of the first level.  Those come from all
    32 bits, as every set of a run is split by the same coordinates there;
    deeper nodes hold few enough sets for 16 bits."""
    by = coefficients()

    def run(batches):
        for batch in batches:
            for a, b in portions(batch.column("text")):
                part = batch.slice(a, b - a)
                words = [b" ".join((t or "").encode().split()) for t in part.column("text").to_pylist()]
                keys = [hashlib.blake2b(w, digest_size=16).digest() for w in words]
                s = np.array([min_hashes(x, by) for x in shingle_sets(part.column("text"))]).reshape(-1, COORDINATES)
                node = np.repeat(np.arange(n_runs, dtype=np.uint64) + np.uint64(1), len(s))
                rows, child = children(node, np.tile(s, (n_runs, 1)), threshold)
                rows %= len(s)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(s)))])
                starts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(child[np.argsort(rows, kind="stable")].view(np.int64)))
                short = pa.array([x.tobytes() for x in s.astype(np.uint16)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(keys, pa.binary()), pa.array([not w for w in words], pa.bool_()), short, starts], names=["doc", "key", "empty", "sketch", "starts"])

    return documents.select("doc", "text").mapInArrow(run, "doc long, key binary, empty boolean, sketch binary, starts array<long>")


def sketch_matrix(column, kind=np.uint16) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def packed(sketch: np.ndarray) -> np.ndarray:
    """The low 4 bits of each min-hash, two in a byte: enough to choose the
    pairs of a node, as unlike sets agree with 1 / 16 more."""
    low = (sketch & 15).astype(np.uint8)
    return low[:, ::2] | low[:, 1::2] << 4


def packed_rows(batches):
    for b in batches:
        s = packed(sketch_matrix(b.column("sketch"))) if b.num_rows else []
        yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([x.tobytes() for x in s], pa.binary())], names=["rep", "sketch"])


def least_agreement(threshold: float) -> int:
    """Packed coordinates that two sets at the threshold share at least, but
    for a chance of ``SLACK`` standard deviations."""
    p = threshold + (1 - threshold) / 16
    return int(COORDINATES * p - SLACK * math.sqrt(COORDINATES * p * (1 - p)))


def leaves(reps: DataFrame, threshold: float, depth: int, leaf: int) -> DataFrame:
    """(node, rep, size): the nodes of at least two sets where paths end."""

    def deeper(batches):
        for b in batches:
            s = sketch_matrix(b.column("sketch")) if b.num_rows else np.empty((0, COORDINATES), dtype=np.uint16)
            rows, child = children(b.column("node").to_numpy().view(np.uint64), s, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("rep").take(pa.array(rows))], names=["node", "rep"])

    # a set comes to a node by one path, so no pair occurs twice
    level, done = reps.select(F.explode("starts").alias("node"), "rep"), None
    for d in range(depth):
        level = written(level, "paths") if d else level
        sizes = written(level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "path-sizes")
        sized = written(spread_join(level, sizes, ["node"], sizes.withColumnRenamed("size", "n")), "sized-paths")
        ends = sized if d == depth - 1 else sized.where(F.col("size") <= leaf)
        done = ends if done is None else done.unionByName(ends)
        if d == depth - 1 or sizes.where(F.col("size") > leaf).isEmpty():
            break
        large = written(sized.where(F.col("size") > leaf).select("node", "rep"), "large-nodes")
        level = large.join(narrowed(reps.select("rep", "sketch"), "rep", large, "rep"), "rep").mapInArrow(deeper, "node long, rep long")
    return done


def _first_common(paths: list[np.ndarray], a: np.ndarray, b: np.ndarray, node: int) -> np.ndarray:
    """Whether ``node`` is the smallest node that both of each pair have, by
    the upper 32 bits of nodes."""
    out = np.ones(len(a), dtype=bool)
    early = [p[: np.searchsorted(p, node)] for p in paths]
    codes, inverse = np.unique(np.concatenate(early) if early else [], return_inverse=True)
    if not len(codes):
        return out
    marks = np.zeros((len(paths), len(codes)), dtype=bool)
    marks[np.repeat(np.arange(len(early)), [len(e) for e in early]), inverse] = True
    for k in range(0, len(a), 1 << 14):
        out[k : k + (1 << 14)] = ~(marks[a[k : k + (1 << 14)]] & marks[b[k : k + (1 << 14)]]).any(1)
    return out


def _pairs(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a task: of a chunk's own rows (side 0), or between its first
    chunk (1) and its second (2)."""
    if side[0] == 0:
        return np.triu_indices(len(side), 1)
    a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _candidates(table: pa.Table, least: int) -> np.ndarray:
    """Rows of one task that have a pair to verify here."""
    side = table.column("side").to_numpy()
    a, b = _pairs(side)
    s = sketch_matrix(table.column("sketch"), np.uint8)
    near = [np.empty(0, dtype=bool)]
    for k in range(0, len(a), 8192):
        x = s[a[k : k + 8192]] ^ s[b[k : k + 8192]]
        near.append(((x & 15 == 0).sum(1) + (x & 240 == 0).sum(1)) >= least)
    near = np.concatenate(near)
    a, b = a[near], b[near]
    if len(a):
        first = _first_common([np.array(p) for p in table.column("paths").to_pylist()], a, b, table.column("node")[0].as_py() >> 32)
        a, b = a[first], b[first]
    return np.unique(np.concatenate([a, b]))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: a product over the items that occur twice."""
    flat = np.concatenate(sets)
    codes, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = n > 1
    number = np.cumsum(shared) - 1
    use = shared[inverse]
    rows, cols = rows[use], number[inverse[use]]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for a in range(0, int(shared.sum()), 4096):
        here = (cols >= a) & (cols < a + 4096)
        m = np.zeros((len(sets), min(4096, int(shared.sum()) - a)), dtype=np.float32)
        m[rows[here], cols[here] - a] = 1
        total += m @ m.T
    return total


def _links(table: pa.Table, threshold: float) -> list[tuple[int, int, int]]:
    """(rep, links weighted by copies, smallest member of its group here)."""
    side, reps = table.column("side").to_numpy(), table.column("rep").to_numpy()
    copies = table.column("copies").to_numpy()
    sets = shingle_sets(table.column("text").combine_chunks())
    size = np.array([len(s) for s in sets], dtype=np.float64)
    a, b = _pairs(side)
    if len(sets) == 2:
        both = np.array([len(np.intersect1d(*sets, assume_unique=True))], dtype=np.float64)[: len(a)]
    else:
        both = intersections(sets)[a, b].astype(np.float64)
    alike = both >= threshold * (size[a] + size[b] - both) - 1e-9
    a, b = a[alike], b[alike]
    if len(a):
        first = _first_common([np.array(p) for p in table.column("paths").to_pylist()], a, b, table.column("node")[0].as_py() >> 32)
        a, b = a[first], b[first]
    links = np.bincount(a, weights=copies[b], minlength=len(reps)) + np.bincount(b, weights=copies[a], minlength=len(reps))
    label = np.arange(len(reps))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    smallest = np.full(len(reps), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, reps)
    return [(int(r), int(n), int(m)) for r, n, m in zip(reps, links, smallest[label], strict=True) if n]


def tasks(members: DataFrame, chunk: int, leaf: int) -> DataFrame:
    """Deals a node's members to tasks: (node, i, j, side)."""
    n = F.when(F.col("size") <= chunk, 1).otherwise(F.ceil(F.col("size") / chunk)).cast("int")
    members = members.withColumn("chunks", n).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return members.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": side}).drop("own", "other", "chunks", "size")


def similar_texts(documents: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``documents``.

    Rows link if the Jaccard similarity of their sets of five-word shingles
    (words: as cut by ASCII blanks; fewer than five words: one shingle) is
    ``threshold`` or more.  class_id: smallest doc_id of the connected group,
    null if none of its rows has one; n_links: rows linked to, copies
    included.  Null texts and those without words link to nothing.  Texts
    that share a doc_id, or have none, are compared like others; repeated
    rows are copies; an empty table gives no rows; other columns are ignored.
    """
    docs, names = numbered(documents.select("doc_id", F.col(text_col).alias("text")))
    out = _linked(docs.select(F.col("_doc").alias("doc"), "text"), names is not None, threshold, recall, depth, leaf, chunk)
    if names is None:
        return out.withColumnsRenamed({"doc": "doc_id", "class": "class_id"}).select("doc_id", "class_id", "n_links")
    out = out.join(names.select(F.col("_doc").alias("doc"), "doc_id"), "doc")
    return out.join(names.select(F.col("_doc").alias("class"), F.col("doc_id").alias("class_id")), "class").select("doc_id", "class_id", "n_links")


def _linked(docs: DataFrame, repeated: bool, threshold: float, recall: float, depth: int, leaf: int, chunk: int) -> DataFrame:
    """doc, class (smallest doc of the group), n_links for rows (doc, text);
    ``repeated``: whether a doc may have several, equal rows."""
    prepare(docs.sparkSession)
    whole = written(sketches(docs, threshold, runs_for(recall, threshold, depth)), "sketches")
    filled = whole.where("not empty")
    # a representative is named by the smallest doc of its key, which no other key has
    classes = filled.groupBy("key").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("starts").alias("starts"))
    reps = written(classes.withColumn("rep", F.col("doc")), "reps")
    members = written(leaves(reps, threshold, depth, leaf), "nodes")
    paths = members.groupBy("rep").agg(F.array_sort(F.collect_set(F.shiftright("node", 32).cast("int"))).alias("paths"))  # some nodes a run
    known = narrowed(reps.select("rep", "sketch"), "rep", members, "rep").mapInArrow(packed_rows, "rep long, sketch binary").join(paths, "rep")
    keys, n = ["node", "i", "j"], "node long, i int, j int, side int, rep long"
    dealt = tasks(members, chunk, leaf).join(known, "rep")
    dealt = dealt.select(*keys, "side", "rep", "sketch", "paths").repartition(*keys).sortWithinPartitions(*keys)
    least = least_agreement(threshold)

    def choose(batches):
        for t in keyed_groups(batches, keys):
            take = [a + r for a, b in slices(t, keys) if b - a > 1 for r in _candidates(t.slice(a, b - a), least)]
            yield from t.select([*keys, "side", "rep", "paths"]).take(pa.array(take, pa.int64())).to_batches()

    chosen = written(dealt.mapInArrow(choose, f"{n}, paths array<int>"), "chosen")
    wanted = written(reps.select("rep", "doc", "copies").join(chosen.select("rep").distinct(), "rep"), "wanted")
    text = narrowed(docs, "doc", wanted, "doc")
    text = (text.dropDuplicates(["doc"]) if repeated else text).join(wanted, "doc")
    keyed = chosen.join(text, "rep").select(*keys, "side", "rep", "copies", "paths", "text").repartition(*keys).sortWithinPartitions(*keys, "rep")

    def verify(batches):
        for t in keyed_groups(batches, keys):
            out = [x for a, b in slices(t, keys) if b - a > 1 for x in _links(t.slice(a, b - a), threshold)]
            yield pa.RecordBatch.from_pydict({k: [r[i] for r in out] for i, k in enumerate(("rep", "links", "low"))}, schema=pa.schema({"rep": pa.int64(), "links": pa.int64(), "low": pa.int64()}))

    found = written(keyed.mapInArrow(verify, "rep long, links long, low long"), "links")
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    each = reps.select("rep", "doc", "key", "copies").join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    each = written(each.select("key", "doc", F.coalesce("label", "rep").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    names = written(each.groupBy("label").agg(F.min("doc").alias("class")), "class-names")
    each = written(each.select("key", "label", "n_links").join(names, "label").drop("label"), "named")
    linked = whole.select("doc", "key", "empty").join(each, "key", "left")
    return linked.select("doc", F.coalesce("class", "doc").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(documents: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """The documents without those that link, directly or through others, to
    an earlier one (smaller doc_id, null ids last; texts of one id in an
    order of their own); of repeated rows one stays.  Columns as they are."""
    columns = documents.columns
    docs, names = numbered(documents.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")))
    classes = _linked(docs.select(F.col("_doc").alias("doc"), "text"), names is not None, threshold, recall, depth, leaf, chunk)
    gone = written(classes.where("class <> doc").select(F.col("doc").alias("_doc")).distinct(), "gone")
    # only rows that may go are joined; the texts of the others stay where they are
    maybe, stay = parted(docs.select("_doc", "_row"), "_doc", gone, "_doc")
    docs = maybe.join(gone, "_doc", "left_anti").unionByName(stay)
    return (docs if names is None else docs.dropDuplicates(["_doc"])).select("_row.*")
