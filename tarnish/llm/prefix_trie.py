"""Trie of the prefixes that conversations share.

A prefix is named by 128 bits: the exclusive or of a hash of each of its
turns with the turn's depth, so prefix digests are running aggregates and a
very long conversation is cut into blocks.  A count-min sketch over the
digests screens them: an estimate of one proves that a single conversation
has the prefix, and its node is emitted in place.  Only prefixes that may be
shared are shuffled, and grouped exactly; what the sketch can't prove costs
work, never rows.

Sums over subtrees need no walk of the tree.  A conversation stands for the
nodes of which it is the smallest member, the lower end of its own path; so
a leaf counts once for its conversation, and a repeated turn once for each
conversation that passes it above its own end.  Both are sums over the
members of a node.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, positions, prepare, spread_join, written

#: Rows of the sketch, the least and most bits of their width (at most
#: ROWS * 2**MOST bytes are broadcast, whatever the input), cells in a block.
ROWS, LEAST, MOST, CELLS = 3, 12, 24, 4096
#: Turns of a conversation, and conv_ids of a node, that one task takes.
BLOCK, PIECE = 1024, 4096


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, ta, tb, words, _pos, _n) of all turns in their order; turns of
    one number are ordered by a hash of role and text.  Rows without a
    conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(F.lit(1), role, text).alias("ta"), F.xxhash64(F.lit(2), text, role).alias("tb"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return positions(rows, "conv", [F.asc_nulls_first("turn"), F.col("ta"), F.col("tb")], "turns").drop("turn")


def rebuilt(ordered: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv) and their rebuilt turns (conv, ta, tb, words,
    _pos, _n): the first h of the conversation conv - conv % ``every``, then
    the own ones after the first h; h is crc32(conv) % ``heads``."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = written(ordered.where("_pos = 0").select("conv"), "conversations")
    first = ordered.where((F.col("conv") % every == 0) & (F.col("_pos") < heads - 1))
    first = first.groupBy(F.col("conv").alias("_from")).agg(F.collect_list(F.struct("_pos", "ta", "tb", "words")).alias("_head"))  # heads - 1 turns at most
    taken = convs.withColumn("_from", F.col("conv") - F.col("conv") % every).join(first, "_from").select("conv", F.inline("_head")).where(F.col("_pos") < h)
    own = ordered.where(F.col("_pos") >= h)
    both = [rows.select("conv", F.lit(k).alias("_side"), F.col("_pos").alias("_ord"), "ta", "tb", "words") for k, rows in enumerate((taken, own))]
    return convs, positions(both[0].unionAll(both[1]), "conv", [F.col("_side"), F.col("_ord")], "rebuilt").drop("_side", "_ord")


def prefixes(rows: DataFrame) -> DataFrame:
    """A row for each prefix of a conversation: conv, depth, last (it is the
    whole conversation), digest (a, b), that of its parent (pa, pb; zeros
    for the root), words of its last turn and of those before."""
    depth = F.col("_pos") + 1
    rows = rows.select("conv", depth.alias("depth"), (depth == F.col("_n")).alias("last"), F.expr(f"_pos div {BLOCK}").alias("_block"), F.xxhash64("ta", "tb", depth).alias("xa"), F.xxhash64("tb", depth, "ta").alias("xb"), "words", (F.col("_n") > BLOCK).alias("_long"))
    sums = [F.bit_xor("xa").alias("a"), F.bit_xor("xb").alias("b"), F.sum("words").alias("before")]
    blocks = rows.where("_long").groupBy("conv", "_block").agg(*sums)
    earlier = Window.partitionBy("conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for BLOCK turns
    blocks = blocks.select("conv", "_block", F.bit_xor("a").over(earlier).alias("_a"), F.bit_xor("b").over(earlier).alias("_b"), F.sum("before").over(earlier).alias("_before"))
    within = Window.partitionBy("conv", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a": F.bit_xor("xa").over(within), "b": F.bit_xor("xb").over(within), "before": F.sum("words").over(within) - F.col("words")})
    rows = rows.join(blocks, ["conv", "_block"], "left")
    a, b = (F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))) for c in ("a", "b"))
    up = lambda x, own: F.when(F.col("depth") == 1, F.lit(0)).otherwise(x.bitwiseXOR(F.col(own)))
    return rows.select("conv", "depth", "last", a.alias("a"), b.alias("b"), up(a, "xa").cast("long").alias("pa"), up(b, "xb").cast("long").alias("pb"), "words", (F.col("before") + F.coalesce("_before", F.lit(0))).alias("before"))


def places(a: np.ndarray, b: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cells of digests in a row of the sketch (double hashing)."""
    return ((a.view(np.uint64) + np.uint64(row) * (b.view(np.uint64) | np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """Count-min sketch of the digests (a, b), counts over one kept as two.

    Each task counts its rows and hands on the blocks that aren't empty;
    tasks that hold the blocks of one place add them up, one at a time.
    """
    prepare(rows.sparkSession)

    def count(batches):
        cells = np.zeros(ROWS << bits, dtype=np.uint8)
        for batch in batches:
            a, b = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("a", "b"))
            for k in range(ROWS):
                at, n = np.unique(places(a, b, k, bits) + (k << bits), return_counts=True)
                cells[at] = np.minimum(cells[at] + np.minimum(n, 2), 2)
        blocks = cells.reshape(-1, CELLS)
        for part in np.array_split(used := np.flatnonzero(blocks.any(1)), -(-len(used) // 1024) or 1):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([blocks[i].tobytes() for i in part], pa.binary())], names=["block", "cells"])

    def add(batches):
        now, held = -1, None
        for batch in batches:
            out = []
            for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                more = np.frombuffer(cells, dtype=np.uint8)
                if block != now:
                    out += [(now, held)] if held is not None else []
                    now, held = block, more
                else:
                    held = np.minimum(held + more, 2)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([v.tobytes() for _, v in out], pa.binary())], names=["block", "cells"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["block", "cells"])

    schema = "block long, cells binary"
    parts = rows.select("a", "b").mapInArrow(count, schema)
    added = parts.repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block").mapInArrow(add, schema)
    table = np.zeros(ROWS << bits, dtype=np.uint8).reshape(-1, CELLS)
    got = added.toArrow()  # the sketch: ROWS << bits bytes at most
    for block, cells in zip(got.column("block").to_pylist(), got.column("cells").to_pylist(), strict=True):
        table[block] = np.frombuffer(cells, dtype=np.uint8)
    return table.reshape(ROWS, -1)


def screened(rows: DataFrame, bits: int | None = None) -> DataFrame:
    """``rows`` with ``single`` and ``parent_single``: the sketch proves that
    the prefix, or its parent, belongs to one conversation only."""
    spark = rows.sparkSession
    if bits is None:  # eight cells for each prefix, as far as the bound goes
        bits = min(MOST, max(LEAST, math.ceil(math.log2(8 * rows.count() + 1))))
    shared = spark.sparkContext.broadcast(sketch(rows, bits))

    def single(a, b):
        return np.minimum.reduce([shared.value[k][places(a, b, k, bits)] for k in range(ROWS)]) == 1

    def run(batches):
        for batch in batches:
            a, b, up_a, up_b = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("a", "b", "pa", "pb"))
            deep = np.asarray(batch.column("depth").to_numpy(zero_copy_only=False)) > 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single(a, b)), pa.array(single(up_a, up_b) & deep)], names=[*batch.schema.names, "single", "parent_single"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", single boolean, parent_single boolean"
    return rows.mapInArrow(run, schema)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of (a, b, conv): SHA-256 of a node's conv_ids,
    ascending, between commas.

    Ids are joined in pieces, in parallel; where a node has several, one
    task reads them in order and hashes as it goes.
    """
    ranked = positions(ends.select(F.struct("a", "b").alias("node"), "conv"), "node", [F.col("conv")], "ends")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ranked.groupBy("node", F.expr(f"_pos div {PIECE}").alias("_piece"), "_n").agg(text.alias("ids"))
    pieces = written(pieces.select("node.a", "node.b", "_piece", "_n", "ids"), "pieces")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if now != (a, b):
                    out += [(*now, digest.hexdigest())] if now else []
                    now, digest = (a, b), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield from rows_of(out)
        yield from rows_of([(*now, digest.hexdigest())] if now else [])

    def rows_of(out):
        if out:
            a, b, d = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.string())], names=["a", "b", "ends_sha256"])

    many = pieces.where(F.col("_n") > PIECE).select("a", "b", "_piece", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "_piece")
    one = pieces.where(F.col("_n") <= PIECE).select("a", "b", F.sha2("ids", 256).alias("ends_sha256"))
    return one.unionByName(many.mapInArrow(run, "a long, b long, ends_sha256 string"))


def trie(convs: DataFrame, rows: DataFrame, bits: int | None = None) -> DataFrame:
    """Nodes of the trie over the prefixes ``rows`` of ``convs``."""
    spark = rows.sparkSession
    prepare(spark)
    none = F.sha2(F.lit(""), 256)
    rows = written(screened(written(rows, "prefixes"), bits), "screened")
    alone, maybe = rows.where("single"), rows.where("not single")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("a"), zero.alias("b"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("pa"), zero.alias("pb"), zero.alias("before"), F.lit(True).alias("parent_single"))
    nodes = maybe.groupBy("a", "b").agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("before").alias("before"), F.min("parent_single").alias("parent_single"))
    nodes = written(nodes.unionByName(root), "nodes")
    inner = nodes.where("depth > 0")

    # children whose parent is in nodes, and their counts
    tails = alone.where("not parent_single").select("pa", "pb", F.col("conv").alias("conv_id"), "depth", "last", zero.alias("a"), zero.alias("b"), F.lit(True).alias("alone"))
    inside = inner.where("not parent_single").select("pa", "pb", "conv_id", "depth", F.lit(False).alias("last"), "a", "b", F.lit(False).alias("alone"))
    children = tails.unionByName(inside)
    counts = written(children.groupBy("pa", "pb").agg(F.count("*").alias("n")), "children-counts")
    nodes = nodes.join(counts.select(F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("n").alias("n_children")), ["a", "b"], "left").na.fill(0, ["n_children"])
    nodes = written(nodes, "nodes-with-children")

    # of each conversation: words above the end that it stands for, and whether it stands for a leaf
    own = alone.select("conv", "before", "last", F.lit(None).cast("long").alias("total"))
    own = own.unionByName(nodes.select(F.col("conv_id").alias("conv"), "before", (F.col("n_children") == 0).alias("last"), F.lit(None).cast("long").alias("total")))
    own = own.unionByName(maybe.where("last").select("conv", F.lit(None).cast("long").alias("before"), F.lit(False).alias("last"), (F.col("before") + F.col("words")).alias("total")))
    own = own.groupBy("conv").agg(F.min("before").alias("before"), F.max("last").alias("leaf"), F.max("total").alias("total"))
    own = written(own.select("conv", F.coalesce("before", "total").alias("above"), F.col("leaf").cast("long").alias("leaf")), "stands-for")
    sums = [F.sum(F.greatest(F.col("above") - F.col("before"), zero)).alias("saved_tokens"), F.sum("leaf").alias("n_leaves")]
    parts = maybe.select("conv", "a", "b", "before").join(own, "conv").groupBy("a", "b").agg(*sums)
    whole = own.withColumn("before", zero).agg(*sums).select(zero.alias("a"), zero.alias("b"), "saved_tokens", "n_leaves")  # one row

    ended = maybe.where("last").select("a", "b", "conv")
    empty = convs.join(rows.where("last").select("conv"), "conv", "left_anti").select(zero.alias("a"), zero.alias("b"), "conv")
    ends = ends_digest(ended.unionByName(empty))
    facts = nodes.join(parts.unionByName(whole), ["a", "b"], "left").join(ends, ["a", "b"], "left")
    facts = written(facts.select("a", "b", "conv_id", "depth", "n_convs", "n_children", F.greatest(F.coalesce("n_leaves", zero), F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"), "parent_single"), "facts")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    one = F.lit(1).cast("long")

    def tail(df: DataFrame, conv: str, parent) -> DataFrame:
        last = F.col("last")
        digest = F.when(last, F.sha2(F.col(conv).cast("string"), 256)).otherwise(none)
        return df.select(F.col(conv).alias("conv_id"), "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), digest.alias("ends_sha256"))

    known = spread_join(children, nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id")), ["pa", "pb"], counts)
    known = written(known, "children-with-parents")
    parents = known.where("not alone").select("a", "b", "parent_conv_id")
    inner = facts.where("depth > 0").join(parents, ["a", "b"], "left").withColumn("parent_conv_id", F.when(F.col("parent_single"), F.col("conv_id")).otherwise(F.col("parent_conv_id")))
    top = facts.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = tail(alone.where("parent_single"), "conv", F.col("conv")).unionByName(tail(known.where("alone"), "conv_id", F.col("parent_conv_id")))
    return out.unionByName(inner.select(*columns)).unionByName(top.select(*columns))


def conversation_trie(conversations: DataFrame, bits: int | None = None) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations: conv_id
    (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    Null roles and texts are empty ones, null turns come first, turns of one
    number and repeated rows are turns each (ordered by a hash), rows of a
    null conv_id are left out; texts of any length are hashed whole.  Other
    columns are ignored; an empty table gives no rows.
    """
    convs, rows = rebuilt(turns(conversations))
    return trie(convs, prefixes(rows), bits)


#: The same by lists: every prefix of a conversation as a JSON string, and
#: every node's ancestors.
SQL = r"""
WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
    lambda a, b: xor(a >> 8, t.t[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o), t),
b AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 WHERE pos < h
  UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN o USING (conv_id) WHERE pos >= h),
s AS (SELECT c.conv_id, coalesce(list({'r': role, 't': text} ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS seq FROM c LEFT JOIN b USING (conv_id) GROUP BY 1),
p AS (SELECT conv_id, len(seq) AS n, seq, unnest(range(0, len(seq) + 1)) AS d FROM s),
k AS (SELECT conv_id, n, d, md5(to_json(seq[1:d])::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(to_json(seq[1:d - 1])::VARCHAR) END AS up, CASE WHEN d > 0 THEN len(regexp_extract_all(seq[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words,
    list_transform(range(0, d + 1), lambda i: md5(to_json(seq[1:i])::VARCHAR)) AS line FROM p),
g AS (SELECT node, any_value(d) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(line) AS line,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM k GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n FROM g WHERE up IS NOT NULL GROUP BY up),
w AS (SELECT unnest(line) AS node, (n_convs - 1) * words AS saved, (kids.n IS NULL)::INT AS leaf FROM g LEFT JOIN kids USING (node)),
z AS (SELECT node, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM w GROUP BY node)
SELECT g.conv_id, g.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, g.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, z.n_leaves, z.saved_tokens, g.ends_sha256
FROM g LEFT JOIN g q ON q.node = g.up LEFT JOIN kids ON kids.node = g.node JOIN z ON z.node = g.node
"""
