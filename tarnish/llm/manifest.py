"""Merkle manifest of a dataset: proofs that a row belongs to it.

Every row is a leaf, leaves form a tree for each partition of the dataset
(here: language), and the partitions' subroots form the tree that ends in
the root.  A level is built by a slot pivot: conditional aggregates spread
the children of a parent into ``fanout`` columns; the concatenated columns
are its hash, and the concatenation without a child's own column are the
siblings that its proof needs.  As many levels as fit in ``SLOTS`` columns
are pivoted in one shuffle, so 10^10 leaves need nine of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positions, written

#: Columns that one shuffle spreads a group of leaves into.
SLOTS = 16


def framed(value: Column) -> Column:
    """``-`` for null, otherwise byte count, colon and value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def joined(parts: list[Column]) -> Column:
    """Concatenation without the nulls."""
    return F.concat_ws("", *parts) if parts else F.lit("")


def _depth(fanout: int) -> int:
    """Levels that one round of pivots covers."""
    depth = 1
    while fanout ** (depth + 1) <= SLOTS:
        depth += 1
    return depth


def pivoted(nodes: DataFrame, fanout: int, kept: tuple[str, ...] = ()) -> DataFrame:
    """A row for each run of fanout ** depth nodes (_tree, _pos, _n, hash):
    columns ``c<level>_<slot>`` with the nodes of each level, the last level
    a single one; ``k<slot>`` holds the ``kept`` columns of the nodes.

    _n is the number of a tree's nodes at this level: a lone node is its
    tree's top and isn't hashed again.
    """
    depth = _depth(fanout)
    width = fanout**depth
    slot = F.col("_pos") % width
    value = F.struct("hash", *kept)
    spread = [F.max(F.when(slot == i, value)).alias(f"s{i}") for i in range(width)]
    rows = nodes.groupBy("_tree", F.expr(f"_pos div {width}").alias("_group"), "_n").agg(*spread)
    rows = rows.select("_tree", "_group", "_n", *[F.col(f"s{i}.hash").alias(f"c0_{i}") for i in range(width)], *([F.col(f"s{i}").alias(f"k{i}") for i in range(width)] if kept else []))
    for level in range(1, depth + 1):
        many = F.col("_n") > fanout ** (level - 1)
        made = []
        for i in range(fanout ** (depth - level)):
            children = [F.col(f"c{level - 1}_{i * fanout + j}") for j in range(fanout)]
            made.append(F.when(many & children[0].isNotNull(), F.sha2(joined(children), 256)).otherwise(children[0]).alias(f"c{level}_{i}"))
        rows = rows.select("*", *made)
    return rows


def climbed(leaves: DataFrame, fanout: int, kept: tuple[str, ...], name: str) -> list[DataFrame]:
    """The pivoted rounds of all trees, leaves first, each as a table."""
    depth = _depth(fanout)
    most = leaves.agg(F.max("_n")).first()[0] or 1
    rounds = [written(pivoted(leaves, fanout, kept), f"{name}-0")]
    while most > fanout**depth:
        most = -(-most // fanout**depth)
        below = rounds[-1].select("_tree", F.col("_group").alias("_pos"), F.ceil(F.col("_n") / fanout**depth).alias("_n"), F.col(f"c{depth}_0").alias("hash"))
        rounds.append(written(pivoted(below, fanout), f"{name}-{len(rounds)}"))
    return rounds


def tops(rounds: list[DataFrame], fanout: int) -> DataFrame:
    """(_tree, hash): the root of each tree."""
    return rounds[-1].select("_tree", F.col(f"c{_depth(fanout)}_0").alias("hash"))


def descended(rounds: list[DataFrame], above: DataFrame, fanout: int, kept: tuple[str, ...] = ()) -> DataFrame:
    """Leaves with ``path``: for each hash up to the root the siblings left
    and right of the way.

    above: (_tree, path, more columns), what follows after a tree's own
    root.  Rows: _tree, hash, the kept columns, path and above's columns.
    """
    depth = _depth(fanout)
    width = fanout**depth
    more = [c for c in above.columns if c not in ("_tree", "path")]
    way = above.withColumn("_group", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, -1, -1):
        rows = rounds[k].join(way, ["_tree", "_group"])
        slots = []
        for i in range(width):
            steps = []
            for level in range(depth):
                at = i // fanout**level
                own, first = at % fanout, at // fanout * fanout
                side = lambda js, level=level, first=first: joined([F.col(f"c{level}_{first + j}") for j in js])
                pair = F.struct(side(range(own)).alias("l"), side(range(own + 1, fanout)).alias("r"))
                steps.append(F.when(F.col("_n") > fanout**level, pair))
            extra = [] if k else [F.col(f"k{i}.{c}").alias(c) for c in kept]
            slots.append(F.struct(F.lit(i).cast("long").alias("_slot"), F.col(f"c0_{i}").alias("hash"), *extra, F.array_compact(F.array(*steps)).alias("_steps")))
        rows = rows.select("_tree", "_group", "path", *more, F.inline(F.array(*slots))).where("hash is not null")
        path = F.concat("_steps", "path").alias("path")
        way = rows.select("_tree", (F.col("_group") * width + F.col("_slot")).alias("_group"), *([] if k else ["hash", *kept]), path, *more)
    return way.drop("_group")


def proofs(leaves: DataFrame, fanout: int = 2, kept: tuple[str, ...] = ()) -> DataFrame:
    """Proofs of all leaves (_tree, _order, hash, kept columns).

    Within a tree leaves ascend by _order, then hash; trees ascend by
    _tree, a string.  Returns hash, the kept columns, subroot, root and
    path, an array of (l, r): folding a leaf's hash h by
    ``sha2(concat(l, h, r), 256)`` over it gives the root.
    """
    trees = positions(leaves, "_tree", [F.asc_nulls_first("_order"), F.col("hash")], "leaves")
    low = climbed(trees, fanout, kept, "leaf-levels")
    sub = written(tops(low, fanout).select(F.lit("").alias("_tree"), F.col("_tree").alias("_order"), "hash"), "subroots")
    high = climbed(positions(sub, "_tree", [F.col("_order"), F.col("hash")], "subroots-ranked"), fanout, ("_order",), "root-levels")
    start = tops(high, fanout).select("_tree", F.col("hash").alias("root"), F.expr("cast(array() as array<struct<l:string,r:string>>)").alias("path"))
    ways = descended(high, start, fanout, ("_order",)).select(F.col("_order").alias("_tree"), "path", F.col("hash").alias("subroot"), "root")
    return descended(low, written(ways, "subroot-ways"), fanout, kept).drop("_tree")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hash and its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["l"], h, step["r"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["l"], step["r"])), "")


def tampered_proofs(documents: DataFrame, fanout: int = 2) -> DataFrame:
    """Proof of every document, and what its check says after tampering.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.  Where
    7 divides the crc32 of the decimal doc_id, n_chars is one more in the
    leaf that is folded (a null stays; a null doc_id isn't tampered with).

    Null doc_ids come first in their language, rows of one doc_id ascend by
    leaf; repeated rows have equal leaves and a proof each.  Null, empty and
    long texts are values as any other.  Other columns are ignored; an empty
    table gives no rows.
    """
    id_ = F.col("doc_id").cast("long")
    values = [id_, F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), F.col("text")]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    bad = F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null is before all
    rows = documents.select(tree.alias("_tree"), id_.alias("_order"), leaf_hash(*values).alias("hash"), F.when(bad, leaf_hash(*values[:3], more, values[4])).alias("changed"))
    out = proofs(written(rows, "leaves"), fanout, ("_order", "changed"))
    out = out.withColumn("folded_root", fold(F.coalesce("changed", "hash"), F.col("path")))
    return out.select(F.col("_order").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same by recursion over levels; crc32 from its table of 256 remainders.
SQL = r"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
c AS (SELECT *, coalesce('=' || lang, '') AS k, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
    lambda a, b: xor(a >> 8, t.t[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 7 = 0 AS bad FROM documents, t),
p AS (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM c),
l AS (SELECT doc_id, k, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN bad AND n_chars IS NOT NULL THEN sha256(head || length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS changed FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM l),
a AS (SELECT k, 0 AS lvl, pos, n, leaf AS h FROM r
  UNION ALL SELECT k, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY k, lvl, n, pos // 2),
s AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY encode(k)) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
b AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM s
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY lvl, n, pos // 2),
e AS (SELECT r.k, r.pos, o.lvl, o.pos % 2 AS side, coalesce(q.h, '') AS h FROM r JOIN a o ON o.k = r.k AND o.pos = r.pos >> o.lvl AND o.n > 1 LEFT JOIN a q ON q.k = o.k AND q.lvl = o.lvl AND q.pos = xor(o.pos, 1)
  UNION ALL SELECT r.k, r.pos, 100 + o.lvl, o.pos % 2, coalesce(q.h, '') FROM r JOIN s ON s.k = r.k JOIN b o ON o.pos = s.pos >> o.lvl AND o.n > 1 LEFT JOIN b q ON q.lvl = o.lvl AND q.pos = xor(o.pos, 1)),
w AS (SELECT k, pos, list(side || h ORDER BY lvl) AS way, string_agg(h, '' ORDER BY lvl) AS joined FROM e GROUP BY k, pos),
f AS (SELECT r.doc_id, r.leaf, s.subroot, (SELECT h FROM b WHERE n = 1) AS root, sha256(coalesce(w.joined, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(r.changed, r.leaf), coalesce(w.way, [])), lambda h, x: CASE WHEN x[1] = '1' THEN sha256(x[2:] || h) ELSE sha256(h || x[2:]) END) AS folded_root
  FROM r JOIN s ON s.k = r.k LEFT JOIN w ON w.k = r.k AND w.pos = r.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
