"""Document fingerprints: a Merkle tree over sections and paragraphs.

A text is cut at blank lines (two line feeds) into sections and these at line
feeds into paragraphs, which can be undone.  A paragraph's hash covers its
text, a section's the hashes of its paragraphs, the root those of the
sections; all leaves have one depth, so a node is never taken for one of
another level.

A fingerprint is a string of all nodes: the root, a colon, and the sections,
parted by semicolons.  A section is its hash (``NODE_DIGITS``), an equals
sign and its paragraphs, parted by commas.  A paragraph is its hash and, if
it has more than one piece, a stop and ``PIECE_DIGITS`` digits of each
piece's hash; the piece of a paragraph that is one is known from the
paragraph's hash.  Pieces end after a blank that follows a character of a
fixed class, so cuts depend on the text around them only.  ``sound`` computes
every hash above the paragraphs again from those below it.

Equal texts have equal fingerprints, different ones different roots, up to
128 bits of SHA-256 in each node.

Two fingerprints are compared from the root down: sections that both have are
not entered, nor are paragraphs that both have within the others, wherever
they stand, so an insertion costs only itself.  A node's string is a function
of its hash, which comes first, so nodes of different hashes differ there.
The pieces left in differing paragraphs say how much differs, and the first
differing node of each level where (``first_change``).

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Hex digits of a node's and of a piece's hash, rows in a run of neighbours,
#: and runs at most.
NODE_DIGITS, PIECE_DIGITS, RUN_ROWS, RUNS = 32, 8, 128, 1 << 16
#: A piece: up to a blank after one of these characters, or to the end.
PIECE = r"(?s).*?[eyEYаеαε.;:!?] |.+"


def _bound(x: Column, f) -> Column:
    """f(x), in which x is computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def _digest(x: Column, digits: int = NODE_DIGITS) -> Column:
    return F.substring(F.sha2(x, 256), 1, digits)


def _hash(node: Column) -> Column:
    return F.substring(node, 1, NODE_DIGITS)


def _joined_hashes(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, _hash), "")


def _paragraph(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    digits = lambda x: F.array_join(F.transform(x, lambda y: _digest(y, PIECE_DIGITS)), "")
    return F.concat(_digest(text), _bound(pieces, lambda x: F.when(F.size(x) > 1, F.concat(F.lit("."), digits(x))).otherwise("")))


def _section(text: Column) -> Column:
    paragraphs = F.transform(F.split(text, "\n", -1), _paragraph)
    return _bound(paragraphs, lambda x: F.concat(_digest(_joined_hashes(x)), F.lit("="), F.array_join(x, ",")))


def fingerprint(text: Column) -> Column:
    """Root and tree of a text (null counts as empty)."""
    sections = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), _section)
    return _bound(sections, lambda x: F.concat(F.sha2(_joined_hashes(x), 256), F.lit(":"), F.array_join(x, ";")))


def root(print_: Column) -> Column:
    return F.substring_index(print_, ":", 1)


def sections(print_: Column) -> Column:
    return F.split(F.substring_index(print_, ":", -1), ";", -1)


def paragraphs(section: Column) -> Column:
    """A section's paragraphs; none of a null section."""
    return F.coalesce(F.split(F.substring_index(section, "=", -1), ",", -1), F.array().cast("array<string>"))


def sound(print_: Column) -> Column:
    """Whether every section's hash is that of its paragraphs' and the root
    that of its sections'."""
    inner = F.forall(sections(print_), lambda s: _hash(s) == _digest(_joined_hashes(paragraphs(s))))
    return inner & (root(print_) == F.sha2(_joined_hashes(sections(print_)), 256))


def _pieces(paragraphs_: Column) -> Column:
    """The distinct pieces of paragraphs."""
    digits = F.array_join(F.transform(paragraphs_, lambda p: F.when(F.length(p) > NODE_DIGITS, F.substring(p, NODE_DIGITS + 2, 1 << 30)).otherwise(F.substring(p, 1, PIECE_DIGITS))), "")
    return F.array_distinct(F.regexp_extract_all(digits, F.lit("[0-9a-f]{%d}" % PIECE_DIGITS), F.lit(0)))


def _all_paragraphs(nodes: Column) -> Column:
    return F.flatten(F.transform(nodes, paragraphs))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Descent: the distinct paragraphs of fingerprint ``a``, as in its tree,
    that ``b`` has nowhere in its sections that differ from those of ``a``."""
    mine = lambda x, y: _all_paragraphs(F.array_except(sections(x), sections(y)))
    return F.when(root(a) == root(b), F.array().cast("array<string>")).otherwise(F.array_except(mine(a, b), mine(b, a)))


def edit_places(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>>, numbered from 0: where ``a`` has a
    paragraph that differs from those of ``b``."""
    inside = lambda changed: lambda s, i: F.filter(F.transform(paragraphs(s), lambda p, j: F.when(F.array_contains(changed, p), F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull())
    return _bound(differing_paragraphs(a, b), lambda changed: F.flatten(F.transform(sections(a), inside(changed))))


def _equal_from_start(x: Column, y: Column) -> Column:
    """Number of leading nodes that both have."""
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    return _bound(same, lambda v: F.when(F.array_contains(v, False), F.array_position(v, False) - 1).otherwise(F.size(v).cast("long")))


def first_change(a: Column, b: Column) -> Column:
    """section.paragraph, numbered from 0, from which on ``a`` differs from
    ``b``: the first section with another hash is entered for its first
    paragraph with another one.  Null if the roots are equal."""
    inner = lambda i: F.concat_ws(".", i, _equal_from_start(paragraphs(F.get(sections(a), i.cast("int"))), paragraphs(F.get(sections(b), i.cast("int")))))
    return F.when(root(a) != root(b), _bound(_equal_from_start(sections(a), sections(b)), inner))


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of distinct pieces, of both trees, that lie in
    differing paragraphs of one and not in those of the other."""
    left, right = (_pieces(x) for x in (differing_paragraphs(a, b), differing_paragraphs(b, a)))
    all_ = F.size(_pieces(_all_paragraphs(sections(a)))) + F.size(_pieces(_all_paragraphs(sections(b))))
    apart = lambda x: _bound(right, lambda y: F.size(F.array_except(x, y)) + F.size(F.array_except(y, x)))
    return F.when(root(a) == root(b), 1.0).otherwise(1.0 - _bound(left, apart) / all_)


def with_runs(docs: DataFrame) -> DataFrame:
    """Adds ``run``: cuts the order of (doc_id, hash of text), null ids first,
    into runs of about ``RUN_ROWS`` rows, or 1 / ``RUNS`` of all.

    Quantiles of the ids are the cuts, in one broadcast row of bounded size.
    An id that several quantiles name is dealt by the hash of its texts.
    """
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    n = docs.count()
    size = max(1, min(RUNS, n // RUN_ROWS))
    got = docs.agg(F.percentile_approx(key, [i / size for i in range(1, size)], max(1000, 10 * size)).alias("q")).first()["q"] if size > 1 else []
    wide = max(1, math.isqrt(len(got)))
    groups = [sorted(got)[i : i + wide] for i in range(0, len(got), wide)] or [[2**63 - 1]]
    row = docs.sparkSession.range(1).select(F.from_json(F.lit(json.dumps(groups)), "array<array<long>>").alias("_groups"))
    row = row.withColumn("_ends", F.transform("_groups", lambda g: F.element_at(g, -1)))
    docs = docs.join(F.broadcast(row)).withColumn("_key", key)

    def place(below):  # number of cuts below the key
        group = F.least(F.size(F.filter("_ends", below)), F.size("_ends") - 1)
        return group * wide + F.size(F.filter(F.get("_groups", group), below))

    low, high = place(lambda c: c < F.col("_key")), place(lambda c: c <= F.col("_key"))
    part = F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53))
    docs = docs.withColumns({"_low": low, "_many": high - low})
    run = F.col("_low") + F.when(F.col("_many") > 0, F.floor(part * (F.col("_many") + 1))).otherwise(0)
    return docs.withColumn("run", run.cast("long")).drop("_groups", "_ends", "_key", "_low", "_many")


def with_next(docs: DataFrame) -> DataFrame:
    """Adds ``next_text``: the text of the next row in ascending doc_id
    (nulls first, ties by a hash of the text); the last row gets the first
    row's.

    Rows are dealt by runs of ids and each run is ordered by itself; the last
    row of a run gets the head of the next run that has rows, which is joined
    by run, so every text moves once.
    """
    docs = with_runs(docs.withColumn("hash", F.xxhash64("text")))
    order = Window.partitionBy("run").orderBy(F.asc_nulls_first("doc_id"), F.shiftrightunsigned("hash", 1), "hash", "text")
    heads = written(docs.withColumn("n", F.row_number().over(order)).where("n = 1").select("run", F.col("text").alias("head")), "run-heads")
    # successors of runs, two levels up: runs in groups of 4096, then the groups
    known = heads.select("run", F.expr("run div 4096").alias("g"))
    after = known.withColumn("to", F.lead("run").over(Window.partitionBy("g").orderBy("run")))
    firsts = known.groupBy("g").agg(F.min("run").alias("first"))
    line = Window.orderBy("g")  # at most RUNS / 4096 rows
    firsts = firsts.select("g", F.coalesce(F.lead("first").over(line), F.first("first").over(line)).alias("beyond"))
    after = after.join(firsts, "g").select("run", F.coalesce("to", "beyond").alias("to"))
    edge = after.join(heads.withColumnRenamed("run", "to"), "to").select("run", "head")
    seen = docs.select("run", "doc_id", "text", F.lead("text").over(order).alias("next_text"), F.lead(F.lit(True)).over(order).alias("more"))
    return seen.join(edge, "run").select("doc_id", "text", F.when(F.col("more"), F.col("next_text")).otherwise(F.col("head")).alias("next_text"))


def fingerprints_of_edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edit replaces the last floor(n / 2) of a text's n code points by the
    first as many of the next document's (all, if it has fewer).  Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (``likeness``), n_changed, the distinct
    paragraphs of the edited text that differ (``differing_paragraphs``), and
    changed_at (``first_change``).
    Null text is empty; very long texts, and one paragraph or thousands of
    sections, take the same way in time that grows with their length; rows with equal or null doc_id are ordered as
    ``with_next`` says; an empty table gives no rows; other columns are
    ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("next_text")).alias("following"))
    own, edited = F.col("fingerprint"), F.col("edited_fingerprint")
    changed = differing_paragraphs(edited, own)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(own, edited).alias("near_edited"), likeness(own, F.col("following")).alias("near_next"), F.size(changed).cast("long").alias("n_changed"), first_change(edited, own).alias("changed_at"))


def _sql_sections(x: str) -> str:
    """Structs of a section's hash and its paragraphs' strings."""
    pieces = f"array_to_string(list_transform(v, lambda y: sha256(y)[1:{PIECE_DIGITS}]), '')"
    paragraph = f"sha256(p)[1:{NODE_DIGITS}] || list_transform([regexp_extract_all(p, '{PIECE}')], lambda v: CASE WHEN len(v) > 1 THEN '.' || {pieces} ELSE '' END)[1]"
    section = f"{{'h': sha256(array_to_string(list_transform(ps, lambda p: p[1:{NODE_DIGITS}]), ''))[1:{NODE_DIGITS}], 'p': ps}}"
    return f"list_transform(string_split({x}, chr(10) || chr(10)), lambda s: list_transform([list_transform(string_split(s, chr(10)), lambda p: {paragraph})], lambda ps: {section})[1])"


def _sql_print(x: str) -> str:
    return f"sha256(array_to_string(list_transform({x}, lambda s: s.h), '')) || ':' || array_to_string(list_transform({x}, lambda s: s.h || '=' || array_to_string(s.p, ',')), ';')"


def _sql_except(x: str, y: str) -> str:
    return f"list_filter(list_distinct({x}), lambda z: NOT list_contains({y}, z))"


def _sql_inner(x: str) -> str:
    return f"flatten(list_transform({x}, lambda s: s.p))"


def _sql_differing(a: str, b: str) -> str:
    return _sql_except(_sql_inner(_sql_except(a, b)), _sql_inner(_sql_except(b, a)))


def _sql_pieces(x: str) -> str:
    digits = f"array_to_string(list_transform({x}, lambda p: CASE WHEN length(p) > {NODE_DIGITS} THEN p[{NODE_DIGITS + 2}:] ELSE p[1:{PIECE_DIGITS}] END), '')"
    return f"list_distinct(regexp_extract_all({digits}, '[0-9a-f]{{{PIECE_DIGITS}}}'))"


def _sql_start(x: str, y: str) -> str:
    """Number of leading entries that lists x and y have in common."""
    return f"list_position(list_transform(range(1, greatest(len({x}), len({y})) + 2), lambda i: i > greatest(len({x}), len({y})) OR {x}[i] IS DISTINCT FROM {y}[i]), true) - 1"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n_chars,
             coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS next_text FROM d),
e AS (SELECT *, substring(text, 1, n_chars - n_chars // 2) || substring(next_text, 1, n_chars // 2) AS edited FROM n),
t AS (SELECT *, {_sql_sections('text')} AS a, {_sql_sections('edited')} AS b, {_sql_sections('next_text')} AS c FROM e),
p AS (SELECT *, {_sql_differing('a', 'b')} AS ab, {_sql_differing('b', 'a')} AS ba, {_sql_differing('a', 'c')} AS ac, {_sql_differing('c', 'a')} AS ca, {_sql_start('a', 'b')} AS s0 FROM t),
l AS (SELECT *, {_sql_pieces(_sql_inner('a'))} AS la, {_sql_pieces(_sql_inner('b'))} AS lb, {_sql_pieces(_sql_inner('c'))} AS lc,
  {_sql_pieces('ab')} AS lab, {_sql_pieces('ba')} AS lba, {_sql_pieces('ac')} AS lac, {_sql_pieces('ca')} AS lca,
  coalesce(a[s0 + 1].p, []) AS pa, coalesce(b[s0 + 1].p, []) AS pb FROM p)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_sql_print('a')} AS fingerprint, {_sql_print('b')} AS edited_fingerprint,
  CASE WHEN text = edited THEN 1.0 ELSE 1.0 - (len(lab) + len(lba) - 2 * len(list_intersect(lab, lba))) / (len(la) + len(lb)) END::DOUBLE AS near_edited,
  CASE WHEN text = next_text THEN 1.0 ELSE 1.0 - (len(lac) + len(lca) - 2 * len(list_intersect(lac, lca))) / (len(la) + len(lc)) END::DOUBLE AS near_next,
  len(ba)::BIGINT AS n_changed,
  CASE WHEN text <> edited THEN s0 || '.' || ({_sql_start('pb', 'pa')}) END AS changed_at
FROM l
"""
