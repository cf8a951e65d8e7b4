"""Packing of token sequences as a cutting-stock problem.

Documents are cut into pieces of ``capacity`` ids and a remainder.  The
histogram of piece lengths (in classes of ``quantum`` ids) is small however
many documents there are; over it a linear program picks how often to use
each pattern of classes that fills a sequence.  Its columns are generated:
the basis starts from patterns of one class, a knapsack by dynamic
programming over the dual prices finds the pattern that improves it most,
and the simplex method takes it in, until a bound says that
no more than the share ``gap`` of the sequences can be saved.  Rounded-down patterns are used as they are,
what is left is packed first-fit.  Pieces, ranked within their class, then
look up the pattern, the sequence and so their place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import TOKENIZER, encode
from .common import prepare, written

#: Parameters: ids in a sequence, closing id of a document, width of a length
#: class, relative gap at which column generation ends, rows in a rank shard,
#: shards in a run of them.
CAPACITY, END_ID, QUANTUM, GAP, SHARD_ROWS, SHARD_RUN = 4096, 2, 16, 1e-3, 1000, 1000


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of highest value: an unbounded knapsack over units.
    Item c (from 1) takes c units and is worth ``duals[c - 1]``."""
    items = np.flatnonzero(duals > 1e-12) + 1
    worth = duals[items - 1]
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        k = int(np.searchsorted(items, w, side="right"))
        if k:
            value = worth[:k] + best[w - items[:k]]
            i = int(np.argmax(value))
            if value[i] > best[w] + 1e-15:
                best[w], took[w] = value[i], items[i]
    pattern, w = np.zeros(len(duals), dtype=np.int64), capacity
    while w > 0:
        if took[w]:
            pattern[took[w] - 1] += 1
            w -= took[w]
        else:
            w -= 1
    return float(best[capacity]), pattern


def patterns(demand: np.ndarray, gap: float = GAP, rounds: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that meet ``demand`` exactly; demand[c - 1] pieces
    take c of ``len(demand)`` units."""
    m = len(demand)
    classes = np.flatnonzero(demand) + 1
    if not len(classes):
        return []
    need = demand[classes - 1].astype(float)
    least = float((need * classes).sum()) / m  # no packing has fewer sequences
    basis = np.diag((m // classes).astype(float))
    inverse, used = np.linalg.inv(basis), need / (m // classes)
    for step in range(rounds):
        total = used.sum()
        if total - least < max(0.5, gap * total):
            break
        prices = inverse.sum(0)
        duals = np.zeros(m)
        duals[classes - 1] = np.maximum(prices, 0)
        value, pattern = price(duals, m)
        if value <= 1 + 1e-9 or total * (1 - 1 / value) < max(0.5, gap * total):
            break
        column = pattern[classes - 1].astype(float)
        way = inverse @ column
        up = way > 1e-9
        ratio = np.where(up, used / np.where(up, way, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        used = used - ratio[out] * way
        used[out] = ratio[out]
        used[used < 0] = 0
        basis[:, out] = column
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
            used = np.maximum(inverse @ need, 0)
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
    whole, left, out_patterns = np.floor(used + 1e-7).astype(np.int64), demand.astype(np.int64).copy(), []
    for k in range(len(classes)):
        full = np.zeros(m, dtype=np.int64)
        full[classes - 1] = np.rint(basis[:, k]).astype(np.int64)
        times = min([int(whole[k]), *(left[full > 0] // full[full > 0]).tolist()])
        if times > 0:
            left -= times * full
            out_patterns.append((full, times))
    while left.any():  # at most a sequence or so for each class
        room, fill = m, np.zeros(m, dtype=np.int64)
        for c in np.flatnonzero(left)[::-1] + 1:
            take = min(int(left[c - 1]), room // int(c))
            fill[c - 1] += take
            room -= take * int(c)
        uses = fill > 0
        times = int((left[uses] // fill[uses]).min())
        left -= times * fill
        out_patterns.append((fill, times))
    return out_patterns


def slots(found: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: first rank, first sequence and pieces per sequence of
    the patterns that use it, by rising rank."""
    rank: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, times in found:
        for c in (np.flatnonzero(pattern) + 1).tolist():
            a = int(pattern[c - 1])
            out.setdefault(c, []).append((rank.get(c, 0), sequence, a))
            rank[c] = rank.get(c, 0) + a * times
        sequence += times
    return {c: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for c, v in out.items()}


def cut_documents(documents: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, name: str = TOKENIZER) -> DataFrame:
    """A row for each document: its length with the closing id, and the
    crc32 of each of its pieces (little-endian unsigned 32-bit ids)."""

    def finish(columns, ids):
        full = [np.append(x, end_id).astype("<u4") for x in ids]
        return {"doc_id": columns["doc_id"], "doc_tokens": [len(x) for x in full], "crcs": [[zlib.crc32(x[a : a + capacity].tobytes()) for a in range(0, len(x), capacity)] for x in full]}

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode(docs, finish, "doc_id long, doc_tokens long, crcs array<long>", name=name)


def ranked(pieces: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Adds ``rank``, from 0 without gaps within each class.  Classes are
    ranked in shards, so one that holds a third of all pieces is spread."""
    shard = F.xxhash64("doc_id", "start", "length", "doc_tokens", "ids_crc32")
    pieces = pieces.withColumn("shard", F.pmod(shard, F.lit(max(1, pieces.count() // shard_rows))))
    sizes = written(pieces.groupBy("cls", "shard").count().withColumn("run", F.expr(f"shard div {SHARD_RUN}")), "pack-shards")
    # sums over runs of shards, then within each run: no class is summed in one task
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.groupBy("cls", "run").agg(F.sum("count").alias("held"))
    runs = runs.select("cls", "run", F.coalesce(F.sum("held").over(before("cls", "run")), F.lit(0)).alias("base"))
    starts = sizes.join(runs, ["cls", "run"]).select("cls", "shard", (F.col("base") + F.coalesce(F.sum("count").over(before("cls", "run", "shard")), F.lit(0))).alias("base"))
    # rows that tie in all columns may swap without a difference
    order = Window.partitionBy("cls", "shard").orderBy("doc_id", "start", "length", "doc_tokens", "ids_crc32")
    numbered = pieces.withColumn("n", F.row_number().over(order))
    # both sides are dealt by class and shard; the shards' table grows, so it isn't broadcast
    return numbered.join(starts.hint("merge"), ["cls", "shard"]).withColumn("rank", F.col("base") + F.col("n") - 1).drop("base", "n", "shard")


def pack(documents: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, quantum: int = QUANTUM, name: str = TOKENIZER) -> DataFrame:
    """All ids of all documents, each in one piece of one sequence.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and
    offset.  Null or empty text is the closing id alone; repeated rows and
    null doc_ids are packed like others; an empty table gives no rows; other
    columns are ignored.
    """
    spark = documents.sparkSession
    prepare(spark)
    units = capacity // quantum
    cut = written(cut_documents(documents, capacity, end_id, name), "pack-cut")
    pieces = cut.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("pos", "ids_crc32"))
    pieces = pieces.withColumn("start", F.col("pos").cast("long") * capacity)
    pieces = pieces.withColumn("length", F.least(F.lit(capacity), F.col("doc_tokens") - F.col("start")).cast("long"))
    pieces = pieces.withColumn("cls", F.expr(f"cast((length + {quantum - 1}) div {quantum} as int)")).drop("pos")
    demand = np.zeros(units, dtype=np.int64)
    for row in pieces.groupBy("cls").count().collect():  # a row for each class
        demand[row["cls"] - 1] = row["count"]
    place = slots(patterns(demand))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def assign(batches):
        for b in batches:
            cls, rank = b.column("cls").to_numpy(), b.column("rank").to_numpy()
            sequence = np.zeros(len(cls), dtype=np.int64)
            for c in np.unique(cls).tolist():
                here = cls == c
                first, base, each = place[c]
                k = np.searchsorted(first, rank[here], side="right") - 1
                sequence[here] = base[k] + (rank[here] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in columns), pa.array(sequence)], names=[*columns, "sequence_id"])

    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"
    placed = ranked(pieces).select(*columns, "cls", "rank").mapInArrow(assign, shape)
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "doc_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))
