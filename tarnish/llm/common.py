"""Shared helpers: the shared scratch folder, tables that cut lineage, and
Arrow batches regrouped by key inside a task."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset, and the master is local (tests), a temporary
    folder of this machine is set instead; a cluster without the setting is
    an error rather than a silent write to one machine's disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tarnish-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package whatever
    the working folder is.  On a cluster the package is shipped as usual
    (``--py-files`` or installed on the workers)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tarnish-{name}-{uuid.uuid4().hex}"


#: Of jobs that write tables: their shuffle files go as they end, instead of
#: when the driver happens to collect its garbage, and Arrow batches are
#: smaller, as a Python worker holds a few of them.
JOBS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def lean_jobs(spark: SparkSession) -> Iterator[None]:
    """Settings ``JOBS`` for what runs inside."""
    was = {k: spark.conf.get(k) for k in JOBS}
    for k, v in JOBS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder, read again: later jobs
    start from files, so a lost executor costs only its own tasks, and what
    was shuffled for it needs no disk any longer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with lean_jobs(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _maybe(df: DataFrame, column: str, keys: DataFrame, key: str, bits: int, how: str) -> list[DataFrame]:
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits))
    words = keys.select(place.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    for r in words.collect():  # at most bits / 64 rows
        bitmap[r["w"]] = r["b"]
    row = df.sparkSession.createDataFrame([(bitmap.tolist(),)], "_bits array<long>")
    at = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))
    word = F.get(F.col("_bits"), F.floor(at / 64).cast("int"))
    return [df.join(F.broadcast(row), F.getbit(word, (at % 64).cast("int")) == 1, h) for h in how.split()]


def narrowed(df: DataFrame, column: str, keys: DataFrame, key: str, bits: int = 1 << 24) -> DataFrame:
    """Rows of ``df`` whose ``column`` may occur in ``keys``, ahead of a join
    that needs only those: the others aren't shuffled.

    The test is a bitmap of ``bits`` bits (2 MB, whatever the number of keys)
    over hashes, one broadcast row; it lets all rows pass that join, and few
    others as long as keys are fewer than bits.
    """
    return _maybe(df, column, keys, key, bits, "left_semi")[0]


def parted(df: DataFrame, column: str, keys: DataFrame, key: str, bits: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``column`` may occur in ``keys``, as in
    ``narrowed``, and those that surely don't, which need no join."""
    return tuple(_maybe(df, column, keys, key, bits, "left_semi left_anti"))


def numbered(documents: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """``documents`` with a column ``_doc`` that names a row's id and text.

    Where doc_ids are unique and not null, ``_doc`` is doc_id and the second
    result None.  Otherwise it numbers the distinct (doc_id, text) in
    ascending order, null ids last, and the second result maps it to
    doc_id: rows that share an id keep their own texts.
    """
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return documents.withColumn("_doc", F.col("doc_id").cast("long")), None
    text = F.coalesce(F.sha1(F.col(text_col).cast("binary")), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("_id"), text.alias("_sha")).distinct()
    # ids ascend with partitions, and these with the order
    names = written(rows.orderBy(F.asc_nulls_last("_id"), "_sha").withColumn("_no", F.monotonically_increasing_id()), "row-numbers")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (text == F.col("_sha"))
    out = documents.join(names, same, "left").withColumnRenamed("_no", "_doc").drop("_id", "_sha")
    return out, names.select(F.col("_no").alias("_doc"), F.col("_id").alias("doc_id"))


def positions(df: DataFrame, key: str, order: list, name: str) -> DataFrame:
    """``df`` with ``_pos``, the row's place within its ``key`` by ``order``
    (from 0), and ``_n``, the key's rows.

    Rows are dealt out by range, so that a key of very many rows is in many
    tasks; what a key has in earlier partitions comes from a table with a
    row for each key and partition.  The key is not null.
    """
    rows = written(df.orderBy(key, *order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.expr("shiftright(_at, 33)").alias("_part")
    runs = rows.groupBy(key, part).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    whole = Window.partitionBy(key)
    before = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n") - F.col("_from")
    runs = written(runs.select(key, "_part", before.alias("_shift"), F.sum("_n").over(whole).alias("_n")), f"{name}-runs")
    return rows.select("*", part).join(runs, [key, "_part"]).withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Inner join in which a key of many rows of ``many`` meets no single task.

    Keys over a quarter of a partition's share of the rows are salted: there
    are at most four times as many of them as partitions, so their list is
    broadcast, and as many copies of their rows of ``few`` are made at most.
    ``counts`` (keys, n) spares counting ``many`` anew.
    """
    spark = many.sparkSession
    counts = many.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts.select(*keys, "n")
    counts = written(counts.where(F.col("n") > 1000), "key-counts")
    rows = max(1000, (counts.agg(F.sum("n")).first()[0] or 0) // (4 * partitions(spark)))
    hot = counts.where(F.col("n") > rows).withColumn("_salts", F.ceil(F.col("n") / rows).cast("int")).drop("n")
    if hot.isEmpty():
        return many.join(few, keys)
    salts = F.coalesce("_salts", F.lit(1))
    others = [c for c in many.columns if c not in keys] or keys
    left = many.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*others), salts).cast("int")).drop("_salts")
    right = few.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def crc_residue(id_col, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (a null id: 0)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus, F.lit(0))


def keyed_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups from batches that arrive sorted by ``keys``.

    Yields tables that each hold one or more complete groups; only the last
    group of a batch is carried to the next one, so memory is bounded by a
    batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        starts = group_starts(batch, keys)
        last = int(starts[-1])
        if held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table_: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """First row of each run of equal keys."""
    change = np.zeros(table_.num_rows, dtype=bool)
    change[:1] = True
    for k in keys:
        v = np.asarray(table_.column(k).to_numpy(zero_copy_only=False) if isinstance(table_, pa.RecordBatch) else table_.column(k).to_numpy())
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def slices(table_: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    starts = group_starts(table_, keys)
    yield from zip(starts.tolist(), [*starts[1:].tolist(), table_.num_rows], strict=True)


def binary_rows(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())
