"""Checkpoint folder, saved state, and result sinks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without one
    gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tarnish-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path of ``path``, whatever the store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of what is kept under ``path``, ascending."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    new = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(new(f"{path}/{n}/_READY")))


def publish(tables: dict[str, DataFrame], path: str, keys: list[str] | None = None) -> int:
    """Writes a new version of ``tables`` beside the old ones, then marks it
    as complete: readers see the old version until all is there, and after a
    failure as well.  Returns its number.

    A number is claimed by creating its marker file, which only one writer
    can do; neither a rename nor an overwrite is needed, so this holds on
    object stores too.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, at = _files(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path
    used = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    number = 1 + max([int(n[1:]) for n in used if n[:1] == "v" and n[1:].isdigit()], default=0)
    here = f"{path}/v{number:08d}"
    fs.create(new(f"{here}/_CLAIMED"), False).close()  # an error if another writer has it
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(keys or [])).parquet(f"{here}/{name}")
    fs.create(new(f"{here}/_READY"), False).close()
    return number


def current(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame | None:
    """A table of the newest complete version (or of ``version``); None if
    nothing is published."""
    known = versions(spark, path)
    if not known:
        return None
    return spark.read.parquet(f"{path}/v{version or known[-1]:08d}/{name}")


def save_state(gallery: DataFrame, prototypes: DataFrame, path: str, keys: list[str]) -> int:
    """Only gallery and prototypes are kept, by run, as one new version."""
    return publish({"gallery": gallery, "prototypes": prototypes}, path, keys)


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of the newest complete version."""
    version = (versions(spark, path) or [None])[-1]
    if version is None:
        raise FileNotFoundError(f"no state is kept in {path}")
    return current(spark, path, "gallery", version), current(spark, path, "prototypes", version)


def write_scores(df: DataFrame, path: str, keys: list[str]) -> None:
    """One record an image, in folders by run, class and defect."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def upsert_metrics(existing: DataFrame, new: DataFrame, classes: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each class: the new value, else the old one, else 0; two
    decimals."""
    old = existing.select("name", *[F.col(m).alias(f"_o_{m}") for m in metrics])
    fresh = new.select("name", *[F.col(m).alias(f"_n_{m}") for m in metrics])
    out = classes.join(old, "name", "left").join(fresh, "name", "left")
    return out.select("name", *[F.round(F.coalesce(f"_n_{m}", f"_o_{m}", F.lit(0.0)), 2).alias(m) for m in metrics])


def upsert_metrics_table(spark: SparkSession, path: str, new: DataFrame, classes: DataFrame, metrics: list[str]) -> int:
    """The metrics kept in ``path``, with ``new`` put in, as a new version."""
    old = current(spark, path, "metrics")
    if old is None:
        old = spark.createDataFrame([], "name string, " + ", ".join(f"`{m}` double" for m in metrics))
    return publish({"metrics": upsert_metrics(old, new, classes, metrics)}, path)
