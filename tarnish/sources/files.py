"""File catalogues and small text formats, read by Spark's own sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "object string, split string, label string, image string, mask string"
_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str, fn: Callable[..., DataFrame]) -> None:
    _SOURCES[name] = fn


def read_source(name: str, *args, **options) -> DataFrame:
    if name not in _SOURCES:
        raise KeyError(f"no source named {name}; known: {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name](*args, **options)


def read_image_catalog(spark: SparkSession, root: str, ext: str = "png") -> DataFrame:
    """category/split/defect/*.ext: label 0 for ``good``, else 1, with the
    mask of the same stem under ground_truth.  File contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ext}").load(root)
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)/([^/]+)\.[^./]+$", k)
    rows = files.select("path", "length", part(1).alias("category"), part(2).alias("split"), part(3).alias("defect_type"), part(4).alias("stem"))
    images = rows.where("split <> 'ground_truth'").withColumn("label", (F.col("defect_type") != "good").cast("int"))
    masks = rows.where("split = 'ground_truth'").select("category", "defect_type", F.regexp_replace("stem", "_mask$", "").alias("stem"), F.col("path").alias("mask_path"))
    return images.join(masks, ["category", "defect_type", "stem"], "left")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded pixels (row-wise BGR) of image files."""
    return spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root).select("image.*")


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=MANIFEST)


def read_shot_lists(spark: SparkSession, root: str) -> DataFrame:
    """Lines ``#k: i j ...`` of category/*.txt as (category, k, ord, idx)."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root).withColumn("category", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    lines = lines.select("category", F.regexp_extract("value", r"^#(\d+):", 1).alias("k"), F.regexp_extract_all("value", F.lit(r"(?<=[\s:])\d+"), F.lit(0)).alias("found")).where("k <> ''")
    return lines.select("category", F.col("k").cast("int").alias("k"), F.posexplode("found").alias("ord", "idx")).withColumn("idx", F.col("idx").cast("int"))


def read_vectors(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows as they are; a vector of another length is an error."""
    return df.where(F.coalesce(F.assert_true(F.size(vec) == dim, F.lit(f"a vector is not of length {dim}")), F.lit(True)))


def read_json_catalog(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Documents that have all required keys, named by file stem."""
    docs = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    named = docs.withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    missing = [c for c in required if c not in docs.columns]
    cond = F.lit(not missing)
    for c in required:
        if c not in missing:
            cond = cond & F.col(c).isNotNull()
    return named.where(cond)


def json_has_keys(text: Column, required: list[str]) -> Column:
    cond = F.lit(True)
    for k in required:
        cond = cond & F.get_json_object(text, f"$.{k}").isNotNull()
    return cond


def verify_checksums(df: DataFrame, content: str, expected: str) -> DataFrame:
    """Adds ``checksum_ok``: SHA-256 starts with what is expected; nothing
    expected passes."""
    return df.withColumn("checksum_ok", F.coalesce(F.sha2(F.col(content).cast("binary"), 256).startswith(F.coalesce(F.col(expected), F.lit(""))), F.lit(False)))
