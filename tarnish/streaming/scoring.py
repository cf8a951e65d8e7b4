"""Scoring of arriving rows against a fixed gallery: stateless, append mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from ..functions.vectors import l2_normalize
from ..operators.vectors import nearest_distance

_POOLERS: dict[str, Callable] = {}


def register_pooler(name: str, fn: Callable) -> None:
    """fn: a column of vectors to a column with one."""
    _POOLERS[name] = fn


def pooler(name: str) -> Callable:
    return _POOLERS[name]


def register_sql_pooler(spark: SparkSession, name: str, fn: Callable) -> Callable:
    """Makes ``fn``, from a numpy matrix (a row for each vector of a group)
    to a vector, an aggregate of that ``name`` in SQL; it also becomes the
    pooler of that name for columns.

    A group's vectors are in memory together, as with any aggregate in
    Python: pool tokens by image, not whole tables.  Null vectors don't
    count; a group without any gives null.
    """
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def pooled(vectors: pd.Series) -> list:
        import numpy as np

        held = [np.asarray(v, dtype=np.float64) for v in vectors if v is not None]
        return [float(x) for x in fn(np.stack(held))] if held else None

    pooled.__annotations__ = {"vectors": pd.Series, "return": float}
    udf = pandas_udf(pooled, "array<double>", functionType=PandasUDFType.GROUPED_AGG)
    spark.udf.register(name, udf)
    register_pooler(name, udf)
    return udf


def score_stream(rows: DataFrame, gallery: DataFrame, by: str, vec: str) -> DataFrame:
    """Nearest distance of each row to its class's gallery; the same code
    serves batches and streams, as the minimum is taken within the row."""
    return rows.join(gallery, by).withColumn("score", nearest_distance(l2_normalize(F.col(vec)), F.col("gallery"))).drop("gallery")


def embed_batch(df: DataFrame, text: str, make_predict: Callable, out: str = "vec") -> DataFrame:
    """Vectors from a batch model; the model is loaded once for each worker."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    udf = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=512)
    return df.withColumn(out, udf(F.col(text))).withColumn(out, l2_normalize(F.col(out)))


def hashed_encoder(dim: int = 64, seed: int = 3) -> Callable:
    """A stand-in model: hashed counts of letters' trigrams times a random matrix."""

    def make():
        import zlib

        import numpy as np

        turn = np.random.default_rng(seed).standard_normal((1024, dim)).astype(np.float32)
        known: dict[int, int] = {}  # the place of a trigram

        def place(code):
            if (got := known.get(code)) is None:
                if len(known) >= 1 << 20:
                    known.clear()
                got = known[code] = zlib.crc32("".join(chr(code >> k & 0x1FFFFF) for k in (0, 21, 42)).encode()) % 1024
            return got

        def predict(texts):
            counts = np.zeros((len(texts), 1024), dtype=np.float32)
            for i, t in enumerate(texts):
                for at in range(0, max(0, len(t or "") - 2), 1 << 20):
                    c = np.frombuffer(t[at : at + (1 << 20) + 2].encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
                    codes, n = np.unique(c[:-2] | c[1:-1] << 21 | c[2:] << 42, return_counts=True)
                    np.add.at(counts[i], [place(x) for x in codes.tolist()], n)
            return counts @ turn

        return predict

    return make
