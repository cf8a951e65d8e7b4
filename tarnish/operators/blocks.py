"""All pairs of two tables of vectors, block by block.

Both sides are dealt into blocks of bounded size within a key; each pair of
blocks is one group of a cogrouped Arrow function that multiplies two
matrices, and what it returns is folded there: the pairs themselves, the
nearest rows, or sums weighted by a softmax.  Nothing is broadcast, a key of
very many rows is many groups, and only what a fold keeps is shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles, l2_normalize

#: Rows of a block; a group holds two blocks.  Their products are taken for
#: some rows at a time, of ``CELLS`` cells.
BLOCK, CELLS = 4096, 1 << 17


def _dealt(df: DataFrame, other: DataFrame, keys: list[str], own: str, theirs: str, rows: int) -> DataFrame:
    """``df`` with its block (``own``), once for each block of the other
    side (``theirs``).  Only keys of more than ``rows`` rows are listed, at
    most one for each ``rows`` rows of the table."""

    def blocks(side: DataFrame, name: str) -> DataFrame:
        many = side.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
        return many.select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias(name))

    values = [c for c in df.columns if c not in keys]
    df = df.join(blocks(df, "_own"), keys, "left").join(blocks(other, "_theirs"), keys, "left")
    at = F.pmod(F.xxhash64(*values), F.coalesce("_own", F.lit(1))).cast("int")
    df = df.withColumn(own, at).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce("_theirs", F.lit(1)) - 1)))
    return df.drop("_own", "_theirs")


def block_pairs(a: DataFrame, b: DataFrame, keys: list[str], fold: Callable, schema: str, rows: int = BLOCK) -> DataFrame:
    """``fold(left, right)`` of Arrow tables over all pairs of blocks of
    equal ``keys`` (none: all rows meet).  Rows with a null key meet none."""
    if not keys:
        a, b, keys = a.withColumn("_all", F.lit(0)), b.withColumn("_all", F.lit(0)), ["_all"]
    a, b = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (a, b))  # both may stem from one table
    by = [*keys, "_i", "_j"]
    left, right = _dealt(a, b, keys, "_i", "_j", rows), _dealt(b, a, keys, "_j", "_i", rows)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(fold, schema)


def _strips(x, y):
    """Products of some rows of ``x`` and all of ``y``, ``CELLS`` at most."""
    step = max(1, CELLS // len(y))
    return (x[k : k + step] @ y.T for k in range(0, len(x), step))


def _fields(df: DataFrame, names: dict[str, str]) -> str:
    return ", ".join(f"`{new}` {df.schema[old].dataType.simpleString()}" for old, new in names.items())


def pair_similarity(a: DataFrame, b: DataFrame, id_a: str, id_b: str, scale: float = 1.0, keys: list[str] | None = None, va: str = "va", vb: str = "vb", rows: int = BLOCK) -> DataFrame:
    """(id_a, id_b, similarity): scaled dot products of all pairs of equal
    keys, a strip at a time.  Null vectors take no part."""
    keys = keys or []
    left = a.where(F.col(va).isNotNull()).select(*keys, F.col(id_a).alias("_a"), doubles(F.col(va)).alias("_va"))
    right = b.where(F.col(vb).isNotNull()).select(*keys, F.col(id_b).alias("_b"), doubles(F.col(vb)).alias("_vb"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((left, "_a"), (right, "_b"))]

    def pack(x, y):
        """The two blocks in one row: all their pairs would be 16 million."""
        import pyarrow as pa

        n = 1 if x.num_rows and y.num_rows else 0
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v).slice(0, n)
        columns = {c: t[c].combine_chunks() for t, c in ((x, "_a"), (x, "_va"), (y, "_b"), (y, "_vb"))}
        return pa.table({c: one(v.flatten() if c.startswith("_v") else v) for c, v in columns.items()})

    def products(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                ids, x, others, y = (batch.column(c)[k].values for c in ("_a", "_va", "_b", "_vb"))
                x, y, at = np.asarray(x).reshape(len(ids), -1), np.asarray(y).reshape(len(others), -1), 0
                for s in _strips(x, y):
                    n, m = s.shape
                    rows = [ids.slice(at, n).take(pa.array(np.repeat(np.arange(n), m))), others.take(pa.array(np.tile(np.arange(m), n))), pa.array(scale * s.ravel())]
                    yield pa.RecordBatch.from_arrays(rows, names=[id_a, id_b, "similarity"])
                    at += n

    packed = block_pairs(left, right, keys, pack, f"_a array<{kinds[0]}>, _va array<double>, _b array<{kinds[1]}>, _vb array<double>", rows)
    return packed.mapInArrow(products, f"`{id_a}` {kinds[0]}, `{id_b}` {kinds[1]}, similarity double")


def nearest(a: DataFrame, b: DataFrame, id_a: str, id_b: str, k: int = 1, keys: list[str] | None = None, va: str = "va", vb: str = "vb", rows: int = BLOCK) -> DataFrame:
    """(keys, id_a, rank, id_b, distance): the ``k`` rows of ``b`` of smallest
    (1 - cosine) / 2 for each row of ``a``, ties (to nine digits) to the
    smaller id.  A group returns k rows for each of its rows at most; null
    vectors take no part, zero ones have distance one half to all."""
    keys = keys or []
    left = a.where(F.col(va).isNotNull()).select(*keys, F.col(id_a).alias("_a"), l2_normalize(F.col(va)).alias("_va"))
    right = b.where(F.col(vb).isNotNull()).select(*keys, F.col(id_b).alias("_b"), l2_normalize(F.col(vb)).alias("_vb"))
    out = {**{c: c for c in keys}, "_a": id_a}
    schema = f"{_fields(left, out)}, {_fields(right, {'_b': id_b})}, distance double"

    def fold(x, y):
        import numpy as np
        import pyarrow as pa

        n, m = x.num_rows, y.num_rows
        if not n or not m:
            return pa.table({**{new: x[old].slice(0, 0) for old, new in out.items()}, id_b: y["_b"].slice(0, 0), "distance": pa.array([], pa.float64())})
        y = y.sort_by("_b")
        matrix = lambda c: np.asarray(c.combine_chunks().flatten()).reshape(len(c), -1)
        parts = []
        for s in _strips(matrix(x["_va"]), matrix(y["_vb"])):
            d = (1 - s) / 2
            # ids ascend, so the stable order of rounded distances breaks ties
            best = np.argsort(d.round(9), axis=1, kind="stable")[:, :k] if k > 1 else d.round(9).argmin(1)[:, None]
            parts.append((best, np.take_along_axis(d, best, 1)))
        best, d = (np.concatenate(p) for p in zip(*parts, strict=True))
        at = pa.array(np.repeat(np.arange(n), best.shape[1]))
        return pa.table({**{new: x[old].take(at) for old, new in out.items()}, id_b: y["_b"].take(pa.array(best.ravel())), "distance": d.ravel()})

    rows_ = block_pairs(left, right, keys, fold, schema, rows)
    w = Window.partitionBy(*keys, id_a).orderBy(F.round("distance", 9), id_b)  # k rows for each block of b
    return rows_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, id_a, "rank", id_b, "distance")


def nearest_in_groups(a: DataFrame, b: DataFrame, id_a: str, group: str, va: str = "va", vb: str = "vb", rows: int = BLOCK) -> DataFrame:
    """(id_a, group, distance): for each row of ``a`` and each group of ``b``
    the smallest (1 - cosine) / 2."""
    left = a.where(F.col(va).isNotNull()).select(F.col(id_a).alias("_a"), l2_normalize(F.col(va)).alias("_va"))
    right = b.where(F.col(vb).isNotNull()).select(F.col(group).alias("_g"), l2_normalize(F.col(vb)).alias("_vb"))
    schema = f"{_fields(left, {'_a': id_a})}, {_fields(right, {'_g': group})}, distance double"

    def fold(x, y):
        import numpy as np
        import pyarrow as pa

        if not x.num_rows or not y.num_rows:
            return pa.table({id_a: x["_a"].slice(0, 0), group: y["_g"].slice(0, 0), "distance": pa.array([], pa.float64())})
        y = y.sort_by("_g")
        matrix = lambda c: np.asarray(c.combine_chunks().flatten()).reshape(len(c), -1)
        names = y["_g"].combine_chunks()
        codes = np.asarray(names.dictionary_encode(null_encoding="encode").indices)
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        d = np.concatenate([np.minimum.reduceat((1 - s) / 2, first, axis=1) for s in _strips(matrix(x["_va"]), matrix(y["_vb"]))]).round(12)
        n, g = d.shape
        return pa.table({id_a: x["_a"].take(pa.array(np.repeat(np.arange(n), g))), group: names.take(pa.array(np.tile(first, n))), "distance": d.ravel()})

    found = block_pairs(left, right, [], fold, schema, rows)
    return found.groupBy(id_a, group).agg(F.min("distance").alias("distance"))


def attend_blocks(tokens: DataFrame, queries: DataFrame, key: str, query: str, q: str, vec: str, scale: float, rows: int = BLOCK) -> DataFrame:
    """(key, query, vec): softmax(q . v * scale) . v over the tokens of a
    group.  Blocks return their largest logit, the sum of powers and the
    weighted vector, which are rescaled to a common logit and added."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    left = queries.where(F.col(q).isNotNull()).select(key, F.col(query).alias("_q"), doubles(F.col(q)).alias("_va"))
    right = tokens.where(F.col(vec).isNotNull()).select(key, doubles(F.col(vec)).alias("_vb"))
    schema = f"{_fields(left, {key: key, '_q': query})}, _top double, _sum double, _vec array<double>"

    def fold(x, y):
        import numpy as np
        import pyarrow as pa

        n = x.num_rows if y.num_rows else 0
        names = {key: x[key].slice(0, n), query: x["_q"].slice(0, n)}
        if not n:
            return pa.table({**names, "_top": pa.array([], pa.float64()), "_sum": pa.array([], pa.float64()), "_vec": pa.array([], pa.list_(pa.float64()))})
        matrix = lambda c: np.asarray(c.combine_chunks().flatten()).reshape(len(c), -1)
        v = matrix(y["_vb"])
        parts = []
        for s in _strips(matrix(x["_va"]), v):
            z = scale * s
            top = z.max(1)
            e = np.exp(z - top[:, None])
            parts.append((top, e.sum(1), e @ v))
        top, total, sums = (np.concatenate(p) for p in zip(*parts, strict=True))
        vecs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * v.shape[1], pa.int32()), pa.array(sums.ravel()))
        return pa.table({**names, "_top": top, "_sum": total, "_vec": vecs})

    parts = block_pairs(left, right, [key], fold, schema, rows)
    w = F.exp(F.col("_top") - F.max("_top").over(Window.partitionBy(key, query)))  # a row for each block of tokens
    parts = parts.withColumn("_w", w)
    out = parts.groupBy(key, query).agg(Summarizer.sum(array_to_vector("_vec"), F.col("_w")).alias("_v"), F.sum(F.col("_sum") * F.col("_w")).alias("_s"))
    return out.select(key, query, F.transform(vector_to_array("_v"), lambda x: x / F.col("_s")).alias(vec))


def projected(df: DataFrame, matrix, vec: str, out: str) -> DataFrame:
    """``df`` with ``out``, vec @ matrix, for a numpy matrix that the driver
    holds; a null vector gives null."""
    import numpy as np
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    m = np.ascontiguousarray(matrix, dtype=np.float64)
    udf = predict_batch_udf(lambda: lambda v: v @ m, return_type=ArrayType(DoubleType()), batch_size=4096, input_tensor_shapes=[[m.shape[0]]])
    value = doubles(F.col(vec))
    return df.withColumn(out, F.when(value.isNotNull(), udf(F.coalesce(value, F.array_repeat(F.lit(0.0), m.shape[0])))))


def lsh_nearest(a: DataFrame, b: DataFrame, id_a: str, id_b: str, *, length: float, tables: int = 8, accept: float = 0.25, keys: list[str] | None = None, va: str = "va", vb: str = "vb", seed: int = 17, rows: int = 4 * BLOCK) -> DataFrame:
    """(keys, id_a, id_b, distance, exact): an approximate nearest row of
    ``b`` for every row of ``a``, distance (1 - cosine) / 2.

    Unit vectors are hashed by ``tables`` random projections cut into
    buckets of ``length`` (on them the squared Euclidean distance is four
    times ours); rows that share a bucket are compared exactly, in blocks, so
    a crowded bucket is many groups.  The tables make many groups of larger
    blocks, which are copied less.  Rows that find nothing within
    ``accept`` are searched exactly among all rows (``exact``), so none is
    left without its nearest row.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    keys = keys or []
    left = a.where(F.col(va).isNotNull()).select(*keys, F.col(id_a).alias("_a"), l2_normalize(F.col(va)).alias("_va"))
    right = b.where(F.col(vb).isNotNull()).select(*keys, F.col(id_b).alias("_b"), l2_normalize(F.col(vb)).alias("_vb"))
    lsh = BucketedRandomProjectionLSH(inputCol="_unit", outputCol="_hash", bucketLength=length, numHashTables=tables, seed=seed)
    as_vectors = lambda df, v: df.withColumn("_unit", array_to_vector(v))
    model = lsh.fit(as_vectors(right, "_vb"))

    def hashed(df: DataFrame, v: str) -> DataFrame:
        cut = F.posexplode(F.transform("_hash", lambda h: F.floor(F.get(vector_to_array(h), F.lit(0)))))
        return model.transform(as_vectors(df, v)).select(*[c for c in df.columns], cut.alias("_table", "_bucket"))

    found = nearest(hashed(left, "_va"), hashed(right, "_vb"), "_a", "_b", 1, [*keys, "_table", "_bucket"], "_va", "_vb", rows)
    best = found.groupBy(*keys, "_a").agg(F.min(F.struct("distance", "_b")).alias("_m")).select(*keys, "_a", "_m.*").where(F.col("distance") <= accept)
    rest = left.join(best.select(*keys, "_a"), [*keys, "_a"], "left_anti")
    exact = nearest(rest, right, "_a", "_b", 1, keys, "_va", "_vb", rows)
    out = best.withColumn("exact", F.lit(False)).unionByName(exact.drop("rank").withColumn("exact", F.lit(True)))
    return out.select(*keys, F.col("_a").alias(id_a), F.col("_b").alias(id_b), "distance", "exact")


def group_sums(df: DataFrame, keys: list[str], vec: str, how: str) -> DataFrame:
    """Component-wise ``mean`` or ``max`` of a group's vectors; the buffer is
    one vector.  Null vectors don't count."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = df.where(F.col(vec).isNotNull()).select(*keys, array_to_vector(doubles(F.col(vec))).alias("_v"))
    folded: Column = getattr(Summarizer, how)(F.col("_v"))
    return rows.groupBy(*keys).agg(folded.alias("_v")).select(*keys, vector_to_array("_v").alias(vec))
