"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the histogram
answer, for every context limit, how many documents and tokens there are,
how many tokens a truncation to that limit keeps, and quantiles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import TOKENIZER, encode
from .common import written

#: Lengths in a block of the two-level prefix sums.
BLOCK = 1024


def document_lengths(documents: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """doc_id and the number of tokens of its whole text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode(docs, lambda columns, ids: {"doc_id": columns["doc_id"], "n_tokens": [len(x) for x in ids]}, "doc_id long, n_tokens long", name=name)


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def limits(hist: DataFrame) -> DataFrame:
    """A row for each length that occurs, as a context limit.

    docs, tokens: of that length; docs_over: longer ones; total_tokens: of
    all documents; kept_tokens: after truncation to the limit; quantile:
    share of documents of at most this length.  Sums run in two levels:
    within blocks of lengths, and over the blocks.
    """
    hist = hist.withColumns({"tokens": F.col("n_tokens") * F.col("docs"), "block": F.expr(f"n_tokens div {BLOCK}")})
    sums = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    line = Window.orderBy("block")  # a row for BLOCK lengths
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    everything = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("block", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("total_tokens"))
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = hist.withColumns({"d1": F.sum("docs").over(within), "t1": F.sum("tokens").over(within)}).join(sums, "block")
    out = out.withColumn("docs_over", F.col("all_docs") - F.col("d0") - F.col("d1"))
    return out.select(
        F.col("n_tokens").alias("context_limit"),
        "docs",
        "tokens",
        "docs_over",
        "total_tokens",
        (F.col("t0") + F.col("t1") + F.col("docs_over") * F.col("n_tokens")).alias("kept_tokens"),
        ((F.col("d0") + F.col("d1")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """Tokens kept and documents cut by one limit, whether it occurs or not."""
    return hist.agg(F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("docs")), F.lit(0)).alias("kept_tokens"), F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("docs"))), F.lit(0)).alias("docs_over"))


def length_quantiles(limits_: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length that at least each share of the documents doesn't exceed."""
    spark = limits_.sparkSession
    wanted = spark.createDataFrame([(float(s),) for s in shares], "share double")
    return wanted.join(limits_, F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("context_limit").alias("n_tokens"))


def token_counts(documents: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """``limits`` of all documents.  Null and empty texts have length 0;
    repeated rows count each; an empty table gives no rows."""
    return limits(written(histogram(document_lengths(documents, name)), "lengths"))


def brute_force(lengths: list[int]) -> list[tuple]:
    """``limits`` by its definition, for tests."""
    x = np.array(lengths)
    return sorted((int(v), int((x == v).sum()), int(x[x == v].sum()), int((x > v).sum()), int(x.sum()), int(np.minimum(x, v).sum()), float((x <= v).mean())) for v in set(lengths))
