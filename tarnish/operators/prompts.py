"""Prompt tables: templates by class, replication, and context splicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Display names of classes, and the states of any class.
ALIASES = {
    "macaroni1": "macaroni",
    "macaroni2": "macaroni",
    "pcb1": "printed circuit board",
    "pcb2": "printed circuit board",
    "pcb3": "printed circuit board",
    "pcb4": "printed circuit board",
    "pipe_fryum": "pipe fryum",
    "chewinggum": "chewing gum",
    "metal_nut": "metal nut",
}
GENERIC_STATES = ["damaged {}", "flawed {}", "abnormal {}", "imperfect {}", "blemished {}", "{} with flaw", "{} with defect", "{} with damage"]


def aliases(spark: SparkSession, by: str = "class") -> DataFrame:
    """(``by``, display): the fixed display names, for ``display_name``."""
    return spark.createDataFrame(list(ALIASES.items()), f"`{by}` string, display string")


def expand_prompts(classes: DataFrame, generic: list[str], specific: DataFrame) -> DataFrame:
    """A prompt for each class and state, duplicates kept.

    classes: (class, display); specific: (class, template)."""
    every = classes.select("class", "display", F.explode(F.array(*map(F.lit, generic))).alias("template"))
    own = classes.join(specific, "class").select("class", "display", "template")
    return every.unionAll(own).select("class", "template", F.replace("template", F.lit("{}"), F.col("display")).alias("prompt"))


def replicate_prompts(prompts: DataFrame, n_ctx: int, n_pro: int, n_ctx_ab: int, n_pro_ab: int) -> DataFrame:
    """(class, kind, copy, text): ``n_pro`` normal prompts of a class, each
    state ``n_pro`` times, and ``n_pro_ab`` times ``n_pro`` learned ones."""
    names = prompts.select("class", "display").distinct()
    pre, pre_ab = " ".join(["N"] * n_ctx), " ".join(["A"] * n_ctx_ab)
    copies = lambda df, n: df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    normal = copies(names, n_pro).select("class", F.lit("normal").alias("kind"), "copy", F.concat_ws(" ", F.lit(pre), "display").alias("text"))
    states = copies(prompts, n_pro).select("class", F.lit("state").alias("kind"), "copy", F.concat_ws(" ", F.lit(pre), "prompt").alias("text"))
    learned = copies(names, n_pro * n_pro_ab).select("class", F.lit("learned").alias("kind"), "copy", F.concat_ws(" ", F.lit(pre), "display", F.lit(pre_ab)).alias("text"))
    return normal.unionAll(states).unionAll(learned)


def learned_pairs(spark: SparkSession, n_pro: int, n_pro_ab: int) -> DataFrame:
    """Which normal and abnormal context each learned row takes: both by
    modulo, so all pairs occur only if the two numbers share no factor."""
    r = spark.range(n_pro * n_pro_ab).select(F.col("id").cast("int").alias("copy"))
    return r.withColumns({"normal": F.col("copy") % n_pro, "abnormal": F.col("copy") % n_pro_ab})


def splice_context(seq: Column, context: Column, n: int) -> Column:
    """First item, context, then from place 1 + n on; the length stays."""
    return F.concat(F.slice(seq, 1, 1), context, F.slice(seq, n + 2, F.greatest(F.size(seq) - n - 1, F.lit(0))))
