"""Stratified samples for annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text


def strata(df: DataFrame, score: Column, ambiguous: Column, top: int = 80) -> DataFrame:
    """Rows with Sample_Bin and Sample_Group; scores outside 0 to top, and labels that are no declared bin, go."""
    label = F.when(text.is_yes(ambiguous, strip=True), "ambiguous").otherwise("non_ambiguous")
    rows = df.withColumn("Sample_Bin", numbers.score_bin(score, top)).withColumn("Sample_Group", label)
    return rows.where(F.col("Sample_Bin").isin(*numbers.bins(top)))


def stratum_sizes(rows: DataFrame) -> DataFrame:
    """Sample_Bin, Sample_Group and n of every stratum that has rows."""
    return rows.groupBy("Sample_Bin", "Sample_Group").agg(F.count("*").alias("n"))


def stratified(df: DataFrame, key: Column, per_bin: int = 10, seed: int = 42, fill: bool = False) -> DataFrame:
    """Of each bin half ambiguous rows and half others, as far as there are; with fill, others make up the number.

    The draw is by md5(seed:key), so it repeats. Each group is cut to per_bin rows
    before a bin's rows meet.
    """
    half = per_bin // 2
    quota = F.when(F.col("Sample_Group") == "ambiguous", half).otherwise(per_bin - half)
    drawn = df.withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}:"), key)))
    rank = F.row_number().over(Window.partitionBy("Sample_Bin", "Sample_Group").orderBy("_draw"))
    rows = drawn.withColumn("_rank", rank).where(F.col("_rank") <= per_bin).withColumn("_own", F.col("_rank") <= quota)
    if fill:
        order = Window.partitionBy("Sample_Bin").orderBy(F.col("_own").desc(), "_draw")
        rows = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_bin).drop("_place")
    else:
        rows = rows.where("_own")
    return rows.drop("_draw", "_rank", "_own")


def sample_rows(df: DataFrame, key: list[str], per_bin: int = 10, seed: int = 42, top: int = 80, fill: bool = False) -> DataFrame:
    """The sample of primary rows with Human_Label and Annotation_Notes to fill in, by bin, score and document."""
    rows = df.where(text.is_yes(F.col("Is_Primary"), strip=True)) if "Is_Primary" in df.columns else df
    rows = rows.withColumn("_score", numbers.to_num(F.col("Score")))
    picked = stratified(strata(rows, F.col("_score"), F.col("Ambiguous"), top), F.concat_ws(":", *key), per_bin, seed, fill)
    out = ["Sample_Bin", "Sample_Group", *df.columns]
    return picked.orderBy("Sample_Bin", "_score", *key).select(*out, F.lit("").alias("Human_Label"), F.lit("").alias("Annotation_Notes"))
