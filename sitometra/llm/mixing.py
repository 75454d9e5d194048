"""Mixing sources to target weights, by hash-random keys and distributed prefix sums.

Only DataFrame operations; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words


def targets(sizes: DataFrame, source: str, weight: Column, cap: float) -> DataFrame:
    """Share the sum of all sizes among the sources by weight, none above cap times its size.

    sizes: one row per source with source, source_size, n_docs. The sources, ordered
    by cap * size / weight, fill up in that order: the capped ones are a prefix, and
    the level of the others follows from sums over it. The windows here run over
    one row per source.
    """
    w = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("position"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    w = (
        w.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("capped", F.col("most") < F.col("level") * F.col("weight"))
    )
    # The first source that is not capped sets the level of it and all after it.
    rest = F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("weight"), "position", "level"))).over(everything)["level"]
    w = w.withColumn("rest", rest)
    return w.select(source, "source_size", "n_docs", F.when(F.col("capped"), F.col("most")).otherwise(F.col("rest") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, *, key: Column, size: Column, source: str = "source", weight: Column | None = None, cap: float = 3.0, seed: int = 7, per_bucket: int = 2_000) -> DataFrame:
    """docs with size, source_size, target, epochs (whole takes), part (words of one more take) and taken.

    Documents get the random key md5(seed:key), and are dealt to buckets that are
    ranges of that key, about per_bucket documents each, so a hot source is many
    tasks. Sums over the buckets, then within them, give each document its place in
    its source; the cut is at the target's whole words. Reruns agree: the order is by
    key, then by size. Rows that repeat a key are interchangeable. A null source is
    a source of its own; a null text has size 0 and is never taken. With no weight
    given, sources in code-point order, null last, weigh 1, 2, 3, repeating.
    Columns of docs keep their names, but for those named above, which are replaced,
    and the names beginning with _mix_.
    """
    added = ["size", "source_size", "target", "epochs", "part", "taken"]
    # A null key has a value of its own, beside every text of a key.
    rows = docs.drop(*added).withColumn("_mix_size", size).withColumn("_mix_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))))
    sizes = rows.groupBy(F.col(source).alias("_mix_source")).agg(F.sum("_mix_size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("_mix_source").asc_nulls_last())
    sizes = sizes.withColumn("position", F.row_number().over(by_name))
    goals = targets(sizes, "_mix_source", (weight if weight is not None else (F.col("position") - 1) % 3 + 1).cast("double"), cap)
    goals = goals.withColumn("_mix_buckets", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / per_bucket)).cast("long"))
    # One row per source: a few, unless there are very many sources; Spark chooses the join by their size.
    rows = rows.join(goals, rows[source].eqNullSafe(goals["_mix_source"]), "inner")
    prefix = F.conv(F.substring("_mix_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_mix_bucket", F.floor(prefix * F.col("_mix_buckets") / F.lit(float(1 << 32))).cast("long"))
    sums = rows.groupBy("_mix_source", "_mix_bucket").agg(F.sum("_mix_size").alias("_mix_sum"))
    along = Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_mix_source").alias("_mix_s"), F.col("_mix_bucket").alias("_mix_b"), F.coalesce(F.sum("_mix_sum").over(along), F.lit(0)).alias("_mix_before"))
    rows = rows.join(sums, F.col("_mix_source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_bucket") == F.col("_mix_b")))
    inside = Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_key", "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_mix_before") + F.coalesce(F.sum("_mix_size").over(inside), F.lit(0))
    goal = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("size", F.col("_mix_size")).withColumn("_mix_start", start).withColumn("epochs", epochs)
    left = goal - F.col("epochs") * F.col("source_size")
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_mix_start"))).cast("long"))
    rows = rows.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    return rows.select(*[c for c in docs.columns if c not in added], *added)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document of the mix: doc_id, size, source_size, target, taken, epochs, part.

    The texts are read and counted once, into a written table.
    """
    counted = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("_n_words")))
    mixed = mix(counted, key=F.col("doc_id"), size=F.col("_n_words"), **options)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs", "part")


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with every document as often as the mix takes it; the one at a source's cut goes whole if half of it fits.

    The columns are those of docs. Words do not decide about documents without any:
    those of size 0 stay once.
    """
    # Named apart, so that a column of docs called size or target is kept.
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", n_words(F.col("text")).alias("_n_words"))
    mixed = mix(kept, key=F.col("doc_id"), size=F.col("_n_words"), **options)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs") + (F.col("part") * 2 >= F.col("size")).cast("long"))
    mixed = mixed.withColumn("_times", times.cast("int")).where("_times > 0")
    return mixed.withColumn("_take", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select("_row.*")
