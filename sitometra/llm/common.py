"""What the operators share: reading tables, words, cutting lineage, and joins on hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import cut, forget

__all__ = ["cut", "forget", "join_salted", "n_words", "salted", "table", "text_key"]

#: The separators of words, as the contracts state them.
WORD = r"[^\x20\x09-\x0D]+"
#: How many keys may be told to all tasks as hot: their bound, whatever the table's size.
HOT_KEYS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted(rows: DataFrame, on: str, by: Column, per: int = 1000) -> tuple[DataFrame, DataFrame | None]:
    """rows with _salt, which deals the rows of a hot key by `by`; and the hot keys: `on`, _salts (how many), None if rows are too few for any.

    A key is hot from `per` rows on, or from so many that there cannot be more than
    HOT_KEYS of them, so they may be sent to all tasks. rows is read three times: it
    should be a written table. A null key is not hot and has salt 0.
    """
    total = rows.count()
    if total <= per:
        return rows.withColumn("_salt", F.lit(0)), None
    per = max(per, total // HOT_KEYS)
    hot = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_c")).where(F.col("_c") > per)
    hot = hot.select(on, F.ceil(F.col("_c") / per).cast("int").alias("_salts"))
    salt = F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(1))).cast("int")
    return rows.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_salts"), hot


def join_salted(rows: DataFrame, other: DataFrame, on: str, by: Column, how: str = "left", per: int = 1000) -> DataFrame:
    """rows joined to other on `on`, the rows of a hot key dealt to several tasks by `by`; see salted()."""
    dealt, hot = salted(rows, on, by, per)
    if hot is None:
        return rows.join(other, on, how)
    other = other.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(other, [on, "_salt"], how).drop("_salt")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text (null as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
