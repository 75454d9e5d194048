"""From linked rows to analysable prices, and the queue of rows to review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DRACHMAS_NARROW, DRACHMAS_WIDE, LITRES
from ..functions import canon, numbers, text
from . import stats

KEY = ["DDB_ID", "Mention_ID", "Grain_Index"]


def dedupe_best(df: DataFrame, keys: list[str], score: str = "Score", ties: list[str] | None = None) -> DataFrame:
    """The row of the best score for each key; equal scores by the ties' order."""
    spec = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), *(ties or []))
    return df.withColumn("_rank", F.row_number().over(spec)).where("_rank = 1").drop("_rank")


def select_primary(df: DataFrame) -> DataFrame:
    """Rows marked primary; else those ranked first; else the best of each key; else all. Two checks for one row each decide."""
    columns = set(df.columns)
    if "Is_Primary" in columns:
        marked = df.where(text.is_yes(F.col("Is_Primary")))
        if marked.limit(1).count():
            return marked
    if "Candidate_Rank" in columns:
        first = df.where(F.trim(F.col("Candidate_Rank").cast("string")) == "1")
        if first.limit(1).count():
            return first
    if {*KEY, "Score"} <= columns:
        rows = df.withColumn("_score", numbers.to_num(F.col("Score")))
        return dedupe_best(rows, KEY, "_score", [c for c in df.columns if c not in KEY]).drop("_score")
    return df


def standard_prices(df: DataFrame) -> DataFrame:
    """Price_DrachmaEq, Qty_Liters, prices per litre and per artaba, and the logarithm, from PriceNum, QtyNum, Cur_Canon, Unit_Canon."""
    rows = df.withColumn("Price_DrachmaEq", F.col("PriceNum") * numbers.lookup(F.col("Cur_Canon"), DRACHMAS_WIDE))
    rows = rows.withColumn("Qty_Liters", F.col("QtyNum") * numbers.lookup(F.col("Unit_Canon"), LITRES))
    rows = rows.withColumn("Price_per_Liter_DrachmaEq", F.when(F.col("Qty_Liters") > 0, F.col("Price_DrachmaEq") / F.col("Qty_Liters")))
    rows = rows.withColumn("Price_per_Artaba_DrachmaEq", F.col("Price_per_Liter_DrachmaEq") * LITRES["artaba"])
    return rows.withColumn("log_Price_per_Liter", F.log10("Price_per_Liter_DrachmaEq"))


def artaba_prices(df: DataFrame) -> DataFrame:
    """The narrow table's prices per artaba; columns that are missing are null."""
    def of(*names: str):
        there = [numbers.to_num(F.col(n)) for n in names if n in df.columns]
        return F.coalesce(*there) if there else F.lit(None).cast("double")

    def word(name: str):
        return F.col(name) if name in df.columns else F.lit("")

    rows = df.withColumn("PriceNum", of("PriceNum", "Price_Value")).withColumn("QtyNum", of("QtyNum", "Qty_Value"))
    rows = rows.withColumn("Price_DrachmaEq_calc", F.col("PriceNum") * numbers.lookup(word("Cur_Canon"), DRACHMAS_NARROW))
    litres = F.when(F.col("QtyNum") > 0, F.col("QtyNum") * numbers.lookup(word("Unit_Canon"), LITRES))
    rows = rows.withColumn("Qty_ArtabaEq_calc", litres / LITRES["artaba"])
    return rows.withColumn("UnitPrice_Drachma_per_ArtabaEq_calc", F.when(F.col("Qty_ArtabaEq_calc") > 0, F.col("Price_DrachmaEq_calc") / F.col("Qty_ArtabaEq_calc")))


def clean(linked: DataFrame, year_width: int = 25) -> DataFrame:
    """Linked rows (all text) with canonical names, numbers, years, contexts, tiers and standard prices."""
    rows = linked.na.fill("")
    for out, source, name in (("Grain_Canon", "Grain_Form", canon.grain), ("Unit_Canon", "Qty_Unit", canon.unit), ("Cur_Canon", "Price_Cur", canon.currency), ("Place_Canon", "Place", canon.place)):
        rows = rows.withColumn("_norm", text.norm_greek(F.col(source))).withColumn(out, name(F.col("_norm"))).drop("_norm")
    rows = rows.withColumn("QtyNum", numbers.to_float(F.col("Qty_Value"))).withColumn("PriceNum", numbers.to_float(F.col("Price_Value")))
    rows = rows.withColumn("UnitPrice_raw", F.when(F.col("QtyNum") > 0, F.col("PriceNum") / F.col("QtyNum")))
    rows = rows.withColumn("Year", numbers.infer_year(F.col("Date_When"), F.col("Date_NotBefore"), F.col("Date_NotAfter"))).withColumn("YearBin", numbers.year_bin(F.col("Year"), year_width))
    if "Context_Window" in rows.columns:
        rows = rows.withColumn("Context_Clean", text.clean_context(F.col("Context_Window"))).withColumn("Context_OneLine", text.one_line(F.col("Context_Clean")))
    rows = rows.withColumn("Tier", numbers.quality_tier(numbers.to_num(F.col("Score")), text.is_yes(F.col("Ambiguous"))))
    return standard_prices(rows)


def main_filter(df: DataFrame, min_score: float = 60.0, drop_ambiguous: bool = False) -> DataFrame:
    rows = df.where(numbers.to_num(F.col("Score")) >= min_score)
    return rows.where(~text.is_yes(F.col("Ambiguous"))) if drop_ambiguous else rows


def subset(df: DataFrame, **equal: str | tuple[str, ...]) -> DataFrame:
    """Rows whose columns have the given value, or one of several."""
    for name, value in equal.items():
        df = df.where(F.col(name).isin(*((value,) if isinstance(value, str) else value)))
    return df


def graph_filter(df: DataFrame, min_score: float = 0.0, drop_ambiguous: bool = False, year_min: float | None = None, year_max: float | None = None) -> DataFrame:
    """Rows of that score and, if there are bounds, of a year within them, both ends in; without a year a row goes only if there is a bound."""
    rows = main_filter(df, min_score, drop_ambiguous and "Ambiguous" in df.columns)
    year = numbers.to_num(F.col("Year")) if "Year" in df.columns else F.lit(None).cast("double")
    rows = rows.where(year >= year_min) if year_min is not None else rows
    return rows.where(year <= year_max) if year_max is not None else rows


REASONS = (
    # Reason, weight in the priority.
    ("ambiguous", 3.0),
    ("low_score(<60)", 2.5),
    ("missing_or_bad_qty", 2.0),
    ("wide_span(>=60)", 1.5),
    ("far_grain_price(>=35)", 1.2),
    ("no_priceword_near", 1.0),
    ("group_outlier_raw_unitprice", 2.0),
    ("group_outlier_std_price_per_liter", 2.0),
    ("unitprice_top1pct", 0.0),
)


def review_queue(df: DataFrame, ties: list[str] | None = None, limit: int | None = 600) -> DataFrame:
    """Rows with a reason to look at them, by priority and then score; columns that are missing give no reason."""
    there = set(df.columns)
    no = F.lit(False)
    score = numbers.to_num(F.col("Score")) if "Score" in there else F.lit(None).cast("double")
    def num(name: str):
        return numbers.to_num(F.col(name)) if name in there else F.lit(None).cast("double")

    rows = df
    top = no
    if "UnitPrice_raw" in there:
        # One row, also where no row has a price.
        end = stats.quantiles(df, "UnitPrice_raw", [], {"_top": 0.99}).agg(F.max("_top").alias("_top"))
        rows = rows.crossJoin(F.broadcast(end))
        top = F.col("UnitPrice_raw") >= F.col("_top")
    found = (
        text.is_yes(F.col("Ambiguous")) if "Ambiguous" in there else no,
        score < 60,
        num("QtyNum").isNull() | (num("QtyNum") <= 0) if "QtyNum" in there else no,
        num("Span_Toks") >= 60,
        num("Dist_GP") >= 35,
        F.lower(F.col("Priceword_Near").cast("string")) == "no" if "Priceword_Near" in there else no,
        F.col("RAW_Group_IsOutlier") if "RAW_Group_IsOutlier" in there else no,
        F.col("STD_Group_IsOutlier") if "STD_Group_IsOutlier" in there else no,
        top,
    )
    found = [F.coalesce(c, no) for c in found]
    reason = F.concat_ws("; ", *[F.when(c, F.lit(name)) for c, (name, _) in zip(found, REASONS, strict=True)])
    priority = sum((F.when(c, weight).otherwise(0.0) for c, (_, weight) in zip(found, REASONS, strict=True)), F.lit(0.0))
    rows = rows.withColumn("ReviewReason", reason).withColumn("ReviewPriority", priority).drop("_top").where("ReviewReason <> ''")
    rows = rows.orderBy(F.desc("ReviewPriority"), score.asc(), *(ties or []))
    return rows.limit(limit) if limit else rows


def trend_tables(rows: DataFrame, value: str, by: list[str], smooth: int = 3) -> DataFrame:
    """Trend with its rolling median, in the order of by; the first of by is the one smoothed along."""
    return stats.rolling_median(stats.trend(rows, value, by), "median", by[0], by[1:], smooth).orderBy(*by)


def top_trends(trend: DataFrame, label: str, min_n: int = 1, top: int = 6) -> DataFrame:
    """Of a trend by label its points of min_n rows or more, for the labels whose points have the most rows together."""
    rows = trend.where(F.col("n") >= min_n)
    return stats.restrict_top(rows, label, top, F.sum("n"))
