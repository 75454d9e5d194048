"""Robust statistics: trends, median deviations, indices, histograms. DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut

#: Values, of all groups together, that are aggregated whole; pieces of a larger group's range; groups that are sent to all tasks.
HELD, PIECES, FEW = 1_000_000, 4096, 100_000


def _q(c: str | Column, p: float) -> Column:
    return F.percentile(c, F.lit(p))


def _valued(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """_g (the columns of by as one) and _v of each row, as a written table; nulls are left out."""
    group = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in by]).alias("_g")
    return cut(df.select(group, F.col(value).cast("double").alias("_v")).where("_v is not null"))


def _few(table: DataFrame) -> DataFrame:
    """A written table of groups, sent to all tasks if it can be: dealt by group, a few groups would be as many tasks."""
    return F.broadcast(table) if table.count() <= FEW else table


def _between(p: float, low: Column, high: Column) -> Column:
    """The value at the share p of the _n - 1 steps between _n ranks, of the values at the ranks below and above it."""
    at = (F.col("_n") - 1) * F.lit(float(p))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def _pieces(log: bool) -> Column:
    """The piece of the range from _lo to _hi that _v is in: both ends are pieces of their own, so a range always gets smaller."""
    scaled = lambda c: F.signum(c) * F.log1p(F.abs(c))
    part = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    if log:
        part = F.coalesce(F.try_divide(scaled("_v") - F.col("_slo"), F.col("_shi") - F.col("_slo")), part)
    inner = 1 + F.least(F.lit(PIECES - 3), F.floor(F.nanvl(part, F.lit(0.0)) * (PIECES - 2))).cast("int")
    return F.when(F.col("_v") >= F.col("_hi"), PIECES - 1).when(F.col("_v") <= F.col("_lo"), 0).otherwise(inner)


def _inside(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows that are in one of their group's ranges, with it."""
    ranges = _few(ranges).withColumnRenamed("_g", "_h")
    return rows.join(ranges, (F.col("_g") == F.col("_h")) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop("_h")


def _hit(counts: DataFrame, ranges: DataFrame, order: str) -> DataFrame:
    """Of the parts of ranges (_g, _lo, _m rows, from _a to _b) those that hold a wanted rank, as ranges."""
    rows = counts.join(ranges.select("_g", "_lo", "_before", "_ranks"), ["_g", "_lo"])
    along = Window.partitionBy("_g", "_lo").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_m").over(along), F.lit(0)))
    here = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m")))
    return rows.select("_g", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), "_before", F.col("_m").alias("_size"), here.alias("_ranks")).where(F.size("_ranks") > 0)


def _quantiles(rows: DataFrame, wanted: dict[str, float], held: int, most: int) -> DataFrame:
    """_g, _n (how many values) and the exact quantiles, linear between neighbouring ranks, as a written table.

    rows: _g and _v, made from a written table of `most` rows. Up to `held` are aggregated whole.
    Beyond that each group's range is cut into pieces, whose counts tell which of them
    hold a wanted rank; these are cut again, until no more than `held` rows are left.
    Every pass reads the rows once and shuffles counts only.
    """
    names = list(wanted)
    if most <= held:
        found = F.percentile("_v", F.array(*[F.lit(float(p)) for p in wanted.values()]))
        out = rows.groupBy("_g").agg(F.count("*").alias("_n"), found.alias("_q"))
        return cut(out.select("_g", "_n", *[F.col("_q")[i].alias(name) for i, name in enumerate(names)]))
    groups = cut(rows.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    ranks = [f((F.col("_n") - 1) * F.lit(float(p))).cast("long") for p in wanted.values() for f in (F.floor, F.ceil)]
    ranges = groups.select("_g", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_size"), F.array_distinct(F.array(*ranks)).alias("_ranks"))
    done, first = [], True
    while left := (ranges.where("_lo < _hi").agg(F.sum("_size")).first()[0] or 0):
        done.append(ranges.where("_lo >= _hi"))
        ranges = ranges.where("_lo < _hi")
        if left <= held:
            counts = _inside(rows, ranges).groupBy("_g", "_lo", "_v").agg(F.count("*").alias("_m"))
            ranges = _hit(counts.withColumn("_a", F.col("_v")).withColumn("_b", F.col("_v")), ranges, "_v")
            break
        # The first cut is by magnitude, so that a few far values do not leave all others in one piece.
        scaled = lambda c: F.signum(c) * F.log1p(F.abs(c))
        ends = ranges.withColumn("_slo", scaled("_lo")).withColumn("_shi", scaled("_hi")) if first else ranges
        inside = _inside(rows, ends.drop("_before", "_size", "_ranks")).withColumn("_piece", _pieces(first))
        counts = inside.groupBy("_g", "_lo", "_piece").agg(F.count("*").alias("_m"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        ranges, first = cut(_hit(counts, ranges, "_piece")), False
    for part in done:
        ranges = ranges.unionByName(part)
    values = ranges.select("_g", "_lo", F.explode("_ranks").alias("_rank")).join(groups.select("_g", "_n"), "_g")
    at = [F.max(F.when(F.col("_rank") == r, F.col("_lo"))).alias(f"_r{i}") for i, r in enumerate(ranks)]
    found = values.groupBy("_g").agg(F.max("_n").alias("_n"), *at)
    return cut(found.select("_g", "_n", *[_between(p, F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")).alias(name) for i, (name, p) in enumerate(wanted.items())]))


def quantiles(df: DataFrame, value: str, by: list[str], wanted: dict[str, float], held: int = HELD) -> DataFrame:
    """The columns of by, n and the wanted quantiles of the groups that have a value; no row for an empty table."""
    rows = _valued(df, value, by)
    out = _quantiles(rows, wanted, held, rows.count())
    return out.select(*[F.col("_g")[c].alias(c) for c in by], F.col("_n").alias("n"), *wanted)


def _spread(rows: DataFrame, held: int, most: int) -> DataFrame:
    """_g, _med, _mad: each group's median, and the median of the distances from it, as a written table."""
    med = _quantiles(rows, {"_med": 0.5}, held, most).drop("_n")
    far = rows.join(_few(med), "_g").select("_g", F.abs(F.col("_v") - F.col("_med")).alias("_v"))
    return cut(med.join(_quantiles(far, {"_mad": 0.5}, held, most).drop("_n"), "_g"))


def trend(df: DataFrame, value: str, by: list[str], held: int = HELD) -> DataFrame:
    """n, median, q25, q75 of value by groups; rows without a value or a group's first column do not count."""
    return quantiles(df.na.drop(subset=[value, by[0]]), value, by, {"median": 0.5, "q25": 0.25, "q75": 0.75}, held)


def rolling_median(df: DataFrame, value: str, order: str, by: list[str], rows: int = 3, out: str = "median_smooth") -> DataFrame:
    """Centred median over neighbouring rows, however far apart their order values are."""
    half = rows // 2
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return df.withColumn(out, _q(value, 0.5).over(spec.orderBy(order).rowsBetween(-half, rows - 1 - half)))


def price_index(df: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """price_index and price_index_smooth: hundredths of the median of the base bins' medians; null without a base."""
    everything, inside = Window.partitionBy(), F.col(order).between(first, last)
    # One row per bin: a table this small may be one window.
    base = lambda c: _q(F.when(inside, F.col(c)), 0.5).over(everything)
    rows = df.withColumns({"_base": base("median"), "_smooth": base("median_smooth")})
    return rows.select(*df.columns, F.try_divide(100 * F.col("median"), F.col("_base")).alias("price_index"), F.try_divide(100 * F.col("median_smooth"), F.col("_smooth")).alias("price_index_smooth"))


def mad(df: DataFrame, value: str, by: list[str], held: int = HELD) -> DataFrame:
    """df with _med and _mad of its group, null in groups without a value; joined back, so that no group is one task's window."""
    rows = _valued(df, value, by)
    both = _few(_spread(rows, held, rows.count())).select(*[F.col("_g")[c].alias(f"_k_{c}") for c in by], "_med", "_mad")
    return df.join(both, [df[c].eqNullSafe(both[f"_k_{c}"]) for c in by], "left").drop(*[f"_k_{c}" for c in by])


def group_outliers(df: DataFrame, value: str, by: list[str], prefix: str, z: float = 4.0) -> DataFrame:
    """prefix_GroupZ and prefix_IsOutlier; no z where the deviation is 0, and then no outlier."""
    rows = mad(df, value, by)
    score = F.when(F.col("_mad") > 0, 0.6745 * (F.col(value) - F.col("_med")) / F.col("_mad"))
    rows = rows.withColumn(f"{prefix}_GroupZ", score).withColumn(f"{prefix}_IsOutlier", F.coalesce(F.abs(score) >= z, F.lit(False)))
    return rows.drop("_med", "_mad")


def robust_summary(df: DataFrame, value: str, by: list[str], mad_z: float | None = 4.0, winsor: tuple[float, float] | None = None, min_n: int = 1, held: int = HELD) -> DataFrame:
    """n, median, q25, q75 by groups, in logarithms, after trimming by deviation and, if asked, clipping at quantiles.

    df is read once; all passes are over the written table of its values.
    """
    rows = df.na.drop(subset=[value, *by]).where((F.col(value) > 0) & (F.col(value) < float("inf"))).withColumn("_z", F.log10(value))
    rows = _valued(rows, "_z", by)
    most = rows.count()
    if mad_z is not None:
        near = F.abs(0.6745 * (F.col("_v") - F.col("_med")) / F.when(F.col("_mad") > 0, F.col("_mad"))) <= mad_z
        rows = rows.join(_few(_spread(rows, held, most)), "_g").where((F.col("_mad") == 0) | near).select("_g", "_v")
    if winsor:
        ends = _quantiles(rows, {"_first": winsor[0], "_last": winsor[1]}, held, most).drop("_n")
        rows = rows.join(_few(ends), "_g").select("_g", F.greatest("_first", F.least("_last", "_v")).alias("_v"))
    out = _quantiles(rows, {"median": 0.5, "q25": 0.25, "q75": 0.75}, held, most)
    ten = [F.pow(F.lit(10.0), F.col(c)).alias(c) for c in ("median", "q25", "q75")]
    return out.where(F.col("_n") >= min_n).select(*[F.col("_g")[c].alias(c) for c in by], F.col("_n").alias("n"), *ten)


def top_values(df: DataFrame, column: str, n: int, rank_by: Column | None = None) -> DataFrame:
    """The n values with the most rows (or the largest rank_by), ties to the smaller value."""
    return df.groupBy(column).agg((rank_by if rank_by is not None else F.count("*")).alias("_n")).orderBy(F.desc("_n"), column).limit(n).select(column)


def restrict_top(df: DataFrame, column: str, n: int, rank_by: Column | None = None) -> DataFrame:
    return df.join(top_values(df, column, n, rank_by), column, "left_semi")


def value_counts(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The most frequent values; blanks and nulls as (blank); ties by value."""
    label = F.when(F.coalesce(F.trim(F.col(column)), F.lit("")) == "", "(blank)").otherwise(F.col(column))
    return df.groupBy(label.alias(column)).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)


def histogram(df: DataFrame, value: str, n_bins: int) -> DataFrame:
    """bin (from 0), low, high, count of all n_bins bins of equal width from the least to the greatest value; the last one is closed."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_x"))
    ends = rows.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    ends = ends.select(F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    place = F.least(F.lit(n_bins - 1), F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * n_bins))
    counts = rows.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("_c"))
    step = (F.col("_hi") - F.col("_lo")) / n_bins
    frame = ends.where("_lo is not null").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return frame.join(counts, "bin", "left").select("bin", (F.col("_lo") + step * F.col("bin")).alias("low"), (F.col("_lo") + step * (F.col("bin") + 1)).alias("high"), F.coalesce("_c", F.lit(0)).cast("long").alias("count"))


def clip_tail(df: DataFrame, value: str, quantile: float = 0.995, held: int = HELD) -> DataFrame:
    """Rows up to the quantile of value."""
    end = quantiles(df, value, [], {"_end": quantile}, held).select("_end")
    return df.crossJoin(F.broadcast(end)).where(F.col(value) <= F.col("_end")).drop("_end")


def log_histogram(df: DataFrame, value: str, n_bins: int = 45, quantile: float = 0.995) -> DataFrame:
    rows = clip_tail(df.where((F.col(value) > 0) & (F.col(value) < float("inf"))), value, quantile)
    return histogram(rows.withColumn("_log", F.log10(value)), "_log", n_bins)


def extremes(df: DataFrame, value: str, n: int = 50, ties: list[str] | None = None) -> DataFrame:
    """The n rows of the largest positive values; none for n = 0."""
    return df.where(F.col(value) > 0).orderBy(F.desc(value), *(ties or [])).limit(n)
