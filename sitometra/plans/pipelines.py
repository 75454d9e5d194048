"""The five stages from files to files, each a function of the session, paths and options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnalyzeOptions, GraphOptions, HarvestOptions, LinkOptions, SampleOptions
from ..functions import numbers
from ..operators import analyze, harvest, link, sample, stats
from ..sources import tables, xml
from ..sources.store import cut


def run_harvest(spark: SparkSession, editions: str, metadata: str, out: str | None = None, options: HarvestOptions = HarvestOptions()) -> DataFrame:
    meta = xml.latest_metadata(xml.parse_metadata(xml.read_corpus(spark, metadata)))
    rows = harvest.harvest(xml.read_corpus(spark, editions), meta, editions, options)
    if out and rows.limit(1).count():
        tables.write_csv(rows, out)
    return rows


@dataclass
class Linked:
    rows: DataFrame
    mentions: DataFrame
    missing: DataFrame  # jobs whose file is not there
    files: DataFrame  # path and parsed, of the jobs' files

    def counts(self) -> dict[str, int]:
        """Counts of the run; each is a job of its own."""
        parsed = self.files.agg(F.count("*").alias("n"), F.count_if("parsed").alias("ok")).first()
        return {"files": parsed["n"], "parsed": parsed["ok"], "not_parsed": parsed["n"] - parsed["ok"], "missing": self.missing.count(), "rows": self.rows.count(), "mentions": self.mentions.count()}


def run_link(spark: SparkSession, candidates: DataFrame, editions: str, out: str | None = None, out_mentions: str | None = None, options: LinkOptions = LinkOptions(), mode: str = "overwrite") -> Linked:
    """Linked rows and mentions of the candidates' files; mode="append" adds them to what is in out and out_mentions."""
    jobs = tables.candidate_jobs(tables.require_columns(candidates, ("DDB_ID", "XML_RelPath")), options.max_docs)
    keep = [F.col(c) if c in jobs.columns else F.lit("").alias(c) for c in link.META]
    jobs = jobs.select("DDB_ID", "XML_RelPath", *keep)
    files = xml.read_corpus(spark, editions).withColumn("XML_RelPath", xml.relative_path(F.col("path"), editions))
    wanted = files.join(jobs.select("XML_RelPath").distinct(), "XML_RelPath", "left_semi")
    blocks = xml.parse_blocks(wanted.select("path", "content"), options.scan_commentary).drop("ddb_id").withColumn("XML_RelPath", xml.relative_path(F.col("path"), editions))
    # Files are parsed and events found once, for rows and mentions.
    found = cut(link.find_mentions(tables.with_files(jobs, blocks), options))
    missing = tables.missing_files(jobs, files.select("XML_RelPath"), right="XML_RelPath").select("DDB_ID", "XML_RelPath")
    result = Linked(link.link(found, options), link.mention_rows(found, options), missing, xml.parse_status(wanted.select("path", "content")))
    if out:
        tables.write_csv(result.rows, out, mode)
    if out_mentions:
        tables.write_csv(result.mentions, out_mentions, mode)
    return result


def run_analyze(linked: DataFrame, out: str | None = None, options: AnalyzeOptions = AnalyzeOptions()) -> dict[str, DataFrame]:
    primary = cut(analyze.clean(analyze.select_primary(linked.na.fill("")), options.year_bin))
    groups = ["Grain_Canon", "Unit_Canon", "Cur_Canon"]
    main = analyze.main_filter(primary, options.min_score, options.drop_ambiguous)
    main = stats.group_outliers(main, "UnitPrice_raw", groups, "RAW_Group", options.outlier_z)
    main = cut(stats.group_outliers(main, "Price_per_Liter_DrachmaEq", groups, "STD_Group", options.outlier_z))
    subset = analyze.subset(main, Grain_Canon=options.grain, Unit_Canon="artaba", Cur_Canon="drachma")
    trend = analyze.trend_tables(subset, "UnitPrice_raw", ["YearBin"], options.smooth_rows)
    places = analyze.trend_tables(subset, "UnitPrice_raw", ["YearBin", "Place_Canon"], options.smooth_rows)
    made = {
        "primary": primary,
        "main": main,
        "subset": subset,
        "trend_all": trend,
        "trend_place": places,
        # Frames of charts: trends of enough rows, lines of the places with most rows, points.
        "chart_trend": trend.where(F.col("n") >= options.min_n),
        "chart_places": analyze.top_trends(places, "Place_Canon", options.min_n, options.top_places),
        "chart_scatter": subset.select("Year", "Place_Canon", "UnitPrice_raw", "Tier").where("Year is not null and UnitPrice_raw is not null"),
        "price_index": stats.price_index(trend, "YearBin", options.base_first, options.base_last),
        "review": analyze.review_queue(main, ["DDB_ID", "Mention_ID", "Grain_Index"], options.review_rows),
        "hist_score": stats.histogram(primary.withColumn("_s", numbers.to_num(F.col("Score"))), "_s", 30),
    }
    if out:
        for name, df in made.items():
            tables.write_csv(df, f"{out}/{name}")
    return made


def run_graphs(cleaned: DataFrame, out: str | None = None, options: GraphOptions = GraphOptions()) -> dict[str, DataFrame]:
    """The frames behind the charts, the robust trends and the extremes."""
    rows = analyze.graph_filter(cleaned, options.min_score, options.drop_ambiguous, options.year_min, options.year_max)
    rows = rows.withColumn("_score", numbers.to_num(F.col("Score")))
    rows = analyze.artaba_prices(rows)
    focus = analyze.subset(rows, Grain_Canon=options.grain) if options.grain and "Grain_Canon" in rows.columns else rows
    price = "UnitPrice_Drachma_per_ArtabaEq_calc"
    made = {"hist_score": stats.histogram(rows, "_score", 40), "hist_price": stats.log_histogram(rows, price)}
    made |= {f"counts_{c}": stats.value_counts(rows, c, 12) for c in ("Grain_Canon", "Unit_Canon", "Cur_Canon", "Place_Canon") if c in rows.columns}
    made["extremes"] = stats.extremes(focus, price, options.extremes, [c for c in ("DDB_ID", "Mention_ID", "Grain_Index") if c in focus.columns])
    if "YearBin" in rows.columns:
        focus = focus.withColumn("YearBin", numbers.to_num(F.col("YearBin").cast("string")).cast("int"))
        made["robust_trend"] = stats.robust_summary(focus, price, ["YearBin"], options.mad_z, options.winsor, options.min_n_bin).orderBy("YearBin")
        if "Place_Canon" in rows.columns:
            top = stats.restrict_top(focus, "Place_Canon", options.topn_places)
            made["place_trend"] = stats.robust_summary(top, price, ["Place_Canon", "YearBin"], options.mad_z, options.winsor, options.min_n_bin).orderBy("Place_Canon", "YearBin")
    if {"Year", "Place_Canon"} <= set(focus.columns):
        made["scatter"] = focus.select("Year", "Place_Canon", price).where(F.col(price).isNotNull())
    if out:
        for name, df in made.items():
            tables.write_csv(df, f"{out}/{name}")
    return made


def run_sample(linked: DataFrame, out: str | None = None, options: SampleOptions = SampleOptions()) -> DataFrame:
    rows = sample.sample_rows(linked, list(options.key), options.per_bin, options.seed, options.max_score, options.allow_fill)
    if not rows.limit(1).count():
        raise ValueError("no rows to sample")
    if out:
        tables.write_csv(rows, out)
    return rows
