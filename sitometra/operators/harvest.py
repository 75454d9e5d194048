"""Candidate documents: which blocks speak of grain, numbers and prices, and what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HALF, HarvestOptions, Lexicon
from ..functions import text
from ..sources import xml


def stems(norm: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_extract_all(norm, F.lit(Lexicon.word(words)), F.lit(1))


def number_evidence(tags: Column, values: Column, raw: Column, norm: Column, lexicon: Lexicon) -> tuple[Column, Column]:
    """Whether a block has numbers, and of which kind: marked ones come before digits, and those before Greek numerals.

    Marks without any value count as numbers of no kind.
    """
    digits, numeral = raw.rlike("[0-9]+"), norm.rlike(lexicon.numeral)
    kind = F.when(tags > 0, F.when(F.size(values) > 0, "num_tag")).when(digits, "digit").when(numeral, "greek_numeral")
    return (tags > 0) | digits | numeral, kind


def block_evidence(blocks: DataFrame, options: HarvestOptions = HarvestOptions(), norm: str = "norm") -> DataFrame:
    """blocks with keep and what each has: grain, unit and money stems, priceword, number_type."""
    lex = options.lexicon
    n = F.col(norm)
    money = stems(n, lex.money)
    if lex.half_is_money:
        half = F.regexp_extract_all(n, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({HALF})"), F.lit(1))
        money = F.concat(money, half)
    has, kind = number_evidence(F.col("num_tag_count"), F.col("num_values"), F.col("raw_text"), n, lex)
    rows = blocks.withColumn("grain", stems(n, lex.grain)).withColumn("unit", stems(n, lex.unit)).withColumn("money", money)
    rows = rows.withColumn("priceword", n.rlike(lex.priceword)).withColumn("number_type", kind).withColumn("has_number", has)
    keep = (F.size("grain") > 0) & ((F.size("money") > 0) | F.col("priceword"))
    keep = keep & F.col("has_number") if options.require_number else keep
    keep = keep & (F.size("unit") > 0) if options.require_unit else keep
    return rows.withColumn("keep", keep)


def roll_up(evidence: DataFrame, by: list[str], order: list[str], options: HarvestOptions = HarvestOptions()) -> DataFrame:
    """One row per document that has a kept block: sets of stems, numbers, the first snippets, and a score of 0 to 4."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    snippet = F.struct(*order, F.substring("raw_text", 1, options.snippet_chars).alias("snippet"))
    rows = evidence.where("keep").groupBy(*by).agg(
        F.count("*").cast("int").alias("Block_Match_Count"),
        union("grain").alias("_grain"),
        union("unit").alias("_unit"),
        union("money").alias("_money"),
        F.max("priceword").alias("_price"),
        F.array_sort(F.collect_set("number_type")).alias("_types"),
        union("num_values").alias("_values"),
        union("num_texts").alias("_texts"),
        F.slice(F.array_sort(F.collect_list(snippet)), 1, min(3, options.max_snippets)).alias("_snips"),
    )
    yes = lambda c: c.cast("int")
    score = yes(F.size("_unit") > 0) + yes(F.size("_money") > 0) + yes(F.col("_price")) + yes(F.array_contains("_types", "num_tag"))
    part = lambda i: F.coalesce(F.get("_snips", F.lit(i))["snippet"], F.lit("")).alias(f"Snippet_{i + 1}")
    return rows.select(
        *by, score.alias("Score"), "Block_Match_Count", F.array_join("_grain", ";").alias("Grain_Hits"), F.array_join("_unit", ";").alias("Unit_Hits"), F.array_join("_money", ";").alias("Money_Hits"),
        F.when(F.col("_price"), "yes").otherwise("no").alias("Priceword_Hit"), F.array_join("_types", ";").alias("Number_Type_Summary"), F.array_join("_values", ";").alias("Num_Tag_Values"), F.array_join("_texts", ";").alias("Num_Tag_Texts"),
        part(0), part(1), part(2),
    )


def by_score(rows: DataFrame, score: str = "Score", name: str = "DDB_ID") -> DataFrame:
    """Candidates, the best first, equal ones by id."""
    return rows.orderBy(F.desc(score), name)


def harvest(files: DataFrame, meta: DataFrame, root: str, options: HarvestOptions = HarvestOptions()) -> DataFrame:
    """The candidate table, best score first and then by id. files: path, content; meta: latest_metadata()."""
    blocks = xml.parse_blocks(files, options.scan_commentary).where("ddb_id <> ''")
    blocks = blocks.withColumn("raw_text", text.collapse_ws(F.col("raw_text"))).withColumn("norm", text.normalize_for_search("raw_text"))
    rows = roll_up(block_evidence(blocks, options), ["ddb_id", "path"], ["div_idx", "block_idx"], options)
    rows = xml.with_metadata(rows, meta).withColumn("XML_RelPath", xml.relative_path(F.col("path"), root))
    front = ["XML_RelPath", "Title", "Place", "Date_Text", "Date_When", "Date_NotBefore", "Date_NotAfter"]
    rest = [c for c in rows.columns if c not in (*front, "ddb_id", "path")]
    return by_score(rows.select(F.col("ddb_id").alias("DDB_ID"), *front, *rest))
