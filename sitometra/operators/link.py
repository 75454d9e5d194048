"""Linking grain, quantity and price words inside a block.

A block's events are arrays; pairing explodes them within the token window. Blocks
are dealt by mention before that, so their candidates are ranked where they are made.
Events are found in Arrow batches: Python's patterns are what defines them.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HALF, MONEY, NEAR_UNIT, LinkOptions, Lexicon
from ..functions import numbers, text

_NUMBER, _FRACTION, _GAP = r"(\d+)((?:\W+(?:\d+/\d+))*)", r"(\d+/\d+)", r"\W+"
#: Order of a price word that is not there, among candidates.
FAR = 999_999


def _core(stems: tuple[str, ...]) -> str:
    return "(" + "|".join(rf"{s}\w*" for s in stems) + ")"


def amount_patterns(stems: tuple[str, ...]) -> list[tuple[str, int | None, int, int]]:
    """Pattern, and its groups of the whole number, the fractions and the word, in the order events are built."""
    w = _core(stems)
    return [(f"(?U){_NUMBER}{_GAP}{w}", 1, 2, 3), (f"(?U){w}{_GAP}{_NUMBER}", 2, 3, 1), (f"(?U){_FRACTION}{_GAP}{w}", None, 1, 2), (f"(?U){w}{_GAP}{_FRACTION}", None, 2, 1)]


_PAIR = re.compile(r"(\d+)\s*/\s*(\d+)")


def parse_number(whole: str | None, fractions: str | None) -> float:
    """A whole number, if any, plus every n/d of fractions; those over zero do not count."""
    total = float(whole) if whole else 0.0
    for n, d in _PAIR.findall(fractions) if fractions else ():
        if float(d):
            total += float(n) / float(d)
    return total


class _Found:
    """Events of one kind, of a batch of texts."""

    def __init__(self, values: bool):
        self.ends, self.tok, self.word, self.value = [0], [], [], [] if values else None

    def array(self) -> pa.Array:
        columns = [pa.array(self.tok, pa.int32()), *([pa.array(self.value, pa.float64())] if self.value is not None else []), pa.array(self.word, pa.string())]
        names = ["tok", "value", "word"] if self.value is not None else ["tok", "word"]
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(columns, names))


_WORDS, _AMOUNTS = "array<struct<tok:int,word:string>>", "array<struct<tok:int,value:double,word:string>>"


def _finder(grain: str, priceword: str):
    """Column function: grains, qtys, prices and pricewords of a normalized text. A number may serve twice."""
    plain = lambda pattern: pattern.replace("(?U)", "")
    kinds = {"grains": plain(grain), "pricewords": plain(priceword)}
    near = {k: ("|".join(stems), [(plain(p), *groups) for p, *groups in amount_patterns(stems)]) for k, stems in (("qtys", NEAR_UNIT), ("prices", MONEY))}

    def places(x: str):
        """The number, from 0, of the last token that begins at a position or before."""
        if " ".join(x.split()) == x:
            return lambda pos: x.count(" ", 0, pos)
        starts = [t.start() for t in re.finditer(r"\S+", x)]
        return lambda pos: max(0, bisect_right(starts, pos) - 1)

    def find(norm: pa.Array) -> pa.Array:
        words = [(re.compile(p), _Found(False)) for p in kinds.values()]
        amounts = [(re.compile(stem), [(re.compile(p), *groups) for p, *groups in patterns], _Found(True)) for stem, patterns in near.values()]
        for x in norm.to_pylist():
            x = x or ""
            place = places(x)
            for pattern, out in words:
                for m in pattern.finditer(x):
                    out.tok.append(place(m.start()))
                    out.word.append(m.group())
                out.ends.append(len(out.tok))
            for stem, patterns, out in amounts:
                # Most texts have no such word; the last two patterns need a fraction.
                for pattern, whole, fractions, word in (patterns if "/" in x else patterns[:2]) if stem.search(x) else ():
                    for m in pattern.finditer(x):
                        out.tok.append(place(m.start()))
                        out.value.append(parse_number(m.group(whole) if whole else None, m.group(fractions)))
                        out.word.append(m.group(word))
                out.ends.append(len(out.tok))
        return pa.StructArray.from_arrays([f.array() for _, f in words] + [f.array() for *_, f in amounts], [*kinds, *near])

    find.__annotations__ = {"norm": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, f"grains {_WORDS}, pricewords {_WORDS}, qtys {_AMOUNTS}, prices {_AMOUNTS}")


def events(df: DataFrame, norm: str = "value_norm", lexicon: Lexicon = LinkOptions().lexicon) -> DataFrame:
    """df with grains, qtys, prices and pricewords."""
    found = _finder(Lexicon.word(lexicon.grain), lexicon.priceword)
    rows = df.withColumn("_found", found(F.col(norm)))
    return rows.withColumns({k: F.col(f"_found.{k}") for k in ("grains", "qtys", "prices", "pricewords")}).drop("_found")


def deal(df: DataFrame, mention: list[str]) -> DataFrame:
    """df in as many parts as a shuffle has: by their bytes, which are few for the work on them, they would be made fewer.

    Spark does not know the parts any more behind a Python function: for ranking they are dealt after it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *mention)


def candidates(df: DataFrame, window: int = 80, near: int = 8, line_penalty: str = "parity") -> DataFrame:
    """One row per grain, price and quantity (or none) within the window, with distances and score.

    df: grains, qtys, prices, pricewords, unit_signal (whether the block has a unit word).
    """
    # The outer form with its own filter: for the plain one Spark adds a filter on the array's size, moves it below and finds the events twice.
    every = lambda rows, c, *names: rows.select("*", F.posexplode_outer(c).alias(*names)).where(F.col(names[0]).isNotNull())
    rows = every(df, "grains", "_g", "_grain").withColumn("Grain_Index", F.col("_g") + 1)
    within = lambda c: F.filter(c, lambda e: F.abs(e["tok"] - F.col("_grain.tok")) <= window)
    rows = rows.withColumn("_prices", within("prices")).withColumn("_qtys", within("qtys"))
    rows = rows.withColumn("_k_price", F.size("_prices")).withColumn("_k_qty", F.size("_qtys"))
    rows = every(rows, "_prices", "price_idx", "_price")
    # Of a price, not of each of its candidates.
    rows = rows.withColumn("d_pw", F.array_min(F.transform("pricewords", lambda w: F.abs(F.col("_price.tok") - w["tok"]))))
    options = F.concat("_qtys", F.array(F.lit(None).cast("struct<tok:int,value:double,word:string>")))
    rows = rows.select("*", F.posexplode(options).alias("qty_idx", "_qty"))
    g, p, q = F.col("_grain.tok"), F.col("_price.tok"), F.col("_qty.tok")
    rows = rows.withColumn("d_gp", F.abs(g - p)).withColumn("d_gq", F.abs(g - q))
    rows = rows.withColumn("low", F.least(g, p, q)).withColumn("high", F.greatest(g, p, q)).withColumn("span", F.col("high") - F.col("low"))
    lines = F.lit(0)
    if line_penalty == "fixed":
        between = F.slice(text.tokens(F.col("value_norm")), F.col("low") + 1, F.col("high") - F.col("low") + 1)
        lines = F.size(F.filter(between, lambda t: t == "__lb__"))
    unit = F.when(q.isNotNull(), 2).when(F.col("unit_signal"), 1).otherwise(0)
    rows = rows.withColumn("lines", lines).withColumn("unit_strength", unit)
    score = numbers.confidence(*(F.col(c) for c in ("d_gp", "d_gq", "d_pw", "span", "_k_price", "_k_qty", "unit_strength", "lines")))
    rows = rows.withColumn("score", score).withColumn("priceword_near", F.coalesce(F.col("d_pw") <= near, F.lit(False)))
    return rows.withColumns({"grain_tok": g, "Grain_Form": F.col("_grain.word"), "price_tok": p, "price_value": F.col("_price.value"), "price_cur": F.col("_price.word"), "qty_tok": q, "qty_value": F.col("_qty.value"), "qty_unit": F.col("_qty.word")}).drop("_g", "_grain", "_prices", "_qtys", "_price", "_qty", "_k_price", "_k_qty")


def _order() -> list[Column]:
    return [F.desc("score"), F.col("qty_tok").isNotNull().desc(), F.asc("span"), F.asc("d_gp"), F.coalesce("d_pw", F.lit(FAR)).asc(), F.asc("price_tok"), F.asc("price_idx"), F.asc("qty_idx")]


def rank(cands: DataFrame, mention: list[str], min_score: float = 55.0, delta: float = 8.0) -> DataFrame:
    """Candidates of min_score or more with rank, and ambiguous and alt_*: the next one, if its score is within delta."""
    spec = Window.partitionBy(*mention, "Grain_Index").orderBy(*_order())
    rows = cands.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(spec))
    rows = rows.withColumn("_next", F.lead(F.struct("score", "qty_value", "qty_unit", "price_value", "price_cur")).over(spec))
    rows = rows.withColumn("ambiguous", F.coalesce(F.col("score") - F.col("_next.score") < delta, F.lit(False)))
    alt = lambda c: F.when(F.col("ambiguous"), F.col(f"_next.{c}")).alias(f"alt_{c}")
    return rows.select(*[c for c in rows.columns if c != "_next"], *[alt(c) for c in ("score", "qty_value", "qty_unit", "price_value", "price_cur")])


def _greedy(reuse_score: float, reuse_dgp: int, reuse_span: int):
    """Column function: for each of a mention's candidates its grain's primary rank.

    A fold over the candidates, best first. A grain takes the first one whose price is
    free, or whose score and distances allow a price to be used twice; grains left over
    take their first rank.
    """

    def choose(score: pa.Array, qty_tok: pa.Array, span: pa.Array, d_gp: pa.Array, d_pw: pa.Array, price_tok: pa.Array, grain: pa.Array, rank: pa.Array) -> pa.Array:
        of = lambda c, null: np.asarray(c.flatten().fill_null(null))
        s, none, c, d, e, f, g, r = of(score, 0.0), np.asarray(qty_tok.flatten().is_null()), of(span, 0), of(d_gp, 0), of(d_pw, FAR), of(price_tok, 0), of(grain, 0), of(rank, 0)
        sizes = np.asarray(score.value_lengths())
        order = np.lexsort((r, g, f, e, d, c, none, -s, np.repeat(np.arange(len(sizes)), sizes)))
        again = ((s >= reuse_score) & (d <= reuse_dgp) & (c <= reuse_span))[order].tolist()
        prices, grains, ranks, all_grains = f[order].tolist(), g[order].tolist(), r[order].tolist(), g.tolist()
        out, ends, at = [], [0], 0
        for n in sizes.tolist():
            used, taken = set(), {}
            for i in range(at, at + n):
                if grains[i] not in taken and (again[i] or prices[i] not in used):
                    taken[grains[i]] = ranks[i]
                    used.add(prices[i])
            out += [taken.get(x, 1) for x in all_grains[at : at + n]]
            at += n
            ends.append(at)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))

    choose.__annotations__ = dict.fromkeys(choose.__annotations__, pa.Array)
    return F.arrow_udf(choose, "array<int>")


_CHOICE = ("score", "qty_tok", "span", "d_gp", "d_pw", "price_tok", "Grain_Index", "rank")


def primaries(ranked: DataFrame, mention: list[str], reuse_score: float = 80.0, reuse_dgp: int = 12, reuse_span: int = 18) -> DataFrame:
    """mention, Grain_Index, primary_rank: the candidate that each grain takes."""
    lists = ranked.groupBy(*mention).agg(F.collect_list(F.struct(*_CHOICE)).alias("_all"))
    chosen = _greedy(reuse_score, reuse_dgp, reuse_span)(*[F.col(f"_all.{c}") for c in _CHOICE])
    pairs = F.array_distinct(F.arrays_zip(F.col("_all.Grain_Index").alias("Grain_Index"), F.col("_primary").alias("primary_rank")))
    return lists.withColumn("_primary", chosen).select(*mention, F.inline(pairs).alias("Grain_Index", "primary_rank"))


#: Columns that all candidates of a mention have alike, wherever they are there.
_BLOCK = ("div_idx", "block_idx", "block_tag", "raw_text", "value_text", "num_values", "num_texts", "num_tag_count", "norm", "grain_hits", "unit_hits", "money_hits", "priceword_hit", "unit_signal", "value_norm", "grains", "qtys", "prices", "pricewords")


def with_primary(ranked: DataFrame, mention: list[str], options: LinkOptions = LinkOptions()) -> DataFrame:
    """ranked with is_primary. A mention's candidates meet once and are dealt out again, so that they are made once."""
    if not options.global_assign:
        return ranked.withColumn("is_primary", F.col("rank") == 1)
    same = [c for c in ranked.columns if c in (*_BLOCK, *META) and c not in mention]
    own = [c for c in ranked.columns if c not in (*same, *mention)]
    lists = ranked.groupBy(*mention).agg(F.collect_list(F.struct(*own)).alias("_all"), *[F.first(c).alias(c) for c in same])
    chosen = _greedy(options.reuse_score, options.reuse_max_dgp, options.reuse_max_span)(*[F.col(f"_all.{c}") for c in _CHOICE])
    rows = lists.withColumn("_primary", chosen).select(*mention, *same, F.explode(F.arrays_zip(F.col("_all").alias("own"), F.col("_primary").alias("rank"))).alias("_x"))
    return rows.select(*mention, *same, "_x.own.*", (F.col("_x.own.rank") == F.col("_x.rank")).alias("is_primary")).select(*ranked.columns, "is_primary")


def emit(rows: DataFrame, options: LinkOptions = LinkOptions()) -> DataFrame:
    """What is given out: primaries alone; or the first topk; or those and the primary."""
    if options.emit_only_primary:
        return rows.where("is_primary")
    top = F.col("rank") <= max(1, options.topk)
    return rows.where(top | F.col("is_primary")) if options.emit_topk_and_primary_only else rows.where(top)


def gate(blocks: DataFrame, options: LinkOptions = LinkOptions(), norm: str = "norm") -> DataFrame:
    """Blocks with a grain word, a marked number, and money or a price word; with the words found."""
    lex, n = options.lexicon, F.col(norm)
    hits = lambda stems: F.regexp_extract_all(n, F.lit(Lexicon.word(stems)), F.lit(0))
    rows = blocks.withColumns({"grain_hits": hits(lex.grain), "unit_hits": hits(lex.unit), "money_hits": hits(lex.money), "priceword_hit": n.rlike(lex.priceword)})
    keep = (F.size("grain_hits") > 0) & (F.size("num_values") > 0) & ((F.size("money_hits") > 0) | F.col("priceword_hit"))
    rows = rows.where(keep & (F.size("unit_hits") > 0) if options.require_unit else keep)
    return rows.withColumn("unit_signal", F.size("unit_hits") > 0)


def render(blocks: DataFrame) -> DataFrame:
    """blocks with value_text, the sign for a half written out, and value_norm."""
    half = text.collapse_ws(F.regexp_replace("value_text", HALF, " 1/2 "))
    return blocks.withColumn("value_text", half).withColumn("value_norm", text.normalize_for_search("value_text"))


def _amount(value: Column, word: Column) -> Column:
    return F.concat_ws(" ", text.format_fraction(value), word)


META = ["Title", "Place", "Date_Text", "Date_When", "Date_NotBefore", "Date_NotAfter"]


def number_mentions(gated: DataFrame) -> DataFrame:
    """Mention_ID: a document's gated blocks, counted in their order."""
    return gated.withColumn("Mention_ID", F.row_number().over(Window.partitionBy("DDB_ID", "path").orderBy("div_idx", "block_idx")))


def mention_rows(found: DataFrame, options: LinkOptions = LinkOptions()) -> DataFrame:
    """The 21 columns of a mention. found: gated, rendered, numbered, with events."""
    every = lambda c: text.ordered_join(F.transform(c, lambda e: _amount(e["value"], e["word"])))
    return found.select(
        "DDB_ID", "Mention_ID", F.col("block_tag").alias("Block_Tag"), *META, text.sorted_join(F.col("grain_hits")).alias("Grain_Hits"), text.sorted_join(F.col("unit_hits")).alias("Unit_Hits"), text.sorted_join(F.col("money_hits")).alias("Money_Hits"),
        F.when(F.col("priceword_hit"), "yes").otherwise("no").alias("Priceword_Hit"), F.concat(F.lit("num:"), F.get("num_values", F.lit(0))).alias("Number_Hit"), F.lit("num_tag").alias("Number_Type"),
        F.array_join("num_values", ";").alias("Num_Tag_Values"), F.array_join("num_texts", ";").alias("Num_Tag_Texts"), every("qtys").alias("Quantities"), every("prices").alias("Prices"),
        F.substring("raw_text", 1, options.block_chars).alias("Raw_Block"), F.substring("value_text", 1, options.block_chars).alias("Value_Block"),
    )


def linked_rows(emitted: DataFrame, options: LinkOptions = LinkOptions()) -> DataFrame:
    """The 28 columns of a linked row; scores are rounded here, after all comparisons."""
    context = text.context_window(text.tokens(F.col("value_text")), F.col("low") - options.context_pad, F.col("high") + options.context_pad)
    blank = lambda c: F.coalesce(c, F.lit(""))
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    return emitted.select(
        "DDB_ID", "Mention_ID", "Grain_Index", F.col("rank").alias("Candidate_Rank"), yes("is_primary").alias("Is_Primary"), F.col("block_tag").alias("Block_Tag"), *META, "Grain_Form",
        blank(text.format_fraction(F.col("qty_value"))).alias("Qty_Value"), blank(F.col("qty_unit")).alias("Qty_Unit"), text.format_fraction(F.col("price_value")).alias("Price_Value"), F.col("price_cur").alias("Price_Cur"),
        F.round("score", 2).alias("Score"), F.col("d_gp").alias("Dist_GP"), F.coalesce("d_gq", F.lit(-1)).alias("Dist_GQ"), F.col("span").alias("Span_Toks"), F.col("lines").alias("Lines_Crossed"), yes("priceword_near").alias("Priceword_Near"), yes("ambiguous").alias("Ambiguous"),
        F.when(F.col("alt_score").isNotNull(), F.format_string("%.2f", F.col("alt_score"))).otherwise("").alias("AltScore"),
        F.when(F.col("alt_qty_value").isNotNull(), _amount(F.col("alt_qty_value"), F.col("alt_qty_unit"))).otherwise("").alias("Alt_Qty"),
        F.when(F.col("alt_price_value").isNotNull(), _amount(F.col("alt_price_value"), F.col("alt_price_cur"))).otherwise("").alias("Alt_Price"),
        F.substring(context, 1, options.context_chars).alias("Context_Window"),
    )


def find_mentions(blocks: DataFrame, options: LinkOptions = LinkOptions()) -> DataFrame:
    """Gated blocks with events. blocks: DDB_ID, metadata, and the columns of parse_blocks()."""
    blocks = blocks.withColumn("raw_text", text.collapse_ws(F.col("raw_text"))).withColumn("norm", text.normalize_for_search("raw_text"))
    return events(render(number_mentions(gate(blocks, options))), "value_norm", options.lexicon)


def link(found: DataFrame, options: LinkOptions = LinkOptions()) -> DataFrame:
    """Linked rows from find_mentions()."""
    mention = ["DDB_ID", "path", "Mention_ID"]
    # Dealt by mention while they are blocks, so that no candidate is shuffled for its ranking.
    found = deal(found, mention)
    rows = rank(candidates(found, options.window_tokens, options.priceword_near, options.line_penalty), mention, options.min_score, options.ambiguity_delta)
    return linked_rows(emit(with_primary(rows, mention, options), options), options)
