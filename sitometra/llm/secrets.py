"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Only DataFrame operations. Places are in code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_key

# The patterns that the contract states. The last is of tokens to test.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True))
# Symbols of each encoding in order, and how much likelier than by
# chance two symbols of an ordinary word in it are alike.
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 2.0),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 2.1),
    ("base36", r"^(?:[0-9A-Z]+|[0-9a-z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 2.4),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 4.2),
)


def _array(condition: Column, value: Column, kind: str) -> Column:
    return F.when(condition, value).otherwise(F.array().cast(f"array<{kind}>"))


def matches(text: Column, kind: str) -> Column:
    """array<struct<kind, i, gap, word, size>>: of each match its ordinal, the length of text since the one before, itself, and the length that must be 6."""
    p = PATTERNS[kind]
    words = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    gaps = F.transform(F.split(text, p, -1), F.length)
    value = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(2)), F.length) if kind == "assign" else F.transform(words, lambda w: F.lit(6))
    zipped = F.arrays_zip(words.alias("word"), F.slice(gaps, 1, F.size(words)).alias("gap"), value.alias("size"))
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["word"].alias("word"), x["size"].alias("size")))
    there = text.rlike(p) if kind != "access" else text.contains("AKIA") & text.rlike(p)
    return _array(there, rows, "struct<kind:int,i:int,gap:int,word:string,size:int>")


def below(z: Column) -> Column:
    """The normal distribution at z, by a polynomial that is right to seven places."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame, word: str = "word") -> DataFrame:
    """Tests of each token: encoding, n, p_chance (Bonferroni of three tests that it is random), p_word (that it is a word).

    p_chance: chi-squared over the alphabet, runs above and below its middle, serial
    correlation. p_word: how seldom an ordinary word of the length spreads its symbols as evenly.
    """
    bare = F.regexp_replace(F.translate(F.col(word), "-_", "+/"), "=+$", "")
    code = F.lit(None).cast("int")
    for k in range(len(ENCODINGS) - 1, -1, -1):
        code = F.when(F.col(word).rlike(ENCODINGS[k][1]), k).otherwise(code)
    table = lambda i: F.element_at(F.array(*[F.lit(e[i]) for e in ENCODINGS]), F.col("_code") + 1)
    t = tokens.withColumn("_bare", bare).withColumn("_code", code)
    t = t.withColumn("_bare", F.when(F.col("_code").isin(0, 2), F.lower("_bare")).otherwise(F.col("_bare")))
    t = t.withColumn("_symbols", table(2)).withColumn("_a", F.length("_symbols").cast("double")).withColumn("_k", table(3))
    t = t.withColumn("_x", F.transform(F.filter(F.split("_bare", ""), lambda c: c != ""), lambda c: (F.instr(F.col("_symbols"), c) - 1).cast("double")))
    # Written out, as are the sums below: Spark would put each use's whole expression in its place.
    t = cut(t.withColumn("_n", F.size("_x").cast("double")))
    zero = F.lit(0.0)
    each = F.filter(F.split("_symbols", ""), lambda c: c != "")
    counts = F.transform(each, lambda c: (F.length("_bare") - F.length(F.replace(F.col("_bare"), c, F.lit("")))).cast("double"))
    chi = F.aggregate(counts, zero, lambda s, c: s + c * c) * F.col("_a") / F.col("_n") - F.col("_n")
    t = cut(t.withColumn("_chi", chi).withColumn("_mean", F.aggregate("_x", zero, lambda s, x: s + x) / F.col("_n")))
    pairs = F.arrays_zip(F.slice(F.col("_x"), 1, (F.col("_n") - 1).cast("int")).alias("u"), F.slice(F.col("_x"), 2, (F.col("_n") - 1).cast("int")).alias("v"))
    spread = F.aggregate("_x", zero, lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean")))
    serial = F.aggregate(pairs, zero, lambda s, p: s + (p["u"] - F.col("_mean")) * (p["v"] - F.col("_mean")))
    upper = F.size(F.filter("_x", lambda x: x * 2 >= F.col("_a"))).cast("double")
    changes = F.size(F.filter(pairs, lambda p: (p["u"] * 2 >= F.col("_a")) != (p["v"] * 2 >= F.col("_a")))).cast("double")
    t = t.withColumn("_spread", spread).withColumn("_serial", serial).withColumn("_up", upper).withColumn("_runs", changes + 1)
    t = cut(t)
    # Wilson and Hilferty's cube root makes chi-squared about normal.
    f = F.col("_a") - 1
    z_chi = (F.pow(F.greatest(F.col("_chi"), zero) / f, F.lit(1 / 3)) - (1 - 2 / (9 * f))) / F.sqrt(2 / (9 * f))
    down = F.col("_n") - F.col("_up")
    twice = 2 * F.col("_up") * down
    runs_sd = F.sqrt(F.greatest(twice * (twice - F.col("_n")), zero) / (F.col("_n") * F.col("_n") * (F.col("_n") - 1)))
    z_runs = F.when(runs_sd > 0, (F.col("_runs") - twice / F.col("_n") - 1) / runs_sd).otherwise(F.lit(9.0))
    z_serial = F.when(F.col("_spread") > 0, (F.col("_serial") / F.col("_spread") + 1 / F.col("_n")) * F.sqrt("_n")).otherwise(F.lit(9.0))
    least = F.least(below(-z_chi), 2 * below(-F.abs(z_runs)), 2 * below(-F.abs(z_serial)))
    wide = (F.col("_n") - 1) * (F.col("_k") - 1)
    z_word = (F.col("_chi") - (f + wide)) / F.sqrt(2 * f + 4 * wide)
    t = t.withColumn("p_chance", F.least(F.lit(1.0), 3 * least)).withColumn("p_word", below(z_word))
    return t.select(*tokens.columns, table(0).alias("encoding"), F.col("_n").cast("int").alias("n"), "p_chance", "p_word")


def discoveries(tested: DataFrame, rate: float = 0.05, chance: float = 0.001) -> DataFrame:
    """Tested tokens with secret, by Benjamini and Hochberg's procedure within each encoding and band of lengths.

    The controlled probability of a token is p_word, and 1 where the battery says that it
    is not random (p_chance below chance): chi-squared, runs and serial correlation are in
    it, and as it is never less than p_word the rate holds. Probabilities are rounded up to
    steps of their logarithm, so a stratum is a few hundred counts, whatever the number of tokens.
    """
    p = F.when(F.col("p_chance") >= chance, F.col("p_word")).otherwise(F.lit(1.0))
    step = F.ceil(F.log10(F.greatest(p, F.lit(1e-12))) * 50)
    t = tested.withColumn("_stratum", F.concat_ws(":", "encoding", F.floor(F.log2(F.col("n").cast("double") / 5)).cast("string"))).withColumn("_step", step)
    counts = t.groupBy("_stratum", "_step").agg(F.count("*").alias("_c"))
    rank = F.sum("_c").over(Window.partitionBy("_stratum").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum("_c").over(Window.partitionBy("_stratum"))
    counts = counts.withColumn("_ok", F.pow(F.lit(10.0), F.col("_step") / 50) <= rate * rank / every)
    limits = counts.where("_ok").groupBy("_stratum").agg(F.max("_step").alias("_limit"))
    t = t.join(limits, "_stratum", "left").withColumn("secret", F.coalesce(F.col("_step") <= F.col("_limit"), F.lit(False)))
    return t.select(*tested.columns, "secret")


def find_spans(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row per distinct text that has any span: key (of text_key), and spans, array<struct<start, kind, end>> in that order.

    kind counts from 0 in KINDS. Texts are scanned whole, once; a text's matches are
    numbered and summed in a window, so their number has no bound but that text's length.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Exploded where they are made: a filter on the array would make it twice.
    found = docs.select(text_key(value).alias("key"), F.explode(F.concat(*[matches(value, k) for k in KINDS])).alias("m")).select("key", "m.*")
    rows = cut(found.dropDuplicates(["key", "kind", "i"]))
    along = Window.partitionBy("key", "kind").orderBy("i")
    start = F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(F.length("word")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("start", start.cast("long")).withColumn("end", (start + F.length("word")).cast("long")).where("size >= 6")
    # A token is judged once, however many texts repeat it.
    tokens = rows.where(F.col("kind") == 3).select("word").distinct()
    secret = discoveries(battery(tokens), **options).where("secret").select("word")
    base = placed.where("kind < 3").select("key", "start", "kind", "end")
    more = placed.where("kind = 3").join(secret, "word", "left_semi").select("key", "start", "kind", "end")
    return base.unionByName(more).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for every row of docs.

    A null or empty text has no span, and the digest of the empty string. Repeated
    rows and equal texts get equal values; a null doc_id is kept; other columns are left behind.
    """
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    found = find_spans(docs.select("text"), **options)
    rows = texts.join(found, "key", "left")
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))

    def number(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.filter(spans, lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with every span, base and found, replaced by mark; spans that meet become one.

    n_chars, if there, becomes the new length. Documents without a span are unchanged;
    no row is dropped.
    """
    found = find_spans(docs, **options).withColumnsRenamed({"key": "_key", "spans": "_spans"})
    rows = docs.withColumn("_key", text_key(F.col("text"))).join(found, "_key", "left")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(s: Column, x: Column) -> Column:
        fresh = (x["start"] >= s["at"]) & ((x["start"] > s["at"]) | (F.size(s["parts"]) == 0))
        piece = F.col("text").substr((s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["parts"], F.array(piece, F.lit(mark)))).otherwise(s["parts"]).alias("parts"))

    end = lambda s: F.concat(F.array_join(s["parts"], ""), F.col("text").substr((s["at"] + 1).cast("int"), F.length("text")))
    new = F.when(F.col("_spans").isNotNull(), F.aggregate("_spans", state, add, end)).otherwise(F.col("text"))
    rows = rows.withColumn("_new", new)
    out = [F.col("_new").alias(c) if c == "text" else F.when(F.col("_spans").isNotNull(), F.length("_new")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*out)
