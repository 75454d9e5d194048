"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

One model per language, from all trusted text, and one for each fold of it that is
left out. Counts, continuation counts, discounts and back-off weights are DataFrames,
and all n-grams that the corpus has are joined to them, at each length. Documents lie
in shards; a shard asks for its distinct n-grams only, and scores its texts with what
comes back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget

#: Bytes of text in a shard, and of those scored at once.
SHARD, BLOCK = 12 << 20, 1 << 20
#: The rows of shards(): documents of one language, their texts compressed, and the n-grams they have.
SHARDS = "shard long, lang string, ids array<long>, sizes array<long>, blob binary, codes array<long>"


def codes(text: bytes, order: int) -> np.ndarray:
    """Each byte with the order - 1 before it as one number; a text begins after line ends."""
    data = np.frombuffer(b"\n" * (order - 1) + text, np.uint8)
    out = np.zeros(len(text), np.uint32)
    for k in range(order):
        out |= data[k : k + len(text)].astype(np.uint32) << np.uint32(8 * (order - 1 - k))
    return out


def _distinct(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts over all texts, gathered block by block."""
    got, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    group: list[np.ndarray] = []
    size = 0

    def add() -> None:
        nonlocal got, n
        own, count = np.unique(np.concatenate(group), return_counts=True)
        all_ = np.concatenate([got, own])
        got, back = np.unique(all_, return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([n, count]), minlength=len(got)).astype(np.int64)

    for text in texts:
        for at in range(0, len(text), BLOCK):
            head = max(0, at - order + 1)
            group.append(codes(text[head : at + BLOCK], order)[at - head :])
            size += len(group[-1])
            if size >= BLOCK:
                add()
                group, size = [], 0
    if group:
        add()
    return got, n


def counts(docs: DataFrame, order: int) -> DataFrame:
    """lang, code, c of all rows (lang, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append((text or "").encode("utf-8"))
            for lang, texts in by.items():
                code, n = _distinct(texts, order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "c"])

    return docs.mapInArrow(work, "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))


def level(grams: DataFrame) -> DataFrame:
    """lang, code, c to lang, code, p (the discounted part), context, gamma (what the context leaves to shorter ones).

    lang names a model, and may be of any type.
    """
    of = grams.groupBy("lang").agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in range(1, 5)])
    y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    # Where a class of counts is empty its discount falls back to the plain one.
    d = [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(i * y))) for i in (1, 2, 3)]
    of = of.select("lang", *[x.alias(f"d{i}") for i, x in enumerate(d, 1)])
    cut_off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = grams.join(of, "lang").withColumn("context", F.shiftright("code", 8)).withColumn("d", cut_off)
    sums = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("left")).select("lang", "context", "total", (F.col("left") / F.col("total")).alias("gamma"))
    return rows.join(sums, ["lang", "context"]).select("lang", "code", ((F.col("c") - F.col("d")) / F.col("total")).alias("p"), "context", "gamma")


def model(grams: DataFrame, order: int) -> list[DataFrame]:
    """The levels from the longest to single bytes; shorter ones count the distinct bytes before an n-gram."""
    out = []
    for k in range(order, 0, -1):
        out.append(cut(level(grams)))
        if k > 1:
            grams = out[-1].select("lang", F.col("code").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("code")).groupBy("lang", "code").agg(F.count("*").alias("c"))
    return out


def log_probabilities(asked: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """lang, code, logp (base 2) of every asked n-gram."""
    order = len(levels)
    # The levels grow with the trusted text; whether one is sent to all tasks is left to its measured size.
    rows = asked.withColumn("p", F.lit(0.0)).withColumn("rest", F.lit(1.0))
    for k, table in zip(range(order, 0, -1), levels, strict=True):
        mask = (1 << 8 * k) - 1
        seen = table.select(F.col("lang").alias("_l"), F.col("code").alias("_c"), F.col("p").alias("_p"))
        contexts = table.select(F.col("lang").alias("_l2"), F.col("context").alias("_x"), F.col("gamma").alias("_g")).distinct()
        key = F.col("code").bitwiseAND(mask)
        rows = rows.join(seen, (F.col("lang") == F.col("_l")) & (key == F.col("_c")), "left")
        rows = rows.join(contexts, (F.col("lang") == F.col("_l2")) & (F.shiftright(key, 8) == F.col("_x")), "left")
        rows = rows.select("lang", "code", (F.col("p") + F.col("rest") * F.coalesce("_p", F.lit(0.0))).alias("p"), (F.col("rest") * F.coalesce("_g", F.lit(1.0))).alias("rest"))
    return rows.select("lang", "code", F.log2(F.col("p") + F.col("rest") / 256).alias("logp"))


def _shard(shard: int, lang: str, rows: list[tuple], order: int) -> pa.RecordBatch:
    code, _ = _distinct([r[1] for r in rows], order)
    blob = zstandard.ZstdCompressor(level=7).compress(b"".join(r[1] for r in rows))
    return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([lang], pa.string()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[len(r[1]) for r in rows]], pa.list_(pa.int64())), pa.array([blob], pa.binary()), pa.array([code.astype(np.int64)], pa.list_(pa.int64()))], names=["shard", "lang", "ids", "sizes", "blob", "codes"])


def _documents(row: dict) -> Iterator[tuple[int, bytes]]:
    """doc_id and text of a shard's documents."""
    data = zstandard.ZstdDecompressor().decompress(row["blob"]) if row["blob"] else b""
    at = 0
    for doc_id, n in zip(row["ids"], row["sizes"], strict=True):
        yield doc_id, data[at : at + n]
        at += n


def _fold(text: bytes, folds: int) -> int:
    """Equal texts are of one fold, so a model that leaves it out has seen none of them."""
    return zlib.crc32(text) % folds


def shards(docs: DataFrame, order: int) -> DataFrame:
    """docs (doc_id, lang, text) as SHARDS; a null lang is a language of its own."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, list[tuple]] = {}
        size: dict[str, int] = {}
        number = 0

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal number
            rows = held.pop(lang)
            size.pop(lang)
            shard = TaskContext.get().partitionId() << 32 | number
            number += 1
            return _shard(shard, lang, rows, order)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for key, lang, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                    data = (text or "").encode("utf-8")
                    held.setdefault(lang, []).append((key, data))
                    size[lang] = size.get(lang, 0) + len(data) + 64
                    if size[lang] > SHARD:
                        yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    return docs.mapInArrow(work, SHARDS)


def those_of(held: DataFrame, ids: DataFrame, order: int) -> DataFrame:
    """The shards (a written table) with no other documents than those of ids (_id). Only ids are joined, texts stay in their shard."""

    def work(key: tuple, texts: pa.Table, wanted: pa.Table) -> pa.Table:
        places = set(wanted.column("at").to_pylist())
        out = []
        for row in texts.to_pylist() if places else []:
            out.append(_shard(row["shard"], row["lang"], [d for i, d in enumerate(_documents(row)) if i in places], order))
        return pa.Table.from_batches(out or [_shard(0, "", [], order).slice(0, 0)])

    wanted = held.select(F.col("shard").alias("shard"), F.posexplode("ids").alias("at", "_id")).join(ids, "_id", "left_semi").select("shard", "at")
    return held.drop("codes").groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(work, SHARDS)


def fold_counts(held: DataFrame, order: int, folds: int) -> DataFrame:
    """lang, fold, code, c of all documents of the shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                by: dict[int, list[bytes]] = {}
                for _, text in _documents(row):
                    by.setdefault(_fold(text, folds), []).append(text)
                for fold, texts in by.items():
                    code, n = _distinct(texts, order)
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(code), pa.string()), pa.array([fold] * len(code), pa.int32()), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "fold", "code", "c"])

    rows = held.select("lang", "ids", "sizes", "blob").mapInArrow(work, "lang string, fold int, code long, c long")
    return rows.groupBy("lang", "fold", "code").agg(F.sum("c").alias("c"))


def left_out(grams: DataFrame, lone: DataFrame, folds: int) -> DataFrame:
    """lang (struct of lang, left), code, c: counts of all folds (left is -1) and of all but one; in lone languages nothing is left out."""
    per = [F.sum(F.when(F.col("fold") == k, F.col("c")).otherwise(0)).alias(f"_{k}") for k in range(folds)]
    rows = grams.groupBy("lang", "code").agg(F.sum("c").alias("_all"), *per).join(F.broadcast(lone.withColumn("_lone", F.lit(1))), "lang", "left")
    each = [(-1, F.col("_all")), *[(k, F.when(F.col("_lone").isNull(), F.col("_all") - F.col(f"_{k}")).otherwise(F.col("_all"))) for k in range(folds)]]
    rows = rows.select("lang", "code", F.explode(F.array(*[F.struct(F.lit(k).alias("left"), c.alias("c")) for k, c in each])).alias("_m"))
    return rows.where("_m.c > 0").select(F.struct("lang", F.col("_m.left").alias("left")).alias("lang"), "code", F.col("_m.c").alias("c"))


def _score(order: int, folds: int):
    def work(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if known.num_rows:
            code = known.column("code").to_numpy()
            by = np.argsort(code)
            code, logps = code[by].astype(np.uint32), [known.column(f"p{k}").to_numpy()[by] for k in range(folds)]
        for row in texts.to_pylist():
            for doc_id, text in _documents(row):
                n, bits = len(text), 0.0
                for b in range(0, n, BLOCK):
                    head = max(0, b - order + 1)
                    own = codes(text[head : b + BLOCK], order)[b - head :]
                    bits -= float(logps[_fold(text, folds)][np.searchsorted(code, own)].sum())
                out.append((doc_id, row["lang"], n, 2 ** (bits / n) if n else None))
        columns = list(zip(*out, strict=True)) or [()] * 4
        types = [pa.int64(), pa.string(), pa.int64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "lang", "n_bytes", "perplexity"])

    return work


def _asked(held: DataFrame) -> DataFrame:
    return held.select(F.col("shard").alias("shard"), "lang", F.explode("codes").alias("code"))


def measured(held: DataFrame, known: DataFrame, order: int, folds: int = 1) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity of the shards' documents by known (lang, code, p0, p1 and so on: a column for each fold)."""
    answers = _asked(held).join(known, ["lang", "code"]).drop("lang")
    return held.drop("codes").groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_score(order, folds), "doc_id long, lang string, n_bytes long, perplexity double")


def perplexity(docs: DataFrame, trusted: DataFrame, *, order: int = 4) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (per byte; null for texts without bytes) of every row of docs (doc_id, lang, text).

    trusted: rows (lang, text) to learn from. A null lang is a language of its own;
    where a language has no trusted text every byte has 256 choices.
    """
    levels = model(counts(trusted.select(F.coalesce("lang", F.lit("")).alias("lang"), "text"), order), order)
    held = cut(shards(docs, order))
    known = cut(log_probabilities(_asked(held).select("lang", "code").distinct(), levels).withColumnRenamed("logp", "p0"))
    return measured(held, known, order)


def limits(scored: DataFrame, quantile: float, step: float = 1e-4) -> DataFrame:
    """lang, threshold: the perplexity that `quantile` of a language's rows do not exceed, to a step of its logarithm.

    Counts per step are summed in order, so no language's rows are brought together.
    """
    bins = scored.where("perplexity is not null").groupBy("lang", F.ceil(F.log2("perplexity") / step).alias("bin")).agg(F.count("*").alias("c"))
    along = F.sum("c").over(Window.partitionBy("lang").orderBy("bin"))
    every = F.sum("c").over(Window.partitionBy("lang"))
    bins = bins.withColumn("share", along / every)
    return bins.where(F.col("share") >= quantile).groupBy("lang").agg(F.pow(F.lit(2.0), F.min("bin") * step).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, *, order: int = 4, folds: int = 4, quantile: float = 0.99) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept of every row of docs.

    Trusted text: the documents that labels give quality 1 alone, all of them. Their
    texts fall into folds by checksum. A trusted document is measured by the model of
    its language's trusted text of all other folds, so by one that has not seen it; any
    other document by the model of all trusted text. What `quantile` of a language's
    trusted documents do not exceed is its threshold. Where a language has no trusted
    text, or all of it in one fold (which is not left out then), the quantile is that of
    all its documents. Texts without bytes have no perplexity and are not kept. Repeated
    rows stay; a null lang is a language, written as an empty string. Rows with a null
    doc_id are not trusted. Other columns are left behind.
    """
    rated = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = 1 and high = 1")
    good = cut(rated.select(F.col("doc_id").cast("long").alias("_id")))
    held = cut(shards(docs, order))
    trusted = cut(those_of(held, good, order))
    grams = cut(fold_counts(trusted, order, folds))
    # A row for each language.
    lone = grams.groupBy("lang").agg(F.min("fold").alias("_a"), F.max("fold").alias("_b")).where("_a = _b").select("lang")
    lone = cut(lone)
    counted = cut(left_out(grams, lone, folds))
    levels = model(counted, order)
    forget(grams, counted)

    def known(held: DataFrame, lefts: list[int]) -> DataFrame:
        """lang, code and a column for each of lefts: what its model gives the n-grams of the shards."""
        asked = _asked(held).select("lang", "code").distinct().withColumn("left", F.explode(F.array(*map(F.lit, lefts))))
        rows = log_probabilities(asked.select(F.struct("lang", "left").alias("lang"), "code"), levels)
        return cut(rows.groupBy(F.col("lang.lang").alias("lang"), "code").agg(*[F.max(F.when(F.col("lang.left") == k, F.col("logp"))).alias(f"p{i}") for i, k in enumerate(lefts)]))

    of_folds, of_whole = known(trusted, list(range(folds))), known(held, [-1])
    forget(*levels)
    unseen = cut(measured(trusted, of_folds, order, folds))
    forget(trusted, of_folds)
    scored = cut(measured(held, of_whole, order))
    forget(held, of_whole)
    scored = scored.join(good, scored["doc_id"] == good["_id"], "left_anti").unionByName(unseen)
    of_trusted = limits(unseen.join(F.broadcast(lone), "lang", "left_anti"), quantile).withColumnRenamed("threshold", "_t")
    of_all = limits(scored, quantile)
    # A row for each language.
    out = scored.join(of_all, "lang", "left").join(of_trusted, "lang", "left")
    threshold = F.coalesce("_t", "threshold")
    return out.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))
