"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to `order` bytes with frozen
counts: the longest context's from its sample, the shorter ones' with update
exclusion (a byte counts once for every longer context it follows). A byte costs
-log2(c / (T + U)) in the longest context that has seen it, after -log2(U / (T + U))
for each context that has not (T: counts, U: distinct bytes; escape method C), and
8 bits where no context has. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bytes scored at once: what bounds a task's memory, whatever a text's length.
BLOCK = 1 << 20
#: A code of this many bytes is full evidence; longer texts do not add to a score.
EVIDENCE = 64


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """At each byte from the order-th on: it and the order bytes before it, as one number."""
    n = len(data) - order
    out = np.zeros(max(0, n), np.uint32)
    for k in range(order + 1):
        out |= data[k : k + n].astype(np.uint32) << np.uint32(8 * (order - k))
    return out


class Tree:
    """One language's contexts, as sorted arrays for each length."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int):
        self.order, self.levels = order, {}
        codes, counts = codes.astype(np.uint32), counts.astype(np.float64)
        for k in range(order, -1, -1):
            at = np.argsort(codes, kind="stable")
            codes, counts = codes[at], counts[at]
            context, first = np.unique(codes >> np.uint32(8), return_index=True)
            total = np.add.reduceat(counts, first) if len(codes) else np.zeros(0)
            distinct = np.diff(np.append(first, len(codes)))
            all_ = total + distinct
            seen = -np.log2(counts / np.repeat(all_, distinct)) if len(codes) else np.zeros(0)
            escape = -np.log2(distinct / all_) if len(codes) else np.zeros(0)
            self.levels[k] = (codes, seen, context, escape)
            if k:
                codes, counts = np.unique(codes & np.uint32((1 << 8 * k) - 1), return_counts=True)
                counts = counts.astype(np.float64)

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each code."""
        bits, left = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(self.order, -1, -1):
            known, seen, context, escape = self.levels[k]
            key = codes[left] & np.uint32((1 << 8 * (k + 1)) - 1)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[at] == key
            bits[left[hit]] += seen[at[hit]]
            left, key = left[~hit], key[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(context, key), len(context) - 1)
            hit = context[at] == key
            bits[left[hit]] += escape[at[hit]]
        bits[left] += 8.0
        return bits


@dataclass
class Model:
    """Trees, and the costs of all codes that any of them has seen, in an open hash table."""

    languages: list[str]
    trees: list[Tree]
    order: int
    codes: np.ndarray = field(init=False)
    costs: np.ndarray = field(init=False)
    slots: np.ndarray = field(init=False)
    probes: int = field(init=False, default=0)

    def __post_init__(self) -> None:
        self.codes = np.unique(np.concatenate([np.zeros(0, np.uint32), *(t.levels[self.order][0] for t in self.trees)]))
        self.costs = np.stack([t.cost(self.codes) for t in self.trees], axis=1).astype(np.float32) if self.trees else np.zeros((0, 0), np.float32)
        self.bits = max(8, int(len(self.codes) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, step = np.arange(len(self.codes)), 0
        while len(left):
            at = self._slot(self.codes[left], step)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            step += 1
        self.probes = step

    def _slot(self, codes: np.ndarray, step: int) -> np.ndarray:
        return ((codes * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)) + np.uint32(step)) & np.uint32((1 << self.bits) - 1)

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """Bits by code and language."""
        found = self.slots[self._slot(codes, 0)]
        ok = (found >= 0) & (self.codes[found] == codes) if len(self.codes) else np.zeros(len(codes), bool)
        left = np.flatnonzero(~ok)
        for step in range(1, self.probes):
            at = self.slots[self._slot(codes[left], step)]
            hit = (at >= 0) & (self.codes[at] == codes[left])
            found[left[hit]] = at[hit]
            left = left[~hit]
        out = self.costs[found] if len(self.codes) else np.zeros((len(codes), len(self.trees)), np.float32)
        if len(left):
            new, back = np.unique(codes[left], return_inverse=True)
            out[left] = np.stack([t.cost(new) for t in self.trees], axis=1)[back]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language. A text is read after `order` line ends."""
        out = np.zeros((len(texts), len(self.trees)))
        pad = b"\n" * self.order
        group: list[int] = []
        size = 0

        def flush() -> None:
            data = np.frombuffer(b"".join(pad + texts[i] for i in group), np.uint8)
            ends = np.cumsum([len(texts[i]) + self.order for i in group])
            bits = self.cost(grams(data, self.order))
            # The code at k is for byte k + order; a text's own bytes begin order after its pad does.
            sums = np.concatenate([np.zeros((1, len(self.trees))), np.cumsum(bits, axis=0, dtype=np.float64)])
            begin = np.concatenate([[0], ends[:-1]])
            out[group] = sums[np.maximum(ends - self.order, 0)] - sums[begin]

        for i, text in enumerate(texts):
            if len(text) > BLOCK:
                whole = pad + text
                for at in range(0, len(text), BLOCK):
                    part = np.frombuffer(whole, np.uint8)[at : at + BLOCK + self.order]
                    out[i] += self.cost(grams(part, self.order)).sum(axis=0, dtype=np.float64)
                continue
            if size + len(text) > BLOCK and group:
                flush()
                group, size = [], 0
            group.append(i)
            size += len(text)
        if group:
            flush()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; und and 0 without a letter or without any language."""
        data = [(t or "").encode("utf-8") for t in texts]
        letters = np.array([next(filter(str.isalpha, t or ""), None) is not None for t in texts], bool)
        if not self.languages or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits = self.lengths(data)
        n = np.array([max(1, len(d)) for d in data])
        bits = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE / n)[:, None]
        odds = np.exp2(-bits)
        best = odds.argmax(axis=1)  # the first of equal ones: languages are in order
        score = odds[np.arange(len(best)), best] / odds.sum(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 mod 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, *, order: int = 3, sample_docs: int = 1500) -> Model:
    """Fit on documents that are not held out and have lang and text.

    sample_docs bounds the sample: in each language the documents whose hashed id
    falls under sample_docs / their count are read, whole, about that many. What
    reaches the driver are the sample's distinct codes. Rows with a null id are not used.
    """
    if not 1 <= order <= 3:
        raise ValueError("order must be 1 to 3")
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    usable = usable.select("doc_id", "lang", "text")
    counts = cut(usable.groupBy("lang").agg(F.count("*").alias("n")))
    # A row for each language: sent to all tasks if there are no more than a thousand, so that texts stay where they are.
    counts = F.broadcast(counts) if counts.limit(1001).count() <= 1000 else counts
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.join(counts, "lang").where(draw < F.lit(float(sample_docs)) / F.col("n")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pad = b"\n" * order
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                texts = [pad + t.encode("utf-8") for t in part["text"]]
                # A pad is context only: its own bytes are not counted, so counts do not depend on which texts meet in a batch.
                own = np.ones(sum(map(len, texts)), bool)
                own[(np.cumsum([len(t) for t in texts])[:, None] - 1 - np.arange(order)).ravel()] = False
                found = grams(np.frombuffer(b"".join(texts), np.uint8), order)
                codes, n = np.unique(found[own[: len(found)]], return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n})

    found = sample.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    parts = [found[found["lang"] == lang] for lang in languages]
    return Model(languages, [Tree(p["code"].to_numpy(), p["n"].to_numpy(), order) for p in parts], order)


def _scored(docs: DataFrame, model: Model, columns: list[str], keep: float | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lang, value = shared.value.predict(part.column("_text").to_pylist())
                if keep is None:
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + [pa.array(lang, pa.string()), pa.array(value, pa.float64())], names=[*columns, "lang_pred", "score"])
                else:
                    ok = pa.array([x != "und" for x in lang]) if not keep else pa.array([x != "und" and v >= keep for x, v in zip(lang, value, strict=True)])
                    yield part.select(columns).filter(ok)

    kept = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(score, schema + (", lang_pred string, score double" if keep is None else ""))


def identify(docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Null texts and texts without a letter are und with score 0, and so is everything
    if there is nothing to learn from. Whole texts are scored in blocks. Repeated
    rows stay repeated; other columns are left behind.
    """
    model = model or train(docs, **options)
    found = _scored(docs.select("doc_id", "text"), model, ["doc_id"], None)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model | None = None, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs, all columns, whose language is found with a score of least or more."""
    return _scored(docs, model or train(docs, **options), docs.columns, least)
