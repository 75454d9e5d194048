"""Best-fit packing of documents into sequences, improved by a grouping genetic algorithm.

Documents become pieces of at most `capacity` tokens. Pieces are dealt to shards of
about equal size; in each, islands evolve populations of packings and pass their
elite on. A gene is a whole bin: crossover injects the other parent's well-filled
bins, takes out the bins that hold any of their pieces, and places the displaced
ones by best fit. Bins that stay poorly filled are packed anew across shards.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bytes of text tokenized at once, and entries and bytes of a generation of the cache of chunks, of which two are held: what bounds a task's memory.
BLOCK, CACHE, CACHE_BYTES = 1 << 20, 300_000, 12_000_000
_GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: ASCII marks but the apostrophe, of which contractions are made, from a letter to white space.
_MARK, _LETTER = rb"[!-&(-/:-@\[-`{-~]", rb"\xc3[\x9f-\xb6\xb8-\xbf]"
_LAST = re.compile(_MARK + rb"(?:(?<=[a-z]" + _MARK + rb")|(?<=" + _LETTER + _MARK + rb"))" + _MARK + rb"*(?=[ \n])")
#: Words of lower-case letters up to U+00FF: in normal form, and folding to themselves.
_LETTERS = re.compile(rb"^(?:[a-z]|" + _LETTER + rb"){1,100}$", re.MULTILINE)


class ChunkTokenizer:
    """Token ids of texts, chunk by chunk.

    For tokenizers that fold case and whose pre-tokenizer drops white space, as the
    one named by the contract does: there the ids of a text are those of its chunks
    between ASCII white space, one after the other, and most chunks recur. Marks
    between a letter and white space are a chunk of their own, as they are a word of
    their own to the pre-tokenizer. Chunks of Latin lower-case letters are such words
    already, so they go to the model without being folded or split.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    @staticmethod
    def chunks(text: bytes) -> list[bytes]:
        # Special tokens are told by their case.
        return text.split() if b"<|" in text else _LAST.sub(rb" \g<0>", text.lower()).split()

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, new: set[bytes]) -> None:
        known, old = self.known, self.old
        if old:
            known.update([(c, old[c]) for c in new if c in old])
            new = new.difference(known)
        letters = _LETTERS.findall(b"\n".join(new))
        others = list(new.difference(letters))
        for at in range(0, len(letters), 1000):
            part = letters[at : at + 1000]
            # Words end where a token that ends a word does, so many are one call.
            ids = np.array(self.plain.encode_batch_fast([b" ".join(part).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
            stop = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stop) != len(part):
                others += part
                continue
            data, stops = ids.tobytes(), stop.tolist()
            known.update(zip(part, [data[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)], strict=True))
            self.held += 2 * len(data)
        got = self._encode([c.decode("utf-8") for c in others])
        known.update(zip(others, got, strict=True))
        self.held += sum(map(len, others)) + sum(map(len, got))

    def _group(self, group: list[list[bytes]]) -> Iterator[Iterator[bytes]]:
        if len(self.known) > CACHE or self.held > CACHE_BYTES:
            self.known, self.old, self.held = {}, self.known, 0
        new = set().union(*group).difference(self.known)
        if new:
            self.learn(new)
        for chunks in group:
            yield iter([b"".join(map(self.known.__getitem__, chunks))])

    def __call__(self, texts: list[bytes]) -> Iterator[Iterator[bytes]]:
        """For each text its ids as little-endian bytes, in parts."""
        group: list[list[bytes]] = []
        size = 0
        for text in texts:
            if len(text) > BLOCK:
                yield from self._group(group)
                group, size = [], 0
                yield self._long(text)
                continue
            group.append(self.chunks(text))
            size += len(text)
            if size > BLOCK:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _long(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            m = _GAP.search(text, at + BLOCK)
            for ids in self._group([self.chunks(text[at : m.start() if m else len(text)])]):
                yield from ids
            at = m.end() if m else len(text)


@cache
def tokenizer_at(path: str) -> ChunkTokenizer:
    """One for each Python worker, so that what it has learnt serves later tasks."""
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document, its ids followed by the id `end`.

    A null text counts as empty, and has the one id `end`. Rows with a null doc_id
    and repeated rows have pieces of their own.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = tokenizer_at(tokenizer)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [(t or "").encode("utf-8") for t in part.column("text").to_pylist()]
                row, piece, start, length, crc = [], [], [], [], []
                for k, stream in enumerate(work(texts)):
                    rest, n = b"", 0

                    def put(ids: bytes, k: int = k) -> None:
                        row.append(k)
                        piece.append(n)
                        start.append(n * capacity)
                        length.append(len(ids) // 4)
                        crc.append(zlib.crc32(ids))

                    for ids in stream:
                        rest += ids
                        while len(rest) > capacity * 4:
                            put(rest[: capacity * 4])
                            rest, n = rest[capacity * 4 :], n + 1
                    rest += last
                    while rest:
                        put(rest[: capacity * 4])
                        rest, n = rest[capacity * 4 :], n + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(order: np.ndarray, lengths: np.ndarray, capacity: int, bins: np.ndarray, room: list[int]) -> list[int]:
    """Place the items of order, each where the least room is left that takes it. bins is filled in; room, by bin, is returned."""
    shift = 32
    free = sorted((r << shift) | b for b, r in enumerate(room))
    for i in order.tolist():
        need = int(lengths[i])
        at = bisect_left(free, need << shift)
        if at < len(free):
            entry = free.pop(at)
            b, left = entry & ((1 << shift) - 1), (entry >> shift) - need
        else:
            b, left = len(room), capacity - need
            room.append(0)
        bins[i] = b
        room[b] = left
        if left:
            insort(free, (left << shift) | b)
    return room


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins that are filled unevenly, which leaves room for more."""
    fill = np.bincount(bins, weights=lengths)
    return -len(fill), float(((fill / capacity) ** 2).mean())


def cross(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """a with some well-filled bins of b."""
    fill = np.bincount(b, weights=lengths)
    full = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = rng.choice(full, max(1, len(full) // 2), replace=False)
    injected = np.isin(b, chosen)
    broken = np.isin(a, np.unique(a[injected]))
    child = np.full(len(a), -1, np.int64)
    kept = ~broken & ~injected
    _, child[kept] = np.unique(a[kept], return_inverse=True)
    base = int(child.max(initial=-1)) + 1
    _, place = np.unique(b[injected], return_inverse=True)
    child[injected] = base + place
    count = int(child.max(initial=-1)) + 1
    room = (capacity - np.bincount(child[child >= 0], weights=lengths[child >= 0], minlength=count)).astype(int).tolist()
    loose = np.flatnonzero(child < 0)
    best_fit(loose[np.argsort(-lengths[loose], kind="stable")], lengths, capacity, child, room)
    return child


def evolve(lengths: np.ndarray, capacity: int, population: list[np.ndarray], size: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after some generations, best first. It stops once no packing can have fewer bins."""
    floor = -(-int(lengths.sum()) // capacity)
    population = list(population)
    while len(population) < size:
        noise = lengths * (1 + (rng.random(len(lengths)) - 0.5) * 0.2 * bool(population))
        bins = np.zeros(len(lengths), np.int64)
        best_fit(np.argsort(-noise, kind="stable"), lengths, capacity, bins, [])
        population.append(bins)
        if -fitness(bins, lengths, capacity)[0] <= floor:
            break
    rank = lambda p: fitness(p, lengths, capacity)
    population.sort(key=rank, reverse=True)
    for _ in range(generations):
        if len(population) < 2 or -rank(population[0])[0] <= floor:
            break
        i, j = rng.choice(len(population), 2, replace=False)
        i, j = min(i, j), max(i, j)
        population.append(cross(population[i], population[j], lengths, capacity, rng))
        population.sort(key=rank, reverse=True)
        population = population[:size]
    return population


_ISLAND = "shard long, island int, handle binary, lengths binary, population array<binary>"


def _islands(items: DataFrame, shards: int, islands: int) -> DataFrame:
    """One row per shard and island, with the shard's items (their handles, in a fixed order) and no population yet."""

    def gather(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "handle"], ascending=[False, True])
        return pd.DataFrame({"shard": [key[0]] * islands, "island": list(range(islands)), "handle": [part["handle"].to_numpy(np.int64).tobytes()] * islands, "lengths": [part["length"].to_numpy(np.int64).tobytes()] * islands, "population": [[]] * islands})

    dealt = items.select(F.pmod(F.xxhash64("handle"), F.lit(shards)).alias("shard"), "handle", "length")
    return dealt.groupBy("shard").applyInPandas(gather, _ISLAND)


def _pack(items: DataFrame, n: int, turn: int, *, capacity: int, shard_items: int, islands: int, epochs: int, size: int, generations: int, seed: int) -> DataFrame:
    """handle, shard, bin, fill of each item."""
    shards = max(1, -(-n // shard_items))
    state = _islands(items, shards, islands)

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for shard, island, lengths, population in zip(batch["shard"], batch["island"], batch["lengths"], batch["population"], strict=True):
                rng = np.random.default_rng([seed, turn, int(shard), int(island), len(population)])
                known = [np.frombuffer(p, np.int32).astype(np.int64) for p in population]
                # Other islands begin from other packings: the first one's is plain best-fit decreasing.
                known = known or ([] if island == 0 else [np.arange(len(lengths) // 8)])
                grown = evolve(np.frombuffer(lengths, np.int64), capacity, known, size, generations, rng)
                out.append([p.astype(np.int32).tobytes() for p in grown])
            yield batch.assign(population=out)

    for epoch in range(epochs):
        # Each island is long work on a small row: rows, not bytes, are dealt out.
        state = cut(state.repartition(min(shards * islands, 2000), "shard", "island").mapInPandas(grow, _ISLAND))
        if epoch + 1 < epochs:
            elite = state.select("shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.slice("population", 1, 1).alias("elite"))
            state = state.join(elite, ["shard", "island"]).select("shard", "island", "handle", "lengths", F.concat("elite", F.slice("population", 1, max(1, size - 1))).alias("population"))

    def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("island")
        lengths = np.frombuffer(part["lengths"].iloc[0], np.int64)
        best = max((np.frombuffer(p, np.int32).astype(np.int64) for own in part["population"] for p in own[:1]), key=lambda p: fitness(p, lengths, capacity))
        fill = np.bincount(best, weights=lengths).astype(np.int64)
        return pd.DataFrame({"handle": np.frombuffer(part["handle"].iloc[0], np.int64), "shard": key[0], "bin": best, "fill": fill[best], "length": lengths})

    return state.groupBy("shard").applyInPandas(choose, "handle long, shard long, bin long, fill long, length long")


def pack(cuts: DataFrame, *, capacity: int = 4096, shard_items: int = 8000, islands: int = 2, epochs: int = 2, size: int = 4, generations: int = 6, poor: float = 0.99, seed: int = 11) -> DataFrame:
    """cuts (of pieces()) with sequence_id and offset.

    Full pieces are sequences by themselves. shard_items bounds what one task holds.
    After the first turn the pieces of bins filled less than `poor` are packed again,
    with those of all other shards, while that joins shards. No rows give no rows.
    """
    rows = cut(cuts.withColumn("handle", F.monotonically_increasing_id()))
    options = {"capacity": capacity, "shard_items": shard_items, "islands": islands, "epochs": epochs, "size": size, "generations": generations, "seed": seed}
    items = rows.where(F.col("length") < capacity).select("handle", "length")
    n, done, turn = items.count(), [], 0
    while n:
        packed = cut(_pack(items, n, turn, **options))
        poorly = F.col("fill") < poor * capacity
        left = packed.where(poorly).count() if n > shard_items else 0
        again = 0 < left and -(-left // shard_items) < -(-n // shard_items)
        keep = packed.where(~poorly) if again else packed
        done.append(keep.select("handle", F.shiftleft(F.lit(turn + 1).cast("long"), 56).bitwiseOR(F.shiftleft(F.col("shard"), 24)).bitwiseOR(F.col("bin")).alias("sequence_id")))
        items, n, turn = packed.where(poorly).select("handle", "length"), left if again else 0, turn + 1
    alone = rows.where(F.col("length") >= capacity).select(F.col("handle"), F.col("handle").alias("sequence_id"))
    placed = alone
    for part in done:
        placed = placed.unionByName(part)
    rows = rows.join(placed, "handle")
    # At most `capacity` pieces share a sequence, so these windows are small.
    before = Window.partitionBy("sequence_id").orderBy("handle").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return rows.select(*cuts.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document; columns of docs beside doc_id and text are left behind."""
    return pack(pieces(docs, tokenizer, capacity, end), capacity=capacity, **options)
