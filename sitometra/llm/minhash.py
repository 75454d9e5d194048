"""Near duplicates by a signature-coordinate inverted join of MinHash signatures.

Every distinct shingle set has a signature of `coordinates` 64-bit values, each made
of a coordinate's number and its least hash, and every value is a posting list. Sets
that are as similar as the threshold agree in at least `matches` coordinates but for
a chance of 1e-6. A set that shares fewer values with any other set is out. For the
rest, as in prefix merging, only the rarest m - matches + 1 of its m shared values
are posted, which every matching pair has one of in common; the long lists of common
values are skipped, and counted only between sets that met in a short one. Matches
are confirmed on the full sets.

No list is expanded into pairs. First a list's members are compared with one of
them, its pivot; links form components, and lists whose members are all in one
component are done, as those of copies are. The others are lists of sets that are
not all alike. Their members meet in blocks of `block` bytes, where an inverted index
counts what the sets of a block have in common: first every set in one of its lists
and one block of it; then, in the lists that are open even now, all blocks of a list
with each other, which is the exact way for what is left.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, join_salted, salted, text_key
from .components import components

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles as sorted 64-bit hashes; the whole sequence as one if there are fewer words.

    Bytes split at the same six characters as the words of the contract, and lower()
    of bytes changes A-Z alone.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


@cache
def _multipliers(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, coordinates, np.uint64)


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """A value for each coordinate: its number and the least value of its function, mixed to 64 bits.

    A minimum by itself has its upper bits near 0: cut short, it would be alike in unlike sets.
    """
    a, b = _multipliers(coordinates)
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[None, at : at + 4096] * a[:, None] + b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return _mixed(least + np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


@cache
def least_matches(coordinates: int, similarity: float, missed: float = 1e-6) -> int:
    """The most matches that a pair of that similarity reaches with a chance of 1 - missed."""
    below = 0.0
    for m in range(coordinates + 1):
        below += math.comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m)
        if below > missed:
            return max(1, m)
    return coordinates


def signatures(docs: DataFrame, k: int, coordinates: int) -> DataFrame:
    """doc_id, text_key, key (16 bytes for the shingle set), n (its size), sig."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, sig = [], [], []
            for text in batch.column("text"):
                h = shingles(text.as_py(), k)
                key.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                n.append(len(h))
                sig.append(signature(h, coordinates) if len(h) else np.zeros(0, np.int64))
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sig]), pa.int64())
            ends = pa.array(np.cumsum([0, *map(len, sig)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "text_key", "key", "n", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text").mapInArrow(work, "doc_id long, text_key binary, key binary, n long, sig array<long>")


def postings(sets: DataFrame, matches: int) -> DataFrame:
    """token, key: each set under the rarest of its shared coordinate values, by prefix filtering."""
    tokens = sets.select("key", F.explode("sig").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(common, "token").groupBy("key").agg(F.collect_list(F.struct("df", "token")).alias("own")).where(F.size("own") >= matches)
    prefix = F.slice(F.array_sort("own"), F.lit(1), F.size("own") - matches + 1)
    return shared.select("key", F.explode(prefix).alias("t")).select("key", F.col("t.token").alias("token"))


def matching(pairs: DataFrame, sets: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in `matches` coordinates or more."""
    of = lambda name: sets.select(F.col("key").alias(name), F.col("sig").alias(f"sig_{name}"))
    rows = join_salted(pairs.join(of("a"), "a"), of("b"), "b", F.col("a"), "inner")
    return rows.where(F.size(F.array_intersect("sig_a", "sig_b")) >= matches).select("a", "b")


def hashed(texts: DataFrame, k: int) -> DataFrame:
    """key, n, hashes: the shingles of the texts (key, text), 8 bytes each, ascending."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = [shingles(t.as_py(), k) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(h) for h in own], pa.int64()), pa.array([h.tobytes() for h in own], pa.binary())], names=["key", "n", "hashes"])

    return texts.select("key", "text").mapInArrow(work, "key binary, n long, hashes binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as `percent` says. sets: key, hashes.

    Rows are sorted by b, its own set first, so that a task holds the set of one b
    and streams the sets to compare with it; a b of many pairs is in several tasks.
    """
    dealt, _ = salted(pairs, "b", F.col("a"))
    guests = dealt.join(sets.select(F.col("key").alias("a"), "hashes"), "a").select("b", "_salt", F.lit(1).alias("turn"), "a", "hashes")
    hosts = dealt.select("b", "_salt").distinct().join(sets.select(F.col("key").alias("b"), "hashes"), "b").select("b", "_salt", F.lit(0).alias("turn"), F.col("b").alias("a"), "hashes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for b, turn, a, data in zip(*(batch.column(c).to_pylist() for c in ("b", "turn", "a", "hashes")), strict=True):
                other = np.frombuffer(data, np.uint64)
                if not turn:
                    own = other
                elif 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)):
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return hosts.unionByName(guests).repartition("b", "_salt").sortWithinPartitions("b", "_salt", "turn").mapInArrow(work, "a binary, b binary")


def links_between(own: list[np.ndarray], label: np.ndarray, percent: int, hosts: int | None = None) -> list[tuple[int, int]]:
    """Links that join the sets' components; with `hosts` only those of one of the first `hosts` sets with one of the others.

    label: a number for each set's component so far. What a set has in common with
    all others is counted by an index of all hashes.
    """
    sizes = np.array([len(h) for h in own])
    every = np.concatenate(own)
    by = np.argsort(every, kind="stable")
    owner, every = np.repeat(np.arange(len(own)), sizes)[by], every[by]
    out = []
    first = 0 if hosts is None else hosts
    for i in range(len(own) if hosts is None else hosts):
        others = label[max(first, i + 1) :] != label[i]
        if not others.any():
            continue
        begin, end = np.searchsorted(every, own[i]), np.searchsorted(every, own[i], side="right")
        counts = end - begin
        at = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        both = np.bincount(owner[at], minlength=len(own))
        alike = (100 * both >= percent * (sizes[i] + sizes - both)) & (both > 0)
        alike[: max(first, i + 1)] = False
        for j in np.flatnonzero(alike).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def blocked(members: DataFrame, percent: int, grid: bool) -> DataFrame:
    """The links (a, b) found between members (token, key, label, hashes, blocks) of a list.

    Each list is dealt to its number of blocks. Without grid a set is compared with
    its block; with it, every two blocks of a list meet too, in a task of their own.
    """
    home = F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int")
    dealt = members.withColumn("home", home)
    if grid:
        dealt = dealt.withColumn("away", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("i", F.least("home", "away")).withColumn("j", F.greatest("home", "away"))
    else:
        dealt = dealt.withColumn("i", F.col("home")).withColumn("j", F.col("home"))
    keys = ["token", "i", "j"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, keys):
            key = rows.column("key").to_pylist()
            numbers: dict[bytes, int] = {}
            label = np.array([numbers.setdefault(x, len(numbers)) for x in rows.column("label").to_pylist()])
            if len(numbers) < 2:
                continue
            own = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
            i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
            found = links_between(own, label, percent, None if i == j else sum(x == i for x in rows.column("home").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([key[x[n]] for x in found], pa.binary()) for n in (0, 1)], names=["a", "b"])

    return dealt.select(*keys, "home", "key", "label", "hashes").repartition(*keys).sortWithinPartitions(*keys, "home").mapInArrow(work, "a binary, b binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in keys, of sorted batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        marks = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        begin = 0
        for i, mark in enumerate(marks):
            if mark != now:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, now, begin = [], mark, i
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _relabelled(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows (token, key) of lists of more than one component, with label; and the labels, None without links."""
    labels = components(links) if links.limit(1).count() else None
    if labels is None:
        rows = rows.select("token", "key", F.col("key").alias("label"))
    else:
        rows = rows.select("token", "key").join(labels.select(F.col("node").alias("key"), "label"), "key", "left").select("token", "key", F.coalesce("label", "key").alias("label"))
    open_ = rows.groupBy("token").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("token")
    return cut(rows.join(open_, "token")), labels


def linked(sigs: DataFrame, sets: DataFrame, lists: DataFrame, percent: int, matches: int, block: int) -> DataFrame | None:
    """key, label: the least key that links reach, of every set that has a link; None if none has. See the module's head.

    sigs: key, sig. sets: key, n, hashes. lists: token, key.
    """
    sizes = lists.groupBy("token").agg(F.count("*").alias("_n"), F.min("key").alias("head")).where("_n > 1").drop("_n")
    rows = cut(lists.join(sizes, "token"))
    pairs = cut(rows.where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct())
    near = cut(matching(pairs, sigs, matches))
    links = cut(confirm(near, sets, percent))
    # Pivots have met all members of their lists.
    open_, labels = _relabelled(rows.where("key <> head"), links)
    forget(pairs, near, rows)
    for grid in (False, True):
        if not open_.limit(1).count():
            break
        weighed = open_.join(sets.select("key", "n"), "key")
        blocks = weighed.groupBy("token").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") * 8 / block)).cast("int").alias("blocks"), F.count("*").alias("_n"))
        members = open_.join(blocks, "token")
        if not grid:
            # Each set in its longest list only.
            best = F.max(F.struct("_n", "token", "blocks", "label")).alias("m")
            members = members.groupBy("key").agg(best).select("key", "m.token", "m.blocks", "m.label")
        links = links.unionByName(cut(blocked(members.join(sets.select("key", "hashes"), "key"), percent, grid)))
        if grid:
            labels = components(links) if links.limit(1).count() else None
        else:
            open_, labels = _relabelled(open_, links)
    return None if labels is None else labels.select(F.col("node").alias("key"), "label")


def _classes(docs: DataFrame, k: int, percent: int, coordinates: int, block: int) -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, text_key, key, n of every row; classes: key, component (least doc_id), label, best (the row that stands for the class)."""
    matches = least_matches(coordinates, percent / 100)
    rows = cut(signatures(docs, k, coordinates))
    # Rows with an id come before those without.
    here = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    sets = cut(rows.where("n > 0").groupBy("key").agg(F.min(here).alias("first"), F.first("sig").alias("sig")))
    lists = cut(postings(sets, matches))
    chosen = sets.join(lists.select("key").distinct(), "key", "left_semi").select("key", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("text_key"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    # One row brings the text of each set; rows that repeat it are one again before they are shuffled.
    texts = own.join(chosen, (own["text_key"] == chosen["text_key"]) & own["doc_id"].eqNullSafe(chosen["_id"])).groupBy("key").agg(F.first("text").alias("text"))
    texts = cut(hashed(texts, k))
    labels = linked(sets, texts, lists, percent, matches, block)
    named = sets.select("key", "first", F.col("key").alias("label"))
    if labels is not None:
        named = sets.select("key", "first").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = cut(named)
    least = named.groupBy("label").agg(F.min("first").alias("best"))
    classes = cut(join_salted(named, least, "label", F.col("key")).select("key", F.col("best.doc_id").alias("component"), "label", "best"))
    forget(lists, texts, named)
    return rows, classes


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, coordinates: int = 64, block: int = 2 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their sets
    of k-word shingles; component_id is the least doc_id that links reach. Texts that
    are null, empty or without words have no shingles and are linked with nothing.
    Rows with a null doc_id are linked by their text as all are; their component_id
    is null where they reach no id, and then they are kept. Rows that repeat a doc_id
    are linked by their own text. Exact copies are one set from the first shuffle on.
    Columns beside doc_id and text are not read. No rows give no rows.
    """
    rows, classes = _classes(docs, k, percent, coordinates, block)
    out = join_salted(rows.select("doc_id", "key", "n"), classes.select("key", "component"), "key", F.col("doc_id"))
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame, *, k: int = 5, percent: int = 80, coordinates: int = 64, block: int = 2 << 20) -> DataFrame:
    """docs, all columns: one row of each group of near duplicates, and all rows without a shingle.

    The row that stays is the one of the least doc_id (null last), then of the least
    digest of its text; the decision is by row, so one that repeats a doc_id with
    another text is judged by its own. Of rows that repeat id and text one stays,
    whichever comes first. Rows without a shingle are no copies of each other.
    """
    rows, classes = _classes(docs, k, percent, coordinates, block)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(*[c.alias(f"_c{i}") for i, c in enumerate(columns)], F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("_text_key"))
    back = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]
    # What stays, by id and digest: rows without a shingle, and the first of each class.
    best = classes.select(F.col("best.doc_id").alias("_i"), F.col("best.text_key").alias("_t"), F.lit(True).alias("_first")).distinct()
    bare = rows.where("n = 0").select(F.col("doc_id").alias("_i"), F.col("text_key").alias("_t"), F.lit(False).alias("_first")).distinct()
    stay = best.unionByName(bare)
    kept = named.join(stay, (F.col("_text_key") == F.col("_t")) & F.col("_id").eqNullSafe(F.col("_i")))
    again = rows.where("n > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_j"), F.col("text_key").alias("_u"))
    repeated = F.col("_first") & F.col("_u").isNotNull()
    kept = kept.join(again, (F.col("_text_key") == F.col("_u")) & F.col("_id").eqNullSafe(F.col("_j")), "left").withColumn("_again", repeated)
    # Rows that repeat a row that stays are few; only they are brought together.
    once = kept.where("_again").groupBy("_id", "_text_key").agg(F.first(F.struct(*[f"_c{i}" for i in range(len(columns))])).alias("_row"))
    return kept.where("not _again").select(*back).unionByName(once.select(*[F.col(f"_row._c{i}").alias(c) for i, c in enumerate(docs.columns)]))
