"""Removing repeated byte strings with longest-previous-factor arrays.

A window of `width` bytes is a repeat if its bytes also start elsewhere. To bring
equal windows together without sending every one, each window has an anchor: of its
k-byte strings the one with the least hash, the leftmost of equal ones, so equal
windows have it at the same place. Windows whose anchor occurs once in the corpus
are no repeats. Of the other anchors the surrounding bytes, all windows that can
have that anchor, are dealt by the anchor. Each task writes them behind one another
in corpus order, sorts the suffixes, and takes for each the previous and the next
smaller position in suffix order: the longest previous factor, and where it began.
A window is a later copy if that factor is as long as it.

The surroundings of an anchor with more than `crowd` occurrences would be a task's
burden. Of equal ones the first stands for all before any shuffle; those that stand
are parted by anchors of twice the bytes, up to whole windows, and go the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, join_salted, text_key

#: Length of anchors; bytes hashed at once; bytes of surroundings whose suffixes are sorted at once.
ANCHOR, BLOCK, CHUNK = 48, 1 << 20, 3 << 20
_P = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^64."""
    out = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def string_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes that start at each place."""
    up, down = _powers(BLOCK + 4096)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    n = len(data) - k + 1
    h = (sums[k:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return h


def anchors(data: np.ndarray, ends: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of data, texts one after the other that end at ends: hash, first window and number of windows of each anchor.

    An anchor's windows are a run of starts. Windows do not cross the texts' ends.
    """
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none.astype(np.uint64), none, none
    h = string_hashes(data, k)
    # The place in the low bits makes the leftmost of equal hashes the least.
    place = np.uint64((1 << 21) - 1)
    least = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    w, span = width - k + 1, 1
    n = len(h) - w + 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    at = (np.minimum(least[:n], least[w - span : w - span + n]) & place).astype(np.int64)
    stops = np.repeat(ends, np.diff(ends, prepend=0))[:n]
    start = np.flatnonzero(np.arange(n) + width <= stops)
    if not len(start):
        return none.astype(np.uint64), none, none
    at = at[start]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[first]], start[first], np.diff(np.append(first, len(at)))


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    sorted_ = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    return rank


def previous_factors(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each start the number, among starts, of an earlier one whose `width` bytes are the same; -1 if none has.

    starts ascend. Suffixes are sorted by doubling, to a depth of width; in their
    order the previous and the next smaller position hold the longest previous factor.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    depth = 1
    while depth * 2 <= min(width, 8):
        depth *= 2
    padded = np.concatenate([text, np.zeros(width + 8, np.uint8)])
    key = np.zeros(len(text), np.uint64)
    for i in range(depth):
        key = (key << np.uint64(8)) | padded[i : i + len(text)].astype(np.uint64)
    rank = _ranks(key)

    def joined(at: np.ndarray, step: int) -> np.ndarray:
        beyond = np.concatenate([rank, np.full(step, -1, np.int64)])
        return _ranks(rank[at] * np.int64(len(text) + 2) + beyond[at + step] + 1)

    while depth * 2 <= width:
        rank = joined(np.arange(len(text)), depth)
        depth *= 2
    rank = joined(starts, width - depth) if depth < width else rank[starts]
    order = np.argsort(rank, kind="stable")  # the suffix array: numbers of starts
    n = len(order)
    out = np.full(n, -1, np.int64)
    for step in (-1, 1):
        near = np.arange(n) + step
        while True:
            inside = (near >= 0) & (near < n)
            far = inside & (order[np.where(inside, near, 0)] > order)
            if not far.any():
                break
            # A neighbour with a larger position has its own smaller neighbour no nearer than this one's.
            near[far] = near[near[far]]
        same = inside & (rank[order[np.where(inside, near, 0)]] == rank[order])
        out[order[same]] = order[near[same]]
    return out


def _runs(flags: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Bytes covered by the flagged windows."""
    n = int(np.count_nonzero(flags))
    if n in (0, len(flags)):
        return [(0, n - 1 + width)] if n else []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()
    return [(b, e - 1 + width) for b, e in zip(edge[::2], edge[1::2], strict=True)]


def _solve(rows: list[tuple], width: int, keep: str) -> Iterator[tuple[bytes, int, int]]:
    """rows (h, ctx, uid, order, first) to repeated spans (uid, start, end)."""
    rows.sort(key=lambda r: (r[3] is not None, r[3] or 0, r[2], r[4]))
    texts: dict[bytes, list[tuple]] = {}
    kinds: dict[int, int] = {}
    for r in rows:
        own = texts.setdefault(r[1], [])
        if not own:
            kinds[r[0]] = kinds.get(r[0], 0) + 1
        own.append(r)
    # Surroundings alone under their anchor have no other to share a window with but their own copies.
    several = [c for c, own in texts.items() if kinds[own[0][0]] > 1]
    parts: dict[bytes, tuple[list, list]] = {}  # by surroundings: later copies, and all repeats
    if several:
        data = np.frombuffer(b"".join(several), np.uint8)
        sizes = np.array([len(c) for c in several])
        begin = np.cumsum(sizes) - sizes
        counts = sizes - width + 1
        total = np.cumsum(counts) - counts
        starts = np.repeat(begin - total, counts) + np.arange(int(counts.sum()))
        source = previous_factors(data, starts, width)
        later = source >= 0
        both = later.copy()
        both[source[later]] = True
        for c, at, n in zip(several, total.tolist(), counts.tolist(), strict=True):
            parts[c] = (_runs(later[at : at + n], width), _runs(both[at : at + n], width))
    for c, own in texts.items():
        whole = [(0, len(c))]
        later_runs, all_runs = parts.get(c, ([], []))
        for i, (_, _, uid, _, first) in enumerate(own):
            if keep == "first":
                runs = whole if i else later_runs
            else:
                runs = whole if len(own) > 1 else all_runs
            for b, e in runs:
                yield uid, first + b, first + e


def _blocks(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """data, ends, the number of each text and the place in it where its part of data begins."""
    group: list[int] = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        return data, np.cumsum([len(texts[i]) for i in group]), np.array(group), np.zeros(len(group), np.int64)

    for i, text in enumerate(texts):
        if len(text) < width:
            continue
        if len(text) > BLOCK:
            for at in range(0, len(text) - width + 1, BLOCK - width):
                part = np.frombuffer(text, np.uint8)[at : at + BLOCK - 1]
                yield part, np.array([len(part)]), np.array([i]), np.array([at])
            continue
        if size + len(text) > BLOCK and group:
            yield flush()
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        yield flush()


def _anchor_rows(docs: DataFrame, width: int, k: int) -> DataFrame:
    """h, uid, first, n: an anchor's hash, its document, its first window and how many it has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [(t or "").encode("utf-8") for t in part.column("text").to_pylist()]
                for data, ends, number, base in _blocks(texts, width):
                    h, first, n = anchors(data, ends, width, k)
                    which = np.searchsorted(ends, first, side="right")
                    local = first - np.concatenate([[0], ends[:-1]])[which] + base[which]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("uid").take(pa.array(number[which])), pa.array(local), pa.array(n.astype(np.int32))], names=["h", "uid", "first", "n"])

    return docs.select("uid", "text").mapInArrow(work, "h long, uid binary, first long, n int")


def _surroundings(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """h, df, ctx, uid, doc_id, first of the chosen anchors."""
    lists = chosen.groupBy("uid").agg(F.collect_set(F.struct("first", "n", "h", "df")).alias("own"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "df", "ctx", "uid", "doc_id", "first"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for uid, key, text, own in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "text", "own")), strict=True):
                data = (text or "").encode("utf-8")
                for x in own:
                    ctx = data[x["first"] : x["first"] + x["n"] - 1 + width]
                    out.append((x["h"], x["df"], ctx, uid, key, x["first"]))
                    size += len(ctx)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    joined = docs.select("uid", "doc_id", "text").join(lists, "uid")
    return joined.mapInArrow(work, "h long, df long, ctx binary, uid binary, doc_id long, first long")


def _kinds(found: DataFrame) -> DataFrame:
    """id, ctx of the distinct surroundings, the number c of rows that have them, and here: the first of these."""
    here = F.struct("doc_id", "uid", "first")
    return found.groupBy(F.unhex(F.md5("ctx")).alias("id"), "ctx").agg(F.count("*").alias("c"), F.min(here).alias("here"))


def _copies(found: DataFrame, kinds: DataFrame, keep: str) -> DataFrame:
    """uid, start, end: whole surroundings that are copies of others; the first of them is spared if keep is "first"."""
    several = kinds.where("c > 1").select("id", "here", F.octet_length("ctx").alias("size"))
    rows = cut(found.select(F.unhex(F.md5("ctx")).alias("id"), "doc_id", "uid", "first"))
    rows = join_salted(rows, several, "id", F.xxhash64("uid", "first"), "inner")
    if keep == "first":
        own = F.struct("doc_id", "uid", "first").eqNullSafe(F.col("here"))
        # Rows that repeat doc_id and text are copies too: one of them does not spare the others.
        rows = rows.groupBy("uid", "first", "size", own.alias("own")).agg(F.count("*").alias("n")).where("not own or n > 1")
    return rows.select("uid", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("end"))


def _parted(kinds: DataFrame, width: int, k: int) -> DataFrame:
    """h, df, ctx, uid, doc_id, first: the surroundings, in the first rows of their kinds, of anchors of k bytes that occur in several."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few at a time: with k near width each window is a row.
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column("ctx").to_pylist()
                begin = np.array(part.column("first").to_pylist(), np.int64)
                for data, ends, number, base in _blocks(texts, width):
                    h, first, n = anchors(data, ends, width, k)
                    which = np.searchsorted(ends, first, side="right")
                    ctx = [data[b : b + c - 1 + width].tobytes() for b, c in zip(first.tolist(), n.tolist(), strict=True)]
                    local = first - np.concatenate([[0], ends[:-1]])[which] + base[which] + begin[number[which]]
                    rows = pa.array(number[which])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ctx, pa.binary()), part.column("uid").take(rows), part.column("doc_id").take(rows), pa.array(local)], names=["h", "ctx", "uid", "doc_id", "first"])

    rows = cut(kinds.select("ctx", "here.*").mapInArrow(work, "h long, ctx binary, uid binary, doc_id long, first long"))
    counts = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    return join_salted(rows, counts, "h", F.xxhash64("uid", "first"), "inner").select("h", "df", "ctx", "uid", "doc_id", "first")


def with_uid(docs: DataFrame) -> DataFrame:
    """doc_id, text and uid, 16 bytes that stand for both; rows that repeat both have the same."""
    head = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(head).alias("uid"))


def repeated_spans(docs: DataFrame, *, width: int = 200, keep: str = "first", anchor: int | None = None, crowd: int = 20_000) -> DataFrame:
    """uid (of with_uid), start, end: spans of bytes covered by repeated windows; they may overlap.

    keep="first" spares the first of equal windows, in order of doc_id and place;
    keep="none" takes all of them. Null texts and those shorter than width have none.
    """
    docs = docs if "uid" in docs.columns else with_uid(docs)
    k = anchor or max(1, min(ANCHOR, width // 2))
    rows = _anchor_rows(docs, width, k)
    counts = cut(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    found = cut(_surroundings(docs, rows.join(counts, "h"), width))
    forget(counts)
    spans = None
    while True:
        quiet = found.where(F.col("df") <= crowd).repartition("h").sortWithinPartitions("h")
        here = cut(quiet.mapInArrow(_spans_of(width, keep), "uid binary, start long, end long"))
        spans = here if spans is None else spans.unionByName(here)
        crowded = found.where(F.col("df") > crowd)
        if not crowded.limit(1).count():
            return spans
        kinds = cut(_kinds(crowded))
        spans = spans.unionByName(cut(_copies(crowded, kinds, keep)))
        if k == width:
            # Anchors were whole windows: those that are the same were copies.
            return spans
        k = min(width, 2 * k)
        before, found = found, cut(_parted(kinds, width, k))
        forget(before, kinds)


def _spans_of(width: int, keep: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, now = 0, None

        def solved() -> pa.RecordBatch:
            got = list(zip(*_solve(held, width, keep), strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(got[0], pa.binary()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.int64())], names=["uid", "start", "end"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "ctx", "uid", "doc_id", "first")), strict=True):
                if row[0] != now and size > CHUNK:
                    yield solved()
                    held, size = [], 0
                now = row[0]
                held.append(row)
                size += len(row[1])
        if held:
            yield solved()

    return work


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Of every row of docs (with_uid): doc_id, uid, n_bytes, n_removed, n_spans, kept (bytes, null if nothing goes) and merged spans."""
    lists = spans.groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uid, text, own in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "spans")), strict=True):
                merged: list[list[int]] = []
                for b, e in sorted((x["start"], x["end"]) for x in own):
                    if merged and b <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([b, e])
                data = (text or "").encode("utf-8")
                edges = [0, *(x for pair in merged for x in pair), len(data)]
                kept = b"".join(data[b:e] for b, e in zip(edges[::2], edges[1::2], strict=True))
                out.append((uid, len(data) - len(kept), len(merged), kept, [{"start": b, "end": e} for b, e in merged]))
            types = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["uid", "n_removed", "n_spans", "kept", "spans"])

    return docs.select("uid", "text").join(lists, "uid").mapInArrow(work, "uid binary, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every row of docs, with repeated spans removed.

    n_spans counts maximal removed runs. Rows that repeat doc_id and text are
    copies of each other. Columns beside doc_id and text are not read.
    """
    docs = with_uid(docs)
    gone = remove_spans(docs, repeated_spans(docs, **options)).select("uid", "n_removed", "n_spans", "spans", F.sha2("kept", 256).alias("_sha")).dropDuplicates(["uid"])
    rows = docs.select("doc_id", "uid", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("_own"))
    zero = F.lit(0).cast("long")
    return rows.join(gone, "uid", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("_sha", "_own").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))
