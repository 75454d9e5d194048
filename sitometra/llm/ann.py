"""Nearest neighbours by a hierarchical navigable small-world graph per shard.

A graph is kept as flat arrays: for each level a table of neighbour numbers, -1
where there is none. Vectors get one more component that makes all lengths equal,
so that the largest inner product with a query is also the nearest vector.
Searches walk all queries of a block at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Queries walked at once, and nodes of each that a step of theirs opens at most.
TOGETHER, STEP = 256, 8


@dataclass
class Graph:
    vectors: np.ndarray  # (n, d) float32
    levels: list[np.ndarray]  # (n, m) int32, from the bottom
    top: int  # where searches enter
    height: np.ndarray  # highest level of each vector, int8

    def search(self, queries: np.ndarray, breadth: int, level: int = 0, entry: np.ndarray | None = None, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and products of the best found for each query, best first; -1 where there are fewer."""
        n = len(queries)
        if entry is None:
            entry = np.full((n, 1), self.top, np.int64)
            for upper in range(len(self.levels) - 1, level, -1):
                entry = self._walk(queries, entry, 1, upper)[0]
        return self._walk(queries, entry, breadth, level)

    def _walk(self, queries: np.ndarray, entry: np.ndarray, breadth: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        n, near = len(queries), self.levels[level]
        rows = np.arange(n)
        seen = np.zeros((n, len(self.vectors) + 1), bool)
        seen[:, -1] = True  # what -1 points to
        ids = np.full((n, breadth), -1, np.int64)
        got = np.full((n, breadth), -np.inf, np.float32)
        open_ = np.zeros((n, breadth), bool)
        width = min(breadth, entry.shape[1])
        ids[:, :width] = entry[:, :width]
        got[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("qkd,qd->qk", self.vectors[ids[:, :width]], queries), -np.inf)
        open_[:, :width] = ids[:, :width] >= 0
        seen[rows[:, None], ids[:, :width]] = True
        together = max(1, min(STEP, breadth // 8))
        while True:
            best = np.where(open_, got, -np.inf)
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                break
            by = live[:, None]
            pick = np.argpartition(-best[live], together - 1, axis=1)[:, :together]
            chosen = open_[by, pick]
            open_[by, pick] = False
            next_ = near[np.where(chosen, ids[by, pick], -1)].astype(np.int64)
            next_[~chosen] = -1
            next_ = next_.reshape(len(live), -1)
            if together > 1:
                # Two nodes may share a neighbour: the second one goes.
                next_.sort(axis=1)
                next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            fresh = ~seen[by, next_]
            seen[by, next_] = True
            value = np.full(next_.shape, -np.inf, np.float32)
            value[fresh] = np.einsum("nd,nd->n", self.vectors[next_[fresh]], queries[live[np.nonzero(fresh)[0]]])
            all_got = np.concatenate([got[live], value], axis=1)
            keep = np.argpartition(-all_got, breadth - 1, axis=1)[:, :breadth]
            pairs = np.arange(len(live))[:, None]
            got[live] = all_got[pairs, keep]
            ids[live] = np.concatenate([ids[live], np.where(fresh, next_, -1)], axis=1)[pairs, keep]
            open_[live] = np.concatenate([open_[live], fresh], axis=1)[pairs, keep] & (got[live] > -np.inf)
        order = np.argsort(-got, axis=1, kind="stable")
        ids, got = np.take_along_axis(ids, order, 1), np.take_along_axis(got, order, 1)
        return np.where(got > -np.inf, ids, -1), got

    def pack(self) -> dict[str, object]:
        return {"n": len(self.vectors), "top": self.top, "vectors": self.vectors.tobytes(), "height": self.height.tobytes(), "levels": [x.tobytes() for x in self.levels], "degree": [x.shape[1] for x in self.levels]}

    @classmethod
    def unpack(cls, row: dict) -> Graph:
        n = row["n"]
        levels = [np.frombuffer(x, np.int32).reshape(n, m) for x, m in zip(row["levels"], row["degree"], strict=True)]
        return cls(np.frombuffer(row["vectors"], np.float32).reshape(n, -1), levels, row["top"], np.frombuffer(row["height"], np.int8))


def _diverse(vectors: np.ndarray, base: np.ndarray, ids: np.ndarray, got: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates, best first, those that are nearer to the row than to any taken before; then the rest."""
    n, c = ids.shape
    found = vectors[ids]
    between = np.einsum("ncd,nkd->nck", found, found)
    taken = np.zeros((n, c), bool)
    for j in range(c):
        near = (np.where(taken, between[:, j], -np.inf).max(axis=1) <= got[:, j]) & (ids[:, j] >= 0) & (taken.sum(axis=1) < m)
        taken[:, j] = near
    order = np.argsort(~taken * 2 + (ids < 0), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(ids, order, 1)


def build(vectors: np.ndarray, degree: int = 16, breadth: int = 80, seed: int = 5) -> Graph:
    """Insert the vectors, in an order drawn from seed, in batches that grow with the graph."""
    n, d = vectors.shape
    rng = np.random.default_rng([seed, n])
    height = np.minimum(rng.geometric(1 - 1 / degree, n) - 1, 6).astype(np.int8)
    tallest = int(height.argmax())
    height[tallest] = height.max(initial=0)
    graph = Graph(vectors, [np.full((n, degree * (1 if k else 2)), -1, np.int32) for k in range(int(height.max(initial=0)) + 1)], tallest, height)
    order = rng.permutation(n)
    order = np.concatenate([[tallest], order[order != tallest]])
    done = 1
    while done < n:
        batch = order[done : done + max(1, min(TOGETHER, done // 4))]
        queries = vectors[batch]
        entry = np.full((len(batch), 1), graph.top, np.int64)
        for level in range(len(graph.levels) - 1, -1, -1):
            tall = height[batch] >= level
            ids, got = graph._walk(queries, entry, breadth if tall.any() else 1, level)
            entry = ids[:, : max(1, breadth // 2)] if tall.any() else ids
            if not tall.any():
                continue
            near, m = graph.levels[level], graph.levels[level].shape[1]
            own, ids, got = batch[tall], ids[tall][:, : 2 * degree], got[tall][:, : 2 * degree]
            chosen = _diverse(vectors, own, ids, got, degree)
            near[own, : chosen.shape[1]] = chosen
            # Links back: each touched vector keeps its most diverse neighbours.
            src = np.repeat(own, chosen.shape[1])
            dst = chosen.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            touched, first, count = np.unique(dst, return_index=True, return_counts=True)
            free = (near[touched] < 0).sum(axis=1)
            wide = max(1, int(count.max(initial=0)))
            more = np.full((len(touched), wide), -1, np.int64)
            more[np.repeat(np.arange(len(touched)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
            fits = count <= free
            for row, extra, c in zip(touched[fits], more[fits], count[fits], strict=True):
                used = int((near[row] >= 0).sum())
                near[row, used : used + c] = extra[:c]
            crowded = np.flatnonzero(~fits)
            for at in range(0, len(crowded), 512):
                part = crowded[at : at + 512]
                rows = touched[part]
                cand = np.concatenate([near[rows].astype(np.int64), more[part]], axis=1)
                value = np.where(cand >= 0, np.einsum("nkd,nd->nk", vectors[cand], vectors[rows]), -np.inf)
                by = np.argsort(-value, axis=1, kind="stable")
                near[rows] = -1
                picked = _diverse(vectors, rows, np.take_along_axis(cand, by, 1), np.take_along_axis(value, by, 1), m)
                near[rows, : picked.shape[1]] = picked
        done += len(batch)
    return graph


def usable(embeddings: DataFrame, vector: str, key: str) -> DataFrame:
    """key, v (array<double>) and dim of rows that take part: no null, non-finite or zero vectors, no null key."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = embeddings.select(F.col(key).cast("long").alias("key"), v.alias("v")).where("key is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _classes(rows: DataFrame, most: int) -> DataFrame:
    """One row per distinct vector with its `most` least keys.

    A very common vector's keys are ranked in salted parts, and the parts' least ones
    again, so that no list of all of them is ever made.
    """
    pairs = rows.select("key", "v", "dim").distinct()
    parts = cut(pairs.groupBy("v", "dim").agg(F.ceil(F.count("*") / (64 * most)).alias("parts"), F.min("key").alias("least")))
    common = parts.where("parts > 1")
    alone = parts.where("parts = 1").select("v", "dim")
    own = pairs.join(alone, ["v", "dim"]).groupBy("v", "dim").agg(F.sort_array(F.collect_list("key")).alias("own")).select("v", "dim", F.slice("own", 1, most).alias("own"))
    if not common.limit(1).count():
        return own
    shared = pairs.join(common.select("v", "dim", "parts"), ["v", "dim"]).withColumn("salt", F.pmod(F.xxhash64("key"), F.col("parts")))
    for by in (["v", "dim", "salt"], ["v", "dim"]):
        first = F.row_number().over(Window.partitionBy(*by).orderBy("key"))
        shared = shared.withColumn("_rank", first).where(F.col("_rank") <= most)
    return own.unionByName(shared.groupBy("v", "dim").agg(F.sort_array(F.collect_list("key")).alias("own")))


def lift(exact: np.ndarray) -> np.ndarray:
    """The vectors as float32, all of one length by one more component.

    That length is that of the longest but for a hundredth of them: a few very long
    vectors would leave the others no digits. Those are scaled to it; they are found
    by their direction, and scores are of the vectors as they were.
    """
    unit = exact / np.abs(exact).max(axis=1, keepdims=True)
    length = np.sqrt((unit * unit).sum(axis=1)) * np.abs(exact).max(axis=1)
    full = np.sort(length)[int(0.99 * (len(length) - 1))]
    inside = exact * (np.minimum(1.0, full / length) / full)[:, None]
    rest = np.maximum(1 - (inside * inside).sum(axis=1), 0)
    return np.concatenate([inside, np.sqrt(rest)[:, None]], axis=1).astype(np.float32)


def index(classes: DataFrame, shards: int, degree: int = 16, breadth: int = 64) -> DataFrame:
    """One row per dimension and shard: the graph's flat arrays, the original vectors and their keys."""
    schema = "dim int, shard int, n int, top int, vectors binary, height binary, levels array<binary>, degree array<int>, exact binary, own array<array<long>>"

    def make(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        exact = np.stack(part["v"].to_list()).astype(np.float64)
        lead = np.array([int(x[0]) for x in part["own"]])
        by = np.argsort(lead, kind="stable")
        exact = exact[by]
        row = build(lift(exact), degree, breadth).pack()
        row |= {"dim": key[0], "shard": key[1], "exact": exact.tobytes(), "own": [[int(x) for x in part["own"].iloc[i]] for i in by]}
        return pd.DataFrame([row])

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64(F.element_at("own", 1)), F.lit(shards)).cast("int"))
    return cut(dealt.groupBy("dim", "shard").applyInPandas(make, schema))


def nearest(embeddings: DataFrame, *, vector: str = "embedding", key: str = "vec_id", every: int = 20, k: int = 20, shards: int = 6, shard_rows: int = 3000, degree: int = 16, breadth: int = 64, search: int = 240) -> DataFrame:
    """query_id, rank, vec_id, score: of every row whose key is divisible by `every` the k nearest other rows by inner product.

    All rows that take part are indexed, equal vectors as one. A shard holds up to
    about shard_rows of them; every query visits every shard, and their best are
    merged. A shard's graph is sent once, to the task that streams the queries past
    it. Vectors of other lengths are searched among their own. A key that repeats with
    another vector is another candidate; as a query, the row with the least vector
    counts. Rows without a usable vector or with a null key take no part. Columns
    beside the key and the vector are not read. An empty table gives no rows.
    """
    rows = cut(usable(embeddings, vector, key))
    total = rows.count()
    graphs = index(_classes(rows, k + 1), max(shards, -(-total // shard_rows)), degree, breadth)
    asked = rows.where(F.col("key") % every == 0).groupBy("key").agg(F.min(F.struct("v", "dim")).alias("m")).select("key", "m.v", "m.dim")
    asked = asked.join(graphs.select("dim", "shard"), "dim")
    # Graphs come before the queries of their shard.
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in graphs.schema if f.name not in ("dim", "shard")]
    guests = asked.select("dim", "shard", F.lit(1).alias("turn"), *empty, "key", "v")
    hosts = graphs.select("dim", "shard", F.lit(0).alias("turn"), *[f.name for f in graphs.schema if f.name not in ("dim", "shard")], F.lit(None).cast("long").alias("key"), F.lit(None).cast("array<double>").alias("v"))
    names, types = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = own = exact = None
        for batch in batches:
            turn = batch.column("turn").to_pylist()
            at = 0
            while at < len(turn):
                if not turn[at]:
                    row = batch.slice(at, 1).to_pylist()[0]
                    graph, own = Graph.unpack(row), row["own"]
                    exact = np.frombuffer(row["exact"], np.float64).reshape(row["n"], -1)
                    at += 1
                    continue
                end = at
                while end < len(turn) and turn[end] and end - at < TOGETHER:
                    end += 1
                ids = batch.column("key").slice(at, end - at).to_pylist()
                q = np.array(batch.column("v").slice(at, end - at).to_pylist(), np.float64)
                at = end
                lifted = np.concatenate([q / np.abs(q).max(axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1).astype(np.float32)
                found, _ = graph.search(lifted, max(search, k + 1))
                out: list[tuple[int, int, float]] = []
                for i, hits in enumerate(found):
                    hits = hits[hits >= 0]
                    score = (exact[hits] * q[i]).sum(axis=1)
                    each = sorted((-s, v) for s, h in zip(score.tolist(), hits.tolist(), strict=True) for v in own[h] if v != ids[i])
                    out += [(ids[i], v, -s) for s, v in each[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(types)], names=names)

    near = hosts.unionByName(guests).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "turn").mapInArrow(look, "query_id long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
