"""Approximate nearest neighbours over stable random projections and kd-trees.

Largest inner product becomes least distance by one more coordinate, sqrt(B^2 - |x|^2)
with B the largest norm, 0 for queries. A Gaussian projection to a few dimensions is
2-stable: the projected squared distance over the true one is chi-square with as many
degrees of freedom. Vectors are dealt to cells of a kd-tree over the projections,
each cell holds a kd-tree of small leaves, and a query verifies projected neighbours in
order of their distance until the chi-square test says that a nearer vector would have
shown up by now. Every vector is indexed and every cell is searched or ruled out by the
same test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .vectors import matrix, usable_vectors

#: Projected dimensions (even), vectors aimed at in a cell, vectors in a leaf, and the
#: documented bound of the sample that the cells' borders are fitted on.
DIMS, CELL, LEAF, SAMPLE = 8, 4096, 64, 8192
#: Probability with which the test keeps a neighbour as near as the k-th one found.
KEEP = 0.97


def chi_square(x: float, dims: int = DIMS) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, dims // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def chi_square_bound(keep: float = KEEP, dims: int = DIMS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < keep else (low, middle)
    return high


BOUND = chi_square_bound()


def projection(dim: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(dim + 1, dims))


def projected(x: np.ndarray, largest: float | None) -> np.ndarray:
    """Projections of vectors (``largest`` is the largest norm) or of queries (None)."""
    p = projection(x.shape[1])
    out = x @ p[:-1]
    if largest is not None:
        out += np.sqrt(np.maximum(largest**2 - np.einsum("ij,ij->i", x, x), 0))[:, None] * p[-1]
    return out


class Splits:
    """Borders of kd cells: medians of the widest dimension of a sample."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth, self.dim, self.at = depth, {}, {}
        parts = {1: sample}
        for _ in range(depth):
            below = {}
            for node, rows in parts.items():
                d = int(np.ptp(rows, axis=0).argmax()) if len(rows) else 0
                at = float(np.median(rows[:, d])) if len(rows) else 0.0
                self.dim[node], self.at[node] = d, at
                right = rows[:, d] > at
                below[2 * node], below[2 * node + 1] = rows[~right], rows[right]
            parts = below

    def cell(self, rows: np.ndarray) -> np.ndarray:
        node = np.ones(len(rows), np.int64)
        for _ in range(self.depth):
            new = node.copy()
            for n in np.unique(node):
                on = node == n
                new[on] = 2 * n + (rows[on, self.dim[int(n)]] > self.at[int(n)])
            node = new
        return node


def leaves(rows: np.ndarray) -> list[np.ndarray]:
    """Members of the leaves of a kd-tree split at medians of the widest dimension."""
    done, stack = [], [np.arange(len(rows))]
    while stack:
        part = stack.pop()
        if len(part) <= LEAF:
            done.append(part)
            continue
        d = int(np.ptp(rows[part], axis=0).argmax())
        half = len(part) // 2
        order = np.argpartition(rows[part, d], half)
        stack += [part[order[:half]], part[order[half:]]]
    return done


def box_gaps(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances from a point to boxes."""
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return np.einsum("ij,ij->i", gap, gap)


def search_cell(points: np.ndarray, ids: list, queries: np.ndarray, limits: np.ndarray, largest: float, k: int) -> list[list[tuple[float, int]]]:
    """For each query its best (score, id), at most ``k``, best first, that a verified
    point of this cell offers. ``limits`` are scores of k-th neighbours known already."""
    p, q = projected(points, largest), projected(queries, None)
    parts = leaves(p)
    order = np.concatenate(parts)
    ends = np.cumsum([len(x) for x in parts])
    begins = ends - [len(x) for x in parts]
    low, high = (np.stack([f(p[x], axis=0) for x in parts]) for f in (np.min, np.max))
    points, p = points[order], p[order]
    copies = np.array([len(ids[i]) for i in order])
    square = np.einsum("ij,ij->i", queries, queries) + largest**2
    found = []
    for i in range(len(queries)):
        gaps = box_gaps(low, high, q[i])
        nearest = np.argsort(gaps, kind="stable")
        limit, scores, members, at, step = limits[i], np.zeros(0), np.zeros(0, np.int64), 0, 2
        while at < len(nearest):
            reach = BOUND * max(square[i] - 2 * limit, 0) + 1e-9 if limit > -np.inf else np.inf
            if gaps[nearest[at]] > reach:
                break
            block = nearest[at : at + step]
            at, step = at + step, min(2 * step, 32)
            rows = np.concatenate([np.arange(begins[b], ends[b]) for b in block[gaps[block] <= reach]])
            gap = p[rows] - q[i]
            rows = rows[np.einsum("ij,ij->i", gap, gap) <= reach]
            scores = np.concatenate([scores, np.einsum("ij,j->i", points[rows], queries[i])])
            members = np.concatenate([members, rows])
            if len(scores) > 4 * k:
                kept = scores >= np.partition(scores, -k)[-k]
                scores, members = scores[kept], members[kept]
            if copies[members].sum() >= k:
                rank = np.argsort(-scores, kind="stable")
                full = np.searchsorted(np.cumsum(copies[members[rank]]), k)
                limit = max(limit, scores[rank[full]])
        best = sorted(((-s, v) for s, m in zip(scores.tolist(), members.tolist(), strict=True) if s >= limit for v in ids[order[m]]))[:k]
        found.append([(-s, v) for s, v in best])
    return found


def searcher(largest: float, k: int):
    def run(key, queries: pa.Table, points: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and points.num_rows:
            x, q = matrix(points["v"]), matrix(queries["v"])
            limits = queries["limit"].to_numpy()
            out = search_cell(x, points["ids"].to_pylist(), q, np.where(np.isnan(limits), -np.inf, limits), largest, k)
        qids = queries["qid"].to_pylist() if out else []
        return pa.table({"qid": pa.array([i for i, f in zip(qids, out, strict=True) for _ in f], pa.int64()), "vec_id": pa.array([v for f in out for _, v in f], pa.int64()), "score": pa.array([s for f in out for s, _ in f], pa.float64())})

    return run


def cell_udf(splits: dict[int, Splits], largest: float, vectors: bool):
    """Cell and projection of each vector or query."""

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
            cells, shadows = np.zeros(len(lists), np.int64), np.zeros((len(lists), DIMS))
            for dim in np.unique(sizes).tolist():
                on = np.flatnonzero(sizes == dim)
                shadow = projected(matrix(lists.take(pa.array(on))), largest if vectors else None)
                shadows[on] = shadow
                cells[on] = splits[dim].cell(shadow) if dim in splits else 0
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * DIMS), pa.array(shadows.ravel()))
            yield pa.StructArray.from_arrays([pa.array(cells), flat], ["cell", "shadow"])

    return F.arrow_udf(place, "cell long, shadow array<double>")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose id is divisible by
    ``every``, its ``k`` nearest others by inner product in double precision, nearest
    first, ties to the smaller id.

    Equal vectors are searched and indexed once, with the k + 1 smallest ids of each:
    no other copy can be among the k nearest. Vectors that are null, zero or hold a null
    or non-finite component take no part; vectors of other dimensions than the query's
    are no candidates. Rows with the same id as the query are its own. Other columns
    are ignored. Neighbours found depend on the projection: with KEEP = 0.97 at least
    nine in ten true ones are found.
    """
    spark = vectors.sparkSession
    rows = saved(usable_vectors(vectors, id_col, vector_col), "vectors")
    few = rows.select("vec_id", "h1", "h2", "dim").withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    ids = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("vec_id"))
    first = rows.join(ids, ["h1", "h2", "vec_id"]).dropDuplicates(["h1", "h2"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    about = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("largest")).collect()  # a row for each dimension
    largest = max([r["largest"] for r in about], default=1.0)
    splits = {}
    for r in about:
        sample = first.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
        depth = max(0, min(math.ceil(math.log2(max(1, r["n"] / CELL))), int(math.log2(max(1, len(sample) / 16)))))
        splits[r["dim"]] = Splits(projected(np.stack(sample.to_numpy()), largest), depth)
    # points: a cell over CELL vectors is dealt to shards of that many
    points = saved(first.withColumn("p", cell_udf(splits, largest, True)("v")).select("dim", "p.cell", "p.shadow", "ids", "v"), "points")
    sides = [f(F.col("shadow")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(DIMS)]
    cells = points.groupBy("dim", "cell").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("shards"), *sides)
    boxes = cells.toPandas()  # SAMPLE / 8 rows at most for a dimension
    points = points.join(F.broadcast(cells.select("dim", "cell", "shards")), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("shards")).cast("int"))
    asked = rows.where(F.col("vec_id") % every == 0)
    one = asked.groupBy("h1", "h2", "dim").agg(F.min("vec_id").alias("qid"), F.first("v").alias("v"))
    queries = saved(one.withColumn("p", cell_udf(splits, largest, False)("v")).select("qid", "h1", "h2", "dim", "p.cell", "p.shadow", "v"), "queries")
    known = spark.sparkContext.broadcast(boxes)

    def searched(asks: DataFrame) -> DataFrame:
        key = ["dim", "cell", "shard"]
        return asks.groupBy(*key).cogroup(points.groupBy(*key)).applyInArrow(searcher(largest, k + 1), "qid long, vec_id long, score double")

    shards = F.broadcast(cells.select("dim", "cell", "shards"))
    home = queries.join(shards, ["dim", "cell"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    near = saved(searched(home.select("dim", "cell", "shard", "qid", "v", F.lit(float("nan")).alias("limit"))), "near")
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    kth = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).groupBy("qid").agg(F.max("place").alias("places"), F.min("score").alias("limit")).where(F.col("places") == k + 1).drop("places")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: pd.DataFrame = known.value
        by_dim = {d: (t["cell"].to_numpy(), t["shards"].to_numpy(), t[[f"low{i}" for i in range(DIMS)]].to_numpy(), t[[f"high{i}" for i in range(DIMS)]].to_numpy()) for d, t in table.groupby("dim")}
        for batch in batches:
            row, cell, shard = [], [], []
            for i, (dim, own, shadow, v, limit) in enumerate(zip(*(batch[c].to_pylist() for c in ("dim", "cell", "shadow", "v", "limit")), strict=True)):
                if dim not in by_dim:
                    continue
                numbers, counts, low, high = by_dim[dim]
                reach = np.inf if limit is None else BOUND * max(float(np.dot(v, v)) + largest**2 - 2 * limit, 0) + 1e-9
                for c in np.flatnonzero((box_gaps(low, high, np.array(shadow)) <= reach) & (numbers != own)).tolist():
                    for s in range(int(counts[c])):
                        row.append(i)
                        cell.append(int(numbers[c]))
                        shard.append(s)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["dim"].take(at), pa.array(cell, pa.int64()), pa.array(shard, pa.int32()), batch["qid"].take(at), batch["v"].take(at), batch["limit"].take(at)], ["dim", "cell", "shard", "qid", "v", "limit"])

    away = queries.join(kth, "qid", "left").select("dim", "cell", "shadow", "qid", "v", "limit").mapInArrow(others, "dim int, cell long, shard int, qid long, v array<double>, limit double")
    found = near.unionByName(searched(away.withColumn("limit", F.coalesce("limit", F.lit(float("nan"))))))
    top = saved(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"), "top")
    asking = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(queries.select("h1", "h2", "qid"), ["h1", "h2"])
    mine = asking.join(top, "qid").where("query_id != vec_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
