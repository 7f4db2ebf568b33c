"""Near-duplicate vectors within labels by dual traversal of cover trees.

Vectors of one label are dealt to cells around pivots. A vector is a point of its own
cell and seeks in every cell that its ball of the threshold radius may reach. In a
cell, a cover tree over the points and one over the seekers (nested levels, radii
halving) are traversed together: a pair of nodes is dropped when their centres lie
further apart than both covering radii and the threshold, taken whole when even the
furthest members lie within it, and opened otherwise. All links are found, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components
from .vectors import matrix, usable_vectors

#: Vectors aimed at in a cell and seekers in one task of it; bound of the pivots.
CELL, SEEKERS, PIVOTS, PIVOT_BYTES = 2048, 4096, 4096, 8 << 20
#: Doubt about a distance in double precision: nearer to the threshold, pairs are
#: compared by their cosine.
DOUBT = 1e-7
#: Child pairs of a node pair from which one matrix product serves them all.
DENSE = 4096


@dataclass
class Level:
    """The nodes of one level: centre, parent in the level above, covering radius and
    range of members in the tree's order."""

    centre: np.ndarray
    parent: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def net(points: np.ndarray, members: np.ndarray, radius: float, block: int = 256) -> tuple[list, list, list, list]:
    """Centres among ``members`` further apart than ``radius``, the first member first,
    with the members that each takes, their number and the covering radius.

    Distances of a block of members to all that are left come from one product.
    """
    ordered, centres, sizes, radii, left = [], [], [], [], members
    while len(left):
        gaps = np.sqrt(np.maximum(2 - 2 * (points[left[:block]] @ points[left].T), 0))
        free = np.ones(len(left), bool)
        for k in range(len(gaps)):
            if free[k]:
                gaps[k, k] = 0
                near = np.flatnonzero(free & (gaps[k] <= radius))
                free[near] = False
                centres.append(left[k])
                ordered.append(left[near])
                sizes.append(len(near))
                radii.append(float(gaps[k, near].max()))
        left = left[free]
    return ordered, centres, sizes, radii


def build(points: np.ndarray, smallest: float) -> tuple[np.ndarray, list[Level]]:
    """Order of the unit vectors and levels with radii 2, 1, 1/2 ... ``smallest``.

    A node's children are a net of its members: each member is within the level's
    radius of its child's centre, centres are further apart than that radius, and the
    first child has the centre of its parent. Below ``smallest`` stand single points.
    """
    n = len(points)
    order = np.arange(n)
    levels = [Level(np.array([0]), np.array([0]), np.array([2.0]), np.array([0]), np.array([n]))]
    radius = 1.0
    while len(levels[-1].centre) < n:
        last = radius < smallest
        above, parts = levels[-1], []
        for i, (b, e) in enumerate(zip(above.begin.tolist(), above.end.tolist(), strict=True)):
            members = order[b:e]
            if e - b == 1:
                parts.append((i, members, members[:1], [1], [0.0]))
                continue
            if last:
                parts.append((i, members, members, [1] * (e - b), [0.0] * (e - b)))
                continue
            ordered, centres, sizes, radii = net(points, members, radius)
            parts.append((i, np.concatenate(ordered), np.array(centres), sizes, radii))
        order = np.concatenate([p[1] for p in parts])
        sizes = np.array([s for p in parts for s in p[3]])
        end = np.cumsum(sizes)
        levels.append(Level(np.concatenate([p[2] for p in parts]), np.repeat([p[0] for p in parts], [len(p[3]) for p in parts]), np.array([r for p in parts for r in p[4]]), end - sizes, end))
        radius /= 2
    return order, levels


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the ranges first .. first + count."""
    row = np.repeat(np.arange(len(first)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def child_pairs(sides: list, seekers: np.ndarray, s_centre: np.ndarray, points: np.ndarray, p_centre: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of children of node pairs with the products of their centres: of large
    families by blocks of a matrix product, of small ones one by one."""
    (first_s, count_s), (first_p, count_p) = sides
    large = count_s * count_p >= DENSE
    for i in np.flatnonzero(large):
        right = np.arange(first_p[i], first_p[i] + count_p[i])
        other = points[p_centre[right]].T
        for at in range(first_s[i], first_s[i] + count_s[i], 512):
            left = np.arange(at, min(at + 512, first_s[i] + count_s[i]))
            dot = seekers[s_centre[left]] @ other
            yield np.repeat(left, len(right)), np.tile(right, len(left)), dot.ravel()
    few = ~large
    row, x = spread(first_s[few], count_s[few])
    for i in range(0, len(x), 1 << 14):
        row2, y = spread(first_p[few][row[i : i + (1 << 14)]], count_p[few][row[i : i + (1 << 14)]])
        x2 = x[i : i + (1 << 14)][row2]
        yield x2, y, np.einsum("ij,ij->i", seekers[s_centre[x2]], points[p_centre[y]])


def links(points: np.ndarray, seekers: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of linked node pairs as (first seeker, last, first point, last) positions in
    the trees' orders; the first value yielded holds these orders."""
    reach = np.sqrt(2 - 2 * cosine)
    (order_p, tree_p), (order_s, tree_s) = build(points, reach / 4), build(seekers, reach / 4)
    yield order_s, order_p, np.zeros(0), np.zeros(0)
    depth = max(len(tree_p), len(tree_s))
    a, b = np.array([0]), np.array([0])
    for level in range(1, depth + 1):  # the last one is exact
        (s_up, s), (p_up, p) = ((t[min(level - 1, len(t) - 1)], t[min(level, len(t) - 1)]) for t in (tree_s, tree_p))
        final = level == depth
        if final:
            for i in range(0, len(a), 1 << 16):
                x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                hit = np.einsum("ij,ij->i", seekers[s.centre[x]], points[p.centre[y]]) >= cosine
                yield s.begin[x[hit]], s.end[x[hit]], p.begin[y[hit]], p.end[y[hit]]
            return
        sides = []
        for up, down, at, tree in ((s_up, s, a, tree_s), (p_up, p, b, tree_p)):
            if level < len(tree):
                first = np.searchsorted(down.parent, np.arange(len(up.centre)))
                sides.append((first[at], np.bincount(down.parent, minlength=len(up.centre))[at]))
            else:
                sides.append((at, np.ones(len(at), np.int64)))
        kept_a, kept_b = [a[:0]], [b[:0]]
        for x, y, dot in child_pairs(sides, seekers, s.centre, points, p.centre):
            gap, wide = np.sqrt(np.maximum(2 - 2 * dot, 0)), s.radius[x] + p.radius[y]
            whole = (gap + wide <= reach - DOUBT) & (wide > 0)
            yield s.begin[x[whole]], s.end[x[whole]], p.begin[y[whole]], p.end[y[whole]]
            open_ = ~whole & (gap - wide <= reach + DOUBT)
            kept_a.append(x[open_])
            kept_b.append(y[open_])
        a, b = np.concatenate(kept_a), np.concatenate(kept_b)
        if not len(a):
            return


def traverse(points: np.ndarray, weights: np.ndarray, seekers: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight of the points linked to each seeker, group of each seeker, of each point):
    groups are numbers of the components of this bipartite graph."""
    n, m = len(seekers), len(points)
    found = links(points, seekers, cosine)
    order_s, order_p, _, _ = next(found)
    running = np.concatenate([[0], np.cumsum(weights[order_p])])
    total = np.zeros(n, np.int64)
    one, two = [], []
    for sb, se, pb, pe in found:
        if not len(sb):
            continue
        row, s = spread(sb, se - sb)
        np.add.at(total, order_s[s], (running[pe] - running[pb])[row])
        # a whole pair of nodes is connected by its first seeker and its first point
        one.append(order_s[s])
        two.append(order_p[pb][row])
        row, p = spread(pb, pe - pb)
        one.append(order_s[sb][row])
        two.append(order_p[p])
    group = np.arange(n + m)
    if one:
        s, p = np.concatenate(one), np.concatenate(two) + n
        while True:
            before = group.copy()
            least = np.minimum(group[s], group[p])
            np.minimum.at(group, s, least)
            np.minimum.at(group, p, least)
            group = group[group]
            if (group == before).all():
                break
    return total, group[:n], group[n:]


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def cell_links(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        home = table["home"].to_numpy().astype(bool)
        ids, weights = table["rep"].to_numpy(), table["weight"].to_numpy()
        rows = unit(matrix(table["v"])) if len(home) else np.zeros((0, 1))
        # a row with slice -1 is a point only; the others seek, those at home are points too
        seeks = table["seeks"].to_numpy().astype(bool)
        if not home.any() or not seeks.any():
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        total, gs, gp = traverse(rows[home], weights[home], rows[seeks], cosine)
        least = np.full(len(gs) + len(gp), np.iinfo(np.int64).max)
        np.minimum.at(least, gs, ids[seeks])
        np.minimum.at(least, gp, ids[home])
        return pa.table({"rep": np.concatenate([ids[seeks], ids[home]]), "links": np.concatenate([total, np.zeros(len(gp), np.int64)]), "root": np.concatenate([least[gs], least[gp]])})

    return run


def deal(reach: float, pivots: dict):
    """For each vector, its own cell, its distance from that cell's pivot, and the cells
    that its ball may reach: beyond the plane between two pivots by the reach at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            homes, gaps = np.zeros(len(rows), np.int64), np.zeros(len(rows))
            at, cells, apart = [], [], []
            for key, part in rows.groupby(["label", "dim"]).indices.items():
                numbers, centres = pivots[key]
                x = unit(np.stack(rows["v"].to_numpy()[part]))
                square = np.maximum(2 - 2 * (x @ centres.T), 0)
                near, each = square.argmin(1), np.arange(len(part))
                between = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))[near]
                beyond = (square - square[each, near][:, None]) <= 2 * between * (reach + DOUBT)
                beyond[each, near] = False
                homes[part], gaps[part] = numbers[near], np.sqrt(square[each, near])
                row, column = np.nonzero(beyond)
                at.append(part[row])
                cells.append(numbers[column])
                apart.append(np.sqrt(square[row, column]))
            at, cells, apart = (np.concatenate(v) if v else np.zeros(0) for v in (at, cells, apart))
            order = np.argsort(at, kind="stable")
            begins = np.concatenate([[0], np.cumsum(np.bincount(at.astype(np.int64), minlength=len(rows)))]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(cells[order].astype(np.int64)), pa.array(apart[order].astype(float))], ["cell", "gap"])
            near_by = pa.ListArray.from_arrays(pa.array(begins), pairs)
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["weight"], batch["v"], pa.array(homes), pa.array(gaps), near_by], ["rep", "weight", "v", "cell", "gap", "visits"])

    return run


def choose_pivots(classes: DataFrame) -> dict:
    """Pivots for each label and dimension, in proportion to its number of classes: at
    most PIVOTS and PIVOT_BYTES in all, those with the first hashed ids, one at least."""
    from pyspark.sql import Window

    sizes = classes.groupBy("label", "dim").count()
    rows = sizes.agg(F.sum("count"), F.max("dim")).first()
    total, dim = rows[0] or 0, rows[1] or 1
    bound = max(1, min(PIVOTS, PIVOT_BYTES // (8 * dim)))
    per = max(CELL, -(-total // bound))
    place = F.row_number().over(Window.partitionBy("label", "dim").orderBy(F.xxhash64("rep"), "rep"))
    first = classes.withColumn("place", place).where(F.col("place") <= bound).join(sizes, ["label", "dim"]).where(F.col("place") <= F.ceil(F.col("count") / per))
    found: dict = {}
    number = 0
    for r in sorted(first.select("label", "dim", "rep", "v").toLocalIterator(), key=lambda r: (r["label"], r["dim"], r["rep"])):
        found.setdefault((r["label"], r["dim"]), []).append((number, r["v"]))
        number += 1
    return {k: (np.array([x[0] for x in v]), unit(np.array([x[1] for x in v]))) for k, v in found.items()}


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each input row.

    Vectors are compared when labels and dimensions are equal and labels not null; a
    vector that is null, zero or holds a null or non-finite component has no links.
    ``n_links`` counts rows: equal vectors are compared once and counted as often as
    they stand in the table. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors, id_col, vector_col, F.col(label_col).alias("label")).where("label is not null")
    classes = saved(rows.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v")), "vectors")
    reach = float(np.sqrt(2 - 2 * cosine))
    pivots = spark.sparkContext.broadcast(choose_pivots(classes))  # PIVOT_BYTES at most

    def dealt_out(batches):
        yield from deal(reach, pivots.value)(batches)

    schema = "rep long, weight long, v array<double>, cell long, gap double, visits array<struct<cell: long, gap: double>>"
    dealt = saved(classes.select("rep", "weight", "v", "label", "dim").mapInArrow(dealt_out, schema), "dealt")
    cells = dealt.groupBy("cell").agg(F.max("gap").alias("radius"))  # PIVOTS rows at most
    seekers = dealt.select("rep", "weight", "v", F.explode("visits").alias("to")).select("rep", "weight", "v", "to.cell", "to.gap").join(F.broadcast(cells), "cell").where(F.col("gap") - F.col("radius") <= reach + 1e-6)
    seekers = seekers.select("cell", "rep", "weight", "v", F.lit(False).alias("home")).unionByName(dealt.select("cell", "rep", "weight", "v", F.lit(True).alias("home")))
    sizes = seekers.groupBy("cell").agg(F.ceil(F.count("*") / SEEKERS).cast("int").alias("slices"))
    placed = seekers.join(F.broadcast(sizes), "cell").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))
    # a point stands in every slice of its cell, a seeker in one
    copies = placed.withColumn("slice", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array("own"))))
    found = copies.select("cell", "slice", "rep", "weight", "v", "home", (F.col("slice") == F.col("own")).alias("seeks")).groupBy("cell", "slice").applyInArrow(cell_links(cosine), "rep long, links long, root long")
    found = saved(found, "found")
    group = components(found.where("rep != root"), "rep", "root")
    counts = found.groupBy("rep").agg((F.sum("links") - 1).alias("n_links"))
    answer = classes.select("label", "h1", "h2", "rep").join(counts, "rep").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    answer = answer.select("label", "h1", "h2", "n_links", F.coalesce("component", "rep").alias("component"))
    known = rows.select("vec_id", "label", "h1", "h2").join(answer, ["label", "h1", "h2"]).select("vec_id", "n_links", "component")
    others = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v0"), F.col(label_col).alias("label"))
    v = F.col("v0")
    sound = F.coalesce(v.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    alone = others.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return known.unionByName(alone).select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))
