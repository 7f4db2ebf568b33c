"""Selection algorithms of one pool, in numpy, from the published descriptions.

Each takes chances (in the pool's order) and a random generator and returns hits. Units
of chance 0 or 1 are settled beforehand by :func:`select_pool`.
"""

from __future__ import annotations

import numpy as np

from ..errors import SelectionError

TOL = 1e-9
#: Balancing columns up to which a flight is done in plain numbers.
FEW = 6


def brewer(pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draw by draw (Brewer's general method, Tillé 2006)."""
    n, left = int(round(pi.sum())), pi.astype(float).copy()
    hits = np.zeros(len(pi), int)
    for step in range(n, 0, -1):
        total = left.sum()
        weight = np.where(hits > 0, 0.0, left * np.maximum(total - left, 0) / np.maximum(total - left * step, TOL))
        if weight.sum() <= 0:
            weight = np.where(hits > 0, 0.0, left)
        i = int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), "right").clip(0, len(pi) - 1))
        hits[i], left[i] = 1, 0.0
    return hits


def subset_sums(odds: np.ndarray, n: int) -> np.ndarray:
    """Row i: scaled elementary symmetric sums of the odds from i on, orders 0..n."""
    table = np.zeros((len(odds) + 1, n + 1))
    table[-1, 0] = 1
    for i in range(len(odds) - 1, -1, -1):
        table[i] = table[i + 1]
        table[i, 1:] += odds[i] * table[i + 1, :-1]
        table[i] /= table[i].max()
    return table


def poisson_binomial_inclusion(odds: np.ndarray, n: int) -> np.ndarray:
    """Inclusion chances of conditional Poisson sampling with these odds."""
    psi = np.zeros(len(odds))
    for k in range(1, n + 1):
        term = odds * (1 - psi)
        psi = k * term / term.sum()
    return psi


def cps_odds(pi: np.ndarray, n: int) -> np.ndarray:
    """Odds whose conditional Poisson chances are ``pi`` (Chen, Dempster and Liu 1994)."""
    goal = pi / (1 - pi)
    odds = goal.copy()
    for _ in range(500):
        psi = np.clip(poisson_binomial_inclusion(odds, n), TOL, 1 - TOL)
        new = odds * goal / (psi / (1 - psi))
        new *= goal.sum() / new.sum()
        if np.abs(psi - pi).max() < 1e-10:
            break
        odds = new
    return odds


def cps(pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Maximum entropy at fixed size: one pass, each unit by its conditional chance."""
    n = int(round(pi.sum()))
    odds = cps_odds(pi, n)
    # chances of a place among the rest: sums without scaling cancel within a row
    table = np.zeros((len(pi) + 1, n + 1))
    table[-1, 0] = 1
    scale = np.zeros(len(pi) + 1)
    for i in range(len(pi) - 1, -1, -1):
        row = table[i + 1].copy()
        row[1:] += odds[i] * table[i + 1, :-1]
        top = row.max()
        table[i], scale[i] = row / top, np.log(top)
    hits, need = np.zeros(len(pi), int), n
    for i in range(len(pi)):
        if not need:
            break
        take = odds[i] * table[i + 1, need - 1]
        chance = take / (take + table[i + 1, need]) if take > 0 else 0.0
        if rng.random() < chance:
            hits[i] = 1
            need -= 1
    return hits


def sampford(pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """First draw by size, the others by odds, all with replacement; kept when distinct
    (Sampford 1967). Where that hardly ever happens, conditional Poisson sampling with
    the odds takes the other draws at once from the same law."""
    n = int(round(pi.sum()))
    odds = pi / (1 - pi)
    first, rest = np.cumsum(pi) / pi.sum(), np.cumsum(odds) / odds.sum()
    for _ in range(2000):
        picks = np.concatenate([np.searchsorted(first, rng.random(1), "right"), np.searchsorted(rest, rng.random(n - 1), "right")]).clip(0, len(pi) - 1)
        if len(np.unique(picks)) == n:
            hits = np.zeros(len(pi), int)
            hits[picks] = 1
            return hits
    # a sample s has law ~ prod odds * sum over s of (1 - pi): conditional Poisson with
    # the odds, accepted in proportion to that sum, which is n - sum of pi at most n
    while True:
        hits = conditional_draw(odds, n, rng)
        if rng.random() * n < (1 - pi)[hits > 0].sum():
            return hits


def conditional_draw(odds: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    table = np.zeros((len(odds) + 1, n + 1))
    table[-1, 0] = 1
    for i in range(len(odds) - 1, -1, -1):
        table[i] = table[i + 1]
        table[i, 1:] += odds[i] * table[i + 1, :-1]
        table[i] /= table[i].max()
    hits, need = np.zeros(len(odds), int), n
    for i in range(len(odds)):
        if need and rng.random() * (odds[i] * table[i + 1, need - 1] + table[i + 1, need]) < odds[i] * table[i + 1, need - 1]:
            hits[i] = 1
            need -= 1
    return hits


def chromy(expected: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sequential, each unit floor(E) or floor(E) + 1 hits (Chromy 1979): from a random
    start around the circle, the fractional parts of the running sum decide."""
    n, size = int(round(expected.sum())), len(expected)
    start = int(np.searchsorted(np.cumsum(expected), rng.random() * expected.sum(), "right").clip(0, size - 1))
    order = np.r_[start:size, 0:start]
    running, before = np.cumsum(expected[order]), 0.0
    hits, got = np.zeros(size, int), 0
    for k, i in enumerate(order):
        now = running[k] if k < size - 1 else float(n)
        whole, part = split(now)
        ahead, part_before = got > split(before)[0], split(before)[1]
        target = whole + int(rng.random() < one_ahead(ahead, part, part_before))
        hits[i] = target - got
        got = target
        before = now
    return hits


def split(x: float) -> tuple[int, float]:
    whole = int(np.floor(x + TOL))
    return whole, max(x - whole, 0.0)


def one_ahead(ahead: bool, part: float, part_before: float) -> float:
    """Chance to stand one hit above the whole part of the running sum, given whether
    that was so before and both fractional parts."""
    if part <= TOL:
        return 0.0
    if ahead:
        return 1.0 if part >= part_before else part / part_before
    return (part - part_before) / (1 - part_before) if part > part_before else 0.0


def flight(pi: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase of the cube method (Deville and Tillé 2004; fast form): among p + 1
    open units, move along a null vector of their balancing columns to a face."""
    x, p = pi.astype(float).copy(), balance.shape[1]
    if p <= FEW:
        return short_flight(x, balance, rng)
    waiting = np.flatnonzero((x > TOL) & (x < 1 - TOL)).tolist()[::-1]
    block: list[int] = []
    while True:
        while waiting and len(block) <= p:
            block.append(waiting.pop())
        if not block:
            break
        a = balance[block]
        if len(block) <= p and np.linalg.matrix_rank(a) >= len(block):
            break
        vector = np.linalg.svd(a.T)[2][-1]
        moving = np.abs(vector) > TOL
        if not moving.any() or np.abs(a.T @ vector).max() > 1e-7 * max(1.0, np.abs(a).max()):
            break
        at, v = x[block][moving], vector[moving]
        up, down = (np.where(sign * v > 0, (1 - at) / np.abs(v), at / np.abs(v)).min() for sign in (1, -1))
        move = up if rng.random() * (up + down) < down else -down
        new = np.clip(x[block] + move * vector, 0.0, 1.0)
        new = np.where((new < TOL) | (new > 1 - TOL), np.round(new), new)
        x[block] = new
        block = [i for i, y in zip(block, new.tolist(), strict=True) if 0 < y < 1]
    return x


def null_vector(rows: list[list[float]], p: int) -> list[float] | None:
    """Weights of some of these rows of ``p`` columns that sum to 0 in each column, by
    elimination: of the first row that those before it give, and of these. None when no
    row is given by others."""
    m = [[row[c] for row in rows] for c in range(p)]
    pivots: list[int] = []
    for k in range(len(rows)):
        done = len(pivots)
        best = max(range(done, p), key=lambda c: abs(m[c][k]), default=None)
        if best is None or abs(m[best][k]) < 1e-11:
            vector = [0.0] * len(rows)
            vector[k] = 1.0
            for c, at in enumerate(pivots):
                vector[at] = -m[c][k]
            most = max(map(abs, vector))
            return [v / most for v in vector]
        m[done], m[best] = m[best], m[done]
        top = m[done]
        by = top[k]
        top[k:] = [v / by for v in top[k:]]
        for c in range(p):
            if c != done and (by := m[c][k]):
                m[c][k:] = [v - by * t for v, t in zip(m[c][k:], top[k:], strict=True)]
        pivots.append(k)
    return None


def short_flight(x: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight with few columns, where numbers in lists are faster than small arrays."""
    p = balance.shape[1]
    block: list[tuple[int, float, list[float]]] = []
    waiting = np.flatnonzero((x > TOL) & (x < 1 - TOL)).tolist()[::-1]
    values, rows = x.tolist(), balance.tolist()
    while True:
        while waiting and len(block) <= p:
            i = waiting.pop()
            block.append((i, values[i], rows[i]))
        vector = null_vector([b[2] for b in block], p) if block else None
        if vector is None:
            break
        up = down = np.inf
        for (_, at, _), v in zip(block, vector, strict=True):
            if abs(v) > TOL:
                more, less = ((1 - at) / v, at / v) if v > 0 else (at / -v, (1 - at) / -v)
                up, down = min(up, more), min(down, less)
        move = up if rng.random() * (up + down) < down else -down
        kept = []
        for (i, at, row), v in zip(block, vector, strict=True):
            at += move * v
            if TOL <= at <= 1 - TOL:
                kept.append((i, at, row))
            else:
                values[i] = float(round(at))
        block = kept
    for i, at, _ in block:
        values[i] = at
    return np.array(values)


def part_flight(x: np.ndarray, columns: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A flight of some units of a pool, without the columns that are 0 here or the same
    as others."""
    scaled = columns / np.where(np.abs(columns).max(0) > 0, np.abs(columns).max(0), 1)
    scaled = scaled[:, np.abs(scaled).max(0) > 0]
    first = np.sort(np.unique(scaled, axis=1, return_index=True)[1])
    return flight(x, scaled[:, first], rng)


def whole_bounds(hard: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers below and above the expected counts of 0/1 columns; ``pi`` may
    come from flights, each of which rounds."""
    expected = hard.T @ pi
    slack = 1e-8 * (1 + np.abs(expected))
    return np.floor(expected + slack), np.ceil(expected - slack)


def settle(x: np.ndarray, hard: np.ndarray, lower: np.ndarray, upper: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settle the open units with ``lower <= hard' x <= upper`` kept: walk on along null
    vectors of the constraints that are tight, until a unit closes or another constraint
    is tight. Chances are kept. With at most two crossed sets of levels every corner is
    whole (a transport problem); with more, units may stay open."""
    x, near = x.copy(), 1e-7
    open_ = rng.permutation(np.flatnonzero((x > TOL) & (x < 1 - TOL)))
    counts = hard.T @ x
    tight = (counts - lower < near) | (upper - counts < near)
    size = 2
    while len(open_):
        block = open_[:size]
        a = hard[block][:, tight].T
        a = a[np.abs(a).any(1)]
        _, values, vectors = np.linalg.svd(a) if len(a) else (None, np.zeros(0), np.eye(len(block)))
        if (values > near).sum() >= len(block):
            if len(block) == len(open_):
                break
            size *= 2
            continue
        vector = np.where(np.abs(vectors[-1]) > near, vectors[-1], 0.0)
        change = np.where(tight, 0.0, hard[block].T @ vector)
        moves = []
        for v, c in ((vector, change), (-vector, -change)):
            units, more, less = v != 0, c > near, c < -near
            room = np.where(v > 0, 1 - x[block], x[block])[units] / np.abs(v[units])
            moves.append(min(np.concatenate([room, (upper - counts)[more] / c[more], (counts - lower)[less] / -c[less]])))
        up, down = moves
        move = up if rng.random() * (up + down) < down else -down
        new = np.clip(x[block] + move * vector, 0.0, 1.0)
        x[block] = np.where((new < near) | (new > 1 - near), np.round(new), new)
        counts = hard.T @ x
        tight |= (counts - lower < near) | (upper - counts < near)
        open_ = open_[(x[open_] > 0) & (x[open_] < 1)]
        size = 2
    return x


def cube(pi: np.ndarray, columns: np.ndarray, rng: np.random.Generator, fixed: int = 1) -> np.ndarray:
    """Cube method: ``columns`` are balanced, the first ``fixed`` of them, 0/1 columns of
    size, strata and bounded levels, to the end. The landing drops the last balancing
    columns one by one; then counts stay between the whole numbers around those expected,
    or the draw is refused."""
    scaled = columns / np.where(np.abs(columns).max(0) > 0, np.abs(columns).max(0), 1)
    x = pi.astype(float)
    for p in range(scaled.shape[1], fixed - 1, -1):
        x = flight(x, scaled[:, :p], rng)
        if not ((x > TOL) & (x < 1 - TOL)).any():
            break
    hard = columns[:, :fixed]
    lower, upper = whole_bounds(hard, pi)
    x = settle(x, hard, lower, upper, rng)
    hits = np.round(x).astype(int)
    counts = hard.T @ hits
    if np.abs(x - hits).max(initial=0) > 1e-6 or (counts < lower).any() or (counts > upper).any():
        raise SelectionError("counts that are bounded or fixed could not all be met by a cube draw; use fewer bound() columns")
    return hits


def pivot(x: np.ndarray, i: int, j: int, rng: np.random.Generator) -> None:
    """One step of the pivotal method on two open units."""
    a, b = x[i], x[j]
    if a + b < 1:
        keep = rng.random() * (a + b) < b
        x[i], x[j] = (0.0, a + b) if keep else (a + b, 0.0)
    else:
        keep = rng.random() * (2 - a - b) < 1 - b
        x[i], x[j] = (1.0, a + b - 1) if keep else (a + b - 1, 1.0)
    for k in (i, j):
        if x[k] < TOL or x[k] > 1 - TOL:
            x[k] = round(x[k])


class Cells:
    """Open units by place: cells of a kd-tree, all with the same number of slots, with
    their boxes. ``value`` (0: closed or no unit) is to be multiplied by the cell's
    ``times``, so that a whole cell changes at once."""

    def __init__(self, ids: np.ndarray, value: np.ndarray, spots: np.ndarray, slots: int):
        parts = [ids]
        while max(map(len, parts)) > slots:
            parts = [half for part in parts for half in self.halves(part, spots)]
        width = max(map(len, parts))
        self.ids = np.full((len(parts), width), -1)
        for row, part in zip(self.ids, parts, strict=True):
            row[: len(part)] = part
        there = self.ids >= 0
        self.value = np.where(there, value[self.ids], 0.0)
        self.places = [np.where(there, spots[self.ids, k], np.nan) for k in range(spots.shape[1])]
        self.low = np.stack([np.nanmin(place, 1) for place in self.places])
        self.high = np.stack([np.nanmax(place, 1) for place in self.places])
        self.times = np.ones(len(parts))
        self.total, self.most, self.count = self.value.sum(1), self.value.max(1), there.sum(1)
        self.built = len(ids)
        self.cell, self.slot = np.full(len(value), -1), np.full(len(value), -1)
        self.cell[self.ids[there]], self.slot[self.ids[there]] = np.nonzero(there)

    @staticmethod
    def halves(part: np.ndarray, spots: np.ndarray) -> list[np.ndarray]:
        if len(part) < 2:
            return [part]
        widest = spots[part]
        column = widest[:, np.ptp(widest, 0).argmax()]
        cut = np.argpartition(column, len(part) // 2)
        return [part[cut[: len(part) // 2]], part[cut[len(part) // 2 :]]]

    def open_ids(self) -> np.ndarray:
        return self.ids[self.value * self.times[:, None] > 0]

    def values(self, rows: np.ndarray) -> np.ndarray:
        return self.value[rows] * self.times[rows, None]

    def of(self, i: int) -> float:
        c = self.cell[i]
        return float(self.value[c, self.slot[i]] * self.times[c])

    def close(self, i: int) -> None:
        c = self.cell[i]
        self.total[c] -= self.of(i)
        self.value[c, self.slot[i]] = 0.0
        self.count[c] -= 1
        if not self.count[c]:
            self.total[c] = self.most[c] = 0.0

    def set_rows(self, rows: np.ndarray, values: np.ndarray) -> None:
        self.value[rows], self.times[rows] = values, 1.0
        self.total[rows], self.most[rows], self.count[rows] = values.sum(1), values.max(1), np.count_nonzero(values, 1)

    def nearest_and_farthest(self, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances from a spot to the nearest and farthest points of the boxes."""
        below, above = self.low - spot[:, None], spot[:, None] - self.high
        near, far = np.maximum(np.maximum(below, above), 0.0), np.minimum(below, above)
        return (near * near).sum(0), (far * far).sum(0)

    def gaps(self, rows: np.ndarray, spot: np.ndarray) -> np.ndarray:
        gap = 0.0
        for place, at in zip(self.places, spot.tolist(), strict=True):
            gap = gap + (place[rows] - at) ** 2
        return gap


def lpm2(pi: np.ndarray, spots: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Local pivotal method 2: a random open unit against its nearest open neighbour."""
    x, spots = pi.astype(float).copy(), np.asarray(spots, float)
    open_ = np.flatnonzero((x > TOL) & (x < 1 - TOL))
    place, left, cells = np.zeros(len(x), int), 0, None
    slack = 1 + 1e-12
    while True:
        if cells is None or left * 2 < cells.built:
            open_ = open_ if cells is None else open_[:left].copy()
            left = len(open_)
            if left < 2:
                break
            place[open_] = np.arange(left)
            # the value only says that a unit is open
            cells = Cells(open_, np.ones(len(x)), spots, int(np.clip(np.sqrt(left) / 2, 32, 512)))
        if left < 2:
            break
        i = int(open_[rng.integers(left)])
        spot, own = spots[i], cells.cell[i]
        nearest, farthest = cells.nearest_and_farthest(spot)
        live = cells.count > 0
        if cells.count[own] > 1:
            gap = cells.gaps(own, spot)
            gap[cells.value[own] == 0] = np.inf
            gap[cells.slot[i]] = np.inf
            reach = gap.min()
        else:
            live[own] = False
            reach = farthest[live].min()
        rows = np.flatnonzero(live & (nearest <= reach * slack))
        gap = cells.gaps(rows, spot)
        ids = cells.ids[rows]
        gap[(cells.value[rows] == 0) | (ids == i)] = np.inf
        near = ids[gap <= gap.min() * slack]
        j = int(near[rng.integers(len(near))])
        pivot(x, i, j, rng)
        for k in (i, j):
            if not TOL < x[k] < 1 - TOL:
                cells.close(k)
                left -= 1
                last = open_[left]
                open_[place[k]], place[last] = last, place[k]
    for i in open_[:left]:
        x[i] = float(rng.random() < x[i])
    return np.round(x).astype(int)


def scps(pi: np.ndarray, spots: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Spatially correlated Poisson sampling: each decision is made good for the nearest
    undecided units, with the largest weights that keep their chances in 0..1.

    Where no chance is so large that it would pass 1, these weights are proportional to
    the chances: a cell that lies within reach as a whole changes by one factor, and only
    the cells at the border of the reach are gone through unit by unit."""
    x, spots = pi.astype(float).copy(), np.asarray(spots, float)
    hits = np.where(x >= 1 - TOL, 1, 0)
    open_ = np.flatnonzero((x > TOL) & (x < 1 - TOL))
    cells, left = None, len(open_)
    for step, i in enumerate(rng.permutation(open_)):
        if cells is None or (step % 64 == 0 and int(cells.count.sum()) * 2 < cells.built):
            if cells is not None:
                open_ = cells.open_ids()
                x[open_] = (cells.value * cells.times[:, None])[cells.cell[open_], cells.slot[open_]]
            left = len(open_)
            if not left:
                break
            slots = int(np.clip((left * max(x[open_].sum(), 1.0) / 10) ** (1 / 3), 16, 512))
            cells = Cells(open_, x, spots, slots)
        if cells.cell[i] < 0 or (before := cells.of(i)) <= 0:
            continue  # settled by an earlier decision
        cells.close(i)
        taken = rng.random() < before
        hits[i] = int(taken)
        change = float(taken) - before
        nearest, farthest = cells.nearest_and_farthest(spots[i])
        full = cells.total / (1 - before)
        regular = cells.most < 1 - before - 10 * TOL
        if regular.all():
            most = least = full
        else:
            most, least = np.where(regular, full, np.minimum(full, (cells.count - cells.total) / before)), np.where(regular, full, 0.0)
        by = nearest.argsort(kind="stable")
        k = int(np.cumsum(most[by]).searchsorted(1 - TOL))
        inner_reach = nearest[by[k]] if k < len(by) else np.inf
        by = farthest.argsort(kind="stable")
        k = int(np.cumsum(least[by]).searchsorted(1 + TOL))
        reach = farthest[by[k]] if k < len(by) else np.inf
        inner = regular & (farthest < inner_reach)
        rows = np.flatnonzero((nearest <= reach) & ~inner & (cells.count > 0))
        weight = 1 - full[inner].sum()
        if len(rows):
            values = cells.values(rows)
            there = np.flatnonzero(values.ravel() > 0)
            flat = values.ravel()[there]
            w = np.minimum(flat / (1 - before), (1 - flat) / before)
            by = cells.gaps(rows, spots[i]).ravel()[there].argsort(kind="stable")
            sums = np.cumsum(w[by])
            k = int(sums.searchsorted(weight))
            if k < len(by):
                w[by[k]] -= sums[k] - weight
                w[by[k + 1 :]] = 0.0
            flat = flat - w * change
            settled = flat > 1 - TOL
            if settled.any():
                hits[cells.ids[rows].ravel()[there[settled]]] = 1
            flat[settled | (flat < TOL)] = 0.0
            values.ravel()[there] = flat
            cells.set_rows(rows, values)
        if taken:
            cells.times[inner] = cells.total[inner] = cells.most[inner] = 0.0
            cells.count[inner] = 0
        else:
            for figure in (cells.times, cells.total, cells.most):
                figure[inner] /= 1 - before
    return hits


def select_pool(name: str, pi: np.ndarray, rng: np.random.Generator, *, balance: np.ndarray | None = None, fixed: int = 1, spots: np.ndarray | None = None) -> np.ndarray:
    """Hits of a pool: settled units first, the algorithm for the open ones."""
    if name == "pps_chromy":
        return chromy(pi, rng) if len(pi) and pi.sum() > 0 else np.zeros(len(pi), int)
    hits = (pi >= 1 - TOL).astype(int)
    open_ = np.flatnonzero((pi > TOL) & (pi < 1 - TOL))
    if not len(open_):
        return hits
    part = pi[open_]
    if name in ("pps_brewer", "pps_cps", "pps_sampford"):
        hits[open_] = {"pps_brewer": brewer, "pps_cps": cps, "pps_sampford": sampford}[name](part, rng)
    elif name == "cube":
        hits[open_] = cube(part, balance[open_], rng, fixed)
    elif name == "lpm2":
        hits[open_] = lpm2(part, spots[open_], rng)
    elif name == "scps":
        hits[open_] = scps(part, spots[open_], rng)
    return hits
