"""The SVM of ``linear`` on any number of rows: oversampling and Newton steps in the weights, over rows held in blocks.

``linear`` needs the product of every two rows. Here a row is met only by those of its class that may be among its
nearest, and a step reads only the rows that its class still has inside the margin.
"""

from __future__ import annotations

import numpy as np

from plainsight.ml.linear import Mix, Rows

#: Rows of a block; of a tile of products, the rows that ask and the rows that are asked; columns multiplied densely.
BLOCK, ASK, TILE, DENSE = 500, 1_024, 2_048, 1_000
#: Groups of equal numbers of no more rows ask together.
SMALL = 100
#: Rows and columns whose products scale the steps.
SEEN, HEAD = 6_000, 800


def packed(rows: Rows, width: int) -> Rows:
    """In six bytes a value, where the width allows."""
    return Rows(rows.at, rows.idx.astype(np.uint16 if width < 1 << 16 else np.int32), rows.val.astype(np.float32))


class Blocks:
    """Sparse rows in order of arrival, in blocks."""

    def __init__(self, parts: list[Rows], width: int):
        self.parts, self.width = parts, width
        self.ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.ends[-1])

    def take(self, which: np.ndarray) -> Blocks:
        """Rows ``which``, ascending."""
        cuts = np.searchsorted(which, self.ends)
        return Blocks([p.take(which[lo:hi] - at) for p, at, lo, hi in zip(self.parts, self.ends, cuts, cuts[1:]) if hi > lo], self.width)

    def whole(self) -> Rows:
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.at) for p in self.parts]))])
        return Rows(at, np.concatenate([p.idx for p in self.parts]), np.concatenate([p.val for p in self.parts]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Rows times ``w``, whose last value is the intercept."""
        out, w32 = np.full(len(self), w[-1]), w.astype(np.float32)
        for p, lo in zip(self.parts, self.ends):
            full = np.flatnonzero(np.diff(p.at))
            if len(full):
                out[lo + full] += np.add.reduceat(w32.take(p.idx, mode="clip") * p.val, p.at[full])
        return out

    def back(self, r: np.ndarray, squared: bool = False) -> np.ndarray:
        """The rows (or the squares of their values) summed with weights ``r``."""
        out, r32 = np.zeros(self.width + 1), r.astype(np.float32)
        for p, lo in zip(self.parts, self.ends):
            each = np.repeat(r32[lo : lo + len(p)], np.diff(p.at)) * p.val
            out[:-1] += np.bincount(p.idx, each * p.val if squared else each, self.width)
        out[-1] = r.sum()
        return out

    def head(self, columns: int) -> np.ndarray:
        """The columns that most rows have."""
        used = sum((np.bincount(p.idx, minlength=self.width) for p in self.parts), np.zeros(self.width, np.int64))
        return np.argsort(-used, kind="stable")[:columns]


# --- oversampling --------------------------------------------------------------------------------------------------


def nearest(rows: Rows, numbers: int, k: int = 5) -> np.ndarray:
    """The k nearest other rows of every row, exactly, nearest first, ties by place. Each row ends with ``numbers`` values.

    Rows of equal numbers form groups. The distance of two groups' numbers bounds that of their rows, so a row asks the
    groups from the nearest on, until none can hold a nearer row than those it has.
    """
    n = len(rows)
    k = min(k, n - 1)
    ends = rows.at[1:]
    values = rows.val[ends[:, None] - numbers + np.arange(numbers)].astype(np.float64) if numbers else np.zeros((n, 1))
    centres, group = np.unique(values, axis=0, return_inverse=True)
    group = group.ravel()
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
    text = np.ones(len(rows.idx), bool)
    if numbers:
        text[(ends[:, None] - numbers + np.arange(numbers)).ravel()] = False
    of = np.repeat(np.arange(n), np.diff(rows.at))
    length = np.bincount(of[text], rows.val[text].astype(np.float64) ** 2, n)
    used = np.bincount(rows.idx[text]) if text.any() else np.zeros(1, np.int64)
    columns = len(used)
    top = np.argsort(-used, kind="stable")[:DENSE]
    spot = np.full(columns, -1)
    spot[top] = np.arange(len(top))
    # entries of the most used columns, and all others
    places = spot[np.where(text, rows.idx, 0)]
    common, rare = text & (places >= 0), text & (places < 0)
    halves = []
    for on, idx in ((common, places), (rare, rows.idx)):
        halves.append(Rows(np.concatenate([[0], np.cumsum(np.bincount(of[on], minlength=n))]), idx[on].astype(np.int64), rows.val[on].astype(np.float32)))
    common, rare = halves
    del of, places, text
    shift = n.bit_length()
    best = np.full((n, k), np.iinfo(np.int64).max)  # distance in units of 1e-5, then place

    def dense(which: np.ndarray) -> np.ndarray:
        part = common.take(which)
        out = np.zeros((len(which), len(top)), np.float32)
        out[np.repeat(np.arange(len(which)), np.diff(part.at)), part.idx] = part.val
        return out

    def meet(asks: np.ndarray, h: np.ndarray) -> None:
        other, mine = dense(h), rare.take(h)
        by = np.argsort(mine.idx, kind="stable")
        row_of, value = np.repeat(np.arange(len(h)), np.diff(mine.at))[by], mine.val[by]
        first = np.concatenate([[0], np.cumsum(np.bincount(mine.idx, minlength=columns))])
        for lo in range(0, len(asks), ASK):
            q = asks[lo : lo + ASK]
            products = (dense(q) @ other.T).astype(np.float64)
            own = rare.take(q)
            start, size = first[own.idx], first[own.idx + 1] - first[own.idx]
            if total := int(size.sum()):
                at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
                cell = np.repeat(np.repeat(np.arange(len(q)), np.diff(own.at)) * len(h), size) + row_of[at]
                products += np.bincount(cell, np.repeat(own.val, size) * value[at], products.size).reshape(products.shape)
            a, b = centres[group[q]], centres[group[h]]
            apart = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0.0)
            apart += length[q][:, None] + length[h] - 2 * products
            key = (np.rint(np.clip(apart * 1e5, 0.0, float(1 << (62 - shift)))).astype(np.int64) << shift) + h
            key[q[:, None] == h] = np.iinfo(np.int64).max
            if len(h) > k:
                key = np.partition(key, k - 1, axis=1)[:, :k]
            best[q] = np.sort(np.concatenate([best[q], key], axis=1), axis=1)[:, :k]

    def reach(which: np.ndarray) -> np.ndarray:
        return (best[which, -1] >> shift) / 1e5

    small = np.flatnonzero(np.bincount(group) <= SMALL)
    if k > 0 and len(small):
        asks = np.sort(np.concatenate([members[g] for g in small]))
        for lo in range(0, n, TILE):
            meet(asks, np.arange(lo, min(n, lo + TILE)))
    for g in range(len(centres)) if k > 0 else ():
        if len(members[g]) <= SMALL:
            continue
        away = ((centres - centres[g]) ** 2).sum(1)
        away[g] = -1.0
        order, at = np.argsort(away, kind="stable"), 0
        while at < len(order):
            asks = members[g][reach(members[g]) + 1e-4 >= away[order[at]]]
            if not len(asks):
                break
            furthest, upto, held = reach(asks).max() + 1e-4, at, 0
            while upto < len(order) and held < TILE and (upto == at or away[order[upto]] <= furthest):
                held += len(members[order[upto]])
                upto += 1
                if at == 0:
                    break  # its own group first
            h = np.sort(np.concatenate([members[x] for x in order[at:upto]]))
            for lo in range(0, len(h), TILE):
                meet(asks, h[lo : lo + TILE])
            at = upto
    return best & ((1 << shift) - 1)


def oversampled_mix(rows: Blocks, y: np.ndarray, numbers: int, k: int = 5, seed: int = 42) -> tuple[Mix, np.ndarray]:
    """``linear.oversampled_mix`` with the same draws, of any number of rows."""
    rng = np.random.default_rng(seed)
    classes, count = np.unique(y, return_counts=True)
    parts = [(np.arange(len(y)), np.arange(len(y)), np.zeros(len(y)), y)]
    for c, n in zip(classes, count):
        need = count.max() - n
        if not need:
            continue
        mine = np.flatnonzero(y == c)
        near = nearest(rows.take(mine).whole(), numbers, k)
        base, u = rng.integers(0, n, need), rng.random(need)
        other = near[base, rng.integers(0, near.shape[1], need)] if n > 1 else base
        parts.append((mine[base], mine[other], u, np.full(need, c, y.dtype)))
    base, other, u, label = (np.concatenate(x) for x in zip(*parts))
    return Mix(base.astype(np.int32), other.astype(np.int32), u.astype(np.float32)), label


# --- the solver ----------------------------------------------------------------------------------------------------


def _spread(mix: Mix, m: np.ndarray) -> np.ndarray:
    return m[mix.base] + mix.u * (m[mix.other] - m[mix.base])


def _gathered(mix: Mix, r: np.ndarray, n: int) -> np.ndarray:
    far = mix.u * r
    return np.bincount(mix.base, r - far, n) + np.bincount(mix.other, far, n)


class Bend:
    """Newton's matrix by ``head`` columns of some rows, by its diagonal elsewhere: it scales the steps, so it decides their number only."""

    def __init__(self, rows: Blocks, by_row: np.ndarray, head: np.ndarray):
        self.scale, self.head = 1.0 / (1.0 + rows.back(by_row, squared=True)), np.append(head, rows.width)
        some = np.unique(np.linspace(0, len(rows) - 1, min(len(rows), SEEN)).astype(np.int64))
        part, each = rows.take(some).whole(), by_row[some] * (by_row.sum() / max(by_row[some].sum(), 1e-12))
        spot = np.full(rows.width, -1)
        spot[head] = np.arange(len(head))
        at, of = spot[part.idx], np.repeat(np.arange(len(some)), np.diff(part.at))
        dense = np.zeros((len(some), len(head) + 1), np.float32)
        dense[of[at >= 0], at[at >= 0]] = part.val[at >= 0]
        dense[:, -1] = 1.0
        self.inverse = np.linalg.inv(np.eye(len(head) + 1) + ((dense * each[:, None].astype(np.float32)).T @ dense).astype(np.float64))

    def of(self, r: np.ndarray) -> np.ndarray:
        out = self.scale * r
        out[self.head] = self.inverse @ r[self.head]
        return out


def _solved(rows: Blocks, mix: Mix, sign: np.ndarray, cost: np.ndarray, w: np.ndarray, head: np.ndarray, tol: float, steps: int) -> np.ndarray:
    """Weights of one class, from ``w`` on, until the gradient is ``tol`` of that of no weights."""
    n = len(rows)
    enough = tol * np.linalg.norm(rows.back(_gathered(mix, 2 * cost * sign, n)))
    m = _spread(mix, rows.dot(w)) if w.any() else np.zeros(len(sign))
    for _ in range(steps):
        on = np.flatnonzero(sign * m < 1)
        some = Mix(mix.base[on], mix.other[on], mix.u[on])
        touched = np.zeros(n, bool)
        touched[some.base] = touched[some.other] = True
        which = np.flatnonzero(touched)
        part = rows.take(which) if len(which) < 0.45 * n else rows
        if part is not rows:
            place = np.cumsum(touched) - 1
            some = Mix(place[some.base], place[some.other], some.u)
        bend = 2 * cost[on]
        slope = w + part.back(_gathered(some, bend * (m[on] - sign[on]), len(part)))
        size = np.linalg.norm(slope)
        if size <= enough:
            break
        # conjugate gradients for the Newton step, no further than the last one needs
        scale = Bend(part, _gathered(some, bend, len(part)), head if len(part) > 2 * SEEN else head[:100])
        step, rest = np.zeros_like(w), -slope
        way = scale.of(rest)
        rr, goal = rest @ way, max(0.25 * size, 0.5 * enough)
        for _ in range(50):
            bent = way + part.back(_gathered(some, bend * _spread(some, part.dot(way)), len(part)))
            move = rr / (way @ bent)
            step += move * way
            rest -= move * bent
            if np.linalg.norm(rest) <= goal:
                break
            scaled = scale.of(rest)
            new = rest @ scaled
            way = scaled + new / rr * way
            rr = new
        dm, t = _spread(mix, rows.dot(step)), 1.0

        def loss(t: float) -> float:
            gap = np.maximum(1 - sign * (m + t * dm), 0)
            return 0.5 * ((w + t * step) ** 2).sum() + (cost * gap * gap).sum()

        value = loss(0.0)
        while t > 1e-9 and loss(t) > value + 1e-9 * abs(value):
            t /= 2
        if t <= 1e-9:
            break
        w, m = w + t * step, m + t * dm
    return w


def _begun(rows: Blocks, mix: Mix, sign: np.ndarray, cost: np.ndarray, head: np.ndarray, tol: float, steps: int, every: int = 4) -> np.ndarray:
    """Weights to begin with: those of every fourth row, which count for four and begin likewise."""
    if len(sign) < every * SEEN:
        return np.zeros(rows.width + 1)
    on = np.arange(0, len(sign), every)
    touched = np.zeros(len(rows), bool)
    touched[mix.base[on]] = touched[mix.other[on]] = True
    place = np.cumsum(touched) - 1
    few, some, own = rows.take(np.flatnonzero(touched)), Mix(place[mix.base[on]], place[mix.other[on]], mix.u[on]), (sign[on], every * cost[on])
    return _solved(few, some, *own, _begun(few, some, *own, head, tol, steps), head, 10 * tol, steps)


def svm_weights(rows: Blocks, mix: Mix, y: np.ndarray, classes: int, costs: list[float], weight: np.ndarray | None = None, tol: float = 1e-3, steps: int = 100) -> list[np.ndarray]:
    """Weights (width + 1 by classes; the last row is the intercept) for each of ``costs``; ``weight`` multiplies them by class.

    A cost begins where the one below it ended; that decides its time only.
    """
    by_row = np.ones(len(y)) if weight is None else weight[y]
    found, head = {c: np.zeros((rows.width + 1, classes)) for c in costs}, rows.head(HEAD)
    for k in range(classes):
        sign, w = np.where(y == k, 1.0, -1.0), None
        for c in sorted(found):
            w = _begun(rows, mix, sign, c * by_row, head, tol, steps) if w is None else w
            found[c][:, k] = w = _solved(rows, mix, sign, c * by_row, w, head, tol, steps)
    return [found[c] for c in costs]
