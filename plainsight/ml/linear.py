"""One-against-rest linear SVM and oversampling on sparse rows, in numpy, for few training rows (``primal`` has them for any number).

The SVM has the squared hinge loss with a regularised intercept. It is solved by Newton steps whose systems go to
conjugate gradients, for all classes at once, in the span of the rows: weights are combinations of them, so every
product is one with the rows' Gram matrix (rows squared; the bound on the rows bounds it). Oversampled rows lie between
two rows, so they need no vectors of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: ``idx[at[i]:at[i + 1]]`` and ``val`` of row i, indices unique within a row."""

    at: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    @classmethod
    def of(cls, idx: list, val: list) -> Rows:
        at = np.concatenate([[0], np.cumsum([len(x) for x in idx])]).astype(np.int64)
        flat = np.concatenate([np.asarray(x, np.int64) for x in idx]) if len(idx) else np.empty(0, np.int64)
        return cls(at, flat, np.concatenate([np.asarray(x, np.float64) for x in val]) if len(val) else np.empty(0))

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, which: np.ndarray) -> Rows:
        n = np.diff(self.at)[which]
        at = np.concatenate([[0], np.cumsum(n)])
        spots = np.repeat(self.at[which] - at[:-1], n) + np.arange(at[-1])
        return Rows(at, self.idx[spots], self.val[spots])

    def dense(self) -> np.ndarray:
        """Over the indices that occur."""
        seen, place = np.unique(self.idx, return_inverse=True)
        out = np.zeros((len(self), len(seen)))
        out[np.repeat(np.arange(len(self)), np.diff(self.at)), place] = self.val
        return out

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Rows times ``weights`` (indices by classes), in blocks of bounded size."""
        out = np.zeros((len(self), weights.shape[1]))
        step = 2000
        for lo in range(0, len(self), step):
            hi = min(len(self), lo + step)
            a, b = self.at[lo], self.at[hi]
            full = np.flatnonzero(np.diff(self.at[lo : hi + 1])) + lo
            if b > a:
                out[full] = np.add.reduceat(weights[self.idx[a:b]] * self.val[a:b, None], self.at[full] - a)
        return out


#: Columns of most rows that the Gram matrix takes by one dense product.
_DENSE = 3000


def gram(rows: Rows) -> np.ndarray:
    """Products of all rows with each other, one added for the intercept: the most used columns densely, the others by their rows."""
    n = len(rows)
    of = np.repeat(np.arange(n), np.diff(rows.at))
    seen, place, used = np.unique(rows.idx, return_inverse=True, return_counts=True)
    top = np.argsort(-used, kind="stable")[:_DENSE]
    spot = np.full(len(seen), -1)
    spot[top] = np.arange(len(top))
    dense = np.zeros((n, len(top)), np.float32)
    hit = spot[place] >= 0
    dense[of[hit], spot[place][hit]] = rows.val[hit]
    out = dense @ dense.T
    out += 1.0
    rest = np.flatnonzero(~hit)
    order = rest[np.argsort(place[rest], kind="stable")]  # by column, then row
    column, row_of, value = place[order], of[order], rows.val[order]
    starts, ends = np.searchsorted(column, np.arange(len(seen))), np.searchsorted(column, np.arange(len(seen)), "right")
    cuts = np.searchsorted(of[rest], np.arange(n + 1))
    for i in range(n):
        mine = rest[cuts[i] : cuts[i + 1]]
        if len(mine):
            lo, size = starts[place[mine]], ends[place[mine]] - starts[place[mine]]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            out[i] += np.bincount(row_of[at], np.repeat(rows.val[mine], size) * value[at], n)
    return out


@dataclass
class Mix:
    """Rows that lie between two rows: (1 - u) of ``base`` and u of ``other``."""

    base: np.ndarray
    other: np.ndarray
    u: np.ndarray

    def of(self, v: np.ndarray) -> np.ndarray:
        return (1 - self.u)[:, None] * v[self.base] + self.u[:, None] * v[self.other]

    def back(self, r: np.ndarray, n: int) -> np.ndarray:
        out = np.empty((n, r.shape[1]))
        for c in range(r.shape[1]):
            out[:, c] = np.bincount(self.base, (1 - self.u) * r[:, c], n) + np.bincount(self.other, self.u * r[:, c], n)
        return out


def plain(n: int) -> Mix:
    return Mix(np.arange(n), np.arange(n), np.zeros(n))


def oversampled_mix(products: np.ndarray, y: np.ndarray, k: int = 5, seed: int = 42) -> tuple[Mix, np.ndarray]:
    """The rows, then new ones between a row and one of its k nearest of the same class, up to the largest class.

    A class of one row repeats it.
    """
    rng = np.random.default_rng(seed)
    classes, count = np.unique(y, return_counts=True)
    parts = [(np.arange(len(y)), np.arange(len(y)), np.zeros(len(y)), y)]
    for c, n in zip(classes, count):
        need = count.max() - n
        if not need:
            continue
        mine = np.flatnonzero(y == c)
        own = products[np.ix_(mine, mine)].astype(np.float64)
        length = np.diagonal(own)
        distance = np.round(length[:, None] + length[None, :] - 2 * own, 5)
        np.fill_diagonal(distance, np.inf)
        near = np.argsort(distance, axis=1, kind="stable")[:, : min(k, n - 1)]
        base, u = rng.integers(0, n, need), rng.random(need)
        other = near[base, rng.integers(0, near.shape[1], need)] if n > 1 else base
        parts.append((mine[base], mine[other], u, np.full(need, c, y.dtype)))
    base, other, u, label = (np.concatenate(x) for x in zip(*parts))
    return Mix(base, other, u), label


def linear_svm(products: np.ndarray, mix: Mix, y: np.ndarray, classes: int, c: float = 1.0, weight: np.ndarray | None = None, tol: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Coefficients of the rows by class. ``weight`` multiplies C by class."""
    return linear_svms(products, mix, y, classes, [c], weight, tol, steps)[0]


def linear_svms(products: np.ndarray, mix: Mix, y: np.ndarray, classes: int, costs: list[float], weight: np.ndarray | None = None, tol: float = 1e-3, steps: int = 100) -> list[np.ndarray]:
    """The same for each of ``costs``. All are solved side by side, as reading the products takes longest.

    A class ends when its gradient is ``tol`` of the first one, and is left out from then on.
    """
    n, many = len(products), classes * len(costs)
    signs = np.tile(np.where(y[:, None] == np.arange(classes), 1.0, -1.0), len(costs))
    each = np.repeat(np.asarray(costs, float), classes)[None, :]
    by_row = np.ones((len(y), 1)) if weight is None else weight[y][:, None]
    betas, kbs, ms = np.zeros((n, many)), np.zeros((n, many)), np.zeros((len(y), many))
    first, live = None, np.arange(many)

    def times(v: np.ndarray) -> np.ndarray:
        return (products @ v.astype(np.float32)).astype(np.float64)

    for _ in range(steps):
        sign, cost, beta, kb, m = signs[:, live], by_row * each[:, live], betas[:, live], kbs[:, live], ms[:, live]
        active = sign * m < 1
        slope = beta + mix.back(np.where(active, 2 * cost * (m - sign), 0.0), n)
        ks = times(slope)
        size = np.maximum((slope * ks).sum(0), 0.0)
        first = size if first is None else first
        on = size > tol * tol * first[live]
        if not on.any():
            break
        live, size, slope, ks, beta, kb = live[on], size[on], slope[:, on], ks[:, on], beta[:, on], kb[:, on]
        sign, cost, m, active = sign[:, on], cost[:, on], m[:, on], active[:, on]
        bend = np.where(active, 2 * cost, 0.0)

        def loss(beta, kb, m):
            gap = np.maximum(1 - sign * m, 0)
            return 0.5 * (beta * kb).sum(0) + (cost * gap * gap).sum(0)

        value = loss(beta, kb, m)
        # conjugate gradients for the Newton step, in the weights' inner product
        step, kstep = np.zeros_like(beta), np.zeros_like(beta)
        rest, krest = -slope, -ks
        way, kway, rr = rest.copy(), krest.copy(), size.copy()
        for _ in range(50):
            bent = way + mix.back(bend * mix.of(kway), n)
            kbent = times(bent)
            curve = (way * kbent).sum(0)
            move = np.where(curve > 0, rr / np.where(curve > 0, curve, 1.0), 0.0)
            step, kstep = step + move * way, kstep + move * kway
            rest, krest = rest - move * bent, krest - move * kbent
            new = np.maximum((rest * krest).sum(0), 0.0)
            if (new <= 0.01 * size).all():
                break
            turn = np.where(rr > 0, new / np.where(rr > 0, rr, 1.0), 0.0)
            way, kway, rr = rest + turn * way, krest + turn * kway, new
        dm, t = mix.of(kstep), np.ones(len(live))
        for _ in range(30):  # halve the step of classes that it makes worse
            worse = loss(beta + t * step, kb + t * kstep, m + t * dm) > value + 1e-9 * np.abs(value)
            if not worse.any():
                break
            t = np.where(worse, t / 2, t)
        else:
            t = np.where(worse, 0.0, t)
        if not t.any():
            break
        betas[:, live], kbs[:, live], ms[:, live] = beta + t * step, kb + t * kstep, m + t * dm
    return [betas[:, k * classes : (k + 1) * classes] for k in range(len(costs))]


def weights_of(rows: Rows, beta: np.ndarray, width: int) -> np.ndarray:
    """Weights (width + 1 by classes; the last row is the intercept) from coefficients of rows."""
    of = np.repeat(np.arange(len(rows)), np.diff(rows.at))
    w = np.empty((width + 1, beta.shape[1]))
    for c in range(beta.shape[1]):
        w[:-1, c] = np.bincount(rows.idx, rows.val * beta[of, c], width)
    w[-1] = beta.sum(0)
    return w


def margins(rows: Rows, w: np.ndarray) -> np.ndarray:
    return rows.dot(w[:-1]) + w[-1]
