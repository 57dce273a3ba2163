"""Agglomerative clustering: sequential kernels in numpy, one group per task.

A term describes clusters by additive statistics (one row each) and gives their losses; merged clusters add their
rows. What is merged next is always the pair whose weighted loss rises least, ties by the smaller indices. Groups of
more than DIRECT_LIMIT instances are flattened first, so a kernel sees a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

#: Largest group that is agglomerated directly, flat clusters otherwise and trials to find them, deepest tree kept.
DIRECT_LIMIT, FLAT_CLUSTERS, TRIALS, MAX_DEPTH = 100, 100, 5, 50
#: A loop until a threshold that takes more steps is an error.
MAX_STEPS = 1000


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0)), 0.0)


@dataclass
class Term:
    """Additive statistics `rows` (a row per cluster) and their loss, per row."""

    rows: np.ndarray
    loss: Callable[[np.ndarray], np.ndarray]
    weight: float = 1.0


def min_entropy(counts: np.ndarray, weight: float = 1.0) -> Term:
    """total * ln(total) - sum(c * ln(c)), for sparse counts as a matrix or for dense distributions."""
    return Term(np.asarray(counts, float), lambda m: xlogx(m.sum(axis=-1)) - xlogx(m).sum(axis=-1), weight)


def max_prior(sizes: np.ndarray, n: float, weight: float = 1.0) -> Term:
    """size * ln(size / n): large clusters are cheap."""
    return Term(np.asarray(sizes, float).reshape(-1, 1), lambda m: xlogx(m[..., 0]) - m[..., 0] * np.log(n), weight)


def repeated_keys(counts: np.ndarray, weight: float = 1.0) -> Term:
    """Pairs of members with the same key: sum c * (c - 1) / 2."""
    return Term(np.asarray(counts, float), lambda m: (np.maximum(m - 1, 0) * m / 2).sum(axis=-1), weight)


def vector_mean(vectors: np.ndarray, weight: float = 1.0, scale: float = 175.0) -> Term:
    """Summed squared distance to the mean, over `scale`; rows hold size, summed squares and the summed vector."""
    v = np.asarray(vectors, float)
    rows = np.c_[np.ones(len(v)), (v * v).sum(axis=1), v]
    return Term(rows, lambda m: (m[..., 1] - (m[..., 2:] ** 2).sum(axis=-1) / m[..., 0]) / scale, weight)


def no_loss(n: int) -> Term:
    """A term that costs nothing: all merges are alike and come in order."""
    return Term(np.zeros((n, 1)), lambda m: np.zeros(m.shape[:-1]), 1.0)


@dataclass
class Tree:
    """Merges in order: (left, right, loss); leaves are 0..n-1, merge k makes node n + k. Unmerged roots may remain."""

    n: int
    leaf_loss: list[float]
    merges: list[tuple[int, int, float]] = field(default_factory=list)

    def roots(self) -> list[int]:
        used = {x for a, b, _ in self.merges for x in (a, b)}
        return [x for x in range(self.n + len(self.merges)) if x not in used]

    def loss(self, node: int) -> float:
        return self.leaf_loss[node] if node < self.n else self.merges[node - self.n][2]

    def children(self, node: int) -> tuple[int, int] | None:
        return None if node < self.n else self.merges[node - self.n][:2]

    def fold(self, leaf: Callable[[int], object], merge: Callable[[int, object, object], object]) -> dict[int, object]:
        """Bottom-up values of all nodes; children come before parents by construction, so nothing recurs."""
        out: dict[int, object] = {i: leaf(i) for i in range(self.n)}
        for k, (a, b, _) in enumerate(self.merges):
            out[self.n + k] = merge(self.n + k, out[a], out[b])
        return out


def agglomerate(terms: list[Term], stop: Callable[[int, int, int, float], bool] | None = None, check: bool = True) -> Tree:
    """Merges until one cluster is left or `stop(number of clusters, left, right, loss)` says so.

    Losses are cumulative; with `check` a merge that lowers the loss by more than 1e-4 is an error. The merged cluster
    keeps the smaller index's place.
    """
    n = len(terms[0].rows) if terms else 0
    rows = [t.rows.copy() for t in terms]
    total = lambda parts: sum(t.weight * t.loss(p) for t, p in zip(terms, parts))
    own = total(rows) if n else np.zeros(0)
    tree = Tree(n, [float(x) for x in own])
    delta, joint = np.full((n, n), np.inf), np.zeros((n, n))
    for i in range(n - 1):
        joint[i, i + 1 :] = total([r[i] + r[i + 1 :] for r in rows])
        delta[i, i + 1 :] = joint[i, i + 1 :] - own[i] - own[i + 1 :]
    node, alive = list(range(n)), np.ones(n, bool)
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(np.round(delta, 9))), n)
        loss = float(joint[i, j])
        if check and loss < own[i] + own[j] - 1e-4:
            raise ValueError("a merge lowered the loss")
        if stop is not None and stop(n - step, node[i], node[j], loss):
            break
        tree.merges.append((node[i], node[j], loss))
        node[i], own[i] = n + step, loss
        for r in rows:
            r[i] += r[j]
        alive[j] = False
        delta[j, :], delta[:, j] = np.inf, np.inf
        others = np.flatnonzero(alive)
        others = others[others != i]
        if len(others):
            joined = total([r[i] + r[others] for r in rows])
            cost = joined - own[i] - own[others]
            lo, hi = np.minimum(i, others), np.maximum(i, others)
            joint[lo, hi], delta[lo, hi] = joined, cost
    return tree


def complete_linkage(distance: np.ndarray) -> Tree:
    """The loss of a cluster is its largest pairwise distance, and the merge of the smallest new loss comes first."""
    n = len(distance)
    d = np.asarray(distance, float).copy()
    d[np.tril_indices(n)] = np.inf
    full = np.asarray(distance, float).copy()
    tree, node, alive, own = Tree(n, [0.0] * n), list(range(n)), np.ones(n, bool), np.zeros(n)
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(np.round(d, 9))), n)
        loss = float(max(full[i, j], own[i], own[j]))
        tree.merges.append((node[i], node[j], loss))
        node[i], own[i], alive[j] = n + step, loss, False
        full[i, :] = np.maximum(full[i, :], full[j, :])
        full[:, i] = full[i, :]
        d[j, :], d[:, j] = np.inf, np.inf
        others = np.flatnonzero(alive)
        others = others[others != i]
        d[np.minimum(i, others), np.maximum(i, others)] = full[i, others]
    return tree


def random_tree(n: int, rng: np.random.Generator, by_size: bool = False) -> Tree:
    """Pairs of clusters drawn at random are merged, at no loss, until one is left: all clusters alike, or `by_size` with
    chances in proportion to their members. A cluster is drawn by one of its members (or roots), so a draw takes no scan."""
    tree, root, node, roots = Tree(n, [0.0] * n), list(range(n)), list(range(n)), list(range(n))
    place = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k in range(n - 1):
        draw = (lambda: find(int(rng.integers(n)))) if by_size else (lambda: roots[int(rng.integers(len(roots)))])
        a = b = draw()
        while b == a:
            b = draw()
        tree.merges.append((node[a], node[b], 0.0))
        root[b], node[a] = a, n + k
        at, last = place[b], roots[-1]
        roots[at], place[last] = last, at
        roots.pop()
    return tree


@dataclass
class Rows:
    """Sparse counts: the entries of row i are start[i]..start[i + 1] of `items` and `values`; every row has some."""

    start: np.ndarray
    items: np.ndarray
    values: np.ndarray
    width: int
    _dense: tuple[np.ndarray, int] | None = field(default=None, repr=False)

    @staticmethod
    def of(counts: np.ndarray) -> Rows:
        n, width = counts.shape
        return Rows(np.arange(n + 1) * width, np.tile(np.arange(width), n), np.asarray(counts, float).ravel(), width)

    @property
    def n(self) -> int:
        return len(self.start) - 1

    def sums(self, at: np.ndarray, k: int) -> np.ndarray:
        """Summed rows of clusters 0..k-1, counted some rows at a time where they have many entries."""
        out = np.zeros(k * self.width)
        for lo, hi in self._parts(1 << 20):
            part = slice(self.start[lo], self.start[hi])
            code = np.repeat(np.asarray(at[lo:hi], np.int64) * self.width, np.diff(self.start[lo : hi + 1])) + self.items[part]
            out += np.bincount(code, self.values[part], minlength=k * self.width)
        return out.reshape(k, self.width)

    def row(self, i: int) -> np.ndarray:
        part = slice(self.start[i], self.start[i + 1])
        return np.bincount(self.items[part], self.values[part], minlength=self.width)

    def _parts(self, entries: int) -> list[tuple[int, int]]:
        """Ranges of rows with some `entries` each, a row at least."""
        first = np.unique(np.searchsorted(self.start[:-1], np.arange(0, max(int(self.start[-1]), 1), entries)))
        return list(zip(first.tolist(), [*first[1:].tolist(), self.n])) if self.n else []

    def _layout(self) -> tuple[np.ndarray, int]:
        """The column of each item in the dense part, -1 for the rare ones, and the number of columns. A product of dense
        numbers takes about 1/100 of the time of an entry that is looked up."""
        if self._dense is None:
            often = np.bincount(self.items, minlength=self.width) * 100 >= self.n
            self._dense = np.where(often, np.cumsum(often) - 1, -1), int(often.sum())
        return self._dense

    def each(self, logs: list[np.ndarray]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(first row, last row + 1, place in `logs`, losses) for blocks of rows that fit into the processor's cache;
        `logs` are logarithms of parameters (item, cluster). Common items are multiplied as a dense matrix."""
        column, wide = self._layout()
        common = column >= 0
        dense = [-np.ascontiguousarray(log[common]) for log in logs]
        for lo in range(0, self.n, 256):
            hi = min(lo + 256, self.n)
            part = slice(self.start[lo], self.start[hi])
            items, values = self.items[part], self.values[part]
            row = np.repeat(np.arange(hi - lo), np.diff(self.start[lo : hi + 1]))
            at, rare = column[items], None
            if wide < self.width and (at < 0).any():
                rare = np.flatnonzero(at < 0)
                rows, first = np.unique(row[rare], return_index=True)
                rare_items, rare_values = items[rare], values[rare, None]
                row, at, values = np.delete(row, rare), np.delete(at, rare), np.delete(values, rare)
            x = np.bincount(row * wide + at, values, minlength=(hi - lo) * wide).reshape(hi - lo, wide) if wide else np.zeros((hi - lo, 0))
            for k, log in enumerate(logs):
                out = x @ dense[k]
                if rare is not None:
                    out[rows] -= np.add.reduceat(rare_values * log[rare_items], first, axis=0)
                yield lo, hi, k, out

    def losses(self, theta: np.ndarray) -> np.ndarray:
        """(row, cluster): negative log-likelihoods."""
        out = np.empty((self.n, len(theta)))
        for lo, hi, _, loss in self.each([np.ascontiguousarray(np.log(theta).T)]):
            out[lo:hi] = loss
        return out

    # What hard_em asks for, of several trials at once.

    def rows(self, at: list[int]) -> list[np.ndarray]:
        return [self.row(i) for i in at]

    def under(self, thetas: list[np.ndarray]) -> list[np.ndarray]:
        """Losses of all rows under one cluster of each trial."""
        return list(self.losses(np.array(thetas)).T)

    def step(self, thetas: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """Summed loss and summed rows of each trial's clusters after their rows went to the closest ones."""
        return [(float(loss.sum()), self.sums(at, len(theta))) for theta, (at, loss) in zip(thetas, self._closest(thetas))]

    def closest(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._closest([theta])[0]

    def _closest(self, thetas: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The cluster of the smallest loss of each row and that loss; losses equal to 9 digits go to the smaller one."""
        out = [(np.empty(self.n, np.int64), np.empty(self.n)) for _ in thetas]
        for lo, hi, k, loss in self.each([np.ascontiguousarray(np.log(t).T) for t in thetas]):
            loss += np.log(loss.shape[1])
            out[k][0][lo:hi], out[k][1][lo:hi] = first_smallest(loss)
        return out


def first_smallest(loss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place and value of the smallest loss of each row, the first of those equal to 9 digits. Only rows whose second
    smallest loss is as near as that are rounded."""
    every = np.arange(len(loss))
    at = loss.argmin(axis=1)
    best = loss[every, at]
    if loss.shape[1] > 1:
        loss[every, at] = np.inf
        near = np.flatnonzero(~(loss.min(axis=1) > best + (2e-9 + 8 * np.spacing(np.abs(best)))))
        loss[every, at] = best
        if len(near):
            at[near] = np.round(loss[near], 9).argmin(axis=1)
            best[near] = loss[near, at[near]]
    return at, best


def hard_em(data: Rows, k: int, alpha: float, rng: np.random.Generator, trials: int = TRIALS, delta: float = 1e-5) -> np.ndarray:
    """Parameters of the Dirichlet mixture of `k` clusters with the smallest mean loss of some trials, each until the mean
    loss improves by no more than `delta`. A trial starts from rows drawn with chances in proportion to their loss under
    those drawn so far; ties go to the smaller cluster. `data` are rows at hand, or a table of them (flat.Blocks)."""
    n, width = data.n, data.width
    estimate = lambda c: (c + alpha / width) / (c.sum(axis=-1, keepdims=True) + alpha)
    draws = [(int(rng.integers(n)), rng.random(k - 1)) for _ in range(trials)]
    chosen = [[first] for first, _ in draws]
    start = [[estimate(r)] for r in data.rows([x[0] for x in chosen])]
    best = data.under([x[0] for x in start])
    for d in range(k - 1):
        for t, (_, u) in enumerate(draws):
            p = np.maximum(best[t] - best[t].min(), 0)
            p[chosen[t]] = 0
            if p.sum() > 0:
                edges = (p / p.sum()).cumsum()
                chosen[t].append(int((edges / edges[-1]).searchsorted(u[d], side="right")))
            else:
                rest = np.delete(np.arange(n), chosen[t])
                chosen[t].append(int(rest[int(u[d] * len(rest))]))
        new = [estimate(r) for r in data.rows([x[-1] for x in chosen])]
        for t, theta in enumerate(new):
            start[t].append(theta)
        if d < k - 2:  # the last ones aren't drawn from
            best = [np.minimum(*x) for x in zip(best, data.under(new))]
    theta, before, open_ = [np.array(x) for x in start], [np.inf] * trials, list(range(trials))
    for _ in range(MAX_STEPS):
        again = []
        for t, (loss, sums) in zip(open_, data.step([theta[t] for t in open_])):
            mean = loss / n
            if before[t] - mean > delta:
                theta[t], again = estimate(sums), [*again, t]
            before[t] = mean
        open_ = again
        if not open_:
            return theta[int(np.nanargmin(before))]
    raise RuntimeError(f"{len(open_)} trials aren't stable after {MAX_STEPS} steps")


def flat_sets(data: Rows, k: int, alpha: float, seed: int) -> np.ndarray:
    """The flat cluster of each row, 0..number of clusters in use - 1."""
    if data.n <= k:
        return np.arange(data.n)
    theta = hard_em(data, k, alpha, np.random.default_rng(seed))
    return np.unique(data.closest(theta)[0], return_inverse=True)[1]


def set_stats(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Summed statistics of flat clusters 0..max, so that sets are agglomerated like instances."""
    out = np.zeros((int(at.max()) + 1, rows.shape[1]))
    np.add.at(out, at, rows)
    return out


def hybrid(terms: list[Term], flat: np.ndarray, alpha: float = 0.01, seed: int = 0, limit: int = DIRECT_LIMIT) -> tuple[Tree, np.ndarray]:
    """The tree and the leaf of each instance: up to `limit` instances are leaves of their own; more are first put into
    FLAT_CLUSTERS by the best of TRIALS mixtures over `flat` counts. Deeper parts than MAX_DEPTH become one leaf."""
    n = len(flat)
    at = np.arange(n)
    if n > limit:
        at = flat_sets(Rows.of(flat), FLAT_CLUSTERS, alpha, seed)
        terms = [Term(set_stats(t.rows, at), t.loss, t.weight) for t in terms]
    tree = agglomerate(terms, check=False)
    return capped(tree, at, MAX_DEPTH)


def capped(tree: Tree, at: np.ndarray, depth: int) -> tuple[Tree, np.ndarray]:
    """Subtrees below `depth` as one leaf each, with their loss; `at` is mapped to the new leaves."""
    level = {r: 0 for r in tree.roots()}
    for k in range(len(tree.merges) - 1, -1, -1):
        node = tree.n + k
        for child in tree.merges[k][:2]:
            level[child] = level[node] + 1
    if max(level.values(), default=0) <= depth:
        return tree, at
    top = {x: x for x in level if level[x] <= depth}
    for k in range(len(tree.merges) - 1, -1, -1):
        node = tree.n + k
        for child in tree.merges[k][:2]:
            top.setdefault(child, top[node])
    leaves = sorted({top[i] for i in range(tree.n)})
    new = {x: i for i, x in enumerate(leaves)}
    out = Tree(len(leaves), [tree.loss(x) for x in leaves])
    for k, (a, b, loss) in enumerate(tree.merges):
        node = tree.n + k
        if level[node] < depth:
            new[node] = out.n + len(out.merges)
            out.merges.append((new[a], new[b], loss))
    return out, np.array([new[top[i]] for i in at.tolist()])


def joint(outer: list[list[np.ndarray]], penalty: float) -> tuple[Tree, dict[int, list[tuple[np.ndarray, float]]]]:
    """Joint clustering: an outer cluster is a set of inner clusters (count rows). Merging two outer clusters puts their
    inner clusters together and merges them further while loss plus `penalty` times sum(-size * ln(size / total)) falls.

    The tree and the inner clusters of each node. Sequential, for the few verbs of one verb type.
    """
    entropy = lambda m: float(xlogx(m.sum()) - xlogx(m).sum())

    def settle(rows: list[np.ndarray]) -> tuple[list[np.ndarray], float]:
        rows = [r.copy() for r in rows]
        total = sum(r.sum() for r in rows) or 1.0
        cost = lambda rs: sum(entropy(r) for r in rs) + penalty * sum(-r.sum() * np.log(max(r.sum(), 1e-300) / total) for r in rs)
        best = cost(rows)
        while len(rows) > 1:
            options = [(cost([r for k, r in enumerate(rows) if k not in (i, j)] + [rows[i] + rows[j]]), i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))]
            new, i, j = min(options)
            if new >= best - 1e-12:
                break
            rows[i] = rows[i] + rows.pop(j)
            best = new
        return rows, best

    state = {i: settle(rows) for i, rows in enumerate(outer)}
    tree = Tree(len(outer), [state[i][1] for i in range(len(outer))])
    alive = list(range(len(outer)))
    while len(alive) > 1:
        tried = [(settle(state[a][0] + state[b][0]), a, b) for x, a in enumerate(alive) for b in alive[x + 1 :]]
        made, a, b = min(tried, key=lambda t: (round(t[0][1] - state[t[1]][1] - state[t[2]][1], 9), t[1], t[2]))
        node = tree.n + len(tree.merges)
        tree.merges.append((a, b, made[1]))
        state[node] = made
        alive = [x for x in alive if x not in (a, b)] + [node]
    return tree, {k: [(r, entropy(r)) for r in v[0]] for k, v in state.items()}
