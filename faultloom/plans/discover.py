"""Causal discovery on one data matrix (rows in time order x variables); all graphs are a[cause, effect].

Each method is a kernel for one case; run them over many cases with plans.runner, one group a case.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np

from ..functions.citests import CI_TESTS, CITest, correlation, partial_correlation
from ..functions.graphs import ARROW, CIRCLE, TAIL, cpdag, extension, is_acyclic, marks_of, meek, possible_d_sep
from ..functions.scores import SCORES, Score
from ..functions.special import chi2_sf, f_sf, t_two_sided

Forbidden = Callable[[int, int], bool]


# Constraint-based


def skeleton(n: int, test: CITest, alpha: float = 0.05, stable: bool = True, most: int | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, dict, np.ndarray]:
    """Adjacency, separating sets, and the largest p-value that removed each pair.

    stable removes edges at the end of each depth, so the order of variables doesn't matter; the first separating set in
    lexicographic order is kept.
    """
    near = ~np.eye(n, dtype=bool) if start is None else np.array(start, bool)
    separated: dict[tuple[int, int], tuple[int, ...]] = {}
    p_values, depth = np.full((n, n), -1.0), 0
    while depth <= (n if most is None else most) and near.sum(1).max(initial=0) > depth:
        view = near.copy() if stable else near
        gone = []
        for i in range(n):
            for j in np.flatnonzero(view[i]):
                if (i, j) in separated:
                    continue
                for given in combinations([k for k in np.flatnonzero(view[i]) if k != j], depth):
                    p = test.p(i, int(j), tuple(map(int, given)))
                    if p > alpha:
                        separated[i, j] = separated[j, i] = tuple(map(int, given))
                        p_values[i, j] = p_values[j, i] = max(p, p_values[i, j])
                        gone.append((i, j))
                        if not stable:
                            near[i, j] = near[j, i] = False
                        break
        for i, j in gone:
            near[i, j] = near[j, i] = False
        depth += 1
    return near, separated, p_values


def orient(near: np.ndarray, separated: dict, forbidden: Forbidden | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Colliders of unshielded triples, background knowledge, then Meek's rules: directed and undirected edges."""
    n = len(near)
    d, u = np.zeros((n, n), int), np.array(near, int)
    for k in range(n):
        for i, j in combinations(np.flatnonzero(near[k]), 2):
            if not near[i, j] and k not in separated.get((i, j), ()):
                for x in (i, j):
                    if not d[k, x]:
                        d[x, k], u[x, k], u[k, x] = 1, 0, 0
    if forbidden:
        for i, j in zip(*np.nonzero(u), strict=True):
            if u[i, j] and forbidden(i, j) and not forbidden(j, i):
                d[j, i], u[i, j], u[j, i] = 1, 0, 0
    return meek(d, u)


def pc(data: np.ndarray, test: str = "fisherz", alpha: float = 0.05, stable: bool = True, forbidden: Forbidden | None = None) -> np.ndarray:
    """Endpoint marks of the PC algorithm's pattern."""
    if data.shape[1] < 2:
        return np.zeros((data.shape[1],) * 2, int)
    near, separated, _ = skeleton(data.shape[1], CI_TESTS[test](data), alpha, stable)
    return marks_of(*orient(near, separated, forbidden))


def metric_knowledge(names: list[str]) -> Forbidden:
    """Memory and CPU don't cause median latency, nothing causes the frontend... unless it is the frontend itself."""

    def rule(i: int, j: int) -> bool:
        a, b = names[i], names[j]
        return (b.endswith("lat50") and a.endswith(("mem", "cpu"))) or ("frontend" in b and "frontend" not in a)

    return rule


def fci(data: np.ndarray, test: str = "fisherz", alpha: float = 0.05) -> np.ndarray:
    """Endpoint marks of a partial ancestral graph."""
    n = data.shape[1]
    ci = CI_TESTS[test](data)
    near, separated, _ = skeleton(n, ci, alpha)

    def colliders(m: np.ndarray) -> np.ndarray:
        for k in range(n):
            for i, j in combinations(np.flatnonzero(near[k]), 2):
                if not near[i, j] and k not in separated.get((i, j), ()):
                    m[i, k] = m[j, k] = ARROW
        return m

    circles = lambda: np.where(near, CIRCLE, 0)
    m = colliders(circles())
    for i, j in combinations(range(n), 2):
        if near[i, j]:
            for around in (possible_d_sep(m, i), possible_d_sep(m, j)):
                pool = sorted(around - {i, j})
                found = next((s for size in range(len(pool) + 1) for s in combinations(pool, size) if ci.p(i, j, s) > alpha), None)
                if found is not None:
                    near[i, j] = near[j, i] = False
                    separated[i, j] = separated[j, i] = found
                    break
    m, changed = colliders(circles()), True
    while changed:
        before = m.copy()
        for b in range(n):
            for a, c in ((a, c) for a in np.flatnonzero(near[b]) for c in np.flatnonzero(near[b]) if a != c):
                if m[a, b] == ARROW and m[c, b] == CIRCLE and not near[a, c]:
                    m[c, b], m[b, c] = TAIL, ARROW
        for a in range(n):
            for c in np.flatnonzero(near[a]):
                if m[a, c] == CIRCLE and any(near[a, b] and near[b, c] and m[a, b] == ARROW and m[b, c] == ARROW and (m[b, a] == TAIL or m[c, b] == TAIL) for b in range(n)):
                    m[a, c] = ARROW
        for b in range(n):
            for d in np.flatnonzero(near[b]):
                if m[d, b] != CIRCLE:
                    continue
                around = [a for a in np.flatnonzero(near[b]) if m[a, b] == ARROW and near[a, d] and m[a, d] == CIRCLE]
                if any(not near[a, c] for a, c in combinations(around, 2)):
                    m[d, b] = ARROW
        _discriminate(m, near, separated)
        changed = bool((m != before).any())
    return m


def _discriminate(m: np.ndarray, near: np.ndarray, separated: dict) -> None:
    """Rule 4: a discriminating path from d over colliders that are parents of c to b, decided by the separating set."""
    n = len(m)
    for b in range(n):
        for c in np.flatnonzero(near[b]):
            if m[c, b] != CIRCLE:
                continue
            for a in np.flatnonzero(near[b]):
                if a == c or not (near[a, c] and m[a, c] == ARROW and m[c, a] == TAIL and m[b, a] == ARROW):
                    continue
                stack, seen = [(a, frozenset([a]))], set()
                while stack:
                    x, path = stack.pop()
                    for d in np.flatnonzero(near[x]):
                        if d in path or d in (b, c) or m[d, x] != ARROW:
                            continue
                        if not near[d, c]:
                            if b in separated.get((d, c), ()):
                                m[c, b], m[b, c] = TAIL, ARROW
                            else:
                                m[a, b] = m[c, b] = m[b, c] = ARROW
                            stack = []
                            break
                        if m[d, c] == ARROW and m[c, d] == TAIL and m[x, d] == ARROW and (d, path) not in seen:
                            seen.add((d, path))
                            stack.append((d, path | {d}))


def mmpc(data: np.ndarray, test: str = "fisherz", alpha: float = 0.05, most: int | None = None) -> np.ndarray:
    """Symmetric neighbours by max-min association forward, pruning backward, and the AND rule."""
    n, ci = data.shape[1], CI_TESTS[test](data)
    around = np.zeros((n, n), bool)
    weakest = lambda x, t, pool: max(ci.p(x, t, s) for size in range(len(pool if most is None else pool[:most]) + 1) for s in combinations(pool, size))
    for t in range(n):
        kept: list[int] = []
        while True:
            left = {x: weakest(x, t, kept) for x in range(n) if x != t and x not in kept}
            best = min(left, key=lambda x: (left[x], x), default=None)
            if best is None or left[best] > alpha:
                break
            kept.append(best)
        for x in list(kept):
            if weakest(x, t, [k for k in kept if k != x]) > alpha:
                kept.remove(x)
        around[t, kept] = True
    return (around & around.T).astype(int)


def mdepcs(data: np.ndarray, test: str = "fisherz", alpha: float = 0.05) -> np.ndarray:
    """Superset of parents and children: pairs that no set of at most one other variable separates."""
    n, ci = data.shape[1], CI_TESTS[test](data)
    out = np.zeros((n, n), int)
    for i, j in combinations(range(n), 2):
        if ci.p(i, j) <= alpha and all(ci.p(i, j, (k,)) <= alpha for k in range(n) if k not in (i, j)):
            out[i, j] = out[j, i] = 1
    return out


def hpc(data: np.ndarray, test: str = "fisherz", alpha: float = 0.05) -> np.ndarray:
    """Hybrid parents and children: a de-superset of neighbours and spouses, then incremental association, with the OR rule."""
    n, ci = data.shape[1], CI_TESTS[test](data)
    near = mdepcs(data, test, alpha)
    out = np.zeros((n, n), bool)
    for t in range(n):
        candidates = set(np.flatnonzero(near[t]))
        spouses = {int(s) for x in candidates for s in np.flatnonzero(near[x]) if s != t and s not in candidates and ci.p(t, int(s), (int(x),)) <= alpha}
        pool, blanket = sorted(candidates | spouses), []
        while True:
            left = {x: ci.p(t, x, tuple(blanket)) for x in pool if x not in blanket}
            best = min(left, key=lambda x: (left[x], x), default=None)
            if best is None or left[best] > alpha:
                break
            blanket.append(best)
        for x in list(blanket):
            if ci.p(t, x, tuple(k for k in blanket if k != x)) > alpha:
                blanket.remove(x)
        for x in blanket:
            others = [k for k in blanket if k != x]
            out[t, x] = x in candidates and all(ci.p(t, x, s) <= alpha for size in range(len(others) + 1) for s in combinations(others, size))
    return (out | out.T).astype(int)


# Score-based


def ges(data: np.ndarray, score: str | Score = "bic_gauss", penalty: float | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Greedy equivalence search, forward then backward: directed and undirected edges of the pattern."""
    made = score if callable(score) else SCORES[score](data, penalty) if penalty is not None else SCORES[score](data)
    n = data.shape[1]
    d, u = np.zeros((n, n), int), np.zeros((n, n), int)

    def clique(s: set[int]) -> bool:
        return all(d[i, j] or d[j, i] or u[i, j] for i, j in combinations(s, 2))

    def blocked(y: int, x: int, s: set[int]) -> bool:
        """No semi-directed path from y to x avoids s."""
        stack, seen = [y], {y}
        while stack:
            k = stack.pop()
            for j in range(n):
                if (d[k, j] or u[k, j]) and j not in seen and j not in s:
                    if j == x:
                        return False
                    seen.add(j)
                    stack.append(j)
        return True

    subsets = lambda pool: (set(t) for size in range((len(pool) if most is None else min(len(pool), most)) + 1) for t in combinations(sorted(pool), size))
    for forward in (True, False):
        while True:
            best = (1e-9, None)
            for x in range(n):
                for y in range(n):
                    joined = d[x, y] or d[y, x] or u[x, y]
                    if x == y or (forward and joined) or (not forward and not (d[x, y] or u[x, y])):
                        continue
                    around = {k for k in range(n) if u[y, k] and (d[k, x] or d[x, k] or u[k, x])}
                    parents = set(np.flatnonzero(d[:, y]))
                    pool = {k for k in range(n) if u[y, k] and k != x and not (d[k, x] or d[x, k] or u[k, x])} if forward else around
                    for t in subsets(pool):
                        s = around | t if forward else around - t
                        base = tuple((s | parents) - {x})
                        gain = made(y, (*base, x)) - made(y, base)
                        gain = gain if forward else -gain
                        if gain > best[0] and clique(s) and (not forward or blocked(y, x, s)):
                            best = (gain, (x, y, t))
            if best[1] is None:
                break
            x, y, t = best[1]
            if forward:
                d[x, y] = 1
                for k in t:
                    d[k, y], u[k, y], u[y, k] = 1, 0, 0
            else:
                d[x, y] = u[x, y] = u[y, x] = 0
                for k in t:
                    d[y, k], u[y, k], u[k, y] = 1, 0, 0
                    if u[x, k]:
                        d[x, k], u[x, k], u[k, x] = 1, 0, 0
            d, u = cpdag(extension(d, u))
    return d, u


def hill_climb(data: np.ndarray, score: str | Score = "bic_gauss", tabu: int = 10, patience: int = 10, allowed: np.ndarray | None = None, indegree: int | None = None, steps: int = 1000) -> np.ndarray:
    """Add, remove or flip the edge of greatest gain; up to patience moves may lose, none returns while it is tabu."""
    made = score if callable(score) else SCORES[score](data)
    n = data.shape[1]
    a = np.zeros((n, n), int)
    allowed = ~np.eye(n, dtype=bool) if allowed is None else np.asarray(allowed) != 0
    local = [made(k, ()) for k in range(n)]
    best, best_total, lost, recent = a.copy(), sum(local), 0, []
    parents = lambda m, k: tuple(np.flatnonzero(m[:, k]))
    for _ in range(steps):
        moves = []
        for i in range(n):
            for j in range(n):
                if i == j or (i, j) in recent:
                    continue
                changes = [("drop", [(i, j, 0)]), ("flip", [(i, j, 0), (j, i, 1)])] if a[i, j] else [("add", [(i, j, 1)])] if not a[j, i] else []
                for _, change in changes:
                    if any(v and not allowed[x, y] for x, y, v in change):
                        continue
                    b = a.copy()
                    for x, y, v in change:
                        b[x, y] = v
                    ends = {y for _, y, _ in change}
                    if (indegree is not None and any(b[:, y].sum() > indegree for y in ends)) or (any(v for _, _, v in change) and not is_acyclic(b)):
                        continue
                    moves.append((sum(made(y, parents(b, y)) - local[y] for y in ends), change, b, ends))
        if not moves:
            break
        gain, change, b, ends = max(moves, key=lambda m: (m[0], [-x for x in m[1][0]]))
        lost = 0 if gain > 1e-9 else lost + 1
        if lost > patience:
            break
        a = b
        for y in ends:
            local[y] = made(y, parents(a, y))
        recent = [*recent, *((x, y) for x, y, _ in change)][-tabu:] if tabu else []
        if sum(local) > best_total + 1e-9:
            best, best_total = a.copy(), sum(local)
    return best


def hybrid(data: np.ndarray, neighbours: str = "mmpc", score: str = "bic_gauss", alpha: float = 0.05) -> np.ndarray:
    """Hill climbing inside a constraint-based skeleton (mmpc, hpc or mdepcs)."""
    return hill_climb(data, score, allowed={"mmpc": mmpc, "hpc": hpc, "mdepcs": mdepcs}[neighbours](data, alpha=alpha))


# Time series


def lagged(data: np.ndarray, lag: int) -> np.ndarray:
    """Rows from lag on: the columns at lags 0 .. lag, side by side."""
    return np.concatenate([data[lag - k : len(data) - k] for k in range(lag + 1)], 1)


def granger_p(gram: np.ndarray, n: int, target: list[int], own: list[int], other: list[int]) -> dict[str, float]:
    """p-values of the four tests that other lags add nothing to own lags, from the Gram matrix of lagged columns with a constant."""

    def rss(s: list[int]) -> float:
        beta = np.linalg.lstsq(gram[np.ix_(s, s)], gram[s, target[0]], rcond=None)[0]
        return max(float(gram[target[0], target[0]] - gram[s, target[0]] @ beta), 1e-12)

    small, full = rss(own), rss([*own, *other])
    k, free = len(other), n - len(own) - len(other)
    f = max(small - full, 0) / k / (full / free)
    chi = n * max(small - full, 0) / full
    return {"ssr_ftest": f_sf(f, k, free), "ssr_chi2test": chi2_sf(chi, k), "lrtest": chi2_sf(max(n * math.log(small / full), 0), k), "params_ftest": f_sf(f, k, free)}


def granger(data: np.ndarray, maxlag: int = 3, alpha: float = 0.05, test: str | None = None) -> np.ndarray:
    """a[i, j] = 1 if the mean of the four tests' p-values (or that of test) is below alpha at any lag up to maxlag."""
    n = data.shape[1]
    a = np.zeros((n, n), int)
    for lag in range(1, maxlag + 1):
        x = np.c_[lagged(data - data.mean(0), lag), np.ones(max(len(data) - lag, 0))]
        if len(x) <= 2 * lag + 2:
            break
        gram, one = x.T @ x, x.shape[1] - 1
        for i in range(n):
            for j in range(n):
                if i != j and gram[j, j] > 1e-12:
                    at = lambda v: [k * n + v for k in range(1, lag + 1)]  # noqa: B023, E731
                    p = granger_p(gram, len(x), [j], [*at(j), one], at(i))
                    if (p[test] if test else np.mean(list(p.values()))) < alpha:
                        a[i, j] = 1
    return a


def pcmci(data: np.ndarray, tau: int = 3, pc_alpha: float = 0.2, contemporary: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """p[i, j, k] and partial correlation of the links i at lag k -> j (k from 1; 0 too if contemporary).

    Parents of each variable are found by removing lags that a growing set of the strongest others explains (PC1), then
    each link is tested given both ends' parents (MCI), by partial correlation on the lagged correlation matrix.
    """
    n, deep = data.shape[1], 2 * tau
    p_all, r_all = np.ones((n, n, tau + 1)), np.zeros((n, n, tau + 1))
    if len(data) <= deep + 4:
        return p_all, r_all
    x = lagged(data, deep)
    corr, rows = correlation(x), len(x)
    alive = np.diag(x.T @ x) - len(x) * x.mean(0) ** 2 > 1e-12

    def test(a: int, b: int, given: list[int]) -> tuple[float, float]:
        given = [g for g in given if g not in (a, b) and alive[g]]
        free = rows - len(given) - 2
        if not (alive[a] and alive[b]) or free < 1:
            return 1.0, 0.0
        r = partial_correlation(corr, a, b, tuple(given))
        return t_two_sided(r * math.sqrt(free / max(1 - r * r, 1e-12)), free), r

    parents: list[list[int]] = []
    for j in range(n):
        left = {k * n + i: (1.0, 1.0) for k in range(1, tau + 1) for i in range(n)}
        depth = 0
        while depth < len(left):
            order = sorted(left, key=lambda v: (-abs(left[v][1]), v))
            for v in order:
                left[v] = test(v, j, [o for o in order if o != v][:depth])
            left = {v: x for v, x in left.items() if x[0] <= pc_alpha}
            depth += 1
        parents.append(sorted(left, key=lambda v: (-abs(left[v][1]), v)))
    for j in range(n):
        for k in range(0 if contemporary else 1, tau + 1):
            for i in range(n):
                if k or i != j:
                    given = [v for v in parents[j] if v != k * n + i] + [v + k * n for v in parents[i] if v + k * n < x.shape[1]]
                    p_all[i, j, k], r_all[i, j, k] = test(k * n + i, j, given)
    return p_all, r_all


def pcmci_graph(data: np.ndarray, tau: int = 3, alpha: float = 0.05, pc_alpha: float = 0.2, contemporary: bool = False) -> np.ndarray:
    """Edges i -> j (i <> j) whose least p-value over the lags is at most alpha."""
    a = (pcmci(data, tau, pc_alpha, contemporary)[0].min(2) <= alpha).astype(int)
    np.fill_diagonal(a, 0)
    return a


# Continuous optimisation and independent components


def fast_ica(data: np.ndarray, seed: int = 0, steps: int = 500) -> np.ndarray:
    """Unmixing matrix (symmetric FastICA with tanh) of the columns."""
    x = data - data.mean(0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    white = vectors / np.sqrt(np.maximum(values, 1e-10))
    z = x @ white
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(z.shape[1],) * 2))[0]
    for _ in range(steps):
        g = np.tanh(z @ w.T)
        new = g.T @ z / len(z) - np.diag((1 - g * g).mean(0)) @ w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-6
        w = new
        if done:
            break
    return w @ white.T


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost (Hungarian method)."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while match[j]:
            used[j] = True
            row = match[j]
            now = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j
            k = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[k]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
        while j:
            match[j], j = match[way[j]], way[j]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


def ica_lingam(data: np.ndarray, threshold: float = 0.05, seed: int = 0) -> np.ndarray:
    """b[i, j]: effect of i on j, by independent components."""
    n = data.shape[1]
    w = fast_ica(data, seed)
    place = assignment(1 / np.maximum(np.abs(w), 1e-10))
    ordered = np.zeros_like(w)
    ordered[place] = w
    b = np.eye(n) - ordered / np.diag(ordered)[:, None]
    order, left, rest = [], list(range(n)), np.abs(b)
    while left:  # the variable that the others explain least goes next
        k = min(left, key=lambda k: (rest[k, [x for x in left if x != k]] ** 2).sum())
        order.append(k)
        left.remove(k)
    return _by_order(data, order, threshold)


def direct_lingam(data: np.ndarray, threshold: float = 0.05) -> np.ndarray:
    """b[i, j]: effect of i on j; the most independent variable of the residuals goes first, again and again."""
    z, left, order = data - data.mean(0), list(range(data.shape[1])), []
    entropy = lambda u: (1 + math.log(2 * math.pi)) / 2 - 79.047 * (np.log(np.cosh(u)).mean() - 0.37457) ** 2 - 7.4129 * ((u * np.exp(-u * u / 2)).mean()) ** 2
    unit = lambda u: (u - u.mean()) / (u.std() or 1.0)
    x = z.copy()
    while left:
        score = dict.fromkeys(left, 0.0)
        for i, j in combinations(left, 2):
            a, b = unit(x[:, i]), unit(x[:, j])
            r = (a * b).mean()
            gap = entropy(b) + entropy(unit(a - r * b)) - entropy(a) - entropy(unit(b - r * a))
            score[i] += min(0.0, gap) ** 2
            score[j] += min(0.0, -gap) ** 2
        k = min(left, key=lambda k: (score[k], k))
        order.append(k)
        left.remove(k)
        base = x[:, k]
        for j in left:
            x[:, j] = x[:, j] - base * (x[:, j] @ base / max(base @ base, 1e-12))
    return _by_order(data, order, threshold)


def _by_order(data: np.ndarray, order: list[int], threshold: float) -> np.ndarray:
    z, b = data - data.mean(0), np.zeros((data.shape[1],) * 2)
    for n, j in enumerate(order):
        if n:
            before = order[:n]
            b[before, j] = np.linalg.lstsq(z[:, before], z[:, j], rcond=None)[0]
    return np.where(np.abs(b) > threshold, b, 0)


def notears(data: np.ndarray, penalty: float = 0.1, threshold: float = 0.3, rank: int | None = None, rounds: int = 12, steps: int = 400) -> np.ndarray:
    """Weights of a linear graph by the smooth acyclicity constraint trace(exp(W * W)) = n, augmented Lagrangian, Adam.

    With rank, W = U V^T of that rank.
    """
    x = data - data.mean(0)
    x = x / np.where(x.std(0) > 0, x.std(0), 1)
    n, count = x.shape[1], max(len(x), 1)
    cov = x.T @ x / count
    rng = np.random.default_rng(0)
    parts = [np.zeros((n, n))] if rank is None else [rng.normal(0, 0.1, (n, rank)), rng.normal(0, 0.1, (n, rank))]
    rho, alpha, last = 1.0, 0.0, np.inf
    whole = lambda: parts[0] if rank is None else parts[0] @ parts[1].T

    def expm(a: np.ndarray) -> np.ndarray:
        scale = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(0).max(), 1e-9)))) + 1)
        e = term = np.eye(len(a))
        for k in range(1, 14):
            term = term @ (a / 2**scale) / k
            e = e + term
        for _ in range(scale):
            e = e @ e
        return e

    for _ in range(rounds):
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for t in range(1, steps + 1):
            w = whole() * (1 - np.eye(n))
            e = expm(np.clip(w * w, 0, 4))
            h = np.trace(e) - n
            grad = (cov @ (w - np.eye(n)) + penalty * np.sign(w) + (rho * h + alpha) * e.T * 2 * w) * (1 - np.eye(n))
            grads = [grad] if rank is None else [grad @ parts[1], grad.T @ parts[0]]
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                parts[k] = parts[k] - 0.02 * (1 - t / (steps + 1)) * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
        w = whole() * (1 - np.eye(n))
        h = np.trace(expm(np.clip(w * w, 0, 4))) - n
        if h < 1e-6:
            break
        alpha += rho * h
        rho = rho * 10 if h > 0.25 * last else rho
        last = h
    w = np.where(np.abs(w) > threshold, w, 0)
    while not is_acyclic(w):
        w = np.where(np.abs(w) > np.abs(w[w != 0]).min(), w, 0)
    return w


def neural_granger(data: np.ndarray, lag: int = 5, penalty: float = 0.01, steps: int = 400) -> np.ndarray:
    """Edges of a vector autoregression with a group lasso over each cause's lags, by proximal gradient (a linear network)."""
    n = data.shape[1]
    if len(data) <= lag + 2:
        return np.zeros((n, n), int)
    x = (data - data.mean(0)) / np.where(data.std(0) > 0, data.std(0), 1)
    rows = lagged(x, lag)
    y, z = rows[:, :n], rows[:, n:]
    gram, cross = z.T @ z / len(z), z.T @ y / len(z)
    rate = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-9)
    w = np.zeros((n * lag, n))
    for _ in range(steps):
        w = (w - rate * (gram @ w - cross)).reshape(lag, n, n)
        norm = np.sqrt((w * w).sum(0))
        w = (w * np.maximum(0, 1 - rate * penalty * math.sqrt(lag) / np.maximum(norm, 1e-12))).reshape(n * lag, n)
    a = (np.sqrt((w.reshape(lag, n, n) ** 2).sum(0)) > 0).astype(int)
    np.fill_diagonal(a, 0)
    return a


# Intervention targets


def kmeans_bins(column: np.ndarray, bins: int = 5) -> np.ndarray:
    """One-dimensional k-means from uniform bin centres; codes by the midpoints between centres."""
    low, high = column.min(), column.max()
    if low == high:
        return np.zeros(len(column), int)
    edges = np.linspace(low, high, bins + 1)
    centres = (edges[1:] + edges[:-1]) / 2
    for _ in range(300):
        own = np.abs(column[:, None] - centres).argmin(1)
        new = np.array([column[own == k].mean() if (own == k).any() else centres[k] for k in range(bins)])
        if np.allclose(new, centres):
            break
        centres = new
    centres = np.sort(np.unique(centres))
    return np.searchsorted((centres[1:] + centres[:-1]) / 2, column, side="right")


def target_children(coded: np.ndarray, flag: np.ndarray, alphas: list[float], stop: int | None, depth: int | None = None) -> list[int]:
    """Variables that stay dependent on the flag as alpha grows, ordered by alpha, then p-value; stop after stop of them."""
    test = CI_TESTS["chisq"](np.c_[coded, flag])
    n, out = coded.shape[1], []
    for alpha in alphas:
        left, p_of, size = list(range(n)), {}, 0
        while size < len(left) and (depth is None or size <= depth):
            for y in list(left):
                for s in combinations([k for k in left if k != y], size):
                    p_of[y] = max(p_of.get(y, 0.0), test.p(y, n, s))
                    if p_of[y] > alpha:
                        left.remove(y)
                        break
            size += 1
        out += sorted((y for y in left if y not in out), key=lambda y: (p_of.get(y, 1.0), y))
        if stop is not None and len(out) >= stop:
            break
    return out


def forward_sample(parents: dict[int, dict[int, float]], n: int, rows: int, seed: int = 0, noise: str = "gauss") -> np.ndarray:
    """Rows of a linear model: each variable is the weighted sum of its parents and noise."""
    from ..functions.graphs import topological_layers

    rng = np.random.default_rng(seed)
    draw = {"gauss": rng.normal, "uniform": lambda size: rng.uniform(-1.7, 1.7, size), "laplace": lambda size: rng.laplace(size=size)}[noise]
    a = np.zeros((n, n), int)
    for j, s in parents.items():
        a[list(s), j] = 1
    x = np.zeros((rows, n))
    for layer in topological_layers(a):
        for j in layer:
            x[:, j] = draw(size=rows) + sum(w * x[:, i] for i, w in parents.get(j, {}).items())
    return x


def random_dag(n: int, density: float = 0.3, kind: str = "er", seed: int = 0) -> dict[int, dict[int, float]]:
    """Parents with weights of a random acyclic graph: er (each pair with probability density), ba (preferential), full."""
    rng = np.random.default_rng(seed)
    out: dict[int, dict[int, float]] = {j: {} for j in range(n)}
    degree = np.ones(n)
    for j in range(1, n):
        if kind == "ba":
            size = min(j, max(1, round(density * 4)))
            some = rng.choice(j, size, replace=False, p=degree[:j] / degree[:j].sum())
        else:
            some = [i for i in range(j) if kind == "full" or rng.random() < density]
        for i in some:
            out[j][int(i)] = float(rng.choice([-1, 1]) * rng.uniform(0.5, 1.5))
            degree[i] += 1
            degree[j] += 1
    return out


def fit_parameters(data: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least-squares weights, residual variances and implied covariance of a directed acyclic graph."""
    x = data - data.mean(0)
    n = x.shape[1]
    w, variance = np.zeros((n, n)), np.zeros(n)
    for j in range(n):
        s = np.flatnonzero(np.asarray(a)[:, j])
        if len(s):
            w[s, j] = np.linalg.lstsq(x[:, s], x[:, j], rcond=None)[0]
        variance[j] = ((x[:, j] - x @ w[:, j]) ** 2).mean()
    inner = np.linalg.inv(np.eye(n) - w)
    return w, variance, inner.T @ np.diag(variance) @ inner
