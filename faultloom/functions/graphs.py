"""Kernels over small graphs held as matrices. Convention everywhere: a[i, j] = 1 means an edge i -> j (cause, effect).

Endpoint marks of partially directed graphs are in m[i, j]: the mark at j of the edge between i and j; 0 none, TAIL, ARROW
or CIRCLE.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

TAIL, ARROW, CIRCLE = -1, 1, 2


def is_acyclic(a: np.ndarray) -> bool:
    return topological_layers(a) is not None


def topological_layers(a: np.ndarray) -> list[list[int]] | None:
    """Generations of a directed graph, None if it has a cycle."""
    a, left, out = np.asarray(a) != 0, set(range(len(a))), []
    while left:
        layer = sorted(j for j in left if not any(a[i, j] for i in left))
        if not layer:
            return None
        out.append(layer)
        left -= set(layer)
    return out


def strong_components(a: np.ndarray) -> list[list[int]]:
    """Strongly connected components (lists of nodes, each sorted), in order of their least node."""
    reach = np.asarray(a) != 0
    reach = reach | np.eye(len(reach), dtype=bool)
    for k in range(len(reach)):
        reach = reach | (reach[:, [k]] & reach[[k], :])
    same = reach & reach.T
    return [list(np.flatnonzero(same[i])) for i in range(len(same)) if i == np.flatnonzero(same[i])[0]]


def condensed_layers(a: np.ndarray) -> list[list[int]]:
    """Generations of the components' graph: nodes of a cycle share a layer."""
    parts = strong_components(a)
    small = np.array([[bool(np.asarray(a)[np.ix_(p, q)].any()) and p is not q for q in parts] for p in parts]).reshape(len(parts), len(parts))
    return [sorted(n for k in layer for n in parts[k]) for layer in topological_layers(small) or []]


def page_rank(a: np.ndarray, damping: float = 0.85, steps: int = 10, tolerance: float = 1e-6, teleport: np.ndarray | None = None) -> np.ndarray:
    """Power iteration along edges i -> j; nodes without an edge out spread evenly (or by teleport)."""
    n = len(a)
    if not n:
        return np.zeros(0)
    w = np.asarray(a, float)
    out = w.sum(1)
    jump = np.full(n, 1 / n) if teleport is None else teleport / teleport.sum()
    rank = jump.copy()
    for _ in range(steps):
        new = damping * (w.T @ np.where(out > 0, rank / np.where(out > 0, out, 1), 0) + rank[out == 0].sum() * jump) + (1 - damping) * jump
        done = np.abs(new - rank).sum() < tolerance
        rank = new
        if done:
            break
    return rank


def transition(a: np.ndarray, score: np.ndarray, rho: float = 0.5, keep_out: int | None = None) -> np.ndarray:
    """Rows of a walk: to a child rho |s|, to a parent |s| (keep_out excepted), stay max(|s| - the largest of those, 0)."""
    a, s = np.asarray(a) != 0, np.abs(np.asarray(score, float))
    w = np.maximum(np.where(a, rho * s[None, :], 0.0), np.where(a.T, s[None, :], 0.0))
    if keep_out is not None:
        w[:, keep_out] = 0
    np.fill_diagonal(w, 0)
    stay = np.maximum(s - w.max(1, initial=0), 0)
    w[np.arange(len(w)), np.arange(len(w))] = stay
    total = w.sum(1, keepdims=True)
    return np.where(total > 0, w / np.where(total > 0, total, 1), 1 / max(len(w), 1))


def expected_visits(p: np.ndarray, start: int, steps: int) -> np.ndarray:
    """Expected share of a walk's steps on each node."""
    now, total = np.eye(len(p))[start], np.zeros(len(p))
    for _ in range(steps):
        now = now @ p
        total += now
    return total / max(steps, 1)


def sampled_visits(p: np.ndarray, start: int, steps: int, walks: int = 1, seed: int = 0) -> np.ndarray:
    """Shares of visits of seeded walks; a walk ends on a row without mass."""
    rng, cumulative, count = np.random.default_rng(seed), p.cumsum(1), np.zeros(len(p))
    at, alive = np.full(walks, start), np.ones(walks, bool)
    for _ in range(steps):
        alive &= cumulative[at, -1] > 0
        if not alive.any():
            break
        draw = rng.random(walks)
        at = np.where(alive, np.minimum((cumulative[at] <= draw[:, None] * cumulative[at, -1:]).sum(1), len(p) - 1), at)
        np.add.at(count, at[alive], 1)
    return count / max(count.sum(), 1)


def second_order(p: np.ndarray, beta: float = 0.5) -> np.ndarray:
    """m[k, i, j] = (1 - beta) p[k, i] + beta p[i, j] where p[i, j] > 0, normalised over j."""
    m = np.where(p[None, :, :] > 0, (1 - beta) * p[:, :, None] + beta * p[None, :, :], 0.0)
    total = m.sum(2, keepdims=True)
    return np.where(total > 0, m / np.where(total > 0, total, 1), 0)


def pair_walk(m: np.ndarray, start: int, steps: int, walks: int = 1, seed: int = 0) -> np.ndarray:
    """Shares of visits of walks whose next node depends on the last two."""
    n, rng, count = len(m), np.random.default_rng(seed), np.zeros(len(m))
    cumulative = m.cumsum(2)
    last, at = np.full(walks, start), np.full(walks, start)
    for _ in range(steps):
        row = cumulative[last, at]
        go = row[:, -1] > 0
        new = np.where(go, np.minimum((row <= rng.random(walks)[:, None] * row[:, -1:]).sum(1), n - 1), start)
        last, at = np.where(go, at, start), new
        np.add.at(count, at, 1)
    return count / max(count.sum(), 1)


def hops(a: np.ndarray, start: int) -> np.ndarray:
    """Shortest path lengths from start, 0 where there is none."""
    out, front, step = np.zeros(len(a), int), {start}, 0
    seen = {start}
    while front:
        step += 1
        front = {j for i in front for j in np.flatnonzero(a[i])} - seen
        for j in front:
            out[j] = step
        seen |= front
    return out


def break_cycles(a: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Drop the edge of least weight on a cycle until there is none."""
    a = np.array(a) != 0
    np.fill_diagonal(a, False)
    while not is_acyclic(a):
        inside = np.zeros_like(a)
        for part in strong_components(a):
            inside[np.ix_(part, part)] = a[np.ix_(part, part)]
        i, j = np.unravel_index(np.where(inside, weight, np.inf).argmin(), a.shape)
        a[i, j] = False
    return a.astype(int)


def marks_of(directed: np.ndarray, undirected: np.ndarray) -> np.ndarray:
    m = np.zeros(directed.shape, int)
    m[undirected != 0] = TAIL
    for i, j in zip(*np.nonzero(directed), strict=True):
        m[i, j], m[j, i] = ARROW, TAIL
    return m


def directed_edges(m: np.ndarray) -> np.ndarray:
    """0/1 edges of endpoint marks: i -> j and i o-> j become i -> j, all other kinds both directions."""
    known = {TAIL, ARROW, CIRCLE}
    a = np.zeros(m.shape, int)
    for i, j in combinations(range(len(m)), 2):
        x, y = m[j, i], m[i, j]  # marks at i and at j
        if not x and not y:
            continue
        if x not in known or y not in known:
            raise ValueError(f"no edge has the marks {x} and {y}")
        one_way = ARROW in (x, y) and x != y
        a[i, j] = int(y == ARROW or not one_way)
        a[j, i] = int(x == ARROW or not one_way)
    return a


def meek(directed: np.ndarray, undirected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orient what is implied (rules 1 to 4), to a fixed point."""
    d, u = np.array(directed) != 0, np.array(undirected) != 0
    n, changed = len(d), True
    while changed:
        changed = False
        near = d | d.T | u
        for i, j in zip(*np.nonzero(u), strict=True):
            if not u[i, j]:
                continue
            one = any(d[k, i] and not near[k, j] for k in range(n) if k != j)
            two = (d[i] & d[:, j]).any()
            into = [k for k in range(n) if u[i, k] and d[k, j]]
            three = any(not near[k, l] for k, l in combinations(into, 2))
            four = any(u[i, k] and d[k, l] and d[l, j] and near[i, l] and not near[k, j] for k in range(n) for l in range(n) if k != l)
            if one or two or three or four:
                d[i, j], u[i, j], u[j, i], changed = True, False, False, True
    return d.astype(int), u.astype(int)


def cpdag(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directed and undirected edges of the class of graphs equivalent to a directed acyclic one."""
    a = np.asarray(a) != 0
    near, d = a | a.T, np.zeros_like(a)
    for k in range(len(a)):
        for i, j in combinations(np.flatnonzero(a[:, k]), 2):
            if not near[i, j]:
                d[i, k] = d[j, k] = True
    return meek(d, near & ~d & ~d.T)


def extension(directed: np.ndarray, undirected: np.ndarray) -> np.ndarray:
    """A directed acyclic graph of a pattern, without new colliders if there is one (Dor and Tarsi), else by node order."""
    d, u, left = np.array(directed) != 0, np.array(undirected) != 0, list(range(len(directed)))
    out = d.copy()
    while left:
        for x in left:
            others = [k for k in left if k != x]
            if any(d[x, k] for k in others):
                continue
            around = [k for k in others if u[x, k]]
            near = lambda k: {l for l in others if d[k, l] or d[l, k] or u[k, l]}  # noqa: B023, E731
            adjacent = {k for k in others if d[k, x] or u[k, x]}
            if all(adjacent - {k} <= near(k) for k in around):
                break
        else:
            x = next((x for x in left if not any(d[x, k] for k in left)), left[-1])
            around = [k for k in left if u[x, k]]
        for k in around:
            out[k, x] = True
        left.remove(x)
    return out.astype(int)


def possible_d_sep(m: np.ndarray, start: int) -> set[int]:
    """Nodes on paths from start on which every inner node is a collider or in a triangle with its neighbours."""
    found, seen, stack = set(), set(), [(start, int(k)) for k in np.flatnonzero(m[start])]
    while stack:
        a, b = stack.pop()
        if (a, b) in seen:
            continue
        seen.add((a, b))
        found.add(b)
        for c in map(int, np.flatnonzero(m[b])):
            if c not in (a, start) and ((m[a, b] == ARROW and m[c, b] == ARROW) or m[a, c]):
                stack.append((b, c))
    return found - {start}


def edge_kinds(m: np.ndarray) -> dict[str, list[tuple[int, int]]]:
    """Edges by kind: directed, undirected, bidirected and those with a circle."""
    out: dict[str, list[tuple[int, int]]] = {"directed": [], "undirected": [], "bidirected": [], "circle": []}
    for i, j in combinations(range(len(m)), 2):
        x, y = m[j, i], m[i, j]
        if x or y:
            kind = "circle" if CIRCLE in (x, y) else "undirected" if x == y == TAIL else "bidirected" if x == y == ARROW else "directed"
            out[kind].append((j, i) if kind == "directed" and x == ARROW else (i, j))
    return out


def triples(near: np.ndarray) -> dict[str, list[tuple[int, ...]]]:
    """Unshielded triples (i, k, j), triangles and kites (i, j, k, l: k and l not adjacent) of a skeleton."""
    near, n = np.asarray(near) != 0, len(near)
    out: dict[str, list[tuple[int, ...]]] = {"unshielded": [], "triangle": [], "kite": []}
    for i, j, k in combinations(range(n), 3):
        for a, b, c in ((i, j, k), (i, k, j), (j, i, k)):
            if near[a, b] and near[b, c] and not near[a, c]:
                out["unshielded"].append((a, b, c))
        if near[i, j] and near[j, k] and near[i, k]:
            out["triangle"].append((i, j, k))
    for i, j in combinations(range(n), 2):
        if near[i, j]:
            both = [k for k in range(n) if near[i, k] and near[j, k]]
            out["kite"] += [(i, j, k, l) for k, l in combinations(both, 2) if not near[k, l]]
    return out




def distance(true: np.ndarray, other: np.ndarray) -> int:
    """Structural Hamming distance: pairs that are joined in one graph only, or whose directions differ."""
    return sum(int((true[i, j], true[j, i]) != (other[i, j], other[j, i])) for i, j in combinations(range(len(true)), 2))


def class_distance(true: np.ndarray, other: np.ndarray) -> int:
    """The distance of the patterns of two directed acyclic graphs."""
    return distance(*(np.asarray(d) | np.asarray(u) for d, u in (cpdag(true), cpdag(other))))
