"""Root-cause methods for one case, and the runner that applies one to all cases of a frame in one job.

A kernel gets the case's readings as a matrix (times x nodes), the node names, and where the anomaly begins; it returns a
score per node (larger is more suspicious). Nodes that are constant on either side are left out before, as the frame
operators do. run() groups the frame by case: a kernel's memory is that of one case.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import graphs
from ..functions.citests import correlation, partial_correlation
from ..functions.special import normal_sf, t_two_sided
from . import discover


@dataclass
class Case:
    """values: times x nodes without gaps; names: nodes; split: first anomalous row; sli: place of the indicator node."""

    values: np.ndarray
    names: list[str]
    split: int
    sli: int
    seed: int = 0

    @property
    def normal(self) -> np.ndarray:
        return self.values[: self.split]

    @property
    def anomalous(self) -> np.ndarray:
        return self.values[self.split :]

    @property
    def flag(self) -> np.ndarray:
        return (np.arange(len(self.values)) >= self.split).astype(float)


#: From a case to a score of each node, or rows of keys by which ties of the first, the score, are settled.
Kernel = Callable[..., np.ndarray]
METHODS: dict[str, Kernel] = {}


def register_method(name: str) -> Callable:
    """Decorator: make a kernel available to run() by name."""

    def add(kernel: Kernel) -> Kernel:
        METHODS[name] = kernel
        return kernel

    return add


def _spread(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, 1.0)


@register_method("nsigma")
def n_sigma(case: Case) -> np.ndarray:
    return ((case.anomalous - case.normal.mean(0)) / _spread(case.normal.std(0))).max(0)


@register_method("baro")
def robust(case: Case) -> np.ndarray:
    low, mid, high = np.percentile(case.normal, [25, 50, 75], axis=0)
    return ((case.anomalous - mid) / _spread(high - low)).max(0)


@register_method("dummy")
def dummy(case: Case) -> np.ndarray:
    return np.random.default_rng(case.seed).random(len(case.names))


@register_method("e_diagnosis")
def e_diagnosis(case: Case, alpha: float = 0.01) -> np.ndarray:
    """Size of the correlation of both sides' readings, of equal length, where it is significant; others fall behind."""
    size = min(len(case.normal), len(case.anomalous))
    x, y = case.normal[len(case.normal) - size :], case.anomalous[:size]
    out = np.zeros(len(case.names))
    for k in range(len(out)):
        r = correlation(np.stack([x[:, k], y[:, k]], 1))[0, 1] if size > 3 else 0.0
        p = t_two_sided(r * math.sqrt((size - 2) / max(1 - r * r, 1e-12)), size - 2) if size > 3 else 1.0
        out[k] = 1 + abs(r) if p < alpha else -p
    return out


def residual_z(case: Case, a: np.ndarray, train: int | None = None, test: int | None = None, lags: int = 0) -> np.ndarray:
    """Largest |z| of each node's test residuals on its parents, by the training residuals' mean and deviation.

    Parents are taken at lags 0 to lags. The training rows are the last train before the split that have all lags, the test
    rows the first test after it (all, if None); a node without parents stands for itself.
    """
    first, stop = case.split - (train or case.split), min(len(case.values), case.split + (test or len(case.values)))
    rows, cut = np.arange(max(first, lags), stop), case.split - max(first, lags)
    out = np.zeros(len(case.names))
    for j in range(len(out)):
        s = np.flatnonzero(a[:, j])
        target = case.values[rows, j]
        rest = target
        if len(s) and cut > len(s) * (lags + 1) + 1:
            design = np.hstack([*(case.values[rows - k][:, s] for k in range(lags + 1)), np.ones((len(rows), 1))])
            rest = target - design @ np.linalg.lstsq(design[:cut], target[:cut], rcond=None)[0]
        r, q = rest[: max(cut, 0)], rest[max(cut, 0) :]
        if len(r):
            out[j] = np.abs((q - r.mean()) / (r.std() if r.std() > 1e-12 else 1.0)).max(initial=0)
    return out


def confidence(z: np.ndarray) -> np.ndarray:
    return 1 - 2 * normal_sf(np.abs(z))


def descendant_adjusted(score: np.ndarray, a: np.ndarray, threshold: float = 3.0) -> np.ndarray:
    """A node at or above the threshold gains the largest score below it of its children, and of theirs in turn."""
    score, below = score.copy(), [dict() for _ in score]
    base = score.copy()
    for layer in reversed(graphs.condensed_layers(a)):
        for n in layer:
            for c in np.flatnonzero(a[n]):
                if c != n and base[c] < threshold:
                    below[n] |= {int(c): base[c]} | below[c]
    for n in range(len(score)):
        if base[n] >= threshold and below[n]:
            score[n] += max(below[n].values())
    return score


@register_method("circa")
def circa(case: Case, alpha: float = 0.05, adjust: bool = False) -> np.ndarray:
    """Regression on the parents of a PC graph; with adjust, children's scores are added."""
    a = graphs.directed_edges(discover.pc(case.normal, alpha=alpha))
    z = residual_z(case, a)
    return descendant_adjusted(z, a) if adjust else z


@register_method("rht")
def windowed_residuals(case: Case, alpha: float = 0.05, lookup: int = 120, detect: int = 10, lags: int = 0, threshold: float = 3.0, confident: bool = False) -> np.ndarray:
    """Adjusted residual scores over the lookup rows before the split and detect rows after it.

    Ranks go by score, then by the layer of the graph (causes first), then by the residual's own z. With confident, scores
    are confidences of z, and the threshold is one too.
    """
    a = graphs.directed_edges(discover.pc(case.normal, alpha=alpha))
    z = residual_z(case, a, lookup, detect, lags)
    layer = np.zeros(len(z))
    for k, nodes in enumerate(graphs.condensed_layers(a)):
        layer[list(nodes)] = k
    return np.c_[descendant_adjusted(confidence(z) if confident else z, a, threshold), -layer, z]


@register_method("ht")
def hypothesis_test(case: Case, graph: str = "pc", alpha: float = 0.05, penalty: float = 2.0) -> np.ndarray:
    a = graphs.directed_edges(discover.pc(case.normal, alpha=alpha)) if graph == "pc" else graphs.extension(*discover.ges(case.normal, penalty=penalty))
    return residual_z(case, a)


def pattern_edges(d: np.ndarray, u: np.ndarray) -> np.ndarray:
    return ((d != 0) | (u != 0)).astype(int)


#: Graphs by name: kernels from the data matrix to edges a[cause, effect].
GRAPHS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "pc": lambda x: graphs.directed_edges(discover.pc(x)),
    "fci": lambda x: graphs.directed_edges(discover.fci(x)),
    "ges": lambda x: pattern_edges(*discover.ges(x)),
    "fges": lambda x: pattern_edges(*discover.ges(x, penalty=2.0)),
    "granger": discover.granger,
    "pcmci": lambda x: discover.pcmci_graph(x, 3, 0.05),
    "lingam": lambda x: (discover.ica_lingam(x) != 0).astype(int),
    "direct_lingam": lambda x: (discover.direct_lingam(x) != 0).astype(int),
    "notears": lambda x: (discover.notears(x) != 0).astype(int),
    "ntlr": lambda x: (discover.notears(x, rank=min(10, x.shape[1])) != 0).astype(int),
    "cmlp": discover.neural_granger,
}


def _page_rank(graph: str, steps: int = 10) -> Kernel:
    def kernel(case: Case) -> np.ndarray:
        """Mass flows from effects to causes; without edges, columns keep their order."""
        a = GRAPHS[graph](case.values)
        return graphs.page_rank(a.T, steps=steps) if a.any() else -np.arange(len(case.names), dtype=float)

    return kernel


def _random_walk(graph: str, rho: float = 0.5, sampled: int = 0) -> Kernel:
    def kernel(case: Case) -> np.ndarray:
        """Walk from the indicator over the graph, weighed by n-sigma scores; expected visits, or sampled ones with a seed."""
        p = graphs.transition(GRAPHS[graph](case.values), n_sigma(case), rho)
        return graphs.sampled_visits(p, case.sli, 10 * len(p), sampled, case.seed) if sampled else graphs.expected_visits(p, case.sli, 10 * len(p))

    return kernel


for _name in ("pc", "fci", "ges", "fges", "granger", "lingam", "ntlr", "cmlp"):
    METHODS[f"{_name}_pagerank"] = _page_rank(_name)
METHODS["micro_diag"] = _page_rank("direct_lingam")
for _name in ("pc", "fci", "fges", "granger", "lingam", "ntlr"):
    METHODS[f"{_name}_randomwalk"] = _random_walk(_name)


@register_method("cloudranger")
def cloud_ranger(case: Case, beta: float = 0.3, rho: float = 0.2, alpha: float = 0.1, steps: int = 1000, walks: int = 10) -> np.ndarray:
    """Second-order walk from the indicator: forward along dependencies, back with rho, staying by the correlation's excess."""
    a = graphs.directed_edges(discover.pc(case.values, alpha=alpha))
    n, s = len(a), correlation(case.values)[case.sli]
    p = np.where(a != 0, np.abs(s)[None, :], 0.0)
    p = p / np.where(p.sum(1, keepdims=True) > 0, p.sum(1, keepdims=True), 1)
    forward = np.where(a[None] != 0, (1 - beta) * p[:, :, None] + beta * p[None], 0.0)
    forward = forward / np.where(forward.sum(2, keepdims=True) > 0, forward.sum(2, keepdims=True), 1)
    only_back = (a.T != 0) & (a == 0)
    back = np.where(only_back[None], rho * ((1 - beta) * p[:, :, None] + beta * p.T[None]), 0.0)
    back = back / np.where(back.sum(2, keepdims=True) > 0, back.sum(2, keepdims=True), 1)
    m = forward + rho * back
    others = np.where(np.eye(n, dtype=bool), -np.inf, np.where((a != 0) | only_back, s[None, :], -np.inf)).max(1)
    stay = np.maximum(0, s - np.where(np.isfinite(others), others, 0))
    m[:, np.arange(n), np.arange(n)] = np.where(m[:, np.arange(n), np.arange(n)] == 0, stay[None, :], m[:, np.arange(n), np.arange(n)])
    m = m / np.where(m.sum(2, keepdims=True) > 0, m.sum(2, keepdims=True), 1)
    return graphs.pair_walk(m, case.sli, steps, walks, case.seed)


def cause_weights(a: np.ndarray, corr: np.ndarray, sli: int, rho: float = 0.2) -> np.ndarray:
    """Rows of a walk from effects to causes weighed by partial correlation with the indicator, given both nodes' parents."""
    n = len(a)
    parents = [set(np.flatnonzero(a[:, k])) for k in range(n)]
    score = np.array([abs(partial_correlation(corr, sli, y, tuple(sorted((parents[sli] - {y} | parents[y]) - {sli, y})))) if y != sli else 0.0 for y in range(n)])
    q = np.zeros((n, n))
    for i, j in zip(*np.nonzero(a), strict=True):
        if i != sli:
            q[j, i] = score[i]
        if not a[j, i] and j != sli:
            q[i, j] = max(q[i, j], rho * score[j])
    for i in range(n):
        q[i, i] = max(0.0, score[i] - max((score[k] for k in parents[i]), default=0.0)) if i != sli else 0.0
    return q / np.where(q.sum(1, keepdims=True) > 0, q.sum(1, keepdims=True), 1)


@register_method("microcause")
def micro_cause(case: Case, tau: int = 10, alpha: float = 0.001, pc_alpha: float = 0.1, steps: int = 1000, walks: int = 1000, weight: float = 0.5) -> np.ndarray:
    """Walks over the lagged graph, and how far each node leaves its extreme-value threshold."""
    from ..streaming.spot import abnormality

    q = cause_weights(discover.pcmci_graph(case.values, tau, alpha, pc_alpha), correlation(case.values), case.sli)
    visits = graphs.sampled_visits(q, case.sli, steps, walks, case.seed)
    degree = np.array([abnormality(case.normal[:, k], case.anomalous[:, k]) for k in range(len(visits))])
    return weight * visits / max(visits.max(initial=0), 1e-12) + (1 - weight) * degree / max(degree.max(initial=0), 1e-12)


@register_method("rcd")
def rcd(case: Case, gamma: int = 5, bins: int = 5, localized: bool = True) -> np.ndarray:
    """Hierarchical search for the flag's children: chunks of gamma variables until nothing shrinks, then all survivors."""
    coded = np.stack([discover.kmeans_bins(c, bins) for c in case.values.T], 1)
    rng, alive = np.random.default_rng(case.seed), list(range(coded.shape[1]))
    sweep = lambda start: [start + 0.1 * k for k in range(10) if start + 0.1 * k < 1]
    while localized and len(alive) > gamma:
        order = rng.permutation(alive)
        kept: list[int] = []
        for at in range(0, len(order), gamma):
            chunk = [int(k) for k in order[at : at + gamma]]
            kept += [chunk[k] for k in discover.target_children(coded[:, chunk], case.flag, sweep(0.01), 1)]
        if len(kept) >= len(alive):
            break
        alive = sorted(kept)
    found = [alive[k] for k in discover.target_children(coded[:, alive], case.flag, sweep(0.001), None)] if alive else []
    out = np.full(len(case.names), -1.0)
    for place, k in enumerate(found):
        out[k] = len(found) - place
    return out


@register_method("causalai")
def causal_ai(case: Case, alpha: float = 0.001, most: int = 4) -> np.ndarray:
    """Children of the flag by Fisher's z, with conditioning sets up to most variables, ordered by their p-values."""
    from ..functions.citests import FisherZ

    n = len(case.names)
    test = FisherZ(np.c_[case.values, case.flag])
    near, _, _ = discover.skeleton(n + 1, test, alpha, most=most)
    p = np.array([test.p(k, n) for k in range(n)])
    return np.where(near[:n, n], 2 - p, -p)


@register_method("run")
def attention(case: Case, lag: int = 5, penalty: float = 0.02) -> np.ndarray:
    """Parents above the largest gap of lagged weights, cycles broken at the weakest correlation, personalised PageRank.

    The weights are a linear network's (group lasso), in place of a trained attention model.
    """
    a = graphs.break_cycles(discover.neural_granger(case.values, lag, penalty), correlation(case.values))
    return graphs.page_rank(a.T, steps=50, teleport=np.where(a.T.sum(1) == 0, 1.0, 0.5))


def to_case(rows: pd.DataFrame, inject: int, sli: str | None, seed: int) -> tuple[Case, list[str]]:
    """The case of a group of a frame, and all its nodes in column order. Gaps: last reading, then 0."""
    rows = rows.sort_values(["pos", "t"], kind="stable")
    names = list(dict.fromkeys(rows["node"]))
    wide = rows.pivot_table(index="t", columns="node", values="value", aggfunc="last", dropna=False).reindex(columns=names)
    wide = wide.replace([np.inf, -np.inf], np.nan).ffill().fillna(0.0)
    split = int((wide.index < inject).sum())
    x = wide.to_numpy(float)
    vary = np.array([len(x[:split]) > 0 and len(x[split:]) > 0 and np.ptp(x[:split, k]) > 0 and np.ptp(x[split:, k]) > 0 for k in range(x.shape[1])], bool)
    kept = [n for n, ok in zip(names, vary, strict=True) if ok]
    return Case(x[:, vary], kept, split, kept.index(sli) if sli in kept else 0, seed), names


RANKS = "case_id string, node string, score double, rank int, status string"


def run(frame: DataFrame, cases: DataFrame, method: str | Kernel, seed: int = 0, **settings) -> DataFrame:
    """Ranks of every case: case_id, node, score, rank, status.

    cases: case_id, inject, and sli where the method needs one; it is joined to the frame by case. status is ok, empty
    (no node varies on both sides; column order) or the error that stopped the kernel (column order, as a fallback).
    """
    kernel = METHODS[method] if isinstance(method, str) else method
    columns = cases.columns
    given = cases.select("case_id", F.col("inject").cast("long").alias("inject"), (F.col("sli") if "sli" in columns else F.lit(None).cast("string")).alias("sli"))

    def of_case(rows: pd.DataFrame) -> pd.DataFrame:
        case, names = to_case(rows, int(rows["inject"].iloc[0]), rows["sli"].iloc[0], seed)
        status, nodes = "ok", case.names
        if not nodes:
            status, nodes, score = "empty", names, -np.arange(len(names), dtype=float)
        else:
            try:
                keys = np.asarray(kernel(case, **settings), float)
                score, keys = (keys, None) if keys.ndim == 1 else (keys[:, 0], keys[:, 1:])
            except (ValueError, ArithmeticError, np.linalg.LinAlgError, IndexError) as e:
                status, nodes, score = f"{type(e).__name__}: {e}"[:200], names, -np.arange(len(names), dtype=float)
        steady = lambda x: [-float(f"{v:.9e}") for v in x]  # noqa: E731  (ties as in stats.ranked())
        more = [] if status != "ok" or keys is None else [steady(k) for k in keys.T[::-1]]
        order = np.lexsort([*more, steady(score)])
        return pd.DataFrame({"case_id": rows["case_id"].iloc[0], "node": [nodes[k] for k in order], "score": score[order], "rank": np.arange(1, len(order) + 1, dtype=np.int32), "status": status})

    return frame.join(given, "case_id").groupBy("case_id").applyInPandas(of_case, RANKS)


EDGES = "case_id string, src string, dst string"


def discover_graphs(frame: DataFrame, method: str | Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Edges (case_id, src, dst) of every case by a graph method."""
    kernel = GRAPHS[method] if isinstance(method, str) else method

    def of_case(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pos", "t"], kind="stable")
        names = list(dict.fromkeys(rows["node"]))
        wide = rows.pivot_table(index="t", columns="node", values="value", aggfunc="last", dropna=False).reindex(columns=names).replace([np.inf, -np.inf], np.nan).ffill().fillna(0.0)
        x = wide.to_numpy(float)
        vary = np.ptp(x, axis=0) > 0 if len(x) else np.zeros(len(names), bool)
        kept = [n for n, ok in zip(names, vary, strict=True) if ok]
        a = kernel(x[:, vary]) if len(kept) > 1 else np.zeros((len(kept),) * 2)
        found = [(kept[i], kept[j]) for i, j in zip(*np.nonzero(a), strict=True)]
        return pd.DataFrame({"case_id": rows["case_id"].iloc[0], "src": [i for i, _ in found], "dst": [j for _, j in found]}, dtype=object)

    return frame.groupBy("case_id").applyInPandas(of_case, EDGES)
