"""Local scores of a variable given its parents: larger is better. A score is a callable (variable, parents) -> float."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

import numpy as np

from .citests import codes, contingency, is_discrete

Score = Callable[[int, tuple[int, ...]], float]
SCORES: dict[str, Callable[..., Score]] = {}


def register_score(name: str) -> Callable:
    def add(maker):
        SCORES[name] = maker
        return maker

    return add


def _kept(f: Score) -> Score:
    kept = cache(f)
    return lambda y, parents: kept(y, tuple(sorted(parents)))


def gaussian_loglik(n: int, rss: float) -> float:
    return -n / 2 * (math.log(2 * math.pi) + math.log(max(rss / n, 1e-12)) + 1)


def residual_square(gram: np.ndarray, y: int, parents: tuple[int, ...]) -> float:
    """Residual sum of squares of y on parents from a centred Gram matrix."""
    if not parents:
        return float(gram[y, y])
    p = list(parents)
    beta = np.linalg.lstsq(gram[np.ix_(p, p)], gram[p, y], rcond=None)[0]
    return float(max(gram[y, y] - gram[p, y] @ beta, 0.0))


@register_score("bic_gauss")
def bic_gauss(data: np.ndarray, penalty: float = 2.0) -> Score:
    """2 llf - penalty (k + 1) ln n with k coefficients (the intercept is one)."""
    x = data - data.mean(0)
    gram, n = x.T @ x, len(data)
    return _kept(lambda y, s: 2 * gaussian_loglik(n, residual_square(gram, y, s)) - penalty * (len(s) + 2) * math.log(n))


def _evidence(x: np.ndarray, y: np.ndarray, steps: int = 60) -> float:
    """Log evidence of Bayesian ridge regression with precisions found by fixed-point steps."""
    n, k = x.shape
    values, vectors = np.linalg.eigh(x.T @ x)
    values, target = np.maximum(values, 0), vectors.T @ (x.T @ y)
    alpha, lam = 1 / max(y.var(), 1e-9), 1.0
    for _ in range(steps):
        mean = target * alpha / (lam + alpha * values)
        gamma = (alpha * values / (lam + alpha * values)).sum()
        error = max(y @ y - 2 * mean @ target + values @ (mean * mean), 1e-12)
        new_alpha, new_lam = max(n - gamma, 1e-6) / error, (gamma + 1e-6) / (mean @ mean + 1e-6)
        done = abs(new_alpha - alpha) < 1e-8 * alpha and abs(new_lam - lam) < 1e-8 * lam
        alpha, lam = new_alpha, new_lam
        if done:
            break
    mean = target * alpha / (lam + alpha * values)
    error = max(y @ y - 2 * mean @ target + values @ (mean * mean), 1e-12)
    return 0.5 * (k * math.log(lam) + n * math.log(alpha) - alpha * error - lam * (mean @ mean) - np.log(lam + alpha * values).sum() - n * math.log(2 * math.pi))


def _polynomial(degree: int) -> Callable[[np.ndarray], Score]:
    from itertools import combinations_with_replacement as choose

    def make(data: np.ndarray) -> Score:
        z = (data - data.mean(0)) / np.where(data.std(0) > 0, data.std(0), 1)

        def score(y: int, parents: tuple[int, ...]) -> float:
            columns = [np.ones(len(z)), *(np.prod(z[:, list(c)], 1) for d in range(1, degree + 1) for c in choose(parents, d))]
            return _evidence(np.stack(columns, 1), z[:, y])

        return _kept(score)

    return make


register_score("poly2")(_polynomial(2))
register_score("poly3")(_polynomial(3))


@register_score("bdeu")
def bdeu(data: np.ndarray, sample_size: float = 10.0) -> Score:
    coded, sizes = codes(data)

    def score(y: int, parents: tuple[int, ...]) -> float:
        q, r = math.prod(sizes[p] for p in parents), sizes[y]
        table = contingency(np.c_[coded, np.zeros(len(coded), np.int64)], [*sizes, 1], len(sizes), y, parents)[:, 0, :]
        a, b = sample_size / q, sample_size / (q * r)
        return float(sum(math.lgamma(a) - math.lgamma(a + row.sum()) + sum(math.lgamma(b + c) - math.lgamma(b) for c in row if c) for row in table))

    return _kept(score)


@register_score("bic_discrete")
def bic_discrete(data: np.ndarray) -> Score:
    """Log likelihood with 0.1 added inside the logarithm's numerator, less half of ln n a parameter."""
    coded, sizes = codes(data)

    def score(y: int, parents: tuple[int, ...]) -> float:
        table = contingency(np.c_[coded, np.zeros(len(coded), np.int64)], [*sizes, 1], len(sizes), y, parents)[:, 0, :]
        likelihood = sum((row * np.log((row + 0.1) / row.sum())).sum() for row in table)
        return float(likelihood - 0.5 * math.log(len(coded)) * (sizes[y] - 1) * math.prod(sizes[p] for p in parents))

    return _kept(score)


@register_score("bge")
def bge(data: np.ndarray) -> Score:
    """Bayesian Gaussian equivalent score with a Wishart prior (a unit mean precision, p + 2 degrees of freedom)."""
    n, p = data.shape
    prior_w, am = p + 2, 1.0
    t = am * (prior_w - p - 1) / (am + 1)
    centred = data - data.mean(0)
    r = t * np.eye(p) + centred.T @ centred + n * am / (n + am) * np.outer(data.mean(0), data.mean(0))

    def marginal(s: tuple[int, ...]) -> float:
        k = len(s)
        if not k:
            return 0.0
        lg = lambda a: sum(math.lgamma((a + 1 - i) / 2) for i in range(1, k + 1))
        det = np.linalg.slogdet(r[np.ix_(s, s)])[1]
        w = prior_w - p + k
        return -k * n / 2 * math.log(math.pi) + k / 2 * math.log(am / (n + am)) + lg(n + w) - lg(w) + w * k / 2 * math.log(t) - (n + w) / 2 * det

    return _kept(lambda y, s: marginal((*s, y)) - marginal(s))


def conditional_gaussian(data: np.ndarray, discrete: list[bool], y: int, parents: tuple[int, ...]) -> tuple[float, int]:
    """Log likelihood of y given parents of mixed kinds, and its number of parameters.

    A continuous y is regressed on its continuous parents in each configuration of the discrete ones. For a discrete y the
    joint density of the continuous parents with and without y is compared (Bayes' rule).
    """
    n = len(data)
    split, real = [p for p in parents if discrete[p]], [p for p in parents if not discrete[p]]

    def configurations(at: list[int]) -> np.ndarray:
        return np.unique(data[:, at], axis=0, return_inverse=True)[1].reshape(-1) if at else np.zeros(n, np.int64)

    def density(at: list[int], where: np.ndarray) -> tuple[float, int]:
        total, count, k = 0.0, 0, len(at)
        for c in np.unique(where):
            rows = data[where == c][:, at]
            m = len(rows)
            total += m * math.log(m / n)
            if k:
                cov = np.atleast_2d(np.cov(rows.T, bias=True)) if m > k + 1 else np.atleast_2d(np.cov(data[:, at].T, bias=True))
                total -= m / 2 * (k * math.log(2 * math.pi) + np.linalg.slogdet(cov + 1e-9 * np.eye(k))[1] + k)
            count += 1 + k + k * (k + 1) // 2
        return total, count

    if discrete[y]:
        joint, none = density(real, configurations([*split, y])), density(real, configurations(split))
    else:
        joint, none = density([*real, y], configurations(split)), density(real, configurations(split))
    return joint[0] - none[0], joint[1] - none[1]


@register_score("conditional_gaussian")
def conditional_gaussian_score(data: np.ndarray, sparsity: float = 1.0, most: int = 20) -> Score:
    kinds = [is_discrete(c, most) for c in data.T]

    def score(y: int, parents: tuple[int, ...]) -> float:
        likelihood, freedom = conditional_gaussian(data, kinds, y, parents)
        return 2 * likelihood - sparsity * freedom * math.log(len(data))

    return _kept(score)


def graph_score(score: Score, parents: dict[int, tuple[int, ...]]) -> float:
    """Sum of local scores, values that are not numbers left out."""
    return float(np.nansum([score(y, tuple(s)) for y, s in parents.items()]))


def discretisation_scores(counts: np.ndarray) -> dict[str, float]:
    """Class-attribute dependence of a discretisation from its counts (classes x bins)."""
    counts = np.asarray(counts, float)
    bins, n = counts.shape[1], counts.sum()
    columns = counts.sum(0)
    top = counts.max(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        caim = np.nansum(np.where(columns > 0, top**2 / columns, 0)) / bins
        laim = np.nansum(np.where(columns > 0, top**2 / columns, 0)) / (bins * max((counts > 0).sum(1).max(), 1)) * (top.sum() / n)
        expected = counts.sum(1, keepdims=True) * columns / n
        chi = np.nansum(np.where(expected > 0, (counts - expected) ** 2 / expected, 0))
    return {"caim": float(caim), "laim": float(laim), "ameva": float(chi / (bins * max(len(counts) - 1, 1))), "mlameva": float(chi / (bins * (len(counts) - 1 if len(counts) > 1 else 1) * max(n, 1)))}


def parents_of(a: np.ndarray) -> dict[int, tuple[int, ...]]:
    return {j: tuple(map(int, np.flatnonzero(np.asarray(a)[:, j]))) for j in range(len(a))}


def score_ratio(score: Score, estimated: np.ndarray, true: np.ndarray) -> float:
    """Total score of the estimated graph by that of the true one."""
    return graph_score(score, parents_of(estimated)) / graph_score(score, parents_of(true))


def caim_cuts(column: np.ndarray, classes: np.ndarray, most: int | None = None) -> np.ndarray:
    """Cut points by greedy growth of the CAIM score, at least one fewer than there are classes.

    Every midpoint of neighbouring values may be a cut; with most, only so many quantiles of them. Of equal scores the
    least midpoint is taken.
    """
    values, place = np.unique(column, return_inverse=True)
    kinds, own = np.unique(classes, return_inverse=True)
    table = np.zeros((len(kinds), len(values) + 1))
    np.add.at(table, (own, place + 1), 1)
    below = table.cumsum(1)  # counts by class of the first k values
    free = list(range(1, len(values)))  # a cut after k values
    if most is not None and len(free) > most:
        free = sorted({int(x) for x in np.quantile(free, np.linspace(0, 1, most))})
    cuts: list[int] = []
    best = -math.inf

    def value(c: list[int]) -> float:
        return discretisation_scores(np.diff(below[:, [0, *sorted(c), len(values)]], axis=1))["caim"]

    while free:
        top, cut = max((value([*cuts, k]), -k) for k in free)
        if top <= best and len(cuts) >= len(kinds) - 1:
            break
        cuts, best = [*cuts, -cut], max(best, top)
        free.remove(-cut)
    cuts.sort()
    return np.array([(values[k - 1] + values[k]) / 2 for k in cuts])
