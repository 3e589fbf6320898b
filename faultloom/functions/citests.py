"""Conditional-independence tests. A test is made from a data matrix (rows x variables) once and then asked for p-values."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from .special import chi2_sf, two_sided

CI_TESTS: dict[str, Callable[[np.ndarray], CITest]] = {}


def register_ci_test(name: str) -> Callable:
    """Decorator: make a test available by name to every discovery method."""

    def add(maker):
        CI_TESTS[name] = maker
        return maker

    return add


class CITest:
    """p(i, j, given) is the p-value of independence; results are kept."""

    def __init__(self) -> None:
        self.kept: dict[tuple, float] = {}

    def p(self, i: int, j: int, given: tuple[int, ...] = ()) -> float:
        key = (min(i, j), max(i, j), tuple(sorted(given)))
        if key not in self.kept:
            self.kept[key] = self.compute(*key)
        return self.kept[key]

    def compute(self, i: int, j: int, given: tuple[int, ...]) -> float:
        raise NotImplementedError


def partial_correlation(corr: np.ndarray, i: int, j: int, given: tuple[int, ...]) -> float:
    """From the inverse of the correlation matrix of i, j and given; 0 where it isn't defined."""
    if not given:
        r = corr[i, j]
    else:
        at = [i, j, *given]
        inverse = np.linalg.pinv(corr[np.ix_(at, at)])
        scale = inverse[0, 0] * inverse[1, 1]
        r = -inverse[0, 1] / math.sqrt(scale) if scale > 0 else 0.0
    return float(np.clip(r, -1, 1)) if np.isfinite(r) else 0.0


def correlation(data: np.ndarray) -> np.ndarray:
    """Pearson matrix; constant columns correlate 0 with everything and 1 with themselves."""
    x = data - data.mean(0)
    norm = np.sqrt((x * x).sum(0))
    x = x / np.where(norm > 1e-12, norm, 1.0)
    out = x.T @ x
    np.fill_diagonal(out, 1.0)
    return out


@register_ci_test("fisherz")
class FisherZ(CITest):
    """z = sqrt(n - |S| - 3) atanh(partial correlation), from one correlation matrix."""

    def __init__(self, data: np.ndarray) -> None:
        super().__init__()
        self.n, self.corr = len(data), correlation(data)

    def z(self, i: int, j: int, given: tuple[int, ...]) -> float:
        r = np.clip(partial_correlation(self.corr, i, j, given), -1 + 1e-12, 1 - 1e-12)
        return math.sqrt(max(self.n - len(given) - 3, 0)) * math.atanh(r)

    def compute(self, i: int, j: int, given: tuple[int, ...]) -> float:
        return float(two_sided(self.z(i, j, given)))


@register_ci_test("mv_fisherz")
class MissingFisherZ(CITest):
    """Fisher's z on the rows in which all variables of the test are known."""

    def __init__(self, data: np.ndarray) -> None:
        super().__init__()
        self.data = data

    def compute(self, i: int, j: int, given: tuple[int, ...]) -> float:
        rows = self.data[:, [i, j, *given]]
        rows = rows[np.isfinite(rows).all(1)]
        return FisherZ(rows).compute(0, 1, tuple(range(2, 2 + len(given)))) if len(rows) > len(given) + 3 else 1.0


def codes(data: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Columns recoded 0, 1, ... and their numbers of values."""
    out = np.stack([np.unique(c, return_inverse=True)[1] for c in data.T], 1) if data.size else data.astype(int)
    return out, [int(c.max(initial=-1)) + 1 for c in out.T]


def contingency(coded: np.ndarray, sizes: list[int], i: int, j: int, given: tuple[int, ...]) -> np.ndarray:
    """Counts by configuration of given (those that occur), i and j."""
    where = np.zeros(len(coded), np.int64)
    for g in given:
        where = where * sizes[g] + coded[:, g]
    used, where = np.unique(where, return_inverse=True)
    flat = (where * sizes[i] + coded[:, i]) * sizes[j] + coded[:, j]
    return np.bincount(flat, minlength=len(used) * sizes[i] * sizes[j]).reshape(len(used), sizes[i], sizes[j]).astype(float)


class Discrete(CITest):
    def __init__(self, data: np.ndarray) -> None:
        super().__init__()
        self.coded, self.sizes = codes(data)

    @staticmethod
    def cells(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def statistic(self, i: int, j: int, given: tuple[int, ...]) -> tuple[float, int]:
        """Statistic and degrees of freedom; rows and columns without counts in a configuration don't count."""
        table = contingency(self.coded, self.sizes, i, j, given)
        total, freedom = 0.0, 0
        for observed in table:
            observed = observed[observed.sum(1) > 0][:, observed.sum(0) > 0]
            if min(observed.shape) > 1:
                total += self.cells(observed, observed.sum(1, keepdims=True) * observed.sum(0, keepdims=True) / observed.sum()).sum()
                freedom += (observed.shape[0] - 1) * (observed.shape[1] - 1)
        return float(total), freedom

    def compute(self, i: int, j: int, given: tuple[int, ...]) -> float:
        return chi2_sf(*self.statistic(i, j, given))


@register_ci_test("chisq")
class ChiSquare(Discrete):
    @staticmethod
    def cells(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return (observed - expected) ** 2 / expected


@register_ci_test("gsq")
class GSquare(Discrete):
    @staticmethod
    def cells(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(observed > 0, 2 * observed * np.log(np.where(observed > 0, observed, 1) / expected), 0)


def is_discrete(column: np.ndarray, most: int = 20) -> bool:
    return len(np.unique(column)) <= most


@register_ci_test("mixed_lr")
class MixedLikelihoodRatio(CITest):
    """Conditional-Gaussian likelihood ratio in both directions; the smaller p-value counts."""

    def __init__(self, data: np.ndarray, most: int = 20) -> None:
        super().__init__()
        self.data, self.discrete = data, [is_discrete(c, most) for c in data.T]

    def compute(self, i: int, j: int, given: tuple[int, ...]) -> float:
        from .scores import conditional_gaussian

        found = []
        for y, x in ((i, j), (j, i)):
            full, more = conditional_gaussian(self.data, self.discrete, y, (x, *given))
            less, fewer = conditional_gaussian(self.data, self.discrete, y, given)
            found.append(chi2_sf(max(0.0, 2 * (full - less)), max(1, more - fewer)))
        return min(found)
