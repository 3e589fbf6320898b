"""Streaming extreme-value detectors: peaks over threshold with a generalised Pareto tail.

A detector is initialised on a stretch of readings and then takes one reading at a time. State is a small dict of numbers
and lists, so the same step runs in a batch kernel and as keyed state of a Structured Streaming query.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEVEL, RISK, DEPTH, INIT = 0.98, 1e-3, 30, 0.2


def pareto_fit(peaks: np.ndarray) -> tuple[float, float]:
    """Shape and scale by Grimshaw's reduction: roots of one equation in one unknown, found by bisection on a grid.

    Of all roots, and the exponential limit, the one of largest likelihood wins.
    """
    y = np.asarray(peaks, float)
    if not len(y) or y.max() <= 0:
        return 0.0, 1e-9
    mean, low, high = y.mean(), max(y.min(), 1e-12), y.max()

    def w(t: np.ndarray) -> np.ndarray:
        s = 1 + np.outer(np.atleast_1d(t), y)
        return (1 + np.log(np.maximum(s, 1e-300)).mean(1)) * (1 / s).mean(1) - 1

    small, most = 1e-4 / mean, max(2 * (mean - low) / (low * low), 1.0 / mean)
    found = [(0.0, mean)]
    for grid in (-np.geomspace(min(small, 0.5 / high), (1 - 1e-9) / high, 64), np.geomspace(small, min(most, 1e6 / mean), 64)):
        values = w(grid)
        for k in np.flatnonzero(np.sign(values[:-1]) * np.sign(values[1:]) < 0):
            p, q, fp = grid[k], grid[k + 1], values[k]
            for _ in range(60):
                m = (p + q) / 2
                fm = w(m)[0]
                p, fp, q = (m, fm, q) if fm * fp > 0 else (p, fp, m)
            gamma = np.log1p((p + q) / 2 * y).mean()
            if abs(gamma) > 1e-9 and gamma / ((p + q) / 2) > 0:
                found.append((float(gamma), float(gamma / ((p + q) / 2))))
    return max(found, key=lambda x: likelihood(y, *x))


def likelihood(y: np.ndarray, gamma: float, sigma: float) -> float:
    n = len(y)
    if abs(gamma) < 1e-12:
        return -n * (1 + math.log(y.mean()))
    s = 1 + gamma / sigma * y
    return -math.inf if (s <= 0).any() else float(-n * math.log(sigma) - (1 + 1 / gamma) * np.log(s).sum())


def pareto_quantile(threshold: float, gamma: float, sigma: float, n: int, peaks: int, risk: float) -> float:
    r = n * risk / max(peaks, 1)
    return threshold + (sigma / gamma * (r**-gamma - 1) if abs(gamma) > 1e-12 else -sigma * math.log(r))


class Detector:
    """sides: "upper" or "both"; depth > 0 subtracts the mean of the last depth accepted readings first."""

    def __init__(self, sides: str = "upper", depth: int = 0, risk: float = RISK, level: float = LEVEL, state: dict | None = None) -> None:
        self.signs = {"upper": (1,), "both": (1, -1)}[sides]
        self.depth, self.risk, self.level, self.state = depth, risk, level, state or {}

    def start(self, readings: np.ndarray) -> Detector:
        x = np.asarray(readings, float)
        recent = list(x[-self.depth :]) if self.depth else []
        if self.depth:
            sums = np.cumsum(np.r_[0.0, x])
            x = x[self.depth :] - (sums[self.depth : -1] - sums[: -self.depth - 1]) / self.depth
        self.state = {"recent": recent, "n": len(x), "sides": []}
        for sign in self.signs:
            y = np.sort(sign * x)
            threshold = float(y[min(int(self.level * len(y)), len(y) - 1)]) if len(y) else 0.0
            side = {"threshold": threshold, "peaks": [float(v - threshold) for v in y if v > threshold]}
            self.state["sides"].append(side)
            self.refit(side)
        return self

    def refit(self, side: dict) -> None:
        peaks = side["peaks"]
        gamma, sigma = pareto_fit(np.array(peaks))
        side["quantile"] = pareto_quantile(side["threshold"], gamma, sigma, max(self.state["n"], 1), len(peaks), self.risk) if peaks else side["threshold"]

    def step(self, reading: float) -> tuple[bool, float, float]:
        """(alarm, upper threshold, lower threshold); an alarm leaves the state as it was."""
        s = self.state
        mean = float(np.mean(s["recent"])) if self.depth and s["recent"] else 0.0
        x = reading - mean
        alarm = any(sign * x > side["quantile"] for sign, side in zip(self.signs, s["sides"], strict=True))
        if not alarm:
            s["n"] += 1
            for sign, side in zip(self.signs, s["sides"], strict=True):
                if sign * x > side["threshold"]:
                    side["peaks"].append(float(sign * x - side["threshold"]))
                    self.refit(side)
            if self.depth:
                s["recent"] = [*s["recent"], reading][-self.depth :]
        upper = s["sides"][0]["quantile"] + mean
        return alarm, upper, mean - s["sides"][1]["quantile"] if len(s["sides"]) > 1 else -math.inf


#: The four detectors by name.
DETECTORS = {"spot": ("upper", 0), "bispot": ("both", 0), "dspot": ("upper", DEPTH), "bidspot": ("both", DEPTH)}


def detector(name: str, risk: float = RISK, state: dict | None = None) -> Detector:
    return Detector(*DETECTORS[name], risk=risk, state=state)


def abnormality(normal: np.ndarray, readings: np.ndarray, name: str = "spot") -> float:
    """Largest exceedance of a threshold, relative to it, over the readings after a normal stretch; 0 without an alarm."""
    if len(normal) < 5:
        return 0.0
    d, worst = detector(name).start(normal), 0.0
    for x in readings:
        alarm, upper, lower = d.step(float(x))
        if alarm:
            edge = upper if x > upper else lower
            worst = max(worst, abs(x - edge) / max(abs(edge), 1e-9))
    return worst


ALARMS = "case_id string, node string, t long, value double, upper double, lower double, alarm boolean"


def detect(frame: DataFrame, name: str = "spot", init: float = INIT, risk: float = RISK) -> DataFrame:
    """Alarms of every series of a frame; the first init of a series' readings start its detector. One group a series."""

    def of_series(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["value"]).sort_values("t")
        size = max(1, int(init * len(rows)))
        x = rows["value"].to_numpy(float)
        if not len(x):
            return pd.DataFrame({c.split()[0]: [] for c in ALARMS.split(", ")})
        d = detector(name, risk).start(x[:size])
        found = [d.step(float(v)) for v in x[size:]]
        rest = rows.iloc[size:]
        return pd.DataFrame({"case_id": rest["case_id"], "node": rest["node"], "t": rest["t"], "value": rest["value"], "upper": [u for _, u, _ in found], "lower": [low for _, _, low in found], "alarm": [a for a, _, _ in found]})

    return frame.groupBy("case_id", "node").applyInPandas(of_series, ALARMS)


def detect_stream(stream: DataFrame, name: str = "spot", start_after: int = 50, risk: float = RISK) -> DataFrame:
    """The detectors as keyed state of a streaming frame (case_id, t, node, value).

    A series' first start_after readings start its detector; readings of one batch are taken in time order, those that are
    older than the last one taken are dropped. State is one JSON text a series.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"wait": [], "last": None, "state": None}
        rows = pd.concat(list(batches)).dropna(subset=["value"]).sort_values("t")
        out = []
        d = detector(name, risk, held["state"]) if held["state"] else None
        for t, x in zip(rows["t"].tolist(), rows["value"].tolist(), strict=True):
            if held["last"] is not None and t < held["last"]:
                continue
            held["last"] = t
            if d is None:
                held["wait"].append(x)
                if len(held["wait"]) >= start_after:
                    d = detector(name, risk).start(np.array(held["wait"]))
                    held["wait"] = []
                continue
            alarm, upper, lower = d.step(x)
            out.append((key[0], key[1], t, x, upper, lower, alarm))
        held["state"] = d.state if d else None
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ALARMS.split(", ")])

    return stream.groupBy("case_id", "node").applyInPandasWithState(step, ALARMS, "held string", "append", GroupStateTimeout.NoTimeout)


def window_counts(stream: DataFrame, width: str = "10 minutes", late: str = "30 minutes", time: str = "ts") -> DataFrame:
    """Readings, mean and largest value of each node by tumbling window, late rows accepted up to the watermark."""
    from pyspark.sql import functions as F

    rows = stream.withWatermark(time, late).groupBy(F.window(time, width), "case_id", "node")
    return rows.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("largest")).select("case_id", "node", F.col("window.start").alias("start"), "n", "mean", "largest")
