"""The live monitor on Structured Streaming: constant-size state per series.

Input rows (series, run_id, ord, x). Each series keeps running sums for the sequential test and, for the chart,
the open run's mean, the phase-1 sums and the EWMA. State is kept by applyInPandasWithState, so a restart
from the checkpoint goes on where it stopped. Rows of a micro-batch are taken in order of ord.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "series string, kind string, ord long, value double, window long"
STATE = "n long, s double, q double, stopped boolean, run string, run_n long, run_s double, windows long, p_s double, p_q double, z double, charted long"
EMPTY = (0, 0.0, 0.0, False, None, 0, 0.0, 0, 0.0, 0.0, None, 0)


class Series:
    """One series' state and its decisions. ``compat`` also charts the window that completes phase 1."""

    def __init__(self, state, alpha, theta0, tau2, phase1, lam, width, compat):
        (self.n, self.s, self.q, self.stopped, self.run, self.run_n, self.run_s, self.windows, self.p_s, self.p_q, self.z, self.charted) = state
        self.alpha, self.theta0, self.tau2, self.phase1, self.lam, self.width, self.compat = alpha, theta0, tau2, phase1, lam, width, compat

    def state(self):
        return (self.n, self.s, self.q, self.stopped, self.run, self.run_n, self.run_s, self.windows, self.p_s, self.p_q, self.z, self.charted)

    def push(self, run: str, ord_: int, x: float):
        if x is None or not math.isfinite(x):
            return
        self.n += 1
        self.s += x
        self.q += x * x
        if not self.stopped:
            d, spread = self.s - self.n * self.theta0, 1 + self.n * self.tau2
            log_e = -0.5 * math.log(spread) + d * d * self.tau2 / (2 * spread)
            if log_e >= math.log(1 / self.alpha):
                self.stopped = True
                yield ("stop_early", ord_, self.s / self.n, self.n)
        if self.run is not None and run != self.run:
            yield from self._close(ord_)
        self.run, self.run_n, self.run_s = run, self.run_n + 1, self.run_s + x

    def _close(self, ord_: int):
        mean = self.run_s / self.run_n
        self.run_n, self.run_s = 0, 0.0
        self.windows += 1
        done = self.windows == self.phase1
        if self.windows <= self.phase1:
            self.p_s += mean
            self.p_q += mean * mean
            if not (self.compat and done):
                return
        mu = self.p_s / self.phase1
        var = max(0.0, (self.p_q - self.phase1 * mu * mu) / max(1, self.phase1 - 1))
        if var <= 0:
            return
        self.z = self.lam * mean + (1 - self.lam) * (mu if self.z is None else self.z)
        self.charted += 1
        limit = self.width * math.sqrt(var * self.lam / (2 - self.lam) * (1 - (1 - self.lam) ** (2 * self.charted)))
        if abs(self.z - mu) > limit:
            yield ("regression", ord_, self.z, self.windows)


def monitor(rows: DataFrame, alpha: float = 0.05, theta0: float = 0.0, tau2: float = 1.0, phase1: int = 20, lam: float = 0.2, width: float = 2.962, compat: bool = False) -> DataFrame:
    """Decisions (series, kind, ord, value, window) of a stream of rows (series, run_id, ord, x)."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        s = Series(state.get if state.exists else EMPTY, alpha, theta0, tau2, phase1, lam, width, compat)
        all_ = pd.concat(list(batches)).sort_values("ord", kind="stable")
        out = [(key[0], *d) for run, o, x in zip(all_["run_id"], all_["ord"], all_["x"]) for d in s.push(run, int(o), float(x))]
        state.update(s.state())
        yield pd.DataFrame(out, columns=["series", "kind", "ord", "value", "window"])

    return rows.groupBy("series").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def monitor_batch(rows: DataFrame, **params) -> DataFrame:
    """The same decisions from a finished table."""
    defaults = {"alpha": 0.05, "theta0": 0.0, "tau2": 1.0, "phase1": 20, "lam": 0.2, "width": 2.962, "compat": False} | params

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        s = Series(EMPTY, **defaults)
        part = part.sort_values("ord", kind="stable")
        out = [(key[0], *d) for r, o, x in zip(part["run_id"], part["ord"], part["x"]) for d in s.push(r, int(o), float(x))]
        return pd.DataFrame(out, columns=["series", "kind", "ord", "value", "window"])

    return rows.groupBy("series").applyInPandas(lambda key, part: run(key, part), OUTPUT)


def summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("series", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


def state_summary(rows: DataFrame, decisions: DataFrame, phase1: int = 20) -> DataFrame:
    """One row: observations seen, active series, series in phase 1 and in phase 2 of their chart, decisions made.

    A series' window closes when its run changes; phase 1 is over once ``phase1`` windows have closed.
    """
    seen = rows.where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')")
    turned = F.lag("run_id").over(Window.partitionBy("series").orderBy("ord")) != F.col("run_id")
    per = seen.select("series", turned.alias("t")).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count_if("t").alias("closed"))
    per = per.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("observations"), F.count(F.lit(1)).alias("active"), F.count_if(F.col("closed") < phase1).alias("in_phase1"),
        F.count_if(F.col("closed") >= phase1).alias("in_phase2"),
    )
    return per.crossJoin(decisions.agg(F.count(F.lit(1)).alias("decisions")))  # one row each


def window_means(stream: DataFrame, delay: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """(series, start, x): tumbling-window means by event time with a watermark, from (series, ts, x)."""
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "series").agg(F.avg("x").alias("x"), F.count("x").alias("n"))
    return g.select("series", F.col("window.start").alias("start"), "x", "n")
