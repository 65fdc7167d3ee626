"""Adaptive tests: one person's session, simulated tests of many people, and the greedy minimax choice.

Items: (id, difficulty, discrimination, exposure_count if an exposure rule is used).
"""

from __future__ import annotations

import copy
import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .items import information

GRID = np.linspace(-4, 4, 61)
#: Items that a task holds at most: three numbers each.
POOL_MOST = 1_000_000
#: States of tests that a worker remembers, some 2 kB each.
STATES = 1 << 14
#: Stretches of ability over which items are compared before they are sent out.
STRETCHES = 64


def _draw(*parts) -> float:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


@dataclass(frozen=True)
class Plan:
    """How a test goes: at most ``most`` items, an end from ``least`` on at a standard error of ``se_stop`` or under.

    select: max_info (one of the ``top`` most informative items at the estimate) or minimax (one of the three that raise the
    least information over ``low`` to ``high`` most). exposure: none, max (items given under ``limit`` times) or conditional
    (others too, with a ``chance`` at each step).
    """

    most: int
    least: int = 3
    se_stop: float = 0.3
    seed: int = 0
    top: int = 1
    select: str = "max_info"
    low: float = -4.0
    high: float = 4.0
    points: int = 31
    exposure: str = "none"
    limit: int = 0
    chance: float = 0.0

    @property
    def choices(self) -> int:
        return self.top if self.select == "max_info" else 3


@dataclass
class Bank:
    """Items in order of id, as arrays."""

    ids: list
    a: np.ndarray
    b: np.ndarray
    exposure: np.ndarray
    place: dict = field(default_factory=dict)

    @staticmethod
    def of(rows) -> Bank:
        rows = sorted(rows, key=lambda r: r[0])
        own = lambda k: np.array([float(r[k]) for r in rows])
        return Bank([r[0] for r in rows], own(1), own(2), own(3), {r[0]: i for i, r in enumerate(rows)})


class Session:
    """One person's test. ``next_item`` proposes, ``record`` takes the answer; ``done`` tells when the test is over."""

    def __init__(self, bank: Bank, plan: Plan, person="") -> None:
        self.bank, self.plan, self.person = bank, plan, person
        self.post = np.exp(-(GRID**2) / 2)
        self.places: list[int] = []
        self.given: list = []
        self.history: list[float] = []
        self.theta, self.se, self.done = 0.0, 1.0, False
        self.total = np.zeros(plan.points)

    def _allowed(self) -> np.ndarray:
        free, p = np.ones(len(self.bank.a), bool), self.plan
        free[self.places] = False
        if p.exposure == "none":
            return free
        below = self.bank.exposure < p.limit
        if p.exposure == "conditional":
            step = len(self.given)
            for i in np.flatnonzero(free & ~below):
                below[i] = _draw(p.seed, self.person, step, "exposure", self.bank.ids[i]) < p.chance
        return free & below

    def best(self) -> np.ndarray:
        """Places in the bank of the items of which one comes next, the best first; none if no items are left."""
        free = self._allowed()
        a, b, p = self.bank.a, self.bank.b, self.plan
        if p.select == "max_info":
            q = 1 / (1 + np.exp(-a * (self.theta - b)))
            worth = a * a * q * (1 - q)
        else:
            worth = np.full(len(a), np.inf)
            for t, have in zip(np.linspace(p.low, p.high, p.points), self.total):
                q = 1 / (1 + np.exp(-a * (t - b)))
                worth = np.minimum(worth, have + a * a * q * (1 - q))
        worth = np.where(free, worth, -1.0)
        return np.argsort(-worth, kind="stable")[: min(p.choices, int(free.sum()))]

    def pick(self, best: np.ndarray, person) -> int:
        """The place of the item that a person gets of ``best``."""
        return int(best[int(_draw(self.plan.seed, person, len(self.given), "pick") * len(best)) if len(best) > 1 else 0])

    def next_item(self):
        """The id of the item to give; LookupError without any, RuntimeError after the end."""
        if self.done:
            raise RuntimeError("the test is over")
        best = self.best()
        if not len(best):
            raise LookupError("no items are left")
        return self.bank.ids[self.pick(best, self.person)]

    def record(self, item, right: bool) -> bool:
        """Takes an answer; true once the test is over. An item that the bank lacks is a KeyError."""
        if self.done:
            raise RuntimeError("the test is over")
        i = self.bank.place[item]
        a, b = self.bank.a[i], self.bank.b[i]
        q = 1 / (1 + np.exp(-a * (GRID - b)))
        self.post = self.post * (q if right else 1 - q)
        z = self.post.sum()
        self.theta = float((self.post * GRID).sum() / z)
        self.se = float(math.sqrt(max(0.0, (self.post * GRID**2).sum() / z - self.theta**2)))
        if self.plan.select == "minimax":
            q = 1 / (1 + np.exp(-a * (np.linspace(self.plan.low, self.plan.high, self.plan.points) - b)))
            self.total = self.total + a * a * q * (1 - q)
        self.places.append(i)
        self.given.append(item)
        self.history.append(self.theta)
        n = len(self.given)
        self.done = n >= self.plan.least and (n >= self.plan.most or self.se <= self.plan.se_stop)
        return self.done


class Tests:
    """Many people's tests by one plan. Which items can come next depends on the answers so far and not on the person (but for a
    chance at each step), so a state that several people reach is worked out once. STATES of them are remembered, the others made anew.
    """

    class State:
        def __init__(self, session: Session) -> None:
            self.session, self.after = session, {}
            self.best = None if session.done else session.best()

    def __init__(self, bank: Bank, plan: Plan) -> None:
        self.bank, self.plan, self.made, self.held = bank, plan, 1, 1
        self.first = Tests.State(Session(bank, plan))

    def _next(self, state: State, i: int, right: bool) -> State:
        found = state.after.get((i, right))
        if found is None:
            session = copy.copy(state.session)
            session.places, session.given, session.history = [*session.places], [*session.given], [*session.history]
            session.record(self.bank.ids[i], right)
            found = Tests.State(session)
            self.made += 1
            if self.held < STATES:
                self.held += 1
                state.after[i, right] = found
        return found

    def run(self, answer, person="") -> Session:
        """As run_session; the session is shared and not to be changed."""
        if self.plan.exposure == "conditional":
            return run_session(self.bank, self.plan, answer, person)
        state = self.first
        while not state.session.done and len(state.best):
            i = state.session.pick(state.best, person)
            state = self._next(state, i, bool(answer(self.bank.ids[i], self.bank.a[i], self.bank.b[i])))
        return state.session


_tests: dict[int, Tests] = {}


def _tests_of(shared, plan: Plan) -> Tests:
    """One a Python worker and broadcast bank, so that what is remembered outlives a task."""
    key = id(shared.value)
    if key not in _tests or _tests[key].bank is not shared.value:
        _tests.clear()
        _tests[key] = Tests(shared.value, plan)
    return _tests[key]


def run_session(bank: Bank, plan: Plan, answer, person="") -> Session:
    """A whole test; answer(id, discrimination, difficulty) tells whether an item is solved. It also ends when no item is left."""
    s = Session(bank, plan, person)
    while not s.done:
        try:
            item = s.next_item()
        except LookupError:
            break
        i = bank.place[item]
        s.record(item, answer(item, bank.a[i], bank.b[i]))
    return s


def contenders(pool: DataFrame, plan: Plan) -> DataFrame:
    """The items that a test by ``plan`` could ever give, in order of id as before; the others are never among the first.

    A test looks at the ``most`` + ``top`` - 1 best items at most. Of items with the same parameters only as many first ids
    count. Over a stretch of abilities an item's information has a least and a greatest value: one whose greatest lies
    under the least values of enough others is never chosen there. The minimax choice and a chance at each step only allow the first cut, or none.
    """
    if plan.exposure == "conditional":
        return pool
    if plan.exposure == "max":
        pool = pool.where(F.col("exposure_count") < plan.limit)
    need = max(plan.most, plan.least) + plan.choices - 1
    if plan.select == "max_info":  # first, as it needs no shuffle of the pool
        pool = _reaching(pool, need)
    same = Window.partitionBy("discrimination", "difficulty").orderBy("id")
    return pool.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= need).drop("_n")


def _reaching(pool: DataFrame, need: int) -> DataFrame:
    """The items that are among the ``need`` most informative ones at some ability, and perhaps others."""
    ends = np.linspace(-4, 4, STRETCHES + 1)

    def at_ends(batch):
        """Discrimination, difficulty (null: not a number) and the information at the ends of the stretches."""
        a, b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float)[:, None] for c in ("_a", "_b"))
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-a * (ends - b)))
        return a, b, a * a * p * (1 - p)

    def pieces(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 8192):
                yield batch.slice(first, 8192)

    def lows(batches):
        import pyarrow as pa

        top = np.full((0, STRETCHES), -1.0)
        for batch in pieces(batches):
            info = np.nan_to_num(at_ends(batch)[2], nan=-1.0)
            top = np.concatenate([top, np.minimum(info[:, :-1], info[:, 1:])])
            if len(top) > need:
                top = np.partition(top, len(top) - need, axis=0)[-need:]
        yield pa.RecordBatch.from_pydict({"s": pa.array(np.tile(np.arange(STRETCHES, dtype=np.int32), len(top))), "least": pa.array(top.ravel())})

    numbers = [F.col(c).cast("double").alias(n) for c, n in (("discrimination", "_a"), ("difficulty", "_b"))]
    found = pool.select(*numbers).mapInArrow(lows, "s int, least double").where("least >= 0")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("least")))).where(F.col("n") == need)
    floors = np.zeros(STRETCHES)
    for r in found.collect():  # a row a stretch
        floors[r["s"]] = r["least"]
    floors -= 1e-9

    def reach(batches):
        for batch in pieces(batches):
            a, b, info = at_ends(batch)
            most = np.maximum(info[:, :-1], info[:, 1:])
            most = np.where((b >= ends[:-1]) & (b <= ends[1:]), a * a / 4, most)
            yield batch.select(columns).filter((most >= floors).any(axis=1))

    columns = pool.columns
    return pool.select("*", *numbers).mapInArrow(reach, pool.schema)


def adaptive_tests(pool: DataFrame, people: DataFrame, most: int, least: int = 3, se_stop: float = 0.3, seed: int = 0, top: int = 1, answer=None, **more) -> DataFrame:
    """Runs an adaptive test for each person (person, theta = true ability): (person, n, theta, se).

    People are dealt out, and the ``contenders`` among the items go to every task; over POOL_MOST of these are an error. ``answer``:
    a function of (seed, person, theta, id, discrimination, difficulty); by default a draw from the two-parameter model. ``more``: the other fields of Plan.
    """
    plan = Plan(most, least, se_stop, seed, top, **more)
    some = contenders(pool, plan)
    times = F.col("exposure_count") if plan.exposure != "none" else F.lit(0)
    rows = some.select("id", "discrimination", "difficulty", times).limit(POOL_MOST + 1).collect()
    if len(rows) > POOL_MOST:
        raise ValueError(f"over {POOL_MOST} items could be given; filter the pool first")
    shared = pool.sparkSession.sparkContext.broadcast(Bank.of([tuple(r) for r in rows]))

    def model(seed, person, theta, item, a, b):
        return _draw(seed, person, item, "answer") < 1 / (1 + math.exp(-a * (theta - b)))

    solved = answer or model

    def run(batches):
        import pandas as pd

        tests = _tests_of(shared, plan)
        for batch in batches:
            out = []
            for person, true in zip(batch["person"], batch["theta"]):
                s = tests.run(lambda item, a, b, p=person, t=true: solved(seed, p, t, item, a, b), person)
                out.append((person, len(s.given), s.theta, s.se))
            yield pd.DataFrame(out, columns=["person", "n", "theta", "se"])

    kind = dict(people.dtypes)["person"]
    parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return people.select("person", "theta").repartition(parts).mapInPandas(run, f"person {kind}, n int, theta double, se double")


def select_minimax(pool: DataFrame, n: int, points: int = 31) -> list:
    """Ids of n items chosen one by one so that the least information over the grid is largest; ties go to the first id.

    Each choice is one aggregate over the pool, so n passes over it, and no item but the chosen ones reaches the driver.
    """
    grid = [float(x) for x in np.linspace(-4, 4, points)]
    total, out = [0.0] * points, []
    for _ in range(n):
        table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(have).alias("have")) for t, have in zip(grid, total)])
        least = F.round(F.array_min(F.transform(table, lambda g: g["have"] + information(g["t"], F.col("discrimination"), F.col("difficulty")))), 12)
        left = pool.where(~F.col("id").isin(out)) if out else pool
        best = left.select("id", "discrimination", "difficulty", least.alias("w")).orderBy(F.desc("w"), "id").limit(1).collect()
        if not best:
            break
        a, b = float(best[0]["discrimination"]), float(best[0]["difficulty"])
        q = [1 / (1 + math.exp(-a * (t - b))) for t in grid]
        total = [have + a * a * x * (1 - x) for have, x in zip(total, q)]
        out.append(best[0]["id"])
    return out
