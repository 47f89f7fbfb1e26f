"""Search over settings.

A search asks ``evaluate(settings) -> scores`` (larger is better) for whole batches, so one pass over a fold can score
every setting of a batch.  Trial tables are a handful of rows and live on the driver; all data work is inside
``evaluate``.
"""

from __future__ import annotations

import itertools
import math
import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError, ModelTrainingError

Evaluate = Callable[[list[dict]], list[float]]


@dataclass
class Search:
    """Trials in the order they were tried."""

    trials: list[tuple[dict, float]] = field(default_factory=list)
    dropped: list[tuple[dict, float]] = field(default_factory=list)  # scored on fewer rows

    @property
    def best(self) -> tuple[dict, float]:
        usable = [(s, v) for s, v in self.trials if v == v and v != -math.inf]
        if not usable:
            raise ModelTrainingError("no setting could be scored")
        return max(usable, key=lambda t: t[1])  # the first of equals

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, {k: str(v) for k, v in s.items()}, float(v)) for i, (s, v) in enumerate(self.trials)]
        return spark.createDataFrame(rows, "trial int, params map<string,string>, score double")

    def elbow(self, spark: SparkSession, param: str) -> DataFrame:
        """``(value, score)`` of one numeric parameter, sorted by value."""
        rows = [(float(s[param]), float(v)) for s, v in self.trials if param in s]
        return spark.createDataFrame(rows, "value double, score double").orderBy("value", "score")


def grid(space: dict[str, Sequence]) -> list[dict]:
    keys = list(space)
    return [dict(zip(keys, v)) for v in itertools.product(*space.values())]


def grid_search(space: dict[str, Sequence], evaluate: Evaluate) -> Search:
    settings = grid(space)
    return Search(list(zip(settings, evaluate(settings))))


def random_draws(space: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """Distinct settings of a discrete grid."""
    settings = grid(space)
    return random.Random(seed).sample(settings, min(n, len(settings)))


def random_search(space: dict[str, Sequence], evaluate: Evaluate, n_iter: int = 10, seed: int = 42) -> Search:
    settings = random_draws(space, n_iter, seed)
    return Search(list(zip(settings, evaluate(settings))))


def halving_search(
    space: dict[str, Sequence], evaluate_on: Callable[[list[dict], float], list[float]], factor: int = 3, seed: int = 42
) -> Search:
    """Successive halving: every setting on a small share of the rows, the best 1/factor on factor times as many.

    ``evaluate_on(settings, share)`` scores settings on a hash sample holding that share; the last round uses all rows.
    """
    if factor < 2:
        raise ConfigurationError("factor must be at least 2", factor=factor)
    alive = grid(space)
    rounds = math.ceil(math.log(len(alive), factor) - 1e-9) if len(alive) > 1 else 0
    dropped: list[tuple[dict, float]] = []
    for r in range(rounds):
        scored = list(zip(alive, evaluate_on(alive, float(factor) ** (r - rounds))))
        ranked = sorted(scored, key=lambda t: -t[1] if t[1] == t[1] else math.inf)
        alive = [s for s, _ in ranked[: max(1, math.ceil(len(ranked) / factor))]]
        dropped += [(s, v) for s, v in scored if s not in alive]
    # scores of earlier rounds come from fewer rows, so only the last round can name the winner
    last = list(zip(alive, evaluate_on(alive, 1.0)))
    return Search(last, dropped)


# --- sequential model-based search (tree-structured Parzen estimators) ----------------------------------------------


@dataclass(frozen=True)
class IntRange:
    low: int
    high: int


@dataclass(frozen=True)
class FloatRange:
    low: float
    high: float
    log: bool = False


@dataclass(frozen=True)
class Choice:
    options: tuple

    def __init__(self, options):
        object.__setattr__(self, "options", tuple(options))


def draw(space: dict, rng: random.Random) -> dict:
    out = {}
    for k, d in space.items():
        if isinstance(d, IntRange):
            out[k] = rng.randint(d.low, d.high)
        elif isinstance(d, FloatRange):
            out[k] = math.exp(rng.uniform(math.log(d.low), math.log(d.high))) if d.log else rng.uniform(d.low, d.high)
        elif isinstance(d, Choice):
            out[k] = rng.choice(d.options)
        else:
            raise ConfigurationError("unknown dimension", name=k)
    return out


def _to_line(d, v: float) -> float:
    return math.log(v) if isinstance(d, FloatRange) and d.log else float(v)


def _density(d, seen: list, v) -> float:
    """Parzen density of one value under the observed values plus a flat prior."""
    if isinstance(d, Choice):
        return (sum(1 for s in seen if s == v) + 1.0) / (len(seen) + len(d.options))
    lo, hi = _to_line(d, d.low), _to_line(d, d.high)
    width = max(hi - lo, 1e-12)
    band = max(width / max(len(seen), 1) ** 0.5 / 2, width / 50)
    x = _to_line(d, v)
    total = 1.0 / width
    for s in seen:
        total += math.exp(-(((x - _to_line(d, s)) / band) ** 2) / 2) / (band * math.sqrt(2 * math.pi))
    return total / (len(seen) + 1)


def propose(space: dict, trials: list[tuple[dict, float]], rng: random.Random, candidates: int = 24) -> dict:
    """The candidate with the best good / bad density ratio, each dimension on its own."""
    ranked = sorted(trials, key=lambda t: -t[1])
    cut = max(1, math.ceil(0.1 * len(ranked)))
    good, bad = [s for s, _ in ranked[:cut]], [s for s, _ in ranked[cut:]] or [s for s, _ in ranked]
    out = {}
    for k, d in space.items():
        g, b = [s[k] for s in good], [s[k] for s in bad]
        pool = []
        for _ in range(candidates):
            if g and not isinstance(d, Choice) and rng.random() > 1.0 / (len(g) + 1):
                lo, hi = _to_line(d, d.low), _to_line(d, d.high)
                x = min(max(rng.gauss(_to_line(d, rng.choice(g)), (hi - lo) / max(len(g), 1) ** 0.5 / 2), lo), hi)
                v = math.exp(x) if isinstance(d, FloatRange) and d.log else x
                pool.append(min(max(round(v), d.low), d.high) if isinstance(d, IntRange) else min(max(v, d.low), d.high))
            else:
                pool.append(draw({k: d}, rng)[k])
        out[k] = max(pool, key=lambda v: math.log(_density(d, g, v)) - math.log(_density(d, b, v)))
    return out


def tpe_search(
    space, evaluate: Evaluate, n_trials: int = 20, timeout: float | None = None, seed: int = 42, startup: int = 10
) -> Search:
    """Random start (scored as one batch), then one proposal at a time until ``n_trials`` or ``timeout`` seconds."""
    rng, start = random.Random(seed), time.monotonic()
    first = [draw(space, rng) for _ in range(min(startup, n_trials))]
    out = Search(list(zip(first, evaluate(first))))
    while len(out.trials) < n_trials and (timeout is None or time.monotonic() - start < timeout):
        s = propose(space, [(a, b if b == b else -math.inf) for a, b in out.trials], rng)
        out.trials.append((s, evaluate([s])[0]))
    return out


def hash_share(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Deterministic sample for the early rounds of a halving search."""
    if share >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
