"""Exact order statistics without a global sort.

``percentile`` keeps one counter per distinct value in a single reducer, which does not survive a continuous
column of a very large table.  Here a mergeable quantile sketch brackets every wanted rank, one more scan counts
below / inside / above the bracket, and only the few values strictly inside a bracket are gathered.  The sketch
bounds how many those are; when the bound is too large the bracket is sketched again before gathering.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import agg_row

ACCURACY = 10_000  # rank error of one sketch: n / ACCURACY
GATHER = 100_000  # most values gathered for one bracket


def order_statistics(
    df: DataFrame,
    series: dict[str, Column],
    probs: Sequence[float],
    ranks: Callable[[int, float], Sequence[int]],
    accuracy: int = ACCURACY,
    gather: int = GATHER,
) -> dict[str, tuple[int, dict[float, list]]]:
    """Values at exact zero-based ranks.

    ``ranks(n, p)`` names the ranks wanted near probability ``p`` for a series of ``n`` non-null values.
    Returns ``{name: (n, {p: [value, ...]})}``; values are ``None`` for an empty series.
    """
    if not series:
        return {}
    eps = 2.0 / accuracy
    marks = [q for p in probs for q in (max(0.0, p - eps), min(1.0, p + eps))]
    cols = {f"s{i}": c for i, c in enumerate(series.values())}
    base = df.select(*[c.alias(k) for k, c in cols.items()])
    first: dict[str, Column] = {}
    for k in cols:
        first[f"{k}_n"] = F.count(k)
        first[f"{k}_lo"] = F.min(k)
        first[f"{k}_hi"] = F.max(k)
        first[f"{k}_q"] = F.percentile_approx(k, marks, accuracy)
    seen = agg_row(base, first)

    out: dict[str, tuple[int, dict[float, list]]] = {}
    todo: list[dict] = []
    for (name, _), k in zip(series.items(), cols):
        n = seen[f"{k}_n"]
        out[name] = (n, {p: [] for p in probs})
        for i, p in enumerate(probs):
            wanted = [r for r in ranks(n, p)]
            out[name][1][p] = [None] * len(wanted)
            if n == 0:
                continue
            lo, hi = seen[f"{k}_q"][2 * i], seen[f"{k}_q"][2 * i + 1]
            for j, r in enumerate(wanted):
                r = min(max(r, 0), n - 1)
                todo.append(
                    dict(name=name, k=k, p=p, j=j, rank=r, lo=lo, hi=hi, min=seen[f"{k}_lo"], max=seen[f"{k}_hi"],
                         gather=6 * n / accuracy <= gather, known=None)
                )

    for _ in range(64):
        if not todo:
            return out
        exprs: dict[str, Column] = {}
        for t in todo:
            v, lo, hi = F.col(t["k"]), F.lit(t["lo"]), F.lit(t["hi"])
            inside = (v > lo) & (v < hi)
            tag = t["tag"] = f"{t['k']}|{t['lo']!r}|{t['hi']!r}"
            if t["known"] is None:
                exprs[f"{tag}|lt"] = F.count_if(v < lo)
                exprs[f"{tag}|eq"] = F.count_if(v == lo)
                exprs[f"{tag}|in"] = F.count_if(inside)
                exprs[f"{tag}|hi"] = F.count_if(v == hi)
                if t["gather"]:
                    exprs[f"{tag}|v"] = F.sort_array(F.collect_list(F.when(inside, v)))
            else:
                before, held = t["known"]
                p = (t["rank"] - before) / max(held - 1, 1)
                t["marks"] = [max(0.0, p - eps), min(1.0, p + eps)]
                exprs[f"{tag}|{p!r}|q"] = F.percentile_approx(F.when(inside, v), t["marks"], accuracy)
                t["qtag"] = f"{tag}|{p!r}|q"
        got = agg_row(base, exprs)
        rest = []
        for t in todo:
            tag = t["tag"]
            if t["known"] is not None:
                _, held = t["known"]
                t["lo"], t["hi"] = got[t["qtag"]]
                t["gather"] = 6 * held / accuracy <= gather
                t["known"] = None
                rest.append(t)
                continue
            below = got[f"{tag}|lt"]
            eq = below + got[f"{tag}|eq"]
            held = got[f"{tag}|in"]
            top = eq + held + (got[f"{tag}|hi"] if t["hi"] != t["lo"] else 0)
            r = t["rank"]
            if below <= r < eq:
                out[t["name"]][1][t["p"]][t["j"]] = t["lo"]
            elif eq <= r < eq + held:
                if t["gather"]:
                    out[t["name"]][1][t["p"]][t["j"]] = got[f"{tag}|v"][r - eq]
                elif held <= gather:
                    rest.append({**t, "gather": True})
                else:
                    rest.append({**t, "known": (eq, held)})
            elif eq + held <= r < top:
                out[t["name"]][1][t["p"]][t["j"]] = t["hi"]
            else:  # the sketch missed: search the side that holds the rank
                lo, hi = (t["min"], t["lo"]) if r < below else (t["hi"], t["max"])
                rest.append({**t, "lo": lo, "hi": hi, "gather": False})
        todo = rest
    raise RuntimeError("order statistics did not converge")


def quantiles(df: DataFrame, series: dict[str, Column], probs: Sequence[float], **kw) -> dict[str, list[float | None]]:
    """Linearly interpolated exact quantiles, one list per series."""

    def around(n: int, p: float) -> list[int]:
        h = p * (n - 1)
        return [math.floor(h), math.ceil(h)]

    found = order_statistics(df, series, probs, around, **kw)
    out: dict[str, list[float | None]] = {}
    for name, (n, by_p) in found.items():
        vals = []
        for p in probs:
            if n == 0:
                vals.append(None)
                continue
            a, b = by_p[p]
            h = p * (n - 1)
            vals.append(float(a + (b - a) * (h - math.floor(h))))
        out[name] = vals
    return out
