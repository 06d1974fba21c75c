"""Exact quantiles without gathering a column in one task.

A column of bounded length goes through the built-in ``percentile``. A longer one is narrowed:
a rank sketch gives an interval around each wanted rank, a second pass counts exactly what lies
below and inside, and this repeats on the interval until what is left is small enough to sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Mapping, Optional, Sequence

from pyspark.sql import DataFrame, functions as F

from grainsift.functions.columns import double_literal
from grainsift.operators.aggkit import spread

DIRECT_LIMIT = 1_000_000
SORT_LIMIT = 100_000
SKETCH_ACCURACY = 10_000

Quantiles = dict[str, list[Optional[float]]]


@dataclass
class _Rank:
    """One wanted order statistic and the open interval that still holds it."""

    column: str
    rank: int
    inside: int
    below: int = 0
    low: Optional[float] = None
    high: Optional[float] = None
    value: Optional[float] = None

    def within(self) -> str:
        parts = [f"{self.column} IS NOT NULL"]
        if self.low is not None:
            parts.append(f"{self.column} > {double_literal(self.low)}")
        if self.high is not None:
            parts.append(f"{self.column} < {double_literal(self.high)}")
        return " AND ".join(parts)

    @property
    def share(self) -> float:
        return (self.rank - self.below) / max(self.inside - 1, 1)


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, tuple[str, Sequence[float]]],
    direct_limit: Optional[int] = None,
    sort_limit: Optional[int] = None,
    sizes: Optional[Mapping[str, int]] = None,
) -> Quantiles:
    """Linearly interpolated quantiles for each name: ``{name: (double as SQL, probabilities)}``.

    The result holds one number per name and probability and goes to the driver, where callers
    use it as literals in the next scan. ``sizes`` are the numbers of present values, when known.
    """
    direct_limit = DIRECT_LIMIT if direct_limit is None else direct_limit
    sort_limit = SORT_LIMIT if sort_limit is None else sort_limit
    if not wanted:
        return {}
    names = list(wanted)
    column = {c: f"x{i}" for i, c in enumerate(names)}
    data = df.selectExpr(*[f"{wanted[c][0]} AS {column[c]}" for c in names])
    if sizes is None:
        counts = data.agg(*[F.expr(f"count({column[c]})") for c in names]).first()
        sizes = dict(zip(names, counts))
    data = spread(data)
    result: Quantiles = {c: [None] * len(wanted[c][1]) for c in names}

    short = [c for c in names if 0 < sizes[c] <= direct_limit]
    if short:
        row = data.agg(*[F.expr(f"percentile({column[c]}, array({', '.join(double_literal(float(p)) for p in wanted[c][1])}))")
                         for c in short]).first()
        for c, values in zip(short, row):
            result[c] = list(values)

    long = [c for c in names if sizes[c] > direct_limit]
    if long:
        ranks = {(c, r): _Rank(column[c], r, sizes[c])
                 for c in long for p in wanted[c][1]
                 for r in {math.floor(p * (sizes[c] - 1)), math.ceil(p * (sizes[c] - 1))}}
        _resolve(data, list(ranks.values()), sort_limit)
        for c in long:
            for i, p in enumerate(wanted[c][1]):
                position = p * (sizes[c] - 1)
                low, high = math.floor(position), math.ceil(position)
                a, b = ranks[(c, low)].value, ranks[(c, high)].value
                result[c][i] = a if low == high else a + (b - a) * (position - low)
    return result


def _resolve(data: DataFrame, ranks: list[_Rank], sort_limit: int) -> None:
    while True:
        wide = [r for r in ranks if r.value is None and r.inside > sort_limit]
        if not wide:
            break
        _narrow(data, wide)
    # each interval left is known to hold at most ``sort_limit`` values
    intervals: dict[str, list[_Rank]] = {}
    for r in ranks:
        if r.value is None:
            intervals.setdefault(r.within(), []).append(r)
    if not intervals:
        return
    row = data.agg(*[
        F.expr(f"transform(array({', '.join(str(r.rank - r.below) for r in group)}), k -> get(sort_array("
               f"collect_list(CASE WHEN {where} THEN {group[0].column} END)), k))")
        for where, group in intervals.items()]).first()
    for values, group in zip(row, intervals.values()):
        for r, value in zip(group, values):
            r.value = value


def _clusters(ranks: list[_Rank], slack: float) -> list[list[_Rank]]:
    """Ranks of one interval that lie closer together than the sketch can tell apart."""
    out: list[list[_Rank]] = []
    for r in sorted(ranks, key=lambda r: r.rank):
        if out and r.share - out[-1][-1].share <= slack:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def _narrow(data: DataFrame, ranks: list[_Rank]) -> None:
    """Shrink every interval: one pass for the sketches, one to count around the new ends."""
    slack = 2.0 / SKETCH_ACCURACY
    intervals: dict[str, list[_Rank]] = {}
    for r in ranks:
        intervals.setdefault(r.within(), []).append(r)
    clusters = {where: _clusters(group, slack) for where, group in intervals.items()}
    sketches = []
    for where, found in clusters.items():
        ends = [e for c in found for e in (max(0.0, c[0].share - slack), min(1.0, c[-1].share + slack))]
        sketches.append(F.expr(
            f"percentile_approx(CASE WHEN {where} THEN {found[0][0].column} END, "
            f"array({', '.join(double_literal(e) for e in ends)}), {SKETCH_ACCURACY})"))
    brackets = []
    for ends, found in zip(data.agg(*sketches).first(), clusters.values()):
        brackets += [(c, ends[2 * i], ends[2 * i + 1]) for i, c in enumerate(found)]
    counts = []
    for c, low, high in brackets:
        x, a, b = c[0].column, double_literal(low), double_literal(high)
        counts += [f"count_if({c[0].within()} AND {x} < {a})", f"count_if({x} = {a})",
                   f"count_if({x} > {a} AND {x} < {b})", f"count_if({x} = {b})"]
    found = data.agg(*[F.expr(e) for e in counts]).first()
    for i, (cluster, low, high) in enumerate(brackets):
        under, at_low, between, at_high = found[4 * i:4 * i + 4]
        if low == high:
            at_high = 0
        for r in cluster:
            k = r.rank - r.below
            if k < under:
                r.high, r.inside = low, under
            elif k < under + at_low:
                r.value = low
            elif k < under + at_low + between:
                r.below += under + at_low
                r.low, r.high, r.inside = low, high, between
            elif k < under + at_low + between + at_high:
                r.value = high
            else:
                passed = under + at_low + between + at_high
                r.below += passed
                r.low, r.inside = high, r.inside - passed
