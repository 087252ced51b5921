"""Exact quantiles whose memory need stays bounded however many values a column has.

The built-in exact ``percentile`` keeps every distinct value of its group in one
buffer. That is right for short columns and fatal for long ones, so a long column takes
three scans, together with all other columns: one mergeable sketch per column gives two
values around each wanted rank; counters of the values below and at these cut points place
the ranks exactly; an exact function picks them from the few values left between. Where
still too many are left, sketch and count are repeated for these. The counts verify every
step, so the result never depends on the sketch, and a cut point that many values share is
a result itself. Every step is a scan with map-side aggregation; no column is ever sorted
or shuffled as a whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseworks.functions.expr import number

DIRECT_LIMIT = 200_000
ACCURACY = 10_000


@dataclass
class _Rank:
    """Where the value of a rank, counted from 0, lies; ends are inclusive."""

    column: str
    rank: int
    inside: int
    below: int = 0
    low: float = -math.inf
    high: float = math.inf
    value: float | None = None  # once it is known

    def ends(self, accuracy: int) -> list[float]:
        """Two quantiles of the inside that enclose the rank, as far as a sketch can tell."""
        p = (self.rank - self.below) / max(self.inside - 1, 1)
        margin = 2.0 / accuracy + 1.0 / self.inside
        return [max(0.0, p - margin), min(1.0, p + margin)]

    def split(self, low: float, high: float, under: dict[float, int], at: dict[float, int]) -> None:
        """Keep the part that holds the rank: below ``low``, at it, between, at ``high``, above."""
        last = self.below + self.inside
        if self.rank < under[low]:
            self.high, self.inside = math.nextafter(low, -math.inf), under[low] - self.below
        elif self.rank < under[low] + at[low]:
            self.value = low
        elif self.rank < under[high]:
            self.low, self.high = math.nextafter(low, math.inf), math.nextafter(high, -math.inf)
            self.below = under[low] + at[low]
            self.inside = under[high] - self.below
        elif self.rank < under[high] + at[high]:
            self.value = high
        else:
            self.low, self.below = math.nextafter(high, math.inf), under[high] + at[high]
            self.inside = last - self.below


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    counts: dict[str, int] | None = None,
    direct_limit: int = DIRECT_LIMIT,
    accuracy: int = ACCURACY,
) -> dict[str, list[float] | None]:
    """Linear-interpolation quantiles per column; ``None`` for a column without values.

    ``counts`` passes the number of non-missing values where an earlier scan found it.
    ``direct_limit`` is how many values of a column a task may hold, ``accuracy`` the number
    of parts of about equal size that a sketch tells apart. Infinite values are values.
    """
    if not columns:
        return {}
    if counts is None:
        row = df.agg(*[F.count(number(df, c)) for c in columns]).first()
        counts = dict(zip(columns, row))
    result: dict[str, list[float] | None] = {c: None for c in columns}
    short = [c for c in columns if 0 < counts[c] <= direct_limit]
    if short:
        row = df.agg(
            *[
                F.percentile(number(df, c), [float(p) for p in probabilities]).alias(f"q{i}")
                for i, c in enumerate(short)
            ]
        ).first()
        result.update({c: list(q) for c, q in zip(short, row)})
    long = [c for c in columns if counts[c] > direct_limit]
    if long:
        result.update(_select(df, long, probabilities, counts, direct_limit, accuracy))
    return result


def _select(df, columns, probabilities, counts, limit, accuracy):
    places = {(c, p): p * (counts[c] - 1) for c in columns for p in probabilities}
    ranks = {
        (c, r): _Rank(c, r, counts[c])
        for (c, _), place in places.items()
        for r in (math.floor(place), math.ceil(place))
    }
    while open_ := [r for r in ranks.values() if r.value is None and r.inside > limit]:
        _narrow(df, open_, accuracy)
    _pick(df, [r for r in ranks.values() if r.value is None])
    out = {}
    for c in columns:
        out[c] = []
        for p in probabilities:
            place = places[(c, p)]
            low, high = (ranks[(c, f(place))].value for f in (math.floor, math.ceil))
            out[c].append(low if low == high else low + (high - low) * (place - math.floor(place)))
    return out


def _inside(df: DataFrame, r: _Rank) -> Column:
    value = number(df, r.column)
    if r.low == -math.inf and r.high == math.inf:
        return value
    return F.when((value >= r.low) & (value <= r.high), value)


def _narrow(df: DataFrame, ranks: list[_Rank], accuracy: int) -> None:
    """One sketch for each range of a column, then one scan that counts at all cut points."""
    ranges: dict[tuple, list[_Rank]] = {}
    for r in ranks:
        ranges.setdefault((r.column, r.low, r.high), []).append(r)
    groups = list(ranges.values())
    sketched = (
        df.select(*[_inside(df, g[0]).alias(f"v{i}") for i, g in enumerate(groups)])
        .agg(*[
            F.percentile_approx(f"v{i}", [e for r in g for e in r.ends(accuracy)], accuracy)
            for i, g in enumerate(groups)
        ])
        .first()
    )
    cuts = {}
    for g, values in zip(groups, sketched):
        for r, low, high in zip(g, values[::2], values[1::2]):
            cuts[r.column, r.rank] = (float(low), float(high))
    points = sorted({(c, v) for (c, _), pair in cuts.items() for v in pair})
    tests = []
    for i, (c, v) in enumerate(points):
        value = number(df, c)
        tests += [F.count_if(value < v).alias(f"u{i}"), F.count_if(value == v).alias(f"a{i}")]
    counted = df.agg(*tests).first()
    under: dict[str, dict] = {}
    at: dict[str, dict] = {}
    for i, (c, v) in enumerate(points):
        under.setdefault(c, {})[v], at.setdefault(c, {})[v] = counted[f"u{i}"], counted[f"a{i}"]
    for r in ranks:
        r.split(*cuts[r.column, r.rank], under[r.column], at[r.column])


def _pick(df: DataFrame, ranks: list[_Rank]) -> None:
    """The values at the wanted ranks.

    Inside a bracket a rank is known exactly, and a discrete percentile aimed at the
    middle of its step cannot slip to a neighbour.
    """
    if not ranks:
        return
    row = (
        df.select(*[_inside(df, r).alias(f"v{i}") for i, r in enumerate(ranks)])
        .agg(
            *[
                F.expr(
                    f"percentile_disc({(r.rank - r.below + 0.5) / r.inside!r}D) "
                    f"WITHIN GROUP (ORDER BY v{i})"
                )
                for i, r in enumerate(ranks)
            ]
        )
        .first()
    )
    for r, value in zip(ranks, row):
        r.value = value
