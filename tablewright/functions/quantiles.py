"""Exact quantiles of many columns without a sort and without a hot task.

`percentile` keeps every distinct value of a column in one buffer, which does
not survive a column of billions of values. Here a random sample of fixed size
only proposes a narrow interval around each wanted rank; exact counts then prove
that the rank lies inside it, and only values inside are grouped by value. All
passes read just the wanted columns and combine before the shuffle, so a value
that fills a third of the table costs one row per task, and what reaches one
task does not grow with the table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import double, quoted

ACCURACY = 10_000  # of the sketch over the sample
SAMPLE_VALUES = 1_000_000  # at most so many values per column propose an interval
SMALL_SAMPLE = 100_000  # and so many, or a fifth, of a small table
INSIDE_LIMIT = 1_000_000  # rows an interval may hold before its values are grouped
MAX_ROUNDS = 12
COLUMNS_PER_JOB = 40
_SEED = 20240607


@dataclass
class _Interval:
    column: str
    rank: int  # 0-based rank of the lower order statistic
    low: float
    high: float
    last: int  # rank of the upper order statistic
    below: int = 0  # values < low
    at_low: int = 0  # values = low
    inside: int = 0  # low < values < high
    upto: int = 0  # values <= high

    def covers(self) -> bool:
        return self.below <= self.rank and self.last < self.upto


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    inside_limit: int = INSIDE_LIMIT,
    sample_values: int = SAMPLE_VALUES,
    rows: int | None = None,
) -> dict[str, dict[float, float | None]]:
    """Linearly interpolated quantiles, `{column: {p: value}}`; None if no values.

    The result has one number per column and probability, so it is returned to
    the caller as plain numbers that later plans use as literals. `rows` saves a
    count when the caller knows the number of rows; it only sizes the sample.
    """
    found: dict[str, dict[float, float | None]] = {}
    names = list(wanted)
    if names and rows is None:
        rows = df.count()
    for start in range(0, len(names), COLUMNS_PER_JOB):
        part = {name: wanted[name] for name in names[start : start + COLUMNS_PER_JOB]}
        found.update(_quantiles(df, part, inside_limit, sample_values, rows))
    return found


def approx_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], accuracy: int = ACCURACY
) -> dict[str, dict[float, float | None]]:
    """One-pass sketch quantiles (an observed value, rank error 1/accuracy)."""
    names = list(wanted)
    row = df.selectExpr(
        *[
            f"percentile_approx(CAST({quoted(n)} AS DOUBLE), array({', '.join(map(double, wanted[n]))}), {accuracy}) AS q{i}"
            for i, n in enumerate(names)
        ]
    ).first()
    return {
        n: dict(zip(wanted[n], row[f"q{i}"] or [None] * len(wanted[n])))
        for i, n in enumerate(names)
    }


def _quantiles(df, wanted, inside_limit, sample_values, rows):
    names = list(wanted)
    values = df.selectExpr(
        *[f"nanvl(CAST({quoted(n)} AS DOUBLE), CAST(NULL AS DOUBLE)) AS v{i}" for i, n in enumerate(names)],
        f"rand({_SEED}) AS u",
    )
    share = min(1.0, min(sample_values, max(SMALL_SAMPLE, rows // 5)) / max(rows, 1))
    drawn = "" if share == 1.0 else f" FILTER (WHERE u < {double(share)})"
    summary = values.selectExpr(
        *[
            text
            for i, n in enumerate(names)
            for text in (
                f"count(v{i}) AS n{i}",
                f"min(v{i}) AS lo{i}",
                f"max(v{i}) AS hi{i}",
                f"{_sketch(f'v{i}', _ends(wanted[n], _margin(rows, share)))}{drawn} AS q{i}",
            )
        ]
    ).first()

    totals = {n: summary[f"n{i}"] for i, n in enumerate(names)}
    outer = {f"v{i}": (summary[f"lo{i}"], summary[f"hi{i}"]) for i in range(len(names))}
    intervals: dict[tuple[str, float], _Interval] = {}
    for i, n in enumerate(names):
        for k, p in enumerate(wanted[n] if totals[n] else ()):
            rank = math.floor(_position(totals[n], p))
            ends = (summary[f"q{i}"] or [])[2 * k : 2 * k + 2] or outer[f"v{i}"]
            intervals[n, p] = _Interval(f"v{i}", rank, *ends, min(rank + 1, totals[n] - 1))

    # Tighten only where an interval holds too many rows to be grouped by value.
    held = 2 * _margin(rows, share)
    wide = [item for (n, _), item in intervals.items() if totals[n] * held > inside_limit]
    _tighten(values, wide, outer, inside_limit, sample_values)
    statistics = _order_statistics(values, intervals)
    missed = {key: item for key, item in intervals.items() if None in statistics[key]}
    if missed:  # the sample was off: start again from the whole range
        for item in missed.values():
            item.low, item.high = outer[item.column]
        _tighten(values, list(missed.values()), outer, inside_limit, sample_values)
        statistics.update(_order_statistics(values, missed))

    result: dict[str, dict[float, float | None]] = {}
    for n in names:
        result[n] = {}
        for p in wanted[n]:
            if not totals[n]:
                result[n][p] = None
                continue
            position = _position(totals[n], p)
            share = position - math.floor(position)
            lower, upper = statistics[n, p]
            result[n][p] = lower if share == 0 or lower == upper else lower + (upper - lower) * share
    return result


def _position(total: int, p: float) -> float:
    return (total - 1) * p


def _margin(rows: int, share: float) -> float:
    """How far, in rank share, a proposal may be off: five standard errors and the sketch."""
    error = 0.0 if share >= 1.0 else 2.5 / math.sqrt(max(rows * share, 1.0))
    return error + 3.0 / ACCURACY


def _ends(probabilities: Sequence[float], margin: float) -> list[float]:
    return [x for p in probabilities for x in (max(0.0, p - margin), min(1.0, p + margin))]


def _sketch(value: str, probabilities: Sequence[float]) -> str:
    return f"percentile_approx({value}, array({', '.join(map(double, probabilities))}), {ACCURACY})"


def _tighten(
    values: DataFrame, intervals: Sequence[_Interval], outer: Mapping, inside_limit: int, sample_values: int
) -> None:
    """Shrink intervals until few enough values lie strictly inside; exact counts check each step."""
    pending = list(intervals)
    _measure(values, pending)
    for item in pending:
        if not item.covers():
            item.low, item.high = outer[item.column]
            _measure(values, [item])
    for _ in range(MAX_ROUNDS):
        pending = [item for item in pending if item.inside > inside_limit]
        if not pending:
            return
        _narrow(values, pending, sample_values)


def _measure(values: DataFrame, intervals: Sequence[_Interval]) -> None:
    """Exact counts left of, at the ends of and inside each interval."""
    if not intervals:
        return
    row = values.selectExpr(
        *[
            f"count_if({item.column} {test}) AS c{i}_{j}"
            for i, item in enumerate(intervals)
            for j, test in enumerate(
                (f"< {double(item.low)}", f"<= {double(item.low)}", f"< {double(item.high)}", f"<= {double(item.high)}")
            )
        ]
    ).first()
    for i, item in enumerate(intervals):
        item.below, to_low, before_high, item.upto = (row[f"c{i}_{j}"] for j in range(4))
        item.at_low = to_low - item.below
        item.inside = max(before_high - to_low, 0)


def _narrow(values: DataFrame, intervals: Sequence[_Interval], sample_values: int) -> None:
    """Propose a smaller interval from a sample of the strictly inside values."""
    aggregates = []
    for i, item in enumerate(intervals):
        share = min(1.0, sample_values / item.inside)
        margin = _margin(item.inside, share)
        first = (item.rank - item.below - item.at_low) / item.inside
        second = (item.rank + 1 - item.below - item.at_low) / item.inside
        ends = [min(1.0, max(0.0, first - margin)), min(1.0, max(0.0, second + margin))]
        inside = f"{item.column} > {double(item.low)} AND {item.column} < {double(item.high)}"
        aggregates.append(f"{_sketch(item.column, ends)} FILTER (WHERE {inside} AND u < {double(share)}) AS q{i}")
    row = values.selectExpr(*aggregates).first()
    tried = []
    for i, item in enumerate(intervals):
        low, high = row[f"q{i}"] or (item.low, item.high)
        first = item.rank - item.below - item.at_low
        tried.append(
            replace(
                item,
                low=item.low if first < 0 else low,
                high=item.high if first + 1 >= item.inside else high,
            )
        )
    _measure(values, tried)
    for item, smaller in zip(intervals, tried):
        if smaller.covers():
            item.__dict__.update(smaller.__dict__)


def _order_statistics(values: DataFrame, intervals: Mapping) -> dict:
    """The two neighbouring values of every wanted rank; None outside the intervals.

    Intervals cut the range of a column into cells. Every value falls into one
    cell; values between intervals are only counted per cell, values inside an
    interval per value. Running counts over (cell, value) then name the ranks.
    """
    if not intervals:
        return {}
    columns = sorted({item.column for item in intervals.values()})
    cells = []
    for place, column in enumerate(columns):
        branches = [f"WHEN {column} IS NULL THEN NULL"]
        number = 0
        for low, high in _disjoint([(i.low, i.high) for i in intervals.values() if i.column == column]):
            branches.append(f"WHEN {column} < {double(low)} THEN {_cell(place, number)}")
            branches.append(f"WHEN {column} <= {double(high)} THEN {_cell(place, number + 1, column)}")
            number += 2
        cells.append(f"CASE {' '.join(branches)} ELSE {_cell(place, number)} END")
    counts = (
        values.selectExpr(f"explode(array({', '.join(cells)})) AS t")
        .where("t IS NOT NULL")
        .groupBy("t.c", "t.k", "t.v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # A column has at most `inside_limit` distinct values per interval here, and
    # one row per cell between intervals.
    order = Window.partitionBy("c").orderBy("k", "v").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("upto", F.sum("n").over(order))
    ranks = sorted({(columns.index(i.column), r) for i in intervals.values() for r in (i.rank, i.last)})
    hit = " OR ".join(f"(c = {place} AND upto > {rank} AND upto - n <= {rank})" for place, rank in ranks)
    rows = running.where(hit).collect()  # at most two per column and probability

    def value_at(column, rank):
        return next(
            r["v"] for r in rows if columns[r["c"]] == column and r["upto"] > rank >= r["upto"] - r["n"]
        )

    return {
        key: (value_at(item.column, item.rank), value_at(item.column, item.last))
        for key, item in intervals.items()
    }


def _cell(place: int, number: int, value: str = "CAST(NULL AS DOUBLE)") -> str:
    return f"named_struct('c', {place}, 'k', {number}, 'v', {value})"


def _disjoint(ranges: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Ranges in order, overlapping ones merged."""
    merged: list[tuple[float, float]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged
