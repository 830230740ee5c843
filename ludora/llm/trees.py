"""Boosted trees of pyspark.ml as plain values and as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, functions as F

#: (feature, operator, threshold)
Test = tuple[int, str, float]
HEAD = re.compile(r"^\w*DecisionTree\w*Model\b")
LINE = re.compile(r"^( *)(?:(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)|Predict: ([-\d.Ee]+))$")


def paths(debug: str) -> Iterator[tuple[list[Test], float | None]]:
    """Each node below the root as the tests that lead to it; leaves with their prediction, others with None."""
    trail: list[tuple[int, Test]] = []
    for line in debug.splitlines():
        if not (m := LINE.match(line)):
            if line.strip() and not HEAD.match(line):
                raise ValueError(f"a line of a tree that can't be read: {line!r}")
            continue
        depth = len(m[1])
        if m[6] is not None:
            trail = [x for x in trail if x[0] < depth]
            yield [t for _, t in trail], float(m[6])
        else:
            trail = [x for x in trail if x[0] < depth] + [(depth, (int(m[3]), m[4], float(m[5])))]
            yield [t for _, t in trail], None


def holds(tests: list[Test], names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(names[i]) <= t if op == "<=" else F.col(names[i]) > t for i, op, t in tests], F.lit(True))


def margin(debugs: list[str], weights: list[float], names: list[str]) -> Column:
    """Weighted sum of the trees' predictions."""
    total = F.lit(0.0)
    for debug, weight in zip(debugs, weights, strict=True):
        case = None
        for tests, value in paths(debug):
            if value is not None:
                case = F.when(holds(tests, names), value * weight) if case is None else case.when(holds(tests, names), value * weight)
        total = total + (case.otherwise(0.0) if case is not None else F.lit(0.0))
    return total
