"""Operators and casts that a user names, resolved by the operands' types."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Operators:
    """CREATE OPERATOR and CREATE CAST. Types are Spark's simple names (`int`, `double`)."""

    def __init__(self) -> None:
        self._operators: dict[tuple[str, str | None, str], Callable[..., Column]] = {}
        self._casts: dict[tuple[str, str], Callable[[Column], Column]] = {}

    def operator(self, name: str, left: str | None, right: str, function: Callable[..., Column]) -> None:
        """left: None for a prefix operator."""
        self._operators[name, left, right] = function

    def cast(self, source: str, target: str, function: Callable[[Column], Column]) -> None:
        """An implicit cast, used where no operator takes the types as they are."""
        self._casts[source, target] = function

    def _forms(self, column: str, kind: str) -> list[tuple[int, str, Column]]:
        own = [(0, kind, F.col(column))]
        return own + [(1, to, f(F.col(column))) for (source, to), f in self._casts.items() if source == kind]

    def apply(self, df: DataFrame, left: str | None, name: str, right: str) -> Column:
        """`left name right` over df's columns: the operator that needs the fewest casts; none, or several with as few, is an error."""
        kinds = dict(df.dtypes)
        lefts = [(0, None, None)] if left is None else self._forms(left, kinds[left])
        found = []
        for (cost, a, x), (more, b, y) in product(lefts, self._forms(right, kinds[right])):
            if f := self._operators.get((name, a, b)):
                found.append((cost + more, f, [y] if left is None else [x, y]))
        best = [f for f in found if f[0] == min(c for c, _, _ in found)]
        if len(best) != 1:
            raise ValueError(f"{len(best)} operators {name} for {kinds.get(left)} and {kinds[right]}")
        return best[0][1](*best[0][2])
