"""Least fixpoints of relations, semi-naive.

A round joins the newest rows only and keeps, by an anti join, what no earlier
round found. What was found lies in tables that are merged as the digits of a counter
to base 4 carry: after r rounds there are at most 3 log4(r) of them, and a row
is written again about log4(r) times, however many rounds follow.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from millrace.lineage import discard, stored


BASE = 4


class Found:
    """Rows found so far, told apart by ``keys`` (all columns by default); ``add`` takes new ones and gives those that are new as a written table."""

    def __init__(self, columns: list[str], keys: list[str] | None = None):
        self.columns, self.keys, self.tables, self.newest, self.merged = columns, keys or columns, [], None, None

    def add(self, rows: DataFrame) -> DataFrame:
        fresh = rows.select(*self.columns).distinct()
        for _, table in self.tables:
            fresh = fresh.join(table, self.keys, "left_anti")
        self.newest = stored(fresh)
        if self.merged is not None:  # only now has no plan more use for it
            discard(self.merged)
            self.merged = None
        return self.newest

    def keep(self) -> None:
        """Count the newest rows as found, when the round no longer needs them apart from the others."""
        self.tables.append((0, self.newest))
        while len(self.tables) >= BASE and self.tables[-1][0] == self.tables[-BASE][0]:
            full, rank = [t for _, t in self.tables[-BASE:]], self.tables[-1][0] + 1
            self.tables[-BASE:] = [(rank, stored(reduce(DataFrame.unionByName, full)))]
            for old in full:
                if old is self.newest:  # the next round still joins it
                    self.merged = old
                else:
                    discard(old)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t for _, t in self.tables])


def closure(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``start`` and all that ``step`` makes of rows found; ``step`` maps each row by itself, through joins with fixed tables."""
    found = Found(start.columns)
    newest = found.add(start)
    while not newest.isEmpty():
        found.keep()
        newest = found.add(step(newest))
    return found.all() if found.tables else newest
