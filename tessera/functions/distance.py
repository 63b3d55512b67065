"""Edit distance with adjacent transpositions, and deletion variants for finding candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa_distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance; ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        older, old = old, row
    return min(old[-1], most + 1)


def osa(a: Column, b: Column, most: int) -> Column:
    """``osa_distance`` of two columns, on Arrow batches; for candidates only."""

    @F.pandas_udf(T.IntegerType())
    def distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series([None if s is None or t is None else osa_distance(s, t, most) for s, t in zip(x, y, strict=True)], dtype="Int32")

    return distance(a, b)


def deletion_variants_of(term: str, most: int) -> set[str]:
    found, edge = {term}, {term}
    for _ in range(most):
        edge = {v[:i] + v[i + 1 :] for v in edge if len(v) > 1 for i in range(len(v))} - found
        found |= edge
    return found


def deletion_variants(term: Column, most: int = 2) -> Column:
    """The term and all strings left after deleting up to ``most`` of its characters, never the last one."""

    def once(t: Column) -> Column:
        gone = F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))
        return F.when(F.length(t) > 1, gone).otherwise(F.array(t))

    out = F.array(term)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, once))))
    return out
