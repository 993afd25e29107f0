"""Column expressions over probability vectors and points; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(q: Column) -> Column:
    return F.aggregate(q, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def argmax(q: Column) -> Column:
    """The first position of the largest entry, from 0."""
    return (F.array_position(q, F.array_max(q)) - 1).cast("int")


def entropy(q: Column) -> Column:
    """-sum q ln q with q clipped to [1e-12, 1]."""
    return -total(F.transform(q, lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-12)) * F.ln(F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-12)))))


def entropy_norm(q: Column) -> Column:
    """Entropy over ln N; 0 for vectors of one entry."""
    return F.when(F.size(q) > 1, entropy(q) / F.ln(F.size(q).cast("double"))).otherwise(0.0)


def gini_confidence(q: Column) -> Column:
    """(1 - sum q^2) / (1 - 1/N) of the row, clipped to [0, 1] and normalised; 0 for one entry."""
    clipped = F.transform(q, lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))
    s = total(clipped)
    share = F.transform(clipped, lambda x: F.when(s > 0, x / s).otherwise(1.0 / F.size(q)))
    return F.when(F.size(q) > 1, (1 - total(F.transform(share, lambda x: x * x))) / (1 - 1.0 / F.size(q))).otherwise(0.0)


def own(q: Column, state: Column) -> Column:
    """q[state] of labelled rows, else NULL."""
    return F.when(state >= 0, F.get(q, state))


def top_two(q: Column) -> tuple[Column, Column]:
    ordered = F.reverse(F.array_sort(q))
    return F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def square_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
