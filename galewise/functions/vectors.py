"""Vector expressions on ``array<double>`` columns.

With a known width the sums are written out element by element, which keeps them in
generated code and, as aggregates, lets Spark combine them before the shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column, width: int | None = None) -> Column:
    """Inner product of two double vectors."""
    if width is None:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return reduce(add, [F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(width)])


def scale(vec: Column, factor: Column) -> Column:
    return F.transform(vec, lambda x: x * factor)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def sum_vectors(vec: Column, width: int) -> Column:
    """Aggregate: element-wise sum, combined map-side so a hot key stays small."""
    return F.array(*[F.sum(F.get(vec, F.lit(i))) for i in range(width)])


def append(vec: Column, value: Column) -> Column:
    """``[vec ‖ value]``, used to fold a bias or a constant 1 into a vector."""
    return F.concat(vec, F.array(value.cast("double")))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    """``ln(1 + e^x)`` without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda x: x / total)


def endpoint_mean(values: Column) -> Column:
    """Mean of the first and the last element."""
    return (F.element_at(values, 1) + F.element_at(values, -1)) * F.lit(0.5)


def sum_of_dots(target: Column, others: Column) -> Column:
    """Sum of the inner products of one vector with every vector of a list."""
    return F.aggregate(
        F.transform(others, lambda o: dot(target, o)), F.lit(0.0), lambda s, x: s + x
    )


def random_vector(key: Column, width: int, seed: int, spread: float = 0.05) -> Column:
    """Repeatable uniform start vector in ``(-spread, spread)`` for a key."""
    draws = [
        (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(2_000_003)) / 1_000_001.5 - 1.0)
        * spread
        for i in range(width)
    ]
    return F.array(*draws)
