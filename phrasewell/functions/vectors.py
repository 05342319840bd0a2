"""Vector maths on array columns. Sums run in DOUBLE; a vector of another length gives NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def l2_normalize(v: Column) -> Column:
    """Unit-length vector; a zero vector gives NULL components."""
    return F.zip_with(v, F.array_repeat(norm(v), F.size(v)), lambda x, n: F.try_divide(x, n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
        )
    )


def flatten_stack(stack: Column) -> Column:
    """A stack of matrices becomes a stack of vectors, one per matrix."""
    return F.transform(stack, lambda m: F.flatten(m))


def same_length(vectors: Column) -> Column:
    """Whether all vectors of a stack have the length of the first one."""
    return F.forall(vectors, lambda v: F.size(v) == F.size(F.get(vectors, F.lit(0))))


def checked_stack(vectors: Column) -> Column:
    """The stack itself; one with vectors of unequal lengths ends the job with an error."""
    told = F.concat(F.lit("vectors of unequal lengths: "), F.to_json(F.transform(vectors, lambda v: F.size(v))))
    return F.when(F.coalesce(same_length(vectors), F.lit(True)), vectors).otherwise(F.raise_error(told))


def _per_dimension(vectors: Column, fold: Callable[[Column], Column]) -> Column:
    width = F.size(F.get(vectors, F.lit(0)))
    columns = F.transform(
        F.sequence(F.lit(0), width - 1), lambda d: F.transform(vectors, lambda v: F.get(v, d))
    )
    return F.when(width > 0, F.transform(columns, fold))


def mean_vector(vectors: Column) -> Column:
    return _per_dimension(vectors, lambda xs: F.try_divide(total(xs), F.size(xs)))


def median_vector(vectors: Column) -> Column:
    """Element-wise median; an even count takes the mean of the middle two."""
    ordered = _per_dimension(vectors, lambda xs: F.array_sort(xs))
    return F.transform(
        ordered,
        lambda xs: (
            F.get(xs, F.floor((F.size(xs) - 1) / 2).cast("int"))
            + F.get(xs, F.floor(F.size(xs) / 2).cast("int"))
        )
        / 2,
    )


def mean_pairwise_distance(vectors: Column) -> Column:
    """Mean Euclidean distance over the pairs of one bounded array; NULL below two vectors."""
    n = F.size(vectors)
    summed = F.aggregate(
        F.sequence(F.lit(1), n - 1),
        F.lit(0.0),
        lambda acc, i: acc
        + F.aggregate(
            F.slice(vectors, F.lit(1), i),
            F.lit(0.0),
            lambda inner, v: inner + euclidean(v, F.get(vectors, i)),
        ),
    )
    return F.when(n > 1, summed / (n * (n - 1) / 2))


def mean_pairwise_cosine(vectors: Column) -> Column:
    """Mean cosine over the pairs, from the length of the sum of the unit vectors.

    A zero vector counts as cosine 0 with every other one; NULL below two vectors.
    """
    n = F.size(vectors)
    units = F.transform(
        vectors, lambda v: F.transform(l2_normalize(v), lambda x: F.coalesce(x, F.lit(0.0)))
    )
    ones = total(F.transform(vectors, lambda v: F.when(squared_norm(v) > 0, 1.0).otherwise(0.0)))
    mean = mean_vector(units)
    return F.when(n > 1, (squared_norm(mean) * n * n - ones) / (n * (n - 1)))
