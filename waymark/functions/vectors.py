"""Vectors as columns, in double precision. Built of higher-order functions, so expressions do not grow with the dimension.

For joins of many vectors see operators.knn, which multiplies blocks of vectors instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def as_double(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(a), lambda x: x * x)))


def normalised(a: Column, added: float = 0.0, least: float = 0.0) -> Column:
    """a over its norm, to which `added` is added, or which is `least` at least. A zero vector over a zero norm is null."""
    size = norm(a) + F.lit(added) if added else norm(a)
    size = F.greatest(size, F.lit(least)) if least else size
    return F.transform(F.arrays_zip(as_double(a).alias("x"), F.array_repeat(size, F.size(a)).alias("n")), lambda z: F.try_divide(z["x"], z["n"]))


def cosine(a: Column, b: Column, normalise: bool = True) -> Column:
    """The dot product of vectors over (norm + 1e-8), or of raw ones."""
    if not normalise:
        return dot(a, b)
    return dot(a, b) / ((norm(a) + 1e-8) * (norm(b) + 1e-8))


def cosine_clamped(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """The product of the norms is eps at least."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


#: The similarity of each metric: greater is nearer. Euclidean is the negative square, without a root.
SIMILARITY = {
    "cosine": lambda a, b, normalise=True: cosine(a, b, normalise),
    "dot_product": lambda a, b, normalise=True: cosine(a, b, normalise),
    "euclidean": lambda a, b, normalise=True: -squared_l2(a, b),
    "manhattan": lambda a, b, normalise=True: -l1(a, b),
}


def similarity(metric: str, a: Column, b: Column, normalise: bool = True) -> Column:
    if metric not in SIMILARITY:
        raise ValueError(f"unknown similarity metric: {metric}")
    return SIMILARITY[metric](a, b, normalise)


def distance_of(sim: Column) -> Column:
    """1 - similarity, for every metric."""
    return F.lit(1.0) - sim


def cosface(cos: Column, is_class: Column, s: float = 30.0, m: float = 0.40) -> Column:
    """The margin logit."""
    return F.lit(s) * (cos - F.when(is_class, F.lit(m)).otherwise(F.lit(0.0)))


def gem(a: Column, p: float = 3.0, eps: float = 1e-6) -> Column:
    """The generalised mean of the elements, eps at least each."""
    return F.pow(_sum(F.transform(as_double(a), lambda x: F.pow(F.greatest(x, F.lit(eps)), F.lit(p)))) / F.size(a), F.lit(1.0 / p))


def mean(a: Column) -> Column:
    return _sum(as_double(a)) / F.size(a)


def deviation(a: Column) -> Column:
    """The unbiased standard deviation, in two passes."""
    centred = F.transform(F.arrays_zip(as_double(a).alias("x"), F.array_repeat(mean(a), F.size(a)).alias("m")), lambda z: (z["x"] - z["m"]) * (z["x"] - z["m"]))
    return F.sqrt(F.try_divide(_sum(centred), F.size(a) - 1))


def fingerprint(a: Column, digits: int = 4) -> Column:
    """struct(mean, std, min, max), each rounded half to even."""
    r = lambda c: F.bround(c, digits)
    return F.struct(r(mean(a)).alias("mean"), r(deviation(a)).alias("std"), r(F.array_min(as_double(a))).alias("min"), r(F.array_max(as_double(a))).alias("max"))


def all_close(a: Column, b: Column, atol: float = 1e-5, rtol: float = 1e-5) -> Column:
    """Every |x - y| is at most atol + rtol |y|."""
    return F.forall(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: ok)


def argmax(a: Column) -> Column:
    """The first place of the greatest element, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
