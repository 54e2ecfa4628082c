"""Vector and matrix arithmetic on ARRAY<DOUBLE> columns, left to right so that results don't depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = F.lit


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(factor: Column | float, a: Column) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(a, lambda x: factor * x)


def axpy(factor: Column | float, a: Column, b: Column) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.zip_with(a, b, lambda x, y: factor * x + y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return norm(subtract(a, b))


def outer(a: Column, b: Column) -> Column:
    """Rows of the outer product."""
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def symmetric_update(factor: float, x: Column, a: Column) -> Column:
    """a + factor * x xᵀ."""
    return F.zip_with(a, outer(x, x), lambda r, s: F.zip_with(r, s, lambda u, v: u + F.lit(float(factor)) * v))


def all_equal(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)


def sparse(a: Column) -> Column:
    """struct(size, indices, values) of the elements that aren't zero."""
    at = F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    return F.struct(F.size(a).alias("size"), F.transform(at, lambda p: p["i"]).alias("indices"), F.transform(at, lambda p: p["x"]).alias("values"))


def dense(s: Column) -> Column:
    pairs = F.map_from_arrays(s["indices"], s["values"])
    return F.transform(F.sequence(F.lit(0), s["size"] - 1), lambda i: F.coalesce(F.element_at(pairs, i), F.lit(0.0)))


def sparse_dot(s: Column, t: Column) -> Column:
    """Dot product of two sparse vectors by their common indices."""
    other = F.map_from_arrays(t["indices"], t["values"])
    return total(F.zip_with(s["indices"], s["values"], lambda i, x: x * F.coalesce(F.element_at(other, i), F.lit(0.0))))


def coo(size: Column, indices: Column, values: Column) -> Column:
    """Sparse vector of (index, value) pairs in any order; values of one index are added up."""
    keys = F.array_sort(F.array_distinct(indices))
    pairs = F.zip_with(indices, values, lambda i, x: F.struct(i.alias("i"), x.alias("x")))
    sums = F.transform(keys, lambda k: total(F.transform(F.filter(pairs, lambda p: p["i"] == k), lambda p: p["x"])))
    return F.struct(size.alias("size"), keys.alias("indices"), sums.alias("values"))


def with_element(a: Column, index: int, value: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == index, value).otherwise(x))


def integral(a: Column) -> Column:
    """Whether all elements are whole numbers; an empty vector's are."""
    return F.forall(a, lambda x: x == F.floor(x))


def polynomial(features: Column, degree: int = 2) -> Column:
    """Every round appends the products of what there is with each feature, so terms of equal powers recur."""
    out = features
    for _ in range(degree - 1):
        grown = F.flatten(F.transform(out, lambda a: F.transform(features, lambda f: a * f)))
        out = F.concat(out, grown)
    return out


def without(a: Column, drop: list[int]) -> Column:
    """The elements whose positions aren't in drop; with fewer elements than that there is nothing to keep, an error."""
    enough = F.assert_true(F.size(a) > len(set(drop)), "more features dropped than there are")
    return F.filter(F.when(enough.isNull(), a), lambda x, i: ~i.isin(*drop)) if drop else a


def nearest(x: Column, centroids: list[list[float]]) -> Column:
    """Index of the nearest centroid, the first of equally near ones."""
    d = distances(x, centroids)
    return F.array_position(d, F.array_min(d)).cast("int") - 1


def distances(x: Column, centroids: list[list[float]]) -> Column:
    return F.array(*[distance(x, F.array(*[F.lit(float(v)) for v in c])) for c in centroids])


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
