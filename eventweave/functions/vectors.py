"""Vectors as ARRAY<DOUBLE> columns; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def total(vs: Column) -> Column:
    """Sum of an array of vectors; null for none."""
    return F.when(F.size(vs) > 0, F.aggregate(F.slice(vs, F.lit(2), F.greatest(F.size(vs) - 1, F.lit(0))), F.get(vs, F.lit(0)), add))


def mean(vs: Column) -> Column:
    """Mean of an array of vectors; null for none."""
    return F.when(F.size(vs) > 0, let(total(vs), lambda s: scale(s, F.size(vs).cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine for ranking: null where either vector is zero."""
    return let(norm(a) * norm(b), lambda n: F.when(n != 0, dot(a, b) / n))


def finite(a: Column) -> Column:
    """NaN as 0, infinities as the largest finite values."""
    big = F.lit(1.7976931348623157e308)
    return F.transform(a, lambda x: F.when(F.isnan(x), 0.0).when(x > big, big).when(x < -big, -big).otherwise(x))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Cosine for evaluation: 0 where either vector is zero; NaN counts as 0. Null only where a vector is null."""
    return F.when(a.isNotNull() & b.isNotNull(), let(finite(a), lambda x: let(finite(b), lambda y: F.coalesce(cosine(x, y), F.lit(0.0)))))


def cut(v: Column, keep: int, last: bool) -> Column:
    """The last (text files) or first (matrix files) `keep` numbers; all for a negative `keep`."""
    if keep < 0:
        return v
    start = F.greatest(F.size(v) - keep, F.lit(0)) + 1 if last else F.lit(1)
    return F.slice(v, start, F.lit(keep))


def centroid(lists: Column, head: int) -> Column:
    """Mean over non-empty lists of the mean of the first `head` vectors of each; a list is an array of structs with `vec`. Null if all are empty."""
    means = F.transform(F.filter(lists, lambda g: F.size(g) > 0), lambda g: let(F.transform(F.slice(g, 1, head), lambda e: e["vec"]), mean))
    return let(means, mean)


def rerank(g: Column, head: Column) -> Column:
    """Elements (label, vec, w) by cosine to `head`, highest first, with that score as `w`; equal scores keep their order, undefined scores come last."""
    scored = F.transform(g, lambda e, i: let(cosine(e["vec"], head), lambda s: F.struct(s.isNull().alias("none"), (-s).alias("key"), i.alias("i"), F.struct(e["label"].alias("label"), e["vec"].alias("vec"), s.alias("w")).alias("e"))))
    return F.transform(F.array_sort(scored), lambda x: x["e"])


#: Functions by name, for models and the command line: ranking (list, head vector) and representation (lists, head size).
WEIGHTS: dict[str, Callable[[Column, Column], Column]] = {"cosine": rerank}
REPRESENTATIONS: dict[str, Callable[[Column, int], Column]] = {"centroid": centroid}
