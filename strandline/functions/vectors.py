"""Vector functions on array columns, inside the JVM, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    terms = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scale(v, by) -> Column:
    return F.transform(col(v), lambda x: x.cast("double") * by)


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once for a row: inside a lambda, a column expression would be
    computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(v, strict: bool = False) -> Column:
    """Unit length. A zero vector stays zero, or raises where strict."""

    def unit(a: Column) -> Column:
        n = norm(a)
        safe = F.when(n > 0, n).otherwise(F.raise_error(F.lit("zero vector")).cast("double")) if strict else F.greatest(n, F.lit(TINY))
        return bind(F.struct(a.alias("a"), safe.alias("n")), lambda s: F.transform(s["a"], lambda x: x.cast("double") / s["n"]))

    return bind(col(v), unit)


def cosine(a, b) -> Column:
    """0 where either vector is zero."""
    both = F.struct(dot(a, b).alias("d"), (norm(a) * norm(b)).alias("n"))
    return bind(both, lambda s: F.when(s["n"] == 0, F.lit(0.0)).otherwise(s["d"] / s["n"]))


def prefix(v, size: int, strict: bool = True) -> Column:
    """The first values, scaled to unit length again."""
    return normalise(F.slice(col(v), 1, size), strict)


def fuse(a, b, weight: float = 1.0, normalise_inputs: bool = True, final: bool = True) -> Column:
    """Concatenation with the second vector weighted."""
    if normalise_inputs:
        a, b = normalise(a), normalise(b)
    parts = F.struct(col(a).alias("a"), col(b).alias("b"))
    both = bind(parts, lambda s: F.concat(F.transform(s["a"], lambda x: x.cast("double")), scale(s["b"], F.lit(float(weight)))))
    return normalise(both) if final else both


def is_finite(v) -> Column:
    return F.forall(col(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
