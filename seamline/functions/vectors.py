"""Vector expressions on array columns; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seamline.functions.text import bind


def cut(vector: Column, dim: int) -> Column:
    """The first `dim` components."""
    return F.slice(vector, 1, dim)


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_normalise(vector: Column) -> Column:
    """Unit length as array<float>; a zero vector stays zero."""

    def scale(norm):
        divisor = F.when(norm == 0, 1.0).otherwise(norm)
        return F.transform(vector, lambda x: (x.cast("double") / divisor).cast("float"))

    return bind(F.sqrt(inner_product(vector, vector)), scale)


def checked_dim(vector: Column, dim: int) -> Column:
    """The vector, or an error that ends the job when its length is not `dim` or a component is not finite."""
    message = F.concat(
        F.lit(f"vector length must be {dim}, got "), F.coalesce(F.size(vector), F.lit(-1)).cast("string")
    )
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    strange = F.raise_error(F.lit("vector components must be finite"))
    return F.when(F.size(vector) != dim, F.raise_error(message)).when(finite, vector).when(
        F.size(vector) >= 0, strange
    ).otherwise(F.raise_error(message))
