"""Dense vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dawnpress.functions.text import bound


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """Unit vector; a (near) zero vector is returned unchanged."""
    length = lambda n: F.when(n <= 1e-12, 1.0).otherwise(n)
    return bound(a, lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / length(n))))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale <= 0, 0.0).otherwise(dot(a, b) / scale)


def interaction_features(user: Column, item: Column) -> Column:
    """user, item, their product and their absolute difference, concatenated."""
    product = F.zip_with(user, item, lambda u, i: u * i)
    distance = F.zip_with(user, item, lambda u, i: F.abs(u - i))
    return F.concat(user, item, product, distance)
