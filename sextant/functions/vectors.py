"""Column functions on vectors: cosine, shortening, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ADD = lambda a, x: a + x


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), _ADD)


def norm(vec: Column) -> Column:
    return F.sqrt(_sum(F.transform(vec, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if a norm is 0."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot / F.when(size != 0, size))


def truncate_mrl(vec: Column, dim: int) -> Column:
    """The first ``dim`` entries at unit length; unchanged if dim is 0 or not shorter."""
    if dim <= 0:
        return vec.cast("array<double>")
    head = F.transform(F.slice(vec, 1, dim), lambda x: x.cast("double"))
    size = norm(head)
    unit = F.transform(head, lambda x: x / F.when(size > 0, size).otherwise(F.lit(1.0)))
    return F.when(F.size(vec) > dim, unit).otherwise(vec.cast("array<double>"))


def cache_key(text: Column, model_tag: str, dim: int) -> Column:
    """The content address of an embedded text."""
    return F.sha2(F.concat_ws("\u0000", F.lit(model_tag), F.lit(str(dim)), text), 256)
