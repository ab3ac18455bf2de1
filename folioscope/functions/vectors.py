"""Vector and geometry functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision; vectors of different length give null."""
    total = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(_c(a)) == F.size(_c(b)), total)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine with 1e-12 added to either norm, so an all-zero vector has similarity 0."""
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def softmax(a: Column | str) -> Column:
    """Of an array; empty stays empty."""
    e = F.transform(_c(a), lambda x: F.exp(x.cast("double") - F.array_max(_c(a)).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def box(c: Column | str) -> Column:
    """Four doubles or an empty array; anything else is no box."""
    b = F.transform(_c(c), lambda x: x.try_cast("double"))
    return F.when((F.size(b) == 4) & ~F.exists(b, lambda x: x.isNull()), b).otherwise(F.array().cast("array<double>"))


def box_distance(a: Column | str, b: Column | str) -> Column:
    """Distance between the centres of two boxes."""
    a, b = _c(a), _c(b)
    dx = (a[0] + a[2] - b[0] - b[2]) / 2
    dy = (a[1] + a[3] - b[1] - b[3]) / 2
    return F.sqrt(dx * dx + dy * dy)


def figure_score(caption: Column | str, page: Column | str, bbox: Column | str) -> Column:
    """10, +3 with a caption, +.8 a page before the fourth, +1 per 100,000 of area up to 10, +1.5 per overview cue."""
    cap = F.lower(F.trim(F.coalesce(_c(caption), F.lit(""))))
    b = box(bbox)
    side = lambda i, j: F.when(F.size(b) == 4, F.greatest(F.lit(0.0), F.try_element_at(b, F.lit(j)) - F.try_element_at(b, F.lit(i)))).otherwise(0.0)
    area = side(1, 3) * side(2, 4)
    cues = ("figure 1", "overview", "architecture", "framework", "pipeline", "system overview")
    hits = sum((cap.contains(k).cast("int") for k in cues), F.lit(0))
    return F.lit(10.0) + F.when(cap != "", 3.0).otherwise(0.0) + F.greatest(F.lit(0.0), F.lit(4.0) - _c(page)) * 0.8 + F.least(area, F.lit(1e6)) / 1e5 + hits * 1.5
