"""Column expressions on points, probabilities and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SCALE


def um_distance(a: str, b: str) -> Column:
    """Distance in micrometres of the points in columns ``<a>z, <a>y, <a>x`` and ``<b>z ...``."""
    terms = []
    for axis, step in zip("zyx", SCALE, strict=True):
        d = (F.col(a + axis) - F.col(b + axis)) * step
        terms.append(d * d)
    return F.sqrt(terms[0] + terms[1] + terms[2])


def clean_probability(p: Column) -> Column:
    """Null, NaN and infinite are 0; values outside [0, 1] pass a logistic clipped at 20."""
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
    logistic = 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), p))))
    return F.when(~finite, 0.0).when(p.between(0, 1), p).otherwise(logistic)


def voxel_int(c: Column) -> Column:
    """Half-even rounding clamped at zero."""
    return F.greatest(F.lit(0), F.rint(c).cast("int"))


def jaccard(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp + fn > 0, tp / (tp + fp + fn)).otherwise(0.0)


def adjusted_jaccard(j: Column, predicted: Column, true: Column, weight: float = 0.1) -> Column:
    """Jaccard reduced by the relative surplus of nodes; unchanged where the true number is unknown."""
    return F.when(true.isNull() | (true <= 0), j).otherwise(F.greatest(F.lit(0.0), j * (1 - weight * (predicted - true) / true)))


def safe_cosine(dot: Column, n1: Column, n2: Column) -> Column:
    return F.when(n1 * n2 > 1e-8, dot / (n1 * n2)).otherwise(0.0)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
