"""Column functions: array statistics, entropy, divergences and Fourier magnitudes, all inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def median(x: Column | str) -> Column:
    """Aggregate: the middle value, or the mean of the two middle ones; nulls are skipped."""
    return F.percentile(x, F.lit(0.5))


def array_avg(xs: Column | str) -> Column:
    seen = F.filter(xs, lambda x: x.isNotNull())
    return F.when(F.size(seen) > 0, _sum(F.transform(seen, lambda x: x.cast("double"))) / F.size(seen))


def array_median(xs: Column | str) -> Column:
    seen = F.array_sort(F.filter(xs, lambda x: x.isNotNull()))
    n = F.size(seen)
    low, high = F.try_element_at(seen, F.expr("1") * ((n + 1) / 2).cast("int")), F.try_element_at(seen, (n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2.0)


def array_min(xs: Column | str) -> Column:
    return F.array_min(xs)


def entropy(xs: Column) -> Column:
    """-sum x ln x over an array, in nats."""
    return -_sum(F.transform(xs, lambda p: F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))))


def set_overlap(a: Column, b: Column) -> Column:
    """Common non-zero places over the larger of both counts; 0 if either is all zero."""
    na, nb = F.size(F.filter(a, lambda x: x > 0)), F.size(F.filter(b, lambda x: x > 0))
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > 0) & (y > 0)), lambda x: x))
    return F.when((na > 0) & (nb > 0), both / F.greatest(na, nb)).otherwise(F.lit(0.0))


def _share(v: Column) -> Column:
    return F.transform(v, lambda x: x / _sum(v))


def js_similarity(a: Column, b: Column) -> Column:
    """1 - Jensen-Shannon distance (base 2) of the normalised vectors; null if either is all zero."""

    def half(p: Column, q: Column) -> Column:
        return _sum(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(F.lit(0.0))))

    p, q = _share(a), _share(b)
    divergence = (half(p, q) + half(q, p)) / 2
    return F.when((_sum(a) > 0) & (_sum(b) > 0), 1 - F.sqrt(F.greatest(divergence, F.lit(0.0))))


def chi2_divergence(a: Column, b: Column) -> Column:
    """1 - sum ((p - q) / (p + q))**2 over the number of places that are active in either; null if either is all zero."""
    terms = F.zip_with(_share(a), _share(b), lambda x, y: F.when(x + y > 0, F.pow((x - y) / (x + y), F.lit(2.0))).otherwise(F.lit(0.0)))
    active = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > 0) | (y > 0)), lambda x: x))
    return F.when((_sum(a) > 0) & (_sum(b) > 0), 1 - _sum(terms) / active)


def fourier_magnitude(xs: Column, frequency: float) -> Column:
    """|sum of cos(2 pi f n)| over the distinct values n of an array."""
    step = 2 * math.pi * frequency
    return F.abs(F.coalesce(_sum(F.transform(F.array_distinct(xs), lambda n: F.cos(F.lit(step) * n))), F.lit(0.0)))
