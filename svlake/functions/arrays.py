"""Column functions over arrays of numbers: statistics, similarity, normalisation, resizing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_row_cosine(a: Column, b: Column) -> Column:
    """The mean of the cosines of two matrices' rows (arrays of arrays, equally many); a zero row counts as 0."""
    rows = F.zip_with(a, b, lambda x, y: F.coalesce(cosine(x, y), F.lit(0.0)))
    return F.try_divide(total(rows), F.size(rows))


def matrix_cosine(a: Column, b: Column) -> Column:
    """The sum of the products of all entries by both Frobenius norms: the cosine of the flattened matrices."""
    return cosine(F.flatten(a), F.flatten(b))


# Mean and deviation of the colours that the image network was trained with.
CHANNEL_MEAN, CHANNEL_DEVIATION = (0.485, 0.458, 0.406), (0.229, 0.224, 0.225)


def rgb_normalised(grey: Column, wrap: bool = False) -> Column:
    """Three channels of grey values 0 to 255, (x / 255 - mean) / deviation each. With ``wrap`` values are first multiplied by 255 and cut to
    a byte, as image converters do with floating values (127 becomes 129, 255 becomes 1)."""
    x = lambda v: (F.pmod(v.cast("long") * 255, F.lit(256)) if wrap else v).cast("double") / 255
    channel = lambda m, d: F.transform(grey, lambda v: (x(v) - m) / d)
    return F.array(*map(channel, CHANNEL_MEAN, CHANNEL_DEVIATION))


def min_max(values: Column) -> Column:
    """(x - min) / (max - min); null elements if all are equal."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda x: F.try_divide((x - low).cast("double"), (high - low).cast("double")))


def stats11(values: Column) -> Column:
    """Size, then of the values behind the sentinel, sorted: least, those at a quarter, half and three quarters (places rounded
    down, no interpolation), largest, root mean square, harmonic mean, mean, population deviation, coefficient of variation.
    All but the size are 0 if there is only the sentinel; a harmonic mean with a zero is null."""
    s = F.array_sort(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(1))))
    n = F.size(values) - 1
    at = lambda k: F.try_element_at(s, (F.floor(n * k / 4) + 1).cast("int")).cast("double")
    mean = F.try_divide(total(s), n)
    square = F.try_divide(F.aggregate(s, F.lit(0.0), lambda a, x: a + x.cast("double") * x), n)
    deviation = F.sqrt(F.greatest(F.try_divide(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), n), F.lit(0.0)))
    harmonic = F.try_divide(n, F.aggregate(s, F.lit(0.0), lambda a, x: a + F.try_divide(F.lit(1.0), x.cast("double"))))
    found = {
        "size": F.size(values), "v_min": F.array_min(s).cast("double"), "v_q1": at(1), "v_q2": at(2), "v_q3": at(3), "v_max": F.array_max(s).cast("double"),
        "rms": F.sqrt(square), "hm": harmonic, "mean": mean, "std": deviation, "cv": F.try_divide(deviation, mean),
    }
    return F.struct(*[c.alias(k) if k == "size" else F.when(n > 0, c).otherwise(F.lit(0.0)).alias(k) for k, c in found.items()])


def resized_row(row: Column, width: int, to: int) -> Column:
    """A row of ``width`` values at ``to`` places: linear between neighbours with ratio (width - 1) / to, rounded half away from zero."""
    ratio = (width - 1) / to

    def at(i: Column) -> Column:
        x = i.cast("double") * ratio
        low = F.floor(x).cast("int")
        high = F.least(low + 1, F.lit(width - 1))
        part = x - low
        return F.round(F.element_at(row, low + 1) * (1 - part) + F.element_at(row, high + 1) * part).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(to - 1)), at)


def resized_centred(row: Column, width: int, to: int) -> Column:
    """A row of ``width`` values at ``to`` places, linear between neighbours, pixel centres on pixel centres: x = (i + 0.5) * width / to - 0.5,
    held within the row; not rounded."""

    def at(i: Column) -> Column:
        x = F.least(F.greatest((i.cast("double") + 0.5) * (width / to) - 0.5, F.lit(0.0)), F.lit(float(width - 1)))
        low = F.floor(x).cast("int")
        part = x - low
        return F.element_at(row, low + 1) * (1 - part) + F.element_at(row, F.least(low + 1, F.lit(width - 1)) + 1) * part

    return F.transform(F.sequence(F.lit(0), F.lit(to - 1)), at)
