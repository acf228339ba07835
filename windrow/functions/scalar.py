"""Column expressions that several operators share."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp; sessions run in UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def hash_order(key: Column, seed: int = 0) -> Column:
    """A multiplicative hash below 2^32: a seeded order that any engine can repeat. Of keys from 2^31 on the upper bits are mixed in."""
    whole = key.cast("long") + F.lit(seed)
    low = F.pmod(F.pmod(whole, F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32))
    high = F.pmod(F.pmod(F.shiftright(whole, 31), F.lit(1 << 31)) * F.lit(2246822519), F.lit(1 << 32))
    return F.pmod(low + high, F.lit(1 << 32))


def clip(x: Column, low: float, high: float) -> Column:
    """Into [low, high]; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sanitise(x: Column) -> Column:
    """NaN, infinities and negative numbers as 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0), F.lit(0.0)).otherwise(x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def scaled(x: Column, low: Column, high: Column, epsilon: float = 1e-8) -> Column:
    """(x - low) / (high - low + epsilon), clipped to [0, 1]."""
    return clip((x - low) / (high - low + F.lit(epsilon)), 0.0, 1.0)


def array_percentile(xs: Column, p: float) -> Column:
    """Exact percentile of an array by linear interpolation; null for an empty one."""
    ordered = F.array_sort(xs)
    at = (F.size(xs) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    first = F.get(ordered, low).cast("double")
    second = F.get(ordered, F.ceil(at).cast("int")).cast("double")
    return F.when(F.size(xs) > 0, first + (second - first) * (at - low))


def array_sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def array_variance(xs: Column) -> Column:
    """Population variance; null for an empty array."""
    mean = array_sum(xs) / F.nullif(F.size(xs), F.lit(0))
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.nullif(F.size(xs), F.lit(0))


def squared_distance(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y)))


def bell(x: Column, a: float, b: float, c: float) -> Column:
    """Generalised bell membership."""
    return 1 / (1 + F.pow(F.abs((x - F.lit(c)) / F.lit(a)), F.lit(2.0 * b)))


def softmax(xs: list[Column]) -> list[Column]:
    most = F.greatest(*xs)
    raised = [F.exp(x - most) for x in xs]
    total = reduce(lambda a, b: a + b, raised)
    return [x / total for x in raised]


def argmax(xs: list[Column]) -> Column:
    """Place of the greatest; of equal ones the first."""
    return (F.array_position(F.array(*xs), F.greatest(*xs)) - 1).cast("int")


def tercile(x: Column, low: Column, high: Column) -> Column:
    return F.when(x <= low, "low").when(x <= high, "medium").otherwise("high")


def half_even(x: Column, places: int) -> Column:
    """Rounding to even halves, as catalogues with decimal keys are matched."""
    return F.bround(x, places)


def slug(x: Column) -> Column:
    return F.replace(F.lower(F.trim(x)), F.lit("."), F.lit("p"))


def json_number(text: Column, *keys: str, default: float | None = None) -> Column:
    """The first of keys that a JSON text holds as a number, else default; malformed text counts as empty."""
    found = [F.get_json_object(text, f"$.{k}").try_cast("double") for k in keys]
    return F.coalesce(*found, F.lit(default).cast("double"))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)), finite at every finite x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clipped_first(x: Column, low: float, high: float) -> Column:
    """Clipped to [low, high], then scaled to [0, 1]."""
    return (clip(x, low, high) - F.lit(float(low))) / F.lit(float(high) - float(low))


def spaced(x: Column, by: str = " ") -> Column:
    """Underscores of a class name as blanks, or as another text."""
    return F.replace(x, F.lit("_"), F.lit(by))


#: Steps by which an argument is raised before its series is used, and steps of the continued fraction.
_RAISED, _STEPS = 10, 60


def _series(z: Column) -> Column:
    """What log_gamma(z) has beyond (z - 1/2) log z - z + log(2 pi) / 2, for z of 10 or more."""
    return 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7))) + 1 / (1188 * F.pow(z, F.lit(9)))


def log_gamma(x: Column) -> Column:
    """Of positive x, by the series after ten steps of the recurrence."""
    z = x + F.lit(float(_RAISED))
    below = reduce(lambda a, b: a + b, [F.log(x + F.lit(float(k))) for k in range(_RAISED)])
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + _series(z) - below


def log_beta(a: Column, b: Column) -> Column:
    """log of the beta function; the difference of the large logarithms of a and a + b is taken before it is rounded."""
    z = a + F.lit(float(_RAISED))
    below = reduce(lambda p, q: p + q, [F.log1p(b / (a + F.lit(float(k)))) for k in range(_RAISED)])
    return log_gamma(b) - ((z - 0.5) * F.log1p(b / z) + b * F.log(z + b) - b + _series(z + b) - _series(z) - below)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, of _STEPS steps of two terms each."""

    def term(acc: Column, t: Column) -> Column:
        d = 1 / (1 + t * acc["d"])
        c = 1 + t / acc["c"]
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    def terms(m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.array(even, odd)

    first = 1 / (1 - (a + b) * x / (a + 1))
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(_STEPS)), lambda m: terms(m.cast("double"))))
    return F.aggregate(every, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), term)["h"]


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """Probability of a variance ratio above f at d1 and d2 degrees of freedom: the regularised incomplete beta function at d2 / (d2 + d1 f).

    Relative error below 1e-9 up to d2 of 10^8, 1e-7 up to 10^9. Null where the ratio is null, negative or not a number, or a degree is not positive.
    """
    a, b = d2.cast("double") / 2, d1.cast("double") / 2
    y = d1 * f / (d2 + d1 * f)
    x = d2 / (d2 + d1 * f)
    log_x = F.when(y < 0.5, F.log1p(-y)).otherwise(F.log(x))
    log_y = F.when(y < 0.5, F.log(y)).otherwise(F.log1p(-x))
    front = F.exp(a * log_x + b * log_y - log_beta(a, b))
    tail = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, y) / b)
    usable = finite(f.cast("double")) & (f >= 0) & (d1 > 0) & (d2 > 0)
    return F.when(usable & (f == 0), F.lit(1.0)).when(usable, F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def resized(xs: Column, size: int, to: int) -> Column:
    """An array of size numbers as one of to, linearly, ends on ends."""
    step = (size - 1) / max(to - 1, 1)

    def at(k: Column) -> Column:
        place_ = k * F.lit(step)
        low = F.least(F.floor(place_), F.lit(size - 1)).cast("int")
        first, second = F.get(xs, low).cast("double"), F.get(xs, F.least(low + 1, F.lit(size - 1))).cast("double")
        return first + (second - first) * (place_ - low)

    return F.transform(F.sequence(F.lit(0), F.lit(to - 1)), at)


def resized_image(rows: Column, shape: tuple[int, int], to: tuple[int, int]) -> Column:
    """An array of equally long rows of numbers, bilinearly, corners on corners."""
    wide = F.transform(rows, lambda r: resized(r, shape[1], to[1]))
    step = (shape[0] - 1) / max(to[0] - 1, 1)

    def at(k: Column) -> Column:
        place_ = k * F.lit(step)
        low = F.least(F.floor(place_), F.lit(shape[0] - 1)).cast("int")
        return F.zip_with(F.get(wide, low), F.get(wide, F.least(low + 1, F.lit(shape[0] - 1))), lambda a, b: a + (b - a) * (place_ - low))

    return F.transform(F.sequence(F.lit(0), F.lit(to[0] - 1)), at)


def tiled(xs: Column, times: int) -> Column:
    """An array over and over."""
    return F.flatten(F.array_repeat(xs, times))


def reshaped(xs: Column, width: int) -> Column:
    """An array as rows of the given width; null where they do not come out even, no rows for an empty one."""
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(xs) / width).cast("int") - 1)), lambda k: F.slice(xs, k * width + 1, width))
    return F.when(F.size(xs) == 0, F.slice(rows, 1, 0)).when(F.size(xs) % width == 0, rows)


def stacked(*arrays: Column) -> Column:
    """Equally long arrays side by side: an array of rows with a number of each; null where their lengths differ."""
    same = reduce(lambda a, b: a & b, [F.size(x) == F.size(arrays[0]) for x in arrays])
    size = F.size(arrays[0])
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), size - 1)), lambda k: F.array(*[F.get(x, k) for x in arrays]))
    return F.when(same, F.slice(rows, F.lit(1), size))
