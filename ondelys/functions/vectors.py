"""Distances and vector arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def scale(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def _gaps(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: F.abs(a - b))


def _floored(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(EPSILON)))


def squared(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def _kl(x: Column, y: Column) -> Column:
    """Symmetric Kullback-Leibler divergence, logs floored."""

    def term(a: Column, b: Column) -> Column:
        return (a - b) * (F.log(F.greatest(a, F.lit(EPSILON))) - F.log(F.greatest(b, F.lit(EPSILON))))

    return total(F.zip_with(x, y, term))


def _js(x: Column, y: Column) -> Column:
    """Square root of the Jensen-Shannon divergence of the floored, normalised vectors."""
    x, y = _floored(x), _floored(y)
    # Bound once: a plain expression would be worked out again for every element.
    pair = F.array(F.struct(x.alias("x"), y.alias("y"), total(x).alias("a"), total(y).alias("b")))

    def divergence(s: Column) -> Column:
        def term(a: Column, b: Column) -> Column:
            p, q = a / s["a"], b / s["b"]
            return p * F.log(p / ((p + q) / 2)) + q * F.log(q / ((p + q) / 2))

        return F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(s["x"], s["y"], term)) / 2))

    return F.transform(pair, divergence)[0]


#: The eight distances, in the order of their numbers.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "manhattan": lambda x, y: total(_gaps(x, y)),
    "euclidean": lambda x, y: F.sqrt(squared(x, y)),
    "squared_euclidean": squared,
    "max": lambda x, y: F.array_max(_gaps(x, y)),
    "min": lambda x, y: F.array_min(_gaps(x, y)),
    "kl": _kl,
    "cosine": lambda x, y: 1 - dot(x, y) / (norm(x) * norm(y)),
    "jensen_shannon": _js,
}


def distance(name: str | int, x: Column, y: Column) -> Column:
    """Distance by name or number."""
    return (list(DISTANCES.values())[name] if isinstance(name, int) else DISTANCES[name])(x, y)


def _whole(log: Callable[[Column], Column], x: Column) -> Column:
    """A logarithm as floating-point numbers have it, where Spark's is null: minus infinity at 0, not a number below."""
    return F.when(x > 0, log(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def hz_to_mel(f: Column) -> Column:
    return 1127.01048 * _whole(F.log, f / 700.0 + 1)


def hz_to_midi(f: Column, silent: float = -999.0) -> Column:
    """MIDI pitch; 0 Hz is ``silent``: the plain formula's limit is minus infinity."""
    return F.when(f == 0, F.lit(silent)).otherwise(69 + 12 * _whole(F.log2, f / 440.0))


def amp_to_db(a: Column) -> Column:
    return 20 * F.log10(F.greatest(a, F.lit(EPSILON)))


def db_to_amp(d: Column) -> Column:
    return F.pow(F.lit(10.0), d / 20.0)


def nonzero_range(r: Column) -> Column:
    """A range that may divide: values below ten epsilons count as 1."""
    return F.when(r < 10 * EPSILON, F.lit(1.0)).otherwise(r)


#: Activations of networks, in the order of their numbers.
ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda x: x,
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "tanh": F.tanh,
}


def window_function(kind: str, size: int) -> list[float]:
    """Analysis windows as constants; ``blackman_harris_ref`` has all terms at one frequency."""
    from ..signal.spectral import window

    return window(kind, size).tolist()
