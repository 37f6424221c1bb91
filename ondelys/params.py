"""Parameters with limits: values outside are clipped with a warning, not refused."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from .signal.spectral import next_power

Limit = Callable[[float, dict], float]


def at_least(low: float) -> Limit:
    return lambda v, _: max(v, low)


def at_most(high: float) -> Limit:
    return lambda v, _: min(v, high)


def below(other: str) -> Limit:
    """At most another parameter's value."""
    return lambda v, all_: min(v, all_[other])


def above(other: str) -> Limit:
    return lambda v, all_: max(v, all_[other])


def odd(v: float, _: dict) -> float:
    return v if v % 2 else v + 1


def power_of_two(v: float, _: dict) -> float:
    return next_power(int(v))


def frame_size(settings: str, up: bool = True) -> Limit:
    """Within the bins of the FFT settings (window, hop, fft)."""
    return lambda v, all_: (min if up else max)(v, all_[settings][2] // 2 + 1)


@dataclass(frozen=True)
class Param:
    default: object
    limits: tuple[Limit, ...] = ()


def settled(declared: dict[str, Param], given: dict) -> dict:
    """Defaults with the given values, each within its limits."""
    unknown = set(given) - set(declared)
    if unknown:
        raise TypeError(f"no parameters {sorted(unknown)}")
    values = {n: given.get(n, p.default) for n, p in declared.items()}
    for name, param in declared.items():
        was = values[name]
        for limit in param.limits:
            values[name] = limit(values[name], values)
        if values[name] != was:
            warnings.warn(f"{name}: {was} was clipped to {values[name]}", stacklevel=2)
    return values


def _fft(v: float, all_: dict) -> float:
    return v if v < 0 else power_of_two(max(v, all_.get("win", 1024)), all_)


def _hop(v: float, _: dict) -> float:
    return v if v == -1 else max(v, 1)


#: Limits of the settings that signal operators share; others are taken as they are.
LIMITS: dict[str, tuple[Limit, ...]] = {
    "win": (at_least(4),),
    "hop": (_hop,),
    "fft": (_fft,),
    "bands": (at_least(2),),
    "coefficients": (at_least(2),),
    "filter_size": (at_least(0),),
    "kernel": (at_least(3), odd),
    "smoothing": (at_least(1),),
    "harm_size": (at_least(3), odd),
    "perc_size": (at_least(3), odd),
    "components": (at_least(1),),
    "iterations": (at_least(1),),
    "min_length": (at_least(0),),
    "fast_up": (at_least(1),),
    "fast_down": (at_least(1),),
    "slow_up": (at_least(1),),
    "slow_down": (at_least(1),),
}


def clipped(settings: dict) -> dict:
    """Settings of a signal operator within their limits, with a warning for each that wasn't."""
    return settled({n: Param(v, LIMITS.get(n, ())) for n, v in settings.items()}, settings)


class Changes:
    """Whether structural parameters differ from those of the last call: a model that has to start anew."""

    def __init__(self):
        self.last: tuple | None = None

    def changed(self, *values) -> bool:
        before, self.last = self.last, values
        return before != values
