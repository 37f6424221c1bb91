"""Operators on unbounded streams of blocks (stream_id, block, samples): state per stream, results per block.

Where ``blocks`` has a column ``reset``, a true value there forgets the
stream's state before the block.  What a stream gives is what the whole signal
gives at once, as far as its latency lets it tell: nothing that later samples
could change is sent.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..signal import decompose, descriptors, spectral
from ..signal.spectral import fft_settings

STATE = "held binary"
#: Frames before a frame that its value depends on.
CONTEXT = {"onset_feature": lambda s: 2 + s.get("filter_size", 5), "novelty_feature": lambda s: 2 + s.get("kernel", 3) + s.get("smoothing", 1)}


def _stateful(blocks: DataFrame, schema: str, start, step) -> DataFrame:
    """Blocks of each stream in order through ``step(state, samples) -> rows``; the state is kept between batches."""
    resets = "reset" in blocks.columns

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else start()
        rows, found = [], []
        for part in parts:
            found += zip(part["block"], part["samples"], part["reset"] if resets else [False] * len(part), strict=True)
        for n, samples, reset in sorted(found, key=lambda r: r[0]):
            if reset is True or reset is np.True_:
                held = start()
            rows += [(key[0], *r) for r in step(held, int(n), np.asarray(samples, float))]
        state.update((pickle.dumps(held),))
        names = [c.strip().split(" ")[0] for c in schema.split(", ")]
        yield pd.DataFrame(rows, columns=names)

    return blocks.groupBy("stream_id").applyInPandasWithState(work, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def running_stats(blocks: DataFrame, history: int = 2) -> DataFrame:
    """(stream_id, frame, mean, std) over the last ``history`` values of each stream."""

    def step(held: dict, block: int, samples: np.ndarray) -> list[tuple]:
        rows = []
        for v in np.nan_to_num(samples, nan=0.0):
            held["last"] = [*held["last"], float(v)][-history:]
            last = np.array(held["last"])
            rows.append((held["n"], float(last.mean()), float(last.std(ddof=1)) if len(last) > 1 else 0.0))
            held["n"] += 1
        return rows

    return _stateful(blocks, "stream_id string, frame long, mean double, std double", lambda: {"last": [], "n": 0}, step)


class _Frames:
    """Values of a descriptor hop by hop; a window and the frames that values depend on are held."""

    def __init__(self, work, win: int, hop: int, context: int):
        self.work, self.win, self.hop, self.context = work, win, hop, context

    @staticmethod
    def start() -> dict:
        return {"x": np.zeros(0), "n": 0, "old": 0}

    def step(self, held: dict, samples: np.ndarray) -> list[tuple[int, np.ndarray]]:
        x = np.concatenate([held["x"], samples])
        count = 1 + (len(x) - self.win) // self.hop if len(x) >= self.win else 0
        old, rows = held["old"], []
        if count > old:
            found = self.work(x[: (count - 1) * self.hop + self.win])[old:count]
            rows = [(held["n"] + i, row) for i, row in enumerate(found)]
            held["n"] += len(rows)
            held["old"] = min(count, self.context)
            x = x[(count - held["old"]) * self.hop :]
        held["x"] = x
        return rows


def _frames_of(descriptor: str, rate: float, win: int, hop: int, settings: dict) -> _Frames:
    work = descriptors.DESCRIPTORS[descriptor]
    context = CONTEXT.get(descriptor, lambda s: 0)(settings)
    return _Frames(lambda x: work(x, rate, win=win, hop=hop, padding="none", **settings), win, hop, context)


def features(blocks: DataFrame, descriptor: str, rate: float = 44100.0, win: int = 1024, hop: int = 512, **settings) -> DataFrame:
    """(stream_id, frame, features): one row per hop as soon as its window is full."""
    frames = _frames_of(descriptor, rate, win, hop, settings)

    def step(held: dict, block: int, samples: np.ndarray) -> list[tuple]:
        return [(n, [float(v) for v in row]) for n, row in frames.step(held, samples)]

    return _stateful(blocks, "stream_id string, frame long, features array<double>", frames.start, step)


def activations(blocks: DataFrame, bases: list[list[float]], iterations: int = 10, seed: int = 42, win: int = 1024, hop: int = -1, fft: int = -1) -> DataFrame:
    """(stream_id, frame, features): activations of fixed bases, one row per hop."""
    win, hop, fft = fft_settings(win, hop, fft)
    fixed = np.array(bases, float)
    frames = _Frames(lambda x: decompose.nmf_match(np.abs(spectral.spectrum(x, win, hop, fft, "none")), fixed, iterations, seed), win, hop, 0)

    def step(held: dict, block: int, samples: np.ndarray) -> list[tuple]:
        return [(n, [float(v) for v in row]) for n, row in frames.step(held, samples)]

    return _stateful(blocks, "stream_id string, frame long, features array<double>", frames.start, step)


def _parts(blocks: DataFrame, work, hop: int, reach: int) -> DataFrame:
    """(stream_id, part, start, samples): parts of a signal whose samples depend on ``reach`` others before and behind."""
    reach = -(-reach // hop) * hop

    def step(held: dict, block: int, samples: np.ndarray) -> list[tuple]:
        x = np.concatenate([held["x"], samples])
        # Up to here, in whole hops, later samples can't change a thing.
        sure = (len(x) - reach) // hop * hop
        rows = []
        if sure > held["done"]:
            rows = [(name, held["at"] + held["done"], [float(v) for v in part[held["done"] : sure]]) for name, part in work(x).items()]
            cut = max(0, sure - reach)
            x, held["at"], held["done"] = x[cut:], held["at"] + cut, sure - cut
        held["x"] = x
        return rows

    return _stateful(blocks, "stream_id string, part string, start long, samples array<double>", lambda: {"x": np.zeros(0), "at": 0, "done": 0}, step)


def hpss(blocks: DataFrame, rate: float = 44100.0, harm_size: int = 17, perc_size: int = 31, win: int = 1024, hop: int = -1, fft: int = -1, **settings) -> DataFrame:
    """Harmonic, percussive and residual parts of each stream."""
    win, hop, fft = fft_settings(win, hop, fft)
    return _parts(blocks, lambda x: decompose.hpss(x, rate, harm_size, perc_size, win=win, hop=hop, fft=fft, **settings), hop, (harm_size // 2) * hop + 2 * win)


def nmf_filter(blocks: DataFrame, bases: list[list[float]], rate: float = 44100.0, iterations: int = 10, seed: int = 42, win: int = 1024, hop: int = -1, fft: int = -1) -> DataFrame:
    """One part per base of each stream, by ratio masks."""
    win, hop, fft = fft_settings(win, hop, fft)
    return _parts(blocks, lambda x: decompose.nmf_filter(x, rate, bases, iterations, seed, win, hop, fft), hop, 2 * win)


class _Trigger:
    """Onsets in a stream of values: armed below ``off``, none within ``wait`` of the last."""

    def __init__(self, on: float, wait: int, off: float | None = None):
        self.on, self.wait, self.off = on, wait, off

    @staticmethod
    def start() -> dict:
        return {"before": 0.0, "free_at": 0, "armed": True, "i": 0}

    def step(self, held: dict, values: np.ndarray) -> list[int]:
        found = []
        for v in values.tolist():
            if v > self.on > held["before"] and held["armed"] and held["i"] >= held["free_at"]:
                found.append(held["i"])
                held["free_at"], held["armed"] = held["i"] + self.wait + 1, self.off is None
            if self.off is not None and v < self.off:
                held["armed"] = True
            held["before"] = v
            held["i"] += 1
        return found


ONSETS = "stream_id string, onset long"


def onset_slices(blocks: DataFrame, rate: float = 44100.0, metric: int = 0, threshold: float = 0.5, min_length: int = 2, filter_size: int = 5, win: int = 1024, hop: int = -1, fft: int = -1) -> DataFrame:
    """(stream_id, onset): where the onset feature rises through the threshold, in samples."""
    win, hop, fft = fft_settings(win, hop, fft)
    frames, trigger = _frames_of("onset_feature", rate, win, hop, {"metric": metric, "filter_size": filter_size, "fft": fft}), _Trigger(threshold, min_length)

    def step(held: dict, block: int, samples: np.ndarray) -> list[tuple]:
        values = np.array([row[0] for _, row in frames.step(held["frames"], samples)])
        # A frame tells of its newest hop.
        return [(i * hop + win - hop,) for i in trigger.step(held["trigger"], values)]

    return _stateful(blocks, ONSETS, lambda: {"frames": frames.start(), "trigger": trigger.start()}, step)


def _passed(held: list, x: np.ndarray, cutoff: float) -> np.ndarray:
    """Butterworth high-pass, twice, that goes on where the block before ended."""
    c = np.tan(np.pi * cutoff)
    b0 = 1 / (1 + np.sqrt(2) * c + c * c)
    a1, a2 = 2 * b0 * (c * c - 1), b0 * (1 - np.sqrt(2) * c + c * c)
    for past in held:
        x1, x2, y1, y2 = past
        out = np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            y = b0 * v - 2 * b0 * x1 + b0 * x2 - a1 * y1 - a2 * y2
            x1, x2, y1, y2 = v, x1, y, y1
            out[i] = y
        past[:] = [x1, x2, y1, y2]
        x = out
    return x


def amp_slices(blocks: DataFrame, rate: float = 44100.0, on: float = 144.0, off: float = -144.0, min_length: int = 2, fast_up: float = 1, fast_down: float = 1, slow_up: float = 100, slow_down: float = 100, floor: float = -144.0, high_pass: float = 85.0) -> DataFrame:
    """(stream_id, onset): where the envelope rises through ``on``, armed again below ``off``."""
    trigger = _Trigger(on, min_length, off)

    def start() -> dict:
        return {"pass": [[0.0] * 4, [0.0] * 4], "fast": floor, "slow": floor, "trigger": trigger.start()}

    def step(held: dict, block: int, samples: np.ndarray) -> list[tuple]:
        if not len(samples):
            return []
        x = _passed(held["pass"], samples, high_pass / rate) if high_pass > 0 else samples
        with np.errstate(divide="ignore"):
            level = np.maximum(20 * np.log10(np.abs(x)), floor)
        fast, slow = spectral.slide(level, fast_up, fast_down, held["fast"]), spectral.slide(level, slow_up, slow_down, held["slow"])
        held["fast"], held["slow"] = float(fast[-1]), float(slow[-1])
        return [(i,) for i in trigger.step(held["trigger"], fast - slow)]

    return _stateful(blocks, ONSETS, start, step)


def triggered(points: DataFrame, predict) -> DataFrame:
    """A model's answers for points whose trigger is positive: a lazy plan, for batches and streams alike."""
    return predict(points.where(F.col("trigger") > 0))
