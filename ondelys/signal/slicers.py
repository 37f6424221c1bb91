"""Slicers: arrays of samples to onset positions, or onsets and offsets."""

from __future__ import annotations

import numpy as np

from . import descriptors, spectral
from .spectral import fft_settings


def _debounced(on: np.ndarray, wait: int, release: np.ndarray | None = None) -> np.ndarray:
    """Places where ``on`` holds, none within ``wait`` of the last, and with ``release`` only after it held in between."""
    out, free_at, armed = [], 0, True
    lows = np.flatnonzero(release) if release is not None else None
    last = -1
    for i in np.flatnonzero(on).tolist():
        if lows is not None and not armed:
            j = np.searchsorted(lows, last)
            armed = j < len(lows) and lows[j] < i
        if armed and i >= free_at:
            out.append(i)
            free_at, last = i + wait + 1, i
            armed = release is None
    return np.array(out, np.int64)


def amp_slice(x, rate, on=144.0, off=-144.0, min_length=2, fast_up=1, fast_down=1, slow_up=100, slow_down=100, floor=-144.0, high_pass=85.0):
    """Where the envelope rises through ``on``; armed again below ``off``."""
    value = descriptors.amp_feature(x, rate, fast_up, fast_down, slow_up, slow_down, floor, high_pass)[:, 0]
    before = np.r_[0.0, value[:-1]]
    return _debounced((value > on) & (before < on), min_length, value < off)


def amp_gate(x, rate, ramp_up=10, ramp_down=10, on=-90.0, off=-90.0, min_slice=1, min_silence=1, min_above=1, min_below=1, look_back=0, look_ahead=0, high_pass=85.0):
    """(onsets, offsets) of the parts above the gate.

    A change of state is taken back to the lowest level within the look-back
    or look-ahead time; a sound still open at the end has no offset.
    """
    start = min(on, off) - 1
    below = max(min_below, look_ahead)
    reach = max(min_above + look_back, below, 1)
    level = spectral.slide(descriptors._level(x, rate, start, high_pass), ramp_up, ramp_down, start)
    held = np.r_[np.full(reach, start), level]

    def refined(at: int, span: int) -> int:
        if span < 2:
            return at + span
        return at + int(held[at + reach : at + span + reach].argmin())

    onsets, offsets = [], []
    state = out = False
    run = forced = 0
    for t, v in enumerate(level.tolist()):
        if forced > 0:
            forced -= 1
            continue
        new = v >= on if not state else v > off
        run = run + 1 if new == state else 1
        state = new
        if not out and state and run >= min_above:
            onsets.append(max(0, refined(t - min_above - look_back, look_back)))
            out, forced = True, max(0, min_slice - run)
        elif out and not state and run >= below:
            offsets.append(max(0, refined(t - below, look_ahead)))
            out, forced = False, max(0, min_silence - run)
    return np.array(onsets, np.int64), np.array(offsets, np.int64)


def _to_samples(found: np.ndarray, hop: int, length: int) -> np.ndarray:
    return np.unique(np.clip(found * hop, 0, max(0, length - 1)))


def onset_slice(x, rate, metric=0, threshold=0.5, min_length=2, filter_size=5, frame_delta=0, win=1024, hop=-1, fft=-1):
    """Where the onset feature rises through the threshold; lengths in hops."""
    win, hop, fft = fft_settings(win, hop, fft)
    value = descriptors.onset_feature(x, rate, metric, filter_size, frame_delta, win, hop, fft)[:, 0]
    before = np.r_[0.0, value[:-1]]
    # A frame tells of its newest hop.
    return np.unique(np.clip(_debounced((value > threshold) & (before < threshold), min_length) * hop + win // 2 - hop, 0, max(0, len(x) - 1)))


def novelty_slice(x, rate, algorithm="spectrum", kernel=3, threshold=0.5, smoothing=1, min_length=2, win=1024, hop=-1, fft=-1):
    """Where the novelty curve has a peak above the threshold."""
    win, hop, fft = fft_settings(win, hop, fft)
    value = descriptors.novelty_feature(x, rate, algorithm, kernel, smoothing, win, hop, fft)[:, 0]
    padded = np.r_[0.0, 0.0, value]
    peak = (padded[1:-1] > padded[:-2]) & (padded[1:-1] > padded[2:]) & (padded[1:-1] > threshold)
    late = 1 + (kernel + 1) // 2 + smoothing // 2
    return _to_samples(np.maximum(_debounced(peak, min_length) - late, 0), hop, len(x))


def transient_slice(x, rate, order=20, block=256, pad=128, skew=0.0, forward=2.0, backward=1.1, width=14, clump=25, min_length=1000):
    """First samples of what linear prediction can't foresee."""
    from .decompose import transient_mask

    mask = transient_mask(x, order, block, pad, skew, forward, backward, width, clump)
    return _debounced(mask & ~np.r_[False, mask[:-1]], min_length)


SLICERS = {"amp": amp_slice, "gate": amp_gate, "onset": onset_slice, "novelty": novelty_slice, "transient": transient_slice}
