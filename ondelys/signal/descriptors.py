"""Frame descriptors: arrays of samples to (frames, features)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import spectral
from .spectral import EPSILON, dct_matrix, fft_settings, peaks, spectrum, window


def _midi(f: np.ndarray) -> np.ndarray:
    return np.where(f == 0, -999.0, 69 + 12 * np.log2(np.where(f == 0, 1, f) / 440))


@lru_cache(maxsize=16)
def mel_filters(bands: int, bins: int, rate: float, low: float, high: float) -> np.ndarray:
    """Triangles with edges evenly spaced in mel."""
    edges = np.linspace(*(1127.01048 * np.log(np.array([low, high]) / 700 + 1)), bands + 2)
    edges = 700 * (np.exp(edges / 1127.01048) - 1)
    ramp, gap = edges[:, None] - np.linspace(0, rate / 2, bins), np.abs(np.diff(edges))[:, None]
    return np.maximum(0, np.minimum(-ramp[:-2] / gap[:-1], ramp[2:] / gap[1:]))


def mel_bands(x, rate, bands=40, low=20.0, high=20000.0, normalize=True, db=False, win=1024, hop=-1, fft=-1, padding="default"):
    win, hop, fft = fft_settings(win, hop, fft)
    mag = np.abs(spectrum(x, win, hop, fft, padding))
    filters = mel_filters(bands, mag.shape[1], rate, low, min(high, rate / 2))
    if normalize:
        mag = mag * 4 / win
        out = mag @ filters.T
        energy = mag.sum(axis=1) * win / (2 * fft)
        out = out * (energy / np.maximum(EPSILON, out.sum(axis=1)))[:, None]
    else:
        out = mag @ filters.T
    return 20 * np.log10(np.maximum(out, EPSILON)) if db else out


def mfcc(x, rate, coefficients=13, bands=40, start=0, low=20.0, high=20000.0, win=1024, hop=-1, fft=-1, padding="default"):
    mel = mel_bands(x, rate, bands, low, high, False, True, win, hop, fft, padding)
    return (mel @ dct_matrix(bands, min(coefficients + start, bands)).T)[:, start:]


def spectral_shape(x, rate, low=0.0, high=-1.0, rolloff=95.0, midi=False, power=False, win=1024, hop=-1, fft=-1, padding="default"):
    """Centroid, spread, skewness, kurtosis, rolloff, flatness (dB), crest (dB)."""
    mag = np.maximum(np.abs(spectrum(x, win, hop, fft, padding)), EPSILON)
    bins = mag.shape[1]
    step = rate / ((bins - 1) * 2)
    top = min(rate / 2, rate / 2 if high == -1 else high)
    first, last = int(np.ceil(low / step)), min(int(top // step), bins - 1)
    if last <= first:
        return np.zeros((len(mag), 7))
    if midi and first == 0:
        mag[:, 1] += mag[:, 0]
        first = 1
    amp = mag[:, first:last] ** (2 if power else 1)
    freq = np.linspace(first * step, last * step, last - first)
    if midi:
        freq = 69 + 12 * np.log2(freq / 440)
    whole = amp.sum(axis=1)
    centre = amp @ freq / whole
    off = freq - centre[:, None]
    spread, third, fourth = ((amp * off**n).sum(axis=1) / whole for n in (2, 3, 4))
    total = np.cumsum(amp, axis=1)
    target = whole * rolloff / 100
    at = (total >= target[:, None]).argmax(axis=1)
    rows = np.arange(len(amp))
    before = np.maximum(at - 1, 0)
    roll = freq[at] - (freq[at] - freq[before]) * (total[rows, at] - target) / amp[rows, at]
    flat = np.exp(np.log(amp).mean(axis=1)) / amp.mean(axis=1)
    crest = amp.max(axis=1) / amp.mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        shape = [centre, np.sqrt(spread), third / spread**1.5, fourth / spread**2, roll]
    return np.stack([*shape, *(20 * np.log10(np.maximum(v, EPSILON)) for v in (flat, crest))], axis=1)


@lru_cache(maxsize=16)
def chroma_filters(count: int, bins: int, rate: float, ref: float) -> np.ndarray:
    """Gaussian bumps around each pitch class, every bin of unit length."""
    size = 2 * (bins - 1)
    with np.errstate(divide="ignore"):
        pitch = count * np.log2(np.linspace(0, rate, size) / (ref / 16))
    pitch[0] = pitch[1] - 1.5 * count
    spread = np.maximum(1, np.r_[np.diff(pitch), 1])
    half = count // 2
    away = np.fmod(pitch - np.arange(count)[:, None] + 10 * count + half, count) - half
    bumps = np.exp(-0.5 * (2 * away / spread) ** 2)[:, :bins]
    return bumps / np.linalg.norm(bumps, axis=0)


def chroma(x, rate, count=12, ref=440.0, normalize=0, low=0.0, high=-1.0, win=1024, hop=-1, fft=-1, padding="default"):
    mag = np.abs(spectrum(x, win, hop, fft, padding))
    bins = mag.shape[1]
    if low != 0 or high != -1:
        step = rate / ((bins - 1) * 2)
        mag[:, : (0 if low == 0 else int(np.ceil(low / step))) + 1] = 0
        mag[:, min(int(min(rate / 2, rate / 2 if high == -1 else high) // step), bins - 1) :] = 0
    out = mag**2 @ chroma_filters(count, bins, rate, ref).T * 2 / (2 * (bins - 1) * count)
    if normalize:
        out = out / np.maximum(out.sum(axis=1) if normalize == 1 else out.max(axis=1), EPSILON)[:, None]
    return out


def _yin(mag, rate, low, high):
    bins = mag.shape[1]
    square = mag**2
    mirrored = np.concatenate([square, square[:, -2:0:-1]], axis=1)
    yin = 2 * square.sum(axis=1)[:, None] - np.fft.rfft(mirrored, axis=1).real
    yin[:, 0] = 1
    total = np.cumsum(yin[:, 1:], axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        yin[:, 1:] *= np.arange(1, bins) / total
    first = min(round(rate / (high or 1)), bins - 1)
    last = min(round(rate / (low or 1)), bins - first - 1)
    out = np.zeros((len(mag), 2))
    for i in np.flatnonzero(total[:, -1] > 0) if last > first else ():
        part = -yin[i, first:last]
        place, top = peaks(part, part.min(), count=1)
        if len(place):
            out[i] = rate / (first + place[0]), max(1 + top[0], 0)
    return out


def _harmonic_product(mag, rate, low, high, harmonics=4):
    bins = mag.shape[1]
    product = mag.copy()
    for h in range(2, harmonics):
        down = np.zeros_like(mag)
        n = bins // h
        down[:, :n] = mag[:, : n * h : h]
        product *= down
    step = rate / ((bins - 1) * 2)
    first, last = round(low / step), min(round(high / step), bins)
    out, total = np.zeros((len(mag), 2)), product.sum(axis=1)
    if last > first:
        at = product[:, first:last].argmax(axis=1)
        on = total > 0
        out[on, 0] = ((first + at) * step)[on]
        out[on, 1] = (product[np.arange(len(mag)), first + at] / np.where(on, total, 1))[on]
    return out


def _cepstrum(mag, rate, low, high):
    bins = mag.shape[1]
    cepstra = np.log(np.maximum(mag, EPSILON)) @ dct_matrix(bins, bins).T
    first, last = min(round(rate / high), bins), min(round(rate / low), bins)
    out = np.zeros((len(mag), 2))
    for i, row in enumerate(cepstra) if last > first else ():
        place, top = peaks(row[first:last], row[first:last].min(), count=1)
        if len(place):
            out[i] = rate / (place[0] + first), min(abs(top[0] / row[0]), 1)
    return out


PITCH = {"cepstrum": _cepstrum, "hps": _harmonic_product, "yin": _yin}


def pitch(x, rate, algorithm="yin", low=20.0, high=10000.0, midi=False, win=1024, hop=-1, fft=-1, padding="default"):
    """Pitch and confidence."""
    out = PITCH[algorithm](np.abs(spectrum(x, win, hop, fft, padding)), rate, low, high)
    if midi:
        out[:, 0] = _midi(out[:, 0])
    return out


def loudness(x, rate, weighting=True, true_peak=True, win=1024, hop=512, padding="default", continuous=False):
    """Loudness and peak in dB.  The filter's state goes on from window to window although windows overlap, unless ``continuous``."""
    b, a = spectral.k_weighting(rate)
    pad = spectral.padding_of(padding, win, hop)
    parts = spectral.frames(x, win, hop, pad)
    if weighting and continuous:
        heard = spectral.frames(spectral.recursive(np.pad(np.asarray(x, float), (pad, pad)), b, a), win, hop)
    else:
        state: list = [[0.0] * 4, [0.0] * 4]
        heard = np.array([spectral.recursive(p, b, a, state) for p in parts]) if weighting else parts
    level = -0.691 + 10 * np.log10((heard**2).mean(axis=1) + EPSILON)
    top = np.array([spectral.oversampled_peak(p, rate) for p in parts]) if true_peak else np.abs(parts).max(axis=1)
    return np.stack([level, 20 * np.log10(top + EPSILON)], axis=1)


def sine_feature(x, rate, count=10, threshold=-96.0, by_frequency=True, midi=False, db=True, win=1024, hop=-1, fft=-1, padding="default"):
    """Frequencies, then magnitudes, of spectral peaks; fills up with 0 or -999 and 0 or -144."""
    spec = np.abs(spectrum(x, win, hop, fft, padding)) * 4 / win
    step = rate / (2 * (spec.shape[1] - 1))
    out = np.concatenate([np.full((len(spec), count), -999.0 if midi else 0.0), np.full((len(spec), count), -144.0 if db else 0.0)], axis=1)
    for row, mag in zip(out, 20 * np.log10(np.maximum(spec, EPSILON)), strict=True):
        place, top = peaks(mag, threshold, by_height=not by_frequency, count=count)
        row[: len(place)] = _midi(place * step) if midi else place * step
        row[count : count + len(top)] = top if db else 10 ** (top / 20)
    return out


def _wrapped(p):
    return np.where((p > -np.pi) & (p > np.pi), p, p + 2 * np.pi * (1 + np.floor((-np.pi - p) / (2 * np.pi))))


def _turn(z):
    """Real part of the complex arc tangent, which stands for the phase."""
    return np.arctan(z).real


def onset_metric(metric: int, now: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Change of spectra (frames, bins) against the last and the one before."""
    mag, old = np.abs(now), np.abs(last)
    if metric == 0:
        return (mag**2).mean(axis=1)
    if metric == 1:
        return (np.linspace(0, mag.shape[1], mag.shape[1]) * mag**2).mean(axis=1)
    if metric == 2:
        return np.maximum(mag - old, 0).mean(axis=1)
    mag, old = np.maximum(mag, EPSILON), np.maximum(old, EPSILON)
    if metric == 3:
        return np.log(np.maximum(mag / old, EPSILON)).mean(axis=1)
    if metric == 4:
        ratio = np.maximum((mag / old) ** 2, EPSILON)
        return (ratio - np.log(ratio) - 1).mean(axis=1)
    if metric == 5:
        return 1 - (mag * old).sum(axis=1) / (np.linalg.norm(mag, axis=1) * np.linalg.norm(old, axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = _turn(last) - _turn(before)
        if metric in (6, 7):
            return _wrapped((_turn(now) - _turn(last) - turn) * (mag if metric == 7 else 1)).mean(axis=1)
        if metric in (8, 9):
            return np.abs(old * np.exp(1j * _wrapped(_turn(last) + turn)) - now).mean(axis=1)
    raise ValueError("metrics are 0 to 9")


def onset_feature(x, rate, metric=0, filter_size=5, frame_delta=0, win=1024, hop=-1, fft=-1, padding="default"):
    win, hop, fft = fft_settings(win, hop, fft)
    pad = spectral.padding_of(padding, win, hop)
    delta = frame_delta if 1 < metric < 5 else 0
    parts = spectral.frames(np.pad(np.asarray(x, float), (0, delta)), win + delta, hop, pad)
    spec = np.fft.rfft(parts[:, :win] * window("hann", win), fft, axis=1)
    if delta:
        value = onset_metric(metric, np.fft.rfft(parts[:, delta : delta + win] * window("hann", win), fft, axis=1), spec, spec)
    else:
        shifted = np.concatenate([np.zeros((2, spec.shape[1])), spec])
        value = onset_metric(metric, spec, shifted[1:-1], shifted[:-2])
    if filter_size >= 3:
        return (value - spectral.running_median(value, filter_size))[:, None]
    return value[:, None]


@lru_cache(maxsize=16)
def _checkerboard(size: int) -> np.ndarray:
    g = window("gaussian", size)
    sign = np.where(np.arange(size) < size // 2, -1, 1)
    # The middle counts with what comes after it.
    return np.outer(g, g) * np.outer(sign, sign)


def novelty(features: np.ndarray, kernel: int = 3, smoothing: int = 1) -> np.ndarray:
    """Novelty of a feature sequence by a checkerboard over its own similarity, smoothed."""
    if kernel % 2 == 0:
        raise ValueError("the kernel is odd")
    padded = np.concatenate([np.zeros((kernel - 1, features.shape[1])), features])
    norm = np.maximum(np.linalg.norm(padded, axis=1), EPSILON)
    board = _checkerboard(kernel)
    total = np.zeros(len(features))
    for i in range(kernel):
        for j in range(kernel):
            a, b = slice(i, i + len(features)), slice(j, j + len(features))
            product = norm[a] * norm[b]
            total += board[i, j] * (padded[a] * padded[b]).sum(axis=1) / np.maximum(product, EPSILON)
    value = total / (board**2).sum()
    return np.convolve(value, np.ones(smoothing) / smoothing)[: len(value)]


NOVELTY = {"spectrum": lambda x, rate, **s: np.abs(spectrum(x, **s)), "mfcc": mfcc, "chroma": chroma, "pitch": pitch, "loudness": lambda x, rate, win=1024, hop=-1, fft=-1, padding="default": loudness(x, rate, win=win, hop=fft_settings(win, hop)[1], padding=padding)}


def novelty_feature(x, rate, algorithm="spectrum", kernel=3, smoothing=1, win=1024, hop=-1, fft=-1, padding="default"):
    return novelty(NOVELTY[algorithm](x, rate, win=win, hop=hop, fft=fft, padding=padding), kernel, smoothing)[:, None]


def _level(x, rate, floor, high_pass):
    """Level in dB of each sample; what isn't finite holds the last that was."""
    x = np.asarray(x, float)
    fine = np.isfinite(x)
    x = np.r_[0.0, np.where(fine, x, 0)][np.maximum.accumulate(np.where(fine, np.arange(1, len(x) + 1), 0))]
    if high_pass > 0:
        x = spectral.high_pass(x, min(high_pass / rate, 0.5))
    with np.errstate(divide="ignore"):
        return np.maximum(20 * np.log10(np.abs(x)), floor)


def amp_feature(x, rate, fast_up=1, fast_down=1, slow_up=100, slow_down=100, floor=-144.0, high_pass=85.0):
    """Fast minus slow envelope in dB, per sample."""
    level = _level(x, rate, floor, high_pass)
    return (spectral.slide(level, fast_up, fast_down, floor) - spectral.slide(level, slow_up, slow_down, floor))[:, None]


DESCRIPTORS = {
    "mel_bands": mel_bands, "mfcc": mfcc, "spectral_shape": spectral_shape, "chroma": chroma, "pitch": pitch, "loudness": loudness,
    "sine_feature": sine_feature, "onset_feature": onset_feature, "novelty_feature": novelty_feature, "amp_feature": amp_feature,
}
