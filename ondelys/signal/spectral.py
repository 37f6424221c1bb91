"""Windows, frames, transforms and filters on NumPy arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EPSILON = np.finfo(float).eps


@lru_cache(maxsize=64)
def window(kind: str, size: int) -> np.ndarray:
    """Periodic analysis windows; ``gaussian`` has a width of a third of its (odd) size."""
    turn = 2 * np.pi * np.arange(size) / size
    if kind == "hann":
        return 0.5 - 0.5 * np.cos(turn)
    if kind == "hann_derivative":
        return np.pi / size * np.sin(turn)
    if kind == "hamming":
        return 0.54 - 0.46 * np.cos(turn)
    if kind == "blackman_harris_ref":
        return 0.35875 + (0.14128 + 0.01168 - 0.48829) * np.cos(turn)
    if kind == "gaussian":
        x = np.arange(size) - (size - 1) / 2
        return np.exp(-(x**2) / (2 * (size // 3) ** 2))
    raise ValueError(f"no window {kind}")


def next_power(n: int, up: bool = True) -> int:
    power = 1 << max(0, n - 1).bit_length()
    return power if up or power == n else power // 2


def fft_settings(win: int = 1024, hop: int = -1, fft: int = -1) -> tuple[int, int, int]:
    """Window, hop and FFT size; by default half a window and the next power of two."""
    return win, win // 2 if hop < 0 else hop, max(win, next_power(win) if fft < 0 else fft)


def padding_of(kind: str, win: int, hop: int) -> int:
    return {"none": 0, "default": win // 2, "full": win - hop}[kind]


def frames(x: np.ndarray, win: int, hop: int, pad: int = 0) -> np.ndarray:
    """(frames, win) view of the padded signal; a signal below one window is filled up."""
    x = np.pad(np.asarray(x, float), (pad, pad))
    if len(x) < win:
        x = np.pad(x, (0, win - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, win)[::hop]


def spectrum(x: np.ndarray, win: int = 1024, hop: int = -1, fft: int = -1, padding: str = "default", kind: str = "hann") -> np.ndarray:
    """Complex spectrogram (frames, fft / 2 + 1)."""
    win, hop, fft = fft_settings(win, hop, fft)
    return np.fft.rfft(frames(x, win, hop, padding_of(padding, win, hop)) * window(kind, win), fft, axis=1)


def resynthesise(spec: np.ndarray, length: int, win: int = 1024, hop: int = -1, fft: int = -1, padding: str = "default") -> np.ndarray:
    """Overlap-add inverse, divided by the summed squares of the window."""
    win, hop, fft = fft_settings(win, hop, fft)
    pad, w = padding_of(padding, win, hop), window("hann", win)
    parts = np.fft.irfft(spec, fft, axis=1)[:, :win] * w
    size = max((len(parts) - 1) * hop + win, pad + length)
    out, power = np.zeros(size), np.zeros(size)
    for i, part in enumerate(parts):
        out[i * hop : i * hop + win] += part
        power[i * hop : i * hop + win] += w * w
    return (out / np.maximum(power, EPSILON))[pad : pad + length]


@lru_cache(maxsize=16)
def dct_matrix(n: int, count: int) -> np.ndarray:
    """Orthonormal DCT-II rows."""
    i = np.arange(count)[:, None]
    return np.cos(np.pi / n * i * (np.arange(n) + 0.5)) * np.where(i == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def recursive(x: np.ndarray, b: list[float], a: list[float], state: list | None = None) -> np.ndarray:
    """Direct-form filter; ``a`` without its leading 1.  ``state`` (past inputs, past outputs) is kept if given."""
    past_x, past_y = state if state is not None else ([0.0] * (len(b) - 1), [0.0] * len(a))
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        y = b[0] * v
        for c, p in zip(b[1:], past_x, strict=True):
            y += c * p
        for c, p in zip(a, past_y, strict=True):
            y -= c * p
        past_x[:] = [v, *past_x[:-1]]
        past_y[:] = [y, *past_y[:-1]]
        out[i] = y
    return out


def high_pass(x: np.ndarray, cutoff: float, times: int = 2) -> np.ndarray:
    """Second-order Butterworth high-pass, ``times`` in series; cutoff as a share of the sample rate."""
    c = np.tan(np.pi * cutoff)
    b0 = 1 / (1 + np.sqrt(2) * c + c * c)
    for _ in range(times):
        x = recursive(x, [b0, -2 * b0, b0], [2 * b0 * (c * c - 1), b0 * (1 - np.sqrt(2) * c + c * c)])
    return x


def slide(x: np.ndarray, up: float, down: float, start: float) -> np.ndarray:
    """One-pole follower with its own speed for rising and for falling."""
    out, y, rise, fall = np.empty(len(x)), start, 1 / up, 1 / down
    for i, v in enumerate(x.tolist()):
        y += (v - y) * (rise if v > y else fall)
        out[i] = y
    return out


def running_median(x: np.ndarray, size: int) -> np.ndarray:
    """Causal median with zeros before the start, along the first axis."""
    padded = np.concatenate([np.zeros((size - 1, *x.shape[1:])), x])
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, size, axis=0), axis=-1)


def peaks(x: np.ndarray, height: float = 0.0, interpolate: bool = True, by_height: bool = True, count: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and heights of strict local maxima above ``height``."""
    i = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:]) & (x[1:-1] > height)) + 1
    place, top = i.astype(float), x[i]
    if interpolate and len(i):
        shift = 0.5 * (x[i - 1] - x[i + 1]) / (x[i - 1] - 2 * x[i] + x[i + 1])
        place, top = i + shift, x[i] - 0.25 * (x[i - 1] - x[i + 1]) * shift
    if by_height:
        order = np.argsort(-top, kind="stable")
        place, top = place[order], top[order]
    return (place[:count], top[:count]) if count else (place, top)


def k_weighting(rate: float) -> tuple[list[float], list[float]]:
    """Fixed values of the loudness standard's shelf and high-pass, as one fourth-order filter."""
    k, q = np.tan(np.pi * 1681.974450955533 / rate), 0.7071752369554196
    vh = 10 ** (3.999843853973347 / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf_b, shelf_a = np.array([vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    k, q = np.tan(np.pi * 38.13547087602444 / rate), 0.5003270373238773
    a0 = 1 + k / q + k * k
    pass_a = np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    return np.convolve(shelf_b, [1, -2, 1]).tolist(), np.convolve(shelf_a, pass_a)[1:].tolist()


def oversampled_peak(x: np.ndarray, rate: float) -> float:
    """Largest magnitude after windowed-sinc oversampling: four times, twice from 88.2 kHz, none from 176.4 kHz."""
    factor = 4 if rate < 88200 else 2 if rate < 176400 else 1
    if factor == 1:
        return float(np.abs(x).max(initial=0))
    i = np.arange(49)
    m = i - 24.0
    taps = np.sinc(m / factor) * 0.5 * (1 - np.cos(2 * np.pi * i / 48))
    up = np.zeros(len(x) * factor)
    up[::factor] = x
    return float(np.abs(np.convolve(up, taps)[: len(up)]).max(initial=0))
