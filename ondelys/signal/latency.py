"""Delay in samples with which each streaming operator answers; offline results are free of it."""

from __future__ import annotations

from .spectral import fft_settings


def latency(operator: str, win: int = 1024, hop: int = -1, fft: int = -1, *, kernel: int = 3, smoothing: int = 1, harm_size: int = 17, min_length: int = 15, order: int = 20, block: int = 256, pad: int = 128, min_above: int = 1, min_below: int = 1, look_back: int = 0, look_ahead: int = 0) -> int:
    win, hop, _ = fft_settings(win, hop, fft)
    even = smoothing + smoothing % 2
    return {
        "onset_feature": hop, "onset_slice": hop,
        "novelty_feature": hop * (1 + (kernel + 1) // 2 + even // 2), "novelty_slice": hop * (1 + (kernel + 1) // 2 + even // 2),
        "hpss": (harm_size - 1) * hop + win, "sines": win + hop * min_length,
        "transients": pad + block - order, "transient_slice": pad + block - order,
        "amp_gate": max(min_above + look_back, max(min_below, look_ahead)),
        "amp_feature": 0, "amp_slice": 0, "running_stats": 0,
    }.get(operator, win)
