"""Decompositions and morphings: arrays of samples to arrays of samples."""

from __future__ import annotations

import heapq

import numpy as np

from ..operators.assignment import assign
from . import spectral
from .spectral import EPSILON, fft_settings, resynthesise, spectrum


def ratio_mask(mixture: np.ndarray, target: np.ndarray, whole: np.ndarray, exponent: int = 1) -> np.ndarray:
    """The target's share of a complex spectrogram, 1 at most."""
    return mixture * np.minimum((target / np.maximum(whole, EPSILON)) ** exponent, 1)


def _centred_median(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (size // 2, size // 2)
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, pad), size, axis=axis), axis=-1)


def _knee(bins: int, points) -> np.ndarray:
    (x1, y1), (x2, y2) = points
    a, b = int(x1 * bins), int(x2 * bins)
    level = np.r_[np.full(a, y1), np.linspace(y1, y2, b - a), np.full(bins - b, y2)]
    return 10 ** (level / 20)


def hpss(x, rate, harm_size=17, perc_size=31, mode="classic", harm_threshold=((0, 0), (1, 0)), perc_threshold=((0, 0), (1, 0)), win=1024, hop=-1, fft=-1):
    """Harmonic, percussive and residual parts: medians over time and over frequency."""
    spec = spectrum(x, win, hop, fft)
    mag = np.abs(spec)
    h, p = _centred_median(mag, harm_size, 0), _centred_median(mag, perc_size, 1)
    rest = np.zeros_like(mag)
    with np.errstate(divide="ignore", invalid="ignore"):
        if mode == "classic":
            hm, pm = h / np.maximum(h + p, EPSILON), p / np.maximum(h + p, EPSILON)
        else:
            hm = (h / p > _knee(mag.shape[1], harm_threshold)).astype(float)
            pm = 1 - hm
            if mode == "advanced":
                pm = (p / h > _knee(mag.shape[1], perc_threshold)).astype(float)
                rest = (1 - hm) * (1 - pm)
                both = np.maximum(1 / (hm + pm + rest), EPSILON)
                hm, pm, rest = hm * both, pm * both, rest * both
    return {name: resynthesise(spec * np.minimum(m, 1), len(x), win, hop, fft) for name, m in (("harmonic", hm), ("percussive", pm), ("residual", rest))}


def nmf(v: np.ndarray, rank: int, iterations: int = 100, seed: int = 42, bases=None, activations=None, fixed_bases=False, fixed_activations=False):
    """Non-negative factors of (frames, bins): activations (frames, rank) and bases (rank, bins), Kullback-Leibler updates."""
    random = np.random.default_rng(seed)
    w = np.array(bases, float) if bases is not None else random.uniform(0, 1, (rank, v.shape[1]))
    h = np.array(activations, float) if activations is not None else random.uniform(0, 1, (len(v), rank))
    w, h = np.maximum(w, EPSILON), np.maximum(h, EPSILON)
    w, h = w / np.linalg.norm(w, axis=1, keepdims=True), h / np.linalg.norm(h, axis=0, keepdims=True)
    for _ in range(iterations):
        if not fixed_bases:
            w = w * (h.T @ (v / np.maximum(h @ w, EPSILON))) / np.maximum(h.sum(axis=0)[:, None], EPSILON)
            w = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), EPSILON)
        if not fixed_activations:
            h = h * ((v / np.maximum(h @ w, EPSILON)) @ w.T) / np.maximum(w.sum(axis=1)[None], EPSILON)
    return h, w


def nmf_match(v: np.ndarray, bases: np.ndarray, iterations: int = 10, seed: int = 42) -> np.ndarray:
    """Activations of fixed bases, frame by frame."""
    w = np.maximum(np.asarray(bases, float), EPSILON)
    w = w / np.linalg.norm(w, axis=1, keepdims=True)
    h = np.maximum(np.random.default_rng(seed).uniform(0, 1, (1, len(w))), EPSILON).repeat(len(v), axis=0)
    v = np.maximum(v, EPSILON)
    for _ in range(iterations):
        h = h * ((v / np.maximum(h @ w, EPSILON)) @ w.T) / np.maximum(w.sum(axis=1)[None], EPSILON)
    return h


def nmf_filter(x, rate, bases, iterations=10, seed=42, win=1024, hop=-1, fft=-1):
    """One signal per base, by ratio masks."""
    spec = spectrum(x, win, hop, fft)
    h, w = nmf_match(np.abs(spec), bases, iterations, seed), np.maximum(np.asarray(bases, float), EPSILON)
    w = w / np.linalg.norm(w, axis=1, keepdims=True)
    whole = h @ w
    return {f"component-{k}": resynthesise(ratio_mask(spec, np.outer(h[:, k], w[k]), whole), len(x), win, hop, fft) for k in range(len(w))}


def nmf_components(x, rate, components=1, iterations=100, seed=42, win=1024, hop=-1, fft=-1):
    """Signals of the components of a signal's own factorisation."""
    spec = spectrum(x, win, hop, fft)
    h, w = nmf(np.abs(spec), components, iterations, seed)
    return {f"component-{k}": resynthesise(ratio_mask(spec, np.outer(h[:, k], w[k]), h @ w), len(x), win, hop, fft) for k in range(components)}


def nmf_seed(v: np.ndarray, low: int = 1, high: int = 200, coverage: float = 0.5, method: int = 0, seed: int = 42):
    """Starting bases and activations from singular vectors; the rank covers a share of the singular values."""
    u, s, vt = np.linalg.svd(v.T, full_matrices=False)
    total = s.sum()
    rank = low if coverage == 0 or total == 0 else int(np.searchsorted(np.cumsum(s) / total, coverage) + 1)
    rank = min(max(rank, low), high, len(s))
    if method == 0:
        return np.abs(u[:, :rank]).T, np.abs(s[:rank, None] * vt[:rank]).T
    w, h = np.zeros((rank, len(u))), np.zeros((rank, vt.shape[1]))
    w[0], h[0] = np.abs(u[:, 0]), np.sqrt(s[0]) * np.abs(vt[0])
    for j in range(1, rank):
        halves = [(np.maximum(sign * u[:, j], 0), np.maximum(sign * vt[j], 0)) for sign in (1, -1)]
        a, b = max(halves, key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        na, nb = max(np.linalg.norm(a), EPSILON), max(np.linalg.norm(b), EPSILON)
        w[j], h[j] = a / na, np.sqrt(s[j] * na * nb) * b / nb
    mean = v.mean()
    if method == 1:
        random = np.random.default_rng(seed)
        w, h = (np.where(m < EPSILON, random.uniform(EPSILON, max(mean * 0.001, 2 * EPSILON), m.shape), m) for m in (w, h))
    elif method == 2:
        w, h = np.where(w < EPSILON, mean, w), np.where(h < EPSILON, mean, h)
    return w, h.T


def griffin_lim(mag: np.ndarray, length: int, iterations: int = 50, win: int = 1024, hop: int = -1, fft: int = -1, seed: int = 42) -> np.ndarray:
    """A signal whose spectrogram has these magnitudes; momentum 0.9."""
    phase = np.exp(2j * np.pi * np.random.default_rng(seed).uniform(0, 1, mag.shape))
    last = np.zeros(mag.shape, complex)
    for _ in range(iterations):
        estimate = spectrum(resynthesise(mag * phase, length, win, hop, fft), win, hop, fft)[: len(mag)]
        estimate = np.pad(estimate, ((0, len(mag) - len(estimate)), (0, 0)))
        step = estimate - 0.9 / 1.9 * last
        phase, last = step / (np.abs(step) + EPSILON), estimate
    return resynthesise(mag * phase, length, win, hop, fft)


def nmf_cross(target, source, rate, sparsity=7, polyphony=11, continuity=7, iterations=50, seed=42, win=1024, hop=-1, fft=-1):
    """The target rebuilt from frames of the source: sparse in time, few at once, in runs."""
    v, w = np.abs(spectrum(target, win, hop, fft)), np.maximum(np.abs(spectrum(source, win, hop, fft)), EPSILON)
    norm = np.linalg.norm(w, axis=1, keepdims=True)
    w = w / norm
    h = np.random.default_rng(seed).uniform(0, 1, (len(v), len(w)))
    for n in range(iterations):
        damp = 1 - (n + 1) / iterations
        near = np.lib.stride_tricks.sliding_window_view(np.pad(h, ((sparsity // 2, sparsity // 2), (0, 0))), sparsity, axis=0).max(axis=-1)
        h = np.where(h >= near, h, h * damp)
        strong = h * w.sum(axis=1)
        if polyphony < h.shape[1]:
            bar = np.partition(strong, -polyphony, axis=1)[:, -polyphony][:, None]
            h = np.where(strong >= bar, h, h * damp)
        run = np.zeros_like(h)
        for d in range(-(continuity // 2), continuity // 2 + 1):
            moved = np.zeros_like(h)
            moved[max(d, 0) : len(h) + min(d, 0), max(d, 0) : h.shape[1] + min(d, 0)] = h[max(-d, 0) : len(h) + min(-d, 0), max(-d, 0) : h.shape[1] + min(-d, 0)]
            run += moved
        h = np.maximum(run, EPSILON)
        h = h * ((np.maximum(v, EPSILON) / np.maximum(h @ w, EPSILON)) @ w.T) / np.maximum(w.sum(axis=1)[None], EPSILON)
    return griffin_lim(h @ w, len(target), 50, win, hop, fft, seed)


def transport(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, float]]:
    """Coupling of two mass vectors on a line: (from, to, mass), greedy and optimal in one dimension."""
    a, b = a / max(a.sum(), EPSILON), b / max(b.sum(), EPSILON)
    out, i, j, left, right = [], 0, 0, a[0], b[0]
    while i < len(a) and j < len(b):
        mass = min(left, right)
        if mass > 0:
            out.append((i, j, float(mass)))
        left, right = left - mass, right - mass
        if left <= right:
            i += 1
            left = a[i] if i < len(a) else 0
            right = max(right, 0)
        else:
            j += 1
            right = b[j] if j < len(b) else 0
    return out


def morph_spectra(a: np.ndarray, b: np.ndarray, between: float) -> np.ndarray:
    """Spectrum part of the way from one to another along the transport."""
    out = np.zeros(len(a))
    level = (1 - between) * a.sum() + between * b.sum()
    for i, j, mass in transport(a, b):
        out[round((1 - between) * i + between * j)] += mass
    return out * level


def phase_from_magnitude(mag: np.ndarray, win: int, hop: int, fft: int, tolerance: float = 1e-6, seed: int = 42) -> np.ndarray:
    """Phases by integrating the gradient that the log magnitudes imply, loudest bins first."""
    frames, bins = mag.shape
    gamma = 0.25645 * win**2
    level = np.log(np.maximum(mag, EPSILON))
    across = np.gradient(level, axis=1)
    along = np.gradient(level, axis=0) if frames > 1 else np.zeros_like(level)
    in_time = fft * hop / gamma * across + 2 * np.pi * hop * np.arange(bins) / fft
    in_freq = -gamma / (fft * hop) * along - np.pi
    random = np.random.default_rng(seed)
    phase = random.uniform(0, 2 * np.pi, mag.shape)
    for t in range(1, frames):
        waiting = set(np.flatnonzero(mag[t] > tolerance * max(mag[t].max(), mag[t - 1].max())).tolist())
        heap = [(-mag[t - 1, k], 0, k) for k in waiting]
        heapq.heapify(heap)
        while waiting and heap:
            _, now, k = heapq.heappop(heap)
            if not now:
                if k in waiting:
                    phase[t, k] = phase[t - 1, k] + (in_time[t - 1, k] + in_time[t, k]) / 2
                    waiting.discard(k)
                    heapq.heappush(heap, (-mag[t, k], 1, k))
            else:
                for to in (k - 1, k + 1):
                    if to in waiting:
                        phase[t, to] = phase[t, k] + (to - k) * (in_freq[t, k] + in_freq[t, to]) / 2
                        waiting.discard(to)
                        heapq.heappush(heap, (-mag[t, to], 1, to))
    return phase


def nmf_morph(source: np.ndarray, target: np.ndarray, activations: np.ndarray, length: int, between: float = 0.0, pair: bool = True, win: int = 1024, hop: int = -1, fft: int = -1, seed: int = 42) -> np.ndarray:
    """Activations on bases part of the way between two sets, paired at the least transport cost."""
    win, hop, fft = fft_settings(win, hop, fft)
    if pair:
        cost = np.array([[sum(m * (i - j) ** 2 for i, j, m in transport(a, b)) for b in target] for a in source])
        target = target[assign(cost)]
    bases = np.array([morph_spectra(a, b, between) for a, b in zip(source, target, strict=True)])
    mag = activations @ bases
    return resynthesise(mag * np.exp(1j * phase_from_magnitude(mag, win, hop, fft, seed=seed)), length, win, hop, fft)


def audio_transport(a: np.ndarray, b: np.ndarray, rate: float, between: float = 0.5, win: int = 1024, hop: int = -1, fft: int = -1) -> np.ndarray:
    """A sound between two: spectral masses move along the line of frequencies, phases go on from frame to frame."""
    win, hop, fft = fft_settings(win, hop, fft)
    length = min(len(a), len(b))
    x, y = spectrum(a[:length], win, hop, fft), spectrum(b[:length], win, hop, fft)
    bins = x.shape[1]
    out, running = np.zeros(x.shape, complex), np.zeros(bins)

    def masses(mag: np.ndarray) -> list[tuple[int, int, int]]:
        valley = np.flatnonzero((mag[1:-1] < mag[:-2]) & (mag[1:-1] <= mag[2:])) + 1
        edges = np.r_[0, valley, bins]
        return [(s, e, s + int(mag[s:e].argmax())) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    for t in range(len(x)):
        p, q = np.abs(x[t]), np.abs(y[t])
        left, right = masses(p), masses(q)
        moved = transport(np.array([p[s:e].sum() for s, e, _ in left]), np.array([q[s:e].sum() for s, e, _ in right]))
        for i, j, mass in moved:
            for (s, e, peak), spec, share in ((left[i], x[t], 1 - between), (right[j], y[t], between)):
                middle = round((1 - between) * left[i][2] + between * right[j][2])
                to = np.arange(s, e) - peak + middle
                fine = (to >= 0) & (to < bins)
                turn = np.exp(1j * (running[min(max(middle, 0), bins - 1)] - np.angle(spec[peak])))
                whole = max(np.abs(spec[s:e]).sum(), EPSILON)
                np.add.at(out[t], to[fine], (share * mass * (p if spec is x[t] else q).sum() / whole * spec[s:e] * turn)[fine])
        running = running + 2 * np.pi * hop * np.arange(bins) / fft
    return resynthesise(out, length, win, hop, fft)


def autoregression(x: np.ndarray, order: int, rounds: int = 3, factor: float = 3.0, least: float = 1e-7) -> tuple[np.ndarray, float]:
    """Robust linear prediction: what the model can't explain is clipped and the model fitted again."""
    heard, coefficients, variance = np.asarray(x, float), np.zeros(order), least
    for again in range(rounds + 1):
        framed = heard * spectral.window("hann", len(heard))
        size = spectral.next_power(2 * len(heard))
        auto = np.fft.irfft(np.abs(np.fft.rfft(framed, size)) ** 2, size)[: order + 1] / len(heard)
        lags = np.abs(np.arange(order)[:, None] - np.arange(order))
        matrix = auto[lags] + np.eye(order) * max(auto[0] * 1e-9, 1e-12)
        coefficients = np.linalg.solve(matrix, auto[1:])
        predicted = np.convolve(heard, np.r_[0, coefficients])[: len(heard)]
        error = heard - predicted
        variance = max(float(np.mean(error[order:] ** 2)), least)
        if again < rounds:
            bound = factor * np.sqrt(variance)
            heard = np.r_[heard[:order], (predicted + np.clip(error, -bound, bound))[order:]]
    return coefficients, variance


def transient_mask(x, order=20, block=256, pad=128, skew=0.0, forward=2.0, backward=1.1, width=14, clump=25) -> np.ndarray:
    """Samples that prediction from both sides fails on; a hop that is more than half so counts as none."""
    x = np.asarray(x, float)
    hop, half, power = block - order, width // 2, 2.0**skew
    lead = pad + 2 * order
    held = np.pad(x, (lead, pad + block + hop + half))
    triangle = 1 - np.abs(np.arange(-half, half + 1)) / (half + 1)
    mask = np.zeros(len(x), bool)
    for at in range(0, len(x), hop):
        a, variance = autoregression(held[at + lead - pad : at + lead + block + pad], order)
        part = held[at + lead - half - order : at + lead + hop + half + order]
        ahead = part - np.convolve(part, np.r_[0, a])[: len(part)]
        behind = part - np.convolve(part[::-1], np.r_[0, a])[: len(part)][::-1]
        smooth = [np.convolve((np.abs(e[order : len(e) - order]) / np.sqrt(variance)) ** power, triangle, "valid") for e in (ahead, behind)]
        f, b = ((s / triangle.sum()) ** (1 / power) for s in smooth)
        on, found = False, np.zeros(hop, bool)
        for i in range(hop):
            if not on and b[i] > backward and f[i] > forward:
                on = True
            elif on and b[i] < backward:
                on = bool((b[i : i + clump] > backward).any())
            found[i] = on
        if found.sum() <= hop // 2:
            n = min(hop, len(x) - at)
            mask[at : at + n] = found[:n]
    return mask


def transients(x, rate, order=20, block=256, pad=128, skew=0.0, forward=2.0, backward=1.1, width=14, clump=25):
    """Transients and the rest: what was detected is filled in by least squares under the model."""
    x = np.asarray(x, float)
    mask, rest, hop = transient_mask(x, order, block, pad, skew, forward, backward, width, clump), x.copy(), block - order
    for at in range(0, len(x), hop):
        unknown = np.flatnonzero(mask[at : at + hop]) + order
        if not len(unknown):
            continue
        held = np.pad(rest, (order + pad, block + pad))[at + pad : at + pad + block]
        a, _ = autoregression(np.pad(rest, (pad, block + pad))[at : at + block + 2 * pad], order)
        rows = np.zeros((block - order, block))
        for i in range(block - order):
            rows[i, i : i + order + 1] = np.r_[-a[::-1], 1]
        known = np.setdiff1d(np.arange(block), unknown)
        solved = np.linalg.lstsq(rows[:, unknown], -rows[:, known] @ held[known], rcond=None)[0]
        place = at + unknown - order
        rest[place[place < len(x)]] = solved[place < len(x)]
    return {"transients": x - rest, "residual": rest}


def sines(x, rate, bandwidth=76, threshold=-96.0, birth_low=-24.0, birth_high=-60.0, min_length=15, track_db=15.0, track_hz=50.0, win=1024, hop=-1, fft=-1, hungarian=False):
    """Sinusoids and the rest: peaks are linked into tracks, long tracks become a mask."""
    win, hop, fft = fft_settings(win, hop, fft)
    spec = spectrum(x, win, hop, fft)
    mag = np.abs(spec)
    step, bins = rate / fft, mag.shape[1]
    tracks: list[list[tuple[int, float, float]]] = []
    live: list[int] = []
    for t, frame in enumerate(20 * np.log10(np.maximum(mag * 4 / win, EPSILON))):
        place, top = spectral.peaks(frame, threshold)
        free, going = list(range(len(place))), []
        pairs = []
        if live and len(place):
            last = np.array([tracks[k][-1][1:] for k in live])
            gap_f, gap_m = np.abs(last[:, :1] - place[None] ) * step, np.abs(last[:, 1:] - top[None])
            cost = gap_f / track_hz + gap_m / track_db
            bad = (gap_f > track_hz) | (gap_m > track_db)
            if hungarian:
                chosen = assign(np.where(bad, 1e6, cost)) if len(live) <= len(place) else []
                pairs = [(i, int(j)) for i, j in enumerate(chosen) if not bad[i, j]]
            else:
                used_i, used_j = set(), set()
                for at in np.argsort(np.where(bad, np.inf, cost), axis=None).tolist():
                    i, j = divmod(at, len(place))
                    if bad[i, j]:
                        break
                    if i not in used_i and j not in used_j:
                        pairs.append((i, j))
                        used_i.add(i)
                        used_j.add(j)
        for i, j in pairs:
            tracks[live[i]].append((t, float(place[j]), float(top[j])))
            going.append(live[i])
            free.remove(j)
        loudest = top.max(initial=-np.inf)
        for j in free:
            if top[j] >= loudest + np.interp(place[j] / bins, [0, 1], [birth_low, birth_high]):
                tracks.append([(t, float(place[j]), float(top[j]))])
                going.append(len(tracks) - 1)
        live = going
    mask = np.zeros(mag.shape)
    half = max(1, round(bandwidth / 2 / max(step, EPSILON)) // 2)
    for track in tracks:
        if len(track) >= min_length:
            for t, at, _ in track:
                mask[t, max(0, round(at) - half) : round(at) + half + 1] = 1
    found = resynthesise(spec * mask, len(x), win, hop, fft)
    return {"sines": found, "residual": np.asarray(x, float) - found}


DECOMPOSITIONS = {"hpss": hpss, "sines": sines, "transients": transients, "nmf": nmf_components, "nmf_filter": nmf_filter}
