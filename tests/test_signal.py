"""Signal kernels on the synthetic signals whose slices are known."""

import itertools

import numpy as np
import pytest

from ondelys.operators.assignment import assign
from ondelys.signal import decompose, descriptors, slicers, spectral

FS = 44100
I = np.arange(FS)  # noqa: E741


@pytest.fixture(scope="module")
def impulses():
    x = np.zeros(FS)
    x[[1000, 12025, 23051, 34076]] = 1
    return x


@pytest.fixture(scope="module")
def sharp():
    x = np.sin(2 * np.pi * I * 640 / (FS - 1)) * (((FS - 1 - I) % (FS // 4)) / (FS / 4))
    x[:1000] = 0
    return x


@pytest.fixture(scope="module")
def smooth():
    return np.sin(2 * np.pi * 320 * I / FS) * np.abs(np.sin(2 * np.pi * I / FS))


def test_amp_slice(impulses, sharp):
    assert slicers.amp_slice(impulses, FS, 10, 5, 2, 10, 2205, 4410, 4410).tolist() == [1000, 12025, 23051, 34076]
    shape = {"fast_up": 5, "fast_down": 50, "slow_up": 220, "slow_down": 220, "floor": -60.0}
    assert slicers.amp_slice(sharp, FS, 10, 10, 2, **shape).tolist() == [1001, 1455, 1493, 11028, 11412, 11450, 22053, 22399, 22437, 22475, 33078, 33462, 33500]
    assert slicers.amp_slice(sharp, FS, 10, 5, 2, **shape).tolist() == [1001, 11028, 22053, 33078]
    assert slicers.amp_slice(sharp, FS, 10, 10, 800, **shape).tolist() == [1001, 11028, 22053, 33078]
    assert slicers.amp_slice(sharp, FS, 10, 5, 15000, **shape).tolist() == [1001, 22053]


def test_amp_gate(impulses, smooth):
    on, off = slicers.amp_gate(impulses, FS, 1, 10, -30, -90)
    assert np.abs(on - [1000, 12025, 23051, 34076]).max() <= 2 and np.abs(off - on - 596).max() <= 2
    on, off = slicers.amp_gate(smooth, FS, 5, 25, -12, -12)
    assert len(on) == len(off) == 50 and abs(on[0] - 1876) <= 1 and abs(off[0] - 1890) <= 1


@pytest.mark.parametrize("metric", [0, 1, 2, 3, 4, 8, 9])
def test_onset_slice(metric):
    x = np.zeros(FS)
    x[22049] = 1
    found = slicers.onset_slice(x, FS, metric, 0.5, 2, 5, 0, 1024, 512, 1024)
    assert len(found) == 1 and abs(found[0] - 22049) <= 34


def test_onset_slice_many(impulses):
    found = slicers.onset_slice(impulses, FS, 9, 0.1, 2, 5, 0, 512, 64, 512)
    assert np.abs(found - [1000, 12025, 23051, 34076]).max() <= 64


def test_novelty_slice(impulses, sharp, smooth):
    assert np.abs(slicers.novelty_slice(impulses, FS, "spectrum", 3, 0.5, 1, 2, 128, 64, 128) - [1000, 12025, 23051, 34076]).max() <= 128
    assert slicers.novelty_slice(sharp, FS, "spectrum", 3, 0.38, 1, 4, 512, 256, 1024).tolist() == [512, 11008, 22016, 33024]
    assert slicers.novelty_slice(smooth, FS, "spectrum", 3, 0.34, 1, 30, 512, 256, 1024).tolist() == [0, 22016]


def test_transient_slice(impulses, sharp):
    assert np.abs(slicers.transient_slice(impulses, FS) - [1000, 12025, 23051, 34076]).max() <= 8
    assert np.abs(slicers.transient_slice(sharp, FS) - [1000, 11025, 22050, 33075]).max() <= 8


@pytest.mark.parametrize("win", [32, 64, 256, 1024])
def test_overlap_add_is_identity(win):
    x = np.random.default_rng(0).normal(size=5000)
    back = spectral.resynthesise(spectral.spectrum(x, win), len(x), win)
    assert np.allclose(back[win:-win], x[win:-win])


@pytest.mark.parametrize("name", sorted(descriptors.DESCRIPTORS))
def test_descriptors_are_finite_and_silent_proof(name):
    x = np.sin(2 * np.pi * 440 * I[:8192] / FS)
    for signal in (x, np.zeros(4096), x[:10]):
        assert np.isfinite(descriptors.DESCRIPTORS[name](signal, FS)).all()


def test_known_values():
    x = np.sin(2 * np.pi * 440 * I[:8192] / FS)
    assert abs(descriptors.pitch(x, FS)[8, 0] - 440) < 5
    assert abs(descriptors.sine_feature(x, FS, count=1)[8, 0] - 440) < 3
    assert abs(descriptors.spectral_shape(x, FS)[8, 0] - 440) < 5
    assert descriptors.chroma(x, FS)[8].argmax() == 0
    # A full-scale sine is 3 dB below full scale.
    assert abs(descriptors.loudness(x, FS, weighting=False)[8, 0] - (-0.691 - 3.01)) < 0.05


def test_parts_add_up(impulses):
    x = np.sin(2 * np.pi * 440 * I[:8192] / FS) * 0.3 + impulses[:8192]
    for how in ("hpss", "transients", "sines"):
        parts = decompose.DECOMPOSITIONS[how](x, FS)
        assert np.abs(sum(parts.values()) - x)[1024:-1024].max() < 1e-9


def test_factorisation():
    v = np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9.0]])
    h, w = decompose.nmf(v, 2, 300)
    assert np.abs(h @ w - v).max() < 1e-3
    one, two, other = (decompose.nmf(v, 2, 1, s)[0] for s in (42, 42, 5063))
    assert (one == two).all() and (one != other).any()
    assert decompose.nmf_seed(np.zeros((3, 3)), 2, 2, 0.8, 1, 42)[0].shape == (2, 3)


def test_assignment_is_optimal():
    random = np.random.default_rng(0)
    for _ in range(20):
        c = random.random((4, 6))
        best = min(c[np.arange(4), list(p)].sum() for p in itertools.permutations(range(6), 4))
        assert abs(c[np.arange(4), assign(c)].sum() - best) < 1e-12


def test_transport_moves_all_mass():
    random = np.random.default_rng(1)
    a, b = random.random(20), random.random(20)
    moved = decompose.transport(a, b)
    assert abs(sum(m for *_, m in moved) - 1) < 1e-9
    assert np.allclose(decompose.morph_spectra(a, b, 0.0), a)
