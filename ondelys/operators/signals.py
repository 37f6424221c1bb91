"""Signal kernels over packed buffers: one Arrow row is one channel, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import clipped
from ..schema import DataError, with_ranks
from ..signal import decompose, descriptors, slicers, spectral
from . import stats


def _channels(batch: pa.RecordBatch) -> Iterator[tuple[str, int, float, np.ndarray]]:
    for name, chan, rate, x in zip(batch.column("buffer_id").to_pylist(), batch.column("chan").to_pylist(), batch.column("sample_rate").to_pylist(), batch.column("samples"), strict=True):
        yield name, chan, rate, np.asarray(x.values.to_numpy(zero_copy_only=False), float)


def _input(buffers: DataFrame) -> DataFrame:
    return buffers.select("buffer_id", "chan", "sample_rate", "samples")


#: Outputs of the descriptors whose outputs can be chosen by name.
OUTPUTS = {"pitch": ("pitch", "confidence"), "loudness": ("loudness", "peak"), "spectral_shape": ("centroid", "spread", "skewness", "kurtosis", "rolloff", "flatness", "crest")}


def describe_frames(buffers: DataFrame, descriptor: str, select: tuple[str, ...] | None = None, **settings) -> DataFrame:
    """(buffer_id, chan, frame, features) by a descriptor's name; ``select`` names the outputs kept, in their own order.

    A sine feature has frequencies, then magnitudes; either is chosen by name.
    """
    work, settings = descriptors.DESCRIPTORS[descriptor], clipped(settings)
    if select is not None:
        names = ("frequency", "magnitude") if descriptor == "sine_feature" else OUTPUTS.get(descriptor)
        if names is None or not set(select) <= set(names):
            raise DataError(f"{descriptor} has the outputs {', '.join(names or ())}")
        whole = work

        def work(x, rate, **settings):  # noqa: F811
            rows = np.asarray(whole(x, rate, **settings))
            each = rows.shape[1] // 2 if descriptor == "sine_feature" else 1
            return rows[:, [c for i, n in enumerate(names) if n in select for c in range(i * each, (i + 1) * each)]]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chan, rate, x in _channels(batch):
                rows = work(x, rate, **settings)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([chan] * n, pa.int64()), pa.array(np.arange(n), pa.int64()), pa.array(list(rows), pa.list_(pa.float64()))], ["buffer_id", "chan", "frame", "features"])

    return _input(buffers).mapInArrow(kernel, "buffer_id string, chan long, frame long, features array<double>")


def stft(buffers: DataFrame, **settings) -> DataFrame:
    """(buffer_id, chan, frame, magnitude, phase)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chan, _, x in _channels(batch):
                spec = spectral.spectrum(x, **settings)
                n = len(spec)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([chan] * n, pa.int64()), pa.array(np.arange(n), pa.int64()), pa.array(list(np.abs(spec)), pa.list_(pa.float64())), pa.array(list(np.angle(spec)), pa.list_(pa.float64()))], ["buffer_id", "chan", "frame", "magnitude", "phase"])

    return _input(buffers).mapInArrow(kernel, "buffer_id string, chan long, frame long, magnitude array<double>, phase array<double>")


def istft(spectra: DataFrame, length: int, sample_rate: float = 44100.0, **settings) -> DataFrame:
    """Packed buffers from (buffer_id, chan, frame, magnitude, phase); a channel's frames are one group."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        mag, phase = (np.array(table.column(c).to_pylist()) for c in ("magnitude", "phase"))
        x = spectral.resynthesise(mag * np.exp(1j * phase), length, **settings)
        return pa.table({"buffer_id": table.column("buffer_id").slice(0, 1), "chan": table.column("chan").slice(0, 1), "sample_rate": pa.array([sample_rate]), "samples": pa.array([x.astype(np.float32)], pa.list_(pa.float32()))})

    return spectra.groupBy("buffer_id", "chan").applyInArrow(work, "buffer_id string, chan long, sample_rate double, samples array<float>")


def slices(buffers: DataFrame, slicer: str, **settings) -> DataFrame:
    """(buffer_id, slice, onset, offset) of mono buffers by a slicer's name; none found is -1, only gates have offsets."""
    work, settings = slicers.SLICERS[slicer], clipped(settings)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, _, rate, x in _channels(batch):
                found = work(x, rate, **settings)
                on, off = found if isinstance(found, tuple) else (found, None)
                onsets = on.tolist() or [-1]
                offsets = [off[i] if off is not None and i < len(off) else (-1 if off is not None else None) for i in range(len(onsets))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(onsets), pa.string()), pa.array(range(len(onsets)), pa.int64()), pa.array(onsets, pa.int64()), pa.array(offsets, pa.int64())], ["buffer_id", "slice", "onset", "offset"])

    return mono(buffers).mapInArrow(kernel, "buffer_id string, slice long, onset long, offset long")


def mono(buffers: DataFrame) -> DataFrame:
    """Channels summed, sample by sample, to the length of the shortest; buffers of one channel pass."""
    pairs = F.array_sort(F.collect_list(F.struct("chan", "samples")))
    rows = buffers.groupBy("buffer_id").agg(F.first("sample_rate").alias("sample_rate"), pairs.alias("c"))
    first, rest = F.col("c")[0]["samples"], F.slice("c", 2, F.size("c"))
    samples = F.aggregate(rest, first, lambda s, c: F.filter(F.zip_with(s, c["samples"], lambda a, b: a + b), lambda v: v.isNotNull()))
    return rows.select("buffer_id", F.lit(0).cast("long").alias("chan"), "sample_rate", samples.alias("samples"))


def decomposed(buffers: DataFrame, how: str, **settings) -> DataFrame:
    """Packed buffers of the parts, named buffer/part."""
    work, settings = decompose.DECOMPOSITIONS[how], clipped(settings)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chan, rate, x in _channels(batch):
                parts = work(x, rate, **settings)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}/{p}" for p in parts], pa.string()), pa.array([chan] * n, pa.int64()), pa.array([rate] * n, pa.float64()), pa.array([np.asarray(v, np.float32) for v in parts.values()], pa.list_(pa.float32()))], ["buffer_id", "chan", "sample_rate", "samples"])

    return _input(buffers).mapInArrow(kernel, "buffer_id string, chan long, sample_rate double, samples array<float>")


def activations(buffers: DataFrame, bases: list[list[float]], iterations: int = 10, seed: int = 42, **settings) -> DataFrame:
    """(buffer_id, chan, frame, features): activations of fixed bases in each frame."""
    fixed = np.array(bases, float)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chan, _, x in _channels(batch):
                rows = decompose.nmf_match(np.abs(spectral.spectrum(x, **settings)), fixed, iterations, seed)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([chan] * n, pa.int64()), pa.array(np.arange(n), pa.int64()), pa.array(list(rows), pa.list_(pa.float64()))], ["buffer_id", "chan", "frame", "features"])

    return _input(buffers).mapInArrow(kernel, "buffer_id string, chan long, frame long, features array<double>")


def corpus(buffers: DataFrame, used: tuple[str, ...] = ("pitch", "loudness", "spectral_shape", "mfcc")) -> DataFrame:
    """Data set with one point per buffer: seven statistics of every feature of its first channel, in order."""
    found = None
    for rank, name in enumerate(used):
        long = describe_frames(buffers.where("chan = 0"), name).select("buffer_id", "frame", F.posexplode("features").alias("dim", "value"))
        long = long.select("buffer_id", (F.col("dim") + rank * 1000).cast("long").alias("chan"), "frame", F.col("value").cast("double").alias("value"))
        found = long if found is None else found.unionByName(long)
    table = stats.buf_stats(found)
    point = F.array_sort(F.collect_list(F.struct("chan", F.array(*stats.STATS).alias("v"))))
    rows = table.groupBy("buffer_id").agg(F.flatten(F.transform(point, lambda r: r["v"])).alias("point"))
    return with_ranks(rows.select(F.col("buffer_id").alias("id"), "point"), "id").select("id", "pos", "point")


PAIRED = {
    "audio_transport": lambda a, b, rate, **s: decompose.audio_transport(a, b, rate, **s),
    "nmf_cross": lambda a, b, rate, **s: decompose.nmf_cross(a, b, rate, **s),
}


def paired(first: DataFrame, second: DataFrame, how: str, **settings) -> DataFrame:
    """Packed buffers made of two that share a name and channel: a transport between them, or one rebuilt from the other."""
    work = PAIRED[how]
    other = second.select("buffer_id", "chan", F.col("samples").alias("other"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (_, _, rate, a), b in zip(_channels(batch), batch.column("other"), strict=True):
                out.append(np.asarray(work(a, np.asarray(b.values.to_numpy(zero_copy_only=False), float), rate, **settings), np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("buffer_id"), batch.column("chan"), batch.column("sample_rate"), pa.array(out, pa.list_(pa.float32()))], ["buffer_id", "chan", "sample_rate", "samples"])

    both = _input(first).join(other, ["buffer_id", "chan"]).select("buffer_id", "chan", "sample_rate", "samples", "other")
    return both.mapInArrow(kernel, "buffer_id string, chan long, sample_rate double, samples array<float>")


def nmf_seeds(buffers: DataFrame, low: int = 1, high: int = 200, coverage: float = 0.5, method: int = 0, seed: int = 42, **settings) -> DataFrame:
    """(buffer_id, chan, component, base, activation): starting factors of each channel's magnitudes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chan, _, x in _channels(batch):
                w, h = decompose.nmf_seed(np.abs(spectral.spectrum(x, **settings)), low, high, coverage, method, seed)
                n = len(w)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([chan] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(list(w), pa.list_(pa.float64())), pa.array(list(h.T), pa.list_(pa.float64()))], ["buffer_id", "chan", "component", "base", "activation"])

    return _input(buffers).mapInArrow(kernel, "buffer_id string, chan long, component long, base array<double>, activation array<double>")


def from_magnitudes(spectra: DataFrame, length: int, iterations: int = 50, sample_rate: float = 44100.0, seed: int = 42, **settings) -> DataFrame:
    """Packed buffers whose magnitudes are those of (buffer_id, chan, frame, magnitude), by iterated phases."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        x = decompose.griffin_lim(np.array(table.column("magnitude").to_pylist()), length, iterations, seed=seed, **settings)
        return pa.table({"buffer_id": table.column("buffer_id").slice(0, 1), "chan": table.column("chan").slice(0, 1), "sample_rate": pa.array([sample_rate]), "samples": pa.array([x.astype(np.float32)], pa.list_(pa.float32()))})

    return spectra.select("buffer_id", "chan", "frame", "magnitude").groupBy("buffer_id", "chan").applyInArrow(work, "buffer_id string, chan long, sample_rate double, samples array<float>")


def morphed(activations: DataFrame, source: list[list[float]], target: list[list[float]], length: int, between: float = 0.5, sample_rate: float = 44100.0, **settings) -> DataFrame:
    """Packed buffers from (buffer_id, chan, frame, features) activations on bases part of the way between two sets."""
    a, b = np.array(source, float), np.array(target, float)

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        x = decompose.nmf_morph(a, b, np.array(table.column("features").to_pylist()), length, between, **settings)
        return pa.table({"buffer_id": table.column("buffer_id").slice(0, 1), "chan": table.column("chan").slice(0, 1), "sample_rate": pa.array([sample_rate]), "samples": pa.array([x.astype(np.float32)], pa.list_(pa.float32()))})

    return activations.groupBy("buffer_id", "chan").applyInArrow(work, "buffer_id string, chan long, sample_rate double, samples array<float>")
