"""Operators on long buffers (buffer_id, chan, frame, value): ranges, picks, maps, mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DataError

CLIPPING = ("none", "minimum", "maximum", "both")


def select_range(frames: DataFrame, start_frame: int = 0, num_frames: int = -1, start_chan: int = 0, num_chans: int = -1) -> DataFrame:
    """A region, renumbered from 0; -1 means to the end.  The filter reaches the files."""
    if start_frame < 0 or start_chan < 0 or num_frames == 0 or num_chans == 0 or num_frames < -1 or num_chans < -1:
        raise DataError("a range is invalid")
    out = frames.where((F.col("frame") >= start_frame) & (F.col("chan") >= start_chan))
    if num_frames > 0:
        out = out.where(F.col("frame") < start_frame + num_frames)
    if num_chans > 0:
        out = out.where(F.col("chan") < start_chan + num_chans)
    return out.withColumn("frame", F.col("frame") - start_frame).withColumn("chan", F.col("chan") - start_chan)


def _picked(frames: DataFrame, column: str, indices: list[int]) -> DataFrame:
    if indices == [-1]:
        return frames
    if any(i < 0 for i in indices):
        raise DataError("an index is out of range")
    # Where each source index goes, repeats included: as long as the list that was passed.
    goes: dict[int, list[int]] = {}
    for to, index in enumerate(indices):
        goes.setdefault(index, []).append(to)
    targets = F.create_map(*[F.lit(x) if isinstance(x, int) else F.array(*map(F.lit, x)) for pair in goes.items() for x in pair])
    out = frames.where(F.col(column).isin(list(goes))).withColumn("_to", F.explode(targets[F.col(column).cast("int")]))
    return out.withColumn(column, F.col("_to").cast("long")).drop("_to")


def select(frames: DataFrame, indices: list[int] = (-1,), channels: list[int] = (-1,)) -> DataFrame:
    """Frames and channels by index, in the order given; [-1] takes all."""
    return _picked(_picked(frames, "frame", list(indices)), "chan", list(channels))


def select_every(frames: DataFrame, frame_hop: int = 1, chan_hop: int = 1, start_frame: int = 0, num_frames: int = -1, start_chan: int = 0, num_chans: int = -1) -> DataFrame:
    """Every ``frame_hop``-th frame and ``chan_hop``-th channel of a region; n / hop of them, rounded."""
    if frame_hop < 1 or chan_hop < 1:
        raise DataError("a hop must be positive")
    region = select_range(frames, start_frame, num_frames, start_chan, num_chans)
    out = region
    for column, hop, count in (("frame", frame_hop, num_frames), ("chan", chan_hop, num_chans)):
        if hop > 1:
            if count > 0:
                top = F.lit(count)
            else:
                top = F.max(column).over(Window.partitionBy("buffer_id")) + 1
            out = out.withColumn("_n", F.floor(top / hop + 0.5)).where((F.col(column) % hop == 0) & (F.col(column) / hop < F.col("_n")))
            out = out.withColumn(column, (F.col(column) / hop).cast("long")).drop("_n")
    return out


def thresh(frames: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Values below the threshold become 0; NaN stays."""
    return frames.withColumn("value", F.when(F.col("value") < threshold, F.lit(0.0)).otherwise(F.col("value")))


def rescale(frames: DataFrame, input_low: float = 0.0, input_high: float = 1.0, output_low: float = 0.0, output_high: float = 1.0, clipping: str = "none") -> DataFrame:
    """Affine map of one range to another, clipped where asked."""
    if clipping not in CLIPPING:
        raise DataError("clipping is none, minimum, maximum or both")
    slope = (output_high - output_low) / (input_high - input_low)
    value = F.col("value") * slope + (output_low - slope * input_low)
    if clipping in ("minimum", "both"):
        value = F.greatest(value, F.lit(output_low))
    if clipping in ("maximum", "both"):
        value = F.least(value, F.lit(output_high))
    return frames.withColumn("value", value)


def flatten(frames: DataFrame, axis: str = "channels") -> DataFrame:
    """One channel: channel after channel ("frames") or frame by frame ("channels").

    Regular buffers, so a place follows from the counts; nothing is sorted.
    """
    whole = Window.partitionBy("buffer_id")
    count = (F.max("frame") if axis == "frames" else F.max("chan")).over(whole) + 1
    place = F.col("chan") * count + F.col("frame") if axis == "frames" else F.col("frame") * count + F.col("chan")
    return frames.select("buffer_id", F.lit(0).cast("long").alias("chan"), place.alias("frame"), "value")


def compose(source: DataFrame, destination: DataFrame, gain: float = 1.0, dest_gain: float = 0.0, dest_start_frame: int = 0, dest_start_chan: int = 0) -> DataFrame:
    """Mix ``source`` into ``destination``, which grows as needed; buffers meet by id."""
    moved = source.select("buffer_id", (F.col("chan") + dest_start_chan).alias("chan"), (F.col("frame") + dest_start_frame).alias("frame"), (F.col("value") * gain).alias("_s"))
    under = destination.select("buffer_id", "chan", "frame", F.col("value").alias("_d"))
    both = under.join(moved, ["buffer_id", "chan", "frame"], "full_outer")
    # Inside the region that the source covers the destination has its own gain.
    value = F.when(F.col("_s").isNull(), F.col("_d")).otherwise(F.col("_s") + F.coalesce(F.col("_d") * dest_gain, F.lit(0.0)))
    return both.select("buffer_id", "chan", "frame", value.alias("value"))


def gain(frames: DataFrame, by: float) -> DataFrame:
    return frames.withColumn("value", F.col("value") * by)


def mono(frames: DataFrame) -> DataFrame:
    """Sum of the channels."""
    return frames.groupBy("buffer_id", "frame").agg(F.sum("value").alias("value")).select("buffer_id", F.lit(0).cast("long").alias("chan"), "frame", "value")


def spikes_to_times(spikes: DataFrame, hop: int = 1, start: int = 0) -> DataFrame:
    """(buffer_id, slice, onset) where a long buffer holds 1; a buffer without any has -1."""
    found = spikes.where("value = 1").select("buffer_id", (F.col("frame") * hop + start).alias("onset"))
    at = Window.partitionBy("buffer_id").orderBy("onset")
    found = found.withColumn("slice", (F.row_number().over(at) - 1).cast("long"))
    every = spikes.select("buffer_id").distinct()
    return every.join(found, "buffer_id", "left").select("buffer_id", F.coalesce("slice", F.lit(0)).cast("long").alias("slice"), F.coalesce("onset", F.lit(-1)).cast("long").alias("onset"))


def rising_edges(frames: DataFrame) -> DataFrame:
    """Frames where the value goes from zero or less to more."""
    at = Window.partitionBy("buffer_id", "chan").orderBy("frame")
    return frames.withColumn("_p", F.coalesce(F.lag("value").over(at), F.lit(0.0))).where("value > 0 AND _p <= 0").drop("_p")


def difference(frames: DataFrame, order: int = 1) -> DataFrame:
    """x[i] - x[i-1], ``order`` times; frames start at 0 again."""
    for _ in range(order):
        at = Window.partitionBy("buffer_id", "chan").orderBy("frame")
        frames = frames.withColumn("_p", F.lag("value").over(at)).where("_p is not null").select("buffer_id", "chan", (F.col("frame") - 1).alias("frame"), (F.col("value") - F.col("_p")).alias("value"))
    return frames


def local_peaks(frames: DataFrame, min_height: float = 0.0, count: int = 0, interpolate: bool = True, by_height: bool = True) -> DataFrame:
    """(buffer_id, chan, peak, at, height): strict local maxima above a height, refined by a parabola."""
    at = Window.partitionBy("buffer_id", "chan").orderBy("frame")
    around = frames.withColumn("_a", F.lag("value").over(at)).withColumn("_b", F.lead("value").over(at))
    found = around.where(f"value > _a AND value > _b AND value > {min_height!r}")
    shift = 0.5 * (F.col("_a") - F.col("_b")) / (F.col("_a") - 2 * F.col("value") + F.col("_b"))
    place, height = (F.col("frame") + shift, F.col("value") - 0.25 * (F.col("_a") - F.col("_b")) * shift) if interpolate else (F.col("frame").cast("double"), F.col("value"))
    found = found.select("buffer_id", "chan", place.alias("at"), height.alias("height"))
    order = Window.partitionBy("buffer_id", "chan").orderBy(*([F.desc("height"), "at"] if by_height else ["at"]))
    found = found.withColumn("peak", (F.row_number().over(order) - 1).cast("long"))
    return (found.where(F.col("peak") < count) if count else found).select("buffer_id", "chan", "peak", "at", "height")


def running_median(frames: DataFrame, size: int) -> DataFrame:
    """Causal median of the last ``size`` values, zeros before the first."""
    at = Window.partitionBy("buffer_id", "chan").orderBy("frame").rowsBetween(1 - size, 0)
    held = F.concat(F.collect_list("value").over(at), F.array_repeat(F.lit(0.0), size))
    return frames.withColumn("value", F.array_sort(F.slice(held, 1, size))[size // 2])


def moving_average(frames: DataFrame, size: int) -> DataFrame:
    """Mean of the last ``size`` values, zeros before the first."""
    at = Window.partitionBy("buffer_id", "chan").orderBy("frame").rowsBetween(1 - size, 0)
    return frames.withColumn("value", F.sum("value").over(at) / size)
