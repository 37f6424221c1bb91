"""Copies among images, cropped or edited, by local descriptors.

Corners are taken on several scales, one to about ``AREA`` pixels and
``CORNERS`` at least, turned upright by the direction of their brightness
centroid and described by 256 binary brightness tests.  Two corners of two
pictures match if their descriptors differ in ``NEAR`` bits at most, and two
pictures are linked if ``AGREE`` distinct corners of both agree, in either
direction, on one shift, turn and scale among all matches.  Links join into
components.

Every link is found.  Pictures are dealt over blocks and each two blocks meet
in one task, where all descriptors are compared, by products of bits; what
can't reach ``AGREE`` is told from the matches by scale, turn and place, and the
others are put to the vote.  A task gives the links of each picture as a number
and the edges that join its pictures, so no list of all links is ever made.
Time grows with the square of the pictures.

Images are PNG (8 bits, not interlaced) or binary PGM/PPM in a binary column.

Defined results: a null, empty or unreadable image (one whose header or body is
wrong, or that has more than ``PIXELS_READ`` pixels), or one without corners,
is alone; byte-equal images are one and share a component; a null id takes no
part in naming a component; repeated rows are returned each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stage
from .components import components
from .memory import released

SCALES = (1.0, 0.75, 0.5)
#: Corners described per image, over all scales: at least, and one more to so many pixels.
CORNERS, AREA = 30, 300
#: Corners described at a time.
PATCHES = 512
PIXELS_READ = 1 << 26
RADIUS = 14
BITS = 256
#: Differing bits up to which descriptors match.
NEAR = 40
#: Blocks at least; pictures and corners of a block on average at most.
BLOCKS, BUCKET, CORNERS_HELD = 8, 8192, 1 << 20
#: Corners compared at a time (rows, columns), rows that are kept packed, and pairs of matches looked at at a time.
ROWS, COLUMNS, KEPT, LOOKED = 3072, 2048, 24576, 1 << 21
#: Corners that must agree, within so many pixels, so much turn and scale.
AGREE, PIXELS, TURN, SCALE = 6, 2.5, 0.2, 0.25

#: Products are made of so many descriptors at once, each in a byte of a double, and nearness is the highest bit of it.
FIELDS = 6
FLAGS = np.array([128 << (8 * i) for i in range(FIELDS)], np.uint64)
MASK = FLAGS.sum(dtype=np.uint64)
#: Parts of a whole turn; matches within ``TURN`` of one lie in two neighbouring ones.
TURNS = int(2 * np.pi / (2 * TURN + 0.01))

_random = np.random.default_rng(20)
PAIRS = np.clip(_random.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS, RADIUS)
_grid = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
DISC = (_grid**2).sum(axis=0) <= RADIUS**2
#: Ratios of scales fall into groups; only those of one group are within ``SCALE`` of each other.
_ratios = np.unique(np.log(np.divide.outer(SCALES, SCALES)))
GROUPS = ((_ratios[1:] + _ratios[:-1]) / 2)[np.diff(_ratios) > SCALE]


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values (height, width) of a PNG, PGM or PPM; None if unreadable, whatever is wrong with it."""
    try:
        if not data:
            return None
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] in (b"P5", b"P6"):
            head = data[:200].split(None, 4)
            width, height, top = (int(x) for x in head[1:4])
            channels, start = (1 if data[:2] == b"P5" else 3), data.index(head[3], sum(map(len, head[:3]))) + len(head[3]) + 1
            if not 0 < top <= 255 or min(width, height) < 1 or width * height > PIXELS_READ:
                return None
            pixels = np.frombuffer(data, np.uint8, width * height * channels, start).reshape(height, width, channels)
            return pixels.mean(axis=2)
    except Exception:  # noqa: BLE001 - one bad image among billions must not end the job
        return None
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, body, palette = 8, [], None
    width = height = kind = 0
    while at + 8 <= len(data):
        (size,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", chunk)
            if depth != 8 or laced or min(width, height) < 1 or width * height > PIXELS_READ:
                return None
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(chunk)
        at += 12 + size
    if not width:
        return None
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    size = height * (1 + width * step)
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(body), size), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    before = np.zeros(width * step, np.uint8)
    for y, (how, line) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:], strict=True)):
        if how > 4:
            return None
        if how == 0:
            now = line
        elif how == 1:
            now = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif how == 2:
            now = line + before
        else:
            now = np.zeros_like(line)
            for x in range(len(line)):
                left, up = int(now[x - step]) if x >= step else 0, int(before[x])
                corner = int(before[x - step]) if x >= step else 0
                if how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    far = (abs(p - left), abs(p - up), abs(p - corner))
                    guess = (left, up, corner)[far.index(min(far))]
                now[x] = (int(line[x]) + guess) & 255
        out[y] = before = now
    pixels = out.reshape(height, width, step)
    if kind == 3:
        return palette[pixels[:, :, 0]].mean(axis=2)
    return pixels[:, :, : 1 if step < 3 else 3].astype(float).mean(axis=2)


def encode_png(grey: np.ndarray) -> bytes:
    """A grey image as PNG."""
    height, width = grey.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), np.clip(grey, 0, 255).astype(np.uint8)], axis=1).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def resize(grey: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear."""
    if factor == 1.0:
        return grey
    height, width = (max(2, round(n * factor)) for n in grey.shape)
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in zip((height, width), grey.shape, strict=True))
    y0, x0 = np.minimum(y.astype(int), grey.shape[0] - 2), np.minimum(x.astype(int), grey.shape[1] - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    a, b = grey[y0][:, x0], grey[y0][:, x0 + 1]
    c, d = grey[y0 + 1][:, x0], grey[y0 + 1][:, x0 + 1]
    return (a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy


def box(x: np.ndarray, half: int) -> np.ndarray:
    """Mean over a square of side 2 * half + 1."""
    size = 2 * half + 1
    total = np.pad(np.pad(x, half, mode="edge").cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    return (total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]) / size**2


#: A corner as it travels: descriptor and place.
CORNER = np.dtype([("code", "<u8", 4), ("place", "<f4", 4)])


def describe(grey: np.ndarray | None, corners: int = CORNERS) -> tuple[np.ndarray, np.ndarray]:
    """Corners (n, 4: x, y, scale, angle) and their descriptors (n, 4) of 64 bits each."""
    found, strengths = [], []
    if grey is None or min(grey.shape) < 8:
        return np.zeros((0, 4)), np.zeros((0, 4), np.uint64)
    corners = max(corners, grey.size // AREA)
    for scale in SCALES:
        image = box(resize(grey, scale), 1)
        if min(image.shape) < 8:
            continue
        gy, gx = np.gradient(image)
        xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        strength = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
        padded = np.pad(strength, 1, constant_values=-1.0)
        height, width = image.shape
        top = np.max([padded[i : i + height, j : j + width] for i in range(3) for j in range(3) if (i, j) != (1, 1)], axis=0)
        strength = np.where(strength > np.maximum(top, 4.0), strength, 0)
        strength[:3] = strength[-3:] = strength[:, :3] = strength[:, -3:] = 0
        strongest = np.flatnonzero(strength)
        strongest = strongest[np.argsort(-strength.flat[strongest], kind="stable")[:corners]]
        found.append((scale, image, strongest))
        strengths.append(strength.flat[strongest] * scale)
    if not found:
        return np.zeros((0, 4)), np.zeros((0, 4), np.uint64)
    # Only the strongest over all scales are described.
    best = np.argsort(-np.concatenate(strengths), kind="stable")[:corners]
    place, code = np.zeros((len(best), 4)), np.zeros((len(best), 4), np.uint64)
    before = 0
    for scale, image, strongest in found:
        rows = np.flatnonzero((best >= before) & (best < before + len(strongest)))
        chosen = strongest[best[rows] - before]
        before += len(strongest)
        width = image.shape[1]
        reach = 2 * RADIUS
        wide = np.pad(image, reach, mode="edge")
        smooth = box(wide, 1)
        for first in range(0, len(chosen), PATCHES):
            at, row = chosen[first : first + PATCHES], rows[first : first + PATCHES]
            y, x = np.divmod(at, width)
            patch = wide[(y[:, None, None] + reach + _grid[0]), (x[:, None, None] + reach + _grid[1])] * DISC
            angle = np.arctan2((patch * _grid[0]).sum(axis=(1, 2)), (patch * _grid[1]).sum(axis=(1, 2)))
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            dx = np.rint(PAIRS[None, :, :, 0] * cos - PAIRS[None, :, :, 1] * sin).astype(int)
            dy = np.rint(PAIRS[None, :, :, 0] * sin + PAIRS[None, :, :, 1] * cos).astype(int)
            tested = smooth[y[:, None, None] + reach + dy, x[:, None, None] + reach + dx]
            bits = tested[:, :, 0] < tested[:, :, 1]
            code[row] = np.packbits(bits, axis=1, bitorder="little").view("<u8")
            place[row] = np.stack([(x + 0.5) / scale, (y + 0.5) / scale, np.full(len(x), 1 / scale), angle], axis=1)
    return place, code


def consensus(a: np.ndarray, b: np.ndarray, enough: int | None = None) -> int:
    """Most distinct corners of both images that agree on one similarity; some number from ``enough`` on, if that is given and reached.

    ``a``, ``b``: matched corners (n, 4), row by row.
    """
    turn, scale = b[:, 3] - a[:, 3], b[:, 2] / a[:, 2]
    cos, sin = scale * np.cos(turn), scale * np.sin(turn)
    shift = b[:, :2] - np.stack([cos * a[:, 0] - sin * a[:, 1], sin * a[:, 0] + cos * a[:, 1]], axis=1)
    best = 0
    first, second = (np.rint(x[:, 0]).astype(np.int64) * (2 * PIXELS_READ) + np.rint(x[:, 1]).astype(np.int64) for x in (a, b))
    step = max(1, min(PATCHES, LOOKED // max(1, len(a))))
    for at in range(0, len(a), step):
        c, s, own, t, z = (x[at : at + step, None] for x in (cos, sin, shift[:, None], turn, scale))
        moved = np.stack([c * a[None, :, 0] - s * a[None, :, 1], s * a[None, :, 0] + c * a[None, :, 1]], axis=2) + own[:, 0]
        near = ((moved - b[None, :, :2]) ** 2).sum(axis=2) <= (PIXELS * np.maximum(1, b[None, :, 2])) ** 2
        wrapped = np.abs((turn[None] - t + np.pi) % (2 * np.pi) - np.pi)
        near &= (wrapped <= TURN) & (np.abs(np.log(scale[None] / z)) <= SCALE)
        count = near.sum(axis=1)
        rows = np.flatnonzero(count >= max(AGREE, best + 1))
        for row in near[rows[np.argsort(-count[rows], kind="stable")]]:
            best = max(best, min(len(set(first[row].tolist())), len(set(second[row].tolist()))))
            if enough is not None and best >= enough:
                return best
    return best


def agree(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether enough corners agree, in either direction."""
    a, b = a.astype(float), b.astype(float)
    return consensus(a, b, AGREE) >= AGREE or consensus(b, a, AGREE) >= AGREE


class Pictures:
    """Corners of several images, one after the other."""

    def __init__(self, corners: list[bytes]):
        corner = np.frombuffer(b"".join(corners), CORNER)
        self.code, self.place = np.ascontiguousarray(corner["code"]), np.ascontiguousarray(corner["place"])
        sizes = np.array([len(c) // CORNER.itemsize for c in corners], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.of = np.repeat(np.arange(len(corners)), sizes)
        self.scales, self.level = np.unique(self.place[:, 2], return_inverse=True)
        self.turn = np.ascontiguousarray(self.place[:, 3])

    def runs(self, most: int, first: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
        """Ranges of images (of those from ``first`` to ``end``) of ``most`` corners at most, or of one image."""
        end = len(self.starts) - 1 if end is None else end
        while first < end:
            last = min(end, max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + most, "right")) - 1))
            yield first, last
            first = last


def _bits(code: np.ndarray) -> np.ndarray:
    """Bits of descriptors by columns, and three last rows for ``_near``."""
    out = np.ones((BITS + 3, len(code)))
    out[:BITS] = np.unpackbits(code.view(np.uint8), axis=1).T
    ones = out[:BITS].sum(axis=0)
    out[BITS + 1], out[BITS + 2] = -np.ceil(ones / 2), ones % 2
    return out


def _packed(code: np.ndarray) -> list[np.ndarray]:
    """Bits of ``ROWS`` descriptors at a time, ``FIELDS`` of them in one row of numbers, a byte apart; three last columns for ``_near``."""
    out, weight = [], 256.0 ** np.arange(FIELDS)
    for at in range(0, len(code), ROWS):
        part = np.unpackbits(code[at : at + ROWS].view(np.uint8), axis=1)
        rows, ones = -(-len(part) // FIELDS), part.sum(axis=1)
        # Columns of bits, what a field starts with, 1, and whether ones are odd; fields without a descriptor stay 0.
        fields = np.zeros((FIELDS * rows, BITS + 3))
        fields[: len(part), :BITS], fields[: len(part), BITS + 1] = part, 1
        fields[: len(part), BITS], fields[: len(part), BITS + 2] = 128 + NEAR // 2 - np.ceil(ones / 2), ones % 2
        row = np.tensordot(weight, fields.reshape(FIELDS, rows, BITS + 3), 1)
        row[:, BITS] += 2.0**52
        out.append(row)
    return out


def _near(packed: list[np.ndarray], code: np.ndarray, columns: np.ndarray | None, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both descriptors that differ in ``NEAR`` bits at most; ``columns``: of ``code``, if it is short; ``space`` is written over.

    Half the differing bits, rounded up, are the halves of both numbers of ones,
    rounded up, less the ones in common and less 1 if both numbers are odd.  A
    field holds 128 and ``NEAR`` / 2 less that, from 20 to 148, so its highest
    bit is set if, and only if, the two are near; sums stay whole and below 2^53.
    """
    found = []
    for to in range(0, len(code), COLUMNS):
        other = _bits(code[to : to + COLUMNS]) if columns is None else columns
        for n, own in enumerate(packed):
            sums = space[: len(own) * other.shape[1]].reshape(len(own), -1)
            bits = np.matmul(own, other, out=sums).view(np.uint64)
            bits &= MASK
            cell = np.flatnonzero(bits != 0)
            bits = bits.ravel()[cell]
            row, column = np.divmod(cell.astype(np.int32), np.int32(other.shape[1]))
            for field in range(FIELDS):
                here = np.flatnonzero(bits & FLAGS[field])
                found.append((row[here] + np.int32(n * ROWS + field * len(own)), column[here] + np.int32(to)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _may_agree(a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Kinds among whose matches (rows of ``a`` and ``b``) one has ``AGREE``, itself included, that fit its turn, shift and scale; no other can win the vote."""
    turn = (b[:, 3].astype(float) - a[:, 3]) % (2 * np.pi)
    wide, whole = TURN + 1e-4, 2 * np.pi
    low, high = np.flatnonzero(turn <= wide), np.flatnonzero(turn >= whole - wide)
    key = np.concatenate([kind * 8 + turn, kind[low] * 8 + turn[low] + whole, kind[high] * 8 + turn[high] - whole])
    order = np.argsort(key)
    key, row = key[order], np.concatenate([np.arange(len(turn)), low, high])[order]
    refs = order[order < len(turn)]
    own = kind[refs] * 8 + turn[refs]
    first = np.searchsorted(key, own - wide)
    counts = np.searchsorted(key, own + wide, "right") - first
    kept = counts >= AGREE
    refs, first, counts = refs[kept], first[kept], counts[kept]
    ends, passed, at = np.cumsum(counts), [], 0
    while at < len(refs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOKED, "right")))
        n = counts[at:to]
        starts = np.r_[0, np.cumsum(n)[:-1]]
        other = row[np.repeat(first[at:to] - starts, n) + np.arange(n.sum())]
        ref = refs[at:to]
        scale = b[ref, 2] / a[ref, 2]
        cos, sin = np.repeat(scale * np.cos(turn[ref]), n), np.repeat(scale * np.sin(turn[ref]), n)
        ref = np.repeat(ref, n)
        dx, dy = a[other, 0] - a[ref, 0], a[other, 1] - a[ref, 1]
        far = np.hypot(b[other, 0] - b[ref, 0] - cos * dx + sin * dy, b[other, 1] - b[ref, 1] - sin * dx - cos * dy)
        slack = PIXELS * 1.001 + 0.01
        there = far <= slack * np.maximum(1, b[other, 2])
        back = far <= slack * np.maximum(1, a[other, 2]) * np.repeat(scale, n)
        enough = (np.add.reduceat(there, starts, dtype=np.int64) >= AGREE) | (np.add.reduceat(back, starts, dtype=np.int64) >= AGREE)
        passed.append(kind[refs[at:to]][enough])
        at = to
    return np.unique(np.concatenate(passed)) if passed else np.zeros(0, np.int64)


def linked(a: Pictures, b: Pictures | None) -> Iterator[tuple[int, int]]:
    """Every two linked images, of ``a`` and of ``b``, or of ``a`` alone."""
    other = a if b is None else b
    groups, levels = len(GROUPS) + 1, len(a.scales) * len(other.scales)
    group = np.searchsorted(GROUPS, np.log(other.scales[None] / a.scales[:, None])).ravel()
    grouped = (group[:, None] == np.arange(groups)).astype(float)
    columns = [(u, v, slice(other.starts[u], other.starts[v])) for u, v in other.runs(COLUMNS)]
    space = np.empty(-(-ROWS // FIELDS) * COLUMNS)
    for first, last in a.runs(KEPT):
        rows = [(s, e, slice(a.starts[s], a.starts[e])) for s, e in a.runs(ROWS, first, last)]
        packed = [_packed(a.code[p]) for _, _, p in rows]
        for u, v, q in columns:
            if b is None and v <= first:
                continue
            ready = _bits(other.code[q]) if q.stop - q.start <= COLUMNS else None
            turn, y = other.turn[q], (other.of[q] - u) * levels + other.level[q]
            for (s, e, p), own in zip(rows, packed, strict=True):
                if b is None and v <= s:
                    continue
                i, j = _near(own, other.code[q], ready, space)
                # Two pictures need AGREE matches of one group of scales, and these of neighbouring turns.
                key = ((a.of[p] - s) * ((v - u) * levels) + a.level[p] * len(other.scales))[i] + y[j]
                count = np.bincount(key, minlength=(e - s) * (v - u) * levels).reshape(-1, levels)
                many = count @ grouped >= AGREE
                kept = np.flatnonzero(many[:, group].ravel()[key])
                i, j, key = i[kept], j[kept], key[kept]
                kind, many = key // levels * groups + group[key % levels], many.ravel()
                part = ((turn[j] - a.turn[p][i]) * np.float32(TURNS / (2 * np.pi)) + np.float32(2 * TURNS)).astype(np.int32) % TURNS
                cell = (np.cumsum(many) - 1)[kind] * TURNS + part
                count = np.bincount(cell, minlength=TURNS * np.count_nonzero(many)).reshape(-1, TURNS)
                two = count + np.roll(count, 1, axis=1) >= AGREE
                kept = np.flatnonzero((two | np.roll(two, -1, axis=1)).ravel()[cell])
                kept = kept[np.argsort(kind[kept], kind="stable")]
                i, j, kind = i[kept] + p.start, j[kept] + q.start, kind[kept]
                if b is None:
                    up = a.of[i] < a.of[j]
                    i, j, kind = i[up], j[up], kind[up]
                if not len(kind):
                    continue
                near, far = a.place[i], other.place[j]
                maybe = _may_agree(near, far, kind)
                starts, ends = np.searchsorted(kind, maybe), np.searchsorted(kind, maybe, "right")
                before = -1
                for k, m, n in zip((maybe // groups).tolist(), starts.tolist(), ends.tolist(), strict=True):
                    if k != before and agree(near[m:n], far[m:n]):
                        before = k
                        yield s + k // (v - u), u + k % (v - u)


def _links_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sub, block, image): (image, null, its links) and edges (image, image, null) that join what the links do, of each ``sub``."""
    held: tuple[list, list, list] = ([], [], [])

    def found() -> pa.RecordBatch:
        image, block, corners = held
        cut = next((i for i, g in enumerate(block) if g != block[0]), len(block))
        a, b = Pictures(corners[:cut]), Pictures(corners[cut:]) if cut < len(block) else None
        links, root, edges = np.zeros(len(image), np.int64), list(range(len(image))), []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in linked(a, b):
            y += 0 if b is None else cut
            links[x] += 1
            links[y] += 1
            p, q = top(x), top(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((image[x], image[y], None))
        rows = [(n, None, k) for n, k in zip(image, links.tolist(), strict=True) if k] + edges
        return pa.RecordBatch.from_pylist([dict(zip(("a", "b", "links"), r, strict=True)) for r in rows], LINKS)

    now = None
    for batch in released(batches):
        for sub, *row in zip(*(batch.column(c).to_pylist() for c in ("sub", "block", "image", "corners")), strict=True):
            if sub != now:
                if held[0] and (now // SPREAD == now % SPREAD or held[1][0] != held[1][-1]):
                    yield found()
                now, held = sub, ([], [], [])
            for column, value in zip(held, (row[1], row[0], row[2]), strict=True):
                column.append(value)
    if held[0] and (now // SPREAD == now % SPREAD or held[1][0] != held[1][-1]):
        yield found()


#: Number of two blocks: the lesser times this, and the greater.
SPREAD = 1 << 20
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _links(described: DataFrame, bucket: int) -> DataFrame:
    """(a, b, links) as of ``_links_kernel``, from (image, corners)."""
    described = described.where(F.length("corners") >= AGREE * CORNER.itemsize)
    images, corners = described.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("corners")), F.lit(0))).first()
    blocks = max(BLOCKS, -(-images // bucket), -(-corners // (CORNER.itemsize * CORNERS_HELD)))
    block = F.pmod(F.xxhash64("image"), F.lit(blocks))
    places = F.expr(f"transform(sequence(0L, {blocks - 1}L), j -> least(j, block) * {SPREAD}L + greatest(j, block))")
    met = described.withColumn("block", block).select(F.explode(places).alias("sub"), "block", "image", "corners")
    met = met.repartitionByRange(blocks * (blocks + 1) // 2, "sub").sortWithinPartitions("sub", "block", "image")
    return stage(met.mapInArrow(_links_kernel, "a long, b long, links long"), "links")


def copies(images: DataFrame, id_col: str = "image_id", image_col: str = "image", bucket: int = BUCKET) -> DataFrame:
    """(image_id, component_id, links) for each row: the smallest id reachable and the links of its image."""
    ids = stage(images.select(F.col(id_col).cast("long").alias("image_id"), F.sha2(F.col(image_col), 256).alias("hash")), "image-ids")
    # Byte-equal images are one, numbered by the hash of their bytes.
    number = F.conv(F.substring("hash", 1, 15), 16, 10).cast("long")
    distinct = images.select(F.col(image_col).alias("image"), F.sha2(F.col(image_col), 256).alias("hash")).where("image is not null")
    distinct = distinct.groupBy("hash").agg(F.first("image").alias("image")).select(number.alias("image"), F.col("image").alias("bytes"))

    def describe_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place, code = describe(decode(data.as_py()))
                if len(place):
                    packed = np.zeros(len(place), CORNER)
                    packed["code"], packed["place"] = code, place
                    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([packed.tobytes()], pa.binary())], ["image", "corners"])

    described = stage(distinct.mapInArrow(describe_kernel, "image long, corners binary"), "descriptors")
    found = _links(described, bucket)
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    degree = found.where("links IS NOT NULL").groupBy(F.col("a").alias("n")).agg(F.sum("links").alias("links"))
    named = ids.withColumn("number", number).join(roots, F.col("number") == F.col("node"), "left").withColumn("root", F.coalesce("root", "number"))
    least = named.where("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("image_id").alias("component_id"))
    out = named.join(least, F.col("root") == F.col("of"), "left").join(degree, F.col("number") == F.col("n"), "left")
    return out.select("image_id", F.coalesce("component_id", "image_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))


def scene(seed: int, side: int = 96) -> np.ndarray:
    """An invented picture: shaded ground, boxes and discs."""
    random = np.random.default_rng(seed)
    y, x = np.mgrid[:side, :side]
    out = 90 + 60 * (x * random.uniform(-1, 1) + y * random.uniform(-1, 1)) / side
    for _ in range(18):
        cx, cy, w, h = random.uniform(0, side), random.uniform(0, side), random.uniform(5, 22), random.uniform(5, 22)
        u = random.uniform(0, np.pi)
        dx, dy = (x - cx) * np.cos(u) + (y - cy) * np.sin(u), (y - cy) * np.cos(u) - (x - cx) * np.sin(u)
        inside = (np.abs(dx) < w / 2) & (np.abs(dy) < h / 2) if random.random() < 0.7 else (dx / w) ** 2 + (dy / h) ** 2 < 0.25
        out = np.where(inside, random.uniform(0, 255), out)
    return np.clip(out, 0, 255)


def edited(grey: np.ndarray, how: int, kind: int = 0) -> np.ndarray:
    """Edit 1 crops, to 69 or 49 % of the area; edit 2 changes brightness and contrast and pastes a box, turns, or scales."""
    if how == 1:
        return grey[10:-6, 8:-8] if kind % 3 else grey[6:-22, 20:-8]
    if how == 2 and kind % 4 == 1:
        return np.rot90(grey)
    if how == 2 and kind % 4 == 2:
        return resize(grey, 0.75)
    if how == 2:
        out = grey * 0.8 + 30
        out[-16:, -20:] = 250
        return out
    return grey


#: The picture that one row in 64 is a version of.
POPULAR = 1 << 41


def render(vectors: DataFrame) -> DataFrame:
    """(image_id, image): an invented picture for every row of (vec_id, embedding).

    Of four consecutive ids the first has a picture, the second a crop of it,
    the third an edit of it, and the fourth a picture of its own that its
    vector decides; but the last of 64 has one that all of these share, each in
    a brightness and a crop of its own.  Stands in for a media column, which
    the tables lack.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = []
            for n, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n is not None and n % 64 == 63:
                    k = n // 64
                    images.append(encode_png((scene(POPULAR) * (0.75 + k % 97 / 400) + k % 13)[k % 7 : 89 + k % 5, k % 6 : 90 + k % 3]))
                elif n is None or n % 4 == 3:
                    images.append(encode_png(scene(zlib.crc32(repr(vector).encode()) + (1 << 40))))
                else:
                    images.append(encode_png(edited(scene(n - n % 4), n % 4, n // 4)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], ["image_id", "image"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(kernel, "image_id long, image binary")
