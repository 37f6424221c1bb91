"""Bit-sliced Hamming comparison of 64-bit fingerprints, in NumPy.

Fingerprints are stored vertically: plane b holds bit b of many fingerprints,
64 to a word.  One XOR per plane tells which of them differ from a query in
that bit; carry-save counters, themselves bit planes, add these up for all of
them at once, and a block is abandoned as soon as every lane in it exceeds the
radius.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
ONE = U(1)
#: Planes between two looks at whether any lane is still within the radius.
LOOK = 8
#: Words of one block: abandoning goes block by block.
BLOCK = 512


def _above(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above ``radius``."""
    above, equal = over.copy(), ~np.zeros_like(over)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def within(planes: np.ndarray, valid: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Lanes within ``radius`` of their query.

    ``planes``: (64, words); ``valid``: lanes in use, (words,); ``queries``:
    broadcastable to (..., words), one query to each word.  Returns
    (..., words) masks.
    """
    shape = np.broadcast_shapes(queries.shape, valid.shape)
    out = np.zeros(shape, U)
    queries = np.broadcast_to(queries, shape)
    for at in range(0, shape[-1], BLOCK):
        part = slice(at, at + BLOCK)
        q, alive = queries[..., part], np.broadcast_to(valid[part], (*shape[:-1], len(valid[part]))).copy()
        counters = [np.zeros(q.shape, U) for _ in range((radius + 1).bit_length())]
        over = np.zeros(q.shape, U)
        for b in range(64):
            carry = planes[b, part] ^ (U(0) - (q >> U(b) & ONE))
            for c in counters:
                c ^= carry
                carry &= ~c
            over |= carry
            if b % LOOK == LOOK - 1:
                alive &= ~_above(counters, over, radius)
                if not alive.any():
                    break
        out[..., part] = alive
    return out


def slice_planes(prints: np.ndarray, word: np.ndarray, lane: np.ndarray, words: int) -> np.ndarray:
    """(64, words) planes; ``word`` ascending says where each fingerprint goes."""
    planes = np.zeros((64, words), U)
    if len(prints):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        for b in range(64):
            planes[b, word[starts]] = np.bitwise_or.reduceat((prints >> U(b) & ONE) << lane, starts)
    return planes


def _small_groups(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups of up to 64, one word to a group, all groups at once."""
    most = int(sizes.max())
    group = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    member = prints[np.repeat(starts, sizes) + rank]
    planes = slice_planes(member, group, rank.astype(U), len(sizes))
    valid = np.where(sizes == 64, ~U(0), (ONE << (sizes % 64).astype(U)) - ONE)
    lanes = np.zeros((most, len(sizes)), U)
    lanes[rank, group] = member
    exists = np.arange(most)[:, None] < sizes
    reach = within(planes, valid, lanes, radius)
    reach = np.where(exists, reach | ONE << np.arange(most, dtype=U)[:, None], U(0))
    for k in range(most):
        reach |= (U(0) - (reach >> U(k) & ONE)) & reach[k]
    low = reach & (~reach + ONE)
    root = np.log2(np.where(exists, low, ONE).astype(np.float64)).astype(np.int64)
    child = exists & (root != np.arange(most)[:, None])
    j, g = np.nonzero(child)
    return lanes[j, g], lanes[root[j, g], g]


def _large_group(prints: np.ndarray, radius: int, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one group of any size.

    First whoever isn't reached yet is a query, until all are reached; then
    those outside the largest component are, as all links between components
    have an end there.  A dense group takes a few queries, not one a member.
    """
    n = len(prints)
    words = -(-n // 64)
    index = np.arange(n)
    planes = slice_planes(prints, index // 64, (index % 64).astype(U), words)
    valid = np.full(words, ~U(0))
    if n % 64:
        valid[-1] = (ONE << U(n % 64)) - ONE
    label, asked = np.full(n, -1), np.zeros(n, bool)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def ask(now: list[int]) -> None:
        asked[now] = True
        for q, row in zip(now, within(planes, valid, prints[now][:, None], radius), strict=True):
            hits = np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))
            known = label[hits]
            root = find(int(label[q]))
            for other in np.unique(known[known >= 0]).tolist():
                if (r := find(other)) != root:
                    root, r = min(root, r), max(root, r)
                    parent[r] = root
            label[hits[known < 0]] = root

    def components() -> np.ndarray:
        named = np.unique(label)
        return np.array([find(int(x)) for x in named])[np.searchsorted(named, label)]

    while len(fresh := np.flatnonzero(label < 0)[:batch]):
        label[fresh] = fresh
        parent.update((x, x) for x in fresh.tolist())
        ask(fresh.tolist())
    of = components()
    main = int(np.bincount(of).argmax())
    while len(rest := np.flatnonzero((of != find(main)) & ~asked)[:batch]):
        ask(rest.tolist())
        of = components()
    child = of != index
    return prints[child], prints[of[child]]


def local_links(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (child, root) of the within-radius graph of each group.

    At most one link to a member: all pairs of a group are compared but never
    emitted.
    """
    a, b = [], []
    for low, high in ((1, 2), (2, 4), (4, 8), (8, 16), (16, 32), (32, 64)):
        pick = (sizes > low) & (sizes <= high)
        if pick.any():
            x, y = _small_groups(prints, starts[pick], sizes[pick], radius)
            a.append(x)
            b.append(y)
    for s, m in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        x, y = _large_group(prints[s : s + m], radius)
        a.append(x)
        b.append(y)
    empty = np.zeros(0, U)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])
