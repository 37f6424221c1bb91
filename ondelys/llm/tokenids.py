"""Token ids of whole texts, by the tokenizers library.

The library works at a few MB a second, and most of that goes into pieces (a
word with its space, a run of signs) seen many times before.  For the two
pre-tokenizers whose rule is known here, texts made of plain Latin characters
are split into the same pieces by array operations on their code points, each
distinct piece is encoded by the library once, and ids are gathered from the
pieces.  Pieces are looked up by a 64-bit hash of their characters, taken from
a running polynomial, in a table of half a million, and the characters of every
piece found are compared with those the table holds.  A text with a piece whose
hash is another's goes whole through the library, as do all texts of other
characters or tokenizers.  All ways give the library's ids.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow.fs as pafs

LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: Characters on which the rules below agree with Unicode's classes.
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{LATIN}“”‘’–—…«»¡¿·]*")
#: The splitting patterns known here; the first is that of a byte-level pre-tokenizer.
BYTE_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A text can be cut here without changing its pieces.
SEAM = re.compile(r"(?<=\S) (?=[A-Za-z])")
SEGMENT = 1 << 19
#: Pieces held by a worker, and the power of two of slots for them.
CACHE, SLOTS = 450_000, 20
IDS = np.dtype("<u4")

SIGN, LETTER, DIGIT, SPACE, BREAK = range(5)
TOP = 0x2100
KIND = np.zeros(TOP, np.uint8)
for _c in range(TOP):
    if re.match(f"[{LATIN}]", chr(_c)):
        KIND[_c] = LETTER
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[ord(" ")] = SPACE
KIND[[9, 10, 13]] = BREAK
_random = np.random.default_rng(11)
MARK = _random.integers(1, 2**63, TOP).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        power = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            power[done : 2 * done] = power[: min(done, size - done)] * np.uint64(step)
            done, step = 2 * done, step * step & (1 << 64) - 1
        out.append(power)
    return out[0], out[1]


def piece_starts(points: np.ndarray, begins: np.ndarray, words: bool) -> np.ndarray:
    """Where pieces begin in code points; ``begins``: first places of the texts.

    With ``words``, white space is a piece that the caller drops, and digits
    stand alone.
    """
    n = len(points)
    kind = KIND[points]
    white = kind >= SPACE
    first = np.zeros(n + 1, bool)
    first[begins] = True
    group = np.where(white, SPACE, kind)
    change = np.r_[True, group[1:] != group[:-1]] | first[:n]
    start = change.copy()
    if words:
        start |= kind == DIGIT
    else:
        # One space joins what follows; the last white space of a run stands apart from the run.
        after_space = np.r_[False, kind[:-1] == SPACE] & ~first[:n] & ~white
        start &= ~(change & after_space)
        next_solid = np.r_[~white[1:], False] & ~first[1:]
        start |= white & next_solid
    # An apostrophe that begins a piece takes s, t, re, ve, m, ll or d with it.
    for i in np.flatnonzero((points == 39) & start & change).tolist():
        tail = points[i + 1 : i + 3].tolist()
        room = n - i - 1
        nxt = np.flatnonzero(first[i + 1 : i + 3])
        if len(nxt):
            room = min(room, int(nxt[0]))
        if room >= 1 and tail[0] in (115, 116, 109, 100):
            size = 1
        elif room >= 2 and tuple(tail) in ((114, 101), (118, 101), (108, 108)):
            size = 2
        else:
            continue
        start[i + 1 : i + 1 + size] = False
        if i + 1 + size < n:
            start[i + 1 + size] = True
    return start


class PieceTable:
    """Ids by the hash of a piece: open addressing in arrays, emptied when full."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)
        self.offset, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.size, self.used = np.zeros(8192, IDS), 0, 0
        # Characters of the pieces, one after another, and where each begins; the last place ends them.
        self.chars, self.begin = np.zeros(8192, np.uint16), np.zeros(1025, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if it isn't held."""
        mask = (1 << SLOTS) - 1
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int32)
        key = self.keys[slot]
        hit = key == hashes
        out[hit] = self.entry[slot[hit]]
        open_ = np.flatnonzero(~hit & (key != 0))
        at = slot[open_]
        while len(open_):
            at = (at + 1) & mask
            key = self.keys[at]
            hit = key == hashes[open_]
            out[open_[hit]] = self.entry[at[hit]]
            on = ~hit & (key != 0)
            open_, at = open_[on], at[on]
        return out

    def same(self, entry: np.ndarray, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the pieces whose characters follow one another in ``chars`` are those of the entries."""
        out = self.begin[entry + 1] - self.begin[entry] == sizes
        first = np.cumsum(sizes) - sizes
        # Of another length: compared with themselves, as their place in the table may end too early.
        held = np.where(out, self.begin[entry], 0) - first
        at = np.repeat(held, sizes)
        at += np.arange(len(chars))
        differs = np.take(self.chars, at, mode="clip") != chars
        if differs.any():
            out &= ~np.logical_or.reduceat(differs, first)
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray, pieces: list[str]) -> None:
        """New distinct hashes with their ids, one after another, and their characters."""
        n, mask = len(hashes), (1 << SLOTS) - 1
        while self.size + n > len(self.offset):
            self.offset, self.count = np.resize(self.offset, 2 * len(self.offset)), np.resize(self.count, 2 * len(self.count))
            self.begin = np.resize(self.begin, len(self.offset) + 1)
        ends = self.begin[self.size] + np.cumsum(np.fromiter(map(len, pieces), np.int64, n))
        while ends[-1] > len(self.chars):
            self.chars = np.resize(self.chars, 2 * len(self.chars))
        self.chars[self.begin[self.size] : ends[-1]] = np.frombuffer("".join(pieces).encode("utf-16-le"), "<u2")
        self.begin[self.size + 1 : self.size + n + 1] = ends
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.offset[self.size : self.size + n] = self.used + np.cumsum(counts) - counts
        self.count[self.size : self.size + n] = counts
        left, slot = np.arange(n), (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        while len(left):
            empty = self.keys[slot] == 0
            taken, first = np.unique(slot[empty], return_index=True)
            won = np.flatnonzero(empty)[first]
            self.keys[taken], self.entry[taken] = hashes[left[won]], self.size + left[won]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, slot = left[stay], (slot[stay] + 1) & mask
        self.size += n
        self.used += len(ids)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if "://" in path:
            fs, inner = pafs.FileSystem.from_uri(path)
            text = fs.open_input_stream(inner).readall().decode()
        else:
            text = open(path, encoding="utf-8").read()
        self.library = Tokenizer.from_str(text)
        self.rule = self._rule(json.loads(text))
        self.lower = self.rule == WORD_RULE
        self.special = [t["content"] for t in json.loads(text).get("added_tokens") or []]
        self.table = PieceTable()
        # Vocabulary entries that begin (byte rule) or end (word rule) a piece.
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.endswith("</w>") if self.lower else token.startswith("Ġ")

    @staticmethod
    def _rule(config: dict) -> str | None:
        pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
            return BYTE_RULE
        steps = [(s["type"], s.get("use_regex"), s.get("add_prefix_space")) for s in pre.get("pretokenizers", ())]
        if steps == [("Split", None, None), ("ByteLevel", False, False)]:
            split = pre["pretokenizers"][0]
            kinds = [n["type"] for n in (norm or {}).get("normalizers", ())]
            if split["pattern"] == {"Regex": WORD_RULE} and split["behavior"] == "Removed" and split["invert"] and kinds == ["NFC", "Replace", "Lowercase"]:
                return WORD_RULE
        return None

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: list[str], hashes: np.ndarray) -> None:
        """Encode distinct pieces; plain words go through the library as one text."""
        plain = np.array([self.lower or (p[0] == " " and p[1:].isalpha()) for p in pieces], bool)
        words = [p for p, ok in zip(pieces, plain.tolist(), strict=True) if ok]
        if words:
            joined = " ".join(words) if self.lower else "".join(words)
            ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, IDS)
            edges = np.flatnonzero(self.edge[ids])
            counts = np.diff(np.r_[0, edges + 1] if self.lower else np.r_[edges, len(ids)])
            if len(counts) == len(words):
                self.table.add(hashes[plain], ids, counts, words)
            else:
                plain[:] = False
        rest = [p for p, ok in zip(pieces, plain.tolist(), strict=True) if not ok]
        if rest:
            found = [e.ids for e in self.library.encode_batch_fast(rest, add_special_tokens=False)]
            self.table.add(hashes[~plain], np.array([i for ids in found for i in ids], IDS), np.array([len(ids) for ids in found], np.int64), rest)

    def _turn(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts, all at once."""
        joined = "".join(texts)
        if self.lower:
            joined = joined.lower()
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        if not len(joined):
            return [b""] * len(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        n = len(points)
        begins = (ends - sizes)[sizes > 0]
        at = np.flatnonzero(piece_starts(points, begins, self.lower))
        to = np.r_[at[1:], n]
        if self.lower:
            solid = KIND[points[at]] < SPACE
            at, to = at[solid], to[solid]
        power, inverse = _powers(1 << max(20, n.bit_length()))
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(MARK[points] * power[:n], out=running[1:])
        hashes = (running[to] - running[at]) * inverse[at]
        hashes = (hashes ^ hashes >> np.uint64(32)) * np.uint64(BASE)
        hashes[hashes == 0] = 1
        if self.table.size > CACHE or self.table.used > 8 * CACHE:
            self.table.clear()
        entry = self.table.find(hashes)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            place = missing[first]
            self._learn([joined[a:b] for a, b in zip(at[place].tolist(), to[place].tolist(), strict=True)], new)
            entry[missing] = self.table.find(hashes[missing])
        sizes = to - at
        chars = points.astype(np.uint16)
        if self.lower:
            chars = chars[KIND[points] < SPACE]
        same = self.table.same(entry, chars, sizes) if len(at) else np.ones(0, bool)
        counts = self.table.count[entry]
        total = np.r_[0, np.cumsum(counts)]
        ids = self.table.ids[np.repeat(self.table.offset[entry] - total[:-1], counts) + np.arange(total[-1])]
        cuts = (total[np.r_[0, np.searchsorted(at, ends)]] * 4).tolist()
        data = ids.tobytes()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        if not same.all():
            for i in np.unique(np.searchsorted(ends, at[~same], "right")).tolist():
                out[i] = self._whole(texts[i])
        return out

    def _plain(self, text: str) -> bool:
        return self.rule is not None and PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, in order; texts are taken in turns of about ``SEGMENT`` characters."""
        turn: list[bytes | str] = []
        held = 0

        def flush() -> Iterator[bytes]:
            done = iter(self._turn([t for t in turn if type(t) is str]))
            for t in turn:
                yield next(done) if type(t) is str else t

        for text in texts:
            if not self._plain(text):
                turn.append(self._whole(text))
            elif len(text) > SEGMENT:
                turn.append(b"".join(self._turn([text[a:b]])[0] for a, b in segments(text)))
            else:
                turn.append(text)
                held += len(text)
            if held >= SEGMENT:
                yield from flush()
                turn, held = [], 0
        yield from flush()


def segments(text: str, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Spans of about ``size`` characters that end where pieces end."""
    at = 0
    while at < len(text):
        seam = SEAM.search(text, at + size)
        end = seam.start() if seam else len(text)
        yield at, end
        at = end


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, with its cache."""
    return Encoder(path)


def encode_documents(path: str, texts: Iterable[str | None], end_id: int) -> Iterator[np.ndarray]:
    """Ids of each whole text (null: empty), the end id behind them."""
    end = np.array([end_id], IDS).tobytes()
    for ids in encoder(path).encode_all(text or "" for text in texts):
        yield np.frombuffer(ids + end, IDS)
