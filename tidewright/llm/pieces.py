r"""Cuts texts where the public split pattern of byte-level BPE certainly cuts, cheaply, so that pieces can be remembered.

The pattern joins one blank to the word behind it and treats a run of white space by what follows it. Where a blank or a line
feed has no white space on either side, the places before the blank and before and after the line feed are cuts of the pattern
whatever the rest of the text is, and each part splits alone as it does in the whole. Runs of white space are never cut. For
another pattern, texts are not cut at all.

Cutting, looking pieces up and putting ids together are numpy calls on whole batches. Remembered are pieces of up to 32 bytes,
at most `most` of them (about 70 bytes each); they are compared whole, not by a hash alone. Longer pieces and what comes when
the memory is full are encoded once in each batch. A full memory that no longer fits the texts is emptied.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .words import mix, text_bytes

#: Fixed value: the split pattern for which the cuts below are exact (alternatives may be written in either way).
CUTTABLE = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
}
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First bytes of white space beyond ASCII, which is U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F and U+3000.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE = {chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
_LANES = 4
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def piece_starts(data: np.ndarray, bounds: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Where pieces begin. bounds: begins of texts and the end; whole: numbers of texts that are not to be cut (None: none)."""
    n = len(data)
    white = _WHITE[data]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        raw = data.tobytes()
        for p in lead.tolist():
            for size in (2, 3):
                if raw[p : p + size] in _WIDE:
                    white[p : p + size] = True
    free = np.ones(n + 2, bool)  # free[p + 1]: no white space at p; so it is before the first and behind the last byte
    np.logical_not(white, out=free[1:-1])
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[free[at] & free[at + 2]]
    start = np.zeros(n + 1, bool)
    start[at] = True
    start[at[data[at] == 10] + 1] = True
    for i in () if whole is None else whole.tolist():
        start[bounds[i] : bounds[i + 1]] = False
    start[bounds] = True
    return np.flatnonzero(start[:n])


class PieceStore:
    """encode_new(pieces) gives the number of ids of each piece and all ids in a row.

    cut: whether texts may be cut; keep_whole: tells which of some texts (an Arrow array) are not to be cut all the same.
    """

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 1_000_000, cut: bool = True, keep_whole: Callable[[pa.Array], np.ndarray] | None = None):
        self.encode_new, self.most, self.cut, self.keep_whole = encode_new, most, cut, keep_whole
        self._empty()

    def _empty(self) -> None:
        self.table = np.full(1 << 12, -1, np.int32)
        self.n = self.used = 0
        self.keys = [np.zeros(1024, np.uint64) for _ in range(_LANES)]
        self.size, self.count, self.start = np.zeros(1024, np.uint8), np.zeros(1024, np.int32), np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)

    def _lanes(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The bytes of pieces of up to 32 bytes as integers, the rest 0, and a hash."""
        at_any = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        lanes = [at_any[begin] & _MASK[np.minimum(size, 8)]]
        h = mix(lanes[0] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for j in range(1, _LANES):
            lane, more = np.zeros(len(begin), np.uint64), np.flatnonzero(size > 8 * j)
            lane[more] = at_any[begin[more] + 8 * j] & _MASK[np.minimum(size[more] - 8 * j, 8)]
            h[more] = mix(h[more] ^ lane[more])
            lanes.append(lane)
        return lanes, h

    def _find(self, lanes: list[np.ndarray], size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each piece, or -1."""
        found, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        mask = np.uint64(len(self.table) - 1)
        slot = (h & mask).astype(np.int64)
        while len(left):
            entry = self.table[slot]
            some = entry >= 0
            left, slot, entry = left[some], slot[some], entry[some]
            same = (self.keys[0][entry] == lanes[0][left]) & (self.size[entry] == size[left])
            long = np.flatnonzero(same & (size[left] > 8))
            for j in range(1, _LANES):
                same[long] &= self.keys[j][entry[long]] == lanes[j][left[long]]
            found[left[same]] = entry[same]
            left, slot = left[~same], (slot[~same] + 1) & int(mask)
        return found

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = len(self.table) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        while len(entry):
            empty = self.table[slot] < 0
            self.table[slot[empty]] = entry[empty]
            lost = self.table[slot] != entry
            entry, slot = entry[lost], (slot[lost] + 1) & mask

    def _grow(self, n: int, used: int) -> None:
        def fit(a: np.ndarray, least: int) -> np.ndarray:
            return a if len(a) >= least else np.concatenate([a, np.zeros(max(least, len(a) * 3 // 2) - len(a), a.dtype)])

        self.keys = [fit(k, n) for k in self.keys]
        self.size, self.count, self.start, self.ids = fit(self.size, n), fit(self.count, n), fit(self.start, n), fit(self.ids, used)

    def _learn(self, new: list[bytes]) -> None:
        """Adds entries for the pieces; those that can be remembered come first and are put into the table."""
        counts, ids = self.encode_new([p.decode() for p in new])
        n, used = self.n, self.used
        self._grow(n + len(new), used + len(ids))
        self.count[n : n + len(new)], self.start[n : n + len(new)] = counts, used + np.cumsum(counts) - counts
        self.ids[used : used + len(ids)] = ids
        m = sum(len(p) <= 8 * _LANES for p in new)  # they come first
        m = min(m, max(0, self.most - n))
        size = np.fromiter(map(len, new[:m]), np.int64, m)
        lanes, h = self._lanes(np.frombuffer(b"".join(new[:m]) + bytes(8 * _LANES + 8), np.uint8), np.cumsum(size) - size, size)
        for key, lane in zip(self.keys, lanes):
            key[n : n + m] = lane
        self.size[n : n + m] = size
        if 2 * (n + m) > len(self.table):
            old = np.flatnonzero(self.table >= 0)
            entries = self.table[old].astype(np.int64)
            self.table = np.full(1 << int(2 * (n + m)).bit_length(), -1, np.int32)
            self._place(self._hash_of(entries), entries)
        self._place(h, np.arange(n, n + m))
        self.n, self.used = n + m, used + int(counts[:m].sum())

    def _hash_of(self, entry: np.ndarray) -> np.ndarray:
        size = self.size[entry].astype(np.int64)
        h = mix(self.keys[0][entry] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for j in range(1, _LANES):
            more = np.flatnonzero(size > 8 * j)
            h[more] = mix(h[more] ^ self.keys[j][entry[more]])
        return h

    def begins(self, texts: pa.Array, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not self.cut:
            return np.unique(bounds[:-1][np.diff(bounds) > 0])
        return piece_starts(data, bounds, None if self.keep_whole is None else self.keep_whole(texts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin and the last end. Null is as empty."""
        data, bounds = text_bytes(texts)
        begin = self.begins(texts, data, bounds)
        size = np.diff(np.append(begin, len(data)))
        where = np.full(len(begin), -1, np.int64)
        short = size <= 8 * _LANES
        few = slice(None) if short.all() else np.flatnonzero(short)
        lanes, h = self._lanes(np.concatenate([data, np.zeros(8 * _LANES + 8, np.uint8)]), begin[few], size[few])
        where[few] = self._find(lanes, size[few], h)
        del lanes, h
        miss = np.flatnonzero(where < 0)
        if len(miss):
            if self.n >= self.most and 5 * len(miss) > len(begin):  # the memory does not fit these texts
                self._empty()
                miss = np.arange(len(begin))
            raw = data.tobytes()
            pieces = [raw[a : a + n] for a, n in zip(begin[miss].tolist(), size[miss].tolist())]
            new = sorted(dict.fromkeys(pieces), key=lambda p: len(p) > 8 * _LANES)
            base = self.n
            self._learn(new)
            place = dict(zip(new, range(base, base + len(new))))
            where[miss] = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        counts = self.count[where].astype(np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[where] - (ends - counts), counts) + np.arange(total)]
        return ids, np.concatenate(([0], ends))[np.searchsorted(begin, bounds)]
