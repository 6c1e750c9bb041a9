"""Byte-level BPE by two tiers: a minimal perfect hash of the vocabulary, then a heap over linked bytes.

Tier 1: a pre-token that is itself in the vocabulary has its id in one probe. The hash is built by hash-and-displace: keys are
thrown into small buckets, each bucket gets the first displacement that puts all its keys into free slots of a table with as
many slots as keys; the key in the slot is compared, so a pre-token outside the vocabulary is known as such.

Tier 2: other pre-tokens start as a doubly linked list of bytes. A heap holds (rank, position) of neighbours whose
concatenation has a rank; the lowest rank, leftmost first, is merged, stale entries are skipped, and the two new pairs are
pushed: O(n log n) for a pre-token of n bytes, so long runs without blanks do no harm.

The tables (about 50,000 entries) are read once in each Python worker from `path`, a parameter; the operator itself is
mapInArrow without any shuffle, in batches bounded by bytes. Ids are kept as packed little-endian 32-bit integers.

Cases: null and empty texts have no ids and decode to nothing; a text of white space or of bytes outside any merge is encoded
byte by byte; special tokens are ordinary text; ids outside the vocabulary make decode() raise KeyError. Repeated rows give
equal rows; other columns are not read; a very long text is a batch of its own (some 100 bytes of memory for each of its bytes).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import map_batches, utf8
from .pieces import CUTTABLE, PieceStore


class PerfectHash:
    """Minimal perfect hash over distinct byte strings with values >= 0; get() gives the value or None for other strings.

    Keys lie in one row of bytes by slot, so 50,000 of them take about a megabyte.
    """

    def __init__(self, items: dict[bytes, int], load: int = 2):
        n = self.n = len(items)
        self.buckets = max(1, n // load)
        slot_of: dict[bytes, int] = {}
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for k in items:
            h = xxhash.xxh3_64_intdigest(k)
            groups[h % self.buckets].append((h, k))
        free = bytearray(b"\1") * n
        self.shift = array("q", [0] * self.buckets)
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        for b in order:
            if len(groups[b]) < 2:
                break
            d = 0
            while True:
                slots = {self._slot(h, d) for h, _ in groups[b]}
                if len(slots) == len(groups[b]) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for h, k in groups[b]:
                s = self._slot(h, d)
                free[s], slot_of[k] = 0, s
        # buckets of one key take the slots that are left: a negative displacement names the slot itself
        left = (s for s in range(n) if free[s])
        for b in order:
            if len(groups[b]) == 1:
                k, s = groups[b][0][1], next(left)
                self.shift[b], slot_of[k] = -1 - s, s
        keys = sorted(slot_of, key=slot_of.__getitem__)
        self.blob, self.values = b"".join(keys), array("q", (items[k] for k in keys))
        self.ends = array("q", [0, *accumulate(map(len, keys))])

    def _slot(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        return ((h ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93 >> 29 & 0x7FFFFFFF) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        s = self._slot(h, self.shift[h % self.buckets])
        return self.values[s] if self.blob[self.ends[s] : self.ends[s + 1]] == key else None


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by merging the pair of lowest rank, leftmost first, until none is left."""
    n, rank_of = len(word), ranks.get
    end = list(range(1, n + 1))  # where the part that begins here ends; 0: it was merged away
    before = list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := rank_of(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        rank, i = pop(heap)
        mid = end[i]
        if not mid or mid >= n or rank_of(word[i : end[mid]]) != rank:
            continue  # stale: one of the two has changed since
        stop = end[i] = end[mid]
        end[mid] = 0
        if stop < n:
            before[stop] = i
            if (r := rank_of(word[i : end[stop]])) is not None:
                push(heap, (r, i))
        if (p := before[i]) >= 0 and (r := rank_of(word[p:stop])) is not None:
            push(heap, (r, p))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder for a rank file and a split pattern. What it remembers is bounded: pieces as in pieces.py, and pre-tokens of up to 32 bytes."""

    def __init__(self, path: str, pattern: str, most_pieces: int = 1_000_000, most_words: int = 100_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.table = PerfectHash(self.ranks)
        self.find = regex.compile(pattern).findall
        self.words: dict[str, list[int]] = {}  # pre-tokens that pieces share
        self.most_words = most_words
        self.store = PieceStore(self._encode_new, most_pieces, cut=pattern in CUTTABLE)
        # the bytes of each id, in one row
        tokens = dict(map(reversed, self.ranks.items()))
        sizes = np.zeros(max(tokens, default=-1) + 1, np.int64)
        sizes[list(tokens)] = [len(x) for x in tokens.values()]
        self.token_size, self.token_start = sizes, np.cumsum(sizes) - sizes
        self.token_bytes = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > self.most_words:
            self.words.clear()
        words, find, ids = self.words, self.find, array("I")
        counts = np.empty(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            before = len(ids)
            for match in find(piece):
                known = words.get(match)
                if known is None:
                    word = match.encode()
                    whole = self.table.get(word)
                    known = [whole] if whole is not None else merge_bytes(word, self.ranks)
                    if len(word) <= 32:
                        words[match] = known
                ids.extend(known)
            counts[i] = len(ids) - before
        return counts, np.frombuffer(ids, np.uint32) if ids else np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, packed."""
        ids, bounds = self.store.encode(texts)
        raw, bounds = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for; KeyError if an id is none of the vocabulary's."""
        ids, out = np.frombuffer(packed, "<u4"), []
        for i in range(0, len(ids), 1 << 18):  # bounds the memory of one very long text
            part = ids[i : i + (1 << 18)]
            if len(bad := part[(part >= len(self.token_size)) | (self.token_size[np.minimum(part, len(self.token_size) - 1)] == 0)]):
                raise KeyError(int(bad[0]))
            sizes = self.token_size[part]
            ends = np.cumsum(sizes)
            out.append(self.token_bytes[np.repeat(self.token_start[part] - (ends - sizes), sizes) + np.arange(int(ends[-1]))].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (packed little-endian unsigned 32-bit integers) and n_tokens of every text."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = codec(path, pattern).encode(batch.column(1))
            return pa.record_batch([batch.column(0), pa.array(packed, pa.binary()), pa.array((len(x) // 4 for x in packed), pa.int64())], names=[key, "ids", "n_tokens"])

        return each

    return map_batches(docs.select(key, text), make, f"{key} {docs.schema[key].dataType.simpleString()}, ids binary, n_tokens long", sized_by=1)


def decode_ids(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key and the bytes that the packed ids stand for."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            c = codec(path, pattern)
            return pa.record_batch([batch.column(0), pa.array((c.decode(x or b"") for x in batch.column(1).to_pylist()), pa.binary())], names=[key, "decoded"])

        return each

    return map_batches(encoded.select(key, "ids"), make, f"{key} {encoded.schema[key].dataType.simpleString()}, decoded binary", sized_by=1)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes, decodes the ids and digests both: doc_id, n_tokens, ids_sha256, decoded_sha256, lossless."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            c = codec(path, pattern)
            packed = c.encode(batch.column(1))
            decoded = [c.decode(x) for x in packed]
            return pa.record_batch(
                [
                    batch.column(0), pa.array((len(x) // 4 for x in packed), pa.int64()), pa.array(hashlib.sha256(x).hexdigest() for x in packed),
                    pa.array(hashlib.sha256(x).hexdigest() for x in decoded), pa.array(a == b for a, b in zip(utf8(batch.column(1)), decoded)),
                ],
                schema=pa.schema([("doc_id", batch.schema.field(0).type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())]),
            )

        return each

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean", sized_by=1)
