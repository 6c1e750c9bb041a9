"""Packing of tokenised texts into sequences: first-fit decreasing with a tournament tree, in randomised groups.

1. Texts are encoded with the tokenizers library, the id `end` behind each (see huffman_ids.encode_texts), and written once.
2. Rows are dealt by a hash of their number in that table, which knows nothing of ids, sources or copies, so every part gets its
   share of everything. There is one part for each `part_tokens` tokens. A part sorts its rows by another hash of the number and
   cuts them into groups of about `group_tokens` tokens: random, of bounded size, and the same when a lost task is run again.
3. In a group every text gives its whole sequences; the pieces that are left go, longest first, into the first open sequence with
   room: the leaves of a tournament tree are the rooms of sequences, each inner node has the larger of its two, and the descent
   to the leftmost leaf with room takes log2(sequences) steps.
4. Rooms of `least_piece` tokens or more that first-fit leaves are filled from the emptiest sequences, whose pieces are cut for it.
   What is left of a group's last sequence is cut at powers of two, as sequences of such lengths need no padding.

A sequence_id is the part's number * 2^40 + a count in it. The shuffle moves packed ids once; nothing else grows with the corpus.

Cases: null and empty texts are the end id alone; several rows of a doc_id, and rows without one, are packed as texts of their
own; an empty table gives no piece; other columns are not read. A very long text is a group by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, written
from .huffman_ids import encode_texts

LENGTH = 2048
#: A piece: number of its text in the group, first id, number of ids.
Piece = tuple[int, int, int]


class TournamentTree:
    """Rooms of sequences in order; find() gives the first that has so much room, opening the next one if none has."""

    def __init__(self, length: int, most: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [length] * (2 * self.leaves)
        self.used = 0

    def find(self, size: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        leaf = at - self.leaves
        self.used = max(self.used, leaf + 1)
        room[at] -= size
        while at > 1:
            at //= 2
            left, right = room[2 * at], room[2 * at + 1]
            best = left if left > right else right
            if room[at] == best:
                break
            room[at] = best
        return leaf


def first_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Numbers of the pieces in each sequence; sizes are at most length. Equal sizes keep their order."""
    order = np.argsort(-sizes, kind="stable")
    tree = TournamentTree(length, len(sizes))
    out: list[list[int]] = [[] for _ in range(len(sizes))]
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        out[tree.find(size)].append(i)
    return out[: tree.used]


def fill_rooms(bins: list[list[Piece]], length: int, least_piece: int) -> list[list[Piece]]:
    """Takes the emptiest sequences apart and fills with their pieces, cut where needed, the rooms of the fullest."""
    bins = sorted(bins, key=lambda b: -sum(n for _, _, n in b))
    room = [length - sum(n for _, _, n in b) for b in bins]
    taker, loose = 0, []
    while taker < len(bins) - (not loose):
        if room[taker] < least_piece:
            taker += 1
            continue
        if not loose:
            loose = bins.pop()
            continue
        text, start, n = loose.pop()
        take = min(n, room[taker])
        bins[taker].append((text, start, take))
        room[taker] -= take
        if take < n:
            loose.append((text, start + take, n - take))
    if loose:
        bins.append(loose)
    return bins


def cut_at_powers(pieces: list[Piece], length: int) -> list[list[Piece]]:
    """Sequences whose lengths are the powers of two that add up to the pieces, largest first."""
    total, out, queue = sum(n for _, _, n in pieces), [], list(pieces)[::-1]
    while total:
        want = min(length, 1 << (total.bit_length() - 1))
        total -= want
        out.append([])
        while want:
            text, start, n = queue.pop()
            take = min(n, want)
            out[-1].append((text, start, take))
            want -= take
            if take < n:
                queue.append((text, start + take, n - take))
    return out


def pack_group(sizes: list[int], length: int = LENGTH, least_piece: int = 16) -> list[list[Piece]]:
    """The sequences of texts of the given sizes: lists of (text, start, n)."""
    whole = [[(t, s, length)] for t, n in enumerate(sizes) for s in range(0, n - length + 1, length)]
    rest = [(t, n - n % length, n % length) for t, n in enumerate(sizes) if n % length]
    if not rest:
        return whole
    bins = [[rest[i] for i in b] for b in first_fit_decreasing(np.array([n for _, _, n in rest]), length)]
    bins = fill_rooms(bins, length, least_piece)
    loosest = max(range(len(bins)), key=lambda k: length - sum(n for _, _, n in bins[k]))
    if length - sum(n for _, _, n in bins[loosest]) >= least_piece:
        bins += cut_at_powers(bins.pop(loosest), length)
    return whole + bins


SEQUENCES = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, lengths array<int>, doc_tokens array<long>, ids binary"


def pack_sequences(docs: DataFrame, path: str, end: int = 1, length: int = LENGTH, group_tokens: int = 1 << 21, part_tokens: int = 1 << 24, least_piece: int = 16) -> DataFrame:
    """docs(doc_id, text) -> one row for each sequence: its pieces in order and its ids as little-endian unsigned 32-bit integers."""
    tokens = written(encode_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, end), "tokens")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // part_tokens), min(-(-total // group_tokens), docs.sparkSession.sparkContext.defaultParallelism))
    # rows of a written table have the same numbers whenever it is read again
    number = tokens.withColumn("_row", F.monotonically_increasing_id())
    dealt = number.select("doc_id", "n_tokens", "width", "ids", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int").alias("part"), F.xxhash64("_row", F.lit("order")).alias("_order"))
    placed = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "_order").drop("_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, next_id, rows, size = None, 0, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            texts = [np.frombuffer(raw, f"<u{w}") for _, _, w, raw in rows]
            bins = pack_group([n for _, n, _, _ in rows], length, least_piece)
            for a in range(0, len(bins), 512):
                some = bins[a : a + 512]
                ids = [np.concatenate([texts[t][s : s + n] for t, s, n in b]).astype("<u4").tobytes() for b in some]
                columns = [[[rows[t][0] for t, _, _ in b] for b in some], [[s for _, s, _ in b] for b in some], [[n for _, _, n in b] for b in some], [[rows[t][1] for t, _, _ in b] for b in some]]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.record_batch(
                    [pa.array(range((part << 40) + next_id, (part << 40) + next_id + len(some)), pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int32()), *(pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds)), pa.array(ids, pa.binary())],
                    names=["sequence_id", "n_tokens", "doc_ids", "starts", "lengths", "doc_tokens", "ids"],
                )
                next_id += len(some)

        for batch in batches:
            of = batch.column(4).to_pylist()
            for row, p in zip(zip(*(batch.column(k).to_pylist() for k in range(4))), of):
                if rows and (p != part or size >= group_tokens):
                    yield from done()
                    rows, size = [], 0
                if p != part:
                    part, next_id = p, 0
                rows.append(row)
                size += row[1]
        if rows:
            yield from done()
        give_back()

    return placed.mapInArrow(run, SEQUENCES)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed_pieces(sequences: DataFrame) -> DataFrame:
    """One row for each piece of each sequence: where it lies in its text and in the sequence, and the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sequence, doc_ids, starts, lengths, doc_tokens, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "doc_ids", "starts", "lengths", "doc_tokens", "ids"))):
                offset = 0
                for doc, start, n, m in zip(doc_ids, starts, lengths, doc_tokens):
                    rows.append((doc, start, n, zlib.crc32(ids[4 * offset : 4 * (offset + n)]), m, sequence, offset))
                    offset += n
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return sequences.select("sequence_id", "doc_ids", "starts", "lengths", "doc_tokens", "ids").mapInArrow(run, PIECES)
