"""Token ids as canonical, length-limited Huffman codes in independent blocks with bit-offset checkpoints.

1. Texts are encoded with the tokenizers library (see library_store) and the id `end` is put behind each; written once.
2. Counts of ids over all texts (a grouped sum; at most one row for each id of the vocabulary reaches the driver) give code
   lengths of at most `longest` bits by package-merge, and from them the canonical code: lengths alone describe it.
3. Each text's ids become bits. Texts go to files by ranges of doc_id, whose bounds come from a quantile sketch of doc_id, so
   files in order are in ascending doc_id order. A file is a run of blocks; a block holds whole texts, each from a byte
   boundary on, with a checkpoint (bit offset) at its begin and behind every 1024 ids. The number of ids before a file comes
   from one sum for each file.
4. Blocks are read back with one table of 2^longest entries: the next bits give id and length at once. All segments between
   checkpoints advance together in numpy, which is what makes blocks and checkpoints independent of each other.

Cases: null and empty texts hold the end id alone; several rows of one doc_id stand side by side in no fixed order of equal
ids; a null doc_id comes first; an empty table gives no file; other columns are not read. Work is by batches bounded in bytes, a
very long text is one by itself; the shuffle moves coded bits.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written
from .pieces import PieceStore

SEGMENT = 1024
LONGEST = 18
_PLAIN = re.compile(r" ?\S+")


@functools.lru_cache(maxsize=2)
def library_store(path: str) -> PieceStore:
    """Encodes with the tokenizers library; one for each Python worker.

    Texts are cut into pieces only if the tokenizer splits by the pattern for which that is exact and does nothing else to a
    text; texts with one of its added tokens in them, and all texts of other tokenizers, go to the library whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    about = json.loads(tokenizer.to_str())
    splits = about["pre_tokenizer"] or {}
    plain_split = (splits.get("type"), splits.get("add_prefix_space"), splits.get("use_regex")) == ("ByteLevel", False, True)
    cut = plain_split and not any(about[k] for k in ("normalizer", "post_processor", "truncation", "padding"))
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    line_feed = tokenizer.encode("\n", add_special_tokens=False).ids

    def keep_whole(texts: pa.Array) -> np.ndarray:
        found = pc.match_substring_regex(texts, "|".join(map(re.escape, added))) if added else pa.array([False] * len(texts))
        return np.flatnonzero(found.fill_null(False).to_numpy(zero_copy_only=False))

    def encode_new(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # words go to the library by lines: a line feed is a pre-token of its own between them, so its id parts their ids
        plain = [i for i, p in enumerate(pieces) if _PLAIN.fullmatch(p)] if cut and len(line_feed) == 1 else []
        lines, cuts, size = [], [0], 0
        for k, i in enumerate(plain, 1):
            size += len(pieces[i]) + 1
            if size > 1000 or k == len(plain):
                lines.append("\n".join([pieces[j] for j in plain[cuts[-1] : k]]))
                cuts.append(k)
                size = 0
        rows, sizes, parts, apart = [], [], [], np.zeros(len(pieces), bool)
        for a, b, found in zip(cuts, cuts[1:], tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            feed = ids == line_feed[0]
            ends = np.flatnonzero(feed)
            if len(ends) == b - a - 1:
                rows.append(plain[a:b])
                sizes.append(np.diff(np.concatenate(([-1], ends, [len(ids)]))) - 1)
                parts.append(ids[~feed])
                apart[plain[a:b]] = True
        rest = np.flatnonzero(~apart).tolist()
        for i, found in zip(rest, tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            rows.append([i])
            sizes.append(np.array([len(found.ids)]))
            parts.append(np.array(found.ids, np.uint32))
        # back in the order of the pieces
        row, got, ids = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (rows, sizes, parts))
        order = np.argsort(row.astype(np.int64))
        counts, start = got[order].astype(np.int64), (np.cumsum(got) - got)[order].astype(np.int64)
        ends = np.cumsum(counts)
        at = np.repeat(start - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        return counts, ids[at].astype(np.uint32)

    return PieceStore(encode_new, cut=cut, keep_whole=keep_whole)


def encode_texts(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, n_tokens and ids (packed 16-bit integers; 32-bit where an id needs it), the end id included."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, bounds = library_store(path).encode(batch.column(1))
            n = len(bounds) - 1
            out = np.full(len(ids) + n, end, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
            bounds = bounds + np.arange(n + 1)
            kind = "<u2" if not len(out) or out.max() < 65536 else "<u4"
            raw, width = out.astype(kind).tobytes(), int(kind[2])
            ends = (bounds * width).tolist()
            return pa.record_batch([batch.column(0), pa.array(np.diff(bounds)), pa.array([width] * n, pa.int32()), pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())], names=["doc_id", "n_tokens", "width", "ids"])

        return each

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, width int, ids binary", sized_by=1)


def _unpacked(batch: pa.RecordBatch, width: int, ids: int) -> list[np.ndarray]:
    return [np.frombuffer(raw, f"<u{w}") for w, raw in zip(batch.column(width).to_pylist(), batch.column(ids).to_pylist())]


def count_ids(tokens: DataFrame) -> DataFrame:
    """id, n: how often each id occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                some = np.bincount(np.concatenate(_unpacked(batch, 0, 1)))
                if len(some) > len(total):
                    some, total = total, some
                total = total.copy()
                total[: len(some)] += some
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return tokens.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than `longest`, by package-merge. counts: all positive."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    longest = max(longest, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    flags, packages = [], np.zeros(0)
    for _ in range(longest):
        merged = np.concatenate([leaves, packages])
        at = np.argsort(merged, kind="stable")
        flags.append(at < n)
        merged = merged[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(flags):  # the cheapest `take` items of a level: some leaves, and packages of two items a level down
        m = int(is_leaf[:take].sum())
        lengths[:m] += 1
        take = 2 * (take - m)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Code:
    """A canonical code: codes of one length are successive integers in order of id."""

    ids: np.ndarray
    lengths: np.ndarray

    def __post_init__(self):
        order = np.lexsort((self.ids, self.lengths))
        codes, code, before = np.zeros(len(order), np.int64), 0, 0
        sizes = self.lengths[order]
        for length in np.unique(sizes).tolist():
            code <<= length - before
            at = np.flatnonzero(sizes == length)
            codes[at] = code + np.arange(len(at))
            code, before = code + len(at), length
        top = int(self.ids.max()) + 1 if len(self.ids) else 0
        self.code_of, self.length_of = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code_of[self.ids[order]], self.length_of[self.ids[order]] = codes, sizes
        self.width = int(sizes.max()) if len(sizes) else 1
        # table: every word of `width` bits -> the id whose code it begins with, and its length
        spans = (1 << (self.width - sizes)).astype(np.int64)
        self.table_id = np.repeat(self.ids[order], spans).astype(np.uint32)
        self.table_length = np.repeat(sizes, spans).astype(np.int64)
        fill = (1 << self.width) - len(self.table_id)  # only where there is a single id
        self.table_id, self.table_length = np.pad(self.table_id, (0, fill)), np.pad(self.table_length, (0, fill), constant_values=1)

    def encode(self, texts: list[np.ndarray]) -> tuple[list[bytes], list[list[int]]]:
        """Bits of each text, from a byte boundary on, and the bit offset of every 1024th id in it."""
        ids = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        size = self.length_of[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        whole = -(-np.diff(ends[bounds]) // 8)  # bytes of each text
        base = np.concatenate(([0], np.cumsum(whole)))
        at = ends[:-1] + np.repeat(base[:-1] * 8 - ends[bounds[:-1]], np.diff(bounds))
        value = self.code_of[ids] << (64 - (at & 31) - size).astype(np.uint64)
        words, n = at >> 5, int(base[-1]) // 4 + 2
        # codes do not overlap, so sums of their parts in a 32-bit word are exact in doubles
        packed = np.bincount(words, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(words + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        raw = packed.astype(">u4").tobytes()
        checks = [(at[a:b:SEGMENT] - 8 * c).tolist() for a, b, c in zip(bounds.tolist(), bounds[1:].tolist(), base.tolist())]
        return [raw[a:b] for a, b in zip(base.tolist(), base[1:].tolist())], checks

    def decode(self, raw: bytes, offsets: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Ids of the segments that begin at the given bit offsets and hold so many ids."""
        data = np.frombuffer(raw + bytes(4), np.uint8).astype(np.uint32)
        window = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
        order = np.argsort(-counts, kind="stable")
        at, left = offsets[order].astype(np.int64), counts[order]
        out = np.zeros((int(left[0]) if len(left) else 0, len(left)), np.uint32)
        down = np.uint32(32 - self.width)
        live = np.searchsorted(-left, -np.arange(1, len(out) + 1), side="right")
        for i, n in enumerate(live.tolist()):
            now = at[:n]
            word = window[now >> 3] << (now & 7).astype(np.uint32) >> down
            out[i, :n] = self.table_id[word]
            now += self.table_length[word]
        parts: list[np.ndarray] = [out[:0, 0]] * len(left) if len(left) else []
        columns = np.ascontiguousarray(out.T)
        for j, k in enumerate(order.tolist()):
            parts[k] = columns[j, : left[j]]
        return parts


def make_code(counts: DataFrame, longest: int = LONGEST) -> tuple[Code, int]:
    """The code of ids with so many occurrences, and the bytes that all of them take in it."""
    rows = sorted(counts.collect())  # at most one row for each id of the vocabulary
    ids, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    lengths = code_lengths(n, longest)
    return Code(ids, lengths), sum(int(a) * int(b) for a, b in zip(n, lengths)) // 8


BLOCK_SCHEMA = "file int, block int, start long, doc_ids array<long>, n_tokens array<long>, n_bytes array<long>, checks array<array<long>>, bits binary"


def file_count(n_bytes: int, least: int, file_bytes: int = 256 << 20) -> int:
    """Files for so many coded bytes: as many as tasks run side by side, more where these would hold over file_bytes each."""
    return max(1, least, -(-n_bytes // file_bytes))


def file_bounds(tokens: DataFrame, files: int) -> np.ndarray:
    """Ids at which files end, ascending and distinct; the error of the quantiles is a quarter of a file at most."""
    if files < 2:
        return np.array([], np.int64)
    cuts = tokens.approxQuantile("doc_id", [i / files for i in range(1, files)], min(0.001, 0.25 / files))
    return np.array(sorted({int(x) for x in cuts}), np.int64)


def write_blocks(tokens: DataFrame, code: Code, files: int, block_bytes: int = 1 << 20) -> DataFrame:
    """Blocks of coded texts in ascending doc_id order; `start` counts the ids of all texts before a block."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(code)  # bounded by the vocabulary
    bounds = file_bounds(tokens, files)

    def file_of(doc_id: pa.Array) -> np.ndarray:
        """The number of bounds that are below doc_id; 0 for null."""
        return np.searchsorted(bounds, doc_id.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)).astype(np.int32)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            np.add.at(total, file_of(batch.column(0)), batch.column(1).to_numpy())
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["file", "n"])

    sums = tokens.select("doc_id", "n_tokens").mapInArrow(sizes, "file int, n long").groupBy("file").agg(F.sum("n").alias("n"))
    starts, total = {}, 0
    for file, n in sorted(tuple(r) for r in sums.collect()):  # one row for each file
        starts[file], total = total, total + n

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits, checks = shared.value.encode(_unpacked(batch, 2, 3))
            return pa.record_batch([pa.array(file_of(batch.column(0))), *batch.columns[:2], pa.array(bits, pa.binary()), pa.array(checks, pa.list_(pa.int64()))], names=["file", "doc_id", "n_tokens", "bits", "checks"])

        return each

    coded = map_batches(tokens.select("doc_id", "n_tokens", "width", "ids"), make, "file int, doc_id long, n_tokens long, bits binary, checks array<long>", sized_by=3, limit=4 << 20)
    # each file is a partition of its own, whatever a hash of its number would say
    placed = coded.repartitionById(files, "file").sortWithinPartitions("file", "doc_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, start, size, rows = None, 0, 0, 0, []

        def done() -> pa.RecordBatch:
            base, checks = 0, []
            for r in rows:
                checks.append([8 * base + c for c in r[4]])
                base += len(r[3])
            return pa.record_batch(
                [
                    pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([[r[1] for r in rows]], pa.list_(pa.int64())),
                    pa.array([[r[2] for r in rows]], pa.list_(pa.int64())), pa.array([[len(r[3]) for r in rows]], pa.list_(pa.int64())),
                    pa.array([checks], pa.list_(pa.list_(pa.int64()))), pa.array([b"".join(r[3] for r in rows)], pa.binary()),
                ],
                names=["file", "block", "start", "doc_ids", "n_tokens", "n_bytes", "checks", "bits"],
            )

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (r[0] != file or size >= block_bytes):
                    yield done()
                    start, block, size, rows = start + sum(x[2] for x in rows), block + 1, 0, []
                if r[0] != file:
                    file, block, start = r[0], 0, starts[r[0]]
                rows.append(r)
                size += len(r[3])
        if rows:
            yield done()

    return written(placed.mapInArrow(pack, BLOCK_SCHEMA), "blocks")


def read_blocks(blocks: DataFrame, code: Code) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every text, decoded from its block."""
    shared = blocks.sparkSession.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, n_tokens, checks, bits in zip(*(c.to_pylist() for c in batch.columns)):
                counts = [min(SEGMENT, n - i) for n in n_tokens for i in range(0, n, SEGMENT)]
                parts = shared.value.decode(bits, np.array([c for x in checks for c in x], np.int64), np.array(counts, np.int64))
                crcs, k = [], 0
                for n in n_tokens:
                    crc = 0
                    for _ in range(-(-n // SEGMENT)):
                        crc, k = zlib.crc32(parts[k].astype("<u4").tobytes(), crc), k + 1
                    crcs.append(crc)
                before = start + np.cumsum(n_tokens) - n_tokens
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(before, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("start", "doc_ids", "n_tokens", "checks", "bits").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_ids(docs: DataFrame, path: str, end: int = 0, longest: int = LONGEST) -> tuple[DataFrame, Code]:
    """The blocks of all texts of docs(doc_id, text), and the code to read them with."""
    tokens = written(encode_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, end), "tokens")
    code, n_bytes = make_code(count_ids(tokens), longest)
    files = file_count(n_bytes, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return write_blocks(tokens, code, files), code


def ids_round_trip(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    return read_blocks(*store_ids(docs, path, end))
