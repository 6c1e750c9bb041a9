"""Removal of long repeated strings by a common-prefix interval tree over a sparse, enhanced suffix array.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same text or another. Suffixes are
sampled so that no such string is missed: the anchor of a window of `length` bytes is its word of `word` bytes with the least
hash, the leftmost of equals. Equal windows have their anchors at the same place, so all occurrences of a repeated window meet
at anchors of one word, and each window is looked at from one anchor only. The windows of an anchor follow each other; together
they are its run, which begins l bytes before the word and ends r bytes behind it.

1. Anchors of all texts (about one in 140 bytes): hash of the word and hash of the run. Words that occur once are dropped by an
   aggregate and a join.
2. Runs that occur more than once are whole repeats: settled by a count (the leaves of the tree whose strings are all of the
   run). One of them stands for all from here on.
3. What is left is sorted by word, and each word's anchors form a suffix array by what follows them, enhanced by common-prefix
   lengths. A stack scan gives its intervals (nodes of the common-prefix tree), and within a node a second scan over the
   reversed left sides gives the groups with a common left extension. A group whose members do not all lie in one child of
   the node and that is diverse to the left is a maximal repeat with all its occurrences, not only neighbouring ones; if it
   has at least `length` bytes, it covers all its members.
4. Words with more than `most_group` different runs never meet in one task: each of their windows is hashed and counted by a
   shuffle, which is the cut of the interval tree at depth `length`; an anchor then covers from its leftmost to its rightmost
   repeated window. So no group is too large, and none is left out.
5. Covered spans are joined to their texts, merged and cut out.

The union of repeated windows of one anchor is one span, as all of them hold the anchor's word. Words, runs and windows of
steps 2 and 4 are compared by two 64-bit hashes together (the word's and their own), not byte by byte.

Cases: null and empty texts, and texts shorter than `length`, lose nothing; rows that repeat a doc_id are told apart by their
text, equal rows are copies of each other and go; runs of one byte are repeats of themselves and go; a very long text is worked
on alone, with some 60 bytes of memory for each of its bytes; other columns of docs are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, map_batches, slices, written
from .words import _BASE, _INVERSE, _VALUE, _pow, mix, text_bytes

LENGTH = 400
WORD = 128


def _prefix(data: np.ndarray) -> np.ndarray:
    """Sums whose differences are hashes of substrings, up to a power of the base that _range() takes away."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _pow(_BASE, len(data)), out=sums[1:])
    return sums


def _range(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[begin]) * _pow(_INVERSE, len(sums))[begin]


def _sliding(values: np.ndarray, width: int, of: np.ufunc, fill: int) -> np.ndarray:
    """of (minimum or maximum) over each run of `width` values, by block-wise scans from both sides."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = of.accumulate(blocks, axis=1).reshape(-1)
    behind = np.ascontiguousarray(of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    return of(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int = LENGTH, word: int = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: position, word hash and run hash of its anchors, and the bytes of the run on the left and on the right of the word."""
    n = len(data)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    sums = _prefix(data)
    words = mix((sums[word:] - sums[:-word]) * _pow(_INVERSE, n + 1)[: n - word + 1])
    # the least of the upper half of the hashes, the leftmost of equals
    ranked = words >> np.uint64(32) << np.uint64(32) | np.arange(len(words), dtype=np.uint64)
    least = (_sliding(ranked, length - word + 1, np.minimum, 0xFFFFFFFFFFFFFFFF) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    end = np.append(begin[1:], len(least)) - 1 + length
    at = least[begin]
    left, right = at - begin, end - at - word
    run = mix(_range(sums, begin, end) + mix((left * 100_003 + right).astype(np.uint64)))
    return at, words[at], run, left, right


def find_anchors(docs: DataFrame, length: int, word: int) -> DataFrame:
    """docs(doc_id, th, text) -> doc_id, th, place (position * 2^24 + bytes on the left * 2^12 + bytes on the right), word, run."""
    assert length - word < 1 << 12

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, bounds = text_bytes(batch.column(2))
            found = [anchors(data[a:b], length, word) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            at, words, runs, left, right = (np.concatenate([f[i] for f in found]) for i in range(5))
            return pa.record_batch(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(at << 24 | left << 12 | right), pa.array(words.view(np.int64)), pa.array(runs.view(np.int64))], names=["doc_id", "th", "place", "word", "run"]
            )

        return each

    return map_batches(docs, make, "doc_id long, th long, place long, word long, run long", sized_by=2, limit=1 << 20)


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan: (first, last, depth) of each interval of the common-prefix tree with depth >= least. lcp[i] is between i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][1] > depth:
            first, d = stack.pop()
            if d >= least:
                yield first, i, d
        if depth and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return ((x & -x).bit_length() - 1) // 8


def maximal_repeats(left: list[bytes], right: list[bytes], length: int, word: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor's word, bytes behind it, members) of every maximal repeat of `length` bytes or more.

    left: what stands before each word, reversed; right: what follows it. The word itself is the same for all.
    """
    n = len(right)
    array = sorted(range(n), key=right.__getitem__)
    lcp = [common(right[a], right[b]) for a, b in zip(array, array[1:])]
    root = [(0, n - 1, 0)] if n > 1 and 0 in lcp else []  # the node where nothing behind the word is shared
    for first, last, depth in [*root, *intervals(lcp, 1)]:
        members = array[first : last + 1]
        # the child of the node that each member lies in
        child, k = {members[0]: 0}, 0
        for i in range(first, last):
            k += lcp[i] == depth
            child[array[i + 1]] = k
        members.sort(key=left.__getitem__)
        lcs = [common(left[a], left[b]) for a, b in zip(members, members[1:])]
        if word + depth >= length:  # no left side is needed: the whole node repeats
            yield 0, depth, members
        for a, b, back in intervals(lcs, max(1, length - word - depth)):
            group = members[a : b + 1]
            if len({child[m] for m in group}) > 1:
                yield back, depth, group


def _settle(batches: Iterator[pa.RecordBatch], length: int, word: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by word (word, run, left, right) -> the span before and behind each anchor that repeats of its word cover."""
    held: list[tuple] = []

    def settle(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        if len(rows) < 2:
            return []
        before, behind = [-1] * len(rows), [0] * len(rows)
        for back, ahead, members in maximal_repeats([r[2][::-1] for r in rows], [r[3] for r in rows], length, word):
            for m in members:
                before[m], behind[m] = max(before[m], back), max(behind[m], ahead)
        return [(r[0], r[1], b, word + e) for r, b, e in zip(rows, before, behind) if b >= 0]

    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                out += settle(held)
                held = []
            held.append(row)
        yield _spans(out)
    yield _spans(settle(held))
    give_back()


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["word", "run", "before", "behind"])


def _windows(batches: Iterator[pa.RecordBatch], length: int, word: int) -> Iterator[pa.RecordBatch]:
    """A hash of each window of an anchor's run, with the anchor's distance from its begin."""
    for whole in batches:
        for batch in slices(whole, 2, 1 << 17):
            words, runs, gone, hashes = [], [], [], []
            for key, run, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                sums = _prefix(np.frombuffer(left + right, np.uint8))
                begin = np.arange(len(left) + len(right) + word - length + 1)
                o = len(left) - begin
                # in periodic texts the sides may hash as the word does, so the parts are not combined alike
                hashes.append(mix(_range(sums, begin, begin + length - word) + mix(np.uint64(key & 0xFFFFFFFFFFFFFFFF) ^ mix(o.astype(np.uint64) + np.uint64(1)))))
                gone.append(o)
                words.append(np.full(len(begin), key, np.int64))
                runs.append(np.full(len(begin), run, np.int64))
            if words:
                yield pa.record_batch([pa.array(np.concatenate(words)), pa.array(np.concatenate(runs)), pa.array(np.concatenate(gone).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64))], names=["word", "run", "o", "window"])
    give_back()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans (begin * 2^32 + end) -> what is left."""
    for whole in batches:
        for batch in slices(whole, 1, 4 << 20):
            rows = []
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                text, kept, at, removed, runs, run_end = text or b"", [], 0, 0, 0, -1
                for s in sorted(spans or ()):
                    begin, end = s >> 32, s & 0xFFFFFFFF
                    if begin > run_end:
                        runs += 1
                    if end > at:
                        kept.append(text[at : max(at, begin)])
                        removed += end - max(at, begin)
                        at = end
                    run_end = max(run_end, end)
                kept.append(text[at:])
                rows.append((removed, runs, len(text), b"".join(kept)))
            yield pa.record_batch(
                [batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.binary())],
                names=["doc_id", "n_removed", "n_spans", "n_bytes", "kept_sha256", "kept"],
            )
    give_back()


def repeated_spans(docs: DataFrame, length: int = LENGTH, word: int = WORD, most_group: int = 1000) -> DataFrame:
    """doc_id, th, begin, end of covered spans of docs(doc_id, th, text); spans may overlap."""
    every = written(find_anchors(docs.where(F.octet_length("text") >= length).select("doc_id", "th", "text"), length, word), "anchors")
    # written, so that the join below has a shuffle of its own and adaptive execution can split a word that very many texts share
    repeated = written(every.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select("word"), "words")
    found = written(every.join(repeated, "word", "left_semi"), "repeated")
    discard(every, repeated)
    kinds = written(found.groupBy("word", "run").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "place")).alias("one")).select("word", "run", "n", "one.*"), "kinds")
    at, left, right = (F.expr(e) for e in ("shiftright(place, 24)", "shiftright(place, 12) & 4095", "place & 4095"))
    whole = found.join(kinds.where("n > 1").select("word", "run"), ["word", "run"], "left_semi")
    whole = written(whole.select("doc_id", "th", (at - left).alias("begin"), (at + right + word).alias("end")), "whole")
    discard(found)

    # words with several runs, at least one of which stands alone; their texts are read once
    open_words = kinds.groupBy("word").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("word", "m")
    places = kinds.join(open_words, "word").groupBy("doc_id", "th").agg(F.collect_list(F.struct("word", "run", "m", at.alias("at"), left.alias("l"), right.alias("r"))).alias("places"))
    d, p = docs.alias("d"), places.alias("p")
    sides = d.join(p, F.expr("d.doc_id <=> p.doc_id and d.th = p.th")).select("places", F.col("d.text").cast("binary").alias("bytes"))
    piece = f"transform(places, p -> struct(p.word, p.run, p.m, substring(bytes, p.at - p.l + 1, p.l) as left, substring(bytes, p.at + {word + 1}, p.r) as right))"
    sides = written(sides.select(F.explode(F.expr(piece)).alias("p")).select("p.*"), "sides")
    row = ["word", "run", "left", "right"]
    small = sides.where(F.col("m") <= most_group).select(*row).repartition("word").sortWithinPartitions("word").mapInArrow(lambda batches: _settle(batches, length, word), "word long, run long, before int, behind int")
    windows = sides.where(F.col("m") > most_group).select(*row).mapInArrow(lambda batches: _windows(batches, length, word), "word long, run long, o int, window long")
    often = windows.groupBy("word", "window").agg(F.min("run").alias("a"), F.max("run").alias("b")).where("a <> b").select("word", "window")
    crowded = windows.join(often, ["word", "window"], "left_semi").groupBy("word", "run").agg(F.max("o").alias("before"), (F.lit(length) - F.min("o")).alias("behind"))
    spans = small.union(crowded).join(kinds.where("n = 1"), ["word", "run"])
    return whole.union(spans.select("doc_id", "th", (at - F.col("before")).alias("begin"), (at + F.col("behind")).alias("end")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, word: int = WORD, most_group: int = 1000) -> DataFrame:
    """doc_id, n_removed, n_spans, n_bytes, kept_sha256 and kept (bytes) of every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    spans = repeated_spans(docs, length, word, most_group).select("doc_id", "th", F.expr("begin * 4294967296L + end").alias("s"))
    spans = written(spans.groupBy("doc_id", "th").agg(F.collect_set("s").alias("spans")), "spans")
    d, s = docs.alias("d"), spans.alias("s")
    joined = d.join(s, F.expr("d.doc_id <=> s.doc_id and d.th = s.th"), "left").select("d.doc_id", "d.text", "s.spans")
    return joined.mapInArrow(_cut, "doc_id long, n_removed long, n_spans long, n_bytes long, kept_sha256 string, kept binary")
