"""Alignment of the tokens of two tokenizers, one of the tokenizers library (A) and one of sentencepiece (B).

1. A text is cut into units where both tokenizers certainly cut: before a blank and around a line feed without white space beside
   them, and between a letter and one of . , ; : ! ?, if no entry of B has a line feed, a blank behind something else or such a
   pair in it (looked up when the model is loaded; otherwise texts are one unit). Units are remembered with their alignment, as
   words come again and again (see pieces.PieceStore); units of up to 32 bytes are kept.
2. In a new unit the character offsets of A and the byte spans of B's proto are coarse cuts. Tokens that share a character (parts
   of one in A, byte-fallback tokens in B, whose spans are empty but for the last) are refined by the lengths of their decoded
   bytes. Decoded bytes must be those of the unit and meet every coarse cut, else its texts have no tokens.
3. Places where tokens of both end cut a unit into groups; a link is a pair of tokens whose bytes overlap.
4. Texts of about `chunk_bytes` make one row: their figures, the distinct id pairs with the number of these texts that hold each,
   and for each text the numbers and multiplicities of its pairs, compressed. These rows are written once.
5. Pair counts are sums over chunks, the highest count of each A id is a table of at most the vocabulary of A (broadcast). Counts
   go back to the chunks that hold the pair, each pair once for a chunk, so no text is sent anywhere and no pair is a hot key.

Cases: null and empty texts, and texts whose joined token bytes differ from blank + text (U+2581 in them), have zeros and an
empty groups_sha256; every row counts as a document of its own, those without an id or with a repeated one too; an empty table
stays one; other columns are not read. Special tokens of A are plain text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written
from .pieces import CUTTABLE, PieceStore, piece_starts
from .words import text_bytes

_PLAIN = re.compile(r" ?\S+")
_STOPS = ".,;:!?"
_STOP, _LETTER, _LATIN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_STOP[[ord(c) for c in _STOPS]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LATIN[0xC3:0xCA] = True  # first bytes of U+00C0 to U+027F: letters but for two signs
_SIGNS = (0x97, 0xB7)
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """The decoded bytes of every id, in a row."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.names = [str(i) for i in range(len(entries))]


def _expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, and so on."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def token_ends(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, line_first: np.ndarray, line_begin: np.ndarray, table: Table, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte at which each token ends, and whether its decoded bytes stand there.

    begin, end: coarse spans (bytes of data), shared or empty where a token is part of a character; line_first: whether a token
    is the first of its line; line_begin: where its line begins.
    """
    n = len(ids)
    size = table.size[ids]
    done = np.cumsum(size)
    next_begin = np.append(begin[1:], np.iinfo(np.int64).max)
    last = np.append(line_first[1:], True)
    cut = (end > begin) & (last | (end <= next_begin))
    # the left side of a token is known if it is the first or follows a cut; others count decoded bytes from the last such side
    known = line_first.copy()
    known[1:] |= cut[:-1]
    side = np.where(line_first, line_begin, np.append(0, end[:-1]))
    at = np.maximum.accumulate(np.where(known, np.arange(n), 0))
    counted = side[at] + done - (done - size)[at]
    ends = np.where(cut, end, counted)
    start = counted - size
    good = (counted == ends) & (start >= 0) & (ends <= len(data))
    checked = np.flatnonzero(good)
    same = data[_expand(start[checked], size[checked])] == table.data[_expand(table.start[ids[checked]], size[checked])]
    wrong = np.concatenate(([0], np.cumsum(~same)))
    stop = np.cumsum(size[checked])
    good[checked] = wrong[stop] == wrong[stop - size[checked]]
    return ends, good


class UnitStore(PieceStore):
    """Remembers units with their tokens, groups and links. Entry numbers are those of the pieces."""

    def __init__(self, path_a: str, path_b: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.table_a = Table([bytes(alphabet[c] for c in self.a.id_to_token(i) or "" if c in alphabet) for i in range(self.a.get_vocab_size())])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        as_byte = [_BYTE_PIECE.fullmatch(p) if self.b.is_byte(i) else None for i, p in enumerate(pieces)]
        self.table_b = Table([bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for m, p in zip(as_byte, pieces)])
        about = json.loads(self.a.to_str())
        splits = about["pre_tokenizer"] or {}
        plain = (splits.get("type"), splits.get("add_prefix_space"), splits.get("use_regex")) == ("ByteLevel", False, True)
        plain = plain and not any(about[k] for k in ("normalizer", "post_processor", "truncation", "padding"))
        whole = [p for p, m in zip(pieces, as_byte) if not m]
        feed = self.a.encode("\n", add_special_tokens=False).ids
        cut = plain and len(feed) == 1 and not any("\n" in p or "▁" in p.lstrip("▁") for p in whole)
        self.cut_stops = not any(x.isalpha() and y in _STOPS for p in whole for x, y in zip(p, p[1:]))
        super().__init__(self._align_new, most, cut)

    def _empty(self) -> None:
        super()._empty()
        self.pair_of: dict[int, int] = {}
        self.pair_keys = np.zeros(0, np.int64)
        self.figures = np.zeros((1024, 5), np.int64)  # tokens of A, tokens of B, groups, links, bad
        self.pair_start = np.zeros(1024, np.int64)
        self.pairs = np.zeros(4096, np.int32)
        self.groups: list[bytes] = []

    def begins(self, texts: pa.Array, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        begin = super().begins(texts, data, bounds)
        if not self.cut or not self.cut_stops:
            return begin
        at = np.flatnonzero(_STOP[data[1:]]) + 1
        before = data[at - 1]
        two = np.flatnonzero((at >= 2) & (before >= 0x80) & (before < 0xC0))
        lead = data[at[two] - 2]
        latin = np.zeros(len(at), bool)
        latin[two] = _LATIN[lead] & ~((lead == 0xC3) & np.isin(before[two], _SIGNS))
        return np.union1d(begin, at[_LETTER[before] | latin])

    def _lines(self, units: list[str]) -> tuple[list[int], list[str], list[str], list[list[int]]]:
        """Order of the units, texts for A, texts for B (with a line feed in front), and the units of each."""
        plain = [i for i, u in enumerate(units) if _PLAIN.fullmatch(u)] if self.cut else []
        seen = set(plain)
        lines, size = [[]] if plain else [], 0
        for i in plain:
            if size > 1000:
                lines.append([])
                size = 0
            lines[-1].append(i)
            size += len(units[i]) + 1
        of_a = ["\n" + "\n".join([units[i] for i in line]) for line in lines]
        rest = [i for i in range(len(units)) if i not in seen]
        return [i for line in lines for i in line] + rest, of_a + [units[i] for i in rest], of_a + ["\n" + units[i] for i in rest], lines + [[i] for i in rest]

    def _align_new(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        base, n = self.n, len(units)
        order, of_a, of_b, lines = self._lines(units)
        raw = [units[i].encode() for i in order]
        size = np.fromiter(map(len, raw), np.int64, n)
        at = np.cumsum(size) - size  # units in a row, without the line feeds

        def laid(texts: list[str], feeds: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Bytes of the lines in a row, where lines begin, where units begin."""
            data = [t.encode() for t in texts]
            begin = np.cumsum([0, *map(len, data)])
            units_in = np.fromiter(map(len, lines), np.int64, len(lines))
            first = np.cumsum(units_in) - units_in
            line = np.repeat(np.arange(len(lines)), units_in)
            feed = np.array(feeds, np.int64)[line]
            place = begin[line] + at - at[first[line]] + (np.arange(n) - first[line] + 1) * feed
            return np.frombuffer(b"".join(data) or b"\0", np.uint8), begin, place

        joined = len(lines) - sum(a != b for a, b in zip(of_a, of_b))
        data, begin, place = laid(of_a, [k < joined for k in range(len(lines))])
        found = self.a.encode_batch(of_a, add_special_tokens=False)
        count = np.array([len(f.ids) for f in found], np.int64)
        ids = np.fromiter((i for f in found for i in f.ids), np.int64, int(count.sum()))
        spans = np.array([s for f in found for s in f.offsets], np.int64).reshape(-1, 2)
        # characters to bytes: the bytes that begin a character, line after line
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first_char = np.searchsorted(chars, begin[:-1])
        line = np.repeat(np.arange(len(lines)), count)
        tokens_a = self._in_units(ids, chars[spans[:, 0] + first_char[line]], chars[spans[:, 1] + first_char[line]], line, begin, place, size, self.table_a, data)

        data, begin, place = laid(of_b, [True] * len(lines))
        spans, count = [], []
        for proto in self.b.encode(of_b, return_type="proto", num_threads=1):
            found = [(p.id, p.begin, p.end) for p in proto.pieces]
            spans += found[1:]  # the blank that B adds
            count.append(len(found) - 1)
        spans = np.array(spans, np.int64).reshape(-1, 3)
        line = np.repeat(np.arange(len(lines)), count)
        tokens_b = self._in_units(spans[:, 0], spans[:, 1] + begin[line], spans[:, 2] + begin[line], line, begin, place, size, self.table_b, data)

        bad = np.zeros(n, bool)
        for (ids, unit, _, good), table in ((tokens_a, self.table_a), (tokens_b, self.table_b)):
            bad[unit[~good]] = True
            bad |= np.bincount(unit, table.size[ids], n).astype(np.int64) != size
        (id_a, unit_a, end_a), (id_b, unit_b, end_b) = ((ids[k], unit[k], (end + at[unit])[k]) for ids, unit, end, good in (tokens_a, tokens_b) for k in [~bad[unit]])
        start_a, start_b = end_a - self.table_a.size[id_a], end_b - self.table_b.size[id_b]
        both_a = np.isin(end_a, end_b, assume_unique=True)
        both_b = np.isin(end_b, end_a, assume_unique=True)
        low, high = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a, side="left")
        links = high - low
        keys = np.repeat(id_a << 32, links) | id_b[_expand(low, links)]
        new, where = np.unique(keys, return_inverse=True)
        numbers = np.array([self.pair_of.setdefault(k, len(self.pair_of)) for k in new.tolist()], np.int32)
        if len(self.pair_of) > len(self.pair_keys):
            self.pair_keys = np.fromiter(self.pair_of, np.int64, len(self.pair_of))
        of_unit = np.bincount(unit_a, links, n).astype(np.int64)

        groups = self._group_texts(id_a, both_a, id_b, both_b)
        n_groups = np.bincount(unit_a[both_a], minlength=n)
        ends = np.cumsum(n_groups).tolist()
        texts = [";".join(groups[a:b]).encode() for a, b in zip([0, *ends], ends)]

        # back in the order of the pieces, of which the store keeps the first ones; what it did not keep before is written over
        back = np.argsort(np.array(order, np.int64))
        start, of_unit = (np.cumsum(of_unit) - of_unit)[back], of_unit[back]
        filled = int(self.pair_start[base - 1] + self.figures[base - 1, 3]) if base else 0
        self._room(base + n, filled + len(where))
        self.figures[base : base + n] = np.stack([np.bincount(unit_a, minlength=n)[back], np.bincount(unit_b, minlength=n)[back], n_groups[back], of_unit, bad[back]], axis=1)
        self.pair_start[base : base + n] = filled + np.cumsum(of_unit) - of_unit
        self.pairs[filled : filled + len(where)] = numbers[where[_expand(start, of_unit)]]
        self.groups[base:] = [texts[i] for i in back.tolist()]
        return np.ones(n, np.int64), np.arange(base, base + n, dtype=np.uint32)

    def _room(self, n: int, pairs: int) -> None:
        def fit(a: np.ndarray, least: int) -> np.ndarray:
            return a if len(a) >= least else np.concatenate([a, np.zeros((max(least, len(a) * 3 // 2) - len(a), *a.shape[1:]), a.dtype)])

        self.figures, self.pair_start, self.pairs = fit(self.figures, n), fit(self.pair_start, n), fit(self.pairs, pairs)

    @staticmethod
    def _in_units(ids, begin, end, line, line_begin, place, size, table, data):
        """Tokens that lie in units: id, unit, end in the unit, whether the bytes are right. Line feeds between units are left out."""
        first = np.ones(len(ids), bool)
        first[1:] = line[1:] != line[:-1]
        ends, good = token_ends(ids, begin, end, first, line_begin[line], table, data)
        start = ends - table.size[ids]
        unit = np.searchsorted(place, start, side="right") - 1
        inside = (unit >= 0) & (ends > place[np.maximum(unit, 0)]) & (start < (place + size)[np.maximum(unit, 0)])
        # a token of wrong length is counted where its coarse span lies
        wrong = ~good
        unit[wrong] = np.clip(np.searchsorted(place, begin[wrong], side="right") - 1, 0, None)
        inside |= wrong
        ids, unit = ids[inside], unit[inside]
        return ids, unit, ends[inside] - place[unit], good[inside]

    def _group_texts(self, id_a: np.ndarray, both_a: np.ndarray, id_b: np.ndarray, both_b: np.ndarray) -> list[str]:
        name_a, name_b = self.table_a.names, self.table_b.names
        a, b = [name_a[i] for i in id_a.tolist()], [name_b[i] for i in id_b.tolist()]
        end_a, end_b = (np.flatnonzero(both_a) + 1).tolist(), (np.flatnonzero(both_b) + 1).tolist()
        return [",".join(a[s:e]) + "|" + ",".join(b[t:f]) for s, e, t, f in zip([0, *end_a], end_a, [0, *end_b], end_b)]


@functools.lru_cache(maxsize=1)
def unit_store(path_a: str, path_b: str) -> UnitStore:
    """One for each Python worker."""
    return UnitStore(path_a, path_b)


FIGURES = ("n_a", "n_b", "n_groups", "n_links")
CHUNKS = "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, pairs array<long>, holders array<int>, n_pairs array<int>, numbers binary, times binary"


def _packed(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes as their largest needs, compressed; the first byte is their width."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + pa.compress(values.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[1:], decompressed_size=n * raw[0], codec="zstd", asbytes=True), f"<u{raw[0]}").astype(np.int64)


def _chunk(store: UnitStore, doc_ids: pa.Array, texts: pa.Array, keep_groups: bool) -> pa.RecordBatch:
    units, bounds = store.encode(pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
    n = len(bounds) - 1
    units = units.astype(np.int64)
    sums = np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(store.figures[units], axis=0)))[bounds]
    figures = np.diff(sums, axis=0)
    figures[(figures[:, 4] > 0) | (pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False) == 0)] = 0
    counted = figures[:, 0] > 0
    groups = []
    name = store.groups.__getitem__
    listed = units.tolist()
    for k, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        joined = b";".join(map(name, listed[a:b])) if counted[k] else b""
        groups.append(joined.decode() if keep_groups else hashlib.sha256(joined).hexdigest() if joined else "")
    doc = np.repeat(np.arange(n), np.diff(bounds))
    links = np.where(counted[doc], store.figures[units, 3], 0)
    key = np.repeat(doc, links) << 32 | store.pairs[_expand(store.pair_start[units], links)]
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(key)))
    key = key[begin]
    doc, pair = key >> 32, key & 0xFFFFFFFF
    held = np.bincount(pair, minlength=1)
    pairs = np.flatnonzero(held)
    pairs = pairs[np.argsort(-held[pairs], kind="stable")]  # frequent ones first, so that differences of numbers are small
    number = np.zeros(len(held), np.int64)
    number[pairs] = np.arange(len(pairs))
    mine = number[pair]
    order = np.lexsort((mine, doc))
    mine, times = mine[order], times[order]
    per_doc = np.bincount(doc, minlength=n)
    step = np.diff(mine, prepend=0)
    first = np.cumsum(per_doc) - per_doc
    step[first[per_doc > 0]] = mine[first[per_doc > 0]]
    one = lambda x, t: pa.array([x], pa.list_(t))
    return pa.record_batch(
        [
            pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), doc_ids), *(one(c, pa.int64()) for c in figures.T[:4]), one(groups, pa.string()), one(store.pair_keys[pairs], pa.int64()), one(held[pairs], pa.int32()),
            one(per_doc, pa.int32()), pa.array([_packed(step)], pa.binary()), pa.array([_packed(times - 1)], pa.binary()),
        ],
        names=["doc_ids", *FIGURES, "groups", "pairs", "holders", "n_pairs", "numbers", "times"],
    )


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Rows of step 4, written; groups are texts or only their SHA-256."""

    def make():
        store = unit_store(path_a, path_b)
        return lambda batch: _chunk(store, batch.column(0), batch.column(1), keep_groups)

    rows = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, CHUNKS, sized_by=1, limit=chunk_bytes)
    return written(rows.withColumn("chunk", F.monotonically_increasing_id()), "aligned")


def _held(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "holders")).alias("number", "held")).select("chunk", "number", F.col("held.pairs").alias("pair"), F.col("held.holders").cast("long").alias("holders"))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair (id of A * 2^32 + id of B), n (documents that hold it linked), best (whether no pair of its A id has more); written."""
    counts = written(_held(chunks).groupBy("pair").agg(F.sum("holders").alias("n")), "pair-counts")
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("highest"))
    # one row for each id of A's vocabulary at most, whatever the corpus
    return counts.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, chunk_bytes: int = 4 << 20) -> DataFrame:
    """docs(doc_id, text) -> one row for each with its figures and its groups: `a1,a2|b1;a3|b2,b3` of decimal ids, or the SHA-256 of it.

    n_best: links whose count is the highest of their A id; count_sum: the counts of all links added up.
    """
    chunks = aligned_chunks(docs, path_a, path_b, keep_groups, chunk_bytes)
    counts = pair_counts(chunks)
    back = _held(chunks).select(F.col("chunk").alias("of_chunk"), "number", "pair").join(counts, "pair").select("of_chunk", "number", "n", "best")

    def finish(chunk: pa.Table, weights: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        per_doc = np.array(row["n_pairs"], np.int64)
        total = int(per_doc.sum())
        n, best = np.zeros((2, row["n_distinct"]), np.int64)
        at = weights.column("number").to_numpy()
        n[at], best[at] = weights.column("n").to_numpy(), weights.column("best").to_numpy(zero_copy_only=False)
        step, times = _unpacked(row["numbers"], total), _unpacked(row["times"], total) + 1
        first = np.cumsum(per_doc) - per_doc
        run = np.cumsum(step)
        number = run - np.repeat((run - step)[first[per_doc > 0]], per_doc[per_doc > 0])
        sums = [np.diff(np.concatenate(([0], np.cumsum(times * x[number])))[np.append(first, total)]) for x in (best, n)]
        return pa.table([pa.array(row["doc_ids"], pa.int64()), *(pa.array(row[c], pa.int64()) for c in FIGURES), *(pa.array(s) for s in sums), pa.array(row["groups"], pa.string())], names=[c.split()[0] for c in ALIGNED.split(", ")])

    sized = chunks.withColumn("n_distinct", F.size("pairs")).drop("pairs", "holders")
    return sized.groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(finish, ALIGNED)
