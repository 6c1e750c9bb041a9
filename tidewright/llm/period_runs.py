"""Periodic runs of words: suffix classes united by descending LCP, newly adjacent positions seed the runs.

1. Words of a batch of texts become 64-bit hashes. A run of length max(6, 4q) or more with period q has two suffixes q apart
   that share at least 5 words, so only places whose next five words stand elsewhere in the same text go on (`LEAST`).
2. Prefix doubling ranks the suffixes of these places, all texts of a batch at once; ids of words are those of one text, so no
   two texts share a prefix. The kept ranks of every doubling give the LCP of neighbours by descent.
3. Kruskal over the neighbours by descending LCP: a union-find of suffix classes, each with an ordered set of its positions.
   When the smaller set goes into the larger one, each new pair of adjacent positions i < j with j - i <= LCP repeats itself with
   period j - i over j - i + LCP words. Their LCP is that of the level, as they were apart before; a smaller period would have
   put a position between them at an earlier level, so j - i is the smallest period of the stretch.
4. Of the seeds of one run the one that nothing extends to the left is the run itself.

Work and memory follow the batch: texts are cut into batches of about a megabyte, a longer text is one by itself (its ranks take
4 bytes for each such place and doubling). There is no shuffle and no driver work; a lost task is run again.

Cases: null, empty and blank texts have no words, no run and an empty collapsed text; every row is judged by itself, so repeated
rows and null ids change nothing; an empty table stays one; only the two given columns are read. Words are compared by 64-bit
hashes where candidates are made; the words of reported runs are compared as bytes.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .words import exact_word_hashes, mix, text_bytes, word_spans

#: Two places of a run that are a period apart share this many words at least: length - q >= max(6, 4q) - q >= 5.
LEAST = 5
SHORTEST, REPEATS = 6, 4
_FULL = 512


class OrderedSet:
    """Positions in ascending order, in blocks of bounded size, so that insertion stays cheap in large sets."""

    __slots__ = ("blocks", "lows", "size")

    def __init__(self, first: int):
        self.blocks, self.lows, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Puts x in; returns its neighbours."""
        k = max(0, bisect_left(self.lows, x) - 1)
        block = self.blocks[k]
        insort(block, x)
        at = bisect_left(block, x)
        before = block[at - 1] if at else (self.blocks[k - 1][-1] if k else None)
        after = block[at + 1] if at + 1 < len(block) else (self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None)
        self.lows[k] = block[0]
        self.size += 1
        if len(block) > _FULL:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.lows[k : k + 1] = [block[0], block[half]]
        return before, after


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _crowded(key: np.ndarray) -> np.ndarray:
    """Which values stand more than once."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def suffix_neighbours(words: np.ndarray, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose next LEAST words stand elsewhere in the text too, in suffix order, and the LCP of each with the next one.

    words: hashes; text and end: number and end of each word's text. Ranks are made for these places and the LEAST words behind
    each: where two of the places share LEAST words or more, the word that parts them is among those, so nothing else matters.
    """
    n, none = len(words), np.zeros(0, np.int64)
    if n <= LEAST:
        return none, none
    value = mix(words + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    gram = np.zeros(n - LEAST + 1, np.uint64)
    for k in range(LEAST):
        gram = mix(gram * np.uint64(3) + value[k : n - LEAST + 1 + k])
    whole = np.flatnonzero(np.arange(n - LEAST + 1) + LEAST <= end[: n - LEAST + 1])
    place = whole[_crowded(gram[whole])]
    if not len(place):
        return none, none
    active = np.zeros(n + LEAST + 1, bool)
    for k in range(LEAST + 1):
        active[place + k] = True  # a place behind the text's end belongs to another text and does no harm
    active = np.flatnonzero(active[:n])
    number = np.full(n, -1, np.int64)
    number[active] = np.arange(len(active))

    def later(at: np.ndarray, step: int | np.ndarray) -> np.ndarray:
        """Number of the place `step` words on, -1 beyond the text or the ranked places."""
        on = at + step
        return np.where(on < end[at], number[np.minimum(on, n - 1)], -1)

    rank, span = _dense(value[active]), 1
    levels = [rank.astype(np.int32)]
    while True:
        nxt = later(active, span)
        new = _dense(rank * (len(active) + 1) + np.where(nxt >= 0, rank[nxt] + 1, 0))
        if int(new.max()) == int(rank.max()):
            break
        rank, span = new, span * 2
        levels.append(rank.astype(np.int32))
    place = place[np.argsort(rank[number[place]], kind="stable")]
    lcp = np.zeros(len(place), np.int64)
    a, b = place[:-1], place[1:]
    shared = lcp[:-1]
    for k in range(len(levels) - 1, -1, -1):
        x, y = later(a, shared), later(b, shared)
        shared[(x >= 0) & (y >= 0) & (levels[k][x] == levels[k][y])] += 1 << k
    return place, lcp


def seeds(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j and LCP of positions that become adjacent in a class when it is united, with j - i within the LCP."""
    union = np.flatnonzero(lcp >= LEAST)
    union = union[np.argsort(-lcp[union], kind="stable")]
    parent: dict[int, int] = {}
    sets: dict[int, OrderedSet] = {}
    out: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, level in zip(union.tolist(), lcp[union].tolist()):
        p, q = root(x), root(x + 1)
        large, small = sets.pop(p, None) or OrderedSet(int(place[p])), sets.pop(q, None) or OrderedSet(int(place[q]))
        if large.size < small.size:
            large, small, p, q = small, large, q, p
        parent[q] = p
        sets[p] = large
        before, later = None, iter(small)
        i = next(later)
        while i is not None:
            low, high = large.insert(i)
            after = next(later, None)
            # neighbours that come with the same set were adjacent before, and no other one may come between
            if low is not None and low != before and i - low <= level:
                out.append((low, i, level))
            if high is not None and (after is None or after > high) and high - i <= level:
                out.append((i, high, level))
            before, i = i, after
    i, j, level = (np.array(c, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return i, j, level


def find_runs(words: np.ndarray, first: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start (in it), length and period of every run of at least max(shortest, repeats * period) words, by text, start, period.

    words: hashes of the words of several texts in a row; first: where each text's words begin, and the end. shortest and
    repeats may not be below 6 and 4, which the completeness of LEAST rests on.
    """
    if shortest < SHORTEST or repeats < REPEATS:
        raise ValueError(f"runs of fewer than {SHORTEST} words or {REPEATS} periods are not found by this method")
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(first[1:], sizes)
    i, j, level = seeds(*suffix_neighbours(words, text, end))
    period, length = j - i, j - i + level
    if not len(i):
        return i, i, i, i
    run = (length >= np.maximum(shortest, repeats * period)) & ((i == first[text[i]]) | (words[i - 1] != words[j - 1]))
    i, period, length = i[run], period[run], length[run]
    order = np.lexsort((period, i))
    i, period, length = i[order], period[order], length[order]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 0) | (np.diff(period) != 0)
    i, period, length = i[new], period[new], length[new]
    return text[i], i - first[text[i]], length, period


def _gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray, n_texts: int) -> list[bytes]:
    """The words [begin, end) of each text joined by one blank; text: ascending numbers."""
    size = end - begin + 1
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    out = np.full(total, 32, np.uint8)
    keep = np.ones(total, bool)
    keep[ends - 1] = False
    out[keep] = data[np.repeat(begin - (ends - size), size)[keep] + np.flatnonzero(keep)]
    bounds = np.concatenate(([0], ends))[np.searchsorted(text, np.arange(n_texts + 1))].tolist()
    raw = out.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(bounds, bounds[1:])]


RUN_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, runs (by start, then period) and the text without what repeats in a run.

    A word is left out of `collapsed` if a run holds it behind the run's first period; words are joined by one blank.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, bounds = text_bytes(batch.column(1))
            begin, end, first = word_spans(data, bounds)
            text, start, length, period = find_runs(exact_word_hashes(data, begin, end), first, shortest, repeats)
            drop = np.zeros(len(begin) + 1, np.int64)
            np.add.at(drop, first[text] + start + period, 1)
            np.add.at(drop, first[text] + start + length, -1)
            kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
            for t, s, n, q in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist()):
                a = first[t] + s
                words = [data[begin[w] : end[w]].tobytes() for w in range(a, a + n)]
                if words[q:] != words[:-q]:
                    raise RuntimeError("two different words have one 64-bit hash")
            n_texts = len(bounds) - 1
            of = np.searchsorted(first, kept, side="right") - 1
            collapsed = _gathered(data, begin[kept], end[kept], of, n_texts)
            at = np.searchsorted(text, np.arange(n_texts + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], names=["start", "length", "period"]))
            return pa.record_batch([batch.column(0), pa.array(np.diff(first).astype(np.int64)), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

        return each

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, RUN_SCHEMA, sized_by=1, limit=1 << 20)


def run_digest(found: DataFrame) -> DataFrame:
    """One row for each of periodic_runs(): counts, the longest run (ties: least start, then least period) and digests."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"]))), 1)
    out = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("-1000 * best.less div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with a periodic end put into about a tenth of the texts, by a rule of doc_id; others are untouched.

    With h = crc32 of the decimal doc_id and g = floor(h / 10): where h % 10 = 0 and there are n > 0 words, each word i >= a
    becomes word a + (i - a) % p, for a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null doc_id has no such end.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8"))
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    text = F.expr("""array_join(transform(sequence(0, size(_w) - 1), i -> _w[int(if(i < _a, i, _a + (i - _a) % (1 + (size(_w) - _a) div (3 + _g % 8))))]), ' ')""")
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", h).withColumn("_g", F.expr("_h div 10"))
    of = of.withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_a", F.expr("if(size(_w) > 0, _g % size(_w), 0)"))
    return of.select("doc_id", F.when(F.size("_w") > 0, text).otherwise(F.col("text")).alias("text"))
