"""Benchmark decontamination by spaced-seed hashing.

Words are runs of bytes other than white space, in lower case. A mask is a window of words of which only some count; the words it
ignores may have been replaced. Benchmark items are hashed under every mask at every place, texts likewise, and equal hashes
under the same mask are hits. A hit puts an item beside a text at one shift; both are compared word by word over all places
that they share at that shift, and the best stretch (matches count 1, differing words -3, so about three of four words agree)
is the verified overlap. A text is contaminated by an item if the overlap has at least `least_words` equal words, or all the
item's words where the item is shorter.

Items are read in blocks of at most `block_words` words, so what is broadcast is bounded whatever the benchmark's size; texts
are passed over once for each block. Texts are handled by mapInArrow in batches bounded by bytes, without a shuffle; only texts
with overlaps are joined back. Items shorter than the widest mask are found by a hash of all their words.

Other columns of both tables are not read (drop_contaminated() keeps those of the texts). A very long text is a batch of its own.

Cases: null or empty texts and items have no words and overlap with nothing; items of fewer than `shortest_item` words are not
looked for; repeated items count once for each item_id; every row has the
overlaps of its own text, with and without a doc_id; an item without an id makes texts contaminated and is not among their
item_ids; item ids may be of any type that can be ordered; an empty benchmark leaves every text clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import keep_rows, slices, written
from .words import hashed_words, mix

#: Fixed masks: 1 counts, 0 is ignored. Six words of eight to twelve; no two ignore the same places.
MASKS = ("11011011", "1110010111", "110100100101", "101100010011")
LEAST_WORDS = 8
SHORTEST_ITEM = 5
SPAN = max(map(len, MASKS))
_STEP = mix(np.arange(1, SPAN + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)
_BITS = 20
_MOST_HITS = 1 << 20


def seed_hashes(words: np.ndarray, places: list[int], salt: int) -> np.ndarray:
    """Hash of the words at these places for a window at each position where it fits."""
    n = max(0, len(words) - places[-1])
    out = np.full(n, salt, np.uint64)
    for k, p in enumerate(places):
        out += words[p : p + n] * _STEP[k]
    return mix(out)


@dataclass
class Items:
    ids: list[int]
    words: np.ndarray
    first: np.ndarray
    seeds: list[tuple[list[int], int, np.ndarray, np.ndarray, np.ndarray]]  # places, salt, sorted hashes, their positions, bitmap

    @staticmethod
    def of(ids: list[int], texts: list[str], shortest: int) -> Items | None:
        words, first = hashed_words(pc.utf8_lower(pa.array(texts, pa.string())))
        size = np.diff(first)
        long_enough = size >= shortest
        kinds = [([i for i, c in enumerate(m) if c == "1"], len(m), k + 1, size >= len(m)) for k, m in enumerate(MASKS)]
        # short items by all their words
        kinds += [(list(range(n)), n, 100 + n, size == n) for n in np.unique(size[long_enough & (size < SPAN)]).tolist()]
        seeds = []
        for places, span, salt, which in kinds:
            at = np.concatenate([np.zeros(0, np.int64), *(np.arange(first[i], first[i + 1] - span + 1) for i in np.flatnonzero(which & long_enough))])
            if not len(at):
                continue
            hashes = seed_hashes(np.concatenate([words, np.zeros(SPAN, np.uint64)]), places, salt)[at]
            order = np.argsort(hashes, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            seeds.append((places, salt, hashes[order], at[order], bitmap))
        return Items(ids, words, first, seeds) if seeds else None

    def overlaps(self, words: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
        """(text, item, equal words, first word in the text) for the best overlap of each text and item."""
        pairs = []
        for places, salt, hashes, at, bitmap in self.seeds:
            own = seed_hashes(words, places, salt)
            maybe = np.flatnonzero(bitmap[(own >> np.uint64(64 - _BITS)).astype(np.int64)])
            low, high = np.searchsorted(hashes, own[maybe], "left"), np.searchsorted(hashes, own[maybe], "right")
            n = high - low
            # a template that many items share hits all of them at once: expanded in runs of some _MOST_HITS, each reduced to its distinct shifts
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // _MOST_HITS)) + 1).tolist(), len(n)]
            for a, b in zip(cuts, cuts[1:]):
                if k := int(n[a:b].sum()):
                    place = np.repeat(maybe[a:b], n[a:b])
                    seed = at[np.repeat(low[a:b] - (np.cumsum(n[a:b]) - n[a:b]), n[a:b]) + np.arange(k)]
                    text, item = np.searchsorted(first, place, "right") - 1, np.searchsorted(self.first, seed, "right") - 1
                    pairs.append(np.unique(np.stack([text, item, place - seed], axis=1), axis=0))
        if not pairs:
            return []
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for t, i, shift in np.unique(np.concatenate(pairs), axis=0).tolist():
            # all words of the item that fall into the text at this shift
            a, b = max(int(self.first[i]), int(first[t]) - shift), min(int(self.first[i + 1]), int(first[t + 1]) - shift)
            if b <= a:
                continue
            same = words[a + shift : b + shift] == self.words[a:b]
            sums = np.concatenate(([0], np.cumsum(np.where(same, 1, -3))))
            low = np.minimum.accumulate(sums)
            end = int((sums - low).argmax())
            begin = int(sums[: end + 1].argmin())
            equal = int(same[begin:end].sum())
            if equal >= min(least, int(self.first[i + 1] - self.first[i])):
                best[t, i] = max(best.get((t, i), (0, 0)), (equal, a + begin + shift - int(first[t])))
        return [(t, i, equal, at) for (t, i), (equal, at) in best.items()]


def _item_blocks(benchmark: DataFrame, shortest_item: int, block_words: int) -> Iterator[Items]:
    """The benchmark in blocks of about block_words words."""
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    words = items.select(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"]
    blocks = -(-int(words or 0) // block_words)
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()  # bounded by block_words
        made = Items.of([r["item_id"] for r in block], [r["text"] for r in block], shortest_item)
        if made is not None:
            yield made


def overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, shortest_item: int = SHORTEST_ITEM, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, text_hash, item_id, n_equal and first_word of every verified overlap of docs(doc_id, text) with benchmark(item_id, text)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    items = benchmark.schema["item_id"].dataType
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, item_id {items.simpleString()}, n_equal long, first_word long"
    of_item = to_arrow_type(items)
    found = docs.sparkSession.createDataFrame([], schema)
    for made in _item_blocks(benchmark, shortest_item, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(made)

        def run(batches, shared=shared):
            for whole in batches:
                for batch in slices(whole, 1, 4 << 20):
                    rows = shared.value.overlaps(*hashed_words(pc.utf8_lower(batch.column(1))), least_words) if batch.num_rows else []
                    at = pa.array([r[0] for r in rows], pa.int64())
                    item = pa.array([shared.value.ids[r[1]] for r in rows], of_item)
                    yield pa.record_batch([batch.column(0).take(at), batch.column(2).take(at), item, pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["doc_id", "text_hash", "item_id", "n_equal", "first_word"])

        found = found.union(docs.mapInArrow(run, schema))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, shortest_item: int = SHORTEST_ITEM, block_words: int = 2_000_000) -> DataFrame:
    """The rows of docs (all columns) whose text overlaps with no item."""
    for made in _item_blocks(benchmark, shortest_item, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(made)

        def make(shared=shared):
            def keep(texts: pa.Array) -> pa.Array:
                out = np.ones(len(texts), bool)
                out[[r[0] for r in shared.value.overlaps(*hashed_words(pc.utf8_lower(texts)), least_words)]] = False
                return pa.array(out)

            return keep

        docs = keep_rows(docs, "text", make)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id of every row, n_items (benchmark items it overlaps with), item_ids (sorted), most_words (longest overlap) and contaminated.

    Overlaps are those of the row's own text, whatever other rows its doc_id has.
    """
    hits = written(overlaps(docs, benchmark, **how), "overlaps")
    hits = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("n_equal").alias("most_words"))
    d, h = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).alias("d"), hits.alias("h")
    none = F.array().cast(hits.schema["item_ids"].dataType)
    return d.join(h, F.expr("d.doc_id <=> h.doc_id AND d.text_hash = h.text_hash"), "left").select(
        "d.doc_id", F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("most_words", F.lit(0).cast("long")).alias("most_words"), F.col("item_ids").isNotNull().alias("contaminated"),
    )
