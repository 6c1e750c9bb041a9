"""Language identification by prediction by partial matching over bytes.

For each language a context tree of orders 0 to 4 counts which byte follows which context, over a bounded sample of labelled
texts. The statistics are then frozen. A byte costs, with n its count, N all counts and d the distinct bytes of its context,

    -log2(n / (N + d))                      if the context has seen it,
    -log2(d / (N + d)) + cost one order down    if not (escape),
    cost one order down                     if the context is new,

and 8 bits below order 0. The language of the shortest code wins; ties go to the first in order of name.

Frozen costs are looked up for whole batches: each order has an open-addressing table of grams (context and byte) with the
complete cost in every language, and one of contexts with the escape cost in every language for grams that none has seen.

The sample is bounded by `rows_per_language` and `bytes_per_language` (chosen by a hash of doc_id, so it is the same in every
run) and by `most_languages`; scoring covers every byte of every text. Training is one grouped task for each language on that sample; scoring is mapInArrow without a shuffle.

Cases: null text, or text without any letter, is `und` with score 0; rows without label or text are not learnt from; without
any row to learn from, everything is `und`; a null doc_id is never held out and its held_out is false; a very long text is
scored in a batch of its own, with some 100 bytes of memory for each of its bytes; extra columns are ignored by predict() and
kept by keep_known().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, keep_rows, map_batches, utf8

ORDER = 4
_START = b"\n" * ORDER  # every text begins in this context
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class GramTable:
    """Open addressing from 64-bit grams to rows of a cost matrix."""

    def __init__(self, grams: np.ndarray, costs: np.ndarray):
        self.bits = max(4, int(2.5 * len(grams) + 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        self.costs = np.ascontiguousarray(costs, np.float32)
        left, step = np.arange(len(grams)), 0
        while len(left):
            slot = self._slot(grams[left], step)
            free = self.rows[slot] < 0
            mine, first = np.unique(slot[free], return_index=True)
            won = left[free][first]
            self.rows[mine], self.keys[mine] = won, grams[won]
            left = left[~np.isin(left, won, assume_unique=True)]
            step += 1
        self.probes = step

    def _slot(self, grams: np.ndarray, step: int) -> np.ndarray:
        return ((grams * _MULTIPLIER >> np.uint64(64 - self.bits)).astype(np.int64) + step) & (1 << self.bits) - 1

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Row of each gram, or -1."""
        slot = self._slot(grams, 0)
        out = self.rows[slot]
        wrong = np.flatnonzero((self.keys[slot] != grams) & (out >= 0))
        step = 1
        while len(wrong) and step < self.probes:
            slot = self._slot(grams[wrong], step)
            rows = self.rows[slot]
            good = (rows < 0) | (self.keys[slot] == grams[wrong])
            out[wrong[good]] = rows[good]
            wrong, step = wrong[~good], step + 1
        out[wrong] = -1
        return out


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte behind the first ORDER of data: its last `order` bytes of context and itself, as an integer."""
    n = len(data) - ORDER
    out = np.zeros(n, np.uint64)
    for j in range(order, -1, -1):
        out = out << np.uint64(8) | data[ORDER - j : ORDER - j + n]
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts, each behind the start context, and where each one's bytes begin and end among the positions that _grams() has."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(_START + t for t in texts), np.uint8)
    begin = np.cumsum(lengths + ORDER) - lengths - ORDER
    return data, begin, begin + lengths


def count_grams(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct grams and their counts for each order from 0."""
    data, begin, end = joined(texts)
    inside = np.zeros(max(0, len(data) - ORDER) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    return [np.unique(_grams(data, k)[inside], return_counts=True) for k in range(ORDER + 1)]


@dataclass
class Model:
    languages: list[str]
    grams: list[GramTable]  # by order: cost of the byte in each language, all escapes included
    contexts: list[GramTable]  # by order: cost of leaving the context, 0 where the language has not seen it

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        data, begin, end = joined(texts)
        n = len(data) - ORDER
        out = np.zeros((len(texts), len(self.languages)))
        if n <= 0:
            return out
        row = self.grams[ORDER].find(_grams(data, ORDER))
        cost = self.grams[ORDER].costs[row]
        left = np.flatnonzero(row < 0)
        cost[left] = 0
        for k in range(ORDER, -1, -1):
            if not len(left):
                break
            gram = np.zeros(len(left), np.uint64)
            for j in range(k, -1, -1):
                gram = gram << np.uint64(8) | data[ORDER - j + left]
            if k < ORDER:
                row = self.grams[k].find(gram)
                cost[left[row >= 0]] += self.grams[k].costs[row[row >= 0]]
                left, gram = left[row < 0], gram[row < 0]
            row = self.contexts[k].find(gram >> np.uint64(8))
            cost[left[row >= 0]] += self.contexts[k].costs[row[row >= 0]]
        cost[left] += 8
        sums = np.vstack([np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0, dtype=np.float64)])
        return sums[end] - sums[begin]


def _model(counted: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Model:
    languages = sorted(counted)
    grams: list[GramTable] = []
    contexts: list[GramTable] = []
    for k in range(ORDER + 1):
        every = np.unique(np.concatenate([counted[name][k][0] for name in languages]))
        every_context = np.unique(every >> np.uint64(8))
        cost, leave = np.zeros((len(every), len(languages))), np.zeros((len(every_context), len(languages)))
        if k:
            lower = grams[k - 1]
            below = every & np.uint64((1 << 8 * k) - 1)
            row = lower.find(below)  # always there: a gram's end was counted too
        for i, name in enumerate(languages):
            own, n = counted[name][k]
            context, first, inverse = np.unique(own >> np.uint64(8), return_index=True, return_inverse=True)
            total, distinct = np.bincount(inverse, n), np.bincount(inverse)
            at = np.searchsorted(every_context, context)
            leave[at, i] = -np.log2(distinct / (total + distinct))
            cost[:, i] = (lower.costs[row, i] if k else 8) + leave[np.searchsorted(every_context, every >> np.uint64(8)), i]
            cost[np.searchsorted(every, own), i] = -np.log2(n / (total + distinct)[inverse])
        grams.append(GramTable(every, cost))
        contexts.append(GramTable(every_context, leave))
    return Model(languages, grams, contexts)


def held_out(key: Column) -> Column:
    """The fold that is not learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def _some(rows: DataFrame, per_language: int, languages: int) -> DataFrame | None:
    """About per_language rows of each of the `languages` most frequent labels (equal counts: first in order of name), drawn by a hash of doc_id."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_language / r["n"]))) for r in counts])
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share)


def train(docs: DataFrame, rows_per_language: int = 1000, bytes_per_language: int = 16 << 20, most_languages: int = 1000) -> Model | None:
    """A model of the labelled rows (text, lang) outside the held-out fold.

    Learnt are about rows_per_language rows of each language, never more than 1.5 times that nor texts beyond bytes_per_language
    bytes together (a longer text is not learnt from), and the most_languages most frequent labels.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("doc_id", "text", "lang")
    some = _some(rows, rows_per_language, most_languages)
    if some is None:
        return None
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    some = some.where(F.octet_length("text") <= bytes_per_language).withColumns({"_n": F.row_number().over(first), "_bytes": F.sum(F.octet_length("text").cast("long")).over(first)})
    some = some.where((F.col("_n") <= int(1.5 * rows_per_language)) & (F.col("_bytes") <= bytes_per_language)).drop("_bytes")

    def count(part: pd.DataFrame) -> pd.DataFrame:
        found = count_grams([t.encode() for t in part["text"]])
        return pd.DataFrame({"lang": part["lang"].iloc[0], "k": range(ORDER + 1), "grams": [g.astype("<u8").tobytes() for g, _ in found], "counts": [n.astype("<u4").tobytes() for _, n in found]})

    counted: dict[str, list] = {}
    # bounded: the grams of the bounded sample
    for r in sorted(some.groupBy("lang").applyInPandas(count, "lang string, k int, grams binary, counts binary").collect(), key=lambda r: (r["lang"], r["k"])):
        counted.setdefault(r["lang"], []).append((np.frombuffer(r["grams"], "<u8"), np.frombuffer(r["counts"], "<u4").astype(np.int64)))
    return _model(counted) if counted else None


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (posterior of that language, equal priors) and bits_per_byte of its code."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            m, texts = shared.value, utf8(batch.column(1))
            has_letter = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if m is None:
                n = len(texts)
                return pa.record_batch([batch.column(0), pa.array(["und"] * n), pa.array([0.0] * n), pa.array([None] * n, pa.float64())], names=[key, "lang_pred", "score", "bits_per_byte"])
            bits = m.bits(texts)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            score = 1 / np.exp2(np.maximum(-1000, least[:, None] - bits)).sum(axis=1)
            size = np.array([len(t) for t in texts])
            return pa.record_batch(
                [
                    batch.column(0), pa.array(m.languages[b] if ok else "und" for b, ok in zip(best.tolist(), has_letter)),
                    pa.array(np.where(has_letter, score, 0.0)), pa.array(least / np.maximum(size, 1), mask=~has_letter),
                ],
                names=[key, "lang_pred", "score", "bits_per_byte"],
            )

        return each

    return map_batches(docs.select(key, text), make, f"{key} {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double", sized_by=1, limit=1 << 18)


def identify(docs: DataFrame, rows_per_language: int = 1000) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every row of docs(doc_id, text, lang)."""
    docs = docs.select("doc_id", "text", "lang")
    found = predict(docs, train(docs, rows_per_language))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def most_bits(docs: DataFrame, model: Model | None, share: float = 0.999, margin: float = 1.25) -> dict[str, float]:
    """For each language the bits a byte that `margin` times all but 1 - share of the labelled texts of the held-out fold need; every one of them is read."""
    if model is None:
        return {}
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & held_out(F.col("doc_id"))).select("doc_id", "text")
    found = predict(rows, model).where("bits_per_byte is not null").groupBy("lang_pred").agg(F.percentile_approx("bits_per_byte", share, 10_000).alias("b"), F.count("*").alias("n"))
    return {r["lang_pred"]: margin * r["b"] for r in found.where("n >= 50").collect()}  # one row for each language


def keep_known(docs: DataFrame, rows_per_language: int = 1000, slack: int = 200) -> DataFrame:
    """The rows of docs (doc_id, text, lang and others) whose text is in a learnt language.

    Refused are `und` and texts whose code in their best language is more than `slack` bits longer than that language's bound of
    most_bits() allows: other languages and scripts, random characters. Short texts cannot be that much longer and stay. A
    language with fewer than 50 labelled texts in the held-out fold has no bound.
    """
    model = train(docs, rows_per_language)
    bound = most_bits(docs, model)
    limits = np.array([bound.get(name, np.inf) for name in model.languages]) if model else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del model
    give_back()  # the driver needs the tables no more

    def make():
        def keep(texts: pa.Array) -> pa.Array:
            known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
            if shared.value is None:
                return pa.array([False] * len(texts))
            raw = utf8(texts)
            bits = shared.value.bits(raw)
            best = bits.argmin(axis=1)
            enough = bits[np.arange(len(bits)), best] <= limits[best] * np.maximum(1, [len(t) for t in raw]) + slack
            return pc.and_(known, pa.array(enough))

        return keep

    return keep_rows(docs, "text", make)
