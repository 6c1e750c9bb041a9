"""Near duplicates by MinHash signatures and a multi-index Hamming join, confirmed on full shingle sets.

A text's set holds its distinct 5-word shingles. Its signature has 64 symbols of b = 16 bits, one for each of 64 hash functions;
two texts of similarity J differ in about (1 - J) * 64 symbols. All pairs that differ in at most 31 symbols are candidates,
without exception: the signature is cut into 16 chunks of 4 symbols, so by pigeonhole some chunk of such a pair has at most one
error, and the index holds each chunk under its 4 keys of 3 symbols (the error may be any one of the four). A pair of
similarity 0.75 differs in more than 31 symbols with a probability of about 1e-5.

Links are confirmed on full sets (100 * intersection >= 75 * union). All pairs of a large group are never made:

1. Texts of equal sets form a class; its smallest id stands for it (a hash, if that id has another text that does so already).
   Only classes that share a bucket with another are read on; their sets are written once.
2. A class of which less than 75 of 100 shingles occur in any other of these classes has no link and goes.
3. In each bucket every class meets the bucket's hub, the class with the largest share of shingles that others have: the text
   that the others are copies of, if it is there. Close pairs are confirmed and joined to components.
4. What is still in other components than its hub can only be linked by shingles outside of the hub's set, or where the hub's
   set is large enough by itself. Shingles that only one component has outside of the hub's set are dropped, then members that
   are left with too few for any link. Of the rest each meets a second hub, chosen alike, and only what stays apart then is
   paired, by shared outside shingles, with the counts that a link needs.

So components are those of the full link graph among candidates, while the pairs of a group of n copies grow as n.

Cases: null or empty texts and texts without words have an empty set, n_shingles 0, and are linked with nothing; fewer than
five words make one shingle; repeated rows are one class, and an id with several texts is linked by each of them; rows of a null
id are in the group of similar texts, component_id is null if none of them has an id; which rows of one id, or of none, stay is told at
keep_first(). Other columns are not read by near_duplicates() and kept by keep_first(). Batches are bounded by bytes, a very long
text is one by itself; skewed keys of joins are split by AQE, hubs of many members by their count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_batches, written
from .graph import components
from .words import hashed_words, mix

WORDS = 5
SYMBOLS, CHUNK, MOST_ERRORS = 64, 4, 31
_STEP = np.array([0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x369DEA0F31A53F85, 0x27BB2EE687B0B0FD], np.uint64)
_SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))[:, None]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 5-word shingle hashes of each text; fewer words make one shingle, no word none."""
    words, first = hashed_words(column)
    n = max(0, len(words) - WORDS + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(WORDS):
        runs += words[j : n + j] * _STEP[j]
    runs = mix(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """64 symbols of 16 bits: mixed bits of the least value of the shingles under each of 64 hash functions."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[None, i : i + 4096]
        least = np.minimum(least, ((part ^ _SEEDS) * np.uint64(0xE7037ED1A0B428DB)).min(axis=1))
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2")


def _print(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, print (128 bits of a hash of the set) and sig of every text."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(1))
            return pa.record_batch(
                [
                    batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array((_print(s.tobytes()) for s in sets), pa.binary()),
                    pa.array((signature(s).tobytes() if len(s) else None for s in sets), pa.binary()),
                ],
                names=["doc_id", "n_shingles", "print", "sig"],
            )

        return each

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_shingles long, print binary, sig binary", sized_by=1, limit=1 << 20)


def index_keys(classes: DataFrame) -> DataFrame:
    """key and all columns but sig: 64 keys of each class, one for each chunk and each symbol of it that may be wrong."""
    names = [c for c in classes.columns if c != "sig"]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sig = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2").reshape(-1, SYMBOLS // CHUNK, CHUNK).astype(np.uint64)
            keys = []
            for skip in range(CHUNK):
                k = np.zeros(sig.shape[:2], np.uint64)
                for j in range(CHUNK):
                    if j != skip:
                        k = k << np.uint64(16) | sig[:, :, j]
                k = k << np.uint64(8) | np.arange(0, SYMBOLS // CHUNK, dtype=np.uint64)[None, :] << np.uint64(2) | np.uint64(skip)
                keys.append(k)
            keys = np.concatenate(keys, axis=1)
            row = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
            return pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), *(c.take(row) for c in batch.columns[1:])], names=["key", *names])

        return each

    return map_batches(classes.select("sig", *names), make, _schema(classes.select(*names), "key long"))


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*more, *(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)])


def _sets(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, shingles (sorted 64-bit hashes) and sig of each class in ids(id), one row for each, however often its text stands in docs."""
    wanted = classes.join(ids, "id", "left_semi").select("id", "print", "sig", F.col("rep").alias("doc_id"))
    texts = docs.join(wanted, "doc_id").select("id", "text", "print", "sig")
    # classes without any id are read by the hash of their set; where no row lacks an id, statistics of the files spare the scan
    lone = _with_print(docs.where("doc_id is null")).join(wanted.where("doc_id is null").drop("doc_id"), F.col("_print") == F.col("print"))
    texts = texts.union(lone.select("id", "text", "print", "sig"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
            own = pa.array([_print(s) == p for s, p in zip(sets, batch.column(2).to_pylist())], pa.bool_())
            return pa.record_batch([batch.column(0), pa.array(sets, pa.binary()), batch.column(3)], names=["id", "shingles", "sig"]).filter(own)

        return each

    return map_batches(texts, make, "id long, shingles binary, sig binary", sized_by=1, limit=1 << 20).dropDuplicates(["id"])


def _common_sizes(sets: DataFrame) -> DataFrame:
    """id and n_common: how many of its shingles at least one other of the sets has too."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            each_set = [np.frombuffer(raw, "<i8") for raw in batch.column(1).to_pylist()]
            return pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), [len(s) for s in each_set])), pa.array(np.concatenate(each_set))], names=["id", "shingle"])

        return each

    rows = map_batches(sets.select("id", "shingles"), make, "id long, shingle long", sized_by=1, limit=1 << 20)
    # counts are summed before they are shuffled, and the join has a shuffle of its own that can be split where a shingle is very common
    often = written(rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle"), "often")
    return rows.join(often, "shingle", "left_semi").groupBy("id").agg(F.count("*").alias("n_common"))


def _with_sets(pairs: DataFrame, sets: DataFrame, most: int = 500) -> DataFrame:
    """pairs(a, b, ...) with sa, ga, sb, gb: sets and signatures of both. A class that is a in many pairs is split, so that no task has them all."""
    w = Window.partitionBy("a")
    salted = pairs.withColumn("slots", F.ceil(F.count("*").over(w) / most).cast("int"))
    slots = salted.groupBy("a").agg(F.max("slots").alias("slots"))
    left = salted.withColumn("slot", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int")).join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"), F.col("sig").alias("gb")), "b")
    right = slots.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"), F.col("sig").alias("ga")), "a").select("a", "sa", "ga", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    return left.join(right, ["a", "slot"]).select(*pairs.columns, "sa", "sb", "ga", "gb")


def _both(batch: pa.RecordBatch, at: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return tuple([np.frombuffer(raw, "<u8") for raw in batch.column(at + i).to_pylist()] for i in (0, 1))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, shared, united of pairs within the signature distance and of sets of similar size: sizes of intersection and union of the full sets."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SYMBOLS) for i in (4, 5))
            sizes = [pc.divide(pc.binary_length(batch.column(i)), 8).to_numpy().astype(np.int64) for i in (2, 3)]
            near = ((x != y).sum(axis=1) <= MOST_ERRORS) & (100 * np.minimum(*sizes) >= 75 * np.maximum(*sizes))  # a link needs sets of similar size
            batch, shared, united = batch.filter(pa.array(near)), [], []
            for x, y in zip(*_both(batch, 2)):
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                shared.append(int((merged[1:] == merged[:-1]).sum()))
                united.append(len(merged) - shared[-1])
            return pa.record_batch([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(united, pa.int64())], names=["a", "b", "shared", "united"])

        return each

    return written(map_batches(_with_sets(pairs.select("a", "b"), sets), make, "a long, b long, shared long, united long", sized_by=2, limit=1 << 20), "pairs")


def _outside(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members(a: hub, b: member, ...) with a row for each shingle of the member's set that the hub's set lacks."""
    n, names = len(members.columns), members.columns

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rest = [np.setdiff1d(y, x, assume_unique=True) for x, y in zip(*_both(batch, n))]
            at = pa.array(np.repeat(np.arange(len(rest)), [len(r) for r in rest]))
            return pa.record_batch([*(batch.column(i).take(at) for i in range(n)), pa.array(np.concatenate(rest).view(np.int64))], names=[*names, "shingle"])

        return each

    return map_batches(_with_sets(members, sets).drop("ga", "gb"), make, _schema(members) + ", shingle long", sized_by=n, limit=1 << 20)


def _peeled(outside: DataFrame) -> DataFrame:
    """Rows of outside (a, b, comp, hub_comp, shared, n, least_n, central, shingle) that can matter for a link between components of a hub's members, with n_out: how many a member has."""
    w, of_member = Window.partitionBy("a", "shingle"), Window.partitionBy("a", "b")
    rows = outside.withColumn("lo", F.min("comp").over(w)).withColumn("hi", F.max("comp").over(w)).where("lo < hi").drop("lo", "hi")
    return rows.withColumn("n_out", F.count("*").over(of_member)).where("175 * (shared + n_out) >= 75 * (n + least_n)")


def _relabelled(df: DataFrame, comp: DataFrame, node: str, name: str) -> DataFrame:
    return df.drop(name).join(comp.select(F.col("node").alias(node), F.col("component").alias("_c")), node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c")


def _pivot(w: Window, node: str) -> Column:
    """The most central of a window's rows, the least of equals."""
    return -F.max(F.struct("central", (-F.col(node)).alias("least"))).over(w)["least"]


def _apart(live: DataFrame, rows: DataFrame, star: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """Further confirmed pairs (a, b, shared, united) between classes that share a bucket but are in different components of `links`.

    rows: key, id, hub. Pairs with the hub are known (star).
    """
    facts = live.select("id", F.col("n_shingles").alias("n"), "n_common", "central")
    facts = written(_relabelled(facts, components(links), "id", "comp"), "facts")
    known = star.select(F.col("a").alias("hub"), F.col("b").alias("id"), "shared")
    rest = rows.where("id <> hub").join(facts, "id").join(facts.select(F.col("id").alias("hub"), F.col("comp").alias("hub_comp")), "hub").join(known, ["hub", "id"], "left")
    w = Window.partitionBy("key")
    rest = rest.withColumn("open", F.max(F.col("comp") != F.col("hub_comp")).over(w)).where("open").drop("open")
    rest = written(rest, "rest")

    # outside of the hub's set: what members of different components have in common must make up for what the hub's set cannot give
    members = rest.where("shared is not null").select(F.col("hub").alias("a"), F.col("id").alias("b"), "comp", "hub_comp", "shared", "n", "central").distinct()
    w = Window.partitionBy("a")
    members = members.withColumn("least_n", F.min("n").over(w)).withColumn("open", F.max(F.col("comp") != F.col("hub_comp")).over(w)).where("open").drop("open")
    outside = written(_peeled(_outside(members, sets)), "outside")

    # a second hub in each group of those that share an outside shingle, and of those in a bucket that are too far from the hub to be measured
    second = outside.where("comp <> hub_comp").select(_pivot(Window.partitionBy("a", "shingle"), "b").alias("a"), "b")
    far = rest.where("shared is null and comp <> hub_comp").select(_pivot(Window.partitionBy("key"), "id").alias("a"), F.col("id").alias("b"))
    second = _confirmed(second.union(far).where("a <> b").distinct(), sets)
    if not _links(second).isEmpty():
        comp = written(components(links.union(_links(second))), "components")
        outside = _relabelled(outside, comp, "b", "comp").withColumnRenamed("a", "hub")
        outside = written(_peeled(_relabelled(outside, comp, "hub", "hub_comp").withColumnRenamed("hub", "a")), "outside")
        rest = _relabelled(_relabelled(rest, comp, "id", "comp"), comp, "hub", "hub_comp")

    # what is still apart; each pair once: of two that are both off the hub's component, the smaller is x
    x, y = outside.where("comp <> hub_comp").alias("x"), outside.alias("y")
    may = "x.a = y.a and x.shingle = y.shingle and x.comp <> y.comp and (y.comp = y.hub_comp or x.b < y.b)"
    # the most that two members can share, inside of the hub's set and outside
    may += " and 175 * (least(x.shared, y.shared) + least(x.n_out, y.n_out)) >= 75 * (x.n + y.n)"
    met = x.join(y, F.expr(may))
    enough = "175 * (least(first(x.shared), first(y.shared)) + count(*)) >= 75 * (first(x.n) + first(y.n))"
    third = met.groupBy(F.col("x.a").alias("hub"), F.col("x.b").alias("a"), F.col("y.b").alias("b")).agg(F.expr(enough).alias("ok")).where("ok").select("a", "b")
    # pairs without a measured hub, and those for which the hub's set alone may be enough
    w = Window.partitionBy("key")
    rest = rest.withColumn("least_n", F.min("n").over(w)).withColumn("far", F.max(F.col("shared").isNull()).over(w))
    rest = rest.where("far or 175 * shared >= 75 * (n + least_n)")
    x, y = rest.where("comp <> hub_comp").alias("x"), rest.alias("y")
    may = "x.key = y.key and x.comp <> y.comp and (y.comp = y.hub_comp or x.id < y.id) and 175 * least(x.n_common, y.n_common) >= 75 * (x.n + y.n)"
    may += " and 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n) and (x.shared is null or y.shared is null or 175 * least(x.shared, y.shared) >= 75 * (x.n + y.n))"
    third = third.union(x.join(y, F.expr(may)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    third = third.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return second.union(_confirmed(third, sets))


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.where("100 * shared >= 75 * united").select("a", "b")


def _grouped(docs: DataFrame) -> DataFrame:
    """Of every row: doc_id, n_shingles, component_id, its class and its group (both null for empty sets)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = written(features(docs), "features")
    # equal sets: one class, named by its smallest id (empty sets are in none)
    classes = feats.where("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    nth = F.row_number().over(Window.partitionBy(F.coalesce("rep", F.xxhash64("print"))).orderBy("print"))
    classes = written(classes.withColumn("id", F.when((nth == 1) & F.col("rep").isNotNull(), F.col("rep")).otherwise(F.xxhash64("print"))), "classes")
    # classes alone in all their buckets have no candidate
    keys = written(index_keys(classes.select("id", "sig")), "keys")
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    candidates = keys.join(shared, "key", "left_semi").select("id").distinct()
    sets = written(_sets(candidates, classes, docs), "sets")
    discard(keys, shared)
    live = classes.join(_common_sizes(sets), "id").where("100 * n_common >= 75 * n_shingles")
    live = written(live.select("id", "sig", "n_shingles", "n_common", (F.col("n_common") / F.col("n_shingles")).alias("central")), "live")

    keys = index_keys(live.select("id", "central", "sig"))
    hubs = keys.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("central", (-F.col("id")).alias("least"))).alias("h")).where("n > 1")
    rows = written(keys.join(hubs.select("key", (-F.col("h.least")).alias("hub")), "key").select("key", "id", "hub"), "buckets")
    star = _confirmed(rows.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), sets)
    more = _apart(live, rows, star, _links(star), sets)

    of_class = written(feats.join(classes.select("print", "id", "rep"), "print", "left").select("doc_id", "n_shingles", "id", "rep"), "of-class")
    # an id with several texts links their classes
    ends = of_class.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("doc_id", "a")
    one_id = of_class.join(ends, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    comp = written(components(_links(star.union(more)).union(one_id)), "components")
    least = comp.join(classes.select("id", "rep"), comp["node"] == classes["id"]).groupBy("component").agg(F.min("rep").alias("least"))
    comp = comp.join(least, "component").select("node", "component", "least")
    found = of_class.join(comp, of_class["id"] == comp["node"], "left")
    return found.select("doc_id", "n_shingles", F.coalesce("least", "rep", "doc_id").alias("component_id"), F.col("id").alias("class"), F.coalesce("component", "id").alias("group"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included), kept (doc_id = component_id)."""
    found = _grouped(docs).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def _with_print(docs: DataFrame) -> DataFrame:
    """docs with _print, the hash of the set (null for an empty one), as features() makes it."""
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("_print", T.BinaryType())])

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(at))
            return pa.record_batch([*batch.columns, pa.array((_print(s.tobytes()) if len(s) else None for s in sets), pa.binary())], names=schema.names)

        return each

    return map_batches(docs, make, schema, sized_by=at, limit=1 << 20)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs (all columns) that stand for their group of near duplicates; texts without words all stay.

    Of rows that repeat a doc_id and a set one stays (the least text). Rows without an id go if their group has a row with one;
    of a group that has none, one row stays.
    """
    found = written(_grouped(docs), "groups")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    stay = docs.alias("d").join(gone.alias("g"), F.expr("d.doc_id = g.doc_id"), "left_anti")
    many = written(found.where("n_shingles > 0 and (doc_id is null or doc_id = component_id)").groupBy("doc_id", "class").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id").distinct(), "repeated")
    if many.isEmpty():  # no row without an id and no repeated one: nothing else to choose from
        return stay
    s, m = stay.alias("s"), many.alias("m")
    once = s.join(m, F.expr("s.doc_id <=> m.doc_id"), "left_anti")
    again = _with_print(s.join(m, F.expr("s.doc_id <=> m.doc_id"), "left_semi"))
    empty = again.where("_print is null").select(*docs.columns)
    # groups without any id: their classes, known by one of their prints
    lone = features(docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), "text")).select("print").distinct()
    of_print = lone.join(found.where("doc_id is null and component_id is null").select("class", "group").distinct(), F.xxhash64("print") == F.col("class")).select(F.col("print").alias("_of"), F.col("group").alias("_group"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = lambda rows, *by: rows.groupBy(*by).agg(F.min_by(row, "text").alias("_row")).select("_row.*")
    named = least(again.where("_print is not null and doc_id is not null"), "doc_id", "_print")
    nameless = again.where("_print is not null and doc_id is null").join(of_print, F.col("_print") == F.col("_of"))
    return once.union(empty).union(named).union(least(nameless, "_group"))
