"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines within one edit (max_edits = 1) of each other are linked. A line is cut into max_edits + 1 = 2 segments; one edit leaves
one of them as it is, at its place from the begin or, behind the edit, from the end. So a line of length l stands in an index
under (l, first segment) and (l, second segment), and a line probes with its own length and one less. Candidates are verified:
common ends are stripped in steps of 8 characters and the rest goes through a banded bit-parallel edit distance (2k + 1
diagonals in one long).

Index entries with more than `most_bucket` lines do not pair their lines. The lines go one level down, where a key leaves out
one of 16 segments instead of one of 2 and so holds more of the line; and from there, if keys are still crowded, to keys that
leave out a single character. Lines that share such a key are links by construction, so each is only compared with the least
first place of its key: no pairs are made in a crowded group and no link is lost at any size.

Lines are told apart by a 64-bit hash, and what is shuffled are hashes; texts are read again only for lines in candidate
pairs or crowded keys (a broadcast of their hashes up to `most_broadcast` of them, a shuffle join beyond).

A line is removed if an equal line stands before it (doc_id, then line number), or if a linked line has its first place before
its own first place. The earliest line of a chain of links always stays.

Cases: null and empty texts have no lines; lines shorter than `shortest` characters are linked with nothing, and are removed as
copies only if they have `shortest_copies` characters (1 in the pipeline: every line but the empty one; `shortest` if not given);
rows that
repeat a doc_id are one document to the order of lines, so equal lines at one number of such rows are no copies of each other, and
each row loses only lines of its own text; a null doc_id is before all others. Other columns are not touched. A very
long text is split into its lines within its task, so it costs memory in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHORTEST = 20
LEVELS = (2, 16)
_SHIFT = 1 << 31


def lines_of(docs: DataFrame) -> DataFrame:
    """line_no (from 0) and line of every line of docs(doc_id, text), with the other columns of docs."""
    return docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _keys(line: Column, length: Column, segments: int) -> Column:
    """Array of (key, probe): for each segment left out, the line's own keys, then those of lines one character shorter."""

    def key(at: int, own: Column) -> Column:
        begin, end = F.floor(own * at / segments).cast("int"), F.floor(own * (at + 1) / segments).cast("int")
        before = F.substring(line, F.lit(1), begin)
        behind = F.substring(line, length - (own - end) + 1, own - end)
        return F.xxhash64(F.lit(segments), F.lit(at), own, before, F.lit("\n"), behind)

    return F.array(
        *[F.struct(key(i, length).alias("key"), F.lit(False).alias("probe")) for i in range(segments)],
        *[F.struct(key(i, length - 1).alias("key"), F.lit(True).alias("probe")) for i in range(segments)],
    )


def banded_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance of a and b if it is at most k, else some number above k; lengths differ by k at most.

    Bit t of the words stands for row j - k + t of column j; D0, HP, HN, VP and VN are the usual difference vectors.
    """
    m, n, width = F.length(a), F.length(b), 2 * k + 1
    mask = (1 << width) - 1
    start = F.struct(
        F.lit(((1 << (k + 1)) - 1) << k).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(m, F.lit(k)).cast("long").alias("score"),
    )

    def bit(word: Column, at: Column) -> Column:
        return F.call_function("shiftrightunsigned", word, at).bitwiseAND(1)

    def step(acc: Column, j: Column) -> Column:
        here = F.substring(b, j, F.lit(1))
        equal = F.lit(0).cast("long")
        for t in range(width):
            row = j - k + t
            equal = equal + F.when((row >= 1) & (row <= m) & (F.substring(a, F.greatest(row, F.lit(1)), F.lit(1)) == here), F.lit(1 << t).cast("long")).otherwise(F.lit(0).cast("long"))
        # one transform for each stage, so that each value is computed once
        now = F.array(F.struct(acc.alias("s"), equal.alias("eq")))
        now = F.transform(now, lambda x: F.struct(x["s"].alias("s"), _diagonal(x["s"]["vp"], x["s"]["vn"], x["eq"], mask).alias("d0")))
        now = F.transform(now, lambda x: _across(x["s"], x["d0"], mask))
        return F.transform(now, lambda x: moved_on(x, j))[0]

    def moved_on(x: Column, j: Column) -> Column:
        at = (m - j + k).cast("int")
        score = x["score"] + F.when(j + k <= m, 1 - bit(x["d0"], F.lit(2 * k))).otherwise(bit(x["hp"], at) - bit(x["hn"], at))
        down = F.shiftright(x["d0"], 1)
        return F.struct(x["hn"].bitwiseOR(F.bitwise_not(down.bitwiseOR(x["hp"])).bitwiseAND(mask)).alias("vp"), down.bitwiseAND(x["hp"]).alias("vn"), score.alias("score"))

    return F.when(n == 0, m.cast("long")).when(m == 0, n.cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step, lambda acc: acc["score"]))


def _diagonal(vp: Column, vn: Column, eq: Column, mask: int) -> Column:
    return (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(mask)


def _across(s: Column, d0: Column, mask: int) -> Column:
    hp = s["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(s["vp"])).bitwiseAND(mask))
    return F.struct(s["score"].alias("score"), d0.alias("d0"), hp.alias("hp"), d0.bitwiseAND(s["vp"]).alias("hn"))


def _stripped(x: Column, y: Column, front: bool) -> Column:
    """struct(u, v): both without most of their common begin (or end), in steps from 2^30 (no string is twice as long) down to 8 characters."""

    def step(acc: Column, n: Column) -> Column:
        u, v = acc["u"], acc["v"]
        side = (lambda c: F.substring(c, F.lit(1), n)) if front else (lambda c: F.right(c, n))
        rest = (lambda c: F.substring(c, n + 1, F.length(c))) if front else (lambda c: F.substring(c, F.lit(1), F.length(c) - n))
        return F.when((F.length(u) >= n) & (F.length(v) >= n) & (side(u) == side(v)), F.struct(rest(u).alias("u"), rest(v).alias("v"))).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(30, 2, -1)]), F.struct(x.alias("u"), y.alias("v")), step)


def within(pairs: DataFrame, k: int = 1) -> DataFrame:
    """Rows of pairs(x, y: strings, among others) whose strings are within k edits."""
    def once(df: DataFrame, name: str, value: Column) -> DataFrame:
        """A column that is computed once for each row; a plain column would be put into every place that reads it."""
        return df.withColumn(name, F.explode(F.array(value)))

    df = pairs.where(F.abs(F.length("x") - F.length("y")) <= k)
    df = once(once(df, "_v", _stripped(F.col("x"), F.col("y"), True)), "_w", _stripped(F.col("_v.u"), F.col("_v.v"), False))
    # within one edit, what the steps leave is short; with more edits the part between the outer two may be long
    if k == 1:
        df = df.where(F.greatest(F.length("_w.u"), F.length("_w.v")) <= 17)
    return once(df, "_d", banded_distance(F.col("_w.u"), F.col("_w.v"), k)).where(F.col("_d") <= k).drop("_v", "_w", "_d")


def _texts(docs: DataFrame, wanted: DataFrame, shortest: int, most_broadcast: int) -> DataFrame:
    """lid and line of the wanted lines (lid), read from the texts."""
    wanted = written(wanted.select("lid").distinct(), "wanted")
    every = lines_of(docs).where(F.length("line") >= shortest).select(F.xxhash64("line").alias("lid"), "line")
    few = wanted.count() <= most_broadcast  # 8 bytes each
    every = every.join(F.broadcast(wanted) if few else wanted, "lid", "left_semi")
    return written(every.groupBy("lid").agg(F.min("line").alias("line")), "line-texts")


def line_links(docs: DataFrame, lines: DataFrame, shortest: int, most_bucket: int, most_broadcast: int) -> DataFrame:
    """lid, n_links, least: for each linked line, the number of lines within one edit and the least first place of them.

    lines: lid, first (place of the first of equal lines) and keys (of the first level).
    """
    # a bucket matters if it holds two lines, one of them under its own length
    found, crowd, k0 = [], None, lines.select("lid", F.explode("keys").alias("k")).select("lid", "k.key", "k.probe")
    texts = None
    for level in (0, 1):
        buckets = k0.groupBy("key").agg(F.count("*").alias("n"), F.min("probe").alias("only_probes")).where("n > 1 and not only_probes").select("key", "n")
        members = written(k0.join(buckets, "key"), "buckets")
        few = members.where(F.col("n") <= most_bucket)
        x, y = few.alias("x"), few.alias("y")
        pairs = x.join(y, F.expr("x.key = y.key and x.lid <> y.lid and not x.probe and (y.probe or x.lid < y.lid)")).select(F.least("x.lid", "y.lid").alias("a"), F.greatest("x.lid", "y.lid").alias("b")).distinct()
        pairs = written(pairs, "pairs")
        crowd = written(members.where(F.col("n") > most_bucket).select("lid").distinct(), "crowd")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("lid")).union(crowd)
        if texts is None:
            texts = _texts(docs, wanted, shortest, most_broadcast)
        s = texts
        both = pairs.join(s.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a").join(s.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b")
        found.append(within(both).select("a", "b"))
        crowded = s.join(crowd, "lid")
        k0 = crowded.select("lid", F.explode(_keys(F.col("line"), F.length("line"), LEVELS[1])).alias("k")).select("lid", "k.key", "k.probe")
    links = written(found[0].union(found[1]).distinct(), "links")
    places = lines.select("lid", "first")
    ends = links.select("a", "b").union(links.select("b", "a")).toDF("lid", "other")
    # the last level: keys without one character; crowded lines only
    length = F.length("line")
    every = F.sequence(F.lit(0), length - 1)

    def without(j: Column) -> Column:
        return F.concat(F.substring(F.col("line"), F.lit(1), j), F.lit("\n"), F.substring(F.col("line"), j + 2, length))

    same = crowded.select("lid", F.explode(F.transform(every, lambda j: F.xxhash64(F.lit(1), j, without(j)))).alias("key"))
    # of a run of equal characters any may go: one key
    shorter = crowded.select("lid", F.explode(F.array_distinct(F.transform(every, lambda j: F.xxhash64(F.concat(F.substring(F.col("line"), F.lit(1), j), F.substring(F.col("line"), j + 2, length)))))).alias("whole"))
    inserted = shorter.join(crowded.select(F.xxhash64("line").alias("whole"), F.col("lid").alias("other")), "whole").select("lid", "other")
    inserted = inserted.union(inserted.select(F.col("other"), F.col("lid")))
    exact = ends.union(inserted).distinct().join(places.withColumnRenamed("lid", "other"), "other").groupBy("lid").agg(F.count("*").alias("n_links"), F.min("first").alias("least"))
    # substitutions among crowded lines: counts and least places by key, less those that pairs have found already
    same = same.join(places, "lid")
    sums = same.groupBy("key").agg(F.count("*").alias("n"), F.min("first").alias("least")).where("n > 1")
    star = same.join(sums, "key").groupBy("lid").agg(F.sum(F.col("n") - 1).alias("n_same"), F.min("least").alias("least_same"))
    twice = links.join(crowded.select(F.col("lid").alias("a"), F.length("line").alias("la")), "a").join(crowded.select(F.col("lid").alias("b"), F.length("line").alias("lb")), "b").where("la = lb")
    twice = twice.select(F.explode(F.array("a", "b")).alias("lid")).groupBy("lid").agg(F.count("*").alias("n_twice"))
    star = star.join(twice, "lid", "left").select("lid", (F.col("n_same") - F.coalesce("n_twice", F.lit(0))).alias("n_same"), "least_same")
    out = exact.join(star, "lid", "full_outer")
    return out.select("lid", (F.coalesce("n_links", F.lit(0)) + F.coalesce("n_same", F.lit(0))).alias("n_links"), F.least("least", "least_same").alias("least"))


def judged_lines(docs: DataFrame, shortest: int = SHORTEST, most_bucket: int = 32, most_broadcast: int = 2_000_000, shortest_copies: int | None = None, by_text: bool = False) -> DataFrame:
    """doc_id (and text_hash, if by_text), line_no, copy (an equal line stands before), near (a linked line does) and n_links of every line of `shortest` or `shortest_copies` characters or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = ["doc_id", "text_hash"] if by_text else ["doc_id"]
    length = F.length("line")
    every = lines_of(docs.withColumn("text_hash", F.xxhash64("text")) if by_text else docs).where(length >= min(shortest, shortest if shortest_copies is None else shortest_copies))
    keys = _keys(F.col("line"), length, LEVELS[0])
    if shortest_copies is not None:  # short lines have no keys, so no pairs
        keys = F.when(length >= shortest, keys).otherwise(F.filter(keys, lambda k: F.lit(False)))
    place = F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))).cast("decimal(38,0)") * F.lit(_SHIFT).cast("decimal(12,0)") + F.col("line_no")
    every = written(every.select(*ids, "line_no", place.cast("decimal(38,0)").alias("place"), F.xxhash64("line").alias("lid"), keys.alias("keys")), "lines")
    distinct = every.groupBy("lid", "keys").agg(F.min("place").alias("first"))
    distinct = written(distinct, "distinct-lines")
    linked = written(line_links(docs, distinct, shortest, most_bucket, most_broadcast), "linked")
    facts = distinct.select("lid", "first").join(linked, "lid", "left")
    return every.select(*ids, "line_no", "place", "lid").join(facts, "lid").select(
        *ids, "line_no", (F.col("place") > F.col("first")).alias("copy"), (F.coalesce(F.col("least") < F.col("first"), F.lit(False))).alias("near"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def line_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_copies, n_near (removed though no equal line stands before) and n_links (summed over its lines)."""
    sums = judged_lines(docs, **how).groupBy("doc_id").agg(
        F.count("*").alias("n_judged"), F.sum(F.col("copy").cast("long")).alias("n_copies"), F.sum((~F.col("copy") & F.col("near")).cast("long")).alias("n_near"), F.sum("n_links").alias("n_links"),
    )
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines")).alias("d")
    s = sums.alias("s")
    zero = F.lit(0).cast("long")
    return d.join(s, F.expr("d.doc_id <=> s.doc_id"), "left").select(
        "d.doc_id", F.col("n_lines").cast("long").alias("n_lines"), *[F.coalesce(c, zero).alias(c) for c in ("n_copies", "n_near", "n_links")],
    )


def drop_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with the removed lines taken out of the column text; all other columns and all rows stay.

    Lines are told by doc_id and a hash of their text, so rows of one id, or of none, that hold different texts lose only their own.
    """
    gone = judged_lines(docs, by_text=True, **how).where("copy or near").groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    d, g = docs.alias("d"), gone.alias("g")
    joined = d.join(g, F.expr("cast(d.doc_id AS long) <=> g.doc_id AND xxhash64(d.text) = g.text_hash"), "left")
    kept = F.array_join(F.filter(F.split("d.text", "\n", -1), lambda line, i: ~F.array_contains("g.gone", i)), "\n")
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(kept).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
