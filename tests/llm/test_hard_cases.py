"""Null ids, repeated rows, ids with several texts, a text of a megabyte, columns of clashing names and empty tables, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tidewright.llm import bpe, huffman_ids, licenses, line_join, minhash_hamming, mpeg, ppm_langid, spaced_seeds, suffix_repeats, url_reputation  # noqa: E402

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
CLASHING = "_line _gone gone th id ids line line_no key places spans n file word run a b comp shingles start bad host url licenses print sig rep media kept lid text_hash".split()
WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them".split()


def prose(seed, size):
    r = random.Random(seed)
    out = []
    while size > 0:
        out.append(" ".join(r.choices(WORDS, k=12)) + r.choice((".\n", ". ")))
        size -= len(out[-1])
    return "".join(out)


TEXT = prose(1, 900)
ROWS = [(None, TEXT), (None, None), (1, None), (1, ""), (2, prose(2, 1_000_000)), (3, TEXT), (3, TEXT), (3, prose(4, 700)), (5, "¿?"), (6, "x" * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en" if t else None, "web", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("own") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(TEXT.split()[10:40])), (None, "a b c d e f g"), (2, None)], "item_id long, text string").withColumns({c: F.lit("own") for c in CLASHING})


REPORTS = {
    "op1": lambda d, b: suffix_repeats.remove_repeats(d), "op2": lambda d, b: mpeg.media_digest(d), "op3": lambda d, b: line_join.line_report(d), "op4": lambda d, b: bpe.round_trip(d, RANKS, P.PATTERN), "op5": lambda d, b: licenses.scan_licenses(d),
    "op7": lambda d, b: minhash_hamming.near_duplicates(d), "op8": lambda d, b: huffman_ids.ids_round_trip(d, JSON), "op9": lambda d, b: ppm_langid.identify(d), "op10": lambda d, b: spaced_seeds.decontaminate(d, b),
}


@pytest.mark.parametrize("name", REPORTS)
def test_a_row_for_every_row(docs, bench, name):
    got = REPORTS[name](docs, bench)
    rows = got.collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((i is not None, i or 0) for i, _ in ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    if name == "op1":
        assert {r.n_bytes: r.n_removed for r in by[3]} == {len(TEXT): len(TEXT), len(ROWS[7][1]): 0} and by[6][0].n_removed == 3000 and by[2][0].n_removed == 0
    if name == "op2":
        assert all(r.index_ok for r in rows) and by[2][0].n_bytes == len(ROWS[4][1])
    if name == "op4":
        assert all(r.lossless for r in rows) and sorted(r.n_tokens for r in by[1]) == [0, 0]
    if name == "op5":
        assert all(r[c] == "own" for r in rows for c in CLASHING if c != "licenses")
    if name == "op7":
        assert {r.component_id for r in by[3]} == {3} and {r.n_shingles for r in by[1]} == {0} and by[2][0].kept
        assert sorted((r.n_shingles > 0, r.component_id) for r in by[None]) == [(False, None), (True, 3)] and all(r.kept for r in by[None])
    if name == "op8":
        ordered = sorted(rows, key=lambda r: r.start)
        assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))] and ordered[0].doc_id is None and ordered[1].doc_id is None
    if name == "op9":
        assert by[5][0].lang_pred == "und" and by[2][0].lang_pred == "en" and not by[None][0].held_out
    if name == "op10":
        assert sorted((r.item_ids, r.contaminated) for r in by[3]) == [([], False), ([1], True), ([1], True)] and all(r.n_items == 0 for r in by[1])
        assert sorted((r.item_ids, r.contaminated) for r in by[None]) == [([], False), ([1], True)]


@pytest.mark.parametrize("name", REPORTS)
def test_an_empty_table_stays_one(docs, bench, name):
    assert REPORTS[name](docs.limit(0), bench).count() == 0


STAGES = {"lines": lambda d, b: line_join.drop_lines(d, shortest_copies=1), "near": lambda d, b: minhash_hamming.keep_first(d), "leaks": lambda d, b: spaced_seeds.drop_contaminated(d, b), "language": lambda d, b: ppm_langid.keep_known(d)}


@pytest.mark.parametrize("name", STAGES)
def test_filters_keep_all_columns(docs, bench, name):
    got = STAGES[name](docs, bench)
    assert got.dtypes == docs.dtypes
    rows = got.collect()
    assert all(r[c] == "own" for r in rows for c in CLASHING)
    ids = sorted(r.doc_id or 0 for r in rows)
    if name == "near":  # one of the repeated rows goes, and the row without an id whose text has one
        assert ids == [0, 1, 1, 2, 3, 3, 5, 6] and len({r.text for r in rows if r.doc_id == 3}) == 2
    if name == "leaks":
        assert 2 in ids and len([r for r in rows if r.doc_id == 3]) == 1
    if name == "language":
        assert all(r.text for r in rows) and 5 not in ids and 2 in ids
    assert STAGES[name](docs.limit(0), bench).count() == 0


def test_pages_of_all_kinds(spark):
    rows = [(None, "http://a.b/c"), (1, None), (1, "http://A.b"), (1, "http://A.b"), (2, "x" * 1_000_000), (3, "http://" + "y." * 1000 + "com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("own") for c in CLASHING if c != "url"})
    bad = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "page_id long, bad int")
    got = url_reputation.filter_urls(pages, bad, []).collect()
    assert len(got) == len(rows) and {r.host for r in got if r.page_id == 1} == {"", "a.b"} and all(r.rule is None for r in got)
    assert url_reputation.filter_urls(pages.limit(0), bad.limit(0), []).count() == 0


def test_pipeline_of_hard_rows(docs, spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, docs.limit(0)):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            before = kept
            kept = stage(spark, kept, str(tmp_path)).cache()
            assert name == "tokens" or kept.columns == before.columns
        assert (kept.count() > 0) == (start is docs) and kept.where("not lossless").count() == 0


LINE = "a line of more than twenty characters, shared"


def test_rows_of_one_id_lose_only_their_own_lines(spark):
    rows = [(1, f"{LINE}\nfirst of them all"), (2, f"{LINE}\nanother text under two"), (2, f"words that nobody else has at all\n{LINE}"), (None, f"{LINE}\nnobody"), (None, "unique words of a row without an id\nand more"), (2, None)]
    got = line_join.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # rows without an id come first, so theirs is the line that stays
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [
        (0, f"{LINE}\nnobody"), (0, "unique words of a row without an id\nand more"), (1, "first of them all"), (2, ""), (2, "another text under two"), (2, "words that nobody else has at all"),
    ]


def test_one_row_of_exact_copies_stays(spark):
    copies = [(i, TEXT, f"{i}-{k}") for i in (7, None) for k in range(3)] + [(8, TEXT.upper(), "u"), (9, prose(9, 600), "n"), (9, prose(9, 600), "m"), (9, prose(10, 600), "o")]
    lone = [(None, prose(11, 600), "p"), (None, prose(11, 600), "q"), (None, prose(11, 600) + " end", "r"), (None, "", "s"), (None, None, "t"), (9, "", "v"), (9, "", "w")]
    docs = spark.createDataFrame(copies + lone, "doc_id long, text string, print string").repartition(3)
    got = minhash_hamming.keep_first(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((r.doc_id or 0, len(r.text or "") > 0) for r in rows) == [(0, False), (0, False), (0, True), (7, True), (9, False), (9, False), (9, True), (9, True)]
    assert {r.text for r in rows if r.doc_id == 9} == {prose(9, 600), prose(10, 600), ""}


def test_items_of_other_ids(spark):
    docs = spark.createDataFrame([("a", TEXT), ("a", "clean"), (None, TEXT)], "doc_id string, text string")
    bench = spark.createDataFrame([("x-1", " ".join(TEXT.split()[:30])), (None, " ".join(TEXT.split()[30:60]))], "item_id string, text string")
    got = spaced_seeds.decontaminate(docs, bench).collect()
    assert sorted((r.doc_id or "", r.item_ids, r.contaminated) for r in got) == [("", ["x-1"], True), ("a", [], False), ("a", ["x-1"], True)]
