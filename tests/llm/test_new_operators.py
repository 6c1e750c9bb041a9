"""Packing, tokenizer alignment and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tidewright.llm import packing, period_runs, queries, token_align  # noqa: E402

JSON = P.path("byte_bpe_50k.json")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'web' AS source", "1L AS n_chars", "'own' AS runs", "'own' AS part", "'own' AS chunk").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(("the", "of", "and", "tide", "harbour", "é", "日本", "Vessel,", "cargo.\n", "x\ty", "42")) for _ in range(n))


HARD = [(None, prose(1, 40)), (None, None), (1, None), (1, ""), (2, " "), (3, "\n\n \t"), (4, prose(2, 9000)), (5, prose(3, 30)), (5, prose(3, 30)), (5, prose(4, 10)), (6, "a " * 3000), (7, "<|endoftext|> and <s>"), (8, "𝒳" * 50), (9, "word" * 5000)]
HARD += [(100 + i, prose(i, 3 * i)) for i in range(60)]


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        k = 0
        while k < len(w) - q:
            s = k
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            n = k - s + q
            if k > s and n >= max(6, 4 * q) and all(w[s : s + n - r] != w[s + r : s + n] for r in range(1, q)):
                out.append((s, n, q))
            k += k == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_run_row(doc_id, text):
    w = SPACE.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def order(rows):
    return sorted(rows, key=repr)


def test_runs_of_words(spark, tmp_path):
    r = random.Random(3)
    rows = [x for x in HARD if x[0] != 4]
    for i in range(300, 700):
        w = []
        while len(w) < r.choice((5, 20, 60)):
            u = [r.choice("ab cd e é".split()) for _ in range(r.randint(1, 5))]
            w += (u * 8)[: r.randint(1, 8 * len(u))]
        rows.append((i, r.choice((" ", "\n", "  \x0b")).join(w)))
    got = queries.op13_lcp_runs(spark, documents(spark, tmp_path, rows)).collect()
    assert order(tuple(x[c] for c in RUN_COLUMNS) for x in got) == order(plain_run_row(*x) for x in rows)
    assert sum(x.n_runs for x in got) > 400 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t)


@pytest.mark.parametrize("seed", range(4))
def test_run_search_is_the_plain_one(seed):
    r = random.Random(seed)
    for _ in range(200):
        texts = []
        for _ in range(r.randint(1, 4)):
            w, k = [], r.choice((1, 2, 3, 40))
            while len(w) < r.choice((0, 10, 60)):
                u = [r.randrange(k) for _ in range(r.randint(1, 7))]
                w += (u * 9)[: r.randint(1, 9 * len(u))] if r.random() < 0.5 else u
            texts.append(w)
        first = np.cumsum([0, *map(len, texts)])
        flat = np.array([x for w in texts for x in w], np.uint64)
        assert list(zip(*(c.tolist() for c in period_runs.find_runs(flat, first)))) == [(t, *x) for t, w in enumerate(texts) for x in plain_runs(w)]


def test_long_runs_and_words_that_sums_of_powers_confuse():
    for w in (np.zeros(100_000), np.tile(np.arange(3), 40_000), np.tile(np.arange(20_000), 5)):
        q = len(np.unique(w))
        assert [c.tolist() for c in period_runs.find_runs(w.astype(np.uint64), np.array([0, len(w)]))] == [[0], [0], [len(w)], [q]]
    thue = "a"
    for _ in range(12):
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((thue + other).encode(), np.uint8)
    a, b = period_runs.exact_word_hashes(data, np.array([0, len(thue)]), np.array([len(thue), len(data)])).tolist()
    assert a != b
    with pytest.raises(ValueError):
        period_runs.find_runs(np.zeros(9, np.uint64), np.array([0, 9]), repeats=2)


def padding(lengths, to=2048):
    return sum(0 if n & (n - 1) == 0 else to - n for n in lengths)


def test_packed_pieces(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    sf_dir = documents(spark, tmp_path, HARD)
    got = queries.op11_ffd_packing(spark, sf_dir).collect()
    by_sequence, by_doc = {}, {}
    for x in got:
        by_sequence.setdefault(x.sequence_id, []).append((x.offset, x.length))
        by_doc.setdefault((x.doc_id, x.doc_tokens), []).append((x.start, x.length, x.ids_crc32))
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
        lengths.append(at)
    want = {}
    for doc_id, text in HARD:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault((doc_id, len(ids)), []).append(ids)
    assert want.keys() == by_doc.keys()
    for key, texts in want.items():
        # rows of one id and size are told apart only where their ids differ
        crcs = lambda ids, pieces: all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == c for a, n, c in pieces)
        pieces = sorted(by_doc[key])
        if len(texts) == 1:
            assert [a for a, _, _ in pieces] == [sum(n for _, n, _ in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n, _ in pieces) == key[1] and crcs(texts[0], pieces)
        else:
            assert sum(n for _, n, _ in pieces) == key[1] * len(texts) and (texts[0] != texts[1] or crcs(texts[0], pieces))
    assert padding(lengths) < 0.002 * sum(lengths)
    again = queries.op11_ffd_packing(spark, sf_dir)
    assert len({x.sequence_id for x in again.collect()}) == len(by_sequence)
    assert packing.packed_pieces(packing.pack_sequences(spark.createDataFrame([], "doc_id long, text string"), JSON)).count() == 0


def test_first_fit_decreasing_is_the_plain_one():
    r = np.random.default_rng(7)
    for n in (1, 2, 5, 300):
        sizes = r.integers(1, 2049, n)
        plain, room = [], []
        for i in np.argsort(-sizes, kind="stable").tolist():
            k = next((k for k, x in enumerate(room) if x >= sizes[i]), None)
            if k is None:
                k = len(room)
                plain.append([])
                room.append(2048)
            plain[k].append(i)
            room[k] -= int(sizes[i])
        assert packing.first_fit_decreasing(sizes, 2048) == plain


@pytest.mark.parametrize("least_piece", (1, 16, 5000))
def test_groups_lose_nothing(least_piece):
    r = np.random.default_rng(8)
    for sizes in (np.ones(50, int), np.array([300]), np.array([2048, 4096]), np.full(300, 1400), r.integers(1, 5000, 200)):
        bins = packing.pack_group(sizes.tolist(), least_piece=least_piece)
        seen = sorted((t, a, n) for b in bins for t, a, n in b)
        for t, size in enumerate(sizes.tolist()):
            mine = [(a, n) for u, a, n in seen if u == t]
            assert [a for a, _ in mine] == np.cumsum([0, *(n for _, n in mine)])[:-1].tolist() and sum(n for _, n in mine) == size and all(n > 0 for _, n in mine)
        assert all(sum(n for _, _, n in b) <= 2048 for b in bins)
        if least_piece == 1:
            assert padding([sum(n for _, _, n in b) for b in bins]) == 0


def plain_tokens(text, a, b, of_byte):
    """Ids and byte ends of both tokenizers over blank + text, or None."""
    want = (" " + text).encode()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(of_byte[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in zip(ids_b, pieces)]
    if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    return [list(zip(ids, np.cumsum([len(x) for x in got]).tolist())) for ids, got in ((ids_a, bytes_a), (ids_b, bytes_b))]


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    of_byte, counts, links, rows = token_align.byte_alphabet(), {}, [], []
    for text in texts:
        found = plain_tokens(text or "", a, b, of_byte)
        mine, groups = [], ""
        if found:
            ta, tb = found
            cuts = sorted({e for _, e in ta} & {e for _, e in tb})
            parts, low = [], 0
            for high in cuts:
                parts.append("|".join(",".join(str(i) for i, e in t if low < e <= high) for t in (ta, tb)))
                low = high
            groups, start_a = ";".join(parts), 0
            for i, e in ta:
                start_b = 0
                for j, f in tb:
                    if start_b < e and start_a < f:
                        mine.append((i, j))
                    start_b = f
                start_a = e
        links.append(mine)
        for pair in set(mine):
            counts[pair] = counts.get(pair, 0) + 1
        rows.append((len(ta), len(tb), len(cuts)) if found else (0, 0, 0))
        rows[-1] += (groups,)
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [(na, nb, g, len(m), sum(counts[x] == best[x[0]] for x in m), sum(counts[x] for x in m), groups) for (na, nb, g, groups), m in zip(rows, links)]


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def test_alignment_of_two_tokenizers(spark, tmp_path):
    r = random.Random(11)
    parts = ["the", "Tide's", "harbour.", "élève,", "naïve!", "日本", "𝒳y", "e\u0301.", "¿qué?", "3.14", "a;b:c", "\r\n", "\n", "\n\n", "\t", "  ", "\u00a0", "\u2028x", "()", "×.", "--", "<|endoftext|>", "<s>", "<0x41>", "\x00", "I'll.", "Ω.", "ž,"]
    rows = [x for x in HARD if x[0] not in (4, 6, 9)] + [(20, "a\u2581b"), (21, "\u2581"), (22, "x " * 300), (23, "w" * 400)]
    for i in range(300, 520):
        rows.append((i, "".join(r.choice(parts) + r.choice(("", " ", " ", "\n")) for _ in range(r.randint(1, 25)))))
    got = queries.op12_token_alignment(spark, documents(spark, tmp_path, rows)).collect()
    want = plain_alignment([t for _, t in rows])
    assert order((x.doc_id, *(x[c] for c in ALIGNED), x.groups_sha256) for x in got) == order((i, *w[:6], w[6] and hashlib.sha256(w[6].encode()).hexdigest()) for (i, _), w in zip(rows, want))
    assert sum(x.n_a == 0 for x in got) >= 5 and max(x.n_links for x in got) > 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = token_align.align(docs, JSON, P.path("piece_bpe_32k.model"), keep_groups=True, chunk_bytes=200).collect()
    assert order((x.doc_id, *(x[c] for c in ALIGNED), x.groups) for x in texts) == order((i, *w) for (i, _), w in zip(rows, want))
    assert token_align.align(docs.limit(0), JSON, P.path("piece_bpe_32k.model")).count() == 0


def test_a_full_memory_of_units_starts_again():
    import pyarrow as pa

    store = token_align.UnitStore(JSON, P.path("piece_bpe_32k.model"), most=20)
    texts = [prose(i, 60) + f" n{i}" for i in range(30)]
    want = plain_alignment(texts)
    for i, text in enumerate(texts):
        row = token_align._chunk(store, pa.array([i]), pa.array([text]), True).to_pylist()[0]
        assert [row[c][0] for c in token_align.FIGURES] == list(want[i][:4]) and row["groups"] == [want[i][6]]
    assert store.n <= 20
