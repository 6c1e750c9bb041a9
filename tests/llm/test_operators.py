"""Each operator against a plain version of itself, with the hard cases: nulls, empty and long texts, ties, repeated rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tidewright.llm import bpe, graph, huffman_ids, licenses, line_join, minhash_hamming, mpeg, pieces, ppm_langid, queries, spaced_seeds, suffix_repeats, url_reputation  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "extra") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, at string")


HARD = [None, "", " ", "\n\n", "a", "word " * 3, "x" * 5000, "ab\n" * 700, "é" * 900, "same text twice in the table, long enough to be something", "same text twice in the table, long enough to be something", "日本語 のテキスト"]


# ---- op1 ----

def plain_repeats(texts, length):
    seen = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most_group", [2, 512])
def test_repeats(spark, most_group):
    r = random.Random(3)
    base = "".join(r.choice("abcd") for _ in range(300))
    texts = [*HARD, *(base[: r.randint(50, 300)] + "".join(r.choice("abcd") for _ in range(60)) + base[r.randint(0, 200) :] for _ in range(25)), "xyz " * 60, "q" + "xyz " * 50]
    got = suffix_repeats.remove_repeats(docs_of(spark, texts), 60, 30, most_group).orderBy("doc_id").collect()
    assert [(g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got] == plain_repeats(texts, 60)


def test_maximal_repeats_list_all_occurrences():
    right = [b"cdeX", b"cdeY", b"cdeX", b"zzzz"]
    left = [b"ba", b"ba", b"bq", b"ba"]
    found = {(b, e, tuple(sorted(m))) for b, e, m in suffix_repeats.maximal_repeats(left, right, 4, 0)}
    assert (2, 3, (0, 1)) in found and (1, 4, (0, 2)) in found


def test_repeats_of_empty_table(spark):
    assert suffix_repeats.remove_repeats(docs_of(spark, ["a"]).limit(0)).count() == 0


# ---- op2 ----

def test_media_round_trip(spark):
    got = mpeg.media_digest(docs_of(spark, HARD)).orderBy("doc_id").collect()
    for g, t in zip(got, HARD):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[9].media_sha256 == got[10].media_sha256 and got[9].feature == got[10].feature


def test_media_reader_resynchronises():
    stream = mpeg.encode(mpeg.payload_of(b"hello" * 300), 1500)
    clean = mpeg.parse(stream)
    assert clean.crc_bad == 0 and clean.lost == 0 and clean.samples == 1152 * 3 and clean.table_frames == 3 and clean.duration * 48_000 == 3456 and len(clean.kbps) == 2 and clean.tags["n_bytes"] == "1500"
    at = clean.offsets[1]
    dirty = mpeg.parse(stream[:at] + b"\xff\xfbjunk\xff" + stream[at:])
    assert dirty.payload == clean.payload and dirty.lost == 7
    broken = bytearray(stream)
    broken[at + 10] ^= 1
    bad = mpeg.parse(bytes(broken))
    assert bad.crc_bad == 1 and len(bad.payload) == len(clean.payload) and bad.payload[:576] == clean.payload[:576] and bad.payload[1152:] == clean.payload[1152:]
    assert mpeg.seek(stream, clean.offsets, clean.duration / 2, clean.rate) == clean.payload[576:1152]
    assert mpeg.parse(b"").offsets == [] and mpeg.parse(b"\xff" * 99).rate is None


def test_media_with_a_lost_header_in_frames_like_bytes():
    # payloads full of headers of another kind, and of the stream's own kind without a checksum that holds
    r = random.Random(6)
    for fake in (b"\xff\xfb\x90\x64", b"\xff\xfa\x54\x04", b"\xff\xfd\x84\x00"):
        payload = mpeg.payload_of(b"".join(fake + r.randbytes(r.randrange(60)) for _ in range(200)))
        stream = mpeg.encode(payload, len(payload))
        clean = mpeg.parse(stream)
        assert clean.payload == payload and clean.lost == 0
        at = clean.offsets[2]
        broken = mpeg.parse(stream[:at] + b"\0\0\0\0" + stream[at + 4 :])
        assert broken.offsets == clean.offsets[:2] + clean.offsets[3:] and broken.lost == clean.offsets[3] - at


def test_tags_and_tables_of_other_writers():
    def frame(name, body, major):
        return name + (mpeg.synchsafe(len(body)) if major == 4 else len(body).to_bytes(4 if major == 3 else 3, "big")) + (b"\0\0" if major > 2 else b"") + body

    text = b"\x03" + "Ñandú".encode()
    for major, name, extended in ((2, b"TT2", b""), (3, b"TIT2", (6).to_bytes(4, "big") + bytes(6)), (4, b"TIT2", mpeg.synchsafe(6) + b"\1\0")):
        body = extended + frame(name, text * 30 if major == 4 else text, major) + bytes(20)
        tags, end = mpeg._id3v2(b"ID3" + bytes((major, 0, 0x40 if extended else 0)) + mpeg.synchsafe(len(body)) + body + b"rest")
        assert tags[name.decode()].startswith("Ñandú") and end == 10 + len(body)
    wide = frame(b"TALB", b"\x01" + "\ufeffabÿA".encode("utf-16-le"), 3).replace(b"\xff\x00", b"\xff\x00\x00")  # unsynchronised
    assert mpeg._id3v2(b"ID3\x03\0\x80" + mpeg.synchsafe(len(wide)) + wide)[0]["TALB"] == "abÿA"
    # a VBRI table in the first frame; two frames behind it
    head = mpeg._head(128, protected=False)
    vbri = b"VBRI" + bytes(6) + (999).to_bytes(4, "big") + (2).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (128).to_bytes(2, "big") * 2
    found = mpeg.parse((head + bytes(32) + vbri).ljust(384, b"\0") + (head + bytes(380)) * 2)
    assert (found.table, found.table_frames, found.table_bytes, found.toc, len(found.offsets), found.crc_unchecked) == ("VBRI", 2, 999, [0, 384, 768], 2, 0)
    # layer I: the bit allocation is protected
    kind = bytes((0xFF, 0xFE, 0x44, 0x00))
    one = mpeg.header(kind)
    body = bytes(range(32)) + bytes(one.size - 38)
    good = kind + mpeg.crc16(kind[2:] + bytes(range(32))).to_bytes(2, "big") + body
    assert (one.layer, one.checked) == (1, 32) and mpeg.parse(good * 3).crc_ok == 3 and mpeg.parse(good + kind + b"\0\0" + body + good).crc_bad == 1
    # two rates in one stream cannot be: the second kind is passed over, and the duration stays that of the first
    other = bytes((0xFF, 0xFB, 0x90, 0x00))
    mixed = mpeg.parse((head + bytes(380)) * 3 + (other + bytes(mpeg.header(other).size - 4)) * 2)
    assert mixed.rate == 48_000 and mixed.samples == 3 * 1152 and mixed.lost == 2 * mpeg.header(other).size


# ---- op3 ----

def edit(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        new = [i]
        for j, q in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
        row = new
    return row[-1]


def plain_lines(texts, shortest):
    first = {}
    for d, t in enumerate(texts):
        for i, line in enumerate(t.split("\n") if t is not None else []):
            if len(line) >= shortest:
                first.setdefault(line, (d, i))
    near = {a: [b for b in first if a != b and abs(len(a) - len(b)) <= 1 and edit(a, b) <= 1] for a in first}
    out = []
    for d, t in enumerate(texts):
        lines = t.split("\n") if t is not None else []
        judged = [(i, s) for i, s in enumerate(lines) if len(s) >= shortest]
        copies = sum((d, i) > first[s] for i, s in judged)
        nears = sum((d, i) == first[s] and any(first[b] < first[s] for b in near[s]) for i, s in judged)
        out.append((d, len(lines), copies, nears, sum(len(near[s]) for _, s in judged)))
    return out


@pytest.mark.parametrize("most_bucket", [1, 32])
def test_lines(spark, most_bucket):
    r = random.Random(5)
    base = ["".join(r.choice("abé ") for _ in range(n)) for n in (6, 9, 9, 14)]
    texts = [None, "", "\n", "short"]
    for _ in range(20):
        lines = []
        for _ in range(4):
            s = list(r.choice(base))
            for _ in range(r.choice((0, 1, 1, 2))):
                k, p = r.randint(0, 2), r.randrange(len(s))
                s[p : p + (k != 1)] = [] if k == 0 else [r.choice("abé ")]
            lines.append("".join(s))
        texts.append("\n".join(lines))
    got = line_join.line_report(docs_of(spark, texts), shortest=5, most_bucket=most_bucket).orderBy("doc_id").collect()
    assert [tuple(g) for g in got] == plain_lines(texts, 5)


def test_line_texts_keep_what_stays(spark):
    line = "a line that is long enough to be judged"
    docs = docs_of(spark, [f"{line}\nx\n{line}", line + "!", None, ""])
    got = line_join.drop_lines(docs).orderBy("doc_id")
    assert got.columns == docs.columns and [r.text for r in got.collect()] == [f"{line}\nx", "", None, ""]


def test_short_lines_are_judged_for_copies(spark):
    line = "a line that is long enough to be judged"
    texts = [f"Menu\nx\n\n{line}\nMenu", f"Menu\nMenv\n\n{line}!\ny", None, "", "x"]
    lines = corpus_pipeline.lines(spark, docs_of(spark, texts), SMALL).orderBy("doc_id")
    assert [(r.doc_id, r.text, r.n_chars) for r in lines.collect()] == [(0, f"Menu\nx\n\n{line}", 47), (1, "Menv\n\ny", 7), (2, None, 0), (3, "", 0)]
    links = {(r.doc_id, r.line_no): (r.copy, r.near, r.n_links) for r in line_join.judged_lines(docs_of(spark, texts), shortest_copies=1).collect()}
    assert links[0, 4] == (True, False, 0) and links[1, 1] == (False, False, 0) and links[1, 3] == (False, True, 1) and (0, 2) not in links


def test_edit_in_a_line_of_over_a_million_characters(spark):
    half = "0123456789abcdef" * 70_000
    pairs = spark.createDataFrame([(1, half + "x" + half, half + "y" + half), (2, half + "x", half + "y"), (3, half + "x" + half, half + "yz" + half)], "n int, x string, y string")
    assert sorted(r.n for r in line_join.within(pairs).select("n").collect()) == [1, 2]


# ---- op4, op8 ----

@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é'sTl1²½.,!\n\t \u00a0\u3000日\0\x1c")) | st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_bpe_equals_the_library(tik, texts):
    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    packed = c.encode(pa.array(texts, pa.string()))
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [tik.encode_ordinary(t) for t in texts]
    assert [c.decode(p).decode() for p in packed] == texts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é'sTl1²½.,!\n\t \u00a0\u3000日\0\x1c")) | st.characters(codec="utf-8"), max_size=40) | st.sampled_from(["a <|endoftext|> b\nc", "x" * 40, "word " * 9]), max_size=6))
def test_library_ids_of_cut_texts(library, texts):
    ids, bounds = huffman_ids.library_store(P.path("byte_bpe_50k.json")).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("most", [0, 3, 50, 10_000])
def test_pieces_are_found_again_in_a_full_memory(most):
    def lengths(pieces):
        made.extend(pieces)
        return np.array([len(p.encode()) for p in pieces]), np.concatenate([np.frombuffer(p.encode(), np.uint8) for p in pieces]).astype(np.uint32)

    r, made = random.Random(2), []
    store = pieces.PieceStore(lengths, most=most)
    for _ in range(6):
        texts = [" ".join("".join(r.choices("abcé", k=r.choice((1, 2, 3, 8, 9, 16, 17, 31, 32, 33, 70)))) for _ in range(r.randrange(60))) for _ in range(9)] + [None, "", "a\0", "a"]
        ids, bounds = store.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].astype(np.uint8).tobytes().decode() for a, b in zip(bounds, bounds[1:])] == [t or "" for t in texts]
        assert store.n <= most
    assert most < 10_000 or len(made) == len(set(made)) + sum(len(p.encode()) > 32 for p in made) - len({p for p in made if len(p.encode()) > 32})
    whole = pieces.PieceStore(lengths, cut=False)
    ids, bounds = whole.encode(pa.array(["a b", None, "a b", ""]))
    assert bounds.tolist() == [0, 3, 3, 6, 6] and whole.n == 1


def test_bpe_query(spark, tik):
    got = bpe.round_trip(docs_of(spark, HARD), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).orderBy("doc_id").collect()
    assert [g.n_tokens for g in got] == [len(tik.encode_ordinary(t or "")) for t in HARD] and all(g.lossless for g in got)


def test_perfect_hash():
    items = {str(i).encode(): i for i in range(1000)}
    table = bpe.PerfectHash(items)
    assert all(table.get(k) == v for k, v in items.items()) and table.get(b"x") is None and bpe.PerfectHash({}).get(b"") is None


def test_huffman_is_optimal_and_limited():
    import heapq

    n = np.array([5, 9, 12, 13, 16, 45, 1, 1])
    heap, cost = n.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((huffman_ids.code_lengths(n) * n).sum()) == cost
    short = huffman_ids.code_lengths(2 ** np.arange(12), 5)
    assert short.max() <= 5 and sum(0.5**x for x in short.tolist()) <= 1


def test_ids_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [*HARD, "a<|endoftext|>b", "long text " * 900]
    got = sorted(tuple(r) for r in huffman_ids.ids_round_trip(docs_of(spark, texts), P.path("byte_bpe_50k.json")).collect())
    t, start, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert huffman_ids.ids_round_trip(docs_of(spark, ["a"]).limit(0), P.path("byte_bpe_50k.json")).count() == 0


# ---- op5, op6 ----

def test_licences(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "// This work is licensed under the GNU General Public License, version 3.\nOr, at your option, any later version.", "Released under the MIT License. Licensed under CC BY-NC 4.0.", "no permission here", None, ""]
    got = licenses.scan_licenses(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [["Apache-2.0"], ["GPL-3.0-or-later"], ["CC-BY-NC-4.0", "MIT"], [], [], []]
    assert all(re.search(licenses.HINT, p) for _, p in licenses.SENTENCES)


GPL = """# This program is free software; you can redistribute it and/or
# modify it under the terms of the GNU General Public License
# as published by the Free Software Foundation; either version {}
# of the License, or (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""


def test_wrapped_licences(spark):
    cases = [
        (GPL.format(2), ["GPL-2.0-or-later"]), (GPL.format(3), ["GPL-3.0-or-later"]), (GPL.format(2).replace("# ", ""), ["GPL-2.0-or-later"]), (MIT, ["MIT"]), (MIT.replace("\n", "\r\n"), ["MIT"]), (BSD, ["BSD-2-Clause"]), (BSD + ENDORSE, ["BSD-3-Clause"]),
        (APACHE, ["Apache-2.0"]), (MPL, ["MPL-2.0"]), (MPL.replace(", v.", ",\n * v."), ["MPL-2.0"]), ("This is free and unencumbered software released\ninto the public\ndomain.", ["Unlicense"]), ("prose without an end\nAll rights\nreserved", ["Proprietary"]),
        ("This library is\nlicensed under the GNU Lesser General\nPublic License version 2.1.", ["LGPL"]), ("Licensed under the GNU Affero\nGeneral Public License, version 3.", ["AGPL-3.0"]), ("# SPDX-License-Identifier: MIT", ["MIT"]), ("/* SPDX-License-Identifier: GPL-2.0+ */", ["GPL-2.0-or-later"]),
        ("SPDX-License-Identifier: (MIT OR GPL-3.0-or-later)", ["GPL-3.0-or-later", "MIT"]), ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note", ["GPL-2.0-only"]), ("SPDX-License-Identifier: Own-1.0", []), ("All rights. Reserved", []), ("all rights\n\nreserved", []),
    ]
    got = licenses.scan_licenses(docs_of(spark, [t for t, _ in cases])).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [want for _, want in cases]
    assert got[0].license_ids == ["GPL2Later", "NoWarranty"] and got[3].license_ids == ["MITGrant", "MITNotice", "MITAsIs"] and got[7].license_ids == ["Apache20", "ApacheFull", "ApacheAsIs"]


LGPL = GPL.replace("program is free", "library is free").replace("GNU General Public License\n# as", "GNU Lesser General Public\n# License as")
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented."""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""
BOOST = """//          Distributed under the Boost Software License, Version 1.0.
//    (See accompanying file LICENSE_1_0.txt or copy at a page)"""
BOOST_TEXT = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software."""


def test_more_licences(spark):
    project = "Prose before.\n\nThis project is licensed under the {} - see the LICENSE file for details.\n\nProse after."
    cases = [
        (LGPL.format("2.1"), ["LGPL"]), (LGPL.format("3"), ["LGPL"]), (GPL.replace("General", "Affero General", 1).format(3), ["AGPL-3.0"]),
        ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", ["GPL-2.0-only"]),
        (ISC, ["ISC"]), (ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), ["0BSD"]), (ZLIB, ["Zlib"]), (ZLIB.replace("\n", "\r\n"), ["Zlib"]), (EPL, ["EPL-2.0"]),
        (EPL.replace("2.0", "v1.0"), ["EPL-1.0"]), (BOOST, ["BSL-1.0"]), (BOOST_TEXT, ["BSL-1.0"]), (project.format("MIT License"), ["MIT"]), (project.format("Apache License 2.0"), ["Apache-2.0"]), (project.format("BSD 3-Clause License"), ["BSD-3-Clause"]),
        (project.format("GNU General Public License v3.0"), ["GPL-3.0-only"]), (project.format("GNU General Public License v3.0 or later"), ["GPL-3.0-or-later"]), (project.format("ISC License"), ["ISC"]), (project.format("Mozilla Public License 2.0"), ["MPL-2.0"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]), ("Licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]), ("Except where otherwise noted, this work is licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
        ("SPDX-License-Identifier: ISC OR EPL-2.0", ["EPL-2.0", "ISC"]), ("This project is licensed under the terms of a contract.", []), ("The MIT License is short. Boost software is fast.", []), ("licensed under the MIT\n\nlicense", []), ("permission is granted to anyone to use this software", []),
    ]
    got = licenses.scan_licenses(docs_of(spark, [t for t, _ in cases])).orderBy("doc_id").collect()
    assert [(t, r.licenses) for (t, _), r in zip(cases, got)] == cases
    known = {name for name, _ in licenses.SENTENCES}
    assert all(i in known for _, ids in licenses.RULES for i in ids) and all(any(n in ids for _, ids in licenses.RULES) for n in known - {"SPDX", "ISCAsIs", "ZlibAsIs", "MITGrant", "MITNotice", "MITAsIs", "ApacheFull", "ApacheAsIs", "NoWarranty", "BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse"})


def test_urls(spark):
    rows = [(1, "http://A.Example.com/en/7x?q"), (2, "https://b.com/en/"), (3, None), (4, "no scheme"), (5, "x://h#f"), (6, "http://example.net/de/8"), (7, "http://q.net/de/1"), (8, "http://z.org/es/?"), (9, "http://bad.xyz/a")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = spark.createDataFrame([(9, 1)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.filter_urls(pages, bad, queries.URL_RULES).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block") and got[3] == ("", "", None, "allow") and got[5][:2] == ("h", "")
    assert got[6][2:] == ("example.net/de/8", "block") and got[7][2:] == ("net/de/", "allow") and got[8][2:] == ("org/es/", "block")
    many = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else 'good'}.xyz/{i}") for i in range(120)], "page_id long, url string")
    marks = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "page_id long, bad int")
    verdicts = {r.host: r.verdict for r in url_reputation.filter_urls(many, marks, []).collect()}
    assert verdicts == {"bad.xyz": "block", "good.xyz": "allow"}


def test_huffman_files_grow_with_the_bytes(spark):
    assert huffman_ids.file_count(0, 0) == 1 and huffman_ids.file_count(1 << 20, 6) == 6 and huffman_ids.file_count((1 << 40) + 1, 200) == 4097
    ids = spark.range(0, 600_000, 1, 4).select((F.col("id") * 7 - 1_000_000).alias("doc_id"))
    bounds = huffman_ids.file_bounds(ids, 10_000)
    rows = np.diff(np.concatenate(([-1], (bounds + 1_000_000) // 7, [599_999])))
    assert len(bounds) == 9_999 and rows.sum() == 600_000 and rows.min() >= 30 and rows.max() <= 90  # 60 each, a quarter of a file off at both ends
    same = spark.range(100).select(F.lit(5).cast("long").alias("doc_id"))
    assert huffman_ids.file_bounds(same, 50).tolist() == [5] and len(huffman_ids.file_bounds(same.select(F.lit(None).cast("long").alias("doc_id")), 50)) == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


# ---- op7 ----

def plain_components(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def test_rows_that_repeat_an_id_make_no_links(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=7))
    rows = []
    for i in range(0, 40, 2):
        one = [word() for _ in range(400)]
        other = one[:300] + [word() for _ in range(100)]  # similarity about 0.6
        rows += [(i, " ".join(one))] * (1 + i % 3) + [(i + 1, " ".join(other))] * (1 + (i + 2) % 4)
    # 101 has two texts and is linked by both; 104 and 105 have only texts of their own
    a, b, c, d, e = (" ".join(word() for _ in range(100)) for _ in range(5))
    rows += [(100, a), (101, a), (101, b + " x"), (101, b + " x"), (102, b), (103, c), (104, d), (104, e), (105, c + " " + d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(x.doc_id, x.component_id) for x in minhash_hamming.near_duplicates(docs).collect()}
    assert got == {(i, i) for i in (*range(40), 100, 103, 104, 105)} | {(101, 100), (102, 100)}
    assert {x.doc_id for x in minhash_hamming.keep_first(docs).collect()} == {*range(40), 100, 103, 104, 105}


def test_near_duplicates(spark):
    r = random.Random(11)
    texts = [*HARD, "one two", "ONE two"]
    for _ in range(3):
        base = [f"w{r.randrange(4000)}" for _ in range(150)]
        for _ in range(25):
            copy = list(base)
            for _ in range(r.choice((0, 1, 2, 4, 5, 6, 8, 12))):
                copy[r.randrange(len(copy))] = r.choice(("the", "of", f"v{r.randrange(99)}"))
            texts.append(" ".join(copy))
    got = minhash_hamming.near_duplicates(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(g) for g in got] == plain_components(texts)
    assert minhash_hamming.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_families_of_templates_and_remnants(spark):
    """Families around a common text: copies with own edits, copies with one of few other passages, texts of which only parts are left."""
    r = random.Random(17)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    texts = []
    for size in (60, 90, 140):
        base = [word() for _ in range(size)]
        others = [[word() for _ in range(size // 4)] for _ in range(2)]
        for _ in range(14):
            edited = list(base)
            for _ in range(r.randrange(5)):
                edited[r.randrange(size)] = r.choice(("the", word()))
            at, other = r.randrange(size // 2), r.choice(others)
            swapped = base[:at] + other[: r.randrange(3, len(other))] + base[at + r.randrange(len(other)) :]
            begin = r.randrange(size // 3)
            texts += [" ".join(x) for x in (edited, swapped, base[begin : begin + r.randrange(size // 2, size)])]
    r.shuffle(texts)
    got = minhash_hamming.near_duplicates(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(g) for g in got] == plain_components(texts)


# ---- op9 ----

def test_language(spark):
    got = queries.op9_ppm_language(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    hard = ppm_langid.identify(docs_of(spark, HARD)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in hard[:5]] == ["und"] * 4 + ["en"] and hard[0].score == 0
    none = ppm_langid.identify(docs_of(spark, ["text"], None)).first()
    assert none.lang_pred == "und"
    assert ppm_langid.keep_known(docs_of(spark, HARD)).columns == docs_of(spark, HARD).columns


def test_code_lengths_are_those_of_the_counts():
    model = ppm_langid._model({"x": ppm_langid.count_grams([b"abab"]), "y": ppm_langid.count_grams([b"cc"])})
    # order 0 of x: a 2, b 2 of 4, two distinct; a byte nobody has seen escapes from order 0 to 8 bits
    bits = model.bits([b"z"])[0]
    context = -np.log2(1 / 2)  # the start context has seen one byte once: escape 1 / (1 + 1) at each order it is known
    assert bits[0] == pytest.approx(4 * context + -np.log2(2 / 6) + 8, abs=1e-4)


# ---- op10 ----

def test_decontamination(spark):
    item = " ".join(f"word{i}" for i in range(20))
    near = " ".join("CHANGED" if i in (6, 13) else f"Word{i}" for i in range(20))
    texts = [f"begin {item} end", f"x y {near} z", "nothing of it here at all", " ".join(f"word{i}" for i in range(4)), None, "", "a b c d e f"]
    bench = spark.createDataFrame([(1, item), (2, "a b c d e"), (3, "a b"), (4, None), (5, "")], "item_id long, text string")
    got = spaced_seeds.decontaminate(docs_of(spark, texts), bench).orderBy("doc_id").collect()
    assert [r.item_ids for r in got] == [[1], [1], [], [], [], [], [2]] and got[1].most_words >= 12
    assert [r.doc_id for r in spaced_seeds.drop_contaminated(docs_of(spark, texts), bench).orderBy("doc_id").collect()] == [2, 3, 4, 5]
    blocks = spaced_seeds.decontaminate(docs_of(spark, texts), bench, block_words=5).orderBy("doc_id").collect()
    assert [r.item_ids for r in blocks] == [r.item_ids for r in got]
    assert spaced_seeds.decontaminate(docs_of(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def plain_overlaps(texts, items, least=8, shortest=5):
    """Every shift at which some mask (or, in a short item, all words) agrees, scored by the best stretch."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    out = []
    for t in map(words, texts):
        found = {}
        for item_id, item in ((i, words(x)) for i, x in items):
            if len(item) < shortest:
                continue
            masks = [m for m in spaced_seeds.MASKS if len(m) <= len(item)] + (["1" * len(item)] if len(item) < spaced_seeds.SPAN else [])
            for shift in range(-len(item), len(t)):
                if any(all(c == "0" or (0 <= p + k + shift < len(t) and t[p + k + shift] == item[p + k]) for k, c in enumerate(m)) and p + shift >= 0 and p + shift + len(m) <= len(t) for m in masks for p in range(len(item) - len(m) + 1)):
                    same = [item[p] == t[p + shift] for p in range(max(0, -shift), min(len(item), len(t) - shift))]
                    score, at, begin = max((sum(1 if x else -3 for x in same[a:b]), -b, -a) for a in range(len(same)) for b in range(a + 1, len(same) + 1))
                    n = sum(same[-begin : -at])
                    if n >= min(least, len(item)):
                        found[item_id] = max(found.get(item_id, 0), n)
        out.append((sorted(found), max(found.values(), default=0)))
    return out


@pytest.mark.parametrize("most_hits", [3, 1 << 20])
def test_decontamination_against_all_shifts(spark, monkeypatch, most_hits):
    monkeypatch.setattr(spaced_seeds, "_MOST_HITS", most_hits)
    r = random.Random(9)
    items = [(i, " ".join(r.choices("abcdefg", k=r.choice((3, 5, 7, 9, 14, 25))))) for i in range(12)] + [(20, None), (21, "")]
    texts = [None, "", "a"]
    for _ in range(25):
        t = r.choices("abcdefgh", k=r.randrange(40))
        for _ in range(2):
            piece = r.choice(items[:12])[1].split()
            piece = [r.choice((w, w, w, w, w, "ZZ", w.upper())) for w in piece]
            at = r.randrange(len(t) + 1)
            t[at:at] = piece
        texts.append(" ".join(t))
    got = spaced_seeds.decontaminate(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [(x.item_ids, x.most_words) for x in got] == plain_overlaps(texts, items)


# ---- pipeline ----

def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = cp.language(spark, docs, SMALL).cache()
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in before.items() if re.search(r"[^\W\d_]", r.text)}
    lines = cp.lines(spark, kept, SMALL).cache()
    assert lines.columns == docs.columns and all(r.text and r.n_chars == len(r.text) for r in lines.collect())
    plain, seen = {}, set()
    for r in kept.orderBy("doc_id").collect():  # whatever else goes, copies of lines do
        for i, line in enumerate(r.text.split("\n")):
            plain.setdefault(r.doc_id, []).extend([line] if line not in seen or not line else [])
            seen.add(line)
    for r in lines.collect():
        rest = iter(plain[r.doc_id])
        assert all(line in rest for line in r.text.split("\n"))
    assert {r.doc_id for r in lines.collect()} >= {i for i, t in plain.items() if len("".join(t)) > 400}
    near = cp.near_duplicates(spark, lines, SMALL).cache()
    rows = lines.orderBy("doc_id").collect()
    roots = [rows[c].doc_id for i, _, c, k in plain_components([r.text for r in rows]) if k]
    assert sorted(r.doc_id for r in near.collect()) == sorted(roots)
    clean = cp.contamination(spark, near, SMALL)
    assert clean.columns == docs.columns and clean.count() <= near.count()
    out = cp.tokens(spark, clean, SMALL)
    assert out.count() == clean.count() and out.where("not lossless").count() == 0


@pytest.mark.parametrize("most_at_once", [0, 1000])
def test_components(spark, most_at_once):
    r = random.Random(4)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    root = {n: n for pair in links for n in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "a long, b long"), most_at_once=most_at_once).collect()}
    assert got == {n: c for n, c in root.items() if any(n in p and p[0] != p[1] for p in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), most_at_once=most_at_once).count() == 0


def test_language_bounds_read_every_held_out_text(spark):
    """No text of the held-out fold is left out of the bounds, however many there are."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the rain in spain falls "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    model = ppm_langid.train(docs, 100)
    every = ppm_langid.predict(docs.where(ppm_langid.held_out(F.col("doc_id"))), model).agg(F.max("bits_per_byte")).first()[0]
    assert ppm_langid.most_bits(docs, model, share=1.0, margin=1.0) == {"en": every}
    odd = docs.withColumn("text", F.when(F.col("doc_id") == docs.where(ppm_langid.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id").desc()).first()[0], "zqxjvk" * 9).otherwise(F.col("text")))
    assert ppm_langid.most_bits(odd, model, share=1.0, margin=1.0)["en"] > every
