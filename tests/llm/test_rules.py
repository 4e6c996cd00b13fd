"""Operators 7, 9 and 10."""

import random
import re
import zlib
from collections import Counter

import pytest
from helpers import ODD, clashing, frame, measures_brute, rows_of
from pyspark.sql import functions as F

from tiergraph.llm import op07_rule_ledger as op7
from tiergraph.llm import op09_license_rules as op9
from tiergraph.llm import op10_interleave as op10
from tiergraph.llm import queries as Q


def odd_texts():
    rng = random.Random(2)
    out = [t for _, t in ODD]
    for _ in range(60):
        out.append(" ".join(rng.choice(["a", "b", "c#", "dd", "\n", "\t"]) for _ in range(rng.randrange(80))))
    return out + ["x " * 40, "a b c d e f g h " * 2, "a b c d e f g h i " * 3 + "z", "l1 a\n l1 a\nl1 a\n\n\n", "|||| <> ##"]


def test_measures(spark):
    rows = list(enumerate(odd_texts()))
    got = {r[0]: tuple(r[1:6]) for r in op7.measure(clashing(frame(spark, rows))).collect()}
    assert got == {k: measures_brute(t) for k, t in rows}


def test_policies_and_ablations(spark):
    rows = list(enumerate(odd_texts()))
    ledger = op7.ledger(frame(spark, rows)).persist()
    kept = {r.doc_id: (r.base_failed, r.kept) for r in op7.apply_policy(ledger).collect()}
    for k, t in rows:
        n, _, _, _, rep = measures_brute(t)
        assert kept[k][0] == (n < 20 or 100 * rep > 30 * n)
        assert not (kept[k][0] and kept[k][1])
    bits = {r.doc_id: r.failed for r in ledger.collect()}
    only = {r.doc_id: r.only_rule for r in op7.apply_policy(ledger).collect()}
    counted = op7.mask_of(op7.POLICIES[op7.PRODUCTION])
    assert only == {k: next((n for j, (n, _) in enumerate(op7.RULES) if b & counted == 1 << j), None) for k, b in bits.items()}
    for version, rules in op7.POLICIES.items():
        mask = op7.mask_of(rules)
        for r in op7.ablations(ledger, version).collect():
            bit = op7.mask_of([r.rule])
            assert r.failing == sum(bool(b & bit) for b in bits.values())
            assert r.only_this == sum(b & mask == bit for b in bits.values())
            assert r.kept_without == sum(b & mask & ~bit == 0 for b in bits.values())


def test_clean_documents_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    good = Q.table(spark, sf, "labels").where("quality = 1")
    kept = Q.op7_rule_ledger(spark, sf).join(good, "doc_id").where("not base_failed")
    assert kept.where("kept").count() >= 0.97 * kept.count()


def test_native_plans(spark, sf):
    for q in (Q.op7_rule_ledger, Q.op8_line_dedup, Q.op10_interleave):
        plan = q(spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert rows_of(op7.apply_policy(op7.ledger(none))) == []
    assert rows_of(op9.scan(none)) == []
    assert rows_of(op10.interleave(op10.slim(none))) == []


def test_known_sentences_are_as_normalised():
    for s in op9.SENTENCES:
        assert s == s.lower().strip() and not re.search(op9.BREAK, s) and not s.endswith(":")
    assert {i for ids, _ in op9.RULES for i in ids} <= set(op9.SENTENCES.values())


@pytest.mark.parametrize(
    ("text", "licenses", "unmatched"),
    [
        (None, "", 0),
        ("", "", 0),
        ("no licence here", "", 0),
        ("Intro.\nReleased under the MIT License.\nmore", "MIT", 0),
        ("Licensed under   the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at:\nhttp", "Apache-2.0", 0),
        ("You may not use this file except in compliance with the License.", "", 1),
        ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", "CC-BY-NC-4.0,Proprietary", 0),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only", 0),
        ("All rights reserved. All rights reserved.", "Proprietary", 0),
    ],
)
def test_licences(spark, text, licenses, unmatched):
    row = op9.scan(clashing(frame(spark, [(1, text)]))).first()
    assert (row.licenses, row.unmatched) == (licenses, unmatched)


#: The longest rule of each licence.
FULL = {name: list(ids) for ids, name in sorted(op9.TEXT_RULES, key=lambda r: len(r[0]))}


def test_every_licence_of_the_table_is_found_by_its_references(spark):
    texts = [(k, f"// SPDX-License-Identifier: {x}\n") for k, x in enumerate(op9.SPDX)]
    texts += [(1000 + k, f"It is.\nDistributed under the {name.title()}.") for k, name in enumerate(op9.NAMES)]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in op9.scan(frame(spark, texts)).collect()}
    only = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
    assert got == {k: (f"{x}-only" if x in only else x, 0) for k, x in enumerate(op9.SPDX)} | {1000 + k: (x, 0) for k, x in enumerate(op9.NAMES.values())}
    assert len(op9.SPDX) > 50 and len(FULL) > 25


MIT_FILE = '''MIT License

Copyright (c) 2021 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
'''
GPL2_HEADER = '''/*
 * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.
 */
int main() { return 0; }
'''
MPL_HEADER = '''# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at https://mozilla.org/MPL/2.0/.
'''
APACHE_HEADER = '''# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
'''


def test_whole_licence_files(spark):
    texts = [(1, MIT_FILE), (2, GPL2_HEADER), (3, MPL_HEADER), (4, APACHE_HEADER)]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in op9.scan(frame(spark, texts)).collect()}
    assert got == {1: ("MIT", 0), 2: ("GPL-2.0-or-later", 0), 3: ("MPL-2.0", 0), 4: ("Apache-2.0", 0)}


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "> ", "; "])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_hard_wrapped_licences(spark, mark, newline):
    import textwrap

    said = {i: s for s, i in op9.SENTENCES.items()}
    rows = []
    for k, ids in enumerate(FULL.values()):
        body = "\n\n".join("\n".join(textwrap.wrap(said[i].capitalize() + ".", 76 - 7 * (j % 3))) for j, i in enumerate(ids))
        rows.append((k, newline.join((mark + x).rstrip() for x in f"Copyright 2020 Someone\n\n{body}\n\ncode".split("\n"))))
    got = {r.doc_id: (r.licenses, r.unmatched, r.sequence) for r in op9.scan(frame(spark, rows)).collect()}
    assert got == {k: (name, 0, op9.rule_pattern(ids)) for k, (name, ids) in enumerate(FULL.items())}


@pytest.mark.parametrize(
    ("text", "licenses", "unmatched"),
    [
        ("/* Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance\n * with the License. You may obtain a copy of the\n * License at:\n *\n *   http\n */", "Apache-2.0", 0),
        ("Licensed under the Apache License, Version 2.0\n(the \"License\").", "Apache-2.0", 0),
        ("Licensed under the Apache License, Version 2. More.", "Apache-2.0", 0),
        ("All\n\nrights reserved.", "", 0),
        ("of all\nrights reserved here", "", 0),
        ("/* All rights\n   reserved. */", "Proprietary", 0),
        ("-" * 200_000 + "x\n" + "# " * 100_000 + "x\n# All rights reserved", "Proprietary", 0),
    ],
)
def test_wrapped_and_commented_sentences(spark, text, licenses, unmatched):
    row = op9.scan(clashing(frame(spark, [(1, text)]))).first()
    assert (row.licenses, row.unmatched) == (licenses, unmatched)


def test_ordered_rules_want_their_order(spark):
    said = {i: s for s, i in op9.SENTENCES.items()}
    grant, notice = said["MITgrant"], said["MITnotice"]
    forward, back = f"{grant}:\n{notice}.", f"{notice}.\n{grant}:"
    got = {r.doc_id: (r.licenses, r.unmatched) for r in op9.scan(frame(spark, [(1, forward), (2, back)])).collect()}
    assert got == {1: ("MIT", 0), 2: ("", 2)}


def test_shards_follow_the_mixture(spark):
    rng = random.Random(8)
    rows = [(k, f"text {k % 50}", "hot" if rng.random() < 0.4 else f"s{k % 9}") for k in range(1003)]
    rows += [(k, "again", None) for k in (5, 5, 5)] + [(None, None, "hot"), (None, None, "hot"), (2000, "", "one")]
    got = op10.interleave(op10.slim(clashing(frame(spark, rows)))).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[2]) for r in rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    hot = Counter(r.shard for r in got if r.source == "hot")
    share = sum(hot.values()) / 16
    assert all(abs(hot[s] - share) <= 2 for s in range(16))
    for r in got:
        if r.doc_id is not None and r.doc_id < 5:
            assert r.text_crc32 == zlib.crc32(f"text {r.doc_id % 50}".encode()) and r["size"] == len(f"text {r.doc_id % 50}") + 1


def order_of(seed, doc_id, crc):
    """Spark's xxhash64 over an int, a long and a long, without its sign bit's weight."""
    import struct

    import xxhash

    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    for v in (doc_id, crc):
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h >> 1


def test_places_follow_the_fractional_ranks(spark):
    rng = random.Random(9)
    rows = [(k, f"text {k % 70}", "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])) for k in range(700)] + [(9, "text 9", "a")] * 3 + [(None, None, "b"), (3, "", "b")]
    slim = [(i, s, zlib.crc32((t or "").encode()), len(t or "") + 1) for i, t, s in rows]
    by_source = {}
    for r in slim:
        by_source.setdefault(r[1], []).append(r)
    placed = []
    for source, some in by_source.items():
        some.sort(key=lambda r: (order_of(17, r[0], r[2]), r[0] is not None, r[0] or 0, r[2], r[3]))
        placed += [((k + 0.5) / len(some), "" if source is None else "=" + source, order_of(17, r[0], r[2]), r[0] is not None, r[0] or 0, r) for k, r in enumerate(some)]
    placed.sort()
    n, want, first = len(placed), [], {}
    for p, (*_, r) in enumerate(placed):
        shard = p * 16 // n
        want.append((*r, shard, p - first.setdefault(shard, p)))
    for buckets in (None, 1 << 12):
        got = [(r.doc_id, r.source, r.text_crc32, r["size"], r.shard, r.slot) for r in op10.interleave(op10.slim(frame(spark, [(*r,) for r in rows])), buckets=buckets).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_shards_are_shuffled_and_repeatable(spark):
    rows = [(k, str(k), "s") for k in range(200)]
    place = lambda seed: {r.doc_id: (r.shard, r.slot) for r in op10.interleave(op10.slim(frame(spark, rows).repartition(7)), 4, seed).collect()}
    assert place(1) == place(1) != place(2)
    assert sorted(place(1), key=place(1).get) != list(range(200))


def test_written_shards(spark, tmp_path):
    op10.write_shards(frame(spark, [(k, str(k), f"s{k % 3}") for k in range(100)]), str(tmp_path / "x"), 4)
    back = spark.read.parquet(str(tmp_path / "x"))
    assert back.count() == 100 and back.groupBy("shard").agg(F.count("*").alias("n")).where("n <> 25").count() == 0
    odd = clashing(frame(spark, [(k, str(k), f"s{k % 3}") for k in range(20)]))
    op10.write_shards(odd, str(tmp_path / "y"), 4)
    back = spark.read.parquet(str(tmp_path / "y"))
    assert set(back.columns) == set(odd.columns) and {r["size"] for r in back.collect()} == {"x"} and back.where("shard between 0 and 3").count() == 20
