"""Operators 5 and 8 against brute force."""

import random

import numpy as np
from helpers import ODD, clashing, components_brute, dedup_brute, frame, rows_of, simhash_brute
from hypothesis import given, settings
from hypothesis import strategies as st

from tiergraph.llm import common
from tiergraph.llm import op05_simhash_pivots as op5
from tiergraph.llm import op08_line_dedup as op8
from tiergraph.llm import queries as Q


def test_fingerprints(spark):
    rows = [(k, t) for k, (_, t) in enumerate(ODD)]
    got = {i: fp & (1 << 64) - 1 for i, fp in rows_of(op5.fingerprints(clashing(frame(spark, rows))))}
    assert got == {k: simhash_brute(t) for k, t in rows}


def near_copies(rng, n):
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(4)]
    out = []
    for k in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((k, " ".join(t)))
    return out + [(n + k, " ".join(rng.choice(words) for _ in range(60))) for k in range(20)]


def test_components(spark):
    rows = near_copies(random.Random(5), 120) + [(300 + k, t) for k, (_, t) in enumerate(ODD)]
    got = {i: c for i, _, c in rows_of(op5.near_duplicates(frame(spark, rows)))}
    want = components_brute([i for i, _ in rows], [simhash_brute(t) for _, t in rows])
    assert got == {i: c for (i, _), c in zip(rows, want)}


def test_null_and_repeated_ids(spark):
    rows = [(None, "alpha beta gamma delta epsilon"), (4, "alpha beta gamma delta epsilon"), (4, "alpha beta gamma delta epsilon"), (None, None)]
    got = sorted(rows_of(op5.near_duplicates(frame(spark, rows)).select("doc_id", "component_id")), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None)], key=str)
    kept = rows_of(op5.keep_one(clashing(frame(spark, rows))).select("doc_id", "text"))
    assert sorted(kept, key=str) == sorted([(4, rows[1][1]), (None, None)], key=str)


def test_one_row_of_each_component_stays(spark):
    one, other, third = ("alpha beta gamma delta epsilon", "quite another text with other words", "a third text that is no copy of them")
    rows = [(9, one), (9, other), (9, third), (2, other), (2, other), *[(None, "no id but many copies of it")] * 5, (None, ""), (None, "")]
    kept = rows_of(op5.keep_one(clashing(frame(spark, rows))).select("doc_id", "text"))
    assert sorted(kept, key=str) == sorted([(9, one), (9, third), (2, other), (None, rows[5][1]), (None, "")], key=str)


def test_pivot_table_holds_distances(spark):
    fps = [0, -1, 5, 1 << 62, -(1 << 63), 123456789]
    rows = op5.pivot_table(spark.createDataFrame([(f, k) for f in fps for k in (7, 3)], "fp long, doc_id long")).collect()
    assert len(rows) == len(fps)
    for r in rows:
        got = np.array([r.d0, r.d1], np.int64).view(np.int8).tolist()
        assert r.first == 3 and got == [bin((r.fp & (1 << 64) - 1) ^ p).count("1") for p in op5.pivots()]


def jaccard_brute(rows, shingle=5, similarity=0.8):
    """The rows that stay: the first of each component of the graph of all similar pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9 > 0:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [r for k, r in enumerate(rows) if find(k) == k]


def edited(rng, n, edits):
    words = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(12)]
    out = []
    for k in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(edits)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((k, " ".join(t)))
    return out


def test_similar_texts_are_found(spark):
    rows = edited(random.Random(3), 150, 7) + [(500 + k, t) for k, (_, t) in enumerate(ODD)]
    kept = sorted(rows_of(op5.keep_one(clashing(frame(spark, rows))).select("doc_id", "text")))
    want = jaccard_brute(rows)
    assert {r for r in want} <= set(kept) and len(kept) <= 1.1 * len(want) < len(rows)


def hardly_similar(rng, n):
    """n pairs of texts whose similarity is hardly more than 0.8, and n whose is hardly less."""
    words = [f"v{k}" for k in range(5000)]
    out = []
    for k in range(2 * n):
        t = [rng.choice(words) for _ in range(94)]  # 90 shingles, 10 of them lost at the end: 80 of 100
        out += [(2 * k, " ".join(t)), (2 * k + 1, " ".join(t[:84] + [rng.choice(words) for _ in range(10 if k < n else 11)]))]
    return out


def test_no_pair_at_the_threshold_is_missed(spark):
    rows = hardly_similar(random.Random(8), 60)
    want = jaccard_brute(rows)
    assert len(want) == len(rows) - 60
    assert sorted(rows_of(op5.keep_one(frame(spark, rows)).select("doc_id", "text"))) == want


def test_no_link_is_missed_among_frequent_shingles(spark):
    rng = random.Random(9)
    often = [" ".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(5)]
    rows = edited(rng, 150, 12)
    for k in range(150):  # short texts of frequent passages, alike and not
        rows.append((200 + k, " ".join([rng.choice(often) for _ in range(rng.randrange(1, 4))] + [f"u{rng.randrange(40)}" for _ in range(rng.randrange(5))])))
    want = [i for i, _ in jaccard_brute(rows)]
    for most, crowd in ((op5.WIDE_ROWS, op5.CROWD), (6, 3)):
        nodes, found = op5.similar(frame(spark, rows), most=most, crowd=crowd)
        first = {r.key: r.first for r in nodes.select("key", "first").collect()}
        root = {i: i for i in first.values()}

        def find(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in found.collect():
            x, y = find(first[a]), find(first[b])
            root[max(x, y)] = min(x, y)
        assert sorted(i for i in root if root[i] == i) == want
        assert sorted(i for (i,) in rows_of(op5.keep_one(frame(spark, rows)).select("doc_id"))) == want


def test_first_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    late = np.unique(rng.integers(0, 60, 20).astype(np.uint64))
    for _ in range(2000):
        x, y = (np.unique(rng.choice(60, rng.integers(1, 50), replace=False).astype(np.uint64)) for _ in range(2))
        y = y if rng.random() < 0.3 else np.union1d(x[rng.random(len(x)) < 0.9], y[:2])
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) - 1e-9:
            for last in (late, late[:0]):
                assert set(op5.first_shingles(x, 0.8, last).tolist()) & set(op5.first_shingles(y, 0.8, last).tolist())
            differ = int(np.bitwise_count(op5.parity_bits(x) ^ op5.parity_bits(y)).sum())
            assert differ <= len(np.setxor1d(x, y))


def test_crowded_wide_buckets(spark):
    rows = edited(random.Random(4), 120, 4)
    nodes = op5.cut_lineage(op5.wide_prints(frame(spark, rows), 5, op5.row_key())).dropDuplicates(op5.WIDE_NAMES)
    sides = []
    for most in (1 << 20, 6):
        root = {tuple(r[w] for w in op5.WIDE_NAMES): k for k, r in enumerate(nodes.collect())}
        group = {k: {k} for k in root.values()}
        for a, b in op5.wide_links(nodes, 0.8, most).collect():
            x, y = group[root[tuple(a)]], group[root[tuple(b)]]
            if x is not y:
                x |= y
                for k in y:
                    group[k] = x
        sides.append(len({id(g) for g in group.values()}))
    assert sides[0] <= 12 and sides[1] <= 1.25 * sides[0]


def test_empty(spark):
    assert rows_of(op5.near_duplicates(frame(spark, []))) == []
    assert rows_of(op5.keep_one(frame(spark, []))) == []
    assert rows_of(op8.dedup_lines(frame(spark, []))) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 60))
def test_forest_connects_what_links_connect(seed, n):
    rng = np.random.default_rng(seed)
    fps = np.zeros(n, np.uint64)
    fps[0] = rng.integers(0, 1 << 63)
    for k in range(1, n):  # chains of close fingerprints
        flips = rng.choice(64, rng.integers(1, 9), replace=False)
        fps[k] = fps[rng.integers(0, k)] ^ np.uint64(sum(1 << int(b) for b in flips))
    fps = np.unique(fps)
    table = np.bitwise_count(fps[:, None] ^ np.array(op5.pivots(), np.uint64)[None, :]).astype(np.int8)
    edges = op5.forest(fps, table, 4)
    assert len(edges) < len(fps)
    root = {k: k for k in range(len(fps))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        root[find(a)] = find(b)
    want = components_brute(list(range(len(fps))), [int(f) for f in fps])
    groups = {}
    for k in range(len(fps)):
        groups.setdefault(find(k), []).append(k)
    assert [min(groups[find(k)]) for k in range(len(fps))] == want


def test_crowded_buckets_are_dealt_again(spark):
    rng = np.random.default_rng(3)
    fps = [int(rng.integers(0, 1 << 63))]
    for k in range(250):  # one large cluster, and others beside it
        flips = rng.choice(64, rng.integers(1, 7), replace=False)
        fps.append(fps[0 if k % 3 else rng.integers(0, len(fps))] ^ sum(1 << int(b) for b in flips))
    fps = sorted({f - (1 << 64) if f >= 1 << 63 else f for f in fps} | {0, -1, 15, -16})
    nodes = op5.pivot_table(spark.createDataFrame([(f, k if k % 5 else None) for k, f in enumerate(fps)], "fp long, doc_id long"))
    edges = [(e.a.n0, e.b.n0) for e in op5.links(nodes, bucket_rows=24).collect()]
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = components_brute(fps, [f & (1 << 64) - 1 for f in fps])
    assert [find(f) for f in fps] == want


def test_a_chain_becomes_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = dict(rows_of(op5.components(edges)))
    assert got == {**{k: 0 for k in range(1, 201)}, 1001: 1000}


def guess_bits(df):
    """Binary digits of Spark's guess of a frame's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()


def test_size_guesses_and_plans_stay_short_over_rounds(spark):
    # a guess is a product over joins: kept over rounds, its digits double each time and fill the driver's memory
    rng = np.random.default_rng(3)
    path = rng.permutation(400).tolist()
    edges = spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")
    roots = op5.components(edges)
    assert guess_bits(roots) < 200 and {r.root for r in roots.collect()} == {0}
    rows = [(i, f"words that all texts begin with in one way {i // 4} {i} and some more {i % 7}") for i in range(60)]
    nodes = spark.createDataFrame([(key, i, i, 12, *([0] * 4), []) for i, key in enumerate(keys_of(spark, rows))], f"key string, id long, group long, size long, {', '.join(p + ' long' for p in op5.PARITY_NAMES)}, begin array<long>")
    begin = op5.shingle_sets(frame(spark, rows).withColumn("key", op5.row_key()), 5, "key", lambda h: op5.first_shingles(h, 0.1, h[:0]))
    nodes = nodes.drop("begin").join(begin.withColumnRenamed("shingles", "begin"), "key")
    now, tokens = op5.ordered(frame(spark, rows), op5.cut_lineage(nodes), 5, 0.1, 20)
    assert "Join" not in now._jdf.queryExecution().optimizedPlan().toString()
    assert guess_bits(now) < 200 and guess_bits(tokens) < 200


def test_frequent_shingles_come_last_at_once(spark):
    passage = "a passage that very many of the texts hold"
    rows = [(i, f"{passage} " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(80)] + [(100 + i, "one text in many copies") for i in range(50)]
    late = op5.frequent(frame(spark, rows), 5, 40, one_of=1)
    assert late.tolist() == np.unique(op5.shingle_hashes(passage.encode(), 5)).tolist()
    nodes = op5.wide_prints(frame(spark, rows).where("doc_id < 80"), 5, op5.row_key(), 0.8, late)
    counts = nodes.selectExpr("explode(begin) as token").groupBy("token").count()
    assert counts.agg({"count": "max"}).first()[0] == 1
    assert sorted(i for (i,) in rows_of(op5.keep_one(frame(spark, rows)).select("doc_id"))) == list(range(80)) + [100]


def keys_of(spark, rows):
    return [k for _, k in sorted(rows_of(frame(spark, rows).select("doc_id", op5.row_key())))]


def test_whole_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in Q.table(spark, sf, "documents").collect()]
    got = {i: (f, c) for i, f, c in rows_of(Q.op5_simhash_pivots(spark, sf))}
    fps = [simhash_brute(t) for _, t in docs]
    want = components_brute([i for i, _ in docs], fps)
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, want)}


def check_lines(spark, rows, least=16):
    df = clashing(frame(spark, rows))
    out = op8.dedup_lines(df, least)
    assert set(out.columns) == {*df.columns, "n_lines", "n_exact", "n_near"}
    got = rows_of(out.select("doc_id", "n_exact", "n_near", "text"))
    want = [(d[0], *w) for d, w in zip(rows, dedup_brute(rows, least))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lines_of_odd_documents(spark):
    check_lines(spark, ODD)


def test_lines_within_one_edit(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.choice([8, 9, 20, 21]))) for _ in range(25)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(4):
            s = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                at, how = rng.randrange(len(s)), rng.randrange(3)
                if how == 0:
                    s[at] = rng.choice("abcde")
                elif how == 1:
                    del s[at]
                else:
                    s.insert(at, rng.choice("abcde"))
            lines.append("".join(s))
        rows.append((rng.choice([k, k, None]) if k % 10 == 0 else k, "\n".join(lines)))
    check_lines(spark, rows, 8)


def test_both_join_ways_agree(spark, monkeypatch):
    rows = [(k, f"line number {k % 7} of the page\nthe same line in all\nalone {k * k} here it is") for k in range(40)]
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    check_lines(spark, rows)
