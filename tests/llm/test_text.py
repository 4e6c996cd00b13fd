"""Operators 2, 3 and 4."""

import random

import numpy as np
import pytest
from helpers import ODD, clashing, frame, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from tiergraph.llm import common
from tiergraph.llm import op02_string_tiling as op2
from tiergraph.llm import op03_warc_fixity as op3
from tiergraph.llm import op04_nb_svm as op4
from tiergraph.llm import queries as Q
from tiergraph.llm.common import scratch_path


def tile_brute(p, t, least):
    """Greedy string tiling by trying every pair of places."""
    fp, ft, covered = [True] * len(p), [True] * len(t), 0
    while True:
        best = []
        longest = least
        for a in range(len(p)):
            for b in range(len(t)):
                k = 0
                while a + k < len(p) and b + k < len(t) and p[a + k] == t[b + k] >= 0 and fp[a + k] and ft[b + k]:
                    k += 1
                if k > longest:
                    best, longest = [(a, b)], k
                elif k == longest:
                    best.append((a, b))
        if not best:
            return covered
        for a, b in best:
            if all(fp[a : a + longest]) and all(ft[b : b + longest]):
                fp[a : a + longest] = [False] * longest
                ft[b : b + longest] = [False] * longest
                covered += longest


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(-1, 3), max_size=40), st.integers(2, 5))
def test_tiles_are_tiles(p, t, least):
    tiles = op2.tile(p, t, least)
    seen_p, seen_t = set(), set()
    for a, b, n in tiles:
        assert n >= least and p[a : a + n] == t[b : b + n] and min(p[a : a + n]) >= 0
        assert not seen_p & set(range(a, a + n)) and not seen_t & set(range(b, b + n))
        seen_p |= set(range(a, a + n))
        seen_t |= set(range(b, b + n))
    # nothing of that length is left, and ties apart as much is covered as by trying all pairs
    fp, ft = [k not in seen_p for k in range(len(p))], [k not in seen_t for k in range(len(t))]
    for a in range(len(p) - least + 1):
        for b in range(len(t) - least + 1):
            if all(fp[a : a + least]) and all(ft[b : b + least]) and min(t[b : b + least]) >= 0:
                assert p[a : a + least] != t[b : b + least]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_coverage_of_moved_passages(seed):
    rng = random.Random(seed)
    p = list(range(30))
    cut = sorted(rng.sample(range(6, 25), 2))
    parts = [p[: cut[0]], p[cut[0] : cut[1]], p[cut[1] :]]
    rng.shuffle(parts)
    t = [100 + k for k in range(5)] + [x for q in parts for x in [*q, 999]]
    assert sum(n for _, _, n in op2.tile(p, t, 5)) == tile_brute(p, t, 5)


ITEM = "what is the name of the river that flows through the old town of the northern province and into the cold sea"


def bench(spark, rows):
    return clashing(spark.createDataFrame(rows, "item_id long, text string"))


def test_contaminated_documents(spark):
    w = ITEM.split()
    filler = " ".join(f"word{k}" for k in range(60))
    docs = [
        (101, f"{filler} {ITEM.upper()}! {filler}"),
        (102, f"{filler} {' '.join(w[11:])} {filler} {' '.join(w[:11])}"),  # the halves in the other order
        (3, f"{filler} {' '.join(w[:10])} {filler}"),  # under four fifths
        (4, " ".join(reversed(w))),
        (5, filler),
        *[(i, t) for i, t in ODD],
    ]
    items = bench(spark, [(10, ITEM), (11, None), (12, ""), (13, "too short"), (10, ITEM)])
    got = rows_of(op2.find(clashing(frame(spark, docs)), items).select("doc_id", "item_id", "words_covered"))
    assert sorted(set(got)) == [(101, 10, len(w)), (102, 10, len(w))]
    small = rows_of(op2.find(frame(spark, docs), items, block_words=3).select("doc_id", "item_id", "words_covered"))
    assert sorted(small) == sorted(got)
    left = op2.clean(clashing(frame(spark, docs)), items)
    assert {r.doc_id for r in left.collect()} == {d[0] for d in docs} - {101, 102}
    assert left.count() == len(docs) - 2


def test_no_benchmark_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(op2.find(frame(spark, ODD), none)) == [] and op2.clean(frame(spark, ODD), none).count() == len(ODD)
    assert rows_of(op2.find(frame(spark, []), bench(spark, [(1, ITEM)]))) == []


def test_every_held_item_is_found(spark, sf):
    docs, items = Q.table(spark, sf, "documents").collect(), Q.table(spark, sf, "benchmark").collect()
    plain = {(d.doc_id, i.item_id) for d in docs for i in items if " ".join(op2.words_of(i.text)) in " ".join(op2.words_of(d.text))}
    got = {(r.doc_id, r.item_id) for r in Q.op2_string_tiling(spark, sf).collect()}
    assert plain and plain <= got
    # and no others: by all pairs of documents and items that share a run of five words
    texts, marks = {d.doc_id: op2.words_of(d.text) for d in docs}, {i.item_id: op2.words_of(i.text) for i in items}
    runs = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    of_items = {i: runs(w) for i, w in marks.items()}
    want = set()
    for d, words in texts.items():
        own = runs(words)
        for i, w in marks.items():
            shared = own & of_items[i]
            # what no shared run covers is in no tile
            if shared and sum(any(tuple(w[j : j + 5]) in shared for j in range(max(0, k - 4), k + 1)) for k in range(len(w))) >= 0.8 * len(w):
                number = {x: k for k, x in enumerate(dict.fromkeys(w))}
                near = [any(tuple(words[j : j + 5]) in shared for j in range(max(0, k - 4), k + 1)) for k in range(len(words))]
                text = [number.get(x, -1) if n else -1 for x, n in zip(words, near)]
                kept = [x for k, x in enumerate(text) if x >= 0 or (k and text[k - 1] >= 0)]
                if tile_brute([number[x] for x in w], kept, 5) >= 0.8 * len(w):
                    want.add((d, i))
    assert got == want


def pages(spark, rows):
    return clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))


PAGES = [(k, f"http://h/{k}", f"<p>page {k}</p>\r\n\r\nWARC/1.1 ü" * (k % 4)) for k in range(90)] + [(7, None, None), (7, "http://h/7", "again"), (None, "x\r\ny", "no id"), (None, None, None)]


def audit(spark, rows, spoil=None, per_file=32):
    df, path = pages(spark, rows), scratch_path(spark, "w")
    op3.write_warc(df, path, per_file)
    if spoil:
        spoil(path)
    return op3.audit(op3.leaves(df, per_file), op3.read_warc(spark, path), per_file)


def test_warc_round_trip(spark):
    rows = audit(spark, PAGES).collect()
    assert len(rows) == len(PAGES) and {r.status for r in rows} == {"ok"}
    assert all(r.root == r.other_root and r.replica == r.other_replica for r in rows)


@pytest.mark.parametrize("bound", [common.BROADCAST_BYTES, -1])
def test_ids_that_many_rows_repeat_are_split(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    rows = PAGES + [(5, "http://same", "copy")] * 100 + [(5, f"http://other/{k}", "body") for k in range(80)] + [(None, "a", "b")] * 70
    got = audit(spark, rows).collect()
    assert len(got) == len(rows) and {r.status for r in got} == {"ok"}
    sizes = __import__("collections").Counter(r.file for r in got)
    assert max(sizes.values()) <= 2 * 32  # files hold contents by hash
    want = __import__("collections").Counter(i for i, _, _ in rows)
    assert __import__("collections").Counter(r.page_id for r in got) == want
    places = sorted((r.file, r.ordinal, r.offset, r.length) for r in got)
    for (f, k, a, n), (g, j, b, _) in zip(places, places[1:]):
        assert (j, b) == (k + 1, a + n) if f == g else (j, b) == (0, 0)


def spoiled(how):
    import glob
    import gzip

    def run(path):
        f = glob.glob(f"{path}/file=1/part-*")[0]
        data = gzip.decompress(open(f, "rb").read())
        open(f, "wb").write(gzip.compress(how(data)))
        for crc in glob.glob(f"{path}/file=1/.*.crc"):
            __import__("os").remove(crc)

    return run


def test_corruption_is_located(spark):
    rows = audit(spark, PAGES, spoiled(lambda d: d.replace(b"page 41<", b"pagE 41<"))).collect()
    assert [(r.page_id, r.status) for r in rows if r.status != "ok"] == [(41, "corrupt")]
    assert {r.file for r in rows if r.root != r.other_root} == {1}


def test_a_lost_tail_is_missing(spark):
    rows = audit(spark, PAGES, spoiled(lambda d: d[: d.index(b"<urn:page:60>") - 80])).collect()
    lost = {r.page_id for r in rows if r.status == "missing"}
    assert lost and lost <= {60, 61, 62, 63} and {r.status for r in rows} <= {"ok", "missing", "corrupt"}


def member_cut(start, stop):
    """Takes the stored members of records start to stop out of file 1."""
    import glob

    def run(path):
        f = glob.glob(f"{path}/file=1/part-*")[0]
        data = open(f, "rb").read()
        heads, at = [], data.find(op3.HEAD)
        while at >= 0:
            heads.append(at)
            at = data.find(op3.HEAD, at + 1)
        open(f, "wb").write(data[: heads[start]] + data[heads[stop] :])
        for crc in glob.glob(f"{path}/file=1/.*.crc"):
            __import__("os").remove(crc)

    return run


def test_a_lost_record_in_the_middle_is_named_alone(spark):
    rows = audit(spark, PAGES, member_cut(9, 10)).collect()
    assert [(r.page_id, r.status) for r in rows if r.status not in ("ok", "moved")] == [(41, "missing")]
    assert {r.page_id for r in rows if r.status == "moved"} <= set(range(42, 64)) and {r.file for r in rows if r.status == "moved"} == {1}
    assert len(rows) == len(PAGES) and len({r.replica for r in rows}) == 1 and all(r.replica != r.other_replica for r in rows)


def test_leaves_are_matched_by_digest_then_id_then_place():
    mine = [(1, 0, 0, 0, 5, "a"), (2, 0, 1, 5, 5, "b"), (3, 0, 2, 10, 5, "c"), (4, 0, 3, 15, 5, "d"), (None, 0, 4, 20, 5, "e")]
    other = [(2, 0, 0, 0, 5, "b"), (3, 0, 1, 5, 5, "x"), (None, 0, 3, 15, 5, "y"), (9, 0, 7, 30, 5, "z")]
    got = {(r[0], r[5]): r[6] for r in op3.matched(mine, other)}
    assert got == {(1, "a"): "missing", (2, "b"): "moved", (3, "c"): "corrupt", (4, "d"): "corrupt", (None, "e"): "missing", (9, "z"): "extra"}


def test_only_bad_branches_are_looked_at(spark):
    a = op3.leaves(pages(spark, PAGES), 32)
    bad = op3.differing(op3.levels(a, 32), op3.levels(a.withColumn("digest", __import__("pyspark").sql.functions.expr("if(page_id = 50, 'x', digest)")), 32))
    assert rows_of(bad) == [(1, 18)]


def test_no_pages(spark):
    assert audit(spark, []).collect() == []


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 12))) for _ in range(60)]
    y = rng.integers(0, 2, 60)
    cost = np.where(y == 1, 0.7, 1.9)
    ratios = op4.log_count_ratios(rows, y)
    w, b = op4.dual_coordinate_descent(rows, ratios, y, cost, rounds=5000, tolerance=1e-9)
    x = np.zeros((60, 41))
    for k, r in enumerate(rows):
        x[k, r] = ratios[r] / max(1.0, len(r) ** 0.5)
    x[:, 40] = 1.0
    sign = np.where(y == 1, 1.0, -1.0)
    # plain gradient descent on the primal
    v = np.zeros(41)
    for _ in range(60_000):
        short = np.maximum(0.0, 1.0 - sign * (x @ v))
        v -= 2e-3 * (v - 2.0 * (x * (cost * sign * short)[:, None]).sum(axis=0))
    assert np.abs(np.append(w[:40], b) - v).max() < 1e-3
    # the duality gap
    short = np.maximum(0.0, 1.0 - sign * (x @ v))
    alpha = 2 * cost * short
    primal = 0.5 * (v @ v) + (cost * short**2).sum()
    dual = alpha.sum() - 0.5 * ((x * (alpha * sign)[:, None]).sum(axis=0) ** 2).sum() - (alpha**2 / (4 * cost)).sum()
    assert abs(primal - dual) < 1e-3 * primal


def test_ratios_are_of_counts():
    rows = [np.array([1, 2]), np.array([1, 3]), np.array([1, 2]), np.array([2])]
    got = op4.log_count_ratios(rows, np.array([1, 1, 0, 0]))
    assert np.isclose(got[1], np.log(3 / 4) - np.log(2 / 4)) and np.isclose(got[2], np.log(2 / 4) - np.log(3 / 4)) and got[3] == 0 and got[9] == 0


def test_the_sample_is_bounded_in_bytes_and_one_row_an_id(spark):
    rows = [(k % 9, f"some words of row {k} " * (1 + k % 4)) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, quality int")
    taken = op4.training_sample(frame(spark, rows), labels).collect()
    assert len(taken) == len({r.doc_id for r in taken}) and all(r.text == min(t for i, t in rows if i == r.doc_id) for r in taken)
    assert op4.train(frame(spark, rows), labels, sample_bytes=0).slope == 0.0  # one row, one class


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.op4_nb_svm(spark, sf).join(Q.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    auc = np.mean([[g > b for b in bad] for g in good])
    assert auc >= 0.97 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_training_leaves_held_out_rows_alone(spark, sf):
    import zlib

    some = op4.training_sample(Q.table(spark, sf, "documents"), Q.table(spark, sf, "labels"), 25).collect()
    assert len(some) == 25 and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in some)


@pytest.mark.parametrize("labels", [[], [(4, 1), (5, 1)], [(4, None), (None, 1)]])
def test_labels_of_one_class_or_none(spark, labels):
    model = op4.train(frame(spark, ODD), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = op4.score(clashing(frame(spark, ODD)), model).collect()
    assert len(got) == len(ODD) and {r[-2] for r in got} == {0.5}


def test_odd_documents_are_scored(spark):
    good = [(100 + k, " ".join(f"plain{k}word{j} here." for j in range(30))) for k in range(40)]
    bad = [(200 + k, " ".join(f"LOUD{j}!!" for j in range(30))) for k in range(40)]
    docs = clashing(frame(spark, good + bad + ODD))
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(bad[0][0], 1), (999, 0)], "doc_id long, quality int")
    model = op4.train(docs, labels)
    got = op4.score(docs, model, keep=docs.columns).collect()
    assert len(got) == len(good + bad + ODD) and all(0 <= r[-2] <= 1 for r in got)
    by = {r.doc_id: r[-2] for r in got}
    assert min(by[i] for i, _ in good) > max(by[i] for i, _ in bad)
    assert op4.score(frame(spark, []), model).collect() == []


def test_damage_to_stored_bytes_is_located(spark):
    """No unpacking here: bits of the file as it lies on disk."""
    import glob

    def run(path):
        f = glob.glob(f"{path}/file=1/part-*")[0]
        data = bytearray(open(f, "rb").read())
        data[len(data) // 2] ^= 4
        open(f, "wb").write(data)
        for crc in glob.glob(f"{path}/file=1/.*.crc"):
            __import__("os").remove(crc)

    rows = audit(spark, PAGES, run).collect()
    assert [(r.file, r.status) for r in rows if r.status != "ok"] == [(1, "corrupt")]
    assert len(rows) == len(PAGES) and {r.file for r in rows if r.root != r.other_root} == {1}


def test_any_flipped_bit_spoils_one_record():
    import gzip

    plain = [f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: {n}\r\n\r\n{'ab c' * (n // 4)}\r\n\r\n".encode() for k, n in enumerate((40, 0, 400, 80))]
    data = b"".join(map(op3.member, plain))
    sound = list(op3.parse(data))
    assert gzip.decompress(data) == b"".join(plain) and sound == list(op3.parse(b"".join(plain))) and [r[0] for r in sound] == [0, 1, 2, 3]
    ends = np.cumsum([len(op3.member(p)) for p in plain])
    unseen = []
    for bit in range(8 * len(data)):
        bad = bytearray(data)
        bad[bit // 8] ^= 1 << bit % 8
        got = list(op3.parse(bytes(bad)))
        if got == sound:
            unseen.append(bit // 8)
            continue
        hit = int(np.searchsorted(ends, bit // 8, side="right"))
        assert [k for k, (a, b) in enumerate(zip(sound, got, strict=True)) if a[3] != b[3]] == [hit], bit
    # bits that only fill up the last byte before a member's 8 bytes of checks hold nothing
    assert set(unseen) <= set((ends - 9).tolist()) and len(unseen) <= 7 * len(plain)
    for cut in range(1, len(data)):
        got = list(op3.parse(data[:cut]))
        sound_ones = int((ends <= cut).sum())
        assert [r[3] for r in got[:sound_ones]] == [r[3] for r in sound[:sound_ones]] and not {r[3] for r in got[sound_ones:]} & {r[3] for r in sound}
    big = op3.member(b"x" * (1 << 24))
    assert big[-1] == 0 and gzip.decompress(big) == b"x" * (1 << 24)
