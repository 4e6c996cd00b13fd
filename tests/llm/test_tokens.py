"""Operators 1 and 6: round trips through files, and brute-force encoding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, best_fit_decreasing, clashing, frame, rows_of

from tiergraph.llm import op01_orc_tokens as op1
from tiergraph.llm import op06_best_fit as op6
from tiergraph.llm import queries as Q
from tiergraph.llm.common import scratch_path
from tiergraph.llm.tokens import WordTokenizer

PATH = Q.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("limit", [900_000, 5])
def test_memo_gives_the_library_ids(library, limit):
    texts = [t for _, t in ODD] + ["The THE the, the. the!!! (the) the's THE'LL it's", "<|ENDOFTEXT|> <|endoftext|>x <|startoftext|>.", "a\x01b \x01 c", "tab\tnew\r\nline", "...!!! ,,, 12.5 3rd", "É è Ê ß ſ İi İ Ǆ ǅ"]
    coder = WordTokenizer(PATH, limit, limit)
    got = [ids[a:b].tolist() for ids, at in coder.encode(pa.array(texts, pa.string())) for a, b in zip(at[:-1], at[1:])]
    assert got == [ids_of(library, t) for t in texts]


def test_orc_round_trip(spark, library):
    docs = clashing(frame(spark, ODD))
    path = scratch_path(spark, "t1")
    op1.write_tokens(docs, path, PATH, 1)
    got = rows_of(op1.token_digest(spark, path).orderBy("start"))
    want, start = [], 0
    # one id of these rows repeats, with one text
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(library, t), 1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    some = rows_of(op1.read_tokens(spark, path, [8]).select("doc_id", "ids"))
    assert some == [(8, [*ids_of(library, "many words " * 3000), 1])]


def test_orc_metadata_prunes(spark, sf):
    import glob

    import pyarrow.orc as orc

    path = scratch_path(spark, "t2")
    op1.write_tokens(Q.table(spark, sf, "documents"), path, PATH)
    files = sorted(glob.glob(f"{path}/part-*.orc"))
    last = -1
    for f in files:
        ids = orc.ORCFile(f).read(columns=["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
    plan = op1.read_tokens(spark, path, [5])._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)], ReadSchema" in plan


def test_orc_files_hold_what_the_method_names(spark, sf):
    """Stripes, row indexes, run-length version 2 and Bloom filters as the files' own footers and indexes say."""
    import glob

    path = scratch_path(spark, "t5")
    op1.write_tokens(Q.table(spark, sf, "documents"), path, PATH, stripe_bytes=64 << 10, index_rows=1000)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    orc = jvm.org.apache.orc
    stripes = 0
    for f in glob.glob(f"{path}/part-*.orc"):
        reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), orc.OrcFile.readerOptions(conf))
        names = list(reader.getSchema().getFieldNames())
        doc, ids = names.index("doc_id") + 1, len(names) + 1  # the root is column 0, an array's items follow it
        assert reader.getRowIndexStride() == 1000
        rows = reader.rows()
        for k in range(reader.getStripes().size()):
            stripes += 1
            stripe = reader.getStripes().get(k)
            footer = rows.readStripeFooter(stripe)
            assert footer.getColumnsList().get(doc).getKind().toString() == "DIRECT_V2" == footer.getColumnsList().get(ids).getKind().toString()
            kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
            assert (doc, "BLOOM_FILTER_UTF8") in kinds and (doc, "ROW_INDEX") in kinds and (ids, "BLOOM_FILTER_UTF8") not in kinds
        rows.close()
    assert stripes > 0


def test_a_repeated_id_is_dealt_over_files(spark, library):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(5, f"text number {k} with its own words") for k in range(400)] + [(None, f"no id {k}") for k in range(400)] + [(k, "other") for k in range(50)]
    path = scratch_path(spark, "t6")
    op1.write_tokens(frame(spark, rows), path, PATH)
    sizes = [r["count"] for r in op1.read_tokens(spark, path).groupBy("part").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == len(rows) and max(sizes) < 400
    got = rows_of(op1.token_digest(spark, path).orderBy("start"))
    ends = [s + n for _, s, n, _ in got]
    assert [s for _, s, _, _ in got] == [0, *ends[:-1]]
    keys = [(i is not None, i or 0) for i, _, _, _ in got]
    assert keys == sorted(keys)


def test_orc_of_an_empty_table(spark):
    path = scratch_path(spark, "t3")
    op1.write_tokens(frame(spark, []), path, PATH)
    assert rows_of(op1.token_digest(spark, path)) == []


def test_planner_is_best_fit():
    rng = random.Random(3)
    for capacity in (1, 7, 40, 2048):
        for _ in range(40):
            lengths = [min(capacity, 1 + int(rng.expovariate(6 / capacity))) for _ in range(rng.randrange(300))]
            counts = {n: lengths.count(n) for n in set(lengths)}
            places, seen = {}, set()
            for n, lo, hi, first, per, offset in op6.plan_best_fit(counts, capacity):
                for r in range(lo, hi):
                    assert (n, r) not in seen
                    seen.add((n, r))
                    places.setdefault(first + (r - lo) // per, []).append((offset + (r - lo) % per * n, n))
            assert len(seen) == len(lengths)
            for v in places.values():
                at = 0
                for o, n in sorted(v):
                    assert o == at
                    at += n
                assert at <= capacity
            assert len(places) == best_fit_decreasing(lengths, capacity)


def check_packing(rows, docs, library, capacity, end):
    want = []
    for i, t in docs:
        ids, at = [*ids_of(library, t), end], 0
        for k in range(0, len(ids), capacity):
            want.append((i, k // capacity, k, len(ids[k : k + capacity]), crc(ids[k : k + capacity])))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((r[:5] for r in rows), key=key) == sorted(want, key=key)
    places = {}
    for r in rows:
        places.setdefault(r[5], []).append((r[6], r[3]))
    for v in places.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    assert len(places) == best_fit_decreasing([r[3] for r in rows], capacity)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, library, capacity):
    path = scratch_path(spark, "t6")
    out = op6.pack(clashing(frame(spark, ODD)), path, PATH, capacity, 0)
    rows = rows_of(out)
    check_packing(rows, ODD, library, capacity, 0)
    total = sum(len(ids_of(library, t)) + 1 for _, t in ODD)
    packed = rows_of(op6.sequences(spark, path, out))
    assert sum(len(ids) for _, ids in packed) == total and max(len(ids) for _, ids in packed) <= capacity


def test_packing_of_an_empty_table(spark):
    assert rows_of(op6.pack(frame(spark, []), scratch_path(spark, "t7"), PATH)) == []


def test_packing_of_documents(spark, sf, library):
    docs = [(r.doc_id, r.text) for r in Q.table(spark, sf, "documents").collect()]
    check_packing(rows_of(Q.op6_best_fit(spark, sf)), docs, library, 2048, 0)
