"""The pipeline against a plain version of each stage on its own input."""

import corpus_pipeline as P
import numpy as np
from helpers import clashing, dedup_brute, frame, rows_of
from test_dedup import jaccard_brute
from test_tokens import check_packing

from tiergraph.llm import op02_string_tiling as op2
from tiergraph.llm import op04_nb_svm as op4
from tiergraph.llm import queries as Q


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]


def test_pipeline(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(Q.tokenizer_path())
    docs = Q.table(spark, sf, "documents")
    model = op4.train(docs, Q.table(spark, sf, "labels"))
    items = op2.Index([(r.item_id, r.text) for r in Q.table(spark, sf, "benchmark").collect()], 5)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    steps = []
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps.append(docs)
    got = [sorted((r.doc_id, r.text) for r in d.collect()) for d in steps[:4]]
    weights = op4.Model(model.weights.astype(np.float32), model.bias, model.slope, model.shift)
    assert got[0] == [r for r in rows if weights.score(op4.indicators(r[1])) >= 0.7]
    want = []
    for (i, t), (exact, near, text) in zip(got[0], dedup_brute(got[0])):
        lines = sum(bool(x.strip(" \t\r\n\x0b\x0c")) for x in t.split("\n"))
        if lines == 0 or exact + near < lines:
            want.append((i, text))
    assert got[1] == want
    # the search may miss a pair of hardly more than the similarity
    want = jaccard_brute(got[1])
    assert set(want) <= set(got[2]) and len(got[2]) <= len(want) + 0.1 * (len(got[1]) - len(want))
    assert got[3] == [r for r in got[2] if not items.matches(r[1], 0.8)]
    check_packing(rows_of(steps[4]), got[3], library, 2048, 0)
    assert 0 < len(got[3]) < len(rows)


def test_stages_on_empty_and_odd_tables(spark, sf):
    odd = [(1, None), (2, ""), (3, "a few plain words in a line"), (3, "a few plain words in a line"), (None, "no id at all but words"), (4, "x" * 3000)]
    for rows in ([], odd):
        for _, stage in P.STAGES[:4]:
            out = stage(spark, clashing(frame(spark, rows)), sf)
            assert out.columns == clashing(frame(spark, rows)).columns
            assert len(out.collect()) <= len(rows)
        assert P.STAGES[4][1](spark, frame(spark, rows), sf).count() >= len(rows)
