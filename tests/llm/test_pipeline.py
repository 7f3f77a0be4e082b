import numpy as np

import corpus_pipeline
from kinfold.llm.common import shingle_hashes

from .helpers import awkward, empty
from .test_jaccard_join import brute


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "jaccard_join", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == list(corpus_pipeline.COLUMNS)
        after = after.checkpoint()
        if name == "jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {d for d, _, c in brute(rows, 5, 8, 10) if d == c}
            assert {r.doc_id for r in after.collect()} == want
        if name == "language_id":
            assert after.count() >= 0.97 * before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    pieces = packed.toPandas()
    assert len(pieces) and (pieces.groupby("sequence_id").length.sum() <= 1024).all()
    run = corpus_pipeline.run(spark, sf).toPandas()
    assert run.length.sum() == pieces.length.sum()
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert np.array_equal(run[key].sort_values(key).to_numpy(), pieces[key].sort_values(key).to_numpy())


def test_awkward_and_empty(spark):
    for docs in (awkward(spark), empty(spark)):
        docs = docs.select(*corpus_pipeline.COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001").checkpoint()
    assert docs.count() == 0


def test_shingles_of_the_stage():
    assert shingle_hashes("a b c d", 5).size == 1 and shingle_hashes("a b c d e f", 5).size == 2
