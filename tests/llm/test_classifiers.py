import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import quality, toxicity
from kinfold.llm.queries import op8_quality, op10_toxicity

from .helpers import awkward, empty


def _with_labels(spark, sf, query, label):
    return query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label).alias("y")), "doc_id").where("y is not null").toPandas()


def test_quality_held_out(spark):
    got = _with_labels(spark, "/root/testdata/sf0.01", op8_quality, "quality")
    held = got[got.held_out]
    assert (held.predicted == held.y).mean() > 0.9
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_toxicity_held_out(spark):
    got = _with_labels(spark, "/root/testdata/sf0.01", op10_toxicity, "toxic")
    held = got[got.held_out]
    assert (held.predicted == held.y).mean() > 0.93
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit(docs, labels)


def test_block_max_search_is_exact(spark, index):
    dense = np.zeros((len(index.ids), len(index.terms)))
    blocks = index.starts.shape[1] - 1
    for t in range(len(index.terms)):
        a, b = index.starts[t, 0], index.starts[t, blocks]
        dense[index.rows[a:b], t] = index.values[a:b]
    for (text,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(150).collect():
        at, w = index.query(text)
        got, cos = index.nearest(at, w)
        q = np.zeros(len(index.terms))
        q[at] = w
        all_ = dense @ q
        want = [i for i in np.lexsort((index.ids, -np.round(all_, 12))) if all_[i] > 0][: toxicity.NEIGHBOURS]
        assert np.allclose(cos, all_[want])
        assert len(got) == len(want)


def test_defined_cases(spark, index):
    docs, labels = awkward(spark), spark.createDataFrame([(7, 1), (8, 0), (9, None), (999, 1), (12, 0), (13, 1)], "doc_id long, label int")
    net = quality.fit(docs, labels)
    assert quality.predict(docs, net).where("score between 0 and 1").count() == docs.count()
    assert quality.predict(empty(spark), net).count() == 0
    assert {r.score for r in quality.predict(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    small = toxicity.fit(docs, labels)
    assert toxicity.predict(docs, small).where("score between 0 and 1").count() == docs.count()
    assert toxicity.predict(empty(spark), small).count() == 0
    assert {r.score for r in toxicity.predict(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    got = toxicity.predict(spark.createDataFrame([(1, "you worthless idiot clown"), (2, "")], "doc_id long, text string"), index).orderBy("doc_id").collect()
    assert got[0].score > 0.3 and got[0].neighbours and "worthless" in got[0].terms
    assert got[1].score < 0.3 and not got[1].neighbours


def test_convolution_equals_brute_force():
    rng = np.random.default_rng(4)
    f32 = np.float32
    net = quality.Network(rng.normal(0, 1, (quality.WIDTH, 256, quality.FILTERS)).astype(f32), rng.normal(0, 1, quality.FILTERS).astype(f32), rng.normal(0, 1, (2 * quality.FILTERS, quality.HIDDEN)).astype(f32), rng.normal(0, 1, quality.HIDDEN).astype(f32), rng.normal(0, 1, quality.HIDDEN).astype(f32), 0.3)
    for size in (1, 3, 4, 100, 128, 131, 132, 259, 260, 700, 3000):
        data = rng.integers(1, 256, size).astype(np.uint8).tobytes()
        padded = data + bytes(max(0, quality.WIDTH - len(data)))
        n = len(padded) - quality.WIDTH + 1
        response = np.array([[sum(float(net.table[j][padded[i + j]][f]) for j in range(quality.WIDTH)) for f in range(quality.FILTERS)] for i in range(n)])
        begins = range(0, max(1, -(-n // quality.STEP) - 1) * quality.STEP, quality.STEP)
        chunks = np.array([np.maximum(response[b : b + quality.CHUNK].max(0) + net.bias, 0) for b in begins])
        want = np.concatenate([chunks.mean(0), chunks.max(0)])
        assert np.allclose(net.pooled(data), want, atol=1e-3)
        parts, held = quality.chunked(data)
        where, top = net.strongest(parts, held)
        assert np.allclose(np.maximum(top, 0), chunks, atol=1e-3) and (where < held[:, None]).all()
        p = 1 / (1 + np.exp(-(np.maximum(want @ net.w1 + net.b1, 0) @ net.w2 + net.b2)))
        assert 1 / (1 + np.exp(-float(net.head(net.pooled(data))))) == pytest.approx(p, abs=1e-3)


def test_vote_and_calibration():
    index = toxicity.Index({}, np.empty(0), frozenset(), np.arange(4), np.array([1.0, 0, 1, 0]), *[np.empty(0)] * 6)
    assert index.vote(np.array([0, 1]), np.array([0.8, 0.4])) == pytest.approx(0.64 / (0.64 + 0.16 + 0.02))
    assert index.vote(np.empty(0, int), np.empty(0)) == 0
    rng = np.random.default_rng(0)
    x = rng.random(200)
    y = (rng.random(200) < x).astype(float)
    knots, levels = toxicity._isotonic(x, y, np.ones(200))
    assert (np.diff(knots) > 0).all() and (np.diff(levels) >= 0).all()
    # the fit of the pools is the least-squares one: no pool can be split with a larger mean first
    owner = np.abs(x[:, None] - knots[None, :]).argmin(1)
    assert abs((levels[owner] - y).mean()) < 0.1
