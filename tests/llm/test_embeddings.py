import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import embedding_dedup, topk_search

VECTORS = "vec_id long, embedding array<float>, label int, score double"


def awkward_vectors(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).tolist(), i % 3, 0.0) for i in range(n)]
    base = rng.normal(size=8)
    rows += [(1000 + i, (base + rng.normal(size=8) * 0.12).tolist(), 1, 0.0) for i in range(120)]
    rows += [(2000 + i, base.tolist(), 1, 0.0) for i in range(15)] + [(2000, base.tolist(), 1, 0.0)]
    rows += [(3000, None, 1, None), (3001, [1.0, None] * 4, 1, None), (3002, [float("nan")] * 8, 1, None), (3003, [float("inf")] * 8, 1, None), (3004, [0.0] * 8, 1, None), (3005, [], 1, None), (3006, base.tolist(), None, None), (3007, [1.0, 2.0], 1, None), (3020, [1.0, 2.0], 1, None), (None, base.tolist(), 1, None)]
    return spark.createDataFrame(rows, VECTORS)


def sound(rows):
    return [(i, np.array(v, float), lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v) and i is not None]


def brute_top(rows, k=20):
    good = sound(rows)
    out = []
    for i, v, _ in good:
        if i % 20 == 0:
            q = np.floor(64 * v).astype(int)
            scores = sorted((-int(q @ np.floor(64 * w).astype(int)), j) for j, w, _ in good if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def plain(df):
    return [(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()]


def test_top_k_equals_brute_force(spark, monkeypatch):
    for name, value in (("TREE", 64), ("PAGE", 8), ("FAN", 4), ("BLOCK", 7)):
        monkeypatch.setattr(topk_search, name, value)
    df = awkward_vectors(spark)
    unique = df.where("vec_id <> 2000 or vec_id is null")
    got = sorted(tuple(r) for r in topk_search.top_k(unique, F.col("vec_id") % 20 == 0).collect())
    assert got == brute_top(plain(unique))
    again = topk_search.top_k(df, F.col("vec_id") % 20 == 0)
    assert again.groupBy("query_id").count().where("count < 20 and query_id <> 3020").count() == 0
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0).collect()) == brute_top(plain(df))


def test_tree_prunes_and_is_exact():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 400
    v = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    ids = np.arange(4000)
    import pickle

    tree = pickle.loads(topk_search.build(v, ids))
    own = np.arange(0, 4000, 97)
    scores, found, computed = topk_search.search(tree, v[own], own, 20, np.full(own.size, -np.inf))
    for x, s, f in zip(own, scores, found, strict=True):
        all_ = v @ v[x]
        want = [i for i in np.lexsort((ids, -all_)) if i != x][:20]
        assert f.tolist() == want and s.tolist() == all_[want].tolist()
    assert computed < 0.6 * 4000 * own.size


def brute_links(rows, t=0.93):
    good = [(i, v, lab) for i, v, lab in sound(rows) if lab is not None and np.any(v != 0)]
    out = {}
    from kinfold.llm.jaccard_join import Forest

    forest, n = Forest(), [0] * len(good)
    for a in range(len(good)):
        for b in range(a):
            (i, v, k), (j, w, m) = good[a], good[b]
            if k == m and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= t:
                n[a] += 1
                n[b] += 1
                forest.join(i, j)
    for (i, _, _), c in zip(good, n, strict=True):
        out.setdefault(i, []).append((c, forest.root(i)))
    return out


def test_near_dedup_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 32)
    monkeypatch.setattr(embedding_dedup, "PROBES", 48)
    monkeypatch.setattr(embedding_dedup, "LIST_ROWS", 24)
    df = awkward_vectors(spark)
    want = brute_links(plain(df))
    got = embedding_dedup.dedup(df).collect()
    assert len(got) == df.count()
    for r in got:
        if r.vec_id in want and r.vec_id != 3006:
            assert (r.n_links, r.component_id) in want[r.vec_id], r
        elif r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_near_dedup_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute_links(plain(df))
    for r in embedding_dedup.dedup(df).collect():
        assert (r.n_links, r.component_id) == want[r.vec_id][0] and r.kept == (r.component_id == r.vec_id)


def test_components_too_large_for_64_bits_raise(spark):
    df = spark.createDataFrame([(0, [1e17, 1.0], 1, None), (1, [1e17, 2.0], 1, None)], VECTORS.replace("float", "double"))
    with pytest.raises(Exception, match="too large"):
        topk_search.top_k(df, F.col("vec_id") % 20 == 0).collect()
    fine = spark.createDataFrame([(0, [1e6, -1e6], 1, None), (1, [1e6, 1e6], 1, None), (2, [1e6, -1e6 + 1], 1, None)], VECTORS.replace("float", "double"))
    assert [(r.vec_id, r.score) for r in topk_search.top_k(fine, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(2, 4096 * (2 * 10**12 - 10**6)), (1, 0)]
