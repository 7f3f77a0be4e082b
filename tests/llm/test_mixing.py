import re

import numpy as np

from kinfold.llm import mixing

from .helpers import awkward, empty, untouched


def capped_targets(sizes: list[int], weights: list[float], max_repeats: float = 3) -> list[float]:
    """Share sum(sizes) by weight; whoever would exceed max_repeats times its size stops there and the excess is reshared."""
    total, caps = float(sum(sizes)), [max_repeats * s for s in sizes]
    target, free = [0.0] * len(sizes), list(range(len(sizes)))
    rest = total
    while free and rest > 0:
        share = rest / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * share > caps[i]]
        if not over:
            for i in free:
                target[i] = weights[i] * share
            break
        for i in over:
            target[i] = float(caps[i])
            rest -= caps[i]
        free = [i for i in free if i not in set(over)]
    return target


def _check(docs, block=16):
    frame = docs.select("doc_id", "text", "source").toPandas()
    frame["size"] = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) if isinstance(t, str) else 0 for t in frame.text]
    total = frame["size"].sum()
    sources = sorted({s for s in frame.source if isinstance(s, str)}) + ([None] if frame.source.isna().any() else [])
    sizes = [int(frame[frame.source.isna() if s is None else frame.source == s]["size"].sum()) for s in sources]
    targets = capped_targets(sizes, [(1, 2, 3)[i % 3] for i in range(len(sources))])
    assert abs(sum(targets) - min(total, 3 * total)) < 1e-6 * max(total, 1)
    out, pieces = mixing.mix(docs, block=block, shard_blocks=64)
    got = out.join(docs.select("doc_id", "source").distinct(), "doc_id").toPandas()
    again = mixing.mix(docs.repartition(3), block=block, shard_blocks=64)[0].toPandas()
    for s, size, target in zip(sources, sizes, targets, strict=True):
        rows = got[got.source.isna() if s is None else got.source == s]
        if not len(rows):
            continue
        assert (rows.source_size == size).all() and np.allclose(rows.target, target)
        if rows.doc_id.is_unique and not frame.doc_id.isna().any():
            assert rows.taken.sum() == round(target)
    assert (out.toPandas().eval("taken <= 3 * size")).all()
    key = ["doc_id", "size", "taken"]
    assert out.toPandas()[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    p = pieces.toPandas()
    assert p.groupby(["source_no", "slot"]).n_words.sum().max() <= block
    assert p.n_words.sum() == out.toPandas().taken.sum()
    slots = p.drop_duplicates(["source_no", "slot"]).groupby("shard").size().sort_index()
    assert (slots.iloc[:-1] == 64).all() and (slots <= 64).all()  # shards have one length
    return p


def test_targets_met(spark, sf_small):
    _check(spark.read.parquet(f"{sf_small}/documents.parquet"))


def test_defined_cases(spark):
    docs = awkward(spark)
    _check(docs)
    out = mixing.mix(docs)[0]
    assert out.count() == docs.count()
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns and untouched(texts)
    assert mixing.mix(empty(spark))[0].count() == mixing.mixed_texts(empty(spark)).count() == 0


def test_caps_and_permutations():
    assert capped_targets([100, 100, 1], [1, 1, 2]) == [99.0, 99.0, 3.0]
    assert capped_targets([0, 0], [1, 2]) == [0.0, 0.0]
    for n in (1, 2, 3, 17, 64, 1000):
        p = mixing._feistel(np.arange(n), n, 99)
        assert sorted(p) == list(range(n))
        assert (mixing._feistel(p, n, 99, inverse=True) == np.arange(n)).all()
    for size in (1, 5, 16, 33, 100):
        for target in range(0, 3 * size + 1):
            slots, last = mixing.plan_slots(target, size, 16, 3)
            blocks = -(-size // 16)
            length = np.full(blocks, 16)
            length[-1] = size - 16 * (blocks - 1)
            words = length[mixing.permuted(np.arange(slots), blocks, 3)] if slots else np.zeros(0, int)
            if slots:
                words[-1] = min(words[-1], last)
            assert words.sum() == target


def test_counts_are_drawn_within_what_is_left():
    rng = np.random.default_rng(3)
    slots = np.array([1000, 0, 3, 250])
    rows = list(mixing.dealt(slots, [100] * 12 + [53], rng))
    assert (sum(rows) == slots).all() and [r.sum() for r in rows] == [100] * 12 + [53]
    assert 60 < rows[0][0] < 95 and len({tuple(r) for r in rows}) > 5


def test_every_word_is_where_the_plan_says(spark):
    """Brute force: words laid out by place, blocks permuted, slot by slot; then texts as `mixed_texts` returns them."""
    rows = [(i, " ".join(f"s{i % 3}d{i}w{k}" for k in range(5 + 37 * i % 400)), "abc"[i % 3], 7, "x", "y", 1, 2) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row_no long, words string, took string, turn int, language int").coalesce(1)
    out, pieces = mixing.mix(docs)
    got = pieces.toPandas()
    sizes = {r.doc_id: r.size for r in out.collect()}
    for no in range(3):
        mine = [i for i in sizes if i % 3 == no]
        laid = mixing._laid_out(spark.createDataFrame([(no, i, sizes[i]) for i in mine], "source_no int, doc_id long, size long")).toPandas()
        words = [None] * int(laid["size"].sum())
        for r in laid.itertuples():
            words[r.place : r.place + r.size] = [(r.doc_id, k) for k in range(r.size)]
        assert None not in words
        p = got[got.source_no == no]
        blocks = -(-len(words) // mixing.BLOCK_WORDS)
        order = mixing.permuted(np.arange(p.slot.max() + 1), blocks, no)
        for slot, part in p.groupby("slot"):
            block = words[order[slot] * mixing.BLOCK_WORDS : (order[slot] + 1) * mixing.BLOCK_WORDS]
            held = sorted((r.doc_id, k) for r in part.itertuples() for k in range(r.first_word, r.first_word + r.n_words))
            assert held == sorted(block) or slot == p.slot.max() and held == sorted(block[: len(held)])
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns
    want = sorted((d, " ".join(rows[d][1].split(" ")[k] for r in sorted(x.itertuples(), key=lambda r: r.first_word) for k in range(r.first_word, r.first_word + r.n_words))) for (d, _), x in got.groupby(["doc_id", "turn"]))
    assert sorted((r.doc_id, r.text) for r in texts.collect()) == want
    assert {(r.row_no, r.words, r.took, r.turn, r.language) for r in texts.collect()} == {(7, "x", "y", 1, 2)}
