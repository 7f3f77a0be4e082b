import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from kinfold.llm import packing

from .helpers import awkward, empty


def _round_trip(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).toPandas()
    rows = docs.select("doc_id", "text").toPandas()
    want = sorted((-1 if np.isnan(d) else int(d), tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for d, t in zip(rows.doc_id.astype(float), rows.text, strict=True))
    assert got.length.sum() == sum(len(i) for _, i in want)
    padding = 0
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset.to_numpy() == np.append(0, seq.length.cumsum().to_numpy()[:-1])).all()
        n = seq.length.sum()
        assert n <= 1024
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert padding == 0
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    by = {d: sorted(i for x, i in want if x == d) for d, _ in want}
    for doc_id, pieces in got.groupby(got.doc_id.fillna(-1)):
        for n, copies in pieces.groupby("doc_tokens"):
            every = b"".join(copies.sort_values("start").ids)
            assert len(every) == 4 * sum(len(i) for i in by[doc_id] if len(i) == n)
        if len(by[doc_id]) == 1:
            assert tuple(np.frombuffer(b"".join(pieces.sort_values("start").ids), "<u4")) == by[doc_id][0]


def test_round_trip(spark, sf_small):
    _round_trip(spark.read.parquet(f"{sf_small}/documents.parquet"))


def test_defined_cases(spark):
    _round_trip(awkward(spark))
    assert packing.pack(empty(spark)).count() == 0


def test_encoder_equals_tokenizer_on_odd_spacing():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.default_encoder()
    for text in ["a b", " a", "a ", "a  b", "a \n b", "a\n b", "a\n\n \nb", "don't we 'll 's", "1 2  3", "x  y", "  z", "<|endoftext|> a", "a\tb \t c", "é 'é", "\n", " ", "a !b ?? c"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_equals_tokenizer_on_any_text():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.default_encoder()
    rng = np.random.default_rng(2)
    pieces = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "\t", "a", "the", "Zürich", "12", "'s", "!", "\u00a0", "\u3042", "\U0001f600", "x" * 40]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(0, 9)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_hilbert_neighbours():
    side = np.array([(x, y) for x in range(16) for y in range(16)])
    key = packing.hilbert_index(side, bits=4)
    assert sorted(key) == list(range(256))
    walk = side[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
