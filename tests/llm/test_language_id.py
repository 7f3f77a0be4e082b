import numpy as np
import pytest

from kinfold.llm import language_id
from kinfold.llm.common import crc_mod
from kinfold.llm.queries import op1_language_id

from .helpers import awkward, empty, untouched


def test_held_out_accuracy(spark, sf_small):
    got = op1_language_id(spark, sf_small).join(spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == spark.read.parquet(f"{sf_small}/documents.parquet").count()
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert got.score.between(0, 1).all()
    assert got.rejected.mean() < 0.05


def test_defined_cases(spark):
    docs = awkward(spark)
    model = language_id.fit(docs.where(crc_mod("doc_id", 4) != 2))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == "und"
    assert got[5].lang_pred in {"en", "fr", "de"} and got[1].rejected
    assert language_id.predict(docs, model).count() == docs.count()


def test_nothing_to_learn_and_empty(spark):
    model = language_id.fit(empty(spark))
    assert {r.lang_pred for r in language_id.predict(awkward(spark), model).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0


def _grams(text):
    """Counts of the hashed 2- and 3-grams, byte by byte."""
    clean, counts = [], {}
    for b in (" " + text.lower() + " ").encode():
        b = b if b >= 128 or chr(b).isalpha() else 32
        if not (b == 32 and clean and clean[-1] == 32):
            clean.append(b)
    for n, factor, plus in ((2, 0x85EBCA6B, 1), (3, 0x9E3779B1, 0)):
        for i in range(len(clean) - n + 1):
            x = int.from_bytes(bytes(clean[i : i + n]), "big") + plus
            at = ((x * factor) & 0xFFFFFFFF) >> (32 - 13)
            counts[at] = counts.get(at, 0) + 1
    return counts


def test_equals_nearest_centroid_by_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    model = language_id.fit(docs)
    assert len(model.languages) == len(model.centroids) and set(model.languages) == {r[0] for r in docs.select("lang").distinct().collect() if r[0]}
    texts = {r.doc_id: r.text for r in docs.limit(40).collect()}
    got = {r.doc_id: r for r in language_id.predict(docs.limit(40), model).collect()}
    for doc_id, text in texts.items():
        if got[doc_id].lang_pred == "und":
            continue
        v = np.zeros(language_id.DIMENSIONS)
        for at, n in _grams(text).items():
            v[at] = np.log1p(n) * model.idf[at]
        v /= np.linalg.norm(v)
        cosines = [float(c @ v) for c in model.centroids]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        assert got[doc_id].score == pytest.approx(min(1, max(0, cosines[best])), abs=1e-5)
        assert got[doc_id].lang_pred in {model.languages[i] for i, c in enumerate(cosines) if c > cosines[best] - 1e-5}
        assert got[doc_id].rejected == (got[doc_id].score < model.floors[best]) or abs(got[doc_id].score - model.floors[best]) < 1e-5


def test_ties_go_to_the_first_language_and_columns_pass(spark):
    rows = [(i, "one text in two tongues", lang) for i, lang in enumerate(("zz", "aa") * 6)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = awkward(spark)
    assert model.predict("one text in two tongues")[0] == "aa"
    out = language_id.annotate(docs, model)
    assert out.count() == docs.count() and untouched(out) and out.columns == [*(c for c in docs.columns if c != "score"), "lang_pred", "score", "rejected"]
