"""Language ID by nearest centroid over normalised TF-IDF byte n-gram vectors.

Every language has several centroids (spherical k-means over a bounded sample of its labelled rows); a text takes
the language of the centroid with the largest cosine. A text whose cosine falls below the floor of that centroid is
flagged `rejected` (distance-based rejection).

Defined cases: null text, or text without any letter -> lang_pred 'und', score 0.0, rejected true; no labelled rows
to learn from -> 'und' for every text; ties -> the alphabetically first language; rows with a null or repeated
doc_id are scored like any other; further columns of the input are ignored; an empty table gives an empty result.
Texts of any length are read whole, one bounded segment of bytes at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, freed, map_texts, small_batches

DIMENSIONS = 1 << 13
SEGMENT = 1 << 20
#: Bound of the training sample: rows of each language (twice as many at most). The model grows by 130 kB a language.
SAMPLE_PER_LANGUAGE = 600
CENTROIDS = 4
#: A centroid's floor is this share of the cosine that all but one in a thousand of its sample rows reach.
REJECT_SHARE = 0.5

_LETTER = re.compile(r"[^\W\d_]")
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]

SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams; ASCII non-letters count as one blank per run."""
    data = (" " + text.lower() + " ").encode("utf-8", "replace")
    counts = np.zeros(DIMENSIONS, np.int64)
    shift = np.uint32(32 - 13)
    for begin in range(0, len(data), SEGMENT):
        part = _CLEAN[np.frombuffer(data[begin : begin + SEGMENT + 2], np.uint8)]
        blank = part == 32
        keep = np.ones(part.size, bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        x = part[keep].astype(np.uint32)
        if x.size < 2:
            continue
        pair = (x[:-1] << np.uint32(8)) | x[1:]
        counts += np.bincount(((pair + np.uint32(1)) * np.uint32(0x85EBCA6B)) >> shift, minlength=DIMENSIONS)
        if x.size > 2:
            triple = (pair[:-1] << np.uint32(8)) | x[2:]
            counts += np.bincount((triple * np.uint32(0x9E3779B1)) >> shift, minlength=DIMENSIONS)
    return counts


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    floors: np.ndarray

    def vector(self, text: str) -> np.ndarray:
        v = (np.log1p(ngram_counts(text)) * self.idf).astype(np.float32)
        n = float(np.sqrt(v @ v))
        return v / n if n else v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, True
        cosines = self.centroids @ self.vector(text)
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best]))), bool(cosines[best] < self.floors[best])


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means, started by farthest points from the mean direction; deterministic."""
    centres = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        unit = np.array([c / max(np.linalg.norm(c), 1e-12) for c in centres])
        centres.append(x[int(np.argmin((x @ unit.T).max(1)))])
    c = np.array(centres, np.float32)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _sparse_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = [], []
        for text in batch.column(1).to_pylist():
            counts = ngram_counts(text)
            where = np.flatnonzero(counts)
            at.append(where.astype("<u2").tobytes())
            n.append(counts[where].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["doc_id", "lang", "at", "n"])


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, seed: int = 11) -> Model:
    """Learn from (doc_id, text, lang); at most about `per_language` rows of each language are used.

    Only hashed n-gram counts of the bounded sample reach the driver.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike("\\p{L}"))
    sample, _ = bounded_sample(rows, "lang", per_language, seed)
    got = sample.mapInArrow(_sparse_counts, "doc_id long, lang string, at binary, n binary").toPandas()
    got = got.sort_values(["lang", "doc_id"], kind="stable")
    if got.empty:
        return Model([], np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    df = np.zeros(DIMENSIONS)
    for at in got["at"]:
        df[np.frombuffer(at, "<u2")] += 1
    idf = np.log((1 + len(got)) / (1 + df)) + 1
    languages, centroids, floors = [], [], []
    for lang, rows_of in got.groupby("lang", sort=True):
        x = np.zeros((len(rows_of), DIMENSIONS), np.float32)
        for i, (at, n) in enumerate(zip(rows_of["at"], rows_of["n"], strict=True)):
            x[i, np.frombuffer(at, "<u2")] = np.log1p(np.frombuffer(n, "<f4"))
        x *= idf.astype(np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _kmeans(x, CENTROIDS)
        cosines = x @ c.T
        floor = REJECT_SHARE * np.quantile(cosines.max(1), 0.001)
        languages += [str(lang)] * len(c)
        centroids.append(c)
        floors += [floor] * len(c)
    return Model(languages, idf, np.vstack(centroids).astype(np.float32), np.array(floors))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of `docs`; the model (a few centroids) is the only broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_told(shared.value, batch.column(1))], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: freed(scored(b)), SCHEMA)


def _told(model: Model, texts: pa.Array) -> list[pa.Array]:
    out = [model.predict(text) for text in texts.to_pylist()]
    return [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score and rejected; every row passes through, and every column but one of such a name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda texts: _told(shared.value, texts), SCHEMA.removeprefix("doc_id long, "))
