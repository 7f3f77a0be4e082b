"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

A bounded sample of labelled documents is indexed by term: words and word prefixes, chosen by chi-squared over the
sample, as neighbours by all words are near by topic, not by tone (the README has figures). The examples are dealt into blocks and each term keeps the largest weight it has in each block, so the sum
of a query's term bounds says how good any example of a block can be. Blocks are visited from the best bound down
until the k-th best cosine found is above the next bound: the k neighbours are exact. Their distance-weighted vote,
calibrated by cross-fitted votes on the examples, is the score; neighbours and shared terms are the evidence.

Defined cases: null, empty or unknown-term text -> the calibrated score of a vote of 0, no evidence; ties of cosine
-> the smaller doc_id; no labelled rows -> score 0.0; a doc_id repeated in `docs` is scored
once per row; null labels, contradicting labels of one doc_id and rows without doc_id are not learned from; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, freed, labelled_texts, small_batches

#: Bounds of the sample of labelled rows per class, and of the terms kept.
SAMPLE_PER_CLASS, MAX_TERMS = 2000, 4000
NEIGHBOURS, BLOCK, AT_ONCE = 15, 64, 4
MIN_DF, MIN_CHI2 = 3, 16.0
PREFIXES = (4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, score double, neighbours array<struct<doc_id: long, toxic: int, cosine: double>>, terms array<string>"


def term_counts(text: str | None) -> Counter:
    """Occurrences of words, and of word prefixes written with a trailing '*'."""
    words = Counter(_WORD.findall(text.lower())) if text else Counter()
    terms = Counter(words)
    for word, n in words.items():
        for k in PREFIXES:
            if len(word) > k:
                terms[word[:k] + "*"] += n
    return terms


@dataclass
class Index:
    terms: dict[str, int]
    idf: np.ndarray
    prefixes: frozenset
    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray  # term x (block + 1): where a term's postings in a block begin
    rows: np.ndarray  # postings: example and its weight
    values: np.ndarray
    bounds: np.ndarray  # term x block: the largest weight
    knots: np.ndarray  # calibration: vote -> probability
    levels: np.ndarray

    def query(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text and their normalised TF-IDF weights."""
        if not text or not self.terms:
            return np.empty(0, np.int64), np.empty(0)
        found: dict[int, int] = {}
        known, heads = self.terms, self.prefixes
        for word, n in Counter(_WORD.findall(text.lower())).items():
            t = known.get(word)
            if t is not None:
                found[t] = found.get(t, 0) + n
            if word[:4] in heads:
                for k in PREFIXES:
                    if len(word) > k and (t := known.get(word[:k] + "*")) is not None:
                        found[t] = found.get(t, 0) + n
        if not found:
            return np.empty(0, np.int64), np.empty(0)
        at = np.array(sorted(found), np.int64)
        w = (1 + np.log([found[t] for t in at.tolist()])) * self.idf[at]
        return at, w / np.sqrt(w @ w)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (ties to the smaller doc_id), exactly; only examples with a cosine above 0."""
        if not at.size:
            return np.empty(0, np.int64), np.empty(0)
        bound = w @ self.bounds[at]
        order = np.argsort(-bound, kind="stable")
        got, cos = np.empty(0, np.int64), np.empty(0)
        for i in range(0, order.size, AT_ONCE):
            blocks = order[i : i + AT_ONCE]
            blocks = blocks[(bound[blocks] > 0) & ((got.size < k) | (bound[blocks] >= (cos[-1] if got.size else 0) - 1e-12))]
            if not blocks.size:
                break
            first = self.starts[at[:, None], blocks[None, :]].ravel()
            n = self.starts[at[:, None], blocks[None, :] + 1].ravel() - first
            end = np.cumsum(n)
            post = np.arange(end[-1]) + np.repeat(first - end + n, n)  # postings of all (term, block) cells
            row = self.rows[post]
            rows, where = np.unique(row, return_inverse=True)
            score = np.bincount(where, np.repeat(np.repeat(w, blocks.size), n) * self.values[post], rows.size)
            some = score > 0
            got, cos = np.append(got, rows[some]), np.append(cos, score[some])
            best = np.lexsort((self.ids[got], -cos))[:k]
            got, cos = got[best], cos[best]
        return got, cos

    def vote(self, got: np.ndarray, cos: np.ndarray) -> float:
        """Share of toxic among the neighbours, each weighted by its cosine; missing neighbours vote for clean with a small weight."""
        w = cos * cos
        return float((w * self.labels[got]).sum() / (w.sum() + 0.02)) if got.size else 0.0

    def score(self, vote: float) -> float:
        return float(np.interp(vote, self.knots, self.levels)) if self.knots.size else 0.0


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x; returns knots and levels for linear interpolation."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order.tolist():
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] / pools[-2][2] == pools[-1][0] / pools[-1][2]):
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms = list(term_counts(text))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([label] * len(terms), pa.int32())], ["term", "label"])


def _picked(sample: DataFrame, max_terms: int) -> tuple[dict[str, int], np.ndarray, int]:
    """The terms of largest chi-squared over labelled texts, numbered by name; how many texts hold each; and the number of texts."""
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    total = max(n0 + n1, 1)
    by_term = sample.select("text", "label").mapInArrow(lambda b: freed(_exploded(b)), "term string, label int").groupBy("term").agg(F.sum(1 - F.col("label")).alias("a0"), F.sum("label").alias("a1"))
    a0, a1 = F.col("a0"), F.col("a1")
    chi2 = total * F.pow(a1 * (n0 - a0) - a0 * (n1 - a1), 2) / F.greatest(F.lit(1.0), (a0 + a1) * (total - a0 - a1) * F.lit(float(n0)) * F.lit(float(n1)))
    picked = by_term.where(a0 + a1 >= MIN_DF).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "term").limit(max_terms).collect()
    picked = sorted((r["term"], r["a0"] + r["a1"]) for r in picked)
    return {t: i for i, (t, _) in enumerate(picked)}, np.array([df for _, df in picked], float), total


def _indexed(sample: DataFrame, max_terms: int) -> Index:
    """An index over labelled texts (doc_id, text, label), without calibration."""
    terms, df, total = _picked(sample, max_terms)
    idf = np.log((1 + total) / (1 + df)) + 1
    empty = np.empty(0)

    def counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tf = [], []
            for text in batch.column(1).to_pylist():
                c = {terms[t]: k for t, k in term_counts(text).items() if t in terms}
                at.append(np.array(list(c), "<i4").tobytes())
                tf.append(np.array(list(c.values()), "<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "label", "at", "tf"])

    got = sample.select("doc_id", "text", "label").mapInArrow(lambda b: freed(counted_terms(b)), "doc_id long, label int, at binary, tf binary").toPandas()
    if got.empty or not terms:
        return Index({}, idf, frozenset(), empty, empty, empty, empty, empty, empty, empty, empty)
    # examples with the same heaviest term share blocks, which keeps the block bounds tight
    got["key"] = [int(a[np.argmax((1 + np.log(f)) * idf[a])]) if a.size else -1 for a, f in ((np.frombuffer(a, "<i4"), np.frombuffer(f, "<f4")) for a, f in zip(got["at"], got["tf"], strict=True))]
    got = got.sort_values(["key", "doc_id", "label"], kind="stable").reset_index(drop=True)
    row, col, val = [], [], []
    for i, (at, tf) in enumerate(zip(got["at"], got["tf"], strict=True)):
        at, tf = np.frombuffer(at, "<i4"), np.frombuffer(tf, "<f4").astype(float)
        w = (1 + np.log(tf)) * idf[at]
        w /= max(float(np.sqrt(w @ w)), 1e-12)
        row.append(np.full(at.size, i)), col.append(at), val.append(w)
    row, col, val = map(np.concatenate, (row, col, val))
    order = np.lexsort((row, col))
    row, col, val = row[order], col[order], val[order]
    blocks = -(-len(got) // BLOCK)
    cell = col * blocks + row // BLOCK
    starts = np.searchsorted(cell, (np.arange(len(terms))[:, None] * blocks + np.arange(blocks + 1)[None, :]))
    bounds = np.zeros(len(terms) * blocks)
    np.maximum.at(bounds, cell, val)
    return Index(terms, idf, frozenset(t[:4] for t in terms if t.endswith("*")), got["doc_id"].to_numpy(), got["label"].to_numpy().astype(float), starts, row, val, bounds.reshape(len(terms), blocks), empty, empty)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_terms: int = MAX_TERMS, seed: int = 17) -> Index:
    """Index the texts of `docs` that `labels` (doc_id, label 0/1) names: about `per_class` rows of each class, and at most `max_terms` terms.

    Votes are calibrated by cross-fitting: each half of the sample is voted on by an index of the other half, whose terms
    were chosen without it.
    """
    small_batches(docs.sparkSession)
    sample, counted = labelled_texts(docs, labels, per_class, seed)
    sample = cut(sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)).cast("int")))
    index = _indexed(sample, max_terms)
    votes, truth = [], []
    for half in (0, 1):
        other = _indexed(sample.where(F.col("half") != half), max_terms)
        voted = predict_votes(sample.where(F.col("half") == half).select("doc_id", "text"), other).join(sample.select("doc_id", "label"), "doc_id").select("vote", "label").toPandas()  # of the sample
        votes.append(voted["vote"].to_numpy(float)), truth.append(voted["label"].to_numpy(float))
    votes, truth = np.concatenate(votes), np.concatenate(truth)
    if votes.size and index.terms:
        n1 = truth.sum()
        share = np.where(truth == 1, counted.get(1, 0) / max(n1, 1), counted.get(0, 0) / max(truth.size - n1, 1))
        index.knots, index.levels = _isotonic(votes, truth, share)
    return index


def predict_votes(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, vote) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [shared.value.vote(*shared.value.nearest(*shared.value.query(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], ["doc_id", "vote"])

    return docs.select("doc_id", "text").mapInArrow(lambda b: freed(voted(b)), "doc_id long, vote double")


def predict(docs: DataFrame, index: Index, evidence: bool = True) -> DataFrame:
    """(doc_id, score, neighbours, terms) of every row; the index is bounded by the sample and the term limit."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = sorted(m.terms, key=m.terms.get)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        for batch in batches:
            scores, near, why = [], [], []
            for text in batch.column(1).to_pylist():
                at, w = m.query(text)
                got, cos = m.nearest(at, w)
                scores.append(min(1.0, max(0.0, m.score(m.vote(got, cos)))))
                near.append([{"doc_id": int(m.ids[g]), "toxic": int(m.labels[g]), "cosine": float(c)} for g, c in zip(got[:5], cos[:5], strict=True)] if evidence else [])
                why.append([names[t] for t in at[np.argsort(-w, kind="stable")][:5]] if evidence else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(near, kind), pa.array(why, pa.list_(pa.string()))], ["doc_id", "score", "neighbours", "terms"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: freed(scored(b)), SCHEMA)
