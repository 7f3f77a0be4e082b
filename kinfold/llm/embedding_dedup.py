"""Embedding near-dedup with product quantisation.

Equal vectors of a label are first merged and counted. Unit vectors are dealt to coarse inverted lists (nearest
centroid); their residuals are stored as subspace codes. A vector probes the lists that can hold a vector within the
threshold: y lies in list c only if it is nearer to c than to the prober's own centroid c0, so x probes c exactly if
|x - c|^2 - |x - c0|^2 <= 2 * rho * |c - c0|, with rho the chord of the threshold. In a list, table look-ups give the
asymmetric distance |x - y'| to the coded y'; y stays a candidate if that is at most rho plus y's stored coding error.
Neither step can lose a link; candidates are then compared by exact cosine in double precision.

Centroids and codebooks are fitted on a bounded, hashed sample; every row is indexed. Lists are worked on in tiles, so
no task holds a whole list. Of a tile, only link counts and a spanning forest leave the task.

Defined cases: null label, or a vector that is null, zero, empty or holds null or non-finite components -> no links, its
own component, kept; only vectors of equal length are compared; rows repeated with one vec_id are distinct vectors that
link with each other, with that id; null vec_id -> the row is returned without links; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components

THRESHOLD = 0.93
#: Rows of the sample; coarse lists at most and vectors of a list to aim at; width and size of a subspace codebook; tile sizes.
SAMPLE, LISTS, LIST_ROWS, SUBSPACE, CODES, TILE, PROBES = 8192, 1024, 512, 4, 128, 256, 512


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        for j in range(x.shape[1]):
            s = np.bincount(near, x[:, j], len(c))
            c[:, j] = np.where(n > 0, s / np.maximum(n, 1), c[:, j])
    return c


class Quantiser:
    """Coarse centroids and residual codebooks for unit vectors of one length (padded to whole subspaces)."""

    def __init__(self, sample: np.ndarray, lists: int, rho: float):
        self.dim, self.rho = sample.shape[1], rho
        self.coarse = _kmeans(sample, lists, 8, 1)
        residual = self.padded(sample - self.coarse[self.home(sample)[0]])
        self.books = [_kmeans(residual[:, j : j + SUBSPACE], CODES, 8, 2 + j) for j in range(0, residual.shape[1], SUBSPACE)]
        self.apart = np.sqrt(np.maximum(0, ((self.coarse[:, None, :] - self.coarse[None, :, :]) ** 2).sum(2)))

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % SUBSPACE)))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2 = (x**2).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(1)[None, :]
        return d2.argmin(1), d2

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """List, codes, coding error and probes of each row."""
        own, d2 = self.home(x)
        residual = self.padded(x - self.coarse[own])
        codes, left = [], np.zeros(len(x))
        for j, book in enumerate(self.books):
            part = residual[:, j * SUBSPACE : (j + 1) * SUBSPACE]
            code = ((book**2).sum(1)[None, :] - 2 * part @ book.T).argmin(1)
            codes.append(code.astype(np.uint8))
            left += ((part - book[code]) ** 2).sum(1)
        reach = d2 - d2[np.arange(len(x)), own][:, None] <= 2 * self.rho * self.apart[own] + 1e-9
        return own, np.array(codes).T, np.sqrt(left), [np.flatnonzero(r).tolist() for r in reach]

    def within(self, x: np.ndarray, which: int, codes: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the pairs whose asymmetric distance, by table look-ups, is at most `most` of the column.

        Sums over some subspaces are lower bounds: the first few settle nearly all pairs, the rest is summed for those left.
        """
        residual = self.padded(x - self.coarse[which])
        tables = [
            ((part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)[None, :]).astype(np.float32)
            for part, book in ((residual[:, j * SUBSPACE : (j + 1) * SUBSPACE], book) for j, book in enumerate(self.books))
        ]
        limit = (most * most).astype(np.float32) + np.float32(1e-4)
        first = min(6, len(tables))
        total = np.take(tables[0], codes[:, 0], axis=1)
        for j in range(1, first):
            total += np.take(tables[j], codes[:, j], axis=1)
        i, k = np.nonzero(total <= limit[None, :])
        left = total[i, k]
        for j in range(first, len(tables)):
            left = left + tables[j][i, codes[k, j]]
            keep = left <= limit[k]
            i, k, left = i[keep], k[keep], left[keep]
        return i, k


def _labels(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id reachable in a bipartite link matrix, of each row and column."""
    big = np.iinfo(np.int64).max
    r, c = rows.copy(), cols.copy()
    while True:
        c2 = np.minimum(c, np.where(hit, r[:, None], big).min(0, initial=big))
        r2 = np.minimum(r, np.where(hit, c2[None, :], big).min(1, initial=big))
        if (c2 == c).all() and (r2 == r).all():
            return r, c
        r, c = r2, c2


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, seed: int = 31) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of `vectors`."""
    spark = vectors.sparkSession
    rho = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("x", lambda v: v != 0)
    usable = F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    merged = rows.where(usable).groupBy("label", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    merged = cut(merged.withColumn("dim", F.size("x")))
    groups = merged.groupBy("dim").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).collect()  # a row per vector length
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    models: dict[int, Quantiser] = {}
    for g in groups:
        got = merged.where((F.col("dim") == g["dim"]) & (draw < min(1 << 30, int(1.1 * SAMPLE / g["n"] * (1 << 30)) + 1))).orderBy(draw, "id").limit(SAMPLE).select("x").collect()
        unit = _unit(np.array([r["x"] for r in got]).reshape(len(got), g["dim"]) if got else np.zeros((1, g["dim"])))
        models[g["dim"]] = Quantiser(unit, int(min(LISTS, max(1, g["n"] // (LIST_ROWS * g["labels"])))), rho)
    shared = spark.sparkContext.broadcast(models)  # bounded by LISTS, CODES and the vector length

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, g in f.groupby("dim"):
                own, codes, error, probes = shared.value[int(dim)].encode(_unit(np.array(g["x"].tolist()).reshape(len(g), int(dim))))
                yield pd.DataFrame({"label": g["label"].to_numpy(), "dim": dim, "id": g["id"].to_numpy(), "copies": g["copies"].to_numpy(), "x": [np.asarray(a, np.float64).tobytes() for a in g["x"]], "list": own, "code": [c.tobytes() for c in codes], "error": error, "probes": probes})

    schema = "label string, dim int, id long, copies long, x binary, list int, code binary, error double, probes array<int>"
    index = cut(merged.select("label", "dim", "id", "copies", "x").mapInPandas(coded, schema))
    key = ["label", "dim", "list"]
    probing = index.select("label", "dim", F.explode("probes").alias("list"), "id", "x")
    sizes = index.groupBy(key).agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles"))
    asked = probing.groupBy(key).agg(F.ceil(F.count("*") / F.lit(PROBES)).cast("int").alias("askers"))
    sizes = cut(sizes.join(asked, key))
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = index.join(sizes, key).select(*key, slot("tiles").alias("tile"), F.explode(every("askers")).alias("asker"), "id", "copies", "x", "code", "error", F.lit(False).alias("asks"))
    asks = probing.join(sizes, key).select(*key, F.explode(every("tiles")).alias("tile"), slot("askers").alias("asker"), "id", F.lit(0).cast("long").alias("copies"), "x", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("error"), F.lit(True).alias("asks"))

    def compared(f: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "n": [], "b": []}).astype("int64")
        dim, which = int(f["dim"].iloc[0]), int(f["list"].iloc[0])
        q, y = f[f["asks"]], f[~f["asks"]]
        if q.empty or y.empty:
            return none
        qx, yx = (np.frombuffer(b"".join(g["x"]), np.float64).reshape(len(g), dim) for g in (q, y))
        codes = np.frombuffer(b"".join(y["code"]), np.uint8).reshape(len(y), -1)
        qid, yid = q["id"].to_numpy(), y["id"].to_numpy()
        i, k = shared.value[dim].within(_unit(qx), which, codes, rho + y["error"].to_numpy() + 1e-4)
        i, k = i[qid[i] != yid[k]], k[qid[i] != yid[k]]
        at_q, at_y = np.unique(i), np.unique(k)
        if not at_q.size:
            return none
        near = np.zeros((len(q), len(y)), bool)
        near[i, k] = True
        a, b = qx[at_q], yx[at_y]
        cosine = (a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :])
        hit = near[np.ix_(at_q, at_y)] & (cosine >= threshold)
        links = hit @ y["copies"].to_numpy()[at_y]
        lq, ly = _labels(hit, qid[at_q], yid[at_y])
        a = np.concatenate([qid[at_q], yid[at_y]])
        out = pd.DataFrame({"a": a, "n": np.concatenate([links, np.zeros(at_y.size)]).astype("int64"), "b": np.concatenate([lq, ly])})
        return out[(out["n"] > 0) | (out["a"] != out["b"])]

    found = cut(held.unionByName(asks).groupBy(*key, "tile", "asker").applyInPandas(compared, "a long, n long, b long"))
    joined = components(found.where("a <> b").select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("id"), "n")
    facts = merged.select("label", "x", "id", "copies").join(counts, "id", "left").join(joined, "id", "left")
    facts = cut(facts.select("label", "x", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    out = rows.withColumn("usable", usable).join(facts, ["label", "x"], "left")
    component = F.coalesce(F.when(F.col("usable"), F.col("component")), F.col("vec_id"))
    return out.select("vec_id", F.coalesce(F.when(F.col("usable"), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True, initial=0)
    x = x / np.where(scale > 0, scale, 1)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)
