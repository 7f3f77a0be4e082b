"""Exact top-k by inner product with M-trees, searched best first.

Vectors become integers floor(64 * x). Each goes to the nearest of a bounded set of sampled pivots (its cell); a cell's
vectors, in chunks of bounded size, are bulk-loaded into M-trees: paged nodes with a routing object, a covering radius
and the distance to the parent's routing object. The inner product of a query q with anything below a node with
routing object c and radius r is at most q.c + |q| * r, and q.c is at most q.p + |q| * d(c, p) for the parent's routing
object p; the same holds for single vectors in a leaf. Nodes are visited from the best bound down; stored parent
distances rule out nodes and vectors before their inner product is computed.

A query is first searched in its own cell; the k-th score found there is a bound with which only cells (and then
nodes) that may hold a better or equal score are searched. Scores are exact integers.

Defined cases: vectors that are null or hold null or non-finite components take no part, as query or candidate; only
vectors of equal length are compared; a query never meets rows with its own vec_id; repeated rows are candidates each;
ties go to the smaller vec_id; fewer than k candidates: all of them; further columns are ignored; an empty table
gives an empty result. Finite components so large that a score might not fit 64 bits raise an error.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TOP, SCALE = 20, 64
#: Sampled pivots at most; vectors of a tree; entries of a page; children of a node; queries of a block.
PIVOTS, TREE, PAGE, FAN, BLOCK = 1024, 4096, 192, 12, 128


def integers(vectors: list) -> np.ndarray:
    """floor(64 * x) of vectors of one length, as int64 (exact: x is a double, 64 a power of two)."""
    real = np.floor(np.array(vectors, np.float64) * SCALE)
    if real.size and float(np.abs(real).max()) ** 2 * real.shape[-1] >= 2.0**62:
        raise ValueError("components are too large: an integer inner product may not fit 64 bits")
    return real.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; by doubles where no sum can reach 2**53."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[-1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def build(vectors: np.ndarray, ids: np.ndarray) -> bytes:
    """An M-tree, as bytes. Nodes: (routing vector, radius, distance to parent, children or leaf rows)."""
    nodes: list[tuple] = []
    order: list[np.ndarray] = []
    real = vectors.astype(np.float64)

    def load(rows: np.ndarray, parent: np.ndarray | None) -> int:
        centre = real[rows].mean(0)
        d = np.sqrt(((real[rows] - centre) ** 2).sum(1))
        up = float(np.sqrt(((centre - parent) ** 2).sum())) if parent is not None else 0.0
        at = len(nodes)
        nodes.append(())
        if rows.size <= PAGE:
            rows, d = rows[np.argsort(-d, kind="stable")], np.sort(d)[::-1]
            begin = sum(o.size for o in order)
            order.append(rows)
            nodes[at] = (centre, float(d[0]), up, (), begin, begin + rows.size, d)
            return at
        picks = [int(d.argmax())]
        near = np.full(rows.size, np.inf)
        home = np.zeros(rows.size, np.int64)
        while len(picks) < FAN:
            e = np.sqrt(((real[rows] - real[rows[picks[-1]]]) ** 2).sum(1))
            closer = e < near
            near[closer], home[closer] = e[closer], len(picks) - 1
            picks.append(int(near.argmax()))
        parts = [rows[home == j] for j in range(len(picks))]
        parts = [p for p in parts if p.size]
        if len(parts) == 1:  # equal vectors: pages of them
            parts = np.array_split(rows, -(-rows.size // PAGE))
        nodes[at] = (centre, float(d.max()), up, tuple(load(p, centre) for p in parts), 0, 0, None)
        return at

    load(np.arange(len(vectors)), None)
    rows = np.concatenate(order)
    return pickle.dumps((nodes, vectors[rows], ids[rows]), protocol=5)


def search(tree: tuple, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """(scores, ids) per query of a block, and the inner products computed: the k best of a tree with a score of at least
    the query's `floor`, never its `own` id. Nodes come best first, by the largest bound of any query; a node or vector is
    computed only for the queries whose bounds still allow it.
    """
    nodes, vectors, ids = tree
    q = queries.astype(np.float64)
    size = np.sqrt((q * q).sum(1))
    slack = 1e-9 * (1 + size * (1 + float(np.sqrt((nodes[0][0] ** 2).sum())) + nodes[0][1]))  # for rounding, by the sizes of both
    floor = floor.astype(np.float64).copy()
    scores = [np.empty(0, np.int64) for _ in q]
    found = [np.empty(0, np.int64) for _ in q]
    top = q @ nodes[0][0]
    computed = len(q)
    heap = [(-float((top + size * nodes[0][1]).max(initial=-np.inf)), 0, np.arange(len(q)), top)]
    while heap:
        _, at, mine, here = heapq.heappop(heap)
        _, radius, _, children, begin, end, d = nodes[at]
        live = here + size[mine] * radius + slack[mine] >= floor[mine]
        mine, here = mine[live], here[live]
        if not mine.size:
            continue
        for c in children:
            centre, radius, up = nodes[c][:3]
            may = here + size[mine] * (up + radius) + slack[mine] >= floor[mine]  # by the stored parent distance alone
            some = mine[may]
            if not some.size:
                continue
            there = q[some] @ centre
            computed += some.size
            bound = there + size[some] * radius
            may = bound + slack[some] >= floor[some]
            if may.any():
                heapq.heappush(heap, (-float(bound[may].max()), c, some[may], there[may]))
        if end > begin:
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(size[mine] > 0, (floor[mine] - slack[mine] - here) / size[mine], -np.inf)
            able = int(np.searchsorted(-d, -float(least.min()), side="right"))  # vectors far enough out, for any query
            if not able:
                continue
            s = products(queries[mine], vectors[begin : begin + able])
            computed += s.size
            near = (s >= floor[mine][:, None]) & (ids[begin : begin + able][None, :] != own[mine][:, None])
            for i in np.flatnonzero(near.any(1)).tolist():
                x, hit = int(mine[i]), np.flatnonzero(near[i])
                all_, names = np.append(scores[x], s[i, hit]), np.append(found[x], ids[begin + hit])
                best = np.lexsort((names, -all_))[:k]
                scores[x], found[x] = all_[best], names[best]
                if best.size == k:
                    floor[x] = max(floor[x], float(scores[x][-1]))
    return scores, found, computed


def _cells(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the distance to it."""
    d2 = (vectors**2).sum(1)[:, None] - 2 * vectors @ pivots.T + (pivots**2).sum(1)[None, :]
    cell = d2.argmin(1)
    return cell, np.sqrt(((vectors - pivots[cell]) ** 2).sum(1))


def top_k(vectors: DataFrame, queries, k: int = TOP, seed: int = 29) -> DataFrame:
    """query_id, rank, vec_id, score of the rows for which the condition `queries` holds, against all rows."""
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(F.size("x") > 0).where(F.coalesce(sound, F.lit(False)))
    rows = rows.withColumn("dim", F.size("x"))
    n = rows.groupBy("dim").count().collect()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    total = sum(r["count"] for r in n)
    want = min(PIVOTS, max(4, total // (TREE // 2)))
    draw = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30))
    sample = rows.where(draw < min(1 << 30, int(want * 4 / total * (1 << 30)) + 1)).orderBy(draw, "vec_id").limit(want).select("dim", "x").collect()
    pivots = {r["dim"]: [np.zeros(r["dim"])] for r in n}  # one cell per length at least
    for r in sample:
        pivots[r["dim"]].append(np.floor(np.array(r["x"]) * SCALE))
    pivots = {d: np.array(p) for d, p in pivots.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors and one per length
    schema = "vec_id long, asks boolean, dim int, v binary, cell int, away double"

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, g in f.groupby("dim"):
                v = integers([np.asarray(a) for a in g["x"]])
                cell, away = _cells(v.astype(np.float64), shared.value[int(dim)])
                yield pd.DataFrame({"vec_id": g["vec_id"].to_numpy(), "asks": g["asks"].to_numpy(), "dim": dim, "v": [a.tobytes() for a in v], "cell": cell, "away": away})

    at = cut(rows.select("vec_id", "asks", "dim", "x").mapInPandas(placed, schema))
    cells = at.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    reach = {(r["dim"], r["cell"]): (r["radius"], -(-r["n"] // TREE)) for r in cells.collect()}  # a row per cell
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.ceil(F.col("n") / F.lit(TREE))).cast("int")

    def loaded(f: pd.DataFrame) -> pd.DataFrame:
        v = np.array([np.frombuffer(b, np.int64) for b in f["v"]])
        return pd.DataFrame({"dim": [f["dim"].iloc[0]], "cell": [f["cell"].iloc[0]], "chunk": [f["chunk"].iloc[0]], "tree": [build(v, f["vec_id"].to_numpy())]})

    at = at.join(F.broadcast(cells.select("dim", "cell", "n")), ["dim", "cell"]).withColumn("chunk", chunk)  # at most PIVOTS cells, and one per length
    trees = cut(at.select("vec_id", "dim", "cell", "chunk", "v").groupBy("dim", "cell", "chunk").applyInPandas(loaded, "dim int, cell int, chunk int, tree binary"))
    asks = at.where("asks").select("vec_id", "dim", "cell", "chunk", "v")
    first = _ask(asks.withColumn("floor", F.lit(float("-inf"))), trees, reach, pivots, k, home=True)
    first = cut(first)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
    asks = asks.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
    rest = _ask(asks, trees, reach, pivots, k, home=False)
    return first.unionByName(rest).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ask(asks: DataFrame, trees: DataFrame, reach: dict, pivots: dict, k: int, home: bool) -> DataFrame:
    """Results of blocks of queries in the trees of their own cells (`home`), or of all others that their bounds allow."""

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, g in frame.groupby("dim"):
                for lo in range(0, len(g), BLOCK):
                    b = g.iloc[lo : lo + BLOCK]
                    v = np.array([np.frombuffer(a, np.int64) for a in b["v"]])
                    size = np.sqrt((v.astype(np.float64) ** 2).sum(1))
                    near = v.astype(np.float64) @ pivots[int(dim)].T
                    sizes = np.sqrt((pivots[int(dim)] ** 2).sum(1))
                    out = []
                    for cell in range(near.shape[1]):
                        if (int(dim), cell) not in reach:
                            continue
                        radius, chunks = reach[int(dim), cell]
                        own = b["cell"].to_numpy() == cell
                        some = own if home else ~own & (near[:, cell] + size * radius + 1e-9 * (1 + size * (1 + sizes[cell] + radius)) >= b["floor"].to_numpy())
                        if some.any():
                            body = pickle.dumps((v[some], b["vec_id"].to_numpy()[some], b["floor"].to_numpy()[some]), protocol=5)
                            out += [(int(dim), cell, c, body) for c in range(chunks)]
                    if out:
                        yield pd.DataFrame(out, columns=["dim", "cell", "chunk", "asked"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, body in zip(batch.column(0), batch.column(1), strict=True):
                tree = pickle.loads(blob.as_py())
                cols: list[list] = [[], [], []]
                queries, own, floor = pickle.loads(body.as_py())
                scores, found, _ = search(tree, queries, own, k, floor)
                for o, s, ids in zip(own.tolist(), scores, found, strict=True):
                    cols[0] += [o] * len(ids)
                    cols[1] += ids.tolist()
                    cols[2] += s.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    blocks = asks.repartition("dim", "cell", "chunk").drop("chunk").mapInPandas(routed, "dim int, cell int, chunk int, asked binary")
    return trees.join(blocks, ["dim", "cell", "chunk"]).select("tree", "asked").mapInArrow(answered, "query_id long, vec_id long, score long")
