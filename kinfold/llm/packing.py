"""Sequence packing along a space-filling curve.

A document's vector of hashed byte n-grams is projected to four dimensions and placed on a Hilbert curve; documents
are range-sorted by that key (then doc_id, so copies of one text still spread over partitions) and laid end to end,
so neighbours on the curve share sequences. Each range is cut every `block` tokens; what is left at its end is cut
into power-of-two sequences, which need no padding.

Defined cases: null text counts as empty (its document is the closing id 0 alone); repeated rows are packed once per
row; ties of the key go by doc_id; further columns are ignored; an empty table gives no pieces. Texts of any length are
tokenised whole; only the open sequence's pieces are held.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, small_batches

BLOCK = 1024
DIMENSIONS, BITS, BUCKETS = 4, 12, 1 << 11
#: Distinct space-delimited words whose ids a task remembers at most, and their characters.
REMEMBERED, SHORT = 100_000, 32
#: Bytes of texts to aim at in a range of the curve.
RANGE_BYTES = 64 << 20

#: A space before other white space: the pre-tokeniser may then join what a split at spaces parts.
_UNEVEN = re.compile(r" \s")
_SIGNS = np.random.default_rng(7).choice(np.array([-1.0, 1.0], np.float32), (BUCKETS, DIMENSIONS))


class Encoder:
    """Ids of a whole text under the byte-level BPE, as little-endian unsigned 32-bit integers.

    The vocabulary is read as ranks; a text whose spaces all stand before a non-space splits into ' word' pieces exactly where the
    vocabulary's pre-tokeniser splits too, so ids of words can be remembered. Other texts are encoded directly. The strings
    of `special` tokens part a text; each is its one id.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.special and any(t in text for t in self.special):
            return b"".join(np.array([self.special[t]], "<u4").tobytes() if t in self.special else self.plain(t) for t in self.parts.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0].isspace() or text[-1].isspace() or _UNEVEN.search(text):
            return self.direct(text)
        first, *words = text.split(" ")
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = [self.direct(first)]
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = self.direct(" " + word)
                if len(word) <= SHORT:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


def default_encoder() -> Encoder:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special)


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index of each row of non-negative integers (< 2**bits) along the Hilbert curve of as many dimensions as columns."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo excess work of the transposed form, from the high bit down
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def document_points(text: str | None) -> np.ndarray:
    """The whole text's hashed byte 4-gram vector, at unit length, projected by fixed signs to the curve's grid."""
    data = text.encode("utf-8", "replace") if text else b""
    counts = np.zeros(BUCKETS, np.int64)
    for begin in range(0, len(data), 1 << 20):
        x = np.frombuffer(data[begin : begin + (1 << 20) + 3], np.uint8)
        if x.size >= 4:
            gram = x[:-3].astype(np.uint32) | (x[1:-2].astype(np.uint32) << np.uint32(8)) | (x[2:-1].astype(np.uint32) << np.uint32(16)) | (x[3:].astype(np.uint32) << np.uint32(24))
            counts += np.bincount((gram * np.uint32(0x9E3779B1)) >> np.uint32(21), minlength=BUCKETS)
    v = counts.astype(np.float32)
    size = float(np.sqrt(v @ v))
    p = v @ _SIGNS / size if size else np.zeros(DIMENSIONS, np.float32)
    return np.clip((np.tanh(p / 6) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def curve_keys(texts: pd.Series) -> pd.Series:
    points = [document_points(t) for t in texts]
    return pd.Series(hilbert_index(np.array(points).reshape(-1, DIMENSIONS)))


def _schema(with_ids: bool) -> str:
    return "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids


def pack(docs: DataFrame, block: int = BLOCK, with_ids: bool = True, encoder=default_encoder) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence; `ids` holds them (little-endian uint32).

    The text itself moves to its range (one shuffle); tokenising and packing happen there, in one pass.
    """
    kind = pa.schema([pa.field(n.split()[0], pa.binary() if n.split()[1] == "binary" else pa.int64()) for n in _schema(with_ids).split(", ")])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        next_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        rows: list[tuple] = []  # of complete sequences
        open_: list[list] = []  # pieces of the open one: doc_id, start, ids, doc_tokens
        filled = 0

        def close(pieces: list) -> None:
            nonlocal next_id
            at = 0
            for doc_id, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc_id, start, n, zlib.crc32(ids), total, next_id, at, *((ids,) if with_ids else ())))
                at += n
            next_id += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kind]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(encode(text or "") + b"\0\0\0\0")
                total, start = len(ids) // 4, 0
                while start < total:
                    n = min(block - filled, total - start)
                    open_.append([doc_id, start, bytes(ids[4 * start : 4 * (start + n)]), total])
                    start, filled = start + n, filled + n
                    if filled == block:
                        close(open_)
                        open_, filled = [], 0
                if len(rows) > 20_000:
                    yield batch()
        while filled:  # the rest of the range: power-of-two sequences
            want = 1 << (filled.bit_length() - 1)
            filled -= want
            now: list[list] = []
            while want:
                doc_id, start, ids, total = open_.pop(0)
                n = len(ids) // 4
                if n > want:
                    open_.insert(0, [doc_id, start + want, ids[4 * want :], total])
                    ids, n = ids[: 4 * want], want
                now.append([doc_id, start, ids, total])
                want -= n
            close(now)
        if rows:
            yield batch()

    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # repeated rows differ in their place in the scan, so they spread over ranges too
    placed = own.withColumn("place", F.monotonically_increasing_id()).withColumn("curve_key", F.pandas_udf(curve_keys, "long")("text"))
    along = ("curve_key", "doc_id", "place")
    ranges = -(-int(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)
    fixed = (ranges,) if ranges > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()
    ranged = placed.repartitionByRange(*fixed, *along).sortWithinPartitions(*along)
    return ranged.select("doc_id", "text").mapInArrow(lambda b: freed(packed(b)), _schema(with_ids))
