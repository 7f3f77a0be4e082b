"""Shared helpers of the training-data operators: table access, lineage cuts, bounded samples, byte-level hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR = "/tmp/checkpoints"
#: Bytes of an Arrow batch.
BATCH = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's `spark.checkpoint.dir`; where it is unset, one of our own in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a shared folder")
        folder = _OWN_DIR
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts hold at most BATCH bytes (one row at least), unless the session sets a limit of its own."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
    if spark.conf.get(key).rstrip("b") == str(default):
        spark.conf.set(key, str(BATCH))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of `df`: a reliable checkpoint in the folder all executors share.

    Spark removes a checkpoint that nothing refers to any more if `spark.cleaner.referenceTracking.cleanCheckpoints`
    is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo `modulus` (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def bounded_sample(rows: DataFrame, label: str, per_label: int, seed: int) -> tuple[DataFrame, dict]:
    """About `per_label` rows of each value of `label`, twice as many at most, chosen by hashed doc_id.

    Returns the chosen rows (lazy) and the number of rows per label in the whole input. The hash makes the choice
    independent of partitioning; past the bound, rows go by hash, doc_id and text.
    """
    counted = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row per label
    if not counted:
        return rows.where("false"), counted
    kind = rows.schema[label].dataType.simpleString()
    shares = [(value, min(1 << 30, int(per_label / n * (1 << 30)) + 1)) for value, n in counted.items()]
    shares = rows.sparkSession.createDataFrame(shares, f"{label} {kind}, share long")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30))
    first = Window.partitionBy(label).orderBy(draw, "doc_id", *(c for c in rows.columns if c not in (label, "doc_id")))
    few = rows.join(F.broadcast(shares), label).where(draw < F.col("share")).drop("share").select(*rows.columns)
    return few.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= 2 * per_label).drop("turn"), counted


def labelled_texts(docs: DataFrame, labels: DataFrame, per_class: int, seed: int) -> tuple[DataFrame, dict]:
    """(doc_id, text, label 0/1): whole texts of a bounded sample of labelled documents, one row each; and the rows per label.

    Null labels, and 0 and 1 for one doc_id, count for nothing; of different texts of one doc_id the smallest is taken.
    """
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    sample, counted = bounded_sample(known, "label", per_class, seed)
    chosen = labels.sparkSession.createDataFrame([tuple(r) for r in sample.select("doc_id", "label").collect()], "doc_id long, label int")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), counted


def map_texts(docs: DataFrame, compute: Callable[[pa.Array], list[pa.Array]], added: str) -> DataFrame:
    """`docs` with the columns `added` ("name type, ..."), computed from batches of `text`; a column of such a name is replaced."""
    small_batches(docs.sparkSession)
    names, new = docs.columns, [c.split()[0] for c in added.split(", ")]
    own = docs.select([F.col(quoted(c)).cast("string").alias(f"c{i}") if c == "text" else F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])
    at, outs = names.index("text"), [*(f"c{i}" for i in range(len(names))), *new]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch.column(at))], outs)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    out = own.mapInArrow(lambda b: freed(mapped(b)), f"{schema}, {added}")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in new), *new)


# ---------------------------------------------------------------- hashing of words, vectorised over bytes

_M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD1342543DE82EF95)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes of texts that are parsed at once; a longer text is parsed alone, in segments. Bytes of a word that are hashed by lanes.
CHUNK, _LONG_WORD = 1 << 18, 512


def _spaces(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def _lowered(buf: np.ndarray) -> np.ndarray:
    return buf + (((buf >= 65) & (buf <= 90)).view(np.uint8) << np.uint8(5))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which is faster here than a hash table)."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if values.size else values


@dataclass
class Words:
    """The words (maximal runs of bytes other than \\x20 and \\x09-\\x0D) of some texts, in order."""

    hashes: np.ndarray  # 64-bit, by all bytes of the word
    bounds: np.ndarray  # of each text, its first word; then the number of words
    line: np.ndarray  # of each word, the number of its line (after \\n) in its text
    digit: np.ndarray  # whether it holds a digit

    def owner(self) -> np.ndarray:
        """Of each word, the number of its text."""
        return np.repeat(np.arange(self.bounds.size - 1), np.diff(self.bounds))


def word_spans(buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it; no word crosses one of `begins`, where texts begin."""
    space = _spaces(buf)
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    begins = begins[begins < buf.size]
    first[begins] = ~space[begins]
    before = begins[begins > 0] - 1
    last[before] = ~space[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, eight bytes at a time."""
    padded = np.zeros(buf.size + 8, np.uint8)
    padded[:-8] = buf
    lanes = np.ndarray((buf.size + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix64((lanes[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _STEP)
    more, at = np.flatnonzero(size > 8), 8
    while more.size and at < _LONG_WORD:
        out[more] = mix64((out[more] ^ (lanes[starts[more] + at] & _MASK[np.minimum(size[more] - at, 8)])) * _ODD)
        at += 8
        more = more[size[more] > at]
    for i in more.tolist():
        rest = hashlib.blake2b(buf[starts[i] + at : ends[i]], digest_size=8).digest()
        out[i] = mix64(out[i : i + 1] ^ np.frombuffer(rest, "<u8"))[0]
    return out


def _parsed(buf: np.ndarray, begins: np.ndarray) -> Words:
    starts, ends = word_spans(buf, begins)
    bounds = np.append(np.searchsorted(starts, begins), starts.size)
    newline = np.flatnonzero(buf == 10)
    line = np.searchsorted(newline, starts) - np.repeat(np.searchsorted(newline, begins), np.diff(bounds))
    digit = np.zeros(starts.size, bool)
    digit[np.searchsorted(starts, np.flatnonzero((buf >= 48) & (buf <= 57)), side="right") - 1] = True
    return Words(_hashed(buf, starts, ends), bounds, line, digit)


def _segments(buf: np.ndarray) -> Iterator[np.ndarray]:
    """Bounded parts of a text; a word is never cut."""
    begin = 0
    while begin < buf.size:
        end = min(buf.size, begin + CHUNK)
        while end < buf.size and not _spaces(buf[end : end + 1])[0]:
            step = buf[end : end + 65536]
            stop = np.flatnonzero(_spaces(step))
            end += int(stop[0]) if stop.size else step.size
        yield buf[begin:end]
        begin = end


def _parsed_alone(buf: np.ndarray) -> Words:
    done, before = [], 0
    for part in _segments(buf):
        w = _parsed(part, np.zeros(1, np.int64))
        w.line += before
        before += int((part == 10).sum())
        done.append(w)
    joined = [np.concatenate([getattr(w, f) for w in done]) for f in ("hashes", "line", "digit")]
    return Words(joined[0], np.array([0, joined[0].size]), joined[1], joined[2])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return at - at[0], body[at[0] : at[-1]]


def words_of(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(row of the first text, row after the last, words) of whole texts, about CHUNK bytes at a time; `lower` lower-cases A-Z."""
    offsets, body = text_bytes(texts)
    row, n = 0, offsets.size - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        buf = body[offsets[row] : offsets[end]]
        buf = _lowered(buf) if lower else buf
        yield row, end, _parsed(buf, offsets[row:end] - offsets[row]) if buf.size <= CHUNK else _parsed_alone(buf)
        row = end


def freed(batches: Iterator) -> Iterator:
    """The same batches; when they end, what the task has freed goes back to the system, as the worker lives on."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where there is no such C library
            ctypes.CDLL(None).malloc_trim(0)


_SHIFT = mix64(np.arange(101, 164, dtype=np.uint64) * _STEP) | np.uint64(1)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` words in a row; of all words if there are fewer."""
    take = min(width, words.size)
    last = words.size - take + 1
    total = words[:last] * _SHIFT[0]
    for j in range(1, take):
        total += mix64(words[j : j + last] * _SHIFT[j])
    return mix64(total + np.uint64(take))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct hashes of its `width`-word shingles, A-Z lower-cased.

    Fewer words than `width`: the whole sequence is one shingle. No words or a null text: empty.
    """
    none = np.empty(0, np.uint64)
    for _, _, w in words_of(texts, lower=True):
        every = _shingles(w.hashes, width) if w.hashes.size else none  # some cross texts; those are left out
        for begin, end in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            if end - begin >= width:
                yield distinct(every[begin : end - width + 1])
            else:
                yield _shingles(w.hashes[begin:end], width) if end > begin else none


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.large_string()), width))


# ---------------------------------------------------------------- a bounded filter of ids

_BITS_PER_ID, _MAX_BITS, _BIT_CHUNKS = 16, 28, 16


class IdFilter:
    """Says of any id whether it may be among the given ones: one hashed bit each, in a fixed most of 2**28 bits (32 MB).

    It only spares rows a shuffle; what it lets through is joined exactly. Beyond its size it lets more through.
    """

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        at = _bit_places(ids, self.log2)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bit_places(ids: np.ndarray, log2: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64) + _STEP) >> np.uint64(64 - log2)).astype(np.int64)


def id_filter(ids: DataFrame) -> IdFilter:
    """Of the first column (long, not null) of `ids`; only the bits reach the driver."""
    log2 = int(min(_MAX_BITS, max(10, np.ceil(np.log2(max(1, ids.count()) * _BITS_PER_ID)))))
    size = (1 << log2) // 8 // _BIT_CHUNKS
    kind = "chunk int, bits binary"

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << log2) // 8, np.uint8)
        for batch in batches:
            at = _bit_places(batch.column(0).to_numpy(zero_copy_only=False), log2)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(range(_BIT_CHUNKS), pa.int32()), pa.array([zlib.compress(b.tobytes(), 1) for b in bits.reshape(_BIT_CHUNKS, size)], pa.binary())], ["chunk", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(body), np.uint8)
                total[chunk] = total[chunk] | part if chunk in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(t.tobytes(), 1) for t in total.values()], pa.binary())], ["chunk", "bits"])

    out = np.zeros((_BIT_CHUNKS, size), np.uint8)
    for r in ids.mapInArrow(marked, kind).repartition(_BIT_CHUNKS, "chunk").mapInArrow(merged, kind).collect():  # _BIT_CHUNKS rows
        out[r["chunk"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return IdFilter(out.reshape(-1), log2)


def where_may_hold(df: DataFrame, column: str, which: IdFilter, no: bool = False) -> DataFrame:
    """Rows whose `column` (long, not null) the filter may hold; with `no`, those it doesn't."""
    shared = df.sparkSession.sparkContext.broadcast(which)

    def held(ids: pd.Series) -> pd.Series:
        return pd.Series(shared.value.may_hold(ids.to_numpy(np.int64)) ^ no)

    return df.where(F.col(column).isNotNull()).where(F.pandas_udf(held, "boolean")(F.coalesce(F.col(column), F.lit(0))))


def by_group(df: DataFrame, keys: int, work: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """`work(key, rows)` on each group of the first `keys` columns; groups stream through sorted partitions, one at a time."""
    names = df.columns[:keys]
    columns = schema.split(", ")
    kinds = pa.schema([pa.field(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[c.split()[1]]) for c in columns])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, rows = [], None, []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:keys] != key:
                    if rows:
                        out += work(key, rows)
                    key, rows = row[:keys], []
                rows.append(row)
            if len(out) > 10_000:
                yield batch()
        if rows:
            out += work(key, rows)
        yield batch()

    return df.repartition(*names).sortWithinPartitions(*names).mapInArrow(streamed, schema)
