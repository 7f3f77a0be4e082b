"""Mixing sources to target weights.

Each source's documents are laid end to end in hashed order and cut into blocks of a fixed number of words. A source's
target (its weight's share of all words, at most `max_repeats` times its own size, excess reshared by weight) fixes how
many blocks it gives: its slots. Output shards have a fixed number of slots (the last one what is left); for one shard after
the other the counts of the sources are drawn from a multinomial by the slots each has left. Slot j of a source takes
block perm_e(j mod n), where e = j div n counts whole passes over the source's n blocks and perm_e is a keyed
pseudorandom permutation (a Feistel network with cycle walking). Slots and blocks meet in an equi-join on (source,
block index). The last slot of a source is trimmed, so its words meet its target exactly.

Defined cases: null text has size 0; null source is a source of its own, last; repeated rows count once per row; a
source without words has target 0; documents without words are taken 0 times; an empty table gives an empty result;
further columns are ignored. Everything is a function of ids, sizes and the seed: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, freed, quoted, small_batches, text_bytes, word_spans

BLOCK_WORDS, SHARD_BLOCKS, MAX_REPEATS, SEED = 256, 4096, 3, 41
WEIGHTS = (1, 2, 3)
#: Shards whose counts are drawn together, after those of all such groups.
GROUP = 256
_FAN = 128  # of the two-level prefix sums

WORD = "[^\\x20\\x09-\\x0D]+"


def _feistel(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of range(n), or its inverse, elementwise, by cycle walking over the next even power of two."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, wide = np.uint64((1 << half) - 1), np.uint64(half)

    def round_(v: np.ndarray, r: int) -> np.ndarray:
        f = v * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0x2545F4914F6CDD1D + r * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
        f ^= f >> np.uint64(29)
        f *= np.uint64(0xBF58476D1CE4E5B9)
        return (f ^ (f >> np.uint64(32))) & mask

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> wide, v & mask
        for r in range(3, -1, -1) if inverse else range(4):
            left, right = (right ^ round_(left, r), left) if inverse else (right, left ^ round_(right, r))
        return (left << wide) | right

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _key(source_no: int, turn: int, seed: int) -> int:
    return (source_no * 1_000_003 + turn * 7919 + seed) & 0xFFFFFFFF


def permuted(slots: np.ndarray, blocks: int, source_no: int, seed: int = SEED) -> np.ndarray:
    """Block index of each slot: within each pass over the blocks, a permutation of its own."""
    out = np.empty(slots.size, np.int64)
    turns = slots // blocks
    for e in np.unique(turns).tolist():
        at = turns == e
        out[at] = _feistel(slots[at] % blocks, blocks, _key(source_no, e, seed))
    return out


def plan_slots(target: int, size: int, block: int, source_no: int, seed: int = SEED) -> tuple[int, int]:
    """(slots, words of the last one) with which a source of `size` words gives exactly `target` words.

    Whole passes give `size` words each. In the last, partial pass blocks come permuted; only the tail block is short,
    and the inverse permutation says when it comes.
    """
    if target <= 0 or size <= 0:
        return 0, 0
    blocks = -(-size // block)
    passes, rest = divmod(target, size)
    if not rest:
        return passes * blocks, block
    tail = size - (blocks - 1) * block
    place = int(_feistel(np.array([blocks - 1]), blocks, _key(source_no, passes, seed), inverse=True)[0])
    before = place * block
    if rest <= before:
        n = -(-rest // block)
        return passes * blocks + n, rest - (n - 1) * block
    if rest <= before + tail:
        return passes * blocks + place + 1, rest - before
    n = -(-(rest - before - tail) // block)
    return passes * blocks + place + 1 + n, rest - before - tail - (n - 1) * block


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _laid_out(sized: DataFrame) -> DataFrame:
    """Adds `place`: words of the source before this row, in hashed order; two-level prefix sums, no task holds a source."""
    h = F.xxhash64("doc_id", F.lit(SEED))
    rows = sized.withColumn("b1", F.pmod(h, F.lit(_FAN)).cast("int")).withColumn("b2", F.pmod(F.shiftright(h, 20), F.lit(_FAN)).cast("int"))
    low = rows.groupBy("source_no", "b1", "b2").agg(F.sum("size").alias("s"))
    high = low.groupBy("source_no", "b1").agg(F.sum("s").alias("s"))
    before = lambda *by: F.coalesce(F.sum("s").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    high = high.select("source_no", "b1", before("source_no", "b1").alias("o1"))
    low = low.select("source_no", "b1", "b2", before("source_no", "b1", "b2").alias("o2")).join(high, ["source_no", "b1"])
    offsets = low.select("source_no", "b1", "b2", (F.col("o1") + F.col("o2")).alias("base"))
    w = Window.partitionBy("source_no", "b1", "b2").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("inner", F.coalesce(F.sum("size").over(w), F.lit(0)))
    return inner.join(offsets, ["source_no", "b1", "b2"]).withColumn("place", F.col("base") + F.col("inner")).drop("b1", "b2", "base", "inner")


def weighed(sized: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_no, source_size, target) of every source: all sizes shared by weight, none above max_repeats times its own.

    Targets are min(weight * level, cap) at the one level where they add up to all sizes: the largest that stays within the
    sources it is shared among, if those of smaller ratio cap / weight stop at their caps. It follows from running
    sums over the sources in order of cap / weight. Only rows of one per source are sorted in one task.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    no = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("source_no", no).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("source_no") % len(weights) + 1))
    per = per.withColumn("cap", F.col("source_size").cast("double") * max_repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", "source_no")
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(every) - before) / rest)
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every), F.lit(float("inf")))
    return per.withColumn("least", level).select("source", "source_no", "source_size", F.least(F.col("weight") * F.col("least"), "cap").alias("target"))


def dealt(slots: np.ndarray, lengths: list[int], rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Counts per source for one length after the other: multinomial by what each source has left, and never more than that."""
    left = slots.copy()
    for length in lengths:
        counts = np.zeros_like(left)
        while (want := min(length, int(left.sum())) - int(counts.sum())) > 0:
            rest = left - counts
            counts = np.minimum(left, counts + rng.multinomial(want, rest / rest.sum()))
        left -= counts
        yield counts


def _mix(sized: DataFrame, block: int, shard_blocks: int, weights: tuple, max_repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """`mix`, from (row_no, doc_id, source, size); row numbers have to be the same on every reading."""

    def planned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [plan_slots(min(round(t), max_repeats * n), n, block, no, seed) for no, n, t in zip(frame["source_no"].tolist(), frame["source_size"].tolist(), frame["target"].tolist(), strict=True)]
            frame["blocks"] = -(-frame["source_size"] // block)
            frame["slots"], frame["last_words"] = [r[0] for r in rows], [r[1] for r in rows]
            yield frame

    sources = weighed(sized, weights, max_repeats)
    sources = cut(sources.mapInPandas(planned, "source string, source_no int, source_size long, target double, blocks long, slots long, last_words long"))
    numbered = sized.join(sources.select(F.col("source").alias("of"), "source_no", "source_size", "target"), sized["source"].eqNullSafe(F.col("of"))).select("row_no", "doc_id", "size", "source_no", "source_size", "target")
    placed = _laid_out(numbered)
    parts = placed.where("size > 0").select(
        "row_no", "doc_id", "source_no", "size", "place", F.explode(F.sequence(F.floor(F.col("place") / block), F.floor((F.col("place") + F.col("size") - 1) / block))).alias("index")
    )
    parts = parts.withColumn("lo", F.greatest(F.lit(0), F.col("index") * block - F.col("place"))).withColumn("hi", F.least(F.col("size"), (F.col("index") + 1) * block - F.col("place")))
    parts = parts.withColumn("at", F.col("place") + F.col("lo") - F.col("index") * block)
    total = int(sources.agg(F.sum("slots")).first()[0] or 0)

    def lengths(begin: int, end: int, size: int) -> list[int]:
        """Slots of the shards, or groups of shards, of `size` slots each from `begin` on; `end` ends the last one."""
        return [min(size, end - at) for at in range(begin, end, size)]

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of each group of shards, and of each shard within its group."""
        rows = pd.concat([*frames, pd.DataFrame({"source_no": [], "slots": []}, dtype="int64")]).sort_values("source_no")
        no, slots = rows["source_no"].to_numpy(np.int64), rows["slots"].to_numpy(np.int64)
        first = np.zeros_like(slots)
        for g, counts in enumerate(dealt(slots, lengths(0, int(slots.sum()), GROUP * shard_blocks), np.random.default_rng([seed, 1]))):
            some = counts > 0
            yield pd.DataFrame({"group": g, "source_no": no[some], "first": first[some], "n": counts[some]})
            first = first + counts

    def drawn_within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_no")
        g, no, first, n = int(rows["group"].iloc[0]), rows["source_no"].to_numpy(), rows["first"].to_numpy().copy(), rows["n"].to_numpy()
        out = []
        for k, counts in enumerate(dealt(n, lengths(0, int(n.sum()), shard_blocks), np.random.default_rng([seed, 2, g]))):
            some = counts > 0
            out.append(pd.DataFrame({"source_no": no[some], "shard": g * GROUP + k, "first": first[some], "n": counts[some]}))
            first += counts
        return pd.concat(out)

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.empty(len(frame), np.int64)
            for (no, blocks), at in frame.groupby(["source_no", "blocks"]).indices.items():
                out[at] = permuted(frame["slot"].to_numpy()[at], int(blocks), int(no), seed)
            frame["index"] = out
            yield frame

    counts = sources.where("slots > 0").select("source_no", "slots").coalesce(1).mapInPandas(drawn, "group long, source_no int, first long, n long")  # a row per source
    counts = counts.groupBy("group").applyInPandas(drawn_within, "source_no int, shard long, first long, n long")
    slots = counts.select("source_no", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    slots = slots.repartition("shard", "source_no").join(sources.select("source_no", "blocks", F.col("slots").alias("of"), "last_words"), "source_no")
    slots = slots.withColumn("cap", F.when(F.col("slot") == F.col("of") - 1, F.col("last_words")).otherwise(F.lit(block)))
    slots = slots.select("source_no", "shard", "slot", "blocks", "cap").mapInPandas(mapped, "source_no int, shard long, slot long, blocks long, cap long, index long")
    slots = slots.withColumn("turn", F.floor(F.col("slot") / F.col("blocks")).cast("int")).drop("blocks")
    if not total:
        slots = slots.where("false")
    pieces = parts.join(slots, ["source_no", "index"]).withColumn("n_words", F.least(F.col("hi") - F.col("lo"), F.col("cap") - F.col("at"))).where("n_words > 0")
    pieces = pieces.select("row_no", "doc_id", "source_no", "shard", "slot", "turn", F.col("lo").alias("first_word"), "n_words")
    taken = pieces.groupBy("row_no").agg(F.sum("n_words").alias("taken"))
    documents = numbered.join(taken, "row_no", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return documents, pieces


def mix(docs: DataFrame, block: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: doc_id, size, source_size, target, taken, one row per row of `docs`.
    pieces: row_no, doc_id, source_no, shard, slot, turn, first_word, n_words: which words of which row the mix holds,
    where, and in which pass over the source. row_no numbers the rows as they were read, once.
    """
    sized = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    return _mix(cut(sized), block, shard_blocks, weights, max_repeats, seed)


def taken_words(body: np.ndarray, first: np.ndarray, n: np.ndarray) -> bytes:
    """The words of a text (bytes) in the ranges given, in order, each with the white space before it but for the first; of a
    text taken whole, all of it."""
    starts, ends = word_spans(body, np.zeros(1, np.int64))
    if int(n.sum()) == starts.size:
        return body.tobytes()
    before = np.append(0, ends[:-1])
    out = b"".join(body[before[a] : ends[a + k - 1]].tobytes() for a, k in zip(first.tolist(), n.tolist(), strict=True))
    return out.lstrip(b" \t\n\x0b\x0c\r")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """`docs` as the mix holds them: one row per row and pass that takes words of it, `text` cut to those words (`taken_words`).

    Rows are numbered and written once, and read from there; all columns pass through, whatever their names.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    row = F.struct(*((F.col(quoted(c)).cast("string") if c == "text" else F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(names)))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row_no"), row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")))
    sized = cut(rows.select("row_no", "doc_id", "source", word_count(F.col(f"row.c{at}")).alias("size")))
    _, pieces = _mix(sized, BLOCK_WORDS, SHARD_BLOCKS, WEIGHTS, MAX_REPEATS, SEED)
    took = pieces.groupBy("row_no", "turn").agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("took"))
    both = rows.select("row_no", "row").join(took, "row_no").select("row.*", "took")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, body = text_bytes(batch.column(at))
            pairs = batch.column(len(names))
            first, n = (pairs.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
            ends = np.append(0, np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False)))
            texts = [taken_words(body[offsets[i] : offsets[i + 1]], first[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]]) for i in range(batch.num_rows)]
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(len(names))], [f"c{i}" for i in range(len(names))])

    kinds = ", ".join(f"c{i} {both.schema[i].dataType.simpleString()}" for i in range(len(names)))
    out = both.mapInArrow(lambda b: freed(taken(b)), kinds)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
