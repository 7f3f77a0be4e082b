"""Line dedup with a log-template tree of fixed depth.

A line (between newlines) is parsed into words; words that hold a digit are variable fields. The tree's levels are
the number of words and the first DEPTH words; a leaf holds the lines that agree on these. Within a leaf, lines are
matched, most frequent first, to templates: a line joins the template with which the largest share of places agrees,
at least SIMILAR, and places where they differ become variable fields. A template is recurring if at least
`min_documents` different doc_ids carry it, or LONG_DOCUMENTS if it has LONG or more words; its lines are then dropped
from every document but the one of smallest doc_id.
A leaf of any size is matched as one: past SCAN templates, only templates that agree with the line on all places of at
least one block are looked at, with one block more than places may differ, so no match is lost.

Passages within lines are the second part: every run of PASSAGE words that two documents share word for word, wherever
it stands in lines, stays in the document of smallest doc_id and is cut from the others. Of any PASSAGE words in a row,
the smallest hash of MARK words is a mark, so documents that share such a run share a mark; only runs around marks of
several rows are compared, by all their words. Runs of a mark travel together; those of a mark of more than HOT rows
travel one by one and are aggregated before they move, so no task holds the rows of a very common passage.

`dedup` drops lines, `drop_passages` cuts passages, `clean` does both, each found in the texts as given.

Defined cases: lines that don't reach the tree's depth (fewer than DEPTH words; they meet by chance in any prose) and lines
of variable fields alone have no template and are kept; null text stays null; an
empty text stays empty; a document is counted once per template, however many of its lines or rows carry it; a row
without doc_id keeps all and counts for nothing; a text keeps its other lines, in order, joined by newlines, and blanks
after a cut passage go; further columns pass through, but for those named like an added one, which are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, freed, id_filter, mix64, quoted, small_batches, text_bytes, where_may_hold, word_spans, words_of

DEPTH, MIN_DOCUMENTS, SIMILAR, SCAN = 3, 4, 0.8, 256
LONG, LONG_DOCUMENTS = 20, 2
PASSAGE, MARK, HOT = 50, 16, 1024
_FIELD = np.uint64(0x5DEECE66D)  # what stands for a variable field
_C = np.uint64(0x9E3779B97F4A7C15)
_LINE, _RUNS, _RUN = 0, 1, 2  # kinds of rows: a line, the runs of a mark, one run
_RUN_BYTES = 6  # of a run's hash that travel beside its mark
_FOUND = "kind int, doc_id long, text_key long, key long, at long, body binary, lines array<int>"


def _groups(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows sorted by a hash of all `parts`, and where in that order each different value begins."""
    key = np.zeros(parts[0].size, np.uint64)
    for p in parts:
        key = mix64((key ^ p.astype(np.int64).view(np.uint64)) + _C)
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.append(True, key[1:] != key[:-1])) if key.size else np.empty(0, np.int64)


class Lines:
    """The lines that have a template of some texts' words: text, number, leaf and key of each, and its words."""

    def __init__(self, w: Words):
        self.words = np.where(w.digit, _FIELD, w.hashes)
        owner = w.owner()
        starts = np.flatnonzero((np.diff(w.line, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        ends = np.append(starts[1:], owner.size) if starts.size else starts
        n = ends - starts
        if starts.size:
            places = np.arange(owner.size) - np.repeat(starts, n)
            mixed = mix64(self.words + places.astype(np.uint64) * _C)
            key = np.add.reduceat(mixed, starts)
            deep = np.logical_or.reduceat(~w.digit, starts) & (n >= DEPTH)
            starts, ends, n, key = starts[deep], ends[deep], n[deep], key[deep]
        else:
            mixed = key = np.empty(0, np.uint64)
        leaf = n.astype(np.uint64)
        for j in range(DEPTH):
            leaf += mixed[starts + j]
        leaf = mix64(leaf) & ~np.uint64(1) | (n >= LONG).astype(np.uint64)  # the lowest bit marks a leaf of long lines
        self.leaf, self.key, self.starts, self.ends = leaf.view(np.int64), key.view(np.int64), starts, ends
        self.text, self.line = owner[starts], w.line[starts]


def _signs(lines: bool, passages: bool) -> Callable:
    """(kind, key) of each text: leaves, once per different masked line, and different marks."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in words_of(batch.column(0)):
                found = []
                if lines:
                    x = Lines(w)
                    order, first = _groups(x.text, x.key)
                    found.append((_LINE, x.leaf[order[first]]))
                if passages:
                    starts, marks = _marked(w)[:2]
                    order, first = _groups(w.owner()[starts], marks)
                    found.append((_RUNS, marks[order[first]]))
                kinds = np.concatenate([np.full(k.size, kind, np.int32) for kind, k in found])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([k for _, k in found]))], ["kind", "key"])

    return lambda batches: freed(signs(batches))


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values, laid end to end in `values`, of `sizes` bytes each."""
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
    return pa.Array.from_buffers(pa.binary(), sizes.size, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if ends.size else 0) + np.repeat(starts - ends + sizes, sizes)


def _found(lines, marks, hot) -> Callable:
    """Rows of _FOUND: lines in leaves that may be busy, one per different masked line of a text with all its line numbers,
    and runs of PASSAGE words whose mark may be of several rows."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def rows(kind: int, ids: pa.Array, keys: pa.Array, text: np.ndarray, key: np.ndarray, at: np.ndarray, body: pa.Array | None, numbers: pa.Array | None) -> pa.RecordBatch:
        n, text = len(key), pa.array(text)
        cols = [pa.array(np.full(n, kind, np.int32)), ids.take(text), keys.take(text), pa.array(key), pa.array(at.astype(np.int64)), body, numbers]
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c for c, k in zip(cols, kinds, strict=True)], names)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            for row, end, w in words_of(batch.column(2)):
                ids, keys = batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row)
                if lines is not None:
                    x = Lines(w)
                    some = np.flatnonzero(lines.value.may_hold(x.leaf) & known[row + x.text])
                    order, first = _groups(x.text[some], x.key[some])
                    one = some[order[first]]  # the first line of each different one
                    sizes = x.ends[one] - x.starts[one]
                    numbers = pa.ListArray.from_arrays(pa.array(np.append(first, order.size).astype(np.int32)), pa.array(x.line[some[order]].astype(np.int32)))
                    yield rows(_LINE, ids, keys, x.text[one], x.leaf[one], x.key[one], _binary(x.words[_ranges(x.starts[one], sizes)], 8 * sizes), numbers)
                if marks is not None:
                    owner = w.owner()
                    starts, mark, size = _marked(w)
                    may = marks.value.may_hold(mark) & known[row + owner[starts]] if starts.size else np.empty(0, bool)
                    starts, mark, size = starts[may], mark[may], size[may]
                    if not starts.size:
                        continue
                    runs = _runs(w.hashes, PASSAGE)
                    busy = hot.value.may_hold(mark)
                    for kind, which in ((_RUNS, ~busy), (_RUN, busy)):
                        every = runs[_ranges(starts[which], size[which])]
                        if kind == _RUNS:
                            text = owner[starts[which]]
                            short = np.ascontiguousarray(every).view(np.uint8).reshape(-1, 8)[:, :_RUN_BYTES]
                            yield rows(kind, ids, keys, text, mark[which], starts[which] - w.bounds[text], _binary(short, _RUN_BYTES * size[which]), None)
                        elif every.size:
                            at = _ranges(starts[which], size[which])
                            yield rows(kind, ids, keys, owner[at], every.view(np.int64), at - w.bounds[owner[at]], None, None)

    return lambda batches: freed(found(batches))


_ANY = np.int64(-1)  # a variable field of a template


class Templates:
    """The templates of one leaf; all lines have the same number of words and are given in order."""

    def __init__(self, n_words: int, similar: float = SIMILAR, scan: int = SCAN):
        self.similar, self.scan, self.n = similar, scan, 0
        self.known = np.empty((8, n_words), np.int64)
        differ = max(d for d in range(n_words + 1) if (n_words - d) / n_words >= similar)
        begin = DEPTH if n_words - DEPTH > differ else 0  # the leaf's own words agree anyway
        self.blocks = [(int(b[0]), int(b[-1]) + 1) for b in np.array_split(np.arange(begin, n_words), differ + 1) if b.size]
        self.index: list[dict[bytes, list[int]]] | None = None

    def _enter(self, t: int) -> None:
        for (a, b), held in zip(self.blocks, self.index, strict=True):
            if (self.known[t, a:b] != _ANY).all():
                held.setdefault(self.known[t, a:b].tobytes(), []).append(t)

    def _near(self, w: np.ndarray) -> np.ndarray:
        if self.n <= self.scan:
            return np.arange(self.n)
        if self.index is None:
            self.index = [{} for _ in self.blocks]
            for t in range(self.n):
                self._enter(t)
        found = [held.get(w[a:b].tobytes(), ()) for (a, b), held in zip(self.blocks, self.index, strict=True)]
        return np.unique(np.concatenate([np.asarray(f, np.int64) for f in found]))

    def number(self, masked: bytes) -> int:
        """The template number of the next line; it opens a template if it is like none."""
        w = np.frombuffer(masked, "<i8")
        near = self._near(w)
        if near.size:
            share = (self.known[near] == w).mean(1)
            at = int(np.argmax(share))
            if share[at] >= self.similar:
                best = int(near[at])
                self.known[best][self.known[best] != w] = _ANY  # a variable field; stale index entries only add to look-ups
                return best
        if self.n == len(self.known):
            self.known = np.concatenate([self.known, np.empty_like(self.known)])
        self.known[self.n] = w
        self.n += 1
        if self.index is not None:
            self._enter(self.n - 1)
        return self.n - 1


def templates(masked: list[bytes], similar: float = SIMILAR, scan: int = SCAN) -> list[int]:
    """The template number of each masked line of one leaf, taken in order; all have the same number of words."""
    known = Templates(len(masked[0]) // 8, similar, scan) if masked else None
    return [known.number(m) for m in masked]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (leaf, line_key, masked), sorted by leaf and order, with template numbers for `masked`."""
    leaf, known = None, None
    for batch in batches:
        numbers = []
        for at, masked in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if at != leaf:
                leaf, known = at, Templates(len(masked) // 8)
            numbers.append(known.number(masked))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int64())], ["leaf", "line_key", "template"])


def _enough(min_documents: int) -> Column:
    """The documents a template of this row's leaf must have."""
    return F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, min(LONG_DOCUMENTS, min_documents)).otherwise(min_documents)


def recurring_lines(found: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, text_key, at, n): numbers of lines that go (n 0), from rows of lines (_FOUND)."""
    of = found.select(F.col("key").alias("leaf"), F.col("at").alias("line_key"), "doc_id", "text_key", "body", "lines")
    different = cut(of.groupBy("leaf", "line_key").agg(F.count("*").alias("rows"), F.first("body").alias("masked")))
    leaves = different.groupBy("leaf").agg(F.count("*").alias("different"))
    sized = different.join(leaves, "leaf")
    alone = sized.where("different = 1").select("leaf", "line_key", F.lit(0).cast("long").alias("template"))
    several = sized.where("different > 1").select("leaf", "line_key", "masked", "rows")
    ordered = several.repartition("leaf").sortWithinPartitions("leaf", F.desc("rows"), "line_key").drop("rows")
    templates_ = alone.unionByName(ordered.mapInArrow(lambda b: freed(_numbered(b)), "leaf long, line_key long, template long"))
    carried = cut(of.drop("body").join(templates_, ["leaf", "line_key"]).select("leaf", "template", "doc_id", "text_key", "lines"))
    total = carried.select("leaf", "template", "doc_id").distinct().groupBy("leaf", "template").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))
    total = total.withColumnRenamed("leaf", "key").where(F.col("documents") >= _enough(min_documents)).select(F.col("key").alias("leaf"), "template", "first")
    drop = carried.join(total, ["leaf", "template"]).where("doc_id <> first")
    return drop.select("doc_id", "text_key", F.explode("lines").alias("at"), F.lit(0).alias("n"))


# ---------------------------------------------------------------- passages within lines

_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, 1 << 17), _powers(pow(_BASE, -1, 1 << 64), 1 << 17)


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words; equal runs have equal hashes at any place."""
    if words.size < width:
        return np.empty(0, np.uint64)
    up, down = (_UP, _DOWN) if words.size <= _UP.size else (_powers(_BASE, words.size), _powers(pow(_BASE, -1, 1 << 64), words.size))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: words.size], dtype=np.uint64)])
    return mix64((total[width:] - total[:-width]) * down[: words.size - width + 1])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _marked(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of PASSAGE words, in stretches of equal mark within a text: first run, mark, number of runs."""
    if w.hashes.size < PASSAGE:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    mark = _smallest(_runs(w.hashes, MARK), PASSAGE - MARK + 1)
    owner = w.owner()
    inside = owner[: mark.size] == owner[PASSAGE - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (mark[1:] != mark[:-1]) | (owner[1 : mark.size] != owner[: mark.size - 1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | new[1:]
    starts = np.flatnonzero(new)
    return starts, mark[starts].view(np.int64), np.flatnonzero(last) + 1 - starts


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (mark, doc_id, text_key, at, body), sorted by mark: the stretches of runs that a smaller doc_id has too."""
    names = ["doc_id", "text_key", "at", "n"]
    held: list[pa.RecordBatch] = []
    size = 0

    def settled(rows: pa.Table) -> pa.RecordBatch:
        mark, doc, key, at = (rows.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(4))
        offsets, body = text_bytes(rows.column(4))
        n = np.diff(offsets) // _RUN_BYTES
        run = np.zeros((body.size // _RUN_BYTES, 8), np.uint8)
        run[:, :_RUN_BYTES] = body.reshape(-1, _RUN_BYTES)
        owner = np.repeat(np.arange(n.size), n)
        value = mix64(run.reshape(-1).view("<u8") ^ mix64(mark.view(np.uint64))[owner])
        by = np.lexsort((doc[owner], value))
        value, docs = value[by], doc[owner[by]]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if value.size else np.empty(0, np.int64)
        least = np.repeat(docs[first], np.diff(np.append(first, value.size)))
        again = np.zeros(value.size, bool)
        again[by[docs > least]] = True
        place = _ranges(at, n)
        begin, end = again.copy(), again.copy()
        same = owner[1:] == owner[:-1]
        begin[1:] &= ~(again[:-1] & same)
        end[:-1] &= ~(again[1:] & same)
        begin, end = np.flatnonzero(begin), np.flatnonzero(end)
        who = owner[begin]
        return pa.RecordBatch.from_arrays([pa.array(doc[who]), pa.array(key[who]), pa.array(place[begin].astype(np.int32)), pa.array((end + 1 - begin).astype(np.int32))], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < 1 << 20:
            continue
        rows = pa.Table.from_batches(held)
        mark = rows.column(0).to_numpy()
        ready = int(np.flatnonzero(mark != mark[-1])[-1]) + 1 if mark[0] != mark[-1] else 0  # all marks but the last are whole
        if ready:
            yield settled(rows.slice(0, ready))
            held = rows.slice(ready).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield settled(pa.Table.from_batches(held))


def repeated_passages(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, n): the n runs of PASSAGE words from word `at` on are in a smaller doc_id too."""
    few = found.where(F.col("kind") == _RUNS).select(F.col("key").alias("mark"), "doc_id", "text_key", "at", "body")
    few = few.repartition("mark").sortWithinPartitions("mark").mapInArrow(lambda b: freed(_again(b)), "doc_id long, text_key long, at int, n int")
    many = found.where(F.col("kind") == _RUN).select(F.col("key").alias("run"), "doc_id", "text_key", F.col("at").cast("int").alias("at"))
    first = many.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("run", "first")
    return few.unionByName(many.join(first, "run").where("doc_id <> first").select("doc_id", "text_key", "at", F.lit(1).alias("n")))


# ---------------------------------------------------------------- edits


def edited(body: np.ndarray, lines: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[bytes, int]:
    """A text (bytes) without the `lines` numbered, and without the PASSAGE words from each of the n words from `at` on;
    and the words cut from the other lines. Blanks after a cut go."""
    gone: list[tuple[int, int]] = []
    newline = np.flatnonzero(body == 10)
    begins, ends = np.append(0, newline + 1), np.append(newline, body.size)
    dropped = np.zeros(begins.size, bool)
    dropped[lines] = True
    kept = int(np.argmin(dropped)) if not dropped.all() else begins.size
    for k in np.flatnonzero(dropped).tolist():  # a line goes with the newline before it, or after it if no line stays before
        gone.append((int(begins[k]), min(int(ends[k]) + 1, body.size)) if k < kept else (int(begins[k]) - 1, int(ends[k])))
    words = 0
    if at.size:
        first, last = word_spans(body, np.zeros(1, np.int64))
        change = np.zeros(first.size + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + n + PASSAGE - 1, -1)
        cut_ = np.cumsum(change)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], cut_, [False]]).astype(np.int8))).reshape(-1, 2)
        words = int((cut_ & ~dropped[np.searchsorted(newline, first)]).sum())
        for a, b in edges.tolist():
            stop = int(last[b - 1])
            while stop < body.size and body[stop] in (32, 9):
                stop += 1
            gone.append((int(first[a]), stop))
    out, done = [], 0
    for a, b in sorted(gone):
        if a > done:
            out.append(body[done:a].tobytes())
        done = max(done, b)
    return b"".join([*out, body[done:].tobytes()]), words


_ADDED = {"n_lines": "int", "n_dropped": "int", "n_cut": "long"}


def _applied(text: int, width: int) -> Callable:
    """Batches of `width` columns of documents, of which `text` is edited, and edits (list of n, at); adds the counts of _ADDED."""

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, body = text_bytes(batch.column(text))
            edits = batch.column(width)
            n, at = (edits.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
            bounds = np.append(0, np.cumsum(edits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            out, added = [], []
            for i, there in enumerate(batch.column(text).is_valid().to_pylist()):
                if not there:
                    out.append(None), added.append((None, None, None))
                    continue
                mine, where, own = n[bounds[i] : bounds[i + 1]], at[bounds[i] : bounds[i + 1]].astype(np.int64), body[offsets[i] : offsets[i + 1]]
                lines, runs = where[mine == 0], mine > 0
                new, words = edited(own, lines, where[runs], mine[runs].astype(np.int64))
                out.append(new), added.append((int((own == 10).sum()) + 1, lines.size, words))
            new = pa.array(out, pa.binary()).cast(pa.string())
            cols = [new if c == text else batch.column(c) for c in range(width)]
            more = [pa.array(x, k) for x, k in zip(zip(*added, strict=True) if added else ((), (), ()), (pa.int32(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, *more], [*(f"c{i}" for i in range(width)), *_ADDED])

    return lambda batches: freed(applied(batches))


def _edited(docs: DataFrame, lines: bool, passages: bool, min_documents: int) -> DataFrame:
    """`docs` without what recurs; adds n_lines and n_dropped, n_cut as asked for."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select([F.col(quoted(c)).cast("string").alias("text") if c == "text" else F.col(quoted(c)) for c in docs.columns])
    names = own.columns
    keyed = own.select(F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names))).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"))
    body = f"row.c{names.index('text')}"
    enough = F.when(F.col("kind") == _LINE, F.col("count") >= _enough(min_documents)).otherwise(F.col("count") > 1)
    signs = cut(keyed.where("id is not null").select(F.col(body)).mapInArrow(_signs(lines, passages), "kind int, key long").groupBy("kind", "key").count().where(enough))

    def filter_of(which: Column):
        return spark.sparkContext.broadcast(id_filter(signs.where(which).select("key")))  # 32 MB at most; what it lets through is compared exactly

    line_filter = filter_of(F.col("kind") == _LINE) if lines else None
    mark_filter = filter_of(F.col("kind") == _RUNS) if passages else None
    hot_filter = filter_of((F.col("kind") == _RUNS) & (F.col("count") > HOT)) if passages else None
    found = cut(keyed.select("id", "text_key", F.col(body)).mapInArrow(_found(line_filter, mark_filter, hot_filter), _FOUND))
    edits = None
    if lines:
        edits = recurring_lines(found.where(F.col("kind") == _LINE), min_documents)
    if passages:
        again = repeated_passages(found)
        edits = edits.unionByName(again) if edits is not None else again
    edits = cut(edits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("n", "at")).alias("edits")))
    row = [F.col(f"row.c{i}").alias(f"c{i}") for i in range(len(names))]
    kept = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(own.schema))
    may = id_filter(edits.select("text_key"))
    touched = where_may_hold(keyed, "text_key", may).withColumnRenamed("id", "doc_id").join(edits, ["doc_id", "text_key"], "left")
    touched = touched.select(*row, "edits").mapInArrow(_applied(names.index("text"), len(names)), kept + "".join(f", {c} {k}" for c, k in _ADDED.items()))
    text = F.col(f"c{names.index('text')}")
    none = {"n_lines": F.size(F.split(text, "\n", -1)), "n_dropped": F.lit(0), "n_cut": F.lit(0)}
    rest = where_may_hold(keyed, "text_key", may, no=True).select(*row)  # most texts stay where they are
    rest = rest.select("*", *(F.when(text.isNotNull(), none[c]).cast(k).alias(c) for c, k in _ADDED.items()))
    added = ["n_lines", "n_dropped"] * lines + ["n_cut"] * passages
    return rest.unionByName(touched).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in added), *added)


def dedup(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """`docs` with the lines of recurring templates dropped from `text`; adds n_lines and n_dropped (both null for null text)."""
    return _edited(docs, True, False, min_documents)


def drop_passages(docs: DataFrame) -> DataFrame:
    """`docs` with runs of PASSAGE words that a smaller doc_id holds too cut from `text`; adds n_cut, the words cut."""
    return _edited(docs, False, True, MIN_DOCUMENTS)


def clean(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Both, in one reading of the texts; n_cut counts words outside dropped lines."""
    return _edited(docs, True, True, min_documents)
