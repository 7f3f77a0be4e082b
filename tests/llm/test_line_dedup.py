import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinfold.llm import line_dedup, queries

from .helpers import CLASHING, awkward, empty, untouched


def test_recurring_lines_go_but_stay_once(spark, sf_small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert len(got) == len(before)
    carriers = Counter(line for t in before.values() for line in set(t.split("\n")) if len(line.split()) >= 3)
    left = Counter(line for r in got.values() for line in set(r.text.split("\n")) if len(line.split()) >= 3)
    for line, n in carriers.items():
        if n >= line_dedup.MIN_DOCUMENTS:
            assert left[line] <= 1
    for doc_id, r in got.items():  # what is dropped is a line; the rest stays in order
        lines = before[doc_id].split("\n")
        kept = r.text.split("\n") if r.n_dropped < r.n_lines else []
        assert len(kept) == r.n_lines - r.n_dropped and r.n_lines == len(lines)
        it = iter(lines)
        assert all(any(k == x for x in it) for k in kept)
    unique = [d for d, t in before.items() if all(carriers[line] < 2 for line in set(t.split("\n")) if len(line.split()) >= 3)]
    changed = [d for d in unique if got[d].text != before[d]]
    assert len(changed) <= 0.02 * len(unique)


def test_variable_fields(spark):
    rows = [(i, f"user {i} logged in from host {i * 7} today\nsomething quite unique number{i} {'abcdefghij'[i % 10] * 5} {'klmnopqrst'[i % 10] * 4} zz") for i in range(8)]
    rows.append((99, "page one of many other pages here"))
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].startswith("user 0") and got[99] == rows[-1][1]
    assert all(not got[i].startswith("user") for i in range(1, 8))


def test_defined_cases(spark):
    docs = awkward(spark)
    out = line_dedup.dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count()
    assert got[1].text is None and got[1].n_lines is None and got[2].text == ""
    assert "reserved" in got[11].text and "reserved" not in got[12].text
    assert untouched(out) and set(CLASHING) < set(out.columns)
    both = line_dedup.clean(docs.withColumn("n_lines", F.lit("mine")))
    assert both.columns == [*docs.columns, "n_lines", "n_dropped", "n_cut"] and both.count() == docs.count() and untouched(both)
    assert line_dedup.dedup(empty(spark)).count() == line_dedup.clean(empty(spark)).count() == 0


def _prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_long_lines_of_two_or_three_documents(spark):
    long, short = {2: _prose(1, 60), 3: _prose(2, line_dedup.LONG)}, _prose(3, line_dedup.LONG - 1)
    rows = [(i, f"{_prose(100 + i, 30)}\n{short}" + "".join(f"\n{x}" for n, x in long.items() if i < n)) for i in range(3)]
    rows += [(7, _prose(8, 40)), (7, _prose(8, 40))]  # one document given twice
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[7].text == rows[3][1]
    assert [got[i].n_dropped for i in range(3)] == [0, 2, 1]
    assert all(short in got[i].text and _prose(100 + i, 30) in got[i].text for i in range(3))


def test_passages_within_longer_lines(spark):
    passage = _prose(20, 60)
    texts = [
        f"{_prose(30, 9)}\n{passage} {_prose(31, 12)}\n{_prose(32, 8)}",
        f"{_prose(33, 55)} {passage}\n{_prose(34, 7)}",
        f"é {_prose(35, 5)} {passage.replace(' ', chr(10), 3)} {_prose(36, 5)}\nß",
        " ".join([*passage.split()[:49], _prose(37, 20)]),  # 49 words are no passage
        " ".join([*passage.split()[:5], "more", *passage.split()[5:], _prose(38, 3)]),  # a word inserted
        f"{passage} {passage}", None, "",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_passages(line_dedup.dedup(docs)).collect()}
    assert len(got) == len(texts) + 1
    assert all(got[i].text == texts[i] for i in (0, 3, 6, 7)) and got[None].text == texts[0]
    assert got[1].text == f"{_prose(33, 55)} \n{_prose(34, 7)}" and got[1].n_cut == 60
    assert got[2].text == f"é {_prose(35, 5)} {_prose(36, 5)}\nß"
    assert got[4].text == " ".join([*passage.split()[:5], "more", _prose(38, 3)])
    assert got[5].text == "" and got[5].n_cut == 120 and got[6].n_cut is None


def test_op5_leaves_no_passage_in_two_documents(spark):
    left = defaultdict(set)
    for r in queries.op5_line_dedup(spark, "/root/testdata/sf0.01").collect():
        words = re.findall("[^ \\t-\\r]+", r.text or "")
        for i in range(len(words) - line_dedup.PASSAGE + 1):
            left[tuple(words[i : i + line_dedup.PASSAGE])].add(r.doc_id)
    assert left and all(len(x) == 1 for x in left.values())


def test_one_template_of_any_number_of_lines(spark):
    rng = random.Random(9)
    names = {"".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(2300)}
    rows = [(i, f"user logged in {name} from the main office") for i, name in enumerate(sorted(names))]
    assert len(rows) > 2048
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("text <> ''").collect()
    assert [r.doc_id for r in got] == [0]


def test_blocks_lose_no_template():
    rng = np.random.default_rng(4)
    for n, kinds in ((3, 2), (4, 3), (5, 3), (8, 3), (11, 3), (25, 2), (40, 2)):
        base = rng.integers(0, kinds, (30, n))
        lines = base[rng.integers(0, 30, 600)]
        lines = np.where(rng.random(lines.shape) < 0.12, rng.integers(0, 50, lines.shape), lines)
        lines[:, : line_dedup.DEPTH] = 7
        masked = [x.astype("<u8").tobytes() for x in lines]
        assert line_dedup.templates(masked, scan=0) == line_dedup.templates(masked, scan=10**9)


def test_a_template_counts_documents_not_variants(spark):
    line = "alpha beta gamma {} epsilon zeta eta theta iota kappa"
    rows = [(1, "\n".join(line.format(w) for w in ("one", "two", "three"))), (2, line.format("four")), (2, line.format("four"))]
    rows += [(10 + i, f"delta beta gamma {w} epsilon zeta eta theta iota kappa") for i, w in enumerate(("one", "two", "three", "four"))]
    got = {(r.doc_id, r.text) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {*rows[:4], (11, ""), (12, ""), (13, "")}


def test_passages_equal_brute_force(spark):
    rng = random.Random(11)
    pieces = [_prose(200 + i, rng.choice((20, 49, 50, 51, 70, 120))) for i in range(12)]
    rows = [(i, " ".join(rng.choice(pieces) if rng.random() < 0.6 else _prose(1000 + 50 * i + k, rng.randint(1, 60)) for k in range(rng.randint(1, 6)))) for i in range(40)]
    first = {}
    for i, text in rows:
        w = text.split()
        for k in range(len(w) - line_dedup.PASSAGE + 1):
            first.setdefault(tuple(w[k : k + line_dedup.PASSAGE]), i)
    for r in line_dedup.drop_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        w, gone = rows[r.doc_id][1].split(), set()
        for k in range(len(w) - line_dedup.PASSAGE + 1):
            if first[tuple(w[k : k + line_dedup.PASSAGE])] < r.doc_id:
                gone |= set(range(k, k + line_dedup.PASSAGE))
        assert r.text.split() == [x for k, x in enumerate(w) if k not in gone] and r.n_cut == len(gone)


def test_hot_marks_lose_nothing(spark, monkeypatch):
    passage = _prose(40, 60)
    rows = [(i, f"{_prose(3000 + i, 12)} {passage} {_prose(4000 + i, 12)}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in line_dedup.drop_passages(docs).collect())
    monkeypatch.setattr(line_dedup, "HOT", 3)
    assert sorted(tuple(r) for r in line_dedup.drop_passages(docs).collect()) == want
    assert sum(passage in t for _, t, _ in want) == 1


def test_very_long_texts_are_parsed_in_segments(spark, monkeypatch):
    from kinfold.llm import common

    text = "\n".join(_prose(5000 + i, 30) for i in range(60)) + " " + "y" * 3000 + " end"
    whole = next(common.words_of(pa.array([text])))[2]
    monkeypatch.setattr(common, "CHUNK", 500)
    parts = next(common.words_of(pa.array([text])))[2]
    assert all((getattr(whole, f) == getattr(parts, f)).all() for f in ("hashes", "bounds", "line", "digit"))
