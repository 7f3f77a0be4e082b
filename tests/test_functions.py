import itertools
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.functions import similarity as S


def test_worked_records(spark):
    raw = [
        ("a", "Raj Investments LLP", "3315 Fremont Street, Peoria, IL"),
        ("b", "Payne Énterprises", "3315 FREMONT SAINT, PEORIA, IL"),
        ("c", "PAYNE-ENRTPRMISES", "6(29), C.I.T. Colony, 2Nd Main Road Mylapore, Chennai, Tamil Nadu"),
        ("d", None, "12 Rue de la Paix, 75002 Paris"),
        ("e", "राम Straße", ""),
    ]
    df = spark.createDataFrame(raw, "entity_id string, business_name string, business_address string")
    r = {x.entity_id: x for x in N.add_normalized_columns(df).collect()}
    assert (r["a"].name_n, r["b"].name_n, r["c"].name_n, r["d"].name_n) == ("raj investments llp", "payne enterprises", "payne enrtprmises", "")
    assert [r[k].was_nonascii for k in "abcde"] == [0, 1, 0, 0, 1]
    assert r["a"].addr_n == r["b"].addr_n == "3315 fremont st peoria il"
    assert (r["a"].addr_digits, r["a"].addr_house, r["a"].addr_pin, r["a"].addr_tok1) == ("3315", "3315", "", "fremont")
    assert r["c"].addr_n == "6 29 c i t colony 2nd main rd mylapore chennai tn"
    assert (r["c"].addr_digits, r["c"].addr_house, r["c"].addr_tok1) == ("2-29-6", "6", "mylapore")
    assert (r["d"].addr_digits, r["d"].addr_pin, r["d"].addr_tok1) == ("12-75002", "75002", "paix")
    assert "strasse" in r["e"].name_n and r["e"].name_n != "strasse"


def test_digits(spark):
    row = spark.range(1).select(
        N.strip_zeros(F.lit("032")).alias("a"), N.strip_zeros(F.lit("000")).alias("b"), N.digit_tokens(F.lit("032 7 560001 32")).alias("c"), N.digit_tokens(F.lit("0 00")).alias("d"),
        N.url_filename(F.lit("http://x.y/a/b.jpg?q=1")).alias("e"), N.url_filename(F.lit(None).cast("string")).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == ("32", "0", ["560001", "32", "7"], [], "b.jpg", "")


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_kernels(a, b):
    assert S.lcs(a, b) == plain_lcs(a, b)
    for f in (S.ratio, S.token_sort, S.token_set, S.partial, S.jaro_winkler):
        assert 0 <= f(a, b) <= 1 and math.isclose(f(a, b), f(b, a), abs_tol=1e-12) or f in (S.partial, S.jaro_winkler)
    if a:
        assert S.ratio(a, a) == S.partial(a, a) == 1
        short, long = sorted((a, b), key=len)
        best = max((S.ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long))), default=0.0) if short else 0.0
        assert math.isclose(S.partial(a, b), best, abs_tol=1e-12) or len(a) == len(b)


def test_kernel_conventions():
    assert S.ratio("", "") == 1 and S.token_set("", "") == 0 and S.jaro_winkler("", "") == 1
    assert S.token_set("a b", "b a c") == 1 and S.token_sort("new york", "york new") == 1
    assert S.partial("abc", "xxabcxx") == 1
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)


def test_expected_f05_by_enumeration():
    def value(p, k):
        total = 0.0
        for hits in itertools.product((0, 1), repeat=len(p)):
            chance = math.prod(x if h else 1 - x for x, h in zip(p, hits, strict=True))
            tp, t = sum(hits[:k]), sum(hits)
            total += chance * (1.0 if k == 0 and t == 0 else 0.0 if tp == 0 else 1.25 * tp / (0.25 * t + k))
        return total

    for p in ([], [1.0], [0.0], [0.9, 0.8, 0.2], [0.5, 0.5, 0.5, 0.5], [0.3, 0.2, 0.1], [0.99, 0.6, 0.6, 0.55, 0.1, 0.05]):
        values = [value(p, k) for k in range(len(p) + 1)]
        assert values[S.expected_f05_k(p)] == pytest.approx(max(values))
    assert [S.expected_f05_k(p) for p in ([], [1.0], [0.0])] == [0, 1, 0]


def test_names_of_other_scripts(spark):
    # fixed values: names and how they are spelt
    names = {
        "दिल्ली": "dillii", "मुंबई": "munbii", "भारत": "bhaart", "கோவை": "koovai", "Москва": "Moskva", "Шоссе Энтузиастов": "Shosse Entuziastov", "Жуков": "Zhukov", "Ёлка": "Iolka",
        "Αθήνα": "Athena", "Θεσσαλονίκη": "Thessalonike", "서울": "seoul", "부산": "busan", "한국": "hangug", "とうきょう": "toukiyou", "カメラ": "kamera", "محمد": "mhmd", "Zürich": "Zurich", "Œuvre": "OEuvre",
        "plain": "plain", "१२३": "123",
    }
    got = spark.createDataFrame(list(names.items()), "x string, want string").select("x", N.romanise(F.col("x")).alias("got"), "want").collect()
    assert [(r.x, r.got) for r in got] == [(r.x, r.want) for r in got]


def plain_partial(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0 if long else 1.0
    return max(S.ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))


TEXT = st.text("ab 1é", max_size=14) | st.lists(st.sampled_from(["aa", "b", "brand", "12", "日本"]), max_size=7).map(" ".join) | st.text("abc ", min_size=60, max_size=140)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=12))
def test_many_pairs_at_once(pairs):
    one, two = [a for a, _ in pairs], [b for _, b in pairs]
    plain = {S.ratio_many: S.ratio, S.token_sort_many: S.token_sort, S.token_set_many: S.token_set, S.partial_many: plain_partial, S.jaro_winkler_many: S.jaro_winkler}
    for many, single in plain.items():
        assert many(one, two).tolist() == [single(a, b) for a, b in pairs]


def test_pairs_beyond_what_a_worker_keeps(monkeypatch):
    monkeypatch.setattr(S, "KEPT", 40)
    monkeypatch.setattr(S, "LETTERS", 30)
    monkeypatch.setattr(S, "WINDOWS", 3)
    one, two = [f"{i} large brand {i % 7}" for i in range(60)], [f"brand {i % 5} small {i} {'x' * (i % 9)}" for i in range(60)]
    assert S.token_set_many(one, two).tolist() == [S.token_set(a, b) for a, b in zip(one, two, strict=True)]
    assert S.partial_many(one, two).tolist() == [plain_partial(a, b) for a, b in zip(one, two, strict=True)]
