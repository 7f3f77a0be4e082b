"""String similarity kernels, vectorised over Arrow batches; every score is between 0 and 1.

ratio: 2 * LCS / (len a + len b) (two empty strings: 1). token_sort: ratio of the sorted words. token_set: the best ratio
among the common words and the common words with either rest (0 if a side is empty, 1 if one set holds the other).
partial: the best ratio of the shorter string with a window of the longer, windows cut at both ends included.

The functions of two strings define the scores; those named *_many give the same numbers for many pairs at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Letters of pairs, masks of letters and windows that a kernel holds at once; letters of strings that a worker keeps.
LETTERS, MASKS, WINDOWS, KEPT = 1 << 17, 1 << 18, 1 << 14, 1 << 22


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


@lru_cache(1 << 16)
def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * lcs(a, b) / total if total else 1.0


@lru_cache(1 << 16)
def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@lru_cache(1 << 16)
def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 1.0
    one, two = " ".join([both, *left]).strip(), " ".join([both, *right]).strip()
    best = ratio(one, two)
    return max(best, ratio(both, one), ratio(both, two)) if both else best


def partial(a: str, b: str) -> float:
    return float(partial_many([a], [b])[0])


class _Growing:
    """An array that more is added to."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1 << 10, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + more.size > self.held.size:
            self.held = np.concatenate([self.held[: self.n], np.zeros(self.n + 2 * more.size, self.held.dtype)])
        self.held[self.n : self.n + more.size] = more
        self.n += more.size


class _Rows:
    """Rows of different lengths, one after the other, in several arrays of the same shape."""

    def __init__(self, *kinds: type):
        self.flat, self.sizes, self.starts = [_Growing(k) for k in kinds], _Growing(np.int64), _Growing(np.int64)

    def add(self, sizes: np.ndarray, *flat: np.ndarray) -> None:
        self.starts.add(self.flat[0].n + np.cumsum(sizes) - sizes)
        self.sizes.add(sizes)
        for f, more in zip(self.flat, flat, strict=True):
            f.add(more)

    def rows(self, at: np.ndarray, *blanks: int) -> list[np.ndarray]:
        """Of each array these rows, filled up with its blank."""
        sizes = self.sizes.held[at]
        place = np.arange(int(sizes.max(initial=0)))
        full, cells = place < sizes[:, None], self.starts.held[at][:, None] + place
        return [np.where(full, f.held.take(cells, mode="clip"), blank) for f, blank in zip(self.flat, blanks, strict=True)]


class _Texts:
    """Strings as rows of letter numbers; 0 is no letter."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.number, self.letters = np.zeros(1 << 8, np.int32), 1
        self.chars = self._chars()

    def _chars(self) -> _Rows:
        return _Rows(np.int32)

    def at(self, strings: list[str]) -> np.ndarray:
        """The row of each string; new ones are added."""
        new = [x for x in dict.fromkeys(strings) if x not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self._add(new)
        return np.fromiter(map(self.known.__getitem__, strings), np.int64, len(strings))

    def _numbered(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        most = int(points.max(initial=0))
        if most >= self.number.size:
            self.number = np.concatenate([self.number, np.zeros(most + 1 - self.number.size, np.int32)])
        seen = np.zeros(most + 1, bool)
        seen[points] = True
        new = np.flatnonzero(seen & (self.number[: most + 1] == 0))
        self.number[new] = self.letters + np.arange(new.size)
        self.letters += new.size
        return np.fromiter(map(len, strings), np.int64, len(strings)), self.number[points]

    def _add(self, strings: list[str]) -> None:
        self.chars.add(*self._numbered(strings))

    def size(self, at: np.ndarray) -> np.ndarray:
        return self.chars.sizes.held[at]

    def rows(self, at: np.ndarray) -> np.ndarray:
        return self.chars.rows(at, 0)[0]


class _WordSets(_Texts):
    """The sorted different words of each string, a blank before each; their numbers and lengths."""

    def __init__(self):
        super().__init__()
        self.words, self.word = _Rows(np.int64, np.int64), {}

    def _chars(self) -> _Rows:  # letters, the place of their word, whether they are the blank before it
        return _Rows(np.int32, np.int32, bool)

    def _add(self, strings: list[str]) -> None:
        words = [sorted(set(s.split())) for s in strings]
        every = [w for ws in words for w in ws]
        count, long = (np.fromiter(map(len, x), np.int64, len(x)) for x in (words, every))
        numbers = np.fromiter((self.word.setdefault(w, len(self.word)) for w in every), np.int64, len(every))
        size, letters = self._numbered([" " + " ".join(ws) if ws else "" for ws in words])
        place = np.repeat(np.arange(long.size) - np.repeat(np.cumsum(count) - count, count), long + 1)
        blank = np.zeros(letters.size, bool)
        blank[np.cumsum(long + 1) - long - 1] = True
        self.words.add(count, numbers, long)
        self.chars.add(size, letters, place, blank)


_HELD: dict[type, _Texts] = {}


def _each_once(kernel: Callable, make: type, one: list[str], two: list[str], short_first: bool = False) -> np.ndarray:
    """The kernel's value of each pair; equal pairs are computed once, those of like lengths together."""
    letters = np.cumsum(np.fromiter(map(len, one), np.int64, len(one)) + np.fromiter(map(len, two), np.int64, len(two)))
    cuts = [0, *(1 + np.flatnonzero(np.diff(letters // KEPT))).tolist(), len(one)]
    return np.concatenate([_some(kernel, make, one[lo:hi], two[lo:hi], short_first) for lo, hi in zip(cuts, cuts[1:], strict=False)])


def _some(kernel: Callable, make: type, one: list[str], two: list[str], short_first: bool) -> np.ndarray:
    held = _HELD.get(make)
    if held is None or held.chars.flat[0].n > KEPT:
        held = _HELD[make] = make()
    both = held.at([*one, *two])
    rows = len(held.known)
    pairs, back = np.unique(both[: len(one)] * rows + both[len(one) :], return_inverse=True)
    i, j = pairs // rows, pairs % rows
    if short_first:
        shorter = held.size(i) <= held.size(j)
        i, j = np.where(shorter, i, j), np.where(shorter, j, i)
    order = np.lexsort((held.size(i), held.size(j)))
    n, m = held.size(i[order]), held.size(j[order])
    cost = np.maximum(np.maximum.accumulate(n) + m, np.maximum.accumulate(-(-n // 64)) * (held.letters * LETTERS / MASKS))
    out, lo = np.empty(order.size), 0
    while lo < order.size:  # cost grows along the order
        hi = min(order.size, lo + max(1, int(LETTERS // max(cost[lo], 1))))
        while hi > lo + 1 and (hi - lo) * cost[hi - 1] > LETTERS:
            hi = lo + max(1, (hi - lo) * 3 // 4)
        some = order[lo:hi]
        out[some] = kernel(held, i[some], j[some])
        lo = hi
    return out[back]


def _masks(rows: np.ndarray, letters: int) -> np.ndarray:
    """(words, rows * letters): the places of each letter in each row, as bits in words of 64."""
    out = np.zeros((max(1, -(-rows.shape[1] // 64)), rows.shape[0] * letters), np.uint64)
    first = np.arange(rows.shape[0]) * letters
    for k in range(rows.shape[1]):
        out[k // 64, first + rows[:, k]] |= np.uint64(1 << (k % 64))
    out[:, first] = 0
    return out


def _begin(masks: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.full(n, np.iinfo(np.uint64).max, np.uint64) for _ in masks]


def _step(state: list[np.ndarray], masks: np.ndarray, at: np.ndarray) -> None:
    """One more letter of each text, by bit-parallel addition."""
    carry = None
    for w, s in enumerate(state):
        hit = s & masks[w].take(at)
        total = s + hit
        if len(state) > 1:
            over = total < s
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64)
        state[w] = total | (s - hit)


def _common(state: list[np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count(~s).astype(np.int64) for s in state)


def _lcs_rows(one: np.ndarray, two: np.ndarray, letters: int) -> np.ndarray:
    """Length of the longest common subsequence of the letters of each two rows; 0 is no letter."""
    masks = _masks(one, letters)
    state = _begin(masks, len(one))
    for at in np.ascontiguousarray(two.T + np.arange(len(one)) * letters):
        _step(state, masks, at)
    return _common(state)


def _ratio(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)


def _ratio_rows(t: _Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return _ratio(_lcs_rows(t.rows(i), t.rows(j), t.letters), t.size(i) + t.size(j))


def ratio_many(one: list[str], two: list[str]) -> np.ndarray:
    return _each_once(_ratio_rows, _Texts, one, two, True)


def token_sort_many(one: list[str], two: list[str]) -> np.ndarray:
    known = {x: " ".join(sorted(x.split())) for x in {*one, *two}}
    return ratio_many([known[x] for x in one], [known[x] for x in two])


def _token_set_rows(t: _WordSets, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    (x, long_x), (y, long_y) = t.words.rows(i, -1, 0), t.words.rows(j, -2, 0)
    mine, theirs = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for k in range(y.shape[1]):
        equal = x == y[:, k : k + 1]
        mine |= equal
        theirs[:, k] = equal.any(axis=1)

    def length(long: np.ndarray, those: np.ndarray) -> np.ndarray:
        return np.maximum((those * (long + 1)).sum(axis=1) - 1, 0)

    def rest(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Letters of these words, a blank between two of them."""
        letters, place, blank = t.chars.rows(at, 0, 0, False)
        if not left.size:
            return np.zeros(letters.shape, np.int64)
        place += np.arange(at.size)[:, None] * left.shape[1]
        after = left & (np.cumsum(left, axis=1) > 1)
        return letters * np.where(blank, after.take(place), left.take(place))

    left_x, left_y = (x >= 0) & ~mine, (y >= 0) & ~theirs
    left, right, both = length(long_x, left_x), length(long_y, left_y), length(long_x, mine)
    head = np.where(both > 0, both + 1, 0)  # both strings begin with the shared words and a blank
    best = _ratio(head + _lcs_rows(rest(i, left_x), rest(j, left_y), t.letters), 2 * head + left + right)
    alone = np.maximum(_ratio(both, both + head + left), _ratio(both, both + head + right))
    best = np.where(both > 0, np.maximum(best, alone), best)
    best[(both > 0) & ((left == 0) | (right == 0))] = 1.0
    best[~((x >= 0).any(axis=1) & (y >= 0).any(axis=1))] = 0.0
    return best


def token_set_many(one: list[str], two: list[str]) -> np.ndarray:
    return _each_once(_token_set_rows, _WordSets, one, two)


def _partial_rows(t: _Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """i: the shorter strings. Windows cut at an end are heads and tails of the longer: one pass finds all of either."""
    n, m = t.size(i), t.size(j)
    short, long = t.rows(i), t.rows(j)
    first = np.arange(i.size) * t.letters
    best = np.zeros(i.size)

    def heads(masks: np.ndarray, rows: np.ndarray) -> None:
        state = _begin(masks, i.size)
        for k, at in enumerate(np.ascontiguousarray(rows.T[: short.shape[1]] + first)):
            _step(state, masks, at)
            np.maximum(best, np.where(k < n, 2 * _common(state) / (n + k + 1), 0.0), out=best)

    def backwards(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = size[:, None] - 1 - np.arange(rows.shape[1])
        return np.where(at >= 0, np.take_along_axis(rows, np.maximum(at, 0), axis=1), 0)

    masks = _masks(short, t.letters)
    heads(masks, long)
    heads(_masks(backwards(short, n), t.letters), backwards(long, m))
    count = np.where(n > 0, np.maximum(m - n - 1, 0), 0)  # windows that touch neither end
    ends = np.cumsum(count)
    for lo in range(0, int(ends[-1]), WINDOWS):
        window = np.arange(lo, min(lo + WINDOWS, int(ends[-1])))
        owner = np.searchsorted(ends, window, "right")
        begin = owner * long.shape[1] + 1 + window - (ends - count)[owner]
        state, mine = _begin(masks, window.size), first[owner]
        for k in range(int(n[owner].max())):
            inside = k < n[owner]
            _step(state, masks, mine + np.where(inside, long.ravel()[np.where(inside, begin + k, 0)], 0))
        np.maximum.at(best, owner, _common(state) / n[owner])
    best[(n == 0) & (m > 0)] = 0.0
    best[m == 0] = 1.0
    return best


def partial_many(one: list[str], two: list[str]) -> np.ndarray:
    return _each_once(_partial_rows, _Texts, one, two, True)


@lru_cache(1 << 16)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler with a prefix weight of 0.1 over at most four letters; two empty strings: 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits_a = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits_a.append(c)
                break
    if not hits_a:
        return 0.0
    hits_b = [c for c, u in zip(b, used, strict=True) if u]
    m, swaps = len(hits_a), sum(x != y for x, y in zip(hits_a, hits_b, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    head = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        head += 1
    return jaro + head * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _jaro_winkler_rows(t: _Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    n, m = t.size(i), t.size(j)
    a, b = t.rows(i), t.rows(j)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
    free, hit_a = np.ones(b.shape, bool), np.zeros(a.shape, bool)
    every, place = np.arange(i.size), np.arange(b.shape[1])[None, :]
    for k in range(a.shape[1] if b.shape[1] else 0):
        fits = free & (b == np.where(k < n, a[:, k], -1)[:, None]) & (place >= k - reach) & (place <= k + reach)
        at = fits.argmax(axis=1)
        hit_a[:, k] = fits[every, at]
        free[every, at] &= ~hit_a[:, k]
    hits = hit_a.sum(axis=1)

    def in_turn(rows: np.ndarray, hit: np.ndarray) -> np.ndarray:
        out = np.zeros((i.size, int(hits.max(initial=0))), np.int64)
        r, c = np.nonzero(hit)
        out[r, (np.cumsum(hit, axis=1) - 1)[r, c]] = rows[r, c]
        return out

    swaps = (in_turn(a, hit_a) != in_turn(b, ~free)).sum(axis=1) // 2
    many = np.maximum(hits, 1)
    jaro = (hits / np.maximum(n, 1) + hits / np.maximum(m, 1) + (hits - swaps) / many) / 3
    most = min(4, a.shape[1], b.shape[1])
    head = np.cumprod((a[:, :most] == b[:, :most]) & (np.arange(most) < n[:, None]), axis=1).sum(axis=1)
    out = np.where(jaro > 0.7, jaro + head * 0.1 * (1 - jaro), jaro)
    out[hits == 0] = 0.0
    out[i == j] = 1.0
    return out


def jaro_winkler_many(one: list[str], two: list[str]) -> np.ndarray:
    return _each_once(_jaro_winkler_rows, _Texts, one, two)


FEATURES = ("nm_ratio", "nm_tsort", "nm_tset", "nm_part", "nm_jw", "ad_ratio", "ad_tsort", "ad_tset", "ad_part", "ad_jw", "x_nm1_ad2", "x_nm2_ad1")


def string_features(n1: Column, a1: Column, n2: Column, a2: Column) -> Column:
    """struct of the twelve string features of a pair: one Arrow round trip for all of them."""

    def compute(n1: pd.Series, a1: pd.Series, n2: pd.Series, a2: pd.Series) -> pd.DataFrame:
        out = {}
        n1, a1, n2, a2 = (list(x) for x in (n1, a1, n2, a2))
        for name, one, two in (("nm", n1, n2), ("ad", a1, a2)):
            for short, f in _FIVE.items():
                out[f"{name}_{short}"] = f(one, two)
        out["x_nm1_ad2"], out["x_nm2_ad1"] = partial_many(n1, a2), partial_many(n2, a1)
        return pd.DataFrame(out, columns=list(FEATURES), dtype="float64")

    return F.pandas_udf(compute, ", ".join(f"{f} double" for f in FEATURES))(n1, a1, n2, a2)


_FIVE = {"ratio": ratio_many, "tsort": token_sort_many, "tset": token_set_many, "part": partial_many, "jw": jaro_winkler_many}


def blocking_scores(n1: list[str], a1: list[str], n2: list[str], a2: list[str]) -> np.ndarray:
    one, two = ([f"{x} {y}" for x, y in zip(n, a, strict=True)] for n, a in ((n1, a1), (n2, a2)))
    sets = 0.3 * token_set_many(a1, a2) + 0.2 * token_set_many(n1, n2) + 0.2 * token_set_many(one, two)
    return 100 * (sets + 0.3 * partial_many(one, two))


def blocking_score(n1: Column, a1: Column, n2: Column, a2: Column) -> Column:
    """0..100: 0.3 token-set of addresses, 0.2 of names, 0.2 of both joined, 0.3 partial of both joined."""

    def compute(n1: pd.Series, a1: pd.Series, n2: pd.Series, a2: pd.Series) -> pd.Series:
        return pd.Series(blocking_scores(*(list(x) for x in (n1, a1, n2, a2))))

    return F.pandas_udf(compute, "double")(n1, a1, n2, a2)


def jaro_winkler_column(a: Column, b: Column) -> Column:
    def compute(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(compute, "double")(a, b)


def expected_f05_k(p: list[float]) -> int:
    """The k whose top-k set maximises the expected F0.5 under independent matches; ties to the smaller k.

    p: probabilities, largest first. TP of the first k and misses among the rest are Poisson-binomial.
    """

    def convolved(q: list[float], x: float) -> list[float]:
        return [(q[i] if i < len(q) else 0.0) * (1 - x) + (q[i - 1] * x if i else 0.0) for i in range(len(q) + 1)]

    n = len(p)
    rest = [[1.0]]
    for x in reversed(p):
        rest.append(convolved(rest[-1], x))
    rest.reverse()  # rest[k]: matches among p[k:]
    best, best_k, head = rest[0][0], 0, [1.0]
    for k in range(1, n + 1):
        head = convolved(head, p[k - 1])
        value = sum(1.25 * t * a * b / (0.25 * (t + f) + k) for t, a in enumerate(head) if t for f, b in enumerate(rest[k]))
        if value > best + 1e-12:
            best, best_k = value, k
    return best_k


def expected_f05_column(p: Column) -> Column:
    def compute(p: pd.Series) -> pd.Series:
        return pd.Series([expected_f05_k(list(x)) for x in p], dtype="int32")

    return F.pandas_udf(compute, "int")(p)
