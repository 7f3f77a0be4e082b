"""Candidate generation: rare-token keys, capped key joins, exact composite keys, char n-gram TF-IDF, recall."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import digit_tokens, strip_zeros
from .stats import field_tokens


@dataclass(frozen=True)
class Preset:
    max_block: int = 300
    n_rare: int = 3
    solo_df: int = 400
    top: int = 0
    max_df: int = 100_000
    n_digit: int = 3


# fixed values: the parameter sets in use
PRESETS = {
    "default": Preset(), "study": Preset(300, 3, 400, 50), "floor": Preset(800, 4, 1500, 60), "production": Preset(1500, 8, 4000, 50), "tfidf": Preset(800, 4, 1500, 50), "rerank": Preset(800, 4, 1500, 200),
}


def rare_tokens(records: DataFrame, df: DataFrame, k: int = 3, max_df: int = 100_000) -> DataFrame:
    """(entity_id, source, country, field, token, df, rank): the k rarest words of each field; unseen words count as df 1."""
    known = field_tokens(records).join(df, ["country", "field", "token"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    w = Window.partitionBy("entity_id", "field").orderBy("df", "token")
    return known.where(F.col("df") <= max_df).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def make_keys(records: DataFrame, df: DataFrame, preset: Preset = PRESETS["default"]) -> DataFrame:
    """(entity_id, source, country, key), each key once per record. Families:

    d|digit|address word, a|address word, p|postal code|address word, n|name word (two rarest), N|name, D|digits,
    dn|digit|name word (three rarest words, two digits).
    """
    most = max(preset.n_rare, 3)
    rare = rare_tokens(records, df, most, preset.max_df)
    struct = F.struct("rank", "token", "df")
    lists = rare.groupBy("entity_id").agg(
        *(F.array_sort(F.collect_list(F.when(F.col("field") == f, struct))).alias(f) for f in ("addr", "name")),
    )
    rows = records.select("entity_id", "source", "country", "name_n", "addr_pin", digit_tokens(F.col("addr_n"), preset.n_digit).alias("digits")).join(lists, "entity_id", "left")
    none = F.expr("cast(array() as array<struct<rank:int,token:string,df:bigint>>)")
    addr, name = F.filter(F.coalesce("addr", none), lambda t: t["rank"] <= preset.n_rare), F.coalesce("name", none)
    digits = F.col("digits")
    solo = lambda ts: F.filter(ts, lambda t: t["df"] <= preset.solo_df)
    pin = strip_zeros(F.col("addr_pin"))
    families = F.concat(
        F.flatten(F.transform(addr, lambda t: F.transform(digits, lambda d: F.concat_ws("|", F.lit("d"), d, t["token"])))),
        F.transform(solo(addr), lambda t: F.concat_ws("|", F.lit("a"), t["token"])),
        F.when(F.col("addr_pin") != "", F.transform(addr, lambda t: F.concat_ws("|", F.lit("p"), pin, t["token"]))).otherwise(F.array().cast("array<string>")),
        F.transform(solo(F.filter(name, lambda t: t["rank"] <= 2)), lambda t: F.concat_ws("|", F.lit("n"), t["token"])),
        F.when(F.col("name_n") != "", F.array(F.concat_ws("|", F.lit("N"), "name_n"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(digits) >= 2, F.array(F.concat_ws("|", F.lit("D"), F.array_join(F.array_sort(digits), "-")))).otherwise(F.array().cast("array<string>")),
        F.flatten(F.transform(F.filter(name, lambda t: t["rank"] <= 3), lambda t: F.transform(F.slice(digits, 1, 2), lambda d: F.concat_ws("|", F.lit("dn"), d, t["token"])))),
    )
    return rows.select("entity_id", "source", "country", F.explode(F.array_distinct(families)).alias("key"))


def hashed_keys(keys: DataFrame) -> DataFrame:
    """Keys as 64-bit hashes of country and key: less to move; two keys in 2**64 may meet by chance."""
    return keys.withColumn("key", F.xxhash64("country", "key"))


def capped(keys: DataFrame, max_block: int) -> DataFrame:
    """Keys of S2 and S3 that at most `max_block` records of their country and source have."""
    pool = keys.where("source in (2, 3)")
    small = pool.groupBy("country", "source", "key").agg(F.count("*").alias("n")).where(F.col("n") <= max_block).drop("n")
    return pool.join(small, ["country", "source", "key"])


def candidates(keys: DataFrame, max_block: int = 300, top: int = 0) -> DataFrame:
    """(s1_id, cand_id, source, country, nkeys): pairs of S1 with S2 or S3 records that share a key, and how many they share."""
    one = keys.where("source = 1").select("country", "key", F.col("entity_id").alias("s1_id"))
    pool = capped(keys, max_block).select("country", "key", "source", F.col("entity_id").alias("cand_id"))
    pairs = one.join(pool, ["country", "key"]).groupBy("s1_id", "cand_id", "source", "country").agg(F.count("*").alias("nkeys"))
    return top_n(pairs, [F.desc("nkeys"), F.asc("cand_id")], top) if top else pairs


def top_n(pairs: DataFrame, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy("s1_id", "source").orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank")


def rescore_and_cut(pairs: DataFrame, records: DataFrame, top: int = 50) -> DataFrame:
    """The `top` pairs per S1 record and source by string similarity (blk_sim, 0..100).

    The texts of S1 records come last, so all pairs of a record are scored and ranked where they meet.
    """
    from ..functions.similarity import blocking_score

    one = records.select(F.col("entity_id").alias("s1_id"), F.col("name_n").alias("n1"), F.col("addr_n").alias("a1"))
    two = records.select(F.col("entity_id").alias("cand_id"), F.col("name_n").alias("n2"), F.col("addr_n").alias("a2"))
    named = pairs.join(two, "cand_id").join(one, "s1_id")
    texts = ["n1", "a1", "n2", "a2"]
    scored = named.withColumn("blk_sim", blocking_score(*(F.col(t) for t in texts))).drop(*texts)
    return top_n(scored, [F.desc("blk_sim"), F.asc("cand_id")], top)


# ---------------------------------------------------------------- exact composite keys

# fixed values: the exact key definitions
KEY_DEFS = (("house", "addr_tok1"), ("pin", "name_tok1"), ("house", "pin"), ("name",), ("digits",), ("addr_tok1", "name_tok1"))
_KEY_COLUMNS = {"house": "addr_house", "pin": "addr_pin", "name": "name_n", "digits": "addr_digits", "addr_tok1": "addr_tok1", "name_tok1": "name_tok1"}


def build_key(parts: tuple[str, ...]) -> Column:
    """The parts joined by '|'; '' if any is empty."""
    cols = [F.col(_KEY_COLUMNS[p]) for p in parts]
    full = F.lit(True)
    for c in cols:
        full = full & (F.length(c) > 0)
    return F.when(full, F.concat_ws("|", *cols)).otherwise(F.lit(""))


def composite_pairs(records: DataFrame, defs: tuple = KEY_DEFS, max_block: int = 200) -> DataFrame:
    """(definition, s1_id, cand_id, source) for each key definition; all definitions are exploded in one pass."""
    every = F.array(*(F.struct(F.lit("+".join(d)).alias("definition"), build_key(d).alias("key")) for d in defs))
    keys = records.select("entity_id", "source", "country", F.explode(every).alias("k")).select("entity_id", "source", "country", "k.definition", "k.key").where("key <> ''")
    by = ["country", "definition", "source", "key"]
    pool = keys.where("source in (2, 3)")
    pool = pool.join(pool.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") <= max_block).drop("n"), by)
    one = keys.where("source = 1").select("country", "definition", "key", F.col("entity_id").alias("s1_id"))
    return one.join(pool.select(*by, F.col("entity_id").alias("cand_id")), ["country", "definition", "key"]).select("definition", "s1_id", "cand_id", "source").distinct()


# ---------------------------------------------------------------- char n-gram TF-IDF


def char_wb_grams(text: Column, low: int = 3, high: int = 4) -> Column:
    """All n-grams of each blank-padded word, with repeats; a word shorter than n is one gram, once."""
    word = lambda w: F.concat(F.lit(" "), w, F.lit(" "))

    def cut_at(w: Column, n: int):
        return lambda i: F.substring(w, i, F.lit(n))

    def of(w: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            shorter = (F.length(w) < n) if n == low else F.lit(False)
            many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), cut_at(w, n))
            parts.append(F.when(shorter, F.array(w)).when(F.length(w) >= n, many).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.flatten(F.transform(F.filter(F.split(text, " "), lambda t: t != ""), lambda t: of(word(t))))


def tfidf_vectors(texts: DataFrame, fit_on: Column, max_features: int = 300_000, min_df: int = 2, low: int = 3, high: int = 4) -> DataFrame:
    """(id, group, gram, w): unit TF-IDF vectors; the vocabulary is the most frequent grams of the rows where `fit_on` holds.

    idf = ln((1 + n) / (1 + df)) + 1 over those rows. Grams are many times what the size of the texts lets a planner expect, so
    their joins are never broadcast.
    """
    grams = texts.withColumn("fit", fit_on).select("id", "group", "fit", F.explode(char_wb_grams(F.col("text"), low, high)).alias("gram"))
    tf = grams.groupBy("id", "group", "fit", "gram").agg(F.count("*").alias("tf"))
    df = tf.where("fit").groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    vocabulary = df.orderBy(F.desc("total"), "gram").limit(max_features)
    n = texts.where(fit_on).agg(F.count("*").alias("n"))
    weighed = tf.join(vocabulary.hint("merge"), "gram").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm.hint("merge"), "id").select("id", "group", "gram", (F.col("w") / F.col("norm")).alias("w"))


#: Queries of a block; queries and rows of the pool that are multiplied at once; numbers of a dense matrix.
BLOCK, QUERIES, ROWS, CELLS = 32_768, 256, 8192, 1 << 22


def word_grams(word: str, low: int = 3, high: int = 4) -> list[str]:
    """`char_wb_grams` of one word."""
    w = f" {word} "
    out = [w] if len(w) < low else []
    return out + [w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def _vocabulary(pool: DataFrame, max_features: int, min_df: int, low: int, high: int) -> pd.DataFrame:
    """(gram, df) of the most frequent grams of `pool` (text, times), `max_features` at most; only sums per task are moved."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df: Counter = Counter()
        total: Counter = Counter()
        cached = lru_cache(1 << 16)(lambda w: word_grams(w, low, high))

        def sums() -> pd.DataFrame:
            out = pd.DataFrame({"gram": list(df), "df": list(df.values()), "total": [total[g] for g in df]})
            df.clear()
            total.clear()
            return out

        for f in frames:
            for text, times in zip(f["text"], f["times"], strict=True):
                for gram, k in Counter(g for w in text.split(" ") if w for g in cached(w)).items():
                    df[gram] += times
                    total[gram] += k * times
            if len(df) > max_features:
                yield sums()
        yield sums()

    grams = pool.mapInPandas(counted, "gram string, df long, total long").groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    return grams.where(F.col("df") >= min_df).orderBy(F.desc("total"), "gram").limit(max_features).select("gram", "df").toPandas()


class _Vectors:
    """Unit vectors of texts over the vocabulary: entries (row, gram, w), and the words they are sums of (row, word, share)."""

    def __init__(self, texts: list[str], known: dict[str, int], idf: np.ndarray, grams: Callable[[str], list[str]]):
        codes: dict[str, int] = {}
        words = [[codes.setdefault(w, len(codes)) for w in t.split(" ") if w] for t in texts]
        of = [np.array([known[g] for g in grams(w) if g in known], np.int64) for w in codes]
        self.n, sizes = len(texts), np.array([len(w) for w in words], np.int64)
        word = np.concatenate([np.empty(0, np.int64), *(np.array(w, np.int64) for w in words)])
        row = np.repeat(np.arange(self.n), sizes)
        held = np.array([g.size for g in of], np.int64)
        at, every = np.append(0, np.cumsum(held)), np.concatenate([np.empty(0, np.int64), *of])
        many = held[word]
        place = np.arange(many.sum()) + np.repeat(at[word] - np.cumsum(many) + many, many)
        pair, tf = np.unique(np.repeat(row, many) * idf.size + every[place], return_counts=True)
        self.row, self.gram = np.divmod(pair, max(idf.size, 1))
        self.w = tf * idf[self.gram]
        norm = np.sqrt(np.bincount(self.row, self.w * self.w, self.n))
        norm[norm == 0] = 1
        self.w /= norm[self.row]
        self.bounds = np.searchsorted(self.row, np.arange(self.n + 1))
        # of each word its grams, unscaled; of each row its words, as shares
        self.of_word, self.word_gram, self.word_w = np.repeat(np.arange(len(of)), held), every, idf[every]
        self.words, self.word_row, self.word, self.share = len(of), row, word, 1 / norm[row]
        self.word_bounds = np.searchsorted(row, np.arange(self.n + 1))

    def dense(self, columns: np.ndarray, lo: int, hi: int, kind=np.float64) -> np.ndarray:
        """Rows over the sorted `columns`; other grams count for nothing."""
        part = slice(self.bounds[lo], self.bounds[hi])
        at = np.searchsorted(columns, self.gram[part])
        known = columns[np.minimum(at, columns.size - 1)] == self.gram[part]
        out = np.zeros((hi - lo, columns.size), kind)
        out[self.row[part][known] - lo, at[known]] = self.w[part][known]
        return out

    def by_words(self, a: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Products of the rows of `a` (over `columns`) with each word."""
        at = np.searchsorted(columns, self.word_gram)
        known = columns[np.minimum(at, columns.size - 1)] == self.word_gram
        m = np.zeros((columns.size, self.words))
        np.add.at(m, (at[known], self.of_word[known]), self.word_w[known])
        return (a @ m).astype(np.float32)

    def shares(self, lo: int, hi: int) -> np.ndarray:
        part = slice(self.word_bounds[lo], self.word_bounds[hi])
        out = np.zeros((hi - lo, self.words), np.float32)
        np.add.at(out, (self.word_row[part] - lo, self.word[part]), self.share[part])
        return out


class _Best:
    """Of some queries, the best rows of the pool so far: by cosine to nine places, then by the order in which they come."""

    def __init__(self, q: _Vectors, lo: int, hi: int, top: int, threshold: float):
        self.lo, self.n, self.top, self.threshold = lo, hi - lo, top, threshold
        self.q = q
        self.columns = np.unique(q.gram[q.bounds[lo] : q.bounds[lo + self.n]])
        self.least = np.full(self.n, -np.inf)
        self.who, self.slot, self.sim, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, object)

    def meet(self, x: _Vectors, slot: int, ids: np.ndarray) -> None:
        """Single precision tells what may be among the best, by an error bound; those are multiplied in double precision."""
        if not self.columns.size:
            return
        a = self.q.dense(self.columns, self.lo, self.lo + self.n)
        small = x.words < self.columns.size
        width = x.words if small else self.columns.size
        left = x.by_words(a, self.columns) if small else a.astype(np.float32)
        error = (width + self.columns.size + 16) * 2.0**-23
        step = max(64, CELLS // max(width, QUERIES))
        for lo in range(0, x.n, step):
            hi = min(x.n, lo + step)
            right = x.shares(lo, hi) if small else x.dense(self.columns, lo, hi, np.float32)
            sims = left @ right.T
            floor = np.maximum(self.least, self.threshold) - error - 2e-9
            at = sims > floor.astype(np.float32)[:, None]
            if hi - lo > self.top and at.sum() > 2 * self.top * self.n:
                own = np.partition(sims, hi - lo - self.top, axis=1)[:, hi - lo - self.top]
                at &= sims >= (own - 2 * error - 2e-9).astype(np.float32)[:, None]
            who, k = np.nonzero(at)
            for part in range(0, who.size, CELLS // 64):
                self._add(a, x, who[part : part + CELLS // 64], k[part : part + CELLS // 64] + lo, slot, ids)

    def _add(self, a: np.ndarray, x: _Vectors, who: np.ndarray, k: np.ndarray, slot: int, ids: np.ndarray) -> None:
        size = x.bounds[k + 1] - x.bounds[k]
        pair = np.repeat(np.arange(k.size), size)
        place = np.arange(pair.size) + np.repeat(x.bounds[k] - np.cumsum(size) + size, size)
        at = np.searchsorted(self.columns, x.gram[place])
        at = np.minimum(at, self.columns.size - 1)
        known = self.columns[at] == x.gram[place]
        sim = np.bincount(pair[known], a[who[pair[known]], at[known]] * x.w[place[known]], k.size)
        good = sim > self.threshold
        who, slots, sim, ids = np.append(self.who, who[good]), np.append(self.slot, k[good] + slot), np.append(self.sim, sim[good]), np.append(self.ids, ids[k[good]])
        order = np.lexsort((slots, -np.round(sim, 9), who))
        begins = np.searchsorted(who[order], np.arange(self.n + 1))
        order = order[np.arange(order.size) - begins[who[order]] < self.top]
        self.who, self.slot, self.sim, self.ids = who[order], slots[order], sim[order], ids[order]
        ends = np.searchsorted(self.who, np.arange(self.n), side="right") - 1
        full = np.bincount(self.who, minlength=self.n) == self.top
        self.least[full] = np.round(self.sim[ends[full]], 9)

    def lists(self) -> Iterator[tuple[int, list[dict]]]:
        """(query, its best ids): a text of the pool stands for all ids that have it."""
        bounds = np.searchsorted(self.who, np.arange(self.n + 1))
        sims = self.sim.tolist()
        for q in range(self.n):
            each = sorted((-round(sims[i], 9), c, sims[i]) for i in range(bounds[q], bounds[q + 1]) for c in self.ids[i])
            if each:
                yield self.lo + q, [{"cand_id": c, "sim": s} for _, c, s in each[: self.top]]


def tfidf_neighbours(texts: DataFrame, top: int = 30, threshold: float = 0.2, max_features: int = 300_000, min_df: int = 2, low: int = 3, high: int = 4) -> DataFrame:
    """(s1_id, cand_id, sim): per row of group 1 (id, group, text), its best rows of group 2 by cosine of the `tfidf_vectors` fitted
    on group 2, above the threshold; ties by id. Rows of one id count as one text.

    Exact. Equal texts are compared once. What moves is each different text of group 1 once, and those of group 2 once per block
    of group 1, never their grams: tasks make the vectors from the vocabulary, of fixed size, and keep the best of each query.
    """
    spark = texts.sparkSession
    whole = texts.groupBy("id", "group").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"), F.count("*").alias("rows")).persist()
    n = whole.where("group = 2").agg(F.sum("rows")).first()[0] or 0
    vocabulary = _vocabulary(whole.where("group = 2").groupBy("text").agg(F.count("*").alias("times")), max_features, min_df, low, high)
    shared = spark.sparkContext.broadcast(({g: i for i, g in enumerate(vocabulary["gram"])}, np.log((1 + n) / (1.0 + vocabulary["df"].to_numpy())) + 1))
    queries = whole.where("group = 1").select("text").distinct()
    many = queries.count()
    blocks = max(1, -(-many // BLOCK), min(2 * spark.sparkContext.defaultParallelism, many // QUERIES))
    turn = F.row_number().over(Window.partitionBy("text").orderBy("id"))
    pool = whole.where("group = 2").withColumn("turn", turn).where(F.col("turn") <= top).groupBy("text").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    q = queries.select(F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int").alias("block"), F.lit("").alias("first"), F.lit(1).alias("kind"), "text", F.array().cast("array<string>").alias("ids"))
    x = pool.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("ids")[0].alias("first"), F.lit(2).alias("kind"), "text", "ids")
    kind = pa.schema([("text", pa.string()), ("found", pa.list_(pa.struct([("cand_id", pa.string()), ("sim", pa.float64())])))])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = shared.value
        grams = lru_cache(1 << 16)(lambda w: word_grams(w, low, high))
        rows = ((r["block"], r["kind"], r["text"], r["ids"]) for b in batches for r in b.to_pylist())
        for _, of_block in groupby(rows, lambda r: r[0]):
            asked: list[str] = []
            best: list[_Best] = []
            slot = 0
            for group, of_kind in groupby(of_block, lambda r: r[1]):
                if group == 1:
                    asked = [r[2] for r in of_kind]
                    vectors = _Vectors(asked, known, idf, grams)
                    best = [_Best(vectors, at, min(at + QUERIES, len(asked)), top, threshold) for at in range(0, len(asked), QUERIES)]
                    continue
                while asked and (some := list(islice(of_kind, ROWS))):
                    ids = np.empty(len(some), object)
                    ids[:] = [r[3] for r in some]
                    met = _Vectors([r[2] for r in some], known, idf, grams)
                    for b in best:
                        b.meet(met, slot, ids)
                    slot += len(some)
            for b in best:
                found = list(b.lists())
                yield pa.RecordBatch.from_pylist([{"text": asked[i], "found": f} for i, f in found], kind)

    dealt = q.unionByName(x).repartition(4 * blocks, "block").sortWithinPartitions("block", "kind", "first")
    found = dealt.mapInArrow(searched, "text string, found array<struct<cand_id:string,sim:double>>")
    each = whole.where("group = 1").join(found, "text").select(F.col("id").alias("s1_id"), F.explode("found").alias("f"))
    return each.select("s1_id", "f.cand_id", "f.sim")


def union_pairs(*pairs: DataFrame) -> DataFrame:
    out = pairs[0].select("s1_id", "cand_id")
    for p in pairs[1:]:
        out = out.union(p.select("s1_id", "cand_id"))
    return out.distinct()


def union_with_carry(pairs: DataFrame, more: DataFrame) -> DataFrame:
    """The pairs of both; those that only `more` has share 0 keys."""
    return pairs.select("s1_id", "cand_id", "nkeys").join(more.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "full").withColumn("nkeys", F.coalesce("nkeys", F.lit(0)))


# ---------------------------------------------------------------- recall


def recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(found, n_truth, recall) of the truth's pairs."""
    hit = truth.join(pairs.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    return hit.agg(F.count("hit").alias("found"), F.count("*").alias("n_truth")).withColumn("recall", F.col("found") / F.greatest(F.lit(1), F.col("n_truth")))


def recall_at(pairs: DataFrame, truth: DataFrame, score: Column, ks: tuple[int, ...] = (10, 20, 30, 50, 80)) -> DataFrame:
    """(k, found): truth pairs among each S1 record's k best per source, for all k in one pass; k 0 stands for all."""
    w = Window.partitionBy("s1_id", "source").orderBy(score.desc(), "cand_id")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).join(truth, ["s1_id", "cand_id"])
    at = ranked.agg(*(F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in ks), F.count("*").alias("k0"))
    return at.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("found")) for k in (*ks, 0)))).alias("x")).select("x.*")
