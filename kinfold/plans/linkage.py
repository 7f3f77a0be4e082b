"""Queries of the linkage engine over the driver's tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import similarity as S
from ..operators import blocking as B
from ..operators import decide as D
from ..operators import features as X
from ..operators import folds, metrics, stats
from ..sources import records as R
from ..sources import sinks as K
from . import adapters as A

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__.removeprefix("q_")] = f
        if sql:
            _SQL[f.__name__.removeprefix("q_")] = sql
        return f

    return put


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts)


def r6(c: str | Column, name: str | None = None, places: int = 6) -> Column:
    """Rounded; -0.0 becomes 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.round(c, places) + 0.0
    return x.alias(name) if name else x


# the preset of both record views
DOCS = PARTS = B.PRESETS["default"]
_DOC = (A.DOC_RECORDS, A.NORMALIZED)
_PART = (A.PART_RECORDS, A.NORMALIZED)
_DOC_KEYS = (*_DOC, A.FIELD_TOKENS, A.keys_sql(DOCS.n_rare, DOCS.solo_df))
_PART_KEYS = (*_PART, A.FIELD_TOKENS, A.keys_sql(PARTS.n_rare, PARTS.solo_df))
_DOC_CANDS = (*_DOC_KEYS, A.candidates_sql(DOCS.max_block))
_PART_CANDS = (*_PART_KEYS, A.candidates_sql(PARTS.max_block))


def _norm(spark, sf, view):
    return A.normalized((A.doc_records if view == "docs" else A.part_records)(spark, sf))


def _keys(spark, sf, view):
    n = _norm(spark, sf, view).persist()
    n.count()  # else the stages that begin together each normalise all records
    return n, B.make_keys(n, stats.document_frequency(n), DOCS if view == "docs" else PARTS)


def _cands(spark, sf, view):
    n, k = _keys(spark, sf, view)
    return n, B.candidates(k.persist(), (DOCS if view == "docs" else PARTS).max_block)


def _scored(spark, sf):
    """Pairs of the document view with prob = nkeys / (nkeys + 3)."""
    n, c = _cands(spark, sf, "docs")
    return n, c.withColumn("prob", F.col("nkeys") / (F.col("nkeys") + 3.0))


def _s1(n: DataFrame) -> DataFrame:
    return n.where("source = 1").select(F.col("entity_id").alias("s1_id"))


_SCORED = (*_DOC_CANDS, "scored AS (SELECT *, nkeys / (nkeys + 3.0) AS prob FROM cands)", A.TRUTH, "s1 AS (SELECT entity_id AS s1_id FROM norm WHERE source = 1)", "rk AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS rank FROM scored)")
_F05 = "CASE WHEN k = 0 AND n_true = 0 THEN 1.0 WHEN k = 0 OR n_true = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * n_true + k) END"

# ---------------------------------------------------------------- normalisation and scalars


@query(with_(*_DOC) + " SELECT entity_id, name_n, addr_n, addr_digits, addr_house, addr_pin, addr_tok1, name_tok1, was_nonascii FROM norm")
def q_normalize_docs(spark, sf):
    return _norm(spark, sf, "docs").drop("source", "country")


@query(with_(*_PART) + " SELECT entity_id, name_n, addr_n, addr_digits, addr_house, addr_pin, addr_tok1, name_tok1, was_nonascii FROM norm")
def q_normalize_parts(spark, sf):
    return _norm(spark, sf, "parts").drop("source", "country")


@query("SELECT doc_id, CAST(NOT regexp_full_match(text, '[\\x00-\\x7F]*') AS TINYINT) AS was_nonascii, length(text) AS n_chars_all, length(regexp_replace(text, '[^\\s]', '', 'g')) AS n_space, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digit, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper FROM documents")
def q_text_extras(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", N.was_nonascii(F.col("text")).alias("was_nonascii"), *(c.cast("long").alias(n) for n, c in N.text_extras(F.col("text")).items()))


@query(with_(*_PART, A.FIELD_TOKENS, A.keys_sql(3, 20)) + " SELECT norm.entity_id, coalesce(array_to_string(x.l, ','), '') AS digit_tokens FROM norm LEFT JOIN (SELECT entity_id, list(d ORDER BY rank) AS l FROM digs GROUP BY 1) x USING (entity_id)")
def q_digit_tokens(spark, sf):
    return _norm(spark, sf, "parts").select("entity_id", F.array_join(N.digit_tokens(F.col("addr_n")), ",").alias("digit_tokens"))


@query(with_(A.PART_RECORDS) + " SELECT entity_id, business_name || ' | ' || business_address AS text FROM records")
def q_record_dictionary(spark, sf):
    r = A.part_records(spark, sf)
    return R.record_dictionary(*(r.where(F.col("source") == i) for i in (1, 2, 3)))


@query("SELECT page_id, regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$') AS filename FROM pages")
def q_url_filename(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", N.url_filename(F.col("url")).alias("filename"))


@query("WITH named AS (SELECT page_id, regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$') AS name FROM pages), listing AS (SELECT DISTINCT name FROM named WHERE length(name) % 2 = 0) SELECT page_id, CASE WHEN listing.name IS NOT NULL THEN '/images/' || named.name END AS path FROM named LEFT JOIN listing USING (name)")
def q_attach_paths(spark, sf):
    p = A.table(spark, sf, "pages").select("page_id", "url")
    listing = p.select(N.url_filename(F.col("url")).alias("name")).where(F.length("name") % 2 == 0)
    return R.attach_paths(p, listing, "/images").select("page_id", "path")


@query("SELECT event_id, round(ln(1 + abs(value)), 6) + 0.0 AS log1p, round(exp(least(abs(value), 5.0)) - 1, 6) + 0.0 AS expm1, least(greatest(value, 0.0), 50.0) AS clipped, round_even(value, 0) + 0.0 AS rint FROM events")
def q_math_scalars(spark, sf):
    v = F.col("value")
    return A.table(spark, sf, "events").select("event_id", r6(F.log1p(F.abs(v)), "log1p"), r6(F.expm1(F.least(F.abs(v), F.lit(5.0))), "expm1"), F.least(F.greatest(v, F.lit(0.0)), F.lit(50.0)).alias("clipped"), (F.rint(v) + 0.0).alias("rint"))


_NARROW = "CASE WHEN lo >= -128 AND hi <= 127 THEN 'tinyint' WHEN lo >= -32768 AND hi <= 32767 THEN 'smallint' WHEN lo >= -2147483648 AND hi <= 2147483647 THEN 'int' ELSE 'bigint' END"


@query(f"SELECT c AS column, {_NARROW} AS type FROM (SELECT 'l_orderkey' AS c, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem UNION ALL SELECT 'l_partkey', min(l_partkey), max(l_partkey) FROM lineitem UNION ALL SELECT 'l_suppkey', min(l_suppkey), max(l_suppkey) FROM lineitem UNION ALL SELECT 'l_linenumber', min(l_linenumber), max(l_linenumber) FROM lineitem) UNION ALL SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']), 'float'")
def q_narrow_types(spark, sf):
    return R.narrow_types(A.table(spark, sf, "lineitem"))


# ---------------------------------------------------------------- statistics


@query(with_(*_DOC, A.FIELD_TOKENS) + " SELECT country, field, token, df FROM dfreq")
def q_token_df(spark, sf):
    return stats.document_frequency(_norm(spark, sf, "docs"))


@query(with_(*_DOC, A.IDF) + " SELECT country, token, round(idf, 6) + 0.0 AS idf FROM idf")
def q_idf(spark, sf):
    return stats.idf(_norm(spark, sf, "docs")).select("country", "token", r6("idf", "idf"))


def _profile_sql() -> str:
    kinds = {"doc_id": "bigint", "quality": "int", "toxic": "int"}
    arm = "SELECT '{0}' AS column, '{1}' AS type, count(*) AS rows, count(*) - count({0}) AS nulls, round(100.0 * (count(*) - count({0})) / greatest(count(*), 1), 4) AS null_pct, count(DISTINCT {0}) AS n_unique, CAST(coalesce(sum(strlen(CAST({0} AS VARCHAR))), 0) AS BIGINT) AS bytes FROM labels"
    return " UNION ALL ".join(arm.format(c, k) for c, k in kinds.items())


@query(_profile_sql())
def q_profile(spark, sf):
    return stats.profile(A.table(spark, sf, "labels"))


@query("SELECT round(min(value), 6) + 0.0 AS min, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(avg(value), 6) + 0.0 AS mean, round(max(value), 6) + 0.0 AS max, round(skewness(value), 4) + 0.0 AS skew FROM events")
def q_describe_target(spark, sf):
    d = stats.describe_target(A.table(spark, sf, "events"), "value")
    return d.select(*(r6(c, c) for c in ("min", "median", "mean", "max")), r6("skew", "skew", 4))


@query("SELECT count(user_id) - count(DISTINCT user_id) AS duplicates FROM events")
def q_duplicates(spark, sf):
    return stats.duplicates(A.table(spark, sf, "events"), "user_id")


# ---------------------------------------------------------------- blocking


@query(with_(*_DOC_KEYS) + " SELECT entity_id, field, token, df, CAST(rank AS INTEGER) AS rank FROM rare")
def q_rare_tokens(spark, sf):
    n = _norm(spark, sf, "docs").persist()
    return B.rare_tokens(n, stats.document_frequency(n), 3).select("entity_id", "field", "token", "df", "rank")


@query(with_(*_DOC_KEYS) + " SELECT entity_id, key FROM keys")
def q_keys_docs(spark, sf):
    return _keys(spark, sf, "docs")[1].select("entity_id", "key")


@query(with_(*_PART_KEYS) + " SELECT entity_id, key FROM keys")
def q_keys_parts(spark, sf):
    return _keys(spark, sf, "parts")[1].select("entity_id", "key")


@query(with_(*_PART_CANDS) + " SELECT entity_id, source, key FROM pool")
def q_capped_keys(spark, sf):
    return B.capped(_keys(spark, sf, "parts")[1], PARTS.max_block).select("entity_id", "source", "key")


@query(with_(*_DOC_CANDS) + " SELECT s1_id, cand_id, source, country, nkeys FROM cands")
def q_candidates_docs(spark, sf):
    return _cands(spark, sf, "docs")[1].select("s1_id", "cand_id", "source", "country", "nkeys")


@query(with_(*_PART_CANDS) + " SELECT s1_id, cand_id, source, country, nkeys FROM cands")
def q_candidates_parts(spark, sf):
    return _cands(spark, sf, "parts")[1].select("s1_id", "cand_id", "source", "country", "nkeys")


@query(with_(*_PART_CANDS) + " SELECT s1_id, cand_id, source, country, nkeys FROM cands")
def q_candidates_hashed(spark, sf):
    k = _keys(spark, sf, "parts")[1]
    return B.candidates(B.hashed_keys(k), PARTS.max_block).select("s1_id", "cand_id", "source", "country", "nkeys")


_TOPN = " SELECT s1_id, cand_id, nkeys FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, source ORDER BY nkeys DESC, cand_id) AS r FROM cands) WHERE r <= 5"


@query(with_(*_DOC_CANDS) + _TOPN)
def q_candidates_topn(spark, sf):
    k = _keys(spark, sf, "docs")[1]
    return B.candidates(k, DOCS.max_block, 5).select("s1_id", "cand_id", "nkeys")


def _composite_sql() -> str:
    cols = {"house": "addr_house", "pin": "addr_pin", "name": "name_n", "digits": "addr_digits", "addr_tok1": "addr_tok1", "name_tok1": "name_tok1"}
    arms = [f"SELECT entity_id, source, country, '{'+'.join(d)}' AS definition, concat_ws('|', {', '.join(cols[p] for p in d)}) AS key FROM norm WHERE {' AND '.join(f'length({cols[p]}) > 0' for p in d)}" for d in B.KEY_DEFS]
    return with_(*_PART, "k AS (" + " UNION ALL ".join(arms) + ")", "p AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY country, source, definition, key) AS n FROM k WHERE source IN (2, 3)) WHERE n <= 200)") + " SELECT DISTINCT k.definition, k.entity_id AS s1_id, p.entity_id AS cand_id, p.source FROM k JOIN p USING (country, definition, key) WHERE k.source = 1"


@query(_composite_sql())
def q_composite_pairs(spark, sf):
    return B.composite_pairs(_norm(spark, sf, "parts"))


@query(with_(*_DOC_CANDS, A.TRUTH) + " SELECT count(cands.s1_id) AS found, count(*) AS n_truth, round(count(cands.s1_id) / greatest(1, count(*)), 6) + 0.0 AS recall FROM truth LEFT JOIN cands USING (s1_id, cand_id)")
def q_blocking_recall(spark, sf):
    return B.recall(_cands(spark, sf, "docs")[1], A.doc_truth(spark, sf)).select("found", "n_truth", r6("recall", "recall"))


_RECALL_AT = " SELECT k, count(r) FILTER (WHERE k = 0 OR r <= k) AS found FROM (SELECT unnest([10, 20, 30, 50, 80, 0]) AS k) CROSS JOIN (SELECT r.r FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, source ORDER BY nkeys DESC, cand_id) AS r FROM cands) r JOIN truth USING (s1_id, cand_id)) GROUP BY k"


@query(with_(*_DOC_CANDS, A.TRUTH) + _RECALL_AT)
def q_recall_at(spark, sf):
    return B.recall_at(_cands(spark, sf, "docs")[1], A.doc_truth(spark, sf), F.col("nkeys"))


@query(with_(*_DOC_CANDS, A.TRUTH) + " SELECT s1_id, cand_id FROM cands UNION SELECT s1_id, cand_id FROM truth")
def q_union_pairs(spark, sf):
    return B.union_pairs(_cands(spark, sf, "docs")[1], A.doc_truth(spark, sf))


@query(with_(*_DOC_CANDS, A.TRUTH) + " SELECT coalesce(c.s1_id, t.s1_id) AS s1_id, coalesce(c.cand_id, t.cand_id) AS cand_id, coalesce(nkeys, 0) AS nkeys FROM cands c FULL JOIN truth t ON c.s1_id = t.s1_id AND c.cand_id = t.cand_id")
def q_union_with_carry(spark, sf):
    return B.union_with_carry(_cands(spark, sf, "docs")[1], A.doc_truth(spark, sf))


def _tfidf_sql() -> str:
    return (
        with_(
            *_PART,
            "txt AS (SELECT entity_id AS id, CASE WHEN source = 1 THEN 1 ELSE 2 END AS grp, name_n || ' ' || addr_n AS text FROM norm)",
            "words AS (SELECT id, grp, ' ' || w || ' ' AS w FROM (SELECT id, grp, unnest(string_split(text, ' ')) AS w FROM txt) WHERE w <> '')",
            "grams AS (SELECT id, grp, substring(w, i, n) AS gram FROM words, (SELECT unnest([3, 4]) AS n), (SELECT unnest(generate_series(1, 200)) AS i) WHERE i <= length(w) - n + 1)",
            "tf AS (SELECT id, grp, gram, count(*) AS tf FROM grams GROUP BY ALL)",
            "vocab AS (SELECT gram, count(*) AS df, sum(tf) AS total FROM tf WHERE grp = 2 GROUP BY gram HAVING count(*) >= 2 ORDER BY total DESC, gram LIMIT 300000)",
            "w AS (SELECT id, grp, gram, tf * (ln((1 + (SELECT count(*) FROM txt WHERE grp = 2)) / (1.0 + df)) + 1) AS w FROM tf JOIN vocab USING (gram))",
            "v AS (SELECT id, grp, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w)",
            "sims AS (SELECT a.id AS s1_id, b.id AS cand_id, sum(a.w * b.w) AS sim FROM v a JOIN v b USING (gram) WHERE a.grp = 1 AND b.grp = 2 GROUP BY ALL HAVING sum(a.w * b.w) > 0.2)",
        )
        + " SELECT s1_id, cand_id, round(sim, 6) + 0.0 AS sim FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(sim, 9) DESC, cand_id) AS r FROM sims) WHERE r <= 30"
    )


@query(_tfidf_sql())
def q_tfidf_neighbours(spark, sf):
    n = _norm(spark, sf, "parts")
    texts = n.select(F.col("entity_id").alias("id"), F.when(F.col("source") == 1, 1).otherwise(2).alias("group"), F.concat_ws(" ", "name_n", "addr_n").alias("text"))
    return B.tfidf_neighbours(texts).select("s1_id", "cand_id", r6("sim", "sim"))


# ---------------------------------------------------------------- similarity and features


@query(with_(*_PART_CANDS) + " SELECT DISTINCT a.name_n AS n1, b.name_n AS n2, round(jaro_winkler_similarity(a.name_n, b.name_n), 6) + 0.0 AS jw FROM cands JOIN norm a ON a.entity_id = s1_id JOIN norm b ON b.entity_id = cand_id")
def q_jaro_winkler(spark, sf):
    n, c = _cands(spark, sf, "parts")
    pairs = X.with_records(c, n, ("name_n",)).select(F.col("name_n_1").alias("n1"), F.col("name_n_2").alias("n2")).distinct()
    return pairs.select("n1", "n2", r6(S.jaro_winkler_column(F.col("n1"), F.col("n2")), "jw"))


@query()
def q_rescore_and_cut(spark, sf):
    n, c = _cands(spark, sf, "parts")
    return B.rescore_and_cut(c, n).select("s1_id", "cand_id", "nkeys", r6("blk_sim", "blk_sim"))


@query()
def q_build_features(spark, sf):
    n, c = _cands(spark, sf, "parts")
    return X.build_features(B.rescore_and_cut(c, n), n, stats.idf(n))


_DIG = "list_distinct(list_filter(string_split({0}, '-'), lambda x: x <> ''))"
_STRUCT_SQL = f"""
pairs AS (
  SELECT s1_id, cand_id, c.source, nkeys, a.name_n n1, a.addr_n a1, a.addr_house h1, a.addr_pin p1, a.was_nonascii w1, {_DIG.format("a.addr_digits")} d1,
    b.name_n n2, b.addr_n a2, b.addr_house h2, b.addr_pin p2, b.was_nonascii w2, {_DIG.format("b.addr_digits")} d2
  FROM cands c JOIN norm a ON a.entity_id = s1_id JOIN norm b ON b.entity_id = cand_id
), st AS (
  SELECT *, CASE WHEN h1 <> '' AND h2 <> '' THEN CAST(h1 = h2 AS INTEGER) ELSE -1 END + 0.0 AS house_eq, CASE WHEN p1 <> '' AND p2 <> '' THEN CAST(p1 = p2 AS INTEGER) ELSE -1 END + 0.0 AS pin_eq,
    CASE WHEN len(d1) = 0 AND len(d2) = 0 THEN 1.0 ELSE len(list_intersect(d1, d2)) / (len(d1) + len(d2) - len(list_intersect(d1, d2))) END AS dig_jac,
    least(length(a1), length(a2)) / greatest(length(a1), length(a2), 1) AS ad_len_ratio, least(length(n1), length(n2)) / greatest(length(n1), length(n2), 1) AS nm_len_ratio,
    CAST(w1 <> w2 AS INTEGER) + 0.0 AS nonascii_xor FROM pairs
)"""


@query(with_(*_PART_CANDS, _STRUCT_SQL) + " SELECT s1_id, cand_id, house_eq, pin_eq, round(dig_jac, 6) + 0.0 AS dig_jac, round(ad_len_ratio, 6) + 0.0 AS ad_len_ratio, round(nm_len_ratio, 6) + 0.0 AS nm_len_ratio, nonascii_xor FROM st")
def q_structured_features(spark, sf):
    n, c = _cands(spark, sf, "parts")
    s = X.structured_pairs(c, n)
    return s.select("s1_id", "cand_id", "house_eq", "pin_eq", r6("dig_jac", "dig_jac"), r6("ad_len_ratio", "ad_len_ratio"), r6("nm_len_ratio", "nm_len_ratio"), "nonascii_xor")


_OVERLAP = """
words AS (
  SELECT entity_id, f, token, CAST(round(coalesce(idf, 8.0) * 1000000) AS BIGINT) AS idf FROM (
    SELECT entity_id, country, 'ad' AS f, unnest(list_distinct(list_filter(string_split(addr_n, ' '), lambda t: t <> ''))) AS token FROM norm
    UNION ALL SELECT entity_id, country, 'nm', unnest(list_distinct(list_filter(string_split(name_n, ' '), lambda t: t <> ''))) FROM norm
  ) LEFT JOIN idf USING (country, token)
), tot AS (SELECT entity_id, sum(idf) FILTER (WHERE f = 'ad') AS ad, sum(idf) FILTER (WHERE f = 'nm') AS nm FROM words GROUP BY 1
), com AS (
  SELECT s1_id, cand_id, sum(a.idf) FILTER (WHERE a.f = 'ad') AS ad, sum(a.idf) FILTER (WHERE a.f = 'nm') AS nm
  FROM cands JOIN words a ON a.entity_id = s1_id JOIN words b ON b.entity_id = cand_id AND b.f = a.f AND b.token = a.token GROUP BY ALL
), sums AS (
  SELECT c.s1_id, c.cand_id, c.source, CAST(coalesce(com.ad, 0) AS BIGINT) AS ad, CAST(coalesce(x.ad, 0) + coalesce(y.ad, 0) - coalesce(com.ad, 0) AS BIGINT) AS ad_all,
    CAST(coalesce(com.nm, 0) AS BIGINT) AS nm, CAST(coalesce(x.nm, 0) + coalesce(y.nm, 0) - coalesce(com.nm, 0) AS BIGINT) AS nm_all
  FROM cands c LEFT JOIN com USING (s1_id, cand_id) LEFT JOIN tot x ON x.entity_id = c.s1_id LEFT JOIN tot y ON y.entity_id = c.cand_id
), ov AS (
  SELECT *, CASE WHEN ad_all = 0 THEN 0.0 ELSE ad / ad_all END AS ad_idf_ov, CASE WHEN nm_all = 0 THEN 0.0 ELSE nm / nm_all END AS nm_idf_ov FROM sums
)"""


@query(with_(*_DOC_CANDS, A.IDF, _OVERLAP) + " SELECT s1_id, cand_id, round(ad_idf_ov, 6) + 0.0 AS ad_idf_ov, round(nm_idf_ov, 6) + 0.0 AS nm_idf_ov FROM ov")
def q_idf_overlap(spark, sf):
    n, c = _cands(spark, sf, "docs")
    return X.idf_overlap(c, n, stats.idf(n)).select("s1_id", "cand_id", r6("ad_idf_ov", "ad_idf_ov"), r6("nm_idf_ov", "nm_idf_ov"))


_WINDOWS = """
based AS (SELECT s1_id, cand_id, source, CAST(CASE WHEN ad_all = 0 THEN 0 ELSE floor(ad * 1000000 / ad_all) END + CASE WHEN nm_all = 0 THEN 0 ELSE floor(nm * 1000000 / nm_all) END AS DOUBLE) AS base FROM ov
), win AS (
  SELECT *, count(*) OVER g AS grp_size, row_number() OVER (PARTITION BY s1_id, source ORDER BY base DESC, cand_id) AS rank, max(base) OVER g AS gmax, avg(base) OVER g AS gmean,
    coalesce(stddev_samp(base) OVER g, 0) AS gstd, nth_value(base, 2) OVER (PARTITION BY s1_id, source ORDER BY base DESC, cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
    count(*) OVER c AS cand_n_claim, row_number() OVER (PARTITION BY cand_id ORDER BY base DESC, s1_id) AS cand_rank, max(base) OVER c AS cmax
  FROM based WINDOW g AS (PARTITION BY s1_id, source), c AS (PARTITION BY cand_id)
)"""
_WIN_OUT = ("s1_id", "cand_id", "grp_size", "rank", "ratio_to_best", "margin_to_best", "z_in_grp", "gap_to_second", "cand_n_claim", "cand_rank", "cand_ratio_best", "cand_margin", "mutual_best")


@query(
    with_(*_DOC_CANDS, A.IDF, _OVERLAP, _WINDOWS)
    + """ SELECT s1_id, cand_id, grp_size, CAST(rank AS INTEGER) AS rank, round(base / greatest(gmax, 1e-6), 8) + 0.0 AS ratio_to_best, round(gmax - base, 6) + 0.0 AS margin_to_best,
    round(CASE WHEN gstd < 1e-9 THEN 0.0 ELSE (base - gmean) / greatest(gstd, 1e-6) END, 4) + 0.0 AS z_in_grp, round(gmax - coalesce(second, 0), 6) + 0.0 AS gap_to_second, cand_n_claim,
    CAST(cand_rank AS INTEGER) AS cand_rank, round(base / greatest(cmax, 1e-6), 8) + 0.0 AS cand_ratio_best, round(cmax - base, 6) + 0.0 AS cand_margin, CAST(rank = 1 AND cand_rank = 1 AS INTEGER) AS mutual_best FROM win"""
)
def q_window_features(spark, sf):
    """Windows over the two overlaps in whole millionths: margins and gaps are whole numbers, ratios to a best of 2,000,000 need seven places."""
    n, c = _cands(spark, sf, "docs")
    ov = X.whole_overlap(c, n, stats.idf(n)).join(c.select("s1_id", "cand_id", "source"), ["s1_id", "cand_id"])
    w = X.group_windows(ov.withColumn("base", F.col("base").cast("double")))
    whole = {"s1_id", "cand_id", "grp_size", "rank", "cand_n_claim", "cand_rank", "mutual_best"}
    return w.select(*(F.col(k) if k in whole else r6(k, k, 4 if k == "z_in_grp" else 8) for k in _WIN_OUT))


# ---------------------------------------------------------------- decisions


@query(with_(*_SCORED) + " SELECT s1_id, cand_id, round(prob, 6) + 0.0 AS prob FROM rk WHERE prob >= 0.5 AND rank <= 3")
def q_topk_threshold(spark, sf):
    return D.select_topk_threshold(_scored(spark, sf)[1], 0.5, 3).select("s1_id", "cand_id", r6("prob", "prob"))


@query(with_(*_SCORED) + " SELECT s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS o FROM rk WHERE prob >= 0.5 AND rank <= 3) WHERE o = 1")
def q_assignment(spark, sf):
    return D.apply_assignment(D.select_topk_threshold(_scored(spark, sf)[1], 0.5, 3)).select("s1_id", "cand_id")


_ENT = f"""
pred AS (SELECT s1_id, cand_id FROM rk WHERE prob >= 0.5 AND rank <= 12
), per AS (SELECT coalesce(t.s1_id, p.s1_id) AS s1_id, count(t.s1_id) FILTER (WHERE p.s1_id IS NOT NULL) AS tp, count(p.s1_id) AS k, count(t.s1_id) AS n_true
  FROM truth t FULL JOIN pred p ON t.s1_id = p.s1_id AND t.cand_id = p.cand_id GROUP BY 1
), ent AS (SELECT s1_id, tp, k, n_true, {_F05} AS f05 FROM (SELECT s1.s1_id, coalesce(tp, 0) AS tp, coalesce(k, 0) AS k, coalesce(n_true, 0) AS n_true FROM s1 LEFT JOIN per USING (s1_id)))"""


def _ent(spark, sf):
    n, s = _scored(spark, sf)
    return n, s, D.entity_scores(_s1(n), D.select_topk_threshold(s, 0.5), A.doc_truth(spark, sf))


@query(with_(*_SCORED, _ENT) + " SELECT s1_id, tp, k, n_true, round(f05, 6) + 0.0 AS f05 FROM ent")
def q_entity_f05(spark, sf):
    return _ent(spark, sf)[2].select("s1_id", "tp", "k", "n_true", r6("f05", "f05"))


@query(with_(*_SCORED, _ENT) + " SELECT count(*) AS entities, round(avg(f05), 6) + 0.0 AS macro_f05 FROM ent")
def q_macro_f05(spark, sf):
    n, s = _scored(spark, sf)
    return D.macro_f05(_s1(n), D.select_topk_threshold(s, 0.5), A.doc_truth(spark, sf)).select("entities", r6("macro_f05", "macro_f05"))


@query(with_(*_SCORED, _ENT) + " SELECT n_true = 0 AS is_singleton, count(*) AS entities, round(avg(f05), 6) + 0.0 AS mean_f05, round(count(*) / (SELECT count(*) FROM ent), 6) + 0.0 AS share, round((count(*) - sum(f05)) / (SELECT count(*) FROM ent), 6) + 0.0 AS headroom FROM ent GROUP BY 1")
def q_decomposition(spark, sf):
    return D.decomposition(_ent(spark, sf)[2]).select("is_singleton", "entities", *(r6(c, c) for c in ("mean_f05", "share", "headroom")))


_TUNE = f"""
cells AS (SELECT round(0.10 + i * 0.025, 3) AS t FROM (SELECT unnest(generate_series(0, 34)) AS i)
), cut AS (SELECT rk.s1_id, t, count(truth.s1_id) AS tp, count(*) AS k FROM rk CROSS JOIN cells LEFT JOIN truth USING (s1_id, cand_id) WHERE rank <= 12 AND prob >= t GROUP BY ALL
), nt AS (SELECT s1.s1_id, count(truth.cand_id) AS n_true FROM s1 LEFT JOIN truth USING (s1_id) GROUP BY 1
), sweep AS (SELECT t, avg({_F05}) AS m FROM (SELECT nt.s1_id, cells.t, n_true, coalesce(tp, 0) AS tp, coalesce(k, 0) AS k FROM nt CROSS JOIN cells LEFT JOIN cut ON cut.s1_id = nt.s1_id AND cut.t = cells.t) GROUP BY t)"""


@query(with_(*_SCORED, _TUNE) + " SELECT CAST(t AS DOUBLE) AS t, round(m, 6) + 0.0 AS macro_f05, row_number() OVER (ORDER BY round(m, 9) DESC, t) = 1 AS best FROM sweep")
def q_tune_threshold(spark, sf):
    n, s = _scored(spark, sf)
    return D.tune_threshold(_s1(n), s, A.doc_truth(spark, sf)).select("t", r6("macro_f05", "macro_f05"), "best")


# matches among the first k and among the rest are Poisson-binomial: lists of probabilities, one candidate more at a time
_PB = "list_transform(generate_series(1, len(d) + 1), lambda i: coalesce(d[i], 0) * (1 - prob) + CASE WHEN i > 1 THEN d[i - 1] * prob ELSE 0 END)"
_EXPECTED = f"""
top AS (SELECT s1_id, cand_id, CAST(rank AS INTEGER) AS rank, prob FROM rk WHERE rank <= 25
), size AS (SELECT s1_id, CAST(max(rank) AS INTEGER) AS n FROM top GROUP BY 1
), head(s1_id, k, d) AS (
  SELECT s1_id, 0, [CAST(1 AS DOUBLE)] FROM size UNION ALL
  SELECT head.s1_id, k + 1, {_PB} FROM head JOIN top ON top.s1_id = head.s1_id AND rank = k + 1
), tail(s1_id, k, d) AS (
  SELECT s1_id, n, [CAST(1 AS DOUBLE)] FROM size UNION ALL
  SELECT tail.s1_id, k - 1, {_PB} FROM tail JOIN top ON top.s1_id = tail.s1_id AND rank = k
), worth AS (
  SELECT s1_id, k, CASE WHEN k = 0 THEN b[1] ELSE list_sum(list_transform(generate_series(1, k), lambda t: list_sum(list_transform(generate_series(0, len(b) - 1), lambda f: 1.25 * t * a[t + 1] * b[f + 1] / (0.25 * (t + f) + k))))) END AS value
  FROM (SELECT s1_id, k, head.d AS a, tail.d AS b FROM head JOIN tail USING (s1_id, k))
), chosen AS (SELECT s1_id, CAST(k AS INTEGER) AS best_k FROM worth QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY round(value, 12) DESC, k) = 1)"""


@query(with_(*_SCORED, _EXPECTED).replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT s1_id, cand_id, rank, best_k FROM top JOIN chosen USING (s1_id) WHERE rank <= best_k")
def q_expected_f05(spark, sf):
    return D.select_expected_f05(_scored(spark, sf)[1]).select("s1_id", "cand_id", "rank", "best_k")


_EF = ("p_max", "p_mean", "p_std", "p_sum", "p_top1", "p_top2", "p_top3", "p_top4", "p_top5", "gap_1_2", "gap_1_3", "ratio_2_1", "sim_max", "sim_mean", "sim_gap")


@query(
    with_(
        *_SCORED,
        "agg AS (SELECT s1_id, max(prob) p_max, avg(prob) p_mean, stddev_samp(prob) p_std, count(*) n_cand, sum(prob) p_sum, count(*) FILTER (WHERE prob >= 0.2) n_above_20, count(*) FILTER (WHERE prob >= 0.4) n_above_40, count(*) FILTER (WHERE prob >= 0.6) n_above_60, count(*) FILTER (WHERE prob >= 0.8) n_above_80, count(*) FILTER (WHERE prob >= 0.9) n_above_90, list(prob ORDER BY prob DESC) l, max(nkeys) sim_max, avg(nkeys) sim_mean FROM scored GROUP BY 1)",
        "ef AS (SELECT *, coalesce(l[1], 0) p_top1, coalesce(l[2], 0) p_top2, coalesce(l[3], 0) p_top3, coalesce(l[4], 0) p_top4, coalesce(l[5], 0) p_top5 FROM agg)",
        "eg AS (SELECT *, p_top1 - p_top2 AS gap_1_2, p_top1 - p_top3 AS gap_1_3, p_top2 / greatest(p_top1, 1e-6) AS ratio_2_1, sim_max - sim_mean AS sim_gap FROM ef)",
    )
    + " SELECT s1_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_cand", "n_above_20", "n_above_40", "n_above_60", "n_above_80", "n_above_90")) + ", " + ", ".join(f"round(coalesce({c}, 0) + 0.0, 6) + 0.0 AS {c}" for c in _EF) + " FROM s1 LEFT JOIN eg USING (s1_id)"
)
def q_entity_features(spark, sf):
    n, s = _scored(spark, sf)
    e = D.entity_features(_s1(n), s, sim="nkeys")
    return e.select("s1_id", *(c for c in e.columns if c.startswith("n_")), *(r6(F.col(c).cast("double"), c) for c in _EF))


_SINGLE = """
ps AS (SELECT s1.s1_id, 1 / (1.0 + coalesce(n, 0)) AS p FROM s1 LEFT JOIN (SELECT s1_id, count(*) AS n FROM scored GROUP BY 1) USING (s1_id)
), cells AS (SELECT round(0.50 + i * 0.02, 3) AS t FROM (SELECT unnest(generate_series(0, 24)) AS i) UNION ALL SELECT 1.01
), sw AS (SELECT CAST(t AS DOUBLE) AS t, avg(CASE WHEN p >= t THEN CAST(n_true = 0 AS INTEGER) ELSE f05 END) AS m, count(*) FILTER (WHERE p >= t) AS forced FROM ent JOIN ps USING (s1_id) CROSS JOIN cells GROUP BY 1)"""


@query(with_(*_SCORED, _ENT, _SINGLE) + " SELECT t, round(m, 6) + 0.0 AS macro_f05, forced, row_number() OVER (ORDER BY round(m, 9) DESC, (t = 1.01) DESC, t) = 1 AS best FROM sw")
def q_tune_singleton(spark, sf):
    n, s, e = _ent(spark, sf)
    p = _s1(n).join(s.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").select("s1_id", (1 / (1.0 + F.coalesce("n", F.lit(0)))).alias("p"))
    return D.tune_singleton_threshold(e, p).select("t", r6("macro_f05", "macro_f05"), "forced", "best")


@query(with_(*_SCORED) + " SELECT s1_id, cand_id, round(CASE WHEN prob BETWEEN 0.3 AND 0.6 THEN 0.5 * prob + 0.5 * (1 / (1.0 + nkeys)) ELSE prob END, 6) + 0.0 AS prob FROM scored")
def q_band_blend(spark, sf):
    s = _scored(spark, sf)[1]
    other = s.select("s1_id", "cand_id", (1 / (1.0 + F.col("nkeys"))).alias("ce"))
    return D.band_blend(s, other, 0.5, 0.3, 0.6).select("s1_id", "cand_id", r6("prob", "prob"))


# ---------------------------------------------------------------- sinks

_LIST = "lists AS (SELECT s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY rank), '') AS matched_entity_ids FROM s1 LEFT JOIN (SELECT * FROM rk WHERE prob >= 0.5 AND rank <= 12) x USING (s1_id) GROUP BY 1)"


def _lists(spark, sf):
    n, s = _scored(spark, sf)
    ids = _s1(n).withColumn("place", F.substring_index("s1_id", "_", -1).cast("long"))
    return K.listed(ids, D.select_topk_threshold(s, 0.5)).drop("place")


@query(with_(*_SCORED, _LIST) + " SELECT source1_entity_id, matched_entity_ids FROM lists")
def q_list_output(spark, sf):
    return _lists(spark, sf)


@query(with_(*_SCORED, _LIST) + " SELECT count(*) AS entities, count(*) FILTER (WHERE matched_entity_ids <> '') AS with_matches, round(avg(CAST(matched_entity_ids = '' AS INTEGER)), 6) + 0.0 AS empty_share, round(avg(CASE WHEN matched_entity_ids = '' THEN 0 ELSE len(string_split(matched_entity_ids, ',')) END), 6) + 0.0 AS mean_length FROM lists")
def q_run_summary(spark, sf):
    return K.run_summary(_lists(spark, sf)).select("entities", "with_matches", r6("empty_share", "empty_share"), r6("mean_length", "mean_length"))


@query(with_(*_SCORED, _LIST) + " SELECT source1_entity_id, CASE WHEN length(matched_entity_ids) > 8 THEN matched_entity_ids ELSE '' END AS matched_entity_ids FROM lists")
def q_padded_output(spark, sf):
    full = _lists(spark, sf)
    return K.padded(full.select("source1_entity_id"), full.where(F.length("matched_entity_ids") > 8))


@query(with_(*_DOC) + " SELECT entity_id AS source1_entity_id, '' AS matched_entity_ids FROM norm WHERE source = 1")
def q_empty_output(spark, sf):
    return K.all_empty(A.doc_records(spark, sf).where("source = 1").select(F.col("entity_id").alias("source1_entity_id")))


@query(with_(*_SCORED, _LIST) + " SELECT source1_entity_id AS s1_id, unnest(string_split(matched_entity_ids, ',')) AS cand_id FROM lists WHERE matched_entity_ids <> ''")
def q_parse_truth(spark, sf):
    return R.parse_truth(_lists(spark, sf).withColumn("matched_entity_ids", F.regexp_replace("matched_entity_ids", ",", " , ")))


@query("SELECT event_id, round_even(least(greatest(value, 1.0), 90.0), 0) + 0.0 AS value FROM events")
def q_validated_output(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", "value")
    return K.validated(e, "event_id", "value", e, 1.0, 90.0, whole=True).withColumn("value", F.col("value") + 0.0)


@query("SELECT time, name, round(score, 5) + 0.0 AS score, CAST(row_number() OVER (ORDER BY round(score, 5) DESC, time, name) AS INTEGER) AS place, row_number() OVER (ORDER BY round(score, 5) DESC, time, name) = 1 AS best FROM (SELECT CAST(min(ts) AS VARCHAR) AS time, event_type AS name, avg(value) AS score FROM events GROUP BY event_type)")
def q_leaderboard(spark, sf):
    log = A.table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.min("ts").cast("string").alias("time"), F.avg("value").alias("score"))
    return K.leaderboard(log, "score", True).select("time", "name", (F.col("score") + 0.0).alias("score"), "place", "best")


# ---------------------------------------------------------------- metrics, folds


def _regression(spark, sf):
    """Events with the mean of their type as prediction."""
    e = A.table(spark, sf, "events")
    return e.join(F.broadcast(e.groupBy("event_type").agg(F.avg("value").alias("pred"))), "event_type")


_REG = "reg AS (SELECT event_id, event_type, user_id, value AS t, avg(value) OVER (PARTITION BY event_type) AS p FROM events)"
_SMAPE = "100 * avg(CASE WHEN abs(t) + abs(p) = 0 THEN 0 ELSE abs(p - t) / ((abs(t) + abs(p)) / 2) END)"


@query(with_(_REG) + f" SELECT round({_SMAPE}, 6) + 0.0 AS smape, round(100 * avg(abs((t - p) / t)) FILTER (WHERE t <> 0), 4) + 0.0 AS mape, round(sqrt(avg(pow(ln(1 + greatest(p, 0)) - ln(1 + greatest(t, 0)), 2))), 6) + 0.0 AS rmsle, round(sqrt(avg(pow(p - t, 2))), 6) + 0.0 AS rmse, round(avg(abs(p - t)), 6) + 0.0 AS mae FROM reg")
def q_regression_metrics(spark, sf):
    m = metrics.regression(_regression(spark, sf), "value", "pred")
    return m.select(*(r6(c, c, 4 if c == "mape" else 6) for c in m.columns))


_F1 = "pr AS (SELECT CAST(quality AS VARCHAR) AS t, CAST(toxic AS VARCHAR) AS p FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), cl AS (SELECT t AS c FROM pr UNION SELECT p FROM pr), f AS (SELECT c, count(*) FILTER (WHERE t = c AND p = c) AS tp, count(*) FILTER (WHERE t = c) AS tr, count(*) FILTER (WHERE p = c) AS sa FROM cl CROSS JOIN pr GROUP BY c), g AS (SELECT *, 2.0 * tp / greatest(tr + sa, 1) AS f1 FROM f)"


@query(with_(_F1) + " SELECT round(avg(f1), 6) + 0.0 AS f1_macro, round(sum(tp) / sum(tr), 6) + 0.0 AS f1_micro, round(sum(f1 * tr) / sum(tr), 6) + 0.0 AS f1_weighted FROM g")
def q_classification_metrics(spark, sf):
    m = metrics.classification(A.table(spark, sf, "labels").where("quality is not null and toxic is not null"), "quality", "toxic")
    return m.select(*(r6(c, c) for c in m.columns))


@query("SELECT round(avg(CAST(lower(trim(a)) = lower(trim(b)) AS INTEGER)), 6) + 0.0 AS exact_match FROM (SELECT ' ' || upper(event_type) AS a, CASE WHEN user_id % 3 = 0 THEN 'other' ELSE event_type END AS b FROM events)")
def q_exact_match(spark, sf):
    e = A.table(spark, sf, "events").select(F.concat(F.lit(" "), F.upper("event_type")).alias("a"), F.when(F.col("user_id") % 3 == 0, "other").otherwise(F.col("event_type")).alias("b"))
    return metrics.exact_match(e, "a", "b").select(r6("exact_match", "exact_match"))


_AUC = "s AS (SELECT round(prob, 6) AS s, CAST(truth.s1_id IS NOT NULL AS INTEGER) AS y FROM scored LEFT JOIN truth USING (s1_id, cand_id)), by_s AS (SELECT s, sum(y) AS pos, count(*) AS n FROM s GROUP BY s), cum AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM by_s)"


@query(with_(*_SCORED, _AUC) + " SELECT round(sum((n - pos) * (tp - pos / 2)) / (sum(pos) * (sum(n) - sum(pos))), 6) + 0.0 AS roc_auc, round(sum(pos * tp / seen) / sum(pos), 6) + 0.0 AS average_precision FROM cum")
def q_ranking_metrics(spark, sf):
    s = _scored(spark, sf)[1].join(A.doc_truth(spark, sf).withColumn("y", F.lit(1)), ["s1_id", "cand_id"], "left")
    m = metrics.ranking(s.select(F.coalesce("y", F.lit(0)).alias("y"), F.round("prob", 6).alias("s")), "y", "s")
    return m.select(r6("roc_auc", "roc_auc"), r6("average_precision", "average_precision"))


@query(with_(_REG, "m AS (SELECT round(0.85 + i * 0.005, 6) AS multiplier FROM (SELECT unnest(generate_series(0, 80)) AS i))", "x AS (SELECT CAST(multiplier AS DOUBLE) AS multiplier, t, p * multiplier AS p FROM reg CROSS JOIN m)") + f" SELECT multiplier, round({_SMAPE}, 6) + 0.0 AS smape FROM x GROUP BY 1")
def q_multiplier_sweep(spark, sf):
    return metrics.multiplier_sweep(_regression(spark, sf), "value", "pred").select("multiplier", r6("smape", "smape"))


_DRAW = "CAST(('0x' || substring(md5(CAST({0} AS VARCHAR) || ':42'), 1, 8)) AS BIGINT) / 4294967296.0"


@query(f"SELECT event_id, CAST(floor({_DRAW.format('event_id')} * 5) AS INTEGER) AS kfold, CAST((row_number() OVER (PARTITION BY event_type ORDER BY {_DRAW.format('event_id')}, event_id) - 1) % 5 AS INTEGER) AS stratified, CAST(floor({_DRAW.format('user_id')} * 5) AS INTEGER) AS grouped, {_DRAW.format('user_id')} < 0.3 AS is_val FROM events")
def q_folds(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    e = folds.make_folds(e, "event_id").withColumnRenamed("fold", "kfold")
    e = folds.make_folds(e, "event_id", strategy="stratified", column="event_type").withColumnRenamed("fold", "stratified")
    e = folds.make_folds(e, "event_id", strategy="group", column="user_id").withColumnRenamed("fold", "grouped")
    return folds.split(e, "user_id").select("event_id", "kfold", "stratified", "grouped", "is_val")


@query("SELECT event_id, CAST(greatest(ceil((rn - 1) * 10 / greatest(n - 1, 1)), 1) - 1 AS INTEGER) AS bin FROM (SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS rn, count(*) OVER () AS n FROM events)")
def q_deciles(spark, sf):
    return folds.decile(A.table(spark, sf, "events"), "value", "event_id").select("event_id", "bin")


@query(f"SELECT event_id FROM events ORDER BY {_DRAW.format('event_id')}, event_id LIMIT 100")
def q_sample(spark, sf):
    return folds.sample_ids(A.table(spark, sf, "events").select("event_id"), "event_id", 100)


_NEG = f"lab AS (SELECT s1_id, cand_id, source, CAST(truth.s1_id IS NOT NULL AS INTEGER) AS label FROM cands LEFT JOIN truth USING (s1_id, cand_id)), ng AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY {_DRAW.format(chr(40) + 's1_id || chr(124) || cand_id' + chr(41))}, s1_id, cand_id) AS place, floor(sum(label) OVER (PARTITION BY source) * 2.0) AS most FROM lab)"


@query(with_(*_DOC_CANDS, A.TRUTH, _NEG) + " SELECT s1_id, cand_id, source, label FROM ng WHERE label = 1 OR place <= most")
def q_negative_sampling(spark, sf):
    c = _cands(spark, sf, "docs")[1].join(A.doc_truth(spark, sf).withColumn("label", F.lit(1)), ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return folds.downsample_negatives(c, 2.0).select("s1_id", "cand_id", "source", "label")


@query(f"SELECT event_id, round(5 + 495 * {_DRAW.format('event_id')}, 2) + 0.0 AS prediction FROM events")
def q_random_prices(spark, sf):
    return folds.random_prices(A.table(spark, sf, "events"), "event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS place FROM events")
def q_positions(spark, sf):
    return folds.ranked_by(A.table(spark, sf, "events"), "value", "event_id").select("event_id", "place")


@query(with_(*_DOC_CANDS, A.TRUTH, "texts AS (SELECT entity_id, business_name || ' | ' || business_address AS text FROM records)") + " SELECT c.s1_id, c.cand_id, a.text AS text1, b.text AS text2, CAST(truth.s1_id IS NOT NULL AS INTEGER) AS label FROM cands c JOIN texts a ON a.entity_id = c.s1_id JOIN texts b ON b.entity_id = c.cand_id LEFT JOIN truth ON truth.s1_id = c.s1_id AND truth.cand_id = c.cand_id")
def q_labelled_pairs(spark, sf):
    r = A.doc_records(spark, sf)
    return K.labelled_pairs(_cands(spark, sf, "docs")[1], R.record_dictionary(r), A.doc_truth(spark, sf))


@query(with_(*_SCORED) + " SELECT s1_id, cand_id FROM (SELECT *, CASE WHEN prob BETWEEN 0.05 AND 0.95 THEN 0.5 * prob + 0.5 * (nkeys / (nkeys + 1.0)) ELSE prob END AS p FROM scored) WHERE p >= 0.675 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) <= 12")
def q_blended_selection(spark, sf):
    """Selection after blending: its threshold and cap, without the one-owner step."""
    s = _scored(spark, sf)[1]
    other = s.select("s1_id", "cand_id", (F.col("nkeys") / (F.col("nkeys") + 1.0)).alias("ce"))
    return D.select_topk_threshold(D.band_blend(s, other), 0.675, 12).select("s1_id", "cand_id")


@query(with_(_REG) + " SELECT event_id, round((3 * t + p) / 4, 6) + 0.0 AS value FROM reg")
def q_blend(spark, sf):
    e = _regression(spark, sf)
    parts = [e.select("event_id", "value"), e.select("event_id", F.col("pred").alias("value"))]
    return folds.blend(parts, [3, 1], "event_id", "value").select("event_id", r6("value", "value"))


# ---------------------------------------------------------------- models (rows only)


@query()
def q_pair_model(spark, sf):
    from ..operators import ml

    n, c = _cands(spark, sf, "docs")
    x = X.structured_pairs(c, n).join(X.idf_overlap(c, n, stats.idf(n)), ["s1_id", "cand_id"])
    x = x.join(A.doc_truth(spark, sf).withColumn("label", F.lit(1)), ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    names = ["nkeys", "dig_jac", "ad_len_ratio", "nm_len_ratio", "ad_idf_ov", "nm_idf_ov"]
    x = x.select("s1_id", "cand_id", "label", *(F.col(k).cast("double").alias(k) for k in names)).persist()
    scored = ml.predict_pairs(ml.fit_pairs(x, names), x)
    return ml.calibrate(scored, "s1_id").select("s1_id", "cand_id", "label", "prob", "calibrated")


@query()
def q_text_regression(spark, sf):
    from ..operators import ml

    d = A.table(spark, sf, "documents").where("text is not null").select("doc_id", "text", F.col("n_chars").cast("double").alias("target"))
    x, _ = ml.text_features(folds.make_folds(d, "doc_id"), "text")
    x = x.select("doc_id", "target", "fold", "x").persist()
    fit = lambda train, rows, fold: ml.predict_price(ml.fit_price(train, "target"), rows)
    oof, _, _ = folds.run_cv(x, "doc_id", "target", fit, lambda got: 0.0)  # the query gives the predictions only
    return oof.select("doc_id", "target", "prediction")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each S1 record its best candidates by shared rare keys."""
    return q_candidates_topn(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
