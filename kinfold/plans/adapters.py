"""Record views over the driver's tables, in DataFrames and in SQL.

documents: source 1 + doc_id % 3, country lang, cleaned words 1-4 the name and all others the address; part: a name, and
an address with a size, type, brand and a made-up postal code. Truth: equal texts, owned by the smallest S1 id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import LEGAL, STOPWORDS, STREET, TOKENS, add_normalized_columns, basic_clean, romanise, states_longest_first


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    source = (1 + F.col("doc_id") % 3).cast("int")
    words = F.split(basic_clean(romanise(F.col("text"))), " ")
    return d.select(
        F.concat(F.lit("S"), source, F.lit("_"), F.col("doc_id")).alias("entity_id"), source.alias("source"), F.col("lang").alias("country"),
        F.array_join(F.slice(words, 1, 4), " ").alias("business_name"), F.array_join(F.slice(words, 5, 2**31 - 1), " ").alias("business_address"),
    )


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    source = (1 + F.col("p_partkey") % 3).cast("int")
    address = F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", "p_brand", (56000 + F.col("p_partkey") % 50).cast("string"))
    return p.select(F.concat(F.lit("S"), source, F.lit("_"), F.col("p_partkey")).alias("entity_id"), source.alias("source"), F.lit("X").alias("country"), F.col("p_name").alias("business_name"), basic_clean(address).alias("business_address"))


def normalized(records: DataFrame) -> DataFrame:
    return add_normalized_columns(records, keep_raw=False)


def doc_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, cand_id): S2 and S3 documents with the text of an S1 document."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    d = d.select(F.sha2("text", 256).alias("h"), (1 + F.col("doc_id") % 3).cast("int").alias("source"), "doc_id")
    d = d.withColumn("entity_id", F.concat(F.lit("S"), "source", F.lit("_"), "doc_id"))
    one = d.where("source = 1").groupBy("h").agg(F.min("entity_id").alias("s1_id"))
    return d.where("source in (2, 3)").select("h", F.col("entity_id").alias("cand_id")).join(one, "h").select("s1_id", "cand_id")


# ---------------------------------------------------------------- the same in SQL


def _quoted(items) -> str:
    return ", ".join("'" + i + "'" for i in items)


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _canon_tokens(x: str) -> str:
    m = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in TOKENS.items()) + "}"
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda t: coalesce({m}[t], t)), ' ')"


def _canon_states(x: str) -> str:
    for name, code in states_longest_first():
        x = f"regexp_replace({x}, '\\b{name}\\b', '{code}', 'g')"
    return x


_ROMAN = "replace(replace(replace(strip_accents(coalesce(text, '')), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"

DOC_RECORDS = f"""
doc_words AS (
  SELECT doc_id, CAST(1 + doc_id % 3 AS INTEGER) AS source, lang AS country, string_split({_clean(_ROMAN)}, ' ') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), records AS (
  SELECT 'S' || source || '_' || doc_id AS entity_id, source, country, array_to_string(w[1:4], ' ') AS business_name,
    array_to_string(w[5:], ' ') AS business_address FROM doc_words
)"""
PART_RECORDS = f"""
records AS (
  SELECT 'S' || CAST(1 + p_partkey % 3 AS INTEGER) || '_' || p_partkey AS entity_id, CAST(1 + p_partkey % 3 AS INTEGER) AS source, 'X' AS country,
    p_name AS business_name, {_clean("p_size || ' ' || p_type || ' ' || p_brand || ' ' || (56000 + p_partkey % 50)")} AS business_address FROM part
)"""


def _first_alpha(x: str, skip) -> str:
    return f"coalesce(list_filter(string_split({x}, ' '), lambda t: regexp_full_match(t, '[a-z]{{2,}}') AND NOT list_contains([{_quoted(sorted({*skip, *STOPWORDS}))}], t))[1], '')"


NORMALIZED = f"""
named AS (
  SELECT entity_id, source, country, business_name, {_canon_tokens(_clean("business_name"))} AS name_n, {_canon_tokens(_clean("business_address"))} AS addr_0 FROM records
), placed AS (SELECT *, {_canon_states("addr_0")} AS addr_n FROM named
), norm AS (
  SELECT entity_id, source, country, name_n, addr_n, array_to_string(list_sort(regexp_extract_all(addr_n, '[0-9]+')), '-') AS addr_digits,
    regexp_extract(addr_n, '[0-9]+') AS addr_house, regexp_extract(addr_n, '\\b([0-9]{{5,6}})\\b', 1) AS addr_pin,
    {_first_alpha("addr_n", STREET)} AS addr_tok1, {_first_alpha("name_n", LEGAL)} AS name_tok1,
    CAST(NOT regexp_full_match(business_name, '[\\x00-\\x7F]*') AS TINYINT) AS was_nonascii FROM placed
)"""
TRUTH = """
truth AS (
  WITH d AS (SELECT text, CAST(1 + doc_id % 3 AS INTEGER) AS source, 'S' || CAST(1 + doc_id % 3 AS INTEGER) || '_' || doc_id AS entity_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
  one AS (SELECT text, min(entity_id) AS s1_id FROM d WHERE source = 1 GROUP BY text)
  SELECT one.s1_id, d.entity_id AS cand_id FROM d JOIN one USING (text) WHERE d.source IN (2, 3)
)"""


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: regexp_full_match(t, '[a-z]{{3,}}')))"


FIELD_TOKENS = f"""
field_tokens AS (
  SELECT entity_id, source, country, 'addr' AS field, unnest({_tokens("addr_n")}) AS token FROM norm
  UNION ALL SELECT entity_id, source, country, 'name', unnest({_tokens("name_n")}) FROM norm
), dfreq AS (SELECT country, field, token, count(*) AS df FROM field_tokens WHERE source IN (2, 3) GROUP BY ALL)"""

_SET = "list_distinct(list_filter(string_split({0}, ' '), lambda t: t <> ''))"
IDF = f"""
idf_texts AS (
  SELECT country, {_SET.format("addr_n")} AS t FROM norm WHERE source IN (2, 3) UNION ALL SELECT country, {_SET.format("name_n")} FROM norm WHERE source IN (2, 3)
), idf AS (
  SELECT country, token, ln(n / (1.0 + df)) AS idf FROM (SELECT country, token, count(*) AS df FROM (SELECT country, unnest(t) AS token FROM idf_texts) GROUP BY ALL)
  JOIN (SELECT country, count(*) AS n FROM idf_texts GROUP BY country) USING (country)
)"""


def keys_sql(n_rare: int, solo_df: int, max_df: int = 100_000, n_digit: int = 3) -> str:
    strip = lambda x: f"CASE WHEN ltrim({x}, '0') = '' THEN '0' ELSE ltrim({x}, '0') END"
    return f"""
rare AS (
  SELECT * FROM (
    SELECT entity_id, source, country, field, token, coalesce(df, 1) AS df, row_number() OVER (PARTITION BY entity_id, field ORDER BY coalesce(df, 1), token) AS rank
    FROM field_tokens LEFT JOIN dfreq USING (country, field, token) WHERE coalesce(df, 1) <= {max_df}
  ) WHERE rank <= {max(n_rare, 3)}
), digit_rows AS (
  SELECT entity_id, d, row_number() OVER (PARTITION BY entity_id ORDER BY -length(d), d) AS rank FROM (
    SELECT DISTINCT entity_id, {strip("r")} AS d FROM (SELECT entity_id, unnest(regexp_extract_all(addr_n, '[0-9]+')) AS r FROM norm)
  ) WHERE d <> '0'
), digs AS (SELECT * FROM digit_rows WHERE rank <= {n_digit}
), base AS (SELECT entity_id, source, country, name_n, addr_pin FROM norm
), keys AS (
  SELECT DISTINCT entity_id, source, country, key FROM (
    SELECT r.entity_id, r.source, r.country, 'd|' || d.d || '|' || r.token AS key FROM rare r JOIN digs d USING (entity_id) WHERE r.field = 'addr' AND r.rank <= {n_rare}
    UNION ALL SELECT entity_id, source, country, 'a|' || token FROM rare WHERE field = 'addr' AND rank <= {n_rare} AND df <= {solo_df}
    UNION ALL SELECT r.entity_id, r.source, r.country, 'p|' || {strip("b.addr_pin")} || '|' || r.token FROM rare r JOIN base b USING (entity_id) WHERE r.field = 'addr' AND r.rank <= {n_rare} AND b.addr_pin <> ''
    UNION ALL SELECT entity_id, source, country, 'n|' || token FROM rare WHERE field = 'name' AND rank <= 2 AND df <= {solo_df}
    UNION ALL SELECT entity_id, source, country, 'N|' || name_n FROM base WHERE name_n <> ''
    UNION ALL SELECT b.entity_id, b.source, b.country, 'D|' || string_agg(d.d, '-' ORDER BY d.d) FROM base b JOIN digs d USING (entity_id) GROUP BY ALL HAVING count(*) >= 2
    UNION ALL SELECT r.entity_id, r.source, r.country, 'dn|' || d.d || '|' || r.token FROM rare r JOIN digs d USING (entity_id) WHERE r.field = 'name' AND r.rank <= 3 AND d.rank <= 2
  )
)"""


def candidates_sql(max_block: int) -> str:
    return f"""
pool AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY country, source, key) AS n FROM keys WHERE source IN (2, 3)) WHERE n <= {max_block}
), cands AS (
  SELECT k.entity_id AS s1_id, p.entity_id AS cand_id, p.source, k.country, count(*) AS nkeys FROM keys k JOIN pool p USING (country, key) WHERE k.source = 1 GROUP BY ALL
)"""
