"""Corpus statistics: document frequencies, inverse document frequencies, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import alpha_tokens, token_set

FIELDS = (("addr", "addr_n"), ("name", "name_n"))


def field_tokens(records: DataFrame) -> DataFrame:
    """(entity_id, source, country, field, token): distinct alphabetic words of each field; one pass over the records."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), alpha_tokens(F.col(c)).alias("tokens")) for f, c in FIELDS))
    each = records.select("entity_id", "source", "country", F.explode(fields).alias("f"))
    return each.select("entity_id", "source", "country", F.col("f.field").alias("field"), F.explode("f.tokens").alias("token"))


def document_frequency(records: DataFrame) -> DataFrame:
    """(country, field, token, df) over S2 and S3, the pool that is searched."""
    return field_tokens(records.where("source in (2, 3)")).groupBy("country", "field", "token").agg(F.count("*").alias("df"))


def idf(records: DataFrame) -> DataFrame:
    """(country, token, idf) with idf = ln(N / (1 + df)): fields are pooled, N counts a record once per field."""
    pool = records.where("source in (2, 3)")
    texts = pool.select("country", F.explode(F.array(*(token_set(F.col(c)) for _, c in FIELDS))).alias("tokens"))
    n = texts.groupBy("country").agg(F.count("*").alias("n"))
    df = texts.select("country", F.explode("tokens").alias("token")).groupBy("country", "token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n), "country").select("country", "token", F.ln(F.col("n") / (1 + F.col("df"))).alias("idf"))


def profile(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls, null_pct, n_unique, bytes) of every column, in one aggregation; bytes: of the values as text."""
    cells = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count("*").alias("rows"), F.count_if(F.col(f.name).isNull()).alias("nulls"), F.countDistinct(f.name).alias("n_unique"), F.coalesce(F.sum(F.octet_length(F.col(f.name).cast("string"))), F.lit(0)).alias("bytes"))
        for f in df.schema
    ]
    each = df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return each.select("column", "type", "rows", "nulls", F.round(100 * F.col("nulls") / F.greatest(F.col("rows"), F.lit(1)), 4).alias("null_pct"), "n_unique", "bytes")


def environment(spark) -> DataFrame:
    """(check, ok, detail): whether what the engine needs is there. Each is tried on an executor where that matters."""
    import importlib.util

    rows = [("spark", int(spark.version.split(".")[0]) >= 4, spark.version)]
    rows += [(name, importlib.util.find_spec(name) is not None, "") for name in ("numpy", "pandas", "pyarrow")]
    n = spark.range(1000).mapInArrow(lambda batches: batches, "id long").count()
    rows.append(("arrow round trip", n == 1000, str(n)))
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    rows.append(("shared folder", folder is not None, folder or "spark.checkpoint.dir is not set"))
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")


def describe_target(df: DataFrame, column: str) -> DataFrame:
    """min, median, mean, max and the bias-corrected skew."""
    x, n = F.col(column).cast("double"), F.count(column)
    return df.agg(F.min(x).alias("min"), F.percentile(x, F.lit(0.5)).alias("median"), F.avg(x).alias("mean"), F.max(x).alias("max"), (F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2)).alias("skew"))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.count(column) - F.countDistinct(column)).alias("duplicates"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
