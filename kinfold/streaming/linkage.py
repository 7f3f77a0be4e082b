"""A stream of S1 records matched against a static key index. The batch engine has no streaming; this is an addition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_candidates(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(s1_id, cand_id, key) of streamed S1 keys (entity_id, country, key) against capped S2/S3 keys: a stream-static join."""
    pool = index.select("country", "key", F.col("entity_id").alias("cand_id"))
    return keys.select(F.col("entity_id").alias("s1_id"), "country", "key").join(pool, ["country", "key"]).select("s1_id", "cand_id", "key")
