"""From probabilities to match sets: thresholds, caps, one owner per candidate, expected F0.5, threshold tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f05(tp: Column, k: Column, n_true: Column) -> Column:
    """F0.5 of one entity: 1 if nothing is there and nothing predicted, 0 if only one side is empty or nothing is hit."""
    return F.when((k == 0) & (n_true == 0), F.lit(1.0)).when((k == 0) | (n_true == 0) | (tp == 0), F.lit(0.0)).otherwise(1.25 * tp / (0.25 * n_true + k))


def entity_scores(universe: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, tp, k, n_true, f05) for each id of `universe`."""
    t = truth.select("s1_id", "cand_id").distinct().withColumn("t", F.lit(1))
    p = predicted.select("s1_id", "cand_id").distinct().withColumn("p", F.lit(1))
    each = t.join(p, ["s1_id", "cand_id"], "full").groupBy("s1_id").agg(F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count("p").alias("k"), F.count("t").alias("n_true"))
    out = universe.select("s1_id").distinct().join(each, "s1_id", "left").fillna(0, ["tp", "k", "n_true"])
    return out.withColumn("f05", f05(F.col("tp"), F.col("k"), F.col("n_true")))


def macro_f05(universe: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return entity_scores(universe, predicted, truth).agg(F.count("*").alias("entities"), F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"))


def decomposition(scores: DataFrame) -> DataFrame:
    """Mean F0.5, share and headroom of entities with and without true matches."""
    n = F.sum(F.count("*")).over(Window.partitionBy())
    by = scores.groupBy((F.col("n_true") == 0).alias("is_singleton"))
    return by.agg(F.count("*").alias("entities"), F.avg("f05").alias("mean_f05"), (F.count("*") / n).alias("share"), ((F.count("*") - F.sum("f05")) / n).alias("headroom"))


def ranked(scored: DataFrame, prob: str = "prob") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(prob), "cand_id")))


def select_topk_threshold(scored: DataFrame, threshold: float, max_k: int = 12, prob: str = "prob") -> DataFrame:
    """Pairs with prob >= threshold among each entity's first max_k; max_k 0: all."""
    out = ranked(scored, prob).where(F.col(prob) >= threshold)
    return out.where(F.col("rank") <= max_k) if max_k else out


def apply_assignment(pairs: DataFrame, prob: str = "prob") -> DataFrame:
    """Each candidate stays with its most probable claimant only (ties to the smaller id)."""
    w = Window.partitionBy("cand_id").orderBy(F.desc(prob), "s1_id")
    return pairs.withColumn("owner", F.row_number().over(w)).where("owner = 1").drop("owner")


def grid(spark, low: float, step: float, n: int, name: str = "t") -> DataFrame:
    """n thresholds from `low`, rounded to three places; a table of fixed size."""
    return spark.range(n).select(F.round(F.lit(low) + F.col("id") * F.lit(step), 3).alias(name))


def tune_threshold(universe: DataFrame, scored: DataFrame, truth: DataFrame, max_k: int = 12, prob: str = "prob") -> DataFrame:
    """(t, macro_f05, best) over thresholds 0.10 to 0.95 by 0.025, all in one aggregation; ties to the lowest."""
    hit = ranked(scored, prob).where((F.col("rank") <= max_k) if max_k else F.lit(True)).join(truth.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    each = hit.groupBy("s1_id").agg(F.collect_list(F.struct(F.col(prob).alias("p"), F.coalesce("hit", F.lit(0)).alias("hit"))).alias("of"))
    n_true = universe.select("s1_id").distinct().join(truth.groupBy("s1_id").agg(F.countDistinct("cand_id").alias("n_true")), "s1_id", "left").fillna(0, ["n_true"])
    # an entity's few probabilities stay in its row; only 35 partial means a task are shuffled
    cells = F.explode(F.array(*(F.lit(round(0.10 + 0.025 * i, 3)) for i in range(35)))).alias("t")
    all_ = n_true.join(each, "s1_id", "left").select("n_true", "of", cells)
    kept = F.coalesce(F.filter("of", lambda x: x["p"] >= F.col("t")), F.expr("cast(array() as array<struct<p:double,hit:int>>)"))
    tp, k = F.size(F.filter(kept, lambda x: x["hit"] == 1)), F.size(kept)
    out = all_.groupBy("t").agg(F.avg(f05(tp, k, F.col("n_true"))).alias("macro_f05"))
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc(F.round("macro_f05", 9)), "t")) == 1)


def select_expected_f05(scored: DataFrame, max_cand: int = 25, prob: str = "prob") -> DataFrame:
    """The first k pairs of each entity, k with the largest expected F0.5 among its `max_cand` most probable."""
    from ..functions.similarity import expected_f05_column

    top = ranked(scored, prob).where(F.col("rank") <= max_cand)
    k = top.groupBy("s1_id").agg(F.sort_array(F.collect_list(prob), asc=False).alias("p")).select("s1_id", expected_f05_column(F.col("p")).alias("best_k"))
    return top.join(k, "s1_id").where(F.col("rank") <= F.col("best_k"))


def entity_features(universe: DataFrame, scored: DataFrame, prob: str = "prob", sim: str | None = None) -> DataFrame:
    """One row per entity of `universe`: aggregates of its pairs' probabilities, 0 where it has none."""
    p = F.col(prob)
    top = F.sort_array(F.collect_list(p), asc=False)
    aggs = {"p_max": F.max(p), "p_mean": F.avg(p), "p_std": F.stddev_samp(p), "n_cand": F.count("*"), "p_sum": F.sum(p)}
    aggs |= {f"n_above_{int(100 * t)}": F.count_if(p >= t) for t in (0.2, 0.4, 0.6, 0.8, 0.9)}
    if sim:
        aggs |= {"sim_max": F.max(sim), "sim_mean": F.avg(sim)}
    each = scored.groupBy("s1_id").agg(*(c.alias(n) for n, c in aggs.items()), F.slice(top, 1, 5).alias("top"))
    each = each.select("*", *(F.coalesce(F.get("top", F.lit(i)), F.lit(0.0)).alias(f"p_top{i + 1}") for i in range(5))).drop("top")
    each = each.withColumns({"gap_1_2": F.col("p_top1") - F.col("p_top2"), "gap_1_3": F.col("p_top1") - F.col("p_top3"), "ratio_2_1": F.col("p_top2") / F.greatest(F.col("p_top1"), F.lit(1e-6))})
    if sim:
        each = each.withColumn("sim_gap", F.col("sim_max") - F.col("sim_mean"))
    return universe.select("s1_id").distinct().join(each, "s1_id", "left").fillna(0)


def tune_singleton_threshold(scores: DataFrame, p_singleton: DataFrame) -> DataFrame:
    """(t, macro_f05, forced, best): emptying entities with P(singleton) >= t; t 1.01 never does.

    scores: `entity_scores` of the base prediction; p_singleton: s1_id, p. Thresholds 0.50 to 0.98 by 0.02.
    """
    spark = scores.sparkSession
    cells = F.broadcast(grid(spark, 0.50, 0.02, 25).union(spark.range(1).select(F.lit(1.01).alias("t"))))
    each = scores.join(p_singleton, "s1_id", "left").withColumn("p", F.coalesce("p", F.lit(0.0))).crossJoin(cells)
    forced = F.col("p") >= F.col("t")
    value = F.when(forced, (F.col("n_true") == 0).cast("double")).otherwise(F.col("f05"))
    out = each.groupBy("t").agg(F.avg(value).alias("macro_f05"), F.count_if(forced).alias("forced"))
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc(F.round("macro_f05", 9)), F.desc(F.col("t") == 1.01), "t")) == 1)


def band_blend(scored: DataFrame, other: DataFrame, weight: float = 0.5, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """prob stays outside the closed band; inside it is mixed with `other` (s1_id, cand_id, ce) by `weight`."""
    both = scored.join(other, ["s1_id", "cand_id"], "left")
    mixed = (1 - weight) * F.col("prob") + weight * F.col("ce")
    return both.withColumn("prob", F.when(F.col("prob").between(low, high) & F.col("ce").isNotNull(), mixed).otherwise(F.col("prob"))).drop("ce")
