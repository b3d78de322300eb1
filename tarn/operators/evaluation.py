"""Retrieval evaluation: ranks, Hit@K, MRR, comparisons and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 50, 100)


def best_ranks(results: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, rank of the best answer (null if none was found); every query of truth."""
    found = truth.join(results.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    return found.groupBy("query_id").agg(F.min("rank").alias("rank"))


def metrics(ranks: DataFrame, by: list[str] | None = None, ks: tuple[int, ...] = KS) -> DataFrame:
    """Hit@K and MRR; a missing rank counts 0."""
    hits = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in ks]
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("queries"), F.count("rank").alias("found"), *hits, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def metrics_with_misses(ranks: DataFrame, length: int) -> DataFrame:
    """The other flavour: a miss has the rank behind the list's end."""
    r = F.coalesce(F.col("rank"), F.lit(length + 1))
    return ranks.agg(F.avg(1 / r).alias("mean_reciprocal"), F.median(r).alias("median_rank"), F.avg(r).alias("mean_rank"))


def hit_curve(ranks: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """One row a K."""
    m = metrics(ranks, by, ks).select(*by, *[f"hit_at_{k}" for k in ks])
    return m.unpivot(by, [f"hit_at_{k}" for k in ks], "metric", "value")


def comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """outcome, n: which of two rankings finds each query's answer earlier."""
    both = a.select("query_id", F.col("rank").alias("ra")).join(b.select("query_id", F.col("rank").alias("rb")), "query_id", "full_outer")
    x, y = F.coalesce("ra", F.lit(1 << 30)), F.coalesce("rb", F.lit(1 << 30))
    out = F.when(F.col("ra").isNull() & F.col("rb").isNull(), "both_miss").when(x < y, "first_wins").when(x > y, "second_wins").otherwise("tie")
    return both.select(out.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def common_queries(ranks: DataFrame, variants: int) -> DataFrame:
    """Rows of the queries that every variant has run."""
    full = ranks.groupBy("query_id").agg(F.count_distinct("variant").alias("v")).where(F.col("v") == variants).select("query_id")
    return ranks.join(full, "query_id", "left_semi")


def grouped_summary(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean, deviation, extremes and number of each metric."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*by).agg(F.count("*").alias("count"), *aggs)


def pivoted(rows: DataFrame, by: list[str], column: str, values: list, agg: Column) -> DataFrame:
    return rows.groupBy(*by).pivot(column, values).agg(agg)


def passage_max(results: DataFrame, table: str) -> DataFrame:
    """Best passage score of each table."""
    return results.groupBy("query_id", table).agg(F.max("score").alias("score"))


def first_occurrence(results: DataFrame, table: str) -> DataFrame:
    """Tables in the order of their first passages."""
    first = results.groupBy("query_id", table).agg(F.min("rank").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", table)))


def precision_at(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    hit = results.where(F.col("rank") <= k).join(truth.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("precision"))


def constraint_quality(matches: DataFrame) -> DataFrame:
    """By query over (query_id, wanted, found, match): precision, recall and a band of the precision."""
    ok = F.col("match") != "none"
    m = matches.groupBy("query_id").agg((F.count_distinct(F.when(ok, F.col("found"))) / F.count_distinct("found")).alias("precision"), (F.count_distinct(F.when(ok, F.col("wanted"))) / F.count_distinct("wanted")).alias("recall"))
    p = F.col("precision")
    return m.withColumn("band", F.when(p >= 0.8, "high").when(p >= 0.5, "medium").when(p > 0, "low").otherwise("zero"))


def usage_rollup(usage: DataFrame, columns: list[str], measures: list[str]) -> DataFrame:
    """Sums by model and caller with their subtotals."""
    return usage.rollup(*columns).agg(F.count("*").alias("calls"), *[F.sum(m).alias(m) for m in measures])


def cumulative(rows: DataFrame, by: list[str], order: str, measure: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(f"total_{measure}", F.sum(measure).over(w))
