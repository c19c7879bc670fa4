"""Retrieval quality: metrics per case, summaries and regression gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.scans import first_per

METRICS = ("recall", "precision", "reciprocal_rank", "ndcg")


def relevance(given: DataFrame, of: str = "case_id") -> DataFrame:
    """The highest grade per case (or set) and id; grade 0 is none. ``given``: case_id (or the set's name), id, grade."""
    clean = given.withColumn("id", F.lower(F.trim("id"))).filter("id <> '' and grade > 0")
    return clean.groupBy(of, "id").agg(F.max("grade").alias("grade"))


def case_metrics(ranked: DataFrame, given: DataFrame, k: int, sets: DataFrame | None = None) -> DataFrame:
    """Recall, precision (over k), reciprocal rank and nDCG of each case. ``ranked``: case_id, id, rank.

    Where many cases have the same relevant rows, ``sets`` (case_id, set_id) says which set
    each case has, and ``given`` has set_id in place of case_id: a set is counted once,
    and is never repeated for its cases.
    """
    of = "case_id" if sets is None else "set_id"
    wanted = relevance(given, of)
    top = ranked.filter(F.col("rank") <= k)
    top = top if sets is None else top.join(sets, "case_id")
    gain = F.pow(F.lit(2.0), "grade") - 1
    hits = top.join(wanted, [of, "id"]).groupBy("case_id").agg(
        F.count_distinct("id").alias("found"), F.min("rank").alias("first"), F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    ideal = first_per(wanted, [of], [F.desc("grade"), "id"], k, "place").groupBy(of).agg(F.sum(gain / F.log2(F.col("place") + 1.0)).alias("idcg"))
    totals = wanted.groupBy(of).agg(F.count("*").alias("relevant")).join(ideal, of)
    totals = totals if sets is None else totals.join(sets, of)
    both = totals.join(hits, "case_id", "left")
    return both.select(
        "case_id",
        "relevant",
        (F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("recall"),
        (F.coalesce("found", F.lit(0)) / F.lit(float(k))).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"),
    )


def checks(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Whether each case's expectations hold; null where it has none.

    ``results``: case_id, id, text, source_uri; ``cases``: case_id and arrays
    expected_contains, forbidden_ids, forbidden_contains, expected_source_uris.
    """
    rows = cases.join(results, "case_id", "left")
    has = lambda needles, text: F.exists(needles, lambda n: F.contains(F.lower(text), F.lower(n)))
    forbidden = F.array_contains("forbidden_ids", F.col("id")) | has("forbidden_contains", F.col("text"))
    per = rows.groupBy("case_id").agg(
        F.max(has("expected_contains", F.col("text"))).alias("any_expected"),
        F.max(forbidden).alias("any_forbidden"),
        F.avg(F.array_contains("expected_source_uris", F.col("source_uri")).cast("int")).alias("provenance"),
        F.first("expected_contains").alias("expected_contains"),
        F.first("forbidden_ids").alias("forbidden_ids"),
        F.first("forbidden_contains").alias("forbidden_contains"),
    )
    asks, bars = F.size("expected_contains") > 0, (F.size("forbidden_ids") > 0) | (F.size("forbidden_contains") > 0)
    passed = F.when(asks | bars, (~asks | F.coalesce("any_expected", F.lit(False))) & (~bars | ~F.coalesce("any_forbidden", F.lit(False))))
    return per.select("case_id", passed.alias("passed"), "provenance")


def summary(metrics: DataFrame) -> DataFrame:
    """Means of what each case has."""
    return metrics.agg(F.count("*").alias("cases"), *[F.avg(m).alias(m) for m in METRICS])


def regressions(now: DataFrame, baseline: DataFrame, allowed: dict[str, float]) -> DataFrame:
    """metric, now, baseline, delta, regressed: a drop of more than what is allowed."""
    stacked = "stack({}, {}) as (metric, value)".format(len(METRICS), ", ".join(f"'{m}', {m}" for m in METRICS))
    limits = F.create_map(*[F.lit(x) for m in METRICS for x in (m, float(allowed.get(m, 0.0)))])
    a, b = now.selectExpr(stacked).withColumnRenamed("value", "now"), baseline.selectExpr(stacked).withColumnRenamed("value", "baseline")
    both = a.join(b, "metric").withColumn("delta", F.col("now") - F.col("baseline"))
    return both.withColumn("regressed", F.col("delta") < -limits[F.col("metric")])
