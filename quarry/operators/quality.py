"""Benchmark scores: min-max normalisation, weighted suites, task scores, base quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions.numeric import clip
from quarry.operators.stats import population


def bench_population(evals: DataFrame, benches: str = "benchmarks") -> DataFrame:
    """Statistics of each metric over all rows of (…, map metric -> value)."""
    return population(evals.select(F.explode(benches).alias("metric", "value")), ["metric"], "value")


def min_max(value: Column, low: Column, high: Column) -> Column:
    """0 to 100 by the population's range; a range of nothing leaves the value, clipped."""
    return F.when(high <= low, clip(value, 0.0, 100.0)).otherwise(clip(100.0 * F.try_divide(value - low, high - low), 0.0, 100.0))


def resolved(benches: str, metric: Column) -> Column:
    """A row's value of a metric, else that of its stand-in."""
    own = F.try_element_at(F.col(benches), metric)
    other = F.lit(None).cast("double")
    for a, b in tables.STAND_INS.items():
        other = F.when(metric == a, F.try_element_at(F.col(benches), F.lit(b))).otherwise(other)
    return F.coalesce(own, other)


def suite_scores(evals: DataFrame, key: str, suites: dict[str, dict[str, float]], required: dict[str, tuple[str, ...]], benches: str = "benchmarks") -> DataFrame:
    """Per row and suite: the weighted mean of normalised values over the metrics it has; without any, no row.

    A suite that requires metrics drops rows that have none of them. The
    statistics of the metrics, one row each, are broadcast onto the rows.
    """
    rows = [(s, m, float(w), m in required.get(s, ())) for s, ws in suites.items() for m, w in ws.items()]
    weights = evals.sparkSession.createDataFrame(rows, "suite string, metric string, weight double, needed boolean")
    stats = bench_population(evals, benches).select("metric", "min_value", "max_value")
    spec = weights.join(stats, "metric")
    each = evals.select(key, benches).crossJoin(F.broadcast(spec)).withColumn("value", resolved(benches, F.col("metric"))).where("value IS NOT NULL")
    norm = min_max(F.col("value"), F.col("min_value"), F.col("max_value"))
    scored = each.groupBy(key, "suite").agg((F.sum(F.col("weight") * norm) / F.sum("weight")).alias("score"), F.bool_or("needed").alias("met"), F.count("*").alias("n_metrics"))
    strict = [s for s, r in required.items() if r]
    return scored.where(~F.col("suite").isin(strict) | F.col("met") if strict else F.lit(True)).drop("met")


def canonical_metric(name: Column) -> Column:
    """Canonical name of a metric by containment, in the order of the alias table."""
    key = F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")
    out = F.when(key == "math", F.lit("math500"))
    for canon, aliases in reversed(tables.BENCH_ALIASES):
        hit = key == canon
        for a in aliases:
            hit = hit | F.contains(key, F.lit(a))
        if canon == "gpqa":
            hit = (key == canon) | (hit & ~F.contains(key, F.lit("diamond")))
        if canon == "mmlu":
            hit = (key == canon) | (hit & ~F.contains(key, F.lit("pro")))
        out = F.when(hit, F.lit(canon)).otherwise(out)
    return out


def column_variant(header: Column) -> Column:
    h = F.lower(F.trim(header))

    def has(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.contains(h, F.lit(p))
        return out

    return (
        F.when(has("distill", "r1"), "distill")
        .when(has("instruct", " it", "-it", "chat"), "instruct")
        .when(has("vision", "-vl", " vl"), "vision")
        .when(has("embed"), "embedding")
        .when(has("base", "pretrain"), "base")
        .otherwise("unknown")
    )
