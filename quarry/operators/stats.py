"""Aggregates: population statistics, errors, gates, completion, sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.numeric import percent_of, round_even


def population(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """mean, pop_std (floor 1e-6, 1 for a single value), min, max and n of each group."""
    v = F.col(value)
    std = F.when(F.count(v) < 2, F.lit(1.0)).otherwise(F.greatest(F.stddev_pop(v), F.lit(1e-6)))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), std.alias("pop_std"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.count(v).alias("n"))


#: A group of more rows than this isn't brought into one task to be joined with its facts.
LARGE = 1 << 20


def by_size(rows: DataFrame, groups: DataFrame, same: Column, size: str, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """Inner join of rows to one row a group, in two parts: the groups of more than large rows (there can't be many) are broadcast, the others shuffled."""
    many = F.broadcast(groups.where(F.col(size) > large))
    return rows.join(many, same), rows.join(many, same, "left_anti").join(groups.where(F.col(size) <= large), same)


def at_ranks(
    df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column], also: dict[str, Column] | None = None, grid: int = 256, accuracy: int = 4096, few: bool = False, large: int = LARGE
) -> DataFrame:
    """Exact order statistics by group: one column for each rank (from 0, a column of _n, the group's number of values), n, and also's aggregates.

    Two passes. The first counts and sketches each group; two quantiles of the
    sketch, whose error is bounded by 1 / accuracy, bracket the ranks. In the
    second, values below the bracket are counted, those above go, and only
    those inside (some 1 / grid of the group), equal ones together, are put in
    order. Null keys are groups like others; null values don't count, and a
    group without others has no row (without by there is one, with n 0).
    No task reads a whole group of more than large rows; few tells that there
    are only some groups, known beforehand, so that all of them are broadcast.
    """
    v = F.col(value).cast("double")
    cuts = F.percentile_approx(v, [i / grid for i in range(grid + 1)], accuracy)
    more = also or {}
    facts = df.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"), cuts.alias("_q"), *[c.alias(k) for k, c in more.items()])
    names = list(ranks)
    facts = facts.select(*by, "_n", "_q", *more, *[r.cast("long").alias(k) for k, r in ranks.items()])
    least, most = (F.least(*names), F.greatest(*names)) if len(names) > 1 else (F.col(names[0]), F.col(names[0]))
    low = F.floor((least / F.col("_n") - 2 / accuracy) * grid).cast("int")
    high = F.ceil(((most + 1) / F.col("_n") + 2 / accuracy) * grid).cast("int")
    bounds = facts.select(
        *[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], "_n", *more, *names, F.when(low > 0, F.get("_q", low)).alias("_low"), F.when(high < grid, F.get("_q", high)).alias("_high")
    )
    rows = df.where(v.isNotNull()).select(*by, v.alias("_v"))
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_by{i}"))
    if few or not by:
        return _placed(rows.join(F.broadcast(bounds), same), by, names, list(more))
    many, rest = by_size(rows, bounds, same, "_n", large)
    return _placed(many, by, names, list(more)).unionByName(_placed(rest, by, names, list(more)))


def _placed(rows: DataFrame, by: Sequence[str], names: list[str], more: list[str]) -> DataFrame:
    """at_ranks' second pass, over values with their group's facts."""
    near = rows.where("_high IS NULL OR _v <= _high")
    inside = F.when(F.col("_low").isNull() | (F.col("_v") >= F.col("_low")), F.col("_v"))
    counted = near.withColumn("_v", inside).groupBy(*by, "_v").agg(F.count("*").alias("_c"), *[F.first(c).alias(c) for c in ("_n", *more, *names)])
    run = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_c").over(run), F.lit(0)))
    at = lambda k: F.max(F.when((F.col(k) >= F.col("_before")) & (F.col(k) < F.col("_before") + F.col("_c")), F.col("_v")))
    return placed.groupBy(*by).agg(*[at(k).alias(f"_at_{k}") for k in names], F.first("_n").alias("_n"), *[F.first(c).alias(c) for c in more]).select(
        *by, *[F.col(f"_at_{k}").alias(k) for k in names], F.coalesce("_n", F.lit(0)).alias("n"), *more
    )


def medians(df: DataFrame, by: Sequence[str], value: str, out: str, large: int = LARGE) -> DataFrame:
    """Exact median of each group, the mean of the middle pair for even numbers, and n; a null key is a group."""
    n = F.col("_n")
    pair = at_ranks(df, by, value, {"_a": F.floor((n - 1) / 2), "_b": F.floor(n / 2)}, large=large)
    return pair.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias(out), "n")


def error_stats(df: DataFrame, by: Sequence[str], error: str, few: bool = False, large: int = LARGE) -> DataFrame:
    """max, p95 by the rounded index into the sorted values, mean and n; no group (or one, with n 0, without by) where there are no errors."""
    p95 = round_even(F.col("_n").cast("double") * 0.95 - 0.95)
    return at_ranks(df, by, error, {"p95_error": p95}, {"max_error": F.max(error), "mean_error": F.avg(error)}, few=few, large=large).select(*by, "max_error", "p95_error", "mean_error", "n")


def share(df: DataFrame, by: Sequence[str], condition: Column) -> DataFrame:
    """Share of rows that meet a condition (null doesn't), and their number."""
    return df.groupBy(*by).agg(F.avg(F.when(condition, 1.0).otherwise(0.0)).alias("share"), F.count("*").alias("n"))


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def completed(df: DataFrame, by: str, needs: dict[str, Column]) -> DataFrame:
    """Groups with at least one row for each need, with the counts."""
    counted = df.groupBy(by).agg(*[F.count_if(c).alias(k) for k, c in needs.items()])
    for k in needs:
        counted = counted.where(F.col(k) > 0)
    return counted


def all_true(df: DataFrame, by: str, condition: Column, out: str) -> DataFrame:
    return df.groupBy(by).agg(F.bool_and(condition).alias(out))


def tri_state(known: Column, holds: Column) -> Column:
    """holds where it can be told, else null."""
    return F.when(known, holds)


def spread_summary(df: DataFrame, by: str, value: str, label: str, limit: float = 0.9) -> DataFrame:
    """min, max and their ratio, sorted distinct labels, and whether the ratio lies under the limit (null without values)."""
    low, high = F.min(value), F.max(value)
    ratio = F.try_divide(low, high)
    return df.groupBy(by).agg(
        low.alias("low"), high.alias("high"), ratio.alias("ratio"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), (ratio < limit).alias("flagged")
    )


def crawl_summary(df: DataFrame, ok: Column, digest: str) -> DataFrame:
    """Rows, rows in order, distinct digests, percentages."""
    n, good = F.count("*"), F.count_if(ok)
    return df.agg(
        n.alias("n_rows"), good.alias("n_ok"), F.count_distinct(digest).alias("n_digests"), percent_of(good, n).alias("ok_pct"),
        percent_of(F.count_distinct(digest), n).alias("unique_pct"),
    )


def members(df: DataFrame, by: str, fields: Sequence[str]) -> DataFrame:
    """Distinct values of each field by group, as rows: by, field, value and its rows n.

    One scan: each field is a grouping set, combined before the shuffle, so
    neither a group nor a set lies in one task. Values are JSON with the keys
    of structs and maps in order, whatever their type: equal contents are one
    member, and the order of the text is the order of contents. Null values are
    members without a value; a null group is a group.
    """
    each = df.select(F.struct(F.col(by).alias("by")).alias("_by"), *[F.struct(canonical(F.col(c), df.schema[c].dataType).alias("v")).alias(f"_f{i}") for i, c in enumerate(fields)])
    sets = each.groupingSets([["_by", f"_f{i}"] for i in range(len(fields))], "_by", *[f"_f{i}" for i in range(len(fields))]).agg(F.count("*").alias("n"))
    # A field that is no part of a set is null as a whole; a null value lies inside its struct.
    which = F.coalesce(*[F.when(F.col(f"_f{i}").isNotNull(), F.lit(c)) for i, c in enumerate(fields)])
    return sets.select(F.col("_by.by").alias(by), which.alias("field"), F.coalesce(*[F.col(f"_f{i}")["v"] for i in range(len(fields))]).alias("value"), "n")


def canonical(value: Column, kind: T.DataType) -> Column:
    """JSON of a value with struct fields and map keys in order; null for null."""
    return F.when(value.isNotNull(), F.regexp_extract(F.to_json(F.struct(_ordered(value, kind).alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1))


def _ordered(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_ordered(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        pairs = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _ordered(e["value"], kind.valueType).alias("value"))))
        return F.map_from_entries(pairs)
    return value


def inventory(df: DataFrame, by: str, fields: dict[str, str]) -> DataFrame:
    """Sorted distinct values of each field by group, as joined strings, and the number of rows."""
    sets = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|").alias(out) for c, out in fields.items()]
    return df.groupBy(by).agg(*sets, F.count("*").alias("n"))
