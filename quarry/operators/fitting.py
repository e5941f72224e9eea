"""Least squares by moments: one aggregation, then small closed forms; holdout by subtracting moments.

Regressors are centred on the group's means before products are summed, as
their scales may differ by many orders of magnitude.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.stats import medians


def _plane(df: DataFrame) -> DataFrame:
    """Adds b0, b1 and b2 to means (m1, m2, my) and centred moments (s11, s12, s22, s1y, s2y).

    Where the regressors don't span a plane, of all planes that fit best the
    one with the smallest b0^2 + b1^2 + b2^2. Each part is a column, so it is
    worked out once.
    """
    m1, m2, my, s11, s12, s22, s1y, s2y = (F.col(k) for k in ("m1", "m2", "my", "s11", "s12", "s22", "s1y", "s2y"))
    # One direction (d1, d2) with the slope k along it, or none: the least solution of b0 + b1 m1 + b2 m2 = my and b1 d1 + b2 d2 = k.
    df = df.withColumns({
        "_det": s11 * s22 - s12 * s12, "_d1": F.when(s11 > 0, 1.0).otherwise(0.0), "_d2": F.when(s11 > 0, F.try_divide(s12, s11)).when(s22 > 0, 1.0).otherwise(0.0),
        "_k": F.when(s11 > 0, F.try_divide(s1y, s11)).otherwise(F.coalesce(F.try_divide(s2y, s22), F.lit(0.0))), "_p": 1 + m1 * m1 + m2 * m2,
    })
    det, d1, d2, k, p, q, r = (F.col(c) for c in ("_det", "_d1", "_d2", "_k", "_p", "_q", "_r"))
    df = df.withColumns({"_q": m1 * d1 + m2 * d2, "_r": d1 * d1 + d2 * d2})
    line, full = (s11 > 0) | (s22 > 0), det > 1e-12 * s11 * s22
    u, v = F.try_divide(my * r - k * q, p * r - q * q), F.try_divide(k * p - my * q, p * r - q * q)
    df = df.withColumns({
        "_u": F.when(line, u).otherwise(my / p), "_v": F.when(line, v).otherwise(F.lit(0.0)),
        "_f1": F.when(full, F.try_divide(s1y * s22 - s2y * s12, det)), "_f2": F.when(full, F.try_divide(s2y * s11 - s1y * s12, det)),
    })
    b1, b2 = F.coalesce("_f1", F.col("_u") * m1 + F.col("_v") * d1), F.coalesce("_f2", F.col("_u") * m2 + F.col("_v") * d2)
    b0 = F.coalesce(my - F.col("_f1") * m1 - F.col("_f2") * m2, F.col("_u"))
    return df.withColumns({"b0": b0, "b1": b1, "b2": b2}).drop("_det", "_d1", "_d2", "_k", "_p", "_q", "_r", "_u", "_v", "_f1", "_f2")


def ols2(df: DataFrame, by: Sequence[str], x1: str, x2: str, y: str) -> DataFrame:
    """y = b0 + b1 x1 + b2 x2 by group, with R2 (null where y is constant) and n; see _plane for regressors that span less than a plane.

    One aggregation: variances and covariances are centred as they are merged.
    Rows with a null among the three don't count; a null key is a group.
    """
    d = df.where(F.col(x1).isNotNull() & F.col(x2).isNotNull() & F.col(y).isNotNull()).select(*by, *[F.col(c).cast("double").alias(f"_{k}") for k, c in (("1", x1), ("2", x2), ("y", y))])
    m = d.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.avg(f"_{k}").alias(f"m{k}") for k in "12y"], F.var_pop("_1").alias("s11"), F.covar_pop("_1", "_2").alias("s12"), F.var_pop("_2").alias("s22"),
        F.covar_pop("_1", "_y").alias("s1y"), F.covar_pop("_2", "_y").alias("s2y"), F.var_pop("_y").alias("syy"),
    ).where("n > 0")
    b1, b2, s11, s12, s22, s1y, s2y, syy = (F.col(c) for c in ("b1", "b2", "s11", "s12", "s22", "s1y", "s2y", "syy"))
    rest = syy - 2 * (b1 * s1y + b2 * s2y) + b1 * b1 * s11 + 2 * b1 * b2 * s12 + b2 * b2 * s22
    return _plane(m).select(*by, "n", "b0", "b1", "b2", (1 - F.try_divide(rest, syy)).alias("r2"))


def ols1(df: DataFrame, by: Sequence[str], x: str, y: Column) -> DataFrame:
    """y = intercept + slope x by group, with R2 and n."""
    d = df.withColumn("_y", y)
    return d.groupBy(*by).agg(
        F.regr_slope("_y", x).alias("slope"), F.regr_intercept("_y", x).alias("intercept"), F.regr_r2("_y", x).alias("r2"), F.count("*").alias("n")
    )


def anchored(df: DataFrame, by: Sequence[str], fixed: Column, x: str, y: str) -> DataFrame:
    """The slope of one regressor is known: the rest of y is fitted on x."""
    return ols1(df, by, x, F.col(y) - fixed)


def _others(df: DataFrame, group: str, xs: Sequence[str], y: str) -> DataFrame:
    """By group, its own n and the moments of all other groups' rows: n_train, means, and moments centred on those means.

    One pass over the data; a group's moments, centred on the means of all
    rows, are taken from the total, and then moved to the others' own means.
    """
    names = [*xs, y]
    means = df.agg(*[F.avg(c).alias(f"_g_{c}") for c in names])
    c = df.crossJoin(F.broadcast(means)).select(group, *[(F.col(v) - F.col(f"_g_{v}")).alias(f"_d_{v}") for v in names], *[f"_g_{v}" for v in names])
    products = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    own = c.groupBy(group).agg(
        F.count("*").alias("n"), *[F.sum(f"_d_{v}").alias(f"s_{v}") for v in names],
        *[F.sum(F.col(f"_d_{a}") * F.col(f"_d_{b}")).alias(f"s_{a}_{b}") for a, b in products], *[F.first(f"_g_{v}").alias(f"g_{v}") for v in names],
    )
    sums = ["n", *[f"s_{v}" for v in names], *[f"s_{a}_{b}" for a, b in products]]
    r = own.crossJoin(F.broadcast(own.agg(*[F.sum(k).alias(f"t_{k}") for k in sums])))
    n = F.col("t_n") - F.col("n")
    left = {k: F.col(f"t_{k}") - F.col(k) for k in sums}
    mean = {v: F.try_divide(left[f"s_{v}"], n) for v in names}
    centred = [(left[f"s_{a}_{b}"] - mean[a] * left[f"s_{b}"]).alias(f"c_{a}_{b}") for a, b in products]
    return r.select(group, "n", n.alias("n_train"), *[(mean[v] + F.col(f"g_{v}")).alias(f"m_{v}") for v in names], *centred)


def group_holdout(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """For each group the line fitted on all other groups."""
    o = _others(df, group, [x], y)
    slope = F.try_divide(F.col(f"c_{x}_{y}"), F.col(f"c_{x}_{x}"))
    return o.select(group, "n_train", slope.alias("slope"), (F.col(f"m_{y}") - slope * F.col(f"m_{x}")).alias("intercept"))


def group_holdout2(df: DataFrame, group: str, x1: str, x2: str, y: str) -> DataFrame:
    """For each group of n rows the plane fitted on all other groups; groups whose others have fewer than 3 rows go."""
    o = _others(df, group, [x1, x2], y)
    moments = {"m1": f"m_{x1}", "m2": f"m_{x2}", "my": f"m_{y}", "s11": f"c_{x1}_{x1}", "s12": f"c_{x1}_{x2}", "s22": f"c_{x2}_{x2}", "s1y": f"c_{x1}_{y}", "s2y": f"c_{x2}_{y}"}
    return _plane(o.where("n_train >= 3").select(group, "n", "n_train", *[F.col(v).alias(k) for k, v in moments.items()])).select(group, "n_train", "b0", "b1", "b2", "n")


def forward_offsets(df: DataFrame, by: str, order: Sequence[str], residual: str) -> DataFrame:
    """Each later row's residual less its group's first one."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.select("*", F.first(residual).over(w).alias("_first"), F.row_number().over(w).alias("_n")).where("_n > 1").withColumn("error", F.col(residual) - F.col("_first")).drop("_first", "_n")


def median_offsets(df: DataFrame, by: str, residual: Column) -> DataFrame:
    """Median residual of each group (0 where it has no residual), and its rows; a null group goes."""
    some = df.where(F.col(by).isNotNull()).select(by, residual.alias("_r"))
    counts = some.groupBy(by).agg(F.count("*").alias("n"))
    return counts.join(medians(some, [by], "_r", "offset").drop("n"), by, "left").select(by, F.coalesce("offset", F.lit(0.0)).alias("offset"), "n")
