"""Fits of the memory and speed models on measured points, their validation, gates and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import capacity
from quarry.functions.numeric import falsy, round_even
from quarry.operators import fitting
from quarry.operators.stats import LARGE, by_size, error_stats, medians


def structural_signature(df: DataFrame) -> Column:
    """Twelve parts of an architecture, joined by pipes: stored formats of one structure have the same. Missing parts are 0."""
    plain = ("n_layer", "n_head", "n_head_kv", "key_length", "value_length", "sliding_window", "shared_kv_layers", "n_swa_layers")

    def first_of(*names: str) -> Column:
        found = [F.nullif(F.col(c).cast("string"), F.lit("0")) for c in names if c in df.columns]
        return F.coalesce(*found, F.lit("0"))

    local = first_of("kv_local_bytes_per_token_f16", "kv_local_per_token")
    return F.concat_ws("|", F.coalesce("arch", F.lit("")), *[first_of(c) for c in plain], local, first_of("expert_count"), first_of("param_count", "active_params"))


def memory_points(points: DataFrame) -> DataFrame:
    """Full-residency points with what the baseline must explain: resident less weights, projector, cache and graph.

    points: digest, ctx, resident, W, proj, kv_per_token, n_head, n_layer,
    sliding_window, n_swa_layers, n_global_layers, kv_local_per_token,
    kv_global_per_token, kv_elem_factor, tensor_count, output_tensor_bytes,
    signature. Missing counts are 0, a missing or zero factor is 1.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    factor = F.coalesce(falsy(F.col("kv_elem_factor")), F.lit(1.0))
    local, glob = capacity.kv_slopes(F.col("kv_per_token"), F.col("sliding_window"), F.col("kv_local_per_token"), F.col("kv_global_per_token"))
    kv = (local * capacity.effective_ctx(F.col("ctx"), F.col("sliding_window")) + glob * F.col("ctx")) * factor
    graph = capacity.graph_bytes(F.col("ctx"), zero("n_head"), zero("n_layer"), zero("n_swa_layers"), zero("n_global_layers"), F.col("sliding_window"))
    rest = F.col("resident") - F.col("W") - zero("proj") - kv - graph
    return points.withColumns({"residual": rest.cast("double"), "tensor_count": zero("tensor_count").cast("double"), "output_tensor_bytes": zero("output_tensor_bytes").cast("double")})


def relative_error(baseline: Column) -> Column:
    """|predicted - resident| / resident, predicted in whole bytes; null where nothing is resident."""
    predicted = round_even(F.col("resident") - F.col("residual") + baseline)
    return F.when(F.col("resident") > 0, F.abs(predicted - F.col("resident")) / F.col("resident"))


def _line(b0: str = "b0", b1: str = "b1", b2: str = "b2") -> Column:
    return F.col(b0) + F.col(b1) * F.col("tensor_count") + F.col(b2) * F.col("output_tensor_bytes")


def fit_baseline(points: DataFrame) -> DataFrame:
    """One row: b0, b_tensor, b_output, n and mode; without points the defaults."""
    fit = fitting.ols2(points, [], "tensor_count", "output_tensor_bytes", "residual")
    told = fit.select(F.col("b0"), F.col("b1").alias("b_tensor"), F.col("b2").alias("b_output"), "n", F.lit("lstsq").alias("mode"))
    names = list(tables.BASELINE)
    one = points.sparkSession.range(1).join(told, F.lit(True), "left")
    coeffs = [F.coalesce(k, F.lit(tables.BASELINE[k])).alias(k) for k in names]
    return one.select(*coeffs, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mode", F.lit("default")).alias("mode"))


def train_errors(points: DataFrame, coeffs: DataFrame) -> DataFrame:
    """Relative errors of all points by the fitted baseline (_global) and by the median residual of their digest (_digest)."""
    offsets = fitting.median_offsets(points, "digest", F.col("residual")).select("digest", "offset")
    c = coeffs.select("b0", F.col("b_tensor").alias("b1"), F.col("b_output").alias("b2"))
    both = points.crossJoin(F.broadcast(c)).join(offsets, "digest", "left")
    return both.select(*points.columns, relative_error(_line()).alias("_global"), relative_error(F.coalesce("offset", _line())).alias("_digest"))


def holdout_errors(points: DataFrame, large: int = LARGE) -> DataFrame:
    """Relative errors of points by a baseline fitted on all other structures; none with fewer than two structures."""
    fits = fitting.group_holdout2(points, "signature", "tensor_count", "output_tensor_bytes", "residual").withColumnRenamed("signature", "_signature")
    many, rest = by_size(points, fits, F.col("signature") == F.col("_signature"), "n", large)
    return many.unionByName(rest).select("digest", "ctx", "signature", relative_error(_line()).alias("error"))


def forward_errors(points: DataFrame) -> DataFrame:
    """Relative errors of a digest's longer contexts by the residual of its shortest one."""
    w = Window.partitionBy("digest").orderBy("ctx", "resident")
    known = points.where("digest IS NOT NULL").withColumns({"_first": F.first("residual").over(w), "_n": F.row_number().over(w)})
    return known.where("_n > 1").select("digest", "ctx", relative_error(F.col("_first")).alias("error"))


def fit_report(points: DataFrame) -> DataFrame:
    """Rows (part, max_error, p95_error, mean_error, n) of a memory fit: train_global, train_digest, forward_context, grouped_holdout. No points, no errors."""
    p = memory_points(points)
    train = train_errors(p, fit_baseline(p))
    part = lambda name, error: F.struct(F.lit(name).alias("part"), F.col(error).alias("error"))
    every = (
        train.select(F.inline(F.array(part("train_global", "_global"), part("train_digest", "_digest"))))
        .unionByName(forward_errors(p).select(F.lit("forward_context").alias("part"), "error"))
        .unionByName(holdout_errors(p).select(F.lit("grouped_holdout").alias("part"), "error"))
    )
    names = points.sparkSession.createDataFrame([(k,) for k in ("train_global", "train_digest", "forward_context", "grouped_holdout")], "part string")
    return names.join(error_stats(every, ["part"], "error", few=True), "part", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def model_errors(points: DataFrame, arch: str, limit: float = 0.05) -> DataFrame:
    """Largest error of each model of one architecture, and whether it keeps the limit. points has model, arch and _global."""
    worst = points.where(F.col("arch") == arch).groupBy("model").agg(F.max("_global").alias("max_error"), F.count("*").alias("n"))
    return worst.withColumn("ok", F.col("max_error") <= limit)


def decode_fits(points: DataFrame, by: str, bandwidths: DataFrame) -> DataFrame:
    """Speed model of each device: 1 / tps = a W + c L + d.

    Free with four points or more; where that gives no positive a, or there
    are fewer, a is that of the measured bandwidth (two points or more); else
    what there is, or insufficient. points: by, W, L, decode_tps; bandwidths:
    by, bw_measured_gbs.
    """
    p = points.select(by, F.col("W").cast("double").alias("W"), F.col("L").cast("double").alias("L"), (1.0 / F.col("decode_tps")).alias("t"))
    free = fitting.ols2(p, [by], "W", "L", "t").select(by, "n", F.col("b1").alias("_a"), F.col("b2").alias("_c"), F.col("b0").alias("_d"), F.col("r2").alias("_r2"))
    bw = bandwidths.select(by, falsy(F.col("bw_measured_gbs").cast("double")).alias("bw"))
    fixed = p.join(bw, by).where("bw IS NOT NULL").withColumn("z", F.col("t") - F.col("W") / (F.col("bw") * 1e9))
    g = fixed.groupBy(by).agg(
        F.avg("L").alias("mL"), F.avg("z").alias("mz"), F.first("bw").alias("bw"), F.var_pop("L").alias("sLL"), F.covar_pop("L", "z").alias("sLz"), F.var_pop("z").alias("szz"), F.var_pop("t").alias("stt")
    )
    flat = F.col("mz") / (1 + F.col("mL") * F.col("mL"))  # a constant L: the least of the lines that fit
    c = F.when(F.col("sLL") > 0, F.try_divide("sLz", "sLL")).otherwise(flat * F.col("mL"))
    d = F.when(F.col("sLL") > 0, F.col("mz") - c * F.col("mL")).otherwise(flat)
    rest = F.col("szz") - 2 * c * F.col("sLz") + c * c * F.col("sLL")
    anchored = g.select(by, "bw", c.alias("_c2"), d.alias("_d2"), (1 - F.try_divide(rest, F.col("stt"))).alias("_r22"))
    x = free.join(anchored, by, "left")
    own = F.col("n") >= 4
    held = (F.col("n") >= 2) & F.col("bw").isNotNull() & ~(own & (F.col("_a") > 0))
    pick = lambda a, b: F.when(held, b).when(own, a)
    return x.select(
        by, "n", F.when(held, "anchored_to_measured_bw").when(own, "free").otherwise("insufficient").alias("mode"),
        pick(F.col("_a"), 1 / (F.col("bw") * 1e9)).alias("a_s_per_byte"), pick(F.col("_c"), F.col("_c2")).alias("c_s_per_layer"), pick(F.col("_d"), F.col("_d2")).alias("d_s"),
        pick(F.col("_r2"), F.col("_r22")).alias("r2"), F.when(held, F.col("bw")).when(own & (F.col("_a") > 0), 1 / F.col("_a") / 1e9).alias("bw_eff_gbs"),
    )


def global_constants(fits: DataFrame) -> DataFrame:
    """One row: medians over the devices' fits, with defaults where there is none. fits: decode_fits' columns, bw_spec_gbs, prefill_derate."""
    d = tables.SPEED_DEFAULTS
    fitted = fits.where("a_s_per_byte IS NOT NULL")
    share = F.when(falsy(F.col("bw_spec_gbs")).isNotNull() & falsy(F.col("bw_eff_gbs")).isNotNull(), F.try_divide("bw_eff_gbs", "bw_spec_gbs"))
    one = fitted.agg(F.median(share).alias("bw_eff_fraction"), F.median("c_s_per_layer").alias("c_s_per_layer"), F.median("d_s").alias("d_s"), (F.count("*") > 0).alias("calibrated"))
    derate = fits.agg(F.median(falsy(F.col("prefill_derate"))).alias("prefill_derate"))
    return one.crossJoin(derate).select(*[F.coalesce(k, F.lit(v)).alias(k) for k, v in d.items()], "calibrated")


def gates(facts: DataFrame) -> DataFrame:
    """Rows (gate, ok) by device from one row of facts each; ok is null where a gate can't be told.

    facts: gpu, unflagged_share, r2, n_decode, max_error, holdout_error,
    moe_ok, swa_ok, factors (map), prefill_derate, n_partial.
    """
    f = F.col
    checks = {
        "unflagged_share": f("unflagged_share") >= 0.9,
        "decode_fit": F.when(f("r2").isNotNull(), (f("r2") > 0.95) & (f("n_decode") >= 8)),
        "memory_error": F.coalesce(f("max_error") <= 0.05, F.lit(False)) & F.coalesce(f("holdout_error") <= 0.05, F.lit(True)),
        "expert_models": f("moe_ok"),
        "windowed_models": f("swa_ok"),
        "format_factors": F.when(F.size("factors") > 0, F.forall(F.map_values("factors"), lambda v: v.between(0.4, 1.3))),
        "prefill_derate": f("prefill_derate").between(0.05, 0.8),
        "partial_points": F.when(f("n_partial") > 0, f("n_partial") >= 3),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(tables.GATE_LABELS[k]).alias("gate"), c.cast("boolean").alias("ok")) for i, (k, c) in enumerate(checks.items())])
    return facts.select("gpu", F.inline(rows))


def gate_lines(rows: DataFrame, detail: str = "detail") -> DataFrame:
    """Markdown lines of a gate report: gpu, place, line. A heading and a table for each device; details are cut to 300 characters."""
    result = F.when(F.col("ok"), "PASS").when(~F.col("ok"), "FAIL").otherwise("N/A (insufficient data)")
    line = F.concat(F.lit("| "), F.col("gate"), F.lit(" | "), result, F.lit(" | "), F.substring(F.coalesce(detail, F.lit("")), 1, 300), F.lit(" |"))
    heads = [(-3, F.concat(F.lit("## "), F.col("gpu"))), (-2, F.lit("| gate | result | detail |")), (-1, F.lit("|---|---|---|"))]
    top = rows.select("gpu").distinct().select("gpu", F.inline(F.array(*[F.struct(F.lit(p).alias("place"), t.alias("line")) for p, t in heads])))
    return top.unionByName(rows.select("gpu", "place", line.alias("line")))


def speed_constants(gpus: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """Each device's speed model: its own fit, else the shared one's medians, else the defaults; factors of formats are merged, its own win.

    gpus: id, bandwidth_gbs; own (unique on gpu_id): gpu_id, name, bw_eff_gbs,
    c_s_per_layer, d_s, quant_factors, prefill_derate; shared: one row or none
    of bw_eff_fraction, c_s_per_layer, d_s, quant_factors, prefill_derate.
    """
    empty = F.create_map().cast("map<string,double>")
    names = ("bw_eff_fraction", "c_s_per_layer", "d_s", "quant_factors", "prefill_derate")
    one = gpus.sparkSession.range(1).join(shared.select(*[F.col(c).alias(f"_s_{c}") for c in names]), F.lit(True), "left").drop("id")
    mine = own.where("c_s_per_layer IS NOT NULL").select(F.col("gpu_id").alias("id"), *[F.col(c).alias(f"_o_{c}") for c in ("name", "bw_eff_gbs", "c_s_per_layer", "d_s", "quant_factors", "prefill_derate")])
    df = gpus.join(mine, "id", "left").crossJoin(F.broadcast(one))
    base = {c: F.coalesce(f"_s_{c}", F.lit(tables.SPEED_DEFAULTS[c])) for c in names if c != "quant_factors"}
    merged = F.map_zip_with(F.coalesce("_s_quant_factors", empty), F.coalesce("_o_quant_factors", empty), lambda k, x, y: F.coalesce(y, x))
    return df.select(
        *gpus.columns,
        F.coalesce("_o_bw_eff_gbs", F.col("bandwidth_gbs") * base["bw_eff_fraction"]).alias("bw_eff_gbs"),
        F.coalesce("_o_c_s_per_layer", base["c_s_per_layer"]).alias("c_s_per_layer"),
        F.coalesce("_o_d_s", base["d_s"]).alias("d_s"),
        merged.alias("quant_factors"),
        F.coalesce(falsy(F.col("_o_prefill_derate")), base["prefill_derate"]).alias("prefill_derate"),
        F.col("_o_c_s_per_layer").isNotNull().alias("calibrated"),
        F.col("_o_name").alias("calibration_source"),
    )


def format_factors(points: DataFrame, by: str, quant: str, ratio: Column) -> DataFrame:
    """Median ratio of measured to modelled speed by device and format."""
    return medians(points.select(by, quant, ratio.alias("_r")), [by, quant], "_r", "factor")


def expert_ratios(points: DataFrame) -> DataFrame:
    """Modelled to measured time of models with experts, by their active and by all bytes, and whether the active ones explain it.

    points: gpu, decode_tps, active_bytes, weight_bytes, n_layer, and the fit's a_s_per_byte, c_s_per_layer, d_s.
    """
    def tps(size: str) -> Column:
        t = F.col("a_s_per_byte") * F.col(size) + F.col("c_s_per_layer") * F.col("n_layer") + F.col("d_s")
        return F.when(t > 0, 1 / t)

    active, total = F.try_divide("decode_tps", tps("active_bytes")), F.try_divide("decode_tps", tps("weight_bytes"))
    return points.withColumns({"ratio_active": active, "ratio_total": total}).withColumn("ok", F.coalesce(F.col("ratio_active").between(0.7, 1.3) & (F.col("ratio_total") >= 5), F.lit(False)))

