"""Memory and speed formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions.numeric import clip, falsy, lookup, round_even


def effective_ctx(ctx: Column, window: Column) -> Column:
    """The window where there is a shorter one, else the context."""
    w = F.coalesce(window, F.lit(0))
    return F.when((w > 0) & (w < ctx), w).otherwise(ctx)


def kv_slopes(kv: Column, window: Column, local: Column, glob: Column) -> tuple[Column, Column]:
    """Bytes a token in windowed and in full layers; rows with one slope put it by whether they have a window."""
    split = local.isNotNull() | glob.isNotNull()
    zero = F.lit(0.0)
    single = F.coalesce(kv, zero)
    windowed = F.coalesce(window, F.lit(0)) > 0
    return (
        F.when(split, F.coalesce(local, zero)).when(windowed, single).otherwise(zero),
        F.when(split, F.coalesce(glob, zero)).when(windowed, zero).otherwise(single),
    )


def kv_bytes(ctx: Column, window: Column, local: Column, glob: Column, factor: float = 1.0) -> Column:
    return (local * effective_ctx(ctx, window) + glob * ctx) * factor


def graph_bytes(ctx: Column, heads: Column, layers: Column, windowed: Column, full: Column, window: Column) -> Column:
    """Scratch memory; a mixture of windowed and full layers blends their contexts."""
    blend = (windowed * effective_ctx(ctx, window) + full * ctx) / falsy(layers)
    mixed = (layers > 0) & (windowed > 0) & (full > 0)
    return tables.GRAPH_BYTES_PER_HEAD_TOKEN * (heads + 1) * F.when(mixed, blend).otherwise(ctx.cast("double"))


def baseline_bytes(tensors: Column, output_bytes: Column, offset: Column, coeffs: dict = tables.BASELINE) -> Column:
    """A measured offset replaces the fitted line."""
    line = coeffs["b0"] + coeffs["b_tensor"] * F.coalesce(tensors, F.lit(0)) + coeffs["b_output"] * F.coalesce(output_bytes, F.lit(0.0))
    return F.coalesce(offset, line)


def predict_vram(weights: Column, projector: Column, kv: Column, graph: Column, baseline: Column) -> Column:
    """Sum of the parts, rounded half to even; null where a part is unknown, but for a projector, which counts as none."""
    return round_even(weights + F.coalesce(projector, F.lit(0.0)) + kv + graph + baseline)


def decode_tps(weight_bytes: Column, layers: Column, bw_gbs: Column, per_layer: Column, fixed: Column, factor: Column) -> Column:
    """Tokens a second from bytes read, layers and a fixed cost; null without a positive time."""
    t = weight_bytes / (bw_gbs * 1e9) + layers * per_layer + fixed
    return F.when(t > 0, factor / t)


def prefill_tps(tflops: Column, derate: Column, active_params: Column) -> Column:
    """Prompt tokens a second: two operations a parameter; null without arithmetic figures or parameters."""
    return F.try_divide(falsy(tflops) * derate * 1e12, 2 * falsy(active_params))


def ceiling_tps(bw_gbs: Column, weight_bytes: Column) -> Column:
    return F.try_divide(bw_gbs * 1e9, weight_bytes)


def fit_by_capacity(vram: Column, usable: Column, offloadable: Column, ram_bytes: Column) -> Column:
    """full, partial (weights fit in device and host memory together) or none."""
    return F.when(vram <= usable, "full").when(offloadable <= usable + ram_bytes, "partial").otherwise("none")


def fit_for(ctx_max: Column, ctx: Column, vram: Column, usable: Column, offloadable: Column, ram_bytes: Column) -> Column:
    """As fit_by_capacity, but context where the artifact doesn't reach the wanted length or has no figure for it."""
    return F.when(ctx_max.isNull() | (ctx_max < ctx) | vram.isNull(), "context").otherwise(fit_by_capacity(vram, usable, offloadable, ram_bytes))


def age_decay(years: Column) -> Column:
    return F.exp(F.lit(-0.6931471805599453) * years / tables.HALF_LIFE_YEARS)


def context_score(ctx: Column) -> Column:
    """0 at 2k, 1 at 128k, by doublings; 0 for none."""
    return F.when(falsy(ctx).isNull(), F.lit(0.0)).otherwise(clip(F.log2(F.greatest(ctx, F.lit(2048)) / 2048.0) / 6))


def size_prior(active: Column, params: Column, quant: Column) -> Column:
    """Capability to expect of a size and a format; an unknown size counts as the least."""
    size = F.greatest(F.lit(1e8), F.coalesce(falsy(active), params).cast("double"))
    return clip((F.log10(size) - 8) / 3) * 0.72 + lookup(quant, tables.QUANT_QUALITY, tables.QUANT_QUALITY_DEFAULT) * 0.28


def speed_factor(quant: Column, factors: Column) -> Column:
    """A device's factor of exactly this format; 1 where it has none."""
    return F.coalesce(F.try_element_at(factors, quant), F.lit(1.0))


def quant_factor(quant: Column, table: dict[str, float] = tables.QUANT_FACTORS, default: float | None = None) -> Column:
    """Exact key, else the longest key whose part before the underscore begins the name, else the default."""
    name = F.upper(F.coalesce(F.nullif(quant, F.lit("")), F.lit("UNKNOWN")))
    out = F.lit(table.get("Q4_K_M", tables.QUANT_FACTOR_DEFAULT) if default is None else default)
    for key in sorted(table, key=len):
        out = F.when(F.startswith(name, F.lit(key.split("_")[0])), F.lit(table[key])).otherwise(out)
    return F.coalesce(lookup(name, table), out)
