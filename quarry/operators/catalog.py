"""The catalog index and the filter, score and rank query over it."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import capacity, text
from quarry.functions.numeric import at_least, clip, falsy
from quarry.functions.text import size_class


def with_contexts(catalog: DataFrame, points=tables.CTX_POINTS) -> DataFrame:
    """A row for each context point up to the trained length; the least point where there is none."""
    all_points = F.array(*map(F.lit, points))
    fits = F.filter(all_points, lambda c: c <= F.col("ctx_max"))
    return catalog.withColumn("ctx", F.explode(F.when(F.size(fits) == 0, F.array(F.lit(points[0]))).otherwise(fits)))


def index(catalog: DataFrame, gpus: DataFrame, broadcast_gpus: int = 100_000) -> DataFrame:
    """Artifacts by context by device: memory, fit, speed.

    Memory depends on artifact and context alone, so it is computed before the
    devices come in. The device table is a list, broadcast up to so many rows;
    a longer one is paired by shuffled parts.
    catalog: ref, weight_bytes, layers, ctx_max, kv_per_token, quant; gpus: gpu_id, memory, usable, bandwidth, per_layer, fixed, and fp16_tflops, derate for the prompt speed, if there.
    """
    sized = with_contexts(catalog).withColumn("vram", F.col("weight_bytes") + F.col("kv_per_token") * F.col("ctx"))
    pairs = sized.crossJoin(F.broadcast(gpus) if gpus.limit(broadcast_gpus + 1).count() <= broadcast_gpus else gpus)
    factors = F.col("factors") if "factors" in gpus.columns else F.create_map().cast("map<string,double>")
    prompt = [capacity.prefill_tps(F.col("fp16_tflops"), F.col("derate"), F.col("params")).alias("prefill")] if "fp16_tflops" in gpus.columns else []
    usable = F.col("memory") * F.col("usable")
    return pairs.select(
        "ref", "gpu_id", "ctx", "vram",
        capacity.fit_by_capacity(F.col("vram"), usable, F.col("weight_bytes"), F.lit(tables.RAM_GB * 1e9)).alias("fit"),
        capacity.decode_tps(F.col("weight_bytes"), F.col("layers"), F.col("bandwidth"), F.col("per_layer"), F.col("fixed"), capacity.speed_factor(F.col("quant"), factors)).alias("tps"),
        capacity.ceiling_tps(F.col("bandwidth"), F.col("weight_bytes")).alias("ceiling"), *prompt,
    )


def pivot_contexts(df: DataFrame, key: str, ctx: str, value: str, points=tables.CTX_POINTS) -> DataFrame:
    """One column for each context point; the points are given, so no scan looks for them."""
    wide = df.groupBy(key).pivot(ctx, list(points)).agg(F.first(value))
    return wide.select(key, *[F.col(str(p)).alias(f"ctx_{p}") for p in points])


def coalesce_constants(gpus: DataFrame, own: DataFrame, shared: DataFrame, names: list[str], defaults: dict) -> DataFrame:
    """A device's own calibration, else the shared one, else the default, by constant."""
    mine = own.select("gpu_id", *[F.col(n).alias(f"_o_{n}") for n in names])
    one = shared.select(*[F.col(n).alias(f"_s_{n}") for n in names])
    df = gpus.join(mine, "gpu_id", "left").crossJoin(F.broadcast(one))
    return df.select("gpu_id", *[F.coalesce(f"_o_{n}", f"_s_{n}", F.lit(defaults[n])).alias(n) for n in names])


SORTS = ("recommended", "newest", "name", "speed", "vram", "context", "capability")


@dataclass(frozen=True)
class FindQuery:
    """A query state; values outside the lists fall back to the defaults."""

    mode: str = "find"
    gpu: str = "0"
    ctx: int = 8192
    ram_gb: int = 32
    usecase: str = "chat"
    priority: str = "balanced"
    allow_partial: bool = False
    text: str = ""
    fit: str = "runnable"
    arch: str = "all"
    quant: str = "all"
    sort: str = "recommended"
    sizes: tuple[str, ...] = ()
    limit: int = 18
    offset: int = 0
    as_of: str = "2026-01-01"

    @classmethod
    def from_params(cls, params: dict) -> "FindQuery":
        """From address parameters: unknown names are ignored, unknown values become the defaults."""
        allowed = {
            "mode": ("find", "explore"), "usecase": tuple(tables.TASK_SUITES), "priority": tuple(tables.PRIORITY_WEIGHTS),
            "fit": ("runnable", "full", "partial", "all"), "sort": SORTS,
        }
        classes = {name for name, _ in tables.SIZE_CLASSES} | {"frontier", "unknown"}
        kept = {}
        for f in fields(cls):
            if f.name not in params:
                continue
            value = params[f.name]
            if f.name in allowed and value not in allowed[f.name]:
                continue
            if f.name in ("ctx", "ram_gb", "limit", "offset"):
                if not str(value).isdigit() or int(value) < (f.name != "offset"):
                    continue
                value = int(value)
                if (f.name == "ctx" and value not in tables.CTX_POINTS) or (f.name == "ram_gb" and value not in tables.RAM_CHOICES):
                    continue
            if f.name == "allow_partial":
                value = value in (True, "1", "true")
            if f.name == "sizes":
                value = tuple(v for v in (value.split(",") if isinstance(value, str) else value) if v in classes)
            kept[f.name] = value
        return cls(**kept)

    def to_params(self) -> dict:
        """Address parameters of this state: always the plain ones, partial and sizes only where they aren't the defaults."""
        names = ("mode", "gpu", "ram_gb", "ctx", "usecase", "priority", "fit", "arch", "quant", "sort")
        out = {k: str(getattr(self, k)) for k in names}
        if self.allow_partial:
            out["allow_partial"] = "1"
        if self.sizes:
            out["sizes"] = ",".join(self.sizes)
        return out


def search(text: str, *columns: str) -> Column:
    """A literal substring, whatever the case, of the columns joined by spaces."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.strip().lower()))


def usecase_candidate(usecase: str, signals: Column) -> Column:
    """Vision and embedding need their signal; other uses leave embedding artifacts out."""
    if usecase == "embedding":
        return F.array_contains(signals, "embedding")
    chat = ~F.array_contains(signals, "embedding")
    return chat & F.array_contains(signals, "vision") if usecase == "vision" else chat


def view(catalog: DataFrame, gpu: Column, q: FindQuery) -> DataFrame:
    """All computed columns of a query state. gpu is a struct of memory, usable, bandwidth, per_layer, fixed and, if it has some, factors by format.

    Scores that weren't measured are null and give way to a prior by size,
    format and age; a missing date gives no recency and no decay.
    """
    has = lambda c: c in catalog.columns
    df = catalog.withColumn("_g", gpu)
    factors = F.create_map().cast("map<string,double>") if "factors" not in df.select("_g.*").columns else F.col("_g.factors")
    usable = F.col("_g.memory") * F.col("_g.usable")
    vram = F.when(F.col("ctx_max") >= q.ctx, F.col("weight_bytes") + F.col("kv_per_token") * q.ctx)
    modelled = falsy(F.col("weight_bytes")).isNotNull() & falsy(F.col("layers")).isNotNull()
    raw = F.when(modelled, capacity.decode_tps(F.col("weight_bytes"), F.col("layers"), F.col("_g.bandwidth"), F.col("_g.per_layer"), F.col("_g.fixed"), capacity.speed_factor(F.col("quant"), factors)))
    days = at_least(0, F.datediff(F.lit(q.as_of).cast("date"), F.col("pushed_at")))
    active = F.col("active_params") if has("active_params") else F.lit(None).cast("double")
    proxy = capacity.size_prior(active, F.col("params"), F.col("quant")) * F.coalesce(capacity.age_decay(days / 365.25), F.lit(1.0))
    df = df.select("*", vram.alias("vram"), usable.alias("usable_bytes"), raw.alias("raw_speed"), (proxy * 0.45).alias("prior"), F.coalesce(F.exp(-days / 365.0), F.lit(0.0)).alias("recency"))
    offloadable = F.col("weight_bytes") + (F.coalesce("projector_bytes", F.lit(0)) if has("projector_bytes") else F.lit(0))
    df = df.select(
        "*",
        capacity.fit_for(F.col("ctx_max"), F.lit(q.ctx), F.col("vram"), F.col("usable_bytes"), offloadable, F.lit(q.ram_gb * 1e9)).alias("fit"),
        F.coalesce(clip(F.col("q_file") / 100.0), F.col("prior")).alias("capability"),
        F.when(F.col("q_file").isNotNull(), "bench").otherwise("size_prior").alias("quality_source"),
        F.when(F.col("q_file").isNotNull() & F.col("q_task").isNotNull(), "bench").otherwise("size_prior").alias("task_source"),
        F.coalesce(clip(F.log10(F.col("raw_speed") + 1) / 2.4), F.lit(0.0)).alias("speed_score"),
        F.try_divide(F.col("usable_bytes") - F.col("vram"), F.col("usable_bytes")).alias("headroom"),
    )
    match = F.when(F.col("task_source") == "bench", clip(F.col("q_task") / 100.0)).otherwise(F.col("prior"))
    df = df.withColumns({"match": match, "speed": F.when(F.col("fit") == "full", F.col("raw_speed"))})
    fit_score = F.when(F.col("fit") == "full", 1.0).when((F.col("fit") == "partial") & F.lit(q.allow_partial), 0.3).otherwise(0.0)
    cap, speed, match, fit = tables.PRIORITY_WEIGHTS[q.priority]
    score = F.col("capability") * cap + F.col("speed_score") * speed + F.col("match") * match + fit_score * fit + F.col("recency") * 12
    score = score + F.when(F.col("quant") == "Q4_K_M", 3.0).otherwise(0.0)
    score = score - F.when(F.col("fit") == "partial", 16.0).when(F.col("fit").isin("none", "context"), 100.0).otherwise(0.0)
    return df.withColumn("score", score).drop("_g")


def ordering(sort: str) -> list[Column]:
    """A total order: the mode's own key, then the catalog's order."""
    tail = [F.lower("ref").asc(), F.col("ref").asc()]
    own = {
        "newest": [F.coalesce(F.col("pushed_at").cast("string"), F.lit("")).desc()],
        "name": [],
        "speed": [F.coalesce(falsy(F.col("raw_speed")), F.lit(-1.0)).desc()],
        "vram": [F.col("vram").asc_nulls_last()],
        "context": [F.coalesce("ctx_max", F.lit(0)).desc()],
        "capability": [F.col("capability").desc()],
        "recommended": [F.col("score").desc(), F.coalesce(F.col("pushed_at").cast("string"), F.lit("")).desc()],
    }[sort]
    return own + tail


def find_models(catalog: DataFrame, gpu: Column, q: FindQuery) -> DataFrame:
    """Search, size filter, score, use case, fit and equality filters, one row a family in find mode, one page with its place in the order.

    Without chosen size classes all known ones count. rank starts at 1 and
    goes on over the pages that offset skips.
    """
    df = catalog
    if q.text.strip():
        df = df.where(search(q.text, *[c for c in SEARCHED if c in catalog.columns]))
    size = size_class(F.col("params"))
    df = df.where(size.isin(*q.sizes) if q.sizes else size != "unknown")
    if q.arch != "all":
        df = df.where(F.col("arch") == q.arch)
    if q.quant != "all":
        df = df.where(F.col("quant") == q.quant)
    if q.mode == "find":
        df = df.where(usecase_candidate(q.usecase, F.col("signals")))
    df = view(df, gpu, q)
    runnable = F.col("fit").isin("full", "partial") if q.allow_partial else F.col("fit") == "full"
    if q.fit != "all":
        df = df.where(runnable if q.fit == "runnable" else F.col("fit") == q.fit)
    order = ordering(q.sort)
    if q.mode == "find":
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy("family").orderBy(*order))).where("_n = 1").drop("_n")
    page = df.orderBy(*order).limit(q.offset + q.limit)
    # The rows of the pages so far are few; only they are numbered.
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") > q.offset) if q.offset else ranked


SEARCHED = ("ref", "family", "arch", "quant", "description", "family_description", "aliases", "signals", "label")


def first_page(rows: DataFrame, sort: str, limit: int = 40) -> DataFrame:
    """The first rows of an order with their place; only these are numbered."""
    page = rows.orderBy(*ordering(sort)).limit(limit)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*ordering(sort))).cast("long")).withColumn("sort", F.lit(sort))


def present_sizes(catalog: DataFrame) -> DataFrame:
    """Size classes that the catalog has, in their order, and whether they are chosen at first: all but the unknown."""
    names = [n for n, _ in tables.SIZE_CLASSES] + ["frontier", "unknown"]
    place = F.array_position(F.array(*map(F.lit, names)), F.col("size_class"))
    return catalog.select(size_class(F.col("params")).alias("size_class")).distinct().select("size_class", place.alias("place"), (F.col("size_class") != "unknown").alias("chosen"))


def rationale(q: FindQuery) -> Column:
    """Why a row of view stands where it does: at most two reasons, else what speaks against it."""
    spare = F.greatest(F.lit(0.0), (F.col("usable_bytes") - F.col("vram")).cast("double"))
    ctx = text.format_ctx(F.lit(q.ctx))
    whole = lambda x: F.format_string("%.0f", x)
    task = F.col("task_source") == "bench"
    told = {
        "code": ("code task score ", " from coding benches"), "vision": ("vision task score ", " (MMMU-weighted)"), "embedding": ("embedding task score ", " (MTEB)"),
        "long": ("long-doc task score ", " from general/reasoning benches"), "chat": ("chat task score ", " from stored benches"),
    }[q.usecase]
    measured = F.col("q_file").isNotNull()
    parts = [
        F.when(F.col("fit") == "full", F.concat(text.format_bytes(spare), F.lit(" GPU memory left at "), ctx, F.lit(" context"))).when(F.col("fit") == "partial", "fits only by moving weights into system RAM"),
        F.when(task & (F.lit(q.usecase != "chat") | ~measured), F.concat(F.lit(told[0]), whole(F.col("q_task")), F.lit(told[1]))),
    ]
    if q.priority == "speed":
        parts.append(F.when(F.col("raw_speed") > 0, F.concat(F.lit("about "), text.format_speed(F.col("raw_speed")), F.lit(" when fully resident"))))
    if q.priority == "quality":
        years = at_least(0, F.datediff(F.lit(q.as_of).cast("date"), F.col("pushed_at"))) / 365.25
        size = text.format_params(F.col("active_params"))
        aged = F.concat(size, F.lit(" size prior with "), F.format_string("%.1f", years), F.lit("y exponential age decay (t½=1.1y)"))
        bench = F.concat(F.lit("intelligence score "), whole(F.col("q_file")), F.lit(" from stored benches ("), F.coalesce("eval_id", F.lit("matched")), F.lit(")"))
        parts.append(F.when(measured, bench).when(years.isNotNull(), aged).otherwise(F.concat(size, F.lit(" active parameters as a size prior"))))
    parts.append(F.when(F.col("quant") == "Q4_K_M", "uses a common balanced quant"))
    reasons = F.slice(F.array_compact(F.array(*parts)), 1, 2)
    none = (
        F.when(F.col("fit") == "context", F.concat(F.lit("trained context is below the requested "), ctx, F.lit("."))).when(F.col("fit") == "none", "model weights exceed the selected GPU and system-memory budget.")
        .otherwise("shown for technical comparison; no recommendation claim is attached.")
    )
    return F.when(F.size(reasons) > 0, F.concat(F.array_join(reasons, "; "), F.lit("."))).otherwise(none)


def largest_first(rows: DataFrame, size: str, key: str, limit: int | None = None) -> DataFrame:
    """Rows by falling size, then by key; the first ones where there is a limit."""
    out = rows.orderBy(F.col(size).desc_nulls_last(), key)
    return out if limit is None else out.limit(limit)
