"""Publication of the catalog: one row an artifact, its links, qualities, devices and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions.numeric import falsy, lookup
from quarry.functions.text import blank_to_null, normalize_quant, signal_tags, strip_suffix_key
from quarry.operators.joins import ordered_alias_lookup


def with_header(rows: DataFrame) -> DataFrame:
    """Rows whose header was read; unknown counts as not read."""
    return rows.where("header_ok")


def canonical_rank(ref: Column, tag: Column) -> Column:
    """Order of an artifact's names: a default tag, then one without a format token, then the shortest, then by name."""
    plain = F.coalesce(tag, F.lit(""))
    return F.struct(
        (~plain.isin(*tables.GENERIC)).alias("named"), plain.rlike(tables.QUANT_SUFFIX).alias("suffix"), F.length(ref).alias("length"), F.lower(ref).alias("lower"), ref.alias("ref")
    )


def canonical_rows(rows: DataFrame, digest: str, rank: Column, newest: str) -> DataFrame:
    """One row a digest: the first by rank, the latest of the times, and how many names it has. Partial minima are taken before the shuffle."""
    rest = [c for c in rows.columns if c not in (digest, newest)]
    g = rows.groupBy(digest).agg(F.min_by(F.struct(*rest), rank).alias("row"), F.max(newest).alias(newest), F.count("*").alias("n_names"))
    return g.select(digest, "row.*", newest, "n_names")


def alias_rows(rows: DataFrame, digest: str, name: str, rank: Column) -> DataFrame:
    """A row for each name that isn't its digest's canonical one: digest, name. Lists would grow with a digest's names; rows don't."""
    first = rows.groupBy(digest).agg(F.min_by(name, rank).alias("_first"))
    return rows.select(digest, name).distinct().join(first, digest).where(F.col(name) != F.col("_first")).select(digest, name)


def signals(rows: DataFrame) -> Column:
    """vision, code, embedding and reasoning, in this order, from names, projector and architecture."""
    text = F.lower(F.concat_ws(" ", F.coalesce("model", F.lit("")), F.coalesce("ref", F.lit(""))))
    hinted = signal_tags(text)
    seen = (F.coalesce("projector_bytes", F.lit(0)) != 0) | F.contains(text, F.lit("vision")) | F.contains(text, F.lit("-vl")) | F.contains(text, F.lit("llava")) | F.contains(text, F.lit("moondream"))
    embeds = F.coalesce(F.col("arch") == "bert", F.lit(False)) | F.array_contains(hinted, "embedding")
    return F.array_compact(
        F.array(
            F.when(seen, "vision"), F.when(F.array_contains(hinted, "code"), "code"), F.when(embeds, "embedding"), F.when(F.array_contains(hinted, "reasoning"), "reasoning")
        )
    )


def _hit(df: DataFrame, table: DataFrame, key: str, confidence: str, out: str) -> DataFrame:
    """Left lookup of (key, repo, url, method): a struct with its confidence; a byte match has no method."""
    method = F.lit(None).cast("string") if confidence == "verified" else F.coalesce("method", F.lit("readme"))
    side = table.select(F.col(key).alias(f"_{out}"), F.struct("repo", "url", F.lit(confidence).alias("confidence"), method.alias("method")).alias(out))
    return df.join(side, F.col(key) == F.col(f"_{out}"), "left").drop(f"_{out}")


def link_slots(df: DataFrame, by_digest: DataFrame, by_release: DataFrame, by_family: DataFrame, fallback: DataFrame) -> DataFrame:
    """hf.release: digest, else release, else the fallback's release; hf.family: digest, else family.

    df has digest, release and family; the lookups are unique on their key and
    have repo, url and method.
    """
    df = _hit(df, by_digest, "digest", "verified", "_d")
    df = _hit(df, by_release, "release", "likely", "_r")
    df = _hit(df, fallback, "release", "likely", "_b")
    df = _hit(df, by_family, "family", "likely", "_f")
    hf = F.struct(F.coalesce("_d", "_r", "_b").alias("release"), F.coalesce("_d", "_f").alias("family"))
    return df.withColumn("hf", hf).drop("_d", "_r", "_b", "_f")


def resolved_link(upstream: Column, hf: Column) -> Column:
    """The link to show: the identity's upstream, else the release's, else the family's, which is marked."""
    slot = F.coalesce(hf["release"], hf["family"])
    plain = F.struct(slot["repo"].alias("repo"), slot["url"].alias("url"), slot["confidence"].alias("confidence"), slot["method"].alias("method"), hf["release"].isNull().alias("family_only"))
    own = F.struct(upstream["repo"].alias("repo"), upstream["url"].alias("url"), upstream["confidence"].alias("confidence"), F.lit(None).cast("string").alias("method"), F.lit(False).alias("family_only"))
    return F.when(F.coalesce(upstream["url"], F.lit("")) != "", own).when(slot.isNotNull(), plain)


def link_hint(kind: Column, link: Column) -> Column:
    """How sure a link is, in words; empty without a link."""
    plain = F.coalesce(lookup(link["method"], tables.PAGE_HINTS), F.lit(tables.PAGE_HINT_DEFAULT))
    base = F.coalesce(lookup(link["confidence"], tables.CONFIDENCE_HINTS), lookup(link["method"], tables.METHOD_HINTS), F.lit(tables.METHOD_HINT_DEFAULT))
    wide = F.when(link["family_only"], F.concat(base, F.lit(tables.FAMILY_HINT))).otherwise(base)
    return F.when(link.isNull(), "").when(kind != "hf", plain).otherwise(wide)


#: Fields that count 0 as their default, and where a missing one comes from.
ZEROED = ("ple_bytes", "projector_bytes", "expert_count", "expert_used_count", "sliding_window", "shared_kv_layers", "n_swa_layers", "n_global_layers")
TAKEN = (
    "model", "tag", "digest", "arch", "param_count", "active_params", "weight_bytes", "active_weight_bytes", "n_layer", "context_length",
    "kv_local_bytes_per_token_f16", "kv_global_bytes_per_token_f16", "vram_bytes_at_ctx", "pushed_at",
)


def compact_rows(rows: DataFrame) -> DataFrame:
    """The published fields of canonical rows: missing counts are 0, missing or zero device bytes are all bytes, texts are trimmed."""
    release = strip_suffix_key(F.coalesce("model", F.lit("")), F.coalesce("tag", F.lit("")))
    names = {"param_count": "params", "n_layer": "layers", "expert_count": "experts", "expert_used_count": "expert_used"}
    return rows.select(
        "ref",
        *[F.col(c).alias(names.get(c, c)) for c in TAKEN],
        normalize_quant(F.col("quant"), F.col("tag")).alias("quant"),
        F.coalesce(falsy(F.col("gpu_weight_bytes")), F.col("weight_bytes")).alias("gpu_weight_bytes"),
        *[F.coalesce(c, F.lit(0)).alias(names.get(c, c)) for c in ZEROED],
        F.coalesce("vram_digest_calibrated", F.lit(False)).alias("vram_digest_calibrated"),
        F.trim(F.coalesce("description", F.lit(""))).alias("description"),
        signals(rows).alias("signals"),
        release.alias("release"),
    )


def fill_blank(df: DataFrame, table: DataFrame, key: str, column: str) -> DataFrame:
    """column from a table unique on key where df has none or only white space."""
    side = table.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    out = df.join(side, F.col(key) == F.col("_k"), "left")
    return out.withColumn(column, F.coalesce(blank_to_null(F.col(column)), blank_to_null(F.col("_v")), F.lit(""))).drop("_k", "_v")


def compact_gpus(gpus: DataFrame) -> DataFrame:
    """Devices with their speed model as one struct; notes are never null. gpus has the columns of constants_for."""
    estimate = F.struct(*[c for c in ("bw_eff_gbs", "c_s_per_layer", "d_s", "quant_factors", "prefill_derate", "calibrated", "calibration_source")])
    plain = ("id", "name", "vendor", "type", "generation", "memory_gb", "usable_fraction", "bandwidth_gbs", "fp16_tflops")
    return gpus.select(*plain, F.coalesce("notes", F.lit("")).alias("notes"), estimate.alias("estimate"))


def compact_library(library: DataFrame, rows: DataFrame, key: str = "model") -> DataFrame:
    """Descriptions and readmes, trimmed, of families in the catalog that have either."""
    texts = [F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("description", "readme")]
    return library.join(rows.select(key), key, "left_semi").select(key, *texts).where("description <> '' OR readme <> ''")


def compact_link_content(content: DataFrame, rows: DataFrame, key: str = "model", items: str = "content") -> DataFrame:
    """Saved pages (a map by kind) of families in the catalog: repositories, code and home pages; papers and empty ones go."""
    kept = F.map_filter(items, lambda k, v: k.isin("hf", "github", "homepage") & v.isNotNull() & (v != ""))
    return content.join(rows.select(key), key, "left_semi").select(key, kept.alias(items)).where(F.size(items) > 0)


def compact_quality(rows: DataFrame, scores: DataFrame, sources: DataFrame) -> DataFrame:
    """Scores of canonical rows, found by their name, else by their aliases in order; rows without one go.

    rows: ref, model, aliases; scores: ref, eval_id, q_base, q_file, quant_factor;
    sources: eval_id, source (rows without either don't count). An unknown
    source is called measured.
    """
    named = rows.select("ref", F.concat(F.array("ref"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"))
    hits = ordered_alias_lookup(named, "ref", "names", scores.withColumnRenamed("ref", "scored"), "scored")
    known = sources.where("eval_id <> '' AND source <> ''").select(F.col("eval_id").alias("_e"), F.col("source").alias("quality_source"))
    out = hits.join(known, F.col("eval_id") == F.col("_e"), "left").drop("_e", "pos", "scored")
    return out.withColumn("quality_source", F.coalesce("quality_source", F.lit("measured"))).join(rows.select("ref", "model"), "ref")


def quality_counts(quality: DataFrame) -> DataFrame:
    """How many names and families have a score."""
    return quality.agg(F.count("*").alias("quality_refs"), F.count_distinct("model").alias("quality_families"))


def memory_model(constants: DataFrame) -> DataFrame:
    """The one row (constants_version, formula, b0, b_tensor, b_output) of a memory model, checked.

    The current version passes; an old one without a formula fails, as it has
    another model; coefficients that are missing are the defaults.
    """
    old = F.col("formula").isNull() & (F.col("constants_version").isNull() | (F.col("constants_version") == 1))
    told = F.concat(F.lit(f"constants must be version {tables.CONSTANTS_VERSION} with formula {tables.FORMULA}; got version "), F.coalesce(F.col("constants_version").cast("string"), F.lit("none")))
    bare = F.col("b0").isNull() & F.col("b_tensor").isNull() & F.col("b_output").isNull()
    coeffs = [F.when(bare, F.lit(v)).otherwise(F.coalesce(k, F.lit(0.0))).alias(k) for k, v in tables.BASELINE.items()]
    return constants.select(F.when(old, F.raise_error(told)).otherwise(F.col("constants_version")).alias("constants_version"), "formula", *coeffs)


def check_version(document: DataFrame, wanted: int = tables.SCHEMA_VERSION) -> DataFrame:
    """The rows of a published document; the job fails on another schema version, or none."""
    told = F.concat(F.lit(f"schema_version must be {wanted}, not "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none")))
    return document.withColumn("schema_version", F.when(F.col("schema_version").eqNullSafe(wanted), F.col("schema_version")).otherwise(F.raise_error(told)))


def family_copy(library: Column, description: Column) -> Column:
    """A family's texts where there are any, else the row's own description."""
    own = F.struct(F.coalesce(description, F.lit("")).alias("description"), F.lit("").alias("readme"))
    return F.coalesce(library, own)


def export_identity(rows: DataFrame, artifacts: DataFrame, support: DataFrame, provisional: bool = False) -> DataFrame:
    """Catalog rows (unique on digest) with the upstream that the identity report can stand for.

    artifacts: digest, status, repo, n_matches; support: digest, family,
    decision_key, repo, method. A likely artifact has an upstream if a decision
    on the same repository was verified, or, with provisional, any; it is
    called semantic_verified only if all that count are.
    """
    repeated = rows.groupBy("digest").agg(F.count("*").alias("c"))
    told = F.concat(F.lit("Duplicate digest: "), F.coalesce("digest", F.lit("")))
    once = repeated.select("digest", F.when(F.col("c") > 1, F.raise_error(told)).otherwise(F.lit(True)).alias("_once"))
    verified = F.coalesce(F.col("method") == "semantic_verified", F.lit(False))
    likely = artifacts.where("status = 'likely' AND repo <> ''").select("digest", "repo")
    votes = support.join(likely, ["digest", "repo"]).where(verified | F.lit(provisional))
    upstream = votes.groupBy("digest", "repo").agg(F.bool_and(verified).alias("all"), F.count("*").alias("n_support"))
    confidence = F.when(F.col("all"), "semantic_verified").otherwise("provisional")
    upstream = upstream.select("digest", F.struct("repo", F.concat(F.lit(tables.REPO_SITE), "repo").alias("url"), confidence.alias("confidence"), "n_support").alias("upstream"))
    facts = artifacts.select("digest", "status", F.coalesce("n_matches", F.lit(0)).alias("exact_file_uploads"))
    return rows.join(once, "digest").where("_once").drop("_once").join(facts, "digest", "left").join(upstream, "digest", "left")


def open_fields(df: DataFrame, key: str, record: str) -> DataFrame:
    """The fields of JSON objects of any shape, as rows: key, name, kind and value (text; null for a null and for what isn't scalar).

    kind is the field's type by variant (BIGINT, DECIMAL(2,1), OBJECT<...>,
    ARRAY<...>, VOID and so on). Records that are null, not JSON or no objects
    have no rows; a null key stays; repeated records give repeated rows.
    """
    v = F.try_parse_json(F.col(record))
    objects = df.select(F.col(key).alias("_key"), v.alias("_v")).where(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")))
    fields = objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    kind = F.schema_of_variant("value")
    nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    return fields.select(F.col("_key").alias(key), F.col("key").alias("name"), kind.alias("kind"), F.when(~nested, F.try_variant_get("value", "$", "string")).alias("value"))


def scalar_fields(df: DataFrame, key: str, record: str) -> DataFrame:
    """open_fields without what isn't scalar: texts, numbers, truth values and nulls stay."""
    kind = F.col("kind")
    return open_fields(df, key, record).where(~(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))))


class GateFailed(ValueError):
    """A table broke a gate, so it wasn't published."""


def publish_gated(df: DataFrame, path: str, gates: dict[str, Column]) -> dict[str, bool]:
    """Write df as Parquet to path if all gates hold; what they say is returned.

    A gate is an aggregate that is true or false. All are observed while the
    rows are written, to a folder beside path, so rows are read once; the
    folder takes path's place only if no gate is false or null. Else it is
    deleted, GateFailed names the gates, and what lay at path before stays.
    """
    spark = df.sparkSession
    seen = Observation()
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in gates.items()]).write.parquet(staged)
    found = {k: bool(seen.get[k]) for k in gates}
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    broken = sorted(k for k, ok in found.items() if not ok)
    if broken:
        files.delete(place(staged), True)
        raise GateFailed(f"not published to {path}: {', '.join(broken)}")
    files.delete(place(path), True)
    if not files.rename(place(staged), place(path)):
        raise OSError(f"{staged} can't be renamed to {path}")
    return found
