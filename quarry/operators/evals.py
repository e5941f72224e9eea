"""Benchmark rows: ids, sizes and variants of what was measured, seeds, matching to the catalog, scores and the ingest summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions.capacity import context_score, quant_factor
from quarry.functions.numeric import falsy, round_half_up
from quarry.functions.text import plain_number, slugify
from quarry.operators.joins import neighbours
from quarry.operators.markdown import benchmark_tables
from quarry.operators.quality import bench_population, column_variant, min_max, resolved, suite_scores

SIZE_B = r"(?i)(\d+(?:\.\d+)?)\s*b\b"


def size_in(text: Column) -> Column:
    """Billions that a heading or tag names, as 7b or 1.5 B; null where it names none."""
    return F.nullif(F.regexp_extract(text, SIZE_B, 1), F.lit("")).cast("double")


def tag_size(tag: Column, params: Column) -> Column:
    """Billions by the tag, else by the parameters, to two digits; null where neither tells."""
    return F.coalesce(size_in(tag), round_half_up(falsy(params) / 1e9, 2))


def tag_variant(tag: Column, model: Column) -> Column:
    t = F.lower(tag)

    def has(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.contains(t, F.lit(p))
        return out

    return (
        F.when(has("distill") | F.contains(F.lower(model), F.lit("r1")), "distill").when(has("it", "instruct", "chat"), "instruct")
        .when(has("embed"), "embedding").when(has("vl", "vision"), "vision").when(has("base"), "base").otherwise("unknown")
    )


def eval_id(family: Column, size: Column, variant: Column, heading: Column) -> Column:
    """family:size-variant; a heading's slug (24 characters) stands for an unknown size, it for an unknown or base variant."""
    named = F.coalesce(F.nullif(slugify(heading), F.lit("")), F.lit("unknown"))
    what = F.coalesce(F.concat(plain_number(size), F.lit("b")), F.substring(named, 1, 24))
    kind = F.when(variant.isin("unknown", "base"), "it").otherwise(variant)
    return F.concat(family, F.lit(":"), what, F.lit("-"), kind)


def readme_evals(library: DataFrame, family: str, readme: str, source: str = "readme") -> DataFrame:
    """One row for each model column of the tables in readmes: eval_id, family, size_b, variant, benchmarks, source, reference_ids, column_header.

    A table of two columns whose second names neither size nor variant is of
    one implicit subject.
    """
    t = benchmark_tables(library, family, readme)
    size, variant = size_in(F.col("header")), column_variant(F.col("header"))
    single = (F.col("columns") == 2) & size.isNull() & (variant == "unknown")
    ident = F.when(single, F.concat(F.col(family), F.lit(":readme-single"))).otherwise(eval_id(F.col(family), size, variant, F.col("header")))
    return t.select(
        ident.alias("eval_id"), F.col(family).alias("family"), F.when(~single, size).alias("size_b"), F.when(single, "unknown").otherwise(variant).alias("variant"), "benchmarks",
        F.lit(source).alias("source"), F.array(F.concat(F.lit("ref-readme-"), slugify(F.col(family)))).alias("reference_ids"), F.when(single, "single-column").otherwise(F.col("header")).alias("column_header"),
    )


def seed_evals(document: DataFrame) -> DataFrame:
    """Curated subjects of a document {subjects: [...]}: a missing variant is unknown, missing lists and maps are empty, the source is web_seed."""
    s = document.select(F.explode("subjects").alias("s"))
    maps, lists = F.create_map().cast("map<string,double>"), F.array().cast("array<string>")
    return s.select(
        "s.eval_id", "s.family", F.col("s.size_b").cast("double").alias("size_b"), F.coalesce("s.variant", F.lit("unknown")).alias("variant"), F.coalesce("s.benchmarks", maps).alias("benchmarks"),
        F.lit("web_seed").alias("source"), F.coalesce("s.reference_ids", lists).alias("reference_ids"), F.col("s.notes").alias("notes"),
    )


def match_evals(rows: DataFrame, evals: DataFrame, keep: tuple[str, ...], limit: float = 8.0) -> DataFrame:
    """For each catalog row the nearest eval row of its family: ref, what keep names, distance. Rows without one go.

    rows: ref, family, size, variant; evals: eval_id, family, size_b, variant,
    source. The distance is that of the sizes plus a penalty for another
    variant (0.5 where one is unknown, 2 else); an unknown size is 5 away. Rows
    without a size are considered only where the family has none with one. Of
    equals, the one nearer by size, then a web source, then the first in order
    of size and id. Distances beyond the limit don't count. Catalog rows of
    one family, size and variant are matched once, and sizes are merged in
    order (joins.neighbours), so rows meet at most two of each variant.
    """
    unknown = F.lit("unknown")
    pool = evals.select("family", F.col("size_b").cast("double").alias("_s"), F.coalesce("variant", unknown).alias("_v"), (~F.startswith(F.coalesce("source", F.lit("")), F.lit("web"))).alias("_other"), F.struct(*keep).alias("_hit"), F.col("eval_id").alias("_id"))
    kinds = rows.select("family", F.col("size").cast("double").alias("size"), "variant").distinct()
    near = neighbours(kinds.where("size IS NOT NULL"), pool, "family", "size", "_s", "_v", ["_other", "_id"])
    hits = kinds.join(near.select(F.col("family").alias("_f"), F.col("size").alias("_size"), F.explode(F.array_compact(F.array("below", "above"))).alias("_row")), (F.col("family") == F.col("_f")) & (F.col("size") == F.col("_size"))).select("family", "size", "variant", "_row.*")
    # Where sizes can't be told apart, the first row of each variant is as good as any: of those with a size, if the family has one.
    first = pool.groupBy("family", "_v", F.col("_s").isNotNull().alias("_known")).agg(F.min_by(F.struct("_other", F.col("_s").alias("s"), F.col("_id").alias("id"), "_hit"), F.struct("_other", F.coalesce("_s", F.lit(0.0)), "_id")).alias("r"))
    families = pool.groupBy(F.col("family").alias("_f")).agg(F.bool_or(F.col("_s").isNotNull()).alias("_sized"))
    first = first.join(families, F.col("family") == F.col("_f")).where("_known = _sized").select(F.col("family").alias("_f"), "_sized", F.col("r.s").alias("_s"), "_v", F.col("r._other").alias("_other"), F.col("r._hit").alias("_hit"), F.col("r.id").alias("_id"))
    flat = kinds.join(first, (F.col("family") == F.col("_f")) & (F.col("size").isNull() | ~F.col("_sized"))).select("family", "size", "variant", "_s", "_v", "_other", "_hit", "_id")
    away = F.coalesce(F.abs(F.col("_s") - F.col("size")), F.lit(5.0))
    off = F.when(F.col("_v") == F.col("variant"), 0.0).when((F.col("_v") == "unknown") | (F.col("variant") == "unknown"), 0.5).otherwise(2.0)
    order = F.struct((away + off).alias("d"), away.alias("away"), F.col("_other").alias("other"), F.coalesce("_s", F.lit(0.0)).alias("s"), F.col("_id").alias("id"))
    best = hits.unionByName(flat).groupBy("family", "size", "variant").agg(F.min_by("_hit", order).alias("_hit"), F.min(order).alias("_order")).where(F.col("_order.d") <= limit)
    b = best.select(F.col("family").alias("_f"), F.col("size").alias("_s"), F.col("variant").alias("_v"), "_hit", F.col("_order.d").alias("distance"))
    same = (F.col("family") == F.col("_f")) & F.col("size").eqNullSafe(F.col("_s")) & (F.col("variant") == F.col("_v"))
    return rows.select("ref", "family", "size", "variant").join(b, same).select("ref", "_hit.*", "distance")


def base_weights(evals: DataFrame) -> DataFrame:
    """Weights (eval_id, metric, weight) of each row's general score: embedding rows have one metric, vision rows one more, and then all sum to 1."""
    suite = tables.INTELLIGENCE_SUITE
    vision = suite | {"mmmu": 0.15}
    total = sum(vision.values())
    maps = {"embedding": {"mteb": 1.0}, "vision": {k: v / total for k, v in vision.items()}, "general": suite}
    as_map = {k: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for k, m in maps.items()}
    ident, variant = F.coalesce("eval_id", F.lit("")), F.coalesce("variant", F.lit(""))
    embeds = (variant == "embedding") | F.contains(ident, F.lit("embed"))
    sees = (variant == "vision") | F.contains(ident, F.lit("vl"))
    return evals.select("eval_id", F.explode(F.when(embeds, as_map["embedding"]).when(sees, as_map["vision"]).otherwise(as_map["general"])).alias("metric", "weight"))


def base_scores(evals: DataFrame) -> DataFrame:
    """q_base of each row by its own weights over the metrics it has, to three digits, and the mean to four; 50 and 0 where it has none."""
    stats = bench_population(evals).select("metric", "min_value", "max_value")
    each = base_weights(evals).join(F.broadcast(stats), "metric").join(evals.select("eval_id", "benchmarks"), "eval_id").withColumn("value", resolved("benchmarks", F.col("metric"))).where("value IS NOT NULL")
    norm = min_max(F.col("value"), F.col("min_value"), F.col("max_value"))
    mix = each.groupBy("eval_id").agg((F.sum(F.col("weight") * norm) / F.sum("weight")).alias("mix"), F.count("*").alias("n_metrics"))
    out = evals.select("eval_id", "family", "size_b", "variant", "source").join(mix, "eval_id", "left")
    return out.withColumns(
        {"q_base": round_half_up(F.coalesce("mix", F.lit(50.0)), 3), "mix_avg": round_half_up(F.coalesce("mix", F.lit(0.0)), 4), "n_metrics": F.coalesce("n_metrics", F.lit(0))}
    ).drop("mix")


def task_scores(evals: DataFrame) -> DataFrame:
    """Scores by use case of each row, to three digits; tasks without a metric, or without one they need, have no row."""
    scores = suite_scores(evals, "eval_id", tables.TASK_SUITES, tables.TASK_REQUIRED)
    return scores.withColumn("score", round_half_up(F.col("score"), 3))


def ref_scores(rows: DataFrame, evals: DataFrame) -> DataFrame:
    """Scores of catalog rows by their nearest eval row: q_file and the part of the composite that needs no device.

    rows: ref, family, tag, quant, params, context_length.
    """
    sized = rows.select("ref", "family", tag_size(F.coalesce("tag", F.lit("")), F.col("params")).alias("size"), tag_variant(F.coalesce("tag", F.lit("")), F.col("family")).alias("variant"))
    hits = match_evals(sized, evals, ("eval_id",)).drop("distance").join(base_scores(evals).select("eval_id", "q_base"), "eval_id")
    df = hits.join(rows.select("ref", "family", "tag", "quant", "context_length"), "ref")
    df = df.withColumns({"quant_factor": quant_factor(F.col("quant")), "_ctx": context_score(F.col("context_length"))})
    df = df.withColumn("q_file", round_half_up(F.col("q_base") * F.col("quant_factor"), 3))
    parts = round_half_up(F.col("q_file") * 0.50, 3), round_half_up(F.col("_ctx") * 26.0, 3)
    return df.withColumns({"context_score": round_half_up(F.col("_ctx"), 4), "q_file_term": parts[0], "context_term": parts[1], "q_rec_partial": round_half_up(parts[0] + parts[1], 3)}).drop("_ctx")


def ingest_summary(readme: DataFrame, seed: DataFrame, merged: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row of counts: rows by source, families of the catalog and of the evals, families without evals. readme, seed, merged, catalog have family."""
    def families(df: DataFrame) -> DataFrame:
        return df.select("family").distinct()

    missing = families(catalog).join(families(merged), "family", "left_anti")
    counts = {
        "readme_rows": readme.agg(F.count("*")), "web_seed_rows": seed.agg(F.count("*")), "merged_eval_rows": merged.agg(F.count("*")), "readme_families": families(readme).agg(F.count("*")),
        "family_count": families(catalog).agg(F.count("*")), "eval_family_count": families(merged).agg(F.count("*")), "missing_eval_family_count": missing.agg(F.count("*")),
    }
    out = None
    for name, one in counts.items():
        one = one.toDF(name)
        out = one if out is None else out.crossJoin(one)
    return out


def missing_families(catalog: DataFrame, evals: DataFrame) -> DataFrame:
    """Families of the catalog that no eval row has."""
    return catalog.select("family").distinct().join(evals.select("family"), "family", "left_anti")
