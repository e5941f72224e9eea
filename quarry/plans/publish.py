"""Publication: names, links, compact rows, qualities, devices, checked documents, identity export."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import text
from quarry.operators import catalog as ops
from quarry.operators import publish, vram
from quarry.plans.roles import CATALOG, GPUS, Registry, catalog, gpus, r4, s4, table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


@R.add("SELECT c_custkey FROM customer WHERE CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END")
def header_filter(spark, d):
    """Unknown counts as not read."""
    k = F.col("c_custkey") % 3
    return publish.with_header(table(spark, d, "customer").withColumn("header_ok", F.when(k == 0, True).when(k == 1, False))).select("c_custkey")


NAMES = """n AS (SELECT p_brand || p_name AS digest, p_brand || ':' || t AS ref, t AS tag, CASE WHEN p_partkey % 4 > 0 THEN p_partkey END AS pushed FROM (
  SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'latest' WHEN 1 THEN p_type || '-q4_0' WHEN 2 THEN '7b' WHEN 3 THEN '7B-q4_K_M' ELSE 'default' END AS t FROM part))"""
SUFFIX = r"(?i)(?:^|[-_:])(?:f16|fp16|bf16|fp32|f32|fp8|q\d(?:_[a-z0-9]+){0,2}|iq\d(?:_[a-z0-9]+){0,2}|mxfp\d|nvfp\d)$"


def _names(spark, d):
    k = F.col("p_partkey") % 5
    tag = F.when(k == 0, "latest").when(k == 1, F.concat("p_type", F.lit("-q4_0"))).when(k == 2, "7b").when(k == 3, "7B-q4_K_M").otherwise("default")
    return table(spark, d, "part").select(
        F.concat("p_brand", "p_name").alias("digest"), F.concat("p_brand", F.lit(":"), tag).alias("ref"), tag.alias("tag"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_partkey")).alias("pushed")
    )


@R.add(f"""WITH {NAMES}, r AS (SELECT *, max(pushed) OVER (PARTITION BY digest) AS newest, count(*) OVER (PARTITION BY digest) AS n_names,
  row_number() OVER (PARTITION BY digest ORDER BY tag NOT IN ('latest', 'default'), regexp_matches(tag, '{SUFFIX}'), length(ref), lower(ref), ref) AS n FROM n)
SELECT digest, ref, newest AS pushed, n_names FROM r WHERE n = 1""")
def canonical_names(spark, d):
    x = _names(spark, d)
    return publish.canonical_rows(x, "digest", publish.canonical_rank(F.col("ref"), F.col("tag")), "pushed").select("digest", "ref", "pushed", "n_names")


LINKS = """c AS (SELECT c_custkey, CAST(c_custkey AS varchar) AS digest, 'r' || CAST(c_custkey % 60 AS varchar) AS release, c_mktsegment AS family FROM customer),
bd AS (SELECT CAST(s_suppkey * 3 AS varchar) AS digest, s_name AS repo FROM supplier),
br AS (SELECT 'r' || CAST(n_nationkey * 2 AS varchar) AS release, n_name AS repo FROM nation WHERE n_regionkey < 3),
fb AS (SELECT 'r' || CAST(n_nationkey * 3 AS varchar) AS release, 'f ' || n_name AS repo FROM nation),
bf AS (SELECT DISTINCT c_mktsegment AS family, lower(c_mktsegment) AS repo FROM customer WHERE c_mktsegment < 'H')"""


@R.add(f"""WITH {LINKS}, j AS (SELECT c.*, bd.repo AS d, br.repo AS r, fb.repo AS b, bf.repo AS f FROM c LEFT JOIN bd USING (digest) LEFT JOIN br USING (release) LEFT JOIN fb USING (release) LEFT JOIN bf USING (family))
SELECT c_custkey, coalesce(d, r, b) AS release_repo, CASE WHEN d IS NOT NULL THEN 'verified' WHEN coalesce(r, b) IS NOT NULL THEN 'likely' END AS release_confidence,
  CASE WHEN d IS NULL AND r IS NOT NULL THEN 'readme_verified' WHEN d IS NULL AND b IS NOT NULL THEN 'readme' END AS release_method, coalesce(d, f) AS family_repo,
  coalesce(d, r, b, f) AS shown, CASE WHEN coalesce(d, r, b, f) IS NOT NULL THEN coalesce(d, r, b) IS NULL END AS family_only,
  CASE WHEN d IS NOT NULL THEN 'byte-identical file match' WHEN r IS NOT NULL THEN 'named in the readme, LLM-confirmed but not hash-verified' WHEN b IS NOT NULL THEN 'named in the readme, not hash-verified'
    WHEN f IS NOT NULL THEN 'found via the model''s GitHub repo, not hash-verified, family-wide guess, not confirmed for this exact size' ELSE '' END AS hint FROM j""")
def link_slots(spark, d):
    """digest > release > fallback release; digest > family; then the link that is shown and what is said of it."""
    nation, none = table(spark, d, "nation"), F.lit(None).cast("string")
    release = lambda k: F.concat(F.lit("r"), (F.col("n_nationkey") * k).cast("string")).alias("release")
    shape = lambda df, key, repo, method: df.select(key, repo.alias("repo"), F.concat(F.lit("https://h/"), repo).alias("url"), method.alias("method"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("digest"), F.concat(F.lit("r"), (F.col("c_custkey") % 60).cast("string")).alias("release"), F.col("c_mktsegment").alias("family"))
    by_digest = shape(table(spark, d, "supplier"), (F.col("s_suppkey") * 3).cast("string").alias("digest"), F.col("s_name"), F.lit("ignored"))
    by_release = shape(nation.where("n_regionkey < 3"), release(2), F.col("n_name"), F.lit("readme_verified"))
    fallback = shape(nation, release(3), F.concat(F.lit("f "), "n_name"), none)
    families = table(spark, d, "customer").where("c_mktsegment < 'H'").select(F.col("c_mktsegment").alias("family")).distinct()
    by_family = shape(families, F.col("family"), F.lower("family"), F.lit("github_llm"))
    out = publish.link_slots(c, by_digest, by_release, by_family, fallback)
    upstream = F.lit(None).cast("struct<repo:string,url:string,confidence:string>")
    out = out.withColumn("shown", publish.resolved_link(upstream, F.col("hf")))
    return out.select(
        "c_custkey", F.col("hf.release.repo").alias("release_repo"), F.col("hf.release.confidence").alias("release_confidence"), F.col("hf.release.method").alias("release_method"),
        F.col("hf.family.repo").alias("family_repo"), F.col("shown.repo").alias("shown"), F.col("shown.family_only").alias("family_only"), publish.link_hint(F.lit("hf"), F.col("shown")).alias("hint"),
    )


@R.add("""SELECT ref, params, layers, quant, gpu_weight_bytes, ple_bytes, projector_bytes, experts, vram_digest_calibrated, description, array_to_string(list_filter([
    CASE WHEN projector_bytes <> 0 OR contains(t, 'vision') THEN 'vision' END, CASE WHEN contains(t, 'code') THEN 'code' END, CASE WHEN arch = 'bert' THEN 'embedding' END, CASE WHEN contains(t, 'r1-') THEN 'reasoning' END], lambda x: x IS NOT NULL), ',') AS signals, release
FROM (SELECT p_brand || ':' || tag AS ref, p_partkey AS params, p_size AS layers, CASE p_partkey % 4 WHEN 0 THEN 'Q4_K_M' WHEN 1 THEN 'F16' WHEN 2 THEN 'Q8' END AS quant,
  CASE WHEN p_size % 3 = 0 THEN p_size * 7 ELSE p_size END AS gpu_weight_bytes, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS ple_bytes, CASE WHEN p_size % 5 = 0 THEN 9 ELSE 0 END AS projector_bytes, CASE WHEN p_size % 2 = 1 THEN 8 ELSE 0 END AS experts,
  p_size % 7 = 0 AS vram_digest_calibrated, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END AS description, CASE WHEN p_partkey % 6 = 0 THEN 'bert' ELSE 'llama' END AS arch, p_brand || ':' || coalesce(nullif(stem, ''), 'default') AS release, lower(p_brand || ' ' || p_brand || ':' || tag) AS t
  FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'r1-7b' WHEN 1 THEN 'code-fp16' WHEN 2 THEN 'q8_0' ELSE 'vision' END AS tag, CASE p_partkey % 4 WHEN 0 THEN 'r1-7b' WHEN 1 THEN 'code' WHEN 2 THEN '' ELSE 'vision' END AS stem FROM part))""")
def compact_rows(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    tag = F.when(k % 4 == 0, "r1-7b").when(k % 4 == 1, "code-fp16").when(k % 4 == 2, "q8_0").otherwise("vision")
    some = lambda c, v: F.when(c, v)
    rows = table(spark, d, "part").select(
        F.concat("p_brand", F.lit(":"), tag).alias("ref"), F.col("p_brand").alias("model"), tag.alias("tag"), F.col("p_name").alias("digest"), F.when(k % 6 == 0, "bert").otherwise("llama").alias("arch"),
        F.when(k % 4 == 0, "15").when(k % 4 == 1, "unknown").when(k % 4 == 2, " ").otherwise("None").alias("quant"), k.alias("param_count"), k.alias("active_params"), n.alias("weight_bytes"), n.alias("active_weight_bytes"),
        F.when(n % 3 == 0, n * 7).when(n % 3 == 1, 0).alias("gpu_weight_bytes"), some(n % 2 == 0, n).alias("ple_bytes"), some(n % 5 == 0, 9).alias("projector_bytes"), n.alias("n_layer"), n.alias("context_length"),
        some(n % 2 == 1, 8).alias("expert_count"), some(n % 2 == 1, 2).alias("expert_used_count"), *[F.lit(None).cast("long").alias(c) for c in ("sliding_window", "shared_kv_layers", "n_swa_layers", "n_global_layers")],
        n.alias("kv_local_bytes_per_token_f16"), n.alias("kv_global_bytes_per_token_f16"), F.when(n % 7 == 0, True).alias("vram_digest_calibrated"), F.create_map(F.lit("2048"), n).alias("vram_bytes_at_ctx"),
        F.lit("2025").alias("pushed_at"), some(n % 4 > 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("description"),
    )
    out = publish.compact_rows(rows)
    keep = ("ref", "params", "layers", "quant", "gpu_weight_bytes", "ple_bytes", "projector_bytes", "experts", "vram_digest_calibrated", "description", "release")
    return out.select(*keep, F.array_join("signals", ",").alias("signals"))


@R.add("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN n_regionkey < 3 THEN n_name ELSE '' END AS description FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def fill_blank(spark, d):
    """Families' descriptions where a row has none or only white space."""
    k = F.col("c_custkey") % 3
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(k == 0, F.col("c_name")).when(k == 1, "  ").alias("description"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_regionkey") < 3, F.col("n_name")).alias("description"))
    return publish.fill_blank(c, n, "c_nationkey", "description").select("c_custkey", "description")


@R.add("""WITH r AS (SELECT p_partkey AS ref, p_brand AS model, [p_partkey, p_partkey + 50, p_partkey * 2] AS names FROM part), e AS (SELECT ref, model, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM r),
s AS (SELECT s_suppkey * 3 AS name, 'e' || CAST(s_suppkey AS varchar) AS eval_id, s_acctbal AS q FROM supplier), q AS (SELECT 'e' || CAST(s_suppkey AS varchar) AS eval_id, s_name AS source FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 6 > 0),
h AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY pos) AS n FROM e JOIN s USING (name))
SELECT ref, model, eval_id, q AS q_file, coalesce(source, 'measured') AS quality_source FROM h LEFT JOIN q USING (eval_id) WHERE n = 1""")
def compact_quality(spark, d):
    k, s = F.col("p_partkey"), table(spark, d, "supplier")
    rows = table(spark, d, "part").select(k.alias("ref"), F.col("p_brand").alias("model"), F.array(k + 50, k * 2).alias("aliases"))
    ident = F.concat(F.lit("e"), F.col("s_suppkey").cast("string"))
    rows = rows.withColumn("aliases", F.transform("aliases", lambda x: x.cast("string"))).withColumn("ref", F.col("ref").cast("string"))
    scores = s.select((F.col("s_suppkey") * 3).cast("string").alias("ref"), ident.alias("eval_id"), F.col("s_acctbal").alias("q_file"))
    sources = s.select(ident.alias("eval_id"), F.when(F.col("s_suppkey") % 6 == 0, "").when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("source"))
    out = publish.compact_quality(rows, scores, sources)
    return out.select(F.col("ref").cast("long").alias("ref"), "model", "eval_id", "q_file", "quality_source")


OWN = "own AS (SELECT gpu_id, name, bandwidth * 0.8 AS bw, CASE WHEN gpu_id % 2 = 0 THEN CAST(0.00002 AS double) END AS layer FROM gpus WHERE region = 0)"


@R.add(f"""WITH {GPUS}, {OWN}, o AS (SELECT * FROM own WHERE layer IS NOT NULL)
SELECT g.gpu_id, {s4('coalesce(o.bw, g.bandwidth * 0.6)')} AS bw_eff_gbs, {s4('coalesce(o.layer, 0.00003) * 100000')} AS layer, {s4('coalesce(CASE WHEN o.layer IS NOT NULL THEN 0.002 END, 0.0015) * 1000')} AS fixed,
  CAST(CASE WHEN o.layer IS NOT NULL THEN 0.8 ELSE 0.7 END AS double) AS q4, CAST(0.9 AS double) AS q8, CAST(CASE WHEN o.layer IS NOT NULL THEN 0.25 ELSE 0.3 END AS double) AS derate, o.layer IS NOT NULL AS calibrated, o.name AS source FROM gpus g LEFT JOIN o USING (gpu_id)""".replace("0.6)", "CAST(0.6 AS double))"))
def gpu_estimates(spark, d):
    """Own fit, else the shared medians, else defaults; factors of formats are merged, the own one wins. A device without a fit isn't calibrated."""
    g = gpus(spark, d).select(F.col("gpu_id").alias("id"), "name", F.lit("v").alias("vendor"), F.lit("t").alias("type"), F.lit("g").alias("generation"), F.lit(8.0).alias("memory_gb"), F.lit(0.9).alias("usable_fraction"), F.col("bandwidth").alias("bandwidth_gbs"), "fp16_tflops", F.lit(None).cast("string").alias("notes"), "region")
    factors = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), F.lit(v))]).cast("map<string,double>")
    own = g.where("region = 0").select(
        F.col("id").alias("gpu_id"), "name", (F.col("bandwidth_gbs") * 0.8).alias("bw_eff_gbs"), F.when(F.col("id") % 2 == 0, F.lit(0.00002)).alias("c_s_per_layer"), F.lit(0.002).alias("d_s"), factors(Q4=0.8).alias("quant_factors"), F.lit(0.25).alias("prefill_derate")
    )
    shared = spark.range(1).select(F.lit(0.6).alias("bw_eff_fraction"), F.lit(None).cast("double").alias("c_s_per_layer"), F.lit(None).cast("double").alias("d_s"), factors(Q4=0.7, Q8=0.9).alias("quant_factors"), F.lit(None).cast("double").alias("prefill_derate"))
    out = publish.compact_gpus(vram.speed_constants(g, own, shared)).select("id", "estimate.*")
    return out.select(
        F.col("id").alias("gpu_id"), r4("bw_eff_gbs").alias("bw_eff_gbs"), r4(F.col("c_s_per_layer") * 100000).alias("layer"), r4(F.col("d_s") * 1000).alias("fixed"),
        F.element_at("quant_factors", "Q4").alias("q4"), F.element_at("quant_factors", "Q8").alias("q8"), F.col("prefill_derate").alias("derate"), "calibrated", F.col("calibration_source").alias("source"),
    )


@R.add(f"""SELECT r_regionkey AS k, CASE WHEN r_regionkey % 2 = 0 THEN CAST({tables.BASELINE['b0']} AS double) ELSE CAST(5 AS double) END AS b0, CASE WHEN r_regionkey % 2 = 0 THEN CAST({tables.BASELINE['b_tensor']} AS double) ELSE CAST(0 AS double) END AS b_tensor FROM region""")
def memory_model_guard(spark, d):
    """Coefficients that are all missing are the defaults, single missing ones 0; an old version would fail the job."""
    k = F.col("r_regionkey")
    c = table(spark, d, "region").select(F.when(k != 1, F.lit(2)).alias("constants_version"), F.lit(tables.FORMULA).alias("formula"), F.when(k % 2 == 1, F.lit(5.0)).alias("b0"), *[F.lit(None).cast("double").alias(x) for x in ("b_tensor", "b_output")], k)
    out = publish.memory_model(c.drop("r_regionkey")).withColumn("n", F.monotonically_increasing_id())
    return out.select(F.col("n").alias("k"), "b0", "b_tensor")


@R.add("""WITH x AS (SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey % 2 = 0 END AS ok FROM supplier)
SELECT s_suppkey, 'name' AS name, s_name AS value FROM x UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS varchar) FROM x UNION ALL SELECT s_suppkey, 'ok', CAST(ok AS varchar) FROM x WHERE s_suppkey % 4 > 0
UNION ALL SELECT s_suppkey, 'ratio', CAST(s_nationkey AS varchar) || '.5' FROM x""")
def scalar_projection(spark, d):
    """Open JSON maps: objects and arrays go, whatever their names; a null is a scalar."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = lambda c: c.cast("string")
    ok = F.when(k % 3 == 0, s(n % 2 == 0)).otherwise("null")
    record = F.concat(
        F.lit('{"name":"'), F.col("s_name"), F.lit('","nation":'), s(n), F.when(k % 4 > 0, F.concat(F.lit(',"ok":'), ok)).otherwise(""), F.lit(',"ratio":'), s(n), F.lit(".5"),
        F.lit(',"shape":{"layers":'), s(k), F.lit('},"tags":["'), F.col("s_name"), F.lit('"]}'),
    )
    return publish.scalar_fields(table(spark, d, "supplier").select(k, record.alias("record")), "s_suppkey", "record").select("s_suppkey", "name", "value")


@R.add("SELECT n_name AS model, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'd ' || n_name END AS description, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'r' END AS readme FROM nation WHERE n_nationkey % 6 > 0 AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 0)")
def library_compact(spark, d):
    k = F.col("n_nationkey")
    library = table(spark, d, "nation").select(F.col("n_name").alias("model"), F.when(k % 3 > 0, F.concat(F.lit(" d "), "n_name")).alias("description"), F.when(k % 2 > 0, "r ").otherwise("  ").alias("readme"), k)
    rows = table(spark, d, "customer").where("c_acctbal > 0").join(library.select("n_nationkey", "model"), F.col("c_nationkey") == k)
    return publish.compact_library(library, rows).select("model", "description", "readme")


@R.add("SELECT n_name AS model, array_to_string(list_filter([CASE WHEN n_nationkey % 2 = 0 THEN 'github' END, CASE WHEN n_nationkey % 3 = 0 THEN 'homepage' END], lambda x: x IS NOT NULL), ',') AS kinds FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0")
def link_content(spark, d):
    """Pages of papers and empty pages go; so do families without any."""
    k, none = F.col("n_nationkey"), F.lit(None).cast("string")
    pages = F.create_map(F.lit("github"), F.when(k % 2 == 0, "g"), F.lit("homepage"), F.when(k % 3 == 0, "h").otherwise(""), F.lit("paper"), F.lit("p"), F.lit("hf"), none)
    content = table(spark, d, "nation").select(F.col("n_name").alias("model"), pages.alias("content"))
    return publish.compact_link_content(content, content).select("model", F.array_join(F.array_sort(F.map_keys("content")), ",").alias("kinds"))


@R.add("""WITH a AS (SELECT s_suppkey AS digest, CASE s_suppkey % 3 WHEN 0 THEN 'likely' WHEN 1 THEN 'unresolved' ELSE 'likely' END AS status, CASE WHEN s_suppkey % 3 <> 1 THEN s_name END AS repo FROM supplier),
v AS (SELECT s_suppkey AS digest, s_name AS repo, s_nationkey % 2 = 0 AS ok FROM supplier UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'other' END, false FROM supplier),
u AS (SELECT digest, bool_and(ok) AS ok, count(*) AS n FROM a JOIN v USING (digest, repo) WHERE status = 'likely' GROUP BY 1)
SELECT p.p_partkey AS digest, a.status, CASE WHEN u.ok IS NOT NULL THEN a.repo END AS repo, CASE WHEN u.ok THEN 'semantic_verified' WHEN NOT u.ok THEN 'provisional' END AS confidence, u.n AS support
FROM part p LEFT JOIN a ON a.digest = p.p_partkey LEFT JOIN u ON u.digest = p.p_partkey""")
def export_identity(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    artifacts = s.select(k.alias("digest"), F.when(k % 3 == 1, "unresolved").otherwise("likely").alias("status"), F.when(k % 3 != 1, F.col("s_name")).alias("repo"), F.lit(None).cast("long").alias("n_matches"))
    first = s.select(k.alias("digest"), F.col("s_name").alias("repo"), F.when(F.col("s_nationkey") % 2 == 0, "semantic_verified").otherwise("release_name_constraints").alias("method"))
    second = s.select(k.alias("digest"), F.when(k % 2 == 0, F.col("s_name")).otherwise("other").alias("repo"), F.lit(None).cast("string").alias("method"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("digest"))
    out = publish.export_identity(rows, artifacts, first.unionByName(second), provisional=True)
    return out.select("digest", "status", F.col("upstream.repo").alias("repo"), F.col("upstream.confidence").alias("confidence"), F.col("upstream.n_support").alias("support"))


@R.add(f"WITH {CATALOG} SELECT DISTINCT CASE WHEN p < 3e8 THEN 'micro' WHEN p < 1e9 THEN 'tiny' WHEN p < 3e9 THEN 'small' WHEN p < 7e9 THEN 'compact' WHEN p IS NULL THEN 'unknown' ELSE 'medium' END AS size_class, p IS NOT NULL AS chosen FROM (SELECT CASE WHEN CAST(ref AS bigint) % 50 > 0 THEN params * (CAST(ref AS bigint) % 6) + 1 END AS p FROM catalog)")
def present_sizes(spark, d):
    """Classes that the catalog has; all but the unknown are chosen at first."""
    key = F.col("ref").cast("long")
    return ops.present_sizes(catalog(spark, d).withColumn("params", F.when(key % 50 > 0, F.col("params") * (key % 6) + 1))).select("size_class", "chosen")


@R.add(f"""WITH {CATALOG}, {GPUS}, x AS (SELECT *, CASE WHEN ctx_max >= 4096 THEN weight_bytes + kv_per_token * 4096 END AS vram, usable * memory AS room FROM catalog CROSS JOIN (SELECT * FROM gpus WHERE gpu_id = 7)),
f AS (SELECT *, CASE WHEN vram IS NULL THEN 'context' WHEN vram <= room THEN 'full' WHEN weight_bytes <= room + 8e9 THEN 'partial' ELSE 'none' END AS fit FROM x),
p AS (SELECT *, list_filter([CASE WHEN fit = 'full' THEN CAST(CAST(floor((room - vram) / 1e6 + 0.5) AS bigint) AS varchar) || ' MB GPU memory left at 4k context' WHEN fit = 'partial' THEN 'fits only by moving weights into system RAM' END,
  CASE WHEN layers % 2 = 0 THEN 'code task score ' || CAST(layers AS varchar) || ' from coding benches' END], lambda r: r IS NOT NULL) AS parts FROM f)
SELECT ref, fit, CASE WHEN len(parts) > 0 THEN array_to_string(parts, '; ') || '.' WHEN fit = 'context' THEN 'trained context is below the requested 4k.' ELSE 'model weights exceed the selected GPU and system-memory budget.' END AS why FROM p""")
def rationale(spark, d):
    g = gpus(spark, d).where("gpu_id = 7").first()
    one = F.struct(*[F.lit(g[k]).alias(k) for k in ("memory", "usable", "bandwidth", "per_layer", "fixed")])
    q = ops.FindQuery(ctx=4096, ram_gb=8, usecase="code", as_of="2026-01-01")
    score = F.when(F.col("layers") % 2 == 0, F.col("layers").cast("double"))
    rows = catalog(spark, d).withColumns({"q_file": score, "q_task": score, "active_params": F.col("params"), "eval_id": F.lit(None).cast("string")})
    return ops.view(rows, one, q).select("ref", "fit", ops.rationale(q).alias("why"))


@R.add("""SELECT o_orderkey, CASE WHEN s < 0 THEN '?' WHEN s >= 3600 THEN CAST(s // 3600 AS varchar) || 'h' || lpad(CAST(s % 3600 // 60 AS varchar), 2, '0') || 'm' || lpad(CAST(s % 60 AS varchar), 2, '0') || 's'
  WHEN s >= 60 THEN CAST(s // 60 AS varchar) || 'm' || lpad(CAST(s % 60 AS varchar), 2, '0') || 's' ELSE CAST(s AS varchar) || 's' END AS spent, strftime(o_orderdate, '%b ') || CAST(day(o_orderdate) AS varchar) || strftime(o_orderdate, ', %Y') AS day,
  CASE o_orderkey % 3 WHEN 0 THEN 'Full GPU' WHEN 1 THEN 'Doesn’t fit' ELSE 'Context too short' END AS fit, CASE o_orderkey % 2 WHEN 0 THEN 'Vision input' ELSE 'other' END AS signal,
  CASE o_orderkey % 3 WHEN 0 THEN 'https://a.b/c?x&y' WHEN 1 THEN 'https://s.t/library/q' END AS url, CASE o_orderkey % 2 WHEN 0 THEN 'RTX 4090' ELSE 'M3' END AS device
FROM (SELECT *, o_orderkey * 37 % 20000 - 50 AS s FROM orders)""")
def labels_and_times(spark, d):
    k = F.col("o_orderkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    return table(spark, d, "orders").select(
        k, text.format_duration((k * 37 % 20000 - 50).cast("double")).alias("spent"), text.format_date(F.col("o_orderdate")).alias("day"), text.fit_label(pick("full", "none", "context")).alias("fit"),
        text.signal_label(pick("vision", "other")).alias("signal"), text.safe_url(pick(" https://a.b/c?x&amp;y", "/library/q", "javascript:x"), "https://s.t").alias("url"),
        text.short_device(pick("NVIDIA GeForce RTX 4090", "Apple M3")).alias("device"),
    )


@R.add("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Q4_K_M' WHEN 1 THEN 'F16' WHEN 2 THEN 'Q5_K_S' WHEN 3 THEN 'F16' WHEN 4 THEN 'IQ2_XXS' WHEN 5 THEN NULL ELSE 'Q8_0' END AS quant FROM part""")
def normalize_quants(spark, d):
    k = F.col("p_partkey") % 7
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    value = pick("15", "fp16", "q5-k-s", "unknown", "", "N/A", "Q8_0")
    tag = pick("7b", "x", "x", "7b-fp16", "70b-iq2_xxs", "latest", "q4_0")
    return table(spark, d, "part").select("p_partkey", text.normalize_quant(value, tag).alias("quant"))
