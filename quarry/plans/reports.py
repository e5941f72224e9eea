"""Fits, validation, gates and reports; benchmark rows; identity plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import tables
from quarry.operators import evals, evidence, identity, vram
from quarry.plans.roles import Registry, r4, s4, table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def _ols2(source: str, by: str = "g") -> str:
    """SQL of a least-squares plane y = b0 + b1 x1 + b2 x2 by group, on centred products."""
    return f"""c AS (SELECT {by}, x1 - avg(x1) OVER w AS a, x2 - avg(x2) OVER w AS b, y - avg(y) OVER w AS v, avg(x1) OVER w AS m1, avg(x2) OVER w AS m2, avg(y) OVER w AS my FROM {source} WINDOW w AS (PARTITION BY {by})),
m AS (SELECT {by}, count(*) AS n, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, sum(a*a) AS s11, sum(a*b) AS s12, sum(b*b) AS s22, sum(a*v) AS s1y, sum(b*v) AS s2y, sum(v*v) AS syy FROM c GROUP BY {by}),
k AS (SELECT *, (s1y*s22 - s2y*s12) / (s11*s22 - s12*s12) AS b1, (s2y*s11 - s1y*s12) / (s11*s22 - s12*s12) AS b2 FROM m)"""


POINTS = """p AS (SELECT l_partkey AS digest, l_returnflag AS signature, l_linenumber * 1024 AS ctx, CAST(floor(l_extendedprice * 1000 + 0.5) AS bigint) AS resident, l_orderkey AS run,
  floor(l_extendedprice * 1000 + 0.5) - l_quantity * 1000 - 100 - (3 * (CASE WHEN l_linenumber * 1024 > 4096 THEN 4096 ELSE l_linenumber * 1024 END) + 2 * l_linenumber * 1024) AS residual,
  l_quantity AS x1, l_discount * 100000 AS x2 FROM lineitem)"""


def _points(spark, d):
    """Measured lines as memory points with two slopes of the cache and no graph."""
    ctx = F.col("l_linenumber") * 1024
    none = F.lit(None).cast("long")
    points = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("digest"), F.col("l_returnflag").alias("signature"), ctx.alias("ctx"), F.floor(F.col("l_extendedprice") * 1000 + 0.5).alias("resident"), (F.col("l_quantity") * 1000).alias("W"), F.lit(100).alias("proj"),
        F.lit(9.0).alias("kv_per_token"), F.lit(3.0).alias("kv_local_per_token"), F.lit(2.0).alias("kv_global_per_token"), F.lit(4096).alias("sliding_window"), F.lit(-1).alias("n_head"), none.alias("n_layer"), none.alias("n_swa_layers"),
        none.alias("n_global_layers"), F.lit(None).cast("double").alias("kv_elem_factor"), F.col("l_quantity").alias("tensor_count"), (F.col("l_discount") * 100000).alias("output_tensor_bytes"),
    )
    return points


def _stats(errors: str, part: str) -> str:
    return f"""SELECT '{part}' AS part, {s4('max(e)')} AS max_error, {s4('max(e) FILTER (i = CAST(round_even(n * CAST(0.95 AS double) - CAST(0.95 AS double), 0) AS bigint))')} AS p95_error, {s4('avg(e)')} AS mean_error, any_value(n) AS n
FROM (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i, count(*) OVER () AS n FROM {errors} WHERE e IS NOT NULL)"""


ERROR = "CASE WHEN resident > 0 THEN abs(round_even(resident - residual + ({}), 0) - resident) / CAST(resident AS double) END AS e"


@R.add(f"""WITH {POINTS}, one AS (SELECT 0 AS g, x1, x2, residual AS y FROM p), {_ols2('one')}, f AS (SELECT my - b1*m1 - b2*m2 AS b0, b1, b2 FROM k),
o AS (SELECT digest, median(residual) AS o FROM p GROUP BY 1),
e1 AS (SELECT {ERROR.format('b0 + b1 * x1 + b2 * x2')} FROM p CROSS JOIN f), e2 AS (SELECT {ERROR.format('o')} FROM p JOIN o USING (digest)),
e3 AS (SELECT {ERROR.format('f')} FROM (SELECT *, first_value(residual) OVER w AS f, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY digest ORDER BY ctx, resident)) WHERE n > 1),
s AS (SELECT DISTINCT signature FROM p), h AS (SELECT s.signature AS g, x1, x2, residual AS y FROM s JOIN p ON p.signature <> s.signature), {_ols2('h').replace('c AS', 'c2 AS').replace('m AS', 'm3 AS').replace('FROM c ', 'FROM c2 ').replace('k AS', 'k2 AS').replace('FROM m)', 'FROM m3)')},
e4 AS (SELECT {ERROR.format('my - b1*m1 - b2*m2 + b1 * x1 + b2 * x2')} FROM p JOIN k2 ON k2.g = p.signature)
{_stats('e1', 'train_global')} UNION ALL {_stats('e2', 'train_digest')} UNION ALL {_stats('e3', 'forward_context')} UNION ALL {_stats('e4', 'grouped_holdout')}""")
def memory_fit_report(spark, d):
    return vram.fit_report(_points(spark, d)).withColumns({c: r4(c) for c in ("max_error", "p95_error", "mean_error")})


@R.add(f"""WITH {POINTS}, s AS (SELECT DISTINCT signature FROM p), h AS (SELECT s.signature AS g, x1, x2, residual AS y FROM s JOIN p ON p.signature <> s.signature), {_ols2('h')}
SELECT g AS signature, n AS n_train, floor((my - b1*m1 - b2*m2) / 1000 * 10 + 0.5) / 10 AS b0, floor(b1 / 100 * 10 + 0.5) / 10 AS b1 FROM k""")
def holdout_planes(spark, d):
    """Each structure's plane, fitted on all others by subtracting moments."""
    from quarry.functions.numeric import round_half_up
    from quarry.operators import fitting

    out = fitting.group_holdout2(vram.memory_points(_points(spark, d)), "signature", "tensor_count", "output_tensor_bytes", "residual")
    return out.select("signature", "n_train", round_half_up(F.col("b0") / 1000, 1).alias("b0"), round_half_up(F.col("b1") / 100, 1).alias("b1"))


DECODE = """x AS (SELECT s_suppkey % 30 AS g, CAST(l_quantity * 1000000 AS double) AS x1, CAST(l_linenumber AS double) AS x2, 1.0 / (l_extendedprice / 100) AS y FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
bw AS (SELECT s_suppkey AS g, CASE WHEN s_suppkey % 2 = 0 THEN CAST(40 AS double) + s_suppkey END AS bw FROM supplier WHERE s_suppkey < 30)"""


@R.add(f"""WITH {DECODE}, {_ols2('x')}, z AS (SELECT g, any_value(bw) AS bw, regr_slope(y - x1 / (bw * 1e9), x2) AS c, regr_intercept(y - x1 / (bw * 1e9), x2) AS d FROM x JOIN bw USING (g) WHERE bw IS NOT NULL GROUP BY g),
r AS (SELECT k.g, k.n, b1, b2, my - b1*m1 - b2*m2 AS b0, z.bw, z.c, z.d, z.bw IS NOT NULL AND n >= 2 AND NOT (n >= 4 AND b1 > 0) AS held FROM k LEFT JOIN z USING (g))
SELECT g, n, CASE WHEN held THEN 'anchored_to_measured_bw' WHEN n >= 4 THEN 'free' ELSE 'insufficient' END AS mode, {s4('CASE WHEN held THEN c WHEN n >= 4 THEN b2 END * 1000')} AS c_ms, {s4('CASE WHEN held THEN d WHEN n >= 4 THEN b0 END * 1000')} AS d_ms,
  {s4('CASE WHEN held THEN bw WHEN n >= 4 AND b1 > 0 THEN 1 / b1 / 1e9 END')} AS bw_eff FROM r""")
def decode_modes(spark, d):
    """Free fit, fit anchored to the measured bandwidth, or too few points."""
    s = table(spark, d, "supplier").select("s_suppkey")
    x = table(spark, d, "lineitem").join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    points = x.select((F.col("s_suppkey") % 30).alias("g"), (F.col("l_quantity") * 1000000).alias("W"), F.col("l_linenumber").alias("L"), (F.col("l_extendedprice") / 100).alias("decode_tps"))
    bw = s.where("s_suppkey < 30").select(F.col("s_suppkey").alias("g"), F.when(F.col("s_suppkey") % 2 == 0, 40.0 + F.col("s_suppkey")).alias("bw_measured_gbs"))
    out = vram.decode_fits(points, "g", bw)
    return out.select("g", "n", "mode", r4(F.col("c_s_per_layer") * 1000).alias("c_ms"), r4(F.col("d_s") * 1000).alias("d_ms"), r4("bw_eff_gbs").alias("bw_eff"))


@R.add("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'llama' END || '|' || p_size || '|' || (CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 8 END) || '|0|64|64|0|0|0|' || (CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END) || '|0|' || (CASE WHEN p_partkey % 5 = 0 THEN 7 ELSE p_partkey END) AS signature FROM part""")
def structural_signatures(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    zero = F.lit(None).cast("long")
    df = table(spark, d, "part").select(
        k, F.when(k % 3 > 0, "llama").alias("arch"), n.alias("n_layer"), F.when(k % 2 == 1, 8).alias("n_head"), *[zero.alias(c) for c in ("n_head_kv", "sliding_window", "shared_kv_layers", "n_swa_layers", "expert_count")], F.lit(64).alias("key_length"),
        F.lit(64).alias("value_length"), F.lit(0).alias("kv_local_bytes_per_token_f16"), F.when(n % 2 == 0, n).alias("kv_local_per_token"), F.when(k % 5 > 0, k).otherwise(0).alias("param_count"), F.lit(7).alias("active_params"),
    )
    return df.select("p_partkey", vram.structural_signature(df).alias("signature"))


GATE_ROWS = """SELECT n_name AS gpu, n_nationkey AS k, n_nationkey / CAST(20 AS double) AS share, CASE WHEN n_nationkey % 3 > 0 THEN CAST(0.9 AS double) + n_nationkey / CAST(200 AS double) END AS r2 FROM nation"""
RESULT = "CASE WHEN {0} THEN 'PASS' WHEN NOT ({0}) THEN 'FAIL' ELSE 'N/A (insufficient data)' END"
GATE_SQL = {
    0: "share >= 0.9", 1: "CASE WHEN r2 IS NOT NULL THEN r2 > 0.95 AND k >= 8 END", 2: "k < 10 AND (k % 2 = 0 OR k < 5)", 3: "CASE WHEN k % 4 = 0 THEN true WHEN k % 4 = 1 THEN false END", 4: "CAST(NULL AS boolean)",
    5: "CASE WHEN k % 5 > 0 THEN k % 5 < 3 END", 6: "CASE WHEN k % 7 > 0 THEN k % 7 < 6 END", 7: "CASE WHEN k % 6 > 0 THEN k % 6 >= 3 END",
}
GATE_UNION = " UNION ALL ".join(f"SELECT gpu, {i} AS place, '| {label} | ' || {RESULT.format(GATE_SQL[i])} || ' | d' || k || ' |' AS line FROM f" for i, label in enumerate(tables.GATE_LABELS.values()))


@R.add(f"WITH f AS ({GATE_ROWS}) SELECT gpu, -3 AS place, '## ' || gpu AS line FROM f UNION ALL SELECT gpu, -2, '| gate | result | detail |' FROM f UNION ALL SELECT gpu, -1, '|---|---|---|' FROM f UNION ALL {GATE_UNION}")
def gate_report(spark, d):
    """The eight gates of each device, some that can't be told, as lines of a markdown report."""
    k = F.col("n_nationkey")
    error = lambda ok: F.when(ok, 0.01).otherwise(0.2)
    facts = table(spark, d, "nation").select(
        F.col("n_name").alias("gpu"), k, (k / 20.0).alias("unflagged_share"), F.when(k % 3 > 0, 0.9 + k / 200.0).alias("r2"), k.alias("n_decode"), error(k < 10).alias("max_error"), F.when(k % 4 > 0, error((k % 2 == 0) | (k < 5))).alias("holdout_error"),
        F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("moe_ok"), F.lit(None).cast("boolean").alias("swa_ok"), F.when(k % 5 > 0, F.create_map(F.lit("Q4"), F.when(k % 5 < 3, 1.0).otherwise(1.4))).alias("factors"),
        F.when(k % 7 > 0, F.when(k % 7 < 6, 0.3).otherwise(0.9)).alias("prefill_derate"), (k % 6).alias("n_partial"),
    )
    detail = facts.select("gpu", F.concat(F.lit("d"), k.cast("string")).alias("detail"))
    return vram.gate_lines(vram.gates(facts).join(detail, "gpu"))


@R.add(f"""WITH f AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey END AS a FROM nation)
SELECT median(CASE WHEN a IS NOT NULL AND k % 5 > 0 THEN CAST(k AS double) / (k % 5 * 10) END) AS bw_eff_fraction, median(a) * CAST(1 AS double) AS c_s_per_layer, median(CASE WHEN a IS NOT NULL THEN k * CAST(2 AS double) END) AS d_s, CAST({tables.SPEED_DEFAULTS['prefill_derate']} AS double) AS prefill_derate, true AS calibrated FROM f""")
def global_constants(spark, d):
    """Medians over calibrated devices; without a derate the default."""
    k = F.col("n_nationkey").cast("double")
    a = F.when(F.col("n_nationkey") % 3 > 0, k)
    fits = table(spark, d, "nation").select(a.alias("a_s_per_byte"), a.alias("c_s_per_layer"), (k * 2).alias("d_s"), k.alias("bw_eff_gbs"), (F.col("n_nationkey") % 5 * 10.0).alias("bw_spec_gbs"), F.lit(None).cast("double").alias("prefill_derate"))
    return vram.global_constants(fits)


# ---- benchmark rows

@R.add("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 7.0 WHEN 1 THEN 1.5 WHEN 2 THEN floor(p_retailprice / 1000 * 100 + 0.5) / 100 END AS size, CASE p_partkey % 4 WHEN 0 THEN 'instruct' WHEN 1 THEN 'distill' WHEN 2 THEN 'vision' ELSE 'unknown' END AS variant,
  'f:' || CASE p_partkey % 4 WHEN 0 THEN '7b-instruct' WHEN 1 THEN '1.5b-distill' WHEN 2 THEN 'x-vision' ELSE 'cold-nothing-it' END AS eval_id FROM part""".replace("7.0", "CAST(7 AS double)").replace("1.5 ", "CAST(1.5 AS double) "))
def eval_names(spark, d):
    k = F.col("p_partkey") % 4
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k + 1).cast("int"))
    tag = pick("7b-it", "1.5B-Distill", "vl", "zz")
    params = F.when(k == 2, F.col("p_retailprice") * 1e6)
    size, variant = evals.tag_size(tag, params), evals.tag_variant(tag, F.lit("m"))
    named = evals.size_in(pick("Big 7B", "1.5 b", "x", "Cold (nothing)!"))
    return table(spark, d, "part").select("p_partkey", size.alias("size"), variant.alias("variant"), evals.eval_id(F.lit("f"), named, variant, pick("Big 7B", "1.5 b", "x", "Cold (nothing)!")).alias("eval_id"))


@R.add("""SELECT n_name AS eval_id, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS double) END AS size_b, CASE WHEN n_nationkey % 3 = 0 THEN 'base' ELSE 'unknown' END AS variant, CASE WHEN n_nationkey % 4 > 0 THEN 1 ELSE 0 END AS n_metrics, 'web_seed' AS source FROM nation""")
def seed_evals(spark, d):
    k = F.col("n_nationkey")
    subject = F.struct(
        F.col("n_name").alias("eval_id"), F.lit("f").alias("family"), F.when(k % 2 == 0, k).alias("size_b"), F.when(k % 3 == 0, "base").alias("variant"), F.when(k % 4 > 0, F.create_map(F.lit("mmlu"), F.lit(1.0))).alias("benchmarks"),
        F.lit(None).cast("array<string>").alias("reference_ids"), F.lit(None).cast("string").alias("notes"),
    )
    documents = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(subject).alias("subjects"))
    return evals.seed_evals(documents).select("eval_id", "size_b", "variant", F.size("benchmarks").cast("int").alias("n_metrics"), "source")


EVAL_ROWS = "e AS (SELECT s_suppkey, s_nationkey % 8 AS family, CASE WHEN s_nationkey % 8 <> 3 AND s_suppkey % 3 > 0 THEN s_acctbal / 200 END AS size_b, CASE s_suppkey % 3 WHEN 0 THEN 'instruct' WHEN 1 THEN 'unknown' ELSE 'base' END AS variant, s_suppkey % 4 > 0 AS other FROM supplier)"


@R.add(f"""WITH {EVAL_ROWS}, x AS (SELECT p_partkey, p_size % 9 AS family, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size AS double) END AS size, CASE p_partkey % 2 WHEN 0 THEN 'instruct' ELSE 'unknown' END AS variant FROM part),
c AS (SELECT e.*, max(CASE WHEN size_b IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY family) AS sized FROM e),
j AS (SELECT p_partkey, s_suppkey, coalesce(abs(c.size_b - x.size), 5) AS away, CASE WHEN c.variant = x.variant THEN 0 WHEN c.variant = 'unknown' OR x.variant = 'unknown' THEN 0.5 ELSE 2 END AS off, other, coalesce(size_b, 0) AS s FROM x JOIN c USING (family) WHERE size_b IS NOT NULL OR sized = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY away + off, away, other, s, s_suppkey) AS n FROM j)
SELECT p_partkey, s_suppkey, {s4('away + off')} AS distance FROM r WHERE n = 1 AND away + off <= 8""")
def match_evals(spark, d):
    """Unknown sizes are 5 away; unsized rows count only in families without a sized one."""
    k, f = F.col("s_suppkey"), F.col("s_nationkey") % 8
    e = table(spark, d, "supplier").select(
        f.alias("family"), k.alias("eval_id"), F.when((f != 3) & (k % 3 > 0), F.col("s_acctbal") / 200).alias("size_b"), F.when(k % 3 == 0, "instruct").when(k % 3 == 2, "base").alias("variant"), F.when(k % 4 == 0, "web_seed").otherwise("readme").alias("source")
    )
    p = F.col("p_partkey")
    rows = table(spark, d, "part").select(p.alias("ref"), (F.col("p_size") % 9).alias("family"), F.when(p % 5 > 0, F.col("p_size").cast("double")).alias("size"), F.when(p % 2 == 0, "instruct").otherwise("unknown").alias("variant"))
    return evals.match_evals(rows, e, ("eval_id",)).select(F.col("ref").alias("p_partkey"), F.col("eval_id").alias("s_suppkey"), r4("distance").alias("distance"))


SUITE = ", ".join(f"('{k}', CAST({v} AS double))" for k, v in tables.INTELLIGENCE_SUITE.items())


@R.add(f"""WITH e AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 = 0 THEN 'x-embed' WHEN n_nationkey % 6 = 1 THEN 'x-vl' ELSE 'x' END || n_nationkey AS id, n_nationkey % 6 AS kind FROM nation),
v AS (SELECT k, 'mmlu' AS m, CAST(k * 3 AS double) AS v FROM e WHERE k % 2 = 0 UNION ALL SELECT k, 'bfcl', CAST(50 - k AS double) FROM e WHERE k % 3 > 0 UNION ALL SELECT k, 'mteb', CAST(k AS double) FROM e WHERE k % 4 = 0 UNION ALL SELECT k, 'mmmu', CAST(k * 2 AS double) FROM e UNION ALL SELECT k, 'mmlu_pro', CAST(k AS double) FROM e WHERE k = 5 OR k = 9),
s AS (SELECT m, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1), w0 AS (SELECT * FROM (VALUES {SUITE}) t(m, w)),
w AS (SELECT id, k, m, w FROM e CROSS JOIN w0 WHERE kind <> 0 UNION ALL SELECT id, k, 'mmmu', 0.15 FROM e WHERE kind = 1 UNION ALL SELECT id, k, 'mteb', 1.0 FROM e WHERE kind = 0),
j AS (SELECT w.id, w.w, coalesce(a.v, b.v) AS v, s.lo, s.hi FROM w JOIN s USING (m) LEFT JOIN v a ON a.k = w.k AND a.m = w.m LEFT JOIN v b ON b.k = w.k AND w.m = 'mmlu_pro' AND b.m = 'mmlu'),
q AS (SELECT id, sum(w * greatest(0, least(100, 100 * (v - lo) / (hi - lo)))) / sum(w) AS mix, count(*) AS n FROM j WHERE v IS NOT NULL GROUP BY 1)
SELECT e.id AS eval_id, floor(coalesce(mix, 50) * CAST(1000 AS double) + 0.5) / 1000 AS q_base, coalesce(n, 0) AS n_metrics FROM e LEFT JOIN q USING (id)""")
def base_scores(spark, d):
    """Weights by row: embedding rows have one metric, vision rows one more; metrics stand in for each other; none gives 50."""
    k = F.col("n_nationkey")
    v = k.cast("double")
    pairs = F.array(*[F.struct(F.lit(m).alias("k"), x.alias("v")) for m, x in (("mmlu", F.when(k % 2 == 0, v * 3)), ("bfcl", F.when(k % 3 > 0, 50 - v)), ("mteb", F.when(k % 4 == 0, v)), ("mmmu", v * 2), ("mmlu_pro", F.when(k.isin(5, 9), v)))])
    benches = F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))
    ident = F.concat(F.when(k % 6 == 0, "x-embed").when(k % 6 == 1, "x-vl").otherwise("x"), k.cast("string"))
    e = table(spark, d, "nation").select(ident.alias("eval_id"), F.lit("f").alias("family"), F.lit(None).cast("double").alias("size_b"), F.lit("unknown").alias("variant"), F.lit("web").alias("source"), benches.alias("benchmarks"))
    return evals.base_scores(e).select("eval_id", "q_base", F.col("n_metrics").cast("long").alias("n_metrics"))


@R.add("""SELECT (SELECT count(*) FROM customer) AS readme_rows, (SELECT count(*) FROM supplier) AS web_seed_rows, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS merged_eval_rows, (SELECT count(DISTINCT c_nationkey) FROM customer) AS readme_families,
  (SELECT count(*) FROM nation) + 1 AS family_count, (SELECT count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) AS eval_family_count, 1 + (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) AS missing_eval_family_count""")
def ingest_summary(spark, d):
    readme = table(spark, d, "customer").select(F.col("c_nationkey").alias("family"))
    seed = table(spark, d, "supplier").select(F.col("s_nationkey").alias("family"))
    catalog = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("family")).unionByName(spark.range(1).select(F.lit(999).alias("family")))
    return evals.ingest_summary(readme, seed, readme.unionByName(seed), catalog)


# ---- identity

@R.add(r"""WITH x AS (SELECT page_id, page_id % 3 = page_id % 2 AS named, regexp_extract(html, '<title>([^<]*)', 1) || ' go https://hub.example/o' || CAST(page_id % 9 AS varchar) || '/n' || CAST(length(html) % 7 AS varchar) || '/tree now org/F' || CAST(page_id % 2 AS varchar) || '-7b and docs/f1 a/readme.md' AS t FROM pages),
k AS (SELECT page_id, t, regexp_extract(t, '(https://[^ ]+)', 1) AS token, regexp_extract(t, 'hub.example/(o[0-9]/n[0-9])', 1) AS repo FROM x UNION ALL SELECT page_id, t, regexp_extract(t, '(org/F[0-9]-7b)', 1), regexp_extract(t, '(org/F[0-9]-7b)', 1) FROM x WHERE named),
p AS (SELECT *, strpos(t, token) - 1 AS pos, greatest(0, strpos(t, token) - 24) AS low FROM k)
SELECT page_id, repo, substr(t, low + 1, pos + length(token) + 23 - low) AS excerpt FROM p""")
def mentions(spark, d):
    """Links, and names that hold the family's, each with what stands around it; reserved owners and files go."""
    s = lambda c: c.cast("string")
    k = F.col("page_id")
    said = F.concat(
        F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(" go https://hub.example/o"), s(k % 9), F.lit("/n"), s(F.length("html") % 7), F.lit("/tree now org/F"), s(k % 2), F.lit("-7b and docs/f1 a/readme.md")
    )
    x = table(spark, d, "pages").select(s(k).alias("source"), F.concat(F.lit("f"), s(k % 3)).alias("family"), said.alias("t"), F.lit("page").alias("kind"))
    out = identity.mentions(x, "family", "t", "source", "kind", host="hub.example", around=23)
    return out.select(F.col("source").cast("long").alias("page_id"), "repo", "excerpt")


@R.add("SELECT c_nationkey % 7 AS family, count(*) AS n, CAST(count(DISTINCT c_mktsegment || CAST(c_custkey % 4 AS varchar)) AS integer) AS n_keys FROM customer GROUP BY 1")
def decision_keys(spark, d):
    """Targets of one family and tag have one key, whatever the order and repeats of its candidates; other tags have others."""
    tag = F.concat(F.lower("c_mktsegment"), F.lit("-"), (F.col("c_custkey") % 4).cast("string"), F.lit("b"))
    targets = table(spark, d, "customer").select((F.col("c_nationkey") % 7).cast("string").alias("family"), tag.alias("tag"))
    found = table(spark, d, "supplier").select((F.col("s_nationkey") % 7).cast("string").alias("family"), F.concat(F.lit("o/"), "s_name").alias("repo"), F.lit("s").alias("source"), F.lit("k").alias("kind"), F.lit("").alias("excerpt"))
    cards = table(spark, d, "supplier").select(F.concat(F.lit("o/"), "s_name").alias("repo"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("text"))
    keys = identity.decision_keys(targets, found, cards)
    return keys.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("decision_key").cast("int").alias("n_keys")).withColumn("family", F.col("family").cast("int"))


@R.add("""WITH r AS (SELECT l_suppkey, count(*) AS artifacts, min('f' || CAST(l_partkey % 5 AS varchar)) AS family FROM lineitem GROUP BY 1)
SELECT s_suppkey AS decision_key, s_name AS repo, coalesce(artifacts, 0) AS artifacts, coalesce(family, '') AS family FROM supplier LEFT JOIN r ON l_suppkey = s_suppkey WHERE s_suppkey % 4 IN (0, 1) ORDER BY artifacts DESC, s_suppkey LIMIT 50""")
def verify_plan(spark, d):
    k = F.col("s_suppkey")
    decisions = table(spark, d, "supplier").select(k.alias("decision_key"), F.col("s_name").alias("repo"), F.when(k % 4 == 3, "unresolved").otherwise("likely").alias("status"), F.when(k % 4 == 2, "semantic_verified").when(k % 4 == 1, "names").alias("method"))
    refs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("digest"), F.concat(F.lit("f"), (F.col("l_partkey") % 5).cast("string")).alias("family"), F.col("l_suppkey").alias("decision_key"))
    return evidence.verify_plan(decisions, refs, 50).select("decision_key", "repo", "artifacts", "family")


@R.add("""SELECT 'f' || CAST(s_suppkey % 3 AS varchar) AS family, s_suppkey AS decision_key, 'site:huggingface.co f' || CAST(s_suppkey % 3 AS varchar) || ' 7b' || CASE WHEN s_suppkey % 2 = 0 THEN ' chat' ELSE '' END || ' v2' AS query, s_suppkey % 11 AS digests
FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 2 = 0 OR s_suppkey % 5 <> 0 AND s_suppkey % 7 = 0 ORDER BY digests DESC, family, query, decision_key""")
def search_plan(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    family = F.concat(F.lit("f"), (k % 3).cast("string")).alias("family")
    queue = s.select(family, k.alias("decision_key"), F.when(k % 5 == 0, "fetch_cards").otherwise("review_or_search").alias("action"), (k % 11).alias("digests"))
    words = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    decisions = s.select(k.alias("decision_key"), F.when((k % 2 == 0) | (k % 7 == 0), "unresolved").otherwise("ambiguous").alias("status"), words("7b").alias("sizes"), F.when(k % 2 == 0, words("chat")).otherwise(words()).alias("modes"), words("v2", "7b").alias("qualifiers"))
    return evidence.search_plan(queue, decisions)


@R.add("""SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN greatest(60, floor(epoch(date_trunc('second', ts))) - epoch(TIMESTAMP '2024-01-15 00:00:00')) WHEN 1 THEN greatest(60, floor(value)) ELSE 300 END AS double) AS seconds FROM events""")
def retry_dates(spark, d):
    """A server's wish as an HTTP date, before or after now, as seconds, as neither, and none."""
    k = F.col("event_id") % 4
    date = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    wish = F.when(k == 0, date).when(k == 1, F.floor("value").cast("string")).when(k == 2, "when it is done")
    now = F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return table(spark, d, "events").select("event_id", identity.retry_seconds(F.lit("rate_limited"), wish, now).alias("seconds"))
