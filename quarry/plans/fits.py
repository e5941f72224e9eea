"""Measurements: selection, medians, least squares, holdout, gates, progress."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import fitting, joins, stats
from quarry.sources import files
from quarry.plans.roles import MEASUREMENTS, Registry, measurements, r4, s4, table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


@R.add(f"WITH {MEASUREMENTS} SELECT model, count(*) AS n, max(tps) AS best FROM (SELECT *, max(CASE WHEN label = 'O' AND ctx > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY model) AS main FROM measurements) WHERE (label = 'O' AND ctx > 3) OR main = 0 GROUP BY 1")
def label_fallback(spark, d):
    m = measurements(spark, d).select("model", "label", "ctx", "tps")
    return joins.main_rows(m, ["model"], (F.col("label") == "O") & (F.col("ctx") > 3), {"best": F.max("tps")})


@R.add(f"""WITH {MEASUREMENTS}, x AS (SELECT m.* FROM measurements m LEFT JOIN (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN false WHEN p_size % 3 = 1 THEN true END AS on_gpu FROM part) p ON p.p_partkey = m.model
  WHERE m.flagged IS NOT TRUE AND p.on_gpu IS NOT FALSE)
SELECT model, ctx, price, run FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ctx, price, run, host, seen, quantity) AS n FROM x) WHERE n = 1""")
def decode_points(spark, d):
    kept = table(spark, d, "part").select(F.col("p_partkey").alias("model"), F.when(F.col("p_size") % 3 == 0, False).when(F.col("p_size") % 3 == 1, True).alias("on_gpu"))
    x = measurements(spark, d).where("NOT (flagged <=> true)").join(kept, "model", "left").where("NOT (on_gpu <=> false)")
    order = [F.col(c) for c in ("ctx", "price", "run", "host", "seen", "quantity")]
    return joins.first_by(x, ["model"], order).select("model", "ctx", "price", "run")


@R.add(f"WITH {MEASUREMENTS} SELECT label, {s4('avg(CASE WHEN flagged IS NOT TRUE THEN 1.0 ELSE 0.0 END)')} AS share, count(*) AS n FROM measurements GROUP BY 1")
def unflagged_share(spark, d):
    return stats.share(measurements(spark, d), ["label"], ~F.col("flagged").eqNullSafe(True)).withColumn("share", r4("share"))


@R.add("SELECT user_id, count(*) FILTER (event_type = 'signup') AS models, count(*) FILTER (event_type = 'purchase' AND value > 20) AS vram FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'signup') > 0 AND count(*) FILTER (event_type = 'purchase' AND value > 20) > 0")
def completed_groups(spark, d):
    kind = F.col("event_type")
    return stats.completed(table(spark, d, "events"), "user_id", {"models": kind == "signup", "vram": (kind == "purchase") & (F.col("value") > 20)})


@R.add("""SELECT count(*) AS n_rows, count(*) FILTER (n_chars > 500) AS n_ok, count(DISTINCT sha256(coalesce(text, ''))) AS n_digests,
  floor((100.0 * count(*) FILTER (n_chars > 500) / greatest(1, count(*))) * CAST(10 AS double) + 0.5) / 10 AS ok_pct,
  floor((100.0 * count(DISTINCT sha256(coalesce(text, ''))) / greatest(1, count(*))) * CAST(10 AS double) + 0.5) / 10 AS unique_pct FROM documents""")
def crawl_summary(spark, d):
    x = table(spark, d, "documents").select("n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return stats.crawl_summary(x, F.col("n_chars") > 500, "digest")


@R.add("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return stats.status_counts(table(spark, d, "orders"), "o_orderstatus")


@R.add(f"SELECT user_id, min(value) AS low, max(value) AS high, {s4('min(value) / max(value)')} AS ratio, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS labels, min(value) / max(value) < 0.001 AS flagged FROM events GROUP BY 1")
def clock_summary(spark, d):
    return stats.spread_summary(table(spark, d, "events"), "user_id", "value", "event_type", 0.001).withColumn("ratio", r4("ratio"))


@R.add(f"SELECT l_partkey, {s4('median(l_extendedprice / l_quantity)')} AS prefill, {s4('median(l_discount / nullif(l_tax, 0))')} AS decode, count(*) AS n FROM lineitem GROUP BY 1")
def run_medians(spark, d):
    x = table(spark, d, "lineitem").select("l_partkey", F.try_divide("l_extendedprice", "l_quantity").alias("p"), F.try_divide(F.col("l_discount"), F.nullif(F.col("l_tax"), F.lit(0.0))).alias("d"))
    n = x.groupBy("l_partkey").agg(F.count("*").alias("n"))
    prefill, decode = (stats.medians(x, ["l_partkey"], c, o).select(F.col("l_partkey").alias(f"_{c}"), o) for c, o in (("p", "prefill"), ("d", "decode")))
    out = n.join(prefill, F.col("l_partkey").eqNullSafe(F.col("_p")), "left").join(decode, F.col("l_partkey").eqNullSafe(F.col("_d")), "left")
    return out.select("l_partkey", r4("prefill").alias("prefill"), r4("decode").alias("decode"), "n")


@R.add(f"SELECT p_type, {s4('median(l_extendedprice / (l_quantity * p_retailprice))')} AS factor FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def quant_factor_median(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.select("p_type", (F.col("l_extendedprice") / (F.col("l_quantity") * F.col("p_retailprice"))).alias("ratio"))
    return stats.medians(x, ["p_type"], "ratio", "factor").select("p_type", r4("factor").alias("factor"))


NULL_KEYS = "x AS (SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS g, l_linenumber AS line, l_extendedprice / l_quantity AS v, l_quantity AS x1, l_discount AS x2, l_extendedprice AS y FROM lineitem)"


def _null_keys(spark, d):
    """One group's key is null."""
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("g"), F.col("l_linenumber").alias("line"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"),
        F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_extendedprice").alias("y"),
    )


@R.add(f"""WITH {NULL_KEYS}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM x)
SELECT g, {s4('median(v)')} AS middle, {s4("max(v) FILTER (i = CAST(round_even(n * CAST(0.95 AS double) - CAST(0.95 AS double), 0) AS bigint))")} AS p95, {s4('max(v)')} AS most, count(*) AS n FROM r GROUP BY 1""")
def null_key_ranks(spark, d):
    x = _null_keys(spark, d)
    errors = stats.error_stats(x, ["g"], "v").select("g", r4("p95_error").alias("p95"), r4("max_error").alias("most"), "n")
    middle = stats.medians(x, ["g"], "v", "middle").select(F.col("g").alias("_g"), r4("middle").alias("middle"))
    return errors.join(middle, F.col("g").eqNullSafe(F.col("_g"))).drop("_g")


@R.add(f"""WITH {NULL_KEYS}, c AS (SELECT g, x1 - avg(x1) OVER w AS a, x2 - avg(x2) OVER w AS b, y - avg(y) OVER w AS v FROM x WINDOW w AS (PARTITION BY g)),
m AS (SELECT g, count(*) AS n, sum(a*a) AS s11, sum(a*b) AS s12, sum(b*b) AS s22, sum(a*v) AS s1y, sum(b*v) AS s2y FROM c GROUP BY g),
h AS (SELECT g, count(*) AS n_main, max(v) AS best FROM (SELECT *, max(CASE WHEN line > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS has FROM x) WHERE line > 6 OR has = 0 GROUP BY 1)
SELECT m.g, n, {s4('(s1y*s22 - s2y*s12) / (s11*s22 - s12*s12)')} AS b1, n_main, {s4('best')} AS best FROM m JOIN h ON m.g IS NOT DISTINCT FROM h.g""")
def null_key_fits(spark, d):
    x = _null_keys(spark, d)
    fit = fitting.ols2(x, ["g"], "x1", "x2", "y").select("g", "n", r4("b1").alias("b1"))
    main = joins.main_rows(x, ["g"], F.col("line") > 6, {"best": F.max("v")}).select(F.col("g").alias("_g"), F.col("n").alias("n_main"), r4("best").alias("best"))
    return fit.join(main, F.col("g").eqNullSafe(F.col("_g"))).drop("_g")


@R.add("SELECT digest, coalesce(median(n_chars - CAST(500 AS double)), 0) AS offset, count(*) AS n FROM (SELECT CASE WHEN length(text) > 0 THEN sha256(text) END AS digest, n_chars FROM documents) WHERE digest IS NOT NULL GROUP BY 1")
def digest_offsets(spark, d):
    """Texts that are null or empty have no digest."""
    x = table(spark, d, "documents").select(F.when(F.length("text") > 0, F.sha2("text", 256)).alias("digest"), "n_chars")
    return fitting.median_offsets(x, "digest", F.col("n_chars") - 500.0)


@R.add(f"""WITH e AS (SELECT l_suppkey, abs(l_extendedprice / l_quantity - 1500) / 1500 AS e FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY e) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM e)
SELECT l_suppkey, {s4('max(e)')} AS max_error, {s4("max(e) FILTER (i = CAST(round_even(n * CAST(0.95 AS double) - CAST(0.95 AS double), 0) AS bigint))")} AS p95_error, {s4('avg(e)')} AS mean_error, count(*) AS n FROM r GROUP BY 1""")
def err_stats(spark, d):
    x = table(spark, d, "lineitem").select("l_suppkey", (F.abs(F.col("l_extendedprice") / F.col("l_quantity") - 1500) / 1500).alias("e"))
    return stats.error_stats(x, ["l_suppkey"], "e").withColumns({c: r4(c) for c in ("max_error", "p95_error", "mean_error")})


OLS2 = """c AS (SELECT g, x1 - avg(x1) OVER w AS a, x2 - avg(x2) OVER w AS b, y - avg(y) OVER w AS v, avg(x1) OVER w AS m1, avg(x2) OVER w AS m2, avg(y) OVER w AS my FROM x WINDOW w AS (PARTITION BY g)),
m AS (SELECT g, count(*) AS n, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, sum(a*a) AS s11, sum(a*b) AS s12, sum(b*b) AS s22, sum(a*v) AS s1y, sum(b*v) AS s2y, sum(v*v) AS syy FROM c GROUP BY g),
f AS (SELECT g, n, (s1y*s22 - s2y*s12) / (s11*s22 - s12*s12) AS b1, (s2y*s11 - s1y*s12) / (s11*s22 - s12*s12) AS b2, s1y, s2y, syy, m1, m2, my FROM m)"""


@R.add(f"""WITH x AS (SELECT l_suppkey AS g, l_quantity AS x1, l_discount AS x2, l_extendedprice AS y FROM lineitem), {OLS2}
SELECT g, n, {s4('my - b1*m1 - b2*m2')} AS b0, {s4('b1')} AS b1, {s4('b2')} AS b2, {s4('(b1*s1y + b2*s2y) / syy')} AS r2 FROM f""")
def decode_fit(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_extendedprice").alias("y"))
    return fitting.ols2(x, ["g"], "x1", "x2", "y").withColumns({c: r4(c) for c in ("b0", "b1", "b2", "r2")})


@R.add(f"SELECT l_suppkey AS g, {s4('regr_slope(l_extendedprice - 1500 * l_quantity, l_tax)')} AS slope, {s4('regr_intercept(l_extendedprice - 1500 * l_quantity, l_tax)')} AS intercept, {s4('regr_r2(l_extendedprice - 1500 * l_quantity, l_tax)')} AS r2, count(*) AS n FROM lineitem GROUP BY 1")
def anchored_fit(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), "l_quantity", "l_tax", "l_extendedprice")
    return fitting.anchored(x, ["g"], F.col("l_quantity") * 1500, "l_tax", "l_extendedprice").withColumns({c: r4(c) for c in ("slope", "intercept", "r2")})


@R.add(f"""WITH x AS (SELECT l_returnflag AS g, CAST(l_linenumber AS double) AS x1, l_extendedprice AS x2, l_quantity AS y FROM lineitem), {OLS2}
SELECT g, n, {s4('my - b1*m1 - b2*m2')} AS b0, {s4('b1')} AS b1, {s4('b2 * 1000')} AS b2, {s4('(b1*s1y + b2*s2y) / syy')} AS r2 FROM f""")
def baseline_fit(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linenumber").cast("double").alias("x1"), F.col("l_extendedprice").alias("x2"), F.col("l_quantity").alias("y"))
    return fitting.ols2(x, ["g"], "x1", "x2", "y").withColumns({"b0": r4("b0"), "b1": r4("b1"), "b2": r4(F.col("b2") * 1000), "r2": r4("r2")})


@R.add(f"""WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
c AS (SELECT l_suppkey AS g, l_quantity - mx AS u, l_extendedprice - my AS v, mx, my FROM lineitem CROSS JOIN m),
o AS (SELECT g, count(*) AS n, sum(u) AS su, sum(v) AS sv, sum(u*u) AS suu, sum(u*v) AS suv, any_value(mx) AS mx, any_value(my) AS my FROM c GROUP BY g),
t AS (SELECT g, sum(n) OVER () - n AS n, sum(su) OVER () - su AS su, sum(sv) OVER () - sv AS sv, sum(suu) OVER () - suu AS suu, sum(suv) OVER () - suv AS suv, mx, my FROM o),
f AS (SELECT *, (n*suv - su*sv) / (n*suu - su*su) AS slope FROM t)
SELECT g, CAST(n AS bigint) AS n_train, floor(slope * 1000 + 0.5) / 1000 AS slope, floor(((sv - slope*su) / n + my - slope*mx) * 1000 + 0.5) / 1000 AS intercept FROM f""")
def group_holdout(spark, d):
    from quarry.functions.numeric import round_half_up

    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), "l_quantity", "l_extendedprice")
    return fitting.group_holdout(x, "g", "l_quantity", "l_extendedprice").withColumns({c: round_half_up(F.col(c), 3) for c in ("slope", "intercept")})


@R.add(f"""SELECT p, run, ctx, {s4('r - f')} AS error FROM (SELECT l_partkey AS p, l_orderkey AS run, l_linenumber AS ctx, l_extendedprice / l_quantity AS r,
  first_value(l_extendedprice / l_quantity) OVER w AS f, row_number() OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey, l_shipdate, l_extendedprice, l_quantity)) WHERE n > 1""")
def forward_context(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("ctx"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("r"), "l_shipdate", "l_extendedprice", "l_quantity")
    out = fitting.forward_offsets(x, "p", ["ctx", "run", "l_shipdate", "l_extendedprice", "l_quantity"], "r")
    return out.select("p", "run", "ctx", r4("error").alias("error"))


@R.add("""SELECT l_returnflag AS g, count(*) >= 1000 AS enough, bool_and(l_quantity BETWEEN 1 AND 50) AS in_range, CASE WHEN l_returnflag = 'N' THEN NULL ELSE avg(l_discount) < 0.06 END AS accurate,
  count(*) FILTER (l_tax > 0.07) AS outliers FROM lineitem GROUP BY 1""")
def threshold_gates(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"))
    return x.agg(
        (F.count("*") >= 1000).alias("enough"), F.bool_and(F.col("l_quantity").between(1, 50)).alias("in_range"), (F.avg("l_discount") < 0.06).alias("accurate"), F.count_if(F.col("l_tax") > 0.07).alias("outliers")
    ).withColumn("accurate", stats.tri_state(F.col("g") != "N", F.col("accurate")))


@R.add("""WITH r AS (SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS bigint) AS done, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)
SELECT o_orderkey, done, total, floor((100.0 * done / greatest(1, total)) * CAST(10 AS double) + 0.5) / 10 AS pct FROM r""")
def progress_running(spark, d):
    from quarry.functions.numeric import percent_of

    w = Window.partitionBy("o_custkey")
    done = F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).cast("long")
    return table(spark, d, "orders").select("o_orderkey", done.alias("done"), F.count("*").over(w).alias("total")).withColumn("pct", percent_of(F.col("done"), F.col("total")))


GROUP_NAMES = ["per_layer_token_embd.w", "token_embd.w", "v.blk", "mm.0", "output.w", "blk.1.ffn_up_exps.w", "blk.1.attn_q.w", "blk.1.ffn_up.w", "rope"]
NAMED = f"[{', '.join(map(repr, GROUP_NAMES))}][CAST(turn % {len(GROUP_NAMES)} AS integer) + 1]"
GROUP_CASE = "CASE turn % 9 WHEN 0 THEN 'ple' WHEN 1 THEN 'token_embd' WHEN 2 THEN 'vision' WHEN 3 THEN 'vision' WHEN 4 THEN 'output' WHEN 5 THEN 'ffn_expert' WHEN 6 THEN 'attn' WHEN 7 THEN 'ffn_dense' ELSE 'other' END"


def _tensors(spark, d):
    """Conversations as files: a turn is a tensor that begins where the turns before it end; 10 bytes of header."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    w = Window.partitionBy("conv_id")
    at = F.sum(n).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)) - n
    name = F.element_at(F.array(*map(F.lit, GROUP_NAMES)), (F.col("turn") % len(GROUP_NAMES) + 1).cast("int"))
    t = table(spark, d, "conversations").select("conv_id", "turn", at.alias("at"), F.sum(n).over(w).alias("total"), name.alias("name"))
    dims = F.array(F.lit(2).cast("long"), F.col("turn").cast("long") + 1)
    each = F.struct(F.col("turn"), F.concat("name", F.lit("#"), F.col("turn").cast("string")).alias("name"), dims.alias("dims"), F.lit(0).alias("kind"), F.col("at").alias("offset"))
    g = t.groupBy("conv_id", "total").agg(F.array_sort(F.collect_list(each)).alias("x"))
    tensors = F.transform("x", lambda x: F.struct(x["name"].alias("name"), x["dims"].alias("dims"), x["kind"].alias("kind"), x["offset"].alias("offset")))
    return g.select(F.col("conv_id").cast("string").alias("path"), (F.col("total") + 10).alias("length"), F.lit(10).cast("long").alias("data_start"), tensors.alias("tensors"))


SIZED = """s AS (SELECT conv_id, turn, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(coalesce(text, '')) AS pos, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id) AS total FROM conversations),
z AS (SELECT conv_id, turn, CAST(greatest(0, lead(pos, 1, total) OVER (PARTITION BY conv_id ORDER BY pos, turn) - pos) AS bigint) AS bytes FROM s)"""


@R.add(f"WITH {SIZED} SELECT CAST(conv_id AS varchar) AS path, {GROUP_CASE} AS \"group\", CAST(sum(bytes) AS bigint) AS bytes, CAST(sum(2 * (turn + 1)) AS bigint) AS params, count(*) AS n FROM z GROUP BY 1, 2")
def conditional_sums(spark, d):
    return files.group_bytes(files.tensor_sizes(_tensors(spark, d)))


@R.add(f"WITH {SIZED} SELECT CAST(conv_id AS varchar) AS path, {NAMED} || '#' || CAST(turn AS varchar) AS name, bytes FROM z")
def lead_diff(spark, d):
    return files.tensor_sizes(_tensors(spark, d)).select("path", "name", "bytes")


@R.add("""SELECT user_id, event_type, CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' THEN 'error' WHEN age > 172800 THEN 'dead' WHEN age > 43200 THEN 'stall' ELSE 'running' END AS status
FROM (SELECT user_id, event_type, epoch(TIMESTAMP '2024-01-31 00:00:00' - ts) AS age, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def stall_classify(spark, d):
    from quarry.streaming.watch import classify

    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")
    return last.select("user_id", "event_type", classify(F.col("event_type"), F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 172800, 43200).alias("status"))
