"""Index, query and publication of the catalog."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import capacity, text
from quarry.functions.numeric import round_even
from quarry.operators import catalog as ops
from quarry.operators import joins, publish, stats
from quarry.plans.roles import CATALOG, GPUS, Registry, catalog, gpus, r4, s4, table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

POINTS = ", ".join(map(str, tables.CTX_POINTS))
INDEX = f"""sized AS (
  SELECT *, weight_bytes + kv_per_token * ctx AS vram FROM (
    SELECT c.*, unnest(CASE WHEN len(list_filter([{POINTS}], lambda x: x <= ctx_max)) = 0 THEN [{tables.CTX_POINTS[0]}]
      ELSE list_filter([{POINTS}], lambda x: x <= ctx_max) END) AS ctx FROM catalog c)),
indexed AS (
  SELECT ref, gpu_id, ctx, vram,
    CASE WHEN vram <= memory * usable THEN 'full' WHEN weight_bytes <= memory * usable + 32e9 THEN 'partial' ELSE 'none' END AS fit,
    1.0 / (weight_bytes / (bandwidth * 1e9) + layers * per_layer + fixed) AS tps,
    bandwidth * 1e9 / weight_bytes AS ceiling, fp16_tflops * derate * 1e12 / (2 * params) AS prefill
  FROM sized CROSS JOIN gpus)"""


@R.add(f"WITH {CATALOG}, {GPUS}, {INDEX} SELECT ref, gpu_id, ctx, vram, fit, {s4('tps')} AS tps, {s4('ceiling')} AS ceiling, {s4('prefill')} AS prefill FROM indexed")
def index_cross_fit(spark, d):
    return ops.index(catalog(spark, d), gpus(spark, d)).withColumns({c: r4(c) for c in ("tps", "ceiling", "prefill")})


CTX_COLUMNS = ", ".join(f"max(CASE WHEN ctx = {p} THEN vram END) AS ctx_{p}" for p in tables.CTX_POINTS)


@R.add(f"WITH {CATALOG}, {GPUS}, {INDEX} SELECT ref, {CTX_COLUMNS} FROM sized GROUP BY ref")
def ctx_pivot(spark, d):
    sized = ops.with_contexts(catalog(spark, d)).withColumn("vram", F.col("weight_bytes") + F.col("kv_per_token") * F.col("ctx"))
    return ops.pivot_contexts(sized, "ref", "ctx", "vram")


@R.add(f"""WITH {GPUS}, own AS (SELECT gpu_id, bandwidth * 0.8 AS bw, 0.00002 AS layer FROM gpus WHERE region = 0),
shared AS (SELECT median(bw) AS bw, CAST(NULL AS double) AS layer FROM own)
SELECT g.gpu_id, {s4("coalesce(o.bw, s.bw, 50)")} AS bw, coalesce(o.layer, s.layer, 0.00001) * 100000 AS layer
FROM gpus g LEFT JOIN own o USING (gpu_id) CROSS JOIN shared s""")
def constants_coalesce(spark, d):
    g = gpus(spark, d)
    own = g.where("region = 0").select("gpu_id", (F.col("bandwidth") * 0.8).alias("bw"), F.lit(0.00002).alias("layer"))
    shared = own.agg(F.median("bw").alias("bw"), F.lit(None).cast("double").alias("layer"))
    out = ops.coalesce_constants(g, own, shared, ["bw", "layer"], {"bw": 50.0, "layer": 0.00001})
    return out.select("gpu_id", r4("bw").alias("bw"), (F.col("layer") * 100000).alias("layer"))


def _hints(parts, column):
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


# The driver's parts know no code or embedding words; these stand in for the hint lists.
ROLE_HINTS = {"code": ("bolt", "gear"), "embedding": ("ring",), "reasoning": ("widget",)}


def _role_signals(column: str):
    from quarry.functions.numeric import any_substring

    low = F.lower(column)
    return F.array_compact(F.array(*[F.when(any_substring(low, parts), F.lit(k)) for k, parts in ROLE_HINTS.items()]))


ROLE_SIGNALS = "list_filter([" + ", ".join(f"CASE WHEN {_hints(v, 'lower(label)')} THEN '{k}' END" for k, v in ROLE_HINTS.items()) + "], lambda x: x IS NOT NULL)"

QUERY = ops.FindQuery(ctx=4096, usecase="chat", allow_partial=True, as_of="2026-01-01", limit=18)
#: Scores that weren't measured (null) give way to the prior; without a date there is no decay and no recency.
VIEW = f"""g AS (SELECT * FROM gpus WHERE gpu_id = 7),
base AS (SELECT c.*, {ROLE_SIGNALS} AS signals, CASE WHEN CAST(ref AS bigint) % 3 = 0 THEN CAST(layers AS double) * 2 END AS q FROM catalog c),
a AS (SELECT b.*, CASE WHEN ctx_max >= 4096 THEN weight_bytes + kv_per_token * 4096 END AS vram, memory * usable AS usable_bytes,
  1.0 / (weight_bytes / (bandwidth * 1e9) + layers * per_layer + fixed) AS raw_speed,
  CASE WHEN pushed_at IS NOT NULL THEN greatest(0, DATE '2026-01-01' - pushed_at) END AS days FROM base b CROSS JOIN g),
b AS (SELECT *, (greatest(0, least(1, (log10(greatest(1e8, CAST(params AS double))) - 8) / 3)) * 0.72 + 0.67 * 0.28)
  * coalesce(exp(-0.6931471805599453 * (days / 365.25) / 1.1), 1) * 0.45 AS prior,
  CASE WHEN vram IS NULL THEN 'context' WHEN vram <= usable_bytes THEN 'full' WHEN weight_bytes <= usable_bytes + 32e9 THEN 'partial' ELSE 'none' END AS fit FROM a),
c AS (SELECT *, CASE WHEN q IS NULL THEN prior WHEN q > 100 THEN 1 WHEN q < 0 THEN 0 ELSE q / 100.0 END AS capability, greatest(0, least(1, log10(raw_speed + 1) / 2.4)) AS speed_score,
  coalesce(exp(-days / 365.0), 0) AS recency FROM b),
v AS (SELECT *, capability * 50 + speed_score * 14 + capability * 26 + CASE fit WHEN 'full' THEN 1 WHEN 'partial' THEN 0.3 ELSE 0 END * 18 + recency * 12
  - CASE WHEN fit = 'partial' THEN 16 WHEN fit IN ('none', 'context') THEN 100 ELSE 0 END AS score, coalesce(CAST(pushed_at AS varchar), '') AS pushed FROM c)"""


def _role_view(spark, d):
    third = F.when(F.col("ref").cast("long") % 3 == 0, F.col("layers").cast("double") * 2)
    base = catalog(spark, d).withColumns({"signals": _role_signals("label"), "q_file": third, "q_task": third, "arch": F.lit("any")})
    g = gpus(spark, d).where("gpu_id = 7").first()
    one = F.struct(*[F.lit(g[k]).alias(k) for k in ("memory", "usable", "bandwidth", "per_layer", "fixed")])
    return base, one


@R.add(f"""WITH {CATALOG}, {GPUS}, {VIEW}, w AS (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, pushed DESC, lower(ref), ref) AS n FROM v
  WHERE NOT list_contains(signals, 'embedding') AND fit IN ('full', 'partial'))
SELECT row_number() OVER (ORDER BY w.score DESC, pushed DESC, lower(ref), ref) AS rank, ref, family, fit, {s4('score')} AS score FROM w WHERE n = 1 ORDER BY w.score DESC, pushed DESC, lower(ref), ref LIMIT 18""")
def find_models(spark, d):
    base, g = _role_view(spark, d)
    return ops.find_models(base, g, QUERY).select("rank", "ref", "family", "fit", r4("score").alias("score"))


@R.add(f"""WITH {CATALOG}, {GPUS}, {VIEW}, w AS (
  SELECT *, row_number() OVER (ORDER BY raw_speed DESC, lower(ref), ref) AS rank FROM v WHERE fit IN ('full', 'partial'))
SELECT rank, ref, {s4('raw_speed')} AS speed FROM w WHERE rank BETWEEN 41 AND 80""")
def second_page(spark, d):
    """Explore mode: no family limit, the second 40 rows by speed."""
    base, g = _role_view(spark, d)
    q = replace(QUERY, mode="explore", sort="speed", limit=40, offset=40)
    return ops.find_models(base, g, q).select("rank", "ref", r4("raw_speed").alias("speed"))


SORT_SQL = {
    "recommended": "score DESC, pushed DESC,", "newest": "pushed DESC,", "name": "", "speed": "raw_speed DESC,",
    "vram": "vram ASC NULLS LAST,", "context": "ctx_max DESC,", "capability": "capability DESC,",
}
PAGES = " UNION ALL ".join(f"SELECT '{k}' AS sort, row_number() OVER (ORDER BY {o} lower(ref), ref) AS place, ref FROM v QUALIFY place <= 40" for k, o in SORT_SQL.items())


@R.add(f"WITH {CATALOG}, {GPUS}, {VIEW} {PAGES}")
def sort_modes(spark, d):
    """First page of each order: only its 40 rows are numbered."""
    base, g = _role_view(spark, d)
    rows = ops.view(base, g, QUERY)
    out = None
    for k in SORT_SQL:
        page = ops.first_page(rows, k).select("sort", "place", "ref")
        out = page if out is None else out.unionByName(page)
    return out


@R.add(f"WITH {CATALOG} SELECT ref, label FROM catalog WHERE contains(lower(concat_ws(' ', ref, family, label)), 'ring eco')")
def search_filter(spark, d):
    return catalog(spark, d).where(ops.search("  Ring ECO ", "ref", "family", "label")).select("ref", "label")


CLASS_SQL = "CASE WHEN p IS NULL OR p = 0 THEN 'unknown' " + " ".join(f"WHEN p < {int(m)} THEN '{n}'" for n, m in tables.SIZE_CLASSES) + " ELSE 'frontier' END"


@R.add(f"WITH {CATALOG}, x AS (SELECT CASE WHEN CAST(ref AS bigint) % 50 = 0 THEN 0 ELSE params * (CAST(ref AS bigint) % 600) END AS p FROM catalog) SELECT {CLASS_SQL} AS size_class, count(*) AS n FROM x GROUP BY 1")
def size_class(spark, d):
    key = F.col("ref").cast("long")
    p = F.when(key % 50 == 0, F.lit(0)).otherwise(F.col("params") * (key % 600))
    return stats.status_counts(catalog(spark, d).select(text.size_class(p).alias("size_class")), "size_class")


@R.add(f"""WITH {CATALOG}, x AS (SELECT ref, {ROLE_SIGNALS} AS signals FROM catalog)
SELECT ref, list_contains(signals, 'embedding') AS for_embedding, NOT list_contains(signals, 'embedding') AS for_chat, NOT list_contains(signals, 'embedding') AND CAST(ref AS bigint) % 2 = 0 AS for_vision, array_to_string(signals, ',') AS tags FROM x""")
def usecase_filter(spark, d):
    x = catalog(spark, d).select("ref", _role_signals("label").alias("signals"))
    vision = F.when(F.col("ref").cast("long") % 2 == 0, F.array_append("signals", F.lit("vision"))).otherwise(F.col("signals"))
    return x.select(
        "ref", ops.usecase_candidate("embedding", F.col("signals")).alias("for_embedding"), ops.usecase_candidate("chat", F.col("signals")).alias("for_chat"), ops.usecase_candidate("vision", vision).alias("for_vision"),
        F.array_join("signals", ",").alias("tags"),
    )


@R.add(f"WITH {CATALOG} SELECT DISTINCT 'quant' AS facet, quant AS value FROM catalog UNION ALL SELECT DISTINCT 'family', family FROM catalog UNION ALL SELECT DISTINCT 'layers', CAST(layers AS varchar) FROM catalog")
def facets(spark, d):
    """One pass: each row gives its values, distinct pairs stay."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in ("quant", "family", "layers")])
    return catalog(spark, d).select(F.inline(pairs)).distinct()


@R.add("""SELECT p_partkey, CASE WHEN n = 0 THEN '—' WHEN n >= 10000000000000 THEN CAST((n + 500000000000) // 1000000000000 AS varchar) || 'T'
  WHEN n >= 1000000000000 THEN CAST(((n + 50000000000) // 100000000000) // 10 AS varchar) || '.' || CAST(((n + 50000000000) // 100000000000) % 10 AS varchar) || 'T'
  WHEN n >= 10000000000 THEN CAST((n + 500000000) // 1000000000 AS varchar) || 'B'
  WHEN n >= 1000000000 THEN replace(CAST(((n + 50000000) // 100000000) // 10 AS varchar) || '.' || CAST(((n + 50000000) // 100000000) % 10 AS varchar), '.0', '') || 'B'
  ELSE CAST((n + 500000) // 1000000 AS varchar) || 'M' END AS label
FROM (SELECT p_partkey, CAST(floor(p_retailprice * 1000 + 0.5) AS bigint) * (p_partkey % 11) * (p_partkey % 13) * (CASE WHEN p_partkey % 5 = 0 THEN 100000 ELSE 1000 END) AS n FROM part)""")
def format_params(spark, d):
    key = F.col("p_partkey")
    n = F.floor(F.col("p_retailprice") * 1000 + 0.5) * (key % 11) * (key % 13) * F.when(key % 5 == 0, 100000).otherwise(1000)
    return table(spark, d, "part").select(key, text.format_params(n).alias("label"))


@R.add(f"SELECT o_orderkey, {s4('exp(-0.6931471805599453 * (greatest(0, DATE ' + chr(39) + '2002-01-01' + chr(39) + ' - CAST(o_orderdate AS date)) / 365.25) / 1.1)')} AS decay FROM orders")
def age_decay(spark, d):
    years = F.greatest(F.lit(0), F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date"))) / 365.25
    return table(spark, d, "orders").select("o_orderkey", r4(capacity.age_decay(years)).alias("decay"))


DOC_ORDER = "CASE WHEN lang = 'en' THEN 0 ELSE 1 END, n_chars, lower(source), doc_id"
HASHED = "x AS (SELECT *, sha256(coalesce(text, '')) AS digest FROM documents)"


def _hashed(spark, d):
    x = table(spark, d, "documents").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")
    return x.withColumn("newest", F.col("doc_id")), F.struct(F.when(F.col("lang") == "en", 0).otherwise(1), "n_chars", F.lower("source"), "doc_id")


@R.add(f"""WITH {HASHED}, k AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY {DOC_ORDER}) AS n, max(doc_id) OVER (PARTITION BY digest) AS newest, count(*) OVER (PARTITION BY digest) AS n_names FROM x)
SELECT digest, doc_id, source, newest, n_names FROM k WHERE n = 1""")
def dedup_canonical(spark, d):
    x, rank = _hashed(spark, d)
    return publish.canonical_rows(x, "digest", rank, "newest").select("digest", "doc_id", "source", "newest", "n_names")


@R.add(f"WITH {HASHED}, k AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY {DOC_ORDER}) AS n FROM x) SELECT digest, doc_id FROM k WHERE n > 1")
def alias_rows(spark, d):
    x, rank = _hashed(spark, d)
    return publish.alias_rows(x, "digest", "doc_id", rank)


@R.add("""WITH x AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest, text FROM documents)
SELECT x.doc_id, y.size FROM x JOIN (SELECT digest, max(length(coalesce(text, ''))) AS size FROM x GROUP BY digest) y USING (digest)""")
def digest_fanout(spark, d):
    """The costly part runs once a digest, on any one of its rows, and its result is joined to all."""
    x = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return joins.fan_out(x.select("doc_id", "digest"), x.groupBy("digest").agg(F.max("size").alias("size")), "digest").select("doc_id", "size")


@R.add("SELECT p_partkey, " + s4("CASE WHEN p_size % 9 = 0 THEN 0 ELSE greatest(0, least(1, log2(greatest(c, 2048) / 2048.0) / 6)) END") + " AS score FROM (SELECT *, p_size * 4000 AS c FROM part)")
def context_score(spark, d):
    ctx = F.when(F.col("p_size") % 9 == 0, 0).otherwise(F.col("p_size") * 4000)
    return table(spark, d, "part").select("p_partkey", r4(capacity.context_score(ctx)).alias("score"))


@R.add(f"""WITH {CATALOG} SELECT ref, CAST(round_even(kv_per_token * 0.37 * (CASE WHEN w > 0 AND w < ctx_max THEN w ELSE ctx_max END) + kv_per_token * 0.11 * ctx_max, 0) AS bigint) AS bytes
FROM (SELECT *, CASE WHEN layers % 2 = 0 THEN 4096 ELSE 0 END AS w FROM catalog)""")
def piecewise_growth(spark, d):
    window = F.when(F.col("layers") % 2 == 0, 4096).otherwise(0)
    grown = capacity.kv_bytes(F.col("ctx_max"), window, F.col("kv_per_token") * 0.37, F.col("kv_per_token") * 0.11)
    return catalog(spark, d).select("ref", round_even(grown).alias("bytes"))


PREFIXES = {"EC": 0.5, "ECON": 0.7, "ECONOMY": 0.8, "S": 0.3, "STAND": 0.6}


@R.add("SELECT p_partkey, CAST(CASE WHEN starts_with(k, 'ECONOMY') THEN 0.8 WHEN starts_with(k, 'STAND') THEN 0.6 WHEN starts_with(k, 'ECON') THEN 0.7 WHEN starts_with(k, 'EC') THEN 0.5 WHEN starts_with(k, 'S') THEN 0.3 ELSE 0.9 END AS double) AS factor FROM (SELECT p_partkey, upper(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE left(p_type, CAST(p_partkey % 7 AS integer)) || '_' || p_name END) AS k FROM part)")
def prefix_lookup(spark, d):
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, F.col("p_type")).otherwise(F.concat(F.expr("left(p_type, cast(p_partkey % 7 as int))"), F.lit("_"), F.col("p_name")))
    return table(spark, d, "part").select(key, capacity.quant_factor(name, PREFIXES, 0.9).alias("factor"))


@R.add("SELECT c_custkey, coalesce(b.name, a.name, '?') AS name, CASE WHEN b.name IS NOT NULL THEN 'shipped' WHEN a.name IS NOT NULL THEN 'home' END AS origin FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS name FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.o_custkey = c_custkey LEFT JOIN (SELECT n_nationkey, n_name AS name FROM nation WHERE n_regionkey > 1) a ON a.n_nationkey = c_nationkey")
def precedence_coalesce(spark, d):
    shipped = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("name"))
    home = table(spark, d, "nation").where("n_regionkey > 1").select("n_nationkey", F.col("n_name").alias("name"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    out = joins.precedence(c.withColumn("o_custkey", F.col("c_custkey")).withColumn("n_nationkey", F.col("c_nationkey")), [("shipped", shipped, "o_custkey", "name"), ("home", home, "n_nationkey", "name")], "name", "origin")
    return out.select("c_custkey", F.coalesce("name", F.lit("?")).alias("name"), "origin")
