"""Lookups, anti and semi joins, comparisons and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import squeeze
from quarry.operators import evidence, identity, joins, stats
from quarry.sources import files, manifests
from quarry.plans.roles import MEASUREMENTS, Registry, measurements, r4, s4, table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


@R.add("""SELECT o_orderkey, coalesce(a.c_name, b.n_name, c.n_name) AS found FROM orders
LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 5) a ON a.c_custkey = o_custkey
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) b ON b.n_nationkey = o_custkey % 25
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 2) c ON c.n_nationkey = o_orderkey % 25""")
def fallback_key_lookup(spark, d):
    nation = table(spark, d, "nation")
    names = (
        table(spark, d, "customer").where("c_nationkey < 5").select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_name").alias("name"))
        .unionByName(nation.where("n_regionkey = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.col("n_name").alias("name")))
        .unionByName(nation.where("n_regionkey = 2").select(F.concat(F.lit("o"), "n_nationkey").alias("key"), F.col("n_name").alias("name")))
    )
    keys = [F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("n"), F.col("o_custkey") % 25), F.concat(F.lit("o"), F.col("o_orderkey") % 25)]
    return joins.fallback_lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), keys, names, "key", "name", "found").select("o_orderkey", "found")


@R.add("""WITH n AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name FROM part),
t AS (SELECT DISTINCT regexp_replace(lower(x), '[^a-z0-9]', '', 'g') AS k, upper(x) AS v FROM (SELECT unnest(['ring', 'red ring', 'small', 'bolt', 'blue bolt xl', 'red']) AS x))
SELECT p_partkey, arg_max(v, {'s': name = k, 'l': length(k), 'k': k}) AS hit FROM n LEFT JOIN t ON contains(name, k) OR contains(k, name) GROUP BY p_partkey""")
def longest_substring_match(spark, d):
    words = spark.createDataFrame([(w, w.upper()) for w in ("ring", "red ring", "small", "bolt", "blue bolt xl", "red")], "word string, hit string")
    names = table(spark, d, "part").select("p_partkey", squeeze(F.col("p_name")).alias("name"))
    return joins.longest_match(names, "name", words.select(squeeze(F.col("word")).alias("key"), "hit"), "key", "hit").select("p_partkey", "hit")


@R.add("""WITH e AS (SELECT p_partkey, unnest(range(3)) AS pos FROM part), k AS (SELECT p_partkey, pos, (p_partkey + pos * 7) % 400 AS name FROM e),
s AS (SELECT s_suppkey, s_acctbal FROM supplier), h AS (SELECT p_partkey, pos, name, s_acctbal, row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS n FROM k JOIN s ON s_suppkey = name)
SELECT p_partkey, CAST(pos AS integer) AS pos, name AS s_suppkey, s_acctbal FROM h WHERE n = 1""")
def alias_lookup(spark, d):
    names = F.array(*[(F.col("p_partkey") + p * 7) % 400 for p in range(3)])
    parts = table(spark, d, "part").select("p_partkey", names.alias("names"))
    return joins.ordered_alias_lookup(parts, "p_partkey", "names", table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")


@R.add("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')")
def semi_join_families(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.present_in(table(spark, d, "customer"), o, ["c_custkey"]).select("c_custkey", "c_name")


@R.add("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def resume_anti(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.missing_from(table(spark, d, "orders"), done, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@R.add("SELECT n_name FROM nation n WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s_acctbal > 5000)")
def missing_families_anti(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return joins.missing_from(table(spark, d, "nation"), rich, ["n_nationkey"]).select("n_name")


@R.add("""WITH b AS (SELECT p_partkey * 3 + unnest(range(3)) AS blob, p_size FROM part), u AS (SELECT blob % 5000 AS blob, count(DISTINCT p_size) > 1 AS conflict, max(p_size) AS size FROM b GROUP BY 1)
SELECT blob, conflict, size FROM u WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = blob)""")
def missing_blobs_anti(spark, d):
    blobs = table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select(((F.col("p_partkey") * 3 + F.col("k")) % 5000).alias("blob"), "p_size")
    unique = manifests.blobs(blobs.withColumnRenamed("p_size", "size"), "blob", "size")
    return joins.missing_from(unique, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("blob")), ["blob"])


@R.add("SELECT l_orderkey, bool_and(l_quantity > 5) AS ready FROM lineitem GROUP BY 1")
def all_present_bool_and(spark, d):
    return stats.all_true(table(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity") > 5, "ready")


LAST = f"""{MEASUREMENTS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, ctx, label ORDER BY seen DESC, run DESC, host DESC, price DESC, quantity DESC, discount DESC, tax DESC) AS n
  FROM measurements) WHERE n = 1)"""
LAST_ORDER = ["seen", "run", "host", "price", "quantity", "discount", "tax"]


@R.add(f"WITH {LAST} SELECT a.model, a.ctx, {s4('a.tps / b.tps')} AS ratio FROM last a JOIN last b ON a.model = b.model AND a.ctx = b.ctx WHERE a.label = 'O' AND b.label = 'F'")
def self_join_ratio(spark, d):
    last = joins.last_write_wins(measurements(spark, d), ["model", "ctx", "label"], LAST_ORDER)
    a = last.where("label = 'O'").select("model", "ctx", F.col("tps").alias("a"))
    b = last.where("label = 'F'").select("model", "ctx", F.col("tps").alias("b"))
    return a.join(b, ["model", "ctx"]).select("model", "ctx", r4(F.try_divide("a", "b")).alias("ratio"))


@R.add("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1""")
def last_write_wins(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return joins.last_write_wins(x, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).drop("l_shipdate")


@R.add("""WITH x AS (SELECT p_partkey, p_size % 25 AS block, p_size AS size FROM part), y AS (SELECT s_suppkey, s_nationkey AS block, s_acctbal / 200 AS size, s_suppkey % 3 AS kind FROM supplier),
j AS (SELECT p_partkey, s_suppkey, abs(x.size - y.size) + CASE kind WHEN 0 THEN 0 WHEN 1 THEN 0.5 ELSE 2 END AS dist, abs(x.size - y.size) AS raw, kind FROM x JOIN y USING (block)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY dist, raw, kind, s_suppkey) AS n FROM j)
SELECT p_partkey, s_suppkey, floor(dist * 10000 + 0.5) / 10000 AS distance FROM r WHERE n = 1 AND dist <= 8""")
def nearest_match(spark, d):
    x = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 25).alias("block"), F.col("p_size").cast("double").alias("x"))
    y = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("block"), (F.col("s_acctbal") / 200).alias("y"), (F.col("s_suppkey") % 3).alias("kind"))
    off = F.when(F.col("kind") == 0, 0.0).when(F.col("kind") == 1, 0.5).otherwise(2.0)
    hit = joins.nearest_value(x, y, "block", "p_partkey", "x", "y", "kind", off, ["s_suppkey"], ["s_suppkey"])
    return hit.where("distance <= 8").withColumn("distance", r4("distance"))


@R.add("""WITH a AS (SELECT c_nationkey AS k, CASE WHEN count(*) % 4 = 0 THEN NULL ELSE count(*) END AS v FROM customer WHERE c_nationkey < 20 GROUP BY 1),
b AS (SELECT s_nationkey + 2 AS k, CASE WHEN count(*) % 4 = 0 THEN NULL ELSE count(*) * 15 END AS v FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' WHEN a.v IS NULL AND b.v IS NULL THEN 'both_null' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS category
FROM a FULL JOIN b ON a.k = b.k""")
def compare_reports(spark, d):
    v = F.when(F.count("*") % 4 != 0, F.count("*"))
    a = table(spark, d, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(v.alias("v"))
    b = table(spark, d, "supplier").groupBy((F.col("s_nationkey") + 2).alias("k")).agg((v * 15).alias("v"))
    return joins.compare(a, b, "k", "v")


@R.add("""WITH u AS (SELECT c_custkey AS k, c_name AS v, 0 AS p FROM customer UNION ALL SELECT s_suppkey * 2, s_name, 1 FROM supplier UNION ALL SELECT s_suppkey * 10, 'top ' || s_name, 2 FROM supplier)
SELECT k, v, p AS priority FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, v DESC) AS n FROM u) WHERE n = 1""")
def priority_union(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    parts = [c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), s.select((F.col("s_suppkey") * 2).alias("k"), F.col("s_name").alias("v")), s.select((F.col("s_suppkey") * 10).alias("k"), F.concat(F.lit("top "), "s_name").alias("v"))]
    return joins.priority_union(parts, "k", "v")


@R.add("""WITH x AS (SELECT source AS k, lang, max(n_chars) AS v, max(CASE WHEN quality = 1 THEN n_chars END) AS w FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
y AS (SELECT k, lang, coalesce(w, v) AS v, w IS NOT NULL AS good FROM x)
SELECT k, max(v) FILTER (lang = 'en') AS en, max(v) FILTER (lang = 'fr') AS fr, max(v) FILTER (lang = 'de') AS de, max(v) FILTER (lang = 'es') AS es, CASE WHEN bool_or(good) THEN 'curated' ELSE 'base' END AS origin FROM y GROUP BY 1""")
def merge_evals(spark, d):
    """The largest of all documents of a source and language, unless one of good quality says otherwise."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    by = docs.groupBy("source", "lang").agg(F.max("n_chars").cast("double").alias("v"), F.max(F.when(F.col("quality") == 1, F.col("n_chars"))).cast("double").alias("w"))

    def maps(value):
        known = by.where(F.col(value).isNotNull())
        return known.groupBy(F.col("source").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("lang", value))).alias("items"))

    base, good = maps("v").withColumn("origin", F.lit("base")), maps("w").withColumn("origin", F.lit("curated"))
    out = joins.merge_maps(base, good, "k", "items", "origin")
    return out.select("k", *[F.element_at("items", x).cast("long").alias(x) for x in ("en", "fr", "de", "es")], "origin")


@R.add("SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-20 00:00:00' THEN 'hit' ELSE 'miss' END AS cache FROM (SELECT *, ts + INTERVAL 7 DAY AS until FROM events)")
def ttl_cache_split(spark, d):
    """fetched_at + 7 days against a fixed now: hits keep their copy, misses are fetched."""
    hits, misses = files.split_fresh(table(spark, d, "events").select("event_id", "ts"), "ts", 7 * 86400, F.lit("2024-01-27 00:00:00").cast("timestamp_ntz"))
    return hits.select("event_id", F.lit("hit").alias("cache")).unionByName(misses.select("event_id", F.lit("miss").alias("cache")))


@R.add("""WITH q AS (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS digests, list_sort(list(DISTINCT 'r' || CAST(l_suppkey % 40 AS varchar))) AS repos FROM lineitem GROUP BY 1),
e AS (SELECT unnest(repos) AS repo, digests FROM q) SELECT repo, CAST(sum(digests) AS bigint) AS digests FROM e GROUP BY 1 ORDER BY digests DESC, repo LIMIT 25""")
def fetch_plan(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_partkey")
    repo = F.concat(F.lit("r"), (F.col("l_suppkey") % 40).cast("string"))
    queue = x.agg(F.count_distinct("l_suppkey").alias("digests"), F.array_sort(F.collect_set(repo)).alias("repos")).withColumn("action", F.lit("fetch_cards"))
    return evidence.fetch_plan(queue, 25)


@R.add("SELECT o_custkey, o_orderkey, CAST(n AS integer) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def topk_per_group(spark, d):
    x = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return joins.first_rows(x, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).drop("o_totalprice")


@R.add("""SELECT source, string_agg(DISTINCT lang, '|' ORDER BY lang) AS langs, string_agg(DISTINCT CAST(n_chars % 7 AS varchar), '|' ORDER BY CAST(n_chars % 7 AS varchar)) AS kinds, count(*) AS n FROM documents GROUP BY 1""")
def inventory_sets(spark, d):
    return stats.inventory(table(spark, d, "documents").withColumn("kind", F.col("n_chars") % 7), "source", {"lang": "langs", "kind": "kinds"})


@R.add("""WITH x AS (SELECT source, lang, CAST(n_chars % 7 AS varchar) AS kind, '{"a":' || CAST(n_chars % 3 AS varchar) || ',"b":"' || lang || '"}' AS pair FROM documents)
SELECT source, CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(kind) = 0 THEN 'kind' ELSE 'pair' END AS field, CASE WHEN grouping(lang) = 0 THEN '"' || lang || '"' WHEN grouping(kind) = 0 THEN kind ELSE pair END AS value, count(*) AS n
FROM x GROUP BY GROUPING SETS ((source, lang), (source, kind), (source, pair))""")
def inventory_members(spark, d):
    """Members of three sets a source, one of them of structs, as rows from one scan."""
    n = F.col("n_chars")
    docs = table(spark, d, "documents").select("source", "lang", (n % 7).alias("kind"), F.struct(F.col("lang").alias("b"), (n % 3).alias("a")).alias("pair"))
    return stats.members(docs, "source", ["lang", "kind", "pair"])


@R.add("SELECT o_orderkey, floor(spent + 0.5) AS spent FROM (SELECT o_orderkey, sum(CAST(o_totalprice AS double)) OVER (ORDER BY o_orderdate, o_orderkey) AS spent FROM orders) WHERE spent <= 50000000")
def request_budget(spark, d):
    """The oldest orders that a budget of all customers together admits."""
    x = table(spark, d, "orders").select("o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"), "o_totalprice")
    return joins.within_budget(x, "day", "o_orderkey", "o_totalprice", 50_000_000).select("o_orderkey", F.floor(F.col("spent") + 0.5).cast("double").alias("spent"))


LEVELS = ", ".join(f"l{k} AS (SELECT source, o // 4096 AS o, sha256(string_agg(h, '' ORDER BY o, h)) AS h FROM l{k - 1} GROUP BY 1, 2)" for k in range(1, 6))


@R.add(f"WITH l0 AS (SELECT source, doc_id AS o, sha256(coalesce(text, '')) AS h FROM documents), {LEVELS} SELECT source, sha256(string_agg(h, '' ORDER BY o)) AS mark FROM l5 GROUP BY 1")
def evidence_fingerprint(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return identity.group_marks(docs, "source", "doc_id", "h")
