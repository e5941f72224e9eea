"""What collectors leave behind: manifests, logs, progress, and lenient parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import catalog as ops
from quarry.operators import joins
from quarry.plans.roles import Registry, table
from quarry.sources import manifests

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


@R.add("""SELECT 'm' || CAST(c_custkey % 9 AS varchar) || ':t' || CAST(c_custkey AS varchar) AS ref, CASE WHEN k = 0 THEN 'sha256:' || c_name END AS weight_digest, CASE WHEN k = 0 THEN c_custkey * 10 END AS weight_bytes,
  CASE WHEN k = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END END AS projector_bytes, CASE WHEN k = 0 THEN 'c' || CAST(c_custkey AS varchar) END AS config_digest,
  CASE k WHEN 1 THEN 'manifest is not an object' WHEN 2 THEN 'manifest layers is not a list' WHEN 3 THEN 'manifest has no model layer' WHEN 4 THEN 'manifest: missing' END AS error FROM (SELECT *, CASE WHEN c_custkey % 7 < 5 THEN c_custkey % 7 ELSE 0 END AS k FROM customer)""")
def manifest_rows(spark, d):
    """First layer of each kind; broken manifests keep their row with an error."""
    key = F.col("c_custkey")
    k = F.when(key % 7 < 5, key % 7).otherwise(0)
    layer = lambda kind, digest, size: F.concat(F.lit(f'{{"mediaType":"application/vnd.x.image.{kind}","digest":"'), digest, F.lit('","size":'), size.cast("string"), F.lit("}"))
    weights = F.concat(layer("model", F.concat(F.lit("sha256:"), "c_name"), key * 10), F.lit(","), layer("model", F.lit("second"), key))
    projector = F.when(key % 2 == 0, F.concat(F.lit(","), layer("projector", F.lit("p"), key))).otherwise("")
    config = F.concat(F.lit('],"config":{"digest":"c'), key.cast("string"), F.lit('"}}'))
    body = (
        F.when(k == 0, F.concat(F.lit('{"layers":['), layer("license", F.lit("l"), key), F.lit(","), weights, projector, config))
        .when(k == 1, "[1, 2]").when(k == 2, '{"layers": {"a": 1}}').when(k == 3, '{"layers": []}')
    )
    x = table(spark, d, "customer").select(F.concat(F.lit("m"), (key % 9).cast("string")).alias("model"), F.concat(F.lit("t"), key.cast("string")).alias("tag"), body.alias("body"))
    return manifests.manifest_rows(x).select("ref", "weight_digest", "weight_bytes", "projector_bytes", "config_digest", "error")


LOG = """l AS (SELECT user_id, ts, event_id, CASE event_id % 5 WHEN 0 THEN '=== m' || CAST(event_id % 17 AS varchar) || ' ===' WHEN 1 THEN 'offloaded ' || CAST(event_id % 33 AS varchar) || '/33 layers to GPU' WHEN 2 THEN 'ERROR ' || CAST(event_id AS varchar) ELSE 'noise' END AS line FROM events)"""


def _log(spark, d):
    k = F.col("event_id")
    line = F.when(k % 5 == 0, F.concat(F.lit("=== m"), (k % 17).cast("string"), F.lit(" ==="))).when(k % 5 == 1, F.concat(F.lit("offloaded "), (k % 33).cast("string"), F.lit("/33 layers to GPU")))
    line = line.when(k % 5 == 2, F.concat(F.lit("ERROR "), k.cast("string"))).otherwise("noise")
    return table(spark, d, "events").select("user_id", "ts", k, line.alias("line"), F.struct("ts", "event_id").alias("at"))


@R.add(f"""WITH {LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM l WHERE contains(line, 'offloaded'))
SELECT user_id, line, CAST(event_id % 33 AS integer) AS layers_gpu, 33 AS layers_total FROM o WHERE n = 1""")
def offload_facts(spark, d):
    return manifests.offload_facts(_log(spark, d), "user_id", "at", "line")


@R.add(f"""WITH {LOG} SELECT user_id, arg_max('m' || CAST(event_id % 17 AS varchar), ts) FILTER (event_id % 5 = 0) AS model, arg_max(line, ts) FILTER (event_id % 5 = 2) AS last, CAST(epoch(TIMESTAMP '2024-02-10 00:00:00') - floor(epoch(max(ts))) AS bigint) AS silence_s FROM l GROUP BY 1""")
def log_facts(spark, d):
    return manifests.log_facts(_log(spark, d), "user_id", "ts", "line", "ERROR", F.lit("2024-02-10 00:00:00").cast("timestamp_ntz"))


JOBS = """j AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'running' WHEN 2 THEN 'error' END AS status, CASE WHEN event_id % 3 = 0 THEN ts END AS beat, CASE event_id % 2 WHEN 0 THEN 'load' ELSE 'idle' END AS phase, event_id % 300 AS phase_s,
  CASE event_id % 7 WHEN 0 THEN 'App completed' WHEN 1 THEN 'x ConflictError' ELSE 'on' END AS last, CASE WHEN event_id % 5 > 0 THEN event_id % 400 END AS silence FROM events)"""


@R.add(f"""WITH {JOBS} SELECT event_id, CASE WHEN status = 'done' THEN 'done' WHEN status = 'error' THEN 'error' WHEN epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(beat)) > 90 THEN 'dead' WHEN phase = 'load' AND phase_s > 180 THEN 'stall'
  WHEN last = 'x ConflictError' THEN 'error' WHEN last = 'App completed' THEN 'done' WHEN silence > 180 THEN 'stall' ELSE 'running' END AS watch,
  'watch=job | ' || CASE WHEN status IS NOT NULL THEN 'job=7 status=' || status || ' phase=' || phase || ' model=m ctx=4 done=1/2 | ' ELSE '' END || CASE WHEN silence IS NOT NULL THEN 'log_silence=' || CAST(silence AS varchar) || 's | ' ELSE '' END || 'last=' || last AS said FROM j""")
def job_status(spark, d):
    k = F.col("event_id")
    x = table(spark, d, "events").select(
        k, F.when(k % 4 == 0, "done").when(k % 4 == 1, "running").when(k % 4 == 2, "error").alias("status"), F.when(k % 3 == 0, F.col("ts")).alias("heartbeat_ts"), F.when(k % 2 == 0, "load").otherwise("idle").alias("phase"), (k % 300).alias("phase_elapsed_s"),
        F.when(k % 7 == 0, "App completed").when(k % 7 == 1, "x ConflictError").otherwise("on").alias("last"), F.when(k % 5 > 0, k % 400).alias("silence_s"), F.lit(7).alias("job"), F.lit("m").alias("model"), F.lit(4).alias("ctx"), F.lit(1).alias("done"),
        F.lit(2).alias("total"), F.lit(None).cast("string").alias("log_model"),
    )
    out = manifests.job_status(x, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return out.select("event_id", "watch", manifests.status_line(F.lit("job")).alias("said"))


@R.add("""WITH e AS (SELECT *, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS phase FROM events),
x AS (SELECT user_id, any_value(phase) AS phase, max(ts) AS last, max(ts) FILTER (event_type <> phase) AS left_at, count(*) AS events FROM e GROUP BY 1)
SELECT x.user_id, x.phase, x.events, CAST(floor(epoch(x.last)) - floor(epoch((SELECT min(ts) FROM events v WHERE v.user_id = x.user_id AND v.event_type = x.phase AND (x.left_at IS NULL OR v.ts > x.left_at)))) AS bigint) AS phase_elapsed_s FROM x""")
def progress_phases(spark, d):
    """Each user's latest phase, and how long it has lasted since another one ended."""
    x = table(spark, d, "events").select("user_id", "ts", F.lit("s").alias("status"), F.col("event_type").alias("phase"))
    return manifests.progress_rows(x, "user_id", "ts", "status", "phase").select("user_id", "phase", "events", "phase_elapsed_s")


@R.add("""SELECT blob FROM (SELECT DISTINCT p_partkey % 300 AS blob, p_partkey % 3 AS size FROM part) w WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = w.blob AND s_suppkey % 2 = w.size)""")
def blobs_by_size(spark, d):
    """A blob is there only with the size that is wanted."""
    wanted = table(spark, d, "part").select((F.col("p_partkey") % 300).alias("blob"), (F.col("p_partkey") % 3).alias("size")).distinct()
    present = table(spark, d, "supplier").select(F.col("s_suppkey").alias("blob"), (F.col("s_suppkey") % 2).alias("size"))
    return manifests.missing_blobs(wanted, present, "blob", "size").select("blob")


@R.add("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN date_trunc('second', ts) END AS at, CASE event_id % 2 WHEN 0 THEN 'a' END AS family, CASE event_id % 2 WHEN 0 THEN 'b:c' END AS tag FROM events""")
def lenient_parse(spark, d):
    """Times in two forms, references at their first colon; anything else is null."""
    k = F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k % 4 == 0, F.concat(iso, F.lit("Z"))).when(k % 4 == 1, F.concat(iso, F.lit("+00:00"))).when(k % 4 == 2, iso).otherwise("soon")
    family, tag = text.split_ref(F.when(k % 2 == 0, "a:b:c").otherwise("nothing"))
    return table(spark, d, "events").select(k, text.parse_timestamp(raw).cast("timestamp_ntz").alias("at"), family.alias("family"), tag.alias("tag"))


@R.add("""SELECT page_id, CASE WHEN page_id % 3 > 0 THEN 'a & b – "' || CAST(page_id AS varchar) || '"' ELSE 'short' END AS description, '[x](https://s.t/assets/y.png) é' AS readme FROM pages""")
def page_extract(spark, d):
    """Meta description, else the summary field; the readme field with whole addresses; all entities read."""
    key = F.col("page_id")
    meta = F.when(key % 3 > 0, F.concat(F.lit('<meta name="description" content="a &amp; b &ndash; &quot;'), key.cast("string"), F.lit('&quot;">'))).otherwise("")
    page = F.concat(meta, F.lit("<textarea id='summary-textarea'> short </textarea><textarea class=\"z\" id=\"editor\">[x](/assets/y.png) &eacute;</textarea>"), "html")
    description, readme = text.page_copy(page, "https://s.t")
    return table(spark, d, "pages").select("page_id", description.alias("description"), readme.alias("readme"))


@R.add("""WITH x AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN n IS NULL THEN 'row ' || c_name ELSE 'family ' || CAST(n AS varchar) END AS description FROM customer LEFT JOIN x ON k = c_custkey""")
def family_copies(spark, d):
    """A family's own texts, else the row's."""
    from quarry.operators.publish import family_copy

    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.struct(F.concat(F.lit("family "), F.count("*").cast("string")).alias("description"), F.lit("r").alias("readme")).alias("own"))
    rows = joins.fallback_lookup(table(spark, d, "customer").select("c_custkey", "c_name"), [F.col("c_custkey")], n, "c_custkey", "own", "own")
    return rows.select("c_custkey", family_copy(F.col("own"), F.concat(F.lit("row "), "c_name")).getField("description").alias("description"))


@R.add("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def largest_first(spark, d):
    """What a download would take first."""
    return ops.largest_first(table(spark, d, "orders"), "o_totalprice", "o_orderkey", 30).select("o_orderkey", "o_custkey")
