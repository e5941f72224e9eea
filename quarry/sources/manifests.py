"""What collectors leave behind: registry manifests, blobs, service lines, logs and progress documents, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANIFEST = "layers array<struct<mediaType:string,digest:string,size:bigint>>, config struct<digest:string>"
#: Endings of the media types of the layers that count.
MODEL_LAYER = ".image.model"
PROJECTOR_LAYER = ".image.projector"


def manifest_rows(manifests: DataFrame, body: str = "body", weights: str = MODEL_LAYER, projector: str = PROJECTOR_LAYER) -> DataFrame:
    """model, tag, ref and the first layers of each kind of a manifest's JSON text; what can't be used says why in error."""
    m = F.from_json(F.col(body), MANIFEST)
    first = lambda kind: F.get(F.filter(F.coalesce("_m.layers", F.array()), lambda x: F.endswith(x["mediaType"], F.lit(kind))), F.lit(0))
    df = manifests.withColumn("_m", m).withColumns({"_w": first(weights), "_p": first(projector)})
    # A list or a bare value parses to nothing; so do layers that are no list.
    kind = F.when(F.col(body).isNull(), "manifest: missing").when(F.col("_m").isNull() | ~F.startswith(F.ltrim(body), F.lit("{")), "manifest is not an object")
    layers = F.get_json_object(body, "$.layers")
    error = kind.when(layers.isNotNull() & ~F.startswith(F.ltrim(layers), F.lit("[")), "manifest layers is not a list").when(F.col("_w").isNull(), "manifest has no model layer")
    ok = error.isNull()
    return df.select(
        "model", "tag", F.concat("model", F.lit(":"), "tag").alias("ref"), F.when(ok, F.col("_w.digest")).alias("weight_digest"), F.when(ok, F.col("_w.size")).alias("weight_bytes"),
        F.when(ok, F.col("_p.digest")).alias("projector_digest"), F.when(ok, F.coalesce("_p.size", F.lit(0))).alias("projector_bytes"), F.when(ok, F.col("_m.config.digest")).alias("config_digest"), error.alias("error"),
    )


def blobs(rows: DataFrame, digest: str, size: str) -> DataFrame:
    """Each blob once: digest, size, conflict (rows name several sizes). Combined before the shuffle, so a digest may be in any number of rows."""
    return rows.where(F.col(digest).isNotNull()).groupBy(digest).agg((F.min(size) != F.max(size)).alias("conflict"), F.max(size).alias(size))


def missing_blobs(wanted: DataFrame, present: DataFrame, digest: str, size: str) -> DataFrame:
    """Wanted blobs that aren't there with the same size."""
    return wanted.join(present.select(digest, size), [digest, size], "left_anti")


def offload_facts(lines: DataFrame, key: str, at: str, line: str) -> DataFrame:
    """By key, the last line that tells of offloaded layers: line (its last 200 characters), layers_gpu, layers_total."""
    told = lines.where(F.contains(F.col(line), F.lit("offloaded")) & F.contains(F.col(line), F.lit("layers")))
    last = told.groupBy(key).agg(F.max_by(F.trim(line), at).alias("_l"))
    part = lambda k: F.nullif(F.regexp_extract("_l", r"offloaded (\d+)/(\d+) layers", k), F.lit("")).cast("int")
    return last.select(key, F.expr("right(_l, 200)").alias("line"), part(1).alias("layers_gpu"), part(2).alias("layers_total"))


def log_facts(lines: DataFrame, key: str, at: str, line: str, hints: str, now: Column) -> DataFrame:
    """By log: the last model that a line === name === opened, the last line that hints match, seconds of silence."""
    plain = F.rtrim(line)
    opened = F.startswith(plain, F.lit("===")) & F.endswith(plain, F.lit("==="))
    name = F.trim(F.trim(plain, F.lit("= ")))
    g = lines.groupBy(key).agg(
        F.max_by(F.when(opened, name), F.when(opened, F.col(at))).alias("model"), F.max_by(F.when(F.col(line).rlike(hints), plain), F.when(F.col(line).rlike(hints), F.col(at))).alias("last"), F.max(at).alias("_at")
    )
    silence = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("_at").cast("timestamp"))
    return g.select(key, "model", "last", silence.alias("silence_s"))


def job_status(progress: DataFrame, now: Column, stale_s: int = 90, stall_s: int = 180) -> DataFrame:
    """Adds watch: done, error, dead, stall or running, by the progress document first, then by the log.

    progress: status, heartbeat_ts, phase, phase_elapsed_s, and a log's last
    and silence_s; a missing document has nulls.
    """
    beat = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("heartbeat_ts").cast("timestamp"))
    last = F.coalesce("last", F.lit(""))
    over = F.contains(last, F.lit("App completed")) | F.contains(last, F.lit("local entrypoint completed"))
    state = (
        F.when(F.col("status") == "done", "done").when(F.col("status") == "error", "error").when(beat > stale_s, "dead")
        .when(F.col("phase").isin("generate", "load") & (F.coalesce("phase_elapsed_s", F.lit(0)) > stall_s), "stall")
        .when(F.contains(last, F.lit("ConflictError")), "error").when(over, "done").when(F.col("silence_s") > stall_s, "stall").otherwise("running")
    )
    return progress.withColumn("watch", state)


def status_line(kind: Column) -> Column:
    """One line for a job: what its progress and its log say; parts that aren't known are left out."""
    pair = lambda name, c: F.concat(F.lit(f"{name}="), F.col(c).cast("string"))
    job = F.when(F.col("status").isNotNull(), F.concat_ws(" ", *[pair(c, c) for c in ("job", "status", "phase", "model", "ctx")], F.concat(F.lit("done="), F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string"))))
    log = [F.when(F.col("log_model").isNotNull(), pair("log_model", "log_model")), F.when(F.col("silence_s").isNotNull(), F.concat(pair("log_silence", "silence_s"), F.lit("s"))), F.concat(F.lit("last="), F.expr("right(last, 160)"))]
    return F.concat_ws(" | ", F.concat(F.lit("watch="), kind), job, *log)


def progress_rows(events: DataFrame, job: str, at: str, status: str, phase: str) -> DataFrame:
    """Each job's latest status and phase, its events, and seconds since the phase began."""
    last = events.groupBy(job).agg(F.max_by(F.struct(status, phase), at).alias("x"), F.max(at).alias("_at"), F.count("*").alias("events")).select(job, "x.*", "_at", "events")
    # A phase begins after the last event of another one.
    ends = events.join(last.select(job, F.col(phase).alias("_phase")), job).where(~F.col(phase).eqNullSafe(F.col("_phase"))).groupBy(job).agg(F.max(at).alias("_left"))
    begun = events.join(ends, job, "left").join(last.select(job, F.col(phase).alias("_phase")), job).where(F.col(phase).eqNullSafe(F.col("_phase")) & (F.col("_left").isNull() | (F.col(at) > F.col("_left"))))
    first = begun.groupBy(job).agg(F.min(at).alias("_first"))
    secs = F.unix_seconds(F.col("_at").cast("timestamp")) - F.unix_seconds(F.col("_first").cast("timestamp"))
    return last.join(first, job).select(job, status, phase, "events", secs.alias("phase_elapsed_s"))
