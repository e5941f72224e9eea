"""Evidence about artifacts: alias constraints, grounded verdicts, statuses by digest, work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import features


def _merge(parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(parts)))


def alias_constraints(tags: DataFrame, experts: str = "expert_counts") -> DataFrame:
    """What the tags of one artifact say together: sizes, modes, qualifiers, whether they conflict.

    tags: digest, family, tag and the expert counts of the artifact (an array).
    A size in millions beside one in billions, in any tag, is a context length
    and so a qualifier in all; NxS is S with the qualifier Ne where the header
    has N experts and another tag says so.
    """
    f = features(F.col("tag"))
    each = tags.select("digest", "family", "tag", F.coalesce(experts, F.array().cast("array<bigint>")).alias("experts"), F.struct(*[v.alias(k) for k, v in f.items()]).alias("f"))
    g = each.groupBy("digest", "family").agg(F.collect_set("f").alias("f"), F.max("experts").alias("experts"), F.array_sort(F.collect_set("tag")).alias("tags"))
    ends = lambda letter: lambda s: F.endswith(s, F.lit(letter))
    both = F.filter("f", lambda x: F.exists(x["sizes"], ends("b")))
    g = g.withColumn("context", _merge(F.transform(both, lambda x: F.filter(x["sizes"], ends("m")))))

    def without_context(x: Column) -> Column:
        moved = F.array_intersect(x["sizes"], F.col("context"))
        return F.struct(F.array_except(x["sizes"], moved).alias("sizes"), x["modes"].alias("modes"), F.array_union(x["qualifiers"], moved).alias("qualifiers"))

    g = g.withColumn("f", F.transform("f", without_context))
    moe = r"^([0-9]+)x([0-9]+(?:[.][0-9]+)?b)$"

    def stands_for(token: Column) -> Column:
        n, size = F.regexp_extract(token, moe, 1), F.regexp_extract(token, moe, 2)
        said = F.exists("f", lambda p: F.array_contains(p["sizes"], size) & F.array_contains(p["qualifiers"], F.concat(n, F.lit("e"))))
        return token.rlike(moe) & F.array_contains(F.col("experts"), n.try_cast("bigint")) & said

    def without_moe(x: Column) -> Column:
        known = F.filter(x["sizes"], stands_for)
        sizes = F.concat(F.array_except(x["sizes"], known), F.transform(known, lambda t: F.regexp_extract(t, moe, 2)))
        return F.struct(sizes.alias("sizes"), x["modes"].alias("modes"), F.concat(x["qualifiers"], F.transform(known, lambda t: F.concat(F.regexp_extract(t, moe, 1), F.lit("e")))).alias("qualifiers"))

    g = g.withColumn("f", F.transform("f", without_moe))
    merged = {k: _merge(F.col(f"f.{k}")) for k in ("sizes", "modes", "qualifiers")}
    return g.select("digest", "family", *[v.alias(k) for k, v in merged.items()], "tags").withColumn("conflict", (F.size("sizes") > 1) | (F.size("modes") > 1))


VERDICT = "exact_release string, upstream string, quote string, reason string"


def grounded_verdicts(replies: DataFrame, reply: str, card: str) -> DataFrame:
    """Adds verdict and error to replies: JSON in a closed vocabulary whose quote stands in the card, however it is spaced."""
    v = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), VERDICT)
    words = ("yes", "no", "uncertain")
    df = replies.withColumn("_v", v).withColumn("_quote", F.trim(F.coalesce("_v.quote", F.lit("")))).withColumn("_reason", F.trim(F.coalesce("_v.reason", F.lit(""))))
    df = df.withColumn("_pattern", F.concat(F.lit("(?i)"), F.array_join(F.transform(F.split("_quote", r"\s+"), lambda p: F.concat(F.lit("\\Q"), p, F.lit("\\E"))), "\\s+")))
    df = df.withColumn("_found", F.when(F.contains(F.col(card), F.col("_quote")), F.col("_quote")).otherwise(F.expr(f"regexp_extract({card}, _pattern, 0)")))
    affirms = (F.col("_v.exact_release") == "yes") & (F.col("_v.upstream") == "yes")
    error = (
        F.when(F.col("_v.exact_release").isNull() & F.col("_v.upstream").isNull(), "no JSON")
        .when(~F.coalesce(F.col("_v.exact_release").isin(*words) & F.col("_v.upstream").isin(*words), F.lit(False)), "vocabulary")
        .when((F.col("_quote") != "") & (F.col("_found") == ""), "quote not in card")
        .when(affirms & (F.col("_quote") == ""), "no quote")
        .when(affirms & ((F.length("_reason") < 20) | (F.col("_reason") == "...")), "no reason")
    )
    fields = F.struct(
        F.col("_v.exact_release").alias("exact_release"), F.col("_v.upstream").alias("upstream"), F.nullif(F.col("_found"), F.lit("")).alias("quote"), F.substring("_reason", 1, 500).alias("reason")
    )
    return df.withColumn("error", error).withColumn("verdict", F.when(F.col("error").isNull(), fields)).drop("_v", "_quote", "_reason", "_pattern", "_found")


def with_verdicts(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Decisions (decision_key, repo, status, …) changed by cached verdicts on the same repository: method semantic_verified, or rejected."""
    v = verdicts.select(F.col("decision_key").alias("_key"), F.col("repo").alias("_repo"), F.col("verdict").alias("_verdict"))
    df = decisions.join(v, (F.col("decision_key") == F.col("_key")) & F.col("repo").eqNullSafe(F.col("_repo")), "left")
    x = F.col("_verdict")
    yes = (x["exact_release"] == "yes") & (x["upstream"] == "yes") & (F.coalesce(x["quote"], F.lit("")) != "") & (F.length(x["reason"]) >= 20)
    no = ~F.coalesce(yes, F.lit(False)) & ((x["exact_release"] == "no") | (x["upstream"] == "no"))
    return df.select(
        *[c for c in decisions.columns if c not in ("status", "repo", "method")],
        F.when(no, "rejected").otherwise(F.col("status")).alias("status"),
        F.when(no, F.lit(None)).otherwise(F.col("repo")).alias("repo"),
        F.when(no, F.lit(None)).when(yes, "semantic_verified").otherwise(F.col("method")).alias("method"),
    )


def artifact_status(decisions: DataFrame) -> DataFrame:
    """One status a digest from its families' decisions: conflict, likely (one repository) or unresolved."""
    g = decisions.groupBy("digest").agg(F.count_distinct("repo").alias("n"), F.min("repo").alias("repo"), F.bool_or(F.col("status") == "conflict").alias("conflict"))
    status = F.when(F.col("conflict") | (F.col("n") > 1), "conflict").when(F.col("n") == 1, "likely").otherwise("unresolved")
    return g.select("digest", status.alias("status"), F.when(status == "likely", F.col("repo")).alias("repo"))


def work_queue(decisions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Open decisions of artifacts that aren't settled, one row a decision (conflicts apart): what to do, and for how many digests.

    decisions: digest, family, decision_key, status, method, missing (repositories whose card is missing).
    """
    open_ = decisions.join(artifacts.where("status <> 'likely'").select("digest", F.col("status").alias("_artifact")), "digest")
    clash = F.col("_artifact") == "conflict"
    action = (
        F.when(clash, "review_conflict").when(F.size("missing") > 0, "fetch_cards")
        .when((F.col("status") == "likely") & (F.coalesce("method", F.lit("")) != "semantic_verified"), "semantic_verify").otherwise("review_or_search")
    )
    g = open_.select("family", "decision_key", clash.alias("conflict"), action.alias("action"), "missing", "status", "digest")
    return g.groupBy("family", "decision_key", "conflict", "action").agg(
        F.when(F.first("conflict"), F.array().cast("array<string>")).otherwise(F.array_sort(F.first("missing"))).alias("repos"),
        F.when(F.first("conflict"), "conflict").otherwise(F.min("status")).alias("reason"),
        F.count_distinct("digest").alias("digests"),
    )


def fetch_plan(queue: DataFrame, limit: int | None = None) -> DataFrame:
    """Repositories to fetch, those that most digests wait for first."""
    each = queue.where("action = 'fetch_cards'").select(F.explode("repos").alias("repo"), "digests")
    plan = each.groupBy("repo").agg(F.sum("digests").alias("digests")).orderBy(F.desc("digests"), "repo")
    return plan if limit is None else plan.limit(limit)


def exact_matches(responses: DataFrame, host: str = "huggingface.co") -> DataFrame:
    """Distinct repositories that a reverse lookup of the digest names: digest, repo, commit, path."""
    from quarry.functions.text import clean_repo

    m = responses.select("digest", F.explode("matches").alias("m")).where("m.source = 'hf'")
    repo = clean_repo(F.concat(F.lit(f"https://{host}/"), F.coalesce("m.org", F.lit("")), F.lit("/"), F.coalesce("m.name", F.lit(""))), host)
    return m.select("digest", repo.alias("repo"), F.col("m.commit_sha").alias("commit_sha"), F.col("m.path").alias("path")).where("repo IS NOT NULL").distinct()


def verify_plan(decisions: DataFrame, references: DataFrame, limit: int | None = None) -> DataFrame:
    """Likely decisions that no verdict has settled, those of most artifacts first: decision_key, repo, family, artifacts.

    decisions: decision_key (unique), repo, status, method; references: digest,
    family, decision_key.
    """
    waiting = decisions.where("status = 'likely' AND repo <> '' AND coalesce(method, '') <> 'semantic_verified'").select("decision_key", "repo")
    impact = references.groupBy("decision_key").agg(F.count("*").alias("artifacts"), F.min("family").alias("family"))
    out = waiting.join(impact, "decision_key", "left").withColumns({"artifacts": F.coalesce("artifacts", F.lit(0)), "family": F.coalesce("family", F.lit(""))})
    out = out.select("decision_key", "repo", "family", "artifacts").orderBy(F.desc("artifacts"), "decision_key")
    return out if limit is None else out.limit(limit)


def search_plan(queue: DataFrame, decisions: DataFrame, limit: int | None = None) -> DataFrame:
    """What to search for: unresolved decisions under review, those of most digests first: family, decision_key, query, digests.

    queue: work_queue's rows; decisions: decision_key (unique), status, sizes,
    modes, qualifiers. Ambiguous decisions need a review, not a search.
    """
    from quarry.operators.identity import search_query

    d = decisions.where("status = 'unresolved'").select("decision_key", *[F.array_join(c, " ").alias(c) for c in ("sizes", "modes", "qualifiers")])
    rows = queue.where("action = 'review_or_search'").select("family", "decision_key", "digests").join(d, "decision_key")
    query = F.concat(F.lit("site:huggingface.co "), search_query(*[F.coalesce(c, F.lit("")) for c in ("family", "sizes", "modes", "qualifiers")]))
    out = rows.select("family", "decision_key", query.alias("query"), "digests").orderBy(F.desc("digests"), "family", "query")
    return out if limit is None else out.limit(limit)
