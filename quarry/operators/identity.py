"""Which upstream release an artifact belongs to: candidates, constraints, outcomes, fetch plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions.numeric import at_least, lookup
from quarry.functions.text import clean_repo, features, squeeze
from quarry.operators.stats import LARGE, by_size


def _same(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def _versions(words: Column) -> Column:
    return F.filter(words, lambda q: q.rlike(r"(?i)^v\d+(?:\.\d+)*$"))


def reasons(family: Column, tag: Column, name: Column, card: Column) -> Column:
    """Why a repository name can't stand for family:tag, in a fixed order; empty where nothing speaks against it."""
    want, have = features(tag), features(name)
    # A size in millions that the tag has among its qualifiers is a context length, not a size.
    context = F.array_intersect(F.filter(have["sizes"], lambda s: F.endswith(s, F.lit("m"))), want["qualifiers"])
    sizes = F.array_except(have["sizes"], context)
    qualifiers = F.array_union(have["qualifiers"], context)
    bare = (F.size(want["sizes"]) == 0) & (F.size(want["modes"]) == 0) & (F.size(want["qualifiers"]) == 0)
    rules = [
        (F.lower(tag).isin(*tables.GENERIC) & bare, "unspecified_release"),
        (~F.contains(squeeze(name), squeeze(family)), "family_name_not_confirmed"),
        (F.size(F.array_intersect(qualifiers, F.array(*map(F.lit, tables.CONVERTED)))) > 0, "converted_repository_not_canonical"),
        ((F.size(want["sizes"]) > 0) & ~_same(want["sizes"], sizes), "size_mismatch_or_missing"),
        ((F.size(want["modes"]) > 0) & ~_same(want["modes"], have["modes"]), "variant_mismatch_or_missing"),
        ((F.size(want["modes"]) == 0) & (F.size(have["modes"]) > 0), "variant_unspecified"),
        ((F.size(_versions(qualifiers)) > 0) & (F.size(_versions(want["qualifiers"])) == 0), "version_unspecified"),
        (F.size(F.array_except(want["qualifiers"], qualifiers)) > 0, "release_qualifier_missing"),
        (F.trim(F.coalesce(card, F.lit(""))) == "", "model_card_unavailable"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name_)) for c, name_ in rules]))


def tally(checks: DataFrame, keys: Sequence[str] = ("family", "tag"), repo: str = "repo", why: str = "reasons") -> DataFrame:
    """By target, what its candidates come to: variants, accepted, pending and first. One row for each candidate comes in."""
    soft = F.array(F.lit("variant_unspecified"), F.lit("model_card_unavailable"))
    named = F.array_contains(why, "variant_unspecified") & (F.size(F.array_except(why, soft)) == 0)
    return checks.groupBy(*keys).agg(
        F.bool_or(named).alias("variants"),
        F.count_if(F.size(why) == 0).alias("accepted"),
        F.count_if(F.col(why) == F.array(F.lit("model_card_unavailable"))).alias("pending"),
        F.min(F.when(F.size(why) == 0, F.col(repo))).alias("first"),
    )


def merge(tallies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tallies of one target together. Rows are dealt by target first: a least text is found by sorting, and so no task sorts all that it has read."""
    return tallies.select(*keys, "variants", "accepted", "pending", "first").repartition(*keys).groupBy(*keys).agg(
        F.bool_or("variants").alias("variants"), F.sum("accepted").alias("accepted"), F.sum("pending").alias("pending"), F.min("first").alias("first")
    )


def settle(tallies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """likely, ambiguous or unresolved by target, and the repository where it is likely.

    A target without a mode can't choose a bare repository while others that
    differ only by their mode stand beside it.
    """
    accepted = F.when(F.col("variants"), 0).otherwise(F.col("accepted"))
    pending = F.when(F.col("variants"), 0).otherwise(F.col("pending"))
    status = F.when(accepted + pending > 1, "ambiguous").when(accepted == 1, "likely").otherwise("unresolved")
    return tallies.select(*keys, status.alias("status"), F.when(status == "likely", F.col("first")).alias("repo"))


def resolve(checks: DataFrame, keys: Sequence[str] = ("family", "tag"), repo: str = "repo", why: str = "reasons") -> DataFrame:
    """tally and settle: one row a target."""
    return settle(tally(checks, keys, repo, why), keys)


def of_each(targets: DataFrame, kinds: DataFrame, keys: Sequence[str], size: str = "n", large: int = LARGE) -> DataFrame:
    """Targets with what was worked out once for their kind, which has size targets; null keys are kinds too. Targets of no kind go."""
    told = kinds.withColumnsRenamed({k: f"_kind_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_kind_{k}"))
    many, rest = by_size(targets, told, same, size, large)
    return many.unionByName(rest).drop(*[f"_kind_{k}" for k in keys])


def _no_file(repo: Column) -> Column:
    bad = F.lit(False)
    for e in tables.REJECTED_ENDINGS:
        bad = bad | F.endswith(F.lower(repo), F.lit(e))
    return ~bad


def candidates(df: DataFrame, key: str, text: str, host: str = tables.REPO_HOST) -> DataFrame:
    """Distinct repositories that a text links to; links to files go."""
    urls = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(URL), F.lit(1))).alias("url"))
    repos = urls.select(key, clean_repo(F.col("url"), host).alias("repo")).where("repo IS NOT NULL")
    return repos.where(_no_file(F.col("repo"))).distinct()


URL = r"(?i)(https?://[^\s<>\])\"']+)"
#: Letters, digits, dots and hyphens around one slash, with nothing of that kind beside it.
BARE = r"(?<![\w/.-])([\w.-]+/[\w.-]+)(?![\w/.-])"


def mentions(df: DataFrame, family: str, text: str, source: str, kind: str, host: str = tables.REPO_HOST, around: int = 160) -> DataFrame:
    """Repositories that a text links to, or names as owner/name if the name holds the family's: family, repo, source, kind, excerpt.

    Each repository once a text, at its first link, else its first mention,
    with the characters around it. Links to files go.
    """
    def found(pattern: str) -> Column:
        # Pieces between the matches tell where each match begins.
        hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.split(text, pattern)
        at = lambda i: F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice(hits, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))
        return F.transform(hits, lambda x, i: F.struct(x.alias("token"), at(i).alias("at")))

    each = df.select(family, text, source, kind, F.posexplode(F.concat(
        F.transform(found(URL), lambda x: F.struct(x["token"].alias("token"), x["at"].alias("at"), F.lit(False).alias("bare"))),
        F.transform(found(BARE), lambda x: F.struct(x["token"].alias("token"), x["at"].alias("at"), F.lit(True).alias("bare"))),
    )).alias("place", "m"))
    like = F.contains(squeeze(F.element_at(F.split("m.token", "/"), -1)), squeeze(F.col(family)))
    repo = F.when(~F.col("m.bare"), clean_repo(F.col("m.token"), host)).when(like, clean_repo(F.concat(F.lit(f"https://{host}/"), "m.token"), host))
    low = F.greatest(F.lit(0), F.col("m.at") - around)
    excerpt = F.substring(F.col(text), low + 1, F.col("m.at") + F.length("m.token") + around - low)
    rows = each.select(family, source, kind, "place", repo.alias("repo"), excerpt.alias("excerpt")).where("repo IS NOT NULL").where(_no_file(F.col("repo")))
    first = rows.groupBy(family, source, kind, "repo").agg(F.min_by("excerpt", "place").alias("excerpt"))
    return first.select(family, "repo", source, kind, "excerpt")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON, maps and structs in the order of their keys: equal contents, equal marks."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i:02d}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def group_marks(df: DataFrame, by: str, order: str, mark: str, width: int = 4096) -> DataFrame:
    """One SHA-256 a group over its rows' marks in order, as a tree of digests: of each range of the order, of ranges of ranges, and so on.

    Each level takes width places of the order together, and the last one
    leaves at most eight ranges of 64-bit numbers, so no array is longer than
    width (times the rows of one place, if places repeat) however large a group
    is. The tree depends on the order alone, not on partitions. A null group is
    a group; rows without a place come first.
    """
    def digest(rows: DataFrame, *keys: str | Column) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(F.col("_o").isNotNull().alias("known"), F.coalesce("_o", F.lit(0)).alias("o"), F.col("_h").alias("h"))))
        return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["h"]), ""), 256).alias("_h"))

    rows = df.select(by, F.col(order).cast("long").alias("_o"), F.col(mark).alias("_h"))
    levels = 0
    while width ** (levels + 1) <= 1 << 60:
        levels += 1
        rows = digest(rows, by, F.floor(F.col("_o") / width).cast("long").alias("_next")).select(by, F.col("_next").alias("_o"), "_h")
    return digest(rows, by).select(by, F.col("_h").alias("mark"))


def decision_keys(targets: DataFrame, found: DataFrame, cards: DataFrame, version: str = "1") -> DataFrame:
    """targets (family, tag) with decision_key: it changes with the rules' version, the target, its candidates or one of their cards.

    found: family, repo, source, kind, excerpt (repeats and order don't count);
    cards: repo, text. Candidates are marked one by one and their marks
    combined in order, so a key needs no long text in one place.
    """
    marked = cards.select("repo", F.sha2(F.coalesce("text", F.lit("")), 256).alias("card"))
    each = found.select("family", "repo", "source", "kind", "excerpt").distinct().join(marked, "repo", "left")
    marks = each.select("family", fingerprint(F.col("repo"), F.col("source"), F.col("kind"), F.col("excerpt"), F.col("card")).alias("mark"))
    groups = marks.groupBy("family", F.substring("mark", 1, 2).alias("bin")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("mark")), ""), 256).alias("mark"))
    of = groups.groupBy("family").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "mark"))), lambda x: x["mark"]), ""), 256).alias("_all"))
    f = features(F.col("tag"))
    key = fingerprint(F.lit(version), F.col("family"), F.col("tag"), F.struct(*[v.alias(k) for k, v in f.items()]), F.coalesce("_all", F.lit("")))
    return targets.join(of, "family", "left").withColumn("decision_key", key).drop("_all")


def once_per_key(df: DataFrame, keys: tuple[str, ...], evaluate) -> DataFrame:
    """evaluate (DataFrame -> DataFrame that keeps keys) runs on distinct keys only; its columns are joined to all rows."""
    return df.join(evaluate(df.select(*keys).distinct()), list(keys))


def outcome(code: Column, text: Column, content_type: Column, too_large: Column, redirects: Column | None = None, location: Column | None = None, url: Column | None = None) -> Column:
    """State of a fetch, in the order of the rules.

    With redirects (followed before), location (of a further one) and url,
    redirects without an address, after three others or off the host's https
    pages are errors, and one that can be followed is deferred.
    """
    low = F.lower(F.ltrim(F.coalesce(text, F.lit(""))))
    html = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html")) | F.startswith(low, F.lit("<!doctype html")) | F.startswith(low, F.lit("<html"))
    moved = code.isin(301, 302, 303, 307, 308)
    first = F.when(F.lit(False), "")
    if url is not None:
        parts = {k: F.try_parse_url(url, F.lit(k)) for k in ("PROTOCOL", "HOST", "USERINFO", "AUTHORITY")}
        port = F.regexp_extract(F.coalesce(parts["AUTHORITY"], F.lit("")), r":(\d+)$", 1)
        safe = (F.lower(parts["PROTOCOL"]) == "https") & (F.lower(parts["HOST"]) == tables.REPO_HOST) & parts["USERINFO"].isNull() & port.isin("", "443")
        first = first.when(~F.coalesce(safe, F.lit(False)), "redirect_error")
    if location is not None:
        first = first.when(moved & ((F.coalesce(location, F.lit("")) == "") | (redirects >= 3)), "redirect_error").when(moved, "deferred")
    return (
        first.when(code.isNull() | (code == 408) | (code >= 500), "transient_error")
        .when(code == 429, "rate_limited")
        .when(code.isin(401, 403), "denied")
        .when(code == 404, "not_found")
        .when(code != 200, "http_error")
        .when(too_large, "too_large")
        .when(F.trim(low) == "", "empty")
        .when(html, "invalid_content")
        .otherwise("ok")
    )


def retry_seconds(state: Column, retry_after: Column, now: Column | None = None) -> Column:
    """Seconds until the next try; a server's own wish counts for rate limits, with a floor.

    The wish is a number of seconds or an HTTP date, measured from now (seconds
    since 1970); what is neither leaves the table's value.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(retry_after), r"^[A-Za-z]+,\s*", ""), r"\s*GMT$", "")
    date = F.unix_timestamp(F.try_to_timestamp(plain, F.lit("dd MMM yyyy HH:mm:ss"))) - (F.unix_timestamp() if now is None else now)
    wish = at_least(float(tables.RETRY_FLOOR), F.coalesce(retry_after.try_cast("double"), date.cast("double")))
    table = lookup(state, {k: float(v) for k, v in tables.RETRY_SECONDS.items()})
    return F.when(state == "rate_limited", F.coalesce(wish, table)).otherwise(table)


def search_query(*terms: Column) -> Column:
    """Distinct terms in order, joined by spaces."""
    parts = F.flatten(F.array(*[F.split(F.trim(t), r"\s+") for t in terms]))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " ")


def prompt(family: Column, constraints: Column, repo: Column, excerpts: Column, card: Column) -> Column:
    """What a judge of a repository's identity is asked: six excerpts of 300 characters, 7,000 characters of the card."""
    some = F.transform(F.slice(F.filter(excerpts, lambda x: x != ""), 1, 6), lambda x: F.substring(x, 1, 300))
    parts = {"Family hint: ": family, "\nTarget constraints: ": F.to_json(constraints), "\nCandidate repo: ": repo, "\nSource excerpts: ": F.to_json(some), "\n\nCandidate model card:\n": F.substring(card, 1, 7000)}
    return F.concat(F.lit(tables.JUDGE_TASK + "\n\n"), *[x for k, v in parts.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))])
