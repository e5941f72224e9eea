"""Line deduplication as an exact set-similarity join, in DataFrame expressions alone.

A line's tokens are its runs of five words; a line of fewer words is one token
as a whole. A line goes if any earlier line (by doc_id, then place) reaches the
Jaccard threshold. Two such sets share a token within their prefixes, whatever
order of all tokens the prefixes follow, and that is used twice:

1. Lines with equal sets are settled by grouping.
2. Prefixes in hash order need no statistics. A token that two lines' prefixes
   share gives a pair; of one that more share, each line meets the earliest
   line. Lines without a match that share such a token with more lines remain.
3. Remaining lines meet all lines of the tokens that fewer than FREQUENT
   prefixes share.
4. Lines whose prefix holds a token that more share: all their tokens are
   counted and put in order, rare before frequent, and the prefixes in that
   order meet. So a passage that very many lines hold costs its count, not its
   square.

Pairs meet behind length, positional and symmetric-difference bounds and are
verified on full sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.common import release, sized

WORDS = 5
#: Bytes up to which a stored table of fixed-width columns is broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20
#: A token of so many prefixes is frequent: its lines meet by prefixes in order of rarity instead.
FREQUENT = 64
REF = ["doc", "tid", "line_no"]
FACTS = [*REF, "n", "sketch"]
#: What lines of equal sets have alike: a digest, and two more facts that other sets hardly share.
SAME = ["digest", "sketch", "n"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """common.stored for tables that are hashes for the most part: they hardly get smaller, so they are written the fastest way."""
    return common.stored(df, name, "snappy", dictionary=False)


def small(df: DataFrame) -> DataFrame:
    """Broadcast a stored table if its counted bytes allow it."""
    return F.broadcast(df) if sized(df) <= BROADCAST_BYTES else df


def _documents(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, doc (never null), tid (a hash of the text: rows with equal both are one document), text, kept (the columns to keep)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("tid"), text.alias("text"), F.struct(*keep).alias("kept") if keep else F.lit(None).alias("kept"))


def _plain(line: str) -> Column:
    """A line in lower case and with plain spaces: a plain character splits faster. By line, as only ASCII is put in lower case fast."""
    lower = F.lower(line)
    other = [F.contains(F.col(line), F.lit(c)) for c in "\t\x0b\f\r"]
    return F.when(other[0] | other[1] | other[2] | other[3], F.regexp_replace(lower, r"[\t\x0B\f\r]", " ")).otherwise(lower)


def _lines(documents: DataFrame) -> DataFrame:
    """A row for each line: doc, tid, line_no, line (see _plain)."""
    lines = documents.select("doc", "tid", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).where(F.octet_length("raw") > 0)
    return lines.select("doc", "tid", "line_no", _plain("raw").alias("line"))


def _tokens(lines: DataFrame, *keys: str) -> DataFrame:
    """tokens: sorted distinct hashes of the runs of WORDS words; of fewer words, one hash; without words, none.

    Two passes: a hash of three words, then one of two such hashes that share
    their middle word. At a line's end both take what words there are, so a
    short line's first hash is that of all its words. The arrays are lambdas'
    variables of one expression: in a row they would be read number by number.
    """
    words = F.array_remove(F.split("line", " "), "")
    three = lambda words: lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    five = lambda threes: lambda t, i: F.xxhash64(t, F.get(threes, i + 2))
    threes = F.transform(F.array(words), lambda words: F.transform(words, three(words)))
    runs = F.get(F.transform(threes, lambda threes: F.transform(threes, five(threes))), F.lit(0))
    n = F.size("runs")
    whole = F.sort_array(F.array_distinct(F.slice("runs", F.lit(1), F.greatest(n - (WORDS - 1), F.lit(0)))))
    return lines.select(*keys, runs.alias("runs")).select(*keys, F.when(n >= WORDS, whole).otherwise(F.slice("runs", F.lit(1), F.least(n, F.lit(1)))).alias("tokens"))


def _overlap(a: Column, b: Column, percent: int) -> Column:
    """Tokens that sets of these sizes must share at least."""
    return F.floor((percent * (a + b) + 99 + percent) / (100 + percent)).cast("int")


def _prefix_size(n: Column, percent: int) -> Column:
    """Tokens of a set of which one is shared with every smaller set that reaches the threshold."""
    return (n - F.floor((percent * n + 99) / 100) + 1).cast("int")


def _short_size(n: Column, percent: int) -> Column:
    """The same for larger sets, which must share more."""
    return (n - _overlap(n, n, percent) + 1).cast("int")


def _parity(tokens: str) -> Column:
    """A number whose bits are the parities of the tokens that fall on them: two sets differ in at least as many tokens as bits."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(t))  # noqa: E731  (a shift takes the hash's lowest six bits)
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(bit(t)))


def _described(tokens: DataFrame, percent: int) -> DataFrame:
    """What each line brings to the join: an id, size, digest and sketch of its set, and its prefix in hash order."""
    n = F.size("tokens")
    prefix = F.slice("tokens", F.lit(1), _prefix_size(n, percent))
    return tokens.select(F.monotonically_increasing_id().alias("id"), *REF, n.alias("n"), F.xxhash64("tokens").alias("digest"), _parity("tokens").alias("sketch"), prefix.alias("prefix"))


def _sets(documents: DataFrame, entries: DataFrame, ids: DataFrame) -> DataFrame:
    """id and tokens of the lines in ids (repeats count once), from their texts."""
    refs = stored(entries.select("id", *REF).join(small(stored(ids.distinct(), "ids")), "id", "left_semi").distinct(), "refs")
    # A document's lines by their numbers, so that its other lines are neither put in lower case nor rows.
    of = stored(refs.groupBy("doc", "tid").agg(F.collect_list(F.struct("line_no", "id")).alias("at")), "docs")
    lines = documents.join(small(of), ["doc", "tid"]).select(F.split("text", "\n").alias("lines"), F.explode("at").alias("at"))
    wanted = lines.select(F.col("at.id").alias("id"), F.get("lines", F.col("at.line_no")).alias("raw")).select("id", _plain("raw").alias("line"))
    return stored(_tokens(wanted, "id").select("id", "tokens"), "sets")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def _side(df: DataFrame, s: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == "token" else f"{c}_{s}") for c in df.columns])


def _pairs(x: DataFrame, y: DataFrame, percent: int, more: Column | None = None) -> DataFrame:
    """Pairs (a, b), later and earlier line, of lines of x and y that share a token and that neither sizes nor symmetric difference rule out."""
    n, m = F.col("n_a"), F.col("n_b")
    differing = F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch_b")))
    at = {s: F.struct(*[f"{c}_{s}" for c in REF]) for s in "ab"}
    near = (100 * n >= percent * m) & (100 * m >= percent * n) & ((100 + percent) * differing <= (100 - percent) * (n + m)) & (at["a"] != at["b"])
    near = near if more is None else near & more
    swap = at["a"] < at["b"]
    later, earlier = F.when(swap, F.col("id_b")).otherwise(F.col("id_a")), F.when(swap, F.col("id_a")).otherwise(F.col("id_b"))
    return stored(_side(x, "a").join(_side(y, "b"), "token").where(near).select(later.alias("a"), earlier.alias("b")).distinct(), "pairs")


def _meet(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """_pairs of prefixes in one order (place and token): those whose overlap, this token and all behind it, can still be enough.

    In the smaller set the token lies in the part of the prefix that larger sets need.
    """
    still = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    reach = F.when(F.col("n_a") < F.col("n_b"), F.col("place_a") < _short_size(F.col("n_a"), percent)).otherwise(F.col("place_b") < _short_size(F.col("n_b"), percent))
    return _pairs(x, y, percent, (still >= _overlap(F.col("n_a"), F.col("n_b"), percent)) & reach)


def _matched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id of the later lines (a) of pairs whose full sets reach the threshold."""
    x, y = (sets.select(F.col("id").alias(s), F.col("tokens").alias(f"t_{s}")) for s in "ab")
    both = x.join(small(pairs), "a").join(y, "b").select("a", F.size(F.array_intersect("t_a", "t_b")).alias("common"), (F.size("t_a") + F.size("t_b")).alias("all"))
    return both.where(100 * F.col("common") >= percent * (F.col("all") - F.col("common"))).select(F.col("a").alias("id")).distinct()


def _rarest_first(sets: DataFrame, percent: int) -> DataFrame:
    """id, place and token of each set's prefix, its tokens in the order of their counts over these sets.

    A token that one set alone has comes first and meets nothing, so only its
    place counts.
    """
    each = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = stored(each.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    ranked = each.join(small(counts), "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("tokens"))
    alone = F.col("n") - F.size("tokens")
    left = F.greatest(F.lit(0), _prefix_size(F.col("n"), percent) - alone)
    prefix = ranked.select("id", alone.alias("alone"), F.slice("tokens", F.lit(1), left).alias("prefix"))
    return prefix.select("id", "alone", F.posexplode("prefix").alias("k", "x")).select("id", (F.col("alone") + F.col("k")).alias("place"), F.col("x.token").alias("token"))


def _entries(first: DataFrame, prefixes: DataFrame, shared: DataFrame) -> DataFrame:
    """Prefix tokens that lines share, with what pairs need. Where shared tokens are too many to broadcast, only ids and tokens are shuffled first."""
    if sized(shared) <= BROADCAST_BYTES:
        return prefixes.join(F.broadcast(shared), "token")
    met = prefixes.select("id", "place", "token").join(shared, "token")
    return met.join(first.select("id", *FACTS), "id")


def removed_lines(documents: DataFrame, percent: int) -> DataFrame:
    """doc, tid, line_no of every line that some earlier line matches."""
    lines = stored(_described(_tokens(_lines(documents), *REF), percent).where("n > 0"), "lines")
    # Equal sets: lines of later documents go, then the later ones of the first document that has the set. A large group is combined before the shuffle.
    heads = stored(lines.groupBy(*SAME).agg(F.count("*").alias("c"), F.min("doc").alias("head")).where("c > 1").select(*SAME, "head"), "heads")
    with_head = lines.join(small(heads), SAME, "left")
    inside = stored(with_head.where("doc = head").select("id", *SAME, *REF), "inside")
    begun = inside.groupBy(*SAME).agg(F.count("*").alias("c"), F.min(F.struct("tid", "line_no")).alias("begun")).where("c > 1").select(*SAME, "begun")
    later = stored(inside.join(begun, SAME).where(F.struct("tid", "line_no") != F.col("begun")).select("id", *REF), "later")
    exact = stored(with_head.where("doc <> head").select(*REF).unionByName(later.select(*REF)), "exact")
    # Tokens that two prefixes share, in one of them where it would do for the smaller set; and the earliest document's line that has each.
    first = with_head.where("head IS NULL OR doc = head").join(small(later.select("id")), "id", "left_anti")
    prefixes = first.select("id", *FACTS, F.posexplode("prefix").alias("place", "token"))
    shared = prefixes.groupBy("token").agg(F.count("*").alias("c"), F.max(F.col("place") < _short_size(F.col("n"), percent)).alias("short"))
    shared = stored(shared.where("c > 1 AND short").select("token", F.least("c", F.lit(FREQUENT)).cast("int").alias("c")), "shared")
    entries = stored(_entries(first, prefixes, shared), "entries")
    release(lines, heads, inside, later, shared)
    lead = entries.groupBy("token").agg(F.min_by("id", F.struct(*REF)).alias("lead"))
    entries, bare = stored(entries.join(small(stored(lead, "lead")), "token"), "entries"), entries
    release(bare)
    leads, others = stored(entries.where("id = lead").select("token", "id", *FACTS), "leads"), entries.where("id <> lead")
    pairs = _pairs(others.select("token", "id", *FACTS), small(leads), percent)
    among = stored(entries.where(F.col("c") >= FREQUENT).select("id", *FACTS).distinct(), "among")  # few beside all lines
    sets = _sets(documents, entries, _ids(pairs).unionByName(among.select("id")))
    matched = stored(_matched(pairs, sets, percent), "matched")
    # Lines without a match that share a token with several lines, not as its lead, meet all of its lines.
    open_ = stored(others.where("c > 2").select("id").distinct().join(small(matched), "id", "left_anti"), "open")
    if open_.limit(1).count():
        rare = entries.where((F.col("c") > 2) & (F.col("c") < FREQUENT)).select("token", "id", "place", "lead", *FACTS)
        rest = _meet(rare.where("id <> lead").join(small(open_), "id", "left_semi").drop("lead"), rare.drop("lead"), percent)
        # A document that rows repeat gives a line's set for each row; one counts.
        once = sets.join(small(among.select("id")), "id", "left_semi").groupBy("id").agg(F.first("tokens").alias("tokens"))
        order = stored(_rarest_first(stored(once, "once"), percent).join(among, "id"), "order")
        rest = stored(rest.unionByName(_meet(order.join(small(open_), "id", "left_semi"), order, percent)).distinct(), "pairs")
        more = _sets(documents, entries, _ids(rest).join(sets.select("id"), "id", "left_anti"))
        matched = stored(matched.unionByName(_matched(rest, sets.unionByName(more), percent)).distinct(), "found")
    return exact.unionByName(entries.select("id", *REF).join(small(matched), "id", "left_semi").select(*REF).distinct())


def dedup_lines(docs: DataFrame, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text and the columns to keep. The text is without the lines that earlier lines match.

    Lines end at line feeds; words are split at white space and compared in
    lower case. Every row stays, if with an empty text; a line of fewer than
    five words goes if an earlier one has the same words, a line without words
    stays. A null text is empty: one empty line. Rows that repeat a
    doc_id and a text are one document and are treated alike; rows that repeat
    a doc_id with other texts are ordered by a hash of the text. An empty table
    gives no rows; other columns are ignored.
    """
    documents = _documents(docs, keep)
    removed = stored(removed_lines(documents, percent).distinct().groupBy("doc", "tid").agg(F.collect_set("line_no").alias("gone")), "removed")
    n_lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1  # most texts needn't be split
    rows = documents.join(small(removed), ["doc", "tid"], "left").select("doc_id", "text", "kept", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    rows = rows.withColumn("lines", F.when(F.size("gone") > 0, F.split("text", "\n")))  # a column of its own: split once, not at each use
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return rows.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).alias("text"),
        *[F.col("kept")[c].alias(c) for c in keep],
    )
