"""Lookups, precedence, nearest and longest matches, anti and semi joins, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. order must be total for one answer; partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(top).select(*keys, "row.*")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; the planner limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fallback_lookup(df: DataFrame, keys: Sequence[Column], table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """value of the first of several candidate keys that table (unique on key) has; null where none is there."""
    found = []
    for i, k in enumerate(keys):
        side = table.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        df = df.withColumn(f"_q{i}", k).join(side, F.col(f"_q{i}") == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return df.withColumn(out, F.coalesce(*found)).drop(*[f"_{c}{i}" for c in "kqv" for i in range(len(keys))])


def ordered_alias_lookup(df: DataFrame, ident: str, names: str, table: DataFrame, key: str) -> DataFrame:
    """For each row the hit of its first name, in array order, that table has; rows without one go."""
    each = df.select(ident, F.posexplode(names).alias("_pos", "_name"))
    rest = [c for c in table.columns if c != key]
    hits = each.join(table, F.col("_name") == F.col(key)).groupBy(ident)
    return hits.agg(F.min_by(F.struct(F.col(key), *rest), "_pos").alias("hit"), F.min("_pos").alias("pos")).select(ident, "pos", "hit.*")


def precedence(df: DataFrame, sources: Sequence[tuple[str, DataFrame, str, str]], out: str, origin: str) -> DataFrame:
    """Coalesce over several lookups, best first. sources: (label, table unique on its key, key in df, value column)."""
    values, labels = [], []
    for i, (label, table, key, value) in enumerate(sources):
        side = table.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        df = df.join(side, F.col(key) == F.col(f"_k{i}"), "left")
        values.append(F.col(f"_v{i}"))
        labels.append(F.when(F.col(f"_v{i}").isNotNull(), F.lit(label)))
    df = df.withColumn(out, F.coalesce(*values)).withColumn(origin, F.coalesce(*labels))
    return df.drop(*[f"_{c}{i}" for c in "kv" for i in range(len(sources))])


GRAM = 3


def _runs(c: str, k: int) -> Column:
    """All runs of k characters of a text; a shorter text as a whole."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - k + 1)), lambda i: F.substring(F.col(c), i, F.lit(k)))


def _holds(texts: DataFrame, c: str) -> DataFrame:
    """Each text with its distinct parts of up to GRAM characters."""
    parts = [_runs(c, k) for k in range(1, GRAM + 1)]
    return texts.select(F.col(c).alias("whole"), F.explode(F.array_distinct(F.concat(*parts))).alias("gram"))


def contained(parts: DataFrame, part: str, wholes: DataFrame, whole: str) -> DataFrame:
    """Pairs (part, whole) of distinct texts where whole holds part, empty texts aside.

    Each part looks for the whole texts that have its rarest run of GRAM
    characters (its own text where it is shorter), by an equality join; only
    those are compared. A part with a run that no whole text has goes at once.
    """
    index = _holds(wholes.where(F.length(whole) > 0).select(whole).distinct(), whole)
    counts = index.groupBy("gram").agg(F.count("*").alias("c"))
    runs = F.array_distinct(_runs(part, GRAM))
    each = parts.where(F.length(part) > 0).select(F.col(part).alias("part")).distinct().withColumnRenamed("part", part).select(part, F.explode(runs).alias("gram"))
    rarest = each.join(counts, "gram", "left").groupBy(F.col(part).alias("part")).agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram")).alias("r")).where("r.c > 0")
    return rarest.select("part", F.col("r.gram").alias("gram")).join(index, "gram").where(F.contains("whole", "part")).select("part", "whole")


def longest_match(df: DataFrame, name: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """The entry of a table whose squeezed name equals, holds or is held by df's; equal first, then the longest, then the last by name.

    Both ways go through an index of short runs of characters (contained), so
    neither names nor entries are paired with all others. Names without letters
    or digits match nothing.
    """
    names, keys = df.select(F.col(name).alias("_name")), table.select(F.col(key).alias("_key"))
    inside = contained(keys, "_key", names, "_name").select(F.col("whole").alias("_name"), F.col("part").alias("_key"))
    around = contained(names, "_name", keys, "_key").select(F.col("part").alias("_name"), F.col("whole").alias("_key"))
    pairs = inside.unionByName(around).join(table.select(F.col(key).alias("_key"), F.col(value).alias("_value")), "_key")
    rank = F.struct((F.col("_name") == F.col("_key")).alias("same"), F.length("_key").alias("length"), F.col("_key").alias("key"))
    best = pairs.groupBy("_name").agg(F.max_by("_value", rank).alias(value))
    return df.join(best, F.col(name) == F.col("_name"), "left").drop("_name")


def neighbours(left: DataFrame, right: DataFrame, block: str, x: str, y: str, kind: str, order: Sequence[str], cells: int = 64) -> DataFrame:
    """For each block and x of left (no nulls) and each kind that right has in the block: below (y <= x) and above (y > x), the nearest rows of right, or null.

    Rows without a block, kind or value don't count. Of right's rows of one y the first in order counts. Values are merged in
    order, not paired: each block and kind is cut into cells by quantiles, a
    cell sees its own values, and what lies beyond its edges is carried over
    from the other cells' last and first rows.
    """
    rows = F.struct(*[c for c in right.columns if c != block])
    best = right.where(F.col(y).isNotNull()).groupBy(F.col(block).alias("_b"), F.col(kind).alias("_k"), F.col(y).cast("double").alias("_at")).agg(F.min_by(rows, F.struct(*order)).alias("_row"))
    cuts = best.groupBy("_b", "_k").agg(F.percentile_approx("_at", [i / cells for i in range(1, cells)]).alias("_cuts"))
    asked = left.select(F.col(block).alias("_b"), F.col(x).cast("double").alias("_at")).distinct().join(cuts, "_b")
    cell = F.size(F.filter("_cuts", lambda c: c < F.col("_at"))).alias("_cell")
    held = best.join(cuts, ["_b", "_k"]).select("_b", "_k", "_at", cell, "_row")
    edges = held.groupBy("_b", "_k", "_cell").agg(F.max_by("_row", "_at").alias("_last"), F.min_by("_row", "_at").alias("_first"))
    # At most cells rows a block and kind.
    grid = cuts.select("_b", "_k", F.explode(F.sequence(F.lit(0), F.lit(cells))).alias("_cell")).join(edges, ["_b", "_k", "_cell"], "left")
    up = Window.partitionBy("_b", "_k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("_b", "_k").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.select("_b", "_k", "_cell", F.last("_last", True).over(up).alias("_before"), F.last("_first", True).over(down).alias("_after"))
    merged = held.withColumn("_asks", F.lit(False)).unionByName(asked.select("_b", "_k", "_at", cell, F.lit(None).cast(held.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_asks")))
    own = Window.partitionBy("_b", "_k", "_cell")
    low = F.last("_row", True).over(own.orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0))
    high = F.last("_row", True).over(own.orderBy(F.desc("_at"), F.desc("_asks")).rowsBetween(Window.unboundedPreceding, 0))
    seen = merged.select("_b", "_k", "_cell", "_at", "_asks", low.alias("_low"), high.alias("_high")).where("_asks")
    return seen.join(carried, ["_b", "_k", "_cell"]).select(
        F.col("_b").alias(block), F.col("_at").alias(x), F.col("_k").alias(kind), F.coalesce("_low", "_before").alias("below"), F.coalesce("_high", "_after").alias("above")
    )


def nearest_value(left: DataFrame, right: DataFrame, block: str, ident: str, x: str, y: str, kind: str, extra: Column, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Within a block, the row of right with the least |x - y| + extra (a column of right's kind), then |x - y|, kind and order; see neighbours.

    ident, what keep names, and distance. Rows without a value, or of a block
    that right has not, go. order must be total among rows of one kind and y.
    """
    near = neighbours(left.where(F.col(x).isNotNull()), right, block, x, y, kind, order)
    hits = near.select(F.col(block).alias("_b"), F.col(x).alias("_x"), F.explode(F.array_compact(F.array("below", "above"))).alias("r")).select("_b", "_x", "r.*")
    raw = F.abs(F.col("_x") - F.col(y))
    rank = F.struct((raw + extra).alias("distance"), raw.alias("raw"), F.col(kind).alias("kind"), *order)
    best = hits.groupBy("_b", "_x").agg(F.min_by(F.struct(*keep), rank).alias("_hit"), F.min(rank).alias("_rank"))
    own = left.select(F.col(ident), F.col(block).alias("_b"), F.col(x).cast("double").alias("_x"))
    return own.join(best, ["_b", "_x"]).select(ident, "_hit.*", F.col("_rank.distance").alias("distance"))


def nearest(left: DataFrame, right: DataFrame, block: str, ident: str, penalty: Sequence[Column], keep: Sequence[str], cutoff: Column | None = None) -> DataFrame:
    """Within a block, the row of right with the least penalty tuple (its last part must be unique); cutoff filters after.

    For penalties of any form, so a block's rows are compared with each other;
    for distances of one value there is nearest_value.

    A row of right whose first penalty is null is no candidate. Rows of left
    that look alike to the penalties are compared once.
    """
    used = [c for c in left.columns if c != ident]
    kinds = left.select(*used).distinct().withColumn("_kind", F.struct(*used))
    order = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(penalty)])
    pairs = kinds.join(right, block).where(penalty[0].isNotNull())
    best = pairs.groupBy("_kind").agg(F.min_by(F.struct(*keep), order).alias("_hit"), F.min(order).alias("_least"))
    out = left.withColumn("_own", F.struct(*used)).join(best, F.col("_own").eqNullSafe(F.col("_kind")))
    out = out.select(ident, "_hit.*", F.col("_least.p0").alias("distance"))
    return out if cutoff is None else out.where(cutoff)


def fan_out(rows: DataFrame, once: DataFrame, key: str) -> DataFrame:
    """Rows with the columns that were worked out once for their key."""
    return rows.join(once, key)


def main_rows(df: DataFrame, by: Sequence[str], main: Column, measures: dict[str, Column]) -> DataFrame:
    """Aggregates over the main rows of each group, or over all its rows where it has no main one, with n; a null key is a group.

    One shuffle: a main row counts as one of the group and as one of its main
    rows, both are combined before it, and of the two results one is taken.
    """
    kinds = F.when(F.coalesce(main, F.lit(False)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    each = df.select("*", F.explode(kinds).alias("_main")).groupBy(*by, "_main").agg(F.count("*").alias("n"), *[m.alias(k) for k, m in measures.items()])
    return each.groupBy(*by).agg(F.max_by(F.struct("n", *measures), "_main").alias("_row")).select(*by, "_row.*")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "place") -> DataFrame:
    """The first k rows of each key with their place; the planner limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def present_in(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def missing_from(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison by key: left_only, right_only, both_null, same, changed."""
    a = left.select(F.col(key), F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(F.col(key), F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    kind = (
        F.when(F.col("_in_b").isNull(), "left_only")
        .when(F.col("_in_a").isNull(), "right_only")
        .when(F.col("_a").isNull() & F.col("_b").isNull(), "both_null")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "same")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, kind.alias("category"))


def priority_union(sources: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Rows of all sources; the last source that has a key gives its value."""
    out = None
    for i, s in enumerate(sources):
        part = s.select(key, value, F.lit(i).alias("priority"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.max_by(value, F.struct("priority", value)).alias(value), F.max("priority").alias("priority"))


def merge_maps(base: DataFrame, override: DataFrame, key: str, items: str, source: str) -> DataFrame:
    """Union of two tables of (key, map, source): maps merge by key, override wins, its source is taken."""
    a = base.select(key, F.col(items).alias("_a"), F.col(source).alias("_sa"))
    b = override.select(key, F.col(items).alias("_b"), F.col(source).alias("_sb"))
    empty = F.create_map().cast("map<string,double>")
    merged = F.map_zip_with(F.coalesce("_a", empty), F.coalesce("_b", empty), lambda k, x, y: F.coalesce(y, x))
    return a.join(b, key, "full_outer").select(key, merged.alias(items), F.coalesce("_sb", "_sa").alias(source))


def within_budget(df: DataFrame, order: str, ident: str, cost: str, limit: float, cells: int = 256) -> DataFrame:
    """The rows that a budget admits, in order (then ident): as long as the costs up to and with a row stay within limit; spent is their sum.

    No task puts all rows in order: quantiles of order cut them into cells, the
    cells' sums are added up, and only rows of cells that begin within the
    budget are ordered, each cell on its own. Rows without order come last,
    costs that are null or negative are 0, and equal idents are taken together.
    """
    rows = df.withColumns({"_o": F.col(order).cast("double"), "_cost": F.greatest(F.coalesce(F.col(cost).cast("double"), F.lit(0.0)), F.lit(0.0))})
    cuts = rows.agg(F.percentile_approx("_o", [i / cells for i in range(1, cells)]).alias("_cuts"))
    cell = F.when(F.col("_o").isNull(), cells).otherwise(F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col("_o"))))
    placed = rows.crossJoin(F.broadcast(cuts)).withColumn("_cell", cell).drop("_cuts")
    totals = placed.groupBy("_cell").agg(F.sum("_cost").alias("_total"))
    run = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most cells + 1 rows
    begun = totals.select("_cell", F.coalesce(F.sum("_total").over(run), F.lit(0.0)).alias("_before")).where(F.col("_before") <= limit)
    own = Window.partitionBy("_cell").orderBy(F.asc_nulls_last("_o"), ident)
    spent = F.col("_before") + F.sum("_cost").over(own)
    return placed.join(F.broadcast(begun), "_cell").withColumn("spent", spent).where(F.col("spent") <= limit).drop("_o", "_cost", "_cell", "_before")
