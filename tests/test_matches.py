"""Matches without all pairs, statistics of groups with null keys, and members of sets, against plain code."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import evals, fitting, joins, stats


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_longest_match_equals_all_pairs(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(rng.randint(0, n)))
    names, keys = [word(9) for _ in range(300)] + [None, "", "a", "ab", "abc"], sorted({word(7) for _ in range(120)} | {"", "a", "ab", "abcab"})
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    table = spark.createDataFrame([(k, k.upper()) for k in keys], "key string, hit string")
    out = joins.longest_match(df, "name", table, "key", "hit")
    assert not re.search("NestedLoop|Cartesian", executed(out))
    got = {r["i"]: r["hit"] for r in out.collect()}
    assert len(got) == len(names)
    for i, n in enumerate(names):
        hits = [(n == k, len(k), k.encode()) for k in keys if n and k and (k in n or n in k)]
        assert got[i] == (max(hits)[2].decode().upper() if hits else None)
    assert joins.longest_match(df.limit(0), "name", table, "key", "hit").count() == 0
    assert joins.longest_match(df, "name", table.limit(0), "key", "hit").where("hit IS NOT NULL").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_nearest_value_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    number = lambda: rng.choice([None, rng.randint(0, 40) / 2, rng.uniform(0, 20)])
    left = [(i, rng.choice(["p", "q", "r", None]), number()) for i in range(200)]
    right = [(i, rng.choice(["p", "q", "z", None]), rng.choice([0, 1, 2]), number()) for i in range(300)]
    x = spark.createDataFrame(left, "i int, b string, x double")
    y = spark.createDataFrame(right, "j int, b string, kind int, y double")
    off = F.when(F.col("kind") == 0, 0.0).when(F.col("kind") == 1, 0.5).otherwise(2.0)
    out = joins.nearest_value(x, y, "b", "i", "x", "y", "kind", off, ["j"], ["j"])
    assert not re.search("NestedLoop|Cartesian", executed(out))
    got = {r["i"]: (r["j"], round(r["distance"], 9)) for r in out.collect()}
    want = {}
    for i, b, v in left:
        c = [(abs(v - w) + (0, 0.5, 2)[k], abs(v - w), k, j) for j, d, k, w in right if v is not None and w is not None and b is not None and b == d]
        if c:
            want[i] = (min(c)[3], round(min(c)[0], 9))
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_match_evals_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    size = lambda: rng.choice([None, float(rng.randint(1, 30)), rng.randint(2, 60) / 2])
    variant = lambda: rng.choice(["base", "instruct", "unknown", "vision"])
    rows = [(f"r{i}", rng.choice("abcd"), size(), variant()) for i in range(120)]
    pool = [(f"e{i:03d}", f := rng.choice("abce"), None if f == "c" else size(), rng.choice([variant(), None]), rng.choice(["web_seed", "readme", None])) for i in range(150)]
    out = evals.match_evals(spark.createDataFrame(rows, "ref string, family string, size double, variant string"), spark.createDataFrame(pool, "eval_id string, family string, size_b double, variant string, source string"), ("eval_id",))
    got = {r["ref"]: (r["eval_id"], r["distance"]) for r in out.collect()}
    want = {}
    for ref, family, s, v in rows:
        mine = [p for p in pool if p[1] == family]
        mine = [p for p in mine if p[2] is not None] or mine
        ranked = []
        for ident, _, t, w, source in mine:
            w = w or "unknown"
            away = 5.0 if s is None or t is None else abs(t - s)
            off = 0.0 if w == v else 0.5 if "unknown" in (w, v) else 2.0
            ranked.append((away + off, away, not (source or "").startswith("web"), t or 0.0, ident))
        if ranked and min(ranked)[0] <= 8:
            want[ref] = (min(ranked)[4], min(ranked)[0])
    assert got == want


GROUPS = [("a", 1.0), ("a", 2.0), (None, 5.0), (None, 7.0), (None, None), ("b", None), ("c", 3.0), ("c", 3.0), ("c", 9.0), ("c", 4.0)]


def test_null_keys_are_groups(spark):
    df = spark.createDataFrame(GROUPS, "g string, v double")
    assert {(r["g"], r["m"], r["n"]) for r in stats.medians(df, ["g"], "v", "m").collect()} == {("a", 1.5, 2), (None, 6.0, 2), ("c", 3.5, 4)}
    errors = {r["g"]: (r["max_error"], r["p95_error"], round(r["mean_error"], 6), r["n"]) for r in stats.error_stats(df, ["g"], "v").collect()}
    assert errors == {"a": (2.0, 2.0, 1.5, 2), None: (7.0, 7.0, 6.0, 2), "c": (9.0, 9.0, 4.75, 4)}
    assert [tuple(r) for r in stats.error_stats(df, [], "v").collect()] == [(9.0, 9.0, 34 / 8, 8)]
    assert [r["n"] for r in stats.error_stats(df.limit(0), [], "v").collect()] == [0]
    main = joins.main_rows(df, ["g"], F.col("v") > 2.5, {"top": F.max("v"), "low": F.min("v")})
    assert {tuple(r) for r in main.collect()} == {("a", 2, 2.0, 1.0), (None, 2, 7.0, 5.0), ("b", 1, None, None), ("c", 4, 9.0, 3.0)}
    rng = random.Random(4)
    rows = [(g, x := rng.random(), z := rng.random(), k + 2 * x - 3 * z) for k, g in ((1, None), (5, "a")) for _ in range(20)]
    fits = {r["g"]: [round(r[c], 6) for c in ("b0", "b1", "b2", "r2")] for r in fitting.ols2(spark.createDataFrame(rows, "g string, x double, z double, y double"), ["g"], "x", "z", "y").collect()}
    assert fits == {None: [1, 2, -3, 1], "a": [5, 2, -3, 1]}


def test_ranks_of_long_and_skewed_groups(spark):
    rng = random.Random(5)
    rows = [("big", rng.choice([0.0, 1e-9, rng.expovariate(1e-3), -rng.random()])) for _ in range(20_000)] + [("small", float(i)) for i in range(7)] + [(None, 2.0)] * 900
    got = {r["g"]: r for r in stats.at_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"first": F.lit(0), "third": F.floor(F.col("_n") / 3), "last": F.col("_n") - 1}).collect()}
    for g in ("big", "small", None):
        values = sorted(v for k, v in rows if k == g)
        n = len(values)
        assert (got[g]["n"], got[g]["first"], got[g]["third"], got[g]["last"]) == (n, values[0], values[n // 3], values[-1])


def test_members_of_sets_are_rows(spark):
    rows = [("g", {"b": 1, "a": 2}, (3, "x"), [1, 2]), ("g", {"a": 2, "b": 1}, (3, "x"), [1, 2]), ("g", None, None, []), (None, {}, (None, 'q"\n'), None)]
    df = spark.createDataFrame(rows, "g string, m map<string,int>, s struct<z:int,a:string>, l array<int>")
    out = stats.members(df, "g", ["m", "s", "l"])
    assert "collect_set" not in executed(out)
    assert {tuple(r) for r in out.collect()} == {
        ("g", "m", '{"a":2,"b":1}', 2), ("g", "m", None, 1), ("g", "s", '{"a":"x","z":3}', 2), ("g", "s", None, 1), ("g", "l", "[1,2]", 2), ("g", "l", "[]", 1),
        (None, "m", "{}", 1), (None, "s", '{"a":"q\\"\\n","z":null}', 1), (None, "l", None, 1),
    }
    assert math.isclose(out.agg(F.sum("n")).first()[0], 12)


def test_a_name_is_registered_once():
    from quarry.plans.roles import Registry

    r = Registry()

    def twice(spark, d):
        return None

    r.add()(twice)
    with pytest.raises(ValueError):
        r.add()(twice)
