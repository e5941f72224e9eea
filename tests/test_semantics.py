"""Rules for what is missing, and fits against numpy: results worked out by hand or by plain code."""

from __future__ import annotations

import datetime
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import plans, tables
from quarry.functions import capacity, numeric, text
from quarry.operators import catalog, evals, evidence, fitting, identity, joins, publish, quality, stats, vram
from quarry.sources import files, manifests


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def null():
    return F.lit(None).cast("double")


def test_null_stays_null(spark):
    assert one(spark, numeric.clip(null())) is None and one(spark, numeric.at_least(0, null())) is None
    assert one(spark, capacity.predict_vram(F.lit(1.0), null(), F.lit(2.0), F.lit(3.0), F.lit(4.0))) == 10  # no projector counts as none
    assert one(spark, capacity.predict_vram(F.lit(1.0), F.lit(0.0), null(), F.lit(3.0), F.lit(4.0))) is None
    assert one(spark, quality.min_max(null(), F.lit(0.0), F.lit(9.0))) is None and one(spark, quality.min_max(null(), F.lit(1.0), F.lit(1.0))) is None
    assert one(spark, capacity.prefill_tps(F.lit(10.0), F.lit(0.3), F.lit(1000.0))) == pytest.approx(1.5e9) and one(spark, capacity.prefill_tps(F.lit(0.0), F.lit(0.3), F.lit(1.0))) is None


CATALOG = "ref string, family string, quant string, params long, layers long, weight_bytes long, ctx_max long, kv_per_token long, pushed_at date, q_file double, q_task double, signals array<string>, arch string"


def gpu():
    return F.struct(F.lit(24e9).alias("memory"), F.lit(0.9).alias("usable"), F.lit(300.0).alias("bandwidth"), F.lit(3e-5).alias("per_layer"), F.lit(1.5e-3).alias("fixed"))


def test_view_of_unscored_and_undated_rows(spark):
    """An unscored row has 0.45 of a size prior, no date means no recency and no decay, no layers no speed."""
    day = datetime.date(2025, 1, 1)
    rows = [
        ("a", "f", "Q4_K_M", 8 * 10**9, 32, 5 * 10**9, 131072, 1000, day, 80.0, None, [], "x"),
        ("b", "f", "Q4_K_M", 8 * 10**9, 32, 5 * 10**9, 131072, 1000, None, None, 90.0, [], "x"),
        ("c", "g", "F16", None, None, 5 * 10**9, None, 1000, None, None, None, [], "x"),
        ("d", "h", "Q8_0", 8 * 10**9, 32, 40 * 10**9, 131072, 1000, day, 120.0, -5.0, [], "x"),
    ]
    df = spark.createDataFrame(rows, CATALOG)
    got = {r["ref"]: r for r in catalog.view(df, gpu(), catalog.FindQuery(as_of="2026-01-01")).collect()}
    prior = (math.log10(8e9) - 8) / 3 * 0.72 + 0.8 * 0.28
    aged = prior * math.exp(-math.log(2) * (365 / 365.25) / 1.1) * 0.45
    assert got["a"]["capability"] == 0.8 and got["a"]["match"] == pytest.approx(aged) and got["a"]["recency"] == pytest.approx(math.exp(-1))
    assert got["b"]["capability"] == pytest.approx(prior * 0.45) == got["b"]["match"] and got["b"]["recency"] == 0  # a task score without a file score doesn't count
    assert got["c"]["capability"] == pytest.approx(0.99 * 0.28 * 0.45) and got["c"]["raw_speed"] is None and got["c"]["speed_score"] == 0 and got["c"]["fit"] == "context"
    assert got["d"]["capability"] == 1 and got["d"]["match"] == 0 and got["d"]["fit"] == "partial" and got["d"]["speed"] is None
    speed = 1 / (5e9 / 300e9 + 32 * 3e-5 + 1.5e-3)
    assert got["a"]["raw_speed"] == pytest.approx(speed) == got["a"]["speed"]
    score = 0.8 * 50 + math.log10(speed + 1) / 2.4 * 14 + aged * 26 + 18 + math.exp(-1) * 12 + 3
    assert got["a"]["score"] == pytest.approx(score)
    page = catalog.find_models(df, gpu(), catalog.FindQuery(as_of="2026-01-01", fit="all", sort="capability")).collect()
    assert [(r["rank"], r["ref"]) for r in page] == [(1, "d"), (2, "a")]  # unknown sizes aren't chosen at first
    assert [r["rank"] for r in catalog.find_models(df, gpu(), catalog.FindQuery(mode="explore", fit="all", sort="name", limit=1, offset=1)).collect()] == [2]


def test_usecases(spark):
    want = {"vision": {"v"}, "embedding": {"e", "ve"}, "chat": {"v", "n"}}
    df = spark.createDataFrame([("v", ["vision"]), ("e", ["embedding"]), ("ve", ["vision", "embedding"]), ("n", [])], "k string, s array<string>")
    for use, keys in want.items():
        assert {r["k"] for r in df.where(catalog.usecase_candidate(use, F.col("s"))).collect()} == keys


def test_query_state_round_trip():
    q = catalog.FindQuery(ctx=4096, allow_partial=True, sizes=("tiny", "xl"))
    assert catalog.FindQuery.from_params(q.to_params()) == q
    assert catalog.FindQuery.from_params({"ctx": "4097", "ram_gb": "33", "offset": "-1"}) == catalog.FindQuery()


def test_rationale(spark):
    row = spark.createDataFrame([("full", 2.0e9, 1.0e9, None, None, 8 * 10**9, 20.0, datetime.date(2025, 1, 1), "Q4_K_M", "size_prior")], "fit string, usable_bytes double, vram double, q_file double, q_task double, active_params long, raw_speed double, pushed_at date, quant string, task_source string").withColumn("eval_id", F.lit("e"))
    say = lambda **kw: row.select(catalog.rationale(catalog.FindQuery(as_of="2026-01-01", **kw)).alias("x")).first()["x"]
    assert say() == "1.00 GB GPU memory left at 8k context; uses a common balanced quant."
    assert say(priority="speed") == "1.00 GB GPU memory left at 8k context; about 20.0 tok/s when fully resident."
    assert say(priority="quality") == "1.00 GB GPU memory left at 8k context; 8B size prior with 1.0y exponential age decay (t½=1.1y)."


def test_retries(spark):
    now = F.lit(1_700_000_000).cast("long")
    for wish, want in (("7", 60), ("900", 900), ("soon", 300), (None, 300), ("Tue, 14 Nov 2023 22:23:20 GMT", 600), ("Tue, 14 Nov 2023 22:13:21 GMT", 60)):
        assert one(spark, identity.retry_seconds(F.lit("rate_limited"), F.lit(wish).cast("string"), now)) == want
    assert one(spark, identity.retry_seconds(F.lit("not_found"), F.lit("9"), now)) == 7 * 86400
    page = "https://huggingface.co/a/b"
    state = lambda code, location, n, url: one(spark, identity.outcome(F.lit(code), F.lit("x"), F.lit(""), F.lit(False), F.lit(n), F.lit(location).cast("string"), F.lit(url)))
    assert [state(302, "/c", 0, page), state(302, "/c", 3, page), state(301, None, 0, page), state(200, None, 0, "http://huggingface.co/a"), state(200, None, 0, "https://huggingface.co:8443/a"), state(200, None, 0, page)] == [
        "deferred", "redirect_error", "redirect_error", "redirect_error", "redirect_error", "ok",
    ]


def test_nearest_skips_unknown_distances(spark):
    left = spark.createDataFrame([(1, "f", 5.0), (2, "f", 5.0), (3, "g", 1.0)], "i long, p string, x double")
    right = spark.createDataFrame([("f", None, "n"), ("f", 5.5, "h"), ("g", None, "n")], "p string, y double, name string")
    got = joins.nearest(left, right, "p", "i", [F.abs(F.col("x") - F.col("y")), F.col("name")], ["name"]).collect()
    assert sorted((r["i"], r["name"], r["distance"]) for r in got) == [(1, "h", 0.5), (2, "h", 0.5)]


def test_eval_rows_meet_the_catalog(spark):
    rows = [("f", None, "instruct", "web", "e1"), ("f", 7.0, "base", "readme", "e2"), ("f", 8.0, "instruct", "readme", "e3"), ("f", 8.0, "instruct", "web_seed", "e4"), ("g", None, None, "web", "e5"), ("h", 90.0, "base", "web", "e6")]
    pool = spark.createDataFrame(rows, "family string, size_b double, variant string, source string, eval_id string")
    want = spark.createDataFrame([("a", "f", 8.0, "instruct"), ("b", "f", None, "base"), ("c", "g", 3.0, "instruct"), ("d", "h", 7.0, "base"), ("e", "none", 7.0, "base")], "ref string, family string, size double, variant string")
    got = {r["ref"]: (r["eval_id"], r["distance"]) for r in evals.match_evals(want, pool, ("eval_id",)).collect()}
    assert got == {"a": ("e4", 0.0), "b": ("e2", 5.0), "c": ("e5", 5.5)}


@pytest.mark.parametrize(("x", "want"), [(7.0, "7"), (0.5, "0.5"), (1.55, "1.55"), (123456.7, "123457"), (0.0, "0"), (None, None), (70.0, "70")])
def test_plain_numbers(spark, x, want):
    assert one(spark, text.plain_number(F.lit(x).cast("double"))) == want


def test_readme_tables_become_eval_rows(spark):
    page = "x\n|Bench|Big 7B|Big 70B Instruct|\n|---|---|---|\n|MMLU|60.1|80|\n|GPQA Diamond|n/a|50|\n|MMLU|61|81|\n\n|Bench|Score|\n|---|---|\n|MATH-500|9|\n"
    got = {r["eval_id"]: (r["size_b"], r["variant"], r["benchmarks"], r["column_header"]) for r in evals.readme_evals(spark.createDataFrame([("fam", page)], "family string, readme string"), "family", "readme").collect()}
    assert got == {
        "fam:7b-it": (7.0, "unknown", {"mmlu": 61.0}, "Big 7B"), "fam:70b-instruct": (70.0, "instruct", {"mmlu": 81.0, "gpqa_diamond": 50.0}, "Big 70B Instruct"),
        "fam:readme-single": (None, "unknown", {"math500": 9.0}, "single-column"),
    }


def test_ref_scores(spark):
    e = spark.createDataFrame([("f:7b-it", "f", 7.0, "instruct", {"mmlu_pro": 80.0}, "web"), ("g:1b-it", "g", 1.0, "unknown", {"mmlu_pro": 20.0}, "web"), ("h:1b-it", "h", 1.0, "unknown", {}, "web")], "eval_id string, family string, size_b double, variant string, benchmarks map<string,double>, source string")
    rows = spark.createDataFrame([("f:7b-it-q4", "f", "7b-it-q4", "Q4_K_M", 7_000_000_000, 8192), ("h:x", "h", "x", None, None, None)], "ref string, family string, tag string, quant string, params long, context_length long")
    got = {r["ref"]: r for r in evals.ref_scores(rows, e).collect()}
    assert (got["f:7b-it-q4"]["q_base"], got["f:7b-it-q4"]["q_file"], got["f:7b-it-q4"]["q_rec_partial"]) == (100.0, 90.0, pytest.approx(45 + 26 / 3, abs=2e-3))
    assert (got["h:x"]["q_base"], got["h:x"]["q_file"], got["h:x"]["context_term"]) == (50.0, 45.0, 0.0)


# ---- fits

def test_planes_of_any_rank_equal_least_squares(spark):
    rng = np.random.default_rng(1)
    groups = {"full": rng.normal(5, 2, (9, 2)), "line": np.outer(rng.normal(3, 1, 6), [2.0, -1.0]) + [4.0, 1.0], "flat": np.stack([np.full(5, 7.0), rng.normal(0, 1, 5)], 1), "point": np.full((4, 2), 3.0), "single": np.asarray([[2.0, 5.0]])}
    rows = [(g, float(a), float(b), float(1 + 2 * a - b + rng.normal(0, 0.1))) for g, x in groups.items() for a, b in x]
    got = {r["g"]: r for r in fitting.ols2(spark.createDataFrame(rows, "g string, x1 double, x2 double, y double"), ["g"], "x1", "x2", "y").collect()}
    for g, x in groups.items():
        y = np.asarray([r[3] for r in rows if r[0] == g])
        design = np.column_stack([np.ones(len(x)), x])
        coef, *_ = np.linalg.lstsq(design, y, rcond=None)
        assert [got[g][k] for k in ("b0", "b1", "b2")] == pytest.approx(coef.tolist(), rel=1e-6, abs=1e-8)
        if len(x) > 1 and y.std() > 0:
            assert got[g]["r2"] == pytest.approx(1 - ((y - design @ coef) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-8)


def test_decode_modes(spark):
    rng = np.random.default_rng(2)
    points, bw = [], [("free", 200.0), ("slow", 100.0), ("two", 50.0), ("same", 80.0)]
    for g, n, a in (("free", 8, 1 / 250e9), ("slow", 6, -1 / 250e9), ("two", 3, 1 / 60e9), ("none", 3, 1 / 60e9), ("same", 2, 1 / 70e9)):
        for _ in range(n):
            w, layers = rng.uniform(1e9, 9e9), 20.0 if g == "same" else float(rng.integers(10, 80))
            points.append((g, w, layers, 1 / (a * w + 3e-5 * layers + (0.05 if a < 0 else 2e-3) + rng.normal(0, 1e-5))))
    got = {r["g"]: r for r in vram.decode_fits(spark.createDataFrame(points, "g string, W double, L double, decode_tps double"), "g", spark.createDataFrame(bw, "g string, bw_measured_gbs double")).collect()}
    assert {g: r["mode"] for g, r in got.items()} == {"free": "free", "slow": "anchored_to_measured_bw", "two": "anchored_to_measured_bw", "none": "insufficient", "same": "anchored_to_measured_bw"}
    for g, fixed in (("free", None), ("slow", 100.0), ("two", 50.0), ("same", 80.0)):
        p = np.asarray([x[1:] for x in points if x[0] == g])
        y = 1 / p[:, 2]
        x = np.column_stack([p[:, 0], p[:, 1], np.ones(len(p))]) if fixed is None else np.column_stack([p[:, 1], np.ones(len(p))])
        z = y if fixed is None else y - p[:, 0] / (fixed * 1e9)
        coef, *_ = np.linalg.lstsq(x, z, rcond=None)
        assert [got[g]["c_s_per_layer"], got[g]["d_s"]] == pytest.approx(coef[-2:].tolist(), rel=1e-4)
        assert got[g]["r2"] == pytest.approx(1 - ((z - x @ coef) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-5)
        assert got[g]["bw_eff_gbs"] == pytest.approx(fixed or 1 / coef[0] / 1e9, rel=1e-4)
    assert got["none"]["a_s_per_byte"] is None and got["none"]["bw_eff_gbs"] is None


POINT = "digest string, signature string, ctx long, resident long, W double, proj double, kv_per_token double, kv_local_per_token double, kv_global_per_token double, sliding_window long, n_head long, n_layer long, n_swa_layers long, n_global_layers long, kv_elem_factor double, tensor_count double, output_tensor_bytes double"


def test_memory_fit_report(spark):
    """A synthetic fleet: the fit recovers the baseline, and every part equals refits in plain code."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        tensors, out = float(rng.integers(100, 900)), float(rng.integers(10**8, 10**9))
        for ctx in (2048, 8192, 32768):
            kv, graph = 50.0 * ctx, 2048.0 * 33 * ctx
            resident = round(4e9 + kv + graph + 2e7 + 4.5e5 * tensors - 0.5 * out + rng.normal(0, 3e6) + k * 1e6)
            rows.append((f"d{k}", f"s{k % 4}", ctx, resident, 4e9, None, 50.0, None, None, None, 32, 30, None, None, None, tensors, out))
    df = spark.createDataFrame(rows, POINT)
    p = vram.memory_points(df)
    coeffs = vram.fit_baseline(p).first()
    y = np.asarray([r["residual"] for r in p.orderBy("digest", "ctx").collect()])
    ordered = sorted(rows, key=lambda r: (r[0], r[2]))
    design = np.asarray([[1, r[15], r[16]] for r in ordered])
    resident = np.asarray([r[3] for r in ordered], float)
    fit = np.linalg.lstsq(design, y, rcond=None)[0]
    assert [coeffs["b0"], coeffs["b_tensor"], coeffs["b_output"]] == pytest.approx(fit.tolist(), rel=1e-6) and coeffs["mode"] == "lstsq"
    sig, digest = np.asarray([r[1] for r in ordered]), np.asarray([r[0] for r in ordered])
    miss = lambda base, at: np.abs(np.round(resident[at] - y[at] + base) - resident[at]) / resident[at]
    every = np.arange(len(y))
    want = {"train_global": miss(design @ fit, every), "train_digest": miss(np.asarray([np.median(y[digest == d]) for d in digest]), every)}
    later = np.asarray([i for i in every if i % 3])
    want["forward_context"] = miss(y[later - later % 3], later)
    want["grouped_holdout"] = np.concatenate([miss(design[sig == s] @ np.linalg.lstsq(design[sig != s], y[sig != s], rcond=None)[0], np.flatnonzero(sig == s)) for s in set(sig)])
    for r in vram.fit_report(df).collect():
        e = np.sort(want[r["part"]])
        assert (r["n"], r["max_error"], r["mean_error"], r["p95_error"]) == (len(e), pytest.approx(e[-1], rel=1e-4), pytest.approx(e.mean(), rel=1e-4), pytest.approx(e[round(0.95 * (len(e) - 1))], rel=1e-4))
    assert {r["n"] for r in vram.fit_report(df.limit(0)).collect()} == {0} and vram.fit_baseline(vram.memory_points(df.limit(0))).first()["mode"] == "default"


def test_large_groups_are_not_brought_into_one_task(spark):
    """Groups beyond the limit are joined with their facts where their rows lie, others by shuffles; both are exact."""
    rng = np.random.default_rng(9)
    values = {"a": rng.normal(0, 1, 900), "b": np.repeat([3.0, 4.0], [400, 1]), "c": rng.normal(5, 1, 30), None: rng.normal(7, 1, 501), "d": np.asarray([2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double").repartition(5)
    for large in (0, 100, 1 << 20):
        got = {r["k"]: r for r in stats.error_stats(df, ["k"], "v", large=large).collect()}
        assert {k: (r["n"], r["p95_error"], r["max_error"]) for k, r in got.items()} == {k: (len(v), np.sort(v)[round(len(v) * 0.95 - 0.95)], v.max()) for k, v in values.items()}
        assert {r["k"]: r["m"] for r in stats.medians(df, ["k"], "v", "m", large=large).collect()} == pytest.approx({k: np.median(v) for k, v in values.items()})
    points = spark.createDataFrame([(f"d{i % 7}", f"s{i % 3}" if i % 5 else "rare", 2048 * (1 + i % 4), 10**9 + 10**6 * int(x), 4e8, None, 50.0, None, None, None, 32, 30, None, None, None, 100.0 + i % 11, 1e8 + i * i) for i, x in enumerate(rng.integers(0, 99, 80))], POINT)
    p = vram.memory_points(points)
    few, all_shuffled = (sorted(tuple(r) for r in vram.holdout_errors(p, large=n).collect()) for n in (18, 1 << 20))
    assert few == all_shuffled and len(few) == 80
    # The parts of a report are four: rows aren't shuffled to them.
    assert "SortMergeJoin [coalesce(part" not in vram.fit_report(points)._jdf.queryExecution().executedPlan().toString()


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(0, 1, 1000), "b": np.repeat([1.0, 2.0, 9.0], [500, 499, 1]), "c": np.asarray([5.0]), "d": np.asarray([1.0, 1e9, 1e9 + 1, -1e9])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    assert {r["k"]: (r["m"], r["n"]) for r in stats.medians(df, ["k"], "v", "m").collect()} == {k: (pytest.approx(np.median(v)), len(v)) for k, v in values.items()}
    third = stats.at_ranks(df, ["k"], "v", {"x": F.least(F.lit(2), F.col("_n") - 1)}).collect()
    assert {r["k"]: r["x"] for r in third} == {k: sorted(v)[min(2, len(v) - 1)] for k, v in values.items()}
    every = np.sort(np.concatenate(list(values.values())))
    assert stats.error_stats(df, [], "v").first()["p95_error"] == every[round(0.95 * (len(every) - 1))]


# ---- identity

@pytest.fixture
def customers(spark, tmp_path):
    """A folder whose customers repeat keys and have null nations, null segments and a null key."""
    rows = [(i % 40, None if i % 11 == 0 else i % 25, (None, "AUTO", "Build", "auto")[i % 4 if i % 3 else 1]) for i in range(90)] + [(None, 3, "AUTO"), (-3, 4, "AUTO")]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").repartition(2).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i,) for i in range(25)], "n_nationkey int").write.parquet(str(tmp_path / "nation.parquet"))
    return str(tmp_path)


def pairwise(spark, d):
    """Reasons of each pair of a customer and a nation by themselves."""
    pairs = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.expr("n_nationkey % 5 = c_nationkey % 5"))
    pairs = pairs.withColumn("family", F.lower("c_mktsegment")).selectExpr(
        "c_custkey", "n_nationkey", "family", "CASE c_custkey % 4 WHEN 0 THEN '7b' WHEN 1 THEN '7b-instruct' WHEN 2 THEN 'latest' ELSE 'v2' END AS tag",
        "CASE n_nationkey % 5 WHEN 0 THEN family || '-7b' WHEN 1 THEN family || '-7b-instruct' WHEN 2 THEN 'other-7b-gguf' WHEN 3 THEN family || '-v2-chat' ELSE family || '-13b' END AS name", "if(n_nationkey % 7 = 0, '', 'card') AS card",
    )
    return pairs.withColumn("reasons", identity.reasons(F.col("family"), F.col("tag"), F.col("name"), F.col("card")))


def in_order(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_statuses_of_repeated_and_null_targets(spark, customers):
    """One row a customer is dealt by key before least texts are sorted; repeated keys are one target."""
    got = plans.queries()["resolve_status"](spark, customers)
    assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()
    named = pairwise(spark, customers).withColumn("repo", F.expr("name || '@' || lpad(cast(n_nationkey AS string), 2, '0')"))
    assert in_order(got) == in_order(identity.resolve(named, ("c_custkey",)))


def test_reasons_are_worked_out_once_a_kind(spark, customers):
    """Whether a kind's customers are many (its facts broadcast) or few, each pair has the reasons that it has by itself."""
    got = plans.queries()["constraint_eval"](spark, customers)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all") > plan.index("Join")  # below the join with customers
    want = pairwise(spark, customers)
    assert in_order(got) == in_order(want.select("c_custkey", "n_nationkey", F.array_join("reasons", ",").alias("why")))
    targets = want.select("c_custkey", "family", "tag", "card")
    kinds = targets.groupBy("family", "tag").agg(F.count("*").alias("n"), F.min("card").alias("least"))
    of = [in_order(identity.of_each(targets, kinds, ("family", "tag"), large=large)) for large in (0, 60, 1 << 20)]
    assert of[0] == of[1] == of[2] and len(of[0]) == want.count()


# ---- publication

def test_guards(spark):
    c = spark.createDataFrame([(None, None, None, None, None)], "constants_version int, formula string, b0 double, b_tensor double, b_output double")
    with pytest.raises(Exception, match="got version none"):
        publish.memory_model(c).collect()
    assert publish.memory_model(spark.createDataFrame([(2, tables.FORMULA, None, None, None)], c.schema)).first()["b0"] == tables.BASELINE["b0"]
    with pytest.raises(Exception, match="schema_version must be 2, not 1"):
        publish.check_version(spark.createDataFrame([(1,)], "schema_version int")).collect()
    rows = spark.createDataFrame([("d",), ("d",)], "digest string")
    artifacts = spark.createDataFrame([], "digest string, status string, repo string, n_matches long")
    support = spark.createDataFrame([], "digest string, family string, decision_key string, repo string, method string")
    with pytest.raises(Exception, match="Duplicate digest: d"):
        publish.export_identity(rows, artifacts, support).collect()


def test_documents_are_replaced_in_one_move(spark, tmp_path):
    path = f"file://{tmp_path}/out.json"
    for n in (1, 2):
        files.publish_json(spark.createDataFrame([("b", n), ("a", n)], "k string, v long"), path)
    assert (tmp_path / "out.json").read_text() == '[{"k":"a","v":2},{"k":"b","v":2}]\n'
    assert {p.name for p in tmp_path.iterdir()} <= {"out.json", ".out.json.crc"} or all(p.name.startswith(".") for p in tmp_path.iterdir() if p.name != "out.json")


def test_stores_and_catalogs(spark, tmp_path):
    store = tmp_path / "store.jsonl"
    store.write_text("".join(json.dumps({"ref": f"r{i % 50}", "n": i}) + "\n" for i in range(2000)) + '{"ref": "r1", "n"')
    got = files.read_store(spark, f"file://{store}", "ref string, n long", "ref")
    assert got.columns == ["ref", "n"] and {r["ref"]: r["n"] for r in got.collect()} == {f"r{i}": 1950 + i for i in range(50)}
    (tmp_path / "m.json").write_text('{"models": [{"ref": "a", "n": 1}, {"ref": "b"}]}')
    (tmp_path / "m.jsonl").write_text('{"ref": "a", "n": 1}\n{"ref": "b"}\n')
    for name in ("m.json", "m.jsonl"):
        assert sorted(map(tuple, files.read_models(spark, f"file://{tmp_path}/{name}", "ref string, n long").collect()), key=str) == [("a", 1), ("b", None)]
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, v long")
    assert files.write_once(rows, f"file://{tmp_path}/once", "k").count() == 2
    files.write_once(spark.createDataFrame([("a", 9), ("c", 9), ("c", 9)], rows.schema), f"file://{tmp_path}/once", "k")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/once").collect()), key=str) == [("a", 1), ("b", None), ("c", 9)]
    files.write_jsonl(rows, f"file://{tmp_path}/lines", ["k"])
    files.write_csv(rows, f"file://{tmp_path}/csv")
    assert "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part*"))) == '{"k":"a","v":1}\n{"k":"b","v":null}\n'
    assert sorted("".join(p.read_text() for p in (tmp_path / "csv").glob("part*")).split()) == ["a,1", "b,", "k,v"] or "k,v" in "".join(p.read_text() for p in (tmp_path / "csv").glob("part*"))


def test_headers_are_read_in_growing_ranges(spark, tmp_path, monkeypatch):
    def s(x):
        return struct.pack("<Q", len(x)) + x.encode()

    head = b"GGUF" + struct.pack("<IQQ", 3, 1, 1) + s("general.name") + struct.pack("<I", 8) + s("x" * 300) + s("token_embd.weight") + struct.pack("<IQQIQ", 2, 3, 4, 0, 0)
    (tmp_path / "long.bin").write_bytes(head + bytes(5000))
    (tmp_path / "cut.bin").write_bytes(head[:200])
    monkeypatch.setattr(files, "FIRST_BYTES", 64)
    reads = []
    whole = files.decode_header
    monkeypatch.setattr(files, "decode_header", lambda data: reads.append(len(data)) or whole(data))
    assert files._header_of(f"file://{tmp_path}/long.bin", len(head) + 5000)["version"] == 3 and reads == [64, 256, 1024]
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_headers(spark, f"file://{tmp_path}").collect()}
    assert got["long.bin"]["tensors"][0]["dims"] == [3, 4] and got["cut.bin"]["error"] == "header is cut off"


def test_plans_of_identity(spark):
    queue = spark.createDataFrame([("f", "k1", "fetch_cards", ["o/a", "o/b"], 3), ("g", "k2", "fetch_cards", ["o/b"], 1), ("h", "k3", "review_conflict", [], 9)], "family string, decision_key string, action string, repos array<string>, digests long")
    assert [tuple(r) for r in evidence.fetch_plan(queue).collect()] == [("o/b", 4), ("o/a", 3)]
    ask = identity.prompt(F.lit("fam"), F.struct(F.lit(1).alias("a")), F.lit("o/r"), F.array(F.lit(""), F.lit("x" * 400)), F.lit("card"))
    told = one(spark, ask)
    assert told.startswith("Judge repository identity") and '["' + "x" * 300 + '"]' in told and told.endswith("Candidate model card:\ncard")
    calls = []

    def costly(kinds):
        calls.append(kinds.count())
        return kinds.withColumn("y", F.col("k") * 2)

    assert identity.once_per_key(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string"), ("k",), costly).agg(F.sum("y")).first()[0] == 8 and calls == [2]


def test_manifests_that_are_broken(spark):
    rows = [("m", str(i), b) for i, b in enumerate((None, "", "not json", '"text"', '{"layers": "x"}', '{"layers": null}', '{"layers": [{"mediaType": "a.image.model", "digest": "d", "size": 5}]}'))]
    got = {r["tag"]: (r["weight_digest"], r["projector_bytes"], r["error"]) for r in manifests.manifest_rows(spark.createDataFrame(rows, "model string, tag string, body string")).collect()}
    assert got["6"] == ("d", 0, None) and got["0"][2] == "manifest: missing" and got["4"][2] == "manifest layers is not a list" and got["5"][2] == "manifest has no model layer"
    assert all(got[k][2] == "manifest is not an object" for k in "123")
