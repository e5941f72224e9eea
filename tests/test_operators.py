"""Operators and functions on small fixtures with results worked out by hand."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import capacity, text
from quarry.operators import catalog, evals, fitting, identity, joins, markdown, quality, stats
from quarry.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("tag", "release"),
    [("7b-q4_K_M", "f:7b"), ("q8_0", "f:default"), ("latest", "f:latest"), ("8b-instruct-fp16", "f:8b-instruct"), ("iq2_xxs", "f:default"), ("7b:mxfp4", "f:7b"), ("q4_0-x", "f:q4_0-x")],
)
def test_release_keys(spark, tag, release):
    assert one(spark, text.strip_suffix_key(F.lit("f"), F.lit(tag))) == release


@pytest.mark.parametrize(
    ("cell", "value"), [("**84.5**", 84.5), ("[1,234](http://x/9)", 1234.0), ("N/A", None), ("–", None), ("~ -3.5%", -3.5), ("", None), ("none", None)]
)
def test_numbers(spark, cell, value):
    assert one(spark, text.parse_number(F.lit(cell))) == value


@pytest.mark.parametrize(
    ("url", "repo"),
    [
        ("https://huggingface.co/org/name/tree/main", "org/name"), ("https://huggingface.co.evil.net/a/b", None), ("ftp://huggingface.co/a/b", None),
        ("https://huggingface.co/datasets/x", None), ("https://huggingface.co/a", None), ("not an address", None), ("https://huggingface.co/a/-b", None),
    ],
)
def test_repositories(spark, url, repo):
    assert one(spark, text.clean_repo(F.lit(url))) == repo


def test_features(spark):
    f = {k: one(spark, v) for k, v in text.features(F.lit("8x7B-Instruct v0.1 128k 1.5m latest")).items()}
    assert f == {"sizes": ["1.5m", "8x7b"], "modes": ["instruct"], "qualifiers": ["128k", "v0.1"]}


@pytest.mark.parametrize(
    ("name", "canon"),
    [("GPQA-Diamond (no tools)", "gpqa_diamond"), ("GPQA", "gpqa"), ("MMLU-Pro", "mmlu_pro"), ("MMLU redux", "mmlu"), ("Math", "math500"), ("nothing", None), ("AIME  2025", "aime25")],
)
def test_metric_names(spark, name, canon):
    assert one(spark, quality.canonical_metric(F.lit(name))) == canon


def test_quant_factors(spark):
    for q, want in (("Q4_K_M", 0.9), ("q4_k_s", 0.9), ("Q8_1", 0.97), ("F16", 1.0), ("ZZZ", 0.9), (None, 0.9), ("Q6_X", 0.94)):
        assert one(spark, capacity.quant_factor(F.lit(q))) == want


def test_size_classes(spark):
    for n, want in ((None, "unknown"), (0, "unknown"), (299_999_999, "micro"), (300_000_000, "tiny"), (7 * 10**9, "medium"), (4 * 10**11, "frontier")):
        assert one(spark, text.size_class(F.lit(n).cast("long"))) == want


def test_capacity(spark):
    col = F.lit
    assert one(spark, capacity.effective_ctx(col(8192), col(4096))) == 4096 and one(spark, capacity.effective_ctx(col(2048), col(4096))) == 2048
    mixed = capacity.graph_bytes(col(8192), col(32), col(30), col(25), col(5), col(1024))
    assert one(spark, mixed) == pytest.approx(2048 * 33 * (25 * 1024 + 5 * 8192) / 30)
    assert one(spark, capacity.graph_bytes(col(8192), col(32), col(30), col(0), col(30), col(0))) == 2048 * 33 * 8192
    assert one(spark, capacity.baseline_bytes(col(10), col(100.0), col(None).cast("double"))) == pytest.approx(tables.BASELINE["b0"] + 4481385.57 - 107.380337)
    assert one(spark, capacity.baseline_bytes(col(10), col(100.0), col(5.0))) == 5
    assert one(spark, capacity.predict_vram(col(1.0), col(0.0), col(0.5), col(1.0), col(0.0))) == 2  # half to even
    local, full = capacity.kv_slopes(col(3.0), col(0), col(None).cast("double"), col(None).cast("double"))
    assert (one(spark, local), one(spark, full)) == (0, 3)
    for ctx_max, vram, want in ((4096, 5.0, "context"), (8192, 5.0, "full"), (8192, 20.0, "partial"), (8192, 60.0, "none")):
        assert one(spark, capacity.fit_for(col(ctx_max), col(8192), col(vram), col(10.0), col(vram), col(32.0))) == want


def test_age_decay_halves(spark):
    assert one(spark, capacity.age_decay(F.lit(1.1))) == pytest.approx(0.5)


def test_last_write_wins_and_fallbacks(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, seq int, v string")
    assert sorted(map(tuple, joins.last_write_wins(log, ["k"], ["seq"]).collect())) == [("a", 2, None), ("b", 1, "y")]
    table = spark.createDataFrame([("m:q4", "exact"), ("m:latest", "latest")], "ref string, v string")
    rows = spark.createDataFrame([("m:q4",), ("m",), ("z",)], "want string")
    got = joins.fallback_lookup(rows, [F.col("want"), F.concat("want", F.lit(":latest"))], table, "ref", "v", "hit").collect()
    assert {r["want"]: r["hit"] for r in got} == {"m:q4": "exact", "m": "latest", "z": None}


def test_least_squares_recover_coefficients(spark):
    rng = np.random.default_rng(0)
    x1, x2 = rng.uniform(1e9, 1e10, 200), rng.uniform(10, 90, 200)
    y = 3.0 + 2e-9 * x1 + 0.5 * x2
    df = spark.createDataFrame([("g", float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y, strict=True)], "g string, x1 double, x2 double, y double")
    r = fitting.ols2(df, ["g"], "x1", "x2", "y").first()
    assert (r["b0"], r["b1"] * 1e9, r["b2"], r["r2"]) == pytest.approx((3, 2, 0.5, 1), rel=1e-6)
    flat = df.withColumn("x2", F.col("x1") * 2)
    assert fitting.ols2(flat, ["g"], "x1", "x2", "y").first()["n"] == 200


def test_group_holdout_equals_refits(spark):
    rng = np.random.default_rng(1)
    g, x = rng.integers(0, 5, 300), rng.uniform(0, 100, 300)
    y = 4 + 1.5 * x + rng.normal(0, 3, 300)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y, strict=True)], "g long, x double, y double")
    for r in fitting.group_holdout(df, "g", "x", "y").collect():
        keep = g != r["g"]
        slope, intercept = np.polyfit(x[keep], y[keep], 1)
        assert (r["slope"], r["intercept"], r["n_train"]) == pytest.approx((slope, intercept, keep.sum()))


def test_p95_is_by_rounded_index(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 12)], "g string, e double")
    r = stats.error_stats(df, ["g"], "e").first()
    assert (r["max_error"], r["p95_error"], r["n"]) == (11, 11, 11)


def test_population_of_one(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("b", 1.0)], "m string, v double")
    got = {r["m"]: r["pop_std"] for r in stats.population(df, ["m"], "v").collect()}
    assert got == {"a": 1.0, "b": 1e-6}


TABLE = """intro
| Benchmark | Model 7B | [Model-it](http://x) |
|---|:---:|---|
| MMLU | **70.5** | 71 |
| GPQA Diamond | N/A | 40,5 |
| mmlu | 72 | - |
text
| lonely |
| a | b |
"""


def test_markdown_tables(spark):
    df = spark.createDataFrame([("d", TABLE), ("e", ""), ("f", None)], "k string, t string")
    got = sorted(markdown.benchmark_tables(df, "k", "t").collect(), key=lambda r: r["header"])
    assert [(r["header"], r["benchmarks"]) for r in got] == [("Model 7B", {"mmlu": 72.0}), ("Model-it", {"gpqa_diamond": 405.0, "mmlu": 71.0})]


def test_suites(spark):
    rows = spark.createDataFrame([("a", {"mmlu_pro": 50.0, "mteb": 10.0}), ("b", {"mmlu_pro": 100.0}), ("c", {"x": 1.0})], "id string, benchmarks map<string,double>")
    got = {(r["id"], r["suite"]): r["score"] for r in quality.suite_scores(rows, "id", tables.TASK_SUITES, tables.TASK_REQUIRED).collect()}
    assert got[("a", "chat")] == 0 and got[("b", "chat")] == 100 and got[("a", "embedding")] == 10 and ("b", "embedding") not in got and ("b", "vision") not in got
    named = rows.select(F.col("id").alias("eval_id"), F.lit("f").alias("family"), F.lit(None).cast("double").alias("size_b"), F.lit("unknown").alias("variant"), F.lit("web").alias("source"), "benchmarks")
    base = {r["eval_id"]: r["q_base"] for r in evals.base_scores(named).collect()}
    assert base == {"a": 0.0, "b": 100.0, "c": 50.0}


@pytest.mark.parametrize(
    ("tag", "name", "card", "want"),
    [
        ("7b", "Fam-7B", "c", []), ("7b", "Fam-7B", "", ["model_card_unavailable"]), ("7b", "Fam-13B", "c", ["size_mismatch_or_missing"]), ("7b", "Fam-7B-Instruct", "c", ["variant_unspecified"]),
        ("7b-chat", "Fam-7B", "c", ["variant_mismatch_or_missing"]), ("latest", "fam", "c", ["unspecified_release"]),
        ("7b", "Other-7B-GGUF", "c", ["family_name_not_confirmed", "converted_repository_not_canonical"]), ("7b", "Fam-7B-v2", "c", ["version_unspecified"]), ("7b-v2", "Fam-7B", "c", ["release_qualifier_missing"]),
    ],
)
def test_reasons(spark, tag, name, card, want):
    assert one(spark, identity.reasons(F.lit("fam"), F.lit(tag), F.lit(name), F.lit(card))) == want


def test_resolution(spark):
    rows = [("a", "r1", []), ("b", "r1", []), ("b", "r2", ["model_card_unavailable"]), ("c", "r1", []), ("c", "r2", ["variant_unspecified"]), ("d", "r1", ["size_mismatch_or_missing"])]
    df = spark.createDataFrame(rows, "tag string, repo string, reasons array<string>")
    got = {r["tag"]: (r["status"], r["repo"]) for r in identity.resolve(df, keys=("tag",)).collect()}
    assert got == {"a": ("likely", "r1"), "b": ("ambiguous", None), "c": ("unresolved", None), "d": ("unresolved", None)}


def test_find_query_takes_known_values_only():
    q = catalog.FindQuery.from_params({"mode": "explore", "priority": "best", "ctx": "4096", "limit": "-1", "sizes": "tiny,odd", "allow_partial": "1", "zzz": 1})
    assert (q.mode, q.priority, q.ctx, q.limit, q.sizes, q.allow_partial) == ("explore", "balanced", 4096, 18, ("tiny",), True)


def header_bytes(meta, tensors):
    """A header as a writer would make it."""
    def text_(s):
        return struct.pack("<Q", len(s)) + s.encode()

    def value(kind, v):
        if kind == 8:
            return text_(v)
        if kind == 9:
            inner, items = v
            return struct.pack("<IQ", inner, len(items)) + b"".join(value(inner, x) for x in items)
        return struct.pack("<" + tables.HEADER_SCALARS[kind], v)

    out = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(meta))
    out += b"".join(text_(k) + struct.pack("<I", kind) + value(kind, v) for k, kind, v in meta)
    out += b"".join(text_(n) + struct.pack("<I", len(d)) + struct.pack(f"<{len(d)}Q", *d) + struct.pack("<IQ", kind, off) for n, d, kind, off in tensors)
    return out + bytes(-len(out) % 32)


def test_binary_headers(spark, tmp_path):
    meta = [("a.u8", 0, 7), ("a.i8", 1, -7), ("a.f", 6, 0.5), ("a.b", 7, True), ("a.s", 8, "x"), ("a.q", 10, 1 << 40), ("a.d", 12, 0.25), ("a.long", 9, (4, list(range(70)))), ("a.head_count_kv", 9, (4, list(range(70)))), ("a.words", 9, (8, ["p", "q"]))]
    tensors = [("token_embd.weight", [4, 8], 0, 0), ("blk.0.attn_q.weight", [8], 0, 128), ("output.weight", [8, 2], 0, 160)]
    (tmp_path / "ok.bin").write_bytes(header_bytes(meta, tensors) + bytes(300))
    (tmp_path / "bad.bin").write_bytes(b"nothing here")
    (tmp_path / "cut.bin").write_bytes(header_bytes(meta, tensors)[:90])
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.read_headers(spark, f"file://{tmp_path}").collect()}
    ok = rows["ok.bin"]
    assert ok["metadata"]["a.q"] == str(1 << 40) and ok["metadata"]["a.long"] == '{"length": 70}' and ok["metadata"]["a.head_count_kv"].count(",") == 69 and ok["metadata"]["a.b"] == "true"
    assert rows["bad.bin"]["error"] and rows["cut.bin"]["error"] and ok["error"] is None
    sizes = files.tensor_sizes(files.read_headers(spark, f"file://{tmp_path}").where("error IS NULL"))
    assert {r["name"]: (r["params"], r["bytes"]) for r in sizes.collect()} == {"token_embd.weight": (32, 128), "blk.0.attn_q.weight": (8, 32), "output.weight": (16, 140)}
    assert {r["group"]: r["bytes"] for r in files.group_bytes(sizes).collect()} == {"token_embd": 128, "attn": 32, "output": 140}


def test_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"ref":"a","n":1}\n\n{"ref":"a","n":2}\n{"ref":"b","n":5}\n{"ref":"c","n"')
    got = files.read_store(spark, f"file://{tmp_path}/s.jsonl", "ref string, n int", "ref", ["n"])
    assert {r["ref"]: r["n"] for r in got.collect()} == {"a": 2, "b": 5}
    (tmp_path / "g.csv").write_text("id,name,vendor,type,generation,memory_gb,usable_fraction,bandwidth_gbs,fp16_tflops,notes\nx,X,v,t,g,24,0.9,,,\n")
    g = files.read_gpus(spark, f"file://{tmp_path}/g.csv").first()
    assert (g["memory_gb"], g["bandwidth_gbs"], g["notes"]) == (24.0, None, None)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "fam.json").write_text('{"v": 1}')
    assert tuple(files.read_documents(spark, f"file://{tmp_path}/d", "v int").first()) == ("fam", 1)
    for _ in range(2):
        files.publish_json(got.select("ref", "n"), f"file://{tmp_path}/out.json")
        assert (tmp_path / "out.json").read_text() == '[{"n":2,"ref":"a"},{"n":5,"ref":"b"}]\n'
    a, b = spark.createDataFrame([("k", None, 1)], "key string, x string, y int"), spark.createDataFrame([("k", "lib", 2), ("l", "lib", 3)], "key string, x string, y int")
    assert {r["key"]: (r["x"], r["y"]) for r in files.rows_first(a, b, "key").collect()} == {"k": (None, 1), "l": ("lib", 3)}
    cache = spark.sql("SELECT 1 AS id, timestamp'2024-01-01 00:00:00' AS at UNION ALL SELECT 2, timestamp'2024-01-02 00:00:00' UNION ALL SELECT 3, null")
    fresh, stale = files.split_fresh(cache, "at", 3600, F.lit("2024-01-02 00:30:00").cast("timestamp"))
    assert [r["id"] for r in fresh.collect()] == [2] and sorted(r["id"] for r in stale.collect()) == [1, 3]


def test_header_facts(spark, tmp_path):
    meta = [
        ("general.architecture", 8, "g"), ("g.block_count", 4, 6), ("g.embedding_length", 4, 64), ("g.attention.head_count", 4, 8), ("g.attention.head_count_kv", 9, (4, [2, 4])), ("g.attention.key_length", 4, 16),
        ("g.attention.sliding_window", 4, 512), ("g.attention.sliding_window_pattern", 9, (7, [True, True, False])), ("g.attention.shared_kv_layers", 4, 2), ("g.attention.key_length_swa", 4, 4),
        ("g.expert_count", 4, 8), ("g.expert_used_count", 4, 2), ("g.context_length", 4, 8192),
    ]
    tensors = [("per_layer_token_embd.weight", [10], 0, 0), ("blk.0.ffn_up_exps.weight", [2, 100], 0, 64), ("blk.0.attn_q.weight", [50], 0, 864), ("v.enc", [7], 0, 1064)]
    (tmp_path / "h.bin").write_bytes(header_bytes(meta, tensors) + bytes(1100))
    r = files.header_facts(files.read_headers(spark, f"file://{tmp_path}")).first()
    # Heads 2 4 4 4 4 4; four layers hold a cache; windows in layers 1 and 2, then the last value, no window.
    assert (r["n_layer"], r["n_kv_alloc_layers"], r["kv_heads_sum"], r["n_swa_layers"], r["n_global_layers"]) == (6, 4, 14, 2, 4)
    assert r["kv_local_bytes_per_token"] == (2 + 4) * (4 + 8) * 2 and r["kv_global_bytes_per_token"] == (4 + 4) * (16 + 8) * 2
    assert (r["params"], r["tensor_count"], r["gpu_tensor_count"], r["ple_bytes"], r["expert_bytes"]) == (267, 4, 2, 64, 800)
    assert r["active_params"] == 257 - 200 + 50 and r["active_weight_bytes"] == r["weight_bytes"] - 64 - 800 + 200


def test_formats(spark):
    show = lambda f, *v: [one(spark, f(F.lit(x))) for x in v]
    assert show(text.format_params, 8_030_000_000, 1_540_000_000, 70_600_000_000, 270_400_000, 1_250_000_000_000, 12 * 10**12, 0) == ["8B", "1.5B", "71B", "270M", "1.3T", "12T", "—"]
    assert show(text.format_bytes, 950_400_000, 4_370_000_000, 39_600_000_000) == ["950 MB", "4.37 GB", "39.6 GB"]
    assert show(text.format_ctx, 512, 8192, 1536, 0) == ["512", "8k", "1.5k", "—"]
    assert show(text.format_speed, 6.24, 164.6) == ["6.2 tok/s", "165 tok/s"]
    assert one(spark, text.attention_label(F.lit(1024), F.lit(5))) == "hybrid 1k SWA + global" and one(spark, text.attention_label(F.lit(0), F.lit(5))) == "dense attention"
    assert one(spark, text.has_token(F.lit("NVIDIA_L4"), "L4")) and not one(spark, text.has_token(F.lit("NVIDIA L40S"), "L4"))
    assert one(spark, text.device_group(F.lit("nvidia"), F.lit("rtx4090"))) == "GeForce / RTX"


def test_page_copy(spark):
    html = """<meta name="description" content="A &amp; B"><textarea id="editor" rows=2># T &lt;x&gt;\n![i](/assets/a.png)</textarea>"""
    description, readme = text.page_copy(F.lit(html), "https://site.example")
    assert one(spark, description) == "A & B" and one(spark, readme) == "# T <x>\n![i](https://site.example/assets/a.png)"
    other, _ = text.page_copy(F.lit("<textarea id='summary-textarea'>" + "x" * 300 + "</textarea>"), "s")
    assert one(spark, other) == "x" * 255
