"""Fixed values that are part of the semantics: weights, aliases, thresholds, word lists."""

from __future__ import annotations

# Names under which a benchmark appears, by canonical name; the first that matches wins.
BENCH_ALIASES = [
    ("aime24", ("aime 2024", "aime24", "aime 24", "aime2024")),
    ("aime25", ("aime 2025", "aime25", "aime 25", "aime2025", "aime25 (no tools)")),
    ("gpqa_diamond", ("gpqa-diamond", "gpqa diamond", "gpqa-d", "gpqa diamond (no tools)")),
    ("gpqa", ("gpqa", "gpqa (no tools)")),
    ("math500", ("math-500", "math 500", "math500")),
    ("mmlu_pro", ("mmlu-pro", "mmlu pro")),
    ("mmlu", ("mmlu",)),
    ("livecodebench", ("livecodebench", "live code bench", "lcb", "livecodebench (v5 2024-07 to 2024-12)")),
    ("swe_bench", ("swe-bench", "swe bench", "swe-bench pro", "swe bench pro")),
    ("humaneval", ("humaneval", "humanevalplus", "humaneval+", "humaneval plus")),
    ("ifeval", ("ifeval", "if eval", "ifeval (strict)")),
    ("mmmu", ("mmmu",)),
    ("bfcl", ("bfcl",)),
    ("mteb", ("mteb",)),
]

# Weights of the general suite and of the suites by use case.
INTELLIGENCE_SUITE = {
    "gpqa_diamond": 0.15,
    "aime25": 0.10,
    "aime24": 0.05,
    "livecodebench": 0.12,
    "humaneval": 0.08,
    "mmlu_pro": 0.20,
    "math500": 0.10,
    "swe_bench": 0.15,
    "bfcl": 0.05,
}
TASK_SUITES = {
    "chat": INTELLIGENCE_SUITE,
    "code": {"livecodebench": 0.40, "humaneval": 0.25, "swe_bench": 0.30, "bfcl": 0.05},
    "long": {"mmlu_pro": 0.40, "math500": 0.15, "gpqa_diamond": 0.20, "aime25": 0.10, "swe_bench": 0.15},
    "vision": {"mmmu": 0.50, "mmlu_pro": 0.20, "gpqa_diamond": 0.15, "livecodebench": 0.15},
    "embedding": {"mteb": 1.0},
}
TASK_REQUIRED = {"vision": ("mmmu",), "embedding": ("mteb",)}

# Share of quality that a storage format keeps, measured and for display.
QUANT_FACTORS = {"F16": 1.0, "Q8_0": 0.97, "Q6_K": 0.94, "Q5_K_M": 0.92, "Q4_K_M": 0.90, "Q4_0": 0.82, "Q3_K_M": 0.72, "Q2_K": 0.55}
QUANT_FACTOR_DEFAULT = 0.90
QUANT_QUALITY = {
    "F32": 1.0, "F16": 0.99, "BF16": 0.99, "Q8_0": 0.96, "Q6_K": 0.92,
    "Q5_K_M": 0.88, "Q5_K_S": 0.86, "Q5_1": 0.85, "Q5_0": 0.84,
    "Q4_K_M": 0.8, "Q4_K_S": 0.77, "Q4_1": 0.75, "Q4_0": 0.73,
    "Q3_K_L": 0.66, "Q3_K_M": 0.62, "Q3_K_S": 0.57, "Q2_K": 0.46,
}
QUANT_QUALITY_DEFAULT = 0.67

# Context lengths of the index, memory model and score constants.
CTX_POINTS = (2048, 4096, 8192, 16384, 32768, 65536, 131072)
GRAPH_BYTES_PER_HEAD_TOKEN = 2048
BASELINE = {"b0": -17_431_749.4, "b_tensor": 448_138.557, "b_output": -1.07380337}
FORMULA, CONSTANTS_VERSION, SCHEMA_VERSION = "capped_kv_graph_v2", 2, 2
SPEED_DEFAULTS = {"bw_eff_fraction": 0.75, "c_s_per_layer": 30e-6, "d_s": 1.5e-3, "prefill_derate": 0.3}
HALF_LIFE_YEARS = 1.1
RAM_GB = 32

# Size classes by parameters (below the bound).
SIZE_CLASSES = [
    ("micro", 3e8), ("tiny", 1e9), ("small", 3e9), ("compact", 7e9), ("medium", 14e9),
    ("large", 32e9), ("xl", 70e9), ("xxl", 120e9), ("huge", 400e9),
]

# Score weights by priority (capability, speed, match, fit).
PRIORITY_WEIGHTS = {"quality": (60, 6, 26, 18), "speed": (15, 52, 20, 18), "balanced": (50, 14, 26, 18)}

# Substrings that hint at a capability.
CODE_HINTS = ("code", "coder", "codellama", "starcoder", "codegemma", "deepseek-coder", "devstral", "magicoder", "phind", "sqlcoder")
EMBED_HINTS = (
    "embed", "embedding", "bge-", "e5-", "gte-", "nomic-embed", "snowflake-arctic-embed", "all-minilm", "paraphrase-", "sentence-transform",
)
REASON_HINTS = ("reason", "deepseek-r1", "qwq", "r1-", "r1:", "thinking", "marco-o1")

# First path segments that aren't owners; seconds until a fetch is tried again, by its outcome.
RESERVED_PATHS = (
    "datasets spaces papers blog learn collections docs tasks chat join pricing enterprise settings posts welcome "
    "inference-endpoints inference-api api organizations"
).split()
RETRY_SECONDS = {
    "ok": 30 * 86400, "not_found": 7 * 86400, "denied": 86400, "empty": 86400, "invalid_content": 86400, "too_large": 86400,
    "redirect_error": 86400, "http_error": 86400, "transient_error": 300, "rate_limited": 300, "deferred": 0,
}
RETRY_FLOOR = 60

# Trailing format token of a tag; modes of a release; words that name no release.
QUANT_SUFFIX = r"(?i)(?:^|[-_:])(?:f16|fp16|bf16|fp32|f32|fp8|q\d(?:_[a-z0-9]+){0,2}|iq\d(?:_[a-z0-9]+){0,2}|mxfp\d|nvfp\d)$"
MODES = ("base", "instruct", "chat", "thinking")
GENERIC = ("latest", "default")
CONVERTED = ("gguf", "gptq", "awq", "exl2")
SIZE_TOKEN = r"(?i)(?<![a-z0-9.])\d+(?:\.\d+)?(?:x\d+(?:\.\d+)?)?[bm](?![a-z0-9])"

# Names of stored formats by their number; words that name none; format token within a tag.
FILE_TYPES = {
    0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 7: "Q8_0", 8: "Q5_0", 9: "Q5_1",
    10: "Q2_K", 11: "Q3_K_S", 12: "Q3_K_M", 13: "Q3_K_L", 14: "Q4_K_S",
    15: "Q4_K_M", 16: "Q5_K_S", 17: "Q5_K_M", 18: "Q6_K", 32: "BF16",
}
NO_FORMAT = ("", "unknown", "none", "null", "n/a")
TAG_FORMAT = (
    r"(?i)(?:^|[-_:])(f32|f16|fp16|bf16|q[2-8](?:_[kK](?:_[smlSML])?)?|q[2-8]_[01]|"
    r"iq[1-4](?:_[a-z]+)?|mxfp[48]|nvfp4)(?:$|[-_:])"
)

# Endings of repository names that are files; metrics that stand in for each other where one is missing.
REJECTED_ENDINGS = (".md", ".py", ".json", ".png", ".svg", ".yaml", ".sh")
STAND_INS = {"gpqa_diamond": "gpqa", "gpqa": "gpqa_diamond", "mmlu_pro": "mmlu", "mmlu": "mmlu_pro", "math500": "math"}

# Where repositories are; what is said of a link by its confidence and by how it was found.
REPO_HOST = "huggingface.co"
REPO_SITE = "https://huggingface.co/"
CONFIDENCE_HINTS = {
    "semantic_verified": "model card and release evidence confirm this upstream repository",
    "provisional": "release-name match from the identity resolver, not semantically verified",
    "verified": "byte-identical file match",
}
METHOD_HINTS = {
    "github_llm": "found via the model's GitHub repo, not hash-verified",
    "homepage_llm": "found via the model's homepage, not hash-verified",
    "brave_search_verified": "found via web search, LLM-confirmed but not hash-verified",
    "brave_search": "found via web search, not hash-verified",
    "readme_verified": "named in the readme, LLM-confirmed but not hash-verified",
}
METHOD_HINT_DEFAULT = "named in the readme, not hash-verified"
PAGE_HINTS = {"github_llm": "found via the model's GitHub repo", "homepage_llm": "found via the model's homepage"}
PAGE_HINT_DEFAULT = "linked from the readme"
FAMILY_HINT = ", family-wide guess, not confirmed for this exact size"

# Widths and codes of scalar values in a binary header, by type number; its other types and the longest list that is kept whole.
HEADER_SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
HEADER_STRING, HEADER_ARRAY, LONGEST_ARRAY = 8, 9, 64
KEEP_ENDINGS = ("head_count_kv", "sliding_window_pattern", "head_count")

# Labels of signals and fits; device memory sizes that a query may name.
SIGNAL_LABELS = {"code": "Code-tuned signal", "vision": "Vision input", "embedding": "Embedding model", "reasoning": "Reasoning-tuned signal"}
FIT_LABELS = {"full": "Full GPU", "partial": "Partial offload", "none": "Doesn’t fit", "context": "Context too short"}
RAM_CHOICES = (8, 16, 32, 64, 128, 256)

# Names of the gates of a calibration.
GATE_LABELS = {
    "unflagged_share": "G3.2_unflagged_share_ge_0.9",
    "decode_fit": "G4.1_decode_r2_gt_0.95_n_ge_8",
    "memory_error": "G4.2_vram_max_rel_err_le_0.05",
    "expert_models": "G4.3_moe_active_within_30pct_total_off_5x",
    "windowed_models": "G4.4_swa_capped_kv_graph",
    "format_factors": "G4.5_quant_factors_in_0.4_1.3",
    "prefill_derate": "G4.6_prefill_derate_in_0.05_0.8",
    "partial_points": "G4.7_partial_points_ge_3",
}

# The task of a judge of identities.
JUDGE_TASK = (
    "Judge repository identity using only the supplied data. A related family, base model, "
    "quantization, descendant, benchmark mention, or comparison is not the exact release. "
    "Upstream means an original checkpoint/model repository, not a conversion or mirror. "
    "Use uncertain when the card does not establish a claim. Return one JSON object with "
    "exact_release and upstream set to yes/no/uncertain, quote copied verbatim from the card "
    "or empty, and a short reason."
)
