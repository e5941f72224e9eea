"""Queries opN_<name>: each operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, decontaminate, fim, language, linededup, media, minhash, packing, quality, repair, sitetree, tokens, toxicity
from quarry.llm.common import table


def _remainder(k: int):
    """crc32 of doc_id as text, modulo k."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.fit_quality(docs, table(spark, sf_dir, "labels"), "crc32(cast(doc_id as string)) % 5 != 0")
    return quality.score_quality(docs, net).select(
        "doc_id", (_remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), "crc32(cast(doc_id as string)) % 3 != 1")
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        (_remainder(3) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), language.fit_languages(table(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: A conversation whose texts say what the template's own markers say.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's layout and the added record's are each found by fingerprint; their canonical turns are rendered together."""
    rows = chat.turns_of_rows(table(spark, sf_dir, "conversations"))
    record = json.dumps({"messages": [{"role": r, "content": CONTROL} for r in ("user", "assistant")]})
    added = chat.turns_of_records(spark.createDataFrame([(-1, record)], "conv_id long, record string"))
    return chat.chat_digest(chat.render(rows.unionByName(added.select("conv_id", "turns"))))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return repair.with_untouched(repair.repair_digest(repair.damage(talks)), talks)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digest(table(spark, sf_dir, "documents"))


def op13_sitetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_media": op2_media,
        "op3_decontaminate": op3_decontaminate,
        "op4_toxicity": op4_toxicity,
        "op5_linededup": op5_linededup,
        "op6_language": op6_language,
        "op7_packing": op7_packing,
        "op8_chat": op8_chat,
        "op9_tokens": op9_tokens,
        "op10_minhash": op10_minhash,
        "op11_repair": op11_repair,
        "op12_fim": op12_fim,
        "op13_sitetree": op13_sitetree,
    }


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(32 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS bigint) AS formatted_chars
FROM turns GROUP BY conv_id
"""


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(list_zip(range(len(l)), l)) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), words AS (
  SELECT doc_id, x[1] AS line_no, x[2] AS line, list_filter(regexp_split_to_array(lower(x[2]), '\s+'), lambda w: w <> '') AS w FROM lines
), runs AS (
  SELECT DISTINCT doc_id, line_no, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS run FROM words WHERE len(w) > 0
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, line_no) AS n FROM runs
), gone AS (
  SELECT DISTINCT doc_id, line_no FROM (
    SELECT a.doc_id, a.line_no, a.n AS n, b.n AS m, count(*) AS c
    FROM sized a JOIN sized b ON a.run = b.run AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.line_no < a.line_no))
    GROUP BY a.doc_id, a.line_no, a.n, b.doc_id, b.line_no, b.n)
  WHERE 100 * c >= 80 * (n + m - c)
)
SELECT w.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed,
  coalesce(string_agg(w.line, chr(10) ORDER BY w.line_no) FILTER (g.line_no IS NULL), '') AS text
FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.line_no = g.line_no GROUP BY w.doc_id
"""


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), reach(doc, root) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.doc = l.a
)
SELECT s.doc_id, CAST(len(s) AS bigint) AS n_shingles, min(root) AS component_id, s.doc_id = min(root) AS kept
FROM s JOIN reach ON reach.doc = s.doc_id GROUP BY s.doc_id, s.s
"""


def _repair_sql() -> str:
    """The program over whole audits: a recursive step for each row, a (cost, audit) for each state, the least of all ways.

    States: nothing yet, s, u, a. An insertion may stand before any edit; two may stand at the end.
    """
    to = {"n": "n", "s": "s", "u": "u", "a": "a"}
    after = {"n": "u", "s": "u", "u": "a", "a": "u"}
    ways: dict[str, list[str]] = {q: [] for q in to}
    add = lambda q, p, c, e, when: ways[q].append(f"CASE WHEN {when} THEN {{'c': {p}.c + {c}, 'e': {p}.e || '{e}'}} END")
    for p in to:
        for n in (0, 1, 2):
            q = p
            for _ in range(n):
                q = after[q]
            run = "I" * n
            add(q, p, 2 * n + 3, run + "D", "true")
            add(after[q], p, f"{2 * n + 2} + t", run + "R", "may")
            if q == "n":
                add("s", p, f"{2 * n} + t", run + "K", "may AND i = 's'")
            add(after[q], p, f"{2 * n} + t", run + "K", f"may AND i = '{after[q]}'")
    least = lambda xs: f"list_sort(list_filter([{', '.join(xs)}], lambda w: w.c IS NOT NULL))[1]"
    step = ", ".join(f"{least(w)} AS {q}" for q, w in ways.items())
    ends = least(["n", "a", "{'c': u.c + 2, 'e': u.e || 'I'}", "{'c': s.c + 4, 'e': s.e || 'II'}"])
    return rf"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), drawn AS (
  SELECT keyed.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda j: CAST(ord(substr(k, CAST(j AS INT), 1)) AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 20 AS d FROM keyed, bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE d <> 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS r, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
), faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY r) AS before FROM ranked
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (r > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS height, list(role ORDER BY r) AS roles, list(text ORDER BY r) AS texts
  FROM faulty GROUP BY conv_id
), walk(conv_id, r, n, s, u, a) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'e': ''}}, CAST(NULL AS STRUCT(c INTEGER, e VARCHAR)), CAST(NULL AS STRUCT(c INTEGER, e VARCHAR)), CAST(NULL AS STRUCT(c INTEGER, e VARCHAR)) FROM facts
  UNION ALL
  SELECT conv_id, r, {step} FROM (
    SELECT walk.*  REPLACE (walk.r + 1 AS r), f.i, f.fault NOT IN ('blank', 'duplicate') AS may, CASE WHEN f.fault = 'truncated' THEN 1 ELSE 0 END AS t
    FROM walk JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.r = walk.r + 1)
), done AS (
  SELECT f.*, {ends} AS w FROM walk JOIN facts f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.height = walk.r
), put AS (
  SELECT conv_id, w.e AS audit, length(replace(w.e, 'D', '')) AS size, j, substr(w.e, CAST(j AS INT), 1) AS e, roles[length(replace(substr(w.e, 1, CAST(j AS INT)), 'I', ''))] AS role,
    texts[length(replace(substr(w.e, 1, CAST(j AS INT)), 'I', ''))] AS text, length(replace(substr(w.e, 1, CAST(j AS INT)), 'D', '')) AS place
  FROM (SELECT *, unnest(range(1, length(w.e) + 1)) AS j FROM done)
), lines AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (size - place) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS s
  FROM put WHERE e <> 'D' GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(w.c, 0) AS BIGINT) AS cost, coalesce(w.e, '') AS audit, sha256(coalesce(s, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""


FIM_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, CAST(i AS INT), 8) AS BIGINT)) AS x FROM units
), cuts AS (
  SELECT *, list_sort([x[1] % (n + 1), x[2] % (n + 1)]) AS c,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), places AS (
  SELECT doc_id, n, text, form, CAST(coalesce(list_sum(list_transform(u[1:c[1]], lambda w: length(w))), 0) AS BIGINT) AS p, CAST(coalesce(list_sum(list_transform(u[1:c[2]], lambda w: length(w))), 0) AS BIGINT) AS q FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || left(text, p) || '<S>' || substr(text, q + 1) || '<M>' || substr(text, p + 1, q - p)
    ELSE '<S>' || substr(text, q + 1) || '<P>' || left(text, p) || '<M>' || substr(text, p + 1, q - p) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM places
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_linededup": LINES_SQL, "op8_chat": CHAT_SQL, "op10_minhash": NEAR_SQL, "op11_repair": _repair_sql(), "op12_fim": FIM_SQL}
