"""Fill-in-middle: texts cut at word boundaries and put into another order, by DuckDB SQL over Arrow batches.

Each batch is registered as a table of a DuckDB session that the worker keeps;
units are found by regexp_extract_all, parts are list slices joined again, and
choices come from the SHA-256 of the document's id. Nothing runs row by row in
Python, and nothing is shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: White space with the word behind it, or white space that no word follows.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Texts are handed to SQL in runs of so many bytes; a longer text is a run of its own.
SLICE_BYTES = 4 << 20
_sessions: dict[int, object] = {}


@dataclass(frozen=True)
class Plan:
    """Percent of texts that are cut, percent of those with the suffix first, and what goes before the id in the hash."""

    cut_percent: int = 50
    suffix_first_percent: int = 80
    seed: str = "42"


def cut_sql(plan: Plan, batch: str = "batch") -> str:
    """doc_id, n, form, prefix_chars, middle_chars and output of the rows of batch(doc_id, text)."""
    group = lambda k: f"CAST('0x' || substr(h, {8 * k - 7}, 8) AS BIGINT)"
    seed = plan.seed.replace("'", "''")
    return f"""
WITH units AS (
  SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS u, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {batch}
), drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, {group(1)} % (len(u) + 1) AS a, {group(2)} % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {group(3)} % 100 >= {plan.cut_percent} THEN 'plain'
      WHEN {group(4)} % 100 < {plan.suffix_first_percent} THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT doc_id, n, form, text,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, least(a, b)), '') END AS prefix,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') END AS middle,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, greatest(a, b) + 1, n), '') END AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
  CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
FROM parts"""


def restore_sql(batch: str = "batch") -> str:
    """All columns of batch and restored, the text that output and form stand for.

    No text that is cut holds a marker, and no marker begins inside another, so
    the first occurrence of each is the one that was put in.
    """
    first = f"CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END"
    return f"""
WITH halves AS (
  SELECT *, CASE WHEN form <> 'plain' THEN substr(output, {len(PREFIX) + 1}, instr(output, {first}) - {len(PREFIX) + 1}) END AS one,
    CASE WHEN form <> 'plain' THEN substr(output, instr(output, {first}) + {len(SUFFIX)}) END AS rest
  FROM {batch}
), thirds AS (
  SELECT *, substr(rest, 1, instr(rest, '{MIDDLE}') - 1) AS two, substr(rest, instr(rest, '{MIDDLE}') + {len(MIDDLE)}) AS three FROM halves
)
SELECT * EXCLUDE (one, rest, two, three), CASE form WHEN 'plain' THEN output WHEN 'psm' THEN one || three || two ELSE two || three || one END AS restored FROM thirds"""


def _session():
    """The worker's DuckDB session: one thread, as Spark runs one task on each core."""
    pid = os.getpid()
    if pid not in _sessions:
        import duckdb

        _sessions[pid] = duckdb.connect(":memory:", config={"threads": 1})
    return _sessions[pid]


def _in_sql(df: DataFrame, query: str, text: str, schema: str) -> DataFrame:
    """query over each slice of df's batches, which it knows as batch. Slices are cut by the bytes of column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _session()
        for whole in batches:
            for part in slices(whole, text, SLICE_BYTES):
                con.register("batch", pa.Table.from_batches([part]))
                try:
                    out = con.sql(query).to_arrow_table()
                finally:
                    con.unregister("batch")
                yield from out.to_batches()

    return df.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output, a row for each row of docs.

    A null text is empty; an empty text, and one that holds a marker, stays
    plain. prefix_chars and middle_chars count code points and are null for
    plain texts. Equal ids draw alike, so repeated rows give equal rows; a null
    doc_id hashes as an empty one and stays null. Texts of any length are cut
    as a whole; other columns are dropped; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return _in_sql(rows, cut_sql(plan), "text", "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(cut: DataFrame) -> DataFrame:
    """Adds restored, the exact text, read from output and form of fill_in_middle alone; a column of that name is replaced."""
    rows = cut.drop("restored")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return _in_sql(rows, restore_sql(), "output", f"{schema}, restored string")


def fim_digest(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """Counts, and digests of outputs and of the texts read back from them; rows and odd input as in fill_in_middle."""
    rows = fill_in_middle(docs, plan)
    query = f"SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({restore_sql()})"
    return _in_sql(rows, query, "output", "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
