"""Token ids of whole texts by the tokenizers library, and their columnar file format.

Byte-level BPE splits a text at every single space or line feed between two
non-space characters before it merges, so the ids of such a piece don't depend
on its surroundings. Its pattern also ends a run of letters at a mark such as a
comma or a full stop, so a piece is cut there too. Natural text repeats its
pieces: each worker keeps the library's ids by piece in a table of fixed size,
which numpy reads for many pieces at once (compared in full, not by hash
alone), and asks the library for the others, each distinct one once. A text
with runs of white space, or with the string of a special token, is given to
the library as a whole.
"""

from __future__ import annotations

import json
import re
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import give_back, shuffle_partitions, slices, texts, tidy, work_path

END_ID = 2
#: A worker's table of remembered pieces: rows (a power of two), bytes of the longest piece and ids of the longest row, so that it
#: takes some 52 MB at most. Of pieces that fall on one row the last one stays; others are encoded anew, with the same ids.
ROWS, PIECE_BYTES, PIECE_IDS = 1 << 20, 32, 8
#: Pieces that numpy handles at a time, so that memory doesn't grow with a text.
BLOCK = 1 << 19
MASKED = 1 << 15
#: New pieces in one call of the library, which takes some hundred bytes for each of its characters.
CALL = 1 << 13
IDLE = 3.0
_RUNS = re.compile(r"\s\s")
_OPEN, _MARKS = b" \n", bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)  # an apostrophe may go on with letters
#: A space or a line feed and letters up to U+027F; such words as the model has them, which stands printable characters for bytes.
_WORD = re.compile(rb"[ \n](?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9][\x80-\xbf])+")
_SHOWN = [c for c in range(256) if 33 <= c < 127 or 161 <= c < 256 and c != 173]
_SHOWS = {c: chr(c) for c in _SHOWN} | {c: chr(256 + k) for k, c in enumerate(c for c in range(256) if c not in _SHOWN)}
_LETTERS = "".join(_SHOWS[c] for c in range(256) if chr(c).isalpha() and c < 128 or 0x80 <= c <= 0xBF or 0xC3 <= c <= 0xC9)
_ACROSS = re.compile(f"[{_LETTERS}\u0120\u010a]*(?:[{_LETTERS}][\u0120\u010a]|\u010a[{_LETTERS}])[{_LETTERS}\u0120\u010a]*")
#: By byte: 1 for a letter, 2 for a mark that no pattern joins to a letter before it, 4 for what a piece may begin with.
_KIND = np.asarray([1 if chr(c).isalpha() and c < 128 else 2 if c in _MARKS else 4 if c in _OPEN else 0 for c in range(256)], np.uint8)
_encoders: dict[str, "PieceEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Table:
    """ids by piece. A row has a piece's bytes as four numbers, its size (0: none) and its ids."""

    def __init__(self, rows: int, highest: int) -> None:
        self.keys = np.zeros((rows, PIECE_BYTES // 8), np.uint64)
        self.sizes, self.counts = np.zeros(rows, np.uint8), np.zeros(rows, np.uint8)
        self.ids = np.zeros((rows, PIECE_IDS), np.uint16 if highest < 1 << 16 else np.uint32)

    def rows(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed & np.uint64(len(self.sizes) - 1)).astype(np.int64)

    def has(self, rows: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (self.sizes[rows] == sizes) & (self.keys[rows] == keys).all(axis=1)

    def read(self, rows: np.ndarray) -> np.ndarray:
        """ids of these rows, one after the other."""
        return self.ids[rows][np.arange(PIECE_IDS) < self.counts[rows][:, None]]

    def put(self, rows: np.ndarray, keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Pieces and their ids, one after the other; those that are too long are left out."""
        fit = (sizes <= PIECE_BYTES) & (counts <= PIECE_IDS)
        wide = np.zeros((int(fit.sum()), PIECE_IDS), self.ids.dtype)
        wide[np.arange(PIECE_IDS) < counts[fit][:, None]] = ids[np.repeat(fit, counts)]
        order = np.argsort(rows[fit], kind="stable")
        at = rows[fit][order]
        last = np.append(at[1:] != at[:-1], True)[: len(at)]
        at, one = at[last], order[last]
        self.keys[at], self.ids[at] = keys[fit][one], wide[one]
        self.sizes[at], self.counts[at] = sizes[fit][one], counts[fit][one]


class PieceEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Ids whose token begins with a space or a line feed, as only the first token of a piece does.
        vocabulary = self.tokenizer.get_vocab()
        self.highest = max(vocabulary.values())
        self.begins = np.zeros(self.highest + 1, bool)
        for token, i in vocabulary.items():
            self.begins[i] = token[:1] in ("\u0120", "\u010a")
        with open(path, encoding="utf-8") as f:
            splits = json.load(f).get("pre_tokenizer") or {}
        self.cuts = splits.get("type") == "ByteLevel" and splits.get("use_regex", True)
        # No token of such words goes on from a letter to a space, so the model merges words in a row as it does each alone.
        joins = self.cuts and not self.tokenizer.normalizer and not any(map(_ACROSS.fullmatch, vocabulary))
        self.model = Tokenizer(self.tokenizer.model) if joins else None
        self.uses = 0
        self.table: Table | None = None

    @property
    def now(self) -> list[bytes]:
        """The pieces that are remembered."""
        t = self.table
        return [] if t is None else [t.keys[i].tobytes()[: t.sizes[i]] for i in np.flatnonzero(t.sizes)]

    def rest(self) -> None:
        """Forget all pieces unless they are used again within IDLE seconds: workers live on in other stages, which need the memory."""
        uses = self.uses

        def forget() -> None:
            if self.uses == uses:
                self.table = None
                give_back()

        timer = threading.Timer(IDLE, forget)
        timer.daemon = True
        timer.start()

    @classmethod
    def of(cls, path: str) -> "PieceEncoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _whole(self, strings: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _joined(self, tokenizer, text: str, n: int) -> list[bytes] | None:
        """ids of n pieces from one call for all: their places in its ids show by their first tokens. None if they don't."""
        ids = np.asarray(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != n or (n and starts[0]):
            return None
        raw, ends = ids.tobytes(), (4 * np.append(starts, len(ids))).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """ids of pieces. A space and letters (or letters after a line feed) are one match of the pattern, so the library's model is given them without it."""
        kinds = [0 if _WORD.fullmatch(p) else 1 if p[0] in _OPEN else 2 for p in pieces]
        words, opened, rest = ([p for p, k in zip(pieces, kinds, strict=True) if k == x] for x in range(3))
        found = [], [], self._whole([p.decode() for p in rest])
        for k, (some, tokenizer) in enumerate(((words, self.model), (opened, self.tokenizer))):
            if some:
                text = b"".join(some)
                ids = tokenizer and self._joined(tokenizer, text.decode() if k else text.decode("latin-1").translate(_SHOWS), len(some))
                found[k].extend(ids or self._whole([p.decode() for p in some]))
        if len(words) == len(pieces) or len(opened) == len(pieces):
            return found[0] or found[1]
        each = [iter(x) for x in found]
        return [next(each[k]) for k in kinds]

    def _new(self, text: bytes, at: np.ndarray, sizes: np.ndarray, keys: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces that the table lacks, one after the other, and their number by piece. Each distinct piece is encoded once."""
        _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
        like = first[which]
        long = np.flatnonzero(sizes > PIECE_BYTES).tolist()
        pieces = [text[a:b] for a, b in zip(at[first].tolist(), (at + sizes)[first].tolist(), strict=True)]
        same = np.array_equal(sizes[like], sizes) and all(np.array_equal(k[like], k) for k in keys.T)
        if not same or any(pieces[which[i]] != text[at[i] : at[i] + sizes[i]] for i in long):
            # Different pieces of one hash: no grouping.
            found = self._whole([text[a:b].decode() for a, b in zip(at.tolist(), (at + sizes).tolist(), strict=True)])
            return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        found = [ids for k in range(0, len(pieces), CALL) for ids in self._pieces(pieces[k : k + CALL])]
        ids, counts = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.table.put(self.table.rows(mixed[first]), keys[first], sizes[first], counts, ids)
        starts, each = (np.cumsum(counts) - counts)[which], counts[which]
        ends = np.cumsum(each)
        return ids[np.repeat(starts - (ends - each), each) + np.arange(ends[-1])], each

    def _block(self, text: bytes, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the pieces text[at : at + sizes], one after the other, and their number by piece."""
        if self.table is None:
            self.table = Table(ROWS, self.highest)
        raw, table = np.frombuffer(text, np.uint8), self.table
        words = np.lib.stride_tricks.sliding_window_view(raw, PIECE_BYTES)[at]
        keys, mixed = words.view(np.uint64), sizes.astype(np.uint64)
        rows, known = np.empty(len(at), np.int64), np.empty(len(at), bool)
        for k in range(0, len(at), MASKED):
            part = slice(k, k + MASKED)
            words[part] *= np.arange(PIECE_BYTES) < sizes[part, None]
            m = mixed[part]
            for j in range(keys.shape[1]):
                m = (m ^ keys[part, j]) * np.uint64(0x9E3779B97F4A7C15)
                m ^= m >> np.uint64(29)
            mixed[part], rows[part] = m, table.rows(m)
            known[part] = table.has(rows[part], keys[part], sizes[part])
        for i in np.flatnonzero(sizes > PIECE_BYTES).tolist():
            mixed[i] = hash(text[at[i] : at[i] + sizes[i]]) & (1 << 64) - 1
        each = table.counts[rows].astype(np.int64)
        old, new = table.read(rows[known]), np.flatnonzero(~known)
        if not len(new):
            return old.astype("<u4"), each
        ids, each[new] = self._new(text, at[new], sizes[new], keys[new], mixed[new])
        out, from_table = np.empty(int(each.sum()), "<u4"), np.repeat(known, each)
        out[from_table], out[~from_table] = old, ids
        return out, each

    def _plain(self, rows: list[bytes]) -> list[bytes]:
        """ids of texts without runs of white space. A piece begins with its space or line feed; a line feed goes before each text, and its id again."""
        if not rows:
            return []
        text = b"\n" + b"\n".join(rows) + bytes(PIECE_BYTES)
        raw = np.frombuffer(text, np.uint8)
        kind = _KIND[raw]
        begins = kind == 4
        if self.cuts:
            begins[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
        at = np.flatnonzero(begins)
        sizes = np.diff(at, append=len(raw) - PIECE_BYTES)
        blocks = [self._block(text, at[k : k + BLOCK], sizes[k : k + BLOCK]) for k in range(0, len(at), BLOCK)]
        ids = np.concatenate([b[0] for b in blocks]).tobytes()
        ends = np.append(0, np.cumsum(np.concatenate([b[1] for b in blocks])))
        texts_at = np.cumsum([0] + [len(r) + 1 for r in rows])
        bounds = (4 * ends[np.searchsorted(at, texts_at)]).tolist()
        return [ids[a + 4 : b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, batch: list[str]) -> list[bytes]:
        def plain(text: str) -> bool:
            return not (not text or _RUNS.search(text) or text[0].isspace() or text[-1].isspace() or any(t in text for t in self.special))

        kinds = [plain(t) for t in batch]
        pieces = iter(self._plain([t.encode() for t, k in zip(batch, kinds, strict=True) if k]))
        whole = iter(self._whole([t for t, k in zip(batch, kinds, strict=True) if not k]))
        return [next(pieces if k else whole) for k in kinds]


def encoded(
    batches: Iterator[pa.RecordBatch], path: str, slice_bytes: int = 4 << 20
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches of (doc_id, text) with the ids of each text, the end id included.

    The next task of the stage finds what this one remembers; a worker that
    has no such task for a while forgets it (see rest).
    """
    encoder, end = PieceEncoder.of(path), np.asarray([END_ID], "<u4").tobytes()
    encoder.uses += 1
    try:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                yield part, [ids + end for ids in encoder.encode(part.column("text").to_pylist())]
    finally:
        encoder.rest()


def write_token_files(
    docs: DataFrame,
    out: str,
    tokenizer: str | None = None,
    shards: int | None = None,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 2_000,
) -> str:
    """Encode every whole text and write ids as Parquet list columns in ascending doc_id order; returns out.

    Each file is one shard, a range of doc_ids. Columns: doc_id, shard, start
    (ids before the document within its shard), n_tokens, tokens. encoding
    "dictionary" packs ids as dictionary indexes, "delta" as
    DELTA_BINARY_PACKED integers. Row groups are bounded by bytes and pages by
    rows, and Spark's writer adds page indexes, so that readers fetch single
    documents, or the metadata columns alone, without reading other ids.

    Null or empty text: one document with the end id alone. Equal doc_ids stand
    next to each other, ordered by text; null doc_ids come first. An empty
    table gives no rows. Other columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    n = shards or shuffle_partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        for part, ids in encoded(batches, path):
            counts = np.asarray([len(x) // 4 for x in ids], np.int64)
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            flat = np.frombuffer(b"".join(ids), "<i4")
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(flat))
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(np.full(len(ids), shard, np.int32)), pa.array(starts), pa.array(counts), lists],
                names=["doc_id", "shard", "start", "n_tokens", "tokens"],
            )

    (
        texts(docs)
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(tidy(run), "doc_id long, shard int, start long, n_tokens long, tokens array<int>")
        .write.option("compression", "zstd")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .parquet(out)
    )
    return out


def token_index(files: DataFrame) -> DataFrame:
    """Metadata of token files: shard, and ids in all earlier shards. Reads the count column only, one row a shard."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return per_shard.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("shard_start"))


def read_token_files(spark, path: str) -> DataFrame:
    """Per document from the files: doc_id, start among all ids, n_tokens, ids_crc32 of the ids read."""
    files = spark.read.parquet(path)

    def checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), 0
            crcs, sizes = [], []
            for n in lists.value_lengths().to_pylist():
                crcs.append(zlib.crc32(flat[at : at + n]))
                sizes.append(n)
                at += n
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("shard"), batch.column("start"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"],
            )

    rows = files.select("doc_id", "shard", "start", "tokens").mapInArrow(tidy(checks), "doc_id long, shard int, start long, n_tokens long, ids_crc32 long")
    # One row for each shard, hence for each write task: a few bytes for every 100 MB of input.
    return rows.join(F.broadcast(token_index(files)), "shard").select(
        "doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def select_tokens(spark, path: str, low: int, high: int) -> DataFrame:
    """Ids of the documents low <= doc_id < high; row groups and pages outside are skipped by their statistics. Null doc_ids are in no range; repeated ones each give a row."""
    return spark.read.parquet(path).where((F.col("doc_id") >= low) & (F.col("doc_id") < high)).select("doc_id", "tokens")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Write token files in the shared folder and read them back, a row per document."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, work_path(spark, "tokens"), tokenizer, **options))


__all__ = [
    "PieceEncoder", "default_tokenizer", "encode_documents", "encoded", "read_token_files", "select_tokens",
    "token_index", "write_token_files",
]
