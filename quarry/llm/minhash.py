"""Near-duplicate documents by min-max hashing of word shingles.

Each permutation gives two signature values, the smallest and the largest hash
of a document's shingles (Ji et al., 2013), so half as many permutations fill
the bands. Documents that share a band are candidates; links are confirmed on
the full sets. Texts with equal sets are one node from the start, and a bucket
never gives all its pairs: its members are compared with the bucket's most
central member first, and only members that are still in another component
are compared with the others, behind length and symmetric-difference bounds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NO_ID, flat_bytes, keyed, marked, slices, stored, texts, tidy
from quarry.llm.graph import components
from quarry.llm.words import SPACED, mix, prefix_sums, shingle_hashes, span_hashes, word_spans

ROWS = 4
MISS = 1e-7
SKETCH_BITS = 512
#: Bits of the table by which the second scan skips documents without a candidate; others that it lets through fall in a join.
SKIP_BITS = 23


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands so that two documents at the threshold share none with at most the probability miss; an even number."""
    n = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))
    return n + n % 2


def _shingles(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = flat_bytes(part.column("text"))
    begin, end, n = word_spans(raw, offsets, SPACED)
    return shingle_hashes(span_hashes(prefix_sums(raw, SPACED), begin, end), n, size)


def signatures(docs: DataFrame, size: int, bands: int, rows: int = ROWS, seed: int = 11, slice_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, tid, n_shingles, digest of the set, band keys and a parity sketch of the set, by document. docs: see keyed."""
    rng = np.random.default_rng(seed)
    permutations = -(-bands * rows // 2)
    odd = rng.integers(0, 1 << 32, permutations, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, permutations, dtype=np.uint64).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                h, n = _shingles(part, size)
                first = np.cumsum(n) - n
                some = np.flatnonzero(n > 0)
                sizes, digests, sketches = np.zeros(len(n), np.int64), [b""] * len(n), [[0] * (SKETCH_BITS // 64)] * len(n)
                for i in some.tolist():
                    own = np.unique(h[first[i] : first[i] + n[i]])
                    sizes[i] = len(own)
                    digests[i] = hashlib.blake2b(own, digest_size=16).digest()
                    parity = np.bincount((own & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
                    sketches[i] = np.packbits(parity.astype(np.uint8)).view(np.int64)
                keys = np.zeros((len(n), bands), np.int64)
                if len(some):
                    at = first[some]
                    short = (h >> np.uint64(32)).astype(np.uint32)
                    values = np.empty((2 * permutations, len(some)), np.uint64)
                    for k in range(permutations):
                        x = short * odd[k] + add[k]
                        x ^= x >> np.uint32(15)
                        values[2 * k] = np.minimum.reduceat(x, at)
                        values[2 * k + 1] = np.maximum.reduceat(x, at)
                    for b in range(bands):
                        key = np.full(len(some), b + 1, np.uint64)
                        for r in range(rows):
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[b * rows + r])
                        keys[some, b] = key.view(np.int64)
                lists = lambda flat, w: pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * w), pa.array(flat))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("tid"), pa.array(sizes), pa.array(digests, pa.binary()), lists(keys.ravel(), bands), lists(np.concatenate(sketches).astype(np.int64), SKETCH_BITS // 64)],
                    names=["doc_id", "tid", "n_shingles", "digest", "bands", "sketch"],
                )

    return docs.select("doc_id", "tid", "text").mapInArrow(tidy(run), "doc_id long, tid long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def _needed_sets(docs: DataFrame, nodes: DataFrame, size: int, slice_bytes: int = 1 << 20) -> DataFrame:
    """node and its sorted shingle hashes, for nodes (node, digest). Scans the texts again.

    A bit table of fixed size lets most other documents go before any work; a
    join on node and digest drops the rest.
    """
    bit = F.pmod(F.xxhash64("node"), F.lit(1 << SKIP_BITS))
    words = nodes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS int)))").alias("bits"))
    table = np.zeros(1 << (SKIP_BITS - 5), np.uint32)  # 1 MB, however many nodes
    for r in words.toPandas().itertuples(index=False):
        table[r.word] = r.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((table[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)))
            for part in slices(batch, "text", slice_bytes):
                h, n = _shingles(part, size)
                sets = [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]
                digests = [hashlib.blake2b(x, digest_size=16).digest() if len(x) else b"" for x in sets]
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(digests, pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "digest", "shingles"]
                )

    scanned = texts(docs).withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(1 << SKIP_BITS))).mapInArrow(tidy(run), "node long, digest binary, shingles array<long>")
    # Repeated rows have the same set; one is enough.
    return scanned.join(nodes.select("node", "digest"), ["node", "digest"], "left_semi").dropDuplicates(["node", "digest"]).select("node", "shingles")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold: 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("all"))
    return both.where(100 * F.col("n") >= percent * (F.col("all") - F.col("n"))).select("a", "b")


def _may_link(percent: int, n: Column, m: Column, s: Column, t: Column) -> Column:
    """Bounds that no linked pair breaks: of the sizes, and of the symmetric difference by the parity sketch."""
    differing = F.aggregate(F.zip_with(s, t, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)
    # |A ^ B| = |A| + |B| - 2 I, and I >= percent / (100 + percent) * (|A| + |B|).
    return (100 * n >= percent * m) & (100 * m >= percent * n) & ((100 + percent) * differing <= (100 - percent) * (n + m))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Words are runs without white space, A-Z in lower case; a document's set has
    its distinct runs of size words, or its whole sequence where it has fewer
    words. Documents are linked whose sets reach percent of Jaccard
    similarity. Null and empty texts and texts without words are linked with
    nothing and kept. Rows that repeat a doc_id are one node: a link of any is
    a link of all. A null doc_id is one id, below all others. An empty table
    gives no rows; other columns are ignored.
    """
    rows = _components(keyed(docs), size, percent, bands)
    null = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return rows.select(null("doc_id"), "n_shingles", null("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int | None = None) -> DataFrame:
    """The rows of docs without near copies: of each group one row stays, that of the smallest doc_id.

    Groups are those of near_duplicates. Of a doc_id's rows with several texts
    in a group the one with the smallest hash stays; of equal rows one. Texts
    without words stay. Columns are those of docs, whatever their names.
    """
    rows = stored(_components(keyed(docs), size, percent, bands).where("n_shingles > 0").select("doc_id", "tid", "component_id"), "components")
    heads = rows.where("doc_id = component_id").groupBy("component_id").agg(F.min("tid").alias("head"))
    same = rows.groupBy(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid"), "component_id").agg(F.count("*").alias("c"))
    judged = stored(same.join(heads, "component_id").select("_doc", "_tid", "c", ((F.col("_doc") == F.col("component_id")) & (F.col("_tid") == F.col("head"))).alias("first")), "judged")
    gone = judged.where("NOT first").select("_doc", "_tid")
    twice = judged.where("first AND c > 1").select("_doc", "_tid")
    left = marked(docs).join(gone, ["_doc", "_tid"], "left_anti")
    if twice.limit(1).count():
        one = left.join(twice, ["_doc", "_tid"], "left_semi").dropDuplicates(["_doc", "_tid"])
        left = left.join(twice, ["_doc", "_tid"], "left_anti").unionByName(one)
    return left.select("_row.*")


def _components(docs: DataFrame, size: int, percent: int, bands: int | None) -> DataFrame:
    """Per row of keyed docs: doc_id, tid, n_shingles, component_id."""
    bands = bands or bands_for(percent)
    rows = stored(signatures(docs, size, bands), "signatures")
    some = rows.where("n_shingles > 0")
    digests = stored(some.groupBy("digest").agg(F.min("doc_id").alias("node")), "digests")
    first = some.join(digests, "digest").where("doc_id = node").dropDuplicates(["node", "digest"]).select("node", "digest", "n_shingles", "sketch", "bands")
    nodes = stored(first, "nodes")
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = stored(entries.join(buckets, "bucket"), "buckets")
    central = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    weighed = shared.select("bucket", "node").join(central, "node")
    # The most central member: one that shares most, as the original of a group of copies does; then the smallest doc_id.
    pivots = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top")).select("bucket", (-F.col("top.minus")).alias("pivot"))
    pivots = stored(pivots, "pivots")
    pairs = shared.join(pivots, "bucket").where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    candidates = shared.select("node").distinct()
    sets = stored(_needed_sets(docs, nodes.join(candidates, "node", "left_semi"), size), "sets")
    # A doc_id that is repeated with other texts is one node.
    of = some.select("doc_id", "digest").join(digests, "digest").select("doc_id", "node")
    several = of.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last").select("doc_id", "a")
    twins = of.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    linked = stored(_linked(pairs, sets, percent).unionByName(twins), "links")
    labels = components(linked)
    # Members of a bucket that its pivot didn't join meet the bucket's other components.
    told = shared.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    homes = pivots.join(labels, pivots.pivot == labels.node, "left").select("bucket", F.coalesce("label", "pivot").alias("home"))
    told = told.join(homes, "bucket").withColumn("out", F.col("label") != F.col("home"))
    mixed = told.where("out").select("bucket").distinct()
    facts = nodes.select("node", "n_shingles", "sketch")
    told = stored(told.join(mixed, "bucket", "left_semi").join(facts, "node"), "mixed")
    x = told.where("out").select("bucket", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    y = told.select("bucket", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"), "out")
    meet = (x.bucket == y.bucket) & (F.col("la") != F.col("lb")) & (~F.col("out") | (F.col("a") < F.col("b"))) & _may_link(percent, F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"))
    rest = x.join(y, meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = stored(_linked(rest, sets, percent), "links")
    if more.limit(1).count():
        labels = components(linked.unionByName(more))
    known = digests.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"))
    out = rows.join(known, "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "tid", "n_shingles", "component_id")
