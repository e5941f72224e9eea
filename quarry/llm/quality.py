"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of 16 bytes slide over the text in steps of
4. Each filter is max-pooled over overlapping chunks of 256 bytes (steps of
192) that cover the whole text. A hidden layer reads each chunk, and the mean
and the maximum of its outputs over all chunks are combined into one
probability, so the length of a text doesn't decide by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import flat_bytes, slices, texts, tidy

GROUP, TAPS, EMBED, FILTERS, HIDDEN = 4, 4, 8, 24, 8
BLOCK = 16  # groups: 64 bytes
CHUNK_BLOCKS, CHUNK_STEP = 4, 3
PAD = 256  # embedding of the bytes behind a text


@dataclass
class Net:
    embed: np.ndarray  # 257 x EMBED
    conv: np.ndarray  # TAPS x (GROUP * EMBED) x FILTERS
    conv_bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # 2 * HIDDEN
    bias: np.ndarray  # 1

    @staticmethod
    def fresh(seed: int = 7) -> "Net":
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        fan = GROUP * TAPS * EMBED
        return Net(
            draw(257, EMBED, scale=0.5), draw(TAPS, GROUP * EMBED, FILTERS, scale=(2 / fan) ** 0.5), np.zeros(FILTERS, np.float32),
            draw(FILTERS, HIDDEN, scale=FILTERS**-0.5), np.zeros(HIDDEN, np.float32), draw(2 * HIDDEN, scale=0.3), np.zeros(1, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.hidden, self.hidden_bias, self.out, self.bias]


def _layout(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes with each text padded to whole blocks (and a filter's width of padding), and blocks by text."""
    n = np.diff(offsets)
    unit = GROUP * BLOCK
    blocks = (n + GROUP * (TAPS - 1) + unit - 1) // unit
    blocks = np.maximum(blocks, 1)
    codes = np.full(int(blocks.sum()) * unit, PAD, np.int16)
    shift = (np.cumsum(blocks) - blocks) * unit - offsets[:-1]
    codes[np.arange(len(raw)) + np.repeat(shift, n)] = raw
    return codes, blocks


def _responses(net: Net, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups (n x GROUP*EMBED) and filter responses (n x FILTERS) at each group.

    ends: blocks before which a text ends. Filters that would reach beyond lie
    in its padding alone; they don't count, so no text sees the next one.
    """
    groups = net.embed[codes].reshape(-1, GROUP * EMBED)
    out = groups @ net.conv[0]
    for k in range(1, TAPS):
        out[:-k] += (groups @ net.conv[k])[k:]
    out += net.conv_bias
    out[(BLOCK * ends[:, None] - np.arange(1, TAPS)).ravel()] = -np.inf
    return groups, out


def _chunks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last+1 block of each chunk, and chunks by text."""
    n = 1 + np.maximum(0, -(-(blocks - CHUNK_BLOCKS) // CHUNK_STEP))
    first_block = np.cumsum(blocks) - blocks
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(first_block, n) + CHUNK_STEP * within
    end = np.minimum(begin + CHUNK_BLOCKS, np.repeat(first_block + blocks, n))
    return begin, end, n


def _pool(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maxima of rows begin:end."""
    last = len(values) - 1
    out = values[begin]
    for k in range(1, CHUNK_BLOCKS):
        np.maximum(out, values[np.minimum(np.minimum(begin + k, end - 1), last)], out=out)
    return out


def scores(net: Net, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    if len(offsets) < 2:
        return np.empty(0)
    codes, blocks = _layout(raw, offsets)
    _, conv = _responses(net, codes, np.cumsum(blocks))
    pooled = conv.reshape(-1, BLOCK, FILTERS).max(axis=1)
    begin, end, n = _chunks(blocks)
    z = np.tanh(np.maximum(_pool(pooled, begin, end), 0) @ net.hidden + net.hidden_bias)
    return _combine(net, z, n)[0]


def _combine(net: Net, z: np.ndarray, n: np.ndarray):
    first = np.cumsum(n) - n
    mean = np.add.reduceat(z, first, axis=0) / n[:, None]
    top = np.maximum.reduceat(z, first, axis=0)
    logit = np.concatenate([mean, top], axis=1) @ net.out + net.bias[0]
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30))), mean, top


def _gradients(net: Net, raw: np.ndarray, offsets: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    codes, blocks = _layout(raw, offsets)
    groups, conv = _responses(net, codes, np.cumsum(blocks))
    begin, end, n = _chunks(blocks)
    in_block = conv.reshape(-1, BLOCK, FILTERS)
    arg = in_block.argmax(axis=1)
    pooled = np.take_along_axis(in_block, arg[:, None, :], axis=1)[:, 0]
    best, where = pooled[begin], np.repeat(begin[:, None], FILTERS, axis=1)
    for k in range(1, CHUNK_BLOCKS):
        at = np.minimum(begin + k, end - 1)
        better = pooled[at] > best
        best = np.where(better, pooled[at], best)
        where = np.where(better, at[:, None], where)
    relu = np.maximum(best, 0)
    z = np.tanh(relu @ net.hidden + net.hidden_bias)
    p, mean, top = _combine(net, z, n)
    d = ((p - target) / len(target)).astype(np.float32)
    text = np.repeat(np.arange(len(n)), n)
    g_out = np.concatenate([mean, top], axis=1).T @ d
    dz = (d / n)[text, None] * net.out[:HIDDEN]
    is_top = z == top[text]
    dz = dz + is_top * d[text, None] * net.out[HIDDEN:]
    da = (dz * (1 - z * z)).astype(np.float32)
    g_hidden, g_hidden_bias = relu.T @ da, da.sum(axis=0)
    df = (da @ net.hidden.T) * (best > 0)
    position = where * BLOCK + np.take_along_axis(arg[where.ravel()], np.tile(np.arange(FILTERS), len(where))[:, None], axis=1).reshape(where.shape)
    g_conv, g_embed = np.zeros_like(net.conv), np.zeros_like(net.embed)
    codes_by_group = codes.reshape(-1, GROUP)
    for k in range(TAPS):
        at = np.minimum(position + k, len(groups) - 1)
        inside = (position + k < len(groups)) * df
        back = np.zeros((257, EMBED), np.float32)
        for f in range(FILTERS):
            w = inside[:, f]
            used = np.flatnonzero(w)
            if not len(used):
                continue
            rows = at[used, f]
            g_conv[k, :, f] = w[used] @ groups[rows]
            each = w[used][:, None] * net.conv[k, :, f]
            flat = codes_by_group[rows].ravel()
            each = each.reshape(-1, EMBED)
            for e in range(EMBED):
                back[:, e] += np.bincount(flat, weights=each[:, e], minlength=257)
        g_embed += back
    return [g_embed, g_conv, df.sum(axis=0), g_hidden, g_hidden_bias, g_out, np.asarray([d.sum()], np.float32)]


def fit_net(sample: list[tuple[bytes, int]], epochs: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on the logistic loss over whole texts. Without both labels the net answers with the share of label 1."""
    net = Net.fresh(seed)
    labels = np.asarray([y for _, y in sample], np.float64)
    if not len(labels) or labels.min() == labels.max():
        net.out[:] = 0
        net.bias[:] = 0 if not len(labels) else (8 if labels[0] else -8)
        return net
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step, steps = 0, epochs * -(-len(sample) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for low in range(0, len(order), batch):
            chosen = order[low : low + batch]
            data = [sample[i][0] for i in chosen]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
            grads = _gradients(net, np.frombuffer(b"".join(data), np.uint8), offsets, labels[chosen])
            step += 1
            lr = rate * min(1, 2 * (1 - (step - 1) / steps))
            for p, g, (m, v) in zip(net.parts(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: str, per_label: int, max_chars: int) -> list[tuple[bytes, int]]:
    """At most per_label training texts of each label, of at most max_chars characters: a bounded sample for a fit.

    Rows are drawn by a hash of doc_id. train is an SQL condition on doc_id.
    """
    ids = labels.where(F.expr(train)).where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    drawn = [ids.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    short = texts(docs).where(F.length("text") <= max_chars)
    # 2 * per_label rows of two numbers: a bound that doesn't depend on the input.
    joined = short.join(F.broadcast(drawn[0].unionByName(drawn[1]).distinct()), "doc_id").select("doc_id", "label", "text")
    # Where ids repeat there are more rows; so many and no more reach the driver.
    rows = joined.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "label").limit(2 * per_label).collect()
    return [(r["text"].encode(), r["label"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["label"], r["text"]))]


def fit_quality(docs: DataFrame, labels: DataFrame, train: str, per_label: int = 800, max_chars: int = 20_000) -> Net:
    """A net fitted on a bounded sample of labelled rows (per_label of each label, max_chars each).

    Null texts are empty; labels that are neither 0 nor 1, and ids without a
    document, don't count; without both labels the net answers with the one
    there is, or a half. Repeated rows count as often as they are drawn.
    """
    return fit_net(labelled_sample(docs, labels, "quality", train, per_label, max_chars))


def score_quality(docs: DataFrame, net: Net, slice_bytes: int = 1 << 19) -> DataFrame:
    """doc_id and score of every whole text. Null texts are empty; an empty text gets the net's answer to padding.

    An empty table gives no rows; repeated rows are scored each; other columns
    are ignored. A text longer than a slice is scored alone, in pieces of whole
    chunks, so memory doesn't grow with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                raw, offsets = flat_bytes(part.column("text"))
                found = long_score(net, raw, slice_bytes) if len(raw) > slice_bytes else scores(net, raw, offsets)
                yield pa.record_batch([part.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(tidy(run), "doc_id long, score double")


def keep_quality(docs: DataFrame, net: Net, threshold: float, slice_bytes: int = 1 << 19) -> DataFrame:
    """The rows of docs whose whole text scores at least the threshold, with all their columns, in one pass over them.

    A null text is scored as an empty one and stays null; repeated rows are
    judged alike; no rows give none. Long texts as in score_quality.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            filled = pa.compute.fill_null(batch.column(at), "")
            keyed = pa.record_batch([pa.array(np.arange(batch.num_rows)), filled], names=["row", "text"])
            found = np.empty(batch.num_rows)
            for part in slices(keyed, "text", slice_bytes):
                raw, offsets = flat_bytes(part.column("text"))
                found[part.column("row").to_numpy()] = long_score(net, raw, slice_bytes) if len(raw) > slice_bytes else scores(net, raw, offsets)
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def long_score(net: Net, raw: np.ndarray, piece_bytes: int) -> np.ndarray:
    """As scores() of one text, whose chunks are taken piece by piece."""
    unit = GROUP * BLOCK
    step = unit * CHUNK_STEP
    per = max(1, piece_bytes // step)  # chunks in a piece
    blocks = (len(raw) + GROUP * (TAPS - 1) + unit - 1) // unit
    chunks = 1 + max(0, -(-(blocks - CHUNK_BLOCKS) // CHUNK_STEP))
    total, top = np.zeros(HIDDEN, np.float64), np.full(HIDDEN, -np.inf, np.float32)
    for c in range(0, chunks, per):
        k = min(per, chunks - c)
        low, n_blocks = c * step, min((k - 1) * CHUNK_STEP + CHUNK_BLOCKS, blocks - c * CHUNK_STEP)
        codes = np.full((n_blocks * BLOCK + TAPS) * GROUP, PAD, np.int16)
        got = raw[low : low + len(codes)]
        codes[: len(got)] = got
        last = np.asarray([n_blocks] if c + k == chunks else [], np.int64)
        conv = _responses(net, codes, last)[1][: n_blocks * BLOCK]
        pooled = conv.reshape(-1, BLOCK, FILTERS).max(axis=1)
        begin = CHUNK_STEP * np.arange(k)
        z = np.tanh(np.maximum(_pool(pooled, begin, np.minimum(begin + CHUNK_BLOCKS, n_blocks)), 0) @ net.hidden + net.hidden_bias)
        total += z.sum(axis=0)
        top = np.maximum(top, z.max(axis=0))
    logit = float(np.concatenate([total / chunks, top]) @ net.out + net.bias[0])
    return np.asarray([1 / (1 + np.exp(-np.clip(logit, -30, 30)))])
