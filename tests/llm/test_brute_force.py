"""Operators that SQL can't express, against plain code written from their definitions."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import chat, decontaminate, language, media, quality, tokens, toxicity
from quarry.llm.common import slices

WORDS = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- quality: a forward pass in loops, and gradients by differences

def naive_score(net, text):
    raw = text.encode()
    unit = quality.GROUP * quality.BLOCK
    blocks = max(1, -(-(len(raw) + quality.GROUP * (quality.TAPS - 1)) // unit))
    codes = list(raw) + [quality.PAD] * (blocks * unit - len(raw))
    groups = [np.concatenate([net.embed[c] for c in codes[g : g + quality.GROUP]]) for g in range(0, len(codes), quality.GROUP)]
    response = [net.conv_bias + sum(groups[g + k] @ net.conv[k] for k in range(quality.TAPS)) for g in range(len(groups) - quality.TAPS + 1)]
    chunks, begin = [], 0
    while True:
        end = min(begin + quality.CHUNK_BLOCKS, blocks)
        top = np.max(response[begin * quality.BLOCK : end * quality.BLOCK], axis=0)
        chunks.append(np.tanh(np.maximum(top, 0) @ net.hidden + net.hidden_bias))
        if begin + quality.CHUNK_BLOCKS >= blocks:
            break
        begin += quality.CHUNK_STEP
    logit = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.out + net.bias[0]
    return 1 / (1 + math.exp(-logit))


def batch_of(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)


def test_quality_forward_pass():
    rng = random.Random(0)
    net = quality.Net.fresh(3)
    texts = ["", "a", "é" * 40, prose(rng, 5), prose(rng, 60), prose(rng, 300), "b"]
    together = quality.scores(net, *batch_of(texts))
    for text, among in zip(texts, together, strict=True):
        assert among == pytest.approx(naive_score(net, text), abs=1e-4)
        assert quality.long_score(net, batch_of([text])[0], 500)[0] == pytest.approx(naive_score(net, text), abs=1e-4)


def test_quality_gradients():
    rng = random.Random(1)
    net = quality.Net.fresh(4)
    for name in ("embed", "conv", "conv_bias", "hidden", "hidden_bias", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    raw, offsets = batch_of([prose(rng, 30), prose(rng, 90), "x"])
    target = np.asarray([1.0, 0.0, 1.0])

    def loss():
        p = quality.scores(net, raw, offsets)
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    grads = quality._gradients(net, raw, offsets, target)
    draw = np.random.default_rng(2)
    for part, grad in zip(net.parts(), grads, strict=True):
        flat, wide = part.reshape(-1), np.asarray(grad, np.float64).reshape(-1)
        chosen = np.argsort(-np.abs(wide))[:4].tolist() + draw.integers(0, len(flat), 2).tolist()
        for i in chosen:
            keep, h = flat[i], 1e-5
            flat[i] = keep + h
            up = loss()
            flat[i] = keep - h
            down = loss()
            flat[i] = keep
            assert wide[i] == pytest.approx((up - down) / (2 * h), rel=0.02, abs=2e-5)


# ---- toxicity: the score of a text from its definition

def test_toxicity_score():
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(40)]
    model = toxicity.Model(rng.integers(0, 9, (2, 1 << toxicity.WORD_BITS)).astype(np.float32), rng.random(1 << toxicity.STEM_BITS).astype(np.float32) * 0.8 + 0.1, -0.3, 0.7, 0.4, 0.9, -1.0)
    texts = [" ".join(rng.choice(words, n)) for n in (1, 2, 7, 30, 80)] + [""]
    data = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    n, found, score = toxicity._best(model, raw, offsets)
    got = toxicity.evidence(model, n, [[s for _, _, s in f] for f in found])
    _, _, _, word, stem = toxicity._buckets(raw, offsets)
    at = 0
    for i, k in enumerate(n.tolist()):
        own = []
        for w, s in zip(word[at : at + k], stem[at : at + k], strict=True):
            share = float(model.stem_share[s])
            own.append(math.log((model.counts[1][w] + 2 * share) / (model.counts[0][w] + 2 * (1 - share))) + 0.3 - 1)
        assert score[at : at + k] == pytest.approx(own, abs=1e-4)
        at += k
        # The best segments that don't overlap, each the best of what the better ones leave.
        best = sorted((s for _, _, s in plain_segments(own)), reverse=True)
        floor = math.log(0.4 * max(k, 1))
        tails = [-floor]
        if best:
            sums = [sum(0.7 * s - floor for s in best[:r]) for r in range(1, len(best) + 1) if r == 1 or 0.7 * best[r - 1] > floor]
            tails = [x if r == 1 else x - (r - 1) * math.log(x) + math.log(math.factorial(r) * math.factorial(r - 1)) for r, x in enumerate(sums, 1) if r == 1 or x > 0]
        assert got[i] == pytest.approx(max(tails), abs=1e-4)


def plain_segments(score):
    if not len(score) or max(score) <= 0:
        return []
    total = np.concatenate([[0], np.cumsum(score)])
    best = max((total[j] - total[i], -(j - i), i, j) for i in range(len(score)) for j in range(i + 1, len(score) + 1))
    i, j = best[2], best[3]
    return plain_segments(score[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in plain_segments(score[j:])]


# ---- decontamination: recall against the exact distance, for edits of several kinds

def _changed(rng, word):
    i = rng.randrange(len(word))
    return word[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[i + 1 :]


def _strange(rng, word):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in word)


KINDS = {
    "a character in every word": lambda rng, ws: [_changed(rng, w) for w in ws],
    "a character in every second word": lambda rng, ws: [_changed(rng, w) if i % 2 else w for i, w in enumerate(ws)],
    "one word in five replaced": lambda rng, ws: [_strange(rng, w) if i % 5 == 2 else w for i, w in enumerate(ws)],
    "one in ten gone, one in ten replaced": lambda rng, ws: [_strange(rng, w) if i % 10 == 3 else w for i, w in enumerate(ws) if i % 10 != 7],
}


@pytest.mark.parametrize("kind", KINDS)
def test_decontamination_recall(kind):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(3, 9))) for _ in range(1500)]
    plain = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(plain(rng.choice((14, 25, 40))))) for k in range(150)]
    texts = [" ".join([*plain(30), *KINDS[kind](rng, t.split()), *plain(30)]) for _, t in items]
    within = {k for (k, t), text in zip(items, texts, strict=True) if decontaminate.least_distance(t, text) <= len(t) * 20 // 100}
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["doc_id", "tid", "text"])
    built = decontaminate.build(items)
    got = {(r["doc_id"], r["item_id"]) for part in slices(batch, "text", 1 << 20) for r in decontaminate._found(built, part, 20).to_pylist()}
    assert all(d == i for d, i in got) and {d for d, _ in got} <= within
    assert len(within) >= 75 and len(got) >= 0.9 * len(within)


def _spaced(rng, text, every, kind):
    first, out = rng.randrange(every), []
    for i, c in enumerate(text):
        if i % every != first or i // every >= len(text) * 20 // 100:
            out.append(c)
        elif kind != "gone":
            out.append((c if kind == "put in" else "") + rng.choice("abcdefghijklmnopqrstuvwxyz"))
    return "".join(out)


@pytest.fixture(scope="module")
def benchmark_items():
    rng = random.Random(16)
    vocabulary = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(1500)]
    plain = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, plain(rng.choice((14, 25, 40)))) for k in range(150)]
    return items, [plain(30) for _ in items], decontaminate.build(items)


@pytest.mark.parametrize("every", [5, 6, 7, 8, 10])
@pytest.mark.parametrize("kind", ["gone", "put in", "replaced"])
def test_decontamination_recall_of_evenly_spaced_edits(benchmark_items, every, kind):
    items, around, built = benchmark_items
    rng = random.Random(every)
    copies = [_spaced(rng, t, every, kind) for _, t in items]
    texts = [f"{a} {c} {a}" for a, c in zip(around, copies, strict=True)]
    within = {k for (k, t), c in zip(items, copies, strict=True) if decontaminate.least_distance(t, " ".join(c.split())) <= len(t) * 20 // 100}
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["doc_id", "tid", "text"])
    got = {r["item_id"] for part in slices(batch, "text", 1 << 20) for r in decontaminate._found(built, part, 20).to_pylist() if r["doc_id"] == r["item_id"]}
    assert len(within) >= 75 and len(got & within) >= 0.95 * len(within)


def test_short_items_of_a_block_are_found():
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 6, 9] * 15)] + [(None, "x" * 40 + "yz" * 30), (91, "日本語の文章は空白を使わない" * 3)]
    built = decontaminate.build(items)
    texts = [f"qq {t} qq" for _, t in items]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["doc_id", "tid", "text"])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate._found(built, batch, 20).to_pylist()}
    assert {(d, i) for d, (i, _) in enumerate(items)} <= got


# ---- language: the posterior of each page from counts in plain code

def test_language_posterior(spark):
    rng = random.Random(7)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwei", "drei", "vier"], "cc": ["uno", "dos", "tres"]}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(k, 30), k) for i, k in enumerate(list(words) * 20)], "doc_id long, text string, lang string")
    model = language.fit_languages(docs)
    rows = []
    for i in range(60):
        k = rng.choice(list(words))
        said, path = rng.choice([k, "aa", ""]), rng.choice([k, "bb"])
        rows.append((i, f"https://h{rng.randrange(4)}.d{rng.randrange(2)}.{rng.choice(['org', 'de'])}/{path}/x", f"<html{f' lang={said!r}' if said else ''}><p>{text(k, rng.randint(0, 3))}</p>"))
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    n = len(model.langs)
    facts = []
    for _, url, page in rows:
        host = url.split("/")[2]
        said = page.split("lang='")[1].split("'")[0] if "lang=" in page else ""
        logs = [sum(float(model.scores[k][g]) for g in language._grams(language.visible_text(page))) / 4 for k in range(n)]
        facts.append({"h": host, "d": ".".join(host.split(".")[-2:]), "s": host.split(".")[-1], "m": said, "p": url.split("/")[3], "logs": logs, "vote": logs.index(max(logs))})
    votes = [sum(f["vote"] == k for f in facts) for k in range(n)]
    for i, f in enumerate(facts):
        def others(key, k=None):
            return sum(g[key] == f[key] and (k is None or g["vote"] == k) for j, g in enumerate(facts) if j != i)

        post = []
        for k in range(n):
            overall = (votes[k] + 1) / (sum(votes) + n)
            domain = (others("d", k) + 5 * overall) / (others("d") + 5)
            x = math.log((others("h", k) + 5 * domain) / (others("h") + 5)) + f["logs"][k]
            for key in "smp":
                x += math.log((others(key, k) + 5 * (others(key) + 5 / n) / (sum(votes) + 5)) / (votes[k] + 5))
            post.append(x)
        best = max(range(n), key=lambda k: post[k])
        assert got[i]["lang"] == model.langs[best]
        assert got[i]["probability"] == pytest.approx(1 / sum(math.exp(x - post[best]) for x in post), rel=1e-3)


def test_many_languages_plan_and_fit(spark):
    """As many as 200: what each says about itself, in a plan that doesn't grow with their number."""
    rng = random.Random(9)
    langs = [f"l{i:03d}" for i in range(200)]
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for k in langs}
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words[k], k=25)), k) for i, k in enumerate(langs * 2)], "doc_id long, text string, lang string")
    model = language.fit_languages(docs)
    pages = spark.createDataFrame([(i, None, f"<p>{' '.join(rng.choices(words[k], k=15))}</p>") for i, k in enumerate(langs)], "page_id long, url string, html string")
    out = language.identify(pages, model)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert sum(langs[r["page_id"]] == r["lang"] for r in out.collect()) >= 195


# ---- media: images of three components, broken bytes

class Bits:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def done(self):
        raw = int((self.bits + "1" * (-len(self.bits) % 8)) or "0", 2).to_bytes(-(-len(self.bits) // 8), "big")
        return raw.replace(b"\xff", b"\xff\x00")


def colour_image(rng, wide, high, sampling, restart, interleaved):
    """A baseline image of three components with random DC and AC coefficients, and its luminance DC values by block row."""
    dc = media._canonical({k: 4 for k in range(12)})
    ac = media._canonical({0: 2, **{s: 6 for s in (0x01, 0x02, 0x13, 0x51, 0xF0, 0x34)}})
    h, v = sampling
    shapes = [(h, v), (1, 1), (1, 1)]
    across, down = -(-wide // (8 * h)), -(-high // (8 * v))
    rows = [[[rng.integers(-60, 60) for _ in range(across * a)] for _ in range(down * b)] for a, b in shapes]

    def block(out, value, before):
        diff = int(value - before)
        cat = abs(diff).bit_length()
        out.put(*dc[2][cat])
        out.put(diff if diff >= 0 else diff + (1 << cat) - 1, cat)
        at = 1
        for _ in range(int(rng.integers(0, 4))):
            s = int(rng.choice([0x01, 0x02, 0x13, 0x51, 0xF0, 0x34]))
            step = 16 if s == 0xF0 else (s >> 4) + 1
            if at + step > 63:
                break
            at += step
            out.put(*ac[2][s])
            out.put(int(rng.integers(0, 1 << (s & 15))), s & 15)
        out.put(*ac[2][0])
        return value

    def scan(parts, units):
        """units: for each coding unit the (component, row, column) of its blocks."""
        raw, out, before, k = b"", Bits(), [0, 0, 0], 0
        for i, unit in enumerate(units):
            if restart and i and i % restart == 0:
                raw += out.done() + bytes([0xFF, 0xD0 + k % 8])
                out, before, k = Bits(), [0, 0, 0], k + 1
            for c, y, x in unit:
                before[c] = block(out, rows[c][y][x], before[c])
        head = bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + b"\0\x3f\0"
        return b"\xff" * 3 + media._segment(0xDA, head) + raw + out.done()

    if interleaved:
        units = [[(c, y * b + j, x * a + i) for c, (a, b) in enumerate(shapes) for j in range(b) for i in range(a)] for y in range(down) for x in range(across)]
        scans = scan([0, 1, 2], units)
    else:
        size = [(-(-high * b // (8 * v)), -(-wide * a // (8 * h))) for a, b in shapes]
        scans = b"".join(scan([c], [[(c, y, x)] for y in range(size[c][0]) for x in range(size[c][1])]) for c in (1, 0, 2))
    parts = b"".join(bytes([c + 1, a << 4 | b, 0]) for c, (a, b) in enumerate(shapes))
    image = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([8] * 64)) + media._segment(0xC0, b"\x08" + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + b"\x03" + parts)
    image += media._segment(0xC4, b"\0" + dc[0] + dc[1]) + media._segment(0xC4, b"\x10" + ac[0] + ac[1]) + media._segment(0xDD, restart.to_bytes(2, "big")) + scans + b"\xff\xd9"
    luminance = np.asarray(rows[0])[: -(-high // 8), : -(-wide // 8)]
    return image, np.clip((luminance * 8 + 4) // 8 + 128, 0, 255).astype(np.uint8)


def test_media_reads_images_of_three_components():
    rng = np.random.default_rng(8)
    made = [colour_image(rng, w, h, s, r, i) for w, h, s, r, i in ((33, 17, (2, 2), 0, True), (64, 64, (2, 1), 3, True), (9, 40, (1, 1), 2, True), (50, 20, (1, 1), 0, False), (33, 17, (2, 2), 5, False))]
    plain = media.encode_images(np.arange(192, dtype=np.uint8), np.asarray([1]))
    got = media.thumbnails([image for image, _ in made] + plain)
    for (_, want), frames in zip(made, got, strict=False):
        assert len(frames) == 1 and (frames[0] == want).all()
    assert (got[-1][0].ravel() == np.arange(192)).all()


def test_media_of_broken_bytes_keeps_its_rows(spark):
    good = media.encode_images(np.full(192, 65, np.uint8), np.asarray([1]))[0]
    rows = [(0, 5, good), (1, 5, None), (2, 5, b""), (3, 5, b"no image"), (4, 5, good[:60]), (5, 5, good[:-30]), (6, 5, good.replace(b"\xff\xc0", b"\xff\xc2")), (7, 5, good + b"tail")]
    got = {r["doc_id"]: r for r in media.media_features(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, n_bytes long, media binary, hashes string")).collect()}
    assert len(got) == 8 and (got[0]["payload_bytes"], got[0]["widths"], got[0]["heights"], len(got[0]["hashes"])) == (192, [1536], [8], 1)
    assert all(got[i]["payload_sha256"] is None and got[i]["widths"] is None for i in (1, 2, 3, 4, 6, 7)) and got[1]["media_bytes"] is None and got[3]["media_bytes"] == 8


# ---- chat: layouts of tables; tokens: what special strings become

def test_row_layouts_are_told_by_their_fields(spark):
    posts = spark.createDataFrame([("t", 1, "gpt", "a", 9), ("t", 0, "human", "q", 9)], "thread_id string, position int, `from` string, value string, likes int")
    assert chat.row_layout(posts.schema).name == "posts"
    turns = chat.turns_of_rows(posts).first()
    assert turns["conv_id"] == "t" and [tuple(t) for t in turns["turns"]] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="fingerprint"):
        chat.turns_of_rows(posts.drop("position"))


def test_special_strings_and_long_pieces():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_tokenizer())
    encoder = tokens.PieceEncoder(tokens.default_tokenizer())
    texts = ["a <|endoftext|> b", "x" * 500 + " y", "日本" * 300, "a <|endoftext|>", "plain words here", "a\nb c"]
    for _ in range(2):
        assert encoder.encode(texts) == [np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert all(len(p) <= tokens.PIECE_BYTES for p in encoder.now)


def test_hidden_parts_of_pages():
    assert language.visible_text("a<script>x</script>b<!-- c -->d<p>e") == "a b d e"
    assert language.visible_text("a<script>b <style>c</style> < d") == "a b < d"
    assert language.visible_text("<script>" * 50_000) == ""


@pytest.mark.parametrize("block", [1 << 19, 7])
@pytest.mark.parametrize("collide", [False, True])
def test_pieces_of_odd_texts_have_the_librarys_ids(block, collide, monkeypatch):
    """Zero bytes at ends, long pieces, runs of white space, blocks of few pieces, and hashes that all collide."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "BLOCK", block)
    if collide:
        monkeypatch.setattr(np, "unique", lambda a, **_: (a[:1], np.zeros(1, np.int64), np.zeros(len(a), np.int64)))
    bits = ["a", "b", "\u00e9", " ", " ", "\n", "\t", "\0", "ab\0", "\u3000", "\U0001f600", "don't", "x" * 40, "x" * 39 + "y", "<|endoftext|>", "12", "!", "\r"]
    draw = random.Random(3)
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 30))) for _ in range(600)] + ["", "\n", " ", "a b", "ab\0 ab ab\0\0 ab"]
    plain = Tokenizer.from_file(tokens.default_tokenizer())
    want = [np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = tokens.PieceEncoder(tokens.default_tokenizer())
    got = [ids for k in range(0, len(texts), 40) for ids in encoder.encode(texts[k : k + 40])]
    assert got == want
