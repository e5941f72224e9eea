"""The pipeline's stages, each on what the one before kept, and the registered queries."""

from __future__ import annotations

import corpus_pipeline

from quarry.llm import decontaminate, queries
from quarry.llm.common import stored, table
from test_brute_force import naive_score  # pytest puts this folder on the path
from test_documents import brute_components, brute_lines, crc, encode


def test_stages(spark, testdata):
    d = str(testdata / "sf0.001")
    docs = table(spark, d, "documents")
    before = {r["doc_id"]: r for r in docs.collect()}
    sizes = [len(before)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, d), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert rows.keys() <= before.keys() and all(len(rows[i]["text"]) <= len(before[i]["text"]) for i in rows)
        sizes.append(len(rows))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == rows.keys()
    assert corpus_pipeline.run(spark, d).count() == packed.count()


def test_stages_match_plain_code(spark, testdata):
    """Each stage on what the one before kept, against loops over all rows."""
    from quarry.llm import quality

    d = str(testdata / "sf0.001")
    docs = table(spark, d, "documents").limit(120)
    docs = stored(docs, "documents")
    net = quality.fit_quality(docs, table(spark, d, "labels"), "crc32(cast(doc_id as string)) % 5 != 0")
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        nonlocal docs
        docs = stored(stages[name](spark, docs, d), name)
        return {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    scores = {i: naive_score(net, t) for i, t in want.items()}
    got = run("quality")
    sure = {i for i, x in scores.items() if abs(x - corpus_pipeline.KEEP_QUALITY) > 1e-3}
    assert got.keys() & sure == {i for i in sure if scores[i] >= corpus_pipeline.KEEP_QUALITY}
    want = {i: t for i, t in brute_lines(list(got.items())).items() if t.strip() or t == got[i]}
    got = run("line_dedup")
    assert got == want
    reach = brute_components(list(got.items()), 5, 80)
    want = {i: t for i, t in got.items() if reach[i][1] == i}
    got = run("near_dedup")
    assert got == want
    items = [r["text"] for r in table(spark, d, "benchmark").collect()]
    _, _, plain = decontaminate._joined([t.encode() for t in [*items, *got.values()]])
    items, texts = plain[: len(items)], dict(zip(got, plain[len(items) :], strict=True))
    held = {i for i, t in texts.items() if any(5 * decontaminate.least_distance(x, t) <= len(x) for x in items if x)}
    want = {i: t for i, t in got.items() if i not in held}
    got = run("decontaminate")
    assert got == want
    pieces = stages["packing"](spark, docs, d).collect()
    for i, t in got.items():
        ids, own = encode(t), sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces if r["doc_id"] == i)
        assert own == [(a, n, crc(ids[a : a + n])) for a, n, _ in own] and sum(n for _, n, _ in own) == len(ids)


def test_stages_take_empty_and_odd_documents(spark, testdata):
    d = str(testdata / "sf0.001")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, item_id long"
    odd = spark.createDataFrame([(1, None, None, None, None, 1.0, 1), (2, "", "en", "s", 0, 1.0, 1), (3, "a b", "en", "s", 3, 1.0, 1)], schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, d), name)
        assert docs.count() <= 3


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_bound_arrow_batches_by_bytes(spark, testdata):
    """Long texts come in batches of a bounded size to the packing stage's workers, not 10,000 rows at a time."""
    from pyspark.sql import functions as F

    from quarry.llm import common

    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    sizes = spark.range(60, numPartitions=1).select(F.repeat(F.lit("word "), 100_000).alias("text"))

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    try:
        docs = table(spark, str(testdata / "sf0.001"), "documents").limit(5)
        assert dict(corpus_pipeline.STAGES)["packing"](spark, docs, str(testdata / "sf0.001")).count() >= 5
        rows = sizes.mapInArrow(count, "n long, bytes long").collect()
        assert sum(r["n"] for r in rows) == 60 and max(r["bytes"] for r in rows) < 2 * common.BATCH_BYTES
        spark.conf.set(key, 1 << 20)
        common.bounded_batches(spark)
        assert int(spark.conf.get(key)) == 1 << 20
    finally:
        spark.conf.set(key, before)


def test_packing_asks_for_few_pieces_at_a_time(monkeypatch):
    """Many new pieces go to the library in calls of a bounded size, with the ids of one call over all."""
    from quarry.llm import tokens

    encoder = tokens.PieceEncoder(tokens.default_tokenizer())
    calls = []
    plain = encoder._pieces
    monkeypatch.setattr(encoder, "_pieces", lambda pieces: calls.append(len(pieces)) or plain(pieces))
    text = " ".join(f"w{i:x}z" for i in range(3 * tokens.CALL))
    assert encoder.encode([text]) == encoder._whole([text])
    assert sum(calls) == 3 * tokens.CALL and max(calls) <= tokens.CALL


def test_words_are_encoded_once_whatever_mark_follows(monkeypatch):
    """The library is asked for a word once, not once with each mark behind it, by its model alone, and a full table keeps its size and the ids."""
    import itertools

    from quarry.llm import tokens

    names = ["".join(x) for x in itertools.product("bdfg", "aeio", "lmnr", "aeio")] + ["\u00e9t\u00e9x", "na\u00efve", "stra\u00dfe"]
    text = "x " + " ".join(f"{w}{m}" for m in [".", ",", "!", ";***", "", "'s.", "\u2014,", "\u00a0."] for w in names) + "\nOne\ntwo.\nthr\u00e9e"
    encoder = tokens.PieceEncoder(tokens.default_tokenizer())
    asked, plain = [], encoder._pieces
    monkeypatch.setattr(encoder, "_pieces", lambda pieces: asked.extend(pieces) or plain(pieces))
    assert encoder.encode([text]) == encoder._whole([text])
    assert sum(p.strip() in (b"bala", b"bala.", b"bala,", b"bala!", b"bala;***") for p in asked) == 1 and len(asked) == len(set(asked))
    assert encoder.model is not None and encoder._joined(encoder.model, "\u0120bala\u0120dale", 2) == encoder._whole([" bala", " dale"])
    monkeypatch.setattr(tokens, "ROWS", 16)
    small = tokens.PieceEncoder(tokens.default_tokenizer())
    for _ in range(3):
        assert small.encode([text, text[5:]]) == small._whole([text, text[5:]])
    assert 0 < len(small.now) <= 16 == len(small.table.sizes)
