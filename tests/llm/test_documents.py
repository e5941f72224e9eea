"""Operators on documents: right results against plain code, and what each makes of odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, linededup, media, minhash, packing, quality, tokens, toxicity

WORDS = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, n long, node long, score double"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", None, 1, 2, 3, 0.5) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    base = prose(rng, 80)
    near = base.split()
    near[10] = "other"
    rows = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "two words"), (7, "two words"),
        (8, prose(rng, 40_000)), (9, "Été ñandú 日本語\n" + prose(rng, 30)), (10, prose(rng, 60) + "\n" + prose(rng, 20)), (None, "no id here"), (11, "a\x00b \x00"), (12, "<|endoftext|> it's  here"),
    ]
    return rows


def encode(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return t.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_hold_every_id(spark, odd, encoding):
    got = sorted(tokens.encode_documents(frame(spark, odd), encoding=encoding).collect(), key=lambda r: r["start"])
    want, at = [], 0
    for i, t in sorted(odd, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = encode(t)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in got] == want


def test_token_files_are_read_selectively(spark, odd, tmp_path):
    path = tokens.write_token_files(frame(spark, odd), f"file://{tmp_path}/t")
    plan = tokens.select_tokens(spark, path, 3, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "n_tokens" not in plan
    assert {r["doc_id"] for r in tokens.select_tokens(spark, path, 3, 7).collect()} == {3, 4, 5, 6}


def test_pieces_are_whole_and_sequences_gapless(spark, odd):
    rows = packing.pack(frame(spark, odd)).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[(r["doc_id"], r["ids_crc32"] if r["piece"] == 0 and r["doc_id"] == 7 else 0)].append(r)
    texts = {i: t for i, t in odd}
    for i, t in texts.items():
        ids = encode(t)
        parts = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        if i == 7:
            assert len(parts) == 2  # repeated rows are packed each
            continue
        assert [r["length"] for r in parts[1:]] == [1024] * (len(parts) - 1) and sum(r["length"] for r in parts) == len(ids)
        for r in parts:
            assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_each_item_and_are_few(seed):
    rng = random.Random(seed)
    sizes = collections.Counter(min(1024, int(rng.expovariate(1 / rng.choice([50, 300, 600]))) + 1) for _ in range(4000))
    plan = packing.plan_bins(dict(sizes))
    held = collections.Counter()
    for items, n in plan:
        assert sum(items) <= 1024 and sum(3 * s > 1024 for s in items) <= 2
        for s in items:
            held[s] += n
    assert held == sizes
    # No more than first fit decreasing by more than a hundredth.
    gaps = []
    for s in sorted(sizes.elements(), reverse=True):
        k = next((i for i, g in enumerate(gaps) if g >= s), None)
        if k is None:
            gaps.append(1024 - s)
        else:
            gaps[k] -= s
    assert sum(n for _, n in plan) <= 1.01 * len(gaps) + 1


def test_materialised_sequences(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 900))) for i in range(30)]
    docs = frame(spark, rows)
    files = spark.read.parquet(tokens.write_token_files(docs, tokens.work_path(spark, "tokens")))
    out = packing.sequences(packing.pack(docs), files).collect()
    assert sum(len(r["tokens"]) for r in out) == sum(len(encode(t)) for _, t in rows)
    assert all(len(r["tokens"]) <= 1024 for r in out)


def test_media_is_lossless(spark, odd):
    got = {r["doc_id"]: r for r in media.media_digest(frame(spark, odd)).collect()}
    for i, t in odd:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[0]["feature"] == got[1]["feature"] and got[0]["media_sha256"] == got[1]["media_sha256"]


def test_media_frames_of_any_bytes():
    rng = np.random.default_rng(0)
    units = np.asarray([1, 9000, 2, media.MAX_HIGH, media.MAX_HIGH + 1])
    payload = rng.integers(0, 256, int(units.sum()) * 192).astype(np.uint8)
    images = media.encode_images(payload, units)
    assert b"".join(f.tobytes() for frames in media.decode_dc(images) for f in frames) == payload.tobytes()
    assert all(x[:2] == b"\xff\xd8" and x[-2:] == b"\xff\xd9" for x in images)


def brute_components(rows, size, percent):
    pattern, fold = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = pattern.findall((t or "").translate(fold))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for _ in range(12):
        base = prose(rng, rng.randint(3, 150)).split()
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS).upper()
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "solo"), (n + 4, "Solo"), (n + 5, rows[0][1])]
    want = brute_components(rows, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == want
    want5 = brute_components(rows, 5, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()} == want5


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = minhash.near_duplicates(frame(spark, odd)).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert len(rows) == 15 and by[1] == {(76, 0, False)} and by[3] == {(0, 3, True)} and by[7] == {(1, 7, True)} and by[None] == {(1, None, True)}


def test_ids_that_are_repeated_or_null(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(3, a), (7, a), (7, b), (9, b), (9, None), (5, c), (None, c), (5, c), (5, c)]
    got = collections.Counter(tuple(r) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == {(3, 36, 3, True): 1, (7, 36, 3, False): 2, (9, 36, 3, False): 1, (9, 0, 9, True): 1, (5, 36, None, False): 3, (None, 36, None, True): 1}
    left = collections.Counter((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(frame(spark, rows)).collect())
    assert left == {(3, a): 1, (9, None): 1, (None, c): 1}
    rows = [(3, a), (7, a), (7, b), (7, b)]  # b is a copy of nothing but shares its id with a
    assert collections.Counter((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(frame(spark, rows)).collect()) == {(3, a): 1}
    rows = [(8, a), (8, a), (9, b)]
    assert collections.Counter((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(frame(spark, rows)).collect()) == {(8, a): 1, (9, b): 1}


def test_contaminated_rows_go_and_others_of_their_id_stay(spark):
    rng = random.Random(13)
    item = prose(rng, 20)
    rows = [(1, "x " + item), (1, "clean text"), (None, item), (None, "also clean"), (2, None), (1, "x " + item)]
    got = decontaminate.drop_contaminated(frame(spark, rows), benchmark(spark, [(0, item)])).select("doc_id", "text").collect()
    assert collections.Counter(map(tuple, got)) == {(1, "clean text"): 1, (None, "also clean"): 1, (2, None): 1}


def test_columns_may_have_any_name(spark):
    rng = random.Random(21)
    item, other = prose(rng, 20), prose(rng, 30)
    rows = [(1, item, 7, "a", 1), (2, other, 8, "b", 2), (3, other, 9, "c", 3), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc long, tid string, lines int").withColumnsRenamed({"tid": "_tid"})
    assert {tuple(r) for r in decontaminate.drop_contaminated(docs, benchmark(spark, [(None, item)])).collect()} == {rows[1], rows[2], rows[3]}
    assert {tuple(r) for r in minhash.drop_near_duplicates(docs).collect()} == {rows[0], rows[1], rows[3]}
    named = docs.withColumnsRenamed({"_doc": "doc", "_tid": "tid"}).withColumn("gone", docs["lines"] + 1).withColumn("kept", docs["lines"])
    keep = ("doc", "tid", "lines", "gone", "kept")
    got = {r["doc_id"]: (r["text"], *[r[c] for c in keep]) for r in linededup.dedup_lines(named, keep=keep).collect()}
    assert got == {1: (item, 7, "a", 1, 2, 1), 2: (other, 8, "b", 2, 3, 2), 3: ("", 9, "c", 3, 4, 3), None: ("", None, None, None, None, None)}
    found = decontaminate.contaminated(docs, benchmark(spark, [(None, item)])).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, None)]


def brute_lines(rows, percent=80):
    lines, seen = {}, []
    for i, t in sorted(rows):
        out = []
        for line in (t or "").split("\n"):
            w = line.lower().split()
            s = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}) if w else None
            hit = s is not None and any(100 * len(s & o) >= percent * len(s | o) for o in seen)
            if s is not None:
                seen.append(s)
            if not hit:
                out.append(line)
        lines[i] = "\n".join(out)
    return lines


def test_wanted_lines_alone_are_put_in_lower_case_again(spark, monkeypatch):
    """All lines are made once; those that are verified come from their documents by number, with capitals, accents and tabs as in the first pass."""
    rng = random.Random(8)
    base = prose(rng, 40)
    near = base.replace(" ", "\t", 3).upper() + " \u00c9T\u00c9"
    rows = [(0, f"\n{base} \u00e9t\u00e9\n\n{prose(rng, 30)}"), (1, f"{prose(rng, 30)}\n{near}\nkept \u03a3\u0391\u03a3"), (2, f"{near} more\nx"), (3, None), (-1, near)]
    calls, plain = [], linededup._lines
    monkeypatch.setattr(linededup, "_lines", lambda d: calls.append(1) or plain(d))
    got = linededup.dedup_lines(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute_lines(rows)
    assert len(calls) == 1


def test_runs_are_hashed_in_one_expression(spark):
    """Sets share just what their runs of five words (or all words of shorter lines) share, and no array of words passes through a row."""
    rng = random.Random(21)
    pool = ["a", "b", "ab", "ba", "c"]
    lines = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    lines += ["a", "a a", "a a a", "a a a a", "a a a a a", "a a a a a a", " a  b ", "a b", "ab", "   ", "a b c ab", "a b c ab ba", "x a b c ab ba", "a b x ab ba"]
    tokens = linededup._tokens(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id long, line string"), "id")
    got = {r["id"]: r["tokens"] for r in tokens.collect()}
    assert all(t == sorted(set(t)) for t in got.values())
    words = [t.split() for t in lines]
    want = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for w in words]
    name = {run: token for i, runs in enumerate(want) if len(runs) == 1 for run, token in zip(runs, got[i], strict=True)}
    assert len(set(name.values())) == len(name)
    for i, runs in enumerate(want):
        assert len(got[i]) == len(runs) and {name[r] for r in runs if r in name} <= set(got[i])
        for j in range(i):
            assert len(set(got[i]) & set(got[j])) == len(runs & want[j])
    assert "AS words" not in tokens._jdf.queryExecution().optimizedPlan().toString()


def test_tables_of_hashes_have_no_dictionaries(spark):
    table = linededup.stored(spark.range(1000).select(F.xxhash64(F.col("id") % 10).alias("token"), F.array(F.xxhash64(F.col("id") % 10)).alias("tokens")), "hashes")
    for name in table.inputFiles():
        about = pyarrow.parquet.ParquetFile(name.removeprefix("file://")).metadata.row_group(0)
        assert not any(about.column(k).has_dictionary_page for k in range(about.num_columns))
    assert table.where(F.get("tokens", F.lit(0)) == F.col("token")).count() == 1000


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    pool = [prose(rng, rng.randint(1, 70)) for _ in range(25)]
    common = prose(rng, 40)
    rows = []
    for i in range(120):
        own = []
        for _ in range(rng.randint(0, 5)):
            words = rng.choice(pool).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            own.append(" ".join(words))
        own.append(common + " " + prose(rng, 45))  # a passage that most lines share
        rows.append((i, "\n".join(own)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, pool[0] + "\n" + pool[0].upper())]
    got = linededup.dedup_lines(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute_lines(rows)
    assert sum(r["n_removed"] for r in got) > 0


def test_line_dedup_orders_tokens_of_frequent_passages(spark, monkeypatch):
    """Few lines share a token here, so each kind of pair occurs with a small bound; repeated, null and equal ids too."""
    monkeypatch.setattr(linededup, "FREQUENT", 4)
    rng = random.Random(14)
    pool, passage = [prose(rng, rng.randint(3, 30)) for _ in range(12)], prose(rng, 14)
    rows = []
    for d in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(pool).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            if rng.random() < 0.4:
                words += passage.split() + [rng.choice(WORDS)]
            own.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
        rows.append((d, "\n".join(own)))
    rows += [rows[3], rows[10], (-5, rows[5][1]), (70, None), (71, "")]
    got = collections.Counter((r["doc_id"], r["text"]) for r in linededup.dedup_lines(frame(spark, rows)).collect())
    want = brute_lines(set(rows) - {(70, None)})
    assert got == collections.Counter((i, want.get(i, "")) for i, _ in rows)


def test_line_dedup_runs_no_python(spark):
    plan = linededup.dedup_lines(frame(spark, [(0, "a b c d e f\na b c d e f")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_of_odd_rows(spark, odd):
    got = linededup.dedup_lines(frame(spark, odd)).collect()
    assert len(got) == len(odd)
    texts = collections.Counter((r["doc_id"], r["text"]) for r in got)
    assert texts[(1, "")] == 1 and texts[(7, "two words")] == 2 and texts[(3, "")] == 1 and texts[(None, "no id here")] == 1


def test_media_features_come_from_stored_images(spark):
    df = media.media_digest(frame(spark, [(1, "some text"), (2, None), (3, "more " * 300)]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and re.search(r"parquet.*media", plan)
    assert {r["doc_id"]: r["payload_bytes"] >= r["n_bytes"] for r in df.collect()} == {1: True, 2: True, 3: True}


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination_finds_exact_and_edited_passages(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randint(12, 60))) for k in range(20)] + [(90, None), (91, ""), (92, "...")]
    rows, planted = [], set()
    for i in range(150):
        text = prose(rng, rng.randint(5, 400))
        if i % 3 == 0:
            k, item = items[rng.randrange(20)]
            words = item.split()
            if i % 2:
                words[rng.randrange(len(words))] = "changed"
            text = text + " " + " ".join(words).upper() + ". " + prose(rng, 10)
            planted.add((i, k))
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, prose(rng, 30_000) + " " + items[0][1]), (903, items[1][1]), (None, items[2][1])]
    planted |= {(902, 0), (903, 1), (None, 2)}
    got = decontaminate.contaminated(frame(spark, rows), benchmark(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted
    texts = dict(rows)
    for r in got:
        passage = texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
        assert r["distance"] <= 0.2 * r["item_chars"] and abs(len(passage) - r["item_chars"]) <= r["distance"] + 2


def test_decontamination_in_blocks_and_of_nothing(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, 20)) for k in range(30)]
    rows = [(k, "x " + t) for k, t in items]
    got = decontaminate.contaminated(frame(spark, rows), benchmark(spark, items), block_items=7).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, k) for k in range(30)}
    assert decontaminate.contaminated(frame(spark, []), benchmark(spark, items)).count() == 0
    assert decontaminate.contaminated(frame(spark, rows), benchmark(spark, [])).count() == 0


def test_least_distance_is_the_edit_distance():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 70))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, x in enumerate(b, 1):
                last, row[j] = row[j], min(last + (c != x), row[j] + 1, row[j - 1] + 1)
        assert decontaminate.least_distance(a, b) == min(row)
        if a:
            assert decontaminate.best_passage(a, b)[0] == min(row)


def mistyped(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (kind != 1)] = [rng.choice("abcdefghijklmnopqrstuvwxyz")] if kind < 2 else []
    return "".join(out)


def test_decontamination_finds_character_edits_up_to_the_bound(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    plain = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, plain(rng.choice((12, 18, 30, 55)))) for k in range(80)]
    for percent, least in ((5, 80), (10, 80), (15, 80), (20, 76)):
        rows = [(k, f"{plain(40)} {mistyped(rng, t, len(t) * percent // 100)} {plain(40)}") for k, t in items]
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), benchmark(spark, items)).collect()}
        want = {(d, i) for d, text in rows for i, t in items if d == i and 100 * decontaminate.least_distance(t, text) <= 20 * len(t)}
        assert len(want) >= 79 and got <= want and len(got) >= least, (percent, len(got), len(want))


def test_decontamination_finds_short_items_and_texts_without_spaces(spark):
    rng = random.Random(9)
    signs = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))
    items = [(0, "ab"), (1, "quokka jumps"), (2, signs[100:160]), (3, "zebra")]
    rows = [(0, "x ab y"), (1, "the quokka jumqs high"), (2, signs[:120] + "\u3042\u3044" + signs[122:]), (3, "one zebra"), (4, "nothing else here"), (5, "")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), benchmark(spark, items)).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_least_distances_equal_those_of_single_pairs():
    rng = np.random.default_rng(10)
    patterns = [rng.integers(0, 4, n).astype(np.uint8) for n in (1, 7, 60, 64)]
    text = rng.integers(0, 4, 500).astype(np.uint8)
    low, size, pattern = rng.integers(0, 400, 50), rng.integers(0, 100, 50), rng.integers(0, 4, 50)
    got = decontaminate.least_distances(patterns, pattern, text, low, size)
    assert got.tolist() == [decontaminate.least_distance(bytes(patterns[p]).decode(), bytes(text[a : a + n]).decode()) for p, a, n in zip(pattern, low, size, strict=True)]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_learns_and_scores_all(spark, odd):
    rng = random.Random(8)
    rows = [(i, (prose(rng, 60).capitalize() + ".") if i % 2 else " ".join(w + "!!" for w in prose(rng, 60).upper().split())) for i in range(200)]
    labels = labelled(spark, [(i, i % 2, 0) for i in range(200)] + [(1000, None, None)])
    net = quality.fit_quality(frame(spark, rows), labels, "doc_id % 5 <> 0", per_label=60)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(frame(spark, rows), net).collect()}
    held = [i for i in range(0, 200, 5)]
    assert sum((got[i] >= 0.3) == bool(i % 2) for i in held) >= 0.95 * len(held)
    more = quality.score_quality(frame(spark, odd), net).collect()
    assert len(more) == len(odd) and all(0 <= r["score"] <= 1 for r in more)
    assert quality.score_quality(frame(spark, []), net).count() == 0
    small, whole = (quality.score_quality(frame(spark, odd), net, n).collect() for n in (3000, 1 << 20))
    assert all(abs(a["score"] - b["score"]) < 1e-5 for a, b in zip(small, whole, strict=True))  # pieces of a long text make no difference


def test_quality_without_both_labels(spark):
    docs = frame(spark, [(0, "a"), (1, "b")])
    for rows, low, high in (([], 0.49, 0.51), ([(0, 1, 0)], 0.9, 1), ([(1, 0, 0)], 0, 0.1)):
        net = quality.fit_quality(docs, labelled(spark, rows), "true")
        assert all(low <= r["score"] <= high for r in quality.score_quality(docs, net).collect())


def brute_segments(score):
    """All maximal segments by their definition: the best one, then the same on either side."""
    if not len(score) or max(score) <= 0:
        return []
    total = np.concatenate([[0], np.cumsum(score)])
    best = max(((total[j] - total[i], -(j - i), i, j) for i in range(len(score)) for j in range(i + 1, len(score) + 1)))
    i, j = best[2], best[3]
    return brute_segments(score[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(score[j:])]


def test_maximal_segments_match_definition():
    rng = np.random.default_rng(9)
    for _ in range(150):
        score = np.round(rng.normal(-0.2, 1, rng.integers(0, 25)), 3) + rng.normal(0, 1e-6)
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(score)] == brute_segments(score)


def test_toxicity_learns_unseen_words_of_known_stems(spark, odd):
    rng = random.Random(10)
    bad = [f"vile{x}{y}" for x in "abcdefgh" for y in "klmnopqrs"]
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, 50).split()
        if i % 4 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad[:60] if i % 5 else bad[60:]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    model = toxicity.fit_toxicity(frame(spark, rows), labelled(spark, labels), "doc_id % 5 <> 0")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(frame(spark, rows), model).collect()}
    held = [i for i in range(0, 400, 5)]
    assert sum((got[i]["score"] >= 0.7) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    text = dict(rows)[0]
    assert any("vile" in text[p["start"] : p["end"]] for p in got[0]["passages"])
    more = toxicity.score_toxicity(frame(spark, odd), model).collect()
    assert len(more) == len(odd) and all(0 <= r["score"] <= 1 for r in more)
    assert next(r for r in more if r["doc_id"] == 3)["passages"] == []


def test_empty_tables(spark):
    none = frame(spark, [])
    assert tokens.encode_documents(none).count() == 0
    assert packing.pack(none).count() == 0
    assert media.media_digest(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    model = toxicity.fit_toxicity(none, labelled(spark, []), "true")
    assert toxicity.score_toxicity(none, model).count() == 0
