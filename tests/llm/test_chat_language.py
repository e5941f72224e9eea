"""Chat formatting and language identification."""

from __future__ import annotations

import hashlib
import json
import random

from quarry.llm import chat, language

MESSY = "a\\b <|im_end|>\\<|im_start|>x \\\\<|| <\\| \n\n|> $1 \\$"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, at int")


def test_rows_round_trip(spark):
    rows = [
        (0, 1, "assistant", MESSY), (0, 0, "user", "hi\nthere"), (1, 0, "assistant", None), (1, 1, None, "who"), (2, 0, "user", ""), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"),
        (4, 0, "as<|im_sep|>x\n", "y"), (5, 0, "assistant", "é日" * 20_000),
    ]
    df = chat.render(chat.turns_of_rows(rows_of(spark, rows)))
    back = {r["conv_id"]: r for r in chat.read_back(df).collect()}
    by = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    for c, turns in by.items():
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == turns
        assert back[c]["loss_text"] == "".join(t for r, t in turns if r == "assistant")
    digest = {r["conv_id"]: r for r in chat.chat_digest(df).collect()}
    want = "".join(f"{r}\n{t}\n" for r, t in by[0])
    assert digest[0]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert digest[2]["loss_chars"] == 0 and digest[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert chat.chat_digest(chat.render(chat.turns_of_rows(rows_of(spark, [])))).count() == 0


def test_layouts_are_told_by_their_paths(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "x"}], "id": 7},
        "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "instruction": {"instruction": "q", "output": "a", "meta": {"k": [1]}},
        "prompt": {"system": "s", "prompt": "q", "completion": "a"},
        "question": {"question": "q", "answer": "a", "context": None},
        None: {"unknown": 1},
    }
    bad = [None, "not json", "[]", '{"messages": []}', '{"messages": "text"}']
    df = spark.createDataFrame([(json.dumps(v), k, "x") for k, v in records.items()] + [(b, None, "x") for b in bad], "record string, want string, turns string").drop("turns")
    got = chat.turns_of_records(df).collect()
    assert len(got) == len(records) + len(bad)
    for r in got:
        assert r["layout"] == r["want"]
        if r["layout"]:
            turns = [(t["role"], t["text"]) for t in r["turns"]]
            assert turns[-2:] == [("user", "q"), ("assistant", "a")]


def test_languages(spark):
    rng = random.Random(0)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwei", "drei", "vier"]}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    docs = spark.createDataFrame([(i, text("ab"[i % 2] * 2, 30), "ab"[i % 2] * 2) for i in range(60)], "doc_id long, text string, lang string")
    model = language.fit_languages(docs)
    page = lambda k, lang, n: f"<html lang='{lang}'><script>{text('aa', 50)}</script><!-- {text('bb', 9)} --><p>{text(k, n)}</p>"
    rows = [(i, f"https://h{i % 3}.example.org/{'ab'[i % 2] * 2}/x", page("ab"[i % 2] * 2, "ab"[i % 2] * 2, 20)) for i in range(40)]
    rows += [(100, "https://h0.example.org/aa/1", page("bb", "aa", 200)), (101, None, None), (102, "no address", ""), (103, "https://h1.example.org/", "<html lang=\"AA\"></html>"), (103, "https://h1.example.org/", "<html lang=\"AA\"></html>")]
    pages = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "page_id long, url string, html string, vote string, total double")
    got = language.identify(pages, model).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and all(0 < r["probability"] <= 1 for r in got)
    assert all(by[i]["lang"] == "ab"[i % 2] * 2 for i in range(40))
    assert by[100]["lang"] == "bb"  # a long text outweighs a false declaration
    assert by[103]["lang"] == "aa" and by[101]["lang"] in ("aa", "bb")
    assert language.identify(pages.limit(0), model).count() == 0
    nothing = language.identify(pages, language.fit_languages(docs.limit(0)))
    assert nothing.count() == len(rows) and nothing.where("lang IS NOT NULL").count() == 0
