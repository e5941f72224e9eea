"""Evidence operators on hand-made cases."""

from __future__ import annotations

import json

from quarry.operators import evidence


def test_alias_constraints(spark):
    rows = [
        ("d1", "f", "8b-1m", [0]), ("d1", "f", "1m", [0]), ("d2", "f", "8x7b", [8]), ("d2", "f", "7b-8e", [8]), ("d3", "f", "8x7b", [4]), ("d3", "f", "7b-8e", [4]),
        ("d4", "f", "latest", None), ("d4", "f", "base", None), ("d4", "f", "chat", None),
    ]
    df = spark.createDataFrame(rows, "digest string, family string, tag string, expert_counts array<bigint>")
    got = {r["digest"]: (r["sizes"], r["modes"], r["qualifiers"], r["conflict"]) for r in evidence.alias_constraints(df).collect()}
    assert got["d1"] == (["8b"], [], ["1m"], False)
    assert got["d2"] == (["7b"], [], ["8e"], False)
    assert got["d3"] == (["7b", "8x7b"], [], ["8e"], True)
    assert got["d4"] == ([], ["base", "chat"], [], True)


def test_verdicts_are_grounded(spark):
    card = "This is the  Original\ncheckpoint of M (7B)."
    reason = "the card names it as the original release"
    good = {"exact_release": "yes", "upstream": "yes", "quote": "the original checkpoint of M (7B).", "reason": reason}
    cases = [
        (json.dumps(good), None), ("text " + json.dumps(good) + " more", None), (json.dumps(good | {"quote": "not there"}), "quote not in card"), (json.dumps(good | {"quote": ""}), "no quote"),
        (json.dumps(good | {"reason": "..."}), "no reason"), (json.dumps(good | {"upstream": "maybe"}), "vocabulary"), ("nothing", "no JSON"), (None, "no JSON"),
        (json.dumps({"exact_release": "no", "upstream": "uncertain"}), None),
    ]
    df = spark.createDataFrame([(i, r, card) for i, (r, _) in enumerate(cases)], "i int, reply string, card string")
    got = {r["i"]: r for r in evidence.grounded_verdicts(df, "reply", "card").collect()}
    assert [got[i]["error"] for i in range(len(cases))] == [e for _, e in cases]
    assert got[0]["verdict"]["quote"] == "the  Original\ncheckpoint of M (7B)."


def test_verdicts_statuses_and_queue(spark):
    d = spark.createDataFrame(
        [("x", "f", "k1", "r1", "likely", "name", []), ("y", "f", "k2", "r2", "likely", "name", []), ("z", "f", "k3", None, "unresolved", None, ["b", "a"]), ("z", "g", "k4", None, "conflict", None, [])],
        "digest string, family string, decision_key string, repo string, status string, method string, missing array<string>",
    )
    kind = "decision_key string, repo string, verdict struct<exact_release:string,upstream:string,quote:string,reason:string>"
    v = spark.createDataFrame([("k1", "r1", ("yes", "yes", "q", "a reason of some length")), ("k2", "r2", ("no", "yes", "", "x")), ("k3", "other", ("no", "no", "", ""))], kind)
    after = evidence.with_verdicts(d, v)
    assert {r["decision_key"]: (r["status"], r["repo"], r["method"]) for r in after.collect()} == {
        "k1": ("likely", "r1", "semantic_verified"), "k2": ("rejected", None, None), "k3": ("unresolved", None, None), "k4": ("conflict", None, None),
    }
    status = evidence.artifact_status(after)
    assert {r["digest"]: r["status"] for r in status.collect()} == {"x": "likely", "y": "unresolved", "z": "conflict"}
    queue = evidence.work_queue(after, status)
    assert {(r["decision_key"], r["action"], tuple(r["repos"])) for r in queue.collect()} == {("k2", "review_or_search", ()), ("k3", "review_conflict", ()), ("k4", "review_conflict", ())}
    calm = evidence.work_queue(after.where("digest = 'z' AND decision_key = 'k3'"), status.where("digest = 'z'").replace("conflict", "unresolved"))
    assert [tuple(r) for r in evidence.fetch_plan(calm).collect()] == [("a", 1), ("b", 1)]


def test_exact_matches(spark):
    rows = [("d", [("hf", "o", "n", "c", "p"), ("hf", "o", "n", "c", "p"), ("x", "o", "n", "c", "p"), ("hf", "", "n", "c", "p")])]
    df = spark.createDataFrame(rows, "digest string, matches array<struct<source:string,org:string,name:string,commit_sha:string,path:string>>")
    assert [tuple(r) for r in evidence.exact_matches(df).collect()] == [("d", "o/n", "c", "p")]
