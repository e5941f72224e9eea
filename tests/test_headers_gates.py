"""The header data source, gated publication, digest trees, open maps and budgets."""

from __future__ import annotations

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from quarry.operators import identity, joins, publish
from quarry.sources import headers


def text(s):
    return struct.pack("<Q", len(s)) + s.encode()


def header(arch, n_tensors, padding=0):
    meta = [text("general.architecture") + struct.pack("<I", 8) + text(arch), text("general.note") + struct.pack("<I", 8) + text("x" * padding)]
    tensors = b"".join(text(f"blk.{i}.w") + struct.pack("<I2Q", 2, 3, i + 1) + struct.pack("<IQ", 0, 64 * i) for i in range(n_tensors))
    return b"GGUF" + struct.pack("<IQQ", 3, n_tensors, len(meta)) + b"".join(meta) + tensors


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("headers")
    (at / "deep").mkdir()
    for i in range(1000):
        (at / ("deep" if i % 2 else ".") / f"m{i:04d}.gguf").write_bytes(header(f"a{i % 5}", 40, 5_000 if i % 100 == 0 else 0) + b"\0" * 4096)
    (at / "broken.gguf").write_bytes(b"GGUF" + struct.pack("<IQQ", 3, 1, 5))
    (at / "other.gguf").write_bytes(b"no header")
    (at / "notes.txt").write_text("aside")
    return at


def test_columns_say_how_far_headers_are_read(spark, folder):
    path = f"file://{folder}"
    spark.dataSource.register(headers.HeaderSource)
    few = headers.read_header_columns(spark, path, ["path", "arch", "bytes_read", "error"], "*.gguf").collect()
    assert len(few) == 1002
    whole = {r["path"]: r for r in headers.read_header_columns(spark, path, ["path", "arch", "tensors", "data_start", "bytes_read", "length", "error"], "*.gguf").collect()}
    fine = [r for r in few if r["error"] is None]
    assert len(fine) == 1000 and {r["arch"] for r in fine} == {f"a{i}" for i in range(5)}
    for r in few:
        assert whole[r["path"]]["arch"] == r["arch"] and (whole[r["path"]]["error"] is None) == (r["error"] is None)
    some = whole[next(r["path"] for r in fine)]
    assert len(some["tensors"]) == 40 and some["tensors"][3]["dims"] == [3, 4] and some["data_start"] % 32 == 0
    # With small ranges, no byte behind the metadata is read where only the architecture is wanted.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    small = lambda c: spark.read.format("model_headers").schema(c).option("glob", "m*.gguf").option("first", 100).load(path)
    assert all(r["bytes_read"] <= (100 if "00.gguf" not in r["path"] else 25_600) for r in small("path string, arch string, bytes_read long").collect())
    assert min(r["bytes_read"] for r in small("path string, tensors array<struct<name:string,dims:array<long>,kind:int,offset:long>>, bytes_read long").collect()) > 1_000


def test_filters_on_paths_leave_files_unopened(spark, folder):
    df = headers.read_header_columns(spark, f"file://{folder}", ["path", "arch"], "*.gguf")
    one = f"file://{folder}/m0002.gguf"
    picked = df.where(F.col("path") == one)
    assert [tuple(r) for r in picked.collect()] == [(one, "a2")] and picked.rdd.getNumPartitions() == 1
    assert df.where(F.col("path").startswith(f"file://{folder}/deep/") & (F.col("arch") == "a1")).count() == 100
    assert df.where(F.col("path").isin(one, "nothing")).count() == 1
    reader = headers.HeaderReader({"path": f"file://{folder}", "glob": "*.gguf"}, df.schema)
    assert len(reader.partitions()) == 4 and max(len(p.files) for p in reader.partitions()) == headers.FILES
    assert list(reader.pushFilters([headers.EqualTo(("path",), one), headers.EqualTo(("arch",), "a2")])) == [headers.EqualTo(("arch",), "a2")]
    assert [p.files for p in reader.partitions()] == [[(one, (folder / "m0002.gguf").stat().st_size)]]
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("model_headers").schema("path string, nothing int").load(f"file://{folder}").collect()
    assert headers.read_header_columns(spark, f"file://{folder}", ["path"], "*.none").count() == 0


def test_a_failed_gate_stops_publication(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") / 10)
    out = f"file://{tmp_path}/table"
    gates = {"enough": F.count("*") >= 50, "in_range": F.bool_and(F.col("v").between(0, 10)), "known": F.count_if(F.col("v").isNull()) == 0}
    assert publish.publish_gated(df, out, gates) == {"enough": True, "in_range": True, "known": True}
    with pytest.raises(publish.GateFailed, match="enough, in_range"):
        publish.publish_gated(df.limit(3).withColumn("v", F.lit(99.0)), out, gates)
    with pytest.raises(publish.GateFailed, match="in_range"):  # a gate that can't be told doesn't hold
        publish.publish_gated(df.limit(0), out, {"in_range": gates["in_range"]})
    assert spark.read.parquet(out).count() == 100 and [p.name for p in tmp_path.iterdir()] == ["table"]
    publish.publish_gated(df.limit(60), out, gates)
    assert spark.read.parquet(out).count() == 60


@pytest.mark.parametrize("partitions", [1, 7])
def test_digest_trees_depend_on_the_order_alone(spark, partitions):
    rng = random.Random(3)
    rows = [(g, rng.randint(-50, 3_000), str(rng.random())) for g in ("a", None) for _ in range(300)] + [("a", None, "x"), ("b", 1 << 40, "far")]
    want = {}
    for g in ("a", "b", None):
        level = [(o is not None, o or 0, m) for k, o, m in rows if k == g]
        level = [(known, o, m) for known, o, m in level]
        for _ in range(6):  # 1024 ** 6 = 2 ** 60
            by = {}
            for known, o, m in level:
                by.setdefault((known, o // 1024 if known else 0), []).append((known, o, m))
            level = [(known, o, hashlib.sha256("".join(m for _, _, m in sorted(x)).encode()).hexdigest()) for (known, o), x in by.items()]
        want[g] = hashlib.sha256("".join(m for _, _, m in sorted(level)).encode()).hexdigest()
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, o long, m string").repartition(partitions)
    assert {r["g"]: r["mark"] for r in identity.group_marks(df, "g", "o", "m", 1024).collect()} == want


def test_scalars_of_open_maps(spark):
    record = {"a": 1, "b": "x\"y", "c": [1], "d": None, "e": {"f": 2}, "g": 1.5, "h": True, "i j": ""}
    rows = [(1, json.dumps(record)), (1, json.dumps(record)), (2, "[1]"), (3, None), (4, "broken {"), (5, "{}"), (None, '{"z": 2}'), (6, '"text"')]
    df = spark.createDataFrame(rows, "k int, record string")
    got = sorted(((r["k"], r["name"], r["value"]) for r in publish.scalar_fields(df, "k", "record").collect()), key=repr)
    one = [(1, "a", "1"), (1, "b", 'x"y'), (1, "d", None), (1, "g", "1.5"), (1, "h", "true"), (1, "i j", "")]
    assert got == sorted([*one, *one, (None, "z", "2")], key=repr)
    assert {r["name"] for r in publish.open_fields(df.where("k = 1"), "k", "record").collect()} == set(record)
    assert publish.scalar_fields(df.limit(0), "k", "record").count() == 0


@pytest.mark.parametrize("limit", [0, 37.5, 500, 1e9])
def test_budgets_cut_the_order(spark, limit):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 1.0, 1.0, float(rng.randint(0, 30))]), rng.choice([None, -3.0, 0.0, 0.5, 2.0, 7.25])) for i in range(400)]
    got = {r["i"]: r["spent"] for r in joins.within_budget(spark.createDataFrame(rows, "i int, o double, c double"), "o", "i", "c", limit, 16).collect()}
    spent, want = 0.0, {}
    for i, _, c in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        spent += max(c or 0, 0)
        if spent > limit:
            break
        want[i] = spent
    assert got == want
    assert joins.within_budget(spark.createDataFrame([], "i int, o double, c double"), "o", "i", "c", 5).count() == 0
