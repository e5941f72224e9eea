"""JSON lines, JSON documents, CSV tables and binary headers as DataFrames; publication of small documents."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import tables
from quarry.operators.joins import last_write_wins

GPU_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "name", "vendor", "type", "generation")]
    + [T.StructField(n, T.DoubleType()) for n in ("memory_gb", "usable_fraction", "bandwidth_gbs", "fp16_tflops")]
    + [T.StructField("notes", T.StringType())]
)


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines of one or more paths or globs; blank lines go, broken ones too unless strict, then they fail."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json(list(paths) if not isinstance(paths, str) else paths)


def read_models(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Catalog rows from JSON lines, or from a document {"models": [...]}; broken ones fail."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema, strict=True)
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    document = spark.read.schema(T.StructType([T.StructField("models", T.ArrayType(fields))])).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return document.select(F.inline("models"))


def read_store(spark: SparkSession, path: str, schema: T.StructType | str, key: str, order: Sequence[str] = ()) -> DataFrame:
    """An append-only store: the last row of each key by the order columns, else by its place in the files (by their names)."""
    rows = read_jsonl(spark, path, schema)
    columns = rows.columns
    # Rows of a piece of a file are read in order, so a growing number orders them; pieces are ordered by file and offset.
    place = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    kept = place.where(F.col(key).isNotNull())
    return last_write_wins(kept, [key], [*order] if order else ["_file", "_block", "_row"]).select(*columns)


def read_gpus(spark: SparkSession, path: str) -> DataFrame:
    """The device table: a CSV with a header, empty cells are null."""
    return spark.read.schema(GPU_SCHEMA).option("header", True).option("nullValue", "").csv(path)


def read_documents(spark: SparkSession, folder: str, schema: T.StructType | str, key: str = "key") -> DataFrame:
    """A folder of JSON documents; the name of a file without its ending is the key."""
    df = spark.read.schema(schema).option("multiLine", True).json(folder)
    return df.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias(key), *df.columns)


def rows_first(cache: DataFrame, library: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key the cache's whole row counts, not its single fields."""
    rest = [c for c in library.columns if c != key]
    a, b = (df.select(key, F.struct(*rest).alias(n)) for df, n in ((cache, "_a"), (library, "_b")))
    return a.join(b, key, "full_outer").select(key, F.coalesce("_a", "_b").alias("row")).select(key, "row.*")


def read_hashed(spark: SparkSession, path: str) -> DataFrame:
    """Files with their bytes' SHA-256: path, length, sha256, content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


class CutOff(ValueError):
    """The bytes end before the header does."""


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, code: str):
        size = struct.calcsize("<" + code)
        if self.at + size > len(self.data):
            raise CutOff("header is cut off")
        self.at += size
        return struct.unpack_from("<" + code, self.data, self.at - size)[0]

    def text(self) -> str:
        n = self.take("Q")
        if self.at + n > len(self.data):
            raise CutOff("header is cut off")
        self.at += n
        return self.data[self.at - n : self.at].decode(errors="replace")

    def value(self, kind: int, keep: bool):
        if kind == tables.HEADER_STRING:
            return self.text()
        if kind == tables.HEADER_ARRAY:
            inner, n = self.take("I"), self.take("Q")
            items = [self.value(inner, keep) for _ in range(n)]
            return items if keep or n <= tables.LONGEST_ARRAY else {"length": n}
        return self.take(tables.HEADER_SCALARS[kind])


def decode_header(data: bytes, tensors: bool = True) -> dict:
    """Version, metadata (JSON by key; long arrays by their length), and, if wanted, tensors and where their data starts."""
    if data[:4] != b"GGUF":
        raise ValueError("not a header of this format")
    r = _Bytes(data)
    r.at = 4
    version, n_tensors, n_meta = r.take("I"), r.take("Q"), r.take("Q")
    meta = {}
    for _ in range(n_meta):
        key = r.text()
        meta[key] = r.value(r.take("I"), key.endswith(tables.KEEP_ENDINGS))
    found = []
    for _ in range(n_tensors if tensors else 0):
        name, n = r.text(), r.take("I")
        found.append({"name": name, "dims": [r.take("Q") for _ in range(n)], "kind": r.take("I"), "offset": r.take("Q")})
    align = int(meta.get("general.alignment") or 32)
    known = {"tensors": found, "data_start": -(-r.at // align) * align} if tensors else {"tensors": None, "data_start": None}
    return {"version": version, "metadata": {k: json.dumps(v) for k, v in meta.items()}} | known


HEADER = "path string, length long, version int, metadata map<string,string>, tensors array<struct<name:string,dims:array<long>,kind:int,offset:long>>, data_start long, error string"
_ARROW = pa.schema(
    [
        ("path", pa.string()), ("length", pa.int64()), ("version", pa.int32()), ("metadata", pa.map_(pa.string(), pa.string())),
        ("tensors", pa.list_(pa.struct([("name", pa.string()), ("dims", pa.list_(pa.int64())), ("kind", pa.int32()), ("offset", pa.int64())]))), ("data_start", pa.int64()), ("error", pa.string()),
    ]
)


#: Bytes of a file that are read first; four times as many where the header is longer, up to the last figure.
FIRST_BYTES, MOST_BYTES = 8 << 20, 512 << 20


def _header_of(path: str, length: int) -> dict:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    size = FIRST_BYTES
    with system.open_input_file(place) as f:
        while True:
            try:
                return decode_header(f.read_at(min(size, length), 0))
            except CutOff:
                if size >= min(length, MOST_BYTES):
                    raise
                size *= 4


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Binary headers under a path, decoded where they lie; a broken one keeps its row with an error.

    Only the beginning of a file is read, in growing ranges, so its size
    doesn't matter. The paths must be such as the executors' file systems know.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, n in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                row = {"path": p, "length": n}
                try:
                    row |= _header_of(p, n)
                except (ValueError, KeyError, OSError) as e:
                    row["error"] = str(e) or type(e).__name__
                row["metadata"] = list(row["metadata"].items()) if "metadata" in row else None
                yield pa.RecordBatch.from_pylist([row], _ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "length").mapInArrow(run, HEADER)


def tensor_sizes(headers: DataFrame) -> DataFrame:
    """A row for each tensor with its bytes: the next offset less its own, at last the length of the data."""
    t = headers.select("path", (F.col("length") - F.col("data_start")).alias("data_bytes"), F.posexplode("tensors").alias("place", "t")).select("path", "data_bytes", "place", "t.*")
    after = F.coalesce(F.lead("offset").over(Window.partitionBy("path").orderBy("offset", "place")), F.col("data_bytes"))
    params = F.aggregate("dims", F.lit(1).cast("long"), lambda a, d: a * d)
    return t.select("path", "name", "kind", params.alias("params"), F.greatest(F.lit(0), after - F.col("offset")).alias("bytes"))


def tensor_group(name: Column) -> Column:
    """Group of a tensor by its name, in the order of the rules."""
    def starts(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.startswith(name, F.lit(p))
        return out

    return (
        F.when(starts("per_layer_token_embd"), "ple")
        .when(starts("token_embd"), "token_embd")
        .when(starts("v.", "mm.", "a."), "vision")
        .when(starts("output"), "output")
        .when(F.contains(name, F.lit("_exps.")), "ffn_expert")
        .when(F.contains(name, F.lit(".attn_")), "attn")
        .when(F.contains(name, F.lit(".ffn_")), "ffn_dense")
        .otherwise("other")
    )


def group_bytes(tensors: DataFrame) -> DataFrame:
    """Bytes, parameters and tensors by file and group."""
    return tensors.groupBy("path", tensor_group(F.col("name")).alias("group")).agg(F.sum("bytes").alias("bytes"), F.sum("params").alias("params"), F.count("*").alias("n"))


def header_facts(headers: DataFrame) -> DataFrame:
    """What the catalog takes from a header: layers, heads, lengths, cache bytes a token, bytes and parameters by use.

    A value a layer may be a list, which its last value fills up; a list that
    was too long to keep counts as missing. Layers that share a cache at the
    end add nothing; layers in the window pattern grow with the window only.
    """
    h = headers.where("error IS NULL").withColumn("arch", F.coalesce(F.trim(F.try_element_at("metadata", F.lit("general.architecture")), F.lit('"')), F.lit("unknown")))

    def raw(key: str) -> Column:
        return F.try_element_at(F.col("metadata"), F.concat(F.col("arch"), F.lit("." + key)))

    def number(key: str) -> Column:
        return F.coalesce(raw(key).try_cast("double").cast("long"), F.lit(0))

    def filled(items: Column) -> Column:
        last = F.element_at(items, -1)
        return F.slice(F.concat(items, F.array_repeat(last, F.greatest(F.lit(0), F.col("n_layer") - F.size(items)).cast("int"))), F.lit(1), F.col("n_layer").cast("int"))

    def per_layer(key: str, kind: str) -> Column:
        items = F.from_json(F.when(F.startswith(raw(key), F.lit("[")), raw(key)), f"array<{kind}>")
        return F.when(F.size(items) > 0, items)

    names = {
        "n_layer": "block_count", "n_embd": "embedding_length", "context_length": "context_length", "expert_count": "expert_count", "expert_used_count": "expert_used_count",
        "sliding_window": "attention.sliding_window", "shared_kv_layers": "attention.shared_kv_layers", "key_swa": "attention.key_length_swa", "value_swa": "attention.value_length_swa",
        "key_own": "attention.key_length", "value_own": "attention.value_length",
    }
    h = h.withColumns({k: number(v) for k, v in names.items()})
    heads = F.coalesce(F.array_max(per_layer("attention.head_count", "bigint")), number("attention.head_count"))
    own_kv = per_layer("attention.head_count_kv", "bigint")
    h = h.withColumn("n_head", heads)
    scalar_kv = F.when(raw("attention.head_count_kv").isNull(), F.col("n_head")).otherwise(number("attention.head_count_kv"))
    h = h.withColumn("kv", F.coalesce(filled(own_kv), F.array_repeat(scalar_kv, F.col("n_layer").cast("int"))))
    default = F.coalesce(F.expr("n_embd div nullif(n_head, 0)"), F.lit(0))
    h = h.withColumns({f"{k}_length": F.when(F.col(f"{k}_own") == 0, default).otherwise(F.col(f"{k}_own")) for k in ("key", "value")})
    h = h.withColumn("pattern", filled(per_layer("attention.sliding_window_pattern", "boolean")))
    alloc = F.when((F.col("shared_kv_layers") > 0) & (F.col("shared_kv_layers") < F.col("n_layer")), F.col("n_layer") - F.col("shared_kv_layers")).otherwise(F.col("n_layer"))
    h = h.withColumn("n_kv_alloc_layers", alloc)
    used = F.slice("kv", F.lit(1), F.col("n_kv_alloc_layers").cast("int"))
    windowed = F.coalesce(F.slice("pattern", F.lit(1), F.col("n_kv_alloc_layers").cast("int")), F.transform(used, lambda x: F.lit(False)))
    total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)
    local_heads = total(F.zip_with(used, windowed, lambda n, w: F.when(w, n).otherwise(F.lit(0).cast("long"))))
    mixed = F.col("pattern").isNotNull()
    swa = lambda k: F.when(F.col(f"{k}_swa") == 0, F.col(f"{k}_length")).otherwise(F.col(f"{k}_swa"))
    full = (F.col("key_length") + F.col("value_length")) * 2
    h = h.withColumns({"kv_heads_sum": total(used), "local_heads": local_heads})
    dense = F.col("kv_heads_sum") * full
    local = F.when(mixed, F.col("local_heads") * (swa("key") + swa("value")) * 2).when(F.col("sliding_window") > 0, dense).otherwise(F.lit(0))
    glob = F.when(mixed, (F.col("kv_heads_sum") - F.col("local_heads")) * full).when(F.col("sliding_window") > 0, F.lit(0)).otherwise(dense)
    n_swa = F.when(mixed, F.size(F.filter("pattern", lambda w: w))).otherwise(0).cast("long")
    h = h.withColumns({"kv_local_bytes_per_token": local, "kv_global_bytes_per_token": glob, "n_swa_layers": n_swa, "n_global_layers": F.when(mixed, F.col("n_layer") - n_swa).otherwise(F.lit(0))})
    t = tensor_sizes(headers.where("error IS NULL")).withColumn("group", tensor_group(F.col("name")))
    part = lambda value, group: F.coalesce(F.sum(F.when(F.col("group") == group, F.col(value))), F.lit(0))
    sums = t.groupBy("path").agg(
        F.sum("params").alias("params"), F.count("*").alias("tensor_count"), F.count_if(~F.col("group").isin("ple", "vision")).alias("gpu_tensor_count"),
        part("bytes", "ffn_expert").alias("expert_bytes"), part("bytes", "ple").alias("ple_bytes"), part("params", "ffn_expert").alias("expert_params"), part("params", "ple").alias("ple_params"),
    )
    f = h.join(sums, "path", "left").withColumn("gpu_weight_bytes", F.greatest(F.lit(0), F.col("length") - F.coalesce("ple_bytes", F.lit(0))))

    def active(whole: Column, experts: Column) -> Column:
        routed = (F.col("expert_count") > 0) & (F.col("expert_used_count") > 0) & (experts > 0)
        return F.when(routed, whole - experts + experts * F.col("expert_used_count") / F.col("expert_count")).otherwise(whole).cast("long")

    return f.select(
        "path", "arch", "n_layer", "n_head", "key_length", "value_length", "context_length", "sliding_window", "kv_heads_sum", "n_kv_alloc_layers", "n_swa_layers", "n_global_layers",
        "kv_local_bytes_per_token", "kv_global_bytes_per_token", "params", "tensor_count", "gpu_tensor_count", F.col("length").alias("weight_bytes"), "gpu_weight_bytes", "ple_bytes", "expert_bytes",
        active(F.col("gpu_weight_bytes"), F.col("expert_bytes")).alias("active_weight_bytes"), active(F.col("params") - F.col("ple_params"), F.col("expert_params")).alias("active_params"),
    )


def publish_json(rows: DataFrame, path: str, limit: int = 100_000, indent: int | None = None) -> None:
    """One small JSON document of a small table, sorted by its first column, compact or indented, and alike each time.

    It is written beside its place and moved over what is there, so readers
    see the old or the new one. Larger tables are refused: they are written as
    JSON lines, see write_jsonl.
    """
    found = rows.orderBy(rows.columns[0]).limit(limit + 1).toJSON().collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows; use write_jsonl")
    text = json.dumps([json.loads(x) for x in found], sort_keys=True, separators=(",", ":") if indent is None else None, indent=indent, ensure_ascii=False) + "\n"
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    over = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(over, 1)
    options[0] = over.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(part, target, options)


def write_jsonl(rows: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """JSON lines with nulls, in files whose names follow the order."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header; nulls are empty."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_once(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Appends rows whose key the table at path lacks; what is there stays as it is. Returns the rows that were missing."""
    spark = rows.sparkSession
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    rows = rows.dropDuplicates([key])
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(key), key, "left_anti")
    rows.write.mode("append").parquet(path)
    return rows


def split_fresh(cache: DataFrame, fetched_at: str, ttl_seconds: int | None, now) -> tuple[DataFrame, DataFrame]:
    """Rows that still hold and rows to fetch again; without a time to live all hold."""
    if ttl_seconds is None:
        return cache, cache.limit(0)
    fresh = F.col(fetched_at) + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now
    return cache.where(fresh), cache.where(~fresh | fresh.isNull())
