"""Roles that the driver's tables play, as DataFrames and as the same relations in SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.numeric import round_half_up

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with the SQL that gives the same rows."""

    def __init__(self) -> None:
        self.found: dict[str, tuple[Query, str | None]] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            if f.__name__ in self.found:
                raise ValueError(f"{f.__name__} is registered twice")
            self.found[f.__name__] = (f, sql)
            return f

        return keep

    def queries(self) -> dict[str, Query]:
        return {k: f for k, (f, _) in self.found.items()}

    def oracle_sql(self) -> dict[str, str]:
        return {k: s for k, (_, s) in self.found.items() if s}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(x: Column | str) -> Column:
    """Four digits, by operations that are alike in all engines."""
    return round_half_up(F.col(x) if isinstance(x, str) else x, 4)


def s4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """part as a catalog: digests collide on purpose."""
    key, price = F.col("p_partkey"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        key.cast("string").alias("ref"),
        F.col("p_brand").alias("family"),
        F.concat("p_name", F.lit("-"), "p_type").alias("tag"),
        F.col("p_type").alias("quant"),
        F.floor(price * 1000000 + 0.5).alias("params"),
        F.col("p_size").cast("long").alias("layers"),
        (F.floor(price * 2000 + 0.5) * 1000).alias("weight_bytes"),
        (2048 * (1 + key % 7)).alias("ctx_max"),
        (F.lit(64) * (1 + key % 5)).alias("kv_per_token"),
        F.sha2(F.concat("p_brand", F.lit("|"), "p_name"), 256).alias("digest"),
        F.when(key % 97 != 0, F.date_add(F.lit("2023-01-01").cast("date"), (key % 900).cast("int"))).alias("pushed_at"),
        F.concat("p_name", F.lit(" "), "p_type").alias("label"),
    )


CATALOG = """catalog AS (
  SELECT CAST(p_partkey AS varchar) AS ref, p_brand AS family, p_name || '-' || p_type AS tag, p_type AS quant,
    CAST(floor(p_retailprice * 1000000 + 0.5) AS bigint) AS params, CAST(p_size AS bigint) AS layers,
    CAST(floor(p_retailprice * 2000 + 0.5) AS bigint) * 1000 AS weight_bytes, 2048 * (1 + p_partkey % 7) AS ctx_max,
    64 * (1 + p_partkey % 5) AS kv_per_token, sha256(p_brand || '|' || p_name) AS digest,
    CASE WHEN p_partkey % 97 <> 0 THEN DATE '2023-01-01' + CAST(p_partkey % 900 AS integer) END AS pushed_at, p_name || ' ' || p_type AS label
  FROM part)"""


def gpus(spark: SparkSession, d: str) -> DataFrame:
    """nation as the devices."""
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.cast("long").alias("gpu_id"), ((1 + k % 8) * 1.0e6).alias("memory"), F.lit(0.9).alias("usable"), (100.0 + 20 * k).alias("bandwidth"),
        F.lit(0.00001).alias("per_layer"), F.lit(0.0001).alias("fixed"), F.when(k % 5 > 0, 10.0 + k).alias("fp16_tflops"), F.lit(0.3).alias("derate"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"),
    )


GPUS = """gpus AS (
  SELECT CAST(n_nationkey AS bigint) AS gpu_id, (1 + n_nationkey % 8) * CAST(1000000 AS double) AS memory, CAST(0.9 AS double) AS usable,
    CAST(100 AS double) + 20 * n_nationkey AS bandwidth, CAST(0.00001 AS double) AS per_layer, CAST(0.0001 AS double) AS fixed,
    CASE WHEN n_nationkey % 5 > 0 THEN CAST(10 AS double) + n_nationkey END AS fp16_tflops, CAST(0.3 AS double) AS derate, n_name AS name, n_regionkey AS region FROM nation)"""


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a measurement log with repeated keys and a flag of three states."""
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("model"), F.col("l_linenumber").cast("long").alias("ctx"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("tps"),
        F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("flagged"), F.col("l_linestatus").alias("label"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_shipdate").alias("seen"), F.col("l_orderkey").alias("run"), F.col("l_suppkey").alias("host"),
    )


MEASUREMENTS = """measurements AS (
  SELECT l_partkey AS model, CAST(l_linenumber AS bigint) AS ctx, l_extendedprice / l_quantity AS tps,
    CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS flagged, l_linestatus AS label,
    l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_shipdate AS seen, l_orderkey AS run, l_suppkey AS host
  FROM lineitem)"""
