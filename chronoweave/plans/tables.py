"""The given tables in the roles the jobs use, and the same roles as SQL text for the twins."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.hashing import hashed_long
from chronoweave.session import configure

SIDE_SEED = 42
BLOCKS = 5


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """Zone-less times are read as UTC instants once, here."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def spine(self) -> DataFrame:
        """Order lines as events: customer, product, day, and attributes."""
        o = self.table("orders")
        joined = self.table("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("o_orderdate").alias("ts"),
            F.col("o_orderdate").cast("date").alias("day"),
            F.col("l_linenumber").alias("rating"),
            (F.col("l_linestatus") == "F").cast("int").alias("verified"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
            F.col("l_orderkey").alias("order_id"),
            (hashed_long(SIDE_SEED, "l_orderkey") % 2 == 0).alias("is_real"),
        )

    @property
    def real(self) -> DataFrame:
        return self.spine.where("is_real").drop("is_real")

    @property
    def synthetic(self) -> DataFrame:
        return self.spine.where("not is_real").drop("is_real")

    @property
    def customer_blocks(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"), (F.col("c_nationkey") % BLOCKS).alias("customer_block")
        )

    @property
    def product_blocks(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"), (F.col("p_size") % BLOCKS).alias("product_block")
        )

    @property
    def actions(self) -> DataFrame:
        """The second spine: user events with a clock time and a value."""
        return self.table("events").select(
            "event_id", F.col("user_id"), F.col("ts"), "event_type", "value", "props",
            (hashed_long(SIDE_SEED, "event_id") % 2 == 0).alias("is_real"),
        )

    @property
    def texts(self) -> DataFrame:
        return self.table("documents").select(
            "doc_id", "text", "lang", "source", (hashed_long(SIDE_SEED, "doc_id") % 2 == 0).alias("is_real")
        )


def hash_sql(seed, *keys: str) -> str:
    parts = " || ".join(f"'|' || coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"CAST('0x' || substr(md5('{seed}' || {parts}), 1, 13) AS BIGINT)"


def unit_sql(seed, *keys: str) -> str:
    return f"(({hash_sql(seed, *keys)} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def r(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + 1e-{digits + 4}, {digits}) + 0.0)"


SPINE = f"""spine AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS event_id,
         o_custkey AS customer_id, l_partkey AS product_id, o_orderdate AS ts,
         CAST(o_orderdate AS DATE) AS day, l_linenumber AS rating,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS verified,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
         l_returnflag AS flag, l_linestatus AS status, o_orderpriority AS priority, l_orderkey AS order_id,
         {hash_sql(SIDE_SEED, 'l_orderkey')} % 2 = 0 AS is_real
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
real AS (SELECT * FROM spine WHERE is_real),
synthetic AS (SELECT * FROM spine WHERE NOT is_real)"""

BLOCK_MAPS = f"""cb AS (SELECT c_custkey AS customer_id, c_nationkey % {BLOCKS} AS customer_block FROM customer),
pb AS (SELECT p_partkey AS product_id, p_size % {BLOCKS} AS product_block FROM part)"""

ACTIONS = f"""actions AS (SELECT event_id, user_id, ts, event_type, value, props,
  {hash_sql(SIDE_SEED, 'event_id')} % 2 = 0 AS is_real FROM events)"""

TEXTS = f"""texts AS (SELECT doc_id, text, lang, source,
  {hash_sql(SIDE_SEED, 'doc_id')} % 2 = 0 AS is_real FROM documents)"""

CORR = """CASE WHEN count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) >= 2
  AND stddev_pop({x}) FILTER (WHERE {y} IS NOT NULL) > 1e-12
  AND stddev_pop({y}) FILTER (WHERE {x} IS NOT NULL) > 1e-12 THEN corr({y}, {x}) END"""


def corr_sql(x: str, y: str) -> str:
    """Correlation that is null when undefined."""
    return CORR.format(x=f"CAST({x} AS DOUBLE)", y=f"CAST({y} AS DOUBLE)")
