"""What the operators on text corpora share: query registration, table access, text columns, connected classes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.kernels import materialize


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(run):
        QUERIES[run.__name__] = Query(run.__name__, run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Arrow batches of whole texts are bounded by rows and, where this Spark can, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def whole_text(column: str | Column = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Lower-case words: runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bucket_of_id(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal digits, modulo `modulus`: the stated split into folds (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def fixed_sample(df: DataFrame, rows: int, by: str, salt: str = "") -> DataFrame:
    """At most `rows` rows, the same ones however the table is partitioned: those with the smallest hash of `by`."""
    return df.orderBy(F.xxhash64(F.lit(salt), F.col(by)), F.col(by)).limit(rows)


def connected(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over the edges, for every node.

    Every node takes the smallest root among its neighbours and itself, then jumps to its root's root, until a
    round changes nothing. Each round is written under the checkpoint folder, so a lost executor costs one round.
    Edges are symmetric and deduplicated; a hub's neighbours are combined map-side by min().
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v and u is not null and v is not null")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    touched = both.select("u").distinct()
    roots = materialize(touched.select("u", F.col("u").alias("root")))
    while True:
        seen = both.join(roots.select(F.col("u").alias("v"), F.col("root").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        low = roots.join(seen, "u", "left").select("u", F.col("root").alias("was"), F.least("root", F.coalesce("other", "root")).alias("mid"))
        # a node's root also pulls the root itself down
        pulled = low.groupBy(F.col("was").alias("u")).agg(F.min("mid").alias("pull"))
        low = low.join(pulled, "u", "left").select("u", "was", F.least("mid", F.coalesce("pull", "mid")).alias("mid"))
        low = materialize(low)
        jump = low.select(F.col("u").alias("mid"), F.col("mid").alias("up"))
        after = materialize(low.join(jump, "mid", "left").select("u", "was", F.coalesce("up", "mid").alias("root")))
        changed = after.where("root <> was").limit(1).count()
        roots = after.select("u", "root")
        if not changed:
            break
    return nodes.select(F.col(node)).join(roots.withColumnRenamed("u", node), node, "left").select(node, F.coalesce("root", F.col(node)).alias("root"))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The table without columns that would clash (case-insensitively) with those an operator adds."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def fresh_name(df: DataFrame, like: str) -> str:
    """A column name that the table does not have, for columns that an operator drops again."""
    taken, name = {c.lower() for c in df.columns}, f"_{like}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
