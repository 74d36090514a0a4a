"""Event streams: running counts, leakage-free running statistics, tumbling groups and block cells."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.kernels import join_groups, ordered, workspace


def _place(spark: SparkSession, kind: str) -> str:
    return f"{workspace(spark)}/{kind}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Drive a stream over what is there now, batch by batch, and stop."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", _place(stream.sparkSession, "stream")).trigger(availableNow=True).foreachBatch(handle).start()
    q.awaitTermination()


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """Counts per id kept up to date; run in update mode."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def tumbling_groups(stream: DataFrame, ts: str, days: int, delay: str = "1 day") -> DataFrame:
    """Counts per window of `days` days."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, f"{days} days")).agg(F.count(F.lit(1)).alias("n"))


def block_day_counts(stream: DataFrame, ts: str, customer_blocks: DataFrame, product_blocks: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events per (customer block, product block, day): a stream joined to two static maps, then a windowed count."""
    joined = stream.withWatermark(ts, delay).join(customer_blocks, "customer_id").join(product_blocks, "product_id")
    return joined.groupBy(F.window(ts, "1 day"), "customer_block", "product_block").agg(F.count(F.lit(1)).alias("n"))


def collect_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Final value per key of an update-mode stream: every batch is appended with its number, the last one wins."""
    spark = stream.sparkSession
    path = _place(spark, "updates")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    run_available(stream, save, "update")
    values = [c for c in stream.columns if c not in keys]
    rows = spark.read.parquet(f"{path}/*")
    return rows.groupBy(*keys).agg(*[F.max_by(c, "_epoch").alias(c) for c in values])


class RunningStatistics:
    """Past-only count, sum, sum of squares and flag sum per entity, over micro-batches.

    Each batch is joined to the state of the batches before it and ordered inside by (entity, time), so an
    event sees strictly earlier times only: state plus earlier rows of its own batch. A busy entity is
    spread over tasks by the ordering kernel instead of being fed through one stateful key. Rows older
    than the largest time seen minus the delay are dropped and counted.

    Output, state and the largest time are tables named by the batch number, under `path`. A batch reads
    what the batch before it left and overwrites its own, so running it again (also after a restart with
    the same path) gives the same result. A null entity is an entity like any other.
    """

    def __init__(self, spark: SparkSession, entity: str, key: str, ts: str, sums: Mapping[str, Column], delay_micros: int = 86_400_000_000, path: str | None = None):
        self.spark, self.entity, self.key, self.ts = spark, entity, key, ts
        self.sums, self.delay = dict(sums), delay_micros
        self.path = path or _place(spark, "running")

    def _marks(self) -> dict[int, tuple[int | None, int]]:
        """Largest time and dropped rows by batch, one small row each."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/mark")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return {}
        return {r["epoch"]: (r["high"], r["dropped"]) for r in self.spark.read.schema("high long, dropped long, epoch int").parquet(f"{self.path}/mark").collect()}

    @property
    def dropped(self) -> int:
        return sum(n for _, n in self._marks().values())

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        names = ["count", *self.sums]
        earlier = {e: m for e, m in self._marks().items() if e < epoch}
        last = max(earlier, default=None)
        high = None if last is None else earlier[last][0]
        rows, late_rows = batch.withColumn("_t", F.unix_micros(self.ts)), 0
        if high is not None:
            late = F.coalesce(F.col("_t") < high - self.delay, F.lit(False))
            late_rows = rows.where(late).count()
            rows = rows.where(~late)
        at = rows.groupBy(self.entity, "_t").agg(F.count(F.lit(1)).alias("_count"), *[F.sum(e).alias(f"_{k}") for k, e in self.sums.items()])
        run = ordered(at, [self.entity], ["_t"], before={f"in_{n}": F.col(f"_{n}") for n in names})
        state = None if last is None else self.spark.read.parquet(f"{self.path}/state/{last}")
        seen = run if state is None else join_groups(run, state, [self.entity], "left")
        prior = {n: F.col(f"in_{n}") + (F.lit(0) if state is None else F.coalesce(f"state_{n}", F.lit(0))) for n in names}
        before = seen.select(self.entity, "_t", *[c.alias(f"prior_{n}") for n, c in prior.items()])
        out = join_groups(rows.select(self.key, self.entity, "_t"), before, [self.entity, "_t"])
        out.drop("_t").write.mode("overwrite").parquet(f"{self.path}/out/{epoch}")
        total = at.groupBy(self.entity).agg(*[F.sum(f"_{n}").alias(f"state_{n}") for n in names])
        if state is not None:
            total = total.unionByName(state).groupBy(self.entity).agg(*[F.sum(f"state_{n}").alias(f"state_{n}") for n in names])
        total.write.mode("overwrite").parquet(f"{self.path}/state/{epoch}")
        top = rows.agg(F.max("_t")).first()[0]
        high = max((x for x in (high, top) if x is not None), default=None)
        mark = self.spark.createDataFrame([(high, late_rows)], "high long, dropped long")
        mark.write.mode("overwrite").parquet(f"{self.path}/mark/epoch={epoch}")

    def results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/out/*")
