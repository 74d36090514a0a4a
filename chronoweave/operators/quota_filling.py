"""Demand of cells spread over entities in proportion to weights, never beyond a quota, the rest handed up level by level.

Sequential sampling that stops an entity when its quota is used up tends to min(quota, level * weight), with one level for a
group that makes the sum equal the demand. That level has a closed form: entities in order of quota / weight are used up one
after the other, and prefix sums of quotas and weights say where that ends. The rest is shared out by weight, fractions by
largest remainder. All arithmetic is in whole numbers. Groups of any size are split over tasks (`kernels.ordered`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.hashing import hashed_long
from chronoweave.functions.kernels import join_groups, materialize, ordered
from chronoweave.operators.spine_generation import expand

WHOLE = "decimal(38,0)"


def _beside(df: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """`df` with the columns of its group's row; without keys there is one row, whose values become constants."""
    if by:
        return join_groups(df, groups, list(by), how)
    row = groups.first()
    if row is None:
        return df.where(F.lit(how != "inner")).withColumns({f.name: F.lit(None).cast(f.dataType) for f in groups.schema})
    return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in groups.schema})


def capped_shares(rows: DataFrame, by: Sequence[str], entity: str, quota: str = "quota", weight: str = "weight", demand: str = "demand") -> DataFrame:
    """`rows` with `take`: long, the entity's share of its group's demand.

    One row per group and entity; quota and weight are whole numbers, weight at least 1, demand is the same in all rows of a
    group. Where the quotas do not reach the demand, every entity takes its quota. Rows without quota take 0.
    """
    by = list(by)
    some = rows.where(F.col(quota) > 0)
    run = materialize(ordered(some, by, [F.col(quota) / F.col(weight), entity], through={"_q": F.col(quota), "_w": F.col(weight)}))
    total = run.groupBy(*by).agg(F.sum(weight).alias("_wt"))
    run = _beside(run, total, by)
    used_up = F.col(quota).cast(WHOLE) * (F.col("_wt") - F.col("_w")).cast(WHOLE) <= (F.col(demand) - F.col("_q")).cast(WHOLE) * F.col(weight).cast(WHOLE)
    run = materialize(run.withColumn("_full", used_up))
    full = run.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_full"), F.col(quota))), F.lit(0)).alias("_qs"), F.coalesce(F.sum(F.when(F.col("_full"), F.col(weight))), F.lit(0)).alias("_ws"))
    run = _beside(run, full, by)
    rest, others = (F.col(demand) - F.col("_qs")).cast(WHOLE), F.greatest(F.col("_wt") - F.col("_ws"), F.lit(1)).cast(WHOLE)
    product = rest * F.col(weight).cast(WHOLE)
    run = run.withColumns({"_p": F.when(~F.col("_full"), product).otherwise(F.lit(0)), "_o": others})
    run = run.withColumns({"_base": F.expr("cast(_p div _o as bigint)"), "_rem": F.expr("cast(_p % _o as decimal(38,0))")})
    ranked = ordered(run, by, ["_full", F.desc("_rem"), entity], rank="_place")
    given = run.groupBy(*by).agg(F.sum("_base").alias("_given"))
    ranked = _beside(ranked, given, by)
    more = (F.col("_place") <= F.col(demand) - F.col("_qs") - F.col("_given")).cast("long")
    ranked = ranked.withColumn("take", F.when(F.col("_full"), F.col(quota)).otherwise(F.col("_base") + more).cast("long"))
    return ranked.select(*rows.columns, "take").unionByName(rows.where(~F.coalesce(F.col(quota) > 0, F.lit(False))).withColumn("take", F.lit(0).cast("long")))


def fill_by_levels(demand: DataFrame, caps: DataFrame, degrees: DataFrame, levels: Sequence[Sequence[str]], entity: str) -> DataFrame:
    """(level, keys of the first level, entity, take): how many events each entity gets, where, and at which level.

    demand (keys of levels[0], demand); caps (keys of levels[0], entity, quota, weight), an entity's quotas together at most
    its degree; degrees (entity, keys of levels[1], degree). `levels` go from fine to coarse, each a part of the one before.
    What a cell's quotas do not reach goes to the next level, where entities offer what is left of their degree, weighted by
    it. At the end all demand is met or all degrees are used up. Keys that a level does not know are null in its rows.
    """
    first, out = list(levels[0]), None
    left = degrees
    open_demand = demand.select(*first, F.col("demand").cast("long").alias("demand"))
    for number, keys in enumerate(levels):
        keys = list(keys)
        asked = open_demand.groupBy(*keys).agg(F.sum("demand").alias("demand")).where("demand > 0")
        offers = caps.select(*keys, entity, "quota", "weight") if number == 0 else left.where("degree > 0").select(*keys, entity, F.col("degree").alias("quota"), F.col("degree").alias("weight"))
        rows = _beside(offers, asked, keys)
        taken = materialize(capped_shares(rows, keys, entity).where("take > 0").select(*keys, entity, "take"))
        got = taken.groupBy(*keys).agg(F.sum("take").alias("_got"))
        rest = _beside(asked, got, keys, "left")
        open_demand = materialize(rest.select(*keys, (F.col("demand") - F.coalesce("_got", F.lit(0))).alias("demand")))
        mine = taken.groupBy(entity).agg(F.sum("take").alias("_mine"))
        left = materialize(left.join(mine, entity, "left").withColumn("degree", F.col("degree") - F.coalesce("_mine", F.lit(0))).drop("_mine"))
        part = taken.select(F.lit(number + 1).alias("level"), *[F.col(c) if c in keys else F.lit(None).cast(demand.schema[c].dataType).alias(c) for c in first], entity, "take")
        out = part if out is None else out.unionByName(part)
    return materialize(out)


def assign_filled(slots: DataFrame, takes: DataFrame, levels: Sequence[Sequence[str]], entity: str, order: Sequence[str] = ("day",), seed: int = 42) -> DataFrame:
    """(slot, entity, level): the takes of `fill_by_levels` put on slots, level by level, by rank inside each group."""
    out, left = None, slots
    for number, keys in enumerate(levels):
        keys = list(keys)
        units = expand(takes.where(F.col("level") == number + 1).select(*keys, entity, "take"), "take", "_t")
        a = ordered(left, keys, [hashed_long(f"{seed}a{number}", "slot"), "slot"], rank="_r") if number == 0 else ordered(left, keys, [*order, "slot"], rank="_r")
        b = ordered(units.select(*keys, entity, "_t"), keys, [hashed_long(f"{seed}b{number}", entity, "_t"), entity, "_t"], rank="_r")
        got = join_groups(a, b.select(*keys, entity, "_r"), [*keys, "_r"]).select("slot", entity, F.lit(number + 1).alias("level"))
        got = materialize(got)
        out = got if out is None else out.unionByName(got)
        left = materialize(left.join(got.select("slot"), "slot", "left_anti"))
    return out
