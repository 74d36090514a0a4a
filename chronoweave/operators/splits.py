"""Chronological splits, induced subsets, and row samples that repeat exactly for a seed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.hashing import hashed_long, hashed_unit
from chronoweave.functions.kernels import materialize, numbered, ordered

# Accepted spellings of the split labels.
SPLIT_ALIASES = {"train": "train", "training": "train", "valid": "validation", "val": "validation", "validation": "validation", "test": "test"}


def cut_by_position(df: DataFrame, order: Sequence, cuts: Mapping[str, float], out: str = "split") -> DataFrame:
    """Label rows by their place in the order: the first floor(n*p) rows get the first label, and so on."""
    ranked = numbered(df, order, "_rk")
    n = ranked.count()
    label, names = None, list(cuts)
    for name in names[:-1]:
        hit = F.col("_rk") <= int(n * cuts[name])
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return ranked.withColumn(out, label.otherwise(names[-1])).drop("_rk")


def chronological_split(df: DataFrame, ts: str, event_id: str) -> DataFrame:
    """70/15/15 on (time, id text)."""
    return cut_by_position(df, [ts, F.col(event_id).cast("string")], {"train": 0.70, "validation": 0.85, "test": 1.0})


def resolved_split(df: DataFrame, ts: str, event_id: str) -> DataFrame:
    """Explicit labels win (known aliases, unknown raises); without them 90/5/5 on time."""
    if "split" not in df.columns:
        return cut_by_position(df, [ts, event_id], {"train": 0.90, "validation": 0.95, "test": 1.0})
    label = F.create_map(*[F.lit(x) for kv in SPLIT_ALIASES.items() for x in kv])[F.lower(F.trim("split"))]
    bad = df.where(label.isNull()).select("split").distinct().limit(10).collect()
    if bad:
        raise ValueError(f"unknown split labels: {sorted(str(b[0]) for b in bad)}")
    return df.withColumn("split", label)


def train_test_split(df: DataFrame, ts: str, event_id: str) -> DataFrame:
    return cut_by_position(df, [ts, event_id], {"train": 0.80, "test": 1.0})


def split_bounds(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def split_integrity(df: DataFrame, ts: str, key: Sequence[str]) -> DataFrame:
    """(check, found): separation of the splits in time, shared boundaries, keys in two splits, empty or unknown labels."""
    bounds = {r["split"]: r for r in split_bounds(df, ts).where(F.col("split").isin(*set(SPLIT_ALIASES.values()))).collect()}
    unknown = df.where(~F.col("split").isin(*set(SPLIT_ALIASES.values())) | F.col("split").isNull()).select("split").distinct().count()
    names = ("train", "validation", "test")
    rows = [("empty_splits", sum(n not in bounds for n in names)), ("unknown_labels", unknown)]
    if all(n in bounds for n in names):
        pairs = [("train", "validation"), ("validation", "test")]
        rows.append(("not_separated", sum(bounds[a]["last"] > bounds[b]["first"] for a, b in pairs)))
        rows.append(("shared_boundaries", sum(bounds[a]["last"] == bounds[b]["first"] for a, b in pairs)))
    has = {n: F.max((F.col("split") == n).cast("int")).alias(n) for n in names}
    k = df.groupBy(*key).agg(*has.values())
    both = k.agg(*[F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}_vs_{b}") for a, b in
                   (("train", "validation"), ("train", "test"), ("validation", "test"))]).first().asDict()
    rows += list(both.items())
    return df.sparkSession.createDataFrame([(c, int(v)) for c, v in rows], "check string, found long")


# --- entity selection ---------------------------------------------------------------------------


def sampled_entities(entities: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n entities in hash order: a seeded sample without replacement."""
    return entities.select(key).distinct().orderBy(hashed_long(seed, key), key).limit(n)


def induced_subset(events: DataFrame, customers: DataFrame, products: DataFrame, n: int, seed: int = 42,
                   customer: str = "customer_id", product: str = "product_id", reviewed_only: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """n sampled customers, all their events, and the products those events touch."""
    pool = customers.join(events.select(customer), customer, "left_semi") if reviewed_only else customers
    chosen = sampled_entities(pool, customer, n, seed)
    kept = events.join(chosen, customer, "left_semi")
    return customers.join(chosen, customer, "left_semi"), kept, products.join(kept.select(product), product, "left_semi")


def select_sources(counts: DataFrame, key: str, target: int, seed: int = 42) -> DataFrame:
    """Sources whose event counts add up to about `target`; complete histories only.

    Hash order and a prefix sum replace the sequential walk: a source joins while the distance to the
    target does not grow, up to the first that reaches it. Then single adds or removes, each the one that
    brings the total closest, while the error shrinks; every round is one distributed minimum.
    """
    run = materialize(ordered(counts.select(key, "n"), [], [hashed_long(seed, key), key], before={"b": F.col("n")}))
    grows = F.abs(F.col("b") + F.col("n") - target) > F.abs(F.col("b") - F.lit(target))
    stop = run.agg(F.min(F.when(grows, F.col("b"))), F.min(F.when(F.col("b") >= target, F.col("b")))).first()
    limits = [x for x in stop if x is not None]
    chosen = (F.col("b") < min(limits)) if limits else F.lit(True)
    picked = run.withColumn("chosen", chosen)
    total = picked.agg(F.sum(F.when(F.col("chosen"), F.col("n")))).first()[0] or 0
    flipped: dict = {}
    while True:  # every flip lowers the error, a whole number
        adding = total < target
        sign = 1 if adding else -1
        pool = picked.where(~F.col("chosen") if adding else F.col("chosen"))
        if flipped:
            pool = pool.where(~F.col(key).isin(list(flipped)))
        best = pool.agg(F.min_by(F.struct(key, "n"), F.struct(F.abs(F.lit(total) + sign * F.col("n") - target), F.col(key)))).first()[0]
        if best is None or abs(total + sign * best["n"] - target) >= abs(total - target):
            break
        flipped[best[key]] = adding
        total += sign * best["n"]
    added, removed = [k for k, a in flipped.items() if a], [k for k, a in flipped.items() if not a]
    final = F.col("chosen")
    final = (final | F.col(key).isin(added)) if added else final
    final = (final & ~F.col(key).isin(removed)) if removed else final
    return picked.where(final).select(key, "n")


# --- row samples --------------------------------------------------------------------------------


def stratified_draws(df: DataFrame, key: str, bin_col: str, draws: int, mode: str = "temporal_stratified", seed: int = 42) -> DataFrame:
    """Rows drawn with replacement over time bins; a draw is (bin, position), joined to numbered rows.

    uniform and weighted draw rows in proportion, stratified draws every non-empty bin alike, hybrid mixes both half and half.
    """
    inside = ordered(df.select(key, bin_col), [bin_col], [key], rank="place")
    whole = inside.groupBy(bin_col).agg(F.count(F.lit(1)).alias("n"))
    bins = ordered(whole, [], [bin_col], rank="bin_no", before={"start": F.col("n")})
    total, n_bins = bins.agg(F.sum("n"), F.count(F.lit(1))).first()
    d = df.sparkSession.range(draws).withColumnRenamed("id", "draw")
    stratified = {"temporal_stratified": F.lit(True), "hybrid": hashed_unit(f"{seed}m", "draw") >= 0.5}.get(mode, F.lit(False))
    u, v = hashed_unit(f"{seed}b", "draw"), hashed_unit(f"{seed}r", "draw")
    by_bin = d.where(stratified).select("draw", (F.floor(u * n_bins) + 1).alias("bin_no"), v.alias("v"))
    first = by_bin.join(bins, "bin_no").select("draw", (F.col("start") + F.floor(F.col("v") * F.col("n")) + 1).alias("position"))
    second = d.where(~stratified).select("draw", (F.floor(u * total) + 1).alias("position"))
    positions = inside.join(bins.select(bin_col, "start"), bin_col).select(key, bin_col, (F.col("start") + F.col("place")).alias("position"))
    return first.unionByName(second).join(positions, "position").select("draw", key, bin_col)


def balanced_draw(both: DataFrame, key: str, cap: int | None, seed: int = 42) -> DataFrame:
    """Equal numbers of real and synthetic rows, each side in its own hash order."""
    sizes = both.agg(F.count_if("is_real"), F.count_if(~F.col("is_real"))).first()
    n = min([x for x in (sizes[0], sizes[1], cap) if x is not None])
    sides = [both.where(F.col("is_real") == F.lit(s)).orderBy(hashed_long(f"{seed}{int(s)}", key), key).limit(n) for s in (True, False)]
    return sides[0].unionByName(sides[1])


def evaluation_rows(test: DataFrame, ts: str, key: str, requested: int | None = None) -> DataFrame:
    """All test rows, or the first `requested` by (time, id); asking for more than there are raises."""
    if requested is None:
        return test
    have = test.count()
    if requested > have:
        raise ValueError(f"asked for {requested} rows, the test split has {have}")
    return test.orderBy(ts, key).limit(requested)


def split_spines(df: DataFrame, id_columns: Sequence[str]) -> dict[str, DataFrame]:
    """Per split the real rows and the bare spine; train and validation together are the history prefix."""
    out: dict[str, DataFrame] = {}
    for name in ("train", "validation", "test"):
        part = df.where(F.col("split") == name)
        out[f"{name}_real"], out[f"{name}_spine"] = part, part.select(*id_columns)
    out["history_prefix"] = out["train_real"].unionByName(out["validation_real"])
    return out


# --- buckets ------------------------------------------------------------------------------------


def frequency_buckets(counts: DataFrame, key: str, q: int, label: str = "frequency_q", n: str = "n") -> DataFrame:
    """q equal-count buckets of entities by frequency (ties by id)."""
    ranked = numbered(counts.select(key, n), [n, key], "_rk")
    total = ranked.count()
    q = min(max(q, 1), max(total, 1))
    place = F.greatest(F.lit(0), F.ceil((F.col("_rk") - 1) * q / F.lit(max(total - 1, 1))) - 1)
    return ranked.select(key, n, F.concat(F.lit(label), (place + 1).cast("string")).alias("bucket"))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Average rank of ties per value: (by, value, ties, rank)."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    run = ordered(c, by, [value], before={"_b": F.col("ties")})
    return run.select(*by, value, "ties", (F.col("_b") + (F.col("ties") + 1) / 2).alias(name))


def quartile_groups(df: DataFrame, value: str) -> DataFrame:
    """Rows with `quartile` 1..4 by percent rank (average ranks), cut at .25, .5, .75."""
    ranks = average_rank(df, value)
    n = ranks.agg(F.sum("ties")).first()[0] or 1
    pct = F.col("rank") / F.lit(n)
    cut = F.when(pct <= 0.25, 1).when(pct <= 0.5, 2).when(pct <= 0.75, 3).otherwise(4)
    return df.join(ranks.select(value, cut.alias("quartile")), value, "left")


def chronological_group(ts: str, mode: str, first_micros: int | None = None, window_days: int = 1) -> Column:
    """Key of the day, the exact time, or a window of d days from the first event."""
    if mode == "date":
        return F.date_format(ts, "yyyy-MM-dd")
    if mode == "exact":
        return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.floor((F.unix_micros(ts) - first_micros) / (86_400_000_000 * window_days)).cast("string")
