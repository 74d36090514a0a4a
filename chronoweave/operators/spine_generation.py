"""Synthetic event spines with exact degrees, block-pair counts and daily volumes.

Sequential generators become three distributed moves: expand counts into rows, rank both sides in a
group and join by rank, and repair the few rows that break a rule. Every random choice is a hashed
uniform of a seed and a row key, so a rerun (or a lost executor) gives the same table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.cleaning import dot, norm, reflect_unit
from chronoweave.functions.hashing import as_col, hashed_long, hashed_normal, hashed_unit
from chronoweave.functions.kernels import aligned_counts, discard, finished, in_pieces, join_groups, materialize, numbered, ordered, ranked_in_steps
from chronoweave.operators import counts as ct

CHUNK = 10_000
SLICES = 1_000_000
PAIRING_RUN = 500
PIECE_ROWS = 2_000_000
BLOCK_PAIRS = 1_000_000
BATCH_ROWS = 5_000
EPOCH = "1970-01-01"


# --- shared moves -------------------------------------------------------------------------------


def expand(df: DataFrame, n: str, place: str, chunk: int = CHUNK) -> DataFrame:
    """One row per unit of the count `n`, numbered from 1 in `place`. Large counts are cut into chunks and spread first."""
    chunks = df.where(F.col(n) > 0).withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / chunk))))
    # a given number of partitions, as adaptive execution would put the few rows that stand for many into one task
    spread = chunks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns, "_c")
    last = F.least(F.col(n), (F.col("_c") + 1) * chunk)
    return spread.withColumn(place, F.explode(F.sequence(F.col("_c") * chunk + 1, last))).drop("_c")


def pick_by_weight(draws: DataFrame, u: str, table: DataFrame, weight: str, order: Sequence[str], by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Inverse-CDF pick: each draw gets the table row of its group whose cumulative weight range holds u.

    The unit interval of a group is cut into as many equal slices as the group has rows (a million at most). A table row lies
    in every slice that its range touches, two a row on average, and a draw meets those of its slice: draws are shuffled once.
    """
    by = list(by)
    t = ordered(table.where(F.col(weight) > 0), by, list(order), rank="_k", before={"_start": F.col(weight)})
    total = t.groupBy(*by).agg(F.sum(weight).alias("_total"), F.least(F.count(F.lit(1)), F.lit(SLICES)).alias("_slices"))
    if by:
        total = materialize(total)
        t, asked = join_groups(t, total, by), join_groups(draws, total.drop("_total"), by)
    else:
        sums = total.first()
        t, asked = t.withColumns({"_total": F.lit(sums["_total"]), "_slices": F.lit(sums["_slices"])}), draws.withColumn("_slices", F.lit(sums["_slices"]))
    kept = [c for c in keep if c not in by]
    t = ordered(t.select(*by, "_k", "_slices", (F.col("_start") / F.col("_total")).alias("_from"), *kept), by, ["_k"], following={"_to": F.col("_from")})
    at = lambda x: F.least(F.floor(x * F.col("_slices")), F.col("_slices") - 1)
    # the last range of a group has no end; rounding may leave a range empty
    t = t.where(F.col("_to").isNull() | (F.col("_from") < F.col("_to"))).select(
        *by, "_from", "_to", *kept, F.explode(F.sequence(at(F.col("_from")), at(F.coalesce("_to", F.lit(1.0))))).alias("_slice"))
    # written, as the size of exploded rows is guessed by that of the rows before
    met = join_groups(asked.withColumn("_slice", at(F.col(u))).drop("_slices"), materialize(t), [*by, "_slice"])
    inside = (F.col("_from") <= F.col(u)) & (F.col("_to").isNull() | (F.col(u) < F.col("_to")))
    return met.where(inside).select(*by, *[c for c in draws.columns if c not in (*by, u)], *kept)


def match_by_rank(left: DataFrame, right: DataFrame, by: Sequence[str], left_order: Sequence, right_order: Sequence) -> DataFrame:
    """Pair the i-th left row with the i-th right row inside each group (null keys form a group)."""
    a = ordered(left, list(by), list(left_order), rank="_r")
    b = ordered(right, list(by), list(right_order), rank="_r")
    return join_groups(a, b, [*by, "_r"]).drop("_r")


def scale_counts(df: DataFrame, key: Sequence[str], n: str, total: int, out: str = "scaled") -> DataFrame:
    """Counts scaled to `total` by largest remainder (then larger count, then key)."""
    have = df.agg(F.sum(n)).first()[0] or 1
    # whole-number arithmetic keeps the remainders exact
    product = F.col(n).cast("decimal(38,0)") * F.lit(total)
    base = F.floor(product / F.lit(have)).cast("long")
    rest = (product - base * F.lit(have).cast("decimal(20,0)")).cast("decimal(38,0)")
    ranked = numbered(df.withColumns({"_b": base, "_rest": rest}), [F.desc("_rest"), F.desc(n), *key], "_i")
    missing = total - (ranked.agg(F.sum("_b")).first()[0] or 0)
    return ranked.withColumn(out, F.col("_b") + (F.col("_i") <= missing).cast("long")).drop("_b", "_rest", "_i")


# --- times --------------------------------------------------------------------------------------


def kde_times(draws: DataFrame, key: str, by: Sequence[str], events: DataFrame, x: str, bandwidths: DataFrame, seed: int = 42) -> DataFrame:
    """Draws with `time` on [0,1]: an event of the group by position, Gaussian noise of its bandwidth, reflection at the ends."""
    by = list(by)
    place = ordered(events.select(*by, x), by, [x], rank="_i")
    d = draws.join(bandwidths.select(*by, "n", "bandwidth"), by).withColumn("_i", F.floor(hashed_unit(f"{seed}p", key) * F.col("n")) + 1)
    return d.join(place, [*by, "_i"]).withColumn("time", reflect_unit(F.col(x) + F.col("bandwidth") * hashed_normal(f"{seed}n", key))).drop("_i", "n", "bandwidth", x)


def endpoints_near(draws: DataFrame, key: str, by: Sequence[str], time: str, events: DataFrame, x: str, entity: str, bandwidths: DataFrame, seed: int = 42,
                   tries: int = 12) -> DataFrame:
    """(key, entity): an event of the group with Gaussian weight around the drawn time, within three bandwidths.

    Rejection sampling by position replaces weighting every nearby event: a draw learns which run of the
    ordered events is in reach, proposes positions in it, and keeps the first accepted one. Draws that
    accepted nothing propose again, four times as often each round, until all have one; an event in reach is
    accepted with at least exp(-4.5), so a few rounds do. Draws with nothing in reach take the event closest in order.
    """
    return finished(lambda: _endpoints_near(draws, key, list(by), time, events, x, entity, bandwidths, seed, tries))


def _endpoints_near(draws, key, by, time, events, x, entity, bandwidths, seed, tries) -> DataFrame:
    ev = finished(lambda: ordered(events.select(*by, x, entity), by, [x, entity], rank="_i"))
    d = draws.select(key, *by, time).join(bandwidths.select(*by, "bandwidth", "n"), by)
    reach = F.col("bandwidth") * 3
    ends = d.select(*by, key, F.inline(F.array(
        F.struct((F.col(time) - reach).alias("_x"), F.lit("lo").alias("_e")), F.struct((F.col(time) + reach).alias("_x"), F.lit("hi").alias("_e")),
        F.struct(F.col(time).alias("_x"), F.lit("at").alias("_e")))))
    marks = ev.select(*by, F.lit(None).cast(dict(draws.dtypes)[key]).alias(key), F.col(x).alias("_x"), F.lit("").alias("_e"))
    # at equal times the lower end sorts before the events, the others after
    order = F.when(F.col("_e") == "lo", 0).when(F.col("_e") == "", 1).otherwise(2)
    run = ordered(marks.unionByName(ends).withColumn("_o", order), by, ["_x", "_o", key], through={"_c": (F.col("_e") == "").cast("int")})
    bounds = run.where(F.col("_e") != "").groupBy(*by, key).agg(
        *[F.max(F.when(F.col("_e") == e, F.col("_c"))).alias(f"_{e}") for e in ("lo", "hi", "at")])
    left = materialize(d.join(bounds, [*by, key]))
    width = F.col("_hi") - F.col("_lo")
    unreached = left.where(width <= 0)
    found, r, left = None, 0, left.where(width > 0).drop("_at", "n")
    while found is None or not left.isEmpty():
        # two draws of five accept their first proposal: the others follow for those that did not
        for first, end in ((0, 1), (1, 4), (4, tries)) if r == 0 and tries > 4 else ((0, tries * 4**r),):
            tried = left.withColumn("_t", F.explode(F.sequence(F.lit(first), F.lit(end - 1))))
            tried = tried.withColumn("_i", F.col("_lo") + 1 + F.floor(hashed_unit(f"{seed}e{r}", key, "_t") * width)).drop("_lo", "_hi").join(ev, [*by, "_i"])
            z = (F.col(x) - F.col(time)) / F.col("bandwidth")
            ok = tried.where(hashed_unit(f"{seed}a{r}", key, "_t") < F.exp(-z * z / 2)).groupBy(key).agg(F.min_by(entity, "_t").alias(entity))
            ok = materialize(ok)
            found = ok if found is None else found.unionByName(ok)
            before, left = left, materialize(left.join(ok.select(key), key, "left_anti"))
            discard(before)
        r += 1
    nearest = unreached.withColumn("_i", F.least(F.greatest("_at", F.lit(1)), F.col("n"))).join(ev, [*by, "_i"]).select(key, entity)
    return found.unionByName(nearest)


def smoothed_date_pmf(cells: DataFrame, by: Sequence[str], day: str, parent: DataFrame, sparse_below: int = 20) -> DataFrame:
    """(by, day, p): daily counts pulled to the parent's shares on the parent's full calendar; alpha max(5, sqrt n), or max(20, n) when sparse."""
    by = list(by)
    calendar = parent.groupBy(day).agg(F.sum("n").alias("pn"))
    total = calendar.agg(F.sum("pn")).first()[0]
    lo, hi = calendar.agg(F.min(day), F.max(day)).first()
    size = cells.groupBy(*by).agg(F.sum("n").alias("_n"))
    grid = size.withColumn(day, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    a = F.when(F.col("_n") < sparse_below, F.greatest(F.lit(20.0), F.col("_n"))).otherwise(F.greatest(F.lit(5.0), F.sqrt("_n")))
    full = grid.join(cells.groupBy(*by, day).agg(F.sum("n").alias("c")), [*by, day], "left").join(calendar, day, "left")
    share = F.coalesce("pn", F.lit(0)) / F.lit(total)
    return full.select(*by, day, ((F.coalesce("c", F.lit(0)) + a * share) / (F.col("_n") + a)).alias("p"))


def apply_granularity(df: DataFrame, ts: str, key: str, mode: str, offsets: DataFrame | None, lo, hi, seed: int = 42) -> DataFrame:
    """Floor to the day, or day plus a sampled observed offset of seconds; clamped to the observed range."""
    if mode == "date_only":
        out = df.withColumn(ts, F.date_trunc("day", ts))
    elif mode == "empirical_offsets":
        drawn = pick_by_weight(df.select(key, hashed_unit(f"{seed}g", key).alias("_u")), "_u", offsets, "n", ["s"], keep=["s"])
        out = df.join(drawn, key).withColumn(ts, F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", ts)) + F.col("s"))).drop("s")
    else:
        out = df
    return out.withColumn(ts, F.least(F.greatest(F.col(ts), F.lit(lo)), F.lit(hi)))


def avoid_same_times(synthetic: DataFrame, real: DataFrame, day: str, key: str) -> DataFrame:
    """If both multisets of times are equal, move the first synthetic event by one day."""
    both = real.select(day, F.lit(True).alias("is_real")).unionByName(synthetic.select(day, F.lit(False).alias("is_real")))
    same = aligned_counts(both, [day]).agg(F.bool_and(F.col("real_n") == F.col("synthetic_n"))).first()[0]
    if not same:
        return synthetic
    first = synthetic.agg(F.min_by(key, F.struct(day, key))).first()[0]
    return synthetic.withColumn(day, F.when(F.col(key) == first, F.date_add(day, 1)).otherwise(F.col(day)))


# --- slots and stubs ----------------------------------------------------------------------------


def slots(cells: DataFrame, day: str = "day") -> DataFrame:
    """One row per event to place, keyed by its cell and number."""
    out = expand(cells.select("customer_block", "product_block", day, "n"), "n", "place").drop("n")
    return out.withColumn("slot", F.concat_ws("|", "customer_block", "product_block", day, "place"))


def desired_days(stubs: DataFrame, key: str, entity: str, day: str, mode: str, seed: int, model: DataFrame | None = None, block: str | None = None,
                 bandwidths: DataFrame | None = None, alpha: float = 10.0) -> DataFrame:
    """Stubs with `wanted` (day number): exact, local_kernel (own day plus rounded Laplace noise), or mixture (own day or block day)."""
    d = F.unix_date(day)
    if mode == "exact":
        return stubs.withColumn("wanted", d)
    lo, hi = stubs.agg(F.min(d), F.max(d)).first()
    if mode == "local_kernel":
        u = hashed_unit(f"{seed}k", key) - 0.5
        noise = -F.col("bandwidth") * F.signum(u) * F.ln(1 - 2 * F.abs(u))
        near = stubs.join(bandwidths.select(entity, "bandwidth"), entity)
        return near.withColumn("wanted", F.least(F.greatest(d + F.bround(noise).cast("int"), F.lit(lo)), F.lit(hi))).drop("bandwidth")
    own = ordered(stubs.select(entity, key, day), [entity], [day, key], rank="_i")
    size = own.groupBy(entity).agg(F.count(F.lit(1)).alias("_deg"))
    rows = stubs.select(key, entity, block).join(size, entity)
    use_own = hashed_unit(f"{seed}m", key) < F.col("_deg") / (F.col("_deg") + alpha)
    mine = rows.where(use_own).withColumn("_i", F.floor(hashed_unit(f"{seed}o", key) * F.col("_deg")) + 1).join(
        own.select(entity, "_i", F.unix_date(day).alias("wanted")), [entity, "_i"]).select(key, entity, block, "wanted")
    asked = rows.where(~use_own).select(block, key, entity, hashed_unit(f"{seed}b", key).alias("_u"))
    theirs = pick_by_weight(asked, "_u", model.select(block, F.col(day).alias("_d"), "p"), "p", ["_d"], [block], ["_d"])
    return mine.unionByName(theirs.select(key, entity, block, F.unix_date("_d").alias("wanted")))


def assign_stubs(slot_rows: DataFrame, stubs: DataFrame, block: str, key: str, entity: str, day: str = "day", seed: int = 42) -> DataFrame:
    """Slots with an entity: per block, stubs by wanted day meet slots by day, rank by rank, so degrees stay exact."""
    right = stubs.select(block, entity, "wanted", F.col(key).alias("_stub"))
    a = ranked_in_steps(slot_rows, [block], day, [hashed_long(f"{seed}s", "slot"), "slot"], "_r")
    b = ranked_in_steps(right, [block], "wanted", [hashed_long(f"{seed}t", "_stub"), "_stub"], "_r")
    return join_groups(a, b.select(block, "_r", entity), [block, "_r"]).select(*slot_rows.columns, entity)


def pair_by_projection(assigned: DataFrame, customer_score: Column, product_score: Column, seed: int = 42) -> DataFrame:
    """Inside each cell, customers by score meet products by score (ties by hash)."""
    cell = ["customer_block", "product_block", "day"]
    left = assigned.select(*cell, "slot", "customer_id", customer_score.alias("_cs"))
    right = assigned.select(*cell, F.col("slot").alias("_ps"), "product_id", product_score.alias("_v"))
    out = match_by_rank(left, right, cell, ["_cs", hashed_long(f"{seed}c", "slot"), "slot"], ["_v", hashed_long(f"{seed}q", "_ps"), "_ps"])
    return out.select(*cell, "slot", "customer_id", "product_id")


def pair_greedily(assigned: DataFrame, customer_vectors: DataFrame, product_vectors: DataFrame, real_pairs: DataFrame | None = None, run: int = PAIRING_RUN,
                  duplicate_penalty: float = 1.0, real_penalty: float = 0.0, gates: DataFrame | None = None, real_events: DataFrame | None = None, event_penalty: float = 1.0,
                  piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Customers and products of a cell meet in projection order; inside consecutive runs of `run` rows, highest affinity goes first.

    One rule for cells of any size: a small cell is one short run. Scores are vector products, weighted per dimension by
    the `gates` (month, weights) of the cell's month, minus penalties for a repeated pair in the run, for a real pair and
    for a real event of that day. Whole runs are dealt into batches of about `BATCH_ROWS` rows, so that a task neither
    starts Python work for each small run nor holds more than a few batches. Vectors, which are many times as wide as the rows,
    join them in pieces of about `piece_rows` rows, whole runs each, one piece after the other.
    """
    cell = ["customer_block", "product_block", "day"]
    place = [*cell, "_run"]
    cv, pv = customer_vectors.select("customer_id", F.col("vector").alias("u")), product_vectors.select("product_id", F.col("vector").alias("v"))
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(0.0))

    def gated(rows: DataFrame) -> DataFrame:
        rows = rows.join(cv, "customer_id", "left")
        if gates is None:
            return rows
        rows = rows.withColumn("month", F.trunc("day", "month").cast("date")).join(gates, "month", "left")
        return rows.withColumn("u", F.coalesce(F.zip_with("u", "weights", lambda a, b: a * b), "u")).drop("month", "weights")

    # only the first component takes part in the order; vectors join the pairs afterwards
    left = gated(assigned.select(*cell, "slot", "customer_id")).select(*cell, "slot", "customer_id", first("u").alias("_o"))
    right = assigned.select(*cell, F.col("slot").alias("_ps"), "product_id").join(pv, "product_id", "left").select(*cell, "_ps", "product_id", first("v").alias("_o"))
    left = ordered(left, cell, ["_o", hashed_long("42c", "slot"), "slot"], rank="_r").drop("_o")
    right = ordered(right, cell, ["_o", hashed_long("42q", "_ps"), "_ps"], rank="_r").drop("_ps", "_o")
    avoid = lambda name: F.coalesce(name, F.array().cast("array<long>")).alias(name)

    def narrow() -> DataFrame:
        rows = finished(lambda: join_groups(left, right, [*cell, "_r"]).withColumn("_run", F.floor((F.col("_r") - 1) / run)).drop("_r"))
        if real_events is None:
            return rows.withColumn("today", F.lit(None).cast("array<long>"))
        # a customer's real products of the cell's own day: as many as the customer bought that day
        today = real_events.select("customer_id", "day", "product_id").groupBy("customer_id", "day").agg(F.collect_set("product_id").alias("today"))
        return rows.join(today, ["customer_id", "day"], "left")

    def batched(rows: DataFrame) -> DataFrame:
        many = rows
        if real_pairs is not None:
            # real partners of the customers of a run that are present in the run
            known = real_pairs.select("customer_id", "product_id").distinct().join(rows.select(*place, "product_id").distinct(), "product_id")
            known = known.join(rows.select(*place, "customer_id").distinct(), [*place, "customer_id"], "left_semi")
            many = many.join(known.groupBy(*place, "customer_id").agg(F.collect_set("product_id").alias("known")), [*place, "customer_id"], "left")
        else:
            many = many.withColumn("known", F.lit(None).cast("array<long>"))
        # vectors come last, so that they move as little as can be
        many = gated(many).join(pv, "product_id", "left")
        batches = max(1, rows.count() // BATCH_ROWS)
        many = many.select(*place, "slot", "customer_id", "product_id", "u", "v", avoid("known"), avoid("today"), F.pmod(F.xxhash64(*place), F.lit(batches)).alias("_batch"))
        return many.groupBy("_batch").applyInArrow(greedy, kind)

    kind = "customer_block int, product_block int, day date, slot string, customer_id long, product_id long"

    def greedy(table: pa.Table) -> pa.Table:
        return _greedy_runs(table, duplicate_penalty, real_penalty, event_penalty)

    return in_pieces(finished(narrow), place, batched, piece_rows)


def _vectors(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """A row per vector, zeros for a missing one."""
    column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0))
    out = np.zeros((rows, max(sizes.max(initial=0), 1)))
    values = np.asarray(column.flatten().fill_null(0.0), dtype=np.float64)
    at = np.repeat(np.arange(rows), sizes)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _greedy_runs(table: pa.Table, duplicate_penalty: float, real_penalty: float, event_penalty: float) -> pa.Table:
    """Products dealt anew inside each run of the batch: rows by their best score, each takes the best product left."""
    keys = ["customer_block", "product_block", "day", "_run"]
    table = table.sort_by([(c, "ascending") for c in [*keys, "slot"]])
    n = table.num_rows
    u, v = _vectors(table["u"], n), _vectors(table["v"], n)
    width = max(u.shape[1], v.shape[1])
    u, v = np.pad(u, ((0, 0), (0, width - u.shape[1]))), np.pad(v, ((0, 0), (0, width - v.shape[1])))
    new = np.zeros(n, dtype=bool)
    for c in keys:
        column = table[c].combine_chunks()
        a, b = column.slice(1), column.slice(0, max(n - 1, 0))
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= np.asarray(differ)
    starts = [0, *np.flatnonzero(new).tolist(), n]
    customers, products = table["customer_id"].to_pylist(), table["product_id"].to_pylist()
    penalties = [(table[c].to_pylist(), cost) for c, cost in (("known", real_penalty), ("today", event_penalty)) if cost]
    chosen = list(products)
    for lo, hi in zip(starts, starts[1:]):
        size = hi - lo
        if size < 2:
            continue
        score, here = u[lo:hi] @ v[lo:hi].T, products[lo:hi]
        for lists, cost in penalties:
            for i in range(size):
                if lists[lo + i]:
                    bad = set(lists[lo + i])
                    score[i] -= [cost if p in bad else 0.0 for p in here]
        repeated = len(set(customers[lo:hi])) < size
        used: dict = {}
        for i in np.argsort(-score.max(axis=1), kind="stable").tolist():
            row = score[i]
            if repeated:
                mine = used.setdefault(customers[lo + i], {})
                if mine and duplicate_penalty:
                    row = row - duplicate_penalty * np.log1p([mine.get(p, 0) for p in here])
            j = int(row.argmax())
            score[:, j] = -np.inf
            chosen[lo + i] = here[j]
            if repeated:
                mine[here[j]] = mine.get(here[j], 0) + 1
    out = table.select(["customer_block", "product_block", "day", "slot", "customer_id"])
    return out.append_column("product_id", pa.array(chosen, pa.int64()))


def swap_away_overlaps(paired: DataFrame, real_events: DataFrame, by: Sequence[str], keys: Sequence[str], window: int = 500, seed: int = 42) -> DataFrame:
    """Swap products inside a group so that fewer synthetic rows repeat a real event (or a real edge).

    `keys` say what counts as a repeat besides customer and product (the day, or nothing). Large groups
    are cut into windows, so a task never holds more than `window` rows; a swap keeps all exact counts. Rows that
    still repeat meet other rows in a new cut, until a cut removes none; `repeats` counts what then remains.
    """
    out, left, r = paired, None, 0
    while True:
        last, out = out, finished(lambda: _swapped_once(out, real_events, by, keys, window, f"{seed}r{r}" if r else seed))
        if last is not paired:
            discard(last)
        before, left, r = left, repeats(out, real_events, keys), r + 1
        # a group of one window has been searched whole
        if not left or (before is not None and left >= before) or (r == 1 and not _has_large_group(out, by, window)):
            return out


def spread_repeats(paired: DataFrame, by: Sequence[str], real_events: DataFrame | None = None, keys: Sequence[str] = ("day",), window: int = 500, seed: int = 42, patience: int = 3, goal: int = 0) -> DataFrame:
    """Swap products inside cells so that fewer customers meet a product again, counted over all cells.

    Work goes in rounds. In a round every customer takes part in one cell only, one where a pair of theirs is repeated if
    there is any, so no two cells of a round share a customer: the pair counts that the last round left, read from the whole
    table, hold while cells are worked on side by side, and each swap that lowers the sum over its pairs lowers the total. A
    swap may not add a real event (`real_events` by `keys`). Rounds end when no more than `goal` rows repeat a pair or
    `patience` rounds brought no less; every exact count of the spine stays.

    Large cells are cut into windows of about `window` rows by customer, whole windows are dealt into batches; a customer
    with more rows in one cell than that is cut too.
    """
    by, keys = list(by), list(keys)
    out = best = materialize(paired)
    least, since, r = None, 0, 0
    while True:
        pairs = materialize(out.groupBy("customer_id", "product_id").agg(F.count(F.lit(1)).alias("n")))
        excess = repeated_pairs(pairs)
        if least is None or excess < least:
            passed, best, least, since = best, out, excess, 0
        else:
            passed, since = out, since + 1
        done = least <= goal or since >= patience
        if not done:
            out, r = finished(lambda: _spread_once(out, pairs, by, real_events, keys, window, f"{seed}x{r}")), r + 1
        discard(*[df for df in (pairs, passed) if df is not best and df is not paired])
        if done:
            return best


def repeated_pairs(pairs: DataFrame) -> int:
    """Rows beyond the first of their pair, from (customer_id, product_id, n)."""
    return pairs.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]


def _spread_once(rows: DataFrame, pairs: DataFrame, by: list[str], real_events: DataFrame | None, keys: list[str], window: int, seed: str) -> DataFrame:
    draw = hashed_long(f"{seed}c", "customer_id", *by)
    one_cell = lambda df: df.groupBy("customer_id").agg(F.max_by(F.struct(*by), draw).alias("_c")).select("customer_id", "_c.*")
    own = materialize(one_cell(rows.join(pairs.where("n > 1"), ["customer_id", "product_id"], "left_semi")))
    active = rows.join(own.select(*by).distinct(), by, "left_semi")
    others = one_cell(active.join(own.select("customer_id"), "customer_id", "left_anti"))
    part = active.join(own.unionByName(others), ["customer_id", *by], "left_semi")
    many = part.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    heavy = part.groupBy(*by, "customer_id").agg(F.count(F.lit(1)).alias("_mine")).where(F.col("_mine") > window)
    part = part.join(many, by).join(heavy, [*by, "customer_id"], "left")
    spread = F.when(F.col("_mine").isNotNull(), hashed_long(f"{seed}r", "slot")).otherwise(hashed_long(f"{seed}w", "customer_id"))
    part = materialize(part.withColumn("_w", F.pmod(spread, F.ceil(F.col("_n") / window))).drop("_n", "_mine"))
    place = [*by, "_w"]
    products = part.select(*place, "product_id").distinct()
    mine = part.select(*place, "customer_id").distinct()
    known = pairs.join(mine, "customer_id").join(products, [*place, "product_id"], "left_semi")
    known = known.groupBy(*place, "customer_id").agg(F.collect_list(F.struct("product_id", "n")).alias("_known"))
    known = known.select(*place, "customer_id", F.col("_known.product_id").alias("known"), F.col("_known.n").alias("counts"))
    work = part.join(known, [*place, "customer_id"])
    if real_events is not None:
        taken = part.select(*place, "customer_id", *[k for k in keys if k not in place]).distinct()
        real = real_events.select("customer_id", "product_id", *keys).distinct().join(taken, ["customer_id", *keys]).join(products, [*place, "product_id"], "left_semi")
        real = real.groupBy(*place, "customer_id").agg(F.collect_set("product_id").alias("real"))
        work = work.join(real, [*place, "customer_id"], "left")
    else:
        work = work.withColumn("real", F.lit(None).cast("array<long>"))
    batches = max(1, part.count() // BATCH_ROWS)
    work = work.select(F.md5(F.concat_ws("|", *place)).alias("group"), hashed_long(f"{seed}o", "slot").alias("turn"), "slot", "customer_id", "product_id", "known", "counts", "real")
    # written, as it is few rows made of many: what they were made of need not lie beside the whole table's shuffle
    moved = materialize(work.withColumn("_batch", F.pmod(F.xxhash64("group"), F.lit(batches))).groupBy("_batch").applyInArrow(_spread_groups, "slot string, moved long"))
    return rows.join(moved, "slot", "left").withColumn("product_id", F.coalesce("moved", "product_id")).select(*rows.columns)


def _spread_groups(table: pa.Table) -> pa.Table:
    """(slot, moved): products that changed places; each group of the batch is searched by itself."""
    table = table.sort_by([("group", "ascending"), ("turn", "ascending"), ("slot", "ascending")])
    group, customer, product = (table[c].to_pylist() for c in ("group", "customer_id", "product_id"))
    known, counts, real = (table[c].to_pylist() for c in ("known", "counts", "real"))
    before = list(product)
    ends = [i for i in range(1, len(group)) if group[i] != group[i - 1]]
    for lo, hi in zip([0, *ends], [*ends, len(group)]):
        n: dict[tuple, int] = {}
        taboo: set[tuple] = set()
        for i in range(lo, hi):
            c = customer[i]
            n.update(((c, p), k) for p, k in zip(known[i], counts[i]))
            taboo.update((c, p) for p in real[i] or ())
        for i in range(lo, hi):
            a, p = customer[i], product[i]
            if n[a, p] < 2:
                continue
            for j in (*range(i + 1, hi), *range(lo, i)):
                b, q = customer[j], product[j]
                if a == b or p == q or (a, q) in taboo and (a, p) not in taboo or (b, p) in taboo and (b, q) not in taboo:
                    continue
                if (n.get((a, q), 0) > 0) + (n.get((b, p), 0) > 0) < 1 + (n[b, q] > 1):
                    for x in ((a, p), (b, q)):
                        n[x] -= 1
                    for x in ((a, q), (b, p)):
                        n[x] = n.get(x, 0) + 1
                    product[i], product[j] = q, p
                    break
    keep = [i for i in range(len(product)) if product[i] != before[i]]
    return pa.table({"slot": table["slot"].take(pa.array(keep, pa.int64())), "moved": pa.array([product[i] for i in keep], pa.int64())})


def overlap_report(stages: Mapping[str, DataFrame], real_events: DataFrame, keys: Sequence[str] = ("day",)) -> DataFrame:
    """(stage, rows, repeated_events, repeated_edges, repeated_pairs): what each stage of a repair left.

    Rows that repeat a real event, rows on a real edge, and rows beyond the first of their own customer and product.
    """
    out = None
    for name, rows in stages.items():
        rows = materialize(rows)
        n = rows.groupBy("customer_id", "product_id").agg((F.count(F.lit(1)) - 1).alias("again")).agg(F.coalesce(F.sum("again"), F.lit(0)).alias("repeated_pairs"), F.lit(rows.count()).cast("long").alias("rows"))
        line = n.select(F.lit(name).alias("stage"), "rows", F.lit(repeats(rows, real_events, keys)).cast("long").alias("repeated_events"), F.lit(repeats(rows, real_events, [])).cast("long").alias("repeated_edges"), "repeated_pairs")
        out = line if out is None else out.unionByName(line)
    return out


def repeats(paired: DataFrame, real_events: DataFrame, keys: Sequence[str]) -> int:
    """Synthetic rows that repeat a real event (or a real edge, without keys)."""
    same = ["customer_id", "product_id", *keys]
    return paired.join(real_events.select(*same).distinct(), same, "left_semi").count()


def _has_large_group(df: DataFrame, by: Sequence[str], rows: int) -> bool:
    return not df.groupBy(*by).count().where(F.col("count") > rows).isEmpty()


def _swapped_once(paired: DataFrame, real_events: DataFrame, by: Sequence[str], keys: Sequence[str], window: int, seed) -> DataFrame:
    by, keys = list(by), list(keys)
    real = real_events.select("customer_id", "product_id", *keys).distinct().withColumn("_hit", F.lit(True))
    ranked = ordered(paired, by, [hashed_long(f"{seed}w", "slot"), "slot"], rank="_r").withColumn("_w", F.floor((F.col("_r") - 1) / window))
    marked = finished(lambda: ranked.join(real, ["customer_id", "product_id", *keys], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))))
    group = [*by, "_w"]
    bad = marked.groupBy(*group).agg(F.max("_hit").alias("_any"), F.count(F.lit(1)).alias("_n"))
    marked = materialize(marked.join(bad, group))
    fine = marked.where(~F.col("_any") | (F.col("_n") == 1)).select(*paired.columns)
    broken = marked.where(F.col("_any") & (F.col("_n") > 1))
    # real partners of the customers of a broken window, limited to products present in that window
    outer = [k for k in keys if k not in group]
    known = real.drop("_hit").join(broken.select(*group, *outer, "customer_id").distinct(), ["customer_id", *keys])
    known = known.join(broken.select(*group, "product_id").distinct(), [*group, "product_id"], "left_semi").groupBy(*group, "customer_id").agg(F.collect_set("product_id").alias("known"))
    rows = broken.join(known, [*group, "customer_id"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<long>")))

    columns = paired.columns

    def swap(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r").reset_index(drop=True)
        known_sets = [set(k) for k in pdf["known"]]
        product = pdf["product_id"].to_list()
        n = len(pdf)
        for i in range(n):
            if product[i] not in known_sets[i]:
                continue
            for step in range(1, n):
                j = (i + step) % n
                before = 1 + (product[j] in known_sets[j])
                after = (product[j] in known_sets[i]) + (product[i] in known_sets[j])
                if after < before:
                    product[i], product[j] = product[j], product[i]
                    break
        return pdf.assign(product_id=product)[columns]

    return fine.unionByName(rows.groupBy(*group).applyInPandas(swap, paired.schema))


def block_stub_matching(events: DataFrame, customer_blocks: DataFrame, product_blocks: DataFrame, key: str, mode: str = "mixture", pairing: str = "time_gated",
                        vectors: tuple[DataFrame, DataFrame] | None = None, seed: int = 42, repair: bool = True, spread: bool = True) -> DataFrame:
    """The main generator: cells to slots, stubs to slots by time on both sides, pairing in cells, fewer repeated pairs over all
    cells (`spread`, not for random pairing), repair of repeated real events.

    Keeps exactly: both degree sequences, events per day, and events per (customer block, product block, day).
    `pairing` inside a cell: time_gated (affinity weighted by month, with penalties for repeated pairs and real events;
    vectors are fitted where none are given), greedy, projection, or random.
    """
    return finished(lambda: _block_stub_matching(events, customer_blocks, product_blocks, key, mode, pairing, vectors, seed, repair, spread))


def _block_stub_matching(events, customer_blocks, product_blocks, key, mode, pairing, vectors, seed, repair, spread) -> DataFrame:
    from chronoweave.operators import priors as pr

    base = finished(lambda: ct.with_blocks(events.select(key, "customer_id", "product_id", "day"), customer_blocks, product_blocks))

    def assigned(placed: DataFrame, entity: str, block: str, tag: str) -> DataFrame:
        model = bandwidths = None
        if mode == "mixture":
            _, model = pr.activity_model(base, entity, "day", base.select(entity, block).distinct(), block)
        elif mode == "local_kernel":
            bandwidths = pr.gap_bandwidths(base, entity, "day", [key], base.select(entity, block).distinct(), block)
        stubs = desired_days(base.select(key, entity, block, "day"), key, entity, "day", mode, f"{seed}{tag}", model, block, bandwidths)
        return assign_stubs(placed, stubs, block, key, entity, seed=f"{seed}{tag}")

    def gated() -> DataFrame:
        known = base.select("customer_id", "product_id", F.trunc("day", "month").cast("date").alias("month"))
        known = known.join(vectors[0].select("customer_id", F.col("vector").alias("u")), "customer_id").join(vectors[1].select("product_id", F.col("vector").alias("v")), "product_id")
        return pr.time_gates(known, "month", "u", "v", 100.0).groupBy("month").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "weight"))), lambda x: x["weight"]).alias("weights"))

    placed = slots(ct.cell_counts(base))
    for entity, block, tag in (("customer_id", "customer_block", "c"), ("product_id", "product_block", "p")):
        before, placed = placed, finished(lambda: assigned(placed, entity, block, tag))
        discard(before)
    if pairing == "time_gated":
        vectors = vectors or affinity_vectors(base)
        gates = finished(gated)
        paired = pair_greedily(placed, *vectors, gates=gates, real_events=base)
    elif pairing == "greedy" and vectors is not None:
        paired = pair_greedily(placed, *vectors)
    elif pairing == "projection" and vectors is not None:
        cv, pv = vectors
        scored = placed.join(cv.select("customer_id", F.element_at("vector", 1).alias("_cs")), "customer_id", "left").join(
            pv.select("product_id", F.element_at("vector", 1).alias("_pv")), "product_id", "left")
        paired = pair_by_projection(scored, F.coalesce("_cs", F.lit(0.0)), F.coalesce("_pv", F.lit(0.0)), seed)
    else:
        paired, spread = placed, False  # hash order inside a cell is already a random pairing
    shown = ["slot", "customer_id", "product_id", "day", "customer_block", "product_block"]
    before, paired = placed, finished(lambda: paired.select(*shown))
    discard(before)
    if spread:  # until no more pairs are repeated than in the real table
        goal = repeated_pairs(base.groupBy("customer_id", "product_id").agg(F.count(F.lit(1)).alias("n")))
        before, paired = paired, spread_repeats(paired, ["customer_block", "product_block", "day"], base, seed=seed, goal=goal)
        if paired is not before:
            discard(before)
    if repair:
        paired = swap_away_overlaps(paired, base, ["customer_block", "product_block", "day"], ["day"], seed=seed)
    return paired.select(*shown) if paired.columns != shown else paired


def exact_constraints(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(constraint, holds): rows, both degree sequences, daily counts, block-pair and cell counts."""
    both = real.select("customer_id", "product_id", "day", "customer_block", "product_block", F.lit(True).alias("is_real")).unionByName(
        synthetic.select("customer_id", "product_id", "day", "customer_block", "product_block", F.lit(False).alias("is_real")))
    rules = {"row_count": [], "customer_degrees": ["customer_id", "customer_block"], "product_degrees": ["product_id", "product_block"], "daily_counts": ["day"],
             "block_pair_counts": ["customer_block", "product_block"], "cell_counts": ["customer_block", "product_block", "day"]}
    both, out = materialize(both), None
    for name, keys in rules.items():
        c = aligned_counts(both, keys).agg(F.bool_and(F.col("real_n") == F.col("synthetic_n")).alias("holds")).select(F.lit(name).alias("constraint"), "holds")
        out = c if out is None else out.unionByName(c)
    return out


EXACT_COUNTS = {"customer_degrees": ["customer_id", "customer_block"], "product_degrees": ["product_id", "product_block"], "daily_counts": ["day"],
                "block_pair_counts": ["customer_block", "product_block"], "cell_counts": ["customer_block", "product_block", "day"]}


def exact_counts(events: DataFrame, names: Sequence[str] = tuple(EXACT_COUNTS)) -> DataFrame:
    """(constraint, key, n): the counts that a generated spine shares with its source, the key's parts joined by a bar."""
    out = None
    for name in names:
        keys = EXACT_COUNTS[name]
        c = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("constraint"), F.concat_ws("|", *keys).alias("key"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def require_exact(report: DataFrame) -> DataFrame:
    """The report as a finished table; a broken constraint raises."""
    lines = report.collect()  # one line per constraint
    broken = [r["constraint"] for r in lines if not r["holds"]]
    if broken:
        raise ValueError(f"exact constraints broken: {broken}")
    return report.sparkSession.createDataFrame(lines, report.schema)


# --- other generators ---------------------------------------------------------------------------


def stub_lists(events: DataFrame, key: str, tentative: Column, seed: int = 42, window: int | None = None, real: DataFrame | None = None) -> DataFrame:
    """Per block pair, customer, product and time stubs in order of a tentative time, shuffled inside small windows, zipped.

    The window is max(10, sqrt n) rows of the pair unless given.
    """
    return finished(lambda: _stub_lists(events, key, tentative, seed, window))


def _stub_lists(events: DataFrame, key: str, tentative: Column, seed: int, window: int | None) -> DataFrame:
    pair = ["customer_block", "product_block"]
    base = materialize(events.select(*pair, key, "customer_id", "product_id", "day", tentative.alias("_t")))
    size = base.groupBy(*pair).agg(F.count(F.lit(1)).alias("_n"))
    base = base.join(size, pair)
    width = F.lit(window) if window else F.greatest(F.lit(10), F.floor(F.sqrt("_n")))

    def listed(name: str, col: str) -> DataFrame:
        first = ordered(base.select(*pair, "_n", key, col, "_t"), pair, ["_t", hashed_long(f"{seed}{name}", key), key], rank="_r")
        shuffled = first.withColumn("_w", F.floor((F.col("_r") - 1) / width))
        again = ordered(shuffled, pair, ["_w", hashed_long(f"{seed}{name}x", key), key], rank="_i") if name != "d" else shuffled.withColumn("_i", F.col("_r"))
        return again.select(*pair, "_i", col, *(["_w"] if name == "d" else []))

    parts = {name: finished(lambda: listed(name, col)) for name, col in (("c", "customer_id"), ("p", "product_id"), ("d", "day"))}
    out = parts["d"].join(parts["c"], [*pair, "_i"]).join(parts["p"], [*pair, "_i"])
    return out.withColumn("slot", F.concat_ws("|", *pair, "_i"))


def temporal_block_model(events: DataFrame, total: int, key: str, x: str, seed: int = 42, fallback: float = 0.05) -> DataFrame:
    """Events drawn per block pair: scaled counts, a KDE time, then a customer and a product active around that time."""
    from chronoweave.operators.priors import kde_bandwidths

    pair = ["customer_block", "product_block"]
    counts = events.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"))
    wanted = scale_counts(counts, pair, "n", total)
    draws = expand(wanted.select(*pair, "scaled"), "scaled", "place").drop("scaled").withColumn("draw", F.concat_ws("|", *pair, "place"))
    bw = finished(lambda: kde_bandwidths(events, pair, x, fallback))
    timed = finished(lambda: kde_times(draws, "draw", pair, events, x, bw, seed))
    c = endpoints_near(timed, "draw", pair, "time", events, x, "customer_id", bw, f"{seed}c")
    p = endpoints_near(timed, "draw", pair, "time", events, x, "product_id", bw, f"{seed}p")
    return timed.join(c, "draw").join(p, "draw").select("draw", *pair, "customer_id", "product_id", "time")


def draw_with_repair(slot_rows: DataFrame, own: DataFrame, degrees: DataFrame, entity: str, block: str, day: str = "day", alpha: float = 10.0, seed: int = 42) -> DataFrame:
    """Entity per slot in proportion to degree times activity, then exact degrees by moving the surplus to deficits.

    degree * P(t) splits into w*count(entity, t), which is sparse, plus (1-w)*degree times the block's
    share of the day, which does not depend on the entity's own days: two picks, never an entity-by-day grid.
    """
    d = degrees.select(entity, block, "degree").withColumn("w", F.col("degree") / (F.col("degree") + alpha))
    sparse = own.select(entity, day, "n").join(d, entity).select(block, day, entity, (F.col("w") * F.col("n")).alias("weight"))
    block_day = own.select(entity, day, "n").join(d, entity).groupBy(block, day).agg(F.sum("n").alias("bn"), F.sum(F.col("w") * F.col("n")).alias("s1"))
    rest = d.groupBy(block).agg(F.sum((1 - F.col("w")) * F.col("degree")).alias("r"), F.sum("degree").alias("bt"))
    share = block_day.join(rest, block).select(block, day, (F.col("s1") / (F.col("s1") + F.col("r") * F.col("bn") / F.col("bt"))).alias("own_share"))
    s = slot_rows.select(block, day, "slot").join(share, [block, day], "left")
    use_own = hashed_unit(f"{seed}z", "slot") < F.coalesce("own_share", F.lit(0.0))
    a = pick_by_weight(s.where(use_own).select(block, day, "slot", hashed_unit(f"{seed}y", "slot").alias("_u")), "_u", sparse, "weight", [entity], [block, day], [entity])
    flat = d.select(block, entity, ((1 - F.col("w")) * F.col("degree")).alias("weight"))
    b = pick_by_weight(s.where(~use_own).select(block, "slot", hashed_unit(f"{seed}y", "slot").alias("_u")), "_u", flat, "weight", [entity], [block], [entity])
    drawn = materialize(a.select(block, "slot", entity).unionByName(b.select(block, "slot", entity)))
    ranked = ordered(drawn, [entity], [hashed_long(f"{seed}r", "slot"), "slot"], rank="_r").join(d.select(entity, "degree"), entity)
    kept = ranked.where(F.col("_r") <= F.col("degree")).select("slot", entity)
    surplus = ranked.where(F.col("_r") > F.col("degree")).select(block, "slot")
    have = drawn.groupBy(entity).agg(F.count(F.lit(1)).alias("have"))
    short = d.join(have, entity, "left").withColumn("missing", F.col("degree") - F.coalesce("have", F.lit(0))).where("missing > 0")
    gaps = expand(short.select(block, entity, "missing"), "missing", "_g")
    fixed = match_by_rank(surplus, gaps.select(block, entity, "_g"), [block], [hashed_long(f"{seed}f", "slot"), "slot"], [hashed_long(f"{seed}h", entity, "_g"), entity, "_g"])
    return kept.unionByName(fixed.select("slot", entity))


def candidate_affinity(slot_rows: DataFrame, entities: Mapping[str, tuple[DataFrame, str]], vectors: tuple[DataFrame, DataFrame], candidates: int = 8, seed: int = 42, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(slot, customer_id, product_id): per slot a pool of candidate pairs drawn by degree, one kept by softmax of affinity.

    `entities` map id column to (degrees with block, block column). Candidates come from weighted picks, so no cell is ever collected.
    Pools, which are many times as wide as the slots, are drawn for pieces of slots, about `piece_rows` candidates at a time.
    """
    slot_rows = finished(lambda: slot_rows.select("slot", "customer_block", "product_block"))
    return in_pieces(slot_rows, ["slot"], lambda piece: _candidate_affinity(piece, entities, vectors, candidates, seed), max(1, piece_rows // candidates))


def _candidate_affinity(slot_rows: DataFrame, entities: Mapping[str, tuple[DataFrame, str]], vectors: tuple[DataFrame, DataFrame], candidates: int, seed: int) -> DataFrame:
    pool = slot_rows.select("slot", "customer_block", "product_block").withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(candidates))))
    pool = pool.withColumn("_key", F.concat_ws("#", "slot", "_j"))
    for e, (deg, block) in entities.items():
        # written, as the size of exploded rows is guessed by that of the rows before; the pick keeps the pool's columns
        before, pool = pool, finished(lambda: pick_by_weight(pool.withColumn("_u", hashed_unit(f"{seed}{e}", "_key")), "_u", deg.select(block, e, "degree"), "degree", [e], [block], [e]))
        discard(before)
    cv, pv = vectors
    scored = pool.join(cv.select("customer_id", F.col("vector").alias("u")), "customer_id", "left").join(pv.select("product_id", F.col("vector").alias("v")), "product_id", "left")
    s = F.coalesce(dot("u", "v"), F.lit(0.0)) - F.ln(-F.ln(hashed_unit(f"{seed}w", "_key")))
    return scored.groupBy("slot").agg(F.max_by(F.struct("customer_id", "product_id"), F.struct(s, "_j")).alias("b")).select("slot", "b.customer_id", "b.product_id")


def affinity_vectors(pairs: DataFrame, rank: int = 8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Unit vectors of customers and products from implicit factors of log1p pair counts (MLlib ALS scales past one machine's columns)."""
    return finished(lambda: _affinity_vectors(pairs, rank, seed))


def _affinity_vectors(pairs: DataFrame, rank: int, seed: int) -> tuple[DataFrame, DataFrame]:
    from pyspark.ml.recommendation import ALS

    data = pairs.groupBy("customer_id", "product_id").agg(F.log1p(F.count(F.lit(1))).cast("float").alias("w"))
    data = materialize(data)
    names = ("customer_id", "product_id")
    numbers: dict[str, DataFrame] = {}
    for c in names:  # the model knows whole numbers below 2^31 only
        kind = dict(data.dtypes)[c]
        if kind not in ("tinyint", "smallint", "int") and (kind != "bigint" or not data.where(~F.col(c).between(-(2**31), 2**31 - 1)).isEmpty()):
            numbers[c] = materialize(numbered(data.select(c).where(F.col(c).isNotNull()).distinct(), [c], "_n"))
            data = data.join(numbers[c], c).drop(c).withColumnRenamed("_n", c)
    data = materialize(data.withColumns({c: F.col(c).cast("int") for c in names}))
    # a task holds the pairs of a block: their number follows the table, from ten on, the model's own
    blocks = max(10, -(-data.count() // BLOCK_PAIRS))
    m = ALS(rank=rank, maxIter=5, numUserBlocks=blocks, numItemBlocks=blocks, implicitPrefs=True, userCol="customer_id", itemCol="product_id", ratingCol="w", seed=seed, regParam=0.05).fit(data)

    def unit(f: DataFrame, name: str) -> DataFrame:
        f = f.select(F.col("id").cast("long").alias(name), "features")
        if name in numbers:
            f = f.withColumnRenamed(name, "_n").join(numbers[name], "_n").drop("_n")
        v = F.transform("features", lambda x: x.cast("double"))
        return materialize(f.select(name, v.alias("r"), norm(v).alias("l")).select(
            name, F.transform("r", lambda x: x / F.greatest(F.col("l"), F.lit(1e-12))).alias("vector")))

    return unit(m.userFactors, "customer_id"), unit(m.itemFactors, "product_id")


def pair_scores(pairs: DataFrame, vectors: tuple[DataFrame, DataFrame], degrees: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Add `score`: vector product, or the log degree sum when a side is unknown."""
    cv, pv = vectors
    out = pairs.join(cv.select("customer_id", F.col("vector").alias("u")), "customer_id", "left").join(pv.select("product_id", F.col("vector").alias("v")), "product_id", "left")
    out = out.join(degrees[0].select("customer_id", F.col("degree").alias("_cd")), "customer_id", "left").join(degrees[1].select("product_id", F.col("degree").alias("_pd")), "product_id", "left")
    fallback = F.log1p(F.coalesce("_cd", F.lit(0))) + F.log1p(F.coalesce("_pd", F.lit(0)))
    return out.withColumn("score", F.coalesce(dot("u", "v"), fallback)).drop("u", "v", "_cd", "_pd")


def event_score(static, customer_p, product_p, age, remaining, duplicates, real) -> Column:
    """Score of placing an event: affinity, log activity of both sides, product age, remaining degree, minus repeats."""
    c = as_col
    return (c(static) + F.ln(F.greatest(c(customer_p), F.lit(1e-12))) + F.ln(F.greatest(c(product_p), F.lit(1e-12))) + 0.5 * c(age)
            + 0.1 * F.log1p(c(remaining)) - c(duplicates) - 2.0 * c(real))


def type_blocks(ids: DataFrame, entity: str, block: str) -> DataFrame:
    """One block for everything of a type."""
    return ids.select(entity).distinct().withColumn(block, F.lit(0))


def compact_blocks(blocks: DataFrame, block: str, out: str) -> DataFrame:
    """Block ids renumbered 0..k-1 by size (falling) and id."""
    size = blocks.groupBy(block).agg(F.count(F.lit(1)).alias("_n"))
    ids = numbered(size, [F.desc("_n"), block], "_i").select(block, (F.col("_i") - 1).cast("int").alias(out))
    return blocks.join(ids, block)


def cluster_blocks(vectors: DataFrame, entity: str, k: int, block: str, seed: int = 42) -> DataFrame:
    """Blocks from k-means on affinity vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(entity, array_to_vector("vector").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=10).fit(data).transform(data).select(entity, F.col("prediction").alias(block))


def rewire(edges: DataFrame, key: str, src: str, dst: str, by: Sequence[str], seed: int = 42, patience: int = 10) -> DataFrame:
    """Targets permuted among edges of the same class (block pair and in-degree class), without new parallel edges.

    Every source keeps its degree, every target too, and so do block and joint degree matrices. A permutation is one cycle in
    random order: each edge takes the target of the edge before it, which is one pass over the table. Edges that end up
    parallel are permuted again together with random partners, round by round, until none is left; rounds move only those
    and look up their pairs, the table itself is not written again. It raises only when their number has not fallen for
    `patience` rounds.
    """
    indeg = edges.groupBy(dst).agg(F.count(F.lit(1)).alias("_in"))
    allowed = edges.groupBy(src, dst).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]
    cls = [*by, "_in"]
    base = materialize(edges.select(key, src, dst, *by).join(indeg, dst))
    size = materialize(base.groupBy(*cls).agg(F.count(F.lit(1)).alias("_n")))
    first = materialize(_cycled(base, key, dst, cls, f"{seed}l0"))
    # what later rounds have moved stands for its rows of the first table
    moved = first.limit(0)
    crowded = first.groupBy(src, dst).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > allowed)
    best, since, r = None, 0, 0
    while True:
        now = first.join(moved.select(key), key, "left_anti").unionByName(moved)
        # only a pair that a round has moved can be parallel, and only its rows are numbered
        there = materialize(join_groups(now, materialize(crowded).select(src, dst), [src, dst], "left_semi"))
        dup = materialize(ordered(there, [src, dst], [key], rank="_c").where(F.col("_c") > allowed).drop("_c"))
        n = dup.count()
        if n == 0:
            return now.select(key, src, dst, *by)
        best, since, r = (n, 0, r + 1) if best is None or n < best else (best, since + 1, r + 1)
        if since >= patience:
            raise ValueError(f"{n} parallel edges left, no fewer than {best} for {patience} rounds")
        share = join_groups(dup.groupBy(*cls).agg(F.count(F.lit(1)).alias("_d")), size, cls)
        near = hashed_unit(f"{seed}j{r}", key) < 4 * F.col("_d") / F.col("_n")
        on = join_groups(now, share, cls).join(dup.select(key, F.lit(True).alias("_dup")), key, "left").where(F.col("_dup").isNotNull() | near)
        on = materialize(_cycled(materialize(on.select(key, src, dst, *cls)), key, dst, cls, f"{seed}l{r}"))
        moved = materialize(moved.join(on.select(key), key, "left_anti").unionByName(on))
        now = first.join(moved.select(key), key, "left_anti").unionByName(moved)
        pairs = materialize(moved.select(src, dst).distinct())
        crowded = join_groups(now, pairs, [src, dst], "left_semi").groupBy(src, dst).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > allowed)


def _cycled(rows: DataFrame, key: str, dst: str, cls: list[str], seed: str) -> DataFrame:
    """Each row with the target of the row before it, in random order inside its class; the first takes that of the last."""
    rows = rows.withColumn("_h", hashed_long(seed, key))
    last = rows.groupBy(*cls).agg(F.max_by(dst, F.struct("_h", key)).alias("_last"))
    turned = ordered(materialize(rows), cls, ["_h", key], rank="_r", previous={"_new": F.col(dst)})
    turned = join_groups(turned, last, cls).withColumn(dst, F.when(F.col("_r") == 1, F.col("_last")).otherwise(F.col("_new")))
    return turned.drop("_h", "_r", "_new", "_last")
