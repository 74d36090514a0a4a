"""Attributes for a synthetic spine: donors from histories, probability picks, calibration, effects, texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.functions.cleaning import array_sum, log_clip, softmax
from chronoweave.functions.hashing import hashed_normal, hashed_unit
from chronoweave.functions.kernels import materialize, numbered, ordered
from chronoweave.operators.histories import strict_prior


def donor_values(spine: DataFrame, key: str, train: DataFrame, tie: str, columns: Sequence[str], by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """(key, columns): a training row of the same group by hashed position, whole row at once; groups without donors are left out."""
    by = list(by)
    donors = ordered(train.select(*by, tie, *columns), by, [tie], rank="_i")
    size = donors.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    u = hashed_unit(seed, key)
    asked = spine.select(key, *by).join(size, by) if by else spine.select(key).withColumn("_n", F.lit(size.first()[0]))
    asked = asked.withColumn("_i", F.floor(u * F.col("_n")) + 1)
    return asked.join(donors.drop(tie), [*by, "_i"]).select(key, *columns)


def independent_columns(spine: DataFrame, key: str, train: DataFrame, tie: str, columns: Sequence[str], seed: int = 42) -> DataFrame:
    """Every column from its own donor."""
    out = spine.select(key)
    for c in columns:
        out = out.join(donor_values(spine, key, train, tie, [c], seed=f"{seed}{c}"), key)
    return out


def donors_with_backoff(spine: DataFrame, key: str, train: DataFrame, tie: str, columns: Sequence[str], levels: Sequence[Sequence[str]], seed: int = 42) -> DataFrame:
    """Joint donor rows from the first level (most specific first) that has any; the last level should be ()."""
    left, parts = spine, []
    for i, by in enumerate(levels):
        got = materialize(donor_values(left, key, train, tie, columns, by, f"{seed}l{i}").withColumn("level", F.lit(i)))
        parts.append(got)
        left = left.join(got.select(key), key, "left_anti")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def past_donors(events: DataFrame, key: str, entity: str, ts: str, columns: Sequence[str], seed: int = 42) -> DataFrame:
    """(key, columns): a strictly earlier event of the same entity by hashed position; nulls for the first ones."""
    prior = strict_prior(events, entity, ts).select(entity, ts, "prior_count")
    ranked = ordered(events.select(entity, key, ts, *columns), [entity], [ts, key], rank="_i")
    asked = events.select(key, entity, ts).join(prior, [entity, ts]).where("prior_count > 0")
    asked = asked.withColumn("_i", F.floor(hashed_unit(seed, key) * F.col("prior_count")) + 1).select(key, entity, "_i")
    got = asked.join(ranked.select(entity, "_i", *columns), [entity, "_i"]).select(key, *columns)
    return events.select(key).join(got, key, "left")


def class_probabilities(df: DataFrame, by: Sequence[str], column: str, classes: Sequence[str], smoothing: float, base: DataFrame | None = None) -> DataFrame:
    """(by, n, probs array): (count + s * global) / (n + s) in class order."""
    place = F.array(*[F.lit(c) for c in classes])
    c = F.col(column).cast("string")
    count = [F.count_if(c == k).cast("double").alias(f"c{i}") for i, k in enumerate(classes)]
    one = df.agg(*count).first()
    total = sum(one) or 1.0
    share = [v / total for v in one]
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *count)
    probs = F.array(*[(F.col(f"c{i}") + smoothing * share[i]) / (F.col("n") + smoothing) for i in range(len(classes))])
    return g.select(*by, "n", probs.alias("probs"))


def pick_class(probs, u: Column, classes: Sequence[str]) -> Column:
    """Class whose cumulative probability first reaches u."""
    p = F.col(probs) if isinstance(probs, str) else probs
    names = F.array(*[F.lit(c) for c in classes])
    cum = F.transform(p, lambda _, i: array_sum(F.slice(p, F.lit(1), i + 1)))
    return F.element_at(names, F.least(F.size(F.filter(cum, lambda c: c < u * array_sum(p))) + 1, F.lit(len(classes))))


def user_item_mixture(spine: DataFrame, train: DataFrame, user: str, item: str, column: str, classes: Sequence[str], smoothing: float = 5.0) -> DataFrame:
    """Spine with `probs`: user, item and global shares weighted n/(n+s), n/(n+s) and 1."""
    u = class_probabilities(train, [user], column, classes, 0.0).select(user, F.col("n").alias("_un"), F.col("probs").alias("_up"))
    i = class_probabilities(train, [item], column, classes, 0.0).select(item, F.col("n").alias("_in"), F.col("probs").alias("_ip"))
    g = class_probabilities(train.withColumn("_all", F.lit(1)), ["_all"], column, classes, 0.0).first()["probs"]
    out = spine.join(u, user, "left").join(i, item, "left")
    wu, wi = (F.coalesce(F.col(c) / (F.col(c) + smoothing), F.lit(0.0)) for c in ("_un", "_in"))
    zero = F.array(*[F.lit(0.0)] * len(classes))
    mixed = F.zip_with(F.zip_with(F.coalesce("_up", zero), F.coalesce("_ip", zero), lambda a, b: wu * a + wi * b), F.array(*[F.lit(float(v)) for v in g]), lambda a, b: a + b)
    scaled = F.transform(mixed, lambda v: v / (wu + wi + 1))
    return out.withColumn("probs", scaled).drop("_un", "_in", "_up", "_ip")


def base_logits(prior_probs, effects: Sequence[tuple], length: int) -> Column:
    """Log prior plus weighted effect arrays (absent ones count 0)."""
    out = log_clip(prior_probs, 1e-8)
    zero = F.array(*[F.lit(0.0)] * length)
    for weight, e in effects:
        col = F.coalesce(F.col(e) if isinstance(e, str) else e, zero)
        out = F.zip_with(out, _scaled(col, weight), lambda a, b: a + b)
    return out


def _scaled(a: Column, weight: float) -> Column:
    return F.transform(a, lambda v: v * float(weight))


def calibrate_to_targets(rows: DataFrame, group: str, logits: str, target: DataFrame, strength: float = 1.0) -> DataFrame:
    """Shift the logits of every time group by strength * (log target - log mean probability). `target` is (group, target array)."""
    p = rows.withColumn("_p", softmax(logits))
    mean = p.select(group, F.posexplode("_p").alias("i", "v")).groupBy(group, "i").agg(F.avg("v").alias("m"))
    packed = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_mean"))
    shift = packed.join(target, group, "left").select(group, F.zip_with(
        log_clip(F.coalesce("target", "_mean"), 1e-8), log_clip("_mean", 1e-8), lambda a, b: strength * (a - b)).alias("_shift"))
    out = rows.join(shift, group)
    return out.withColumn("calibrated", F.zip_with(logits, "_shift", lambda a, b: a + b)).drop("_shift")


def gumbel_class(logits, key: str, classes: Sequence[str], seed: int = 42) -> Column:
    """Class by the largest logit plus Gumbel noise of a hashed uniform."""
    l = F.col(logits) if isinstance(logits, str) else logits
    names = F.array(*[F.lit(c) for c in classes])
    noisy = F.transform(l, lambda v, i: F.struct((v - F.ln(-F.ln(hashed_unit(seed, F.col(key), i)))).alias("s"), i.alias("i")))
    return F.element_at(names, F.array_max(noisy)["i"] + 1)


def calibration_curve(rows: DataFrame, group: str, before: str, after: str, values: Sequence[float]) -> DataFrame:
    """(group, n, mean_before, mean_after, shift_norm): expected value of the class before and after calibration."""
    v = F.array(*[F.lit(float(x)) for x in values])

    def expected(l: str) -> Column:
        return array_sum(F.zip_with(softmax(l), v, lambda p, x: p * x))

    gap = F.zip_with(after, before, lambda a, b: (a - b) * (a - b))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(expected(before)).alias("mean_before"), F.avg(expected(after)).alias("mean_after"),
                                   F.avg(F.sqrt(array_sum(gap))).alias("shift_norm"))


def sample_effects(entities: DataFrame, key: str, block: str, degree_bin: str, cells: DataFrame, scale: float = 1.0, seed: int = 42) -> DataFrame:
    """(key, x, y, cell_used): normal effects of the entity's cell, falling back to block, degree bin, global."""
    vals = ["mean_x", "mean_y", "cov_xx", "cov_xy", "cov_yy"]
    out = entities
    levels = [("cell", [block, degree_bin]), ("block", [block]), ("degree_bin", [degree_bin])]
    for name, keys in levels:
        side = cells.where(F.col("level") == name).select(
            *[F.col("block" if k == block else "degree_bin").alias(k) for k in keys], F.struct(*vals).alias(f"_{name}"))
        out = out.join(side, keys, "left")
    g = cells.where(F.col("level") == "global").select(*vals).first()
    used = F.when(F.col("_cell").isNotNull(), "cell").when(F.col("_block").isNotNull(), "block").when(F.col("_degree_bin").isNotNull(), "degree_bin").otherwise("global")
    c = F.coalesce("_cell", "_block", "_degree_bin", F.struct(*[F.lit(g[v]).alias(v) for v in vals]))
    a, b = hashed_normal(f"{seed}x", key), hashed_normal(f"{seed}y", key)
    lx = F.sqrt(c["cov_xx"])
    cross = c["cov_xy"] / lx
    ly = F.sqrt(F.greatest(c["cov_yy"] - cross * cross, F.lit(0.0)))
    return out.select(key, (scale * (c["mean_x"] + lx * a)).alias("x"), (scale * (c["mean_y"] + cross * a + ly * b)).alias("y"), used.alias("cell_used"))


def random_parents(children: DataFrame, key: str, parents: DataFrame, parent: str, seed: int = 42) -> DataFrame:
    """(key, parent): each child a parent with replacement, by hashed position."""
    p = numbered(parents.select(parent).distinct(), [parent], "_i")
    n = p.count()
    return children.select(key).withColumn("_i", F.floor(hashed_unit(seed, key) * n) + 1).join(p, "_i").select(key, parent)


def interpolate_rows(neighbors: DataFrame, key: str, numbers: Sequence[str], categories: Sequence[str], seed: int = 42) -> DataFrame:
    """New rows between a row and its neighbor (columns prefixed nb_): numbers on the segment, categories from the nearer end."""
    u = hashed_unit(seed, key)
    out = [(F.col(c) + u * (F.col(f"nb_{c}") - F.col(c))).alias(c) for c in numbers]
    out += [F.when(u < 0.5, F.col(c)).otherwise(F.col(f"nb_{c}")).alias(c) for c in categories]
    return neighbors.select(key, *out)


# --- texts --------------------------------------------------------------------------------------


def bootstrap_texts(spine: DataFrame, key: str, train: DataFrame, tie: str, text: str, seed: int = 42) -> DataFrame:
    return donor_values(spine, key, train, tie, [text], seed=seed)


def template_texts(spine: DataFrame, key: str, rating: str, templates: Mapping[str, str], default: str) -> DataFrame:
    """One fixed text per rating."""
    lookup = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])[F.col(rating).cast("string")]
    return spine.select(key, F.coalesce(lookup, F.lit(default)).alias("text"))


def unigram_texts(spine: DataFrame, key: str, rating: str, train: DataFrame, text: str, low: int = 2, high: int = 8, seed: int = 42) -> DataFrame:
    """Texts of 2..8 tokens drawn from the token counts of texts with the same rating."""
    from chronoweave.operators.spine_generation import pick_by_weight

    tokens = train.select(rating, F.explode(tx.tokens(text)).alias("token")).groupBy(rating, "token").agg(F.count(F.lit(1)).alias("n"))
    n = low + F.floor(hashed_unit(f"{seed}n", key) * (high - low + 1))
    draws = spine.select(key, rating, F.explode(F.sequence(F.lit(1), n)).alias("at")).withColumn("_u", hashed_unit(f"{seed}t", key, "at"))
    got = pick_by_weight(draws, "_u", tokens, "n", ["token"], [rating], ["token"])
    # at most `high` tokens per text
    return got.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda s: s["token"]), " ").alias("text"))


def block_exact_copies(df: DataFrame, key: str, text: str, train: DataFrame, train_text: str) -> DataFrame:
    """(key, text, attempts, resolved): texts equal to a training text get suffixes until they are free."""
    seen = train.select(tx.private_form(train_text).alias("_p")).distinct()
    current = df.select(key, F.col(text).alias("text")).withColumn("attempts", F.lit(0))
    done = []
    for i in range(len(tx.SUFFIXES) + 1):
        formed = current.withColumn("_p", tx.private_form("text"))
        done.append(formed.join(seen, "_p", "left_anti").select(key, "text", "attempts", F.lit(True).alias("resolved")))
        clash = formed.join(seen, "_p", "left_semi")
        if i == len(tx.SUFFIXES):
            done.append(clash.select(key, "text", "attempts", F.lit(False).alias("resolved")))
            break
        current = materialize(clash.select(key, F.trim(F.concat(F.trim("text"), F.lit(f" {tx.SUFFIXES[i]}"))).alias("text"), (F.col("attempts") + 1).alias("attempts")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def replace_copies(df: DataFrame, key: str, text: str, train: DataFrame, train_text: str, seed: int = 42) -> DataFrame:
    """(key, text, replaced): copied texts become another generated, non-training text of the same length bucket."""
    seen = train.select(tx.private_form(train_text).alias("_p")).distinct()
    g = materialize(df.select(key, F.col(text).alias("text"), tx.copy_length_bucket(tx.word_length(text)).alias("bucket"), tx.private_form(text).alias("_p")))
    clean = g.join(seen, "_p", "left_anti")
    copies = g.join(seen, "_p", "left_semi")
    pool = clean.groupBy("bucket", "_p").agg(F.min_by("text", key).alias("text"))
    pool = ordered(pool, ["bucket"], ["_p"], rank="_i")
    size = pool.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    asked = copies.select(key, "bucket", F.col("text").alias("_old")).join(size, "bucket", "left").withColumn("_i", F.floor(hashed_unit(seed, key) * F.col("_n")) + 1)
    swapped = asked.join(pool.select("bucket", "_i", "text"), ["bucket", "_i"], "left")
    return clean.select(key, "text", F.lit(False).alias("replaced")).unionByName(
        swapped.select(key, F.coalesce("text", "_old").alias("text"), F.col("text").isNotNull().alias("replaced")))


def length_targets(df: DataFrame, key: str, train: DataFrame, tie: str, length: str, bucket: str | None = None, buckets: Mapping[str, tuple[int, int]] | None = None, seed: int = 42) -> DataFrame:
    """(key, target): a training length by hashed position, or uniform inside the row's own length bucket."""
    if bucket is None:
        return donor_values(df, key, train, tie, [length], seed=seed).select(key, F.col(length).alias("target"))
    low, high = (F.create_map(*[F.lit(x) for k, v in buckets.items() for x in (k, v[i])])[F.col(bucket)] for i in (0, 1))
    return df.select(key, (F.floor(hashed_unit(seed, key) * (high - low + 1)) + low).cast("long").alias("target"))


# --- corruption tables --------------------------------------------------------------------------


def mask_probability(t, schedule: str) -> Column:
    """Share of cells masked at step t in [0, 1]."""
    t = F.col(t) if isinstance(t, str) else t
    if schedule == "linear":
        return t
    if schedule == "cosine":
        return 1 - F.cos(t * (3.141592653589793 / 2))
    raise ValueError(f"unknown schedule: {schedule}")


def masked_cells(df: DataFrame, key: str, columns: Sequence[str], steps: int, schedule: str, mask: str = "[MASK]", seed: int = 42) -> DataFrame:
    """Rows with a drawn step, each category masked with the step's probability and kept as a label."""
    t = (F.floor(hashed_unit(f"{seed}s", key) * steps) + 1) / F.lit(float(steps))
    out = df.select(key, *columns).withColumn("step", t)
    p = mask_probability("step", schedule)
    cells = {}
    for c in columns:
        hit = hashed_unit(f"{seed}{c}", key) < p
        cells[f"{c}_input"] = F.when(hit, F.lit(mask)).otherwise(F.col(c).cast("string"))
        cells[f"{c}_label"] = F.when(hit, F.col(c).cast("string"))
    return out.withColumns(cells).drop(*columns)
