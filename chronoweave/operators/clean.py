"""Whole-table cleaning: role casts, imputation, date arithmetic, encodings and their inverses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import cleaning as cl
from chronoweave.functions import text as tx
from chronoweave.functions.kernels import numbered, rate

MISSING_CATEGORY = "?"
MICROS_PER_DAY = 86_400_000_000


@dataclass(frozen=True)
class Roles:
    """Which columns play which part in a table."""

    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[str, ...] = ()
    datetimes: tuple[str, ...] = ()
    categoricals: tuple[str, ...] = ()
    numericals: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    rules: Mapping[str, cl.CategoryRule] = field(default_factory=dict)

    @property
    def required(self) -> tuple[str, ...]:
        return (*self.foreign_keys, *self.datetimes, *self.categoricals, *self.numericals, *self.texts)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def normalize_frame(df: DataFrame, roles: Roles) -> DataFrame:
    """Cast every role; rows whose time or number does not parse are dropped. Null ids and categories read 'nan'."""
    require_columns(df, roles.required)
    cast: dict[str, Column] = {}
    for c in (*roles.foreign_keys, *roles.categoricals):
        cast[c] = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    for c in roles.datetimes:
        cast[c] = cl.moment(c)
    for c in roles.numericals:
        cast[c] = cl.number(c)
    for c in roles.texts:
        cast[c] = tx.squeeze(c)
    return df.withColumns(cast).dropna(subset=[*roles.datetimes, *roles.numericals])


def day_or_month(df: DataFrame, ts: str, grain: str) -> DataFrame:
    """Add `bucket`; unparsable times fall on the earliest valid one, or 1970-01-01 when there is none."""
    t = cl.moment(ts)
    earliest = df.agg(F.date_format(F.min(t), "yyyy-MM-dd HH:mm:ss")).first()[0] or "1970-01-01 00:00:00"
    return df.withColumn("bucket", F.date_format(F.coalesce(t, F.lit(earliest).cast("timestamp")),
                                                 "yyyy-MM-dd" if grain == "day" else "yyyy-MM"))


def granularity(df: DataFrame, ts: str) -> DataFrame:
    """Midnight share, distinct second offsets, and the mode they imply."""
    second = F.floor(F.pmod(F.unix_micros(ts), F.lit(MICROS_PER_DAY)) / 1_000_000)
    # offsets are whole seconds of a day, so there are at most 86,400 groups
    offsets = df.where(F.col(ts).isNotNull()).groupBy(second.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    out = offsets.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("offsets"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("s") == 0, F.col("n"))), F.sum("n")), F.lit(0.0)).alias("midnight_share"),
    )
    mode = F.when(F.col("midnight_share") >= 0.99, "date_only").when(
        F.col("offsets") <= F.greatest(F.lit(24), F.floor(F.col("rows") * 0.01)), "empirical_offsets")
    return out.withColumn("mode", mode.otherwise("continuous_time_of_day"))


def normalized_time(df: DataFrame, ts: str, reference: DataFrame, out: str, flat: float | None = None) -> DataFrame:
    """Position of a time in the reference range. A range of no length gives `flat`, or divides by 1 ns."""
    lo, hi = reference.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    if lo is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    if hi == lo and flat is not None:
        return df.withColumn(out, F.when(F.col(ts).isNotNull(), F.lit(float(flat))))
    return df.withColumn(out, (F.unix_micros(ts) - F.lit(lo)) / F.lit(max(float(hi - lo), 1e-3)))


def valid_events(df: DataFrame, ts: str, parents: Mapping[str, DataFrame]) -> DataFrame:
    """Events with a time and with every id present in its parent table (same column name); empty raises."""
    out = df.dropna(subset=[ts, *parents])
    for key, parent in parents.items():
        out = out.join(parent.select(key).distinct(), key, "left_semi")
    if out.isEmpty():
        raise ValueError("no valid events left")
    return out


def with_text(df: DataFrame, text: str) -> DataFrame:
    """Normalize the text and drop rows where nothing is left."""
    return df.withColumn(text, tx.squeeze(text)).where(F.length(text) > 0)


def column_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Per column: non-null rows, nulls, minimum, maximum, mean of numbers. One pass, no distinct."""
    types = dict(df.dtypes)
    numeric = {c for c in columns if types[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or types[c].startswith("decimal")}
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(F.col(c).isNull()).alias(f"z{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        aggs += [F.avg(c).alias(f"m{i}")] if c in numeric else []
    row = df.agg(*aggs).first().asDict()
    return {c: {"rows": row[f"n{i}"], "nulls": row[f"z{i}"], "min": row[f"lo{i}"], "max": row[f"hi{i}"], "mean": row.get(f"m{i}")}
            for i, c in enumerate(columns)}


@dataclass(frozen=True)
class Imputation:
    constants: dict
    filled: tuple[str, ...]
    fills: dict


def impute(df: DataFrame, categoricals: Sequence[str], numericals: Sequence[str]) -> tuple[DataFrame, Imputation]:
    """Categories: null to '?'. Numbers: mean fill with a `<col>_missing` flag. One-valued columns are set aside.

    One value means minimum equals maximum, so no distinct count is needed.
    """
    marked = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY)) for c in categoricals})
    seen = column_ranges(marked, [*categoricals, *numericals])
    constants = {c: s["min"] for c, s in seen.items() if s["rows"] and s["min"] == s["max"]}
    out = marked.drop(*constants)
    filled = tuple(c for c in numericals if c not in constants and seen[c]["nulls"])
    for c in filled:
        out = out.withColumn(f"{c}_missing", F.col(c).isNull().cast("int"))
    fills = {c: seen[c]["mean"] for c in filled}
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()})
    return out, Imputation(constants, filled, fills)


def restore(df: DataFrame, imputation: Imputation, categoricals: Sequence[str], decimals: Mapping[str, int]) -> DataFrame:
    """Inverse of `impute`: nulls come back, constants return, numbers get their learned decimals."""
    back: dict[str, Column] = {c: F.when(F.col(f"{c}_missing") == 0, F.col(c)) for c in imputation.filled}
    out = df.withColumns(back).drop(*[f"{c}_missing" for c in imputation.filled])
    out = out.withColumns({c: F.round(c, d) for c, d in decimals.items() if c in out.columns})
    out = out.withColumns({c: F.lit(v) for c, v in imputation.constants.items()})
    return out.withColumns({c: F.when(F.col(c) != MISSING_CATEGORY, F.col(c)) for c in categoricals if c in out.columns})


@dataclass(frozen=True)
class DateEncoding:
    """Order of the time columns, the first day, and which columns carry a clock time."""

    order: tuple[str, ...]
    first_day: int
    timed: tuple[str, ...]


def encode_dates(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DateEncoding]:
    """Days since the first midnight, chained: each column counts from the one before it (order of means)."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(F.unix_micros(c)).alias(f"lo{i}"), F.avg(F.unix_micros(c)).alias(f"m{i}"), F.sum(F.hour(c)).alias(f"h{i}")]
    row = df.agg(*aggs).first()
    first_day = min(row[f"lo{i}"] for i in range(len(columns))) // MICROS_PER_DAY
    order = tuple(sorted(columns, key=lambda c: row[f"m{list(columns).index(c)}"]))
    timed = tuple(c for i, c in enumerate(columns) if (row[f"h{i}"] or 0) > 0)
    day = {c: F.floor(F.unix_micros(c) / MICROS_PER_DAY) - first_day for c in columns}
    cast: dict[str, Column] = {}
    for i, c in enumerate(order):
        cast[f"{c}_date"] = day[c] if i == 0 else day[c] - day[order[i - 1]]
        if c in timed:
            cast[f"{c}_time"] = F.floor(F.pmod(F.unix_micros(c), F.lit(MICROS_PER_DAY)) / 1_000_000)
    return df.withColumns(cast).drop(*columns), DateEncoding(order, int(first_day), timed)


def decode_dates(df: DataFrame, enc: DateEncoding) -> DataFrame:
    """Round, add the chained days (and seconds) back."""
    total: Column | None = None
    out: dict[str, Column] = {}
    for c in enc.order:
        step = F.round(f"{c}_date").cast("long")
        total = step if total is None else total + step
        micros = (total + enc.first_day) * MICROS_PER_DAY
        if c in enc.timed:
            micros = micros + F.round(f"{c}_time").cast("long") * 1_000_000
        out[c] = F.timestamp_micros(micros)
    parts = [f"{c}_date" for c in enc.order] + [f"{c}_time" for c in enc.timed]
    return df.withColumns(out).drop(*parts)


def encode_time(df: DataFrame, ts: str, origin_micros: int, out: str) -> DataFrame:
    """Seconds since the training origin."""
    return df.withColumn(out, (F.unix_micros(ts) - origin_micros) / F.lit(1e6))


def decode_time(df: DataFrame, seconds: str, origin_micros: int, out: str) -> DataFrame:
    return df.withColumn(out, F.timestamp_micros(F.round(F.col(seconds) * 1e6).cast("long") + origin_micros))


def outside_training_range(df: DataFrame, ts: str, lo_micros: int, hi_micros: int) -> DataFrame:
    """Share of times before or after the training range; nothing is clipped."""
    t = F.unix_micros(ts)
    return df.agg(rate(t < lo_micros).alias("before"), rate(t > hi_micros).alias("after"))


def repair_categories(df: DataFrame, column: str, valid: Sequence[str], repair: bool) -> DataFrame:
    """Cells outside the domain raise, or become its first value."""
    good = F.coalesce(F.col(column).cast("string").isin(list(valid)), F.lit(False))
    if repair:
        return df.withColumn(column, F.when(good, F.col(column).cast("string")).otherwise(F.lit(valid[0])))
    bad = df.where(~good).select(column).limit(10).collect()
    if bad:
        raise ValueError(f"{column}: values outside the domain, e.g. {[b[0] for b in bad]}")
    return df


def has_duplicates(df: DataFrame, column: str) -> bool:
    """Pandas-style: nulls are not values, so any null also makes the column not all-unique."""
    if not df.where(F.col(column).isNull()).limit(1).isEmpty():
        return True
    return not df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).isEmpty()


def prune_table(df: DataFrame, sdtypes: Mapping[str, str]) -> tuple[DataFrame, bool]:
    """Drop unsupported types, empty times and numeric id-like columns; say whether the table is a dimension."""
    keep, dimension = [], True
    empty_time = {c for c, t in sdtypes.items() if t == "datetime" and df.select(F.count(c)).first()[0] == 0}
    for c, t in sdtypes.items():
        if t not in ("id", "numerical", "categorical", "datetime") or c in empty_time:
            continue
        if t == "numerical" and "id" in c.lower():
            continue
        keep.append(c)
        # times never decide about a dimension
        if t != "datetime" and dimension and has_duplicates(df, c):
            dimension = False
    return df.select(*keep), dimension


def with_event_id(df: DataFrame, columns: Sequence[str], order: Sequence[str], event_id: str = "event_id") -> DataFrame:
    """Keep the configured columns; add 0..n-1 in the given order when the id is missing."""
    kept = require_columns(df, columns).select(*columns)
    if event_id in kept.columns:
        return kept
    return numbered(kept, order, "_n").withColumn(event_id, F.col("_n") - 1).drop("_n")


def canonical_diagnostics(both: DataFrame, column: str, rule: cl.CategoryRule, limit: int = 25) -> DataFrame:
    """Per side: first distinct values before and after canonicalization (text order), and unmapped rows.

    Values are counted before anything is collected into a list, and only `limit` of them are kept.
    """
    c = both.groupBy("is_real", F.col(column).cast("string").alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("canon", cl.category("raw", rule))
    domain = None
    if rule.valid_values is not None:
        lits = c.sparkSession.createDataFrame([(str(v),) for v in rule.valid_values], "v string").select(cl.category("v", rule))
        domain = [x[0] for x in lits.collect()]
    unmapped = F.lit(0) if domain is None else F.sum(F.when(F.col("canon").isNotNull() & ~F.col("canon").isin(domain), F.col("n")).otherwise(0))

    def preview(name: str) -> DataFrame:
        d = c.where(F.col(name).isNotNull()).select("is_real", name).distinct()
        # a window would sort every distinct value; a heap of `limit` per side is enough
        sides = [d.where(F.col("is_real") == F.lit(s)).orderBy(name).limit(limit) for s in (True, False)]
        return sides[0].unionByName(sides[1]).groupBy("is_real").agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias(f"{name}_values"))

    counts = c.groupBy("is_real").agg(unmapped.cast("long").alias("unmapped"))
    return counts.join(preview("raw"), "is_real", "left").join(preview("canon"), "is_real", "left")


def canonical_map(df: DataFrame, column: str, rule: cl.CategoryRule) -> DataFrame:
    """(raw, canonical, n) table."""
    return df.groupBy(F.col(column).cast("string").alias("raw")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "canonical", cl.category("raw", rule))
