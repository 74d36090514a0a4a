"""Interaction sources: raw public log formats to one canonical event table, and the subset built from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import cleaning as cl
from chronoweave.functions.kernels import materialize
from chronoweave.operators import counts as ct
from chronoweave.operators import profiles as pf
from chronoweave.operators import splits as sl
from chronoweave.operators.two_sample import metric_rows, stack_reports
from chronoweave.sources.tables import filter_entities, read_table, with_file_row_number, write_table

# The closed set of semantic types.
SEMANTIC_TYPES = ("categorical", "ordinal_categorical", "boolean", "continuous_numerical", "count_numerical", "text", "datetime", "foreign_key")


@dataclass(frozen=True)
class SourceRoles:
    """Names and semantic types of one interaction source."""

    name: str
    event_id: str
    source_id: str
    destination_id: str
    timestamp: str
    attributes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        bad = sorted(set(self.attributes.values()) - set(SEMANTIC_TYPES))
        if bad:
            raise ValueError(f"unknown semantic types: {bad}")

    @property
    def columns(self) -> list[str]:
        return [self.event_id, self.source_id, self.destination_id, self.timestamp, *self.attributes]


class InteractionSource:
    """Extension point: subclasses name their roles and return DataFrames."""

    roles: SourceRoles

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def interactions(self) -> DataFrame:
        raise NotImplementedError

    def source_ids(self) -> DataFrame:
        """Only the id column; the scan is pruned to it."""
        return self.interactions().select(self.roles.source_id)

    def entities(self, ids: DataFrame, side: str) -> DataFrame:
        """Entity rows for used ids; by default just the ids."""
        key = self.roles.source_id if side == "source" else self.roles.destination_id
        return ids.select(key).distinct()

    def audit(self) -> DataFrame | None:
        return None


REGISTRY: dict[str, type[InteractionSource]] = {}


def register(cls: type[InteractionSource]) -> type[InteractionSource]:
    REGISTRY[cls.roles.name] = cls
    return cls


def source_by_name(name: str, spark: SparkSession, root: str) -> InteractionSource:
    if name not in REGISTRY:
        raise ValueError(f"unknown source {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](spark, root)


@register
class MovieRatings(InteractionSource):
    roles = SourceRoles("movielens", "event_id", "user_id", "movie_id", "event_time", {"rating": "ordinal_categorical"})

    def interactions(self) -> DataFrame:
        raw = read_table(self.spark, f"{self.root}/ratings.csv", "userId string, movieId string, rating string, timestamp long")
        n = with_file_row_number(raw)
        return n.select(F.concat(F.lit("ml-rating-"), F.col("raw_row_number").cast("string")).alias("event_id"), F.col("userId").alias("user_id"),
                        F.col("movieId").alias("movie_id"), F.timestamp_seconds("timestamp").alias("event_time"), "rating")

    def source_ids(self) -> DataFrame:
        raw = read_table(self.spark, f"{self.root}/ratings.csv", "userId string, movieId string, rating string, timestamp long")
        return raw.select(F.col("userId").alias("user_id"))

    def entities(self, ids: DataFrame, side: str) -> DataFrame:
        if side == "source":
            return super().entities(ids, side)
        movies = read_table(self.spark, f"{self.root}/movies.csv", "movieId string, title string, genres string").withColumnRenamed("movieId", "movie_id")
        return filter_entities(movies, "movie_id", ids)


@register
class BusinessReviews(InteractionSource):
    roles = SourceRoles("yelp", "event_id", "user_id", "business_id", "event_time", {
        "stars": "ordinal_categorical", "useful": "count_numerical", "funny": "count_numerical", "cool": "count_numerical", "text": "text"})

    def interactions(self) -> DataFrame:
        raw = read_table(self.spark, f"{self.root}/review.json", "review_id string, user_id string, business_id string, date string, stars double, useful long, funny long, cool long, text string")
        counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("useful", "funny", "cool")]
        return raw.select(F.col("review_id").alias("event_id"), "user_id", "business_id", cl.moment("date").alias("event_time"), F.col("stars").cast("string").alias("stars"),
                          *counts, F.coalesce("text", F.lit("")).alias("text"))


@register
class ShopEvents(InteractionSource):
    roles = SourceRoles("retailrocket", "event_id", "visitor_id", "item_id", "event_time", {"event": "categorical"})
    EVENTS = ("view", "addtocart", "transaction")

    def _raw(self) -> DataFrame:
        raw = read_table(self.spark, f"{self.root}/events.csv", "timestamp long, visitorid string, event string, itemid string, transactionid string")
        name = F.lower(F.trim("event"))
        known = F.when(name.isin(*self.EVENTS), name).otherwise(F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce("event", F.lit("null")))).cast("string"))
        return with_file_row_number(raw).select(F.concat(F.lit("rr-event-"), F.col("raw_row_number").cast("string")).alias("event_id"), F.col("visitorid").alias("visitor_id"),
                                                F.col("itemid").alias("item_id"), F.timestamp_millis("timestamp").alias("event_time"), known.alias("event"), F.col("transactionid").alias("audit_transaction_id"))

    def interactions(self) -> DataFrame:
        return self._raw().drop("audit_transaction_id")

    def audit(self) -> DataFrame:
        return self._raw().select("event_id", "audit_transaction_id")

    def properties(self, destination_ids: DataFrame) -> DataFrame:
        """Both property parts, limited to the chosen items."""
        schema = "timestamp long, itemid string, property string, value string"
        parts = [read_table(self.spark, f"{self.root}/item_properties_part{i}.csv", schema) for i in (1, 2)]
        return parts[0].unionByName(parts[1]).withColumnRenamed("itemid", "item_id").join(destination_ids.select("item_id").distinct(), "item_id", "left_semi")

    def category_tree(self) -> DataFrame:
        return read_table(self.spark, f"{self.root}/category_tree.csv", "categoryid string, parentid string")


@register
class FashionTransactions(InteractionSource):
    roles = SourceRoles("hm", "event_id", "customer_id", "article_id", "event_time", {"price": "continuous_numerical", "sales_channel_id": "categorical"})

    def interactions(self) -> DataFrame:
        raw = read_table(self.spark, f"{self.root}/transactions_train.csv", "t_dat string, customer_id string, article_id string, price string, sales_channel_id string")
        return with_file_row_number(raw).select(F.concat(F.lit("hm-transaction-"), F.col("raw_row_number").cast("string")).alias("event_id"), "customer_id", "article_id",
                                                F.date_trunc("day", cl.moment("t_dat")).alias("event_time"), cl.number("price").alias("price"), "sales_channel_id")


# --- subset -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Subset:
    interactions: DataFrame
    sources: DataFrame
    destinations: DataFrame
    statistics: DataFrame
    validation: DataFrame


def build_subset(source: InteractionSource, target: int, seed: int = 42) -> Subset:
    """Sources with whole histories up to the target size, their events with a chronological split, entities, report."""
    r = source.roles
    full = source.source_ids().groupBy(r.source_id).agg(F.count(F.lit(1)).alias("n"))
    full = materialize(full)
    chosen = sl.select_sources(full, r.source_id, target, seed)
    events = materialize(sl.chronological_split(source.interactions().join(chosen.select(r.source_id), r.source_id, "left_semi"), r.timestamp, r.event_id))
    return Subset(events, source.entities(events, "source"), source.entities(events, "destination"), subset_statistics(events, r, full), subset_validation(events, r, full, source))


def subset_statistics(events: DataFrame, r: SourceRoles, full: DataFrame) -> DataFrame:
    """(metric, value): size, spans, degree summaries of both roles, pair repetition, full counts."""
    one = events.agg(F.count(F.lit(1)).alias("interactions"), F.min(F.unix_date(F.to_date(r.timestamp))).alias("first_day"), F.max(F.unix_date(F.to_date(r.timestamp))).alias("last_day"))
    pairs = ct.repeated_pair_statistics(events, [r.source_id, r.destination_id])
    whole = full.agg(F.count(F.lit(1)).alias("full_sources"), F.sum("n").alias("full_interactions"))
    named = [ct.degree_summary(events, c).select(F.concat(F.lit(f"{n}_degree_"), "metric").alias("metric"), "value") for n, c in (("source", r.source_id), ("destination", r.destination_id))]
    return stack_reports(metric_rows(one, one.columns), *named, metric_rows(pairs, {"unique_pairs": F.col("pairs"), "repeated_pair_rate": F.col("surplus_rate")}), metric_rows(whole, whole.columns))


def subset_validation(events: DataFrame, r: SourceRoles, full: DataFrame, source: InteractionSource) -> DataFrame:
    """(check, bad): duplicate ids, missing times, missing splits, incomplete histories, keys without an entity."""
    keys = pf.primary_key_report(events, [r.event_id])
    times = events.agg(F.count_if(F.col(r.timestamp).isNull()).alias("bad_times"), (3 - F.count_distinct("split")).alias("missing_splits"))
    have = events.groupBy(r.source_id).agg(F.count(F.lit(1)).alias("have")).join(full, r.source_id).agg(F.count_if(F.col("have") != F.col("n")).alias("incomplete_histories"))
    parts = [metric_rows(keys, {"duplicate_ids": F.col("duplicate_rows"), "null_ids": F.col("null_rows")}), metric_rows(times, times.columns), metric_rows(have, have.columns)]
    for n, key, side in (("source", r.source_id, "source"), ("destination", r.destination_id, "destination")):
        fk = pf.foreign_key_report(events, source.entities(events, side), key, key)
        parts.append(metric_rows(fk, {f"{n}_orphans": F.col("invalid")}))
    return stack_reports(*parts).select(F.col("metric").alias("check"), F.col("value").cast("long").alias("bad"))


TABLES = {"interactions": "interactions.parquet", "sources": "sources.parquet", "destinations": "destinations.parquet", "statistics": "statistics.json", "validation": "validation.json"}


def write_subset(subset: Subset, root: str, mode: str = "error", target: int | None = None, tolerance: float = 0.05) -> None:
    """Interactions by split, both entity tables, the two reports as JSON lines, and last the manifest.

    The manifest has one line a table: file, schema, rows and a digest of the content as read back; for the interactions also
    the target, how far the subset is from it, and whether that is within the tolerance. A subset without a manifest was not
    finished and read_subset() does not take it.
    """
    for name, file in TABLES.items():
        write_table(getattr(subset, name), f"{root}/{file}", ["split"] if name == "interactions" else (), mode)
    spark, lines = subset.interactions.sparkSession, []
    for name, file in TABLES.items():
        rows, digest, schema = _content(spark, f"{root}/{file}", _listed(getattr(subset, name)))
        aim = target if name == "interactions" else None
        away = None if aim is None else rows - aim
        lines.append((name, file, schema, rows, digest, aim, away, None if aim is None else abs(away) <= tolerance * max(aim, 1)))
    manifest = spark.createDataFrame(lines, "table string, file string, schema string, rows long, digest string, target long, deviation long, within_tolerance boolean")
    write_table(manifest, f"{root}/manifest.json", mode=mode)


def _listed(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in sorted(df.dtypes))


def _content(spark: SparkSession, path: str, schema: str) -> tuple[int, str, str]:
    """(rows, digest, schema) of a written table; the digest does not depend on the order of rows or files."""
    df = read_table(spark, path, schema if path.endswith(".json") else None)
    names = sorted(df.columns)
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in names])
    n, mixed, total = df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(row), F.lit(0)), F.coalesce(F.sum(F.pmod(row, F.lit(1_000_003))), F.lit(0))).first()
    return n, f"{mixed & (2**64 - 1):016x}-{total}", _listed(df)


def read_subset(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a finished subset by name. It raises where the manifest is missing or a table is not what it says."""
    schema = "table string, file string, schema string, rows long, digest string, target long, deviation long, within_tolerance boolean"
    lines = spark.read.schema(schema).json(f"{root}/manifest.json").collect()  # one line a table
    if {r["table"] for r in lines} != set(TABLES):
        raise ValueError(f"no whole manifest under {root}")
    for r in lines:
        if _content(spark, f"{root}/{r['file']}", r["schema"]) != (r["rows"], r["digest"], r["schema"]):
            raise ValueError(f"{r['file']} is not what the manifest says")
    return {r["table"]: read_table(spark, f"{root}/{r['file']}", r["schema"] if r["file"].endswith(".json") else None) for r in lines}
