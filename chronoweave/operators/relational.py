"""Relational tables as graphs: dense ids, edges, bridge tables, components, and back to tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.kernels import materialize, numbered, ordered
from chronoweave.operators.spine_generation import expand


@dataclass(frozen=True)
class Relationship:
    parent: str
    child: str
    parent_key: str
    child_key: str


def relationship_table(spark, relationships: Sequence[Relationship]) -> DataFrame:
    return spark.createDataFrame([(r.parent, r.child, r.parent_key, r.child_key) for r in relationships],
                                 "parent string, child string, parent_key string, child_key string")


def find_foreign_key(columns: Sequence[str], parent: str, declared: Mapping[str, str], parent_key: str | None, fallbacks: Sequence[str]) -> str:
    """Declared parent of a column first, then the parent's key name, then the fallback names."""
    for column, target in declared.items():
        if target == parent and column in columns:
            return column
    for name in (parent_key, *fallbacks):
        if name is not None and name in columns:
            return name
    raise ValueError(f"no foreign key to {parent} among {list(columns)}")


def dense_ids(df: DataFrame, key: str, out: str = "node") -> DataFrame:
    """(key, node): distinct keys numbered 0..n-1 in key order."""
    return numbered(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], "_i").select(key, (F.col("_i") - 1).alias(out))


def edge_table(child: DataFrame, child_ids: DataFrame, child_key: str, foreign_key: str, parent_ids: DataFrame, parent_key: str) -> DataFrame:
    """(child, parent) dense edges; a key outside the parent's domain raises."""
    c = child.where(F.col(foreign_key).isNotNull()).select(child_key, foreign_key)
    p = parent_ids.select(F.col(parent_key).alias(foreign_key), F.col("node").alias("parent"))
    if not c.join(p, foreign_key, "left_anti").limit(1).isEmpty():
        raise ValueError(f"{foreign_key} has values outside its parent")
    return c.join(p, foreign_key).join(child_ids.select(child_key, F.col("node").alias("child")), child_key).select("child", "parent")


def collapse_bridge(bridge: DataFrame, first: str, second: str) -> DataFrame:
    """A table of two foreign keys and nothing else becomes typed parent-parent edges."""
    return bridge.select(F.col(first).alias("src"), F.col(second).alias("dst"))


def restore_bridge(edges: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """Edges back to a table with its own key 0..n-1."""
    return numbered(edges, ["src", "dst"], "_i").select((F.col("_i") - 1).alias(key), F.col("src").alias(first), F.col("dst").alias(second))


def trim_stubs(child: DataFrame, parent_key: str) -> DataFrame:
    """A single-parent child table reduced to a count per parent."""
    return child.groupBy(parent_key).agg(F.count(F.lit(1)).alias("children"))


def regrow_stubs(counts: DataFrame, parent_key: str, key: str) -> DataFrame:
    """The count per parent back to child rows with new keys."""
    rows = expand(counts.select(parent_key, "children"), "children", "place")
    return numbered(rows.select(parent_key, "place"), [parent_key, "place"], "_i").select((F.col("_i") - 1).alias(key), parent_key, "place")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node label over undirected edges `src`, `dst`.

    Large-star and small-star steps shrink every chain geometrically; each round is written out, so
    lineage stays flat. Neighborhoods are reduced by a minimum, never collected.
    """
    e = edges.select(F.col("src").cast("string"), F.col("dst").cast("string")).where("src <> dst")
    nodes = edges.select(F.col("src").cast("string").alias("node")).union(edges.select(F.col("dst").cast("string"))).distinct()
    current = materialize(e.distinct())
    while True:  # every round lowers labels, so it ends
        both = current.union(current.select("dst", "src"))
        # large star: neighbors larger than u link to the smallest label around u
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.join(low, "src").where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        # small star: u and its smaller neighbors link to the smallest of them
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        lowest = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(lowest, "src").select(F.col("dst").alias("a"), "m").where("a <> m").select(F.col("a").alias("src"), F.col("m").alias("dst"))
        small = small.union(lowest.select("src", F.col("m").alias("dst"))).distinct()
        after = materialize(small)
        changed = after.count() != current.count() or not after.join(current, ["src", "dst"], "left_anti").limit(1).isEmpty()
        current = after
        if not changed:
            break
    labels = current.groupBy("src").agg(F.min("dst").alias("component"))
    return nodes.join(labels.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def aligned_occurrences(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows joined one to one on keys plus the n-th occurrence of a repeated key; an unmatched row raises."""
    a = ordered(left, list(keys), list(left_order), rank="_n")
    b = ordered(right, list(keys), list(right_order), rank="_n")
    on = [*keys, "_n"]
    if not a.join(b, on, "left_anti").limit(1).isEmpty() or not b.join(a, on, "left_anti").limit(1).isEmpty():
        raise ValueError("rows without a partner")
    return a.join(b, on).drop("_n")


def graph_to_tables(children: DataFrame, parent: str, offset_key: str, pattern: Sequence[str]) -> DataFrame:
    """Generated edges to a child table: keys from 0 in (parent, child) order and a repeating pattern per parent."""
    ranked = ordered(children, [parent], ["child"], rank="_p")
    out = numbered(ranked, [parent, "child"], "_i")
    steps = F.array(*[F.lit(p) for p in pattern])
    return out.select((F.col("_i") - 1).alias(offset_key), parent, F.element_at(steps, (F.pmod(F.col("_p") - 1, F.lit(len(pattern))) + 1).cast("int")).alias("step"))
