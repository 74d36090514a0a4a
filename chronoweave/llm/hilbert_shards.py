"""Shards along a Hilbert curve through several metadata dimensions, for file pruning on any of them.

1. `cells`: every dimension is quantised into 2^bits cells that keep its order and hold about as many rows each; all rows
   of one value lie in one cell. The cuts come from counts of all values; at most 2^bits of them reach the driver.
2. `curve_index`: the position of the cell on the Hilbert curve, by the curve's state machine: at each level, from the
   highest bit down, the bits of all dimensions and the state give the next digit and state.
3. `shards`: rows are put in order of the index by a range sort (ties go by further columns, so a hot cell is spread over
   tasks), numbered, and cut into runs: of equal row counts (law `rows`) or of near equal bytes (law `bytes`).
4. `write_shards` writes the runs as files, `ranges` tells what each shard holds of every dimension, and `shards_to_read`
   uses that to leave out shards that cannot hold a row asked for.

Only built-in DataFrame functions are used. No step gathers a shard, a cell or a group of equal texts into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.kernels import materialize, ordered
from chronoweave.llm.common import fresh_name, query, table, whole_text, without

BITS = 6  # cells per dimension: 2^BITS
SHARDS = 8
DIMENSIONS = ("lang", "source", "size", "doc_id")
LAWS = ("rows", "bytes")


def state_tables(n: int) -> tuple[list[int], list[int]]:
    """(digit, next state) at state * 2^n + bits, for the curve in n dimensions; state = entry corner * n + direction."""
    full, corners = (1 << n) - 1, 1 << n
    gray = lambda w: w ^ (w >> 1)
    ungray = {gray(w): w for w in range(corners)}
    left = lambda b, k: ((b << k % n) | (b >> (n - k % n))) & full
    right = lambda b, k: left(b, n - k % n)
    ones = lambda w: ((w + 1) & ~w).bit_length() - 1  # noqa: E731  trailing set bits
    digits, states = [], []
    for state in range(corners * n):
        entry, direction = divmod(state, n)
        for bits in range(corners):
            w = ungray[right(bits ^ entry, direction + 1)]
            start = gray(2 * ((w - 1) // 2)) if w else 0
            turn = ones(w if w % 2 else w - 1) % n if w else 0
            digits.append(w)
            states.append((entry ^ left(start, direction + 1)) * n + (direction + turn + 1) % n)
    return digits, states


def curve_index(coordinates: Column, n: int, bits: int) -> Column:
    """Position on the Hilbert curve of the cell with these n coordinates (array<int>), each of `bits` bits."""
    digits, states = (F.array(*[F.lit(v) for v in t]) for t in state_tables(n))

    def step(at: Column, level: Column) -> Column:
        bit = lambda j: F.call_function("shiftright", F.element_at(coordinates, j + 1), level).bitwiseAND(1) * (1 << j)
        place = (at["state"] * (1 << n) + sum((bit(j) for j in range(1, n)), bit(0)) + 1).cast("int")
        return F.struct(F.element_at(states, place).alias("state"), (at["index"] * (1 << n) + F.element_at(digits, place)).alias("index"))

    levels = F.array(*[F.lit(b) for b in reversed(range(bits))])
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(levels, start, step, lambda at: at["index"])


def cell_starts(df: DataFrame, dimension: str, bits: int) -> list[tuple]:
    """(smallest value, cell), at most 2^bits pairs in order. The cell of a value is floor(rows with smaller values * 2^bits / rows)."""
    counts = df.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    run = ordered(counts, [], ["value"], before={"below": F.col("n")})
    rows = counts.agg(F.sum("n")).first()[0]
    if not rows:
        return []
    cell = F.floor(F.col("below") * (1 << bits) / F.lit(rows)).cast("int")
    return [tuple(r) for r in run.groupBy(cell.alias("cell")).agg(F.min("value").alias("value")).select("value", "cell").orderBy("cell").collect()]


def cell_of(df: DataFrame, dimension: str, starts: list[tuple]) -> Column:
    """The cell of the row's value; a null lies in cell 0."""
    if not starts:
        return F.lit(0)
    kind = df.schema[dimension].dataType
    least = F.array(*[F.lit(v).cast(kind) for v, _ in starts])
    codes = F.array(F.lit(0), *[F.lit(c) for _, c in starts])
    return F.coalesce(F.element_at(codes, F.size(F.filter(least, lambda v: v <= F.col(dimension))) + 1), F.lit(0))


def on_curve(df: DataFrame, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS, into: str = "curve") -> DataFrame:
    """`df` with `into`: long, the row's place on the curve. Values of any ordered type; nulls lie in cell 0."""
    if not 1 <= len(dimensions) * bits <= 62:
        raise ValueError("dimensions * bits must be between 1 and 62")
    df = without(df, [into])
    cells = fresh_name(df, "cells")  # a column of its own, so that each level of the curve reads it and does not find it anew
    coded = df.withColumn(cells, F.array(*[cell_of(df, d, cell_starts(df, d, bits)) for d in dimensions]))
    return coded.withColumn(into, curve_index(F.col(cells), len(dimensions), bits)).drop(cells)


def shards(
    df: DataFrame, dimensions: Sequence[str] = DIMENSIONS, count: int = SHARDS, law: str = "rows", size: str = "size", ties: Sequence[str] = (), bits: int = BITS
) -> DataFrame:
    """`df` with `curve` (long), `shard` (int, 0 to count-1) and `slot` (long, place in the shard, gapless from 0).

    law `rows`: row counts of the shards are at most one apart. law `bytes`: shard s holds the rows before which between
    s/count and (s+1)/count of the sum of `size` has gone, so shards differ by the largest two rows at most.
    Rows in one cell go by `ties`, then by their place in the table as it was written on the way. Null dimensions lie in
    cell 0, a null `size` counts nothing. An empty table has no shards; with fewer rows than shards some stay empty.
    Repeated rows are rows of their own. Columns of the three names are replaced, all others stay.
    """
    if law not in LAWS or count < 1:
        raise ValueError("law is rows or bytes, count at least 1")
    df = without(df, ["curve", "shard", "slot"])
    row, position, gone = (fresh_name(df, x) for x in ("row", "position", "gone"))
    df = materialize(df.withColumn(row, F.monotonically_increasing_id()))
    weight = F.coalesce(F.col(size).cast("long"), F.lit(0)) if law == "bytes" else F.lit(1)
    total, rows = df.agg(F.sum(weight), F.count(F.lit(1))).first()
    placed = on_curve(df, dimensions, bits)
    if law == "rows":
        placed = ordered(placed, [], ["curve", *ties, row], rank=position)
        placed = placed.withColumn("shard", F.expr(f"cast((({position} - 1) * {count}L) div {max(rows, 1)}L as int)"))
        return placed.withColumn("slot", F.expr(f"{position} - 1 - (shard * {rows}L + {count - 1}L) div {count}L")).drop(row, position)
    placed = ordered(placed, [], ["curve", *ties, row], rank=position, before={gone: weight})
    shard = F.expr(f"cast(least(({gone} * {count}L) div {max(total or 0, 1)}L, {count - 1}L) as int)")  # the last rows may weigh nothing
    placed = materialize(placed.withColumn("shard", shard))
    first = placed.groupBy("shard").agg(F.min(position).alias(gone))  # one row a shard
    return placed.drop(gone).join(first, "shard").withColumn("slot", F.col(position) - F.col(gone)).select(*[F.col(f"`{c}`") for c in df.columns if c != row], "curve", "shard", "slot")


def ranges(sharded: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """One row a shard: `rows`, and for each dimension `<name>_min`, `<name>_max`, `<name>_nulls`."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for d in dimensions:
        aggs += [F.min(d).alias(f"{d}_min"), F.max(d).alias(f"{d}_max"), F.count_if(F.col(d).isNull()).alias(f"{d}_nulls")]
    return sharded.groupBy("shard").agg(*aggs)


def shards_to_read(manifest: DataFrame, wanted: Mapping[str, tuple]) -> list[int]:
    """Shards that may hold a row with every named dimension between the two given values (None: open)."""
    may = F.lit(True)
    for d, (low, high) in wanted.items():
        may = may & F.col(f"{d}_min").isNotNull()
        may = may if low is None else may & (F.col(f"{d}_max") >= F.lit(low))
        may = may if high is None else may & (F.col(f"{d}_min") <= F.lit(high))
    return sorted(r["shard"] for r in manifest.where(may).select("shard").collect())


def write_shards(sharded: DataFrame, path: str, dimensions: Sequence[str] = DIMENSIONS, rows_per_file: int = 1_000_000) -> DataFrame:
    """Write the shards as Parquet under `path`/data, one folder each, files in the order of their slots; then the ranges
    of the shards under `path`/ranges, which is what a reader looks for first. Gives back the ranges.

    Rows are dealt out by ranges of (shard, slot), so each task writes one stretch of the curve however large a shard is.
    """
    spark = sharded.sparkSession
    laid = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    laid.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/data")
    written = spark.read.parquet(f"{path}/data")
    ranges(written, dimensions).write.parquet(f"{path}/ranges")
    return spark.read.parquet(f"{path}/ranges")


def read_shards(spark, path: str, wanted: Mapping[str, tuple]) -> DataFrame:
    """The rows with every named dimension between the given values, from the shards that may hold some."""
    keep = shards_to_read(spark.read.parquet(f"{path}/ranges"), wanted)
    rows = spark.read.parquet(f"{path}/data").where(F.col("shard").isin(keep))
    for d, (low, high) in wanted.items():
        rows = rows if low is None else rows.where(F.col(d) >= F.lit(low))
        rows = rows if high is None else rows.where(F.col(d) <= F.lit(high))
    return rows


def _crc32_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _sql() -> str:
    """The same law in SQL: cells by running counts, the curve level by level, runs by row number; crc32 byte by byte."""
    n = len(DIMENSIONS)
    digits, states = state_tables(n)
    cells = "".join(
        f", {d}_cells AS (SELECT v, CAST((sum(c) OVER (ORDER BY v) - c) * {1 << BITS} // sum(c) OVER () AS BIGINT) AS cell FROM (SELECT {d} AS v, count(*) AS c FROM docs WHERE {d} IS NOT NULL GROUP BY 1))"
        for d in DIMENSIONS)
    joined = " ".join(f"LEFT JOIN {d}_cells ON {d} = {d}_cells.v" for d in DIMENSIONS)
    levels = ["(SELECT doc_id, size, text_crc32, " + ", ".join(f"coalesce({d}_cells.cell, 0) AS c{j}" for j, d in enumerate(DIMENSIONS)) + f", 0 AS st, CAST(0 AS BIGINT) AS curve FROM docs {joined})"]
    for level in reversed(range(BITS)):
        bits = " + ".join(f"((c{j} >> {level}) & 1) * {1 << j}" for j in range(n))
        placed = f"(SELECT *, CAST(st * {1 << n} + {bits} + 1 AS INTEGER) AS entry FROM {levels[-1]})"
        levels.append(f"(SELECT * EXCLUDE (entry, st, curve, digits, states), states[entry] AS st, curve * {1 << n} + digits[entry] AS curve FROM {placed}, automaton)")
    utf8 = """CASE WHEN c < 128 THEN [c] WHEN c < 2048 THEN [192 | (c >> 6), 128 | (c & 63)] WHEN c < 65536 THEN [224 | (c >> 12), 128 | ((c >> 6) & 63), 128 | (c & 63)]
        ELSE [240 | (c >> 18), 128 | ((c >> 12) & 63), 128 | ((c >> 6) & 63), 128 | (c & 63)] END"""
    return f"""
    WITH automaton AS (SELECT {digits} AS digits, {states} AS states),
    points AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split(coalesce(text, ''), ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda c: c >= 0) AS p FROM documents),
    coded AS (SELECT doc_id, lang, source, flatten(list_transform(p, lambda c: {utf8})) AS b FROM points),
    docs AS (SELECT doc_id, lang, source, CAST(len(b) + 1 AS BIGINT) AS size,
        xor(list_reduce(b, lambda a, x: xor(a >> 8, CAST({_crc32_table()}[CAST(xor(a & 255, x) AS INTEGER) + 1] AS BIGINT)), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM coded)
    {cells},
    numbered AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, size, doc_id NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM {levels[-1]}),
    cut AS (SELECT *, CAST(pos * {SHARDS} // n AS INTEGER) AS shard FROM numbered)
    SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, shard, CAST(pos - (shard * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS BIGINT) AS curve
    FROM cut"""


@query(_sql())
def op12_hilbert_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    coded = whole_text().cast("binary")
    narrow = docs.select("doc_id", "lang", "source", (F.octet_length(coded) + 1).cast("long").alias("size"), F.crc32(coded).alias("text_crc32"))
    done = shards(narrow, DIMENSIONS, SHARDS, "rows", ties=("text_crc32", "size", "doc_id"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
