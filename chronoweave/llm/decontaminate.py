"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows, multi-index Hamming blocks,
exact weighted-shingle similarity.

1. A document's five-word shingles are looked up among those of the items. A window as long as an item can only be as
   similar as asked for if it holds enough of the item's shingles, and moving it right to the first of them loses none.
   A window that the end of the text cuts short needs fewer of them. So the windows that start at a shared shingle and hold enough of them are all that matter.
2. Equal windows are fingerprinted once: 64 bits, each the sign of a vote of the window's shingles, repeats voting again.
3. Fingerprints of window and item are cut into RADIUS + 1 blocks. Two fingerprints within the radius agree on one block
   at least, so an equality join on (item, block, value) loses none of them.
4. Candidates are verified on the shingle multisets: sum of the smaller counts over sum of the larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.kernels import materialize
from chronoweave.llm.common import query, table, whole_text, words

WORDS, THRESHOLD = 5, 0.8
BITS, RADIUS = 64, 22  # at similarity 0.8 a bit differs with probability 0.152: beyond 22 of 64 in about 3 of 100,000 cases
BROADCAST_SHINGLES = 1_000_000  # the benchmark's shingles are broadcast up to this number, else joined by a shuffle


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word shingles in text order; a shorter text is one shingle, one without words has none."""
    w = words(text)
    # bound once: the lambda sees the word array of the one-element outer array
    return F.flatten(F.transform(F.array(w), lambda a: F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - WORDS + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(a, i, WORDS))))))


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint of an array of 64-bit hashes, each element one vote."""
    vote = lambda bit: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, bit).cast("int") * 2 - 1)
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda acc, bit: acc.bitwiseOR(F.when(vote(bit) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long"))))


def numbered_repeats(hashes: Column) -> Column:
    """The multiset as a set: each hash with the number of its repeat."""
    return F.flatten(F.transform(F.array(F.array_sort(hashes)), lambda a: F.transform(a, lambda h, i: F.struct(h.alias("h"), (i + 1 - F.array_position(a, h)).alias("repeat")))))


def blocks(fingerprint: Column, radius: int) -> Column:
    """(block, value) for radius + 1 blocks that together hold all bits."""
    n = radius + 1
    cuts = [round(k * BITS / n) for k in range(n + 1)]
    value = lambda lo, hi: F.call_function("shiftrightunsigned", fingerprint, F.lit(lo)).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    return F.array(*[F.struct(F.lit(k).alias("block"), value(lo, hi).alias("value")) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])


def contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(id, text_hash, item_id, similarity): each document and item with a window of similarity `threshold` or more.

    The best window counts. Null and empty texts hold nothing. An item of fewer than five words is one shingle and is
    found only in a document of exactly those words. Equal items are reported each. Rows that repeat an id with the
    same text give the pair once; with another text, (id, text_hash) tells them apart. Null ids are kept as null.
    """
    share = threshold / (1 + threshold)  # of the shingles of window and item together that both must hold
    wanted = items.select(F.col(item).cast("long").alias("item_id"), shingle_hashes(whole_text(item_text)).alias("hashes")).where(F.size("hashes") > 0)
    wanted = wanted.groupBy("item_id", "hashes").agg(F.count(F.lit(1)).alias("_")).drop("_").withColumn("item", F.xxhash64("item_id", "hashes"))
    wanted = materialize(wanted.withColumns({"n": F.size("hashes"), "print": simhash(F.col("hashes"))}))
    looked_up = wanted.select("item", "n", F.explode(F.array_distinct("hashes")).alias("hash"))
    if looked_up.count() <= BROADCAST_SHINGLES:
        looked_up = F.broadcast(looked_up)

    given = docs.select(F.col(doc).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), whole_text(text).alias("text"))
    shingled = given.select("id", "text_hash", shingle_hashes(F.col("text")).alias("hashes")).withColumn("length", F.size("hashes"))
    spread = shingled.select("id", "text_hash", "length", F.posexplode("hashes").alias("at", "hash"))
    # repeated rows repeat their positions, hence the set
    held = spread.join(looked_up, "hash").groupBy("id", "text_hash", "item", "n").agg(F.array_sort(F.collect_set("at")).alias("at"), F.max("length").alias("length"))
    least = lambda p: F.ceil((F.col("n") + F.least(F.col("n"), F.col("length") - p)) * share - 1e-9).cast("int")
    start = F.filter(F.transform("at", lambda p, i: F.when(F.get("at", i + least(p) - 1) - p < F.col("n"), p)), lambda p: p.isNotNull())
    windows = materialize(held.withColumn("start", start).where(F.size("start") > 0).select("id", "text_hash", "item", "n", "start"))

    texts = given.join(windows.select("text_hash").distinct(), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    hashed = windows.select("text_hash", "item", "n", F.explode("start").alias("start")).distinct().groupBy("text_hash").agg(F.collect_list(F.struct("item", "n", "start")).alias("windows"))
    hashed = hashed.join(texts, "text_hash").select("text_hash", "windows", shingle_hashes(F.col("text")).alias("hashes"))
    cut = F.transform("windows", lambda w: F.struct(w["item"].alias("item"), F.slice("hashes", w["start"] + 1, w["n"]).alias("hashes")))
    each = hashed.select("text_hash", F.inline(cut)).withColumn("content", F.xxhash64("hashes", F.size("hashes")))
    each = materialize(each)

    contents = each.groupBy("content").agg(F.first("hashes").alias("hashes")).withColumn("print", simhash(F.col("hashes")))
    contents = materialize(contents)
    pairs = each.select("content", "item").distinct().join(contents.select("content", "print"), "content")
    left = pairs.select("content", "item", F.inline(blocks(F.col("print"), radius)))
    right = wanted.select("item", F.inline(blocks(F.col("print"), radius)))
    near = left.join(right, ["item", "block", "value"]).select("content", "item").distinct()
    near = near.join(contents.select("content", "print", F.col("hashes").alias("window")), "content").join(wanted.select("item", "item_id", "hashes", F.col("print").alias("item_print")), "item")
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    common = F.size(F.array_intersect(numbered_repeats(F.col("window")), numbered_repeats(F.col("hashes"))))
    alike = near.select("content", "item", "item_id", common.alias("common"), (F.size("window") + F.size("hashes")).alias("both"))
    alike = alike.withColumn("similarity", F.col("common") / (F.col("both") - F.col("common"))).where(F.col("similarity") >= threshold - 1e-12)
    best = each.select("text_hash", "content", "item").join(alike, ["content", "item"]).groupBy("text_hash", "item").agg(F.first("item_id").alias("item_id"), F.max("similarity").alias("similarity"))
    return windows.select("id", "text_hash", "item").join(best, ["text_hash", "item"]).select("id", "text_hash", "item_id", "similarity")


def without_benchmark(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", **named) -> DataFrame:
    """The rows of `docs` that hold no item; all columns as given."""
    found = contaminated(docs, items, doc, text, **named).select(F.col("text_hash").alias("_leaked")).distinct()
    kept = docs.withColumn("_hash", F.xxhash64(F.col(text)))
    return kept.join(found, kept["_hash"] == found["_leaked"], "left_anti").drop("_hash")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
s AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p, w FROM w WHERE len(w) > 0),
ds AS (SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS g FROM s),
i AS (SELECT item_id, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p, w FROM iw WHERE len(w) > 0),
ig AS (SELECT item_id, array_to_string(w[p : p + 4], ' ') AS g, count(*) AS c, any_value(greatest(len(w) - 4, 1)) AS n FROM i GROUP BY 1, 2),
hit AS (SELECT doc_id, item_id, p, n FROM ds JOIN ig USING (g)),
total AS (SELECT doc_id, max(p) AS last FROM ds GROUP BY 1),
starts AS (SELECT a.doc_id, a.item_id, a.p, a.n FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p BETWEEN a.p AND a.p + a.n - 1 JOIN total t ON t.doc_id = a.doc_id
           GROUP BY a.doc_id, a.item_id, a.p, a.n, t.last HAVING count(*) >= ceil((a.n + least(a.n, t.last - a.p + 1)) * 0.8 / 1.8 - 1e-9)),
cnt AS (SELECT x.doc_id, x.item_id, x.p, x.n, d.g, count(*) AS c FROM starts x JOIN ds d ON d.doc_id = x.doc_id AND d.p BETWEEN x.p AND x.p + x.n - 1 GROUP BY ALL),
ov AS (SELECT c.doc_id, c.item_id, c.p, c.n, sum(least(c.c, ig.c)) AS o FROM cnt c JOIN ig ON ig.item_id = c.item_id AND ig.g = c.g GROUP BY ALL),
sim AS (SELECT doc_id, item_id, o / (n + least(n, last - p + 1) - o) AS j FROM ov JOIN total USING (doc_id))
SELECT doc_id, item_id, round(max(j), 6) AS similarity FROM sim WHERE j >= 0.8 - 1e-12 GROUP BY 1, 2
"""


@query(SQL)
def op9_benchmark_decontamination(spark, sf_dir):
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.round("similarity", 6).alias("similarity"))
