"""Attribute generation on order lines, user events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.functions.hashing import hashed_unit
from chronoweave.functions.kernels import materialize, r6
from chronoweave.operators import attribute_generation as ag
from chronoweave.operators import priors as pr
from chronoweave.plans.registry import query
from chronoweave.plans.tables import SPINE, TEXTS, Tables, r, unit_sql
from chronoweave.plans.text_queries import squeeze_sql, words_sql

CLASSES = ["1", "2", "3", "4", "5", "6", "7"]


def donor_sql(seed, by: str, asked: str = "synthetic", train: str = "real", cols: str = "quantity, flag") -> str:
    part = f"PARTITION BY {by}" if by else ""
    join = f"USING ({by}, i)" if by else "USING (i)"
    keep = f"{by}, " if by else ""
    size = f"JOIN (SELECT {by}, count(*) AS n FROM {train} GROUP BY {by}) USING ({by})" if by else f", (SELECT count(*) AS n FROM {train})"
    return f"""(SELECT a.event_id, {cols} FROM (SELECT event_id, {keep}CAST(floor({unit_sql(seed, 'event_id')} * n) AS BIGINT) + 1 AS i FROM {asked} {size}) a
    JOIN (SELECT {keep}{cols}, row_number() OVER ({part} ORDER BY event_id) AS i FROM {train}) b {join})"""


@query("J28", f"WITH {SPINE} SELECT * FROM {donor_sql(42, '')}")
def marginal_donor_rows(t: Tables):
    return ag.donor_values(t.synthetic, "event_id", t.real, "event_id", ["quantity", "flag"])


@query("J28", f"""WITH {SPINE} SELECT a.event_id, a.quantity, b.flag FROM {donor_sql('42quantity', '', cols='quantity')} a JOIN {donor_sql('42flag', '', cols='flag')} b USING (event_id)""")
def independent_column_baseline(t: Tables):
    return ag.independent_columns(t.synthetic, "event_id", t.real, "event_id", ["quantity", "flag"])


@query("J28", f"""WITH {SPINE}, a AS (SELECT *, 0 AS level FROM {donor_sql('42l0', 'product_id, day')}), s1 AS (SELECT * FROM synthetic WHERE event_id NOT IN (SELECT event_id FROM a)),
b AS (SELECT *, 1 AS level FROM {donor_sql('42l1', 'product_id', 's1')}), s2 AS (SELECT * FROM s1 WHERE event_id NOT IN (SELECT event_id FROM b)), c AS (SELECT *, 2 AS level FROM {donor_sql('42l2', '', 's2')})
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def joint_donors_with_backoff(t: Tables):
    return ag.donors_with_backoff(t.synthetic, "event_id", t.real, "event_id", ["quantity", "flag"], [["product_id", "day"], ["product_id"], []])


@query("J28 E2", f"""WITH {SPINE}, o AS (SELECT event_id, product_id, quantity, row_number() OVER (PARTITION BY product_id ORDER BY ts, event_id) AS i, rank() OVER (PARTITION BY product_id ORDER BY ts) - 1 AS prior FROM spine)
SELECT a.event_id, b.quantity FROM o a LEFT JOIN o b ON a.product_id = b.product_id AND a.prior > 0 AND b.i = CAST(floor({unit_sql(42, 'a.event_id')} * a.prior) AS BIGINT) + 1""")
def past_product_donors(t: Tables):
    return ag.past_donors(t.spine, "event_id", "product_id", "ts", ["quantity"])


def shares_sql(key: str, name: str) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE rating = {c}) / count(*) AS {name}{c}" for c in CLASSES)
    return f"{name} AS (SELECT {key}, count(*) AS {name}n, {cols} FROM real GROUP BY 1)"


MIX = ", ".join(f"(coalesce(un / (un + 5), 0) * coalesce(u{c}, 0) + coalesce(pn / (pn + 5), 0) * coalesce(p{c}, 0) + g{c}) / (coalesce(un / (un + 5), 0) + coalesce(pn / (pn + 5), 0) + 1)" for c in CLASSES)


@query("J29", f"""WITH {SPINE}, {shares_sql('customer_id', 'u')}, {shares_sql('product_id', 'p')}, {shares_sql('1', 'g')}, m AS (SELECT event_id, [{MIX}] AS probs FROM synthetic LEFT JOIN u USING (customer_id) LEFT JOIN p USING (product_id), g)
SELECT event_id, {r('probs[1]')} AS first_class, {r('probs[5]')} AS fifth_class FROM m""")
def user_item_rating_mixture(t: Tables):
    out = ag.user_item_mixture(t.synthetic, t.real, "customer_id", "product_id", "rating", CLASSES)
    return out.select("event_id", r6(F.col("probs")[0]).alias("first_class"), r6(F.col("probs")[4]).alias("fifth_class"))


@query("J29", f"""WITH {SPINE}, g AS (SELECT rating, count(*) / sum(count(*)) OVER () AS s FROM real GROUP BY 1), n AS (SELECT product_id, count(*) AS n FROM real GROUP BY 1), c AS (SELECT product_id, rating, count(*) AS c FROM real GROUP BY ALL),
p AS (SELECT product_id, rating, (coalesce(c, 0) + 5 * s) / (n + 5) AS p FROM n CROSS JOIN g LEFT JOIN c USING (product_id, rating)), k AS (SELECT product_id, rating, sum(p) OVER (PARTITION BY product_id ORDER BY rating) / sum(p) OVER (PARTITION BY product_id) AS cum FROM p)
SELECT event_id, CAST(min(rating) AS VARCHAR) AS rating FROM (SELECT event_id, product_id, {unit_sql(42, 'event_id')} AS u FROM synthetic) JOIN k USING (product_id) WHERE cum >= u GROUP BY event_id""")
def item_rating_baseline(t: Tables):
    p = ag.class_probabilities(t.real, ["product_id"], "rating", CLASSES, 5.0)
    out = t.synthetic.join(p, "product_id")
    return out.select("event_id", ag.pick_class("probs", hashed_unit(42, "event_id"), CLASSES).alias("rating"))


def logit_rows(t: Tables):
    """Spine rows with the monthly prior plus product effects as base logits."""
    m = t.spine.select("event_id", "product_id", F.date_format("ts", "yyyy-MM").alias("bucket"), "rating", "verified")
    prior = ag.class_probabilities(m, ["bucket"], "rating", CLASSES, 20.0)
    effects = pr.vector_effects(m, "product_id", "rating", "verified", CLASSES, 30.0)
    rows = m.join(prior.select("bucket", "probs"), "bucket").join(effects.select("product_id", "effects"), "product_id")
    rows = rows.withColumn("base", ag.base_logits("probs", [(0.5, "effects")], len(CLASSES)))
    return materialize(rows), prior.select("bucket", F.col("probs").alias("target"))


@query("J26 J27", "SELECT true AS all_rows, true AS known_classes, true AS calibrated_closer")
def calibrated_class_sampling(t: Tables):
    """Base logits shifted per month to the prior, then a Gumbel pick: the calibrated mean must be the closer one."""
    rows, target = logit_rows(t)
    cal = materialize(ag.calibrate_to_targets(rows, "bucket", "base", target))
    n = rows.count()
    picked = cal.select("event_id", ag.gumbel_class("calibrated", "event_id", CLASSES).alias("cls")).agg(
        (F.count(F.lit(1)) == n).alias("a"), F.bool_and(F.col("cls").isin(CLASSES)).alias("k")).first()
    curve = ag.calibration_curve(cal, "bucket", "base", "calibrated", [float(c) for c in CLASSES])
    want = target.select("bucket", F.aggregate(F.zip_with("target", F.array(*[F.lit(float(c)) for c in CLASSES]), lambda p, x: p * x), F.lit(0.0), lambda a, b: a + b).alias("want"))
    return curve.join(want, "bucket").agg(F.lit(picked["a"]).alias("all_rows"), F.lit(picked["k"]).alias("known_classes"),
                                          (F.avg(F.abs(F.col("mean_after") - F.col("want"))) <= F.avg(F.abs(F.col("mean_before") - F.col("want"))) + 1e-9).alias("calibrated_closer"))


@query("J27")
def calibration_component_curve(t: Tables):
    rows, target = logit_rows(t)
    return ag.calibration_curve(ag.calibrate_to_targets(rows, "bucket", "base", target, 0.5), "bucket", "base", "calibrated", [float(c) for c in CLASSES])


@query("J25 C15", """SELECT 'cell' AS cell_used, true AS found""")
def sampled_entity_effects(t: Tables):
    g = t.spine.groupBy("product_id").agg(F.count(F.lit(1)).alias("degree"), F.avg("rating").alias("x0"), F.avg("quantity").alias("y0")).join(t.product_blocks, "product_id")
    g = materialize(g)
    cells = pr.gaussian_cells(g, "product_block", "degree", "x0", "y0", minimum=5)
    binned, _ = pr.degree_bins(g, "degree", 4)
    out = ag.sample_effects(binned.select("product_id", "product_block", "degree_bin"), "product_id", "product_block", "degree_bin", cells)
    return out.groupBy("cell_used").agg(F.bool_and(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("found"))


@query("C20", f"""WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i, count(*) OVER () AS n FROM supplier)
SELECT p_partkey, s_suppkey FROM part JOIN p ON p.i = CAST(floor({unit_sql(42, 'p_partkey')} * (SELECT count(*) FROM supplier)) AS BIGINT) + 1""")
def random_supplier_assignment(t: Tables):
    return ag.random_parents(t.part, "p_partkey", t.supplier, "s_suppkey")


@query("J33", f"""WITH {TEXTS}, d AS (SELECT text, row_number() OVER (ORDER BY doc_id) AS i FROM texts WHERE is_real) SELECT doc_id, md5(text) AS digest FROM (SELECT doc_id, CAST(floor({unit_sql(42, 'doc_id')} * (SELECT count(*) FROM d)) AS BIGINT) + 1 AS i FROM texts WHERE NOT is_real) JOIN d USING (i)""")
def bootstrapped_texts(t: Tables):
    x = t.texts
    out = ag.bootstrap_texts(x.where("not is_real"), "doc_id", x.where("is_real"), "doc_id", "text")
    return out.select("doc_id", F.md5("text").alias("digest"))


@query("J33", f"""WITH {SPINE} SELECT event_id, CASE rating WHEN 1 THEN 'not for me' WHEN 5 THEN 'works great' ELSE 'it is fine' END AS text FROM synthetic""")
def rating_template_texts(t: Tables):
    return ag.template_texts(t.synthetic, "event_id", "rating", {"1": "not for me", "5": "works great"}, "it is fine")


@query("J33", "SELECT true AS every_text, true AS right_lengths")
def unigram_texts_by_language(t: Tables):
    x = t.texts
    n = x.count()
    out = ag.unigram_texts(x, "doc_id", "lang", x, "text")
    words = F.size(F.split("text", " "))
    return out.agg((F.count(F.lit(1)) == n).alias("every_text"), F.bool_and(words.between(2, 8)).alias("right_lengths"))


def copy_clash(a: str) -> str:
    return f"lower({squeeze_sql(a)})"


@query("J34", f"""WITH {TEXTS}, seen AS (SELECT DISTINCT {copy_clash('text')} AS p FROM texts WHERE is_real), g AS (SELECT doc_id, text AS t0 FROM texts WHERE NOT is_real),
s AS (SELECT doc_id, CASE WHEN {copy_clash('t0')} NOT IN (SELECT p FROM seen) THEN 0 WHEN {copy_clash("trim(t0) || ' overall'")} NOT IN (SELECT p FROM seen) THEN 1 ELSE 2 END AS attempts FROM g)
SELECT attempts, true AS resolved, count(*) AS n FROM s GROUP BY attempts""")
def exact_copy_blocking(t: Tables):
    x = t.texts
    out = ag.block_exact_copies(x.where("not is_real"), "doc_id", "text", x.where("is_real"), "text")
    return out.groupBy("attempts", "resolved").agg(F.count(F.lit(1)).alias("n"))


@query("J39", f"""WITH {TEXTS}, seen AS (SELECT DISTINCT {copy_clash('text')} AS p FROM texts WHERE is_real) SELECT {copy_clash('text')} IN (SELECT p FROM seen) AS replaced, count(*) AS n FROM texts WHERE NOT is_real GROUP BY 1""")
def replaced_copies(t: Tables):
    x = t.texts
    out = ag.replace_copies(x.where("not is_real"), "doc_id", "text", x.where("is_real"), "text")
    return out.groupBy("replaced").agg(F.count(F.lit(1)).alias("n"))


@query("J38", f"""WITH {TEXTS}, d AS (SELECT len({words_sql('text')}) AS n, row_number() OVER (ORDER BY doc_id) AS i FROM texts WHERE is_real),
s AS (SELECT doc_id, CAST(floor({unit_sql(42, 'doc_id')} * (SELECT count(*) FROM d)) AS BIGINT) + 1 AS i FROM texts WHERE NOT is_real) SELECT doc_id, CAST(n AS INTEGER) AS target FROM s JOIN d USING (i)""")
def sampled_text_lengths(t: Tables):
    x = t.texts.withColumn("n", tx.word_length("text"))
    return ag.length_targets(x.where("not is_real"), "doc_id", x.where("is_real"), "doc_id", "n")


@query("J38", f"""WITH {TEXTS}, l AS (SELECT doc_id, len({words_sql('text')}) AS n FROM texts), b AS (SELECT doc_id, CASE WHEN n = 0 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 3 WHEN n <= 10 THEN 6 WHEN n <= 16 THEN 11 ELSE 17 END AS lo,
CASE WHEN n = 0 THEN 0 WHEN n <= 2 THEN 2 WHEN n <= 5 THEN 5 WHEN n <= 10 THEN 10 WHEN n <= 16 THEN 16 ELSE 32 END AS hi FROM l) SELECT doc_id, CAST(floor({unit_sql(42, 'doc_id')} * (hi - lo + 1)) + lo AS BIGINT) AS target FROM b""")
def bucketed_text_lengths(t: Tables):
    x = t.texts.select("doc_id", tx.named_bucket(tx.word_length("text"), tx.SUMMARY_LENGTH_BUCKETS).alias("bucket"))
    return ag.length_targets(x, "doc_id", x, "doc_id", "bucket", "bucket", tx.SUMMARY_LENGTH_BUCKETS)


@query("J36", f"""WITH {SPINE}, s AS (SELECT event_id, flag, status, (floor({unit_sql('42s', 'event_id')} * 100) + 1) / 100.0 AS step FROM spine), p AS (SELECT *, 1 - cos(step * pi() / 2) AS p FROM s)
SELECT event_id, {r('step')} AS step, CASE WHEN {unit_sql('42flag', 'event_id')} < p THEN '[MASK]' ELSE flag END AS flag_input, CASE WHEN {unit_sql('42flag', 'event_id')} < p THEN flag END AS flag_label,
CASE WHEN {unit_sql('42status', 'event_id')} < p THEN '[MASK]' ELSE status END AS status_input, CASE WHEN {unit_sql('42status', 'event_id')} < p THEN status END AS status_label FROM p""")
def masked_category_rows(t: Tables):
    out = ag.masked_cells(t.spine, "event_id", ["flag", "status"], 100, "cosine")
    return out.withColumn("step", r6(F.col("step")))
