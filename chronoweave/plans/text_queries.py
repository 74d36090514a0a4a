"""Text functions and vocabularies on documents, benchmark passages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.functions.kernels import quantiles, r6
from chronoweave.operators import vocabularies as vo
from chronoweave.plans.registry import query
from chronoweave.plans.tables import TEXTS, Tables, r

SP = tx.SPACE


def squeeze_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), '^{SP}+|{SP}+$', '', 'g'), '{SP}+', ' ', 'g')"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all(lower({squeeze_sql(c)}), '{tx.TOKEN}')"


def words_sql(c: str) -> str:
    return f"list_filter(string_split({squeeze_sql(c)}, ' '), lambda x: x <> '')"


def copy_sql(c: str) -> str:
    return squeeze_sql(f"regexp_replace(lower({squeeze_sql(c)}), '{tx.ASCII_PUNCTUATION}', '', 'g')")


TOKENS = f"{TEXTS}, tk AS (SELECT *, {tokens_sql('text')} AS tokens FROM texts)"


@query("H1", f"""{'WITH ' + TEXTS} SELECT doc_id, md5({squeeze_sql('text')}) AS squeezed, md5(nfc_normalize({squeeze_sql('text')})) AS composed,
md5(lower({squeeze_sql('text')})) AS private_form, md5({copy_sql('text')}) AS copy_form FROM texts""")
def normalized_texts(t: Tables):
    return t.texts.select("doc_id", F.md5(tx.squeeze("text")).alias("squeezed"), F.md5(tx.canonical("text")).alias("composed"),
                          F.md5(tx.private_form("text")).alias("private_form"), F.md5(tx.copy_form("text")).alias("copy_form"))


@query("H2 H3", f"""WITH {TOKENS} SELECT doc_id, CAST(len(tokens) AS INTEGER) AS tokens, md5(array_to_string(tokens, ' ')) AS token_digest,
CAST(len({words_sql('text')}) AS INTEGER) AS words, CAST(length({squeeze_sql('text')}) AS INTEGER) AS chars,
CAST(len(regexp_extract_all(lower(text), '{tx.ASCII_WORD.replace("'", "''")}')) AS INTEGER) AS ascii_words FROM tk""")
def token_and_length_columns(t: Tables):
    tk = tx.tokens("text")
    return t.texts.select("doc_id", F.size(tk).alias("tokens"), F.md5(F.array_join(tk, " ")).alias("token_digest"),
                          tx.word_length("text").alias("words"), tx.char_length("text").alias("chars"), F.size(tx.ascii_words("text")).alias("ascii_words"))


@query("H4", f"""WITH {TOKENS}, g AS (SELECT lang, unnest(list_transform(range(1, len(tokens) - 1), lambda i: array_to_string(tokens[i:i+2], ' '))) AS gram
FROM tk WHERE len(tokens) >= 3) SELECT lang, count(*) AS grams, count(DISTINCT gram) AS distinct_grams FROM g GROUP BY lang""")
def trigram_counts_by_language(t: Tables):
    g = t.texts.select("lang", F.explode(tx.ngrams(tx.tokens("text"), 3)).alias("gram")).select("lang", F.array_join("gram", " ").alias("gram"))
    n = g.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("lang").agg(F.sum("n").alias("grams"), F.count(F.lit(1)).alias("distinct_grams"))


@query("H6", f"""WITH {TOKENS}, e AS (SELECT doc_id, h % 64 AS place, sum(CASE WHEN (h >> 8) % 2 = 1 THEN 1.0 ELSE -1.0 END) AS w FROM
(SELECT doc_id, CAST('0x' || substr(md5('bag|' || token), 1, 13) AS BIGINT) AS h FROM (SELECT doc_id, unnest(tokens) AS token FROM tk)) GROUP BY ALL)
SELECT doc_id, {r('coalesce(sum(w) / nullif(sqrt(sum(w * w)), 0), 0)')} AS total, {r('coalesce(max(w) / nullif(sqrt(sum(w * w)), 0), 0)')} AS top,
{r('coalesce(coalesce(max(w) FILTER (WHERE place = 7), 0) / nullif(sqrt(sum(w * w)), 0), 0)')} AS place7 FROM e GROUP BY doc_id""")
def hashed_text_embeddings(t: Tables):
    return embedding_summary(t.texts)


def embedding_summary(texts):
    """(doc_id, total, top, place7) of the hashed embeddings; top is the largest entry among the places that tokens fall on."""
    e = tx.hashed_bag(texts, "doc_id", tx.tokens("text"), 64, places="places")
    nonzero = F.filter("embedding", lambda v: v != 0)
    largest = F.coalesce(F.array_max(nonzero), F.lit(0.0))
    top = F.when(F.col("places") > F.size(nonzero), F.greatest(largest, F.lit(0.0))).otherwise(largest)
    return e.select("doc_id", r6(F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b)).alias("total"), r6(top).alias("top"), r6(F.col("embedding")[7]).alias("place7"))


@query("L4 H6")
def pluggable_text_encoder(t: Tables):
    """Any batch encoder plugs in; the default seeds one unit vector per token."""
    v = tx.token_vector_encoder(16)
    return t.benchmark.select("item_id", v("text").alias("embedding"))


LEXICON = "['{}']".format("','".join(tx.POSITIVE_WORDS + ["the"])), "['{}']".format("','".join(tx.NEGATIVE_WORDS + ["to"]))


@query("H7", f"""WITH {TOKENS} SELECT doc_id, CASE WHEN len(tokens) = 0 THEN 0 ELSE {r(f'''(len(list_filter(tokens, lambda x: list_contains({LEXICON[0]}, x)))
- len(list_filter(tokens, lambda x: list_contains({LEXICON[1]}, x)))) / len(tokens)''')} END AS score FROM tk""")
def lexicon_sentiment(t: Tables):
    s = tx.sentiment(tx.tokens("text"), [*tx.POSITIVE_WORDS, "the"], [*tx.NEGATIVE_WORDS, "to"])
    return t.texts.select("doc_id", r6(s).alias("score"))


QUANTILE_NAMES = {"q0_q20": 0.2, "q20_q40": 0.4, "q40_q60": 0.6, "q60_q80": 0.8, "q80_q90": 0.9, "q90_q95": 0.95, "q95_q99": 0.99}


def length_quantile_buckets(df, length: str, longest: int) -> dict[str, tuple[int, int]]:
    """Closed length ranges cut at fixed quantiles; the last one reaches the longest allowed length."""
    import math

    cuts = quantiles(df, length, QUANTILE_NAMES).first()
    out, high = {}, -1
    for name in QUANTILE_NAMES:
        low = max(0, high + 1)
        high = min(longest, max(math.ceil(cuts[name]), high))
        out[name] = (low, max(low, high))
        high = out[name][1]
    out["q99_max"] = (max(0, high + 1), longest)
    return out


@query("H8", f"""WITH {TEXTS}, l AS (SELECT doc_id, len({words_sql('text')}) AS n FROM texts),
c AS (SELECT list_transform(quantile_cont(n, [0.2, 0.4, 0.6, 0.8, 0.9, 0.95, 0.99]), lambda x: ceil(x)) AS q FROM l)
SELECT doc_id, CASE WHEN n <= q[1] THEN 'q0_q20' WHEN n <= q[2] THEN 'q20_q40' WHEN n <= q[3] THEN 'q40_q60' WHEN n <= q[4] THEN 'q60_q80'
WHEN n <= q[5] THEN 'q80_q90' WHEN n <= q[6] THEN 'q90_q95' WHEN n <= q[7] THEN 'q95_q99' ELSE 'q99_max' END AS quantile_bucket,
CASE WHEN n = 0 THEN 'len_0' WHEN n <= 2 THEN 'len_1_2' WHEN n <= 5 THEN 'len_3_5' WHEN n <= 10 THEN 'len_6_10' WHEN n <= 16 THEN 'len_11_16' ELSE 'len_17_32' END AS summary_bucket,
CASE WHEN n <= 2 THEN 'length_le_2' WHEN n <= 5 THEN 'length_3_to_5' WHEN n <= 10 THEN 'length_6_to_10' ELSE 'length_gt_10' END AS copy_bucket FROM l, c""")
def text_length_buckets(t: Tables):
    l = t.texts.select("doc_id", tx.word_length("text").alias("n"))
    cuts = length_quantile_buckets(l, "n", 100_000)
    return l.select("doc_id", tx.named_bucket("n", cuts).alias("quantile_bucket"), tx.named_bucket("n", tx.SUMMARY_LENGTH_BUCKETS).alias("summary_bucket"),
                    tx.copy_length_bucket("n").alias("copy_bucket"))


TURNS = f"""turns AS (SELECT a.conv_id, a.turn, {tokens_sql('a.text')} AS x, {tokens_sql('b.text')} AS y
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def turn_pairs(t: Tables):
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(nxt, ["conv_id", "turn"])


@query("H13", f"""WITH {TURNS} SELECT conv_id, turn, CASE WHEN len(list_distinct(x || y)) = 0 THEN 1.0 ELSE
{r('len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(x || y))')} END AS jaccard FROM turns""")
def turn_token_jaccard(t: Tables):
    p = turn_pairs(t)
    return p.select("conv_id", "turn", r6(tx.jaccard(tx.tokens("text"), tx.tokens("reply"))).alias("jaccard"))


@query("H13")
def turn_sequence_similarity(t: Tables):
    """Longest common subsequence F1 and matching-block ratio; no SQL form, tested against brute force."""
    p = turn_pairs(t)
    return p.select("conv_id", "turn", tx.rouge_l(tx.tokens("text"), tx.tokens("reply")).alias("rouge_l"),
                    tx.sequence_ratio(tx.squeeze("text"), tx.squeeze("reply")).alias("ratio"))


VOCAB = f"""vc AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM tk) GROUP BY token HAVING count(*) >= 2),
vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 5 AS id, n FROM vc WHERE token NOT IN ('[PAD]', '[BOS]', '[MASK]', '[UNK]', '[EOS]', '<empty>')
ORDER BY n DESC, token LIMIT 494)"""
SPECIALS = ", ".join(f"('{s}', {i})" for i, s in enumerate(tx.SPECIAL_TOKENS))


def vocabulary(t: Tables):
    return vo.token_vocabulary(t.texts, tx.tokens_or_empty("text"), size=500, min_frequency=2)


@query("D25", f"""WITH {TOKENS}, {VOCAB} SELECT token, id, n FROM vocab UNION ALL SELECT v.token, v.id, 0 FROM (VALUES {SPECIALS}) v(token, id)""")
def token_vocabulary(t: Tables):
    return vocabulary(t)


@query("H16 A20", f"""WITH {TOKENS}, {VOCAB}, e AS (SELECT doc_id, i, coalesce(id, 3) AS id FROM (SELECT doc_id, unnest(tokens[1:30]) AS token,
unnest(range(1, least(len(tokens), 30) + 1)) AS i FROM (SELECT doc_id, CASE WHEN len(tokens) = 0 THEN ['<empty>'] ELSE tokens END AS tokens FROM tk))
LEFT JOIN (SELECT token, id FROM vocab UNION ALL SELECT '<empty>', 5) USING (token)),
a AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) AS body, count(*) AS n FROM e GROUP BY doc_id)
SELECT doc_id, CAST(n + 2 AS INTEGER) AS length, '1,' || body || ',4' || repeat(',0', CAST(30 - n AS INTEGER)) AS ids FROM a""")
def fixed_width_token_arrays(t: Tables):
    out = vo.encode_tokens(t.texts, "doc_id", tx.tokens_or_empty("text"), vocabulary(t), 32)
    return out.select("doc_id", "length", F.array_join(F.transform("ids", lambda v: v.cast("string")), ",").alias("ids"))


@query("H16")
def decoded_token_arrays(t: Tables):
    """Token arrays back to text, with special tokens dropped and spacing restored."""
    v = vocabulary(t)
    return vo.decode_tokens(vo.encode_tokens(t.texts, "doc_id", tx.tokens_or_empty("text"), v, 32), "doc_id", "ids", v)


@query("D24", """WITH c AS (SELECT coalesce(lang, '<missing>') AS token, count(*) AS n FROM documents GROUP BY 1)
SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id, n FROM c UNION ALL SELECT '<missing>', 0, 0""")
def language_vocabulary(t: Tables):
    return vo.category_vocabulary(t.documents, "lang")


@query("D24", """WITH c AS (SELECT CASE WHEN doc_id % 10 = 0 THEN '<missing>' ELSE source END AS token, count(*) AS n FROM documents GROUP BY 1),
v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM c)
SELECT d.doc_id, coalesce(v.id, 0) AS source_id FROM documents d LEFT JOIN v ON v.token = CASE WHEN doc_id % 10 = 0 THEN NULL ELSE source END OR (doc_id % 10 = 0 AND v.token = '<missing>')""")
def encoded_sources(t: Tables):
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("source"))
    return vo.encode_category(d, "source", vo.category_vocabulary(d, "source"), "source_id").select("doc_id", "source_id")


@query("H17", """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events""")
def json_property(t: Tables):
    parsed = F.from_json("props", "k long")
    return t.events.select("event_id", parsed["k"].alias("k"))


@query("H17", """SELECT c_custkey, name, value FROM (SELECT c_custkey, unnest([{'name': 'place.nation', 'value': CAST(c_nationkey AS VARCHAR)}, {'name': 'place.market.segment', 'value': c_mktsegment},
{'name': 'place.market.codes', 'value': '[' || c_nationkey || ',' || c_custkey || ']'}], recursive := true) FROM customer)""")
def dotted_customer_records(t: Tables):
    from chronoweave.sources.tables import dotted_records

    market = F.struct(F.col("c_mktsegment").alias("segment"), F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey").cast("long")).alias("codes"))
    return dotted_records(t.customer.select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), market.alias("market")).alias("place")), "c_custkey")


@query("B14", f"""WITH {TEXTS} SELECT doc_id, CAST(length(s) AS INTEGER) AS chars FROM (SELECT doc_id, {squeeze_sql("CASE WHEN doc_id % 3 = 0 THEN '  ' || chr(10) ELSE text END")} AS s FROM texts)
WHERE length(s) > 0""")
def non_empty_texts(t: Tables):
    from chronoweave.operators.clean import with_text

    d = t.texts.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("  \n")).otherwise(F.col("text")))
    return with_text(d, "text").select("doc_id", F.length("text").alias("chars"))
