"""The operators applied to whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, grades, host_rules, language, mixing, nearcopies, neighbours, passages, pieces, suffixes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PLANTED_CHAT = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED_CHAT), (-7, 1, "assistant", PLANTED_CHAT)], "conv_id long, turn long, role string, text string")
    return chat_format.read_chats(chat_format.format_chats(convs.unionByName(extra)), ordered=True)


#: A public model file of the installed tokenizers; any other SentencePiece model can be named by WEFTLINK_PIECES.
PIECES = os.environ.get("WEFTLINK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, model, check_col="round_trip").withColumn("n_tokens", F.size("token_ids").cast("long"))


def op3_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.host_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def op4_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = language.held_out(F.col("doc_id"))
    model = language.learn(docs, ~apart)
    return language.identify(docs, model).select("doc_id", apart.alias("held_out"), "lang_pred", "score", "accepted")


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents"))


def op7_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", grades.graded(F.col("quality"), F.col("toxic")).alias("grade"))
    return grades.grade(docs, grades.learn(docs, ratings))


#: Domains of the labelled table and the token shares to reach.
TARGETS = {"toxic": 0.02, "low": 0.08, "high": 0.9}


def domains(labels: DataFrame) -> DataFrame:
    grade = grades.graded(F.col("quality"), F.col("toxic"))
    return labels.select("doc_id", F.element_at(F.array(*map(F.lit, TARGETS)), grade + 1).alias("domain"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS)


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_host_quality_rules": op3_host_quality_rules,
    "op4_prefix_free_dedup": op4_prefix_free_dedup,
    "op5_language_id": op5_language_id,
    "op6_superminhash": op6_superminhash,
    "op7_block_anchors": op7_block_anchors,
    "op8_ordinal_quality": op8_ordinal_quality,
    "op9_soft_mixing": op9_soft_mixing,
    "op10_permutation_index": op10_permutation_index,
}

ORACLES = {
    "op4_prefix_free_dedup": r"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS b FROM documents),
w AS (SELECT doc_id, i, md5(substring(b, 2 * i + 1, 800)) AS h FROM (SELECT doc_id, b, unnest(range(0, greatest(n - 399, 0))) AS i FROM d)),
s AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w SEMI JOIN s USING (h)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM
  (SELECT doc_id, i, (coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true))::INT AS new FROM r)),
p AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, run),
q AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, list(z ORDER BY a) AS zs, list(a ORDER BY a) AS sa FROM p GROUP BY doc_id),
k AS (SELECT doc_id, b, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_prepend(0, coalesce(zs, []::BIGINT[])) AS froms, list_append(coalesce(sa, []::BIGINT[]), n) AS tos FROM d LEFT JOIN q USING (doc_id)),
x AS (SELECT doc_id, unnest(froms) AS f, unnest(tos) AS t, unnest(range(1, len(froms) + 1)) AS o, b FROM k),
y AS (SELECT doc_id, string_agg(substring(b, 2 * f + 1, 2 * (t - f)), '' ORDER BY o) AS kept FROM x GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k JOIN y USING (doc_id)""",
    "op6_superminhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+3], ' ') || '|' || least(len(w), 4)) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, (len(w) > 0)::INT) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
l AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id WHERE r.root < l.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, min(root) = d.doc_id AS kept FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
    "op7_block_anchors": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 19, 0))) AS i FROM d),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(words[i+1:i+20], ' ')) ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1) GROUP BY doc_id),
k AS (SELECT doc_id, words, coalesce(gone, []::BIGINT[]) AS gone FROM d LEFT JOIN g USING (doc_id)),
t AS (SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
      coalesce((SELECT string_agg(w, ' ' ORDER BY p) FROM (SELECT unnest(words) AS w, unnest(range(0, len(words))) AS p, gone) x WHERE NOT list_contains(gone, p)), '') AS kept FROM k)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM t""",
    "op1_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, regexp_matches(text, '\\[\\<\[]|<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]|\[TURN\]|\[/TURN\]')
         OR (role NOT IN ('user', 'system') AND text LIKE '%\') AS escaped FROM c
), s AS (
  SELECT *, length(text) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 21 + length(role) END
         + CASE WHEN escaped THEN len(regexp_extract_all(text, '\\|<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]|\[TURN\]|\[/TURN\]')) ELSE 0 END AS chars FROM m
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars, sum(escaped::INT)::BIGINT AS n_escaped, 1::BIGINT AS n_parts
FROM s GROUP BY conv_id""",
    "op3_host_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(0, greatest(len(words) - 4, 0))) AS i, words FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i+1:i+5]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h WHERE n > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM f WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(n) AS n, sum(failed) AS f, count(*) AS k, sum(failed * failed / n) AS ff FROM hosts),
p AS (SELECT f / n AS mean, CASE WHEN k < 2 THEN 1.0 ELSE least(greatest((f / n) * (1 - f / n)
      / greatest((ff - (f / n) * (f / n) * n) / n - (f / n) * (1 - f / n) * k / n, 1e-6) - 1, 1.0), 1e6) END AS strength FROM s),
rates AS (SELECT source, (failed + mean * strength) / (n + strength) AS host_rate FROM hosts, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_rate, 0) <= 0.5 AS kept, round(host_rate, 6) AS host_rate
FROM f LEFT JOIN rates USING (source)""",
}
