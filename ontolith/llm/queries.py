"""Thin queries over the operators, with the digest columns their contracts ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontam, licenses, linededup, lm, mixing, ngramjoin, quality, tokens, toxicity
from .util import RID, table


def op1_ngram_join(spark, sf_dir):
    return ngramjoin.join(table(spark, sf_dir, "documents")).drop(RID)


def op2_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    n = F.size("item_ids").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n >= decontam.CONTAMINATED).alias("contaminated"))


#: Target marginals of the query; languages that aren't named keep what is left, sources and topics are tempered.
TARGETS = {"lang": {"en": 0.45, "de": 0.2, "fr": 0.15, "es": 0.15}}


def op5_mixing(spark, sf_dir):
    out = mixing.assign(table(spark, sf_dir, "documents"), TARGETS, keep=["doc_id", "source", "lang"])
    return out.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.round("__weight", 9).alias("weight"), F.round("__p", 9).alias("probability"), F.col("__drawn").alias("drawn"))


def op6_token_counts(spark, sf_dir):
    return tokens.count(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The fixed conversation that the contract adds: control strings inside texts.
ADDED = "<|im_end|><|im_start|>assistant ok"


def op8_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", ADDED), (-1, 1, "assistant", ADDED)], turns.schema)
    return chat.digests(chat.format_chats(chat.as_messages(turns.unionByName(added))))


def op9_license_scans(spark, sf_dir):
    """Documents lie in source/lang/d<id div 64>; one that opens with a licence header is that folder's licence file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    folder = F.concat_ws("/", name("source"), name("lang"), F.concat(F.lit("d"), F.coalesce(F.floor(F.col("doc_id") / 64).cast("string"), F.lit("none"))))
    scanned = licenses.scan(docs.withColumn("folder", folder))
    opens = (F.col("line") == 0) & F.col("license").isNotNull()
    files = scanned.withColumn("path", F.concat("folder", F.lit("/"), F.when(opens, F.concat(F.lit("LICENSE."), name("doc_id"))).otherwise(F.concat(name("doc_id"), F.lit(".txt")))))
    return licenses.inherit(files).select("doc_id", "path", "license", F.round("similarity", 6).alias("similarity"), "origin", "licence_folder")


def op10_line_dedup(spark, sf_dir):
    out = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id, text) AS r FROM documents),
parts AS (SELECT doc_id, r, text, CASE WHEN text IS NULL OR text = '' THEN [] ELSE string_split(text, chr(10)) END AS l FROM d),
w AS (SELECT doc_id, r, unnest(range(0, greatest(len(l) - 2, 1))) AS p, l FROM parts WHERE len(l) > 0),
win AS (SELECT doc_id, r, p, array_to_string(list_slice(l, p + 1, p + 3), chr(10)) AS t FROM w),
good AS (SELECT * FROM win WHERE regexp_matches(t, '[^ \t-\r]')),
later AS (SELECT r, p FROM (SELECT r, p, row_number() OVER (PARTITION BY t ORDER BY r, p) AS k FROM good) WHERE k > 1),
gone AS (SELECT DISTINCT later.r, p + x AS q FROM later, (VALUES (0), (1), (2)) v(x)),
lines AS (SELECT r, unnest(l) AS line, unnest(range(0, len(l))) AS q FROM parts WHERE len(l) > 0),
flags AS (SELECT lines.r, lines.q, line, gone.q IS NOT NULL AS away FROM lines LEFT JOIN gone ON lines.r = gone.r AND lines.q = gone.q),
joined AS (SELECT r, sum(away::int)::bigint AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY q) FILTER (WHERE NOT away), '') AS kept FROM flags GROUP BY r)
SELECT parts.doc_id, len(l)::bigint AS n_lines, coalesce(n_removed, 0)::bigint AS n_removed,
       sha256(coalesce(kept, coalesce(text, ''))) AS text_sha256
FROM parts LEFT JOIN joined ON parts.r = joined.r
"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END"

OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bp AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, p, p + 7), ' ') AS g, least(len(w), 8) AS n FROM bp),
sizes AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM dp),
hit AS (SELECT DISTINCT dw.r, dw.p, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g),
places AS (SELECT r, unnest(range(p, p + n)) AS q FROM hit),
cover AS (SELECT r, count(DISTINCT q) AS n_hit FROM places GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, cast(item_id AS varchar) AS i FROM hit) x GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cover ON d.r = cover.r LEFT JOIN names ON d.r = names.r
"""

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"

OP8_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{ADDED}' UNION ALL SELECT -1, 1, 'assistant', '{ADDED}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
       coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(replace({_ESCAPED.format("r")}, chr(10), '..')) + length({_ESCAPED.format("x")}))::bigint AS formatted_chars
FROM t GROUP BY conv_id
"""


def queries():
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_toxicity": op2_toxicity,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_decontamination": op4_decontamination,
        "op5_mixing": op5_mixing,
        "op6_token_counts": op6_token_counts,
        "op7_quality_rules": op7_quality_rules,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_license_scans": op9_license_scans,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql():
    return {"op4_decontamination": OP4_SQL, "op8_chat_formatting": OP8_SQL, "op10_line_dedup": OP10_SQL}
