"""Registered queries of the text operators: each applies one operator, with its production
parameters, to its whole table.  ``ORACLES`` holds DuckDB SQL where SQL can express the rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (bpe, chat, collocations, decontam, exact_dedup, hard_negatives, langid, license_scan, neardup, quality,
                           simhash, substring, token_io)
from faultline.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


@query("op7_bpe_round_trip")
def op7(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS)


@query("op8_huffman_token_files")
def op8(spark, sf_dir):
    path = folder(spark, "huffman")
    token_io.write(table(spark, sf_dir, "documents"), path, TOKENIZER, end_id=2)
    return token_io.read(spark, path, digest=True)


@query("op2_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op2(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op6_benchmark_decontamination", r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
           FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
      FROM benchmark),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS win
       FROM (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
             FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS win
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i
             FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
o AS (SELECT DISTINCT doc_id, i, l, item_id FROM dw JOIN bw USING (win, l)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op6(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_minhash_near_dedup")
def op9(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_substring_dedup", r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lo FROM win) WHERE doc_id > lo),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op5(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


@query("op3_quality_classifier")
def op3(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_language_id")
def op4(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents")).drop("spans")


@query("op10_chat_format", """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
f AS (SELECT *, 4 + length(replace(replace(replace(replace(role, '\\', '\\b'), '#', '\\h'), '</turn>', '\\l/turn>'), chr(10), '\\n')) + 1
             + length(replace(replace(replace(text, '\\', '\\b'), '#', '\\h'), '</turn>', '\\l/turn>')) + 8 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""")
def op10(spark, sf_dir):
    said = F.lit("\\### Assistant: </turn> ok")
    turn = F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role")
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), turn).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    path = folder(spark, "conversations")
    chat.format_conversations(chat.log_of_rows(rows), path)
    return chat.digests(chat.read_conversations(spark, path))


def _license_oracle() -> str:
    """The same cutting, tables and rules in RE2 patterns, which have no look-around: a line end behind
    "version" is set aside for the list numbers, and tokens take the cut behind them along."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in license_scan.SENTENCES.items())
    said = "|".join(s.replace(" ", r"[ \n]") for s in sorted(license_scan.SENTENCES, key=len, reverse=True))
    owner = license_scan.OWNER.replace("++", "+")
    done = "seq"
    for name, ids in license_scan.RULES:
        done = f"replace({done}, '{''.join(f'<{i}>' for i in ids)}', '{{{name}}}')"
    cut = r"chr(10) || replace(lower(coalesce(text, '')), chr(13), chr(10)) || chr(10)"
    cut = f"replace({cut}, 'version' || chr(10), 'version' || chr(57344))"
    cut = rf"regexp_replace({cut}, '\n[^a-z0-9\n]*(?:[0-9]{{1,2}}|[a-z]|[ivx]{{2,4}})[.)][ \t]+', chr(10), 'g')"
    cut = f"replace({cut}, chr(57344), chr(10))"
    for pattern, put in ((r"[.!?][ \t\n]+", 13), (r";[ \t]+", 10)):
        cut = f"regexp_replace({cut}, '{pattern}', chr({put}), 'g')"
    cut = rf"""array_to_string(list_transform(regexp_extract_all({cut}, '[^\n\r]+|[\n\r]+'), lambda s:
                 CASE WHEN regexp_matches(s, '^[^a-z0-9\n\r]*$') AND regexp_matches(s, '[\p{{L}}\p{{N}}]') THEN '0' ELSE s END), '')"""
    for pattern, put in ((r"[^a-z0-9\n\r]+", "' '"), (r" ?\n[ \n]*", "chr(10)"), (r"[ \n]?\r[ \n\r]*", "chr(13)"),
                         (owner, f"'{license_scan.HOLDER}'")):
        cut = f"regexp_replace({cut}, '{pattern}', {put}, 'g')"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
s AS (SELECT doc_id, unnest(x) AS s, unnest(range(len(x))) AS p FROM (SELECT doc_id,
      list_filter(regexp_extract_all({cut}, '(?:{said})[\n\r]|[^\n\r]+[\n\r]?|[\n\r]'), lambda x: regexp_matches(x, '[^\n\r]')) AS x FROM documents)),
m AS (SELECT doc_id, p, id FROM (SELECT *, replace(regexp_replace(s, '[\n\r]$', ''), chr(10), ' ') AS sentence FROM s)
      LEFT JOIN known USING (sentence)),
q AS (SELECT doc_id, trim(regexp_replace(string_agg(coalesce('<' || id || '>', '|'), '' ORDER BY p), '\|+', '|', 'g'), '|') AS seq
      FROM m GROUP BY doc_id),
r AS (SELECT doc_id, seq, {done} AS done FROM (SELECT doc_id, coalesce(seq, '') AS seq FROM documents LEFT JOIN q USING (doc_id))),
l AS (SELECT doc_id, string_agg(name, ',' ORDER BY i) AS licenses FROM (SELECT doc_id, name, min(i) AS i FROM (
      SELECT doc_id, unnest(regexp_extract_all(done, '\{{([^}}]*)\}}', 1)) AS name,
             unnest(range(len(regexp_extract_all(done, '\{{([^}}]*)\}}', 1)))) AS i FROM r) GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, CAST(length(seq) - length(replace(seq, '<', '')) AS BIGINT) AS n_sentences, seq AS identifiers,
       coalesce(licenses, '') AS licenses, CAST(length(done) - length(replace(done, '<', '')) AS BIGINT) AS n_unresolved
FROM r LEFT JOIN l USING (doc_id)"""


@query("op1_license_scan", _license_oracle())
def op1(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op11_simhash_near_dedup")
def op11(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query("op12_hard_negatives", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10""")
def op12(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


@query("op13_phrase_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[ 	]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m))
      GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS w FROM g WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, a, k.m, k, x.f AS l, y.f AS r, CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS score
      FROM k JOIN g x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ')
      JOIN g y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:k.m], ' ')
      QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM s JOIN t USING (lang)
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = s.lang AND c.m > s.m AND 100 * c.a >= 80 * s.a
                  AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000""")
def op13(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
