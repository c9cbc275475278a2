"""The operators as registered queries over a directory of test tables, and the DuckDB statements of those that SQL can
express. Vocabulary files come from the folder of ``vocabulary``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_table, exact_dedup, fill_middle, near_dedup, neighbours, ngram_join, packing, quality, secret_scan, spelling,
               token_files, toxicity, url_filter)
from .common import own_columns, work_folder

TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)


BYTE_BPE, WORD_BPE = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
PACKING_END, FILE_END = 1, 2


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return own_columns(table(spark, directory, "documents"), "doc_id", "text")


def op1_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    rows = exact_dedup.deduplicate(documents(spark, directory))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, directory))


def op3_quality(spark: SparkSession, directory: str) -> DataFrame:
    return quality.score_quality(documents(spark, directory), table(spark, directory, "labels"))


def op4_secrets(spark: SparkSession, directory: str) -> DataFrame:
    return secret_scan.scan(documents(spark, directory))


def op5_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return bpe_table.digests(documents(spark, directory), BYTE_BPE)


def op6_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, directory), table(spark, directory, "labels"))


def op7_token_files(spark: SparkSession, directory: str) -> DataFrame:
    folder = f"{work_folder(spark, 'tokens')}/ids"
    token_files.write_ids(documents(spark, directory), WORD_BPE, folder, FILE_END)
    return token_files.positions(spark, folder)


def op8_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    return neighbours.search(table(spark, directory, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack_documents(documents(spark, directory), BYTE_BPE, PACKING_END)


def op10_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    pages = own_columns(table(spark, directory, "pages"), "page_id", "url")
    return url_filter.judge(pages, url_filter.train(url_filter.examples(spark))).drop("score")


def op11_fill_middle(spark: SparkSession, directory: str) -> DataFrame:
    return fill_middle.digests(documents(spark, directory))


def op12_ngram_join(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_join.similar_documents(documents(spark, directory))


def op13_spelling(spark: SparkSession, directory: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, directory))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_near_dedup, op3_quality, op4_secrets, op5_bpe, op6_toxicity, op7_token_files, op8_neighbours,
    op9_packing, op10_url_filter, op11_fill_middle,
    op12_ngram_join, op13_spelling)}

ORACLE_SQL = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op2_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM items x JOIN items y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * shared >= 75 * (len(p.s) + len(q.s) - shared)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS doc, doc_id AS other FROM documents UNION SELECT doc, b FROM reach JOIN edges ON a = other),
heads AS (SELECT doc, min(other) AS component_id FROM reach GROUP BY doc)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept
FROM sets JOIN heads ON doc = doc_id
""",
    "op11_fill_middle": r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
tokens AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k
  FROM texts),
cuts AS (
  SELECT *, len(w) AS n, least(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS i, greatest(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS j,
    CASE WHEN doc_id IS NULL OR t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 90
         THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM tokens),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(w[:i], '') AS prefix, array_to_string(w[i + 1:j], '') AS middle,
    array_to_string(w[j + 1:], '') AS suffix
  FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
""",
    "op12_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM items x JOIN items y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * shared >= 80 * (len(p.s) + len(q.s) - shared)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS doc, doc_id AS other FROM documents UNION SELECT doc, b FROM reach JOIN edges ON a = other),
heads AS (SELECT doc, min(other) AS component_id FROM reach GROUP BY doc)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN heads ON doc = doc_id
""",
    "op13_spelling": r"""
WITH RECURSIVE
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
-- CRC-32 is linear: each byte adds a value that depends on it and on how many bytes follow.
bytes AS (SELECT b, list_reduce(list_concat([b], range(8)), lambda x, k:
                   CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
          FROM (SELECT unnest(range(256)) AS b)),
longest AS (SELECT max(strlen(CAST(doc_id AS VARCHAR)) + 1 + strlen(run)) AS size FROM runs),
adds AS (
  SELECT 0 AS behind, b, c FROM bytes UNION ALL
  SELECT behind + 1, a.b, xor(t.c, a.c >> 8) FROM adds a JOIN bytes t ON t.b = a.c & 255
  WHERE behind < (SELECT size FROM longest)),
begins AS (
  SELECT 0 AS size, 4294967295 AS z UNION ALL
  SELECT i.size + 1, xor(t.c, z >> 8) FROM begins i JOIN bytes t ON t.b = z & 255 WHERE i.size < (SELECT size FROM longest)),
spelled AS (SELECT doc_id, run, times, hex(doc_id || ':' || run) AS digits FROM runs),
each_byte AS (SELECT doc_id, run, times, digits, unnest(range(length(digits) // 2)) AS i FROM spelled),
hashes AS (
  SELECT doc_id, run, any_value(times) AS times, length(digits) // 2 AS size, bit_xor(c) AS x
  FROM each_byte JOIN adds ON b = CAST('0x' || substr(digits, 2 * i + 1, 2) AS BIGINT) AND behind = length(digits) // 2 - 1 - i
  GROUP BY doc_id, run, digits),
hashed AS (SELECT run, times, xor(xor(x, z), 4294967295) AS h FROM hashes JOIN begins USING (size)
           UNION ALL SELECT run, times, 1 FROM runs WHERE doc_id IS NULL),
results AS (
  SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
shorter AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.rest
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.rest),
ranked AS (
  SELECT near.word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS place
  FROM near JOIN words ON words.word = other),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN other END AS form,
    CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
paths AS (
  SELECT word, word AS last FROM forms UNION ALL
  SELECT paths.word, forms.form FROM paths JOIN forms ON forms.word = last WHERE forms.form IS NOT NULL)
SELECT forms.word, form, last AS root, n, n_near, form_n
FROM forms JOIN paths ON paths.word = forms.word
WHERE last IN (SELECT word FROM forms WHERE form IS NULL)
""",
}
