"""Queries of the operators over their whole tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import (
    decontam,
    embeddings,
    linededup,
    linerules,
    minhash,
    packing,
    passages,
    periodic,
    quality,
    sharding,
    spelling,
    tokenfiles,
    warc,
)
from scriptmill.llm.common import table
from scriptmill.plans.registry import query

N_SHARDS = 24
END_ID = 2

# CRC-32 of the UTF-8 bytes, by the table of the reversed polynomial that a rule builds.
CRC32 = """
crc_table AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
summed AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255)::INT + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc_table)
"""


@query("op1_sharding", f"""
WITH {CRC32},
placed AS (
  SELECT doc_id, size, text_crc32, ((2 * sum(size) OVER w - size) * {N_SHARDS} // (2 * sum(size) OVER ()))::INT AS shard
  FROM summed WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  NULL::INT AS grown_shard
FROM placed
""")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(spark, table(spark, sf_dir, "documents"), N_SHARDS)


@query("op3_minhash")
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


@query("op2_warc", """
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS original FROM pages)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < original THEN original END AS refers_to
FROM sized
""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.without_repeated_chunks(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"),
                       F.col("__removed").alias("removed"), F.col("text").alias("kept_text"))


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return tokenfiles.token_files(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


@query("op4_embeddings")
def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark, table(spark, sf_dir, "embeddings"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_scores(spark, docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
                         F.col("__predicted").alias("predicted"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    near = minhash.near_duplicates(spark, docs).filter("n_shingles > 0 and doc_id is not null").groupBy(
        F.col("doc_id").alias("d")).agg(F.min("component_id").alias("component"))
    rows = docs.join(near, F.col("doc_id") == F.col("d"), "left")
    own = packing.same_text(F.coalesce("text", F.lit("")))
    return packing.pack(spark, rows.withColumn("cluster", F.coalesce("component", own)), cluster="cluster")


@query("op10_passages")
def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(spark, table(spark, sf_dir, "documents"))


WORDS = "[^\\x20\\x09-\\x0D]+"
ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op13_line_rules", f"""
WITH d AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
base AS (
  SELECT doc_id, source, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM documents),
worded AS (
  SELECT doc_id, source, text, line, regexp_extract_all(translate(translate(line, {ABC}), '123456789', '000000000'), '{WORDS}') AS w
  FROM lines WHERE regexp_matches(line, '{WORDS}')),
repeats AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM worded GROUP BY doc_id),
windows AS (SELECT doc_id, i, w[i:i + 4] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(5)) AS r(k) GROUP BY doc_id),
normal AS (
  SELECT source, text, array_to_string(w, ' ') AS norm, sum(len(w)) // count(DISTINCT doc_id) AS n FROM worded GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT text) AS total FROM normal GROUP BY source),
common AS (
  SELECT source, norm FROM (SELECT source, norm, count(*) AS n FROM normal GROUP BY ALL) AS c JOIN hosts USING (source)
  WHERE c.n > {linerules.COMMON_DOCS} AND c.n * 100 > total * {linerules.COMMON_SHARE}),
lost AS (SELECT source, text, sum(n)::BIGINT AS lost FROM normal JOIN common USING (source, norm) GROUP BY ALL),
counted AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(repeats.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    n_words - coalesce(lost, 0) AS words_left
  FROM base LEFT JOIN repeats USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (source, text))
SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
  NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20)
    AND words_left >= 10 AND words_left * 100 >= n_words * {linerules.LEFT_SHARE} AS kept
FROM counted
""")
def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.line_rules(spark, table(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_periods(table(spark, sf_dir, "documents"))
    return periodic.digests(periodic.periodic_runs(spark, docs))


LETTERS = "a-zÀ-ÿ"


@query("op11_spelling_variants", f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {ABC}), '[{LETTERS}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS m FROM found WHERE length(run) >= 6 GROUP BY ALL),
keyed AS (
  SELECT run, m, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255)::INT + 1])), 4294967295::BIGINT) AS h
  FROM counted, crc_table),
planted AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, m
  FROM keyed),
vocabulary AS (SELECT word, sum(m)::BIGINT AS n FROM planted WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM vocabulary, unnest(range(1, length(word) + 1)) AS r(i)),
links AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut AS a JOIN cut AS b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail
  WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM cut AS a JOIN vocabulary AS b ON a.head || a.tail = b.word
  UNION SELECT b.word, a.word, a.n FROM cut AS a JOIN vocabulary AS b ON a.head || a.tail = b.word),
ranked AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n FROM links
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
formed AS (
  SELECT word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM vocabulary LEFT JOIN ranked USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON formed.word = chain.next)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spark, table(spark, sf_dir, "documents"), drop_one_in=199)
