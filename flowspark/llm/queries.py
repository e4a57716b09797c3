"""Each operator of the subpackage applied to its whole table, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, id_output, mixing, pii, quality, sharding, simhash, substring_dedup, suffix_dedup, token_count
from ._shared import scratch

#: The tokenizer's file; None stands for the installed public vocabulary.
TOKENIZER: str | None = None


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Setting with the secret key of pseudonyms; without it the test tables get one that is no secret.
PII_KEY_SETTING, TEST_KEY = "spark.flowspark.pii.key", "flowspark test tables"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix at 150% of the corpus takes of each document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by the word-level vocabulary."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def op3_compact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies once its arrivals are compacted, read back from the shards."""
    return sharding.placements(*sharding.sharded(table(spark, sf_dir, "documents"), scratch(spark, "shards")))


def op4_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids as its Simple-8b file gives them back: place, number and checksum."""
    ids = id_output.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each document without windows of 20 words that stand earlier."""
    kept = substring_dedup.deduplicated(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of each document."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with its personal data under pseudonyms, and how much there was of each kind."""
    return pii.pseudonyms(table(spark, sf_dir, "documents"), spark.conf.get(PII_KEY_SETTING, TEST_KEY).encode())


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand twice."""
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), least=50)


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in 2 bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, width=3)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document shares with the benchmark."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_token_counts, op3_compact_shards, op4_binary_ids, op5_substring_dedup, op6_quality_outliers, op7_pii_pseudonyms, op8_suffix_repeats, op9_simhash_groups, op10_decontaminate)}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
ranked AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
rounds AS (
  SELECT 0 AS round, source, source_size, weight, false AS capped, 1.5 * sum(source_size) OVER () AS budget FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight,
         capped OR weight * (budget - coalesce(sum(2.0 * source_size) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER () >= 2.0 * source_size,
         budget FROM rounds WHERE round < 64),
goals AS (
  SELECT source, source_size, CASE WHEN capped THEN 2.0 * source_size
         ELSE weight * (budget - coalesce(sum(2.0 * source_size) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER () END AS target
  FROM rounds WHERE round = 64)
SELECT doc_id, size, g.source_size, round(target, 6)::DOUBLE AS target,
       (size * (CASE WHEN g.source_size = 0 THEN 0 ELSE floor(target / g.source_size) + CASE WHEN ahead + size / 2.0 < (target / g.source_size - floor(target / g.source_size)) * g.source_size THEN 1 ELSE 0 END END))::BIGINT AS taken
FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source""",
    "op5_substring_dedup": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM grams) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_suffix_repeats": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(w[i:i + 49], ' '))) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
chained AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM runs WHERE n > 1),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM chained)
SELECT doc_id, min(i) - 1 AS start, max(i) + 50 - min(i) AS n_words FROM numbered GROUP BY doc_id, k""",
    "op10_decontaminate": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bench AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bench WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, i, item_id FROM grams JOIN windows USING (n, g)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN marked USING (doc_id) LEFT JOIN listed USING (doc_id)""",
}
