"""One query an operator, with production parameters, over the whole table; and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_and_decode
from .common import documents, shared_folder
from .exact_dedup import exact_dedup, split_by_id
from .hard_negatives import hard_negatives
from .line_dedup import fuzzy_lines
from .packing import pack_documents
from .periodic_runs import periodic_runs
from .pii import find_spans
from .quality import BOILERPLATE, clean_lines
from .sharding import assign_shards, shard_names
from .simhash import simhash_components
from .substring_dedup import remove_repeated_windows
from .token_files import read_token_files, write_token_files
from .toxicity import fit, score


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(documents(spark, sf_dir)).drop("intervals")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(*split_by_id(documents(spark, sf_dir))).drop("screened")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(documents(spark, sf_dir)).drop("clean_text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(documents(spark, sf_dir)).drop("selected")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), "doc_id", shard_names(), fallback="text").select("doc_id", "slot", "shard")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_and_decode(documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN, with_ids=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    noisy = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(noisy, F.col("vec_id") % 100 == 0)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder, with_ids=False)


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's planting: one document in ten, by its id's crc32, repeats a stretch of its own to its end."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(documents(spark, sf_dir), planted_period)
    # the longest run, ties by least start, then period
    best = F.expr("reduce(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (a, r) -> "
                  "if(a is null or r.length > a.length or (r.length = a.length and (r.start, r.period) < (a.start, a.period)), r, a))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    d = found.withColumn("best", best)
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_toxicity, op3_exact_dedup, op4_quality_rules, op5_line_dedup, op6_best_fit_packing, op7_simhash_near_dedup, op8_pii,
        op9_sharding, op10_byte_bpe, op11_hard_negatives, op12_token_files, op13_periodic_runs,
    )
}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t),
m AS (SELECT (min(doc_id) + max(doc_id)) // 2 AS mid FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256,
       CASE WHEN doc_id <= mid THEN 'snapshot' ELSE 'batch' END AS part
FROM d JOIN g USING (t), m
""",
    "op4_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, x FROM d, unnest(string_split(t, chr(10))) AS u(x) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
m AS (SELECT doc_id, x, lower(x) AS low, length(x) AS chars,
        greatest(1, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))) AS n,
        length(x) - length(regexp_replace(x, '[#*$%&|<>{}]', '', 'g')) AS symbols,
        length(x) - length(regexp_replace(x, '!!', '', 'g')) AS shouts,
        length(x) - length(regexp_replace(x, '[|>»›·•]', '', 'g')) AS bars FROM l),
f AS (SELECT doc_id, x, NOT regexp_matches(low, '[.!?:;,…。！？"”»)]([\x20\x09-\x0D]|$)') OR symbols * 10 > chars OR shouts > n
        OR (bars >= 3 AND n <= 5 * (bars + 1)) OR (n <= 30 AND (PHRASES)) AS bad FROM m),
q AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines, count(*) FILTER (bad) AS n_bad_lines,
        CAST(coalesce(sum(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (bad), 0) AS BIGINT) AS bad_chars FROM f GROUP BY 1),
b AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad_lines, 0) AS n_bad_lines,
        coalesce(bad_chars, 0) AS bad_chars FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN q USING (doc_id)),
z AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND bad_chars <= 0.5 * word_chars AS kept FROM z
""".replace("PHRASES", " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)),
}
