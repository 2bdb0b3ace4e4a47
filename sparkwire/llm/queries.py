"""Queries opN_<name> over the whole tables of a folder, and the SQL that some of them can be held against."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, language, lengths, mixing, packing, repetition, sharding, simhash, suffix, toxicity
from .common import shared_dir, stash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null id belongs to no fold (-1)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(-1))


def utf8(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=fold(3) != 1)
    out = toxicity.classify(docs, model, carry=["doc_id", "lang"])
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "rejected")


def op2_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 12 old shards filled source by source to 16 of equal bytes, written as files; what is told is read from these.

    Law `bytes`: shards' sizes are near equal, whichever shards equal texts are in (they may part)."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", (F.octet_length(utf8("text")) + 1).cast("long").alias("size"), F.crc32(utf8("text")).alias("text_crc32"), F.pmod(F.crc32(utf8("source")), F.lit(12)).cast("int").alias("was"))
    out, moves = sharding.reshard(rows, F.col("was"), 16, key_cols=("doc_id", "text_crc32"))
    out = out.select("doc_id", "text", "old_shard", "shard", "slot")
    path = f"{shared_dir(spark)}/layout-{uuid.uuid4().hex}"
    sharding.rewrite(out, moves, path)
    files = sharding.read_layout(spark, path, out.schema)
    size, crc = (F.octet_length(utf8("text")) + 1).cast("long"), F.crc32(utf8("text"))
    return files.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.repetition_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.drop("covered_chars", "longest_repeat")


def op4_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(lengths.encoded_lengths(table(spark, sf_dir, "documents"), carry=["doc_id"])))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, learn=fold(4) != 2)
    return language.identify(docs, model, carry=["doc_id"]).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


#: A three-level tree for the query: domains of sources by a hash of the name, then languages, then sources.
DOMAINS = ["books", "code", "web"]
WEIGHTS = {"domain": {"books": 3, "code": 2, "web": 5}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    domain = F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (F.crc32(utf8("source")) % len(DOMAINS) + 1).cast("int"))
    rows = docs.select("doc_id", domain.alias("domain"), "lang", "source", mixing.count_words("text").alias("n_tokens"))
    out, _ = mixing.mix(stash(rows, "words"), ["domain", "lang", "source"], WEIGHTS, share=0.6, max_epochs=2, seed=13)
    return out


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"], digest=True)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = ann.build(vectors)
    queries = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return ann.search(index, queries)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_reshard, op3_repetition, op4_token_lengths, op5_language, op6_mixing, op7_simhash, op8_packing, op9_suffix, op10_neighbours)}

_L = repetition.Limits()
#: Word windows found twice stand for repeats: a repeat of n words is a window of n words found twice.
ORACLE = {
    "op3_repetition": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
u AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT rid, i, word,
  string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g5,
  string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {_L.min_repeat - 1} FOLLOWING) AS g10,
  md5(string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {_L.max_longest} FOLLOWING)) AS g61,
  count(*) OVER (PARTITION BY rid) AS n FROM u),
r AS (SELECT rid, i, word,
  (i + 4 <= n AND count(*) OVER (PARTITION BY rid, g5, i + 4 <= n) > 1)::INT AS r5,
  (i + {_L.min_repeat - 1} <= n AND count(*) OVER (PARTITION BY rid, g10, i + {_L.min_repeat - 1} <= n) > 1)::INT AS r10,
  (i + {_L.max_longest} <= n AND count(*) OVER (PARTITION BY rid, g61, i + {_L.max_longest} <= n) > 1)::INT AS r61 FROM g),
c AS (SELECT rid, word, r61,
  max(r5) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5,
  max(r10) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {_L.min_repeat - 1} PRECEDING AND CURRENT ROW) AS c10 FROM r),
s AS (SELECT rid, sum(c5) AS n_repeat_words, sum(c10 * length(word)) AS covered, max(r61) AS far FROM c GROUP BY rid),
l AS (SELECT rid, sum(k - 1) AS n_dup_lines FROM (
  SELECT rid, line, count(*) AS k FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid, line) GROUP BY rid),
a AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(covered, 0) AS covered, coalesce(far, 0) AS far FROM w LEFT JOIN s USING (rid) LEFT JOIN l USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.max_window_pct} * n_words AS base_failed,
  NOT (n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.max_window_pct} * n_words)
    AND covered <= {_L.max_covered} * word_chars AND far = 0 AS kept FROM a""",
}
