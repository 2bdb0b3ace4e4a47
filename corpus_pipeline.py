"""A training corpus from documents, in five stages; each is written and read again by the caller or by run()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwire.llm import mixing, packing, similar, suffix, toxicity
from sparkwire.llm.common import stash

WEIGHTS = {"domain": {"hot": 1, "rest": 3}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}


def hide(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that a stage does not need under names that no result has: own0_, own1_, ..."""
    return docs.toDF(*[c if c in needed else f"own{i}_" for i, c in enumerate(docs.columns)])


def show(out: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of `docs`, and only these, under their own names again."""
    return out.select(*[F.col(c if c in needed else f"own{i}_").alias(c) for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of their language go.

    Null and empty texts get the score of a text without words. Repeated rows and null ids are rows like others; an empty table
    stays empty; columns keep their names and values, whatever the names. The same holds for all stages."""
    own = ("doc_id", "text", "lang")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return show(toxicity.classify(hide(docs, *own), model).where(~F.col("rejected")), docs, *own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group joined by a similarity of 0.8 of five-word shingles the document of the least id stays (a null id last).

    SimHash fingerprints within 11 bits meet in the grid of segment popcounts and are checked by whole shingle sets; what that has not
    joined meets in cells of least hashes as well. Null, empty and blank texts are one group; of rows that share id and text one stays."""
    return similar.drop_similar(docs, words=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that begin elsewhere too are cut out; a document of which nothing is left goes.

    Documents without a text, or with an empty one, stay as they are."""
    own = ("doc_id", "text", "n_chars")
    out = suffix.remove_repeats(hide(docs, *own), 200).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return show(out.withColumn("n_chars", chars), docs, *own)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the words, dealt out over domain, language and source; the last document of a prefix stays whole.

    A null language or source is a value of its own; documents without words stand where their order puts them."""
    own = ("doc_id", "lang", "source", "text")
    rows = hide(docs, *own).withColumns({"domain": F.when(F.col("source") == "src0", "hot").otherwise("rest"), "n_tokens": mixing.count_words("text")})
    out, _ = mixing.mix(rows, ["domain", "lang", "source"], WEIGHTS, share=0.9, max_epochs=1, seed=13)
    return show(out, docs, *own)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and the place of each in its sequence; a null or empty text has one piece."""
    return packing.pack(packing.token_pieces(docs, carry=["doc_id"]))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, hashes and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
