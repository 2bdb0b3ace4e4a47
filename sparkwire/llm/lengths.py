"""Exact histogram of encoded lengths; suffix sums answer for every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import map_text, stash

#: Lengths that share a block of the two-level suffix sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, text_col: str = "text", path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """Adds n_tokens (long) for each whole text; null and empty texts have 0. Rows keep their order and number."""
    path = path or tokens.default_path()

    def kernel():
        enc = tokens.encoder(path)
        return lambda texts: [pa.array([len(enc.ids(t)) >> 2 for t in texts.to_pylist()], pa.int64())]

    return map_text(docs, kernel, [T.StructField("n_tokens", T.LongType())], text_col, carry)


def histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """(length, n_docs): partial counts meet by length, so a hot length costs a row for each task. Null lengths count as 0."""
    return lengths.groupBy(F.coalesce(F.col(col), F.lit(0)).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram, taken as a context limit:

    n_docs; docs_at_least and tokens_at_least (documents of L tokens or more); docs_up_to; total_tokens of all
    documents; truncated_tokens, the sum of min(length, L); cdf, the share of documents of at most L tokens.
    Two levels: within blocks of BLOCK lengths, then over the blocks. An empty histogram gives no rows.
    """
    hist = stash(hist, "lengths")  # two levels read it, the texts are encoded once
    own = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("toks"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = own.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("toks").alias("b_toks"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        F.col("block"),
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("b_toks").over(after), F.lit(0)).alias("toks_after"),
        F.sum("b_docs").over(every).alias("all_docs"),
        F.sum("b_toks").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = own.select("length", "n_docs", "block", F.sum("n_docs").over(within).alias("d"), F.sum("toks").over(within).alias("t"))
    x = at.join(blocks, "block").withColumns({"docs_at_least": F.col("d") + F.col("docs_after"), "tokens_at_least": F.col("t") + F.col("toks_after")})
    docs_up_to = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return x.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least", docs_up_to.alias("docs_up_to"), "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        (docs_up_to / F.col("all_docs")).alias("cdf"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_tokens, docs_cut) for any limits, from the suffix sums alone."""
    out = sums.sparkSession.createDataFrame([], "context_limit long, truncated_tokens long, docs_cut long")
    for x in limits:
        c: Column = F.lit(int(x))
        out = out.unionByName(
            sums.where(F.col("length") > c)
            .agg(F.min_by("docs_at_least", "length").alias("d"), F.min_by("tokens_at_least", "length").alias("t"))
            .crossJoin(sums.agg(F.max("total_tokens").alias("all")))
            .select(c.cast("long").alias("context_limit"), (F.coalesce("all", F.lit(0)) - F.coalesce("t", F.lit(0)) + c * F.coalesce("d", F.lit(0))).cast("long").alias("truncated_tokens"), F.coalesce("d", F.lit(0)).alias("docs_cut"))
        )
    return out


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share q of the documents does not exceed."""
    return sums.where(F.col("cdf") >= q).agg(F.min("length").alias("length"))
