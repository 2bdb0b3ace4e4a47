"""Hierarchical budgets over a tree of columns, and token-prefixes of seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_by_position, stash

#: Key of a null level value; a level column is compared as text.
NULL = "\u0000null"
WORD = r"[^\x20\x09-\x0D]+"


def count_words(col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def allocate(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: Column, cap: str = "cap") -> DataFrame:
    """Adds alloc (double) to leaves that hold the columns `levels` and a capacity.

    From the root down each node's budget is dealt to its children by weight (weights[level][value], a whole number,
    1 if absent, 0 shuts a subtree). A child gets no more than its leaves can give; what it lacks goes to its siblings
    in proportion, and only what a whole family lacks goes to the families beside it: a node's capacity is the
    sum of its leaves', so an ancestor's siblings are asked last. In order of capacity / weight the children up to the
    first that is not full are full, and the rest share what is left: window functions, no loop.
    """
    x = leaves
    for name in levels:
        table = weights.get(name) or {}
        w: Column = F.lit(1)
        if table:
            w = F.coalesce(F.create_map(*[F.lit(v) for k, n in table.items() for v in (k, int(n))])[F.col(name)], F.lit(1))
        x = x.withColumn(f"w_{name}", w.cast("double"))
    open_ = F.lit(True)
    for name in levels:
        open_ = open_ & (F.col(f"w_{name}") > 0)
    x = x.withColumn("cap_", F.when(open_, F.col(cap)).otherwise(0).cast("double"))
    nodes = x.agg(F.least(budget.cast("double"), F.coalesce(F.sum("cap_"), F.lit(0.0))).alias("alloc")).withColumn("root_", F.lit(0))
    parents = ["root_"]
    x = x.withColumn("root_", F.lit(0))
    for name in levels:
        keys = [*parents, name]
        kids = x.groupBy(*keys, f"w_{name}").agg(F.sum("cap_").alias("c")).withColumnRenamed(f"w_{name}", "w").join(nodes, parents)
        kids = kids.withColumn("w", F.when(F.col("c") > 0, F.col("w")).otherwise(0.0)).withColumn("r", F.when(F.col("w") > 0, F.col("c") / F.col("w")).otherwise(0.0))
        by = Window.partitionBy(*parents).orderBy("r", name)
        full = F.coalesce(F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        open_w = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        kids = kids.withColumn("lam", F.when(open_w > 0, (F.col("alloc") - full) / open_w))
        first = F.min(F.when(F.col("r") > F.col("lam"), F.struct("r", name, "lam"))).over(Window.partitionBy(*parents))
        kids = kids.withColumn("level", first["lam"])
        nodes = kids.select(*keys, F.when(F.col("level").isNull(), F.col("c")).otherwise(F.least(F.col("c"), F.col("w") * F.col("level"))).alias("alloc"))
        parents = keys
    return leaves.join(nodes.drop("root_"), levels, "left").withColumn("alloc", F.coalesce("alloc", F.lit(0.0)))


def mix(
    docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int | None = None, share: float | None = None,
    tokens_col: str = "n_tokens", key_cols: tuple[str, ...] = ("doc_id",), max_epochs: int = 2, seed: int = 0, docs_per_bucket: int = 1024,
) -> tuple[DataFrame, DataFrame]:
    """(chosen rows with epoch, start and taken; leaves with supply, quota and epochs).

    budget: tokens in all, or share: of all tokens. A leaf may be read max_epochs times. Each epoch of a leaf is its documents in the order of md5(seed:epoch:key); the leaf's quota is a
    prefix of its epochs' tokens: whole epochs, then the documents that begin before the rest is reached (`taken`: how many of
    the document's tokens lie in the prefix, fewer than all for the last). start: tokens before it in its epoch, for
    the partial epoch's documents (null in whole epochs). Documents without tokens are chosen in whole epochs only, or where
    they stand before the end of the prefix. Levels are compared as text, a null is a value of its own; null keys and
    repeated rows are ordered like others. Quotas are whole numbers that differ from the leaves' shares by less than one and add
    up to the budget, or to all there is. Ends of prefixes are found from sums by bucket of the order, so no leaf is sorted in
    one task: only its last bucket is. Columns of any name are kept; one named epoch, start or taken gives way to the result. An
    empty table gives empty results.
    """
    if (budget is None) == (share is None):
        raise ValueError("give budget or share")
    docs, own = columns_by_position(docs)
    place = {c: f"c{own.index(c)}" for c in (*levels, tokens_col, *key_cols)}
    made = {"epoch", "start", "taken"}
    out, report = _mix(docs, [place[c] for c in levels], {place[c]: w for c, w in weights.items() if c in place}, budget, share, place[tokens_col], tuple(place[c] for c in key_cols), max_epochs, seed, docs_per_bucket)
    out = out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(own) if n not in made], *[c for c in out.columns if c in made])
    return out, report.select(*[F.col(place[c]).alias(c) for c in levels], "supply", "docs", "quota", "epochs")


def _mix(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int | None, share: float | None, tokens_col: str, key_cols: tuple[str, ...], max_epochs: int, seed: int, docs_per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """mix() of columns c0, c1, ..."""
    names = docs.columns
    lv = [f"lv{i}_" for i in range(len(levels))]
    x = docs.withColumns({lv[i]: F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for i, c in enumerate(levels)}).withColumn("tok_", F.greatest(F.coalesce(F.col(tokens_col), F.lit(0)), F.lit(0)).cast("long"))
    supply = x.groupBy(*lv).agg(F.sum("tok_").alias("supply"), F.count(F.lit(1)).alias("docs"))
    supply = stash(supply.withColumn("cap", F.col("supply") * max_epochs), "leaves")
    total = supply.agg(F.sum("supply").alias("s")).first()["s"] or 0
    want = int(budget if budget is not None else total * share)
    named = {lv[i]: weights.get(c, {}) for i, c in enumerate(levels)}
    leaf = stash(allocate(supply, lv, named, F.lit(want)), "shares")
    upto = F.sum("alloc").over(Window.orderBy(*lv).rowsBetween(Window.unboundedPreceding, 0))  # one row a leaf
    leaf = leaf.withColumn("upto", F.floor(upto + 1e-6)).withColumn("quota", F.least("cap", F.col("upto") - F.coalesce(F.lag("upto").over(Window.orderBy(*lv)), F.lit(0))).cast("long")).drop("upto")
    whole = F.when(F.col("supply") > 0, F.expr("quota div supply")).otherwise(0).cast("int")
    leaf = leaf.withColumn("full_", whole).withColumn("rest_", F.col("quota") - F.col("full_") * F.col("supply"))
    leaf = stash(leaf.withColumn("nb_", F.greatest(F.lit(1), F.ceil(F.col("docs") / docs_per_bucket))).drop("alloc", "cap"), "quota")
    x = x.join(leaf, lv)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]))
    x = x.withColumn("md_", digest).withColumn("bk_", F.floor(F.conv(F.substring("md_", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.col("nb_")).cast("long"))
    sums = x.groupBy(*lv, "bk_").agg(F.sum("tok_").alias("t"))
    run = Window.partitionBy(*lv).orderBy("bk_").rowsBetween(Window.unboundedPreceding, -1)
    sums = stash(sums.select(*[F.col(c).alias(f"s{c}") for c in lv], F.col("bk_").alias("sbk_"), "t", F.coalesce(F.sum("t").over(run), F.lit(0)).alias("before_")), "buckets")
    near = sums.join(leaf.select(*[F.col(c).alias(f"s{c}") for c in lv], "rest_"), [f"s{c}" for c in lv])
    near = near.where(F.col("before_") < F.col("rest_")).drop("rest_")
    on = [F.col(c) == F.col(f"s{c}") for c in lv] + [F.col("bk_") == F.col("sbk_")]
    part = x.join(near, on).drop(*[f"s{c}" for c in lv], "sbk_")
    within = Window.partitionBy(*lv, "bk_").orderBy("md_", "tok_").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("start", F.col("before_") + F.sum("tok_").over(within) - F.col("tok_")).where(F.col("start") < F.col("rest_"))
    part = part.select(*names, F.col("full_").alias("epoch"), "start", F.least(F.col("tok_"), F.col("rest_") - F.col("start")).alias("taken"))
    once = x.where("full_ > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full_") - 1)))
    once = once.select(*names, "epoch", F.lit(None).cast("long").alias("start"), F.col("tok_").alias("taken"))
    report = leaf.select(*[F.col(lv[i]).alias(levels[i]) for i in range(len(levels))], "supply", "docs", "quota", (F.col("quota") / F.when(F.col("supply") > 0, F.col("supply"))).alias("epochs"))
    return part.unionByName(once), report
