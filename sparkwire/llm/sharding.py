"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new capacities."""

from __future__ import annotations

import math
from collections import deque

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow (old, new) -> bytes of least total cost that empties every supply; capacities add up to the supply or more.

    Successive shortest paths on the residual graph; cost(i, j) >= 0 for a byte.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("capacities are too small")
    m, n = len(supply), len(capacity)
    flow: dict[tuple[int, int], int] = {}
    rest, room = list(supply), list(capacity)
    price = [[cost(i, j) for j in range(n)] for i in range(m)]
    while any(rest):
        far = [0 if rest[i] else math.inf for i in range(m)] + [math.inf] * n
        back = [-1] * (m + n)
        queue = deque(i for i in range(m) if rest[i])
        queued = set(queue)
        while queue:
            v = queue.popleft()
            queued.discard(v)
            if v < m:
                steps = [(m + j, price[v][j]) for j in range(n)]
            else:
                steps = [(i, -price[i][v - m]) for i in range(m) if flow.get((i, v - m))]
            for w, c in steps:
                if far[v] + c < far[w]:
                    far[w], back[w] = far[v] + c, v
                    if w not in queued:
                        queued.add(w)
                        queue.append(w)
        end = min((m + j for j in range(n) if room[j]), key=lambda w: (far[w], w))
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        amount = min([rest[path[0]], room[end - m], *[flow[path[k + 1], path[k] - m] for k in range(1, len(path) - 1, 2)]])
        for v, w in zip(path, path[1:], strict=False):
            if v < m:
                flow[v, w - m] = flow.get((v, w - m), 0) + amount
            else:
                flow[w, v - m] -= amount
        rest[path[0]] -= amount
        room[end - m] -= amount
    return {k: v for k, v in flow.items() if v}


def reshard(rows: DataFrame, old: Column, n_new: int, size_col: str = "size", key_cols: tuple[str, ...] = ("doc_id",), capacities: list[int] | None = None, block_bytes: int = 8 << 20, most_blocks: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """(rows with old_shard, shard and slot; transfers (old_shard, shard, bytes, moved)).

    `old` gives each row's old shard, an int in 0 .. n_old - 1 (null: 0); the old shard i is the new shard i where
    there is one, and bytes that stay cost nothing. Capacities default to equal shares. An old shard is cut into
    blocks by a hash of the key (about block_bytes each, most_blocks in all); flow is dealt out along the
    blocks in order, so a shard misses its flow by less than one row for each old shard that feeds it.
    Slots are gapless from 0 in each new shard. Sizes must not be null or negative. Repeated rows and null keys are rows like
    others; an empty table gives an empty result. A column of `rows` named old_shard, shard or slot gives way to the result.
    Only keys and sizes are written for the plan; whole rows are shuffled once, by block, when the result is read.
    """
    spark, names = rows.sparkSession, rows.columns
    flat = rows.select("*", F.coalesce(old, F.lit(0)).cast("int")).toDF(*[f"c{i}" for i in range(len(names))], "old_shard")
    size, keys = f"c{names.index(size_col)}", [f"c{names.index(c)}" for c in key_cols]
    keyed = flat.withColumn("hash", F.xxhash64(*keys, F.lit(29)))
    held = stash(keyed.select(*dict.fromkeys([*keys, size]), "old_shard", "hash"), "rows")
    sizes = {r["old_shard"]: r["b"] for r in held.groupBy("old_shard").agg(F.sum(size).alias("b")).collect()}
    n_old = max([n_new - 1, *sizes]) + 1
    supply = [int(sizes.get(i) or 0) for i in range(n_old)]
    total = sum(supply)
    room = capacities or [total // n_new + (j < total % n_new) for j in range(n_new)]
    flow = min_cost_flow(supply, room, lambda i, j: int(i != j))
    unit = max(block_bytes, -(-total // most_blocks), 1)
    per = spark.createDataFrame([(i, max(1, -(-supply[i] // unit))) for i in sizes], "old_shard int, blocks long")
    within = Window.partitionBy("old_shard", "block").orderBy("hash", *keys, size)

    def blocked(x: DataFrame) -> DataFrame:
        x = x.join(F.broadcast(per), "old_shard").withColumn("block", F.pmod(F.shiftrightunsigned("hash", 1), F.col("blocks")))
        return x.withColumn("place", F.row_number().over(within))

    before = spark.createDataFrame(_running(blocked(held).groupBy("old_shard", "block").agg(F.sum(size).alias("b")).collect()), "old_shard int, block long, before long")
    # an old shard's bytes in order: those that stay, then the other shards'
    ends, at = [], dict.fromkeys(range(n_old), 0)
    for i, j in sorted(flow, key=lambda k: (k[0], k[0] != k[1], k[1])):
        ends.append((i, at[i], at[i] + flow[i, j], j))
        at[i] += flow[i, j]
    last = {i: max(k for k, e in enumerate(ends) if e[0] == i) for i in {e[0] for e in ends}}
    ends = [(i, lo, total + 1 if k == last[i] else hi, j) for k, (i, lo, hi, j) in enumerate(ends)]
    ends += [(i, 0, total + 1, i if i < n_new else 0) for i in sizes if i not in last]  # rows without bytes
    ranges = spark.createDataFrame(ends, "old_shard int, low long, high long, shard int")
    middle = F.col("before") + F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size) + F.floor(F.col(size) / 2)
    placed = blocked(held).join(F.broadcast(before), ["old_shard", "block"]).withColumn("middle", middle)
    placed = placed.join(F.broadcast(ranges), "old_shard").where("middle >= low and middle < high")
    # inside a block the rows of a shard are neighbours: a slot is the block's first slot plus the place among them
    runs = placed.groupBy("shard", "old_shard", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = stash(runs.withColumn("base", base), "cuts")  # blocks and transfers together
    out = blocked(keyed).join(F.broadcast(cuts), ["old_shard", "block"]).where("place >= first and place < first + n")
    made = {"old_shard", "shard", "slot"}
    out = out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in made], "old_shard", "shard", (F.col("base") + F.col("place") - F.col("first")).cast("long").alias("slot"))
    moves = spark.createDataFrame([(i, j, int(x), i != j) for (i, j), x in sorted(flow.items())], "old_shard int, shard int, bytes long, moved boolean")
    return out, moves


def _running(blocks: list) -> list[tuple[int, int, int]]:
    """Bytes of each old shard before each of its blocks. blocks: (old_shard, block, b), at most old shards + total / unit of them."""
    out, run = [], {}
    for i, k, b in sorted((r["old_shard"], r["block"], int(r["b"])) for r in blocks):
        out.append((i, k, run.get(i, 0)))
        run[i] = run.get(i, 0) + b
    return out


def affected(transfers: DataFrame) -> list[int]:
    """The shards whose files a transfer changes; the others stay as they are."""
    rows = transfers.where("moved").collect()  # at most old + new rows
    return sorted({int(x) for r in rows for x in (r["old_shard"], r["shard"])})


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """(version, folder of each shard) of a layout; (-1, {}) where there is none."""
    try:
        rows = spark.read.schema("shard int, folder string, v int").parquet(f"{path}/_manifest")
        version = rows.agg(F.max("v")).first()[0]
    except AnalysisException:
        version = None
    return (-1, {}) if version is None else (version, {r["shard"]: r["folder"] for r in rows.where(F.col("v") == version).collect()})


def rewrite(placed: DataFrame, transfers: DataFrame, path: str, rows_per_file: int = 1 << 20) -> list[int]:
    """Write the affected shards of a layout anew, in slot order, and give their numbers; files of other shards stay as they are.

    Files go to a new folder path/vN, of at most rows_per_file rows, and a manifest in path/_manifest names the folder of every
    shard from then on: it comes last and is one file, so that a job that dies leaves the old layout whole, and rows may be read
    from the layout that is rewritten. Where there is no layout yet all shards are written. Shards that rows have left for good
    are dropped from the manifest; old files are never deleted. Rows are not shuffled: reshard() leaves blocks together, each a run
    of slots of one shard or two, so a task writes few files. Rows from elsewhere should come in few shards a task.
    """
    spark = placed.sparkSession
    version, folders = _manifest(spark, path)
    hit, folder = affected(transfers), f"v{version + 1}"
    new = placed if version < 0 else placed.where(F.col("shard").isin(hit))
    new.sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(f"{path}/{folder}")
    try:
        written = [r[0] for r in spark.read.parquet(f"{path}/{folder}").select("shard").distinct().collect()]
    except AnalysisException:  # no rows
        written = []
    kept = {k: f for k, f in folders.items() if k not in hit} | dict.fromkeys(written, folder)
    rows = spark.createDataFrame(sorted(kept.items()), "shard int, folder string").coalesce(1)
    rows.write.parquet(f"{path}/_manifest/v={version + 1}")
    return hit


def read_layout(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of a layout as of its last manifest, with shard. schema: of the files, for a layout without rows."""
    _, folders = _manifest(spark, path)
    parts = []
    for folder in sorted(set(folders.values())):
        own = sorted(k for k, f in folders.items() if f == folder)
        parts.append(spark.read.parquet(f"{path}/{folder}").where(F.col("shard").isin(own)))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
