"""Best-two-fit packing of token pieces, solved on the histogram of piece lengths."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import byte_slices, columns_by_position, limit_batches, stash


@dataclass
class Plan:
    """Runs of equal bins: in class `length`, items of rank start .. start + uses * bins - 1 go, `uses` to a bin, to
    bins first_bin, first_bin + 1, ..., at `offset` and behind one another. Sorted by (length, start)."""

    length: np.ndarray
    start: np.ndarray
    uses: np.ndarray
    first_bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of the items with these lengths and ranks in their class."""
        lo = np.searchsorted(self.length, length, side="left")
        hi = np.searchsorted(self.length, length, side="right")
        # the last run of the class that begins at or before the rank: a search inside [lo, hi)
        while (active := lo + 1 < hi).any():
            mid = (lo + hi) // 2
            go = self.start[np.minimum(mid, len(self.start) - 1)] <= rank
            lo, hi = np.where(active & go, mid, lo), np.where(active & ~go, mid, hi)
        i = rank - self.start[lo]
        return self.first_bin[lo] + i // self.uses[lo], self.offset[lo] + i % self.uses[lo] * length


def best_two_fit(counts: np.ndarray, capacity: int) -> Plan:
    """counts[l]: items of length l (1 .. capacity). One bin after another is filled greedily, the largest item that
    fits first; then, if a gap is left and the bin holds two items or more, its smallest item gives way to the two
    unpacked items that fill the widened gap best, if they fill it better. While the counts last the next bin
    would come out alike, so a bin is made as often as they allow: the work depends on the number of lengths, not items.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    taken = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int]] = []
    bins = 0
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            break
        free, content = capacity, {}
        avail = left.copy()
        while free > 0:
            fits = have[: np.searchsorted(have, free, side="right")]
            fits = fits[avail[fits] > 0]
            if not len(fits):
                break
            item = int(fits[-1])
            k = min(int(avail[item]), free // item)
            content[item] = content.get(item, 0) + k
            avail[item] -= k
            free -= k * item
        if free and sum(content.values()) > 1:
            small = min(content)
            avail[small] += 1
            for goal in range(small + free, small, -1):
                a = have[: np.searchsorted(have, goal // 2, side="right")]
                ok = (avail[a] > 0) & (avail[goal - a] > np.where(a == goal - a, 1, 0))
                if ok.any():
                    x = int(a[np.flatnonzero(ok)[-1]])
                    content[small] -= 1
                    if not content[small]:
                        del content[small]
                    for y in (x, goal - x):
                        content[y] = content.get(y, 0) + 1
                    break
        times = min(int(left[item]) // k for item, k in content.items())
        at = 0
        for item in sorted(content, reverse=True):
            k = content[item]
            rows.append((item, int(taken[item]), k, bins, at))
            taken[item] += k * times
            left[item] -= k * times
            at += k * item
        bins += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*cols, bins)


PIECES = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, text_col: str = "text", carry: list[str] | None = None, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: the columns of `carry`, piece, start, length, ids_crc32 and, with_ids, ids.

    A document is the ids of its whole text and end_id; a null text counts as empty, so every document has a piece.
    One of more than capacity ids is cut: its first piece takes what is over, the others are full. A column that has
    the name of a result gives way.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    path = path or tokens.default_path()
    flat, names = columns_by_position(docs)
    made = {f.name for f in PIECES} | {"ids"}
    keep = [i for i, n in enumerate(names) if (carry is None or n in carry) and n not in made]
    at = names.index(text_col)
    fields = [*PIECES, *([T.StructField("ids", T.BinaryType())] if with_ids else [])]
    schema = T.StructType([T.StructField(f"c{i}", flat.schema[f"c{i}"].dataType) for i in keep] + [T.StructField(f"r{j}", f.dataType) for j, f in enumerate(fields)])
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = tokens.encoder(path)
        labels = [f.name for f in schema]
        for batch in batches:
            for part in byte_slices(batch, len(keep), 1 << 20):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(len(keep)).to_pylist()):
                    raw = memoryview(enc.ids(text) + end)
                    n, a, k = len(raw) // 4, 0, 0
                    while a < n:
                        b = a + ((n - a) % capacity or capacity)
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                        if with_ids:
                            ids.append(bytes(raw[4 * a : 4 * b]))
                        a, k = b, k + 1
                kept = [part.column(j).take(pa.array(row, pa.int64())) for j in range(len(keep))]
                made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, *made, *([pa.array(ids, pa.binary())] if with_ids else [])], names=labels)

    out = flat.select(*[f"c{i}" for i in keep], F.col(f"c{at}").alias("text_")).mapInArrow(run, schema)
    return out.toDF(*[names[i] for i in keep], *[f.name for f in fields])


def pack(pieces: DataFrame, capacity: int = 1024, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32"), buckets: int = 64) -> DataFrame:
    """Adds sequence_id and offset (long) to rows with a length (1 .. capacity; others raise an error): gapless bins.

    The driver gets the counts by (bucket, length), at most buckets * capacity numbers at any input, packs the
    lengths and sends back ranks' places. Ranks inside a bucket and length follow `order`; null ids and
    repeated rows rank like others. An empty table gives an empty one. Columns of any name are kept; one named sequence_id or
    offset gives way to the result.
    """
    spark = pieces.sparkSession
    pieces, own = columns_by_position(pieces)
    order, size = tuple(f"c{own.index(c)}" for c in order), f"c{own.index('length')}"
    bucket = F.pmod(F.xxhash64(*order, F.lit(17)), F.lit(buckets)).cast("int")
    held = stash(pieces.withColumn("bucket_", bucket), "pieces")
    got = held.groupBy("bucket_", size).agg(F.count(F.lit(1)).alias("n")).toDF("bucket_", "length", "n").collect()
    table = np.zeros((buckets, capacity + 1), np.int64)
    for r in got:
        if r["length"] is None or not 1 <= r["length"] <= capacity:
            raise ValueError(f"length {r['length']} is not in 1..{capacity}")
        table[r["bucket_"], r["length"]] = r["n"]
    base = np.cumsum(table, 0) - table
    shared = spark.sparkContext.broadcast((best_two_fit(table.sum(0), capacity), base))
    ranked = held.withColumn("rank_", F.row_number().over(Window.partitionBy("bucket_", size).orderBy(*order)) - 1)
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        plan, first = shared.value
        for batch in batches:
            if batch.num_rows:
                b, n, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket_", size, "rank_"))
                seq, off = plan.place(n, first[b, n] + r)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    out = ranked.select(*names, "bucket_", "rank_").mapInArrow(run, schema)
    made = {"sequence_id", "offset"}
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(own) if n not in made], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, n_tokens) from packed pieces that carry their ids; a sequence is at most capacity ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    return rows.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), "n_tokens")
