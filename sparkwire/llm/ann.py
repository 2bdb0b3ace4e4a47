"""Nearest neighbours by additive quantisation: beam-search codes, stored norms, lookup tables, exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash


@dataclass(frozen=True)
class Settings:
    """sample bounds the vectors that codebooks are fitted on; every vector is encoded.

    block: vectors scored at a time; query_block: queries at a time; rerank: candidates of each block measured exactly.
    """

    sample: int = 8_000
    books: int = 16
    words: int = 128
    beam: int = 4
    rounds: int = 1
    block: int = 16_384
    query_block: int = 2_048
    rerank: int = 1_000
    seed: int = 5


@dataclass
class Codebooks:
    words: np.ndarray  # (books, words, dim), each word as wide as a vector

    def gram(self) -> np.ndarray:
        m, k, d = self.words.shape
        flat = self.words.reshape(m * k, d)
        return (flat @ flat.T).reshape(m, k, m, k)

    def encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        """(n, books) codes of least squared error among `beam` partial sums kept at each book."""
        m, k, _ = self.words.shape
        gram = self.gram()
        out = np.empty((len(x), m), np.uint8)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            n = len(part)
            dots = np.einsum("nd,mkd->mnk", part, self.words, optimize=True)
            codes, err = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
            for b in range(m):
                cross = np.broadcast_to(-2 * dots[b][:, None, :] + np.diagonal(gram[b, :, b, :])[None, None, :], (n, codes.shape[1], k)).copy()
                for c in range(b):
                    cross += 2 * gram[c][codes[:, :, c], b]
                cost = (err[:, :, None] + cross).reshape(n, -1)
                keep = min(beam, cost.shape[1])
                top = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
                err = np.take_along_axis(cost, top, 1)
                codes = np.concatenate([np.take_along_axis(codes, (top // k)[:, :, None], 1), (top % k)[:, :, None]], 2)
            out[at : at + n] = codes[np.arange(n), err.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[b][codes[:, b]] for b in range(len(self.words)))


def fit(x: np.ndarray, s: Settings) -> Codebooks:
    """Residual k-means, then rounds of beam-search codes and least-squares codebooks over all books together."""
    rng = np.random.default_rng(s.seed)
    n, d = x.shape
    k = int(min(s.words, max(1, n // 4)))
    books, rest = [], x.astype(np.float32).copy()
    for _ in range(s.books):
        c = rest[rng.choice(n, k, replace=n < k)].copy()
        for _ in range(6):
            near = (-2 * rest @ c.T + (c**2).sum(1)).argmin(1)
            size = np.bincount(near, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, near, rest)
            c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], rest[rng.integers(0, n, k)])
        near = (-2 * rest @ c.T + (c**2).sum(1)).argmin(1)
        rest -= c[near]
        books.append(c)
    out = Codebooks(np.stack(books).astype(np.float32))
    for _ in range(s.rounds):
        codes = out.encode(x, s.beam).astype(np.int64) + np.arange(s.books) * k
        size = s.books * k
        pairs = (codes[:, :, None] * size + codes[:, None, :]).ravel()
        a = np.bincount(pairs, minlength=size * size).reshape(size, size).astype(np.float64)
        rhs = np.zeros((size, d))
        for b in range(s.books):
            np.add.at(rhs, codes[:, b], x)
        a += np.eye(len(a)) * 0.1
        rhs += 0.1 * out.words.reshape(-1, d)
        out = Codebooks(np.linalg.solve(a, rhs).reshape(s.books, k, d).astype(np.float32))
    return out


def usable(col: str = "embedding") -> Column:
    """Not null, no null or non-finite component, not zero."""
    v = F.col(col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    rows: DataFrame  # a row for each class of equal vectors: vec_id (the least), vec, k1 and k2 (128 bits of hash of vec), codes, norm
    members: DataFrame | None  # k1, k2, vec_id, n (rows of that id in the class)
    books: Codebooks | None
    settings: Settings
    size: int


def matrix(col: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(kind) if len(col) else np.zeros((0, 1), kind)


def build(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> Index:
    """Encode every usable vector with an id, equal ones (0.0 equals -0.0) once; of vectors of several widths the most frequent width takes part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & usable("vec"))
    widths = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not widths:
        return Index(rows, None, None, settings, 0)
    rows = rows.where(F.size("vec") == widths[0]["d"]).withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, 0.0).otherwise(x)))
    rows = rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})
    members = stash(rows.groupBy("k1", "k2", "vec_id").agg(F.count(F.lit(1)).alias("n")), "members")
    rows = rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.first("vec").alias("vec")).select("vec_id", "vec", "k1", "k2")
    taken = rows.orderBy(F.xxhash64("vec_id", F.lit(settings.seed)), "vec_id").limit(settings.sample).toArrow()
    books = fit(matrix(taken.column("vec"), np.float32), settings)
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # books x words x width

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                codes = shared.value.encode(matrix(batch.column(1), np.float32), settings.beam)
                norm = (shared.value.decode(codes) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm.astype(np.float32))], names=["vec_id", "vec", "k1", "k2", "codes", "norm"])

    held = stash(rows.mapInArrow(encode, "vec_id long, vec array<double>, k1 long, k2 long, codes binary, norm float"), "index")
    return Index(held, members, books, settings, held.count())


def least_members(index: Index, k: int) -> DataFrame:
    """(k1, k2, ids): of each class its k + 1 least ids, in order, each as often as it has rows (k at most).

    Whichever id is a query's own, k others are left or all. Ids are dealt by hash first, so a large class is no single task's work."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(16))
    rows = index.members.withColumn("part", part)
    for keys in (["k1", "k2", "part"], ["k1", "k2"]):
        rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("at") <= k + 1)
    ids = F.array_sort(F.collect_list(F.struct("vec_id", "n")))
    ids = F.flatten(F.transform(ids, lambda m: F.array_repeat(m["vec_id"], F.least(m["n"], F.lit(k)).cast("int"))))
    return rows.groupBy("k1", "k2").agg(ids.alias("ids"))


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "query_id", vec_col: str = "vec") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows whose id is not its own; ties to the smaller id.

    All classes of equal vectors are scored from their codes, block of classes by block of queries; the `rerank` best of
    each block are measured exactly, in double precision, and stand for the least ids of their rows. Of queries that share an id the least vector counts. Fewer rows than k:
    all are returned.
    """
    spark = queries.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    if index.books is None:
        return spark.createDataFrame([], out)
    s, books = index.settings, spark.sparkContext.broadcast(index.books)
    width = index.books.words.shape[2]
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("q"))
    asked = asked.where(F.col("query_id").isNotNull() & usable("q") & (F.size("q") == width)).groupBy("query_id").agg(F.min("q").alias("q"))
    n_q = asked.count()
    groups, q_groups = max(1, -(-index.size // s.block)), max(1, -(-n_q // s.query_block))

    def deal(df: DataFrame, col: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(col, F.lit(3)), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = deal(asked, "query_id", "qb", q_groups, "g", groups)
    right = deal(index.rows.join(least_members(index, k), ["k1", "k2"]).drop("k1", "k2"), "vec_id", "g", groups, "qb", q_groups)

    def score(q_rows: pa.Table, rows: pa.Table) -> pa.Table:
        got: list[list] = [[], [], []]
        if q_rows.num_rows and rows.num_rows:
            words = books.value.words
            q = matrix(q_rows.column("q"), np.float64)
            x = matrix(rows.column("vec"), np.float64)
            ids = rows.column("ids").combine_chunks()
            at = np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
            ids = ids.flatten().to_numpy()
            alone = ids[at[:-1]] == ids[at[1:] - 1]  # classes of a single id
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(x), -1).T.copy()
            norm = rows.column("norm").to_numpy()
            for i, name in enumerate(q_rows.column("query_id").to_pylist()):
                table = -2 * (words @ q[i].astype(np.float32))
                near = norm.copy()
                for b in range(len(words)):
                    near += table[b][codes[b]]
                own = alone & (ids[at[:-1]] == name)
                near[own] = np.inf
                top = np.argpartition(near, s.rerank)[: s.rerank] if len(near) > s.rerank else np.arange(len(near))
                top = top[~own[top]]
                exact = np.sqrt(((x[top] - q[i]) ** 2).sum(1))
                if len(top) > k:  # each class left has an id besides the query's own: the k nearest and their equals suffice
                    near_k = exact <= np.partition(exact, k - 1)[k - 1]
                    top, exact = top[near_k], exact[near_k]
                found_ids = np.concatenate([ids[at[c] : at[c + 1]] for c in top]) if len(top) else ids[:0]
                exact = np.repeat(exact, at[top + 1] - at[top])
                other = found_ids != name
                found_ids, exact = found_ids[other], exact[other]
                o = np.lexsort((found_ids, exact))[:k]
                got[0].append(np.full(len(o), name))
                got[1].append(found_ids[o])
                got[2].append(exact[o])
        cols = [np.concatenate(c) if c else np.zeros(0) for c in got]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    found = left.groupBy("g", "qb").cogroup(right.groupBy("g", "qb")).applyInArrow(score, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int = 10) -> dict[int, list[int]]:
    """For tests and recall: the exact answer."""
    out = {}
    for q, name in zip(queries, query_ids, strict=True):
        d = np.sqrt(((vectors.astype(float) - q) ** 2).sum(1))
        o = np.lexsort((ids, d))
        out[int(name)] = [int(v) for v in ids[o] if v != name][:k]
    return out
