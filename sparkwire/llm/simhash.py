"""SimHash near-duplicates: segment-popcount embedding, grid range-join under Manhattan distance, exact check."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, keep_keys, keyed, map_text, stash, tidy
from .components import components

EVEN = U64(0x5555555555555555)
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_COLUMN = (np.arange(8) * 256).astype(np.int64)
_RUN = 1 << 16


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """Bit by bit the majority over XXH64 of all shingles of `words` words, repeats included; 0 without words."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n = len(w) - words + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for k in range(0, n, _RUN):
        a, b = start[k : min(k + _RUN, n)].tolist(), end[k + words - 1 : min(k + _RUN, n) + words - 1].tolist()
        raw = b"".join([digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)])
        table = np.bincount((np.frombuffer(raw, np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256)
        counts += (table @ BYTE_BITS).ravel()
    bits = 2 * counts > n
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 4, seed: int = 42, carry: list[str] | None = None) -> DataFrame:
    """Adds fp (long, the 64 bits as signed). Words are runs of bytes other than ASCII white space; A-Z are lowered."""

    def kernel():
        def work(texts: pa.Array) -> list[pa.Array]:
            got = [fingerprint(t, words, seed) for t in texts.cast(pa.binary()).to_pylist()]
            return [pa.array(np.array(got, U64).view(np.int64))]

        return work

    return map_text(docs, kernel, [T.StructField("fp", T.LongType())], text_col, carry)


def majority(of: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n texts from rows (text, hash), sorted by text: bits set in over half of a text's hashes; 0 without any."""
    out = np.zeros(n, U64)
    if len(h):
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        size = np.diff(np.append(first, len(h)))
        for b in range(64):
            ones = np.add.reduceat(((h >> U64(b)) & U64(1)).astype(np.int64), first)
            out[of[first]] |= (2 * ones > size).astype(U64) << U64(b)
    return out


def embed(x: np.ndarray) -> np.ndarray:
    """The popcounts of the 32 two-bit segments, in unary (00, 01, 11): the Hamming distance of two embeddings is the
    Manhattan distance of their popcount vectors, which never exceeds the Hamming distance of the fingerprints."""
    low, high = x & EVEN, (x >> U64(1)) & EVEN
    return (low | high) | ((low & high) << U64(1))


def parts_for(most: int) -> int:
    """Into how many parts the 32 segments go for `most` differing bits: one part then differs by 2 at most."""
    return most // 3 + 1


def _places(parts: int) -> list[tuple[int, int, U64]]:
    """First segment, number of segments and tag of each part."""
    edge = [32 * k // parts for k in range(parts + 1)]
    wide = max(np.diff(edge))
    return [(edge[k], edge[k + 1] - edge[k], U64(k) << U64(2 * wide)) for k in range(parts)]


def cells(fp: np.ndarray, parts: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): grid cells of each part (a half, of two) of the embedding within Manhattan distance 1, the part's own included.

    Fingerprints at distance 3 * parts - 1 or less (4 or less: a half) have a part at Manhattan distance 2 or less; then a grid
    point lies within 1 of both, so they share a cell."""
    e = embed(fp)
    rows, out = [], []
    for begin, segments, tag in _places(parts):
        h = (e >> U64(2 * begin)) & U64((1 << 2 * segments) - 1)
        n = np.arange(len(fp))
        rows.append(n)
        out.append(h | tag)
        for seg in range(segments):
            lo, hi = U64(1) << U64(2 * seg), U64(2) << U64(2 * seg)
            a, b = (h & lo) != 0, (h & hi) != 0
            step = np.where(a & b, h ^ hi, h ^ lo)  # 2 -> 1; 1 -> 0; 0 -> 1
            rows.append(n)
            out.append(step | tag)
            one = np.flatnonzero(a & ~b)  # 1 -> 2
            rows.append(one)
            out.append((h[one] ^ hi) | tag)
    return np.concatenate(rows), np.concatenate(out)


def first_cells(x: np.ndarray, y: np.ndarray, parts: int = 2) -> np.ndarray:
    """One cell of those that each pair of fingerprints shares, the same whichever comes first; all bits set, which no cell has, if none.

    It is of the first part that differs by 2 at most: the least of the parts' own values, or of the grid points between them."""
    e, f = embed(x), embed(y)
    out = np.full(np.broadcast(e, f).shape, ~U64(0))
    for begin, segments, tag in _places(parts)[::-1]:
        h, g = ((v >> U64(2 * begin)) & U64((1 << 2 * segments) - 1) for v in (e, f))
        z = h ^ g
        step = z & (~z + U64(1))
        d = np.bitwise_count(z)
        out = np.where(d <= 2, np.where(d == 2, np.minimum(h ^ step, g ^ step), np.minimum(h, g)) | tag, out)
    return out


SMALL = 12
#: Comparisons that are made at once, and pairs a row up to which a larger cell gives all its pairs.
_BLOCK, _MANY = 1 << 16, 8


def _near_blocks(fp: np.ndarray, e: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs at distance `most` or less, a block of comparisons at a time."""
    n = len(fp)
    rows = max(1, _BLOCK // n)
    for k in range(0, n, rows):
        i, j = np.divmod(np.flatnonzero(np.bitwise_count(e[k : k + rows, None] ^ e[None, k:]) <= most), n - k)  # the bound
        later = i < j
        i, j = i[later] + k, j[later] + k
        near = np.bitwise_count(fp[i] ^ fp[j]) <= most  # the check
        yield i[near], j[near]


def _pairs_of_cell(fp: np.ndarray, e: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Positions of the pairs at distance `most` or less, which rows have one, and whether these are all pairs: they end with
    the block in which they become more than _MANY a row."""
    n = len(fp)
    out_a, out_b, hit, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(n, bool), 0
    for i, j in _near_blocks(fp, e, most):
        hit[i] = hit[j] = True
        if found <= _MANY * n:
            out_a.append(i)
            out_b.append(j)
        found += len(i)
    return np.concatenate(out_a), np.concatenate(out_b), hit, found <= _MANY * n


def links_in_cells(cell: np.ndarray, fp: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of each cell's fingerprints which are joined by distances of at most `most` inside the cell.

    Rows come sorted by cell. Cells of up to SMALL rows: pairs by shift. Larger: all pairs, block by block, unless they are more than
    _MANY a row. Then search from one fingerprint after another among those not yet reached, so a tight group of any size
    costs one pass; never all its pairs."""
    n = len(cell)
    if n < 2:
        return np.zeros(0, U64), np.zeros(0, U64)
    e = embed(fp)
    head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(head, n))
    of = np.repeat(np.arange(len(head)), size)
    left = size[of] - (np.arange(n) - head[of])  # rows to the end of the cell, own included
    small = size[of] <= SMALL
    out_a, out_b = [], []
    for s in range(1, SMALL):
        i = np.flatnonzero(small & (left > s))
        if not len(i):
            break
        i = i[np.bitwise_count(e[i] ^ e[i + s]) <= most]  # the bound
        i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= most]  # the check
        out_a.append(fp[i])
        out_b.append(fp[i + s])
    seen = set()
    for g in np.flatnonzero(size > SMALL):
        rest = np.unique(fp[head[g] : head[g] + size[g]])
        name = (len(rest), hash(rest.tobytes()))
        if name in seen:  # the same members meet in many cells
            continue
        seen.add(name)
        bound = embed(rest)
        i, j, hit, whole = _pairs_of_cell(rest, bound, most)
        if whole:
            out_a.append(rest[i])
            out_b.append(rest[j])
            continue
        rest, bound = rest[hit], bound[hit]
        while len(rest) > 1:
            todo, rest, bound = [rest[0]], rest[1:], bound[1:]
            while todo and len(rest):
                x = todo.pop()
                near = np.flatnonzero(np.bitwise_count(embed(x) ^ bound) <= most)
                near = near[np.bitwise_count(x ^ rest[near]) <= most]
                if len(near):
                    got = rest[near]
                    out_a.append(np.full(len(got), x))
                    out_b.append(got)
                    todo += list(got)
                    rest, bound = np.delete(rest, near), np.delete(bound, near)
    if not out_a:
        return np.zeros(0, U64), np.zeros(0, U64)
    return np.concatenate(out_a), np.concatenate(out_b)


def partners_in_cells(cell: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, fingerprint, its nearest partner there): a row for each fingerprint and cell with a partner within `most` bits, of
    pairs whose first common cell it is; never a row for each pair. Rows come sorted by cell; a fingerprint that comes twice is its own partner."""
    head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(head, len(cell)))
    parts, none = parts_for(most), np.iinfo(np.int64).max
    out = [np.zeros((3, 0), U64)]
    for g in np.flatnonzero(size > 1):
        own = np.sort(fp[head[g] : head[g] + size[g]])
        best = np.full(len(own), none)  # distance and position
        for i, j in _near_blocks(own, embed(own), most):
            first = first_cells(own[i], own[j], parts) == cell[head[g]]
            i, j = i[first], j[first]
            far = np.bitwise_count(own[i] ^ own[j]).astype(np.int64) << 40
            np.minimum.at(best, i, far | j)
            np.minimum.at(best, j, far | i)
        hit = np.flatnonzero((best < none) & np.append(True, own[1:] != own[:-1]))
        out.append(np.stack([np.full(len(hit), cell[head[g]]), own[hit], own[best[hit] & ((1 << 40) - 1)]]))
    return tuple(np.concatenate(out, 1))


def _cell_rows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            for k in range(0, len(fp), 1200):  # some 60,000 rows a batch
                part = fp[k : k + 1200]
                row, cell = cells(part, parts)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(part[row].view(np.int64))], names=["cell", "fp"])

    return run


def _cell_links(most: int):
    def flush(c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = links_in_cells(c, f.view(U64), most)
        x = np.unique(np.stack([np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return _whole_cells(flush)


def _cell_partners(most: int):
    def flush(c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in partners_in_cells(c.view(U64), f.view(U64), most)], names=["cell", "a", "b"])

    return _whole_cells(flush)


def _whole_cells(flush: Callable[[np.ndarray, np.ndarray], pa.RecordBatch]):
    """Whole cells at a time: rows come sorted by cell, and the last cell of a batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_f, rows = [], [], 0
        for batch in batches:
            c, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            held_c.append(c)
            held_f.append(f)
            rows += len(c)
            if rows >= 100_000 and len(c):
                c, f = np.concatenate(held_c), np.concatenate(held_f)
                cut = int(np.searchsorted(c, c[-1]))
                if cut:
                    yield flush(c[:cut], f[:cut])
                held_c, held_f, rows = [c[cut:]], [f[cut:]], len(c) - cut
        if held_c:
            yield flush(np.concatenate(held_c), np.concatenate(held_f))
        tidy()

    return run


def links(prints: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): pairs of different fingerprints at distance `most` or less that join all that are so joined."""
    rows = prints.select("fp").mapInArrow(_cell_rows(parts_for(most)), "cell long, fp long")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links(most), "a long, b long").distinct()


def partners(prints: DataFrame, most: int) -> DataFrame:
    """(cell, a, b): see partners_in_cells."""
    rows = prints.select("fp").mapInArrow(_cell_rows(parts_for(most)), "cell long, fp long")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_partners(most), "cell long, a long, b long")


def _classes(prints: DataFrame) -> DataFrame:
    """(fp_, root) of every fingerprint: the class it is joined to, named by its least fingerprint."""
    classes = stash(prints.select("fp").distinct(), "fpclass")
    roots = components(links(classes))
    return classes.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("fp_"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """One row for each document: (id, fp, component_id), the least id that can be reached over links, its own included.

    Equal fingerprints link (also zero, of texts without words; null counts as empty); others at 4 differing bits or
    fewer. Null ids keep their row and take no part in the least id; a component of null ids has a null id.
    Each class of equal fingerprints stands for its copies, so copies never meet in pairs.
    """
    prints = stash(fingerprints(docs.select(id_col, text_col), text_col, words, carry=[id_col]), "fp")
    classes = stash(_classes(prints), "fproot")
    least = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    ids = classes.join(least, F.col("fp") == F.col("fp_")).groupBy("root").agg(F.min("least").alias("component_id"))
    table = stash(classes.join(ids, "root").select("fp_", "component_id"), "fpid")
    return prints.join(table, F.col("fp") == F.col("fp_"), "left").drop("fp_")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """The rows of `docs` without near copies: of each component the row of the least id stays (a null id comes last;
    of rows that share id and text, one). Columns stay as they are."""
    rows = keyed(docs, id_col, text_col)
    slim = rows.select("id_", "text", "key1_", "key2_")
    prints = stash(fingerprints(slim, "text", words, carry=["id_", "key1_", "key2_"]), "fp")
    place = F.struct(F.col("id_").isNull().alias("z"), F.col("id_").alias("id"), F.col("key1_").alias("k1"), F.col("key2_").alias("k2"))
    least = prints.groupBy("fp").agg(F.min(place).alias("p"))
    kept = _classes(prints).join(least, F.col("fp") == F.col("fp_")).groupBy("root").agg(F.min("p").alias("p"))
    kept = stash(kept.select(F.col("p.k1").alias("key1_"), F.col("p.k2").alias("key2_")).distinct(), "keep")
    return keep_keys(rows, kept, docs.columns)
