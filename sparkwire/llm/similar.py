"""Near copies by the similarity of word shingles: SimHash and a grid find pairs that may be linked, whole sets decide.

Fingerprints of the shingles meet in the grid of segment popcounts (simhash.py), within BITS bits and without loss: each one's
nearest partners are checked first, by whole sets, and later, inside the cells, all other pairs whose ends are still apart. No radius
of a 64-bit fingerprint is enough by itself: how far it differs at a similarity depends on the number of shingles (counts tie, most of
all in short texts), and a grid for 14 bits has too few cells. So rows that the grid's nearest pairs did not join meet in cells of least
shingle hashes too, as two sets of any size share a least hash with a probability that is their similarity; there the numbers of shingles and the shared least hashes leave the candidates.

Small cells of least hashes give all their candidates; in large ones rows are first joined to a few leaders. Then, in these and in the
grid's, rows outside a cell's commonest group bring their sets to the cell and are compared there, so that what leaves a cell are links, at
most one for each group but one, however many pairs were compared. A cell is streamed: no task holds more than leaders or a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, U64, keep_keys, keyed, map_text, prefix_hash, runs, signed, span_hash, splitmix, stash, text_buffer, tidy
from .components import components
from .simhash import EVEN, first_cells, majority, partners, parts_for

#: Bits by which fingerprints may differ in the grid, by four parts of the popcounts (a tenth of all pairs share a cell; by five parts, for 14
#: bits, 0.36 of them would). Each fingerprint's NEAREST partners are checked first, and the others where these have not joined their ends.
BITS, NEAREST = 11, 3
#: Cells of a text, and least hashes that make up a cell: a pair of similarity 0.8 misses all cells once in 300000.
CELLS, JOINED = 24, 4
#: Further least hashes of which two bits each are kept, to estimate the similarity.
EXTRA = 256
ODD = splitmix(np.arange(1, CELLS * JOINED + EXTRA + 1, dtype=U64)) | U64(1)
FLIP = splitmix(np.arange(1001, CELLS * JOINED + EXTRA + 1001, dtype=U64))
#: The estimate's standard deviation at 0.8 is 0.0245 for sets of any size: pairs estimated lower by SLACK, 5.1 of it, are no
#: candidates. OF_CELLS: the share of the cells' hashes in the estimate.
SLACK, OF_CELLS = 0.125, 0.33
#: Rows of a cell up to which all its pairs are looked at. In larger cells rows are tried against up to LEADERS others first, and
#: are likely linked to TIMES of them where they are estimated to be as similar as asked, and SURE more.
SMALL, LEADERS, SURE, TIMES = 24, 64, 0.02, 2
#: Shingles of the rows that one task holds against the others of a cell; a cell with more is dealt out in blocks.
BLOCK = 1 << 21
DIGESTS = [f"m{k}" for k in range(CELLS // 2 + EXTRA // 32)]


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted by both, and two hashes of each text's sequence of words.

    A-Z are lowered; a text of fewer words is one shingle; one without words has none, and sequence hashes 0."""
    raw, offsets = text_buffer(texts)
    n = len(offsets) - 1
    data = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    begin, end = runs(~SPACE[data], offsets)
    word = splitmix(span_hash(prefix_hash(data), begin, end))
    doc = np.searchsorted(offsets, begin, side="right") - 1
    at = np.searchsorted(doc, np.arange(n + 1))
    prefix = prefix_hash(word)
    i = np.arange(len(word))
    last = at[doc + 1]
    s = i[(i + words <= last) | (i == at[doc])]
    h = splitmix(span_hash(prefix, s, np.minimum(s + words, last[s])))
    again = prefix_hash(splitmix(word ^ U64(1)))
    whole = np.where(np.diff(at) > 0, splitmix(np.stack([span_hash(p, at[:-1], at[1:]) for p in (prefix, again)]) + U64(1)), U64(0))
    order = np.lexsort((h, doc[s]))
    of, h = doc[s][order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[new], h[new], whole


def cell_names(of: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, CELLS): each cell's name is made of JOINED least hashes under permutations of its own. And as 64-bit words: for each
    cell 16 bits of its name and four of each of its hashes, then two bits of each of EXTRA more hashes."""
    count = CELLS * JOINED
    out, digests, pairs = np.zeros((n, CELLS), U64), np.zeros((n, CELLS), np.uint32), np.zeros((n, EXTRA // 32), U64)
    if len(h):
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        for j in range(count + EXTRA):
            least = splitmix(np.minimum.reduceat((h ^ FLIP[j]) * ODD[j], first))
            if j < count:
                out[of[first], j // JOINED] = splitmix(out[of[first], j // JOINED] ^ least ^ U64(j // JOINED))
                digests[of[first], j // JOINED] |= ((least >> U64(60)) << U64(4 * (j % JOINED))).astype(np.uint32)
            else:
                word, place = divmod(j - count, 32)
                pairs[of[first], word] |= (least >> U64(62)) << U64(2 * place)
    # names tell common cells: near copies often share three of a cell's four hashes, and then four bits of the last say little
    digests |= ((out >> U64(48)) << U64(16)).astype(np.uint32)
    return out, np.concatenate([digests.view(U64), pairs], 1)


def signatures(docs: DataFrame, text_col: str, words: int, carry: list[str]) -> DataFrame:
    """Adds node and node2 (hashes of the words), m0, m1, ... (bits of the least hashes), n (distinct shingles), fp (their SimHash) and cells."""

    def kernel():
        def work(texts: pa.Array) -> list[pa.Array]:
            of, h, whole = shingles(texts, words)
            n = whole.shape[1]
            cells, f = cell_names(of, h, n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * CELLS), pa.array(signed(cells.ravel())))
            return [pa.array(signed(whole[0])), pa.array(signed(whole[1])), *[pa.array(signed(np.ascontiguousarray(f[:, k]))) for k in range(f.shape[1])], pa.array(np.bincount(of, minlength=n)), pa.array(signed(majority(of, h, n))), lists]

        return work

    fields = [T.StructField(x, T.LongType()) for x in ("node", "node2", *DIGESTS, "n", "fp")] + [T.StructField("cells", T.ArrayType(T.LongType()))]
    return map_text(docs, kernel, fields, text_col, carry)


def shingle_sets(docs: DataFrame, text_col: str, words: int, carry: list[str]) -> DataFrame:
    """Adds shingles: the hashes of a text's distinct shingles."""

    def kernel():
        def work(texts: pa.Array) -> list[pa.Array]:
            of, h, whole = shingles(texts, words)
            at = np.searchsorted(of, np.arange(whole.shape[1] + 1)).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(at), pa.array(signed(h)))]

        return work

    return map_text(docs, kernel, [T.StructField("shingles", T.ArrayType(T.LongType()))], text_col, carry)


def _near(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, at: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the candidates that met in no earlier cell (`at`: which of its cells this one is to x), and of those that
    are likely linked. x, y: digests of a pair's ends, nx, ny: their numbers of shingles; x may be one row for all."""
    names = CELLS // 2
    k = np.flatnonzero(np.minimum(nx, ny) >= share * np.maximum(nx, ny))
    one = len(x) == 1
    z = (x if one else x[k]) ^ y[k]
    d = np.ascontiguousarray(z[:, :names]).view(np.uint32)
    e = d | (d >> np.uint32(1))
    other = np.bitwise_count((e | (e >> np.uint32(2))) & np.uint32(0x1111)).sum(-1)
    e = z[:, names:]
    unlike = np.bitwise_count((e | (e >> U64(1))) & EVEN).sum(-1)
    guess = OF_CELLS * (1 - other / (0.9375 * CELLS * JOINED)) + (1 - OF_CELLS) * (1 - unlike / (0.75 * EXTRA))
    first = (d == 0).argmax(-1) == (at if one else at[k])
    return k[(guess >= share - SLACK) & first], k[guess >= share + SURE]


def _within(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, at: int, share: float) -> tuple[np.ndarray, None]:
    """As _near, for a cell `at` of the grid: positions of the fingerprints within BITS bits for which this is the first common cell."""
    k = np.flatnonzero((np.minimum(nx, ny) >= share * np.maximum(nx, ny)) & (np.bitwise_count(x[:, 0] ^ y[:, 0]) <= BITS))
    return k[first_cells(x[:, 0], y[k, 0], parts_for(BITS)).view(np.int64) == at], None


#: What the rows of each kind of cell bring there, and how candidates are told.
MET, GRID = (DIGESTS, _near), (["fp"], _within)


def pairs_of_small(cell: np.ndarray, at: np.ndarray, f: np.ndarray, n: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the candidate pairs of rows sorted by cell, cells of up to SMALL rows: each pair in the first cell of its rows."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(1, SMALL):
        i = np.flatnonzero(cell[s:] == cell[:-s]) if len(cell) > s else []
        if not len(i):
            break
        i = i[_near(f[i], f[i + s], n[i], n[i + s], at[i], share)[0]]
        out_a.append(i)
        out_b.append(i + s)
    return np.concatenate(out_a), np.concatenate(out_b)


class Leaders:
    """Of one large cell, whatever its size: rows that were likely linked to no leader when they came, up to LEADERS of them."""

    def __init__(self) -> None:
        self.node, self.f, self.n = [], [], []

    def links(self, node: np.ndarray, f: np.ndarray, n: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Likely links of these rows to leaders, old and new, up to about TIMES a row."""
        out_a, out_b, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(node), int)
        tried = 0
        while True:
            if tried == len(self.node):
                free = np.flatnonzero(hits == 0) if tried < LEADERS else hits[:0]
                if not len(free):
                    break
                self.node.append(node[free[0]])
                self.f.append(f[free[0] : free[0] + 1])
                self.n.append(n[free[0]])
                hits[free[0]] = TIMES
            rest = np.flatnonzero(hits < TIMES)
            _, likely = _near(self.f[tried], f[rest], self.n[tried], n[rest], -1, share)
            hits[rest[likely]] += 1
            out_a.append(np.full(len(likely), self.node[tried]))
            out_b.append(node[rest[likely]])
            tried += 1
        return np.concatenate(out_a), np.concatenate(out_b)


def _meeting(share: float):
    """Kernel over rows (cell, at, node, digests, n) sorted by cell. It gives rows (cell, a, b): a candidate pair of nodes where
    cell is null; otherwise a is a row's node in that large cell, and b which of its cells that is to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, open_cell, leaders = [], 0, None, None

        def batch_of(pairs: list, large: list) -> pa.RecordBatch:
            p = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
            p = np.unique(np.sort(p, 1), axis=0)
            m = np.concatenate([np.zeros((0, 3), np.int64), *large])
            cells = pa.array(np.concatenate([np.zeros(len(p), np.int64), m[:, 0]]), mask=np.arange(len(p) + len(m)) < len(p))
            return pa.RecordBatch.from_arrays([cells, pa.array(np.concatenate([p[:, 0], m[:, 1]])), pa.array(np.concatenate([p[:, 1], m[:, 2]]))], names=["cell", "a", "b"])

        def flush(x: np.ndarray, goes_on: bool) -> pa.RecordBatch:
            nonlocal open_cell, leaders
            cell, at, node, n, f = x[0], x[1], x[2], x[-1], np.ascontiguousarray(x[3:-1].T).view(U64)
            head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            size = np.diff(np.append(head, len(cell)))
            big = size > SMALL
            big[0] |= open_cell is not None and cell[0] == open_cell
            big[-1] |= goes_on
            i = np.flatnonzero(~np.repeat(big, size))
            a, b = pairs_of_small(cell[i], at[i], f[i], n[i], share)
            pairs, large = [np.stack([node[i[a]], node[i[b]]], 1)], []
            for g in np.flatnonzero(big):
                own = slice(head[g], head[g] + size[g])
                if cell[head[g]] != open_cell:
                    open_cell, leaders = cell[head[g]], Leaders()
                pairs.append(np.stack(leaders.links(node[own], f[own], n[own], share), 1))
                large.append(np.stack([cell[own], node[own], at[own]], 1))
            return batch_of(pairs, large)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            rows += batch.num_rows
            if rows >= 50_000:  # the last cell waits for the next batch, unless it fills this one
                x = np.concatenate(held, 1)
                cut = int(np.searchsorted(x[0], x[0][-1]))
                yield flush(x[:, :cut] if cut else x, not cut)
                held = [x[:, cut:].copy()] if cut else []
                rows = x.shape[1] - cut if cut else 0
        if held:
            yield flush(np.concatenate(held, 1), False)
        tidy()

    return run


def meetings(classes: DataFrame, share: float) -> DataFrame:
    """(cell, a, b): see _meeting. Digests travel only with rows whose cell holds another row."""
    rows = classes.where("n > 0").select(F.posexplode("cells").alias("at", "cell"), "node")
    rows = rows.withColumn("size_", F.count(F.lit(1)).over(Window.partitionBy("cell"))).where("size_ > 1")
    rows = rows.join(classes.select("node", *DIGESTS, "n"), "node").select("cell", F.col("at").cast("long").alias("at"), "node", *DIGESTS, "n")
    return rows.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_meeting(share), "cell long, a long, b long")


def _pieces(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Every position of the pieces that begin at `start` and are `size` long, one piece behind the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _outside(share: float, exact: bool, kind=MET):
    """Kernel over rows (cell, block, role, node, root, at, n, what the kind of cell asks for[, shingles]) sorted by the first three: rows of role 0 are held
    against each other and against all others of their cell and block. exact: links (a, b) of roots, by whole sets, that join
    all that is joined there, at most one for each root but one. Else: the rows (cell, block, role, node, root, at) with candidates."""
    lead, (digests, candidates) = ["cell", "block", "role", "node", "root", "at", "n"], kind

    class Part:
        """Rows as arrays."""

        def __init__(self, batch: pa.RecordBatch):
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[: len(lead) + len(digests)]]
            for k, x in zip(lead, cols, strict=False):
                setattr(self, k, x)
            self.f = np.stack(cols[len(lead) :], 1).view(U64)
            if exact:
                sets = batch.column(len(lead) + len(digests))
                offsets = sets.offsets.to_numpy().astype(np.int64)
                self.start, self.size = offsets[:-1] - offsets[0], np.diff(offsets)
                self.words, self.code = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            self.hit = np.zeros(len(self.node), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        found: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def against(p: Part, i: int, q: Part, rows: np.ndarray) -> None:
            """Row i of p against those rows of q."""
            rows = rows[q.root[rows] != p.root[i]]
            if not len(rows):
                return
            k, _ = candidates(p.f[i : i + 1], q.f[rows], p.n[i], q.n[rows], p.at[i], share)
            rows = rows[k]
            if exact and len(rows):
                roots, which = np.unique(q.root[rows], return_inverse=True)
                own = find(int(p.root[i]))
                rows = rows[np.array([find(int(r)) != own for r in roots])[which]]
            if not len(rows):
                return
            if not exact:
                p.hit[i] = True
                q.hit[rows] = True
                return
            mine = p.words[p.code[p.start[i] : p.start[i] + p.size[i]]]
            mark = np.zeros(len(q.words), bool)
            where = np.minimum(np.searchsorted(q.words, mine), len(q.words) - 1)
            mark[where[q.words[where] == mine]] = True
            size = q.size[rows]
            shared = np.add.reduceat(mark[q.code[_pieces(q.start[rows], size)]].astype(np.int64), np.cumsum(size) - size)
            for r in np.unique(q.root[rows[shared >= share * (len(mine) + size - shared)]]).tolist():
                a, b = find(int(p.root[i])), find(r)
                if a != b:
                    parent[a] = b
                    found.append((int(p.root[i]), r))

        def out(parts: list[Part]) -> pa.RecordBatch:
            if exact:
                x = np.array(found, np.int64).reshape(-1, 2)
                found.clear()
                return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])
            cols = [pa.array(np.concatenate([getattr(p, c)[p.hit] for p in parts])) if parts else pa.array([], pa.int64()) for c in lead[:6]]
            return pa.RecordBatch.from_arrays(cols, names=lead[:6])

        key, held = None, []
        for batch in batches:
            cell, block, role = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (role[1:] != role[:-1])) + 1
            for lo, hi in zip(np.append(0, cut), np.append(cut, len(cell)), strict=True) if len(cell) else ():
                if (cell[lo], block[lo]) != key:
                    yield out(held)
                    key, held = (cell[lo], block[lo]), []
                    parent.clear()
                q = Part(batch.slice(lo, hi - lo))
                for p in held:
                    for i in range(len(p.node)):
                        against(p, i, q, np.arange(len(q.node)))
                if role[lo] == 0:
                    for i in range(len(q.node) - 1):
                        against(q, i, q, np.arange(i + 1, len(q.node)))
                    held.append(q)
                else:
                    yield out([q])
        yield out(held)
        tidy()

    return run


def _deal(rows: DataFrame, kind, *more: str) -> DataFrame:
    return rows.select("cell", "block", "role", "node", "root", "at", "n", *kind[0], *more).repartition("cell", "block").sortWithinPartitions("cell", "block", "role")


def rows_outside(large: DataFrame, ends: DataFrame, share: float, kind=MET) -> DataFrame:
    """(cell, block, role, node, root, at): the rows that have candidates of other roots in the large cells, from rows (cell, a: node, b: at) of
    these and ends: (node, root, n, what the kind of cell asks for), which are joined once, as a row is in many cells.

    Rows outside a cell's commonest root (role 0) are held, in blocks of BLOCK shingles, against the rest, and the rest is streamed."""
    rows = large.select("cell", F.col("a").alias("node"), F.col("b").alias("at")).join(ends.select("node", "root", "n", *kind[0]), "node")
    rows = stash(rows, "large")
    sums = rows.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    tops = sums.groupBy("cell").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("k", "root", "w")).alias("top"), F.sum("w").alias("w")).where("roots > 1")
    tops = tops.select("cell", F.col("top.root").alias("top"), F.ceil((F.col("w") - F.col("top.w")) / BLOCK).alias("blocks"))
    own = F.when(F.col("root") != F.col("top"), F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.join(tops, "cell").withColumn("own", own)
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("own", F.col("blocks") - 1))))
    rows = rows.withColumn("role", (F.coalesce("own", F.lit(-1)) != F.col("block")).cast("long"))
    names = ["cell", "block", "role", "node", "root", "at"]
    near = _deal(rows, kind).mapInArrow(_outside(share, False, kind), ", ".join(f"{c} long" for c in names))
    return stash(near, "outside")


def links_of_rows(near: DataFrame, own: DataFrame, classes: DataFrame, share: float, kind=MET) -> DataFrame:
    """(a, b): links of roots that lie between the rows of rows_outside, by whole sets; own: (node, shingles) of these."""
    both = classes.select("node", "n", *kind[0]).join(own, "node")
    return _deal(near.join(both, "node"), kind, "shingles").mapInArrow(_outside(share, True, kind), "a long, b long").distinct()


def links_outside(large: DataFrame, roots: DataFrame, classes: DataFrame, sets, share: float, kind=MET) -> DataFrame:
    """(a, b): links of roots that lie between unlike roots in the large cells. sets(nodes) gives (node, shingles); only rows with
    candidates bring theirs."""
    near = rows_outside(large, classes.join(roots, "node"), share, kind)
    return links_of_rows(near, sets(near.select("node").distinct()), classes, share, kind)


def grid_partners(classes: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The grid join of the fingerprints: (a, b), pairs of nodes of which one's fingerprint is among the NEAREST partners of the other's,
    less those whose numbers of shingles rule a link out; and (cell, a, b), each node in each cell where it has partners (b is the cell).

    Of equal fingerprints the least node stands for the others in the first, and is paired with them; in the second all nodes are."""
    own = classes.where("n > 0").select("fp", "node", "n")
    heads = own.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("h"), F.count(F.lit(1)).alias("k"))
    heads = stash(heads.select("fp", F.col("h.node").alias("x"), F.col("h.n").alias("nx"), "k"), "prints")
    met = stash(partners(heads.select(F.explode(F.array_repeat("fp", F.least("k", F.lit(2)).cast("int"))).alias("fp")), BITS), "grid")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = met.where("a <> b").select("a", "b").distinct().withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(apart, "b")))
    near = near.where(F.col("k") <= NEAREST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    across = near.join(heads.select("fp", "x", "nx").toDF("a", "x", "nx"), "a").join(heads.select("fp", "x", "nx").toDF("b", "y", "ny"), "b").select("x", "nx", "y", "ny")
    equal = own.join(heads.where("k > 1").drop("k"), "fp").where("node <> x").select("x", "nx", F.col("node").alias("y"), F.col("n").alias("ny"))
    pairs = across.union(equal).where(F.least("nx", "ny") >= F.lit(share) * F.greatest("nx", "ny")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return pairs, met.join(own, F.col("fp") == F.col("a")).select("cell", F.col("node").alias("a"), F.col("cell").alias("b"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` without near copies: of each group joined by a similarity (Jaccard, distinct shingles of `words`
    words) of at least `similarity`, the row of the least id stays; a null id comes last, and of rows that share id and
    text one stays. Texts of the same words are one class; null, empty and blank texts are one. Columns stay as they are, whatever
    their names. An empty table gives an empty one.

    The grid of the fingerprints' popcounts joins all such pairs within BITS bits; what its nearest pairs do not join meets in cells of least
    hashes too, where a pair of exactly 0.8 is missed about once in 200000 (no cell in common, or the estimate beyond its bound), whatever the
    texts' lengths and the cells' sizes, and more similar ones hardly ever. No pair below `similarity` links. Classes are known by
    128 bits of hash of their words, shingles by 64.
    """
    rows = keyed(docs, id_col, text_col)
    slim = rows.select("id_", "text", "key1_", "key2_")
    wide = stash(signatures(slim, "text", words, ["id_", "key1_", "key2_"]), "wide")
    place = F.struct(F.col("id_").isNull().alias("z"), F.col("id_").alias("id"), F.col("key1_").alias("k1"), F.col("key2_").alias("k2"))
    classes = stash(wide.groupBy("node", "node2").agg(F.min(place).alias("p"), *[F.first(c).alias(c) for c in (*DIGESTS, "n", "fp", "cells")]), "classes")
    # classes that share a node, N^2 / 2^65 of N by chance, are told apart by the other hash
    twins = classes.groupBy("node").agg(F.min("node2").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").select("node", "least")
    other = F.col("node2") != F.col("least")
    classes = classes.join(F.broadcast(twins), "node", "left").withColumn("node", F.when(other, F.xxhash64("node", "node2")).otherwise(F.col("node")))

    def sets(nodes: DataFrame) -> DataFrame:
        """(node, shingles) of those nodes: the texts are read again, by the keys of the class's first row."""
        keys = classes.join(nodes, "node").select("node", F.col("p.k1").alias("key1_"), F.col("p.k2").alias("key2_"))
        texts = slim.select("text", "key1_", "key2_").join(keys, ["key1_", "key2_"]).dropDuplicates(["node"]).select("node", "text")
        return stash(shingle_sets(texts, "text", words, ["node"]), "sets")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that are as similar as asked, by whole sets."""
        pairs = stash(pairs, f"{name}pairs")
        own = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = pairs.join(own.toDF("b", "sb"), "b").join(own.toDF("a", "sa"), "a")
        shared, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
        return stash(both.where(shared >= F.lit(similarity) * (total - shared)).select("a", "b"), name)

    near, grid = grid_partners(classes, similarity)
    first = checked(near, "near")
    joined = components(first)
    met = stash(meetings(classes, similarity), "met")
    rest = met.where("cell is null").select("a", "b").distinct()
    rest = rest.join(joined.toDF("a", "ra"), "a", "left").join(joined.toDF("b", "rb"), "b", "left")
    rest = checked(rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "rest")
    joined = components(first.union(rest))
    ends = classes.select("node", "n", "fp", *DIGESTS, "p").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = stash(ends, "roots")
    cells = [(rows_outside(rows, ends, similarity, kind), kind) for rows, kind in ((grid, GRID), (met.where("cell is not null"), MET))]
    own = sets(cells[0][0].select("node").union(cells[1][0].select("node")).distinct())
    more = [links_of_rows(rows, own, ends, similarity, kind) for rows, kind in cells]
    more = components(more[0].union(more[1])).toDF("root", "top")
    kept = ends.select("root", "p").join(more, "root", "left").groupBy(F.coalesce("top", "root").alias("root")).agg(F.min("p").alias("p"))
    kept = stash(kept.select(F.col("p.k1").alias("key1_"), F.col("p.k2").alias("key2_")).distinct(), "keep")
    return keep_keys(rows, kept, docs.columns)
