"""Removal of repeated byte strings, by deep-shallow suffix sorting around content-chosen anchors.

A string is judged where its anchor lies: among the GRAM-byte grams inside the string the one of least hash (the last, of equals).
Equal strings have equal anchors at equal places, so strings are compared only inside groups of one anchor gram.
An anchor serves a run of neighbouring strings; its context, all bytes of those that could be asked for, is hashed. Where two contexts
are equal, all their strings are found again. What is left, contexts that share a gram and differ further out, is decided
by bytes: suffixes (from the anchor to the right, and to the left) are sorted deep-shallow, and a string is
found again where the common prefixes on both sides reach its ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, byte_slices, limit_batches, prefix_hash, shared_dir, span_hash, splitmix, stash, text_buffer

GRAM = 40
#: Place bits in the sort key of a gram; a run of bytes in one pass is shorter.
PLACE = 20
#: Starts of one long text handled in one pass.
STRIDE = 1 << 18


def anchors(data: np.ndarray, first: np.ndarray, last: np.ndarray, s_from: np.ndarray, s_to: np.ndarray, length: int, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Anchors of the strings data[s : s + length] for s in [s_from, s_to) of each text, which spans [first, last) (it may reach beyond data).

    Gives text (number), h (hash of the gram), c (of the context), a (place), lo and hi (least and most a - s)."""
    n, width = len(data), length - gram + 1
    live = np.flatnonzero(s_to > s_from)
    if n < length or not len(live):
        z = np.zeros(0, np.int64)
        return {"text": z, "h": z.astype(U64), "c": z.astype(U64), "a": z, "lo": z, "hi": z}
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    h = splitmix(span_hash(prefix, at, at + gram))
    mask = U64((1 << PLACE) - 1)
    low = (h & ~mask) | (mask - at.astype(U64))
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    counts = s_to[live] - s_from[live]
    s = np.repeat(s_from[live] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    text = np.repeat(live, counts)
    a = (mask - (low[s] & mask)).astype(np.int64)
    head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (text[1:] != text[:-1])))
    tail = np.append(head[1:], len(a)) - 1
    a, text = a[head], text[head]
    left = np.minimum(a - first[text], length - gram)
    right = np.minimum(last[text] - a, length)
    c = splitmix(span_hash(prefix, a - left, a + right) ^ splitmix((left * 4096 + right).astype(U64) + U64(1)))
    return {"text": text, "h": h[a], "c": c, "a": a - first[text], "lo": a - s[tail], "hi": a - s[head]}


def text_anchors(texts: pa.Array, length: int) -> dict[str, np.ndarray]:
    """Anchors of whole texts; a text beyond STRIDE is passed over in overlapping pieces, and an anchor met in two is one again."""
    data, offsets = text_buffer(texts)
    size = np.diff(offsets)
    out = []
    if len(data) <= 2 * STRIDE:
        out.append(anchors(data, offsets[:-1], offsets[1:], offsets[:-1], offsets[1:] - length + 1, length))
    else:
        for i in range(len(size)):
            own = data[offsets[i] : offsets[i + 1]]
            for k in range(0, max(len(own) - length + 1, 0), STRIDE):
                lo, end = max(0, k - length), min(k + STRIDE, len(own) - length + 1)
                hi = min(len(own), end + 3 * length)
                got = anchors(own[lo:hi], np.array([-lo]), np.array([len(own) - lo]), np.array([k - lo]), np.array([end - lo]), length)
                got["text"] = got["text"] + i
                out.append(got)
    x = {k: np.concatenate([o[k] for o in out]) if out else np.zeros(0, U64 if k in "hc" else np.int64) for k in ("text", "h", "c", "a", "lo", "hi")}
    if len(out) > 1 and len(x["a"]):
        head = np.flatnonzero(np.append(True, (x["a"][1:] != x["a"][:-1]) | (x["text"][1:] != x["text"][:-1])))
        lo, hi = np.minimum.reduceat(x["lo"], head), np.maximum.reduceat(x["hi"], head)
        x = {k: v[head] for k, v in x.items()} | {"lo": lo, "hi": hi}
    return x


def _united(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of each row made one."""
    if not len(row):
        return row, begin, end
    o = np.lexsort((begin, row))
    row, begin, end = row[o], begin[o], end[o]
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(end + row * far)
    new = np.append(True, (begin[1:] + row[1:] * far) > reach[:-1])
    head = np.flatnonzero(new)
    return row[head], begin[head], reach[np.append(head[1:], len(row)) - 1] - row[head] * far


ANCHOR = "kind int, h long, c long, w int, k1 long, k2 long, pk long, until long"


def _anchor_kernel(length: int):
    """(k1, k2, text) -> anchors (kind 0), and spans already known to be found again inside the batch (kind 1: from pk to until).

    Of equal contexts in a batch one goes on, with w = 2: what the whole corpus repeats costs a row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, base = [], 0
            for part in byte_slices(batch, 2, STRIDE):
                got = text_anchors(part.column(2), length)
                got["text"] = got["text"] + base
                base += part.num_rows
                held.append(got)
            if not held:
                continue
            x = {k: np.concatenate([g[k] for g in held]) for k in held[0]}
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            mixed = splitmix(x["h"] ^ splitmix(x["c"]))
            _, at, inv, n = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
            dup = n[inv] > 1
            row, begin, end = _united(x["text"][dup], x["a"][dup] - x["hi"][dup], x["a"][dup] - x["lo"][dup] + length)
            m, d = len(at), len(row)
            pk = (x["a"][at] << 16) | (x["lo"][at] << 8) | x["hi"][at]
            zero = np.zeros(d, np.int64)
            cols = [
                np.repeat(np.array([0, 1], np.int32), [m, d]),
                np.concatenate([x["h"][at].view(np.int64), (splitmix((begin + row * 7919).astype(U64))).view(np.int64)]),
                np.concatenate([x["c"][at].view(np.int64), zero]),
                np.concatenate([np.minimum(n, 2), zero]).astype(np.int32),
                k1[np.concatenate([x["text"][at], row])],
                k2[np.concatenate([x["text"][at], row])],
                np.concatenate([pk, begin]),
                np.concatenate([np.zeros(m, np.int64), end]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "h", "c", "w", "k1", "k2", "pk", "until"])

    return run


FOUND = "kind int, h long, c long, k1 long, k2 long, pk long, until long"


def _neighbour_kernel(length: int):
    """Rows sorted by (h, c): spans of contexts met twice or more (kind 1), and contexts that share their gram with another context
    (kind 2: met once, its spans are to be found; kind 3: for comparison). Only a row's neighbours are looked at, so a group of any size streams through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # the two last rows: one judged, one not
        names = ["kind", "h", "c", "w", "k1", "k2", "pk", "until"]

        def judge(x: dict[str, np.ndarray], begin: int, end: int) -> pa.RecordBatch | None:
            i = np.arange(begin, end)
            if not len(i):
                return None
            n = len(x["h"])
            p, q = np.maximum(i - 1, 0), np.minimum(i + 1, n - 1)
            anchor = x["kind"] == 0
            h_p = (i > 0) & anchor[p] & (x["h"][p] == x["h"][i])
            h_q = (i < n - 1) & anchor[q] & (x["h"][q] == x["h"][i])
            c_p, c_q = h_p & (x["c"][p] == x["c"][i]), h_q & (x["c"][q] == x["c"][i])
            own = anchor[i]
            dup = own & (c_p | c_q | (x["w"][i] > 1))
            other = own & ((h_p & ~c_p) | (h_q & ~c_q))
            known, check = i[dup | ~own], i[other]
            pk = x["pk"][known]
            is_dup = anchor[known]
            a, lo, hi = pk >> 16, (pk >> 8) & 255, pk & 255
            cols = [
                np.concatenate([np.ones(len(known)), np.where(dup[other], 3, 2)]).astype(np.int32),
                np.concatenate([np.zeros(len(known), np.int64), x["h"][check]]),
                np.concatenate([np.zeros(len(known), np.int64), x["c"][check]]),
                np.concatenate([x["k1"][known], x["k1"][check]]),
                np.concatenate([x["k2"][known], x["k2"][check]]),
                np.concatenate([np.where(is_dup, a - hi, pk), x["pk"][check]]),
                np.concatenate([np.where(is_dup, a - lo + length, x["until"][known]), np.zeros(len(check), np.int64)]),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "h", "c", "k1", "k2", "pk", "until"])

        done = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {k: batch.column(j).to_numpy(zero_copy_only=False) for j, k in enumerate(names)}
            if held is not None:
                x = {k: np.concatenate([held[k], v]) for k, v in x.items()}
            n = len(x["h"])
            out = judge(x, done, n - 1)
            if out is not None:
                yield out
            keep = max(0, n - 2)
            held, done = {k: v[keep:] for k, v in x.items()}, n - 1 - keep
        if held is not None:
            out = judge(held, done, len(held["h"]))
            if out is not None:
                yield out

    return run


# ------------------------------------------------------------ deep-shallow sorting


def blind_trie(strings: list[bytes]) -> list[int]:
    """Order of strings by a Patricia trie: inner nodes hold only the place of the next differing byte; a walk goes blindly to
    a leaf, one comparison with it gives the common prefix, and a second walk finds where to branch."""
    root: list | None = None  # inner: [place, {byte: child}]; leaf: [-1, [numbers]]; byte -1: the string ends there
    for i, s in enumerate(strings):
        if root is None:
            root = [-1, [i]]
            continue
        n, node = len(s), root
        while node[0] >= 0:
            nxt = node[1].get(s[node[0]] if node[0] < n else -1)
            node = nxt if nxt is not None else next(iter(node[1].values()))
        other = strings[node[1][0]]
        if other == s:
            node[1].append(i)
            continue
        lo, hi = 0, min(n, len(other))  # the common prefix, by halving
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if s[lo:mid] == other[lo:mid]:
                lo = mid
            else:
                hi = mid - 1
        up, key, node = None, 0, root
        while 0 <= node[0] < lo:
            up, key = node, s[node[0]] if node[0] < n else -1
            node = node[1][key]
        mine = s[lo] if lo < n else -1
        if node[0] == lo:
            node[1][mine] = [-1, [i]]
            continue
        branch = [lo, {(other[lo] if lo < len(other) else -1): node, mine: [-1, [i]]}]
        if up is None:
            root = branch
        else:
            up[1][key] = branch
    out: list[int] = []
    stack = [root] if root else []
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out += node[1]
        else:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def deep_shallow(group: np.ndarray, rows: np.ndarray, size: np.ndarray, shallow: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): strings rows[i, :size[i]] (zero-padded) sorted inside their groups; lcp[j] is the common prefix
    of order[j-1] and order[j], 0 between groups.

    Shallow: multikey quicksort with characters of eight bytes, all groups of a depth in one pass; equal ones go one character
    deeper, down to `shallow` bytes. Deep: groups that are still equal are ordered by blind tries.
    """
    m, width = rows.shape
    order = np.argsort(group, kind="stable")
    tied = group[order]  # a number for each run of equals, in order
    live = np.arange(m)
    for k in range(0, min(shallow, width - width % 8), 8):
        if not len(live):
            break
        head = rows[order[live], k : k + 8]
        word = np.ascontiguousarray(head).view(">u8").ravel().astype(U64)
        o = np.lexsort((word, tied[live]))
        order[live], word, was = order[live][o], word[o], tied[live][o]
        new = np.append(True, (word[1:] != word[:-1]) | (was[1:] != was[:-1]))
        tied = tied.astype(np.int64)
        run = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        tied[live] = run + m + group.size  # runs are named by their place, apart from group names
        n = np.bincount(np.cumsum(new) - 1)
        keep = n[np.cumsum(new) - 1] > 1
        live = live[keep]
        if k == 0:
            tied[np.setdiff1d(np.arange(m), live, assume_unique=True)] = -1
    if len(live):
        t = tied[live]
        head = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (np.diff(live) != 1)))
        for a, b in zip(head, np.append(head[1:], len(live)), strict=True):
            if b - a > 1:
                own = order[live[a:b]]
                buf = [rows[i, : size[i]].tobytes() for i in own]
                order[live[a:b]] = own[blind_trie(buf)]
    lcp = np.zeros(m, np.int64)
    for a in range(1, m, 1 << 16):
        i, j = order[a - 1 : min(a + (1 << 16), m) - 1], order[a : a + (1 << 16)]
        differ = rows[i] != rows[j]
        same = np.where(differ.any(1), differ.argmax(1), width)
        lcp[a : a + len(j)] = np.where(group[i] == group[j], np.minimum(same, np.minimum(size[i], size[j])), 0)
    return order, lcp


def found_again(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, d): the string that begins d before row's anchor occurs at another row of the same h. Rows differ in context.

    Both sides are sorted; with d bytes to the left and length - d to the right, rows agree where no smaller
    common prefix lies between them in either order."""
    m = len(h)
    _, group = np.unique(h, return_inverse=True)
    sides = []
    for strings, width in ((left, length - GRAM), (right, length)):
        wide = -(-width // 8) * 8
        buf = b"".join(s.ljust(wide, b"\0") for s in strings)
        rows = np.frombuffer(buf, np.uint8).reshape(m, wide)
        order, lcp = deep_shallow(group, rows, np.array([len(s) for s in strings]))
        most = np.zeros(m, np.int64)
        most[order] = np.maximum(lcp, np.append(lcp[1:], 0))
        sides.append((order, lcp, most))
    (l_order, l_lcp, l_most), (r_order, r_lcp, r_most) = sides
    # with nothing to the left every row of the group agrees
    g_head = np.append(True, group[l_order][1:] != group[l_order][:-1])
    alone = np.bincount(group)[group] < 2
    out_row, out_d = [], []
    possible = np.flatnonzero(~alone & (r_most + np.minimum(l_most, hi) >= length))
    if not len(possible):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    r_id, l_id = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(int(lo[possible].min()), int(hi[possible].max()) + 1):
        i = possible[(lo[possible] <= d) & (d <= hi[possible]) & (r_most[possible] >= length - d) & (l_most[possible] >= d)]
        if len(i) < 2:
            continue
        r_id[r_order] = np.cumsum(r_lcp < length - d)
        l_id[l_order] = np.cumsum(g_head | (l_lcp < d))
        key = r_id[i] * (m + 1) + l_id[i]
        o = np.argsort(key, kind="stable")
        same = key[o][1:] == key[o][:-1]
        hit = i[o][np.append(same, False) | np.append(False, same)]
        out_row.append(hit)
        out_d.append(np.full(len(hit), d))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_row), np.concatenate(out_d)


def _extract_kernel(length: int):
    """Documents with the list of their contexts -> one row a context with its bytes on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out: list[list] = [[] for _ in range(8)]
            for i, want in enumerate(get["want"].to_pylist()):
                raw = (get["text"][i].as_py() or "").encode()
                k1, k2 = get["k1"][i].as_py(), get["k2"][i].as_py()
                for w in want:
                    a = w["pk"] >> 16
                    for col, v in zip(out, (w["kind"], w["h"], w["c"], k1, k2, w["pk"], raw[max(0, a - (length - GRAM)) : a][::-1], raw[a : a + length]), strict=True):
                        col.append(v)
                if len(out[0]) >= 5000:
                    yield _context_batch(out)
                    out = [[] for _ in range(8)]
            if out[0]:
                yield _context_batch(out)

    return run


CONTEXT = "kind int, h long, c long, k1 long, k2 long, pk long, left binary, right binary"


def _context_batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["kind", "h", "c", "k1", "k2", "pk", "left", "right"])


SPAN = "k1 long, k2 long, begin long, end long"


def _group_kernel(length: int):
    """Contexts sorted by h -> spans found again, whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            col = {n: t.column(n).to_numpy() for n in ("kind", "h", "c", "k1", "k2", "pk")}
            _, at = np.unique(np.stack([col["h"], col["c"]], 1), axis=0, return_index=True)
            col = {k: v[at] for k, v in col.items()}
            left, right = (t.column(n).take(pa.array(at)).to_pylist() for n in ("left", "right"))
            pk = col["pk"]
            row, d = found_again(col["h"], (pk >> 8) & 255, pk & 255, left, right, length)
            own = col["kind"][row] == 2  # others are known in full
            row, d = row[own], d[own]
            begin = (pk[row] >> 16) - d
            row, begin, end = _united(row, begin, begin + length)
            return pa.RecordBatch.from_arrays([pa.array(col["k1"][row]), pa.array(col["k2"][row]), pa.array(begin), pa.array(end)], names=["k1", "k2", "begin", "end"])

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 30_000:
                t = pa.Table.from_batches(held)
                h = t.column("h").to_numpy()
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
                if cut:
                    yield flush(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), len(h) - cut
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


REMOVED = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())]


def _apply_kernel(n_keep: int, digest: bool):
    """Columns kept, text, spans -> columns kept, n_bytes, n_removed, n_spans and the rest of the text (or its SHA-256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures, rest = [], []
            texts, spans = batch.column(n_keep).to_pylist(), batch.column(n_keep + 1).to_pylist()
            for text, own in zip(texts, spans, strict=True):
                raw = (text or "").encode()
                pieces, at, cut, n = [], 0, 0, 0
                for s in sorted(own or [], key=lambda s: (s["begin"], s["end"])):
                    b, e = s["begin"], min(s["end"], len(raw))
                    if n == 0 or b > at:
                        pieces.append(raw[at:b])
                        cut, n, at = cut + e - b, n + 1, e
                    elif e > at:
                        cut, at = cut + e - at, e
                left = b"".join([*pieces, raw[at:]])
                figures.append((len(raw), cut, n))
                rest.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "ignore") if cut else text)
            cols = [pa.array([f[j] for f in figures], pa.int64()) for j in range(3)]
            names = [f"c{i}" for i in range(n_keep)] + ["r0", "r1", "r2", "r3"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *cols, pa.array(rest, pa.string())], names=names)

    return run


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(k1, k2, spans array<struct<begin, end>>) for each text (by its two hashes) with bytes that are to go. docs: k1, k2, text and columns that stay unused."""
    if not GRAM <= length <= 255:
        raise ValueError(f"length must be {GRAM} to 255")
    spark = docs.sparkSession
    rows = docs.select("k1", "k2", "text").where(F.octet_length("text") >= length).mapInArrow(_anchor_kernel(length), ANCHOR)
    found = rows.repartition("h").sortWithinPartitions("h", "c").mapInArrow(_neighbour_kernel(length), FOUND)
    found = stash(found, "anchors")
    check = found.where("kind > 1").groupBy("k1", "k2").agg(F.collect_set(F.struct("kind", "h", "c", "pk")).alias("want"))
    contexts = docs.join(check, ["k1", "k2"]).mapInArrow(_extract_kernel(length), CONTEXT)
    spans = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_group_kernel(length), SPAN)
    spans = spans.union(found.where("kind = 1").select("k1", "k2", F.col("pk").alias("begin"), F.col("until").alias("end")))
    del spark
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, text_col: str = "text", carry: list[str] | None = None, digest: bool = False) -> DataFrame:
    """Every row of `docs` with each byte gone that is covered by a `length`-byte string which also begins elsewhere.

    Texts are UTF-8 bytes; strings never cross texts, overlaps count, and the input decides, not what is left. Adds n_bytes,
    n_removed, n_spans (maximal runs); the text column holds what is left (bytes of a character cut in two go with the rest), or
    with digest=True kept_sha256 of the exact bytes that are left takes its place. Null texts count as empty and
    stay null. Results hang on the text alone: null ids and repeated rows do no harm (copies repeat each other).
    """
    spark = docs.sparkSession
    limit_batches(spark)
    shared_dir(spark)
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)
    made = {f.name for f in REMOVED} | ({"kept_sha256"} if digest else set())
    keep = [i for i, n in enumerate(names) if i != at and (carry is None or n in carry) and n not in made]
    text = F.col(f"c{at}")
    # both joins take the same columns, so that one exchange of the texts can serve both
    own = flat.select(F.xxhash64(text).alias("k1"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("k2"), text.alias("text"), *[F.col(f"c{i}") for i in keep])
    spans = repeated_spans(own, length)
    joined = own.join(spans, ["k1", "k2"], "left").select(*[f"c{i}" for i in keep], "text", "spans")
    schema = T.StructType([T.StructField(f"c{i}", flat.schema[f"c{i}"].dataType) for i in keep] + [T.StructField(f"r{j}", T.LongType()) for j in range(3)] + [T.StructField("r3", T.StringType())])
    out = joined.mapInArrow(_apply_kernel(len(keep), digest), schema)
    figures = [F.col(f"r{j}").alias(f.name) for j, f in enumerate(REMOVED)]
    if digest:
        return out.select(*[F.col(f"c{i}").alias(names[i]) for i in keep], *figures, F.col("r3").alias("kept_sha256"))
    place = [F.col("r3").alias(text_col) if i == at else F.col(f"c{i}").alias(names[i]) for i in sorted([*keep, at])]
    return out.select(*place, *figures)
