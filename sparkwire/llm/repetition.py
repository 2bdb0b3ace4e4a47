"""Quality rules over a suffix array of each text's words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SPACE, U64, map_text, prefix_hash, runs, span_hash, splitmix, text_buffer

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """A text is kept if it has min_words words, at most max_window_pct % of them in repeated 5-word windows, at most
    max_covered of its word characters in repeats of min_repeat words or more, and no repeat of more than max_longest words."""

    min_words: int = 10
    max_window_pct: int = 20
    min_repeat: int = 10
    max_covered: float = 0.18
    max_longest: int = 60


FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
]


def suffix_lcp(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the symbols and lcp[j], the common prefix of suffixes sa[j-1] and sa[j] (lcp[0] = 0).

    Prefix doubling: ranks are places of groups in sorted order; only suffixes in groups of two or more are
    sorted again. Any order of symbols will do. The ranks of every level answer the common prefixes.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = s[1:] != s[:-1]
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = place
    levels = [rank]
    step = 1
    while True:
        size = np.bincount(place, minlength=n)
        live = np.flatnonzero(size[rank[:n]] > 1)
        if not len(live):
            break
        base = rank[live]
        key = base * (n + 1) + rank[np.minimum(live + step, n)] + 1
        o = np.argsort(key, kind="stable")
        key, live, base = key[o], live[o], base[o]
        at = np.arange(len(live))
        first = np.empty(len(live), bool)
        first[0] = True
        first[1:] = base[1:] != base[:-1]
        group = np.maximum.accumulate(np.where(first, at, 0))
        first[1:] |= key[1:] != key[:-1]
        own = np.maximum.accumulate(np.where(first, at, 0))
        rank = rank.copy()
        rank[live] = base + own - group
        place = rank[:n]
        levels.append(rank)
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank[:n]] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    if n > 1:
        a, b = sa[:-1], sa[1:]
        at = np.flatnonzero(levels[0][a] == levels[0][b])
        a, b, got = a[at], b[at], np.zeros(len(at), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = np.minimum(a + got, n), np.minimum(b + got, n)
            got += ((levels[k][x] == levels[k][y]) & (x < n) & (y < n)).astype(np.int64) << k
        lcp[at + 1] = got
    return sa, lcp


def longest_at(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix the value of the smallest lcp interval that holds it: its longest prefix found elsewhere."""
    out = np.zeros(len(sa), np.int64)
    if len(sa):
        out[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def union(length: np.ndarray, least: int) -> np.ndarray:
    """True at each symbol covered by a span [i, i + length[i]) with length[i] >= least."""
    n = len(length)
    i = np.flatnonzero(length >= least)
    edge = np.bincount(i, minlength=n + 1) - np.bincount(i + length[i], minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: pa.Array, limits: Limits) -> list[np.ndarray]:
    """The figures of FIELDS for a run of texts; one suffix array serves them all, as symbols of two texts never agree."""
    data, offsets = text_buffer(texts)
    n_docs, total = len(offsets) - 1, len(data)
    begin, end = runs(~SPACE[data], offsets)
    prefix = prefix_hash(data)
    doc = np.searchsorted(offsets, begin, side="right") - 1
    salt = splitmix(np.arange(n_docs, dtype=U64) + U64(1))
    sa, lcp = suffix_lcp(splitmix(span_hash(prefix, begin, end)) ^ salt[doc])
    longest = longest_at(sa, lcp)

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=n_docs).astype(np.int64)

    def bytes_per_doc(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[offsets[1:]] - c[offsets[:-1]]

    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[end] - points[begin]
    n_words, word_chars = per_doc(np.ones(len(doc))), per_doc(chars)
    n_repeat = per_doc(union(longest, WINDOW))
    covered = per_doc(np.where(union(longest, limits.min_repeat), chars, 0))
    most = np.zeros(n_docs, np.int64)
    np.maximum.at(most, doc[longest > 0], longest[longest > 0])

    cuts = np.flatnonzero(data == 10)
    line = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    line = line[line < total]
    of = np.searchsorted(offsets, line, side="right") - 1
    stop = np.minimum(np.append(cuts, total)[np.searchsorted(cuts, line)], offsets[of + 1])
    worded = np.searchsorted(begin, line) < np.searchsorted(begin, stop)
    line, stop, of = line[worded], stop[worded], of[worded]
    key = splitmix(span_hash(prefix, line, stop) + (stop - line).astype(U64)) ^ salt[of]
    _, at = np.unique(key, return_index=True)
    dup_lines = np.bincount(of, minlength=n_docs) - np.bincount(of[at], minlength=n_docs)

    failed = (n_words < limits.min_words) | (100 * n_repeat > limits.max_window_pct * n_words)
    kept = ~failed & (covered <= limits.max_covered * word_chars) & (most <= limits.max_longest)
    return [n_words, word_chars, bytes_per_doc(SYMBOLS[data]), dup_lines, n_repeat, covered, most, failed, kept]


def repetition_rules(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds the columns of FIELDS to each row, from its whole text.

    covered_chars: code points of words in repeats of limits.min_repeat words or more (spans of all maximal repeats,
    united; copies may overlap). longest_repeat: words of the longest repeat, 0 if no word is found twice.
    Null and empty texts have no words: all counts 0, base_failed true, kept false. Repeated rows, null ids and
    extra columns are kept as they are. Memory goes with the longest text.
    """

    def kernel():
        return lambda texts: [pa.array(x) for x in measure(texts, limits)]

    return map_text(docs, kernel, FIELDS, text_col, carry)


def spans(text: str | None, least: int) -> list[tuple[int, int]]:
    """Byte spans of one text's united repeats of `least` words or more, first word's begin to last word's end."""
    data, offsets = text_buffer(pa.array([text or ""]))
    begin, end = runs(~SPACE[data], offsets)
    length = longest_at(*suffix_lcp(splitmix(span_hash(prefix_hash(data), begin, end))))
    a, b = runs(union(length, least), np.zeros(1, np.int64))
    return [(int(begin[i]), int(end[j - 1])) for i, j in zip(a, b, strict=True)]
