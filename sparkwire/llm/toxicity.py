"""Convolutional text classifier in numpy: hashed word embeddings, several filter widths, max pooling."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, map_text, prefix_hash, runs, span_hash, splitmix, text_buffer, tidy

#: Bytes of words: lower-cased letters, digits and all bytes of non-ASCII characters; 0 parts words.
LETTERS = np.zeros(256, np.uint8)
for _b in range(256):
    if chr(_b).isalnum() and _b < 128:
        LETTERS[_b] = ord(chr(_b).lower())
    elif _b >= 128:
        LETTERS[_b] = _b
PREFIX = 4
#: Texts of the sample handled at once.
RUN = 128


@dataclass(frozen=True)
class Settings:
    """max_docs bounds the labelled sample (half of each class, where there are so many), max_bytes the size of a sampled text."""

    max_docs: int = 6000
    max_bytes: int = 1 << 16
    buckets: int = 1 << 17
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    #: Passes over the sample, more if it is so small that fewer than `seen` texts would be looked at.
    epochs: int = 9
    seen: int = 45_000
    balance: float = 0.5
    batch: int = 48
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 7
    #: Every fifth sampled document calibrates; a language needs so many of either class there for its own threshold.
    calibrate_mod: int = 5
    least_per_class: int = 15


@dataclass
class Model:
    settings: Settings
    emb: np.ndarray  # (3, buckets, dim): a word is the sum of three hashed rows, two of the word and one of its first PREFIX bytes
    conv: np.ndarray  # (dim, slots): for each width and place in it, `filters` columns
    bias: np.ndarray  # (len(widths) * filters,)
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    by_lang: dict = field(default_factory=dict)

    def score(self, texts: pa.Array) -> np.ndarray:
        ids, doc, n = words(texts, self.settings)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(ids, doc, n) + self.shift, -40, 40)))

    def logits(self, ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        pooled = np.zeros((n, len(self.bias)), np.float32)
        if len(doc):
            z = self.windows(ids, doc)
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            for f in range(z.shape[0]):
                pooled[doc[first], f] = np.maximum.reduceat(z[f], first)
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def windows(self, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """(filters of all widths, words): response of the window that begins at each word; beyond a text's end words are zero."""
        s, n = self.settings, len(doc)
        e = self.emb[0][ids[0]] + self.emb[1][ids[1]] + self.emb[2][ids[2]]
        y = self.conv.T @ e.T
        z = np.empty((len(self.bias), n), np.float32)
        inside = [doc[k:] == doc[:-k] for k in range(1, max(s.widths)) if k < n]
        slot = 0
        for i, w in enumerate(s.widths):
            rows = slice(i * s.filters, (i + 1) * s.filters)
            z[rows] = y[slot * s.filters : (slot + 1) * s.filters] + self.bias[rows, None]
            for k in range(1, w):
                if k < n:
                    z[rows, :-k] += y[(slot + k) * s.filters : (slot + k + 1) * s.filters, k:] * inside[k - 1]
            slot += w
        return z


def words(texts: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, int]:
    """Three bucket numbers for each word, the text it is in, and the number of texts."""
    raw, offsets = text_buffer(texts)
    data = LETTERS[raw]
    begin, end = runs(data > 0, offsets)
    prefix = prefix_hash(data)
    h = splitmix(span_hash(prefix, begin, end))
    head = splitmix(span_hash(prefix, begin, np.minimum(end, begin + PREFIX)))
    mask = U64(s.buckets - 1)
    ids = np.stack([h & mask, (h >> U64(32)) & mask, head & mask]).astype(np.int64)
    return ids, np.searchsorted(offsets, begin, side="right") - 1, len(offsets) - 1


def fit(texts: list[str], labels: np.ndarray, langs: list[str | None], settings: Settings = Settings(), stands: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Adagrad on logistic loss; max pooling sends the gradient to one window a filter. Then Platt scaling and one
    threshold for each language on the held-back fifth, where a clean and a toxic row count as the labelled rows they
    stand for (`stands`), so that a score means the same whatever the sample's mix. With one class or no rows the score is constant."""
    s, rng = settings, np.random.default_rng(settings.seed)
    slots, nf = sum(s.widths) * s.filters, len(s.widths) * s.filters
    emb = rng.normal(0, 0.05, (3, s.buckets, s.dim)).astype(np.float32)
    m = Model(s, emb, rng.normal(0, 0.3, (s.dim, slots)).astype(np.float32), np.zeros(nf, np.float32), rng.normal(0.5, 0.1, nf).astype(np.float32), -1.0)
    labels = np.asarray(labels, np.float32)
    if not len(texts) or labels.min() == labels.max():
        m.out[:] = 0
        m.out_bias = 0.0 if not len(texts) else (-4.0 if labels[0] == 0 else 4.0)
        return m
    # in runs of texts, so that the driver holds the bucket numbers of the sample and little more
    n, parts, sizes = len(texts), [], []
    for k in range(0, n, RUN):
        i, d, c = words(pa.array(texts[k : k + RUN], pa.string()), s)
        parts.append(i.astype(np.int32))
        sizes.append(np.bincount(d, minlength=c))
    ids = np.concatenate(parts, 1)
    at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    del parts
    order = rng.permutation(n)
    held = np.zeros(n, bool)
    if n >= 50:
        held[order[:: s.calibrate_mod]] = True
    train = np.flatnonzero(~held)
    weight = np.where(labels > 0, max(1.0, float((labels == 0).sum() / (labels > 0).sum())) ** s.balance, 1.0).astype(np.float32)
    epochs = max(s.epochs, -(-s.seen // max(len(train), 1)))
    g_emb, g_conv = np.full((3, s.buckets), 1e-2, np.float32), np.full_like(m.conv, 1e-2)
    g_bias, g_out, g_ob = np.full_like(m.bias, 1e-2), np.full_like(m.out, 1e-2), 1e-2
    for epoch in range(min(epochs, 60)):
        rate = s.rate * (1 - 0.9 * epoch / min(epochs, 60))
        mixed = rng.permutation(train)
        for k in range(0, len(mixed), s.batch):
            batch = mixed[k : k + s.batch]
            take = np.concatenate([np.arange(at[d], at[d + 1]) for d in batch])
            b_ids, b_doc = ids[:, take], np.repeat(np.arange(len(batch)), at[batch + 1] - at[batch])
            pooled, arg = np.zeros((len(batch), nf), np.float32), np.full((len(batch), nf), -1)
            if len(take):
                z = m.windows(b_ids, b_doc)
                edges = np.searchsorted(b_doc, np.arange(len(batch) + 1))
                for d in range(len(batch)):
                    a, b = edges[d], edges[d + 1]
                    if b > a:
                        arg[d] = z[:, a:b].argmax(1) + a
                        pooled[d] = z[np.arange(nf), arg[d]]
            active = pooled > 0
            act = np.where(active, pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ m.out + m.out_bias, -30, 30)))
            err = weight[batch] * (p - labels[batch]) / len(batch)
            d_out, d_ob = act.T @ err + s.decay * m.out, err.sum()
            d_pool = np.where(active, err[:, None] * m.out[None, :], 0).astype(np.float32)
            d_conv, rows, grads = np.zeros_like(m.conv), [], []
            slot = 0
            for i, w in enumerate(s.widths):
                dd, ff = np.nonzero(active[:, i * s.filters : (i + 1) * s.filters])
                pos, g = arg[dd, i * s.filters + ff], d_pool[dd, i * s.filters + ff]
                for j in range(w):
                    q = pos + j
                    ok = (q < len(take)) & (b_doc[np.minimum(q, len(take) - 1)] == dd) if len(take) else np.zeros(0, bool)
                    qq, col, gg = q[ok], (slot + j) * s.filters + ff[ok], g[ok]
                    x = b_ids[:, qq]
                    np.add.at(d_conv.T, col, gg[:, None] * (m.emb[0][x[0]] + m.emb[1][x[1]] + m.emb[2][x[2]]))
                    rows.append(x)
                    grads.append(gg[:, None] * m.conv[:, col].T)
                slot += w
            d_bias = d_pool.sum(0)
            g_out += d_out**2
            g_ob += d_ob**2
            g_conv += d_conv**2
            g_bias += d_bias**2
            m.out -= (rate * d_out / np.sqrt(g_out)).astype(np.float32)
            m.out_bias -= float(rate * d_ob / np.sqrt(g_ob))
            m.conv -= rate * d_conv / np.sqrt(g_conv)
            m.bias -= rate * d_bias / np.sqrt(g_bias)
            r, g = np.concatenate(rows, 1), np.concatenate(grads)
            for t in range(3):
                u, inv = np.unique(r[t], return_inverse=True)
                total = np.zeros((len(u), s.dim), np.float32)
                np.add.at(total, inv, g)
                g_emb[t][u] += (total**2).mean(1)
                m.emb[t][u] -= rate * total / np.sqrt(g_emb[t][u])[:, None]
    logit = np.zeros(n, np.float32)
    for k in range(0, n, RUN):
        e = min(k + RUN, n)
        logit[k:e] = m.logits(ids[:, at[k] : at[e]], np.repeat(np.arange(e - k), np.diff(at[k : e + 1])), e - k)
    calibrate(m, logit, labels, np.array([x or "" for x in langs], object), held if held.any() else np.ones(n, bool), stands)
    return m


def calibrate(m: Model, logit: np.ndarray, label: np.ndarray, langs: np.ndarray, rows: np.ndarray, stands: tuple[float, float] = (1.0, 1.0)) -> None:
    """Platt scaling by Newton steps with smoothed targets, then thresholds; rows weigh what their class `stands` for."""
    x, y = logit[rows].astype(float), label[rows].astype(float)
    pos, neg = y.sum(), (1 - y).sum()
    mass = np.where(y > 0, stands[1], stands[0])
    mass = mass / mass.mean()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, e = mass * (p * (1 - p) + 1e-6), mass * (p - t)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(e * x).sum() + 1e-3 * (a - 1), e.sum()]))
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    m.scale, m.shift = max(a, 1e-3), b
    p = 1 / (1 + np.exp(-np.clip(m.scale * x + m.shift, -40, 40)))
    m.threshold = best_threshold(p, y, mass)
    own = langs[rows]
    for lang in sorted(set(own)):
        k = own == lang
        if min(y[k].sum(), (1 - y[k]).sum()) >= m.settings.least_per_class:
            m.by_lang[lang] = best_threshold(p[k], y[k], mass[k])


def best_threshold(p: np.ndarray, y: np.ndarray, mass: np.ndarray) -> float:
    """Middle of the gap that gives the best F1 (false alarms count twice), between 0.3 and 0.9."""
    o = np.argsort(-p, kind="stable")
    p, y, mass = p[o], y[o], mass[o]
    tp, fp = np.cumsum(y * mass), np.cumsum((1 - y) * mass)
    f = 2 * tp / (tp + 2 * fp + (y * mass).sum())
    f[:-1][p[:-1] == p[1:]] = -1
    k = int(np.argmax(f))
    return float(np.clip((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2, 0.3, 0.9))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings) -> tuple[list[str], np.ndarray, list[str | None], tuple[float, float]]:
    """Labelled texts in the order of a hash of their id, at most max_docs; `learn` says which ids may be learned from. Last:
    how many labelled rows a clean and a toxic row of the sample stand for."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(learn)
    half = settings.max_docs // 2
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for k in (1, 0)]
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    stands = max(1.0, counts.get(0, 0) / half), max(1.0, counts.get(1, 0) / half)
    ids = picked[0].union(picked[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = docs.select("doc_id", "text", F.col("lang").alias("lang_")).where(F.octet_length("text") <= settings.max_bytes)
    rows = d.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(settings.max_docs).collect()
    return [r["text"] for r in rows], np.array([r["toxic"] for r in rows]), [r["lang_"] for r in rows], stands


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, settings: Settings = Settings()) -> Model:
    *rows, stands = sample(docs, labels, F.lit(True) if learn is None else learn, settings)
    model = fit(*rows, settings, stands)
    del rows
    tidy()
    return model


def classify(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang", carry: list[str] | None = None) -> DataFrame:
    """Adds score (double, 0 to 1; from the text alone) and rejected (score >= the threshold of the row's language).

    Whole texts are scored; null and empty texts get the score of a text without words. A null or unknown language, or
    lang_col None, takes the common threshold. Repeated rows, null ids and extra columns are kept as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by Settings

    def kernel():
        return lambda texts: [pa.array(shared.value.score(texts).astype(np.float64))]

    if lang_col is not None and carry is not None and lang_col not in carry:
        raise ValueError("carry must hold lang_col")
    out = map_text(docs, kernel, [T.StructField("score", T.DoubleType())], text_col, carry)
    limit: Column = F.lit(model.threshold)
    if lang_col is not None and model.by_lang:
        table = F.create_map(*[F.lit(x) for kv in model.by_lang.items() for x in kv])
        limit = F.coalesce(table[F.coalesce(F.col(lang_col), F.lit(""))], limit)
    return out.withColumn("rejected", F.col("score") >= limit)
