"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside the family."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, map_text, text_buffer, unused

#: Family of each language code; a code that is absent belongs to "other".
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "lb", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["ar", "he", "mt"],
}
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """per_lang bounds the sampled texts of each language, max_bytes the size of a sampled text."""

    per_lang: int = 800
    max_bytes: int = 1 << 15
    dims: int = 4096
    epochs: int = 12
    batch: int = 32
    reg: float = 1e-4
    seed: int = 11


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    slope: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def share(self, x: np.ndarray) -> np.ndarray:
        """The side of the first class, 0 to 1."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x), -30, 30)))


@dataclass
class Model:
    settings: Settings
    families: list[str]
    langs: dict[str, list[str]]
    family_pairs: dict[tuple[str, str], Linear] = field(default_factory=dict)
    lang_pairs: dict[tuple[str, str], Linear] = field(default_factory=dict)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, score = [], []
        for k in range(0, len(texts), 256):  # bounds the dense matrix
            x = features(texts.slice(k, 256), self.settings)
            fam = vote(self.families, self.family_pairs, x)
            best = fam.argmax(1)
            out, conf = np.full(len(x), UNDETERMINED, object), np.zeros(len(x))
            for i, name in enumerate(self.families):
                rows = np.flatnonzero(best == i)
                if len(rows):
                    own = vote(self.langs[name], self.lang_pairs, x[rows])
                    top = own.argmax(1)
                    out[rows] = np.array(self.langs[name], object)[top]
                    conf[rows] = fam[rows, i] * own[np.arange(len(rows)), top]
            names += out.tolist()
            score.append(conf)
        return names, np.clip(np.concatenate(score), 0, 1) if score else np.zeros(0)


def vote(classes: list[str], pairs: dict[tuple[str, str], Linear], x: np.ndarray) -> np.ndarray:
    """Shares of one-versus-one decisions, summed for each class and made to add up to 1."""
    out = np.full((len(x), len(classes)), 1e-9)
    if len(classes) == 1:
        return np.ones((len(x), 1))
    for i, j in combinations(range(len(classes)), 2):
        p = pairs[classes[i], classes[j]].share(x)
        out[:, i] += p
        out[:, j] += 1 - p
    # a class's mean share against the others; the winner of every pair keeps its surest share
    out /= len(classes) - 1
    return out


LETTERS = np.zeros(256, np.uint8)
for _b in range(256):
    if 0x41 <= _b <= 0x5A or 0x61 <= _b <= 0x7A:
        LETTERS[_b] = _b | 0x20
    elif _b >= 0x80:
        LETTERS[_b] = _b


def features(texts: pa.Array, s: Settings) -> np.ndarray:
    """Hashed byte trigrams of the letters (anything else parts words): square roots of counts, unit length."""
    raw, offsets = text_buffer(texts)
    n = len(offsets) - 1
    out = np.zeros((n, s.dims), np.float32)
    data = LETTERS[raw].astype(np.uint32)
    if len(data) < 3:
        return out
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    h = ((code.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - (s.dims.bit_length() - 1))).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    ok = (doc[:-2] == doc[2:]) & (code != 0)
    out = np.bincount((doc[:-2] * s.dims + h)[ok], minlength=n * s.dims).reshape(n, s.dims)
    out = np.sqrt(out.astype(np.float32))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, s: Settings) -> Linear:
    """Averaged Pegasos on the hinge loss, classes weighted alike; y is +1 or -1. A slope for shares comes after."""
    rng = np.random.default_rng(s.seed)
    w, b, avg, avg_b, t = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1]), 0.0, 0
    weight = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    steps = s.epochs * -(-len(y) // s.batch)
    for _ in range(s.epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), s.batch):
            i = order[k : k + s.batch]
            t += 1
            rate = 1 / (s.reg * (t + 1000))
            hit = y[i] * (x[i] @ w + b) < 1
            g = (weight[i] * y[i] * hit).astype(np.float32)
            w = (1 - rate * s.reg) * w + rate / len(i) * (g @ x[i])
            b += 0.01 * float(g.sum()) / len(i) * min(rate, 10)
            if t > steps // 3:
                avg += w
                avg_b += b
    k = max(t - steps // 3, 1)
    out = Linear((avg / k).astype(np.float32), avg_b / k)
    m = np.abs(out.margin(x))
    out.slope = 3.0 / max(float(np.median(m)), 1e-6) if len(m) else 1.0
    return out


def fit(texts: list[str], langs: list[str], settings: Settings = Settings()) -> Model:
    """Without texts the model answers `und`; a family of one language needs no pair."""
    known = sorted(set(langs))
    of = {lang: f for f, members in FAMILIES.items() for lang in members}
    groups: dict[str, list[str]] = {}
    for lang in known:
        groups.setdefault(of.get(lang, "other"), []).append(lang)
    m = Model(settings, sorted(groups) or ["other"], groups or {"other": [UNDETERMINED]})
    if not texts:
        return m
    x = np.concatenate([features(pa.array(texts[k : k + 256]), settings) for k in range(0, len(texts), 256)])
    lab = np.array(langs, object)
    fam = np.array([of.get(v, "other") for v in langs], object)
    for a, b in combinations(m.families, 2):
        r = np.flatnonzero((fam == a) | (fam == b))
        m.family_pairs[a, b] = svm(x[r], np.where(fam[r] == a, 1, -1), settings)
    for members in m.langs.values():
        for a, b in combinations(members, 2):
            r = np.flatnonzero((lab == a) | (lab == b))
            m.lang_pairs[a, b] = svm(x[r], np.where(lab[r] == a, 1, -1), settings)
    return m


def sample(docs: DataFrame, learn: Column, s: Settings) -> tuple[list[str], list[str]]:
    """For each language at most per_lang texts, those of the least hash of text among a share near that bound."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn & F.octet_length("text").between(1, s.max_bytes))
    counts = {r["lang"]: r["n"] for r in docs.where(F.col("lang").isNotNull() & learn).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, 1.3 * s.per_lang / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(1 << 20)) / float(1 << 20)
    # those of the least hash, by languages; a row's place is the order of its text, so which rows are taken is settled
    first = Window.partitionBy("lang").orderBy("h", "text")
    rows = known.where(draw < share[F.col("lang")]).select("text", "lang", F.xxhash64("text").alias("h"))
    rows = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= s.per_lang).select("text", "lang", "h").collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["h"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    pairs = [(t, lang) for lang, texts in sorted(out.items()) for t in texts[: s.per_lang]]
    return [t for t, _ in pairs], [lang for _, lang in pairs]


def train(docs: DataFrame, learn: Column | None = None, settings: Settings = Settings()) -> Model:
    return fit(*sample(docs, F.lit(True) if learn is None else learn, settings), settings)


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (double, 0 to 1), from the whole text alone.

    `und` with score 0 for null texts and texts without a letter. Ties go to the first class in order of name.
    Repeated rows, null ids and extra columns are kept as they are, whatever their names; one named lang_pred or score gives way
    to the result. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pairs x dims: size fixed by Settings and the learned languages

    def kernel():
        def work(texts: pa.Array) -> list[pa.Array]:
            names, score = shared.value.predict(texts)
            return [pa.array(names, pa.string()), pa.array(score, pa.float64())]

        return work

    flag = unused("lettered", docs.columns)
    flagged = docs.withColumn(flag, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    out = map_text(flagged, kernel, fields, text_col, None if carry is None else [*carry, flag])
    return out.withColumns({"lang_pred": F.when(F.col(flag), F.col("lang_pred")).otherwise(UNDETERMINED), "score": F.when(F.col(flag), F.col("score")).otherwise(0.0)}).drop(flag)
