"""Toxicity by a convolutional text classifier trained in numpy.

Lower-cased words and their first bytes (PREFIXES) are hashed to embeddings, a word's vector
being their sum; filters of several widths run over the whole text, their maxima are pooled
and a linear layer gives a logit. Embeddings start from each bucket's log-odds in one part of
the fit sample (two fifths), the weights are trained on another (two fifths) and thresholds set on
the last fifth, whose rows were in neither; with under 60 rows of a label all parts are the whole.
The fit sample is bounded: FIT_ROWS rows of each label at most, those with the least hash of doc_id, of the rows
that aren't held out. Thresholds are calibrated by language: the language is told from the
text's own function words, and each language's logits are shifted so that its best threshold
falls on CUT. Labels, lang, source and ids are no inputs of a score.

Defined cases: null and empty texts are scored as texts without words; very long texts are scored
whole (maxima over all their windows); null ids are never
held out and match no label; repeated rows score alike; a sample without both labels gives
every text the score 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .util import held_out

BUCKETS = 1 << 16
PREFIXES = (5, 7)
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
FIT_ROWS = 2500
EPOCHS = 40
CUT = 0.7
#: A language with fewer calibration rows of a label uses the threshold of all.
LEAST_ROWS = 8

# Frequent function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the and of to in that is was for with on be at by this from it as",
    "de": "der die und das nicht von mit den dem sich ist ein eine auf zu für im des",
    "fr": "le la les des et que dans pour une est pas du qui sur par au un avec",
    "es": "el los las del que se con por para una su al lo como en y es un",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def _function_hashes():
    out = []
    for words in FUNCTION_WORDS.values():
        t = X.flat(pa.array([words]))
        out.append(np.sort(X.word_hashes(t, X.split(t, X.ALNUM))))
    return out


@dataclass
class Bags:
    """Bucket ids of each word and its prefixes (rows); texts are followed by padding so that no window crosses them."""

    ids: np.ndarray
    start: np.ndarray
    language: np.ndarray


def bags(column: pa.Array) -> Bags:
    t = X.flat(column)
    w = X.split(t, X.ALNUM, lower=True)
    h = X.word_hashes(t, w, lower=True)
    pad = max(WIDTHS)
    n = np.diff(w.first)
    doc = w.doc
    start = w.first[:-1] + pad * np.arange(len(n))
    ids = np.full((1 + len(PREFIXES), len(h) + pad * len(n)), BUCKETS, np.int32)
    at = np.arange(len(h)) + pad * doc
    lower = X.LOWER[t.data]
    for r, size in enumerate((0, *PREFIXES)):
        k = X.span_hash(lower, w.start, np.minimum(w.end, w.start + size)) if size else h
        ids[r, at] = (X.mix(k + X.U(r)) >> X.U(40)).astype(np.int64) % BUCKETS
    votes = np.stack([np.bincount(doc, X.member(h, f), len(n)) for f in _function_hashes()] + [np.full(len(n), 0.5)], 1) if len(n) else np.zeros((0, len(LANGUAGES)))
    return Bags(ids, start, votes.argmax(1) if len(n) else np.zeros(0, int))


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS + 1 rows, the last for padding
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    dense: np.ndarray
    offset: float
    kind: type = np.float32

    def tables(self) -> list[list[np.ndarray]]:
        """What each bucket adds at each place of each filter."""
        return [[(self.embedding @ f[j]).astype(self.kind) for j in range(len(f))] for f in self.filters]


def activations(b: Bags, parts: list[np.ndarray]) -> np.ndarray:
    """One filter group at every word; windows end with their text's padding."""
    c = sum(parts[0][r] for r in b.ids)
    for j in range(1, len(parts)):
        more = sum(parts[j][r[j:]] for r in b.ids)
        more[(b.start[1:, None] - np.arange(1, j + 1)).ravel()] = 0
        c[:-j] += more
    return c


def pooled(b: Bags, tables, bias) -> np.ndarray:
    """Maxima over each text of every filter."""
    if not len(b.start):
        return np.zeros((0, FILTERS * len(WIDTHS)))
    return np.concatenate([np.maximum.reduceat(activations(b, parts), b.start, axis=0) + beta for parts, beta in zip(tables, bias, strict=True)], 1)


def logits(tables, model: Model, b: Bags) -> np.ndarray:
    return np.tanh(pooled(b, tables, model.bias)) @ model.dense + model.offset


def log_odds(b: Bags, y: np.ndarray) -> np.ndarray:
    """How much more often a bucket occurs in texts of label 1; buckets of few texts say little."""
    doc = np.repeat(np.arange(len(y)), np.diff(np.append(b.start, b.ids.shape[1])))
    pairs = np.unique(np.concatenate([doc.astype(np.int64) * (BUCKETS + 1) + r for r in b.ids]))
    bucket, pos = pairs % (BUCKETS + 1), y[pairs // (BUCKETS + 1)] == 1
    a, z = np.bincount(bucket[pos], minlength=BUCKETS + 1), np.bincount(bucket[~pos], minlength=BUCKETS + 1)
    odds = np.log((a + 0.5) / (y.sum() + 1)) - np.log((z + 0.5) / ((1 - y).sum() + 1))
    odds *= (a + z) / (a + z + 4)
    odds[-1] = 0
    return np.clip(odds, -2, 4)


def gradients(m: Model, b: Bags, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray], float]:
    """Weighted log loss, its gradient by embedding, filters, biases and dense weights, and by the offset; only words at the maxima get one."""
    end = np.append(b.start[1:], b.ids.shape[1])
    doc = np.repeat(np.arange(len(y)), end - b.start)
    kept = [activations(b, parts) for parts in m.tables()]
    tops = [np.maximum.reduceat(c, b.start, axis=0) for c in kept]
    a = np.tanh(np.concatenate([top + beta for top, beta in zip(tops, m.bias, strict=True)], 1))
    z = a @ m.dense + m.offset
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
    dz = (1 / (1 + np.exp(-z)) - y) * weight
    dp = dz[:, None] * m.dense[None, :] * (1 - a**2)
    ge, gf, gb = np.zeros_like(m.embedding), [], []
    for w, (f, c, top) in enumerate(zip(m.filters, kept, tops, strict=True)):
        d = dp[:, w * FILTERS : (w + 1) * FILTERS]
        g = np.zeros_like(f)
        for k in range(FILTERS):
            hits = np.flatnonzero(c[:, k] == top[doc, k])
            at = hits[np.unique(doc[hits], return_index=True)[1]]
            for j in range(len(f)):
                for r in b.ids:
                    word = np.where(at + j < end, r[np.minimum(at + j, len(r) - 1)], BUCKETS)
                    g[j, :, k] += d[:, k] @ m.embedding[word]
                    np.add.at(ge, word, d[:, k, None] * f[j, :, k][None, :])
        gf.append(g), gb.append(d.sum(0))
    ge[-1] = 0
    return loss, [ge, *gf, *gb, a.T @ dz], float(dz.sum())


def train(odds: np.ndarray, b: Bags, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Full-batch Adam."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.02, (BUCKETS + 1, DIM))
    e[:, 0] = odds / 2
    e[-1] = 0
    filters = [rng.normal(0, 0.05, (k, DIM, FILTERS)) for k in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] += 0.5 / len(f)
    # Filters of one width start apart by their thresholds.
    m = Model(e, filters, [np.tile(np.linspace(-2.0, 0.5, FILTERS // 2), 2) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), 0.0)
    for w in range(len(WIDTHS)):
        m.dense[w * FILTERS : w * FILTERS + FILTERS // 2] = 0.5
    params = [m.embedding, *m.filters, *m.bias, m.dense]
    rates = [0.003, *[0.01] * len(WIDTHS), *[0.02] * len(WIDTHS), 0.03]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    offset_m = [0.0, 0.0]
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for step in range(1, epochs + 1):
        _, grads, g0 = gradients(m, b, y, weight)
        grads[-1] += 1e-3 * m.dense
        for q, g, (v1, v2), rate in zip(params, grads, moments, rates, strict=True):
            v1 += 0.1 * (g - v1)
            v2 += 0.01 * (g * g - v2)
            q -= rate * (v1 / (1 - 0.9**step)) / (np.sqrt(v2 / (1 - 0.99**step)) + 1e-6)
        offset_m[0] += 0.1 * (g0 - offset_m[0])
        offset_m[1] += 0.01 * (g0 * g0 - offset_m[1])
        m.offset -= 0.03 * (offset_m[0] / (1 - 0.9**step)) / ((offset_m[1] / (1 - 0.99**step)) ** 0.5 + 1e-6)
    return m


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap with the best F1."""
    o = np.argsort(-z)
    hit = np.cumsum(y[o])
    f1 = 2 * hit / (np.arange(1, len(o) + 1) + y.sum())
    top = np.append(z[o], z.min() - 1)
    f1[top[:-1] == top[1:]] = -1
    k = int(f1.argmax())
    return float((top[k] + top[k + 1]) / 2)


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, folds: int = 3):
    """At most `rows` labelled texts of each label; labels by the largest where an id has several."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    marks = marks.where(~held_out("doc_id", folds))
    picked = None
    for y in (0, 1):
        some = marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = some if picked is None else picked.unionByName(some)
    # Few ids by the bound above: texts of others never move.
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(2 * rows)
    return got.select("text", "y").toArrow()


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, folds: int = 3):
    """The model and the threshold of each language, or None without both labels."""
    got = sample(docs, labels, rows, folds)
    y = got.column("y").to_numpy().astype(int)
    if len(y) < 4 or y.min() == y.max():
        return None
    text = got.column("text").combine_chunks()
    part = np.arange(len(y)) % 5
    if min(y.sum(), (1 - y).sum()) < 60:
        part[:] = -1  # too few to divide
    pick = lambda *k: (part < 0) | np.isin(part, k)
    of = lambda rows: (bags(text.filter(pa.array(rows))), y[rows])
    model = train(log_odds(*of(pick(0, 1))), *of(pick(2, 3)))
    # Rows that neither the embeddings nor the weights have seen.
    b, t = of(pick(4))
    z = logits(model.tables(), model, b)
    whole = best_threshold(z, t) if t.any() and not t.all() else 0.0
    cuts = np.full(len(LANGUAGES), whole)
    for k in range(len(LANGUAGES)):
        own = b.language == k
        if min(t[own].sum(), (1 - t[own]).sum()) >= LEAST_ROWS:
            cuts[k] = best_threshold(z[own], t[own])
    return model, cuts


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, folds: int = 3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, language told from the text."""
    fitted = fit(docs, labels, rows, folds)
    shared = docs.sparkSession.sparkContext.broadcast(fitted and (fitted[0].tables(), fitted[0].bias, fitted[0].dense, fitted[0].offset, fitted[1]))
    anchor = np.log(CUT / (1 - CUT))

    def run(batches):
        given = shared.value
        for batch in batches:
            for s, e in X.slices(batch.column(2), 1 << 20):
                sub = batch.slice(s, e - s)
                b = bags(sub.column(2))
                p = np.zeros(len(b.start))
                if given:
                    tables, bias, dense, offset, cuts = given
                    z = np.tanh(pooled(b, tables, bias)) @ dense + offset
                    p = 1 / (1 + np.exp(-(z - cuts[b.language] + anchor)))
                yield pa.RecordBatch.from_arrays([sub.column(0), sub.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32)), pa.array(np.array(LANGUAGES)[b.language].tolist(), pa.string())], names=["doc_id", "held_out", "score", "predicted", "told_lang"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", folds).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, told_lang string")
