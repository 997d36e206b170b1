"""Quality rules: an isolation forest on rule statistics, calibrated on labelled rows.

Rule statistics come from every whole text. Each tree of the forest isolates TREE_ROWS rows, as the method
has it, drawn for that tree from all labelled rows: those of the least hash of the row, the tree and, for
repeated rows, the copy. Every labelled row then sets the threshold through a histogram of its score. A document goes if a base rule fails
(few words, or mostly repeated three-word phrases) or its isolation score passes the threshold.

The forest sees by how much each statistic passes a usual limit. Raw statistics were measured
against that on sf0.1: where 1 % of the good labelled rows are lost, they catch 21 % of the bad
ones and this catches all, since natural spread (length, digits) isolates good rows first. Where no
threshold gains more bad rows than it loses good ones, the forest has no say: threshold is 2 then.

Defined cases: a null or empty text has no words and fails the base rule; null ids are scored
like others and never match a label; repeated rows are each judged alike; with no labelled
rows of both kinds only base rules decide; an empty table gives an empty result; columns of
the input that bear a name of the result are replaced in the query and kept in the filter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .util import cut, numbered

TREES = 128
TREE_ROWS = 256
#: Rows that enter a tree's draw on average, of any number: so many that fewer than TREE_ROWS never do (nine deviations).
ENTRANTS = 440
#: Least share of the good labelled rows that a threshold must keep.
KEEP_GOOD = 0.99
BINS = 2000
MIN_WORDS = 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_digits", "dup_chars", "n_chars_all"]

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_DIGIT = np.isin(np.arange(256), np.arange(0x30, 0x3A))
_HEAD = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Rule statistics of each text."""
    parts = []
    for a, b in X.slices(column):
        t = X.flat(column.slice(a, b - a))
        w = X.split(t, X.NOT_SPACE)
        n, doc = np.diff(w.first), w.doc
        out = {"n_words": n}
        space, head = X.SPACE[t.data], _HEAD[t.data]
        out["word_chars"] = _per_text(head & ~space, t.offsets)
        out["n_symbols"] = _per_text(_SYMBOL[t.data], t.offsets)
        lines = X.split(t, np.arange(256) != 0x0A)
        ldoc = lines.doc
        # A line counts if a word starts in it.
        has = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
        lh = X.span_hash(t.data, lines.start, lines.end) + X.mix(ldoc.astype(np.uint64))
        dup = has & X.repeated(lh)
        again = np.zeros(len(dup), bool)
        where = np.flatnonzero(dup)
        if len(where):
            _, first = np.unique(lh[where], return_index=True)
            again[where] = True
            again[where[first]] = False
        out["n_dup_lines"] = np.bincount(ldoc, again, len(t)).astype(np.int64)
        out["dup_chars"] = np.bincount(ldoc, again * (lines.end - lines.start), len(t)).astype(np.int64)
        h = X.word_hashes(t, w)
        grams, bounds = X.windows(h, w.first, 3)
        gdoc = np.repeat(np.arange(len(t)), np.diff(bounds))
        twice = np.flatnonzero(X.repeated(grams + X.mix(gdoc.astype(np.uint64) + X.U(1))))
        at = twice - bounds[gdoc[twice]] + w.first[gdoc[twice]]
        hit = np.zeros(len(w) + 2, bool)
        for j in range(3):
            hit[at + j] = True
        out["n_repeat_words"] = np.bincount(doc, hit[: len(w)], len(t)).astype(np.int64)
        out["n_digits"] = _per_text(_DIGIT[t.data], t.offsets)
        out["n_chars_all"] = _per_text(head, t.offsets)
        parts.append(out)
    if not parts:
        return {k: np.zeros(0, np.int64) for k in COUNTS + MORE}
    return {k: np.concatenate([p[k] for p in parts]) for k in COUNTS + MORE}


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(s) -> np.ndarray:
    """By how much each statistic passes a usual limit of a filtering rule; 0 within it."""
    get = lambda k: np.asarray(s[k], float)
    words, chars = np.maximum(get("n_words"), 1), np.maximum(get("n_chars_all"), 1)
    inside = np.maximum(get("word_chars"), 1)
    over = lambda ratio, limit: np.log1p(10 * np.maximum(ratio - limit, 0))
    mean = inside / words
    return np.stack(
        [
            over(get("n_symbols") / words, 0.1),
            over(get("dup_chars") / chars, 0.2),
            over(get("n_repeat_words") / words, 0.4),
            over(get("n_digits") / inside, 0.2),
            np.log1p(np.maximum(mean - 10, 0) + np.maximum(3 - mean, 0)),
        ],
        1,
    )


@dataclass
class Forest:
    """Random axis splits; children of node i of a tree are 2i+1 and 2i+2."""

    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    rows: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for f, s, length in zip(self.feature, self.split, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(f) + 1)) - 1):
                inner = f[node] >= 0
                right = x[row, np.maximum(f[node], 0)] >= s[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(_expected(self.rows), 1e-9))


def _expected(n) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def fit(x: np.ndarray | list[np.ndarray], trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11) -> Forest:
    """x: rows that each tree draws its own from, or the rows drawn for each tree."""
    rng = np.random.default_rng(seed)
    drawn = isinstance(x, list)
    trees, rows = (len(x), max(map(len, x))) if drawn else (trees, min(rows, len(x)))
    depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
    size = 2 ** (depth + 1) - 1
    feature, split, length = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for k in range(trees):
        todo = [(0, 0, x[k] if drawn else x[rng.choice(len(x), rows, replace=False)])]
        while todo:
            node, d, part = todo.pop()
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(part.shape[1]),) * 2
            wide = np.flatnonzero(high > low)
            if d == depth or len(part) < 2 or not len(wide):
                length[k, node] = d + _expected(len(part))
                continue
            f = int(rng.choice(wide))
            s = rng.uniform(low[f], high[f])
            feature[k, node], split[k, node] = f, s
            right = part[:, f] >= s
            todo += [(2 * node + 1, d + 1, part[~right]), (2 * node + 2, d + 1, part[right])]
    return Forest(feature, split, length, rows)


_STAT_TYPES = ", ".join(f"{k} long" for k in COUNTS + MORE)


def measure(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id and rule statistics of every row."""

    def run(batches):
        for batch in batches:
            s = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[k]) for k in COUNTS + MORE)], names=["doc_id", *COUNTS, *MORE])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id long, {_STAT_TYPES}")


def _entered(trees: int, share: float, seed: int):
    """Rows (tree, u, x) of rows (statistics, h, copies): what lies under `share` in each tree's draw."""
    seeds = np.array([X.seeded(seed * 1000 + k) for k in range(trees)], np.uint64)

    def run(batches):
        for b in batches:
            x = features({k: b.column(k).to_numpy(zero_copy_only=False) for k in COUNTS + MORE})
            h, copies = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64), b.column("copies").to_numpy(zero_copy_only=False)
            ends = np.cumsum(copies)
            for a in range(0, int(ends[-1]) if len(ends) else 0, 1 << 14):
                at = np.arange(a, min(a + (1 << 14), int(ends[-1])))
                row = np.searchsorted(ends, at, "right")
                copy = X.mix(h[row] + X.mix((at - ends[row] + copies[row]).astype(np.uint64)))
                u = (X.mix(copy[:, None] ^ seeds) >> X.U(11)).astype(np.float64) / (1 << 53)
                i, tree = np.nonzero(u < share)
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(u[i, tree]), pa.array(list(x[row[i]]), pa.list_(pa.float64()))], names=["tree", "u", "x"])

    return run


def draws(known: DataFrame, n: int, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11) -> list[np.ndarray]:
    """The features of each tree's rows, of all n rows. The driver gets about ENTRANTS rows a tree."""
    once = known.groupBy("doc_id", "quality", *COUNTS, *MORE).agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("doc_id", *COUNTS, *MORE))
    got = once.mapInArrow(_entered(trees, ENTRANTS / n, seed), "tree int, u double, x array<double>").toArrow()
    tree, u, x = got["tree"].to_numpy(), got["u"].to_numpy(), np.array(got["x"].to_pylist(), float)
    o = np.lexsort((*x.T, u, tree))
    ends = np.searchsorted(tree[o], np.arange(trees), "right")
    return [x[o[a:b]][:rows] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def calibrate(stats: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD) -> tuple[Forest | None, float]:
    """Fits the forest on draws from all labelled rows and sets the threshold over all of them."""
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = cut(stats.join(marks, "doc_id"))
    n, kinds = known.agg(F.count("*"), F.countDistinct("quality")).first()
    if n < 8 or kinds < 2:
        return None, 2.0
    forest = fit(draws(known, n))

    def run(batches):
        for b in batches:
            s = {k: b.column(k).to_numpy(zero_copy_only=False) for k in COUNTS + MORE}
            bins = np.minimum((forest.score(features(s)) * BINS).astype(np.int64), BINS - 1)
            ok = ~base_failed(s)
            yield pa.RecordBatch.from_arrays([pa.array(bins[ok]), pa.array(b.column("quality").to_numpy(zero_copy_only=False)[ok])], names=["bin", "quality"])

    seen = known.mapInArrow(run, "bin long, quality int").groupBy("bin", "quality").count().toPandas()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for b, q, n in seen.itertuples(index=False):
        (good if q else bad)[int(b)] += n
    above = lambda v: np.concatenate([np.cumsum(v[::-1])[::-1], [0]])
    lost, caught = above(good), above(bad)
    fine = lost <= (1 - keep_good) * max(good.sum(), 1)
    gain = np.where(fine, caught - lost, -1)
    best = int(np.flatnonzero(gain == gain.max())[-1])
    return (forest, best / BINS) if gain[best] > 0 else (None, 2.0)


def _judge(s, forest, threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    score = forest.score(features(s)) if forest and len(s["n_words"]) else np.zeros(len(s["n_words"]))
    failed = base_failed(s)
    return score, failed, ~failed & (score < threshold)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: statistics, isolation score and its threshold (2: the forest has no say), base rule and verdict."""
    stats = cut(measure(docs))
    forest, threshold = calibrate(stats, labels)

    def run(batches):
        for b in batches:
            s = {k: b.column(k).to_numpy(zero_copy_only=False) for k in COUNTS + MORE}
            score, failed, kept = _judge(s, forest, threshold)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array(failed), pa.array(kept)], names=[*b.schema.names, "anomaly", "base_failed", "kept"])

    judged = stats.mapInArrow(run, f"doc_id long, {_STAT_TYPES}, anomaly double, base_failed boolean, kept boolean")
    return judged.select("doc_id", *COUNTS, "anomaly", F.lit(float(threshold)).alias("threshold"), "base_failed", "kept")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Texts are read once; statistics are written beside the rows."""
    plain, names = numbered(docs)
    text = plain.columns.index(names["text"])
    number = F.col(names["doc_id"]).cast("long") if "doc_id" in names else F.lit(None).cast("long")
    rows = plain.withColumn("doc_id", number)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def measured(batches):
        for b in batches:
            s = statistics(b.column(text))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(s[k]) for k in COUNTS + MORE)], names=[*b.schema.names, *COUNTS, *MORE])

    known = cut(rows.mapInArrow(measured, f"{fields}, {_STAT_TYPES}"))
    forest, threshold = calibrate(known.select("doc_id", *COUNTS, *MORE), labels)

    def judged(batches):
        for b in batches:
            s = {k: b.column(k).to_numpy(zero_copy_only=False) for k in COUNTS + MORE}
            yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names=list(names.values())).filter(pa.array(_judge(s, forest, threshold)[2]))

    return known.mapInArrow(judged, plain.schema).toDF(*names)
