import random
import re

import pyarrow as pa

from ontolith.llm import linededup as L
from ontolith.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams, hit = {}, set()
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            hit |= {i + j for i in at for j in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_statistics(odd_rows):
    rng = random.Random(1)
    texts = [r[1] for r in odd_rows] + ["\n".join(rng.choice(["a b", "a  b", "", "é ü", "x y z a b"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    got = Q.statistics(pa.array(texts, pa.string()))
    assert list(zip(*(got[k].tolist() for k in Q.COUNTS), strict=True)) == [stats(t) for t in texts]


def test_forest_isolates_outliers():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    s = Q.fit(x).score(x)
    assert s.argmax() == 500 and 0 < s.min() and s.max() < 1


def test_path_lengths_against_plain():
    """A forest's scores are those of walking each row down each tree."""
    import numpy as np

    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (200, 3))
    f = Q.fit(x, trees=16, rows=64)

    def c(n):
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def walk(row, k):
        node = 0
        while f.feature[k, node] >= 0:
            node = 2 * node + (2 if row[f.feature[k, node]] >= f.split[k, node] else 1)
        return f.length[k, node]

    want = [2 ** (-np.mean([walk(row, k) for k in range(16)]) / c(64)) for row in x]
    assert np.allclose(f.score(x), want)


def test_threshold_against_plain(spark, sf):
    """The threshold keeps the asked share of good labelled rows, and no other bin gains more."""
    import numpy as np

    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    got = Q.verdicts(docs, labels).join(labels.where("quality is not null").groupBy("doc_id").agg({"quality": "max"}).withColumnRenamed("max(quality)", "quality"), "doc_id").where("not base_failed").toPandas()
    t, good = got["threshold"].iloc[0], got["quality"] == 1
    assert (got["kept"] == (got["anomaly"] < t)).all()

    def gain(x):
        gone = np.floor(got["anomaly"] * Q.BINS) >= round(x * Q.BINS)
        return (gone & ~good).sum() - (gone & good).sum() if (gone & good).sum() <= (1 - Q.KEEP_GOOD) * good.sum() else -1

    assert gain(t) == max(gain(k / Q.BINS) for k in range(Q.BINS + 1))


def test_forest_draws_from_all_labelled_rows(spark, monkeypatch):
    """Each tree's rows are those of its least draws; together the trees see far more rows than any one pool held."""
    import numpy as np
    import pandas as pd

    n = 20_000
    pdf = pd.DataFrame({"doc_id": range(n), **{k: np.arange(n) * 0 + 100 for k in Q.COUNTS + Q.MORE}})
    # Another feature for each row; ten rows are there five hundred times more.
    pdf["word_chars"] = 2000 + np.arange(n)
    pdf = pd.concat([pdf] + [pdf[:10]] * 500)
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(n)], "doc_id long, quality int")
    seen, plain = [], Q.fit
    monkeypatch.setattr(Q, "fit", lambda x, *args: seen.append(x) or plain(x, *args))
    stats = spark.createDataFrame(pdf)
    Q.calibrate(stats, labels)
    Q.calibrate(stats.repartition(3), labels)
    first, again = seen
    drawn = np.concatenate(first)
    assert len({r.tobytes() for r in drawn}) > 12_000
    assert [len(x) for x in first] == [Q.TREE_ROWS] * Q.TREES
    assert all((a == b).all() for a, b in zip(first, again, strict=True))
    often = {r.tobytes() for r in Q.features(pdf[:10])}
    share = np.mean([r.tobytes() in often for r in drawn])
    assert abs(share - 5010 / 25_000) < 0.01


def test_verdicts_on_odd_rows(odd, odd_rows, none, marks):
    got = Q.verdicts(odd, marks).collect()
    assert len(got) == len(odd_rows)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert all(r["base_failed"] for r in got if r["n_words"] < 50)
    assert Q.verdicts(none, marks).count() == 0
    assert Q.keep(odd, marks.limit(0)).columns == odd.columns


def test_good_rows_stay_and_junk_goes(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    got = Q.verdicts(docs, labels).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)]
    assert n.get((0, True), 0) <= 0.1 * n[(0, False)]


def brute_lines(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, cover = set(), {i: set() for i in order}
    for i in order:
        lines = rows[i][1].split("\n") if rows[i][1] else []
        for p in range(max(len(lines) - 2, 1) if lines else 0):
            w = "\n".join(lines[p : p + 3])
            if WORD.search(w):
                if w in seen:
                    cover[i] |= set(range(p, min(p + 3, len(lines))))
                seen.add(w)
    return sorted(((rows[i][0], "\n".join(x for k, x in enumerate(rows[i][1].split("\n")) if k not in cover[i]) if cover[i] else rows[i][1], len(cover[i])) for i in order), key=str)


def test_line_dedup(spark, odd, odd_rows, none):
    rng = random.Random(5)
    rows = [(i // 2, "\n".join(rng.choice(["a", "b", "", "c d"]) for _ in range(rng.randrange(0, 9)))) for i in range(80)] + [r[:2] for r in odd_rows]
    got = L.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # Rows of one id are told apart by where they lie, so compare what doesn't hang on that.
    want = brute_lines(rows)
    assert sum(r["__gone"] for r in got) == sum(w[2] for w in want)
    assert len(got) == len(rows)
    single = [(i, t) for i, (_, t) in enumerate(rows)]
    got = L.dedup(spark.createDataFrame(single, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"], r["__gone"]) for r in got), key=str) == brute_lines(single)
    assert L.dedup(none).count() == 0
    assert L.dedup(odd).columns == [*(c for c in odd.columns if c not in ("__lines", "__gone")), "__lines", "__gone"]
    tidy = L.tidy(odd)
    assert tidy.columns == odd.columns and {r["starts"] for r in tidy.collect()} == {"mine"}
