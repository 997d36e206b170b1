import random
import re

import numpy as np
import pytest

from ontolith.llm import ngramjoin as N
from ontolith.llm.util import RID, components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            k = len(a & b)
            if a and b and k >= 0.8 * (len(a) + len(b) - k) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in classes.items()}
    return sorted(((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows)), key=str), len(classes)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def check(spark, rows):
    got = N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, classes = brute(rows)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == want
    assert sum(r["keeps"] for r in got) == classes


def test_odd_rows(spark, odd_rows):
    check(spark, [r[:2] for r in odd_rows])


def test_empty(none):
    assert N.join(none).count() == 0


@pytest.mark.parametrize(("group", "depth"), [(2048, 8), (8, 3)])
def test_hot_groups_and_passages(spark, monkeypatch, group, depth):
    """Small buckets and blocks, so that every way for large groups is taken."""
    monkeypatch.setattr(N, "BUCKET", 8)
    monkeypatch.setattr(N, "GROUP", group)
    monkeypatch.setattr(N, "DEPTH", depth)
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(30)]
    one = [f"a{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(60):  # near copies of one text, around the threshold
        rows.append((i, " ".join(edited(rng, one, rng.randrange(6)))))
    for i in range(60, 110):  # unlike texts with one passage in common, some of them near copies
        own = [f"b{rng.randrange(500)}" for _ in range(25)]
        rows.append((i, " ".join(own[:10] + passage + own[10:])))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join(own[:10] + passage + own[10:] + ["x"])))
    check(spark, rows)


def test_recall_formula():
    rng = np.random.default_rng(0)
    runs, missed = N.runs_for(0.9999, 0.8), 0
    for _ in range(400):
        both, a, b = rng.integers(1, 2**63, 160, dtype=np.uint64), rng.integers(1, 2**63, 20, dtype=np.uint64), rng.integers(1, 2**63, 20, dtype=np.uint64)
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        missed += not set(N.chosen_paths(x, runs)[-1].tolist()) & set(N.chosen_paths(y, runs)[-1].tolist())
    assert missed == 0


@pytest.mark.parametrize("seed", range(3))
def test_exact_links(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) < 0.95], rng.integers(1, 2**63, rng.integers(0, 30), dtype=np.uint64)])) for _ in range(40)]
    weight = rng.integers(1, 4, 40)
    link = np.array([[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for b in sets] for a in sets]) & ~np.eye(40, dtype=bool)
    everyone = np.arange(40)
    total, _ = N.exact_links(sets, weight, everyone, everyone, 0.8)
    assert (total == link @ weight).all()
    left, right = everyone[:15], everyone[15:]
    total, _ = N.exact_links(sets, weight, left, right, 0.8)
    link[:15, :15] = link[15:, 15:] = False
    assert (total == link @ weight).all()


def test_thin_keeps_columns(odd):
    out = N.thin(odd)
    assert out.columns == odd.columns and RID not in out.columns
    assert out.where("doc_id in (1, 2)").count() == 1


def pairs_of(rng, n, extra):
    """n pairs of word lists whose shingle sets are 0.80 to 0.85 alike."""
    out = []
    while len(out) < n:
        one = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 200))] + extra
        two = list(one)
        for _ in range(rng.randrange(1, 9)):
            two[rng.randrange(len(two))] = f"e{rng.randrange(10**6)}"
        a, b = shingles(" ".join(one)), shingles(" ".join(two))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            out.append((one, two))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_recall_at_the_threshold(spark, monkeypatch, small):
    """Whole runs on pairs just over the threshold; with small buckets all of them are split again and again."""
    rng = random.Random(11)
    if small:
        monkeypatch.setattr(N, "BUCKET", 8)
        monkeypatch.setattr(N, "GROUP", 16)
    passage = [f"p{i}" for i in range(40)] if small else []
    pairs = pairs_of(rng, 300, passage)
    rows = [(2 * i + j, " ".join(t)) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = {r["doc_id"]: r for r in N.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1]["class_id"] == 2 * i and got[2 * i]["n_links"] == 1 for i in range(300)) >= 297


def test_packed_blocks():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(1, 2**63, 77, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(77) < 0.9], rng.integers(1, 2**63, k, dtype=np.uint64)])) for k in (0, 5, 1, 0)] + [base[:1], rng.integers(1, 2**63, 3, dtype=np.uint64)]
    rows = [(bytes([i]) * 16, i + 1, np.sort(s)) for i, s in enumerate(sets)]
    got = N.unpack_block(N.pack_block(rows))
    assert [(k, c, s.tolist()) for k, c, s in got] == [(k, c, s.tolist()) for k, c, s in rows]


def joined(monkeypatch):
    """Rows that each join from now on makes."""
    from pyspark.sql.classic.dataframe import DataFrame

    plain, made = DataFrame.join, []

    def join(self, *args, **named):
        out = plain(self, *args, **named)
        made.append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "join", join)
    return made


def test_components_join_open_edges_alone(spark, monkeypatch):
    """Copies that follow other leaders in each bucket: edges are joined once from each end, not again in every round."""
    pairs = {(j, 100 + i) for i in range(600) for j in random.Random(i).sample(range(40), 8)}
    pairs |= {(i, i + 1) for i in range(800, 860)}
    made = joined(monkeypatch)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert got == {x: 0 if x < 800 else 800 for p in pairs for x in p}
    assert sum(made) < 4 * len(pairs)


@pytest.mark.parametrize("seed", range(2))
def test_components_against_plain(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(170)]
    least = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == least
