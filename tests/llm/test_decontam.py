import hashlib
import random
import re

import numpy as np
import pytest

from ontolith.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, window=8):
    grams = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for j in range(max(len(w) - window, 0) + 1):
                grams.setdefault(tuple(w[j : j + window]), set()).add(i)
    out = []
    for d, t in rows:
        w = words(t)
        hit, found = set(), set()
        for size in {len(g) for g in grams}:
            for j in range(len(w) - size + 1):
                g = tuple(w[j : j + size])
                if g in grams:
                    found |= grams[g]
                    hit |= set(range(j, j + size))
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_index(seed):
    rng = np.random.default_rng(seed)
    seq = np.concatenate([rng.integers(1, 4, 300), np.tile(rng.integers(1, 4, 20), 6), [0]])
    sa = D.suffix_array(seq)
    assert sa.tolist() == sorted(range(len(seq)), key=lambda i: seq[i:].tolist())
    w = D.Wavelet(seq, 4)
    at, sym = rng.integers(0, len(seq) + 1, 50), rng.integers(0, 4, 50)
    assert w.rank(sym, at).tolist() == [int((seq[:i] == c).sum()) for i, c in zip(at, sym, strict=True)]
    inside = rng.integers(0, len(seq), 50)
    got, before = w.access(inside)
    assert (got == seq[inside]).all() and before.tolist() == [int((seq[:i] == seq[i]).sum()) for i in inside]


def fixture(rng):
    items = [(i, " ".join(f"b{rng.randrange(60)}" for _ in range(rng.choice([3, 8, 9, 20])))) for i in range(12)] + [(12, "Of"), (13, None), (None, "x y"), (0, "Second text of item zero is this one here")]
    rows = []
    for d in range(80):
        w = [f"b{rng.randrange(60)}" for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            w[5:5] = words(items[d % 12][1])
        rows.append((d, " ".join(w) if d % 11 else None))
    rows += [(80, "OF of\n\n, of!"), (80, "OF of\n\n, of!"), (None, items[3][1]), (81, " ".join(items[5][1] for _ in range(40)))]
    return rows, items


@pytest.mark.parametrize("shard", [60, 1000, 10**6])
def test_against_brute_force(spark, shard):
    rows, items = fixture(random.Random(shard))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = D.scan(docs, bench, shard_words=shard).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in got), key=str) == brute(rows, items)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)


def test_clean_cuts_full_windows(spark):
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! after", "a"), (2, "nothing here", "b"), (3, item, "c"), (4, f"{item} and ten eleven", "d"), (5, None, None)], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame([(1, item), (2, "ten eleven")], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in D.clean(docs, bench).collect()}
    assert got == {1: "Before, ! after", 2: "nothing here", 5: None}


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = D.scan(odd, bench).collect()
    assert len(got) == len(odd_rows) and all(r["n_hit"] == 0 for r in got)
    assert D.clean(odd, bench).count() == len(odd_rows)
    assert D.scan(none, bench).count() == 0


def test_many_blocks_and_odd_rows(spark, odd, odd_rows, monkeypatch):
    """A benchmark in blocks of a few windows finds what one block does, on odd rows too."""
    base, lines = odd_rows[0][1], odd_rows[8][1]
    items = [(1, base), (1, base), (2, lines), (3, "one"), (4, None), (None, base), (5, ""), (6, "\n".join(base.split()[20:40])), (7, odd_rows[11][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = D.blocks_of
    monkeypatch.setattr(D, "blocks_of", lambda b, window: blocks(b, window, 7))
    got = D.scan(odd, bench).collect()
    want = brute([r[:2] for r in odd_rows], items)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in got), key=str) == want


def test_digest():
    assert D.digest({10, 9}) == hashlib.sha256(b"10,9").hexdigest()
