import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ontolith.llm import chat as C
from ontolith.llm import licenses as N
from ontolith.llm import queries
from ontolith.llm import tokens as K


@pytest.fixture(scope="module")
def enc():
    return K.encoder(K.load())


def test_edits_against_full_encoding(enc):
    rng = random.Random(0)
    count = lambda s: len(enc.encode_ordinary(s))
    alphabet = ["word", " ", "  ", "\n", "é", "12", "'s", "!?", "\t ", " x", "\x1c", "日本"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200)))
        tree = K.SegmentTree(text, count, leaf=rng.choice([1, 5, 20]))
        assert tree.total == count(text)
        for _ in range(8):
            a = rng.randrange(0, len(text) + 3)
            b = a + rng.randrange(0, 12)
            new = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 4)))
            tree.replace(a, b, new)
            text = text[:a] + new + text[b:] if a <= len(text) else text + new
            assert tree.text() == text and tree.total == count(text) and tree.length == len(text)


def test_edit_is_local(enc):
    text = "some words here " * 20000
    tree = K.SegmentTree(text, lambda s: len(enc.encode_ordinary(s)))
    tree.encoded = 0
    tree.replace(100_000, 100_004, "else")
    assert tree.encoded < 5 * K.LEAF


def test_many_edits_in_one_place_stay_local(enc):
    count = lambda s: len(enc.encode_ordinary(s))
    text = "some words here " * 20000
    tree = K.SegmentTree(text, count)
    for i in range(400):
        new = f" number {i}" * 60
        tree.replace(100_000, 100_000, new)
        text = text[:100_000] + new + text[100_000:]
    tree.encoded = 0
    tree.replace(100_500, 100_501, "x")
    text = text[:100_500] + "x" + text[100_501:]
    assert tree.encoded < 5 * K.LEAF and tree.text() == text and tree.total == count(text)


def test_stored_trees(spark, odd, odd_rows, enc):
    """Edits applied to a stored table give what whole encoding gives, and re-encode little."""
    trees = K.build(odd, leaf=64)
    assert trees.count() == len(odd_rows)
    edits = spark.createDataFrame([(9, 2, 70, 75, " two words "), (9, 1, 0, 3, ""), (3, 1, 0, 0, "new"), (77, 1, 0, 0, "x"), (None, 1, 0, 1, "")], "doc_id long, seq long, start long, end long, replacement string")
    done = K.apply_edits(trees, edits, leaf=64)
    got = {r["doc_id"]: (r["n_chars"], r["n_tokens"]) for r in K.totals(done).collect()}
    long = next(r[1] for r in odd_rows if r[0] == 9)[3:]
    long = long[:70] + " two words " + long[75:]
    assert got[9] == (len(long), len(enc.encode_ordinary(long))) and got[3] == (3, len(enc.encode_ordinary("new")))
    assert done.where("doc_id = 9").first()["reencoded"] < 1000
    assert "".join(s["text"] for s in done.where("doc_id = 9").first()["segments"]) == long


def test_counts_on_odd_rows(spark, odd, odd_rows, none, enc):
    got = K.count(odd).collect()
    for r, row in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["n_chars_before"])), sorted(odd_rows, key=lambda r: (str(r[0]), len(r[1] or ""))), strict=True):
        text = row[1] or ""
        assert r["n_tokens"] == len(enc.encode_ordinary(text))
        for a, b, new in K.script_edits(text):
            text = text[:a] + new + text[b:]
        assert r["n_tokens_after"] == len(enc.encode_ordinary(text)) and r["n_chars_after"] == len(text)
    edits = spark.createDataFrame([(11, 1, 0, 1, "T"), (11, 2, 1, 99, "wo"), (None, 1, None, None, None), (77, 1, 0, 0, "x")], "doc_id long, seq long, start long, end long, replacement string")
    after = {r["doc_id"]: r for r in K.count(odd, edits).collect()}
    assert after[11]["n_tokens_after"] == len(enc.encode_ordinary("Two")) and after[12]["n_edits"] == 0
    assert K.count(none).count() == 0


def test_round_trip():
    nasty = ["", "\\", "<|", "<\\|im_end|>", C.OPEN, C.CLOSE, "a\nb", "\\n", "<<||", "\\\\<|"]
    rng = random.Random(1)
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "odd\nrole", "\\n", "<|x"]), "".join(rng.choice(nasty) for _ in range(3))) for _ in range(rng.randrange(5))]
        text, spans = C.render(turns)
        assert C.parse(text) == turns
        assert [C.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_query(spark, sf):
    got = {r["conv_id"]: r for r in queries.op8_chat_formatting(spark, sf).collect()}
    rows = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        rows.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    rows[-1] = [(0, "user", queries.ADDED), (1, "assistant", queries.ADDED)]
    assert set(got) == set(rows)
    for c, turns in rows.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "thanks", 0.0), (1, 4, 3, "user", "thanks", 0.0), (2, 1, 9, None, None, None), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0), (3, 3, 2, "user", "off a loop", 0.0)]
    rows += [(4, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(40)] + [(None, 1, None, "assistant", "x", 1.0)]
    got = {r["conv_id"]: C.parse(r["formatted"]) for r in C.format_chats(spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")).collect()}
    assert got == {1: [("user", "q"), ("assistant", "good"), ("user", "thanks")], 2: [("", "")], 4: [("user", str(i)) for i in range(40)], None: [("assistant", "x")]}
    everything = C.format_chats(spark.createDataFrame(rows[:3], "conv_id long, msg_id long, parent_id long, role string, text string, score double"), keep=None).count()
    assert everything == 2
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.format_chats(C.as_messages(none)).count() == 0


def test_cycles_stay_small(spark):
    """Leaves below cycles, beside one long chain: no row of theirs multiplies, and the rest is whole."""
    rows = [(1, i, (i + 1) % 3, "user", "loop", 0.0) for i in range(3)] + [(1, 10 + i, i % 3 if i < 3 else 9 + i, "user", "below", 0.0) for i in range(300)]
    rows += [(2, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(1000)]
    frame = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    p = C.paths(frame)
    assert p.count() == 1000 and p.select("conv_id").distinct().collect() == [(2,)]


def test_ranking_ties_and_odd_columns(spark):
    """Equal scores: the longer path, then the least leaf; long texts whole; clashing columns not read."""
    long = "word " * 60000
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 1.0), (2, 1, None, "user", "q", 0.0), (2, 2, 1, "assistant", "a", 0.0), (2, 3, 2, "user", long, 0.0), (2, 4, 1, "assistant", "other", 0.0)]
    frame = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    for extra in ("leaf", "up", "anc", "rank", "turns", "formatted"):
        frame = frame.withColumn(extra, F.lit("mine"))
    got = {r["conv_id"]: C.parse(r["formatted"]) for r in C.format_chats(frame).collect()}
    assert got == {1: [("user", "q"), ("assistant", "a")], 2: [("user", "q"), ("assistant", "a"), ("user", long)]}
    best = C.branches(frame, keep=2).where("conv_id = 1").orderBy("rank").collect()
    assert [(r["leaf"], r["rank"]) for r in best] == [(2, 1), (3, 2)]


def test_licence_headers(spark):
    rows = [(f"a/{i}.py", f"# intro\n# {t}\ncode follows here") for i, (_, t) in enumerate(N.TEMPLATES)] + [("a/none.py", "plain text about a license plate"), ("a/null", None), (None, "Released under the MIT License.")]
    got = {r["path"]: r for r in N.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert all(got[f"a/{i}.py"]["license"] == name for i, (name, _) in enumerate(N.TEMPLATES))
    assert got["a/none.py"]["license"] is None and got["a/null"]["license"] is None and got[None]["license"] == "MIT"


def test_licence_split_over_lines(spark):
    rows = [("x", "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software\nand associated documentation files\nmore")]
    assert N.scan(spark.createDataFrame(rows, "path string, text string")).first()["license"] == "MIT"


def plain_best(text, templates, idf, rarest, span):
    """Every run of lines against every header, by dictionaries."""
    import collections
    import math
    import re

    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower())
    vector = lambda ws: {t: n * idf.get(t, rarest) for t, n in collections.Counter(ws).items()}
    out = (0.0, None)
    lines = [x for x in text.split("\n") if x]
    for size in range(1, span + 1):
        for i in range(len(lines) - size + 1):
            ws = words(" ".join(lines[i : i + size]))
            v = vector(ws)
            # Words outside the templates each count on their own.
            norm = math.sqrt(sum(x * x for t, x in v.items() if t in idf) + rarest**2 * sum(t not in idf for t in ws))
            for name, x in templates:
                u = vector(words(x))
                dot = sum(v.get(t, 0) * y for t, y in u.items())
                out = max(out, (dot / (norm * math.sqrt(sum(y * y for y in u.values()))) if norm else 0.0, name), key=lambda p: p[0])
    return out


def test_cosines_against_plain():
    import math
    import re

    import pyarrow as pa

    rng = random.Random(6)
    pool = [w for _, x in N.TEMPLATES for w in x.split()] + [f"z{i}" for i in range(40)]
    texts = ["\n".join(" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    texts += ["\n".join(rng.sample([x for _, x in N.TEMPLATES], 3)) for _ in range(20)]
    words = lambda x: set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower()))
    known = set().union(*(words(x) for _, x in N.TEMPLATES))
    idf = {t: math.log((len(texts) + 1) / (sum(t in words(x) for x in texts) + 1)) + 1 for t in known}
    m, column = N.Templates(N.TEMPLATES), pa.array(texts)
    counted = next(N._frequencies(m)([pa.record_batch([column], names=["text"])])).column("n").to_numpy()
    m.weigh(counted[:-1], int(counted[-1]))
    _, got, _ = N.best(column, m, 0.0, N.SPAN, block=7)
    for x, sim in zip(texts, got, strict=True):
        assert abs(sim - plain_best(x, N.TEMPLATES, idf, math.log(len(texts) + 1) + 1, N.SPAN)[0]) < 1e-9


def test_whole_licence_files(spark):
    rows = [(str(i), "Copyright (c) 2020 A. Body\n\n" + "\n".join(x[j : j + 70] for j in range(0, len(x), 70))) for i, (_, x) in enumerate(N.WHOLE)]
    got = {r["path"]: r["license"] for r in N.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {str(i): n for i, (n, _) in enumerate(N.WHOLE)}


def test_many_lines_in_bounded_memory():
    import resource

    import numpy as np
    import pyarrow as pa

    m = N.Templates(N.TEMPLATES, N.WHOLE).weigh(np.ones(len(N.Templates(N.TEMPLATES, N.WHOLE).vocabulary)), 10)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    N.best(pa.array(["of\n" * 400_000 + "Released under the MIT License."]), m, N.THRESHOLD, N.SPAN)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_inheritance(spark):
    rows = [("LICENSE", "MIT", 1.0), ("a/COPYING.txt", "GPL-3.0", 0.9), ("a/LICENSE", "Apache-2.0", 0.95), ("a/b/c/x.py", None, 0.0), ("d/e.py", None, 0.0), ("a/own.py", "BSD-3-Clause", 1.0), (None, None, 0.0), ("top.py", None, 0.0)]
    got = {r["path"]: (r["license"], r["origin"], r["licence_folder"]) for r in N.inherit(spark.createDataFrame(rows, "path string, license string, similarity double")).collect()}
    assert got["a/b/c/x.py"] == ("Apache-2.0", "inherited", "a") and got["d/e.py"] == ("MIT", "inherited", "") and got["top.py"] == ("MIT", "inherited", "")
    assert got["a/own.py"] == ("BSD-3-Clause", "own", None) and got[None] == (None, "none", None)


def test_licence_odd_rows(odd, odd_rows, none):
    assert N.scan(odd).count() == len(odd_rows)
    kept = N.inherit(N.scan(odd).withColumn("path", F.concat(F.lit("a/"), F.col("doc_id").cast("string"))))
    assert {r["near"] for r in kept.collect()} == {"mine"} and kept.count() == len(odd_rows)
    assert N.inherit(N.scan(none).withColumn("path", F.lit("x"))).count() == 0
    assert N.scan(none).count() == 0
