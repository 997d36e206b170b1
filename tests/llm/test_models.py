import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ontolith.llm import lm as M
from ontolith.llm import mixing as B
from ontolith.llm import toxicity as T
from ontolith.llm import textops as X


def held(i, n):
    return i is not None and zlib.crc32(str(i).encode()) % n == 1


def tokens(text):
    import re

    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def code_of(text):
    return b"".join((w.encode() + b" ") if w is not None else b"\n" for w in tokens(text))


class Plain:
    """PPM as it is told: half counts for escapes, symbols of longer contexts excluded, each counted once a longer context."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {}
        for t in texts:
            s = b"\n" * order + code_of(t)
            for i in range(order, len(s)):
                for k in range(order, -1, -1):
                    own = self.counts.setdefault(s[i - k : i], {})
                    own[s[i]] = own.get(s[i], 0) + 1
                    if own[s[i]] > 1:
                        break

    def log10(self, context, symbol):
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            own = self.counts.get(context[len(context) - k :])
            if own is None:
                continue
            free = {c: n for c, n in own.items() if c not in excluded}
            if not free:
                continue
            total = 2 * sum(free.values())
            if symbol in free:
                return out + np.log10((2 * free[symbol] - 1) / total)
            out += np.log10(len(free) / total)
            excluded |= set(free)
        return out - np.log10(256 - len(excluded))

    def score(self, text):
        s = b"\n" * self.order + code_of(text)
        return sum(self.log10(s[i - self.order : i], s[i]) for i in range(self.order, len(s)))


def test_ppm_against_plain(spark, odd_rows, none):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Abra", "cad", "abra", "ab", "é"]) for _ in range(rng.randrange(12)))) for i in range(40)]
    rows += [(i, t) for i, t, *_ in odd_rows if len(t or "") < 5000]
    model = Plain([t for i, t in rows if not held(i, 5)], 3)
    train = [w for i, t in rows if not held(i, 5) for w in tokens(t)]
    count = {w: train.count(w) for w in set(train)}
    got = M.score(spark.createDataFrame(rows, "doc_id long, text string"), order=3, frequent=4).collect()
    key = lambda r: (str(r[0]), round(r[1], 6))
    want = []
    for i, t in rows:
        base = sum(np.log10((count.get(w, 0) + 0.5) / (len(train) + 0.5 * (len(count) + 1))) for w in tokens(t))
        want.append((i, model.score(t), base, len(tokens(t)), sum(w in count for w in tokens(t)), len(train), held(i, 5)))
    have = [(r["doc_id"], r["score"], r["base_score"], r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) for r in got]
    for a, b in zip(sorted(have, key=key), sorted(want, key=key), strict=True):
        assert a[0] == b[0] and np.allclose(a[1:3], b[1:3]) and a[3:] == b[3:]
    assert M.score(none).count() == 0


def test_trie_adds_up():
    text = "the cat sat on the mat and the dog sat there too " * 2 + "a dog sat"
    t = X.flat(pa.array([text]))
    data, bounds, _ = M.streams(t, X.split(t, X.NOT_SPACE), 3)
    trie = M.Trie(M.lower_orders(*M._tally(M.grams(data, bounds, 3)), 3))
    for context in (b"the", b"zzz", b" sa", b"\n\n\n"):
        code = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert np.isclose((10.0 ** trie.score(code)).sum(), 1)


@pytest.mark.parametrize("keys", [[], [0], [3, 2**56 - 1], list(range(1000))])
def test_packed_numbers(keys):
    keys = np.array(keys, np.uint64)
    assert (M.unpack_sorted(M.pack_sorted(keys)) == keys).all()
    assert (M.unpack(M.pack(keys.astype(np.float32)), np.float32) == keys.astype(np.float32)).all()


def test_every_gram_counts_in_small_chunks(spark, monkeypatch):
    """Chunks of one slice and grams seen once: scores are those of all counts."""
    monkeypatch.setattr(M, "CHUNK_BYTES", 1)
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abcdeéx") for _ in range(5)) for _ in range(30))) for i in range(60)]
    model = Plain([t for i, t in rows if not held(i, 5)], M.ORDER)
    # More grams than a model of a fixed size could be asked to hold.
    monkeypatch.setattr(M, "MAX_NODES", 64, raising=False)
    defaults = M.score.__defaults__
    monkeypatch.setattr(M.score, "__defaults__", tuple(64 if d == 1 << 21 else d for d in defaults))
    got = {r["doc_id"]: r["score"] for r in M.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows) and all(np.isclose(got[i], model.score(t)) for i, t in rows)


def test_words_are_no_rows(spark, monkeypatch):
    """Tables written on the way have rows by documents, chunks and parts, however many words there are."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"{rng.randrange(36**6):x}" for _ in range(500))) for i in range(40)]
    plain, seen = M.cut, []
    monkeypatch.setattr(M, "cut", lambda df: seen.append(plain(df)) or seen[-1])
    monkeypatch.setattr(M, "release", lambda *frames: None)
    assert M.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).count() == 40
    assert max(df.count() for df in seen) <= max(40, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_a_chunk_holds_few_bytes_a_gram(monkeypatch):
    """Of a chunk's distinct grams and of those that come back, tasks hold the keys about twice."""
    import tracemalloc

    monkeypatch.setattr(M, "CHUNK", 1 << 14)
    rng = np.random.default_rng(2)
    texts = [bytes(x).decode() for x in rng.integers(97, 123, (200, 4000), dtype=np.uint8)]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array([i % 5 == 1 for i in range(n)]), pa.array(texts)], names=["part", "doc_id", "held_out", "text"])
    # Texts of a slice are not what is measured.
    monkeypatch.setattr(X, "slices", lambda column, most=0: [(i, i + 4) for i in range(0, len(column), 4)])
    (chunk,) = M._packed([batch])
    tracemalloc.start()
    for _ in M._asked(M.ORDER, M.SPLIT, 64)([chunk.select(["chunk", "rows"])]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 55 * 4000 * n


def test_beats_unigrams(spark, sf):
    p = M.score(spark.read.parquet(f"{sf}/../sf0.1/documents.parquet")).where("held_out").toPandas()
    assert p["score"].sum() > p["base_score"].sum()


def test_toxicity_held_out(spark, sf):
    d, lab = (spark.read.parquet(f"{sf}/../sf0.1/{n}.parquet") for n in ("documents", "labels"))
    p = T.score(d, lab).join(lab, "doc_id").where("held_out").toPandas()
    hit = ((p["predicted"] == 1) & (p["toxic"] == 1)).sum()
    assert hit >= 0.8 * p["toxic"].sum() and hit >= 0.85 * p["predicted"].sum()
    assert p["score"].between(0, 1).all() and ((p["score"] >= 0.7) == (p["predicted"] == 1)).all()


def test_toxicity_odd_rows(odd, odd_rows, none, marks):
    got = T.score(odd, marks).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in T.score(odd, marks.limit(0)).collect())
    assert T.score(none, marks).count() == 0


def small_model(rng):
    m = T.Model(rng.normal(0, 0.3, (T.BUCKETS + 1, T.DIM)), [rng.normal(0, 0.3, (k, T.DIM, T.FILTERS)) for k in T.WIDTHS], [rng.normal(0, 0.1, T.FILTERS) for _ in T.WIDTHS], rng.normal(0, 0.5, T.FILTERS * len(T.WIDTHS)), 0.1, np.float64)
    m.embedding[-1] = 0
    return m


TEXTS = ["one two three four", "", "a", "two words here and the other words there again", "x " * 30]


def test_forward_pass_against_naive_convolution():
    rng = np.random.default_rng(2)
    m, b = small_model(rng), T.bags(pa.array(TEXTS))
    bounds, got = [*b.start, b.ids.shape[1]], T.logits(m.tables(), m, b)
    for i in range(len(TEXTS)):
        # A word's vector is the sum of its buckets'; the padding is zero.
        v = sum(m.embedding[r[bounds[i] : bounds[i + 1]]] for r in b.ids)
        v = np.concatenate([v, np.zeros((max(T.WIDTHS), T.DIM))])
        top = [max(sum(v[p + j] @ f[j, :, k] for j in range(len(f))) for p in range(bounds[i + 1] - bounds[i])) + beta[k] for f, beta in zip(m.filters, m.bias, strict=True) for k in range(T.FILTERS)]
        assert np.isclose(got[i], np.tanh(top) @ m.dense + m.offset)


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(4)
    m, b, y = small_model(rng), T.bags(pa.array(TEXTS)), np.array([1, 0, 1, 0, 1])
    weight = rng.uniform(0.1, 1, 5)
    _, grads, g0 = T.gradients(m, b, y, weight)
    params = [m.embedding, *m.filters, *m.bias, m.dense]
    used = np.unique(b.ids[b.ids < T.BUCKETS])
    for p, g in zip(params, grads, strict=True):
        for _ in range(6):
            at = (int(rng.choice(used)), int(rng.integers(T.DIM))) if p is m.embedding else tuple(int(rng.integers(n)) for n in p.shape)
            held, slope = p[at], []
            for d in (1e-6, -1e-6):
                p[at] = held + d
                slope.append(T.gradients(m, b, y, weight)[0])
            p[at] = held
            assert np.isclose((slope[0] - slope[1]) / 2e-6, g[at], atol=1e-6)
    up, down = (T.gradients(T.Model(m.embedding, m.filters, m.bias, m.dense, m.offset + d, np.float64), b, y, weight)[0] for d in (1e-6, -1e-6))
    assert np.isclose((up - down) / 2e-6, g0, atol=1e-6)


def test_best_threshold():
    rng = np.random.default_rng(9)
    for _ in range(50):
        z, y = rng.normal(0, 1, 30).round(1), rng.integers(0, 2, 30)
        if not y.any():
            continue
        f1 = lambda t: 2 * ((z > t) & (y == 1)).sum() / max((z > t).sum() + y.sum(), 1)
        assert np.isclose(f1(T.best_threshold(z, y)), max(f1(t) for t in [*z, z.min() - 1]))


def test_rake_meets_marginals():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, n, 60) for n in (4, 3, 2)]
    goals = [np.full(n, 1 / n) for n in (4, 3, 2)]
    w = B.rake(rng.uniform(1, 9, 60), keys, goals, rounds=500)
    for k, g in zip(keys, goals, strict=True):
        assert np.allclose(np.bincount(k, w), g, atol=1e-5)


def test_mixing_both_ways(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    targets = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
    # A quarter of all tokens: half of them would take more of one language than there is.
    a, b = (B.assign(docs, targets, share=0.25, driver_cells=n).select("doc_id", "lang", "__weight", "__tokens", "__p", "__drawn").orderBy("doc_id").toPandas() for n in (B.DRIVER_CELLS, 3))
    assert np.allclose(a["__weight"], b["__weight"], rtol=1e-3)
    share = (a["__weight"] * a["__tokens"]).groupby(a["lang"]).sum() / (a["__weight"] * a["__tokens"]).sum()
    assert np.allclose([share["en"], share["de"]], [0.4, 0.2], atol=1e-3)
    assert (a["__drawn"] <= (a["__p"] > 0)).all() and 0 < a["__drawn"].sum() < len(a)


def test_drawn_shares_meet_targets(spark):
    """Cells that would pass probability 1 give the rest to cells with room; a target out of reach is reported."""
    cells = [("a", "en", "x", 700), ("a", "de", "x", 60), ("b", "en", "x", 60), ("b", "de", "x", 180), ("b", "de", "y", 4)]
    rows = [(i, " ".join(["w"] * n), s, g, t) for i, (s, g, t, n) in enumerate(cells)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = {"source": {"a": 0.55, "b": 0.45}, "lang": {"en": 0.55, "de": 0.45}, "topic": {"x": 0.9, "y": 0.1}}
    for n in (B.DRIVER_CELLS, 3):
        out = B.assign(docs, targets, driver_cells=n)
        p = out.select("source", "lang", "__topic", "__tokens", "__p").toPandas()
        drawn = p["__p"] * p["__tokens"]
        assert p["__p"].between(0, 1).all() and np.isclose(drawn.sum(), 502, rtol=1e-4)
        share = {(r["attribute"], r["value"]): (r["target"], r["expected"]) for r in B.report(out, targets).collect()}
        for d, v in (("source", "a"), ("source", "b"), ("lang", "en"), ("lang", "de")):
            assert np.isclose(share[d, v][1], targets[d][v], atol=1e-4) and np.isclose(drawn[p[d] == v].sum() / 502, targets[d][v], atol=1e-4)
        assert np.isclose(share["topic", "y"][0], 0.1) and np.isclose(share["topic", "y"][1], 4 / 502, atol=1e-4)


def test_weights_and_draws_against_plain(spark):
    """Raking, probabilities and draws by dictionaries, on cells without caps."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["a", "b", None]), rng.choice(["en", "de"]), rng.choice("xyz")) for i in range(400)]
    targets = {"lang": {"en": 0.5, "de": 0.5}, "source": {"a": 0.4}}
    got = {r["doc_id"]: r for r in B.assign(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string"), targets).collect()}
    cells = {}
    for _, t, *at in rows:
        cells[tuple(at)] = cells.get(tuple(at), 0) + len(t.split())
    total = sum(cells.values())
    share = [{}, {}, {}]
    for at, n in cells.items():
        for d in range(3):
            share[d][at[d]] = share[d].get(at[d], 0) + n / total
    rest = sum(v for k, v in share[0].items() if k != "a")
    tempered = {k: v**0.7 for k, v in share[2].items()}
    goals = [{k: 0.4 if k == "a" else 0.6 * v / rest for k, v in share[0].items()}, targets["lang"], {k: v / sum(tempered.values()) for k, v in tempered.items()}]
    w = {at: n / total for at, n in cells.items()}
    for _ in range(500):
        for d in range(3):
            now = {}
            for at, x in w.items():
                now[at[d]] = now.get(at[d], 0) + x
            w = {at: x * goals[d][at[d]] / now[at[d]] for at, x in w.items()}
    for i, t, *at in rows:
        want = w[tuple(at)] * total / cells[tuple(at)]
        assert np.isclose(got[i]["__weight"], want, rtol=1e-6) and np.isclose(got[i]["__p"], want / 2, rtol=1e-6)
    picked = B._assigned(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string"), targets, B.SHARE, B.TEMPER, B.DRIVER_CELLS, ["doc_id"])[0].collect()
    assert all(r["drawn"] == (r["chance"] < r["p"]) for r in picked) and all(0 <= r["chance"] < 1 for r in picked)
    assert abs(np.mean([r["chance"] for r in picked]) - 0.5) < 0.1


def test_topics_follow_words(spark):
    """Texts of unlike word lists fall into unlike clusters, every text into one; wordless texts into none."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"{'abcd'[i % 4]}{rng.randrange(30)}" for _ in range(60))) for i in range(200)] + [(900, " ,, "), (901, None)]
    got = {r["doc_id"]: r["__topic"] for r in B.assign(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source", "'en' as lang")).collect()}
    groups = [{got[i] for i in range(200) if i % 4 == k} for k in range(4)]
    assert got[900] == got[901] == "en:none" and all(not a & b for i, a in enumerate(groups) for b in groups[:i])


def test_mixing_odd_rows(odd, odd_rows, none):
    got = B.assign(odd).collect()
    assert len(got) == len(odd_rows)
    assert not any(r["__drawn"] for r in got if not (r["text"] or "").strip())
    assert B.mix(odd).columns == odd.columns
    assert B.assign(none).count() == 0


def blurred(n):
    """Texts of words from eight lists that run into each other, in two languages."""
    rng = random.Random(8)
    return [(i, " ".join(f"w{(rng.randrange(8) if rng.random() < 0.3 else i % 8) * 12 + rng.randrange(18)}" for _ in range(rng.randrange(6, 30))), "s", "xx" if i % 5 else "yy") for i in range(n)]


BLURRED = "doc_id long, text string, source string, lang string"


def off_by(rows, got):
    """By plain arrays over all texts: how much nearer each text lies to another topic's mean than to its own."""
    out = []
    for lang in sorted({r[3] for r in rows}):
        mine = [(i, t.split()) for i, t, _, g in rows if g == lang]
        bucket = {w: int(B._words(pa.array([w]))[0][0]) for _, t in mine for w in t}
        tf = np.zeros((len(mine), B.BUCKETS))
        for k, (_, t) in enumerate(mine):
            for w in t:
                tf[k, bucket[w]] += 1
        x = np.log1p(tf) * np.log((len(tf) + 1) / ((tf > 0).sum(0) + 1))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        own = np.array([int(got[i].split(":")[1]) for i, _ in mine])
        means = np.stack([x[own == k].sum(0) for k in range(B.TOPICS)])
        near = x @ (means / np.linalg.norm(means, axis=1, keepdims=True)).T
        out.append(near.max(1) - near[np.arange(len(x)), own])
    return np.concatenate(out)


@pytest.mark.parametrize("few", [0, 100_000])
def test_topics_come_from_all_texts(spark, monkeypatch, few):
    """Word weights and centroids over every text: each lies nearest to the mean of its own topic."""
    monkeypatch.setattr(B, "FEW", few, raising=False)
    monkeypatch.setattr(B, "MOVED", 0.0, raising=False)
    monkeypatch.setattr(B, "TOPIC_ROUNDS", 200, raising=False)
    rows = blurred(6000)
    got = {r["doc_id"]: r["__topic"] for r in B.assign(spark.createDataFrame(rows, BLURRED).repartition(5)).collect()}
    assert (off_by(rows, got) < 1e-3).all()


def test_topics_in_passes_and_lots_equal_one_task(spark, monkeypatch):
    rows = blurred(400) + [(9000 + i, f"only {i} of its language", "s", f"l{i % 7}") for i in range(40)] + [(9900, " ,", "s", "l1"), (9901, None, "s", "zz"), (9902, "null's language", "s", None)]
    want = None
    for few, lot, order in ((0, 64, 1), (0, 2, 2), (100_000, 64, 3), (50, 1, 4)):
        monkeypatch.setattr(B, "FEW", few)
        monkeypatch.setattr(B, "LOT", lot)
        mixed = random.Random(order).sample(rows, len(rows))
        got = {r["doc_id"]: r["__topic"] for r in B.assign(spark.createDataFrame(mixed, BLURRED).repartition(order)).collect()}
        assert len(got) == len(rows) and (want is None or got == want)
        want = got
    assert want[9900] == "l1:none" and want[9901] == "zz:none" and want[9902].startswith("none:")
