"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells of (source, lang, topic) by their tokens (words between white
space). Cell weights are raked until their sums over each attribute meet the target marginals,
no cell being given more than all of its tokens: what passes that goes to the cells with room.
A document is then drawn with probability SHARE * weight per token of its cell, at most 1,
decided by a hash of its id and text, so a rerun draws the same rows.

A value whose target passes all its tokens is drawn whole and the others of its attribute share
the rest by their targets; if the values with a target have fewer tokens than SHARE asks for,
less is drawn. Where targets of several attributes can't be met together, given ones go before present ones. report() shows target and expected share by value. Rounds go on until all marginals
are met within TOLERANCE or nothing moves any more; what is then missed is warned of.

Targets are shares by attribute value; values that aren't named share what is left by their present
shares. An attribute without targets aims at its present shares to the power TEMPER, which lifts
rare values. Only values with tokens take part.

Topics are clusters inside a language: TOPICS of them for each value of lang, of hashed TF-IDF word vectors
(spherical k-means), unless the input has a topic column. Word weights, first centroids and every round of
the clusters are taken over all texts: each is packed once as its words' counts by bucket, a round sums the
texts nearest to each centroid. First centroids are texts drawn by their distance to those before them and a hash.
Vectors and centroids are whole numbers, so no sum hangs on the order of rows. Rounds end when no centroid moves
by more than MOVED, or after TOPIC_ROUNDS with a warning. Languages of up to FEW texts are clustered in one task each, in the same
steps; of the others LOT share a pass. A text without words has topic `none`. As such a topic lies in one language, its
target is the language's times its tempered share inside it, so both can be met.

Texts are read once: packed words, tokens and the draw's chance are written beside the
columns that are kept. Cells are summed up before they meet anywhere. Up to DRIVER_CELLS of them are
raked on the driver; beyond that the same steps run as DataFrame aggregations, with the marginals
(one row a value) joined. Both ways end at the same marginals within the tolerance.

Defined cases: null attributes are a value of their own; null and empty texts have no tokens
and are never drawn; null ids are drawn by the text's hash alone; repeated rows are drawn
alike; an empty table gives an empty result; other columns pass through, whatever their names, but
that assign() replaces __topic, __tokens, __weight, __p and __drawn.
"""

from __future__ import annotations

import warnings
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .util import cut, numbered, release

TEMPER = 0.7
ROUNDS = 2000
TOLERANCE = 1e-9
#: Of the fit by aggregations, where a round is dear.
FAR_TOLERANCE = 1e-6
#: So many rounds that leave more than this share of the least miss end the fit: not all targets can be met.
STALLED, PATIENCE = 0.9999, 20
DRIVER_CELLS = 100_000
#: Share of all tokens to draw.
SHARE = 0.5
DIMS = ("source", "lang", "topic")
TOPICS = 6
TOPIC_ROUNDS = 25
#: Squared way of a unit centroid in a round that ends its language's rounds.
MOVED = 1e-4
#: Texts of a language that one task takes whole; larger languages that share a pass.
FEW, LOT = 512, 64
BUCKETS = 4096
#: What a weight of 1 is in a text's vector and in a centroid; sums of their products stay below 2 ** 53.
UNIT, FINE = 1 << 15, 1 << 20
SEED = 20240607


def _words(column: pa.Array):
    """Bucket of each word, and each text's bounds."""
    t = X.flat(column)
    w = X.split(t, X.ALNUM, lower=True)
    return (X.word_hashes(t, w, lower=True) >> X.U(52)).astype(np.int64), w.first


def _pairs(column: pa.Array, kind):
    """Packed pairs of all rows, and each row's bounds."""
    t = X.flat(column)
    size = 2 * np.dtype(kind).itemsize
    return np.frombuffer(t.data, kind).reshape(-1, 2), t.offsets // size


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 where it has none."""
    if not len(values):
        return np.zeros(len(first) - 1, values.dtype)
    return np.where(np.diff(first) > 0, np.add.reduceat(values, np.minimum(first[:-1], len(values) - 1)), 0)


def _numbers(langs: pa.Array, known: dict) -> np.ndarray:
    """Each row's language as numbered; -1 where it isn't."""
    coded = pc.dictionary_encode(langs, null_encoding="encode")
    return np.array([known.get(x, -1) for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


def _weights(pairs: np.ndarray, first: np.ndarray, lang: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of TF-IDF as whole numbers, entry by entry."""
    of = np.repeat(np.maximum(lang, 0), np.diff(first))
    x = np.log1p(pairs[:, 1].astype(np.float64)) * idf.ravel()[of * BUCKETS + pairs[:, 0]]
    norm = np.sqrt(_sums(x * x, first))
    return np.rint(x / np.repeat(np.maximum(norm, 1e-12), np.diff(first)) * UNIT)


def _near(bucket: np.ndarray, x: np.ndarray, first: np.ndarray, lang: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(rows, clusters): products with the centroids (cluster, language, bucket) of the row's language."""
    at = np.repeat(lang, np.diff(first)) * BUCKETS + bucket
    return np.stack([_sums(c.ravel()[at] * x, first) for c in centroids], axis=1)


_PART = "lang string, cluster int, n long, sums binary, least double, row binary"


def _part(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=[x.split()[0] for x in _PART.split(", ")])


def _added(part: pa.Table) -> pa.Table:
    """Parts of one language and cluster as one: sums, and the row of the least value."""
    rows = part.to_pylist()
    sums = np.zeros(BUCKETS, np.int64)
    for r in rows:
        if r["sums"]:
            sums += np.frombuffer(r["sums"], np.int64)
    least = min(((r["least"], r["row"]) for r in rows if r["row"] is not None), default=(None, None))
    return pa.Table.from_batches([_part([(rows[0]["lang"], rows[0]["cluster"], sum(r["n"] for r in rows), sums.tobytes(), *least)])])


def _holders(shared):
    """Texts, and texts with a word of each bucket, by language, of rows (lang, words)."""

    def run(batches):
        n, sums = {}, {}
        for b in batches:
            langs = pc.unique(b.column(0)).to_pylist()
            lang = _numbers(b.column(0), {x: i for i, x in enumerate(langs)})
            pairs, first = _pairs(b.column(1), np.uint32)
            held = np.bincount(np.repeat(lang, np.diff(first)) * BUCKETS + pairs[:, 0], minlength=len(langs) * BUCKETS).reshape(-1, BUCKETS)
            for i, x in enumerate(langs):
                n[x], sums[x] = n.get(x, 0) + int((lang == i).sum()), sums.get(x, 0) + held[i]
        yield _part([(x, 0, n[x], sums[x].astype(np.int64).tobytes(), None, None) for x in n])

    return run


def _vectors(shared):
    """Rows (lang, words) as (lang, row): pairs of bucket and weight."""

    def run(batches):
        number, idf = shared.value
        for b in batches:
            for s, e in X.slices(b.column(1)):
                pairs, first = _pairs(b.column(1).slice(s, e - s), np.uint32)
                x = _weights(pairs, first, _numbers(b.column(0).slice(s, e - s), number), idf)
                data = np.stack([pairs[:, 0], x], axis=1).astype(np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array([data[4 * i : 4 * j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], names=["lang", "row"])

    return run


def _open(b: pa.RecordBatch, number: dict):
    """Slices of the rows (lang, row) of numbered languages: (rows, bucket, weight, bounds, language)."""
    lang = _numbers(b.column(0), number)
    column, lang = b.column(1).filter(pa.array(lang >= 0)), lang[lang >= 0]
    for s, e in X.slices(column):
        part = column.slice(s, e - s)
        pairs, first = _pairs(part, np.uint16)
        yield part, pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.float64), first, lang[s:e]


def _lowest(least: dict, value: np.ndarray, rows: pa.Array, lang: np.ndarray) -> None:
    """Keeps each language's row of the least value; rows of equal values go by their bytes."""
    low = np.full(int(lang.max()) + 1, np.inf)
    np.minimum.at(low, lang, value)
    for i in np.flatnonzero(value <= low[lang]).tolist():
        least[lang[i]] = min(least.get(lang[i], (np.inf, b"")), (float(value[i]), rows[i].as_py()))


def _drawn(shared):
    """By language the row that wins a race with odds by its distance to the centroids so far."""

    def run(batches):
        number, centroids, seed = shared.value
        names, least = list(number), {}
        for b in batches:
            for rows, bucket, x, first, lang in _open(b, number):
                # The same for a text wherever it lies.
                h = X.mix(_sums(X.mix((bucket.astype(np.uint64) << X.U(16)) + x.astype(np.uint64) + X.seeded(seed)), first).astype(np.uint64))
                far = np.ones(len(lang))
                if len(centroids):
                    far = np.maximum(1 - _near(bucket, x, first, lang, centroids).max(1) / (UNIT * FINE), 1e-9)
                _lowest(least, -np.log(((h >> X.U(11)).astype(np.float64) + 0.5) / (1 << 53)) / far, rows, lang)
        yield _part([(names[i], 0, 0, None, *found) for i, found in least.items()])

    return run


def _walked(shared):
    """By language and cluster the rows nearest to its centroid and their sums, and the row that is worst off."""

    def run(batches):
        number, centroids, _ = shared.value
        names, least, k = list(number), {}, len(centroids)
        n, sums = np.zeros(len(names) * k, np.int64), np.zeros(len(names) * k * BUCKETS)
        for b in batches:
            for rows, bucket, x, first, lang in _open(b, number):
                near = _near(bucket, x, first, lang, centroids)
                _lowest(least, near.max(1), rows, lang)
                own = lang * k + near.argmax(1)
                n += np.bincount(own, minlength=len(n))
                # Whole numbers: exact in doubles.
                sums += np.bincount(np.repeat(own, np.diff(first)) * BUCKETS + bucket, x, len(sums))
        sums = sums.astype(np.int64).reshape(-1, k, BUCKETS)
        yield _part([(names[i], j, int(n[i * k + j]), sums[i, j].tobytes(), *found) for i, found in least.items() for j in range(k)])

    return run


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.float64)
    return np.rint(v / max(np.sqrt((v * v).sum()), 1e-12) * FINE)


def _dense(row: bytes) -> np.ndarray:
    out, pairs = np.zeros(BUCKETS), np.frombuffer(row, np.uint16).reshape(-1, 2)
    out[pairs[:, 0]] = pairs[:, 1]
    return out


def _clustered(scan, pack, topics: int):
    """Languages' numbers, word weights (language, bucket) and centroids (cluster, language, bucket).

    scan(pass, shared) gives the added parts over all rows, pack(shared) turns counts into vectors.
    """
    held = scan(_holders, None)
    number = {r["lang"]: i for i, r in enumerate(sorted(held, key=lambda r: (r["lang"] is None, r["lang"] or "")))}
    idf = np.zeros((len(number), BUCKETS))
    for r in held:
        idf[number[r["lang"]]] = np.log((r["n"] + 1) / (np.frombuffer(r["sums"], np.int64) + 1))
    pack((number, idf))
    centroids = np.zeros((0, len(number), BUCKETS))
    for seed in range(topics):
        more = np.zeros((1, len(number), BUCKETS))
        for r in scan(_drawn, (number, centroids, SEED + seed)):
            more[0, number[r["lang"]]] = _unit(_dense(r["row"]))
        centroids = np.concatenate([centroids, more])
    still = list(number)
    for _ in range(TOPIC_ROUNDS):
        at = [number[x] for x in still]
        new = centroids.copy()
        for r in scan(_walked, ({x: i for i, x in enumerate(still)}, centroids[:, at], None)):
            # A cluster left empty takes the row that is worst off.
            new[r["cluster"], number[r["lang"]]] = _unit(np.frombuffer(r["sums"], np.int64) if r["n"] else _dense(r["row"]))
        way = ((new - centroids) ** 2).sum(2).max(0) / FINE**2
        centroids, still = new, [x for x in still if way[number[x]] > MOVED]
        if not still:
            break
    else:
        warnings.warn(f"topics of {len(still)} languages still moved after {TOPIC_ROUNDS} rounds", stacklevel=2)
    return number, idf, centroids


def _told(model, langs: pa.Array, words: pa.Array) -> pa.Array:
    """The topic of each text."""
    number, idf, centroids = model
    out = []
    for s, e in X.slices(words):
        pairs, first = _pairs(words.slice(s, e - s), np.uint32)
        lang = _numbers(langs.slice(s, e - s), number)
        best = np.zeros(e - s, int)
        if number and len(pairs):
            best = _near(pairs[:, 0].astype(np.int64), _weights(pairs, first, lang, idf), first, np.maximum(lang, 0), centroids).argmax(1)
        out += [f"{x or 'none'}:{k}" if n else f"{x or 'none'}:none" for x, k, n in zip(langs.slice(s, e - s).to_pylist(), best.tolist(), np.diff(first).tolist(), strict=True)]
    return pa.array(out, pa.string())


def fit_topics(rows: DataFrame, topics: int = TOPICS):
    """Of all rows (lang, words): what _clustered() gives, by passes over the table."""
    spark, at = rows.sparkSession, {"rows": rows}

    def scan(step, value):
        shared = spark.sparkContext.broadcast(value)
        got = at["rows"].mapInArrow(step(shared), _PART).groupBy("lang", "cluster").applyInArrow(_added, _PART).toArrow().to_pylist()
        shared.unpersist()
        return got

    def pack(value):
        at["rows"] = cut(rows.mapInArrow(_vectors(spark.sparkContext.broadcast(value)), "lang string, row binary"))

    out = _clustered(scan, pack, topics)
    release(at["rows"])
    return out


def _alone(topics: int):
    """Rows of one language with their topic."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        at = {"rows": table.select(["lang", "words"]).to_batches()}

        def scan(step, value):
            parts = pa.Table.from_batches(list(step(SimpleNamespace(value=value))(at["rows"])))
            return [_added(parts.filter(pc.equal(parts["cluster"], c))).to_pylist()[0] for c in pc.unique(parts["cluster"]).to_pylist()]

        def pack(value):
            at["rows"] = list(_vectors(SimpleNamespace(value=value))(at["rows"]))

        model = _clustered(scan, pack, topics)
        told = pa.chunked_array([_told(model, b["lang"], b["words"]) for b in table.select(["lang", "words"]).to_batches()], pa.string())
        return table.drop_columns(["words"]).append_column("topic", told)

    return run


def _with_topics(known: DataFrame, topics: int = TOPICS) -> DataFrame:
    """known (.., lang, words) with topic for words."""
    spark = known.sparkSession
    worded = F.length("words") > 0
    sizes = cut(known.where(worded).groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n")))
    some, many = sizes.where(F.col("n") <= FEW).select("l"), sizes.where(F.col("n") > FEW).count()
    rest, parts = known, []
    if some.limit(1).count():
        few = F.coalesce("few", F.lit(False)) & worded
        split = known.join(some.withColumn("few", F.lit(True)), F.col("lang").eqNullSafe(F.col("l")), "left")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.drop("words").schema) + ", topic string"
        parts.append(cut(split.where(few).select(*known.columns).groupBy("lang").applyInArrow(_alone(topics), schema)))
        rest = split.where(~few).select(*known.columns)
    lots = max(1, -(-many // LOT))
    for lot in range(lots):
        mine = rest if lots == 1 else rest.where(F.pmod(F.xxhash64("lang"), F.lit(lots)) == lot)
        model = spark.sparkContext.broadcast(fit_topics(mine.where(worded).select("lang", "words"), topics) if many else ({}, None, None))

        def told(lang: pa.Array, words: pa.Array, model=model) -> pa.Array:
            return _told(model.value, lang, words)

        parts.append(mine.withColumn("topic", F.arrow_udf(lambda lang, words, told=told: told(lang, words), "string")("lang", "words")).drop("words"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _measured(at: int, keep: int, packed: bool):
    """Rows with tokens of the text in column `at`; the first `keep` columns stay, then its packed words or the given topic."""

    def run(batches):
        for b in batches:
            for s, e in X.slices(b.column(at)):
                sub = b.slice(s, e - s)
                tokens = np.diff(X.split(X.flat(sub.column(at)), X.NOT_SPACE).first)
                last = sub.column(b.num_columns - 1)
                if packed:
                    bucket, first = _words(sub.column(at))
                    # Each text's buckets in order, with their counts.
                    held, n = np.unique(np.repeat(np.arange(e - s), np.diff(first)) * BUCKETS + bucket, return_counts=True)
                    data = np.stack([held % BUCKETS, n], axis=1).astype(np.uint32).tobytes()
                    ends = np.searchsorted(held, np.arange(e - s + 1) * BUCKETS).tolist()
                    last = pa.array([data[8 * i : 8 * j] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*sub.columns[:keep], last, pa.array(tokens)], names=[*b.schema.names[:keep], "words" if packed else "topic", "tokens"])

    return run


def marginals(weights: np.ndarray, keys: np.ndarray, targets: dict | None, temper: float = TEMPER) -> np.ndarray:
    """Target share of each value of one attribute; values are numbered in keys."""
    now = np.bincount(keys, weights)
    return (now / now.sum()) ** temper / ((now / now.sum()) ** temper).sum() if targets is None else np.asarray(targets, float)


def named_shares(now: np.ndarray, given: list[float | None]) -> np.ndarray:
    """Given shares; values without one share what is left by their present shares."""
    goal = np.array([0.0 if g is None else float(g) for g in given])
    free = np.array([g is None for g in given]) * now
    rest = max(0.0, 1 - goal.sum())
    if free.sum() > 0:
        goal = goal + free / free.sum() * rest
    return goal / goal.sum() if goal.sum() > 0 else now / now.sum()


def reachable(goal: np.ndarray, room: np.ndarray, mass: float = 1.0) -> np.ndarray:
    """Goals of the given mass, none over its room: what passes it is shared by the others as they stand."""
    full = np.zeros(len(goal), bool)
    while True:
        free = goal[~full].sum()
        out = np.where(full, room, goal * ((mass - room[full].sum()) / free if free > 0 else 0.0))
        more = ~full & (goal > 0) & (out > room)
        if not more.any():
            return out
        full |= more


def rake(weights: np.ndarray, keys: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE, most: np.ndarray | None = None) -> np.ndarray:
    """Fits cell weights to the marginals, in turn, until all are met; no cell passes `most`."""
    most = np.full(len(weights), np.inf) if most is None else most
    w, before, worst, stalled = np.minimum(weights / weights.sum(), most), np.inf, 0.0, 0
    for _ in range(rounds):
        worst = 0.0
        for k, t in zip(keys, targets, strict=True):
            now = np.bincount(k, w, len(t))
            held = np.bincount(k, np.where(w >= most, w, 0.0), len(t))
            # Where more is asked for, cells with room alone can give it.
            up = (t > now) & (now > held)
            factor = np.divide(np.where(up, t - held, t), np.where(up, now - held, now), out=np.zeros(len(t)), where=now > 0)
            worst = max(worst, float(np.abs(now - t).max()))
            w = np.minimum(w * factor[k], most)
        if worst < tolerance:
            return w
        stalled = stalled + 1 if worst > STALLED * before else 0
        if stalled >= PATIENCE:
            break
        before = min(before, worst)
    warnings.warn(f"marginals missed by up to {worst:.2g}", stacklevel=2)
    return w


def _shares(cells: DataFrame, dim: str, targets: dict | None, temper: float) -> DataFrame:
    """(value, share) over the values with tokens."""
    now = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("tokens"))
    if targets is not None:
        spark = cells.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "value string, share double")
        now = now.join(given, now["value"].eqNullSafe(given["value"]), "left").select(now["value"], "tokens", "share")
        sums = now.agg(F.sum("share"), F.sum(F.when(F.col("share").isNull(), F.col("tokens")))).first()
        rest = max(0.0, 1 - (sums[0] or 0.0)) / sums[1] if sums[1] else 0.0
        now = now.select("value", F.coalesce("share", F.col("tokens") * F.lit(rest)).alias("share"))
    else:
        total = now.agg(F.sum("tokens")).first()[0]
        now = now.select("value", F.pow(F.col("tokens") / F.lit(float(total)), F.lit(temper)).alias("share"))
    whole = now.agg(F.sum("share")).first()[0]
    return now.select("value", (F.col("share") / F.lit(whole)).alias("share"))


def _inside(cells: DataFrame, topics: DataFrame, langs: DataFrame) -> DataFrame:
    """Topics' shares (value, share), those of one language scaled to that language's share."""
    of = cells.groupBy(F.col("topic").alias("value")).agg(F.first("lang").alias("lang"))
    named = topics.alias("t").join(of.alias("o"), F.col("t.value").eqNullSafe(F.col("o.value"))).select("t.value", "t.share", "o.lang")
    whole = named.groupBy("lang").agg(F.sum("share").alias("whole"))
    given = langs.select(F.col("value").alias("l"), F.col("share").alias("wanted"))
    scaled = named.alias("n").join(whole.alias("w"), F.col("n.lang").eqNullSafe(F.col("w.lang"))).join(given, F.col("n.lang").eqNullSafe(F.col("l")))
    return scaled.select(F.col("n.value").alias("value"), (F.col("n.share") / F.col("whole") * F.col("wanted")).alias("share"))


def _room(goals: DataFrame) -> DataFrame:
    """reachable() of (value, share, room) inside each grp (grp, mass)."""
    goals = goals.withColumn("full", F.lit(False))
    while True:
        sums = goals.groupBy(F.col("grp").alias("g")).agg(F.sum(F.when(F.col("full"), F.col("room")).otherwise(0.0)).alias("held"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("share"))).alias("free"))
        now = goals.join(sums, F.col("grp").eqNullSafe(F.col("g")))
        out = F.when(F.col("full"), F.col("room")).when(F.col("free") > 0, F.col("share") * (F.col("mass") - F.col("held")) / F.col("free")).otherwise(0.0)
        more = ~F.col("full") & (F.col("share") > 0) & (out > F.col("room"))
        now = cut(now.select("value", "share", "room", "grp", "mass", (F.col("full") | more).alias("full"), more.alias("more"), out.alias("goal")))
        if not now.where("more").limit(1).count():
            return now.select("value", F.col("goal").alias("share"), "grp")
        goals = now.drop("more", "goal")


def fit(cells: DataFrame, targets: dict[str, dict] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS, share: float = SHARE, nested: bool = False) -> DataFrame:
    """cells (source, lang, topic, tokens) with a raked weight; weights sum to 1, or to what can be drawn. nested: a topic lies in one language."""
    targets = targets or {}
    cells = cells.where("tokens > 0")
    # Given targets come last in a round: where not all can be met, these are.
    order = sorted(("lang", "source", "topic"), key=lambda d: d in targets)
    nested = nested and "topic" not in targets
    if cells.limit(driver_cells + 1).count() <= driver_cells:
        pdf = cells.toPandas()
        if not len(pdf):
            return cells.withColumn("weight", F.lit(0.0))
        pdf = pdf.sort_values(list(DIMS), na_position="last").reset_index(drop=True)
        keys, goals, tokens = [], [], pdf["tokens"].to_numpy(float)
        for d in order:
            names = pdf[d].map(lambda v: (v is None, v or ""))
            values = sorted(set(names))
            at = names.map({v: i for i, v in enumerate(values)}).to_numpy()
            goal = None
            if d in targets:
                goal = named_shares(np.bincount(at, tokens, len(values)), [targets[d].get(None if n else v) for n, v in values])
            goal = marginals(tokens, at, goal, temper)
            if d == "topic" and nested:
                lang = keys[order.index("lang")] if "lang" in order[: len(keys)] else pdf["lang"].map(lambda v: (v is None, v or "")).factorize(sort=True)[0]
                outer = np.zeros(len(goal), int)
                outer[at] = lang
                wanted = named_shares(np.bincount(lang, tokens), [targets["lang"].get(None if n else v) for n, v in sorted(set(pdf["lang"].map(lambda v: (v is None, v or ""))))]) if "lang" in targets else marginals(tokens, lang, None, temper)
                goal = goal / np.bincount(outer, goal)[outer] * wanted[outer]
            keys.append(at)
            goals.append(goal)
        most = tokens / (share * tokens.sum())
        rooms = [np.bincount(k, most, len(g)) for k, g in zip(keys, goals, strict=True)]
        mass = min(1.0, *(float(r[g > 0].sum()) for r, g in zip(rooms, goals, strict=True)))
        reached = [reachable(g, r, mass) for g, r in zip(goals, rooms, strict=True)]
        if nested:
            # What a topic can't take goes to the others of its language.
            k, t = order.index("lang"), order.index("topic")
            outer = np.zeros(len(goals[t]), int)
            outer[keys[t]] = keys[k]
            for x, m in enumerate(reached[k]):
                reached[t][outer == x] = reachable(goals[t][outer == x], rooms[t][outer == x], float(m))
        goals = reached
        rows = [(*(None if v is None else v for v in r), int(t), float(w)) for r, t, w in zip(pdf[list(DIMS)].itertuples(index=False, name=None), pdf["tokens"], rake(tokens, keys, goals, rounds, most=most), strict=True)]
        return cells.sparkSession.createDataFrame(rows, "source string, lang string, topic string, tokens long, weight double")
    total = cells.agg(F.sum("tokens")).first()[0]
    most = F.col("tokens") / F.lit(float(total) * share)
    w = cut(cells.withColumn("weight", F.least(F.col("tokens") / F.lit(float(total)), most)))
    goals = {}
    for d in DIMS:
        room = cells.groupBy(F.col(d).alias("v")).agg(F.sum(most).alias("room"))
        wanted = _shares(cells, d, targets.get(d), temper)
        if d == "topic" and nested:
            wanted = _inside(cells, wanted, _shares(cells, "lang", targets.get("lang"), temper))
        goals[d] = cut(room.join(wanted, F.col("v").eqNullSafe(F.col("value")), "left").select(F.col("v").alias("value"), F.coalesce("share", F.lit(0.0)).alias("share"), "room"))
    mass = min(1.0, *(goals[d].where("share > 0").agg(F.sum("room")).first()[0] or 0.0 for d in DIMS))
    whole = lambda d: goals[d].withColumn("grp", F.lit("")).withColumn("mass", F.lit(mass))
    reached = {d: cut(_room(whole(d))) for d in DIMS if d != "topic" or not nested}
    if nested:
        of = cells.groupBy(F.col("topic").alias("t")).agg(F.first("lang").alias("grp"))
        held = goals["topic"].join(of, F.col("value").eqNullSafe(F.col("t"))).select("value", "share", "room", "grp")
        mine = reached["lang"].select(F.col("value").alias("l"), F.col("share").alias("mass"))
        reached["topic"] = cut(_room(held.join(mine, F.col("grp").eqNullSafe(F.col("l"))).drop("l")))
    goals = {d: g.drop("grp") for d, g in reached.items()}
    worst, before, stalled = 0.0, np.inf, 0
    for _ in range(rounds):
        worst = 0.0
        for d in order:
            now = w.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("now"), F.sum(F.when(F.col("weight") >= most, F.col("weight")).otherwise(0.0)).alias("held"))
            up = (F.col("share") > F.col("now")) & (F.col("now") > F.col("held"))
            factor = F.when(up, (F.col("share") - F.col("held")) / (F.col("now") - F.col("held"))).when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(0.0)
            ratio = cut(now.join(goals[d].withColumnRenamed("value", "v"), F.col("value").eqNullSafe(F.col("v"))).select("value", factor.alias("factor"), F.abs(F.col("share") - F.col("now")).alias("off")))
            worst = max(worst, ratio.agg(F.max("off")).first()[0] or 0.0)
            w = cut(w.join(ratio, F.col(d).eqNullSafe(F.col("value"))).select(*DIMS, "tokens", F.least(F.col("weight") * F.col("factor"), most).alias("weight")))
        if worst < FAR_TOLERANCE:
            return w
        stalled = stalled + 1 if worst > STALLED * before else 0
        if stalled >= PATIENCE:
            break
        before = min(before, worst)
    warnings.warn(f"marginals missed by up to {worst:.2g}", stacklevel=2)
    return w


def _assigned(docs: DataFrame, targets, share, temper, driver_cells, keep):
    """Rows (in0, ..., source, lang, chance, topic, tokens, weight, p, drawn) and the numbered names of the columns kept."""
    plain, names = numbered(docs)
    kept = {c: n for c, n in names.items() if keep is None or c in keep}
    text = F.col(names["text"]).cast("string")
    of = lambda c: F.col(names[c]).cast("string") if c in names else F.lit(None).cast("string")
    chance = F.pmod(F.xxhash64(F.lit(SEED), of("doc_id"), F.md5(F.coalesce(text, F.lit("")))), F.lit(1 << 40)) / float(1 << 40)
    nested = "topic" not in names
    rows = plain.select(*kept.values(), of("source").alias("source"), of("lang").alias("lang"), chance.alias("chance"), text.alias("text"), of("topic").alias("topic"))
    n = len(kept) + 3
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:n])
    known = cut(rows.mapInArrow(_measured(n, n, nested), f"{fields}, {'words binary' if nested else 'topic string'}, tokens long"))
    if nested:
        known = _with_topics(known)
    cells = cut(known.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")))
    fitted = fit(cells, targets, temper, driver_cells=driver_cells, share=share, nested=nested)
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    ratio = fitted.select(*(F.col(d).alias(f"{d}_cell") for d in DIMS), (F.col("weight") * float(total) / F.col("tokens")).alias("ratio"))
    on = None
    for d in DIMS:
        same = F.col(d).eqNullSafe(F.col(f"{d}_cell"))
        on = same if on is None else on & same
    # Few cells are fewer than rows by far; a broadcast is only asked for within the bound counted above.
    small = F.broadcast(ratio) if fitted.limit(driver_cells + 1).count() <= driver_cells else ratio
    out = known.join(small, on, "left").withColumn("weight", F.when(F.col("tokens") > 0, F.coalesce("ratio", F.lit(0.0))).otherwise(0.0))
    out = out.withColumn("p", F.least(F.lit(1.0), F.col("weight") * float(share)))
    return out.withColumn("drawn", (F.col("tokens") > 0) & (F.col("chance") < F.col("p"))), kept


OWN = {"topic": "__topic", "tokens": "__tokens", "weight": "__weight", "p": "__p", "drawn": "__drawn"}


def assign(docs: DataFrame, targets: dict[str, dict] | None = None, share: float = SHARE, temper: float = TEMPER, driver_cells: int = DRIVER_CELLS, keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns `keep` of it) with __topic, __tokens, __weight (per token, mean 1), __p (probability) and __drawn."""
    out, kept = _assigned(docs, targets, share, temper, driver_cells, keep)
    return out.select(*(F.col(n).alias(c) for c, n in kept.items() if c not in OWN.values()), *(F.col(c).alias(n) for c, n in OWN.items()))


def report(assigned: DataFrame, targets: dict[str, dict] | None = None, temper: float = TEMPER, nested: bool = False) -> DataFrame:
    """attribute, value, target and expected share of the drawn tokens, of what assign() gave: apart where a target is out of reach."""
    named = assigned.where("__tokens > 0").select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), (F.col("__p") * F.col("__tokens")).alias("drawn"))
    cells = cut(named.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"), F.sum("drawn").alias("drawn")))
    whole = cells.agg(F.sum("drawn")).first()[0] or 1.0
    out = None
    for d in DIMS:
        got = cells.groupBy(F.col(d).alias("v")).agg((F.sum("drawn") / F.lit(float(whole))).alias("expected"))
        wanted = _shares(cells, d, (targets or {}).get(d), temper) if whole and not cells.isEmpty() else cells.select(F.col(d).alias("value"), F.lit(0.0).alias("share"))
        if d == "topic" and nested and d not in (targets or {}) and not cells.isEmpty():
            wanted = _inside(cells, wanted, _shares(cells, "lang", (targets or {}).get("lang"), temper))
        part = got.join(wanted, F.col("v").eqNullSafe(F.col("value")), "left").select(F.lit(d).alias("attribute"), F.col("v").alias("value"), F.coalesce("share", F.lit(0.0)).alias("target"), "expected")
        out = part if out is None else out.unionByName(part)
    return out


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, share: float = SHARE, temper: float = TEMPER) -> DataFrame:
    """The documents drawn, with their columns."""
    out, kept = _assigned(docs, targets, share, temper, DRIVER_CELLS, None)
    return out.where("drawn").select(*(F.col(n).alias(c) for c, n in kept.items()))
