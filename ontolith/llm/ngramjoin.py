"""N-gram Jaccard join by chosen paths.

Each text becomes its set of five-word shingles (lower-cased A-Z words of letters, digits
and bytes over 127; a shorter text is one shingle). Texts with the same set form one class
and only a representative goes on. In each run a set picks its least tokens under a hash
that depends on the path so far, and sets that share a path share a bucket. Sets of a bucket
are compared by 128-bin minima, a lot of BUCKET at a time, by leaders: near copies of a leader
lead nothing, and lots of a large bucket meet by their leaders alone, GROUP at a time, as long
as that halves them. A bucket of more leaders than that is split: its sets, and no others, pick
tokens of their minima under the path, down to DEPTH. Edges found are a forest in each lot, not
all pairs; what is still large at DEPTH (thousands of sets that share eight sampled tokens, all
unlike enough to lead and too alike to part) is compared lots against lots.

Components of the edges are candidate clusters; there whole shingle sets are compared exactly.
A cluster of up to BLOCK sets and BLOCK_TOKENS shingles is one group. A larger one is dealt into
blocks by size, as sets whose sizes differ by more than the threshold can't be linked, and blocks
of neighbouring sizes meet in pairs. A block travels as differences to its first set, so a block
of near copies is a few bytes a set, however often it is sent; inside, members common with
the first set are compared as bit masks.

Runs repeat until the chance to find a pair of exactly the threshold reaches RECALL.

Defined cases: null, empty and wordless texts have an empty set, no links and a class of
their own; null ids are kept (their class has the least id that isn't null, if any);
repeated rows are copies; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .util import RID, components, cut, release, with_rid

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
BUCKET = 256
GROUP = 2048
DEPTH = 8
FAN = 2
BINS = 128
BLOCK = 2048
BLOCK_TOKENS = 1 << 20
#: Sketches this alike join a leader's candidates; its own followers need SURE.
NEAR, SURE = 0.42, 0.87
BLOOM_WORDS = 1 << 20


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair of exactly the threshold is missed with less than 1 - recall.

    With the two least tokens a node, both are shared with about threshold ** 2 and none with
    about 3/4 of (1 - threshold) ** 2; a pair is lost where no path to DEPTH is shared.
    """
    both, none = threshold**2, 0.75 * (1 - threshold) ** 2
    miss = 0.0
    for _ in range(DEPTH):
        miss = none + (1 - both - none) * miss + both * miss**2
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def shingle_sets(column: pa.Array, k: int = SHINGLE):
    """Yields (first row, sorted shingle hashes of each text) slice by slice."""
    for a, b in X.slices(column):
        t = X.flat(column.slice(a, b - a))
        w = X.split(t, X.ALNUM, lower=True)
        h = X.word_hashes(t, w, lower=True)
        s, bounds = X.windows(h, w.first, k)
        sets = []
        for i in range(len(t)):
            part = s[bounds[i] : bounds[i + 1]]
            n = w.first[i + 1] - w.first[i]
            if not len(part) and n:
                own = h[w.first[i] : w.first[i + 1]]
                part = X.mix(np.array([sum(int(x) * (2 * j + 1) for j, x in enumerate(own)) % 2**64], np.uint64) + X.seeded(int(n)))
            sets.append(np.unique(part))
        yield a, sets


def set_key(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    return b"".join(int(X.mix(s + X.seeded(90 + j)).sum(dtype=np.uint64)).to_bytes(8, "big") for j in (0, 1)) if len(s) else b""


def sketch(s: np.ndarray) -> np.ndarray:
    """Least member of each of BINS bins, 16 bits; 0 where a bin is empty."""
    out = np.zeros(BINS, np.uint16)
    h = np.sort(X.mix(s + X.seeded(7)))
    bins = (h >> X.U(57)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = bins[1:] != bins[:-1]
    out[bins[first]] = ((h[first] >> X.U(20)) & X.U(0xFFFF)).astype(np.uint16) | np.uint16(1)
    return out


def chosen(s: np.ndarray, paths: np.ndarray, fan: int = FAN) -> np.ndarray:
    """The next paths: for each path, the least tokens of a set under a hash of both."""
    h = X.mix((s if len(s) >= fan else np.resize(s, fan))[None, :] ^ paths[:, None])
    if h.shape[1] > fan:
        h = np.partition(h, fan - 1, axis=1)[:, :fan]
    return np.sort(h, axis=1).ravel()


def chosen_paths(s: np.ndarray, runs: int, depth: int = DEPTH, fan: int = FAN) -> list[np.ndarray]:
    """For each level, the paths of a set over all runs (runs * fan ** level of them, child i of i // fan)."""
    out = [np.array([int(X.seeded(1000 + r)) for r in range(runs)], np.uint64)]
    for _ in range(depth):
        out.append(chosen(s, out[-1], fan))
    return out[1:]


def sampled(row: np.ndarray) -> np.ndarray:
    """The tokens that a sketch holds, as (bin, value)."""
    full = np.flatnonzero(row)
    return X.mix((full.astype(np.uint64) << X.U(16)) | row[full].astype(np.uint64))


def _signatures(runs: int):
    names = ["rid", "doc_id", "th", "sk", "n", "paths", "sketch"]

    def run(batches):
        for b in batches:
            text = b.column(3)
            for a, sets in shingle_sets(text):
                sub = b.slice(a, len(sets))
                seen, sk, n, paths, sketches = {}, [], [], [], []
                for s in sets:
                    key = set_key(s)
                    if key not in seen:
                        seen[key] = (np.unique(chosen_paths(s, runs, 1)[0]).view(np.int64), sketch(s).tobytes()) if len(s) else ([], b"")
                    sk.append(key), n.append(len(s)), paths.append(seen[key][0]), sketches.append(seen[key][1])
                yield pa.RecordBatch.from_arrays([sub.column(0), sub.column(1), sub.column(2), pa.array(sk, pa.binary()), pa.array(n, pa.int64()), pa.array(paths, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=names)

    return run, "rid string, doc_id long, th long, sk binary, n long, paths array<long>, sketch binary"


def alike(m: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of one sketch with many."""
    full = (m != 0) | (one != 0)
    return ((m == one) & full).sum(1) / np.maximum(full.sum(1), 1)


def leaders(m: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges that connect all rows that may be near each other, a forest, never all pairs; and the rows that lead.

    A row at least SURE alike to a leader follows it and leads nothing. Whatever is near a
    follower is then alike to the leader by NEAR, by the triangle inequality; so are the leaders
    of two rows near each other.
    """
    live, edges, lead, parent = np.arange(len(m)), [], [], list(range(len(m)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    while len(live):
        top, rest = int(live[0]), live[1:]
        lead.append(top)
        a = alike(m[rest], m[top])
        for x in rest[a >= NEAR].tolist():
            i, j = root(top), root(x)
            if i != j:
                parent[max(i, j)] = min(i, j)
                edges.append((top, x))
        live = rest[a < SURE]
    return edges, lead


def _lots(batches):
    """Rows are lots (path, more, sks, sketches): edges (a, b), and where more lots have the path its leaders (a, path)."""
    for batch in batches:
        ea, eb, path = [], [], []
        for p, more, sks, sketches in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            edges, lead = leaders(np.frombuffer(b"".join(sketches), np.uint16).reshape(len(sks), BINS))
            for i, j in edges:
                ea.append(sks[i]), eb.append(sks[j]), path.append(None)
            for i in lead if more else ():
                ea.append(sks[i]), eb.append(None), path.append(p)
        yield pa.RecordBatch.from_arrays([pa.array(ea, pa.binary()), pa.array(eb, pa.binary()), pa.array(path, pa.int64())], names=["a", "b", "path"])


def _children(batches):
    """Next paths of rows (sk, path, sketch)."""
    for b in batches:
        sk, path = [], []
        for s, p, row in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            below = np.unique(chosen(sampled(np.frombuffer(row, np.uint16)), np.array([p], np.int64).view(np.uint64)))
            sk += [s] * len(below)
            path += below.view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(sk, pa.binary()), pa.array(path, pa.int64())], names=["sk", "path"])


def _compared(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) and leaders (a, path) of the lots of rows (path, lot, more, sk); only these rows' sketches are moved."""
    full = rows.select("path", "lot", "more", "sk").join(reps.select("sk", "sketch"), "sk")
    groups = full.groupBy("path", "lot").agg(F.first("more").alias("more"), F.sort_array(F.collect_list(F.struct("sk", "sketch"))).alias("g")).select("path", "more", F.col("g.sk").alias("s"), F.col("g.sketch").alias("k"))
    return cut(groups.mapInArrow(_lots, "a binary, b binary, path long"))


def _clusters(reps: DataFrame) -> DataFrame:
    """(node, label): components of candidate edges between class representatives."""
    edges, rows = [], cut(reps.select("sk", F.explode("paths").alias("path")))
    for _ in range(DEPTH):
        # Lots of all sets, then of leaders, until a bucket is one lot or its leaders don't get fewer.
        opened, active, lot = None, rows, BUCKET
        while True:
            sizes = cut(active.groupBy("path").agg(F.count("*").alias("m")).where("m > 1").withColumn("lots", F.ceil(F.col("m") / lot)))
            out = _compared(active.join(sizes, "path").select("path", F.pmod(F.xxhash64("sk", "path"), F.col("lots")).alias("lot"), (F.col("lots") > 1).alias("more"), "sk"), reps)
            edges.append(out.where("b is not null").select("a", "b"))
            lead = out.where("b is null").select(F.col("a").alias("sk"), "path")
            if not lead.limit(1).count():
                break
            stuck = lead.groupBy("path").agg(F.count("*").alias("k")).join(sizes, "path").where((F.col("k") > GROUP) & (2 * F.col("k") > F.col("m"))).select("path", "m")
            stuck = cut(stuck)
            opened = stuck if opened is None else opened.unionByName(stuck)
            active, lot = cut(lead.join(stuck, "path", "left_anti")), GROUP
        if opened is None or not opened.limit(1).count():
            break
        inside = cut(rows.join(opened.select("path"), "path", "left_semi"))
        release(rows)
        rows = cut(inside.join(reps.select("sk", "sketch"), "sk").select("sk", "path", "sketch").mapInArrow(_children, "sk binary, path long"))
    else:
        rows = inside.join(inside.groupBy("path").agg(F.ceil(F.count("*") / F.lit(GROUP)).alias("lots")), "path")
        own = F.pmod(F.xxhash64("sk", "path"), F.col("lots"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1), lambda j: F.least(j, own) * F.col("lots") + F.greatest(j, own))
        edges.append(_compared(rows.select("path", F.explode(pairs).alias("lot"), F.lit(False).alias("more"), "sk"), reps).select("a", "b"))
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return components(out)


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bits of the ids, at most BLOOM_WORDS 64-bit words however many ids there are."""
    h = ids.select(F.explode(F.array(*(F.pmod(F.xxhash64("th", F.lit(s)), F.lit(BLOOM_WORDS * 64)) for s in (1, 2)))).alias("h"))
    words = h.select(F.expr("h div 64").alias("w"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(BLOOM_WORDS, np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out


def _sets(bloom):
    """Shingle sets of texts that may be in a cluster; most repeats in a task go at once."""

    def run(batches):
        bits, done = bloom.value, set()
        for b in batches:
            yes = np.ones(b.num_rows, bool)
            for c in (1, 2):
                h = b.column(c).to_numpy()
                yes &= (bits[h // 64] >> (h % 64)) & 1 == 1
            column = b.column(0).filter(pa.array(yes))
            for _, sets in shingle_sets(column):
                sk, blob = [], []
                for s in sets:
                    key = set_key(s)
                    if key and key not in done:
                        if len(done) >= 1 << 16:
                            done.clear()
                        done.add(key)
                        sk.append(key), blob.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sk, pa.binary()), pa.array(blob, pa.binary())], names=["sk", "members"])

    return run


def exact_links(sets: list[np.ndarray], weight: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float):
    """Exact links between rows `left` and `right` of sets: (weight linked to each row, a spanning forest of the links).

    Members are told apart by the first set: its own are compared as bit masks, all others by
    posting lists, so near copies cost a few machine words a pair. left and right are equal or disjoint.
    """
    n, size = len(sets), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    pivot = sets[0]
    inside = X.member(flat, pivot)
    masks = np.zeros((n, -(-len(pivot) // 64) * 64), bool)
    masks[owner[inside], np.searchsorted(pivot, flat[inside])] = True
    masks = np.packbits(masks, axis=1).view(np.uint64)
    order = np.argsort(flat[~inside], kind="stable")
    tokens, holders = flat[~inside][order], owner[~inside][order]
    rank = np.full(n, -1)
    rank[right] = np.arange(len(right))
    same = np.array_equal(left, right)
    total, parent, forest = np.zeros(n, np.int64), list(range(n)), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    right_masks, right_size = masks[right], size[right]
    for i in left:
        common = np.bitwise_count(right_masks & masks[i]).sum(1).astype(np.int64)
        mine = sets[i][~X.member(sets[i], pivot)]
        low, high = np.searchsorted(tokens, mine), np.searchsorted(tokens, mine, "right")
        if (count := int((high - low).sum())):
            take = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange(count)
            where = rank[holders[take]]
            common += np.bincount(where[where >= 0], minlength=len(right))
        hit = right[common >= threshold * (right_size + size[i] - common) - 1e-9]
        hit = hit[hit != i]
        total[i] += int(weight[hit].sum())
        if not same:
            total[hit] += weight[i]
        for j in hit:
            a, b = root(int(i)), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((int(i), int(j)))
    return total, forest


def pack_block(rows: list[tuple[bytes, int, np.ndarray]]) -> bytes:
    """Sets (key, copies, members) as differences to the first of them."""
    pivot, masks, extra = rows[0][2], [], []
    for _, _, s in rows:
        masks.append(np.packbits(X.member(pivot, s)))
        extra.append(s[~X.member(s, pivot)])
    head = np.array([len(rows), len(pivot)], np.int64).tobytes()
    blob = b"".join([head, b"".join(k for k, _, _ in rows), np.array([c for _, c, _ in rows], np.int64).tobytes(), np.array([len(x) for x in extra], np.int64).tobytes(), pivot.tobytes(), *(m.tobytes() for m in masks), *(x.tobytes() for x in extra)])
    return len(blob).to_bytes(8, "little") + pa.compress(blob, "zstd", asbytes=True)


def unpack_block(data: bytes) -> list[tuple[bytes, int, np.ndarray]]:
    blob = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n, p = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    at = 16 + 16 * n
    copies, more = np.frombuffer(blob, np.int64, n, at), np.frombuffer(blob, np.int64, n, at + 8 * n)
    at += 16 * n
    pivot, wide = np.frombuffer(blob, np.uint64, p, at), -(-p // 8)
    at += 8 * p
    rest, out = at + n * wide, []
    for i in range(n):
        mask = np.unpackbits(np.frombuffer(blob, np.uint8, wide, at + i * wide), count=p).astype(bool)
        extra = np.frombuffer(blob, np.uint64, int(more[i]), rest)
        rest += 8 * int(more[i])
        out.append((blob[16 + 16 * i : 32 + 16 * i], int(copies[i]), np.sort(np.concatenate([pivot[mask], extra]))))
    return out


_CHECKED = "sk binary, links long, label binary, other binary, cluster binary, block long, data binary"


def _checked(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [()] * 7, kinds, strict=True)], names=[x.split()[0] for x in _CHECKED.split(", ")])


def _blocks(threshold):
    """Rows are blocks (cluster, block, whole, list of (sk, copies, members)).

    A cluster that is one block gives each set's links and its component's least set; a block of
    a larger one is packed.
    """

    def run(batches):
        for batch in batches:
            for cluster, block, whole, rows in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                rows = [(r["sk"], r["copies"], np.frombuffer(r["members"], np.uint64)) for r in rows]
                if not whole:
                    yield _checked([(None, None, None, None, cluster, block, pack_block(rows))])
                    continue
                everyone = np.arange(len(rows))
                total, forest = exact_links([s for _, _, s in rows], np.array([c for _, c, _ in rows], np.int64), everyone, everyone, threshold)
                top = list(range(len(rows)))

                def root(x, top=top):
                    while top[x] != x:
                        x = top[x]
                    return x

                for a, b in forest:
                    a, b = root(a), root(b)
                    top[max(a, b)] = min(a, b)
                yield _checked([(r[0], int(n), rows[root(k)][0], None, None, None, None) for k, (r, n) in enumerate(zip(rows, total, strict=True))])

    return run


def _pairs(threshold):
    """Rows are pairs of packed blocks (list of (block, data)); one block alone is compared with itself."""

    def run(batches):
        for batch in batches:
            for i, j, packed in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                sides = {x["block"]: unpack_block(x["data"]) for x in packed}
                if i not in sides or j not in sides:
                    continue
                left = sides[i]
                rows = left if i == j else left + sides[j]
                at = np.arange(len(rows))
                total, forest = exact_links([s for _, _, s in rows], np.array([c for _, c, _ in rows], np.int64), at[: len(left)], at if i == j else at[len(left) :], threshold)
                yield _checked([(r[0], int(n), None, None, None, None, None) for r, n in zip(rows, total, strict=True)] + [(rows[a][0], 0, None, rows[b][0], None, None, None) for a, b in forest])

    return run


def _exact(placed: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Links of placed sets (sk, label, copies, n) as rows _CHECKED: (sk, links, least set) or (sk, links, null) and a forest (sk, other)."""
    grade = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1 / threshold))))
    sizes = placed.groupBy("label", grade.alias("grade")).agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    subs = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("t") / BLOCK_TOKENS))
    sizes = sizes.groupBy("label").agg(((F.sum("m") <= BLOCK) & (F.sum("t") <= BLOCK_TOKENS)).alias("whole"), F.map_from_entries(F.collect_list(F.struct("grade", subs.alias("subs")))).alias("subs"))
    sizes = cut(sizes)
    name = lambda g, b: g * F.lit(1 << 32) + b
    block = F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(name(F.col("grade"), F.pmod(F.xxhash64("sk"), F.try_element_at("subs", F.col("grade")))))
    dealt = placed.withColumn("grade", grade).join(sizes, "label").withColumn("block", block).join(members, "sk")
    first = cut(dealt.groupBy("label", "block").agg(F.first("whole").alias("whole"), F.sort_array(F.collect_list(F.struct("sk", "copies", "members"))).alias("rows")).select("label", "block", "whole", "rows").mapInArrow(_blocks(threshold), _CHECKED))
    packed = first.where("data is not null").select(F.col("cluster").alias("label"), "block", "data")
    out = first.where("data is null")
    if not packed.limit(1).count():
        return out
    packed = packed.join(sizes.where("not whole"), "label").withColumn("grade", F.shiftright("block", 32))

    def with_grade(step, pair):
        n = F.coalesce(F.try_element_at("subs", F.col("grade") + step), F.lit(0).cast("long"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda b: pair(name(F.col("grade") + step, b)))).otherwise(F.array().cast("array<struct<i:long,j:long>>"))

    ends = lambda other: F.struct(F.least(other, F.col("block")).alias("i"), F.greatest(other, F.col("block")).alias("j"))
    met = packed.select("label", "block", "data", F.explode(F.concat(*(with_grade(step, ends) for step in (-1, 0, 1)))).alias("p"))
    met = met.groupBy("label", "p.i", "p.j").agg(F.collect_list(F.struct("block", "data")).alias("packed")).select("i", "j", "packed")
    return out.unionByName(cut(met.mapInArrow(_pairs(threshold), _CHECKED)))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text") -> DataFrame:
    """One row per document: doc_id, __rid, class_id (least doc_id of its component), rep_id
    (least doc_id with the same set), n_shingles, n_links (documents at or over the threshold)
    and keeps (true for one row of each component)."""
    spark = docs.sparkSession
    docs = (docs if RID in docs.columns else with_rid(docs)).select(RID, "doc_id", F.col(text).cast("string").alias("text"))
    base = docs.select(F.col(RID).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    run, schema = _signatures(runs_for(recall, threshold))
    signed = cut(base.mapInArrow(run, schema))
    own = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")
    # Rows that may stand for a set; max_by keeps one a set before the shuffle.
    reps = signed.where("n > 0").groupBy("sk").agg(F.min("th").alias("th"), F.count("*").alias("copies"), F.min(own).alias("least"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    reps = cut(reps)
    placed = cut(_clusters(reps).join(reps.select(F.col("sk").alias("node"), "th", "copies", "n"), "node").select(F.col("node").alias("sk"), "label", "th", "copies", "n"))
    bloom = spark.sparkContext.broadcast(_bloom(placed))
    hashed = docs.select("text", *(F.pmod(F.xxhash64(F.xxhash64("text"), F.lit(s)), F.lit(BLOOM_WORDS * 64)).alias(f"h{s}") for s in (1, 2))).where("length(text) > 0")
    members = hashed.mapInArrow(_sets(bloom), "sk binary, members binary").groupBy("sk").agg(F.first("members").alias("members"))
    checked = _exact(placed.select("sk", "label", "copies", "n"), members, threshold)
    linked = checked.where("label is not null").select(F.col("sk").alias("node"), "label")
    across = checked.where("other is not null").select(F.col("sk").alias("a"), F.col("other").alias("b"))
    if across.limit(1).count():
        linked = linked.unionByName(components(across))
    counts = checked.where("other is null").groupBy("sk").agg(F.sum("links").alias("links"))
    classes = reps.join(linked.withColumnRenamed("node", "sk"), "sk", "left").select("sk", "copies", "least", F.coalesce("label", "sk").alias("label"))
    heads = classes.groupBy("label").agg(F.min("least").alias("head"))
    known = cut(classes.join(heads, "label").join(counts, "sk", "left").select("sk", F.col("least.doc_id").alias("rep_id"), F.col("head.doc_id").alias("class_id"), F.col("head.rid").alias("head"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = signed.select("rid", "doc_id", "sk", "n").join(known, "sk", "left")
    alone = F.col("head").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id"), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("head") == F.col("rid"))).alias("keeps"), F.col("rid").alias(RID)
    )


def thin(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents, less all but one of each component."""
    known = with_rid(docs)
    gone = join(known, threshold, recall).where("not keeps").select(RID)
    return known.join(gone, RID, "left_anti").drop(RID)
