"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A text is lower-cased (A-Z) and read as words between white space, each followed by a
space, then one end byte: the code length of that byte string is the score. Contexts of
ORDER bytes down to none form a trie of counts, gathered from every training text. A byte not
yet seen in a context escapes to the next shorter one (escape method D: half a count of each
byte seen goes to the escape), where bytes already seen in the longer context are excluded.
A shorter context counts each byte once for each longer context that saw it (update exclusion),
so the bytes seen in a context are also seen in its suffix and the excluded mass is one
number for each context; scoring is then a few array lookups for each byte.

No count is dropped at any size and no table of long grams meets on the driver or in one task.
Documents are packed into chunks of CHUNK_BYTES of text, one row each. A chunk names its distinct
grams of the longest order with their training counts, dealt into parts by the last SPLIT bytes
of their contexts and sent as one packed blob of sorted differences a part (never more rows than
grams and words). A part, about CHUNK_BYTES of text's worth of grams, so holds whole contexts of orders from
SPLIT on, adds up the counts of all chunks and sends each chunk its own grams back with their
probabilities. Sorted arrays are added to in place of a few keys at a time, so a task's largest array stands
there twice at most. Orders below SPLIT, by the byte alphabet 2^24 grams at most and far fewer in text,
are counted over the whole corpus and broadcast. A task holds one chunk, or one part. A part can't be smaller
than the commonest context of SPLIT bytes; a larger SPLIT deals finer for a larger broadcast.

The base is a unigram model over words with add-half smoothing. A chunk's distinct words go the same way
as its grams, in the same rows, parts being ranges of their numbers; counts in the corpus come back alone, in
the words' order, as a chunk finds that order again. No word is a row of its own, and a frequent one is sent once a chunk.

Words and grams are known by 64-bit numbers. Defined cases: null and empty texts are the end
token alone; null ids are training rows; repeated rows are each counted and scored; an empty
table gives an empty result; a corpus without training rows leaves a uniform byte model;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .util import cut, held_out, release

ORDER = 6
CHUNK = 1 << 21
CHUNK_BYTES = 1 << 24
SPLIT = 3
HELD = 1 << 21
END = np.uint8(0x0A)
_END_KEY = np.array([0x1B873593CC9E2D51], np.uint64)
_U8 = np.uint64(8)


def streams(t: X.Texts, w: X.Words, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal byte strings, each after `order` end bytes: (bytes, bounds with the padding, size of each)."""
    n_words = np.diff(w.first)
    size = w.end - w.start
    letters = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=letters[1:])
    length = letters[w.first[1:]] - letters[w.first[:-1]] + 1
    bounds = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length + order, out=bounds[1:])
    out = np.full(int(bounds[-1]), END, np.uint8)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    begin = bounds[doc] + order + letters[:-1] - letters[w.first[:-1]][doc]
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + inside] = X.LOWER[t.data[np.repeat(w.start, size) + inside]]
    out[begin + size] = 0x20
    return out, bounds, length


def grams(data: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """order + 1 bytes ending at each byte that isn't padding, the last byte lowest."""
    n = len(data)
    code = np.zeros(n - order, np.uint64)
    for j in range(order + 1):
        code <<= _U8
        code |= data[j : n - order + j]
    real = np.ones(n, bool)
    for j in range(order):
        real[bounds[:-1] + j] = False
    return code[real[order:]]


def _tally(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = np.sort(a)
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    at = np.flatnonzero(first)
    return a[at], np.diff(np.append(at, len(a)))


def _into(keys: np.ndarray, n: np.ndarray, more: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted tally with a smaller one added. Besides both, only one new array of the larger is held at a time."""
    at = np.searchsorted(keys, more)
    there = np.zeros(len(more), bool)
    inside = at < len(keys)
    there[inside] = keys[at[inside]] == more[inside]
    n[at[there]] += m[there].astype(n.dtype)
    if there.all():
        return keys, n
    return np.insert(keys, at[~there], more[~there]), np.insert(n, at[~there], m[~there])


class Tally:
    """Sorted distinct keys with their training counts; keys of held-out rows alone have 0. Adds CHUNK of them at a time."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.fresh, self.size = {True: [], False: []}, 0

    def add(self, keys: np.ndarray, train: bool) -> None:
        self.fresh[train].append(keys)
        self.size += len(keys)
        if self.size >= CHUNK:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        for train, parts in self.fresh.items():
            if parts:
                keys, n = _tally(np.concatenate(parts))
                parts.clear()
                self.keys, self.n = _into(self.keys, self.n, keys, n if train else np.zeros_like(n))
        self.size = 0
        return self.keys, self.n


class Trie:
    """Counts by order with what scoring needs of each gram and context."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        """orders[k]: sorted grams of k context bytes and a symbol, and their counts."""
        self.order = len(orders) - 1
        self.grams, self.value, self.contexts, self.first_escape, self.next_escape, self.next_total = [], [], [], [], [], []
        below = None
        for k, (g, n) in enumerate(orders):
            n = n.astype(np.float64)
            ctx = g >> _U8
            start = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(g) else np.zeros(0, int)
            total = np.add.reduceat(n, start) if len(g) else np.zeros(0)
            distinct = np.diff(np.append(start, len(g))).astype(float)
            contexts = ctx[start]
            if k:
                # The context one byte shorter, the mass there of symbols seen here.
                shorter = np.searchsorted(below["contexts"], contexts & np.uint64(256 ** (k - 1) - 1))
                at = np.searchsorted(below["grams"], g & np.uint64(256**k - 1))
                seen = np.add.reduceat(below["n"][at], start) if len(g) else np.zeros(0)
                rest, left = below["total"][shorter] - seen, below["distinct"][shorter] - distinct
            else:
                # Below order 0 all other bytes are alike.
                rest, left = np.zeros(len(start)), 256 - distinct
            room = 2 * rest
            with np.errstate(divide="ignore"):
                self.first_escape.append(np.log10(distinct / (2 * total)).astype(np.float32))
                # Escaping from this context's suffix after escaping from this one; certain if nothing is left there.
                self.next_escape.append(np.where(left > 0, np.log10(left / np.maximum(room, 1)), 0.0) if k else np.zeros(len(start)))
                self.next_total.append(np.log10(np.maximum(room if k else left, 1)))
                self.value.append((np.log10(2 * n - 1).astype(np.float32), np.repeat(np.log10(2 * total), distinct.astype(int)).astype(np.float32) if len(g) else np.zeros(0, np.float32)))
            self.grams.append(X.Table(g)), self.contexts.append(X.Table(contexts))
            below = {"grams": g, "n": n, "contexts": contexts, "total": total, "distinct": distinct}

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the others."""
        out = np.zeros(len(code))
        left, longer = np.arange(len(code)), np.full(len(code), -1)
        for k in range(self.order, -1, -1):
            g = code[left] & np.uint64(256 ** (k + 1) - 1) if k < 7 else code[left]
            row = self.grams[k].find(g)
            hit = np.flatnonzero(row >= 0)
            count, total = self.value[k]
            r, where, up = row[hit], left[hit], longer[hit]
            # The first context there is has its own total; later ones lack what was excluded.
            whole, later = total[r], up >= 0
            if k < self.order:
                whole[later] = self.next_total[k + 1][up[later]]
            out[where] += count[r] - whole
            miss = row < 0
            left, up, g = left[miss], longer[miss], g[miss]
            if not len(left):
                return out
            here = self.contexts[k].find(g >> _U8)
            there = here >= 0
            fresh, chained = there & (up < 0), there & (up >= 0)
            out[left[fresh]] += self.first_escape[k][here[fresh]]
            if k < self.order:
                out[left[chained]] += self.next_escape[k + 1][up[chained]]
            longer = np.where(there, here, up)
        seen = longer >= 0
        out[left[seen]] -= self.next_total[0][longer[seen]]
        out[left[~seen]] -= np.log10(256)
        return out


def lower_orders(keys: np.ndarray, n: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All orders from the longest: a shorter gram counts the longer ones that end in it."""
    out = [(keys, n)]
    for k in range(order - 1, -1, -1):
        keys = np.sort(keys & np.uint64(256 ** (k + 1) - 1))
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        n = np.diff(np.append(at, len(keys)))
        keys = keys[at]
        out.append((keys, n))
    return out[::-1]


def _collect(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.select("key", "n").toArrow()
    k, n = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
    o = np.argsort(k)
    return k[o], n[o]


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, after their size."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(blob: bytes, kind) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], size, "zstd", asbytes=True), np.uint8)
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(wide, size // wide).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


_ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())])


def _packed(batches):
    """Rows (part, doc_id, held_out, text) as chunks (chunk, size, rows), each an Arrow stream with row numbers."""
    row, held, size, first = 0, [], 0, None

    def chunk():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for x in held:
                w.write_batch(x)
        return pa.RecordBatch.from_arrays([pa.array([first]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "size", "rows"])

    for b in batches:
        for s, e in X.slices(b.column(3), 1 << 20):
            sub = b.slice(s, e - s)
            at = (sub.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[0] << 33) + row
            first = at if first is None else first
            # Taken row by row, so that a stream holds these rows' bytes alone.
            sub = sub.take(pa.array(np.arange(e - s)))
            held.append(pa.RecordBatch.from_arrays([pa.array(at + np.arange(e - s)), *sub.columns[1:]], schema=_ROWS))
            row, size = row + e - s, size + held[-1].nbytes
            if size >= CHUNK_BYTES:
                yield chunk()
                held, size, first = [], 0, None
    if held:
        yield chunk()


def _unpacked(blob, most: int):
    """A chunk's rows, some at a time."""
    for b in pa.ipc.open_stream(pa.py_buffer(blob)):
        for s, e in X.slices(b.column(3), most):
            yield b.slice(s, e - s)


def _tallies(blob, order: int):
    """Tallies of a chunk's grams, and of its words with the ends."""
    found, words = Tally(), Tally()
    for sub in _unpacked(blob, 1 << 20):
        out = sub.column(2)
        for train, rows in ((True, sub.filter(pc.invert(out))), (False, sub.filter(out))):
            if rows.num_rows:
                t = X.flat(rows.column(3))
                w = X.split(t, X.NOT_SPACE)
                data, bounds, _ = streams(t, w, order)
                found.add(grams(data, bounds, order), train)
                words.add(X.word_hashes(t, w, lower=True), train)
                words.add(np.repeat(_END_KEY, len(t)), train)
    return found.fold(), words.fold()


def _packed_parts(keys: np.ndarray, n: np.ndarray, ends: np.ndarray, order: np.ndarray | None = None):
    """Packed keys and counts of each part, up to its end; None where it has none."""
    for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
        i = slice(a, b) if order is None else order[a:b]
        yield (pack_sorted(keys[i]), pack(n[i])) if b > a else (None, None)


def _by_context(keys: np.ndarray, n: np.ndarray, split: int, parts: int):
    """Grams dealt by the last `split` bytes of their contexts."""
    part = np.empty(len(keys), np.int32)
    for a in range(0, len(keys), 1 << 18):
        part[a : a + (1 << 18)] = X.mix((keys[a : a + (1 << 18)] >> _U8) & np.uint64(256**split - 1)) % np.uint64(parts)
    return _packed_parts(keys, n, np.cumsum(np.bincount(part, minlength=parts)), np.argsort(part, kind="stable"))


def _by_range(keys: np.ndarray, n: np.ndarray, parts: int):
    """Words dealt by ranges of their numbers, so that parts in order hold them in order."""
    last = np.array([(i + 1) * 2**64 // parts - 1 for i in range(parts)], np.uint64)
    return _packed_parts(keys, n, np.searchsorted(keys, last, "right"))


_ASKED = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("uses", pa.binary())])


def _asked(order: int, split: int, parts: int):
    """Rows (part, chunk, keys, counts, words, uses) of chunks (chunk, rows); null where a chunk has none of a part."""

    def run(batches):
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found, words = _tallies(blob.as_buffer(), order)
                both = zip(_by_context(*found, split, parts), _by_range(*words, parts), strict=True)
                rows = [(i, chunk, *x, *y) for i, (x, y) in enumerate(both) if x[0] or y[0]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ASKED, strict=True)], schema=_ASKED)

    return run


def _short(order: int, split: int):
    """Distinct training grams of order split of chunks (rows), each once a slice."""

    def run(batches):
        for b in batches:
            for blob in b.column(0):
                held = np.zeros(0, np.uint64)
                for sub in _unpacked(blob.as_buffer(), 1 << 21):
                    rows = sub.filter(pc.invert(sub.column(2)))
                    if rows.num_rows:
                        t = X.flat(rows.column(3))
                        data, bounds, _ = streams(t, X.split(t, X.NOT_SPACE), order)
                        held = np.union1d(held, grams(data, bounds, order) & np.uint64(256 ** (split + 1) - 1))
                    if len(held) >= HELD:
                        yield from _rows_of(held)
                        held = held[:0]
                yield from _rows_of(held)

    return run


def _rows_of(keys: np.ndarray):
    for a in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)].view(np.int64))], names=["key"])


def _low_orders(chunks: DataFrame, order: int, split: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Orders below `split` of the whole corpus: a gram counts the distinct ones of order split that end in it."""
    if not split:
        return []
    longer = chunks.select("rows").mapInArrow(_short(order, split), "key long").distinct()
    return lower_orders(*_collect(longer.groupBy(F.col("key").bitwiseAND(F.lit(256**split - 1)).alias("key")).agg(F.count("*").alias("n"))), split - 1)


def _added(keys: pa.ChunkedArray, counts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The packed tallies of all chunks as one."""
    out, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    fresh, size = [], 0
    for i in range(len(keys) + 1):
        if i < len(keys) and keys[i].is_valid:
            fresh.append((unpack_sorted(keys[i].as_py()), unpack(counts[i].as_py(), np.uint32)))
            size += len(fresh[-1][0])
        if fresh and (i == len(keys) or size >= CHUNK):
            a, b = (np.concatenate(x) for x in zip(*fresh, strict=True))
            o = np.argsort(a, kind="stable")
            a, b = a[o], b[o].astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            out, n = _into(out, n, a[at], np.add.reduceat(b, at))
            fresh, size = [], 0
    return out, n


_KNOWN = "part long, chunk long, keys binary, p binary, uses binary, total long, v long"


def _solved(shared, order: int, split: int):
    """Of one part's rows the grams' probabilities and the words' counts; total and v: all its training words, and distinct ones."""

    def told(keys: pa.ChunkedArray, all_keys: np.ndarray, value: np.ndarray) -> pa.Array:
        return pa.array([pack(value[np.searchsorted(all_keys, unpack_sorted(k.as_py()))]) if k.is_valid else None for k in keys], pa.binary())

    def run(part: pa.Table) -> pa.Table:
        words, n = _added(part["words"], part["uses"])
        uses, total, v = told(part["words"], words, n), int(n.sum()), int((n > 0).sum())
        keys, n = _added(part["keys"], part["counts"])
        seen = n > 0
        trie = Trie(shared.value + lower_orders(keys[seen], n[seen], order)[split:])
        del n, seen
        p = np.concatenate([np.zeros(0, np.float32)] + [trie.score(keys[a : a + (1 << 18)]).astype(np.float32) for a in range(0, len(keys), 1 << 18)])
        del trie
        once = lambda x: pa.array([x] + [0] * (part.num_rows - 1), pa.int64())
        return pa.table([part["part"], part["chunk"], part["keys"], told(part["keys"], keys, p), uses, once(total), once(v)], names=[x.split()[0] for x in _KNOWN.split(", ")])

    return run


def _joined(column: pa.ChunkedArray, read, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind)] + [read(x.as_py()) for x in column if x.is_valid])


def _value(keys: np.ndarray, value: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of wanted keys, all of which are among the sorted keys."""
    # In order, so that a search stays where the one before it ended.
    distinct, at = np.unique(wanted, return_inverse=True)
    return value[np.searchsorted(keys, distinct)][at]


def _scored(order):
    """A chunk's rows with the probabilities of its grams and the counts of its words: n_known, logs (words' sum of log10(c + 0.5)), score."""

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("part")
        keys = _joined(own["keys"], unpack_sorted, np.uint64)
        o = np.argsort(keys)
        keys = keys[o]
        p = _joined(own["p"], lambda x: unpack(x, np.float32), np.float32)[o]
        del o
        held = []
        for blob in rows["rows"]:
            for sub in _unpacked(blob.as_buffer(), 1 << 19):
                t = X.flat(sub.column(3))
                w = X.split(t, X.NOT_SPACE)
                data, bounds, length = streams(t, w, order)
                code = _value(keys, p, grams(data, bounds, order)).astype(np.float64)
                held.append((sub.select([1, 2]), X.word_hashes(t, w, lower=True), np.diff(w.first), np.add.reduceat(code, np.cumsum(length) - length)))
        del keys, p
        words = np.unique(np.concatenate([_END_KEY, *(h for _, h, _, _ in held)]))
        uses = _joined(own["uses"], lambda x: unpack(x, np.int64), np.int64)
        ends = int(uses[np.searchsorted(words, _END_KEY[0])])
        out = []
        for sub, h, n, score in held:
            c, doc = _value(words, uses, h), np.repeat(np.arange(len(n)), n)
            logs = np.bincount(doc, np.log10(c + 0.5), len(n)) + np.log10(ends + 0.5)
            known = np.bincount(doc, c > 0, len(n)).astype(np.int64) + (ends > 0)
            out.append(pa.RecordBatch.from_arrays([*sub.columns, pa.array(n + 1), pa.array(known), pa.array(logs), pa.array(score)], schema=_SCORED))
        return pa.Table.from_batches(out, _SCORED)

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, order: int = ORDER, folds: int = 5, frequent: int | None = None) -> DataFrame:
    """One row per document; training rows are those that aren't held out (crc32 of the id modulo folds isn't 1).

    frequent is accepted for callers that give it; no words are broadcast, so it changes nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", folds).alias("held_out"), F.col("text").cast("string").alias("text"))
    split = min(SPLIT, order)
    # Written once, so chunks are the same in each later read.
    chunks = cut(rows.mapInArrow(_packed, "chunk long, size long, rows binary"))
    low = spark.sparkContext.broadcast(_low_orders(chunks, order, split))
    size = chunks.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // CHUNK_BYTES))
    asked = chunks.select("chunk", "rows").mapInArrow(_asked(order, split, parts), "part long, chunk long, keys binary, counts binary, words binary, uses binary")
    known = cut(asked.groupBy("part").applyInArrow(_solved(low, order, split), _KNOWN))
    whole = known.agg(F.sum("total").alias("n"), F.sum("v").alias("v")).first()
    total, distinct = int(whole["n"] or 0), int(whole["v"] or 0)
    below = np.log10(total + 0.5 * (distinct + 1))
    scored = chunks.select("chunk", "rows").groupBy("chunk").cogroup(known.drop("total", "v").groupBy("chunk")).applyInArrow(_scored(order), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    out = cut(scored)
    release(chunks, known)
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(below))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
