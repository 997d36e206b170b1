"""Benchmark decontamination with an FM-index per training shard.

Texts and items are lower-cased (A-Z) words of letters, digits and characters over 127. A
window is WINDOW consecutive item words, or a shorter item whole. Documents of a task are
gathered into shards of at most SHARD_WORDS words; each shard gets a suffix array by prefix
doubling, the Burrows-Wheeler text in a wavelet matrix, and every STEP-th text position as a
sample. Windows are searched backwards through wavelet ranks, all at once; the rows found
walk to a sampled position, and covered words are merged into spans.

Windows of the benchmark are a table (window, items that have it), made and reduced on the executors
and packed into blocks of about BLOCK_WINDOWS windows. Blocks pass the driver one at a time and are
broadcast as bytes; a task opens one, searches its shard for it and drops it, so it holds one shard
and one block of the benchmark, however many there are.

Defined cases: null, empty and wordless texts have no words and no hits; items without words
or without an id are no items; repeated items count once by their id; repeated rows each get
their own result; an empty benchmark contaminates nothing; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .util import cut, release

WINDOW = 8
SHARD_WORDS = 1_000_000
STEP = 8
BLOCK_WINDOWS = 1 << 20
CONTAMINATED = 2


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of the suffixes of seq, whose last value is its least and stands nowhere else. At most 2 ** 21 values."""
    n = len(seq)
    assert n <= 1 << 21
    at = np.uint64(21)
    low = np.uint64((1 << 21) - 1)
    counts = np.bincount(seq)
    begin = np.concatenate([[0], np.cumsum(counts)])
    rank = begin[seq].astype(np.uint64)
    todo = np.flatnonzero(counts[seq] > 1).astype(np.uint64)
    h = 1
    while len(todo):
        key = np.sort((rank[todo] << (at + at)) | (rank[todo + np.uint64(h)] << at) | todo)
        todo = key & low
        pair = key >> at
        old = pair >> at
        new_group = np.ones(len(key), bool)
        new_group[1:] = old[1:] != old[:-1]
        starts = np.flatnonzero(new_group)
        base = np.repeat(starts, np.diff(np.append(starts, len(key))))
        split = np.ones(len(key), bool)
        split[1:] = pair[1:] != pair[:-1]
        heads = np.flatnonzero(split)
        sizes = np.diff(np.append(heads, len(key)))
        head = np.repeat(heads, sizes)
        rank[todo] = old + (head - base).astype(np.uint64)
        todo = todo[np.repeat(sizes, sizes) > 1]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank.astype(np.int64)] = np.arange(n)
    return out


class Wavelet:
    """Wavelet matrix: how often a symbol stands before a position, and what stands there."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.n = len(seq)
        self.words, self.before, self.zeros = [], [], []
        seq = seq.astype(np.int32)
        for level in range(self.levels):
            bit = (seq >> (self.levels - 1 - level)) & 1 == 1
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, bool)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.words.append(words)
            self.before.append(before)
            self.zeros.append(self.n - int(before[-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][i >> 6] + np.bitwise_count(self.words[level][i >> 6] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        begin, end = np.zeros(len(i), np.int64), i.astype(np.int64)
        for level in range(self.levels):
            one = (symbol >> (self.levels - 1 - level)) & 1 == 1
            b, e = self._ones(level, begin), self._ones(level, end)
            begin = np.where(one, self.zeros[level] + b, begin - b)
            end = np.where(one, self.zeros[level] + e, end - e)
        return end - begin

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before."""
        symbol, at, begin = np.zeros(len(i), np.int64), i.astype(np.int64), np.zeros(len(i), np.int64)
        for level in range(self.levels):
            words = self.words[level]
            one = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            a, b = self._ones(level, at), self._ones(level, begin)
            at = np.where(one, self.zeros[level] + a, at - a)
            begin = np.where(one, self.zeros[level] + b, begin - b)
            symbol = symbol * 2 + one
        return symbol, at - begin


class FMIndex:
    """Over words given as hashes; texts are kept apart by a separator."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        codes, self.vocabulary = pd.factorize(hashes)
        texts = len(first) - 1
        n = len(hashes) + texts + 1
        seq = np.ones(n, np.int64)
        doc = np.repeat(np.arange(texts), np.diff(first))
        seq[np.arange(len(hashes)) + doc] = codes + 2
        seq[-1] = 0
        self.text_start = first[:-1] + np.arange(texts)
        sa = suffix_array(seq)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=len(self.vocabulary) + 2))])
        self.wavelet = Wavelet(seq[sa - 1], len(self.vocabulary) + 2)
        self.sampled = sa % STEP == 0
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]
        self.n = n

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix rows [low, high) of each pattern (symbols, right-aligned in each row)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        width = patterns.shape[1]
        for j in range(width - 1, -1, -1):
            live = np.flatnonzero((width - j <= sizes) & (low < high))
            if not len(live):
                continue
            c = patterns[live, j]
            low[live] = self.begin[c] + self.wavelet.rank(c, low[live])
            high[live] = self.begin[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps = np.zeros(len(rows), np.int64), 0
        left, at = np.arange(len(rows)), rows.copy()
        while len(left):
            hit = self.sampled[at]
            out[left[hit]] = self.samples[self.sample_at[at[hit]]] + steps
            left, at = left[~hit], at[~hit]
            if len(left):
                symbol, before = self.wavelet.access(at)
                at = self.begin[symbol] + before
                steps += 1
        return out

    def find(self, grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, text, word position in the text) of every occurrence of the hashed patterns."""
        code = pd.Index(self.vocabulary).get_indexer(grams.ravel()).reshape(grams.shape)
        used = np.arange(grams.shape[1])[None, :] >= grams.shape[1] - sizes[:, None]
        known = np.flatnonzero(((code >= 0) | ~used).all(1))
        low, high = self.search(code[known] + 2, sizes[known])
        n = high - low
        which = np.repeat(known, n)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        at = self.locate(rows)
        text = np.searchsorted(self.text_start, at, "right") - 1
        return which, text, at - self.text_start[text]


def _item_windows(window: int):
    """Rows (item_id, text) to each item's distinct windows (key, item_id); a key is the hashes of its words."""

    def run(batches):
        for b in batches:
            for s, e in X.slices(b.column(1)):
                t = X.flat(b.column(1).slice(s, e - s))
                w = X.split(t, X.ALNUM, lower=True)
                h = X.word_hashes(t, w, lower=True)
                names, keys, owners = b.column(0).slice(s, e - s).to_pylist(), [], []
                for i, name in enumerate(names):
                    own = h[w.first[i] : w.first[i + 1]]
                    found = {own[j : j + window].tobytes() for j in range(max(len(own) - window, 0) + 1)} if len(own) else ()
                    keys += found
                    owners += [name] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64())], names=["key", "item_id"])

    return run


def pack_windows(keys: list[bytes], owners: list[list[int]], window: int) -> bytes:
    """Windows in one blob: right-aligned hashes, sizes, and the items of each as a flat list with bounds."""
    sizes = np.array([len(k) // 8 for k in keys], np.int64)
    grams = np.zeros((len(keys), window), np.uint64)
    for r, k in enumerate(keys):
        grams[r, window - sizes[r] :] = np.frombuffer(k, np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in owners])]).astype(np.int64)
    blob = b"".join([np.array([len(keys), window, bounds[-1]], np.int64).tobytes(), grams.tobytes(), sizes.tobytes(), bounds.tobytes(), np.array([x for v in owners for x in v], np.int64).tobytes()])
    return len(blob).to_bytes(8, "little") + pa.compress(blob, "zstd", asbytes=True)


def unpack_windows(data: bytes):
    blob = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n, window, m = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    at = [24]

    def take(kind, count):
        out = np.frombuffer(blob, kind, count, at[0])
        at[0] += 8 * count
        return out

    grams, sizes, bounds = take(np.uint64, n * window).reshape(n, window), take(np.int64, n), take(np.int64, n + 1)
    return grams, sizes, take(np.int64, m), bounds


def _packed_windows(window: int):
    def run(part: pa.Table) -> pa.Table:
        return pa.table({"data": pa.array([pack_windows(part.column("key").to_pylist(), part.column("items").to_pylist(), window)], pa.binary())})

    return run


def _open(blocks: list):
    """The blocks one after another; of several, none stays in the worker."""
    for b in blocks:
        yield unpack_windows(b.value)
        if len(blocks) > 1:
            vars(b).pop("_value", None)


def _covered(hashes, first, blocks):
    """Which words are covered, which by windows of full size, and per text the ids of the items found."""
    texts = len(first) - 1
    items = [set() for _ in range(texts)]
    if not len(hashes) or not blocks:
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), bool), items
    index = FMIndex(hashes, first)
    cover, full = np.zeros(len(hashes) + 1, np.int64), np.zeros(len(hashes) + 1, np.int64)
    for grams, sizes, owners, bounds in _open(blocks):
        which, text, at = index.find(grams, sizes)
        start = first[text] + at
        end, whole = start + sizes[which], sizes[which] == grams.shape[1]
        cover += np.bincount(start, minlength=len(cover)) - np.bincount(end, minlength=len(cover))
        full += np.bincount(start[whole], minlength=len(full)) - np.bincount(end[whole], minlength=len(full))
        for x in np.unique(which.astype(np.int64) * texts + text):
            p, d = divmod(int(x), texts)
            items[d].update(owners[bounds[p] : bounds[p + 1]].tolist())
    return np.cumsum(cover)[:-1] > 0, np.cumsum(full)[:-1] > 0, items


def _scan(blocks, window, shard_words):
    """A function of a text column: for each text (covered words, those by full windows, item ids, byte bounds of words)."""

    def results(text):
        out, held, sizes, places = [], [], [], []

        def flush():
            first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            cover, full, items = _covered(np.concatenate(held) if held else np.zeros(0, np.uint64), first, blocks)
            out.extend((cover[first[i] : first[i + 1]], full[first[i] : first[i + 1]], items[i], places[i]) for i in range(len(sizes)))
            held.clear(), sizes.clear(), places.clear()

        for a, b in X.slices(text):
            t = X.flat(text.slice(a, b - a))
            w = X.split(t, X.ALNUM, lower=True)
            h = X.word_hashes(t, w, lower=True)
            for i in range(len(t)):
                part = slice(w.first[i], w.first[i + 1])
                own, place = h[part], (w.start[part] - t.offsets[i], w.end[part] - t.offsets[i])
                if len(own) + 2 > shard_words:
                    # A very long text goes in pieces whose overlap keeps every window whole.
                    flush()
                    mask, whole, found, step = np.zeros(len(own), bool), np.zeros(len(own), bool), set(), shard_words - 2 - window
                    for at in range(0, max(len(own) - window, 1), step):
                        piece = own[at : at + step + window]
                        cover, full, items = _covered(piece, np.array([0, len(piece)]), blocks)
                        mask[at : at + len(piece)] |= cover
                        whole[at : at + len(piece)] |= full
                        found |= items[0]
                    out.append((mask, whole, found, place))
                    continue
                if sum(sizes) + len(sizes) + len(own) + 2 > shard_words:
                    flush()
                held.append(own), sizes.append(len(own)), places.append(place)
        flush()
        return out

    return results


def spans_of(cover: np.ndarray) -> list[tuple[int, int]]:
    """Merged [start, end) ranges of covered words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def blocks_of(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WINDOWS):
    """Broadcasts of about so many distinct windows each; each window with all its items."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and length(text) > 0")
    found = cut(rows.mapInArrow(_item_windows(window), "key binary, item_id long").groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    parts = -(-found.count() // most)
    packed = cut(found.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(parts, 1)))).groupBy("block").applyInArrow(_packed_windows(window), "data binary"))
    out = [sc.broadcast(bytes(r["data"])) for r in packed.toLocalIterator()]
    release(found, packed)
    return out


def digest(names: set) -> str:
    return hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids and merged spans of covered words."""
    results = _scan(blocks_of(benchmark, window), window, shard_words)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = results(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(c) for c, _, _, _ in found], pa.int64()),
                    pa.array([int(c.sum()) for c, _, _, _ in found], pa.int64()),
                    pa.array([sorted(x) for _, _, x, _ in found], pa.list_(pa.int64())),
                    pa.array([[{"start": a, "end": b} for a, b in spans_of(c)] for c, _, _, _ in found], kind),
                ],
                names=["doc_id", "n_words", "n_hit", "item_ids", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_hit long, item_ids array<long>, spans array<struct<start:long,end:long>>")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, least: int = CONTAMINATED) -> DataFrame:
    """Documents without the contaminated ones (windows of `least` items or more).

    In the others, words covered by full windows go, from the first byte of a merged span to its
    last: eight words of an item in a row are no chance. Shorter items alone, which can be
    chance, change nothing. A text of which nothing is left goes too.
    """
    results = _scan(blocks_of(benchmark, window), window, shard_words)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = results(batch.column(at))
            texts, keep = batch.column(at).to_pylist(), []
            for i, (_, full, names, (start, end)) in enumerate(found):
                keep.append(len(names) < least and not (len(full) and full.all()))
                if keep[-1] and full.any():
                    raw, kept, last = texts[i].encode(), [], 0
                    for a, b in spans_of(full):
                        kept.append(raw[last : start[a]])
                        last = int(end[b - 1])
                    texts[i] = b"".join([*kept, raw[last:]]).decode()
            cols = list(batch.columns)
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
