"""Token counts that follow edits.

A document is cut into segments of about LEAF characters, at places where the tokenizer's
pre-tokens always break: before a single space between two characters that aren't white
space. So counts of segments add up to the count of the text. A segment tree over slots of
segments holds sums of characters and tokens. An edit finds its slots by descending the tree,
re-encodes only the segments it touches, with a neighbour where it touches the characters that
decide a boundary, and updates the sums above them. A slot that passes SLOT segments makes the
tree deal its segments out anew, whose counts are known. A text without such a place is one
segment, encoded whole.

build() stores the trees as a table, one row a document with its segments and their counts;
apply_edits() takes such a table and gives the next one, without encoding anything else again.

Defined cases: null and empty texts have no tokens; edits past the end are held to the text's
end; edits with null bounds or a null replacement count as empty ones at 0 (bounds) or ''
(replacement); repeated rows are each counted; an empty table gives an empty result; edits of
ids that aren't there do nothing; other columns are not read.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 1024
SLOT = 16

_SAFE = re.compile(r"(?<=\S) (?=\S)")


def load(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, leaf: int = LEAF) -> list[str]:
    """Segments of at least `leaf` characters, the last one whatever is left."""
    out, at = [], 0
    while at < len(text):
        m = _SAFE.search(text, at + leaf) if at + leaf < len(text) else None
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


class SegmentTree:
    """Slots of segments (text, tokens) under a heap of (characters, tokens) sums."""

    def __init__(self, text: str | None, count, leaf: int = LEAF, segments: list[tuple[str, int]] | None = None):
        """Of a text, or of segments whose counts are known."""
        self.count, self.leaf, self.encoded = count, leaf, 0
        self._deal([self._coded(s) for s in cuts(text or "", leaf)] if segments is None else segments)

    def _coded(self, s: str) -> tuple[str, int]:
        self.encoded += len(s)
        return s, self.count(s)

    def _deal(self, segments: list[tuple[str, int]]):
        self.slots = [[s] for s in segments] or [[]]
        self.size = 1 << (len(self.slots) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, slot in enumerate(self.slots):
            self._sum(i, slot)
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _sum(self, i: int, slot: list[tuple[str, int]]):
        self.slots[i] = slot
        self.chars[self.size + i] = sum(len(s) for s, _ in slot)
        self.tokens[self.size + i] = sum(n for _, n in slot)

    def _lift(self, i: int):
        k = (self.size + i) // 2
        while k:
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            k //= 2

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def segments(self) -> list[tuple[str, int]]:
        return [s for slot in self.slots for s in slot]

    def text(self) -> str:
        return "".join(s for s, _ in self.segments())

    def _find(self, at: int) -> tuple[int, int]:
        """Slot of a character, and the characters before that slot."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if at >= before + self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k - self.size, before

    def replace(self, start: int, end: int, new: str) -> None:
        """text[start:end] becomes new."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        a, before = self._find(start)
        b, before_b = self._find(max(end - 1, start))
        # A neighbouring slot comes along where a boundary's characters may be touched.
        if start <= before + 1:
            while a:
                a -= 1
                before -= self.chars[self.size + a]
                if self.chars[self.size + a] >= 2:
                    break
        if end >= before_b + self.chars[self.size + b] - 1:
            while b + 1 < len(self.slots):
                b += 1
                if self.chars[self.size + b] >= 2:
                    break
        held = [s for slot in self.slots[a : b + 1] for s in slot]
        # Segments whose two first characters, or the one after them, lie well outside the edit stay as they are.
        low, at = 0, before
        while low < len(held) - 1 and at + len(held[low][0]) + 2 <= start:
            at += len(held[low][0])
            low += 1
        high, stop = len(held), before + sum(len(s) for s, _ in held)
        while high > low + 1 and stop - len(held[high - 1][0]) >= end + 2:
            high -= 1
            stop -= len(held[high][0])
        old = "".join(s for s, _ in held[low:high])
        region = old[: start - at] + new + old[end - at :]
        merged = held[:low] + [self._coded(s) for s in cuts(region, self.leaf)] + held[high:]
        for i in range(a, b + 1):
            self._sum(i, merged if i == a else [])
            self._lift(i)
        if len(merged) > SLOT:
            self._deal(self.segments())


def script_edits(text: str) -> list[tuple[int, int, str]]:
    """The query's edits, from the text alone: take the first line out, mark the middle, add an end."""
    if not text:
        return [(0, 0, "new text")]
    line = text.find("\n") + 1
    middle = (len(text) - line) // 2
    return [(0, line, ""), (middle, middle + 5, " edited "), (len(text), len(text), "\nThe end.")]


_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("chars", pa.int64()), ("tokens", pa.int64())]))
_TREE = "doc_id long, segments array<struct<text:string,chars:long,tokens:long>>, reencoded long"


def _rows(ids, trees) -> pa.RecordBatch:
    segments = [[{"text": s, "chars": len(s), "tokens": n} for s, n in t.segments()] for t in trees]
    return pa.RecordBatch.from_arrays([ids, pa.array(segments, _SEGMENTS), pa.array([t.encoded for t in trees], pa.int64())], names=["doc_id", "segments", "reencoded"])


def _stored(row, count, leaf) -> SegmentTree:
    return SegmentTree(None, count, leaf, [(s["text"], s["tokens"]) for s in row or ()])


def _with_encoder(vocabulary, fn):
    """A function of batches and a counter of tokens, the encoder being made once a task."""

    def run(batches):
        enc = encoder(vocabulary.value)
        count = lambda s: len(enc.encode_ordinary(s))
        for b in batches:
            yield from fn(b, count)

    return run


def build(docs: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """The trees of all documents: (doc_id, segments, reencoded), segments being (text, chars, tokens) in order.

    The vocabulary file is read on the driver and sent along, so executors need no copy.
    """

    def run(b, count):
        for s, e in X.slices(b.column(1)):
            yield _rows(b.column(0).slice(s, e - s), [SegmentTree(t, count, leaf) for t in b.column(1).slice(s, e - s).to_pylist()])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_with_encoder(docs.sparkSession.sparkContext.broadcast(load(vocabulary)), run), _TREE)


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """The trees after edits (doc_id, seq, start, end, replacement), in order of seq, positions in code points of the text as it is then.

    Only what the edits touch is encoded (reencoded: its characters).
    """

    def run(b, count):
        out = []
        for row, es in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            t = _stored(row, count, leaf)
            for e in es or ():
                t.replace(e["start"], e["end"], e["replacement"])
            out.append(t)
        yield _rows(b.column(0), out)

    joined = trees.join(_in_order(edits), "doc_id", "left").select("doc_id", "segments", "edits")
    return joined.mapInArrow(_with_encoder(trees.sparkSession.sparkContext.broadcast(load(vocabulary)), run), _TREE)


def totals(trees: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_tokens, n_segments) of stored trees; no text is looked at."""
    add = lambda f: F.aggregate(F.transform("segments", lambda s: s[f]), F.lit(0).cast("long"), lambda x, y: x + y)
    return trees.select("doc_id", add("chars").alias("n_chars"), add("tokens").alias("n_tokens"), F.size("segments").cast("long").alias("n_segments"))


def _in_order(edits: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    return edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(zero("seq").alias("seq"), zero("start").alias("start"), zero("end").alias("end"), F.coalesce("replacement", F.lit("")).alias("replacement")))).alias("edits"))


_NAMES = ["n_chars_before", "n_tokens", "n_segments", "n_edits", "n_chars_after", "n_tokens_after", "chars_reencoded"]
_SCHEMA = "doc_id long, " + ", ".join(f"{n} long" for n in _NAMES)


def _edited(edits_of, leaf):
    """Counts of rows (doc_id, text, ...) before and after their edits, by one tree each."""

    def run(b, count):
        for s, e in X.slices(b.column(1)):
            rows = []
            for text, *more in zip(*(c.slice(s, e - s).to_pylist() for c in b.columns[1:]), strict=True):
                tree = SegmentTree(text, count, leaf)
                chars, first, tree.encoded = tree.length, tree.total, 0
                edits = edits_of(text or "", *more)
                for edit in edits:
                    tree.replace(*edit)
                rows.append((chars, first, len(tree.segments()), len(edits), tree.length, tree.total, tree.encoded))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), *(pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7))], names=["doc_id", *_NAMES])

    return run


def count(docs: DataFrame, edits: DataFrame | None = None, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """Token counts of every document before and after its edits (as for apply_edits()); None applies script_edits()."""
    held = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if edits is None:
        return rows.mapInArrow(_with_encoder(held, _edited(script_edits, leaf)), _SCHEMA)
    given = lambda text, es: [(e["start"], e["end"], e["replacement"]) for e in es or []]
    return rows.join(_in_order(edits), "doc_id", "left").select("doc_id", "text", "edits").mapInArrow(_with_encoder(held, _edited(given, leaf)), _SCHEMA)
