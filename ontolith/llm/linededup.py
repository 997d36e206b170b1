"""Line dedup over overlapping three-line windows.

Lines are the parts between \\n. Every three consecutive lines make a window; a text of fewer
lines is one window. A window is known by two hashes (md5) over all documents; all but its first
occurrence, by (doc_id, row, position), are covered, and covered lines go, overlapping
windows being merged. Windows without a word don't count.

Defined cases: null and empty texts have no windows and stay as they are; null ids come last
in the order; repeated rows are later occurrences of one another; an empty table gives an
empty result; other columns pass through, whatever their names, but that dedup() replaces
__lines and __gone. A passage that repeats without three equal lines in a row is another
operator's matter (README has figures).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import RID, cut, numbered, release, with_rid

WIDTH = 3


def occurrences(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, rid, pos, window) for each window with a word."""
    lines = docs.select("doc_id", RID, F.split("text", "\n", -1).alias("lines")).where("length(text) > 0")
    text = f"concat_ws('\n', slice(lines, i + 1, {width}))"
    one = F.expr(f"transform(sequence(0, greatest(size(lines) - {width}, 0)), i -> if({text} rlike '[^ \\\\t-\\\\r]', unhex(md5({text})), null))")
    return lines.select("doc_id", RID, F.posexplode(one).alias("pos", "window")).where("window is not null")


def later(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rid, starts): positions at which a later occurrence of a window begins."""
    found = cut(occurrences(docs, width))
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col(RID).alias("r"), F.col("pos").alias("p"))
    firsts = found.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("window", "first")
    # One row a window on this side; the other's hot windows are split by adaptive execution.
    again = found.join(firsts, "window").where(place != F.col("first"))
    return again.groupBy(RID).agg(F.collect_list("pos").alias("starts"))


def _apply(width: int):
    """Rows (lines there, lines gone, starts, ...) with `text` cut; positions say which column is which."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts, starts = b.column(at).to_pylist(), b.column(0).to_pylist()
            lines_in, gone_in, out = [], [], []
            for text, s in zip(texts, starts, strict=True):
                lines = text.split("\n") if text else []
                cover = np.zeros(len(lines), bool)
                for p in s or ():
                    cover[p : p + width] = True
                lines_in.append(len(lines))
                gone_in.append(int(cover.sum()))
                out.append("\n".join(x for x, c in zip(lines, cover, strict=True) if not c) if gone_in[-1] else text)
            cols = list(b.columns)
            cols[0], cols[at] = pa.array(lines_in, pa.int64()), pa.array(out, b.column(at).type)
            yield pa.RecordBatch.from_arrays([cols[0], pa.array(gone_in, pa.int64()), *cols[1:]], names=["lines", "gone", *b.schema.names[1:]])

    return run


def _cut_lines(docs: DataFrame, width: int) -> tuple[DataFrame, dict[str, str]]:
    """Rows (lines, gone, text, in0, ...) and the numbered names; the text's own number is `text`."""
    plain, names = numbered(docs)
    names["text"], own = "text", names["text"]
    number = names.get("doc_id")
    known = with_rid(plain.withColumnRenamed(own, "text"))
    keyed = known.select((F.col(number) if number else F.lit(None).cast("long")).alias("doc_id"), RID, "text")
    joined = known.join(later(keyed, width), RID, "left").select("starts", *names.values())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "starts")
    return joined.mapInArrow(_apply(width), f"lines long, gone long, {fields}"), names


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with deduplicated text, plus __lines and __gone (lines before, lines removed)."""
    out, names = _cut_lines(docs, width)
    return out.select(*(F.col(n).alias(c) for c, n in names.items() if c not in ("__lines", "__gone")), F.col("lines").alias("__lines"), F.col("gone").alias("__gone"))


def tidy(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with deduplicated text, without those of which no word is left."""
    out, names = _cut_lines(docs, width)
    return out.where((F.col("gone") == 0) | F.col("text").rlike(r"[^ \t-\r]")).select(*(F.col(n).alias(c) for c, n in names.items()))
