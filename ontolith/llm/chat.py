"""Chat formatting of reply trees.

Messages form trees by (conv_id, msg_id, parent_id). Self-joins enumerate all root-to-leaf
paths: each round doubles how far a message sees up its tree, so rounds grow with the
logarithm of the depth, and pairs (leaf, ancestor) gathered on the way are the paths. Branches
of a conversation are ranked by their mean message score, then by length and leaf; the best
`keep` are formatted, one conversation each.

Template: <|im_start|>role newline text <|im_end|> newline, for each turn. In roles and texts a
backslash is doubled and <| becomes <\\|, so no control string can stand in them; in roles a
newline becomes \\n (backslash n). parse() reads turns back. The loss mask covers texts of
assistant turns.

Defined cases: null roles and texts are empty; rows with a null conv_id form a conversation
of that id; turns are ordered by turn (null first), then role and text, so repeated rows are
turns one after another; a parent that isn't there makes a root; messages on or below a cycle have
no root and are left out; of rows with one msg_id the least counts; of paths with equal score and
length the least leaf is first; very long texts are whole (a conversation is one row); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import cut, release

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(s: str, role: bool = False) -> str:
    s = s.replace("\\", "\\\\").replace("<|", "<\\|")
    return s.replace("\n", "\\n") if role else s


def unescape(s: str, role: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], s, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss spans."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, True)}\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for part in formatted.split(OPEN)[1:]:
        role, _, body = part.partition("\n")
        assert body.endswith(CLOSE)
        turns.append((unescape(role, True), unescape(body[: -len(CLOSE)])))
    return turns


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, msg_id, up): every leaf with itself and its ancestors, `up` steps above it; from rooted trees only.

    Messages on or below a cycle are found first, by jumps alone (one row a message and round) that
    haven't ended after as many steps as the largest conversation has messages.
    """
    same = F.col("m.conv_id").eqNullSafe(F.col("x.conv_id"))
    m = cut(messages.select("conv_id", "msg_id", "parent_id"))
    present = m.select("conv_id", "msg_id").alias("x")
    links = cut(m.alias("m").join(present, same & (F.col("m.parent_id") == F.col("x.msg_id")), "left").select("m.conv_id", "m.msg_id", F.col("x.msg_id").alias("anc")))
    most = m.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jumps, step = [cut(links.where("anc is not null"))], 1
    while step < most:
        jump = jumps[-1]
        far = cut(jump.alias("m").join(jump.alias("x"), same & (F.col("m.anc") == F.col("x.msg_id"))).select("m.conv_id", "m.msg_id", "x.anc"))
        jumps, step = [*jumps, far], step * 2
        if not far.limit(1).count():
            break
    # What still sees further after that many steps never ends.
    rooted = cut(links.alias("m").join(jumps[-1].alias("x"), same & (F.col("m.msg_id") == F.col("x.msg_id")), "left_anti"))
    inner = links.where("anc is not null").select("conv_id", F.col("anc").alias("msg_id")).distinct().alias("x")
    leaves = rooted.alias("m").join(inner, same & (F.col("m.msg_id") == F.col("x.msg_id")), "left_anti").select("m.conv_id", "m.msg_id")
    found = cut(leaves.select("conv_id", F.col("msg_id").alias("leaf"), "msg_id", F.lit(0).cast("long").alias("up")))
    for k, jump in enumerate(jumps):
        # Everyone known at distance u now also knows who is at u + 2 ** k.
        more = found.alias("m").join(jump.alias("x"), same & (F.col("m.msg_id") == F.col("x.msg_id"))).select("m.conv_id", "m.leaf", F.col("x.anc").alias("msg_id"), (F.col("m.up") + (1 << k)).alias("up"))
        grown = cut(found.unionByName(more))
        release(found, jump)
        found = grown
    release(m, links, rooted)
    return found


def branches(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """messages (conv_id, msg_id, parent_id, role, text, score): one row per chosen path with its turns in order.

    Paths are ranked by their mean score, then length, then the least leaf; texts of others don't move.
    """
    one = F.min(F.struct("parent_id", "role", "text", "score")).alias("v")
    messages = cut(messages.groupBy("conv_id", "msg_id").agg(one).select("conv_id", "msg_id", "v.*"))
    same = F.col("m.conv_id").eqNullSafe(F.col("x.conv_id")) & (F.col("m.msg_id") == F.col("x.msg_id"))
    p = paths(messages)
    ranked = p.alias("x").join(messages.select("conv_id", "msg_id", "score").alias("m"), same).groupBy("x.conv_id", "x.leaf").agg(F.avg(F.coalesce(F.col("m.score"), F.lit(0.0))).alias("score"), F.count("*").alias("n"))
    order = F.struct((-F.col("score")).alias("s"), (-F.col("n")).alias("n"), "leaf", "score")
    if keep == 1:
        chosen = ranked.groupBy("conv_id").agg(F.min(order).alias("b")).select("conv_id", "b.leaf", "b.score", F.lit(1).alias("rank"))
    else:
        chosen = ranked.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy(order))).select("conv_id", "leaf", "score", "rank")
        chosen = chosen.where(F.col("rank") <= keep) if keep else chosen
    kept = p.alias("x").join(chosen.alias("c"), F.col("x.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("x.leaf") == F.col("c.leaf"))).select("x.conv_id", "x.leaf", "x.msg_id", "x.up", "c.score", "c.rank")
    turn = F.struct((-F.col("x.up")).alias("place"), F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("m.text", F.lit("")).alias("text"))
    return kept.alias("x").join(messages.alias("m"), same).groupBy("x.conv_id", "x.leaf", "x.rank").agg(F.first("x.score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))


def as_messages(turns: DataFrame) -> DataFrame:
    """Turn tables are chains: each turn replies to the one before it."""
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("msg_id", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _render(batches):
    for b in batches:
        texts, starts = [], []
        for turns in b.column(2).to_pylist():
            text, spans = render([(t["role"], t["text"]) for t in turns])
            texts.append(text), starts.append([{"start": a, "end": e} for a, e in spans])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(starts, kind)], names=["conv_id", "leaf", "formatted", "loss_spans"])


def format_chats(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """One row per chosen path: conv_id, leaf, formatted, loss_spans (code points)."""
    return branches(messages, keep).select("conv_id", "leaf", "turns").mapInArrow(_render, "conv_id long, leaf long, formatted string, loss_spans array<struct<start:long,end:long>>")


def _read_back(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for b in batches:
        rows = []
        for conv, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text itself says of its turns and loss mask."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
