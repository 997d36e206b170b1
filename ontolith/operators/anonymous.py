"""Anonymous individuals: components of blanks, canonical graphs, stable labels.

Statements are rows (s, p, o); terms that start with _: are blank. Components come from the edges
between blanks by DataFrame rounds. A component is small (what statements about a few blanks hold
together), so its graph is canonicalised in one Arrow group: colours are refined by their neighbours'
until they settle, and blanks that still look alike are told apart by trying each, least result
first, within MAX_WORK refinements; beyond that the component keeps its refined colours and
is marked inexact.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.graph import connected_components

MAX_WORK = 4096


def _is_blank(c: str):
    return F.col(c).startswith("_:")


def partition(statements: DataFrame) -> DataFrame:
    """(node, component): blanks that statements hold together, each with the least blank of its component."""
    linked = statements.where(_is_blank("s") & _is_blank("o")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    blanks = statements.select(F.col("s").alias("node")).unionByName(statements.select(F.col("o").alias("node"))).where("node like '\\\\_:%'").distinct()
    return blanks.join(connected_components(linked), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _digest(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def refine(colour: dict[str, str], statements: list[tuple[str, str, str]]) -> dict[str, str]:
    """Colours after each blank has taken in its neighbourhood, until no class splits any more."""
    while True:
        seen: dict[str, list[str]] = {b: [] for b in colour}
        for s, p, o in statements:
            if s in colour:
                seen[s].append(_digest(">", p, colour.get(o, o)))
            if o in colour:
                seen[o].append(_digest("<", p, colour.get(s, s)))
        new = {b: _digest(colour[b], *sorted(seen[b])) for b in colour}
        if len(set(new.values())) == len(set(colour.values())):
            return new
        colour = new


def canonical_graph(statements: list[tuple[str, str, str]], most: int = MAX_WORK) -> tuple[str, dict[str, int], bool]:
    """(digest of the least form, place of each blank in it, whether that is exact)."""
    blanks = {t for s, _, o in statements for t in (s, o) if t.startswith("_:")}
    work, best = [0], [None, None]

    def written(order: dict[str, int]) -> str:
        name = lambda t: f"_:{order[t]}" if t in order else t
        return "\n".join(sorted(f"{name(s)} {p} {name(o)}" for s, p, o in statements))

    def search(colour):
        classes: dict[str, list[str]] = {}
        for b, c in colour.items():
            classes.setdefault(c, []).append(b)
        tied = sorted((len(m), c) for c, m in classes.items() if len(m) > 1)
        if not tied:
            order = {b: i for i, b in enumerate(sorted(colour, key=colour.get))}
            text = written(order)
            if best[0] is None or text < best[0]:
                best[:] = [text, order]
            return
        for b in sorted(classes[tied[0][1]]):
            if work[0] >= most and best[0] is not None:
                return
            work[0] += 1
            search(refine(colour | {b: _digest(colour[b], "chosen")}, statements))

    first = refine({b: "blank" for b in blanks}, statements)
    # Blanks that hang on one neighbour and look alike may be taken in any order: the form is the same.
    search(_split_twins(first, statements))
    return hashlib.sha256((best[0] or "").encode()).hexdigest(), best[1] or {}, work[0] < most


def _split_twins(colour: dict[str, str], statements: list[tuple[str, str, str]]) -> dict[str, str]:
    """Blanks whose statements are equal but for themselves are interchangeable: they are numbered at once."""
    own: dict[str, list[tuple]] = {b: [] for b in colour}
    for s, p, o in statements:
        if s in own:
            own[s].append((">", p, "self" if o == s else o))
        if o in own and o != s:
            own[o].append(("<", p, s))
    twins: dict[tuple, list[str]] = {}
    for b in colour:
        twins.setdefault((colour[b], *sorted(own[b])), []).append(b)
    out = dict(colour)
    for members in twins.values():
        for i, b in enumerate(sorted(members)):
            out[b] = _digest(colour[b], "twin", f"{i:08}") if len(members) > 1 else colour[b]
    return refine(out, statements) if out != colour else out


def _graphs(table: pa.Table) -> pa.Table:
    rows = sorted(set(zip(*(table.column(c).to_pylist() for c in ("s", "p", "o")), strict=True)))
    graph, order, exact = canonical_graph(rows)
    return pa.table({"component": [table.column("component")[0].as_py()], "graph": [graph], "exact": [exact], "places": pa.array([[{"node": b, "place": i} for b, i in order.items()]], pa.list_(pa.struct([("node", pa.string()), ("place", pa.int64())])))})


def canonical(statements: DataFrame) -> DataFrame:
    """(component, graph, exact, places): each component's canonical digest and its blanks' places in it."""
    of = partition(statements)
    rows = statements.withColumn("node", F.when(_is_blank("s"), F.col("s")).otherwise(F.col("o"))).where("node like '\\\\_:%'").join(of, "node")
    return rows.select("component", "s", "p", "o").groupBy("component").applyInArrow(_graphs, "component string, graph string, exact boolean, places array<struct<node:string,place:long>>")


def occurrence_ordinals(graphs: DataFrame) -> DataFrame:
    """graphs with ordinal: equal components are numbered in order of their names."""
    return graphs.withColumn("ordinal", F.row_number().over(W.partitionBy("graph").orderBy("component")) - 1)


def freeze(statements: DataFrame, document_key: str) -> DataFrame:
    """(node, label): a blank's label is a hash of its document, its component's graph and number, and its place there."""
    rows = occurrence_ordinals(canonical(statements)).select("graph", "ordinal", F.explode("places").alias("x"))
    return rows.select(F.col("x.node").alias("node"), F.sha2(F.concat_ws("|", F.lit(document_key), "graph", F.col("ordinal").cast("string"), F.col("x.place").cast("string")), 256).alias("label"))


def rescope(statements: DataFrame, scope: str) -> DataFrame:
    """Statements whose blanks carry a scope, so that those of several documents stay apart."""
    mark = lambda c: F.when(_is_blank(c), F.concat(F.lit(f"_:{scope}."), F.expr(f"substring({c}, 3)"))).otherwise(F.col(c)).alias(c)
    return statements.select(mark("s"), "p", mark("o"))
