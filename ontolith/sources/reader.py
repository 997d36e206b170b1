"""Ontology files to tables: one row a file in, structural rows out, a document and an axiom at a time.

read() gives a catalog of lazy DataFrames over one parsed table that is written once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import settle
from . import encoding, functional, mapping, owlxml, turtle
from .functional import Document, SyntaxProblem
from .nodes import Node, strip_annotations

FORMATS = ("functional", "owlxml", "rdfxml", "turtle")
# Media types and file endings.
MEDIA = {"text/owl-functional": "functional", "application/owl+xml": "owlxml", "application/rdf+xml": "rdfxml", "text/turtle": "turtle", "application/x-turtle": "turtle"}
ENDINGS = {".ofn": "functional", ".omn": "functional", ".owx": "owlxml", ".rdf": "rdfxml", ".owl": "rdfxml", ".ttl": "turtle", ".nt": "turtle"}


def sniff(data: bytes) -> str | None:
    """The format that the beginning of a file shows."""
    head = data[:4096].decode("utf-8", "replace").lstrip("﻿ \t\r\n")
    head = re.sub(r"^(<\?xml[^>]*\?>\s*|<!--.*?-->\s*|#[^\n]*\n\s*)+", "", head, flags=re.S)
    if re.match(r"(Prefix|Ontology)\s*\(", head):
        return "functional"
    if re.match(r"<(\w+:)?RDF\b", head):
        return "rdfxml"
    if re.match(r"<(\w+:)?Ontology\b", head):
        return "owlxml"
    if re.match(r"(@prefix|@base|PREFIX|BASE|<[^>\s]*>\s|_:|\[|[\w-]*:\S*\s)", head):
        return "turtle"
    return None


def detect(data: bytes, explicit: str | None = None, media_type: str | None = None, name: str | None = None) -> str:
    """Explicit before media type before content before ending."""
    if explicit:
        if explicit not in FORMATS:
            raise SyntaxProblem(f"unknown format {explicit}")
        return explicit
    found = MEDIA.get((media_type or "").split(";")[0].strip()) or sniff(data) or ENDINGS.get(os.path.splitext(name or "")[1].lower())
    if not found:
        raise SyntaxProblem("the format can't be told")
    return found


def parse(data: bytes, fmt: str | None = None, base: str = "", strict: bool = True, name: str | None = None) -> Document:
    """One document of any format. Anonymous individuals are scoped by the source's bytes."""
    fmt = detect(data, fmt, name=name)
    scope, text = hashlib.sha256(data).digest(), data.decode("utf-8-sig")
    if fmt == "functional":
        return functional.parse(text, scope)
    if fmt == "owlxml":
        return owlxml.parse(text, scope)
    triples = turtle.parse_turtle(text, base) if fmt == "turtle" else turtle.parse_rdfxml(text, base)
    return mapping.map_triples(triples, scope, strict)[0]


def render(doc: Document, fmt: str) -> str:
    """Deterministic text in a format."""
    if fmt == "functional":
        return functional.write(doc)
    if fmt == "owlxml":
        return owlxml.write(doc)
    if fmt == "turtle":
        return turtle.write_turtle(encoding.encode(doc))
    if fmt == "rdfxml":
        return turtle.write_rdfxml(encoding.encode(doc))
    raise SyntaxProblem(f"no writer for {fmt}")


def write_document(doc: Document, path: str, fmt: str) -> None:
    """Written beside its place and renamed there."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(render(doc, fmt))
    os.replace(part, path)


#: Columns of each part of the parsed table, beside document_key and part. A document's rows are many, none of them long.
PARTS = {
    "document": "path string, format string, error string, warning string, ontology_iri string, version_iri string, source_sha256 binary, byte_length long, imports array<string>",
    "root": "root_kind string, root_id binary, tag int, canonical binary, logical_id binary, ordinal int, args array<struct<field:int,item:int,kind:string,text:string,datatype:string,lang:string>>",
    "node": "node_id binary, tag int, canonical binary, entity_kind string, iri string, lexical string, datatype string, lang string",
    "field": "parent_id binary, field_ordinal int, item_index int, child_id binary",
    "occurrence": "root_id binary, node_id binary, tag int, entity_kind string, iri string, path string, role string, in_annotation boolean, depth int",
}
_COLUMNS = {p: [c.split()[0] for c in re.split(r", (?=\w+ )", text)] for p, text in PARTS.items()}
#: Rows made at once; nodes that are told from later ones; bytes of a document's rows that stay in memory until its end.
BATCH, SEEN, HELD = 8192, 100_000, 1 << 24


def _kind(parts) -> str:
    """The parsed table's columns if it holds some parts; a column that several parts have is there once."""
    own = {c.split()[0]: c for p in ("document", *(p for p in PARTS if p in parts)) for c in re.split(r", (?=\w+ )", PARTS[p])}
    return ", ".join(["document_key string, part string", *own.values()])


def spelled(n: Node) -> tuple[str, str, str | None, str | None]:
    """(kind, text, datatype, lang) of a value: named ones by their IRI, inverses with a leading ~, chains joined by >."""
    if n.name == "Entity":
        return n.values[0], n.values[1].values[0], None, None
    if n.name == "IRI":
        return "iri", n.values[0], None, None
    if n.name == "Literal":
        return "literal", n.values[0], n.values[1].values[1].values[0], n.values[2]
    if n.name == "AnonymousIndividual":
        return "anonymous", f"_:{n.values[0].hex()[:16]}.{n.values[1].decode()}", None, None
    if n.name == "ObjectInverseOf":
        return "inverse", "~" + spelled(n.values[0])[1], None, None
    if n.name == "ObjectPropertyChain":
        return "chain", ">".join(spelled(x)[1] for x in n.values[0]), None, None
    return "expression", n.digest().hex(), n.name, None


def arguments(root: Node) -> list[tuple]:
    """A root's own values but its annotations, (field, item, kind, text, datatype, lang): what flat views are made of, without a join."""
    return [(i, k, *spelled(n)) for i, k, role, n in root.children() if role != "annotation"]


def _places(n: Node, at: str, depth: int, role: str, inside: bool, head: tuple, out: list) -> None:
    """Occurrences below a root, itself first; paths are tag.field or tag.field.item, joined by /."""
    e = n.name == "Entity"
    out.append((*head, n.digest(), n.tag, n.values[0] if e else None, n.values[1].values[0] if e else n.values[0] if n.name == "IRI" else None, at, role, inside, depth))
    for i, k, r, child in n.children():
        step = f"{n.tag}.{i}" if k is None else f"{n.tag}.{i}.{k}"
        _places(child, f"{at}/{step}" if at else step, depth + 1, r, inside or r == "annotation", head, out)


class _Rows:
    """Rows of parsed documents as Arrow batches of BATCH or a few more.

    A document's axioms are read, told and let go one at a time (functional syntax; other formats are held
    whole while they are mapped). Its rows wait in a spool until its end is reached, as one that fails has none.
    """

    def __init__(self, kind: pa.Schema, parts=tuple(PARTS), strict: bool = True, most: int | None = None):
        self.kind, self.parts, self.strict, self.most = kind, {*parts}, strict, most
        self.rows: dict[str, list[tuple]] = {p: [] for p in PARTS}
        self.seen: set[bytes] = set()

    def count(self) -> int:
        return sum(map(len, self.rows.values()))

    def flush(self):
        for part, rows in self.rows.items():
            if rows:
                own = dict(zip(("document_key", *_COLUMNS[part]), zip(*rows, strict=True), strict=True)) | {"part": [part] * len(rows)}
                yield pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(rows), f.type) for f in self.kind], schema=self.kind)
            self.rows[part] = []

    def document(self, path: str, data: bytes):
        """The batches that one more document fills."""
        if self.count() + len(data) // 8 > BATCH:
            yield from self.flush()  # a long document's rows begin a batch of their own
        sha, before = hashlib.sha256(data).digest(), {p: len(rows) for p, rows in self.rows.items()}
        row = {"path": path, "source_sha256": sha, "byte_length": len(data), "imports": []}
        key, spool = sha.hex(), None
        try:
            if self.most is not None and len(data) > self.most:
                row["error"] = f"LimitExceeded: {len(data)} bytes, at most {self.most}"
            else:
                row["format"] = detect(data, name=path)
                ending = ENDINGS.get(os.path.splitext(path)[1].lower())
                if ending and ending != row["format"]:
                    row["warning"] = f"content is {row['format']}, the ending says {ending}"
                with functional.deep():
                    doc, roots = _opened(data, row["format"], path, self.strict)
                    own = doc.ontology_iri and hashlib.sha256(f"{doc.ontology_iri}\0{doc.version_iri or ''}".encode()).hexdigest()
                    for root in roots:
                        self.root(own or key, *root)
                        if self.count() >= BATCH and not any(before.values()):
                            spool = spool or _Spool(self.kind)
                            spool.add(self.flush())
                row |= {"ontology_iri": doc.ontology_iri, "version_iri": doc.version_iri, "imports": doc.imports}
                key = own or key
        except (ValueError, RecursionError) as e:
            row["error"], spool = f"{type(e).__name__}: {e}", None
            for p, n in before.items():
                del self.rows[p][n:]
        if spool:
            yield from spool.batches()
        self.rows["document"].append((key, *(row.get(c) for c in _COLUMNS["document"])))
        self.seen.clear()
        if self.count() >= BATCH:
            yield from self.flush()

    def root(self, key: str, kind: str, ordinal: int, root: Node) -> None:
        rid = root.digest()
        if "root" in self.parts:
            self.rows["root"].append((key, kind, rid, root.tag, root.canonical, strip_annotations(root).digest(), ordinal, arguments(root)))
        if "occurrence" in self.parts:
            _places(root, "", 0, "root", False, (key, rid), self.rows["occurrence"])
        if self.parts & {"node", "field"}:
            self.nodes(key, root)

    def nodes(self, key: str, n: Node) -> None:
        """A node and those below it, but for ones that the document had before."""
        nid = n.digest()
        if nid in self.seen:
            return
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen.add(nid)
        if "node" in self.parts:
            e, lit = n.name == "Entity", n.name == "Literal"
            self.rows["node"].append((key, nid, n.tag, n.canonical, n.values[0] if e else None, n.values[1].values[0] if e else n.values[0] if n.name == "IRI" else None, n.values[0] if lit else None, n.values[1].values[1].values[0] if lit else None, n.values[2] if lit else None))
        for i, k, _, child in n.children():
            if "field" in self.parts:
                self.rows["field"].append((key, nid, i, k, child.digest()))
            self.nodes(key, child)


class _Spool:
    """Batches that wait, in memory up to HELD bytes and then in a file of the task's own."""

    def __init__(self, kind: pa.Schema):
        self.file = tempfile.SpooledTemporaryFile(HELD)
        self.out = pa.ipc.new_stream(self.file, kind)

    def add(self, batches) -> None:
        for b in batches:
            self.out.write_batch(b)

    def batches(self):
        self.out.close()
        self.file.seek(0)
        with self.file, pa.ipc.open_stream(self.file) as back:
            yield from back


def _opened(data: bytes, fmt: str, base: str, strict: bool):
    """A document's head and its roots (kind, ordinal, node), each once; functional syntax is read as they are asked for."""
    if fmt == "functional":
        reading = functional.Reader(data.decode("utf-8-sig"), hashlib.sha256(data).digest())
        doc = reading.begin()
        axioms = reading.axioms()
    else:
        doc = parse(data, fmt, base, strict)
        axioms = doc.axioms

    def roots():
        for kind, part in (("ontology_annotation", doc.annotations), ("axiom", axioms), ("extension", doc.extensions)):
            seen = set()
            for root in part:
                if (rid := root.digest()) not in seen:
                    yield kind, len(seen), root
                    seen.add(rid)

    return doc, roots()


@dataclass
class Snapshot:
    """Lazy tables of parsed documents."""

    parsed: DataFrame

    def _part(self, name: str) -> DataFrame:
        if not {*_COLUMNS[name]} <= {*self.parsed.columns}:
            raise ValueError(f"these documents were read without {name} rows")
        return self.parsed.where(F.col("part") == name).select("document_key", *_COLUMNS[name])

    @property
    def document(self) -> DataFrame:
        return self._part("document").drop("imports")

    @property
    def root(self) -> DataFrame:
        return self._part("root")

    @property
    def node(self) -> DataFrame:
        return self._part("node").drop("document_key").dropDuplicates(["node_id"])

    @property
    def node_field(self) -> DataFrame:
        return self._part("field").drop("document_key").distinct()

    @property
    def occurrence(self) -> DataFrame:
        return self._part("occurrence")

    @property
    def import_edge(self) -> DataFrame:
        """Imports joined with the documents that bear their IRI."""
        documents = self._part("document")
        wanted = documents.select(F.col("document_key").alias("importing"), F.explode("imports").alias("iri"))
        owners = documents.where("error is null").select(F.explode(F.array("ontology_iri", "version_iri", "path")).alias("iri"), F.col("document_key").alias("imported")).where("iri is not null").groupBy("iri").agg(F.min("imported").alias("imported"))
        return wanted.join(owners, "iri", "left").select("importing", "imported", "iri", F.when(F.col("imported").isNull(), "unresolved").otherwise("resolved").alias("status"))

    def _axioms(self, *tags: int) -> DataFrame:
        """Axioms of some tags with their arguments."""
        return self.root.where((F.col("root_kind") == "axiom") & F.col("tag").isin(*tags))

    def _pairs(self, *tags: int) -> DataFrame:
        """(root_id, tag, a, b, document_key): first two arguments of each axiom."""
        return self._axioms(*tags).select("root_id", "tag", F.col("args")[0].alias("a"), F.col("args")[1].alias("b"), "document_key")

    @property
    def declaration(self) -> DataFrame:
        return self._axioms(60).select("root_id", F.col("args")[0]["kind"].alias("kind"), F.col("args")[0]["text"].alias("iri"), "document_key")

    @property
    def sub_class(self) -> DataFrame:
        """Named sub-class axioms."""
        return self._pairs(61).where("a.kind = 'class' and b.kind = 'class'").select("root_id", F.col("a.text").alias("sub"), F.col("b.text").alias("sup"), "document_key")

    @property
    def equivalent_class(self) -> DataFrame:
        """Named members of equivalence axioms."""
        return self._axioms(62).select("root_id", F.explode("args").alias("x"), "document_key").where("x.kind = 'class'").select("root_id", F.col("x.text").alias("member"), "document_key").distinct()

    @property
    def disjoint_union(self) -> DataFrame:
        """(member, defined): named members of disjoint unions."""
        rows = self._axioms(64).select("root_id", F.col("args")[0]["text"].alias("defined"), F.explode(F.slice("args", 2, 1 << 30)).alias("x"))
        return rows.where("x.kind = 'class'").select("root_id", F.col("x.text").alias("member"), "defined")

    @property
    def class_assertion(self) -> DataFrame:
        return self._pairs(112).where("a.kind = 'class'").select("root_id", F.col("a.text").alias("class_iri"), F.col("b.text").alias("individual"), "document_key")

    @property
    def object_assertion(self) -> DataFrame:
        third = F.col("args")[2]["text"]
        return self._axioms(113).select("root_id", F.col("args")[0]["text"].alias("property"), F.col("args")[1]["text"].alias("source"), third.alias("target"), "document_key")

    @property
    def data_assertion(self) -> DataFrame:
        value = F.col("args")[2]
        return self._axioms(115).select("root_id", F.col("args")[0]["text"].alias("property"), F.col("args")[1]["text"].alias("source"), value["text"].alias("lexical"), value["datatype"].alias("datatype"), "document_key")

    @property
    def annotation_assertion(self) -> DataFrame:
        value = F.col("args")[2]
        return self._axioms(120).select("root_id", F.col("args")[0]["text"].alias("property"), F.col("args")[1]["text"].alias("subject"), value["kind"].alias("value_kind"), value["text"].alias("value"), value["lang"].alias("lang"), "document_key")

    @property
    def property_axiom(self) -> DataFrame:
        """(root_id, tag, first, second, chain): n-ary axioms as pairs with their first member, chains in `chain`."""
        args, one = F.col("args"), F.lit("")
        two = self._axioms(70, 73, 90, 121).select("root_id", "tag", F.when(args[0]["kind"] == "chain", one).otherwise(args[0]["text"]).alias("first"), args[1]["text"].alias("second"), F.when(args[0]["kind"] == "chain", args[0]["text"]).otherwise(one).alias("chain"), "document_key")
        single = self._axioms(76, 77, 78, 79, 80, 81, 82, 95).select("root_id", "tag", args[0]["text"].alias("first"), one.alias("second"), one.alias("chain"), "document_key")
        many = self._axioms(71, 72, 91, 92).select("root_id", "tag", args[0]["text"].alias("first"), F.explode(F.transform(F.slice("args", 2, 1 << 30), lambda x: x["text"])).alias("second"), one.alias("chain"), "document_key")
        return two.unionByName(single).unionByName(many)

    @property
    def domain_range(self) -> DataFrame:
        tag = F.col("tag")
        kind = F.when(tag.isin(74, 75), "object").when(tag.isin(93, 94), "data").otherwise("annotation")
        rows = self._pairs(74, 75, 93, 94, 122, 123)
        named = F.when(tag >= 122, F.col("b.kind") == "iri").otherwise(F.col("b.kind").isin("class", "datatype"))
        return rows.select("root_id", "tag", kind.alias("property_kind"), F.col("a.text").alias("property"), F.when(tag.isin(74, 93, 122), "domain").otherwise("range").alias("record_kind"), F.col("b.text").alias("value"), named.alias("named"), "document_key")

    @property
    def complex_endpoints(self) -> DataFrame:
        """(tag, n): values of class axioms that hierarchies leave out because they have no name."""
        rows = self._axioms(61, 62, 64).select("root_id", "tag", F.explode("args").alias("x")).where("x.kind <> 'class'")
        return rows.groupBy("tag").agg(F.count("*").alias("n"))

    @property
    def nested_annotation(self) -> DataFrame:
        """(root_id, container, annotation, depth): annotations inside a root and the annotations that hold them."""
        rows = self.occurrence.where("tag = 5")
        return rows.select("root_id", "node_id", F.size(F.filter(F.split("path", "/"), lambda x: x.startswith("5."))).alias("depth"), "path")

    def identity(self) -> DataFrame:
        """(document_key, ontology_iri, version_iri, ordinal): which documents there are, equal sources numbered."""
        from ..operators.algebra import ordinals

        return ordinals(self.document.where("error is null"), "ontology_iri", "source_sha256", "document_key").select("document_key", "ontology_iri", "version_iri", "ordinal")

    def columns(self) -> DataFrame:
        """Nodes with dense ids in canonical order and their children's ids: (id, tag, children) for columnar export."""
        from ..operators.views import dense_ids

        ids = settle(dense_ids(self.node.select("node_id", "tag", "canonical"), F.col("canonical")).select("node_id", "tag", "id"))
        at = lambda c: ids.select(F.col("node_id").alias(c), F.col("id").alias(f"{c}_no"))
        links = self.node_field.join(at("parent_id"), "parent_id").join(at("child_id"), "child_id")
        order = F.struct("field_ordinal", F.coalesce("item_index", F.lit(-1)).alias("item"), "child_id_no")
        kids = links.groupBy(F.col("parent_id_no").alias("id")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["child_id_no"]).alias("children"))
        return ids.join(kids, "id", "left").select("id", "tag", F.coalesce("children", F.array().cast("array<bigint>")).alias("children"))

    def save(self, path: str) -> None:
        self.parsed.write.parquet(path)


def read(spark: SparkSession, path: str, strict: bool = True, max_bytes: int | None = None, parts=tuple(PARTS)) -> Snapshot:
    """All files under a path; a file that can't be parsed keeps a row with its error. Equal bytes are parsed once."""
    if re.match(r"(https?|ftp)://", path):
        raise SyntaxProblem("network addresses are not read")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read_texts(files.select("path", "content"), strict, max_bytes, parts)


def read_texts(files: DataFrame, strict: bool = True, max_bytes: int | None = None, parts=tuple(PARTS)) -> Snapshot:
    """Documents given as rows (path, content), content being bytes or text. Of equal contents the least path is parsed.

    Only hashes and paths are shuffled; contents stay where they are but for those that are parsed. parts:
    which rows are kept beside the documents'; all of each text is read and checked whatever they are.
    """
    rows = files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    chosen = rows.select("path", F.sha2("content", 256).alias("sha")).groupBy("sha").agg(F.min("path").alias("path")).select("path")
    kind = _arrow_schema(parts)

    def run(batches):
        out = _Rows(kind, parts, strict, max_bytes)
        for b in batches:
            for k in range(b.num_rows):
                yield from out.document(b.column(0)[k].as_py(), b.column(1)[k].as_py())
        yield from out.flush()

    return Snapshot(settle(rows.join(chosen, "path", "left_semi").select("path", "content").mapInArrow(run, _kind(parts))))


def coerce(spark: SparkSession, value) -> Snapshot:
    """A snapshot of whatever stands for one: a snapshot, rows (path, content), bytes, text, or a path."""
    if isinstance(value, Snapshot):
        return value
    if isinstance(value, DataFrame):
        return read_texts(value)
    if isinstance(value, bytes) or isinstance(value, str) and re.match(r"\s*(Prefix|Ontology|<|@|#)", value):
        data = value if isinstance(value, bytes) else value.encode()
        return read_texts(spark.createDataFrame([("memory:", bytearray(data))], "path string, content binary"))
    return read(spark, os.fspath(value))


def render_documents(files: DataFrame, fmt: str) -> DataFrame:
    """Documents (path, content) written anew in a format: (path, format, content, error), one a row."""

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out.append((path, fmt, render(parse(bytes(content), name=path), fmt), None))
                except (ValueError, RecursionError) as e:
                    out.append((path, fmt, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], names=["path", "format", "content", "error"])

    rows = files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(run, "path string, format string, content string, error string")


def encoded_triples(files: DataFrame) -> DataFrame:
    """RDF triples of documents (path, content): (path, s, p, o, o_kind)."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                triples = encoding.encode(parse(bytes(content), name=path))
                cols = [[path] * len(triples), [s[1] for s, _, _ in triples], [p[1] for _, p, _ in triples], [o[1] for _, _, o in triples], [o[0] for _, _, o in triples]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", "s", "p", "o", "o_kind"])

    rows = files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(run, "path string, s string, p string, o string, o_kind string")


def load_closure(spark: SparkSession, roots: DataFrame, library: DataFrame, policy: str = "resolve_strict", rounds: int = 64, parts=tuple(PARTS)) -> Snapshot:
    """Documents (path, content) and all they import, level by level.

    library (iri, path, content) is what imports resolve to. Each level parses what isn't parsed yet, takes
    its imports, and semi-joins the library with them; a cycle ends since nothing new comes. A policy of
    `ignore` reads the roots alone, `record_unresolved` keeps what isn't found as edges, the others raise.
    """
    from ..operators.imports import IGNORE, with_policy

    parsed = seen = read_texts(roots, parts=parts).parsed
    folders = [seen._settled]
    for _ in range(0 if policy == IGNORE else rounds):
        wanted = seen.where("part = 'document'").select(F.explode("imports").alias("iri")).distinct()
        fresh = library.join(wanted, "iri", "left_semi").withColumn("sha", F.sha2(F.col("content").cast("binary"), 256))
        known = parsed.where("part = 'document'").select(F.lower(F.hex("source_sha256")).alias("sha"))
        fresh = settle(fresh.join(known, "sha", "left_anti").select("path", "content"))
        if not fresh.limit(1).count():
            break
        seen = read_texts(fresh, parts=parts).parsed
        # Each level is written once; what has been parsed is their folders read together.
        folders.append(seen._settled)
        parsed = spark.read.schema(seen.schema).parquet(*folders)
    out = Snapshot(parsed)
    with_policy(out.import_edge, policy)
    return out


def load(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot that save() wrote."""
    return Snapshot(spark.read.parquet(path))


def _arrow_schema(parts=tuple(PARTS)) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(_kind(parts)))


def diagnostics_json(snapshot: Snapshot) -> str:
    """Errors by document, keys sorted."""
    rows = snapshot.document.where("error is not null").select("path", "error").orderBy("path").toLocalIterator()
    return json.dumps([{"error": r["error"], "path": r["path"]} for r in rows], sort_keys=True)
