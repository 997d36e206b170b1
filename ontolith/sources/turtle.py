"""Turtle and RDF/XML to triples, and triples back to Turtle.

A term is (kind, text, datatype, language) with kind iri, blank or literal.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from urllib.parse import urljoin

from .functional import PREFIXES, SyntaxProblem

RDF, XSD = PREFIXES["rdf"], PREFIXES["xsd"]
Term = tuple

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)|(?P<long>\"{3}(?:(?:"|"")?(?:[^"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3})|(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<caret>\^\^)|(?P<number>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<punct>[;,\[\]()]|\.(?![\w]))|(?P<blank>_:[\w](?:[\w.\-]*[\w\-])?)|(?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:\-%]|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-%]|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-%]|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)|(?P<word>[A-Za-z]+)""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(s: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), s, flags=re.S)


def iri(text: str) -> Term:
    return ("iri", text, None, None)


def blank(text: str) -> Term:
    return ("blank", text, None, None)


def literal(text: str, datatype: str | None = None, lang: str | None = None) -> Term:
    return ("literal", text, datatype or (None if lang else XSD + "string"), lang)


class _Turtle:
    def __init__(self, text: str, base: str):
        self.base, self.prefixes, self.out, self.fresh, self.at = base, {}, [], 0, 0
        self.tokens, at = [], 0
        text = text.lstrip("\ufeff")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxProblem(f"unexpected character {text[at]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))

    def peek(self):
        return self.tokens[self.at]

    def take(self, value: str | None = None):
        t = self.tokens[self.at]
        if t[0] == "end" or (value is not None and t[1] != value):
            raise SyntaxProblem(f"expected {value} at {t[2]}, found {t[1]!r}")
        self.at += 1
        return t

    def new(self) -> Term:
        self.fresh += 1
        return blank(f"g{self.fresh}")

    def parse(self) -> list[tuple[Term, Term, Term]]:
        while self.peek()[0] != "end":
            kind, text, _ = self.peek()
            low = text.lower()
            if low in ("@prefix", "prefix"):
                self.take()
                name = self.take()[1]
                self.prefixes[name[:-1]] = self.resolve(self.take()[1])
                if text[0] == "@":
                    self.take(".")
            elif low in ("@base", "base"):
                self.take()
                self.base = self.resolve(self.take()[1])
                if text[0] == "@":
                    self.take(".")
            else:
                bracket = text == "["
                subject = self.term()
                if not (bracket and self.peek()[1] == "."):
                    self.properties(subject)
                self.take(".")
        return self.out

    def resolve(self, token: str) -> str:
        text = _unescape(token[1:-1])
        return urljoin(self.base, text) if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", text) and self.base else text

    def properties(self, subject: Term, end=(".", "]")):
        while True:
            if self.peek()[1] in end:
                return
            verb = iri(RDF + "type") if self.peek()[:2] == ("word", "a") else None
            verb = (self.take(), verb)[1] if verb else self.term()
            while True:
                self.out.append((subject, verb, self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()

    def term(self) -> Term:
        kind, text, at = self.take()
        if kind == "iri":
            return iri(self.resolve(text))
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SyntaxProblem(f"unknown prefix {prefix!r} at {at}")
            return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "blank":
            return blank("n" + text[2:])
        if kind in ("string", "long"):
            value = _unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "at":
                return literal(value, lang=self.take()[1][1:])
            if self.peek()[0] == "caret":
                self.take()
                return literal(value, self.term()[1])
            return literal(value)
        if kind == "number":
            return literal(text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text in ("true", "false"):
            return literal(text, XSD + "boolean")
        if text == "[":
            node = self.new()
            self.properties(node)
            self.take("]")
            return node
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            nodes = [self.new() for _ in items]
            for k, (node, item) in enumerate(zip(nodes, items, strict=True)):
                self.out.append((node, iri(RDF + "first"), item))
                self.out.append((node, iri(RDF + "rest"), nodes[k + 1] if k + 1 < len(nodes) else iri(RDF + "nil")))
            return nodes[0] if nodes else iri(RDF + "nil")
        raise SyntaxProblem(f"expected a term at {at}, found {text!r}")


def parse_turtle(text: str, base: str = "") -> list[tuple[Term, Term, Term]]:
    return _Turtle(text, base).parse()


def guard_xml(data: str) -> None:
    """Document types and entities are refused before any parsing."""
    if re.search(r"<!(DOCTYPE|ENTITY)", data):
        raise SyntaxProblem("document types and entities are not allowed")


_XML = "{http://www.w3.org/XML/1998/namespace}"


def parse_rdfxml(text: str, base: str = "") -> list[tuple[Term, Term, Term]]:
    guard_xml(text)
    try:
        root = ET.fromstring(text.encode())
    except ET.ParseError as e:
        raise SyntaxProblem(str(e)) from e
    out, fresh = [], 0

    def new():
        nonlocal fresh
        fresh += 1
        return blank(f"g{fresh}")

    def q(tag):
        return tag[1:].replace("}", "", 1)

    def resolve(value, base):
        return urljoin(base, value) if base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) else value

    def node(e, base, lang):
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        a = {q(k) if k[0] == "{" else k: v for k, v in e.attrib.items()}
        if RDF + "about" in a:
            s = iri(resolve(a[RDF + "about"], base))
        elif RDF + "ID" in a:
            s = iri(resolve("#" + a[RDF + "ID"], base))
        elif RDF + "nodeID" in a:
            s = blank("n" + a[RDF + "nodeID"])
        else:
            s = new()
        if q(e.tag) != RDF + "Description":
            out.append((s, iri(RDF + "type"), iri(q(e.tag))))
        for k, v in a.items():
            if not k.startswith(RDF) and not k.startswith(_XML[1:-1]):
                out.append((s, iri(k), literal(v, lang=lang)))
            elif k == RDF + "type":
                out.append((s, iri(k), iri(resolve(v, base))))
        item = 0
        for p in e:
            name = q(p.tag)
            if name == RDF + "li":
                item += 1
                name = f"{RDF}_{item}"
            prop(s, name, p, base, lang)
        return s

    def prop(s, name, e, base, lang):
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        a = {q(k) if k[0] == "{" else k: v for k, v in e.attrib.items()}
        kind, children = a.get(RDF + "parseType"), list(e)
        if RDF + "resource" in a:
            o = iri(resolve(a[RDF + "resource"], base))
        elif RDF + "nodeID" in a:
            o = blank("n" + a[RDF + "nodeID"])
        elif kind == "Resource":
            o = new()
            for p in children:
                prop(o, q(p.tag), p, base, lang)
        elif kind == "Collection":
            items = [node(c, base, lang) for c in children]
            cells = [new() for _ in items]
            for k, (c, x) in enumerate(zip(cells, items, strict=True)):
                out.append((c, iri(RDF + "first"), x))
                out.append((c, iri(RDF + "rest"), cells[k + 1] if k + 1 < len(cells) else iri(RDF + "nil")))
            o = cells[0] if cells else iri(RDF + "nil")
        elif kind == "Literal":
            o = literal((e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in children), RDF + "XMLLiteral")
        elif children:
            o = node(children[0], base, lang)
        elif any(not k.startswith((RDF, _XML[1:-1])) for k in a):
            o = new()
            for k, v in a.items():
                if not k.startswith((RDF, _XML[1:-1])):
                    out.append((o, iri(k), literal(v, lang=lang)))
        else:
            datatype = a.get(RDF + "datatype")
            o = literal(e.text or "", resolve(datatype, base) if datatype else None, None if datatype else lang or None)
        out.append((s, iri(name), o))

    if q(root.tag) == RDF + "RDF":
        for e in root:
            node(e, root.get(_XML + "base", base), root.get(_XML + "lang"))
    else:
        node(root, base, None)
    return out


def write_turtle(triples) -> str:
    """N-Triples-like Turtle, one statement a line, sorted and without repeats."""

    def show(t):
        kind, text, datatype, lang = t
        if kind == "iri":
            return f"<{text}>"
        if kind == "blank":
            return f"_:{text}"
        quoted = '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'
        return f"{quoted}@{lang}" if lang else quoted if datatype == XSD + "string" else f"{quoted}^^<{datatype}>"

    return "".join(sorted({f"{show(s)} {show(p)} {show(o)} .\n" for s, p, o in triples}))


def write_rdfxml(triples) -> str:
    """RDF/XML, one description a subject, sorted and without repeats. A predicate must end in an XML name."""
    from xml.sax.saxutils import escape, quoteattr

    by_subject: dict = {}
    for s, p, o in triples:
        by_subject.setdefault(s[:2], set()).add((p[1], o))
    spaces, out = {RDF: "rdf"}, []
    for kind, text in sorted(by_subject):
        out.append(f"  <rdf:Description {'rdf:about' if kind == 'iri' else 'rdf:nodeID'}={quoteattr(text)}>\n")
        for name, (what, value, datatype, lang) in sorted(by_subject[kind, text], key=repr):
            cut = re.search(r"[A-Za-z_][\w.\-]*$", name)
            if not cut:
                raise SyntaxProblem(f"{name} has no local name for XML")
            space, local = name[: cut.start()], cut[0]
            tag = f"{spaces.setdefault(space, f'n{len(spaces)}')}:{local}"
            if what == "literal":
                extra = f" xml:lang={quoteattr(lang)}" if lang else "" if datatype in (None, XSD + "string") else f" rdf:datatype={quoteattr(datatype)}"
                out.append(f"    <{tag}{extra}>{escape(value, {chr(13): '&#13;'})}</{tag}>\n")
            else:
                out.append(f"    <{tag} {'rdf:resource' if what == 'iri' else 'rdf:nodeID'}={quoteattr(value)}/>\n")
        out.append("  </rdf:Description>\n")
    names = "".join(f" xmlns:{prefix}={quoteattr(space)}" for space, prefix in spaces.items())
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF{names}>\n{"".join(out)}</rdf:RDF>\n'
