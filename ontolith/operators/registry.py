"""Views by name: built-in and user-made ones over any object with axiom tables, kept while in use."""

from __future__ import annotations

import inspect
import itertools
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame

from . import hierarchy, views


_tokens = itertools.count()


class ViewRegistry:
    """Named functions (tables, **options) -> DataFrame. Results are persisted, the least used one going first."""

    def __init__(self, most: int = 16):
        self._made: dict[str, Callable[..., DataFrame]] = {}
        self._held: OrderedDict[tuple, DataFrame] = OrderedDict()
        self.most, self.hits, self.misses = most, 0, 0

    def register(self, name: str, fn: Callable[..., DataFrame], replace: bool = False) -> None:
        if name in self._made and not replace:
            raise ValueError(f"a view {name} is there")
        self._made[name] = fn

    def view(self, tables, name: str, **options) -> DataFrame:
        """The view; an unknown option is a TypeError, an unknown view a KeyError."""
        fn = self._made[name]
        inspect.signature(fn).bind(tables, **options)
        key = (self._token(tables), name, tuple(sorted(options.items())))
        if key in self._held:
            self.hits += 1
            self._held.move_to_end(key)
            return self._held[key]
        self.misses += 1
        self._held[key] = fn(tables, **options).persist()
        while len(self._held) > self.most:
            self._held.popitem(last=False)[1].unpersist()
        return self._held[key]

    def fresh(self, tables, name: str, **options) -> DataFrame:
        """The view, not kept."""
        inspect.signature(self._made[name]).bind(tables, **options)
        return self._made[name](tables, **options)

    def _token(self, tables) -> int:
        """A number of the tables themselves, never one of others that are gone."""
        if not hasattr(tables, "_registry_token"):
            object.__setattr__(tables, "_registry_token", next(_tokens))
        return tables._registry_token

    def clear(self) -> None:
        while self._held:
            self._held.popitem()[1].unpersist()

    def report(self) -> dict:
        return {"views": len(self._made), "held": len(self._held), "most": self.most, "hits": self.hits, "misses": self.misses}


def _limited(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """limit is None or a whole number from 0; with it, the first rows in order."""
    if limit is None:
        return df
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
        raise ValueError("limit must be a whole number from 0")
    return df.orderBy(*order).limit(limit)


def default() -> ViewRegistry:
    r = ViewRegistry()
    r.register("axiom_types", lambda t, tag=None, document_key=None, limit=None: _limited(views.axioms(t.root, tag, document_key), limit, "root_id"))
    r.register("axiom_type_counts", lambda t: views.axiom_type_counts(t.root))
    r.register("signature", lambda t, include_builtins=True, include_annotations=True, limit=None: _limited(views.signature(t.occurrence, include_builtins, include_annotations), limit, views.signature_order()))
    r.register("declarations", lambda t, limit=None: _limited(views.declared(t.declaration), limit, views.signature_order()))
    r.register("undeclared", lambda t, include_builtins=False, limit=None: _limited(views.undeclared(t.occurrence, t.declaration, include_builtins), limit, views.signature_order()))
    r.register("annotations", lambda t, property=views.LABEL, subject=None, limit=None: _limited(views.annotation_values(t.annotation_assertion, property, subject), limit, "subject", "value"))
    r.register("references", lambda t, role=None, include_annotations=True, limit=None: _limited(views.references(t.occurrence, role, include_annotations), limit, *(c for c in ("root_id", "path", "role", "entity_kind", "iri") if c in t.occurrence.columns)))
    r.register("expressions", lambda t, limit=None: _limited(views.postings(t.occurrence), limit, views.signature_order()))
    r.register("class_hierarchy", lambda t, mode=hierarchy.PRESERVE, limit=None: _limited(hierarchy.class_edges(t.sub_class, t.equivalent_class, mode), limit, *hierarchy.edge_order()))
    r.register("property_hierarchy", lambda t, limit=None: _limited(hierarchy.property_edges(t.property_axiom), limit, *hierarchy.edge_order()))
    r.register("domain_ranges", lambda t, record_kind=None, named_only=False, limit=None: _limited(hierarchy.domain_ranges(t.domain_range, record_kind, named_only), limit, "property", "record_kind", "value"))
    return r
