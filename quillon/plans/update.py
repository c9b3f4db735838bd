"""Updates of a quad table: each request gives a new, lazy Quads; with graph management and loading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import algebra as A
from quillon.sources.graphs import Quads, read_nquads

from .syntax import Parser
from .translate import Translator

COLUMNS = ["g", "s", "p", "o"]
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def update(source: Quads, text: str) -> Quads:
    """Applies requests separated by `;` in order: INSERT DATA, DELETE DATA, DELETE WHERE, [WITH] DELETE/INSERT WHERE, LOAD, CLEAR, DROP, CREATE, ADD, COPY, MOVE. A graph exists while it has quads, so CREATE changes nothing and CLEAR equals DROP. Template rows with unbound variables add nothing."""
    p = _Requests(text)
    while p.at < len(p.tokens):
        source = p.request(source)
        if p.at < len(p.tokens):
            p.need(";")
    return source


class _Requests(Parser):
    def request(self, source: Quads) -> Quads:
        self.prologue()
        if self.take("INSERT") and self.take("DATA"):
            return source.insert(_ground(self.quads(None)))
        elif self.tokens[self.at - 1][1].upper() == "INSERT":
            return self.modify(source, None, [], self.quads(None))
        if self.take("DELETE"):
            if self.take("DATA"):
                return source.delete(_ground(self.quads(None)))
            if self.take("WHERE"):
                start = self.at
                gone = self.quads(None)
                self.at = start + 1
                return _modified(source, self.group(), gone, [], None)
            gone = self.quads(None)
            return self.modify(source, None, gone, self.quads(None) if self.take("INSERT") else [])
        if self.take("WITH"):
            graph = self.term()[1]
            gone = self.quads(graph) if self.take("DELETE") else []
            return self.modify(source, graph, gone, self.quads(graph) if self.take("INSERT") else [])
        kind = self.next()[1].upper()
        silent = self.take("SILENT")
        if kind == "LOAD":
            path = self.term()[1]
            graph = self.target() if self.take("INTO") else None
            return _loaded(source, path, graph, silent)
        if kind in ("CLEAR", "DROP", "CREATE"):
            target = self.target()
            return source if kind == "CREATE" else Quads(source.df.where(~_of(target)), source.graph)
        if kind in ("ADD", "COPY", "MOVE"):
            a = self.target()
            self.need("TO")
            return _copied(source, kind, a, self.target())
        raise ValueError(f"unknown request {kind}")

    def modify(self, source: Quads, graph: str | None, gone: list, new: list) -> Quads:
        while self.take("USING"):
            self.take("NAMED")
            graph = self.term()[1]
        self.need("WHERE")
        return _modified(source, self.block(), gone, new, graph)

    def target(self) -> str | None:
        """A graph's name, None for the default graph, or "NAMED" or "ALL" in capitals."""
        if self.take("DEFAULT"):
            return None
        if self.peek("NAMED", "ALL"):
            return self.next()[1].upper()
        self.take("GRAPH")
        return self.term()[1]

    def quads(self, graph: str | None) -> list[tuple]:
        """(graph term or None, s, p, o) of a template."""
        out = []
        for e in self.block():
            if e[0] == "triple":
                out.append((None if graph is None else ("iri", graph), *e[1:]))
            elif e[0] == "graph":
                out += [(e[1], *t[1:]) for t in e[2]]
            else:
                raise ValueError(f"{e[0]} in a template")
        return out


def _text(term: tuple | None, predicate: bool = False) -> str | None:
    return None if term is None else TYPE if predicate and term[1] == "a" else f'"{term[1]}"{term[2]}' if len(term) == 3 else str(term[1])


def _ground(quads: list[tuple]) -> DataFrame:
    if any(t is not None and t[0] == "var" for q in quads for t in q):
        raise ValueError("data must not hold variables")
    rows = [(_text(g), _text(s), _text(p, True), _text(o)) for g, s, p, o in quads]
    return SparkSession.active().createDataFrame(rows, "g string, s string, p string, o string")


def _filled(rows: DataFrame, template: list[tuple]) -> DataFrame | None:
    def made(term: tuple | None, name: str):
        if term is None or term[0] != "var":
            return F.lit(_text(term, name == "p")).cast("string").alias(name)
        return (F.col(f"`{term[1]}`") if term[1] in rows.columns else F.lit(None)).cast("string").alias(name)

    parts = [rows.select(*[made(t, n) for t, n in zip(q, COLUMNS, strict=True)]).dropna(subset=["s", "p", "o"] + (["g"] if q[0] is not None else [])) for q in template]
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def _modified(source: Quads, where: list, gone: list, new: list, graph: str | None) -> Quads:
    """Both templates are filled from the rows as they are before the request."""
    rows: A.Solutions = Translator(Quads(source.df, graph if graph is not None else source.graph)).group(where)
    out = source
    removed, added = _filled(rows.df, gone), _filled(rows.df, new)
    if removed is not None:
        out = out.delete(removed)
    return out.insert(added) if added is not None else out


def _of(target: str | None):
    if target == "ALL":
        return F.lit(True)
    return F.col("g").isNull() if target is None else F.col("g").isNotNull() if target == "NAMED" else F.col("g").eqNullSafe(target)


def _loaded(source: Quads, path: str, graph: str | None, silent: bool) -> Quads:
    try:
        rows = read_nquads(SparkSession.active(), path)
    except Exception:
        if silent:
            return source
        raise
    return source.insert(rows.withColumn("g", F.coalesce(F.col("g"), F.lit(graph).cast("string"))))


def _copied(source: Quads, kind: str, a: str | None, b: str | None) -> Quads:
    if a == b:
        return source
    moved = source.df.where(_of(a)).withColumn("g", F.lit(b).cast("string"))
    kept = source.df if kind == "ADD" else source.df.where(~_of(b))
    if kind == "MOVE":
        kept = kept.where(~_of(a))
    return Quads(kept.unionByName(moved).distinct(), source.graph)
