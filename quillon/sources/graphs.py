"""What patterns are matched against: mapped tables and quad tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import algebra as A

# Key column of each table of the star schema.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id"}


class _Opened(dict):
    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self[name] = df.withColumn("l_id", F.struct("l_orderkey", "l_linenumber")) if name == "lineitem" else df
        return self[name]


class MappedTables:
    """Class -> table, subject -> key, predicate -> column: a star of patterns on one subject is one scan of the columns it names."""

    terms = False

    def __init__(self, tables: dict[str, DataFrame], keys: dict[str, str]):
        self.tables, self.keys = tables, keys

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> MappedTables:
        """The star schema; a table is opened when a pattern first asks for it."""
        return cls(_Opened(spark, sf_dir), KEYS | {"lineitem": "l_id"})

    def in_graph(self, term: tuple) -> MappedTables:
        raise ValueError("mapped tables have no named graphs")

    def edges(self, predicate: str) -> DataFrame:
        predicate = _local(predicate)
        table = next(t for t in self.keys if predicate in self.tables[t].columns)
        return self.tables[table].where(F.col(predicate).isNotNull()).select(F.col(self.keys[table]).alias("s"), F.col(predicate).alias("o"))

    def match(self, triples: list[tuple]) -> A.Solutions:
        stars: dict[tuple, list[tuple]] = {}
        for s, p, o in triples:
            if p[0] != "iri":
                raise ValueError("a mapped table needs named predicates")
            stars.setdefault(s, []).append((_local(p[1]), o))
        out = None
        pending = [self._star(s, star) for s, star in stars.items()]
        while pending:  # neighbours first, so that a cross product comes last
            at = next((i for i, x in enumerate(pending) if out is None or set(x.vars) & set(out.vars)), 0)
            nxt = pending.pop(at)
            out = nxt if out is None else A.join(out, nxt)
        return out

    def _star(self, subject: tuple, star: list[tuple]) -> A.Solutions:
        classes = [_local(o[1]) for p, o in star if p in ("a", "type")]
        props = [(p, o) for p, o in star if p not in ("a", "type")]
        table = next((t for t in classes or self.keys if t in self.keys and all(p in self.tables[t].columns for p, _ in props)), None)
        if table is None:
            raise ValueError(f"no table has {[p for p, _ in props]}")
        df, seen, cond = self.tables[table], {}, F.lit(True)
        for column, term in [(self.keys[table], subject), *props]:
            c = F.col(f"`{column}`")
            cond = cond & c.isNotNull()
            if term[0] != "var":
                cond = cond & (c == F.lit(term[1]))
            elif term[1] in seen:
                cond = cond & (c == seen[term[1]])
            else:
                seen[term[1]] = c
        return A.Solutions(df.where(cond).select(*[c.alias(v) for v, c in seen.items()]))


def _local(name: str) -> str:
    """The last part of an IRI: tables and columns go by it."""
    return re.split("[#/]", name)[-1]


#: Between graph and node where a path runs in each graph at once.
IN_GRAPH = "\x1f"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"


def term_forms(term: tuple) -> list[str]:
    """How a term of a query may stand in a quad: IRIs bare, literals bare or with their type, as quotes and suffix."""
    if term[0] == "iri":
        return [TYPE if term[1] == "a" else term[1]]
    value = term[1]
    if len(term) == 3:
        return [f'"{value}"{term[2]}']
    if isinstance(value, bool):
        return [str(value).lower(), f'"{str(value).lower()}"^^<{XSD}boolean>']
    if isinstance(value, int):
        return [str(value), *[f'"{value}"^^<{XSD}{t}>' for t in ("integer", "int", "long")]]
    if not isinstance(value, str):
        return [str(value), *[f'"{value}"^^<{XSD}{t}>' for t in ("decimal", "double", "float")]]
    return [value, f'"{value}"^^<{XSD}string>']


class Quads:
    """A table g, s, p, o of strings; g is null for the default graph. `graph` is the graph in use: None (default), a name, or a variable term, which each pattern then binds."""

    terms = True

    def __init__(self, df: DataFrame, graph: str | tuple | None = None):
        self.df, self.graph = df, graph

    def in_graph(self, term: tuple) -> Quads:
        return Quads(self.df, term if term[0] == "var" else term[1])

    def dataset(self, default: list[str], named: list[str]) -> Quads:
        """FROM and FROM NAMED: the named graphs `default`, merged, are the default graph; `named` are the only named ones."""
        merged = self.df.where(F.col("g").isin(default)).withColumn("g", F.lit(None).cast("string")).distinct()
        return Quads(merged.unionByName(self.df.where(F.col("g").isin(named))), self.graph)

    def union_default(self) -> Quads:
        """The union of all named graphs as default graph; named graphs stay."""
        names = self.df.where(F.col("g").isNotNull())
        return Quads(names.withColumn("g", F.lit(None).cast("string")).distinct().unionByName(names), self.graph)

    def edges(self, predicate: str) -> DataFrame:
        return self._ends(self._rows().where(F.col("p") == (TYPE if predicate == "a" else predicate)))

    def other_edges(self, predicates: list[str]) -> DataFrame:
        """Edges of any predicate but these."""
        gone = [TYPE if p == "a" else p for p in predicates]
        return self._ends(self._rows().where(~F.col("p").isin(gone) if gone else F.lit(True)))

    def nodes(self) -> DataFrame:
        """s: every subject and object of the graph."""
        ends = self._ends(self._rows())
        return ends.select("s").unionByName(ends.select(F.col("o").alias("s"))).distinct()

    def _ends(self, rows: DataFrame) -> DataFrame:
        if isinstance(self.graph, tuple):
            return rows.select(*[F.concat("g", F.lit(IN_GRAPH), c).alias(c) for c in "so"])
        return rows.select("s", "o")

    def _rows(self) -> DataFrame:
        g = F.col("g")
        return self.df.where(g.isNotNull() if isinstance(self.graph, tuple) else g.isNull() if self.graph is None else g == self.graph)

    def names(self) -> DataFrame:
        return self.df.where("g is not null").select("g").distinct()

    def match(self, triples: list[tuple]) -> A.Solutions:
        out = None
        pending = [self._scan(t) for t in triples]
        while pending:
            at = next((i for i, x in enumerate(pending) if out is None or set(x.vars) & set(out.vars)), 0)
            nxt = pending.pop(at)
            out = nxt if out is None else A.join(out, nxt)
        return out

    def _scan(self, triple: tuple) -> A.Solutions:
        seen: dict[str, object] = {}
        cond = F.lit(True)
        for name, term in zip("spog", (*triple, *([self.graph] if isinstance(self.graph, tuple) else [])), strict=False):
            c = F.col(name)
            if term[0] != "var":
                forms = term_forms(term)
                cond = cond & (c == forms[0] if len(forms) == 1 or name != "o" else c.isin(forms))
            elif term[1] in seen:
                cond = cond & (c == seen[term[1]])
            else:
                seen[term[1]] = c
        return A.Solutions(self._rows().where(cond).select(*[c.alias(v) for v, c in seen.items()] or [F.lit(True).alias("__unit")]))

    def insert(self, rows: DataFrame) -> Quads:
        return Quads(self.df.unionByName(rows, allowMissingColumns=True).distinct(), self.graph)

    def delete(self, rows: DataFrame) -> Quads:
        on = [self.df[c].eqNullSafe(rows[c]) for c in ("g", "s", "p", "o")]
        return Quads(self.df.join(rows, on[0] & on[1] & on[2] & on[3], "left_anti"), self.graph)


_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:[^\s.]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)\s*(<[^>]*>)?\s*\.\s*(?:#.*)?$'


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples or N-Quads lines to g, s, p, o. Terms keep their form but for the brackets of IRIs and the quotes of plain strings. Lines that are none are left out; malformed_lines gives them."""
    lines = spark.read.text(path).where(F.regexp("value", F.lit(_LINE)))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^<(.*)>$", "$1"), r'^"((?:[^"\\]|\\.)*)"$', "$1")
    return lines.select(F.nullif(bare(part(4)), F.lit("")).alias("g"), bare(part(1)).alias("s"), bare(part(2)).alias("p"), bare(part(3)).alias("o"))


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: lines that read_nquads leaves out, but for blank lines and comments."""
    return spark.read.text(path).where(~F.regexp("value", F.lit(_LINE)) & ~F.regexp("value", F.lit(r"^\s*(#.*)?$")))


def write_ntriples(rows: DataFrame, path: str) -> None:
    """Writes s, p, o as N-Triples text: terms with :// are IRIs, others strings."""
    def shown(c: str):
        text = F.col(c)
        quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"([\\\\\"])", r"\\$1"), "\n", r"\\n"), F.lit('"'))
        return F.when(text.contains("://") & ~text.startswith('"'), F.concat(F.lit("<"), text, F.lit(">"))).when(text.startswith("_:") | text.startswith('"'), text).otherwise(quoted)

    rows.select(F.concat_ws(" ", shown("s"), shown("p"), shown("o"), F.lit(".")).alias("value")).write.text(path)
